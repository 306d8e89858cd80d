"""Decision rules over measured arms: predicates on aggregates, and the arm they pick.

Thresholds are fixed values. Every rule is a row (rule, passed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-6


def verdicts(df: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per group and rule; a rule that can't be told fails."""
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for name, c in rules.items()])
    return df.select(*by, F.explode(entries).alias("_r")).select(*by, "_r.rule", "_r.passed")


def qualifies(rules: DataFrame, by: list[str]) -> DataFrame:
    return rules.groupBy(*by).agg(F.bool_and("passed").alias("qualifies"))


def cumulative(rules: DataFrame, order: str) -> DataFrame:
    """Arms qualify in order: one that fails stops all after it."""
    arms = rules.groupBy("arm", order).agg(F.bool_and("passed").alias("own"))
    return arms.withColumn("qualifies", F.bool_and("own").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def gate_arms(rows: DataFrame, baseline: str) -> DataFrame:
    """The gate benchmark's rule for each candidate arm: its requirements, fidelity and whether it is eligible.

    rows: (arm, place, candidate, set, example, exact, leads, cited, all_asked, gate, fidelity_sum, fidelity_tokens).
    """
    base = rows.where((F.col("arm") == baseline) & (F.col("set") == "facts"))
    base_exact = base.agg(F.count_if("exact").alias("base_exact"))
    owned = base.where("leads AND cited").select("example", F.lit(True).alias("base_owned")).distinct()
    marked = rows.where("candidate").join(owned, "example", "left")
    on = lambda name: F.col("set") == name
    own = F.coalesce(F.col("leads") & F.col("cited"), F.lit(False))
    share = lambda name, flag: F.try_divide(F.count_if(on(name) & flag).cast("double"), F.count_if(on(name)).cast("double"))
    scored = F.col("set").isin("facts", "pairs")
    arms = marked.groupBy("arm", "place").agg(
        F.count_if(on("facts") & F.col("exact")).alias("exact"), F.count_if(on("facts") & F.coalesce("base_owned", F.lit(False)) & ~own).alias("lost"), share("pairs", own).alias("moved"),
        share("pairs", F.col("exact")).alias("pairs_exact"), share("facts", F.col("exact")).alias("facts_exact"), share("unknown", F.col("all_asked")).alias("unknown_asked"),
        F.avg(F.when(on("unknown"), F.col("gate"))).alias("unknown_gate"), share("generic", F.col("all_asked")).alias("generic_asked"), F.avg(F.when(on("generic"), F.col("gate"))).alias("generic_gate"),
        F.coalesce(F.try_divide(F.sum(F.when(scored, F.col("fidelity_sum"))), F.sum(F.when(scored, F.col("fidelity_tokens"))).cast("double")), F.lit(0.0)).alias("fidelity"),
    )
    good = (
        (F.col("exact") >= F.col("base_exact") - 1) & (F.col("lost") == 0) & (F.col("moved") >= 0.9) & (F.col("pairs_exact") >= F.col("facts_exact") - 0.1)
        & (F.col("unknown_asked") >= 0.9) & (F.col("unknown_gate") <= 0.8) & (F.col("generic_asked") >= 1) & (F.col("generic_gate") <= 0.65)
    )
    # The baseline's count is one row.
    return arms.join(F.broadcast(base_exact)).withColumn("eligible", F.coalesce(good, F.lit(False)))


def winner(arms: DataFrame, band: float = 0.02) -> DataFrame:
    """Of the eligible arms within the band of the best fidelity, the one listed first; null where none is eligible."""
    w = Window.partitionBy()
    near = arms.where("eligible").withColumn("_best", F.max("fidelity").over(w)).where(F.col("fidelity") >= F.col("_best") - band)
    return near.agg(F.min_by("arm", "place").alias("winner"))


def umbrella_rules() -> dict[str, Column]:
    """Facts, pairs, nobody's text and attribution of an arm against the first: columns of the arm, `v1_` those of the first."""
    c = F.col
    level = (c("facts") > 0) & (c("v1_facts") > 0) & (c("exact") / c("facts") >= c("v1_exact") / c("v1_facts") - 1 / 30 - 1e-9)
    return {
        "U1": level & (c("owned") >= c("v1_owned")), "U2": c("moved") >= 0.9, "U3": (c("commons_leads") >= 0.9) & (c("thread_gate") <= 0.35),
        "U4": (c("thread_share") <= 0.10) & (c("owner_share") >= 0.90) & (c("lift_positive") >= 0.95),
    }


def architecture_rules() -> dict[str, Column]:
    """An arm's node against the reference's: learning, answers, general text, breaks."""
    c = F.col
    return {
        "A1": c("steps_to_97").isNotNull() & F.coalesce(c("steps_to_97") <= 1.25 * c("ref_steps_to_97"), F.lit(True)), "A2": c("greedy") >= c("ref_greedy") - 0.02,
        "A3": c("held_out").isNotNull() & F.coalesce(c("held_out") <= c("ref_held_out"), F.lit(True)), "A4": (c("boundaries") > 0) & (c("break_rate") >= 0.8), "A5": c("citations_on_breaks") == 0,
        "B1": c("steps_to_97").isNotNull() & F.coalesce(c("steps_to_97") <= 0.75 * c("ref_steps_to_97"), F.lit(True)),
        "M3": c("held_out").isNotNull() & F.coalesce(c("held_out") <= c("ref_held_out") + 0.02, F.lit(True)),
        "W1": c("steps").isNotNull() & F.coalesce(c("steps") <= 1.5 * c("ref_steps"), F.lit(True)),
    }


def commons_rules() -> dict[str, Column]:
    """A child commons is no worse than its parent: columns child_ and parent_."""
    c = F.col
    return {
        "C1": c("child_loss") <= c("parent_loss") + SLACK, "C2": (c("child_exact") >= c("parent_exact") - 1 / 30 - SLACK) & (c("child_citation") >= c("parent_citation") - 0.02 - SLACK),
        "C3": c("child_leads") >= c("parent_leads") - 0.02 - SLACK, "C4": (c("child_share") <= c("parent_share") + 0.02 + SLACK) & (c("child_lift") >= c("parent_lift") - 0.02 - SLACK),
    }


def question_rules() -> dict[str, Column]:
    """The arm that rewrites questions: fidelity, exactness, citation, unknowns, shared and copied facts."""
    c = F.col
    return {
        "Q1": (c("questions") > 0) & (c("rewrite_rate") >= 1 - SLACK), "Q2": c("exact_rate") >= c("stem_exact_rate") - 0.05 - SLACK, "Q2'": c("exact_rate") >= c("slice_exact_rate") - 0.10 - SLACK,
        "Q3": (c("exact_rate") > 0) & (c("cited_rate") >= 0.9), "Q4": (c("unknown") > 0) & (c("unknown_lead_rate") >= 0.8) & (c("unknown_credit") <= 0.25),
        "Q5a": (c("shared") > 0) & (c("decided_rate") >= 0.6) & (c("followed_rate") >= 0.9) & (c("duplicate_credit") <= 0.10), "Q5b": (c("copied") == 0) | ((c("tie_rate") >= 0.9) & (c("taken") == 0)),
    }


def route_rules() -> dict[str, Column]:
    """Routing keeps the answers and, with many nodes, cuts the cost."""
    c = F.col
    cheap = (c("opened") <= c("nodes") / 4 + 1e-9) & (c("ratio") > 0) & (c("ratio") <= 0.5 + 1e-9)
    return {
        "R1": (c("facts") > 0) & (c("found") / c("facts") >= 0.99 - SLACK), "R2": (c("exact") >= c("plain_exact") - 1 / 30 - SLACK) & (c("citation") >= c("plain_citation") - 0.02 - SLACK) & (c("moved") >= c("plain_moved") - 2 / 60 - SLACK),
        "R3": F.when(c("nodes") >= 24, cheap).when(c("nodes") <= 3, (c("ratio") > 0) & (c("ratio") <= 1.05 + 1e-9)).otherwise(True),
    }


def profile_rules() -> dict[str, Column]:
    """Profiles open the nodes a prompt needs, few of them, and the credit stays inside."""
    c = F.col
    return {
        "P1": (c("facts") > 0) & (c("found") / c("facts") >= 0.99 - SLACK), "P2": c("opened") <= 4 + 1e-9, "P3": c("recall") >= 0.95 - SLACK, "P4": (c("copies") > 0) & (c("within") == c("copies")) & (c("together") == c("copies")),
        "S1": (c("questions") > 0) & (c("owner_opened") / c("questions") >= 0.99 - SLACK) & (c("owner_leads") / c("questions") >= 0.90 - SLACK), "S2": (c("stray_opened") <= 0.10 + 1e-9) & (c("stray_share") <= 0.10 + 1e-9),
        "S3": (c("exact") > 0) & (c("owner_share") >= 0.90 - SLACK) & (c("lift_rate") >= 0.95 - SLACK), "S4": (c("homonyms") > 0) & (c("decided") / c("homonyms") >= 0.90 - SLACK),
    }


def scale_points(points: DataFrame) -> DataFrame:
    """Each point beside the one with the fewest nodes, then its rules. Points are a few rows, so one ordered window serves."""
    w = Window.partitionBy().orderBy("nodes").rowsBetween(Window.unboundedPreceding, 0)
    first = points.withColumn("_exact", F.first("exact").over(w)).withColumn("_citation", F.first("citation").over(w))
    c = F.col
    return verdicts(first, ["nodes"], {
        "N1": (c("exact") >= c("_exact") - 1 / 30 - SLACK) & (c("owned") >= 0.90 - SLACK) & (c("citation") >= c("_citation") - 0.02 - SLACK), "N2": (c("leads") >= 0.90 - SLACK) & (c("thread_share") <= 0.10 + SLACK),
    })


def hosted_rules() -> dict[str, Column]:
    c = F.col
    return {"H1": (c("prompts") > 0) & (c("identical") == c("prompts")) & (c("largest") <= 1e-6), "H3": (c("ratio") > 0) & (c("ratio") <= 1.2 + 1e-9)}


def thought_rules() -> dict[str, Column]:
    """Over all nodes: a readout is faithful, ahead, and tells who knows."""
    c = F.col
    return {
        "L1": F.bool_and((c("positions") > 0) & (c("lens") >= c("identity") + 0.10)), "L2": F.bool_and((c("ahead") > 0) & (c("lens_ahead") > c("output_ahead")) & (c("lens_ahead") > c("identity_ahead"))),
        "L3": (F.avg("source") >= F.avg("control") + 0.20) & (F.avg("source") >= F.avg("output") + 0.10),
    }


def vocabulary_choice(rows: DataFrame) -> DataFrame:
    """The seeded arm, else the commons arm, that reached the target in at most twice the baseline's epochs and five points of its answers; else each its own."""
    base = rows.where("name = 'baseline'").select(F.col("epochs").alias("_e"), F.col("exact").alias("_x"))
    passing = rows.join(F.broadcast(base)).where(F.col("epochs").isNotNull() & F.coalesce(F.col("epochs") <= 2 * F.col("_e"), F.lit(True)) & (F.col("exact") >= F.col("_x") - 0.05))
    pick = lambda prefix: F.min_by(F.when(F.startswith("name", F.lit(prefix)), F.col("name")), F.when(F.startswith("name", F.lit(prefix)), F.struct(F.col("epochs"), -F.col("exact"))))
    return passing.agg(F.coalesce(pick("seeded"), pick("commons"), F.lit("per thread")).alias("choice"))


def trajectory_rules(readings: DataFrame, holder: float = 0.40, low: float = 0.10, ask: float = 0.25) -> DataFrame:
    """Whether traces tell the holder of a text, and manner its voice: T1 to T3, M1 and M3.

    readings: (text, kind, owner, strand, trace, manner), one row per text and strand.
    """
    c = F.col
    own, kind = c("strand") == c("owner"), lambda *k: c("kind").isin(*k)
    share = lambda cond, flag: F.avg(F.when(cond, flag.cast("double")))
    texts = readings.groupBy("text", "kind").agg(
        F.max("trace").alias("top"), F.avg("trace").alias("mean"), F.max(F.when(own, c("manner"))).alias("own"), F.max(F.when(~own, c("manner"))).alias("other"), F.max("manner").alias("most"),
    )
    by_reading = readings.agg(
        share(kind("held") & own, c("trace") >= holder).alias("held"), share(kind("shuffled", "collage") & own, c("trace") <= low).alias("apart"),
        share(kind("told", "source") & own, c("trace") >= holder).alias("holders"), share(kind("told", "source") & ~own, c("trace") <= low).alias("others"),
    )
    voice = lambda k: F.coalesce((share(kind(k), c("top") <= low) >= 0.95) & (F.avg(F.when(kind(k), c("mean"))) <= 0.05), F.lit(False))
    by_text = texts.agg(
        voice("voice").alias("v"), voice("voice_shuffled").alias("s"), voice("generic").alias("g"),
        share(kind("voice"), c("own") > F.coalesce("other", F.lit(-1.0))).alias("m1"), F.sum(F.when(kind("generic"), (F.coalesce("most", F.lit(0.0)) >= ask).cast("int"))).alias("m3"),
    )
    return verdicts(by_reading.join(F.broadcast(by_text)), [], {
        "T1": (c("held") >= 0.9) & (c("apart") >= 0.9), "T2": (c("holders") >= 0.9) & (c("others") >= 0.9), "T3": c("v") & c("s") & c("g"), "M1": c("m1") >= 0.8, "M3": c("m3") == 0,
    })


def promotion_gates(candidate: DataFrame, floor: float = 0.90) -> DataFrame:
    """A version's gates: a trained one has memorised enough, vocabularies match, nothing withdrawn is indexed, probes verify.

    Where the columns are there, also: its trunk is the expected one, and its rows are those of the corpus (no strays).
    """
    c = F.col
    gates = {"memorised": (c("kind") != "train") | (c("memorised") >= floor), "vocabulary": c("vocabulary") == c("expected_vocabulary"), "withdrawn": c("leaked") == 0, "verified": c("unverified") == 0}
    if "trunk" in candidate.columns:
        gates["trunk"] = c("trunk") == c("expected_trunk")
    if "strays" in candidate.columns:
        gates["chain"] = c("strays") == 0
    return verdicts(candidate, ["version"], gates)
