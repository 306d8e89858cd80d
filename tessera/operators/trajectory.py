"""How a text's retrieval follows documents: chains of entries, bridges, fit, phase and arc.

An index entry expects a token (value) and sits at a position of a document; `hits` are what each position retrieved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import clamp, trace
from tessera.functions.stats import pearson, with_ranks
from tessera.functions.text import ngram_key
from tessera.sources.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """Lengths and counts of chains. Fixed values."""

    phrase: int = 24
    arc: int = 96
    bridge: int = 8
    seeds: int = 4


def positions(parts: DataFrame, document: str, order: str, tokens: str, gap: int = 0) -> DataFrame:
    """Where each partition starts in its document, with breaks of `gap` tokens between, and the document's length."""
    w = Window.partitionBy(document)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(F.col(tokens) + gap).over(before), F.lit(0))).withColumn("length", F.sum(tokens).over(w) + gap * (F.count(F.lit(1)).over(w) - 1))


def successors(entries: DataFrame, document: str) -> DataFrame:
    """The entry of a document's next position, if the index has it."""
    w = Window.partitionBy(document).orderBy("position")
    follows = (F.lead("position").over(w) == F.col("position") + 1) & (F.lead("entry").over(w) == F.col("entry") + 1)
    return entries.withColumn("successor", F.when(follows, F.lead("entry").over(w)))


def phase(position, length):
    """The place in a document, from 0 to 1; 0 in one of a single token."""
    return F.when(length > 1, clamp(position / (length - 1), 0, 1)).otherwise(0.0)


def wire_lengths(hits: DataFrame, text: str) -> DataFrame:
    """Per position the longest chain of hits that followed one another: entry e at one position, e + 1 at the next.

    Hits that expected the token that came are links; a chain is an island on the diagonal of entry and position within a
    document. hits: (text, j, entry, document, expected: whether the token at j + 1 was the hit's value).
    """
    came = hits.where("expected").select(text, "j", "entry", "document").distinct()
    line = Window.partitionBy(text, "document", F.col("entry") - F.col("j")).orderBy("j")
    runs = came.withColumn("_island", F.col("j") - F.row_number().over(line)).withColumn("_d", F.col("entry") - F.col("j"))
    chain = runs.withColumn("run", F.row_number().over(Window.partitionBy(text, "document", "_d", "_island").orderBy("j")))
    return chain.groupBy(text, (F.col("j") + 1).alias("j")).agg(F.max("run").alias("length"))


def moving_fit(steps: DataFrame, text: str, window: int = 32) -> DataFrame:
    """The mean over the last steps of the mass that retrieval gave the token that came."""
    return steps.withColumn("mean_fit", F.avg("fit").over(Window.partitionBy(text).orderBy("j").rowsBetween(1 - window, 0)))


def block_medians(steps: DataFrame, text: str, block: int = 16) -> DataFrame:
    """Medians of full blocks of phases."""
    w = Window.partitionBy(text).orderBy("j")
    placed = steps.withColumn("block", F.floor((F.row_number().over(w) - 1) / block).cast("int"))
    return placed.groupBy(text, "block").agg(F.count(F.lit(1)).alias("_n"), F.percentile("phase", F.lit(0.5)).alias("median")).where(F.col("_n") == block).drop("_n")


def arcs(medians: DataFrame, text: str, blocks: int = 8, least: int = 4) -> DataFrame:
    """How the last blocks' medians rise: Spearman against their order; null below `least` blocks."""
    w = Window.partitionBy(text).orderBy(F.desc("block"))
    last = medians.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= blocks)
    ranked = with_ranks(last, "median", "_r", [text])
    return ranked.groupBy(text).agg(F.when(F.count(F.lit(1)) >= least, pearson(F.col("block"), F.col("_r"))).alias("arc"))


def runs(steps: DataFrame, entries: DataFrame, text: str, rule: Rule, scratch: Scratch) -> DataFrame:
    """The runs of every text along documents: (text, document, line, first, last).

    On a line the position in the document less that in the text is the same. A run starts at j where one of the best hits
    expected the token that came at j + 1, and goes on over the line as long as the document has the tokens that come,
    whether hits say so or not. Matching hits of a line that follow each other are islands; each island is followed on to
    its first mismatch, or up to the next island, a few positions at first and four times as many in each round; islands
    that this joins are one run. Work is in proportion to the runs' lengths.
    """
    came = steps.select(text, (F.col("j") - 1).alias("j"), F.col("token").alias("came"))
    seeds = steps.select(text, "j", F.explode(F.slice("hits", 1, rule.seeds)).alias("h")).select(text, "j", "h.*")
    met = seeds.join(came, [text, "j"]).where("value = came").select(text, "document", (F.col("position") - F.col("j")).alias("line"), "j").distinct()
    line = [text, "document", "line"]
    apart = met.withColumn("_island", F.col("j") - F.row_number().over(Window.partitionBy(*line).orderBy("j")))
    along = Window.partitionBy(*line).orderBy("first")
    islands = apart.groupBy(*line, "_island").agg(F.min("j").alias("first"), F.max("j").alias("last")).drop("_island").withColumn("until", F.lead("first").over(along))
    open_ = scratch.save(islands, "islands0")
    near = scratch.save(entries.join(open_.select("document").distinct(), "document", "left_semi").select("document", "position", "value"), "near")
    ended, reach = [], 8
    while True:
        stop = F.least(F.col("last") + reach, F.col("until") - 1)
        ahead = open_.withColumn("stop", stop).withColumn("j", F.explode(F.sequence(F.col("last") + 1, F.col("stop")))).withColumn("position", F.col("j") + F.col("line"))
        seen = ahead.join(near, ["document", "position"], "left").join(came, [text, "j"], "left")
        wrong = F.min(F.when(~F.coalesce(F.col("value") == F.col("came"), F.lit(False)), F.col("j"))).alias("wrong")
        found = seen.groupBy(*line, "first", "until", "stop").agg(wrong)
        done = F.col("wrong").isNotNull() | F.coalesce(F.col("stop") == F.col("until") - 1, F.lit(False))
        found = scratch.save(found.select(*line, "first", F.coalesce(F.col("wrong") - 1, F.col("stop")).alias("last"), "until", done.alias("done")), f"islands{len(ended) + 1}")
        ended.append(found.where("done").drop("done"))
        open_ = found.where("NOT done").drop("done")
        if open_.isEmpty():
            break
        reach *= 4
    whole = ended[0]
    for other in ended[1:]:
        whole = whole.unionByName(other)
    new = F.when(F.lag("last").over(along) + 1 == F.col("first"), 0).otherwise(1)
    numbered = whole.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    return numbered.groupBy(*line, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def bridged(found: DataFrame, text: str, rule: Rule, scratch: Scratch) -> DataFrame:
    """What runs take over from earlier ones: (text, document, line, first, before), runs that take over nothing left out.

    A run of at least `bridge` tokens continues one as long that ended at most `bridge` tokens before it began, in the text
    and in the document. A run is taken over once, by the first that can; of several a run takes the longest, then the one
    that ended last. `before` sums a run's predecessors, by doubling steps along their chain.
    """
    long = found.where(F.col("last") - F.col("first") + 1 >= rule.bridge)
    old = long.select(text, "document", F.col("line").alias("up_line"), F.col("first").alias("up_first"), F.col("last").alias("_end"), F.explode(F.sequence(F.col("last") + 1, F.col("last") + 1 + rule.bridge)).alias("first"))
    gap = F.col("first") + F.col("line") - F.col("_end") - 1 - F.col("up_line")
    able = long.select(text, "document", "line", "first").join(old, [text, "document", "first"]).where(gap.between(0, rule.bridge)).withColumn("before", F.col("_end") - F.col("up_first") + 1)
    taker = Window.partitionBy(text, "document", "up_line", "up_first").orderBy("first", "line")
    pick = Window.partitionBy(text, "document", "line", "first").orderBy(F.desc("before"), F.desc("_end"), "up_line")
    chosen = able.withColumn("_r", F.row_number().over(taker)).where("_r = 1").withColumn("_r", F.row_number().over(pick)).where("_r = 1")
    state = scratch.save(chosen.select(text, "document", "line", "first", "up_line", "up_first", "before"), "bridges0")
    k = 0
    while not state.where("up_line IS NOT NULL").isEmpty():
        up = state.select(F.col(text).alias("_t"), F.col("document").alias("_d"), F.col("line").alias("_l"), F.col("first").alias("_f"), F.col("up_line").alias("_ul"), F.col("up_first").alias("_uf"), F.col("before").alias("_b"))
        same = (F.col(text) == F.col("_t")) & (F.col("document") == F.col("_d")) & (F.col("up_line") == F.col("_l")) & (F.col("up_first") == F.col("_f"))
        k += 1
        state = scratch.save(state.join(up, same, "left").select(text, "document", "line", "first", F.col("_ul").alias("up_line"), F.col("_uf").alias("up_first"), (F.col("before") + F.coalesce("_b", F.lit(0))).alias("before")), f"bridges{k}")
    return state.drop("up_line", "up_first")


def tracked(steps: DataFrame, entries: DataFrame, text: str, rule: Rule | None = None) -> DataFrame:
    """Chain length and trace at every position of every text: (text, j, token, hits: array of (document, position, value), best first).

    A position's length is the greatest number of tokens that a run has come to there, from `bridge` tokens on with those of
    the runs that it continues; 0 where none matches. `entries` is the index: (document, position, value).
    """
    rule = rule or Rule()
    scratch = Scratch(steps.sparkSession, "tracked")
    steps = steps.withColumn("j", F.col("j").cast("long"))
    entries = entries.withColumn("position", F.col("position").cast("long"))
    found = scratch.save(runs(steps, entries, text, rule, scratch), "runs")
    held = found.join(bridged(found, text, rule, scratch), [text, "document", "line", "first"], "left")
    at = held.withColumn("j", F.explode(F.sequence("first", "last"))).withColumn("own", F.col("j") - F.col("first") + 1)
    mass = F.col("own") + F.when(F.col("own") >= rule.bridge, F.coalesce("before", F.lit(0))).otherwise(0)
    lengths = at.groupBy(text, (F.col("j") + 1).alias("j")).agg(F.max(mass).alias("length"))
    out = steps.select(text, "j").join(lengths, [text, "j"], "left").select(text, "j", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    return out.withColumn("trace", trace(F.col("length"), rule.phrase, rule.arc))


def contexts(tokens: DataFrame, text: str, order: str, levels: tuple[int, ...]) -> DataFrame:
    """Every token with its last tokens of each level's number as a key: `keys`, an array of (level, high, low), longest first.

    A key is exact: up to four 16-bit tokens in each of two numbers. Tokens without that many before them lack the level.
    """
    w = Window.partitionBy(text).orderBy(order)
    back = [F.lag("token", k).over(w) if k else F.col("token") for k in range(max(levels))]
    with_back = tokens.select("*", *[t.alias(f"_b{k}") for k, t in enumerate(back)])
    b = [F.col(f"_b{k}") for k in range(len(back))]
    none = F.lit(0).cast("long")
    key = lambda n: F.when(b[n - 1].isNotNull(), F.struct(F.lit(n).alias("level"), (ngram_key(*b[4:n], bits=16) if n > 4 else none).alias("high"), ngram_key(*b[: min(n, 4)], bits=16).alias("low")))
    return with_back.withColumn("keys", F.filter(F.array(*[key(n) for n in sorted(levels, reverse=True)]), lambda x: x.isNotNull())).drop(*[f"_b{k}" for k in range(len(back))])


#: Keys of texts' positions that are broadcast; more are joined like any other table.
MOST_KEYS = 200_000


def retrieved(steps: DataFrame, entries: DataFrame, text: str, k: int = 16, levels: tuple[int, ...] = (8, 4, 2, 1)) -> DataFrame:
    """The k best entries of every position: (text, j, hits: array of (document, position, value)).

    steps: (text, j, token); entries: (document, position, token, value).

    An entry of the same token is better the more of the tokens before it are those before the position, by levels, and the
    lower one is better among equals. Of each key only its k lowest entries can be among a position's k best, so common
    tokens are cut to those before anything is joined to positions.
    """
    asked = contexts(steps, text, "j", levels).select(text, "j", F.explode("keys").alias("key")).select(text, "j", "key.*")
    keys = asked.select("level", "high", "low").distinct()
    keys = keys if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS else F.broadcast(keys)
    held = contexts(entries, "document", "position", levels).select("document", "position", "value", F.explode("keys").alias("key")).select("document", "position", "value", "key.*")
    low = Window.partitionBy("level", "high", "low").orderBy("document", "position")
    first = held.join(keys, ["level", "high", "low"], "left_semi").withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= k).drop("_r")
    met = asked.join(first, ["level", "high", "low"]).groupBy(text, "j", "document", "position").agg(F.max("level").alias("level"), F.first("value").alias("value"))
    best = Window.partitionBy(text, "j").orderBy(F.desc("level"), "document", "position")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document", "position", "value"))), lambda x: F.struct(x["document"].alias("document"), x["position"].alias("position"), x["value"].alias("value")))
    return ranked.groupBy(text, "j").agg(hits.alias("hits"))
