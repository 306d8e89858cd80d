"""Ledgers, evaluation and decision rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import token_id, words
from tessera.operators import cite, evaluate, ledger, rules
from tessera.session import table

from .base import LIKELIHOODS, PROMPTS, TOKENS, documents, hits, likelihoods, prompts, query, rounded, tokens

LOSSES = TOKENS + ", losses AS (SELECT doc_id AS row, pos AS offs, token % 1000 AS thousandths, (token % 1000) / 1000.0::DOUBLE AS loss, (token % 777) / 777.0::DOUBLE AS entropy, lang FROM tokens)"


def losses(spark, sf):
    """A loss and an entropy for every token, from its id."""
    return tokens(spark, sf).select(F.col("doc_id").alias("row"), F.col("pos").alias("offset"), ((F.col("token") % 1000) / 1000.0).alias("loss"), ((F.col("token") % 777) / 777.0).alias("entropy"), "lang")


def listed_losses(spark, sf):
    """The same, a document's in two lists: texts become words and measures where they are."""
    t = documents(spark, sf).select(F.col("doc_id").alias("row"), F.transform(words(F.col("text")), token_id).alias("token"))
    return t.select("row", F.transform("token", lambda x: (x % 1000) / 1000.0).alias("loss"), F.transform("token", lambda x: (x % 777) / 777.0).alias("entropy"))


@query("partition_stats", f"WITH {LOSSES} SELECT doc_id AS row, count(loss) FILTER (loss IS NOT NULL) AS positions, sum(thousandths)::DOUBLE / 1000.0::DOUBLE / count(loss) AS mean_loss, round(avg(entropy), 6) AS mean_entropy, max(loss) AS max_loss, round(quantile_cont(loss, 0.9), 6) AS p90_loss, round(avg((loss < 0.1)::INT), 6) AS memorised FROM documents LEFT JOIN losses ON row = doc_id GROUP BY 1")
def partition_stats(spark, sf):
    s = ledger.partition_stats(listed_losses(spark, sf), documents(spark, sf).select(F.col("doc_id").alias("row")))
    # The mean loss is exact on both sides; rounded, means that lie halfway between two places would part.
    return rounded(s.withColumn("positions", F.coalesce("positions", F.lit(0))), "mean_entropy", "p90_loss", "memorised")


@query("memorised_fraction", f"WITH {LOSSES} SELECT lang, round(coalesce(avg((loss < 0.1)::INT), 0), 6) AS memorised FROM losses GROUP BY 1")
def memorised_fraction(spark, sf):
    return rounded(losses(spark, sf).groupBy("lang").agg(ledger.memorised_share(F.col("loss")).alias("memorised")))


@query("fact_losses_left_join", f"""WITH {LOSSES}, f AS (SELECT doc_id AS fact, unnest(range(8, 12)) AS offs FROM documents), j AS (SELECT fact, f.offs, coalesce(loss, 'nan'::DOUBLE) AS loss FROM f LEFT JOIN losses ON row = fact AND losses.offs = f.offs)
    SELECT fact, list(loss ORDER BY offs) AS losses, bool_and(loss < 0.1 AND NOT isnan(loss)) AS memorised FROM j GROUP BY 1""")
def fact_losses_left_join(spark, sf):
    facts = documents(spark, sf).select(F.col("doc_id").alias("fact"), F.col("doc_id").alias("row"), F.lit(8).alias("first"), F.lit(12).alias("last"))
    return ledger.fact_losses(facts, losses(spark, sf))


@query("value_position_last_write", "SELECT user_id AS row, event_id % 20 AS offset, arg_max(value, event_id) AS loss FROM events GROUP BY 1, 2")
def value_position_last_write(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("row"), (F.col("event_id") % 20).alias("offset"), F.col("event_id").alias("seq"), F.col("value").alias("loss"))
    return ledger.by_value_position(e)


@query("train_loss_by_epoch", "SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS epoch, count(*) AS positions, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2")
def train_loss_by_epoch(spark, sf):
    e = table(spark, sf, "events").withColumn("epoch", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(e.groupBy("event_type", "epoch").agg(F.count(F.lit(1)).alias("positions"), F.avg("value").alias("loss")))


EPOCHS = """m AS (SELECT l_returnflag AS run, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS epoch, count(*) AS steps FROM lineitem GROUP BY 1, 2),
epochs AS (SELECT *, sum(steps) OVER (PARTITION BY run ORDER BY epoch)::DOUBLE / sum(steps) OVER (PARTITION BY run) AS memorised FROM m)"""


def epochs(spark, sf):
    """Months as epochs of three runs, rows as steps, the share of a run's rows so far as what it has memorised."""
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch")).agg(F.count(F.lit(1)).alias("steps"))
    w = Window.partitionBy("run")
    return m.withColumn("memorised", F.sum("steps").over(w.orderBy("epoch")) / F.sum("steps").over(w))


@query("memorised_at_epoch", f"WITH {EPOCHS} SELECT run, epoch, min(CASE WHEN memorised >= 0.95 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS memorised_at FROM epochs")
def memorised_at_epoch(spark, sf):
    return ledger.memorised_at(epochs(spark, sf), "run").select("run", "epoch", "memorised_at")


@query("steps_to_threshold", f"WITH {EPOCHS}, c AS (SELECT *, sum(steps) OVER (PARTITION BY run ORDER BY epoch) AS total FROM epochs) SELECT run, min(CASE WHEN memorised >= 0.97 THEN total END)::BIGINT AS steps FROM c GROUP BY 1")
def steps_to_threshold(spark, sf):
    return ledger.steps_to(epochs(spark, sf), "run", "memorised", 0.97)


@query("latest_by_key", f"WITH {EPOCHS} SELECT run, round(arg_max(memorised, epoch), 6) AS memorised FROM epochs GROUP BY 1")
def latest_by_key(spark, sf):
    return rounded(ledger.latest(epochs(spark, sf), "run", "epoch", "memorised"))


@query("masked_loss", f"WITH {LOSSES} SELECT lang, round(sum(loss * (offs % 2)) / sum(offs % 2), 6) AS loss FROM losses GROUP BY 1")
def masked_loss(spark, sf):
    return rounded(ledger.masked_loss(losses(spark, sf).withColumn("mask", F.col("offset") % 2), ["lang"]))


@query("marginal_cost", """WITH w AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS sl, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS ss, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS tl, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS ts FROM orders GROUP BY 1) SELECT round(avg((sl - ss) / nullif(tl - ts, 0)), 5) AS cost FROM w""")
def marginal_cost(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "long").when(F.col("o_orderstatus") == "O", "short").alias("kind"), F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("tokens"))
    return ledger.marginal_cost(o, "o_custkey").select(F.round("cost", 5).alias("cost"))


@query("parameter_activity", "WITH a AS (SELECT l_returnflag, sqrt(sum((l_extendedprice * l_discount) ** 2) / greatest(sum((l_extendedprice * (1 - l_discount)) ** 2), 1e-12)) AS moved FROM lineitem GROUP BY 1) SELECT l_returnflag, round(moved, 6) AS moved, round(moved / max(moved) OVER (), 6) AS activity FROM a")
def parameter_activity(spark, sf):
    w = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("now"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("before"))
    return rounded(ledger.activity(w, ["l_returnflag"]))


JOINED = "j AS (SELECT d.doc_id, lang, source, n_chars, quality = 1 AS good, toxic = 1 AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def joined(spark, sf):
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


@query("lambda_metrics", f"WITH {JOINED} SELECT lang, count(*) AS facts, round(avg(good::INT), 6) AS exact, round(avg(n_chars / 1e4), 6) AS citation, round(avg(CASE WHEN good THEN n_chars / 1e4 END), 6) AS citation_on_exact, round(avg(toxic::INT), 6) AS covered, round(avg(least(n_chars / 5e3, 1)), 6) AS confidence FROM j GROUP BY 1")
def lambda_metrics(spark, sf):
    o = joined(spark, sf).select("lang", F.col("good").alias("exact"), (F.col("n_chars") / 1e4).alias("citation"), F.col("toxic").alias("covered"), F.least(F.col("n_chars") / 5e3, F.lit(1.0)).alias("confidence"))
    return rounded(evaluate.lambda_metrics(o, "lang"))


BENCH = JOINED + """, b AS (SELECT lang AS arm, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS place, lang <> 'en' AS candidate, (['facts', 'pairs', 'unknown', 'generic'])[doc_id % 4 + 1] AS "set", doc_id // 7 AS example, good AS exact, NOT toxic AS leads, CASE WHEN n_chars > 50 THEN n_chars > 300 END AS cited, n_chars > 100 AS all_asked, least(n_chars / 2e4, 0.6) AS gate, n_chars / 1e3 AS fidelity_sum, n_chars // 900 AS fidelity_tokens FROM j)"""


def bench(spark, sf):
    """Labelled documents as a benchmark's rows: languages as arms, four sets."""
    sets = F.array(*[F.lit(s) for s in ("facts", "pairs", "unknown", "generic")])
    return joined(spark, sf).select(
        F.col("lang").alias("arm"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3).alias("place"), (F.col("lang") != "en").alias("candidate"),
        F.get(sets, (F.col("doc_id") % 4).cast("int")).alias("set"), F.floor(F.col("doc_id") / 7).alias("example"), F.col("good").alias("exact"), (~F.col("toxic")).alias("leads"),
        F.when(F.col("n_chars") > 50, F.col("n_chars") > 300).alias("cited"), (F.col("n_chars") > 100).alias("all_asked"), F.least(F.col("n_chars") / 2e4, F.lit(0.6)).alias("gate"),
        (F.col("n_chars") / 1e3).alias("fidelity_sum"), F.floor(F.col("n_chars") / 900).alias("fidelity_tokens"),
    )


@query("bench_summary_by_arm_set", f"""WITH {BENCH} SELECT arm, "set", count(*) AS prompts, round(avg(exact::INT), 6) AS exact, round(avg(leads::INT), 6) AS leads, round(avg(cited::INT), 6) AS cited, round(coalesce(avg(all_asked::INT), 0), 6) AS all_asked, round(avg(gate), 6) AS gate, round(sum(fidelity_sum) / nullif(sum(fidelity_tokens), 0), 6) AS fidelity FROM b GROUP BY 1, 2""")
def bench_summary_by_arm_set(spark, sf):
    return rounded(evaluate.arm_summary(bench(spark, sf), ["arm", "set"]))


ARMS = BENCH + """, base AS (SELECT DISTINCT example FROM b WHERE arm = 'en' AND "set" = 'facts' AND leads AND cited), be AS (SELECT count(*) FILTER (exact) AS n FROM b WHERE arm = 'en' AND "set" = 'facts'),
arms AS (SELECT arm, place, count(*) FILTER ("set" = 'facts' AND exact) AS exact, count(*) FILTER ("set" = 'facts' AND example IN (SELECT * FROM base) AND NOT coalesce(leads AND cited, false)) AS lost,
    avg(coalesce(leads AND cited, false)::INT) FILTER ("set" = 'pairs') AS moved, avg(exact::INT) FILTER ("set" = 'pairs') AS pe, avg(exact::INT) FILTER ("set" = 'facts') AS fe, avg(all_asked::INT) FILTER ("set" = 'unknown') AS ua, avg(gate) FILTER ("set" = 'unknown') AS ug,
    avg(all_asked::INT) FILTER ("set" = 'generic') AS ga, avg(gate) FILTER ("set" = 'generic') AS gg, coalesce(sum(fidelity_sum) FILTER ("set" IN ('facts', 'pairs')) / nullif(sum(fidelity_tokens) FILTER ("set" IN ('facts', 'pairs')), 0), 0) AS fidelity FROM b WHERE candidate GROUP BY 1, 2),
ok AS (SELECT *, coalesce(exact >= n - 1 AND lost = 0 AND moved >= 0.9 AND pe >= fe - 0.1 AND ua >= 0.9 AND ug <= 0.8 AND ga >= 1 AND gg <= 0.65, false) AS eligible FROM arms, be)"""


@query("decide_arm_rule", f"WITH {ARMS} SELECT arm, exact, lost, round(moved, 6) AS moved, round(fidelity, 6) AS fidelity, eligible FROM ok")
def decide_arm_rule(spark, sf):
    b = bench(spark, sf)
    return rounded(rules.gate_arms(b, "en").select("arm", "exact", "lost", "moved", "fidelity", "eligible"))


@query("arm_winner", f"WITH {ARMS} SELECT arg_min(arm, place) AS winner FROM (SELECT *, max(fidelity) OVER () AS best FROM ok WHERE gg <= 0.65) WHERE fidelity >= best - 0.02")
def arm_winner(spark, sf):
    return rules.winner(rules.gate_arms(bench(spark, sf), "en").withColumn("eligible", F.col("generic_gate") <= 0.65))


@query("fidelity_l1", f"""WITH {LIKELIHOODS}, s AS (SELECT *, p / sum(p) OVER (PARTITION BY item_id, position) AS share, p * 40 >= 0.5 AS knew FROM likelihoods), e AS (SELECT *, count(*) FILTER (knew) OVER (PARTITION BY item_id, position) AS n FROM s)
    SELECT item_id, position, round(1 - sum(abs(share - CASE WHEN knew THEN 1.0::DOUBLE / n ELSE 0 END)) / 2, 6) AS fidelity FROM e WHERE n > 0 GROUP BY 1, 2""")
def fidelity_l1(spark, sf):
    s = likelihoods(spark, sf).withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("item_id", "position"))).withColumn("alone", F.col("p") * 40)
    return rounded(evaluate.fidelity(s, ["item_id", "position"]))


@query("compare_runs", """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS entry, e.label AS value, q.label AS own, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
    a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS rank FROM s QUALIFY rank <= 16), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS rank FROM s WHERE value <> own QUALIFY rank <= 16)
    SELECT coalesce(a.query, b.query) AS query, bool_and(coalesce(a.entry = b.entry, false)) AS identical, round(max(abs(a.score - b.score)), 6) AS largest FROM a FULL JOIN b ON a.query = b.query AND a.rank = b.rank GROUP BY 1""")
def compare_runs(spark, sf):
    return rounded(evaluate.compared(hits(spark, sf), hits(spark, sf, apart=True), ["query", "rank"], "entry", "score", ["query"]))


@query("overlay_measures", f"WITH {JOINED} SELECT d.doc_id, coalesce(j.good::INT, d.n_chars)::BIGINT AS measure FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id")
def overlay_measures(spark, sf):
    other = joined(spark, sf).select("doc_id", F.col("good").cast("long").alias("measure"))
    return evaluate.overlay(documents(spark, sf).select("doc_id", F.col("n_chars").alias("measure")), other, ["doc_id"], ["measure"])


@query("range_join_lookahead", f"""WITH {PROMPTS}, t AS (SELECT item_id, pos, [token % 512, (token * 7) % 512] AS top FROM prompts), c AS (SELECT item_id, pos, token % 512 AS token FROM prompts WHERE length(word) > 3)
    SELECT t.item_id, t.pos, coalesce(bool_or(list_contains(top, c.token)), false) AS held FROM t LEFT JOIN c ON c.item_id = t.item_id AND c.pos BETWEEN t.pos + 2 AND t.pos + 8 GROUP BY 1, 2""")
def range_join_lookahead(spark, sf):
    p = prompts(spark, sf)
    tops = p.select("item_id", "pos", F.array(F.col("token") % 512, (F.col("token") * 7) % 512).alias("top"))
    content = p.select("item_id", "pos", (F.col("token") % 512).alias("token"), F.when(F.length("word") > 3, "content").otherwise("form").alias("role"))
    return evaluate.ahead(content, tops, "item_id")


@query("credit_recall", f"WITH {LIKELIHOODS} SELECT round(sum(CASE WHEN p > 0.001 THEN p * position ELSE 0 END) / sum(p * position), 6) AS recall FROM likelihoods")
def credit_recall(spark, sf):
    r = likelihoods(spark, sf).select("strand", F.col("position").alias("bits"), F.col("p").alias("credit"), (F.col("p") > 0.001).alias("open"))
    return rounded(evaluate.credit_recall(r))


@query("first_gate", f"WITH {LIKELIHOODS} SELECT item_id, round(max(p), 6) AS gate, bool_and(p > 0.001) AS all_asked FROM likelihoods WHERE position = 0 GROUP BY 1")
def first_gate(spark, sf):
    r = likelihoods(spark, sf).select("item_id", "position", F.col("p").alias("gate"), (F.col("p") > 0.001).alias("open"))
    return rounded(evaluate.first_gate(r, "item_id"))


@query("node_tally", f"WITH {JOINED} SELECT source, count(*) FILTER (good) AS hits, count(*) AS n FROM j GROUP BY 1")
def node_tally(spark, sf):
    return evaluate.tally(joined(spark, sf), ["source"], "good")


@query("fact_scores", f"""WITH {JOINED}, f AS (SELECT doc_id AS fact, doc_id AS row, 3 AS first, 4 AS length FROM j), a AS (SELECT doc_id AS fact, u.i AS i, CASE WHEN (doc_id + u.i) % 3 = 0 THEN doc_id ELSE doc_id + 1 END AS tr, 3 + u.i + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS tof, CASE WHEN good THEN doc_id END AS cr, CASE WHEN good THEN 0.5 END AS c FROM j, range(6) u(i))
    SELECT fact, round(count(*) FILTER (tr = row) / 4, 6) AS partition_at_1, round(count(*) FILTER (tr = row AND tof = first + i) / 4, 6) AS offset_at_1, round(count(*) FILTER (cr = row) / 4, 6) AS cited_at_1, round(avg(coalesce(c, 0))::DOUBLE, 6) AS confidence FROM f JOIN a USING (fact) WHERE i < length GROUP BY 1""")
def fact_scores(spark, sf):
    j = joined(spark, sf)
    facts = j.select(F.col("doc_id").alias("fact"), F.col("doc_id").alias("row"), F.lit(3).alias("first"), F.lit(4).alias("length"))
    a = j.select("doc_id", "good", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    answers = a.select(F.col("doc_id").alias("fact"), "i", F.when((F.col("doc_id") + F.col("i")) % 3 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("top_row"), (3 + F.col("i") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)).alias("top_offset"), F.when(F.col("good"), F.col("doc_id")).alias("cited_row"), F.when(F.col("good"), 0.5).alias("confidence"))
    return rounded(evaluate.fact_scores(facts, answers))


GROUND = JOINED + ", g AS (SELECT lang, n_chars / 1e4 AS confidence, toxic::INT::DOUBLE AS agreement, (doc_id % 100) / 100.0::DOUBLE AS influence, (n_chars % 97) / 97.0::DOUBLE AS risk, toxic AS uncited, (['function', 'grounded', 'other'])[doc_id % 3 + 1] AS kind, n_chars > 500 AS verbatim, doc_id % 5 <> 0 AS inside, (doc_id % 7) / 7.0::DOUBLE AS tw FROM j)"


@query("grounding_stats", f"""WITH {GROUND}, r AS (SELECT lang, uncited, rank() OVER (PARTITION BY lang ORDER BY risk) + (count(*) OVER (PARTITION BY lang, risk) - 1) / 2.0 AS rk FROM g), u AS (SELECT lang, CASE WHEN bool_or(uncited) AND bool_or(NOT uncited) THEN round((sum(rk) FILTER (uncited) - count(*) FILTER (uncited) * (count(*) FILTER (uncited) + 1) / 2.0) / (count(*) FILTER (uncited) * count(*) FILTER (NOT uncited)), 6) END AS risk_auroc FROM r GROUP BY 1)
    SELECT g.lang, count(*) FILTER (kind <> 'function') AS content, count(*) AS joined, CASE WHEN count(*) >= 3 AND max(confidence) > min(confidence) THEN round(corr(confidence, influence), 6) END AS confidence_r, CASE WHEN count(*) >= 3 AND max(agreement) > min(agreement) THEN round(corr(agreement, influence), 6) END AS agreement_r,
    round(avg(influence) FILTER (NOT uncited), 6) AS influence_cited, round(avg(influence) FILTER (uncited), 6) AS influence_uncited, round(avg((kind = 'grounded')::INT) FILTER (verbatim AND kind <> 'function'), 6) AS grounded_share, round(sum(CASE WHEN NOT inside THEN tw END) / sum(tw), 6) AS outside_weight, any_value(risk_auroc) AS risk_auroc FROM g JOIN u ON u.lang = g.lang GROUP BY g.lang""")
def grounding_stats(spark, sf):
    kinds = F.array(*[F.lit(s) for s in ("function", "grounded", "other")])
    g = joined(spark, sf).select("lang", (F.col("n_chars") / 1e4).alias("confidence"), F.col("toxic").cast("double").alias("agreement"), ((F.col("doc_id") % 100) / 100.0).alias("influence"), ((F.col("n_chars") % 97) / 97.0).alias("risk"), F.col("toxic").alias("uncited"),
        F.get(kinds, (F.col("doc_id") % 3).cast("int")).alias("kind"), (F.col("n_chars") > 500).alias("verbatim"), (F.col("doc_id") % 5 != 0).alias("inside"), ((F.col("doc_id") % 7) / 7.0).alias("top_weight"))
    return rounded(evaluate.grounding_stats(g, ["lang"]))


@query("grounding_join_whole", f"WITH {PROMPTS}, t AS (SELECT item_id, pos AS step, token FROM prompts QUALIFY pos < max(pos) OVER (PARTITION BY item_id)), m AS (SELECT item_id, pos AS step, CASE WHEN pos % 6 = 5 THEN token + 1 ELSE token END AS token FROM prompts) SELECT m.item_id, m.step, t.token IS NULL OR t.token = m.token AS aligned FROM m LEFT JOIN t ON t.item_id = m.item_id AND t.step = m.step")
def grounding_join_whole(spark, sf):
    """Every step of every prompt, the trace lacking only the last."""
    p = prompts(spark, sf).select("item_id", F.col("pos").alias("step"), "token")
    measured = p.withColumn("token", F.when(F.col("step") % 6 == 5, F.col("token") + 1).otherwise(F.col("token")))
    last = p.groupBy(F.col("item_id").alias("_item")).agg(F.max("step").alias("_last"))
    traces = p.join(last, (F.col("item_id") == F.col("_item")) & (F.col("step") < F.col("_last"))).select("item_id", "step", "token")
    return evaluate.grounding_rows(traces, measured, ["item_id"]).select("item_id", "step", "aligned")


@query("agreement_band", f"WITH {GROUND} SELECT round(quantile_cont(influence, 0.95) FILTER (NOT inside), 6) AS low, round(quantile_cont(influence, 0.5) FILTER (inside), 6) AS high FROM g")
def agreement_band(spark, sf):
    g = joined(spark, sf).select(((F.col("doc_id") % 100) / 100.0).alias("agreement"), (F.col("doc_id") % 5 != 0).alias("matched"))
    return rounded(evaluate.agreement_band(g))


@query("calibrate_tau", f"WITH {LIKELIHOODS}, g AS (SELECT t.i / 10.0::DOUBLE AS tau, ln(1e-3 + pow(p, t.i / 10.0::DOUBLE)) AS ll FROM likelihoods, range(1, 6) t(i)), m AS (SELECT tau, round(avg(ll), 6) AS score FROM g GROUP BY 1) SELECT arg_max(tau, (score, (tau = 0.3)::INT, -tau)) AS tau, max(score) AS score FROM m")
def calibrate_tau(spark, sf):
    g = likelihoods(spark, sf).select("p", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i / 10.0)).alias("tau"))
    b = evaluate.best_setting(g, "tau", F.ln(F.lit(1e-3) + F.pow("p", "tau")), 0.3)
    return rounded(b)


# Decision rules: the same measures of every node serve as the columns of each family.
MEASURES = "m AS (SELECT source, count(*) AS n, avg((quality = 1)::INT)::DOUBLE AS q, avg((toxic = 1)::INT)::DOUBLE AS t, avg(n_chars)::DOUBLE AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


def measures(spark, sf):
    j = joined(spark, sf)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("good").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("t"), F.avg("n_chars").alias("c"))


def rule_query(name: str, columns: dict[str, str], family, oracle: dict[str, str]) -> None:
    """Registers a family of rules over the measures; `columns` and `oracle` are expressions in both dialects."""
    picked = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    cases = " UNION ALL ".join(f"SELECT source, '{r.replace(chr(39), chr(39) * 2)}' AS rule, coalesce({e}, false) AS passed FROM r" for r, e in oracle.items())

    @query(name, f"WITH {MEASURES}, r AS (SELECT source, {picked} FROM m) {cases}")
    def run(spark, sf):
        return rules.verdicts(measures(spark, sf).select("source", *[F.expr(e).alias(c) for c, e in columns.items()]), ["source"], family())


rule_query("rules_umbrella", {"facts": "n", "exact": "n * q", "v1_facts": "40", "v1_exact": "33", "owned": "q", "v1_owned": "0.8", "moved": "1 - t", "commons_leads": "q + 0.05", "thread_gate": "t * 2", "thread_share": "t", "owner_share": "q + 0.1", "lift_positive": "1 - t / 2"}, rules.umbrella_rules, {
    "U1": "facts > 0 AND exact / facts >= v1_exact / v1_facts - 1 / 30.0 - 1e-9 AND owned >= v1_owned", "U2": "moved >= 0.9", "U3": "commons_leads >= 0.9 AND thread_gate <= 0.35", "U4": "thread_share <= 0.1 AND owner_share >= 0.9 AND lift_positive >= 0.95"})
rule_query("rules_architecture", {"steps_to_97": "CASE WHEN n > 10 THEN n * 10 END", "ref_steps_to_97": "180", "greedy": "q", "ref_greedy": "0.87", "held_out": "t", "ref_held_out": "0.1", "boundaries": "n", "break_rate": "q", "citations_on_breaks": "floor(t * 10)", "steps": "n", "ref_steps": "12"}, rules.architecture_rules, {
    "A1": "steps_to_97 IS NOT NULL AND steps_to_97 <= 1.25 * ref_steps_to_97", "A2": "greedy >= ref_greedy - 0.02", "A3": "held_out <= ref_held_out", "A4": "boundaries > 0 AND break_rate >= 0.8", "A5": "citations_on_breaks = 0",
    "B1": "steps_to_97 IS NOT NULL AND steps_to_97 <= 0.75 * ref_steps_to_97", "M3": "held_out <= ref_held_out + 0.02", "W1": "steps <= 1.5 * ref_steps"})
rule_query("rules_commons", {"child_loss": "t", "parent_loss": "0.1", "child_exact": "q", "parent_exact": "0.9", "child_citation": "q", "parent_citation": "0.88", "child_leads": "q", "parent_leads": "0.85", "child_share": "t", "parent_share": "0.1", "child_lift": "q", "parent_lift": "0.9"}, rules.commons_rules, {
    "C1": "child_loss <= parent_loss + 1e-6", "C2": "child_exact >= parent_exact - 1 / 30.0 - 1e-6 AND child_citation >= parent_citation - 0.02 - 1e-6", "C3": "child_leads >= parent_leads - 0.02 - 1e-6", "C4": "child_share <= parent_share + 0.02 + 1e-6 AND child_lift >= parent_lift - 0.02 - 1e-6"})
rule_query("rules_question", {"questions": "n", "rewrite_rate": "CASE WHEN n % 2 = 0 THEN 1.0 ELSE q END", "exact_rate": "q", "stem_exact_rate": "0.9", "slice_exact_rate": "0.95", "cited_rate": "q + 0.02", "unknown": "n", "unknown_lead_rate": "q", "unknown_credit": "t * 2", "shared": "n", "decided_rate": "q", "followed_rate": "q", "duplicate_credit": "t", "copied": "n % 3", "tie_rate": "q", "taken": "n % 2"}, rules.question_rules, {
    "Q1": "questions > 0 AND rewrite_rate >= 1 - 1e-6", "Q2": "exact_rate >= stem_exact_rate - 0.05 - 1e-6", "Q2'": "exact_rate >= slice_exact_rate - 0.1 - 1e-6", "Q3": "exact_rate > 0 AND cited_rate >= 0.9", "Q4": "unknown > 0 AND unknown_lead_rate >= 0.8 AND unknown_credit <= 0.25",
    "Q5a": "shared > 0 AND decided_rate >= 0.6 AND followed_rate >= 0.9 AND duplicate_credit <= 0.1", "Q5b": "copied = 0 OR (tie_rate >= 0.9 AND taken = 0)"})
rule_query("rules_route", {"nodes": "n", "facts": "n", "found": "n * q", "exact": "q", "plain_exact": "0.9", "citation": "q", "plain_citation": "0.85", "moved": "q", "plain_moved": "0.8", "opened": "n * t", "ratio": "t * 3"}, rules.route_rules, {
    "R1": "facts > 0 AND found / facts >= 0.99 - 1e-6", "R2": "exact >= plain_exact - 1 / 30.0 - 1e-6 AND citation >= plain_citation - 0.02 - 1e-6 AND moved >= plain_moved - 2 / 60.0 - 1e-6",
    "R3": "CASE WHEN nodes >= 24 THEN opened <= nodes / 4.0 + 1e-9 AND ratio > 0 AND ratio <= 0.5 + 1e-9 WHEN nodes <= 3 THEN ratio > 0 AND ratio <= 1.05 + 1e-9 ELSE true END"})
rule_query("rules_profile", {"facts": "n", "found": "n * q", "opened": "c / 800", "recall": "q + 0.1", "copies": "n", "within": "n - n % 2", "together": "n", "questions": "n", "owner_opened": "n * q", "owner_leads": "n * q", "stray_opened": "t", "stray_share": "t", "exact": "n", "owner_share": "q", "lift_rate": "1 - t", "homonyms": "n", "decided": "n * q"}, rules.profile_rules, {
    "P1": "facts > 0 AND found / facts >= 0.99 - 1e-6", "P2": "opened <= 4 + 1e-9", "P3": "recall >= 0.95 - 1e-6", "P4": "copies > 0 AND within = copies AND together = copies", "S1": "questions > 0 AND owner_opened / questions >= 0.99 - 1e-6 AND owner_leads / questions >= 0.9 - 1e-6",
    "S2": "stray_opened <= 0.1 + 1e-9 AND stray_share <= 0.1 + 1e-9", "S3": "exact > 0 AND owner_share >= 0.9 - 1e-6 AND lift_rate >= 0.95 - 1e-6", "S4": "homonyms > 0 AND decided / homonyms >= 0.9 - 1e-6"})
rule_query("rules_hosted", {"prompts": "n", "identical": "n - n % 2", "largest": "t / 1e6", "ratio": "q * 1.4"}, rules.hosted_rules, {"H1": "prompts > 0 AND identical = prompts AND largest <= 1e-6", "H3": "ratio > 0 AND ratio <= 1.2 + 1e-9"})


@query("rules_scale", f"""WITH {MEASURES}, p AS (SELECT c AS nodes, q AS exact, q + 0.05 AS owned, q AS citation, q + 0.02 AS leads, t AS thread_share FROM m), f AS (SELECT *, first_value(exact) OVER (ORDER BY nodes) AS fe, first_value(citation) OVER (ORDER BY nodes) AS fc FROM p)
    SELECT round(nodes, 6) AS nodes, 'N1' AS rule, exact >= fe - 1 / 30.0 - 1e-6 AND owned >= 0.9 - 1e-6 AND citation >= fc - 0.02 - 1e-6 AS passed FROM f UNION ALL SELECT round(nodes, 6), 'N2', leads >= 0.9 - 1e-6 AND thread_share <= 0.1 + 1e-6 FROM f""")
def rules_scale(spark, sf):
    q = F.col("q")
    p = measures(spark, sf).select(F.col("c").alias("nodes"), q.alias("exact"), (q + 0.05).alias("owned"), q.alias("citation"), (q + 0.02).alias("leads"), F.col("t").alias("thread_share"))
    return rounded(rules.scale_points(p))


@query("rules_thought", f"WITH {MEASURES}, a AS (SELECT bool_and(n > 0 AND q >= t + 0.1) AS l1, bool_and(n > 0 AND q > t AND q > t / 2) AS l2, avg(q) >= avg(t) + 0.2 AND avg(q) >= avg(t * 2) + 0.1 AS l3 FROM m) SELECT 'L1' AS rule, l1 AS passed FROM a UNION ALL SELECT 'L2', l2 FROM a UNION ALL SELECT 'L3', l3 FROM a")
def rules_thought(spark, sf):
    m = measures(spark, sf).select(F.col("n").alias("positions"), F.col("q").alias("lens"), F.col("t").alias("identity"), F.col("n").alias("ahead"), F.col("q").alias("lens_ahead"), F.col("t").alias("output_ahead"), (F.col("t") / 2).alias("identity_ahead"), F.col("q").alias("source"), F.col("t").alias("control"), (F.col("t") * 2).alias("output"))
    found = rules.thought_rules()
    return rules.verdicts(m.agg(*[c.alias(k) for k, c in found.items()]), [], {k: F.col(k) for k in found})


@query("vocabulary_rule", f"WITH {MEASURES}, v AS (SELECT CASE source WHEN 'src0' THEN 'baseline' WHEN 'src1' THEN 'seeded×0.5' WHEN 'src2' THEN 'seeded×1.0' WHEN 'src3' THEN 'commons' END AS name, CASE WHEN n % 5 <> 0 THEN n END AS epochs, q AS exact FROM m), b AS (SELECT epochs AS be, exact AS bx FROM v WHERE name = 'baseline'), p AS (SELECT * FROM v, b WHERE epochs IS NOT NULL AND coalesce(epochs <= 2 * be, true) AND exact >= bx - 0.05) SELECT coalesce((SELECT arg_min(name, (epochs, -exact)) FROM p WHERE starts_with(name, 'seeded')), (SELECT arg_min(name, (epochs, -exact)) FROM p WHERE starts_with(name, 'commons')), 'per thread') AS choice")
def vocabulary_rule(spark, sf):
    name = F.when(F.col("source") == "src0", "baseline").when(F.col("source") == "src1", "seeded×0.5").when(F.col("source") == "src2", "seeded×1.0").when(F.col("source") == "src3", "commons")
    v = measures(spark, sf).select(name.alias("name"), F.when(F.col("n") % 5 != 0, F.col("n")).alias("epochs"), F.col("q").alias("exact"))
    return rules.vocabulary_choice(v)


READ = JOINED + """, x AS (SELECT doc_id AS text, (['held', 'shuffled', 'collage', 'told', 'source', 'voice', 'voice_shuffled', 'generic'])[doc_id % 8 + 1] AS kind, lang AS owner, u.s AS strand, CASE WHEN u.s = lang THEN least(n_chars / 3e3, 1) ELSE (n_chars % 13) / 100.0::DOUBLE END AS trace, CASE WHEN good THEN (n_chars % 50) / 100.0::DOUBLE END AS manner FROM j, (SELECT unnest(['en', 'de', 'fr']) AS s) u)"""


@query("rules_trajectory", f"""WITH {READ}, t AS (SELECT text, kind, max(trace) AS top, avg(trace) AS mean, max(manner) FILTER (strand = owner) AS own, max(manner) FILTER (strand <> owner) AS other, max(manner) AS most FROM x GROUP BY 1, 2),
    a AS (SELECT avg((trace >= 0.4)::INT) FILTER (kind = 'held' AND strand = owner) AS h, avg((trace <= 0.1)::INT) FILTER (kind IN ('shuffled', 'collage') AND strand = owner) AS ap, avg((trace >= 0.4)::INT) FILTER (kind IN ('told', 'source') AND strand = owner) AS ho, avg((trace <= 0.1)::INT) FILTER (kind IN ('told', 'source') AND strand <> owner) AS ot FROM x),
    b AS (SELECT bool_and(v) AS v, max(m1) AS m1, max(m3) AS m3 FROM (SELECT coalesce(avg((top <= 0.1)::INT) FILTER (kind = k) >= 0.95 AND avg(mean) FILTER (kind = k) <= 0.05, false) AS v, avg((own > coalesce(other, -1))::INT) FILTER (kind = 'voice') AS m1, count(*) FILTER (kind = 'generic' AND coalesce(most, 0) >= 0.25) AS m3 FROM t, (SELECT unnest(['voice', 'voice_shuffled', 'generic']) AS k) GROUP BY k))
    SELECT 'T1' AS rule, coalesce(h >= 0.9 AND ap >= 0.9, false) AS passed FROM a UNION ALL SELECT 'T2', coalesce(ho >= 0.9 AND ot >= 0.9, false) FROM a UNION ALL SELECT 'T3', v FROM b UNION ALL SELECT 'M1', coalesce(m1 >= 0.8, false) FROM b UNION ALL SELECT 'M3', coalesce(m3 = 0, false) FROM b""")
def rules_trajectory(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("held", "shuffled", "collage", "told", "source", "voice", "voice_shuffled", "generic")])
    x = joined(spark, sf).select(F.col("doc_id").alias("text"), F.get(kinds, (F.col("doc_id") % 8).cast("int")).alias("kind"), F.col("lang").alias("owner"), F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr"))).alias("strand"), "n_chars", "good")
    trace = F.when(F.col("strand") == F.col("owner"), F.least(F.col("n_chars") / 3e3, F.lit(1.0))).otherwise((F.col("n_chars") % 13) / 100.0)
    return rules.trajectory_rules(x.withColumn("trace", trace).withColumn("manner", F.when(F.col("good"), (F.col("n_chars") % 50) / 100.0)))


@query("promotion_gates", f"""WITH {MEASURES}, c AS (SELECT source AS version, CASE WHEN n % 2 = 0 THEN 'train' ELSE 'reindex' END AS kind, q AS memorised, n % 4 AS v, n % 3 AS leaked, n % 5 AS unverified FROM m) SELECT version, 'memorised' AS rule, kind <> 'train' OR memorised >= 0.9 AS passed FROM c UNION ALL SELECT version, 'vocabulary', v <> 3 FROM c UNION ALL SELECT version, 'withdrawn', leaked = 0 FROM c UNION ALL SELECT version, 'verified', unverified = 0 FROM c""")
def promotion_gates(spark, sf):
    n = F.col("n")
    c = measures(spark, sf).select(F.col("source").alias("version"), F.when(n % 2 == 0, "train").otherwise("reindex").alias("kind"), F.col("q").alias("memorised"), F.when(n % 4 == 3, "other").otherwise("shared").alias("vocabulary"), F.lit("shared").alias("expected_vocabulary"), (n % 3).alias("leaked"), (n % 5).alias("unverified"))
    return rules.promotion_gates(c)


@query("cumulative_qualification", f"WITH {MEASURES}, a AS (SELECT source AS arm, n AS place, bool_and(q >= 0.7) AS own FROM m GROUP BY 1, 2) SELECT arm, own, bool_and(own) OVER (ORDER BY place, arm ROWS UNBOUNDED PRECEDING) AS qualifies FROM a")
def cumulative_qualification(spark, sf):
    m = measures(spark, sf).select(F.col("source").alias("arm"), F.struct("n", "source").alias("place"), (F.col("q") >= 0.7).alias("passed"))
    return rules.cumulative(m, "place").select("arm", "own", "qualifies")
