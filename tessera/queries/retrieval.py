"""Indexes, neighbours and mixtures."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rng, scores
from tessera.operators import clusters, evaluate, index, mix, trajectory
from tessera.operators.bounds import few
from tessera.session import table
from tessera.sources.scratch import Scratch

from .base import HITS, LIKELIHOODS, PARTS, PROMPTS, TOKENS, WEIGHTED, WORDS, documents, hits, likelihoods, mixed_numbers, parts, prompts, query, rounded, tokens, weighted


@query("transitions_lead", f"WITH {TOKENS}, t AS (SELECT lang, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tokens) SELECT lang, token, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def transitions_lead(spark, sf):
    t = index.ngram_counts(documents(spark, sf), "doc_id", "text", "lang", n=2, bits=16).groupBy("lang", "key").agg(F.sum("n").alias("n")).where("n >= 3")
    return t.select("lang", F.shiftright("key", 16).alias("token"), F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("next"), "n")


@query("packed_stream", f"""WITH {TOKENS}, z AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), s AS (SELECT doc_id, n, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM z)
    SELECT doc_id, start::BIGINT AS start, n, (start + n)::BIGINT AS stop FROM s""")
def packed_stream(spark, sf):
    st = index.text_stream(documents(spark, sf), "doc_id", "text", 70000)
    own = st.where("offset IS NOT NULL").groupBy("doc_id").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    return own.select("doc_id", "start", "n", (F.col("start") + F.col("n")).alias("stop"))


@query("shared_trigrams_having_2", f"""WITH {TOKENS}, g AS (SELECT doc_id, (token << 32) | (lead(token, 1) OVER w << 16) | lead(token, 2) OVER w AS key FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT key, count(DISTINCT doc_id) AS documents FROM g WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def shared_trigrams_having_2(spark, sf):
    return index.shared_ngrams(index.ngram_counts(documents(spark, sf), "doc_id", "text", n=3, bits=16), "doc_id")


SKETCH = TOKENS + "," + PROMPTS + """,
sk AS (SELECT DISTINCT source, (token << 32) | nx AS key FROM (SELECT source, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tokens) WHERE nx IS NOT NULL),
pk AS (SELECT DISTINCT item_id, (token << 32) | nx AS key FROM (SELECT item_id, token, lead(token) OVER (PARTITION BY item_id ORDER BY pos) AS nx FROM prompts) WHERE nx IS NOT NULL)"""


@query("bigram_sketch_route", f"""WITH {SKETCH}, nodes AS (SELECT DISTINCT source FROM documents), few AS (SELECT key FROM sk GROUP BY 1 HAVING count(*) <= greatest(1, (SELECT count(*) // 4 FROM nodes))),
    met AS (SELECT DISTINCT item_id, source FROM pk JOIN sk USING (key) WHERE key IN (SELECT key FROM few)) SELECT item_id, source, true AS distinctive FROM met UNION ALL SELECT item_id, source, false FROM (SELECT DISTINCT item_id FROM pk) p, nodes WHERE item_id NOT IN (SELECT item_id FROM met)""")
def bigram_sketch_route(spark, sf):
    nodes = documents(spark, sf).select("source").distinct()
    sketch = index.ngram_counts(documents(spark, sf), "doc_id", "text", "source", n=2, bits=32).select("source", "key").distinct()
    return index.route(index.ngrams(prompts(spark, sf, 1), "item_id", 2, 32), sketch, nodes, "item_id", "source")


@query("eval_windows_overlap", f"""WITH {TOKENS}, z AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), w AS (SELECT doc_id, n, unnest(range(0, greatest(n - 64, 0) + 64, 64)) AS start FROM z)
    SELECT doc_id, start, least(128, n - start) AS length, CASE WHEN start = 0 THEN 0 ELSE least(64, n - start) END AS record_from FROM w""")
def eval_windows_overlap(spark, sf):
    z = tokens(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 64, F.lit(0)) + 63, F.lit(64).cast("long"))
    w = z.select("doc_id", "n", F.explode(starts).alias("start"))
    return w.select("doc_id", "start", F.least(F.lit(128), F.col("n") - F.col("start")).alias("length"), F.when(F.col("start") == 0, F.lit(0)).otherwise(F.least(F.lit(64), F.col("n") - F.col("start"))).cast("long").alias("record_from"))


@query("doc_phase", f"""WITH {PARTS}, p AS (SELECT document_id, partition_index, len({WORDS.format('text')}) AS n FROM parts), s AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY document_id ORDER BY partition_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(n) OVER (PARTITION BY document_id) + 2 * (count(*) OVER (PARTITION BY document_id) - 1) AS length FROM p)
    SELECT document_id, partition_index, start::BIGINT AS start, length::BIGINT AS length, round(CASE WHEN length > 1 THEN greatest(0, least(1, start / (length - 1))) ELSE 0 END, 6) AS phase FROM s""")
def doc_phase(spark, sf):
    from tessera.functions.text import words

    p = parts(spark, sf).withColumn("n", F.size(words(F.col("text"))).cast("long"))
    s = trajectory.positions(p, "document_id", "partition_index", "n", 2)
    return rounded(s.select("document_id", "partition_index", "start", "length", trajectory.phase(F.col("start"), F.col("length")).alias("phase")))


@query("successor_entries", "WITH e AS (SELECT vec_id AS entry, label AS document, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings) SELECT entry, CASE WHEN lead(entry) OVER w = entry + 1 AND lead(position) OVER w = position + 1 THEN lead(entry) OVER w END AS successor FROM e WINDOW w AS (PARTITION BY document ORDER BY position)")
def successor_entries(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry"), F.col("label").alias("document"), F.row_number().over(w).alias("position"))
    return trajectory.successors(e, "document").select("entry", "successor")


@query("knn_top16", f"WITH {HITS} SELECT query, entry, rank, score FROM hits")
def knn_top16(spark, sf):
    return hits(spark, sf).select("query", "entry", "rank", "score")


@query("knn_cross_join", f"WITH {HITS} SELECT query, entry, rank, score FROM hits WHERE rank <= 8")
def knn_cross_join(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"))
    return index.neighbours(e.where("entry % 50 = 0").withColumnRenamed("entry", "query"), e, 8).select("query", "entry", "rank", "score")


@query("knn_leave_group_out", f"WITH {HITS}, r AS (SELECT query, entry, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS rank FROM scored WHERE value <> qlabel) SELECT query, entry, rank, score FROM r WHERE rank <= 16")
def knn_leave_group_out(spark, sf):
    return hits(spark, sf, apart=True).select("query", "entry", "rank", "score")


@query("knn_softmax_weights", f"WITH {WEIGHTED} SELECT query, entry, round(weight, 6) AS weight FROM weighted")
def knn_softmax_weights(spark, sf):
    return rounded(weighted(spark, sf).select("query", "entry", "weight"))


@query("knn_label_distribution", f"WITH {WEIGHTED} SELECT query, value, round(sum(weight), 6) AS p FROM weighted GROUP BY 1, 2")
def knn_label_distribution(spark, sf):
    return rounded(mix.distribution(weighted(spark, sf), ["query"]))


@query("source_entropy", f"WITH {WEIGHTED}, r AS (SELECT query, entry // 50 AS row, sum(weight) AS p FROM weighted GROUP BY 1, 2) SELECT query, round(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 6) AS entropy FROM r GROUP BY 1")
def source_entropy(spark, sf):
    return rounded(mix.source_entropy(weighted(spark, sf).withColumn("row", F.floor(F.col("entry") / 50)), ["query"], "row"))


@query("argmax_tie_rule", f"WITH {WEIGHTED}, d AS (SELECT query, value, round(sum(weight), 6) AS p FROM weighted GROUP BY 1, 2) SELECT query, arg_max(value, (p, -value)) AS value, max(p) AS p FROM d GROUP BY 1")
def argmax_tie_rule(spark, sf):
    return mix.argmax(rounded(mix.distribution(weighted(spark, sf), ["query"])), ["query"], "value", "p")


@query("knn_citation_weights", f"WITH {WEIGHTED}, d AS (SELECT query, value, round(sum(weight), 6) AS p FROM weighted GROUP BY 1, 2) SELECT query, arg_max(value, (p, -value)) AS value, max(p) AS p, round(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 5) AS entropy FROM d GROUP BY 1")
def knn_citation_weights(spark, sf):
    """The flagship: neighbours, weights, distribution, choice and its entropy."""
    from tessera.functions.stats import entropy

    d = rounded(mix.distribution(weighted(spark, sf), ["query"]))
    h = d.groupBy("query").agg(F.round(entropy(F.col("p")), 5).alias("entropy"))
    return mix.argmax(d, ["query"], "value", "p").join(h, "query")


@query("choose_tie_band_oldest", f"WITH {WEIGHTED}, d AS (SELECT query, value, count(*)::DOUBLE AS p, min(entry) AS age FROM weighted GROUP BY 1, 2), t AS (SELECT *, max(p) OVER (PARTITION BY query) AS top FROM d) SELECT query, arg_min(value, (age, value)) AS value FROM t WHERE p >= top - top * 1e-6 GROUP BY 1")
def choose_tie_band_oldest(spark, sf):
    d = weighted(spark, sf).groupBy("query", "value").agg(F.count(F.lit(1)).cast("double").alias("p"), F.min("entry").alias("age"))
    return mix.choose(d, ["query"], "value", "p", "age")


@query("cited_age", f"WITH {WEIGHTED} SELECT query, value, arg_max(entry * 10, (weight, -entry)) AS age FROM weighted GROUP BY 1, 2")
def cited_age(spark, sf):
    return mix.cited_age(weighted(spark, sf).withColumn("made", F.col("entry") * 10), ["query"], "value", "made")


POOLED = HITS + """,
apart AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, strand ORDER BY score DESC, entry) <= 8),
pool0 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, strand, entry) AS place FROM apart QUALIFY place <= 16),
pool1 AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query)) / 0.05::DOUBLE) AS part FROM pool0),
pool2 AS (SELECT *, part / sum(part) OVER (PARTITION BY query) AS weight FROM pool1),
gates AS (SELECT query, strand, sum(weight) AS gate FROM pool2 GROUP BY 1, 2),
opened AS (SELECT *, (gate >= 0.2 AND gate > 0) OR row_number() OVER (PARTITION BY query ORDER BY gate DESC, strand DESC) = 1 AS open FROM gates),
renorm AS (SELECT *, CASE WHEN open THEN gate / sum(CASE WHEN open THEN gate ELSE 0 END) OVER (PARTITION BY query) ELSE 0 END AS share FROM opened)"""


def own_hits(spark, sf):
    """Every strand's own nearest entries, as a fan-out over nodes would return them."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("value"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("strand"), F.lit(None).cast("long").alias("grp"))
    q = e.where("entry % 50 = 0").select(F.col("entry").alias("query"), "vector", "grp")
    return index.blocked_neighbours(q, e, 8).join(e.select("entry", "value"), "entry")


def pool(spark, sf, found=None):
    return mix.pooled(own_hits(spark, sf) if found is None else found, ["query"], 16, 0.05)


def gates(spark, sf, found=None):
    return pool(spark, sf, found).groupBy("query", "strand").agg(F.sum("weight").alias("gate"))


@query("pooled_topk_gates", f"WITH {POOLED} SELECT query, strand, entry, place AS rank, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY query, strand), 6) AS gate FROM pool2")
def pooled_topk_gates(spark, sf):
    return rounded(pool(spark, sf).select("query", "strand", "entry", "rank", "weight", "gate"))


@query("open_strands", f"WITH {POOLED} SELECT query, strand, open FROM opened")
def open_strands(spark, sf):
    return mix.opened(gates(spark, sf), ["query"], 0.2).select("query", "strand", "open")


@query("renormalised_gates", f"WITH {POOLED} SELECT query, strand, round(share, 6) AS share FROM renorm")
def renormalised_gates(spark, sf):
    return rounded(mix.renormalised(mix.opened(gates(spark, sf), ["query"], 0.2), ["query"]).select("query", "strand", "share"))


@query("thread_entropy", f"WITH {POOLED} SELECT query, round(-sum(gate * ln(gate)), 5) AS entropy FROM gates GROUP BY 1")
def thread_entropy(spark, sf):
    return mix.thread_entropy(gates(spark, sf), ["query"]).select("query", F.round("entropy", 5).alias("entropy"))


POSTERIOR = LIKELIHOODS + """,
ll AS (SELECT *, coalesce(sum(ln(greatest(p, 1e-30))) OVER (PARTITION BY item_id, strand ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ll FROM likelihoods),
es AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY item_id, position)) AS e FROM ll),
posterior AS (SELECT item_id, position, token, strand, p, e / sum(e) OVER (PARTITION BY item_id, position) AS posterior FROM es)"""


@query("posterior_cumulative", f"WITH {POSTERIOR} SELECT item_id, position, strand, round(posterior, 6) AS posterior FROM posterior")
def posterior_cumulative(spark, sf):
    return rounded(mix.posterior(likelihoods(spark, sf), ["item_id"]).select("item_id", "position", "strand", "posterior"))


@query("bounded_log_likelihood", f"""WITH {LIKELIHOODS}, b AS (SELECT item_id, position, strand, (position + length(strand)) % 3 <> 0 AS open, p AS exact, p / 4 AS bound FROM likelihoods),
    c AS (SELECT *, sum(ln(greatest(CASE WHEN open THEN exact ELSE bound END, 1e-30))) OVER w AS charged, sum(CASE WHEN NOT open THEN ln(greatest(exact, 1e-30)) - ln(greatest(bound, 1e-30)) ELSE 0 END) OVER w AS owed FROM b WINDOW w AS (PARTITION BY item_id, strand ORDER BY position)),
    d AS (SELECT *, last_value(CASE WHEN open THEN owed END IGNORE NULLS) OVER (PARTITION BY item_id, strand ORDER BY position) AS paid FROM c) SELECT item_id, position, strand, round(charged + coalesce(paid, 0), 5) AS total FROM d""")
def bounded_log_likelihood(spark, sf):
    b = likelihoods(spark, sf).select("item_id", "position", "strand", ((F.col("position") + F.length("strand")) % 3 != 0).alias("open"), F.col("p").alias("exact"), (F.col("p") / 4).alias("bound"))
    return mix.bounded_log_likelihood(b, ["item_id"]).select("item_id", "position", "strand", F.round("total", 5).alias("total"))


@query("mix_interpolate", f"""WITH {WEIGHTED}, knn AS (SELECT query, value, sum(weight) AS p FROM weighted GROUP BY 1, 2), lm AS (SELECT DISTINCT q.query, l.label::BIGINT AS value, l.n / t.n AS p FROM (SELECT DISTINCT query FROM knn) q, (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1) l, (SELECT count(*)::DOUBLE AS n FROM embeddings) t)
    SELECT query, value, round(lm.p * 0.5 + coalesce(knn.p, 0) * 0.5, 6) AS p FROM lm LEFT JOIN knn USING (query, value)""")
def mix_interpolate(spark, sf):
    knn = mix.distribution(weighted(spark, sf), ["query"])
    e = table(spark, sf, "embeddings")
    labels = e.groupBy(F.col("label").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = labels.agg(F.sum("n").alias("t"))
    # Labels are few, their total is one row.
    lm = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query")).join(few(labels.join(F.broadcast(total)))).select("query", "value", (F.col("n") / F.col("t")).alias("p"))
    return rounded(mix.interpolated(lm, knn, ["query"], "value", 0.5))


EXPERTS = POOLED + """,
own AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query, strand)) / 0.05::DOUBLE) AS e FROM apart),
own2 AS (SELECT query, strand, value, e / sum(e) OVER (PARTITION BY query, strand) AS w FROM own),
knn AS (SELECT query, strand, value, sum(w) AS knn FROM own2 GROUP BY 1, 2, 3),
lm AS (SELECT 's' || (vec_id % 4) AS strand, label::BIGINT AS value, count(*)::DOUBLE AS c FROM embeddings GROUP BY 1, 2),
lm2 AS (SELECT strand, value, c / sum(c) OVER (PARTITION BY strand) AS lm FROM lm),
experts AS (SELECT o.query, o.strand, o.gate, o.open, o.share AS weight, lm2.value AS token, coalesce(knn, 0) AS knn, lm, CASE o.strand WHEN 's0' THEN 0.25 ELSE 0.5 END::DOUBLE AS lam FROM renorm o JOIN lm2 ON lm2.strand = o.strand LEFT JOIN knn ON knn.query = o.query AND knn.strand = o.strand AND knn.value = lm2.value),
alone AS (SELECT *, lam * knn + (1 - lam) * lm AS alone FROM experts),
mixparts AS (SELECT *, weight * alone AS part FROM alone)"""


def mixparts(spark, sf):
    """Four strands as experts: their own retrieval over the labels, label counts as the model, one with a smaller share of retrieval."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("token"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("strand"))
    counts = e.groupBy("strand", "token").agg(F.count(F.lit(1)).cast("double").alias("c"))
    lm = counts.select("strand", "token", (F.col("c") / F.sum("c").over(Window.partitionBy("strand"))).alias("lm"))
    # Neighbours are looked for once, for the gates and for the experts.
    found = Scratch(spark, "own").save(own_hits(spark, sf), "hits")
    opened = mix.opened(gates(spark, sf, found), ["query"], 0.2)
    knn = mix.distribution(mix.weights(found, ["query", "strand"], 0.05), ["query", "strand"]).withColumnsRenamed({"value": "token", "p": "knn"})
    experts = opened.join(lm, "strand").join(knn, ["query", "strand", "token"], "left").withColumn("knn", F.coalesce("knn", F.lit(0.0)))
    return mix.expert_mix(experts.withColumn("lambda", F.when(F.col("strand") == "s0", 0.25).otherwise(0.5)), ["query"])


@query("expert_mix", f"WITH {EXPERTS} SELECT query, token, round(sum(part), 6) AS p FROM mixparts GROUP BY 1, 2")
def expert_mix(spark, sf):
    return rounded(mix.mixed(mixparts(spark, sf), ["query"]))


@query("token_shares", f"WITH {EXPERTS}, s AS (SELECT *, sum(part) OVER (PARTITION BY query, token) AS total FROM mixparts) SELECT query, token, strand, round(CASE WHEN total > 0 THEN part / total ELSE weight END, 6) AS share FROM s")
def token_shares(spark, sf):
    return rounded(mix.shares(mixparts(spark, sf), ["query"]).select("query", "token", "strand", "share"))


@query("top3_candidates", f"WITH {EXPERTS}, m AS (SELECT query, token, round(sum(part), 6) AS p FROM mixparts GROUP BY 1, 2) SELECT query, token, p, row_number() OVER (PARTITION BY query ORDER BY p DESC, token) AS rank FROM m WHERE p > 0 QUALIFY rank <= 3")
def top3_candidates(spark, sf):
    return mix.candidates(rounded(mix.mixed(mixparts(spark, sf), ["query"])), ["query"])


@query("sampled_tokens", f"""WITH {EXPERTS}, m AS (SELECT query, token, round(sum(part), 6) AS p, (query % 997) / 997.0::DOUBLE AS u FROM mixparts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p DESC, token) AS k FROM m QUALIFY k <= 5),
    s AS (SELECT *, sum(p) OVER (PARTITION BY query ORDER BY k) AS run, sum(p) OVER (PARTITION BY query) AS whole FROM r) SELECT query, arg_min(token, k) AS token FROM s WHERE run >= u * whole GROUP BY 1""")
def sampled_tokens(spark, sf):
    m = rounded(mix.mixed(mixparts(spark, sf), ["query"])).withColumn("u", (F.col("query") % 997) / 997.0)
    return mix.sampled(m, ["query"], "u", 5)


@query("mixture_entropies", f"""WITH {EXPERTS}, m AS (SELECT query, token, sum(part) AS p FROM mixparts GROUP BY 1, 2), h AS (SELECT query, -sum(CASE WHEN p > 0 THEN p * ln(p) END) AS entropy FROM m GROUP BY 1), o AS (SELECT query, strand, max(weight) AS w, -sum(CASE WHEN alone > 0 THEN alone * ln(alone) END) AS h FROM mixparts GROUP BY 1, 2)
    SELECT h.query, round(entropy, 5) AS entropy, round(sum(w * h), 5) AS within FROM h JOIN o ON o.query = h.query GROUP BY h.query, entropy""")
def mixture_entropies(spark, sf):
    return mix.mixture_entropies(mixparts(spark, sf), ["query"]).select("query", F.round("entropy", 5).alias("entropy"), F.round("within", 5).alias("within"))


@query("tempered_softmax", f"WITH {HITS}, e AS (SELECT query, entry, exp((score - max(score) OVER (PARTITION BY query)) / 0.7::DOUBLE) AS e FROM hits) SELECT query, entry, round(e / sum(e) OVER (PARTITION BY query), 6) AS p FROM e")
def tempered_softmax(spark, sf):
    return rounded(mix.tempered(hits(spark, sf), ["query"], 0.7, "score").select("query", "entry", "p"))


AGREE = EXPERTS + """,
lead AS (SELECT query, arg_max(strand, (round(gate, 9), strand)) AS leader FROM gates GROUP BY 1),
want AS (SELECT k.query, arg_max(value, (round(knn, 9), -value)) AS want FROM knn k JOIN lead l ON l.query = k.query AND l.leader = k.strand GROUP BY 1),
agree AS (SELECT s.query, s.strand, CASE WHEN s.strand = leader THEN 1.0 ELSE coalesce(least(greatest(knn, 0), 1), 0) END::DOUBLE AS agreement FROM (SELECT DISTINCT query, strand FROM knn) s JOIN lead ON lead.query = s.query JOIN want ON want.query = s.query LEFT JOIN knn ON knn.query = s.query AND knn.strand = s.strand AND knn.value = want.want)"""


def agreements(spark, sf):
    parts_ = mixparts(spark, sf)
    knn = parts_.where("knn > 0").select("query", "strand", F.col("token").alias("value"), F.round("knn", 9).alias("p"))
    g = gates(spark, sf)
    lead = g.groupBy("query").agg(F.max_by("strand", F.struct(F.round("gate", 9), F.col("strand"))).alias("leader"))
    return mix.agreement(knn, lead, ["query"])


@query("leader_agreement", f"WITH {AGREE} SELECT query, strand, round(agreement, 6) AS agreement FROM agree WHERE strand IN (SELECT strand FROM gates g WHERE g.query = agree.query)")
def leader_agreement(spark, sf):
    return rounded(agreements(spark, sf))


GATEW = """lk AS (SELECT item_id, position, strand, p FROM likelihoods),
st AS (SELECT item_id, position, strand, p / sum(p) OVER (PARTITION BY item_id, position) AS memory, length(strand) * 0.0 + p / max(p) OVER (PARTITION BY item_id, position) AS agreement, (position % 10) / 10.0::DOUBLE * CASE strand WHEN 'en' THEN 1 ELSE 0.5 END AS trace FROM lk),
ld AS (SELECT *, row_number() OVER (PARTITION BY item_id, position ORDER BY memory DESC, strand) = 1 AS leads FROM st),
tp AS (SELECT *, max(CASE WHEN leads THEN memory END) OVER w AS top, max(CASE WHEN leads THEN trace END) OVER w AS ttop, avg(trace) OVER w AS tmean FROM ld WINDOW w AS (PARTITION BY item_id, position)),
gw AS (SELECT item_id, position, strand, (CASE WHEN leads THEN memory ELSE memory + least(greatest(agreement, 0), 1) * (1 - greatest(0, ttop - trace)) * (top - memory) END) * exp(trace - tmean) AS g FROM tp)"""


@query("gate_weights", f"WITH {LIKELIHOODS}, {GATEW} SELECT item_id, position, strand, round(g / sum(g) OVER (PARTITION BY item_id, position), 6) AS gate FROM gw")
def gate_weights(spark, sf):
    w = Window.partitionBy("item_id", "position")
    p = F.col("p")
    st = likelihoods(spark, sf).select("item_id", "position", "strand", (p / F.sum(p).over(w)).alias("memory"), (p / F.max(p).over(w)).alias("agreement"), ((F.col("position") % 10) / 10.0 * F.when(F.col("strand") == "en", 1.0).otherwise(0.5)).alias("trace"))
    return rounded(mix.gate_weights(st, ["item_id", "position"], mix.Gate(lift=True, by_trace=True)).select("item_id", "position", "strand", "gate"))


@query("asked_by_manner", f"WITH {LIKELIHOODS}, m AS (SELECT item_id, position, strand, coalesce(CASE WHEN position % 4 <> 0 THEN p * 20 END >= 0.25, true) AS want FROM likelihoods) SELECT item_id, position, strand, want OR NOT bool_or(want) OVER (PARTITION BY item_id, position) AS asked FROM m")
def asked_by_manner(spark, sf):
    m = likelihoods(spark, sf).withColumn("manner", F.when(F.col("position") % 4 != 0, F.col("p") * 20))
    return mix.asked(m, ["item_id", "position"], 0.25).select("item_id", "position", "strand", "asked")


def folded(commons: bool) -> str:
    """The gate's memory in SQL, a position at a time over lists of strands in their order."""
    clipped = "greatest(0.02, least(50, x / greatest(list_extract(r.ps, r.c), 1e-12)))" if commons else "greatest(0.01, least(0.5, x))"
    evidence = f"list_transform(r.ps, lambda x, i: {f'CASE WHEN i = r.c THEN 1 ELSE {clipped} END' if commons else clipped}::DOUBLE)"
    loss = "greatest(-ln(x) / ln(50::DOUBLE), 0)" if commons else "ln(0.5 / x) / ln(0.5 / 0.01::DOUBLE)"
    gain = "greatest(ln(x) / ln(50::DOUBLE), 0)" if commons else f"1 - {loss}"
    voices = "list_max(list_filter(credible, lambda x, i: i <> c))" if commons else "list_max(credible)"
    start = "list_transform(ps, lambda x, i: CASE WHEN i = c THEN 0.9 ELSE (1 - 0.9) / (len(ps) - 1) END::DOUBLE)" if commons else "list_transform(ps, lambda x: 1 / len(ps)::DOUBLE)"
    return f"""WITH RECURSIVE {LIKELIHOODS}, lists AS (SELECT item_id, position, row_number() OVER (PARTITION BY item_id ORDER BY position) AS i, list(strand ORDER BY strand) AS strands, list(p ORDER BY strand) AS ps, list_position(list(strand ORDER BY strand), 'en') AS c FROM likelihoods GROUP BY 1, 2),
    memories AS (SELECT item_id, 0::BIGINT AS i, {start} AS memory, list_transform(ps, lambda x: 0::DOUBLE) AS credible FROM lists WHERE i = 1
        UNION ALL
        SELECT item_id, i, list_transform(updated, lambda x, k: x - given[k] + (list_sum(given) - given[k]) / (len(given) - 1)) AS memory, credible FROM (
            SELECT *, list_transform(updated, lambda x, k: x * (1 - pow(0.95::DOUBLE, losses[k]))) AS given FROM (
                SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS updated FROM (
                    SELECT *, list_transform(evidence, lambda x, k: old[k] * pow(x, {voices})) AS raw FROM (
                        SELECT item_id, i, c, evidence, old, list_transform(evidence, lambda x: {loss}) AS losses, list_transform(evidence, lambda x, k: 0.9::DOUBLE * before[k] + 0.1::DOUBLE * ({gain})) AS credible FROM (
                            SELECT r.item_id, r.i, r.c, m.memory AS old, m.credible AS before, {evidence} AS evidence FROM memories m JOIN lists r ON r.item_id = m.item_id AND r.i = m.i + 1))))))
    """


RESULT = "SELECT item_id, position, unnest(strands) AS strand, round(unnest(memory), 6) AS memory, round(unnest(credible), 6) AS credibility FROM lists JOIN memories USING (item_id, i)"


@query("gate_memory_fold", folded(False) + RESULT)
def gate_fold(spark, sf):
    return rounded(mix.gate_memory(likelihoods(spark, sf), "item_id", mix.Gate()))


@query("lift_gate_fold", folded(True) + RESULT)
def lift_gate_fold(spark, sf):
    return rounded(mix.gate_memory(likelihoods(spark, sf), "item_id", mix.Gate(), commons="en"))


@query("braided_scores", folded(False) + """, g AS (SELECT l.item_id, l.position, unnest(l.strands) AS strand, unnest(l.ps) AS p, unnest(m.memory) AS w FROM lists l JOIN memories m ON m.item_id = l.item_id AND m.i = l.i - 1),
    o AS (SELECT *, w >= 0.15 OR max(w) OVER (PARTITION BY item_id, position) < 0.15 AS ok FROM g)
    SELECT item_id, position, round(sum(w * p) FILTER (ok) / sum(w) FILTER (ok), 9) AS p, count(*) FILTER (ok) AS open, arg_min(strand, (-round(w, 9), strand)) AS leader FROM o GROUP BY 1, 2""")
def braided_scores(spark, sf):
    """Every prompt's tokens as the braid gives them: texts are given, so that all positions are scored at once."""
    l = likelihoods(spark, sf)
    found = mix.braided(l, mix.gate_memory(l, "item_id", mix.Gate()), "item_id", 0.15)
    return found.withColumn("p", F.round("p", 9))


PROFILES = """cent AS (SELECT label AS thread, vec_id % 3 AS centroid, list(embedding::DOUBLE[] ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1, 2),
cvec AS (SELECT thread, centroid, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda v: v[i]))) AS vector FROM cent)"""


def profiles(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("thread"), (F.col("vec_id") % 3).alias("centroid"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("w"))
    return index.weighted_mean_vector(e, ["thread", "centroid"], "v", "w")


@query("weighted_mean_vector", f"WITH {PROFILES} SELECT thread, centroid, round(list_sum(vector), 5) AS total, round(vector[7], 6) AS seventh FROM cvec")
def weighted_mean_vector(spark, sf):
    p = profiles(spark, sf)
    return p.select("thread", "centroid", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("vector")[6], 6).alias("seventh"))


ROUTED = PROFILES + """,
ps AS (SELECT q.vec_id AS query, thread, max(round(list_cosine_similarity(q.embedding::DOUBLE[], vector), 6)) AS score FROM embeddings q, cvec WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
pr AS (SELECT *, max(score) OVER (PARTITION BY query) AS best, row_number() OVER (PARTITION BY query ORDER BY score DESC, thread) AS rank FROM ps)"""


@query("profile_route", f"WITH {ROUTED} SELECT query, thread, score, CASE WHEN best > 0 THEN score >= 0.5 * best AND rank <= 6 ELSE true END AS open FROM pr")
def profile_route(spark, sf):
    q = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return index.profile_route(index.profile_scores(q, profiles(spark, sf), "query", "thread"), "query", "thread")


@query("profile_spread", f"WITH {PROFILES} SELECT a.thread, round(avg(list_cosine_similarity(a.vector, b.vector)), 6) AS spread FROM cvec a JOIN cvec b ON a.thread = b.thread AND a.centroid < b.centroid GROUP BY 1")
def profile_spread(spark, sf):
    return rounded(index.spread(profiles(spark, sf), "thread", "centroid"))


#: Starts drawn by weight and squared distance with the generator's first numbers, then Lloyd rounds until nothing moves.
KMEANS = f"""seeds AS (SELECT unnest(range(0, 4)) AS k), {mixed_numbers(f'7::UHUGEINT + k::UHUGEINT * {rng.GAMMA}::UHUGEINT', 'r', 'seeds')}, units AS (SELECT list((r >> 11)::DOUBLE * pow(2::DOUBLE, -53) ORDER BY k) AS us FROM r),
points AS (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) AS xs, list((vec_id % 5 + 1)::DOUBLE ORDER BY vec_id) AS ws FROM embeddings GROUP BY 1),
starts AS (SELECT label, 0 AS j, []::DOUBLE[][] AS cs FROM points
    UNION ALL SELECT label, j + 1, list_append(cs, xs[least(len(xs), len(list_filter(sums, lambda c: c < us[j + 1] * sums[-1])) + 1)]) FROM (
        SELECT *, list_transform(range(1, len(parts) + 1), lambda i: list_sum(parts[1:i])) AS sums FROM (
            SELECT s.label, j, cs, xs, us, list_transform(xs, lambda x, i: ws[i] * CASE WHEN j = 0 THEN 1 ELSE list_min(list_transform(cs, lambda c: list_distance(x, c) ** 2)) END) AS parts
            FROM starts s JOIN points USING (label), units WHERE j < least(4, len(xs))))),
rounds AS (SELECT label, 0 AS step, cs, []::BIGINT[] AS own, false AS done FROM starts JOIN points USING (label) WHERE j = least(4, len(xs))
    UNION ALL SELECT label, step + 1, CASE WHEN now = own THEN cs ELSE list_transform(masses, lambda m, j: CASE WHEN m > 0 THEN list_transform(range(1, len(xs[1]) + 1), lambda d: list_sum(list_transform(xs, lambda x, i: CASE WHEN now[i] = j THEN ws[i] * x[d] ELSE 0 END)) / m) ELSE xs[list_position(costs, list_max(costs))] END) END, now, now = own FROM (
        SELECT *, list_transform(cs, lambda c, j: list_sum(list_transform(ws, lambda w, i: CASE WHEN now[i] = j THEN w ELSE 0 END))) AS masses, list_transform(xs, lambda x, i: ws[i] * list_distance(x, cs[now[i]]) ** 2) AS costs FROM (
            SELECT r.*, xs, ws, list_transform(xs, lambda x: list_position(list_transform(cs, lambda c: list_distance(x, c)), list_min(list_transform(cs, lambda c: list_distance(x, c))))::BIGINT) AS now FROM rounds r JOIN points USING (label) WHERE NOT done AND step < 20))),
settled AS (SELECT label, arg_max(cs, step) AS cs FROM rounds GROUP BY 1),
held AS (SELECT label, cs, ws, list_transform(xs, lambda x: list_position(list_transform(cs, lambda c: list_distance(x, c)), list_min(list_transform(cs, lambda c: list_distance(x, c))))) AS now FROM settled JOIN points USING (label)),
mass AS (SELECT label, unnest(range(0, len(cs))) AS centroid, unnest(list_transform(cs, lambda c, j: list_sum(list_transform(ws, lambda w, i: CASE WHEN now[i] = j THEN w ELSE 0 END)))) AS mass FROM held)"""


@query("weighted_kmeans", f"WITH RECURSIVE {KMEANS} SELECT label, centroid::INT AS centroid, round(mass, 6) AS mass FROM mass")
def weighted_kmeans(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 5 + 1).alias("w"))
    return index.centroids(e, "label", "v", "w", 4).select("label", "centroid", F.round("mass", 6).alias("mass"))


@query("kmeans_whole")
def kmeans_whole(spark, sf):
    """All embeddings as one thread's states: eight centres and the weight that is nearest to each."""
    e = table(spark, sf, "embeddings", spread=True).select("vec_id", F.lit("all").alias("thread"), F.col("embedding").cast("array<double>").alias("v"), F.lit(1.0).alias("w"))
    return clusters.kmeans(e, "thread", "vec_id", "v", "w", 8).select("thread", "centroid", F.round("mass", 6).alias("mass"), "vector")


@query("composite_keys_whole", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS square, 1.0::DOUBLE AS unit FROM embeddings")
def composite_keys_whole(spark, sf):
    """The key of every embedding."""
    return keyed(table(spark, sf, "embeddings"))


def keyed(embeddings):
    v = F.col("embedding").cast("array<double>")
    key = scores.composite_key(F.slice(v, 1, 32), F.slice(v, 33, 32), 0.3)
    return embeddings.select("vec_id", F.round(scores.dot(v, v), 5).alias("square"), F.round(scores.norm(key), 6).alias("unit"))


@query("logit_stats", f"WITH {HITS}, l AS (SELECT query, list(score::DOUBLE ORDER BY rank) AS z FROM hits GROUP BY 1), e AS (SELECT query, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l), p AS (SELECT query, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT query, round(-ln(p[3]), 6) AS loss, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy FROM p")
def logit_stats(spark, sf):
    z = hits(spark, sf).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("s")))), lambda x: x["s"]).alias("z"))
    loss, entropy = scores.log_softmax_stats(F.col("z"), F.lit(2))
    return rounded(z.select("query", loss.alias("loss"), entropy.alias("entropy")))


@query("split_half_agreement", "WITH h AS (SELECT label, u.d AS d, sum(CASE WHEN vec_id % 2 = 0 THEN embedding[u.d]::DOUBLE ELSE 0 END) AS a, sum(CASE WHEN vec_id % 2 = 1 THEN embedding[u.d]::DOUBLE ELSE 0 END) AS b FROM embeddings, range(1, 65) u(d) GROUP BY 1, 2) SELECT label, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM h GROUP BY 1")
def split_half_agreement(spark, sf):
    d = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    h = d.groupBy("label", "d").agg(F.sum(F.when(F.col("vec_id") % 2 == 0, F.col("x")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("vec_id") % 2 == 1, F.col("x")).otherwise(0.0)).alias("b"))
    return rounded(evaluate.split_half(h, ["label"]))
