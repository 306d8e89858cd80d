"""Citations, credit, trajectories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cite, index, mix, trajectory
from tessera.session import table
from tessera.sources.scratch import Scratch

from .base import BEFORE, LIKELIHOODS, PROMPTS, TOKENS, WEIGHTED, WORDS, documents, likelihoods, parts, prompts, query, rounded, snapshots, tokens, weighted


def neighbours(spark, sf):
    """Prompts as generations: a position's neighbours are where its last three words occur in documents, in order."""
    grams = index.ngrams(tokens(spark, sf, 2), "doc_id", 3, 16).select("key", F.col("doc_id").alias("row"), (F.col("pos") + 2).alias("offset"))
    asked = index.ngrams(prompts(spark, sf, 2), "item_id", 3, 16).select("key", F.col("item_id").alias("gen"), (F.col("pos") + 2).alias("k"))
    met = asked.join(grams, "key").select("gen", "k", "row", "offset")
    placed = met.withColumn("rank", F.row_number().over(Window.partitionBy("gen", "k").orderBy("row", "offset")))
    scored = placed.withColumn("score", 1 - F.least(F.col("rank"), F.lit(40)) * 0.01).withColumn("loss", (F.col("row") % 7) * 0.01)
    return mix.weights(scored, ["gen", "k"], 0.05).withColumn("matches", F.lit(True)).withColumn("offset", F.col("offset").cast("long"))


def rows(spark, sf):
    """Documents as partitions; every third one's last tokens count as its break."""
    counts = tokens(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("document_id"), F.lit(0).alias("partition_index"), (F.col("n") - F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0)).alias("token_count"))


NEIGHBOURS = TOKENS + "," + PROMPTS + """,
tri AS (SELECT doc_id AS row, pos + 2 AS offs, (token << 32) | (lead(token, 1) OVER w << 16) | lead(token, 2) OVER w AS key FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ptri AS (SELECT item_id AS gen, pos + 2 AS k, (token << 32) | (lead(token, 1) OVER w << 16) | lead(token, 2) OVER w AS key FROM prompts WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
nb0 AS (SELECT gen, k, row, offs, row_number() OVER (PARTITION BY gen, k ORDER BY row, offs) AS rank FROM ptri JOIN tri USING (key)),
nb1 AS (SELECT *, 1 - least(rank, 40) * 0.01::DOUBLE AS score, (row % 7) * 0.01::DOUBLE AS loss FROM nb0),
nb2 AS (SELECT *, exp((score - max(score) OVER (PARTITION BY gen, k)) / 0.05::DOUBLE) AS e FROM nb1),
nb AS (SELECT *, e / sum(e) OVER (PARTITION BY gen, k) AS weight FROM nb2),
refs AS (SELECT doc_id AS row, count(*) - CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS token_count FROM tokens GROUP BY 1),
citable AS (SELECT nb.* FROM nb JOIN refs USING (row) WHERE offs < token_count)"""

CITED = NEIGHBOURS + """,
grouped AS (SELECT gen, k, row, sum(weight) AS weight, arg_max(score, (score, -rank)) AS score, arg_max(rank, (score, -rank)) AS rank, arg_max(loss, (score, -rank)) AS loss FROM citable GROUP BY 1, 2, 3),
cited AS (SELECT *, greatest(0, least(1, (score - 0.5) / 0.5)) * greatest(0, least(1, weight)) * exp(-greatest(loss, 0)) AS product FROM grouped)"""


@query("citation_groups", f"WITH {CITED} SELECT gen, k, row, round(weight, 6) AS weight, round(score, 6) AS score, rank, round(CASE WHEN product > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END, 6) AS confidence, row_number() OVER (PARTITION BY gen, k ORDER BY weight DESC, score DESC, row) AS place FROM cited")
def citation_groups(spark, sf):
    return rounded(cite.citations(neighbours(spark, sf), rows(spark, sf)).select("gen", "k", "row", "weight", "score", "rank", "confidence", "place"))


@query("citation_confidence", f"WITH {CITED} SELECT gen, count(DISTINCT k) AS cited, round(avg(CASE WHEN product > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END), 6) AS confidence FROM cited GROUP BY 1")
def citation_confidence(spark, sf):
    c = cite.citations(neighbours(spark, sf), rows(spark, sf))
    return rounded(c.groupBy("gen").agg(F.count_distinct("k").alias("cited"), F.avg("confidence").alias("confidence")))


CHAINS = NEIGHBOURS + """,
el AS (SELECT gen, k, row, offs, arg_min(weight, rank) AS weight FROM citable WHERE rank <= 3 GROUP BY 1, 2, 3, 4),
il AS (SELECT *, offs - k AS d, k - row_number() OVER (PARTITION BY gen, row, offs - k ORDER BY k) AS island FROM el),
chains AS (SELECT gen, row, min(k) AS start, count(*) AS length, min(offs) AS offs, sum(weight) AS weight FROM il GROUP BY gen, row, d, island HAVING count(*) >= 3)"""


@query("chains_gaps_islands", f"WITH {CHAINS} SELECT gen, row, start, length, offs AS offset, round(weight, 6) AS weight FROM chains")
def chains_gaps_islands(spark, sf):
    return rounded(cite.chains(neighbours(spark, sf), rows(spark, sf)).select("gen", "row", "start", "length", "offset", "weight"))


#: Chains one after the other in the order of the choice: `taken` lists those that overlap none taken before.
CHOSEN = CHAINS + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY gen ORDER BY length DESC, weight DESC, row, offs) AS i FROM chains),
picked AS (SELECT gen, 0::BIGINT AS i, []::STRUCT(a BIGINT, z BIGINT, i BIGINT)[] AS taken FROM (SELECT DISTINCT gen FROM chains)
    UNION ALL SELECT p.gen, o.i, CASE WHEN len(list_filter(p.taken, lambda t: o.start < t.z AND t.a < o.start + o.length)) = 0 THEN list_append(p.taken, {'a': o.start, 'z': o.start + o.length, 'i': o.i}) ELSE p.taken END
    FROM picked p JOIN ordered o ON o.gen = p.gen AND o.i = p.i + 1),
places AS (SELECT gen, unnest(arg_max(taken, i)) AS t FROM picked GROUP BY gen),
owners AS (SELECT o.gen, o.i, o.row, min(t.i) AS owner FROM ordered o JOIN places p ON p.gen = o.gen AND o.start < t.z AND t.a < o.start + o.length GROUP BY 1, 2, 3),
others AS (SELECT gen, owner, string_agg(row::VARCHAR, ',' ORDER BY i) AS alternatives FROM (SELECT * FROM owners WHERE i <> owner QUALIFY row_number() OVER (PARTITION BY gen, owner ORDER BY i) <= 5) GROUP BY 1, 2),
spans AS (SELECT o.*, row_number() OVER (PARTITION BY o.gen ORDER BY start) - 1 AS span, coalesce(alternatives, '') AS alternatives FROM ordered o JOIN places p ON p.gen = o.gen AND t.i = o.i LEFT JOIN others x ON x.gen = o.gen AND x.owner = o.i)"""


def chosen(spark, sf):
    return cite.spans(cite.chains(neighbours(spark, sf), rows(spark, sf)), rows(spark, sf))


@query("greedy_spans", f"WITH RECURSIVE {CHOSEN} SELECT gen, span, start, length, row, offs AS offset, round(weight, 6) AS weight, alternatives FROM spans")
def greedy_spans(spark, sf):
    return rounded(chosen(spark, sf).withColumn("alternatives", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ",")), "weight")


@query("span_confidence", f"""WITH RECURSIVE {CHOSEN}, grouped AS (SELECT gen, k, row, sum(weight) AS weight, arg_max(score, (score, -rank)) AS score, arg_max(loss, (score, -rank)) AS loss FROM citable GROUP BY 1, 2, 3),
    cited AS (SELECT *, greatest(0, least(1, (score - 0.5) / 0.5)) * greatest(0, least(1, weight)) * exp(-greatest(loss, 0)) AS product FROM grouped),
    along AS (SELECT gen, span, row, unnest(range(start, start + length)) AS k FROM spans), c AS (SELECT along.gen, span, CASE WHEN coalesce(product, 0) > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END AS c FROM along LEFT JOIN cited USING (gen, k, row))
    SELECT gen, span, round(min(c), 6) AS confidence, round(avg(c), 6) AS mean_confidence FROM c GROUP BY 1, 2""")
def span_confidence(spark, sf):
    return rounded(cite.span_confidence(chosen(spark, sf), cite.citations(neighbours(spark, sf), rows(spark, sf))))


@query("markers_first_use", f'WITH {CHAINS}, f AS (SELECT gen, row, start + length - 1 AS "end", min(start + length - 1) OVER (PARTITION BY gen, row) AS first FROM chains) SELECT gen, "end", row, dense_rank() OVER (PARTITION BY gen ORDER BY first, row) AS number FROM f')
def markers_first_use(spark, sf):
    return cite.markers(cite.chains(neighbours(spark, sf), rows(spark, sf)))


@query("generation_summary", f"""WITH {CITED}, p AS (SELECT gen, k, max(CASE WHEN product > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END) AS c, max(rank) AS r FROM cited GROUP BY 1, 2), t AS (SELECT item_id AS gen, pos AS k FROM prompts)
    SELECT t.gen, count(*) AS generated, count(*) FILTER (r <= 3) AS covered, count(*) FILTER (r > 3) AS supported, count(*) FILTER (r IS NULL) AS uncited, round(avg(c), 6) AS confidence FROM t LEFT JOIN p ON p.gen = t.gen AND p.k = t.k GROUP BY 1""")
def generation_summary(spark, sf):
    best = cite.citations(neighbours(spark, sf), rows(spark, sf)).groupBy("gen", "k").agg(F.max("confidence").alias("confidence"), F.max("rank").alias("r"))
    t = prompts(spark, sf).select(F.col("item_id").alias("gen"), F.col("pos").alias("k")).join(best, ["gen", "k"], "left")
    return rounded(cite.summary(t.withColumn("span", F.when(F.col("r") <= 3, F.col("r"))).withColumn("uncited", F.col("r").isNull())))


@query("span_distinctiveness", f"""WITH {TOKENS}, g AS (SELECT doc_id, (token << 32) | (lead(token, 1) OVER w << 16) | lead(token, 2) OVER w AS key FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), s AS (SELECT key FROM g WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)
    SELECT doc_id, round(1 - avg(CASE WHEN s.key IS NOT NULL THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS distinctiveness FROM g LEFT JOIN s USING (key) WHERE g.key IS NOT NULL GROUP BY 1""")
def span_distinctiveness(spark, sf):
    g = index.ngram_counts(documents(spark, sf), "doc_id", "text", n=3, bits=16)
    return rounded(cite.distinctiveness(g, index.shared_ngrams(g, "doc_id"), ["doc_id"]))


@query("verify_status", f"""WITH {BEFORE}, sp AS (SELECT b.document_id, b.partition_index, b.sha, {WORDS.format('p.text')} AS w FROM before b JOIN parts p ON p.document_id = b.document_id AND p.partition_index = b.partition_index),
    lv AS (SELECT document_id, partition_index, text, {WORDS.format('text')} AS now FROM parts WHERE document_id % 7 <> 0), st AS (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN sha256(text) <> sha THEN 'stale' WHEN NOT 1 < len(now) THEN 'mismatch' WHEN now[2:4] = CASE WHEN sp.document_id % 11 = 0 THEN list_reverse(w[2:4]) ELSE w[2:4] END THEN 'verified' ELSE 'mismatch' END AS status FROM sp LEFT JOIN lv USING (document_id, partition_index))
    SELECT status, count(*) AS n FROM st GROUP BY 1""")
def verify_status(spark, sf):
    before, after = snapshots(spark, sf)
    w = F.slice(text.words(F.col("text")), 2, 3)
    spans = before.select("document_id", "partition_index", "sha", F.lit(1).alias("offset"), F.when(F.col("document_id") % 11 == 0, F.reverse(w)).otherwise(w).alias("tokens")).withColumn("span_text", F.lit("-"))
    return cite.verified(spans, after, text.words).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


PIECES = r"""pc0 AS (SELECT item_id, regexp_extract_all(text, ' ?[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS ps FROM benchmark),
pieces AS (SELECT item_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS piece FROM pc0)"""


def pieces(spark, sf):
    """Prompts cut as a tokenizer would: words with the space before them, and single marks."""
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r" ?[\p{L}\p{N}]+|[^\p{L}\p{N}]"), 0)).alias("i", "piece"))


FORMS = ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS)
ROLED = PIECES + f""",
starts AS (SELECT *, NOT regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]') OR NOT regexp_matches(coalesce(lag(piece) OVER (PARTITION BY item_id ORDER BY i), ''), '[\\p{{L}}\\p{{N}}]$') AS s FROM pieces),
wordy AS (SELECT *, sum(s::INT) OVER (PARTITION BY item_id ORDER BY i) AS word FROM starts),
whole AS (SELECT item_id, word, trim(string_agg(piece, '' ORDER BY i)) AS w FROM wordy GROUP BY 1, 2),
roled AS (SELECT item_id, word, CASE WHEN NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]') OR (regexp_matches(w, '^\\p{{L}}+$') AND lower(w) IN ({FORMS})) THEN 'form' ELSE 'content' END AS role FROM whole)"""


@query("token_roles", f"WITH {ROLED} SELECT item_id, i, role FROM wordy JOIN roled USING (item_id, word)")
def token_roles(spark, sf):
    return cite.word_roles(pieces(spark, sf), "item_id", "i", "piece").select("item_id", "i", "role")


@query("sentence_windows", f"""WITH {PIECES}, b AS (SELECT *, last_value(CASE WHEN regexp_matches(piece, '\\S') THEN piece END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pieces)
    SELECT item_id, i, sum(coalesce(contains(piece, chr(10)) OR (regexp_matches(before, '[.?!]\\s*$') AND regexp_matches(piece, '^[\\s\\p{{Lu}}]')), false)::INT) OVER (PARTITION BY item_id ORDER BY i)::BIGINT AS sentence FROM b""")
def sentence_windows(spark, sf):
    return cite.sentence_windows(pieces(spark, sf), "item_id", "i", "piece").select("item_id", "i", "sentence")


@query("sentence_context", f"""WITH {PIECES}, s AS (SELECT *, coalesce(last_value(CASE WHEN piece IN ('.', '?', '!') THEN i + 1 END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts FROM pieces)
    SELECT item_id, i AS pos, starts, coalesce((SELECT max(t.starts) FROM s t WHERE t.item_id = s.item_id AND t.starts < s.starts), 0) AS previous FROM s""")
def sentence_context(spark, sf):
    p = pieces(spark, sf).withColumnRenamed("i", "pos")
    return cite.context_start(p, "item_id", F.col("piece").isin(".", "?", "!")).select("item_id", "pos", "starts", "previous")


SHARES = LIKELIHOODS + """,
sh AS (SELECT item_id, position, CASE strand WHEN 'es' THEN 'commons' ELSE strand END AS strand, p / sum(p) OVER (PARTITION BY item_id, position) AS share, max(CASE WHEN strand = 'es' THEN p END) OVER (PARTITION BY item_id, position) AS base, CASE WHEN position % 3 = 0 THEN 'form' ELSE 'content' END AS role FROM likelihoods),
cr AS (SELECT *, CASE WHEN role = 'form' THEN (strand = 'commons')::INT::DOUBLE ELSE share END AS credit, -log2(greatest(base, 1e-30)) AS bits FROM sh)"""


def credited(spark, sf):
    p = likelihoods(spark, sf)
    w = Window.partitionBy("item_id", "position")
    s = p.select("item_id", "position", F.when(F.col("strand") == "es", "commons").otherwise(F.col("strand")).alias("strand"), (F.col("p") / F.sum("p").over(w)).alias("share"), F.max(F.when(F.col("strand") == "es", F.col("p"))).over(w).alias("base"), F.when(F.col("position") % 3 == 0, "form").otherwise("content").alias("role"))
    return cite.credit(s)


@query("role_credit", f"WITH {SHARES} SELECT item_id, position, strand, round(credit, 6) AS credit, round(bits, 6) AS bits FROM cr")
def role_credit(spark, sf):
    return rounded(credited(spark, sf).select("item_id", "position", "strand", "credit", "bits"))


@query("credit_bits_weighted", f"WITH {SHARES} SELECT item_id, strand, round(sum(bits * credit) / sum(bits), 6) AS credit FROM cr GROUP BY 1, 2")
def credit_bits_weighted(spark, sf):
    return rounded(cite.weighed_credit(credited(spark, sf), ["item_id", "strand"]))


FOLLOW = SHARES + """,
adv AS (SELECT item_id, strand, count(*) FILTER (share >= top) AS advances, count(*) FILTER (role = 'content') AS content FROM (SELECT *, max(CASE WHEN strand <> 'commons' THEN share END) OVER (PARTITION BY item_id, position) AS top FROM cr) WHERE strand <> 'commons' GROUP BY 1, 2),
rk AS (SELECT *, max(advances) OVER (PARTITION BY item_id) AS best FROM adv WHERE advances > 0),
fl AS (SELECT item_id, max(best) AS best, max(content) AS content, count(*) FILTER (advances + 2 > best) AS close, list_sort(list(strand) FILTER (advances + 2 > best)) AS strands FROM rk GROUP BY 1),
decided AS (SELECT item_id, CASE WHEN best * 2 > content AND close = 1 THEN strands[1] END AS followed, CASE WHEN best * 2 > content AND close > 1 THEN strands ELSE [] END AS tied FROM fl)"""


def decisions(spark, sf):
    top = F.max(F.when(F.col("strand") != "commons", F.col("share"))).over(Window.partitionBy("item_id", "position"))
    rows_ = credited(spark, sf).withColumn("top", top).where("strand <> 'commons'")
    adv = rows_.groupBy("item_id", "strand").agg(F.count_if(F.col("share") >= F.col("top")).alias("advances"), F.count_if(F.col("role") == "content").alias("content"))
    return cite.followed(adv, ["item_id"])


@query("followed_decision", f"WITH {FOLLOW} SELECT item_id, followed, array_to_string(tied, ',') AS tied FROM decided")
def followed_decision(spark, sf):
    return decisions(spark, sf).select("item_id", "followed", F.array_join("tied", ",").alias("tied"))


@query("followed_credit", f"""WITH {FOLLOW}, j AS (SELECT cr.*, followed, coalesce(tied, []) AS tied, strand <> 'commons' AND credit > 0 AS holds FROM cr LEFT JOIN decided USING (item_id)),
    v AS (SELECT *, sum(CASE WHEN holds THEN credit ELSE 0 END) OVER w AS pooled, count(*) FILTER (holds) OVER w >= 2 AND role = 'content' AS several, count(*) FILTER (holds AND list_contains(tied, strand)) OVER w AS tn, sum(CASE WHEN holds AND list_contains(tied, strand) THEN credit ELSE 0 END) OVER w AS ts FROM j WINDOW w AS (PARTITION BY item_id, position))
    SELECT item_id, position, strand, round(CASE WHEN several AND followed IS NOT NULL AND strand = followed THEN pooled WHEN several AND followed IS NOT NULL AND holds THEN 0 WHEN several AND followed IS NULL AND tn >= 2 AND holds AND list_contains(tied, strand) THEN ts / tn ELSE credit END, 6) AS credit FROM v""")
def followed_credit(spark, sf):
    return rounded(cite.followed_credit(credited(spark, sf), decisions(spark, sf), ["item_id"], ["item_id", "position"]).select("item_id", "position", "strand", "credit"))


@query("asof_row_owner", "SELECT doc_id AS row, (SELECT arg_max('s' || n_nationkey, n_nationkey) FROM nation WHERE n_nationkey * 30 + 5 <= doc_id) AS owner FROM documents")
def asof_row_owner(spark, sf):
    s = table(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("strand"), (F.col("n_nationkey") * 30 + 5).cast("long").alias("first"))
    return cite.owner_of_row(documents(spark, sf).select(F.col("doc_id").alias("row")), s)


@query("range_row_owner", "SELECT doc_id AS row, 's' || n_nationkey AS strand FROM documents LEFT JOIN nation ON doc_id >= n_nationkey * 30 AND doc_id < n_nationkey * 30 + 20")
def range_row_owner(spark, sf):
    s = table(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("strand"), (F.col("n_nationkey") * 30).cast("long").alias("first"), F.lit(20).alias("rows"))
    return cite.row_owner(documents(spark, sf).select(F.col("doc_id").alias("row")), s)


SOURCES = WEIGHTED + ", srcs AS (SELECT query, entry // 20 AS src, min(rank) AS first, sum(weight) AS weight FROM weighted GROUP BY 1, 2)"


def sources(spark, sf):
    return cite.kept_sources(weighted(spark, sf).withColumn("src", F.floor(F.col("entry") / 20)), ["query"], "src", "rank")


@query("top_sources", f"WITH {SOURCES} SELECT query, src, first, round(weight, 6) AS weight, row_number() OVER (PARTITION BY query ORDER BY weight DESC, first) AS place FROM srcs QUALIFY place <= 4")
def top_sources(spark, sf):
    return rounded(cite.top_sources(sources(spark, sf), ["query"], 4).select("query", "src", "first", "weight", "place"))


@query("budgeted_sources", f"WITH {SOURCES}, r AS (SELECT *, sum(src % 9 + 1) OVER w AS run, row_number() OVER w AS k FROM srcs WINDOW w AS (PARTITION BY query ORDER BY weight DESC, first ROWS UNBOUNDED PRECEDING)) SELECT query, src FROM r WHERE run <= 20 OR k = 1")
def budgeted_sources(spark, sf):
    s = sources(spark, sf).withColumn("pos", F.col("first")).withColumn("size", F.col("src") % 9 + 1)
    return mix.budgeted_sources(s, ["query"], "weight", "size", F.lit(20)).select("query", "src")


WIRE = NEIGHBOURS + """,
came AS (SELECT DISTINCT gen, k - 1 AS j, row AS document, offs AS entry FROM nb WHERE rank <= 16),
isl AS (SELECT *, entry - j AS d, j - row_number() OVER (PARTITION BY gen, document, entry - j ORDER BY j) AS island FROM came),
runs AS (SELECT *, row_number() OVER (PARTITION BY gen, document, d, island ORDER BY j) AS run FROM isl),
wire AS (SELECT gen, j + 1 AS j, max(run) AS length FROM runs GROUP BY 1, 2)"""


@query("wire_lengths", f"WITH {WIRE} SELECT gen, j, length FROM wire")
def wire_lengths(spark, sf):
    h = neighbours(spark, sf).where("rank <= 16").select("gen", (F.col("k") - 1).alias("j"), F.col("row").alias("document"), F.col("offset").alias("entry"), F.lit(True).alias("expected"))
    return trajectory.wire_lengths(h, "gen").select("gen", "j", "length")


@query("trace_ramp", f"WITH {WIRE} SELECT gen, j, round(greatest(0, least(1, (length - 24) / 72.0::DOUBLE)), 6) AS trace FROM wire")
def trace_ramp(spark, sf):
    from tessera.functions.scores import trace

    return rounded(wire_lengths(spark, sf).select("gen", "j", trace(F.col("length")).alias("trace")))


FIT = LIKELIHOODS + ", fit AS (SELECT item_id, position AS j, max(p) * 10 AS fit, min(p) / max(p) AS phase FROM likelihoods GROUP BY 1, 2)"


def steps(spark, sf):
    return likelihoods(spark, sf).groupBy("item_id", F.col("position").alias("j")).agg((F.max("p") * 10).alias("fit"), (F.min("p") / F.max("p")).alias("phase"))


@query("fit_moving_32", f"WITH {FIT} SELECT item_id, j, round(avg(fit) OVER (PARTITION BY item_id ORDER BY j ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 6) AS mean_fit FROM fit")
def fit_moving_32(spark, sf):
    return rounded(trajectory.moving_fit(steps(spark, sf), "item_id").select("item_id", "j", "mean_fit"))


BLOCKS = FIT + ", b AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY j) - 1) // 8 AS block, phase FROM fit), med AS (SELECT item_id, block, quantile_cont(phase, 0.5) AS median FROM b GROUP BY 1, 2 HAVING count(*) = 8)"


@query("block_median_16", f"WITH {BLOCKS} SELECT item_id, block::INT AS block, round(median, 6) AS median FROM med")
def block_median_16(spark, sf):
    return rounded(trajectory.block_medians(steps(spark, sf), "item_id", 8))


@query("arc_spearman", f"""WITH {BLOCKS}, l AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY median) + (count(*) OVER (PARTITION BY item_id, median) - 1) / 2.0 AS r FROM (SELECT * FROM med QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY block DESC) <= 8))
    SELECT item_id, CASE WHEN count(*) >= 4 AND max(r) > min(r) THEN round(greatest(-1, least(1, corr(block, r))), 6) END AS arc FROM l GROUP BY 1""")
def arc_spearman(spark, sf):
    return rounded(trajectory.arcs(trajectory.block_medians(steps(spark, sf), "item_id", 8), "item_id"))


#: Seeds of every prompt's positions, runs along the lines that they open, and what runs take over from earlier ones.
TRACKED = TOKENS + "," + PROMPTS + """,
g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
held AS (SELECT doc_id AS document, pos AS position, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS value, list(token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS past FROM tokens WHERE doc_id IN (FROM g)),
entries AS (SELECT * FROM held WHERE value IS NOT NULL),
steps AS (SELECT item_id, pos AS j, token, lead(token) OVER (PARTITION BY item_id ORDER BY pos) AS came, list(token) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS past FROM prompts),
hits AS (SELECT item_id, j, came, document, position, value FROM steps s JOIN entries e ON e.token = s.token QUALIFY row_number() OVER (PARTITION BY item_id, j ORDER BY
    CASE WHEN len(s.past) = 8 AND s.past = e.past THEN 8 WHEN len(s.past) >= 4 AND len(e.past) >= 4 AND s.past[-4:] = e.past[-4:] THEN 4 WHEN len(s.past) >= 2 AND len(e.past) >= 2 AND s.past[-2:] = e.past[-2:] THEN 2 ELSE 1 END DESC, document, position) <= 4),
met AS (SELECT DISTINCT item_id, document, position - j AS line, j FROM hits WHERE value = came),
same AS (SELECT l.item_id, l.document, line, j FROM (SELECT DISTINCT item_id, document, line FROM met) l JOIN steps s ON s.item_id = l.item_id JOIN entries e ON e.document = l.document AND e.position = s.j + line AND e.value = s.came),
cut AS (SELECT *, j - row_number() OVER (PARTITION BY item_id, document, line ORDER BY j) AS island FROM same),
runs AS (SELECT item_id, document, line, min(j) FILTER (seed) AS a, max(j) AS b FROM (SELECT c.*, m.j IS NOT NULL AS seed FROM cut c LEFT JOIN met m USING (item_id, document, line, j)) GROUP BY item_id, document, line, island HAVING bool_or(seed)),
able AS (SELECT y.item_id, y.document, y.line, y.a, x.line AS up_line, x.a AS up_a, x.b AS up_b FROM runs y JOIN runs x ON x.item_id = y.item_id AND x.document = y.document WHERE y.b - y.a >= 7 AND x.b - x.a >= 7 AND y.a - x.b - 1 BETWEEN 0 AND 8 AND y.a + y.line - x.b - 1 - x.line BETWEEN 0 AND 8
    QUALIFY row_number() OVER (PARTITION BY x.item_id, x.document, x.line, x.a ORDER BY y.a, y.line) = 1),
bridges AS (SELECT * FROM able QUALIFY row_number() OVER (PARTITION BY item_id, document, line, a ORDER BY up_b - up_a DESC, up_b DESC, up_line) = 1),
chains AS (SELECT item_id, document, line, a, up_line, up_a, up_b - up_a + 1 AS before FROM bridges UNION ALL
    SELECT c.item_id, c.document, c.line, c.a, b.up_line, b.up_a, b.up_b - b.up_a + 1 FROM chains c JOIN bridges b ON b.item_id = c.item_id AND b.document = c.document AND b.line = c.up_line AND b.a = c.up_a),
taken AS (SELECT item_id, document, line, a, sum(before) AS before FROM chains GROUP BY 1, 2, 3, 4),
masses AS (SELECT item_id, unnest(range(a, b + 1)) AS j, a, coalesce(before, 0) AS before FROM runs LEFT JOIN taken USING (item_id, document, line, a)),
lengths AS (SELECT item_id, j + 1 AS j, max(j - a + 1 + CASE WHEN j - a >= 7 THEN before ELSE 0 END) AS length FROM masses GROUP BY 1, 2)"""


@query("trajectory_state", f"WITH RECURSIVE {TRACKED} SELECT item_id, s.j, coalesce(length, 0)::BIGINT AS length, greatest(0, least(1, (coalesce(length, 0) - 24) / 72.0::DOUBLE)) AS trace FROM steps s LEFT JOIN lengths USING (item_id, j)")
def trajectory_state(spark, sf):
    """Every prompt followed through an index over all documents that the test tables mark as good.

    A position's hits are the 16 entries of its token that share most of the tokens before it, the lower among equals; this
    ranking stands in for the score of keys.
    """
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct()
    t = index.tokens(documents(spark, sf).join(good, "doc_id", "left_semi"), "doc_id", "text", ahead=1)
    entries = index.transitions(t, "doc_id").select(F.col("doc_id").alias("document"), F.col("pos").alias("position"), "token", F.col("next").alias("value"))
    scratch = Scratch(spark, "trajectory")
    entries = scratch.save(entries, "entries")
    p = prompts(spark, sf).select("item_id", F.col("pos").alias("j"), "token")
    hits = scratch.save(trajectory.retrieved(p, entries, "item_id"), "hits")
    return trajectory.tracked(p.join(hits, ["item_id", "j"], "left"), entries, "item_id")
