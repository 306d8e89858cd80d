"""Text functions and corpora."""

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import corpus, evaluate, trees
from tessera.session import table
from tessera.sources.scratch import Scratch

from .base import BEFORE, PARTS, WORDS, derived, documents, mixed_numbers, parts, query, rounded, snapshots


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.sha256(F.col("text")).alias("sha"))


CANONICAL = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("canonical_ids", f"WITH c AS (SELECT doc_id, source, 'doc-' || substr(sha256({CANONICAL}), 1, 24) AS id FROM documents) SELECT doc_id, id, regexp_matches(id, '^doc-[0-9a-f]{{24}}$') AS valid, 'mem://' || source || '/' || id || '/p/0' AS url, regexp_matches(source, '^[a-z0-9][a-z0-9._-]{{1,63}}$') AS handle FROM c")
def canonical_ids(spark, sf):
    d = documents(spark, sf).select("doc_id", "source", text.content_id("doc", text.canonical(F.col("text"))).alias("id"))
    return d.select("doc_id", "id", text.is_content_id(F.col("id"), "doc").alias("valid"), text.partition_url("mem", F.col("source"), F.col("id"), F.lit(0)).alias("url"), text.is_handle(F.col("source")).alias("handle"))


@query("word_list", f"WITH w AS (SELECT lang, unnest({WORDS.format('text')}) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2")
def word_list(spark, sf):
    return documents(spark, sf).select("lang", F.explode(text.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query("occurrence_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def occurrence_count(spark, sf):
    return documents(spark, sf).select("doc_id", text.occurrences(F.lit("the"), F.col("text")).alias("n"))


@query("english_filter", f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents) SELECT doc_id, len(ws) AS words, len(ws) >= 200 AND len(list_filter(ws, lambda x: x IN ('the', 'and', 'of'))) / greatest(len(ws), 1) >= 0.06 AS english FROM w")
def english_filter(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"), text.reads_as_english(F.col("text"), 200).alias("english"))


@query("sentence_units", r"""SELECT doc_id, 1 + len(regexp_extract_all(text, '[.?!"] [\p{Lu}"]')) AS units FROM documents WHERE NOT regexp_matches(text, '[.?!"] " ?')""")
def sentence_units(spark, sf):
    d = documents(spark, sf).where(~F.col("text").rlike('[.?!"] " ?'))
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("units"))


ROLE = "CASE WHEN NOT regexp_matches(word, '[\\p{L}\\p{N}]') OR lower(word) IN (" + ", ".join("'" + c.replace("'", "''") + "'" for c in text.CLITICS) + ") OR (regexp_matches(word, '^\\p{L}+$') AND lower(word) IN (" + ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS) + ")) THEN 'form' ELSE 'content' END"


@query("word_role_counts", f"WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM documents) SELECT lang, {ROLE} AS role, count(*) AS n FROM w GROUP BY 1, 2")
def word_role_counts(spark, sf):
    w = documents(spark, sf).select("lang", F.explode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("word"))
    return w.groupBy("lang", text.role(F.col("word")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("template_fill", r"""WITH s AS (SELECT item_id, split_part(text, ' ', 1) AS w FROM benchmark), q AS (SELECT item_id, lower(w) AS subject, 'When was ' || lower(w) || ' founded?' AS question FROM s)
    SELECT item_id, question, replace(replace('{S} was founded in', '{s}', sub), '{S}', upper(substr(sub, 1, 1)) || substr(sub, 2)) AS stem,
    regexp_replace(regexp_replace(regexp_replace(lower(question), '^\s+|\s+$', '', 'g'), '[.?!:,;]+$', ''), '\s+', ' ', 'g') AS plain
    FROM (SELECT *, regexp_extract(question, '(?i)^\s*when was (.+?) founded\?\s*$', 1) AS sub FROM q)""")
def template_fill(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("subject"))
    q = s.withColumn("question", F.concat(F.lit("When was "), "subject", F.lit(" founded?")))
    q = q.withColumn("found", F.regexp_extract("question", r"(?i)^\s*when was (.+?) founded\?\s*$", 1))
    return q.select("item_id", "question", text.fill(F.lit("{S} was founded in"), F.col("found")).alias("stem"), text.normalised(F.col("question")).alias("plain"))


@query("markers_rendered", r"SELECT conv_id, turn, regexp_replace(text || ' ', '\s+$', '') || '[[' || (turn + 1) || ']] ' AS marked FROM conversations WHERE NOT regexp_matches(text, '\s$')")
def markers_rendered(spark, sf):
    c = table(spark, sf, "conversations").where(~F.col("text").rlike(r"\s$"))
    return c.select("conv_id", "turn", text.marked(F.concat("text", F.lit(" ")), F.col("turn") + 1).alias("marked"))


#: Pieces and chunks are built up as texts in which chr(2) parts them, so that what stands behind the last one is still open.
CHUNKS = r"""paragraphs AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n(?:[^\S\n]*\n)+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bodies FROM documents),
bodies AS (SELECT doc_id, generate_subscripts(bodies, 1) AS place, unnest(bodies) AS body FROM paragraphs),
sentences AS (SELECT doc_id, place, body, CASE WHEN length(body) > 600 THEN list_filter(flatten(list_transform(string_split(regexp_replace(body, '([.?!])([ \n])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda s: list_transform(regexp_extract_all(trim(s, ' ' || chr(9)), '(?s)(?:.{1,600}$|.{1,599} +|.{600})'), lambda x: trim(x, ' ' || chr(9))))), lambda x: x <> '') ELSE [body] END AS bits FROM bodies),
packed AS (SELECT doc_id, place, CASE WHEN length(body) > 600 THEN string_split(list_reduce(bits, lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^\x02]*$')) + 1 + length(x) <= 600 THEN acc || ' ' || x ELSE acc || chr(2) || x END), chr(2)) ELSE bits END AS pieces FROM sentences),
merged AS (SELECT doc_id, list_reduce(flatten(list(pieces ORDER BY place)), lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^\x02]*$')) < 120 THEN acc || ' ' || x ELSE acc || chr(2) || x END) AS whole FROM packed GROUP BY 1),
cut AS (SELECT doc_id, string_split(CASE WHEN length(regexp_extract(whole, '[^\x02]*$')) < 120 THEN regexp_replace(whole, '\x02([^\x02]*)$', ' \1') ELSE whole END, chr(2)) AS chunks FROM merged),
chunks AS (SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk, unnest(chunks) AS body FROM cut)"""


@query("chunk_paragraphs", f"WITH {CHUNKS} SELECT doc_id, chunk, length(body) AS n_chars, sha256(body) AS sha FROM chunks")
def chunk_paragraphs(spark, sf):
    d = documents(spark, sf).select("doc_id", F.posexplode(text.chunked()(F.col("text"))).alias("chunk", "text"))
    return d.select("doc_id", "chunk", F.length("text").alias("n_chars"), text.sha256(F.col("text")).alias("sha"))


@query("splitmix64_shuffle", f"WITH {mixed_numbers(derived(2024, 'doc_id'), 'a', 'documents')}, {mixed_numbers('a', 'b', 'a')} SELECT doc_id, (b >> 11)::DOUBLE * pow(2::DOUBLE, -53) AS u FROM b")
def splitmix64_shuffle(spark, sf):
    from tessera.functions.rng import unit_of

    return documents(spark, sf).select("doc_id", unit_of(2024)(F.col("doc_id")).alias("u"))


@query("corpus_hash", f"WITH {PARTS}, e AS (SELECT source, document_id, partition_index, document_id || chr(9) || partition_index || chr(9) || sha256(text) || chr(10) AS line FROM parts) SELECT source, sha256(string_agg(line, '' ORDER BY document_id, partition_index)) AS corpus_hash FROM e GROUP BY 1")
def corpus_hash(spark, sf):
    return corpus.corpus_hash(parts(spark, sf), ("source",))


@query("ordered_hash", "SELECT sha256(string_agg(text || chr(0), '' ORDER BY item_id)) AS hash FROM benchmark")
def ordered_hash(spark, sf):
    return corpus.ordered_hash(table(spark, sf, "benchmark"), "item_id", F.col("text"), "\0")


@query("snapshot_manifest", f"WITH {PARTS}, e AS (SELECT document_id, partition_index, document_id || chr(9) || partition_index || chr(9) || sha256(text) || chr(10) AS line FROM parts) SELECT count(DISTINCT document_id) AS documents, count(*) AS partitions, sha256(string_agg(line, '' ORDER BY document_id, partition_index)) AS corpus_hash FROM e")
def snapshot_manifest(spark, sf):
    return corpus.snapshot(parts(spark, sf))


CHANGED = BEFORE + ", c AS (SELECT coalesce(b.document_id, a.document_id) AS document_id, coalesce(b.partition_index, a.partition_index) AS partition_index, b.sha AS old, a.sha AS new FROM before b FULL JOIN after a ON a.document_id = b.document_id AND a.partition_index = b.partition_index), changed AS (SELECT document_id, partition_index, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change FROM c WHERE old IS DISTINCT FROM new)"


@query("snapshot_changes", f"WITH {CHANGED} SELECT * FROM changed")
def snapshot_changes(spark, sf):
    return corpus.changes(*snapshots(spark, sf))


@query("snapshot_changes_tree", f"WITH {CHANGED} SELECT * FROM changed")
def snapshot_changes_tree(spark, sf):
    """The same between stored snapshots, whose trees of digests say which ranges to compare."""
    path = Scratch(spark, "trees").path
    for name, parts_ in zip(("before", "after"), snapshots(spark, sf), strict=True):
        trees.save(parts_.select("document_id", "partition_index", "sha"), f"{path}/{name}", 12)
    return trees.stored_changes(spark, f"{path}/before", f"{path}/after")


@query("document_changes", f"WITH {BEFORE} SELECT DISTINCT document_id, 'added' AS change FROM after WHERE document_id NOT IN (SELECT document_id FROM before) UNION ALL SELECT DISTINCT document_id, 'removed' FROM before WHERE document_id NOT IN (SELECT document_id FROM after)")
def document_changes(spark, sf):
    return corpus.document_changes(*snapshots(spark, sf))


@query("snapshot_diff_full_outer", f"WITH {CHANGED} SELECT CASE change WHEN 'removed' THEN 'missing ' WHEN 'added' THEN 'unexpected ' ELSE 'text differs at ' END || document_id || '#' || partition_index AS problem FROM changed")
def snapshot_diff_full_outer(spark, sf):
    return corpus.problems(*snapshots(spark, sf))


@query("update_plan", f"""WITH {CHANGED}, n AS (SELECT d.source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM documents d LEFT JOIN changed ON doc_id = document_id GROUP BY 1),
    p AS (SELECT source, count(*) AS partitions FROM parts GROUP BY 1) SELECT n.*, CASE WHEN coalesce(partitions, 0) <= 0 THEN 'none' WHEN added + removed + changed = 0 THEN 'none' WHEN (added + changed) / greatest(partitions, 1) >= 0.05 THEN 'reindex+train' ELSE 'reindex' END AS plan FROM n LEFT JOIN p USING (source)""")
def update_plan(spark, sf):
    change = corpus.changes(*snapshots(spark, sf))
    d = documents(spark, sf).select("source", F.col("doc_id").alias("document_id")).join(change, "document_id", "left")
    n = d.groupBy("source").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])
    p = parts(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("partitions"))
    j = n.join(p, "source", "left").withColumn("partitions", F.coalesce("partitions", F.lit(0)))
    return j.select("source", "added", "removed", "changed", corpus.update_plan(j, F.col("partitions"), F.lit(True)).alias("plan"))


@query("live_documents", "SELECT doc_id AS document_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def live_documents(spark, sf):
    deposits = documents(spark, sf).select(F.col("doc_id").alias("document_id"), "source")
    return corpus.present(deposits, table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id")))


LINKS = "links AS (SELECT 'l' || d.doc_id AS link, d.doc_id AS source, d.doc_id + 1 AS target, d.source AS source_node, e.source AS target_node FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 WHERE d.lang = e.lang AND d.source <> e.source)"


def links(spark, sf):
    """Links between successive documents of one world on two nodes."""
    d = documents(spark, sf).select(F.col("doc_id").alias("source"), F.col("lang"), F.col("source").alias("source_node"))
    e = d.select((F.col("source") - 1).alias("source"), F.col("source").alias("target"), F.col("lang").alias("_lang"), F.col("source_node").alias("target_node"))
    return d.join(e, "source").where("lang = _lang AND source_node <> target_node").select(F.concat(F.lit("l"), F.col("source").cast("string")).alias("link"), "source", "target", "source_node", "target_node")


@query("exclusive_left_anti", f"WITH {LINKS} SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT source FROM links UNION SELECT target FROM links)")
def exclusive_left_anti(spark, sf):
    return corpus.exclusive(documents(spark, sf).select(F.col("doc_id").alias("document_id")), links(spark, sf))


@query("retold_texts", f"WITH {LINKS}, p AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0), live AS (SELECT * FROM links WHERE source IN (SELECT * FROM p) AND target IN (SELECT * FROM p)) SELECT 'told' AS kind, target AS document_id FROM live UNION ALL SELECT DISTINCT 'source', source FROM live")
def retold_texts(spark, sf):
    return corpus.retold(links(spark, sf), documents(spark, sf).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("document_id")))


@query("link_validation", f"""WITH {LINKS}, p AS (SELECT * FROM documents WHERE doc_id % 4 <> 0), m AS (SELECT l.*, s.source AS s_is, t.source AS t_is, s.text AS st, t.text AS tt FROM links l LEFT JOIN p s ON s.doc_id = l.source LEFT JOIN p t ON t.doc_id = l.target),
    x AS (SELECT link, unnest([CASE WHEN s_is IS NULL THEN 'missing source' END, CASE WHEN t_is IS NULL THEN 'missing target' END, CASE WHEN s_is <> source_node THEN 'wrong source node' END, CASE WHEN t_is <> target_node THEN 'wrong target node' END, CASE WHEN contains(tt, st) THEN 'verbatim' END]) AS problem FROM m) SELECT * FROM x WHERE problem IS NOT NULL""")
def link_validation(spark, sf):
    d = documents(spark, sf).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("document_id"), F.col("source").alias("node"), "text")
    return corpus.link_problems(links(spark, sf), d)


@query("crossed_facts", f"""WITH {LINKS}, {PARTS}, f AS (SELECT l.link, p.partition_index AS fact_id, row_number() OVER (PARTITION BY link ORDER BY partition_index) AS k FROM links l JOIN parts p ON p.document_id = l.target WHERE l.source IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)) SELECT link, fact_id FROM f WHERE k <= 2""")
def crossed_facts(spark, sf):
    facts = parts(spark, sf).select("document_id", F.col("partition_index").alias("fact_id"))
    return corpus.crossed(links(spark, sf), facts, documents(spark, sf).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("document_id")), 2).select("link", "fact_id")


@query("duplicate_text_across_sources", "SELECT sha256(text) AS sha, list_sort(list_distinct(list(source))) AS holders FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def duplicate_text_across_sources(spark, sf):
    return corpus.held_by_several(documents(spark, sf).withColumn("sha", text.sha256(F.col("text"))), "sha", "source")


SHARED = f"""{PARTS}, h AS (SELECT DISTINCT sha256(text) AS c, lang || source AS n FROM parts), z AS (SELECT n, count(*) AS size FROM h GROUP BY 1), s AS (SELECT x.n AS a, y.n AS b, count(*) AS shared FROM h x JOIN h y ON x.c = y.c AND x.n < y.n GROUP BY 1, 2), pairs AS (SELECT s.*, za.size AS of_a, zb.size AS of_b FROM s JOIN z za ON za.n = a JOIN z zb ON zb.n = b)"""


@query("shared_pairs", f"WITH {SHARED} SELECT a, b, shared, of_a, of_b FROM pairs")
def shared_pairs(spark, sf):
    return corpus.shared_pairs(parts(spark, sf).withColumn("node", F.concat("lang", "source")), "sha", "node").select("a", "b", "shared", "of_a", "of_b")


@query("copy_pair", f"WITH {SHARED} SELECT a, b, shared, of_a, of_b FROM pairs WHERE 2 * shared >= least(of_a, of_b) ORDER BY shared DESC, a, b LIMIT 1")
def copy_pair(spark, sf):
    return corpus.copy_pair(parts(spark, sf).withColumn("node", F.concat("lang", "source")), "sha", "node").select("a", "b", "shared", "of_a", "of_b")


@query("ordered_pairs_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_name <> b.n_name")
def ordered_pairs_theta(spark, sf):
    return corpus.ordered_pairs(table(spark, sf, "nation"), "n_name")


@query("ring_peers", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE (b.n_nationkey - a.n_nationkey + 25) % 25 BETWEEN 1 AND 3")
def ring_peers(spark, sf):
    return corpus.peers(table(spark, sf, "nation"), "n_nationkey", F.lit(25), 3)


SUBJECT = r"regexp_extract(text, '(\p{Lu}\p{Ll}{5,})', 1)"


@query("substring_theta_join", f"WITH s AS (SELECT DISTINCT {SUBJECT} AS subject, doc_id AS owner FROM documents WHERE doc_id % 50 = 0 AND {SUBJECT} <> '') SELECT subject, owner, d.doc_id AS document_id FROM s JOIN documents d ON d.doc_id <> owner AND contains(d.text, subject) AND list_contains({WORDS.format('d.text')}, lower(subject))")
def substring_theta_join(spark, sf):
    d = documents(spark, sf)
    s = d.where("doc_id % 50 = 0").select(F.regexp_extract("text", r"(\p{Lu}\p{Ll}{5,})", 1).alias("subject"), F.col("doc_id").alias("owner")).where("subject <> ''").distinct()
    return corpus.mentions(s, d, "subject", "owner", "doc_id", "text")


@query("keyset_page", "SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf):
    return corpus.page(documents(spark, sf).select("doc_id", "source"), "doc_id", 100, 50)


NEXT = "pairs AS (SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def next_pairs(spark, sf):
    """Every document beside the next."""
    d = documents(spark, sf).select("doc_id", F.col("text").alias("a"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


@query("word_jaccard", f"WITH {NEXT}, w AS (SELECT doc_id, list_distinct({WORDS.format('a')}) AS x, list_distinct({WORDS.format('b')}) AS y FROM pairs) SELECT doc_id, len(x) AS words_a, len(y) AS words_b, round(CASE WHEN len(list_distinct(x || y)) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(x || y)) ELSE 0 END, 6) AS jaccard FROM w")
def word_jaccard(spark, sf):
    o = corpus.word_overlap(next_pairs(spark, sf), "a", "b")
    return rounded(o.select("doc_id", F.col("words_a").cast("long"), F.col("words_b").cast("long"), "jaccard"))


@query("token_f1", f"""WITH {NEXT}, wa AS (SELECT doc_id, unnest({WORDS.format('a')}) AS w FROM pairs), wb AS (SELECT doc_id, unnest({WORDS.format('b')}) AS w FROM pairs), ca AS (SELECT doc_id, w, count(*) AS na FROM wa GROUP BY 1, 2), cb AS (SELECT doc_id, w, count(*) AS nb FROM wb GROUP BY 1, 2),
    j AS (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, na, nb FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id AND ca.w = cb.w) SELECT doc_id, round(coalesce(2 * sum(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN least(na, nb) END) / (sum(coalesce(na, 0)) + sum(coalesce(nb, 0))), 0)::DOUBLE, 6) AS f1 FROM j GROUP BY 1""")
def token_f1(spark, sf):
    return rounded(evaluate.token_f1(next_pairs(spark, sf), ["doc_id"], "a", "b"))


CONV = f"""turns AS (SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS x, {WORDS.format('b.text')} AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query("longest_common_run", f"""WITH {CONV}, l AS (SELECT conv_id, turn, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM turns), r AS (SELECT conv_id, turn, generate_subscripts(y, 1) AS j, unnest(y) AS w FROM turns),
    m AS (SELECT conv_id, turn, i, i - j AS d FROM l JOIN r USING (conv_id, turn, w)), g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, d ORDER BY i) AS island FROM m), c AS (SELECT conv_id, turn, count(*) AS n FROM g GROUP BY conv_id, turn, d, island) SELECT conv_id, turn, max(n) AS run FROM c GROUP BY 1, 2""")
def longest_common_run(spark, sf):
    c = table(spark, sf, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return corpus.longest_common_run(c.select("conv_id", "turn", F.col("text").alias("a")).join(n, ["conv_id", "turn"]), ["conv_id", "turn"], "a", "b")


@query("lineage_recursive", "WITH RECURSIVE r AS (SELECT sha256(doc_id::VARCHAR) AS sha, CASE WHEN doc_id >= 3 THEN sha256((doc_id // 3)::VARCHAR) END AS parent FROM documents), c AS (SELECT sha, parent, 0 AS depth FROM r WHERE sha = sha256('100') UNION ALL SELECT r.sha, r.parent, depth + 1 FROM r JOIN c ON r.sha = c.parent) SELECT sha, depth FROM c")
def lineage_recursive(spark, sf):
    import hashlib

    digest = lambda c: text.sha256(c.cast("string"))
    r = documents(spark, sf).select(digest(F.col("doc_id")).alias("sha"), F.when(F.col("doc_id") >= 3, digest(F.floor(F.col("doc_id") / 3))).alias("parent"))
    return corpus.lineage(r, hashlib.sha256(b"100").hexdigest())


@query("registry_resolve", "WITH r AS (SELECT source AS slot, sha256(doc_id::VARCHAR) AS sha, lang || doc_id AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS current FROM documents) SELECT max(sha) AS found FROM r WHERE slot = 'src3' AND current")
def registry_resolve(spark, sf):
    d = documents(spark, sf)
    from pyspark.sql import Window

    r = d.select(F.col("source").alias("slot"), text.sha256(F.col("doc_id").cast("string")).alias("sha"), F.concat("lang", F.col("doc_id").cast("string")).alias("name"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) == 1).alias("current"))
    return corpus.resolve(r, "slot", "sha", "name", "src3")


@query("retention_newest_n", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 3 OR doc_id % 40 = 1")
def retention_newest_n(spark, sf):
    return corpus.retained(documents(spark, sf), "doc_id", 3, F.col("doc_id") % 40 == 1, ["source"]).select("source", "doc_id")


@query("round_robin_interleave", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents QUALIFY turn <= 4")
def round_robin_interleave(spark, sf):
    return corpus.round_robin(documents(spark, sf), "source", ["doc_id"], 4).select("source", "doc_id", F.col("turn").cast("long"))


@query("even_stride_sample", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= 30 OR i = 0 OR i * 30 // n <> (i - 1) * 30 // n")
def even_stride_sample(spark, sf):
    return corpus.even_stride(documents(spark, sf), ["doc_id"], 30, ["lang"]).select("lang", "doc_id")


@query("token_budget_running_sum", "WITH r AS (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents) SELECT source, doc_id FROM r WHERE spent < 20000")
def token_budget_running_sum(spark, sf):
    return corpus.within_budget(documents(spark, sf), [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")], "n_chars", 20000, ["source"]).select("source", "doc_id")


@query("held_out_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, k <= least(256, greatest(2, n // 100)) AS held_out FROM r")
def held_out_split(spark, sf):
    return corpus.held_out(documents(spark, sf), F.md5(F.col("doc_id").cast("string").cast("binary"))).select("doc_id", "held_out")


@query("dataset_manifest", f"WITH c AS (SELECT source, lang, count(*) AS n, sum(len({WORDS.format('text')})) AS w FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS documents, sum(w)::BIGINT AS words, string_agg(lang || ':' || n, ',' ORDER BY lang) AS kinds FROM c GROUP BY 1")
def dataset_manifest(spark, sf):
    m = corpus.manifest(documents(spark, sf), "source", "text")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return m.select("source", "documents", "words", kinds.alias("kinds"))


@query("html_links_first_seen", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages), e AS (SELECT page_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS link FROM l) SELECT page_id, link, min(pos) AS first FROM e GROUP BY 1, 2""")
def html_links_first_seen(spark, sf):
    from tessera.sources.web import links_first_seen

    return links_first_seen(table(spark, sf, "pages"), "page_id", "html").select("page_id", "link", F.col("first").cast("long"))
