"""Reports, guards, questions, samples and whole plans."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import formats, tables
from tessera.functions.text import sha256, words
from tessera.operators import questions, samples, views
from tessera.plans import answer, build
from tessera.operators.bounds import few
from tessera.session import table

from .base import HITS, LIKELIHOODS, PARTS, PROMPTS, TOKENS, WORDS, documents, likelihoods, parts, prompts, query, rounded, tokens
from .citation import CITED, neighbours, pieces, rows
from .ledgers import JOINED, joined
from .texts import LINKS, links

SHARED = "sh AS (SELECT item_id, position, strand, p / sum(p) OVER (PARTITION BY item_id, position) AS share FROM likelihoods)"


def shares(spark, sf):
    p = F.col("p")
    return likelihoods(spark, sf).select("item_id", "position", "strand", (p / F.sum(p).over(Window.partitionBy("item_id", "position"))).alias("share"))


@query("dominant_strand", f"WITH {LIKELIHOODS}, {SHARED}, r AS (SELECT item_id, position, strand, round(share, 9) AS share FROM sh) SELECT item_id, position, arg_min(strand, (-share, strand)) AS strand, round(max(share), 6) AS share FROM r GROUP BY 1, 2 HAVING max(share) >= 0.6")
def dominant_strand(spark, sf):
    return rounded(views.dominant(shares(spark, sf).withColumn("share", F.round("share", 9)), ["item_id", "position"]))


@query("threads_asked", f"WITH {LIKELIHOODS}, {SHARED}, g AS (SELECT item_id, position, CASE strand WHEN 'es' THEN 'commons' ELSE strand END AS strand, round(share, 9) AS gate FROM sh) SELECT item_id, position, count(*) FILTER (gate > 0.2 AND strand <> 'commons') AS asked, coalesce(max(gate) <= max(gate) FILTER (strand = 'commons'), false) AS commons_leads FROM g GROUP BY 1, 2")
def threads_asked(spark, sf):
    g = shares(spark, sf).select("item_id", "position", F.when(F.col("strand") == "es", "commons").otherwise(F.col("strand")).alias("strand"), F.round("share", 9).alias("gate"))
    return views.asked(g.withColumn("open", F.col("gate") > 0.2), ["item_id", "position"])


@query("document_attention", f"WITH {PROMPTS}, e AS (SELECT item_id, pos, sum((token % 16 = 0)::INT) OVER (PARTITION BY item_id ORDER BY pos) AS d FROM prompts) SELECT a.item_id, a.pos AS t, b.pos AS s FROM e a JOIN e b ON a.item_id = b.item_id AND a.d = b.d AND b.pos <= a.pos")
def document_attention(spark, sf):
    return views.attention(prompts(spark, sf).withColumn("token", F.col("token") % 16), "item_id", 0)


@query("partition_cells", f"WITH {PARTS} SELECT document_id, partition_index, CASE WHEN document_id % 3 <> 0 AND document_id % 2 = 0 THEN 'learned' WHEN document_id % 3 <> 0 THEN 'indexed' ELSE 'pending' END AS state FROM parts")
def partition_cells(spark, sf):
    p = parts(spark, sf)
    return views.cells(p, p.where("document_id % 3 <> 0"), p.where("document_id % 2 = 0"))


@query("same_world", "SELECT a.doc_id, coalesce(CASE WHEN a.doc_id % 3 <> 0 THEN a.lang END, 'tiny') = coalesce(CASE WHEN b.doc_id % 3 <> 0 THEN b.lang END, 'tiny') AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def same_world(spark, sf):
    d = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("w"))
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(n, "doc_id").select("doc_id", views.same_world(F.col("w"), F.col("v")).alias("same"))


@query("distinctive_spans", f"WITH {JOINED} SELECT doc_id FROM j WHERE n_chars > 500 AND n_chars % 10 > 0 AND good")
def distinctive_spans(spark, sf):
    s = joined(spark, sf).select("doc_id", F.when(F.col("n_chars") > 500, "verbatim").otherwise("support").alias("kind"), ((F.col("n_chars") % 10) / 10).alias("distinctiveness"), F.when(F.col("good"), "verified").otherwise("stale").alias("status"))
    return views.distinctive(s).select("doc_id")


@query("ledger_fact_filter", "SELECT 'f-' || doc_id AS fact, n_chars FROM documents WHERE ends_with('f-' || doc_id, '17')")
def ledger_fact_filter(spark, sf):
    return views.by_fact(documents(spark, sf).select(F.concat(F.lit("f-"), F.col("doc_id").cast("string")).alias("fact"), "n_chars"), "17")


@query("binding_guard", "SELECT vec_id, 'index-1' AS index FROM embeddings")
def binding_guard(spark, sf):
    return views.guarded(table(spark, sf, "embeddings").select("vec_id", F.lit("index-1").alias("index")), {"index": "index-1"})


@query("trace_table", f"WITH {CITED}, c AS (SELECT gen, k, list(row ORDER BY weight DESC, score DESC, row) AS rs, max(CASE WHEN product > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END) AS c FROM cited GROUP BY 1, 2), t AS (SELECT item_id * 1000 + pos AS k, word AS text, round(c.c, 6) AS confidence, rs[1] AS citation FROM prompts LEFT JOIN c ON gen = item_id AND c.k = pos WHERE pos >= 4) SELECT * FROM t ORDER BY k LIMIT 200")
def trace_table(spark, sf):
    from tessera.operators import cite

    c = cite.citations(neighbours(spark, sf), rows(spark, sf)).groupBy("gen", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("citations"), F.round(F.max("confidence"), 6).alias("confidence"))
    t = prompts(spark, sf).join(c, (F.col("item_id") == F.col("gen")) & (F.col("pos") == F.col("k")), "left")
    return views.trace_table(t.select((F.col("item_id") * 1000 + F.col("pos")).alias("k"), F.col("word").alias("text"), "confidence", "citations", (F.col("pos") < 4).alias("is_prompt")), 200)


@query("kept_and_dropped_sources", "SELECT DISTINCT source, source IN (SELECT source FROM documents WHERE doc_id < 5) AS kept FROM documents")
def kept_and_dropped_sources(spark, sf):
    d = documents(spark, sf)
    return views.kept_and_dropped(d.select("source"), d.where("doc_id < 5"), "source").select("source", "kept")


@query("source_attribution", "WITH i AS (SELECT l_suppkey % 50 AS partition, arg_min(l_discount, (l_orderkey, l_linenumber)) AS influence FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1), c AS (SELECT l_suppkey % 50 AS partition, count(*) AS tokens, round(sum(l_quantity), 2) AS weight FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT r.i AS partition, influence, coalesce(tokens, 0) AS tokens, coalesce(weight, 0) AS weight FROM range(60) r(i) LEFT JOIN i ON i.partition = r.i LEFT JOIN c ON c.partition = r.i")
def source_attribution(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("partition", F.col("l_suppkey") % 50)
    influence = li.where("l_suppkey % 3 <> 0").select("partition", F.struct("l_orderkey", "l_linenumber").alias("place"), F.col("l_discount").alias("influence"))
    found = views.attributed(spark.range(60).withColumnRenamed("id", "partition"), influence, li.where("l_suppkey % 2 = 0").withColumn("weight", F.col("l_quantity")))
    return found.select("partition", "influence", "tokens", F.round("weight", 2).alias("weight"))


@query("control_metrics", f"""WITH {JOINED} SELECT lang AS "group", count(*) AS prompts, round(avg(good::INT), 6) AS exact, round(avg(toxic::INT), 6) AS cited, round(avg(n_chars), 4) AS confidence FROM j GROUP BY 1""")
def control_metrics(spark, sf):
    c = views.controls(joined(spark, sf).select(F.col("lang").alias("group"), F.col("good").alias("exact"), F.col("toxic").alias("cited"), F.col("n_chars").alias("confidence")))
    return rounded(c.withColumn("confidence", F.round("confidence", 4)), "exact", "cited")


@query("answer_by_thread", f"WITH {LIKELIHOODS}, {SHARED}, t AS (SELECT sum(position) AS b FROM sh) SELECT strand, round(sum(share * position) / any_value(b), 6) AS part FROM sh, t GROUP BY 1")
def answer_by_thread(spark, sf):
    c = shares(spark, sf).select("strand", F.col("share").alias("credit"), F.col("position").alias("bits"), F.lit(None).cast("string").alias("cited"), F.col("position").alias("first"))
    return rounded(views.answer_rows(c).select("strand", "part"))


@query("citations_on_breaks", f"WITH {CITED} SELECT count(*) AS citations, count(*) FILTER (offs >= token_count) AS on_breaks FROM nb JOIN refs USING (row)")
def citations_on_breaks(spark, sf):
    return views.on_breaks(neighbours(spark, sf), rows(spark, sf))


@query("greedy_rate", f"WITH {TOKENS}, f AS (SELECT source AS node, doc_id AS fact, bool_and(token % 40 <> 7) AS r FROM tokens GROUP BY 1, 2) SELECT node, count(*) AS facts, round(avg(r::INT), 6) AS greedy FROM f GROUP BY 1")
def greedy_rate(spark, sf):
    t = tokens(spark, sf).select(F.col("source").alias("node"), F.col("doc_id").alias("fact"), F.when(F.col("token") % 40 == 7, -1).otherwise(F.col("token")).alias("predicted"), F.col("token").alias("expected"))
    return rounded(views.greedy_rate(t))


@query("combined_manifest", "SELECT sha256(string_agg('s' || n_nationkey || chr(9) || n_regionkey || chr(9) || sha256(n_name), chr(10) ORDER BY 's' || n_nationkey)) AS manifest, sum(n_regionkey)::BIGINT AS version FROM nation")
def combined_manifest(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("strand"), F.col("n_regionkey").alias("version"), sha256(F.col("n_name")).alias("sha"))
    return views.manifest_hash(n)


@query("relative_representation", "WITH a AS (SELECT vec_id AS anchor, embedding FROM embeddings WHERE vec_id < 5), c AS (SELECT e.vec_id, anchor, list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS c FROM embeddings e, a) SELECT vec_id, anchor, round(c - avg(c) OVER (PARTITION BY vec_id), 6) AS value FROM c")
def relative_representation(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rounded(views.relative(e, e.where("vec_id < 5").withColumnRenamed("vec_id", "anchor"), "vec_id"))


@query("context_assembly", f"WITH {PROMPTS}, c AS (SELECT item_id // 4 AS context, item_id AS place, list(token ORDER BY pos) AS ts FROM prompts GROUP BY 1, 2), x AS (SELECT context, flatten(list([0::BIGINT] || ts ORDER BY place)) || [0::BIGINT, 1, 2] AS t FROM c GROUP BY 1) SELECT context, len(t) AS n, list_sum(t)::BIGINT AS total, t[1] AS first, t[len(t) - 2] AS mark FROM x")
def context_assembly(spark, sf):
    c = prompts(spark, sf).groupBy(F.floor(F.col("item_id") / 4).alias("context"), F.col("item_id").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    t = views.context(c, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), 0)
    return t.select("context", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get("tokens", F.lit(0)).alias("first"), F.get("tokens", F.size("tokens") - 3).alias("mark"))


@query("source_ids", r"SELECT doc_id, source || '#' || lang || '#' || n_chars AS id, source || '#' || lang AS document, n_chars::INT AS partition, substr(sha256(lang || '|' || source || '|' || doc_id), 1, 16) AS generation, regexp_matches(source, 'x') AS wrong FROM documents")
def source_ids(spark, sf):
    d = documents(spark, sf)
    i = formats.source_id(F.concat_ws("#", "source", "lang"), F.col("n_chars"))
    p = formats.parsed_source_id(i)
    return d.select("doc_id", i.alias("id"), p["document_id"].alias("document"), p["partition_index"].alias("partition"), formats.generation_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("generation"), formats.parsed_source_id(F.col("source"))["document_id"].isNotNull().alias("wrong"))


@query("settings_fingerprint", """SELECT doc_id, substr(sha256('{' || array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN '"floor":0.5' END, '"lang":"' || lang || '"'], lambda x: x IS NOT NULL), ',') || '}'), 1, 8) AS fingerprint FROM documents""")
def settings_fingerprint(spark, sf):
    return documents(spark, sf).select("doc_id", formats.fingerprint([F.when(F.col("doc_id") % 2 == 0, 0.5).alias("floor"), F.col("lang")]).alias("fingerprint"))


@query("run_ids", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-' || event_type AS run, date_trunc('second', ts) AS second FROM events")
def run_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", formats.run_id(F.col("event_type"), F.col("ts")).alias("run"), formats.whole_second(F.col("ts")).alias("second"))


@query("formatted", "SELECT doc_id, CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN (n_chars // 60) || 'm' || lpad((n_chars % 60)::VARCHAR, 2, '0') || 's' ELSE (n_chars // 3600) || 'h' || lpad((n_chars % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS lasted, CASE WHEN length(text) > 12 THEN substr(text, 1, 11) || '…' ELSE text END AS short FROM documents")
def formatted(spark, sf):
    return documents(spark, sf).select("doc_id", formats.duration(F.col("n_chars")).alias("lasted"), formats.clipped(F.col("text"), 12).alias("short"))


@query("remaining_time", "SELECT event_id, round(CASE WHEN event_id > 0 THEN (20000 - event_id) * value / event_id + 3 * 2.5 END, 5) AS eta FROM events")
def remaining_time(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(formats.remaining(F.col("event_id"), F.lit(20000), F.col("value"), F.lit(3), F.lit(2.5)), 5).alias("eta"))


QUESTIONS = r"""qs AS (SELECT item_id, lower(regexp_extract(text, '^(\S+)', 1)) AS s, CASE item_id % 4 WHEN 0 THEN 'When was ' || s || ' founded?' WHEN 1 THEN ' who is the mayor of ' || s || '? ' WHEN 2 THEN 'WHEN WAS ' || s || ' BORN?' ELSE 'How is ' || s || '?' END AS question FROM benchmark)"""
TEMPLATES = [("founded", "When was {s} founded?", "{S} was founded in"), ("mayor", "Who is the mayor of {s}?", "The current mayor of {s} is"), ("born", "When was {s} born?", "The profile says {s} was born in"), ("any", "When was {s}?", "{S} was")]


def asked_questions(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.lower(F.regexp_extract("text", r"^(\S+)", 1)).alias("s"))
    k = F.col("item_id") % 4
    q = F.when(k == 0, F.concat(F.lit("When was "), "s", F.lit(" founded?"))).when(k == 1, F.concat(F.lit(" who is the mayor of "), "s", F.lit("? "))).when(k == 2, F.concat(F.lit("WHEN WAS "), "s", F.lit(" BORN?"))).otherwise(F.concat(F.lit("How is "), "s", F.lit("?")))
    return b.select("item_id", q.alias("question"), "s")


@query("question_rewrite", f"""WITH {QUESTIONS}, r AS (SELECT item_id, question, s, CASE item_id % 4 WHEN 0 THEN 'founded' WHEN 1 THEN 'mayor' WHEN 2 THEN 'born' END AS kind, CASE item_id % 4 WHEN 0 THEN upper(substr(s, 1, 1)) || substr(s, 2) || ' was founded in' WHEN 1 THEN 'The current mayor of ' || s || ' is' WHEN 2 THEN 'The profile says ' || s || ' was born in' END AS stem FROM qs)
    SELECT item_id, kind, coalesce(stem, question) AS used, CASE WHEN stem IS NULL THEN 'question' ELSE 'rules' END AS by, CASE WHEN contains(lower(coalesce(stem, question)), s) THEN instr(lower(coalesce(stem, question)), s) - 1 END AS first FROM r""")
def question_rewrite(spark, sf):
    r = questions.with_fallback(questions.rewritten(asked_questions(spark, sf), questions.template_rows(spark, TEMPLATES)))
    return r.select("item_id", "kind", "used", "by", questions.subject_span(F.col("used"), F.col("s"))["first"].cast("long").alias("first"))


@query("question_acceptance", r"""SELECT item_id, trim(text) <> '' AND NOT regexp_matches(text, '\?\s*$') AND list_aggregate(list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+')[2:1001], lambda w: regexp_matches(w, '^\p{Lu}')), lambda w: contains(lower(split_part(text, '.', 1)), lower(w))), 'bool_and') IS DISTINCT FROM false AS ok FROM benchmark""")
def question_acceptance(spark, sf):
    b = table(spark, sf, "benchmark")
    stem = F.split_part("text", F.lit("."), F.lit(1))
    return b.select("item_id", (questions.acceptable(stem, F.col("text")) & (F.trim("text") != "") & ~F.col("text").rlike(r"\?\s*$")).alias("ok"))


@query("fact_pairs_by_key", f"WITH {PARTS}, a AS (SELECT source, lang, substr(text, 1, 12) AS k, document_id * 1000 + partition_index AS fact FROM parts WHERE document_id % 2 = 0), b AS (SELECT source, lang, substr(text, 1, 12) AS k, min(document_id * 1000 + partition_index) AS other FROM parts WHERE document_id % 2 = 1 GROUP BY 1, 2, 3) SELECT fact, other, other IS NOT NULL AS matched FROM a LEFT JOIN b USING (source, lang, k)")
def fact_pairs_by_key(spark, sf):
    p = parts(spark, sf).select("source", "lang", F.substring("text", 1, 12).alias("k"), (F.col("document_id") * 1000 + F.col("partition_index")).alias("fact"), "document_id")
    return questions.paired(p.where("document_id % 2 = 0"), p.where("document_id % 2 = 1"), ["source", "lang", "k"]).select("fact", "other", "matched")


@query("shared_facts", f"WITH {LINKS}, p AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) SELECT link, coalesce(CASE WHEN target % 3 <> 0 THEN target END, source) AS fact FROM links WHERE source IN (SELECT * FROM p) AND target IN (SELECT * FROM p)")
def shared_facts(spark, sf):
    own = links(spark, sf).withColumn("target_fact", F.when(F.col("target") % 3 != 0, F.col("target"))).withColumn("source_fact", F.col("source")).withColumn("place", F.col("source"))
    return questions.shared_facts(own, documents(spark, sf).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("document_id")), 1).select("link", "fact")


@query("newest_first_turns", f"WITH {PARTS} SELECT document_id, partition_index, row_number() OVER (PARTITION BY document_id ORDER BY partition_index) AS turn, -document_id AS newest FROM parts")
def newest_first_turns(spark, sf):
    f = samples.newest_first(parts(spark, sf), "document_id", "document_id", "partition_index")
    return f.select("document_id", "partition_index", F.col("turn").cast("long"), "newest")


@query("prompt_quota", "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2")
def prompt_quota(spark, sf):
    return samples.quota(documents(spark, sf), ["lang", "source"], ["doc_id"], 2).select("lang", "source", "doc_id")


@query("training_grid", "WITH g AS (SELECT doc_id, n_chars, doc_id % 64 AS o FROM documents) SELECT doc_id, unnest(range(o, n_chars - 64, 64)) AS start FROM g WHERE n_chars - 65 >= o")
def training_grid(spark, sf):
    return samples.grid(documents(spark, sf), "doc_id", "n_chars", F.col("doc_id") % 64, 64)


@query("training_batches", "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), f AS (SELECT lang, doc_id, unnest(CASE WHEN i < (16 - n % 16) % 16 THEN [i, n + i] ELSE [i] END) AS spot FROM r) SELECT lang, doc_id, spot // 16 AS batch, spot % 16 AS place FROM f")
def training_batches(spark, sf):
    b = samples.batches(documents(spark, sf).select("lang", "doc_id"), F.md5(F.col("doc_id").cast("string").cast("binary")), 16, ["lang"])
    return b.select("lang", "doc_id", F.col("batch").cast("long"), F.col("place").cast("long"))


@query("corpus_plan", "SELECT i AS step, CASE WHEN i % 6 < 3 THEN 'web' WHEN i % 6 < 5 THEN 'books' ELSE 'code' END AS corpus, CASE WHEN i % 6 < 3 THEN i // 6 * 3 + i % 6 WHEN i % 6 < 5 THEN i // 6 * 2 + i % 6 - 3 ELSE i // 6 END AS \"window\" FROM (SELECT event_id AS i FROM events)")
def corpus_plan(spark, sf):
    """Every event as a step."""
    return samples.planned(table(spark, sf, "events").select(F.col("event_id").alias("step")), {"web": 3, "books": 2, "code": 1})


@query("panel_schedule", "SELECT i AS round, 0 AS place, 'facts' AS list, i % 7 AS item FROM (SELECT event_id AS i FROM events) UNION ALL SELECT i, 1, 'unknown', i // 3 % 4 FROM (SELECT event_id AS i FROM events) WHERE i % 3 = 0")
def panel_schedule(spark, sf):
    """Every event as a round."""
    return samples.schedule({"facts": 7, "unknown": 4}, {"unknown": 3}, table(spark, sf, "events").select(F.col("event_id").alias("round")))


@query("collage_texts", f"WITH {PARTS}, d AS (SELECT source, document_id, partition_index, text, dense_rank() OVER (PARTITION BY source ORDER BY document_id) - 1 AS d FROM parts) SELECT source, sha256(string_agg(text, ' ' ORDER BY partition_index, document_id, text)) AS sha FROM d WHERE d < 5 AND partition_index % 5 = d GROUP BY 1")
def collage_texts(spark, sf):
    return samples.collage(parts(spark, sf), 5, "source", "document_id", "partition_index", "text").select("source", sha256(F.col("text")).alias("sha"))


@query("units_rejoin", f"WITH {PARTS}, u AS (SELECT document_id, list({WORDS.format('text')} ORDER BY partition_index) AS us FROM parts GROUP BY 1) SELECT document_id, flatten(us) = {WORDS.format('d.text')} AS exact FROM u JOIN documents d ON doc_id = document_id")
def units_rejoin(spark, sf):
    whole = documents(spark, sf).select(F.col("doc_id").alias("document_id"), words(F.col("text")).alias("whole"))
    units = parts(spark, sf).select("document_id", "partition_index", words(F.col("text")).alias("tokens"))
    return samples.joined_again(units, whole, "document_id", "partition_index", "tokens", "whole")


@query("next_unfed", "SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def next_unfed(spark, sf):
    return samples.next_unfed(documents(spark, sf).select(F.col("doc_id").alias("document_id")), table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")), "document_id", 25)


@query("newest_document", "SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 1")
def newest_document(spark, sf):
    return samples.newest(documents(spark, sf).select("doc_id", "lang"), "doc_id")


@query("byte_offsets", r"""WITH p AS (SELECT item_id, regexp_extract_all(text, ' ?[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS ps FROM benchmark), x AS (SELECT item_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM p)
    SELECT item_id, pos, coalesce(sum(strlen(piece)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte FROM x""")
def byte_offsets(spark, sf):
    return build.byte_offsets(pieces(spark, sf).withColumnRenamed("i", "pos"), "item_id", "piece").select("item_id", "pos", "byte")


FACTS = r"""p AS (SELECT item_id, regexp_extract_all(text, ' ?[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS ps FROM benchmark), x AS (SELECT item_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM p),
b AS (SELECT item_id, pos, strlen(piece) AS size, coalesce(sum(strlen(piece)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte FROM x),
f AS (SELECT item_id AS fact, item_id, 20 AS start, 40 AS stop, 10 AS context FROM benchmark UNION ALL SELECT item_id + 1000, item_id, byte, byte + size, 5 FROM b WHERE pos = 6),
l AS (SELECT f.fact, f.item_id, s.pos AS first, e.pos + 1 AS last, (SELECT max(c.pos) FROM b c WHERE c.item_id = f.item_id AND c.byte <= f.context) AS context_token FROM f JOIN b s ON s.item_id = f.item_id AND s.byte = f.start JOIN b e ON e.item_id = f.item_id AND e.byte + e.size = f.stop)"""


def byte_facts(spark, sf):
    b = build.byte_offsets(pieces(spark, sf).withColumnRenamed("i", "pos"), "item_id", "piece")
    base = table(spark, sf, "benchmark").select(F.col("item_id").alias("fact"), "item_id", F.lit(20).cast("long").alias("start"), F.lit(40).cast("long").alias("stop"), F.lit(10).cast("long").alias("context"))
    exact = b.where("pos = 6").select((F.col("item_id") + 1000).alias("fact"), "item_id", F.col("byte").alias("start"), (F.col("byte") + F.col("size")).alias("stop"), F.lit(5).cast("long").alias("context"))
    return base.unionByName(exact), b


@query("fact_locator", f"WITH {FACTS} SELECT fact, item_id, first, last, context_token FROM l")
def fact_locator(spark, sf):
    facts, b = byte_facts(spark, sf)
    return build.located(facts, b, "item_id")[0].select("fact", "item_id", F.col("first").cast("long"), F.col("last").cast("long"), F.col("context_token").cast("long"))


@query("fact_unaligned", f"WITH {FACTS} SELECT fact FROM f WHERE fact NOT IN (SELECT fact FROM l)")
def fact_unaligned(spark, sf):
    facts, b = byte_facts(spark, sf)
    return build.located(facts, b, "item_id")[1].select("fact")


@query("build_index", f"WITH {TOKENS}, k AS (SELECT * FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), m AS (SELECT doc_id, pos, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM k) SELECT doc_id AS row, count(*) AS entries, sum(nx)::BIGINT AS total, min(pos + 1) AS first FROM m WHERE nx IS NOT NULL GROUP BY 1")
def build_index(spark, sf):
    out = table(spark, sf, "labels").where("quality = 0")
    b = build.build(documents(spark, sf).select("doc_id", "text"), "doc_id", "text", (F.col("next") % 1000) / 1000.0, F.lit(0.0), out)
    return b.entries.groupBy("row").agg(F.count(F.lit(1)).alias("entries"), F.sum("value").alias("total"), F.min("offset").cast("long").alias("first"))


@query("answer_plan", f"WITH {HITS}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query)) / 0.05::DOUBLE) AS e FROM hits), w AS (SELECT query, value, sum(e) AS s FROM e GROUP BY 1, 2), d AS (SELECT query, value, s / sum(s) OVER (PARTITION BY query) AS p FROM w), lm AS (SELECT label::BIGINT AS value, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY 1), x AS (SELECT q.query, lm.value, round(lm.p * 0.75 + coalesce(d.p, 0) * 0.25, 9) AS p FROM (SELECT DISTINCT query FROM hits) q CROSS JOIN lm LEFT JOIN d ON d.query = q.query AND d.value = lm.value) SELECT query, arg_max(value, (p, -value)) AS value, round(max(p), 6) AS p FROM x GROUP BY 1")
def answer_plan(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"), F.lit(None).cast("long").alias("grp"), F.col("label").cast("long").alias("value"))
    q = e.where("entry % 50 = 0").select(F.col("entry").alias("query"), "vector", "grp")
    n = answer.retrieved(q, e, 16, 0.05)
    labels = e.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    model = q.select("query").join(few(labels.join(F.broadcast(labels.agg(F.sum("c").alias("t")))))).select("query", "value", (F.col("c") / F.col("t")).alias("p"))
    return rounded(answer.answered(n, model, 0.25))


@query("tokenize_udtf", r"SELECT item_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS pieces FROM benchmark")
def tokenize_udtf(spark, sf):
    tables.register(spark)
    table(spark, sf, "benchmark").createOrReplaceTempView("_prompts")
    return spark.sql("SELECT item_id, count(*) AS pieces FROM _prompts, LATERAL tokenize(text) GROUP BY item_id")


@query("lift_over_commons", f"WITH {LIKELIHOODS} SELECT item_id, position, round(greatest(0, max(CASE WHEN strand = 'en' THEN -ln(p) END) - max(CASE WHEN strand = 'de' THEN -ln(p) END)), 6) AS lift FROM likelihoods GROUP BY 1, 2")
def lift_over_commons(spark, sf):
    loss = lambda s: F.max(F.when(F.col("strand") == s, -F.ln("p")))
    return rounded(likelihoods(spark, sf).groupBy("item_id", "position").agg(F.greatest(F.lit(0.0), loss("en") - loss("de")).alias("lift")))


@query("kind_counts", "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1")
def kind_counts(spark, sf):
    return documents(spark, sf).groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
