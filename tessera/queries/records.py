"""Records, lookups, guards, parsers, tokenizers and sessions."""

import math
from collections import deque

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import formats, rng, scores, text
from tessera.operators import cite, evaluate, mix, questions, samples
from tessera.session import table
from tessera.sources import records, store, synthetic
from tessera.sources.scratch import Scratch
from tessera.streaming import sessions as session_state
from tessera.streaming.sync import Throttle

from .base import PROMPTS, TOKENS, documents, prompts, query, rounded, tokens
from .citation import CHOSEN, CITED, chosen, neighbours, rows
from .retrieval import PROFILES, profiles

CITATIONS = CITED + """,
best AS (SELECT gen, k, row, weight, CASE WHEN product > 0 THEN pow(product, 1 / 3.0::DOUBLE) ELSE 0 END AS confidence, row_number() OVER (PARTITION BY gen, k ORDER BY weight DESC, score DESC, row) AS place FROM cited)"""


def saved_generations(spark, sf, path):
    cited = cite.citations(neighbours(spark, sf), rows(spark, sf)).where("place <= 3").withColumnRenamed("gen", "generation_id")
    spans = chosen(spark, sf).withColumnRenamed("gen", "generation_id")
    said = prompts(spark, sf).select(F.col("item_id").alias("generation_id"), F.col("pos").alias("k"), "token")
    records.save(records.generations(said, cited, spans), path, records.GENERATION)
    return records.load(spark, path, records.GENERATION)


@query("generation_record", f"WITH {CITATIONS} SELECT p.item_id::VARCHAR AS generation_id, p.pos::BIGINT AS k, p.token, place, row, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM prompts p LEFT JOIN (SELECT * FROM best WHERE place <= 3) b ON b.gen = p.item_id AND b.k = p.pos")
def generation_record(spark, sf):
    """Every prompt as a generation with its tokens and their best citations, saved and read back."""
    found = saved_generations(spark, sf, f"{Scratch(spark, 'generations').path}/all")
    at = found.select("generation_id", F.explode("tokens").alias("t")).select("generation_id", "t.k", "t.token", F.explode_outer("t.citations").alias("c"))
    return rounded(at.select("generation_id", "k", "token", "c.place", "c.row", "c.weight", "c.confidence"))


@query("generation_spans_record", f"WITH RECURSIVE {CHOSEN} SELECT gen::VARCHAR AS generation_id, span, start, length, row, offs AS offset FROM spans")
def generation_spans_record(spark, sf):
    found = saved_generations(spark, sf, f"{Scratch(spark, 'generations').path}/all")
    return found.select("generation_id", F.explode("spans").alias("s")).select("generation_id", "s.*")


@query("grounding_record", f"WITH {PROMPTS}, t AS (SELECT item_id, pos AS step, token FROM prompts QUALIFY pos < max(pos) OVER (PARTITION BY item_id)), m AS (SELECT item_id, pos AS step, CASE WHEN pos % 6 = 5 THEN token + 1 ELSE token END AS token FROM prompts) SELECT m.item_id::VARCHAR AS generation_id, m.step::BIGINT AS step, t.token IS NULL OR t.token = m.token AS aligned FROM m LEFT JOIN t ON t.item_id = m.item_id AND t.step = m.step")
def grounding_record(spark, sf):
    """Grounding records beside the generations, found by generation."""
    path = f"{Scratch(spark, 'grounding').path}/generations"
    p = prompts(spark, sf).select("item_id", F.col("pos").alias("step"), "token")
    measured = p.withColumn("token", F.when(F.col("step") % 6 == 5, F.col("token") + 1).otherwise(F.col("token")))
    last = p.groupBy(F.col("item_id").alias("_item")).agg(F.max("step").alias("_last"))
    traces = p.join(last, (F.col("item_id") == F.col("_item")) & (F.col("step") < F.col("_last"))).select("item_id", "step", "token")
    found = evaluate.grounding_rows(traces, measured, ["item_id"]).withColumn("generation_id", F.col("item_id").cast("string"))
    records.save(records.listed(found, ["generation_id"], records.GROUNDING["steps"].dataType.elementType, "steps"), records.grounding_path(path), records.GROUNDING)
    return records.load(spark, records.grounding_path(path), records.GROUNDING).select("generation_id", F.explode("steps").alias("s")).select("generation_id", "s.*")


@query("profile_record", f"WITH {PROFILES} SELECT thread::VARCHAR AS thread, 'v1' AS version, centroid::BIGINT AS centroid, round(list_sum(vector), 5) AS total, round(vector[7], 6) AS seventh FROM cvec")
def profile_record(spark, sf):
    path = f"{Scratch(spark, 'profiles').path}/all"
    p = profiles(spark, sf).withColumn("version", F.lit("v1")).withColumn("mass", F.lit(1.0)).withColumn("thread", F.col("thread").cast("string"))
    records.save(records.listed(p, ["thread", "version"], records.PROFILE["centroids"].dataType.elementType, "centroids"), path, records.PROFILE)
    found = records.load(spark, path, records.PROFILE, "version", "v1").select("thread", "version", F.explode("centroids").alias("c"))
    total = F.aggregate("c.vector", F.lit(0.0), lambda s, x: s + x)
    return found.select("thread", "version", F.col("c.centroid").alias("centroid"), F.round(total, 5).alias("total"), F.round(F.get("c.vector", F.lit(6)), 6).alias("seventh"))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("bpe_round_trip", "SELECT doc_id, sha256(text) AS decoded, sha256(text) AS joined, chr(10) || chr(10) AS mark FROM documents")
def bpe_round_trip(spark, sf):
    """Every text as ids of a byte-level vocabulary and back, once by decoding and once from the tokens' bytes; the ids of a paragraph break."""
    from tessera.functions import bpe

    path = vocabulary_file()
    back = bpe.round_trips(documents(spark, sf), "doc_id", "text", path)
    mark = spark.range(0, 1, 1, 1).select(bpe.decoded(path)(F.array(*[F.lit(i) for i in bpe.paragraph_break(path)])).alias("mark"))
    return back.select("doc_id", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded"), F.sha2("joined", 256).alias("joined")).join(F.broadcast(mark))


@query("document_lookup", "SELECT doc_id::VARCHAR AS document_id, sha256(text) AS sha FROM documents WHERE doc_id IN (3, 50, 77, 150, 199, 9999999)")
def document_lookup(spark, sf):
    """The feature is a lookup by given ids."""
    docs = documents(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), text.sha256(F.col("text")).alias("sha"))
    return store.by_ids(docs, ["3", "50", "77", "150", "199", "9999999"])


@query("wait_until_visible", "SELECT true AS visible, false AS absent")
def wait_until_visible(spark, sf):
    """Whether all documents of a store become visible, and an id that never comes does."""
    scratch = Scratch(spark, "visible")
    ids = documents(spark, sf).select(F.col("doc_id").alias("document_id"))
    ids.write.parquet(f"{scratch.path}/store")
    live = lambda: spark.read.parquet(f"{scratch.path}/store")
    seen, absent = store.wait_until(live, ids, 30), store.wait_until(live, spark.range(1).select((F.col("id") - 1).alias("document_id")), 0.1, 0.05)
    return spark.createDataFrame([(seen, absent)], "visible boolean, absent boolean")


@query("files_to_documents", "SELECT sha256(n_name || chr(10)) AS sha FROM nation UNION ALL SELECT sha256(text) FROM documents WHERE text IS NOT NULL")
def files_to_documents(spark, sf):
    """A text file for each nation and JSON lines of documents, read as documents."""
    path = Scratch(spark, "files").path
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(f"{path}/texts")
    documents(spark, sf).select("text").write.json(f"{path}/lines")
    return store.files(spark, f"{path}/texts", f"{path}/lines").select(text.sha256(F.col("text")).alias("sha"))


@query("file_digests", "SELECT sha256(n_name || chr(10)) AS sha, strlen(n_name) + 1 AS length FROM nation")
def file_digests(spark, sf):
    path = Scratch(spark, "files").path
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path + "/texts")
    return store.file_digests(spark, path + "/texts").select("sha", "length")


@query("recorded_events", "SELECT event_id, event_type FROM events")
def recorded_events(spark, sf):
    """Events slimmed to the columns that are kept, appended in two parts."""
    path = Scratch(spark, "recorder").path
    e = store.slim(table(spark, sf, "events"), ["event_id", "event_type", "no_such_column"])
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{path}/events")
    return spark.read.parquet(f"{path}/events")


@query("index_guards", "SELECT count(*) AS entries, true AS miscounted, true AS weak, true AS foreign, false AS sound FROM embeddings")
def index_guards(spark, sf):
    """An index that is as said, and which faults are refused."""
    keys = table(spark, sf, "embeddings").select(F.col("embedding").alias("vector"))
    number = keys.count()
    info = lambda n: spark.createDataFrame([(n,)], "entries long")
    strong = lambda m, c: spark.createDataFrame([(m, c, "a")], "memorised double, chain string, expected_chain string")

    def refused(call) -> bool:
        try:
            call()
        except store.StoreError:
            return True
        return False

    faults = [refused(lambda: store.checked_index(keys, info(number + 1))), refused(lambda: store.strong_index(strong(0.49, "a"))), refused(lambda: store.strong_index(strong(0.9, "b"))), refused(lambda: store.strong_index(strong(0.5, "a")))]
    found = store.checked_index(keys, info(number)).agg(F.count(F.lit(1)).alias("entries"))
    return found.select("entries", *[F.lit(x).alias(c) for c, x in zip(("miscounted", "weak", "foreign", "sound"), faults, strict=True)])


@query("address_projection", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, 'caller') AS thread, doc_id % 4 AS partition_index FROM documents")
def address_projection(spark, sf):
    own = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    d = documents(spark, sf).select("doc_id", formats.address(own, F.lit("caller"), F.col("doc_id"), F.col("doc_id") % 4, F.lit(0)).alias("a"))
    return d.select("doc_id", "a.thread", "a.partition_index")


@query("shared_quota", "WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source, 1000 // n + (i < 1000 % n)::BIGINT AS share FROM s")
def shared_quota(spark, sf):
    """A thousand samples shared out evenly over sources, the first ones one more. Sources are few."""
    s = documents(spark, sf).select("source").distinct()
    s = s.withColumn("i", F.row_number().over(Window.orderBy("source")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return s.select("source", samples.shared_out(1000, F.col("n"), F.col("i")).alias("share"))


@query("unit_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings")
def unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", scores.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return e.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(scores.norm(F.col("u")), 6).alias("norm"))


@query("scaled_floor", "SELECT event_id, round(0.3 * 2 / greatest(2, event_id % 5 + 1), 6)::DOUBLE AS floor FROM events")
def scaled_floor(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", scores.gate_floor(0.3, F.col("event_id") % 5 + 1).alias("floor")))


@query("rewrite_cleaned", r"""WITH t AS (SELECT doc_id, split_part('" ' || replace(text, '_', '-') || '?_and more', '_', 1) AS x FROM documents) SELECT doc_id, sha256(regexp_replace(regexp_replace(x, '^[\s"'']+', ''), '[\s"''.,:;?!]+$', '')) AS sha FROM t""")
def rewrite_cleaned(spark, sf):
    written = F.concat(F.lit('" '), F.replace("text", F.lit("_"), F.lit("-")), F.lit("?_and more"))
    return documents(spark, sf).select("doc_id", text.sha256(questions.cleaned(written)).alias("sha"))


@query("rearranged_units", "SELECT doc_id, 20 AS n, 190 AS total, 0 AS neighbours FROM documents")
def rearranged_units(spark, sf):
    """Twenty units in a new order for each document: how many, their sum, and how many neighbours were neighbours before."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: rng.rearranged(list(range(20)), int(s)))

    d = documents(spark, sf).select("doc_id", run(F.col("doc_id")).alias("u"))
    follows = F.size(F.filter(F.arrays_zip(F.slice("u", 1, 19).alias("a"), F.slice("u", 2, 19).alias("b")), lambda p: p["b"] == p["a"] + 1))
    return d.select("doc_id", F.size(F.array_distinct("u")).alias("n"), F.aggregate("u", F.lit(0), lambda s, x: s + x).alias("total"), follows.alias("neighbours"))


def drawn() -> str:
    """A Fisher-Yates shuffle of twenty numbers by the seeded generator, a swap at a time."""
    mask = f"{rng.MASK}::UHUGEINT"
    return f"""WITH RECURSIVE draws AS (SELECT doc_id, 19 AS i, doc_id::UHUGEINT AS state, range(0, 20) AS items FROM documents
        UNION ALL
        SELECT doc_id, i - 1, state, list_transform(items, lambda x, k: CASE WHEN k = i + 1 THEN items[j + 1] WHEN k = j + 1 THEN items[i + 1] ELSE x END) FROM (
            SELECT doc_id, i, state, items, (xor(z, z >> 31) % (i + 1)::UHUGEINT)::BIGINT AS j FROM (
                SELECT *, (xor(y, y >> 27) * {rng.MIX_B}::UHUGEINT) & {mask} AS z FROM (
                    SELECT *, (xor(state, state >> 30) * {rng.MIX_A}::UHUGEINT) & {mask} AS y FROM (
                        SELECT doc_id, i, items, (state + {rng.GAMMA}::UHUGEINT) & {mask} AS state FROM draws WHERE i > 0)))))
    SELECT doc_id, array_to_string(items, ',') AS items FROM draws WHERE i = 0"""


@query("value_pool", drawn())
def value_pool(spark, sf):
    """Twenty values drawn without replacement for each document."""

    @F.pandas_udf(T.StringType())
    def run(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: ",".join(map(str, rng.SplitMix64(int(s)).shuffled(list(range(20))))))

    return documents(spark, sf).select("doc_id", run(F.col("doc_id")).alias("items"))


SETTING = "CASE doc_id % 5 WHEN 0 THEN source || ', ' || lang WHEN 1 THEN source || ',' || source WHEN 2 THEN 'top:' || (doc_id + 1) WHEN 3 THEN source || '#' || doc_id || ',' || lang || '#1' ELSE 'all' END"


@query("parsed_settings", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '|' || lang WHEN 1 THEN '' WHEN 2 THEN 'top ' || (doc_id + 1) WHEN 3 THEN 'ids ' || source || '#' || doc_id || ' ' || lang || '#1' ELSE 'all' END AS parsed, doc_id % 5 <> 1 AS sound FROM (SELECT doc_id, source, lang, {SETTING} AS setting FROM documents)")
def parsed_settings(spark, sf):
    """Of every document a list of nodes or a source policy as read; what is ill-formed is refused."""

    @F.pandas_udf("parsed string, sound boolean")
    def read(setting: pd.Series, nodes: pd.Series) -> pd.DataFrame:
        out = []
        for text, listed in zip(setting, nodes, strict=True):
            try:
                if listed:
                    out.append(("|".join(formats.node_list(text)), True))
                    continue
                kind, what = formats.source_policy(text)
                out.append((" ".join([kind, *([] if what is None else [str(what)] if isinstance(what, int) else what)]), True))
            except ValueError:
                out.append(("", False))
        return pd.DataFrame(out, columns=["parsed", "sound"])

    d = documents(spark, sf).select("doc_id", F.expr(SETTING).alias("setting"))
    return d.select("doc_id", read("setting", F.col("doc_id") % 5 < 2).alias("r")).select("doc_id", "r.*")


@query("json_lines_non_finite", """SELECT event_id, '{"a":' || event_id || ',"b":"' || CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE (event_id % 7) || '.0' END || '"}' AS line FROM events""")
def json_lines_non_finite(spark, sf):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(math.nan)).when(F.col("event_id") % 4 == 1, F.lit(math.inf)).when(F.col("event_id") % 4 == 2, F.lit(-math.inf)).otherwise((F.col("event_id") % 7).cast("double"))
    return table(spark, sf, "events").select("event_id", store.sorted_json([F.col("event_id").alias("a"), store.finite(x).alias("b")]).alias("line"))


@query("commons_expert", f"WITH {TOKENS}, c AS (SELECT lang, token, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT lang, token, round(n / sum(n) OVER (PARTITION BY lang), 9)::DOUBLE AS p FROM c")
def commons_expert(spark, sf):
    """The expert that every node shares: a background model of each world, to which retrieval adds nothing."""
    counts = tokens(spark, sf).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    lm = counts.join(sizes, "lang").select("lang", "token", (F.col("n") / F.col("whole")).alias("p"))
    return mix.interpolated(lm, lm.limit(0), ["lang"], "token", 0.0).select("lang", "token", F.round("p", 9).alias("p"))


KINDS = "CASE event_id % 7 WHEN 0 THEN 'open' WHEN 5 THEN 'close' WHEN 3 THEN 'hidden' ELSE 'advance' END"


@query("stream_served_sessions", f"""WITH r AS (SELECT user_id AS session, event_id AS "at", {KINDS} AS kind, event_id // 100 AS live FROM events),
    g AS (SELECT *, count(*) FILTER (kind = 'open') OVER w AS turn FROM r WINDOW w AS (PARTITION BY session ORDER BY "at")),
    c AS (SELECT *, coalesce(count(*) FILTER (kind = 'close') OVER (PARTITION BY session, turn ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, max(CASE WHEN kind = 'open' THEN live END) OVER (PARTITION BY session, turn) AS pinned, count(*) FILTER (kind = 'advance') OVER (PARTITION BY session, turn ORDER BY "at") AS taken FROM g)
    SELECT session, "at", kind, CASE WHEN turn > 0 AND closed = 0 THEN pinned END AS version, CASE WHEN turn > 0 AND closed = 0 THEN taken END AS steps, CASE WHEN turn > 0 AND closed = 0 THEN 'served' ELSE 'refused' END AS status FROM c""")
def stream_served_sessions(spark, sf):
    """Every user's events as requests of a session, from a stream of them."""
    scratch = Scratch(spark, "served")
    kind = F.when(F.col("event_id") % 7 == 0, "open").when(F.col("event_id") % 7 == 5, "close").when(F.col("event_id") % 7 == 3, "hidden").otherwise("advance")
    r = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("at"), kind.alias("kind"), F.floor(F.col("event_id") / 100).alias("live"))
    r.write.parquet(f"{scratch.path}/in")
    stream = spark.readStream.schema(r.schema).parquet(f"{scratch.path}/in")
    q = session_state.served(stream).writeStream.format("parquet").option("path", f"{scratch.path}/out").option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{scratch.path}/out")


@query("synthetic_crossings", "SELECT 3000 AS links, 4 AS kinds, 5 AS nodes, 3000 AS subjects, 0 AS not_peers, 0 AS verbatim, 0 AS wrong")
def synthetic_crossings(spark, sf):
    """Links of a generated world of five nodes, and how many break its rules: none joins nodes that aren't peers, none has a
    sentence on both sides, and facts agree as the kind of link says."""
    synthetic.register(spark)
    d = spark.read.format("tessera_crossings").option("documents", 3000).option("seed", 5).option("nodes", 5).option("peers", 2).load()
    number = lambda c: F.substring(c, 5, 9).cast("int")
    step = F.pmod(number("peer") - number("node"), F.lit(5))
    verbatim = F.exists(F.split("text", r"(?<=\.) "), lambda x: F.contains(F.col("peer_text"), x))
    same, theirs = F.size(F.array_intersect("facts", "peer_facts")), F.size("peer_facts")
    kind = F.col("kind")
    right = F.when(kind == "paraphrase", (same == 4) & (theirs == 4)).when(kind == "summary", (same == 2) & (theirs == 2)).when(kind == "variant", (same == 3) & (theirs == 4)).otherwise(same == 0)
    named = F.contains("text", F.col("subject")) & F.contains("peer_text", F.col("subject"))
    return d.agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("kind").alias("kinds"), F.count_distinct("node").alias("nodes"), F.count_distinct("subject").alias("subjects"),
        F.count_if(~step.between(1, 2)).alias("not_peers"), F.count_if(verbatim).alias("verbatim"), F.count_if(~right | ~named).alias("wrong"),
    )


@query("sync_rounds", "SELECT source AS node, (row_number() OVER (ORDER BY source) - 1) // 3 AS round FROM (SELECT DISTINCT source FROM documents)")
def sync_rounds(spark, sf):
    """In which round each node is sent when three may sync at once and every one settles before the next. Nodes are few."""
    names = sorted(r["source"] for r in documents(spark, sf).select("source").distinct().collect())
    throttle, out, versions = Throttle(deque(names), 3), [], dict.fromkeys(names, 0)
    for k in range(len(names)):
        sent = throttle.advance({n: {"versions": v, "busy": False, "stopped": False} for n, v in versions.items()})
        out += [(n, k) for n in sent]
        versions |= {n: versions[n] + 1 for n in sent}
    return spark.createDataFrame(out, "node string, round long")
