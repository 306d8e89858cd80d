"""Sources, sinks and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rng
from tessera.functions.text import sha256
from tessera.operators import corpus
from tessera.sources import store, synthetic
from tessera.sources.scratch import Scratch
from tessera.session import table
from tessera.streaming import sessions as session_state
from tessera.streaming import sync, windows

from .base import BEFORE, PARTS, TOKENS, derived, documents, mixed_numbers, parts, query


def exported(spark, sf):
    return documents(spark, sf).select(F.concat(F.lit("doc-"), F.col("source"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("document_id"), F.col("lang").alias("owner"), F.col("source").alias("group"), "n_chars")


EXPORT = """x AS (SELECT 'doc-' || source || '-' || lpad(doc_id::VARCHAR, 9, '0') AS document_id, lang AS owner, source AS "group", n_chars FROM documents)"""


@query("export_page", f"""WITH {EXPORT} SELECT * FROM x WHERE owner = 'en' AND "group" IN ('src0', 'src1') AND starts_with(document_id, 'doc-src') AND document_id > 'doc-src0-000000020' ORDER BY document_id LIMIT 40""")
def export_page(spark, sf):
    return store.export(exported(spark, sf), "en", ["src0", "src1"], "doc-src", "doc-src0-000000020", 40)


@query("exported_ids", f"WITH {EXPORT} SELECT DISTINCT document_id FROM x WHERE starts_with(document_id, 'doc-src1')")
def exported_ids(spark, sf):
    return store.exported_ids(exported(spark, sf), prefix="doc-src1")


@query("source_stats", f'WITH {EXPORT} SELECT count(DISTINCT document_id) AS documents, count(DISTINCT "group") AS groups, count(DISTINCT owner) AS owners FROM x')
def source_stats(spark, sf):
    return store.source_stats(exported(spark, sf))


@query("index_requests", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT source, doc_id, n // 16 AS request, n % 16 AS place FROM r")
def index_requests(spark, sf):
    return store.requests(documents(spark, sf).select("source", "doc_id"), "source", "doc_id", 16).select("source", "doc_id", "request", F.col("place").cast("long"))


@query("withdrawn_documents", f"WITH {EXPORT} SELECT document_id FROM x WHERE owner <> 'de'")
def withdrawn_documents(spark, sf):
    x = exported(spark, sf)
    return store.removed(x, x.where("owner = 'de'")).select("document_id")


@query("wire_partitions", f"WITH {PARTS}, g AS (SELECT document_id, list(text ORDER BY partition_index) AS texts FROM parts GROUP BY 1), w AS (SELECT document_id, texts, CASE WHEN document_id % 2 = 0 THEN list_transform(texts, lambda t: 'u' || length(t)) ELSE ['u'] END AS urls FROM g) SELECT document_id, generate_subscripts(texts, 1) - 1 AS partition_index, sha256(unnest(texts)) AS sha, unnest(CASE WHEN len(urls) = len(texts) THEN urls ELSE list_transform(texts, lambda t: NULL::VARCHAR) END) AS url FROM w")
def wire_partitions(spark, sf):
    g = parts(spark, sf).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("partition_index", "text"))), lambda x: x["text"]).alias("texts"))
    urls = F.when(F.col("document_id") % 2 == 0, F.transform("texts", lambda t: F.concat(F.lit("u"), F.length(t).cast("string")))).otherwise(F.array(F.lit("u")))
    return store.wire_partitions(g.withColumn("urls", urls)).select("document_id", "partition_index", sha256(F.col("text")).alias("sha"), "url")


@query("partition_lookup", f"WITH {BEFORE}, lv AS (SELECT document_id, partition_index, text FROM parts WHERE document_id % 7 <> 0) SELECT b.document_id, b.partition_index, sha256(l.text) AS sha FROM before b LEFT JOIN lv l ON l.document_id = b.document_id AND l.partition_index = b.partition_index")
def partition_lookup(spark, sf):
    from .base import snapshots

    before, live = snapshots(spark, sf)
    return store.partition_texts(before.select("document_id", "partition_index"), live).select("document_id", "partition_index", sha256(F.col("text")).alias("sha"))


@query("routed_lookup", f"""WITH {PARTS}, nodes AS (SELECT DISTINCT source AS node, 'doc-' || source || '-' AS prefix FROM documents), lv AS (SELECT source AS node, 'doc-' || source || '-' || document_id AS document_id, partition_index, text FROM parts), a AS (SELECT 'doc-' || source || '-' || doc_id AS document_id, 0 AS partition_index FROM documents) SELECT a.document_id, n.node, sha256(l.text) AS sha FROM a LEFT JOIN nodes n ON starts_with(a.document_id, n.prefix) LEFT JOIN lv l ON l.node = n.node AND l.document_id = a.document_id AND l.partition_index = a.partition_index""")
def routed_lookup(spark, sf):
    key = lambda s, d: F.concat(F.lit("doc-"), F.col(s), F.lit("-"), F.col(d).cast("string"))
    nodes = documents(spark, sf).select(F.col("source").alias("node"), F.concat(F.lit("doc-"), "source", F.lit("-")).alias("prefix")).distinct()
    live = parts(spark, sf).select(F.col("source").alias("node"), key("source", "document_id").alias("document_id"), "partition_index", "text")
    asked = documents(spark, sf).select(key("source", "doc_id").alias("document_id"), F.lit(0).alias("partition_index"))
    return store.routed_texts(asked, nodes, live).select("document_id", "node", sha256(F.col("text")).alias("sha"))


@query("corpus_json_roundtrip", "SELECT doc_id AS document_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, sha256(text) AS sha FROM documents")
def corpus_json_roundtrip(spark, sf):
    path = Scratch(spark, "corpus").path
    docs = documents(spark, sf).select(F.col("doc_id").alias("document_id"), "text")
    facts = docs.select("document_id", F.substring("text", 1, 20).alias("sentence"))
    store.write_corpus(docs, facts, path)
    read, _ = store.read_corpus(spark, path, docs.schema, facts.schema)
    return read.select("document_id", "place", sha256(F.col("text")).alias("sha"))


@query("version_store", f"WITH {PARTS} SELECT count(*) AS partitions, count(DISTINCT document_id) AS documents, 1 AS written FROM parts")
def version_store(spark, sf):
    path = Scratch(spark, "versions").path
    p = parts(spark, sf).select("document_id", "partition_index", "sha")
    written = sum(store.save_version(p, path, "corpus_hash", "a1") for _ in range(2))
    v = store.load_version(spark, path, "corpus_hash", "a1")
    return v.agg(F.count(F.lit(1)).alias("partitions"), F.count_distinct("document_id").alias("documents")).withColumn("written", F.lit(written))


@query("token_shard_slice", f"""WITH {TOKENS}, z AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1), s AS (SELECT doc_id, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM z) SELECT (start + pos)::BIGINT AS at, token FROM tokens JOIN s USING (doc_id) WHERE start + pos BETWEEN 5000 AND 5999""")
def token_shard_slice(spark, sf):
    from tessera.operators.index import text_stream

    path = Scratch(spark, "shard").path
    shard = store.shard(spark, path, "words16", lambda: text_stream(documents(spark, sf), "doc_id", "text", 70000))
    return store.token_slice(shard, 5000, 1000).where("offset IS NOT NULL").select("at", "token")


@query("ledger_append", "SELECT event_type AS run, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 2 = 0 OR event_type <> 'view' GROUP BY 1")
def ledger_append(spark, sf):
    path = Scratch(spark, "ledger").path
    e = table(spark, sf, "events").select(F.col("event_type").alias("run"), "event_id", "value")
    store.append_json(e.where("event_id % 2 = 0"), path)
    store.append_json(e.where("event_id % 2 = 1 AND run <> 'view'"), path)
    back = store.read_json(spark, path, T.StructType([T.StructField("run", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())]))
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("registry_fold_whole", "WITH a AS (SELECT source AS slot, 'p' || doc_id AS sha, doc_id AS created, CASE WHEN doc_id % 2 = 0 AND doc_id // 20 = 3 THEN true END AS current FROM documents), r AS (SELECT *, bool_or(coalesce(current, false)) OVER (PARTITION BY slot) AS has, row_number() OVER (PARTITION BY slot ORDER BY created, sha) AS k FROM a) SELECT slot, sha, coalesce(current, false) OR (NOT has AND k = 1) AS current FROM r")
def registry_fold_whole(spark, sf):
    """Every document as a pack of its slot."""
    return packs_folded(documents(spark, sf))


def packs_folded(docs):
    a = docs.select(F.col("source").alias("slot"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("sha"), F.col("doc_id").alias("created"), F.when((F.col("doc_id") % 2 == 0) & (F.floor(F.col("doc_id") / 20) == 3), F.lit(True)).alias("current"))
    return store.registry(a.where("created % 3 <> 0"), a).select("slot", "sha", "current")


@query("catalog_recency", "SELECT source AS name, max(CASE WHEN doc_id % 3 = 0 THEN doc_id END) AS updated FROM documents GROUP BY 1 ORDER BY updated DESC NULLS LAST, name")
def catalog_recency(spark, sf):
    return store.catalog(documents(spark, sf).groupBy(F.col("source").alias("name")).agg(F.max(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("updated")))


@query("message_lines", "WITH m AS (SELECT user_id, list(event_type || ':' || event_id ORDER BY event_id) AS ms FROM events GROUP BY 1) SELECT user_id, generate_subscripts(ms, 1) - 1 AS line, unnest(ms) AS message FROM m")
def message_lines(spark, sf):
    """Messages cut in two at an arbitrary place and put together again."""
    m = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit("\n"))
    halves = table(spark, sf, "events").select("user_id", "event_id", m.alias("m")).select("user_id", F.posexplode(F.array(F.substring("m", 1, 3), F.substr("m", F.lit(4)))).alias("half", "piece"), "event_id")
    pieces = halves.withColumn("at", F.col("event_id") * 2 + F.col("half"))
    return store.split_lines(pieces, "user_id", "at", "piece").select("user_id", F.col("line").cast("long"), "message")


@query("packed_floats", "SELECT vec_id, 64 AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def packed_floats(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", store.unpacked_floats(store.packed_floats(F.col("embedding"))).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


#: A document's first draws: how many syllables its subject has, those, and how many paragraphs.
SYNTHETIC = f"""{mixed_numbers(derived(11, 'number'), 'a', '(SELECT range AS number FROM range(2000))')},
steps AS (SELECT number, a, unnest(range(0, 5)) AS k FROM a), {mixed_numbers(f'a + k::UHUGEINT * {rng.GAMMA}::UHUGEINT', 'r', 'steps')},
draws AS (SELECT number, list(r ORDER BY k) AS d FROM r GROUP BY 1),
made AS (SELECT number, 'node' || number % 4 AS node, 2 + d[1] % 2::UHUGEINT AS n, list_transform(d[2:4], lambda x: (x % {len(synthetic.SYLLABLES)}::UHUGEINT)::BIGINT) AS s, d FROM draws)"""


@query("synthetic_corpus", f"WITH {SYNTHETIC} SELECT node, count(*) AS documents, sum(2 + d[n::BIGINT + 2] % 3::UHUGEINT)::BIGINT AS paragraphs, count(DISTINCT s[1:n::BIGINT]) AS subjects FROM made GROUP BY 1")
def synthetic_corpus(spark, sf):
    synthetic.register(spark)
    d = spark.read.format("tessera_corpus").option("documents", 2000).option("seed", 11).option("nodes", 4).load()
    return d.groupBy("node").agg(F.count(F.lit(1)).alias("documents"), F.sum("paragraphs").alias("paragraphs"), F.count_distinct("subject").alias("subjects"))


@query("book_paragraphs", r"SELECT conv_id, sha256(regexp_replace(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '\r\n?', chr(10), 'g'), '\n', ' ', 'g')) AS sha FROM conversations GROUP BY 1")
def book_paragraphs(spark, sf):
    from tessera.sources.web import book_body

    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))
    book = F.concat(F.lit("Title\n*** START OF THE BOOK ***\n"), "body", F.lit("*** END OF THE BOOK ***\nlicense"))
    return c.select("conv_id", sha256(book_body(book)).alias("sha"))


@query("event_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf):
    return windows.tumbling(table(spark, sf, "events"), "1 hour", ["event_type"])


@query("event_sliding", "WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL (k * 30) MINUTE AS start, event_type, value FROM events, range(2) r(k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def event_sliding(spark, sf):
    return windows.sliding(table(spark, sf, "events"), "1 hour", "30 minutes", ["event_type"])


@query("event_session", "WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '2 hours' AS brk FROM events), s AS (SELECT user_id, ts, sum(coalesce(brk, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS stop, count(*) AS n FROM s GROUP BY user_id, s")
def event_session(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "2 hours", "user_id")


@query("newest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def newest_state(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return windows.newest(e, "user_id", "event_id").select("user_id", "event_type", "value")


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    """The batch query's result from a stream: every batch replaces the table of windows."""
    scratch = Scratch(spark, "stream")
    counted = windows.tumbling(event_stream(spark, sf), "1 hour", ["event_type"])
    q = counted.writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{scratch.path}/out")).option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{scratch.path}/out")


FEED = BEFORE + """, removed AS (SELECT DISTINCT document_id FROM before WHERE document_id NOT IN (SELECT document_id FROM after)), live AS (SELECT b.document_id, b.partition_index FROM before b WHERE document_id NOT IN (SELECT document_id FROM removed) UNION SELECT document_id, partition_index FROM after)"""


@query("stream_sync_foreachbatch", f"WITH {FEED} SELECT document_id, count(*) AS partitions FROM live GROUP BY 1")
def stream_sync_foreachbatch(spark, sf):
    """A first snapshot, then the difference to a second, through the ladder; the live version's partitions by document."""
    from .base import snapshots

    scratch = Scratch(spark, "sync")
    before, after = snapshots(spark, sf)
    columns = ["document_id", "partition_index", "text", "sha"]
    gone = corpus.document_changes(before, after).where("change = 'removed'").select("document_id", F.lit(0).alias("partition_index"), F.lit("").alias("text"), F.lit("").alias("sha"), F.lit("withdraw").alias("op"))
    first = before.select(*columns).withColumn("op", F.lit("deposit"))
    second = after.select(*columns).withColumn("op", F.lit("deposit")).unionByName(gone)
    ladder = sync.Ladder(spark, scratch.path)
    for feed in (first, second):
        feed.write.mode("append").option("compression", "zstd").parquet(f"{scratch.path}/feed")
        stream = spark.readStream.schema(first.schema).parquet(f"{scratch.path}/feed")
        ladder.follow(stream, f"{scratch.path}/checkpoint").awaitTermination()
    return ladder.index(ladder.live()).groupBy("document_id").agg(F.count(F.lit(1)).alias("partitions"))


SYNC_PLAN = "CASE WHEN {0} >= 0.05::DOUBLE * {1} THEN 'reindex+train' ELSE 'reindex' END"


@query("sync_versions", f"""WITH {PARTS}, n AS (SELECT count(*) AS n, count(*) FILTER (document_id % 100 = 7) AS a, count(*) FILTER (document_id % 100 = 11) AS w, count(*) FILTER (document_id % 100 = 13) AS b, count(*) FILTER (document_id % 100 = 17) AS c FROM parts)
    SELECT 0 AS batch, 0 AS version, 'train' AS plan, n AS added, 0 AS changed, 0 AS removed, n AS partitions, true AS passed FROM n
    UNION ALL SELECT 1, 1, {SYNC_PLAN.format("a", "n")}, 0, a, 0, n, true FROM n
    UNION ALL SELECT 2, 1, {SYNC_PLAN.format("b", "(n - w)")}, 0, b, w, n - w, false FROM n
    UNION ALL SELECT 3, 3, {SYNC_PLAN.format("(b + c)", "(n - w)")}, 0, b + c, w, n - w, true FROM n""")
def sync_versions(spark, sf):
    """The whole corpus, then one document in a hundred at a time changed or withdrawn, as a stream of four batches.

    Every version is probed: each changed partition is quoted as the version has it. The third version answers from the one
    before, so that its quotes are stale and it is held; the fourth makes up for it.
    """
    scratch = Scratch(spark, "versions")
    p = parts(spark, sf).select("document_id", "partition_index", "text", "sha")
    text_ = F.concat(F.lit("!"), "text")
    changed = lambda k: p.where(f"document_id % 100 = {k}").select("document_id", "partition_index", text_.alias("text"), sha256(text_).alias("sha"), F.lit("deposit").alias("op"))
    gone = p.where("document_id % 100 = 11").select("document_id", F.lit(0).alias("partition_index"), F.lit("").alias("text"), F.lit("").alias("sha"), F.lit("withdraw").alias("op")).distinct()
    feeds = [p.withColumn("op", F.lit("deposit")), changed(7), changed(13).unionByName(gone), changed(17)]
    ladder = sync.Ladder(spark, f"{scratch.path}/ladder", buckets=16)

    def measure(index, touched, version):
        says = index if version != 2 else ladder.index(1)
        quotes = says.select("document_id", "partition_index", F.lit(0).alias("first"), F.substring("text", 1, 24).alias("text"))
        spans = quotes.join(touched, ["document_id", "partition_index"], "left_semi")
        return sync.Measured(index.select("document_id", "partition_index", F.when(sha256(F.col("text")) == F.col("sha"), 0.0).otherwise(1.0).alias("loss")), spans)

    ladder.measure = measure
    for feed in feeds:
        feed.write.mode("append").option("compression", "zstd").parquet(f"{scratch.path}/feed")
        ladder.follow(spark.readStream.schema(feeds[0].schema).parquet(f"{scratch.path}/feed"), f"{scratch.path}/checkpoint").awaitTermination()
    return ladder.batches()


@query("stream_session_state", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, (event_id % 4) AS x FROM events), h AS (SELECT user_id AS session, j, x + j AS entry FROM e WHERE x < 3 UNION ALL SELECT user_id, j, 7 + j FROM e WHERE j % 5 <> 4),
    c AS (SELECT DISTINCT session, j, entry FROM h), g AS (SELECT *, entry - j AS d, j - row_number() OVER (PARTITION BY session, entry - j ORDER BY j) AS island FROM c), r AS (SELECT session, j, row_number() OVER (PARTITION BY session, d, island ORDER BY j) AS run FROM g), m AS (SELECT session, j, max(run) AS length FROM r GROUP BY 1, 2)
    SELECT user_id AS session, e.j, coalesce(length, 0) AS length FROM e LEFT JOIN m ON m.session = user_id AND m.j = e.j""")
def stream_session_state(spark, sf):
    """Chains of every user's events as a session, from a stream of them."""
    scratch = Scratch(spark, "sessions")
    j = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), j.cast("long").alias("j"), (F.col("event_id") % 4).alias("x"))
    hits = e.select("session", "j", F.array(F.col("x") + F.col("j"), 7 + F.col("j")).alias("entries"), F.array(F.col("x") < 3, F.col("j") % 5 != 4).alias("expected"))
    hits.write.parquet(f"{scratch.path}/in")
    steps = spark.readStream.schema(hits.schema).parquet(f"{scratch.path}/in")
    q = session_state.chain_lengths(steps).writeStream.format("parquet").option("path", f"{scratch.path}/out").option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{scratch.path}/out")


# Plain relational shapes over the star schema.
@query("star_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("star_regions", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_regions(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
