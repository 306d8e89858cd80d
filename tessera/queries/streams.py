"""Streams whose rows come late, whose keys fall silent, and that stop and go on."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.session import table
from tessera.sources import log
from tessera.sources.scratch import Scratch
from tessera.streaming import resume
from tessera.streaming import sessions as session_state
from tessera.streaming.ordered import presence, streaming_session

from .base import documents, query

#: Three batches of ten days; a row may be three hours in the wrong one.
BATCH = "(unix_seconds(ts) - unix_seconds(TIMESTAMP '2024-01-01 00:00:00') + pmod(hash(event_id), 21600) - 10800) DIV 864000"
HOUR = 3_600_000_000


def in_batches(spark, sf, *columns):
    """The events in three batches, shuffled within each, and across where batches meet."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_batch", F.least(F.lit(2), F.greatest(F.lit(0), F.expr(BATCH))))
    return [events.where(F.col("_batch") == k).select("event_id", "user_id", "ts", *columns).orderBy(F.hash("event_id", "ts")) for k in range(3)]


def followed(spark, label, feeds, run):
    """What a stream writes of feeds that come one after another; it is started anew for each, from where it stopped."""
    scratch, own = Scratch(spark, label), streaming_session(spark)
    for feed in feeds:
        feed.write.mode("append").parquet(f"{scratch.path}/in")
        found = run(own.readStream.schema(feed.schema).parquet(f"{scratch.path}/in"))
        found.writeStream.format("parquet").option("path", f"{scratch.path}/out").option("checkpointLocation", f"{scratch.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{scratch.path}/out")


GONE = """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e),
    r AS (SELECT *, count(*) FILTER (gap > 86400000000) OVER (PARTITION BY user_id ORDER BY t) AS run FROM g), s AS (SELECT user_id, min(t) AS joined, max(t) AS last_seen, count(*) AS beats FROM r GROUP BY user_id, run),
    w AS (SELECT max(t) // 1000 * 1000 - 21600000000 AS mark FROM e)
    SELECT user_id AS node, joined, last_seen, last_seen + 86400000000 AS dropped, beats FROM s, w WHERE last_seen + 86400000000 <= mark"""


@query("stream_presence", GONE)
def stream_presence(spark, sf):
    """Users as nodes that are pinged every eight hours: who has missed three in a row, by the time of all."""
    found = followed(spark, "presence", in_batches(spark, sf), lambda s: presence(s, "user_id", "ts", 8 * HOUR, 3, "6 hours"))
    return found.withColumnRenamed("key", "node")


def with_last(feeds, row):
    """A row far ahead of all others ends a stream: the watermark passes every row that waits."""
    last = feeds[-1].agg(*[F.lit(None).cast(kind).alias(c) for c, kind in feeds[-1].dtypes]).select(*[F.expr(row.get(c, c)).alias(c) for c in feeds[-1].columns])
    return [*feeds[:-1], feeds[-1].unionByName(last)]


@query("stream_sessions_late", """WITH r AS (SELECT user_id AS session, event_id AS "at", CASE event_id % 7 WHEN 0 THEN 'open' WHEN 5 THEN 'close' WHEN 3 THEN 'hidden' ELSE 'advance' END AS kind, event_id // 100 AS live FROM events),
    g AS (SELECT *, count(*) FILTER (kind = 'open') OVER w AS turn FROM r WINDOW w AS (PARTITION BY session ORDER BY "at")),
    c AS (SELECT *, coalesce(count(*) FILTER (kind = 'close') OVER (PARTITION BY session, turn ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, max(CASE WHEN kind = 'open' THEN live END) OVER (PARTITION BY session, turn) AS pinned, count(*) FILTER (kind = 'advance') OVER (PARTITION BY session, turn ORDER BY "at") AS taken FROM g)
    SELECT session, "at", kind, CASE WHEN turn > 0 AND closed = 0 THEN pinned END AS version, CASE WHEN turn > 0 AND closed = 0 THEN taken END AS steps, CASE WHEN turn > 0 AND closed = 0 THEN 'served' ELSE 'refused' END AS status FROM c""")
def stream_sessions_late(spark, sf):
    """Requests of sessions in three shuffled batches, answered as if they had come in order."""
    kind = F.when(F.col("event_id") % 7 == 0, "open").when(F.col("event_id") % 7 == 5, "close").when(F.col("event_id") % 7 == 3, "hidden").otherwise("advance")
    feeds = [f.select(F.col("user_id").cast("long").alias("session"), "ts", F.col("event_id").cast("long").alias("at"), kind.alias("kind"), F.floor(F.col("event_id") / 100).alias("live")) for f in in_batches(spark, sf)]
    feeds = with_last(feeds, {"session": "-1L", "ts": "TIMESTAMP '2100-01-01 00:00:00'", "kind": "'hidden'"})
    return followed(spark, "late", feeds, lambda s: session_state.served_late(s, "6 hours")).where("session >= 0")


@query("stream_chains_late", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j, (event_id % 4) AS x FROM events), h AS (SELECT user_id AS session, j, x + j AS entry FROM e WHERE x < 3 UNION ALL SELECT user_id, j, 7 + j FROM e WHERE j % 5 <> 4),
    c AS (SELECT DISTINCT session, j, entry FROM h), g AS (SELECT *, entry - j AS d, j - row_number() OVER (PARTITION BY session, entry - j ORDER BY j) AS island FROM c), r AS (SELECT session, j, row_number() OVER (PARTITION BY session, d, island ORDER BY j) AS run FROM g), m AS (SELECT session, j, max(run) AS length FROM r GROUP BY 1, 2)
    SELECT user_id AS session, e.j, coalesce(length, 0) AS length FROM e LEFT JOIN m ON m.session = user_id AND m.j = e.j""")
def stream_chains_late(spark, sf):
    """Chains of every user's events, from steps that come in three shuffled batches."""
    j = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    places = table(spark, sf, "events").select("event_id", j.cast("long").alias("j"))
    x = F.col("event_id") % 4
    hits = lambda f: f.join(places, "event_id").select(F.col("user_id").alias("session"), "ts", "j", F.array(x + F.col("j"), 7 + F.col("j")).alias("entries"), F.array(x < 3, F.col("j") % 5 != 4).alias("expected"))
    feeds = with_last([hits(f) for f in in_batches(spark, sf)], {"session": "-1L", "ts": "TIMESTAMP '2100-01-01 00:00:00'", "j": "0L", "entries": "array(0L)", "expected": "array(true)"})
    return followed(spark, "chains", feeds, lambda s: session_state.chain_lengths_late(s, "6 hours")).where("session >= 0")


@query("stream_resumed", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(*) AS held FROM events GROUP BY 1")
def stream_resumed(spark, sf):
    """Running totals of a stream that breaks off once its second batch of three is written, and goes on from its checkpoint.

    The totals are those of the sink; `held` is the count in the state that the checkpoint holds in the end.
    """
    scratch = Scratch(spark, "resumed")
    for feed in in_batches(spark, sf, "value"):
        feed.repartition(1).write.mode("append").parquet(f"{scratch.path}/in")
    schema = spark.read.parquet(f"{scratch.path}/in").schema

    def broken(df, batch):
        if batch == 1:
            raise RuntimeError("stopped")

    def run(then=None):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.path}/in")
        totals = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        sink = totals.writeStream.outputMode("update").foreachBatch(resume.once(f"{scratch.path}/out", then)).option("checkpointLocation", f"{scratch.path}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()

    try:
        run(broken)
    except Exception as e:
        if "stopped" not in str(e):
            raise
    run()
    held = resume.state_of(spark, f"{scratch.path}/checkpoint").select("user_id", F.col("count").alias("held"))
    return resume.latest(spark, f"{scratch.path}/out", ["user_id"]).join(held, "user_id").select("user_id", "n", F.round("total", 4).alias("total"), "held")


@query("log_round_trip", "SELECT doc_id, sha256(text) AS sha, lang, source, n_chars FROM documents")
def log_round_trip(spark, sf):
    """All documents written to a log, streamed from there in pages by offset into a second one, and read back."""
    log.register(spark)
    path = Scratch(spark, "log").path
    docs = documents(spark, sf)
    docs.write.format("tessera_log").mode("append").option("path", f"{path}/one").save()
    stream = spark.readStream.format("tessera_log").schema(docs.schema).option("path", f"{path}/one").option("pageRows", 500).load()
    stream.writeStream.format("tessera_log").option("path", f"{path}/two").option("writer", "copy").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.format("tessera_log").option("path", f"{path}/two").load()
    return back.select("doc_id", F.sha2("text", 256).alias("sha"), "lang", "source", "n_chars")
