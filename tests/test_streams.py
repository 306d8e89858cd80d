import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import resume, sessions
from tessera.streaming.ordered import GROUPS, presence, streaming_session
from tessera.streaming.sync import Ladder

T0 = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def followed(own, path, feeds, schema, run):
    """What each feed brings out, one start of the stream for each."""
    told = []
    for rows in feeds:
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = run(own.readStream.schema(schema).parquet(f"{path}/in"))
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        now = [tuple(r) for r in own.read.schema(found.schema).parquet(f"{path}/out").collect()]
        told.append(sorted(set(now) - {x for t in told for x in t}, key=repr))
        assert len(now) == len(set(now))
    return told


@pytest.fixture(scope="module")
def own(spark):
    return streaming_session(spark)


def test_silent_nodes_are_dropped_by_the_time_of_others(own, tmp_path):
    """b falls silent for good, c comes back; neither is dropped by a row of its own, and a is there to the end."""
    beats = {"a": range(0, 61, 5), "b": [0, 4], "c": [0, 30, 35]}
    rows = [(n, at(m)) for n, ms in beats.items() for m in ms] + [(None, at(3)), ("d", None)]
    random.Random(1).shuffle(rows)
    part = lambda low, high: [r for r in rows if r[1] is None or low <= (r[1] - T0).seconds // 60 < high]
    told = followed(own, str(tmp_path), [part(0, 11), part(11, 31), part(31, 99)], "node string, ts timestamp", lambda s: presence(s, "node", "ts", 3 * MINUTE, 3, "2 minutes"))
    micros = lambda m: int(at(m).replace(tzinfo=dt.UTC).timestamp() * 10**6)
    row = lambda n, first, last, count: (n, micros(first), micros(last), micros(last + 9), count)
    assert told == [[], [row("b", 0, 4, 2), row("c", 0, 0, 1)], [row("c", 30, 35, 2)]]


def requests(rows):
    return [(s, at(m), k, kind, live) for s, m, k, kind, live in rows]


REQUEST = "session long, ts timestamp, at long, kind string, live long"


def test_late_requests_are_put_in_order(own, tmp_path):
    """A request that comes a batch late still counts where it belongs; one beyond the lateness is left out."""
    feeds = [
        requests([(1, 0, 0, "open", 7), (1, 20, 3, "close", None), (1, 10, 2, "advance", None)]),
        requests([(1, 12, 9, "advance", None), (2, 30, 4, "open", 8), (1, 25, 5, "advance", None)]),
        requests([(1, 1, 1, "advance", None), (-1, 500, 6, "hidden", None)]),
    ]
    told = followed(own, str(tmp_path), feeds, REQUEST, lambda s: sessions.served_late(s, "10 minutes"))
    rows = [x for t in told for x in t if x[0] > 0]
    assert sorted(rows, key=lambda r: r[1]) == [
        (1, 0, "open", 7, 0, "served"), (1, 2, "advance", 7, 1, "served"), (1, 3, "close", 7, 2, "served"),
        (2, 4, "open", 8, 0, "served"), (1, 5, "advance", None, None, "refused"), (1, 9, "advance", 7, 2, "served"),
    ]
    assert (1, 0, "open", 7, 0, "served") in told[0]  # what the watermark has passed doesn't wait for the end


def test_idle_sessions_expire(own, tmp_path):
    feeds = [requests([(1, 0, 0, "open", 7), (1, 5, 1, "advance", None), (2, 0, 2, "open", 7)]), requests([(2, 40, 3, "advance", None), (1, 200, 4, "advance", None)]), requests([(-1, 900, 5, "hidden", None)])]
    told = followed(own, str(tmp_path), feeds, REQUEST, lambda s: sessions.served_late(s, "10 minutes", idle=60 * MINUTE))
    rows = {x for t in told for x in t}
    assert {(1, None, "expired", 7, 1, "expired"), (2, None, "expired", 7, 1, "expired"), (1, 4, "advance", None, None, "refused")} <= rows and len(rows) == 7


def test_what_waits_follows_the_lateness(own, tmp_path):
    """A long session holds the rows of the last minutes alone."""
    feeds = [requests([(1, 100 * b + k, 100 * b + k, "open" if b == k == 0 else "advance", 1) for k in range(100)]) for b in range(4)]
    followed(own, str(tmp_path), feeds, REQUEST, lambda s: sessions.served_late(s, "10 minutes"))
    waiting = own.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(f"{tmp_path}/checkpoint")
    assert 9 <= waiting.count() <= 11


def test_many_keys_share_groups(own, tmp_path):
    """State is called for by groups of keys, of which there are no more when keys are many; every key is still its own."""
    keys = 3 * GROUPS
    feeds = [requests([(s, s % 7 + k, k, kind, s) for s in range(keys) for k, kind in enumerate(("open", "advance"))]), requests([(s, 40, 2, "close", None) for s in range(keys)] + [(-1, 500, 3, "hidden", None)])]
    told = followed(own, str(tmp_path), feeds, REQUEST, lambda s: sessions.served_late(s, "10 minutes"))
    assert {x for t in told for x in t if x[0] >= 0} == {(s, k, kind, s, min(k, 1), "served") for s in range(keys) for k, kind in enumerate(("open", "advance", "close"))}
    timers = own.read.format("statestore").option("stateVarName", "timer").load(f"{tmp_path}/checkpoint")
    assert timers.count() <= GROUPS


def test_chains_of_late_steps(own, tmp_path):
    r = random.Random(4)
    rows = [(s, at(j), j, [j % 3 + j, 7 + j], [r.random() < 0.7, r.random() < 0.7]) for s in (1, 2) for j in range(60)]
    placed = [(min(2, max(0, (x[2] + r.randrange(-8, 9)) // 20)), r.random(), x) for x in rows]
    feeds = [[x for _, _, x in sorted(p for p in placed if p[0] == b)] for b in range(3)]
    feeds[2].append((-1, at(5000), 0, [0], [True]))
    schema = "session long, ts timestamp, j long, entries array<long>, expected array<boolean>"
    told = followed(own, str(tmp_path), feeds, schema, lambda s: sessions.chain_lengths_late(s, "90 minutes"))
    want, chains = set(), {1: {}, 2: {}}
    for s, _, j, entries, expected in rows:
        chains[s] = {e: chains[s].get(e - 1, 0) + 1 for e, ok in zip(entries, expected, strict=True) if ok}
        want.add((s, j, max(chains[s].values(), default=0)))
    assert {x for t in told for x in t if x[0] > 0} == want


def test_a_broken_stream_goes_on_without_repeats(spark, tmp_path):
    """A sink that breaks once a batch is written gets that batch again, which replaces itself."""
    for b in range(3):
        spark.range(10 * b, 10 * b + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def run(path, stop):
        def then(df, batch):
            seen.append(batch)
            if batch == stop:
                raise RuntimeError("stopped")

        counted = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select((F.col("id") % 4).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        counted.writeStream.outputMode("update").foreachBatch(resume.once(f"{path}/out", then)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run(tmp_path / "a", 1)
    assert seen == [0, 1]
    run(tmp_path / "a", None)
    assert seen == [0, 1, 1, 2]
    run(tmp_path / "b", None)
    rows = lambda p: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{p}/out").collect())
    assert rows("a") == rows("b") and len(rows("a")) == 12
    assert {r["k"]: r["n"] for r in resume.latest(spark, f"{tmp_path}/a/out", ["k"]).collect()} == {0: 8, 1: 8, 2: 7, 3: 7}
    assert {r["k"]: r["count"] for r in resume.state_of(spark, f"{tmp_path}/a/checkpoint").collect()} == {0: 8, 1: 8, 2: 7, 3: 7}


def test_a_ladder_goes_on_where_it_broke(spark, tmp_path):
    """A ladder that dies between a version's files and its gates writes that version once when it is started anew."""
    feed = lambda rows: spark.createDataFrame(rows, "document_id string, partition_index int, text string, op string").withColumn("sha", F.sha2("text", 256)).select("document_id", "partition_index", "text", "sha", "op")
    batches = [feed([("a", 0, "one", "deposit"), ("b", 0, "two", "deposit")]), feed([("b", 0, "TWO", "deposit"), ("c", 0, "three", "deposit")]), feed([("a", 0, "", "withdraw")])]
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")

    def run(path, stop):
        ladder = Ladder(spark, f"{path}/ladder", buckets=4)
        check = ladder.checked

        def checked(feed_, version, last):
            if version == stop:
                raise RuntimeError("stopped")
            return check(feed_, version, last)

        ladder.checked = checked
        stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
        ladder.follow(stream, f"{path}/checkpoint").awaitTermination()
        return ladder

    with pytest.raises(Exception, match="stopped"):
        run(tmp_path / "a", 1)
    assert Ladder(spark, f"{tmp_path}/a/ladder", buckets=4).live() == 0
    one, two = run(tmp_path / "a", None), run(tmp_path / "b", None)
    told = [sorted(map(tuple, x.batches().collect())) for x in (one, two)]
    assert told[0] == told[1] and [r[1] for r in told[0]] == [0, 1, 2]
    for v in range(3):
        assert sorted(map(tuple, one.index(v).collect())) == sorted(map(tuple, two.index(v).collect()))
