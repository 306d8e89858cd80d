"""Incremental maintenance: deposits and withdrawals come in, versions that pass their gates go live."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import sha256
from tessera.operators import corpus, ledger, rules
from tessera.operators.bounds import few
from tessera.sources.layers import COMPRESSION, Layers
from tessera.sources.store import exists

#: Documents that travel to the partitions of the live version.
FEW_DOCUMENTS = 100_000
#: What an index keeps of a partition.
PARTITION = ["document_id", "partition_index", "text", "sha"]
#: Rows of one key in one batch: the first by these is taken.
SAME = ["sha", "inexact"]


def inexact() -> Column:
    """Whether a partition's digest is not that of its text, as 0 or 1."""
    return (F.col("sha") != sha256(F.col("text"))).cast("long").alias("inexact")


def touching(rows: DataFrame) -> DataFrame:
    """The documents of a feed or of spans, to pick their partitions: they travel to these while they are few."""
    return few(rows.select("document_id").distinct(), FEW_DOCUMENTS)


@dataclass
class Measured:
    """What a model trained on a version, or read with it, says; models are outside, so that it comes as tables.

    losses: (document_id, partition_index, loss), a row for each position, or for each partition of equal positions;
    spans: (document_id, partition_index, first, text), what answers to probes of changed facts quoted, from character
    `first` of a partition on; vocabulary and trunk: digests of what the version was made with.
    """

    losses: DataFrame | None = None
    spans: DataFrame | None = None
    vocabulary: str = ""
    trunk: str = ""


def unverified(spans: DataFrame, live: DataFrame) -> int:
    """Quoted spans that the partitions as they are now don't have there: other text, or no such partition."""
    now = live.select(*corpus.KEY, F.col("text").alias("_text"))
    found = spans.join(now, corpus.KEY, "left")
    same = F.substr("_text", F.col("first") + 1, F.length("text")) == F.col("text")
    return found.where(~F.coalesce(same, F.lit(False))).count()


@dataclass
class Ladder:
    """export, compare, plan, index, measure, gates, live: one batch of a feed after another.

    The store holds versions of the index that share their files, and a pointer to the live one: a batch writes the rows that
    it changes and reads the buckets that it touches. A version that fails a gate stays, held, and the old one goes on
    serving; the next batch starts from the live one, and `feeds` keeps what came in between, so that nothing of a held batch
    is lost. A batch that is replayed writes the same version again; once it is live there is nothing left of it to do.

    `build` makes the rows of an index from partitions, a partition's from that partition alone, and keeps their columns;
    `measure` says how a version does: it takes the index, the keys of added and changed partitions, and the version. Without
    one the index is its own model, which has memorised a partition if a row's digest is that of its text.
    """

    spark: SparkSession
    path: str
    floor: float = 0.9
    measure: Callable[[DataFrame, DataFrame, int], Measured] | None = None
    build: Callable[[DataFrame], DataFrame] | None = None
    vocabulary: str = ""
    trunk: str = ""
    train_fraction: float = 0.05
    buckets: int = 64

    def __post_init__(self):
        self.store = Layers(self.spark, f"{self.path}/index", self.buckets)

    def live(self) -> int | None:
        if not exists(self.spark, f"{self.path}/live"):
            return None
        return self.spark.read.parquet(f"{self.path}/live").agg(F.max_by("version", "batch")).first()[0]

    def index(self, version: int) -> DataFrame:
        return self.store.read(version)

    def gates(self) -> DataFrame:
        """Every version's gates: version, rule, passed."""
        return self.spark.read.parquet(f"{self.path}/gates")

    def batches(self) -> DataFrame:
        """What came of each batch that called for a version: batch, version (live after it), plan, added, changed, removed, partitions, passed."""
        told = [self.spark.read.parquet(f"{self.path}/{k}").drop("number") for k in ("live", "held") if exists(self.spark, f"{self.path}/{k}")]
        return reduce(DataFrame.unionByName, told)

    def since(self, batch: int, last: int | None) -> DataFrame:
        """The rows of this batch and of those since the live version, as they came."""
        return self.spark.read.parquet(f"{self.path}/feeds").where((F.col("number") <= batch) & (F.col("number") > (-1 if last is None else last)))

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table of the ladder, written once and read back."""
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def pending(self, feed: DataFrame, batch: int, last: int | None) -> DataFrame:
        """What this batch and those since the live version ask for, of each key and document the newest; a batch withdraws before it deposits.

        Key, op, sha, inexact, and the batch whose rows have the text: texts stay in the feeds. A batch with nothing before it
        and a row for each key is read as it is stored; of others the keys are put together once.
        """
        feed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{self.path}/feeds/number={batch}")
        rows = self.since(batch, last)
        alone = rows.groupBy(*corpus.KEY, "op").count().where("count > 1").isEmpty() and rows.select("number").distinct().count() <= 1
        rows = rows.select(*corpus.KEY, "op", "sha", inexact(), "batch")
        if alone:
            return rows
        gone = rows.where("op = 'withdraw'").groupBy("document_id").agg(F.max("batch").alias("_gone"))
        newest = Window.partitionBy(*corpus.KEY, "op").orderBy(F.desc("batch"), *SAME)
        whole = rows.join(gone, "document_id", "left").where("_gone IS NULL OR batch >= _gone OR op = 'withdraw'")
        return self.kept(whole.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select(rows.columns), f"pending/number={batch}")

    def deposits(self, wanted: DataFrame, batch: int, last: int | None) -> DataFrame:
        """The partitions of some pending deposits (key, batch), from the feeds.

        Feeds that have none of them are not read, and keys meet texts only where feeds have others too.
        """
        counts = {r["batch"]: r["count"] for r in wanted.groupBy("batch").count().collect()}  # a row for each batch since the live version
        rows = self.since(batch, last).where(F.col("number").isin(*counts) & (F.col("op") == "deposit"))
        if rows.count() > sum(counts.values()):
            rows = rows.join(wanted.select(*corpus.KEY, "batch"), [*corpus.KEY, "batch"], "left_semi")
            if rows.count() > sum(counts.values()):  # a batch has a key twice
                one = Window.partitionBy(*corpus.KEY, "batch").orderBy(*SAME)
                rows = rows.withColumn("inexact", inexact()).withColumn("_k", F.row_number().over(one)).where("_k = 1")
        return rows.select(*PARTITION)

    def now(self, asked: DataFrame, batch: int, last: int | None, docs: DataFrame) -> DataFrame:
        """The partitions of some documents as they are with the feed: key and text."""
        wanted = asked.where("op = 'deposit'").join(docs, "document_id", "left_semi")
        new = self.deposits(wanted, batch, last).select(*corpus.KEY, "text")
        if last is None:
            return new
        gone = asked.where("op = 'withdraw'").select("document_id").distinct()
        before = self.store.read(last, self.store.touched(docs)).select(*corpus.KEY, "text").join(docs, "document_id", "left_semi")
        return before.join(gone, "document_id", "left_anti").join(wanted.select(*corpus.KEY), corpus.KEY, "left_anti").unionByName(new)

    def changed(self, asked: DataFrame, batch: int, last: int | None) -> DataFrame:
        """What the feed changes, kept as a table: key, change, bucket, by how much the inexact partitions grow, and the batch of the text.

        Where there is a live version, the partitions that stay as they are in the feed's documents are there as well, with no change.
        """
        if last is None:
            found = asked.where("op = 'deposit'").select(*corpus.KEY, F.lit("added").alias("change"), "inexact", "batch")
        else:
            found = self.compared(asked, last)
        return self.kept(found.withColumn("bucket", self.store.bucket()), f"changes/number={batch}")

    def compared(self, asked: DataFrame, last: int) -> DataFrame:
        """The partitions of the feed's documents: key, change, by how much the inexact ones grow, the batch of the text, `want` and `kept`, the digest and whether there is one with the feed, and `was`, whether the live version's is inexact."""
        docs = touching(asked)
        old = self.store.read(last, self.store.touched(docs)).select(*corpus.KEY, F.col("sha").alias("_old"), inexact().alias("was")).join(docs, "document_id", "left_semi")
        gone = asked.where("op = 'withdraw'").select("document_id").distinct().withColumn("_gone", F.lit(True))
        new = asked.where("op = 'deposit' AND document_id IS NOT NULL").select(*corpus.KEY, F.col("sha").alias("_new"), F.col("inexact").alias("_is"), "batch")
        met = old.join(gone, "document_id", "left").join(new, corpus.KEY, "full_outer")
        comes, stays = F.col("batch").isNotNull(), F.col("_gone").isNull()
        met = met.withColumn("want", F.when(comes, F.col("_new")).when(stays, F.col("_old"))).withColumn("_is", F.when(comes, F.col("_is")).when(stays, F.col("was")))
        change = F.when(F.col("_old").isNull(), "added").when(F.col("want").isNull(), "removed").when(F.col("_old") != F.col("want"), "changed")
        more = F.coalesce("_is", F.lit(0)) - F.coalesce("was", F.lit(0))
        return met.select(*corpus.KEY, change.alias("change"), more.alias("inexact"), "batch", "want", (comes | stays).alias("kept"), "was")

    def checked(self, asked: DataFrame, version: int, last: int | None) -> tuple[int, int, int]:
        """What a reader of the version finds of the feed's documents: rows that differ, rows of withdrawn documents, inexact rows beyond those of the live version."""
        if last is None:  # all that the version has is the feed's
            now, after, was = self.store.read(version).select(*corpus.KEY, "sha", inexact()), asked.where("op = 'deposit'").select(*corpus.KEY, F.col("sha").alias("_want")), 0
        else:
            docs, found = touching(asked), self.spark.read.parquet(f"{self.path}/changes/number={version}")
            now = self.store.read(version, self.store.touched(docs)).select(*corpus.KEY, "sha", inexact()).join(docs, "document_id", "left_semi")
            after, was = found.where("kept").select(*corpus.KEY, F.col("want").alias("_want")), found.agg(F.sum("was")).first()[0] or 0
        # A document that the feed withdraws and deposits anew is wanted; one that it only withdraws must not be indexed.
        gone = asked.groupBy("document_id").agg(F.bool_and(F.col("op") == "withdraw").alias("_gone")).where("_gone")
        met = now.join(gone, "document_id", "left").join(after, corpus.KEY, "full_outer")
        differs = ~F.coalesce(F.col("sha") == F.col("_want"), F.lit(False))
        told = met.agg(F.count_if(differs), F.count_if(F.coalesce(F.col("_gone"), F.lit(False)) & F.col("sha").isNotNull()), F.coalesce(F.sum("inexact"), F.lit(0))).first()
        return told[0], told[1], told[2] - was

    def sync(self, feed: DataFrame, batch: int) -> None:
        """feed: (document_id, partition_index, text, sha, op), op `deposit` or `withdraw`."""
        last = self.live()
        asked = self.pending(feed, batch, last)
        change = self.changed(asked, batch, last).where("change IS NOT NULL")
        kinds = ("added", "changed", "removed")
        found = change.groupBy("bucket").agg(*[F.count_if(F.col("change") == c).alias(c) for c in kinds], F.sum("inexact").alias("inexact")).collect()  # a row for each bucket
        added, altered, removed = (sum(r[c] for r in found) for c in kinds)
        buckets = self.store.manifest(last)[0] if last is not None else []
        rows = sum(x.rows for x in buckets) + added - removed
        counts = self.spark.createDataFrame([(added, altered, removed)], "added long, changed long, removed long")
        plan = counts.select(corpus.update_plan(counts, F.lit(rows), F.lit(last is not None), self.train_fraction).alias("plan")).first()["plan"]
        if plan == "none":
            return
        touched = change.where("change <> 'removed'").select(*corpus.KEY)
        new = self.deposits(change.where("change <> 'removed'"), batch, last)
        marks = change.where("change <> 'added'").select(*corpus.KEY)
        grown = {r["bucket"]: (r["added"] - r["removed"], r["added"] + 2 * r["changed"] + r["removed"], (r["inexact"],)) for r in found}
        self.store.commit(batch, last, self.build(new) if self.build else new, marks, grown)
        strays, leaked, more = self.checked(asked, batch, last)
        said = self.measure(self.index(batch), touched, batch) if self.measure else Measured(None, None, self.vocabulary, self.trunk)
        learned = said.losses.agg(ledger.memorised_share(F.col("loss"))).first()[0] if said.losses is not None else 0.0
        if not self.measure:
            learned = 1 - (sum(x.sums[0] for x in buckets if x.sums) + more) / rows
        bad = 0
        if said.spans is not None:
            spans = self.kept(said.spans, f"spans/number={batch}")
            bad = unverified(spans, self.now(asked, batch, last, touching(spans)))
        kind = "train" if "train" in plan else "reindex"
        row = self.spark.createDataFrame(
            [(batch, kind, float(learned or 0.0), said.vocabulary, self.vocabulary, said.trunk, self.trunk, leaked, bad, strays)],
            "version long, kind string, memorised double, vocabulary string, expected_vocabulary string, trunk string, expected_trunk string, leaked long, unverified long, strays long",
        )
        verdicts = rules.promotion_gates(row, self.floor)
        verdicts.write.mode("overwrite").parquet(f"{self.path}/gates/number={batch}")
        passed = rules.qualifies(verdicts, ["version"]).first()["qualifies"]
        state = self.spark.createDataFrame(
            [(batch, batch if passed else last, plan, added, altered, removed, rows, bool(passed))],
            "batch long, version long, plan string, added long, changed long, removed long, partitions long, passed boolean",
        )
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{'live' if passed else 'held'}/number={batch}")

    def follow(self, feed: DataFrame, checkpoint: str):
        """The ladder over a stream of feed files; the checkpoint makes it resume where it stopped."""
        return feed.writeStream.foreachBatch(lambda df, k: self.sync(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Throttle:
    """At most so many nodes sync at once; one is done when it has settled after it was sent."""

    waiting: deque[str]
    at_once: int = 0
    flying: dict[str, list] = field(default_factory=dict)  # name: versions when sent, whether seen busy
    done: list[str] = field(default_factory=list)

    def advance(self, states: dict[str, dict]) -> list[str]:
        """states: versions, busy, stopped (held or failed) of each node. Returns the nodes to send now."""
        for name in sorted(self.flying):
            state, flight = states.get(name), self.flying[name]
            if not state:
                continue
            if state["busy"]:
                flight[1] = True
            elif state["versions"] > flight[0] or state["stopped"] or flight[1]:
                del self.flying[name]
                self.done.append(name)
        send = []
        while self.waiting and (self.at_once <= 0 or len(self.flying) < self.at_once):
            name = self.waiting.popleft()
            self.flying[name] = [states.get(name, {}).get("versions", 0), False]
            send.append(name)
        return send
