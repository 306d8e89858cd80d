"""Versions of a keyed table that share their files: a version is a manifest of immutable layers, bucket by bucket.

Rows lie in buckets by a hash of their document. A commit writes the rows that are new or changed as a layer, and the keys that
it replaces or removes as marks; buckets that nothing touched keep the files that they have. A bucket whose layers have grown
beyond a share of it, or become many, is written whole again, so that what a reader passes over stays in proportion.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import StoreError, exists

KEY = ["document_id", "partition_index"]
#: Marks that travel to the rows when a version is read; the manifest knows how many there are at most.
FEW_MARKS = 200_000
#: Texts are written several times, and come to a third less than by Spark's default.
COMPRESSION = "zstd"

MANIFEST = T.StructType([
    T.StructField("bucket", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("layers", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType())),
    T.StructField("rows", T.LongType()), T.StructField("layered", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("schema", T.StringType()),
])


@dataclass(frozen=True)
class Bucket:
    """A bucket in one version: the commit that wrote it whole, the layers and marks since, its live rows, rows and marks in layers, and sums that the caller keeps."""

    base: int | None = None
    layers: tuple[int, ...] = ()
    marks: tuple[int, ...] = ()
    rows: int = 0
    layered: int = 0
    sums: tuple[int, ...] = ()


@dataclass
class Layers:
    """A store of versions. `buckets` is fixed when the first version is written; the driver holds a row for each.

    `share` is what the layers of a bucket may come to of its rows, `most` about how many layers it may have.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    share: float = 0.25
    most: int = 24
    known: dict[int, tuple[list[Bucket], T.StructType]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def manifest(self, version: int) -> tuple[list[Bucket], T.StructType]:
        """The buckets of a version in their order, and the schema of its rows."""
        if version not in self.known:
            if not exists(self.spark, f"{self.path}/manifests/version={version}"):
                raise StoreError(f"no version {version} in {self.path}")
            rows: list[Row] = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/version={version}").orderBy("bucket").collect()
            self.known[version] = [Bucket(r["base"], tuple(r["layers"]), tuple(r["marks"]), r["rows"], r["layered"], tuple(r["sums"])) for r in rows], T.StructType.fromJson(json.loads(rows[0]["schema"]))
        if len(self.known[version][0]) != self.buckets:
            raise StoreError(f"{self.path} has {len(self.known[version][0])} buckets, not {self.buckets}")
        return self.known[version]

    def _files(self, kind: str, named: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        """The files of (commit, bucket) pairs of one kind: their rows, with `written`, the commit."""
        schema = T.StructType([*schema.fields, T.StructField("written", T.LongType()), T.StructField("bucket", T.IntegerType())])
        if not named:
            return self.spark.createDataFrame([], schema).drop("bucket")
        root = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/written={w}/bucket={b}" for w, b in sorted(named)]).drop("bucket")

    def read(self, version: int, only: set[int] | None = None) -> DataFrame:
        """A version's live rows, of the buckets `only` if given: those that no later mark of the version names."""
        buckets, schema = self.manifest(version)
        chosen = [(b, x) for b, x in enumerate(buckets) if only is None or b in only]
        rows = self._files("bases", [(x.base, b) for b, x in chosen if x.base is not None], schema)
        layered = [(w, b) for b, x in chosen for w in x.layers]
        if layered:
            rows = rows.unionByName(self._files("layers", layered, schema))
        marked = [(w, b) for b, x in chosen for w in x.marks]
        if not marked:
            return rows.drop("written")
        marks = self._files("marks", marked, T.StructType([schema[k] for k in KEY])).groupBy(*KEY).agg(F.max("written").alias("_marked"))
        if sum(x.layered for _, x in chosen) <= FEW_MARKS:
            marks = F.broadcast(marks)  # rows stay where they are
        return rows.join(marks, KEY, "left").where("_marked IS NULL OR written >= _marked").select(*schema.names)

    def touched(self, docs: DataFrame) -> set[int]:
        """The buckets of documents."""
        return {r["b"] for r in docs.select(self.bucket().alias("b")).distinct().collect()}

    def _write(self, df: DataFrame, kind: str, version: int) -> set[int]:
        """Rows as files of a commit, one for each bucket or for each part of a large one; the buckets that have any. A commit that is written again is replaced."""
        target = f"{self.path}/{kind}/written={version}"
        df.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket")).write.mode("overwrite").option("compression", COMPRESSION).partitionBy("bucket").parquet(target)
        fs, path = self._fs(target)
        return {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}

    def _fs(self, target: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def commit(self, version: int, parent: int | None, rows: DataFrame, marks: DataFrame, counts: dict[int, tuple[int, int, tuple[int, ...]]]) -> None:
        """A version: its parent without the keys of `marks`, and with `rows`.

        `counts` has for each touched bucket by how much its live rows grow, how many rows and marks this commit has for it,
        and what is added to its sums. The manifest is written last, so that a commit that fails leaves no version.
        """
        schema = rows.schema
        before = self.manifest(parent)[0] if parent is not None else [Bucket()] * self.buckets
        after = list(before)
        whole = set()
        for b, (grown, written, sums) in counts.items():
            x = before[b]
            old = x.sums or (0,) * len(sums)
            after[b] = replace(x, rows=x.rows + grown, layered=x.layered + written, sums=tuple(s + t for s, t in zip(old, sums, strict=True)))
            if x.base is None or after[b].layered > self.share * after[b].rows or len(x.layers) >= self.most + b % self.most:
                whole.add(b)
        if parent is None:
            filled = self._write(rows, "bases", version)
            after = [replace(x, base=version if b in filled else None, layered=0) for b, x in enumerate(after)]
        else:
            with_rows, with_marks = self._write(rows, "layers", version), self._write(marks.select(*KEY), "marks", version)
            whole |= {b for b in with_rows if before[b].base is None}
            filled = set()
            if whole:
                kept = self.read(parent, whole).join(marks.where(self.bucket().isin(*whole)).select(*KEY), KEY, "left_anti").select(*schema.names)
                new = self._files("layers", [(version, b) for b in with_rows & whole], schema).select(*schema.names)
                filled = self._write(kept.unionByName(new), "bases", version)
            for b in range(self.buckets):
                if b in whole:
                    after[b] = replace(after[b], base=version if b in filled else None, layers=(), marks=(), layered=0)
                else:
                    after[b] = replace(after[b], layers=(*after[b].layers, *([version] if b in with_rows else [])), marks=(*after[b].marks, *([version] if b in with_marks else [])))
        told = json.dumps(schema.jsonValue())
        listed = [(b, x.base, list(x.layers), list(x.marks), x.rows, x.layered, list(x.sums), told) for b, x in enumerate(after)]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        self.known[version] = after, schema

    def retire(self, keep: set[int]) -> int:
        """Drops all versions but those of `keep`, and the files that none of these names. How many folders went."""
        named = set()
        for v in keep:
            for b, x in enumerate(self.manifest(v)[0]):
                named |= {("bases", x.base, b)} | {("layers", w, b) for w in x.layers} | {("marks", w, b) for w in x.marks}
        gone = 0
        for kind in ("bases", "layers", "marks"):
            if not exists(self.spark, f"{self.path}/{kind}"):
                continue
            fs, root = self._fs(f"{self.path}/{kind}")
            for commit in fs.listStatus(root):
                written = int(commit.getPath().getName().split("=")[1])
                for s in fs.listStatus(commit.getPath()):
                    name = s.getPath().getName()
                    if name.startswith("bucket=") and (kind, written, int(name.split("=")[1])) not in named:
                        fs.delete(s.getPath(), True)
                        gone += 1
        fs, root = self._fs(f"{self.path}/manifests")
        for s in fs.listStatus(root):
            if (v := int(s.getPath().getName().split("=")[1])) not in keep:
                fs.delete(s.getPath(), True)
                self.known.pop(v, None)
        return gone
