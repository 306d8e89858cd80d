"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Each text has two collections of `tables` small hashes, each of `width` minhashes. A table key is a pair of one hash
from either collection, so that 2 * tables * width minhashes serve tables ** 2 tables. Two sets of similarity s share a
key unless all small hashes of a collection differ: with 9 tables of width 2 a link at 0.85 is missed with probability
2e-5, one at 0.9 with 6e-7.

Equal sets are one class from the start. Texts that share a key are joined to the key's smallest class, its head, never to
each other, and the components of these links, the clusters, hold every link. Links are then confirmed on full sets in two
ways. First, in clusters of more than two blocks, each text is held against one of its heads after the other, round by
round; what links is one group from then on. Near copies of one text end here, at a cost in proportion to their number.
Then, in clusters that are still several groups, all texts outside a cluster's largest group are compared with all of the
cluster, in blocks of bounded size (a cluster of less than two is one): a prefix filter over rare shingles finds partners,
full sets decide, and only the links that join two groups are emitted, so that the output never exceeds the number of texts.
This last part is the one whose work is not in proportion to the rows: texts that are close to a large group of near copies
and link with none of it meet all of it, a block at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, in_chunks, shingle_hashes, word_hashes

#: Production parameters of op8: words in a shingle, tables in each collection, minhashes in each small hash.
SHINGLE, TABLES, WIDTH = 5, 9, 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles in a block of a cluster; two blocks are in memory at once.
BLOCK = 1_000_000
#: Heads that a text is held against one by one at most, and texts that are held against one head in one task.
ROUNDS, SHARE = 4, 5_000
#: Tasks that the rows of one key are dealt over where they meet what is known of it.
SALTS = 8

SIGNATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("left", T.ArrayType(T.LongType())), T.StructField("right", T.ArrayType(T.LongType())),
])


def distinct_sets(texts: pa.Array, width: int):
    """Each text's distinct shingle hashes, sorted."""
    hashes, counts = shingle_hashes(*word_hashes(texts), width)
    stops = np.cumsum(counts)
    for start, stop in zip(stops - counts, stops, strict=True):
        own = np.sort(hashes[start:stop])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own


def minhashes(sets: list[np.ndarray], number: int) -> np.ndarray:
    """`number` minhashes of each set; sets must not be empty."""
    odd = np.random.RandomState(20240501).randint(0, 2**63 - 1, size=(number, 2), dtype=np.int64).astype(np.uint64)
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    at = np.cumsum(sizes) - sizes
    out = np.empty((number, len(sets)), np.uint64)
    for k, (a, b) in enumerate(odd):
        out[k] = np.minimum.reduceat((flat ^ a) * (b | np.uint64(1)), at)
    return out


def small_hashes(sets: list[np.ndarray], tables: int, width: int) -> np.ndarray:
    """Both collections: an array of texts by 2 * tables."""
    found = minhashes(sets, 2 * tables * width).reshape(2 * tables, width, -1)
    salt = np.arange(1, 2 * tables + 1, dtype=np.uint64)[:, None]
    out = np.zeros((2 * tables, found.shape[2]), np.uint64)
    for k in range(width):
        out = (out ^ found[:, k]) * np.uint64(0x9E3779B97F4A7C15) + salt
        out ^= out >> np.uint64(29)
    return out.T.view(np.int64)


def signatures(docs: DataFrame, tables: int, width: int, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in in_chunks([batch], "text"):
                sets = list(distinct_sets(part.column("text"), shingle))
                full = [i for i, s in enumerate(sets) if len(s)]
                digests = np.zeros((len(sets), 2), np.int64)
                hashes: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, small_hashes([sets[i] for i in full], tables, width), strict=True):
                        digests[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                        hashes[i] = row
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array([None if h is None else h[:tables] for h in hashes], pa.list_(pa.int64())),
                    pa.array([None if h is None else h[tables:] for h in hashes], pa.list_(pa.int64())),
                ], names=SIGNATURES.names)

    return docs.mapInArrow(run, SIGNATURES)


def enough(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], side: np.ndarray, percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that link, as a spanning forest: every link lies inside a tree. With sides, pairs of 0 with 1 only count.

    Sets of one of the `groups` are known to be in one tree, and no links among them are emitted.

    Two sets that link share a shingle among the rarest of either: with t = percent / 100, a set of n shingles can spare
    n - ceil(t n) of them. Postings over those prefixes give partners, full sets decide.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    out: list[tuple[int, int]] = []
    if n == 2 and groups is None:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if enough(np.int64(common), sizes[0], sizes[1], percent) else []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    order = np.empty(len(count), np.int64)
    order[np.argsort(count, kind="stable")] = np.arange(len(count))
    rank = order[token]
    postings: dict[int, list[int]] = {}
    forest, seen = Forest(n), np.zeros(len(count), bool)
    last: dict[int, int] = {}
    for i, group in enumerate(groups or ()):
        forest.join(i, last.setdefault(group, i))
    rare = int((count == 1).sum())  # ranks below have no partner
    for i in np.argsort(sizes, kind="stable").tolist():
        own = np.sort(rank[starts[i] : stops[i]])
        prefix = own[: sizes[i] - -(-percent * sizes[i] // 100) + 1]
        prefix = prefix[prefix >= rare].tolist()
        near = [postings[t] for t in prefix if t in postings]
        if near:
            found = np.unique(np.concatenate([np.array(x) for x in near]))
            found = found[100 * sizes[found] >= percent * sizes[i]]
            if side is not None:
                found = found[side[found] != side[i]]
            if len(found):
                seen[own] = True
                # Partners of one tree at a time count once: the first that links makes the rest needless.
                roots = np.array([forest.root(j) for j in found.tolist()])
                found, roots = found[roots != forest.root(i)], roots[roots != forest.root(i)]
                while len(found):
                    now, later = found[:256], found[256:]
                    flat = np.concatenate([seen[rank[starts[j] : stops[j]]] for j in now.tolist()])
                    common = np.add.reduceat(flat.astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                    for j in now[enough(common, sizes[i], sizes[now], percent)].tolist():
                        if forest.join(i, j):
                            out.append((i, j))
                    if len(later):
                        mine = forest.root(i)
                        later = later[np.array([forest.root(j) != mine for j in later.tolist()])]
                    found = later
                seen[own] = False
        for t in prefix:
            postings.setdefault(t, []).append(i)
    return out


def block_links(batches, percent: int):
    """Rows sorted by their block pair: links of each pair. A pair of blocks is in memory at a time."""
    key, ids, sides, groups, sets = None, [], [], [], []

    def close():
        if len(set(groups)) < 2:
            return None
        side = np.array(sides) if key[1] != key[2] else None
        found = links(sets, side, percent, groups)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"]) if found else None

    for batch in batches:
        cluster, first, second, side, cls, group = (batch.column(c).to_pylist() for c in ("cluster", "first", "second", "side", "cls", "group"))
        blob = batch.column("shingles")
        for k in range(batch.num_rows):
            now = (cluster[k], first[k], second[k])
            if now != key:
                if (done := close()) is not None:
                    yield done
                key, ids, sides, groups, sets = now, [], [], [], []
            ids.append(cls[k])
            sides.append(side[k])
            groups.append(group[k])
            sets.append(np.frombuffer(blob[k].as_buffer(), np.uint64).copy())
    if (done := close()) is not None:
        yield done


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """The sets of texts: cls, shingles (64-bit hashes in order)."""
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        for part in in_chunks(batches, "text"):
            sets = [s.tobytes() for s in distinct_sets(part.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(sets, pa.binary())], names=schema.names)

    return docs.select("cls", "text").mapInArrow(run, schema)


def held_against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets. Many texts share a b: it goes to each SHARE of them."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("shares"))
    dealt = pairs.join(shares, "b").select("a", "b", "shares", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    mine = sets.join(dealt.select(F.col("a").alias("cls"), "b", "share"), "cls").select(F.col("cls").alias("a"), "b", "share", "shingles")
    theirs = shares.select(F.col("b").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    theirs = sets.join(theirs, "cls").select(F.col("cls").alias("b"), "share", F.col("shingles").alias("other"))

    def run(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("shingles", "other"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(enough(np.int64(common), len(x), np.int64(len(y)), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mine.join(theirs, ["b", "share"]).select("a", "b", "shingles", "other").mapInArrow(run, "a long, b long")


def dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined to a table of a row for each key: rows of one key are dealt over SALTS tasks, and the table goes to each.

    The table grows with the rows, so that it is never broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    every = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def grouped(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """`members` (cluster, cls, n) of clusters that are not one group, with their group: cluster, cls, n, group."""
    if groups is None:
        found = members.select("cluster", "cls", "n", F.col("cls").alias("group"))
    else:
        found = members.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cluster", "cls", "n", F.coalesce("component", "cls").alias("group"))
    open_ = found.groupBy("cluster").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("cluster")
    return dealt_join(found, open_, ["cluster"], "left_semi")


def blocks_of(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Cut open clusters into blocks of about `block` shingles by size: members with block; what each block holds.

    The texts of a cluster's largest group have blocks below 0, all others from 0 on; a cluster below the bound is one
    block, 0. Sizes are counted per cluster, part and size, and a running sum over that histogram places each size; the
    members of one size spread over its share by a hash.
    """
    groups = members.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("held"))
    largest = groups.groupBy("cluster").agg(F.max(F.struct("texts", -F.col("group")))["col2"].alias("_most"), F.sum("held").alias("whole"))
    members = dealt_join(members, largest, ["cluster"]).withColumn("low", (F.col("group") == -F.col("_most")) & (F.col("whole") > 2 * block))
    sizes = members.groupBy("cluster", "low", "n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("cluster", "low").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("n")).over(before), F.lit(0)))
    own = F.floor((F.col("before") + F.pmod(F.xxhash64("cls"), F.col("c")) * F.col("n")) / F.lit(block)).cast("long")
    number = F.when(F.col("whole") <= 2 * block, F.lit(0).cast("long")).when(F.col("low"), -1 - own).otherwise(own)
    placed = dealt_join(members, sizes, ["cluster", "low", "n"]).withColumn("block", number)
    ranges = placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("texts"))
    return placed.select("cluster", "cls", "n", "group", "block"), ranges


def block_pairs(ranges: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks that can link: cluster, first (0 or more), second."""
    left = ranges.where("block >= 0").select("cluster", F.col("block").alias("first"), F.col("least").alias("least_1"), F.col("most").alias("most_1"), F.col("texts").alias("texts_1"))
    right = ranges.select("cluster", F.col("block").alias("second"), F.col("least").alias("least_2"), F.col("most").alias("most_2"))
    near = (100 * F.col("most_1") >= percent * F.col("least_2")) & (100 * F.col("most_2") >= percent * F.col("least_1"))
    each = (F.col("second") < 0) | (F.col("first") < F.col("second")) | ((F.col("first") == F.col("second")) & (F.col("texts_1") > 1))
    return left.join(right, "cluster").where(near & each).select("cluster", "first", "second")


def compared(placed: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of every pair of blocks, a pair in one task."""
    roles = pairs.select("cluster", "first", "second", F.explode(F.when(F.col("first") == F.col("second"), F.array(F.col("first"))).otherwise(F.array("first", "second"))).alias("block"))
    rows = sets.join(placed, "cls").join(roles, ["cluster", "block"]).withColumn("side", (F.col("block") == F.col("second")).cast("int"))
    dealt = rows.repartition("cluster", "first", "second").sortWithinPartitions("cluster", "first", "second", "cls")
    return dealt.select("cluster", "first", "second", "side", "cls", "group", "shingles")


def confirmed(scratch: Scratch, docs: DataFrame, classes: DataFrame, shared: DataFrame, percent: int, shingle: int, block: int) -> DataFrame | None:
    """The groups of linked classes, (node, component), among classes that share a key with a head: shared (a, b). None if none link."""
    clusters = components(scratch, shared, "shared")
    if clusters is None:
        return None
    members = scratch.save(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")).join(classes.select("cls", "n"), "cls"), "members")
    sets = scratch.save(full_sets(docs.join(members.select("cls"), F.col("doc_id") == F.col("cls")), shingle), "sets")
    whole = members.groupBy("cluster").agg(F.sum("n").alias("whole")).where(F.col("whole") > 2 * block).select("cluster")
    large = scratch.save(dealt_join(members, whole, ["cluster"], "left_semi"), "large")
    groups, open_, edges, tried = None, large, [], []
    for k in range(0 if large.isEmpty() else ROUNDS):
        mine = open_.select(F.col("cls").alias("a"), (F.col("group") if k else F.lit(0)).alias("group"))
        left = shared.join(mine, "a")
        if k:
            left = left.join(open_.select(F.col("cls").alias("b"), F.col("group").alias("other")), "b").where("group <> other")
        for old in tried:
            left = left.join(old, ["a", "b"], "left_anti")
        now = scratch.save(left.groupBy("a").agg(F.min("b").alias("b")), f"pairs{k}")
        if now.isEmpty():
            break
        tried.append(now)
        edges.append(scratch.save(held_against(now, sets, percent), f"links{k}"))
        groups = components(scratch, union(edges), f"groups{k}")
        open_ = scratch.save(grouped(large, groups), f"open{k}")
        if open_.isEmpty():
            break
    open_ = scratch.save(grouped(members, groups), "open")
    if open_.isEmpty():
        return groups
    placed, ranges = blocks_of(open_, block)
    placed, ranges = scratch.save(placed, "placed"), scratch.save(ranges, "ranges")
    last = compared(placed, block_pairs(ranges, percent), sets).mapInArrow(lambda batches: block_links(batches, percent), "a long, b long")
    return components(scratch, union([*edges, scratch.save(last, "last")]), "linked")


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, tables: int = TABLES, width: int = WIDTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a text's set is its distinct `shingle`-word shingles,
    a shorter text is one shingle, an empty or null text has none and links with nothing. Repeated rows stay, each with
    the same result. A null doc_id takes no part in links: its component is the class of equal sets that it belongs to,
    if that has an id, and it is not kept. An empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = scratch.save(signatures(docs, tables, width, shingle), "signatures")
    classes = scratch.save(
        found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")),
        "classes",
    )
    keys = classes.select("cls", F.posexplode("left").alias("i", "l"), "right").select("cls", "i", "l", F.posexplode("right").alias("j", "r")).select("cls", F.xxhash64("i", "l", "j", "r").alias("key"))
    heads = keys.groupBy("key").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head < last").select("key", "head")
    shared = keys.join(heads, "key").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    shared = scratch.save(shared, "shared")
    joined = confirmed(scratch, docs, classes, shared, percent, shingle, block)
    classes = classes.select("set_a", "set_b", "cls")
    if joined is not None:
        classes = classes.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select("set_a", "set_b", F.coalesce("component", "cls").alias("component"))
    else:
        classes = classes.select("set_a", "set_b", F.col("cls").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.join(classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle and their components by recursion: exact, and meant for small tables.
SQL = r"""
    WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM cut),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
    both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON b.x = r.other),
    found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN found USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
