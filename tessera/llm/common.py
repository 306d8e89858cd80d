"""Helpers that the training-data operators share: scratch tables, word hashing, ranking and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: Characters of text that one step of a vectorised pass takes at once; longer texts go alone.
CHUNK_CHARS = 1_500_000


def in_chunks(batches, column: str, limit: int = CHUNK_CHARS):
    """Cut Arrow batches so that no piece holds more than `limit` bytes of text, unless one text alone does."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` for columns of any name: Spark's own looks names with dots up as fields of structs."""
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(run, schema)
    return df.toDF(*[f"_{k}" for k in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Places in a word whose byte values are tabulated.
PLACES = 64


def place_value(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit number for a byte (A-Z as a-z) at a place of a word."""
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
    return mix(mix(place.astype(np.uint64) * np.uint64(256) + lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    place, byte = np.divmod(np.arange(PLACES * 256), 256)
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    return place_value(byte, place), solid


VALUES, SOLID = _tables()
BLOCK_BYTES = 1 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string array, and where each text starts and the last one ends. Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words `[^\\x20\\x09-\\x0D]+`; words don't reach from one text into the next."""
    solid = SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and each text's word count. Null is empty.

    A word's hash sums a number for each byte and its place, so that no two words collide by their form.
    """
    data, at = text_bytes(texts)
    starts, ends = word_spans(data, at)
    sizes = np.diff(np.searchsorted(starts, at))
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK_BYTES, "right")))
        low, high = starts[k], ends[stop - 1]
        begin, end = starts[k:stop] - low, ends[k:stop] - low
        own = data[low:high].astype(np.int64)
        place = np.arange(high - low) - np.repeat(begin, np.diff(np.append(begin, high - low)))
        far = np.flatnonzero(place >= PLACES) if int((end - begin).max()) > PLACES else place[:0]
        values = VALUES[np.minimum(place, PLACES - 1) * 256 + own]
        values[far] = place_value(own[far], place[far])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[k:stop] = sums[end] - sums[begin] + (end - begin).astype(np.uint64)
        k = stop
    return mix(out), sizes


def shingle_hashes(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words, text by text; a shorter non-empty text is one shingle. Repeats stay."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    out = np.zeros(int(counts.sum()), np.uint64)
    if not len(out):
        return out, counts
    run = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        run += words[k : k + len(run)] * factors[k]
    at = np.cumsum(counts) - counts
    long = np.flatnonzero(sizes >= width)
    if len(long):
        keep = np.zeros(len(run) + 1, np.int64)
        np.add.at(keep, starts[long], 1)
        np.add.at(keep, starts[long] + counts[long], -1)
        fill = np.zeros(len(out) + 1, np.int64)
        np.add.at(fill, at[long], 1)
        np.add.at(fill, at[long] + counts[long], -1)
        out[np.cumsum(fill[:-1]) > 0] = run[np.cumsum(keep[:-1]) > 0]
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        own = words[starts[i] : stops[i]]
        out[at[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), counts


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, rows: int, per_bucket: int = 100_000) -> DataFrame:
    """Gapless positions from 0 within each group, for groups of any size.

    A group is cut into hash buckets of about `per_bucket` rows, the bucket counts give each bucket's first
    position, and rows are numbered within buckets; no task holds a whole group. `rows` is the table's row count.
    """
    buckets = max(1, -(-rows // per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    within = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(within) - 1).join(firsts, same)
    return placed.withColumn(name, F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first", *[f"_f{i}" for i in range(len(keys))])


def settled_roots(scratch: Scratch, found: DataFrame, name: str) -> DataFrame:
    """Pointer doubling over (node, component): follow components until they are their own, in few rounds."""
    k = 0
    while True:
        found = scratch.save(found, f"{name}-{k}")
        up = found.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("_up"))
        if found.join(up, "component", "left_semi").isEmpty():
            return found
        found = found.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
        k += 1


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame | None:
    """Connected components of edges (a, b), both non-null: (node, component), component the smallest node reachable.

    Each round joins every node to its smallest neighbour, follows those links to their roots and contracts the graph,
    so rounds are few and the edge table shrinks. Every step is a table in the shared folder; the driver only learns
    whether edges are left. None if there is no edge.
    """
    current = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges0")
    found = None
    k = 0
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
        roots = settled_roots(scratch, nearest, f"{name}-roots{k}")
        left = roots.select(F.col("node").alias("a"), F.col("component").alias("_a"))
        right = roots.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        moved = current.join(left, "a").join(right, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        k += 1
        current = scratch.save(moved.where("a < b").distinct(), f"{name}-edges{k}")
        scratch.drop(f"{name}-edges{k - 1}")
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("component"), F.col("component").alias("_up"))
            found = found.join(step, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return found
