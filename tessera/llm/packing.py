"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Documents of a window or more are first cut into full windows; what is left of each is placed, longest first, into the
open window with the least room that still holds it. Lengths are whole numbers below the window, so that the global
order of best-fit decreasing depends on nothing but how many pieces have each length. The driver plans with that
histogram (at most `window` numbers, however large the table) and a segment tree over remaining capacity; each plan row
covers a run of equal pieces, and the pieces take their places by their rank within their length, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks, ranked

#: Production parameters of op5.
WINDOW = 1024
VOCABULARY = "byte_bpe_50k"
END_ID = 0

PLAN = T.StructType([
    T.StructField("length", T.IntegerType(), False),
    T.StructField("first_rank", T.LongType(), False),
    T.StructField("last_rank", T.LongType(), False),
    T.StructField("per_sequence", T.LongType(), False),
    T.StructField("first_sequence", T.LongType(), False),
    T.StructField("room", T.IntegerType(), False),
])


def tokenizer_paths(name: str = VOCABULARY) -> tuple[str, str, str]:
    """A byte-level BPE's tokenizer file, the same vocabulary as ranks, and the pattern that cuts texts for it."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Ids of `tokenizers` for one vocabulary, without special tokens added.

    The ranks give the same ids several times faster. A text that names a special token goes to the tokenizer itself,
    which reads such a name as that token, and so does a text with characters beyond those in which both cut alike.
    """

    def __init__(self, paths: tuple[str, str, str]):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(paths[0])
        self.special = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=paths[2], mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if any(s in text for s in self.special) or not plain(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def plain(text: str) -> bool:
    """Whether every character lies below U+3400, where both tokenizers know the same letters, digits and spaces."""
    if text.isascii():
        return True
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool((codes < 0x3400).all())


def pieces_of(ids: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, len(ids), window):
        yield start, ids[start : start + window]


def cut(docs: DataFrame, window: int, paths: tuple[str, str, str], end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: full windows, and what is left of each document."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])

    def run(batches):
        encode = Encoder(paths)
        for batch in in_chunks(batches, "text"):
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], np.uint32)
                for start, own in pieces_of(ids, window):
                    owner.append(i)
                    rows.append((start, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(ids), own if keep_ids else None))
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int32())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]
            if keep_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacity: open windows by room, and the tightest room that holds a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)
        self.runs: dict[int, list[list[int]]] = {}

    def mark(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """`count` windows from number `first` on have this room left."""
        if room and count:
            self.runs.setdefault(room, []).append([first, count])
            self.mark(room, True)

    def tightest(self, length: int) -> int | None:
        """The least room of an open window that is at least `length`."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` windows of one run with this room: first number, count."""
        run = self.runs[room][-1]
        first, count = run[0], min(most, run[1])
        run[0] += count
        run[1] -= count
        if not run[1]:
            self.runs[room].pop()
            if not self.runs[room]:
                self.mark(room, False)
        return first, count


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths, as rows of PLAN.

    A window that takes a piece of some length has less room than before, so that it stays the tightest as long as
    another such piece fits: equal windows each take as many equal pieces as they hold, run by run.
    """
    tree, rows, opened = CapacityTree(window), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            each = (room or window) // length
            if room is None:
                room, first, count = window, opened, -(-left // each)
                opened += count
            else:
                first, count = tree.take(room, -(-left // each))
            placed = min(left, each * count)
            rows.append((length, rank, rank + placed - 1, each, first, room))
            full = placed // each
            tree.add(room - each * length, first, full)
            tree.add(room - (placed - full * each) * length, first + full, count - full)
            rank, left = rank + placed, left - placed
    return rows


def pack(docs: DataFrame, window: int = WINDOW, paths: tuple[str, str, str] | None = None, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of `docs` into sequences of at most `window` ids; one row per piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens (with the end id),
    sequence_id (gapless from 0), offset (in the sequence, gapless from 0), and with `keep_ids` the ids themselves.
    A null or empty text has its end id alone. Repeated rows are packed as often as they occur, a null doc_id is kept,
    other columns are ignored. An empty table gives no rows. Equal lengths are ranked by document, start and checksum;
    which of two identical rows comes first does not show in the result. Sequences are to be padded to `window`.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut_up = scratch.save(cut(docs, window, paths or tokenizer_paths(), end_id, keep_ids, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(plan(histogram, window), PLAN)
    placed = ranked(cut_up, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "_rank", sum(histogram.values()))
    # The plan has a few rows for each length at most, whatever the size of the table.
    joined = placed.join(F.broadcast(places), (placed["length"] == places["length"]) & F.col("_rank").between(F.col("first_rank"), F.col("last_rank"))).drop(places["length"])
    at = F.col("_rank") - F.col("first_rank")
    return joined.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.lit(window) - F.col("room") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, from the rows of `pack` with their ids.

    A sequence has at most `window` ids, so its group is bounded. Pieces of repeated rows are pieces like others; null and
    empty texts are there by their end id; an empty table gives no rows.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
