"""Document quality by histogram gradient-boosted trees over statistics of the text.

The statistics are counts and shares of a whole text, computed for many texts at once from its bytes; ids, labels,
languages and sources are no inputs. Training bins each statistic at quantiles and grows trees of fixed depth from
histograms of gradients on the driver, over a bounded sample of labelled rows; every other count covers all rows. A model
is three flat arrays, (trees, nodes) each, that numpy walks for a batch of texts level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_chunks, map_batches, mix, shingle_hashes, text_bytes, word_hashes, word_spans

#: Production parameters of op7. SAMPLE bounds the labelled rows that training takes, in the order of a hash of their ids.
SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE = 20_000, 80, 4, 64, 0.15, 2.0
#: A score of at least this is a label 1.
THRESHOLD = 0.3

#: Byte classes that the statistics count.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "#$%&*@^~", "|", "\"'()[]{}<>/\\:;-_+=`"]
FEATURES = [
    "log_bytes", "log_words", "log_lines", *[f"class_{k}" for k in range(len(CLASSES))], "high", "rest",
    "mean_word", "long_words", "short_words", "distinct_words", "top_word", "distinct_shingles", "distinct_lines", "mean_line", "ended_lines", "capital_words", "closed_words",
]


def byte_classes() -> np.ndarray:
    out = np.full(256, len(CLASSES) + 1, np.int64)
    out[128:] = len(CLASSES)
    for k, members in enumerate(CLASSES):
        out[np.frombuffer(members.encode(), np.uint8)] = k
    return out


def distinct(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and how often its commonest occurs."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])))
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, owner[at], np.diff(np.append(at, len(values))))
    return np.bincount(owner[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text, as float64 rows. A null or empty text has zeros."""
    n = len(texts)
    data, at = text_bytes(texts)
    size = np.diff(at).astype(float)
    classes, table = len(CLASSES) + 2, byte_classes()
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * classes + table[data], minlength=n * classes).reshape(n, classes).astype(float)
    starts, ends = word_spans(data, at)
    words, sizes = word_hashes(texts)
    of = np.repeat(np.arange(n), sizes)
    length = (ends - starts).astype(float)
    last, first = table[data[ends - 1]], table[data[starts]]
    sums = lambda values: np.bincount(of, weights=values, minlength=n)
    kinds, most = distinct(of, words, n)
    shingles, per = shingle_hashes(words, sizes, 5)
    runs, _ = distinct(np.repeat(np.arange(n), per), shingles, n)
    # A line's hash sums its words' hashes by their place from the right, which is one running sum for the whole batch.
    breaks = np.cumsum(np.isin(data, (10, 13)))
    line = (breaks[starts] if len(starts) else np.zeros(0, np.int64)) + of
    fresh = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    stop = np.append(fresh[1:], len(line))
    lines, line_of = np.zeros(len(fresh), np.uint64), of[fresh]
    if len(fresh):
        place = (np.arange(len(line)) - np.repeat(fresh, stop - fresh)).astype(np.uint64)
        lines = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15)), fresh)
    kept, _ = distinct(line_of, lines, n)
    number = np.bincount(line_of, minlength=n).astype(float)
    ended = np.bincount(line_of, weights=np.isin(last[stop - 1], (5, 7, 8)) if len(fresh) else None, minlength=n)
    some, count, rows = np.maximum(size, 1), np.maximum(sizes, 1).astype(float), np.maximum(number, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(sizes), np.log1p(number), counts / some[:, None],
        sums(length) / count, sums(length > 12) / count, sums(length <= 3) / count, kinds / count, most / count,
        runs / np.maximum(per, 1), kept / rows, sizes / rows, ended / rows, sums(first == 1) / count, sums((last == 9) | (last == 7)) / count,
    ])


@dataclass
class Model:
    """Complete trees, flattened: node k has children 2k+1 and 2k+2; a row goes right where its value exceeds the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Boosted trees for the logistic loss. Without rows of both labels the model is the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if len(np.unique(y)) < 2:
        return Model(base, feature[:0], cut[:0], value[:0])
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    place = binned + np.arange(width) * bins
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            spot = ((node - first)[:, None] * (width * bins) + place).ravel()
            shape = (here, width, bins)
            g = np.cumsum(np.bincount(spot, np.repeat(slope, width), here * width * bins).reshape(shape), axis=2)
            h = np.cumsum(np.bincount(spot, np.repeat(bend, width), here * width * bins).reshape(shape), axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < 1) | (h_all - h < 1)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for k in range(here):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        total += value[t, leaf]
    return Model(base, feature, cut, value)


def held_out(id_col: str):
    """Whether a row's label is kept from training: crc32 of its id as text is a multiple of 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most `sample` labelled documents that are not held out; other columns are ignored.

    Of several labels of an id the lowest counts, of several texts of an id that with the least hash (then the least
    statistics), so that the model doesn't depend on how rows are dealt. Null texts count as empty; null ids, and labels other
    than 0 and 1, are left out. Without usable rows the model gives one half.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    marked = marked.where(~held_out("_id")).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_label", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for part in in_chunks(batches, "_text"):
            x = statistics(part.column("_text"))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label").cast(pa.int32()), part.column("_hash"), pa.array(list(x), pa.list_(pa.float64()))], names=schema.names)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # `chosen` has at most `sample` rows of two numbers.
    seen = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", F.xxhash64("_text").alias("_hash"), "_text").mapInArrow(run, schema)
    rows = seen.groupBy("_id", "_label").agg(F.min(F.struct("hash", "x")).alias("least")).collect()
    rows.sort(key=lambda r: r["_id"])
    x = np.array([r["least"]["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r["_label"] for r in rows], float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """`docs` with all its columns and `name`, from 0 to 1: how likely label 1 is; a column of that name is replaced.

    Null texts count as empty, repeated rows stay, equal texts have equal scores; an empty table gives no rows.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for part in in_chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(statistics(part.column(text_col))))], names=schema.names)

    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted (1 if score >= threshold, else 0).

    Equal texts have equal scores, whatever their other columns; repeated rows stay; a null id is not held out. An empty
    table gives no rows, and without usable labels every score is one half.
    """
    model = fit(docs, labels, sample, id_col, text_col, label_col)
    found = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
