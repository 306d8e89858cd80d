"""Spelling variants: words one inserted, deleted or replaced code point apart, joined on their rarest bigrams.

All bigrams with their positions are put in one global order, rarest first. One edit touches two bigrams of a word at most, so
that of two near words each has one of the pair's common bigrams among its three first: only these are joined. The bigram's
position limits the join further. It keeps its place from the left if the edit lies to its right, and from the right if to its
left; what lies on its other side is the same in both words, and so is one half of what lies on the edit's side. Each of the
three thus becomes the windows of the word, a beginning and an end, that are whole if the edit lies in one half of one side;
the windows' hashes are the join's keys. Pairs that share one are few and are verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks, mix, settled_roots

#: Production parameters of op12: a word's least code points and occurrences, and how many times as common a form is.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
#: Of the occurrences one in so many loses a code point.
DAMAGED = 31
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rarest bigrams of each word: one edit touches two bigrams, and one more is left.
RAREST = 3
#: Bigrams are counted by this many numbers: one each for code points below 256, others share.
BIGRAMS = 1 << 16
#: Words in one step of the key kernel, in bytes.
KEY_BYTES = 1 << 18


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, or one in DAMAGED without a code point, by the unsigned crc32 of `doc_id:run`. A null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, change: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct words of the texts: word, n. Words are runs of letters, A-Z as a-z; `change` may alter each occurrence.

    Counts are summed before they are shuffled. Null texts have no words, repeated rows count as often as they occur. The
    runs of one text are an array until they become rows.
    """
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least_chars)
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    words = runs.select("doc_id", lower.alias("run"))
    words = words.select((change(F.col("doc_id"), F.col("run")) if change else F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and where each word starts and the last one ends."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)


def bigrams(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bigram inside a word: its number, the word, and its position in it."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(owner[:-1] == owner[1:])
    return (codes[first] * 256 + codes[first + 1]) % BIGRAMS, owner[first], first - at[owner[first]]


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How often each bigram number occurs in the distinct words: BIGRAMS numbers, whatever the table's size."""

    def run(batches):
        total = np.zeros(BIGRAMS, np.int64)
        for batch in in_chunks(batches, "word", KEY_BYTES):
            total += np.bincount(bigrams(*code_points(batch.column("word")))[0], minlength=BIGRAMS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counts = np.zeros(BIGRAMS, np.int64)
    for r in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["gram"]] = r["n"]
    return counts


def rarest(codes: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The RAREST bigrams of each word in the global order (count, number, position): the word and the position."""
    gram, owner, position = bigrams(codes, at)
    order = np.lexsort((position, gram, counts[gram], owner))
    owner, position = owner[order], position[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner[rank < RAREST], position[rank < RAREST]


def windows(length: np.ndarray, position: np.ndarray, total: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of bigrams at `position` in words of `length`, for pairs whose longer word has `total` code points.

    Each is (whether it is one, the bigram's place counted from the edit's far end, code points of the beginning, of the end).
    """
    right = total - position - 2
    half = right // 2
    tail = length - position
    left = total - tail
    part = left // 2
    none = np.zeros_like(position)
    return [
        (right >= 1, position, position + 2 + half, none),
        (half >= 1, position, position + 2, right - half),
        (part >= 1, tail, none, total - part),
        (left >= 1, tail, part, tail),
    ]


def keys(words: pa.Array, counts: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' join keys for pairs whose longer word is `longer` code points longer than the word: its number and the key."""
    codes, at = code_points(words)
    length = np.diff(at)
    place = np.arange(len(codes)) - np.repeat(at[:-1], length)
    back = np.repeat(length, length) - 1 - place
    value = codes.astype(np.uint64) << np.uint64(32)
    ahead, behind = (np.concatenate([[np.uint64(0)], np.cumsum(mix(mix(value + p.astype(np.uint64) + np.uint64(salt))), dtype=np.uint64)]) for p, salt in ((place, 1), (back, 1 << 31)))
    owner, position = rarest(codes, at, counts)
    total = length[owner] + longer
    found = []
    for k, (valid, where, begin, end) in enumerate(windows(length[owner], position, total)):
        o, b, e = owner[valid], begin[valid], end[valid]
        whole = mix(ahead[at[o] + b] - ahead[at[o]]) + mix(behind[at[o + 1]] - behind[at[o + 1] - e]) * np.uint64(3)
        form = ((total[valid] * 4 + k) << 40) + (where[valid] << 20)
        found.append((o, mix(whole + mix(form.astype(np.uint64)) + mix(b.astype(np.uint64) << np.uint64(32) | e.astype(np.uint64)))))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).view(np.int64)


def keyed(words: DataFrame, counts: np.ndarray, both: bool) -> DataFrame:
    """A row for each key: key, word, n, longer. `longer` tells keys of pairs with a word one code point longer; only if `both`."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("longer", T.BooleanType())])

    def run(batches):
        for batch in in_chunks(batches, "word", KEY_BYTES):
            for longer in (0, 1) if both else (0,):
                owner, key = keys(batch.column("word"), counts, longer)
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("word").take(own), batch.column("n").take(own), pa.array(np.full(len(key), longer == 1))], names=schema.names)

    return words.select("word", "n").mapInArrow(run, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: a, a_n, b, b_n. Words are distinct, non-null and of at least four code points."""
    counts = bigram_counts(words)
    one = keyed(words, counts, False).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    two = keyed(words, counts, True).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    met = one.join(two, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Of each word (word, n): its form, root, n, n_near and form_n.

    A word's form is its commonest near word (of several the smallest), if that is at least `times` as common; its root is
    where its forms lead. Words are distinct and have at least four code points, so that three bigrams stand for each. An
    empty table gives no rows.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", F.col("n").cast("long").alias("n")), "words")
    if not words.where(F.coalesce(F.length("word"), F.lit(0)) < RAREST + 1).isEmpty():
        raise ValueError(f"words need at least {RAREST + 1} code points")
    pairs = near_pairs(words)
    sides = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in (("a", "b"), ("b", "a"))]))
    near = pairs.select(sides.alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    best_n = -F.col("best.less")
    enough = best_n >= F.col("n") * times
    found = words.join(near, "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, best_n).alias("form_n"))
    found = scratch.save(found, "forms")
    roots = settled_roots(scratch, found.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("component")), "roots")
    led = found.join(roots.select(F.col("node").alias("word"), F.col("component").alias("root")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=damaged))


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2
), bits AS (
  SELECT run, c, hex(encode(doc_id || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_transform(range(len(x) * 4), lambda i: (('0x' || x[2 * (i // 8) + 1 : 2 * (i // 8) + 2])::BIGINT >> (i % 8)) & 1),
    lambda s, b: xor(s >> 1, xor(s & 1, b) * 3988292384), 4294967295)) AS h
  FROM bits
), words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2
), less AS (
  SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), met AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY b_n DESC, encode(b)) AS best, max(b_n) AS best_n FROM met GROUP BY a
), forms AS (
  SELECT word, CASE WHEN best_n >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON a = word
), led AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, l.root FROM led l JOIN forms f ON f.form = l.word
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON l.word = f.word
"""
