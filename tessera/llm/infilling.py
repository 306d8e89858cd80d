"""Fill-in-middle: documents cut in three, and put together so that a model learns to write the middle.

One pass over a whole Arrow batch finds every row's cuts: a table gives each UTF-8 byte its class, a mask over neighbouring
bytes marks where tokens begin, its cumulative sum, taken back to nothing at each text's start, counts them, and one binary
search over the sums finds the two cuts of all rows at once. White space is ASCII and bytes of longer code points are all of
one class, so that no cut falls into a code point. The three parts are slices of the batch's own buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SOLID, in_chunks, text_bytes

#: Production parameters of op13: the seed, and of 100 documents how many are cut, of 100 of these how many begin with the suffix.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: What stands before the prefix, the suffix and the middle: "<", a letter, ">".
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def numbers(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that a document draws: the first 8-digit groups of sha256 of `seed:key`. A null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marks(data: np.ndarray) -> np.ndarray:
    """Byte positions of sentinels."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    letter = (data[1:-1] == ord(PREFIX[1])) | (data[1:-1] == ord(SUFFIX[1])) | (data[1:-1] == ord(MIDDLE[1]))
    return np.flatnonzero((data[:-2] == ord("<")) & letter & (data[2:] == ord(">")))


def sliced(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings between neighbouring positions, without a copy."""
    kind, make = (np.int32, pa.StringArray) if len(data) < 2**31 else (np.int64, pa.LargeStringArray)
    return make.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, kind)), pa.py_buffer(np.ascontiguousarray(data)))


def inside(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a found position; sentinels that reach over a text's end are not in it."""
    own = np.searchsorted(at, found, "right") - 1
    held = np.zeros(len(at) - 1, bool)
    held[own[found + 3 <= at[own + 1]]] = True
    return held


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of tokens, and the byte positions of its two cuts.

    A token is white space and the word behind it, or the white space that ends a text: tokens begin at a text's start and
    where white space follows a word.
    """
    solid = SOLID[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = solid[:-1] & ~solid[1:]
    begins[at[:-1][np.diff(at) > 0]] = True
    total = np.cumsum(begins, dtype=np.int64)
    before = np.concatenate([[0], total])[at]
    n = np.diff(before)
    a, b = h1 % (n + 1), h2 % (n + 1)
    units = np.stack([np.minimum(a, b), np.maximum(a, b)])
    places = np.searchsorted(total, before[:-1] + units + 1)
    first, second = np.where(units < n, places, at[1:])
    return n, first, second


def cut_up(df: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts the text's tokens. form is `plain` (output is the text) for an empty text, one that holds a sentinel, and for
    those that the draw leaves whole; else `psm` or `spm`, by which part comes first. A null text is an empty one. Repeated
    rows give equal rows; a null id draws as an empty one; other columns are ignored; an empty table gives no rows. A task
    holds a few batches of texts, or one text where it is longer.
    """
    schema = T.StructType([
        T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])

    def run(batches):
        for batch in in_chunks(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            n, first, second = cuts(data, at, h1, h2)
            whole = (n == 0) | inside(marks(data), at) | (h3 % 100 >= rate)
            first, second = (np.where(whole, at[:-1], x) for x in (first, second))
            parts = sliced(data, np.append(np.stack([at[:-1], first, second], 1).ravel(), at[-1]))
            prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
            plain, late = pa.array(whole), pa.array(h4 % 100 < suffix_first)
            joined = pc.binary_join_element_wise(pc.if_else(late, SUFFIX, PREFIX), pc.if_else(late, suffix, prefix), pc.if_else(late, PREFIX, SUFFIX), pc.if_else(late, prefix, suffix), MIDDLE, middle, "")
            output = pc.if_else(plain, suffix, joined)
            lengths = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            form = pc.if_else(plain, "plain", pc.if_else(late, "spm", "psm"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), form, *lengths, output.cast(pa.string())], names=schema.names)

    draws = [h.alias(f"h{k}") for k, h in enumerate(numbers(F.col(id_col), seed), 1)]
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *draws).mapInArrow(run, schema)


def put_back(df: DataFrame, keep: list[str], form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The columns `keep`, and `restored`: the text that an output was made from.

    Its parts are what stands between the sentinels, which no cut text holds. A null output is restored to null, and so is
    one whose sentinels don't stand as its form says.
    """
    names = [f"_{k}" for k in range(len(keep))]
    fields = [T.StructField(x, df.schema[c].dataType) for x, c in zip(names, keep, strict=True)]
    schema = T.StructType([*fields, T.StructField("restored", T.StringType())])

    def run(batches):
        for batch in in_chunks(batches, "output"):
            data, at = text_bytes(batch.column("output"))
            form = batch.column("form").to_pylist()
            late, plain = np.array([f == "spm" for f in form]), np.array([f == "plain" for f in form])
            found = marks(data)
            low, high = np.searchsorted(found, at[:-1]), np.searchsorted(found, at[1:] - 2)
            three = np.append(found, [0, 0, 0])[np.minimum(low[:, None] + np.arange(3), len(found) + 2)]
            letters = data[np.minimum(three + 1, max(len(data) - 1, 0))] if len(data) else np.zeros_like(three)
            wanted = np.where(late[:, None], [ord(x[1]) for x in (SUFFIX, PREFIX, MIDDLE)], [ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)])
            good = (high - low == 3) & (three[:, 0] == at[:-1]) & (letters == wanted).all(1) & np.array([f in ("spm", "psm") for f in form])
            three = np.where(good[:, None], three, at[:-1, None] - np.array([3, 0, 0]))
            edges = np.stack([at[:-1], three[:, 0] + 3, three[:, 1], np.where(good, three[:, 1] + 3, three[:, 1]), three[:, 2], np.where(good, three[:, 2] + 3, three[:, 2])], 1)
            pieces = sliced(data, np.append(edges.ravel(), at[-1]))
            one, two, last = (pieces.take(pa.array(np.arange(k, len(pieces), 6))) for k in (1, 3, 5))
            turned = pa.array(late)
            text = pc.binary_join_element_wise(pc.if_else(turned, two, one), last, pc.if_else(turned, one, two), "")
            text = pc.if_else(pa.array(good | plain), text, pa.scalar(None, text.type))
            text = pc.if_else(pc.is_valid(batch.column("output")), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), text.cast(pa.string())], names=schema.names)

    found = df.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(names, keep, strict=True)], F.col(form_col).alias("form"), F.col(output_col).alias("output"))
    return found.mapInArrow(run, schema).toDF(*keep, "restored")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut_up(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("output_sha256", F.sha2("output", 256))
    back = put_back(made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
    return back.select(*back.columns[:-1], F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
