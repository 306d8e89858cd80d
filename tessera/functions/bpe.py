"""Byte-level pair encoding as functions over columns; a tokenizer file's path is a parameter.

Ids are those of the `tokenizers` library for that file, no special tokens added. A worker reads a file once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 for itself, the rest from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> dict[int, bytes]:
    """The bytes of every token; a token added by name is its name."""
    t, letters = tokenizer(path), byte_letters()
    added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    return {i: bytes(letters[c] for c in piece) for piece, i in t.get_vocab(with_added_tokens=False).items() if i not in added} | added


#: Characters that are encoded at once, about: the library keeps texts, offsets and marks of all tokens until it is done with them.
AT_ONCE = 1 << 18


def slices(texts: Iterable[str], most: int = AT_ONCE) -> Iterator[list[str]]:
    """Texts in order, as many at once as have `most` characters together, or one."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(path: str):
    """Ids of each text; null stays null, an empty text has none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        some = texts.dropna()
        ids = pd.Series(index=some.index, dtype=object)
        # An array has an eighth of a list's size.
        ids[:] = [np.array(e.ids, np.int32) for s in slices(list(some)) for e in tokenizer(path).encode_batch(s, add_special_tokens=False)]
        return ids.reindex(texts.index).where(texts.notna(), None)

    return run


def decoded(path: str):
    """The text of ids; bytes that are no UTF-8 on their own are replaced."""

    @F.pandas_udf(T.StringType())
    def run(ids: pd.Series) -> pd.Series:
        own = pieces(path)
        return ids.map(lambda x: None if x is None else b"".join(own[int(i)] for i in x).decode("utf-8", "replace"))

    return run


def token_texts(path: str):
    """The bytes of each token; together they are the text's."""

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def run(ids: pd.Series) -> pd.Series:
        own = pieces(path)
        return ids.map(lambda x: None if x is None else [own[int(i)] for i in x])

    return run


def round_trips(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Each text by way of its ids, which are made once: key, decoded from them, and joined from the tokens' bytes.

    A task holds the texts of a batch, and ids and tokens of a slice of it.
    """
    schema = T.StructType([rows.schema[key], T.StructField("decoded", T.StringType()), T.StructField("joined", T.BinaryType())])

    def run(batches):
        own = pieces(path)
        for batch in batches:
            at, column = 0, batch.column(text)
            for some in slices((t.as_py() or "" for t in column)):
                n = len(some)
                there = column.slice(at, n).is_valid().to_pylist()
                ids = [e.ids for e in tokenizer(path).encode_batch(some, add_special_tokens=False)]
                parts = [[own[i] for i in x] if ok else None for x, ok in zip(ids, there, strict=True)]
                joined = pa.array([None if x is None else b"".join(x) for x in parts], pa.binary())
                again = pa.array([None if x is None else b"".join(x).decode("utf-8", "replace") for x in parts], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, n), again, joined], names=schema.names)
                at += n

    return rows.select(key, text).mapInArrow(run, schema)


def paragraph_break(path: str, before: str = "One paragraph.", after: str = "Another paragraph.", mark: str = "\n\n") -> list[int]:
    """The ids that part two paragraphs: those of both joined that belong to neither on its own."""
    ids = lambda text: tokenizer(path).encode(text, add_special_tokens=False).ids
    whole, left, right = ids(before + mark + after), ids(before), ids(after)
    first = next((k for k, (a, b) in enumerate(zip(whole, left, strict=False)) if a != b), min(len(whole), len(left)))
    last = next((k for k, (a, b) in enumerate(zip(reversed(whole), reversed(right), strict=False)) if a != b), min(len(whole), len(right)))
    return whole[first : max(first, len(whole) - last)]
