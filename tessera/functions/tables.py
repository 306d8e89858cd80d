"""Table functions for SQL: one row to many."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

WORD = re.compile(r"[^\W_]+")


@udtf(returnType="pos: int, piece: string, byte: int")
class Tokenize:
    """`SELECT t.* FROM docs, LATERAL tokenize(text) t`: words, their order and where they start in UTF-8 bytes."""

    def eval(self, text: str):
        at = byte = 0
        for pos, m in enumerate(WORD.finditer(text or "")):
            byte += len(text[at : m.start()].encode())
            yield pos, m[0], byte
            at = m.start()


def register(spark: SparkSession) -> None:
    spark.udtf.register("tokenize", Tokenize)
