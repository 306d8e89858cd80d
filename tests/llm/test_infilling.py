import hashlib
import re

import pyarrow as pa
import pytest
from cases import TEXTS, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes
from tessera.llm.infilling import cut_up, cuts, op13, put_back

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["<P>", "a<S>b c", "x <M", "<P", ">", "<<P>", "S>", "<S", "a <", "P> b", "  a b", "\x0b\x0c", "a\x1cb \x85c", "\x00 \x00", "é" * 5000 + " ", " " * 5000, "漢 字 🎉", "<X> <p>", "a\n\nb\r\nc "]


@pytest.fixture(scope="module")
def rows():
    """The common cases, and each odd text under ids of every form."""
    return TEXTS + [(100 + 40 * i + k, t) for i, t in enumerate(ODD) for k in range(40)]


def test_against_brute_force(spark, rows):
    made = cut_up(docs(spark, rows))
    got = put_back(made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    want = sorted(((*brute(*r), r[1] or "") for r in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert put_back(cut_up(empty(spark)), ["doc_id"]).count() == 0


def test_all_texts_without_bytes(spark):
    assert {tuple(r) for r in cut_up(docs(spark, [(1, ""), (2, None)])).collect()} == {(1, 0, "plain", None, None, ""), (2, 0, "plain", None, None, "")}


def test_broken_outputs_are_null(spark):
    outputs = [("psm", "<P>a<S>b<M>c"), ("spm", "<P>a<S>b<M>c"), ("psm", "x<P>a<S>b<M>c"), ("psm", "<P>a<S>b"), ("spm", "<S>b<P>a<M>c"), ("plain", "<P>"), ("other", "a"), ("psm", None), ("plain", None), ("psm", "<P>a<S>b<M>c<M>")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(outputs)], "`a.b` long, form string, output string")
    got = {r[0]: r[1] for r in put_back(df, ["a.b"]).collect()}
    assert got == {0: "acb", 1: None, 2: None, 3: None, 4: "acb", 5: "<P>", 6: None, 7: None, 8: None, 9: None}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=" \t\n\x0b\x1fab<é漢", max_size=12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=6))
def test_cuts(cases):
    import numpy as np

    data, at = text_bytes(pa.array([c[0] for c in cases]))
    n, first, second = cuts(data, at, np.array([c[1] for c in cases]), np.array([c[2] for c in cases]))
    for i, (text, h1, h2) in enumerate(cases):
        units = UNIT.findall(text)
        assert n[i] == len(units)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert bytes(data[at[i] : first[i]]).decode() == "".join(units[:a])
        assert bytes(data[first[i] : second[i]]).decode() == "".join(units[a:b])


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in op13(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, text in texts:
        _, n, form, a, b, output = brute(i, text)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, b)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_forms_share(spark):
    """Of many documents half are cut, and four of five of these begin with the suffix."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text of words").alias("text"))
    counts = {r["form"]: r["count"] for r in cut_up(df).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 10_000) < 400 and abs(counts["spm"] - 8_000) < 400
