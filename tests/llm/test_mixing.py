import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from cases import TEXTS, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.mixing import mixed, op11, repeated, size_of, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(3, 1, 2), share=Fraction(3, 2), epochs=Fraction(2)):
    """Water-filling one source at a time: {source: exact target}."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    limit, left, open_ = {s: epochs * sizes[s] for s in order}, share * sum(sizes.values()), set(order)
    out = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = limit[s]
            open_.remove(s)
        left -= sum(limit[s] for s in over)
    return out


def brute(rows):
    """Rows (id, source, size): the multiset of (id, size, source_size, target, taken)."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target, out = filled(sizes), []
    for s, total in sizes.items():
        own = sorted((hashlib.sha256(f"11:{'' if i is None else i}:{n}".encode()).hexdigest()[:32], n, i) for i, x, n in rows if x == s)
        words = int(target[s] + Fraction(1, 2))
        whole, extra = divmod(words, total) if total else (0, 0)
        for _, n, i in own:
            part = min(n, extra)
            extra -= part
            out.append((i, n, total, float(target[s]), whole * n + part))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


CASES = {
    "plain": [(i, f"src{i % 5}", 10 + i * 7 % 50) for i in range(200)],
    "hot": [(i, "hot" if i % 3 else f"s{i % 7}", i % 90) for i in range(500)],
    "clamped": [(1, "a", 1), (2, "b", 2), (3, "c", 1000), (4, "d", 3), (5, None, 40), (6, None, 2)],
    "repeated": [(1, "a", 9)] * 100 + [(None, "a", 7)] * 50 + [(None, "b", 7)] * 30 + [(2, "b", 0)] * 20,
    "nothing": [(1, "a", 0), (2, "b", 0), (3, None, 0)],
    "one": [(1, None, 20_000), (2, None, 3)],
    "order": [(i, s, 100) for i, s in enumerate(["Z", "a", "é", "漢", "🎉", "", None])],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = CASES[name]
    got = found(mixed(table(spark, rows)))
    assert got == brute(rows)
    assert found(mixed(table(spark, rows[::-1]).repartition(3))) == got
    for s in {x[1] for x in rows}:
        own = {x[0] for x in rows if x[1] == s}
        assert abs(sum(x[4] for x in got if x[0] in own) - sum({x[3]: x[3] for x in got if x[0] in own})) <= 0.5 or len(own & {x[0] for x in rows if x[1] != s})


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=2) | st.none(), st.integers(0, 10**6), min_size=1, max_size=12), st.sampled_from([Fraction(1, 2), Fraction(3, 2), Fraction(19, 10), Fraction(5)]))
def test_targets(spark, sizes, share):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    df = spark.createDataFrame([(s, sizes[s], (3, 1, 2)[k % 3]) for k, s in enumerate(order)], "source string, source_size long, weight long")
    want = filled(sizes, share=share)
    for r in targets(df, share).collect():
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12) and r["words"] <= 2 * r["source_size"]


def test_many_rounds_of_clamping(spark):
    """Each round's excess clamps the next source."""
    sizes = {f"{k:02d}": 3**k for k in range(25)}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, weight long")
    want = filled(sizes, weights=(1,), share=Fraction(19, 10))
    assert {r["source"]: r["target"] for r in targets(df, Fraction(19, 10)).collect()} == pytest.approx({s: float(t) for s, t in want.items()})


def test_texts_of_the_mix(spark):
    """Whole copies are the text, the last one of a source's last row its first words; words add up to what is taken."""
    rows = TEXTS + [(100 + i, f" w{i} é漢 \n c" * (1 + i % 4)) for i in range(60)]
    df = docs(spark, rows).withColumn("source", F.when(F.length("text") > 60, None).otherwise(F.concat(F.lit("s"), F.coalesce(F.col("doc_id"), F.lit(0)) % 3)))
    sized = Scratch(spark, "test").save(df.withColumn("size", size_of(F.col("text"))), "sized")
    plan = mixed(sized)
    assert plan.columns == [*sized.columns, "source_size", "target", "taken"]
    taken = defaultdict(int)
    for r in plan.collect():
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    words, cut = defaultdict(int), 0
    whole = {t for _, t in rows}
    for r in repeated(plan).collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
        if r["text"] not in whole:
            cut += 1
            assert any(t and t.startswith(r["text"]) for t in whole)
    assert words == {s: n for s, n in taken.items() if n} and cut <= len(taken)


def test_empty_table_and_bad_weights(spark):
    df = empty(spark).withColumn("size", F.lit(1))
    assert mixed(df).count() == 0 and repeated(mixed(df)).count() == 0
    with pytest.raises(ValueError):
        mixed(df, weights=(1, 0))


def test_clashing_names(spark):
    df = table(spark, CASES["plain"]).withColumns({c: F.lit("x") for c in ("target", "taken", "source_size", "_mix_key", "_mix_edge", "key", "rows", "weight", "a.b")})
    got = mixed(df)
    assert found(got) == brute(CASES["plain"]) and got.where("`_mix_key` = 'x' AND `a.b` = 'x' AND key = 'x'").count() == 200


def test_query(spark, sf):
    rows = [(r[0], r[1], len(WORD.findall(r[2] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert found(op11(spark, sf)) == brute(rows)
