import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import rng, scores, stats, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_generator_vectors():
    random = rng.SplitMix64(0)
    assert [random.next() for _ in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert sorted(rng.SplitMix64(7).shuffled(list(range(20)))) == list(range(20))
    assert 0 <= rng.SplitMix64(1).unit() < 1 and rng.SplitMix64.derived(1, 2).next() != rng.SplitMix64.derived(1, 3).next()
    units = rng.rearranged(list(range(8)), 5)
    assert sorted(units) == list(range(8)) and all(b != a + 1 for a, b in zip(units, units[1:], strict=False))


def test_canonical_and_ids(spark):
    assert one(spark, text.canonical(F.lit("  a \t\r\nb  \r\rcé \n"))) == "a\nb\n\ncé"
    assert one(spark, text.is_content_id(text.content_id("doc", F.lit("x")), "doc")) and not one(spark, text.is_handle(F.lit("A")))


def test_roles_and_sentences(spark):
    roles = {w: one(spark, text.role(F.lit(w))) for w in ("the", "The", "'s", "...", "Mill", "42", "don't")}
    assert roles == {"the": "form", "The": "form", "'s": "form", "...": "form", "Mill": "content", "42": "content", "don't": "content"}
    assert one(spark, text.sentences(F.lit('It rains. The sun? No 3.14 here. "Yes." He said.'))) == ["It rains.", "The sun?", "No 3.14 here.", '"Yes."', "He said."]
    ended = [one(spark, text.sentence_ended(F.lit(a), F.lit(b))) for a, b in (("done.", " next"), ("done.", "Next"), ("3.", "14"), ("done", " x"), ("a", "x\ny"), ("done. ", "It"))]
    assert ended == [True, True, False, False, True, True]
    starts = [one(spark, text.starts_word(F.lit(a), F.lit(b))) for a, b in ((" a", "b"), ("a", "b"), ("a", "b "), (".", "b"), ("a", "-"))]
    assert starts == [True, False, True, True, True]


def test_templates_and_markers(spark):
    assert one(spark, text.fill(F.lit("{S} met {s}."), F.lit("the mill"))) == "The mill met the mill."
    assert one(spark, text.normalised(F.lit("  What  is It?!  "))) == "what is it"
    assert one(spark, text.marked(F.lit("cited  "), F.lit(3))) == "cited[[3]]  "
    assert one(spark, text.occurrences(F.lit("aa"), F.lit("aaaaa"))) == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\t", max_size=400), st.integers(10, 60), st.integers(0, 20))
def test_chunks_keep_the_words_and_the_limits(body, most, least):
    found = text.chunks(body, most, least)
    assert "".join("".join(found).split()) == "".join(body.split())
    assert all(c.strip(" \t") == c and c for c in found)
    assert all(len(c) >= least for c in found[:-1]) and (len(found) < 2 or len(found[-1]) >= least)
    assert all(len(c) <= most + 2 * least + 2 for c in found)


def test_chunks_by_example():
    assert text.chunks("One two. Three four.\n\nFive.", 12, 0) == ["One two.", "Three four.", "Five."]
    assert text.chunks("short\n\nlonger paragraph", 100, 8) == ["short longer paragraph"]
    assert text.chunks("a paragraph here\n \nend", 100, 8) == ["a paragraph here end"] and text.chunks(" \n\n ") == []
    assert text.chunks("abcdefghij klm", 8, 0) == ["abcdefgh", "ij klm"]


def test_scores(spark):
    got = [one(spark, scores.confidence(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((1.0, 1.0, 0.0), (0.4, 1.0, 0.0), (0.75, 0.5, 1.0))]
    assert got[:2] == [1.0, 0.0] and math.isclose(got[2], (0.5 * 0.5 * math.exp(-1)) ** (1 / 3))
    assert [one(spark, scores.trace(F.lit(n))) for n in (0, 24, 60, 96, 400)] == [0, 0, 0.5, 1, 1]
    assert math.isclose(one(spark, scores.array_entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))), math.log(2))
    p = one(spark, scores.softmax(F.array(F.lit(1000.0), F.lit(1001.0)), 0.5))
    assert math.isclose(sum(p), 1) and math.isclose(p[1] / p[0], math.exp(2))
    key = one(spark, scores.composite_key(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0)), 0.25))
    assert math.isclose(sum(x * x for x in key), 1) and math.isclose(key[0], 0.3)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_statistics_by_example(spark):
    pairs = frame(spark, [("up", float(i), 2.0 * i) for i in range(5)] + [("down", float(i), -float(i)) for i in range(5)] + [("flat", float(i), 1.0) for i in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)] + [("odd", float(i), float("nan") if i == 2 else float(i)) for i in range(5)], "g string, x double, y double")
    r = {x["g"]: x["r"] for x in pairs.groupBy("g").agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert r["up"] == pytest.approx(1) and r["down"] == pytest.approx(-1) and r["flat"] is None and r["few"] is None and r["odd"] is None
    s = {x["g"]: x["spearman"] for x in stats.spearman(pairs.where("g <> 'odd'"), "x", "y", ["g"]).collect()}
    assert s["up"] == pytest.approx(1) and s["flat"] is None
    marks = frame(spark, [("a", 0.1, False), ("a", 0.9, True), ("b", 0.5, True), ("b", 0.5, False), ("c", 0.5, True)], "g string, score double, label boolean")
    assert {x["g"]: x["auroc"] for x in stats.auroc(marks, "score", "label", ["g"]).collect()} == {"a": 1.0, "b": 0.5, "c": None}
    none = spark.range(0).select(F.lit(1.0).alias("x"))
    assert none.agg(stats.mean(F.col("x")).alias("m"), stats.quantile(F.col("x"), 0.5).alias("q")).first() == (0.0, 0.0)
    ranks = stats.with_ranks(frame(spark, [(1.0,), (2.0,), (2.0,), (5.0,)], "x double"), "x", "r")
    assert sorted(x["r"] for x in ranks.collect()) == [1, 2.5, 2.5, 4]


def test_bins_by_example(spark):
    rows = frame(spark, [(0.05, False), (0.95, True), (1.0, True), (1.2, True)], "c double, ok boolean")
    found = {x["bin"]: (x["n"], x["accuracy"]) for x in stats.bins(rows, "c", "ok").collect()}
    assert found[0] == (1, 0.0) and found[9] == (2, 1.0) and found[5] == (0, 0.0) and len(found) == 10
    assert sum(x["error"] for x in stats.bins(rows, "c", "ok").collect()) == pytest.approx(0.25 * 0.05 + 0.5 * 0.025)
