import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import questions, samples, views
from tessera.plans import answer, build


def test_answer_cites_what_it_says(spark):
    """A text read back word by word from one of two documents: the choice is its next word, one span covers it."""
    random = np.random.RandomState(0)
    rows = [(d * 20 + i, random.randn(6).tolist(), 100 * d + i + 1, d, i + 1, 0.0) for d in range(2) for i in range(20)]
    entries = spark.createDataFrame(rows, "entry long, vector array<double>, value long, row long, offset long, loss double").withColumn("grp", F.lit(None).cast("long"))
    queries = entries.where("entry BETWEEN 22 AND 30").select(F.col("entry").alias("query"), "vector", "grp")
    found = answer.retrieved(queries, entries, 4, 0.05)
    model = queries.select("query").join(entries.select("value")).select("query", "value", F.lit(1 / 40).alias("p"))
    choice = answer.answered(found, model, 0.5)
    assert {r["query"]: r["value"] for r in choice.collect()} == {22 + k: 103 + k for k in range(9)}
    generation = queries.select("query", F.lit(1).cast("long").alias("gen"), (F.col("query") - 22).alias("k"))
    parts = spark.createDataFrame([(0, "a", 0, 50), (1, "b", 0, 50)], "row long, document_id string, partition_index int, token_count int")
    cited, spans = answer.supported(found, choice, generation, parts)
    assert {r["row"] for r in cited.collect()} == {1}
    assert [(r["start"], r["length"], r["row"], r["offset"]) for r in spans.collect()] == [(0, 9, 1, 3)]


def test_build_leaves_documents_out(spark):
    docs = spark.createDataFrame([(1, "a b c\nd"), (2, "a b c e"), (3, "x y")], "id long, body string")
    b = build.build(docs, "id", "body", F.lit(0.05), F.lit(0.1), docs.where("id = 3"))
    assert b.entries.count() == 6 and b.partitions.count() == 3 and b.shared.count() == 1
    assert {r["row"]: r["memorised"] for r in b.stats.collect()} == {1: 1.0, 2: 1.0}
    assert b.snapshot.first()["documents"] == 2


def test_questions(spark):
    t = questions.template_rows(spark, [("born", "When was {s} born?", "{S} was born in"), ("any", "When was {s}?", "{S} was")])
    q = spark.createDataFrame([(1, " when was ada (the first) born? "), (2, "When was it?"), (3, "Who?"), (3, "Who?")], "id long, question string")
    got = sorted((r["id"], r["kind"], r["stem"]) for r in questions.rewritten(q, t).collect())
    assert got == [(1, "born", "Ada (the first) was born in"), (2, "any", "It was"), (3, None, None)]
    clean = spark.range(1).select(questions.cleaned(F.lit(' "The mill." ___ more')).alias("x")).first()["x"]
    assert clean == "The mill"
    ok = [spark.range(1).select(questions.acceptable(F.lit(a), F.lit(b)).alias("x")).first()["x"] for a, b in (("the mill of Aro is", "Who owns Aro?"), ("the mill is", "Who owns Aro?"), ("Is it Aro?", "Who owns Aro?"), (" ", "Who?"))]
    assert ok == [True, False, False, False]


def test_samples(spark):
    rows = spark.createDataFrame([(i, "g") for i in range(10)], "id long, g string")
    b = samples.batches(rows, F.col("id"), 4, ["g"]).collect()
    assert sorted((r["batch"], r["place"]) for r in b) == [(i // 4, i % 4) for i in range(12)] and sorted(r["id"] for r in b) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [samples.share(10, 4, i) for i in range(4)] == [3, 3, 2, 2]
    plan = samples.planned(spark.range(7).withColumnRenamed("id", "step"), {"a": 2, "b": 1}).orderBy("step").collect()
    assert [(r["corpus"], r["window"]) for r in plan] == [("a", 0), ("a", 1), ("b", 0), ("a", 2), ("a", 3), ("b", 1), ("a", 4)]


def test_views(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("x",), ("y",)], "sha string")
    with pytest.raises(PySparkException):
        views.guarded(df, {"sha": "x"}).collect()
    assert views.guarded(df.where("sha = 'x'"), {"sha": "x"}).count() == 1
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 5, 6, 0, 7])], "text long, pos long, token long")
    assert {(r["t"], r["s"]) for r in views.attention(tokens, "text", 0).collect()} == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 3), (4, 3), (4, 4)}


def test_formats(spark):
    assert formats.node_list("ab, c-d") == ["ab", "c-d"] and formats.source_policy("top:3") == ("top", 3) and formats.source_policy("all") == ("all", None) and formats.source_policy("a#1,b#2") == ("ids", ["a#1", "b#2"])
    for bad in ("ab,ab", "A", "ab,,c"):
        with pytest.raises(ValueError):
            formats.node_list(bad)
    show = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [show(formats.duration(F.lit(s))) for s in (5, 65, 3725)] == ["5s", "1m05s", "1h02m"] and show(formats.percent(F.lit(0.123))) == "12.3%"
    p = show(formats.parsed_source_id(F.lit("a#b#12")))
    assert (p["document_id"], p["partition_index"]) == ("a#b", 12)
