import zlib

import numpy as np
import pyarrow as pa
from cases import TEXTS, docs, empty

from tessera.llm.quality import FEATURES, SAMPLE, classify, op7, scored, statistics, train


def test_statistics_of_known_texts():
    x = statistics(pa.array(["AB cd, ef!\nAB cd, ef!\n", None, "", "x"], pa.string()))
    row = dict(zip(FEATURES, x[0], strict=True))
    assert x.shape == (4, len(FEATURES)) and np.isfinite(x).all()
    assert row["log_words"] == np.log1p(6) and row["log_lines"] == np.log1p(2) and row["distinct_words"] == 0.5 and row["distinct_lines"] == 0.5
    assert row["class_1"] == 4 / 22 and row["class_8"] == 0 and row["class_7"] == 2 / 22 and row["top_word"] == 2 / 6 and row["ended_lines"] == 1 and row["capital_words"] == 2 / 6
    assert not x[1].any() and not x[2].any()


def test_statistics_don_t_depend_on_the_batch():
    texts = [t for _, t in TEXTS]
    whole = statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, whole, strict=True):
        assert np.allclose(statistics(pa.array([t], pa.string()))[0], row)


def test_trees_learn_and_traverse_as_written():
    random = np.random.RandomState(1)
    x = random.rand(4000, 6)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    model = train(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.98
    one = x[3000]
    total = model.base
    for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if one[feature[node]] > cut[node] else 1)
        total += value[node - len(feature)]
    assert np.isclose(model.score(x[3000:3001])[0], 1 / (1 + np.exp(-total)))


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (8, 0), (None, 1), (5, None), (77, 3)], "doc_id long, quality int")
    found = classify(docs(spark), labels).collect()
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert classify(empty(spark), labels).count() == 0
    none = classify(docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_scores_don_t_depend_on_how_rows_are_dealt(spark):
    """Repeated ids with different texts, under several partitionings and orders."""
    texts = [(i % 40, f"text {i} " + "good words, here. " * (i % 7) + "JUNK!!! " * (i % 5)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    seen = set()
    for parts, turn in ((1, 1), (3, -1), (7, 1), (16, -1)):
        found = classify(docs(spark, texts[::turn]).repartition(parts), labels).collect()
        seen.add(tuple(sorted((r["doc_id"], r["score"]) for r in found)))
    assert len(seen) == 1


def test_op7_by_hand(spark, sf):
    """The query's scores again: training rows by Python, statistics a text at a time, trees walked node by node."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    used = sorted(i for i in labels if i in texts and not out[i])
    rows = {i: statistics(pa.array([t], pa.string()))[0] for i, t in texts.items()}
    model = train(np.array([rows[i] for i in used]), np.array([labels[i] for i in used], float))
    found = op7(spark, sf).collect()
    assert len(found) == len(texts) and len(used) < SAMPLE
    for r in found:
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if rows[r["doc_id"]][feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        want = 1 / (1 + np.exp(-total))
        assert np.isclose(r["score"], want, rtol=1e-9) and r["held_out"] == out[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    found = op7(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    score, good = found["score"].to_numpy(), found["quality"].to_numpy() == 1
    assert (score[good][:, None] > score[~good][None, :]).mean() > 0.99
    assert (found["predicted"][good] == 1).mean() > 0.99 and (found["predicted"][~good] == 0).mean() > 0.95


def test_scored_keeps_columns(spark):
    model = train(np.zeros((2, len(FEATURES))), np.array([0.0, 1.0]))
    assert scored(docs(spark), model).columns == [*docs(spark).columns, "_score"]
    assert scored(docs(spark), model, name="score").columns == [*[c for c in docs(spark).columns if c != "score"], "score"]
    assert scored(empty(spark), model).count() == 0
