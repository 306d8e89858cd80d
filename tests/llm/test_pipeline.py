import sys
import zlib

import corpus_pipeline
import numpy as np
from cases import docs, empty
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_decontaminate import low_words
from test_neardup import brute
from test_packing import best_fit
from test_secrets import base

from tessera.llm.packing import Encoder, tokenizer_paths
from tessera.llm.quality import THRESHOLD, fit, scored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf):
    """Every stage's rows by plain Python over what its predecessor kept; the classifier's scores are the operator's."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in frame.collect()}
    bench = [low_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs_ = frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs_ = stage(spark, docs_, sf)
        assert docs_.columns == COLUMNS
        got = {r["doc_id"]: r["text"] for r in docs_.collect()}
        if name == "quality_classifier":
            model = fit(frame, spark.read.parquet(f"{sf}/labels.parquet"))
            keep = {r["doc_id"] for r in scored(frame, model).where(f"_score >= {THRESHOLD}").collect()}
            rows = {i: t for i, t in rows.items() if i in keep}
        elif name == "minhash_near_dedup":
            groups = brute(rows.items(), 80)
            rows = {i: t for i, t in rows.items() if groups[i][1] == i}
        elif name == "benchmark_decontamination":
            def holds(text):
                w = " ".join(low_words(text))
                return any(f" {' '.join(b)} " in f" {w} " for b in bench)

            rows = {i: t for i, t in rows.items() if not holds(t)}
        else:
            assert got.keys() == rows.keys() and not any(base(t) for t in got.values())
            assert all(t == rows[i] for i, t in got.items() if not base(rows[i]) and "[" not in t)
            rows = got
        assert got == rows, name
    encode = Encoder(tokenizer_paths())
    lengths = [len(encode(t)) + 1 for t in rows.values()]
    packed = corpus_pipeline.STAGES[4][1](spark, docs_, sf).toPandas()
    assert packed.groupby("doc_id")["doc_tokens"].first().to_dict() == dict(zip(rows, lengths, strict=True))
    whole, rest = sum(n // 1024 for n in lengths), [n % 1024 for n in lengths if n % 1024]
    assert packed["sequence_id"].max() + 1 == whole + len(best_fit(rest, 1024))


def test_run_is_the_stages(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0


def test_awkward_tables(spark, tmp_path):
    schema = T.StructType([f for f in docs(spark).schema.fields if f.name in COLUMNS])
    for rows in (docs(spark).select(COLUMNS), empty(spark).select(COLUMNS)):
        folder = f"{tmp_path}/{rows.count()}"
        spark.createDataFrame(rows.collect(), schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert (found.count() > 0) == (rows.count() > 0)
    assert "corpus_pipeline" in sys.modules


def test_clashing_names_and_repeats(spark, tmp_path, sf):
    """Every stage keeps columns of the names that stages use themselves, and doesn't depend on the order of rows."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_score", "_first", "kept", "component_id", "_hash", "_id", "_text", "_label", "x", "a.b", "set_a", "cls", "ids", "start", "_rank", "_bucket"]
    rows = docs(spark)
    twice = rows.unionByName(rows.withColumn("text", F.concat("text", F.lit(" and more of it"))).where("doc_id IN (1, 6)"))
    wide = twice.select("*", *[F.lit(f"value of {n}").alias(n) for n in names])
    seen = set()
    for parts in (1, 5):
        frame = wide.repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == wide.columns, name
            assert all(r[n] == f"value of {n}" for r in frame.collect() for n in names)
        seen.add(tuple(sorted(map(str, frame.collect()))))
        assert corpus_pipeline.STAGES[4][1](spark, frame, str(tmp_path)).count() >= frame.count() > 0
    assert len(seen) == 1


def test_training_sequences_are_those_of_the_plan(spark, sf):
    ids = {r["sequence_id"]: list(r["ids"]) for r in corpus_pipeline.training_sequences(spark, sf).collect()}
    plan = corpus_pipeline.run(spark, sf).collect()
    assert ids.keys() == {r["sequence_id"] for r in plan}
    assert sum(map(len, ids.values())) == sum(r["length"] for r in plan)
    for r in plan:
        piece = ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.asarray(piece, "<u4").tobytes()) == r["ids_crc32"]
