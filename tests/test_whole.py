"""Queries do the whole job on tables larger than the smallest."""

import duckdb
import pytest

from tessera import registry
from tessera.sources import store

LARGER = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize(("name", "table"), [("registry_fold_whole", "documents"), ("composite_keys_whole", "embeddings")])
def test_every_row_by_its_sql(spark, name, table):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{LARGER}/{table}.parquet'")
    cursor = db.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()))
    assert sorted(tuple(r[c] for c in order) for r in QUERIES[name](spark, LARGER).collect()) == want
    assert len(want) == db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_registry_of_hot_null_and_repeated_packs(spark):
    schema = "slot string, sha string, created int, current boolean"
    rows = [("hot", f"p{i}", 5 + i, None) for i in range(300)] + [(None, "a", 2, None), (None, "b", 1, None), ("set", "c", 1, None), ("set", "d", 2, True), ("twice", "e", 1, None), ("twice", "e", 1, None), ("odd", "f", None, None), ("odd", "g", 0, None)]
    found = store.registry(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))
    assert found.columns == ["slot", "sha", "created", "current"] and found.count() == len(rows)
    assert sorted((r["slot"] or "", r["sha"]) for r in found.where("current").collect()) == [("", "b"), ("hot", "p0"), ("odd", "f"), ("set", "d"), ("twice", "e")]


def test_grounding_joins_every_step(spark):
    from tessera.queries.base import prompts

    tokens = {(r["item_id"], r["pos"]) for r in prompts(spark, LARGER).collect()}
    last = {i: max(p for j, p in tokens if j == i) for i, _ in tokens}
    found = {(r["item_id"], r["step"]): r["aligned"] for r in QUERIES["grounding_join_whole"](spark, LARGER).collect()}
    assert found == {(i, p): p % 6 != 5 or p == last[i] for i, p in tokens}
    assert max(last.values()) > 13
