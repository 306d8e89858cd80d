import re

import numpy as np
import pyarrow as pa
from cases import LONG, TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import Scratch, components, in_chunks, ranked, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def same_pattern(values, hashes):
    """Equal values have equal hashes and different ones different."""
    return len(set(zip(values, hashes, strict=True))) == len(set(values)) == len(set(hashes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB éß\t\n\x0b\x1c  漢", max_size=30)), max_size=8))
def test_words_are_the_patterns(texts):
    hashes, sizes = word_hashes(pa.array(texts, pa.string()))
    own = [words(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in own]
    assert same_pattern([w for ws in own for w in ws], hashes.tolist())


def test_words_of_slices_and_long_texts():
    texts = [t for _, t in TEXTS] + [LONG * 10]
    array = pa.array(["skip me", *texts, "and me"], pa.string()).slice(1, len(texts))
    hashes, sizes = word_hashes(array)
    own = [words(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in own]
    assert same_pattern([w for ws in own for w in ws], hashes.tolist())


def test_shingles_are_runs_of_words():
    texts = ["a b c d e f", "a b", "", "x a b c d e", "b a", None]
    hashes, counts = shingle_hashes(*word_hashes(pa.array(texts, pa.string())), 5)
    runs = [[tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))] for w in map(words, texts)]
    assert counts.tolist() == [len(r) for r in runs] == [2, 1, 0, 2, 1, 0]
    assert same_pattern([r for rs in runs for r in rs], hashes.tolist())


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c" * 10])], names=["text"])
    parts = list(in_chunks([batch], "text", 50))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert len(parts) == 3


def test_ranked_is_gapless_in_every_group(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 7 AS STRING) END AS g")
    rows = ranked(df, ["g"], ["id"], "at", 5000, per_bucket=100).collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["at"])
    assert sum(map(len, by.values())) == 5000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_components_against_union_find(spark):
    random = np.random.RandomState(5)
    edges = [(int(a), int(b)) for a, b in random.randint(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    found = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), "t")
    assert {(r["node"], r["component"]) for r in found.collect()} == {(x, root(x)) for x in up}
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "t") is None


def test_words_of_one_form_don_t_collide():
    """Texts on which sums of powers of any odd number collide modulo 2 ** 64, and long words that differ in one letter."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
        if len(word) >= 16:
            own, other = word_hashes(pa.array([word, word.translate({97: 98, 98: 97})]))[0].tolist()
            assert own != other
    words = [*("x" * k + "y" + "x" * (199 - k) for k in range(200)), "x" * 199, "x" * 200, "x" * 201]
    assert len(set(word_hashes(pa.array(words))[0].tolist())) == len(words)
    assert word_hashes(pa.array(["Zx" * 100]))[0][0] == word_hashes(pa.array(["zX" * 100]))[0][0]
    assert len(set(word_hashes(pa.array(["ab ba abab baba aabb bbaa"]))[0].tolist())) == 6
