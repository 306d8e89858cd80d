import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import docs, empty

from tessera.llm.decontaminate import INDEX_BYTES, Index, decontaminated, index_bytes, matches, op9, parts_of, window_size


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def vocabulary(random, n):
    return [f"word{random.randint(3000)}" for _ in range(n)]


def test_planted_items_are_found(spark):
    random = np.random.RandomState(4)
    items = [(i, " ".join(vocabulary(random, n))) for i, n in enumerate([6, 9, 14, 20, 33, 47, 60, 130, 400])]
    rows, planted = [], set()
    for d in range(120):
        words = vocabulary(random, random.randint(5, 900))
        if d % 2 == 0:
            i, text = items[random.randint(len(items))]
            at = random.randint(len(words) + 1)
            words[at:at] = text.upper().split()
            planted.add((d, i))
        rows.append((d, "  ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = matches(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    assert all(r["similarity"] == 1.0 for r in found)
    kept = decontaminated(docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in planted}
    assert kept.columns == docs(spark, rows).columns


def test_edited_items_and_near_misses():
    """One changed word in a long item is found, half an item is not."""
    random = np.random.RandomState(8)
    items = [" ".join(vocabulary(random, 60)) for _ in range(60)]
    index = Index(list(range(60)), items, 5, 15)
    found = 0
    for i, item in enumerate(items):
        words = item.split()
        edited = [*words[:40], "changed", *words[41:]]
        text = " ".join(vocabulary(random, 200) + edited + vocabulary(random, 100))
        half = " ".join(vocabulary(random, 200) + words[:30] + vocabulary(random, 100))
        hits = index.search(pa.array([text, half, " ".join(edited), None, ""]), 0.8)
        assert all(t in (0, 2) and o == i and s < 1 for t, o, *_, s in hits)
        found += len(hits)
    assert found >= 0.98 * 120


def test_multi_index_misses_no_fingerprint_within_radius():
    random = np.random.RandomState(2)
    index = Index([0], [" ".join(vocabulary(random, 80))], 5, 15)
    _, _, prints, _, _, tables = index.groups[0]
    queries = []
    for p in prints:
        for flips in range(0, 22):
            q = int(p)
            for b in random.choice(64, flips, replace=False):
                q ^= 1 << int(b)
            queries.append(q)
    queries = np.array(queries, np.uint64)
    got = {(a, b) for x, y in index.near(prints, tables, queries) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i, q in enumerate(queries) for j, p in enumerate(prints) if int(q ^ p).bit_count() <= 15}
    assert got == want


def test_every_split_of_the_bits_finds_the_same():
    random = np.random.RandomState(5)
    texts = [" ".join(vocabulary(random, 40)) for _ in range(30)]
    prints = np.concatenate([g[2] for g in Index(list(range(30)), texts, 5, 15).groups])
    queries = prints.copy()
    for _ in range(13):
        queries ^= np.uint64(1) << random.randint(0, 64, len(queries)).astype(np.uint64)
    seen = set()
    for most in (10**9, index_bytes(len(prints), 1200, 1, 2), index_bytes(len(prints), 1200, 1, 1), 0):
        index = Index(list(range(30)), texts, 5, 15, most)
        [(_, _, own, _, _, tables)] = index.groups
        got = {(a, b) for x, y in index.near(own, tables, queries) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        seen.add((len(index.tried), frozenset(got)))
    assert sorted(n for n, _ in seen) == [1, 17, 137, 697] and len({g for _, g in seen}) == 1


def test_an_index_stays_within_its_bytes(spark):
    """A benchmark of a million characters: the index holds what the bound says, and lists fewer bits for it."""
    random = np.random.RandomState(6)
    texts = [" ".join(vocabulary(random, random.randint(6, 90))) for _ in range(3000)]
    assert sum(map(len, texts)) > 10**6
    whole = Index(list(range(3000)), texts, 5, 15, 10**10)
    for most in (300_000_000, INDEX_BYTES, 60_000_000):
        index = Index(list(range(3000)), texts, 5, 15, most)
        assert index.nbytes() <= most < whole.nbytes()
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert len(parts_of(bench, INDEX_BYTES, "item_id", "text")) == 1
    parts = [[r["text"] for r in p.collect()] for p in parts_of(bench, 30_000_000, "item_id", "text")]
    assert len(parts) > 1 and sorted(t for p in parts for t in p) == sorted(texts)
    assert all(Index(list(range(len(p))), p, 5, 15, 30_000_000).nbytes() <= 30_000_000 for p in parts)


def similarity(a, b):
    """Weighted Jaccard similarity of the five-word shingles."""
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a, b))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common)


def test_edited_items_by_brute_force():
    """Words replaced, put in, left out and cut off at random places: of what is 0.8 similar, at least 0.99 is found."""
    random = np.random.RandomState(12)
    wanted = found = 0
    for n in (20, 35, 60, 120, 300, 900):
        items = [vocabulary(random, n) for _ in range(12)]
        texts, similar = [], []
        for i, item in enumerate(items):
            for kind in range(4):
                for _ in range(8):
                    words = list(item)
                    for _ in range(1 + random.randint(max(1, n // 50) + 1)):
                        at = random.randint(len(words))
                        if kind == 0:
                            words[at] = "replaced"
                        elif kind == 1:
                            words.insert(at, "added")
                        elif kind == 2:
                            del words[at]
                        else:
                            words = words[1:] if random.randint(2) else words[:-1]
                    if similarity(item, words) >= 0.8:
                        similar.append((len(texts), i))
                    texts.append(" ".join(vocabulary(random, random.randint(60)) + words + vocabulary(random, random.randint(60))))
        hits = {(t, i) for t, i, *_ in Index(list(range(12)), [" ".join(x) for x in items], 5, 15).search(pa.array(texts), 0.8)}
        assert hits <= {(t, t // 32) for t in range(len(texts))}
        wanted += len(similar)
        found += len(hits & set(similar))
    assert wanted > 1500 and found >= 0.99 * wanted


def test_window_sizes_leave_play():
    assert all(1 <= window_size(n) <= n - n // 8 for n in range(1, 2000))


def test_awkward_rows(spark):
    from cases import TEXTS

    bench = spark.createDataFrame([(1, TEXTS[0][1]), (2, None), (3, ""), (4, "one two"), (None, "an orphan without any id at all")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in matches(docs(spark), bench).collect()}
    assert found == {(1, 1), (2, 1), (6, 4), (7, 4), (None, None)}
    assert matches(empty(spark), bench).count() == 0
    assert matches(docs(spark), bench.limit(0)).count() == 0
    parts = matches(docs(spark), bench, most=4_000).collect()
    assert {(r["doc_id"], r["item_id"]) for r in parts} == found
    assert len(parts_of(bench, 4_000, "item_id", "text")) > 1
    kept = decontaminated(docs(spark), bench, most=400)
    assert len(parts_of(bench, 400, "item_id", "text")) > 4 and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in decontaminated(docs(spark), bench).collect()}


def test_op9_against_brute_force(spark, sf):
    items = {r["item_id"]: low_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = low_words(r["text"])
        own = {tuple(words[i : i + 5]) for i in range(len(words))}
        for i, item in items.items():
            n = len(item)
            grams = {tuple(item[k : k + 5]) for k in range(n - 4)}
            if len(grams & own) < 0.8 * len(grams):
                continue
            for at in range(len(words) - n + 1):
                here = {tuple(words[k : k + 5]) for k in range(at, at + n - 4)}
                if len(here & grams) >= 0.8 * len(here | grams):
                    want.add((r["doc_id"], i))
    assert {(r["doc_id"], r["item_id"]) for r in op9(spark, sf).collect()} == want
