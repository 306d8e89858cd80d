import re

import numpy as np
from cases import docs, empty

from tessera.llm import neardup
from tessera.llm.neardup import links, near_duplicates, op8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, percent=85):
    """Components by all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows, **settings):
    found = near_duplicates(docs(spark, rows), **settings).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def edited(random, words, edits):
    words = list(words)
    for i in random.choice(len(words), edits, replace=False):
        words[i] = f"edit{random.randint(10**6)}"
    return " ".join(words)


def test_awkward_rows(spark):
    from cases import TEXTS

    check(spark, TEXTS)


def test_copies_of_copies(spark):
    """A hub with near copies that link through it or each other, a chain, shared passages and unrelated texts."""
    random = np.random.RandomState(3)
    base = [f"w{random.randint(5000)}" for _ in range(150)]
    rows = [(i, edited(random, base, random.randint(0, 7))) for i in range(10, 130)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(130, 150):
        chain = edited(random, chain, 1).split()
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join([f"u{random.randint(10**6)}" for _ in range(40)] + base[:30])) for i in range(150, 180)]
    rows += [(200, "a b c"), (201, "A  b c"), (202, "a b"), (203, None), (204, "")]
    check(spark, rows)
    check(spark, rows, block=600)  # many blocks and block pairs


def near_copies(number, seed=5, outliers=False):
    """Near copies of one size, each with two words of its own; with outliers, one in twenty has four. The text that they are made from is none of them."""
    random = np.random.RandomState(seed)
    base = [f"w{k}" for k in range(300)]
    return [(i, edited(random, base, 4 if outliers and i % 20 == 7 else 2)) for i in range(number)]


def test_work_follows_rows_in_a_group_of_near_copies(spark, monkeypatch):
    """Twice the near copies, about twice the sets that are compared, though a block holds three texts."""
    work = {}
    for number in (150, 300, 600):
        seen = work[number] = []
        for name in ("held_against", "compared"):
            def counted(first, *rest, plain=getattr(neardup, name), seen=seen, name=name):
                out = plain(first, *rest)
                seen.append((first if name == "held_against" else out).count())
                return out

            monkeypatch.setattr(neardup, name, counted)
        found = near_duplicates(docs(spark, near_copies(number)), block=1000).collect()
        monkeypatch.undo()
        assert {r["component_id"] for r in found} == {0}
    assert sum(work[300]) < 2.5 * sum(work[150]) and sum(work[600]) < 2.5 * sum(work[300]), work
    assert sum(work[600]) < 2 * 600, work


def test_near_copies_in_many_blocks(spark):
    """Outliers of a cluster meet all of it, wherever its blocks are cut."""
    for seed, block in ((1, 1000), (2, 3000), (3, 10**6)):
        check(spark, near_copies(120, seed, True) + [(1000 + i, t) for i, t in near_copies(40, seed + 10, True)], block=block)


def test_links_hold_every_link():
    random = np.random.RandomState(9)
    base = random.randint(0, 10**9, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        own[random.randint(0, 60, random.randint(0, 9))] = random.randint(0, 10**9)
        sets.append(np.unique(own))
    up = list(range(80))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links(sets, None, 85):
        common = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common)
        up[max(root(i), root(j))] = min(root(i), root(j))
    for i in range(80):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert root(i) == root(j)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_op8_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    found = op8(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
