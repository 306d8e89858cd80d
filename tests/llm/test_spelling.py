import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import docs, empty
from pyspark.sql import functions as F

from tessera.llm import spelling
from tessera.llm.spelling import damaged, keys, near_pairs, op12, variants, word_counts


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute_variants(words):
    found = {}
    for w, n in words.items():
        own = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = own[0][1] if own and -own[0][0] >= 10 * n else None
        found[w] = (form, n, len(own), words[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def edited(r, word, letters):
    k = r.randrange(len(word) + 1)
    return r.choice([word[:k] + r.choice(letters) + word[k:], word[:k] + word[k + 1 :], word[:k] + r.choice(letters) + word[k + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdeéÿ", "a漢🎉b"])
def test_pairs_by_brute_force(spark, letters):
    """Words over few letters, so that bigrams repeat within a word and most words have near ones."""
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randrange(4, 12))) for _ in range(150)}
    for _ in range(2):
        words |= {e for w in sorted(words) for e in [edited(r, w, letters)] if len(e) >= 4}
    words = {w: r.choice([2, 3, 40, 500, 9000]) for w in sorted(words)}
    got = {(x["a"], x["b"]) if x["a"] < x["b"] else (x["b"], x["a"]) for x in near_pairs(table(spark, words)).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)} and len(got) > 100
    rows = variants(table(spark, words)).collect()
    assert {tuple(x) for x in rows} == brute_variants(words) and len(rows) == len(words)


def test_every_edit_shares_a_key():
    """Each near pair has a key in common, at every place of the edit and whatever the counts that order bigrams."""
    r = random.Random(7)
    for _ in range(1500):
        letters = r.choice(["ab", "abc", "abcdefghijklmnop"])
        a = "".join(r.choice(letters) for _ in range(r.randrange(4, 14)))
        b = edited(r, a, letters)
        if len(b) < 4 or not near(a, b):
            continue
        a, b = sorted((a, b), key=len, reverse=True)
        counts = np.random.RandomState(r.randrange(10**6)).randint(1, 4, spelling.BIGRAMS)
        one, two = keys(pa.array([a]), counts, 0)[1], keys(pa.array([b]), counts, len(a) - len(b))[1]
        assert set(one) & set(two), (a, b)


def test_texts_by_brute_force(spark):
    r = random.Random(3)
    base = ["Spelling", "spelling", "VARIANT", "straße", "naïvement", "ÉCOLES×ab", "grouping", "groupingx", "goruping"]
    rows = [(i, " ".join(edited(r, r.choice(base), "aeS") for _ in range(40)) + r.choice([" ", "1", "Ā", "é"]) + " ".join(r.choice(base) for _ in range(60))) for i in range(60)]
    rows += [(None, "grouping grouping"), (70, None), (71, ""), (72, "Spelling " * 3000), (72, "Spelling " * 3000)]
    words = brute_words(rows)
    got = word_counts(docs(spark, rows), change=damaged)
    assert {x["word"]: x["n"] for x in got.collect()} == words
    assert {tuple(x) for x in variants(got).collect()} == brute_variants(words)


def test_forms_lead_to_roots(spark):
    words = {"lettering": 9000, "letterin": 900, "letteri": 90, "letter": 9, "letters": 2, "unlike": 5, "unlikes": 49, "unlikest": 50}
    got = {x["word"]: (x["form"], x["root"], x["n_near"]) for x in variants(table(spark, words)).collect()}
    assert got["letter"] == ("letteri", "lettering", 2) and got["letterin"] == ("lettering", "lettering", 2) and got["unlike"] == (None, "unlike", 1)
    assert got["letters"] == ("letteri", "lettering", 2)


def test_ties_take_the_smallest_form(spark):
    got = {x["word"]: x["form"] for x in variants(table(spark, {"wordzone": 100, "wordsone": 100, "wordyone": 100, "wordxone": 1})).collect()}
    assert got["wordxone"] == "wordsone" and got["wordsone"] is None


def test_empty_and_short(spark):
    assert word_counts(empty(spark)).count() == 0 and variants(word_counts(empty(spark))).count() == 0
    with pytest.raises(ValueError):
        variants(table(spark, {"abc": 3}))


def test_long_words(spark):
    long = "abcdefghij" * 2000
    words = {long: 50, long[:9999] + long[10000:]: 2, long + "x": 3, "y" + long: 3}
    assert {tuple(x) for x in variants(table(spark, words)).collect()} == brute_variants(words)


def test_candidates_stay_few(spark):
    """Common beginnings and endings don't bring words together: pairs that share a key are hardly more than near ones."""
    r = random.Random(5)
    words = {"pre" + "".join(r.choice("abcdefgh") for _ in range(8)) + "tion": 2 for _ in range(4000)}
    df = table(spark, words)
    counts = spelling.bigram_counts(df)
    one, two = (spelling.keyed(df, counts, both) for both in (False, True))
    met = one.select("key", F.col("word").alias("a")).join(two, "key").where(F.col("longer") | (F.col("a") < F.col("word"))).select("a", "word").distinct().count()
    assert met < 12 * len(words)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(x) for x in op12(spark, sf).collect()} == brute_variants(brute_words([tuple(r) for r in rows]))
