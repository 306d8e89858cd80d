import random
import time

import pytest

from tessera.operators import corpus


def brute(x, y):
    best, row = 0, [0] * (len(y) + 1)
    for w in x:
        row = [0] + [row[j] + 1 if w == v else 0 for j, v in enumerate(y)]
        best = max(best, *row)
    return best


def pairs_of(r, n):
    for k in range(n):
        letters = r.choice(["a", "ab", "abc", "abcdefghij"])
        x = [r.choice(letters) for _ in range(r.randrange(0, 40))]
        y = [r.choice(letters) for _ in range(r.randrange(0, 40))]
        if x and r.random() < 0.5:
            i, m = r.randrange(len(x)), r.randrange(1, 30)
            at = r.randrange(len(y) + 1)
            y[at:at] = x[i : i + m]
        yield k, " ".join(x), " ".join(y)


@pytest.mark.parametrize("words", [1, 60, 200_000])
def test_runs_by_hand(spark, monkeypatch, words):
    monkeypatch.setattr(corpus, "RUN_WORDS", words)
    rows = [*pairs_of(random.Random(8), 400), (400, None, "a"), (401, "", "a"), (402, "a", "b"), (403, "A, b-C", "x a B c")]
    got = {r["k"]: r["run"] for r in corpus.longest_common_run(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b").collect()}
    want = {k: brute((a or "").lower().split(), (b or "").lower().split()) for k, a, b in rows[:-1]} | {403: 3}
    assert got == {k: n for k, n in want.items() if n}


def test_equal_words_take_the_time_of_others(spark):
    """Two texts of 20,000 equal words, and two of 20,000 different ones."""
    took = {}
    for name, words in (("equal", ["w"] * 20_000), ("other", [f"w{k}" for k in range(20_000)])):
        df = spark.createDataFrame([(1, " ".join(words), " ".join(words[:15_000] + ["end"] + words[:4000]))], "k long, a string, b string")
        start = time.monotonic()
        assert [r["run"] for r in corpus.longest_common_run(df, ["k"], "a", "b").collect()] == [15_000]
        took[name] = time.monotonic() - start
    assert took["equal"] < 3 * took["other"] + 3


def test_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k long, a string, b string")
    assert "Exchange" not in corpus.longest_common_run(df, ["k"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert corpus.longest_common_run(df.limit(0), ["k"], "a", "b").count() == 0
