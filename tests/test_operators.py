import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cite, corpus, evaluate, index, ledger, mix, rules, trajectory


def test_snapshot_changes_by_example(spark):
    rows = lambda r: spark.createDataFrame([(d, i, t) for d, i, t in r], "document_id string, partition_index int, text string").withColumn("sha", F.sha2("text", 256))
    before, after = rows([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")]), rows([("a", 0, "one"), ("a", 1, "TWO"), ("c", 0, "four"), ("c", 1, "five")])
    got = {(r["document_id"], r["partition_index"], r["change"]) for r in corpus.changes(before, after).collect()}
    assert got == {("c", 0, "added"), ("c", 1, "added"), ("b", 0, "removed"), ("a", 1, "changed")}
    assert {(r["document_id"], r["change"]) for r in corpus.document_changes(before, after).collect()} == {("c", "added"), ("b", "removed")}
    assert corpus.changes(before, before).count() == 0
    assert corpus.snapshot(before).collect() == corpus.snapshot(before.orderBy(F.desc("sha"))).collect()


@pytest.mark.parametrize(("added", "removed", "changed", "live", "parts", "plan"), [(1, 0, 0, False, 10, "train"), (1, 0, 0, True, 10, "reindex+train"), (0, 1, 0, True, 10, "reindex"), (1, 0, 0, True, 100, "reindex"), (0, 0, 0, True, 10, "none"), (5, 0, 0, True, 0, "none")])
def test_update_plan(spark, added, removed, changed, live, parts, plan):
    row = spark.createDataFrame([(added, removed, changed)], "added int, removed int, changed int")
    assert row.select(corpus.update_plan(row, F.lit(parts), F.lit(live)).alias("p")).first()["p"] == plan


def hits(spark, rows):
    return spark.createDataFrame(rows, "q int, strand string, entry int, value int, score double")


def test_weights_pool_and_gates(spark):
    rows = hits(spark, [(1, "a", 0, 7, 0.9), (1, "b", 0, 7, 0.9), (1, "a", 1, 8, 0.2), (1, "c", 5, 9, 0.1)])
    pool = mix.pooled(rows, ["q"], 3, 0.05)
    got = pool.orderBy("rank").collect()
    assert [r["strand"] for r in got] == ["a", "b", "a"] and sum(r["weight"] for r in got) == pytest.approx(1)
    gates = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.4), (1, "c", 0.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", 0.01), (3, "b", 0.02)], "q int, strand string, gate double")
    opened = {(r["q"], r["strand"]): r["open"] for r in mix.opened(gates, ["q"], 0.05).collect()}
    assert opened == {(1, "a"): True, (1, "b"): True, (1, "c"): False, (2, "a"): True, (2, "b"): True, (3, "a"): False, (3, "b"): True}
    shares = mix.renormalised(mix.opened(gates, ["q"], 0.05), ["q"]).groupBy("q").agg(F.sum("share").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in shares.collect())


def test_choice_at_a_near_tie(spark):
    rows = spark.createDataFrame([(1, 5, 0.5, 20), (1, 9, 0.5 - 1e-8, 10), (1, 2, 0.4, 1), (2, 5, 0.5, None), (2, 3, 0.5, None), (3, 4, 0.6, 9), (3, 1, 0.4, 1)], "q int, token int, p double, age long")
    assert {r["q"]: r["token"] for r in mix.choose(rows, ["q"], "token", "p", "age").collect()} == {1: 9, 2: 3, 3: 4}


def test_gate_memory_laws():
    random = np.random.RandomState(1)
    p = random.rand(50, 3) * 0.4
    for commons in (None, 0):
        memory, credible = mix.remembered(p, mix.Gate(), commons)
        assert np.allclose(memory.sum(1), 1) and (memory >= 0).all() and ((credible >= 0) & (credible <= 1)).all()
    same = np.repeat(random.rand(20, 1), 3, 1)
    assert np.allclose(mix.remembered(same, mix.Gate(variable=True))[0], 1 / 3)
    lead = np.column_stack([np.full(30, 0.5), np.full(30, 1e-4)])
    assert mix.remembered(lead, mix.Gate())[0][-1][0] > 0.9
    assert np.allclose(mix.remembered(same, mix.Gate(), commons=1, prior=0.9)[0][-1][1], 0.9)


def test_neighbours_stay_off_the_driver(spark, monkeypatch):
    """Blocks and cells of any size give the same rows, in a plan whose products meet no collected query."""
    r = np.random.RandomState(12)
    e = spark.createDataFrame([(i, r.randint(-2, 3, 4).astype(float).tolist(), int(i % 3)) for i in range(150)], "entry long, vector array<double>, grp long")
    q = e.where("entry % 3 = 1").select(F.col("entry").alias("query"), "vector", "grp")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    whole = key(index.blocked_neighbours(q, e, 7))
    assert len(whole) == 350
    monkeypatch.setattr(index, "CELL", 11)
    assert key(index.blocked_neighbours(q, e.repartition(4), 7, block=9)) == whole
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.blocked_neighbours(q, e, 7, block=9)
        assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString() and key(found) == whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    named = index.blocked_neighbours(q.withColumn("grp", F.lit(None).cast("long")), e.withColumn("strand", F.concat(F.lit("s"), F.col("entry") % 2)), 3)
    assert named.groupBy("query", "strand").count().where("count <> 3").count() == 0 and named.count() == 300
    assert index.blocked_neighbours(q.limit(0), e, 3).count() == 0 and index.blocked_neighbours(q, e.limit(0), 3).count() == 0


def test_many_nodes_meet_without_a_broadcast(spark, monkeypatch):
    """Beyond the bound of what travels, joins without equal keys give the same rows by another plan."""
    from tessera.operators import bounds

    nodes = spark.range(40).select(F.concat(F.lit("n"), "id").alias("n"))
    few = corpus.ordered_pairs(nodes, "n")
    assert few.count() == 40 * 39 and "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(corpus, "few", lambda df: bounds.few(df, 10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = corpus.ordered_pairs(nodes, "n")
        assert "CartesianProduct" in many._jdf.queryExecution().executedPlan().toString() and sorted(many.collect()) == sorted(few.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spans_of_a_long_text(spark):
    """Thousands of chains of one generation, over many batches, as a scan of all that is chosen chooses them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        r = np.random.RandomState(6)
        rows = [(g, int(r.randint(3000)), int(r.randint(3, 40)), int(r.randint(9)), int(r.randint(500)), float(r.choice([0.1, 0.2, 0.7]))) for g in (1, 1, 1, 2) for _ in range(700)]
        rows = sorted({(x[0], *x[2:5]): x for x in rows}.values())  # no two of one rank
        parts = spark.createDataFrame([(k, f"d{k % 4}", k) for k in range(9)], "row long, document_id string, partition_index int")
        df = spark.createDataFrame(rows, "gen long, start long, length long, row long, offset long, weight double")
        got = {(x["gen"], x["span"]): (x["start"], x["length"], x["row"], x["offset"], x["alternatives"]) for x in cite.spans(df, parts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in (1, 2):
        chosen = []
        for _, start, length, row, offset, _ in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], -x[5], f"d{x[3] % 4}", x[3], x[4])):
            owner = next((c for c in chosen if start < c[0] + c[1] and c[0] < start + length), None)
            if owner is None:
                chosen.append((start, length, row, offset, []))
            elif len(owner[4]) < 5:
                owner[4].append(row)
        want |= {(g, i): c for i, c in enumerate(sorted(chosen))}
    assert got == want and len(want) > 100


def test_gate_memory_step_by_step():
    """The fold against one written out for a single token at a time, with and without a commons, in every setting."""

    def step(weight, credit, row, gate, commons):
        n = len(weight)
        if commons is None:
            said = [min(max(x, gate.floor), gate.ceiling) for x in row]
            short = [math.log(gate.ceiling / x) / math.log(gate.ceiling / gate.floor) for x in said]
            good = [1 - x for x in short]
        else:
            most = gate.ceiling / gate.floor
            said = [1.0 if t == commons else min(max(x / max(row[commons], 1e-12), 1 / most), most) for t, x in enumerate(row)]
            good, short = [max(0, math.log(x) / math.log(most)) for x in said], [max(0, -math.log(x) / math.log(most)) for x in said]
        credit = [(1 - gate.credibility_rate) * c + gate.credibility_rate * g for c, g in zip(credit, good, strict=True)]
        power = max(c for t, c in enumerate(credit) if t != commons) if gate.credibility else 1
        new = [w * x**power for w, x in zip(weight, said, strict=True)]
        new = [x / sum(new) for x in new]
        if not gate.variable:
            return [(1 - gate.share_rate) * x + gate.share_rate / n for x in new], credit
        out = [x * (1 - (1 - gate.share_rate) ** f) for x, f in zip(new, short, strict=True)]
        return [x - o + (sum(out) - o) / (n - 1) for x, o in zip(new, out, strict=True)], credit

    random = np.random.RandomState(4)
    p = random.choice([0.0, 1e-5, 0.02, 0.3, 0.5, 0.9], (60, 4)) * random.rand(60, 4)
    for commons in (None, 2):
        for gate in (mix.Gate(), mix.Gate(variable=False), mix.Gate(credibility=False), mix.Gate(floor=0.1, ceiling=0.11)):
            memory, credible = mix.remembered(p, gate, commons, 0.8)
            weight = [0.25] * 4 if commons is None else [0.2 / 3, 0.2 / 3, 0.8, 0.2 / 3]
            credit = [0.0] * 4
            for k, row in enumerate(p.tolist()):
                weight, credit = step(weight, credit, row, gate, commons)
                assert np.allclose(memory[k], weight) and np.allclose(credible[k], credit)
    halves = mix.Memory(4, mix.Gate())
    parts = [halves.read(p[:17]), halves.read(p[17:])]
    assert np.allclose(np.vstack([x[0] for x in parts]), mix.remembered(p, mix.Gate())[0])


def test_gate_memory_of_long_texts(spark):
    """A text over many batches is one fold, silent strands give 0, texts don't touch each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        random = np.random.RandomState(5)
        rows = [(t, k, s, float(random.rand())) for t in ("long", "b", "c") for k in range(40 if t == "long" else 3) for s in "xyz" if (t, s) != ("c", "y") and (k + ord(s)) % 5]
        df = spark.createDataFrame(rows, "text string, position long, strand string, p double").repartition(5)
        got = {(r["text"], r["position"], r["strand"]): r["memory"] for r in mix.gate_memory(df, "text", mix.Gate(), "x").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t in ("long", "b", "c"):
        names, given = sorted({s for x, _, s, _ in rows if x == t}), {(k, s): p for x, k, s, p in rows if x == t}
        at = sorted({k for k, _ in given})
        memory, _ = mix.remembered(np.array([[given.get((k, s), 0.0) for s in names] for k in at]), mix.Gate(), names.index("x"))
        want |= {(t, k, s): memory[i][j] for i, k in enumerate(at) for j, s in enumerate(names)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def neighbours(spark, rows):
    return spark.createDataFrame([(1, k, 10 + k, rank, 0.95 - 0.01 * rank, weight, True, row, offset, 0.0) for k, rank, weight, row, offset in rows], "gen long, k long, token long, rank int, score double, weight double, matches boolean, row long, offset long, loss double")


def partition_table(spark, sizes):
    return spark.createDataFrame([(i, f"d{i}", 0, n) for i, n in enumerate(sizes)], "row long, document_id string, partition_index int, token_count int")


def test_spans_chains_and_breaks(spark):
    parts = partition_table(spark, [50, 50])
    rows = [(k, 1 + (k > 4), 0.9, 0, 6 + k) for k in range(4, 8)]
    chains = cite.chains(neighbours(spark, rows), parts)
    assert [(r["start"], r["length"], r["offset"]) for r in chains.collect()] == [(4, 4, 10)]
    broken = [(k, 4 if k == 5 else 1, 0.9, 0, 6 + k) for k in range(4, 8)]
    assert cite.chains(neighbours(spark, broken), parts).count() == 0
    past = [(k, 1, 0.9, 0, 46 + k) for k in range(1, 6)]  # offsets 47 to 51 of 50 tokens
    assert [(r["start"], r["length"]) for r in cite.chains(neighbours(spark, past), parts).collect()] == [(1, 3)]
    cited = cite.citations(neighbours(spark, past), parts)
    assert {r["k"] for r in cited.collect()} == {1, 2, 3}


def test_greedy_selection_keeps_alternatives(spark):
    parts = partition_table(spark, [50, 50])
    rows = [(k, 1, 0.6, 0, 3 + k) for k in range(0, 6)] + [(k, 2, 0.4, 1, 20 + k) for k in range(2, 6)] + [(k, 1, 0.9, 1, 30 + k) for k in range(8, 12)]
    chosen = cite.spans(cite.chains(neighbours(spark, rows), parts), parts).orderBy("span").collect()
    assert [(r["row"], r["start"], r["length"], r["alternatives"]) for r in chosen] == [(0, 0, 6, [1]), (1, 8, 4, [])]
    marks = cite.markers(cite.spans(cite.chains(neighbours(spark, rows), parts), parts)).orderBy("end").collect()
    assert [(r["end"], r["number"]) for r in marks] == [(5, 1), (11, 2)]
    c = cite.span_confidence(cite.spans(cite.chains(neighbours(spark, rows), parts), parts), cite.citations(neighbours(spark, rows), parts)).collect()
    assert all(0 < r["confidence"] <= r["mean_confidence"] <= 1 for r in c)


def test_verification_statuses(spark):
    from tessera.functions.text import sha256, words

    spans = spark.createDataFrame([("a", 0, "one two three", 1, ["two"]), ("a", 1, "four five", 0, ["five"]), ("b", 0, "gone", 0, ["gone"]), ("c", 0, "old text", 0, ["old"]), ("a", 0, "one two three", 9, ["x"])], "document_id string, partition_index int, was string, offset int, tokens array<string>")
    spans = spans.withColumn("sha", sha256(F.col("was"))).withColumn("span_text", F.lit("-"))
    live = spark.createDataFrame([("a", 0, "one two three"), ("a", 1, "four five"), ("c", 0, "new text")], "document_id string, partition_index int, text string")
    got = sorted((r["document_id"], r["partition_index"], r["offset"], r["status"]) for r in cite.verified(spans, live, words).collect())
    assert got == [("a", 0, 1, "verified"), ("a", 0, 9, "mismatch"), ("a", 1, 0, "mismatch"), ("b", 0, 0, "missing"), ("c", 0, 0, "stale")]


def test_following_and_credit(spark):
    advances = spark.createDataFrame([(1, "a", 6, 8), (1, "b", 2, 8), (2, "a", 6, 8), (2, "b", 5, 8), (3, "a", 3, 8), (4, "a", 0, 8)], "w int, strand string, advances long, content long")
    got = {r["w"]: (r["followed"], r["tied"]) for r in cite.followed(advances, ["w"]).collect()}
    assert got == {1: ("a", []), 2: (None, ["a", "b"]), 3: (None, [])}
    shares = spark.createDataFrame([(w, 0, s, c, "content") for w in (1, 2, 3) for s, c in (("a", 0.2), ("b", 0.5), ("commons", 0.3))], "w int, k int, strand string, credit double, role string")
    credit = {(r["w"], r["strand"]): round(r["credit"], 6) for r in cite.followed_credit(shares, cite.followed(advances, ["w"]), ["w"], ["w", "k"]).collect()}
    assert credit == {(1, "a"): 0.7, (1, "b"): 0.0, (1, "commons"): 0.3, (2, "a"): 0.35, (2, "b"): 0.35, (2, "commons"): 0.3, (3, "a"): 0.2, (3, "b"): 0.5, (3, "commons"): 0.3}


def runs_by_hand(text, hits, tokens_at):
    """Runs of one text: {(document, line): [(first, last)]}, from matching seeds on as long as tokens agree."""
    found = {}
    for j, here in enumerate(hits[:-1]):
        for d, p in here[:4]:
            own = found.setdefault((d, p - j), [])
            if any(a <= j <= b for a, b in own) or tokens_at(d, p + 1) != text[j + 1]:
                continue
            last = j
            while last + 2 < len(text) and tokens_at(d, p - j + last + 2) == text[last + 2]:
                last += 1
            own.append((j, last))
    return {k: v for k, v in found.items() if v}


def lengths_by_hand(text, hits, tokens_at):
    """Chain lengths of one text from its runs: each taken over once, by the first run of its document that begins soon after it."""
    runs = [(a, b, d, line) for (d, line), own in runs_by_hand(text, hits, tokens_at).items() for a, b in own]
    long = [r for r in runs if r[1] - r[0] >= 7]
    taken = {}
    for x in long:
        able = [y for y in long if y[2] == x[2] and 0 <= y[0] - x[1] - 1 <= 8 and 0 <= y[0] + y[3] - x[1] - x[3] - 1 <= 8]
        if able:
            taken.setdefault(min(able, key=lambda y: (y[0], y[3])), []).append(x)
    before = {}
    for y in sorted(long):
        if y in taken:
            x = max(taken[y], key=lambda x: (x[1] - x[0], x[1], -x[3]))
            before[y] = x[1] - x[0] + 1 + before.get(x, 0)
    out = [0] * len(text)
    for r in runs:
        for j in range(r[0], r[1] + 1):
            out[j + 1] = max(out[j + 1], j - r[0] + 1 + (before.get(r, 0) if j - r[0] >= 7 else 0))
    return out


THREE = {d: [1000 * (d + 1) + i for i in range(n)] for d, n in enumerate((60, 40, 140))}


def follow(spark, *texts):
    """The chain lengths of texts over three documents whose tokens are theirs alone; each hit is the token's own entry."""
    at = {t: (d, p) for d, ts in THREE.items() for p, t in enumerate(ts)}
    entries = spark.createDataFrame([(d, p, ts[p + 1]) for d, ts in THREE.items() for p in range(len(ts) - 1)], "document long, position int, value long")
    hits = lambda t: [(*at[t], t + 1)] if t in at and t + 1 in at else []
    steps = spark.createDataFrame([(i, j, t, hits(t)) for i, text in enumerate(texts) for j, t in enumerate(text)], "text long, j long, token long, hits array<struct<document: long, position: int, value: long>>")
    found = {(r["text"], r["j"]): r["length"] for r in trajectory.tracked(steps, entries, "text").collect()}
    return [[found[i, j] for j in range(len(text))] for i, text in enumerate(texts)]


def test_chains_follow_a_document(spark):
    a, b, c = THREE.values()
    whole, phrases, junk, turned, across, far = follow(spark, a, a[:20] + b[:20], [9000] * 10, a[15:30] + a[:15] + a[30:45], a[45:60] + b[:15], c)
    assert whole == list(range(60)) and max(phrases) == 19 and junk == [0] * 10
    assert max(turned) <= 15 and max(across) == 14 and far == list(range(140))


def test_chains_bridge_a_changed_name(spark):
    a, _, c = THREE.values()
    renamed = [*c[:30], 9001, 9002, *c[32:60]]
    twice = [*c[:30], 9001, *c[31:60], 9002, *c[61:90]]
    name, distant, value, sentence, dropped, two = follow(spark, renamed, c[:30] + [9000] * 20 + c[30:60], [*a[:20], 9000, *a[21:41]], a[:20] + [9000] * 12 + a[32:52], a[:20] + a[22:42], twice)
    assert name[29] == 29 and name[31] == 0 and name[-1] == 29 + 27
    assert distant[-1] == 29 and max(value) == 38 and max(sentence) == 19 and max(dropped) == 38
    assert two[-1] == 29 + 28 + 28 and two[29 + 2 + 6] == 6 and two[29 + 2 + 8] == 29 + 8


def track_by_hand(texts, documents_, rule=(8, 4, 2, 1), k=16):
    """Chain lengths by plain loops over a whole index: documents and texts as lists of tokens by id."""
    of = {}
    for d, ts in sorted(documents_.items()):
        for p in range(len(ts) - 1):
            of.setdefault(ts[p], []).append((d, p))
    found = {}
    for i, text in texts.items():
        hits = []
        for j, t in enumerate(text):
            level = lambda d, p, j=j, text=text: next(n for n in rule if n <= p + 1 and n <= j + 1 and documents_[d][p + 1 - n : p + 1] == text[j + 1 - n : j + 1])
            hits.append([at for _, at in sorted((-level(*at), at) for at in of.get(t, []))[:k]])
        lengths = lengths_by_hand(text, hits, lambda d, p: documents_[d][p] if 0 <= p < len(documents_[d]) else None)
        found |= {(i, j): n for j, n in enumerate(lengths)}
    return found


def test_trajectory_state_is_the_whole_index(spark, sf):
    from tessera.queries import base, citation

    def lists(df, i):
        out = {}
        for r in df.orderBy(i, "pos").collect():
            out.setdefault(r[i], []).append(r["token"])
        return out

    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    held = {d: ts for d, ts in lists(base.tokens(spark, sf), "doc_id").items() if d in good}
    got = {(r["item_id"], r["j"]): r["length"] for r in citation.trajectory_state(spark, sf).collect()}
    assert got == track_by_hand(lists(base.prompts(spark, sf), "item_id"), held)


def test_tracked_follows_a_late_passage_of_common_tokens(spark):
    random = np.random.RandomState(3)
    held = {d: [int(t) for t in random.randint(0, 12, 50)] for d in range(60)}
    texts = {1: held[57][5:45], 2: held[58][:20] + held[31][10:30], 3: [99, 98]}
    rows = [(d, p, ts[p], ts[p + 1]) for d, ts in held.items() for p in range(49)]
    entries = spark.createDataFrame(rows, "document long, position int, token long, value long").repartition(5)
    steps = spark.createDataFrame([(i, j, t) for i, ts in texts.items() for j, t in enumerate(ts)], "text long, j int, token long")
    hits = trajectory.retrieved(steps, entries, "text")
    every = steps.join(hits, ["text", "j"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
    got = {(r["text"], r["j"]): r["length"] for r in trajectory.tracked(every, entries, "text").collect()}
    assert got == track_by_hand(texts, held)
    assert got[1, 39] > 30 and got[3, 1] == 0


def test_wire_lengths_agree_with_a_loop(spark):
    random = np.random.RandomState(2)
    rows = [(1, j, int(e), 0) for j in range(40) for e in set(random.randint(0, 12, 5) + j)]
    df = spark.createDataFrame([(t, j, e, d, True) for t, j, e, d in rows], "text long, j long, entry long, document long, expected boolean")
    chains, want = {}, {}
    for j in range(40):
        now = {e for _, k, e, _ in rows if k == j}
        chains = {e: chains.get(e - 1, 0) + 1 for e in now}
        want[j + 1] = max(chains.values())
    assert {r["j"]: r["length"] for r in trajectory.wire_lengths(df, "text").collect()} == want


def test_neighbours_of_more_queries_than_a_block(spark, monkeypatch):
    v = np.random.RandomState(1).randn(90, 6)
    e = spark.createDataFrame([(i, v[i].tolist(), i % 4) for i in range(90)], "entry long, vector array<double>, grp long")
    q = e.where("entry % 2 = 0").withColumnRenamed("entry", "query")
    key = lambda other=None: sorted((r["query"], r["rank"], r["entry"], r["score"]) for r in index.neighbours(q, e, 5, other=other).collect())
    apart = F.col("grp") != F.col("q_grp")
    want = key(), key(apart)
    monkeypatch.setattr(index, "MOST_QUERIES", 7)
    assert (key(), key(apart)) == want and len(want[0]) == 45 * 5


def test_positions_over_breaks(spark):
    parts = spark.createDataFrame([("d", 0, 3), ("d", 1, 2), ("d", 2, 4)], "doc string, i int, n int")
    got = [(r["start"], r["length"]) for r in trajectory.positions(parts, "doc", "i", "n", 2).orderBy("i").collect()]
    assert got == [(0, 13), (5, 13), (9, 13)]
    assert [r["start"] for r in trajectory.positions(parts, "doc", "i", "n").orderBy("i").collect()] == [0, 3, 5]


def test_blocked_neighbours_are_the_cross_join(spark):
    random = np.random.RandomState(0)
    v = random.randn(200, 8)
    v[50:60] = v[40:50]  # ties
    e = spark.createDataFrame([(i, v[i].tolist(), i % 5) for i in range(200)], "entry long, vector array<double>, grp long").repartition(7)
    q = e.where("entry % 10 = 0").select(F.col("entry").alias("query"), "vector", F.lit(None).cast("long").alias("grp"))
    a = index.neighbours(q.drop("grp"), e.drop("grp"), 6).select("query", "entry", "score", "rank")
    key = lambda df: sorted((r["query"], r["rank"], r["entry"], r["score"]) for r in df.collect())
    assert key(a) == key(index.blocked_neighbours(q, e, 6, block=7).select("query", "entry", "score", "rank"))
    apart = index.blocked_neighbours(q.drop("grp").join(e.select(F.col("entry").alias("query"), "grp"), "query"), e, 6).join(e.select("entry", "grp"), "entry").collect()
    assert apart and all(r["grp"] != r["query"] % 5 for r in apart)


def test_routing_by_rare_bigrams(spark):
    sketches = spark.createDataFrame([(f"n{i}", 1) for i in range(8)] + [("n2", 7), ("n3", 9), ("n4", 9)], "node string, key long")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(8)], "node string")
    prompts = spark.createDataFrame([("rare", 7), ("rare", 1), ("two", 9), ("common", 1), ("none", 55)], "prompt string, key long")
    got = {}
    for r in index.route(prompts, sketches, nodes, "prompt", "node").collect():
        got.setdefault(r["prompt"], set()).add(r["node"])
    assert got["rare"] == {"n2"} and got["two"] == {"n3", "n4"} and len(got["common"]) == len(got["none"]) == 8


def test_partition_stats_of_lists(spark):
    """Lists are measured as rows are: none, unknown, not a number, huge, equal and unequal neighbours; no position is shuffled."""
    nan = float("nan")
    lists = {1: [], 2: None, 3: [None], 4: [0.05], 5: [0.3, 0.01, None, 0.2], 6: [nan, 0.1, 0.09], 7: [1e13, 0.1, 2.5], 8: [k % 7 / 1000 for k in range(30)], 9: [-0.5, 123456789.123456, 0.1] * 7}
    kind = "row int, loss array<double>, entropy array<double>"
    own = spark.createDataFrame([(k, v, v and [x and x / 2 for x in v]) for k, v in lists.items()], kind)
    rows = lambda df: df.select("row", F.explode(F.arrays_zip("loss", "entropy")).alias("p")).select("row", "p.loss", "p.entropy")
    parts = spark.createDataFrame([(k,) for k in range(11)], "row int")
    told = lambda df: {r[0]: [x if x is None else repr(round(x, 12)) for x in r[1:3]] + [x if x is None else repr(round(float(x), 9)) for x in r[3:]] for r in ledger.partition_stats(df, parts).collect()}
    got = told(own)
    assert got == told(rows(own)) and len(got) == 11 and got[1] == got[2] == [None] * 6
    assert got[5] == ["4", "0.17", "0.085", "0.3", "0.28", "0.333333333"]
    plan = ledger.partition_stats(own, parts)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    halves = spark.createDataFrame([(5, [0.3, 0.01], [0.15, 0.005]), (5, [None, 0.2], [None, 0.1])], kind)
    assert told(halves)[5] == got[5]


def test_stream_in_two_levels(spark):
    sizes = {i: (i * 7) % 11 + 1 for i in range(50)}
    tokens = spark.createDataFrame([(d, p, d * 100 + p) for d, n in sizes.items() for p in range(n)], "doc long, pos int, token long")
    rows = sorted((r["at"], r["token"]) for r in index.stream(tokens, "doc", -1).collect())
    want = [-1]
    for d, n in sizes.items():
        want += [d * 100 + p for p in range(n)] + [-1]
    assert rows == list(enumerate(want))
    assert {r["k"]: r["start"] for r in index.running_start(spark.createDataFrame(list(sizes.items()), "k long, n long"), "k", F.col("n"), width=7).collect()} == {d: sum(sizes[x] for x in range(d)) for d in sizes}


def test_kmeans_finds_clusters(spark):
    random = np.random.RandomState(3)
    rows = [(i, "t", (np.eye(4)[i % 3] * 10 + random.randn(4) * 0.1).tolist(), 1.0 + i % 2) for i in range(90)] + [(99, "t", [50.0] * 4, 0.0)]
    found = index.centroids(spark.createDataFrame(rows, "id long, t string, v array<double>, w double"), "t", "v", "w", 3).collect()
    assert sorted(int(np.argmax(r["vector"])) for r in found) == [0, 1, 2] and sum(r["mass"] for r in found) == pytest.approx(sum(r[3] for r in rows))


def test_ledger_rules(spark):
    losses = spark.createDataFrame([([0.05, 0.01],), ([],), ([0.05, float("nan")],), ([0.2],)], "l array<double>")
    assert [r[0] for r in losses.select(ledger.all_memorised(F.col("l"))).collect()] == [True, True, False, False]
    epochs = spark.createDataFrame([("r", 1, 10, 0.5), ("r", 2, 10, 0.96), ("r", 3, 10, 0.9), ("s", 1, 5, 0.1)], "run string, epoch int, steps int, memorised double")
    assert [r["memorised_at"] for r in ledger.memorised_at(epochs, "run").where("run = 'r'").orderBy("epoch").collect()] == [None, 2, 2]
    assert {r["run"]: r["steps"] for r in ledger.steps_to(epochs, "run", "memorised", 0.95).collect()} == {"r": 20, "s": None}


def test_arm_rule_by_example(spark):
    def rows(arm, place, candidate, exact=True, gate=0.5, fid=0.9):
        return [(arm, place, candidate, s, f"{s}{i}", exact, True, True, True, gate, fid, 1) for s in ("facts", "pairs", "unknown", "generic") for i in range(4)]

    schema = "arm string, place int, candidate boolean, `set` string, example string, exact boolean, leads boolean, cited boolean, all_asked boolean, gate double, fidelity_sum double, fidelity_tokens int"
    df = spark.createDataFrame(rows("posterior", 0, False) + rows("x", 1, True, fid=0.89) + rows("y", 2, True, fid=0.9) + rows("z", 3, True, gate=0.7, fid=0.99) + rows("w", 4, True, exact=False), schema)
    arms = rules.gate_arms(df, "posterior")
    assert {r["arm"]: r["eligible"] for r in arms.collect()} == {"x": True, "y": True, "z": False, "w": False}
    assert rules.winner(arms).first()["winner"] == "x"


def test_fidelity_and_comparison(spark):
    shares = spark.createDataFrame([(1, "a", 0.5, 0.9), (1, "b", 0.5, 0.8), (2, "a", 1.0, 0.9), (2, "b", None, 0.7), (3, "a", 1.0, 0.1)], "k int, strand string, share double, alone double")
    assert {r["k"]: r["fidelity"] for r in evaluate.fidelity(shares, ["k"]).collect()} == {1: 1.0, 2: 0.5}
    a = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.5), (2, 1, 7, 0.1)], "p int, k int, token int, share double")
    b = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.4), (2, 2, 7, 0.1)], "p int, k int, token int, share double")
    assert {r["p"]: r["identical"] for r in evaluate.compared(a, b, ["p", "k"], "token", "share", ["p"]).collect()} == {1: True, 2: False}


def test_lineage_and_registry(spark):
    from tessera.sources import store

    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x")], "sha string, parent string")
    assert sorted((r["depth"], r["sha"]) for r in corpus.lineage(chain, "c").collect()) == [(0, "c"), (1, "b"), (2, "a")]
    slots = spark.createDataFrame([("s", "p1", 5, None), ("t", "p3", 1, True)], "slot string, sha string, created int, current boolean")
    loose = spark.createDataFrame([("s", "p0", 1), ("t", "p3", 1)], "slot string, sha string, created int")
    assert {r["sha"] for r in store.registry(slots, loose.withColumn("current", F.lit(None).cast("boolean"))).where("current").collect()} == {"p0", "p3"}


def test_mentions_by_the_rarest_word(spark):
    docs = spark.createDataFrame([(1, "the Old Mill stands by the Old Bridge"), (2, "an Old Mill and the Old Millers there"), (3, "Mill Old"), (4, "the hOld Mill"), (5, None), (6, "")], "doc long, text string")
    subjects = spark.createDataFrame([("Old Mill", 1), ("the Old Bridge", 9), ("Mill", 2), ("nowhere at all", 1)], "subject string, owner long")
    found = {(r["subject"], r["document_id"]) for r in corpus.mentions(subjects, docs, "subject", "owner", "doc", "text").collect()}
    assert found == {("Old Mill", 2), ("the Old Bridge", 1), ("Mill", 1), ("Mill", 3), ("Mill", 4)}


def test_mentions_fetch_a_text_once_for_all_owners(spark):
    import re

    docs = spark.createDataFrame([(i, "the Old Mill") for i in range(5)], "doc long, text string")
    subjects = spark.createDataFrame([("Old Mill", 100 + i) for i in range(40)] + [("Old Mill", 1), ("Mill", 1)], "subject string, owner long")
    found = corpus.mentions(subjects, docs, "subject", "owner", "doc", "text")
    assert found.count() == 40 * 5 + 4 + 4 and found.distinct().count() == found.count()
    last = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert re.search(r"owner#\d+L?\)*$|subject#\d+ = subject#\d+", last) and "_t" not in last


def test_units_meet_their_document_as_strings(spark):
    from tessera.operators import samples

    lists = {1: [["a", "b"], ["c"]], 2: [["a\0b"], ["c"]], 3: [[], ["", "x"]], 4: [["a"], ["b"]], 5: [[], []], 6: [["\1"], ["\0\2"]]}
    wholes = {1: ["a", "b", "c"], 2: ["a", "b\0c"], 3: ["", "x"], 4: ["b", "a"], 5: [], 6: ["\1", "\0\2"], 7: ["none"]}
    units = spark.createDataFrame([(d, i, u) for d, us in lists.items() for i, u in reversed(list(enumerate(us)))], "d int, i int, u array<string>")
    docs = spark.createDataFrame(list(wholes.items()), "d int, w array<string>")
    found = samples.joined_again(units, docs, "d", "i", "u", "w")
    assert {r["d"]: r["exact"] for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    # No list of tokens is shuffled.
    assert "array" not in " ".join(str(x) for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_token_f1_counts_words_where_their_texts_are(spark):
    pairs = spark.createDataFrame([(1, "a a b", "A c"), (2, None, "x"), (3, "", None), (4, "x y", "x y"), (5, "p", "q"), (6, "k k", "k"), (6, "l", "l k"), (None, "n", "n")], "i int, a string, b string")
    found = evaluate.token_f1(pairs, ["i"], "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {r["i"]: r["f1"] for r in found.collect()}
    assert got == {1: pytest.approx(2 / 5), 2: 0.0, 4: 1.0, 5: 0.0, 6: 1.0, None: 1.0}
    assert evaluate.token_f1(pairs.where("i = 3"), ["i"], "a", "b").count() == 0


@pytest.mark.parametrize(("n", "bits"), [(1, 16), (2, 16), (2, 32), (3, 16)])
def test_ngram_counts_are_those_of_the_rows(spark, n, bits, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b A, b", "x"), (2, None, "x"), (3, "", "y"), (4, "one", "y"), (5, "été b a", None), (6, "b a b", "y"), (7, "two words", "x")], "d long, t string, s string").coalesce(1)
    rows = index.ngrams(index.tokens(docs, "d", "t", "s", ahead=2), "d", n, bits)
    want = {(r["d"], r["s"], r["key"]): r["count"] for r in rows.groupBy("d", "s", "key").count().collect()}
    monkeypatch.setattr(index, "TEXTS_AT_ONCE", 2)
    counts = index.ngram_counts(docs, "d", "t", "s", n=n, bits=bits)
    assert {(r["d"], r["s"], r["key"]): r["n"] for r in counts.collect()} == want and want
    shared = {(r["key"], r["documents"]) for r in index.shared_ngrams(rows, "d").collect()}
    found = index.shared_ngrams(counts, "d")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert {(r["key"], r["documents"]) for r in found.collect()} == shared
    told = lambda g: {r["d"]: r["distinctiveness"] for r in cite.distinctiveness(g, index.shared_ngrams(g, "d"), ["d"]).collect()}
    assert told(counts) == pytest.approx(told(rows))


def test_hashes_of_streamed_groups(spark):
    import hashlib

    parts = spark.createDataFrame([(f"d{i % 7}", i // 7, f"s{i}", "xy"[i % 2]) for i in range(500)], "document_id string, partition_index int, sha string, node string").repartition(9)
    rows = sorted((r["document_id"], r["partition_index"], r["sha"], r["node"]) for r in parts.collect())
    want = lambda node: hashlib.sha256("".join(f"{d}\t{i}\t{s}\n" for d, i, s, n in rows if node in (None, n)).encode()).hexdigest()
    assert corpus.corpus_hash(parts).first()["corpus_hash"] == want(None)
    assert {r["node"]: r["corpus_hash"] for r in corpus.corpus_hash(parts, ("node",)).collect()} == {"x": want("x"), "y": want("y")}
    assert corpus.corpus_hash(parts.limit(0)).first()["corpus_hash"] == hashlib.sha256(b"").hexdigest() and corpus.corpus_hash(parts.limit(0), ("node",)).count() == 0


def test_ring_peers(spark):
    nodes = spark.range(5).withColumnRenamed("id", "p")
    found = {(r["i"], r["j"]) for r in corpus.peers(nodes, "p", F.lit(5), 2).collect()}
    assert found == {(i, (i + k) % 5) for i in range(5) for k in (1, 2)}
    assert {(r["i"], r["j"]) for r in corpus.peers(nodes, "p", F.lit(5), 9).collect()} == {(i, j) for i in range(5) for j in range(5) if i != j}


def test_tokens_know_what_follows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, ""), (4, None)], "doc long, text string")
    plain, ahead = index.tokens(docs, "doc", "text"), index.tokens(docs, "doc", "text", ahead=2)
    key = lambda t: sorted((r["doc"], r["pos"], r["key"]) for r in index.ngrams(t, "doc", 3, 16).collect())
    assert key(plain) == key(ahead) and len(key(plain)) == 2
    assert sorted(map(tuple, index.transitions(plain, "doc").select("doc", "pos", "token", "next").collect())) == sorted(map(tuple, index.transitions(ahead, "doc").select("doc", "pos", "token", "next").collect()))
    assert "Exchange" not in index.ngrams(ahead, "doc", 3, 16)._jdf.queryExecution().executedPlan().toString()


def test_citations_of_equal_weight_tie_in_any_order_of_rows(spark):
    hit = lambda row, weights: [("g", 0, 1, row * 10 + i, 0.6, w, True, row, i, 0.0) for i, w in enumerate(weights)]
    rows = hit(2, [0.1, 0.2, 0.3]) + hit(1, [0.3, 0.2, 0.1]) + hit(3, [float("nan")])
    near = spark.createDataFrame(rows, "gen string, k int, token int, rank int, score double, weight double, matches boolean, row int, offset int, loss double").coalesce(1)
    parts = spark.createDataFrame([(r, r, 0, 9) for r in (1, 2, 3)], "row int, document_id int, partition_index int, token_count int")
    found = {r["row"]: r for r in cite.citations(near, parts).collect()}
    assert found[1]["weight"] == found[2]["weight"] and found[1]["place"] < found[2]["place"] and math.isnan(found[3]["weight"])


def test_neighbours_meet_a_cell_in_slices(spark, monkeypatch):
    """However many queries a block has, a product of matrices takes a part of them, and each keeps its own best."""
    one = index.nearest_in_cell

    def held(ids, *rest):
        assert len(ids) <= 128
        return one(ids, *rest)

    monkeypatch.setattr(index, "nearest_in_cell", held)
    e = spark.range(300).select(F.col("id").alias("entry"), F.array(F.cos(F.col("id") / 60), F.sin(F.col("id") / 60)).alias("vector"), F.lit(None).cast("long").alias("grp"))
    found = index.blocked_neighbours(e.withColumnRenamed("entry", "query"), e, 1, digits=12).collect()
    assert len(found) == 300 and all(r["query"] == r["entry"] for r in found)


def test_lines_are_hashed_from_packs(spark, monkeypatch):
    """What comes to the task of a group are packs of sorted lines, from which every byte is got back: with digests, without and empty."""
    monkeypatch.setattr(corpus, "PACK", 1000)
    line = [f"{k}\t" + ("ab" * 32) * (k % 3) + ("" if k % 5 else "c" * 63 + "\0é\n") for k in range(500)]
    rows = spark.createDataFrame([(k % 2, k, x) for k, x in enumerate(line)], "g int, k int, line string").repartition(7)
    made = corpus.packs(rows, ("g",), ["k"])
    assert 4 < made.count() < 100
    want = {g: hashlib.sha256("".join(line[g::2]).encode()).hexdigest() for g in (0, 1)}
    assert {r["g"]: r["h"] for r in corpus.streamed_hash(rows, ("g",), ["k"], "h").collect()} == want
    assert corpus.streamed_hash(rows, (), ["k"], "h").first()["h"] == hashlib.sha256("".join(line).encode()).hexdigest()
    assert corpus.streamed_hash(rows.limit(0), (), ["k"], "h").first()["h"] == hashlib.sha256(b"").hexdigest()
    assert all(corpus.expanded(*corpus.squeezed(x)) == x for x in (b"", b"a", b"0" * 64, b"0" * 200))


def test_starts_come_to_texts_before_words_do(spark):
    """A text's stream is that of its tokens, without an exchange or a sort of tokens by document."""
    docs = spark.createDataFrame([(7, "one two three"), (3, "four"), (5, None), (20_001, "five, five"), (9, " ")], "doc int, text string")
    made = index.text_stream(docs, "doc", "text", -1)
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, index.stream(index.tokens(docs, "doc", "text"), "doc", -1).collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.text_stream(docs, "doc", "text", -1)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 <= plan.find("Generate") < plan.find("SortMergeJoin")
