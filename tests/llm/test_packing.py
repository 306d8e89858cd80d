import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import TEXTS, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import WINDOW, Encoder, pack, plan, sequences, tokenizer_paths


def best_fit(lengths, window):
    """Best-fit decreasing, one piece at a time: the room that is left in every window."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used = defaultdict(list)
    for length, first, last, each, sequence, room in plan(histogram, 32):
        for r in range(first, last + 1):
            at = r - first
            used[sequence + at // each].append((32 - room + at % each * length, length))
    assert sorted(len([1 for x in used.values() for y in x if y[1] == n]) for n in histogram) == sorted(histogram.values())
    for pieces in used.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 32
    assert set(used) == set(range(len(used)))
    assert sorted(32 - sum(n for _, n in x) for x in used.values()) == best_fit(lengths, 32)


def test_round_trip(spark):
    packed = pack(docs(spark)).collect()
    full = Encoder(tokenizer_paths()).full
    want = sorted((str(i), [*full.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in TEXTS)
    pieces = defaultdict(list)
    for r in packed:
        assert r["length"] == len(r["ids"]) <= WINDOW and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[str(r["doc_id"])].append((r["start"], r["ids"], r["doc_tokens"]))
    got = []
    for i, own in pieces.items():
        copies = [t for j, t in TEXTS if str(j) == i]
        own.sort()
        for c in range(len(copies)):
            ids = [x for p in own[c :: len(copies)] for x in p[1]]
            assert len(ids) == own[0][2]
            got.append((i, ids))
    assert sorted(got) == want
    rows = sequences(pack(docs(spark))).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(len(ids) for _, ids in want) and max(len(r["ids"]) for r in rows) <= WINDOW


def test_empty_table(spark):
    assert pack(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["plain words", "été 漢字 🎉", "a <|endoftext|> b", "", "\n\n  x"])
def test_encoder_is_the_tokenizer(text):
    encode = Encoder(tokenizer_paths())
    assert encode(text) == encode.full.encode(text, add_special_tokens=False).ids


def test_op5_small(spark, sf):
    from tessera.llm.packing import op5

    rows = op5(spark, sf).toPandas()
    by = rows.sort_values("offset").groupby("sequence_id")
    assert (by["length"].sum() <= WINDOW).all() and len(by) == rows["sequence_id"].max() + 1
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()


def test_ranks_give_the_tokenizers_ids():
    """Twenty thousand random texts below U+3400, and some with what goes through the tokenizer itself."""
    random = np.random.RandomState(11)
    encode = Encoder(tokenizer_paths())
    kinds = [(32, 127), (9, 14), (160, 0x250), (0x370, 0x530), (0x5D0, 0x700), (0x900, 0xE80), (0x2000, 0x2070), (0x2070, 0x3400)]
    texts = []
    for _ in range(20_000):
        parts = []
        for _ in range(random.randint(1, 6)):
            low, high = kinds[random.choice(len(kinds), p=[0.5, 0.1, 0.1, 0.08, 0.05, 0.05, 0.06, 0.06])]
            parts.append("".join(map(chr, random.randint(low, high, random.randint(1, 8)))))
        texts.append(random.choice(["", " ", "  ", "\n", "'"]).join(parts))
    texts += ["漢字とかな", "🎉 party", "<|endoftext|>", "a\u3400b", "it's we'll I'd", "\ufeffx", ""]
    want = [e.ids for e in encode.full.encode_batch(texts, add_special_tokens=False)]
    assert [encode(t) for t in texts] == want
