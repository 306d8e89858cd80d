"""Benchmark decontamination: SimHash windows of the items' sizes, multi-index Hamming search, exact confirmation.

A benchmark item of n words is searched with windows of a size from a fixed ladder, the greatest that leaves room for the
words that a similar copy may lack at its ends and an eighth of the item as play. Every such window of the item has a
fingerprint in the index; a document is fingerprinted at steps of the play, so that a window lies wholly inside any copy of
the item, cut ones too, and equals a window of the item where the copy is exact. Fingerprints are 64-bit SimHashes over
word pairs.

The index cuts fingerprints into four blocks of 16 bits. Two fingerprints within RADIUS = 15 bits agree up to 3 bits in at
least one block. A table per block lists, for each of its 65,536 values, the fingerprints within some of these bits, and a
search looks at all values within the rest of them: no fingerprint within the radius is missed, whatever the split. An index
lists as many bits as INDEX_BYTES allows, since long lists cost memory and many looks cost time. A benchmark beyond what fits
without lists takes several indexes. A candidate places the whole item in the document; the weighted Jaccard similarity of
the five-word shingles there, multiplicities as weights, decides, at the item's length and over the stretch around it in
which the item's shingles most outnumber others, which is longer or shorter where words were put in or left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_chunks, map_batches, mix, shingle_hashes, word_hashes

#: Production parameters of op9.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
#: Bytes of one index, which each task holds; a larger benchmark takes several. Indexes that tasks hold at once at most.
INDEX_BYTES, AT_ONCE = 128_000_000, 4
BLOCKS, BLOCK_BITS = 4, 16
#: Places around a candidate at which the item is tried, for words that were put in or left out.
SHIFTS = (0, -1, 1, -2, 2, -3, 3)

MATCHES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType()),
])


def ladder(limit: int) -> list[int]:
    """Window sizes up to `limit`: each a fifth above the last."""
    sizes = [1]
    while sizes[-1] < limit:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 6 // 5))
    return sizes


def ends(words: int) -> int:
    """Words that a copy may lack at its ends at a similarity of SIMILARITY."""
    return int((1 - SIMILARITY) * max(0, words - SHINGLE + 1) + 1e-9)


def window_size(words: int) -> int:
    most = max(1, words - words // 8 - ends(words))
    return max(x for x in ladder(most) if x <= most)


def around(bits: int) -> np.ndarray:
    """What changes at most `bits` bits of a block."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint32)


def index_bytes(prints: int, words: int, sizes: int, bits: int) -> int:
    """About what an index of so many fingerprints, words and window sizes holds if its tables list `bits` bits."""
    return prints * (16 + 4 * BLOCKS * len(around(bits))) + 48 * words + sizes * 4 * BLOCKS * (2**BLOCK_BITS + 1)


def prints_of(words: int) -> int:
    return words - window_size(words) + 1 if words else 0


def pair_hashes(words: np.ndarray) -> np.ndarray:
    pairs = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        pairs[:-1] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return pairs


class Counters:
    """Running counts of the 64 bits of pair hashes, several in each 64-bit number.

    A lane holds the count of one bit. The running sums overflow from lane to lane, yet the difference of two of them is
    the packed counts of the window between, as long as no count of a window exceeds half a lane's range.
    """

    def __init__(self, words: np.ndarray, size: int):
        self.lane = next(b for b in (8, 16, 32) if size <= 1 << (b - 1))
        self.ones = np.uint64(sum(1 << k for k in range(0, 64, self.lane)))
        pairs = pair_hashes(words)
        self.sums = np.zeros((self.lane, len(words) + 1), np.uint64)
        for k in range(self.lane):
            np.cumsum((pairs >> np.uint64(k)) & self.ones, out=self.sums[k, 1:])

    def prints(self, starts, ends, pairs) -> np.ndarray:
        """SimHash of the windows from `starts` to `ends` (slices or positions), of `pairs` word pairs each."""
        out: np.ndarray | int = 0
        top = (1 << (self.lane - 1)) - 1
        lift = np.asarray(top - pairs // 2, np.uint64) * self.ones
        for k in range(self.lane):
            over = (self.sums[k][ends] - self.sums[k][starts] + lift) >> np.uint64(self.lane - 1)
            out = out | ((over & self.ones) << np.uint64(k))
        return out


class Index:
    """Fingerprints of all windows of the items, by window size, with a table per block.

    The tables list as many bits around a block's value as `most` bytes allow; a search tries the rest.
    """

    def __init__(self, ids: list[int], texts: list[str], shingle: int, radius: int, most: int = INDEX_BYTES):
        words, sizes = word_hashes(pa.array(texts, pa.string()))
        stops = np.cumsum(sizes)
        self.ids, self.shingle, self.radius = pa.array(ids, pa.int64()), shingle, radius
        self.words = [words[b - n : b] for n, b in zip(sizes, stops, strict=True)]
        self.sizes = sizes
        self.shingles = []
        for own in self.words:
            values, counts = np.unique(shingle_hashes(own, np.array([len(own)]), shingle)[0], return_counts=True)
            self.shingles.append((values, counts))
        self.known = np.unique(np.concatenate([v for v, _ in self.shingles])) if self.shingles else np.zeros(0, np.uint64)
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(sizes.tolist()):
            if n:
                by_size.setdefault(window_size(n), []).append(i)
        whole, prints, words = radius // BLOCKS, sum(prints_of(n) for n in sizes.tolist()), int(sizes.sum())
        bits = next((b for b in range(whole, 0, -1) if index_bytes(prints, words, len(by_size), b) <= most), 0)
        near, self.tried = around(bits), around(whole - bits)
        self.groups = []
        for size, items in sorted(by_size.items()):
            prints, owner, at = [], [], []
            for i in items:
                own = self.words[i]
                starts = np.arange(len(own) - size + 1)
                prints.append(Counters(own, size).prints(starts, starts + size - 1, size - 1) if size > 1 else mix(own))
                owner.append(np.full(len(starts), i, np.int32))
                at.append(starts.astype(np.int32))
            prints, owner, at = np.concatenate(prints), np.concatenate(owner), np.concatenate(at)
            tables = []
            for b in range(BLOCKS):
                value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint32)
                spread = (value[:, None] ^ near[None, :]).ravel()
                order = np.argsort(spread, kind="stable")
                first = np.zeros((1 << BLOCK_BITS) + 1, np.int32)
                np.cumsum(np.bincount(spread, minlength=1 << BLOCK_BITS), out=first[1:])
                tables.append((first, (order // len(near)).astype(np.int32)))
            step = min(self.sizes[i] - ends(int(self.sizes[i])) - size + 1 for i in items)
            self.groups.append((size, int(step), prints, owner, at, tables))

    def nbytes(self) -> int:
        """What all arrays of the index hold."""
        held = [*self.words, self.sizes, self.known, *[x for pair in self.shingles for x in pair]]
        for _, _, prints, owner, at, tables in self.groups:
            held += [prints, owner, at, *[x for table in tables for x in table]]
        return sum(x.nbytes for x in held)

    def near(self, prints: np.ndarray, tables, queries: np.ndarray):
        """All (query, fingerprint) within the radius, some of them more than once."""
        for b, (first, listed) in enumerate(tables):
            own = ((queries >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint32)
            for change in self.tried:
                value = (own ^ change).astype(np.int64)
                begin = first[value].astype(np.int64)
                count = first[value + 1] - begin
                ends = np.cumsum(count)
                done = 0
                while done < len(queries):
                    base = ends[done - 1] if done else 0
                    stop = max(done + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
                    n = count[done:stop]
                    query = np.repeat(np.arange(done, stop), n)
                    entry = np.arange(len(query)) + np.repeat(begin[done:stop] - (ends[done:stop] - n - base), n)
                    found = listed[entry]
                    hit = np.bitwise_count(queries[query] ^ prints[found]) <= self.radius
                    if hit.any():
                        yield query[hit], found[hit]
                    done = stop

    def search(self, texts: pa.Array, least: float) -> list[tuple[int, int, int, int, float]]:
        """The best place of each item in each text, if it is similar enough: text, item, first word, words, similarity."""
        words, sizes = word_hashes(texts)
        if not len(words) or not self.groups:
            return []
        stops = np.cumsum(sizes)
        begins = stops - sizes
        text = np.repeat(np.arange(len(sizes)), sizes)
        counters: dict[int, Counters] = {}
        places = []
        for size, step, prints, owner, at, tables in self.groups:
            if size > 1 and (found := next((c for c in counters.values() if size <= 1 << (c.lane - 1)), None)) is None:
                found = Counters(words, size)
                counters[found.lane] = found
            for starts, queries in self.windows(words, sizes, stops, text, found if size > 1 else None, size, step):
                for query, hit in self.near(prints, tables, queries):
                    at_text = text[starts[query]]
                    places.append(np.stack([at_text, owner[hit], starts[query] - begins[at_text] - at[hit]], axis=1))
        if not places:
            return []
        # A place needs about as many of the items' shingles as it has; only the few that do are compared in full.
        shingles, counts = shingle_hashes(words, sizes, self.shingle)
        spot = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        known = np.concatenate(([0], np.cumsum(self.known[spot] == shingles)))
        base = np.cumsum(counts) - counts
        t, i, place = np.unique(np.concatenate(places), axis=0).T
        reach = self.sizes[i] // 4 + max(SHIFTS)
        low = np.clip(place - reach, 0, counts[t])
        high = np.clip(place + reach + np.maximum(self.sizes[i] - self.shingle + 1, 1), low, counts[t])
        enough = (known[base[t] + high] - known[base[t] + low] >= least * (self.sizes[i] - self.shingle + 1) * 0.999) | (self.sizes[i] < self.shingle)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b, c in zip(t[enough].tolist(), i[enough].tolist(), place[enough].tolist(), strict=True):
            self.confirm(words[begins[a] : stops[a]], shingles[base[a] : base[a] + counts[a]], a, b, c, least, best)
        return [(a, b, start, n, similarity) for (a, b), (similarity, start, n) in sorted(best.items())]

    @staticmethod
    def windows(words, sizes, stops, text, counters, size: int, step: int):
        """Fingerprints of windows at every `step` words and at each text's end; texts a little shorter than a window as a whole."""
        if size == 1:
            yield np.arange(len(words)), mix(words)
            return
        last = len(words) - size
        if last >= 0:
            starts = np.arange(0, last + 1, step)
            inside = stops[text[starts]] >= starts + size
            queries = counters.prints(slice(0, last + 1, step), slice(size - 1, last + size, step), size - 1)
            yield starts[inside], queries[inside]
        ends = stops[sizes >= size] - size
        ends = ends[ends % step > 0]
        brief = (sizes < size) & (5 * sizes >= 4 * size) & (sizes > 1)
        if len(ends):
            yield ends, counters.prints(ends, ends + size - 1, size - 1)
        if brief.any():
            starts = (stops - sizes)[brief]
            yield starts, counters.prints(starts, stops[brief] - 1, sizes[brief] - 1)

    def confirm(self, words, shingles, text: int, item: int, place: int, least: float, best) -> None:
        values, weights = self.shingles[item]
        n, total = int(self.sizes[item]), int(weights.sum())

        def keep(here, start: int, number: int) -> float:
            spot = np.minimum(np.searchsorted(values, here), len(values) - 1)
            same = spot[values[spot] == here]
            common = int(np.minimum(np.bincount(same, minlength=len(values)), weights).sum())
            similarity = common / (total + len(here) - common)
            old = best.get((text, item))
            if similarity >= least and (old is None or (-similarity, start) < (-old[0], old[1])):
                best[text, item] = (similarity, start, number)
            return similarity

        for shift in SHIFTS:
            start, stop = max(0, place + shift), min(len(words), place + shift + n)
            if stop - start >= self.shingle:
                here = shingles[start : stop - self.shingle + 1]
            elif stop - start == n or stop - start == len(words):
                here = shingle_hashes(words[start:stop], np.array([stop - start]), self.shingle)[0]
            else:
                continue
            if keep(here, start, stop - start) == 1:
                return
        reach = n // 4 + max(SHIFTS)
        first = max(0, place - reach)
        around = shingles[first : place + reach + n - self.shingle + 1]
        if n < self.shingle or len(words) < self.shingle or not len(around):
            return
        spot = np.minimum(np.searchsorted(values, around), len(values) - 1)
        sums = np.concatenate(([0], np.cumsum(np.where(values[spot] == around, 1, -1))))
        stop = int(np.argmax(sums[1:] - np.minimum.accumulate(sums[:-1]))) + 1
        start = int(np.argmin(sums[:stop]))
        keep(around[start:stop], first + start, stop - start + self.shingle - 1)


def parts_of(benchmark: DataFrame, most: int, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in parts, each of which an index of about `most` bytes holds; items without words are left out.

    Parts are cut by a hash of the item, at half the bound if there are several. An item too long for the bound on its own
    has an index of its own length.
    """
    benchmark = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def sizes(batches):
        for part in in_chunks(batches, "text"):
            words = word_hashes(part.column("text"))[1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([prints_of(n) for n in words], pa.int64()), pa.array(words, pa.int64())], names=["prints", "words"])

    found = benchmark.select("text").mapInArrow(sizes, "prints long, words long")
    found = found.agg(F.coalesce(F.sum("prints"), F.lit(0)).alias("prints"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.max("words"), F.lit(0)).alias("longest")).first()
    fixed = index_bytes(0, 0, len(ladder(max(found["longest"], 1))), 0)
    moving = index_bytes(found["prints"], found["words"], 0, min(1, RADIUS // BLOCKS))
    if fixed + moving <= most:
        return [benchmark]
    number = -(-2 * moving // max(most - fixed, most // 4))
    return [benchmark.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == k) for k in range(number)]


def index_of(part: DataFrame, shingle: int, radius: int, most: int):
    """A broadcast index of a part that `parts_of` has cut to the bound."""
    rows = part.collect()
    return part.sparkSession.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], shingle, radius, most))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, most: int = INDEX_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Where benchmark items occur in documents: one row per document row and item, at the item's best place there.

    Columns: doc_id, item_id, start_word (from 0), n_words, similarity. Texts are lower-cased A-Z and cut into words
    `[^\\x20\\x09-\\x0D]+`. Documents without an item give no row. Null and empty texts, and items without words, match
    nothing; an item shorter than a shingle is one shingle and matches its exact words. Ids may be null or repeat. Each index
    is a pass over the documents; with several, each one's matches are a table before the next is built.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def finder(shared):
        def run(batches):
            for part in in_chunks(batches, "text"):
                found = shared.value.search(part.column("text"), least)
                if found:
                    text, item, start, n, similarity = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array(text, pa.int32())), shared.value.ids.take(pa.array(item, pa.int32())),
                        pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(similarity, pa.float64()),
                    ], names=MATCHES.names)

        return run

    parts = parts_of(benchmark, most, item_col, text_col)
    if len(parts) == 1:
        return docs.mapInArrow(finder(index_of(parts[0], shingle, radius, most)), MATCHES)
    scratch, found = Scratch(docs.sparkSession, "decontaminate"), []
    for k, part in enumerate(parts):
        shared = index_of(part, shingle, radius, most)
        found.append(scratch.save(docs.mapInArrow(finder(shared), MATCHES), f"matches{k}"))
        shared.destroy()
    return docs.sparkSession.read.schema(MATCHES).parquet(*[f"{scratch.path}/matches{k}" for k in range(len(parts))])


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, most: int = INDEX_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of `docs`, all their columns, that hold no benchmark item; the rules of `matches`.

    AT_ONCE indexes pass over the documents together; where there are more, what they leave is a table before the next ones.
    """
    schema = docs.schema

    def keeper(shared):
        def run(batches):
            for part in in_chunks(batches, text_col):
                drop = {row[0] for row in shared.value.search(part.column(text_col), least)}
                yield part.take(pa.array([i for i in range(part.num_rows) if i not in drop], pa.int32())) if drop else part

        return run

    parts = parts_of(benchmark, most, item_col, "text")
    scratch = Scratch(docs.sparkSession, "decontaminate") if len(parts) > AT_ONCE else None
    held = []
    for k, part in enumerate(parts):
        if len(held) == AT_ONCE:
            docs = scratch.save(docs, f"left{k}")
            scratch.drop(f"left{k - AT_ONCE}")
            for shared in held:
                shared.destroy()
            held = []
        held.append(index_of(part, shingle, radius, most))
        docs = map_batches(docs, keeper(held[-1]), schema)
    return docs


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
