"""Corpora as tables: partitions, snapshots and their differences, hashes, checks, selections.

A partition row is (document_id, partition_index, text, sha); a document row has a document_id and a node that owns it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.runs import longest_common
from tessera.functions.text import sha256, words
from tessera.operators.bounds import few
from tessera.sources.scratch import Scratch

KEY = ["document_id", "partition_index"]


def partitions(docs: DataFrame, document: str, text: str, *keep: str) -> DataFrame:
    """Non-empty lines of each document, numbered from 0, with their digest."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    out = docs.select(F.col(document).alias("document_id"), *keep, F.posexplode(lines).alias("partition_index", "text"))
    return out.withColumn("sha", sha256(F.col("text")))


def snapshot(parts: DataFrame) -> DataFrame:
    """One row: documents, partitions and the corpus hash. What is counted and hashed is read from a table, so that lines are cut once."""
    parts = Scratch(parts.sparkSession, "snapshot").save(parts.select(*KEY, "sha"), "parts")
    return parts.agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("partitions")).join(F.broadcast(corpus_hash(parts)))


#: Bytes of lines that `streamed_hash` packs into one row.
PACK = 1 << 20
DIGEST = re.compile(rb"[0-9a-f]{64}")


def squeezed(lines: bytes) -> tuple[bytes, bytes]:
    """Bytes as the digests in them, which don't compress, and what stands between, compressed after its lengths."""
    between = DIGEST.split(lines)
    lengths = np.array([len(x) for x in between], np.uint32)
    return bytes.fromhex(b"".join(DIGEST.findall(lines)).decode()), zlib.compress(lengths.tobytes() + b"".join(between))


def expanded(digests: bytes, rest: bytes) -> bytes:
    """What `squeezed` was given."""
    rest, digests, n = zlib.decompress(rest), digests.hex().encode(), len(digests) // 32 + 1
    ends = (np.cumsum(np.frombuffer(rest[: 4 * n], np.uint32), dtype=np.int64) + 4 * n).tolist()
    return b"".join([rest[a:b] + digests[64 * k : 64 * k + 64] for k, (a, b) in enumerate(zip([4 * n, *ends], ends, strict=False))])


def packs(lines: DataFrame, groups: tuple[str, ...], order: list[str]) -> DataFrame:
    """The column `line` of a group's rows in an order, compressed: groups, _part, _pack, _digests, _rest. A pack is about PACK bytes of lines.

    Groups and orders are cut into ranges together, which are sorted where they are packed.
    """
    schema = T.StructType([*[lines.schema[g] for g in groups], *[T.StructField(c, T.IntegerType()) for c in ("_part", "_pack")], *[T.StructField(c, T.BinaryType()) for c in ("_digests", "_rest")]])
    dealt = lines.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).select(*groups, F.spark_partition_id().alias("_part"), "line")

    def run(batches):
        key, held, size, made = None, [], 0, 0

        def row():
            own = [pa.array([k], t) for k, t in zip(key, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*own, pa.array([part], pa.int32()), pa.array([made], pa.int32()), *[pa.array([x], pa.binary()) for x in squeezed(b"".join(held))]], names=schema.names)

        for batch in batches:
            kinds = [batch.column(g).type for g in groups]
            part = batch.column("_part")[0].as_py() if batch.num_rows else None
            keys = zip(*[batch.column(g).to_pylist() for g in groups], strict=True) if groups else repeat((), batch.num_rows)
            for own, line in zip(keys, batch.column("line").to_pylist(), strict=True):
                if held and (own != key or size >= PACK):
                    yield row()
                    held, size, made = [], 0, made + 1
                key = own
                held.append((line or "").encode())
                size += len(held[-1])
        if held:
            yield row()

    return dealt.mapInArrow(run, schema)


def streamed_hash(lines: DataFrame, groups: tuple[str, ...], order: list[str], name: str) -> DataFrame:
    """SHA-256 over the column `line` of each group's rows in an order: one row per group, one in all without groups.

    A hash of a sorted whole is one after the other by its nature, so a group is one task. Its rows are sorted and packed
    before, over all tasks; what comes to the one are compressed packs, some thousandth as many, which pass through one at a time.
    """
    found = packs(lines, groups, order)
    sorted_ = (found.repartition(*groups) if groups else found.repartition(1)).sortWithinPartitions(*groups, "_part", "_pack")
    schema = T.StructType([*[lines.schema[g] for g in groups], T.StructField(name, T.StringType())])

    def run(batches):
        key, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key[0], kinds, strict=True)], pa.array([digest.hexdigest()])], names=schema.names)

        kinds = []
        for batch in batches:
            kinds = [batch.column(g).type for g in groups]
            keys = list(zip(*[batch.column(g).to_pylist() for g in groups], strict=True)) if groups else [()] * batch.num_rows
            for own, *pack in zip(keys, batch.column("_digests"), batch.column("_rest"), strict=True):
                if key is None or key[0] != own:
                    if key is not None:
                        yield row()
                    key, digest = (own,), hashlib.sha256()
                digest.update(expanded(*[x.as_py() for x in pack]))
        if key is not None:
            yield row()

    hashed = sorted_.select(*groups, "_digests", "_rest").mapInArrow(run, schema)
    return hashed if groups else hashed.agg(F.coalesce(F.max(name), sha256(F.lit(""))).alias(name))


def corpus_hash(parts: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 over lines `id TAB index TAB digest`, sorted by id and index: the same for any order of the rows."""
    line = F.concat(F.concat_ws("\t", "document_id", F.col("partition_index").cast("string"), "sha"), F.lit("\n"))
    return streamed_hash(parts.select(*groups, "document_id", "partition_index", line.alias("line")), groups, ["document_id", "partition_index", "line"], "corpus_hash")


def ordered_hash(df: DataFrame, order: str, text: Column, separator: str) -> DataFrame:
    """SHA-256 over texts in a stored order with a separator after each."""
    return streamed_hash(df.select(F.col(order).alias("_order"), F.concat(text, F.lit(separator)).alias("line")), (), ["_order", "line"], "hash")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Partitions added, removed or changed between two snapshots: document_id, partition_index, change."""
    old, new = before.select(*KEY, F.col("sha").alias("old")), after.select(*KEY, F.col("sha").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, KEY, "full_outer").select(*KEY, change.alias("change")).where("change IS NOT NULL")


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents that only one snapshot has."""
    old, new = before.select("document_id").distinct(), after.select("document_id").distinct()
    added, removed = new.join(old, "document_id", "left_anti"), old.join(new, "document_id", "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def problems(generated: DataFrame, stored: DataFrame) -> DataFrame:
    """What differs between a generated corpus and a stored one, in words; one row per partition that does."""
    old, new = generated.select(*KEY, F.col("sha").alias("want")), stored.select(*KEY, F.col("sha").alias("have"))
    where = F.concat(F.col("document_id").cast("string"), F.lit("#"), F.col("partition_index").cast("string"))
    problem = F.when(F.col("have").isNull(), F.concat(F.lit("missing "), where)).when(F.col("want").isNull(), F.concat(F.lit("unexpected "), where))
    problem = problem.when(F.col("want") != F.col("have"), F.concat(F.lit("text differs at "), where))
    return old.join(new, KEY, "full_outer").select(problem.alias("problem")).where("problem IS NOT NULL")


def update_plan(change: DataFrame, partitions: Column, has_live: Column, fraction: float = 0.05) -> Column:
    """Which updates a row of counts (added, changed, removed) calls for: none, reindex, train, or reindex and train."""
    grown = (F.col("added") + F.col("changed")) / F.greatest(partitions, F.lit(1))
    return (
        F.when(partitions <= 0, F.lit("none")).when(~has_live, F.lit("train"))
        .when(F.col("added") + F.col("changed") + F.col("removed") == 0, F.lit("none"))
        .when(grown >= fraction, F.lit("reindex+train")).otherwise(F.lit("reindex"))
    )


def present(deposits: DataFrame, withdrawals: DataFrame, key: str = "document_id") -> DataFrame:
    """Deposited and not withdrawn."""
    return deposits.join(withdrawals.select(key), key, "left_anti")


def exclusive(docs: DataFrame, links: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents on neither side of a link."""
    sides = links.select(F.explode(F.array("source", "target")).alias(key))
    return docs.join(sides, key, "left_anti")


def held_by_several(docs: DataFrame, content: str, node: str) -> DataFrame:
    """Contents that two or more nodes hold, with the sorted holders; the nodes of a content are few."""
    pairs = docs.select(content, node).distinct()
    return pairs.groupBy(content).agg(F.array_sort(F.collect_list(node)).alias("holders")).where(F.size("holders") > 1)


def shared_pairs(docs: DataFrame, content: str, node: str) -> DataFrame:
    """How many contents each two nodes share, and how many each has: a, b, shared, of_a, of_b."""
    held = docs.select(F.col(content).alias("_c"), F.col(node).alias("_n")).distinct()
    sizes = held.groupBy("_n").agg(F.count(F.lit(1)).alias("size"))
    # Nodes of one content are an array, so that a content held by few nodes never meets others.
    holders = held.groupBy("_c").agg(F.array_sort(F.collect_list("_n")).alias("h")).where(F.size("h") > 1)
    pairs = holders.select(F.posexplode("h").alias("i", "a"), "h").select("a", F.explode(F.slice(F.col("h"), F.col("i") + 2, F.size("h"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return counted.join(sizes.withColumnsRenamed({"_n": "a", "size": "of_a"}), "a").join(sizes.withColumnsRenamed({"_n": "b", "size": "of_b"}), "b")


def copy_pair(docs: DataFrame, content: str, node: str) -> DataFrame:
    """The two nodes that share most, if that is at least half of the smaller."""
    enough = shared_pairs(docs, content, node).where(2 * F.col("shared") >= F.least("of_a", "of_b"))
    return enough.orderBy(F.desc("shared"), "a", "b").limit(1)


def ordered_pairs(nodes: DataFrame, node: str) -> DataFrame:
    """All ordered pairs of different nodes. Nodes are few by their nature."""
    return nodes.select(F.col(node).alias("a")).join(few(nodes.select(F.col(node).alias("b"))), F.col("a") != F.col("b"))


def peers(nodes: DataFrame, position: str, number: Column, reach: int) -> DataFrame:
    """Ring peers: the next `reach` nodes after each. Every node names the places of its peers, which then meet the nodes there."""
    a = nodes.select(F.col(position).alias("i"), F.explode(F.sequence(F.lit(1), F.least(F.lit(reach), number - 1).cast("int"))).alias("_k")).withColumn("_at", F.pmod(F.col("i") + F.col("_k"), number))
    b = nodes.select(F.col(position).alias("j"), F.pmod(F.col(position), number).alias("_at"))
    return a.join(b, "_at").select("i", "j")


def mentions(subjects: DataFrame, docs: DataFrame, subject: str, owner: str, document: str, text: str) -> DataFrame:
    """Subjects that occur in documents other than their own.

    A subject occurs where its first word does as a whole word, and so do all its words but the last, which may go on. Of
    these the one that the fewest documents have is its key, so that common words bring nothing together; texts are then
    fetched once a document, whoever owns its subjects, and the full string decides.
    """
    owners = subjects.select(F.col(subject).alias("subject"), F.col(owner).alias("owner")).distinct()
    listed = words(F.col("subject"))
    wanted = owners.select("subject").distinct().select("subject", F.get(listed, F.lit(0)).alias("_first"), F.explode(F.slice(listed, 1, F.greatest(F.size(listed) - 1, F.lit(1)))).alias("_w")).distinct()
    there = docs.select(F.col(document).alias("document_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("_w"))
    there = Scratch(docs.sparkSession, "mentions").save(there.join(wanted.select("_w").distinct(), "_w", "left_semi"), "held")
    held = there.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    rarest = wanted.join(held, "_w", "left").groupBy("subject", "_first").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), F.col("_w")))["_w"].alias("_w"))
    # Subjects of a document are put together before its text is fetched, and owners of a subject are joined last.
    near = there.join(rarest, "_w").groupBy("document_id").agg(F.collect_list(F.struct("subject", "_first")).alias("_near"))
    texts = docs.select(F.col(document).alias("document_id"), F.col(text).alias("_t"))
    each = near.join(texts, "document_id").select("document_id", "_t", words(F.col("_t")).alias("_words"), F.explode("_near").alias("_s"))
    found = each.where(F.contains(F.col("_t"), F.col("_s.subject")) & F.array_contains("_words", F.col("_s._first"))).select("document_id", "_s.subject")
    return found.join(owners, "subject").where(F.col("document_id") != F.col("owner")).select("subject", "owner", "document_id")


def word_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Word sets of two texts: sizes and Jaccard."""
    wa, wb = F.array_distinct(words(F.col(a))), F.array_distinct(words(F.col(b)))
    both, either = F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))
    return pairs.select("*", F.size(wa).alias("words_a"), F.size(wb).alias("words_b"), F.when(either > 0, both / either).otherwise(0.0).alias("jaccard"))


#: Words of the pairs that one step of `longest_common_run` takes at once; longer pairs go alone.
RUN_WORDS = 200_000


def longest_common_run(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The most words in a row that two texts share: keys, run; pairs that share none, or lack a text, have no row.

    A pair is a row and stays where it is. Runs are told apart by ranks whose lengths double, so that texts of one word
    repeated take no longer than others.
    """
    rows = pairs.select(*keys, words(F.col(a)).alias("_a"), words(F.col(b)).alias("_b")).where("size(_a) > 0 AND size(_b) > 0")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("run", T.LongType())])

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [batch.column(c) for c in ("_a", "_b")]
        sizes = np.stack([pc.list_value_length(s).to_numpy() for s in sides], 1)
        flat = pa.concat_arrays([s.flatten() for s in sides])
        tokens = flat.dictionary_encode().indices.to_numpy()
        pair = np.concatenate([np.repeat(np.arange(len(sizes)), sizes[:, k]) for k in (0, 1)])
        left = np.concatenate([np.arange(n, 0, -1) for k in (0, 1) for n in sizes[:, k]])
        run = longest_common(tokens, pair, np.repeat([False, True], sizes.sum(0)), left, len(sizes))
        found = batch.select(keys).append_column("run", pa.array(run))
        return found.filter(pa.array(run > 0))

    def go(batches):
        for batch in batches:
            total = np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy() for c in ("_a", "_b")))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + RUN_WORDS, "right")))
                yield measured(batch.slice(start, end - start))
                start = end

    return rows.mapInArrow(go, schema)


def crossed(links: DataFrame, facts: DataFrame, docs: DataFrame, per_link: int) -> DataFrame:
    """The first facts of each link's target whose source document is there."""
    live = links.join(docs.select(F.col("document_id").alias("source")), "source", "left_semi")
    w = Window.partitionBy("link").orderBy("fact_id")
    return live.join(facts.withColumnRenamed("document_id", "target"), "target").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_link).drop("_k")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def resolve(registry: DataFrame, slot: str, sha: str, name: str, reference: str, shortest: int = 6) -> DataFrame:
    """What a reference names: a current slot, an exact digest, a unique name, or a unique prefix long enough."""

    def unique(condition: Column) -> Column:
        return F.when(F.countDistinct(F.when(condition, F.col(sha))) == 1, F.max(F.when(condition, F.col(sha))))

    current = F.max(F.when((F.col(slot) == reference) & F.col("current"), F.col(sha)))
    long = F.lit(len(reference) >= shortest)
    return registry.agg(F.coalesce(current, unique(F.col(sha) == reference), unique(F.col(name) == reference), unique(F.startswith(F.col(sha), F.lit(reference)) & long)).alias("found"))


def lineage(registry: DataFrame, start: str, depth: int = 64) -> DataFrame:
    """A pack and its ancestors by parent pointers: (sha, depth). A recursive query; a cycle ends at `depth`."""
    registry.createOrReplaceTempView("_registry")
    return registry.sparkSession.sql(
        "WITH RECURSIVE chain(sha, parent, depth) AS (SELECT sha, parent, 0 FROM _registry WHERE sha = :start"
        " UNION ALL SELECT r.sha, r.parent, c.depth + 1 FROM _registry r JOIN chain c ON r.sha = c.parent WHERE c.depth < :most) SELECT sha, depth FROM chain",
        args={"start": start, "most": depth},
    )


def retained(versions: DataFrame, order: str, number: int, live: Column, by: list[str]) -> DataFrame:
    """The newest versions and whichever is live."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return versions.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= number) | live).drop("_k")


def round_robin(df: DataFrame, node: str, order: list[str], quota: int | None = None) -> DataFrame:
    """`turn` of every row within its node; ordered by turn and node, the nodes take turns."""
    out = df.withColumn("turn", F.row_number().over(Window.partitionBy(node).orderBy(*order)))
    return out.where(F.col("turn") <= quota) if quota else out


def even_stride(df: DataFrame, order: list[str], total: int, by: list[str]) -> DataFrame:
    """At most `total` rows of each group at an even stride of their order."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.floor(F.col("_i") * total / F.col("_n")) != F.floor((F.col("_i") - 1) * total / F.col("_n"))
    return placed.where((F.col("_n") <= total) | (F.col("_i") == 0) | step).drop("_i", "_n")


def within_budget(df: DataFrame, order: list[Column], cost: str, budget: int, by: list[str]) -> DataFrame:
    """Rows in order until their cost reaches a budget; the row that passes it is kept."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_spent", F.coalesce(F.sum(cost).over(before), F.lit(0))).where(F.col("_spent") < budget).drop("_spent")


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """A page by key: the next rows after one."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def held_out(df: DataFrame, key: Column, least: int = 2, most: int = 256) -> DataFrame:
    """`held_out` for a hundredth of the rows, at least 2 and at most 256, by the order of a seeded key.

    The key's cut is found by a top-k of at most `most` keys.
    """
    number = df.count()
    quota = min(number, most, max(least, number // 100))
    chosen = df.select(key.alias("_key")).orderBy("_key").limit(quota).agg(F.max("_key").alias("_cut"))
    return df.withColumn("_key", key).join(F.broadcast(chosen)).withColumn("held_out", F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))).drop("_key", "_cut")


def retold(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of links whose both documents are there: every target, each source once."""
    ids = docs.select("document_id")
    live = links.join(ids.withColumnRenamed("document_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("document_id", "target"), "target", "left_semi")
    told = live.select(F.lit("told").alias("kind"), F.col("target").alias("document_id"))
    return told.unionByName(live.select(F.lit("source").alias("kind"), F.col("source").alias("document_id")).distinct())


def link_problems(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links whose documents are missing, on a wrong node or on one node, or copied verbatim: link, problem."""
    side = lambda name: docs.select(F.col("document_id").alias(name), F.col("node").alias(f"{name}_is"), F.col("text").alias(f"{name}_text"))
    met = links.join(side("source"), "source", "left").join(side("target"), "target", "left")
    checks = {
        "missing source": F.col("source_is").isNull(), "missing target": F.col("target_is").isNull(), "wrong source node": F.col("source_is") != F.col("source_node"),
        "wrong target node": F.col("target_is") != F.col("target_node"), "same node": F.col("source_node") == F.col("target_node"), "verbatim": F.contains(F.col("target_text"), F.col("source_text")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return met.select("link", F.explode(found).alias("problem"))


def manifest(docs: DataFrame, node: str, text: str) -> DataFrame:
    """Documents, words and kinds of each node."""
    counts = docs.groupBy(node, "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(words(F.col(text)))).alias("w"))
    return counts.groupBy(node).agg(F.sum("n").alias("documents"), F.sum("w").alias("words"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("kinds"))
