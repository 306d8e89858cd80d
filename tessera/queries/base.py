"""The registry, and relations that several queries start from, in Spark and in SQL.

`documents.source` plays the node that holds a document, `lang` its world; a partition is a line of a text; a token is a
word with the 16-bit id of its digest; `embeddings` are index entries whose label is the value that they expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rng
from tessera.functions.text import token_id
from tessera.operators import corpus, index, mix
from tessera.session import table
from tessera.sources.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", spread=True)


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.partitions(documents(spark, sf), "doc_id", "text", "lang", "source")


PARTS = r"""lines AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
parts AS (SELECT doc_id AS document_id, lang, source, generate_subscripts(l, 1) - 1 AS partition_index, unnest(l) AS text FROM lines)"""

#: The snapshot before: every third document is missing, and one partition in five reads differently.
BEFORE = PARTS + """,
before AS (SELECT document_id, partition_index, CASE WHEN (document_id + partition_index) % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha FROM parts WHERE document_id % 3 <> 0),
after AS (SELECT document_id, partition_index, sha256(text) AS sha FROM parts WHERE document_id % 7 <> 0)"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: documents come and go, and some partitions change."""
    from tessera.functions.text import sha256

    p = parts(spark, sf).select("document_id", "partition_index", "text", "sha")
    changed = (F.col("document_id") + F.col("partition_index")) % 5 == 0
    before = p.where("document_id % 3 <> 0").withColumn("sha", F.when(changed, sha256(F.concat("text", F.lit("!")))).otherwise(F.col("sha")))
    return before, p.where("document_id % 7 <> 0")


def tokens(spark: SparkSession, sf: str, ahead: int = 0) -> DataFrame:
    return index.tokens(documents(spark, sf), "doc_id", "text", "lang", "source", ahead=ahead)


WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
TOKEN = "('0x' || substr(md5({}), 1, 4))::BIGINT"
TOKENS = f"""bag AS (SELECT doc_id, lang, source, {WORDS.format("text")} AS ws FROM documents),
tokens0 AS (SELECT doc_id, lang, source, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM bag),
tokens AS (SELECT *, {TOKEN.format("word")} AS token FROM tokens0)"""


def prompts(spark: SparkSession, sf: str, ahead: int = 0) -> DataFrame:
    return index.tokens(table(spark, sf, "benchmark"), "item_id", "text", ahead=ahead)


PROMPTS = f"""pbag AS (SELECT item_id, {WORDS.format("text")} AS ws FROM benchmark),
prompts0 AS (SELECT item_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM pbag),
prompts AS (SELECT *, {TOKEN.format("word")} AS token FROM prompts0)"""


def hits(spark: SparkSession, sf: str, k: int = 16, apart: bool = False) -> DataFrame:
    """The nearest entries of every fiftieth vector: query, entry, score, rank, value (label) and strand (entry mod 4).

    Apart: entries of the query's own label are left out.
    """
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("grp"))
    q = e.where("entry % 50 = 0").select(F.col("entry").alias("query"), "vector", (F.col("grp") if apart else F.lit(None).cast("long")).alias("grp"))
    entries = e if apart else e.withColumn("grp", F.lit(None).cast("long"))
    found = index.blocked_neighbours(q, entries, k)
    return found.join(e.select("entry", F.col("grp").alias("value")), "entry").withColumn("strand", F.concat(F.lit("s"), (F.col("entry") % 4).cast("string")))


HITS = """scored AS (SELECT q.vec_id AS query, e.vec_id AS entry, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, e.label::BIGINT AS value,
    's' || (e.vec_id % 4)::VARCHAR AS strand, q.label AS qlabel FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 16)"""


def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return mix.weights(hits(spark, sf), ["query"], 0.05)


WEIGHTED = HITS + """,
powers AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query)) / 0.05::DOUBLE) AS part FROM hits),
weighted AS (SELECT *, part / sum(part) OVER (PARTITION BY query) AS weight FROM powers)"""


def likelihoods(spark: SparkSession, sf: str) -> DataFrame:
    """What every world's count model gives each token of every prompt: item_id, position, strand, p.

    Words are counted before they become tokens, and the counts are a table: texts are read once, and a digest is made of
    each different word.
    """
    words = tokens(spark, sf).groupBy(F.col("lang").alias("strand"), "word").agg(F.count(F.lit(1)).alias("c"))
    counts = words.groupBy("strand", token_id(F.col("word")).alias("token")).agg(F.sum("c").alias("c"))
    counts = Scratch(spark, "counts").save(counts, "counts")
    sizes = counts.groupBy("strand").agg(F.sum("c").alias("n"))
    vocabulary = counts.agg(F.count_distinct("token").alias("v"))
    # One row for each world, and one for the vocabulary.
    every = prompts(spark, sf).join(F.broadcast(sizes.join(F.broadcast(vocabulary))))
    found = every.join(counts, ["strand", "token"], "left")
    return found.select("item_id", F.col("pos").alias("position"), "token", "strand", ((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("v"))).alias("p"))


LIKELIHOODS = TOKENS + "," + PROMPTS + """,
counts AS (SELECT lang AS strand, token, count(*) AS c FROM tokens GROUP BY 1, 2),
sizes AS (SELECT strand, sum(c) AS n FROM counts GROUP BY 1),
vocabulary AS (SELECT count(DISTINCT token) AS v FROM counts),
likelihoods AS (SELECT item_id, pos AS position, p.token, s.strand, (coalesce(c, 0) + 1)::DOUBLE / (n + v)::DOUBLE AS p
    FROM prompts p CROSS JOIN sizes s CROSS JOIN vocabulary LEFT JOIN counts c ON c.strand = s.strand AND c.token = p.token)"""


def mixed_numbers(state: str, name: str, source: str) -> str:
    """The seeded generator's next number after `state`, in 128-bit arithmetic cut to 64 bits; the same fixed values as functions.rng."""
    mask = f"{rng.MASK}::UHUGEINT"
    return f"""{name}0 AS (SELECT *, (({state}) + {rng.GAMMA}::UHUGEINT) & {mask} AS z FROM {source}),
    {name}1 AS (SELECT * REPLACE ((xor(z, z >> 30) * {rng.MIX_A}::UHUGEINT) & {mask} AS z) FROM {name}0), {name}2 AS (SELECT * REPLACE ((xor(z, z >> 27) * {rng.MIX_B}::UHUGEINT) & {mask} AS z) FROM {name}1),
    {name} AS (SELECT * EXCLUDE (z), xor(z, z >> 31) AS {name} FROM {name}2)"""


def derived(seed: int, key: str) -> str:
    """The state from which a key's own stream is made."""
    return f"xor({seed}::UHUGEINT, ({key}::UHUGEINT * {rng.STREAM}::UHUGEINT) & {rng.MASK}::UHUGEINT)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, which is as far as both engines' sums agree."""
    kinds = dict(df.dtypes)
    return df.select([F.round(c, 6).alias(c) if (c in names if names else kinds[c] == "double") else F.col(c) for c in df.columns])
