"""URL filters by a path-template tree, with built-in functions alone.

Explicit rules label the pages they fit. Per host, paths become templates: digits and long hexadecimal names are wildcards
from the start; then, from branching to branching down to the end of every path, branches without labels and those whose
labelled share of allowed pages does not differ from their siblings' merge into one wildcard. A template's purity is its
labelled share of allowed pages, smoothed towards its host's, which is smoothed towards that of all pages; templates below
a bound are rejected. The tree is built from counts of distinct templates: only the first count and the last join touch all
pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rules of op6: verdict, host and path as one string.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Settings:
    """Production parameters of op6."""

    z: float = 2.576  # branches within so many standard errors of their siblings' share merge
    weight: float = 8.0  # pages that a prior counts for
    least: float = 0.35  # templates of less purity are rejected


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's. Else null."""
    found = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def parts_of(path: Column) -> Column:
    """A path's segments with digits and long hexadecimal names as wildcards.

    A backslash stands before what a segment itself has of the marks of wildcards, so that no segment reads like one.
    """
    names = F.split(F.regexp_replace(path, "^/", ""), "/")
    marked = lambda s: F.regexp_replace(s, r"([\\*{}])", r"\\$1")
    return F.transform(names, lambda s: F.when(s.rlike("^[0-9a-f-]{16,}$"), F.lit("{h}")).otherwise(F.regexp_replace(marked(s), "[0-9]+", "{n}")))


def alike(s: Settings) -> Column:
    """Whether a child's share (a of l) is within s.z standard errors of that of its node (all_a of all_l), or it has no labels."""
    d = lambda c: F.col(c).cast("double")
    gap = d("a") * d("all_l") - d("all_a") * d("l")
    return (F.col("l") == 0) | (gap * gap <= F.lit(s.z * s.z) * d("all_a") * (d("all_l") - d("all_a")) * d("l"))


def branched(tree: DataFrame, s: Settings) -> DataFrame:
    """Each template followed down to where its node branches: `node` and `level` grow by the segments up to there.

    A node branches where two of its paths differ; up to there each path is a beginning of the longest one, and ends in
    between (`alone`) or goes on. Where some end, the one child that goes on is a wildcard or not by its share, as it would
    be among siblings; all such places of a node are decided at once. `own` is the segment at the branching, null where a
    path ends there.
    """
    size = F.size("parts")
    longest = tree.groupBy("node").agg(F.max_by("parts", F.struct(size, "parts")).alias("longest"), F.sum("allow").alias("whole_a"), F.sum("labelled").alias("whole_l"))
    found = tree.join(longest.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    rest = lambda c: F.slice(c, F.col("level") + 1, size - F.col("level"))  # noqa: E731  (segments before are merged ones)
    differs = F.array_position(F.zip_with(rest("parts"), rest("longest"), lambda x, y: x == y), False)
    cut = found.groupBy("node").agg(F.min(F.when(differs > 0, F.col("level") + differs - 1)).cast("int").alias("cut"))
    found = found.join(cut.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    found = found.withColumn("cut", F.coalesce("cut", F.size("longest") + 1)).withColumn("alone", size < F.col("cut"))
    before = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum("allow").alias("end_a"), F.sum("labelled").alias("end_l"), F.first("whole_a").alias("whole_a"), F.first("whole_l").alias("whole_l"), F.first(F.size("longest")).alias("deepest")]
    ends = found.where("alone").groupBy("node", size.alias("at")).agg(*sums)
    left = lambda c: F.col(f"whole_{c}") - F.coalesce(F.sum(f"end_{c}").over(before), F.lit(0))
    ends = ends.withColumns({"all_a": left("a"), "all_l": left("l")}).withColumns({"a": F.col("all_a") - F.col("end_a"), "l": F.col("all_l") - F.col("end_l")})
    stars = ends.where((F.col("at") < F.col("deepest")) & alike(s)).groupBy(F.col("node").alias("_node")).agg(F.collect_list("at").alias("stars"))
    found = found.join(stars, F.col("node") == F.col("_node"), "left")
    passed = F.slice("parts", F.col("level") + 1, F.least(size, F.col("cut")) - F.col("level"))
    names = F.transform(passed, lambda x, i: F.when(F.coalesce(F.array_contains("stars", F.col("level") + i), F.lit(False)), F.lit("*")).otherwise(x))
    found = found.select("host", "parts", "n", "allow", "labelled", "alone", F.concat_ws("/", "node", names).alias("node"), F.col("cut").alias("level"))
    return found.withColumn("own", F.try_element_at("parts", F.col("level") + 1))


def merged(tree: DataFrame, s: Settings) -> DataFrame:
    """One branching of every node: `node` grows by the segment there, or by a wildcard; `done` where the path ends."""
    child = tree.groupBy("node", "own").agg(F.sum("n").alias("n"), F.sum("allow").alias("a"), F.sum("labelled").alias("l"))
    total = child.groupBy("node").agg(F.sum("a").alias("all_a"), F.sum("l").alias("all_l"))
    child = child.join(total, "node")
    name = F.when(alike(s), F.lit("*")).otherwise(F.col("own"))
    step = child.where("own IS NOT NULL").select(F.col("node").alias("_node"), F.col("own").alias("_own"), name.alias("name"))
    joined = tree.join(step, (F.col("node") == F.col("_node")) & (F.col("own") == F.col("_own")), "left")
    done = F.col("own").isNull()
    return joined.select("host", "parts", "n", "allow", "labelled", F.when(done, F.col("node")).otherwise(F.concat_ws("/", "node", "name")).alias("node"), (F.col("level") + 1).alias("level"), done.alias("done"))


def templates(count: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """The node of every distinct path of a host: host, parts, n, allow, labelled, node.

    Each round takes every open node one branching further, so that rounds are as many as branchings follow each other on
    a path, however long it is and however many paths end along it; paths that are at their end wait in tables of their own.
    """
    columns = ["host", "parts", "n", "allow", "labelled", "node"]
    tree = scratch.save(count.withColumn("node", F.concat(F.col("host"), F.lit(":"))).withColumn("level", F.lit(0)), "open0")
    ended, k = [], 0
    while not tree.isEmpty():
        down = scratch.save(branched(tree, s), f"down{k}")
        step = scratch.save(merged(down.where("NOT alone"), s), f"step{k}")
        ended += [down.where("alone").select(columns), step.where("done").select(columns)]
        scratch.drop(f"open{k}")
        k += 1
        tree = scratch.save(step.where("NOT done").drop("done"), f"open{k}")
    out = tree.select(columns)
    for other in ended:
        out = out.unionByName(other)
    return scratch.save(out, "tree")


def filtered(pages: DataFrame, rules=RULES, settings: Settings | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block: the rule's, else its template's), template.

    A null url, or one without `://`, has an empty host and path and the template of those. Repeated rows stay and count;
    ids may be null. Hosts of any size spread over tasks by template; an empty table gives no rows.
    """
    s = settings or Settings()
    verdicts = {rule: verdict for verdict, rule in rules}
    scratch = Scratch(pages.sparkSession, "urlfilter")
    host, path = host_and_path(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = seen.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), parts_of(F.col("path")).alias("parts"))
    blocked = F.coalesce(F.col("rule").isin([r for r, v in verdicts.items() if v == "block"]), F.lit(False))
    labelled = F.col("rule").isNotNull()
    count = seen.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), F.count_if(labelled & ~blocked).alias("allow"), F.count_if(labelled).alias("labelled"))
    tree = templates(count, scratch, s)
    share = lambda a, l, prior: (a.cast("double") + F.lit(s.weight) * prior) / (l.cast("double") + F.lit(s.weight))  # noqa: E731, E741
    whole = tree.agg(share(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0)), F.lit(0.5)).alias("purity"))
    hosts = tree.groupBy("host").agg(F.sum("allow").alias("a"), F.sum("labelled").alias("l"))
    # One row: the share of all pages.
    hosts = hosts.join(F.broadcast(whole)).select(F.col("host").alias("_host"), share(F.col("a"), F.col("l"), F.col("purity")).alias("prior"))
    nodes = tree.groupBy("host", "node").agg(F.sum("allow").alias("a"), F.sum("labelled").alias("l"))
    nodes = nodes.join(hosts, F.col("host") == F.col("_host")).select(F.col("node").alias("_node"), share(F.col("a"), F.col("l"), F.col("prior")).alias("purity"))
    judged = tree.join(nodes, F.col("node") == F.col("_node")).select(F.col("host").alias("_host"), F.col("parts").alias("_parts"), "node", "purity")
    found = seen.join(judged, (F.col("host") == F.col("_host")) & (F.col("parts") == F.col("_parts")))
    ruled = F.when(blocked, F.lit("block")).when(labelled, F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("purity") < s.least, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.col("node").alias("template"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle(rules=RULES, settings: Settings | None = None) -> str:
    """The same verdicts in DuckDB SQL."""
    s = settings or Settings()
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(rules, key=lambda r: -len(r[1]))
    ) + " END"
    blocked = ", ".join(f"'{r}'" for v, r in rules if v == "block")
    w = f"{s.weight!r}::DOUBLE"
    return f"""
        WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        seen AS (SELECT *, {rule} AS rule, list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
            lambda x: CASE WHEN regexp_matches(x, '^[0-9a-f-]{{16,}}$') THEN '{{h}}' ELSE regexp_replace(regexp_replace(x, '([\\*{{}}])', '\\\\\\1', 'g'), '[0-9]+', '{{n}}', 'g') END) AS parts FROM named),
        depth AS (SELECT coalesce(max(len(parts)), 0) AS most FROM seen),
        levels AS (
            SELECT 0 AS level, host, parts, count(*)::DOUBLE AS n, count(*) FILTER (rule IS NOT NULL AND rule NOT IN ({blocked}))::DOUBLE AS allow, count(rule)::DOUBLE AS labelled, host || ':' AS node FROM seen GROUP BY host, parts
            UNION ALL
            SELECT level + 1, host, parts, n, allow, labelled, CASE WHEN own IS NULL THEN node
                WHEN kids > 1 AND (l = 0 OR (a * ll - aa * l) * (a * ll - aa * l) <= {s.z * s.z!r}::DOUBLE * aa * (ll - aa) * l) THEN node || '/*'
                ELSE node || '/' || own END
            FROM (SELECT *, sum(allow) OVER child AS a, sum(labelled) OVER child AS l, sum(allow) OVER parent AS aa, sum(labelled) OVER parent AS ll,
                    CASE WHEN min(own) OVER parent = max(own) OVER parent AND count(own) OVER parent = count(*) OVER parent THEN 1 ELSE 2 END AS kids
                FROM (SELECT *, parts[level + 1] AS own FROM levels WHERE level < (SELECT most FROM depth))
                WINDOW child AS (PARTITION BY node, own), parent AS (PARTITION BY node))),
        tree AS (SELECT * FROM levels WHERE level = (SELECT most FROM depth)),
        whole AS (SELECT (coalesce(sum(allow), 0)::DOUBLE + {w} * 0.5::DOUBLE) / (coalesce(sum(labelled), 0)::DOUBLE + {w}) AS purity FROM tree),
        hosts AS (SELECT host, (sum(allow)::DOUBLE + {w} * any_value(purity)) / (sum(labelled)::DOUBLE + {w}) AS prior FROM tree, whole GROUP BY host),
        nodes AS (SELECT t.host, node, (sum(allow)::DOUBLE + {w} * any_value(prior)) / (sum(labelled)::DOUBLE + {w}) AS purity FROM tree t JOIN hosts ON t.host = hosts.host GROUP BY t.host, node)
        SELECT page_id, seen.host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN purity < {s.least!r}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict, t.node AS template
        FROM seen JOIN tree t ON seen.host = t.host AND seen.parts = t.parts JOIN nodes ON t.node = nodes.node"""
