"""Questions turned into stems, and the facts they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tessera.functions.text import fill
from tessera.operators.bounds import few


def quoted(text: Column) -> Column:
    """Plain text as a pattern."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def rewritten(questions: DataFrame, templates: DataFrame, question: str = "question") -> DataFrame:
    """Each question's stem by the longest template that fits, whatever its case; null where none does.

    templates: (kind, template, stem) with `{s}` once in the template. They are a fixed, short list that travels.
    """
    parts = F.split("template", r"\{s\}")
    pattern = F.concat(F.lit(r"(?i)^\s*"), quoted(parts[0]), F.lit("(.+?)"), quoted(parts[1]), F.lit(r"\s*$"))
    listed = templates.select("kind", "template", "stem", pattern.alias("_p"))
    met = questions.join(few(listed), F.expr(f"`{question}` RLIKE _p"), "left")
    subject = F.trim(F.expr(f"regexp_extract(`{question}`, _p, 1)"))
    best = F.max_by(F.struct("kind", fill(F.col("stem"), subject).alias("stem")), F.when(F.col("template").isNotNull(), F.struct(F.length("template"), F.col("template"))))
    return met.groupBy(*questions.columns).agg(best.alias("_b")).select(*questions.columns, F.col("_b.kind").alias("kind"), F.col("_b.stem").alias("stem"))


def with_fallback(rewrites: DataFrame, question: str = "question") -> DataFrame:
    """The stem, or the question itself, and which it is."""
    return rewrites.withColumn("used", F.coalesce("stem", question)).withColumn("by", F.when(F.col("stem").isNotNull(), "rules").otherwise("question"))


def cleaned(text: Column) -> Column:
    """A written answer up to its blank, without quotes or marks at its end."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(text, "_", 1), r"""^[\s"']+""", ""), r"""[\s"'.,:;?!]+$""", "")


def acceptable(stem: Column, question: Column) -> Column:
    """A stem that is there, is no question, and keeps the question's capitalised words after its first."""
    names = F.filter(F.slice(F.split(question, r"[^\p{L}\p{N}]+"), 2, 1000), lambda w: w.rlike(r"^\p{Lu}"))
    return (F.trim(stem) != "") & ~stem.rlike(r"\?\s*$") & F.forall(names, lambda w: F.contains(F.lower(stem), F.lower(w)))


def subject_span(stem: Column, subject: Column) -> Column:
    """Where a subject starts and ends in a stem, in characters, without regard to case; null where it is not."""
    at = F.instr(F.lower(stem), F.lower(subject))
    return F.when(at > 0, F.struct((at - 1).alias("first"), (at - 1 + F.length(subject)).alias("last")))


def paired(facts: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of one version with those of another by their composite key; `matched` tells whether there is one."""
    right = other.select(*keys, F.col("fact").alias("other")).groupBy(*keys).agg(F.min("other").alias("other"))
    return facts.join(right, keys, "left").withColumn("matched", F.col("other").isNotNull())


def shared_facts(links: DataFrame, documents: DataFrame, per_link: int) -> DataFrame:
    """The first facts of each link whose both documents are there: the target's, else the source's."""
    ids = documents.select("document_id")
    live = links.join(ids.withColumnRenamed("document_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("document_id", "target"), "target", "left_semi")
    ranked = live.withColumn("fact", F.coalesce("target_fact", "source_fact")).withColumn("_k", F.row_number().over(Window.partitionBy("link").orderBy("place")))
    return ranked.where(F.col("_k") <= per_link).drop("_k")


def template_rows(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([Row(kind=k, template=t, stem=s) for k, t, s in rows], "kind string, template string, stem string")
