"""Versioned prompt templates (F3) and which rows a new version asks again.

A template names the parts a prompt is made of in slots: ``{guideline}``, ``{rules}`` and ``{text}``; doubled braces are literal
ones. A version is a row (version, task_id, template, guideline, rules). What an answer depends on, beside its
text, is the template and the parts its slots name: their digest is the version's *dependency digest*. Two versions of a task with one digest make
equal prompts, so a row is asked again only where no earlier version it was asked under has that digest: a new template
touches every task that uses it, new rules only the tasks whose rules changed and whose template shows them, and going back to an earlier
version asks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.operators.cache import Annotator, respond_with_cache

SLOTS = ("guideline", "rules", "text")
_SLOT = r"(?<!\{)\{(" + "|".join(SLOTS) + r")\}(?!\})"


def _parts(template: Column) -> tuple[Column, Column]:
    """(literal parts, slot names between them), doubled braces unescaped."""
    literal = F.transform(F.split(template, _SLOT, -1), lambda p: F.replace(F.replace(p, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")))
    return literal, F.regexp_extract_all(template, F.lit(_SLOT), 1)


def render(template: Column, **values: Column) -> Column:
    """A template filled in one pass, so that a slot written inside a value stays as it is; a null value is empty."""
    literal, names = _parts(template)
    pick = lambda n: F.coalesce(*[F.when(n == k, F.coalesce(v, F.lit(""))) for k, v in values.items()], F.lit(""))
    return F.concat(F.element_at(literal, 1), F.array_join(
        F.transform(names, lambda n, i: F.concat(pick(n), F.element_at(literal, i + 2))), ""))


def dependency_digest(template: Column, guideline: Column, rules: Column) -> Column:
    """Digest of the template and of the parts its slots name."""
    _, names = _parts(template)
    part = lambda k, v: F.when(F.array_contains(names, k), F.sha2(F.coalesce(v, F.lit("")), 256)).otherwise(F.lit("-"))
    return F.sha2(F.concat_ws("\u001f", F.sha2(template, 256), part("guideline", guideline), part("rules", rules)), 256)


def with_digests(versions: DataFrame) -> DataFrame:
    return versions.withColumn("dependency", dependency_digest(F.col("template"), F.col("guideline"), F.col("rules")))


def plan_versions(rows: DataFrame, versions: DataFrame, since: str = "since") -> DataFrame:
    """version, task_id, rows, reasked: how many of a task's rows exist at a version, and how many it has to ask.

    ``rows``: (task_id, since), a row for each text with the first version it was there for. Rows are counted by (task, since) first; what
    is joined with the versions are these counts.
    """
    counts = rows.groupBy("task_id", F.col(since).alias("since")).agg(F.count("*").alias("n"))
    digests = with_digests(versions).select("task_id", "version", "dependency")
    met = counts.join(digests, "task_id").where(F.col("version") >= F.col("since"))
    first = F.min("version").over(W.partitionBy("task_id", "since", "dependency"))  # a few versions each
    return (met.withColumn("first", first).groupBy("version", "task_id")
            .agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("version") == F.col("first"), F.col("n")).otherwise(0)).alias("reasked")))


def ask_version(rows: DataFrame, versions: DataFrame, version: int, cache_path: str, model: str, annotator: Annotator,
                text: str = "text_to_annotate", tasks: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows' answers under one version; rows whose prompt no earlier version made are asked, the others come from the cache.

    Adds ``dependency`` and the columns of ``respond_with_cache``. Rows of tasks without this version are left out. ``keep``: the
    columns of ``rows`` that are returned, all by default.
    """
    v = with_digests(versions.where(F.col("version") == version)).select(
        F.col("task_id").alias("_task"), F.col("template").alias("_template"), F.col("guideline").alias("_guideline"), F.col("rules").alias("_rules"), "dependency")
    prompt = render(F.col("_template"), guideline=F.col("_guideline"), rules=F.col("_rules"), text=F.col(text))
    # one version has a row for each task; the texts stay where they are
    asked = rows.join(F.broadcast(v), rows["task_id"] == v["_task"]).select(*rows.columns, "dependency", prompt.alias("prompt"))
    return respond_with_cache(asked, cache_path, model, annotator, tasks=tasks, keep=[*(rows.columns if keep is None else keep), "dependency"])
