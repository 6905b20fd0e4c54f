"""Generalising rule clusters and merging similar rules.

Per cluster, a pluggable ``synthesizer(prompt) -> response`` is asked once, through the response cache:
the guideline and the cluster's numbered rules (at most 20) go in, the answer is stored before it is used and parsed by
F7. The global merge is not one prompt over all rules: rules whose word sets have a Jaccard similarity of at
least a threshold are linked exactly (prefix filter on the rarest words, then stars and list scans,
see ``operators.linking``), and each component takes its lowest rule.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.functions.parse import parse_categories
from rulesift.operators.cache import respond_with_cache
from rulesift.operators.linking import connect_sets
from rulesift.session import cut_lineage, shared_path

Synthesizer = Callable[[str], str]
JACCARD_MIN = 0.8

# What the synthesizer is asked; the answer's keys are those that F7 reads.
RULES_TEMPLATE = (
    "The rules below were proposed for unclear cases of this guideline.\n"
    "<guideline>\n{guideline}\n</guideline>\n"
    "Group rules that ask for the same handling and state one general rule 'When <condition> -> <action>' for each group.\n"
    "Answer as JSON: {{\"categories\": [{{\"category_description\": rule, \"edge_cases\": [numbers of the group's rules]}}]}}.\n"
    "<rules>\n{rules}\n</rules>\n"
)


def run_synthesizer(lists: DataFrame, synthesizer: Synthesizer, key: str = "cluster_id",
                    text: str = "rule_list", guideline: str = "", cache_path: str | None = None,
                    model: str = "synthesizer", tasks: int | None = None, template: str = RULES_TEMPLATE) -> DataFrame:
    """One synthesizer call per distinct list: ``(key, response, error)``, written to the cache before use."""
    def ask(prompts: list[str]) -> list[dict]:
        return [{"response": synthesizer(p)} for p in prompts]

    path = cache_path or shared_path(lists.sparkSession, "synthesizer_cache")
    answered = respond_with_cache(lists.select(key, text), path, model, ask, prompt=text, batch_size=1,
                                  context=template + guideline,
                                  render=lambda rules: template.format(guideline=guideline, rules=rules), tasks=tasks)
    return answered.select(key, "response", "error")


def offline_synthesizer(rule_list: str) -> str:
    """Offline synthesizer: one category per distinct condition (text before
    ``->``) with the numbers of the rules that state it."""
    rule_list = rule_list.split("<rules>\n")[-1].split("\n</rules>")[0]
    cats: OrderedDict[str, list[int]] = OrderedDict()
    for line in rule_list.split("\n"):
        m = re.match(r"^(\d+)\.\s*(.*)$", line)
        if not m:
            continue
        cond = m.group(2).split("->")[0].strip()
        cats.setdefault(cond, []).append(int(m.group(1)))
    body = {"categories": [{"category_description": f"{c} -> handle as the members agree",
                            "edge_cases": v} for c, v in cats.items()]}
    return "```json\n" + json.dumps(body) + "\n```"


def generalise(lists: DataFrame, synthesizer: Synthesizer = offline_synthesizer,
               key: str = "cluster_id", **options) -> DataFrame:
    """Categories per cluster: ``(key, category_no, category_description, edge_case)``; ``options`` as for
    ``run_synthesizer``."""
    return parse_categories(run_synthesizer(lists, synthesizer, key, **options), key)


def normalise_rule(c: str = "rule"):
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"\s+", " ")


def merge_similar(rules: DataFrame, threshold: float = JACCARD_MIN) -> DataFrame:
    """``(rule_no, component, merged_rule)``: similar rules share the component
    of their lowest rule number and take that rule's text.

    Similar: equal after normalising, or word sets with a Jaccard similarity of ``threshold``
    (in hundredths) or more, directly or through others. All rules are kept.
    """
    percent = round(threshold * 100)
    base = rules.select("rule_no", "rule", normalise_rule().alias("_norm"))
    # Exact duplicates after normalisation first (a partial aggregate).
    exact = base.groupBy("_norm").agg(F.min("rule_no").alias("_rep"))
    words = exact.select(F.col("_rep").cast("long").alias("cls"), F.array_distinct(F.filter(
        F.split("_norm", r"\W+"), lambda w: w != "")).alias("words"))
    word = words.select("cls", F.size("words").alias("size"), F.explode("words").alias("w"))
    df = word.groupBy("w").agg(F.count("*").alias("df"))
    ranked = F.array_sort(F.collect_list(F.struct("df", F.xxhash64("w").alias("h"))))  # rarest first; the words of one rule
    sets = (word.join(df, "w").groupBy("cls", "size").agg(ranked.alias("r"))
            .select("cls", F.col("size").cast("long").alias("size"), F.transform("r", lambda x: x["h"]).alias("elements"),
                    F.aggregate("r", F.lit(0.0), lambda a, x: a + F.log(x["df"].cast("double"))).alias("hub")))
    sets = cut_lineage(sets)
    # Linked sets share at least ceil(size * threshold) words, so one of the first size - that + 1.
    prefix = F.slice("elements", 1, (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int"))
    labels = connect_sets(sets, sets.select("cls", F.explode(prefix).alias("sig")), percent)
    comp = (base.join(exact, "_norm").join(labels.select(F.col("cls").alias("_rep"), "label"), "_rep", "left")
            .select("rule_no", "rule", F.coalesce("label", "_rep").cast(rules.schema["rule_no"].dataType).alias("component")))
    text = comp.where(F.col("rule_no") == F.col("component")).select("component", F.col("rule").alias("merged_rule"))
    return comp.join(text, "component").select("rule_no", "component", "merged_rule")
