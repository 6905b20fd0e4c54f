"""Merging rules by the model's answers (J9, F8): a prompt holds a block of similar rules, never all of them.

1. Rules are grouped into components of loosely similar rules (exact, see ``operators.linking``); rules of different
   components are never in one prompt.
2. Each component is put in order of its rules' texts and cut into blocks of at most ``limit`` rules and ``budget`` characters.
3. Each block is asked through the response cache; answers are read by F8 and their numbers mapped back to rules; numbers that
   a block has not are left out.
4. Answers that share a rule are one set (connected components). A set lives on as its lowest rule with the text of the first answer
   (by block and line) that touches it.
5. Components with several blocks are asked again, with what is left of them and with borders moved by half a block on every other pass,
   until they fit one block or two passes in a row, one with either borders, merge nothing.

Each pass but the last two makes at least one rule fewer, and rules that meet the same neighbours again are answered by the cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.functions.parse import parse_merges
from rulesift.operators.generalise import merge_similar, normalise_rule, run_synthesizer
from rulesift.operators.linking import components
from rulesift.operators.ranking import global_row_number
from rulesift.session import cut_lineage

Merger = Callable[[str], str]
LIMIT, BUDGET = 40, 12_000       # rules and characters of one prompt
LOOSE = 0.5                      # similarity of rules that may meet in a prompt

# What the model is asked; the answer's lines are those that F8 reads.
MERGE_TEMPLATE = (
    "The general rules below belong to this guideline.\n"
    "<guideline>\n{guideline}\n</guideline>\n"
    "Which of them ask for the same handling of the same cases? Write one line 'Merge [numbers, with commas]: the one rule that replaces them' "
    "for each such set, or NO MERGE when all of them differ.\n"
    "<rules>\n{rules}\n</rules>\n"
)


def offline_merger(prompt: str) -> str:
    """Offline merger: rules whose word sets have a Jaccard similarity of 0.8 or more, also through others, take the first one's text."""
    listed = re.findall(r"^(\d+)\. (.*)$", prompt.split("<rules>\n")[-1].split("\n</rules>")[0], re.M)
    words = [set(re.findall(r"\w+", text.lower())) for _, text in listed]
    owner = list(range(len(listed)))
    for i in range(len(listed)):
        for j in range(i):
            if len(words[i] & words[j]) * 10 >= len(words[i] | words[j]) * 8:
                a, b = owner[i], owner[j]
                owner = [min(a, b) if o in (a, b) else o for o in owner]
    sets: dict[int, list[int]] = {}
    for i, o in enumerate(owner):
        sets.setdefault(o, []).append(i)
    lines = [f"Merge [{', '.join(listed[i][0] for i in s)}]: {listed[s[0]][1]}" for s in sets.values() if len(s) > 1]
    return "\n".join(lines) or "NO MERGE"


def cut_blocks(rules: DataFrame, limit: int = LIMIT, budget: int = BUDGET, shift: int = 0) -> DataFrame:
    """``rules`` (component, rule_no, rule) with ``block`` and the number ``n`` of each rule in its block.

    A block holds at most ``limit`` rules and ``budget`` characters; a longer rule is a block of its own.
    """
    ordered = global_row_number(rules.withColumn("_norm", normalise_rule()), ["component", "_norm", "rule_no"], "_rn")
    start = ordered.groupBy("component").agg(F.min("_rn").alias("_start"))
    placed = ordered.join(start, "component").withColumn("_cell", F.floor((F.col("_rn") - F.col("_start") + shift) / limit))
    cell = W.partitionBy("component", "_cell")  # at most limit rules
    length = F.length("rule") + 8               # with its number and the line's end
    width = F.greatest(F.lit(budget) - F.max("_length").over(cell), F.lit(1))
    placed = (placed.withColumn("_length", length).withColumn("_width", width)
              .withColumn("_before", F.sum("_length").over(cell.orderBy("_rn")) - F.col("_length"))
              .withColumn("_part", F.floor(F.col("_before") / F.col("_width"))))
    block = F.concat_ws("-", *(F.col(c).cast("string") for c in ("component", "_cell", "_part")), F.lit(str(shift)))
    return (placed.withColumn("block", block).withColumn("n", F.row_number().over(W.partitionBy("block").orderBy("_rn")))
            .drop("_norm", "_rn", "_start", "_cell", "_length", "_width", "_before", "_part"))


def ask_blocks(blocks: DataFrame, merger: Merger, **options) -> DataFrame:
    """(block, merge_no, rule_no, merged_rule): what each block's answer merges; blocks of one rule are not asked."""
    items = F.array_sort(F.collect_list(F.struct("n", F.col("rule").alias("r"))))
    text = F.array_join(F.transform(items, lambda x: F.concat(x["n"].cast("string"), F.lit(". "), F.regexp_replace(x["r"], r"\s*\n\s*", " "))), "\n")
    lists = blocks.groupBy("block").agg(F.count("*").alias("rules"), text.alias("rule_list")).where("rules > 1")
    answers = run_synthesizer(lists, merger, key="block", template=MERGE_TEMPLATE, **options)
    merges = parse_merges(answers.where("response is not null"), "block").withColumnRenamed("member", "n")
    return merges.join(blocks.select("block", "n", "rule_no"), ["block", "n"]).select("block", "merge_no", "rule_no", "merged_rule")


def unite(merges: DataFrame) -> DataFrame:
    """(rule_no, label, merged_rule): answers that share a rule as one set, by its lowest rule and its first answer's text."""
    first = merges.groupBy("block", "merge_no").agg(F.min("rule_no").alias("a"), F.first("merged_rule").alias("merged_rule"))
    merges = merges.select("block", "merge_no", "rule_no").join(first, ["block", "merge_no"])
    linked = components(merges.select("a", F.col("rule_no").alias("b"))).withColumnRenamed("node", "rule_no")
    # an answer can give one rule a new text
    sets = merges.select("rule_no").distinct().join(linked, "rule_no", "left").select("rule_no", F.coalesce("label", "rule_no").alias("label"))
    text = (merges.join(sets, "rule_no").groupBy("label")
            .agg(F.min(F.struct("block", "merge_no", "merged_rule")).alias("_t")).select("label", F.col("_t.merged_rule").alias("merged_rule")))
    return sets.join(text, "label").select("rule_no", "label", "merged_rule")


def merge_by_model(rules: DataFrame, merger: Merger = offline_merger, limit: int = LIMIT, budget: int = BUDGET, loose: float = LOOSE, **options) -> DataFrame:
    """(rule_no, component, merged_rule) of every rule: rules that the model merges share the lowest rule number and one text.

    ``rules``: (rule_no, rule). ``options`` as for ``run_synthesizer`` (guideline, cache_path, model, tasks). An empty rule list gives no rows.
    """
    kind = rules.schema["rule_no"].dataType
    similar = merge_similar(rules, loose).select("rule_no", "component")
    live = cut_lineage(rules.select(F.col("rule_no").cast("long").alias("rule_no"), "rule")
                       .join(similar.select(F.col("rule_no").cast("long").alias("rule_no"), F.col("component").cast("long").alias("component")), "rule_no"))
    mapped = live.select("rule_no", F.col("rule_no").alias("label"))
    left, idle, turn = live, 0, 0
    while idle < 2 and not left.isEmpty():
        blocks = cut_lineage(cut_blocks(left, limit, budget, (turn % 2) * (limit // 2)))
        # components that one block holds are done with this answer
        several = cut_lineage(blocks.groupBy("component").agg(F.count_distinct("block").alias("_b")).where("_b > 1").select("component"))
        merges = cut_lineage(ask_blocks(blocks, merger, **options))
        turn += 1
        idle += 1
        if not merges.isEmpty():
            took = cut_lineage(unite(merges)).withColumnRenamed("label", "_label")
            if not took.where("_label != rule_no").isEmpty():
                idle = 0
            mapped = cut_lineage(mapped.join(took.select(F.col("rule_no").alias("label"), "_label"), "label", "left")
                                 .select("rule_no", F.coalesce("_label", "label").alias("label")))
            live = cut_lineage(live.join(took, "rule_no", "left").where(F.col("_label").isNull() | (F.col("_label") == F.col("rule_no")))
                               .select("rule_no", F.coalesce("merged_rule", "rule").alias("rule"), "component"))
        left = cut_lineage(live.join(several, "component", "left_semi"))
    text = live.select(F.col("rule_no").alias("label"), F.col("rule").alias("merged_rule"))
    return mapped.join(text, "label").select(F.col("rule_no").cast(kind).alias("rule_no"), F.col("label").cast(kind).alias("component"), "merged_rule")
