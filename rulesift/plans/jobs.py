"""Whole-table jobs: the user-facing API.

Each job is a DataFrame lineage with Python only inside the pluggable
functions (annotator, embedder, synthesizer) and M8's leaf step. Caches,
models and results live below ``work_dir`` (a shared folder).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift.functions.parse import parse_annotations
from rulesift.functions.text import guideline_label_lines, split_template, text_key  # noqa: F401 - callers take it from here
from rulesift.operators import cache as C
from rulesift.operators import features as M
from rulesift.operators import rounds as R
from rulesift.operators import rules as RU
from rulesift.operators.generalise import Synthesizer, generalise, offline_synthesizer
from rulesift.operators.identity import assign_ids
from rulesift.operators.history import record
from rulesift.operators.keyed_store import KeyedStore, distinct_keys
from rulesift.operators.merge_blocks import Merger, merge_by_model, offline_merger
from rulesift.operators.registry import update_edge_cases, upsert_relabelled
from rulesift.operators.stored_cells import rule_clusters
from rulesift.schema import REGISTRY
from rulesift.session import cut_lineage
from rulesift.sources.ingest import clean_examples, cleaned_keys, input_report, raise_on_violations, read_round
from rulesift.sources.sinks import write_round

DEFAULT_TEMPLATE = (
    "You label texts by the guideline below.\n"
    "<guideline>\n{guideline}\n</guideline>\n"
    "Give the index of the label (from 0) or -1 when no label fits, a confidence from 0 to 100, "
    "whether this is a new edge case (confidence <= 75 or label -1, not covered by a rule) and, if so, "
    "a rule 'When <condition> -> <action>', else EMPTY.\n"
    "Answer as JSON with the keys analysis, annotation, confidence, new_edge_case, new_edge_case_rule.\n"
    "<text>\n{text}\n</text>\n"
)


@dataclass
class Plugins:
    annotator: C.Annotator
    embedder: C.Embedder
    synthesizer: Synthesizer = offline_synthesizer
    merger: Merger = offline_merger
    annotate_model: str = "annotator"
    embed_model: str = "hashing-64"
    synthesize_model: str = "synthesizer"
    merge_model: str = "merger"
    tasks: int | None = None       # tasks that calls are dealt over; default: a multiple of the cores


@dataclass
class Increment:
    """B3's tables: annotations and edge cases after the upsert, and the registry's additions."""

    annotations: DataFrame
    edge_cases: DataFrame | None
    registry: DataFrame


def offline_plugins() -> Plugins:
    return Plugins(annotator=C.offline_annotator(), embedder=C.hashing_embedder(64))


def _guideline(guidelines: DataFrame, task_id: str) -> tuple[str, list[str]]:
    """The task's one guideline and its labels: a prompt-sized string, part of every call."""
    rows = (guidelines.where(F.col("task_id") == task_id)
            .select("guideline", guideline_label_lines("guideline").alias("labels")).limit(2).collect())
    if len(rows) != 1:
        raise ValueError(f"expected one guideline for task {task_id!r}, found {'several' if rows else 'none'}")
    return rows[0]["guideline"], rows[0]["labels"]


USAGE = "task_id string, round int, model string, calls long, input_tokens long, output_tokens long, failed long"


def record_usage(answered: DataFrame, work_dir: str, task_id: str, round_no: int, model: str) -> None:
    """What a job's calls used, as one row of ``<work_dir>/usage``: distinct prompts that were not in the cache."""
    asked = answered.where("not cache_hit").groupBy("prompt_key").agg(F.min(F.struct("error", "input_tokens", "output_tokens")).alias("_r"))
    (asked.agg(F.count("*").alias("calls"), F.sum("_r.input_tokens").alias("input_tokens"), F.sum("_r.output_tokens").alias("output_tokens"),
               F.count("_r.error").alias("failed"))
     .select(F.lit(task_id).alias("task_id"), F.lit(round_no).alias("round"), F.lit(model).alias("model"), "calls", "input_tokens", "output_tokens", "failed")
     .write.mode("append").parquet(f"{work_dir}/usage"))


def job_costs(spark: SparkSession, work_dir: str, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each task, round and model over all jobs of ``work_dir``; ``prices`` as for ``run_cost``, a
    model without a price has a null cost."""
    used = spark.read.schema(USAGE).parquet(f"{work_dir}/usage").groupBy("task_id", "round", "model").agg(
        *(F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "failed")))
    p = prices.groupBy(F.col("model").alias("_m")).agg(F.max("input_usd_per_mtok").alias("_i"), F.max("output_usd_per_mtok").alias("_o"))
    cost = F.col("input_tokens") / 1e6 * F.col("_i") + F.col("output_tokens") / 1e6 * F.col("_o")
    return used.join(p, used["model"] == p["_m"], "left").select(*used.columns, F.round(cost, 6).alias("cost_usd"))


def _answer(ex: DataFrame, guidelines: DataFrame, task_id: str, round_no: int, work_dir: str, plugins: Plugins,
            template: str) -> DataFrame:
    """F3 -> J2 -> F4-F6. A failed call keeps its error and gets no label, confidence or flag."""
    guideline, labels = _guideline(guidelines, task_id)
    head, middle, tail = split_template(template)
    answered = C.respond_with_cache(
        ex.select("uid", "ordinal", "text_to_annotate"), f"{work_dir}/response_cache", plugins.annotate_model,
        plugins.annotator, prompt="text_to_annotate", context=template + guideline,
        render=lambda text: head + guideline + middle + text + tail, tasks=plugins.tasks)
    record_usage(answered, work_dir, task_id, round_no, plugins.annotate_model)
    parsed = parse_annotations(answered.withColumnRenamed("response", "raw_annotations")
                               .withColumn("labels", F.array(*map(F.lit, labels)).cast("array<string>")), labels="labels")
    ok = F.col("error").isNull()
    for c in ("annotation", "confidence", "new_edge_case", "parse_ok"):
        parsed = parsed.withColumn(c, F.when(ok, F.col(c)))
    return parsed


def registry_of(spark: SparkSession, path: str, task_id: str) -> KeyedStore:
    """The registry of one task's text ids (J1) as a keyed store."""
    return KeyedStore(spark, path, REGISTRY, "text_key", task_id)


def identify(examples: DataFrame, task_id: str, registry: DataFrame | None, registry_path: str | None) -> tuple[DataFrame, DataFrame]:
    """P1/P2 -> J1: (cleaned examples with ids, checkpointed; registry additions). A stored registry is looked up for these
    texts only and gets the additions."""
    if registry_path is None:
        ex, additions = assign_ids(clean_examples(examples, key="_tk"), registry, key="_tk")
        return cut_lineage(ex.drop("_tk")), additions
    store = registry_of(examples.sparkSession, registry_path, task_id)
    known = store.lookup(distinct_keys(cleaned_keys(examples), "text_key"))
    if registry is not None:
        known = known.unionByName(registry.select(*known.columns))
    # ids are found where the cleaned texts lie, and both are written once; a text has one row, so those of new texts are the additions
    ex, _ = assign_ids(clean_examples(examples, key="_tk"), known, key="_tk")
    ex = cut_lineage(ex)
    additions = ex.where("is_new").select("task_id", F.col("_tk").alias("text_key"), "text_to_annotate", "uid")
    store.append(additions)
    store.fold()
    return ex.drop("_tk"), additions


def annotate_round(examples: DataFrame, guidelines: DataFrame, task_id: str, round_no: int, work_dir: str,
                   plugins: Plugins, registry: DataFrame | None = None, template: str = DEFAULT_TEMPLATE,
                   reuse_models: bool = False, check: bool = True, out_path: str | None = None,
                   registry_path: str | None = None) -> DataFrame:
    """B1: P14 -> P1/P2 -> J1 -> M1 -> M2/M4 (M5) -> F3 -> J2 -> F4-F6 (-> S4).

    ``examples``: (task_id, ordinal, text_to_annotate). Returns one row per
    distinct text in the ANNOTATIONS shape; with ``out_path`` the round is
    written partitioned by task and round (dynamic overwrite) and read back. With ``registry_path`` ids
    come from the registry stored there, and the ids of new texts are added to it.
    """
    spark = examples.sparkSession
    ex = examples.where(F.col("task_id") == task_id)
    if check:
        raise_on_violations(input_report(ex, guidelines.where(F.col("task_id") == task_id)))
    # Lineage cuts: the ids feed embedding and prompts; the embeddings come
    # back checkpointed and feed a count, two fingerprints and the fits.
    ex, _ = identify(ex, task_id, registry, registry_path)
    emb = C.embed_with_cache(ex.select("uid", "text_to_annotate"), f"{work_dir}/embedding_cache",
                             plugins.embed_model, plugins.embedder, text="text_to_annotate", tasks=plugins.tasks, keep=["uid"])
    vec = M.with_vector(emb)
    n = vec.count()
    root = f"{work_dir}/models"
    km, _ = M.load_or_fit(spark, root, task_id, round_no, "text_kmeans", vec,
                          lambda d: M.fit_kmeans(d, n), reuse=reuse_models)
    placed = M.assign_clusters(km, vec)
    if n >= 2:
        pca, _ = M.load_or_fit(spark, root, task_id, round_no, "text_pca", vec, M.fit_projection, reuse=reuse_models)
        placed = M.project(pca, placed)
    else:
        placed = placed.withColumn("pca_x", F.lit(0.0)).withColumn("pca_y", F.lit(0.0))
    placed = placed.select("uid", "cluster", "pca_x", "pca_y")

    parsed = _answer(ex, guidelines, task_id, round_no, work_dir, plugins, template)
    out = (parsed.join(placed, "uid", "left")
           .select(F.lit(task_id).alias("task_id"), F.lit(round_no).alias("round"), "uid", "ordinal",
                   "text_to_annotate", "cluster", "pca_x", "pca_y", "raw_annotations", "analyses", "annotation",
                   "confidence", "new_edge_case", "guideline_improvement", "parse_ok", "error",
                   F.lit(False).alias("is_reannotated")))
    if out_path is None:
        return out
    write_round(out, out_path)
    return read_round(spark, out_path, task_id, round_no, out.schema).select(*out.columns)


def discover_edge_cases(annotations: DataFrame, task_id: str, round_no: int, work_dir: str, plugins: Plugins,
                        require_flag: bool = False, guideline: str = "", reuse_cells: bool = False) -> tuple[DataFrame, DataFrame]:
    """B2: P5/P6 -> M1 -> M6-M8 -> W1 -> A7 -> M10/F7 -> J8 -> A8 -> F8 (blocks of similar rules) -> J9 -> J10/P7.

    Returns ``(suggestions(rule_key, rule_no, rule), edge_cases)``. ``edge_cases`` has one row for each row with a
    proposed rule and the same columns for any number of rules. A rule whose embedding failed keeps its row with
    ``embed_error``, without a place and without a general rule (L11). ``guideline`` is part of the synthesizer's prompt.
    With ``reuse_cells`` rules that this round has clustered before keep their clusters and new ones join them (M5).
    """
    spark = annotations.sparkSession
    # the rows' texts are not needed before the last join, and then only where they are asked for
    wide = RU.proposed_rules(annotations, require_flag=require_flag)
    rules = cut_lineage(wide.select("uid", "guideline_improvement", "condition"))
    emb = C.embed_with_cache(rules.select("uid", "condition"), f"{work_dir}/embedding_cache", plugins.embed_model,
                             plugins.embedder, text="condition", tasks=plugins.tasks, keep=["uid"])
    vec = M.with_vector(emb)
    n = vec.count()
    rows = rules.join(emb.select("uid", "embed_error"), "uid", "left")
    if n > 1:
        pca, _ = M.load_or_fit(spark, f"{work_dir}/models", task_id, round_no, "rule_pca", vec, M.fit_projection)
        placed = M.project(pca, vec).select("uid", "pca_x", "pca_y")
        cells = rule_clusters(emb.where("embedding is not null").select("uid", "embedding"), M.model_path(f"{work_dir}/models", task_id, round_no, "rule_cells"), reuse_cells)
        numbered = RU.number_in_cluster(rows.join(cells, "uid"))
        cats = generalise(RU.numbered_lists(numbered), plugins.synthesizer, guideline=guideline, model=plugins.synthesize_model,
                          cache_path=f"{work_dir}/response_cache", tasks=plugins.tasks)
        mapped = RU.map_members(cats, numbered)
        ordered = RU.rule_order(mapped)
    else:                                                        # M9: at most one rule, its own edge case 0 at (0, 0)
        zero = F.lit(0.0)
        placed = vec.select("uid", zero.alias("pca_x"), zero.alias("pca_y"))
        mapped = rows.join(vec.select("uid"), "uid", "left_semi").select(
            "uid", F.col("guideline_improvement").alias("category_description"))
        ordered = mapped.select(F.lit(1).cast("long").alias("rule_no"), F.col("category_description").alias("rule"))
    if n // RU.RULES_PER_CLUSTER + 1 == 1:                       # one cluster: no global merge
        merges = spark.createDataFrame([], "block string, merge_no int, member long, merged_rule string")
    else:
        comp = merge_by_model(ordered, plugins.merger, guideline=guideline, model=plugins.merge_model,
                              cache_path=f"{work_dir}/response_cache", tasks=plugins.tasks)
        sets = comp.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
        merges = comp.join(sets, "component").select(
            F.lit("model").alias("block"), F.col("component").cast("int").alias("merge_no"), F.col("rule_no").alias("member"), "merged_rule")
    merged = RU.merge_rules(ordered, merges)
    members = (mapped.join(ordered, mapped["category_description"] == ordered["rule"]).select("uid", "rule_no")
               .join(merged, "rule_no").select("uid", "final_no", "final_rule"))
    wide = wide.drop("pca_x", "pca_y", "cluster").join(emb.select("uid", "embed_error"), "uid", "left")
    edge = RU.assign_final_rules(wide.join(placed, "uid", "left"), members)
    edge = edge.join(emb.select("uid", "embed_error"), "uid", "left")
    sugg = merged.select(F.concat(F.lit("edge_case_"), F.col("final_no").cast("string")).alias("rule_key"),
                         F.col("final_no").alias("rule_no"), F.col("final_rule").alias("rule")).distinct()
    return sugg, edge


def annotate_increment(new_examples: DataFrame, annotations: DataFrame, guidelines: DataFrame, task_id: str,
                       round_no: int, work_dir: str, plugins: Plugins, registry: DataFrame | None = None,
                       template: str = DEFAULT_TEMPLATE, edge_cases: DataFrame | None = None,
                       check: bool = True, registry_path: str | None = None) -> Increment:
    """P14 -> score new examples with the round's stored models (no refit) and
    upsert them into the annotations and the edge cases (J7). Fails clearly when
    the round has no models (ledger L23). ``registry_path`` as for ``annotate_round``."""
    from pyspark.ml import PipelineModel
    spark = new_examples.sparkSession
    paths = [M.model_path(f"{work_dir}/models", task_id, round_no, m) + "/model" for m in ("text_kmeans", "text_pca")]
    if not all(C.path_exists(spark, p) for p in paths):
        raise RuntimeError(f"no fitted models for task {task_id!r} round {round_no}; run annotate_round first")
    km, pca = (PipelineModel.load(p) for p in paths)
    new = new_examples.where(F.col("task_id") == task_id)
    if check:
        raise_on_violations(input_report(new, guidelines.where(F.col("task_id") == task_id)))
    ex, additions = identify(new, task_id, registry, registry_path)
    emb = C.embed_with_cache(ex.select("uid", "text_to_annotate"), f"{work_dir}/embedding_cache",
                             plugins.embed_model, plugins.embedder, text="text_to_annotate", tasks=plugins.tasks, keep=["uid"])
    placed = M.project(pca, M.assign_clusters(km, M.with_vector(emb))).select("uid", "cluster", "pca_x", "pca_y")
    parsed = _answer(ex, guidelines, task_id, round_no, work_dir, plugins, template)
    new_rows = parsed.join(placed, "uid", "left").select(
        F.lit(task_id).alias("task_id"), F.lit(round_no).alias("round"), "uid", "ordinal", "text_to_annotate",
        "cluster", "pca_x", "pca_y", "raw_annotations", "analyses", "annotation", "confidence", "new_edge_case",
        "guideline_improvement", "parse_ok", "error")
    new_rows = project_rules(new_rows, task_id, round_no, work_dir, plugins)
    updated = None if edge_cases is None else update_edge_cases(edge_cases, at_rules(new_rows))
    return Increment(upsert_relabelled(annotations, new_rows), updated, additions)


def at_rules(new_rows: DataFrame) -> DataFrame:
    """New rows with the places of their rules instead of those of their texts, as the edge cases have them."""
    return new_rows.drop("pca_x", "pca_y").withColumnsRenamed({"edge_case_pca_x": "pca_x", "edge_case_pca_y": "pca_y"})


def project_rules(rows: DataFrame, task_id: str, round_no: int, work_dir: str, plugins: Plugins) -> DataFrame:
    """B3's rule projection: a new edge case with a rule (flag required,
    ledger L14) gets its rule condition embedded and placed with the round's
    rule projection (from B2) as ``edge_case_pca_x/y``; null when the round
    has no rule model or the row is not an edge case."""
    from pyspark.ml import PipelineModel
    nulls = rows.withColumn("edge_case_pca_x", F.lit(None).cast("double")) \
        .withColumn("edge_case_pca_y", F.lit(None).cast("double"))
    path = M.model_path(f"{work_dir}/models", task_id, round_no, "rule_pca") + "/model"
    if not C.path_exists(rows.sparkSession, path):               # B2 has not run for this round
        return nulls
    model = PipelineModel.load(path)
    flagged = RU.proposed_rules(rows.select("uid", "guideline_improvement", "new_edge_case"), require_flag=True)
    emb = C.embed_with_cache(flagged.select("uid", "condition"), f"{work_dir}/embedding_cache",
                             plugins.embed_model, plugins.embedder, text="condition", tasks=plugins.tasks, keep=["uid"])
    placed = M.project(model, M.with_vector(emb), names=("edge_case_pca_x", "edge_case_pca_y"))
    return rows.join(placed.select("uid", "edge_case_pca_x", "edge_case_pca_y"), "uid", "left")


def iterate(examples: DataFrame, guidelines: DataFrame, saved_rules: DataFrame, task_id: str, next_round: int,
            work_dir: str, plugins: Plugins, registry: DataFrame | None = None,
            out_path: str | None = None, history_path: str | None = None, registry_path: str | None = None) -> dict[str, DataFrame]:
    """Guideline + saved rules (A9) -> B1 and B2 at the next round (U3: with ``out_path`` the new round is one more
    partition of the rounds table; with ``history_path`` the guideline it is labelled under is one more version of the history,
    in force from this round on, and the whole history is returned too)."""
    complete = RU.complete_guideline(guidelines.where(F.col("task_id") == task_id), saved_rules)
    out = {"guideline": complete}
    if history_path is not None:
        out["history"] = record(complete, history_path, F.lit(next_round))
    ann = annotate_round(examples, complete, task_id, next_round, work_dir, plugins, registry, out_path=out_path, registry_path=registry_path)
    sugg, edge = discover_edge_cases(ann, task_id, next_round, work_dir, plugins, guideline=_guideline(complete, task_id)[0])
    return out | {"annotations": ann, "suggestions": sugg, "edge_cases": edge}


def compare_rounds(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """The evaluation tables of two rounds."""
    paired = R.pair_rounds(before, after)
    return {
        "counts": R.round_counts(before, after),
        "transitions": R.edge_transitions(paired),
        "paired_change": R.paired_confidence_change(paired),
        "match": R.match_summary(R.match_rounds(after, before)),
        "by_class": R.confidence_shift_by_class(after, before),
        "statistics": R.round_statistics(after, before),
    }


def round_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """B5 in one row: sizes, edge counts, paired change and resolved rows."""
    paired = R.pair_rounds(before, after)
    b, a = F.col("new_edge_case_original"), F.col("new_edge_case_reannotated")
    p = paired.agg(F.count(F.lit(1)).alias("paired_rows"),
                   F.round(F.avg(F.col("confidence_reannotated") - F.col("confidence_original")), 6)
                   .alias("mean_paired_change"),
                   F.count_if(b & ~a).alias("true_to_false"), F.count_if(~b & a).alias("false_to_true"),
                   F.count_if(b).alias("paired_edges_before"), F.count_if(a).alias("paired_edges_after"))
    return p
