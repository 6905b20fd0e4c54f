"""Layers 2-4: ledger cases on hand-made rows, invariants of the non-SQL
operators, and re-run equality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01


# --- parsing (F4-F8) on hand-made responses ---------------------------------------------

def _parse(spark, responses, labels=("a", "b")):
    from rulesift.functions.parse import parse_annotations
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "id int, raw_annotations string")
    df = df.withColumn("labels", F.array(*[F.lit(x) for x in labels]))
    return {r["id"]: r for r in parse_annotations(df).collect()}


def test_parse_ledger_cases(spark):
    out = _parse(spark, [
        '{"analysis": "x", "annotation": 1, "confidence": 80, "new_edge_case": false, "new_edge_case_rule": "EMPTY"}',
        '```json\n{"analysis": "x", "annotation": "0", "confidence": "95", "new_edge_case": "True",'
        ' "new_edge_case_rule": "When a -> b"}\n```',
        '<think>hmm</think>{"analysis": "y", "annotation": "-1", "confidence": 40, "new_edge_case": true, '
        '"new_edge_case_rule": "When c -> d"}',
        '{\n"analysis": "broken",\n"annotation": 7,\n"confidence": 33,\n"new_edge_case_rule": "When x: y -> z",\n}',
        '{\n"analysis": "words",\n"annotation": "one",\n"new_edge_case": True,\n}',
        None,
        '',
        '{"analysis": "f", "annotation": "1.0", "confidence": 60, "new_edge_case": false, "new_edge_case_rule": null}',
    ])
    assert out[0]["annotation"] == "b" and out[0]["confidence"] == 80 and out[0]["parse_ok"]
    assert out[1]["annotation"] == "a" and out[1]["confidence"] == 95 and out[1]["new_edge_case"] is True
    assert out[2]["annotation"] == "-1" and out[2]["guideline_improvement"] == "When c -> d"     # L1
    assert not out[3]["parse_ok"] and out[3]["annotation"] == "-1"                              # out of range
    assert out[3]["confidence"] == 33 and out[3]["new_edge_case"] is False                       # L6 default
    assert out[3]["guideline_improvement"] == "When x: y -> z"                                   # L8 first colon
    assert out[4]["new_edge_case"] is True and out[4]["confidence"] == 50.0                      # defaults
    assert out[5]["annotation"] == "-1" and out[6]["annotation"] == "-1"                         # null / empty
    assert out[7]["annotation"] == "b" and out[7]["guideline_improvement"] is None               # L19, L3


def test_parse_categories_malformed(spark):
    from rulesift.functions.parse import parse_categories, parse_merges
    text = "Category 1: something\nEdge Cases in Category 1: [1, 3]\n"
    df = spark.createDataFrame([(0, text), (1, "no json at all")], "k int, response string")
    assert parse_categories(df, "k").count() == 0                         # non-JSON gives nothing
    m = spark.createDataFrame([(0, "Merge [1, 2]: When a: b -> c\nMerge [3]: x"), (1, "NO MERGE")],
                              "k int, response string")
    rows = sorted((r["merge_no"], r["member"], r["merged_rule"]) for r in parse_merges(m, "k").collect())
    assert rows == [(1, 1, "When a: b -> c"), (1, 2, "When a: b -> c"), (2, 3, "x")]


def test_guideline_labels_stop_at_rules(spark):
    from rulesift.functions.text import guideline_label_lines, guideline_task
    g = "Task.\n- not a label\n\nLabels:\n- yes\n- no\n\nEdge Case Handling:\n1. When x -> y\n- z"
    r = spark.range(1).select(guideline_label_lines(F.lit(g)).alias("l"), guideline_task(F.lit(g)).alias("t")).first()
    assert r["l"] == ["yes", "no"] and r["t"] == "Task.\n- not a label"                        # L2
    plain = "Task\n\nLabels: 1 (yes) or 0 (no)"
    assert spark.range(1).select(guideline_label_lines(F.lit(plain))).first()[0] == []


def test_prompt_does_not_substitute_inside_guideline(spark):
    from rulesift.functions.text import render_prompt
    p = spark.range(1).select(render_prompt("G={guideline} T={text} {{x}}", F.lit("has {text}"), F.lit("abc"))).first()[0]
    assert p == "G=has {text} T=abc {x}"


def test_clean_and_dedup(spark):
    from rulesift.sources.ingest import clean_examples
    df = spark.createDataFrame([("t", 0, "  a\x01b "), ("t", 1, "ab"), ("t", 2, "\x02"), ("t", 3, None),
                                ("t", 4, "c\td")], "task_id string, ordinal long, text_to_annotate string")
    got = sorted((r["ordinal"], r["text_to_annotate"]) for r in clean_examples(df).collect())
    assert got == [(0, "ab"), (4, "c\td")]


# --- distributed ranking ------------------------------------------------------------------

def test_global_row_number_exact(spark):
    from rulesift.operators.ranking import global_row_number
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    out = global_row_number(df, ["k"], "rn", partitions=7).select("k", "rn").collect()
    assert sorted((r["k"] + 1, r["rn"]) for r in out) == [(i, i) for i in range(1, 5001)]


@pytest.mark.parametrize("keys", [3000, 1])
def test_no_task_of_a_ranking_holds_much_text(spark, monkeypatch, keys):
    from rulesift.operators import ranking
    monkeypatch.setattr(ranking, "PARTITION_BYTES", 100_000, raising=False)
    df = spark.range(3000).select((F.col("id") * 7919 % keys).alias("k"), F.repeat(F.lit("x"), 1000).alias("text"))
    out = ranking.global_row_number(df, ["k"], "rn").withColumn("p", F.spark_partition_id())
    assert max(r["count"] for r in out.groupBy("p").count().collect()) <= 400          # 30 partitions of 100 rows, sampled bounds
    rows = out.select("k", "rn").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["rn"])] == sorted(r["k"] for r in rows) and {r["rn"] for r in rows} == set(range(1, 3001))


# --- ML invariants (section 5, layer 3) -------------------------------------------------------

def _sizes(df):
    return sorted(r["c"] for r in df.groupBy("cluster_id").agg(F.count("*").alias("c")).collect())


@pytest.mark.parametrize("leaf_rows", [20_000, 60])
def test_balanced_clusters_limits(spark, leaf_rows):
    from rulesift.operators.balance import balanced_clusters
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("uid"),
                                                                   "embedding")
    out = balanced_clusters(emb, leaf_rows=leaf_rows)
    n = emb.count()
    sizes = _sizes(out)
    assert len(sizes) == n // 15 + 1                          # M6
    assert min(sizes) >= 10 and max(sizes) <= 20              # M7, n > 40
    assert out.select("uid").distinct().count() == n          # every row exactly once
    ids = sorted(r[0] for r in out.select("cluster_id").distinct().collect())
    assert ids == list(range(n // 15 + 1))


def test_balanced_split_arithmetic():
    from rulesift.operators.balance import left_size

    def leaves(m, p):
        if p <= 1:
            return [m]
        c = left_size(m, p)
        return leaves(c, p // 2) + leaves(m - c, p - p // 2)

    for n in list(range(21, 2000)) + [100_000, 1_000_007]:
        k = n // 15 + 1
        s = leaves(n, k)
        lo, hi = (5, 20) if n <= 40 else (10, 20)
        assert len(s) == k and sum(s) == n and min(s) >= lo and max(s) <= hi, n


def test_pca_centred_and_matches_numpy(spark):
    from rulesift.operators import features as M
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    v = M.with_vector(emb)
    rows = M.project(M.fit_projection(v), v).select("vec_id", "pca_x", "pca_y", "embedding").collect()
    xy = np.array([[r["pca_x"], r["pca_y"]] for r in rows])
    assert np.allclose(xy.mean(axis=0), 0, atol=1e-9)
    assert xy[:, 0].var() >= xy[:, 1].var()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    ref = x @ vt[:2].T
    for i in range(2):
        assert np.allclose(np.abs(ref[:, i]), np.abs(xy[:, i]), atol=1e-6)


def test_kmeans_centres_are_member_means(spark):
    from rulesift.operators import features as M
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    v = M.with_vector(emb)
    model = M.fit_kmeans(v, v.count())
    out = M.assign_clusters(model, v).select("cluster", "embedding").collect()
    centres = model.stages[-1].clusterCenters()
    for c, centre in enumerate(centres):
        pts = np.array([r["embedding"] for r in out if r["cluster"] == c], dtype=np.float64)
        assert np.allclose(pts.mean(axis=0), centre, atol=1e-4)


def test_kmeans_tiny_inputs(spark):
    from rulesift.operators import features as M
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").limit(3)
    v = M.with_vector(emb)
    assert M.fit_kmeans(v, 1) is None
    assert M.fit_kmeans(v, 3).stages[-1].getK() == 3


def test_model_reuse_and_refit(spark):
    from rulesift.plans.ml_queries import model_reuse
    rows = model_reuse(spark, SF001).select("first_fit", "second_fit").distinct().collect()
    assert [(r[0], r[1]) for r in rows] == [(True, False)]


def test_merge_similar_components(spark):
    from rulesift.operators.generalise import merge_similar
    rules = spark.createDataFrame([
        (1, "When the text is short -> label 0"), (2, "when the text is  short -> label 0"),
        (3, "When the text is short and rude -> label 0"), (4, "Completely different rule about links"),
    ], "rule_no long, rule string")
    got = {r["rule_no"]: r["component"] for r in merge_similar(rules, threshold=0.6).collect()}
    assert got[1] == got[2] == 1 and got[4] == 4


# --- caches: a repeated run computes nothing new (layer 4) ------------------------------------

def test_response_cache_second_run_all_hits(spark):
    from rulesift.operators import cache as C
    from rulesift.session import shared_path
    path = shared_path(spark, "t_cache")
    calls = []

    def annotator(prompts):
        calls.append(len(prompts))
        return C.offline_annotator()(prompts)

    req = spark.read.parquet(f"{SF001}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("uid"), F.col("text").alias("prompt"))
    first = C.respond_with_cache(req, path, "annotator", annotator)
    assert first.where("response IS NULL").count() == 0
    second = C.respond_with_cache(req, path, "annotator", annotator)
    assert second.where("NOT cache_hit").count() == 0
    distinct = req.select("prompt").distinct().count()
    from rulesift.operators.keyed_store import KeyedStore
    from rulesift.schema import RESPONSE_CACHE
    assert KeyedStore(spark, path, RESPONSE_CACHE, "prompt_key", "annotator").rows().count() == distinct


def test_embedding_halving_retry(spark):
    from rulesift.operators.cache import call_halving

    def flaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("boom")
        return [[1.0, 0.0] for _ in texts]

    out = call_halving(flaky, ["a", "bad", "c", "d"])
    assert [e is None for _, e in out] == [True, False, True, True]
    assert out[1][0] is None and out[0][0] == [1.0, 0.0]


def test_shuffle_partitions_do_not_change_results(spark):
    from rulesift.plans.rounds_queries import round_match
    key = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = key(round_match(spark, SF001).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = key(round_match(spark, SF001).collect())
    assert a == b


def test_sorted_output_is_ordered(spark):
    from rulesift.plans.explore_queries import sort_confidence_change
    rows = sort_confidence_change(spark, SF001).collect()
    keys = [(r["sort_group"], r["sort_value"], r["uid"] or "") for r in rows if r["uid"] is not None]
    assert keys == sorted(keys)


def test_stream_equals_batch(spark):
    """The table built by the streaming increment equals the batch increment."""
    from rulesift.plans.jobs_queries import annotate_increment, stream_increment
    cols = ["uid", "cluster", "annotation", "confidence", "is_reannotated"]
    key = lambda df: sorted(tuple("" if v is None else str(v) for v in r) for r in df.select(cols).collect())
    assert key(stream_increment(spark, SF001)) == key(annotate_increment(spark, SF001))


def test_entry_flagship_values(spark):
    """The flagship query's rollup row equals the sum of its two groups."""
    import __spark_entry__ as e
    rows = {r["edge_before"]: r for r in e.entry(spark).collect()}
    assert rows[None]["rows"] == rows[True]["rows"] + rows[False]["rows"]
    assert rows[None]["resolved"] == rows[True]["resolved"]


def test_hot_text_third_of_rows(spark):
    """A text holding a third of all rows: reduced map-side, results whole."""
    from rulesift.operators.identity import assign_ids
    from rulesift.operators.rounds import match_rounds
    from rulesift.sources.ingest import clean_examples
    n = 3000
    ex = spark.range(n).select(
        F.lit("t").alias("task_id"), F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
        .alias("text_to_annotate"))
    cleaned = clean_examples(ex)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan or "partial_min" in plan            # combined before the shuffle
    rows = {r["text_to_annotate"]: r["ordinal"] for r in cleaned.collect()}
    assert len(rows) == n - n // 3 + 1 and rows["the same text"] == 0
    ids, adds = assign_ids(ex, None)
    assert ids.count() == n                                               # no row dropped or multiplied
    assert ids.where(F.col("text_to_annotate") == "the same text").select("uid").distinct().count() == 1
    assert adds.count() == n - n // 3 + 1
    prev = ids.select("uid", "text_to_annotate", F.lit(50.0).alias("confidence"),
                      F.lit(False).alias("new_edge_case"), F.lit("0").alias("annotation"))
    cur = ids.select(F.lit(None).cast("string").alias("uid"), "text_to_annotate", F.lit(60.0).alias("confidence"))
    m = match_rounds(cur, prev)
    assert m.count() == n and m.where("match_way = 'text'").count() == n


def test_merge_sections_defaults(spark):
    from rulesift.operators.registry import merge_sections
    df = spark.createDataFrame([(1, "a", "x1", 1), (1, "a", None, 2), (1, "b", "y", 3), (2, "b", "z", 1)],
                               "k int, sec string, val string, v int")
    got = {(r["k"], r["sec"]): r["val"] for r in merge_sections(df, ["k"], "sec", "val", ["v"],
                                                                 defaults={"a": "d", "c": "dc"}).collect()}
    assert got == {(1, "a"): "x1", (1, "b"): "y", (1, "c"): "dc", (2, "a"): "d", (2, "b"): "z", (2, "c"): "dc"}


def test_csv_without_data_row(spark, tmp_path):
    from rulesift.sources.ingest import read_texts_csv
    p = tmp_path / "empty.csv"
    p.write_text("﻿ Text_To_Annotate \n")
    with pytest.raises(ValueError):
        read_texts_csv(spark, str(p), "t")


def test_ledger_l10_bounded_retries_then_error(spark, tmp_path):
    from rulesift.operators import cache as C
    from rulesift.session import shared_path
    marks = str(tmp_path / "attempts")

    def broken(prompts):
        with open(marks, "a") as f:        # the function runs in a Python worker
            f.write("x")
        raise RuntimeError("service down")

    req = spark.createDataFrame([("u1", "same prompt"), ("u2", "same prompt")], "uid string, prompt string")
    out = C.respond_with_cache(req, shared_path(spark, "t_err"), "m", broken).collect()
    assert len(out) == 2 and all(r["response"] is None and "service down" in r["error"] for r in out)
    # Misses are deduplicated: one prompt, one batch, bounded attempts, then the error column.
    assert len(open(marks).read()) == C.MAX_ATTEMPTS


def test_ledger_l14_require_flag(spark):
    from rulesift.operators.rules import proposed_rules
    df = spark.createDataFrame([("a", "When x -> y", True), ("b", "When z -> w", False), ("c", " empty ", True),
                                ("d", None, True)], "uid string, guideline_improvement string, new_edge_case boolean")
    assert sorted(r["uid"] for r in proposed_rules(df).collect()) == ["a", "b"]          # L3: null is no rule
    assert [r["uid"] for r in proposed_rules(df, require_flag=True).collect()] == ["a"]


def test_ledger_l23_missing_models(spark):
    from rulesift.plans import jobs as J
    from rulesift.session import shared_path
    ex = spark.createDataFrame([("t", 0, "hello")], "task_id string, ordinal long, text_to_annotate string")
    g = spark.createDataFrame([("t", "Task\n\nLabels:\n- a\n- b")], "task_id string, guideline string")
    with pytest.raises(RuntimeError, match="no fitted models for task 't' round 3"):
        J.annotate_increment(ex, ex, g, "t", 3, shared_path(spark, "t_nomodel"), J.offline_plugins())


def test_ledger_l25_refit_when_keys_change(spark):
    from rulesift.operators import features as M
    from rulesift.session import shared_path
    root = shared_path(spark, "t_models")
    v = M.with_vector(spark.read.parquet(f"{SF001}/embeddings.parquet").select(
        F.col("vec_id").cast("string").alias("uid"), "embedding"))
    _, first = M.load_or_fit(spark, root, "t", 0, "p", v, M.fit_projection)
    _, same = M.load_or_fit(spark, root, "t", 0, "p", v, M.fit_projection)
    _, changed = M.load_or_fit(spark, root, "t", 0, "p", v.where("uid <> '0'"), M.fit_projection)
    _, reused = M.load_or_fit(spark, root, "t", 0, "p", v, M.fit_projection, reuse=True)
    assert (first, same, changed, reused) == (True, False, True, False)


def test_input_checks(spark):
    from rulesift.sources.ingest import input_report, raise_on_violations
    ex = spark.createDataFrame([("t", 0, "a"), ("t", 1, "  "), ("u", 0, "b")],
                               "task_id string, ordinal long, text_to_annotate string")
    g = spark.createDataFrame([("t", "Task\n\nLabels:\n- a"), ("u", "\n\nLabels:\n- a\n- b")],
                              "task_id string, guideline string")
    rep = {r["task_id"]: r for r in input_report(ex, g).collect()}
    assert rep["t"]["blank_examples"] == 1 and rep["t"]["one_label_warning"]        # L24: a warning
    assert rep["u"]["missing_task_text"]
    raise_on_violations(input_report(ex.where("task_id = 't'"), g.where("task_id = 't'")))   # blanks pass
    with pytest.raises(ValueError):
        raise_on_violations(input_report(ex, g))


def test_increment_projects_new_edge_rules(spark):
    """With a rule model for the round, flagged new edge cases get rule coordinates."""
    from rulesift.plans import jobs as J
    from rulesift.plans.jobs_queries import _guidelines, _round0_job
    work, ann = _round0_job(spark, SF001)
    J.discover_edge_cases(ann, "docs", 0, work, J.offline_plugins())          # fits the round's rule model
    new = spark.read.parquet(f"{SF001}/benchmark.parquet").select(
        F.lit("docs").alias("task_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("text_to_annotate"))
    out = J.annotate_increment(new, ann, _guidelines(spark), "docs", 0, work, J.offline_plugins()).annotations
    fresh = out.where("is_reannotated").collect()
    flagged = [r for r in fresh if r["new_edge_case"] and r["guideline_improvement"] not in (None, "EMPTY")]
    assert flagged and all(r["edge_case_pca_x"] is not None for r in flagged)
    assert all(r["edge_case_pca_x"] is None for r in fresh if not r["new_edge_case"])
