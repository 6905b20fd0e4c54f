"""State that outlives a run: keyed store, guideline history, template versions, merges in blocks, stored clusters, the stream's tables."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulesift.functions.parse import parse_annotations
from rulesift.operators import cache as C
from rulesift.operators import history as H
from rulesift.operators import keyed_store as K
from rulesift.operators import merge_blocks as MB
from rulesift.operators import stored_cells as S
from rulesift.operators import templates as TP
from rulesift.operators.balance import balanced_clusters
from rulesift.operators.nearest import Centres, nearest
from rulesift.operators.rounds import order_digest, point_links, round_counts
from rulesift.plans import jobs as J
from rulesift.schema import RESPONSE_CACHE
from rulesift.session import shared_path


# --- keyed store (J2, J3) --------------------------------------------------------

def _rows(spark, numbers, text="a", error=None):
    return spark.createDataFrame([(n,) for n in numbers], "n long").select(
        F.lit("m").alias("model"), F.sha2(F.col("n").cast("string"), 256).alias("prompt_key"),
        (F.lit(None).cast("string") if error else F.concat(F.lit(text), F.col("n").cast("string"))).alias("response"), F.lit(None).cast("string").alias("response_reasoning"),
        F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(error).cast("string").alias("error"))


def _keys(spark, numbers):
    return K.distinct_keys(_rows(spark, numbers), "prompt_key")


def _store(spark, name, model="m"):
    return K.KeyedStore(spark, shared_path(spark, name), RESPONSE_CACHE, "prompt_key", model)


def test_a_lookup_reads_only_prefixes_that_may_hold_a_key(spark, monkeypatch):
    monkeypatch.setattr(K, "ROWS_A_PREFIX", 40)
    store = _store(spark, "prune", "org/model one")
    store.append(_rows(spark, range(2000)))
    assert store.fold(1)
    (run,) = store.manifest()["runs"]
    assert run["rows"] == 2000 and run["digits"] == 2 and len(run["prefixes"]) > 200
    wanted = [5, 77, 1234]
    prefixes = {r[0] for r in _keys(spark, wanted).select(K.prefix_of("prompt_key", 2)).collect()}
    found = store.lookup(_keys(spark, wanted))
    assert sorted(r.response for r in found.collect()) == ["a1234", "a5", "a77"]
    read = {re.search(r"prefix=(\w+)", f).group(1) for f in found.inputFiles() if "/data/" in f}
    assert read == prefixes
    # keys that were never stored: hardly any prefix is read
    unknown = _keys(spark, range(10_000, 10_100))
    assert len(store.candidates(unknown, run)) < 30
    assert store.lookup(unknown).count() == 0


def test_files_stay_few_and_every_row_is_found(spark):
    store = _store(spark, "fold")
    for i in range(50):
        store.append(_rows(spark, range(10 * i, 10 * i + 10)).coalesce(2))
        store.fold()
    assert store.files() <= 2 * K.FOLD_BATCHES + 8
    assert len(store.manifest()["runs"]) <= 4 and len(store.manifest()["log"]) < K.FOLD_BATCHES
    assert {r.response for r in store.lookup(_keys(spark, range(-5, 600))).collect()} == {f"a{i}" for i in range(500)}
    assert store.rows().count() == 500


def test_an_answer_comes_before_an_error_and_writers_do_not_lose_batches(spark):
    store = _store(spark, "order")
    store.append(_rows(spark, range(6), error="failed"))
    store.fold(1)
    other = K.KeyedStore(spark, store.top, RESPONSE_CACHE, "prompt_key", "m")
    stale = other.manifest()
    store.append(_rows(spark, [1, 2], "b"))
    other.append(_rows(spark, [2, 3], "c"))
    assert other.manifest()["version"] == stale["version"] + 2
    one = {r.prompt_key: r.response for r in K.one_row(store.lookup(_keys(spark, range(6))), "prompt_key", RESPONSE_CACHE).collect()}
    assert sorted(filter(None, one.values())) == ["b1", "b2", "c3"]
    assert store.fold(1) and {r.response for r in store.rows().collect()} == {None, "b1", "b2", "c3"}


def test_a_reader_keeps_its_files_over_one_fold(spark):
    store = _store(spark, "grace")
    store.append(_rows(spark, range(20)))
    held = store.lookup(_keys(spark, range(20)))
    store.fold(1)
    assert held.count() == 20


def test_a_cache_of_the_earlier_layout_is_taken_over(spark):
    path = shared_path(spark, "old")
    key = F.sha2(F.concat(F.lit("x")), 256)
    _rows(spark, [1]).withColumn("prompt_key", key).write.partitionBy("model").parquet(path)

    def never(prompts):
        raise AssertionError("asked again")

    got = C.respond_with_cache(spark.createDataFrame([("x",)], "prompt string"), path, "m", never).collect()
    assert [(r.response, r.cache_hit) for r in got] == [("a1", True)]


# --- guideline history (U3) --------------------------------------------------------

def test_history_is_appended_and_read_as_of(spark):
    path = shared_path(spark, "history")
    g = lambda *rows: spark.createDataFrame(rows, "task_id string, guideline string")
    H.record(g(("a", "one"), ("b", "one"), (None, "x")), path, F.lit(0))
    H.record(g(("a", "one"), ("b", "two")), path, F.lit(3))
    h = H.record(g(("a", "three")), path, F.lit(5))
    assert sorted((r.task_id, r.version, r.valid_from, r.valid_to) for r in H.intervals(h).collect()) == [
        ("a", 1, 0, 5), ("a", 2, 5, None), ("b", 1, 0, 3), ("b", 2, 3, None)]
    rows = spark.createDataFrame([("a", -1), ("a", 0), ("a", 4), ("a", 5), ("b", 99), ("c", 1), (None, 1), ("a", None)], "task_id string, at int")
    got = {(r.task_id, r.at): r.guideline_version for r in H.as_of(rows, h, "at").collect()}
    assert got == {("a", -1): None, ("a", 0): 1, ("a", 4): 1, ("a", 5): 2, ("b", 99): 2, ("c", 1): None, (None, 1): None, ("a", None): None}
    with pytest.raises(ValueError):
        H.record(g(("a", "four")), path, F.lit(2))
    again = H.record(g(("a", "five")), path, F.lit(5))  # a round that is run again
    assert H.as_of(rows, again, "at").where("task_id = 'a' and at = 5").first().guideline_version == 3


def test_a_task_with_most_answers_is_not_shuffled(spark):
    h = H.append_versions(None, spark.createDataFrame([("hot", "g")], "task_id string, guideline string"), F.lit(1))
    rows = spark.createDataFrame([("hot", i) for i in range(1000)], "task_id string, at int")
    out = H.as_of(rows, h, "at")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.where("guideline_version = 1").count() == 999


# --- template versions (F3) ----------------------------------------------------------

def test_templates_are_filled_in_one_pass(spark):
    df = spark.createDataFrame([("A {{x}} {guideline}|{rules}|{text}|{text} {other}", "g {text}", None, "t {rules}")], "template string, g string, r string, t string")
    got = df.select(TP.render(F.col("template"), guideline=F.col("g"), rules=F.col("r"), text=F.col("t"))).first()[0]
    assert got == "A {x} g {text}||t {rules}|t {rules} {other}"
    assert spark.createDataFrame([("{{text}} plain",)], "template string").select(TP.render(F.col("template"), text=F.lit("T"))).first()[0] == "{text} plain"


def test_only_touched_rows_are_asked_again(spark):
    plain, ruled = "G {guideline} T {text}", "G {guideline} R {rules} T {text}"
    versions = spark.createDataFrame([
        (1, "a", plain, "g", ""), (2, "a", plain, "g", "r"), (3, "a", ruled, "g", "r"), (4, "a", ruled, "g", "r2"), (5, "a", plain, "g", ""), (6, "a", plain, "g2", ""),
        (1, "b", plain, "g", ""), (2, "b", plain, "g", ""), (3, "b", plain, "g", "r")], "version int, task_id string, template string, guideline string, rules string")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 2, "x")], "task_id string, since int, text_to_annotate string")
    got = {(r.version, r.task_id): (r.rows, r.reasked) for r in TP.plan_versions(rows, versions).collect()}
    assert got == {(1, "a"): (2, 2), (2, "a"): (2, 0), (3, "a"): (3, 3), (4, "a"): (3, 3), (5, "a"): (3, 1), (6, "a"): (3, 3), (2, "b"): (1, 1), (3, "b"): (1, 0)}
    path, asked = shared_path(spark, "versions"), {}
    for v in range(1, 7):
        out = TP.ask_version(rows.where(F.col("since") <= v), versions, v, path, "m", C.offline_annotator())
        asked[v] = out.where("task_id = 'a' and not cache_hit").count()
    assert asked == {1: 2, 2: 0, 3: 3, 4: 3, 5: 1, 6: 3}


# --- merging by the model (J9, F8) ----------------------------------------------------

def _merge(spark, rules, merger, **options):
    df = spark.createDataFrame(rules, "rule_no long, rule string")
    return {r.rule_no: (r.component, r.merged_rule) for r in MB.merge_by_model(df, merger, cache_path=shared_path(spark, "merges"), **options).collect()}


def test_no_prompt_over_its_limits_and_sets_meet_over_blocks(spark, tmp_path):
    seen = tmp_path / "prompts"
    rules = [(i, f"When the text number {i:03d} of kind {i % 3} is unclear -> label {i % 3}") for i in range(1, 71)] + [(100, "something else entirely"), (101, "")]

    def by_kind(prompt):
        body = prompt.split("<rules>\n")[1].split("\n</rules>")[0]
        with open(seen, "a") as f:
            f.write(f"{len(body.splitlines())} {len(body)}\n")
        sets = collections.defaultdict(list)
        for n, k in re.findall(r"^(\d+)\. When the text(?: number \d+)? of kind (\d)", body, re.M):
            sets[k].append(n)
        return "\n".join(f"Merge [{', '.join(v)}, 999]: When the text of kind {k} is unclear -> label {k}" for k, v in sets.items() if len(v) > 1) or "NO MERGE"

    got = _merge(spark, rules, by_kind, limit=10, budget=500)
    sizes = [tuple(map(int, x.split())) for x in seen.read_text().splitlines()]
    assert len(sizes) > 7 and all(n <= 10 and c <= 500 for n, c in sizes)
    assert {got[i] for i in range(1, 71)} == {(k or 3, f"When the text of kind {k} is unclear -> label {k}") for k in range(3)}
    assert got[100] == (100, "something else entirely") and got[101] == (101, "")


def test_answers_that_share_a_rule_are_one_set(spark):
    rules = [(i, f"When words {'abcdef'[i]} and more words are here -> do it") for i in range(5)]
    got = _merge(spark, rules, lambda p: "Merge [1, 2]: first\nMerge [2, 3]: second\nMerge [5]: alone")
    assert [got[i] for i in range(5)] == [(0, "first"), (0, "first"), (0, "first"), (3, rules[3][1]), (4, "alone")]
    assert _merge(spark, rules, lambda p: "NO MERGE") == {i: (i, r) for i, r in rules}
    assert _merge(spark, [], lambda p: "NO MERGE") == {}


def test_a_rule_longer_than_the_budget_is_alone(spark):
    rules = [(i, f"same words every time {'x' * (300 if i == 2 else 1)} {i}") for i in range(1, 6)]
    blocks = MB.cut_blocks(spark.createDataFrame([(1, n, r) for n, r in rules], "component long, rule_no long, rule string"), limit=40, budget=100).collect()
    by = collections.defaultdict(list)
    for b in blocks:
        by[b.block].append(b)
    assert all(sum(len(b.rule) + 8 for b in v) <= 100 or len(v) == 1 for v in by.values()) and len(blocks) == 5


def test_offline_merger_reads_its_own_prompt():
    prompt = MB.MERGE_TEMPLATE.format(guideline="1. not a rule", rules="1. a b c d e\n2. a b c d e\n3. x y z")
    assert MB.offline_merger(prompt) == "Merge [1, 2]: a b c d e"
    assert MB.offline_merger(MB.MERGE_TEMPLATE.format(guideline="", rules="1. a\n2. b")) == "NO MERGE"


# --- nearest centres (M3) and stored clusters (M5, M8) --------------------------------------

def test_nearest_is_exact_and_skips_blocks():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (3000, 16)) * rng.uniform(0.1, 30, (3000, 1))
    x = centres[rng.integers(0, 3000, 700)] + rng.normal(0, 0.01, (700, 16))
    all_d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    d2, number, done = Centres.of(np.arange(3000), centres).search(x, 5)
    order = np.argsort(all_d, axis=1, kind="stable")[:, :5]
    assert (number == order).all() and np.allclose(d2, np.take_along_axis(all_d, order, 1))
    assert done < 6 * 12  # of six blocks of rows and twelve of centres: those whose norms cannot match are not multiplied
    assert Centres.of(np.arange(3000), centres).search(x, 1)[2] <= 24


def test_nearest_edges(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0]), (3, None)], "id long, v array<float>")
    centres = spark.createDataFrame([(7, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [5.0, 5.0]), (None, [0.0, 0.0]), (8, None)], "c int, m array<double>")
    got = {r.id: (r["_labels"], r["_distances"]) for r in nearest(points, centres, "c", "m", "v", k=2).collect()}
    assert got == {1: ([4, 7], [1.0, 1.0]), 2: ([9, 4], [0.0, 41.0]), 3: ([], [])}
    assert nearest(points, centres.limit(0), "c", "m", "v").where("size(_labels) > 0").count() == 0


def _vectors(spark, n, seed, spread=1.0, prefix="u"):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(x) for x in rng.normal(0, spread, 4)]) for i in range(n)], "uid string, embedding array<float>")


@pytest.mark.parametrize("added,spread", [(25, 1.0), (60, 0.01), (1, 1.0), (0, 1.0)])
def test_new_rules_join_stored_clusters(spark, added, spread):
    old = _vectors(spark, 200, 0)
    before = balanced_clusters(old).join(old, "uid").checkpoint()
    after = S.assign_new_rules(before, _vectors(spark, added, 1, spread, "n") if added else old.limit(0)).collect()
    assert len(after) == len({r.uid for r in after}) == 200 + added
    sizes = collections.Counter(r.cluster_id for r in after)
    assert all(10 <= n <= 20 for n in sizes.values())
    was = {r.uid: r.cluster_id for r in before.collect()}
    refit = {was[r.uid] for r in after if r.how == "refit" and r.uid in was}
    assert all(r.cluster_id == was[r.uid] for r in after if r.uid in was and was[r.uid] not in refit)
    assert len(refit) <= 1


def test_full_clusters_are_refitted(spark):
    old = _vectors(spark, 40, 0)
    before = balanced_clusters(old, k=2).join(old, "uid").checkpoint()  # two clusters of twenty
    after = S.assign_new_rules(before, _vectors(spark, 3, 1, 1.0, "n")).collect()
    sizes = collections.Counter(r.cluster_id for r in after)
    assert sorted(sizes.values()) in ([11, 12, 20], [10, 13, 20]) and sum(r.how == "refit" for r in after) == 23
    many = S.assign_new_rules(before, _vectors(spark, 47, 1, 1.0, "n")).collect()
    sizes = collections.Counter(r.cluster_id for r in many)
    assert len(many) == 87 and all(10 <= n <= 20 for n in sizes.values())
    assert sum(r.how == "stored" for r in many) == 40


def test_bids_go_to_the_nearest_cluster_with_room(spark):
    cells = spark.createDataFrame([(0, 19, [0.0, 0.0]), (1, 18, [1.0, 0.0]), (2, 20, [0.0, 0.0])], "cluster_id int, size long, centre array<double>")
    new = spark.createDataFrame([("a", [0.1, 0.0]), ("b", [0.0, 0.0]), ("c", [0.2, 0.0]), ("d", [0.3, 0.0])], "uid string, embedding array<float>")
    placed, left = S.bid(new, cells, 20)
    assert {r.uid: r.cluster_id for r in placed.collect()} == {"b": 0, "d": 1, "c": 1}
    assert [r.uid for r in left.collect()] == ["a"]


def test_stored_clusters_are_versions(spark):
    path, old = shared_path(spark, "cells"), _vectors(spark, 60, 0)
    first = {r.uid: r.cluster_id for r in S.rule_clusters(old, path).collect()}
    again = {r.uid: r.cluster_id for r in S.rule_clusters(old.union(_vectors(spark, 2, 5, 1.0, "n")), path, reuse=True).collect()}
    assert len(again) == 62 and all(again[u] == c for u, c in first.items())
    assert S.stored_versions(spark, path) == [0, 1]


# --- registry and the stream (J1, T1) --------------------------------------------------------

def _examples(spark, texts, first=0):
    return spark.createDataFrame([("t", first + i, t) for i, t in enumerate(texts)], "task_id string, ordinal long, text_to_annotate string")


def _guideline(spark):
    return spark.createDataFrame([("t", "Decide.\n\nLabels:\n- 0\n- 1")], "task_id string, guideline string")


def test_rounds_add_to_the_stored_registry(spark):
    work, path = shared_path(spark, "w"), shared_path(spark, "registry")
    one = {r.text_to_annotate: r.uid for r in J.annotate_round(_examples(spark, ["a b", "c d"]), _guideline(spark), "t", 0, work, J.offline_plugins(), registry_path=path).collect()}
    store = J.registry_of(spark, path, "t")
    assert {r.text_to_annotate: r.uid for r in store.rows().collect()} == one
    store.append(spark.createDataFrame([("t", r.text_key, "e f", "imported") for r in _examples(spark, ["e f"]).select(J.text_key("text_to_annotate").alias("text_key")).collect()],
                                       "task_id string, text_key string, text_to_annotate string, uid string"))
    two = {r.text_to_annotate: r.uid for r in J.annotate_round(_examples(spark, ["e f", "c d", "new"]), _guideline(spark), "t", 1, work, J.offline_plugins(), registry_path=path).collect()}
    assert two["c d"] == one["c d"] and two["e f"] == "imported" and store.rows().count() == 4


def test_stream_folds_and_replays(spark, monkeypatch):
    from rulesift.streaming import increment as I
    fold = I.fold
    monkeypatch.setattr(I, "fold", lambda s, o, e: fold(s, o, e, 2))
    work, out = shared_path(spark, "w"), shared_path(spark, "out")
    ann = J.annotate_round(_examples(spark, [f"text {i}" for i in range(12)]), _guideline(spark), "t", 0, work, J.offline_plugins())
    texts = [[f"new {i}", f"text {i}"] for i in range(5)]
    inp = shared_path(spark, "in")
    for i, t in enumerate(texts):
        _examples(spark, t, 100 + 2 * i).coalesce(1).write.mode("append").parquet(inp)
    I.start(spark, inp, out, shared_path(spark, "ck"), ann, _guideline(spark), "t", 0, work, J.offline_plugins(), max_files_per_trigger=1).awaitTermination()
    assert I._numbers(spark, f"{out}/scored", "batch") == [2, 3, 4] and I._numbers(spark, f"{out}/folded", "upto") == [1, 3]
    tables = I.current_tables(spark, ann, out, "t")
    rows = {r.text_to_annotate: r for r in tables.annotations.collect()}
    assert len(rows) == 12 + 5 and sum(r.is_reannotated for r in rows.values()) == 10
    assert {r.text_to_annotate for r in tables.registry.collect()} == {x for t in texts for x in t}
    # an epoch that is scored again changes nothing
    J.annotate_increment(_examples(spark, texts[4], 108), ann.limit(0), _guideline(spark), "t", 0, work, J.offline_plugins(), registry_path=f"{out}/registry").annotations \
        .write.mode("overwrite").parquet(f"{out}/scored/batch=4")
    again = I.current_tables(spark, ann, out, "t")
    assert {r.text_to_annotate: (r.uid, r.annotation) for r in again.annotations.collect()} == {t: (r.uid, r.annotation) for t, r in rows.items()}
    assert again.registry.count() == 10


def test_iterate_keeps_the_guideline_history(spark):
    work, path = shared_path(spark, "w"), shared_path(spark, "h")
    ex = _examples(spark, [f"text {i}" for i in range(6)])
    rules = spark.createDataFrame([("t", 0, "When odd -> 1")], "task_id string, cluster_no int, rule string")
    J.iterate(ex, _guideline(spark), rules.limit(0), "t", 1, work, J.offline_plugins(), history_path=path)
    out = J.iterate(ex, _guideline(spark), rules, "t", 2, work, J.offline_plugins(), history_path=path)
    assert sorted((r.version, r.valid_from, "When odd" in r.guideline) for r in out["history"].collect()) == [(1, 1, False), (2, 2, True)]


# --- A6, J6, F6 ---------------------------------------------------------------------------

def test_order_of_rounds(spark):
    frame = lambda ids, first=0: spark.createDataFrame([(i, first + n) for n, i in enumerate(ids)], "uid string, ordinal long")
    same = lambda a, b: R(a, b)

    def R(a, b):
        r = round_counts(a, b, order="ordinal").first()
        return r.same_ids, r.same_order

    assert same(frame("abcd"), frame("abcd", 5).repartition(3)) == (True, True)
    assert same(frame("abcd"), frame("abdc")) == (True, False)
    assert same(frame("aabb"), frame("abab")) == (True, False) and same(frame("aabb"), frame("aabb")) == (True, True)
    assert same(frame("abc"), frame("abd")) == (False, False)
    assert order_digest(frame("").limit(0)).first().rows == 0


def test_links_pair_copies_once(spark):
    schema = "uid string, text_to_annotate string"
    points = spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", "x"), ("k", "y"), (None, "z"), (None, "z"), ("q", None)], schema)
    target = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("k", "other"), ("t3", "y"), ("t4", "z"), ("t5", None)], schema)
    got = sorted(((r.uid or "", r.target_uid, r.way) for r in point_links(points, target).collect()))
    assert got == [("", "t4", "text"), ("k", "k", "uid"), ("p1", "t1", "text"), ("p2", "t2", "text")]
    back = sorted(((r.target_uid or "", r.uid, r.way) for r in point_links(target, points).collect()))
    assert back == got


@pytest.mark.parametrize("value", ["99999999999999999999.5", "1e30", "-1e400", "12345678901234567890", "NaN", '"NaN"', '"1e999"', "[1]", '{"a": 1}', "null", "1.0", "2.7"])
@pytest.mark.parametrize("field", ["annotation", "confidence", "new_edge_case"])
def test_no_answer_can_end_a_job(spark, field, value):
    fields = {"analysis": '"x"', "annotation": "0", "confidence": "50", "new_edge_case": "true", "new_edge_case_rule": '"r"'} | {field: value}
    body = "{" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + "}"
    df = spark.createDataFrame([(body,)], "raw_annotations string").withColumn("labels", F.array(F.lit("no"), F.lit("yes")))
    (r,) = parse_annotations(df).collect()
    assert r.annotation in ("no", "yes", "-1")


# --- S6, O6, A12 ------------------------------------------------------------------------------

def test_a_changed_section_shows(spark):
    from rulesift.sources import sinks
    path = shared_path(spark, "bundle")
    rows = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "uid string, x double")
    sinks.export_bundle(path, "t", 3, points=rows, guideline=spark.createDataFrame([("t", "g")], "task_id string, guideline string"), none=rows.limit(0))
    assert {(r.section, r.found_rows, r.intact) for r in sinks.verify_bundle(spark, path).collect()} == {("points", 2, True), ("guideline", 1, True), ("none", 0, True)}
    assert sorted(map(tuple, sinks.read_section(spark, path, "points").collect())) == [("a", 1.0), ("b", None)]
    assert sinks.read_manifest(spark, path).where("exported_at is not null and round = 3").count() == 3
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "uid string, x double").write.mode("overwrite").parquet(f"{path}/points")
    assert {r.section: r.intact for r in sinks.verify_bundle(spark, path).collect()} == {"points": False, "guideline": True, "none": True}


def test_a_page_reads_its_part(spark):
    from rulesift.operators.explore import sorting
    from rulesift.operators.stored_pages import StoredPages, write_pages
    rows = spark.range(2000).select(F.format_string("u%05d", "id").alias("uid"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text_to_annotate"),
                                    ((F.col("id") * 37) % 101).cast("double").alias("confidence"), (F.col("id") % 3).cast("string").alias("annotation"))
    for option in ("confidence", "class"):
        path = shared_path(spark, "pages")
        assert write_pages(rows, option, path, part_rows=100) == 2000
        keyed, order = sorting(rows, option)
        want = [r.uid for r in keyed.orderBy(*order).collect()]
        pages = StoredPages(spark, path)
        for p in (1, 7, 40, 41):
            got = pages.page(p)
            assert [r.uid for r in sorted(got.collect(), key=lambda r: r.page_rank)] == want[50 * (p - 1):50 * p]
            assert len({f.split("part=")[1].split("/")[0] for f in got.inputFiles()}) <= 1
        assert pages.rank("u00007") == want.index("u00007") + 1 and pages.rank("nobody") is None
        pinned = pages.page(2, pinned_uid=want[1500]).collect()
        assert len(pinned) == 51 and max(pinned, key=lambda r: r.page_rank).uid == want[1500]
        assert pages.page(2, pinned_uid=want[60]).count() == 50
    empty = shared_path(spark, "pages")
    assert write_pages(rows.limit(0), "confidence", empty) == 0 and StoredPages(spark, empty).page(1, "x").count() == 0


def test_only_computed_calls_cost(spark):
    work, prices = shared_path(spark, "w"), spark.createDataFrame([("annotator", 1.0, 1.0)], "model string, input_usd_per_mtok double, output_usd_per_mtok double")
    for _ in range(2):  # the second round finds its answers in the cache
        J.annotate_round(_examples(spark, ["a", "b", "a"]), _guideline(spark), "t", 0, work, J.offline_plugins()).count()
    (r,) = J.job_costs(spark, work, prices).collect()
    assert (r.calls, r.failed) == (2, 0) and r.cost_usd == pytest.approx((r.input_tokens + r.output_tokens) / 1e6, abs=1e-6)
    assert J.job_costs(spark, work, prices.limit(0)).first().cost_usd is None


# --- P8 ------------------------------------------------------------------------------------------

def test_indexed_search_finds_the_same_rows_in_fewer_blocks(spark):
    from rulesift.operators.explore import search
    from rulesift.operators.search_index import SearchIndex, build
    texts = [f"text {i} about {'needles' if i in (17, 333) else 'hay'} Ünï {i % 7}" for i in range(600)] + ["", "a", "ab", None, "😀x", "xq", "q"]
    rows = spark.createDataFrame([(f"u{i}", t, None if i % 2 else f"note {i}") for i, t in enumerate(texts)], "uid string, text_to_annotate string, analyses string").repartition(4)
    path = shared_path(spark, "search")
    build(rows, path, block_rows=10)
    index = SearchIndex(spark, path)
    for term in ("needle", "NEEDLES", "ünï 3", "a", "ab", "q", "😀", "😀x", "note 12", "zz", "zzz", "text 599 about", " ", "", "t"):
        assert sorted(r.uid for r in index.search(term).collect()) == sorted(r.uid for r in search(rows, term).collect()), term
    assert index.blocks("needle").count() == 2 and index.blocks("zzz").count() == 0 and index.blocks("text").count() >= 60
    assert index.search("needle").columns == rows.columns


def test_few_rules_are_clustered_by_kmeans(spark):
    far = [(f"u{i:02d}", [float(i >= 3) * 50 + i * 0.01, 0.0]) for i in range(18)]
    got = {r.uid: r.cluster_id for r in balanced_clusters(spark.createDataFrame(far, "uid string, embedding array<float>")).collect()}
    assert len(got) == 18 and len({got[f"u{i:02d}"] for i in range(3)}) == 1 and len({got[f"u{i:02d}"] for i in range(3, 18)}) == 1 and len(set(got.values())) == 2
    few = balanced_clusters(spark.createDataFrame(far[:9], "uid string, embedding array<float>")).collect()
    assert {r.cluster_id for r in few} == {0}
