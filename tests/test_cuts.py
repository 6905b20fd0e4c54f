"""Lineage cuts, clustering and ids move and read only the columns that they use (round 3: F4, F7, F8, F10)."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rulesift.operators import balance as B
from rulesift.operators import stored_cells as S
from rulesift.plans import jobs as J
from rulesift.session import cut_lineage, shared_path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cut_is_read_by_column(spark):
    df = spark.createDataFrame([(1, "a", [1.0, None]), (2, None, None), (2, "", [])], "a int, b string, c array<double>").withColumn(
        "v", array_to_vector(F.array(F.lit(1.0), F.col("a").cast("double"))))
    cut = cut_lineage(df)
    assert sorted(map(str, cut.collect())) == sorted(map(str, df.collect())) and cut.dtypes == df.dtypes
    plan = _plan(cut.select("a"))
    assert "ReadSchema: struct<a:int>" in plan, plan
    assert cut_lineage(df.limit(0)).collect() == []
    void = spark.range(2).select("id", F.lit(None).alias("x"))  # no place in Parquet
    assert sorted(r.id for r in cut_lineage(void).collect()) == [0, 1]


def test_texts_of_rules_are_read_for_the_result_only(spark, tmp_path):
    n = 60
    spark.range(n).select(
        F.format_string("u%03d", "id").alias("uid"), F.lit("long text").alias("text_to_annotate"), F.lit(None).cast("string").alias("raw_annotations"),
        F.lit("a").alias("analyses"), F.lit("0").alias("annotation"), F.lit(50.0).alias("confidence"), F.lit(True).alias("new_edge_case"),
        F.concat(F.lit("When topic "), F.col("id").cast("string"), F.lit(" comes up -> label 1")).alias("guideline_improvement")).write.parquet(f"{tmp_path}/in")
    _, edge = J.discover_edge_cases(spark.read.parquet(f"{tmp_path}/in"), "t", 0, shared_path(spark, "w"), J.offline_plugins())
    assert "text_to_annotate" not in _plan(edge.select("uid", "edge_case_id", "low_level_rule"))
    rows = edge.select("uid", "text_to_annotate", "edge_case_id").collect()
    assert len(rows) == n and all(r.text_to_annotate == "long text" and r.edge_case_id is not None for r in rows)


@pytest.mark.parametrize("twice", [False, True])
def test_levels_rank_keys_only_and_cut_like_a_leaf(spark, monkeypatch, twice):
    rng = np.random.default_rng(3)
    rows = [(f"u{i:04d}", [float(v) for v in rng.normal(size=6) * (1, 1, 3, 1, 2, 1)]) for i in range(400)]
    if twice:
        rows = [(u, rows[i // 8 * 8][1]) for i, (u, _) in enumerate(rows)]  # equal places: the uid decides
    e = spark.createDataFrame(rows, "uid string, embedding array<double>").repartition(5)
    ranked, whole = [], B.global_row_number
    monkeypatch.setattr(B, "global_row_number", lambda df, *a: ranked.append(df.columns) or whole(df, *a))
    got = {r.uid: r.cluster_id for r in B.balanced_clusters(e, leaf_rows=60).collect()}
    assert ranked and all("x" not in c for c in ranked)
    sizes = np.bincount(list(got.values()))
    assert len(got) == 400 and len(sizes) == 400 // 15 + 1 and sizes.min() >= 14 and sizes.max() <= 15
    assert got == {r.uid: r.cluster_id for r in B.balanced_clusters(e).collect()}


def test_bids_are_those_of_the_rounds(spark):
    """Against the rounds one by one, in fewer Spark jobs than five cuts a round took."""
    rng = random.Random(5)
    place = lambda: [rng.gauss(0, 1) for _ in range(3)]
    cells = [(i, rng.choice([15, 17, 18, 19, 20]), place()) for i in range(30)]
    new = [(f"n{i:03d}", place()) for i in range(90)]
    room, left, want = {i: 20 - n for i, n, _ in cells if n < 20}, dict(new), {}
    centre = {i: np.array(c) for i, _, c in cells}
    rounds = 0
    while left and room:
        d = {u: sorted((((np.array(x) - centre[c]) ** 2).sum(), c) for c in room)[:S.CANDIDATES] for u, x in left.items()}
        while True:
            bids = {}
            for u, near in d.items():
                for dist, c in near:
                    if u in left and room.get(c, 0) > 0:
                        bids.setdefault(c, []).append((dist, u))
                        break
            rounds += 1
            if not bids:
                break
            for c, b in bids.items():
                for _, u in sorted(b)[:room[c]]:
                    want[u] = c
                    del left[u]
                room[c] -= min(len(b), room[c])
        room = {c: n for c, n in room.items() if n}
    spark.sparkContext.setJobGroup("bids", "bids")
    try:
        placed, rest = S.bid(spark.createDataFrame(new, "uid string, embedding array<double>").repartition(3),
                             spark.createDataFrame(cells, "cluster_id long, size long, centre array<double>"), 20)
        got = {r.uid: r.cluster_id for r in placed.collect()}
        assert {r.uid for r in rest.collect()} == set(left)
        print("rounds", rounds, "jobs", len(spark.sparkContext.statusTracker().getJobIdsForGroup("bids")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want


def test_texts_are_written_once_with_their_ids(spark, monkeypatch):
    cuts, cut = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: cuts.append(df.columns) or cut(df))
    path = shared_path(spark, "registry")
    ex = lambda *rows: spark.createDataFrame(list(rows), "task_id string, ordinal long, text_to_annotate string").repartition(3)
    first, added = J.identify(ex(("t", 1, " a "), ("t", 0, "a"), ("t", 2, "b"), ("t", 3, None), ("t", 4, "  ")), "t", None, path)
    assert sum("text_to_annotate" in c for c in cuts) == 1
    ids = {r.text_to_annotate: r.uid for r in first.collect()}
    assert set(ids) == {"a", "b"} and {(r.text_to_annotate, r.uid) for r in added.collect()} == set(ids.items())
    known = spark.createDataFrame([("t", J.registry_of(spark, path, "t").rows().where("text_to_annotate = 'a'").first().text_key, "a", "0-own")],
                                  "task_id string, text_key string, text_to_annotate string, uid string")
    again, added = J.identify(ex(("t", 7, "c"), ("t", 8, "b"), ("t", 9, "a")), "t", known, path)
    got = {r.text_to_annotate: (r.uid, r.is_new, r.ordinal) for r in again.collect()}
    assert got["b"] == (ids["b"], False, 8) and got["a"] == (min(ids["a"], "0-own"), False, 9) and got["c"][1:] == (True, 7)
    assert [r.text_to_annotate for r in added.collect()] == ["c"]
    assert {r.uid for r in J.registry_of(spark, path, "t").rows().collect()} == {*ids.values(), got["c"][0]}
