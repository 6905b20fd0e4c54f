"""Plug-in calls, rule jobs and parsing cases that the verdict measured."""

import pytest
from pyspark.sql import functions as F

from rulesift.functions.parse import parse_annotations, parse_categories
from rulesift.operators import cache as C
from rulesift.operators import generalise as G
from rulesift.operators.registry import upsert_relabelled
from rulesift.operators.rounds import round_counts
from rulesift.plans import jobs as J
from rulesift.session import shared_path


def test_calls_use_the_tasks_asked_for_and_failures_stay_alone(spark):
    from pyspark import TaskContext

    def annotator(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [{"response": f"{TaskContext.get().partitionId()}|{p}"} for p in prompts]

    req = spark.range(600).select(F.concat(F.lit("text "), F.when(F.col("id") == 7, "bad").otherwise(F.col("id").cast("string"))).alias("item"))
    path = shared_path(spark, "calls")
    got = C.respond_with_cache(req, path, "m", annotator, prompt="item", context="c", render=lambda t: "<" + t + ">", tasks=16).collect()
    assert len({r.response.split("|")[0] for r in got if r.response}) == 16
    assert [r.item for r in got if r.error] == ["text bad"]
    assert all(r.response.endswith(f"|<{r.item}>") for r in got if not r.error)
    again = C.respond_with_cache(req, path, "m", annotator, prompt="item", context="c", render=lambda t: t)
    assert again.where("not cache_hit").count() == 1  # only the failed one is asked again
    other = C.respond_with_cache(req, path, "m", annotator, prompt="item", context="another", render=lambda t: t)
    assert other.where("cache_hit").count() == 0


def _proposed(spark, n):
    return spark.range(n).select(
        F.format_string("u%03d", "id").alias("uid"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text_to_annotate"),
        F.lit(None).cast("string").alias("raw_annotations"), F.lit("a").alias("analyses"), F.lit("0").alias("annotation"),
        F.lit(50.0).alias("confidence"), F.lit(True).alias("new_edge_case"),
        F.concat(F.lit("When topic "), F.col("id").cast("string"), F.lit(" comes up -> label 1")).alias("guideline_improvement"))


def _plugins(embedder=None, synthesizer=None):
    p = J.offline_plugins()
    p.embedder, p.synthesizer = embedder or p.embedder, synthesizer or p.synthesizer
    return p


def test_synthesizer_is_asked_once_and_sees_the_guideline(spark, tmp_path):
    counter = tmp_path / "calls"

    def varying(prompt):
        import re
        import uuid
        with open(counter, "a") as f:
            f.write("x")
        assert "GUIDE" in prompt
        numbers = re.findall(r"^(\d+)\. ", prompt.split("<rules>")[1], re.M)
        return f'{{"categories": [{{"category_description": "{uuid.uuid4()} -> x", "edge_cases": [{", ".join(numbers)}]}}]}}'

    sugg, edge = J.discover_edge_cases(_proposed(spark, 60), "t", 0, shared_path(spark, "w"), _plugins(synthesizer=varying), guideline="GUIDE")
    assert edge.where("edge_case_id is not null").count() == edge.count() == 60
    assert len(counter.read_text()) == 60 // 15 + 1 == sugg.count()


@pytest.mark.parametrize("n", [0, 1, 2, 15, 20, 21])
def test_one_schema_for_any_number_of_rules(spark, n):
    sugg, edge = J.discover_edge_cases(_proposed(spark, n), "t", 0, shared_path(spark, "w"), _plugins())
    assert edge.columns == ["uid", *[c for c in J.RU.OUTPUT_FIELDS if c != "uid"], "low_level_rule", "embed_error"]
    rows = edge.collect()
    assert len(rows) == n and all(r.edge_case_id is not None and r.pca_x is not None for r in rows)
    if n == 1:
        assert (rows[0].edge_case_id, rows[0].pca_x, rows[0].guideline_improvement) == (0, 0.0, rows[0].low_level_rule)
    assert (sugg.count() > 0) == (n > 0)


def test_rules_without_an_embedding_keep_their_row(spark):
    def flaky(texts):
        if any("topic 1" in t for t in texts):
            raise RuntimeError("no vector")
        return C.hashing_embedder(64)(texts)

    _, edge = J.discover_edge_cases(_proposed(spark, 30), "t", 0, shared_path(spark, "w"), _plugins(embedder=flaky))
    rows = edge.collect()
    failed = [r for r in rows if r.embed_error]
    assert len(rows) == 30 and len(failed) == 11
    assert all(r.edge_case_id is None and r.low_level_rule for r in failed)


def test_long_chains_are_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rules = [(i + 1, " ".join(words[i:i + 20])) for i in range(120)] + [(200, "one two three"), (201, "")]
    got = {r.rule_no: r.component for r in G.merge_similar(spark.createDataFrame(rules, "rule_no long, rule string")).collect()}
    assert len(got) == 122 and {got[i] for i in range(1, 121)} == {1} and got[200] == 200 and got[201] == 201


def test_failed_calls_have_no_label(spark):
    def annotator(prompts):
        if any("text 3" in p for p in prompts):
            raise RuntimeError("no")
        return C.offline_annotator()(prompts)

    p = J.offline_plugins()
    p.annotator = annotator
    ex = spark.range(15).select(F.lit("t").alias("task_id"), F.col("id").alias("ordinal"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text_to_annotate"))
    g = spark.createDataFrame([("t", "Decide.\n\nLabels:\n- 0\n- 1")], "task_id string, guideline string")
    rows = {r.text_to_annotate: r for r in J.annotate_round(ex, g, "t", 0, shared_path(spark, "w"), p).collect()}
    assert [t for t, r in rows.items() if r.error] == ["text 3"]
    assert rows["text 3"].annotation is None and rows["text 3"].confidence is None and rows["text 3"].new_edge_case is None
    assert all(r.annotation in ("0", "1") for t, r in rows.items() if t != "text 3")


def test_upsert_replaces_one_row(spark):
    old = spark.createDataFrame([("u1", "same", 1.0), ("u2", "same", 2.0), ("u3", "other", 3.0)], "uid string, text_to_annotate string, confidence double")
    new = spark.createDataFrame([("n9", "same", 9.0)], old.schema)
    assert sorted(r.uid for r in upsert_relabelled(old, new).collect()) == ["n9", "u2", "u3"]


def test_same_ids_count_repeats(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "uid string")
    for a, b, same in (("aab", "abb", False), ("aab", "aba", True), ("ab", "ac", False)):
        assert round_counts(frame(a), frame(b)).first()["same_ids"] is same


def test_numbers_and_null_lists(spark):
    body = ['{"analysis": "", "annotation": 1.7, "confidence": 80, "new_edge_case": false, "new_edge_case_rule": "EMPTY"}',
            '{"analysis": "", "annotation": "1.7", "confidence": 80, "new_edge_case": false, "new_edge_case_rule": "EMPTY"}']
    df = spark.createDataFrame([(i, b, ["x", "y"]) for i, b in enumerate(body)], "k int, raw_annotations string, labels array<string>")
    assert [r.annotation for r in parse_annotations(df).orderBy("k").collect()] == ["y", "-1"]
    text = '{"categories": [{"category_description": "a", "edge_cases": null}, {"category_description": "b", "edge_cases": [1, 2]}]}'
    got = parse_categories(spark.createDataFrame([(1, text)], "k int, response string"), "k").collect()
    assert sorted((r.category_description, r.edge_case) for r in got) == [("b", 1), ("b", 2)]


def test_csv_columns_in_another_order_are_an_error(spark, tmp_path):
    from rulesift.sources.ingest import read_texts_csv
    (tmp_path / "a.csv").write_text("text_to_annotate,n\nhello,1\n")
    (tmp_path / "b.csv").write_text("n,text_to_annotate\n3,world\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_texts_csv(spark, str(tmp_path), "t").collect()


def test_sorts_in_both_directions_and_alphabetical_pages(spark):
    from rulesift.operators import explore as X
    rows = [("a", "beta", 10.0, True), ("b", "Alpha", 90.0, False), ("c", "gamma", 50.0, True), ("d", None, None, False)]
    df = spark.createDataFrame(rows, "uid string, text_to_annotate string, confidence double, is_reannotated boolean")
    ids = lambda option, up: "".join(r.uid for r in X.sort_rows(df, option, ascending=up).collect())
    assert (ids("confidence", True), ids("confidence", False)) == ("dacb", "bcad")
    assert (ids("new", True), ids("new", False)) == ("cabd", "acdb")  # new rows first either way
    assert (ids("alphabetical", True), ids("alphabetical", False)) == ("dbac", "cabd")
    change = df.withColumn("confidence_change", F.col("confidence") - 40)
    ids = lambda option, up: "".join(r.uid for r in X.sort_rows(change, option, ascending=up).collect())
    assert (ids("confidence_increase", True), ids("confidence_increase", False)) == ("cbad", "bcda")
    assert (ids("confidence_decrease", True), ids("confidence_decrease", False)) == ("abcd", "adcb")
    page = X.page(df, "alphabetical", pinned_uid="a").orderBy("page_rank").collect()
    assert [r.uid for r in page] == ["d", "b", "a", "c"]


def test_rows_without_ids_are_spread(spark):
    """Their join keys differ, so no partition gets all of them, and they match by text only."""
    from rulesift.functions.text import text_key
    from rulesift.operators.rounds import match_rounds, spread_uid
    cur = spark.range(200).select(F.lit(None).cast("string").alias("uid"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text_to_annotate"),
                                  F.lit(1.0).alias("confidence"), F.lit(False).alias("new_edge_case"), F.lit("0").alias("annotation"))
    assert cur.withColumn("_tk", text_key("text_to_annotate")).select(spread_uid()).distinct().count() == 200
    prev = cur.withColumn("uid", F.concat(F.lit("u"), F.col("text_to_annotate"))).limit(50)
    assert match_rounds(cur, prev).where("match_way = 'text'").count() == 50


def test_snapshots_of_one_second_are_kept(spark, tmp_path):
    from rulesift.sources.sinks import write_snapshot
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "uid int, x double")
    a, b = write_snapshot(df, str(tmp_path)), write_snapshot(df.where("uid = 2"), str(tmp_path))
    assert a != b
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(a).collect()) == [(1, None), (2, 0.5)]
    assert spark.read.schema(df.schema).json(b).count() == 1


def test_csv_files_stay_small(spark, monkeypatch, tmp_path):
    """a file with line breaks inside quotes is read by one task, so there are as many as the texts need."""
    from rulesift.plans import ingest_queries as Q
    monkeypatch.setattr(Q, "CSV_FILE_BYTES", 20_000, raising=False)
    rows = [(i, f"src{i % 3}", f'line {i}\n"quoted" ' + "x" * 900) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.csv_ingest(spark, str(tmp_path))
    assert len(out.inputFiles()) >= 9
    assert sorted((r["ordinal"], r["text_to_annotate"]) for r in out.collect()) == [(i, t) for i, _, t in rows]


def test_versions_are_asked_without_moving_the_texts(spark):
    """the answers come with the columns asked for; the same prompts are asked."""
    from rulesift.operators import cache as C
    from rulesift.operators import templates as TP
    from rulesift.session import shared_path
    rows = spark.createDataFrame([("a", i, f"text {i % 7}") for i in range(20)], "task_id string, doc_id long, text_to_annotate string")
    versions = spark.createDataFrame([(1, "a", "Q {text}", "g", "")], "version int, task_id string, template string, guideline string, rules string")
    whole = TP.ask_version(rows, versions, 1, shared_path(spark, "t_ask"), "m", C.offline_annotator())
    less = TP.ask_version(rows, versions, 1, shared_path(spark, "t_ask"), "m", C.offline_annotator(), keep=["doc_id"])
    assert set(whole.columns) - set(less.columns) == {"task_id", "text_to_annotate"}
    assert sorted(map(tuple, less.collect())) == sorted(map(tuple, whole.select(less.columns).collect())) and less.count() == 20


def test_embeddings_come_without_the_texts(spark):
    """only the columns asked for move with the embeddings, and these are the sums over the words."""
    import zlib
    import numpy as np
    from rulesift.operators import cache as C
    from rulesift.session import shared_path
    texts = ["One two two", "", "three", None, "One two two"]
    df = spark.createDataFrame(list(enumerate(texts)), "uid int, text string")
    got = {r["uid"]: r["embedding"] for r in C.embed_with_cache(df, shared_path(spark, "t_emb"), "m", C.hashing_embedder(8), keep=["uid"]).select("uid", "embedding").collect()}
    for i, t in enumerate(texts):
        want = np.zeros(8)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            want[h % 8] += 1.0 if (h >> 16) & 1 else -1.0
        if t is not None:
            assert got[i] == (want / (np.linalg.norm(want) or 1.0)).astype(np.float32).tolist()
    assert set(got) == set(range(5))


def test_controls_are_stripped_with_and_without_any(spark):
    from rulesift.functions.text import strip_controls
    rows = [("plain\ttext\r\n",), ("a\x00b\x08c\x0bd\x0ce\x0ef\x1fg",), ("",), (None,), ("é\x7f\x01",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(strip_controls("t")).collect()]
    assert got == ["plain\ttext\r\n", "abcdefg", "", None, "é\x7f"]
