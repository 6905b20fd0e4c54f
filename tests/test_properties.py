"""Property tests: the JVM expressions against plain-Python statements of the
same rules, on generated strings (one Spark job per property)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ALPHABET = st.sampled_from(list("ab Z9-> \t\n.:_") + ["->", "EMPTY", "empty", "edge_case_", "12", "\x01"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=60)
WS = " \t\n\x0b\x0c\r"


def _run(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_rule_condition_and_empty(spark, texts):
    from rulesift.functions.text import is_empty_rule, rule_condition
    cond = _run(spark, texts, rule_condition)
    empty = _run(spark, texts, is_empty_rule)
    for t, c, e in zip(texts, cond, empty):
        assert c == t.split("->")[0].strip(WS)
        assert e == (t.strip(WS).upper() == "EMPTY")


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_rule_key_number(spark, texts):
    from rulesift.functions.text import rule_key_number
    got = _run(spark, texts, rule_key_number)
    for t, g in zip(texts, got):
        m = re.search(r"edge_case_(\d+)", t) or re.search(r"\d+", t)
        want = None
        if m:
            digits = m.group(1) if m.re.pattern.startswith("edge") else m.group(0)
            want = int(digits) if int(digits) < 2 ** 31 else None
        assert g == want, t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(str), st.sampled_from(["1.0", "0.0", "2.5", "one", "", " 1", "-0"])),
                min_size=1, max_size=40))
def test_label_text(spark, raws):
    from rulesift.functions.parse import label_text
    labels = ["a", "b", "c"]
    got = _run(spark, raws, lambda c: label_text(c, F.array(*[F.lit(x) for x in labels])))
    for r, g in zip(raws, got):
        try:
            v = float(r)
            idx = int(v) if v == int(v) else None
        except ValueError:
            idx = None
        want = labels[idx] if idx is not None and 0 <= idx < len(labels) else "-1"
        assert g == want, r


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_clean_text(spark, texts):
    from rulesift.functions.text import clean_text
    got = _run(spark, texts, clean_text)
    ctrl = {chr(i) for i in range(32)} - {"\t", "\n", "\r"}
    for t, g in zip(texts, got):
        assert g == "".join(ch for ch in t.strip(WS) if ch not in ctrl)
