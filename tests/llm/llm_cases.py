import pytest

LONG = "aa bb cc dd ee ff gg hh " * 4000

#: Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names.
EDGE = [
    (None, "one two three four five six seven eight nine ten eleven twelve", "k", 1),
    (None, None, None, None),
    (1, "", "k", 2),
    (2, None, "k", 3),
    (3, "Short text", "k", 4),
    (3, "Short text", "k", 4),
    (4, "short TEXT", "k", 5),
    (5, "one two three four five six seven eight nine ten eleven twelve", "k", 6),
    (6, LONG, "k", 7),
    (7, LONG + "tail", "k", 8),
    (8, "  \t\n ", "k", 9),
    (9, "日本語 テキスト ▁▁ x y é" * 20, "k", 10),
    (10, "Ünïcode \x00 zero <s> </s> <unk> <0x41>", "k", 11),
]


@pytest.fixture(scope="session")
def edge(spark):
    """doc_id, text and columns named like the operators' own (shard, payload, score)."""
    return spark.createDataFrame([(i, t, c, n, float(n or 0), "row") for i, t, c, n in EDGE],
                                 "doc_id long, text string, shard string, tie long, score double, spans string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
