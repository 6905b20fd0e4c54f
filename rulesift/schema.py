"""Declared schemas. Nothing in rulesift infers a schema from data."""

from pyspark.sql import types as T

EXAMPLES = T.StructType([
    T.StructField("task_id", T.StringType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("text_to_annotate", T.StringType(), True),
])

REGISTRY = T.StructType([
    T.StructField("task_id", T.StringType(), False),
    T.StructField("text_key", T.StringType(), False),
    T.StructField("text_to_annotate", T.StringType(), False),
    T.StructField("uid", T.StringType(), False),
])

ANNOTATIONS = T.StructType([
    T.StructField("task_id", T.StringType(), True),
    T.StructField("round", T.IntegerType(), True),
    T.StructField("uid", T.StringType(), True),
    T.StructField("text_to_annotate", T.StringType(), True),
    T.StructField("cluster", T.IntegerType(), True),
    T.StructField("pca_x", T.DoubleType(), True),
    T.StructField("pca_y", T.DoubleType(), True),
    T.StructField("raw_annotations", T.StringType(), True),
    T.StructField("analyses", T.StringType(), True),
    T.StructField("annotation", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("new_edge_case", T.BooleanType(), True),
    T.StructField("guideline_improvement", T.StringType(), True),
    T.StructField("is_reannotated", T.BooleanType(), True),
])

# Parsed model output: everything arrives as a string (numbers and booleans are
# written both quoted and bare by models), then is try_cast.
RESPONSE_JSON = T.StructType([
    T.StructField("analysis", T.StringType(), True),
    T.StructField("annotation", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("new_edge_case", T.StringType(), True),
    T.StructField("new_edge_case_rule", T.StringType(), True),
])

CATEGORIES_JSON = T.StructType([
    T.StructField("categories", T.ArrayType(T.StructType([
        T.StructField("category_description", T.StringType(), True),
        T.StructField("edge_cases", T.ArrayType(T.StringType()), True),
    ])), True),
])

RESPONSE_CACHE = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("prompt_key", T.StringType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("response_reasoning", T.StringType(), True),
    T.StructField("input_tokens", T.LongType(), True),
    T.StructField("output_tokens", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
])

EMBEDDING_CACHE = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("text_key", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("error", T.StringType(), True),
])

MODEL_PRICES = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("input_usd_per_mtok", T.DoubleType(), False),
    T.StructField("output_usd_per_mtok", T.DoubleType(), False),
])

RULES = T.StructType([
    T.StructField("task_id", T.StringType(), True),
    T.StructField("round", T.IntegerType(), True),
    T.StructField("rule_no", T.IntegerType(), True),
    T.StructField("rule", T.StringType(), True),
])

SAVED_RULES = T.StructType([
    T.StructField("task_id", T.StringType(), False),
    T.StructField("cluster_no", T.IntegerType(), False),
    T.StructField("rule", T.StringType(), False),
])
