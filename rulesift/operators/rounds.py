"""Comparing annotation rounds: matching, transitions and confidence shifts.

Matching by uid-else-text is written as two equi-joins plus ``coalesce``;
an ``OR`` join condition would plan a nested-loop join. The text side is first
reduced to one row per text (by a partial aggregate, so a text repeated in a
third of all rows is combined map-side), which keeps joins from multiplying
rows. Text keys are SHA-256 digests so shuffles do not carry the texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulesift.functions.text import text_key
from rulesift.operators.ranking import global_row_number

MATCH_UID, MATCH_TEXT, MATCH_NONE = "uid", "text", "none"


def valid_confidence(c: str | Column = "confidence") -> Column:
    """Confidence if it is a finite number in 0..100, else null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (x >= 0) & (x <= 100), x)


# --- J4 -------------------------------------------------------------------------

def pair_rounds(before: DataFrame, after: DataFrame, key: str = "uid",
                cols: tuple[str, ...] = ("new_edge_case", "confidence", "annotation")) -> DataFrame:
    """Inner join on ``key`` with ``_original`` / ``_reannotated`` suffixes."""
    b = before.where(F.col(key).isNotNull()).select(
        key, *[F.col(c).alias(f"{c}_original") for c in cols])
    a = after.where(F.col(key).isNotNull()).select(
        key, *[F.col(c).alias(f"{c}_reannotated") for c in cols])
    return b.join(a, key, "inner")


def edge_transitions(paired: DataFrame) -> DataFrame:
    """A4: row counts per (edge before, edge after)."""
    return paired.groupBy(
        F.col("new_edge_case_original").alias("edge_before"),
        F.col("new_edge_case_reannotated").alias("edge_after"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def paired_confidence_change(paired: DataFrame) -> DataFrame:
    """A5: mean paired change, overall (null key) and by previous edge flag."""
    before = F.col("new_edge_case_original")
    after = F.col("new_edge_case_reannotated")
    diff = F.col("confidence_reannotated") - F.col("confidence_original")
    return paired.rollup(before.alias("edge_before")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(diff), 6).alias("mean_change"),
        F.count_if(before & ~after).alias("resolved"),
        F.count_if(~before & after).alias("new_edges"),
    )


def round_counts(before: DataFrame, after: DataFrame, key: str = "uid", order: str | None = None) -> DataFrame:
    """Row counts of both rounds and whether they hold the same ids, each as often.

    One tagged union, one partial aggregate per id, one global aggregate. With ``order``, a column of positions,
    ``same_order`` says whether the same ids stand at the same distances from the first row; see ``order_digest``.
    """
    tagged = (before.select(F.col(key).alias("k"), F.lit(1).alias("_b"), F.lit(0).alias("_a"))
              .unionByName(after.select(F.col(key).alias("k"), F.lit(0).alias("_b"), F.lit(1).alias("_a"))))
    per_id = tagged.groupBy("k").agg(F.sum("_b").alias("nb"), F.sum("_a").alias("na"))
    known = F.col("k").isNotNull()
    out = per_id.agg(
        F.sum("nb").cast("bigint").alias("rows_before"),
        F.sum("na").cast("bigint").alias("rows_after"),
        F.coalesce(F.sum(F.when(~known, F.col("nb"))), F.lit(0)).cast("bigint").alias("null_ids_before"),
        F.coalesce(F.sum(F.when(~known, F.col("na"))), F.lit(0)).cast("bigint").alias("null_ids_after"),
        F.count_if(known & (F.col("nb") > 0) & (F.col("na") == 0)).alias("ids_only_before"),
        F.count_if(known & (F.col("na") > 0) & (F.col("nb") == 0)).alias("ids_only_after"),
        F.count_if(known & (F.col("na") != F.col("nb"))).alias("_uneven"),
    )
    same = ((F.col("rows_before") == F.col("rows_after")) & (F.col("ids_only_before") == 0)
            & (F.col("ids_only_after") == 0) & (F.col("null_ids_before") == 0)
            & (F.col("null_ids_after") == 0) & (F.col("_uneven") == 0))
    out = out.withColumn("same_ids", same).drop("_uneven")
    if order is None:
        return out
    b, a = (order_digest(x, key, order).first() for x in (before, after))  # one row each
    return out.withColumn("same_order", F.col("same_ids") & F.lit(tuple(b) == tuple(a)))


def order_digest(df: DataFrame, key: str = "uid", order: str = "ordinal") -> DataFrame:
    """One row (rows, digest): equal for two tables that have the same keys at the same positions, counted from the least one.

    Each (key, position) pair is hashed and the hashes are summed modulo two numbers, so that partial sums of any partitions merge and
    nothing is sorted. Rows without a key or position count as null at it.
    """
    least = df.agg(F.min(order)).first()[0]  # one number
    place = F.col(order) - F.lit(least) if least is not None else F.lit(None).cast("long")
    h = F.xxhash64(F.lit(1), F.col(key), place), F.xxhash64(F.lit(2), F.col(key), place)
    sums = [F.sum(F.pmod(x, F.lit(p))) % p for x, p in zip(h, (2147483629, 2147483587))]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *(x.cast("string") for x in sums)).alias("digest"))


# --- J5 / J6 --------------------------------------------------------------------

def one_per_text(df: DataFrame, keep: tuple[str, ...], text: str = "text_to_annotate",
                 uid: str = "uid") -> DataFrame:
    """One row per text: the lowest non-null uid wins (ledger L15).

    A partial ``min(struct)`` aggregate, so hot texts combine map-side.
    """
    pick = F.min(F.struct(F.col(uid).isNull().alias("_nu"), F.col(uid).alias("_uid"),
                          *[F.col(c).alias(c) for c in keep]))
    return (df.where(F.col(text).isNotNull())
            .groupBy(text_key(text).alias("_tk")).agg(pick.alias("_p"))
            .select("_tk", F.col("_p._uid").alias(uid), *[F.col(f"_p.{c}").alias(c) for c in keep]))


def one_per_uid(df: DataFrame, keep: tuple[str, ...], uid: str = "uid") -> DataFrame:
    pick = F.min(F.struct(*[F.col(c).alias(c) for c in keep]))
    return (df.where(F.col(uid).isNotNull()).groupBy(uid).agg(pick.alias("_p"))
            .select(uid, *[F.col(f"_p.{c}").alias(c) for c in keep]))


def spread_uid(uid: str = "uid", text_digest: str = "_tk") -> Column:
    """A join key for uids: rows without one get keys of their own texts, which match no uid.

    All null keys hash to one partition; an import without ids would send every row there.
    """
    return F.coalesce(F.col(uid), F.concat(F.lit("\u0000"), F.col(text_digest)))


def match_rounds(current: DataFrame, previous: DataFrame,
                 keep: tuple[str, ...] = ("confidence", "new_edge_case", "annotation"),
                 text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """Attach each current row's previous-round row, by uid else by text.

    Adds ``match_way`` (uid / text / none), ``prev_uid`` and ``prev_<c>`` for
    every ``c`` in ``keep``.
    """
    by_uid = one_per_uid(previous, keep, uid).select(
        F.col(uid).alias("_u_uid"), *[F.col(c).alias(f"_u_{c}") for c in keep])
    by_text = one_per_text(previous, keep, text, uid).select(
        "_tk", F.lit(True).alias("_t_hit"), F.col(uid).alias("_t_uid"),
        *[F.col(c).alias(f"_t_{c}") for c in keep])
    cur = current.withColumn("_tk", text_key(text)).withColumn("_uk", spread_uid(uid))
    j = (cur.join(by_uid, F.col("_uk") == F.col("_u_uid"), "left")
         .join(by_text, "_tk", "left"))
    hit_uid = F.col("_u_uid").isNotNull()
    hit_text = F.col("_t_hit").isNotNull()
    way = F.when(hit_uid, F.lit(MATCH_UID)).when(hit_text, F.lit(MATCH_TEXT)).otherwise(F.lit(MATCH_NONE))
    prev = [F.when(hit_uid, F.col(f"_u_{c}")).otherwise(F.col(f"_t_{c}")).alias(f"prev_{c}") for c in keep]
    out_cols = [c for c in current.columns]
    return j.select(*out_cols, way.alias("match_way"),
                    F.when(hit_uid, F.col("_u_uid")).otherwise(F.col("_t_uid")).alias("prev_uid"),
                    *prev)


def match_summary(matched: DataFrame) -> DataFrame:
    """Rows and mean(current) - mean(previous) per way of matching."""
    return matched.groupBy("match_way").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(valid_confidence("confidence")) - F.avg(valid_confidence("prev_confidence")), 6)
        .alias("mean_shift"),
    )


def membership(points: DataFrame, annotations: DataFrame, edge_cases: DataFrame,
               text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """Is each point in the annotations / in the edge cases (uid or text)?

    Two semi-joins per target (uid, text) instead of an ``OR`` join; the
    target sides are reduced to distinct keys first.
    """
    def flag(target: DataFrame, name: str) -> DataFrame:
        uids = target.where(F.col(uid).isNotNull()).select(F.col(uid).alias("_k")).distinct()
        texts = target.where(F.col(text).isNotNull()).select(text_key(text).alias("_k")).distinct()
        return uids, texts, name

    out = points.withColumn("_tk", text_key(text)).withColumn("_uk", spread_uid(uid))
    for target, name in ((annotations, "in_annotations"), (edge_cases, "in_edge_cases")):
        uids, texts, _ = flag(target, name)
        u = uids.withColumn("_hu", F.lit(True))
        t = texts.withColumn("_ht", F.lit(True))
        out = (out.join(u, out["_uk"] == u["_k"], "left").drop("_k")
               .join(t, out["_tk"] == t["_k"], "left").drop("_k")
               .withColumn(name, F.coalesce(F.col("_hu"), F.col("_ht"), F.lit(False)))
               .drop("_hu", "_ht"))
    return out.drop("_tk", "_uk")


def point_links(points: DataFrame, target: DataFrame, text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """J6 as a link table (uid, target_uid, way): which row of the other plot a point stands for; read either way, since no row
    of either side is in two links.

    Rows with the same uid are linked (the k-th with the k-th, if ids repeat). Of the rows whose uid the other side has not, the k-th
    copy of a text, in the order of uids (rows without one last), meets the k-th copy there. Copies are numbered by a
    distributed rank, so a text that holds a third of all rows is in no single task, and copies never multiply.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(uid).alias("u"), text_key(text).alias("_tk"))

    def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
        ranked = global_row_number(df.withColumn("_nu", F.col("u").isNull()), [*keys, "_nu", "u", "_tk"], "_rn")
        start = ranked.groupBy(*keys).agg(F.min("_rn").alias("_start"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        start = start.withColumnsRenamed({k: f"_{k}" for k in keys})
        joined = ranked.join(start, functools.reduce(lambda x, y: x & y, on))
        return joined.select("u", "_tk", (F.col("_rn") - F.col("_start")).alias("k"))

    p, t = side(points), side(target)
    by_uid = (numbered(p.where("u is not null"), ["u"]).select("u", "k")
              .join(numbered(t.where("u is not null"), ["u"]).select(F.col("u").alias("v"), F.col("k").alias("m")), (F.col("u") == F.col("v")) & (F.col("k") == F.col("m")))
              .select(F.col("u").alias("uid"), F.col("v").alias("target_uid"), F.lit(MATCH_UID).alias("way")))

    def rest(mine: DataFrame, other: DataFrame) -> DataFrame:
        known = other.where("u is not null").select(F.col("u").alias("_o")).distinct()
        return mine.withColumn("_uk", spread_uid("u")).join(known, F.col("_uk") == F.col("_o"), "left_anti").where("_tk is not null").select("u", "_tk")

    a = numbered(rest(p, t), ["_tk"])
    b = numbered(rest(t, p), ["_tk"]).select(F.col("u").alias("v"), F.col("_tk").alias("_tl"), F.col("k").alias("m"))
    by_text = (a.join(b, (F.col("_tk") == F.col("_tl")) & (F.col("k") == F.col("m")))
               .select(F.col("u").alias("uid"), F.col("v").alias("target_uid"), F.lit(MATCH_TEXT).alias("way")))
    return by_uid.unionByName(by_text)


# --- A1 / A2 / A3 / A14 -----------------------------------------------------------

def _ui_confidence(c: str = "confidence") -> Column:
    """A1's reading of a confidence: not a finite number -> 0 (null reads as 0)."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def round_statistics(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A1 + A3 + A14: one row of panel statistics for a round.

    Mean confidence of edge / other rows after the panel's reading (not a
    number -> 0, only 0..100 counted, empty -> 0), the edge count and its
    difference from the previous round, and whether any row was re-labelled.
    Both rounds go through one tagged union and one aggregate.
    """
    def side(df: DataFrame, is_cur: bool) -> DataFrame:
        reann = (F.coalesce(F.col("is_reannotated"), F.lit(False))
                 if "is_reannotated" in df.columns else F.lit(False))
        return df.select(F.lit(is_cur).alias("_cur"), _ui_confidence().alias("_c"),
                         F.coalesce(F.col("new_edge_case"), F.lit(False)).alias("_e"),
                         reann.alias("_r"))

    both = side(current, True)
    if previous is not None:
        both = both.unionByName(side(previous, False))
    cur, edge, conf = F.col("_cur"), F.col("_e"), F.col("_c")
    ok = cur & (conf >= 0) & (conf <= 100)
    prev_edges = F.count_if(~cur & edge) if previous is not None else F.lit(None).cast("bigint")
    return both.agg(
        F.count_if(cur).alias("total_rows"),
        F.count_if(cur & edge).alias("edge_rows"),
        F.round(F.coalesce(F.avg(F.when(ok & edge, conf)), F.lit(0.0)), 6).alias("edge_mean_confidence"),
        F.round(F.coalesce(F.avg(F.when(ok & ~edge, conf)), F.lit(0.0)), 6).alias("other_mean_confidence"),
        F.coalesce(F.bool_or(cur & F.col("_r")), F.lit(False)).alias("any_reannotated"),
        (F.count_if(cur & edge) - prev_edges).alias("edge_rows_change"),
    )


def confidence_shift_by_class(current: DataFrame, previous: DataFrame,
                              text: str = "text_to_annotate", uid: str = "uid") -> DataFrame:
    """A2: per previous class (edge / other), mean of the matched current rows
    minus mean of *all* previous rows of that class. Not-a-number or out of
    range confidences are dropped; null when either side is empty.

    Matching goes from each previous row to the current round by uid, else text
    (current side reduced to one row per uid and per text).
    """
    keep = ("confidence",)
    cur_uid = one_per_uid(current, keep, uid).select(F.col(uid).alias("_cu"), F.col("confidence").alias("_cuc"))
    cur_txt = one_per_text(current, keep, text, uid).select("_tk", F.col("confidence").alias("_ctc"),
                                                            F.lit(True).alias("_ct"))
    prev = previous.select(uid, F.coalesce(F.col("new_edge_case"), F.lit(False)).alias("prev_edge"),
                           "confidence", text_key(text).alias("_tk")).withColumn("_uk", spread_uid(uid))
    j = (prev.join(cur_uid, F.col("_uk") == F.col("_cu"), "left")
         .join(cur_txt, "_tk", "left"))
    matched = F.col("_cu").isNotNull() | F.col("_ct").isNotNull()
    cur_conf = F.when(F.col("_cu").isNotNull(), F.col("_cuc")).otherwise(F.col("_ctc"))
    g = j.groupBy("prev_edge").agg(
        F.count(F.lit(1)).alias("prev_rows"),
        F.count_if(matched).alias("matched_rows"),
        F.avg(valid_confidence("confidence")).alias("_pm"),
        F.avg(F.when(matched, valid_confidence(cur_conf))).alias("_cm"),
    )
    return g.select("prev_edge", "prev_rows", "matched_rows",
                    F.round(F.col("_cm") - F.col("_pm"), 6).alias("confidence_shift"))


# --- W5 ---------------------------------------------------------------------------

def confidence_lag(hist: DataFrame, uid: str = "uid", order: str = "round") -> DataFrame:
    """Each row's confidence change against the same uid's previous round.

    Windows are partitioned by uid (a handful of rounds each). Rows without a
    uid cannot be tracked and get a null change; they stay out of the window so
    a large id-less import never lands in one task.
    """
    w = Window.partitionBy(uid).orderBy(order)
    tracked = hist.where(F.col(uid).isNotNull()).select(
        "*", F.lag("confidence").over(w).alias("prev_confidence"))
    untracked = hist.where(F.col(uid).isNull()).select("*", F.lit(None).cast("double").alias("prev_confidence"))
    both = tracked.unionByName(untracked)
    return both.withColumn("confidence_change", F.round(F.col("confidence") - F.col("prev_confidence"), 6))
