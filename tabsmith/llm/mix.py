"""Mixing sources to target weights with hash-threshold histograms (built-in functions only).

Every row has a hash of its key and text. A source that needs c whole copies and a part of one more takes every row c
times and, once more, the rows whose hash lies below a threshold. The threshold comes from nested histograms: words by
(source, top hash bits), a running sum over at most 4096 buckets a source, then the same inside the one bucket
that holds the boundary, then over the few hash values left in there. Rows are filtered by threshold, never sorted,
and the choice depends on nothing but the rows, so reruns agree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share all words by weight; a target
stops at MOST times its source's words and the excess is shared again by weight.

Defined cases: null text has no words and its row is never taken; null source is a source of its own; rows that
agree in key and text have one hash and are taken together; the row at the threshold is taken when that brings the source
nearer to its target; an empty table, or one without words, takes nothing (all targets 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
HASH_BITS = 60
LEVELS = (12, 12, 36)  # bits of the hash that each histogram resolves


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of key and text."""
    row = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, h) of every row, stored so that the texts are read once."""
    return C.stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                size_of(text_col).alias("size"), hash_of(id_col, text_col).alias("h")), "mix-sizes")


def targets(sized: DataFrame) -> DataFrame:
    """A row per source: source, source_size, target, copies (whole copies of every row), budget (words beyond them).

    Sources are taken in order of MOST * size / weight. A source is held at its limit as long as an equal share by weight of
    what is left would exceed it; from the first that isn't, all get the same share a weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source from here on
    full = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("weight", 1 + (F.row_number().over(order) - 1) % 3).withColumn("total", full)
    rising = Window.orderBy((MOST * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = each.withColumn("cap", MOST * F.col("source_size")) \
        .withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("share", F.col("words_left") / F.col("weight_left")) \
        .withColumn("held", F.col("share") * F.col("weight") >= F.col("cap"))
    rate = F.first(F.when(~F.col("held"), F.col("share")), ignorenulls=True).over(whole)
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(rate * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return left.withColumn("target", target).withColumn("copies", copies).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def thresholds(sized: DataFrame) -> DataFrame:
    """targets() with ``below`` (rows with a smaller hash are taken once more; null: none) and ``edge`` (the hash ``below`` too)."""
    goal = C.stored(targets(sized), "mix-targets")
    bound = goal.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    shift = HASH_BITS
    for bits in LEVELS:
        # only rows that share the bits resolved so far with their source's boundary bucket (at first: all)
        rows = sized.alias("r").join(bound.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))
                                     & (F.shiftright(F.col("r.h"), shift) == F.col("b.prefix")))
        shift -= bits
        counts = rows.groupBy(F.col("r.source").alias("source"), F.shiftright(F.col("r.h"), shift).alias("bucket")) \
            .agg(F.sum("r.size").alias("words")).filter("words > 0")
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(running, F.lit(0)))
        hit = counts.alias("c").join(bound.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source"))) \
            .filter("c.before <= b.budget and b.budget < c.before + c.words")
        bound = C.stored(hit.select("b.source", (F.col("b.budget") - F.col("c.before")).alias("budget"),
                                    F.col("c.bucket").alias("prefix"), F.col("c.words").alias("words")), "mix-level")
    edge = bound.select(F.col("source").alias("s"), F.col("prefix").alias("below"), (2 * F.col("budget") > F.col("words")).alias("edge"))
    return C.stored(goal.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-thresholds")


def copies_of(size: Column, h: Column, prefix: str = "") -> Column:
    """How often a row is taken, given its source's columns of thresholds() (renamed with ``prefix``)."""
    below, edge, copies = (F.col(prefix + c) for c in ("below", "edge", "copies"))
    more = (h < below) | ((h == below) & edge)
    return F.when(size > 0, copies + F.coalesce(more, F.lit(False)).cast("long")).otherwise(0).cast("long")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id_col, size, source_size, target, taken."""
    sized = sizes(docs, id_col, text_col, source_col)
    goal = thresholds(sized)
    both = sized.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    return both.select(F.col("r.id").alias(id_col), "r.size", "g.source_size", "g.target",
                       (F.col("r.size") * copies_of(F.col("r.size"), F.col("r.h"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns kept."""
    own = "__mix_"  # keeps helper columns apart from those of ``docs``
    goal = thresholds(sizes(docs, id_col, text_col, source_col))
    goal = goal.toDF(*[own + c for c in goal.columns])
    rows = docs.withColumns({own + "size": size_of(text_col), own + "h": hash_of(id_col, text_col)}) \
        .join(goal, F.col(source_col).cast("string").eqNullSafe(F.col(own + "source")))
    times = copies_of(F.col(own + "size"), F.col(own + "h"), own).cast("int")
    return rows.withColumn(own + "copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same choice in DuckDB: sort where the operator uses thresholds.
ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
e AS (SELECT source, sum(size)::BIGINT AS source_size,
             1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM r GROUP BY source),
l AS (SELECT *, 3 * source_size AS cap,
             (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS share
      FROM e WINDOW p AS (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size,
             CASE WHEN share * weight >= cap THEN cap::DOUBLE
                  ELSE weight * (SELECT arg_min(share, cap::DOUBLE / weight) FROM l WHERE share * weight < cap) END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
v AS (SELECT source, h, sum(size) AS words FROM r GROUP BY ALL),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
x AS (SELECT c.source, c.h,
             c.before + c.words <= b.target - b.copies * b.source_size
             OR (c.before <= b.target - b.copies * b.source_size AND 2 * (b.target - b.copies * b.source_size - c.before) > c.words) AS more
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source)
SELECT r.doc_id, r.size, b.source_size, b.target, r.size * (b.copies + CASE WHEN x.more THEN 1 ELSE 0 END) AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source JOIN x ON r.source IS NOT DISTINCT FROM x.source AND r.h = x.h
"""
