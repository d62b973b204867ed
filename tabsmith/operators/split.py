"""Splits, folds, samples and resampling.

Row membership comes from an md5 hash of a key (or of the whole row), never
from partition layout, so results are reproducible, identical in DuckDB,
and need no shuffle. Stratified cuts are per-class order statistics of the
hash (bounded: classes x cut points), found without a per-class window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.exprs import c, hash8, hex_cut, numeric_cols
from ..functions.neighbours import nearest
from ..session import cut_lineage

CLASS_LIMIT = 1000  # stratification and class weights are for class targets (bounded level count)


def row_hash(df: DataFrame, key: Sequence[str] | str | None, seed: int = K.SEED, digits: int = 15) -> Column:
    """Integer from the first ``digits`` hex digits of md5(key:seed). Without a key the whole row
    is hashed, which also keeps identical rows on the same side."""
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    parts = [c(k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws(":", *parts, F.lit(str(seed)))), 1, digits)
    return F.conv(h, 16, 10).cast("long")


def _classes(df: DataFrame, t: str) -> dict:
    rows = df.groupBy(c(t).alias("v")).agg(F.count(F.lit(1)).alias("n")).limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{t!r} has more than {CLASS_LIMIT} classes; stratify on a class target")
    return {r["v"]: r["n"] for r in rows}


HASH_BITS = 60               # row_hash values are uniform on [0, 2^60)
CUT_LEVELS = (12, 12, 36)    # bits of the hash that each histogram resolves


def _class_cuts(df: DataFrame, t: str, h: str, ranks: dict, weight: Column | None = None) -> dict:
    """{(class, rank): (hash value at that 0-based rank within the class, rank among the rows that share it)}, exactly, by refining
    histograms.

    Rows are counted by (class, leading hash bits); a running sum over a class's 4,096 buckets finds the
    bucket that holds each wanted rank, and only the rows of those buckets are counted by further bits, until
    the value is known. Every level is one grouped count with map-side combine; the wanted cuts (classes x cut
    points, bounded by ``CLASS_LIMIT``) are the only thing that is joined or collected. With ``weight`` a row counts so often.
    """
    wanted = [(cls, int(r)) for cls, rs in ranks.items() for r in rs]
    if not wanted:
        return {}
    spark = df.sparkSession
    kind = df.schema[t].dataType
    schema = T.StructType([T.StructField("_c", kind), T.StructField("_rank", T.LongType()),
                           T.StructField("_left", T.LongType()), T.StructField("_prefix", T.LongType())])
    state = [(cls, r, r, 0) for cls, r in wanted]
    shift = HASH_BITS
    for bits in CUT_LEVELS:
        cuts = spark.createDataFrame(state, schema)
        inside = F.broadcast(cuts.select("_c", "_prefix").distinct())
        rows = df.select(c(t).alias("_c"), F.col(h).alias("_h"), F.shiftright(h, shift).alias("_prefix"),
                         (F.lit(1) if weight is None else weight).alias("_w")).join(inside, ["_c", "_prefix"], "left_semi")
        shift -= bits
        counts = rows.groupBy("_c", "_prefix", F.shiftright("_h", shift).alias("_next")).agg(F.sum("_w").alias("_n"))
        below = F.sum("_n").over(Window.partitionBy("_c", "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1))
        found = counts.withColumn("_below", F.coalesce(below, F.lit(0))).join(F.broadcast(cuts), ["_c", "_prefix"]) \
            .where((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_n")))
        state = [(r["_c"], r["_rank"], r["_left"] - r["_below"], r["_next"]) for r in
                 found.select("_c", "_rank", "_left", "_below", "_next").collect()]
    return {(cls, r): (value, left) for cls, r, left, value in state}


def _with_cuts(df: DataFrame, t: str, cuts: dict, kind: str, col: str = "_cut") -> DataFrame:
    """``df`` with each row's class's entry of ``cuts`` (null: none). The table has a row per class, so it is broadcast."""
    schema = T.StructType([T.StructField("_cls", df.schema[t].dataType), T.StructField(col, T.DataType.fromDDL(kind))])
    table = df.sparkSession.createDataFrame(list(cuts.items()), schema)
    return df.join(F.broadcast(table), c(t) == F.col("_cls"), "left").drop("_cls")


# ----------------------------------------------------------------------------- E1

def test_flag(df: DataFrame, t: str | None = None, test: float = 0.2, seed: int = K.SEED,
              stratify: bool = False, key: Sequence[str] | str | None = None) -> DataFrame:
    """Adds ``is_test``. Plain: md5 prefix below the ``test`` cut (same rows in DuckDB). Stratified:
    per class exactly floor(test * n_class) rows with the smallest hashes."""
    if not stratify or t is None:
        keys = [key] if isinstance(key, str) else list(key or df.columns)
        return df.withColumn("is_test", hash8(keys, seed) < F.lit(hex_cut(test)))
    out = df.withColumn("_h", row_hash(df, key, seed))
    counts = _classes(out, t)
    ranks = {cls: [int(math.floor(test * n))] for cls, n in counts.items() if cls is not None and int(test * n) > 0}
    got = _class_cuts(out, t, "_h", ranks)
    cuts = {cls: got[(cls, r[0])][0] for cls, r in ranks.items()}
    return _with_cuts(out, t, cuts, "long").withColumn("is_test", F.coalesce(F.col("_h") < F.col("_cut"), F.lit(False))).drop("_h", "_cut")


def train_test_split(df: DataFrame, t: str | None = None, test: float = 0.2, seed: int = K.SEED,
                     stratify: bool = True, key: Sequence[str] | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    flagged = test_flag(df, t, test, seed, stratify, key)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


# ----------------------------------------------------------------------------- E2, E3

def scout_size(n: int) -> int:
    """max(200, min(2000, 10 % of n)), never more than n."""
    return min(n, max(K.SCOUT_MIN, min(K.SCOUT_MAX, int(n * K.SCOUT_FRACTION))))


def allocate(size: int, counts: dict) -> dict:
    """Largest-remainder allocation of ``size`` over classes; ties by class order."""
    n = sum(counts.values())
    quota = {k: size * v / n for k, v in counts.items()}
    alloc = {k: int(math.floor(q)) for k, q in quota.items()}
    left = size - sum(alloc.values())
    order = sorted(counts, key=lambda k: (-(quota[k] - alloc[k]), k))
    for k in order[:left]:
        alloc[k] += 1
    return alloc


def stratified_sample(df: DataFrame, t: str, size: int, seed: int = K.SEED,
                      key: Sequence[str] | str | None = None) -> DataFrame:
    """Exactly ``size`` rows, per class by largest remainder, smallest hashes first."""
    out = df.where(c(t).isNotNull()).withColumn("_h", row_hash(df, key, seed))
    counts = _classes(out, t)
    alloc = allocate(size, counts)
    ranks = {cls: [a - 1] for cls, a in alloc.items() if a > 0}
    got = _class_cuts(out, t, "_h", ranks)
    cuts = {cls: got[(cls, r[0])][0] for cls, r in ranks.items()}
    return _with_cuts(out, t, cuts, "long").where(F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def scout_sample(df: DataFrame, t: str, problem_type: str = "classification", seed: int = K.SEED,
                 key: Sequence[str] | str | None = None) -> DataFrame:
    """Scout sample of max(200, min(2000, 10 % of n)) rows, stratified for class targets."""
    size = scout_size(df.count())
    if problem_type == "regression":
        return sample_n(df, size, seed, key)
    return stratified_sample(df, t, size, seed, key)


def sample_n(df: DataFrame, n: int, seed: int = K.SEED, key: Sequence[str] | str | None = None) -> DataFrame:
    """The n rows with the smallest md5(key:seed) — a top-n, not a full sort."""
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    order = F.md5(F.concat_ws(":", *[c(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_o", order).orderBy("_o").limit(n).drop("_o")


# ----------------------------------------------------------------------------- E4, E5

def add_fold(df: DataFrame, k: int = 5, t: str | None = None, seed: int = K.SEED,
             key: Sequence[str] | str | None = None, col: str = "fold") -> DataFrame:
    """Fold 0..k-1. Plain: k equal ranges of the md5 prefix. Stratified (``t``): per class,
    the hash order is cut at ranks floor(j * n_class / k), so every fold holds 1/k of each class."""
    if t is None:
        keys = [key] if isinstance(key, str) else list(key or df.columns)
        unit = F.conv(hash8(keys, seed), 16, 10).cast("double") / float(16 ** 8)
        return df.withColumn(col, F.floor(unit * k).cast("int"))
    out = df.withColumn("_h", row_hash(df, key, seed))
    counts = _classes(out, t)
    ranks = {cls: sorted({int(math.floor(j * n / k)) for j in range(1, k)} - {n}) for cls, n in counts.items()
             if cls is not None}
    got = _class_cuts(out, t, "_h", ranks)
    cuts = {cls: [got[(cls, r)][0] for r in rs] for cls, rs in ranks.items()}
    below = F.size(F.filter("_cut", lambda x: x <= F.col("_h")))
    return _with_cuts(out, t, cuts, "array<long>").withColumn(col, F.when(F.col("_cut").isNotNull(), below)).drop("_h", "_cut")


def safe_folds(n: int) -> int:
    """E5: min(5, max(2, n // 20))."""
    return min(5, max(2, n // 20))


# ----------------------------------------------------------------------------- E6

SPREAD = 10_000  # synthetic rows that one row makes in one place


def class_points(df: DataFrame, t: str, features: Sequence[str], classes: Sequence) -> DataFrame:
    """Distinct complete points of ``classes``: _k (number of the class), _id (md5 of the point), _x, _m (how many rows share it). Rows with
    a null, NaN or infinite feature are left out."""
    number = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(classes)], T.StructType(
        [T.StructField("_v", df.schema[t].dataType), T.StructField("_k", T.IntegerType())]))
    point = F.array(*[c(x).cast("double") + F.lit(0.0) for x in features])
    complete = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.join(F.broadcast(number), c(t) == F.col("_v")).select("_k", point.alias("_x")).where(complete)  # a row per class
    return rows.groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("_m")) \
        .withColumn("_id", F.md5(F.concat_ws(",", F.transform("_x", lambda v: v.cast("string")))))


def smote(train: DataFrame, t: str, features: Sequence[str] | None = None, k: int = 5, seed: int = K.SEED,
          classes: Sequence | None = None) -> DataFrame:
    """Synthetic rows until every class (or each of ``classes``) has as many rows as the largest one.

    Each synthetic row lies on the segment between a row of its class and one of that row's ``k`` nearest
    neighbours in the class, at a hash-derived position. Neighbours are exact (``functions.neighbours``): copies of the row come first, then
    the nearest other points, each as often as rows share it. Every row of a class makes the same number of rows, those first in the
    order of their points' hashes one more. Rows are told apart by their features alone, so the result doesn't depend on the table's
    files, partitions or settings. Rows with a null, NaN or infinite feature neither give nor receive neighbours, so no
    value is made up; a null class is left alone; a class with fewer than two complete rows stays as it is.
    Apply to training rows only.
    """
    features = list(features or numeric_cols(train, exclude=[t]))
    counts = {v: n for v, n in _classes(train, t).items() if v is not None}
    most = max(counts.values(), default=0)
    short = {v: most - n for v, n in sorted(counts.items()) if n < most and (classes is None or v in set(classes))}
    if not short:
        return train
    names = list(short)
    base = cut_lineage(class_points(train, t, features, names))
    have = {r["_k"]: r["n"] for r in base.groupBy("_k").agg(F.sum("_m").alias("n")).collect()}
    plan = {i: divmod(need, have[i]) for i, need in enumerate(short.values()) if have.get(i, 0) >= 2}
    if not plan:
        return train
    base = base.where(F.col("_k").isin(*plan)).withColumn("_h", F.conv(F.substring("_id", 1, HASH_BITS // 4), 16, 10).cast("long"))
    # every row makes ``per`` rows, the first ``extra`` of a class one more: those of points below a hash and some of the point at it
    cuts = _class_cuts(base, "_k", "_h", {i: [extra - 1] for i, (_, extra) in plan.items() if extra}, F.col("_m"))
    share = {i: (per, *((cuts[(i, extra - 1)][0], cuts[(i, extra - 1)][1] + 1) if extra else (-1, 0))) for i, (per, extra) in plan.items()}
    share = {i: {"per": per, "cut": cut, "at": at} for i, (per, cut, at) in share.items()}
    shared = _with_cuts(base, "_k", share, "struct<per:long,cut:long,at:long>")
    more = F.when(F.col("_h") < F.col("_cut.cut"), F.col("_m")).when(F.col("_h") == F.col("_cut.cut"), F.least("_m", "_cut.at")).otherwise(0)
    makes = shared.withColumn("_n", F.col("_m") * F.col("_cut.per") + more).drop("_cut").where("_n > 0")
    copies = F.array_repeat(F.col("_x"), F.least(F.col("_m") - 1, F.lit(k)).cast("int"))
    near = nearest(base, k)
    others = F.flatten(F.transform("_near", lambda s: F.array_repeat(s["x"], F.least(s["m"], F.lit(k)).cast("int"))))
    gen = makes.join(near, ["_k", "_id"], "left").withColumn("_nb", F.slice(F.when(F.col("_near").isNull(), copies)
                                                                            .otherwise(F.concat(copies, others)), 1, k))
    # a point shared by many rows makes many: in parts, dealt to several tasks
    parts = gen.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SPREAD))))
    width = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(width, "_k", "_id", "_part")
    gen = parts.withColumn("_s", F.explode(F.sequence(F.col("_part") * SPREAD + 1, F.least(F.col("_n"), (F.col("_part") + 1) * SPREAD))))
    pick = F.pmod(F.xxhash64("_id", "_s", F.lit(seed)), F.size("_nb")).cast("int")
    gap = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_id"), F.col("_s").cast("string"),
                                               F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(16 ** 8)
    synth = gen.select("_k", "_x", F.element_at("_nb", pick + 1).alias("_y"), gap.alias("_u")).select(
        "_k", F.zip_with("_x", "_y", lambda a, b: a + (b - a) * F.col("_u")).alias("_v"))
    label = train.sparkSession.createDataFrame(list(enumerate(names)), T.StructType(
        [T.StructField("_k", T.IntegerType()), T.StructField("_t", train.schema[t].dataType)]))
    synth = synth.join(F.broadcast(label), "_k")  # a row per class
    made = {x: F.col("_v")[i] for i, x in enumerate(features)} | {t: F.col("_t")}
    return train.unionByName(synth.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                                            for f in train.schema.fields]))


# ----------------------------------------------------------------------------- E7, E8, E9

def class_weights(df: DataFrame, t: str, mode: str = "balanced", col: str = "weight") -> DataFrame:
    """E7 ``balanced``: n / (k * n_c). E8 ``scale_pos``: negatives/positives on the positive class
    (label 1), 1 elsewhere. Weights come from a bounded class-count map (no join)."""
    counts = {k: v for k, v in _classes(df, t).items() if k is not None}
    n, k = sum(counts.values()), len(counts)
    if mode == "scale_pos":
        pos = counts.get(1, 0)
        ratio = (n - pos) / pos if pos else 1.0
        return df.withColumn(col, F.when(c(t) == F.lit(1), F.lit(ratio)).otherwise(F.lit(1.0)))
    weights = {cls: n / (k * m) for cls, m in counts.items()}
    lookup = F.create_map(*[x for cls, w in weights.items() for x in (F.lit(cls), F.lit(w))])
    return df.withColumn(col, lookup[c(t)])


def learning_sizes(steps: int = 6, start: float = 0.15) -> list[float]:
    return [start + (1.0 - start) * i / (steps - 1) for i in range(steps)]


def learning_subsets(df: DataFrame, sizes: Sequence[float] | None = None, seed: int = K.SEED,
                     key: Sequence[str] | str | None = None, col: str = "subset") -> DataFrame:
    """Nested subsets. ``subset`` = index of the smallest size whose cut includes the row,
    so subset i holds every row with ``subset <= i`` and contains all smaller subsets."""
    sizes = list(sizes or learning_sizes())
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    h = hash8(keys, seed)
    expr = F.lit(len(sizes) - 1)
    for i in reversed(range(len(sizes) - 1)):
        expr = F.when(h < F.lit(hex_cut(sizes[i])), F.lit(i)).otherwise(expr)
    return df.withColumn(col, expr)
