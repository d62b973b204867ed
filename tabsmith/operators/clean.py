"""Cleaning operators (C1-C34) as fit/transform pairs.

``fit`` runs one aggregate job and keeps only bounded statistics (per column,
or per level for encoders proven small by a distinct count). ``transform`` is
a lazy projection, so fitted cleaners apply to batch and streaming frames
alike. Large lookup maps (free-text frequencies, many labels) stay
DataFrames and are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.aggregates import level_counts, modes
from ..functions.exprs import (
    boolean_cols, c, dtype_of, is_datetime, is_fractional, is_integral, is_numeric, numeric_cols, safe_name,
    string_cols,
)
from ..functions.cumulative import BROADCAST_ROWS, dense_ranks
from ..functions.quantiles import exact_quantiles
from ..sources.tables import materialize

INLINE_LEVELS = 1_000  # lookup maps up to this many keys become literal maps; larger ones are joined


def _log(step: str, column: str | None, action: str, n: int | None, reason: str = "") -> tuple:
    return (step, column, action, None if n is None else int(n), reason)


LOG_SCHEMA = "step string, column string, action string, n_affected bigint, reason string"


# ----------------------------------------------------------------------------- C1, C2, C3

@dataclass
class SentinelNulls:
    """String sentinels -> NULL (exact match); numeric sentinels -> NULL when frequent.

    A numeric sentinel ``v`` is replaced in a column when more than ``min_share`` of all
    rows equal ``v`` and the column's minimum over non-sentinel values is >= 0
    (the reference tests the minimum with the sentinels included, so -1 and -999
    could never match; see README).
    """
    strings: Sequence[str] = tuple(K.STRING_NULLS)
    numbers: Sequence[float] = tuple(K.NUMERIC_NULLS)
    min_share: float = 0.05
    exclude: Sequence[str] = ()
    replace: dict = field(default_factory=dict)
    str_cols: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> "SentinelNulls":
        ex = set(self.exclude)
        self.str_cols = [n for n in string_cols(df) if n not in ex]
        nums = [n for n in numeric_cols(df) if n not in ex]
        if not nums:
            self.replace = {}
            return self
        sent = [F.lit(v) for v in self.numbers]
        exprs = [F.count(F.lit(1)).alias("_n")]
        for i, n in enumerate(nums):
            x = c(n)
            exprs.append(F.min(F.when(~x.isin(*sent), x)).alias(f"_min{i}"))
            exprs += [F.count_if(x == F.lit(v)).alias(f"_c{i}_{j}") for j, v in enumerate(self.numbers)]
        row = df.agg(*exprs).first()
        total = max(row["_n"], 1)
        self.replace = {}
        for i, n in enumerate(nums):
            mn = row[f"_min{i}"]
            hits = [v for j, v in enumerate(self.numbers) if row[f"_c{i}_{j}"] / total > self.min_share]
            if hits and mn is not None and mn >= 0:
                self.replace[n] = hits
        return self

    def _expr(self, name: str) -> Column:
        x = c(name)
        if name in self.replace:
            return F.when(x.isin(*[F.lit(v) for v in self.replace[name]]), F.lit(None)).otherwise(x)
        return F.when(x.isin(*[F.lit(s) for s in self.strings]), F.lit(None)).otherwise(x)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [n for n in self.str_cols if n in df.columns] + [n for n in self.replace if n in df.columns]
        return df.withColumns({n: self._expr(n) for n in cols}) if cols else df

    def counts(self, df: DataFrame) -> DataFrame:
        """(column, n_replaced) over the frame before replacement, plus a ``__total__`` row."""
        cols = [n for n in self.str_cols if n in df.columns] + [n for n in self.replace if n in df.columns]
        if not cols:
            return df.sparkSession.createDataFrame([], "column string, n_replaced bigint")
        agg = df.agg(*[F.count_if(c(n).isNotNull() & self._expr(n).isNull()).alias(f"_s{i}")
                       for i, n in enumerate(cols)])
        names = F.create_map(*[x for i, n in enumerate(cols) for x in (F.lit(f"_s{i}"), F.lit(n))])
        long = agg.unpivot([], [f"_s{i}" for i in range(len(cols))], "_slot", "n_replaced") \
            .select(names[F.col("_slot")].alias("column"), "n_replaced")
        total = long.agg(F.sum("n_replaced").alias("n_replaced")).select(F.lit("__total__").alias("column"),
                                                                          F.col("n_replaced").cast("bigint"))
        return long.unionByName(total)


def null_sentinels(df: DataFrame, exclude: Sequence[str] = (), **kw) -> DataFrame:
    return SentinelNulls(exclude=exclude, **kw).fit(df).transform(df)


# ----------------------------------------------------------------------------- C4, C5, C6

def drop_useless(df: DataFrame, t: str, max_null: float = K.NULL_DROP, id_rule: str = "pattern",
                 extra_id: Sequence[str] = (), extra_constant: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Drop ID-like, mostly-null (> max_null) and constant columns; never the target.

    ``id_rule='pattern'`` uses the B25 rule; ``'substring'`` the literal "'id' in name and >95 %
    distinct" rule as written in the reference recipe. Returns (frame, (column, reason) table).
    """
    from ..plans.rules import plan_table
    table = plan_table(df, t).collect()  # one row per column
    drops = []
    for r in table:
        n = r["column"]
        if n == t:
            continue
        if id_rule == "substring":
            is_id = "id" in n.lower() and r["n_unique"] > K.ID_SHARE_STRICT * r["n_rows"]
        else:
            is_id = r["is_id_like"]
        if is_id or n in extra_id:
            drops.append((n, "id_like", int(r["n_unique"])))
        elif r["null_pct"] > max_null:
            drops.append((n, "mostly_missing", int(r["n_missing"])))
        elif r["n_unique"] <= 1 or n in extra_constant:
            drops.append((n, "constant", int(r["n_unique"])))
    out = df.drop(*[d[0] for d in drops])
    return out, df.sparkSession.createDataFrame(drops, "column string, reason string, evidence bigint")


# ----------------------------------------------------------------------------- C7, C8, C9, C32

@dataclass
class NumericImputer:
    """C7-C9 (defaults) and C32 (``flag_min=.30, flag_min_inclusive=False, flag_max=1, drop_above=None``).

    null share == 0: untouched; < flag_min: median fill; flag band: ``<c>_was_missing`` flag
    then median; > drop_above: column dropped. Medians are exact (linear interpolation).
    """
    flag_min: float = K.NULL_LOW
    flag_max: float = K.NULL_HIGH
    drop_above: float | None = K.NULL_HIGH
    flag_min_inclusive: bool = True
    exclude: Sequence[str] = ()
    cols: Sequence[str] | None = None
    medians: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "NumericImputer":
        ex = set(self.exclude)
        cols = [n for n in (self.cols or numeric_cols(df)) if n not in ex and n in df.columns]
        if not cols:
            return self
        row = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(c(n).isNull()).alias(f"_m{i}") for i, n in enumerate(cols)]).first()
        total = max(row["_n"], 1)
        self.shares = {n: row[f"_m{i}"] / total for i, n in enumerate(cols)}
        need = [n for n, s in self.shares.items() if s > 0]
        self.medians = {k: v[0] for k, v in exact_quantiles(df, need, [0.5]).items()} if need else {}
        return self

    def action(self, name: str) -> str:
        s = self.shares.get(name, 0.0)
        if s == 0:
            return "none"
        if self.drop_above is not None and s > self.drop_above:
            return "drop"
        lo_ok = s >= self.flag_min if self.flag_min_inclusive else s > self.flag_min
        if lo_ok and s <= self.flag_max:
            return "flag_median"
        return "median"

    def transform(self, df: DataFrame) -> DataFrame:
        new, drop = {}, []
        for n in self.shares:
            if n not in df.columns:
                continue
            act = self.action(n)
            if act == "drop":
                drop.append(n)
                continue
            if act == "flag_median":
                new[f"{n}_was_missing"] = c(n).isNull().cast("int")
            if act in ("median", "flag_median") and self.medians.get(n) is not None:
                new[n] = F.coalesce(c(n), F.lit(self.medians[n]))
        return df.withColumns(new).drop(*drop) if new else df.drop(*drop)

    def log_rows(self) -> list[tuple]:
        rows = []
        for n, s in self.shares.items():
            act = self.action(n)
            if act != "none":
                rows.append(_log("impute", n, act, None, f"{s:.1%} missing"))
        return rows


# ----------------------------------------------------------------------------- C10

@dataclass
class ModeImputer:
    """Categorical NULL -> most frequent value (smallest on ties), 'unknown' when none."""
    exclude: Sequence[str] = ()
    cols: Sequence[str] | None = None
    fill: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "ModeImputer":
        ex = set(self.exclude)
        cols = [n for n in (self.cols or string_cols(df)) if n not in ex and n in df.columns]
        if not cols:
            return self
        got = {r["column"]: r["mode"] for r in modes(df, cols).collect()}  # one row per column
        self.fill = {n: got.get(n) if got.get(n) is not None else "unknown" for n in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.coalesce(c(n), F.lit(v)) for n, v in self.fill.items() if n in df.columns})


# ----------------------------------------------------------------------------- C11, C12, C13, C14

def numeric_string_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, share): fraction of all rows whose value parses as a number."""
    cols = list(cols or string_cols(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, share double")
    agg = df.agg(*[(F.count_if(c(n).try_cast("double").isNotNull()) / F.count(F.lit(1))).alias(f"_p{i}")
                   for i, n in enumerate(cols)])
    names = F.create_map(*[x for i, n in enumerate(cols) for x in (F.lit(f"_p{i}"), F.lit(n))])
    return agg.unpivot([], [f"_p{i}" for i in range(len(cols))], "_slot", "share") \
        .select(names[F.col("_slot")].alias("column"), "share")


def cast_numeric_strings(df: DataFrame, min_share: float = K.NUMERIC_PARSE_SHARE,
                         exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """C11: cast string columns to double when more than ``min_share`` of all rows parse."""
    cols = [n for n in string_cols(df) if n not in set(exclude)]
    shares = {r["column"]: r["share"] for r in numeric_string_shares(df, cols).collect()}
    cast = [n for n, s in shares.items() if s is not None and s > min_share]
    return (df.withColumns({n: c(n).try_cast("double") for n in cast}) if cast else df), cast


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """Unparseable values become NULL (ANSI-safe ``try_cast``)."""
    return df.withColumn(col, c(col).try_cast("double"))


def boolean_text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns whose non-null values are all yes/no/true/false (any case)."""
    cols = [n for n in string_cols(df) if n not in set(exclude)]
    if not cols:
        return []
    words = [F.lit(w) for w in K.BOOLEAN_TRUE + K.BOOLEAN_FALSE]
    row = df.agg(*[F.bool_and(F.when(c(n).isNotNull(), F.lower(c(n)).isin(*words))).alias(f"_b{i}")
                   for i, n in enumerate(cols)]).first()
    return [n for i, n in enumerate(cols) if row[f"_b{i}"]]


def map_boolean_text(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Yes/No, True/False (any case) -> 1/0 as int; other values NULL."""
    cols = list(cols) if cols is not None else boolean_text_columns(df, exclude)
    t_words = [F.lit(w) for w in K.BOOLEAN_TRUE]
    f_words = [F.lit(w) for w in K.BOOLEAN_FALSE]
    return df.withColumns({n: F.when(F.lower(c(n)).isin(*t_words), F.lit(1))
                          .when(F.lower(c(n)).isin(*f_words), F.lit(0)) for n in cols}) if cols else df


def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """C14: fixed value map (unmapped -> NULL)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out or col, m[c(col)])


# ----------------------------------------------------------------------------- C15, D2

@dataclass
class DatetimeExpander:
    """<c>_year, _month, _day, _dayofweek (Mon=0), _is_weekend, and _hour only when
    the column has more than one distinct hour; NULL parts -> 0; the source column is dropped."""
    cols: Sequence[str] = ()
    with_hour: dict = field(default_factory=dict)

    @staticmethod
    def _ts(df: DataFrame, n: str) -> Column:
        return c(n) if is_datetime(dtype_of(df, n)) else F.try_to_timestamp(c(n).cast("string"))

    def fit(self, df: DataFrame) -> "DatetimeExpander":
        cols = [n for n in self.cols if n in df.columns]
        if cols:
            row = df.agg(*[F.count_distinct(F.hour(self._ts(df, n))).alias(f"_h{i}") for i, n in enumerate(cols)]).first()
            self.with_hour = {n: row[f"_h{i}"] > 1 for i, n in enumerate(cols)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new, drop = {}, []
        for n in self.cols:
            if n not in df.columns:
                continue
            ts = self._ts(df, n)
            dow = F.weekday(ts)
            new[f"{n}_year"] = F.coalesce(F.year(ts), F.lit(0))
            new[f"{n}_month"] = F.coalesce(F.month(ts), F.lit(0))
            new[f"{n}_day"] = F.coalesce(F.dayofmonth(ts), F.lit(0))
            new[f"{n}_dayofweek"] = F.coalesce(dow, F.lit(0))
            new[f"{n}_is_weekend"] = F.coalesce(dow >= 5, F.lit(False)).cast("int")
            if self.with_hour.get(n):
                new[f"{n}_hour"] = F.coalesce(F.hour(ts), F.lit(0))
            drop.append(n)
        return df.withColumns(new).drop(*drop) if new else df


def expand_datetime(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return DatetimeExpander(cols=cols).fit(df).transform(df)


# ----------------------------------------------------------------------------- C16, C19, D4, D18

@dataclass
class FrequencyEncoder:
    """Value -> share of all fitted rows; unseen and NULL -> 0.

    Maps with at most ``INLINE_LEVELS`` keys (one pass of sketches for all columns, exact near the limit)
    become literal maps in the projection (no join, no shuffle). Larger maps are counted once into a
    table in the shared folder and joined on the value; the join strategy is left to AQE, with no hint.
    """
    cols: Sequence[str] = ()
    inline_limit: int = INLINE_LEVELS
    inline: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "FrequencyEncoder":
        cols = [n for n in self.cols if n in df.columns]
        if not cols:
            return self
        total = max(df.count(), 1)
        levels = level_counts(df, cols, self.inline_limit) if self.inline_limit > 0 else {}
        for n in cols:
            freq = (df.where(c(n).isNotNull()).groupBy(c(n).alias("_k"))
                    .agg((F.count(F.lit(1)) / F.lit(float(total))).alias("_f")))
            if levels.get(n, self.inline_limit + 1) <= self.inline_limit:
                self.inline[n] = {r["_k"]: r["_f"] for r in freq.collect()}
            else:
                self.tables[n] = materialize(freq, "levels")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for n, m in self.inline.items():
            if n in df.columns:
                lookup = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]) if m else None
                new[n] = F.coalesce(lookup[c(n)], F.lit(0.0)) if lookup is not None else F.lit(0.0)
        out = df.withColumns(new) if new else df
        for n, table in self.tables.items():
            if n not in out.columns:
                continue
            key = f"__fk_{safe_name(n)}"
            t = table.withColumnRenamed("_k", key).withColumnRenamed("_f", f"__fv_{safe_name(n)}")
            out = (out.join(t, c(n) == F.col(key), "left").drop(key)
                   .withColumn(n, F.coalesce(F.col(f"__fv_{safe_name(n)}"), F.lit(0.0)))
                   .drop(f"__fv_{safe_name(n)}"))
        return out


# ----------------------------------------------------------------------------- C17, C18, C20, C21, C22

@dataclass
class OneHot:
    """One int column ``<c>_<level>`` per sorted level; NULL -> all zeros.

    ``drop_first`` drops the first sorted level. Columns with more than ``max_levels``
    levels are refused (use FrequencyEncoder), so the level lists are bounded.
    """
    cols: Sequence[str] = ()
    drop_first: bool = True
    max_levels: int = K.ONEHOT_MAX_LEVELS
    levels: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OneHot":
        cols = [n for n in self.cols if n in df.columns]
        if not cols:
            return self
        levels = level_counts(df, cols, self.max_levels)
        too_many = [n for n in cols if levels[n] > self.max_levels]
        if too_many:
            raise ValueError(f"one-hot refused for {too_many}: more than {self.max_levels} levels")
        lv = df.agg(*[F.sort_array(F.collect_set(c(n))).alias(f"_l{i}") for i, n in enumerate(cols)]).first()
        self.levels = {n: list(lv[f"_l{i}"]) for i, n in enumerate(cols)}
        return self

    def output_names(self, n: str) -> list[str]:
        keep = self.levels[n][1:] if self.drop_first else self.levels[n]
        return [safe_name(f"{n}_{v}") for v in keep]

    def transform(self, df: DataFrame) -> DataFrame:
        new, drop = {}, []
        for n, lv in self.levels.items():
            if n not in df.columns:
                continue
            keep = lv[1:] if self.drop_first else lv
            for v in keep:
                new[safe_name(f"{n}_{v}")] = F.coalesce(c(n) == F.lit(v), F.lit(False)).cast("int")
            drop.append(n)
        return df.withColumns(new).drop(*drop) if new else df.drop(*drop)


def ordinal_encode(df: DataFrame, orders: dict[str, list]) -> DataFrame:
    """C20: position in the given order (0-based); unknown and NULL -> -1."""
    new = {}
    for n, order in orders.items():
        if n in df.columns:
            pos = F.array_position(F.array(*[F.lit(v) for v in order]), c(n)).cast("int") - 1
            new[n] = F.coalesce(pos, F.lit(-1))
    return df.withColumns(new) if new else df


def encode_all(df: DataFrame, cols: Sequence[str], max_levels: int = K.ONEHOT_MAX_LEVELS,
               encoding: dict | None = None) -> DataFrame:
    """C21 (with C17/C19/C20): use the plan entry when present, else > max_levels -> frequency, else one-hot."""
    encoding = encoding or {}
    cols = [n for n in cols if n in df.columns]
    if not cols:
        return df
    levels = level_counts(df, cols, max_levels)
    ordinal, freq, onehot = {}, [], []
    for n in cols:
        e = encoding.get(n, {})
        if e.get("kind") == "ordinal":
            ordinal[n] = e["order"]
        elif e.get("kind") == "frequency" or levels[n] > max_levels:
            freq.append(n)
        else:
            onehot.append(n)
    out = ordinal_encode(df, ordinal)
    out = FrequencyEncoder(cols=freq).fit(out).transform(out)
    return OneHot(cols=onehot, drop_first=True, max_levels=max_levels).fit(out).transform(out)


@dataclass
class LabelEncoder:
    """Integer codes in sorted value order; NULL gets its own code after the last level.

    Few levels (distinct count checked) -> literal array lookup. Many levels -> codes
    from a distributed sort of the distinct values (``dense_ranks``), joined back.
    """
    cols: Sequence[str] = ()
    inline_limit: int = INLINE_LEVELS
    inline: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "LabelEncoder":
        cols = [n for n in self.cols if n in df.columns]
        if not cols:
            return self
        row = df.agg(*[F.approx_count_distinct(c(n)).alias(f"_d{i}") for i, n in enumerate(cols)]).first()
        for i, n in enumerate(cols):
            distinct = df.where(c(n).isNotNull()).select(c(n).cast("string").alias("_k")).distinct()
            if row[f"_d{i}"] <= self.inline_limit:
                self.inline[n] = sorted(r["_k"] for r in distinct.collect())
            else:
                self.tables[n] = dense_ranks(distinct, ["_k"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for n, lv in self.inline.items():
            if n in df.columns:
                pos = F.array_position(F.array(*[F.lit(v) for v in lv]), c(n).cast("string")).cast("int") - 1
                new[n] = F.when(c(n).isNull(), F.lit(len(lv))).otherwise(pos)
        out = df.withColumns(new) if new else df
        for n, (table, n_levels) in self.tables.items():
            if n not in out.columns:
                continue
            key = f"__lk_{safe_name(n)}"
            t = table.withColumnRenamed("_k", key)
            t = F.broadcast(t) if n_levels <= BROADCAST_ROWS else t
            out = (out.join(t, c(n).cast("string") == F.col(key), "left").drop(key)
                   .withColumn(n, F.coalesce(F.col("_code"), F.lit(n_levels)).cast("int")).drop("_code"))
        return out


# ----------------------------------------------------------------------------- C23, C24

def encode_target(df: DataFrame, t: str, problem_type: str, max_classes: int = 1000) -> tuple[DataFrame, dict]:
    """C23/C24. Regression: numeric, unparseable rows dropped. Classes: trimmed strings in sorted
    order -> 0..k-1 (int); numeric class targets cast to int; NULL targets dropped."""
    if problem_type == "regression":
        out = df.withColumn(t, c(t).try_cast("double") if not is_numeric(dtype_of(df, t)) else c(t).cast("double"))
        return out.where(c(t).isNotNull()), {}
    if isinstance(dtype_of(df, t), T.StringType):
        trimmed = F.trim(c(t))
        levels = [r["v"] for r in df.where(c(t).isNotNull()).select(trimmed.alias("v")).distinct()
                  .orderBy("v").limit(max_classes + 1).collect()]
        if len(levels) > max_classes:
            raise ValueError(f"target {t!r} has more than {max_classes} classes")
        mapping = {v: i for i, v in enumerate(levels)}
        code = F.array_position(F.array(*[F.lit(v) for v in levels]), trimmed).cast("int") - 1
        return df.where(c(t).isNotNull()).withColumn(t, code), mapping
    return df.where(c(t).isNotNull()).withColumn(t, c(t).cast("int")), {}


def apply_target_codes(df: DataFrame, t: str, mapping: dict) -> DataFrame:
    """Replay a fitted C24 mapping (trimmed level -> code); unseen levels and NULL targets are dropped."""
    levels = sorted(mapping, key=mapping.get)
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), F.trim(c(t))).cast("int") - 1
    return df.withColumn(t, code).where(c(t) >= 0)


# ----------------------------------------------------------------------------- C25, C26, C27

def log_transform(df: DataFrame, cols: Sequence[str], t: str | None = None,
                  min_skew: float | None = None) -> tuple[DataFrame, list[str]]:
    """C25 (``min_skew=None``) / D7 (``min_skew=1``): log1p in place on listed numeric columns,
    never the target, only when min >= 0 (and, for D7, signed skew > min_skew)."""
    from ..functions.exprs import corrected_skew
    cand = [n for n in cols if n in df.columns and n != t and is_numeric(dtype_of(df, n))]
    if not cand:
        return df, []
    exprs = [F.min(c(n)).alias(f"_m{i}") for i, n in enumerate(cand)]
    if min_skew is not None:
        exprs += [corrected_skew(c(n).cast("double")).alias(f"_s{i}") for i, n in enumerate(cand)]
    row = df.agg(*exprs).first()
    done = []
    for i, n in enumerate(cand):
        mn = row[f"_m{i}"]
        if mn is None or mn < 0:
            continue
        if min_skew is not None and not (row[f"_s{i}"] is not None and row[f"_s{i}"] > min_skew):
            continue
        done.append(n)
    return (df.withColumns({n: F.log1p(c(n).cast("double")) for n in done}) if done else df), done


@dataclass
class Winsorizer:
    """Clip int/float columns (never boolean, never the target) to exact [1 %, 99 %] percentiles."""
    low: float = K.CLIP_LOW
    high: float = K.CLIP_HIGH
    exclude: Sequence[str] = ()
    cols: Sequence[str] | None = None
    bounds: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Winsorizer":
        ex = set(self.exclude)
        cols = [n for n in (self.cols or numeric_cols(df)) if n not in ex and n in df.columns]
        q = exact_quantiles(df, cols, [self.low, self.high])
        self.bounds = {n: tuple(v) for n, v in q.items() if v[0] is not None}
        return self

    def _expr(self, n: str) -> Column:
        lo, hi = self.bounds[n]
        x = c(n)
        return F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x.cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: self._expr(n) for n in self.bounds if n in df.columns})

    def clipped_counts(self, df: DataFrame) -> DataFrame:
        """(column, n_clipped, low, high) on the frame before clipping."""
        cols = [n for n in self.bounds if n in df.columns]
        rows = []
        if cols:
            row = df.agg(*[F.count_if((c(n) < F.lit(self.bounds[n][0])) | (c(n) > F.lit(self.bounds[n][1])))
                           .alias(f"_k{i}") for i, n in enumerate(cols)]).first()
            rows = [(n, int(row[f"_k{i}"]), float(self.bounds[n][0]), float(self.bounds[n][1]))
                    for i, n in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, "column string, n_clipped bigint, low double, high double")


def bool_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns -> tinyint."""
    cols = boolean_cols(df)
    return df.withColumns({n: c(n).cast("tinyint") for n in cols}) if cols else df


# ----------------------------------------------------------------------------- C28, C29, C30, C31

def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (hot duplicates collapse in the map-side partial aggregate)."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates) in one job."""
    return df.groupBy(*[c(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("_k")).agg(
        F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def redundant_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """C29 check: (keep, twin, one_to_one) — the twin is a 1:1 function of the kept column."""
    rows = []
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            rows.append(df.agg(F.count_distinct(c(a)).alias("da"), F.count_distinct(c(b)).alias("db"),
                               F.count_distinct(c(a), c(b)).alias("dab"))
                        .select(F.lit(a).alias("keep"), F.lit(b).alias("twin"),
                                ((F.col("da") == F.col("dab")) & (F.col("db") == F.col("dab"))).alias("one_to_one")))
    if not rows:
        return df.sparkSession.createDataFrame([], "keep string, twin string, one_to_one boolean")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def drop_redundant(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Drop each twin that is a 1:1 copy of its ordinal-encoded partner."""
    twins = [r["twin"] for r in redundant_pairs(df, pairs).where("one_to_one").collect()]
    return df.drop(*twins)


def final_fill(df: DataFrame, t: str | None = None) -> DataFrame:
    """Numeric NULL -> median (target included, as the reference), string -> mode / 'unknown'
    (target excluded), booleans -> tinyint, anything left -> 0."""
    nums = [n for n in numeric_cols(df)]
    imp = NumericImputer(flag_min=2.0, flag_max=2.0, drop_above=None, cols=nums).fit(df)
    out = imp.transform(df)
    out = ModeImputer(exclude=[t] if t else []).fit(out).transform(out)
    out = bool_to_int(out)
    fill = {n: 0 for n in numeric_cols(out)}
    return out.fillna(fill) if fill else out


def drop_null_rows(df: DataFrame) -> DataFrame:
    """C31."""
    return df.na.drop()


def target_values(df: DataFrame, t: str) -> DataFrame:
    """The distinct target values, one row each, as text."""
    return df.where(c(t).isNotNull()).select(c(t).cast("string").alias("target_value")).distinct()


def cleaning_summary(df: DataFrame, t: str) -> DataFrame:
    """(n_rows, n_cols, target_dtype, n_numeric, no_missing, n_target_values); the values themselves are
    rows of ``target_values``."""
    nums = [n for n in numeric_cols(df) if n != t]
    any_null = F.lit(False)
    for n in df.columns:
        any_null = any_null | c(n).isNull()
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), (~F.coalesce(F.max(any_null), F.lit(False))).alias("no_missing"),
                   F.count_distinct(c(t)).alias("n_target_values"))
    return stats.select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.lit(dtype_of(df, t).simpleString()).alias("target_dtype"),
        F.lit(len(nums)).cast("bigint").alias("n_numeric"), "no_missing", "n_target_values",
    )
