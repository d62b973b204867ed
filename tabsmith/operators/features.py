"""Feature-engineering operators.

Statistics (correlations, skew, quantiles, TF-IDF vocabulary) are computed
by distributed aggregates; only bounded results (per column, per pair of
columns, or a vocabulary of ``max_features`` terms) reach the driver, and
every feature is then a lazy projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.aggregates import level_counts
from ..functions.exprs import c, corrected_skew, dtype_of, inf_to_null, is_numeric, numeric_cols, safe_name, string_cols
from ..functions.quantiles import exact_quantiles
from ..functions.terms import batch_term_counts
from ..session import ship_package
from . import profile as P
from .clean import FrequencyEncoder, NumericImputer

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"  # runs of 2+ letters/digits/underscore (Unicode)


def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark ML's built-in stop-word list."""
    return tuple(StopWordsRemover.loadDefaultStopWords(language))


# ----------------------------------------------------------------------------- D1

def feature_columns(df: DataFrame, t: str) -> dict[str, list[str]]:
    """Numeric / categorical feature lists; the target is never a feature."""
    return {"numeric": numeric_cols(df, exclude=[t]), "categorical": string_cols(df, exclude=[t])}


# ----------------------------------------------------------------------------- D3

@dataclass
class TfidfFeatures:
    """D3: per-document TF-IDF over the ``max_features`` most frequent corpus terms.

    Tokens: lower-cased runs of 2+ letters/digits; stop words removed; terms kept when
    their document frequency >= ``min_df``; the vocabulary is the ``max_features`` terms
    with the highest corpus count (ties by term). Weight = count * (ln((1+n)/(1+df)) + 1),
    then L2-normalised per document over the vocabulary. One column per term,
    ``<col>_tfidf_<term>``; the text column is dropped.
    """
    col: str = "text"
    max_features: int = 20
    min_df: int = 2
    stop_words: Sequence[str] | None = None
    key: str | None = None  # optional document key; corpus statistics are per term, so fit needs none
    vocab: list = field(default_factory=list)
    idf: dict = field(default_factory=dict)

    def tokens(self):
        return F.regexp_extract_all(F.lower(F.coalesce(c(self.col), F.lit(""))), F.lit(TOKEN_PATTERN), 0)

    def fit(self, df: DataFrame) -> "TfidfFeatures":
        stops = list(self.stop_words if self.stop_words is not None else default_stop_words())
        n_docs = df.count()
        ship_package(df.sparkSession)
        # every text is tokenised once: a batch gives one row per term of its own, which the partial aggregate adds up
        stats = (df.select(self.tokens().alias("tokens")).mapInArrow(batch_term_counts, "term string, total long, df long")
                 .where(~F.col("term").isin(stops) if stops else F.lit(True))  # planned as a hash-set lookup
                 .groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
                 .where(F.col("df") >= self.min_df))
        top = stats.orderBy(F.col("total").desc(), F.col("term")).limit(self.max_features).collect()
        self.vocab = sorted(r["term"] for r in top)
        import math
        dfs = {r["term"]: r["df"] for r in top}
        self.idf = {w: math.log((1 + n_docs) / (1 + dfs[w])) + 1.0 for w in self.vocab}
        return self

    def _weighted(self, df: DataFrame, keep: list) -> DataFrame:
        """Adds ``__w``: normalised weights in vocabulary order. Tokens, raw weights and the norm
        are each computed once per document (separate projections, not re-inlined)."""
        vocab = F.array(*[F.lit(w) for w in self.vocab])
        idf = F.array(*[F.lit(float(self.idf[w])) for w in self.vocab])
        # Heavy expressions appear only as higher-order-function arguments, never inside a lambda
        # body: Catalyst may inline a projected column into a lambda, where it would be re-evaluated
        # per element. One pass keeps vocabulary tokens, one aggregate counts them per term.
        hits = F.filter(self.tokens(), lambda x: x.isin(self.vocab))  # a hash-set lookup, too
        zero = F.array(*[F.lit(0.0) for _ in self.vocab])
        counts = F.aggregate(hits, zero, lambda acc, x: F.transform(
            acc, lambda n, i: n + F.when(F.get(vocab, i) == x, F.lit(1.0)).otherwise(F.lit(0.0))))
        raw = df.select(*keep, F.zip_with(counts, idf, lambda n, w: n * w).alias("__raw"))
        normed = raw.select(*keep, "__raw",
                            F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x * x)).alias("__norm"))
        # divide outside any lambda: a column used inside a lambda body may be re-inlined per element
        norm = F.col("__norm")
        return normed.select(*keep, F.array(*[F.when(norm > 0, F.col("__raw")[i] / norm).otherwise(F.lit(0.0))
                                              for i in range(len(self.vocab))]).alias("__w"))

    def output_names(self) -> list[str]:
        return [safe_name(f"{self.col}_tfidf_{w}") for w in self.vocab]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c(x) for x in df.columns]
        if not self.vocab:
            return df.drop(self.col)
        w = self._weighted(df, keep)
        return w.select(*[c(x) for x in df.columns if x != self.col],
                        *[F.col("__w")[i].alias(n) for i, n in enumerate(self.output_names())])

    def transform_long(self, df: DataFrame, key: str) -> DataFrame:
        """(key, term, weight) for non-zero weights: the same values in long form."""
        if not self.vocab:
            return df.select(c(key), F.lit(None).cast("string").alias("term"),
                             F.lit(None).cast("double").alias("weight")).limit(0)
        w = self._weighted(df, [c(key)])
        terms = F.array(*[F.lit(t) for t in self.vocab])
        # explode_outer: plain explode makes Catalyst infer size(_z) > 0 and push that filter,
        # with the whole weight expression inlined, below the tokeniser
        return (w.select(c(key), F.arrays_zip(terms.alias("term"), F.col("__w").alias("weight")).alias("_z"))
                .select(c(key), F.explode_outer("_z").alias("_e"))
                .select(c(key), F.col("_e.term").alias("term"), F.col("_e.weight").alias("weight"))
                .where(F.col("weight") > 0))


# ----------------------------------------------------------------------------- D5, D6

def collinear_pairs(df: DataFrame, t: str, cols: Sequence[str] | None = None, limit: float = K.COLLINEAR_LIMIT
                    ) -> DataFrame:
    """Pairs (a, b) with |r(a, b)| > limit (a before b in column order), with each one's |r| to the target."""
    cols = [x for x in (cols or numeric_cols(df)) if x != t]
    pairs = P.correlation_matrix(df, cols).where(F.abs("r") > limit)
    tr = P.target_correlations(df, t, cols, digits=None).select("column", "abs_r")
    return (pairs.join(tr.withColumnsRenamed({"column": "a", "abs_r": "a_target_r"}), "a", "left")
            .join(tr.withColumnsRenamed({"column": "b", "abs_r": "b_target_r"}), "b", "left")
            .select("a", "b", "r", "a_target_r", "b_target_r"))


def prune_correlated(df: DataFrame, t: str, cols: Sequence[str] | None = None, limit: float = K.COLLINEAR_LIMIT,
                     mode: str = "greedy") -> tuple[DataFrame, list[str]]:
    """D5 (``greedy``): walk pairs in column order; of a pair above ``limit`` drop the one with the
    lower |target r| (the later one on ties); once a column is dropped it is skipped.
    D6 (``upper_half``): columns with any |r| > limit to an earlier column, drop the first half + 1.
    """
    cols = [x for x in (cols or numeric_cols(df)) if x != t]
    if mode == "upper_half":
        hits = P.correlation_matrix(df, cols).where(F.abs("r") > limit).select("b").distinct().collect()
        flagged = [x for x in cols if x in {r["b"] for r in hits}]
        drop = flagged[: len(flagged) // 2 + 1] if flagged else []
        return df.drop(*drop), drop
    at = {x: i for i, x in enumerate(cols)}
    place = F.create_map(*[F.lit(v) for kv in at.items() for v in kv])
    weaker = F.when(F.coalesce("a_target_r", F.lit(0.0)) < F.coalesce("b_target_r", F.lit(0.0)), F.col("a")).otherwise(F.col("b"))
    ordered = collinear_pairs(df, t, cols, limit).select("a", "b", weaker.alias("out")).orderBy(place[F.col("a")], place[F.col("b")])
    gone: dict[str, None] = {}
    for r in ordered.collect():  # at most (columns choose 2) pairs, in column order
        if r["a"] not in gone and r["b"] not in gone:
            gone[r["out"]] = None
    return df.drop(*gone), list(gone)


# ----------------------------------------------------------------------------- D8, D9

def log_features(df: DataFrame, cols: Sequence[str] | None = None, t: str | None = None, min_skew: float = K.LOG_SKEW,
                 strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Extra ``log_<c>`` = log1p(c) when skew > min_skew and all values > 0 (``strict``) or >= 0."""
    cols = [x for x in (cols or numeric_cols(df)) if x != t]
    if not cols:
        return df, []
    row = df.agg(*[F.min(c(x)).alias(f"_m{i}") for i, x in enumerate(cols)],
                 *[corrected_skew(c(x).cast("double")).alias(f"_s{i}") for i, x in enumerate(cols)]).first()
    made = []
    for i, x in enumerate(cols):
        mn, sk = row[f"_m{i}"], row[f"_s{i}"]
        if sk is None or sk <= min_skew or mn is None:
            continue
        if (strict and mn > 0) or (not strict and mn >= 0):
            made.append(x)
    return (df.withColumns({f"log_{x}": F.log1p(c(x).cast("double")) for x in made}) if made else df), made


def missing_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``<c>_was_missing`` flags for numeric columns lacking one — apply before imputation."""
    cols = cols or numeric_cols(df)
    new = {f"{x}_was_missing": c(x).isNull().cast("int") for x in cols if f"{x}_was_missing" not in df.columns}
    return df.withColumns(new) if new else df


# ----------------------------------------------------------------------------- D10, D11, D12

def _ranked_by_target(df: DataFrame, t: str, cols: Sequence[str]) -> list[tuple[str, float]]:
    pos = {x: i for i, x in enumerate(cols)}
    tr = [(r["column"], r["abs_r"]) for r in P.target_correlations(df, t, cols, digits=None).collect()]
    return sorted(tr, key=lambda p: (-p[1], pos[p[0]]))


def apply_products(df: DataFrame, products: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Replay fitted (name, a, b) products as one projection."""
    new = {name: c(a) * c(b) for name, a, b in products}
    return df.withColumns(new) if new else df


def interaction_pairs(df: DataFrame, t: str, cols: Sequence[str] | None = None, k: int = K.INTERACTION_TOP,
                      min_r: float = K.INTERACTION_MIN_R, pairs: str = "all") -> list[tuple[str, str, str]]:
    """Fit step of D10/D11: (name, a, b) for products of the k features most correlated with the target."""
    cols = [x for x in (cols or numeric_cols(df)) if x != t]
    top = [x for x, r in _ranked_by_target(df, t, cols) if r > min_r][:k]
    combos = list(combinations(top, 2)) if pairs == "all" else [(top[0], x) for x in top[1:]]
    return [(f"{a}_x_{b}", a, b) for a, b in combos]


def interactions(df: DataFrame, t: str, cols: Sequence[str] | None = None, k: int = K.INTERACTION_TOP,
                 min_r: float = K.INTERACTION_MIN_R, pairs: str = "all") -> tuple[DataFrame, list[str]]:
    """D10 (defaults) / D11 (``min_r=0``, ``pairs='all'|'star'``): products ``a_x_b`` of the k features
    most correlated with the target (|r| > min_r)."""
    prods = interaction_pairs(df, t, cols, k, min_r, pairs)
    return apply_products(df, prods), [p[0] for p in prods]


def polynomial_pairs(df: DataFrame, t: str, cols: Sequence[str] | None = None, k: int = 3
                     ) -> list[tuple[str, str, str]]:
    """Fit step of D12: squares ``a_sq`` and cross terms ``a_x_b`` of the k most target-correlated
    columns; names already present are skipped."""
    cols = [x for x in (cols or numeric_cols(df)) if x != t]
    top = [x for x, _ in _ranked_by_target(df, t, cols)][:k]
    if len(top) < 2:
        return []
    out = []
    for i, a in enumerate(top):
        for b in top[i:]:
            name = f"{a}_sq" if a == b else f"{a}_x_{b}"
            if name not in df.columns:
                out.append((name, a, b))
    return out


def polynomial_features(df: DataFrame, t: str, cols: Sequence[str] | None = None, k: int = 3
                        ) -> tuple[DataFrame, list[str]]:
    """Degree-2 terms of the k most target-correlated columns."""
    prods = polynomial_pairs(df, t, cols, k)
    return apply_products(df, prods), [p[0] for p in prods]


# ----------------------------------------------------------------------------- D13

@dataclass
class QuantileBins:
    """``<c>_bin`` = quantile bin 0..q-1 for columns with skew > ``min_skew``.

    Edges are the exact 0, 1/q, ..., 1 quantiles with duplicates merged; bins are
    right-closed and the first bin includes the minimum (not ``ntile``, which splits ties).
    """
    cols: Sequence[str] = ()
    q: int = 5
    min_skew: float | None = K.BIN_SKEW
    edges: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "QuantileBins":
        cols = [x for x in self.cols if x in df.columns and is_numeric(dtype_of(df, x))]
        if self.min_skew is not None and cols:
            row = df.agg(*[corrected_skew(c(x).cast("double")).alias(f"_s{i}") for i, x in enumerate(cols)]).first()
            cols = [x for i, x in enumerate(cols) if row[f"_s{i}"] is not None and row[f"_s{i}"] > self.min_skew]
        probs = [i / self.q for i in range(self.q + 1)]
        for x, vals in exact_quantiles(df, cols, probs).items():
            if vals[0] is None:
                continue
            edges = []
            for v in vals:
                if not edges or v != edges[-1]:
                    edges.append(v)
            self.edges[x] = edges
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for x, e in self.edges.items():
            if len(e) < 2:
                new[f"{x}_bin"] = F.lit(None).cast("int")
                continue
            v = c(x)
            expr = F.when(v.isNull() | (v < F.lit(e[0])) | (v > F.lit(e[-1])), F.lit(None).cast("int"))
            for i in range(1, len(e)):
                expr = expr.when(v <= F.lit(e[i]), F.lit(i - 1))
            new[f"{x}_bin"] = expr
        return df.withColumns(new) if new else df


# ----------------------------------------------------------------------------- D14-D17

def ratio_feature(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """A / (b + 1), NULL on a zero denominator."""
    return df.withColumn(name or f"{a}_per_{b}", F.try_divide(c(a).cast("double"), c(b) + 1))


def square_feature(df: DataFrame, a: str, name: str | None = None) -> DataFrame:
    """D15."""
    return df.withColumn(name or f"{a}_squared", c(a) * c(a))


def row_sum(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Row-wise sum (NULL if any part is NULL, as plain addition)."""
    expr = c(cols[0])
    for x in cols[1:]:
        expr = expr + c(x)
    return df.withColumn(name, expr)


def product_feature(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """Column x indicator."""
    return df.withColumn(name or f"{a}_x_{b}", c(a) * c(b))


# ----------------------------------------------------------------------------- D18, D19, D20

def encode_remaining(df: DataFrame, t: str | None = None, min_levels: int = 10) -> tuple[DataFrame, list[str]]:
    """Frequency-encode string columns (not the target) with more than ``min_levels`` levels."""
    cols = [x for x in string_cols(df) if x != t]
    if not cols:
        return df, []
    levels = level_counts(df, cols, min_levels)
    todo = [x for x in cols if levels[x] > min_levels]
    return FrequencyEncoder(cols=todo).fit(df).transform(df), todo


def sanitize(df: DataFrame, t: str | None = None) -> DataFrame:
    """+-inf -> NULL, numeric NULL -> median, then 0; strings -> 'unknown'. Target untouched."""
    nums = [x for x in numeric_cols(df) if x != t]
    out = df.withColumns({x: inf_to_null(c(x)) for x in nums}) if nums else df
    imp = NumericImputer(flag_min=2.0, flag_max=2.0, drop_above=None, cols=nums).fit(out)
    out = imp.transform(out)
    fill_num = {x: 0 for x in nums}
    fill_str = {x: "unknown" for x in string_cols(out) if x != t}
    out = out.fillna(fill_num) if fill_num else out
    return out.fillna(fill_str) if fill_str else out


def feature_report(before: DataFrame, after: DataFrame, t: str) -> DataFrame:
    """(feature, is_new, target_r) for every feature after the stage; new ones flagged."""
    old = set(before.columns)
    feats = [x for x in after.columns if x != t]
    corr = P.target_correlations(after, t, [x for x in numeric_cols(after) if x != t], digits=3)
    rows = [(x, x not in old) for x in feats]
    base = after.sparkSession.createDataFrame(rows, "feature string, is_new boolean")
    return base.join(corr.select(F.col("column").alias("feature"), F.col("r").alias("target_r")), "feature", "left")
