"""Composed stages: Cleaner (C1-C34 in order), Featurizer (D2-D20) and the end-to-end run.

Each step is fitted on the frame produced by the previous steps (one aggregate
job per step; only bounded statistics are kept) and replayed as a lazy
projection on other frames, so a cleaner fitted on train applies unchanged to
test or to a stream. Lineage is cut with a reliable checkpoint between stages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.aggregates import level_counts
from ..functions.exprs import datetime_typed_cols, numeric_cols, string_cols
from ..operators import audit as H
from ..operators import clean as C
from ..operators import features as FE
from ..session import cut_lineage, shared_path
from .rules import Plan, build_plan

# Reason text per cleaning action (joined to the step log).
REASONS = {
    "sentinel_to_null": "encoded missing value replaced by NULL",
    "id_like": "identifier carries no signal",
    "mostly_missing": "too few observed values to fill the rest from",
    "constant": "one value in every row cannot tell rows apart",
    "median": "few missing values: median fill",
    "flag_median": "moderate missing share: indicator flag plus median",
    "missing_flag": "indicator of a filled value, asked for by the feature plan",
    "drop": "too many missing values to impute",
    "mode": "categorical missing values: most frequent value",
    "to_numeric": "numbers stored as text",
    "boolean_text": "yes/no text mapped to 1/0",
    "datetime_parts": "date expanded to calendar parts",
    "encode": "categorical encoded per plan",
    "target_encode": "target mapped to numbers",
    "log1p": "skewed non-negative column compressed",
    "clip": "outliers clipped to the 1st/99th percentile",
    "bool_to_int": "booleans stored as int8",
    "duplicates": "exact duplicate rows removed",
    "redundant": "numeric twin of an ordinal column",
    "final_fill": "remaining gaps filled",
}


@dataclass
class FittedCleaner:
    target: str
    problem_type: str
    steps: list = field(default_factory=list)  # (name, callable(df) -> df)
    log_rows: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for name, fn in self.steps:
            if name == "duplicates":
                continue  # de-duplication applies to the fitted (training) frame only
            out = fn(out)
        return out

    def log(self, spark) -> DataFrame:
        """(step, column, action, n_affected, reason)."""
        base = spark.createDataFrame(self.log_rows, C.LOG_SCHEMA)
        reasons = spark.createDataFrame(list(REASONS.items()), "action string, fixed_reason string")
        return (base.join(F.broadcast(reasons), "action", "left")  # fixed lookup table: bounded
                .select("step", "column", "action", "n_affected",
                        F.coalesce("fixed_reason", "reason").alias("reason")))


@dataclass
class Cleaner:
    """Cleaning in the reference's order: sentinels -> drop useless -> impute -> type repair ->
    encode -> target -> log -> clip -> bool -> duplicates -> redundant -> final fill."""
    plan: Plan
    drop_duplicates: bool = True
    redundant_pairs: Sequence[tuple[str, str]] = ()
    text_encoding: str = "tfidf"  # text columns stay for the featurizer; "frequency" encodes here

    def fit(self, df: DataFrame) -> tuple[FittedCleaner, DataFrame]:
        t, plan = self.plan.target, self.plan
        fc = FittedCleaner(t, plan.problem_type)
        log = fc.log_rows
        # every step's statistics job re-reads the input through the lazy chain: keep one copy
        # (memory, spilling to executor disk; lost blocks are recomputed from lineage)
        base = df.persist(StorageLevel.MEMORY_AND_DISK)
        cur, distinct = base, None

        def add(name, fn):
            nonlocal cur
            fc.steps.append((name, fn))
            cur = fn(cur)

        s = C.SentinelNulls(exclude=[t]).fit(cur)
        for r in s.counts(cur).where("n_replaced > 0").collect():
            log.append(("sentinels", r["column"], "sentinel_to_null", r["n_replaced"], ""))
        add("sentinels", s.transform)

        _, dropped = C.drop_useless(cur, t, extra_id=plan.id_columns, extra_constant=plan.constant_columns)
        drops = [r["column"] for r in dropped.collect()]
        for r in dropped.collect():
            log.append(("drop_useless", r["column"], r["reason"], r["evidence"], ""))
        add("drop_useless", lambda d, drops=drops: d.drop(*drops))

        imp = C.NumericImputer(exclude=[t]).fit(cur)
        log.extend(imp.log_rows())
        # Flags of filled columns that the imputer flags none for, made here, where the rows still show what is missing
        flagged = [x for x in imp.shares if imp.action(x) == "median"] if plan.missing_flags else []
        if flagged:
            log.extend(("impute", x, "missing_flag", None, "") for x in flagged)
            add("missing_flags", lambda d, cols=flagged: FE.missing_flags(d, cols))
        add("impute_numeric", imp.transform)
        mode = C.ModeImputer(exclude=[t] + [x for x in plan.text_columns]).fit(cur)
        for x in mode.fill:
            log.append(("impute_categorical", x, "mode", None, ""))
        add("impute_categorical", mode.transform)

        _, cast = C.cast_numeric_strings(cur, exclude=[t])
        for x in cast:
            log.append(("type_fix", x, "to_numeric", None, ""))
        add("to_numeric", lambda d, cast=cast: d.withColumns({x: F.col(f"`{x}`").try_cast("double") for x in cast})
            if cast else d)
        bools = C.boolean_text_columns(cur, exclude=[t])
        for x in bools:
            log.append(("type_fix", x, "boolean_text", None, ""))
        add("boolean_text", lambda d, bools=bools: C.map_boolean_text(d, bools))

        dt_cols = [x for x in dict.fromkeys(plan.datetime_columns + datetime_typed_cols(cur, exclude=[t]))
                   if x in cur.columns]
        dte = C.DatetimeExpander(cols=dt_cols).fit(cur)
        for x in dt_cols:
            log.append(("type_fix", x, "datetime_parts", None, ""))
        add("datetime", dte.transform)

        text = [x for x in plan.text_columns if x in cur.columns]
        if self.text_encoding == "frequency" and text:
            fe = C.FrequencyEncoder(cols=text).fit(cur)
            add("text_frequency", fe.transform)
            text = []
        cats = [x for x in string_cols(cur, exclude=[t]) if x not in text]
        before_cols = set(cur.columns)
        enc_steps = self._fit_encoders(cur, cats)
        for x in cats:
            log.append(("encode", x, "encode", None, self.plan.encoding.get(x, {}).get("kind", "auto")))
        add("encode", enc_steps)
        onehot_cols = [x for x in cur.columns if x not in before_cols]

        _, mapping = C.encode_target(cur, t, plan.problem_type)
        log.append(("target", t, "target_encode", None, str(mapping) if mapping else plan.problem_type))
        if mapping:  # string classes: replay the training mapping, never re-derive it on other frames
            add("target", lambda d, m=mapping: C.apply_target_codes(d, t, m) if t in d.columns else d)
        else:
            add("target", lambda d: C.encode_target(d, t, plan.problem_type)[0] if t in d.columns else d)

        _, done = C.log_transform(cur, [x for x in plan.skewed_columns if x in cur.columns], t)
        for x in done:
            log.append(("log", x, "log1p", None, ""))
        add("log1p", lambda d, done=done: d.withColumns({x: F.log1p(F.col(f"`{x}`").cast("double")) for x in done})
            if done else d)

        win = C.Winsorizer(exclude=[t, *onehot_cols, *[f"{x}_was_missing" for x in flagged]]).fit(cur)
        for r in win.clipped_counts(cur).where("n_clipped > 0").collect():
            log.append(("outliers", r["column"], "clip", r["n_clipped"], ""))
        add("clip", win.transform)
        add("bool_to_int", C.bool_to_int)

        if self.drop_duplicates:
            before = cur.count()
            add("duplicates", C.drop_duplicates)
            # the count, the last fill's statistics and the result all read the rows that are left: one shuffle of whole rows
            distinct = cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
            log.append(("duplicates", None, "duplicates", before - cur.count(), ""))
        if self.redundant_pairs:
            twins = [r["twin"] for r in C.redundant_pairs(cur, self.redundant_pairs).where("one_to_one").collect()]
            for x in twins:
                log.append(("redundant", x, "redundant", None, ""))
            add("redundant", lambda d, twins=twins: d.drop(*twins))
        fill_num = C.NumericImputer(flag_min=2.0, flag_max=2.0, drop_above=None).fit(cur)
        fill_cat = C.ModeImputer(exclude=[t] + text).fit(cur)
        add("final_fill", lambda d: C.bool_to_int(fill_cat.transform(fill_num.transform(d))).fillna(
            {x: 0 for x in numeric_cols(d)}))
        cleaned = cut_lineage(cur)  # reliable checkpoint in the shared folder
        if distinct is not None:
            distinct.unpersist()
        base.unpersist()
        return fc, cleaned

    def _fit_encoders(self, df: DataFrame, cats: list[str]):
        """Fit ordinal / frequency / one-hot encoders for ``cats`` once; return the replay function."""
        enc = self.plan.encoding
        ordinal = {x: enc[x]["order"] for x in cats if enc.get(x, {}).get("kind") == "ordinal"}
        rest = [x for x in cats if x not in ordinal]
        levels = level_counts(df, rest, K.ONEHOT_MAX_LEVELS)
        freq = [x for x in rest if levels[x] > K.ONEHOT_MAX_LEVELS]
        onehot = [x for x in rest if x not in freq]
        fe = C.FrequencyEncoder(cols=freq).fit(df)
        oh = C.OneHot(cols=onehot, drop_first=True).fit(df)
        return lambda d: oh.transform(fe.transform(C.ordinal_encode(d, ordinal)))


@dataclass
class Featurizer:
    """D2 -> D3 -> D5 -> D7 -> D10 -> D12 -> D13 -> D18 -> D19, with the D20 report and H2 gate."""
    plan: Plan
    max_features: int = 20

    def fit(self, df: DataFrame) -> tuple[list, DataFrame, DataFrame]:
        t, plan = self.plan.target, self.plan
        steps = []
        cur = df
        n_before = len(df.columns)
        for x in [x for x in plan.text_columns if x in cur.columns]:
            tf = FE.TfidfFeatures(col=x, max_features=self.max_features).fit(cur)
            steps.append(tf.transform)
            cur = tf.transform(cur)
        if plan.prune_correlated:
            cur, dropped = FE.prune_correlated(cur, t)
            steps.append(lambda d, dropped=dropped: d.drop(*dropped))
        flagged = []
        if plan.missing_flags:  # one aggregate over all columns
            open_ = [x for x in numeric_cols(cur) if x != t and f"{x}_was_missing" not in cur.columns]
            row = cur.agg(*[F.max(F.col(f"`{x}`").isNull()).alias(f"m{i}") for i, x in enumerate(open_)]).first() if open_ else ()
            flagged = [x for i, x in enumerate(open_) if row[f"m{i}"]]
        if flagged:
            steps.append(lambda d, cols=flagged: FE.missing_flags(d, cols))
            cur = FE.missing_flags(cur, flagged)
        if plan.log_transform:
            cur, done = C.log_transform(cur, [x for x in plan.skewed_columns if x in cur.columns], t, min_skew=K.LOG_SKEW)
            steps.append(lambda d, done=done: d.withColumns({x: F.log1p(F.col(f"`{x}`")) for x in done}) if done else d)
        if plan.interactions:
            prods = FE.interaction_pairs(cur, t)
            steps.append(lambda d, p=prods: FE.apply_products(d, p))
            cur = FE.apply_products(cur, prods)
        if plan.polynomial:
            prods = FE.polynomial_pairs(cur, t)
            steps.append(lambda d, p=prods: FE.apply_products(d, p))
            cur = FE.apply_products(cur, prods)
        if plan.bins:
            qb = FE.QuantileBins(cols=[x for x in plan.skewed_columns if x in cur.columns]).fit(cur)
            steps.append(qb.transform)
            cur = qb.transform(cur)
        _, todo = FE.encode_remaining(cur, t)
        fenc = C.FrequencyEncoder(cols=todo).fit(cur)
        steps.append(fenc.transform)
        cur = fenc.transform(cur)
        nums = [x for x in numeric_cols(cur) if x != t]
        no_inf = lambda d: d.withColumns({x: FE.inf_to_null(F.col(f"`{x}`")) for x in nums if x in d.columns})
        med = C.NumericImputer(flag_min=2.0, flag_max=2.0, drop_above=None, cols=nums).fit(no_inf(cur))
        sanitize = lambda d: med.transform(no_inf(d)).fillna({x: 0 for x in nums if x in d.columns}).fillna(
            {x: "unknown" for x in string_cols(d) if x != t})
        steps.append(sanitize)
        cur = cut_lineage(sanitize(cur))
        return FittedFeaturizer(steps), cur, FE.feature_report(df, cur, t), H.gate_features(cur, t, n_before)


@dataclass
class FittedFeaturizer:
    """Fitted feature steps, replayed in order on other frames (test rows, streams)."""
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for fn in self.steps:
            df = fn(df)
        return df


def rebalanced(train: DataFrame, t: str, strategy: str, key: Sequence[str] | str | None = None) -> tuple[DataFrame, str | None]:
    """The plan's imbalance strategy on training rows: (rows, weight column or None). SMOTE rows get weights too, as do
    rows where the threshold is tuned; synthetic rows have no key."""
    from ..operators import models as M
    from ..operators import split as E
    if strategy == "none":
        return train, None
    if strategy == "smote_plus_class_weight":
        aside = {t, *M.key_columns(key)}
        train = E.smote(train, t, [x for x in numeric_cols(train) if x not in aside])
    return E.class_weights(train, t, col="__weight"), "__weight"


def model_stage(train: DataFrame, test: DataFrame, t: str, plan: Plan, key: Sequence[str] | str | None = None,
                candidates: Sequence[str] | None = None, n_iter: int = K.TUNE_DRAWS, folds: int = K.TUNE_FOLDS, grids: dict | None = None,
                path: str | None = None) -> dict:
    """Scout -> best two -> train with the imbalance plan -> tune the better one -> threshold on a validation part ->
    cross-validate -> importance -> save -> H3 gate. Test rows are used for the final metrics alone."""
    from ..operators import metrics as G
    from ..operators import models as M
    from ..operators import split as E
    ptype, spark = plan.problem_type, train.sparkSession
    binary = ptype == "binary_classification"
    strat = t if ptype != "regression" else None
    ranking = M.scout(train, t, ptype, None if ptype == "regression" else plan.metric, candidates=candidates or plan.models, key=key)
    fit_rows, valid = E.train_test_split(train, strat, stratify=strat is not None, key=key)
    rows, weight = rebalanced(fit_rows, t, plan.imbalance_strategy, key) if strat else (fit_rows, None)
    rows = cut_lineage(rows)
    aside = [*M.key_columns(key), *([weight] if weight else [])]
    best, compared = M.train_and_select(rows, valid, t, M.top_two(ranking), ptype, plan.metric, weight=weight, exclude=aside)
    params, search = M.tune(train, t, best.name, ptype, n_iter, folds, plan.metric, grid=(grids or {}).get(best.name), key=key)
    model = M.model_pipeline(rows, t, best.name, ptype, params, weight, exclude=aside).fit(rows)
    threshold = 0.5
    if binary:
        threshold = G.best_threshold(G.threshold_sweep(M.predictions(model, valid, t), positive=1.0))
    cv = M.cross_validate(train, t, best.name, ptype, folds, plan.metric, params, key=key)
    metrics = M.evaluate(model, test, t, ptype, threshold if binary else None)
    path = M.save_pipeline(model, path or shared_path(spark, "modelled"), threshold)
    return {"ranking": ranking, "comparison": compared, "search": search, "best": best.name, "params": params, "threshold": threshold,
            "cv": G.fold_summary(cv), "metrics": metrics, "importance": M.feature_importance(model), "path": path,
            "gate_model": H.gate_model(spark, metrics, ptype, path, path)}


def run_all(df: DataFrame, t: str, ordinals: dict | None = None, test: float = 0.2, models: Sequence[str] | None = None,
            key: Sequence[str] | str | None = None, **modelling) -> dict:
    """Split -> profile and plan on train -> clean -> features -> model stage -> gates. Everything is fitted on train and
    replayed on test; the split key stays out of cleaning, features and models."""
    from ..operators import models as M
    from ..operators import split as E
    from .rules import detect_problem_type
    strat = detect_problem_type(df, t).first()["problem_type"] != "regression"
    train, test_df = E.train_test_split(df, t if strat else None, test, stratify=strat, key=key)
    aside = M.key_columns(key)
    plan = build_plan(train.drop(*aside), t, ordinals)
    cleaner, clean_train = Cleaner(plan).fit(train.drop(*aside))
    clean_test = cleaner.transform(test_df.drop(*aside))
    gate_c = H.gate_cleaned(clean_train, t)
    feat = Featurizer(plan)
    featurizer, feat_train, report, gate_f = feat.fit(clean_train)
    feat_test = featurizer.transform(clean_test).select(*feat_train.columns)  # the same fitted steps, replayed on test rows
    done = model_stage(feat_train, feat_test, t, plan, candidates=models, **modelling)
    return {"plan": plan, "cleaning_log": cleaner.log(df.sparkSession), "gate_cleaned": gate_c,
            "feature_report": report, "gate_features": gate_f, **done}
