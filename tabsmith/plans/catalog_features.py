"""Registered queries for feature engineering (D), with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as FE
from ..operators import profile as P
from . import frames as FR

Q: dict = {}
SQL: dict = {}


def reg(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


D = FR.DIRTY_LINEITEM_SQL
DF = FR.DOC_FEATURES_SQL
PL = FR.PRICED_LINEITEM_SQL


#: Spark ML's English stop words, which the operator loads from its session; here for the SQL text alone (no file is
#: read on import). tests/test_plans.py compares the two lists.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


# ----------------------------------------------------------------------------- D1, D2

@reg("d01_feature_columns", f"""
SELECT column_name AS feature, CASE WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS role
FROM (DESCRIBE {FR.DOC_FEATURES_SQL}) WHERE column_name <> 'quality'
""")
def d01(spark, d):
    df = FR.doc_features(spark, d)
    roles = FE.feature_columns(df, "quality")
    rows = [(x, role) for role, xs in roles.items() for x in xs]
    return spark.createDataFrame(rows, "feature string, role string")


@reg("d02_datetime_parts", """
SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year,
       CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, CAST(day(l_shipdate) AS INTEGER) AS l_shipdate_day,
       CAST(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_dayofweek,
       CAST(isodow(l_shipdate) - 1 >= 5 AS INTEGER) AS l_shipdate_is_weekend
FROM lineitem
""")
def d02(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return C.expand_datetime(li, ["l_shipdate"])


# ----------------------------------------------------------------------------- D3, D4

TFIDF_SQL = f"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{FE.TOKEN_PATTERN.replace('p{L}', 'pL').replace('p{N}', 'pN')}')) AS term
             FROM documents),
     kept AS (SELECT * FROM tok WHERE term NOT IN ({STOPS})),
     tf AS (SELECT doc_id, term, count(*) AS c FROM kept GROUP BY doc_id, term),
     stats AS (SELECT term, count(*) AS dfreq, sum(c) AS total FROM tf GROUP BY term HAVING count(*) >= 2),
     vocab AS (SELECT term, dfreq FROM stats ORDER BY total DESC, term LIMIT 20),
     w AS (SELECT tf.doc_id, tf.term,
                  tf.c * (ln((1 + (SELECT count(*) FROM documents)) / (1 + vocab.dfreq)) + 1) AS v
           FROM tf JOIN vocab ON tf.term = vocab.term),
     z AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, ROUND(w.v / z.norm, 6) AS weight FROM w JOIN z ON w.doc_id = z.doc_id
"""


@reg("d03_tfidf", TFIDF_SQL)
def d03(spark, d):
    docs = FR.table(spark, d, "documents").select("doc_id", "text")
    tf = FE.TfidfFeatures(col="text", key="doc_id").fit(docs)
    return tf.transform_long(docs, "doc_id").withColumn("weight", F.round("weight", 6))


@reg("d04_text_frequency_fallback", """
SELECT doc_id, ROUND(count(*) OVER (PARTITION BY text) / count(*) OVER (), 6) AS text FROM documents
""")
def d04(spark, d):
    docs = FR.table(spark, d, "documents").select("doc_id", "text")
    return C.FrequencyEncoder(cols=["text"]).fit(docs).transform(docs).withColumn("text", F.round("text", 6))


# ----------------------------------------------------------------------------- D5, D6

_DF_NUM = ["n_chars", "text_len", "n_words", "n_lines", "n_periods", "toxic"]


def _pairs_sql(frame: str, cols: list[str], t: str, limit: float) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ({frame})"
        for i, a in enumerate(cols) for b in cols[i + 1:])
    tr = " UNION ALL ".join(f"SELECT '{x}' AS col, abs(corr({x}, {t})) AS tr FROM ({frame})" for x in cols)
    return f"""
WITH p AS ({pairs}), t AS ({tr})
SELECT p.a, p.b, ROUND(p.r, 6) AS r, ROUND(ta.tr, 6) AS a_target_r, ROUND(tb.tr, 6) AS b_target_r
FROM p JOIN t ta ON ta.col = p.a JOIN t tb ON tb.col = p.b WHERE abs(p.r) > {limit}
"""


@reg("d05_collinear_pairs", _pairs_sql(DF, _DF_NUM, "quality", 0.95))
def d05(spark, d):
    df = FR.doc_features(spark, d)
    out = FE.collinear_pairs(df, "quality", _DF_NUM, 0.95)
    return out.select("a", "b", *[F.round(x, 6).alias(x) for x in ["r", "a_target_r", "b_target_r"]])


def _greedy_sql(frame: str, cols: list[str], t: str, limit: float) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS apos, {j} AS bpos, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, "
        f"coalesce(abs(corr({a}, {t})), 0) AS ta, coalesce(abs(corr({b}, {t})), 0) AS tb FROM ({frame})"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i)
    return f"""
WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY apos, bpos) AS k, a, b, ta, tb
                     FROM ({pairs}) WHERE abs(r) > {limit}),
     walk(k, dropped) AS (
       SELECT 0, CAST([] AS VARCHAR[])
       UNION ALL
       SELECT w.k + 1,
              CASE WHEN list_contains(w.dropped, p.a) OR list_contains(w.dropped, p.b) THEN w.dropped
                   ELSE list_append(w.dropped, CASE WHEN p.ta < p.tb THEN p.a ELSE p.b END) END
       FROM walk w JOIN p ON p.k = w.k + 1)
SELECT unnest(dropped) AS dropped FROM walk WHERE k = (SELECT count(*) FROM p)
"""


@reg("d05_prune_greedy", _greedy_sql(DF, _DF_NUM, "quality", 0.95))
def d05g(spark, d):
    df = FR.doc_features(spark, d)
    _, dropped = FE.prune_correlated(df, "quality", _DF_NUM, 0.95)
    return spark.createDataFrame([(x,) for x in dropped], "dropped string")


def _upper_half_sql(frame: str, cols: list[str], limit: float) -> str:
    pairs = " UNION ALL ".join(f"SELECT '{b}' AS b, {j} AS pos, abs(corr({a}, {b})) AS r FROM ({frame})"
                               for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i)
    return f"""
WITH p AS ({pairs}),
     flagged AS (SELECT b, min(pos) AS pos FROM p WHERE r > {limit} GROUP BY b),
     ranked AS (SELECT b, row_number() OVER (ORDER BY pos) AS rn, count(*) OVER () AS n FROM flagged)
SELECT b AS dropped FROM ranked WHERE rn <= n // 2 + 1
"""


@reg("d06_prune_upper_half", _upper_half_sql(DF, _DF_NUM, 0.92))
def d06(spark, d):
    df = FR.doc_features(spark, d)
    _, dropped = FE.prune_correlated(df, "quality", _DF_NUM, 0.92, mode="upper_half")
    return spark.createDataFrame([(x,) for x in dropped], "dropped string")


# ----------------------------------------------------------------------------- D7, D8, D9

@reg("d07_log_recheck", """
SELECT event_id,
       ROUND(CASE WHEN (SELECT min(value) >= 0 AND skewness(value) > 1.0 FROM events) THEN ln(1 + value)
                  ELSE value END, 6) AS value,
       ROUND(CASE WHEN (SELECT min(user_id) >= 0 AND skewness(user_id) > 1.0 FROM events) THEN ln(1 + user_id)
                  ELSE user_id END, 6) AS user_id
FROM events
""")
def d07(spark, d):
    ev = FR.table(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double"))
    out, _ = C.log_transform(ev, ["value", "user_id"], min_skew=1.0)
    return out.withColumn("value", F.round("value", 6)).withColumn("user_id", F.round("user_id", 6))


@reg("d08_log_features", f"""
SELECT doc_id, ROUND(ln(1 + n_chars), 6) AS log_n_chars, ROUND(ln(1 + text_len), 6) AS log_text_len,
       ROUND(ln(1 + n_words), 6) AS log_n_words
FROM ({DF})
""")
def d08(spark, d):
    df = FR.doc_features(spark, d).select("doc_id", "n_chars", "text_len", "n_words")
    out, made = FE.log_features(df, ["n_chars", "text_len", "n_words"])
    return out.select("doc_id", *[F.round(f"log_{x}", 6).alias(f"log_{x}") for x in made])


@reg("d08_log_features_made", f"""
SELECT col AS feature FROM (
  SELECT 'n_chars' AS col, skewness(n_chars) AS s, min(n_chars) AS m FROM ({DF})
  UNION ALL SELECT 'text_len', skewness(text_len), min(text_len) FROM ({DF})
  UNION ALL SELECT 'n_words', skewness(n_words), min(n_words) FROM ({DF})
  UNION ALL SELECT 'n_periods', skewness(n_periods), min(n_periods) FROM ({DF})
  UNION ALL SELECT 'n_lines', skewness(n_lines), min(n_lines) FROM ({DF}))
WHERE s > 1.0 AND m > 0
""")
def d08m(spark, d):
    df = FR.doc_features(spark, d)
    _, made = FE.log_features(df, ["n_chars", "text_len", "n_words", "n_periods", "n_lines"])
    return spark.createDataFrame([(x,) for x in made], "feature string")


@reg("d09_missing_flags", f"""
SELECT l_orderkey, l_linenumber, CAST(l_quantity IS NULL AS INTEGER) AS l_quantity_was_missing,
       CAST(l_discount IS NULL AS INTEGER) AS l_discount_was_missing, CAST(l_tax IS NULL AS INTEGER) AS l_tax_was_missing
FROM ({D})
""")
def d09(spark, d):
    df = FR.dirty_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return FE.missing_flags(df, ["l_quantity", "l_discount", "l_tax"]).drop("l_quantity", "l_discount", "l_tax")


# ----------------------------------------------------------------------------- D10-D12

_PL_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _interaction_sql(min_r: float, k: int, pairs: str, poly: bool = False, frame: str = PL,
                     feats: list[str] = _PL_NUM, t: str = "net", rank: str = "r") -> str:
    cols = ", ".join(f"('{x}', {i})" for i, x in enumerate(feats))
    if poly:
        pair_rule = "a.rk <= b.rk"
        name = "CASE WHEN a.col = b.col THEN a.col || '_sq' ELSE a.col || '_x_' || b.col END"
    else:
        pair_rule = "a.rk < b.rk" if pairs == "all" else "a.rk = 1 AND b.rk > 1"
        name = "a.col || '_x_' || b.col"
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, {t} AS net, {", ".join(feats)} FROM ({frame})),
     long AS (SELECT rid, net, col, v FROM (UNPIVOT base ON {", ".join(feats)} INTO NAME col VALUE v)),
     pos AS (SELECT * FROM (VALUES {cols}) AS t(col, pos)),
     tr AS (SELECT long.col, abs(corr(v, net)) AS r, min(pos.pos) AS pos FROM long JOIN pos ON long.col = pos.col
            GROUP BY long.col),
     top AS (SELECT col, row_number() OVER (ORDER BY {rank} DESC, pos) AS rk FROM tr WHERE r > {min_r}
             QUALIFY rk <= {k}),
     pairs AS (SELECT a.col AS ca, b.col AS cb, {name} AS feature FROM top a JOIN top b ON {pair_rule})
SELECT feature, ROUND(corr(la.v * lb.v, la.net), 3) AS r
FROM pairs JOIN long la ON la.col = pairs.ca JOIN long lb ON lb.col = pairs.cb AND lb.rid = la.rid
GROUP BY feature
"""


def _new_feature_report(df, t, new):
    if not new:
        return df.sparkSession.createDataFrame([], "feature string, r double")
    corr = P.target_correlations(df, t, new, digits=3)
    return corr.select(F.col("column").alias("feature"), "r")


_DOC_NUM = ["text_len", "n_words", "n_lines", "n_periods", "quality", "toxic"]


@reg("d10_interactions", _interaction_sql(0.2, 3, "all", frame=DF, feats=_DOC_NUM, t="n_chars"))
def d10(spark, d):
    df = FR.doc_features(spark, d)
    out, new = FE.interactions(df, "n_chars", _DOC_NUM)
    return _new_feature_report(out, "n_chars", new)


@reg("d11_interactions_star", _interaction_sql(0.0, 3, "star"))
def d11(spark, d):
    df = FR.priced_lineitem(spark, d)
    out, new = FE.interactions(df, "net", _PL_NUM, min_r=0.0, pairs="star")
    return _new_feature_report(out, "net", new)


@reg("d12_polynomial_features", _interaction_sql(-1.0, 3, "all", poly=True))
def d12(spark, d):
    df = FR.priced_lineitem(spark, d)
    out, new = FE.polynomial_features(df, "net", _PL_NUM)
    return _new_feature_report(out, "net", new)


# ----------------------------------------------------------------------------- D13

@reg("d13_quantile_bins", """
WITH e AS (SELECT list_sort(list_distinct([quantile_cont(n_chars, 0.0), quantile_cont(n_chars, 0.2),
                                            quantile_cont(n_chars, 0.4), quantile_cont(n_chars, 0.6),
                                            quantile_cont(n_chars, 0.8), quantile_cont(n_chars, 1.0)])) AS edges
           FROM documents)
SELECT doc_id, CAST(greatest(0, len(list_filter((SELECT edges FROM e), lambda x: x < n_chars)) - 1) AS INTEGER)
       AS n_chars_bin
FROM documents
WHERE (SELECT skewness(n_chars) FROM documents) > 2.0
""")
def d13(spark, d):
    docs = FR.table(spark, d, "documents").select("doc_id", "n_chars")
    return FE.QuantileBins(cols=["n_chars"]).fit(docs).transform(docs).drop("n_chars")


# ----------------------------------------------------------------------------- D14-D17

@reg("d14_17_arithmetic_features", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount + 1 = 0 THEN NULL ELSE l_extendedprice / (l_discount + 1) END AS price_per_discount,
       l_quantity * l_quantity AS quantity_squared,
       l_quantity + l_discount + l_tax AS qty_disc_tax,
       l_extendedprice * CAST(l_returnflag = 'R' AS INTEGER) AS price_if_returned
FROM lineitem
""")
def d14(spark, d):
    li = FR.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                               "l_quantity", "l_tax",
                                               (F.col("l_returnflag") == "R").cast("int").alias("is_returned"))
    out = FE.ratio_feature(li, "l_extendedprice", "l_discount", "price_per_discount")
    out = FE.square_feature(out, "l_quantity", "quantity_squared")
    out = FE.row_sum(out, ["l_quantity", "l_discount", "l_tax"], "qty_disc_tax")
    out = FE.product_feature(out, "l_extendedprice", "is_returned", "price_if_returned")
    return out.select("l_orderkey", "l_linenumber", "price_per_discount", "quantity_squared", "qty_disc_tax",
                      "price_if_returned")


# ----------------------------------------------------------------------------- D18, D19

@reg("d18_encode_remaining", """
SELECT p_partkey, p_size,
       ROUND(count(*) OVER (PARTITION BY p_name) / count(*) OVER (), 6) AS p_name,
       ROUND(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS p_brand,
       p_type
FROM part
""")
def d18(spark, d):
    p = FR.table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    out, done = FE.encode_remaining(p)
    return out.withColumns({x: F.round(x, 6) for x in done})


@reg("d18_encoded_columns", """
SELECT col AS "column" FROM (SELECT 'p_name' AS col, count(DISTINCT p_name) AS n FROM part
                             UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
                             UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE n > 10
""")
def d18c(spark, d):
    p = FR.table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand", "p_type")
    _, done = FE.encode_remaining(p)
    return spark.createDataFrame([(x,) for x in done], "column string")


_INF_FRAME = """
SELECT event_id, CASE WHEN value > 20 THEN CAST('inf' AS DOUBLE) WHEN value < 0.5 THEN CAST('-inf' AS DOUBLE)
                      WHEN event_type = 'view' THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type
FROM events
"""


@reg("d19_sanitize", f"""
WITH f AS ({_INF_FRAME}),
     m AS (SELECT quantile_cont(CASE WHEN abs(value) = CAST('inf' AS DOUBLE) THEN NULL ELSE value END, 0.5) AS med
           FROM f)
SELECT event_id,
       ROUND(COALESCE(CASE WHEN abs(value) = CAST('inf' AS DOUBLE) THEN NULL ELSE value END, (SELECT med FROM m), 0), 6)
         AS value,
       COALESCE(event_type, 'unknown') AS event_type
FROM f
""")
def d19(spark, d):
    ev = FR.table(spark, d, "events")
    v = F.col("value")
    df = ev.select("event_id",
                   F.when(v > 20, F.lit(float("inf"))).when(v < 0.5, F.lit(float("-inf")))
                   .when(F.col("event_type") == "view", F.lit(None)).otherwise(v).alias("value"),
                   F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("event_type"))
    return FE.sanitize(df, t=None).withColumn("value", F.round("value", 6))


# ----------------------------------------------------------------------------- D20

_REPORT_OLD = ["toxic", "n_chars", "text_len", "n_words", "n_lines", "n_periods"]
_REPORT_LOGS = ["log_n_chars", "log_text_len", "log_n_words"]
_REPORT_FRAME = f"SELECT *, {', '.join(f'ln(1 + {x[4:]}) AS {x}' for x in _REPORT_LOGS)} FROM ({DF})"
_REPORT_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS feature, {str(x in _REPORT_LOGS).lower()} AS is_new, ROUND(corr({x}, quality), 3) AS target_r "
                                  f"FROM ({_REPORT_FRAME})" for x in _REPORT_OLD + _REPORT_LOGS)


@reg("d20_feature_report", f"""
SELECT feature, is_new, CASE WHEN NOT isnan(target_r) THEN target_r + 0.0 END AS target_r FROM ({_REPORT_ROWS}
  UNION ALL SELECT feature, true, r FROM (
    {_interaction_sql(0.0, 3, "all", frame=_REPORT_FRAME, feats=_REPORT_OLD + _REPORT_LOGS, t="quality", rank="ROUND(r, 9)")}))
""")
def d20(spark, d):
    before = FR.doc_features(spark, d).drop("lang", "source", "doc_id")
    after, _ = FE.log_features(before, ["n_chars", "text_len", "n_words"], t="quality")
    after, _ = FE.interactions(after, "quality", min_r=0.0)
    return FE.feature_report(before, after, "quality")
