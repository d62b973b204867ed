"""Input frames built from the provided tables, in Spark and as DuckDB SQL.

The provided tables hold no nulls, so the cleaning frames inject missing
values, sentinels and numeric strings with value-based rules that both
engines evaluate identically (no row positions, no sampling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------- labelled documents

def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels: binary, imbalanced targets ``quality`` and ``toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


LABELLED_DOCS_SQL = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric view of the labelled documents (lengths, word and line counts)."""
    d = labelled_docs(spark, sf_dir)
    return d.select(
        "doc_id", "quality", "toxic", "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.length("text").cast("double").alias("text_len"),
        (F.size(F.split("text", " ")) * 1.0).alias("n_words"),
        (F.size(F.split("text", "\n")) * 1.0).alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[.]", ""))).cast("double").alias("n_periods"),
    )


DOC_FEATURES_SQL = f"""
SELECT doc_id, quality, toxic, lang, source,
       CAST(n_chars AS DOUBLE) AS n_chars,
       CAST(length(text) AS DOUBLE) AS text_len,
       CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
       CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines,
       CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS n_periods
FROM ({LABELLED_DOCS_SQL})
"""


# ----------------------------------------------------------------------------- dirty lineitem

def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values in every null band, sentinels and a numeric-text column.

    l_quantity  NULL on line 7          (~14 %: flag + median)
    l_discount  NULL where 0.0          (~5 %:  median)
    l_tax       NULL on lines 6-7       (~29 %: dropped)
    l_comment_len NULL on lines 3-7     (~71 %: dropped as mostly missing)
    l_linestatus '?' on line 1          (string sentinel -> NULL -> mode)
    l_suppkey   999 on line 3           (numeric sentinel, > 5 % of rows)
    l_qty_text  quantity as text, 'n/a' on line 2 (~86 % parse -> cast)
    """
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_partkey",
        F.when(ln == 3, F.lit(999).cast("bigint")).otherwise(F.col("l_suppkey")).alias("l_suppkey"),
        "l_linenumber",
        F.when(ln == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_discount") == 0.0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(ln >= 6, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(ln >= 3, F.lit(None)).otherwise(F.col("l_quantity") * 2).alias("l_comment_len"),
        "l_returnflag",
        F.when(ln == 1, F.lit("?")).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.when(ln == 2, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("l_qty_text"),
        "l_shipdate",
    )


DIRTY_LINEITEM_SQL = """
SELECT l_orderkey, l_partkey,
       CASE WHEN l_linenumber = 3 THEN CAST(999 AS BIGINT) ELSE l_suppkey END AS l_suppkey,
       l_linenumber,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity,
       l_extendedprice,
       CASE WHEN l_discount = 0.0 THEN NULL ELSE l_discount END AS l_discount,
       CASE WHEN l_linenumber >= 6 THEN NULL ELSE l_tax END AS l_tax,
       CASE WHEN l_linenumber >= 3 THEN NULL ELSE l_quantity * 2 END AS l_comment_len,
       l_returnflag,
       CASE WHEN l_linenumber = 1 THEN '?' ELSE l_linestatus END AS l_linestatus,
       CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS l_qty_text,
       l_shipdate
FROM lineitem
"""


# ----------------------------------------------------------------------------- lineitem with a net price target

def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression frame: target ``net`` = price * (1 - discount) * (1 + tax)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net"),
    )


PRICED_LINEITEM_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net
FROM lineitem
"""


# ----------------------------------------------------------------------------- scored frames for metrics

def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with a deterministic score in (0,1) from a fixed logistic formula.

    The metric operators need (label, score, prediction) without a trained model, so
    that every engine can reproduce the score exactly.
    """
    d = doc_features(spark, sf_dir)
    z = (F.col("n_periods") / F.greatest(F.col("n_words"), F.lit(1.0))) * 10.0 - 1.0
    score = F.round(1.0 / (1.0 + F.exp(-z)), 4)
    return d.select("doc_id", F.col("quality").alias("label"), score.alias("score"),
                    (score >= 0.5).cast("int").alias("prediction"))


SCORED_DOCS_SQL = f"""
SELECT doc_id, quality AS label,
       ROUND(1.0 / (1.0 + exp(-((n_periods / greatest(n_words, 1.0)) * 10.0 - 1.0))), 4) AS score,
       CAST(ROUND(1.0 / (1.0 + exp(-((n_periods / greatest(n_words, 1.0)) * 10.0 - 1.0))), 4) >= 0.5 AS INTEGER)
         AS prediction
FROM ({DOC_FEATURES_SQL})
"""


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass labels (return flag codes) with a rule-based prediction, and a regression
    pair (net, a price-only estimate)."""
    li = priced_lineitem(spark, sf_dir)
    label = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")).cast("int") - 1
    pred = (F.when(F.col("l_linestatus") == "O", F.lit(1))
            .when(F.col("l_discount") >= 0.05, F.lit(0)).otherwise(F.lit(2)))
    return li.select("l_orderkey", "l_linenumber", label.alias("label"), pred.alias("prediction"),
                     F.col("net").alias("actual"), (F.col("l_extendedprice") * 0.95).alias("predicted"))


SCORED_LINEITEM_SQL = f"""
SELECT l_orderkey, l_linenumber,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS label,
       CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_discount >= 0.05 THEN 0 ELSE 2 END AS prediction,
       net AS actual, l_extendedprice * 0.95 AS predicted
FROM ({PRICED_LINEITEM_SQL})
"""
