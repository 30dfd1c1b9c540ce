"""Tables with missing cells, derived from the given complete ones by value.

Each has its SQL twin, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Pending orders have no price yet; a priority that is not specified is missing."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
    )


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Returned items have no price."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
    )


def customer(spark: SparkSession, folder: str) -> DataFrame:
    """A negative balance and the machinery segment count as not known."""
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The source is missing for German texts and blank for French ones."""
    return table(spark, folder, "documents").select(
        "doc_id", "lang", "n_chars",
        F.when(F.col("lang") == "de", F.lit(None)).when(F.col("lang") == "fr", F.lit("   "))
        .otherwise(F.col("source")).alias("src"),
    )


# The same tables in SQL, to be put after WITH.
ORDERS = """orders_d AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
  NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders)"""
LINEITEM = """lineitem_d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem)"""
CUSTOMER = """customer_d AS (SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal,
  NULLIF(c_mktsegment, 'MACHINERY') AS segment FROM customer)"""
DOCUMENTS = """documents_d AS (SELECT doc_id, lang, n_chars,
  CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '   ' ELSE source END AS src FROM documents)"""
