"""The given tables as procurement tables, and the same views in SQL for the oracles.

A line of an order is a bid: the order is the tender, (order, line) the lot, the supplier the bidder, the
customer the buyer. Lots repeat, and so may (lot, bidder): one row per (lot, bidder) is kept, a win if any
of its lines wins, with the highest price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.common import materialize, small_partitions, table


def without_part(line: DataFrame, part: DataFrame) -> DataFrame:
    """``line`` as an inner join with ``part`` leaves it, without a column of it: the few part numbers that no part has are looked up
    first, so that no line moves."""
    line = line.where(F.col("l_partkey").isNotNull())
    unknown = materialize(line.select("l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"), "unknown-parts")
    return line if unknown.isEmpty() else line.join(unknown, "l_partkey", "left_anti")


def raw_contracts(spark: SparkSession, sf_dir: str, cpvs: bool = True) -> DataFrame:
    """One row a lot and bidder; without ``cpvs`` there is no ``tender_cpvs``, and lines move once less.

    Buyers meet the orders, which are fewer than the lines; lines meet the orders by order, where they are grouped, and names come last.
    """
    small_partitions(spark, sf_dir, "lineitem", "orders")
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    nation, part = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    bought = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    lines = line.join(part, line["l_partkey"] == part["p_partkey"]) if cpvs else without_part(line, part)
    grouped = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(
        F.max("o_custkey").cast("string").alias("buyer_masterid"),
        F.max("n_name").alias("buyer_country"),
        F.bool_or(F.col("l_returnflag") != "R").alias("bid_iswinning"),
        F.max("l_extendedprice").alias("bid_price"),
        F.max("o_totalprice").alias("estimate"),
        *([F.max("p_type").alias("tender_cpvs")] if cpvs else []),
        F.max("o_orderdate").alias("call_date"),
        F.max("l_shipdate").alias("deadline"),
    )
    names = supplier.groupBy("s_suppkey").agg(F.max("s_name").alias("bidder_name"))
    return grouped.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").cast("string").alias("tender_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("lot_id"),
        F.col("l_suppkey").cast("string").alias("bidder_masterid"),
        "bidder_name",
        *[c for c in grouped.columns if not c.startswith("l_")],
        F.year("call_date").alias("publish_year"),
    )


RAW_SQL = """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS tender_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS lot_id,
         CAST(l_suppkey AS VARCHAR) AS bidder_masterid, max(s_name) AS bidder_name, CAST(max(o_custkey) AS VARCHAR) AS buyer_masterid,
         max(n_name) AS buyer_country, bool_or(l_returnflag <> 'R') AS bid_iswinning, max(l_extendedprice) AS bid_price,
         max(o_totalprice) AS estimate, max(p_type) AS tender_cpvs, max(o_orderdate) AS call_date, max(l_shipdate) AS deadline,
         CAST(year(max(o_orderdate)) AS INTEGER) AS publish_year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey, l_linenumber, l_suppkey
)"""
