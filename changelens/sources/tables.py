"""Tables of other kinds read as changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_as_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits by the customer's nation, their lines change parts' files."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "part", "customer", "nation")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/p"), (F.col("p_partkey") % 40).cast("string"), F.lit(".rs"))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("rev"), F.col("n_name").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        path.alias("entity"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"),
    )


def events_as_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user in an hour are a commit."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int") % 20
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd'T'HH")).alias("rev"), F.concat(F.lit("u"), (F.col("user_id") % 23).cast("string")).alias("author"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat("event_type", F.lit("/k"), k.cast("string"), F.lit(".rs")).alias("entity"),
        F.floor("value").cast("long").alias("added"), F.lit(1).cast("long").alias("deleted"),
    )
