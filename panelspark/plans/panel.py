"""The person-year panel that the registered queries work on, derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL_SQL = """
select o.o_orderkey as sid, c.c_custkey as customer_id, cast(year(o.o_orderdate) as int) as year,
  case when o.o_orderstatus = 'F' then 1 else 0 end as y,
  case when o.o_orderstatus = 'F' and o.o_orderpriority = '1-URGENT' then 1 else 0 end as y_rare,
  o.o_orderpriority as cat_priority,
  case when o.o_orderkey % 13 = 0 then null else c.c_mktsegment end as cat_segment,
  n.n_name as cat_nation,
  c.c_nationkey % 10 as low_card_int,
  c.c_acctbal > 0 as is_active,
  case when o.o_orderkey % 11 = 0 then null when o.o_orderkey % 2 = 0 then 1 else 0 end as flag,
  o.o_totalprice as price, c.c_acctbal as balance, l.n_lines as n_lines, l.qty as qty,
  case when o.o_orderkey % 97 = 0 then cast('NaN' as double)
       when o.o_orderkey % 89 = 0 then cast('Infinity' as double)
       when o.o_orderkey % 83 = 0 then cast('-Infinity' as double)
       else o.o_totalprice / 1000.0 end as dirty,
  cast(7.0 as double) as constant,
  round(o.o_totalprice / 5000) / 110.0 as p1
from {orders} o
join {customer} c on c.c_custkey = o.o_custkey
join {nation} n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, count(*) as n_lines, sum(l_quantity) as qty from {lineitem} group by l_orderkey) l
  on l.l_orderkey = o.o_orderkey
"""
TABLES = ("orders", "customer", "nation", "lineitem")
ORACLE_PANEL = PANEL_SQL.format(**{t: t for t in TABLES})

TRAIN, VALID, TEST = (1995, 1999), (1999, 2000), (2000, 2002)
KEYS = ["sid"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PANEL_SQL, **{t: table(spark, sf_dir, t) for t in TABLES})


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).where((F.col("year") >= TRAIN[0]) & (F.col("year") < TRAIN[1]))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the orders that have lines; the others have none."""
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left_semi")
    return orders.select(F.col("o_orderkey").alias("sid"), (F.round(F.col("o_totalprice") / 5000) / 110.0).alias("score"))
