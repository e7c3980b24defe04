"""Receipts derived from the driver's tables: a receipt an order, an item a lineitem, printed as text.

SQL states the same values directly, so a query that reads them back from the text is checked against what was printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as t
from ..operators import synth

SHOPS = [s for shops in fixed.SHOPS.values() for s in shops]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers repeat in an order: a line's place is its own, by number, price and part."""
    d = table(spark, sf_dir, "lineitem")
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey"))
    return d.select(F.col("l_orderkey").alias("k"), line.alias("line"), F.floor("l_extendedprice").cast("bigint").alias("yen"), F.when(F.col("l_tax") < 0.05, 8).otherwise(10).alias("rate"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, total, a8, a10, t8, t10 (taxes inside), deposit, change: one aggregation, one shuffle."""
    of = lambda r: F.coalesce(F.sum(F.when(F.col("rate") == r, F.col("yen"))), F.lit(0)).cast("bigint").alias(f"a{r}")
    d = items(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.sum("yen").alias("total"), of(8), of(10))
    d = d.withColumns({f"t{r}": synth.tax_inside(F.col(f"a{r}"), F.lit(r)) for r in (8, 10)})
    d = d.withColumn("deposit", synth.deposit(F.col("total"), F.lit(1000)))
    return d.withColumn("change", F.col("deposit") - F.col("total"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, text of every order with items.  The narrow orders meet their customers first, so that the last deal is by k."""
    k = F.col("k")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    places = orders.join(customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    d = amounts(spark, sf_dir).join(places.select("k", "day", "n_name"), "k")
    cash, hidden = k % 3 != 0, (k % 5 == 4) & (k % 3 != 0)
    label = F.when(k % 3 == 0, "合計 ").when(k % 3 == 1, "合 計 ").otherwise("合計金額 ")
    rated = lambda r: F.when((k % 2 == 0) & (F.col(f"a{r}") > 0), F.concat(F.lit(f"消費税等({r}%) "), t.yen(F.col(f"t{r}"))))
    parts = [
        F.element_at(F.array(*map(F.lit, SHOPS)), (k % len(SHOPS) + 1).cast("int")),
        F.concat(F.replace(F.col("n_name"), F.lit("_"), F.lit("")), F.lit("店")),
        F.concat(synth.date_text(F.col("day"), k % 4), F.lit(" "), synth.time_text((k % 14 + 8).cast("int"), (k % 60).cast("int"), k % 10 < 3)),
        F.when(k % 9 != 0, F.concat(F.lit("登録番号 T"), F.lpad(k.cast("string"), 13, "0"))),
        F.concat(F.lit("点数 "), F.col("n"), F.lit("個")),
        F.when(~hidden, F.concat(label, t.yen(F.col("total")))),
        rated(8), rated(10),
        F.when(k % 2 == 1, F.concat(F.lit("(内消費税等 "), t.yen(F.col("t8") + F.col("t10"), comma=False), F.lit(")"))),
        F.when(cash, F.concat(F.when(k % 2 == 0, "お預り ").otherwise("お預り合計 "), t.yen(F.col("deposit")))),
        F.when(cash, F.concat(F.when(k % 2 == 0, "お釣り ").otherwise("お 釣 "), t.yen(F.col("change")))),
    ]
    return d.select("k", synth.receipt_text(parts).alias("text"))


def misread(receipts: DataFrame) -> DataFrame:
    """rendered() as a poor reading gives it, by k: wide digits and signs; a wrong letter in the brand; brand and branch on one
    line with a wrong letter, and misread labels; or another shop's name in capitals.  NAMED tells the last."""
    k, x = F.col("k"), F.col("text")
    wide = F.translate(x, "0123456789¥,/:()", "０１２３４５６７８９￥，／：（）")
    wrong = F.regexp_replace(x, "^(.).", "$1◇")
    labels = F.replace(F.replace(x, F.lit("合計"), F.lit("合十")), F.lit("額"), F.lit("额"))
    joined = F.regexp_replace(labels, r"^(.).([^\n]*)\n", "$1◇$2")
    capitals = F.regexp_replace(x, r"^[^\n]*", "TAKARA")
    return receipts.withColumn("text", F.when((k % 4 == 0) & (k % 7 == 6), capitals).when(k % 4 == 1, wide).when(k % 4 == 2, wrong).when(k % 4 == 3, joined).otherwise(x))


#: i: items; r: amounts; f: all fields that a text prints.
SQL = f"""
WITH i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS line, floor(l_extendedprice)::BIGINT AS yen, CASE WHEN l_tax < 0.05 THEN 8 ELSE 10 END AS rate FROM lineitem),
a AS (SELECT k, count(*) AS n, sum(yen)::BIGINT AS total, coalesce(sum(yen) FILTER (rate = 8), 0)::BIGINT AS a8, coalesce(sum(yen) FILTER (rate = 10), 0)::BIGINT AS a10 FROM i GROUP BY k),
r AS (SELECT *, a8 * 8 // 108 AS t8, a10 * 10 // 110 AS t10, (total + 999) // 1000 * 1000 AS deposit, (total + 999) // 1000 * 1000 - total AS change FROM a),
f AS (SELECT r.k, ([{", ".join(f"'{s}'" for s in SHOPS)}])[r.k % {len(SHOPS)} + 1] AS store_brand, replace(n_name, '_', '') || '店' AS store_branch,
        CASE WHEN r.k % 9 <> 0 THEN 'T' || lpad(r.k::VARCHAR, 13, '0') END AS registration_number,
        (CASE WHEN r.k % 4 = 3 THEN 2000 + year(o_orderdate) % 100 ELSE year(o_orderdate) END)::VARCHAR || strftime(o_orderdate, '-%m-%d') AS date,
        lpad((r.k % 14 + 8)::VARCHAR, 2, '0') || ':' || lpad((r.k % 60)::VARCHAR, 2, '0') AS time,
        total, t8 + t10 AS tax, CASE WHEN r.k % 3 <> 0 THEN deposit END AS deposit, CASE WHEN r.k % 3 <> 0 THEN change END AS change
      FROM r JOIN orders ON r.k = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
#: The brand that misread() leaves.
NAMED = "CASE WHEN k % 4 = 0 AND k % 7 = 6 THEN 'TAKARA' ELSE store_brand END AS store_brand"
