"""Panel tables from the star schema: prices, metadata, fundamentals, macro, market, earnings, insiders.

Sums are taken over decimals, so that they don't depend on their order, and become doubles once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 15
#: Order priorities standing in for macro series (fixed values).
SERIES = {"1-URGENT": "DGS10", "2-HIGH": "DGS2", "3-MEDIUM": "VIXCLS", "4-NOT SPECIFIED": "BAMLH0A0HYM2", "5-LOW": "NAPM"}


class Star:
    """The tables of one folder. ``by`` is 'supplier' or 'bucket' and sets what a ticker is."""

    def __init__(self, spark: SparkSession, path: str, by: str = "bucket"):
        self.spark, self.path, self.by = spark, path, by

    def stamp(self) -> tuple:
        """Names, lengths and times of what lies in the folder: other files, another stamp."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(hadoop)))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _ticker(self, col: str = "l_suppkey"):
        if self.by == "supplier":
            return F.concat(F.lit("S"), F.lpad(F.col(col).cast("string"), 5, "0"))
        return F.concat(F.lit("B"), F.lpad((F.col(col) % BUCKETS).cast("string"), 2, "0"))

    @staticmethod
    def _sum(expr, scale: int = 2):
        return F.sum(expr.cast(f"decimal(18,{scale})")).cast("double")

    def prices(self) -> DataFrame:
        """``date, ticker, adj_close, close, volume``: mean unit price and quantity of a day."""
        rows = self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date"), self._ticker().alias("ticker"))
        rows = rows.agg((self._sum(F.col("l_extendedprice")) / F.sum("l_quantity")).alias("adj_close"), F.sum("l_quantity").cast("long").alias("volume"))
        return rows.select("date", "ticker", "adj_close", F.col("adj_close").alias("close"), "volume")

    def metadata(self) -> DataFrame:
        """``ticker, sector, industry, shares_outstanding``."""
        supplier = self.table("supplier")
        if self.by == "bucket":
            b = (F.col("s_suppkey") % BUCKETS).alias("b")
            rows = supplier.select(b).distinct()
            return rows.select(F.concat(F.lit("B"), F.lpad(F.col("b").cast("string"), 2, "0")).alias("ticker"), F.concat(F.lit("G"), (F.col("b") % 5).cast("string")).alias("sector"), F.lit("bucket").alias("industry"), (1000.0 + 10 * F.col("b")).alias("shares_outstanding"))
        rows = supplier.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(self._ticker("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), (1000 + F.abs("s_acctbal")).alias("shares_outstanding"))

    def quarters(self) -> DataFrame:
        """A row for each ticker and quarter of the order date: sums of its lines, what statements and earnings are made of.

        Lines meet their orders in this one join; where they are many, it is the largest shuffle there is. A task of the join
        has lines of all suppliers, so sums taken there would have about a row for each line, several times its size: for
        suppliers the lines themselves go on, to one task for all of a supplier's quarter. Buckets are few, and summed first.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
        orders = self.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderstatus")
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.withColumns({"q": F.date_trunc("quarter", "day").cast("date"), "ticker": self._ticker()}).drop("l_orderkey", "o_orderkey", "l_suppkey")
        if self.by == "supplier":
            rows = rows.repartition("q", "ticker")
        price, when = F.col("l_extendedprice"), lambda c, v: F.when(F.col(c) == v, F.col("l_extendedprice"))
        return rows.groupBy("q", "ticker").agg(
            self._sum(F.col("o_totalprice")).alias("book_value"), self._sum(price * (1 - F.col("l_discount")), 4).alias("gross_profit"),
            self._sum(price).alias("total_assets"), self._sum(price * F.col("l_tax"), 4).alias("total_debt"),
            self._sum(when("o_orderstatus", "F")).alias("ebitda"), self._sum(when("l_returnflag", "N")).alias("operating_cash_flow"),
            self._sum(when("l_returnflag", "R")).alias("capital_expenditures"), self._sum(when("l_returnflag", "A")).alias("net_income"),
            F.min("day").alias("first"), F.sum("l_quantity").alias("quantity"))

    @staticmethod
    def fundamentals(quarters: DataFrame) -> DataFrame:
        """``date, ticker`` and statement fields by quarter-end of the order date."""
        return quarters.select(F.last_day(F.add_months("q", 2)).alias("date"), "ticker", "book_value", "gross_profit", "total_assets", "total_debt", "ebitda", "operating_cash_flow", "capital_expenditures", "net_income")

    def macro(self) -> DataFrame:
        """``date, series_name, value``: mean order value by day and priority."""
        names = F.create_map(*[F.lit(x) for pair in SERIES.items() for x in pair])
        rows = self.table("orders").groupBy(F.to_date("o_orderdate").alias("date"), names[F.col("o_orderpriority")].alias("series_name"))
        return rows.agg((self._sum(F.col("o_totalprice")) / F.count("*")).alias("value"))

    def market(self) -> DataFrame:
        """``date, mkt_rf, rf``: change of the mean unit price over all trades of a day."""
        daily = self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((self._sum(F.col("l_extendedprice")) / F.sum("l_quantity")).alias("p"))
        w = Window.orderBy("date")  # one row for each trading day
        return daily.select("date", (F.col("p") / F.lag("p").over(w) - 1).alias("mkt_rf"), F.lit(0.0001).alias("rf"))

    @staticmethod
    def earnings(quarters: DataFrame) -> DataFrame:
        """``ticker, date, eps_estimate, reported_eps, surprise_pct`` on the first order date of a quarter."""
        q = quarters.select("ticker", "q", F.col("first").alias("date"), (F.col("total_assets") / F.col("quantity")).alias("reported_eps"))
        prior = F.lag("reported_eps").over(Window.partitionBy("ticker").orderBy("q"))
        return q.select("ticker", "date", prior.alias("eps_estimate"), "reported_eps", (100 * (F.col("reported_eps") / prior - 1)).alias("surprise_pct"))

    def insiders(self) -> DataFrame:
        """``ticker, date, shares, text``."""
        flag = F.when(F.col("l_returnflag") == "N", "Purchase at market").when(F.col("l_returnflag") == "R", "Sale at market").otherwise("Sale of gift")
        return self.table("lineitem").select(self._ticker().alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("shares"), flag.alias("text"))
