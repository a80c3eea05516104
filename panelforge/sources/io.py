"""Readers and writers: vendor normalisation, text and macro parsing, upserts, CSV and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICE_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume", "Date": "date"}
VALUES = ["open", "high", "low", "close", "adj_close"]
#: Statement labels in order of preference (fixed values).
LABELS = {
    "book_value": ["stockholders equity", "total stockholders equity", "common stock equity", "stockholders_equity"],
    "gross_profit": ["gross profit", "grossprofit", "gross_profit"],
    "total_assets": ["total assets", "totalassets", "total_assets"],
    "eps": ["diluted eps", "basic eps", "diluted_eps", "basic_eps", "eps", "net income"],
    "ebitda": ["ebitda", "normalized ebitda", "normalized_ebitda"],
    "total_debt": ["total debt", "total_debt"],
    "operating_cash_flow": ["operating cash flow", "operating_cash_flow", "cash flow from continuing operating activities"],
    "capital_expenditures": ["capital expenditure", "capital_expenditures", "capital_expenditure", "purchase of ppe", "purchase of property plant and equipment"],
    "net_income": ["net income", "net_income", "net income from continuing operations"],
}


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Vendor columns renamed, absent ones null, NaN null, volume 0 for null, rows without any price dropped."""
    rows = raw.withColumnsRenamed({a: b for a, b in PRICE_COLUMNS.items() if a in raw.columns})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in [*VALUES, "volume"] if c not in rows.columns})
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in VALUES]
    volume = F.coalesce(F.when(~F.isnan(F.col("volume").cast("double")), F.col("volume")), F.lit(0)).cast("long")
    rows = rows.select(F.to_date("date").alias("date"), "ticker", *clean, volume.alias("volume")).dropna("all", subset=VALUES)
    return latest(rows, ["date", "ticker"], "volume")


def ticker_info(raw: DataFrame) -> DataFrame:
    """``ticker, sector, industry, shares_outstanding`` of vendor columns; where the shares are absent or 0, the implied ones."""
    known = {c: F.col(c) if c in raw.columns else F.lit(None) for c in ("sector", "industry", "sharesOutstanding", "impliedSharesOutstanding")}
    shares = F.coalesce(F.nullif(known["sharesOutstanding"].cast("double"), F.lit(0.0)), known["impliedSharesOutstanding"].cast("double"))
    return raw.select("ticker", *[known[c].cast("string").alias(c) for c in ("sector", "industry")], shares.alias("shares_outstanding"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def statement_fields(items: DataFrame) -> DataFrame:
    """``date, ticker, label, value`` to a column for each field, by the first label present; capex without sign."""
    spark = items.sparkSession
    table = spark.createDataFrame([(label, field, i) for field, labels in LABELS.items() for i, label in enumerate(labels)], "label string, field string, place int")
    rows = items.withColumn("label", F.lower(F.trim("label"))).where("value is not null").join(F.broadcast(table), "label")
    rows = rows.groupBy("date", "ticker", "field").agg(F.min_by("value", "place").alias("value"))
    wide = rows.groupBy("date", "ticker").pivot("field", list(LABELS)).agg(F.first("value"))
    return wide.withColumn("capital_expenditures", F.abs("capital_expenditures"))


def read_market_factors(spark: SparkSession, path: str) -> DataFrame:
    """Daily factors from a text file: rows after the header with Mkt-RF, up to the first short line, in fractions.

    Blank lines are skipped. Lines are numbered by Spark in the order of the file, which one task reads: such a file
    has one line for each trading day.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    rows = lines.where(F.trim("line") != "").withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    head = rows.where(F.col("line").contains("Mkt-RF")).agg(F.min("i").alias("head"))
    rows = rows.crossJoin(F.broadcast(head)).where(F.col("i") > F.col("head"))
    data = (F.size("f") >= 7) & F.col("f")[0].rlike(r"^\d{8}$")
    first = rows.where(data).agg(F.min("i").alias("first"))
    stop = rows.crossJoin(F.broadcast(first)).where((F.size("f") < 7) & (F.col("i") > F.col("first"))).agg(F.min("i").alias("stop"))
    rows = rows.crossJoin(F.broadcast(stop)).where(data & (F.col("stop").isNull() | (F.col("i") < F.col("stop"))))
    return rows.select(F.to_date(F.col("f")[0], "yyyyMMdd").alias("date"), *[(F.col("f")[k + 1].cast("double") / 100).alias(c) for k, c in enumerate(("mkt_rf", "smb", "hml", "rmw", "cma", "rf"))])


def macro_long(wide: DataFrame) -> DataFrame:
    """Wide macro series to ``date, series_name, value`` without nulls; text that isn't a number is null."""
    names = [c for c in wide.columns if c != "date"]
    rows = wide.select("date", *[F.col(c).try_cast("double").alias(c) for c in names])
    return rows.unpivot(["date"], names, "series_name", "value").dropna(subset=["value"])


def macro_filled(long: DataFrame) -> DataFrame:
    """Every date with every series, carried forward."""
    grid = long.select("date").distinct().crossJoin(long.select("series_name").distinct()).join(long, ["date", "series_name"], "left")
    w = Window.partitionBy("series_name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("value", F.last("value", ignorenulls=True).over(w))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys. Keys repeated in ``new`` are an error of the
    caller; one of the rows is taken."""
    new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions below ``path``, in order: those whose writer has left its mark of success."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    return sorted(n for n in names if fs.exists(hadoop(f"{path}/{n}/_SUCCESS")))


def write_upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Write ``path/version`` with ``new`` upserted into the newest complete version before it; versions sort by name.

    A version never reads itself, so writing it once more, after a failure or a replay, gives the same table.
    """
    before = [v for v in versions(spark, path) if v < version]
    rows = upsert(spark.read.parquet(f"{path}/{before[-1]}"), new, keys) if before else new.dropDuplicates(keys)
    rows.write.mode("overwrite").parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version below ``path``."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}")


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file of a small result."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_matrix_csv(rows: DataFrame, path: str) -> None:
    """Dates down, tickers across."""
    names = [r.ticker for r in rows.select("ticker").distinct().orderBy("ticker").collect()]
    write_csv(rows.groupBy("date").pivot("ticker", names).agg(F.first("value")).orderBy("date"), path)


def metrics_markdown(name: str, metrics: dict[str, float | None]) -> str:
    """A Markdown table; ratios as numbers, all else in percent."""
    line = lambda k, v: "n/a" if v is None else f"{v:.2f}" if "ratio" in k or k.startswith("n_") else f"{v:.2%}"
    return "\n".join([f"# {name}", "", "| metric | value |", "|-|-|", *(f"| {k} | {line(k, v)} |" for k, v in sorted(metrics.items()))]) + "\n"
