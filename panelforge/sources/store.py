"""The store: tables with keys in one ledger, saving results and runs, reports, and ingestion with a status for each source."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, combine, report
from . import io
from .ledger import WHOLE, Change, Ledger, Spec

LOG = logging.getLogger("panelforge")


def _spec(columns: str, *key: str, by: str | None = "date") -> Spec:
    """``columns`` by spaces, each with its type behind a colon, double where none is given."""
    pairs = [(c.split(":") + ["double"])[:2] for c in columns.split()]
    return Spec(", ".join(f"{n} {t}" for n, t in pairs), key, by)


KEY = "date:date ticker:string "
#: The tables. A metric of a run has one value for each scope, so the scope is part of the key.
TABLES = {
    "prices": _spec(KEY + "open high low close adj_close volume:long", "date", "ticker"),
    "returns": _spec(KEY + "log_return simple_return freq:string", "date", "ticker", "freq"),
    "metadata": _spec("ticker:string sector:string industry:string shares_outstanding", "ticker", by=None),
    "fundamentals": _spec(KEY + " ".join(io.LABELS), "date", "ticker"),
    "macro": _spec("date:date series_name:string value", "date", "series_name"),
    "market_factors": _spec("date:date mkt_rf smb hml rmw cma rf", "date"),
    "insider_transactions": _spec("id:string ticker:string date:date insider:string position:string shares value text:string", "id"),
    "earnings_calendar": _spec("ticker:string date:date eps_estimate reported_eps surprise_pct", "ticker", "date"),
    "universe_membership": _spec(KEY + "in_universe:boolean market_cap_proxy avg_dollar_vol days_since_first_price:int", "date", "ticker"),
    "factor_scores": _spec(KEY + "factor_name:string raw_score winsorized_score z_score final_score", "date", "ticker", "factor_name"),
    "factor_metrics": _spec("factor_name:string date:date stage:string metric_name:string value", "factor_name", "date", "stage", "metric_name"),
    "portfolio_weights": _spec("backtest_name:string date:date ticker:string weight", "backtest_name", "date", "ticker"),
    "trades": _spec("backtest_name:string date:date ticker:string trade_type:string weight_change turnover_contribution", "backtest_name", "date", "ticker"),
    "backtest_results": _spec("backtest_name:string date:date gross_return net_return portfolio_value drawdown turnover transaction_costs", "backtest_name", "date"),
    "backtest_metrics": _spec("backtest_name:string metric_name:string value", "backtest_name", "metric_name", by=None),
    "combination_runs": _spec("run_id:string method:string config_hash:string train_start:date train_end:date test_start:date test_end:date created_at:date", "run_id", by=None),
    "composite_scores": _spec(KEY + "method:string run_id:string composite_score", "date", "ticker", "method"),
    "combination_weights": _spec("date:date factor_name:string method:string run_id:string weight", "date", "factor_name", "method"),
    "combination_metrics": _spec("run_id:string method:string metric_name:string metric_scope:string value", "run_id", "method", "metric_name", "metric_scope", by=None),
    "market_regimes": _spec("date:date regime_id:int regime_label:string prob_0 prob_1 prob_2 prob_3", "date"),
    "model_nodes": _spec("model_id:string tree:int node:int depth:int feature:string threshold left:int right:int value rows:long", "model_id", "tree", "node", by=None),
}


def opened(spark: SparkSession, root: str) -> Ledger:
    return Ledger(spark, root, TABLES)


def create(spark: SparkSession, root: str) -> Ledger:
    """The store, with an empty first commit if it has none."""
    ledger = opened(spark, root)
    if not ledger.head()[0]:
        ledger.commit({})
    return ledger


def insiders(rows: DataFrame) -> DataFrame:
    """Insider transactions with an ``id`` made of all they say, so that loading them once more adds none."""
    said = ["ticker", "date", "insider", "position", "shares", "value", "text"]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in said if c not in rows.columns})
    line = F.concat_ws("|", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1"), F.lit("")) for c in said])
    return rows.withColumn("id", F.sha2(line, 256))


def save(ledger: Ledger, name: str, rows: DataFrame, batch: int | None = None) -> DataFrame:
    """The table with ``rows`` upserted by its key; columns it doesn't have are left out, absent ones are null.

    A ``batch`` number counts once for a table: an earlier or repeated one changes nothing.
    """
    ledger.commit({name: insiders(rows) if name == "insider_transactions" else rows}, batch=None if batch is None else (name, batch))
    return ledger.read(name)


def save_backtests(ledger: Ledger, weights: DataFrame, moves: DataFrame) -> dict[str, DataFrame]:
    """Weights, trades, results and metrics of backtests in one commit; the tables by name."""
    results = backtest.backtest_results(moves)
    rows = {"portfolio_weights": weights, "trades": backtest.trades(moves), "backtest_results": results, "backtest_metrics": backtest.backtest_metrics(results)}
    ledger.commit(rows)
    return {name: ledger.read(name) for name in rows}


def save_regimes(ledger: Ledger, states: DataFrame, labels: DataFrame) -> DataFrame:
    """States with their labels (a state without one is 'State k'); absent probabilities are 0."""
    rows = states.withColumns({f"prob_{i}": F.lit(0.0) for i in range(4) if f"prob_{i}" not in states.columns})
    rows = rows.join(F.broadcast(labels), "regime_id", "left")  # a row for each state
    rows = rows.withColumn("regime_label", F.coalesce("regime_label", F.concat(F.lit("State "), F.col("regime_id").cast("string"))))
    return save(ledger, "market_regimes", rows)


def save_run(ledger: Ledger, method: str, config: dict, scores: DataFrame, weights: DataFrame | None = None, metrics: DataFrame | None = None, train: tuple = (None, None), test: tuple = (None, None)) -> str:
    """A run of a composite method: its record, ``scores`` (date, ticker, composite_score), ``weights`` (date, factor_name,
    weight) and ``metrics`` (metric_name, metric_scope, value), all in one commit; its run_id.

    A run takes the place of earlier runs of the method under the same configuration, with all they have saved.
    """
    run_id, digest = combine.run_id(method, config)
    old = {k: r for k, r in ledger.head()[1]["runs"].items() if (r["method"], r["config_hash"]) == (method, digest)}
    spans = [f"{name} date" for name in ("train_start", "train_end", "test_start", "test_end", "created_at")]
    record = ledger.spark.createDataFrame([(run_id, method, digest, *train, *test, dt.date.today())], "run_id string, method string, config_hash string, " + ", ".join(spans))
    rows = {"combination_runs": record, "composite_scores": scores, "combination_weights": weights, "combination_metrics": metrics}
    changes = {}
    for table, own in rows.items():
        if own is None:
            own = ledger.spark.createDataFrame([], TABLES[table].columns)
        parts = {p for r in old.values() for p in r["parts"].get(table, ())}
        own = own.withColumns({"method": F.lit(method), "run_id": F.lit(run_id)})
        changes[table] = Change(own, F.col("run_id").isin(*old) if old else None, tuple(parts if TABLES[table].by else parts & {WHOLE}))
    ledger.commit(changes, run=(run_id, {"method": method, "config_hash": digest}), ended=tuple(old))
    return run_id


def run_metrics(results: DataFrame, start: str) -> DataFrame:
    """``metric_name, metric_scope, value`` of one backtest, over all dates and out of sample (from ``start`` on)."""
    row = report.comparison(results, start)
    tall = row.unpivot([], [c for c in row.columns if c != "backtest_name"], "name", "value")
    return tall.select(F.substring_index("name", "_", 1).alias("metric_scope"), F.regexp_replace("name", "^[a-z]+_", "").alias("metric_name"), "value")


def write_report(saved: dict[str, DataFrame], path: str, start: str) -> None:
    """CSV folders of a run's tables, yearly and monthly figures and the comparison, and a text file with a summary."""
    results = saved["backtest_results"]
    tables = saved | {"annual_performance": backtest.annual_perf(results), "monthly_returns_grid": backtest.monthly_grid(results), "comparison": report.comparison(results, start)}
    _written(tables, path, ("comparison", "backtest_metrics", "annual_performance"))


def write_composite_report(path: str, comparison: DataFrame, weights: dict[str, DataFrame], coefficients: DataFrame | None = None, shap_values: DataFrame | None = None) -> None:
    """CSV folders of the comparison of methods, each method's factor weights, regression coefficients (a column for each
    factor) and Shapley values, and the comparison as Markdown."""
    tables = {"composite_comparison": comparison} | {f"factor_weights_{m}": rows for m, rows in weights.items()}
    if coefficients is not None:
        names = sorted(r[0] for r in coefficients.select("factor_name").distinct().collect())
        tables["fama_macbeth_coefficients"] = coefficients.groupBy("date").pivot("factor_name", names).agg(F.first("beta")).orderBy("date")
    if shap_values is not None:
        tables["shap_values"] = shap_values
    _written(tables, path, ("composite_comparison",))


def _written(tables: dict[str, DataFrame], path: str, told: tuple[str, ...]) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    text = "\n".join(report.markdown(tables[n].orderBy(*tables[n].columns[:2]), n) for n in told)
    tables[told[0]].sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.md")


def ingest(ledger: Ledger, sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """``source, status, n_rows, error`` of saving each source's rows; one that fails does not stop the others."""
    done = []
    for name, read in sources.items():
        try:
            rows = read()
            n = rows.count()
            save(ledger, name, rows)
            done.append((name, "ok" if n else "empty", n, None))
        except Exception as problem:  # whatever a source raises is its status
            LOG.warning("source %s failed: %s", name, problem)
            done.append((name, "failed", 0, str(problem).splitlines()[0][:300]))
    return ledger.spark.createDataFrame(done, "source string, status string, n_rows long, error string")
