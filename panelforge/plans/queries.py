"""The queries: each operator applied to the panel of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import backtest, combine, evaluate, factors, regime, report, returns, shap
from ..sources import io, models, store
from ..sources.ledger import Ledger
from ..sources.ranges import SPECS, Range
from . import oracle
from .catalog import standard
from .panels import leased, opened

S, X, D = "string", "double", "date"
SCORES = ["raw_score", "winsorized_score", "z_score", "final_score"]
#: Days without a price that a ticker may have in a row in fill_gaps_drop.
MOST = 14
#: The panels the queries are made of.
CATALOG = standard()
#: Name: (function of a lease on the panels, result columns)
PLANS: dict = {}


def plan(name: str, columns: str):
    """Registers a function of a lease; ``columns`` are 'name:type' by spaces, double where no type is given."""
    pairs = [(c.split(":") + [X])[:2] for c in columns.split()]

    def add(f):
        PLANS[name] = (f, [tuple(p) for p in pairs])
        return f

    return add


def _mret(s):
    return s("returns")


def _mpanel(s):
    return returns.panel(_mret(s))


def _member(s):
    return returns.universe_membership(s("prices"))


def _scores(s):
    return s.scores(factors.FACTORS)


def _bt(s):
    return _scores(s).select(F.col("factor_name").alias("backtest_name"), "date", "ticker", F.col("final_score").alias("score"))


def _moves(s):
    return backtest.run(_bt(s), _mret(s))


def _common(s):
    return _bt(s).join(_mret(s).select("date").distinct(), "date", "left_semi")


def _panel(s):
    return s("feature panel")


def _basic(s):
    return s("basic panel")


def _features(s):
    return regime.regime_features(s("prices"), s("macro"))


def _states(s):
    """A fixed sequence of states, so that what is built on states can be compared."""
    return _features(s).select("date", (F.expr("(year(date) * 12 + month(date)) div 5 % 4")).cast("int").alias("regime_id"))


KEY = "date:date ticker:string "
plan("dense_grid", KEY + "adj_close volume:bigint")(lambda s: returns.dense_grid(s("prices")))
plan("daily_returns", KEY + "log_return simple_return")(lambda s: returns.daily_returns(s("prices")))
plan("monthly_returns", KEY + "log_return simple_return")(_mret)
plan("stored_returns", KEY + "log_return simple_return freq:string")(lambda s: returns.stored_returns(s("prices")))
plan("validate_index", "index_ticker:string correlation valid:boolean")(lambda s: returns.validate_index(_mret(s)))
plan("universe_membership", KEY + "in_universe:boolean market_cap_proxy avg_dollar_vol days_since_first_price:int")(_member)
plan("universe_size", "date:date n_members:bigint n_total:bigint inclusion_rate")(lambda s: returns.inclusion(_member(s)))
plan("asof_membership", KEY + "in_universe:boolean")(lambda s: returns.asof_membership(_mpanel(s), _member(s)))
plan("fill_gaps_drop", KEY + "value")(lambda s: returns.fill_gaps(returns.panel(returns.daily_returns(s("prices"))), "drop_cols", MOST))
plan("trim_by_universe", KEY + "value")(lambda s: returns.trim_by_universe(_mpanel(s), returns.asof_membership(_mpanel(s), _member(s))))
plan("xs_stats", "date:date mean std median skewness excess_kurtosis pct_positive n_stocks:bigint")(lambda s: returns.xs_stats(_mpanel(s)))
plan("annual_stats", "year:int n_obs:bigint mean std skewness excess_kurtosis min max")(lambda s: returns.annual_stats(_mpanel(s)))
plan("distribution_tests", "n:bigint jarque_bera p_value p01 p25 p50 p75 p99")(lambda s: returns.distribution_tests(_mpanel(s)))
plan("panel_summary", "n_dates:bigint n_tickers:bigint n_values:bigint first_date:date last_date:date n_years:bigint")(lambda s: returns.panel_summary(_mpanel(s)))
for _n in factors.FACTORS:
    plan(f"factor_{_n}", KEY + "raw_score")(lambda s, n=_n: s.family(n).select("date", "ticker", (F.round(n, 9) + F.lit(0.0)).alias("raw_score")))
for _q, _c in (("winsorize", "winsorized_score"), ("zscore", "z_score"), ("neutralize", "final_score")):
    plan(_q, KEY + f"factor_name:string {_c}")(lambda s, c=_c: _scores(s).select("date", "ticker", "factor_name", c))
plan("factor_scores_long", KEY + "factor_name:string " + " ".join(SCORES))(_scores)
plan("ic_series", "factor_name:string date:date n:bigint ic")(lambda s: evaluate.ic_series(_scores(s), _mret(s)))
plan("ic_summary", "factor_name:string mean_ic std_ic icir n_dates:bigint")(lambda s: evaluate.ic_summary(evaluate.ic_series(_scores(s), _mret(s))))
plan("quintile_returns", "factor_name:string date:date return_q1 return_q5 return_ls")(lambda s: evaluate.quintile_returns(_scores(s), _mret(s)))
plan("quintile_sharpe", "factor_name:string sharpe_q1 sharpe_q5 sharpe_ls")(lambda s: evaluate.quintile_sharpe(evaluate.quintile_returns(_scores(s), _mret(s)).where("return_ls is not null")))
plan("score_autocorr", "factor_name:string lag:int autocorr")(lambda s: evaluate.score_autocorr(_scores(s)))
plan("half_life", "factor_name:string half_life")(lambda s: evaluate.half_life(evaluate.score_autocorr(_scores(s))))
plan("factor_metrics", "factor_name:string date:date stage:string metric_name:string value")(lambda s: evaluate.factor_metrics(_scores(s), _mret(s)))
plan("rebalance_schedule", "date:date")(lambda s: backtest.rebalance_schedule(s("prices")))
plan("topk_weights", "backtest_name:string date:date ticker:string weight")(lambda s: backtest.topk_weights(_common(s)))
plan("long_short_weights", "backtest_name:string date:date ticker:string weight")(lambda s: backtest.long_short_weights(_common(s)))
plan("cap_weights", "backtest_name:string date:date ticker:string weight")(lambda s: backtest.cap_weights(backtest.rank_weights(_common(s)), 0.4))
plan("active_scores", "backtest_name:string date:date ticker:string score")(lambda s: backtest.active_scores(_bt(s), returns.asof_membership(_bt(s).select("date", "ticker").distinct(), _member(s))))
plan("trades", "backtest_name:string date:date ticker:string trade_type:string weight_change turnover_contribution")(lambda s: backtest.trades(_moves(s)))
plan("backtest_results", "backtest_name:string date:date gross_return net_return portfolio_value drawdown turnover transaction_costs")(lambda s: backtest.backtest_results(_moves(s)).withColumn("portfolio_value", F.ln(F.col("portfolio_value") / 1e7)))
plan("backtest_metrics", "backtest_name:string metric_name:string value")(lambda s: backtest.backtest_metrics(backtest.backtest_results(_moves(s))))
plan("annual_perf", "backtest_name:string year:int annual_return volatility sharpe max_drawdown")(lambda s: backtest.annual_perf(backtest.backtest_results(_moves(s))))
plan("monthly_grid", "backtest_name:string year:int " + " ".join(f"m{m:02}" for m in range(1, 13)) + " total")(lambda s: backtest.monthly_grid(backtest.backtest_results(_moves(s))))
plan("method_comparison", "backtest_name:string full_sharpe full_max_dd oos_sharpe oos_max_dd")(lambda s: report.comparison(backtest.backtest_results(_moves(s)), "1996-01-01"))
plan("drawdown_spans", "backtest_name:string start_date:date end_date:date n_dates:bigint depth")(lambda s: report.drawdown_spans(backtest.backtest_results(_moves(s))))
plan("return_histogram", "bin:int low high n:bigint")(lambda s: report.histogram(_mpanel(s)))
plan("normal_quantiles", "p theoretical observed")(lambda s: report.normal_quantiles(_mpanel(s)))
plan("member_any_by_month", "month:date ticker:string any_true:boolean")(lambda s: report.any_by_month(_member(s), "in_universe"))
plan("feature_panel", KEY + " ".join(factors.FACTORS) + " fwd")(_panel)
plan("ic_weights", "date:date factor_name:string weight")(lambda s: combine.ic_weights(_panel(s)))
plan("ic_composite", KEY + "composite_score")(lambda s: combine.composite(_panel(s), combine.ic_weights(_panel(s))))
plan("fama_macbeth_coef", "date:date factor_name:string beta")(lambda s: combine.regressions(_basic(s)))
plan("fama_macbeth_weights", "date:date factor_name:string weight")(lambda s: combine.fama_macbeth_weights(combine.regressions(_basic(s))))
plan("composite_scores", KEY + "method:string composite_score")(lambda s: combine.composites(_basic(s), [combine.ICWeighted(), combine.FamaMacBeth()]))
plan("factor_corr", "factor_a:string factor_b:string correlation")(lambda s: combine.factor_corr(_panel(s)))
plan("regime_features", "date:date " + " ".join(regime.FEATURES))(_features)
plan("regime_profile", "regime_id:int feature:string mean z")(lambda s: regime.regime_profile(_features(s), _states(s)))
plan("regime_labels", "regime_id:int regime_label:string")(lambda s: regime.regime_labels(_features(s), _states(s)))
plan("regime_spans", "regime_id:int start_date:date end_date:date n_dates:bigint")(lambda s: regime.regime_spans(_states(s)))
plan("regime_transitions", "from_id:int to_id:int probability expected_duration")(lambda s: regime.transitions(_states(s)))
plan("hmm_states", "date:date regime_id:int prob_0 prob_1 prob_2 prob_3")(lambda s: regime.hmm_states(_features(s)))
plan("hmm_bic", "k:bigint log_likelihood bic best:boolean")(lambda s: regime.bic_by_states(_features(s)))
plan("macro_unpivot", "date:date series_name:string value")(lambda s: io.macro_long(s("macro").groupBy("date").pivot("series_name", ["DGS10", "DGS2", "VIXCLS", "BAMLH0A0HYM2", "NAPM"]).agg(F.first("value"))))
plan("macro_filled", "date:date series_name:string value")(lambda s: io.macro_filled(s("macro")))
plan("metadata", "ticker:string sector:string industry:string shares_outstanding")(lambda s: s("metadata"))
plan("fundamentals", KEY + " ".join(factors.STATEMENT))(lambda s: s("fundamentals"))


def _between(s):
    return Range(Ledger(s.panels.star.spark, s("history"), SPECS), *oracle.BETWEEN)


plan("daily_returns_range", KEY + "log_return simple_return")(lambda s: _between(s).daily_returns())
plan("monthly_returns_range", KEY + "log_return simple_return")(lambda s: _between(s).monthly_returns())
plan("universe_range", KEY + "in_universe:boolean market_cap_proxy avg_dollar_vol days_since_first_price:int")(lambda s: _between(s).universe_membership())
plan("momentum_range", KEY + " ".join(factors.PRICE))(lambda s: _between(s).price_factors())
plan("macro_filled_range", "date:date series_name:string value")(lambda s: _between(s).macro_filled())


@plan("upsert_merge", KEY + "simple_return")
def _upsert(s):
    rows = _mret(s).select("date", "ticker", "simple_return")
    changed = rows.where(F.month("date").isin(6, 12)).withColumn("simple_return", F.col("simple_return") + 1)
    return io.upsert(rows.where(F.month("date") != 6), changed, ["date", "ticker"])  # June comes in, December changes


@plan("event_windows", "window_start:timestamp event_type:string n:bigint total")
def _events(s):
    from ..streaming.events import windowed

    return windowed(s.table("events"))


@plan("boosted_composite", KEY + "composite_score")
def _boosted(s):
    return combine.boosted_walk(_panel(s))


@plan("model_scores", KEY + "composite_score")
def _model(s):
    saved = store.opened(s.panels.star.spark, s("model"))
    return models.scored(_panel(s), models.nodes_of(saved, "boosted"))


@plan("shap_importance", "factor_name:string importance")
def _shap(s):
    panel = _panel(s)
    return shap.importance(shap.shap_values(panel, combine.boosted_trees(panel, factors.FACTORS), factors.FACTORS))


def _query(name: str):
    f, columns = PLANS[name]
    by = oracle.SELECTS.get(name, ("bucket",))[0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lease = opened(spark, CATALOG, sf_dir, by).lease()
        rows = f(lease)
        return leased(rounded(rows.select(*[F.col(c).cast(t).alias(c) if t not in (X, "timestamp") else F.col(c) for c, t in columns]), oracle.DIGITS, oracle.DIGITS.get(name, 6)), lease)

    return run


def queries() -> dict:
    return {name: _query(name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: oracle.sql(name, PLANS[name][1]) for name in PLANS if name in oracle.SELECTS}
