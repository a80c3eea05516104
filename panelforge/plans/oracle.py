"""The queries in DuckDB SQL: one chain of common tables for each kind of ticker, and a final SELECT for each query."""

from __future__ import annotations

from datetime import date
from statistics import NormalDist

from ..operators.factors import EVENT, FACTORS, PRICE, RISK, VALUE

N = "/ nullif({}, 0)".format


def _dec(expr: str, scale: int = 2) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def asof(target: str, source: str, cols: list[str], extra: str = "") -> str:
    """Each field's last value by ticker at or before the target's date."""
    pick = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in cols)
    null = ", ".join(f"NULL AS {c}" for c in cols)
    return f"""SELECT * EXCLUDE (t) FROM (SELECT date, ticker, t{extra}, {pick} FROM (
        SELECT date, ticker, 1 AS t{extra}, {null} FROM {target} UNION ALL BY NAME SELECT date, ticker, 0 AS t, {", ".join(cols)} FROM {source})
        WINDOW w AS (PARTITION BY ticker ORDER BY date, t ROWS UNBOUNDED PRECEDING)) WHERE t = 1"""


def features(x: str, names: list[str]) -> str:
    """The panel of the factors ``names``, rank correlations with forward returns and weights; ``x`` ends the tables' names."""
    ranks = ", ".join(f"rank() OVER (PARTITION BY factor_name, date ORDER BY {c}) + (count(*) OVER (PARTITION BY factor_name, date, {c}) - 1) / 2.0 AS {r}" for c, r in (("score", "rx"), ("fwd", "ry")))
    return f"""pan0{x} AS (SELECT date, ticker, {", ".join(f"max(CASE WHEN factor_name = '{n}' THEN final_score END) AS {n}" for n in names)} FROM scores WHERE factor_name IN ({", ".join(f"'{n}'" for n in names)}) GROUP BY 1, 2),
    pan1{x} AS (SELECT date, ticker, {", ".join(f"coalesce({n}, median({n}) OVER (PARTITION BY date)) AS {n}" for n in names)} FROM pan0{x}),
    panel{x} AS (SELECT * FROM pan1{x} JOIN fwd USING (date, ticker) WHERE fwd IS NOT NULL AND {" AND ".join(f"{n} IS NOT NULL" for n in names)}),
    plong{x} AS ({" UNION ALL ".join(f"SELECT date, ticker, fwd, '{n}' AS factor_name, {n} AS score FROM panel{x}" for n in names)}),
    prk{x} AS (SELECT *, {ranks} FROM plong{x}),
    pic{x} AS (SELECT factor_name, date, CASE WHEN count(*) >= 5 THEN covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) END AS ic FROM prk{x} GROUP BY 1, 2),
    pm{x} AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(ic) OVER w END AS mean FROM pic{x} WINDOW w AS (PARTITION BY factor_name ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
    icw{x} AS (SELECT date, factor_name, CASE WHEN total > 0 THEN greatest(coalesce(mean, 0), 0) / total ELSE 1.0 / k END AS weight FROM
        (SELECT *, sum(greatest(coalesce(mean, 0), 0)) OVER w AS total, count(*) OVER w AS k, max(mean) OVER w AS best FROM pm{x} WINDOW w AS (PARTITION BY date)) WHERE best IS NOT NULL)"""


def stage(x: str, col: str) -> str:
    """Evaluation of the scores in ``col``; ``x`` ends the tables' names."""
    return f"""pairs{x} AS (SELECT factor_name, date, ticker, {col} AS score, fwd FROM scores JOIN fwd USING (date, ticker)),
    rk{x} AS (SELECT *, rank() OVER (PARTITION BY factor_name, date ORDER BY score) + (count(*) OVER (PARTITION BY factor_name, date, score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor_name, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor_name, date, fwd) - 1) / 2.0 AS ry FROM pairs{x} WHERE score IS NOT NULL AND fwd IS NOT NULL),
    ics{x} AS (SELECT factor_name, date, count(*) AS n, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk{x} GROUP BY 1, 2 HAVING count(*) >= 3),
    qs{x} AS (SELECT factor_name, date, fwd, greatest((5 * (r - 1) + m - 2) // (m - 1), 1) - 1 AS q FROM (SELECT *, row_number() OVER (PARTITION BY factor_name, date ORDER BY score, ticker) AS r, count(*) OVER (PARTITION BY factor_name, date) AS m FROM pairs{x} WHERE score IS NOT NULL) WHERE m >= 5),
    qret{x} AS (SELECT factor_name, last_day(date + 1) AS date, q1 AS return_q1, q5 AS return_q5, q5 - q1 AS return_ls FROM (SELECT factor_name, date, avg(fwd) FILTER (q = 0) AS q1, avg(fwd) FILTER (q = 4) AS q5 FROM qs{x} GROUP BY 1, 2)),
    sidx{x} AS (SELECT *, dense_rank() OVER (PARTITION BY factor_name ORDER BY date) AS i FROM scores),
    acp{x} AS (SELECT a.factor_name, a.i, l.lag, a.{col} AS x, b.{col} AS y FROM sidx{x} a CROSS JOIN (SELECT unnest(range(1, 7)) AS lag) l JOIN sidx{x} b ON a.factor_name = b.factor_name AND a.ticker = b.ticker AND b.i = a.i + l.lag WHERE a.{col} IS NOT NULL AND b.{col} IS NOT NULL),
    acr{x} AS (SELECT factor_name, i, lag, rank() OVER (PARTITION BY factor_name, i, lag ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, i, lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY factor_name, i, lag ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, i, lag, y) - 1) / 2.0 AS ry FROM acp{x}),
    ace{x} AS (SELECT factor_name, i, lag, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ac FROM acr{x} GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    ac{x} AS (SELECT factor_name, lag::INTEGER AS lag, coalesce(autocorr, 0) AS autocorr FROM (SELECT DISTINCT factor_name FROM scores) CROSS JOIN (SELECT unnest(range(1, 7)) AS lag) LEFT JOIN (SELECT factor_name, lag, avg(ac) AS autocorr FROM ace{x} GROUP BY 1, 2) USING (factor_name, lag))"""


def base(by: str) -> str:
    ticker = (lambda c: f"'S' || lpad(CAST({c} AS VARCHAR), 5, '0')") if by == "supplier" else (lambda c: f"'B' || lpad(CAST({c} % 15 AS VARCHAR), 2, '0')")
    t = ticker("l_suppkey")
    meta = (
        f"SELECT {ticker('s_suppkey')} AS ticker, r_name AS sector, n_name AS industry, 1000 + abs(s_acctbal) AS shares_outstanding FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        if by == "supplier"
        else "SELECT 'B' || lpad(CAST(b AS VARCHAR), 2, '0') AS ticker, 'G' || CAST(b % 5 AS VARCHAR) AS sector, 'bucket' AS industry, 1000.0::DOUBLE + 10 * b AS shares_outstanding FROM (SELECT DISTINCT s_suppkey % 15 AS b FROM supplier)"
    )
    when = lambda c, v: f"CASE WHEN {c} = '{v}' THEN l_extendedprice END"
    r9 = lambda names: ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in names)
    cov = lambda x: f"covar_samp(CASE WHEN {x} IS NOT NULL THEN r END, CASE WHEN r IS NOT NULL THEN {x} END) OVER w"
    return f"""WITH
    px AS (SELECT CAST(l_shipdate AS DATE) AS date, {t} AS ticker, {_dec("l_extendedprice")} / SUM(l_quantity) AS adj_close, CAST(SUM(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2),
    meta AS ({meta}),
    grid AS (SELECT date, ticker, adj_close, volume FROM (SELECT DISTINCT date FROM px) CROSS JOIN (SELECT DISTINCT ticker FROM px) LEFT JOIN px USING (date, ticker)),
    rets AS (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS ch FROM grid),
    dret AS (SELECT date, ticker, CASE WHEN ch > 0 THEN ln(ch) END AS log_return, ch - 1 AS simple_return FROM rets WHERE ch IS NOT NULL),
    ff AS (SELECT date, ticker, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS px FROM grid),
    mlast AS (SELECT last_day(date) AS date, ticker, arg_max(px, date) AS px FROM ff GROUP BY 1, 2),
    months AS (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM px)), date_trunc('month', (SELECT max(date) FROM px)), INTERVAL 1 MONTH)) AS m)),
    me AS (SELECT date, ticker, px FROM months CROSS JOIN (SELECT DISTINCT ticker FROM px) LEFT JOIN mlast USING (date, ticker)),
    mret AS (SELECT date, ticker, CASE WHEN ch > 0 THEN ln(ch) END AS log_return, ch - 1 AS simple_return FROM (SELECT *, px / lag(px) OVER (PARTITION BY ticker ORDER BY date) AS ch FROM me) WHERE ch IS NOT NULL),
    lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    fund AS (SELECT last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS date, {t} AS ticker,
        {_dec("o_totalprice")} AS book_value, {_dec("l_extendedprice * (1 - l_discount)", 4)} AS gross_profit, {_dec("l_extendedprice")} AS total_assets, {_dec("l_extendedprice * l_tax", 4)} AS total_debt,
        {_dec(when("o_orderstatus", "F"))} AS ebitda, {_dec(when("l_returnflag", "N"))} AS operating_cash_flow, {_dec(when("l_returnflag", "R"))} AS capital_expenditures, {_dec(when("l_returnflag", "A"))} AS net_income FROM lo GROUP BY 1, 2),
    macro AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'DGS2' WHEN '3-MEDIUM' THEN 'VIXCLS' WHEN '4-NOT SPECIFIED' THEN 'BAMLH0A0HYM2' ELSE 'NAPM' END AS series_name, {_dec("o_totalprice")} / count(*) AS value FROM orders GROUP BY 1, 2),
    mktp AS (SELECT CAST(l_shipdate AS DATE) AS date, {_dec("l_extendedprice")} / SUM(l_quantity) AS p FROM lineitem GROUP BY 1),
    mkt AS (SELECT date, p / lag(p) OVER (ORDER BY date) - 1 AS mkt_rf, 0.0001::DOUBLE AS rf FROM mktp),
    earn AS (SELECT ticker, date, lag(e) OVER (PARTITION BY ticker ORDER BY q) AS eps_estimate, e AS reported_eps, 100 * (e / lag(e) OVER (PARTITION BY ticker ORDER BY q) - 1) AS surprise_pct FROM
        (SELECT {t} AS ticker, date_trunc('quarter', o_orderdate) AS q, min(CAST(o_orderdate AS DATE)) AS date, {_dec("l_extendedprice")} / SUM(l_quantity) AS e FROM lo GROUP BY 1, 2)),
    ins AS (SELECT {t} AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS b, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS s FROM lineitem GROUP BY 1, 2),
    f_price AS (SELECT date, ticker, {r9(PRICE)} FROM (SELECT date, ticker, lag(px) OVER w / lag(px, 12) OVER w - 1 AS PriceMomentum, lag(px) OVER w / lag(px, 3) OVER w - 1 AS ThreeMonthMomentum, -(px / lag(px) OVER w - 1) AS OneMonthReversal FROM me WINDOW w AS (PARTITION BY ticker ORDER BY date))),
    lev AS (SELECT date, ticker, x - lag(x) OVER (PARTITION BY ticker ORDER BY date) AS leverage FROM (SELECT DISTINCT date FROM fund) CROSS JOIN (SELECT DISTINCT ticker FROM fund) LEFT JOIN (SELECT date, ticker, total_debt {N("book_value")} AS x FROM fund) USING (date, ticker)),
    reports AS (SELECT * FROM lev FULL JOIN (SELECT *, -(net_income - operating_cash_flow) {N("total_assets")} AS accruals FROM fund) USING (date, ticker)),
    known AS ({asof("me", "reports", ["book_value", "gross_profit", "total_assets", "total_debt", "ebitda", "operating_cash_flow", "capital_expenditures", "accruals", "leverage"], ", px")}),
    f_value AS (SELECT date, ticker, {r9(VALUE)} FROM (SELECT date, ticker, book_value {N("cap")} AS BookToPrice, gross_profit {N("total_assets")} AS GrossProfitability, ebitda {N("(cap + coalesce(total_debt, 0))")} AS EVtoEBITDA,
        (operating_cash_flow - coalesce(capital_expenditures, 0)) {N("cap")} AS FCFYield, -leverage AS DebtToEquityChange, accruals AS Accruals FROM (SELECT *, px * shares_outstanding AS cap FROM known LEFT JOIN meta USING (ticker)))),
    cal AS (SELECT DISTINCT date FROM px),
    wide AS (SELECT date, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("DGS10", "DGS2", "VIXCLS", "BAMLH0A0HYM2", "NAPM"))} FROM cal LEFT JOIN
        (SELECT date, {", ".join(f"max(CASE WHEN series_name = '{c}' THEN value END) AS {c}" for c in ("DGS10", "DGS2", "VIXCLS", "BAMLH0A0HYM2", "NAPM"))} FROM macro GROUP BY date) USING (date)),
    expo AS (SELECT date, last_value(m IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS m, s - lag(s) OVER (ORDER BY date) AS slope, h - lag(h) OVER (ORDER BY date) AS spread, q - lag(q) OVER (ORDER BY date) AS pmi FROM
        (SELECT date, mkt_rf + rf AS m, DGS10 - DGS2 AS s, BAMLH0A0HYM2 AS h, NAPM - lag(NAPM, CAST(least(60, greatest(1, (SELECT count(*) FROM cal) // 5)) AS INTEGER)) OVER (ORDER BY date) AS q FROM wide LEFT JOIN mkt USING (date))),
    risk AS (SELECT date, ticker, CASE WHEN count(r) OVER w >= 126 THEN stddev_samp(r) OVER w END AS vol, var_samp(r) OVER w AS v, var_samp(m) OVER w AS vm,
        {", ".join(f"{cov(x)} / nullif(var_samp({x}) OVER w, 0) AS b_{x}" for x in ("m", "slope", "spread", "pmi"))} FROM (SELECT date, ticker, ch - 1 AS r FROM rets) JOIN expo USING (date)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    rlast AS (SELECT last_day(date) AS date, ticker, max(date) AS d FROM risk GROUP BY 1, 2),
    riskff AS (SELECT * EXCLUDE (vol), last_value(vol IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS vol FROM risk),
    f_risk AS (SELECT date, ticker, {r9(RISK)} FROM (SELECT l.date, l.ticker, -vol AS LowVolatility, b_m AS MarketBeta, CASE WHEN b_m IS NOT NULL AND v IS NOT NULL THEN -sqrt(greatest(0, v - b_m * b_m * vm)) END AS IdiosyncraticVolatility,
        b_slope AS YieldCurveSlopeBeta, b_spread AS CreditSpreadBeta, b_pmi AS PMIMomentumBeta FROM rlast l JOIN riskff r ON l.ticker = r.ticker AND l.d = r.date)),
    rev AS (SELECT date, ticker, x - lag(x) OVER (PARTITION BY ticker ORDER BY date) AS EarningsRevision FROM (SELECT DISTINCT date FROM earn) CROSS JOIN (SELECT DISTINCT ticker FROM earn) LEFT JOIN (SELECT date, ticker, eps_estimate AS x FROM earn) USING (date, ticker)),
    news AS (SELECT date, ticker, EarningsRevision, surprise_pct AS EarningsSurpriseSUE FROM rev FULL JOIN earn USING (date, ticker)),
    eknown AS ({asof("me", "news", ["EarningsSurpriseSUE", "EarningsRevision"])}),
    trade AS (SELECT me.date, me.ticker, coalesce(sum(b), 0) AS b, coalesce(sum(s), 0) AS s FROM me LEFT JOIN ins ON ins.ticker = me.ticker AND ins.date BETWEEN me.date - 60 AND me.date GROUP BY 1, 2),
    f_event AS (SELECT date, ticker, {r9(EVENT)} FROM (SELECT date, ticker, EarningsSurpriseSUE, EarningsRevision, (b - s) / (b + s + 1e-5) AS InsiderBuyingRatio FROM eknown JOIN trade USING (date, ticker))),
    allf AS (SELECT * FROM f_price FULL JOIN f_value USING (date, ticker) FULL JOIN f_risk USING (date, ticker) FULL JOIN f_event USING (date, ticker)),
    raw0 AS ({" UNION ALL ".join(f"SELECT date, ticker, '{n}' AS factor_name, {n} AS raw_score FROM allf" for n in FACTORS)}),
    raw AS (SELECT * FROM raw0 QUALIFY count(raw_score) OVER (PARTITION BY date, factor_name) > 0),
    bars AS (SELECT date, factor_name, quantile_cont(raw_score, 0.01) AS lo, quantile_cont(raw_score, 0.99) AS hi FROM raw GROUP BY 1, 2),
    wins AS (SELECT raw.*, CASE WHEN raw_score IS NOT NULL THEN greatest(least(raw_score, hi), lo) END AS winsorized_score FROM raw JOIN bars USING (date, factor_name)),
    z AS (SELECT *, CASE WHEN winsorized_score IS NOT NULL THEN coalesce((winsorized_score - avg(winsorized_score) OVER w) / CASE WHEN stddev_samp(winsorized_score) OVER w > 1e-12 THEN stddev_samp(winsorized_score) OVER w END, 0) END AS z_score FROM wins WINDOW w AS (PARTITION BY date, factor_name)),
    sized AS (SELECT z.*, coalesce(sector, 'Unknown') AS s, ln(CASE WHEN coalesce(px * shares_outstanding, 1) > 0 THEN coalesce(px * shares_outstanding, 1) END) AS x FROM z LEFT JOIN me USING (date, ticker) LEFT JOIN meta USING (ticker)),
    dm AS (SELECT *, x - avg(x) OVER s AS xd, y - avg(y) OVER s AS yd, count(y) OVER w AS n, k FROM (SELECT *, CASE WHEN x IS NOT NULL THEN z_score END AS y FROM (SELECT * EXCLUDE (x), CASE WHEN z_score IS NOT NULL THEN x END AS x FROM sized)) LEFT JOIN
        (SELECT date, factor_name, count(DISTINCT s) AS k FROM sized WHERE z_score IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2) USING (date, factor_name)
        WINDOW s AS (PARTITION BY date, factor_name, s), w AS (PARTITION BY date, factor_name)),
    scores AS (SELECT date, ticker, factor_name, round(raw_score, 9) + 0.0 AS raw_score, round(winsorized_score, 9) + 0.0 AS winsorized_score, round(z_score, 9) + 0.0 AS z_score,
        round(CASE WHEN n <= 1 + k THEN y ELSE yd - coalesce(sum(xd * yd) OVER w / nullif(sum(round(xd * xd, 12)) OVER w, 0), 0) * xd END, 9) + 0.0 AS final_score FROM dm WINDOW w AS (PARTITION BY date, factor_name)),
    fwd AS (SELECT date, ticker, lead(simple_return) OVER (PARTITION BY ticker ORDER BY date) AS fwd FROM (SELECT DISTINCT date FROM mret) CROSS JOIN (SELECT DISTINCT ticker FROM mret) LEFT JOIN mret USING (date, ticker)),
    {stage("", "final_score")},
    bt AS (SELECT factor_name AS backtest_name, date, ticker, final_score AS score FROM scores WHERE final_score IS NOT NULL AND date IN (SELECT date FROM mret)),
    rkd AS (SELECT *, row_number() OVER (PARTITION BY backtest_name, date ORDER BY score DESC, ticker) AS top, row_number() OVER (PARTITION BY backtest_name, date ORDER BY score, ticker DESC) AS low, greatest(1, CAST(ceil(round(count(*) OVER (PARTITION BY backtest_name, date) * 0.2, 9)) AS INTEGER)) AS k FROM bt),
    wts AS (SELECT backtest_name, date, ticker, 1.0::DOUBLE / k AS weight FROM rkd WHERE top <= k),
    idx AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bt)),
    wi AS (SELECT * FROM wts JOIN idx USING (date)),
    span AS (SELECT backtest_name, min(i) AS first, max(i) AS last FROM wi GROUP BY 1),
    mv0 AS (SELECT backtest_name, ticker, i, coalesce(n.weight, 0) AS target, coalesce(o.weight, 0) AS old FROM wi n FULL JOIN (SELECT backtest_name, ticker, i + 1 AS i, weight FROM wi) o USING (backtest_name, ticker, i)),
    mv1 AS (SELECT mv0.*, date, first, coalesce(simple_return, 0) AS r FROM mv0 JOIN span USING (backtest_name) JOIN idx USING (i) LEFT JOIN mret USING (date, ticker) WHERE i BETWEEN first AND last),
    mv2 AS (SELECT *, sum(old * r) OVER (PARTITION BY backtest_name, i) AS g FROM mv1),
    mv3 AS (SELECT *, CASE WHEN g > -0.999 THEN old * (1 + r) / (1 + g) ELSE old END AS d1 FROM mv2),
    mv4 AS (SELECT *, sum(d1 * r) OVER (PARTITION BY backtest_name, i) AS g2 FROM mv3),
    mv AS (SELECT backtest_name, date, i, first, ticker, target, g, CASE WHEN g2 > -0.999 THEN d1 * (1 + r) / (1 + g2) ELSE d1 END AS drifted FROM mv4),
    rs0 AS (SELECT backtest_name, date, i = first AS f, max(g) AS g, sum(abs(target - drifted)) AS turnover, sum(abs(target - drifted)) * 10 / 1e4 AS tc FROM mv GROUP BY backtest_name, date, i, first),
    rs1 AS (SELECT *, CASE WHEN f THEN -tc ELSE (1 + g) * (1 - lag(tc) OVER (PARTITION BY backtest_name ORDER BY date)) - 1 END AS net FROM rs0),
    rs2 AS (SELECT *, 1e7 * product(1 + net) OVER (PARTITION BY backtest_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM rs1),
    results AS (SELECT backtest_name, date, CASE WHEN f THEN 0 ELSE g END AS gross_return, net AS net_return, v AS portfolio_value, v / max(v) OVER (PARTITION BY backtest_name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, turnover, tc AS transaction_costs FROM rs2),
    {features("", sorted(PRICE + VALUE))},
    mpx AS (SELECT date, median(adj_close) AS px FROM px GROUP BY 1),
    rf0 AS (SELECT date, px, px / lag(px) OVER (ORDER BY date) - 1 AS ret, px / lag(px, 252) OVER (ORDER BY date) - 1 AS mom FROM mpx),
    rf1 AS (SELECT *, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS vol FROM rf0 JOIN wide USING (date) WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
    rf2 AS (SELECT date, vol AS market_vol, mom AS market_mom, VIXCLS AS vix_level, VIXCLS - lag(VIXCLS) OVER (ORDER BY date) AS vix_change, DGS10 - DGS2 AS yield_slope, BAMLH0A0HYM2 AS credit_spread, 0.02::DOUBLE AS gdp_growth FROM rf1),
    feats AS (SELECT date, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in ("market_vol", "market_mom", "vix_level", "vix_change", "yield_slope", "credit_spread", "gdp_growth"))} FROM rf2),
    states AS (SELECT date, CAST((year(date) * 12 + month(date)) // 5 % 4 AS INTEGER) AS regime_id FROM feats),
    member AS (SELECT date, ticker, coalesce(adv / 1e9 >= 0 AND adv >= bar AND date - first >= 12 * 30.44, false) AS in_universe, adv / 1e9 AS market_cap_proxy, adv AS avg_dollar_vol, (date - first)::INTEGER AS days_since_first_price FROM
        (SELECT *, CASE WHEN count(dv) OVER w >= 30 THEN avg(dv) OVER w END AS adv, min(CASE WHEN adj_close IS NOT NULL THEN date END) OVER (PARTITION BY ticker) AS first FROM (SELECT *, adj_close * volume AS dv FROM grid) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
        JOIN (SELECT date, quantile_cont(adv, 0.5) AS bar FROM (SELECT date, CASE WHEN count(dv) OVER w >= 30 THEN avg(dv) OVER w END AS adv FROM (SELECT *, adj_close * volume AS dv FROM grid) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY 1) USING (date) WHERE adj_close IS NOT NULL),
    mpanel AS (SELECT date, ticker, simple_return AS value FROM (SELECT DISTINCT date FROM mret) CROSS JOIN (SELECT DISTINCT ticker FROM mret) LEFT JOIN mret USING (date, ticker)),
    dpanel AS (SELECT date, ticker, simple_return AS value FROM (SELECT DISTINCT date FROM dret) CROSS JOIN (SELECT DISTINCT ticker FROM dret) LEFT JOIN dret USING (date, ticker)),
    mmem AS ({asof("mpanel", "member", ["in_universe"])})
    """


def _metrics(x: str, name: str) -> str:
    """All metrics of one stage."""
    sharpe = ", ".join(f"CASE WHEN count(return_{c}) = count(*) AND stddev_pop(return_{c}) > 0 THEN sqrt(12.0) * avg(return_{c}) / stddev_pop(return_{c}) ELSE 0 END AS sharpe_{c}" for c in ("q1", "q5", "ls"))
    life = "CASE WHEN count(*) FILTER (autocorr > 0) >= 2 AND sum(CASE WHEN autocorr > 0 THEN -lag * ln(autocorr) END) > 0 THEN ln(2.0) * sum(CASE WHEN autocorr > 0 THEN lag * lag END) / sum(CASE WHEN autocorr > 0 THEN -lag * ln(autocorr) END) ELSE 0 END"
    lags = ", ".join(f"max(autocorr) FILTER (lag = {k}) AS autocorr_lag{k}" for k in range(1, 7))
    each = ["ic_mean", "ic_std", "icir", "sharpe_q1", "sharpe_q5", "sharpe_ls", "half_life", *(f"autocorr_lag{k}" for k in range(1, 7))]
    return f"""SELECT factor_name, date, '{name}' AS stage, 'ic' AS metric_name, ic AS value FROM ics{x}
        UNION ALL SELECT factor_name, date, '{name}', metric_name, value FROM qret{x} UNPIVOT INCLUDE NULLS (value FOR metric_name IN (return_q1, return_q5, return_ls))
        UNION ALL SELECT factor_name, date, '{name}', metric_name, value FROM (SELECT * FROM (SELECT factor_name, ic_mean::DOUBLE AS ic_mean, ic_std::DOUBLE AS ic_std, icir::DOUBLE AS icir, {", ".join(f"{c}::DOUBLE AS {c}" for c in each[3:])} FROM
            (SELECT factor_name, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, CASE WHEN stddev_samp(ic) = 0 THEN 0 ELSE avg(ic) / stddev_samp(ic) END AS icir FROM ics{x} GROUP BY 1)
            FULL JOIN (SELECT factor_name, {sharpe} FROM qret{x} WHERE return_ls IS NOT NULL GROUP BY 1) USING (factor_name) FULL JOIN (SELECT factor_name, {life} AS half_life, {lags} FROM ac{x} GROUP BY 1) USING (factor_name)) UNPIVOT INCLUDE NULLS (value FOR metric_name IN ({", ".join(each)})))
            JOIN (SELECT factor_name, max(date) AS date FROM pairs{x} GROUP BY 1) USING (factor_name)"""


def fama_macbeth(names: list[str]) -> str:
    """Cross-sectional regressions: correlations of each date, and Gauss-Jordan elimination over lists."""
    k, y = len(names), "CASE WHEN stddev_pop(fwd) > 0 THEN stddev_pop(fwd) ELSE 1 END"
    cell = lambda a, b: "1.0" if a == b else f"covar_pop({a}, {b}) / (stddev_pop({a}) * {y if b == 'fwd' else f'stddev_pop({b})'})"
    rows = ", ".join(f"[{', '.join(cell(a, b) for b in [*names, 'fwd'])}]" for a in names)
    flat = " OR ".join(f"max({n}) = min({n})" for n in names)
    return f""", fm0 AS (SELECT date, {y} AS y, [{", ".join(f"stddev_pop({n})" for n in names)}] AS sd, [{rows}] AS m FROM panel GROUP BY date HAVING count(*) >= {k + 2} AND NOT ({flat})),
    fm1 AS (SELECT date, y, sd, list_reduce(list_prepend(m, list_transform(range(1, {k + 1}), lambda i: [[i::DOUBLE]])), lambda m, s: CASE WHEN m[s[1][1]::INT][s[1][1]::INT] > 1e-10 THEN
        list_transform(m, lambda r, j: list_transform(range(1, {k + 2}), lambda c: CASE WHEN j = s[1][1]::INT THEN r[c] / m[s[1][1]::INT][s[1][1]::INT] ELSE r[c] - m[s[1][1]::INT][c] * r[s[1][1]::INT] / m[s[1][1]::INT][s[1][1]::INT] END))
        ELSE list_transform(m, lambda r, j: list_transform(r, lambda x: CASE WHEN j = s[1][1]::INT THEN 0 ELSE x END)) END) AS m FROM fm0),
    fmb AS (SELECT date, names[i] AS factor_name, m[i][{k + 1}] * y / sd[i] AS beta FROM (SELECT *, {names!r} AS names, unnest(range(1, {k + 1})) AS i FROM fm1)),
    fmw AS (SELECT date, factor_name, coalesce(mean / nullif(sum(abs(mean)) OVER (PARTITION BY date), 0), 1.0 / count(*) OVER (PARTITION BY date)) AS weight FROM (SELECT date, factor_name, avg(beta) OVER (PARTITION BY factor_name ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS mean FROM fmb))"""


MOMENTS = "avg(value) AS mean, stddev_samp(value) AS std, {}skewness(value) AS skewness, CASE WHEN count(value) >= 4 THEN kurtosis(value) END AS excess_kurtosis".format
#: Name: (kind of ticker, digits, columns and types as in the query, SELECT)
SELECTS = {
    "dense_grid": ("supplier", "SELECT * FROM grid"),
    "daily_returns": ("supplier", "SELECT * FROM dret"),
    "monthly_returns": ("supplier", "SELECT * FROM mret"),
    "stored_returns": ("bucket", "SELECT *, 'daily' AS freq FROM dret UNION ALL SELECT *, 'monthly' FROM mret"),
    "validate_index": ("bucket", """SELECT t AS index_ticker, c AS correlation, coalesce(c >= 0.3, false) AS valid FROM (SELECT min(t) AS t, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS c FROM
        (SELECT date, (SELECT min(ticker) FROM mret) AS t, avg(simple_return) AS a, max(CASE WHEN ticker = (SELECT min(ticker) FROM mret) THEN simple_return END) AS b FROM mret GROUP BY date) WHERE a IS NOT NULL AND b IS NOT NULL)"""),
    "universe_membership": ("bucket", "SELECT * FROM member"),
    "universe_size": ("bucket", "SELECT date, count(*) FILTER (in_universe) AS n_members, count(*) AS n_total, count(*) FILTER (in_universe) / count(*) AS inclusion_rate FROM member GROUP BY date"),
    "asof_membership": ("bucket", "SELECT date, ticker, in_universe FROM mmem WHERE in_universe IS NOT NULL"),
    "fill_gaps_drop": ("bucket", """SELECT date, ticker, value FROM dpanel WHERE ticker NOT IN (SELECT ticker FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - row_number() OVER (PARTITION BY ticker, value IS NULL ORDER BY date) AS g, value FROM dpanel) WHERE value IS NULL GROUP BY ticker, g HAVING count(*) > 14)"""),
    "trim_by_universe": ("bucket", "SELECT date, ticker, CASE WHEN in_universe THEN value END AS value FROM mpanel LEFT JOIN mmem USING (date, ticker)"),
    "xs_stats": ("supplier", f"SELECT date, {MOMENTS('median(value) AS median, ')}, avg(CASE WHEN value IS NOT NULL THEN (value > 0)::INTEGER END) AS pct_positive, nullif(count(value), 0) AS n_stocks FROM mpanel GROUP BY date"),
    "annual_stats": ("supplier", f"SELECT year(date)::INTEGER AS year, count(*) AS n_obs, {MOMENTS('')}, min(value) AS min, max(value) AS max FROM mpanel WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"),
    "distribution_tests": ("bucket", """SELECT n, n / 6 * (sk * sk + ku * ku / 4) AS jarque_bera, exp(-(n / 6 * (sk * sk + ku * ku / 4)) / 2) AS p_value, q[1] AS p01, q[2] AS p25, q[3] AS p50, q[4] AS p75, q[5] AS p99 FROM
        (SELECT count(*) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS sk, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 AS ku, quantile_cont(value, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM (SELECT value, value - (SELECT avg(value) FROM mpanel) AS d FROM mpanel WHERE value IS NOT NULL))"""),
    "panel_summary": ("bucket", "SELECT count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, count(value) AS n_values, min(date) AS first_date, max(date) AS last_date, count(DISTINCT year(date)) AS n_years FROM mpanel"),
    **{f"factor_{n}": ("supplier" if n in PRICE + VALUE + EVENT else "bucket", f"SELECT date, ticker, {n} AS raw_score FROM {f}") for names, f in ((PRICE, "f_price"), (VALUE, "f_value"), (RISK, "f_risk"), (EVENT, "f_event")) for n in names},
    "winsorize": ("bucket", "SELECT date, ticker, factor_name, winsorized_score FROM scores"),
    "zscore": ("bucket", "SELECT date, ticker, factor_name, z_score FROM scores"),
    "neutralize": ("bucket", "SELECT date, ticker, factor_name, final_score FROM scores"),
    "factor_scores_long": ("bucket", "SELECT * FROM scores"),
    "ic_series": ("bucket", "SELECT * FROM ics"),
    "ic_summary": ("bucket", "SELECT factor_name, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, CASE WHEN stddev_samp(ic) = 0 THEN 0 ELSE avg(ic) / stddev_samp(ic) END AS icir, count(ic) AS n_dates FROM ics GROUP BY 1"),
    "quintile_returns": ("bucket", "SELECT * FROM qret"),
    "quintile_sharpe": ("bucket", "SELECT factor_name, " + ", ".join(f"CASE WHEN count(return_{c}) = count(*) AND stddev_pop(return_{c}) > 0 THEN sqrt(12.0) * avg(return_{c}) / stddev_pop(return_{c}) ELSE 0 END AS sharpe_{c}" for c in ("q1", "q5", "ls")) + " FROM qret WHERE return_ls IS NOT NULL GROUP BY 1"),
    "score_autocorr": ("bucket", "SELECT * FROM ac"),
    "half_life": ("bucket", "SELECT factor_name, CASE WHEN n >= 2 AND xy / xx > 0 THEN ln(2.0) / (xy / xx) ELSE 0 END AS half_life FROM (SELECT factor_name, count(*) FILTER (autocorr > 0) AS n, sum(CASE WHEN autocorr > 0 THEN -lag * ln(autocorr) END) AS xy, sum(CASE WHEN autocorr > 0 THEN lag * lag END) AS xx FROM ac GROUP BY 1)"),
    "factor_metrics": ("bucket", f"{_metrics('_raw', 'raw')} UNION ALL {_metrics('', 'final')}"),
    "rebalance_schedule": ("bucket", "SELECT max(date) AS date FROM px GROUP BY date_trunc('month', date)"),
    "topk_weights": ("bucket", "SELECT * FROM wts"),
    "long_short_weights": ("bucket", "SELECT backtest_name, date, ticker, CASE WHEN l THEN 0.5 / nullif(count(*) FILTER (l) OVER w, 0) ELSE -0.5 / nullif(count(*) FILTER (s) OVER w, 0) END AS weight FROM (SELECT *, top <= k AND low > k AS l, low <= k AND top > k AS s FROM rkd) WHERE l OR s WINDOW w AS (PARTITION BY backtest_name, date)"),
    "active_scores": ("bucket", """SELECT factor_name AS backtest_name, date, ticker, final_score AS score FROM scores LEFT JOIN (SELECT date, ticker, in_universe FROM amem WHERE in_universe IS NOT NULL) USING (date, ticker)
        WHERE in_universe OR date NOT IN (SELECT date FROM amem WHERE in_universe IS NOT NULL)"""),
    "trades": ("bucket", "SELECT backtest_name, date, ticker, CASE WHEN c > 0 THEN 'buy' ELSE 'sell' END AS trade_type, c AS weight_change, abs(c) AS turnover_contribution FROM (SELECT *, round(target - drifted, 9) AS c FROM mv) WHERE c <> 0 AND i > first"),
    "backtest_results": ("bucket", "SELECT * REPLACE (ln(portfolio_value / 1e7) AS portfolio_value) FROM results"),
    "monthly_grid": ("bucket", "SELECT backtest_name, year(date)::INTEGER AS year, " + ", ".join(f"coalesce(product(1 + net_return) FILTER (month(date) = {m}) - 1, 0) AS m{m:02}" for m in range(1, 13)) + ", product(1 + net_return) - 1 AS total FROM results GROUP BY 1, 2"),
    "backtest_metrics": ("bucket", """SELECT backtest_name, metric_name, value FROM (SELECT backtest_name, cum AS cumulative_return_net, gcum AS cumulative_return_gross, pow(1 + cum, 12.0 / n) - 1 AS cagr_net, dd AS max_drawdown, win AS win_rate, tu AS average_turnover, sd * sqrt(12.0) AS annualized_volatility,
        CASE WHEN sd <= 1e-12 THEN 0 ELSE m / sd * sqrt(12.0) END AS sharpe_ratio, coalesce(m / nullif(down, 0) * sqrt(12.0), 0) AS sortino_ratio, CASE WHEN abs(dd) > 1e-12 THEN (pow(1 + cum, 12.0 / n) - 1) / abs(dd) END AS calmar_ratio, tu * 12 AS annualized_turnover FROM
        (SELECT backtest_name, count(net) AS n, product(1 + net) - 1 AS cum, product(1 + gr) - 1 AS gcum, avg(net) AS m, coalesce(stddev_samp(net), 0) AS sd, sqrt(avg(net * net) FILTER (net < 0)) AS down, coalesce(min(eq / pk - 1), 0) AS dd, avg(CASE WHEN net IS NOT NULL THEN (net > 0)::INTEGER END) AS win, avg(turnover) AS tu FROM
        (SELECT *, max(eq) OVER (PARTITION BY backtest_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, product(1 + net) OVER (PARTITION BY backtest_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM
        (SELECT *, CASE WHEN k > 1 THEN net_return END AS net, CASE WHEN k > 1 THEN gross_return END AS gr FROM (SELECT *, row_number() OVER (PARTITION BY backtest_name ORDER BY date) AS k FROM results)))) GROUP BY 1)) UNPIVOT INCLUDE NULLS (value FOR metric_name IN (cumulative_return_net, cumulative_return_gross, cagr_net, max_drawdown, win_rate, average_turnover, annualized_volatility, sharpe_ratio, sortino_ratio, calmar_ratio, annualized_turnover))"""),
    "annual_perf": ("bucket", """SELECT backtest_name, year, annual_return, sd * sqrt(12.0) AS volatility, CASE WHEN sd > 1e-12 THEN m / sd * sqrt(12.0) ELSE 0 END AS sharpe, dd AS max_drawdown FROM (SELECT backtest_name, year, count(*) AS n, min(k) AS k, product(1 + net_return) - 1 AS annual_return, coalesce(stddev_samp(net_return), 0) AS sd, avg(net_return) AS m, min(eq / pk - 1) AS dd FROM
        (SELECT *, max(eq) OVER (PARTITION BY backtest_name, year ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, row_number() OVER (PARTITION BY backtest_name ORDER BY date) AS k, product(1 + net_return) OVER (PARTITION BY backtest_name, year(date) ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq, year(date)::INTEGER AS year FROM results)) GROUP BY 1, 2) WHERE NOT (n = 1 AND k = 1)"""),
    "method_comparison": ("bucket", "SELECT backtest_name, " + ", ".join(f"CASE WHEN count(net) FILTER ({w}) > 0 THEN CASE WHEN coalesce(stddev_samp(net) FILTER ({w}), 0) <= 1e-12 THEN 0 ELSE avg(net) FILTER ({w}) / stddev_samp(net) FILTER ({w}) * sqrt(12.0) END END AS {n}_sharpe, min(\"{n}\" / {n}m - 1) FILTER ({w}) AS {n}_max_dd" for n, w in (("full", "true"), ("oos", "date >= '1996-01-01'"))) + """ FROM
        (SELECT *, max("full") OVER (PARTITION BY backtest_name ORDER BY date) AS fullm, max(oos) OVER (PARTITION BY backtest_name ORDER BY date) AS oosm FROM (SELECT backtest_name, date, net_return AS net, product(1 + net_return) OVER (PARTITION BY backtest_name ORDER BY date) AS "full",
        CASE WHEN date >= '1996-01-01' THEN product(CASE WHEN date >= '1996-01-01' THEN 1 + net_return ELSE 1 END) OVER (PARTITION BY backtest_name ORDER BY date) END AS oos FROM (SELECT *, row_number() OVER (PARTITION BY backtest_name ORDER BY date) AS k FROM results) WHERE k > 1)) GROUP BY 1"""),
    "drawdown_spans": ("bucket", "SELECT backtest_name, min(date) AS start_date, max(date) AS end_date, count(*) AS n_dates, min(drawdown) AS depth FROM (SELECT *, count(*) FILTER (drawdown >= -1e-12) OVER (PARTITION BY backtest_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM results) WHERE drawdown < -1e-12 GROUP BY backtest_name, g"),
    "return_histogram": ("bucket", "SELECT bin::INTEGER AS bin, a + bin * (b - a) / 50 AS low, a + (bin + 1) * (b - a) / 50 AS high, count(*) AS n FROM (SELECT a, b, least(coalesce(floor((value - a) / nullif(b - a, 0) * 50), 0), 49) AS bin FROM mpanel CROSS JOIN (SELECT min(value) AS a, max(value) AS b FROM mpanel) WHERE value IS NOT NULL) GROUP BY bin, a, b"),
    "normal_quantiles": ("bucket", "SELECT p, m + s * z AS theoretical, o AS observed FROM (VALUES " + ", ".join(f"({(i + 1) / 20}::DOUBLE, {NormalDist().inv_cdf((i + 1) / 20)!r}::DOUBLE, {i + 1})" for i in range(19)) + ") v(p, z, i) JOIN (SELECT unnest(q) AS o, unnest(range(1, 20)) AS i, m, s FROM (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, [" + ", ".join(str((i + 1) / 20) for i in range(19)) + "]) AS q FROM mpanel)) USING (i)"),
    "member_any_by_month": ("bucket", "SELECT last_day(date) AS month, ticker, coalesce(bool_or(in_universe), false) AS any_true FROM member GROUP BY 1, 2"),
    "feature_panel": ("bucket", "SELECT * FROM panel_all"),
    "ic_weights": ("bucket", "SELECT * FROM icw_all"),
    "ic_composite": ("bucket", "SELECT date, ticker, sum(weight * score) AS composite_score FROM plong_all JOIN icw_all USING (date, factor_name) GROUP BY 1, 2"),
    "factor_corr": ("bucket", "SELECT factor_a, factor_b, correlation FROM (SELECT a.factor_name AS factor_a, b.factor_name AS factor_b, covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) AS correlation FROM r a JOIN r b ON a.date = b.date AND a.ticker = b.ticker AND a.factor_name <= b.factor_name GROUP BY 1, 2)"),
    "regime_features": ("bucket", "SELECT * FROM feats"),
    "regime_profile": ("bucket", "SELECT regime_id, feature, mean, (mean - avg(mean) OVER w) / CASE WHEN stddev_samp(mean) OVER w > 1e-12 THEN stddev_samp(mean) OVER w END AS z FROM (SELECT regime_id, feature, avg(value) AS mean FROM (UNPIVOT (SELECT * FROM feats JOIN states USING (date)) ON market_vol, market_mom, vix_level, vix_change, yield_slope, credit_spread, gdp_growth INTO NAME feature VALUE value) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature)"),
    "regime_spans": ("bucket", "SELECT regime_id, min(date) AS start_date, max(date) AS end_date, count(*) AS n_dates FROM (SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY regime_id ORDER BY date) AS g FROM states) GROUP BY regime_id, g"),
    "regime_transitions": ("bucket", "SELECT from_id, to_id, p AS probability, 1 / (1 - max(CASE WHEN from_id = to_id THEN p ELSE 0 END) OVER (PARTITION BY from_id)) AS expected_duration FROM (SELECT from_id, to_id, count(*) / sum(count(*)) OVER (PARTITION BY from_id) AS p FROM (SELECT regime_id AS from_id, lead(regime_id) OVER (ORDER BY date) AS to_id FROM states) WHERE to_id IS NOT NULL GROUP BY 1, 2)"),
    "regime_labels": ("bucket", """SELECT regime_id, CASE WHEN regime_id = bear THEN 'Bear / High-Vol' WHEN regime_id = bull THEN 'Bull Market' WHEN regime_id = shock THEN 'Rate Shock / Stagnation' ELSE 'Neutral / Transition' END AS regime_label FROM m CROSS JOIN (SELECT bear, bull, (SELECT regime_id FROM m WHERE regime_id NOT IN (bear, bull) ORDER BY s, regime_id LIMIT 1) AS shock FROM
        (SELECT bear, (SELECT regime_id FROM m WHERE regime_id <> bear ORDER BY o DESC, regime_id LIMIT 1) AS bull FROM (SELECT regime_id AS bear FROM m ORDER BY v DESC, regime_id LIMIT 1)))"""),
    "macro_unpivot": ("bucket", "SELECT date, series_name, value FROM macro"),
    "macro_filled": ("bucket", "SELECT date, series_name, last_value(value IGNORE NULLS) OVER (PARTITION BY series_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT DISTINCT date FROM macro) CROSS JOIN (SELECT DISTINCT series_name FROM macro) LEFT JOIN macro USING (date, series_name)"),
    "upsert_merge": ("supplier", "SELECT date, ticker, CASE WHEN month(date) IN (6, 12) THEN simple_return + 1 ELSE simple_return END AS simple_return FROM mret"),
    "metadata": ("supplier", "SELECT * FROM meta"),
    "fundamentals": ("supplier", "SELECT * FROM fund"),
    "cap_weights": ("bucket", """SELECT backtest_name, date, ticker, CASE WHEN j < cut THEN cap ELSE a * scale_at END AS weight FROM (SELECT *, min(j) FILTER (fits) OVER w AS cut, min(scale) FILTER (fits AND first_fit) OVER w AS scale_at FROM
        (SELECT *, fits AND count(*) FILTER (fits) OVER (PARTITION BY backtest_name, date ORDER BY j ROWS UNBOUNDED PRECEDING) = 1 AS first_fit FROM (SELECT *, (1 - j * cap) / (1 - above) AS scale, a * ((1 - j * cap) / (1 - above)) <= cap + 1e-12 AS fits FROM capped)) WINDOW w AS (PARTITION BY backtest_name, date))"""),
    "fama_macbeth_coef": ("bucket", "SELECT date, factor_name, beta FROM fmb"),
    "fama_macbeth_weights": ("bucket", "SELECT date, factor_name, weight FROM fmw"),
    "composite_scores": ("bucket", """SELECT date, ticker, 'ic_weighted' AS method, sum(weight * score) AS composite_score FROM plong JOIN icw USING (date, factor_name) GROUP BY 1, 2
        UNION ALL SELECT date, ticker, 'fama_macbeth', sum(weight * score) FROM plong JOIN fmw USING (date, factor_name) GROUP BY 1, 2"""),
    "event_windows": ("bucket", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"),
}
#: First and last date of the queries over a range: each equals the whole result between them.
BETWEEN = (date(1996, 5, 17), date(1997, 9, 30))
RANGES = {"daily_returns_range": "dret", "monthly_returns_range": "mret", "universe_range": "member", "momentum_range": "f_price"}
SELECTS |= {n: ("bucket", f"SELECT * FROM {t} WHERE date BETWEEN '{BETWEEN[0]}' AND '{BETWEEN[1]}'") for n, t in RANGES.items()}
SELECTS["macro_filled_range"] = ("bucket", f"SELECT * FROM ({SELECTS['macro_filled'][1]}) WHERE date BETWEEN '{BETWEEN[0]}' AND '{BETWEEN[1]}'")
#: Digits that are compared; where values are exact quotients, six would end in ties.
DIGITS = {n: 9 for n in ("dense_grid", "macro_unpivot", "macro_filled", "macro_filled_range", "momentum_range", "winsorize", "zscore", "neutralize", "factor_scores_long", "feature_panel", "factor_metrics", "score_autocorr", *(f"factor_{f}" for f in FACTORS))}
DIGITS |= {"avg_dollar_vol": 7}
EXTRA = {
    "active_scores": f", amem AS ({asof('(SELECT DISTINCT date, ticker FROM scores)', 'member', ['in_universe'])})",
    "cap_weights": """, capped AS (SELECT *, row_number() OVER (PARTITION BY backtest_name, date ORDER BY a DESC, ticker) - 1 AS j, coalesce(sum(a) OVER (PARTITION BY backtest_name, date ORDER BY a DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
        greatest(0.4, 1.0 / count(*) OVER (PARTITION BY backtest_name, date)) AS cap FROM (SELECT backtest_name, date, ticker, (k - top + 1) / (k * (k + 1) / 2.0) AS a FROM rkd WHERE top <= k))""",
    **{n: fama_macbeth(sorted(PRICE + VALUE)) for n in ("fama_macbeth_coef", "fama_macbeth_weights", "composite_scores")},
    "factor_metrics": ", " + stage("_raw", "raw_score"),
    **{n: f", {features('_all', FACTORS)}" for n in ("feature_panel", "ic_weights", "ic_composite")},
    "factor_corr": f", {features('_all', FACTORS)}, r AS (" + " UNION ALL ".join(f"SELECT date, ticker, '{n}' AS factor_name, rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS r FROM panel_all" for n in FACTORS) + ")",
    "regime_labels": ", m AS (SELECT regime_id, avg(market_vol) AS v, avg(market_mom) AS o, avg(yield_slope) AS s FROM feats JOIN states USING (date) GROUP BY 1)",
}


def sql(name: str, columns: list[tuple[str, str]]) -> str:
    """The query's SQL, its doubles rounded as the query's are."""
    by, select = SELECTS[name]
    cols = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS.get(c, DIGITS.get(name, 6))}) + 0.0 AS {c}" if t == "double" else f"CAST({c} AS BIGINT) AS {c}" if t == "bigint" else c for c, t in columns)
    return f"{base(by)}{EXTRA.get(name, '')}\n    SELECT {cols} FROM ({select})"
