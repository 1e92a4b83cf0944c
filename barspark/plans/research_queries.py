"""Registered queries: risk, regressions, factor evaluation, signals, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import dealt
from ..functions.numeric import rounded
from ..operators import capm, factors as fac, indicators as ind, ml, risk, signals
from ..operators.ranking import PART_ROWS
from ..sources import datasets
from ..sources.folders import work_folder
from ..streaming import bars as streams
from .oracle import check
from .series_queries import TECH, days, last, macd_sql
from .table_queries import DAYBARS, DERIVED, tradable_sql, with_returns
from .tables import BARS, FACTORS, MARKET, MINUTES, RETS, bars_daily as daily, bars_minute as minute, factor_returns, market, recursive_means, table


def ret(s, d) -> DataFrame:
    return risk.returns_of(daily(s, d))


RET = "ret AS (SELECT ticker, date, ret_d AS ret FROM rets WHERE ret_d IS NOT NULL)"
DAYRET = """dret AS (SELECT * FROM (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret
  FROM days) a WHERE ret IS NOT NULL)"""


def curve_sql(source: str, name: str, keys: str = "ticker") -> str:
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""{name} AS (SELECT *, CASE WHEN hi IS NOT NULL AND hi - prev_hi > 1 THEN hi - prev_hi - 1 END AS recovered_after
      FROM (SELECT *, max(hi) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hi
      FROM (SELECT *, CASE WHEN NOT drawdown < 0 THEN pos END AS hi
      FROM (SELECT *, wealth - 1 AS cumulative_return, (wealth - peak) / nullif(peak, 0) AS drawdown
      FROM (SELECT *, max(wealth) OVER ({w} ROWS UNBOUNDED PRECEDING) AS peak
      FROM (SELECT *, product(1 + ret) OVER ({w} ROWS UNBOUNDED PRECEDING) AS wealth, row_number() OVER ({w}) - 1 AS pos
            FROM {source}) a) b) c) e) f)"""


def report_sql(source: str, keys: str = "ticker") -> str:
    """Over a curve expression."""
    return f"""SELECT *, coalesce(annualized_return / nullif(abs(max_drawdown), 0), 0.0) AS calmar_ratio FROM (
      SELECT {keys}, count(*) AS trading_days, product(1 + ret) - 1 AS total_return, avg(ret) * 252 AS annualized_return,
       stddev(ret) * sqrt(252.0) AS annualized_volatility, coalesce(avg(ret) / nullif(stddev(ret), 0), 0.0) * sqrt(252.0) AS sharpe_ratio,
       coalesce(avg(ret) / nullif(stddev(ret) FILTER (ret < 0), 0), 0.0) * sqrt(252.0) AS sortino_ratio,
       min(drawdown) AS max_drawdown, CAST(coalesce(max(recovered_after), 0) AS INTEGER) AS max_drawdown_days, max(v) AS var_95,
       avg(ret) FILTER (ret <= v) AS cvar_95, count(*) FILTER (ret > 0) / count(*)::DOUBLE AS win_rate,
       CASE WHEN coalesce(sum(ret) FILTER (ret > 0), 0) = 0 AND coalesce(sum(-ret) FILTER (ret < 0), 0) = 0 THEN 0.0
            ELSE coalesce(sum(ret) FILTER (ret > 0), 0) / nullif(coalesce(sum(-ret) FILTER (ret < 0), 0), 0) END AS profit_factor,
       max(ret) AS best_day, min(ret) AS worst_day, avg(ret) AS avg_daily_return
      FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY {keys}) AS v FROM {source}) a GROUP BY {keys}) b"""


_REPORT_ROUND = ("total_return annualized_return annualized_volatility sharpe_ratio sortino_ratio max_drawdown var_95 cvar_95 "
                 "win_rate profit_factor best_day worst_day avg_daily_return calmar_ratio")
_REPORT_PLAIN = "ticker trading_days max_drawdown_days"
CURVE = [BARS, RETS, RET, curve_sql("ret", "curve")]
WILD = {"total_return": 4, "cumulative_return": 7, "annualized_return": 5, "profit_factor": 5}

HUGE = {**WILD, "total_return": -4}


def _report(columns: str):
    plain = "ticker " + " ".join(c for c in columns.split() if c in _REPORT_PLAIN)
    real = " ".join(c for c in columns.split() if c not in _REPORT_PLAIN)
    return (lambda s, d: rounded(risk.report(ret(s, d)).select("ticker", *columns.split()), 6, **WILD),
            check(CURVE, report_sql("curve"), plain, real, 6, WILD))


# --- regressions ------------------------------------------------------------------------------
def pairs(s, d) -> DataFrame:
    bars = daily(s, d)
    return capm.aligned(risk.returns_of(bars), market(bars))


PAIRS = "pairs AS (SELECT ticker, r.date, ret AS y, ret_m AS x FROM ret r JOIN market m ON r.date = m.date)"
CAPM = [BARS, RETS, RET, MARKET, PAIRS, """capm AS (SELECT *, alpha_daily * 252 AS alpha,
   1 - (1 - r_squared) * (n_observations - 1) / (n_observations - 2) AS adj_r_squared, sqrt(s2 / sxx) AS std_error_beta,
   sqrt(s2 * (1.0 / n_observations + mx * mx / sxx)) AS std_error_alpha, beta / sqrt(s2 / sxx) AS t_stat_beta,
   alpha_daily / sqrt(s2 * (1.0 / n_observations + mx * mx / sxx)) AS t_stat_alpha
  FROM (SELECT *, (1 - r_squared) * syy / (n_observations - 2) AS s2 FROM
   (SELECT ticker, count(*) AS n_observations, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha_daily,
           regr_r2(y, x) AS r_squared, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM pairs GROUP BY ticker) a) b
  WHERE n_observations >= 30)"""]
_CAPM = "beta alpha alpha_daily r_squared adj_r_squared std_error_beta std_error_alpha t_stat_beta t_stat_alpha"
_W60 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
ROLL = f"""roll AS (SELECT *, (my - rolling_beta * mx) * 252 AS rolling_alpha FROM
  (SELECT *, CASE WHEN count(*) OVER {_W60} >= 30 THEN covar_samp(y, x) OVER {_W60} / nullif(var_samp(x) OVER {_W60}, 0) END AS rolling_beta,
    avg(y) OVER {_W60} AS my, avg(x) OVER {_W60} AS mx FROM pairs) a)"""


def factor_table(s, d) -> DataFrame:
    return capm.factor_table(factor_returns(s, d))


FROWS_ALIGNED = """fal AS (SELECT ticker, r.date, ret - rf / 100 AS y, 1.0::DOUBLE AS one, mkt_rf / 100 AS mkt_rf, smb / 100 AS smb,
   hml / 100 AS hml, rmw / 100 AS rmw, cma / 100 AS cma FROM ret r JOIN facs f ON r.date = f.date
  WHERE mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND rmw IS NOT NULL AND cma IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY ticker) >= 30)"""


def fit_sql(source: str, factors: list[str]) -> str:
    """Least squares of y per ticker by successive projection: each term is projected off all the others."""
    terms = ["one", *factors]
    over = "OVER (PARTITION BY ticker)"

    def projected(order: list[str]) -> str:
        inner = f"(SELECT ticker, y, y AS e, {', '.join(order)} FROM {source})"
        for i, z in enumerate(order[:-1]):
            rest = [*order[i + 1:], "e"]
            cols = ", ".join(f"{c} - sum({c} * {z}) {over} / sum({z} * {z}) {over} * {z} AS {c}" for c in rest)
            inner = f"(SELECT ticker, y, {cols} FROM {inner} s{i})"
        return inner

    fits = []
    k = len(factors)
    for t in terms:
        last_term = [x for x in terms if x != t] + [t]
        fits.append(f"""SELECT ticker, '{"alpha" if t == "one" else t}' AS term, count(*) AS n_observations,
            sum(e * {t}) / sum({t} * {t}) AS coefficient, sum({t} * {t}) AS zz,
            sum(e * e) - sum(e * {t}) ** 2 / sum({t} * {t}) AS rss, var_pop(y) * count(*) AS tss
            FROM {projected(last_term)} p GROUP BY ticker""")
    return f"""SELECT *, coefficient / std_error AS t_stat FROM (SELECT *,
      sqrt(rss / (n_observations - {k + 1}) / zz) AS std_error, 1 - rss / tss AS r_squared,
      1 - rss / tss * (n_observations - 1) / (n_observations - {k + 1}) AS adj_r_squared FROM ({' UNION ALL '.join(fits)}) u) v"""


def ols_sql(name: str, model: str) -> list[str]:
    return [f"{name} AS (SELECT *, '{model}' AS model FROM ({fit_sql('fal', list(capm.MODELS[model]))}) m)",
            f"""{name}w AS (SELECT ticker, model, max(n_observations) AS n_observations, max(r_squared) AS r_squared,
      max(adj_r_squared) AS adj_r_squared, max(coefficient * 252) FILTER (term = 'alpha') AS alpha,
      max(t_stat) FILTER (term = 'alpha') AS alpha_t_stat,
      {', '.join(f"max(coefficient) FILTER (term = '{t}') AS beta_{t}" for t in capm.MODELS['5-factor'])} FROM {name} GROUP BY ticker, model)"""]


# --- tails of t and F, from the continued fraction of the incomplete beta function ------------------
def _half_sql(x: str, a: str, b: str) -> str:
    return (f"CASE WHEN {x} > 0 THEN exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / "
            f"list_reduce(list_transform(range(300, 0, -1), lambda i: CAST(i AS DOUBLE)), lambda value, m: 1 - ({a} + m - 1) * ({a} + {b} + m - 1) * {x} / (({a} + 2 * m - 2) * ({a} + 2 * m - 1))"
            f" / (1 + m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m)) / value), 1.0::DOUBLE) ELSE 0.0 END")


def beta_sql(x: str, a: str, b: str) -> str:
    return f"(CASE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {_half_sql(f'(1 - {x})', b, a)} ELSE {_half_sql(x, a, b)} END)"


def tail_sql(source: str, tails: dict[str, tuple[str, str]]) -> str:
    """``source`` with the two-sided tail of each statistic: name -> (statistic, degrees of freedom)."""
    inner = ", ".join(f"({v})::DOUBLE / (({v}) + ({t}) ** 2) AS x_{n}, ({v})::DOUBLE / 2 AS a_{n}" for n, (t, v) in tails.items())
    outer = ", ".join(f"{beta_sql(f'x_{n}', f'a_{n}', '0.5::DOUBLE')} AS {n}" for n in tails)
    return f"SELECT * EXCLUDE ({', '.join(f'x_{n}, a_{n}' for n in tails)}), {outer} FROM (SELECT *, {inner} FROM {source}) tails"


def quantile_sql(source: str, freedom: str) -> str:
    """``source`` with ``q``, the upper quantile of 97.5 %, by halving an interval for each number of degrees of freedom."""
    tail = beta_sql("(v / (v + middle ** 2))", "(v / 2)", "0.5::DOUBLE")
    return f"""WITH RECURSIVE halved AS (SELECT DISTINCT ({freedom})::DOUBLE AS v, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 25.0::DOUBLE AS middle, 0 AS turn FROM {source}
      UNION ALL SELECT v, CASE WHEN tail > 0.05 THEN middle ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE middle END,
        CASE WHEN tail > 0.05 THEN (middle + high) / 2 ELSE (low + middle) / 2 END, turn + 1 FROM (SELECT *, {tail} AS tail FROM halved WHERE turn < 45) h)
      SELECT s.*, middle AS q FROM {source} s JOIN halved ON v = ({freedom}) AND turn = 45"""


CAPM_TAILS = [*CAPM, f"capm_p AS ({tail_sql('capm', {'p_value_beta': ('t_stat_beta', 'n_observations - 2'), 'p_value_alpha': ('t_stat_alpha', 'n_observations - 2')})})",
              f"capm_q AS ({quantile_sql('capm_p', 'n_observations - 2')})",
              """inferred AS (SELECT p.ticker, p.n AS n_observations, c.* EXCLUDE (ticker, n_observations, q), beta - q * std_error_beta AS beta_ci_lower,
               beta + q * std_error_beta AS beta_ci_upper, CASE WHEN p.n < 30 THEN 'Insufficient data: ' || p.n || ' observations (need >= 30)' END AS error
              FROM (SELECT ticker, count(*) AS n FROM pairs GROUP BY ticker) p LEFT JOIN capm_q c ON c.ticker = p.ticker)"""]
FITS = [BARS, RETS, RET, FACTORS, FROWS_ALIGNED]
_FIT = "coefficient std_error t_stat r_squared adj_r_squared"


# --- factor evaluation ---------------------------------------------------------------------------
FACTOR_COLUMNS = ["ret_d", "volume"]
HORIZONS = (1, 5, 10)


def factor_rows(s, d) -> DataFrame:
    return fac.factor_rows(with_returns(s, d), FACTOR_COLUMNS)


def forward(s, d) -> DataFrame:
    size = table(s, d, "lineitem").count() * len(FACTOR_COLUMNS)  # there are no more bars than lines
    return fac.with_forward(dealt(factor_rows(s, d), size, ["factor", "ticker"], PART_ROWS), HORIZONS)


def _lead(h: int) -> str:
    return f"lead(close, {h}) OVER (PARTITION BY factor, ticker ORDER BY date) / nullif(close, 0) - 1"


FROWS = """frows AS (SELECT ticker, date, close, 'ret_d' AS factor, ret_d AS value FROM rets WHERE ret_d IS NOT NULL
  UNION ALL SELECT ticker, date, close, 'volume', volume::DOUBLE FROM rets)"""
FPAIRS = "fpairs AS (" + " UNION ALL ".join(
    f"SELECT *, CAST({h} AS INTEGER) AS horizon, {_lead(h)} AS fwd FROM frows" for h in HORIZONS) + ")"


def rank_sql(value: str, group: str) -> str:
    return (f"(rank() OVER (PARTITION BY {group} ORDER BY {value}) + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0::DOUBLE)")


def corr_sql(a: str, b: str) -> str:
    def part(x, y):
        return f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y}))"
    return f"{part(a, b)}::DOUBLE / nullif(sqrt({part(a, a)}::DOUBLE) * sqrt({part(b, b)}::DOUBLE), 0)"


def ic_sql(group: str = "factor, horizon, date", source: str = "fpairs") -> str:
    return f"""SELECT * FROM (SELECT {group}, {corr_sql('rv', 'rf')} AS ic, count(*) AS names
      FROM (SELECT *, {rank_sql('value', group)} AS rv, {rank_sql('fwd', group)} AS rf FROM {source} WHERE fwd IS NOT NULL) a
      GROUP BY {group}) b WHERE names >= 10"""


FE = [BARS, RETS, FROWS, FPAIRS, f"ics AS ({ic_sql()})"]


def summary_sql(source: str, by: str = "") -> str:
    return f"""SELECT *, coalesce(mean_ic / nullif(std_ic / sqrt(days), 0), 0.0) AS t_stat FROM
      (SELECT factor, horizon{by}, avg(ic) AS mean_ic, stddev(ic) AS std_ic, count(*) AS days,
        count(*) FILTER (ic > 0) / count(*)::DOUBLE AS positive_share FROM {source} GROUP BY factor, horizon{by}) s"""


BINS = """edges AS (SELECT factor, date, list_sort(list_distinct([min(value), quantile_cont(value, 0.2::DOUBLE),
   quantile_cont(value, 0.4::DOUBLE), quantile_cont(value, 0.6::DOUBLE), quantile_cont(value, 0.8::DOUBLE), max(value)])) AS e FROM frows GROUP BY 1, 2),
 bins AS (SELECT f.*, CASE WHEN len(e) > 1 THEN CAST(greatest(1, len(list_filter(e, lambda x: x < value))) AS INTEGER) END AS quantile
  FROM frows f JOIN edges g ON f.factor = g.factor AND f.date = g.date)"""
QPAIRS = "qpairs AS (" + " UNION ALL ".join(
    f"SELECT *, CAST({h} AS INTEGER) AS horizon, {_lead(h)} AS fwd FROM bins" for h in HORIZONS) + ")"
QRET = """qret AS (SELECT factor, horizon, quantile, avg(fwd) AS mean_return, count(fwd) AS rows FROM qpairs
  WHERE quantile IS NOT NULL GROUP BY 1, 2, 3)"""
SPREAD = """spr AS (SELECT factor, horizon, CASE WHEN count(*) >= 2 THEN arg_max(mean_return, quantile) - arg_min(mean_return, quantile)
  ELSE 0.0 END AS spread FROM qret GROUP BY 1, 2)"""
FRET = """fmean AS (SELECT factor, horizon, date, avg(value) AS m FROM fpairs WHERE fwd IS NOT NULL GROUP BY 1, 2, 3),
 fret AS (SELECT f.factor, f.horizon, f.date, sum((value - m) * fwd) / nullif(sum(abs(value - m)), 0) AS factor_return
  FROM fpairs f JOIN fmean USING (factor, horizon, date) WHERE fwd IS NOT NULL GROUP BY 1, 2, 3)"""
RANKED = f"""rk AS (SELECT *, lag(rank) OVER (PARTITION BY factor, ticker ORDER BY date) AS rank_before
  FROM (SELECT *, {rank_sql('value', 'factor, date')} AS rank FROM frows) a)"""


def binned(s, d) -> DataFrame:
    return fac.with_forward(fac.quantile_bins(factor_rows(s, d)), HORIZONS)


def sectors(df: DataFrame) -> DataFrame:
    """A stand-in for sectors: the last digit of the ticker, in four groups."""
    return df.withColumn("sector", F.concat(F.lit("G"), (F.substring("ticker", -1, 1).cast("int") % 4).cast("string")))


# --- signals ---------------------------------------------------------------------------------------
def simulate_sql(source: str, name: str, keys: str = "ticker", fee: float = 0.001, slip: float = 0.001) -> str:
    """``source`` has close, entry and exit."""
    w = f"PARTITION BY {keys} ORDER BY date"
    run = f"({w} ROWS UNBOUNDED PRECEDING)"
    return f"""{name} AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER {run} AS trade, product(1.0 + ret) OVER {run} AS equity FROM (
      SELECT *, (CASE WHEN held = 1 THEN coalesce(close / nullif(pc, 0), 1.0) ELSE 1.0::DOUBLE END)
        * (CASE WHEN opens THEN (1.0::DOUBLE - {fee}) / (1.0::DOUBLE + {slip}) ELSE 1.0::DOUBLE END)
        * (CASE WHEN closes THEN (1.0::DOUBLE - {fee}) * (1.0::DOUBLE - {slip}) ELSE 1.0::DOUBLE END) - 1 AS ret FROM (
      SELECT *, position = 1 AND held = 0 AS opens, position = 0 AND held = 1 AS closes FROM (
      SELECT *, coalesce(lag(position) OVER ({w}), 0) AS held, lag(close) OVER ({w}) AS pc FROM (
      SELECT *, coalesce(last_value(CASE WHEN entry THEN 1 WHEN "exit" THEN 0 END IGNORE NULLS) OVER {run}, 0) AS position
      FROM {source}) a) b) c) e)"""


MACD_SIG = [BARS, macd_sql("bars", "b1", "ticker", "date"),
            "sig AS (SELECT *, cross_up = 1 AS entry, cross_down = 1 AS \"exit\" FROM b1x)"]
RSI_SIG = [*TECH, """sig AS (SELECT *, coalesce(rsi_14 < 30 AND before >= 30, false) AS entry, coalesce(rsi_14 > 70 AND before <= 70, false) AS "exit"
  FROM (SELECT *, lag(rsi_14) OVER (PARTITION BY ticker ORDER BY date) AS before FROM tech) a)"""]


def custom_sig(entry: str, leave: str) -> list[str]:
    return [*TECH, f'sig AS (SELECT *, coalesce({entry}, false) AS entry, coalesce({leave}, false) AS "exit" FROM tech)']


SIM = simulate_sql("sig", "sim")
TRADES = """trd AS (SELECT ticker, CAST(trade AS BIGINT) AS trade, min(date) AS entry_date, max(date) FILTER (closes) AS exit_date,
  product(1 + ret) - 1 AS trade_return, count(*) FILTER (position = 1) AS bars FROM sim WHERE position = 1 OR closes GROUP BY 1, 2)"""


def stats_sql(gate: str = "true") -> list[str]:
    return [SIM, TRADES, curve_sql("(SELECT ticker, date, ret FROM sim)", "acc"),
            f"""st AS (SELECT a.*, coalesce(total_trades, 0) AS total_trades, t.* EXCLUDE (ticker, total_trades) FROM
             (SELECT ticker, total_return, sharpe_ratio, sortino_ratio, max_drawdown FROM ({report_sql('acc')}) r) a
             LEFT JOIN (SELECT ticker, count(*) AS total_trades, count(*) FILTER (trade_return > 0) / count(*)::DOUBLE AS win_rate,
               CASE WHEN coalesce(sum(trade_return) FILTER (trade_return > 0), 0) = 0 AND coalesce(sum(-trade_return) FILTER (trade_return < 0), 0) = 0
                    THEN 0.0 ELSE coalesce(sum(trade_return) FILTER (trade_return > 0), 0)
                    / nullif(coalesce(sum(-trade_return) FILTER (trade_return < 0), 0), 0) END AS profit_factor,
               avg(trade_return) FILTER (trade_return > 0) AS avg_winning_trade, max(trade_return) AS best_trade, min(trade_return) AS worst_trade
              FROM trd GROUP BY ticker) t ON a.ticker = t.ticker)"""]


_STATS = "total_return sharpe_ratio sortino_ratio max_drawdown win_rate profit_factor avg_winning_trade best_trade worst_trade"
_STATS_SPECIAL = {"total_return": 5, "profit_factor": 5, "best_trade": 5, "avg_winning_trade": 5}
_DRAWN_SPECIAL = {"return_95pct": 5}


def _mixed_sql(x: str, source: str, keep: str) -> str:
    """``source`` with the mixed number ``m``, one subquery per step as no step may repeat the ones before."""
    out = f"SELECT {keep}, {x} AS m FROM {source}"
    for shift, factor in ((16, 569420461), (15, 1935289751)):
        out = f"SELECT {keep}, (xor(m, m >> {shift}) * {factor}) % 2147483648 AS m FROM ({out}) x"
    return out


BOOTSTRAP_SQL = [
    "slot AS (SELECT ticker, 1 + trade_return AS growth, row_number() OVER (PARTITION BY ticker ORDER BY trade) - 1 AS at FROM trd)",
    "size AS (SELECT ticker, count(*) AS n, ('0x' || substr(md5(ticker), 1, 7))::BIGINT AS own FROM slot GROUP BY ticker)",
    "sims AS (" + _mixed_sql("(own + 42 + sim * 1000003) % 2147483648", "(SELECT *, unnest(range(1, 1001)) AS sim FROM size) z", "ticker, n, sim") + ")",
    "drawn AS (" + _mixed_sql("(base + k) % 2147483648", "(SELECT ticker, n, sim, m AS base, unnest(range(1, n + 1)) AS k FROM sims) y", "ticker, n, sim") + ")",
    """ends AS (SELECT d.ticker, sim, product(growth) - 1 AS result FROM drawn d JOIN slot s ON s.ticker = d.ticker AND s.at = (d.m * d.n) >> 31
      GROUP BY d.ticker, sim)"""]
REGIMES = [("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1998-12-31"), ("late", "1998-07-01", "2001-12-31")]
GRID = signals.macd_grid((5, 8), (13, 21), (5,))
RSI_GRID = signals.parameter_grid(period=(9, 14), oversold=(30, 35), overbought=(65,))


def technical(s, d) -> DataFrame:
    return ind.technical_features(daily(s, d))


def _signal_rows(make, source):
    return lambda s, d: make(source(s, d)).filter(F.col("entry") | F.col("exit")).select("ticker", "date", "entry", "exit")


_SIG_SQL = 'SELECT ticker, date, entry, "exit" FROM sig WHERE entry OR "exit"'


def _sql(ctes, body):
    return f"WITH {', '.join(ctes)} {body}"


# each bar once per window and phase; the windows of a ticker follow from its own first and last day
SLICES = """slices AS MATERIALIZED (SELECT ticker, date, close, CAST(k AS INTEGER) AS win, unnest(CASE WHEN date = mid THEN ['train', 'test']
   WHEN date < mid THEN ['train'] ELSE ['test'] END) AS phase
  FROM (SELECT ticker, date, close, k, CAST(first + to_months(k) AS DATE) AS a, CAST(first + to_months(k + 6) AS DATE) AS mid,
          CAST(first + to_months(k + 7) AS DATE) AS z, final
        FROM (SELECT *, CAST(unnest(range(greatest(0, date_diff('month', first, date) - 8), date_diff('month', first, date) + 2)) AS INTEGER) AS k
              FROM (SELECT *, min(date) OVER (PARTITION BY ticker) AS first, max(date) OVER (PARTITION BY ticker) AS final FROM bars) b) c) d
  WHERE date BETWEEN a AND z AND z <= final)"""
_WALK_KEYS = "ticker, win, phase"
_FIGURES_SQL = {"sharpe_ratio": "coalesce(avg(ret) / nullif(stddev(ret), 0), 0.0) * sqrt(252.0)", "total_return": "product(1.0 + ret) - 1",
                "win_rate": "count(*) FILTER (trade_return > 0) / nullif(count(trade_return), 0)::DOUBLE"}


def walk_sql(sets: list[tuple[list[str], dict]], metric: str = "sharpe_ratio") -> list[str]:
    """Every set of parameters (with the tables that lead to its signals ``g<i>``) traded and measured in every slice."""
    keys, names = _WALK_KEYS, list(sets[0][1])
    out, stats = [BARS, SLICES], []
    for i, (tables, values) in enumerate(sets):
        out += [*tables, simulate_sql(f"g{i}", f"v{i}", keys)]
        own = ", ".join(f"{float(v)}::DOUBLE AS {k}" for k, v in values.items())
        if metric in ("sharpe_ratio", "total_return"):
            deciding, joined = _FIGURES_SQL[metric], ""
        else:
            out += [f"t{i} AS (SELECT {keys}, trade, product(1 + ret) - 1 AS trade_return FROM v{i} WHERE position = 1 OR closes GROUP BY ALL)",
                    f"f{i} AS (SELECT {keys}, {_FIGURES_SQL[metric]} AS figure FROM t{i} GROUP BY ALL)"]
            deciding, joined = "any_value(figure)", f"LEFT JOIN f{i} USING ({keys})"
        stats.append(f"""SELECT {keys}, {i} AS param, {own}, {deciding} AS figure, {_FIGURES_SQL['total_return']} AS total_return,
          {_FIGURES_SQL['sharpe_ratio']} AS sharpe FROM v{i} {joined} GROUP BY {keys}""")
    return [*out, f"wst AS MATERIALIZED ({' UNION ALL '.join(stats)})",
            """best AS (SELECT * FROM wst WHERE phase = 'train' AND figure IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY ticker, win ORDER BY round(figure, 9) DESC, param) = 1)""",
            f"""walk AS (SELECT b.ticker, b.win AS "window", {', '.join('b.' + n for n in names)}, b.figure AS train_metric,
              t.total_return AS test_return, t.sharpe AS test_sharpe FROM best b JOIN wst t ON t.ticker = b.ticker
              AND t.win = b.win AND t.param = b.param AND t.phase = 'test')"""]


def _macd_walk(metric: str = "sharpe_ratio") -> list[str]:
    return walk_sql([([macd_sql("slices", f"w{i}", _WALK_KEYS, "date", g["fast"], g["slow"], g["signal"]),
                       f"g{i} AS MATERIALIZED (SELECT *, cross_up = 1 AS entry, cross_down = 1 AS \"exit\" FROM w{i}x)"], g) for i, g in enumerate(GRID)], metric)


def _rsi_walk() -> list[str]:
    out = []
    for i, g in enumerate(RSI_GRID):
        p = g["period"]
        out.append(([f"""m{i} AS (SELECT *, greatest(step, 0.0) AS gain, greatest(-step, 0.0) AS loss
                       FROM (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY {_WALK_KEYS} ORDER BY date), 0.0) AS step FROM slices) a)""",
                     recursive_means(f"m{i}", _WALK_KEYS, "date", {"eg": ("gain", p), "el": ("loss", p)}, "z.* EXCLUDE (p)", f"s{i}"),
                     f"""g{i} AS MATERIALIZED (SELECT *, coalesce(rsi < {g['oversold']} AND was >= {g['oversold']}, false) AS entry,
                       coalesce(rsi > {g['overbought']} AND was <= {g['overbought']}, false) AS "exit"
                       FROM (SELECT *, lag(rsi) OVER (PARTITION BY {_WALK_KEYS} ORDER BY date) AS was
                             FROM (SELECT *, 100.0 - 100.0 / (1.0 + coalesce(eg / nullif(el, 0), 0.0)) AS rsi FROM s{i}) a) b)"""], g))
    return walk_sql(out, "total_return")


# --- models -----------------------------------------------------------------------------------------
ML_FEATURES = ["rsi_14", "stoch_d", "roc_10", "adx_14", "bb_pct", "hist_vol_20", "strong_trend"]


# the training rows with standardised features, as one group
ML_FIT = [*TECH, f"""mrow AS (SELECT * FROM (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS target,
    count(*) OVER (PARTITION BY ticker) AS cnt FROM tech) a WHERE cnt >= 100 AND target IS NOT NULL
    AND {' AND '.join(f'{c} IS NOT NULL' for c in ML_FEATURES)})""",
          "mstd AS (SELECT 'all' AS ticker, target AS y, 1.0::DOUBLE AS one, "
          + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in ML_FEATURES) + " FROM mrow)",
          f"mfit AS ({fit_sql('mstd', ML_FEATURES)})"]


def model_rows(s, d) -> DataFrame:
    from ..operators.labels import next_day_dataset
    return next_day_dataset(technical(s, d), ML_FEATURES, 100)


def _ml(run):
    """Fit on the whole table.  The rows are kept for the fits and freed with the session's cache."""
    def query(s, d):
        rows = model_rows(s, d).persist()
        try:
            return run(s, rows)
        finally:
            rows.unpersist()
    return query


def _cv(stage, classify=False):
    return _ml(lambda s, rows: rounded(ml.cross_validate(rows, ML_FEATURES, stage, ml.folds(rows), classify)))


def _importance(s, rows):
    model = ml.fit_linear(rows, ML_FEATURES)
    out = ml.permutation_importance(model, rows, ML_FEATURES)
    return rounded(s.createDataFrame(out.collect(), out.schema))  # one row per feature


def _exchanged(s, d):
    return rounded(ml.exchanged(model_rows(s, d), ["ticker", "date", "rsi_14"]).select(
        "ticker", "date", F.col("_o_ticker").alias("other_ticker"), F.col("_o_date").alias("other_date"), F.col("_o_rsi_14").alias("other_rsi")))


_FOLLOWS = "OVER (ORDER BY md5('42|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date)"
EXCHANGED_SQL = f"""mex AS (SELECT *, lead(struct_pack(ticker := ticker, date := date, {', '.join(f'{c} := {c}' for c in ML_FEATURES)})) {_FOLLOWS} AS nxt,
   row_number() {_FOLLOWS} AS place FROM mrow),
 mpair AS (SELECT a.*, coalesce(a.nxt, f.me) AS other FROM mex a,
   (SELECT struct_pack(ticker := ticker, date := date, {', '.join(f'{c} := {c}' for c in ML_FEATURES)}) AS me FROM mex WHERE place = 1) f)"""
# a linear model's error changes by its coefficient times the exchanged, standardised difference
IMPORTANCE_SQL = [*ML_FIT, EXCHANGED_SQL,
                  "msd AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ML_FEATURES) + " FROM mrow)",
                  "mco AS (SELECT " + ", ".join(f"max(coefficient) FILTER (term = '{c}') AS c_{c}" for c in ["alpha", *ML_FEATURES]) + " FROM mfit)",
                  "merr AS (SELECT p.*, msd.*, mco.*, target - c_alpha - " + " - ".join(f"c_{c} * ({c} - m_{c}) / s_{c}" for c in ML_FEATURES)
                  + " AS err FROM mpair p, msd, mco)",
                  "mimp AS (" + " UNION ALL ".join(
                      f"SELECT '{c}' AS feature, avg(pow(err - c_{c} * (other.{c} - {c}) / s_{c}, 2)) AS loss, avg(err * err) AS base FROM merr"
                      for c in ML_FEATURES) + ")"]


def _saved_model(s, rows):
    path = work_folder(s, "model")
    ml.save(ml.fit_linear(rows, ML_FEATURES, "ridge", 1.0), path)
    return rounded(ml.coefficients(ml.load(path), ML_FEATURES, s).select("feature", "coefficient"))


def _trees(s, rows, classify):
    return rounded(ml.tree_importance(ml.fit_trees(rows, ML_FEATURES, classify), ML_FEATURES, s))


FOLD_SQL = """WITH {bars}, d AS (SELECT list_sort(list(DISTINCT date)) AS d, count(DISTINCT date) AS n FROM bars),
  f AS (SELECT d, n, n // 6 AS first, greatest(1, n // 6 - 1) AS size, unnest([0, 1, 2, 3, 4]) AS i FROM d)
  SELECT CAST(i + 1 AS INTEGER) AS fold, d[1] AS train_start, d[first + i * size] AS train_end,
    d[first + i * size + 1 + 1] AS test_start, d[least(first + i * size + 1 + size, n)] AS test_end FROM f"""


# --- streams ------------------------------------------------------------------------------------------
def event_stream(s, d, file: str = "events.parquet") -> DataFrame:
    schema = s.read.parquet(f"{d}/{file}").schema
    ev = s.readStream.schema(schema).option("pathGlobFilter", file).parquet(d)
    at = F.col("ts").cast("timestamp")
    return ev.select(F.col("event_type").alias("ticker"), at.alias("dt"),
                     (F.unix_micros(at) % 300_000_000 + F.col("event_id") % 1000 / 1000.0).alias("at"),
                     *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume"))


def _stream_bars(s, d):
    target, checkpoint = work_folder(s, "bars"), work_folder(s, "bars-checkpoint")
    streams.run_to_table(streams.resampled(event_stream(s, d)), target, checkpoint)
    return rounded(s.read.parquet(target))


def _stream_ingest(s, d):
    """The events as feed files of two layouts, ingested twice: the second run finds nothing new."""
    from .table_queries import as_files, raw_minutes
    source = as_files(s, raw_minutes(s, d, True), "feed")
    target, checkpoint = work_folder(s, "minutes"), work_folder(s, "minutes-checkpoint")
    for _ in range(2):
        streams.ingest_days(s, source, target, checkpoint)
    days = s.read.parquet(target)
    return rounded(days.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low")))


def _stream_crosses(s, d):
    """Minute bars as a stream of files, smoothed over each ticker's whole history."""
    source = work_folder(s, "closes")
    minute(s, d).select("ticker", "dt", "close").write.parquet(source)
    stream = s.readStream.schema("ticker string, dt timestamp, close double").parquet(source)
    target, checkpoint = work_folder(s, "crosses"), work_folder(s, "crosses-checkpoint")
    streams.run_to_table(streams.macd_crosses(stream), target, checkpoint)
    return rounded(s.read.parquet(target))


QUERIES = {
    # --- risk ---------------------------------------------------------------------------
    "win13_rolling_risk": (
        lambda s, d: rounded(risk.rolling(ret(s, d)).select("ticker", "date", "rolling_sharpe", "rolling_volatility")),
        check([BARS, RETS, RET], f"""SELECT ticker, date, CASE WHEN row_number() OVER w >= 60 THEN avg(ret) OVER {last(60)}
              / nullif(stddev_samp(ret) OVER {last(60)}, 0) * sqrt(252.0) END AS rolling_sharpe,
              CASE WHEN row_number() OVER w >= 20 THEN stddev_samp(ret) OVER {last(20)} * sqrt(252.0) END AS rolling_volatility
              FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "ticker date", "rolling_sharpe rolling_volatility")),
    "win14_cumulative_return": (
        lambda s, d: rounded(risk.curve(ret(s, d)).select("ticker", "date", "cumulative_return"), 6, **WILD),
        check(CURVE, "SELECT * FROM curve", "ticker date", "cumulative_return", 6, WILD)),
    "win15_drawdown_series": (
        lambda s, d: rounded(risk.curve(ret(s, d)).select("ticker", "date", "drawdown")),
        check(CURVE, "SELECT * FROM curve", "ticker date", "drawdown")),
    "win18_recovered_spells": (
        lambda s, d: risk.curve(ret(s, d)).filter(F.col("recovered_after").isNotNull()).select("ticker", "date", "recovered_after"),
        _sql(CURVE, "SELECT ticker, date, CAST(recovered_after AS INTEGER) AS recovered_after FROM curve WHERE recovered_after IS NOT NULL")),
    "rk1_sharpe": _report("sharpe_ratio"),
    "rk2_sortino": _report("sortino_ratio"),
    "rk3_drawdown": (
        lambda s, d: rounded(risk.drawdowns(ret(s, d))),
        check(CURVE, report_sql("curve"), "ticker max_drawdown_days", "max_drawdown")),
    "rk4_value_at_risk": (
        lambda s, d: rounded(ret(s, d).groupBy("ticker").agg(risk.value_at_risk().alias("var_95"))),
        check(CURVE, report_sql("curve"), "ticker", "var_95")),
    "rk5_cvar": (
        lambda s, d: rounded(risk.cvar(ret(s, d))),
        check(CURVE, f"SELECT ticker, var_95 AS var, cvar_95 AS cvar FROM ({report_sql('curve')}) r", "ticker", "var cvar")),
    "rk6_calmar": _report("calmar_ratio"),
    "rk7_win_rate_and_profit_factor": _report("win_rate profit_factor"),
    "rk8_return_report": (
        lambda s, d: rounded(risk.report(ret(s, d)), 6, **WILD),
        check(CURVE, report_sql("curve"), _REPORT_PLAIN, _REPORT_ROUND, 6, WILD)),
    "rk9_benchmark_comparison": (
        lambda s, d: rounded(_benchmark(s, d)),
        check([BARS, RETS, RET, MARKET, PAIRS], """SELECT ticker, n, coalesce(beta, 0.0) AS beta, a - coalesce(beta, 0.0) * b AS alpha,
              coalesce((a - b) / nullif(te, 0), 0.0) AS information_ratio, correlation, benchmark_sharpe FROM
              (SELECT ticker, count(*) AS n, covar_samp(y, x) / nullif(var_samp(x), 0) AS beta, avg(y) * 252 AS a, avg(x) * 252 AS b,
                stddev(y - x) * sqrt(252.0) AS te, covar_samp(y, x) / nullif(stddev(y) * stddev(x), 0) AS correlation,
                coalesce(avg(x) / nullif(stddev(x), 0), 0.0) * sqrt(252.0) AS benchmark_sharpe FROM pairs GROUP BY ticker) q0""",
              "ticker n", "beta alpha information_ratio correlation benchmark_sharpe")),
    "rk10_portfolio_returns": (
        lambda s, d: rounded(risk.portfolio_returns(risk.returns_of(days(s, d)))),
        check([MINUTES, DAYBARS, DAYRET], """SELECT 'portfolio' AS ticker, date, avg(ret) AS ret FROM dret GROUP BY date
              HAVING count(*) = (SELECT count(DISTINCT ticker) FROM dret)""", "ticker date", "ret")),
    "rk10_weighted_portfolio": (
        lambda s, d: rounded(risk.portfolio_returns(risk.returns_of(days(s, d)), _weights(s, d))),
        check([MINUTES, DAYBARS, DAYRET], """SELECT 'portfolio' AS ticker, date, sum(ret * length(ticker) / 28.0) AS ret FROM dret
              GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM dret)""", "ticker date", "ret")),
    "rk11_portfolio_report": (
        lambda s, d: rounded(risk.report(risk.portfolio_returns(risk.returns_of(days(s, d)))), 6, **HUGE),
        check([MINUTES, DAYBARS, DAYRET, """pret AS (SELECT 'portfolio' AS ticker, date, avg(ret) AS ret FROM dret GROUP BY date
              HAVING count(*) = (SELECT count(DISTINCT ticker) FROM dret))""", curve_sql("pret", "curve")],
              report_sql("curve"), _REPORT_PLAIN, _REPORT_ROUND, 6, HUGE)),
    "rk11_asset_report": (
        lambda s, d: rounded(risk.asset_report(risk.returns_of(days(s, d))), 6, **WILD),
        check([MINUTES, DAYBARS, DAYRET, """shared AS (SELECT * FROM dret WHERE date IN (SELECT date FROM dret GROUP BY date
               HAVING count(*) = (SELECT count(DISTINCT ticker) FROM dret)))""", curve_sql("shared", "curve")],
              f"SELECT *, 1.0 / (SELECT count(DISTINCT ticker) FROM dret) AS weight FROM ({report_sql('curve')}) r", "ticker",
              "total_return sharpe_ratio max_drawdown weight", 6, WILD)),
    # --- regressions ---------------------------------------------------------------------
    "fm1_returns": (
        lambda s, d: rounded(ret(s, d)), check([BARS, RETS, RET], "SELECT * FROM ret", "ticker date", "ret")),
    "fm2_capm": (
        lambda s, d: rounded(capm.capm(pairs(s, d), inference=False).filter(F.col("error").isNull()).drop("error")),
        check(CAPM, "SELECT * FROM capm", "ticker n_observations", _CAPM)),
    "fm2_capm_inference": (
        lambda s, d: rounded(capm.capm(pairs(s, d)), 5),
        check(CAPM_TAILS, "SELECT * FROM inferred", "ticker n_observations error",
              f"{_CAPM} p_value_beta p_value_alpha beta_ci_lower beta_ci_upper", 5)),
    "win12_rolling_beta": (
        lambda s, d: rounded(capm.rolling(pairs(s, d)).select("ticker", "date", "rolling_beta", "rolling_alpha")),
        check([BARS, RETS, RET, MARKET, PAIRS, ROLL], "SELECT * FROM roll", "ticker date", "rolling_beta rolling_alpha")),
    "fm3_capm_report": (
        lambda s, d: rounded(capm.capm_report(pairs(s, d), inference=False).select(
            "ticker", "beta", "alpha", "rolling_beta_current", "rolling_alpha_current")),
        check([*CAPM, ROLL], """SELECT * FROM capm JOIN (SELECT ticker, arg_max(rolling_beta, date) AS rolling_beta_current,
              arg_max(rolling_alpha, date) AS rolling_alpha_current FROM roll GROUP BY ticker) r USING (ticker)""",
              "ticker", "beta alpha rolling_beta_current rolling_alpha_current")),
    "fm7_factor_table": (
        lambda s, d: rounded(capm.factor_table(factor_returns(s, d), "1995-06-01", "2000-12-31")),
        check([FACTORS], "SELECT date, " + ", ".join(f"{c} / 100 AS {c}" for c in ("mkt_rf", "smb", "hml", "rmw", "cma", "rf"))
              + " FROM facs WHERE date BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'", "date", "mkt_rf smb hml rmw cma rf")),
    "jn12_factor_alignment": (
        lambda s, d: rounded(ret(s, d).join(factor_table(s, d), "date").na.drop().select("ticker", "date", "ret", "mkt_rf", "cma")),
        check([BARS, RETS, RET, FACTORS], """SELECT ticker, r.date, ret, mkt_rf / 100 AS mkt_rf, cma / 100 AS cma FROM ret r
              JOIN facs f ON r.date = f.date WHERE mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND rmw IS NOT NULL
              AND cma IS NOT NULL""", "ticker date", "ret mkt_rf cma")),
    "fm4_factor_exposures": (
        lambda s, d: rounded(capm.factor_exposures(ret(s, d), factor_table(s, d), "5-factor").drop("p_value"), 5),
        check([*FITS, *ols_sql("fit5", "5-factor")], "SELECT * FROM fit5", "ticker model n_observations term", _FIT, 5)),
    "fm4_factor_inference": (
        lambda s, d: rounded(capm.factor_exposures(ret(s, d), factor_table(s, d), "3-factor"), 5),
        check([*FITS, *ols_sql("fit3", "3-factor")], tail_sql("fit3", {"p_value": ("t_stat", "n_observations - 4")}),
              "ticker model term n_observations", f"{_FIT} p_value", 5)),
    "fm5_factor_report": (
        lambda s, d: rounded(capm.factor_report(capm.factor_exposures(ret(s, d), factor_table(s, d), "3-factor")), 5),
        check([*FITS, *ols_sql("fit3", "3-factor")], "SELECT * FROM fit3w", "ticker model n_observations",
              "r_squared adj_r_squared alpha alpha_t_stat beta_mkt_rf beta_smb beta_hml beta_rmw beta_cma", 5)),
    "fm6_model_comparison": (
        lambda s, d: rounded(capm.compare_models(pairs(s, d), ret(s, d), factor_table(s, d)), 5),
        check([*FITS, *CAPM[3:], *ols_sql("fit3", "3-factor"), *ols_sql("fit5", "5-factor")],
              """SELECT ticker, 'CAPM' AS model, alpha, r_squared, beta FROM capm
                 UNION ALL SELECT ticker, model, alpha, r_squared, beta_mkt_rf FROM fit3w
                 UNION ALL SELECT ticker, model, alpha, r_squared, beta_mkt_rf FROM fit5w""", "ticker model", "alpha r_squared beta", 5)),
    # --- factor evaluation --------------------------------------------------------------------
    "fe1_factor_rows": (
        lambda s, d: rounded(factor_rows(s, d)),
        check([BARS, RETS, FROWS], "SELECT * FROM frows", "ticker date factor", "close value")),
    "jn13_factor_with_prices": (
        lambda s, d: rounded(fac.joined_prices(factor_rows(s, d).drop("close"), daily(s, d))),
        check([BARS, RETS, FROWS], "SELECT * FROM frows", "ticker date factor", "close value")),
    "fe2_daily_ic": (
        lambda s, d: rounded(fac.daily_ic(forward(s, d))),
        check(FE, "SELECT * FROM ics", "factor horizon date names", "ic")),
    "win17_rank_within_date": (
        lambda s, d: rounded(fac.ranked(factor_rows(s, d)).select("factor", "ticker", "date", "rank")),
        check([BARS, RETS, FROWS, RANKED], "SELECT * FROM rk", "factor ticker date", "rank")),
    "fe3_ic_summary": (
        lambda s, d: rounded(fac.ic_summary(fac.daily_ic(forward(s, d)))),
        check(FE, summary_sql("ics"), "factor horizon days", "mean_ic std_ic positive_share t_stat")),
    "fe4_quantile_returns": (
        lambda s, d: rounded(fac.quantile_returns(binned(s, d))),
        check([BARS, RETS, FROWS, BINS, QPAIRS, QRET], "SELECT * FROM qret", "factor horizon quantile rows", "mean_return")),
    "fe4_quantile_spread": (
        lambda s, d: rounded(fac.spread(fac.quantile_returns(binned(s, d)))),
        check([BARS, RETS, FROWS, BINS, QPAIRS, QRET, SPREAD], "SELECT * FROM spr", "factor horizon", "spread")),
    "fe5_evaluate_factor": (
        lambda s, d: rounded(fac.evaluate(with_returns(s, d), ["ret_d"], HORIZONS)),
        check([*FE, BINS, QPAIRS, QRET, SPREAD], f"SELECT * FROM ({summary_sql('ics')}) a JOIN spr USING (factor, horizon) WHERE factor = 'ret_d'",
              "factor horizon days", "mean_ic std_ic positive_share t_stat spread")),
    "fe6_evaluate_factors": (
        lambda s, d: rounded(fac.evaluate(with_returns(s, d), FACTOR_COLUMNS, HORIZONS)),
        check([*FE, BINS, QPAIRS, QRET, SPREAD], f"SELECT * FROM ({summary_sql('ics')}) a JOIN spr USING (factor, horizon)",
              "factor horizon days", "mean_ic std_ic positive_share t_stat spread")),
    "fe7_available_factors": (
        lambda s, d: _available(s, d),
        _sql([BARS, DERIVED], "SELECT column_name AS factor, r AS rows FROM (SELECT " + ", ".join(
            f"count({c}) AS {c}" for c in ("ret_d", "abs_ret_d", "abs_change_d")) + " FROM derived) a "
            "UNPIVOT (r FOR column_name IN (ret_d, abs_ret_d, abs_change_d))")),
    "fe8_factor_returns": (
        lambda s, d: rounded(fac.factor_returns(forward(s, d))),
        check([*FE, FRET], "SELECT * FROM fret", "factor horizon date", "factor_return")),
    "fe8_cumulative_factor_returns": (
        lambda s, d: rounded(fac.cumulative_factor_returns(fac.factor_returns(forward(s, d)), 0.001), 5),
        check([*FE, FRET], """SELECT *, product(1 + coalesce(factor_return * 0.001, 0)) OVER (PARTITION BY factor, horizon ORDER BY date
              ROWS UNBOUNDED PRECEDING) - 1 AS cumulative_return FROM fret""", "factor horizon date",
              "factor_return cumulative_return", 5)),
    "fe8_rank_autocorrelation": (
        lambda s, d: rounded(fac.rank_autocorrelation(factor_rows(s, d))),
        check([BARS, RETS, FROWS, RANKED], f"""SELECT factor, date, {corr_sql('rank', 'rank_before')} AS autocorrelation, count(*) AS names
              FROM rk WHERE rank_before IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10""", "factor date names", "autocorrelation")),
    "fe9_rank_turnover": (
        lambda s, d: rounded(fac.rank_turnover(factor_rows(s, d))),
        check([BARS, RETS, FROWS, RANKED], """SELECT factor, date, avg(abs(rank - rank_before)) AS turnover FROM rk
              WHERE rank_before IS NOT NULL GROUP BY 1, 2""", "factor date", "turnover")),
    "fe9_rolling_ic": (
        lambda s, d: rounded(fac.rolling_ic(fac.daily_ic(forward(s, d))).select("factor", "horizon", "date", "rolling_ic")),
        check(FE, """SELECT *, CASE WHEN count(*) OVER w = 60 THEN avg(ic) OVER w END AS rolling_ic FROM ics
              WINDOW w AS (PARTITION BY factor, horizon ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
              "factor horizon date", "rolling_ic")),
    "fe9_sector_ic": (
        lambda s, d: rounded(fac.ic_summary(fac.daily_ic(sectors(forward(s, d)), 4, ["sector"]), ["sector"])),
        check([BARS, RETS, FROWS, FPAIRS, "spairs AS (SELECT *, concat('G', CAST(right(ticker, 1) AS INTEGER) % 4) AS sector FROM fpairs)",
               "sics AS (" + ic_sql("factor, horizon, date, sector", "spairs").replace(">= 10", ">= 4") + ")"],
              summary_sql("sics", ", sector"), "factor horizon sector days", "mean_ic std_ic positive_share t_stat")),
    "fe9_holdout_split": (
        lambda s, d: rounded(fac.holdout_ic(fac.daily_ic(forward(s, d)), factor_rows(s, d))),
        check([*FE, "cut AS (SELECT list_sort(list(DISTINCT date))[CAST(floor(count(DISTINCT date) * 0.67) AS INTEGER) + 1] AS c FROM frows)",
               "hics AS (SELECT *, CASE WHEN date < (SELECT c FROM cut) THEN 'in_sample' ELSE 'out_of_sample' END AS sample FROM ics)"],
              summary_sql("hics", ", sample"), "factor horizon sample days", "mean_ic std_ic positive_share t_stat")),
    # --- signals ------------------------------------------------------------------------------------
    "sg1_macd_signals": (_signal_rows(signals.macd_signals, daily), _sql(MACD_SIG, _SIG_SQL)),
    "sg2_rsi_signals": (_signal_rows(signals.rsi_signals, daily), _sql(RSI_SIG, _SIG_SQL)),
    "sg3_mean_reversion": (
        _signal_rows(signals.mean_reversion, technical),
        _sql(custom_sig("rsi_14 < 30 AND bb_pct < 0 AND adx_14 < 20", "close > bb_middle"), _SIG_SQL)),
    "sg3_momentum": (
        _signal_rows(signals.momentum, technical),
        _sql(custom_sig("rsi_14 BETWEEN 50 AND 70 AND sma_cross_20_50 > 0 AND adx_14 > 25 AND roc_10 > 0", "sma_cross_20_50 < 0"), _SIG_SQL)),
    "sg4_equity": (
        lambda s, d: rounded(signals.simulate(signals.macd_signals(daily(s, d))).select(
            "ticker", "date", "position", "trade", "ret", "equity"), 6, equity=5),
        check([*MACD_SIG, SIM], "SELECT * REPLACE (CAST(trade AS BIGINT) AS trade) FROM sim", "ticker date position trade", "ret equity", 6,
              {"equity": 5})),
    "sg4_trades": (
        lambda s, d: rounded(signals.trades(signals.simulate(signals.macd_signals(daily(s, d))))),
        check([*MACD_SIG, SIM, TRADES], "SELECT * FROM trd", "ticker trade entry_date exit_date bars", "trade_return")),
    "sg5_strategy_stats": (
        lambda s, d: rounded(signals.strategy_stats(signals.simulate(signals.macd_signals(daily(s, d)))), 6, **_STATS_SPECIAL),
        check([*MACD_SIG, *stats_sql()], "SELECT * FROM st", "ticker total_trades", _STATS, 6, _STATS_SPECIAL)),
    "sg6_run_macd": (
        lambda s, d: rounded(signals.run_strategy(daily(s, d), "macd"), 6, **_STATS_SPECIAL),
        check([*MACD_SIG, *stats_sql()], "SELECT * FROM st", "ticker total_trades", _STATS, 6, _STATS_SPECIAL)),
    "sg6_run_rsi": (
        lambda s, d: rounded(signals.run_strategy(daily(s, d), "rsi"), 6, **_STATS_SPECIAL),
        check([*RSI_SIG, *stats_sql()], "SELECT * FROM st", "ticker total_trades", _STATS, 6, _STATS_SPECIAL)),
    "sg7_walk_forward": (
        lambda s, d: rounded(signals.walk_forward(daily(s, d), GRID), 5),
        check(_macd_walk(), "SELECT * FROM walk", 'ticker "window"', "fast slow signal train_metric test_return test_sharpe", 5)),
    "sg7_walk_forward_rsi": (
        lambda s, d: rounded(signals.walk_forward(daily(s, d), RSI_GRID, metric="total_return", strategy="rsi"), 5),
        check(_rsi_walk(), "SELECT * FROM walk", 'ticker "window"', "period oversold overbought train_metric test_return test_sharpe", 5)),
    "sg7_walk_forward_win_rate": (
        lambda s, d: rounded(signals.walk_forward(daily(s, d), GRID, metric="win_rate"), 5),
        check(_macd_walk("win_rate"), "SELECT * FROM walk", 'ticker "window"', "fast slow signal train_metric test_return test_sharpe", 5)),
    "sg7_walk_forward_summary": (
        lambda s, d: rounded(signals.walk_forward_summary(signals.walk_forward(daily(s, d), GRID)), 5),
        check(_macd_walk(), """SELECT ticker, count(*) AS num_windows, avg(test_return) AS avg_test_return,
              stddev_pop(test_return) AS std_test_return FROM walk GROUP BY ticker""", "ticker num_windows",
              "avg_test_return std_test_return", 5)),
    "sg8_position_size": (
        lambda s, d: rounded(signals.position_size(technical(s, d)).select(
            "ticker", "date", "stop_distance", "stop_price", "shares", "position_value", "risk_amount"), 4),
        check(TECH, """SELECT *, close - stop_distance AS stop_price, shares * close AS position_value, shares * stop_distance AS risk_amount
              FROM (SELECT *, CAST(least(floor(1000.0 / nullif(stop_distance, 0)), floor(20000.0 / nullif(close, 0)), floor(volume * 0.05)) AS BIGINT) AS shares
              FROM (SELECT *, atr_14 * 2.0 AS stop_distance FROM tech) a) b""", "ticker date shares",
              "stop_distance stop_price position_value risk_amount", 4)),
    "sg9_regimes": (
        lambda s, d: rounded(signals.by_regime(ret(s, d), REGIMES).select(
            "ticker", "regime", "trading_days", "sharpe_ratio", "max_drawdown", "total_return"), 6, **WILD),
        check([BARS, RETS, RET, "reg AS (" + " UNION ALL ".join(
            f"SELECT *, '{n}' AS regime FROM ret WHERE date BETWEEN DATE '{a}' AND DATE '{b}'" for n, a, b in REGIMES) + ")",
               curve_sql("reg", "curve", "ticker, regime")], report_sql("curve", "ticker, regime"),
              "ticker regime trading_days", "sharpe_ratio max_drawdown total_return", 6, WILD)),
    "sg10_trade_bootstrap": (
        lambda s, d: rounded(signals.bootstrap(signals.trades(signals.simulate(signals.macd_signals(daily(s, d))))), 6, **_DRAWN_SPECIAL),
        check([*MACD_SIG, SIM, TRADES, *BOOTSTRAP_SQL], """SELECT ticker, count(*) AS simulations, quantile_cont(result, 0.5) AS median_return,
              quantile_cont(result, 0.05) AS return_5pct, quantile_cont(result, 0.95) AS return_95pct,
              count(*) FILTER (result > 0) / count(*)::DOUBLE AS prob_positive FROM ends GROUP BY ticker""",
              "ticker simulations", "median_return return_5pct return_95pct prob_positive", 6, _DRAWN_SPECIAL)),
    # --- models ------------------------------------------------------------------------------------
    "ml1_time_folds": (lambda s, d: ml.fold_table(daily(s, d)), FOLD_SQL.format(bars=BARS)),
    "ml2_ml3_linear_cross_validation": (_cv(lambda n: ml.linear_stage(None, rows=n)), None),
    "ml3_linear_coefficients": (
        _ml(lambda s, rows: rounded(ml.coefficients(ml.fit_linear(rows, ML_FEATURES), ML_FEATURES, s)
                                    .select("feature", "coefficient", "abs_coefficient", "t_stat"), 5)),
        check(ML_FIT, """SELECT term AS feature, coefficient, abs(coefficient) AS abs_coefficient, t_stat FROM mfit WHERE term <> 'alpha'""",
              "feature", "coefficient abs_coefficient t_stat", 5)),
    "ml3_linear_inference": (
        _ml(lambda s, rows: rounded(ml.coefficients(ml.fit_linear(rows, ML_FEATURES), ML_FEATURES, s), 5)),
        check([*ML_FIT, f"""tails AS ({tail_sql("(SELECT * FROM mfit WHERE term <> 'alpha')", {"p_value": ("t_stat", f"n_observations - {len(ML_FEATURES) + 1}")})})"""],
              "SELECT *, term AS feature, abs(coefficient) AS abs_coefficient, p_value < 0.05 AS significant FROM tails",
              "feature significant", "coefficient abs_coefficient t_stat p_value", 5)),
    "ml3_linear_fit": (
        _ml(lambda s, rows: rounded(ml.fit_summary(ml.fit_linear(rows, ML_FEATURES), s, len(ML_FEATURES)), 5)),
        check([*ML_FIT, f"""whole AS (SELECT n_observations AS rows, r_squared, adj_r_squared, (n_observations - {len(ML_FEATURES) + 1})::DOUBLE AS free,
              r_squared / {len(ML_FEATURES)} / ((1 - r_squared) / (n_observations - {len(ML_FEATURES) + 1})) AS f_statistic
              FROM mfit WHERE term = 'alpha')"""],
              f"""SELECT *, {beta_sql(f"(free / (free + {len(ML_FEATURES)} * f_statistic))", "(free / 2)", f"({len(ML_FEATURES)}::DOUBLE / 2)")} AS f_p_value FROM whole""",
              "rows", "r_squared adj_r_squared f_statistic f_p_value", 5)),
    "ml4_logistic_cross_validation": (_cv(lambda n: ml.logistic_stage("l2", 1.0, n), True), None),
    "ml5_regularisation_path": (_ml(lambda s, rows: rounded(ml.tune(rows, ML_FEATURES, "lasso")[1])), None),
    "ml6_tree_classifier": (_ml(lambda s, rows: _trees(s, rows, True)), None),
    "ml6_tree_regressor": (_ml(lambda s, rows: _trees(s, rows, False)), None),
    "ml7_model_report": (_ml(lambda s, rows: rounded(ml.model_report(rows, ML_FEATURES, "linear", 1.0, "ridge")[1])), None),
    "ml8_permutation_importance": (
        _ml(_importance),
        check(IMPORTANCE_SQL, "SELECT *, loss - base AS importance FROM mimp", "feature", "loss importance")),
    "ml8_exchanged_rows": (
        _exchanged,
        check([*ML_FIT, EXCHANGED_SQL], "SELECT ticker, date, other.ticker AS other_ticker, other.date AS other_date, other.rsi_14 AS other_rsi FROM mpair",
              "ticker date other_ticker other_date", "other_rsi")),
    "snk6_saved_model": (_ml(_saved_model), None),
    # --- streams -------------------------------------------------------------------------------------
    "st1_incremental_ingest": (
        _stream_ingest,
        f"""SELECT upper(event_type) AS ticker, CAST(ts AS DATE) AS date, count(*) AS bars, CAST(sum(user_id) AS BIGINT) AS volume,
             round(max(value), 6) AS high, round(min(value), 6) AS low FROM events
           WHERE event_type <> 'error' AND {tradable_sql('event_type')} GROUP BY 1, 2"""),
    "st2_streaming_bars": (
        _stream_bars,
        """SELECT ticker, dt, round(arg_min(value, ts), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
             round(arg_max(value, ts), 6) AS close, count(*) AS volume
           FROM (SELECT event_type AS ticker, time_bucket(INTERVAL '5 minutes', ts) AS dt, ts, value FROM events) a GROUP BY 1, 2
           HAVING dt + INTERVAL '5 minutes' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)"""),
    "st3_streaming_crosses": (
        _stream_crosses,
        check([MINUTES, macd_sql("mins", "m1", "ticker")], """SELECT *, close AS entry_close,
              CASE WHEN cross_up = 1 THEN 'cross_up' ELSE 'cross_down' END AS event_type FROM m1x WHERE cross_up = 1 OR cross_down = 1""",
              "ticker dt event_type", "hist hist_prev entry_close")),
}


def _benchmark(s, d):
    bars = daily(s, d)
    return risk.against_benchmark(risk.returns_of(bars), market(bars))


def _weights(s, d):
    """Weight by the length of the name, summing to one over the five tickers."""
    return minute(s, d).select("ticker").distinct().withColumn("weight", F.length("ticker") / 28.0)


def _available(s, d):
    df = with_returns(s, d)
    names = datasets.numeric_columns(df, ("open", "high", "low", "close", "volume", "year", "month"))
    row = df.agg(*[F.count(n).alias(n) for n in names])
    return row.unpivot([], names, "factor", "rows")
