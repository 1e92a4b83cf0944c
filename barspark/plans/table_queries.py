"""Registered queries: sources, filters, projections, joins, aggregations, sorting and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import rounded
from ..functions.predicates import apply_filters
from ..functions.tickers import is_tradable, tradable_only, with_chart_links
from ..operators import intraday, labels, returns, screens
from ..sources import bars as feeds, datasets, increments, sinks
from ..sources.folders import work_folder
from .oracle import check
from .tables import (BARS, FIVES, MINUTES, RETS, bars_daily as daily, bars_minute as minute, table)

AS_OF = "2001-07-01"


def as_of():
    return F.lit(AS_OF).cast("date")


def with_returns(s, d) -> DataFrame:
    return returns.daily_derivatives(daily(s, d), 1.0, 9.99)


def symbols(s, d) -> DataFrame:
    """Many spellings of a symbol, one per line item and user event, to exercise the ticker rules."""
    endings = F.array(*[F.lit(x) for x in ("", "W", "WS", "U", "R", "PR", "PRA", "P", ".B", "1", "TEST")])
    part = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    stem = F.upper(F.substring(F.regexp_replace("name", " ", ""), 1, 5))
    return part.select(F.concat(F.substring(stem, 1, (F.col("k") % 5 + 1).cast("int")),
                                endings[(F.col("k") % 11).cast("int")]).alias("ticker"),
                       F.col("k").alias("volume"))


SYMBOLS = """syms AS (SELECT concat(substring(upper(substring(replace(p_name, ' ', ''), 1, 5)), 1, CAST(p_partkey % 5 + 1 AS INTEGER)),
  ['', 'W', 'WS', 'U', 'R', 'PR', 'PRA', 'P', '.B', '1', 'TEST'][CAST(p_partkey % 11 + 1 AS INTEGER)]) AS ticker,
  p_partkey AS volume FROM part)"""


def tradable_sql(t: str) -> str:
    u = f"upper(trim({t}))"
    return f"""coalesce(NOT (length({u}) < 1 OR regexp_matches({u}, '[.\\-^+=/#@!$%&*]') OR contains({u}, 'TEST')
      OR length({u}) >= 7 OR (length({u}) >= 5 AND regexp_matches({u}, '(W|WS|WT|U)$'))
      OR (length({u}) = 5 AND regexp_matches({u}, '[A-Z]R$')) OR (length({u}) >= 4 AND instr({u}, 'PR') >= 3)
      OR (length({u}) >= 4 AND regexp_matches({u}, '^[A-Z]+P$')) OR regexp_matches({u}, '[0-9].')), false)"""


def raw_feed(s, d) -> DataFrame:
    """Line items in the shape of a flat-file feed: text columns and epoch nanoseconds."""
    line = table(s, d, "lineitem")
    return line.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000 + F.col("l_orderkey")).cast("string").alias("timestamp"),
        *[F.floor(F.col("l_extendedprice")).cast("string").alias(p) for p in feeds.PRICES],
        F.col("l_quantity").cast("long").cast("string").alias("volume"))


def raw_minutes(s, d, broken: bool = False) -> DataFrame:
    """Events as a minute feed; when ``broken``, those of errors have no readable time."""
    ev = table(s, d, "events")
    ns = (F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))) * 1000).cast("string")
    when = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(ns) if broken else ns
    return ev.select(F.upper("event_type").alias("ticker"), when.alias("window_start"),
                     *[F.col("value").cast("string").alias(p) for p in feeds.PRICES],
                     F.col("user_id").cast("string").alias("volume"))


def as_files(s, raw: DataFrame, name: str) -> str:
    """A feed as gzip CSV files of two layouts: the published order, and another one with the other names and a further column."""
    folder = work_folder(s, name)
    rows = raw.withColumnsRenamed({a: n for a, n in feeds.ALIASES.items() if a in raw.columns}).withColumn("half", F.pmod(F.xxhash64("ticker", "window_start"), F.lit(2)))
    first = rows.filter("half = 0").select("ticker", "volume", "open", "close", "high", "low", "window_start")
    other = rows.filter("half = 1").select("low", "close", F.lit("x").alias("note"), F.col("window_start").alias("timestamp"), "high", "volume", F.col("ticker").alias("symbol"), "open")
    first.write.csv(f"{folder}/2024", header=True, compression="gzip")
    other.write.csv(f"{folder}/2025/late [2]", header=True, compression="gzip")
    return folder


def read_files(s, raw: DataFrame, name: str, lenient: bool = False) -> DataFrame:
    return feeds.read_feed(s, as_files(s, raw, name), lenient)


def minutes_as_feed(s, d) -> DataFrame:
    """Minute bars in the shape of the feed."""
    return minute(s, d).select("ticker", (F.unix_micros("dt") * 1000).cast("string").alias("window_start"), *[F.col(c).cast("string").alias(c) for c in (*feeds.PRICES, "volume")])


def _increments(s, d):
    """Days summed up from a minute table that grows: two deliveries, and a third run with nothing to do."""
    root = work_folder(s, "increments")
    source, target, log = f"{root}/minute", f"{root}/days", f"{root}/commits"
    bars = minute(s, d)
    for number, some in enumerate((F.dayofmonth("date") <= 15, F.dayofmonth("date") > 15, F.lit(False))):
        sinks.write_by_date(bars.filter(some), source)
        increments.run(s, source, target, log, lambda part: sinks.write_by_date(intraday.day_bars(part).withColumn("run", F.lit(number + 1)), target))  # noqa: B023
    return s.read.parquet(target).groupBy("date", "run").agg(F.count(F.lit(1)).alias("tickers"), F.sum("volume").alias("volume"))


RAW_MINUTES = """raw AS (SELECT upper(event_type) AS ticker, date_trunc('minute', ts) AS dt, value, user_id AS volume FROM events)"""
READABLE = "readable AS (SELECT * FROM raw WHERE ticker <> 'ERROR')"

FILTERS = {"close": {"min": 1.0, "max": 50.0}, "ticker": "^S[1-4]", "volume": {"min": 60000}, "missing": 3, "low": None}


def listing_lines(s, d) -> DataFrame:
    """Storage listing text: one line per ship date, some too short to be a listing line."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(s, d, "lineitem").select(day.alias("day")).distinct().select(
        F.when(F.dayofmonth(F.col("day").cast("date")) == 31, F.concat(F.lit("PRE "), F.col("day")))
        .otherwise(F.concat(F.col("day"), F.lit(" 20:30:14   212396 bucket/day/"), F.col("day"), F.lit(".csv.gz")))
        .alias("value"))


def present_files(s, d) -> DataFrame:
    return table(s, d, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv.gz")).alias("file")).distinct()


def _files(s, d):
    return datasets.missing_and_extra(datasets.listed_files(listing_lines(s, d), end=as_of()), present_files(s, d))


def _band_days(s, d) -> DataFrame:
    """A daily table that shares its keys with the minute bars."""
    return intraday.day_bars(minute(s, d))


DAYBARS = """days AS (SELECT ticker, date, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, dt) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM mins GROUP BY 1, 2)"""

DERIVED = """derived AS (SELECT *, abs(ret_d) AS abs_ret_d,
   abs(close - lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS abs_change_d,
   close BETWEEN 1.0 AND 9.99 AS close_in_band
  FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret_d FROM bars) a)"""

WEEKS = """weeks AS (SELECT *, close_w / nullif(lag(close_w) OVER w, 0) - 1 AS ret_w,
   abs(close_w / nullif(lag(close_w) OVER w, 0) - 1) AS abs_ret_w, abs(close_w - lag(close_w) OVER w) AS abs_change_w,
   CAST(year(week_start) AS INTEGER) AS year, CAST(weekofyear(week_start) AS INTEGER) AS week
  FROM (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_max(close, date) AS close_w
        FROM bars GROUP BY 1, 2) a WINDOW w AS (PARTITION BY ticker ORDER BY week_start))"""


AVERAGES = f"""av AS (SELECT ticker, avg(close) AS price, avg(volume) AS shares, avg(high - low) AS width, count(*) AS days
  FROM bars WHERE date >= DATE '{AS_OF}' - 90 GROUP BY ticker HAVING count(*) >= 15)"""


def _column_info(s, d):
    return screens.column_info(with_returns(s, d))


def _column_stats(s, d):
    return rounded(screens.column_stats(with_returns(s, d)), 4)


_NUMERIC = ["open", "high", "low", "close", "volume", "ret_d", "abs_ret_d", "abs_change_d"]
_COLUMN_TYPES = {"ticker": "string", "date": "date", "volume": "bigint", "close_in_band": "boolean"}


def _register_views(s, d):
    df = daily(s, d)
    return screens.run_sql(s, """
        SELECT year(date) AS year, count(DISTINCT ticker) AS tickers, sum(volume) AS volume, round(max(high), 4) AS top
        FROM daily GROUP BY year(date)""", {"daily": df})


def _views(s, d):
    screens.register_views(daily(s, d), as_of())
    return s.sql("""SELECT count(*) AS tickers, sum(days) AS bars FROM ticker_summary
                    WHERE ticker IN (SELECT ticker FROM high_volume_tickers)""")


def _datasets(s, d):
    """The registry over the given files: a missing first choice falls back to the second."""
    registry = datasets.Datasets({"lines": [f"{d}/lineitem_all.parquet", f"{d}/lineitem.parquet"],
                                  "orders": [f"{d}/orders*.parquet"]})
    return datasets.listing({n: registry.load(s, n) for n in registry.groups})


def _concat(s, d):
    df = daily(s, d)
    low = df.filter(F.col("close") < 10).select("ticker", "date", "close", F.lit("low").alias("part"))
    high = df.filter(F.col("close") >= 10).select("ticker", "date", "close", "volume", F.lit("high").alias("part"))
    return rounded(low.unionByName(high, allowMissingColumns=True))


def _low_price(s, d):
    return rounded(labels.low_price_tickers(daily(s, d), 48.0, 850_000))


def _written(s, d):
    path = work_folder(s, "bars")
    with_keys = daily(s, d).withColumns({"year": F.year("date"), "month": F.month("date")})
    sinks.write_parquet(with_keys, path, ["year", "month"])
    return s.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


def _by_date(s, d, label):
    """Written twice: the second run replaces the dates of the first."""
    path = work_folder(s, "days")
    for _ in range(2):
        sinks.write_by_date(minute(s, d), path, label)
    return s.read.parquet(path).groupBy("mode", "date").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


def _event_folders(s, d):
    path = work_folder(s, "events")
    rising = minute(s, d).filter(F.col("close") > F.col("open"))
    sinks.write_by_date(rising, path)
    return s.read.schema(rising.schema).parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def _macd_partitions(s, d):
    from ..operators.macd import macd
    path = work_folder(s, "macd")
    lines = macd(minute(s, d)).withColumns({"year": F.year("date"), "month": F.month("date")})
    sinks.write_parquet(lines, path, ["year", "month"], "snappy", tradable=False)
    return s.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("bars"))


def _exported(s, d, kind):
    path = work_folder(s, kind)
    df = returns.daily_returns(daily(s, d)).select("ticker", "date", "ret_d")
    schema = "ticker string, date string, ret_d double"
    if kind == "json":
        sinks.export_json(df, path)
        return rounded(s.read.schema(schema).json(path))
    sinks.export_csv(df, path)
    return rounded(s.read.schema(schema).csv(path, header=True))


QUERIES = {
    # --- sources -----------------------------------------------------------------
    "src1_daily_feed": (
        lambda s, d: feeds.daily_bars(read_files(s, raw_feed(s, d), "daily-feed")).drop("open", "high", "low"),
        """SELECT CAST(l_shipdate AS DATE) AS date, concat('S', l_suppkey) AS ticker, floor(l_extendedprice) AS close,
           CAST(l_quantity AS BIGINT) AS volume, CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem"""),
    "src2_minute_feed": (
        lambda s, d: feeds.minute_bars(read_files(s, raw_minutes(s, d), "minute-feed"))
        .groupBy("ticker", "date", "hour").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"),
                                               F.max("minute").alias("last_minute")),
        f"""WITH {RAW_MINUTES} SELECT ticker, CAST(dt AS DATE) AS date, CAST(hour(dt) AS INTEGER) AS hour,
            count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, CAST(max(minute(dt)) AS INTEGER) AS last_minute
            FROM raw GROUP BY 1, 2, 3"""),
    "src3_lenient_day_reader": (
        lambda s, d: rounded(feeds.minute_bars(read_files(s, raw_minutes(s, d, True), "lenient-feed", True), lenient=True, tradable=True)
                             .groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("bars"),
                                                            F.max("close").alias("top"))),
        f"""WITH {RAW_MINUTES}, {READABLE} SELECT ticker, CAST(dt AS DATE) AS date, count(*) AS bars, round(max(value), 6) AS top
            FROM readable WHERE {tradable_sql('ticker')} GROUP BY 1, 2"""),
    "src4_minute_scan_years": (
        lambda s, d: feeds.minute_bars(read_files(s, raw_minutes(s, d, True), "years-feed", True), lenient=True).groupBy("ticker", "year", "month")
        .agg(F.count(F.lit(1)).alias("bars"), F.min("dt").alias("first_dt")),
        f"""WITH {RAW_MINUTES}, {READABLE} SELECT ticker, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month,
            count(*) AS bars, min(dt) AS first_dt FROM readable GROUP BY 1, 2, 3"""),
    "src5_minute_ohlcv_scan": (
        lambda s, d: rounded(feeds.minute_bars(read_files(s, minutes_as_feed(s, d), "ohlcv-feed")).select("ticker", "dt", "date", "open", "high", "low", "close", "volume")),
        check([MINUTES], "SELECT * FROM mins", "ticker dt date volume", "open high low close")),
    "src6_table_scan": (
        lambda s, d: feeds.read_tables(s, [f"{d}/nation.parquet"]),
        "SELECT * FROM nation"),
    "src7_dataset_registry": (
        _datasets,
        """SELECT 'lines' AS name, count(*) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem
           UNION ALL SELECT 'orders', count(*), CAST(6 AS INTEGER) FROM orders"""),
    "src8_latest_date": (
        lambda s, d: datasets.latest_date(daily(s, d), intraday.day_bars(minute(s, d))),
        f"""WITH {BARS}, {MINUTES} SELECT max(x) AS latest_date FROM (SELECT max(date) AS x FROM bars
            UNION ALL SELECT max(date) FROM mins) q"""),
    "src9_freshness": (
        lambda s, d: datasets.freshness({"daily": daily(s, d), "minute": minute(s, d)}, F.lit("2001-11-05").cast("date")),
        f"""WITH {BARS}, {MINUTES} SELECT name, x AS latest_date, DATE '2001-11-02' AS expected_date,
            x >= DATE '2001-11-02' AS is_fresh
            FROM (SELECT 'daily' AS name, max(date) AS x FROM bars UNION ALL SELECT 'minute', max(date) FROM mins) q"""),
    "src10_not_yet_done": (
        lambda s, d: datasets.not_yet_done(
            daily(s, d).groupBy("date").agg(F.count(F.lit(1)).alias("bars")),
            table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))),
        f"""WITH {BARS} SELECT date, count(*) AS bars FROM bars
            WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders) GROUP BY date"""),
    "src10_increments": (
        _increments,
        f"""WITH {MINUTES} SELECT date, CAST(CASE WHEN day(date) <= 15 THEN 1 ELSE 2 END AS INTEGER) AS run, count(DISTINCT ticker) AS tickers,
            CAST(sum(volume) AS BIGINT) AS volume FROM mins GROUP BY 1, 2"""),
    "src10_needs_rebuild": (
        lambda s, d: datasets.needs_rebuild(daily(s, d), table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))),
        f"""WITH {BARS} SELECT a AS input_date, b AS output_date, a > b AS rebuild FROM
            (SELECT (SELECT max(date) FROM bars) AS a, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS b) q"""),
    # --- sinks: written and read back ----------------------------------------------
    "snk1_partitioned_parquet": (
        _written,
        f"""WITH {BARS} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS bars,
            CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE {tradable_sql('ticker')} GROUP BY 1, 2"""),
    "snk2_date_folders": (
        lambda s, d: _by_date(s, d, "core"),
        f"WITH {MINUTES} SELECT 'core' AS mode, date, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM mins GROUP BY 2"),
    "snk3_event_folders": (
        lambda s, d: _event_folders(s, d), f"WITH {MINUTES} SELECT date, count(*) AS rows FROM mins WHERE close > open GROUP BY 1"),
    "snk4_macd_partitions": (
        _macd_partitions,
        f"WITH {MINUTES} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS bars FROM mins GROUP BY 1, 2"),
    "snk5_json_export": (
        lambda s, d: _exported(s, d, "json"),
        check([BARS, RETS], "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, ret_d FROM rets", "ticker date", "ret_d")),
    "snk5_csv_export": (
        lambda s, d: _exported(s, d, "csv"),
        check([BARS, RETS], "SELECT ticker, strftime(date, '%Y-%m-%d') AS date, ret_d FROM rets", "ticker date", "ret_d")),
    # --- filters and projections -------------------------------------------------
    "flt1_filter_document": (
        lambda s, d: rounded(apply_filters(daily(s, d), FILTERS).select("ticker", "date", "close", "volume")),
        check([BARS], """SELECT * FROM bars WHERE close >= 1.0 AND close <= 50.0 AND regexp_matches(ticker, '^S[1-4]')
              AND volume >= 60000""", "ticker date volume", "close")),
    "flt1_filter_lists_and_digits": (
        lambda s, d: rounded(apply_filters(with_returns(s, d), {"ticker": 7, "close_in_band": True,
                                                                "volume": [30000, 60000, 90000, 600000, 900000]})
                             .select("ticker", "date", "close", "volume")),
        check([BARS, DERIVED], """SELECT * FROM derived WHERE contains(ticker, '7') AND close_in_band
              AND volume IN (30000, 60000, 90000, 600000, 900000)""", "ticker date volume", "close")),
    "flt2_price_band": (
        lambda s, d: rounded(returns.price_band(daily(s, d), 1.0, 9.99).select("ticker", "date", "close")),
        check([BARS], "SELECT * FROM bars WHERE close BETWEEN 1.0 AND 9.99", "ticker date", "close")),
    "flt3_tradable_tickers": (
        lambda s, d: symbols(s, d).select("ticker", "volume", is_tradable(F.col("ticker")).alias("tradable")),
        f"WITH {SYMBOLS} SELECT ticker, volume, {tradable_sql('ticker')} AS tradable FROM syms"),
    "flt4_tradable_table": (
        lambda s, d: tradable_only(symbols(s, d)).groupBy("ticker").agg(F.sum("volume").alias("volume")),
        f"WITH {SYMBOLS} SELECT ticker, CAST(sum(volume) AS BIGINT) AS volume FROM syms WHERE {tradable_sql('ticker')} GROUP BY 1"),
    "flt5_clean_report": (
        lambda s, d: screens.clean_report(symbols(s, d)),
        f"""WITH {SYMBOLS} SELECT count(*) AS rows_before, count(*) FILTER ({tradable_sql('ticker')}) AS rows_after,
            count(DISTINCT ticker) AS tickers_before, count(DISTINCT ticker) FILTER ({tradable_sql('ticker')}) AS tickers_after
            FROM syms"""),
    "flt5_removed_tickers": (
        lambda s, d: screens.removed_tickers(symbols(s, d)),
        f"WITH {SYMBOLS} SELECT DISTINCT ticker FROM syms WHERE NOT {tradable_sql('ticker')} ORDER BY ticker LIMIT 50"),
    "flt6_regular_session": (
        lambda s, d: rounded(intraday.regular_session(minute(s, d)).select("ticker", "dt", "close")),
        # January: New York is five hours behind UTC
        check([MINUTES], """SELECT * FROM mins WHERE CAST(dt - INTERVAL '5 hours' AS TIME)
              BETWEEN TIME '09:30:00' AND TIME '16:00:00'""", "ticker dt", "close")),
    "flt7_months_back_newest": (
        lambda s, d: rounded(_since_newest(s, d)),
        check([BARS], """SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS newest FROM bars) a
              WHERE date >= newest - 360""", "ticker date", "close")),
    "flt7_months_back_as_of": (
        lambda s, d: rounded(_since(s, d)),
        check([BARS], f"SELECT * FROM bars WHERE date >= DATE '{AS_OF}' - 360", "ticker date", "close")),
    "flt8_date_range": (
        lambda s, d: rounded(returns.returns_between(daily(s, d), ["S1", "S3", "S7"], "1996-01-01", "1998-12-31")
                             .select("ticker", "date", "close")),
        check([BARS], """SELECT * FROM bars WHERE ticker IN ('S1', 'S3', 'S7')
              AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""", "ticker date", "close")),
    "flt9_prefix_search": (
        lambda s, d: rounded(screens.search(daily(s, d), "s1", as_of(), min_volume=100_000, max_price=90.0)),
        check([BARS], f"""SELECT ticker, arg_max(close, date) AS latest_close, avg(volume) AS avg_volume, count(*) AS days
              FROM bars WHERE ticker LIKE 'S1%' AND date >= DATE '{AS_OF}' - 30 GROUP BY ticker
              HAVING avg(volume) >= 100000 AND arg_max(close, date) <= 90.0 ORDER BY avg_volume DESC, ticker LIMIT 20""",
              "ticker days", "latest_close avg_volume")),
    "prj1_needed_columns": (
        lambda s, d: rounded(daily(s, d).select(*[c for c in ("ticker", "date", "close", "ret_d", "volume")
                                                 if c in daily(s, d).columns])),
        check([BARS], "SELECT * FROM bars", "ticker date volume", "close")),
    "prj2_chart_links": (
        lambda s, d: with_chart_links(daily(s, d).select("ticker").distinct(), "NYSE"),
        f"""WITH {BARS} SELECT DISTINCT ticker, concat('https://www.tradingview.com/chart/?symbol=NYSE:', ticker, '&interval=1') AS tv_1m,
            concat('https://www.tradingview.com/chart/?symbol=NYSE:', ticker, '&interval=5') AS tv_5m FROM bars"""),
    "prj4_column_info": (
        _column_info,
        f"WITH {BARS}, {DERIVED} " + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{_COLUMN_TYPES.get(c, 'double')}' AS type, count(*) > count({c}) AS nullable FROM derived"
            for c in ["ticker", "date", *_NUMERIC, "close_in_band"])),
    "prj5_dataset_listing": (
        lambda s, d: datasets.listing({"daily": daily(s, d), "minute": minute(s, d)}),
        f"""WITH {BARS}, {MINUTES} SELECT 'daily' AS name, count(*) AS rows, CAST(7 AS INTEGER) AS columns FROM bars
            UNION ALL SELECT 'minute', count(*), CAST(8 AS INTEGER) FROM mins"""),
    # --- joins --------------------------------------------------------------------
    "jn1_price_gate": (
        lambda s, d: rounded(intraday.in_price_band(minute(s, d), _band_days(s, d), 20.0, 120.0)
                             .select("ticker", "dt", "close")),
        check([MINUTES, DAYBARS], """SELECT * FROM mins m WHERE EXISTS (SELECT 1 FROM days b WHERE b.ticker = m.ticker
              AND b.date = m.date AND b.close BETWEEN 20.0 AND 120.0)""", "ticker dt", "close")),
    "jn2_valid_ticker_gate": (
        lambda s, d: rounded(screens.prefiltered(daily(s, d), 1.0, 9.99, 850_000, 500).select("ticker", "date", "close")),
        check([BARS], """SELECT * FROM bars WHERE close BETWEEN 1.0 AND 9.99 AND ticker IN (SELECT ticker FROM bars
              GROUP BY ticker HAVING avg(volume) >= 850000 AND count(*) >= 500)""", "ticker date", "close")),
    "jn11_align_market": (
        lambda s, d: rounded(_aligned(s, d)),
        check([BARS, RETS, "market AS (SELECT date, avg(ret_d) AS ret_m FROM rets WHERE ret_d IS NOT NULL GROUP BY date)"],
              "SELECT r.ticker, r.date, r.ret_d, m.ret_m FROM rets r JOIN market m ON r.date = m.date WHERE r.ret_d IS NOT NULL",
              "ticker date", "ret_d ret_m")),
    "jn14_ticker_list": (
        lambda s, d: rounded(daily(s, d).join(_low_price(s, d).select("ticker"), "ticker", "left_semi")
                             .select("ticker", "date", "close")),
        check([BARS], """SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker
              HAVING avg(close) <= 48.0 AND avg(volume) >= 850000)""", "ticker date", "close")),
    "jn15_missing_and_extra_files": (
        _files,
        f"""WITH l AS (SELECT DISTINCT concat(strftime(l_shipdate, '%Y-%m-%d'), '.csv.gz') AS file FROM lineitem
              WHERE day(l_shipdate) <> 31 AND CAST(l_shipdate AS DATE) <= DATE '{AS_OF}'),
            p AS (SELECT DISTINCT concat(strftime(o_orderdate, '%Y-%m-%d'), '.csv.gz') AS file FROM orders)
            SELECT file, 'missing' AS status FROM l WHERE file NOT IN (SELECT file FROM p)
            UNION ALL SELECT file, 'extra' FROM p WHERE file NOT IN (SELECT file FROM l)"""),
    # --- aggregations -------------------------------------------------------------
    "agg1_weekly_bars": (
        lambda s, d: rounded(returns.weekly_returns(daily(s, d))),
        check([BARS, WEEKS], "SELECT * FROM weeks", "ticker week_start year week", "close_w ret_w abs_ret_w abs_change_w")),
    "agg2_resample_five_minutes": (
        lambda s, d: rounded(intraday.resample(minute(s, d))),
        check([MINUTES, FIVES], "SELECT * FROM fives", "ticker dt date volume", "open high low close")),
    "agg3_ticker_history": (
        lambda s, d: rounded(intraday.history(minute(s, d), "click", 20, 1.5)),
        check([MINUTES, DAYBARS], "SELECT * FROM days WHERE ticker = 'click' ORDER BY date DESC LIMIT 20",
              "ticker date volume", "open high low close")),
    "agg3_daily_history": (
        lambda s, d: rounded(intraday.history(with_returns(s, d), "S7", 50, 1.5)),
        check([BARS, DERIVED], "SELECT * FROM derived WHERE ticker = 'S7' ORDER BY date DESC LIMIT 50",
              "ticker date volume", "open high low close ret_d abs_ret_d")),
    "agg3_weekly_history": (
        lambda s, d: rounded(intraday.history(returns.weekly_returns(daily(s, d)), "S7", 30)),
        check([BARS, WEEKS], "SELECT * FROM weeks WHERE ticker = 'S7' ORDER BY week_start DESC LIMIT 30",
              "ticker week_start year week", "close_w ret_w abs_ret_w abs_change_w")),
    "agg3_day_bars": (
        lambda s, d: rounded(intraday.day_bars(minute(s, d))),
        check([MINUTES, DAYBARS], "SELECT * FROM days", "ticker date volume", "open high low close")),
    "agg7_liquidity_gate": (
        lambda s, d: rounded(screens.liquid_tickers(daily(s, d), 850_000, 500)),
        check([BARS], """SELECT ticker, avg(volume) AS avg_volume, count(*) AS day_count FROM bars GROUP BY ticker
              HAVING avg(volume) >= 850000 AND count(*) >= 500""", "ticker day_count", "avg_volume")),
    "agg8_low_price_tickers": (
        _low_price,
        check([BARS], """SELECT ticker, avg(close) AS avg_close, arg_max(close, date) AS last_close, avg(volume) AS avg_volume,
              count(*) AS day_count FROM bars GROUP BY ticker HAVING avg(close) <= 48.0 AND avg(volume) >= 850000""",
              "ticker day_count", "avg_close last_close avg_volume")),
    "agg11_latest_close": (
        lambda s, d: rounded(screens.latest_close(daily(s, d))),
        check([BARS], "SELECT ticker, arg_max(close, date) AS latest_close, max(date) AS latest_date FROM bars GROUP BY 1",
              "ticker latest_date", "latest_close")),
    "agg12_column_stats": (
        _column_stats,
        f"WITH {BARS}, {DERIVED} " + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
                round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, count(*) - count({c}) AS nulls FROM derived"""
            for c in _NUMERIC)),
    "agg13_ticker_summary": (
        lambda s, d: rounded(screens.ticker_summary(daily(s, d)), 5),
        check([BARS], """SELECT ticker, count(*) AS days, min(date) AS first_date, max(date) AS last_date, avg(close) AS avg_close,
              min(close) AS min_close, max(close) AS max_close, avg(volume) AS avg_volume, stddev(close) AS close_std
              FROM bars GROUP BY ticker""", "ticker days first_date last_date",
              "avg_close min_close max_close avg_volume close_std", 5)),
    "agg14_recent_daily": (
        lambda s, d: rounded(screens.recent(daily(s, d), as_of()).select("ticker", "date", "close")),
        check([BARS], f"SELECT * FROM bars WHERE date >= DATE '{AS_OF}' - 90", "ticker date", "close")),
    "agg15_high_volume_tickers": (
        lambda s, d: rounded(screens.high_volume_tickers(daily(s, d), as_of()), 6, avg_close=10),
        check([BARS], f"""SELECT ticker, avg(volume) AS avg_volume, avg(close) AS avg_close, count(*) AS days FROM bars
              WHERE date >= DATE '{AS_OF}' - 90 GROUP BY ticker HAVING avg(volume) >= 100000""",
              "ticker days", "avg_volume avg_close", 6, {"avg_close": 10})),
    "agg16_totals": (
        lambda s, d: screens.totals(daily(s, d)),
        f"WITH {BARS} SELECT count(*) AS total_rows, count(DISTINCT ticker) AS unique_tickers FROM bars"),
    "agg16_volume_leaders": (
        lambda s, d: screens.volume_leaders(daily(s, d), as_of(), 15),
        f"""WITH {BARS}, {AVERAGES} SELECT ticker, CAST(shares AS BIGINT) AS avg_volume, days FROM av
            ORDER BY avg_volume DESC, ticker LIMIT 10"""),
    "agg16_cheap_and_liquid": (
        lambda s, d: screens.cheap_and_liquid(daily(s, d), as_of(), 15),
        f"""WITH {BARS}, {AVERAGES} SELECT ticker, round(price, 2) AS avg_price, CAST(shares AS BIGINT) AS avg_volume, days
            FROM av WHERE price BETWEEN 1 AND 10 AND shares > 500000 ORDER BY avg_volume DESC, ticker LIMIT 20"""),
    "agg16_widest_for_price": (
        lambda s, d: screens.widest_for_price(daily(s, d), as_of(), 15),
        f"""WITH {BARS}, {AVERAGES} SELECT ticker, round(price, 2) AS avg_price, CAST(shares AS BIGINT) AS avg_volume,
            round(width, 3) AS avg_daily_range, days FROM av WHERE price BETWEEN 1 AND 10 AND shares > 100000
            ORDER BY width / price DESC, ticker LIMIT 50"""),
    "agg17_ad_hoc_sql": (
        _register_views,
        f"""WITH {BARS} SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT ticker) AS tickers,
            CAST(sum(volume) AS BIGINT) AS volume, round(max(high), 4) AS top FROM bars GROUP BY 1"""),
    "agg17_views": (
        _views,
        f"""WITH {BARS}, v AS (SELECT ticker, avg(volume) AS av FROM bars WHERE date >= DATE '{AS_OF}' - 90 GROUP BY ticker HAVING avg(volume) >= 100000)
            SELECT count(*) AS tickers, CAST(sum(n) AS BIGINT) AS bars FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY 1) s
            WHERE ticker IN (SELECT ticker FROM v)"""),
    "agg18_distinct_dates": (
        lambda s, d: daily(s, d).select("date").distinct(),
        f"WITH {BARS} SELECT DISTINCT date FROM bars"),
    "agg19_distinct_counts": (
        lambda s, d: daily(s, d).groupBy(F.year("date").alias("year")).agg(
            screens.distinct_count("ticker").alias("tickers"), screens.distinct_count("date").alias("dates")),
        f"""WITH {BARS} SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT ticker) AS tickers,
            count(DISTINCT date) AS dates FROM bars GROUP BY 1"""),
    "agg20_ticker_detail": (
        lambda s, d: rounded(_detail(s, d)),
        check([BARS], """SELECT *, count(*) OVER (PARTITION BY ticker) AS data_points FROM
              (SELECT ticker, date, close, volume, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n
               FROM bars WHERE ticker = 'S5' AND date >= DATE '1998-01-01') a WHERE n <= 500 QUALIFY n <= 30""",
              "ticker date volume data_points", "close")),
    # --- sort, limit, sets ----------------------------------------------------------
    "srt1_sorted_bars": (
        lambda s, d: rounded(daily(s, d).select("ticker", "date", "close").orderBy("ticker", "date")),
        check([BARS], "SELECT * FROM bars ORDER BY ticker, date", "ticker date", "close")),
    "srt2_query_page": (
        lambda s, d: rounded(screens.page(daily(s, d), {"close": {"min": 5.0}}, "volume", True, 40, 60)
                             .select("ticker", "date", "close", "volume")),
        check([BARS], "SELECT * FROM bars WHERE close >= 5.0 ORDER BY volume DESC, ticker, date LIMIT 60 OFFSET 40",
              "ticker date volume", "close")),
    "srt2_query_total": (
        lambda s, d: screens.page_total(daily(s, d), {"close": {"min": 5.0}}),
        f"WITH {BARS} SELECT count(*) AS total FROM bars WHERE close >= 5.0"),
    "srt4_newest_per_ticker": (
        lambda s, d: rounded(screens.newest_per_ticker(daily(s, d), 5).select("ticker", "date", "close")),
        check([BARS], "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5",
              "ticker date", "close")),
    "set1_concat": (
        _concat,
        check([BARS], """SELECT ticker, date, close, NULL::BIGINT AS volume, 'low' AS part FROM bars WHERE close < 10
              UNION ALL SELECT ticker, date, close, volume, 'high' FROM bars WHERE close >= 10""",
              "ticker date volume part", "close")),
    "set2_difference": (
        lambda s, d: daily(s, d).select("date").distinct().exceptAll(
            table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()),
        f"WITH {BARS} SELECT DISTINCT date FROM bars EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders"),
    "set3_distinct_keys": (
        lambda s, d: minute(s, d).select("ticker", "date").distinct(),
        f"WITH {MINUTES} SELECT DISTINCT ticker, date FROM mins"),
    # --- plain windows ----------------------------------------------------------------
    "win1_daily_return": (
        lambda s, d: rounded(returns.daily_returns(daily(s, d)).select("ticker", "date", "ret_d")),
        check([BARS, RETS], "SELECT * FROM rets", "ticker date", "ret_d")),
    "win2_daily_derivatives": (
        lambda s, d: rounded(with_returns(s, d).select("ticker", "date", "ret_d", "abs_ret_d", "abs_change_d", "close_in_band")),
        check([BARS, DERIVED], "SELECT * FROM derived", "ticker date close_in_band", "ret_d abs_ret_d abs_change_d")),
    "win3_weekly_derivatives": (
        lambda s, d: rounded(returns.weekly_returns(daily(s, d)).select("ticker", "week_start", "ret_w", "abs_ret_w", "abs_change_w")),
        check([BARS, WEEKS], "SELECT * FROM weeks", "ticker week_start", "ret_w abs_ret_w abs_change_w")),
    "win16_forward_returns": (
        lambda s, d: rounded(returns.forward_returns(daily(s, d)).select("ticker", "date", "fwd_ret_1d", "fwd_ret_5d", "fwd_ret_10d")),
        check([BARS], "SELECT ticker, date, " + ", ".join(
            f"lead(close, {p}) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS fwd_ret_{p}d" for p in (1, 5, 10))
            + " FROM bars", "ticker date", "fwd_ret_1d fwd_ret_5d fwd_ret_10d")),
}


def _since_newest(s, d):
    from ..operators.scoring import since_newest
    return since_newest(daily(s, d)).select("ticker", "date", "close")


def _since(s, d):
    from ..operators.scoring import since
    return since(daily(s, d), as_of()).select("ticker", "date", "close")


def _aligned(s, d):
    from .tables import market
    bars = daily(s, d)
    r = returns.daily_returns(bars).filter(F.col("ret_d").isNotNull())
    return r.join(market(bars), "date").select("ticker", "date", "ret_d", "ret_m")


def _detail(s, d):
    one = screens.ticker_detail(daily(s, d), "S5", F.lit("1998-01-01").cast("date"))
    return one.select("ticker", "data_points", F.explode("price_history").alias("b")).select(
        "ticker", "data_points", "b.date", "b.close", "b.volume")
