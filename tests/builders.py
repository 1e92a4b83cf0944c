"""Tables and columns that several test files use."""

import datetime


def day(n: int):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def bars(spark, closes, ticker="A", spread=0.0, volume=100):
    """Daily bars from closing prices."""
    rows = [(ticker, day(i), c, c + spread, c - spread, c, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]
