"""Registration helpers and the SQL form of the shared views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

PRICES = ("open", "high", "low", "close")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its twin."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r(expression: str, digits: int = 6) -> str:
    """Rounded SQL value without a negative zero."""
    value = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"(CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END)"


def rnd(column: str | Column, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits)


def rounded(df, columns, digits: int = 6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def rsql(columns, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


VIEWS = {
    "bars": ((), """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date,
        arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2"""),
    "panel": (("bars",), """SELECT t.ticker, d.date, b.open, b.high, b.low, b.close, b.volume
        FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT date FROM bars) d
        LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date"""),
    "ticks": ((), """SELECT event_type AS ticker, ts, event_id AS seq, value AS price, user_id
        FROM events"""),
    "messages": (("ticks",), """SELECT 'instant_' || lower(ticker) AS topic, CAST(user_id % 16 AS INTEGER) AS partition,
        seq AS "offset", ticker, '1d' AS period, CASE WHEN user_id % 5 = 0 THEN 'tick' ELSE '1m' END AS "interval",
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || (CASE seq % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' ELSE '' END)
        AS "timestamp", price * 1.25::DOUBLE AS open, price * 2 AS high, price / 2 AS low, price AS close,
        CAST(user_id % 1000 + 1 AS BIGINT) AS volume,
        ts AS event_ts FROM ticks"""),
    "doubled": (("messages",), """SELECT * FROM messages UNION ALL
        SELECT * REPLACE ("offset" + 1000000000 AS "offset") FROM messages"""),
    "logs": (("bars",), "SELECT *, " + ", ".join(f"ln(nullif({p}, 0)) AS {p}_log" for p in PRICES) + " FROM bars"),
    "ret": (("logs",), "SELECT *, " + ", ".join(
        f"{p}_log - lag({p}_log) OVER (PARTITION BY ticker ORDER BY date) AS {p}_log_return" for p in PRICES)
        + ", row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM logs"),
    "xy": (("ret",), """SELECT ticker, date, x, y, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
        count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, date,
        lag(close_log_return) OVER (PARTITION BY ticker ORDER BY date) AS x,
        lead(close_log_return) OVER (PARTITION BY ticker ORDER BY date) AS y FROM ret)
        WHERE x IS NOT NULL AND y IS NOT NULL"""),
    "folds": ((), "SELECT unnest([0, 1, 2, 3])::BIGINT AS fold"),
    "parts": (("xy", "folds"), """SELECT xy.*, fold, n - (4 - fold) * (n // 5) AS test_start, n // 5 AS size
        FROM xy CROSS JOIN folds"""),
    "lines": (("parts",), """SELECT ticker, fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
        FROM parts WHERE pos < test_start GROUP BY 1, 2"""),
    "preds": (("parts", "lines"), """SELECT p.ticker, p.fold, p.date, l.slope * p.x + l.intercept AS pred, p.y AS actual
        FROM parts p JOIN lines l ON l.ticker = p.ticker AND l.fold = p.fold
        WHERE p.pos >= p.test_start AND p.pos < p.test_start + p.size"""),
    "nets_flat": (("preds",), """SELECT *, position * actual - cost AS net FROM (SELECT *,
        CASE WHEN position - previous <> 0 THEN 0.0001 ELSE 0.0 END AS cost FROM (SELECT *,
        lag(position, 1, 0.0) OVER (PARTITION BY ticker, fold ORDER BY date) AS previous FROM (
        SELECT *, CAST(sign(pred) AS DOUBLE) AS position FROM preds)))"""),
    "nets_turnover": (("preds",), """SELECT *, position * actual - cost AS net FROM (SELECT *,
        abs(position - previous) * 0.0001 AS cost FROM (SELECT *,
        lag(position, 1, 0.0) OVER (PARTITION BY ticker, fold ORDER BY date) AS previous FROM (
        SELECT *, CASE WHEN abs(pred) < 1e-5 THEN 0.0 ELSE CAST(sign(pred) AS DOUBLE) END AS position FROM preds)))"""),
    "cums_flat": (("nets_flat",), """SELECT *, sum(net) OVER (PARTITION BY ticker, fold ORDER BY date
        ROWS UNBOUNDED PRECEDING) AS cum FROM nets_flat"""),
    "cums_turnover": (("nets_turnover",), """SELECT *, sum(net) OVER (PARTITION BY ticker, fold ORDER BY date
        ROWS UNBOUNDED PRECEDING) AS cum FROM nets_turnover"""),
    "dd_flat": (("cums_flat",), """SELECT ticker, fold, min(cum - top) AS max_dd FROM (SELECT *, max(cum) OVER (
        PARTITION BY ticker, fold ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM cums_flat) GROUP BY 1, 2"""),
    "dd_turnover": (("cums_turnover",), """SELECT ticker, fold, max(top - cum) AS max_dd FROM (SELECT *, max(cum) OVER (
        PARTITION BY ticker, fold ORDER BY date ROWS UNBOUNDED PRECEDING) AS top FROM cums_turnover) GROUP BY 1, 2"""),
    "ic_rank": (("preds",), """SELECT ticker, fold, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic
        FROM (SELECT ticker, fold,
        rank() OVER (PARTITION BY ticker, fold ORDER BY pred)
          + (count(*) OVER (PARTITION BY ticker, fold, pred) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY ticker, fold ORDER BY actual)
          + (count(*) OVER (PARTITION BY ticker, fold, actual) - 1) / 2.0 AS b FROM preds) GROUP BY 1, 2"""),
    "report_flat": (("nets_flat", "dd_flat", "ic_rank"), """SELECT m.*, d.max_dd, i.ic FROM (SELECT ticker, fold,
        avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
        avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END) AS dir_acc,
        coalesce(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252), 0.0) AS sharpe,
        avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(net) AS net_pnl
        FROM nets_flat GROUP BY 1, 2) m JOIN dd_flat d ON d.ticker = m.ticker AND d.fold = m.fold
        JOIN ic_rank i ON i.ticker = m.ticker AND i.fold = m.fold"""),
    "report_turnover": (("nets_turnover", "dd_turnover"), """SELECT m.*, d.max_dd FROM (SELECT ticker, fold,
        avg(net) / nullif(stddev_pop(net), 0) * sqrt(252) AS sharpe,
        avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END) AS hit_rate,
        CASE WHEN stddev_pop(pred) > 0 AND stddev_pop(actual) > 0 THEN corr(pred, actual) END AS ic,
        sum(net) AS net_pnl FROM nets_turnover GROUP BY 1, 2) m
        JOIN dd_turnover d ON d.ticker = m.ticker AND d.fold = m.fold"""),
}


def grade_sql(ic: str = "ic", dir_acc: str = "dir_acc", sharpe: str = "sharpe") -> str:
    return f"""CASE WHEN {ic} > 0.04 AND {dir_acc} > 0.53 AND {sharpe} > 1.5 THEN 'Exceptional'
        WHEN {ic} > 0.03 AND {dir_acc} > 0.52 AND {sharpe} > 1.0 THEN 'Strong'
        WHEN {ic} > 0.02 AND {dir_acc} > 0.51 AND {sharpe} > 0.5 THEN 'Acceptable'
        WHEN {ic} > 0.01 AND {dir_acc} > 0.50 AND {sharpe} > 0.0 THEN 'Marginal' ELSE 'Weak' END"""


def using(views: str, body: str, **extra: str) -> str:
    """SQL with the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for parent in VIEWS[name][0]:
                visit(parent)
            order.append(name)

    for v in views.split():
        visit(v)
    ctes = [f"{v} AS ({VIEWS[v][1]})" for v in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(ctes)} {body}"
