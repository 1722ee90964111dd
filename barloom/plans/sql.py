"""DuckDB statements equivalent to the registered queries: written apart from the DataFrame code, to check it."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY ts"
TICK_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, price"

TRADES = "trades AS (SELECT *, CAST(l_shipdate AS DATE) AS ts, 100*(1-l_discount)*(1+l_tax) AS price FROM lineitem)"
BARS = f"""{TRADES},
bars AS (SELECT p_type AS symbol, ts, first(price ORDER BY {TICK_ORDER}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {TICK_ORDER}) AS close, sum(l_quantity) AS volume
  FROM trades JOIN part ON l_partkey = p_partkey GROUP BY p_type, ts)"""
MARKET = """market AS (SELECT ts, sum(price*l_quantity)/sum(l_quantity) AS mkt_close, sum(l_quantity) AS mkt_volume, max(price) AS mkt_high, min(price) AS mkt_low
  FROM trades GROUP BY ts),
market_r AS (SELECT *, ln(mkt_close / lag(mkt_close) OVER (ORDER BY ts)) AS mkt_return FROM market)"""
JOINED = "joined AS (SELECT bars.*, mkt_close, mkt_return FROM bars JOIN market_r USING (ts) WHERE mkt_return IS NOT NULL)"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def adjust(source: str, extra: str = "1.0::DOUBLE AS split_factor, 0.0::DOUBLE AS dividend") -> str:
    return f"""act AS (SELECT *, {extra} FROM {source}),
grown AS (SELECT *, (close + dividend) / (lag(close) OVER ({P}) * split_factor) AS growth FROM act),
adj0 AS (SELECT *, CASE WHEN growth IS NULL THEN close ELSE round(first(close) OVER ({P} {PAST}) * product(growth) OVER ({P} {PAST}), 8) END AS close_adj FROM grown),
adj AS (SELECT *, open*(close_adj/close) AS open_adj, high*(close_adj/close) AS high_adj, low*(close_adj/close) AS low_adj FROM adj0)"""


PANEL = f"""{BARS}, {MARKET}, {JOINED}, {adjust("joined")},
panel AS (SELECT *, ln(close_adj / lag(close_adj) OVER ({P})) AS log_return, ln(open_adj / lag(close_adj) OVER ({P})) AS overnight_return,
  ln(close_adj/open_adj) AS intraday_return, ln(high_adj/low_adj) AS hl_log_range, coalesce(ln(close_adj / lag(close_adj) OVER ({P})), 0) AS r FROM adj)"""
BOOK = """book AS (SELECT *, low AS bid_price_1, high AS ask_price_1, volume*0.4 AS bid_size_1, abs(close-open)*10.0+1.0 AS ask_size_1,
  low-0.5 AS bid_price_2, high+0.5 AS ask_price_2, volume*0.3 AS bid_size_2, volume*0.2+1.0 AS ask_size_2 FROM panel)"""


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({P})"


def diff(x: str, k: int = 1) -> str:
    return f"({x} - {lag(x, k)})"


def roll(agg: str, x: str, n: int, shift: int = 0, y: str | None = None) -> str:
    over = f"OVER ({P} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    args, seen = (x, x) if y is None else (f"{x}, {y}", f"{x} + {y}")
    return f"(CASE WHEN count({seen}) {over} = {n} THEN {agg}({args}) {over} END)"


def mean(x: str, n: int, shift: int = 0) -> str:
    return roll("avg", x, n, shift)


def std(x: str, n: int, shift: int = 0) -> str:
    return roll("stddev_samp", x, n, shift)


def total(x: str, n: int, shift: int = 0) -> str:
    return roll("sum", x, n, shift)


def z(x: str, n: int, shift: int = 0) -> str:
    return f"(({x} - {mean(x, n, shift)}) / ({std(x, n, shift)} + 1e-8))"


def chain(base: str, source: str, *steps: dict[str, str]) -> tuple[str, str]:
    """WITH list and last name of selects that each add columns."""
    parts, name = [base], source
    for i, step in enumerate(steps):
        parts.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM {name})")
        name = f"s{i}"
    return ",\n".join(parts), name


def shown(base: str, source: str, digits: int | dict[str, int], names: list[str], *steps: dict[str, str], keys: str = "symbol, ts") -> str:
    parts, name = chain(base, source, *steps)
    at = digits if isinstance(digits, dict) else dict.fromkeys(names, digits)
    columns = ", ".join(f"round({c}::DOUBLE, {at[c]}) + 0.0::DOUBLE AS {c}" for c in names)
    return f"WITH {parts}\nSELECT {keys}, {columns} FROM {name}"


def gamma_tail(a: float, z: str) -> str:
    """The upper regularised gamma function, as one minus its series: tails of the normal (a = 1/2) and of chi-squared."""
    return f"(CASE WHEN {z} > 300 THEN 0.0 WHEN {z} <= 0 THEN 1.0 ELSE 1 - list_sum([exp(({a} + k)*ln({z}) - {z} - lgamma({a} + k + 1)) FOR k IN range(0, 900)]) END)"
