"""Registered queries of the feature families, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators import prep
from barloom.plans.panel import panel, shown, with_book
from barloom.plans.sql import BOOK, P, PANEL, PAST, chain, diff, lag, mean, roll, std, total, z
from barloom.plans.sql import shown as sql_shown

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: key -> (names, SQL steps, base, source) of the families that SQL expresses.
FAMILIES: dict[str, tuple] = {}
SPAN = "(high_adj - low_adj + 1e-8)"


def family(key: str, job, digits: int | dict[str, int], names: list[str], *steps: dict[str, str], source=None, base: str = PANEL, at: str = "panel") -> None:
    QUERIES[key] = lambda spark, sf_dir: shown(job((source or panel)(spark, sf_dir)), digits, *names)
    if steps:
        SQL[key] = sql_shown(base, at, digits, names, *steps)
        FAMILIES[key] = (job, names, steps, base, at)


family(
    "feat_baseline",
    X.baseline,
    6,
    ["geo_body_ratio", "geo_upper_shadow", "geo_lower_shadow", "overnight_gap"],
    {
        "geo_body_ratio": f"(close_adj - open_adj) / {SPAN}",
        "geo_upper_shadow": f"(high_adj - greatest(open_adj, close_adj)) / {SPAN}",
        "geo_lower_shadow": f"(least(open_adj, close_adj) - low_adj) / {SPAN}",
        "overnight_gap": f"open_adj / {lag('close_adj')} - 1",
    },
)
family(
    "feat_volume_shock",
    X.volume_shock,
    6,
    ["rvol_5", "vol_shock_5", "rvol_20", "vol_shock_20"],
    {"lv": "ln(volume + 1e-8)"},
    {f"rvol_{k}": f"volume / ({mean('volume', k, 1)} + 1e-8)" for k in (5, 20)} | {f"vol_shock_{k}": z("lv", k, 1) for k in (5, 20)},
)
family(
    "feat_calendar",
    X.calendar,
    6,
    ["sin_dow", "cos_dow", "sin_month", "cos_month"],
    {
        "sin_dow": "sin(2*pi()*(isodow(ts)-1)/5.0)",
        "cos_dow": "cos(2*pi()*(isodow(ts)-1)/5.0)",
        "sin_month": "sin(2*pi()*month(ts)/12.0)",
        "cos_month": "cos(2*pi()*month(ts)/12.0)",
    },
)
family(
    "feat_trend",
    X.trend,
    6,
    ["ret_1", "ret_5", "ret_20", "tsmom_sign_1", "tsmom_sign_5", "tsmom_sign_20", "breakout_ratio_5", "breakout_ratio_20"],
    {f"ret_{k}": f"ln(close_adj / {lag('close_adj', k)})" for k in (1, 5, 20)}
    | {f"hi_{k}": roll("max", "close_adj", k, 1) for k in (5, 20)}
    | {f"lo_{k}": roll("min", "close_adj", k, 1) for k in (5, 20)},
    {f"tsmom_sign_{k}": f"sign(ret_{k})::DOUBLE" for k in (1, 5, 20)} | {f"breakout_ratio_{k}": f"(close_adj - hi_{k}) / (hi_{k} - lo_{k} + 1e-8)" for k in (5, 20)},
)


def _ema(span: int) -> str:
    """y_t = q^t (x_0 + a * sum of x_i q^-i), q = 1 - a; exact while q^-t is finite."""
    q = 1 - 2 / (span + 1)
    return f"pow({q!r}, i) * (first(close_adj) OVER ({P} {PAST}) + {1 - q!r} * sum(CASE WHEN i > 0 THEN close_adj * pow({q!r}, -i) ELSE 0 END) OVER ({P} {PAST}))"


family(
    "feat_macd",
    X.macd,
    6,
    ["macd_dist", "macd_slope_5"],
    {"i": f"row_number() OVER ({P}) - 1"},
    {"ema12": _ema(12), "ema26": _ema(26)},
    {"macd_dist": "ema12/ema26 - 1"},
    {"macd_slope_5": diff("macd_dist", 5)},
)
family(
    "feat_oscillators",
    X.oscillators,
    6,
    [f"{n}_{k}" for k in (5, 10, 20) for n in ("zscore", "bollinger_pctB")] + ["rsi_14"],
    {f"m{k}": mean("close_adj", k, 1) for k in (5, 10, 20)} | {f"d{k}": std("close_adj", k, 1) for k in (5, 10, 20)} | {"delta": f"coalesce({diff('close_adj')}, 0)"},
    {f"zscore_{k}": f"(close_adj - m{k}) / (d{k} + 1e-8)" for k in (5, 10, 20)}
    | {f"bollinger_pctB_{k}": f"(close_adj - (m{k} - 2*d{k})) / ((m{k} + 2*d{k}) - (m{k} - 2*d{k}) + 1e-8)" for k in (5, 10, 20)}
    | {"gain": "CASE WHEN delta > 0 THEN delta ELSE 0 END", "loss": "CASE WHEN delta < 0 THEN -delta ELSE 0 END"},
    {"rsi_14": f"100 - 100 / (1 + {mean('gain', 14, 1)} / ({mean('loss', 14, 1)} + 1e-8))"},
)
_W = X.fractional_weights(0.4)
QUERIES["feat_fractional_memory"] = lambda spark, sf_dir: shown(X.fractional_memory(panel(spark, sf_dir)).withColumnRenamed("frac_diff_d0.40", "frac_diff"), 6, "frac_diff")
SQL["feat_fractional_memory"] = sql_shown(
    PANEL,
    "panel",
    6,
    ["frac_diff"],
    {"past": f"list(close_adj) OVER ({P} ROWS BETWEEN {len(_W) - 1} PRECEDING AND CURRENT ROW)", "rows_seen": f"count(close_adj) OVER ({P} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"},
    {"frac_diff": f"CASE WHEN rows_seen >= 10 THEN list_inner_product(list_reverse(past), ([{', '.join(map(repr, _W))}])[1:len(past)]) END"},
)
family(
    "feat_wavelet",
    X.wavelet,
    {"wavelet_detail_d1": 7, "wavelet_detail_d2": 7, "wavelet_approx_a3": 8, "wavelet_energy_ratio": 4},
    ["wavelet_detail_d1", "wavelet_detail_d2", "wavelet_approx_a3", "wavelet_energy_ratio"],
    {
        "wavelet_detail_d1": f"(close_adj - {lag('close_adj')}) / sqrt(2.0::DOUBLE)",
        "wavelet_detail_d2": f"((close_adj + {lag('close_adj')}) - ({lag('close_adj', 2)} + {lag('close_adj', 3)})) / 2",
        "wavelet_approx_a3": mean("close_adj", 8),
    },
    {"wavelet_energy_ratio": "pow(wavelet_detail_d1, 2) / (pow(wavelet_detail_d2, 2) + 1e-8)"},
)
family(
    "feat_kinematics",
    X.kinematics,
    6,
    ["kinematic_velocity", "kinematic_acceleration", "kinematic_jerk", "kinematic_squeeze_ratio", "kinematic_clv_vol", "kinematic_clv_vol_roll20"],
    {
        "kinematic_velocity": "r",
        "tr": f"greatest(high_adj - low_adj, abs(high_adj - {lag('close_adj')}), abs(low_adj - {lag('close_adj')}))",
        "kinematic_clv_vol": f"((close_adj - low_adj) - (high_adj - close_adj)) / {SPAN} * volume",
    },
    {"kinematic_acceleration": diff("kinematic_velocity")},
    {
        "kinematic_jerk": diff("kinematic_acceleration"),
        "kinematic_squeeze_ratio": f"4 * {std('close_adj', 20, 1)} / (3 * {mean('tr', 20, 1)} + 1e-8)",
        "kinematic_clv_vol_roll20": mean("kinematic_clv_vol", 20),
    },
)
family(
    "feat_liquidity",
    X.liquidity,
    6,
    ["liq_amihud_raw", "liq_amihud_z", "liq_roll_measure_20", "liq_log_turnover", "liq_turnover_ratio_20"],
    {"money": "close * volume", "before": lag("log_return")},
    {"liq_amihud_raw": "abs(log_return) / nullif(money, 0)"},
    {
        "liq_amihud_z": f"(liq_amihud_raw - {mean('liq_amihud_raw', 20)}) / ({std('liq_amihud_raw', 20)} + 1e-8)",
        "liq_roll_measure_20": f"CASE WHEN count(log_return) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN corr(log_return, before) OVER ({P} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) END",
        "liq_log_turnover": "ln(money + 1e-8)",
        "liq_turnover_ratio_20": f"money / ({mean('money', 20, 1)} + 1e-8)",
    },
)
family(
    "feat_order_flow",
    X.order_flow,
    6,
    ["flow_imbalance_proxy", "flow_imbalance_zscore", "flow_vpin_10"],
    {"flow_imbalance_proxy": f"((close_adj - low_adj) / {SPAN} - (high_adj - close_adj) / {SPAN}) * volume"},
    {"flow_imbalance_zscore": z("flow_imbalance_proxy", 20), "flow_vpin_10": f"{total('abs(flow_imbalance_proxy)', 10)} / ({total('volume', 10)} + 1e-8)"},
)
family("feat_gmm_regimes", X.gmm_regimes, 6, ["gmm_prob_bull", "gmm_prob_bear"])
family(
    "feat_volume_price",
    X.volume_price,
    6,
    ["cmf_20", "cmf_slope_5", "obv_zscore_20", "obv_slope_5", "vpt_zscore_20", "cmf_price_divergence"],
    {
        "fl": f"((close_adj - low_adj) - (high_adj - close_adj)) / {SPAN} * volume",
        "obv": f"sum(sign(r) * volume) OVER ({P} {PAST})",
        "vpt": f"sum(r * volume) OVER ({P} {PAST})",
    },
    {"cmf_20": f"{total('fl', 20)} / ({total('volume', 20)} + 1e-8)"},
    {
        "cmf_slope_5": diff("cmf_20", 5),
        "obv_zscore_20": z("obv", 20),
        "obv_slope_5": f"{diff('obv', 5)} / ({mean('volume', 20)} + 1e-8)",
        "vpt_zscore_20": z("vpt", 20),
        "cmf_price_divergence": f"cmf_20 - (close_adj / {lag('close_adj', 20)} - 1)",
    },
)
family(
    "feat_candle_pressure",
    X.candle_pressure,
    6,
    ["net_pressure_ratio", "net_pressure_volume", "net_pressure_vol_roll", "wick_absorption_direction", "wick_absorption_thrust", "body_direction_momentum", "body_direction_accel"],
    {
        "net_pressure_ratio": f"(close_adj - low_adj) / {SPAN} - (high_adj - close_adj) / {SPAN}",
        "wick_absorption_direction": f"((least(open_adj, close_adj) - low_adj) - (high_adj - greatest(open_adj, close_adj))) / {SPAN}",
        "body": f"(close_adj - open_adj) / {SPAN}",
    },
    {"net_pressure_volume": "net_pressure_ratio * ln(volume + 1.0)", "body_direction_momentum": mean("body", 5)},
    {
        "net_pressure_vol_roll": mean("net_pressure_volume", 14),
        "wick_absorption_thrust": f"wick_absorption_direction * (volume / ({mean('volume', 14)} + 1e-8))",
        "body_direction_accel": diff("body_direction_momentum", 2),
    },
)
_K = 0.34 / (1.34 + 21.0 / 19.0)
family(
    "feat_range_volatility",
    X.range_volatility,
    6,
    ["vol_parkinson", "vol_garman_klass", "vol_rogers_satchell", "vol_yang_zhang"],
    {
        "hl": "ln(high_adj/low_adj)",
        "co": "ln(close_adj/open_adj)",
        "rs": "ln(high_adj/close_adj)*ln(high_adj/open_adj) + ln(low_adj/close_adj)*ln(low_adj/open_adj)",
        "oc": f"ln(open_adj / {lag('close_adj')})",
    },
    {
        "vol_parkinson": f"sqrt(hl*hl / (4 * {math.log(2.0)!r}))",
        "vol_garman_klass": f"sqrt(greatest(0, 0.5*hl*hl - {2 * math.log(2.0) - 1!r}*co*co))",
        "vol_rogers_satchell": "sqrt(greatest(0, rs))",
        "yz": f"{roll('var_samp', 'oc', 20)} + {_K!r} * {roll('var_samp', 'co', 20)} + {1 - _K!r} * {mean('rs', 20)}",
    },
    {"vol_yang_zhang": "CASE WHEN yz IS NOT NULL THEN sqrt(greatest(0, yz)) END"},
)
family(
    "feat_semi_deviation",
    X.semi_deviation,
    6,
    ["vol_downside_dev_20", "vol_upside_dev_20", "vol_semi_variance_ratio_raw"],
    {"dn": "CASE WHEN log_return < 0 THEN log_return ELSE 0 END", "up": "CASE WHEN log_return > 0 THEN log_return ELSE 0 END"},
    {"vol_downside_dev_20": std("dn", 20), "vol_upside_dev_20": std("up", 20)},
    {"vol_semi_variance_ratio_raw": "vol_downside_dev_20 / (vol_upside_dev_20 + 1e-8)"},
)
family(
    "feat_moments",
    X.moments,
    6,
    ["skewness_20", "kurtosis_20"],
    {"skewness_20": roll("skewness", "log_return", 20), "kurtosis_20": roll("kurtosis", "log_return", 20)},
)
family(
    "feat_jumps",
    X.jumps,
    4,
    ["jump_diffusion_component", "continuous_vol_ratio", "jump_signed_shock"],
    {"pair": f"abs(r) * abs({lag('r')})"},
    {"rv": total("r*r", 20), "bv": f"pi()/2 * {total('pair', 20)}"},
    {"jump_diffusion_component": "CASE WHEN rv - bv IS NOT NULL THEN greatest(rv - bv, 0) / (rv + 1e-8) END", "continuous_vol_ratio": "bv / (rv + 1e-8)"},
    {"jump_signed_shock": "jump_diffusion_component * sign(r)"},
)
family(
    "feat_signed_volatility",
    X.signed_volatility,
    4,
    ["vol_directional_bias", "vol_directional_accel", "signed_expansion_thrust"],
    {"dv": mean("(CASE WHEN r < 0 THEN r*r ELSE 0 END)", 20), "uv": mean("(CASE WHEN r > 0 THEN r*r ELSE 0 END)", 20)},
    {"vol_directional_bias": "(uv - dv) / (uv + dv + 1e-8)"},
    {"vol_directional_accel": diff("vol_directional_bias", 3), "signed_expansion_thrust": "sign(close_adj - open_adj) * ln(high_adj/low_adj)"},
)
MARKET_NAMES = ["mkt_relative_return", "mkt_rs_cum_20", "mkt_rs_momentum", "mkt_rolling_beta_60", "mkt_beta_shock", "mkt_vol_ratio_20", "mkt_correlation_20", "mkt_divergence_signed"]
family(
    "feat_market_context",
    X.market_context,
    6,
    MARKET_NAMES,
    {
        "mkt_relative_return": "r - mkt_return",
        "mkt_rs_cum_20": f"{total('r', 20)} - {total('mkt_return', 20)}",
        "beta": f"{roll('covar_samp', 'r', 60, y='mkt_return')} / ({roll('var_samp', 'mkt_return', 60)} + 1e-8)",
        "mkt_vol_ratio_20": f"{std('r', 20)} / ({std('mkt_return', 20)} + 1e-8)",
        "mkt_correlation_20": f"coalesce({roll('corr', 'r', 20, y='mkt_return')}, 0)",
        "mkt_divergence_signed": "sign(r) * sign(mkt_return) * (r - mkt_return)",
    },
    {"mkt_rolling_beta_60": "CASE WHEN beta IS NOT NULL THEN greatest(-1.0, least(3.5, beta)) END"},
    {"mkt_rs_momentum": diff("mkt_rs_cum_20", 5), "mkt_beta_shock": diff("mkt_rolling_beta_60", 5)},
)
family(
    "feat_shadow_pressure",
    X.shadow_pressure,
    3,
    ["shadow_asymmetry_ratio", "buying_tail_power", "selling_tail_power", "body_efficiency_ratio"],
    {"us": "high_adj - greatest(open_adj, close_adj)", "ls": "least(open_adj, close_adj) - low_adj"},
    {
        "shadow_asymmetry_ratio": f"(us - ls) / {SPAN}",
        "buying_tail_power": f"ls / {SPAN} * volume",
        "selling_tail_power": f"us / {SPAN} * volume",
        "body_efficiency_ratio": f"abs(close_adj - open_adj) / {SPAN}",
    },
)
_PATTERN = "CASE WHEN a IS NULL THEN NULL WHEN a <= b AND b <= r THEN 0 WHEN a <= r AND r < b THEN 1 WHEN b < a AND a <= r THEN 2 WHEN b <= r AND r < a THEN 3 WHEN r < a AND a <= b THEN 4 ELSE 5 END"
_FRAME18 = f"OVER ({P} ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)"
family(
    "feat_complexity",
    X.complexity,
    6,
    ["chaos_permutation_entropy_20", "lz_complexity_proxy_20"],
    {"a": lag("r", 2), "b": lag("r"), "up": "(CASE WHEN r > 0 THEN 1 ELSE 0 END)"},
    {"pat": _PATTERN, "flip": f"abs({diff('up')})::DOUBLE"},
    {f"q{k}": f"sum(CASE WHEN pat = {k} THEN 1 ELSE 0 END) {_FRAME18} / 18.0::DOUBLE" for k in range(6)} | {"seen": f"count(pat) {_FRAME18}", "lz_complexity_proxy_20": mean("flip", 20)},
    {"chaos_permutation_entropy_20": "CASE WHEN seen = 18 THEN -(" + " + ".join(f"(CASE WHEN q{k} > 0 THEN q{k} * log2(q{k} + 1e-8) ELSE 0 END)" for k in range(6)) + ") / log2(6.0::DOUBLE) END"},
)
BOOK_NAMES = [
    "l2_micro_dev_raw", "l2_micro_dev_accel", "l2_spread_zscore", "l2_order_imbalance_raw", "l2_order_imbalance_z", "l2_depth_total", "l2_depth_ratio",
    "l2_bid_replenishment", "l2_ask_replenishment", "l2_bid_withdrawal", "l2_ask_withdrawal",
]
_D = math.exp(-0.5)
L2_STEPS = (
    {
        "bs": f"bid_size_1 + bid_size_2*{_D!r}",
        "asz": f"ask_size_1 + ask_size_2*{_D!r}",
        "bp": f"bid_price_1*bid_size_1 + bid_price_2*(bid_size_2*{_D!r})",
        "ap": f"ask_price_1*ask_size_1 + ask_price_2*(ask_size_2*{_D!r})",
        "mid_price": "(bid_price_1 + ask_price_1)/2",
        "l2_spread": "ask_price_1 - bid_price_1",
    },
    {"order_imbalance_depth": "(bs - asz)/(bs + asz + 1e-8)", "micro_price_depth": "(bp/(bs+1e-8)*asz + ap/(asz+1e-8)*bs)/(bs + asz + 1e-8)"},
    {"micro_mid_deviation": "micro_price_depth - mid_price"},
)
family(
    "feat_book_dynamics",
    lambda df: X.book_dynamics(prep.book_l2(with_book(df))),
    4,
    BOOK_NAMES,
    *L2_STEPS,
    {"imb": "bid_size_1 - ask_size_1", "db": f"coalesce({diff('bid_size_1')}, 0)", "da": f"coalesce({diff('ask_size_1')}, 0)"},
    {
        "l2_micro_dev_raw": "micro_mid_deviation",
        "l2_micro_dev_accel": diff("micro_mid_deviation"),
        "l2_spread_zscore": z("l2_spread", 20),
        "l2_order_imbalance_raw": "imb",
        "l2_order_imbalance_z": z("imb", 20),
        "l2_depth_total": "bid_size_1 + ask_size_1",
        "l2_depth_ratio": "bid_size_1 / (ask_size_1 + 1e-8)",
        "l2_bid_replenishment": "greatest(db, 0)",
        "l2_ask_replenishment": "greatest(da, 0)",
        "l2_bid_withdrawal": "greatest(-db, 0)",
        "l2_ask_withdrawal": "greatest(-da, 0)",
    },
    base=f"{PANEL}, {BOOK}",
    at="book",
)
_DEN = 3.0 - 2.0 * math.sqrt(2.0)
family(
    "feat_corwin_schultz",
    X.corwin_schultz,
    6,
    ["liq_spread_cs"],
    {"h1": lag("high"), "l1": lag("low")},
    {"g": "pow(ln(high/low), 2) + pow(ln(h1/l1), 2)", "bt": "CASE WHEN h1 IS NOT NULL THEN pow(ln(greatest(high, h1)/least(low, l1)), 2) END"},
    {"al": f"(sqrt(2*bt) - sqrt(bt)) / {_DEN!r} - sqrt(g / {_DEN!r})"},
    {"liq_spread_cs": "CASE WHEN al IS NOT NULL THEN greatest(0, 2*(exp(al) - 1)/(1 + exp(al))) END"},
)
family(
    "feat_nonlinear",
    X.nonlinear,
    6,
    ["nonlin_ret_squared_signed", "nonlin_ret_cubed", "nonlin_range_x_ret", "nonlin_ret_x_volshock"],
    {
        "nonlin_ret_squared_signed": "pow(log_return, 2) * sign(log_return)",
        "nonlin_ret_cubed": "pow(log_return, 3)",
        "nonlin_range_x_ret": "ln(high_adj/low_adj) * log_return",
        "nonlin_ret_x_volshock": f"log_return * (volume / ({mean('volume', 20, 1)} + 1e-8))",
    },
)
family(
    "feat_median_regime",
    X.median_regime,
    6,
    ["regime_p_high_vol", "regime_weighted_return", "regime_transition_shock"],
    {"s20": std("log_return", 20)},
    {"half": roll("median", "s20", 60, 1)},
    {"regime_p_high_vol": "CASE WHEN s20 > half THEN 1.0 ELSE 0.0 END"},
    {"regime_weighted_return": "log_return * regime_p_high_vol", "regime_transition_shock": f"abs({diff('regime_p_high_vol')})"},
)
family(
    "feat_efficiency",
    X.efficiency,
    6,
    ["chaos_hurst_proxy", "chaos_shannon_entropy_20", "chaos_kaufman_er_10"],
    {"w20": f"list(r) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "st": f"abs({diff('close_adj')})"},
    {"lo": "list_min(w20)", "wide": "list_max(w20) - list_min(w20)"},
    {"bins": "CASE WHEN len(w20) = 20 AND wide > 0 THEN list_transform(w20, lambda x: least(9, floor((x - lo) / wide * 10))) END"},
    {
        "chaos_hurst_proxy": f"ln({std('r', 20)} / ({std('r', 5)} + 1e-8)) / ln(4.0::DOUBLE)",
        "chaos_shannon_entropy_20": "CASE WHEN len(w20) = 20 AND wide = 0 THEN 0 WHEN bins IS NOT NULL THEN "
        + "-("
        + " + ".join(f"(CASE WHEN len(list_filter(bins, lambda x: x = {k})) > 0 THEN len(list_filter(bins, lambda x: x = {k})) / 20.0::DOUBLE * ln(len(list_filter(bins, lambda x: x = {k})) / 20.0::DOUBLE) ELSE 0 END)" for k in range(10))
        + ") END",
        "chaos_kaufman_er_10": f"abs({diff('close_adj', 10)}) / ({total('st', 10)} + 1e-8)",
    },
)
family(
    "feat_stress",
    X.stress,
    6,
    ["asym_ratio_20", "drawdown_20", "drawdown_velocity"],
    {"path": f"product(1 + r) OVER ({P} {PAST})", "up": "greatest(r, 0)", "dn": "least(r, 0)"},
    {"asym_ratio_20": f"{std('up', 20)} / ({std('dn', 20)} + 1e-8)", "top": roll("max", "path", 20)},
    {"drawdown_20": "(path - top) / (top + 1e-8)"},
    {"drawdown_velocity": diff("drawdown_20")},
)
family(
    "feat_term_structure",
    X.term_structure,
    6,
    ["vts_5_20", "vol_accel"],
    {"vts_5_20": f"{std('r', 5)} / ({std('r', 20)} + 1e-8)"},
    {"vol_accel": diff("vts_5_20")},
)
family(
    "feat_vwap_distance",
    X.vwap_distance,
    6,
    ["vwap_distance_20"],
    {"tpv": "(high_adj + low_adj + close_adj)/3 * volume"},
    {"vwap": f"{total('tpv', 20)} / ({total('volume', 20)} + 1e-8)"},
    {"vwap_distance_20": "(close_adj - vwap) / (vwap + 1e-8)"},
)
_LAGS = {"mkt_relative_return": 2, "mkt_rs_cum_20": 5}
LAG_NAMES = [f"{f}_{n}" for f, k in _LAGS.items() for n in (f"zscaled_lag{k}", "momentum", "acceleration")]


def _logged(df):
    """Relative changes on a signed log scale: where the lagged value is near 0 they reach millions."""
    names = [n for n in LAG_NAMES if "lag" not in n]
    return df.withColumns({n: F.signum(n) * F.ln(1.0 + F.abs(n)) for n in names})


family(
    "feat_lag_transforms",
    lambda df: _logged(X.lag_transforms(X.market_context(df), _LAGS)),
    5,
    LAG_NAMES,
    {"mkt_relative_return": "r - mkt_return", "mkt_rs_cum_20": f"{total('r', 20)} - {total('mkt_return', 20)}"},
    {f"{f}_zscaled_lag{k}": f"({lag(f, k)} - {mean(f, 20, k)}) / ({std(f, 20, k)} + 1e-8)" for f, k in _LAGS.items()}
    | {f"{f}_momentum": f"({f} - {lag(f, k)}) / (abs({lag(f, k)}) + 1e-8)" for f, k in _LAGS.items()},
    {f"{f}_accel0": diff(f"{f}_momentum") for f in _LAGS} | {f"{f}_mom0": f"{f}_momentum" for f in _LAGS},
)
for _f in _LAGS:
    for _n, _from in (("momentum", "mom0"), ("acceleration", "accel0")):
        SQL["feat_lag_transforms"] = SQL["feat_lag_transforms"].replace(f"round({_f}_{_n}::DOUBLE", f"round((sign({_f}_{_from}) * ln(1 + abs({_f}_{_from})))::DOUBLE")


def feat_all(spark, sf_dir: str):
    df, names = X.assemble(panel(spark, sf_dir))
    return shown(df, 3, *names)


QUERIES["feat_all"] = feat_all


def _side_by_side() -> str:
    """The routed families' own SQL, joined on the row's key; all but the mixture regimes, which SQL cannot fit."""
    routed = [f.__name__ for f, _ in X.ROUTES if f not in (X.gmm_regimes, X.book_dynamics)]
    parts, columns = [], []
    for n, name in enumerate(routed):
        _, names, steps, base, at = FAMILIES[f"feat_{name}"]
        chained, last = chain(base, at, *steps)
        parts.append(f"f{n} AS (WITH {chained} SELECT symbol, ts, {', '.join(names)} FROM {last})")
        columns += [f"round({c}::DOUBLE, {3 - 3 * (c in _LARGE)}) + 0.0::DOUBLE AS {c}" for c in names]
    joined = " JOIN ".join(["f0", *[f"f{n} USING (symbol, ts)" for n in range(1, len(routed))]])
    return "WITH " + ",\n".join(parts) + f"\nSELECT symbol, ts, {', '.join(columns)} FROM {joined}"


#: Columns of magnitudes at which three digits are beyond a double's sums.
_LARGE = ("kinematic_clv_vol", "kinematic_clv_vol_roll20", "buying_tail_power", "selling_tail_power", "flow_imbalance_proxy", "wavelet_energy_ratio")
SQL["feat_assembled"] = _side_by_side()


def feat_assembled(spark, sf_dir: str):
    """All families that SQL can check, side by side over one window."""
    df, names = X.assemble(panel(spark, sf_dir), without=(X.gmm_regimes,))
    return shown(df, {n: 3 - 3 * (n in _LARGE) for n in names}, *names)


QUERIES["feat_assembled"] = feat_assembled
