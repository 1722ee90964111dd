"""Registered queries of diagnostics and selection, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.functions.windows import rounded
from barloom.operators import diagnostics as D
from barloom.operators import features as X
from barloom.operators import prep
from barloom.operators import regressions as R
from barloom.operators import selection as S
from barloom.plans.data_queries import LABELED
from barloom.plans.model_queries import MODEL_FEATURES, model_panel
from barloom.plans.panel import labeled, panel, shown, with_book
from barloom.sources import bars as src
from barloom.plans.sql import P, PANEL, gamma_tail, lag, std, total

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            SQL[job.__name__] = sql
        return job

    return add


@query(
    f"""WITH {PANEL}, m AS (SELECT symbol, count(log_return) AS n, avg(log_return) AS mean, stddev_samp(log_return) AS std, skewness(log_return) AS skewness, kurtosis(log_return) + 3 AS kurtosis,
  skewness(log_return)*(count(log_return)-2)/sqrt(count(log_return)*(count(log_return)-1.0::DOUBLE)) AS ps, kurtosis_pop(log_return) AS pk FROM panel WHERE log_return IS NOT NULL GROUP BY symbol)
SELECT symbol, n, round(mean, 8) AS mean, round(std, 8) AS std, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(n/6.0::DOUBLE*(ps*ps + pk*pk/4), 4) AS jarque_bera,
  kurtosis > 3 AS is_leptokurtic, exp(-(n/6.0::DOUBLE*(ps*ps + pk*pk/4))/2) < 0.05 AS reject_normality FROM m"""
)
def diag_distribution(spark, sf_dir):
    out = D.distribution(panel(spark, sf_dir))
    return out.select("symbol", "n", *rounded(8, "mean", "std"), *rounded(6, "skewness", "kurtosis"), *rounded(4, "jarque_bera"), "is_leptokurtic", "reject_normality")


_X = f"""x AS (SELECT symbol, ts, log_return - avg(log_return) OVER (PARTITION BY symbol) AS x, row_number() OVER ({P}) AS i FROM panel WHERE log_return IS NOT NULL),
tot AS (SELECT symbol, sum(x*x) AS s, count(*) AS n FROM x GROUP BY symbol),
acf AS (SELECT a.symbol, k.range AS k, sum(a.x*b.x) / any_value(s) AS v, any_value(n) AS n FROM x a, range(1, 31) k JOIN x b ON b.symbol = a.symbol AND b.i = a.i - k.range JOIN tot ON tot.symbol = a.symbol GROUP BY 1, 2)"""


@query(f"WITH {PANEL}, {_X} SELECT symbol, k::INT AS k, round(v, 6) AS acf FROM acf")
def diag_acf(spark, sf_dir):
    out = D.acf(panel(spark, sf_dir)).select("symbol", F.posexplode("acf").alias("k", "acf"))
    return out.select("symbol", (F.col("k") + 1).alias("k"), *rounded(6, "acf"))


@query(
    f"""WITH {PANEL}, {_X}, sig AS (SELECT symbol, k, row_number() OVER (PARTITION BY symbol ORDER BY k) AS r FROM acf WHERE abs(v) > 1.96/sqrt(n) AND k <= n // 3),
u AS (SELECT symbol, k FROM sig WHERE r <= 5 UNION SELECT symbol, v FROM tot, (VALUES (1), (5), (20)) t(v) UNION SELECT symbol, v FROM tot, (VALUES (1), (3), (5)) t(v) WHERE symbol NOT IN (SELECT symbol FROM sig))
SELECT symbol, string_agg(k, ',' ORDER BY k) AS dynamic_lags FROM u GROUP BY symbol"""
)
def diag_acf_lags(spark, sf_dir):
    return D.acf_lags(panel(spark, sf_dir)).select("symbol", F.array_join(F.transform("dynamic_lags", lambda x: x.cast("string")), ",").alias("dynamic_lags"))


def _vr(k: int) -> str:
    pairs = " UNION ALL ".join(f"SELECT symbol, {j} AS j, sum(e * el{j}) AS d FROM v2 GROUP BY symbol" for j in range(1, k))
    return f"""WITH {PANEL}, v0 AS (SELECT symbol, ts, ln(close_adj) AS p, ln(close_adj) - ln({lag('close_adj')}) AS r1, ln(close_adj) - ln({lag('close_adj', k)}) AS rk FROM panel),
v1 AS (SELECT *, avg(r1) OVER (PARTITION BY symbol) AS mu FROM v0), va AS (SELECT *, pow(r1 - mu, 2) AS e FROM v1),
v2 AS (SELECT *, {", ".join(f"lag(e, {j}) OVER ({P}) AS el{j}" for j in range(1, k))} FROM va),
d AS ({pairs}), ph AS (SELECT symbol, sum(pow(2.0::DOUBLE*({k}-j)/{k}, 2) * d) AS num FROM d GROUP BY symbol),
a AS (SELECT symbol, count(*) AS t, sum(e) AS s1, sum(pow(rk - {k}*mu, 2)) AS sk FROM v2 GROUP BY symbol),
z AS (SELECT symbol, sk / ({k}*(t-{k})*(1 - {k}.0::DOUBLE/(t-1))) / (s1/(t-2)) AS vr, num/(s1*s1) AS phi FROM a JOIN ph USING (symbol))
SELECT symbol, round(vr, 6) AS vr, round((vr-1)/sqrt(phi), 4) AS z FROM z"""


@query(_vr(3))
def diag_variance_ratio_short(spark, sf_dir):
    return D.variance_ratio(panel(spark, sf_dir), 3).select("symbol", *rounded(6, "vr"), *rounded(4, "z"))


@query(_vr(20))
def diag_variance_ratio_long(spark, sf_dir):
    return D.variance_ratio(panel(spark, sf_dir), 20).select("symbol", *rounded(6, "vr"), *rounded(4, "z"))


@query(
    f"""WITH {PANEL}, {_X}, y AS (SELECT x.symbol, i - 1 AS i, n, sum(x) OVER (PARTITION BY x.symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM x JOIN tot USING (symbol)),
sc AS (SELECT DISTINCT symbol, n, floor(pow(10.0::DOUBLE, 1 + (log10(n // 4) - 1) * k.range / 14.0) + 1e-9)::BIGINT AS s FROM tot, range(15) k),
seg AS (SELECT y.symbol, s, y.i // s AS g, y.i % s AS t, y FROM y JOIN sc USING (symbol) WHERE (y.i // s + 1) * s <= y.n),
fit AS (SELECT symbol, s, g, sqrt(greatest(0, regr_syy(y, t) - pow(regr_sxy(y, t), 2)/regr_sxx(y, t)) / s) AS f FROM seg GROUP BY 1, 2, 3),
fl AS (SELECT symbol, s, avg(f) AS f FROM fit GROUP BY 1, 2)
SELECT symbol, round(regr_slope(ln(f), ln(s)), 6) AS hurst FROM fl GROUP BY symbol"""
)
def diag_hurst_dfa(spark, sf_dir):
    return D.hurst_dfa(panel(spark, sf_dir)).select("symbol", *rounded(6, "hurst"))


@query(
    f"""WITH {PANEL}, p AS (SELECT symbol, close_adj AS p, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM panel),
t AS (SELECT symbol, regr_slope(p, i) AS b, regr_intercept(p, i) AS a FROM p GROUP BY symbol), x AS (SELECT symbol, i, n, p - b*i - a AS x FROM p JOIN t USING (symbol)),
k AS (SELECT DISTINCT symbol, n, unnest(range(1, n // 2 + 1)) AS k FROM x),
f AS (SELECT symbol, k, any_value(x.n) AS n, pow(sum(x*cos(2*pi()*((k*i) % x.n)/x.n)), 2) + pow(sum(x*sin(2*pi()*((k*i) % x.n)/x.n)), 2) AS power FROM k JOIN x USING (symbol) GROUP BY 1, 2)
SELECT symbol, floor(least(30.0, greatest(3.0, 1.0/(arg_max(k, power)*(1.0/any_value(n)))))::DOUBLE)::INT AS dominant_cycle FROM f GROUP BY symbol"""
)
def diag_cycle(spark, sf_dir):
    return D.cycle(panel(spark, sf_dir))


@query()
def diag_optimal_d(spark, sf_dir):
    return D.optimal_d(panel(spark, sf_dir)).select("symbol", "optimal_d", "price_stationary", *rounded(6, "memory_corr"))


@query(f"WITH {PANEL}, l AS (SELECT symbol, log_return, {lag('log_return')} AS r1 FROM panel WHERE log_return IS NOT NULL) SELECT symbol, round(corr(r1, log_return*log_return), 6) AS leverage FROM l GROUP BY symbol")
def diag_leverage(spark, sf_dir):
    return D.arch(panel(spark, sf_dir)).select("symbol", *rounded(6, "leverage"))


def _arch() -> str:
    """The regression on five lags by taking out one lag after another; what is left of the others belongs to no earlier one."""
    own = "OVER (PARTITION BY symbol)"
    parts = [f"WITH {PANEL}, e AS (SELECT symbol, ts, log_return, log_return*log_return AS c0 FROM panel WHERE log_return IS NOT NULL)"]
    parts.append(f"l0 AS (SELECT * FROM (SELECT symbol, c0, {', '.join(f'{lag("c0", k)} AS c{k}' for k in range(1, 6))} FROM e) WHERE c5 IS NOT NULL)")
    for k in range(1, 6):
        rest = ", ".join(f"c{j} - regr_slope(c{j}, c{k}) {own} * (c{k} - avg(c{k}) {own}) AS c{j}" for j in (0, *range(k + 1, 6)))
        parts.append(f"l{k} AS (SELECT symbol, {rest} FROM l{k - 1})")
    parts.append("a AS (SELECT symbol, count(*) AS n, var_pop(c0) AS whole FROM l0 GROUP BY symbol), b AS (SELECT symbol, var_pop(c0) AS rest FROM l5 GROUP BY symbol)")
    parts.append("m AS (SELECT symbol, n*(1 - rest/whole) AS lm FROM a JOIN b USING (symbol))")
    parts.append(f"v AS (SELECT symbol, corr(r1, c0) AS leverage FROM (SELECT symbol, c0, {lag('log_return')} AS r1 FROM e) GROUP BY symbol)")
    parts.append(f"q AS (SELECT *, {gamma_tail(2.5, 'lm/2')} AS p FROM m)")
    return ",\n".join(parts) + "\nSELECT symbol, round(lm, 4) AS arch_lm, round(p, 4) AS arch_p, p < 0.05 AS has_arch_effect, leverage < -0.1 AS has_asymmetric_vol FROM q JOIN v USING (symbol)"


@query(_arch())
def diag_arch(spark, sf_dir):
    return D.arch(panel(spark, sf_dir)).select("symbol", *rounded(4, "arch_lm", "arch_p"), "has_arch_effect", "has_asymmetric_vol")


@query(_arch())
def diag_arch_sums(spark, sf_dir):
    """The same test from sums of products."""
    return R.arch(panel(spark, sf_dir)).select("symbol", *rounded(4, "arch_lm", "arch_p"), "has_arch_effect", "has_asymmetric_vol")


@query(
    f"""WITH {PANEL}, j0 AS (SELECT symbol, ts, log_return AS q, abs(log_return) * abs({lag('log_return')}) AS pair FROM panel WHERE log_return IS NOT NULL),
j1 AS (SELECT symbol, {total('q*q', 20)} AS rv, pi()/2 * {total('pair', 20)} AS bv FROM j0),
j2 AS (SELECT symbol, CASE WHEN rv - bv IS NOT NULL THEN greatest(rv - bv, 0)/(rv + 1e-8) END AS j FROM j1)
SELECT symbol, count(*) FILTER (WHERE j > 0.25) > count(*) * 0.05 AS has_volatility_jumps, round(avg(j), 6) AS mean_jump_ratio FROM j2 GROUP BY symbol"""
)
def diag_jumps(spark, sf_dir):
    return D.jump_share(panel(spark, sf_dir)).select("symbol", "has_volatility_jumps", *rounded(6, "mean_jump_ratio"))


@query(
    f"""WITH {PANEL}, s AS (SELECT symbol, volume AS a, round(abs(log_return), 10) AS b FROM panel WHERE log_return IS NOT NULL),
rk AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY a) + (count(*) OVER (PARTITION BY symbol, a) - 1)/2.0 AS ra, rank() OVER (PARTITION BY symbol ORDER BY b) + (count(*) OVER (PARTITION BY symbol, b) - 1)/2.0 AS rb FROM s),
rho AS (SELECT symbol, count(*) - 2 AS d, corr(ra, rb) AS rho FROM rk GROUP BY symbol),
tt AS (SELECT *, d / (d + rho * rho * d / (1 - rho * rho)) AS c2 FROM rho),
tails AS (SELECT symbol, rho, 1 - CASE WHEN d % 2 = 0
  THEN sqrt(1 - c2) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5) + k * ln(c2)) for k in range(d // 2)])
  ELSE 2 / pi() * (atan(sqrt(1 / c2 - 1)) + sqrt(c2 * (1 - c2)) * list_sum([exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(c2)) for k in range((d - 1) // 2)])) END AS p FROM tt)
SELECT symbol, round(rho, 6) AS vol_ret_corr, p < 0.05 AND rho > 0.1 AS is_volume_significant FROM tails"""
)
def diag_volume(spark, sf_dir):
    return D.volume(panel(spark, sf_dir)).select("symbol", *rounded(6, "vol_ret_corr"), "is_volume_significant")


@query()
def diag_book(spark, sf_dir):
    return D.book(prep.book_l2(with_book(panel(spark, sf_dir)))).select("symbol", *rounded(6, "micro_dev_corr"), "micro_deviation_sig", "l2_spread_stationary")


@query(
    f"""WITH {PANEL}, r0 AS (SELECT symbol, ts, log_return AS r, {lag('log_return')} AS b FROM panel WHERE log_return IS NOT NULL),
ab AS (SELECT symbol, regr_slope(r, b) AS s, regr_intercept(r, b) AS c FROM r0 WHERE b IS NOT NULL GROUP BY symbol),
e AS (SELECT symbol, ts, r - c - s*b AS e FROM r0 JOIN ab USING (symbol) WHERE b IS NOT NULL),
x0 AS (SELECT symbol, row_number() OVER ({P}) - 1 AS i, (e - avg(e) OVER (PARTITION BY symbol)) / (stddev_pop(e) OVER (PARTITION BY symbol) + 1e-8) AS x FROM e),
x AS (SELECT symbol, i, x, lead(x) OVER (PARTITION BY symbol ORDER BY i) AS x1, 1.5 * stddev_samp(x) OVER (PARTITION BY symbol) AS eps FROM x0),
d AS (SELECT a.symbol, a.i, count(*) AS g, count(*) FILTER (WHERE b.i > a.i) AS p1, count(*) FILTER (WHERE b.i > a.i AND a.i > 0) AS pt,
  count(*) FILTER (WHERE b.i > a.i AND abs(a.x1 - b.x1) < a.eps) AS p2 FROM x a JOIN x b ON a.symbol = b.symbol AND abs(a.x - b.x) < a.eps GROUP BY 1, 2),
t AS (SELECT symbol, count(*)::DOUBLE AS n, count(*) - 1.0::DOUBLE AS m, sum(g*g)::DOUBLE AS g2, sum(g)::DOUBLE AS g1, sum(p1)::DOUBLE AS p1, sum(pt)::DOUBLE AS pt, sum(p2)::DOUBLE AS p2 FROM d GROUP BY symbol),
c AS (SELECT symbol, m, p1/(n*(n-1)/2) AS c, (g2 - 3*g1 + 2*n)/(n*(n-1)*(n-2)) AS k, pt/(m*(m-1)/2) AS c1, p2/(m*(m-1)/2) AS c2 FROM t),
z AS (SELECT symbol, sqrt(m)*(c2 - c1*c1)/sqrt(4*(k*k + 2*k*c*c + c*c*c*c - 4*k*c*c)) AS z FROM c), q AS (SELECT *, {gamma_tail(0.5, 'z*z/2')} AS p FROM z)
SELECT symbol, round(z, 6) AS bds, round(p, 6) AS bds_p, p < 0.05 AS is_nonlinear FROM q"""
)
def diag_nonlinear(spark, sf_dir):
    return D.nonlinear(panel(spark, sf_dir)).select("symbol", *rounded(6, "bds", "bds_p"), "is_nonlinear")


@query()
def diag_lag_information(spark, sf_dir):
    return D.nonlinear(panel(spark, sf_dir)).select("symbol", *rounded(6, "bds", "bds_p", "mutual_information_lag1"), "is_nonlinear")


_PAT = "CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN b <= c AND c < a THEN 3 WHEN c < a AND a <= b THEN 4 ELSE 5 END"


@query(
    f"""WITH {PANEL}, t AS (SELECT symbol, {lag('log_return', 2)} AS a, {lag('log_return')} AS b, log_return AS c FROM panel WHERE log_return IS NOT NULL),
p AS (SELECT symbol, {_PAT} AS p, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY 1, 2), q AS (SELECT symbol, k/sum(k) OVER (PARTITION BY symbol) AS q FROM p)
SELECT symbol, round(-sum(q*log2(q + 1e-8))/{math.log2(6.0)!r}, 6) AS permutation_entropy, -sum(q*log2(q + 1e-8))/{math.log2(6.0)!r} > 0.85 AS is_high_complexity FROM q GROUP BY symbol"""
)
def diag_permutation_entropy(spark, sf_dir):
    return D.permutation_entropy(panel(spark, sf_dir)).select("symbol", *rounded(6, "permutation_entropy"), "is_high_complexity")


_REGIME = f"s20 AS (SELECT *, {std('log_return', 20)} AS sd FROM {{0}}), half AS (SELECT symbol, median(sd) AS h FROM s20 GROUP BY symbol), regime AS (SELECT s20.*, CASE WHEN sd > h THEN 1.0 ELSE 0.0 END::DOUBLE AS hv FROM s20 JOIN half USING (symbol))"


@query(f"WITH {PANEL}, {_REGIME.format('panel')} SELECT symbol, ts, hv AS prob_regime_high_vol, 1 - hv AS prob_regime_low_vol FROM regime")
def diag_regime_fallback(spark, sf_dir):
    return D.regime(panel(spark, sf_dir))


@query()
def diag_markov_regime(spark, sf_dir):
    """Filtered probabilities of two volatility regimes of every symbol."""
    return D.markov_regime(panel(spark, sf_dir)).select("symbol", "ts", *rounded(6, "prob_regime_low_vol", "prob_regime_high_vol"), "status")


@query()
def diag_payload(spark, sf_dir):
    out = D.payload(panel(spark, sf_dir))
    return out.withColumn("dynamic_lags", F.array_join(F.transform("dynamic_lags", lambda x: x.cast("string")), ","))


@query()
def feat_routed(spark, sf_dir):
    """All families, those that a symbol's diagnostics do not route nulled, for the symbol's own lags and order."""
    df = panel(spark, sf_dir)
    flags = D.payload(df).drop("dominant_cycle")
    flags = spark.createDataFrame(flags.collect(), flags.schema)  # one row a symbol, read several times
    out, names = X.assemble(df, flags)
    plain = {n: n.replace(".", "_") for n in names}
    return shown(out.withColumnsRenamed(plain), 3, *plain.values())


#: Columns that plain SQL over the labeled panel gives back.
SCREENED = ["log_return", "overnight_return", "intraday_return", "hl_log_range", "mkt_return", "volume"]


@query(
    f"""{LABELED}, k AS (SELECT * FROM labeled WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SCREENED)}),
r AS ({" UNION ALL ".join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM k" for j, b in enumerate(SCREENED) for a in SCREENED[:j])} UNION ALL SELECT '{SCREENED[0]}', 0)
SELECT feature, round(max(r), 6) AS strongest, max(r) > 0.85 AS dropped FROM r GROUP BY feature"""
)
def sel_corr(spark, sf_dir):
    return S.correlation_screen(labeled(spark, sf_dir), SCREENED).select("feature", *rounded(6, "strongest"), "dropped")


@query()
def sel_vif(spark, sf_dir):
    kept = S.vif_screen(model_panel(spark, sf_dir), MODEL_FEATURES)
    return spark.createDataFrame([(f, f in kept) for f in MODEL_FEATURES], "feature string, kept boolean")


def _long(*more: str) -> str:
    columns = ", ".join(["target_label", *more, *SCREENED])
    return f"long AS (UNPIVOT (SELECT {columns} FROM {{0}} WHERE target_label IS NOT NULL) ON {', '.join(SCREENED)} INTO NAME feature VALUE value)"


def _mi(keys: str) -> str:
    return f"""e AS (SELECT {keys}, min(value) AS lo, max(value) AS hi FROM long GROUP BY {keys}),
c AS (SELECT {keys}, CASE WHEN hi > lo THEN least(9, floor((value - lo)/(hi - lo)*10)) ELSE 0 END AS b, target_label AS y, count(*) AS k FROM long JOIN e USING ({keys}) GROUP BY ALL),
t AS (SELECT *, sum(k) OVER (PARTITION BY {keys}) AS n, sum(k) OVER (PARTITION BY {keys}, b) AS nb, sum(k) OVER (PARTITION BY {keys}, y) AS ny FROM c),
mi AS (SELECT {keys}, sum(k/n*ln(k*n/(nb*ny))) AS mi FROM t GROUP BY {keys})"""


@query(f"{LABELED}, {_long().format('labeled')}, {_mi('feature')} SELECT feature, round(mi, 6) AS mi FROM mi")
def sel_binned_mi(spark, sf_dir):
    return S.binned_information(S.long_form(labeled(spark, sf_dir), SCREENED, "target_label")).select("feature", *rounded(6, "mi"))


@query(
    f"""{LABELED}, {_long().format('labeled')}, {_mi('feature')},
r AS (SELECT *, CASE WHEN regexp_matches(feature, '{"|".join(S.PRIORITY)}') AND mi > 0.005 THEN 0 WHEN mi > 0.01 THEN 1 END AS tier FROM mi),
q AS (SELECT *, count(tier) OVER () AS n, row_number() OVER (ORDER BY tier ASC NULLS LAST, mi DESC, feature) AS a, row_number() OVER (ORDER BY mi DESC, feature) AS b FROM r)
SELECT feature, round(mi, 6) AS mi, (CASE WHEN n < 6 THEN b ELSE a END)::INT AS place FROM q WHERE (n < 6 AND b <= 6) OR (n >= 6 AND tier IS NOT NULL AND a <= 16)"""
)
def sel_priority(spark, sf_dir):
    scores = S.binned_information(S.long_form(labeled(spark, sf_dir), SCREENED, "target_label"))
    return S.prioritised(scores).select("feature", *rounded(6, "mi"), "place")


@query(
    f"""{LABELED}, {_REGIME.format('labeled')}, {_long('hv').format('regime')}, {_mi('feature, hv')},
w AS (SELECT feature, max(mi) FILTER (WHERE hv > 0.5) AS mi_high_vol, max(mi) FILTER (WHERE hv <= 0.5) AS mi_low_vol FROM mi GROUP BY feature)
SELECT feature, round(mi_high_vol, 6) AS mi_high_vol, round(mi_low_vol, 6) AS mi_low_vol, mi_high_vol > 0.01 OR mi_low_vol > 0.01 AS accepted FROM w"""
)
def sel_regime_mi(spark, sf_dir):
    df = labeled(spark, sf_dir)
    both = df.join(D.regime(df).select("symbol", "ts", "prob_regime_high_vol"), ["symbol", "ts"])
    out = S.regime_information(S.long_form(both, SCREENED, "target_label", "prob_regime_high_vol"))
    return out.select("feature", *rounded(6, "mi_high_vol", "mi_low_vol"), "accepted")


@query()
def sel_markov_regime_mi(spark, sf_dir):
    """Information in each of the switching model's regimes, of all assembled features (the mixtures aside)."""
    wide, names = X.assemble(labeled(spark, sf_dir), without=(X.gmm_regimes,))
    both = wide.join(D.markov_regime(wide).select("symbol", "ts", "prob_regime_high_vol"), ["symbol", "ts"])
    out = S.regime_information(S.long_form(both, names, "target_label", "prob_regime_high_vol"))
    return out.select("feature", *rounded(6, "mi_high_vol", "mi_low_vol", "mi_all"), "accepted")


@query(
    f"""{LABELED}, l AS (UNPIVOT (SELECT symbol, target_label, {", ".join(SCREENED)} FROM labeled WHERE target_label IS NOT NULL) ON {", ".join(SCREENED)} INTO NAME feature VALUE value),
k AS (SELECT symbol, feature, rank() OVER (PARTITION BY symbol, feature ORDER BY value) + (count(*) OVER (PARTITION BY symbol, feature, value) - 1)/2.0 AS a,
  rank() OVER (PARTITION BY symbol, feature ORDER BY target_label) + (count(*) OVER (PARTITION BY symbol, feature, target_label) - 1)/2.0 AS b FROM l),
r AS (SELECT symbol, feature, abs(corr(a, b)) AS rho FROM k GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rho DESC, feature) AS place FROM r)
SELECT symbol, feature, round(rho, 6) AS rho, place::INT AS place FROM p WHERE place <= 5"""
)
def sel_fallback(spark, sf_dir):
    return S.rank_fallback(labeled(spark, sf_dir), SCREENED).select("symbol", "feature", *rounded(6, "rho"), "place")


@query()
def sel_chain(spark, sf_dir):
    """Redundancy, medoids, Granger, information and fallback screens for every symbol."""
    return S.select(model_panel(spark, sf_dir), MODEL_FEATURES)




@query()
def sel_hrp_medoids(spark, sf_dir):
    return S.hrp_medoids(model_panel(spark, sf_dir), MODEL_FEATURES, 4)


@query()
def sel_granger_wide(spark, sf_dir):
    """The F tests of every assembled feature (the mixtures aside), from sums of products."""
    wide, names = X.assemble(labeled(spark, sf_dir), without=(X.gmm_regimes,))
    wide = src.written(wide.select("symbol", "ts", "target_label", *names), "wide")
    return R.granger_screen(wide, names).select("symbol", "feature", *rounded(6, "p"), "lag", "causal")


@query()
def sel_granger(spark, sf_dir):
    return S.granger_screen(model_panel(spark, sf_dir), MODEL_FEATURES).select("symbol", "feature", *rounded(6, "p"), "lag", "causal")


@query()
def sel_lagged_mi(spark, sf_dir):
    return S.lagged_information(model_panel(spark, sf_dir), MODEL_FEATURES).select("symbol", "feature", *rounded(6, "mi"), "lag", "accepted")


@query()
def sel_mi_rank(spark, sf_dir):
    """Information of the lag transforms of two features."""
    df = X.lag_transforms(model_panel(spark, sf_dir), {"mkt_relative_return": 2, "cmf_20": 1})
    names = [f"{f}_{n}" for f, k in (("mkt_relative_return", 2), ("cmf_20", 1)) for n in (f"zscaled_lag{k}", "momentum", "acceleration")]
    return S.information_rank(df, names).select("symbol", "feature", *rounded(6, "mi"), "place")
