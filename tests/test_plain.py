"""Queries that SQL cannot express, against plain versions written here: loops and normal equations, one symbol at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import features as X
from barloom.operators import models, selection, validation
from barloom.plans import diag_queries, feature_queries, model_queries
from barloom.plans.panel import panel, with_book

NAMES = model_queries.MODEL_FEATURES


def by_symbol(df):
    """symbol -> rows in time order."""
    out = {}
    for r in df.collect():
        out.setdefault(r["symbol"], []).append(r)
    return {s: sorted(rows, key=lambda r: r["ts"]) for s, rows in out.items()}


@pytest.fixture(scope="module")
def bars(spark, sf):
    return by_symbol(panel(spark, sf).select("symbol", "ts", "close_adj", "log_return"))


@pytest.fixture(scope="module")
def model_rows(spark, sf):
    """symbol -> (feature matrix, label) of rows without nulls."""
    rows = by_symbol(model_queries.model_panel(spark, sf).na.drop())
    return {s: (np.array([[r[f] for f in NAMES] for r in v]), np.array([r["target_label"] for r in v])) for s, v in rows.items()}


def ssr(columns, y):
    """Residual sum of squares by the normal equations of centred columns."""
    x = np.column_stack(columns)
    x, y = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    return float(y @ y - beta @ (x.T @ y)), beta, x, y


def test_mixture_regimes(spark, sf, bars):
    """Walk-forward mixtures, every block of every symbol by a loop over components and rows."""
    got = by_symbol(feature_queries.QUERIES["feat_gmm_regimes"](spark, sf))
    for s, rows in list(bars.items())[:2]:
        r = np.array([x["log_return"] or 0.0 for x in rows])
        v = np.array([r[i - 19 : i + 1].std(ddof=1) if i >= 19 else 0.0 for i in range(len(r))])
        want = np.zeros((len(r), 2))
        for start in range(120, len(r), 20):
            train = np.column_stack((r, v))[start - 120 : start]
            if train[:, 0].var() <= 1e-8:
                continue
            high = train[:, 0] >= np.median(train[:, 0])
            share = [[float(not h), float(h)] for h in high]
            last = -math.inf
            for _ in range(100):
                mean, cov, weight = [], [], []
                for k in (0, 1):
                    p = np.array([q[k] for q in share])
                    n = p.sum() + 10 * np.finfo(float).eps
                    m = (p[:, None] * train).sum(0) / n
                    c = sum(w * np.outer(x - m, x - m) for w, x in zip(p, train, strict=True)) / n + 1e-6 * np.eye(2)
                    mean.append(m), cov.append(c), weight.append(n / len(train))

                def density(x, k, mean=mean, cov=cov, weight=weight):
                    d = x - mean[k]
                    return weight[k] * math.exp(-0.5 * d @ np.linalg.solve(cov[k], d)) / (2 * math.pi) ** 2 / math.sqrt(np.linalg.det(cov[k])) * (2 * math.pi)

                both = [[density(x, 0), density(x, 1)] for x in train]
                share = [[a / (a + b), b / (a + b)] for a, b in both]
                level = float(np.mean([math.log(a + b) for a, b in both]))
                if abs(level - last) < 1e-3:
                    break
                last = level
            bull = int(mean[1][0] > mean[0][0])
            for i in range(start, min(start + 20, len(r))):
                a = [density(np.array([r[i], v[i]]), k) for k in (0, 1)]
                want[i] = a[bull] / sum(a), a[1 - bull] / sum(a)
        assert all(x["gmm_prob_bull"] is None for x in got[s][:120])
        have = np.array([[x["gmm_prob_bull"], x["gmm_prob_bear"]] for x in got[s][120:]])
        assert np.abs(have - want[120:]).max() < 2e-3


def test_all_families_equal_their_own_queries(spark, sf):
    """The assembled columns are those of each family by itself, in route order, none missing."""
    df = panel(spark, sf)
    wide, names = X.assemble(df, without=(X.gmm_regimes,))
    expected = [c for f, _ in X.ROUTES if f not in (X.gmm_regimes, X.book_dynamics) for c in feature_queries.FAMILIES[f"feat_{f.__name__}"][1]]
    assert sorted(names) == sorted(expected)
    assert "gmm_prob_bull" in X.assemble(df)[1] and len(X.assemble(df)[1]) == len(names) + 2
    assert {"l2_depth_total", "l2_spread_zscore"} <= set(X.assemble(diag_queries.prep.book_l2(with_book(df)))[1])


def test_routed_families_follow_the_payload(spark, sf):
    """Null where a symbol's diagnostics do not name a family, a lag or an order; elsewhere the family's own values."""
    df = panel(spark, sf)
    flags = spark.createDataFrame(
        [("A", [1, 5], 0.4, True, False), ("B", [7], 1.0, False, True)], "symbol string, dynamic_lags array<int>, optimal_d double, has_long_trend boolean, has_vol_jumps boolean"
    )
    flags = flags.withColumns({f: F.lit(False) for f in {flag for _, flag in X.ROUTES if flag} - set(flags.columns)})
    two = [r[0] for r in df.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    some = df.where(F.col("symbol").isin(two)).withColumn("symbol", F.when(F.col("symbol") == two[0], "A").otherwise("B"))
    got = by_symbol(X.assemble(some, flags, without=(X.gmm_regimes,))[0])
    plain = by_symbol(X.fractional_memory(X.volume_shock(X.jumps(X.trend(some, (1, 5, 7))), (5, 7)), 0.4))

    def same(s, c):
        return [r[c] for r in got[s]] == [r[c] for r in plain[s]]

    def empty(s, c):
        return all(r[c] is None for r in got[s])

    assert same("A", "ret_1") and same("A", "rvol_5") and same("A", "breakout_ratio_5") and same("A", "frac_diff_d0.40") and empty("A", "ret_7") and empty("A", "jump_diffusion_component")
    assert same("B", "rvol_7") and same("B", "jump_diffusion_component") and empty("B", "ret_7") and empty("B", "frac_diff_d0.40") and empty("B", "macd_dist") and empty("B", "rvol_5")


def plain_adf(x):
    """The t of the lagged level and its p by the response surface; AIC over lags on one sample."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = [x[i + 1] - x[i] for i in range(n - 1)]

    def columns(lags, skip):
        rows = range(skip, n - 1)
        return [np.array([x[t] for t in rows]), *[np.array([d[t - k] for t in rows]) for k in range(1, lags + 1)]], np.array([d[t] for t in rows])

    scores = []
    for lags in range(most + 1):
        c, y = columns(lags, most)
        scores.append((len(y) * math.log(ssr(c, y)[0] / len(y)) + 2 * (lags + 2), lags))
    c, y = columns(min(scores)[1], min(scores)[1])
    rest, beta, xc, _ = ssr(c, y)
    se = math.sqrt(rest / (len(y) - len(c) - 1) * np.linalg.inv(xc.T @ xc)[0, 0])
    tau = beta[0] / se
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    z = sum(k * tau**i for i, k in enumerate(small if tau <= -1.61 else large))
    return 0.0 if tau <= -18.83 else 1.0 if tau >= 2.74 else 0.5 * math.erfc(-z / math.sqrt(2))


def plain_kpss(x):
    n = len(x)
    e = [v - sum(x) / n for v in x]

    def auto(k):
        return sum(e[t] * e[t - k] for t in range(k, n))

    lags = int(n ** (2 / 9))
    s0 = auto(0) / n + sum(auto(k) / (n / 2) for k in range(1, lags + 1))
    s1 = sum(k * auto(k) / (n / 2) for k in range(1, lags + 1))
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = auto(0) / n + 2 / n * sum(auto(k) * (1 - k / (width + 1)) for k in range(1, width + 1))
    level = eta = 0.0
    for v in e:
        level += v
        eta += level * level
    return float(np.interp(eta / n / n / long_run, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)))


def test_optimal_order(spark, sf, bars):
    for r in diag_queries.QUERIES["diag_optimal_d"](spark, sf).collect():
        x = [b["close_adj"] for b in bars[r["symbol"]]]
        assert r["price_stationary"] == (plain_adf(x) < 0.05 and plain_kpss(x) > 0.05)
        for step in range(21):
            d, w = round(step * 0.05, 2), [1.0]
            while len(w) < len(x) and abs(-w[-1] / len(w) * (d - len(w) + 1)) >= 1e-4:
                w.append(-w[-1] / len(w) * (d - len(w) + 1))
            y = [sum(k * x[t - i - 1] for i, k in enumerate(w)) for t in range(len(w), len(x))]
            if len(y) >= 50 and plain_adf(y) < 0.05:
                break
        assert r["optimal_d"] == d
        if d > 0:
            assert r["memory_corr"] == pytest.approx(np.corrcoef(x[len(x) - len(y) :], y)[0, 1], abs=2e-6)


def test_book_diagnostics(spark, sf):
    rows = by_symbol(diag_queries.prep.book_l2(with_book(panel(spark, sf))))
    for r in diag_queries.QUERIES["diag_book"](spark, sf).collect():
        own = rows[r["symbol"]]
        dev, ret = [0.0, *[b["micro_mid_deviation"] for b in own[:-1]]], [b["log_return"] or 0.0 for b in own]

        def rank(v):
            return [sum(a < x for a in v) + (sum(a == x for a in v) + 1) / 2 for x in v]

        rho = np.corrcoef(rank(dev), rank(ret))[0, 1]
        assert r["micro_dev_corr"] == pytest.approx(rho, abs=2e-6)
        t = rho * math.sqrt((len(own) - 2) / (1 - rho * rho))
        assert r["micro_deviation_sig"] == (stats.t_tail(t, len(own) - 2) < 0.05 and abs(rho) > 0.05)
        assert r["l2_spread_stationary"] == (plain_adf([b["l2_spread"] for b in own]) < 0.05)


def test_payload_joins_the_single_diagnostics(spark, sf):
    got = {r["symbol"]: r for r in diag_queries.QUERIES["diag_payload"](spark, sf).collect()}
    pairs = [
        ("diag_acf_lags", "dynamic_lags", "dynamic_lags"), ("diag_optimal_d", "optimal_d", "optimal_d"), ("diag_cycle", "dominant_cycle", "dominant_cycle"), ("diag_arch", "has_arch_effect", "has_vol_clustering"),
        ("diag_arch", "has_asymmetric_vol", "has_asymmetric_vol"), ("diag_jumps", "has_volatility_jumps", "has_vol_jumps"), ("diag_nonlinear", "is_nonlinear", "is_nonlinear"), ("diag_permutation_entropy", "is_high_complexity", "is_high_complexity"),
    ]
    for query, column, flag in pairs:
        assert {r["symbol"]: r[column] for r in diag_queries.QUERIES[query](spark, sf).collect()} == {s: r[flag] for s, r in got.items()}
    for k, flag, side in ((3, "has_short_reversion", -1), (20, "has_long_trend", 1)):
        for r in diag_queries.D.variance_ratio(panel(spark, sf), k).collect():
            assert got[r["symbol"]][flag] == (side * (r["vr"] - 1) > 0 and math.erfc(abs(r["z"]) / math.sqrt(2)) < 0.05)


def plain_f_tail(f, a, b):
    """P(F > f) by integrating the beta density."""
    x = a * f / (a * f + b)
    t = (np.arange(200_000) + 0.5) / 200_000 * (1 - x) + x
    log = (a / 2 - 1) * np.log(t) + (b / 2 - 1) * np.log1p(-t) - (math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2))
    return float(np.exp(log).mean() * (1 - x))


def test_granger_screen(spark, sf, model_rows):
    for r in diag_queries.QUERIES["sel_granger"](spark, sf).collect():
        x, y = model_rows[r["symbol"]]
        x = x[:, NAMES.index(r["feature"])]
        found = []
        for k in range(1, 6):
            own = [y[k - i : len(y) - i] for i in range(1, k + 1)]
            both = own + [x[k - i : len(x) - i] for i in range(1, k + 1)]
            small, full, free = ssr(own, y[k:])[0], ssr(both, y[k:])[0], len(y) - k - 2 * k - 1
            found.append((plain_f_tail(max(1e-12, (small - full) / k / (full / free)), k, free), k))
        p, k = min(found)
        assert r["p"] == pytest.approx(p, abs=2e-3 if k == 1 else 1e-4) and r["causal"] == (r["p"] < 0.05)
        assert r["lag"] == k or abs(sorted(found)[1][0] - p) < 2e-3


def plain_information(x, y, k=3):
    """Nearest-neighbour information of one feature and classes by sorting all distances."""
    psi = [0.0, -0.5772156649015329]
    while len(psi) < len(x) + 2:
        psi.append(psi[-1] + 1 / (len(psi) - 1))
    size = {c: int((y == c).sum()) for c in set(y.tolist())}
    own = [i for i in range(len(x)) if size[y[i]] > 1]
    a = b = c = 0.0
    for i in own:
        q = min(k, size[y[i]] - 1)
        radius = np.sort(np.abs(x[y == y[i]] - x[i]))[q] * (1 - 1e-10)
        a, b, c = a + psi[q], b + psi[size[y[i]]], c + psi[max(1, int((np.abs(x - x[i]) <= radius).sum()))]
    return max(0.0, psi[len(own)] + (a - b - c) / len(own))


def test_information_screens(spark, sf, model_rows):
    for r in diag_queries.QUERIES["sel_lagged_mi"](spark, sf).where(F.col("feature").isin(NAMES[:3])).collect():
        x, y = model_rows[r["symbol"]]
        x = x[:, NAMES.index(r["feature"])]
        found = {k: plain_information(np.concatenate((np.zeros(k), x[:-k])), y) for k in range(1, 6)}
        assert r["mi"] == pytest.approx(max(found.values()), abs=2e-6) and found[r["lag"]] == pytest.approx(max(found.values()), abs=2e-6)
        assert r["accepted"] == (r["mi"] > 0.01)
    ranked = by_place = {}
    for r in diag_queries.QUERIES["sel_mi_rank"](spark, sf).collect():
        by_place.setdefault(r["symbol"], []).append((r["place"], r["mi"]))
    assert len(ranked) and all([m for _, m in sorted(v)] == sorted((m for _, m in v), reverse=True) for v in by_place.values())


def test_vif_and_medoids(spark, sf, model_rows):
    rows = np.vstack([v[0] for v in model_rows.values()])
    full = np.array([[r[f] for f in NAMES] for r in model_queries.model_panel(spark, sf).select(*NAMES).na.drop().collect()])
    r = np.abs(np.corrcoef(full, rowvar=False))
    left = [j for j in range(len(NAMES)) if all(r[i, j] <= 0.85 for i in range(j))]
    while len(left) > 1:
        vif = []
        for j in left:
            rest, _, _, y = ssr([full[:, i] for i in left if i != j], full[:, j])
            vif.append(1 / max(1e-4, rest / float(y @ y)))
        if max(vif) <= 6:
            break
        left.pop(vif.index(max(vif)))
    got = {x["feature"]: x["kept"] for x in diag_queries.QUERIES["sel_vif"](spark, sf).collect()}
    assert got == {f: i in left for i, f in enumerate(NAMES)} and len(rows) > 0
    chosen = {}
    for x in diag_queries.QUERIES["sel_hrp_medoids"](spark, sf).collect():
        chosen.setdefault(x["symbol"], set()).add(x["feature"])
    rows = by_symbol(model_queries.model_panel(spark, sf).select("symbol", "ts", *NAMES).na.drop())
    for s, own in rows.items():
        v = np.array([[x[f] for f in NAMES] for x in own])
        ranks = np.array([[(c < x).sum() + ((c == x).sum() + 1) / 2 for x in c] for c in v.T])
        d = np.sqrt(np.maximum(0, 0.5 * (1 - np.corrcoef(ranks))))
        np.fill_diagonal(d, 0)
        groups = [[i] for i in range(len(NAMES))]

        def spread(g, d=d):  # Ward's criterion from pairwise squared distances
            return sum(d[i, j] ** 2 for i in g for j in g) / 2 / len(g)

        while len(groups) > 4:
            a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: spread(groups[p[0]] + groups[p[1]]) - spread(groups[p[0]]) - spread(groups[p[1]]))
            groups[b] += groups.pop(a)
        assert chosen[s] == {NAMES[min(g, key=lambda i: sum(d[i, j] for j in g))] for g in groups}


def walked(tree, nodes, x):
    node = nodes[0]
    while node["left"] >= 0:
        node = nodes[node["left"] if x[node["split"]] <= node["threshold"] else node["right"]]
    return node["stats"]


def test_forest_probabilities_and_weighted_loss(spark, sf, tmp_path):
    """A forest's probabilities by walking its saved trees; the tuning table's loss from them."""
    df = model_queries.model_panel(spark, sf)
    out, gains = models.train_folds(df, NAMES, 3, trees=4, depth=3)
    tested = validation.folds(df.where("target_label is not null"), 3)
    own = tested.where("fold = 1")
    train = validation.class_weights(own.where("part = 'train'"), by=("fold",))
    model = models.fit(train, NAMES, trees=4, depth=3)
    model.write().overwrite().save(str(tmp_path / "forest"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "forest" / "data")).collect():
        n = r["nodeData"] if "nodeData" in r else r
        trees.setdefault(r["treeID"], {})[n["id"]] = {
            "left": n["leftChild"], "right": n["rightChild"], "split": n["split"]["featureIndex"], "threshold": (n["split"]["leftCategoriesOrThreshold"] or [0])[0], "stats": np.array(n["impurityStats"])
        }
    test = own.where("part = 'test'")
    weighted = validation.class_weights(test, by=("fold",))
    loss = weight = 0.0
    scored = {(r["symbol"], r["ts"]): r for r in models.probabilities(model, weighted, NAMES).collect()}
    for r in weighted.collect():
        x = [r[f] or 0.0 for f in NAMES]
        p = sum(v / v.sum() for v in (walked(t, nodes, x) for t, nodes in trees.items())) / len(trees)
        have = scored[r["symbol"], r["ts"]]
        assert np.allclose([have["prob_short"], have["prob_neutral"], have["prob_long"]], p, atol=1e-9)
        loss -= math.log(min(1, max(2.2e-16, p[int(r["target_label"]) + 1]))) * r["weight"]
        weight += r["weight"]
    assert {(r["symbol"], r["ts"]) for r in out.where("fold = 1").collect()} == set(scored)
    assert models.probabilities(model, weighted, NAMES).agg(models.weighted_log_loss(models.true_probability(), F.col("weight"))).first()[0] == pytest.approx(loss / weight, rel=1e-9)
    assert {r["fold"] for r in gains.collect()} == {0, 1, 2} and all(r["gain"] >= 0 for r in gains.collect())
    table = models.tune(df, NAMES, 2, [(1, 2, 1.0, 4), (1, 3, 1.0, 10)])
    rows = table.collect()
    assert [r["set"] for r in rows] == [r["set"] for r in sorted(rows, key=lambda r: (r["loss"], r["set"]))] and len(rows) == 2
    parts = validation.class_weights(validation.folds(df.where("target_label is not null"), 2, max_train=None), by=("fold", "part"))
    want = []
    for f in (0, 1):
        o = parts.where(F.col("fold") == f)
        m = models.fit(o.where("part = 'train'"), NAMES, 1, 2, 1.0, 4)
        want.append(models.probabilities(m, o.where("part = 'test'"), NAMES).agg(models.weighted_log_loss(models.true_probability(), F.col("weight"))).first()[0])
    assert next(r["loss"] for r in rows if r["set"] == 0) == pytest.approx(sum(want) / 2, rel=0.03)  # split candidates vary with the partitions


def walk_text(text, x):
    """The value that a tree's printed form gives for x: at each If its own branch or that of the Else of the same indent."""
    lines = text.splitlines()[1:]
    at = 0
    while "Predict:" not in lines[at]:
        indent = len(lines[at]) - len(lines[at].lstrip())
        name, _, limit = lines[at].strip()[4:-1].rsplit(" ", 2)
        if x[int(name.split()[1])] <= float(limit):
            at += 1
        else:
            at = 1 + next(i for i in range(at + 1, len(lines)) if lines[i].strip().startswith("Else") and len(lines[i]) - len(lines[i].lstrip()) == indent)
    return float(lines[at].split()[1])


def test_boosted_probabilities(spark):
    """Boosted margins by walking the trees: 1 / (1 + exp(-2 margin)) of each class, over their sum; and they learn a planted rule."""
    rng = np.random.default_rng(2)
    rows = [("A" if i % 2 else "B", i, float(a), float(b), float(-1 if a < -0.4 else 1 if a > 0.4 else 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "symbol string, ts int, a double, b double, target_label double").withColumn("weight", F.lit(1.0))
    model = models.fit_boosted(df, ["a", "b"], rounds=4, depth=2, share=1.0, step=0.5)
    got = models.boosted_probabilities(model, df, ["a", "b"]).collect()
    assert sorted(model.parts) == [0, 1, 2]
    trees = {c: [(w, t.toDebugString) for w, t in zip(m.treeWeights, m.trees, strict=True)] for c, m in model.parts.items()}

    for r in got[:60]:
        p = []
        for c in (0, 1, 2):
            margin = 0.0
            for w, text in trees[c]:
                margin += w * walk_text(text, (r["a"], r["b"]))
            p.append(1 / (1 + math.exp(-2 * margin)))
        assert np.allclose([r["prob_short"], r["prob_neutral"], r["prob_long"]], np.array(p) / sum(p), atol=1e-9)
    right = [max((-1, 0, 1), key=lambda k, r=r: (r["prob_short"], r["prob_neutral"], r["prob_long"])[k + 1]) == r["target_label"] for r in got]
    assert sum(right) / len(right) > 0.9
    alone = models.fit_boosted(df.where("target_label = 1"), ["a", "b"], rounds=2)
    assert {r["prob_long"] for r in models.boosted_probabilities(alone, df, ["a", "b"]).collect()} == {1.0}


def test_plain_helpers_agree_with_the_librarys():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=300))
    assert stats.adf_p(x) == pytest.approx(plain_adf(x.tolist()), rel=1e-6) and stats.kpss_p(x) == pytest.approx(plain_kpss(x.tolist()), rel=1e-9)
    assert selection.MI_LIMIT == 0.01
