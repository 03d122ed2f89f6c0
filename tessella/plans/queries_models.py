"""Queries over model scores: networks, class shares, ratio nets, trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import isotonic, quality, scoring
from tessella.operators.score_cache import ScoreCache
from tessella.plans.registry import derived, events, r, rs, scored
from tessella.schema import MONOMIALS, PROCESSES
from tessella.sources.fixture import views
from tessella.sources.scratch import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: A network small enough to be written out in SQL.
NETWORK = scoring.Network(
    features=("PRI_lep_pt", "PRI_met"),
    layers=(([[0.5, -0.25, 0.1], [0.2, 0.3, -0.4]], [0.1, 0.0, -0.1]), ([[0.3, -0.2, 0.1, 0.0], [0.5, 0.1, -0.3, 0.2], [-0.4, 0.6, 0.2, -0.1]], [0.0, 0.1, -0.1, 0.2])),
    mean=(40.0, 80.0),
    variance=(200.0, 2500.0),
)


def _sql_network() -> str:
    (w1, b1), (w2, b2) = NETWORK.layers
    x = [f"((lep_pt-{NETWORK.mean[0]}::double)/sqrt({NETWORK.variance[0]}::double))", f"((met-{NETWORK.mean[1]}::double)/sqrt({NETWORK.variance[1]}::double))"]
    hidden = ", ".join(f"greatest(0::double, {' + '.join(f'{x[i]}*({w1[i][j]})::double' for i in range(2))} + ({b1[j]})::double) AS h{j}" for j in range(3))
    out = ", ".join(f"{' + '.join(f'h{i}*({w2[i][j]})::double' for i in range(3))} + ({b2[j]})::double AS o{j}" for j in range(4))
    return f"net AS (SELECT *, {out} FROM (SELECT *, {hidden} FROM ev))"


@query("q_mlp_softmax", views(_sql_network()) + "SELECT event_id, " + ", ".join(f"{rs(f'exp(o{c})/(exp(o0)+exp(o1)+exp(o2)+exp(o3))', 8)} AS p_{p}" for c, p in enumerate(PROCESSES)) + " FROM net")
def q_mlp_softmax(spark, sf):
    out = scoring.with_class_scores(events(spark, sf).select("event_id", *NETWORK.features), NETWORK)
    return out.select("event_id", *(r(f"p_{p}", 8).alias(f"p_{p}") for p in PROCESSES))


@query("q_score_cache", views(_sql_network()) + "SELECT event_id, " + ", ".join(f"{rs(f'exp(o{c})/(exp(o0)+exp(o1)+exp(o2)+exp(o3))', 8)} AS p_{p}" for c, p in enumerate(PROCESSES)) + " FROM net")
def q_score_cache(spark, sf):
    """The same scores from a cache of two parts, one of which an earlier evaluation has left there."""
    cache = ScoreCache(spark, f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}")
    e = events(spark, sf).select("event_id", "label", *NETWORK.features)
    part = lambda rows: lambda: scoring.with_class_scores(e.where(rows), NETWORK).select("event_id", *(f"p_{p}" for p in PROCESSES))
    parts = {"signal": part("label = 0"), "background": part("label != 0")}
    cache.scored({"signal": parts["signal"]}, NETWORK)
    return cache.scored(parts, NETWORK).select("event_id", *(r(f"p_{p}", 8).alias(f"p_{p}") for p in PROCESSES))


_STATS = {"PRI_had_pt": (50.0, 300.0), "PRI_lep_pt": (40.0, 200.0), "PRI_met": (80.0, 2500.0), "PRI_met_phi": (0.0, 3.3), "DER_mass_transverse_met_lep": (70.0, 1500.0), "DER_mass_vis": (90.0, 3600.0)}


@query(
    "q_preproc",
    views() + "SELECT event_id, " + ", ".join(f"{rs(f'({c}-({m})::double)/sqrt({v}::double)', d)} AS {n}" for n, c, (m, v), d in (
        ("had_pt", "had_pt", _STATS["PRI_had_pt"], 6), ("lep_pt", "lep_pt", _STATS["PRI_lep_pt"], 6), ("met", "met", _STATS["PRI_met"], 6), ("met_phi", "met_phi", _STATS["PRI_met_phi"], 6),
        ("mt", "mt", _STATS["DER_mass_transverse_met_lep"], 4), ("mass_vis", "mass_vis", _STATS["DER_mass_vis"], 4),
    )) + ", " + ", ".join(f"{rs(f'{a}-{b}')} AS {n}" for n, a, b in (("had_lep_eta", "had_eta", "lep_eta"), ("had_lep_phi", "had_phi", "lep_phi"), ("met_lep_phi", "met_phi", "lep_phi"), ("met_had_phi", "met_phi", "had_phi"))) + " FROM de",
)
def q_preproc(spark, sf):
    cols = scoring.network_inputs(_STATS)
    return derived(spark, sf).select("event_id", *(r(c, 4 if n in ("mt", "mass_vis") else 6).alias(n) for n, c in cols.items()))


@query("q_lr_schedule", f"SELECT CAST(i AS INTEGER) AS epoch, {rs('CASE WHEN i < 150 THEN 0.001::double ELSE 0.001::double - 0.001::double/50*(i-150) END', 9)} AS rate FROM range(200) t(i)")
def q_lr_schedule(spark, sf):
    return spark.range(200).select(F.col("id").cast("int").alias("epoch"), r(scoring.learning_rate(F.col("id").cast("double"), 0.001, 200, 50), 9).alias("rate"))


# -- class scores --------------------------------------------------------------------------------------------------------
@query("q_dcr", views() + "SELECT event_id, " + ", ".join(f"{rs(f'p{c}*({c + 1})/(p0+2*p1+3*p2+4*p3)', 9)} AS {p}" for c, p in enumerate(PROCESSES)) + " FROM sc")
def q_dcr(spark, sf):
    shares = scoring.score_shares({p: F.col(f"p_{p}") * float(i + 1) for i, p in enumerate(PROCESSES)})
    return scored(spark, sf).select("event_id", *(r(c, 9).alias(p) for p, c in shares.items()))


_CAL = "greatest(1e-6, least(1-1e-6, {p}*{p}))"


@query("q_dcr_rescale", views() + f"SELECT event_id, {rs(_CAL.format(p='p0'), 9)} AS htautau, " + ", ".join(f"{rs(f'p{c}*(1-{_CAL.format(p='p0')})/(1-p0)', 9)} AS {p}" for c, p in list(enumerate(PROCESSES))[1:]) + " FROM sc")
def q_dcr_rescale(spark, sf):
    clip = lambda x: F.greatest(F.lit(scoring.CLIP), F.least(F.lit(1 - scoring.CLIP), x))
    out = scoring.rescaled({p: F.col(f"p_{p}") for p in PROCESSES}, clip(F.col("p_htautau") * F.col("p_htautau")))
    return scored(spark, sf).select("event_id", *(r(c, 9).alias(p) for p, c in out.items()))


@query("q_dcr_rescale_multi", views() + f"SELECT event_id, {rs('p0*p0', 9)} AS htautau, " + ", ".join(f"{rs(f'p{c}*p{c}*(1-p0*p0)/(p1*p1+p2*p2+p3*p3)', 9)} AS {p}" for c, p in list(enumerate(PROCESSES))[1:]) + " FROM sc")
def q_dcr_rescale_multi(spark, sf):
    out = scoring.rescaled_multi({p: F.col(f"p_{p}") * F.col(f"p_{p}") for p in PROCESSES})
    return scored(spark, sf).select("event_id", *(r(c, 9).alias(p) for p, c in out.items()))


#: Isotonic regression by its minimax formula over the distinct scores: the largest, over all starts up to a score, of the smallest mean
#: of the targets from there to any end from the score on. The synthetic scores have few distinct values.
_ISOTONIC = (
    "v AS (SELECT p0 AS x, sum(w*CASE WHEN label=0 THEN 1 ELSE 0 END) AS t, sum(w) AS w FROM sc GROUP BY p0), n AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM v), "
    "c AS (SELECT a.i AS a, b.i AS b, sum(m.t)/sum(m.w) AS mean FROM n a JOIN n b ON a.i <= b.i JOIN n m ON m.i BETWEEN a.i AND b.i GROUP BY a.i, b.i), "
    "low AS (SELECT n.i, c.a, min(c.mean) AS least FROM n JOIN c ON c.a <= n.i AND c.b >= n.i GROUP BY n.i, c.a), iso AS (SELECT n.x, max(least) AS y FROM low JOIN n USING (i) GROUP BY n.x)"
)


@query("q_isotonic", views(_ISOTONIC) + f"SELECT event_id, {rs('greatest(1e-6, least(1-1e-6, y))', 6)} AS calibrated FROM sc JOIN iso ON p0 = x")
def q_isotonic(spark, sf):
    s = scored(spark, sf).select("event_id", "p_htautau", "label", "weight")
    model = scoring.fit_isotonic(s, "p_htautau", F.col("label") == 0)
    return scoring.calibrate_isotonic(s, model, "p_htautau").select("event_id", r(F.col("calibrated"), 6).alias("calibrated"))


@query("q_isotonic_ranges", views(_ISOTONIC.replace("p0 AS x", "lep_pt/100 AS x").replace("GROUP BY p0", "GROUP BY lep_pt")) + f"SELECT event_id, {rs('greatest(1e-6, least(1-1e-6, y))', 6)} AS calibrated FROM sc JOIN iso ON lep_pt/100 = x")
def q_isotonic_ranges(spark, sf):
    """Isotonic regression pooled range by range, on a score of some dozens of values."""
    s = scored(spark, sf).select("event_id", (F.col("PRI_lep_pt") / 100.0).alias("score"), "label", "weight")
    curve = isotonic.fit(s, "score", F.col("label") == 0)
    return isotonic.calibrate(s, curve, "score").select("event_id", r("calibrated").alias("calibrated"))


_RESIDUAL = ["mu_measured", "mu_measured_up", "mu_measured_down", "nu_tes", "nu_jes", "nu_met", "nu_bkg", "nu_tt", "nu_diboson"]


@query("q_residual_trees")
def q_residual_trees(spark, sf):
    e = F.col("event_id")
    toys = events(spark, sf).select("event_id", (F.col("weight") * 1.1 + 0.05).alias("mu_measured"), *(((e % (5 + i)).cast("double") / 10).alias(n) for i, n in enumerate(_RESIDUAL[1:])), F.col("weight").alias("mu_true"))
    toys = quality.closure(toys)
    model = scoring.fit_residuals(toys, _RESIDUAL, maxIter=5)
    return scoring.predict_residuals(toys, _RESIDUAL, model).select("event_id", r("residual").alias("residual"), r("correction").alias("correction"))


# -- ratio nets ----------------------------------------------------------------------------------------------------------
_NU = {"nu_tes": 1.0, "nu_jes": -0.5, "nu_met": 0.7}


def _nu():
    return {k: F.lit(v) for k, v in _NU.items()}


def _products() -> list[float]:
    out = []
    for c in MONOMIALS:
        x = 1.0
        for n in c:
            x *= _NU[n]
        out.append(x)
    return out


def sql_log_ratio(p: int) -> str:
    return "(" + " + ".join(f"d{p}{k}*({x!r})::double" for k, x in enumerate(_products())) + ")"


@query("q_pnn_ratio", views() + f"SELECT event_id, {rs(f'1.25::double*exp({sql_log_ratio(0)})', 8)} AS ratio FROM sc")
def q_pnn_ratio(spark, sf):
    return scored(spark, sf).select("event_id", r(1.25 * F.exp(scoring.log_ratio_of("d_htautau", _nu())), 8).alias("ratio"))


_SOFT = "(greatest({x}, 0) + ln(1+exp(-abs({x}))))"
_L1 = sql_log_ratio(1)


@query("q_pnn_loss", views() + f"SELECT label, {rs(f'sum(w*{_SOFT.format(x=_L1)}) + sum(w*1.1::double*{_SOFT.format(x=f"(-{_L1})")})/1.25::double - ln(2)*sum(w+w*1.1::double)', 4)} AS loss FROM sc GROUP BY label")
def q_pnn_loss(spark, sf):
    loss = scoring.ratio_loss(scoring.log_ratio_of("d_ztautau", _nu()), F.col("weight"), F.col("weight") * 1.1, 1.25)
    return scored(spark, sf).groupBy("label").agg(r(loss, 4).alias("loss"))


@query(
    "q_logistic_grad",
    views() + f"SELECT event_id, {rs(f'CASE WHEN label%2=0 THEN {_SOFT.format(x=_L1)} ELSE {_SOFT.format(x=f"(-{_L1})")} END', 9)} AS loss, {rs(f'1/(1+exp(-{_L1})) - CASE WHEN label%2=0 THEN 0 ELSE 1 END', 9)} AS grad, "
    f"{rs(f'(1/(1+exp(-{_L1})))*(1-1/(1+exp(-{_L1})))', 9)} AS hess FROM sc",
)
def q_logistic_grad(spark, sf):
    loss, grad, hess = scoring.logistic_gradients(scoring.log_ratio_of("d_ztautau", _nu()), F.col("label") % 2)
    return scored(spark, sf).select("event_id", r(loss, 9).alias("loss"), r(grad, 9).alias("grad"), r(hess, 9).alias("hess"))


# -- trees ---------------------------------------------------------------------------------------------------------------
_L, _S = scoring.Leaf, scoring.Split
TREES = [
    _S("PRI_met", 80.0, _S("PRI_lep_pt", 35.0, _L((0.02, -0.01)), _L((0.05, 0.0))), _S("PRI_n_jets", 1.0, _L((-0.03, 0.02)), _L((0.01, 0.04)))),
    _S("PRI_had_pt", 40.0, _L((0.015, 0.005)), _L((-0.02, 0.01))),
]
_SQL = {"PRI_met": "met", "PRI_lep_pt": "lep_pt", "PRI_n_jets": "nj", "PRI_had_pt": "had_pt"}


def sql_tree(t, k: int) -> str:
    if isinstance(t, _L):
        return f"({t.value[k]})::double"
    return f"CASE WHEN {_SQL[t.feature]} <= {t.threshold} THEN {sql_tree(t.left, k)} ELSE {sql_tree(t.right, k)} END"


@query("q_tree_predict", views() + f"SELECT event_id, {rs(sql_tree(TREES[0], 0))} AS d0, {rs(sql_tree(TREES[0], 1))} AS d1 FROM ev")
def q_tree_predict(spark, sf):
    return events(spark, sf).select("event_id", *(r(scoring.tree_column(TREES[0], k)).alias(f"d{k}") for k in (0, 1)))


@query("q_ensemble_predict", views() + f"SELECT event_id, {rs(f'0.2::double*({sql_tree(TREES[0], 0)}) + ({sql_tree(TREES[1], 0)})')} AS d0, {rs(f'0.2::double*({sql_tree(TREES[0], 1)})')} AS first_only FROM ev")
def q_ensemble_predict(spark, sf):
    full, one = scoring.ensemble(TREES, 0.2, 0, last_counts_full=True), scoring.ensemble(TREES, 0.2, 1, n_trees=1)
    return events(spark, sf).select("event_id", r(full).alias("d0"), r(one).alias("first_only"))


@query("q_tree_ensemble", views("o AS (SELECT event_id, " + ", ".join(f"0.5::double*({sql_tree(TREES[c % 2], 0)})*{c + 1} + ({sql_tree(TREES[(c + 1) % 2], 1)}) AS o{c}" for c in range(4)) + " FROM ev)") + "SELECT event_id, " + ", ".join(f"{rs(f'exp(o{c})/(exp(o0)+exp(o1)+exp(o2)+exp(o3))', 9)} AS p_{p}" for c, p in enumerate(PROCESSES)) + " FROM o")
def q_tree_ensemble(spark, sf):
    margins = {p: F.exp(0.5 * scoring.tree_column(TREES[c % 2], 0) * (c + 1) + scoring.tree_column(TREES[(c + 1) % 2], 1)) for c, p in enumerate(PROCESSES)}
    return events(spark, sf).select("event_id", *(r(s, 9).alias(f"p_{p}") for p, s in scoring.score_shares(margins).items()))


@query("q_boost_reweight", views() + f"SELECT event_id, {rs(f'w*exp(-0.2::double*({sql_tree(TREES[0], 0)}*1.0::double + {sql_tree(TREES[0], 1)}*-0.5::double))', 8)} AS weight FROM ev")
def q_boost_reweight(spark, sf):
    delta = [scoring.tree_column(TREES[0], k) if k < 2 else F.lit(0.0) for k in range(len(MONOMIALS))]
    e = events(spark, sf).withColumns(_nu())
    return e.select("event_id", r(scoring.boosted_weight(F.col("weight"), delta, 0.2), 8).alias("weight"))


_SPLIT_FEATURES = ["PRI_lep_pt", "PRI_met"]
_SPLIT_POINTS, _SPLIT_TERMS = [(0.0, 0.0, 0.0), (0.0, 1.0, 0.0)], (("nu_jes",),)


def split_events(spark, sf):
    """Events at the nominal point and at one varied point, whose weights depend on the lepton."""
    e = events(spark, sf).select(*_SPLIT_FEATURES, "weight", F.lit(0).alias("point"))
    return e.unionByName(e.withColumns({"weight": F.col("weight") * F.when(F.col("PRI_lep_pt") > 40, 1.2).otherwise(0.9), "point": F.lit(1)}))


def _sql_split() -> str:
    side = "({a}*({s}-ln(2)) + {b}*({t}-ln(2)))"
    loss = lambda a, b: side.format(a=a, b=b, s=_SOFT.format(x=f"ln({b}/{a})"), t=_SOFT.format(x=f"(-ln({b}/{a}))"))
    flat = " UNION ALL ".join(f"SELECT '{f}' AS feature, {c} AS v, w AS w0, w*CASE WHEN lep_pt > 40 THEN 1.2::double ELSE 0.9::double END AS w1 FROM ev" for f, c in (("PRI_lep_pt", "lep_pt"), ("PRI_met", "met")))
    return (
        f"f AS ({flat}), c AS (SELECT feature, v, sum(w0) AS w0, sum(w1) AS w1, count(*) AS n FROM f GROUP BY feature, v), "
        "r AS (SELECT *, sum(w0) OVER o AS l0, sum(w1) OVER o AS l1, sum(n) OVER o AS ln, sum(w0) OVER p AS a0, sum(w1) OVER p AS a1, sum(n) OVER p AS an, max(v) OVER p AS last FROM c "
        "WINDOW o AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY feature)), "
        f"s AS (SELECT feature, v, round({loss('l0', 'l1')} + {loss('(a0-l0)', '(a1-l1)')}, 9) AS loss FROM r WHERE v < last AND ln >= 50 AND an-ln >= 50)"
    )


@query("q_best_split", views(_sql_split()) + f"SELECT feature, {rs('threshold', 4)} AS threshold, {rs('loss', 4)} AS loss FROM (SELECT feature, arg_min(v, struct_pack(loss := loss, v := v)) AS threshold, min(loss) AS loss FROM s GROUP BY feature)")
def q_best_split(spark, sf):
    best = scoring.best_split(split_events(spark, sf), _SPLIT_FEATURES, _SPLIT_POINTS, _SPLIT_TERMS, 50)
    return best.select("feature", r("threshold", 4).alias("threshold"), r("loss", 4).alias("loss"))


def _sql_grown(depth: int, min_size: int) -> str:
    """The tree level by level: the best split of each node, events sent to their side, and the leaf's log ratio of yields."""
    features = (("PRI_lep_pt", "lep_pt"), ("PRI_met", "met"))
    side = "({a}*({s}-ln(2)) + {b}*({t}-ln(2)))"
    loss = lambda a, b: side.format(a=a, b=b, s=_SOFT.format(x=f"ln({b}/{a})"), t=_SOFT.format(x=f"(-ln({b}/{a}))"))
    parts = ["e0 AS (SELECT event_id, lep_pt, met, w AS w0, w*CASE WHEN lep_pt > 40 THEN 1.2::double ELSE 0.9::double END AS w1, 1 AS node, true AS grows FROM ev)"]
    for k in range(depth):
        flat = " UNION ALL ".join(f"SELECT node, '{f}' AS feature, {c} AS v, w0, w1 FROM e{k} WHERE grows" for f, c in features)
        parts += [
            f"c{k} AS (SELECT node, feature, v, sum(w0) AS w0, sum(w1) AS w1, count(*) AS n FROM ({flat}) GROUP BY node, feature, v)",
            f"r{k} AS (SELECT *, sum(w0) OVER o AS l0, sum(w1) OVER o AS l1, sum(n) OVER o AS ln, sum(w0) OVER p AS a0, sum(w1) OVER p AS a1, sum(n) OVER p AS an, max(v) OVER p AS last FROM c{k} "
            "WINDOW o AS (PARTITION BY node, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY node, feature))",
            f"s{k} AS (SELECT node, feature, v, round({loss('l0', 'l1')} + {loss('(a0-l0)', '(a1-l1)')}, 9) AS loss FROM r{k} WHERE v < last AND ln >= {min_size} AND an-ln >= {min_size})",
            f"b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loss, feature, v) AS place FROM s{k}) WHERE place = 1)",
            f"e{k + 1} AS (SELECT event_id, lep_pt, met, w0, w1, CASE WHEN b.node IS NULL THEN e.node WHEN (CASE b.feature WHEN 'PRI_met' THEN met ELSE lep_pt END) <= b.v THEN 2*e.node ELSE 2*e.node + 1 END AS node, grows AND b.node IS NOT NULL AS grows FROM e{k} e LEFT JOIN b{k} b ON e.node = b.node)",
        ]
    return ", ".join([*parts, f"leaf AS (SELECT node, ln(sum(w1)/sum(w0)) AS delta FROM e{depth} GROUP BY node)"])


@query("q_grow_tree", views(_sql_grown(2, 50)) + f"SELECT event_id, {rs('delta')} AS delta FROM e2 JOIN leaf USING (node)")
def q_grow_tree(spark, sf):
    tree = scoring.grow_tree(split_events(spark, sf), _SPLIT_FEATURES, _SPLIT_POINTS, _SPLIT_TERMS, 2, 50)
    return events(spark, sf).select("event_id", r(scoring.tree_column(tree, 0)).alias("delta"))


#: A ratio net: linear outputs are the coefficients of the monomials.
_RATIO_NET = scoring.Network(("PRI_lep_pt", "PRI_met"), (([[0.02, -0.01], [0.03, 0.04]], [0.0, 0.01]), ([[0.5, 0.1], [0.2, -0.3]], [0.01, 0.02])), "linear", (40.0, 80.0), (200.0, 2500.0))


def _sql_ratio_net() -> str:
    (w1, b1), (w2, b2) = _RATIO_NET.layers
    x = [f"((lep_pt-{_RATIO_NET.mean[0]}::double)/sqrt({_RATIO_NET.variance[0]}::double))", f"((met-{_RATIO_NET.mean[1]}::double)/sqrt({_RATIO_NET.variance[1]}::double))"]
    hidden = ", ".join(f"greatest(0::double, {' + '.join(f'{x[i]}*({w1[i][j]})::double' for i in range(2))} + ({b1[j]})::double) AS h{j}" for j in range(2))
    out = ", ".join(f"{' + '.join(f'h{i}*({w2[i][j]})::double' for i in range(2))} + ({b2[j]})::double AS o{j}" for j in range(2))
    return f"net AS (SELECT *, {out} FROM (SELECT *, {hidden} FROM ev))"


@query("q_ratio_net", views(_sql_ratio_net()) + f"SELECT event_id, {rs('o0', 9)} AS d0, {rs('o1', 9)} AS d1, {rs('exp(0.5::double*o0 - 0.25::double*o1)', 9)} AS ratio FROM net")
def q_ratio_net(spark, sf):
    """A net with linear outputs: the coefficients of two monomials, and the ratio at a point."""
    out = scoring.with_network(events(spark, sf).select("event_id", *_RATIO_NET.features), _RATIO_NET, "d")
    d = [F.col("d")[k] for k in range(2)]
    return out.select("event_id", r(d[0], 9).alias("d0"), r(d[1], 9).alias("d1"), r(F.exp(0.5 * d[0] - 0.25 * d[1]), 9).alias("ratio"))
