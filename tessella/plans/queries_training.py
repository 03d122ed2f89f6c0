"""Queries of network training: gradients against their SQL, and runs that go on where they ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.kinematics import with_derived
from tessella.operators import training
from tessella.operators.scoring import Network
from tessella.operators.yields import design
from tessella.plans.queries_models import NETWORK
from tessella.plans.queries_trees import POINTS, point_events, store
from tessella.plans.queries_trees import _BASE as _POINT_BASE
from tessella.plans.registry import events, rs
from tessella.schema import MONOMIALS
from tessella.sources.fixture import views
from tessella.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


CLASS_WEIGHTS = (4.0, 1.5, 2.0, 3.0)
FEATURES = ("PRI_lep_pt", "PRI_met")
_D = lambda x: f"({x!r})::double"


def _sql_forward(net: Network) -> tuple[str, str]:
    """Columns of the hidden layer over x0, x1, and of the outputs over the hidden layer."""
    (w1, b1), (w2, b2) = net.layers
    hidden = ", ".join(f"greatest(0::double, {' + '.join(f'x{i}*{_D(w1[i][j])}' for i in range(len(w1)))} + {_D(b1[j])}) AS h{j}" for j in range(len(b1)))
    out = ", ".join(f"{' + '.join(f'h{i}*{_D(w2[i][k])}' for i in range(len(w2)))} + {_D(b2[k])} AS o{k}" for k in range(len(b2)))
    return hidden, out


def _sql_gradient(net: Network, source: str, over: str) -> str:
    """(position, value) from source with x, h and the derivatives z of the outputs, summed and put over a number."""
    (w1, b1), (w2, b2) = net.layers
    below = [f"CASE WHEN h{j} > 0 THEN {' + '.join(f'z{k}*{_D(w2[j][k])}' for k in range(len(b2)))} ELSE 0 END" for j in range(len(b1))]
    sums = [f"sum(x{i}*({below[j]}))" for i in range(len(w1)) for j in range(len(b1))] + [f"sum({b})" for b in below]
    sums += [f"sum(h{j}*z{k})" for j in range(len(b1)) for k in range(len(b2))] + [f"sum(z{k})" for k in range(len(b2))]
    return f"SELECT CAST(unnest(range({len(sums)})) AS INTEGER) AS position, unnest([{', '.join(sums)}])/{over} AS value FROM {source}"


def _frame(spark, loss: float, gradient, digits: int):
    rows = [(-1, loss), *enumerate(gradient.tolist())]
    return spark.createDataFrame([(i, round(float(v), digits) + 0.0) for i, v in rows], "position int, value double")


# -- classes -------------------------------------------------------------------------------------------------------------
_X = ", ".join(f"({c} - {m}::double)/sqrt({v}::double) AS x{i}" for i, (c, m, v) in enumerate(zip(("lep_pt", "met"), NETWORK.mean, NETWORK.variance, strict=True)))
_H, _O = _sql_forward(NETWORK)
_EXP = "(exp(o0)+exp(o1)+exp(o2)+exp(o3))"


@query(
    "q_class_gradient",
    views(f"a AS (SELECT label, w*[{', '.join(map(_D, CLASS_WEIGHTS))}][label + 1] AS w, {_X} FROM ev)", f"b AS (SELECT *, {_H} FROM a)", f"c AS (SELECT *, {_O} FROM b)",
          "d AS (SELECT *, " + ", ".join(f"w*(exp(o{k})/{_EXP} - CASE WHEN label = {k} THEN 1 ELSE 0 END) AS z{k}" for k in range(4)) + f", -w*ln(exp([o0, o1, o2, o3][label + 1])/{_EXP}) AS loss FROM c)",
          f"g AS ({_sql_gradient(NETWORK, 'd', 'count(*)')})")
    + f"SELECT position, {rs('value', 8)} AS value FROM (SELECT * FROM g UNION ALL SELECT -1, sum(loss)/count(*) FROM d)",
)
def q_class_gradient(spark, sf):
    """Loss (position -1) and gradient of a class network."""
    return _frame(spark, *training.gradient_of(events(spark, sf), NETWORK, training.ClassLoss(4, CLASS_WEIGHTS)), 8)


@query("q_train_classes")
def q_train_classes(spark, sf):
    """(epoch, loss) of a class network trained for three epochs and, from its stored state, for three more."""
    table, kept = cut(events(spark, sf).select(*FEATURES, "weight", "label")), store(spark)
    net = training.random_network(FEATURES, (8,), 4, mean=NETWORK.mean, variance=NETWORK.variance)
    for epochs in (3, 6):
        _, losses = training.train(table, net, training.ClassLoss(4, CLASS_WEIGHTS), epochs, training.Adam(0.05), kept)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


# -- ratios --------------------------------------------------------------------------------------------------------------
RATIO_NET = Network(FEATURES, (([[0.3, -0.2], [0.1, 0.4]], [0.05, 0.1]), ([[((3 * i + 5 * k) % 7 - 3) * 0.02 for k in range(len(MONOMIALS))] for i in range(2)], [0.01] * len(MONOMIALS))), "linear", NETWORK.mean, NETWORK.variance)
BIAS = tuple(1.0 + 0.01 * k for k in range(POINTS))
ORDER = ("event_id", "PRI_lep_pt", "PRI_met", "weight")


def samples(spark, sf) -> list:
    """One sample a base point, of unequal sizes."""
    e = with_derived(point_events(spark, sf))
    return [e.where((F.col("point") == k) & (F.col("event_id") % 11 <= 5 + k % 5)) for k in range(POINTS)]


_V = design()["V"]
_H2, _O2 = _sql_forward(RATIO_NET)
_LOG = " + ".join(f"o{k}*v{k}" for k in range(len(MONOMIALS)))
_PTS = "pts AS (SELECT " + ", ".join([f"unnest(range(1, {POINTS})) AS j", *(f"unnest([{', '.join(_D(float(x)) for x in _V[:, k])}]) AS v{k}" for k in range(len(MONOMIALS)))]) + ")"
_SOFT = "(greatest({x}, 0) + ln(1+exp(-abs({x}))))"
_ALIGNED = (
    _POINT_BASE[0],
    "s0 AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY event_id, lep_pt, met, pw) AS n FROM pe WHERE event_id % 11 <= 5 + point % 5)",
    f"a AS (SELECT row_number() OVER () AS r, point, pw AS w, {_X} FROM s0 WHERE n <= (SELECT min(c) FROM (SELECT max(n) AS c FROM s0 GROUP BY point)))",
    f"b AS (SELECT *, {_H2} FROM a)",
    f"c AS MATERIALIZED (SELECT *, {_O2} FROM b)",
    _PTS,
    f"e AS (SELECT c.*, pts.*, {_LOG} AS lg, 1.0::double + 0.01::double*j AS bias FROM c JOIN pts ON c.point = 0 OR c.point = pts.j)",
    "q AS (SELECT *, CASE WHEN point = 0 THEN w/(1+exp(-lg)) ELSE -w/bias/(1+exp(lg)) END AS s, "
    f"CASE WHEN point = 0 THEN w*({_SOFT.format(x='lg')} - ln(2)) ELSE w*({_SOFT.format(x='(-lg)')}/bias - ln(2)) END AS loss FROM e)",
    "d AS (SELECT r, any_value(x0) AS x0, any_value(x1) AS x1, any_value(h0) AS h0, any_value(h1) AS h1, " + ", ".join(f"sum(s*v{k}) AS z{k}" for k in range(len(MONOMIALS))) + " FROM q GROUP BY r)",
    f"g AS ({_sql_gradient(RATIO_NET, 'd', '1')})",
)


@query("q_ratio_gradient", views(*_ALIGNED) + f"SELECT position, {rs('value', 4)} AS value FROM (SELECT * FROM g UNION ALL SELECT -1, sum(loss) FROM q)")
def q_ratio_gradient(spark, sf):
    """Loss (position -1) and gradient of a ratio net over aligned samples of all base points, cut to the shortest."""
    table = training.aligned(samples(spark, sf), FEATURES, ORDER, 500)
    return _frame(spark, *training.gradient_of(table, RATIO_NET, training.RatioLoss(bias=BIAS), mean=False), 4)


@query("q_train_ratio")
def q_train_ratio(spark, sf):
    """(epoch, loss) of a ratio net: aligned once, then an epoch a job."""
    table, kept = training.aligned(samples(spark, sf), FEATURES, ORDER), store(spark)
    for epochs in (2, 4):
        _, losses = training.train(table, RATIO_NET, training.RatioLoss(bias=BIAS), epochs, training.Adam(0.01), kept)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")
