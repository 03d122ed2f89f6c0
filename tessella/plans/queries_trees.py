"""Queries of trees grown level by level, boosting, and their SQL: all features, all base points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import trees
from tessella.operators.yields import design
from tessella.plans.registry import SQL_OF, events, r, rs
from tessella.schema import BASE_POINTS, FEATURES, MONOMIALS, PROCESSES
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


POINTS, EDGES = len(BASE_POINTS), trees.equal_edges(FEATURES)
DEPTH, MIN_SIZE, RATE = 2, 20, 0.2
PARAMETRIC = trees.Parametric(min_size=MIN_SIZE)


# -- events of base points -----------------------------------------------------------------------------------------------
def point_events(spark, sf):
    """Every event at one of the base points, with a weight that follows the point and the event's features; primary columns only."""
    e = events(spark, sf).withColumn("point", (F.col("event_id") % POINTS).cast("int"))
    nu = [F.element_at(F.array(*(F.lit(p[i]) for p in BASE_POINTS)), F.col("point") + 1) for i in range(3)]
    sign = lambda c: F.when(c, 1.0).otherwise(-1.0)
    factor = 1.0 + 0.1 * nu[0] * sign(F.col("PRI_met") > 80) + 0.05 * nu[1] * sign(F.col("PRI_lep_pt") > 40) + 0.04 * nu[2] * sign(F.col("PRI_n_jets") >= 2)
    return e.withColumn("weight", F.col("weight") * factor)


def _sql_codes(source: str, *keep: str) -> str:
    """c0 to c27: the number of thresholds below each feature, or the last bin."""
    code = lambda f: f"CAST(CASE WHEN {SQL_OF[f]} IS NULL OR isnan({SQL_OF[f]}::double) THEN {EDGES.bins - 1} ELSE len(list_filter([{', '.join(f'{x!r}::double' for x in EDGES.of[f])}], lambda e: e < {SQL_OF[f]}::double)) END AS INTEGER)"
    return f"SELECT row_number() OVER () AS r, event_id, {', '.join(keep)}, {', '.join(f'{code(f)} AS c{i}' for i, f in enumerate(FEATURES))} FROM {source}"


_nu = lambda i: f"[{', '.join(f'{p[i]!r}::double' for p in BASE_POINTS)}][event_id % {POINTS} + 1]"
_sign = lambda c: f"CASE WHEN {c} THEN 1.0::double ELSE -1.0::double END"
_BASE = (
    f"pe AS (SELECT *, CAST(event_id % {POINTS} AS INTEGER) AS point, w*(1.0::double + 0.1::double*{_nu(0)}*{_sign('met > 80')} + 0.05::double*{_nu(1)}*{_sign('lep_pt > 40')} + 0.04::double*{_nu(2)}*{_sign('nj >= 2')}) AS pw FROM ce)",
    f"base AS MATERIALIZED ({_sql_codes('pe', 'point', 'pw')})",
)
_D = design()
_table = lambda name, m, i, j: f"{name} AS (SELECT unnest([{', '.join(str(a) for a in range(m.shape[0]) for _ in range(m.shape[1]))}]) AS {i}, unnest([{', '.join(str(b + 1) for _ in range(m.shape[0]) for b in range(m.shape[1]))}]) AS {j}, unnest([{', '.join(f'{float(x)!r}::double' for x in m.ravel())}]) AS v)"
_MATRICES = (_table("mv", _D["MV"], "i0", "j"), _table("mk", _D["M"].T, "a", "j"))
_SOFT = "(greatest({x}, 0) + ln(1+exp(-abs({x}))))"
_CODES = ", ".join(f"c{i}" for i in range(len(FEATURES)))


def _sql_parametric(t: str, source: str, weight: str) -> list[str]:
    """Of the tree on the rows of source (r, point, weight, codes): {t}n (r, node, sums of its leaf's coefficients from node src) and {t}d (node, a, delta)."""
    out = [f"{t}e0 AS (SELECT r, point, {weight} AS w, {_CODES}, 1 AS node FROM {source})", f"{t}t0 AS (SELECT node, point, sum(w) AS tw, count(*) AS tn, 1 AS src FROM {t}e0 GROUP BY node, point)"]
    for k in range(DEPTH):
        side = lambda w, b: f"sum({b}0*({_SOFT.format(x='x')} - ln(2)) + {w}*({_SOFT.format(x='(-x)')} - ln(2)))"
        out += [
            f"{t}o{k} AS (SELECT node FROM {t}t{k} GROUP BY node HAVING min(tn) >= {2 * MIN_SIZE} AND count(*) = {POINTS})",
            f"{t}h{k} AS (SELECT node, f, c, point, sum(w) AS w, count(*) AS n FROM (SELECT node, point, w, unnest([{_CODES}]) AS c, unnest(range({len(FEATURES)})) AS f FROM {t}e{k} JOIN {t}o{k} USING (node)) WHERE c < {EDGES.bins - 1} GROUP BY ALL)",
            f"{t}g{k} AS (SELECT q.node, q.f, q.c, p.point, coalesce(h.w, 0) AS w, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT node, f, c FROM {t}h{k} WHERE c < {EDGES.bins - 2}) q CROSS JOIN (SELECT unnest(range({POINTS}))::INTEGER AS point) p LEFT JOIN {t}h{k} h USING (node, f, c, point))",
            f"{t}l{k} AS (SELECT node, f, c, point, sum(w) OVER s AS lw, sum(n) OVER s AS ln_, tw, tn FROM {t}g{k} JOIN {t}t{k} USING (node, point) WINDOW s AS (PARTITION BY node, f, point ORDER BY c))",
            f"{t}v{k} AS (SELECT node, f, c FROM {t}l{k} GROUP BY node, f, c HAVING min(ln_) >= {MIN_SIZE} AND min(tn - ln_) >= {MIN_SIZE} AND min(lw) > 0 AND min(tw - lw) > 0)",
            f"{t}s{k} AS (SELECT node, f, c, side, point, CASE side WHEN 0 THEN lw ELSE tw - lw END AS w FROM {t}l{k} JOIN {t}v{k} USING (node, f, c), (SELECT unnest([0, 1]) AS side))",
            f"{t}y{k} AS (SELECT a.node, a.f, a.c, a.side, a.point, a.w, b.w AS w0, ln(a.w/b.w) AS lg FROM {t}s{k} a JOIN {t}s{k} b ON (a.node, a.f, a.c, a.side) = (b.node, b.f, b.c, b.side) AND b.point = 0 WHERE a.point > 0)",
            f"{t}x{k} AS (SELECT node, f, c, side, mv.i0 + 1 AS point, sum(mv.v*lg) AS x FROM {t}y{k} JOIN mv ON mv.j = point GROUP BY ALL)",
            f"{t}z{k} AS (SELECT node, f, c, round({side('w', 'w')}, {trees.DIGITS}) AS loss FROM {t}x{k} JOIN {t}y{k} USING (node, f, c, side, point) GROUP BY node, f, c)",
            f"{t}b{k} AS (SELECT node, f, c FROM {t}z{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY loss, f, c) = 1)",
            f"{t}e{k + 1} AS (SELECT r, point, w, {_CODES}, CASE WHEN b.node IS NULL THEN e.node WHEN [{_CODES}][f + 1] <= c THEN 2*e.node ELSE 2*e.node + 1 END AS node FROM {t}e{k} e LEFT JOIN {t}b{k} b ON e.node = b.node)",
            f"{t}t{k + 1} AS (SELECT node, point, sum(w) AS tw, count(*) AS tn FROM {t}e{k + 1} WHERE node >= {2 ** (k + 1)} GROUP BY node, point)",
        ]
    out += [
        f"{t}w AS (SELECT node, point, tw, tn FROM {t}t0 " + "".join(f"UNION ALL SELECT node, point, tw, tn FROM {t}t{k} " for k in range(1, DEPTH + 1)) + ")",
        f"{t}k AS (SELECT node, CASE WHEN min(tn) >= {2 * MIN_SIZE} AND count(*) = {POINTS} THEN node ELSE node // 2 END AS src FROM {t}w GROUP BY node)",
        f"{t}d AS (SELECT k.node, mk.a, sum(mk.v*ln(p.tw/q.tw)) AS delta FROM {t}k k JOIN {t}w p ON p.node = k.src AND p.point > 0 JOIN {t}w q ON q.node = k.src AND q.point = 0 JOIN mk ON mk.j = p.point GROUP BY k.node, mk.a)",
        f"{t}f AS (SELECT node, list(delta ORDER BY a) AS d FROM {t}d GROUP BY node)",
    ]
    return out


@query("q_grow_levels", views(*_BASE, *_MATRICES, *_sql_parametric("a", "base", "pw")) + "SELECT event_id, point, " + ", ".join(f"{rs(f'd[{k + 1}]')} AS d{k}" for k in range(len(MONOMIALS))) + f" FROM base JOIN ae{DEPTH} USING (r, point) JOIN af USING (node)")
def q_grow_levels(spark, sf):
    """A parametric tree over all features and base points: each event's coefficients."""
    table = trees.binned(point_events(spark, sf), EDGES, "weight", "point", "event_id")
    grown, _ = trees.grow(table, EDGES, PARAMETRIC, DEPTH)
    return trees.placed(table, grown[0], "event_id", "point").select("event_id", "point", *(r(F.col("value")[k]).alias(f"d{k}") for k in range(len(MONOMIALS))))


def store(spark) -> trees.Store:
    return trees.Store(spark, f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}")


_V = [f"[{', '.join(f'{float(x)!r}::double' for x in [0.0] + [row[k] for row in _D['V']])}][point + 1]" for k in range(len(MONOMIALS))]
_moved = lambda rate: f"CASE WHEN point = 0 THEN w ELSE w*exp(-{rate}::double*(" + " + ".join(f"d[{k + 1}]*{v}" for k, v in enumerate(_V)) + ")) END"


@query(
    "q_boost_parametric",
    views(*_BASE, *_MATRICES, *_sql_parametric("a", "base", "pw"), f"second AS MATERIALIZED (SELECT r, point, {_moved(1.0)} AS pw, {_CODES} FROM ae{DEPTH} JOIN af USING (node))", *_sql_parametric("b", "second", "pw"))
    + f"SELECT event_id, e.point, {rs(_moved(RATE).replace('[point', '[e.point').replace('WHEN point', 'WHEN e.point'), 7)} AS weight FROM be{DEPTH} e JOIN bf USING (node) JOIN base USING (r)",
)
def q_boost_parametric(spark, sf):
    """Weights after two trees, the first of which counts in full. The second one comes from a run that goes on after the first."""
    rows, kept = point_events(spark, sf), store(spark)
    options = {"depth": DEPTH, "rate": RATE, "first_full": True, "objective": PARAMETRIC, "keep": ("event_id",)}
    for rounds in (1, 2):
        trees.boost_parametric(kept, rows, EDGES, rounds, **options)
    return kept.version(2).select("event_id", "point", r("weight", 7).alias("weight"))


# -- second order --------------------------------------------------------------------------------------------------------
L2, ETA = 1.0, 0.3


def _sql_newton(source: str, targets: int, gradient: str, hessian: str) -> list[str]:
    """One round on source (r, event_id, w, target, codes): m (r, k, margin). gradient and hessian are SQL of w, target and the tree k."""
    score = lambda g, h: f"({g}*{g}/({h} + {L2}))"
    out = [f"e0 AS (SELECT r, k, {gradient} AS g, {hessian} AS h, {_CODES}, 1 AS node FROM {source}, (SELECT unnest(range({targets})) AS k))", "t0 AS (SELECT k, node, sum(g) AS tg, sum(h) AS th FROM e0 GROUP BY k, node)"]
    for i in range(DEPTH):
        gain = f"({score('lg', 'lh')} + {score('(tg - lg)', '(th - lh)')} - {score('tg', 'th')})/2"
        out += [
            f"h{i} AS (SELECT k, node, f, c, sum(g) AS g, sum(h) AS h FROM (SELECT k, node, g, h, unnest([{_CODES}]) AS c, unnest(range({len(FEATURES)})) AS f FROM e{i}) WHERE c < {EDGES.bins - 2} GROUP BY ALL)",
            f"l{i} AS (SELECT k, node, f, c, sum(g) OVER s AS lg, sum(h) OVER s AS lh, tg, th FROM h{i} JOIN t{i} USING (k, node) WHERE th >= 2 WINDOW s AS (PARTITION BY k, node, f ORDER BY c))",
            f"b{i} AS (SELECT k, node, f, c FROM l{i} WHERE lh >= 1 AND th - lh >= 1 AND {gain} > 1e-{trees.DIGITS} QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY round(-{gain}, {trees.DIGITS}), f, c) = 1)",
            f"e{i + 1} AS (SELECT r, e.k, g, h, {_CODES}, CASE WHEN b.node IS NULL THEN e.node WHEN [{_CODES}][f + 1] <= c THEN 2*e.node ELSE 2*e.node + 1 END AS node FROM e{i} e LEFT JOIN b{i} b ON e.node = b.node AND e.k = b.k)",
            f"t{i + 1} AS (SELECT k, node, sum(g) AS tg, sum(h) AS th FROM e{i + 1} WHERE node >= {2 ** (i + 1)} GROUP BY k, node)",
        ]
    return [*out, f"u AS (SELECT k, node, -{ETA}*sum(g)/(sum(h) + {L2}) AS step FROM e{DEPTH} GROUP BY k, node)", f"m AS (SELECT r, list(step ORDER BY k) AS m FROM e{DEPTH} JOIN u USING (k, node) GROUP BY r)"]


_CLASSES = (f"base AS MATERIALIZED ({_sql_codes('ce', 'w', 'label AS target')})",)


@query(
    "q_boost_softprob",
    views(*_CLASSES, *_sql_newton("base", 4, "w*(0.25::double - CASE WHEN target = k THEN 1 ELSE 0 END)", "2*w*0.1875::double"))
    + "SELECT event_id, " + ", ".join(f"{rs(f'exp(m[{k + 1}])/(exp(m[1])+exp(m[2])+exp(m[3])+exp(m[4]))', 7)} AS p_{p}" for k, p in enumerate(PROCESSES)) + " FROM base JOIN m USING (r)",
)
def q_boost_softprob(spark, sf):
    """Class shares after one round of four trees, one a class, grown together."""
    kept = store(spark)
    trees.boost_newton(kept, events(spark, sf).withColumn("target", F.col("label")), EDGES, 1, DEPTH, trees.Newton(rate=ETA, l2=L2), ("event_id",))
    parts = [F.exp(F.col("margins")[k]) for k in range(4)]
    return kept.version(1).select("event_id", *(r(parts[k] / (parts[0] + parts[1] + parts[2] + parts[3]), 7).alias(f"p_{p}") for k, p in enumerate(PROCESSES)))


_TAGS = (_BASE[0], f"base AS MATERIALIZED ({_sql_codes('pe', f'CASE WHEN point = 0 THEN pw*{POINTS - 1} ELSE pw END AS w', 'CASE WHEN point = 0 THEN 0 ELSE 1 END AS target')})")


@query("q_boost_tags", views(*_TAGS, *_sql_newton("base", 1, "w*(0.5::double - target)", "w*0.25::double")) + f"SELECT event_id, {rs('m[1]', 7)} AS margin FROM base JOIN m USING (r)")
def q_boost_tags(spark, sf):
    """The margin between events of the base points and nominal ones after one round; nominal events stand for a copy at each other point."""
    kept = store(spark)
    trees.boost_newton(kept, trees.tagged(point_events(spark, sf)), EDGES, 1, DEPTH, trees.Newton("tags", rate=ETA, l2=L2), ("event_id",))
    return kept.version(1).select("event_id", r(F.col("margins")[0], 7).alias("margin"))
