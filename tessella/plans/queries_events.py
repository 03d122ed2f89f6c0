"""Queries over events: scans, kinematics, variations, selections, weights, yields and histograms."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import kinematics as K
from tessella.functions.numeric import half_even
from tessella.operators import histograms as H
from tessella.operators import quality, resampling, selections, systematics, yields
from tessella.operators import variations as V
from tessella.plans.registry import SQL_OF, derived, events, r, rs, scored
from tessella.schema import ALPHA_MEAN, ALPHA_SIGMA, BASE_POINTS, BINNING, CODE, FEATURES, MONOMIALS, PROCESSES, SHAPES
from tessella.sources import events as S
from tessella.sources.fixture import LOG_YIELD, SQL_NAMES, centralities_sql, derived_sql, momenta_sql, views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


PRIMARY_SQL = tuple(SQL_OF[f] for f in FEATURES[:16])


# -- scans and sources ---------------------------------------------------------------------------------------------------
@query("q_scan_events", views() + "SELECT event_id, " + ", ".join(f"{s} AS {f}" if f == "PRI_n_jets" else f"{rs(s)} AS {f}" for f, s in SQL_OF.items() if f.startswith("PRI")) + f", {rs('w')} AS weight, label FROM ev")
def q_scan_events(spark, sf):
    return events(spark, sf).select("event_id", *(F.col(f) if f == "PRI_n_jets" else r(f).alias(f) for f in FEATURES[:16]), r("weight").alias("weight"), "label")


#: Draw k of an event: 52 bits of a digest of seed and event_id, four draws a digest.
_draw = lambda k, seed=resampling.SEED: f"(('0x' || substr(sha256('{seed}:' || event_id || ':{k // 4}'), {13 * (k % 4) + 1}, 13))::UBIGINT::DOUBLE/{1 << 52}::double)"


@query("q_sample_n", views() + f"SELECT event_id FROM ev ORDER BY {_draw(0)} LIMIT 1000")
def q_sample_n(spark, sf):
    return resampling.sample_rows(events(spark, sf).select("event_id"), 1000, key=["event_id"])


_ORDERED = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, o_totalprice, o_custkey FROM orders"


def _ordered(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey")
    return S.index_rows(orders, [F.col("o_orderkey")])


@query("q_pick_rows", f"WITH o AS ({_ORDERED}) SELECT CAST(row_idx AS BIGINT) AS row_idx, o_orderkey, o_totalprice FROM o WHERE row_idx IN (0, 5, 17, 400, 1200)")
def q_pick_rows(spark, sf):
    return S.pick_rows(_ordered(spark, sf), [0, 5, 5, 17, 400, 1200]).select("row_idx", "o_orderkey", "o_totalprice")


@query("q_zip_columns", f"WITH o AS ({_ORDERED}), c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_custkey FROM customer) SELECT CAST(o.row_idx AS BIGINT) AS row_idx, o_orderkey, c_custkey FROM o JOIN c USING (row_idx)")
def q_zip_columns(spark, sf):
    customers = S.index_rows(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey"), [F.col("c_custkey")])
    return S.zip_columns(_ordered(spark, sf).select("row_idx", "o_orderkey"), customers).select("row_idx", "o_orderkey", "c_custkey")


@query("q_union_process", views() + "SELECT event_id, label, CASE label WHEN 0 THEN 'htautau' WHEN 1 THEN 'ztautau' WHEN 2 THEN 'ttbar' ELSE 'diboson' END AS process FROM ev")
def q_union_process(spark, sf):
    parts = [df.select("event_id", "label", F.lit(p).alias("process")) for p, df in resampling.split_by_process(events(spark, sf)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("q_batch_weight_sum", f"WITH o AS ({_ORDERED}) SELECT CAST(row_idx // 1000 AS BIGINT) AS batch, {rs('sum(o_totalprice)', 2)} AS weight_sum, count(*) AS n FROM o GROUP BY row_idx // 1000")
def q_batch_weight_sum(spark, sf):
    return S.batches(_ordered(spark, sf), size=1000).groupBy("batch").agg(r(F.sum("o_totalprice"), 2).alias("weight_sum"), F.count("*").alias("n"))


_NAMES = [S.file_name(p, v) for p in (None, *PROCESSES) for v in (None, (0.97, 1.0, 0.0), (1.0, 1.01, 1.5), (1.02, 0.99, 3.0))]


@query(
    "q_parse_filename",
    "WITH f AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS file), b AS (SELECT file, replace(file, '.h5', '') AS base, regexp_extract(file, '(htautau|ztautau|ttbar|diboson)', 1) AS p FROM f) "
    "SELECT file, CASE WHEN p = '' THEN NULL ELSE p END AS process, "
    + ", ".join(f"coalesce(TRY_CAST(replace(regexp_extract(base, '{s}_([0-9]+p[0-9]+|[0-9]+)', 1), 'p', '.') AS DOUBLE), {d}::double) AS {s}" for s, d in zip(S.SHIFTS, S.DEFAULTS, strict=True))
    + " FROM b",
)
def q_parse_filename(spark, sf):
    files = spark.createDataFrame([(n,) for n in _NAMES], "file string")
    return files.select("file", *(c.alias(n) for n, c in S.parse_file_name(F.col("file")).items()))


@query("q_copy_selection", views() + f"SELECT event_id, {rs('w')} AS weight FROM de WHERE mt < 70 AND j1_pt > 50 AND j2_pt > 30 AND label = 0")
def q_copy_selection(spark, sf):
    return selections.process_filter(selections.select_region(derived(spark, sf), "lowMT_VBFJet"), "htautau").select("event_id", r("weight").alias("weight"))


# -- kinematics ----------------------------------------------------------------------------------------------------------
@query("q_momenta", views() + "SELECT event_id, " + ", ".join(f"{rs(s)} AS {n}" for n, s in (("had_px", "hx"), ("had_py", "hy"), ("had_pz", "hz"), ("had_p", "hp"), ("lep_pz", "lz"), ("met_px", "mx"), ("met_py", "my"), ("j1_px", "ax"), ("j1_pz", "az"), ("j2_py", "by_"), ("j2_p", "bp"))) + " FROM mo")
def q_momenta(spark, sf):
    m = {n: K.momentum(n) for n in (K.HAD, K.LEP, K.MET, K.JET[1], K.JET[2])}
    cols = {"had_px": (K.HAD, "px"), "had_py": (K.HAD, "py"), "had_pz": (K.HAD, "pz"), "had_p": (K.HAD, "p"), "lep_pz": (K.LEP, "pz"), "met_px": (K.MET, "px"),
            "met_py": (K.MET, "py"), "j1_px": (K.JET[1], "px"), "j1_pz": (K.JET[1], "pz"), "j2_py": (K.JET[2], "py"), "j2_p": (K.JET[2], "p")}
    return events(spark, sf).select("event_id", *(r(m[a][b]).alias(n) for n, (a, b) in cols.items()))


#: Digits that survive the cancellation in a root of differences.
_COARSE = {"DER_mass_transverse_met_lep": 3, "DER_mass_vis": 3, "DER_mass_jet_jet": 3, "DER_pt_tot": 5}


def _derived_query(name: str, *features: str):
    digits = {f: _COARSE.get(f, 6) for f in features}

    @query(name, views() + "SELECT event_id, " + ", ".join(f"{rs(SQL_OF[f], digits[f])} AS {f}" for f in features) + " FROM ce")
    def run(spark, sf):
        return K.with_derived(events(spark, sf), features).select("event_id", *(r(f, digits[f]).alias(f) for f in features))


_derived_query("q_der_mt", "DER_mass_transverse_met_lep")
_derived_query("q_der_mass_vis", "DER_mass_vis")
_derived_query("q_der_pt_h", "DER_pt_h")
_derived_query("q_der_jets", "DER_deltaeta_jet_jet", "DER_mass_jet_jet", "DER_prodeta_jet_jet")
_derived_query("q_der_deltar", "DER_deltar_had_lep")
_derived_query("q_der_pt_tot", "DER_pt_tot")
_derived_query("q_der_sum_pt", "DER_sum_pt")
_derived_query("q_der_ratio", "DER_pt_ratio_lep_tau")
_derived_query("q_der_met_centrality", "DER_met_phi_centrality")
_derived_query("q_der_lep_centrality", "DER_lep_eta_centrality")
_derived_query("q_derived_all", *K.DERIVE)


@query(
    "q_v4_kinematics",
    views("v AS (SELECT *, hx+lx AS x, hy+ly AS y, hz+lz AS z, hp+lp AS e FROM mo)")
    + f"SELECT event_id, {rs('sqrt(x*x+y*y)', 5)} AS pt, {rs('sqrt(abs(e*e-x*x-y*y-z*z))', 3)} AS mass, {rs('asinh(z/sqrt(x*x+y*y))', 5)} AS eta, {rs('atan2(y, x)', 5)} AS phi, "
    f"{rs('had_eta-lep_eta', 5)} AS delta_eta, abs(e) + 0.001 >= sqrt(x*x+y*y+z*z) AS valid FROM v",
)
def q_v4_kinematics(spark, sf):
    had, lep = (K.Vector4.from_polar(*(F.col(f"{n}_{x}") for x in ("pt", "eta", "phi"))) for n in (K.HAD, K.LEP))
    v = K.Vector4.sum([had, lep])
    e = events(spark, sf)
    return e.select("event_id", r(v.pt(), 5).alias("pt"), r(v.mass(), 3).alias("mass"), r(v.eta(), 5).alias("eta"), r(v.phi(), 5).alias("phi"), r(had.delta_eta(lep), 5).alias("delta_eta"), v.valid().alias("valid"))


_TES, _JES = 1.02, 1.03
_tes_view = f"t AS (SELECT *, had_pt*{_TES}::double AS had2, mx+(had_pt*cos(had_phi)*{_TES}::double)*((1-{_TES}::double)/{_TES}::double) AS x, my+(had_pt*sin(had_phi)*{_TES}::double)*((1-{_TES}::double)/{_TES}::double) AS y FROM mo)"


@query("q_syst_tes", views(_tes_view) + f"SELECT event_id, {rs('had2', 3)} AS had_pt, {rs('sqrt(x*x+y*y)', 3)} AS met, {rs('atan2(y, x)', 3)} AS met_phi FROM t")
def q_syst_tes(spark, sf):
    return systematics.vary(events(spark, sf), systematics.Shift(tes=_TES)).select("event_id", r("PRI_had_pt", 3).alias("had_pt"), r("PRI_met", 3).alias("met"), r("PRI_met_phi", 3).alias("met_phi"))


_k = f"((1-{_JES}::double)/{_JES}::double)"
_jes_view = (
    f"t AS (SELECT *, CASE WHEN nj>=1 THEN j1_pt*{_JES}::double ELSE j1_pt END AS a1, CASE WHEN nj>=2 THEN j2_pt*{_JES}::double ELSE j2_pt END AS a2, all_pt*{_JES}::double AS a3, "
    f"mx + ax*{_JES}::double*{_k} + bx*{_JES}::double*{_k} AS x, my + ay*{_JES}::double*{_k} + by_*{_JES}::double*{_k} AS y FROM mo)"
)


@query("q_syst_jes", views(_jes_view) + f"SELECT event_id, {rs('round_even(a1*1000, 0)/1000')} AS j1_pt, {rs('round_even(a2*1000, 0)/1000')} AS j2_pt, {rs('round_even(a3*1000, 0)/1000')} AS all_pt, {rs('sqrt(x*x+y*y)', 3)} AS met FROM t")
def q_syst_jes(spark, sf):
    v = systematics.vary(events(spark, sf), systematics.Shift(jes=_JES))
    return v.select("event_id", r("PRI_jet_leading_pt").alias("j1_pt"), r("PRI_jet_subleading_pt").alias("j2_pt"), r("PRI_jet_all_pt").alias("all_pt"), r("PRI_met", 3).alias("met"))


_NOISE = f"sqrt(-2*ln({_draw(0)} + {2.0**-53!r}::double))*{{}}(2*pi()*{_draw(1)})*2.0::double"


@query("q_syst_softmet", views(f"n AS (SELECT event_id, met*cos(met_phi) + {_NOISE.format('cos')} AS x, met*sin(met_phi) + {_NOISE.format('sin')} AS y FROM ev)") + f"SELECT event_id, {rs('round_even(sqrt(x*x + y*y)*1000, 0)/1000', 3)} AS met, {rs('cos(round_even(atan2(y, x)*1000, 0)/1000)', 4)} AS c FROM n")
def q_syst_softmet(spark, sf):
    v = systematics.vary(events(spark, sf), systematics.Shift(soft_met=2.0, key="event_id"))
    return v.select("event_id", r("PRI_met", 3).alias("met"), r(F.cos("PRI_met_phi"), 4).alias("c"))


@query("q_round3", views() + f"SELECT event_id, {rs('round_even(w*1.23456789::double*1000, 0)/1000')} AS rounded FROM ev")
def q_round3(spark, sf):
    return events(spark, sf).select("event_id", r(half_even(F.col("weight") * F.lit(1.23456789))).alias("rounded"))


@query("q_alpha_to_nu", views() + "SELECT event_id, " + ", ".join(f"{rs(f'(w - {ALPHA_MEAN[a]}::double)/{ALPHA_SIGMA[a]}::double')} AS nu_{a}" for a in ALPHA_MEAN) + " FROM ev")
def q_alpha_to_nu(spark, sf):
    return events(spark, sf).select("event_id", *(r(systematics.alpha_to_nu(F.col("weight"), a)).alias(f"nu_{a}") for a in ALPHA_MEAN))


@query("q_nu_to_alpha", views() + "SELECT event_id, " + ", ".join(f"{rs(f'w*{ALPHA_SIGMA[a]}::double + {ALPHA_MEAN[a]}::double')} AS alpha_{a}" for a in ALPHA_MEAN) + " FROM ev")
def q_nu_to_alpha(spark, sf):
    return events(spark, sf).select("event_id", *(r(systematics.nu_to_alpha(F.col("weight"), a)).alias(f"alpha_{a}") for a in ALPHA_MEAN))


_STANDARD = ("PRI_lep_pt", "PRI_had_pt", "PRI_met")


@query("q_standardize", views("m AS (SELECT " + ", ".join(f"avg({SQL_OF[f]}) AS m_{SQL_OF[f]}, var_pop({SQL_OF[f]}) AS v_{SQL_OF[f]}" for f in _STANDARD) + " FROM ev)") + "SELECT event_id, " + ", ".join(f"{rs(f'({SQL_OF[f]}-m_{SQL_OF[f]})/sqrt(v_{SQL_OF[f]})', 5)} AS {f}" for f in _STANDARD) + " FROM ev, m")
def q_standardize(spark, sf):
    e = events(spark, sf)
    stats = {row.feature: row for row in yields.feature_statistics(e, _STANDARD).collect()}  # one row a feature
    return e.select("event_id", *(r(yields.standardised(F.col(f), stats[f].mean, stats[f].variance), 5).alias(f) for f in _STANDARD))


@query("q_nu_monomials", "WITH p AS (SELECT unnest([" + ", ".join(str(i) for i in range(35)) + "]) AS i, unnest([" + ", ".join(f"{p[0]}::double" for p in BASE_POINTS) + "]) AS tes, unnest([" + ", ".join(f"{p[1]}::double" for p in BASE_POINTS) + "]) AS jes, unnest([" + ", ".join(f"{p[2]}::double" for p in BASE_POINTS) + "]) AS met) SELECT CAST(i AS INTEGER) AS i, " + ", ".join(f"{'*'.join(n.removeprefix('nu_') for n in c)} + 0.0::double AS m{k}" for k, c in enumerate(MONOMIALS)) + " FROM p")
def q_nu_monomials(spark, sf):
    return yields.base_point_table(spark).select("i", *((m + F.lit(0.0)).alias(f"m{k}") for k, m in enumerate(yields.monomial_columns())))


# -- selections ----------------------------------------------------------------------------------------------------------
_SQL_ATOMS = {
    "inclusive": "true", "lowMT": "mt < 70", "highMT": "mt >= 70", "VBFJet": "(j1_pt > 50 AND j2_pt > 30)", "noVBFJet": "NOT (j1_pt > 50 AND j2_pt > 30)", "ptH0to50": "pt_h < 50", "ptH0to100": "pt_h < 100",
    "ptH50to100": "(pt_h >= 50 AND pt_h < 100)", "ptH100to200": "(pt_h >= 100 AND pt_h < 200)", "ptH100": "pt_h >= 100", "ptH200": "pt_h >= 200",
}


def sql_region(name: str) -> str:
    return " AND ".join(_SQL_ATOMS[p] for p in name.split("_"))


def _atom_query(name: str):
    @query(f"q_sel_{name}", views() + f"SELECT event_id, {rs('w')} AS weight FROM de WHERE {_SQL_ATOMS[name]}")
    def run(spark, sf):
        return selections.select_region(derived(spark, sf), name).select("event_id", r("weight").alias("weight"))


for _name in selections.ATOMS:
    _atom_query(_name)


def sql_regions(names, src: str = "de") -> str:
    """Rows of src with their region."""
    return f"SELECT * FROM (SELECT *, unnest(list_filter([{', '.join(f'CASE WHEN {sql_region(n)} THEN {chr(39)}{n}{chr(39)} END' for n in names)}], lambda x: x IS NOT NULL)) AS region FROM {src})"


@query("q_sel_regions", views(f"g AS ({sql_regions(selections.COMPOSITES)})") + f"SELECT region, count(*) AS n, {rs('sum(w)')} AS weight FROM g GROUP BY region")
def q_sel_regions(spark, sf):
    return selections.explode_regions(derived(spark, sf), selections.COMPOSITES).groupBy("region").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query("q_sel_mva", views() + "SELECT event_id, CASE WHEN p2 > 0.4 THEN 'ttbar' ELSE 'diboson' END AS picked FROM sc WHERE p2 > 0.4 OR (p2 <= 0.4 AND p3 > 0.5)")
def q_sel_mva(spark, sf):
    picked = F.array_compact(F.array(*(F.when(c(), F.lit(n)) for n, c in selections.SCORE_SELECTIONS.items())))
    return scored(spark, sf).select("event_id", F.explode(picked).alias("picked"))


@query("q_sel_mva_window", views() + f"SELECT event_id, {rs('p2')} AS p_ttbar, {rs('p3')} AS p_diboson FROM sc WHERE p2 >= 0.1 AND p2 < 0.4 AND p3 >= 0.2 AND p3 < 100")
def q_sel_mva_window(spark, sf):
    rows = scored(spark, sf).where(selections.score_window("ttbar", 0.1, 0.4) & selections.score_window("diboson", 0.2, 100.0))
    return rows.select("event_id", r("p_ttbar").alias("p_ttbar"), r("p_diboson").alias("p_diboson"))


@query("q_sel_process", views() + f"SELECT event_id, {rs('w')} AS weight FROM ev WHERE label = 2")
def q_sel_process(spark, sf):
    return selections.process_filter(events(spark, sf), "ttbar").select("event_id", r("weight").alias("weight"))


@query("q_class_subset", views() + "SELECT event_id, CASE label WHEN 3 THEN 0 ELSE 1 END AS label FROM ev WHERE label IN (3, 1)")
def q_class_subset(spark, sf):
    return selections.class_subset(events(spark, sf), ("diboson", "ztautau")).select("event_id", "label")


@query("q_partition_check", views(f"g AS ({sql_regions(selections.EXCLUSIVE)})") + f"SELECT label, (SELECT count(*) FROM g WHERE g.label = de.label) AS n_regions, count(*) AS n_all, {rs('(SELECT sum(w) FROM g WHERE g.label = de.label)', 4)} AS w_regions, {rs('sum(w)', 4)} AS w_all FROM de GROUP BY label")
def q_partition_check(spark, sf):
    d = derived(spark, sf)
    parts = selections.explode_regions(d, selections.EXCLUSIVE).groupBy("label").agg(F.count("*").alias("n_regions"), r(F.sum("weight"), 4).alias("w_regions"))
    every = d.groupBy("label").agg(F.count("*").alias("n_all"), r(F.sum("weight"), 4).alias("w_all"))
    return parts.join(every, "label")


def sql_thresholds(src: str, had: str) -> str:
    """Thresholds in SQL: the subleading jet first, then the leading one."""
    soft = "{j}_pt BETWEEN 0 AND 26"
    step = lambda j, s: f"SELECT * REPLACE (CASE WHEN {soft.format(j=j)} THEN all_pt-{j}_pt ELSE all_pt END AS all_pt, CASE WHEN {soft.format(j=j)} THEN nj-1 ELSE nj END AS nj, " + ", ".join(f"CASE WHEN {soft.format(j=j)} THEN -25.0::double ELSE {j}_{x} END AS {j}_{x}" for x in ("pt", "eta", "phi")) + f") FROM ({s})"
    return f"SELECT * FROM ({step('j1', step('j2', f'SELECT * FROM {src} WHERE {had}'))}) WHERE lep_pt >= 20"


def _threshold_query(name: str, mode: str, had: str):
    @query(name, views(f"t AS ({sql_thresholds('ev', had)})") + f"SELECT event_id, nj AS n_jets, {rs('all_pt')} AS all_pt, {rs('j1_pt')} AS j1_pt, {rs('j2_eta')} AS j2_eta FROM t")
    def run(spark, sf):
        t = systematics.apply_thresholds(events(spark, sf), mode)
        return t.select("event_id", F.col("PRI_n_jets").alias("n_jets"), r("PRI_jet_all_pt").alias("all_pt"), r("PRI_jet_leading_pt").alias("j1_pt"), r("PRI_jet_subleading_eta").alias("j2_eta"))


_threshold_query("q_postprocess_doc", "documented", "had_pt > 26")
_threshold_query("q_postprocess_lit", "literal", "NOT had_pt >= 26")


# -- weights and sets ----------------------------------------------------------------------------------------------------
@query("q_weight_norms", views() + f"SELECT event_id, {rs('w * CASE WHEN label=2 THEN 1.04::double ELSE 1.0::double END * CASE WHEN label=3 THEN 1.5::double ELSE 1.0::double END * CASE WHEN label!=0 THEN 1.002::double ELSE 1.0::double END')} AS weight FROM ev")
def q_weight_norms(spark, sf):
    return systematics.scale_weights(events(spark, sf), ttbar=1.04, diboson=1.5, background=1.002).select("event_id", r("weight").alias("weight"))


_re = lambda x: f"round_even(({x})*1000, 0)/1000"
_varied = (
    "vr AS (SELECT event_id, label, "
    + ", ".join(f"{_re(c)} AS {c}" for c in ("lep_pt", "lep_eta", "lep_phi", "had_eta", "had_phi", "j1_eta", "j1_phi", "j2_eta", "j2_phi"))
    + f", {_re(f'had_pt*{_TES}::double')} AS had_pt, {_re(f'CASE WHEN nj>=1 THEN j1_pt*{_JES}::double ELSE j1_pt END')} AS j1_pt, {_re(f'CASE WHEN nj>=2 THEN j2_pt*{_JES}::double ELSE j2_pt END')} AS j2_pt, "
    f"{_re(f'all_pt*{_JES}::double')} AS all_pt, nj, {_re('sqrt(x*x+y*y)')} AS met, {_re('atan2(y, x)')} AS met_phi, w*CASE WHEN label=2 THEN 1.04::double ELSE 1.0::double END AS w FROM "
    f"(SELECT *, mx + hx*{_TES}::double*((1-{_TES}::double)/{_TES}::double) + ax*{_JES}::double*{_k} + bx*{_JES}::double*{_k} AS x, my + hy*{_TES}::double*((1-{_TES}::double)/{_TES}::double) + ay*{_JES}::double*{_k} + by_*{_JES}::double*{_k} AS y FROM mo))"
)


@query(
    "q_systematics",
    views(_varied, f"th AS ({sql_thresholds('vr', 'had_pt > 26')})", f"mo2 AS ({momenta_sql('th')})", f"de2 AS ({derived_sql('mo2')})", f"rg AS ({sql_regions(selections.EXCLUSIVE, 'de2')})")
    + f"SELECT region, label, count(*) AS n, {rs('sum(w)', 4)} AS weight, {rs('avg(sum_pt)', 4)} AS mean_sum_pt FROM rg GROUP BY region, label",
)
def q_systematics(spark, sf):
    d = systematics.systematic_events(events(spark, sf), systematics.Shift(tes=_TES, jes=_JES, ttbar_scale=1.04))
    return selections.explode_regions(d, selections.EXCLUSIVE).groupBy("region", "label").agg(F.count("*").alias("n"), r(F.sum("weight"), 4).alias("weight"), r(F.avg("DER_sum_pt"), 4).alias("mean_sum_pt"))


@query("q_class_reweight", views("y AS (SELECT label, sum(w) AS s FROM ev GROUP BY label)") + f"SELECT event_id, label, {rs('w*(SELECT sum(s) FROM y)/y.s')} AS weight FROM ev JOIN y USING (label)")
def q_class_reweight(spark, sf):
    return yields.balance_classes(events(spark, sf)).select("event_id", "label", r("weight").alias("weight"))


@query("q_onehot", views() + "SELECT event_id, " + ", ".join(f"CAST(label = {c} AS INTEGER) AS is_{p}" for p, c in CODE.items()) + " FROM ev")
def q_onehot(spark, sf):
    return selections.one_hot(events(spark, sf)).select("event_id", *(f"is_{p}" for p in PROCESSES))


@query("q_split_process", views() + "SELECT event_id, weight, process FROM (SELECT event_id, w + 0.0::double AS weight, CASE label " + " ".join(f"WHEN {c} THEN '{p}'" for p, c in CODE.items()) + " END AS process FROM ev)")
def q_split_process(spark, sf):
    parts = resampling.split_by_process(events(spark, sf).select("event_id", "weight", "label"))
    every = [resampling.shuffled(rows.select("event_id", "weight", F.lit(p).alias("process"))) for p, rows in parts.items()]
    return reduce(DataFrame.unionByName, every)


def sql_poisson(mean: str, u: str) -> str:
    """The number of a draw: how many partial sums of the distribution it is above. For means up to about 1: numbers beyond 16 do not occur."""
    return f"list_sum(list_transform(range(16), lambda k: CASE WHEN {u} > list_sum(list_transform(range(k + 1), lambda i: exp(-({mean}) + i*ln({mean}) - lgamma(i + 1)))) THEN 1 ELSE 0 END))"


_SCALE = "CASE label WHEN 0 THEN 1.5::double WHEN 1 THEN 1.001::double WHEN 2 THEN 1.02::double*1.001::double ELSE 1.0::double END"


@query("q_bootstrap", views(f"b AS (SELECT event_id, label, w*{_SCALE} AS m, {_draw(0)} AS u FROM ev)") + f"SELECT event_id, label FROM (SELECT event_id, label, unnest(range(CAST({sql_poisson('m', 'u')} AS INTEGER))) FROM b)")
def q_bootstrap(spark, sf):
    return resampling.bootstrap(events(spark, sf).select("event_id", "label", "weight"), mu=1.5, background=1.001, ttbar=1.02, key=["event_id"])


_REPLICATES = 9


@query("q_bootstrap_yields", views("b AS (" + " UNION ALL ".join(f"SELECT label, {k} AS replicate, w AS m, {_draw(k)} AS u FROM ev" for k in range(_REPLICATES)) + ")") + f"SELECT label, CAST(replicate AS INTEGER) AS replicate, CAST(sum({sql_poisson('m', 'u')}) AS BIGINT) AS yield FROM b GROUP BY label, replicate")
def q_bootstrap_yields(spark, sf):
    """The yields of bootstrap replicates, all from one scan."""
    e = events(spark, sf).select("event_id", "label", "weight")
    return resampling.replicate_yields(e, _REPLICATES, "label", key=["event_id"])


@query("q_bootstrap_det", views("b AS (SELECT event_id, label, CAST(floor(w*CASE label WHEN 0 THEN 3.0::double WHEN 1 THEN 2.0::double WHEN 2 THEN 1.04::double*2.0::double ELSE 1.0::double END) AS INTEGER) AS n FROM ev)") + "SELECT event_id, label FROM (SELECT event_id, label, unnest(range(n)) FROM b)")
def q_bootstrap_det(spark, sf):
    return resampling.bootstrap(events(spark, sf).select("event_id", "label", "weight"), mu=3.0, background=2.0, ttbar=1.04, draw=False)


@query("q_repeat_by_weight", views() + "SELECT event_id FROM (SELECT event_id, unnest(range(CAST(floor(w*3.0::double) AS INTEGER))) FROM ev)")
def q_repeat_by_weight(spark, sf):
    return resampling.repeat_by_weight(events(spark, sf).select("event_id", (F.col("weight") * 3.0).alias("weight")))


@query("q_nominal_replicate", views() + f"SELECT CAST(i AS INTEGER) AS i, count(*) AS n, {rs('sum(w)', 4)} AS weight FROM ev, range(1, 35) t(i) GROUP BY i")
def q_nominal_replicate(spark, sf):
    return yields.with_base_points(events(spark, sf).select("weight")).groupBy("i").agg(F.count("*").alias("n"), r(F.sum("weight"), 4).alias("weight"))


# -- yields --------------------------------------------------------------------------------------------------------------
@query("q_weight_sum", views() + f"SELECT {rs('sum(w)')} AS weight_sum, count(*) AS n FROM de WHERE mt < 70")
def q_weight_sum(spark, sf):
    return yields.weight_sum(selections.select_region(derived(spark, sf), "lowMT")).select(r("weight_sum").alias("weight_sum"), "n")


@query("q_ic", views(f"g AS ({sql_regions(selections.EXCLUSIVE)})") + f"SELECT region, label, {rs('sum(w)')} AS yield, count(*) AS n FROM g GROUP BY region, label")
def q_ic(spark, sf):
    return yields.class_yields(selections.explode_regions(derived(spark, sf), selections.EXCLUSIVE), "region").select("region", "label", r("yield").alias("yield"), "n")


@query("q_s_over_b", views(f"g AS ({sql_regions(selections.EXCLUSIVE)})") + f"SELECT region, {rs('sum(CASE WHEN label=0 THEN w ELSE 0 END)/sum(CASE WHEN label!=0 THEN w ELSE 0 END)')} AS s_over_b FROM g GROUP BY region")
def q_s_over_b(spark, sf):
    return yields.signal_over_background(selections.explode_regions(derived(spark, sf), selections.EXCLUSIVE), "region").select("region", r("s_over_b").alias("s_over_b"))


#: Digits of mean and variance; fewer for the two masses that are roots of differences of large numbers.
_ROUND = {f: (2, 0) if f in ("DER_mass_vis", "DER_mass_jet_jet") else (4, 3) for f in FEATURES}


@query("q_scaler", views() + " UNION ALL ".join(f"SELECT '{f}' AS feature, {rs(f'avg({SQL_OF[f]})', _ROUND[f][0])} AS mean, {rs(f'var_pop({SQL_OF[f]})', _ROUND[f][1])} AS variance FROM ce" for f in FEATURES))
def q_scaler(spark, sf):
    coarse = F.col("feature").isin(*(f for f, d in _ROUND.items() if d == (2, 0)))
    rounded = lambda c, fine, rough: F.when(coarse, r(c, rough)).otherwise(r(c, fine)).alias(c)
    return yields.feature_statistics(derived(spark, sf), FEATURES).select("feature", rounded("mean", 4, 2), rounded("variance", 3, 0))


def _at_points(spark, sf):
    """Events at every base point, their weights scaled by the synthetic log-polynomial; the nominal point too."""
    e = events(spark, sf).select("weight", "label")
    nominal = e.select("*", F.lit(0).alias("i"), *(F.lit(0.0).alias(s) for s in SHAPES))
    every = yields.with_base_points(e).unionByName(nominal)
    return every.withColumn("weight", F.col("weight") * F.exp(yields.log_ratio(LOG_YIELD)))


_POINTS = "pts AS (SELECT " + ", ".join(f"unnest([{', '.join(f'{p[k]}::double' for p in BASE_POINTS)}]) AS {s}" for k, s in enumerate(SHAPES)) + ")"
_LOG = "0.010::double*nu_tes - 0.020::double*nu_jes + 0.003::double*nu_met + 0.0001::double*nu_tes*nu_jes"


@query("q_yields_by_point", views(_POINTS, "s AS (SELECT sum(w) AS w FROM ev)") + f"SELECT nu_tes + 0.0::double AS nu_tes, nu_jes + 0.0::double AS nu_jes, nu_met, {rs(f's.w*exp({_LOG})', 4)} AS yield FROM pts, s")
def q_yields_by_point(spark, sf):
    return yields.yields_by_point(_at_points(spark, sf)).select(*((F.col(s) + F.lit(0.0)).alias(s) for s in SHAPES), r("yield", 4).alias("yield"))


@query("q_icp_fit", "SELECT unnest([" + ", ".join(f"'{'*'.join(c)}'" for c in MONOMIALS) + "]) AS monomial, unnest([" + ", ".join(f"{x}::double" for x in LOG_YIELD) + "]) AS coefficient")
def q_icp_fit(spark, sf):
    found = yields.fit_yields(yields.yields_by_point(_at_points(spark, sf)))
    return spark.createDataFrame([("*".join(c), round(float(x), 8) + 0.0) for c, x in zip(MONOMIALS, found, strict=True)], "monomial string, coefficient double")


@query("q_icp_predict", f"WITH {_POINTS} SELECT nu_tes + 0.0::double AS nu_tes, nu_jes + 0.0::double AS nu_jes, nu_met, {rs(f'exp({_LOG})', 8)} AS ratio FROM pts")
def q_icp_predict(spark, sf):
    return yields.base_point_table(spark).select(*((F.col(s) + F.lit(0.0)).alias(s) for s in SHAPES), r(F.exp(yields.log_ratio(LOG_YIELD)), 8).alias("ratio"))


# -- histograms ----------------------------------------------------------------------------------------------------------
def sql_bin(x: str, bins: int, low: float, high: float) -> str:
    return f"CASE WHEN {x} >= {low!r}::double AND {x} <= {high!r}::double AND NOT isnan({x}) THEN least(CAST(floor(({x} - {low!r}::double)/{(high - low) / bins!r}::double) AS INTEGER), {bins - 1}) END"




@query("q_hist_feature", views() + f"SELECT feature, bin, {rs('sum(w)')} AS sum FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {sql_bin(f'({SQL_OF[f]})::double', *BINNING[f])} AS bin, w FROM ce" for f in FEATURES) + ") WHERE bin IS NOT NULL GROUP BY feature, bin")
def q_hist_feature(spark, sf):
    return H.feature_histograms(derived(spark, sf)).select("feature", "bin", r("sum").alias("sum"))


_BIAS = 1.02


_NUMBERED = "pts AS (SELECT unnest(range(" + str(len(BASE_POINTS)) + "))::INTEGER AS point, " + ", ".join(f"unnest([{', '.join(f'{p[k]}::double' for p in BASE_POINTS)}]) AS {s}" for k, s in enumerate(SHAPES)) + ")"
_OWN = " + ".join(f"d0{k}*{'*'.join(c)}" for k, c in enumerate(MONOMIALS))
_ALL_BINS = lambda src, *keep: " UNION ALL ".join(f"SELECT point, '{f}' AS feature, {sql_bin(f'({c})::double', *BINNING[f])} AS bin, {', '.join(keep)} FROM {src}" for c, f in SQL_NAMES.items())


@query(
    "q_hist_net",
    views(_NUMBERED, "cs AS (SELECT ce.*, " + ", ".join(f"(((event_id+{k})%5)-2)::double*0.01::double AS d0{k}" for k in range(len(MONOMIALS))) + " FROM ce)", f"h AS (SELECT cs.*, point, w*exp({_LOG}) AS wv, w*{_BIAS}::double*exp({_OWN}) AS wp FROM cs, pts WHERE point > 0)", f"b AS ({_ALL_BINS('h', 'wv', 'wp')})")
    + f"SELECT point, feature, bin, {rs('sum(wv)', 4)} AS true_sum, {rs('sum(wp)', 4)} AS predicted FROM b WHERE bin IS NOT NULL GROUP BY ALL",
)
def q_hist_net(spark, sf):
    """Of every base point and feature: varied weights, and nominal weights times a ratio net's answer."""
    h = V.point_histograms(scored(spark, sf), LOG_YIELD, "d_htautau", _BIAS)
    return h.select("point", "feature", "bin", r("true_sum", 4).alias("true_sum"), r("predicted", 4).alias("predicted"))


_TES_, _JES_ = "(1.0::double + nu_tes*0.01::double)", "(1.0::double + nu_jes*0.01::double)"
_AT_POINTS = (
    _NUMBERED,
    f"mp AS (SELECT mo.*, point, {_TES_} AS tes, {_JES_} AS jes, nu_met AS soft, sqrt(-2*ln({_draw(0)} + {2.0**-53!r}::double))*cos(2*pi()*{_draw(1)}) AS zx, sqrt(-2*ln({_draw(0)} + {2.0**-53!r}::double))*sin(2*pi()*{_draw(1)}) AS zy FROM mo, pts)",
    "mq AS (SELECT *, mx + CASE WHEN tes != 1 THEN hx*tes*((1-tes)/tes) ELSE 0 END + CASE WHEN jes != 1 THEN ax*jes*((1-jes)/jes) + bx*jes*((1-jes)/jes) ELSE 0 END + zx*soft AS x, "
    "my + CASE WHEN tes != 1 THEN hy*tes*((1-tes)/tes) ELSE 0 END + CASE WHEN jes != 1 THEN ay*jes*((1-jes)/jes) + by_*jes*((1-jes)/jes) ELSE 0 END + zy*soft AS y FROM mp)",
    "vp AS (SELECT event_id, point, w, nj, " + ", ".join(f"round_even({c}*1000, 0)/1000 AS {c}" for c in ("lep_pt", "lep_eta", "lep_phi", "had_eta", "had_phi", "j1_eta", "j1_phi", "j2_eta", "j2_phi"))
    + ", round_even(had_pt*tes*1000, 0)/1000 AS had_pt, round_even(CASE WHEN nj>=1 THEN j1_pt*jes ELSE j1_pt END*1000, 0)/1000 AS j1_pt, round_even(CASE WHEN nj>=2 THEN j2_pt*jes ELSE j2_pt END*1000, 0)/1000 AS j2_pt, "
    "round_even(all_pt*jes*1000, 0)/1000 AS all_pt, round_even(sqrt(x*x+y*y)*1000, 0)/1000 AS met, round_even(atan2(y, x)*1000, 0)/1000 AS met_phi FROM mq)",
)
_VARIED_BINS = views(*_AT_POINTS, f"th AS ({sql_thresholds('vp', 'had_pt > 26')})", f"mo2 AS ({momenta_sql('th')})", f"de2 AS ({derived_sql('mo2')})", f"ce2 AS ({centralities_sql('de2')})", f"b AS ({_ALL_BINS('ce2', 'w')})")


@query("q_hist_variations", _VARIED_BINS + f"SELECT point, feature, bin, {rs('sum(w)', 4)} AS sum FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def q_hist_variations(spark, sf):
    """All features at all base points, as they vary with the energy scales and the soft term, from one scan."""
    return V.varied_histograms(events(spark, sf)).select("point", "feature", "bin", r("sum", 4).alias("sum"))


_MET_BIN = sql_bin("met", *BINNING["PRI_met"])


@query("q_hist_class", views() + f"SELECT bin, {', '.join(f'{rs(f"sum(CASE WHEN label={c} THEN w ELSE 0 END)")} AS true_{p}, {rs(f"sum(w*p{c})", 5)} AS pred_{p}' for p, c in CODE.items())} FROM (SELECT *, {_MET_BIN} AS bin FROM sc) WHERE bin IS NOT NULL GROUP BY bin")
def q_hist_class(spark, sf):
    h = H.class_histograms(scored(spark, sf), "PRI_met", PROCESSES)
    return h.select("bin", *(r(f"true_{p}").alias(f"true_{p}") for p in PROCESSES), *(r(f"pred_{p}", 5).alias(f"pred_{p}") for p in PROCESSES))


@query("q_hist_score", views("c AS (" + " UNION ALL ".join(f"SELECT '{p}' AS predicted, label, {sql_bin(f'p{c}', 30, 0.0, 1.0)} AS bin, w FROM sc" for p, c in CODE.items()) + ")", "h AS (SELECT predicted, label, bin, sum(w) AS s FROM c WHERE bin IS NOT NULL GROUP BY predicted, label, bin)") + f"SELECT predicted, label, bin, {rs('s')} AS sum, {rs('s/sum(s) OVER (PARTITION BY predicted, label)', 8)} AS share FROM h")
def q_hist_score(spark, sf):
    return H.score_histograms(scored(spark, sf), PROCESSES).select("predicted", "label", "bin", r("sum").alias("sum"), r("share", 8).alias("share"))


@query("q_hist_rebin", views() + f"SELECT label, CAST(floor(bin/4) AS INTEGER) AS bin, {rs('sum(w)')} AS sum FROM (SELECT *, {_MET_BIN} AS bin FROM ev) WHERE bin IS NOT NULL GROUP BY label, floor(bin/4)")
def q_hist_rebin(spark, sf):
    h = H.histogram(events(spark, sf), F.col("PRI_met"), *BINNING["PRI_met"], {"sum": F.col("weight")}, "label")
    return H.rebin(h, 4, "label").select("label", "bin", r("sum").alias("sum"))


@query("q_hist_ratio", views(f"h AS (SELECT label, bin, sum(w) AS s FROM (SELECT *, {_MET_BIN} AS bin FROM ev) WHERE bin IS NOT NULL GROUP BY label, bin)") + f"SELECT a.label, a.bin, {rs('CASE WHEN b.s > 0 THEN a.s/b.s ELSE 0 END')} AS ratio FROM h a LEFT JOIN h b ON a.bin = b.bin AND b.label = 0")
def q_hist_ratio(spark, sf):
    h = H.histogram(events(spark, sf), F.col("PRI_met"), *BINNING["PRI_met"], {"sum": F.col("weight")}, "label")
    return H.ratio_to(h, h.where("label = 0")).select("label", "bin", r("ratio").alias("ratio"))


@query("q_hist2d", views("s AS (SELECT min(w) AS a, max(w) AS b, min(met) AS c, max(met) AS d FROM ev)") + "SELECT least(CAST(floor((w-a)/(b-a)*50) AS INTEGER), 49) AS bin_x, least(CAST(floor((met-c)/(d-c)*50) AS INTEGER), 49) AS bin_y, count(*) AS n FROM ev, s GROUP BY ALL")
def q_hist2d(spark, sf):
    return H.histogram_2d(events(spark, sf), F.col("weight"), F.col("PRI_met"))


# -- quality of scores and intervals -------------------------------------------------------------------------------------
_ROC = """h AS (SELECT p0 AS t, sum(CASE WHEN label=0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label!=0 THEN 1 ELSE 0 END) AS fp FROM sc GROUP BY p0),
c AS (SELECT t, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tp) OVER () AS p, sum(fp) OVER () AS n, tp AS own, fp AS neg FROM h WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("q_roc", views(_ROC) + f"SELECT {rs('t', 9)} AS threshold, {rs('tp/p::double', 9)} AS tpr, {rs('fp/n::double', 9)} AS fpr FROM c UNION ALL SELECT NULL, 0.0::double, 0.0::double")
def q_roc(spark, sf):
    return quality.roc_curve(scored(spark, sf), "p_htautau", F.col("label") == 0).select(r("threshold", 9).alias("threshold"), r("tpr", 9).alias("tpr"), r("fpr", 9).alias("fpr"))


@query("q_auc", views(_ROC) + f"SELECT {rs('sum(neg::double*(tp - own/2.0::double))/(max(p)::double*max(n)::double)', 9)} AS auc FROM c")
def q_auc(spark, sf):
    return quality.auc(scored(spark, sf), "p_htautau", F.col("label") == 0).select(r("auc", 9).alias("auc"))


@query(
    "q_calibration_curve",
    views("s AS (SELECT min(p0) AS lo, max(p0) AS hi FROM sc)", "b AS (SELECT k AS bin, lo + k*((hi-lo)/10) AS a, CASE WHEN k=9 THEN hi ELSE lo + (k+1)*((hi-lo)/10) END AS b FROM s, range(10) t(k))")
    + f"SELECT CAST(bin AS INTEGER) AS bin, {rs('coalesce(sum(CASE WHEN label=0 THEN w ELSE 0 END)/sum(w) + 1e-16, 0)')} AS \"true\", {rs('coalesce(avg(p0), 0)')} AS pred FROM b LEFT JOIN sc ON p0 >= a AND p0 <= b.b GROUP BY bin",
)
def q_calibration_curve(spark, sf):
    rows = scored(spark, sf).select("p_htautau", (F.col("label") == 0).cast("int").alias("y"), "weight")
    return quality.calibration_curve(rows, "p_htautau", "y").select("bin", r("true").alias("true"), r("pred").alias("pred"))


_INTERVALS = "i AS (SELECT w AS mu_true, w - 0.02::double - (event_id % 7)/100.0::double AS mu_down, w - 0.02::double + (event_id % 11)/100.0::double AS mu_up, w + ((event_id % 5) - 2)/10.0::double AS mu_measured, event_id FROM ev)"


def _intervals(spark, sf):
    w, e = F.col("weight"), F.col("event_id")
    frac = lambda n, d: (e % n).cast("double") / F.lit(d)
    return events(spark, sf).select("event_id", w.alias("mu_true"), (w - F.lit(0.02) - frac(7, 100.0)).alias("mu_down"), (w - F.lit(0.02) + frac(11, 100.0)).alias("mu_up"), (w + (e % 5 - 2).cast("double") / F.lit(10.0)).alias("mu_measured"))


@query(
    "q_coverage_score",
    views(_INTERVALS, "a AS (SELECT avg(mu_up-mu_down) AS width, avg(CASE WHEN mu_true>mu_down AND mu_true<mu_up THEN 1.0::double ELSE 0.0::double END) AS coverage, sqrt((1-0.6827::double)*0.6827::double/count(*)) AS s FROM i)")
    + f"SELECT {rs('-ln((width+0.01::double)*CASE WHEN coverage < 0.6827-2*s THEN 1+power((coverage-(0.6827::double-2*s))/s, 4) WHEN coverage > 0.6827+2*s THEN 1+power((coverage-(0.6827::double+2*s))/s, 3) ELSE 1 END)', 5)} AS score, {rs('width')} AS width, {rs('coverage')} AS coverage FROM a",
)
def q_coverage_score(spark, sf):
    return quality.coverage_score(_intervals(spark, sf)).select(r("score", 5).alias("score"), r("width").alias("width"), r("coverage").alias("coverage"))


@query("q_closure", views(_INTERVALS) + f"SELECT event_id, {rs('mu_true-mu_measured')} AS residual FROM i")
def q_closure(spark, sf):
    return quality.closure(_intervals(spark, sf)).select("event_id", r("residual").alias("residual"))


@query("q_correlation", views() + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rs(f'corr({SQL_OF[a]}, {SQL_OF[b]})', 6)} AS correlation FROM ev" for a in _STANDARD for b in _STANDARD))
def q_correlation(spark, sf):
    e = events(spark, sf)
    cov = e.agg(*(F.covar_pop(a, b).alias(f"{a}__{b}") for a in _STANDARD for b in _STANDARD)).first()
    rho = quality.correlations([[cov[f"{a}__{b}"] for b in _STANDARD] for a in _STANDARD])
    return spark.createDataFrame([(a, b, round(rho[i][j], 6)) for i, a in enumerate(_STANDARD) for j, b in enumerate(_STANDARD)], "a string, b string, correlation double")


