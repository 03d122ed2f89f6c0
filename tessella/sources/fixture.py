"""Synthetic events out of the driver's tables, the same in Spark and in SQL. Arbitrary numbers for testing arithmetic, no physics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schema import FEATURES, PROCESSES, UNDEFINED


def collision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary columns, weight and label of one event for each line item. event_id numbers order lines and can repeat. A narrow step."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    grid = lambda key, n, origin: (c(key) % n).cast("double") / F.lit(10.0) + F.lit(origin)
    jets = (c("l_linenumber") % 4).cast("int")
    hard = F.lit(20.0) + c("l_extendedprice") / F.lit(400.0)
    soft = F.least(hard, F.lit(10.0) + c("l_quantity") * F.lit(0.8))
    given = lambda n, v, other=UNDEFINED: F.when(jets >= n, v).otherwise(F.lit(other))
    return t.select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("event_id"),
        (F.lit(15.0) + c("l_quantity")).alias("PRI_lep_pt"),
        grid("l_partkey", 50, -2.45).alias("PRI_lep_eta"),
        grid("l_suppkey", 62, -3.05).alias("PRI_lep_phi"),
        (F.lit(20.0) + (c("l_partkey") % 40).cast("double") * F.lit(1.5)).alias("PRI_had_pt"),
        grid("l_orderkey", 46, -2.25).alias("PRI_had_eta"),
        grid("l_partkey", 61, -3.0).alias("PRI_had_phi"),
        given(1, hard).alias("PRI_jet_leading_pt"),
        given(1, grid("l_orderkey", 90, -4.45)).alias("PRI_jet_leading_eta"),
        given(1, grid("l_orderkey", 61, -3.0)).alias("PRI_jet_leading_phi"),
        given(2, soft).alias("PRI_jet_subleading_pt"),
        given(2, grid("l_partkey", 90, -4.45)).alias("PRI_jet_subleading_eta"),
        given(2, grid("l_suppkey", 61, -3.0)).alias("PRI_jet_subleading_phi"),
        jets.alias("PRI_n_jets"),
        (given(1, hard, 0.0) + given(2, soft, 0.0)).alias("PRI_jet_all_pt"),
        (F.lit(5.0) + c("l_discount") * F.lit(1500.0)).alias("PRI_met"),
        grid("l_orderkey", 63, -3.1).alias("PRI_met_phi"),
        (F.lit(0.5) + c("l_discount") + c("l_tax")).alias("weight"),
        ((c("l_orderkey") + c("l_linenumber")) % 4).cast("int").alias("label"),
    )


def with_scores(events: DataFrame) -> DataFrame:
    """Class scores p_<process> and ratio coefficients d_<process>, by arithmetic on event_id."""
    raw = [(1 + (F.col("event_id") + 7 * c) % 11).cast("double") for c in range(4)]
    every = raw[0] + raw[1] + raw[2] + raw[3]
    delta: dict[str, Column] = {f"d_{p}": F.array(*((((F.col("event_id") + 3 * i + k) % 5) - 2).cast("double") * F.lit(0.01) for k in range(9))) for i, p in enumerate(PROCESSES)}
    return events.withColumns({f"p_{p}": raw[i] / every for i, p in enumerate(PROCESSES)} | delta)


#: Log-polynomial of the synthetic yields, by monomial: tes, jes, met, tes2, jes2, met2, tes jes, tes met, jes met.
LOG_YIELD = [0.010, -0.020, 0.003, 0.0, 0.0, 0.0, 0.0001, 0.0, 0.0]

_ev = """
select l_orderkey*8+l_linenumber as event_id, 15.0::double+l_quantity as lep_pt, (l_partkey%50)::double/10.0::double + (-2.45)::double as lep_eta,
 (l_suppkey%62)::double/10.0::double + (-3.05)::double as lep_phi, 20.0::double+(l_partkey%40)::double*1.5::double as had_pt,
 (l_orderkey%46)::double/10.0::double + (-2.25)::double as had_eta, (l_partkey%61)::double/10.0::double + (-3.0)::double as had_phi,
 case when l_linenumber%4>=1 then 20.0::double+l_extendedprice/400.0::double else -25.0::double end as j1_pt,
 case when l_linenumber%4>=1 then (l_orderkey%90)::double/10.0::double + (-4.45)::double else -25.0::double end as j1_eta,
 case when l_linenumber%4>=1 then (l_orderkey%61)::double/10.0::double + (-3.0)::double else -25.0::double end as j1_phi,
 case when l_linenumber%4>=2 then least(20.0::double+l_extendedprice/400.0::double, 10.0::double+l_quantity*0.8::double) else -25.0::double end as j2_pt,
 case when l_linenumber%4>=2 then (l_partkey%90)::double/10.0::double + (-4.45)::double else -25.0::double end as j2_eta,
 case when l_linenumber%4>=2 then (l_suppkey%61)::double/10.0::double + (-3.0)::double else -25.0::double end as j2_phi,
 (l_linenumber%4)::int as nj,
 case when l_linenumber%4>=1 then 20.0::double+l_extendedprice/400.0::double else 0.0::double end
  + case when l_linenumber%4>=2 then least(20.0::double+l_extendedprice/400.0::double, 10.0::double+l_quantity*0.8::double) else 0.0::double end as all_pt,
 5.0::double+l_discount*1500.0::double as met, (l_orderkey%63)::double/10.0::double + (-3.1)::double as met_phi,
 0.5::double+l_discount+l_tax as w, ((l_orderkey+l_linenumber)%4)::int as label
from lineitem"""

_mom = """
select *, had_pt*cos(had_phi) as hx, had_pt*sin(had_phi) as hy, had_pt*sinh(had_eta) as hz, had_pt*cosh(had_eta) as hp,
 lep_pt*cos(lep_phi) as lx, lep_pt*sin(lep_phi) as ly, lep_pt*sinh(lep_eta) as lz, lep_pt*cosh(lep_eta) as lp, met*cos(met_phi) as mx, met*sin(met_phi) as my,
 case when nj>=1 then j1_pt*cos(j1_phi) else 0.0::double end as ax, case when nj>=1 then j1_pt*sin(j1_phi) else 0.0::double end as ay,
 case when nj>=1 then j1_pt*sinh(j1_eta) else 0.0::double end as az, case when nj>=1 then j1_pt*cosh(j1_eta) else 0.0::double end as ap,
 case when nj>=2 then j2_pt*cos(j2_phi) else 0.0::double end as bx, case when nj>=2 then j2_pt*sin(j2_phi) else 0.0::double end as by_,
 case when nj>=2 then j2_pt*sinh(j2_eta) else 0.0::double end as bz, case when nj>=2 then j2_pt*cosh(j2_eta) else 0.0::double end as bp
from {src}"""

_der = """
select *, sqrt(greatest(0.0::double, (met+lep_pt)*(met+lep_pt)-(lx+mx)*(lx+mx)-(ly+my)*(ly+my))) as mt,
 case when (lp+hp)*(lp+hp)-(lx+hx)*(lx+hx)-(ly+hy)*(ly+hy)-(lz+hz)*(lz+hz) < 0 then 'nan'::double else sqrt(abs((lp+hp)*(lp+hp)-(lx+hx)*(lx+hx)-(ly+hy)*(ly+hy)-(lz+hz)*(lz+hz))) end as mass_vis,
 sqrt((hx+lx+mx)*(hx+lx+mx)+(hy+ly+my)*(hy+ly+my)) as pt_h,
 case when nj>=2 then abs(j1_eta-j2_eta) else -25.0::double end as deta_jj,
 case when nj>=2 then sqrt(greatest(0.0::double, (ap+bp)*(ap+bp)-(ax+bx)*(ax+bx)-(ay+by_)*(ay+by_)-(az+bz)*(az+bz))) else -25.0::double end as mass_jj,
 case when nj>=2 then j1_eta*j2_eta else -25.0::double end as prodeta,
 sqrt((had_eta-lep_eta)*(had_eta-lep_eta) + power(abs((had_phi-lep_phi+3*pi()) - 2*pi()*floor((had_phi-lep_phi+3*pi())/(2*pi())) - pi()), 2)) as deltar,
 sqrt(power(hx+lx+mx+ax+bx,2)+power(hy+ly+my+ay+by_,2)) as pt_tot, had_pt+lep_pt+all_pt as sum_pt,
 case when had_pt!=0 then lep_pt/had_pt end as ratio,
 case when nj>=2 then exp(-4.0::double/power(case when j1_eta-j2_eta=0 then 0.0001::double else j1_eta-j2_eta end,2)*power(lep_eta-(j1_eta+j2_eta)/2,2)) else -25.0::double end as lep_c
from {src}"""

_cent = """
select *, case when d0!=0 then t0/d0 when d1!=0 then t1/d1 else -25.0::double end as met_c from (
 select *, sin(met_phi-lep_phi)*sign(sin(had_phi-lep_phi))+sin(had_phi-met_phi)*sign(sin(had_phi-lep_phi)) as t0,
  sqrt(power(sin(met_phi-lep_phi)*sign(sin(had_phi-lep_phi)),2)+power(sin(had_phi-met_phi)*sign(sin(had_phi-lep_phi)),2)) as d0,
  sin(met_phi-lep_phi-0.0001::double)*sign(sin(had_phi-lep_phi-0.0001::double))+sin(had_phi-met_phi)*sign(sin(had_phi-lep_phi-0.0001::double)) as t1,
  sqrt(power(sin(met_phi-lep_phi-0.0001::double)*sign(sin(had_phi-lep_phi-0.0001::double)),2)+power(sin(had_phi-met_phi)*sign(sin(had_phi-lep_phi-0.0001::double)),2)) as d1
 from {src})"""

_scored = (
    "select *, "
    + ", ".join(f"s{c}/(s0+s1+s2+s3) as p{c}" for c in range(4))
    + " from (select *, "
    + ", ".join(f"(1+(event_id+{7 * c})%11)::double as s{c}" for c in range(4))
    + ", "
    + ", ".join(f"(((event_id+{3 * p + k})%5)-2)::double*0.01::double as d{p}{k}" for p in range(4) for k in range(9))
    + " from {src})"
)


def views(*extra: str) -> str:
    """WITH clause of the SQL side: ev (primary), mo (momenta), de (derived), ce (centralities), sc (scores), and extra "name AS (...)"."""
    parts = [f"ev AS ({_ev})", f"mo AS ({_mom.format(src='ev')})", f"de AS ({_der.format(src='mo')})", f"ce AS ({_cent.format(src='de')})", f"sc AS ({_scored.format(src='de')})", *extra]
    return "WITH " + ",\n".join(parts) + "\n"


def momenta_sql(src: str) -> str:
    return _mom.format(src=src)


def derived_sql(src: str) -> str:
    return _der.format(src=src)


def centralities_sql(src: str) -> str:
    return _cent.format(src=src)


#: Features by the names that the SQL side gives them.
SQL_NAMES = dict(
    zip(
        ("lep_pt", "lep_eta", "lep_phi", "had_pt", "had_eta", "had_phi", "j1_pt", "j1_eta", "j1_phi", "j2_pt", "j2_eta", "j2_phi", "nj", "all_pt", "met", "met_phi",
         "mt", "mass_vis", "pt_h", "deta_jj", "mass_jj", "prodeta", "deltar", "pt_tot", "sum_pt", "ratio", "met_c", "lep_c"),
        FEATURES,
        strict=True,
    )
)
