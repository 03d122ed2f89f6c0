"""Kinematics of events as Column expressions.

Every function returns a Column over the primary columns, so that Catalyst prunes and fuses what a query uses. Divisions are guarded,
since ANSI mode raises where IEEE arithmetic would give an infinity.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.schema import UNDEFINED

JET = {1: "PRI_jet_leading", 2: "PRI_jet_subleading"}
#: Added to a vanishing difference before it is divided by.
EPSILON = 1e-4


def has_jets(n: int) -> Column:
    return F.col("PRI_n_jets") >= n


def polar(name: str) -> dict[str, Column]:
    """px, py, pz and p of a massless particle with columns name_pt, name_eta, name_phi."""
    pt, eta, phi = (F.col(f"{name}_{x}") for x in ("pt", "eta", "phi"))
    return {"px": pt * F.cos(phi), "py": pt * F.sin(phi), "pz": pt * F.sinh(eta), "p": pt * F.cosh(eta)}


def momentum(name: str) -> dict[str, Column]:
    """The same, and 0 for a jet that an event does not have; met has px and py only."""
    if name == "met":
        return {"px": F.col("PRI_met") * F.cos("PRI_met_phi"), "py": F.col("PRI_met") * F.sin("PRI_met_phi")}
    number = next((k for k, v in JET.items() if v == name), None)
    out = polar(name)
    return out if number is None else {k: F.when(has_jets(number), v).otherwise(F.lit(0.0)) for k, v in out.items()}


def total(axis: str, *names: str) -> Column:
    return reduce(lambda a, b: a + b, (momentum(n)[axis] for n in names))


def length(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (p * p for p in parts)))


def clamped_root(x: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), x))


def delta_phi(a: Column, b: Column) -> Column:
    """Distance of two angles, 0 to pi."""
    return F.abs(F.pmod(a - b + F.lit(3 * math.pi), F.lit(2 * math.pi)) - F.lit(math.pi))


def sq(x: Column) -> Column:
    return x * x


def if_jets(n: int, value: Column) -> Column:
    return F.when(has_jets(n), value).otherwise(F.lit(UNDEFINED))


LEP, HAD, MET = "PRI_lep", "PRI_had", "met"


def mass_transverse_met_lep() -> Column:
    return clamped_root(sq(F.col("PRI_met") + F.col("PRI_lep_pt")) - sq(total("px", LEP, MET)) - sq(total("py", LEP, MET)))


def mass_vis() -> Column:
    """Not clamped: NaN where rounding makes the square negative."""
    return F.sqrt(sq(total("p", LEP, HAD)) - sq(total("px", LEP, HAD)) - sq(total("py", LEP, HAD)) - sq(total("pz", LEP, HAD)))


def pt_h() -> Column:
    return length(total("px", HAD, LEP, MET), total("py", HAD, LEP, MET))


def deltaeta_jet_jet() -> Column:
    return if_jets(2, F.abs(F.col(f"{JET[1]}_eta") - F.col(f"{JET[2]}_eta")))


def mass_jet_jet() -> Column:
    a, b = (polar(JET[k]) for k in (1, 2))
    return if_jets(2, clamped_root(sq(a["p"] + b["p"]) - sq(a["px"] + b["px"]) - sq(a["py"] + b["py"]) - sq(a["pz"] + b["pz"])))


def prodeta_jet_jet() -> Column:
    return if_jets(2, F.col(f"{JET[1]}_eta") * F.col(f"{JET[2]}_eta"))


def deltar_had_lep() -> Column:
    return length(F.col("PRI_had_eta") - F.col("PRI_lep_eta"), delta_phi(F.col("PRI_had_phi"), F.col("PRI_lep_phi")))


def pt_tot() -> Column:
    names = (HAD, LEP, MET, JET[1], JET[2])
    return length(total("px", *names), total("py", *names))


def sum_pt() -> Column:
    return F.col("PRI_had_pt") + F.col("PRI_lep_pt") + F.col("PRI_jet_all_pt")


def pt_ratio_lep_tau() -> Column:
    """NULL where the hadron has no transverse momentum."""
    return F.try_divide(F.col("PRI_lep_pt"), F.col("PRI_had_pt"))


def met_phi_centrality() -> Column:
    met, had = F.col("PRI_met_phi"), F.col("PRI_had_phi")

    def parts(lep: Column) -> tuple[Column, Column]:
        sign = F.signum(F.sin(had - lep))
        a, b = F.sin(met - lep) * sign, F.sin(had - met) * sign
        return a + b, F.sqrt(a * a + b * b)

    (top, base), (top_2, base_2) = parts(F.col("PRI_lep_phi")), parts(F.col("PRI_lep_phi") + F.lit(EPSILON))
    return F.when(base != 0, top / base).when(base_2 != 0, top_2 / base_2).otherwise(F.lit(UNDEFINED))


def lep_eta_centrality() -> Column:
    a, b = F.col(f"{JET[1]}_eta"), F.col(f"{JET[2]}_eta")
    gap = F.when(a - b == 0, F.lit(EPSILON)).otherwise(a - b)
    return if_jets(2, F.exp(F.lit(-4.0) / sq(gap) * sq(F.col("PRI_lep_eta") - (a + b) / 2)))


DERIVE = {
    "DER_mass_transverse_met_lep": mass_transverse_met_lep,
    "DER_mass_vis": mass_vis,
    "DER_pt_h": pt_h,
    "DER_deltaeta_jet_jet": deltaeta_jet_jet,
    "DER_mass_jet_jet": mass_jet_jet,
    "DER_prodeta_jet_jet": prodeta_jet_jet,
    "DER_deltar_had_lep": deltar_had_lep,
    "DER_pt_tot": pt_tot,
    "DER_sum_pt": sum_pt,
    "DER_pt_ratio_lep_tau": pt_ratio_lep_tau,
    "DER_met_phi_centrality": met_phi_centrality,
    "DER_lep_eta_centrality": lep_eta_centrality,
}


def with_derived(events: DataFrame, names: tuple[str, ...] = tuple(DERIVE), single_precision: bool = False) -> DataFrame:
    """events with the derived columns; single_precision rounds them as a 32-bit store would."""
    value = lambda n: DERIVE[n]().cast("float").cast("double") if single_precision else DERIVE[n]()
    return events.withColumns({n: value(n) for n in names})


class Vector4:
    """A four-momentum of Columns: px, py, pz, e."""

    def __init__(self, px: Column, py: Column, pz: Column, e: Column):
        self.px, self.py, self.pz, self.e = px, py, pz, e

    @classmethod
    def from_polar(cls, pt: Column, eta: Column, phi: Column, mass: Column | float = 0.0) -> Vector4:
        px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
        mass = mass if isinstance(mass, Column) else F.lit(float(mass))
        return cls(px, py, pz, F.sqrt(px * px + py * py + pz * pz + mass * mass))

    def __add__(self, other: Vector4) -> Vector4:
        return Vector4(self.px + other.px, self.py + other.py, self.pz + other.pz, self.e + other.e)

    @staticmethod
    def sum(parts: list[Vector4]) -> Vector4:
        return reduce(lambda a, b: a + b, parts)

    def pt(self) -> Column:
        return length(self.px, self.py)

    def p(self) -> Column:
        return length(self.px, self.py, self.pz)

    def mass(self) -> Column:
        """From the absolute value of the square."""
        return F.sqrt(F.abs(sq(self.e) - sq(self.px) - sq(self.py) - sq(self.pz)))

    def eta(self) -> Column:
        return F.when(self.pt() != 0, F.asinh(self.pz / F.nullif(self.pt(), F.lit(0.0))))

    def phi(self) -> Column:
        return F.atan2(self.py, self.px)

    def valid(self) -> Column:
        """Energy not below momentum, but for rounding."""
        return self.e + F.lit(1e-3) >= self.p()

    def scaled(self, k: Column | float) -> Vector4:
        k = k if isinstance(k, Column) else F.lit(float(k))
        return Vector4(self.px * k, self.py * k, self.pz * k, F.abs(self.e * k))

    def scaled_fixed_mass(self, k: Column | float) -> Vector4:
        k = k if isinstance(k, Column) else F.lit(float(k))
        px, py, pz = self.px * k, self.py * k, self.pz * k
        return Vector4(px, py, pz, F.sqrt(px * px + py * py + pz * pz + sq(self.mass())))

    def delta_phi(self, other: Vector4) -> Column:
        """Signed, -pi to pi."""
        return F.pmod(self.phi() - other.phi() + F.lit(3 * math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)

    def delta_eta(self, other: Vector4) -> Column:
        return self.eta() - other.eta()

    def delta_r(self, other: Vector4) -> Column:
        return length(self.delta_eta(other), self.delta_phi(other))
