"""Systematic variations of primary events: energy scales, soft missing momentum, thresholds, normalisations.

All steps are projections and filters in this order: normalise weights, vary, cut, derive. They add no
shuffle. Branches of variations that are switched off are not built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.kinematics import DERIVE, JET, Vector4, has_jets, momentum, with_derived
from tessella.functions.numeric import above, half_even, keyed_uniform
from tessella.schema import ALPHA_MEAN, ALPHA_SIGMA, CODE, PRIMARY, UNDEFINED

LEP_PT, JET_PT, HAD_PT = 20.0, 26.0, 26.0
#: The pseudorapidity of a subleading jet counts up to this for its momentum.
ETA_LIMIT = 10.0
# The features that are rounded.
ROUNDED = (
    "PRI_lep_pt", "PRI_lep_eta", "PRI_lep_phi", "PRI_had_pt", "PRI_had_eta", "PRI_had_phi", "PRI_jet_leading_pt", "PRI_jet_leading_eta", "PRI_jet_leading_phi",
    "PRI_jet_subleading_pt", "PRI_jet_subleading_eta", "PRI_jet_subleading_phi", "PRI_jet_all_pt", "PRI_met", "PRI_met_phi",
)


@dataclass(frozen=True)
class Shift:
    """A systematic variation. Arguments go by name only: they are easily mistaken for each other."""

    tes: float = 1.0
    jes: float = 1.0
    soft_met: float = 0.0
    ttbar_scale: float | None = None
    diboson_scale: float | None = None
    bkg_scale: float | None = None
    seed: int = 31415
    #: Names the column that says which draw of the soft term an event gets; without it the event's primary columns do.
    key: str | None = None


def alpha_to_nu(alpha: Column, which: str) -> Column:
    return (alpha - ALPHA_MEAN[which]) / ALPHA_SIGMA[which]


def nu_to_alpha(nu: Column, which: str) -> Column:
    return nu * ALPHA_SIGMA[which] + ALPHA_MEAN[which]


def scale_weights(events: DataFrame, ttbar: float | None = None, diboson: float | None = None, background: float | None = None) -> DataFrame:
    """Weights of ttbar, of diboson, and of all that is not signal, scaled one after another."""
    factor = F.lit(1.0)
    for scale, rows in ((ttbar, F.col("label") == CODE["ttbar"]), (diboson, F.col("label") == CODE["diboson"]), (background, F.col("label") != CODE["htautau"])):
        if scale is not None:
            factor = factor * F.when(rows, F.lit(float(scale))).otherwise(F.lit(1.0))
    return events.withColumn("weight", F.col("weight") * factor)


def vary(events: DataFrame, shift: Shift) -> DataFrame:
    """Energy scales of the hadron and the jets, with the missing momentum that balances them; then all rounded to 3 digits.

    A jet counts by PRI_n_jets; PRI_jet_all_pt is scaled always.
    """
    px, py = momentum("met")["px"], momentum("met")["py"]
    scaled: dict[str, Column] = {}
    if shift.tes != 1.0:
        had, k = momentum("PRI_had"), (1 - shift.tes) / shift.tes
        scaled["PRI_had_pt"] = F.col("PRI_had_pt") * shift.tes
        px, py = px + had["px"] * shift.tes * k, py + had["py"] * shift.tes * k
    if shift.jes != 1.0:
        k = (1 - shift.jes) / shift.jes
        for n, jet in JET.items():
            pt = F.col(f"{jet}_pt")
            scaled[f"{jet}_pt"] = F.when(has_jets(n), pt * shift.jes).otherwise(pt)
            at = lambda f, n=n, jet=jet: F.when(has_jets(n), F.col(f"{jet}_pt") * shift.jes * f(F.col(f"{jet}_phi"))).otherwise(F.lit(0.0))
            px, py = px + at(F.cos) * k, py + at(F.sin) * k
        scaled["PRI_jet_all_pt"] = F.col("PRI_jet_all_pt") * shift.jes
    if shift.soft_met > 0:
        x, y = keyed_normals(F.col(shift.key) if shift.key else F.xxhash64(*PRIMARY), shift.seed)
        px, py = px + x * shift.soft_met, py + y * shift.soft_met
    moved = events.withColumns({**scaled, "__px": px, "__py": py})
    moved = moved.withColumns({"PRI_met": F.hypot("__px", "__py"), "PRI_met_phi": F.atan2("__py", "__px")}).drop("__px", "__py")
    return moved.withColumns({c: half_even(F.col(c)) for c in ROUNDED})


def keyed_normals(key: Column, seed: int) -> tuple[Column, Column]:
    """Two independent standard normal numbers of a key: the same wherever and however often they are drawn."""
    reach, angle = F.sqrt(-2.0 * F.log(keyed_uniform(key, seed) + F.lit(2.0**-53))), 2.0 * F.pi() * keyed_uniform(key, seed, 1)
    return reach * F.cos(angle), reach * F.sin(angle)


def subleading_momentum() -> Vector4:
    """The subleading jet's momentum, pseudorapidity limited."""
    jet = JET[2]
    return Vector4.from_polar(F.col(f"{jet}_pt"), F.greatest(F.least(F.col(f"{jet}_eta"), F.lit(ETA_LIMIT)), F.lit(-ETA_LIMIT)), F.col(f"{jet}_phi"))


def hadron_cut(mode: str = "documented") -> Column:
    """documented: more than HAD_PT stays. literal: the opposite cut, which drops HAD_PT and more (a NaN stays)."""
    pt = F.col("PRI_had_pt")
    if mode == "documented":
        return above(pt, HAD_PT)
    if mode == "literal":
        return ~above(pt, HAD_PT, True)
    raise ValueError(f"unknown mode {mode}")


def apply_thresholds(events: DataFrame, mode: str = "documented") -> DataFrame:
    """Hadron cut, soft jets removed (the subleading before the leading one), lepton cut."""
    out = events.where(hadron_cut(mode))
    for n in (2, 1):
        jet = JET[n]
        soft = F.col(f"{jet}_pt").between(0.0, JET_PT)
        out = out.withColumn("__soft", soft).withColumns(
            {
                "PRI_jet_all_pt": F.when(F.col("__soft"), F.col("PRI_jet_all_pt") - F.col(f"{jet}_pt")).otherwise(F.col("PRI_jet_all_pt")),
                "PRI_n_jets": F.when(F.col("__soft"), F.col("PRI_n_jets") - 1).otherwise(F.col("PRI_n_jets")),
                **{f"{jet}_{x}": F.when(F.col("__soft"), F.lit(UNDEFINED)).otherwise(F.col(f"{jet}_{x}")) for x in ("pt", "eta", "phi")},
            }
        )
    return out.drop("__soft").where(above(F.col("PRI_lep_pt"), LEP_PT, True))


def systematic_events(events: DataFrame, shift: Shift = Shift(), mode: str = "documented", thresholds: bool = True, derived: tuple[str, ...] = tuple(DERIVE), single_precision: bool = False) -> DataFrame:
    """The whole treatment: weights, variation, thresholds, derived columns."""
    out = vary(scale_weights(events, shift.ttbar_scale, shift.diboson_scale, shift.bkg_scale), shift)
    return with_derived(apply_thresholds(out, mode) if thresholds else out, derived, single_precision)


def unit_weight_events(events: DataFrame, shift: Shift = Shift(), mode: str = "documented") -> DataFrame:
    """The same for events of weight 1."""
    return systematic_events(events.withColumn("weight", F.lit(1.0)), shift, mode)
