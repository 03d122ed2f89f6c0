"""Named selections: conjunctions of predicates on four columns.

Predicates treat NaN as IEEE comparisons do, and are plain Columns, so they reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import above, below
from tessella.schema import CODE

MT, PT_H, JET1, JET2 = "DER_mass_transverse_met_lep", "DER_pt_h", "PRI_jet_leading_pt", "PRI_jet_subleading_pt"


def _vbf() -> Column:
    return above(F.col(JET1), 50.0) & above(F.col(JET2), 30.0)


def _window(low: float | None, high: float | None) -> Column:
    parts = ([] if low is None else [above(F.col(PT_H), low, True)]) + ([] if high is None else [below(F.col(PT_H), high)])
    return reduce(lambda a, b: a & b, parts)


ATOMS = {
    "inclusive": lambda: F.lit(True),
    "lowMT": lambda: below(F.col(MT), 70.0),
    "highMT": lambda: above(F.col(MT), 70.0, True),
    "VBFJet": _vbf,
    "noVBFJet": lambda: ~_vbf(),
    "ptH0to50": lambda: _window(None, 50.0),
    "ptH0to100": lambda: _window(None, 100.0),
    "ptH50to100": lambda: _window(50.0, 100.0),
    "ptH100to200": lambda: _window(100.0, 200.0),
    "ptH100": lambda: _window(100.0, None),
    "ptH200": lambda: _window(200.0, None),
}
# Names of the composite selections.
COMPOSITES = (
    "lowMT_VBFJet", "highMT_VBFJet", "highMT_noVBFJet", "lowMT_noVBFJet_ptH0to100", "lowMT_noVBFJet_ptH100", "highMT_noVBFJet_ptH0to100",
    "highMT_noVBFJet_ptH100", "lowMT_noVBFJet_ptH100to200", "lowMT_noVBFJet_ptH200", "highMT_noVBFJet_ptH100to200", "highMT_noVBFJet_ptH200",
    "noVBFJet_ptH0to100", "noVBFJet_ptH50to100", "noVBFJet_ptH100to200", "noVBFJet_ptH100", "noVBFJet_ptH200",
)
#: Regions that share no event and together hold all.
EXCLUSIVE = tuple(f"{mt}_{rest}" for mt in ("lowMT", "highMT") for rest in ("VBFJet", "noVBFJet_ptH0to100", "noVBFJet_ptH100to200", "noVBFJet_ptH200"))


def list_selections() -> list[str]:
    return sorted({*ATOMS, *COMPOSITES})


def predicate(name: str) -> Column:
    """The conjunction that a name stands for: atoms joined by underscores."""
    unknown = [part for part in name.split("_") if part not in ATOMS]
    if unknown:
        raise KeyError(f"unknown selection {name}: no {', '.join(unknown)} in {sorted(ATOMS)}")
    return reduce(lambda a, b: a & b, (ATOMS[part]() for part in name.split("_")))


def select_region(events: DataFrame, name: str) -> DataFrame:
    return events.where(predicate(name))


def explode_regions(events: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row for each region that an event is in, with column region: one scan for all regions."""
    inside = F.array_compact(F.array(*(F.when(predicate(n), F.lit(n)) for n in names)))
    return events.withColumn("region", F.explode(inside))


def process_filter(events: DataFrame, process: str) -> DataFrame:
    return events.where(F.col("label") == CODE[process])


def score_window(process: str, low: float, high: float) -> Column:
    """low <= score < high for the class score column p_process."""
    return above(F.col(f"p_{process}"), low, True) & below(F.col(f"p_{process}"), high)


SCORE_SELECTIONS = {
    "ttbar": lambda: above(F.col("p_ttbar"), 0.4),
    "diboson": lambda: below(F.col("p_ttbar"), 0.4, True) & above(F.col("p_diboson"), 0.5),
}


def class_subset(events: DataFrame, processes: tuple[str, ...]) -> DataFrame:
    """Events of the named classes, relabelled by their position among them."""
    codes = [CODE[p] for p in processes]
    label = F.array_position(F.array(*map(F.lit, codes)), F.col("label")) - 1
    return events.where(F.col("label").isin(codes)).withColumn("label", label.cast("int"))


def one_hot(events: DataFrame, processes: tuple[str, ...] = tuple(CODE)) -> DataFrame:
    return events.withColumns({f"is_{p}": (F.col("label") == CODE[p]).cast("int") for p in processes})
