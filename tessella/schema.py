"""Names, codes and constants of the event model."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import types as T

# Names of the features.
PRIMARY = (
    "PRI_lep_pt", "PRI_lep_eta", "PRI_lep_phi", "PRI_had_pt", "PRI_had_eta", "PRI_had_phi", "PRI_jet_leading_pt", "PRI_jet_leading_eta", "PRI_jet_leading_phi",
    "PRI_jet_subleading_pt", "PRI_jet_subleading_eta", "PRI_jet_subleading_phi", "PRI_n_jets", "PRI_jet_all_pt", "PRI_met", "PRI_met_phi",
)
DERIVED = (
    "DER_mass_transverse_met_lep", "DER_mass_vis", "DER_pt_h", "DER_deltaeta_jet_jet", "DER_mass_jet_jet", "DER_prodeta_jet_jet",
    "DER_deltar_had_lep", "DER_pt_tot", "DER_sum_pt", "DER_pt_ratio_lep_tau", "DER_met_phi_centrality", "DER_lep_eta_centrality",
)
FEATURES = PRIMARY + DERIVED

#: Event classes by code. An unknown class is UNKNOWN.
PROCESSES = ("htautau", "ztautau", "ttbar", "diboson")
CODE = {name: code for code, name in enumerate(PROCESSES)}
SIGNAL = CODE["htautau"]
UNKNOWN = -1
#: Stands for a quantity that an event does not have.
UNDEFINED = -25.0

EVENT_SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType())]
    + [T.StructField(f, T.IntegerType() if f == "PRI_n_jets" else T.DoubleType()) for f in FEATURES]
    + [T.StructField("weight", T.DoubleType()), T.StructField("label", T.IntegerType())]
)

# Mean and one standard deviation of the nuisance quantities.
ALPHA_MEAN = {"jes": 1.0, "tes": 1.0, "met": 0.0, "bkg": 1.0, "ttbar": 1.0, "diboson": 1.0}
ALPHA_SIGMA = {"jes": 0.01, "tes": 0.01, "met": 1.0, "bkg": 0.001, "ttbar": 0.02, "diboson": 0.25}

# Histogram binning, feature -> (bins, low, high).
BINNING = {
    "PRI_lep_pt": (20, 20.0, 400.0),
    "PRI_lep_eta": (20, -2.5, 2.5),
    "PRI_lep_phi": (20, -math.pi, math.pi),
    "PRI_had_pt": (20, 25.0, 400.0),
    "PRI_had_eta": (20, -3.0, 3.0),
    "PRI_had_phi": (20, -math.pi, math.pi),
    "PRI_jet_leading_pt": (20, 25.0, 400.0),
    "PRI_jet_leading_eta": (20, -5.0, 5.0),
    "PRI_jet_leading_phi": (20, -math.pi, math.pi),
    "PRI_jet_subleading_pt": (20, 25.0, 400.0),
    "PRI_jet_subleading_eta": (20, -5.0, 5.0),
    "PRI_jet_subleading_phi": (20, -math.pi, math.pi),
    "PRI_n_jets": (15, 0.0, 15.0),
    "PRI_jet_all_pt": (20, 0.0, 1000.0),
    "PRI_met": (20, 0.0, 300.0),
    "PRI_met_phi": (20, -math.pi, math.pi),
    "DER_mass_transverse_met_lep": (20, 0.0, 200.0),
    "DER_mass_vis": (20, 0.0, 500.0),
    "DER_pt_h": (20, 0.0, 600.0),
    "DER_deltaeta_jet_jet": (20, 0.0, 6.0),
    "DER_mass_jet_jet": (20, 0.0, 3000.0),
    "DER_prodeta_jet_jet": (20, -25.0, 25.0),
    "DER_deltar_had_lep": (20, 0.2, 6.2),
    "DER_pt_tot": (20, 0.0, 400.0),
    "DER_sum_pt": (20, 0.0, 1500.0),
    "DER_pt_ratio_lep_tau": (20, 0.0, 10.0),
    "DER_met_phi_centrality": (20, -math.sqrt(2), math.sqrt(2)),
    "DER_lep_eta_centrality": (20, 0.0, 1.0),
}

#: The shape nuisances, and the monomials up to second order in them.
SHAPES = ("nu_tes", "nu_jes", "nu_met")
MONOMIALS = tuple((a,) for a in SHAPES) + tuple((a, a) for a in SHAPES) + tuple(itertools.combinations(SHAPES, 2))
NORMS = ("nu_bkg", "nu_tt", "nu_diboson")
PARAMETERS = ("mu", *NORMS, *SHAPES)
NOMINAL = (0.0, 0.0, 0.0)
# Points (nu_tes, nu_jes, nu_met) at which yields and ratios are trained, the nominal one first.
BASE_POINTS = (
    (0.0, 0.0, 0.0), (-3.0, 0.0, 0.0), (-2.0, 0.0, 0.0), (-1.0, -1.0, 0.0), (-1.0, -1.0, 1.0),
    (-1.0, -1.0, 2.0), (-1.0, 0.0, 0.0), (-1.0, 0.0, 1.0), (-1.0, 0.0, 2.0), (-1.0, 1.0, 0.0),
    (-1.0, 1.0, 1.0), (-1.0, 1.0, 2.0), (0.0, -3.0, 0.0), (0.0, -2.0, 0.0), (0.0, -1.0, 0.0),
    (0.0, -1.0, 1.0), (0.0, -1.0, 2.0), (0.0, 0.0, 1.0), (0.0, 0.0, 2.0), (0.0, 1.0, 0.0),
    (0.0, 1.0, 1.0), (0.0, 1.0, 2.0), (0.0, 2.0, 0.0), (0.0, 3.0, 0.0), (1.0, -1.0, 0.0),
    (1.0, -1.0, 1.0), (1.0, -1.0, 2.0), (1.0, 0.0, 0.0), (1.0, 0.0, 1.0), (1.0, 0.0, 2.0),
    (1.0, 1.0, 0.0), (1.0, 1.0, 1.0), (1.0, 1.0, 2.0), (2.0, 0.0, 0.0), (3.0, 0.0, 0.0),
)

# Regions of the likelihood; Poisson regions with (selection, [(class, low, high) windows of class scores]).
UNBINNED_REGIONS = ("lowMT_VBFJet", "lowMT_noVBFJet_ptH100", "highMT_VBFJet")
POISSON_REGIONS = {
    "lowMT_noVBFJet_ptH0to100": ("lowMT_noVBFJet_ptH0to100", ()),
    "highMT_noVBFJet_ttbar": ("highMT_noVBFJet", (("ttbar", 0.4, 100.0),)),
    "highMT_noVBFJet_diboson": ("highMT_noVBFJet", (("ttbar", -100.0, 0.4), ("diboson", 0.5, 100.0))),
}
#: Relative size of one standard deviation of the normalisations.
RATE = {"nu_bkg": ALPHA_SIGMA["bkg"], "nu_tt": ALPHA_SIGMA["ttbar"], "nu_diboson": ALPHA_SIGMA["diboson"]}
