"""Fixed values.

Everything in this module is a value that must equal the analysed study's own
vocabulary for results to be right: unit constants, byte-exact unit spellings,
method vocabularies, conversion rules, study-specific corrections, label texts
and small literal dimensions.  They are stated plainly, in their natural order.
Spellings are byte exact: ``µ`` is the micro sign, ``μ`` the Greek mu,
``−`` the minus sign, ``–`` the en dash and ``\x02`` a control
character that ends one spelling.  Do not normalise them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: unit constants
# ---------------------------------------------------------------------------
MOL_TO_UMOL = 1e6
NMOL_TO_UMOL = 1e3
G_TO_MG = 1e3
MOLAR_MASS_CACO3 = 100.10
DAY_TO_HOUR = 24.0
HOUR_TO_MINUTE = 60.0
YEAR_TO_DAY = 365.25
M2_TO_CM2 = 1e4
CALCITE_DENSITY = 2.71
YEAR_TO_MONTH = 12.0
MM_TO_UM = 1e3
CM_TO_MM = 10.0

# ---------------------------------------------------------------------------
# FIXED VALUES: unit vocabularies
# ---------------------------------------------------------------------------
BIOMASS_UNITS = [
    "µmol/g/h", "nmoles g-1 dry weight min-l", "mgCaCO3 g-1 d-1", "mg g–1 d–1)", "g CaCO3/g/h",
    "ulmol CaCO3 g-1 h-", "umol C h -1 g -1\x02", "umol/g(dwt)/min", "umol_g_h", "µmol CaCO3/g/h",
    "mg CaCO3 mg-1 day-1.", "mg wet weight mg-1 day-1", "[myu]molCaCO3g^-1hr^-1", "umol CaCO3 gDW-1 h-1",
    "g per g (day-1)", "µmolC/g day", "µmol CaCO3/g/day",
    "Net Calcification (μmol CaCO3 g−1 DW  hr−1)",
    "Dark Net Calcification (μmol CaCO3 g−1 DW  hr−1)",
    "mgCaCO3 g-1 DW h-1", "[myu]molCaCO3gFW^-1hr^-1",
]

SURFACE_UNITS = [
    "mg/cm2/d", "Calcif in umol m-2 h-1", "mgCaCO3 cm-2 d-1", "CaCO3 [mg/cm**2/day]", "mg CaCO3 cm–2 d–1)",
    "umol CaCO3 cm-2 h-1", "mmol/cm**2/day", "mg cm-2 day-1", "micro mol CaCO3 cm-2 h-1", "µmol CaCO3/cm2/h",
    "mg/cm-2/year", "CaCO3 mg cm–2 d–1",
]

VOLUME_UNIT = "g CaCO3/cm3/year"

# Spellings folded into one canonical spelling per target.
CANONICAL_BIOMASS = "umol_g_h"
BIOMASS_TO_CANONICAL = [
    "µmol/g/h", "ulmol CaCO3 g-1 h-", "umol C h -1 g -1\x02", "umol_g_h", "µmol CaCO3/g/h",
    "[myu]molCaCO3g^-1hr^-1", "umol CaCO3 gDW-1 h-1",
    "Net Calcification (μmol CaCO3 g−1 DW  hr−1)",
    "Dark Net Calcification (μmol CaCO3 g−1 DW  hr−1)",
    "[myu]molCaCO3gFW^-1hr^-1",
]
CANONICAL_SURFACE = "mg_cm2_day"
SURFACE_TO_CANONICAL = [
    "mg/cm2/d", "mgCaCO3 cm-2 d-1", "CaCO3 [mg/cm**2/day]", "mg CaCO3 cm–2 d–1)", "mg cm-2 day-1",
    "CaCO3 mg cm–2 d–1",
]
CANONICAL_EXTENSION = "mm_year"
EXTENSION_TO_CANONICAL = ["mm y-1", "mm-year", "mm/year"]

# Units that are neither standardisable nor extension rates.
NON_STANDARD_EXCLUDED = [None, "um", "ugCaCO3", "1 hour incubations"]
NON_STANDARD_ALREADY_USED = ["umol CacO3 h-1", "g buoyant wt. yr-1", "mm2 42days-1", "mm per mm (day-1)"]

# ---------------------------------------------------------------------------
# FIXED VALUES: conversion rules, (canonical or raw unit, multiplier of the rate)
# ---------------------------------------------------------------------------
BIOMASS_RATE_RULES = [
    ("umol_g_h", 1.0),
    ("µmolC/g day", 1 / DAY_TO_HOUR),
    ("µmol CaCO3/g/day", 1 / DAY_TO_HOUR),
    ("umol/g(dwt)/min", HOUR_TO_MINUTE),
    ("nmoles g-1 dry weight min-l", HOUR_TO_MINUTE / NMOL_TO_UMOL),
    ("g CaCO3/g/h", 1 / MOLAR_MASS_CACO3 * MOL_TO_UMOL),
    ("mgCaCO3 g-1 DW h-1", 1 / MOLAR_MASS_CACO3 / G_TO_MG * MOL_TO_UMOL),
    ("mgCaCO3 g-1 d-1", 1 / MOLAR_MASS_CACO3 / G_TO_MG / DAY_TO_HOUR * MOL_TO_UMOL),
    ("mg g–1 d–1)", 1 / MOLAR_MASS_CACO3 / G_TO_MG / DAY_TO_HOUR * MOL_TO_UMOL),
    ("g per g (day-1)", 1 / MOLAR_MASS_CACO3 / DAY_TO_HOUR * MOL_TO_UMOL),
    ("mg CaCO3 mg-1 day-1.", 1 / MOLAR_MASS_CACO3 / DAY_TO_HOUR * MOL_TO_UMOL),
    ("mg wet weight mg-1 day-1", 1 / MOLAR_MASS_CACO3 / DAY_TO_HOUR * MOL_TO_UMOL),
]

SURFACE_RATE_RULES = [
    ("mg_cm2_day", 1.0),
    ("mg/cm-2/year", 1 / YEAR_TO_DAY),
    ("mmol/cm**2/day", MOLAR_MASS_CACO3),
    ("µmol CaCO3/cm2/h", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
    ("umol CaCO3 cm-2 h-1", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
    ("micro mol CaCO3 cm-2 h-1", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
    ("Calcif in umol m-2 h-1", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG / M2_TO_CM2),
]

VOLUME_RATE_RULES = [
    (VOLUME_UNIT, CALCITE_DENSITY / MOLAR_MASS_CACO3 * MOL_TO_UMOL / YEAR_TO_DAY / DAY_TO_HOUR),
]

EXTENSION_RATE_RULES = [
    ("mm_year", 1.0),
    ("mm d-1", YEAR_TO_DAY),
    ("mm/day", YEAR_TO_DAY),
    ("µm/day", YEAR_TO_DAY / MM_TO_UM),
    ("cm month-1", YEAR_TO_MONTH * CM_TO_MM),
    ("mm/4 months", 3.0),
]

# Rescued rows: one wide row, at most one non-null target.  The surface rule for
# "mg/cm-2/year" is 1 here (not 1/365.25 as in the main surface rules).
RESCUE_EXTENSION_RULES = [("mm_year", 1.0)]
RESCUE_SURFACE_RULES = [
    ("mg/cm-2/year", 1.0),
    ("µmol CaCO3/cm2/h", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
]
RESCUE_BIOMASS_RULES = [("nmol/gWW/min", 1 / NMOL_TO_UMOL * HOUR_TO_MINUTE)]

# Error rules, applied after the error text is made numeric.  Four rate rules have
# no error rule ("g CaCO3/g/h", "mg wet weight mg-1 day-1", "Calcif in umol m-2 h-1",
# "micro mol CaCO3 cm-2 h-1"), so their std_error is null.
ERROR_RULES = [
    ("nmoles g-1 dry weight min-l", 1 / NMOL_TO_UMOL * HOUR_TO_MINUTE),
    ("mgCaCO3 g-1 d-1", 1 / MOLAR_MASS_CACO3 / G_TO_MG / DAY_TO_HOUR * MOL_TO_UMOL),
    ("mg g–1 d–1)", 1 / MOLAR_MASS_CACO3 / G_TO_MG / DAY_TO_HOUR * MOL_TO_UMOL),
    ("umol_g_h", 1.0),
    ("umol/g(dwt)/min", HOUR_TO_MINUTE),
    ("mg CaCO3 mg-1 day-1.", 1 / MOLAR_MASS_CACO3 / DAY_TO_HOUR * MOL_TO_UMOL),
    ("g per g (day-1)", 1 / MOLAR_MASS_CACO3 / DAY_TO_HOUR * MOL_TO_UMOL),
    ("µmolC/g day", 1 / DAY_TO_HOUR),
    ("µmol CaCO3/g/day", 1 / DAY_TO_HOUR),
    ("mgCaCO3 g-1 DW h-1", 1 / MOLAR_MASS_CACO3 / G_TO_MG * MOL_TO_UMOL),
    ("g CaCO3/cm3/year", CALCITE_DENSITY / MOLAR_MASS_CACO3 * MOL_TO_UMOL / YEAR_TO_DAY / DAY_TO_HOUR),
    ("nmol/gWW/min", 1 / NMOL_TO_UMOL * HOUR_TO_MINUTE),
    ("mg_cm2_day", 1.0),
    ("umol CaCO3 cm-2 h-1", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
    ("mmol/cm**2/day", MOLAR_MASS_CACO3),
    ("µmol CaCO3/cm2/h", MOLAR_MASS_CACO3 / MOL_TO_UMOL * DAY_TO_HOUR * G_TO_MG),
    ("mg/cm-2/year", 1 / YEAR_TO_DAY),
    ("µm/day", YEAR_TO_DAY / MM_TO_UM),
    ("mm/day", YEAR_TO_DAY),
    ("cm month-1", YEAR_TO_MONTH * CM_TO_MM),
    ("mm d-1", YEAR_TO_DAY),
    ("mm_year", 1.0),
    ("mm/4 months", 3.0),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: method vocabulary (spelling -> family) and dropped methods
# ---------------------------------------------------------------------------
METHOD_FAMILIES = {
    "TA anomaly": ["TA", "TA anomaly", "TA anamoly Light calcification"],
    "Staining": ["Staining", "Calcofluor white", "alizarin red"],
    "Isotopes": ["45Ca", "Isotope/growth band", "13C"],
    "BW or RGR": ["BW", "RGR Wet weight", "change in total wieght", "Linear extension", "RGR (SA)",
                  "Relative growth rate", "length extension", "Area extension"],
}
DROPPED_METHODS = ["Net photosynthesis", "Photo", "Net respiration", "SOPHIE TO GET ?"]
NA_TEXT = "NA"

# ---------------------------------------------------------------------------
# FIXED VALUES: labels and small dimensions
# ---------------------------------------------------------------------------
STANDARDIZATION_BIOMASS = "Biomass – umol_g_h"
STANDARDIZATION_SURFACE = "Surface – mg_cm2_day"
STANDARDIZATION_EXTENSION = "Extension – mm_year"

ARTICULATE_GENERA = ["Bosiella", "Corallina", "Calliarthron", "Amphiroa", "Arthrocardia", "Ellisolandia", "Jania"]

# Yearly structural complexity multiplier.
COMPLEXITY = [(2005, 3.07), (2008, 2.73), (2009, 2.46), (2010, 1.75), (2011, 1.58), (2012, 2.21),
              (2013, 1.99), (2014, 2.52), (2015, 2.30), (2016, 3.87)]

CCA_GROUP = "Crustose Corallines"
CORAL_GROUP = "Coral"

# Rugosity ratios of the two coral growth forms (flat reef = 1).
R_BRANCHING = 2.97
R_MASSIVE = 1.54

QUANTILE_PROBS = [0.01, 0.25, 0.50, 0.75, 0.99]
GLOBAL_QUANTILE_PROBS = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]

# Rate rescales.
MG_DAY_TO_G_YEAR = YEAR_TO_DAY / 1000.0   # x / 1000 * 365.25
G_CM2_TO_KG_M2 = 10.0
SURFACE_TO_G_CM2_YEAR = 0.36525

MAD_SCALE = 1.4826

# ---------------------------------------------------------------------------
# FIXED VALUES: study-specific corrections of the review (keyed by study name)
# ---------------------------------------------------------------------------
BIOMASS_DAY_NOT_HOUR = ["Graba-Landry et al. 2018"]          # rate / 24
BIOMASS_EXCLUDED = ["Donham et al 2022", "Barner et al. 2018"]
SURFACE_EXCLUDED = ["Noisette et al. 2013 J phycol", "Burdett et al. 2018"]

# (column, value, studies)
BIOMASS_PATCHES = [
    ("method", "RGR", ["Narvarte et al. 2019", "Navarte et al 2020", "Sordo et al. 2018"]),
    ("method_family", "BW or RGR", ["Narvarte et al. 2019", "Navarte et al 2020", "Sordo et al. 2018"]),
    ("method", "Total alkalinity", ["Legrand et al 2019", "Qui-Minet et al. 2019"]),
    ("method_family", "TA anomaly", ["Legrand et al 2019", "Qui-Minet et al. 2019"]),
    ("climate", "Cool Temperate", ["Navarte et al 2020", "Noisette et al 2013 JEMBE", "Ragazzola et al 2020",
                                   "Schubert et al 2021", "Schubert et al. 2019", "Sordo et al 2020"]),
    ("climate", "Warm temperate", ["McGraw et al. 2010"]),
    ("climate", "Tropical", ["Wei et al 2020"]),
]

SURFACE_POSITIONAL = ("Johnson and Carpenter 2012", {"rate": [0.0059, 0.0062], "error": [0.0003, 0.00025]})
SURFACE_PRE_PATCHES = [("species", "Hydrolithon onkodes", ["Johnson and Carpenter 2012"])]
SURFACE_PATCHES = [
    ("method_family", "X-ray CT Scan", ["Schubert et al 2021"]),
    ("method_family", "BW or RGR", ["Tanaka et al. 2016"]),
    ("climate", "Cool Temperate", ["Schubert et al 2021", "Schubert et al 2022"]),
    ("climate", "Tropical", ["Tanaka et al. 2016"]),
    ("climate", "Polar", ["Westfield et al 2022"]),
    ("method", "X-ray CT Scan", ["Schubert et al 2021"]),
    ("method", "RGR", ["Tanaka et al. 2016"]),
]

VOLUME_FAMILY = "X-ray CT Scan"
VOLUME_PATCHES = [("climate", "Polar", ["Williams et al 2020"])]

EXTENSION_PATCHES = [
    ("climate", "Cool Temperate", ["McCoy and Ragazzola 2014", "Piazza et al 2022"]),
    ("method", "RGR", ["O'Leary et al. 2017"]),
    ("method_family", "BW or RGR", ["O'Leary et al. 2017"]),
]

RESCUE_TEMPERATURE_EXCLUDED = 31.95
RESCUE_STUDY_PATTERN_EXCLUDED = "Russel"
RESCUE_POSITIONAL = ("Vasquez-Elizondo and Enriquez 2016", {"error": [0.01, 0.02, 0.06]})
RESCUE_PATCHES = [
    ("method", "Total alkalinity", ["Vasquez-Elizondo and Enriquez 2016"]),
    ("method_family", "TA anomaly", ["Vasquez-Elizondo and Enriquez 2016"]),
    ("unit", "µmol CaCO3/cm2/h", ["Vasquez-Elizondo and Enriquez 2016"]),
    ("unit", "mm_year", ["Ragazzola et al. 2012", "Ragazzola et al. 2013"]),
    ("method", "Alizarin", ["Ragazzola et al. 2012", "Ragazzola et al. 2013"]),
    ("method_family", "Staining", ["Ragazzola et al. 2012", "Ragazzola et al. 2013"]),
    ("unit", "nmol/gWW/min", ["Semesi et al. 2009"]),
    ("method", "TA", ["Semesi et al. 2009"]),
    ("method_family", "TA anomaly", ["Semesi et al. 2009"]),
    ("unit", "mg/cm-2/year", ["Short et al. 2014"]),
    ("method", "BW", ["Short et al. 2014"]),
    ("method_family", "BW or RGR", ["Short et al. 2014"]),
    ("species", "Hydrolithon sp.", ["Short et al. 2014"]),
]

# Late corrections on the unified table.
CLIMATE_RECODE = ("Cool Temperate", "Cool temperate")
GROWTH_PATCHES = [("genus", "Lithothamnion", ["Ragazzola et al. 2012", "Ragazzola et al. 2013"])]
BIOMASS_GENUS_CLIMATE_FIX = ("Arthrocardia", "Cool temperate")

# Studies left out of the review panels and the biomass model frame.
PANEL_EXCLUDED_STUDIES = ["Graba-Landry et al. 2018", "Johnson et al 2019"]
HALIMEDA = "Halimeda"

# Category orders of the panel legends, and axis limits of the panels.
PANEL_CLIMATE_ORDER = ["Tropical", "Warm temperate", "Cool temperate", "Polar"]
PANEL_METHOD_ORDER = ["Isotopes", "BW or RGR", "TA anomaly", "X-ray CT Scan"]
PANEL_BIOMASS_LIMITS = (0.0, 30.0)
PANEL_SURFACE_LIMITS = (0.0, 1.2)
