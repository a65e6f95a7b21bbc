"""Fixed values.

Everything in this module is a constant that results depend on: indicator codes,
member lists, thresholds, labels and action texts.  Operators take all of them as
parameters; these are only the defaults.
"""

from __future__ import annotations

# --- Fixed values: indicator code -> panel column -------------------------------
INDICATORS = {
    "EN.GHG.CO2.MT.CE.AR5": "co2_emissions_mt",
    "EN.GHG.CO2.PC.CE.AR5": "co2_emissions_per_capita",
    "EN.GHG.CO2.TR.MT.CE.AR5": "co2_transport_mt",
    "EN.GHG.CO2.PI.MT.CE.AR5": "co2_power_industry_mt",
    "EN.GHG.CO2.BU.MT.CE.AR5": "co2_buildings_mt",
    "EN.GHG.CO2.IC.MT.CE.AR5": "co2_industrial_mt",
    "NY.GDP.MKTP.CD": "gdp_current_usd",
    "NY.GDP.PCAP.CD": "gdp_per_capita",
    "NY.GDP.MKTP.KD.ZG": "gdp_growth",
    "EG.USE.PCAP.KG.OE": "energy_use_per_capita",
    "EG.USE.ELEC.KH.PC": "electric_power_consumption",
    "EG.FEC.RNEW.ZS": "renewable_energy_pct",
    "EG.ELC.FOSL.ZS": "fossil_fuel_electricity_pct",
    "SP.POP.TOTL": "population",
    "SP.URB.TOTL.IN.ZS": "urban_pop_pct",
    "EN.POP.DNST": "population_density",
    "NV.IND.TOTL.ZS": "industry_value_added_pct",
    "NV.AGR.TOTL.ZS": "agriculture_value_added_pct",
    "NV.SRV.TOTL.ZS": "services_value_added_pct",
    "EG.ELC.ACCS.ZS": "access_to_electricity_pct",
    "AG.LND.FRST.ZS": "forest_area_pct",
}
START_YEAR, END_YEAR = 1990, 2024

# --- Fixed values: codes of aggregates that are not single entities -------------
AGGREGATE_MEMBERS = """
    WLD EUU ECS SSF MEA SAS EAS LCN NAC OED LDC HIC MIC LIC PST PRE AFE AFW ARB CEB
    CSS EAP EAR EMU ECA FCS HPC IBD IBT IDA IDB IDX LAC LMC LMY LTE MNA OGC OSS PSS
    SSA SST TEA TEC TLA TMN TSA TSS UMC INX
""".split()

# --- Fixed values: catalogue search terms ---------------------------------------
SEARCH_TERMS = ["CO2", "GDP", "energy", "population", "renewable"]

# --- Fixed values: gap filling --------------------------------------------------
INTERPOLATE_LIMIT, FORWARD_LIMIT, BACKWARD_LIMIT = 3, 2, 2
MAX_MISSING_SHARE = 0.5

# --- Fixed values: regression features and their categories ---------------------
REGRESSION_FEATURES = [
    "log_gdp", "gdp_per_capita", "gdp_growth",
    "log_population", "urban_pop_pct", "population_density",
    "energy_use_per_capita", "renewable_energy_pct", "fossil_fuel_electricity_pct",
    "industry_value_added_pct", "services_value_added_pct",
    "access_to_electricity_pct",
]
FEATURE_CATEGORIES = {
    "Economic": ["log_gdp", "gdp_per_capita", "gdp_growth"],
    "Demographic": ["log_population", "urban_pop_pct", "population_density"],
    "Energy": ["energy_use_per_capita", "renewable_energy_pct", "fossil_fuel_electricity_pct", "electric_power_consumption"],
    "Structural": ["industry_value_added_pct", "services_value_added_pct", "agriculture_value_added_pct"],
    "Development": ["access_to_electricity_pct", "forest_area_pct"],
}
REGRESSION_TARGET = "log_co2"
SPLIT_YEAR = 2017
RIDGE_ALPHAS = [0.001, 0.01, 0.1, 1, 10, 100, 1000]
RIDGE_FOLDS = 5
SHOCK = 1.10

# --- Fixed values: classification features --------------------------------------
OUTCOME_FEATURES = [
    "gdp_per_capita", "gdp_growth",
    "energy_use_per_capita", "renewable_energy_pct", "fossil_fuel_electricity_pct",
    "industry_value_added_pct", "services_value_added_pct",
    "urban_pop_pct", "population_density",
    "access_to_electricity_pct",
    "co2_emissions_mt", "co2_emissions_per_capita",
]
OUTCOME_LOG_FEATURES = ["gdp_per_capita", "co2_emissions_mt", "population_density", "energy_use_per_capita"]
REDUCTION_THRESHOLD = 0.10
HORIZON_YEARS = 10
EVIDENCE_SHARE = 0.7
TEST_SHARE = 0.25
SEED = 42

# --- Fixed values: bins (right-closed) ------------------------------------------
INCOME_EDGES = [0, 1000, 4000, 12000, float("inf")]
INCOME_LABELS = ["Low", "Lower-Middle", "Upper-Middle", "High"]
GRID_EDGES = [0, 20, 40, 60, 80, 100]
GRID_LABELS = ["Very Clean (0-20%)", "Clean (20-40%)", "Mixed (40-60%)", "Dirty (60-80%)", "Very Dirty (80-100%)"]
CLEAN_LABELS = ["Very Clean (0-20%)", "Clean (20-40%)"]
DIRTY_LABELS = ["Dirty (60-80%)", "Very Dirty (80-100%)"]

# --- Fixed values: scenario assumptions -----------------------------------------
ASSUMPTIONS = {
    "share": {"low": 0.40, "base": 0.45, "high": 0.50},
    "adoption": {"low": 0.30, "base": 0.50, "high": 0.70},
    "ref_per_km": {"low": 100.0, "base": 120.0, "high": 150.0},
    "use_per_km": {"low": 0.15, "base": 0.20, "high": 0.25},
}
INTENSITY_BASE, INTENSITY_PER_PCT = 50.0, 8.0
ADOPTION_TARGET = 0.50
OWNERSHIP_THRESHOLDS = [1000, 5000, 15000, 30000, 50000]
OWNERSHIP_VALUES = [20, 50, 200, 400, 600, 800]
OWNERSHIP_DEFAULT = 100
OWNERSHIP_REFERENCE = 200
ADOPTION_CLASSES = {
    "high": ["NOR", "ISL", "SWE", "DNK", "NLD", "FIN", "CHE"],
    "medium": ["DEU", "GBR", "FRA", "CHN", "USA", "CAN", "AUT", "BEL", "PRT", "IRL", "NZL", "AUS", "KOR"],
}
ADOPTION_RATES = {"high": 0.20, "medium": 0.08, "low": 0.02}

# --- Fixed values: prioritisation ------------------------------------------------
TOP_K = 15
POTENTIAL_WEIGHTS = {"fossil": 30, "renewable": 30, "intensity": 20, "size": 20}
POTENTIAL_MIN_SIZE = 10
QUICK_WIN_CHANGE, QUICK_WIN_MIN_SIZE = -0.05, 5
DOMINANT_SHARE_PCT, DOMINANT_TOP = 50, 5

# --- Fixed values: archetypes -----------------------------------------------------
ARCHETYPE_CUTS = {"renewable": 50, "high_income": 30000, "high_per_head": 10, "middle_income": 5000, "fossil": 70}
ARCHETYPES = [
    "Insufficient Data", "Clean Energy Leader", "High-Income High-Emitter", "High-Income Low-Emitter",
    "Middle-Income Fossil-Dependent", "Middle-Income Transitioning", "Low-Income",
]

# --- Fixed values: sector actions -------------------------------------------------
SECTOR_ACTIONS = {
    "transport": [
        "EV adoption incentives and charging infrastructure",
        "Public transit expansion and electrification",
        "Fuel efficiency standards for remaining ICE vehicles",
        "Urban planning to reduce vehicle dependence",
        "Rail freight development",
    ],
    "power_industry": [
        "Renewable energy capacity expansion (solar, wind)",
        "Coal-to-gas or coal-to-renewable switching",
        "Grid modernization and storage",
        "Carbon capture for remaining fossil plants",
        "Nuclear energy consideration",
    ],
    "buildings": [
        "Building efficiency standards and retrofits",
        "Heat pump adoption for heating/cooling",
        "Electric appliance standards",
        "District heating with renewable sources",
        "Smart building management systems",
    ],
    "industrial": [
        "Industrial process electrification",
        "Green hydrogen for high-heat processes",
        "Carbon capture for cement and steel",
        "Circular economy and material efficiency",
        "Energy efficiency requirements",
    ],
}

# --- Fixed values: archetype actions ----------------------------------------------
ARCHETYPE_ACTIONS = {
    "High-Income High-Emitter": [
        "Accelerate renewable deployment with ambitious targets",
        "Phase out coal power immediately, gas by 2035-2040",
        "Aggressive EV adoption targets (100% new sales by 2030-2035)",
        "Building electrification mandates",
        "Carbon pricing ($100+/ton)",
        "Lead international climate finance",
    ],
    "High-Income Low-Emitter": [
        "Maintain momentum on existing policies",
        "Address remaining hard-to-abate sectors",
        "Export clean technology and expertise",
        "Support international climate finance",
        "Achieve net-zero by 2040-2045",
    ],
    "Clean Energy Leader": [
        "Protect and expand renewable capacity",
        "Become regional clean energy hub",
        "Focus on transport and industry decarbonization",
        "Maintain forest carbon sinks",
        "Share expertise with neighbors",
    ],
    "Middle-Income Fossil-Dependent": [
        "Leapfrog to renewables (avoid new coal)",
        "International financing for clean energy transition",
        "Manage just transition for fossil fuel workers",
        "Develop domestic clean energy manufacturing",
        "Efficiency standards for rapid infrastructure build-out",
    ],
    "Middle-Income Transitioning": [
        "Accelerate existing clean energy momentum",
        "Peak emissions as soon as possible",
        "Industrial decarbonization roadmaps",
        "Clean transportation infrastructure",
        "Regional climate leadership",
    ],
    "Low-Income": [
        "Avoid carbon lock-in: skip fossil fuel era",
        "Deploy distributed renewables (solar mini-grids)",
        "International support for clean electrification",
        "Climate adaptation alongside mitigation",
        "Protect carbon sinks (forests, wetlands)",
    ],
}

# --- Fixed values: insight rules (feature, expected sign of the difference, text) --
INSIGHT_RULES = [
    ("gdp_per_capita", 1, "Higher GDP per capita", "$%,.0f vs $%,.0f"),
    ("renewable_energy_pct", 1, "Higher renewable energy share", "%.1f%% vs %.1f%%"),
    ("fossil_fuel_electricity_pct", -1, "Lower fossil fuel dependence", "%.1f%% vs %.1f%%"),
    ("services_value_added_pct", 1, "Larger services sector", "%.1f%% vs %.1f%%"),
]
