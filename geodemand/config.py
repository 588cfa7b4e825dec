"""Fixed values of the demand model: priors, coefficients and cuts. Parameters, not logic."""

FACTORS = ["F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F10"]

# Prior weight of each factor, and what a category changes of it.
PRIOR = {
    "F1": 0.18, "F2": 0.08, "F3": 0.22, "F4": 0.13, "F5": 0.11,
    "F6": 0.12, "F7": 0.06, "F8": -0.05, "F9": 0.05, "F10": 0.10,
}
# Assumptions of this model for the product types of the given tables; callers pass their own.
PRIOR_BY_CATEGORY = {
    "ECONOMY": {"F1": 0.24, "F10": 0.12},
    "PROMO": {"F5": 0.20, "F8": -0.08},
    "STANDARD": {"F4": 0.21, "F9": 0.07},
}
PRIOR_BY_PRODUCT = {"Brand#1:PROMO": {"F5": 0.25, "F6": 0.15}}
WEIGHT_MIN, WEIGHT_MAX = -0.25, 0.45

# Sub-factors of each factor: feature, weight, direction. A feature that is not there is left
# out and the weights of the others are scaled up. Weights are assumptions of this model.
SUBFACTORS = {
    "F1": [("income_per_ha", 0.6, "positive"), ("credit_depth", 0.4, "positive")],
    "F2": [("avg_holding_ha", 0.5, "positive"), ("holding_gini", 0.5, "negative")],
    "F3": [("tractor_density", 0.7, "positive"), ("mean_hp", 0.3, "positive")],
    "F4": [("farm_power_kw_ha", 0.5, "positive"), ("labour_scarcity", 0.3, "positive"), ("wage_level", 0.2, "positive")],
    "F5": [("high_value_share", 0.5, "positive"), ("crop_entropy", 0.3, "positive"), ("cropping_intensity", 0.2, "positive")],
    "F6": [("fpo_density", 1.0, "positive")],
    "F7": [("irrigation_reliability", 0.7, "positive"), ("rainfall_departure", 0.3, "positive")],
    "F8": [("chc_density", 1.0, "dual")],
    "F9": [("digital_access", 0.5, "positive"), ("precision_adoption", 0.5, "positive")],
    "F10": [("dealer_accessibility", 0.5, "positive"), ("service_density", 0.5, "positive")],
}

# Which factor a panel regressor speaks for, and the sign it should have.
REGRESSOR_FACTOR = {"x1": "F1", "x2": "F7", "x3": "F4", "x4": "F1"}
REGRESSOR_SIGN = {"x1": "positive", "x2": "positive", "x3": "positive", "x4": "negative"}

# Distances: kilometres per degree, reach of a dealer, decay of access.
KM_LON, KM_LAT = 95.0, 111.0
MAX_DEALER_KM = 65.0
DECAY_KM = 18.0

# Choice model.
BRAND_WEIGHT, FIT_WEIGHT = 1.1, 1.9
PRICE_SENSITIVITY, DISTANCE_SENSITIVITY = -2.4, -0.055
OVERLAP_CUT, DISPLACEMENT_CUT, CAPTURE_RATE = 0.35, 0.55, 0.45

# Share of each product type that a new player finds taken: an assumption, one step per type in alphabetical order.
INCUMBENCY = {t: round(0.60 + 0.05 * i, 2) for i, t in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))}
HEADWIND_DEFAULT = 0.75

# Demand.
ANNUAL_CONVERSION = 0.09
LIFE_YEARS = 10.0
TIER_SCORE = {0: 1.0, 1: 0.6, 2: 0.28, 3: 0.6, 4: 0.28}

# Names of the four action quadrants, by headroom and by nearness of a dealer.
ACTIONS = {("high", "near"): "Convert now", ("high", "far"): "Build access", ("low", "near"): "Defend", ("low", "far"): "Monitor"}

# Features in which a place is set against its peers; they are called by their column names.
PEER_FEATURES = (
    "attach_rate", "avg_holding_ha", "chc_density", "credit_depth", "dealer_accessibility", "farm_power_kw_ha", "income_per_ha", "irrigation_ratio",
    "replacement_pressure", "residue_per_ha", "tractor_density", "workability",
)

# Words that texts for readers outside the analysis must not hold.
BANNED_TERMS = ["regression", "p-value", "sigma", "percentile", "variance", "likelihood", "z-score", "quantile"]

# Power bands of the tractor fleet, one per holding class, and what each category asks for.
POWER_BANDS = [(20.0, 35.0), (35.0, 45.0), (45.0, 60.0), (60.0, 80.0)]
ATTACH_CEILING = 0.5
NEEDS_IRRIGATION = ("MEDIUM",)
NEEDS_RESIDUE = ("PROMO",)
SELF_PROPELLED = ("SMALL",)
SOIL_AFFINITY = {"LARGE": {"hard": 1.0, "medium": 0.7}}
# How far each product type has spread: an assumption, falling by one step per type in alphabetical order.
MATURITY = {t: round(0.75 - 0.10 * i, 2) for i, t in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))}
RENTAL = {"ECONOMY": 0.35, "LARGE": 0.40, "MEDIUM": 0.20, "PROMO": 0.50, "SMALL": 0.30, "STANDARD": 0.10}
OWN_PLAYER = "Brand#1"
