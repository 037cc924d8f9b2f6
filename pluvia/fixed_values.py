"""Fixed values. They must equal the published ones for results to agree; nothing here is logic."""

# Rainfall classes (name, above, up to) and cut-offs in mm per day.
INTENSITY_CATEGORIES = [
    ("Dry", None, 0.0),
    ("Light", 0.0, 15.5),
    ("Moderate", 15.5, 64.4),
    ("Heavy", 64.4, 115.5),
    ("Extreme", 115.5, None),
]
HEAVY_MM = 64.4
EXTREME_MM = 115.5

# Windows in days.
LAG_DAYS = (1, 2, 3, 7, 14)
ROLL_DAYS = (3, 7, 14, 30)

# Study box (degrees), half cell, grid bounds.
STUDY_BOX = {"min_lat": 18.30, "max_lat": 18.75, "min_lon": 73.60, "max_lon": 74.10}
CELL_HALF_DEG = 0.125
GRID_BOUNDS = {"min_lat": 6.5, "max_lat": 38.5, "min_lon": 66.5, "max_lon": 100.0}

# Score bands, min inclusive, max exclusive.
RISK_BANDS = {"LOW": (0, 40), "MODERATE": (40, 60), "HIGH": (60, 80), "CRITICAL": (80, 100.0001)}
VULNERABILITY_BANDS = {"LOW": (0, 45), "MODERATE": (45, 65), "HIGH": (65, 100.0001)}
HEAT_BANDS = {"LOW": (0, 40), "MODERATE": (40, 65), "HIGH": (65, 100.0001)}
WATER_BANDS = {"LOW": (0, 30), "MODERATE": (30, 60), "HIGH": (60, 100.0001)}
MODEL_ZONE_BANDS = {"LOW": (0, 40), "MODERATE": (40, 65), "HIGH": (65, 100.0001)}

# Risk weights and trend thresholds.
RISK_WEIGHTS = {"anomaly": 0.45, "intensity": 0.30, "vulnerability": 0.25}
TREND_THRESHOLDS = [
    ("STRONGLY_INCREASING", 10.0),
    ("INCREASING", 3.0),
    ("STABLE", -3.0),
    ("DECREASING", None),
]

# Additive point risk (above, points) and its cut-offs.
POINT_RAIN = [(115.5, 4.0), (64.4, 3.0), (15.5, 1.5)]
POINT_RAIN_7D = [(150.0, 3.0), (100.0, 2.0), (50.0, 1.0)]
POINT_HIGH = 8.0
POINT_MODERATE = 4.5
POINT_LABELS = ("🔴 HIGH", "🟡 MODERATE", "🟢 LOW")

# Vulnerability factors: key, source column, higher is worse, weight, noun.
VULNERABILITY_FACTORS = [
    ("imperviousness", "built_up_pct", True, 0.20, "high built-up percentage"),
    ("low_elevation", "elevation_mean_m", False, 0.15, "low elevation"),
    ("waterway_exposure", "distance_to_nearest_waterway_m", False, 0.15, "close proximity to river/stream"),
    ("drainage_access_deficit", "distance_to_nearest_drainage_m", True, 0.15, "large distance from mapped drainage"),
    ("flatness", "slope_mean_deg", False, 0.10, "flat terrain with slow runoff"),
    ("vegetation_deficit", "vegetation_pct", False, 0.10, "sparse vegetation cover"),
    ("rainfall_exposure", "rainfall_climatology_mm_day", True, 0.10, "strong historical rainfall exposure"),
    ("water_presence", "water_cover_pct", True, 0.05, "permanent water bodies nearby"),
]
MINOR_POINTS = 5.0
HEAT_WEIGHTS = {"built_up": 0.6, "vegetation": 0.4}

# Land-cover code, class, built-up percent; class used for unmapped codes.
LAND_COVER = [
    (10, "Vegetation_Hilly", 15.0),
    (20, "Vegetation_Hilly", 15.0),
    (30, "Vegetation_Hilly", 15.0),
    (40, "Agriculture_Plains", 25.0),
    (50, "Urban_Dense", 85.0),
    (60, "Agriculture_Plains", 20.0),
    (80, "Water_Bodies", 0.0),
    (90, "Wetland", 5.0),
]
LAND_COVER_UNMAPPED = ("Urban_Suburban", 55.0)
LC_BUILT_UP = (50,)
LC_VEGETATION = (10, 20, 30)
LC_WATER = (80,)
LC_CROPLAND = (40,)
LC_NODATA = 0

# Line classes.
WATERWAY_CLASSES = ("river", "stream", "canal")
DRAINAGE_CLASSES = ("drain", "ditch")

# Model feature columns.
DYNAMIC_FEATURES = [
    "rainfall_1d", "rainfall_3d", "rainfall_7d", "rainfall_14d", "rainfall_30d",
    "rainfall_anomaly_mm", "monthly_rainfall_to_date", "monsoon_rainfall_to_date",
    "river_level_daily_mean_m", "river_level_daily_max_m",
]
STATIC_FEATURES = [
    "elevation_mean_m", "elevation_min_m", "elevation_max_m",
    "slope_mean_deg", "slope_min_deg", "slope_max_deg",
    "built_up_pct", "vegetation_pct", "water_cover_pct",
    "distance_to_nearest_waterway_m", "waterway_length_m",
    "distance_to_nearest_drainage_m", "drainage_length_m",
]
FORBIDDEN_FEATURES = ("flood_event_active", "road_density")
PROXY_FEATURES = [
    "elevation_m", "slope_deg", "twi_proxy", "builtup_frac_local",
    "dist_to_drainage_m", "dist_to_waterway_m",
]
EVENT_BUFFER_DAYS = 3
LABEL_DISTANCE_M = 700.0
LABEL_ELEVATION_QUANTILE = 0.35
MIN_PROXY_SAMPLES = 5000
LABEL_GATE = {"min_positives": 20, "min_zones": 3, "min_years": 3, "max_zone_share": 0.6}

# Domains.
RISK_LEVELS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
TRENDS = ("STRONGLY_INCREASING", "INCREASING", "STABLE", "DECREASING")
REPORT_TYPES = ("WATERLOGGING", "FLOODING", "BLOCKED_DRAIN", "OTHER")
ROLES = ("PUBLIC", "MNC", "DISASTER")

# Priority ladder.
PRIORITY = {
    "order": ["ROUTINE", "ELEVATED", "HIGH", "URGENT"],
    "base_by_level": {"LOW": "ROUTINE", "MODERATE": "ELEVATED", "HIGH": "HIGH", "CRITICAL": "URGENT"},
    "trend_bonus_steps": {"STRONGLY_INCREASING": 1, "INCREASING": 1, "STABLE": 0, "DECREASING": 0},
    "report_threshold": 4,
    "report_bonus_steps": 1,
}

# Prevention rules (id, all-of predicates, action, explanation).
RULES = [
    {"rule_id": "RULE_LOW_ROUTINE_MONITOR",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "LOW"}]},
     "action": "Recommend routine monitoring; no urgent intervention required",
     "explanation": "Risk level is LOW - standard watchkeeping suffices"},
    {"rule_id": "RULE_MOD_INCREASED_MONITORING",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "MODERATE"}]},
     "action": "Recommend increased monitoring frequency of rainfall and local water levels",
     "explanation": "Moderate risk warrants closer observation than routine"},
    {"rule_id": "RULE_MOD_PREPARE_RESOURCES_RISING",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "MODERATE"},
                           {"field": "risk_trend", "op": "in", "value": ["INCREASING", "STRONGLY_INCREASING"]}]},
     "action": "Recommend preparing response resources for possible escalation",
     "explanation": "Rising trend at MODERATE level justifies advance preparation"},
    {"rule_id": "RULE_HIGH_INSPECT_DRAINAGE",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "HIGH"}]},
     "action": "Recommend inspection of drainage choke points and low-lying stretches",
     "explanation": "High risk raises probability of drainage-related waterlogging"},
    {"rule_id": "RULE_HIGH_DEPLOY_RESOURCES",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "HIGH"}]},
     "action": "Recommend deployment readiness / pre-positioning of response resources",
     "explanation": "High risk justifies having resources ready nearby"},
    {"rule_id": "RULE_HIGH_ADVISORY",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "HIGH"}]},
     "action": "Recommend issuing an appropriate public advisory through official channels",
     "explanation": "High risk merits proactive public communication"},
    {"rule_id": "RULE_HIGH_MONITOR_VULNERABLE_AREAS",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "HIGH"}]},
     "action": "Recommend targeted monitoring of known vulnerable low-lying zones",
     "explanation": "High risk concentrates impact in structurally vulnerable areas"},
    {"rule_id": "RULE_CRIT_IMMEDIATE_RESPONSE",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "CRITICAL"}]},
     "action": "Recommend immediate activation of response procedures",
     "explanation": "Critical risk leaves no margin for delayed reaction"},
    {"rule_id": "RULE_CRIT_EMERGENCY_RESOURCES",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "CRITICAL"}]},
     "action": "Recommend deployment of emergency resources at priority locations",
     "explanation": "Critical risk calls for resources at the most exposed spots first"},
    {"rule_id": "RULE_CRIT_NOTIFY_DISASTER_MGMT",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "CRITICAL"}]},
     "action": "Recommend notifying disaster-management personnel through established channels",
     "explanation": "Critical risk requires institutional awareness beyond this system"},
    {"rule_id": "RULE_CRIT_URGENT_ADVISORY",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "CRITICAL"}]},
     "action": "Recommend issuing an urgent public advisory",
     "explanation": "Critical risk justifies urgent public-facing communication"},
    {"rule_id": "RULE_CRIT_CONTINUOUS_MONITORING",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "CRITICAL"}]},
     "action": "Recommend continuous monitoring until conditions ease below CRITICAL",
     "explanation": "Critical states must be tracked without interruption"},
    {"rule_id": "RULE_TREND_ESCALATION_RISING",
     "condition": {"all": [{"field": "risk_level", "op": "in", "value": ["HIGH", "CRITICAL"]},
                           {"field": "risk_trend", "op": "in", "value": ["INCREASING", "STRONGLY_INCREASING"]}]},
     "action": "Recommend escalating preparedness measures given the rising risk trend",
     "explanation": "A rising trend at already-elevated levels argues for stronger action than a stable one"},
    {"rule_id": "RULE_TREND_DECREASING_DOWNGRADE_WATCH",
     "condition": {"all": [{"field": "risk_trend", "op": "==", "value": "DECREASING"},
                           {"field": "risk_level", "op": "not_in", "value": ["CRITICAL"]}]},
     "action": "Recommend maintaining only the standard monitoring cycle as conditions improve",
     "explanation": "Improving trend with non-critical level reduces need for extraordinary measures"},
    {"rule_id": "RULE_CITIZEN_REPORTS_VERIFY",
     "condition": {"all": [{"field": "citizen_reports", "op": ">=", "value": 1}]},
     "action": "Recommend field verification of the citizen-reported incident(s) and inclusion as contextual evidence",
     "explanation": "Citizen reports are contextual signals that deserve on-ground confirmation, not automatic truth"},
    {"rule_id": "RULE_CITIZEN_REPORTS_CLUSTER_ESCALATE",
     "condition": {"all": [{"field": "citizen_reports", "op": ">=", "value": 4}]},
     "action": "Recommend treating the clustered citizen reports as priority evidence for inspection resourcing",
     "explanation": "Multiple independent reports in one zone indicate a probable real incident pattern"},
]

# Demonstration rules.
DEMO_RULES = [
    {"rule_id": "RULE_DEMO_ESCALATE_HIGH_RISING",
     "condition": {"all": [{"field": "risk_level", "op": "in", "value": ["HIGH", "CRITICAL"]},
                           {"field": "risk_trend", "op": "in", "value": ["INCREASING", "STRONGLY_INCREASING"]}]},
     "action": "[DEMO] Activate response-team standby and review site safety checklist",
     "explanation": "[DEMO] High/elevated risk that is still rising warrants proactive preparedness"},
    {"rule_id": "RULE_DEMO_MONITOR_MODERATE",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "MODERATE"},
                           {"field": "risk_trend", "op": "in", "value": ["STABLE", None]}]},
     "action": "[DEMO] Increase observation frequency to twice daily",
     "explanation": "[DEMO] Moderate but non-improving situations benefit from closer watch"},
    {"rule_id": "RULE_DEMO_ROUTINE_LOW",
     "condition": {"all": [{"field": "risk_level", "op": "==", "value": "LOW"},
                           {"field": "risk_trend", "op": "not_in", "value": ["INCREASING", "STRONGLY_INCREASING"]}]},
     "action": "[DEMO] Maintain routine monitoring schedule",
     "explanation": "[DEMO] Low and non-rising conditions require no special measures"},
    {"rule_id": "RULE_DEMO_HEAVY_RAIN_AWARENESS",
     "condition": {"all": [{"field": "environmental_context.rainfall_1d", "op": ">=", "value": 75}]},
     "action": "[DEMO] Issue situational-awareness note to field staff",
     "explanation": "[DEMO] Very heavy daily rainfall deserves explicit communication regardless of level band"},
]

# Task lists per priority.
CHECKLISTS = {
    "ROUTINE": ["Confirm routine monitoring cycle completed"],
    "ELEVATED": ["Increase monitoring cadence", "Review drainage hotspot list",
                 "Brief field volunteers on conditions"],
    "HIGH": ["Inspect drainage choke points", "Verify response-resource readiness",
             "Draft public advisory", "Watch known vulnerable low-lying zones"],
    "URGENT": ["Activate response procedures", "Position emergency resources at priority locations",
               "Notify disaster-management contacts", "Publish urgent public advisory",
               "Maintain continuous monitoring until stand-down"],
}

# Advisory text per level.
ADVISORIES = {
    "LOW": "Conditions are normal. No action needed.",
    "MODERATE": "Stay aware of weather updates; avoid waterlogged stretches if you see them.",
    "HIGH": "Avoid low-lying areas and follow official advisories today.",
    "CRITICAL": "Stay indoors if safe, avoid flooded areas, and follow emergency advisories.",
}

# Anomaly message.
ANOMALY_MESSAGE = (
    "Hydro-meteorological conditions are unusually anomalous for this location. Awaiting rule-engine "
    "vulnerability assessment before issuing a final flood-risk classification."
)
ANOMALY_DISCLAIMER = "ML anomaly status only - NOT a flood warning and NOT official flood risk."

# Public message templates. {brand}, {zone} and {authority} are parameters.
PUBLIC_TEMPLATES = {
    "LOW": {
        "headline": "{brand} Update — {zone}",
        "status": "All clear in your area.",
        "what_happening": "Weather conditions are stable. No flood risk detected.",
        "what_to_do": ["No action needed right now", "Stay updated with local weather forecasts"],
        "tone": "calm",
    },
    "MODERATE": {
        "headline": "{brand} Advisory — {zone}",
        "status": "Some activity building up. Stay aware.",
        "what_happening": "We're monitoring some weather patterns that could cause minor waterlogging in low-lying areas.",
        "what_to_do": ["Keep your phone charged for updates", "Know your area's drainage spots",
                       "Avoid walking through standing water if you see it"],
        "tone": "aware",
    },
    "HIGH": {
        "headline": "{brand} Alert — {zone}",
        "status": "Elevated risk today. Please be cautious.",
        "what_happening": "Conditions are building up that could lead to waterlogging in some parts of your area. We're watching it closely.",
        "what_to_do": ["Avoid low-lying areas and underpasses if possible", "Keep emergency contacts handy",
                       "Move vehicles to higher ground if parked in flood-prone spots",
                       "Follow updates from {authority}"],
        "tone": "cautious",
    },
    "CRITICAL": {
        "headline": "{brand} Warning — {zone}",
        "status": "Significant risk. Take precautions now.",
        "what_happening": "Heavy rainfall and conditions suggest a real risk of waterlogging or flooding in parts of your area.",
        "what_to_do": ["Stay away from rivers, drains, and low-lying roads",
                       "Move to higher floors if you're in a ground-floor or basement unit",
                       "Keep emergency supplies ready (water, flashlight, charger)",
                       "Follow official instructions from disaster management authorities",
                       "Do not attempt to cross flooded roads on foot or in a vehicle"],
        "tone": "urgent",
    },
}

# Operational message templates.
MUNICIPAL_TEMPLATES = {
    "LOW": {"headline": "ZONE STATUS: {zone} ({grid})",
            "situation": "LOW risk — no immediate action required.",
            "action_required": "Continue routine monitoring."},
    "MODERATE": {"headline": "ZONE STATUS: {zone} ({grid})",
                 "situation": "MODERATE risk — conditions building, monitor closely.",
                 "action_required": "Pre-position resources. Alert field teams. Review drainage capacity in priority wards."},
    "HIGH": {"headline": "ZONE ALERT: {zone} ({grid})",
             "situation": "HIGH risk — waterlogging probable in low-lying areas.",
             "action_required": "Activate response protocols. Deploy pumps to priority locations. Alert disaster-management personnel. Prepare shelters if needed."},
    "CRITICAL": {"headline": "ZONE EMERGENCY: {zone} ({grid})",
                 "situation": "CRITICAL risk — flooding possible. Immediate action required.",
                 "action_required": "FULL ACTIVATION: Deploy all available resources. Evacuate vulnerable areas. Activate emergency shelters. Coordinate with NDRF/SDRF if needed. Issue public warnings."},
}
