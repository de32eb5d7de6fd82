"""Weights, texts, thresholds and small tables the results depend on."""

from __future__ import annotations

# --- Fixed values: score weights -------------------------------------------
VEHICLE_WEIGHTS = {
    "SCOOTER": 0.2,
    "MOTOR CYCLE": 0.2,
    "MOPED": 0.2,
    "PASSENGER AUTO": 0.5,
    "GOODS AUTO": 0.8,
    "CAR": 1.0,
    "VAN": 1.0,
    "MAXI-CAB": 1.2,
    "LGV": 1.8,
    "PRIVATE BUS": 2.5,
    "TANKER": 3.0,
    "TRACTOR": 2.0,
    "HCV": 3.0,
}
VIOLATION_WEIGHTS = {
    "DOUBLE PARKING": 3.0,
    "PARKING IN A MAIN ROAD": 2.5,
    "PARKING NEAR ROAD CROSSING": 2.0,
    "PARKING NEAR TRAFFIC LIGHT OR ZEBRA CROSS": 2.0,
    "PARKING NEAR BUSTOP/SCHOOL/HOSPITAL ETC": 1.8,
    "WRONG PARKING": 1.5,
    "NO PARKING": 1.2,
    "PARKING ON FOOTPATH": 1.0,
    "DEFECTIVE NUMBER PLATE": 0.2,
    "REFUSE TO GO FOR HIRE": 0.1,
}
DEFAULT_WEIGHT = 1.0

# --- Fixed values: road classes, first match wins ---------------------------
JUNCTION_MARK = "btp"
JUNCTION_WEIGHT = 3.0
ROAD_CLASSES = (
    (("metro station", "market"), 2.8),
    (("main road", "ring road", "highway", "flyover"), 2.0),
    (("cross road", "cross", "layout"), 0.8),
)
OTHER_ROAD_WEIGHT = 1.2

# --- Fixed values: cost factors ---------------------------------------------
DELAY_PER_CIS = 0.25
VALUE_OF_TIME = 150.0
FUEL_PER_HOUR = 1.2
IDLE_SHARE = 0.5
CO2_PER_LITRE = 2.3

# --- Fixed values: null defaults --------------------------------------------
NO_JUNCTION = "No Junction"
UNKNOWN = "UNKNOWN"
NULL_DEFAULTS = {
    "police_station": UNKNOWN,
    "vehicle_type": UNKNOWN,
    "location": UNKNOWN,
    "junction_name": NO_JUNCTION,
}
NOISE = -1
DEFAULT_APPROVAL = 0.85

# --- Fixed values: reporting ------------------------------------------------
REPORT_DAYS = 150
CIS_SCALE = 4.14
VEHICLES_PER_TICKET = 12
TREND_HOURS = (8, 10, 12, 14, 16, 18, 20)
QUIET_TREND_HOURS = (8, 14, 20)
QUIET_FACTOR = 0.8
BUSY_FACTOR = 1.1
MAP_CENTRE = (12.9716, 77.5946)

# --- Fixed values: clustering and approval model ----------------------------
MIN_PROBABILITY = 0.7
MIN_CIS = 1.5
EPS_DEGREES = 0.0015
MIN_SAMPLES = 15
APPROVAL_FEATURES = (
    "hour",
    "day_of_week",
    "month",
    "w_size",
    "w_type",
    "w_road",
    "vehicle_type_enc",
    "police_station_enc",
    "primary_violation_enc",
)

# --- Fixed values: sentences that explain a hotspot --------------------------
REASONS = (
    (8.0, "Critical bottleneck showing extreme peak-hour congestion and heavy vehicle footprint. Immediate towing enforcement required."),
    (5.0, "High violation density and sustained peak-hour concentration. Scheduled officer deployment recommended to clear transit capacity."),
)
OTHER_REASON = "Routine patrol. Minor parking friction with low baseline delay impact."
AUDIT_SENTENCE = (
    "Hotspot prioritized as %s due to a high density of %s violations. "
    "Analysis reveals that %.1f%% of offending vehicles are %ss, "
    "significantly restricting transit capacity."
)

# --- Fixed values: the 23 columns of the scored snapshot --------------------
SCORED_COLUMNS = (
    "id",
    "latitude",
    "longitude",
    "location",
    "vehicle_type",
    "violation_type",
    "created_datetime",
    "police_station",
    "junction_name",
    "validation_status",
    "hour",
    "day_of_week",
    "month",
    "cis",
    "delay_hours",
    "economic_loss_inr",
    "fuel_wasted_liters",
    "co2_wasted_kg",
    "approval_probability",
    "cluster_label",
    "w_size",
    "w_type",
    "w_road",
)

# --- Fixed values: texts that count as missing in the raw CSV ---------------
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: stand-in junction record of the feed ---------------------
FEED_DEFAULTS = {
    "jurisdiction": "Unknown",
    "lat": 12.9716,
    "lng": 77.5946,
    "vehicle_mix": "SCOOTER (45%), CAR (20%)",
    "vehicle_mix_data": (("SCOOTER", 45.0), ("CAR", 20.0)),
    "peak_hour": "09:00",
    "peak_hour_val": 9,
    "peak_hour_violations": 100,
    "trend_multiplier": 1.0,
    "raw_cis_base": 1.0,
    "economic_cost_base": 0,
    "co2_impact_base": 0,
}

# --- Fixed values: road corridors and patrol units --------------------------
CORRIDORS = (
    ("R1", "MG Road Corridor", ((12.9785, 77.6010), (12.9801, 77.6046), (12.9805, 77.6095)), 18, 50, "orange", 1240, 4.2, True),
    ("R2", "K.G. Road (Upparpet)", ((12.9730, 77.5750), (12.9775, 77.5772), (12.9790, 77.5780)), 12, 45, "red", 980, 5.6, True),
    ("R3", "Koramangala 80ft Road", ((12.9300, 77.6140), (12.9329, 77.6143), (12.9370, 77.6150)), 32, 45, "yellow", 850, 2.1, False),
    ("R4", "HAL Airport Road", ((12.9570, 77.6400), (12.9592, 77.6444), (12.9610, 77.6480)), 7, 60, "dark-red", 1420, 8.5, True),
    ("R5", "Malleshwaram Link Road", ((12.9960, 77.5710), (12.9984, 77.5714), (13.0010, 77.5720)), 48, 50, "green", 510, 0.5, False),
    ("R6", "Modi Hospital Road", ((12.9840, 77.5380), (12.9863, 77.5385), (12.9890, 77.5390)), 24, 45, "orange", 720, 3.2, True),
)
PATROL_UNITS = (
    ("O1", 12.9820, 77.6010, "officer", "P-12"),
    ("O2", 12.9750, 77.5810, "officer", "P-05"),
    ("T1", 12.9560, 77.6410, "tow", "TOW-01"),
    ("T2", 12.9690, 77.5710, "tow", "TOW-02"),
)
DISPATCH_NAMES = ("Patrol Alpha", "Patrol Beta", "Tow Unit 01")
DISPATCH_CODES = ("P-12", "P-05", "TOW-01")
THIRD_ACTION = "Tow Vehicle"
LINK_KM = 1.0
EARTH_RADIUS_KM = 6371.0
