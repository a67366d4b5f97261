"""Fixed values of the models, to be kept as they are.

Limits in pounds, thresholds, depth bins and species lists.
"""

from __future__ import annotations

from harborline.functions.labels import GroupRule
from harborline.operators.limits import LimitSchedule

# Limits, one number where they are the same in every period.
LINGCOD_LIMITS = (
    LimitSchedule("LE", "two_month", {"SQ": 7000, "A1": 9000, "A2": 11000, "A3": 14000}),
    LimitSchedule("OA", "month", {"SQ": 3500, "A1": 4500, "A2": 5500, "A3": 7000}),
)
POP_LIMITS = (LimitSchedule("LE", "two_month", {"SQ": 1800, "A1": 3600}),)
SHELF_LIMITS = (
    LimitSchedule("LE", "month", {"SQ": 800, "A1": 1500}),
    LimitSchedule("OA", "month", {"SQ": 800, "A1": 1500}),
)
WIDOW_SHELF_LIMITS = (
    LimitSchedule("LE", "month", {"SQ": 200, "A1_WIDOW": 4000, "A1_SHELF": 200}),
    LimitSchedule("OA", "month", {"SQ": 200, "A1_WIDOW": 2000, "A1_SHELF": 200}),
)
YELLOWTAIL_LIMITS = (
    LimitSchedule("LE", "month", {"SQ": 3000, "A1": 4500}),
    LimitSchedule("OA", "month", {"SQ": 1500, "A1": 2500}),
)
LE_ZONE_STATUS_QUO = (2000, 2000, 2000, 2500, 2500, 2500)
ZONE_LIMITS = (
    LimitSchedule("LEN", "two_month", {"SQ": LE_ZONE_STATUS_QUO, "A1": 3000, "A2": 750, "A3": 350}),
    LimitSchedule("LES", "two_month", {"SQ": LE_ZONE_STATUS_QUO, "A1": 3000, "A2": 750, "A3": 350}),
    LimitSchedule("LESS", "two_month", {"SQ": 3000, "A1": 4000}),
    LimitSchedule("OAN", "two_month", {"SQ": 100, "A1": 50, "A2": 40}),
    LimitSchedule("OAS", "two_month", {"SQ": 100, "A1": 50, "A2": 40}),
)
# The monthly open access limits that were considered as well.
ZONE_LIMITS_MONTHLY_OA = ZONE_LIMITS[:3] + (
    LimitSchedule("OAN", "month", {"SQ": 50, "A1": 25, "A2": 20}),
    LimitSchedule("OAS", "month", {"SQ": 50, "A1": 25, "A2": 20}),
)

# Rule and threshold by scenario and fleet or zone.
LINGCOD_RULES = {a: {"LE": ("raise", 0.8), "OA": ("raise", 0.8)} for a in ("A1", "A2", "A3")}
POP_RULES = {"A1": {"LE": ("raise", 0.9)}}
SHELF_RULES = {"A1": {"LE": ("raise", 0.9), "OA": ("raise", 0.54)}}
YELLOWTAIL_RULES = {"A1": {"LE": ("raise", 0.7), "OA": ("raise", 0.7)}}
WIDOW_SHELF_THRESHOLD = 0.9
ZONE_RULES = {
    "A1": {
        "LEN": ("raise", 0.6),
        "LES": ("raise", 0.6),
        "LESS": ("raise", 0.8),
        "OAN": ("cap", 0.8),
        "OAS": ("cap", 0.8),
        "OASS": ("cap", 0.8),
    },
    "A2": {
        "LEN": ("cap", 0.6),
        "LES": ("cap", 0.6),
        "OAN": ("cap", 0.8),
        "OAS": ("cap", 0.8),
        "OASS": ("cap", 0.8),
    },
    "A3": {"LEN": ("cap", 0.6), "LES": ("cap", 0.6)},
}

# Last period of actual landings by fleet; the alternatives start after it.
LAST_ACTUAL = {"LE": 4, "OA": 9}

# Depth bins: region, bin, share of the catch, discard ratio, discard mortality.
DEPTH_BINS = (
    ("OR", "10", 0.2654, 0.003, 0.28),
    ("OR", "20", 0.6400, 0.016, 0.45),
    ("OR", "30", 0.0897, 0.067, 0.67),
    ("OR", "31", 0.0049, 0.005, 1.00),
    ("ncal", "10", 0.2109, 0.001, 0.28),
    ("ncal", "20", 0.5837, 0.008, 0.45),
    ("ncal", "30", 0.2033, 0.070, 0.67),
    ("ncal", "31", 0.0021, 0.045, 1.00),
)

# Trip model: pounds of the target species per pound allowed, by scenario.
RATIO_LIMITS = {"SQTL_200LBS": 5.0, "ALT1_250LBS": 4.0}
RATIO_BASE = "SQTL_200LBS"
TRIP_SPECIES = {"PACIFIC_HALIBUT": "PACIFIC HALIBUT", "SABLEFISH": "SABLEFISH"}
TRIP_FISHERIES = ("PRI", "LEN")
EXCLUDED_REMOVAL = "E"
HALIBUT_EXCLUDED_AREAS = ("60A2", "61")

# Species lists.
LINGCOD_SPECIES = ("LINGCOD",)
POP_SPECIES = ("PACIFIC OCEAN PERCH",)
THORNYHEAD_SPECIES = ("SHORTSPINE THORNYHEAD",)
YELLOWTAIL_SPECIES = ("YELLOWTAIL ROCKFISH",)
WIDOW_AND_SHELF_GROUPS = {
    "WIDOW&SHELF": (
        "SHORTBELLY ROCKFISH", "BOCACCIO", "WIDOW ROCKFISH", "CHILIPEPPER ROCKFISH", "COWCOD",
    ),
    "SHELF": ("SHORTBELLY ROCKFISH", "BOCACCIO", "CHILIPEPPER ROCKFISH", "COWCOD"),
    "WIDOW": ("WIDOW ROCKFISH",),
}
SHELF_SPECIES = (
    "BRONZESPOTTED ROCKFISH", "BOCACCIO", "CHILIPEPPER ROCKFISH", "COWCOD ROCKFISH",
    "FLAG ROCKFISH", "FRECKLED ROCKFISH", "GREENBLOTCHED ROCKFISH", "GREENSPOTTED ROCKFISH",
    "GREENSTRIPED ROCKFISH", "HALFBANDED ROCKFISH", "HARLEQUIN ROCKFISH", "HONEYCOMB ROCKFISH",
    "MEXICAN ROCKFISH", "NOR. UNSP. SHELF ROCKFISH", "PINK ROCKFISH", "PYGMY ROCKFISH",
    "REDSTRIPE ROCKFISH", "ROSETHORN ROCKFISH", "ROSY ROCKFISH", "SILVERGRAY ROCKFISH",
    "SPECKLED ROCKFISH", "SQUARESPOT ROCKFISH", "STARRY ROCKFISH", "STRIPETAIL ROCKFISH",
    "SWORDSPINE ROCKFISH", "TIGER ROCKFISH", "UNSP. SHELF ROCKFISH", "VERMILION ROCKFISH",
)
NEARSHORE_SPECIES = (
    "BLACK ROCKFISH", "BLUE ROCKFISH", "DEACON ROCKFISH", "BOCACCIO", "CABEZON",
    "KELP GREENLING", "LINGCOD", "BLACK AND YELLOW ROCKFISH", "BLACK+BLUE ROCKFISH",
    "CHINA ROCKFISH", "GOPHER ROCKFISH", "UNSP. GOPHER ROCKFISH", "GRASS ROCKFISH",
    "KELP ROCKFISH", "OLIVE ROCKFISH", "COPPER ROCKFISH", "QUILLBACK ROCKFISH",
    "CALICO ROCKFISH", "CANARY ROCKFISH", "BROWN ROCKFISH", "UNSP. NEAR-SHORE ROCKFISH",
    "NOR. UNSP. NEAR-SHORE ROCKFISH", "YELLOWEYE ROCKFISH", "UNSP. DEEP NEAR-SHORE RF",
    "UNSP. ROCKFISH", "TREEFISH", "CALIFORNIA SCORPIONFISH",
)
SMALL_SPECIES = "CALIFORNIA SHEEPHEAD"
SMALL_SPECIES_BELOW = 110
NEARSHORE_RULES = (
    GroupRule(
        "NEARSHORE",
        (
            "BLACK AND YELLOW ROCKFISH", "BLUE ROCKFISH", "CHINA ROCKFISH", "GOPHER ROCKFISH",
            "UNSP. GOPHER ROCKFISH", "GRASS ROCKFISH", "KELP ROCKFISH", "OLIVE ROCKFISH",
            "COPPER ROCKFISH", "QUILLBACK ROCKFISH", "CALICO ROCKFISH", "BROWN ROCKFISH",
            "UNSP. NEAR-SHORE ROCKFISH", "NOR. UNSP. NEAR-SHORE ROCKFISH",
            "UNSP. DEEP NEAR-SHORE RF", "TREEFISH",
        ),
    ),
    GroupRule(
        "BLACK/BLUE/DEACON ROCKFISH",
        ("BLACK ROCKFISH", "BLUE ROCKFISH", "DEACON ROCKFISH", "BLACK+BLUE ROCKFISH"),
        "O",
    ),
    GroupRule("CABEZON/KELP GREENLING", ("CABEZON", "KELP GREENLING"), "O"),
    GroupRule("CANARY ROCKFISH WA", ("CANARY ROCKFISH",), "W"),
)
