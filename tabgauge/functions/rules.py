"""Thresholds, name fragments and wording the results depend on."""

# Name fragments that mark a date column.
DATE_NAME_PARTS = ["date", "time", "timestamp", "year", "month"]
CONTEXT_DATE_NAME_PARTS = ["date", "time", "timestamp"]

# Scenario -> name fragments, tried in this order.
SCENARIO_PARTS = {
    "MANUFACTURING": ["machine", "sensor", "vibration", "temperature", "rpm", "speed"],
    "QUALITY_CONTROL": ["defect", "quality", "inspection", "pass", "fail"],
    "SUPPLY_CHAIN": ["shipment", "delivery", "warehouse", "inventory", "stock"],
}
GENERIC = "GENERIC"

# Scenario -> metric role -> (kind of column, name fragments).
ROLE_PARTS = {
    "MANUFACTURING": {
        "critical": ("numeric", ["vibration"]),
        "health": ("numeric", ["temperature", "temp"]),
        "efficiency": ("numeric", ["rpm", "speed"]),
        "unit": ("text", ["machine", "sensor"]),
    },
    "QUALITY_CONTROL": {
        "critical": ("text", ["status", "result"]),
        "health": ("numeric", ["score", "rating"]),
    },
    "SUPPLY_CHAIN": {
        "critical": ("numeric", ["quantity", "stock"]),
        "health": ("numeric", ["delay", "time"]),
    },
    "GENERIC": {},
}

# Question phrase -> month and day, tried in this order.
DATE_PHRASES = [
    ("jan 1", "01-01"),
    ("jan 2", "01-02"),
    ("january 1", "01-01"),
    ("feb 1", "02-01"),
    ("march 1", "03-01"),
]

# Tukey fence width and z-score limit.
FENCE_WIDTH = 1.5
Z_LIMIT = 3.0

# Share of a unit's rows above the fence that raises an alert.
ALERT_SHARE = 0.2

# Correlation levels.
R_STRONG = 0.5
R_VERY_STRONG = 0.8
R_HIGH = 0.9
R_VERY_HIGH = 0.95

# Days a forecast may look ahead.
MAX_HORIZON = 365

DEFAULT_EFFICIENCY = 87.5
SYSTEM_WIDE = "System-Wide"
