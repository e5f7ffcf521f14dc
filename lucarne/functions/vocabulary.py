"""Word lists, markers, limits and presets that results depend on."""

# --- Fixed values: cells read as missing in delimited text -------------------
NULL_TOKENS = ["", "NA", "N/A", "null", "NULL", "None"]

# --- Fixed values: spreadsheet error texts -----------------------------------
ERROR_TOKENS = ["#N/A", "#VALUE!", "#REF!", "#DIV/0!", "#NUM!", "#NAME?", "#NULL!"]

# --- Fixed values: separators, in order of preference ------------------------
SEPARATORS = [",", ";", "|", "\t"]

# --- Fixed values: boolean markers -------------------------------------------
# Numbers 1 and 1.0 are markers too; as lower-case text that is "1" and "1.0".
TRUE_MARKERS = ["1", "true", "vrai", "oui", "yes", "y", "t"]
FALSE_MARKERS = ["0", "false", "faux", "non", "no", "n", "f"]
# The lenient cast also takes the text of the float marker.
LENIENT_TRUE_MARKERS = TRUE_MARKERS + ["1.0"]
# Values taken as the positive side when a two-valued column is labelled.
POSITIVE_LABELS = ["1", "true", "yes", "oui", "vrai", "t", "y", "o"]
# Texts that select the true rows of a boolean column in an equality filter.
FILTER_TRUE = ["true", "1", "yes", "oui"]

# --- Fixed values: month names, French then English, in replacement order -----
MONTHS = {
    "janvier": "01", "février": "02", "mars": "03", "avril": "04", "mai": "05", "juin": "06",
    "juillet": "07", "août": "08", "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12",
    "janv": "01", "févr": "02", "avr": "04", "juil": "07", "sept": "09", "octo": "10", "nove": "11", "déce": "12",
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05", "june": "06",
    "july": "07", "august": "08", "september": "09", "october": "10", "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07", "aug": "08",
    "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

# --- Fixed values: name hints, matched as substrings of the lower-case name ---
MEASURE_WORDS = [
    "prix", "price", "age", "valeur", "value", "amount", "montant",
    "taux", "rate", "ht", "ttc", "score", "note",
]
ID_WORDS = ["id", "uuid", "ref", "pk", "code", "index", "key", "idx", "num", "no"]

# --- Fixed values: limits ----------------------------------------------------
CATEGORY_LIMIT = 30        # at most this many distinct values -> categorical
IDENTIFIER_RATIO = 0.95    # above this share of distinct values -> identifier
PREVIEW_ROWS = 2000
SHEET_PREVIEW_ROWS = 10
ADVICE_ROWS = 100
HISTOGRAM_BINS = 20
TOP_VALUES = 10
DISTINCT_LIMIT = 1000
CHART_POINTS = 5000
BAR_LIMIT = 50
PIE_LIMIT = 20
BOX_LIMIT = 30
BOX_OUTLIERS = 50
PIVOT_WIDTH = 200
PIVOT_SEPARATOR = " | "

# --- Fixed values: detector presets per sensitivity ---------------------------
SENSITIVITY = {
    "strict": {"zscore": 2.5, "iqr": 1.5, "isolation_forest": 0.05},
    "standard": {"zscore": 3.0, "iqr": 2.0, "isolation_forest": 0.10},
    "loose": {"zscore": 3.5, "iqr": 3.0, "isolation_forest": 0.15},
}
METHOD_LABELS = {
    "zscore": "Z-Score",
    "iqr": "IQR (Tukey)",
    "isolation_forest": "Isolation Forest",
}
ROW_SEVERITY = [(0.75, "high", "Critique"), (0.45, "moderate", "Modéré")]
ROW_SEVERITY_ELSE = ("low", "Faible")
TABLE_SEVERITY = [(0.05, "high", "Élevé"), (0.01, "moderate", "Modéré")]
TABLE_SEVERITY_ELSE = ("low", "Faible")
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256
FOREST_SEED = 42
