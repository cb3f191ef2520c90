"""Thresholds, labels and word lists of the domain.

Fixed values: they must equal those of the data that the rules are held against.
"""

from __future__ import annotations

# Spatial
SOURCE_EPSG = 4326
METRIC_EPSG = 32631
KM_PER_DEGREE = 111.11
BUFFER_METRES = 200.0
FALLBACK_BUFFER = 100.0
NEIGHBOUR_METRES = 65.0
NEAREST_METRES = 60.0
BUILDING_LIMIT = 2
AREA_LIMIT = 30.0
GRID_SIZE_BUILT_UP = 50.0
GRID_SIZE_OTHER = 100.0
MIN_DISTANCE, TARGET_DISTANCE, SHIFT_DISTANCE, SHIFT_ROUNDS = 66.0, 68.0, 67.0, 100

# Fuzzy thresholds
ADMIN_CUTOFF, ADMIN_PARTIAL, COLUMN_CUTOFF, ATTRIBUTE_CUTOFF = 80, 90, 90, 91
DUPLICATE_NAME_SCORE, MATCH_CUTOFF, BOUNDARY_CUTOFF, SUBMISSION_CUTOFF = 92, 96, 97, 95

# Labels
VISITED, NOT_YET_VISITED, NOT_VISITED = "Visited", "Not Yet Visited", "Not Visited"
NO_COVERAGE, POOR, PARTIAL, FULL = "No Coverage", "Poorly Covered", "Partially Covered", "Fully Covered"
COVERAGE_ORDER = (FULL, PARTIAL, POOR, NO_COVERAGE)
VISIT_ORDER = (VISITED, NOT_YET_VISITED, NOT_VISITED)

ABBREVIATIONS = {"Alh": "Alhaji", "Ang": "Anguwar", "Ung": "Unguwar", "Ugw": "Unguwan"}
FACILITIES = {"PHC": "Primary Health Center", "HF": "Health Facility", "GH": "General Hospital", "HP": "Health Post"}
FACILITY_WORDS = ("PHC", "HF", "GH", "HP", "MCH", "MDG", "Dispensary", "NPI", "WCWC", "TcHF")
EXCLUSION_WORDS = ("exist", "unknown", "duplicate", "migrate", "abandoned", "state", "remove")
GONE = ("Abandoned", "Migrated")

LEVEL_TITLES = {"state": "State", "lga": "LGA", "ward": "Ward"}
ROUND_LABELS = ("visited", "not visited", "not found")
NEVER_ROUNDS = ("contact", "contact_proportion", "coverage", "settlement_id", "unique_code")
TEAM_CODE_LIMIT = 10_000

YES_NO = ("Y", "N")
YES_NO_COLUMNS = (
    "security_compromised", "urban", "rural", "scattered", "highrisk", "slums", "densely_populated", "hard2reach",
    "border", "nomadic", "riverine", "fulani",
)
NUMERIC_COLUMNS = ("set_population", "set_target", "number_of_household", "noncompliant_household", "team_code")
FULLY_ACCESSIBLE = "Fully Accessible"
PRESETS = {
    "day_of_activity": ("1", "1_2", "1_2_3", "1_2_3_4", "2", "2_3", "2_3_4", "3", "3_4", "4"),
    "border_type": ("International", "State", "LGA", "Ward"),
    "accessibility_status": ("Fully Accessible", "Inaccessible", "Partially Accessible"),
    "reasons_for_inaccessibility": (
        "AOGs", "Banditry", "Cattle Rustling", "Kidnapping", "Terrain", "Banditry/Kidnapping", "Banditry/Terrain",
        "Banditry/Kidnapping/Cattle Rustling", "Banditry/Kidnapping/Cattle Rustling/Terrain",
    ),
    "habitational_status": ("Inhabited", "Partially Inhabited", "Abandoned", "Migrated"),
}
FEEDBACK_COLUMNS = (
    "invalid_name_length", "stacked_point", "duplicate_attribute", "no_coordinates", "boundary_issues", "proximity_issues",
)
MAJOR_FLAGS = (
    "stacked_point", "duplicate_attribute", "proximity_issues", "WE_population", "habitation_fidelity",
    "settlement_type_fidelity", "WE_accessibility_status", "WE_security_compromised", "WE_urban", "WE_rural",
    "WE_scattered", "WE_habitational_status", "WE_eha_guid",
)

# Patterns
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
STRICT_COORDINATE = r"^\b-?\d+\.\d{2,}([eE][-+]?\d+)?\b"
