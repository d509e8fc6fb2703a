"""The citation table: declared schema, column lists and column roles."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "summons_number"
DATE = "issue_date"
CODE = "violation_code"
FINE = "fine_amount"
UNKNOWN = "UNKNOWN"

# The columns of the citation table, in order.
CITATION_SCHEMA = T.StructType(
    [
        T.StructField("summons_number", T.StringType(), False),
        T.StructField("source_dataset", T.StringType(), False),
        T.StructField("issue_date", T.DateType()),
        T.StructField("violation_time", T.StringType()),
        T.StructField("violation_code", T.StringType()),
        T.StructField("violation_desc", T.StringType()),
        T.StructField("issuing_agency", T.StringType()),
        T.StructField("county", T.StringType()),
        T.StructField("precinct", T.StringType()),
        T.StructField("street_name", T.StringType()),
        T.StructField("intersecting_street", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("fine_amount", T.DecimalType(10, 2)),
        T.StructField("plate_id", T.StringType()),
        T.StructField("registration_state", T.StringType()),
        T.StructField("plate_type", T.StringType()),
        T.StructField("soda_row_id", T.StringType()),
        T.StructField("soda_created_at", T.TimestampType()),
        T.StructField("soda_updated_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)

POINT = ["latitude", "longitude"]
ALL_COLUMNS = [name for name in CITATION_SCHEMA.fieldNames() if name not in POINT]

# Default column list of a scan.
SCAN_COLUMNS = [
    "summons_number",
    "issue_date",
    "violation_time",
    "violation_code",
    "violation_desc",
    "issuing_agency",
    "county",
    "precinct",
    "street_name",
    "intersecting_street",
    "fine_amount",
    "plate_type",
    "registration_state",
]

# A training load leaves out the cross street and the plate's state.
TRAINING_COLUMNS = [
    name for name in SCAN_COLUMNS if name not in ("intersecting_street", "registration_state")
]

# Role of every column of the feature frame.
COLUMN_ROLES = {
    "numeric": [
        "hour",
        "day_of_week",
        "day_of_month",
        "month",
        "week_of_year",
        "year",
        "is_weekend",
        "is_rush_hour",
        "is_asp_day",
        "is_avenue",
        "is_street",
        "is_broadway",
        "fine_amount_clean",
    ],
    "categorical": ["borough", "precinct_clean", "time_of_day", "agency", "plate_type_grouped"],
    "target_candidates": ["violation_code", "borough", "fine_amount_clean"],
    "id_columns": ["summons_number"],
    "drop_columns": [
        "issue_date",
        "violation_time",
        "violation_desc",
        "issuing_agency",
        "county",
        "precinct",
        "street_name",
        "street_name_clean",
        "fine_amount",
        "plate_type",
        "plate_type_clean",
        "violation_code_clean",
        "has_fine",
    ],
}
