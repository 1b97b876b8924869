"""Declared schemas; the feature list is named once, here."""

from __future__ import annotations

from pyspark.sql import types as T

# Model feature order.
FEATURES = ["Age", "Gender", "Stream", "Internships", "CGPA", "Hostel", "HistoryOfBacklogs"]
LABEL = "PlacedOrNot"
CATEGORICAL = ["Gender", "Stream"]

PROFILE_FIELDS = [
    T.StructField("Age", T.IntegerType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Stream", T.StringType()),
    T.StructField("Internships", T.IntegerType()),
    T.StructField("CGPA", T.DoubleType()),
    T.StructField("Hostel", T.IntegerType()),
    T.StructField("HistoryOfBacklogs", T.IntegerType()),
]

LABELLED_PROFILE = T.StructType(PROFILE_FIELDS + [T.StructField(LABEL, T.IntegerType())])

PROFILE_REQUEST = T.StructType(
    [T.StructField("id", T.LongType())]
    + PROFILE_FIELDS
    + [
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("desired_role", T.StringType()),
    ]
)

# Catalogue column names as they stand in the source file, and the names used inside.
CATALOGUE_COLUMNS = {
    "Job roles": "job",
    "Skills": "skills",
    "Programming Languages": "langs",
    "Tools": "tools",
}

EDGE = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("skill", T.StringType()),
        T.StructField("ord_row", T.LongType()),
        T.StructField("ord_pos", T.IntegerType()),
    ]
)
