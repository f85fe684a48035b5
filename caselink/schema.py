"""Column sets shared by every module."""

from pyspark.sql import types as T

CASE_SCHEMA = T.StructType(
    [
        T.StructField("dr_no", T.LongType(), False),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("area_name", T.StringType()),
        T.StructField("crm_cd", T.IntegerType()),
        T.StructField("crm_cd_desc", T.StringType()),
        T.StructField("weapon_desc", T.StringType()),
        T.StructField("vict_age", T.IntegerType()),
        T.StructField("vict_sex", T.StringType()),
        T.StructField("mo_text", T.StringType()),
    ]
)

CASE_COLUMNS = CASE_SCHEMA.fieldNames()

# Order in which the model sees the pair features.
FEATURES = [
    "similarity",
    "area_match",
    "weapon_match",
    "crime_code_match",
    "time_decay",
    "sex_match",
    "age_difference",
]
