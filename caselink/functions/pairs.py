"""Comparison of a base case with a candidate case.

``base`` and ``cand`` are struct columns holding case columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_AGE = 40.0
DECAY_DAYS = 365.0
MICROS_PER_DAY = 86_400_000_000


def same(base: Column, cand: Column, field: str) -> Column:
    """1 when both values are present and equal, else 0."""
    return F.coalesce((base[field] == cand[field]).cast("int"), F.lit(0))


def whole_days(base: Column, cand: Column) -> Column:
    """Days from base to candidate, rounded down before the sign is dropped.

    One hour earlier is therefore one day apart, one hour later is zero days apart.
    """
    micros = F.timestamp_diff("MICROSECOND", base["datetime"], cand["datetime"])
    return F.abs(F.floor(micros / F.lit(MICROS_PER_DAY)))


def pair_features(similarity: Column, base: Column, cand: Column) -> dict[str, Column]:
    age = lambda case: F.coalesce(case["vict_age"].cast("double"), F.lit(DEFAULT_AGE))
    return {
        "similarity": F.coalesce(similarity, F.lit(0.0)),
        "area_match": same(base, cand, "area_name"),
        "weapon_match": same(base, cand, "weapon_desc"),
        "crime_code_match": same(base, cand, "crm_cd"),
        "time_decay": F.exp(-whole_days(base, cand) / F.lit(DECAY_DAYS)),
        "sex_match": same(base, cand, "vict_sex"),
        "age_difference": F.abs(age(cand) - age(base)),
    }


def is_relevant(base: Column, cand: Column) -> Column:
    """Rule-made label: at least two of crime code, area, weapon and whole text agree."""
    agreeing = sum(same(base, cand, f) for f in ("crm_cd", "area_name", "weapon_desc", "mo_text"))
    return (agreeing >= 2).cast("int")
