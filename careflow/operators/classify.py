"""Classification of episodes, beds and staff, and the type index.

Lookups are joined without a broadcast hint: Spark broadcasts a lookup whose size is under its
threshold and otherwise falls back to a sort-merge join, where adaptive execution splits a hot code.
A null code never matches (SQL equality), and a code listed twice fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import fixed_values as fv


def classify_episodes(
    episodes: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    diagnosis_code: str = "diagnosis_code",
    procedure_code: str = "procedure_code",
) -> DataFrame:
    """Add ``patient_type`` (six values) and ``patient_type_coarse`` (four values).

    ``diagnoses`` is (code, disease, disease_coarse); ``procedures`` is (code, treatment). Codes
    without a lookup row are other / other / clinical.
    """
    d = diagnoses.select(F.col("code").alias("_diagnosis"), "disease", "disease_coarse")
    p = procedures.select(F.col("code").alias("_procedure"), "treatment")
    treatment = F.coalesce("treatment", F.lit(fv.CLINICAL))
    return (
        episodes.join(d, episodes[diagnosis_code] == d["_diagnosis"], "left")
        .join(p, episodes[procedure_code] == p["_procedure"], "left")
        .withColumns(
            {
                "patient_type": F.concat_ws("_", F.coalesce("disease", F.lit(fv.OTHER)), treatment),
                "patient_type_coarse": F.concat_ws(
                    "_", F.coalesce("disease_coarse", F.lit(fv.OTHER)), treatment
                ),
            }
        )
        .drop("_diagnosis", "_procedure", "disease", "disease_coarse", "treatment")
    )


def classify_beds(beds: DataFrame, bed_lookup: DataFrame, bed_code: str = "bed_code") -> DataFrame:
    """Add ``bed_group``; a bed code without a lookup row keeps a null group.

    ``bed_lookup`` is (code, bed_group).
    """
    k = bed_lookup.select(F.col("code").alias("_code"), "bed_group")
    return beds.join(k, beds[bed_code] == k["_code"], "left").drop("_code")


def classify_staff(
    staff: DataFrame,
    occupations: DataFrame,
    hour_cols: tuple[str, ...] = ("h_amb", "h_hosp", "h_other"),
    divisor: int = fv.HOURS_DIVISOR,
    unknown: str = fv.UNKNOWN_OCCUPATION,
) -> DataFrame:
    """Head count per (facility, occupation, month, daily hours).

    ``occupations`` is (code, name). Daily hours are weekly hours over ``divisor``, truncated. The
    count is of known occupation codes.
    """
    o = occupations.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    weekly: Column = sum((F.col(c) for c in hour_cols[1:]), F.col(hour_cols[0]))
    return (
        staff.join(o, staff["occupation_code"] == o["_code"], "left")
        .select(
            "facility_id",
            F.coalesce("_name", F.lit(unknown)).alias("occupation"),
            "month_key",
            (weekly / divisor).cast("long").alias("hours"),
            "occupation_code",
        )
        .dropna(subset=["facility_id", "month_key", "hours"])
        .groupBy("facility_id", "occupation", "month_key", "hours")
        .agg(F.count("occupation_code").alias("headcount"))
    )


def type_array(df: DataFrame, type_col: str = "patient_type") -> Column:
    """Sorted distinct types of ``df`` as a scalar subquery.

    The classifier knows six types, so the array is small whatever the size of ``df``; every task
    reduces its rows to that set before anything is shuffled.
    """
    return df.agg(F.array_sort(F.collect_set(type_col))).scalar()


def type_index(seen: DataFrame, type_col: str = "patient_type") -> DataFrame:
    """(type_id, patient_type): 0-based rank of each type seen in ``seen``, in name order."""
    return seen.agg(F.array_sort(F.collect_set(type_col)).alias("_all")).select(
        F.posexplode("_all").alias("type_id", "patient_type")
    )


def encode_types(seen: DataFrame, *tables: DataFrame, type_col: str = "patient_type") -> list[DataFrame]:
    """Add ``type_id`` to each table and drop rows whose type does not occur in ``seen``."""
    index = type_array(seen, type_col)
    out = []
    for table in tables:
        coded = table.withColumn("type_id", F.array_position(index, F.col(type_col)).cast("int") - 1)
        out.append(coded.where(F.col("type_id") >= 0))
    return out
