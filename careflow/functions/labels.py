"""Case rules of the lookups as column expressions. The first rule that holds wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from careflow import fixed_values as fv


def disease_group(is_cancer: Column, is_covid: Column) -> Column:
    """Fine disease label of a diagnosis row."""
    return F.when(is_cancer, fv.CANCER).when(is_covid, fv.COVID).otherwise(fv.OTHER)


def disease_group_coarse(is_cancer: Column) -> Column:
    """Coarse disease label: covid counts as other."""
    return F.when(is_cancer, fv.CANCER).otherwise(fv.OTHER)


def procedure_group(group_name: Column, surgical: str = fv.SURGICAL_GROUP) -> Column:
    """Surgery or clinical treatment, from the name of the procedure group."""
    return F.when(group_name == surgical, fv.SURGERY).otherwise(fv.CLINICAL)


def bed_group(
    bed_code: Column,
    bed_kind: Column,
    cancer_surgery: Iterable[int] = fv.CANCER_SURGERY_BED_CODES,
    cancer_clinical: Iterable[int] = fv.CANCER_CLINICAL_BED_CODES,
    surgical_kinds: Iterable[int] = fv.SURGICAL_BED_KINDS,
) -> Column:
    """Patient type (coarse) that a bed can take."""
    return (
        F.when(bed_code.isin(*cancer_surgery), "CANCER_SURGERY")
        .when(bed_code.isin(*cancer_clinical), "CANCER_CLINICAL")
        .when(bed_kind.isin(*surgical_kinds), "OTHER_SURGERY")
        .otherwise("OTHER_CLINICAL")
    )
