"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow import fixed_values as fv
from careflow.functions import labels
from careflow.session import cut_lineage


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

# Source files by their own column names. Only columns that are used are listed; a CSV reader with a header
# needs the full header in its schema, so ``read_table`` fills in the others as strings.
EPISODES = _schema(
    N_AIH=_L, MUNIC_RES=_L, MUNIC_MOV=_L, CNES=_L, DT_INTER=_I, DT_SAIDA=_I, DIAS_PERM=_I, DIAG_PRINC=_S, PROC_REA=_L
)
STAFF = _schema(CNES=_L, CBO=_L, HORA_AMB=_I, HORAHOSP=_I, HORAOUTR=_I, COMPETEN=_I)
BEDS = _schema(CNES=_L, CODLEITO=_I, TP_LEITO=_I, QT_SUS=_L, COMPETEN=_I)
GEO = _schema(codigo_ibge=_L, latitude=_D, longitude=_D)
DIAGNOSES = _schema(ICD_10=_S, Chapter_Desc=_S)
PROCEDURES = _schema(Codigo=_L, Nome_Grupo_1=_S)
BED_KINDS = _schema(CO_LEITO=_I, TP_LEITO=_I)
OCCUPATIONS = _schema(cod_cbo=_L, Nome_Cbo=_S)

SOURCE_NAMES = {
    "episodes": {
        "N_AIH": "episode_id", "MUNIC_RES": "area_id", "MUNIC_MOV": "facility_area_id", "CNES": "facility_id",
        "DT_INTER": "admit_date", "DT_SAIDA": "discharge_date", "DIAS_PERM": "stay_days",
        "DIAG_PRINC": "diagnosis_code", "PROC_REA": "procedure_code",
    },
    "staff": {
        "CNES": "facility_id", "CBO": "occupation_code", "HORA_AMB": "h_amb", "HORAHOSP": "h_hosp",
        "HORAOUTR": "h_other", "COMPETEN": "month_key",
    },
    "beds": {
        "CNES": "facility_id", "CODLEITO": "bed_code", "TP_LEITO": "bed_kind", "QT_SUS": "qty",
        "COMPETEN": "month_key",
    },
    "geo": {"codigo_ibge": "code_full", "latitude": "lat", "longitude": "lon"},
}
SOURCE_SCHEMAS = {"episodes": EPISODES, "staff": STAFF, "beds": BEDS, "geo": GEO}

LOOKUP_FILES = {
    "diagnoses": ("deParaCID.csv", DIAGNOSES),
    "procedures": ("deparaProcedimentos.csv", PROCEDURES),
    "beds": ("deParaLeitos.csv", BED_KINDS),
    "occupations": ("deParaCBO.csv", OCCUPATIONS),
}


class RejectedRows(ValueError):
    """Some rows of a source cannot be read as their schema says."""


REJECTED = "_rejected"


def settle(df: DataFrame, source: str, rejects: str | None) -> DataFrame:
    """Rows whose ``_rejected`` column is null, without that column, from one pass over the source.

    The pass parses every row, counts the rejected ones and writes all of them to the checkpoint folder; whoever reads the
    result, however often, reads that narrow table and not the source. Rejected rows are written to ``rejects`` as Parquet,
    or, without such a path, are an error that tells their number. Nothing is dropped in silence.
    """
    wanted = [c for c in df.columns if c != REJECTED]
    found = Observation()
    written = cut_lineage(df.observe(found, F.count(REJECTED).alias("n")))
    n = found.get["n"]
    if n and rejects is None:
        raise RejectedRows(f"{source}: {n} rows don't fit the schema; give a path for rejects to go on without them")
    if rejects is not None:
        bad = written.where(F.col(REJECTED).isNotNull())
        values = F.to_json(F.struct(*wanted)).alias("values")
        bad.select(F.lit(source).alias("source"), F.col(REJECTED).alias("row"), values).write.mode("append").parquet(rejects)
    return written.where(F.col(REJECTED).isNull()).select(*wanted)


def _checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to ``schema``, with ``_rejected`` if any column has another type than it should have."""
    own = {f.name: f.dataType for f in df.schema.fields}
    cast = [f for f in schema.fields if own.get(f.name) != f.dataType]
    if not cast:
        return df.select(*schema.names)
    fits = [F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull() for f in cast]
    rejected = F.when(~reduce(and_, fits), F.to_json(F.struct(*schema.names)))
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields), rejected.alias(REJECTED))


def _parsed(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str, encoding: str, whole_lines: bool
) -> DataFrame:
    """The columns of ``schema``, and ``_rejected`` where a row can be rejected at all."""
    if fmt != "csv":
        return _checked(spark.read.format(fmt).load(path), schema)
    reader = spark.read.option("header", True).option("sep", ",").option("encoding", encoding)
    header = reader.csv(path).columns
    known = {f.name: f for f in schema.fields}
    missing = [n for n in known if n not in header]
    if missing:
        raise ValueError(f"{path}: columns not found: {missing}")
    placed = [known.get(n, T.StructField(n, T.StringType())) for n in header]
    reader = reader.option("enforceSchema", False).option("columnPruning", not whole_lines)
    reader = reader.option("columnNameOfCorruptRecord", REJECTED)
    df = reader.schema(T.StructType([*placed, T.StructField(REJECTED, T.StringType())])).csv(path)
    return df.select(*schema.names, REJECTED)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "csv",
    columns: Iterable[str] | None = None,
    encoding: str = fv.CSV_ENCODING,
    rejects: str | None = None,
    whole_lines: bool = True,
) -> DataFrame:
    """Read a table and keep ``columns`` (default: those of ``schema``).

    Types come from ``schema``, never from the data. For CSV the header line is read once to place the
    schema's columns; all others are read as text and left out. Every file's own header is checked
    against it, so files whose columns come in another order are an error and never read into the wrong columns. Other
    formats carry their own names and are cast to the schema; if their types are those of the schema, nothing can be
    rejected and the table stays a plain scan. A value that doesn't fit its type rejects its row, see ``settle``; values
    of columns that are not kept reject nothing.

    With ``whole_lines`` a CSV line with too few or too many values is rejected as well. Without it the parser takes only
    the columns that are kept, which is faster on wide files, and cannot see such lines: what is missing is null.
    """
    wanted = list(columns) if columns is not None else None
    if schema is None:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True).option("sep", ",").option("encoding", encoding)
        df = reader.load(path)
        return df.select(*wanted) if wanted else df
    if wanted is not None:
        unknown = [n for n in wanted if n not in schema.names]
        if unknown:
            raise ValueError(f"{path}: columns not in the schema: {unknown}")
        schema = T.StructType([schema[n] for n in wanted])
    df = _parsed(spark, path, schema, fmt, encoding, whole_lines)
    return settle(df, path, rejects) if REJECTED in df.columns else df


def read_source(
    spark: SparkSession, path: str, kind: str, fmt: str = "csv", rejects: str | None = None, whole_lines: bool = True
) -> DataFrame:
    """One of the source tables (``episodes``, ``staff``, ``beds``, ``geo``) in this library's vocabulary.

    Date keys that are no dates reject their rows like other bad values, in the same pass.
    """
    from careflow.functions.calendar import from_date_key

    raw = _parsed(spark, path, SOURCE_SCHEMAS[kind], fmt, fv.CSV_ENCODING, whole_lines)
    names = SOURCE_NAMES[kind]
    rejected = [REJECTED] if REJECTED in raw.columns else []
    df = raw.select(*(F.col(old).alias(new) for old, new in names.items()), *rejected)
    dates = [c for c in ("admit_date", "discharge_date") if c in df.columns]
    if dates:
        bad = reduce(or_, (F.col(c).isNotNull() & from_date_key(c).isNull() for c in dates))
        row = F.when(bad, F.to_json(F.struct(*names.values())))
        df = df.withColumn(REJECTED, F.coalesce(*rejected, row))
        df = df.withColumns({c: from_date_key(c) for c in dates})
    return settle(df, path, rejects) if REJECTED in df.columns else df


def read_lookups(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The four lookups in the form the classifiers take."""
    raw = {
        name: read_table(spark, f"{folder.rstrip('/')}/{file}", schema, fmt)
        for name, (file, schema) in LOOKUP_FILES.items()
    }
    cancer = F.col("Chapter_Desc").eqNullSafe(fv.CANCER_CHAPTER)
    covid = F.col("ICD_10").eqNullSafe(fv.COVID_CODE)
    return {
        "diagnoses": raw["diagnoses"].select(
            F.col("ICD_10").alias("code"),
            labels.disease_group(cancer, covid).alias("disease"),
            labels.disease_group_coarse(cancer).alias("disease_coarse"),
        ),
        "procedures": raw["procedures"].select(
            F.col("Codigo").alias("code"), labels.procedure_group(F.col("Nome_Grupo_1")).alias("treatment")
        ),
        "beds": raw["beds"].select(
            F.col("CO_LEITO").alias("code"),
            labels.bed_group(F.col("CO_LEITO"), F.col("TP_LEITO")).alias("bed_group"),
        ),
        "occupations": raw["occupations"].select(F.col("cod_cbo").alias("code"), F.col("Nome_Cbo").alias("name")),
    }


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Iterable[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a table; ``partition_by`` takes the place of values in file names."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    parts = list(partition_by)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.save(path)
