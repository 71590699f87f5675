"""Daily census ledger per facility and patient type.

Shape of the work: one pass over the episodes turns each into an admission event and a discharge
event, which are counted per (type, facility, day) with map-side partial aggregation. From there on a
series (type, facility) has at most one row per calendar day, however many episodes a facility has, so
a hot facility cannot make a large window partition. Running census, gap filling and peaks all use that
one series partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike, as_date
from careflow.operators.calendar import in_horizon
from careflow.operators.classify import type_array
from careflow.session import cut_lineage

SERIES = ("patient_type", "facility_id")
DENSE_ROWS_A_TASK = 1_000_000


def movements(
    episodes: DataFrame,
    type_col: str = "patient_type",
    start: DateLike | None = None,
    end: DateLike | None = None,
    id_col: str = "episode_id",
) -> DataFrame:
    """Admissions and discharges per (type, facility, date).

    With ``start`` and ``end`` the scheduled releases of that window are counted in the same pass.
    """
    one = F.col(id_col).isNotNull().cast("long")
    zero = F.lit(0).cast("long")
    names = ["admits", "discharges"]
    admitted = [F.col("admit_date").alias("date"), one.alias("admits"), zero.alias("discharges")]
    left = [F.col("discharge_date").alias("date"), zero.alias("admits"), one.alias("discharges")]
    if start is not None and end is not None:
        names.append("releases")
        admitted.append(zero.alias("releases"))
        left.append(F.when(_is_release(start, end), one).otherwise(zero).alias("releases"))
    return (
        episodes.dropna(subset=[type_col, "facility_id"])
        .select(
            F.col(type_col).alias("patient_type"),
            "facility_id",
            F.inline(F.array(F.struct(*admitted), F.struct(*left))),
        )
        .where("date is not null")
        .groupBy("patient_type", "facility_id", "date")
        .agg(*(F.sum(n).alias(n) for n in names))
    )


def _is_release(start: DateLike, end: DateLike) -> Column:
    first, last = F.lit(as_date(start)), F.lit(as_date(end))
    return (
        (F.col("admit_date") < first)
        & (F.col("discharge_date") > first)
        & (F.col("discharge_date") < last)
    )


def regroup_types(mov: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Merge types of a movement table, e.g. the fine types into the coarse ones.

    Counts add up, so the coarse table comes from the small fine one and not from the episodes.
    """
    renamed = F.col("patient_type")
    for old, new in mapping.items():
        renamed = F.when(F.col("patient_type") == old, new).otherwise(renamed)
    measures = [c for c in mov.columns if c not in (*SERIES, "date")]
    return (
        mov.withColumn("patient_type", renamed)
        .groupBy("patient_type", "facility_id", "date")
        .agg(*(F.sum(c).alias(c) for c in measures))
    )


def scheduled_releases(
    episodes: DataFrame,
    start: DateLike,
    end: DateLike,
    type_col: str = "patient_type",
    id_col: str = "episode_id",
) -> DataFrame:
    """Patients in care before ``start`` who leave strictly inside the window, per day."""
    return (
        episodes.where(_is_release(start, end))
        .dropna(subset=[type_col, "facility_id"])
        .groupBy(
            F.col(type_col).alias("patient_type"), "facility_id", F.col("discharge_date").alias("date")
        )
        .agg(F.count(id_col).alias("releases"))
    )


def _running(keys: tuple[str, ...], date_col: str = "date") -> Column:
    w = W.partitionBy(*keys).orderBy(date_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum("net").over(w)


def running_census(mov: DataFrame, keys: tuple[str, ...] = SERIES, date_col: str = "date") -> DataFrame:
    """Add ``net`` and ``census`` (running sum of net). A patient leaves on the discharge day."""
    return mov.withColumn("net", F.col("admits") - F.col("discharges")).withColumn(
        "census", _running(keys, date_col)
    )


def census_of_nets(rows: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Add ``census`` to rows that carry their ``net``, rows without a date first."""
    return rows.withColumn("census", _running(keys))


def observed_days(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Distinct dates of a table. At most one row per calendar day."""
    return df.select(F.col(date_col).alias("date")).where("date is not null").distinct()


def fill_series(
    sparse: DataFrame,
    keys: tuple[str, ...],
    carry: dict[str, object],
    exact: dict[str, object],
    days: DataFrame | None,
    first: Column,
    last: Column,
    skeleton: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One row per series and day between ``first`` and ``last`` (both included).

    Each sparse row holds until the next row of its series, so it is stretched over those days in place.
    ``carry`` columns keep their value over the stretch, ``exact`` columns only on the row's own day; the
    dict values are the defaults before the first row and on other days. ``skeleton`` lists series that
    may have no row at all.

    With ``days``, the distinct days to fill, a stretch is a slice of their sorted list: a single day far away adds one
    day and not all that lie between. Without it every calendar day from ``first`` to ``last`` is filled. One shuffle by
    series; no join of the dense rows. ``tasks``: how many tasks share the series, otherwise that follows the sparse rows.
    """
    own = F.lit(1)
    measures = [*carry, *exact]
    rows = sparse.select(*keys, "date", own.alias("_own"), *measures)
    series = (skeleton if skeleton is not None else sparse).select(*keys).distinct()
    types = {f.name: f.dataType for f in rows.schema.fields}
    opening = series.select(
        *keys,
        first.alias("date"),
        F.lit(0).alias("_own"),
        *(F.lit(v).cast(types[c]).alias(c) for c, v in carry.items()),
        *(F.lit(v).cast(types[c]).alias(c) for c, v in exact.items()),
    )
    stretched = rows.unionByName(opening)
    if days is None:
        # places are day numbers from ``first``
        n = F.datediff(last, first) + 1
        at = F.least(F.greatest(F.datediff("date", first), F.lit(0)), n)
    else:
        listed = days.where(F.col("date").between(first, last)).agg(F.array_sort(F.collect_set("date"))).scalar()
        n = F.coalesce(F.size(listed), F.lit(0))
        places = sparse.sparkSession.range(1).select(F.posexplode(listed).alias("_place", "_date"))
        # one row per day that occurs at all
        stretched = stretched.join(F.broadcast(places), F.col("date") == F.col("_date"), "left")
        at = F.when((F.col("_own") == 0) | (F.col("date") < first), 0).otherwise(F.coalesce("_place", n))
    if tasks is not None:
        stretched = stretched.repartition(tasks, *keys)
    # An opening row sorts before a real row of the same day and then covers no day. A real row before
    # ``first`` sorts before the opening row, so the opening row takes over its carried values.
    w = W.partitionBy(*keys).orderBy("date", "_own")
    held = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    stretched = stretched.withColumn("_at", at).withColumns(
        {
            "_next": F.coalesce(F.lead("_at").over(w), n),
            **{
                c: F.coalesce(
                    F.last(F.when(F.col("_own") == 1, F.col(c)), ignorenulls=True).over(held), F.col(c)
                )
                for c in carry
            },
        }
    )
    stretched = stretched.where("_at < _next")
    if days is None:
        covered = F.sequence(F.date_add(first, F.col("_at")), F.date_add(first, F.col("_next") - 1))
    else:
        covered = F.slice(listed, F.col("_at") + 1, F.col("_next") - F.col("_at"))
    stretched = stretched.withColumn("_day", F.explode(covered))
    is_own = (F.col("_own") == 1) & (F.col("_day") == F.col("date"))
    return stretched.select(
        *keys,
        F.col("_day").alias("date"),
        *carry,
        *(
            F.when(is_own, F.col(c)).otherwise(F.lit(v).cast(types[c])).alias(c)
            for c, v in exact.items()
        ),
    )


def series_skeleton(df: DataFrame, type_col: str = "patient_type") -> DataFrame:
    """Every facility with every type that occurs anywhere in ``df``."""
    types = type_array(df, type_col)
    return df.select("facility_id").where("facility_id is not null").distinct().select(
        F.explode(types).alias("patient_type"), "facility_id"
    )


def densify(df: DataFrame, measures: tuple[str, ...], calendar: bool = False) -> DataFrame:
    """Every type and facility on every observed date; measures are null where there was no row.

    ``calendar`` also adds the days without any movement.

    The dense rows stay in the tasks of their series, where later windows may sort them, so the number of tasks goes by
    dense rows.
    """
    first, last = (
        df.agg(F.min("date")).scalar(),
        df.agg(F.max("date")).scalar(),
    )
    days, skeleton = observed_days(df), series_skeleton(df)
    n_days = df.agg(F.datediff(F.max("date"), F.min("date")) + 1).first()[0] if calendar else days.count()
    return fill_series(
        df,
        SERIES,
        carry={},
        exact=dict.fromkeys(measures),
        days=None if calendar else days,
        first=first,
        last=last,
        skeleton=skeleton,
        tasks=max(1, -(-skeleton.count() * (n_days or 0) // DENSE_ROWS_A_TASK)),
    )


def forward_fill(
    df: DataFrame,
    cols: tuple[str, ...],
    keys: tuple[str, ...] = SERIES,
    order: str = "date",
    leading: int = 0,
) -> DataFrame:
    """Carry the last known value forward inside each series; leading gaps become ``leading``."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(leading)) for c in cols}
    )


def ledger_from_movements(
    mov: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    calendar: bool = False,
) -> DataFrame:
    """Dense ledger of a movement table (with releases), for start <= date < end or all dates.

    The running census is computed on the sparse rows over the full history. Only the days of the window
    are then generated, so a short window over a long history stays small.
    """
    return ledger_from_running(running_census(mov), start, end, calendar, mov)


def ledger_from_running(
    sparse: DataFrame,
    start: DateLike | None = None,
    end: DateLike | None = None,
    calendar: bool = False,
    mov: DataFrame | None = None,
) -> DataFrame:
    """Dense ledger of sparse rows that carry their running census already, such as those of a store.

    ``mov``: a table with the same series and dates that is cheaper to read, by default the rows themselves.
    """
    mov = sparse if mov is None else mov
    if start is not None and end is not None:
        first = F.lit(as_date(start))
        last = F.lit(as_date(end) - dt.timedelta(days=1))
        days = observed_days(mov.where(in_horizon("date", start, end)))
    else:
        first, last = mov.agg(F.min("date")).scalar(), mov.agg(F.max("date")).scalar()
        days = observed_days(mov)
    return fill_series(
        sparse,
        SERIES,
        carry={"census": 0},
        exact={"admits": 0, "discharges": 0, "net": 0, "releases": 0},
        days=None if calendar else days,
        first=first,
        last=last,
        skeleton=series_skeleton(mov),
    ).select("date", "facility_id", "patient_type", "admits", "discharges", "net", "census", "releases")


def census_ledger(
    episodes: DataFrame,
    start: DateLike,
    end: DateLike,
    type_col: str = "patient_type",
    calendar: bool = False,
) -> DataFrame:
    """Admits, discharges, net, census and releases per (date, facility, type) in the window.

    The movement table is read several times below (series, days, types), so it is written once to the
    checkpoint folder: the episodes are scanned a single time.
    """
    mov = cut_lineage(movements(episodes, type_col, start, end))
    return ledger_from_movements(mov, start, end, calendar)


def peak_census(
    mov: DataFrame, types: tuple[str, ...] = fv.CANCER_TYPES
) -> DataFrame:
    """Largest census ever per (facility, type), positive ones only.

    Taken from the sparse rows over the full history: filling gaps repeats values and adds leading zeros,
    so it cannot change a positive maximum.
    """
    return (
        running_census(mov.where(F.col("patient_type").isin(*types)))
        .groupBy("facility_id", "patient_type")
        .agg(F.max("census").alias("peak"))
        .where("peak > 0")
    )


def census_by_group(
    ledger: DataFrame, types: tuple[str, ...], positive_only: bool = False, name: str = "census"
) -> DataFrame:
    """Census of a group of types per (date, facility)."""
    out = (
        ledger.where(F.col("patient_type").isin(*types))
        .groupBy("date", "facility_id")
        .agg(F.sum("census").alias(name))
    )
    return out.where(F.col(name) > 0) if positive_only else out


def occupancy_report(ledger: DataFrame) -> DataFrame:
    """Cancer, covid, other and total census per (date, facility); missing groups are 0."""
    groups = {"cancer": fv.CANCER_TYPES, "covid": fv.COVID_TYPES, "other": fv.OTHER_TYPES}
    sums = [
        F.sum(F.when(F.col("patient_type").isin(*types), F.col("census")).otherwise(0)).alias(name)
        for name, types in groups.items()
    ]
    return (
        ledger.groupBy("facility_id", "date")
        .agg(*sums)
        .withColumn("total", F.col("cancer") + F.col("covid") + F.col("other"))
    )
