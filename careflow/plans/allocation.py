"""Assignment of demand to facilities, and the evaluation of such plans.

A plan is (weight, patient_type, area_id, facility_id, date, qty). All objective weights live in one
table; nothing loops over them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike, as_date
from careflow.operators.capacity import hours_needed
from careflow.operators.ledger import fill_series
from careflow.operators.params import other_weight, weight_array
from careflow.session import cut_lineage

DEMAND_KEY = ["weight", "patient_type", "area_id", "date"]
CELL_KEY = ["weight", "patient_type", "facility_id", "date"]
SCOPE = ["weight", "patient_type", "date"]
SPREAD_ROWS_A_TASK = 500_000  # ways x days
DEPTH = 32  # options of a row that are looked at together
BOUNDS = ("best_distance", "worst_distance", "best_infection", "worst_infection")


# --- unit costs -----------------------------------------------------------------------------------


def reach_all(
    od: DataFrame, areas: DataFrame, overflow: int = fv.OVERFLOW_FACILITY, km: float = fv.OVERFLOW_KM
) -> DataFrame:
    """``od`` with the way to the overflow facility for every area in ``areas`` that has no distance at all.

    Areas are made distinct before they are looked up: a written column with few values looks small to Spark, and all ways
    would be broadcast through the driver.
    """
    there = od.select("area_id", "facility_id", "km")
    lost = areas.select("area_id").distinct().join(there.select("area_id").distinct(), "area_id", "left_anti")
    facility = F.lit(overflow).cast(od.schema["facility_id"].dataType).alias("facility_id")
    return there.unionByName(lost.select("area_id", facility, F.lit(float(km)).alias("km")))


def located_exposure(od: DataFrame, exposure: DataFrame, area_days: DataFrame) -> DataFrame:
    """(area_id, date, facility_id, km, exposure) for the area-days that occur in ``area_days``.

    Exposure of a (facility, day) without a row is 0. An area without any distance has the overflow facility alone.

    Days are put into one row per area and exposures into one per facility, both no longer than the calendar. So ways
    are shuffled and not ways x days, and the days are spread in place at the end; the number of tasks goes by the spread
    rows. Without the hint the exposures could be broadcast through the driver, since sizes are estimated before the days
    are gathered.
    """
    ways = reach_all(od, area_days)
    tasks = 1 + ways.count() * area_days.select("date").distinct().count() // SPREAD_ROWS_A_TASK
    days = area_days.select("area_id", "date").distinct().groupBy("area_id").agg(F.collect_list(F.struct("date")).alias("_days"))
    none = F.lit(0).cast("long")
    seen = (
        exposure.where("date is not null")
        .repartition(tasks, "facility_id")
        .groupBy("facility_id", "date")
        .agg(F.collect_list(F.coalesce("exposure", none)).alias("_here"))  # one value, unless rows repeat
        .groupBy("facility_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("date", "_here"))).alias("_seen"))
    )

    def of_day(d: Column) -> Column:
        here = F.coalesce(F.try_element_at("_seen", d["date"]), F.array(none))
        return F.transform(here, lambda e: F.struct(d["date"].alias("date"), e.alias("exposure")))

    return (
        ways.repartition(tasks, "facility_id")
        .join(seen.hint("merge"), "facility_id", "left")
        .join(days, "area_id")
        .select("area_id", "facility_id", "km", F.inline(F.flatten(F.transform("_days", of_day))))
    )


def objective_bounds(
    demand: DataFrame,
    od: DataFrame,
    exposure: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> DataFrame:
    """Smallest and largest total distance and infection, with and without the overflow facility.

    Sum of demand x cheapest / dearest unit cost: exact while capacity does not bind. One row.

    Distance does not depend on the day, and exposure on the area only through the facilities that it can reach.
    So distances are reduced per area, exposures per day and set of facilities (areas mostly share one), and both are
    joined to the demand totals; nothing is spread over areas x days x facilities. Unlocated areas reach the overflow
    facility only and have no share in the totals without it.
    """
    real = F.col("facility_id") != overflow
    ways = reach_all(od, demand, overflow)
    areas = ways.groupBy("area_id").agg(
        F.min("km").alias("d0"),
        F.max("km").alias("d1"),
        F.min(F.when(real, F.col("km"))).alias("rd0"),
        F.max(F.when(real, F.col("km"))).alias("rd1"),
        F.count_distinct("facility_id").alias("n"),
        F.count_distinct(F.when(real, F.col("facility_id"))).alias("rn"),
        F.bit_xor(F.xxhash64("facility_id")).alias("reach"),
    )
    sample = areas.groupBy("n", "reach").agg(F.min("area_id").alias("area_id"))
    # the hint is for the side: one row per set of facilities against one per way, which may look smaller
    members = ways.join(F.broadcast(sample), "area_id").select("n", "reach", "facility_id").distinct()
    by_day = (
        exposure.join(members.hint("merge"), "facility_id")
        .groupBy("n", "reach", "date")
        .agg(
            F.min("exposure").alias("e0"),
            F.max("exposure").alias("e1"),
            F.count("*").alias("seen"),
            F.min(F.when(real, F.col("exposure"))).alias("re0"),
            F.max(F.when(real, F.col("exposure"))).alias("re1"),
            F.count(F.when(real, F.lit(1))).alias("rseen"),
        )
    )
    zero = F.lit(0).cast("long")

    def least(low: str, seen: str, n: str) -> Column:
        """A facility without a row has exposure 0."""
        return F.when(F.col(n) == 0, None).when(F.col(seen) >= F.col(n), F.col(low)).otherwise(zero)

    def most(high: str, seen: str, n: str) -> Column:
        return F.when(F.col(n) == 0, None).otherwise(F.coalesce(high, zero))

    unit = {
        "e0": least("e0", "seen", "n"),
        "e1": most("e1", "seen", "n"),
        "re0": least("re0", "rseen", "rn"),
        "re1": most("re1", "rseen", "rn"),
    }
    wanted = demand.groupBy("area_id", "date").agg(F.sum("qty").alias("qty"))
    rows = wanted.join(areas, "area_id").join(by_day, ["n", "reach", "date"], "left")
    rows = rows.withColumns({"seen": F.coalesce("seen", zero), "rseen": F.coalesce("rseen", zero)}).withColumns(unit)

    def total(col: str, factor: float = 1.0) -> Column:
        return F.coalesce(F.sum(F.col("qty") * F.col(col)) * F.lit(factor), F.lit(0.0))

    return rows.agg(
        total("d0").alias("best_distance"),
        total("d1").alias("worst_distance"),
        total("e0", attack).alias("best_infection"),
        total("e1", attack).alias("worst_infection"),
        total("rd0").alias("best_distance_real"),
        total("rd1").alias("worst_distance_real"),
        total("re0", attack).alias("best_infection_real"),
        total("re1", attack).alias("worst_infection_real"),
    )


def _spread(bounds: Column, kind: str) -> Column:
    return F.nullif(bounds[f"worst_{kind}"] - bounds[f"best_{kind}"], F.lit(0.0))


def _one_row(bounds: DataFrame) -> Column:
    return bounds.select(F.struct(*BOUNDS)).scalar()


def unit_cost(weight: Column, km: Column, exposure: Column, bounds: Column, attack: float) -> Column:
    """Weighted, normalised cost of one patient. A term whose bounds coincide cannot decide and is 0."""
    distance = F.coalesce(weight * km / _spread(bounds, "distance"), F.lit(0.0))
    infection = F.coalesce(
        other_weight(weight) * F.lit(attack) * exposure / _spread(bounds, "infection"), F.lit(0.0)
    )
    return distance + infection


def pair_costs(
    od: DataFrame,
    exposure: DataFrame,
    weight_values: list[float],
    bounds: DataFrame,
    area_days: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
) -> DataFrame:
    """(weight, area_id, facility_id, date, cost) for every area-day with demand and every facility."""
    b = _one_row(bounds)
    return (
        located_exposure(od, exposure, area_days)
        .withColumn("weight", F.explode(weight_array(weight_values)))
        .select(
            "weight",
            "area_id",
            "facility_id",
            "date",
            unit_cost(F.col("weight"), F.col("km"), F.col("exposure"), b, attack).alias("cost"),
        )
    )


# --- assignment -----------------------------------------------------------------------------------


def assign_lowest_cost(demand: DataFrame, costs: DataFrame, overflow: int = fv.OVERFLOW_FACILITY) -> DataFrame:
    """Every demand row to its cheapest facility, ties to the smallest facility id, the overflow facility last.

    Optimal when neither beds nor staff bind, a lower bound otherwise. The choice per (weight, area, day) is shared by all
    patient types. Cost tables of ``pair_costs`` hold the overflow facility for areas without coordinates, so their demand is
    assigned there.

    The least cost is found first and written (a row per weight, area and day), then the smallest facility at that cost. An
    order over several columns in one aggregate would sort all costs before they are combined; plain minima are hashed.
    """
    keys, number = ["weight", "area_id", "date"], F.col("facility_id")
    least = cut_lineage(costs.groupBy(*keys).agg(F.min("cost").alias("_least"), F.max(F.col("cost").isNull()).alias("_unknown")))
    # as in an order over columns, null comes first
    least = least.select(*(F.col(k).alias(f"_{k}") for k in keys), F.expr("if(_unknown, null, _least)").alias("_least"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    at_least = costs.join(least, [*same, F.col("cost").eqNullSafe(F.col("_least"))])
    best = at_least.groupBy(*keys).agg(
        F.min(F.when(number != overflow, number)).alias("_real"), F.min(number).alias("_any"), F.max(number.isNull()).alias("_null")
    )
    best = best.select(*keys, F.expr("if(_null, null, coalesce(_real, _any))").alias("facility_id"))
    return _placed(demand, best)


def _placed(demand: DataFrame, best: DataFrame) -> DataFrame:
    """The plan that puts every demand row into the facility that ``best`` has for its weight, area and day."""
    located = demand.join(best, ["area_id", "date"])
    columns = ["weight", "patient_type", "area_id", "facility_id", "date", F.col("qty").cast("long").alias("qty")]
    return located.select(*columns)


def assign_cheapest(
    demand: DataFrame,
    od: DataFrame,
    exposure: DataFrame,
    weight_values: list[float],
    bounds: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
) -> DataFrame:
    """``assign_lowest_cost`` straight from distances and exposure, without the full cost table.

    Seen from one area, facilities of the same town are equally far. Of those only two can win a day: the one
    with the least exposure, and the smallest id where exposure has no weight. So each (area, day, distance)
    is reduced to these two, with map-side combining, before the weights multiply the rows.
    """
    b = _one_row(bounds)
    candidates = (
        located_exposure(od, exposure, demand)
        .groupBy("area_id", "date", "km")
        .agg(
            F.min(F.struct("exposure", "facility_id")).alias("safest"),
            F.min(F.struct("facility_id", "exposure")).alias("first"),
        )
        .select(
            "area_id",
            "date",
            "km",
            F.explode(
                F.array(
                    F.struct(F.col("safest.facility_id").alias("id"), F.col("safest.exposure").alias("exposure")),
                    F.struct(F.col("first.facility_id").alias("id"), F.col("first.exposure").alias("exposure")),
                )
            ).alias("c"),
        )
        .select("area_id", "date", F.explode(weight_array(weight_values)).alias("weight"), "km", "c.id", "c.exposure")
    )
    cost = unit_cost(F.col("weight"), F.col("km"), F.col("exposure"), b, attack)
    best = candidates.groupBy("weight", "area_id", "date").agg(
        F.min_by("id", F.struct(cost, F.col("id") == fv.OVERFLOW_FACILITY, "id")).alias("facility_id")
    )
    return _placed(demand, best)


def effective_beds(
    beds: DataFrame, hours: DataFrame, hours_per_patient: dict[str, int] = fv.HOURS_PER_PATIENT
) -> DataFrame:
    """(patient_type, facility_id, date, room): beds, or fewer if the staff hours cannot serve them."""
    per = F.nullif(hours_needed(hours_per_patient), F.lit(0))
    served = F.floor(F.coalesce("hours", F.lit(0)) / per).cast("long")
    # merged, not broadcast: days that are spread from months make tables look small
    return beds.join(hours.hint("merge"), ["facility_id", "date"], "left").select(
        "patient_type", "facility_id", "date", F.least("beds", served).alias("room")
    )


#: (open rows, room, depth) -> rows with facility_id, cost and room; at least the ``depth`` cheapest offers of each row.
#: If ``room`` has a toll, it is part of the cost and is returned too. With depth ``None`` the rows carry ``wanted``, which is
#: returned too, and each gets at least its cheapest offers whose rooms add up to that, or all.
Offers = Callable[[DataFrame, DataFrame, int | None], DataFrame]


def distance_classes(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facility_id, class_id) and (area_id, class_id, km): facilities that are equally far from every area share a class."""
    seen = F.array_sort(F.collect_list(F.struct("area_id", "km")))  # at most one entry per area
    members = cut_lineage(ways.groupBy("facility_id").agg(F.md5(F.to_json(seen)).alias("class_id")))
    return members, cut_lineage(ways.join(members, "facility_id").groupBy("area_id", "class_id").agg(F.min("km").alias("km")))


def real_classes(od: DataFrame, overflow: int = fv.OVERFLOW_FACILITY) -> tuple[DataFrame, DataFrame]:
    """``distance_classes`` of the real facilities."""
    return distance_classes(od.where(F.col("facility_id") != overflow).select("area_id", "facility_id", "km"))


def offers_by_cost(costs: DataFrame, overflow: int = fv.OVERFLOW_FACILITY) -> Offers:
    """Real facilities with room for open rows, priced by a cost table."""
    priced = costs.where(F.col("facility_id") != overflow)

    def offers(rows: DataFrame, room: DataFrame, depth: int | None) -> DataFrame:
        free = room.where((F.col("room") > 0) & (F.col("facility_id") != overflow))
        met = rows.join(priced, ["weight", "area_id", "date"]).join(free, CELL_KEY)
        return met.withColumn("cost", F.col("cost") + F.col("toll")) if "toll" in room.columns else met

    return offers


def offers_by_distance(
    od: DataFrame,
    exposure: DataFrame,
    bounds: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> Offers:
    """The same from distance per (area, facility) and exposure per (day, facility), which stay apart.

    Only rows that are still open meet facilities that still have room; no table of all costs is built. Facilities at the
    same distances form classes, and in each the ``depth`` with the least exposure come first, whatever the area. A row
    goes through classes as branch and bound does: ``depth`` offers of near classes give a bound, and a class whose best
    offer is above it is not opened. Without a depth the same is done with rooms up to ``wanted`` in place of offers.
    """
    b = _one_row(bounds)
    members, ways = real_classes(od, overflow)
    group = ["weight", "patient_type", "date", "class_id"]
    nothing = F.lit(0).cast("long")

    def offers(rows: DataFrame, room: DataFrame, depth: int | None) -> DataFrame:
        tolls = ["toll"] if "toll" in room.columns else []
        goal = ["wanted"] if depth is None else []
        free = room.where((F.col("room") > 0) & (F.col("facility_id") != overflow)).select(*CELL_KEY, "room", *tolls)
        if depth is None:
            free = free.join(rows.select(*SCOPE, "wanted").distinct(), SCOPE)
        # without the hint written exposures of many facilities are broadcast through the driver, since their files are small
        seen = exposure.hint("shuffle_hash") if depth is None else exposure
        free = free.join(seen, ["date", "facility_id"], "left").join(members, "facility_id")
        unit = unit_cost(F.col("weight"), F.lit(0.0), F.coalesce("exposure", nothing), b, attack)
        unit = unit + F.col("toll") if tolls else unit
        free = free.select(*group, "facility_id", "room", unit.alias("unit"), *tolls, *goal)
        way = unit_cost(F.col("weight"), F.col("km"), nothing, b, attack)
        met = rows.join(ways, "area_id").withColumn("way", way)
        order = W.partitionBy(*group).orderBy("unit", "facility_id")
        if depth is None:
            before = F.sum("room").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("room")
            # written, it looks small to Spark, which would broadcast it through the driver without the hint
            near = cut_lineage(free.withColumn("_before", before).where("_before < wanted").drop("_before", "wanted")).hint("merge")
            held, enough = F.sum("room"), F.col("wanted")
        else:
            near = free.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= depth).drop("_n")
            held, enough = F.count("*"), F.lit(depth)
        ends = near.groupBy(*group).agg(held.alias("_n"), F.min("unit").alias("_low"), F.max("unit").alias("_high"))
        own = W.partitionBy(*DEMAND_KEY)
        so_far = own.orderBy(F.col("way") + F.col("_high"), "class_id").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = met.join(ends.hint("merge") if depth is None else ends, group).withColumn("_sum", F.sum("_n").over(so_far))
        bound = F.min(F.when(F.col("_sum") >= enough, F.col("way") + F.col("_high"))).over(own)
        met = met.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("way") + F.col("_low") <= F.col("_bound")))
        met = met.join(near, group).withColumn("cost", F.col("way") + F.col("unit"))
        if depth is None:
            met = met.where("_bound is null or cost <= _bound")
        return met.select(*DEMAND_KEY, "qty", "facility_id", "cost", "room", *tolls, *goal)

    return offers


def _rounds(kind: pa.Schema, first: dt.date, n: int, overflow: int, depth: int, unlimited: int) -> Callable[..., pa.Table]:
    """All rounds of proposals of one weight and type over the ``n`` days of a segment (see ``place_in_rounds``).

    An inner function, which reaches executors that do not have this package.
    """
    import numpy as np

    def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
        """The entries of a column of lists, and for each the row that it belongs to."""
        lists = column.combine_chunks()
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()

    def place(key: tuple, series: pa.Table, rows: pa.Table) -> pa.Table:
        area, ids = rows["area_id"].to_pylist(), series["facility_id"].to_numpy()
        los = int(series["los"][0].as_py()) if len(ids) else 1
        block = max(los, 1)
        free, unit = np.zeros((len(ids), n), np.int64), np.zeros((len(ids), n))
        code = np.zeros(len(ids), np.int64)
        way = np.full((len(area), 1), np.inf)
        if len(ids):
            free = lists_of(series["free"])[1].to_numpy(zero_copy_only=False).reshape(-1, n).copy()
            who, seen = lists_of(series["seen"])
            least = np.full((len(ids), n), np.inf)
            np.minimum.at(least, (who, seen.field("day").to_numpy(zero_copy_only=False)), seen.field("unit").to_numpy(zero_copy_only=False))
            unit = np.where(np.isfinite(least), least, 0.0)
            coded = series["class_id"].combine_chunks().dictionary_encode()
            code, names = coded.indices.to_numpy(), {c: i for i, c in enumerate(coded.dictionary.to_pylist())}
            way = np.full((len(area), len(names)), np.inf)
            whose, there = lists_of(rows["ways"])
            known = [(i, names[c], w) for i, c, w in zip(whose, there.field("class_id").to_pylist(), there.field("way").to_pylist(), strict=True) if c in names]
            for i, c, w in known:
                way[i, c] = w

        def rooms(left: np.ndarray) -> np.ndarray:
            """Smallest free value over the days that a patient coming in on a day would stay."""
            if los <= 0:
                return np.full_like(left, unlimited)
            low = left.copy()
            for k in range(1, min(los, n)):
                low[:, : n - k] = np.minimum(low[:, : n - k], left[:, k:])
            return np.maximum(low, 0)

        room = rooms(free)
        order = [np.lexsort((ids, unit[:, d], code)) for d in range(n)]
        whose, wanted = lists_of(rows["wanted"])
        open_ = {(i, d): q for i, d, q in zip(whose.tolist(), wanted.field("day").to_pylist(), wanted.field("qty").to_pylist(), strict=True)}
        placed: dict[tuple, int] = {}
        while open_:
            lists, queue = {}, []
            for d in sorted({d for _, d in open_}):
                some = order[d][room[order[d], d] > 0]
                c = code[some]
                near = some[np.arange(len(c)) - np.searchsorted(c, c) < depth]  # the first of each class
                units, classes, numbers = unit[near, d], code[near], ids[near]
                for i in [i for i, day in open_ if day == d]:
                    cost = way[i, classes] + units
                    at = np.flatnonzero(cost < np.inf)
                    if len(at) > depth:
                        at = at[cost[at] <= np.partition(cost[at], depth - 1)[depth - 1]]
                    at = at[np.lexsort((numbers[at], cost[at]))[:depth]]
                    if len(at):
                        lists[i, d] = near[at], cost[at]
                        queue.append((near[at[0]], d // block, d, cost[at[0]], area[i], i))
            for i, d in [k for k in open_ if k not in lists]:
                placed[i, overflow, d] = placed.get((i, overflow, d), 0) + open_.pop((i, d))
            ahead: dict[tuple, int] = {}
            asked: dict[int, dict[int, list]] = {}
            for h, part, d, _, _, i in sorted(queue):
                before, q = ahead.get((h, part), 0), open_[i, d]
                ahead[h, part] = before + q
                there, cost = lists[i, d]
                upto = np.cumsum(room[there, d])
                asks = np.minimum(upto, before + q) - np.maximum(upto - room[there, d], before)
                for k in np.flatnonzero(asks > 0).tolist():
                    asked.setdefault(int(there[k]), {}).setdefault(d, []).append((cost[k], area[i], i, int(asks[k])))
            for h, days in asked.items():
                for d in sorted(days):
                    fits = max(0, int(free[h, d : d + los].min())) if los > 0 else unlimited
                    for _, _, i, q in sorted(days[d]):
                        got = min(q, fits)
                        if not got:
                            break
                        fits -= got
                        if los > 0:
                            free[h, d : d + los] -= got
                        placed[i, int(ids[h]), d] = placed.get((i, int(ids[h]), d), 0) + got
                        open_[i, d] -= got
            open_ = {k: q for k, q in open_.items() if q}
            changed = np.array(list(asked), np.int64)
            room[changed] = rooms(free[changed])
        at = list(placed)
        columns = [[k.as_py()] * len(at) for k in key]
        columns += [[area[i] for i, _, _ in at], [h for _, h, _ in at], [first + dt.timedelta(days=d) for _, _, d in at], list(placed.values())]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return place


def place_in_rounds(
    demand: DataFrame,
    ways: DataFrame,
    series: DataFrame,
    bounds: DataFrame,
    first: dt.date,
    n: int,
    attack: float = fv.ATTACK_FACTOR,
    overflow: int = fv.OVERFLOW_FACILITY,
    depth: int = DEPTH,
    tasks: int = 88,
) -> DataFrame:
    """Rounds of proposals until every row of a segment of ``n`` days from ``first`` is placed.

    ``ways`` is (area_id, class_id, km), ``series`` (weight, patient_type, facility_id, class_id, los, free, seen): the free
    value of each day, which counts patients for ``los`` days, and (date, exposure) of days with any.

    In each round a row lists its ``depth`` cheapest real facilities with room for the whole stay. A row whose competitors
    (same weight, type, first choice and block of days of a stay, earlier or cheaper) already claim ``ahead`` places asks those
    of its own list that hold the places ``ahead`` to ``ahead + qty``, so a crowded facility does not cost one round per refused
    row. A facility takes what fits in day order, on each day the cheapest first, then the smallest area. What it cannot take
    tries again; a row behind so many that its list has no place for it asks nobody this time. Room never grows, so a row
    without room anywhere goes to the overflow facility, and the loop ends.

    Rows only compete inside a weight and type, so one task walks through all rounds of these: no job for a round. It holds one
    row per area and one per facility, with an array of the segment's days each; facilities without room on any day stay
    outside.
    """
    b = _one_row(bounds)
    rows = demand.select(*DEMAND_KEY, F.col("qty").cast("long").alias("qty")).where("qty > 0")
    rows = rows.groupBy(*DEMAND_KEY).agg(F.sum("qty").alias("qty"))
    group, nothing = ["weight", "patient_type"], F.lit(0).cast("long")
    own = rows.groupBy(*group, "area_id").agg(F.collect_list(F.struct(F.datediff("date", F.lit(first)).alias("day"), "qty")).alias("wanted"))
    near = ways.groupBy("area_id").agg(F.collect_list(F.struct("class_id", "km")).alias("ways"))
    priced = lambda km, exposure: unit_cost(F.col("weight"), km, exposure, F.col("_b"), attack)
    own = own.join(near, "area_id").withColumn("_b", b).withColumn(
        "ways", F.transform("ways", lambda w: F.struct(w["class_id"].alias("class_id"), priced(w["km"], nothing).alias("way")))
    )
    inside = lambda s: s["date"].between(F.lit(first), F.lit(first + dt.timedelta(days=n - 1)))
    held = series.where((F.col("facility_id") != overflow) & F.exists("free", lambda x: x > 0)).withColumn("_b", b).withColumn(
        "seen",
        F.transform(
            F.filter(F.coalesce("seen", F.array().cast(series.schema["seen"].dataType)), inside),
            lambda s: F.struct(
                F.datediff(s["date"], F.lit(first)).alias("day"), priced(F.lit(0.0), F.coalesce(s["exposure"], nothing)).alias("unit")
            ),
        ),
    )
    kind = T.StructType([*(rows.schema[k] for k in (*group, "area_id")), series.schema["facility_id"], rows.schema["date"], rows.schema["qty"]])
    place = _rounds(to_arrow_schema(kind), first, n, overflow, depth, fv.OVERFLOW_BEDS)
    held = held.select(*group, "facility_id", "class_id", "los", "free", "seen").repartition(tasks, *group)
    own = own.select(*group, "area_id", "ways", "wanted").repartition(tasks, *group)
    placed = held.groupBy(*group).cogroup(own.groupBy(*group)).applyInArrow(place, kind)
    lost = rows.join(ways.select("area_id").distinct(), "area_id", "left_anti")
    columns = ["weight", "patient_type", "area_id", "facility_id", "date", "qty"]
    facility = F.lit(overflow).cast(series.schema["facility_id"].dataType).alias("facility_id")
    return placed.select(*columns).unionByName(lost.select("*", facility).select(*columns))


def _walker(kind: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """The rounds of proposals of one weight, type and day, whose rows bring their lists of offers.

    An inner function, which reaches executors that do not have this package.
    """

    def walk(offers: pa.Table) -> pa.Table:
        key = [offers[k][0] for k in kind.names[:3]]
        area, rank, facility, cost, qty, n = (offers[k].to_pylist() for k in ("area_id", "_rank", "facility_id", "cost", "qty", "room"))
        room, left = dict(zip(facility, n, strict=True)), dict(zip(area, qty, strict=True))
        lists: dict[int, list] = {a: [] for a in left}
        for i in sorted(range(len(rank)), key=rank.__getitem__, reverse=True):
            lists[area[i]].append((cost[i], facility[i]))  # the next offer is the last one
        placed = []
        while left:
            bids: dict[int, list] = {}
            for a in left:
                own = lists[a]
                while own and not room[own[-1][1]]:
                    own.pop()
                if own:
                    bids.setdefault(own[-1][1], []).append((own[-1][0], a))
            still = {}
            for h, asks in bids.items():
                for _, a in sorted(asks):
                    got = min(left[a], room[h])
                    room[h] -= got
                    if got:
                        placed.append((a, h, got))
                    if got < left[a]:
                        still[a] = left[a] - got
            left = still
        columns = [[k.as_py()] * len(placed) for k in key] + [list(c) for c in zip(*placed, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return walk


def assign_with_capacity(
    demand: DataFrame, costs: DataFrame | Offers, free: DataFrame, overflow: int = fv.OVERFLOW_FACILITY
) -> DataFrame:
    """Greedy assignment under capacity, each (weight, type, day) on its own.

    ``demand`` is (weight, patient_type, area_id, date, qty), ``free`` is (weight, patient_type,
    facility_id, date, room) with a row for each cell, ``costs`` a cost table or ``offers_by_distance``. A heuristic: never
    above ``room``, all demand placed (what fits nowhere goes to the overflow facility), equal to ``assign_lowest_cost`` with
    room to spare, not proven optimal.

    In rounds, a row proposes to its cheapest facility with room, ties to the smallest id, and a facility takes the cheapest
    proposals first, ties to the smallest area. A full facility stays full, and all rows of a weight, type and day together
    want no more than their total, so a row finds its places among the cheapest facilities whose rooms add up to that. These
    lists hold all that the rounds of such a group need, and one task walks through them: no job for a round, however many
    there are. A group has the areas' lists, which grow with the demand of a day and not with the facilities.
    """
    offers = offers_by_cost(costs, overflow) if isinstance(costs, DataFrame) else costs
    rows = demand.where("qty > 0").groupBy(*DEMAND_KEY).agg(F.sum("qty").cast("long").alias("qty"))
    rows = cut_lineage(rows.join(rows.groupBy(*SCOPE).agg(F.sum("qty").alias("wanted")), SCOPE, "left"))
    met = offers(rows, free.select(*CELL_KEY, "room"), None).repartition(*SCOPE)
    own = W.partitionBy(*DEMAND_KEY).orderBy("cost", "facility_id")
    before = F.sum("room").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("room")
    needed = met.withColumns({"_rank": F.row_number().over(own), "_before": before}).where("_before < wanted")
    # as Spark sorts: null first, NaN last
    cost = F.nanvl(F.coalesce("cost", F.lit(float("-inf"))), F.lit(float("inf")))
    needed = needed.select(*DEMAND_KEY, "qty", "facility_id", "room", "_rank", cost.alias("cost"))
    kind = T.StructType([*(rows.schema[k] for k in (*SCOPE, "area_id")), met.schema["facility_id"], T.StructField("qty", T.LongType())])
    placed = cut_lineage(needed.groupBy(*SCOPE).applyInArrow(_walker(to_arrow_schema(kind)), kind).select(*DEMAND_KEY, "facility_id", "qty"))
    open_ = rows.select(*DEMAND_KEY, "qty").unionByName(placed.select(*DEMAND_KEY, (-F.col("qty")).alias("qty")))
    lost = open_.groupBy(*DEMAND_KEY).agg(F.sum("qty").alias("qty")).where("qty > 0")
    facility = F.lit(overflow).cast(met.schema["facility_id"].dataType).alias("facility_id")
    columns = ["weight", "patient_type", "area_id", "facility_id", "date", "qty"]
    return placed.select(*columns).unionByName(lost.select("*", facility).select(*columns))


# --- evaluation -----------------------------------------------------------------------------------


def plan_census(
    plan: DataFrame,
    initial: DataFrame,
    releases: DataFrame,
    los: DataFrame,
    start: DateLike,
    end: DateLike,
    weight_values: list[float],
) -> DataFrame:
    """(weight, patient_type, facility_id, date, census) on every day start <= date < end.

    Patients come in on their day, leave after their length of stay, and the initial ones as released.
    ``initial`` and ``releases`` carry a weight column if they differ by weight, otherwise they count for
    every one of ``weight_values``. Series without any patient have no rows (census 0).
    """
    first, last = as_date(start), as_date(end) - dt.timedelta(days=1)
    all_weights = weight_array(weight_values)

    def weighted(df: DataFrame) -> DataFrame:
        return df if "weight" in df.columns else df.withColumn("weight", F.explode(all_weights))

    def change(df: DataFrame, date: Column, amount: Column) -> DataFrame:
        return df.select(
            "weight", "patient_type", "facility_id", date.alias("date"), amount.cast("long").alias("change")
        )

    stays = plan.groupBy(*CELL_KEY).agg(F.sum("qty").alias("qty")).join(los, "patient_type")
    moves = stays.select(
        "weight",
        "patient_type",
        "facility_id",
        F.inline(
            F.array(
                F.struct(F.col("date").alias("date"), F.col("qty").alias("change")),
                F.struct(
                    F.date_add("date", F.col("los").cast("int")).alias("date"), (-F.col("qty")).alias("change")
                ),
            )
        ),
    )
    all_changes = (
        moves.unionByName(change(weighted(initial), F.lit(first), F.col("census")))
        .unionByName(
            change(
                weighted(releases.where(F.col("date").between(F.lit(first), F.lit(last)))),
                F.col("date"),
                -F.col("releases"),
            )
        )
        .where(F.col("date") <= F.lit(last))
        .withColumn("date", F.greatest("date", F.lit(first)))
        .groupBy(*CELL_KEY)
        .agg(F.sum("change").alias("change"))
    )
    keys = ("weight", "patient_type", "facility_id")
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return fill_series(
        all_changes.withColumn("census", F.sum("change").over(w)),
        keys,
        carry={"census": 0},
        exact={},
        days=None,
        first=F.lit(first),
        last=F.lit(last),
    ).select("weight", "patient_type", "facility_id", "date", "census")


def score_plan(
    plan: DataFrame,
    od: DataFrame,
    exposure: DataFrame,
    bounds: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Distance cost, infection cost, their normalised forms and the weighted total, per weight.

    Every assigned patient counts; a way without a known distance is as long as that to the overflow facility.
    """
    b = _one_row(bounds)
    keys = ["weight", *by]
    flows = plan.groupBy(*keys, "area_id", "facility_id", "date").agg(F.sum("qty").alias("qty"))
    sums = (
        flows.join(od.select("area_id", "facility_id", "km"), ["area_id", "facility_id"], "left")
        .withColumn("km", F.coalesce("km", F.lit(float(fv.OVERFLOW_KM))))
        .join(exposure, ["date", "facility_id"], "left")
        .groupBy(*keys)
        .agg(
            F.sum(F.col("qty") * F.col("km")).alias("distance_cost"),
            (F.sum(F.col("qty") * F.coalesce("exposure", F.lit(0))) * F.lit(attack)).alias("infection_cost"),
        )
    )
    distance = (F.col("distance_cost") - b["best_distance"]) / _spread(b, "distance")
    infection = (F.col("infection_cost") - b["best_infection"]) / _spread(b, "infection")
    return sums.select(
        *keys,
        "distance_cost",
        "infection_cost",
        distance.alias("distance_norm"),
        infection.alias("infection_norm"),
        (
            F.col("weight") * F.coalesce(distance, F.lit(0.0))
            + other_weight(F.col("weight")) * F.coalesce(infection, F.lit(0.0))
        ).alias("total"),
    )


def carry_over(census: DataFrame, last_day: DateLike) -> DataFrame:
    """(weight, patient_type, facility_id, census): patients still there on the last day of a segment."""
    return census.where((F.col("date") == F.lit(as_date(last_day))) & (F.col("census") > 0)).select(
        "weight", "patient_type", "facility_id", "census"
    )


def plan_history(*plans: DataFrame) -> DataFrame:
    """Assigned rows of all segments so far."""
    out = plans[0]
    for plan in plans[1:]:
        out = out.unionByName(plan)
    return out.where("qty > 0")
