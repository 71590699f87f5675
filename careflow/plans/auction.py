"""Assignment under capacity by an auction: near the cheapest one, however many rows want the same facility.

Every (weight, type, day) is a transport problem of its own. A row with open patients bids for its cheapest facilities, each
up to what it has room for, and for each as much as it can without paying more than for the next one on its list. A
facility keeps the highest bids that it has room for; its price is the lowest of them once it is full. Who is outbid bids
again at the new prices. When nobody is left, no row can do better by more than epsilon at these prices, so the whole costs at
most epsilon a patient more than the optimum - if no facility with room to spare has a price.

Epsilon goes down in phases (scaling): coarse ones find prices in a few rounds, and finer ones start from them. Days without
rivals end in the first round. Days on which a phase leaves an old price on a facility with spare room are auctioned once
more, with that price at 0; this ends, since a price that has been put to 0 comes from bids alone from then on.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.operators.params import weight_array
from careflow.plans.allocation import BOUNDS, CELL_KEY, DEMAND_KEY, DEPTH, Offers, reach_all, unit_cost
from careflow.session import cut_lineage

log = logging.getLogger(__name__)

GROUP = ["weight", "patient_type", "date"]
PHASES = (64, 16, 4, 1)  # epsilon of each phase, in units of the last one
UNLIMITED = fv.OVERFLOW_BEDS


def overflow_costs(
    od: DataFrame,
    exposure: DataFrame,
    weight_values: list[float],
    bounds: DataFrame,
    area_days: DataFrame,
    attack: float = fv.ATTACK_FACTOR,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> DataFrame:
    """(weight, area_id, date, cost) of a patient in the overflow facility, for the area-days of ``area_days``."""
    b = bounds.select(F.struct(*BOUNDS)).scalar()
    there = reach_all(od, area_days, overflow).where(F.col("facility_id") == overflow).select("area_id", "km")
    rows = area_days.select("area_id", "date").distinct().join(there, "area_id", "left")
    rows = rows.join(exposure.where(F.col("facility_id") == overflow).select("date", "exposure"), "date", "left")
    cost = unit_cost(F.col("weight"), F.coalesce("km", F.lit(float(fv.OVERFLOW_KM))), F.coalesce("exposure", F.lit(0)), b, attack)
    return rows.withColumn("weight", F.explode(weight_array(weight_values))).select("weight", "area_id", "date", cost.alias("cost"))


def relative_epsilon(
    od: DataFrame,
    exposure: DataFrame,
    weight_values: list[float],
    bounds: DataFrame,
    part: float = 0.001,
    attack: float = fv.ATTACK_FACTOR,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> dict[float, float]:
    """For each weight, ``part`` of what the farthest and most exposed real facility would cost."""
    b = bounds.select(F.struct(*BOUNDS)).scalar()
    real = F.col("facility_id") != overflow
    far = od.where(real).agg(F.max("km")).scalar()
    met = F.coalesce(exposure.where(real).agg(F.max("exposure")).scalar(), F.lit(0))
    weights = bounds.sparkSession.range(1).select(F.explode(weight_array(weight_values)).alias("weight"))
    rows = weights.select("weight", unit_cost(F.col("weight"), far, met, b, attack).alias("cost")).collect()
    return {r["weight"]: part * (r["cost"] or 0.0) for r in rows}


def _bids(rows: DataFrame, held: DataFrame, priced: DataFrame, offers: Offers, over: DataFrame, epsilon: Column, overflow: int, depth: int) -> DataFrame:
    """What open rows bid: DEMAND_KEY, facility_id, n, bid. The overflow facility takes all and has no price."""
    own = held.groupBy(*DEMAND_KEY, "facility_id").agg(F.sum("n").alias("own"))
    met = offers(rows, priced, depth).join(own, [*DEMAND_KEY, "facility_id"], "left")
    room = F.col("room") - F.coalesce("own", F.lit(0).cast("long"))
    met = met.select(*DEMAND_KEY, "qty", "facility_id", "cost", "toll", room.alias("cap")).where("cap > 0")
    last = rows.join(over, ["weight", "area_id", "date"]).select(
        *DEMAND_KEY, "qty", F.lit(overflow).cast(met.schema["facility_id"].dataType).alias("facility_id"), "cost",
        F.lit(0.0).alias("toll"), F.lit(UNLIMITED).cast("long").alias("cap"),
    )
    mine = W.partitionBy(*DEMAND_KEY)
    in_order = mine.orderBy("cost", F.col("facility_id") == overflow, "facility_id")
    listed = met.unionByName(last).withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= depth)
    by_rank = mine.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    listed = listed.withColumn("upto", F.sum("cap").over(by_rank))
    # the first facility that still has room behind this row; if the list ends before, its last one is only a mark
    spare = F.min(F.when(F.col("upto") > F.col("qty"), F.col("cost"))).over(mine)
    listed = listed.withColumns({"spare": spare, "end": F.max("rank").over(mine), "top": F.max("cost").over(mine)})
    before = F.col("upto") - F.col("cap")
    asked = listed.where((before < F.col("qty")) & (F.col("spare").isNotNull() | (F.col("rank") < F.col("end"))))
    bid = F.when(F.col("facility_id") == overflow, 0.0).otherwise(F.col("toll") + F.coalesce("spare", "top") - F.col("cost") + epsilon)
    return asked.select(*DEMAND_KEY, "facility_id", F.least("cap", F.col("qty") - before).alias("n"), bid.alias("bid"))


def _kept(bids: DataFrame, room: DataFrame, overflow: int) -> DataFrame:
    """The highest bids of each facility up to its room; the last one may be cut. A cell has few bids of each area."""
    real = bids.where(F.col("facility_id") != overflow)
    best = W.partitionBy(*CELL_KEY).orderBy(F.col("bid").desc(), "area_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = real.join(room, CELL_KEY).withColumn("before", F.sum("n").over(best) - F.col("n"))
    kept = ranked.withColumn("n", F.least(F.col("n"), F.col("room") - F.col("before"))).where("n > 0")
    return kept.select(bids.columns).unionByName(bids.where(F.col("facility_id") == overflow))


def _prices(held: DataFrame, room: DataFrame, start: DataFrame | None) -> DataFrame:
    """CELL_KEY, room, filled, begun (price before the phase) and toll: the lowest bid if full, else ``begun``."""
    sums = held.groupBy(*CELL_KEY).agg(F.sum("n").alias("filled"), F.min("bid").alias("low"))
    priced = room.join(sums, CELL_KEY, "left")
    priced = priced.join(start, CELL_KEY, "left") if start is not None else priced.withColumn("begun", F.lit(0.0))
    begun = F.coalesce("begun", F.lit(0.0))
    full = F.coalesce("filled", F.lit(0).cast("long")) >= F.col("room")
    return priced.select(*CELL_KEY, "room", full.alias("is_full"), begun.alias("begun"), F.when(full, F.col("low")).otherwise(begun).alias("toll"))


def _phase(rows: DataFrame, room: DataFrame, start: DataFrame | None, offers: Offers, over: DataFrame, epsilon: Column, overflow: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Rounds until no row has open patients: (held units with their bids, groups that took more than one round).

    Groups that are done in the first round leave the others. The driver sees one boolean per round.
    """
    parts, open_rows, rounds, contested = [], rows, 0, None
    held = rows.select(*DEMAND_KEY, F.lit(overflow).cast(room.schema["facility_id"].dataType).alias("facility_id"), F.col("qty").alias("n"), F.lit(0.0).alias("bid")).limit(0)
    while True:
        priced = _prices(held, room, start).select(*CELL_KEY, "room", "toll")
        fresh = _bids(open_rows, held, priced, offers, over, epsilon, overflow, depth)
        held = cut_lineage(_kept(held.unionByName(fresh.select(held.columns)), room, overflow))
        has = held.groupBy(*DEMAND_KEY).agg(F.sum("n").alias("has"))
        left = rows.join(has, DEMAND_KEY, "left").withColumn("qty", F.col("qty") - F.coalesce("has", F.lit(0).cast("long")))
        open_rows = cut_lineage(left.where("qty > 0").drop("has"))
        rounds += 1
        if open_rows.isEmpty():
            log.info("phase ends after %d rounds", rounds)
            return reduce(DataFrame.unionByName, [*parts, held]), contested
        if contested is None:  # most groups have no rivals and end here
            contested = cut_lineage(open_rows.select(*GROUP).distinct())
            parts.append(held.join(contested, GROUP, "left_anti"))
            held, rows, room = (cut_lineage(x.join(contested, GROUP, "left_semi")) for x in (held, rows, room))


def assign_by_auction(
    demand: DataFrame,
    offers: Offers,
    free: DataFrame,
    over: DataFrame,
    epsilon: dict[float, float],
    phases: tuple[float, ...] = PHASES,
    overflow: int = fv.OVERFLOW_FACILITY,
    depth: int = DEPTH,
) -> DataFrame:
    """(weight, patient_type, area_id, facility_id, date, qty) within ``epsilon`` (by weight) a patient of the cheapest plan.

    ``demand``, ``offers`` and ``free`` are as in ``assign_with_capacity``; ``over`` is what the overflow facility costs
    (weight, area_id, date, cost), which takes whoever it is cheapest for at the prices. An epsilon of 0 is an error where
    rows compete; costs that are all 0 need none.
    """
    if min(epsilon.values(), default=1.0) < 0 or phases[-1] != 1:
        raise ValueError("epsilon must not be negative, and the last phase has it as it is")
    least = max(epsilon.values(), default=0.0) or 1.0
    step = F.create_map(*(F.lit(float(x)) for w, e in epsilon.items() for x in (w, e or 1e-6 * least)))
    step = F.try_element_at(step, F.col("weight"))
    rows = cut_lineage(demand.select(*DEMAND_KEY, F.col("qty").cast("long").alias("qty")).where("qty > 0"))
    room = free.where((F.col("room") > 0) & (F.col("facility_id") != overflow)).select(*CELL_KEY, F.col("room").cast("long").alias("room"))
    room = cut_lineage(room.join(rows.select(*GROUP).distinct(), GROUP, "left_semi"))
    over = cut_lineage(over)
    done, start, held = [], None, None
    for k, factor in enumerate(phases):
        held, contested = _phase(rows, room, start, offers, over, step * factor, overflow, depth)
        if k == 0 and contested is not None:
            # whoever had no rival has the cheapest facility
            done.append(held.join(contested, GROUP, "left_anti"))
            rows, room = (cut_lineage(x.join(contested, GROUP, "left_semi")) for x in (rows, room))
            held = held.join(contested, GROUP, "left_semi")
        if contested is None and k == 0:
            break
        if k + 1 < len(phases):
            lower = F.greatest(F.lit(0.0), F.col("toll") - step * factor)
            start = _prices(held, room, start).where("is_full").select(*CELL_KEY, lower.alias("begun")).where("begun > 0")
            start = cut_lineage(start)
    while start is not None:
        # a price from before on a facility with spare room is not backed by demand: it starts from 0 in one more auction
        priced = cut_lineage(_prices(held, room, start))
        unbacked = priced.where(~F.col("is_full") & (F.col("begun") > 0))
        idle = cut_lineage(unbacked.select(*GROUP).distinct())
        if idle.isEmpty():
            break
        done.append(held.join(idle, GROUP, "left_anti"))
        rows, room = (cut_lineage(x.join(idle, GROUP, "left_semi")) for x in (rows, room))
        backed = F.when(F.col("is_full"), F.least("begun", F.greatest(F.lit(0.0), F.col("toll") - step))).otherwise(0.0)
        start = priced.join(idle, GROUP, "left_semi").select(*CELL_KEY, backed.alias("begun")).where("begun > 0")
        start = cut_lineage(start)
        held, _ = _phase(rows, room, start, offers, over, step, overflow, depth)
    held = reduce(DataFrame.unionByName, [*done, held])
    found = held.groupBy(*DEMAND_KEY, "facility_id").agg(F.sum("n").alias("qty"))
    return found.select("weight", "patient_type", "area_id", "facility_id", "date", "qty")
