"""One query per operator on the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow import fixed_values as fv
from careflow.bindings.views import CONFIG, EXCLUDED_AREAS, SURGICAL, Views
from careflow.functions import labels
from careflow.functions.calendar import (
    as_date,
    date_key,
    end_of,
    from_date_key,
    segment_starts,
    shift_date_key,
    weekday_of,
)
from careflow.functions.geo import haversine_km
from careflow.operators import calendar as cal
from careflow.operators import capacity as cap
from careflow.operators import checks
from careflow.operators import classify as cls
from careflow.operators import demand as dem
from careflow.operators import geography as geo
from careflow.operators import ledger as led
from careflow.operators import params as par
from careflow.operators import reports as rep
from careflow.operators import resources as res
from careflow.plans import allocation as alloc
from careflow.plans import dual
from careflow.plans import preparation as prep
from careflow.plans.exchange import exchange
from careflow.plans.horizon import plan_segments as run_segments
from careflow.session import cut_lineage, scratch_folder
from careflow.sources import ledger_store, param_store, tables

START, END, DAYS = CONFIG.start, CONFIG.end, CONFIG.days
SEGMENTS = 7
FIRST_SEGMENT_LAST = segment_starts(START, DAYS, SEGMENTS)[0][1]
WEIGHTS = par.weights(0.1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


# --- shared intermediate tables -------------------------------------------------------------------


def _movements(v: Views) -> DataFrame:
    return v.once("movements", lambda: led.movements(v.classified(), "patient_type", START, END))


def _coarse(v: Views) -> DataFrame:
    return v.once("coarse", lambda: led.regroup_types(_movements(v), prep.COARSE_OF))


def _beds(v: Views) -> DataFrame:
    return res.daily_beds(v.beds(), START, END)


def _staff_days(v: Views) -> DataFrame:
    return res.daily_staff(v.staff(), START, END)


def _frame(v: Views, floor: bool) -> DataFrame:
    return prep.bed_frame(_coarse(v), _beds(v), None, CONFIG, floor)


def _wide(v: Views, floor: bool = True) -> DataFrame:
    return cap.pivot_types(_frame(v, floor))


def _long(v: Views) -> DataFrame:
    return prep.dynamic_beds(_frame(v, True))


def _demand(v: Views) -> DataFrame:
    return v.once("demand", lambda: prep.project_baseline(v.kept(), CONFIG))


def _region_daily(v: Views) -> DataFrame:
    rows = v.classified().withColumn("area_id", F.col("region_id"))
    return dem.daily_demand(rows, CONFIG.baseline_start, CONFIG.baseline_end)


def _od(v: Views, homes: DataFrame) -> DataFrame:
    places = v.once("places", lambda: v.kept().select("facility_id", "facility_area_id").distinct())
    km = geo.area_distances(homes, places, v.coordinates())
    return geo.add_overflow_distance(geo.facility_distances(km, places), areas=homes)


def _covid(v: Views) -> DataFrame:
    ledger = led.ledger_from_movements(_movements(v), START, END)
    return led.census_by_group(ledger, fv.COVID_TYPES)


def _exposure(v: Views) -> DataFrame:
    return res.infection_exposure(res.overflow_census(_covid(v)), res.staff_headcount(_staff_days(v)))


def _los(v: Views) -> DataFrame:
    return v.once("los", lambda: dem.avg_length_of_stay(v.kept(), START, END, fv.CANCER_TYPES))


class _Plan:
    """Tables the plan queries share: demand, distance, exposure, bounds, costs and the cheapest plan.

    Movements, demand, places and lengths of stay all come from one written table of the episodes.
    """

    def __init__(self, v: Views, weights: list[float] = WEIGHTS):
        v.keep()
        self.v = v
        self.demand = cut_lineage(_demand(v).where(cal.in_horizon("date", START, END)))
        self.od = cut_lineage(_od(v, self.demand))
        self.exposure = cut_lineage(_exposure(v))
        first = self.demand.where(F.col("date") <= F.lit(FIRST_SEGMENT_LAST))
        self.bounds = cut_lineage(alloc.objective_bounds(first, self.od, self.exposure))
        self.costs = alloc.pair_costs(self.od, self.exposure, weights, self.bounds, self.demand)
        self.plan = alloc.assign_cheapest(self.demand, self.od, self.exposure, weights, self.bounds)

    def written(self) -> _Plan:
        """The plan on disk, for queries that read it more than once."""
        self.plan = cut_lineage(self.plan)
        return self


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# --- A: exchange form ------------------------------------------------------------------------------


@query
def param_table(v: Views) -> DataFrame:
    types = cls.type_array(v.classified())
    return par.param_to_table(_demand(v), "qty", types)


def _folder(v: Views, name: str) -> str:
    return f"{scratch_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query
def read_table(v: Views) -> DataFrame:
    """Orders written as CSV with a column more than is read, and read again by schema."""
    path = _folder(v, "orders")
    cols = ["o_orderkey", date_key(F.col("o_orderdate")).alias("o_orderdate"), "o_custkey"]
    tables.write_table(v.table("orders").select(*cols, F.lit("é,").alias("o_note")), path, "csv")
    schema = T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("o_orderdate", T.IntegerType())])
    return tables.read_table(v.spark, path, schema, encoding="UTF-8")


@query
def read_lookups(v: Views) -> DataFrame:
    """The four lookups, made from parts and suppliers, written as CSV and read again."""
    folder = _folder(v, "lookups")
    part, supplier = v.table("part"), v.table("supplier")
    chapter = F.when(F.col("p_type") == "PROMO", fv.CANCER_CHAPTER).otherwise(F.col("p_type"))
    group = F.when(F.col("p_size") > 25, fv.SURGICAL_GROUP).otherwise("x")
    sources = {
        "diagnoses": part.select(F.concat(F.lit("P"), "p_partkey").alias("ICD_10"), chapter.alias("Chapter_Desc")),
        "procedures": part.select(F.col("p_partkey").alias("Codigo"), group.alias("Nome_Grupo_1")),
        "beds": supplier.select(F.col("s_suppkey").alias("CO_LEITO"), (F.col("s_suppkey") % 3).alias("TP_LEITO")),
        "occupations": supplier.select(F.col("s_suppkey").alias("cod_cbo"), F.col("s_name").alias("Nome_Cbo")),
    }
    for name, df in sources.items():
        df.write.option("header", True).option("encoding", fv.CSV_ENCODING).csv(f"{folder}/{tables.LOOKUP_FILES[name][0]}")
    read = tables.read_lookups(v.spark, folder)
    values = {"diagnoses": "disease", "procedures": "treatment", "beds": "bed_group", "occupations": "name"}
    rows = (
        read[n].select(F.lit(n).alias("lookup"), F.col("code").cast("string").alias("code"), F.col(c).alias("value"))
        for n, c in values.items()
    )
    return reduce(DataFrame.unionByName, rows)


@query
def write_table(v: Views) -> DataFrame:
    """Flow counts written by type and read again."""
    path = _folder(v, "flows")
    tables.write_table(dem.flow_counts(v.classified()), path, "parquet", ["patient_type"])
    return v.spark.read.parquet(path).select("patient_type", "area_id", "date", "qty")


@query
def save_params(v: Views) -> DataFrame:
    """Beds and staff hours saved as a run and loaded again."""
    base, made = _folder(v, "store"), {"beds": _beds(v), "hours": res.staff_hours(_staff_days(v))}
    run = param_store.run_id(START, DAYS, {"seed": CONFIG.seed}, made)
    param_store.save_params(made, base, run)
    found = param_store.load_params(v.spark, base, run)
    hours = found["hours"].select("facility_id", F.lit(None).cast("string").alias("patient_type"), "date", F.col("hours").alias("amount"))
    return found["beds"].select("facility_id", "patient_type", "date", F.col("beds").alias("amount")).unionByName(hours)


# --- B: classification -----------------------------------------------------------------------------


@query
def disease_group(v: Views) -> DataFrame:
    return v.diagnoses().select("code", "disease")


@query
def disease_group_coarse(v: Views) -> DataFrame:
    return v.diagnoses().select("code", "disease_coarse")


@query
def procedure_group(v: Views) -> DataFrame:
    name = F.when(F.col("procedure_code") == "R", SURGICAL).when(F.col("procedure_code") == "A", "CLINICAL")
    return v.episodes().select(
        "episode_id", "diagnosis_code", labels.procedure_group(name, SURGICAL).alias("treatment")
    )


@query
def bed_group(v: Views) -> DataFrame:
    group = labels.bed_group(F.col("bed_code"), F.col("bed_kind"))
    return v.bed_rows().select("facility_id", "bed_code", "month_key", group.alias("bed_group"))


@query
def classify_episodes(v: Views) -> DataFrame:
    return v.classified().select(
        "episode_id", "diagnosis_code", "facility_id", "admit_date", "patient_type", "patient_type_coarse"
    )


@query
def classify_beds(v: Views) -> DataFrame:
    return v.beds().select("facility_id", "bed_code", "month_key", "qty", "bed_group")


@query
def classify_staff(v: Views) -> DataFrame:
    return v.staff()


@query
def encode_types(v: Views) -> DataFrame:
    episodes = v.classified()
    seen = episodes.where(cal.in_horizon("admit_date", START, END))
    return cls.encode_types(seen, dem.flow_counts(episodes))[0]


# --- C: calendar -----------------------------------------------------------------------------------


@query
def shift_date_key_query(v: Views) -> DataFrame:
    key = date_key("admit_date")
    return v.episodes().select(
        "episode_id",
        "diagnosis_code",
        key.alias("admit_key"),
        shift_date_key(key, F.col("stay_days")).alias("later_key"),
        shift_date_key(key, -F.col("stay_days")).alias("earlier_key"),
    )


@query
def date_key_query(v: Views) -> DataFrame:
    key = date_key("o_orderdate")
    return v.table("orders").select(
        "o_orderkey", key.alias("order_key"), from_date_key(key).alias("order_date"),
        weekday_of("o_orderdate").alias("weekday"),
    )


@query
def date_spine(v: Views) -> DataFrame:
    episodes = v.episodes()
    spine = cal.observed_span(episodes, "admit_date", "discharge_date")
    counts = episodes.groupBy(F.col("admit_date").alias("date")).agg(F.count("episode_id").alias("admits"))
    return spine.join(counts, "date", "left").select("date", F.coalesce("admits", F.lit(0)).alias("admits"))


@query
def monthly_to_daily(v: Views) -> DataFrame:
    return cal.expand_monthly_to_daily(v.bed_rows(), START, END).select("facility_id", "bed_code", "qty", "date")


@query
def split_horizon(v: Views) -> DataFrame:
    days = v.episodes().groupBy(F.col("admit_date").alias("date")).agg(F.count("episode_id").alias("admits"))
    return cal.split_horizon(days, START, DAYS, SEGMENTS)


@query
def slice_by_segment(v: Views) -> DataFrame:
    return cal.slice_by_segment(dem.flow_counts(v.classified()), START, DAYS, SEGMENTS)


# --- D: geography ----------------------------------------------------------------------------------


@query
def haversine(v: Views) -> DataFrame:
    at = v.coordinates()
    home = at.select("area_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = at.select(F.col("area_id").alias("facility_area_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return (
        v.episodes().join(home, "area_id").join(there, "facility_area_id")
        .select("episode_id", "diagnosis_code", "facility_id", F.round(km, 6).alias("km"))
    )


@query
def area_distances(v: Views) -> DataFrame:
    e = v.episodes()
    return _rounded(geo.area_distances(e, e, v.coordinates()), "km")


@query
def facility_distances(v: Views) -> DataFrame:
    e = v.episodes()
    return _rounded(geo.facility_distances(geo.area_distances(e, e, v.coordinates()), e), "km")


@query
def overflow_distance(v: Views) -> DataFrame:
    return _rounded(_od(v, v.kept()), "km")


@query
def restrict_od(v: Views) -> DataFrame:
    return _rounded(geo.restrict_od(_od(v, v.kept()), _demand(v), v.kept()), "km")


# --- E: demand -------------------------------------------------------------------------------------


@query
def daily_demand(v: Views) -> DataFrame:
    return dem.daily_demand(v.classified(), CONFIG.baseline_start, CONFIG.baseline_end, fv.CANCER_TYPES)


@query
def weekday_profile(v: Views) -> DataFrame:
    return _rounded(dem.weekday_profile(_region_daily(v)), "qty")


@query
def project_demand(v: Views) -> DataFrame:
    return _rounded(dem.project_demand(dem.weekday_profile(_region_daily(v)), START, END), "qty")


@query
def integerize_demand(v: Views) -> DataFrame:
    projected = dem.project_demand(dem.weekday_profile(_region_daily(v)), START, END)
    return dem.integerize_demand(cut_lineage(projected), None, CONFIG.seed)


@query
def integerize_demand_prefix(v: Views) -> DataFrame:
    return prep.project_baseline(v.classified(), replace(CONFIG, area_prefix="11"))


@query
def flow_counts(v: Views) -> DataFrame:
    return dem.flow_counts(v.classified())


@query
def length_of_stay(v: Views) -> DataFrame:
    return dem.avg_length_of_stay(v.classified(), START, END)


# --- F: ledger -------------------------------------------------------------------------------------


@query
def movements(v: Views) -> DataFrame:
    return led.movements(v.classified())


@query
def running_census(v: Views) -> DataFrame:
    return led.running_census(led.movements(v.classified()))


@query
def scheduled_releases(v: Views) -> DataFrame:
    return led.scheduled_releases(v.classified(), START, END)


def _by_procedure(v: Views) -> DataFrame:
    return cut_lineage(led.running_census(led.movements(v.episodes(), "procedure_code")))


@query
def densify(v: Views) -> DataFrame:
    return led.densify(_by_procedure(v), ("admits", "discharges", "census"))


@query
def forward_fill(v: Views) -> DataFrame:
    dense = led.densify(_by_procedure(v), ("census",))
    return led.forward_fill(dense, ("census",))


@query
def census_ledger(v: Views) -> DataFrame:
    return led.census_ledger(v.classified(), START, END)


@query
def census_ledger_coarse(v: Views) -> DataFrame:
    return led.census_ledger(v.classified(), START, END, "patient_type_coarse")


@query
def census_ledger_history(v: Views) -> DataFrame:
    mov = cut_lineage(led.movements(v.episodes(), "procedure_code", START, END))
    return led.ledger_from_movements(mov)


@query
def census_ledger_batches(v: Views) -> DataFrame:
    """A stored ledger of the episodes of the early years, to which the other years are added one batch after another."""
    path, episodes = _folder(v, "ledger"), v.episodes()
    year = F.year("admit_date")

    def mov(some: DataFrame) -> DataFrame:
        return led.movements(some, "procedure_code", START, END)

    ledger_store.start_ledger(mov(episodes.where(year.isNull() | (year < 1997))), path, buckets=16)
    ledger_store.add_batch(mov(episodes.where(year == 1997)), path, "y1997")
    ledger_store.add_batch(mov(episodes.where(year > 1997)), path, "later")
    return led.ledger_from_running(ledger_store.running_rows(v.spark, path))


@query
def peak_census(v: Views) -> DataFrame:
    return led.peak_census(led.movements(v.classified(), "patient_type_coarse"))


@query
def census_by_group(v: Views) -> DataFrame:
    ledger = led.census_ledger(v.classified(), START, END)
    return led.census_by_group(ledger, fv.OTHER_TYPES, positive_only=True)


@query
def occupancy_report(v: Views) -> DataFrame:
    return led.occupancy_report(led.census_ledger(v.classified(), START, END))


# --- G: resources ----------------------------------------------------------------------------------


@query
def daily_beds(v: Views) -> DataFrame:
    return _beds(v)


@query
def daily_staff(v: Views) -> DataFrame:
    return _staff_days(v)


@query
def staff_headcount(v: Views) -> DataFrame:
    return res.staff_headcount(_staff_days(v))


@query
def staff_hours(v: Views) -> DataFrame:
    return res.staff_hours(_staff_days(v))


@query
def overflow_census(v: Views) -> DataFrame:
    return res.overflow_census(_covid(v))


@query
def infection_exposure(v: Views) -> DataFrame:
    return _exposure(v)


@query
def infected_census(v: Views) -> DataFrame:
    return res.infected_census(res.overflow_census(_covid(v)))


# --- H: capacity -----------------------------------------------------------------------------------


@query
def attach_beds(v: Views) -> DataFrame:
    mov = _coarse(v)
    return cap.attach_beds(led.ledger_from_movements(mov, START, END), _beds(v), led.peak_census(mov))


@query
def overflow_beds(v: Views) -> DataFrame:
    return _frame(v, False)


@query
def floor_beds(v: Views) -> DataFrame:
    return _frame(v, True)


@query
def pivot_types(v: Views) -> DataFrame:
    return _wide(v)


@query
def borrow_beds(v: Views) -> DataFrame:
    return cap.borrow_beds(_wide(v, floor=False)).select(
        "date", "facility_id", "free_other_CLINICAL", "free_other_SURGERY", "dynamic_beds_CLINICAL", "dynamic_beds_SURGERY"
    )


@query
def unpivot_types(v: Views) -> DataFrame:
    return cap.unpivot_types(cap.borrow_beds(_wide(v, floor=False)))


@query
def floor_beds_initial(v: Views) -> DataFrame:
    return _long(v)


@query
def bed_adjust_audit(v: Views) -> DataFrame:
    return cap.bed_adjust_audit(cap.borrow_beds(_wide(v)))


@query
def raise_capacity(v: Views) -> DataFrame:
    """Day-by-day load against beds and hours."""
    long = cut_lineage(_long(v))
    hours = res.staff_hours(_staff_days(v))
    history = v.classified().where(
        F.col("patient_type").isin(*fv.CANCER_TYPES) & (F.col("admit_date") < F.lit(START).cast("date"))
    ).groupBy("patient_type", "facility_id", F.col("admit_date").alias("date")).agg(F.count("episode_id").alias("qty"))
    beds, staff = cap.raise_capacity(
        long, hours, par.initial_census(long), history, par.release_table(long), _los(v), START, END
    )
    cols = ["kind", "patient_type", "facility_id", "date", "before", "after", "raised"]
    return beds.select(F.lit("beds").alias("kind"), "*", F.col("beds").alias("after")).select(*cols).unionByName(
        staff.select(
            F.lit("hours").alias("kind"), F.lit(None).cast("string").alias("patient_type"), "*", F.col("hours").alias("after")
        ).select(*cols)
    )


# --- I: parameter tables ---------------------------------------------------------------------------


@query
def initial_census(v: Views) -> DataFrame:
    return par.initial_census(cut_lineage(_long(v)))


@query
def release_table(v: Views) -> DataFrame:
    return par.release_table(_long(v))


@query
def capacity_table(v: Views) -> DataFrame:
    return par.capacity_table(_long(v))


@query
def index_sets(v: Views) -> DataFrame:
    return par.index_sets(_demand(v), v.kept(), START, DAYS)


def _sums(name: str, df: DataFrame) -> DataFrame:
    """Rows and, per number column, the sum of a table; text columns count their distinct values."""
    columns = [c for c in ("qty", "beds", "releases", "census", "los", "km", "exposure", "hours", "type_id") if c in df.columns]
    if not columns:
        value = F.count_distinct("member")
    elif columns[0] == "km":
        value = F.round(F.sum(F.round("km", 6)), 3)
    else:  # whole numbers are summed exactly
        value = F.sum(columns[0])
    keys = [F.count_distinct(c) for c in df.columns if c not in columns]
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(value.cast("double"), F.lit(0.0)).alias("total"),
        sum(keys, F.lit(0)).cast("long").alias("n_keys"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "total", "n_keys")


@query
def build_params(v: Views) -> DataFrame:
    return reduce(DataFrame.unionByName, (_sums(n, df) for n, df in prep.build_params(v.sources(), CONFIG).items()))


@query
def scenario_zero(v: Views) -> DataFrame:
    return par.zero_param(_beds(v), "beds")


@query
def scenario_relax(v: Views) -> DataFrame:
    return par.relax_param(_beds(v), "beds")


@query
def scenario_total(v: Views) -> DataFrame:
    return par.total_param(_beds(v), "beds")


@query
def weight_grid(v: Views) -> DataFrame:
    return par.weight_grid(_demand(v), 0.1)


# --- K: allocation ---------------------------------------------------------------------------------


@query
def pair_costs(v: Views) -> DataFrame:
    return _rounded(_Plan(v).costs, "cost", places=9)


@query
def assign_lowest_cost(v: Views) -> DataFrame:
    p = _Plan(v)
    return alloc.assign_lowest_cost(p.demand, p.costs)


@query
def assign_cheapest(v: Views) -> DataFrame:
    return _Plan(v).plan


@query
def assign_with_capacity(v: Views) -> DataFrame:
    p = _Plan(v)
    rooms = alloc.effective_beds(
        _beds(v).where(F.col("patient_type").isin(*fv.CANCER_TYPES)), res.staff_hours(_staff_days(v))
    )
    weighted = par.weight_array(WEIGHTS)
    return alloc.assign_with_capacity(
        p.demand.select(F.explode(weighted).alias("weight"), "*"),
        alloc.offers_by_distance(p.od, p.exposure, p.bounds),
        cut_lineage(rooms.select(F.explode(weighted).alias("weight"), "*")),
    )


PLANNING = ("demand", "distance", "exposure", "staff_hours", "los", "capacity", "initial", "releases")


def _params(v: Views, *names: str) -> dict[str, DataFrame]:
    return prep.cut_params(prep.build_params(v.sources(), CONFIG), *names)


@query
def plan_horizon(v: Views) -> DataFrame:
    return run_segments(_params(v, *PLANNING), WEIGHTS, START, DAYS, SEGMENTS).plan


@query
def plan_horizon_demand(v: Views) -> DataFrame:
    """What the rolling plan places, by row of the demand."""
    plan = plan_horizon(v)
    return plan.groupBy("weight", "patient_type", "area_id", "date").agg(F.sum("qty").alias("qty"))


@query
def plan_horizon_violations(v: Views) -> DataFrame:
    """The rolling plan against demand, raised beds and raised staff hours; no row means that all hold."""
    params = _params(v, *PLANNING)
    h = run_segments(params, WEIGHTS, START, DAYS, SEGMENTS)
    plan = h.plan.drop("segment")
    census = cut_lineage(
        alloc.plan_census(plan, params["initial"], params["releases"], params["los"], START, END, WEIGHTS)
    )
    demand = params["demand"].where(cal.in_horizon("date", START, END))
    return checks.check_plan(plan, census, demand, h.beds, h.hours, WEIGHTS)


def _planned(v: Views):
    """The rolling plan, what it started from, and its program."""
    params = _params(v, *PLANNING)
    h = run_segments(params, WEIGHTS, START, DAYS, SEGMENTS)
    first = params["demand"].where(cal.in_horizon("date", START, END) & (F.col("date") <= F.lit(FIRST_SEGMENT_LAST)))
    bounds = cut_lineage(alloc.objective_bounds(first, params["distance"], params["exposure"]))
    beds, hours = cut_lineage(h.beds.drop("segment")), cut_lineage(h.hours.drop("segment"))
    program = dual.horizon_program(params, beds, hours, WEIGHTS, bounds, START, DAYS)
    return params, replace(h, beds=beds, hours=hours), cut_lineage(h.plan.drop("segment")), program


@query
def plan_horizon_gap(v: Views) -> DataFrame:
    """Cost of the rolling plan by weight, a lower bound under its beds and staff, and the gap between them."""
    params, _, plan, program = _planned(v)
    return dual.plan_gap(program, plan, params["distance"], params["exposure"])


@query
def plan_horizon_exchanged(v: Views) -> DataFrame:
    """The rolling plan after exchanges."""
    _, _, plan, program = _planned(v)
    return exchange(program, plan, START)


@query
def exchanged_violations(v: Views) -> DataFrame:
    """Rules that the plan breaks after exchanges, and weights that got dearer; no row means none."""
    params, h, plan, program = _planned(v)
    better = cut_lineage(exchange(program, plan, START))
    census = alloc.plan_census(better, params["initial"], params["releases"], params["los"], START, END, WEIGHTS)
    demand = params["demand"].where(cal.in_horizon("date", START, END))
    broken = checks.check_plan(better, cut_lineage(census), demand, h.beds, h.hours, WEIGHTS)
    cost = lambda x, name: dual.plan_cost(program.goals, x, params["distance"], params["exposure"]).withColumnRenamed("cost", name)
    dearer = cost(plan, "before").join(cost(better, "after"), "goal", "full").where("after is null or before is null or after > before * (1 + 1e-9)")
    none = F.lit(None)
    dearer = dearer.select(F.lit("cost").alias("rule"), F.col("goal").alias("weight"), none.cast("string").alias("patient_type"),
                           none.cast("long").alias("place"), none.cast("date").alias("date"), F.lit(1).cast("long").alias("amount"))
    return broken.unionByName(dearer)


def _cells(v: Views) -> DataFrame:
    """Room of every real facility's day beside nobody: beds, or what staff can serve."""
    rooms = alloc.effective_beds(
        _beds(v).where(F.col("patient_type").isin(*fv.CANCER_TYPES)), res.staff_hours(_staff_days(v))
    )
    real = rooms.where(F.col("facility_id") != fv.OVERFLOW_FACILITY)
    return cut_lineage(real.withColumn("free", F.greatest("room", F.lit(0))).drop("room"))


@query
def cheapest_open_ways(v: Views) -> DataFrame:
    """Every demand row's cheapest facility that has room on all days of the stay: the bound at prices of 0."""
    p = _Plan(v)
    goals = dual.weight_goals(WEIGHTS, p.bounds)
    program = dual.program(goals, p.demand, p.od, p.exposure, _cells(v), _los(v), START, DAYS)
    date = F.date_add(F.lit(START).cast("date"), F.col("day")).alias("date")
    ways = dual.cheapest_ways(program, program.series)
    return ways.select(F.col("goal").alias("weight"), "patient_type", "area_id", date, "qty", "facility_id", F.round("cost", 9).alias("cost"))


@query
def capacity_bounds(v: Views) -> DataFrame:
    """Range of distance and infection of the first segment that beds and staff allow."""
    p = _Plan(v)
    days = (as_date(FIRST_SEGMENT_LAST) - as_date(START)).days + 1
    found = dual.capacity_bounds(p.demand, p.od, p.exposure, _cells(v), _los(v), START, days)
    return _rounded(found, *dual.RANGE, places=3)


@query
def capacity_bounds_outside(v: Views) -> DataFrame:
    """Bounds under capacity that lie outside those that ignore it; no row means none."""
    p = _Plan(v)
    days = (as_date(FIRST_SEGMENT_LAST) - as_date(START)).days + 1
    inner = dual.capacity_bounds(p.demand, p.od, p.exposure, _cells(v), _los(v), START, days, rounds=4)
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"i.{n}").alias("inner"), F.col(f"o.{n}").alias("outer")) for n in dual.RANGE))
    both = inner.alias("i").crossJoin(p.bounds.alias("o")).select(F.inline(names))
    slip = 1e-9 * F.abs("outer")
    low = F.col("name").startswith("best") & (F.col("inner") < F.col("outer") - slip)
    return both.where(low | (F.col("name").startswith("worst") & (F.col("inner") > F.col("outer") + slip)))


def _slack(v: Views) -> DataFrame:
    """The rolling plan when neither beds nor staff bind."""
    params = _params(v, *PLANNING)
    params["capacity"] = par.relax_param(params["capacity"], "beds")
    params["staff_hours"] = par.relax_param(params["staff_hours"], "hours")
    cells = params["staff_hours"].where(cal.in_horizon("date", START, END)).select("facility_id", "date").distinct()
    types = F.array(*(F.lit(t) for t in fv.CANCER_TYPES))
    every = cells.select(F.explode(types).alias("patient_type"), "*", F.lit(fv.RELAXED_VALUE).cast("long").alias("beds"))
    params["capacity"] = cut_lineage(every)
    return run_segments(params, WEIGHTS, START, DAYS, SEGMENTS).plan


@query
def plan_horizon_slack(v: Views) -> DataFrame:
    """With room to spare the rolling plan is the cheapest one."""
    return _slack(v).drop("segment")


@query
def objective_bounds(v: Views) -> DataFrame:
    out = _Plan(v).bounds
    return _rounded(out, *out.columns, places=3)


@query
def score_plan(v: Views) -> DataFrame:
    p = _Plan(v)
    score = alloc.score_plan(p.plan, p.od, p.exposure, p.bounds)
    score = _rounded(score, "distance_cost", "infection_cost", places=3)
    return _rounded(score, "distance_norm", "infection_norm", "total", places=9)


def _plan_census(v: Views, p: _Plan, long: DataFrame) -> DataFrame:
    return alloc.plan_census(p.plan, par.initial_census(long), par.release_table(long), _los(v), START, END, WEIGHTS)


@query
def plan_census(v: Views) -> DataFrame:
    return _plan_census(v, _Plan(v).written(), cut_lineage(_long(v)))


@query
def carry_over(v: Views) -> DataFrame:
    return alloc.carry_over(_plan_census(v, _Plan(v).written(), cut_lineage(_long(v))), FIRST_SEGMENT_LAST)


@query
def plan_history(v: Views) -> DataFrame:
    """The first two segments of a rolling plan with room to spare, put together again."""
    plan = cut_lineage(_slack(v))
    return alloc.plan_history(plan.where("segment = 0"), plan.where("segment = 1"))


# --- L: checks -------------------------------------------------------------------------------------


def _loose(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long table before any repair, which may break the rules."""
    long = cut_lineage(cap.unpivot_types(cap.borrow_beds(_wide(v, floor=False))))
    return long, par.initial_census(long), par.release_table(long)


@query
def check_initial_beds(v: Views) -> DataFrame:
    long, initial, releases = _loose(v)
    return checks.check_initial_within_beds(long.where("beds > 0"), initial, releases, START)


@query
def check_releases(v: Views) -> DataFrame:
    _, initial, releases = _loose(v)
    return checks.check_releases_within_initial(initial, releases)


@query
def check_running_releases(v: Views) -> DataFrame:
    return checks.check_running_releases(_loose(v)[0])


def _check_plan(v: Views, staff_mode: str) -> DataFrame:
    p = _Plan(v).written()
    long = cut_lineage(_long(v))
    census = cut_lineage(_plan_census(v, p, long))
    # Judge the plan against the demand of all observed admissions, which differs from the planned one.
    seen = dem.flow_counts(v.kept().where(cal.in_horizon("admit_date", START, END)), "patient_type")
    wanted = seen.where(F.col("patient_type").isin(*fv.CANCER_TYPES))
    return checks.check_plan(
        p.plan, census, wanted, long, res.staff_hours(_staff_days(v)), WEIGHTS, staff_mode=staff_mode
    )


@query
def check_plan(v: Views) -> DataFrame:
    return _check_plan(v, "per_type")


@query
def check_plan_pooled(v: Views) -> DataFrame:
    return _check_plan(v, "pooled")


# --- M: reports ------------------------------------------------------------------------------------


def _edges(v: Views) -> DataFrame:
    return rep.flow_edges(v.classified(), v.coordinates(), "11", EXCLUDED_AREAS)


@query
def flow_edges(v: Views) -> DataFrame:
    return _edges(v)


@query
def flow_nodes(v: Views) -> DataFrame:
    return rep.flow_nodes(_edges(v), v.coordinates())


def _segmented(v: Views) -> tuple[_Plan, dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """The cheapest plan with, for each segment, the census on its eve and the beds raised to the load there."""
    p = _Plan(v).written()
    long = cut_lineage(_long(v))
    releases, los = par.release_table(long), _los(v)
    census = cut_lineage(_plan_census(v, p, long))
    first = par.initial_census(long).select(F.explode(par.weight_array(WEIGHTS)).alias("weight"), F.lit(0).alias("segment"), "*")
    segments = segment_starts(START, DAYS, SEGMENTS)
    eves = [alloc.carry_over(census, last).withColumn("segment", F.lit(n + 1)) for n, (_, last) in enumerate(segments[:-1])]
    initial = cut_lineage(reduce(DataFrame.unionByName, eves, first))
    every = F.explode(par.weight_array(WEIGHTS)).alias("weight")
    beds = []
    for n, (day, last) in enumerate(segments):
        after = last + dt.timedelta(days=1)
        raised, _ = cap.raise_capacity(
            par.capacity_table(long).where(cal.in_horizon("date", day, after)).select(every, "*"),
            res.staff_hours(_staff_days(v)).where(F.lit(False)).select(every, "*"),
            initial.where(F.col("segment") == n).drop("segment"),
            p.plan.where(F.col("date") < F.lit(day)),
            releases.where(cal.in_horizon("date", day, after)).select(every, "*"),
            los,
            day,
            after,
            scope=("weight",),
        )
        beds.append(raised.select("weight", "patient_type", "facility_id", "date", "beds"))
    ledger = led.ledger_from_movements(_movements(v), START, END)
    covid = cut_lineage(res.overflow_census(led.census_by_group(ledger, fv.COVID_TYPES)))
    params = {
        "demand": p.demand,
        "distance": p.od,
        "exposure": p.exposure,
        "releases": releases,
        "los": los,
        "infected": res.infected_census(covid),
        "other": led.census_by_group(ledger, fv.OTHER_TYPES, positive_only=True),
        "staff_hours": res.staff_hours(_staff_days(v)),
    }
    return p, params, initial, cut_lineage(reduce(DataFrame.unionByName, beds)), census


@query
def plan_detail(v: Views) -> DataFrame:
    p, params, initial, beds, census = _segmented(v)
    detail = rep.plan_detail(p.plan, census, params, initial, beds, WEIGHTS, START, DAYS, SEGMENTS)
    return _rounded(detail, "distance_cost", "infection_cost", places=4)


@query
def plan_edges(v: Views) -> DataFrame:
    p, params, _, beds, _ = _segmented(v)
    return rep.plan_edges(p.plan, params, beds, WEIGHTS, START, DAYS, SEGMENTS)


for _name in ("shift_date_key", "date_key"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
