"""The whole preparation: source tables to parameter tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike, end_of
from careflow.operators import capacity as cap
from careflow.operators import demand as dem
from careflow.operators import geography as geo
from careflow.operators import ledger as led
from careflow.operators import params as par
from careflow.operators import resources as res
from careflow.operators.classify import classify_beds, classify_episodes, classify_staff, type_array, type_index
from careflow.session import cut_lineage

COARSE_OF = {"COVID_CLINICAL": "OTHER_CLINICAL", "COVID_SURGERY": "OTHER_SURGERY"}


@dataclass(frozen=True)
class RunConfig:
    """What a run plans for and how."""

    start: DateLike = fv.PLANNING_START
    days: int = fv.PLANNING_DAYS
    baseline_start: DateLike = fv.BASELINE_START
    baseline_end: DateLike = fv.BASELINE_END
    demand_types: tuple[str, ...] = fv.CANCER_TYPES
    area_prefix: str | None = fv.AREA_PREFIX
    seed: int = 0
    calendar: bool = False

    @property
    def end(self):
        return end_of(self.start, self.days)


def load_sources(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Classified sources from raw ones.

    ``tables``: episodes, beds, staff, coordinates (area_id, lat, lon) and the lookups diagnoses, procedures,
    bed_lookup, occupations.
    """
    return {
        "episodes": classify_episodes(tables["episodes"], tables["diagnoses"], tables["procedures"]),
        "places": tables["episodes"].select("facility_id", "facility_area_id"),
        "beds": classify_beds(tables["beds"], tables["bed_lookup"]),
        "staff": classify_staff(tables["staff"], tables["occupations"]),
        "coordinates": tables["coordinates"],
    }


def project_baseline(episodes: DataFrame, config: RunConfig) -> DataFrame:
    """Whole-number demand on the planning days from the weekday profile of the baseline."""
    daily = dem.daily_demand(episodes, config.baseline_start, config.baseline_end, config.demand_types)
    projected = dem.project_demand(dem.weekday_profile(daily), config.start, config.end)
    return dem.integerize_demand(projected, config.area_prefix, config.seed)


def bed_frame(mov_coarse: DataFrame, beds: DataFrame, types, config: RunConfig, floor: bool = True) -> DataFrame:
    """Coarse ledger with beds, overflow facility and (``floor``) the capacity repair.

    ``types`` is the array of types in the planning window; rows of other types drop out, as in the encoding.
    """
    ledger = led.ledger_from_movements(mov_coarse, config.start, config.end, config.calendar)
    # Read three times below (rows, dates, types); one row per facility, type and planning day.
    attached = cut_lineage(cap.attach_beds(ledger, beds, led.peak_census(mov_coarse)))
    frame = cap.add_overflow_beds(attached)
    if types is not None:
        frame = frame.where(F.array_contains(types, F.col("patient_type")))
    return cap.floor_beds_to_load(frame) if floor else frame


def dynamic_beds(frame: DataFrame) -> DataFrame:
    """Cancer beds per (date, facility, type) after other patients took what they lack."""
    long = cut_lineage(cap.unpivot_types(cap.borrow_beds(cap.pivot_types(frame))))
    return cap.floor_beds_to_initial(long)


def build_params(sources: dict[str, DataFrame], config: RunConfig) -> dict[str, DataFrame]:
    """All parameter tables of a run.

    The episodes are read for four narrow aggregates: movements, baseline demand, length of stay, and the
    facility places. What is used more than once afterwards (movements, demand, bed table) is small by then and
    is written to the checkpoint folder, so neither a lost executor nor a second use reads the episodes again.
    """
    episodes = sources["episodes"]
    start, end = config.start, config.end

    mov = cut_lineage(led.movements(episodes, "patient_type", start, end))
    los_all = cut_lineage(dem.avg_length_of_stay(episodes, start, end))
    types = type_array(los_all)
    demand = cut_lineage(
        project_baseline(episodes, config).where(F.array_contains(types, F.col("patient_type")))
    )

    fine = led.ledger_from_movements(mov, start, end, config.calendar)
    other = led.census_by_group(fine, fv.OTHER_TYPES, positive_only=True)
    covid = cut_lineage(res.overflow_census(led.census_by_group(fine, fv.COVID_TYPES)))

    coarse = cut_lineage(led.regroup_types(mov, COARSE_OF))
    beds = res.daily_beds(sources["beds"], start, end)
    long = cut_lineage(dynamic_beds(bed_frame(coarse, beds, types, config)))

    staff_days = res.daily_staff(sources["staff"], start, end)
    places = cut_lineage(sources["places"].dropna(subset=["facility_id"]).distinct())
    # Restricting the home areas to those with demand before building the matrix gives the same rows as
    # restricting the finished matrix.
    area_km = geo.area_distances(demand, places, sources["coordinates"])
    reached = geo.add_overflow_distance(geo.facility_distances(area_km, places), areas=demand)
    od = geo.restrict_od(reached, demand, places)

    return {
        "demand": par.demand_table(demand),
        "capacity": par.capacity_table(long),
        "releases": par.release_table(long),
        "initial": par.initial_census(long),
        "los": los_all.where(F.col("patient_type").isin(*fv.CANCER_TYPES)),
        "distance": par.distance_table(od),
        "exposure": res.infection_exposure(covid, res.staff_headcount(staff_days)),
        "infected": res.infected_census(covid),
        "other": other,
        "staff_hours": res.staff_hours(staff_days),
        "types": type_index(los_all),
        "sets": par.index_sets(demand, places, start, config.days),
    }


def cut_params(params: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """Write the named tables (default all) to the checkpoint folder."""
    chosen = names or tuple(params)
    return {n: cut_lineage(df) if n in chosen else df for n, df in params.items()}
