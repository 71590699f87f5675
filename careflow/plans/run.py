"""From sources to reports: parameters are loaded or built, the horizon is planned, the reports are written."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from careflow import fixed_values as fv
from careflow.functions.calendar import end_of
from careflow.operators.params import weights
from careflow.operators.reports import plan_detail, plan_edges
from careflow.plans.allocation import plan_census
from careflow.plans.horizon import Horizon, plan_segments
from careflow.plans.preparation import RunConfig, build_params
from careflow.session import cut_lineage
from careflow.sources.param_store import load_params, run_id, save_params
from careflow.sources.tables import write_table


def load_or_build(
    spark: SparkSession, base: str, sources: dict[str, DataFrame], config: RunConfig, version: str | None = None
) -> dict[str, DataFrame]:
    """Parameter tables of a run from the store, or built from the classified sources and stored.

    Without a ``version`` of the sources their content tells whether the store is up to date, at one pass over them.
    """
    run = run_id(config.start, config.days, asdict(config), sources, version)
    params = load_params(spark, base, run)
    if params is None:
        save_params(build_params(sources, config), base, run)
        params = load_params(spark, base, run)
    return params


def reports(
    horizon: Horizon, params: dict[str, DataFrame], weight_values: list[float], config: RunConfig, parts: int
) -> tuple[DataFrame, DataFrame]:
    """Detail and edges of a planned horizon, with each segment's own initial census and raised beds."""
    end = end_of(config.start, config.days)
    census = cut_lineage(
        plan_census(
            horizon.plan, params["initial"], params["releases"], params["los"], config.start, end, weight_values
        )
    )
    detail = plan_detail(
        horizon.plan, census, params, horizon.initial, horizon.beds, weight_values, config.start, config.days, parts
    )
    edges = plan_edges(horizon.plan, params, horizon.beds, weight_values, config.start, config.days, parts)
    return detail, edges


def run(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    config: RunConfig,
    store: str,
    out: str,
    weight_values: list[float] | None = None,
    parts: int = fv.SEGMENTS,
    fmt: str = "parquet",
    version: str | None = None,
) -> Horizon:
    """Everything: ``sources`` as of ``load_sources``; detail and edges go to ``out`` by weight and segment."""
    weight_values = weights() if weight_values is None else weight_values
    params = load_or_build(spark, store, sources, config, version)
    horizon = plan_segments(params, weight_values, config.start, config.days, parts)
    detail, edges = reports(horizon, params, weight_values, config, parts)
    write_table(detail, f"{out}/plan_detail", fmt, ["w_distance", "segment"])
    write_table(edges, f"{out}/plan_edges", fmt, ["w_distance", "segment"])
    return horizon
