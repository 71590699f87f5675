"""The model's source tables derived from the driver's tables.

Facility = supplier key + 1 (0 stays free), area = 100 + nation key, stay = quantity. All rows of the driver's tables are
used. Bed rows of quantity 0 are the gaps that the fallbacks fill.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions import labels
from careflow.operators.classify import classify_beds, classify_episodes, classify_staff
from careflow.operators.geography import area_coordinates
from careflow.plans.preparation import RunConfig
from careflow.session import cut_lineage

CONFIG = RunConfig(
    start="1998-01-05",
    days=120,
    baseline_start="1996-01-01",
    baseline_end="1997-03-01",
    area_prefix=None,
    seed=7,
)
EXCLUDED_AREAS = (113, 117)
SURGICAL = "SURGICAL"
SUPPLIERS_A_TASK = 1000


class Views:
    """Source tables at one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._once: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:  # the schema is read once per table, not once per use
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _literal(self, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
        """A few literal rows as a plan of known size, so that Spark can tell it is small."""
        structs = [F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row, strict=True))) for row in rows]
        return self.spark.range(1).select(F.inline(F.array(*structs)))

    def episodes(self) -> DataFrame:
        """Line items with their order, customer, supplier and nation.

        Orders and customers grow with the input and are merged: Spark sees the size of their files, which is far below
        that of their rows in the driver, and would broadcast them.
        """
        lineitem, orders = self.table("lineitem"), self.table("orders")
        customer, supplier, nation = self.table("customer"), self.table("supplier"), self.table("nation")
        admitted = F.col("o_orderdate").cast("date")
        homes = customer.select("c_custkey", "c_nationkey").hint("merge")
        orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
        return (
            lineitem.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("episode_id"),
                (F.col("l_suppkey") + 1).alias("facility_id"),
                (F.col("c_nationkey") + 100).cast("long").alias("area_id"),
                (F.col("s_nationkey") + 100).cast("long").alias("facility_area_id"),
                (F.col("n_regionkey") + 1).cast("long").alias("region_id"),
                F.col("l_partkey").alias("diagnosis_code"),
                F.col("l_returnflag").alias("procedure_code"),
                admitted.alias("admit_date"),
                F.date_add(admitted, F.col("l_quantity").cast("int")).alias("discharge_date"),
                F.col("l_quantity").cast("int").alias("stay_days"),
            )
        )

    def diagnosis_rows(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("code"), F.col("p_type").alias("chapter"), F.col("p_brand").alias("brand")
        )

    def diagnoses(self) -> DataFrame:
        cancer, covid = F.col("chapter") == "PROMO", F.col("brand") == "Brand#2"
        return self.diagnosis_rows().select(
            "code",
            labels.disease_group(cancer, covid).alias("disease"),
            labels.disease_group_coarse(cancer).alias("disease_coarse"),
        )

    def procedures(self) -> DataFrame:
        return self._literal(("code", "group_name"), [("R", SURGICAL), ("A", "CLINICAL")]).select(
            "code", labels.procedure_group(F.col("group_name"), SURGICAL).alias("treatment")
        )

    def classified(self) -> DataFrame:
        """Classified episodes; diagnoses are as many as parts, so they are merged like orders."""
        return classify_episodes(self.episodes(), self.diagnoses().hint("merge"), self.procedures())

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of a query use, written when it is first asked for."""
        if name not in self._once:
            self._once[name] = cut_lineage(make())
        return self._once[name]

    def kept(self) -> DataFrame:
        """Classified episodes with the columns that plans use, written once: one join and one scan of the raw tables."""
        columns = ["episode_id", "area_id", "facility_id", "facility_area_id", "patient_type", "admit_date",
                   "discharge_date", "stay_days"]
        return self.once("episodes", lambda: Views.classified(self).select(*columns))

    def keep(self) -> None:
        """From now on ``classified`` is the written table, for queries that read the episodes more than once."""
        self.classified = self.kept  # type: ignore[method-assign]

    def month_keys(self) -> DataFrame:
        d = F.col("o_orderdate")
        return self.table("orders").select((F.year(d) * 100 + F.month(d)).alias("month_key")).distinct()

    def _months(self) -> Column:
        return self.month_keys().agg(F.collect_list("month_key")).scalar()

    def _suppliers(self) -> DataFrame:
        """Supplier keys spread over tasks: each has hundreds of bed and staff rows, made in the task that holds it."""
        keys = self.table("supplier").select("s_suppkey")
        tasks = -(-keys.count() // SUPPLIERS_A_TASK)
        return keys.repartition(tasks) if tasks > 1 else keys

    def bed_lookup_rows(self) -> DataFrame:
        return self._literal(("bed_code", "bed_kind"), [(12, 1), (44, 2), (3, 1), (33, 2)])

    def bed_lookup(self) -> DataFrame:
        return self.bed_lookup_rows().select(
            F.col("bed_code").alias("code"),
            labels.bed_group(F.col("bed_code"), F.col("bed_kind")).alias("bed_group"),
        )

    def bed_rows(self) -> DataFrame:
        kinds = [(12, 1), (44, 2), (3, 1), (33, 2), (99, 2)]  # 99 is not in the lookup
        codes = F.array(
            *(F.struct(F.lit(c).alias("bed_code"), F.lit(k).alias("bed_kind")) for c, k in kinds)
        )
        qty = (F.col("s_suppkey") * 13 + F.col("month_key") * 7 + F.col("bed_code") * 5) % 40
        return (
            self._suppliers()
            .select("s_suppkey", F.inline(codes))
            .select("*", F.explode(self._months()).alias("month_key"))
            .select(
                (F.col("s_suppkey") + 1).alias("facility_id"), "bed_code", "bed_kind", "month_key",
                qty.cast("long").alias("qty"),
            )
        )

    def staff_rows(self) -> DataFrame:
        k = F.col("occupation_code")
        return (
            self._suppliers()
            .select("s_suppkey", F.explode(self._months()).alias("month_key"))
            .select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")).alias("occupation_code"))
            .select(
                (F.col("s_suppkey") + 1).alias("facility_id"),
                "month_key",
                "occupation_code",
                ((F.col("s_suppkey") + k * 7) % 21).cast("int").alias("h_amb"),
                ((F.col("s_suppkey") * 3 + F.col("month_key") + k) % 41).cast("int").alias("h_hosp"),
                (k * 2).cast("int").alias("h_other"),
            )
        )

    def occupations(self) -> DataFrame:
        return self._literal(("code", "name"), [(1, "Physician"), (2, "Nurse")])

    def geo(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            ((n + 100) * 10 + n % 10).cast("long").alias("code_full"),
            ((n * 7) % 38 - 33).cast("double").alias("lat"),
            ((n * 11) % 38 - 73).cast("double").alias("lon"),
        )

    def coordinates(self) -> DataFrame:
        return area_coordinates(self.geo())

    def beds(self) -> DataFrame:
        return classify_beds(self.bed_rows(), self.bed_lookup())

    def staff(self) -> DataFrame:
        return classify_staff(self.staff_rows(), self.occupations())

    def sources(self) -> dict[str, DataFrame]:
        """Input of ``build_params``."""
        return {
            "episodes": self.kept(),
            "places": self.kept().select("facility_id", "facility_area_id"),
            "beds": self.beds(),
            "staff": self.staff(),
            "coordinates": self.coordinates(),
        }
