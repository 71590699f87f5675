"""Small hand-made tables that pin the corner cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careflow.functions import labels
from careflow.functions.calendar import date_key, from_date_key, segment_of, segment_starts, shift_date_key
from careflow.functions.geo import haversine_km, normalize_area_code
from careflow.operators import capacity as cap
from careflow.operators import classify as cls
from careflow.operators import demand as dem
from careflow.operators import geography as geo
from careflow.operators import ledger as led
from careflow.operators import params as par
from careflow.operators import resources as res
from careflow.sources import param_store, tables

D = dt.date
EPISODE = (
    "episode_id long, patient_type string, facility_id long, area_id long, admit_date date, discharge_date date, stay_days int"
)


def episodes(spark, rows):
    return spark.createDataFrame(rows, EPISODE)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_same_day_and_null_discharge(spark):
    e = episodes(
        spark,
        [
            (1, "A", 1, 10, D(2020, 1, 2), D(2020, 1, 2), 0),
            (2, "A", 1, 10, D(2020, 1, 1), None, 5),
            (3, "A", None, 10, D(2020, 1, 1), None, 5),
            (None, "A", 1, 10, D(2020, 1, 3), None, 5),
        ],
    )
    got = rows(led.running_census(led.movements(e)), "date", "admits", "discharges", "census")
    assert got == [(D(2020, 1, 1), 1, 0, 1), (D(2020, 1, 2), 1, 1, 1), (D(2020, 1, 3), 0, 0, 1)]


def test_release_edges_are_strict(spark):
    e = episodes(
        spark,
        [
            (1, "A", 1, 10, D(2020, 1, 1), D(2020, 1, 5), 4),  # leaves on the start day
            (2, "A", 1, 10, D(2020, 1, 1), D(2020, 1, 9), 8),  # leaves on the end day
            (3, "A", 1, 10, D(2020, 1, 5), D(2020, 1, 6), 1),  # comes on the start day
            (4, "A", 1, 10, D(2020, 1, 1), D(2020, 1, 6), 5),
        ],
    )
    assert rows(led.scheduled_releases(e, "2020-01-05", "2020-01-09"), "date", "releases") == [(D(2020, 1, 6), 1)]
    mov = led.movements(e, "patient_type", "2020-01-05", "2020-01-09").where("releases > 0")
    assert rows(mov, "date", "releases") == [(D(2020, 1, 6), 1)]


def test_leading_gap_unseen_series_and_window_seed(spark):
    e = episodes(
        spark,
        [
            (1, "A", 1, 10, D(2020, 1, 1), D(2020, 1, 4), 3),
            (2, "B", 2, 10, D(2020, 1, 3), D(2020, 1, 6), 3),
        ],
    )
    full = {(r.date, r.facility_id, r.patient_type): r for r in led.ledger_from_movements(
        led.movements(e, "patient_type", "2020-01-02", "2020-01-05")).collect()}
    assert len(full) == 2 * 2 * 4  # two types, two facilities, four observed days
    assert full[(D(2020, 1, 1), 2, "B")].census == 0
    assert full[(D(2020, 1, 4), 2, "B")].census == 1
    assert full[(D(2020, 1, 3), 1, "B")].census == 0
    window = led.census_ledger(e, "2020-01-02", "2020-01-05")
    assert rows(window, "date", "facility_id", "patient_type", "census") == sorted(
        (d, f, t, r.census) for (d, f, t), r in full.items() if D(2020, 1, 2) <= d < D(2020, 1, 5)
    )
    padded = led.census_ledger(e, "2020-01-02", "2020-01-05", calendar=True)
    assert padded.count() == 3 * 4


def test_lookup_fan_out_null_codes_and_defaults(spark):
    e = spark.createDataFrame([(1, "x", "s"), (2, None, None), (3, "q", "s")], "id int, diagnosis_code string, procedure_code string")
    d = spark.createDataFrame([("x", "CANCER", "CANCER"), ("x", "COVID", "OTHER"), (None, "COVID", "OTHER")], "code string, disease string, disease_coarse string")
    p = spark.createDataFrame([("s", "SURGERY")], "code string, treatment string")
    assert rows(cls.classify_episodes(e, d, p), "id", "patient_type", "patient_type_coarse") == [
        (1, "CANCER_SURGERY", "CANCER_SURGERY"),
        (1, "COVID_SURGERY", "OTHER_SURGERY"),
        (2, "OTHER_CLINICAL", "OTHER_CLINICAL"),
        (3, "OTHER_SURGERY", "OTHER_SURGERY"),
    ]


def test_labels_first_rule_wins(spark):
    beds = spark.createDataFrame([(12, 1), (44, 1), (3, 1), (9, 2)], "c int, k int")
    got = [r[0] for r in beds.select(labels.bed_group(F.col("c"), F.col("k"))).collect()]
    assert got == ["CANCER_SURGERY", "CANCER_CLINICAL", "OTHER_SURGERY", "OTHER_CLINICAL"]


def test_half_even_stay(spark):
    e = episodes(
        spark,
        [(i, t, 1, 10, D(2020, 1, 1), D(2020, 1, 3), s) for i, (t, s) in enumerate([("A", 2), ("A", 3), ("B", 3), ("B", 4)])]
        + [(9, "C", 1, 10, D(2019, 1, 1), D(2019, 1, 2), 1)],
    )
    assert rows(dem.avg_length_of_stay(e, "2020-01-01", "2020-02-01")) == [("A", 2), ("B", 4)]


def test_dates_and_segments(spark):
    d = spark.createDataFrame([(20200228,), (20191231,)], "k int")
    assert [tuple(r) for r in d.select(shift_date_key("k", 2), date_key(from_date_key("k"))).collect()] == [
        (20200301, 20200228),
        (20200102, 20191231),
    ]
    sizes = [(b - a).days + 1 for a, b in segment_starts("2021-03-01", 120, 7)]
    assert sizes == [18, 17, 17, 17, 17, 17, 17]
    days = spark.range(3).select(F.date_add(F.lit(D(2021, 3, 1)), F.col("id").cast("int")).alias("date"))
    assert [r[0] for r in days.select(segment_of("date", "2021-03-01", 2, 5)).collect()] == [0, 1, None]


def test_distance(spark):
    p = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0), (0.0, 0.0, 0.0, 90.0)], "a double, b double, c double, d double")
    km = [r[0] for r in p.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert km[0] == 1.0
    assert km[1] == pytest.approx(6373.0 * 3.141592653589793 / 2)
    assert spark.range(1).select(normalize_area_code(F.lit(2304400))).first()[0] == 230440


def test_facility_in_two_areas_takes_the_nearer_and_overflow_is_added(spark):
    km = spark.createDataFrame([(1, 7, 5.0), (1, 8, 3.0)], "area_id long, facility_area_id long, km double")
    places = spark.createDataFrame([(4, 7), (4, 8)], "facility_id long, facility_area_id long")
    od = geo.add_overflow_distance(geo.facility_distances(km, places))
    assert rows(od) == [(1, 0, 99999.9), (1, 4, 3.0)]


def test_sampling_takes_what_there_is(spark):
    day = D(2020, 1, 1)
    p = spark.createDataFrame(
        [(day, 231, "A", 0.9), (day, 111, "A", 0.9), (day, 112, "A", 0.9), (day, 232, "A", 2.5)],
        "date date, area_id long, patient_type string, qty double",
    )
    assert rows(dem.integerize_demand(p, "23"), "area_id", "qty") == [(231, 1), (232, 2)]
    assert dem.integerize_demand(p, None, 3).where("qty = 1").count() == 3
    assert dem.integerize_demand(p, "23", 3, total_before_filter=False).where("qty = 1").count() == 1


def test_sampling_ranks_like_a_global_sort(spark):
    day = F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 50).cast("int"))
    p = spark.range(5000).select(day.alias("date"), F.col("id").alias("area_id"), F.lit("A").alias("patient_type"), F.lit(0.3).alias("qty"))
    got = {r.area_id for r in dem.integerize_demand(p, None, 5).collect()}
    order = p.select("area_id", F.md5(F.concat_ws("|", F.lit("5"), "date", "area_id", "patient_type")).alias("h")).collect()
    assert got == {r.area_id for r in sorted(order, key=lambda r: r.h)[:1500]}


def test_staff_overflow_and_double_division(spark):
    staff = cls.classify_staff(
        spark.createDataFrame([(1, 5, 202101, 8, 8, 8), (1, 6, 202101, 8, 8, 8)], "facility_id long, occupation_code long, month_key int, h_amb int, h_hosp int, h_other int"),
        spark.createDataFrame([(5, "Physician")], "code long, name string"),
    )
    assert rows(staff) == [(1, "Outros", 202101, 4, 1), (1, "Physician", 202101, 4, 1)]
    days = res.daily_staff(staff, "2021-01-30", "2021-02-01")
    assert rows(res.staff_hours(days)) == sorted(
        (f, D(2021, 1, d), h) for d in (30, 31) for f, h in ((0, -(-999999 * 999999 // 5)), (1, 2))
    )


WIDE = {f"{m}_{t}": 0 for m in cap.MEASURES for t in ("CANCER_CLINICAL", "CANCER_SURGERY", "OTHER_CLINICAL", "OTHER_SURGERY")}


def test_borrowing(spark):
    a = WIDE | {"beds_OTHER_CLINICAL": 3, "census_OTHER_CLINICAL": 5, "beds_CANCER_CLINICAL": 1, "beds_CANCER_SURGERY": 4}
    b = a | {"beds_CANCER_CLINICAL": 9}
    df = spark.createDataFrame([{"date": D(2020, 1, 1), "facility_id": i, **w} for i, w in enumerate((a, b))])
    got = rows(cap.borrow_beds(df), "facility_id", "dynamic_beds_CLINICAL", "dynamic_beds_SURGERY")
    assert got == [(0, 0, 4), (1, 7, 4)]


def test_pivot_carries_forward(spark):
    df = spark.createDataFrame(
        [(D(2020, 1, 1), 1, "OTHER_SURGERY", 1, 0, 1, 1, 0, 5), (D(2020, 1, 2), 1, "CANCER_SURGERY", 2, 0, 2, 2, 1, 7)],
        "date date, facility_id long, patient_type string, admits long, discharges long, net long, census long, releases long, beds long",
    )
    got = rows(cap.pivot_types(df), "date", "beds_OTHER_SURGERY", "admits_OTHER_SURGERY", "beds_CANCER_SURGERY")
    assert got == [(D(2020, 1, 1), 5, 1, 0), (D(2020, 1, 2), 5, 0, 7)]


def test_negative_release_is_flagged_and_left(spark):
    long = spark.createDataFrame(
        [(D(2020, 1, 1), 1, "A", 1, 0, 3), (D(2020, 1, 2), 1, "A", 1, 2, 3), (D(2020, 1, 3), 1, "A", 1, 2, 3)],
        "date date, facility_id long, patient_type string, beds long, releases long, census long",
    )
    assert rows(cap.floor_beds_to_initial(long), "date", "beds", "over_released") == [
        (D(2020, 1, 1), 3, False),
        (D(2020, 1, 2), 1, False),
        (D(2020, 1, 3), 1, True),
    ]


def test_scenarios_and_weights(spark):
    t = spark.createDataFrame([(1, 5), (2, 7)], "k int, v long")
    assert rows(par.zero_param(t, "v")) == [(1, 0), (2, 0)]
    assert rows(par.relax_param(t, "v")) == [(1, 9999999), (2, 9999999)]
    assert rows(par.total_param(t, "v")) == [(12,)]
    assert par.weights(0.1) == [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
    assert rows(par.weight_grid(t, 0.5).where("k = 1"), "weight", "weight_infection") == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]


def test_csv_sources_and_lookups(spark, tmp_path):
    (tmp_path / "sih.csv").write_text(
        "N_AIH,UF_ZI,MUNIC_RES,MUNIC_MOV,CNES,DT_INTER,DT_SAIDA,DIAS_PERM,DIAG_PRINC,PROC_REA\n"
        "77,x,230440,230440,5,20210301,20210304,3,C509,301\n",
        encoding="latin-1",
    )
    e = tables.read_source(spark, str(tmp_path / "sih.csv"), "episodes")
    assert rows(e, "episode_id", "facility_id", "admit_date", "discharge_date") == [(77, 5, D(2021, 3, 1), D(2021, 3, 4))]
    (tmp_path / "deParaCID.csv").write_text("ICD_10,Chapter_Desc\nC509,Neoplasms (C00-D48)\nB342,Infections\nZ,\n", encoding="latin-1")
    (tmp_path / "deparaProcedimentos.csv").write_text("Codigo,Nome_Grupo_1\n301,Procedimentos cirúrgicos\n302,Outro\n", encoding="latin-1")
    (tmp_path / "deParaLeitos.csv").write_text("CO_LEITO,TP_LEITO\n12,1\n3,1\n", encoding="latin-1")
    (tmp_path / "deParaCBO.csv").write_text("cod_cbo,Nome_Cbo\n5,Médico\n", encoding="latin-1")
    look = tables.read_lookups(spark, str(tmp_path))
    assert rows(look["diagnoses"], "code", "disease") == [("B342", "COVID"), ("C509", "CANCER"), ("Z", "OTHER")]
    assert rows(look["procedures"]) == [(301, "SURGERY"), (302, "CLINICAL")]
    assert rows(look["occupations"]) == [(5, "Médico")]
    assert rows(cls.classify_episodes(e, look["diagnoses"], look["procedures"]), "patient_type") == [("CANCER_SURGERY",)]
    with pytest.raises(ValueError):
        tables.read_source(spark, str(tmp_path / "deParaCBO.csv"), "geo")


def test_param_store_is_keyed_by_run(spark, tmp_path):
    t = spark.createDataFrame([("A", 1, 2, D(2020, 1, 1), 3)], "patient_type string, area_id long, facility_id long, date date, qty long")
    run = param_store.run_id("2021-03-01", 120, {"seed": 1})
    param_store.save_params({"demand": t}, str(tmp_path), run)
    assert rows(param_store.load_params(spark, str(tmp_path), run)["demand"]) == rows(t)
    assert param_store.load_params(spark, str(tmp_path), param_store.run_id("2021-03-01", 121, {"seed": 1})) is None
    assert rows(par.param_to_table(t, "qty", F.array(F.lit("A")))) == [(0, 1, 2, 20200101, 3)]
    tables.write_table(t, str(tmp_path / "out"), "csv", ["area_id"])
    assert (tmp_path / "out" / "area_id=1").exists()


def test_one_date_far_away_adds_one_day(spark):
    near = [(k, "A", 1 + k % 2, 10, D(2020, 1, 1 + k % 5), D(2020, 1, 3 + k % 7), 2) for k in range(12)]
    far = [*near, (99, "B", 2, 10, D(9999, 12, 30), None, 1)]

    def dense(some):
        mov = led.running_census(led.movements(episodes(spark, some)))
        return led.forward_fill(led.densify(mov, ("census",)), ("census",))

    want = {tuple(r) for r in dense(near).collect()}
    found = dense(far).collect()
    got, days = [tuple(r) for r in found], {r.date for r in found}
    assert days == {r.date for r in dense(near).collect()} | {D(9999, 12, 30)}
    assert len(got) == len(days) * 2 * 2  # two types, two facilities
    assert want <= set(got)
    ledger = led.ledger_from_movements(led.movements(episodes(spark, far), "patient_type", "2020-01-01", "2020-01-09"))
    assert ledger.where("date > '2020-02-01'").count() == 4


def test_hot_facility_has_one_row_per_day(spark):
    """A facility with most of the episodes is counted before its series is ordered."""
    many = spark.range(30_000).select(
        F.col("id").alias("episode_id"), F.lit("A").alias("patient_type"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("facility_id"),
        F.lit(10).alias("area_id"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 30).cast("int")).alias("admit_date"),
        F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 30 + 2).cast("int")).alias("discharge_date"), F.lit(2).alias("stay_days"),
    )
    mov = led.movements(many)
    assert mov.where("facility_id = 7").count() <= 32
    assert led.running_census(mov).where("facility_id = 7").agg(F.max("census")).first()[0] > 1000


def test_exchanged_columns_bad_values_and_bad_dates(spark, tmp_path):
    geo_dir = tmp_path / "geo"
    geo_dir.mkdir()
    (geo_dir / "a.csv").write_text("codigo_ibge,latitude,longitude\n1100015,-11.9,-61.9\n")
    (geo_dir / "b.csv").write_text("codigo_ibge,longitude,latitude\n1100023,-62.9,-9.9\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_source(spark, str(geo_dir), "geo").collect()
    bad = tmp_path / "bad.csv"
    bad.write_text("codigo_ibge,latitude,longitude\n1100015,-11.9,x\n1100023,-9.9,-62.9\n")
    with pytest.raises(tables.RejectedRows, match="1 rows"):
        tables.read_source(spark, str(bad), "geo")
    rejects = str(tmp_path / "rejects")
    assert rows(tables.read_source(spark, str(bad), "geo", rejects=rejects)) == [(1100023, -9.9, -62.9)]
    assert "-11.9" in spark.read.parquet(rejects).first()["row"]
    sih = tmp_path / "sih.csv"
    head = "N_AIH,MUNIC_RES,MUNIC_MOV,CNES,DT_INTER,DT_SAIDA,DIAS_PERM,DIAG_PRINC,PROC_REA\n"
    sih.write_text(head + "1,11,11,5,20200101,20200103,2,C50,1\n2,11,11,5,20200232,20200303,2,C50,1\n3,11,11,5,20200101,0,2,C50,1\n")
    with pytest.raises(tables.RejectedRows, match="2 rows"):
        tables.read_source(spark, str(sih), "episodes")
    kept = tables.read_source(spark, str(sih), "episodes", rejects=str(tmp_path / "rejects2"))
    assert rows(kept, "episode_id", "admit_date", "discharge_date") == [(1, D(2020, 1, 1), D(2020, 1, 3))]
    assert spark.read.parquet(str(tmp_path / "rejects2")).count() == 2


def test_a_save_that_fails_leaves_no_run(spark, tmp_path):
    t = spark.createDataFrame([(1, 2)], "area_id long, qty long")
    param_store.save_params({"demand": t}, str(tmp_path), "r")
    broken = t.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        param_store.save_params({"demand": t, "extra": broken}, str(tmp_path), "r")
    assert param_store.load_params(spark, str(tmp_path), "r") is None


def test_run_is_named_by_content(spark, tmp_path):
    def name(df, **more):
        df.write.mode("overwrite").parquet(str(tmp_path / "e"))
        return param_store.run_id("2021-03-01", 9, {}, {"e": spark.read.parquet(str(tmp_path / "e"))}, **more)

    t = spark.createDataFrame([(1, 2), (3, None)], "area_id long, qty long")
    first = name(t)
    assert name(t.repartition(3)) == name(t.orderBy(F.desc("area_id"))) == first
    # replaced under the same name, a row more, a repeated row, none at all, other types
    others = [t.withColumn("qty", F.lit(5).cast("long")), t.unionAll(t.limit(1)), t.unionAll(t), t.limit(0), t.withColumn("qty", F.col("qty").cast("int"))]
    assert len({first, *map(name, others)}) == 6
    assert name(t, version="a") == name(others[0], version="a") != name(t, version="b")


def test_a_source_is_read_once(spark, tmp_path):
    path, jobs = tmp_path / "sih.csv", spark.sparkContext.statusTracker()
    head = "N_AIH,MUNIC_RES,MUNIC_MOV,CNES,DT_INTER,DT_SAIDA,DIAS_PERM,DIAG_PRINC,PROC_REA,NOTE\n"
    path.write_text(head + "1,11,11,5,20200101,20200103,2,C50,1,a\n2,11,11,5,20200232,20200303,2,C50,1,a\n3,11\n4,x,11,5,,,2,C50,1,a\n")
    rejects = str(tmp_path / "rejects")
    spark.sparkContext.setJobGroup("one-scan", "reads")
    with pytest.raises(tables.RejectedRows, match="3 rows"):
        tables.read_source(spark, str(path), "episodes")
    spark.sparkContext.setJobGroup("other", "reads")
    assert len(jobs.getJobIdsForGroup("one-scan")) == 2  # the header line, and the pass that parses, counts and writes
    kept = tables.read_source(spark, str(path), "episodes", rejects=rejects)
    path.unlink()
    assert rows(kept, "episode_id") == [(1,)]
    assert rows(kept, "facility_id") == [(5,)]
    assert sorted(r["row"][:2] for r in spark.read.parquet(rejects).collect()) == ["3,", "4,", '{"']


def test_lines_of_a_wrong_length_and_plain_scans(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("codigo_ibge,latitude,longitude,name\n1,2.0,3.0,a\n2,2.0,3.0\n3,2.0,3.0,a,b\n")
    with pytest.raises(tables.RejectedRows, match="2 rows"):
        tables.read_source(spark, str(path), "geo")
    assert rows(tables.read_source(spark, str(path), "geo", whole_lines=False), "code_full") == [(1,), (2,), (3,)]
    assert rows(tables.read_table(spark, str(path), tables.GEO, columns=["latitude"], whole_lines=False)) == [(2.0,)] * 3
    with pytest.raises(ValueError, match="name"):
        tables.read_table(spark, str(path), tables.GEO, columns=["name"])
    spark.createDataFrame([(1, 2.0, 3.0, "a")], "codigo_ibge long, latitude double, longitude double, name string").write.parquet(str(tmp_path / "geo"))
    df = tables.read_source(spark, str(tmp_path / "geo"), "geo", "parquet")
    assert df.inputFiles()[0].endswith(".parquet") and "geo" in df.inputFiles()[0]  # not a copy
    assert rows(df) == [(1, 2.0, 3.0)]
