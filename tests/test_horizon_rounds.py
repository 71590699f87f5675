"""The rolling plan against the same rounds in plain Python, with crowded facilities, and how many tables it writes."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.functions.calendar import daily_values
from careflow.plans import allocation as alloc
from careflow.plans import dual
from careflow.plans.horizon import plan_segments
from careflow.session import written_tables

DAY = dt.date(2021, 3, 1)
N, PARTS, TYPES, WEIGHTS = 6, 2, {"CANCER_CLINICAL": 2, "CANCER_SURGERY": 3}, [1.0, 0.4, 0.0]
DAYS = [DAY + dt.timedelta(days=i) for i in range(N)]
AREAS, PLACES = (1, 2, 3), range(1, 61)
BEDS = {(p, h, d): 1 + (h + d + len(p)) % 3 for p in TYPES for h in PLACES for d in range(N)}
KM = {(a, h): 10.0 * abs(a - h % 3) + 1 for a in AREAS for h in PLACES}
MET = {(d, h): h * 7 % 5 + d for d in range(N) for h in PLACES if (h + d) % 2}
WANT = {(p, a, d): 5 + (11 * a + 7 * d) % 23 for p in TYPES for a in AREAS for d in range(N)}


@pytest.fixture(scope="module")
def params(spark):
    initial = {("CANCER_CLINICAL", 5): 2, ("CANCER_SURGERY", 6): 1}
    releases = {("CANCER_CLINICAL", 5, 1): 1, ("CANCER_CLINICAL", 5, 4): 1}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "demand": make([(p, a, DAYS[d], q) for (p, a, d), q in WANT.items()] + [("CANCER_SURGERY", 9, DAY, 4), ("CANCER_SURGERY", None, DAY, 3)],
                       "patient_type string, area_id long, date date, qty long"),
        "distance": make([(a, h, k) for (a, h), k in KM.items()] + [(a, 0, 99999.9) for a in AREAS], "area_id long, facility_id long, km double"),
        "exposure": make([(DAYS[d], h, e) for (d, h), e in MET.items()], "date date, facility_id long, exposure long"),
        "capacity": make([(p, h, DAYS[d], n) for (p, h, d), n in BEDS.items()] + [(p, 0, d, 99999999) for p in TYPES for d in DAYS],
                         "patient_type string, facility_id long, date date, beds long"),
        "staff_hours": make([(h, d, 12) for h in range(61) for d in DAYS], "facility_id long, date date, hours long"),
        "los": make([*TYPES.items()], "patient_type string, los long"),
        "initial": make([(*k, n) for k, n in initial.items()], "patient_type string, facility_id long, census long"),
        "releases": make([(p, h, DAYS[d], n) for (p, h, d), n in releases.items()], "patient_type string, facility_id long, date date, releases long"),
    }


def rounds(free, want, cost, los, first):
    """Rounds of proposals of one weight and type, days counted from the segment's first one."""
    n, placed, open_ = len(next(iter(free.values()))), {}, dict(want)

    def fits(h, d):
        return max(0, min(free[h][d : d + los]))

    while open_:
        lists = {}
        for a, d in open_:
            options = sorted((cost(a, h, d), h) for h in free if fits(h, d) > 0)[: alloc.DEPTH]
            if options:
                lists[a, d] = [(c, h, fits(h, d)) for c, h in options]
        for a, d in set(open_) - set(lists):
            placed[a, 0, d] = placed.get((a, 0, d), 0) + open_.pop((a, d))
        ahead, asks = {}, {}
        for a, d in sorted(lists, key=lambda k: (k[1], lists[k][0][0], k[0])):
            key = lists[a, d][0][1], d // max(los, 1)
            before = ahead.get(key, 0)
            ahead[key] = before + open_[a, d]
            at = 0
            for c, h, room in lists[a, d]:
                q = min(at + room, before + open_[a, d]) - max(at, before)
                at += room
                if q > 0:
                    asks.setdefault((h, d), []).append((c, a, q))
        for h, d in sorted(asks, key=lambda k: k[1]):
            room = fits(h, d)
            for _, a, q in sorted(asks[h, d]):
                got = min(q, room)
                room -= got
                if got:
                    placed[a, h, d] = placed.get((a, h, d), 0) + got
                    open_[a, d] -= got
                    for day in range(d, min(d + los, n)):
                        free[h][day] -= got
        open_ = {k: q for k, q in open_.items() if q}
    return placed


def test_crowded_horizon_is_that_of_plain_rounds_and_writes_no_table_for_a_round(spark, params):
    before = written_tables()
    h = plan_segments(params, WEIGHTS, DAY, N, PARTS)
    got = {(r.weight, r.patient_type, r.area_id, r.facility_id, r.date): r.qty for r in h.plan.collect()}
    assert written_tables() - before < 8 + 2 * PARTS
    beds = {(r.weight, r.patient_type, r.facility_id, r.date): r.beds for r in h.beds.collect()}
    hours = {(r.weight, r.facility_id, r.date): r.hours for r in h.hours.collect()}
    per = {p: fv.HOURS_PER_PATIENT[p] for p in TYPES}
    first = params["demand"].where(F.col("date") <= F.lit(DAYS[2]))
    bounds = alloc.objective_bounds(first, params["distance"], params["exposure"]).first()
    spread = lambda kind: bounds[f"worst_{kind}"] - bounds[f"best_{kind}"]
    expected, stays = {}, []
    for segment, (lo, hi) in enumerate(((0, 3), (3, 6))):
        new = []
        for w, (p, los) in itertools.product(WEIGHTS, TYPES.items()):
            here = {}
            for x in PLACES:
                census = [sum(q for w2, p2, h2, d2, q in stays if (w2, p2, h2) == (w, p, x) and d2 <= d < d2 + los) for d in range(lo, hi)]
                started = {("CANCER_CLINICAL", 5): [2, 1, 1, 1, 0, 0], ("CANCER_SURGERY", 6): [1] * N}.get((p, x), [0] * N)
                here[x] = [min(beds[w, p, x, DAYS[d]], hours[w, x, DAYS[d]] // per[p]) - census[d - lo] - started[d] for d in range(lo, hi)]
            cost = lambda a, x, d, w=w, lo=lo: (w * KM[a, x] / spread("distance") + 0.0) + (0.0 + round(1 - w, 4) * 0.52 * MET.get((d + lo, x), 0) / spread("infection"))
            want = {(a, d - lo): q for (t, a, d), q in WANT.items() if t == p and lo <= d < hi}
            for (a, x, d), q in rounds(here, want, cost, los, lo).items():
                expected[w, p, a, x, DAYS[d + lo]] = q
                if x:
                    new.append((w, p, x, d + lo, q))
            if not segment and p == "CANCER_SURGERY":
                expected[w, p, 9, 0, DAY], expected[w, p, None, 0, DAY] = 4, 3
        stays += new
    assert got == expected
    assert any(x == 0 and a in AREAS for _, _, a, x, _ in got)  # crowded
    # what an earlier segment left is carried, whether or not the weight's plan touched the facility
    assert {r.weight for r in h.initial.where("segment = 1").collect()} == set(WEIGHTS)
    assert h.beds.groupBy("weight", "patient_type", "facility_id", "date").count().where("count > 1").isEmpty()
    assert len(beds) == len(WEIGHTS) * (len(BEDS) + len(TYPES) * N) and len(hours) == len(WEIGHTS) * 61 * N


def test_days_of_a_series_are_sorted_into_an_array(spark):
    """Each day was looked up in a map of all days, 120 x 120 steps a series."""
    rows = [(1, d, v) for d, v in zip(DAYS, (4, None, 6, 7, 8, 9), strict=True)] + [(2, DAYS[4], 5), (2, DAYS[1], 3)]
    df = spark.createDataFrame(rows, "k int, date date, v int")
    arrays = df.groupBy("k").agg(daily_values("date", "v", DAY, N).alias("x"))
    assert {r.k: r.x for r in arrays.collect()} == {1: [4, 0, 6, 7, 8, 9], 2: [0, 3, 0, 0, 5, 0]}
    assert "try_element_at" not in arrays._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="comes twice"):
        df.unionByName(df).groupBy("k").agg(daily_values("date", "v", DAY, N)).collect()


@pytest.mark.parametrize("free", [[1, 2, 3, 4], [1, 0, 3, -2], [0, 0, 0, 0], []])
@pytest.mark.parametrize("los", [0, 1, 2, 9])
def test_open_days_are_those_with_room_for_the_whole_stay(spark, free, los):
    df = spark.createDataFrame([(free, los)], "free array<long>, los int")
    tight = F.transform("free", lambda _, d: dual.fits(F.col("free"), d, F.col("los")))
    got = df.select(dual.open_days(F.col("free"), F.col("los")), tight).first()
    stays = [min(free[d : d + los], default=dual.UNLIMITED) for d in range(len(free))]
    assert got[0] == [x > 0 for x in stays] and got[1] == stays
