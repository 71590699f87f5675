"""The auction against the exact optimum of the transport problem."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from careflow.plans import allocation as alloc
from careflow.plans.auction import assign_by_auction

DAY = dt.date(2021, 3, 1)
DEMAND = "weight double, patient_type string, area_id long, date date, qty long"
COSTS = "weight double, area_id long, facility_id long, date date, cost double"
ROOM = "weight double, patient_type string, facility_id long, date date, room long"
OVER = "weight double, area_id long, date date, cost double"


def optimum(qty, room, cost, over):
    """Least cost of placing all patients, by shortest augmenting paths, one patient at a time (Bellman-Ford)."""
    flow, total = {}, 0.0
    for a in qty:
        for _ in range(qty[a]):
            dist, via = {("a", a): 0.0}, {}
            for _ in range(2 * (len(qty) + len(room)) + 2):
                changed = False
                for node, d in list(dist.items()):
                    kind, k = node
                    if kind == "a":
                        steps = [(("h", h), cost[k, h]) for h in room] + [(("o", k), over[k])]
                    elif kind == "h":
                        steps = [(("a", b), -cost[b, k]) for b in qty if flow.get((b, k), 0) > 0]
                    else:
                        steps = []
                    for to, c in steps:
                        if d + c < dist.get(to, float("inf")) - 1e-12:
                            dist[to], via[to], changed = d + c, node, True
                if not changed:
                    break
            ends = [n for n in dist if n[0] == "o" or n[0] == "h" and sum(flow.get((b, n[1]), 0) for b in qty) < room[n[1]]]
            at = min(ends, key=dist.get)
            total += dist[at]
            while at in via:
                back = via[at]
                if at[0] == "h":
                    flow[back[1], at[1]] = flow.get((back[1], at[1]), 0) + 1
                elif at[0] == "a":
                    flow[at[1], back[1]] -= 1
                at = back
    return total


def tables(spark, problems):
    demand, costs, room, over = [], [], [], []
    for w, (qty, rooms, cost, far) in problems.items():
        demand += [(w, "A", a, DAY, n) for a, n in qty.items()]
        costs += [(w, a, h, DAY, c) for (a, h), c in cost.items()]
        room += [(w, "A", h, DAY, n) for h, n in rooms.items()]
        over += [(w, a, DAY, c) for a, c in far.items()]
    frames = (demand, DEMAND), (costs, COSTS), (room, ROOM), (over, OVER)
    return [spark.createDataFrame(rows, schema) for rows, schema in frames]


def solved(spark, problems, epsilon, **kw):
    demand, costs, room, over = tables(spark, problems)
    plan = assign_by_auction(demand, alloc.offers_by_cost(costs), room, over, dict.fromkeys(problems, epsilon), **kw).collect()
    out = {}
    for w, (qty, rooms, cost, far) in problems.items():
        mine = [r for r in plan if r["weight"] == w]
        assert {a: sum(r["qty"] for r in mine if r["area_id"] == a) for a in qty} == qty
        load = {h: sum(r["qty"] for r in mine if r["facility_id"] == h) for h in rooms}
        assert all(load[h] <= rooms[h] for h in rooms)
        out[w] = sum(r["qty"] * (cost[r["area_id"], r["facility_id"]] if r["facility_id"] else far[r["area_id"]]) for r in mine)
    return out


LONG = pytest.mark.skipif("CAREFLOW_ALL" not in os.environ, reason="many rounds of small jobs: several minutes")


def test_rivals_for_the_same_facility(spark):
    cost = {(1, 1): 1.0, (1, 2): 2.0, (2, 1): 1.5, (2, 2): 5.0}
    problem = ({1: 2, 2: 2}, {1: 2, 2: 3}, cost, {1: 50.0, 2: 50.0})
    got = solved(spark, {0.5: problem}, 0.1, phases=(1,))
    assert optimum(*problem) - 1e-9 <= got[0.5] <= optimum(*problem) + 0.1 * 4


@LONG
@pytest.mark.parametrize("depth", [4])
def test_within_epsilon_of_the_optimum(spark, depth):
    rng, problems = random.Random(11), {}
    for k in range(16):
        areas, places = range(1, rng.randint(2, 6)), range(1, rng.randint(2, 6))
        qty = {a: rng.randint(1, 6) for a in areas}
        room = {h: rng.randint(1, 7) for h in places}
        cost = {(a, h): float(rng.choice([1, 2, 3, 5, 8, rng.random() * 10])) for a in areas for h in places}
        problems[k / 100] = (qty, room, cost, {a: float(rng.choice([4, 20])) for a in areas})
    got = solved(spark, problems, 0.4, depth=depth, phases=(4, 1))
    for w, (qty, *rest) in problems.items():
        best = optimum(qty, *rest)
        assert best - 1e-9 <= got[w] <= best + 0.4 * sum(qty.values()) + 1e-9


@LONG
def test_rounds_do_not_grow_with_rivals_for_one_facility(spark, monkeypatch):
    """All areas want the same facility first; four times as many of them take about as many rounds."""
    from careflow.plans import auction

    rounds = []
    monkeypatch.setattr(auction, "_bids", lambda *a, f=auction._bids: rounds.append(1) or f(*a))
    counts = {}
    for n in (5, 20):
        cost = {(a, h): 1.0 + h + 0.001 * a * h for a in range(1, n + 1) for h in range(1, n + 1)}
        problem = {0.5: ({a: 1 for a in range(1, n + 1)}, {h: 1 for h in range(1, n + 1)}, cost, dict.fromkeys(range(1, n + 1), 1000.0))}
        rounds.clear()
        got = solved(spark, problem, 0.25, depth=32, phases=(4, 1))
        counts[n] = len(rounds)
        assert got[0.5] <= optimum(*problem[0.5]) + 0.25 * n
    assert counts[20] <= 2 * counts[5]


def test_room_for_all_gives_the_cheapest_plan_and_edge_cases(spark):
    wide = {0.5: ({1: 3, 2: 2}, {1: 9, 2: 9}, {(1, 1): 1.0, (1, 2): 2.0, (2, 1): 5.0, (2, 2): 4.0}, {1: 50.0, 2: 50.0})}
    assert solved(spark, wide, 0.0)[0.5] == 3 * 1 + 2 * 4
    none = {0.5: ({1: 3}, {1: 0}, {(1, 1): 1.0}, {1: 50.0})}
    demand, costs, room, over = tables(spark, none)
    (row,) = assign_by_auction(demand, alloc.offers_by_cost(costs), room, over, {0.5: 0.1}).collect()
    assert (row["facility_id"], row["qty"]) == (0, 3)
    empty = assign_by_auction(demand.limit(0), alloc.offers_by_cost(costs), room, over, {0.5: 0.1})
    assert empty.collect() == []
    with pytest.raises(ValueError):
        assign_by_auction(demand, alloc.offers_by_cost(costs), room, over, {0.5: -1.0})
