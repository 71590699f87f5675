"""Even shards by balanced label propagation over linked documents.

Documents with the same text are linked. They start in shards by hash; in each round a document looks at its neighbours'
shards and wants to go to where most of them are. How many may go from one shard to another is a quota: as many bytes as
come back the other way, and what the target has room for. Then the documents without links fill all shards to the same
size, and a few passes even out what chance leaves.

Documents of one text in one shard are alike, so they are one row, a *cell*, with their number. A text that a third of all
documents share is a cell in each shard and moves in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.ranks import placed
from careflow.session import cut_lineage

CELL = ["key", "size", "shard"]


def _chance(*salt: Column | str | int) -> Column:
    """A number in [0, 1) that depends on a cell and on ``salt`` only."""
    salts = [F.lit(s) if isinstance(s, (str, int)) else s for s in salt]
    return F.pmod(F.xxhash64("key", "size", "shard", *salts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _gathered(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(F.sum("n").alias("n"))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Bytes by shard: one number for each comes to the driver."""
    found = {r["shard"]: r["b"] for r in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _wanting(cells: DataFrame, loads: list[int], open_to: list[bool], shards: int) -> DataFrame:
    """``cells`` with ``goal``: the shard that holds most documents of the text, of the open ones and the own one.

    Between equally many the emptier shard wins, then one that depends on the text.
    """
    votes = cells.groupBy("key", "shard").agg(F.sum("n").alias("docs"))
    # at most one entry per shard
    votes = votes.groupBy("key").agg(F.collect_list(F.struct("shard", "docs")).alias("votes"))
    load = F.array(*(F.lit(int(x)) for x in loads))
    open_ = F.array(*map(F.lit, open_to))

    def rank(v: Column) -> Column:
        lot = F.pmod(F.col("key") + v["shard"], F.lit(shards))
        return F.struct(v["docs"].alias("docs"), (-F.get(load, v["shard"])).alias("free"), lot.alias("lot"), v["shard"].alias("to"))

    asked = F.filter("votes", lambda v: F.get(open_, v["shard"]) | (v["shard"] == F.col("shard")))
    return cells.join(votes, "key").withColumn("goal", F.array_max(F.transform(asked, rank))["to"]).drop("votes")


def _shares(wishes: dict[tuple[int, int], int], room: list[float]) -> dict[tuple[int, int], float]:
    """Part of each wish (from, to) -> bytes that is granted: what comes back from there, and what there is room for."""
    back = {k: min(b, wishes.get(k[::-1], 0)) for k, b in wishes.items()}
    extra = {}
    for (_, to), b in ((k, wishes[k] - back[k]) for k in wishes):
        extra[to] = extra.get(to, 0) + b
    granted = {}
    for k, b in wishes.items():
        fits = min(1.0, max(0.0, room[k[1]]) / extra[k[1]]) if extra[k[1]] else 0.0
        granted[k] = (back[k] + (b - back[k]) * fits) / b
    return granted


def _move(cells: DataFrame, part: Column, goal: Column, chance: Column) -> DataFrame:
    """``part`` of each cell's documents goes to ``goal``; a fraction of a document is decided by ``chance``."""
    n = F.least(F.col("n"), F.floor(F.col("n") * part + chance)).cast("long")
    split = cells.withColumn("m", F.when(goal.isNotNull(), F.coalesce(n, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    stay = F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("m")).alias("n"))
    gone = F.struct(goal.alias("shard"), F.col("m").alias("n"))
    moved = split.select("key", "size", F.inline(F.array(stay, gone)))
    return _gathered(moved.where("n > 0"))


def propagated(
    cells: DataFrame, shards: int, capacity: float, rounds: int, enough: float, worth: float = 0.02
) -> DataFrame:
    """Rounds of label propagation under quotas; ends early when less than ``enough`` of the bytes wish to move.

    In every other round all shards may be wished for, so that documents change places; in the rounds between only those
    with room for ``worth`` of their capacity, since a fuller one would draw wishes that it can't grant.
    """
    idle = 0
    for turn in range(rounds):
        loads = _loads(cells, shards)
        room = [capacity - x for x in loads]
        open_to = [turn % 2 == 0 or r > worth * capacity for r in room]
        wanting = cut_lineage(_wanting(cells, loads, open_to, shards))
        flows = wanting.where("goal <> shard").groupBy("shard", "goal").agg(F.sum(F.col("n") * F.col("size")).alias("b"))
        wishes = {(r["shard"], r["goal"]): r["b"] for r in flows.collect()}  # at most one row per pair of shards
        granted = _shares(wishes, room)
        moved = sum(b * granted[k] for k, b in wishes.items())
        idle = idle + 1 if moved <= enough * sum(loads) else 0
        if idle == 2 or not wishes and turn % 2 == 0:
            break
        if not moved:
            continue
        table = F.array(*(F.lit(float(granted.get((a, b), 0.0))) for a in range(shards) for b in range(shards)))
        part = F.when(F.col("goal") != F.col("shard"), F.get(table, F.col("shard") * shards + F.col("goal"))).otherwise(0.0)
        cells = cut_lineage(_move(wanting, part, F.col("goal"), _chance("move", turn)))
    return cells


def _by_interval(chance: Column, ends: list[float]) -> Column:
    """The first index whose end is above ``chance``, or the last one."""
    out = F.lit(len(ends) - 1)
    for k in reversed(range(len(ends) - 1)):
        out = F.when(chance < F.lit(float(ends[k])), F.lit(k)).otherwise(out)
    return out


def _ends(parts: list[float]) -> list[float]:
    total, ends, whole = 0.0, [], sum(parts)
    for p in parts:
        total += p
        ends.append(total / whole if whole else 0.0)
    return ends


def filled(lonely: DataFrame, loads: list[int], target: float) -> DataFrame:
    """Cells without links, dealt to the shards in proportion to the room that the linked ones leave."""
    ends = _ends([max(0.0, target - x) for x in loads])
    share = [b - a for a, b in zip([0.0, *ends], ends)]
    dealt = lonely.withColumn("shard", F.lit(0))  # the chance must not depend on the shard
    return dealt.withColumn("shard", _by_interval(_chance("fill"), ends if sum(share) else _ends([1.0] * len(loads))))


def evened(cells: DataFrame, shards: int, target: float, passes: int, within: float) -> DataFrame:
    """Documents move from shards above the target to those below it, until all are ``within`` that part of it.

    Documents without links go first; linked ones (``linked``) only if those don't suffice. Only documents that are not
    larger than what the fullest shard has too much can make it better. The best state of all passes is returned.
    """
    best, least = cells, None
    for turn in range(passes + 1):
        loads = _loads(cells, shards)
        off = max(abs(x - target) for x in loads)
        if least is None or off < least:
            best, least = cells, off
        if off <= within * target or turn == passes:
            break
        over = [max(0.0, x - target) for x in loads]
        under = _ends([max(0.0, target - x) for x in loads])
        above = F.array(*(F.lit(x) for x in over))
        fit = cells.where((F.get(above, F.col("shard")) > 0) & (F.col("size") <= F.get(above, F.col("shard"))))
        sums = fit.groupBy("shard", "linked").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()
        able = {(r["shard"], r["linked"]): r["b"] for r in sums}  # at most two rows per shard
        if not able:
            break
        parts = {}
        for s in range(shards):
            left = over[s]
            for kind in (False, True):
                b = able.get((s, kind), 0)
                parts[s, kind] = min(1.0, left / b) if b else 0.0
                left -= parts[s, kind] * b
        table = F.array(*(F.lit(float(parts[s, kind])) for s in range(shards) for kind in (False, True)))
        eligible = F.col("size") <= F.get(above, F.col("shard"))
        part = F.when(eligible, F.get(table, F.col("shard") * 2 + F.col("linked").cast("int"))).otherwise(0.0)
        goal = _by_interval(_chance("goal", turn), under)
        kinds = [
            _move(cells.where(F.col("linked") == kind), part, goal, _chance("even", turn)).withColumn("linked", F.lit(kind))
            for kind in (False, True)
        ]
        cells = cut_lineage(kinds[0].unionByName(kinds[1]))
    return best


def shard_cells(
    cells: DataFrame, shards: int, headroom: float = 0.02, rounds: int = 12, passes: int = 8, enough: float = 0.001, within: float = 0.001
) -> DataFrame:
    """(key, size, shard, n, linked) after propagation, filling and evening, from (key, size, shard, n)."""
    totals = cells.groupBy("key").agg(F.sum("n").alias("docs"))
    known = cut_lineage(cells.join(totals, "key"))
    target = sum(_loads(known, shards)) / shards
    linked = propagated(known.where("docs > 1").drop("docs"), shards, target * (1 - headroom), rounds, enough)
    lonely = filled(known.where("docs = 1").drop("docs"), _loads(linked, shards), target)
    both = lonely.select(*CELL, "n", F.lit(False).alias("linked")).unionByName(
        linked.select(*CELL, "n", F.lit(True).alias("linked"))
    )
    return evened(cut_lineage(both), shards, target, passes, within)


def balanced_shards(docs: DataFrame, shards: int = 16, **parameters) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, shard and slot (gapless from 0 in doc_id order) of every document.

    Documents of equal texts are linked; the shards' sizes differ from each other as little as the sizes of documents let
    them. Reruns agree: all chance comes from hashes of contents. Parameters as in ``shard_cells``.

    A null text is 1 byte large, has the crc32 of an empty one, and is linked with other nulls; a null id comes first in
    its shard; repeated rows are documents of their own, and copies of one text are dealt to the shards that the text
    has, in the order of their ids. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
    )
    narrow = cut_lineage(narrow)
    begin = F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int")
    cells = cut_lineage(narrow.withColumn("shard", begin).groupBy(*CELL).agg(F.count("*").alias("n")))
    cells = shard_cells(cells, shards, **parameters)
    first = F.min("shard").alias("shard")
    spread = cells.groupBy("key", "size").agg(
        F.count("*").alias("cells"), first, F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("parts")
    )
    spread = cut_lineage(spread)
    whole = narrow.join(spread.where("cells = 1").select("key", "size", "shard"), ["key", "size"])
    # texts in several shards: their documents by place, each shard's part behind the one before
    ranked = placed(narrow.join(spread.where("cells > 1").select("key", "size"), ["key", "size"], "left_semi"), ["key", "size"], [F.col("doc_id").asc_nulls_first()])
    state = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("shard"))
    found = F.aggregate(
        "parts",
        state,
        lambda s, p: F.when(
            s["upto"] < F.col("place"), F.struct((s["upto"] + p["n"]).alias("upto"), p["shard"].alias("shard"))
        ).otherwise(s),
    )
    dealt = ranked.join(spread.where("cells > 1").select("key", "size", "parts"), ["key", "size"])
    dealt = dealt.withColumn("shard", found["shard"]).select(whole.columns)
    slots = placed(cut_lineage(whole.unionByName(dealt)), ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("key")])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - 1).alias("slot"))
