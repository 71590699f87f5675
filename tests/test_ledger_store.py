"""Base plus batches against a full rebuild, and what a batch rewrites."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from careflow.operators import ledger as led
from careflow.sources import ledger_store as store

SCHEMA = "episode_id long, patient_type string, facility_id long, admit_date date, discharge_date date"


def day(n):
    return dt.date(2018, 1, 1) + dt.timedelta(days=n)


def stays(n, start, facilities, span=300):
    """``n`` episodes from day ``start`` on; every ninth is still open."""
    return [
        (start * 10_000 + k, "ABC"[k % 3], facilities[k % len(facilities)], day(start + k * 7 % span), day(start + k * 7 % span + k % 23) if k % 9 else None)
        for k in range(n)
    ]


def moved(spark, rows):
    return led.movements(spark.createDataFrame(rows, SCHEMA), "patient_type", "2019-01-01", "2019-06-01")


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df.select(*cols).collect()))


def files(path):
    return {
        os.path.relpath(os.path.join(folder, n), path): os.stat(os.path.join(folder, n)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for n in names
        if n.endswith(".parquet")
    }


def units(names):
    return {os.path.dirname(n) for n in names}


def test_base_and_batches_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert not store.has_ledger(spark, path)
    parts = [stays(200, 0, [1, 2, 3, 4, 5, 6], 900), stays(40, 700, [3, 99]), stays(30, 100, [5]), stays(10, 2500, [1])]
    store.start_ledger(moved(spark, parts[0]), path, buckets=8)
    assert store.has_ledger(spark, path)
    for n, part in enumerate(parts[1:], 1):
        assert store.add_batch(moved(spark, part), path, f"b{n}")
        whole = moved(spark, [r for p in parts[: n + 1] for r in p])
        assert table(store.running_rows(spark, path)) == table(led.running_census(whole))
        dense = led.ledger_from_running(store.running_rows(spark, path))
        assert table(dense) == table(led.ledger_from_movements(whole))
    window = led.ledger_from_running(store.running_rows(spark, path), "2019-02-01", "2019-03-01")
    assert table(window) == table(led.ledger_from_movements(whole, "2019-02-01", "2019-03-01"))


def test_only_touched_units_are_written(spark, tmp_path):
    path = str(tmp_path / "ledger")
    base = stays(300, 0, list(range(1, 21)), 1400)
    store.start_ledger(moved(spark, base), path, buckets=64)
    before = files(f"{path}/rows")
    batch = [(1, "A", 7, day(800), day(803))]  # 2020: the units of 2018 and 2019 stay, as do all other buckets
    store.add_batch(moved(spark, batch), path, "one")
    after = files(f"{path}/rows")
    gone, new = units(before.keys() - after.keys()), units(after.keys() - before.keys())
    assert all(before[n] == after[n] for n in before.keys() & after.keys())
    assert len({u.split("/")[0] for u in new}) == 1
    assert {u.split("/")[1] for u in new} <= {"year=2020", "year=2021", "year=2022"}
    assert gone <= new
    assert len(before.keys() & after.keys()) > len(new)


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    base, more = stays(50, 0, [1, 2]), stays(20, 200, [2, 3])
    store.start_ledger(moved(spark, base), path, buckets=4)
    assert store.add_batch(moved(spark, more), path, "b")
    want = table(store.running_rows(spark, path))
    assert not store.add_batch(moved(spark, more), path, "b")
    assert store.add_batch(moved(spark, []), path, "empty")
    assert not store.add_batch(moved(spark, more), path, "empty")
    assert table(store.running_rows(spark, path)) == want
    with pytest.raises(ValueError):
        store.add_batch(moved(spark, more), path, "../b")
    with pytest.raises(ValueError, match="releases"):
        store.add_batch(moved(spark, more).drop("releases"), path, "narrow")


@pytest.mark.parametrize("stopped_at", ["_move_in", "_note"])
def test_a_stopped_writer_is_made_good(spark, tmp_path, monkeypatch, stopped_at):
    path = str(tmp_path / "ledger")
    base, more, last = stays(50, 0, [1, 2]), stays(20, 200, [2, 3]), stays(5, 300, [1])
    store.start_ledger(moved(spark, base), path, buckets=4)
    real = getattr(store, stopped_at)

    def stop(*args):
        # before moving in, or after it but before the note of it
        if stopped_at == "_move_in" or args[3] == store.APPLIED:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(store, stopped_at, stop)
    with pytest.raises(RuntimeError, match="lost"):
        store.add_batch(moved(spark, more), path, "b")
    monkeypatch.setattr(store, stopped_at, real)
    nothing = moved(spark, more).where(F.raise_error(F.lit("read again")).isNull())
    if stopped_at == "_move_in":
        assert store.add_batch(nothing, path, "b")  # the prepared rows count
        both = base + more
    else:
        assert store.add_batch(moved(spark, last), path, "c")  # another batch finishes it first
        assert not store.add_batch(nothing, path, "b")
        both = base + more + last
    assert table(store.running_rows(spark, path)) == table(led.running_census(moved(spark, both)))


def test_a_store_without_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    store.start_ledger(moved(spark, []), path)
    assert store.running_rows(spark, path).count() == 0
    some = stays(20, 0, [1])
    assert store.add_batch(moved(spark, some), path, "b")
    assert table(store.running_rows(spark, path)) == table(led.running_census(moved(spark, some)))
