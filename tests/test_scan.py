"""Scans and folds inside keys against loops, with a key that holds a third of all rows and more."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import evaluate, scan, store

rng = random.Random(3)


def events(n, hot=0.5):
    return [(1 if rng.random() < hot else rng.randrange(2, 40), i * 3) for i in range(n)]


@pytest.mark.parametrize("bound", [None, 20])
def test_sums_and_maxima_are_those_of_a_loop(spark, bound):
    rows = [(k, s, rng.choice([None, 1, 2, 50])) for k, s in events(900)] + [(1, 7, 3), (1, 7, 4), (None, 4, 5)]
    df = spark.createDataFrame(rows, "k long, s long, v long").repartition(5)
    got = scan.scan(df, ["k"], "s", {"total": (F.sum, F.col("v")), "most": (F.max, F.col("v"))}, "v", bound=bound)
    want, seen = [], {}
    for k, s, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)):
        before = [x for x in seen.get(k, []) if x is not None]
        want.append((k, s, v, sum(before) if before else None, max(before, default=None)))
        seen.setdefault(k, []).append(v)
    assert sorted(map(repr, map(tuple, got.select("k", "s", "v", "total", "most").collect()))) == sorted(map(repr, want))
    where = scan.positions(df, ["k"], "s", "v", bound=bound).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"))
    assert where.where("n <> d or m <> n - 1").count() == 0


def test_a_hot_key_is_cut_and_others_are_not(spark):
    df = spark.createDataFrame(events(4000), "k long, s long")
    got = scan.ranged(df, ["k"], "s", 1000).groupBy("k", "__range").count().collect()
    assert {r["__range"] for r in got if r.k != 1} == {-1}
    hot = [r["count"] for r in got if r.k == 1]
    assert len(hot) > 200 and max(hot) < 40
    cut = scan.scan(df, ["k"], "s", {"n": (F.sum, F.lit(1))}, bound=1000).withColumn("task", F.spark_partition_id())
    assert cut.where("k = 1").select("task").distinct().count() == 4  # all tasks of this session


@pytest.mark.parametrize("block", [4, 256])
def test_guarded_moves_are_those_of_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rows = [(k, s, rng.choice([*store.STATES, "ODD", None])) for k, s in events(1500)]
    got = store.guard_transitions(spark.createDataFrame(rows, "file_id long, seq long, status string"), bound=100)
    state, want = {}, []
    for k, s, w in rows:
        now = state.get(k, "ACTIVE")
        good = (now, w) in store.MOVES
        state[k] = w if good else now
        want.append((k, s, good, state[k]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not any("Python" in line or "InPandas" in line for line in got._jdf.queryExecution().toString().split("\n"))


@pytest.mark.parametrize("block,rising", [(4, True), (4, False), (256, True)])
def test_compare_and_set_is_that_of_a_loop(spark, monkeypatch, block, rising):
    monkeypatch.setattr(scan, "BLOCK", block)
    catalog = [(k, k % 3) for k in range(1, 40)]
    now, rows, want = dict(catalog), [], []
    for k, s in events(1200):
        if rising:  # what writers do: most expect the current version, some an older one
            expected = now[k] - (rng.random() < 0.2)
            new = expected + 1
        else:
            expected, new = rng.randrange(5), rng.randrange(5)
        swapped = now[k] == expected
        now[k] = new if swapped else now[k]
        rows.append((k, s, expected, new))
        want.append((k, s, swapped, now[k]))
    got = store.compare_and_set(spark.createDataFrame(rows, "file_id long, seq long, expected long, new_version long"), spark.createDataFrame(catalog, "file_id long, version long"), bound=100)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    empty = spark.createDataFrame([], "file_id long, seq long, expected long, new_version long")
    assert store.compare_and_set(empty, spark.createDataFrame(catalog, "file_id long, version long")).count() == 0
    with pytest.raises(Exception, match="no file 99"):
        store.compare_and_set(spark.createDataFrame([(99, 0, 0, 1)], empty.schema), spark.createDataFrame(catalog, "file_id long, version long")).collect()


@pytest.mark.parametrize("bound", [None, 30])
def test_refused_calls_add_nothing(spark, bound):
    rows = [("hot" if k == 1 else f"arm{k % 3}", s, rng.choice(["Ollama", "paid"]), rng.choice([None, 1, 5])) for k, s in events(600)]
    got = evaluate.running_cap(spark.createDataFrame(rows, "arm string, seq long, provider string, cost_usd long"), 300, bound=bound)
    spent, want = {}, []
    for arm, s, provider, cost in rows:
        before = spent.get(arm, 0)
        refused = provider == "paid" and before >= 300
        want.append((arm, s, before, refused))
        spent[arm] = before + (0 if refused else cost or 0)
    assert sorted(map(tuple, got.select("arm", "seq", "spent_before", "refused").collect())) == sorted(want)
    assert any(w[3] for w in want) and max(w[2] for w in want) > 306  # free calls go on adding


def test_pins_and_sizes_of_a_hot_key(spark):
    pins = [(0, i, 1 if i % 3 else -1) for i in range(1, 900)] + [(5, 1, 1), (5, 2, -1)]
    assert store.epoch_pins(spark.createDataFrame(pins, "epoch long, seq long, delta int"), bound=50).collect() == [(0, sum(p[2] for p in pins[:-2]))]
    with pytest.raises(Exception, match="released twice"):
        store.epoch_pins(spark.createDataFrame([(0, i, 1 if i < 400 else -1) for i in range(900)], "epoch long, seq long, delta int"), bound=50).collect()
    app = [(1, i, None if i == 5 else "é" * (i % 4)) for i in range(700)]
    got = store.append_sizes(spark.createDataFrame(app, "file_id long, seq long, data string"), 1000, bound=50)
    sizes = [2 * (i % 4) * (i != 5) for i in range(700)]
    assert [tuple(r) for r in got.orderBy("seq").select("seq", "new_size").collect()] == [(i, sum(sizes[: i + 1])) for i in range(700)]
    assert got.where("crossed").count() == 1


@pytest.mark.parametrize("block,owners", [(8, 3), (256, 30)])
def test_leases_are_those_of_a_loop(spark, monkeypatch, block, owners):
    monkeypatch.setattr(scan, "BLOCK", block)
    rows, at = [], 0
    for k, s in events(400):
        at += rng.choice([0, 0, 1, 2, 9])
        rows.append((k, s, f"o{rng.randrange(owners)}", at))
    got = store.lease_decisions(spark.createDataFrame(rows, "file_id long, seq long, owner string, at long"), 10, bound=100)
    state, want = {}, []
    for k, s, owner, at in rows:
        holder, until = state.get(k, (None, -1))
        granted = at >= until or owner == holder
        if granted:
            state[k] = (owner, at + 10)
        want.append((k, s, owner, granted, *state[k]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[3] for w in want} == {True, False}


def test_the_cuts_of_a_scan_are_taken_once(spark):
    """Cuts are approximate: each part of a plan that reads them must read the same ones, so they are written, and no part takes them anew."""
    rows = spark.createDataFrame([(i % 2 * (i % 7), i) for i in range(900)], "k long, seq long")
    x = scan.positions(rows, ["k"], "seq", bound=50)
    plan = x._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "weft-cuts" in plan
    assert sorted(r.pos for r in x.where("k = 0").collect()) == list(range(rows.where("k = 0").count()))
