"""Scans inside keys: sums, maxima and folds over a key's rows in order, for keys of any size.

A window by key puts a key's rows in one task. Here keys of more than BOUND rows are cut in ranges of the order column, at
approximate quantiles of their own; a range's rows are scanned by a window of their own and what the ranges before it hold
is a window over RANGES rows a key at most. Smaller keys have one range and take no part in the second level.

fold_states is the same for functions that do not commute. Events are maps from state to state; a block of BLOCK events
composes to one map, blocks of blocks to maps again, until a key has one block. Down from there each block learns
the state in which it is entered, and all blocks replay their events at once. No row holds more than BLOCK events or maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_dir, staged

#: Rows of a key from which it is cut; the ranges it is cut in, a power of two.
BOUND, RANGES = 1_000_000, 1024
#: Rows that a task of a scan should sort.
ROWS = 1_000_000
#: Events or maps that are folded at once.
BLOCK = 256


def _rank(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are smaller than value, by halving."""
    steps = []
    while not steps or steps[-1] > 1:
        steps.append(RANGES >> (len(steps) + 1))
    far = lambda at, step: F.coalesce((at + step <= F.size(cuts)) & (F.element_at(cuts, at + step) < value), F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(far(at, step), at + step).otherwise(at))


def ranged(df: DataFrame, keys: list[str], order: str, bound: int | None = None) -> DataFrame:
    """df with __range: -1 for keys of at most bound rows, else the number of the range that the row's order (a number) is in.

    The cuts are written: they are approximate, so a second reader that took them anew could see others. They are broadcast,
    a row for each bound rows of df at most, so that no join deals a large key's rows to one task.
    """
    heavy = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > (BOUND if bound is None else bound)).select(*keys)
    at = [i / RANGES for i in range(1, RANGES)]
    cuts = df.select(*keys, order).join(F.broadcast(heavy), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), at, 10 * RANGES).alias("__cuts"))
    cuts = staged(cuts, new_dir(df.sparkSession, "cuts"))
    place = F.when(F.col("__cuts").isNull(), F.lit(-1)).otherwise(_rank(F.col("__cuts"), F.col(order).cast("double")))
    return df.join(F.broadcast(cuts), keys, "left").withColumn("__range", place).drop("__cuts")


def _tasks(df: DataFrame) -> int:
    """Tasks that a window over df needs, so that none sorts much more than ROWS rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def scan(df: DataFrame, keys: list[str], order: str, over: dict[str, tuple[Callable, Column]], *then: str, upto: bool = False, bound: int | None = None) -> DataFrame:
    """df with a column for each of over (name: aggregate and value): the aggregate over the rows of the same keys that come
    earlier in order of `order` (a number), then the other columns; with upto, the row itself counts too. F.sum, F.max and
    F.min are what it is for; null where no row counts."""
    x = df
    for name, (_, value) in over.items():
        x = x.withColumn(f"__{name}", value)
    n = _tasks(df)
    x = ranged(x, keys, order, bound)
    groups = [*keys, "__range"]
    last = 0 if upto else -1
    inside = Window.partitionBy(*groups).orderBy(order, *then).rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = x.where("__range >= 0").groupBy(*groups).agg(*[f(f"__{name}").alias(f"__b_{name}") for name, (f, _) in over.items()])
    bases = bases.select(*groups, *[f(f"__b_{name}").over(earlier).alias(f"__b_{name}") for name, (f, _) in over.items()])
    x = x.repartition(n, *groups)
    for name, (f, _) in over.items():
        x = x.withColumn(f"__i_{name}", f(f"__{name}").over(inside))
    x = x.join(F.broadcast(bases), groups, "left")  # RANGES rows a key that is cut
    both = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}
    for name, (f, _) in over.items():
        x = x.withColumn(name, both[f](F.col(f"__b_{name}"), F.col(f"__i_{name}")))
    return x.drop("__range", *[p + name for name in over for p in ("__", "__b_", "__i_")])


def positions(df: DataFrame, keys: list[str], order: str, *then: str, bound: int | None = None) -> DataFrame:
    """df with pos: the row's number within its keys, from 0."""
    x = scan(df, keys, order, {"pos": (F.sum, F.lit(1).cast("long"))}, *then, bound=bound)
    return x.withColumn("pos", F.coalesce("pos", F.lit(0).cast("long")))


def fold_states(events: DataFrame, key: str, order: str, initial: DataFrame, *, as_map: Callable, compose: Callable, apply: Callable, step: Callable, bound: int | None = None) -> DataFrame:
    """The events' columns with before and state (before and after the event), folding each key's events in order of `order` (a number,
    distinct within a key). initial: key, state, a row for each key.

    as_map(events) is the map, a column, of an array of events in order; compose(first, second) that of two maps;
    apply(map, state) the state after a map; step(state, event) the state after an event. Events are structs of the
    columns. Only keys of more than BLOCK events need maps; what a map holds is as_map's and compose's to bound.
    """
    spark, base = events.sparkSession, new_dir(events.sparkSession, "fold")
    columns = events.columns
    rows = positions(events, [key], order, bound=bound)
    body = F.struct("pos", *[c for c in columns if c != key])
    blocks = rows.groupBy(key, F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(body)).alias("events"))
    blocks = staged(blocks, f"{base}/blocks")
    depth = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    entered = initial.select(key, F.lit(0).cast("long").alias("block"), "state")
    if depth > 0:
        # up: the maps of blocks, of blocks of blocks, and so on until a key has one group of them
        many = blocks.where("block > 0").select(key).distinct()
        levels = [staged(blocks.join(many, key, "left_semi").select(key, "block", as_map(F.col("events")).alias("map")), f"{base}/maps-0")]
        pair = F.array_sort(F.collect_list(F.struct("block", "map"))).alias("m")
        while depth >= BLOCK:
            depth //= BLOCK
            grouped = levels[-1].groupBy(key, F.floor(F.col("block") / BLOCK).alias("up")).agg(pair)
            whole = F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.element_at("m", 1)["map"], lambda a, x: compose(a, x["map"]))
            levels.append(staged(grouped.select(key, F.col("up").alias("block"), whole.alias("map")), f"{base}/maps-{len(levels)}"))
        # down: the state in which each block of a group is entered
        state = initial.schema["state"].dataType.simpleString()
        start = F.struct(F.col("state").alias("state"), F.expr(f"cast(array() as array<struct<block:bigint,state:{state}>>)").alias("out"))
        inside = initial.join(many, key, "left_semi").select(key, F.lit(0).cast("long").alias("up"), "state")
        for i, maps in reversed(list(enumerate(levels))):
            grouped = maps.groupBy(key, F.floor(F.col("block") / BLOCK).alias("up")).agg(pair).join(inside, [key, "up"])
            told = F.aggregate("m", start, lambda a, x: F.struct(apply(x["map"], a["state"]).alias("state"), F.concat(a["out"], F.array(F.struct(x["block"].alias("block"), a["state"].alias("state")))).alias("out")))
            inside = staged(grouped.select(key, F.inline(told["out"])), f"{base}/entered-{i}")
            inside = inside.withColumnRenamed("block", "up") if i else inside
        entered = entered.join(many, key, "left_anti").unionByName(inside)
    replayed = blocks.join(entered, [key, "block"])
    kind = blocks.schema["events"].dataType.elementType.simpleString()
    state = initial.schema["state"].dataType.simpleString()
    start = F.struct(F.col("state").alias("state"), F.expr(f"cast(array() as array<struct<event:{kind},before:{state},state:{state}>>)").alias("out"))

    def after(a, e):
        s = step(a["state"], e)
        return F.struct(s.alias("state"), F.concat(a["out"], F.array(F.struct(e.alias("event"), a["state"].alias("before"), s.alias("state")))).alias("out"))

    out = replayed.select(key, F.inline(F.aggregate("events", start, after)["out"]))
    return out.select(key, *[F.col(f"event.{c}").alias(c) for c in columns if c != key], "before", "state")
