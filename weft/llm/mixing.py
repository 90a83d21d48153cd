"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every source is cut into BLOCKS blocks by a hash of the document id, so a source that holds a third of all rows is spread
over as many keys as any other has, and each block into as many cells as the output shards ask for. The target of a source
gives whole passes over its blocks and a remainder, which a first-fit walk over the permuted blocks fills. That fixes exact
quotas of cells. The tree then halves the list of output shards again and again; at each node the left half's quotas are
drawn from the multivariate hypergeometric distribution (conditional draws, source by source), so each leaf ends with an
exact number of cells of each source. A leaf takes the next disjoint range of each source's permuted cells and orders its
documents by a hash.

Scale. Texts are read once for their sizes. Shards have about SHARD_WORDS words however large the input is. What is
gathered in one row has a fixed bound: BLOCKS blocks of a source, and the quotas of a node (one for each source). Ranges
of cells meet their leaves by an equal rank, one row a cell. Seeds are fixed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240607
#: Words that an output shard should hold, and the fewest shards.
SHARD_WORDS, LEAST_SHARDS = 1 << 25, 16
#: Blocks of a source, and cells of a source that an output shard gets of those blocks' cells at least, on average.
BLOCKS, CELLS = 1024, 64


def _uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cols]), F.lit(1 << 53)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(src, nul, source_size, n_docs) of each source gets weight, target. One row for each source, so one task orders them.

    A source is full when its weighted share reaches most times its size. Sorted by that ratio, full sources come first;
    the level of the rest is what is left divided by the weight that is left.
    """
    n = len(weights)
    by_name = Window.orderBy("nul", "src")
    w = sizes.withColumn("pos", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % n + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("most", "weight", "level", "pos")["level"])).over(every)
    first = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), F.col("pos"), F.col("level")))).over(every)
    w = w.withColumn("fill", F.coalesce(first["level"], level, F.lit(math.inf)))
    return w.select("src", "nul", "source_size", "n_docs", "pos", "weight", F.least("most", F.col("fill") * F.col("weight")).alias("target"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x < 2, F.lit(0.0)).otherwise(series)


def _hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among draws without replacement, by inverting the distribution at u (12 standard deviations wide)."""
    total = (good + bad).cast("double")
    mean = draws * good / F.greatest(total, F.lit(1.0))
    sd = F.sqrt(F.greatest(mean * (bad / F.greatest(total, F.lit(1.0))) * ((total - draws) / F.greatest(total - 1, F.lit(1.0))), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - 12 * sd - 2))
    high = F.least(good, draws, F.ceil(mean + 12 * sd + 2))
    weigh = lambda k: F.exp(
        _log_factorial(good) - _log_factorial(k) - _log_factorial(good - k) + _log_factorial(bad) - _log_factorial(draws - k) - _log_factorial(bad - draws + k) - _log_factorial(good + bad) + _log_factorial(draws) + _log_factorial(good + bad - draws)
    )
    support = F.transform(F.array(F.struct(low.alias("low"), F.greatest(low, high).alias("high"))), lambda z: F.struct(z["low"], F.transform(F.sequence(z["low"], z["high"]), weigh).alias("p")))
    summed = F.transform(support, lambda z: F.struct(z["low"], z["p"], (u * F.aggregate(z["p"], F.lit(0.0), lambda a, p: a + p)).alias("at")))

    def walk(z):  # counts the values whose cumulated weight stays below the mark
        step = lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["k"] + F.when(a["sum"] + p <= z["at"], 1).otherwise(0)).cast("long").alias("k"))
        return z["low"] + F.aggregate(z["p"], F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k")), step)["k"]

    return F.least(high, F.transform(summed, walk)[0])


def split_tree(quotas: DataFrame, depth: int, path: str, seed: int = SEED) -> DataFrame:
    """From one row (node, q array of block counts by source) to 2**depth rows whose arrays add up to it.

    Each level is written below path: it is read twice by the next, and would be drawn anew for either reading.
    """
    out = quotas
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.floor(total / 2).cast("long").alias("draws"), total.alias("left"), F.array().cast("array<bigint>").alias("out"))

        def draw(a, k):
            u = _uniform(seed, level, F.col("node"), F.size(a["out"]))  # noqa: B023
            got = _hypergeometric(k, a["left"] - k, a["draws"], u)
            return F.transform(F.array(got), lambda x: F.struct((a["draws"] - x).alias("draws"), (a["left"] - k).alias("left"), F.concat(a["out"], F.array(x)).alias("out")))[0]

        halves = staged(out.repartition("node").select("node", "q", F.aggregate("q", start, draw)["out"].alias("l")), f"{path}/{level}")
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))
        out = halves.select(F.inline(pair))
    return out


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = SEED, n_shards: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(sizes, cells, number of cells a source).

    sizes: one row per row of docs: doc_id, size, src, nul, cell. cells: src, nul, cell, source_size, target, shards
    (the output shard of each copy of the cell, one entry for each time it is taken).
    """
    spark = docs.sparkSession
    base = new_dir(spark, "mix")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col).cast("string")).alias("size"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.isnull(source_col).cast("int").alias("nul"))
    named = staged(named, f"{base}/sizes")
    totals = staged(named.groupBy("src", "nul").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), f"{base}/sources")
    if n_shards is None:
        words = SHARE * (totals.agg(F.sum("source_size")).first()[0] or 0)
        n_shards = max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))
    depth = max(0, math.ceil(math.log2(n_shards)))
    each = max(1, (CELLS << depth) // BLOCKS)  # cells of a block
    n_cells = BLOCKS * each
    sizes = named.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(n_cells)).cast("int"))

    # Quotas: whole passes, then the remainder by first fit over the permuted blocks; the smallest block left goes in if that ends nearer.
    targets = source_targets(totals)
    blocks = sizes.groupBy("src", "nul", F.floor(F.col("cell") / each).cast("int").alias("block")).agg(F.sum("size").alias("words"))
    of_source = blocks.groupBy("src", "nul").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "src", "nul", "block").alias("perm"), "block", "words"))).alias("all"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int")
    planned = of_source.join(targets, ["src", "nul"]).withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    empty = F.array().cast("array<int>")
    fit = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("sum"), empty.alias("got"), F.lit(None).cast("struct<words:bigint,block:int>").alias("least")),
        lambda a, b: F.when((F.col("whole") < MOST) & (a["sum"] + b["words"] <= F.col("rest")), F.struct((a["sum"] + b["words"]).alias("sum"), F.concat(a["got"], F.array(b["block"])).alias("got"), a["least"].alias("least"))).otherwise(
            F.struct(a["sum"].alias("sum"), a["got"].alias("got"), F.least(a["least"], F.struct(b["words"].alias("words"), b["block"].alias("block"))).alias("least"))
        ),
    )
    planned = staged(planned.withColumn("fit", fit), f"{base}/quotas")
    nearer = (F.col("whole") < MOST) & F.col("fit.least").isNotNull() & (F.col("fit.sum") + F.col("fit.least.words") - F.col("rest") < F.col("rest") - F.col("fit.sum"))
    planned = planned.withColumn("part", F.when(nearer, F.concat("fit.got", F.array("fit.least.block"))).otherwise(F.col("fit.got")))
    epochs = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(empty), F.array(F.lit(-1)))
    taken_blocks = planned.select("src", "nul", "pos", "part", F.explode("all").alias("b"), epochs.alias("epochs")).select("src", "nul", "pos", "part", F.col("b.block").alias("block"), F.explode("epochs").alias("epoch"))
    taken_blocks = taken_blocks.where((F.col("epoch") >= 0) | F.array_contains("part", F.col("block"))).drop("part")
    own_cells = F.explode(F.sequence(F.col("block") * each, F.col("block") * each + (each - 1))).alias("cell")
    taken = staged(taken_blocks.select("src", "nul", "pos", "epoch", own_cells), f"{base}/taken")

    # The tree: exact quotas for each leaf; a leaf takes the next ranks of a source's permuted cells.
    counts = taken.groupBy("pos").agg(F.count("*").alias("k"))
    root = counts.agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("s")).select(F.lit(0).cast("long").alias("node"), F.transform("s", lambda x: x["k"]).alias("q"), F.transform("s", lambda x: x["pos"]).alias("at"))
    root = staged(root, f"{base}/root")
    leaves = split_tree(root.select("node", "q"), depth, f"{base}/levels", seed)
    names = root.select(F.posexplode("at").alias("i", "pos"))
    by_leaf = leaves.select("node", F.posexplode("q").alias("i", "k")).where("k > 0").join(names, "i").select("node", "pos", "k")
    upto = F.sum("k").over(Window.partitionBy("pos").orderBy("node"))
    slots = by_leaf.withColumn("upto", upto).select("pos", F.col("node").cast("int").alias("shard"), F.explode(F.sequence(F.col("upto") - F.col("k") + 1, F.col("upto"))).alias("rank"))
    ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(F.xxhash64(F.lit(seed + 2), "cell", "epoch"), "cell", "epoch")).cast("long"))
    placed = ranked.join(slots, ["pos", "rank"])
    shards = placed.groupBy("src", "nul", "cell").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    every = planned.select("src", "nul", "source_size", "target", F.explode("all").alias("b")).select("src", "nul", "source_size", "target", F.col("b.block").alias("block"))
    every = every.select("src", "nul", "source_size", "target", own_cells)
    plan = every.join(shards, ["src", "nul", "cell"], "left").withColumn("shards", F.coalesce("shards", empty))
    return sizes, staged(plan, f"{base}/plan"), n_cells


def mixing_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, shards.

    Null sources are a source of their own, the last; null texts have size 0. Documents without words take no part in
    totals, but follow their cell. All-empty tables have targets of 0. Rows that repeat an id fall into one cell.
    """
    sizes, plan, _ = mixing_plan(docs, **kw)
    out = sizes.join(plan, ["src", "nul", "cell"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = SEED, n_shards: int | None = None) -> DataFrame:
    """The mix: rows of docs with all their columns, each as often as it is taken, dealt to shards and in random order there."""
    _, plan, n_cells = mixing_plan(docs, id_col, text_col, source_col, seed=seed, n_shards=n_shards)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("src", "nul", "cell", "shards")]).where(F.size("__shards") > 0)
    keyed = docs.withColumns({"__s": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__n": F.isnull(source_col).cast("int"), "__b": F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("long")), F.lit(n_cells)).cast("int")})
    rows = keyed.join(plan, (F.col("__s") == F.col("__src")) & (F.col("__n") == F.col("__nul")) & (F.col("__b") == F.col("__cell")))
    rows = rows.select(*[docs[c] for c in docs.columns], F.posexplode("__shards").alias("__copy", "__shard"))
    order = F.xxhash64(F.lit(seed + 3), F.col(id_col).cast("long"), "__copy")
    return rows.repartition("__shard").sortWithinPartitions("__shard", order).select(*docs.columns)
