"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Each source's target in words is its weighted share, levelled off at a multiple of its size. A
document of a source with target ratio c is due c copies: floor(c) always, and one more
with probability c - floor(c). Pairs of fractional documents exchange probability so that their
joint expected words stay the same, until one of the two is settled at 0 or 1; the choice of
direction is random and leaves every document's expectation unchanged. Groups of bounded size
settle all their documents but one; these residuals meet in the groups of the next level, up to
one group a source, whose last residual goes to the nearer end. What that leaves over is made up, as far as
it goes, by turning settled documents of the last group, the largest that fit first. So a source's words
miss its target by half of one document at most, as a rule by far less.

Equal rows (of one key, source and size) share a due share, not a fate: of n rows with a fraction p, floor(n p) take one
more copy at once and a single row goes into the pairing with what is left of n p.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashweave.llm.common import pick, stored, word_count

WEIGHTS = (1, 2, 3)
#: No source's target and no document's words exceed this many times its size.
CAP = 3
SEED = 20240607
#: Documents a group of the first level is expected to hold at most, and children of a later group.
GROUP_BITS, TREE_BITS = 10, 6
EPS = 1e-9


def source_targets(units: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): the levelled weighted shares of all words.

    Sources in code-point order, NULL last, take the weights in turn. A source whose share exceeds
    ``cap`` times its size gets that much; the level of the others rises until the sum is met. The
    windows run over one row a source, as a mixing plan lists them, never over documents.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    ranked = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_first())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_w = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left_t = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    levelled = (ranked.withColumn("limit", cap * F.col("source_size").cast("double"))
                .withColumn("level", left_t / left_w)
                .withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit")))
    # Sources are capped from the smallest limit for its weight on; the first that is not sets the level.
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "level"))).over(every)
    return levelled.withColumn("share", first["level"]).select(
        "source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(
            F.col("share") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)) / float(1 << 53)


def _settle(items: Column, level: int) -> Column:
    """Fold an array of (h, unit, mass, p) to (rest, done): at most one fractional left, done with x = 0 or 1."""
    def open_(e, p):
        return F.struct(e["h"].alias("h"), e["unit"].alias("unit"), e["mass"].alias("mass"), p.alias("p"))

    def step(acc, j):
        i = acc["rest"]
        up = F.least(i["mass"] * (1 - i["p"]), j["mass"] * j["p"])  # words that may go from j to i
        down = F.least(i["mass"] * i["p"], j["mass"] * (1 - j["p"]))
        rise = _uniform(F.lit(level), i["h"], j["h"]) * (up + down) < down
        i_p = F.when(rise, i["p"] + up / i["mass"]).otherwise(i["p"] - down / i["mass"])
        j_p = F.when(rise, j["p"] - up / j["mass"]).otherwise(j["p"] + down / j["mass"])
        i_set = F.when(rise, i["mass"] * (1 - i["p"]) <= j["mass"] * j["p"]).otherwise(
            i["mass"] * i["p"] <= j["mass"] * (1 - j["p"]))
        rest, settled = F.when(i_set, open_(j, j_p)).otherwise(open_(i, i_p)), F.when(i_set, i["unit"]).otherwise(j["unit"])
        # i is settled at the end it moved to; if j is settled instead, it moved to the other end.
        x = F.when(i_set, rise.cast("int")).otherwise((~rise).cast("int"))
        more = F.concat(acc["done"], F.array(F.struct(settled.alias("unit"), x.alias("x"))))
        whole = (rest["p"] < EPS) | (rest["p"] > 1 - EPS)
        last = F.array(F.struct(rest["unit"].alias("unit"), F.round(rest["p"]).cast("int").alias("x")))
        return F.when(i.isNull(), F.struct(j.alias("rest"), acc["done"].alias("done"))).when(
            whole, F.struct(F.lit(None).alias("rest"), F.concat(more, last).alias("done"))).otherwise(
            F.struct(rest.alias("rest"), more.alias("done")))

    first = F.filter(items, lambda e: F.lit(False))
    none = F.get(first, F.lit(0))
    start = F.struct(none.alias("rest"), F.transform(first, lambda e: F.struct(
        e["unit"].alias("unit"), F.lit(0).alias("x"))).alias("done"))
    return F.aggregate(items, start, step)


def _made_up(done: Column, missing: Column) -> Column:
    """``done`` with some x turned so that ``missing`` words (below zero: words too many) come nearer to none."""
    ordered = F.sort_array(F.transform(done, lambda d: F.struct(
        (-d["unit"]["size"].cast("double")).alias("o"), d["unit"].alias("unit"), d["x"].alias("x"))))

    def step(acc, d):
        gain = F.when(d["x"] == 0, -d["o"]).otherwise(d["o"])  # words that turning it would add
        turn = F.abs(acc["left"] - gain) < F.abs(acc["left"])
        x = F.when(turn, 1 - d["x"]).otherwise(d["x"])
        return F.struct(F.when(turn, acc["left"] - gain).otherwise(acc["left"]).alias("left"),
                        F.concat(acc["done"], F.array(F.struct(d["unit"].alias("unit"), x.alias("x")))).alias("done"))

    return F.aggregate(ordered, F.struct(missing.alias("left"), F.filter(done, lambda d: F.lit(False)).alias("done")), step)["done"]


def _units(docs: DataFrame, key: str, text: str, source: str, weights, cap: int) -> DataFrame:
    """One row for each unit, the n rows of equal key, source and size: each is taken ``sure`` times, ``up`` of them once more."""
    rows = pick(docs, key, source, text).select(
        F.struct(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    units = stored(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    targets = stored(source_targets(units, weights, cap), "mix-targets").withColumnRenamed("source", "_source")
    due = units.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    due = (due.withColumn("_c", ratio).withColumn("sure", F.floor(F.col("_c") + EPS).cast("int"))
           .withColumn("_p", F.col("n") * F.greatest(F.col("_c") - F.col("sure"), F.lit(0.0)))
           .withColumn("up", F.floor(F.col("_p") + EPS).cast("long"))
           .withColumn("p", F.greatest(F.col("_p") - F.col("up"), F.lit(0.0))).drop("_c", "_p")
           .withColumn("h", F.xxhash64(F.lit(SEED), "key", "source", "size")))
    columns = ["key", "source", "size", "n", "source_size", "target", "sure"]
    settled = (F.col("p") < EPS) | (F.col("size") == 0)
    alone = due.filter(settled).select(*columns, (F.col("up") + F.when(
        F.col("p") > _uniform(F.lit(-1), F.col("h")), 1).otherwise(0)).alias("up"))

    open_rows = due.filter(~settled).select("source", "h", F.struct(*columns, "up").alias("unit"), F.col("size").cast("double").alias("mass"), "p")
    bits = max(0, math.ceil(math.log2(max(1, units.count()))) - GROUP_BITS)
    parts, level = [alone], 0
    while True:
        node = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
        grouped = open_rows.groupBy("source", node.alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("h", "unit", "mass", "p"))).alias("items"))
        folded = grouped.select("source", _settle(F.col("items"), level).alias("f")).select("source", "f.rest", "f.done")
        if not bits:
            rest = F.col("rest")
            missing = rest["mass"] * (rest["p"] - F.when(rest["p"] >= 0.5, 1.0).otherwise(0.0))
            folded = folded.withColumn("done", F.when(rest.isNotNull(), _made_up(F.col("done"), missing)).otherwise(F.col("done")))
        folded = stored(folded, "mix-level")
        parts.append(folded.select(F.explode("done").alias("d")).select(
            *[f"d.unit.{c}" for c in columns], (F.col("d.unit.up") + F.col("d.x")).alias("up")))
        open_rows = folded.filter("rest IS NOT NULL").select("source", "rest.h", "rest.unit", "rest.mass", "rest.p")
        if not bits:
            break
        bits, level = (bits - 1) // TREE_BITS * TREE_BITS, level + 1  # the last group has the most children
    parts.append(open_rows.select(*[f"unit.{c}" for c in columns], (F.col("unit.up") + (F.col("p") >= 0.5).cast("int")).alias("up")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("key", F.col(f"key.{key}"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        cap: int = CAP) -> DataFrame:
    """Copies of every document in the mix.

    Rows of equal key, source and size form a unit; its result is one row, or two where some of its rows are
    taken once more than the others: ``key``, source, size (words), n (so many of its rows), source_size, target
    and copies (0 .. cap). So many equal rows come as near to a target as different ones. NULL
    and empty texts have size 0 and are settled by themselves; a source without words has target 0
    and no copies; a NULL source is a source. An empty table gives an empty result; other columns are
    ignored; only the number of words of very long texts moves on. Only key, source and size are shuffled. Draws
    are hashes of the keys, so reruns agree.
    """
    parts = F.array(F.struct(F.col("up").alias("n"), (F.col("sure") + 1).alias("copies")),
                    F.struct((F.col("n") - F.col("up")).alias("n"), F.col("sure").alias("copies")))
    rows = _units(docs, key, text, source, weights, cap).withColumn("part", F.explode(F.filter(parts, lambda x: x["n"] > 0)))
    return rows.select(F.col("key").alias(key), "source", "size", "part.n", "source_size", "target", "part.copies")


def per_document(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of :func:`mix`'s units, with the words the mix takes of it."""
    rows = mixed.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(key, "source", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as :func:`mix` says, with its own columns.

    Where units have several rows, these are numbered to tell which are taken once more: first within
    the unit's rows of one input partition, then by the counts of earlier partitions, so that no unit meets in one task.
    """
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = {c: f"_{names.index(c)}" for c in (key, text, source)}
    units = stored(_units(docs, key, text, source, WEIGHTS, CAP).filter("sure + up > 0").select(
        F.col("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "n", "sure", "up"), "mix-copies")
    rows = rows.withColumn("_size", word_count(F.col(at[text])))
    repeated = not units.filter("n > 1").isEmpty()
    if repeated:
        rows = rows.withColumn("_part", F.spark_partition_id())
    same = F.col(at[key]).eqNullSafe(F.col("k")) & F.col(at[source]).eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z"))
    joined = rows.join(units.filter("n = 1"), same).withColumn("_copies", F.col("sure") + F.col("up"))
    if repeated:
        unit = ["k", "s", "z"]
        several = rows.join(units.filter("n > 1"), same).withColumn("_rank", F.row_number().over(
            Window.partitionBy(*unit, "_part").orderBy(F.xxhash64(at[text]))))
        sizes = several.groupBy(*unit, "_part").agg(F.count(F.lit(1)).alias("_m"))
        before = sizes.select(*[F.col(c).alias(f"_{c}") for c in unit], F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(
            Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        several = several.join(before, F.col("k").eqNullSafe(F.col("_k")) & F.col("s").eqNullSafe(F.col("_s"))
                               & (F.col("z") == F.col("_z")) & (F.col("_part") == F.col("_p")))
        several = several.withColumn("_copies", F.col("sure") + (F.col("_before") + F.col("_rank") <= F.col("up")).cast("int"))
        joined = joined.unionByName(several.select(*joined.columns))
    copied = joined.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return copied.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])
