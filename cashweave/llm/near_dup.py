"""Near duplicates by SetSketch registers, banding, likelihood estimates and exact verification.

A text's set holds its distinct word shingles. Each register is a truncated logarithm, on an
exponential scale, of the smallest of the set's hash values for that register (the registers of a
union are the larger ones, so sketches merge). Texts with equal sets form a class first. Classes that
share a band of registers are compared by the joint likelihood of their registers; those whose estimate
allows the threshold fall into one cluster, and inside a cluster pairs are verified on full sets, the
likeliest first, until no unverified pair could join two components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm import wordvec
from cashweave.llm.common import pick, stored
from cashweave.llm.grouping import Forest, blocks, components, runs

WIDTH = 5
#: Similarity at which texts are linked, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Registers in bands of four: a pair at 0.8 shares none of 32 bands with probability 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Base of the registers' scale: fine enough that registers agree by chance in 1 of 2,000 cases.
BASE = 1.001
#: Added to all registers: log_b of the largest x a 64-bit hash gives (45) is 3,809, so small sets do not clip at 0.
OFFSET = 3_840
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0
#: Classes compared at once: sketches of a bucket, sets of a cluster.
BUCKET_ROWS, CLUSTER_ROWS = 2048, 512

_rng = np.random.default_rng(8)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes.

    Register i is OFFSET + floor(1 - log_b(x)) of the smallest x = -log(u) over the set, u uniform for each
    element, cut to 16 bits.
    """
    smallest = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        h = hashes[at:at + 1024, None] * _MULTIPLY + _ADD
        h ^= h >> np.uint64(32)
        np.minimum(smallest, (h * np.uint64(0xD6E8FEB86659FD93)).min(0), out=smallest)
    x = -np.log1p(-(smallest.astype(np.float64) + 0.5) * 2.0 ** -64)
    return np.clip(np.floor(OFFSET + 1 - np.log(x) / math.log(BASE)), 0, 65_535).astype("<u2")


def similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (rows) given the set sizes."""
    more = (left > right).sum(1)
    less = (left < right).sum(1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood has one maximum
        one, two = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = likelihood(one) < likelihood(two)
        low, high = np.where(up, one, low), np.where(up, high, two)
    return (low + high) / 2


class Threshold:
    """The similarity asked for, and the least estimate that may still belong to it."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        j = numerator / denominator
        self.estimate = max(0.0, j - SLACK * math.sqrt(j * (1 - j) / REGISTERS))

    def sizes(self, a, b):
        """Whether sets of these sizes can be similar enough at all."""
        return self.denominator * np.minimum(a, b) >= self.numerator * np.maximum(a, b)

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.denominator * both >= self.numerator * (len(a) + len(b) - both)


def candidates(regs: np.ndarray, sizes: np.ndarray, side: np.ndarray, limit: Threshold):
    """Pairs (i, j, estimate) of one group that may be similar; across the two sides if there are two."""
    ones = np.arange(len(regs)) if side.min() == side.max() else np.flatnonzero(side == side.min())
    others = ones if side.min() == side.max() else np.flatnonzero(side != side.min())
    out_i, out_j, out_e = [], [], []
    need = limit.estimate * REGISTERS - 4 * math.sqrt(REGISTERS) / 2  # far fewer equal registers rule a pair out
    for k, i in enumerate(ones):
        j = others[k + 1:] if others is ones else others
        j = j[limit.sizes(sizes[i], sizes[j])]
        if not len(j):
            continue
        j = j[(regs[j] == regs[i]).sum(1) >= need * 0.8]
        if not len(j):
            continue
        e = similarity(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), float(sizes[i])),
                       sizes[j].astype(float))
        good = e >= limit.estimate
        out_i.append(np.full(good.sum(), i))
        out_j.append(j[good])
        out_e.append(e[good])
    if not out_i:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_e)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketch(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n, c1, c2, regs): set size, two 64-bit sums that name the set, and its registers."""
    rows = pick(docs, key, text)
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("n", "c1", "c2")),
                           T.StructField("regs", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at, n in wordvec.pieces(batch.column(1)):
                part = batch.slice(at, n)
                sets = wordvec.shingles(part.column(1), width)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), *names(sets),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=schema.names)

    return rows.mapInArrow(run, schema)


def names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums over a set's hashes, which together name it."""
    one = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
    two = [int(wordvec.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
    return [pa.array(one, pa.int64()), pa.array(two, pa.int64())]


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def clusters(classes: DataFrame, limit: Threshold) -> DataFrame:
    """(node, component) of the classes that estimates do not keep apart.

    Buckets of a band go by their rows' count and the sum of their hashes: equal buckets of several
    bands are compared once. Buckets above BUCKET_ROWS are compared chunk by chunk. A bucket gives
    one star for each of its clusters, not its pairs.
    """
    banded = classes.select("rep", "regs", "c1")
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("c1", T.LongType()),
                           T.StructField("band", T.IntegerType()),
                           T.StructField("value", T.LongType())])

    def bands(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = _matrix(part.column(1)).view("<i8")
                n = len(values)
                each = pa.array(np.repeat(np.arange(n), BANDS))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), part.column(2).take(each),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(values.ravel())], names=schema.names)

    rows = banded.mapInArrow(bands, schema)
    mark = F.sum(F.xxhash64("rep", "c1").cast("decimal(38,0)"))
    buckets = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("rows"), mark.alias("mark"), F.min("rep").alias(
        "least")).filter("rows > 1")
    buckets = stored(buckets.groupBy("rows", "mark", "least").agg(F.min(F.struct("band", "value")).alias("x")).select(
        "x.band", "x.value", "rows"), "buckets")
    members = rows.join(buckets, ["band", "value"]).join(classes.select("rep", "c1", "n", "regs"), ["rep", "c1"])
    members = blocks(members, "rows", "c1", BUCKET_ROWS).select(
        "band", "value", "left", "right", "side", "rep", "n", "regs")
    members = members.repartition("band", "value", "left", "right").sortWithinPartitions(
        "band", "value", "left", "right")

    def compare(batches):
        for table, offsets in runs(batches, 4):
            side, rep, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
            regs, found = _matrix(table.column("regs")), []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                forest = Forest(rep[a:b])
                i, j, _ = candidates(regs[a:b], n[a:b], side[a:b], limit)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    forest.join(x, y)
                found += [(int(rep[a + x]), int(rep[a + r])) for x, r in forest.stars()]
            yield _edges(found)

    return components(members.mapInArrow(compare, _EDGE), "a", "b")


def named(texts: DataFrame, width: int) -> DataFrame:
    """(_id, text) with the size and the two sums of each text's set: _n, _1, _2."""
    schema = T.StructType([*texts.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_n", "_1", "_2"))])

    def run(batches):
        for batch in batches:
            for at, n in wordvec.pieces(batch.column(1)):
                part = batch.slice(at, n)
                sets = wordvec.shingles(part.column(1), width)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(s) for s in sets], pa.int64()), *names(sets)],
                                                 names=schema.names)

    return texts.mapInArrow(run, schema)


def verified(docs: DataFrame, classes: DataFrame, clustered: DataFrame, key: str, text: str, width: int,
             limit: Threshold, repeated: bool) -> DataFrame:
    """Edges (a, b) that span the components of linked classes, each confirmed on full sets.

    Only texts of clusters travel, once to their cluster and once for each chunk pair of a cluster above CLUSTER_ROWS.
    A group verifies likelier pairs first and none whose ends are joined already; of the others none is skipped.
    """
    nodes = clustered.join(classes, clustered["node"] == classes["rep"]).select(
        F.col("rep"), "component", "n", "c1", "c2", "regs")
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    nodes = nodes.join(sizes, "component")
    texts = pick(docs, key, text).select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text"))
    if repeated:  # one text for each class, named by its set: an id may stand on many rows and for many classes
        held = texts.join(clustered.select("node"), F.col("_id") == F.col("node"), "left_semi")
        held = named(held, width).groupBy("_id", "_n", "_1", "_2").agg(F.first("text").alias("text"))
        on = [F.col("_id") == F.col("rep"), F.col("_n") == F.col("n"), F.col("_1") == F.col("c1"), F.col("_2") == F.col("c2")]
    else:
        held, on = texts, F.col("_id") == F.col("rep")
    members = blocks(held.join(nodes, on), "rows", "c1", CLUSTER_ROWS).select(
        "component", "left", "right", "side", "rep", "n", "c1", "c2", "regs", "text")
    members = members.repartition("component", "left", "right").sortWithinPartitions("component", "left", "right", "rep")

    def verify(batches):
        for table, offsets in runs(batches, 3):
            side, rep, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
            c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
            regs, found = _matrix(table.column("regs")), []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                a, b = int(a), int(b)
                held = table.column("text").slice(a, b - a).combine_chunks()
                held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
                sets = [s for at, m in wordvec.pieces(held) for s in wordvec.shingles(held.slice(at, m), width)]
                one, two = (x.to_numpy() for x in names(sets))
                own = np.flatnonzero((one == c1[a:b]) & (two == c2[a:b]))  # not another text with that key
                forest = Forest(rep[a:b])
                i, j, e = candidates(regs[a:b][own], n[a:b][own], side[a:b][own], limit) if len(own) > 1 else ((),) * 3
                for k in np.argsort(-np.asarray(e), kind="stable"):
                    x, y = int(own[i[k]]), int(own[j[k]])
                    if forest.root(x) != forest.root(y) and limit.holds(sets[x], sets[y]):
                        forest.join(x, y)
                found += [(int(rep[a + x]), int(rep[a + r])) for x, r in forest.stars() if rep[a + x] != rep[a + r]]
            yield _edges(found)

    return members.mapInArrow(verify, _EDGE)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                    numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    Texts are linked when their sets' Jaccard similarity is numerator/denominator or more; a component has the
    smallest key reachable as its id and keeps that one. ASCII case is ignored. NULL, empty and blank texts have
    empty sets and link with nothing. Rows that repeat a key are one document: what either row links with
    belongs to its component. A NULL key links with nothing, has no component and is kept. An empty
    table gives an empty result; other columns are ignored. Keys are integers.
    """
    limit = Threshold(numerator, denominator)
    sketched = stored(sketch(docs, key, text, width).withColumn(key, F.col(key).cast("long")), "sketches")
    classes = stored(sketched.filter((F.col("n") > 0) & F.col(key).isNotNull()).groupBy("c1", "c2", "n").agg(
        F.min(key).alias("rep"), F.first("regs").alias("regs")), "classes")
    ids = sketched.filter((F.col("n") > 0) & F.col(key).isNotNull()).groupBy(key).count()
    repeated = not ids.filter("count > 1").isEmpty()
    linked = components(verified(docs, classes, clusters(classes, limit), key, text, width, limit, repeated), "a", "b")
    sets = classes.select("c1", "c2", "n", "rep").join(linked, F.col("rep") == F.col("node"), "left").select(
        F.col("c1").alias("_1"), F.col("c2").alias("_2"), F.col("n").alias("_n"),
        F.coalesce("component", "rep").alias("_c"))
    found = sketched.drop("regs").join(sets, (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")) & (
        F.col("n") == F.col("_n")) & F.col(key).isNotNull(), "left")
    component = F.coalesce("_c", key)
    return found.select(key, F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, but only one row of each group of near duplicates.

    Rows that repeat a key are documents of their own here: different texts of one key all stay unless they are
    near duplicates, and the row of the smallest key of a group stays. Of rows with one key and no words
    one stays; rows without a key all stay.
    """
    columns = docs.columns
    keys = pick(docs, key).filter(F.col(key).isNotNull())
    at, words = f"_{columns.index(key)}", f"_{columns.index(text)}"
    rows = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    if keys.count() == keys.distinct().count():
        gone = near_duplicates(docs, key, text, **options).filter("NOT kept").select(F.col(key).alias("_gone")).distinct()
        return rows.join(gone, F.col(at).cast("long") == F.col("_gone"), "left_anti").toDF(*columns)
    # Row numbers in the keys' order; rows of one key are spread over the ranges at random, then stored.
    own = stored(rows.filter(F.col(at).isNotNull()).withColumn("_spread", F.rand(3)).repartitionByRange(at, "_spread")
                 .sortWithinPartitions(at).drop("_spread").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = stored(near_duplicates(own, "_row", words, **options), "numbered-near")
    blank = own.select("_row", at).join(found.filter("n_shingles = 0").select("_row"), "_row")
    stay = found.filter("kept AND n_shingles > 0").select("_row").unionByName(
        blank.groupBy(at).agg(F.min("_row").alias("_row")).select("_row"))
    kept = own.join(stay, "_row", "left_semi").drop("_row")
    return kept.unionByName(rows.filter(F.col(at).isNull())).toDF(*columns)
