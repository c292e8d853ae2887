"""Near-duplicate vectors through a forest of random-projection trees.

Trees are fitted on a bounded sample: each inner node splits where a random projection is thinnest near
its median, and vectors near the split go to both sides. The overlap follows from the distance of vectors that
link, so a node no wider than that is not split but kept as a leaf. Every vector is then routed to its leaves. Vectors of a leaf
are compared exactly; leaves above a size are compared chunk by chunk. A pair counts in the first leaf of
the forest that its vectors share, so numbers of links add up without any list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, stored
from cashweave.llm.grouping import Forest, blocks, components, runs

COSINE = 0.9
TREES = 6
#: Vectors the trees are fitted on at most, and bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: A leaf holds about so many vectors, and so many sample rows at least.
LEAF_ROWS, LEAF_SAMPLE = 512, 24
#: Half-width of the overlap at a split, in standard deviations of the projected difference of two vectors
#: that just link.
SPILL = 0.4
#: A split lies between these quantiles; a node it leaves with more than SHRINK on one side stays a leaf.
QUANTILES, SHRINK = (0.35, 0.65), 0.75
#: Vectors of a leaf compared at once.
CHUNK_ROWS = 1024


def unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """(index, dimension, unit vector as float64) of the usable vectors of a list array.

    A vector is usable if it is not NULL, has components, all of them finite numbers, and is not zero.
    """
    index, dims, out = [], [], []
    for i, v in enumerate(vectors.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                top = np.abs(x).max()
                if top > 0:
                    x = x / top
                    index.append(i)
                    dims.append(len(x))
                    out.append(x / np.sqrt(x @ x))
    return np.array(index, np.int64), np.array(dims, np.int64), out


def normalised(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(key, dim, unit): usable vectors with their unit vector as 8-byte floats; others have NULL there."""
    rows = pick(vectors, key, embedding).withColumn(key, F.col(key).cast("long"))
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("unit", T.BinaryType())])

    def run(batches):
        for batch in batches:
            index, dims, units = unit(batch.column(1))
            dim, data = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            dim[index] = dims
            for i, x in zip(index.tolist(), units, strict=True):
                data[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim), pa.array(data, pa.binary())],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


class Tree:
    """Inner nodes (projection, split, overlap, children); a negative child -k-1 is leaf k of the forest."""

    def __init__(self, sample: np.ndarray, leaf: int, rng, first_leaf: int, spill: float):
        self.nodes: list[tuple] = []
        self.leaves, self.spill = first_leaf, spill
        self.start = self._grow(sample, leaf, rng, 0)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, rows: np.ndarray, leaf: int, rng, depth: int) -> int:
        if len(rows) <= leaf or depth > 40:
            return self._leaf()
        for _ in range(3):
            direction = rng.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            at, spill = rows @ direction, self.spill
            ordered = np.sort(at)
            splits = np.quantile(ordered, np.linspace(*QUANTILES, 13))
            both = np.searchsorted(ordered, splits + spill) - np.searchsorted(ordered, splits - spill)
            split = float(splits[both.argmin()])
            left, right = at <= split + spill, at > split - spill
            if max(left.sum(), right.sum()) <= SHRINK * len(rows):
                break
        else:  # too dense to part: compared as one leaf
            return self._leaf()
        me = len(self.nodes)
        self.nodes.append(())
        a = self._grow(rows[left], leaf, rng, depth + 1)
        b = self._grow(rows[right], leaf, rng, depth + 1)
        self.nodes[me] = (direction, split, spill, a, b)
        return me

    def route(self, rows: np.ndarray):
        """Yield (leaf, indices of the rows in it)."""
        todo = [(self.start, np.arange(len(rows)))]
        while todo:
            node, index = todo.pop()
            if not len(index):
                continue
            if node < 0:
                yield -node - 1, index
                continue
            direction, split, spill, a, b = self.nodes[node]
            at = rows[index] @ direction
            todo.append((a, index[at <= split + spill]))
            todo.append((b, index[at > split - spill]))


def fit(sample: np.ndarray, total: int, cosine: float, trees: int = TREES, seed: int = 11) -> list[Tree]:
    rng, out, leaves = np.random.default_rng(seed), [], 0
    spill = SPILL * (2 * (1 - cosine) / sample.shape[1]) ** 0.5
    leaf = max(LEAF_SAMPLE, int(LEAF_ROWS * len(sample) / max(1, total)))
    for _ in range(trees):
        out.append(Tree(sample, leaf, rng, leaves, spill))
        leaves = out[-1].leaves
    return out


def _floats(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def similar_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors``: key, n_links, component_id, kept.

    Two vectors link when a leaf of the forest holds both and their cosine, in double precision, is
    ``cosine`` or more; n_links counts the others a vector links with, copies each for itself. Vectors that are
    NULL, empty or zero, or hold NULL or non-finite components, link with nothing; vectors of
    other dimensions never meet. Equal vectors are one class, compared once. Rows that repeat a key count as vectors of
    their own with one component. A NULL key has no component and is kept. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = stored(normalised(vectors, key, embedding), "units")
    usable = rows.filter(F.col("unit").isNotNull() & F.col(key).isNotNull())
    classes = stored(usable.groupBy("dim", F.sha2("unit", 256).alias("sha")).agg(
        F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "vector-classes")
    found = None
    # One forest for each dimension: an embedding table has one, as many as it mixes models.
    for dim, total in classes.groupBy("dim").count().orderBy("dim").collect():
        got = _links(classes.filter(F.col("dim") == dim), dim, total, cosine)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("copies").alias("links")).limit(0)
    found = stored(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("a <> b"), "a", "b")
    known = (classes.select("sha", "rep", "copies").join(counts, F.col("rep") == F.col("_a"), "left")
             .join(joined, F.col("rep") == F.col("node"), "left")
             .select(F.col("sha").alias("_sha"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "rep").alias("c")))
    out = rows.withColumn("sha", F.when(F.col("unit").isNotNull() & F.col(key).isNotNull(), F.sha2("unit", 256)))
    out = out.join(known, F.col("sha") == F.col("_sha"), "left")
    component = F.coalesce("c", key)
    return out.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, total: int, cosine: float) -> DataFrame:
    """(a, b, links): for each class that links, its links and the smallest class it reaches within a group."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    share = F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / total))
    sample = classes.filter(share).select("rep", "unit").orderBy("rep").limit(most).toPandas()
    trees = fit(np.frombuffer(b"".join(sample["unit"]), np.float64).reshape(-1, dim), total, cosine)
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("copies", T.LongType()),
                           T.StructField("leaves", T.ArrayType(T.IntegerType())), T.StructField("unit", T.BinaryType())])

    def route(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows = _floats(part.column(2), dim)
                at, leaf = [], []
                for tree in trees:
                    for k, index in tree.route(rows):
                        at.append(index)
                        leaf.append(np.full(len(index), k, np.int32))
                at, leaf = np.concatenate(at), np.concatenate(leaf)
                order = np.lexsort((leaf, at))
                bounds = np.searchsorted(at[order], np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(leaf[order])),
                    part.column(2)], names=schema.names)

    routed = stored(classes.select("rep", "copies", "unit").mapInArrow(route, schema), "routed")
    # One row for each leaf: their number is bounded by the sample the forest was fitted on.
    sizes = F.broadcast(routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
        F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    members = routed.withColumn("leaf", F.explode("leaves")).join(sizes, "leaf")
    members = blocks(members, "rows", "rep", CHUNK_ROWS).select(
        "leaf", "left", "right", "side", "rep", "copies", "leaves", "unit")
    members = members.repartition("leaf", "left", "right").sortWithinPartitions("leaf", "left", "right", "rep")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "links")])

    def compare(batches):
        for table, offsets in runs(batches, 3):
            leaf = table.column("leaf").to_numpy()
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found.append(compared(table.slice(a, b - a), int(leaf[a]), dim, cosine))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(3)],
                                             names=out.names)

    return members.mapInArrow(compare, out)


def compared(group: pa.Table, leaf: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links inside a group: (class, smallest class of its component here, its links), for those with any."""
    side, rep, copies = (group.column(c).to_numpy() for c in ("side", "rep", "copies"))
    units = _floats(group.column("unit"), dim)
    ones = np.flatnonzero(side == side.min())
    others = ones if side.min() == side.max() else np.flatnonzero(side == side.max())
    lists = group.column("leaves").to_pylist()
    width = max(map(len, lists))
    held = np.full((len(lists), width), -1, np.int32)
    for i, x in enumerate(lists):
        held[i, :len(x)] = x
    links, forest, hit = np.zeros(len(rep), np.int64), Forest(rep), np.zeros(len(rep), bool)
    for at in range(0, len(ones), 256):
        rows = ones[at:at + 256]
        near = units[rows] @ units[others].T >= cosine
        if others is ones:
            near &= np.arange(len(others))[None, :] > np.arange(at, at + len(rows))[:, None]
        x, y = np.nonzero(near)
        for k in range(0, len(x), 20_000):
            i, j = rows[x[k:k + 20_000]], others[y[k:k + 20_000]]
            # The first leaf both are in, as leaves are numbered tree by tree.
            earlier = np.zeros(len(i), bool)
            for c in range(width):
                own = held[i, c]
                earlier |= (own >= 0) & (own < leaf) & (held[j] == own[:, None]).any(1)
            i, j = i[~earlier], j[~earlier]
            links += np.bincount(i, copies[j], len(links)).astype(np.int64)
            links += np.bincount(j, copies[i], len(links)).astype(np.int64)
            hit[i] = hit[j] = True
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(p, q)
    at = np.flatnonzero(hit)
    return rep[at], rep[[forest.root(int(k)) for k in at]] if len(at) else rep[at], links[at]
