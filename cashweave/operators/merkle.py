"""Trees of hashes over a ledger: proofs of single events, named damage, comparison of versions.

Every append has a tree over its arrival positions. A node of level k covers 16**k neighbouring positions and hashes its
children, each named by its slot, so a position is part of what is proved; stretches without rows have no nodes.
The hash of a leaf is the content of one row (identity, payload hash, time of insertion, chain link). Nodes of four
levels are built at once from groups of 65,536 children, and so on up to the one node that covers the append.

The trees of all appends are the leaves of a mountain range: perfect binary trees of falling height, merged
like the digits of a counter. A root row keeps its peaks and what it merged, so a proof reads one row a level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.functions import hashing
from cashweave.operators.windows import seq_range

BITS, LEVELS = 4, 4
FAN, GROUP_BITS = 1 << BITS, BITS * LEVELS
CHILDREN = "array<struct<slot:int,hash:string>>"
#: What :func:`difference` may say of a position.
FINDINGS = ("added", "changed", "deleted", "duplicated", "moved")
NODES = f"root_seq long, index long, rows long, hash string, children {CHILDREN}, level int"


def content() -> Column:
    """Hash of one ledger row without its position. Payload columns are covered by the payload hash."""
    return hashing.sha256_parts(*[F.col(c) for c in ("event_identity", "payload_hash", "inserted_at", "ledger_hash")])


def _sha(*parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def node_hash(level: int, index: int, children: list[tuple[int, str]]) -> str:
    return _sha("node", level, index, *[f"{slot}:{h}" for slot, h in children])


def _node_hash(level: Column, index: Column, children: Column) -> Column:
    """:func:`node_hash` as a Column."""
    return F.sha2(F.concat_ws("|", F.lit("node"), level.cast("string"), index.cast("string"), F.array_join(
        F.transform(children, lambda c: F.concat(c["slot"].cast("string"), F.lit(":"), c["hash"])), "|")), 256)


def _grow(level: int):
    """A group of nodes of ``level`` (root_seq, index, rows, hash) to the nodes of the four levels above it."""
    def run(table):
        import pyarrow as pa

        root = table.column(0)[0].as_py()
        now = sorted((i, h.hex(), n) for i, h, n in zip(*[table.column(c).to_pylist() for c in ("index", "hash", "rows")], strict=True))
        out = []
        for up in range(level + 1, level + 1 + LEVELS):
            groups: dict[int, list] = {}
            for index, digest, rows in now:
                groups.setdefault(index >> BITS, []).append((index & (FAN - 1), digest, rows))
            now = []
            for index, members in groups.items():
                children = [(slot, digest) for slot, digest, _ in members]
                now.append((index, node_hash(up, index, children), sum(m[2] for m in members)))
                out.append((root, index, now[-1][2], now[-1][1], [{"slot": s, "hash": h} for s, h in children], up))
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.string())])), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def leaves(ledger: DataFrame, root_seq: Column | None = None) -> DataFrame:
    """Nodes of level 0: (root_seq, index, rows, hash) of every row."""
    root = F.lit(0) if root_seq is None else root_seq
    return ledger.select(root.cast("long").alias("root_seq"), F.col("arrival_seq").alias("index"),
                         F.lit(1).cast("long").alias("rows"), content().alias("hash"))


def grow(nodes: DataFrame, level: int = 0) -> DataFrame:
    """The four levels above nodes of ``level``. A group holds the children of 65,536 indexes, so it is bounded."""
    return nodes.select("root_seq", "index", "rows", F.unhex("hash").alias("hash"), F.shiftright("index", GROUP_BITS).alias("_g")).groupBy(
        "root_seq", "_g").applyInArrow(_grow(level), NODES)


def of_append(rows: DataFrame, entries: DataFrame, segment_width: int) -> DataFrame:
    """``rows`` with ``root_seq``, the append whose entry covers their position (NULL: none). Joined by segment."""
    ranges = entries.select("root_seq", F.col("segment").alias("_s"), F.col("first_seq").alias("_a"), F.col("last_seq").alias("_b"))
    return rows.join(ranges, (seq_range("arrival_seq", segment_width) == F.col("_s"))
                     & F.col("arrival_seq").between(F.col("_a"), F.col("_b")), "left").drop("_s", "_a", "_b")


def _folder(path: str, root_seq: int) -> str:
    return f"{path.rstrip('/')}_nodes/append={root_seq}"


def write_nodes(spark: SparkSession, path: str, written: DataFrame, root_seq: int, first: int, last: int) -> tuple[int, str]:
    """Store the tree of one append, whose ledger rows ``written`` are; returns level and hash of its top.

    Replaying it replaces the tree. A round a factor of 65,536 positions between ``first`` and ``last``.
    """
    top = LEVELS
    while first >> BITS * top != last >> BITS * top:
        top += 1
    now = leaves(written, F.lit(root_seq))
    for level in range(0, top, LEVELS):
        base = f"{_folder(path, root_seq)}/part={level}"
        grow(now, level).filter(F.col("level") <= top).sortWithinPartitions("level", "index").write.mode("overwrite").option(
            "compression", "zstd").parquet(base)
        now = spark.read.schema(NODES).parquet(base).filter(F.col("level") == level + LEVELS)
    peak = spark.read.schema(NODES).parquet(base).filter(F.col("level") == top).select("hash").first()
    return top, peak["hash"]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The stored nodes of all appends; ``append`` equals ``root_seq`` and prunes folders."""
    return spark.read.schema(NODES + ", append long").parquet(f"{path.rstrip('/')}_nodes").drop("part")


# The mountain range.


def add_peak(peaks: list[tuple[int, str]], tree: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(peaks, merged nodes) after one more append; both as (height, hash), merged from the lowest up."""
    peaks, merged, node = list(peaks), [], (0, tree)
    while peaks and peaks[-1][0] == node[0]:
        height, left = peaks.pop()
        node = (height + 1, _sha("mountain", height + 1, left, node[1]))
        merged.append(node)
    return [*peaks, node], merged


def mountain_hash(count: int, peaks: list[tuple[int, str]]) -> str:
    return _sha("range", count, *[h for _, h in peaks])


def peak_places(count: int) -> list[tuple[int, int]]:
    """(height, index) of the peaks over ``count`` leaves; index counts nodes of that height."""
    out, at = [], 0
    for height in reversed(range(count.bit_length())):
        if count >> height & 1:
            out.append((height, at >> height))
            at += 1 << height
    return out


def _siblings(height: int, index: int, count: int) -> list[tuple[int, int]]:
    """Nodes met on the way from (height, index) up to its peak over ``count`` leaves."""
    out = []
    while (height, index) not in peak_places(count):
        out.append((height, index ^ 1))
        height, index = height + 1, index >> 1
    return out


def _mountain_nodes(roots: DataFrame, places: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """Hashes of mountain nodes: each stands in the root row of the last leaf below it, so one row a node is read."""
    at = {((i + 1) << h) - 1: None for h, i in places}
    if not at:
        return {}
    rows = {r["leaf"]: r for r in roots.filter(F.col("leaf").isin(list(at))).select("leaf", "tree", "merged").collect()}

    def one(h, i):
        row = rows.get(((i + 1) << h) - 1)
        return None if row is None else row["tree"] if h == 0 else dict((m["height"], m["hash"]) for m in row["merged"]).get(h)

    return {(h, i): one(h, i) for h, i in places}


def _climb(height: int, index: int, digest: str, path: list[tuple[int, int]], known: dict) -> str:
    for place in path:
        other = known[place]
        left, right = (other, digest) if index & 1 else (digest, other)
        height, index = height + 1, index >> 1
        digest = _sha("mountain", height, left, right)
    return digest


@dataclass
class Proof:
    """What shows that a row of a position belongs to a ledger of ``count`` appends: O(log n) hashes."""

    arrival_seq: int
    steps: list[tuple[int, int, list[tuple[int, str]]]]  # level, index and children, from the bottom up
    leaf: int
    count: int
    siblings: dict[tuple[int, int], str]
    peaks: list[tuple[int, str]]

    def holds(self, row_content: str, mountain: str) -> bool:
        """Does the row with this content hash stand at the position, under this mountain hash?"""
        digest, index = row_content, self.arrival_seq
        for level, at, children in self.steps:
            if at != index >> BITS or [h for s, h in children if s == index & (FAN - 1)] != [digest]:
                return False
            digest, index = node_hash(level, at, children), at
        path = _siblings(0, self.leaf, self.count)
        if any(self.siblings.get(p) is None for p in path):
            return False
        summit = _climb(0, self.leaf, digest, path, self.siblings)
        place = (len(path), self.leaf >> len(path))
        return (place in peak_places(self.count) and [h for h, _ in self.peaks] == [h for h, _ in peak_places(self.count)]
                and self.peaks[peak_places(self.count).index(place)][1] == summit
                and mountain_hash(self.count, self.peaks) == mountain)


def prove(spark: SparkSession, path: str, arrival_seq: int) -> Proof | None:
    """The proof of one position against the newest root; None where no append has it.

    Reads one node a level (pruned by append and index), one root row for each node of the mountain on the way, and
    the newest root row.
    """
    from cashweave.operators.roots import read_roots

    roots = read_roots(spark, path)
    newest = roots.orderBy(F.col("leaf").desc()).select("leaf", "peaks").first()
    own = roots.filter((F.col("first_seq") <= arrival_seq) & (F.col("last_seq") >= arrival_seq)).select(
        "root_seq", "leaf", "top").first()
    if own is None:
        return None
    on_path = [(F.col("level") == k) & (F.col("index") == arrival_seq >> BITS * k) for k in range(1, own["top"] + 1)]
    wanted = on_path[0]
    for one in on_path[1:]:
        wanted = wanted | one
    found = read_nodes(spark, path).filter((F.col("append") == own["root_seq"]) & wanted).select("level", "index", "children").collect()
    if len(found) < own["top"]:
        return None
    count = newest["leaf"] + 1
    return Proof(arrival_seq, sorted((r["level"], r["index"], [(c["slot"], c["hash"]) for c in r["children"]]) for r in found),
                 own["leaf"], count, _mountain_nodes(roots, _siblings(0, own["leaf"], count)),
                 [(p["height"], p["hash"]) for p in newest["peaks"]])


def consistent(roots: DataFrame, before: int, after: int) -> bool:
    """Do the first ``before`` appends of a ledger stand unchanged at the head of its ``after`` appends?

    Climbs from the older mountain's peaks to the newer one's, O(log n) root rows; both mountain hashes must come out.
    """
    ends = {r["leaf"]: r for r in roots.filter(F.col("leaf").isin([before - 1, after - 1])).select("leaf", "peaks", "mountain").collect()}
    if before > after or len(ends) < len({before, after}):
        return False
    old, new = ([(p["height"], p["hash"]) for p in ends[n - 1]["peaks"]] for n in (before, after))
    paths = {place: _siblings(*place, after) for place in peak_places(before)}
    known = _mountain_nodes(roots, [p for path in paths.values() for p in path])
    known |= {place: h for place, (_, h) in zip(peak_places(before), old, strict=True)}  # the older peaks speak for themselves
    if None in known.values():
        return False
    new_at = dict(zip(peak_places(after), (h for _, h in new), strict=True))
    reached = all(_climb(*place, known[place], path, known) == new_at.get((place[0] + len(path), place[1] >> len(path)))
                  for place, path in paths.items())
    return (reached and mountain_hash(before, old) == ends[before - 1]["mountain"]
            and mountain_hash(after, new) == ends[after - 1]["mountain"])


def event_proofs(ledger: DataFrame, events: DataFrame, nodes: DataFrame, entries: DataFrame, roots: DataFrame,
                 segment_width: int) -> DataFrame:
    """(arrival_seq, root_seq, steps, hashes, ok): the path of each of many ``events`` (arrival_seq) checked up to its append's tree.

    The distributed form of :func:`prove`: an event meets its nodes by (append, level, index) and its steps are
    put together again by event; ``hashes`` counts what was read.
    """
    rows = ledger.select("arrival_seq", content().alias("content")).join(events.select("arrival_seq").distinct(), "arrival_seq")
    placed = of_append(rows, entries, segment_width).join(roots.select("root_seq", "top", "tree"), "root_seq", "left")
    levels = placed.withColumn("level", F.explode_outer(F.when(F.col("top").isNotNull(), F.sequence(F.lit(1), F.col("top")))))
    levels = levels.withColumn("index", F.expr(f"shiftright(arrival_seq, {BITS} * level)")).withColumn(
        "slot", F.expr(f"shiftright(arrival_seq, {BITS} * (level - 1)) & {FAN - 1}").cast("int"))
    known = nodes.select("root_seq", "level", "index", "hash", "children")
    met = levels.join(known, ["root_seq", "level", "index"], "left")
    of_slot = F.filter("children", lambda c: c["slot"] == F.col("slot"))
    step = F.struct("level", "hash", F.size("children").alias("n"), _node_hash(F.col("level"), F.col("index"), F.col("children")).alias("computed"),
                    F.when(F.size(of_slot) == 1, of_slot[0]["hash"]).alias("child"))
    by_event = met.groupBy("arrival_seq", "root_seq", "content", "top", "tree").agg(F.sort_array(F.collect_list(step)).alias("s"))
    below = F.concat(F.array("content"), F.transform("s", lambda x: x["computed"]))
    good = F.forall(F.zip_with("s", below, lambda x, b: x.isNull() | (x["child"] == b)), lambda ok: F.coalesce(ok, F.lit(False)))
    reached = F.coalesce(F.element_at(F.transform("s", lambda x: x["computed"]), -1) == F.col("tree"), F.lit(False))
    return by_event.select("arrival_seq", "root_seq", F.size("s").alias("steps"), F.aggregate(
        "s", F.lit(0), lambda n, x: n + F.coalesce(x["n"], F.lit(0))).alias("hashes"), (good & reached).alias("ok"))


# Comparison.


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(arrival_seq, finding, other_seq): what ``after`` does to the rows of ``before``, by position.

    Both are node tables with levels 1 and 4. Segments (level 4) are compared by hash, nodes of level 1
    only below segments that differ, rows only below nodes that differ. ``changed``, ``deleted``, ``added``,
    ``duplicated`` (stands there more than once), ``moved`` (to ``other_seq``: the same content, deleted here, added there).
    """
    def level(nodes, k):
        return nodes.filter(F.col("level") == k).select("root_seq", "index", "hash", "children")

    def differing(a, b):
        b = b.toDF(*[f"b_{c}" for c in b.columns])
        return a.join(b, F.col("root_seq").eqNullSafe(F.col("b_root_seq")) & (F.col("index") == F.col("b_index")), "full_outer").filter(
            ~F.col("hash").eqNullSafe(F.col("b_hash")))

    segments = differing(level(before, LEVELS), level(after, LEVELS)).select(
        F.coalesce("index", "b_index").alias("_segment")).distinct()
    low, high = segments.agg(F.min("_segment"), F.max("_segment")).first()
    if low is None:
        low, high = 0, -1
    shift = BITS * (LEVELS - 1)

    def suspects(nodes):  # a literal range, which Parquet statistics prune, then the segments themselves
        near = level(nodes, 1).filter((F.col("index") >= low << shift) & (F.col("index") < (high + 1) << shift))
        return near.join(segments, F.shiftright("index", shift) == F.col("_segment"), "left_semi")

    found = differing(suspects(before), suspects(after))

    def rows(index, children, side):
        one = found.select(F.col(index).alias("_i"), F.explode(children).alias("_c"))
        return one.groupBy((F.shiftleft("_i", BITS) + F.col("_c.slot")).alias("seq")).agg(
            F.min("_c.hash").alias(f"{side}_hash"), F.count(F.lit(1)).alias(f"{side}_n"), F.max("_c.hash").alias(f"{side}_max"))

    both = rows("index", "children", "a").join(rows("b_index", "b_children", "b"), "seq", "full_outer")
    a, b = F.col("a_hash"), F.col("b_hash")
    finding = F.when(b.isNull(), "deleted").when(a.isNull(), F.when(F.col("b_n") > 1, "duplicated").otherwise("added")).when(
        F.col("b_n") > F.col("a_n"), "duplicated").when((a != b) | (F.col("a_max") != F.col("b_max")), "changed")
    named = both.select("seq", "a_hash", "b_hash", finding.alias("finding")).filter("finding IS NOT NULL")
    gone = named.filter("finding = 'deleted'").select(F.col("a_hash").alias("h"), F.col("seq").alias("at"))
    new = named.filter("finding = 'added'").select(F.col("b_hash").alias("h"), F.col("seq").alias("to"))
    moved = gone.join(new, "h").groupBy("at").agg(F.min("to").alias("to"))
    named = named.join(moved, F.col("seq") == F.col("at"), "left").join(
        moved.select(F.col("to").alias("_to")).distinct(), F.col("seq") == F.col("_to"), "left_anti")
    return named.select(F.col("seq").alias("arrival_seq"), F.when(F.col("to").isNotNull(), "moved").otherwise(
        F.col("finding")).alias("finding"), F.col("to").alias("other_seq"))


def tree_of(ledger: DataFrame, entries: DataFrame | None = None, segment_width: int = 1 << GROUP_BITS) -> DataFrame:
    """Levels 1 to 4 computed from the rows that are there now, by append (from its ``entries``) or as one tree."""
    narrow = ledger.select("arrival_seq", "event_identity", "payload_hash", "inserted_at", "ledger_hash")
    if entries is None:
        return grow(leaves(narrow))
    return grow(leaves(of_append(narrow, entries, segment_width), F.col("root_seq")))


def damage(ledger: DataFrame, nodes: DataFrame, entries: DataFrame, segment_width: int) -> DataFrame:
    """:func:`difference` between what the appends recorded and the rows that are there now."""
    return difference(nodes, tree_of(ledger, entries, segment_width))


def broken_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored nodes whose hash is not that of their children, or not the one their parent (or root row) holds."""
    inner = nodes.select("root_seq", "level", "index", "hash", _node_hash(F.col("level"), F.col("index"), F.col("children")).alias("_own"))
    held = nodes.select("root_seq", (F.col("level") - 1).alias("level"), F.explode("children").alias("c"), "index").filter("level > 0").select(
        "root_seq", "level", (F.shiftleft("index", BITS) + F.col("c.slot")).alias("index"), F.col("c.hash").alias("_held"))
    tops = roots.select("root_seq", F.col("top").alias("level"), F.expr(f"shiftright(first_seq, {BITS} * top)").alias("index"), F.col("tree").alias("_held"))
    both = inner.join(held.unionByName(tops), ["root_seq", "level", "index"], "full_outer")
    return both.filter(~(F.col("hash").eqNullSafe(F.col("_own")) & F.col("hash").eqNullSafe(F.col("_held")))).select(
        "root_seq", "level", "index")
