"""Chain of append roots: what every append wrote, linked to the append before it.

Each append adds the tree of its rows to ``<ledger>_nodes`` (see ``merkle``), one entry per chain segment it wrote
to (first and last position, row count, last hash) to ``<ledger>_entries`` and one row to ``<ledger>_roots``: a
digest over its entries, hashed together with the tree and the previous root, and the mountain range of all
trees so far. The root row is written last: an append without it did not finish. All tables only ever
grow; nothing is derived from rows that an earlier append stored, so rows deleted since then show in any later
check, and so does an entry that is changed or taken away.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cashweave.functions import hashing
from cashweave.operators import merkle
from cashweave.operators.windows import seq_range
from cashweave.tables import read_table

ENTRIES = ("root_seq long, segment long, first_seq long, last_seq long, rows long, last_hash string, "
           "entry_hash string")
_PEAKS = "array<struct<height:int,hash:string>>"
ROOTS = ("root_seq long, entries long, digest string, prev_root string, root string, leaf long, first_seq long, last_seq long, "
         f"rows long, top int, tree string, peaks {_PEAKS}, merged {_PEAKS}, mountain string")
#: Segments whose entries are digested together first, so that no task meets all of them.
GROUP = 4096


def _paths(path: str) -> tuple[str, str]:
    base = path.rstrip("/")
    return f"{base}_entries", f"{base}_roots"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(_paths(path)[0]).drop("append")


def read_roots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROOTS).parquet(_paths(path)[1]).drop("append")


def _entry_hash():
    return hashing.sha256_parts(*[F.col(c) for c in ("segment", "first_seq", "last_seq", "rows", "last_hash")])


def segment_entries(rows: DataFrame, segment_width: int, *keys: str) -> DataFrame:
    """One row for each segment that ``rows`` (arrival_seq, ledger_hash) touch."""
    return rows.groupBy(*keys, seq_range("arrival_seq", segment_width).alias("segment")).agg(
        F.min("arrival_seq").alias("first_seq"), F.max("arrival_seq").alias("last_seq"),
        F.count(F.lit(1)).alias("rows"), F.max_by("ledger_hash", "arrival_seq").alias("last_hash"))


def digests(entries: DataFrame) -> DataFrame:
    """(root_seq, entries, digest, rows, first_seq, last_seq): entry hashes in segment order, digested by groups and then together."""
    def joined(value, order):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))),
                                               lambda x: x[value]), "|"), 256)

    def ends(rows, first, last):
        return F.sum(rows).alias("rows"), F.min(first).alias("first_seq"), F.max(last).alias("last_seq")

    grouped = entries.groupBy("root_seq", seq_range("segment", GROUP).alias("_g")).agg(
        joined("entry_hash", "segment").alias("_d"), F.count(F.lit(1)).alias("_n"), *ends("rows", "first_seq", "last_seq"))
    return grouped.groupBy("root_seq").agg(F.sum("_n").alias("entries"), joined("_d", "_g").alias("digest"),
                                           *ends("rows", "first_seq", "last_seq"))


def write_entries(written: DataFrame, path: str, root_seq: int, segment_width: int) -> DataFrame:
    """Store one append's entries, made from the rows it wrote; returns them as stored."""
    base = f"{_paths(path)[0]}/append={root_seq}"
    entries = segment_entries(written, segment_width).withColumn("root_seq", F.lit(root_seq).cast("long")).withColumn(
        "entry_hash", _entry_hash())
    entries.select(*[c.split()[0] for c in ENTRIES.split(", ")]).write.mode("overwrite").parquet(base)
    return written.sparkSession.read.schema(ENTRIES).parquet(base)


def write_root(spark: SparkSession, path: str, own: Row, top: int, tree: str, root_seq: int, before: Row | None) -> None:
    """Store one append's root row, which commits it. ``own`` is its digest, ``before`` the root row before it."""
    previous = before and before["root"]
    peaks = [(p["height"], p["hash"]) for p in before["peaks"]] if before and before["peaks"] else []
    leaf = before["leaf"] + 1 if before and before["leaf"] is not None else 0
    peaks, merged = merkle.add_peak(peaks, tree)
    root = hashlib.sha256("|".join([previous or "", own["digest"], tree]).encode()).hexdigest()
    spark.createDataFrame([(root_seq, own["entries"], own["digest"], previous, root, leaf, own["first_seq"], own["last_seq"], own["rows"],
                            top, tree, peaks, merged, merkle.mountain_hash(leaf + 1, peaks))], ROOTS).coalesce(1) \
        .write.mode("overwrite").parquet(f"{_paths(path)[1]}/append={root_seq}")


def append_root(spark: SparkSession, path: str, written: DataFrame, root_seq: int, segment_width: int, before: Row | None) -> None:
    """Record one append from the rows it wrote: its entries, its tree, then its root. Replaying it replaces all three."""
    own = digests(write_entries(written, path, root_seq, segment_width)).first()
    if own is not None:  # an append without rows leaves no root
        top, tree = merkle.write_nodes(spark, path, written, root_seq, own["first_seq"], own["last_seq"])
        write_root(spark, path, own, top, tree, root_seq, before)


def newest_root(spark: SparkSession, path: str, before: int | None = None) -> Row | None:
    """The root row of the last append that finished (before number ``before``); None for the first. One row is read back."""
    known = read_table(spark, _paths(path)[1], ROOTS)
    if known is None:
        return None
    rows = known if before is None else known.filter(F.col("root_seq") < before)
    return rows.orderBy(F.col("root_seq").desc()).drop("append", "merged").first()


def verify_roots(ledger: DataFrame, entries: DataFrame, roots: DataFrame, segment_width: int) -> DataFrame:
    """One row: do the stored rows still bear out every entry, and the entries every root?

    ``segments_mismatched`` counts entries whose range holds other rows than were written (any deletion: the
    head or tail of a segment, a page, a whole segment), ``rows_uncovered`` rows no entry knows, ``rows_repeated`` rows
    at a position that an earlier row has, ``entries_overlapping`` entries that begin before the one before them in their segment ends,
    ``roots_broken`` appends whose digest or link fails. Narrow columns only: one join on the segment; distinct
    positions are counted in bitmaps, so rows are not shuffled for them.
    """
    rows = ledger.filter(F.col("ledger_hash").isNotNull()).select("arrival_seq", "ledger_hash")
    placed = merkle.of_append(rows, entries, segment_width)
    now = segment_entries(placed.select("root_seq", "arrival_seq", "ledger_hash"), segment_width, "root_seq")
    now = now.withColumn("_now", _entry_hash()).select(F.col("root_seq").alias("_r"), F.col("segment").alias("_s"), "_now",
                                                      F.col("rows").alias("_rows"))
    both = entries.join(now, (F.col("root_seq") == F.col("_r")) & (F.col("segment") == F.col("_s")), "full_outer")
    bad = F.col("entry_hash").isNotNull() & ~F.col("entry_hash").eqNullSafe(F.col("_now"))
    segments = both.agg(F.count("entry_hash").alias("segments"), F.count_if(bad).alias("segments_mismatched"),
                        F.min(F.when(bad, F.col("segment"))).alias("first_bad_segment"),
                        F.coalesce(F.sum(F.when(F.col("entry_hash").isNull(), F.col("_rows"))), F.lit(0)).alias("rows_uncovered"))
    in_bits = rows.groupBy(F.bitmap_bucket_number("arrival_seq").alias("_bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("arrival_seq"))).alias("_distinct"), F.count(F.lit(1)).alias("_rows"))
    repeated = in_bits.agg(F.coalesce(F.sum(F.col("_rows") - F.col("_distinct")), F.lit(0)).alias("rows_repeated"))
    before = F.max("last_seq").over(Window.partitionBy("segment").orderBy("first_seq", "last_seq").rowsBetween(Window.unboundedPreceding, -1))
    overlapping = entries.select((F.col("first_seq") <= before).alias("_o")).agg(F.count_if("_o").alias("entries_overlapping"))
    # Every root must link to the one before it by number, and digest the entries stored for it.
    # One row an append: the window never sees ledger rows.
    linked = roots.withColumn("_before", F.lag("root").over(Window.orderBy("root_seq")))
    found = digests(entries.withColumn("entry_hash", _entry_hash())).select(
        F.col("root_seq").alias("_q"), F.col("digest").alias("_digest"))
    checked = linked.join(found, F.col("root_seq") == F.col("_q"), "full_outer")
    broken = ~(F.col("digest").eqNullSafe(F.col("_digest")) & F.col("prev_root").eqNullSafe(F.col("_before"))
               & F.col("root").eqNullSafe(hashing.sha256_parts(F.col("prev_root"), F.col("digest"), F.col("tree"))))
    chain = checked.agg(F.count(F.lit(1)).alias("roots"), F.count_if(broken).alias("roots_broken"))
    both = segments
    for one in (repeated, overlapping, chain):
        both = both.unionByName(one, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    faults = ("segments_mismatched", "rows_uncovered", "rows_repeated", "entries_overlapping", "roots_broken")
    return both.withColumn("ok", reduce(lambda a, b: a & b, [F.col(c) == 0 for c in faults]))
