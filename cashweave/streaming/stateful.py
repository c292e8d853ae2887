"""Stateful streaming ingest: keyed dedup state in the state store (T2s, T3s, T4s, T15).

``readStream`` pages -> flatten (arrival = source ``page_seq``, phase, position) -> project and
hash. The events themselves go straight to ``foreachBatch``; beside them, each id and range of pages
is cut to the three events or fewer that decide where its last run of equal events starts, and
``applyInPandasWithState`` folds those into, per id, only the newest event's ``(seq, class, hash)`` and hands
on what it held before. Ids are handled in groups: a Python call and a state of the store hold a whole group of
ids as columns, so the number of calls follows the groups that a batch touches and not its ids. ``foreachBatch``
collapses the events after that with the salted windows of the batch path (identity, chain, partition
overwrite), so no task and no frame holds all events of an id.

Each micro-batch touches only the state of its own groups (no ledger scan); the state store is
versioned with the checkpoint, so a replayed batch sees exactly the state it saw the first time.
State never expires: an id can be modified years later (by design, as in the reference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from cashweave.operators import ledger as ledger_ops
from cashweave.operators.windows import seq_range
from cashweave.session import tune
from cashweave.sources import pages as page_src
from cashweave.streaming.ingest import _utc_now, inserted_by_item
from cashweave.streaming.runlog import RunLog
from cashweave.tables import read_table

STATE_SCHEMA = "ids array<string>, seqs array<long>, classes array<string>, hashes array<string>"
#: Groups of ids. A group's state is rewritten when one of its ids has an event: choose about the expected number of
#: ids / 128 for a feed. Fixed for the life of a checkpoint.
ID_GROUPS = 256
#: Arrival positions of a range: 256 pages, whose events of one group of ids are one frame.
RANGE_WIDTH = 1 << 30
#: Added to the stored position of an id, which so comes before every event of a batch.
BEFORE = -(1 << 63)
_NARROW = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("arrival_seq", T.LongType()),
                        T.StructField("event_class", T.StringType()), T.StructField("payload_hash", T.StringType())])
_ID, _SEQ, _CLASS, _HASH = _NARROW.names


def _runs(pdf):
    """(events by id and position, first event of each id, events that repeat the one before them)."""
    pdf = pdf.sort_values([_ID, _SEQ], kind="stable").reset_index(drop=True)
    before = pdf.shift()
    first = (pdf[_ID] != before[_ID]).to_numpy()
    same = ~first & ((pdf[_CLASS] == before[_CLASS]) & (pdf[_HASH] == before[_HASH])).to_numpy()
    return pdf, first, same


def _last_starts(first, kept):
    """For each id, the row of its last kept event, -1 if it has none."""
    import numpy as np

    rows = np.where(kept, np.arange(len(kept)), -1)
    return np.maximum.reduceat(rows, np.flatnonzero(first)) if len(rows) else rows


def _ends(pdf):
    """The events of each id in one range that decide its newest kept event, whatever came before the range.

    The first event, the start of the last run of equal events, and the one before it: folded in order they
    leave the state that all events of the range leave.
    """
    import numpy as np

    pdf, first, same = _runs(pdf)
    start, head = _last_starts(first, ~same), np.flatnonzero(first)
    return pdf.iloc[np.unique(np.concatenate([head, start, np.maximum(start - 1, head)]))]


def _fold(pdf, state):
    """W1/W2 for some events of a group of ids: (stored newest events of these ids, new state).

    Each event is compared with the raw event before it (the stored newest event for an id's first): a dropped
    event equals its predecessor, so this is the sequential "newest event" rule, for all ids at once.
    """
    import numpy as np
    import pandas as pd

    # Without a state the empty columns would be of doubles, which round positions beyond 2**53.
    stored = pd.DataFrame(dict(zip(_NARROW.names, state or ([],) * 4, strict=True))).astype({_SEQ: "int64"}).set_index(_ID)
    pdf, first, same = _runs(pdf)
    heads = pdf[first]
    known = stored.reindex(heads[_ID])
    repeats = ((known[_CLASS].to_numpy() == heads[_CLASS].to_numpy()) & (known[_HASH].to_numpy() == heads[_HASH].to_numpy()))
    kept = ~same
    kept[np.flatnonzero(first)] = ~repeats
    last = _last_starts(first, kept)
    newest = pdf.iloc[last[last >= 0]].set_index(_ID)
    before = stored[stored.index.isin(heads[_ID])]
    after = pd.concat([stored[~stored.index.isin(newest.index)], newest[[_SEQ, _CLASS, _HASH]]])
    return before, (after.index.tolist(), [int(x) for x in after[_SEQ]], after[_CLASS].tolist(), after[_HASH].tolist())


def _remember(key, pdfs, state):
    """The newest kept event before the batch of each id that has one, as rows; the state becomes the newest ones after it."""
    import pandas as pd

    before, now = _fold(pd.concat(list(pdfs), ignore_index=True), state.get if state.exists else None)
    state.update(now)
    out = before.reset_index()
    out[_SEQ] = out[_SEQ].astype("int64") + BEFORE
    yield out[_NARROW.names]


class StatefulLedgerSink:
    """``foreachBatch`` after the state step: collapse, identity, chain, write the batch partition."""

    def __init__(self, ledger_path: str, now: str | None = None, chain: bool = True,
                 segment_width: int = ledger_ops.DEFAULT_SEGMENT_WIDTH, runs_path: str | None = None,
                 bucket_width: int = RANGE_WIDTH):
        self.bucket_width = bucket_width
        self.ledger_path = ledger_path
        self.runs_path = runs_path
        self.now = now
        self.chain = chain
        self.segment_width = segment_width

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        tune(spark)
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Every action on a foreachBatch frame re-runs the micro-batch, state-store step included;
        # persist it once (it spills to disk) and release it after the write.
        from pyspark import StorageLevel

        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        events = rows.filter(~F.col("_before")).drop("_before")
        kept = ledger_ops.collapse_repeats(events, rows.filter("_before"), self.bucket_width, keep_bucket=True)
        link = F.col("supersedes_seq")
        kept = kept.withColumn("supersedes_seq", F.when(link < 0, link - F.lit(BEFORE)).otherwise(link))
        log = RunLog(spark, self.runs_path) if self.runs_path else None
        now = self.now or _utc_now()
        try:
            if log:  # only kept rows get here: runs of items whose rows all repeat are not listed
                log.open(kept.select("item_id"), batch_id, now)
            stored = read_table(spark, self.ledger_path) if self.chain else None
            if stored is not None:
                stored = stored.filter(F.col("ingest_batch") < batch_id)
            bounds = ledger_ops.arrival_bounds(events) if stored is not None else None
            ledger_ops.finish_and_write(kept, self.ledger_path, stored, self.chain, self.segment_width,
                                        partition=("ingest_batch", batch_id), mode="overwrite", bounds=bounds)
            if log:
                log.close(inserted_by_item(spark, self.ledger_path, batch_id), batch_id, now)
        except Exception as exc:
            if log:
                log.fail(batch_id, now, exc)
            raise
        finally:
            rows.unpersist()


def events_with_state(pages: DataFrame, now: str | None = None, range_width: int = RANGE_WIDTH,
                      id_groups: int = ID_GROUPS) -> DataFrame:
    """Streaming DataFrame of all events, and of the newest kept event before the batch of each of its ids that
    has one (``_before``, its position moved by BEFORE)."""
    events = ledger_ops.prepare_events(page_src.explode_pages(pages, batch_id=None), now)
    group = F.pmod(F.xxhash64("transaction_id"), F.lit(id_groups))
    narrow = events.select(*_NARROW.names).groupBy(group, seq_range("arrival_seq", range_width))
    ends = narrow.applyInPandas(_ends, _NARROW).withColumn("id_group", group)
    before = ends.groupBy("id_group").applyInPandasWithState(
        _remember, _NARROW, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return events.withColumn("_before", F.lit(False)).unionByName(
        before.withColumn("_before", F.lit(True)), allowMissingColumns=True)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stateful_ingest(spark: SparkSession, pages_path: str, ledger_path: str, checkpoint: str,
                          now: str | None = None,
                          max_files_per_trigger: int | None = None, available_now: bool = True, chain: bool = True,
                          state_provider: str | None = ROCKSDB_PROVIDER, runs_path: str | None = None,
                          id_groups: int = ID_GROUPS):
    """Start the state-store ingest. Per-id state grows with the number of ids and never expires,
    so it lives in RocksDB on executor disk (not the JVM heap) unless another provider is given."""
    tune(spark)
    if state_provider:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_provider)
    pages = page_src.read_change_pages(spark, pages_path, max_files_per_trigger)
    writer = events_with_state(pages, now, id_groups=id_groups).writeStream.outputMode("append") \
        .foreachBatch(StatefulLedgerSink(ledger_path, now, chain, runs_path=runs_path)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
