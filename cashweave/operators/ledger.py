"""Ledger append: project, collapse exact repeats, link versions, identity and hash chain.

Set-based re-expression of the reference's row-at-a-time insert loop (S5, W1, W2, J9, F4, F6).

Skew: one transaction id may hold a large share of all events. The per-id window is
therefore *salted by arrival range*: rows are grouped by ``(transaction_id, seq_bucket)``
(``seq_bucket = arrival_seq div bucket_width``, so no group exceeds ``bucket_width`` rows),
compared with their in-group predecessor, and the first row of each group is fixed up from
a one-row-per-group summary that carries the previous group's last state forward.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave import schemas
from cashweave.functions import hashing, privacy, scalars
from cashweave.operators import roots
from cashweave.operators.windows import seq_range
from cashweave.tables import read_table

DEFAULT_BUCKET_WIDTH = 1 << 22
# Rows per hash-chain segment: segments fold in parallel, one Python task each.
DEFAULT_SEGMENT_WIDTH = 1 << 16
# Stands for "no link" where links pass through pandas, whose integers know no NULL.
_NO_LINK = -(1 << 63)

_JSON_FIELDS = {
    "category": "category_json",
    "personal_finance_category": "personal_finance_category_json",
    "counterparties": "counterparties_json",
    "location": "location_json",
    "payment_meta": "payment_meta_json",
}
_TEXT_FIELDS = (
    "pending_transaction_id", "account_id", "name", "merchant_name", "original_description",
    "iso_currency_code", "unofficial_currency_code", "payment_channel", "transaction_type", "transaction_code",
    "category_id", "personal_finance_category_icon_url", "website", "logo_url", "merchant_entity_id",
    "check_number", "account_owner",
)


def _field(payload: Column, ptype: T.StructType, name: str, dtype: T.DataType) -> Column:
    """A payload field, or a typed NULL when the payload schema lacks it."""
    if name in ptype.fieldNames():
        return payload.getField(name)
    return F.lit(None).cast(dtype)


def _stamp(now: str | None) -> Column:
    return F.lit(now) if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _moment(now: str | None) -> str:
    """One time for all rows of an append, which the chain hashes."""
    return now if now is not None else _dt.datetime.now(_dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def prepare_events(changes: DataFrame, now: str | None, env: str | None = None) -> DataFrame:
    """P2 + F21 + F1/F2 + P1: change rows -> typed ledger rows without link, identity or chain.

    ``changes`` carries ``arrival_seq, item_id, event_type, payload`` (a struct) and optionally
    ``batch_id, cursor_fingerprint, received_at, env`` and ``payload_json``: the payload's whole JSON text. With
    the text, ``raw_json``, the hash and the nested columns come from it, so fields the struct does not
    list are kept and a change in one is a new version; without it they come from the struct. ``now`` (ISO text) stamps ``inserted_at``;
    ``None`` uses ``current_timestamp()``, which a streaming query fixes per micro-batch from its
    offset log, so a replayed batch gets the same stamp.
    """
    keyed, raw = keyed_events(changes)
    return typed_events(keyed, raw, now, env)


def moved_events(changes: DataFrame) -> DataFrame:
    """Change rows with a transaction id as they are shuffled: the stripped payload (and the canonical text of open JSON,
    which a Python function makes: behind a shuffle it would cost one more) without what is spelt from it later."""
    ptype = changes.schema["payload"].dataType
    given = {"arrival_seq": F.col("arrival_seq").cast("long"), "event_type": F.col("event_type"),
             "item_id": F.col("item_id").cast("string"), "payload": privacy.strip_secrets(F.col("payload"), ptype)}
    given |= {n: F.col(n) for n in ("batch_id", "cursor_fingerprint", "received_at", "env") if n in changes.columns}
    if "payload_json" in changes.columns:
        given["_open"] = privacy.canonical_open_json(F.col("payload_json"))
    df = changes.select(*[c.alias(n) for n, c in given.items()])
    df = df.withColumn("transaction_id", F.col("payload").getField("transaction_id").cast("string"))
    return df.filter(F.coalesce(F.col("transaction_id"), F.lit("")) != "")


def opened_events(moved: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of :func:`moved_events` with class and payload hash, and the expression of the payload's canonical text."""
    df = moved
    ptype, p, klass = df.schema["payload"].dataType, F.col("payload"), scalars.event_class(F.col("event_type"))
    removal_fields = [f for f in schemas.REMOVAL_PAYLOAD.fieldNames() if f in ptype.fieldNames()]
    removal_type = T.StructType([ptype[f] for f in removal_fields])
    removal_struct = F.struct(*[p.getField(f).alias(f) for f in removal_fields])
    raw = F.when(klass == "removed", hashing.canonical_json(removal_struct, removal_type)) \
        .otherwise(hashing.canonical_json(p, ptype))
    if "_open" in df.columns:
        raw = F.coalesce(F.col("_open"), raw)
    return df.select("*", klass.alias("event_class"), hashing.payload_hash(raw).alias("payload_hash")), raw


def keyed_events(changes: DataFrame) -> tuple[DataFrame, Column]:
    """What :func:`collapse_repeats` compares, beside the stripped payload, and the expression of its canonical text.

    The rows that are shuffled and sorted carry the payload once; :func:`typed_events` spells its text and its
    columns (several times its size) for the rows that are kept, where they then are.
    """
    return opened_events(moved_events(changes))


def event_keys(keyed: DataFrame) -> DataFrame:
    """What collapse, identity and chain need of events, narrow: payload hashes as bytes."""
    return keyed.select("arrival_seq", "transaction_id", "item_id", "event_class", F.unhex("payload_hash").alias("payload_hash"))


def decided(keys: DataFrame, tail: DataFrame | None, bucket_width: int, now: str) -> DataFrame:
    """The kept ones of :func:`event_keys` with link, identity and hash (bytes) and time of insertion."""
    kept = collapse_repeats(keys, tail, bucket_width, keep_bucket=True)
    identity = hashing.event_identity(F.col("item_id"), F.col("transaction_id"), F.col("event_class"),
                                      F.lower(F.hex("payload_hash")), F.col("supersedes_seq"))
    return kept.select("arrival_seq", "transaction_id", "_b", "supersedes_seq", F.unhex(identity).alias("event_identity"),
                       "payload_hash", F.lit(now).alias("inserted_at"))


def typed_events(keyed: DataFrame, raw: Column, now: str | None, env: str | None = None) -> DataFrame:
    """The ledger's columns of rows from :func:`keyed_events`, with what :func:`collapse_repeats` has added to them."""
    ptype, p, is_open = keyed.schema["payload"].dataType, F.col("payload"), "_open" in keyed.columns

    def opt(name: str, default: Column) -> Column:
        return F.col(name) if name in keyed.columns else default

    def text(name: str) -> Column:
        return _field(p, ptype, name, T.StringType()).cast("string")

    def as_json(name: str) -> Column:
        if name not in ptype.fieldNames():
            return F.lit(None).cast("string")
        c = p.getField(name)
        typed = F.when(c.isNotNull(), hashing.canonical_json(c, ptype[name].dataType))
        if not is_open:
            return typed
        return F.when(F.col("_open").isNotNull(), F.get_json_object("_open", f"$.{name}")).otherwise(typed)

    pending = _field(p, ptype, "pending", T.BooleanType())
    cols = {
        "arrival_seq": F.col("arrival_seq"),
        "event_type": F.col("event_type"),
        "event_class": F.col("event_class"),
        "transaction_id": F.col("transaction_id"),
        "item_id": F.col("item_id"),
        "batch_id": opt("batch_id", F.lit(None).cast("string")),
        "cursor_fingerprint": opt("cursor_fingerprint", F.lit(None).cast("string")),
        "txn_date": scalars.safe_date(_field(p, ptype, "date", T.StringType())),
        "authorized_date": scalars.safe_date(_field(p, ptype, "authorized_date", T.StringType())),
        "txn_datetime": scalars.datetime_text(_field(p, ptype, "datetime", T.StringType())),
        "authorized_datetime": scalars.datetime_text(_field(p, ptype, "authorized_datetime", T.StringType())),
        "amount": scalars.as_float(_field(p, ptype, "amount", T.DoubleType())),
        "pending": F.when(pending.isNull(), F.lit(None).cast("int"))
        .otherwise(F.when(pending.cast("boolean"), 1).otherwise(0)),
        "raw_json": raw,
        "received_at": opt("received_at", F.lit(None).cast("string")),
        "inserted_at": _stamp(now),
        "env": opt("env", F.lit(env).cast("string")),
        "app_version": F.lit(schemas.APP_VERSION),
        "schema_version": F.lit(schemas.SCHEMA_VERSION),
    }
    for name in _TEXT_FIELDS:
        cols[name] = text(name)
    for src, dst in _JSON_FIELDS.items():
        cols[dst] = as_json(src)
    passed = ("payload_hash", "supersedes_seq", "_b", "event_identity", "prev_ledger_hash", "ledger_hash")
    cols |= {n: F.col(n) for n in passed if n in keyed.columns}
    return keyed.select(*[c.alias(n) for n, c in cols.items()])


def collapse_repeats(events: DataFrame, tail: DataFrame | None = None,
                     bucket_width: int = DEFAULT_BUCKET_WIDTH, keep_bucket: bool = False) -> DataFrame:
    """W1 + W2: keep an event unless it repeats the previous event of its id (same class and hash).

    Adds ``supersedes_seq`` (the previous *kept* event of the id, any class). ``tail`` holds the
    newest already-stored event of ids in ``events`` (columns ``transaction_id, arrival_seq,
    event_class, payload_hash``); tail rows take part in the comparison and are not returned.
    """
    key = "transaction_id"
    seq = F.col("arrival_seq")
    ch = F.struct(F.col("event_class"), F.col("payload_hash"))
    w = Window.partitionBy(key, "_b").orderBy("arrival_seq")

    rows = events.withColumn("_tail", F.lit(False))
    if tail is not None:
        t = tail.select(key, "arrival_seq", "event_class", "payload_hash").withColumn("_tail", F.lit(True))
        rows = rows.unionByName(t, allowMissingColumns=True)
    rows = rows.withColumn("_b", seq_range("arrival_seq", bucket_width)).withColumn("_prev", F.lag(ch).over(w))
    rows = rows.withColumn("_first", F.col("_prev").isNull()) \
        .withColumn("_local_dup", F.col("_prev").isNotNull() & (F.col("_prev") == ch))
    # One row per (id, bucket): what the next bucket of the same id needs to know. Taken from
    # the same window operator (whole-group frame) on each group's first row: no extra aggregate.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_last_ch", F.last(ch).over(whole)).withColumn(
        "_last_local_kept", F.max(F.when(~F.col("_first") & ~F.col("_local_dup"), seq)).over(whole))
    summary = rows.filter(F.col("_first")).select(
        key, "_b", ch.alias("_first_ch"), "_last_ch", seq.alias("_first_seq"), "_last_local_kept")
    ws = Window.partitionBy(key).orderBy("_b")
    summary = summary.withColumn("_prev_last_ch", F.lag("_last_ch").over(ws))
    summary = summary.withColumn(
        "_first_kept", F.col("_prev_last_ch").isNull() | (F.col("_prev_last_ch") != F.col("_first_ch")))
    summary = summary.withColumn(
        "_group_last_kept",
        F.coalesce(F.col("_last_local_kept"), F.when(F.col("_first_kept"), F.col("_first_seq"))))
    summary = summary.withColumn(
        "_carry_kept",
        F.last("_group_last_kept", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1)))
    summary = summary.select(key, "_b", "_first_kept", "_carry_kept")

    joined = rows.join(summary, [key, "_b"], "inner")
    kept = joined.filter(F.when(F.col("_first"), F.col("_first_kept")).otherwise(~F.col("_local_dup")))
    kept = kept.withColumn("supersedes_seq", F.coalesce(F.lag(seq).over(w), F.col("_carry_kept")))
    out = kept.filter(~F.col("_tail"))
    out = out.drop("_tail", "_prev", "_first", "_local_dup", "_first_kept", "_carry_kept", "_last_ch",
                   "_last_local_kept")
    # ``_b`` names the partitioning the rows already have; keeping it lets a later join on
    # (transaction_id, _b, ...) move only the other side.
    return out if keep_bucket else out.drop("_b")


def with_identity(kept: DataFrame) -> DataFrame:
    """F4 on kept rows."""
    return kept.withColumn("event_identity", hashing.event_identity(
        F.col("item_id"), F.col("transaction_id"), F.col("event_class"), F.col("payload_hash"),
        F.col("supersedes_seq")))


_CHAIN_SCHEMA = ("arrival_seq long, transaction_id string, _b long, supersedes_seq long, prev_ledger_hash binary, "
                 "ledger_hash binary")


def _fold_chain(pdf):
    """Sequential hash fold of one bounded chain segment (rows sorted by arrival). Identities and chain links travel as bytes."""
    import hashlib

    import pandas as pd

    pdf = pdf.sort_values("arrival_seq")
    prev = None
    keep, prevs, hashes = [], [], []
    for identity, digest, inserted_at, seed in zip(pdf["event_identity"], pdf["payload_hash"], pdf["inserted_at"],
                                                   pdf["_seed"]):
        if seed:
            prev = identity  # seed rows carry the stored hash in the identity slot
            keep.append(False)
            continue
        text = digest if isinstance(digest, str) else digest.hex()
        parts = "|".join(["" if prev is None else prev.hex(), identity.hex(), text, "" if inserted_at is None else inserted_at])
        h = hashlib.sha256(parts.encode("utf-8")).digest()
        keep.append(True)
        prevs.append(prev)
        hashes.append(h)
        prev = h
    out = pdf.loc[keep, ["arrival_seq", "transaction_id", "_b", "supersedes_seq"]].reset_index(drop=True)
    out["prev_ledger_hash"] = pd.Series(prevs, dtype=object)
    out["ledger_hash"] = pd.Series(hashes, dtype=object)
    return out


def chain_links(rows: DataFrame, seeds: DataFrame | None = None, segment_width: int = DEFAULT_SEGMENT_WIDTH) -> DataFrame:
    """Tamper-evidence chain in bounded segments of arrival order, as narrow rows (hashes as bytes).

    A hash chain is sequential by definition, so it is built per segment
    (``arrival_seq div segment_width``, at most ``segment_width`` rows each) in parallel; the
    first link of a segment starts from the segment's stored last hash (``seeds``:
    ``segment, ledger_hash``) or from nothing. Only narrow columns travel to Python. Identities and payload hashes of
    ``rows`` are hex text or bytes; ``_b`` and ``supersedes_seq`` are handed on, where ``rows`` have them.
    """
    def given(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("long")

    def is_text(name: str) -> bool:
        return isinstance(rows.schema[name].dataType, T.StringType)

    identity = F.unhex("event_identity") if is_text("event_identity") else F.col("event_identity")
    narrow = rows.select(
        "arrival_seq", "transaction_id", given("_b").alias("_b"), F.coalesce(given("supersedes_seq"), F.lit(_NO_LINK)).alias("supersedes_seq"),
        seq_range("arrival_seq", segment_width).alias("_segment"), identity.alias("event_identity"), "payload_hash", "inserted_at",
        F.lit(False).alias("_seed"))
    if seeds is not None:
        s = seeds.select(F.lit(-1).cast("long").alias("arrival_seq"), F.lit(None).cast("string").alias("transaction_id"),
                         F.lit(None).cast("long").alias("_b"), F.lit(_NO_LINK).alias("supersedes_seq"), F.col("segment").alias("_segment"),
                         F.unhex("ledger_hash").alias("event_identity"),
                         F.lit("").cast(rows.schema["payload_hash"].dataType).alias("payload_hash"),
                         F.lit(None).cast("string").alias("inserted_at"), F.lit(True).alias("_seed"))
        narrow = narrow.unionByName(s)
    chained = narrow.groupBy("_segment").applyInPandas(_fold_chain, _CHAIN_SCHEMA)
    return chained.withColumn("supersedes_seq", F.nullif("supersedes_seq", F.lit(_NO_LINK)))


def _spelt_links(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("prev_ledger_hash", "ledger_hash")})


def with_chain(rows: DataFrame, seeds: DataFrame | None = None, segment_width: int = DEFAULT_SEGMENT_WIDTH) -> DataFrame:
    """``rows`` with their :func:`chain_links`."""
    chained = chain_links(rows.drop("supersedes_seq"), seeds, segment_width).drop("supersedes_seq")
    if "_b" in rows.columns:
        # Join on the keys the wide rows are already partitioned by (plus arrival_seq): only the
        # narrow chain side is shuffled; the wide ledger rows stay where the collapse put them.
        return _spelt_links(rows.join(chained, ["transaction_id", "_b", "arrival_seq"], "inner"))
    # Without a bucket column (rows from the state-store ingest, already partitioned by id) the
    # id still leads the join keys, so that partitioning is reused as well.
    return _spelt_links(rows.join(chained.drop("_b"), ["transaction_id", "arrival_seq"], "inner"))


def completed(moved: DataFrame, links: DataFrame, now: str, env: str | None = None,
              bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """The ledger rows of the events in ``links`` (:func:`chain_links` of :func:`decided` rows, or these themselves).

    All is decided on narrow rows, so payloads move once and unspelt. An event belongs to a link if the link's hash comes
    out of it: events that share a position keep their own, and of equal events there the link takes one.
    """
    on = ["transaction_id", "_b", "arrival_seq"]
    chained = "ledger_hash" in links.columns
    mark = F.col("ledger_hash" if chained else "_identity")
    some = links.select(*on, "supersedes_seq", *(["prev_ledger_hash", "ledger_hash"] if chained else [
        F.col("event_identity").alias("_identity")]))
    # The links' numbers need them by id and range, as files are clustered, and so the events come there too.
    of_id = Window.partitionBy("transaction_id", "_b").orderBy("arrival_seq")
    some = some.withColumn("_n", F.row_number().over(of_id))
    # Merged: payloads are never broadcast, whatever their pages' compressed size promises, and rows come link by link.
    wide = moved.withColumn("_b", seq_range("arrival_seq", bucket_width)).hint("merge")
    both, raw = opened_events(some.join(wide, on, "inner"))
    both = with_identity(both)
    own = F.col("event_identity")
    if chained:
        own = hashing.ledger_hash(F.lower(F.hex("prev_ledger_hash")), own, F.col("payload_hash"), F.lit(now))
    both = both.filter(F.unhex(own) == mark)
    both = both.withColumn("_again", F.coalesce(F.lag("_n").over(of_id) == F.col("_n"), F.lit(False))).filter(~F.col("_again"))
    out = typed_events(both, raw, now, env)
    if chained:
        return _spelt_links(out)
    return _unchained(out)


def _unchained(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("prev_ledger_hash", "ledger_hash")})


def ledger_tail(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Newest stored event of every id present in ``batch``.

    The ledger is folded by id before the join, so that its ids move and not its rows; where the batch's ids fit a
    broadcast, Spark filters by them first.
    """
    ids = batch.select("transaction_id").distinct()
    newest = ledger.groupBy("transaction_id").agg(
        F.max_by(F.struct("arrival_seq", "event_class", "payload_hash"), F.col("arrival_seq")).alias("t"))
    return newest.join(ids, "transaction_id", "left_semi").select("transaction_id", "t.arrival_seq", "t.event_class", "t.payload_hash")


def _byte_tail(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    return ledger_tail(ledger.withColumn("payload_hash", F.unhex("payload_hash")), batch)


def arrival_bounds(df: DataFrame) -> tuple[int | None, int | None]:
    """Smallest and largest ``arrival_seq`` (two scalars; only that column is read)."""
    lo, hi = df.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    return lo, hi


def chain_seeds(ledger: DataFrame, batch: DataFrame, segment_width: int = DEFAULT_SEGMENT_WIDTH,
                bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Stored last hash of every chain segment in the range the batch writes into.

    The batch's arrival range (two numbers) bounds the stored rows read: a literal range filter on
    ``arrival_seq`` that Parquet min/max statistics prune, instead of a scan of the whole ledger.
    Pass ``bounds`` taken from the raw events (a superset range) so the kept rows are not computed
    once more just for two numbers.
    """
    seg = seq_range("arrival_seq", segment_width)
    lo, hi = bounds if bounds is not None else arrival_bounds(batch)
    if lo is None:
        return ledger.sparkSession.createDataFrame([], "segment long, ledger_hash string")
    seg_lo = (lo // segment_width) * segment_width
    seg_hi = (hi // segment_width + 1) * segment_width
    stored = ledger.filter((F.col("arrival_seq") >= seg_lo) & (F.col("arrival_seq") < seg_hi) &
                           F.col("ledger_hash").isNotNull()).select(seg.alias("segment"), "arrival_seq", "ledger_hash")
    return stored.groupBy("segment").agg(F.max_by("ledger_hash", "arrival_seq").alias("ledger_hash"))


def append_events(changes: DataFrame, now: str, ledger: DataFrame | None = None, env: str | None = None,
                  chain: bool = True, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                  segment_width: int = DEFAULT_SEGMENT_WIDTH) -> DataFrame:
    """The ledger rows a batch of change rows appends (to be written with mode ``append``).

    ``ledger`` is the stored ledger (None for the first batch). Counts of inserted and
    duplicate rows are ``count()`` of the result and of ``changes`` minus it.
    """
    if chain:
        now, moved = _moment(now), moved_events(changes)
        keys = event_keys(opened_events(moved)[0])
        rows = decided(keys, _byte_tail(ledger, keys) if ledger is not None else None, bucket_width, now)
        seeds = chain_seeds(ledger, keys, segment_width) if ledger is not None else None
        kept = completed(moved, chain_links(rows, seeds, segment_width), now, env, bucket_width)
    else:
        events, raw = keyed_events(changes)
        tail = ledger_tail(ledger, events) if ledger is not None else None
        kept = _unchained(with_identity(typed_events(collapse_repeats(events, tail, bucket_width), raw, now, env)))
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields])


def absent(rows: DataFrame, stored: DataFrame, identity_col: str = "event_identity") -> DataFrame:
    """``rows`` whose identity ``stored`` does not hold (ON CONFLICT(identity) DO NOTHING)."""
    return rows.join(_identities(stored, rows, identity_col), identity_col, "left_anti")


def _identities(stored: DataFrame, like: DataFrame, identity_col: str = "event_identity") -> DataFrame:
    """The stored identities (hex text) as ``like`` spells its own: as text or as bytes."""
    is_text = isinstance(like.schema[identity_col].dataType, T.StringType)
    return stored.select(identity_col if is_text else F.unhex(identity_col).alias(identity_col))


class RepeatedAppend(ValueError):
    """An append whose positions do not fit what is stored: neither new, nor the one that did not finish."""


def _within(rows: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """Stored rows of an arrival range: two literals that Parquet statistics prune by."""
    return rows.filter(F.col("arrival_seq").between(*bounds))


def finish_and_write(kept: DataFrame, path: str, ledger: DataFrame | None = None, chain: bool = True,
                     segment_width: int = DEFAULT_SEGMENT_WIDTH, partition: tuple[str, int] | None = None,
                     mode: str = "append", bounds: tuple[int | None, int | None] | None = None) -> None:
    """Identity, chain and write for a batch of kept rows (from :func:`collapse_repeats` with
    ``keep_bucket=True``), then tree, entries and root, which commits the append.

    A repeated append adds nothing twice. A partition of its own is replaced. Otherwise rows of the batch's arrival
    range that are stored already are left out by identity; rows behind the last committed position are those of an
    attempt that did not finish, and the append takes them over. ``bounds`` is the arrival range of the raw
    events. The wide rows are not persisted on purpose: a cached relation loses the collapse partitioning, so the
    chain join would shuffle them a second time.
    """
    def complete(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
        return with_chain(rows, seeds, segment_width) if chain else _unchained(rows)

    _finish(with_identity(kept), complete, path, ledger, chain, segment_width, partition, mode, bounds)


def _finish(rows: DataFrame, complete: Callable[[DataFrame, DataFrame | None], DataFrame], path: str, ledger: DataFrame | None,
            chain: bool, segment_width: int, partition: tuple[str, int] | None, mode: str,
            bounds: tuple[int | None, int | None] | None) -> None:
    """:func:`finish_and_write` for ``rows`` with identities, all of whose columns ``complete`` makes of those to be written
    and the chain's seeds. All that is asked of rows before they are written is asked of ``rows``, which may be narrow."""
    spark = rows.sparkSession
    before = roots.newest_root(spark, path, partition[1] if partition else None) if chain else None
    end = before and before["last_seq"]
    pending = None
    here = None if _replaces(partition, mode) else read_table(spark, path, schemas.LEDGER)
    if here is not None:
        bounds = bounds or arrival_bounds(rows)
        if bounds[0] is None:
            return  # an empty batch
        last = -1 if end is None else end
        found = _within(here, bounds)
        if chain:
            pending = _unfinished(here, end, bounds)
            found = found.filter(F.col("arrival_seq") <= last)
            if bounds[0] <= last:
                rows = absent(rows, found)
                lowest = rows.agg(F.min("arrival_seq")).first()[0]
                if lowest is None and pending is None:
                    return  # all of it is stored and committed
                if lowest is not None and lowest <= last:
                    raise RepeatedAppend("an append must follow the stored positions, or have a partition of its own")
            # What the chain continues: committed rows, or those of a ledger that has no roots yet.
            ledger = here.filter(F.col("arrival_seq") <= last if end is not None else ~F.col("arrival_seq").between(*bounds))
        elif not found.isEmpty():
            rows = absent(rows, found)
    missing = True
    if pending is not None:
        missing, others = _apart(rows, pending)
        if others:
            raise RepeatedAppend("rows of another append that did not finish are stored: repeat that one first")
    if missing:  # else the attempt that did not finish had written all rows
        out = complete(rows, chain_seeds(ledger, rows, segment_width, bounds) if chain and ledger is not None else None)
        if pending is not None:
            # Not the join's own partitioning: the repeat of a partly written append may shuffle its rows again.
            out = absent(out, pending)
        # Files clustered by (transaction_id, arrival_seq): point lookups of one id prune row groups
        # by min/max. The rows already arrive in (transaction_id, _b, arrival_seq) order from the
        # collapse, and _b is monotone in arrival_seq, so this adds no sort to the plan.
        order = ["transaction_id", "_b", "arrival_seq"] if "_b" in out.columns else ["transaction_id", "arrival_seq"]
        out = out.sortWithinPartitions(*order)
        out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LEDGER.fields])
        # Half of a row are hashes in hex, which zstd stores in half their length and the default codec does not.
        if partition is not None:
            name, value = partition
            out.withColumn(name, F.lit(value).cast("long")).write.mode(mode).option("compression", "zstd").partitionBy(name).parquet(path)
        else:
            out.write.mode(mode).option("compression", "zstd").parquet(path)
    if not chain:
        return
    written = read_table(spark, path, schemas.LEDGER)
    if written is None:  # an empty first batch
        return
    if partition is not None:
        if partition[0] not in written.columns:  # an empty first batch
            return
        written = written.filter(F.col(partition[0]) == partition[1])
    elif end is not None:
        written = written.filter(F.col("arrival_seq") > end)  # pruned by Parquet statistics
    narrow = written.filter(F.col("ledger_hash").isNotNull()).select(
        "arrival_seq", "event_identity", "payload_hash", "inserted_at", "ledger_hash")
    root_seq = partition[1] if partition else before["root_seq"] + 1 if before else 0
    roots.append_root(spark, path, narrow, root_seq, segment_width, before)


def _apart(rows: DataFrame, pending: DataFrame) -> tuple[bool, bool]:
    """Do ``rows`` hold identities that ``pending`` lacks, and the other way round?"""
    a = rows.select("event_identity", F.lit(1).alias("_a"))
    b = _identities(pending, rows).withColumn("_b", F.lit(1))
    both = a.join(b, "event_identity", "full_outer").agg(F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())).first()
    return both[0] > 0, both[1] > 0


def _replaces(partition: tuple[str, int] | None, mode: str) -> bool:
    """Does the append take the place of an earlier attempt, which then needs no other care?"""
    return partition is not None and mode == "overwrite"


def _unfinished(here: DataFrame, end: int | None, bounds: tuple[int, int]) -> DataFrame | None:
    """Stored rows behind the last committed position ``end``: an attempt that did not finish.

    They must lie in this append's range. In a ledger without any root only rows of this range are taken for such.
    """
    rows = _within(here, bounds) if end is None else here.filter(F.col("arrival_seq") > end)
    low, high = arrival_bounds(rows)
    if low is None:
        return None
    if low < bounds[0] or high > bounds[1]:
        raise RepeatedAppend(f"positions {low} to {high} are of an append that did not finish: repeat that one first")
    return rows


def write_events(changes: DataFrame, now: str, path: str, ledger: DataFrame | None = None, env: str | None = None,
                 chain: bool = True, bucket_width: int = DEFAULT_BUCKET_WIDTH,
                 segment_width: int = DEFAULT_SEGMENT_WIDTH, partition: tuple[str, int] | None = None,
                 mode: str = "append") -> None:
    """S5 as a write job: the rows of :func:`append_events` written to ``path`` (optionally into
    one partition, e.g. the ingest batch, replaced on replay with ``mode="overwrite"``).

    May be repeated after any failure, and after success (see :func:`finish_and_write`). The batch's own rows
    take no part in the comparison with stored events, and a repeat keeps the first attempt's time of insertion,
    so it ends with the rows, links and roots of one undisturbed run.
    """
    # Payloads are hashed once for all decisions and once more for the rows written.
    moved = moved_events(changes)
    held = [event_keys(opened_events(moved)[0]).persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        _write(moved, held, _moment(now), path, ledger, env, chain, bucket_width, segment_width, partition, mode)
    finally:
        for one in held:
            one.unpersist()


def _write(moved: DataFrame, held: list[DataFrame], now: str, path: str, ledger: DataFrame | None,
           env: str | None, chain: bool, bucket_width: int, segment_width: int, partition: tuple[str, int] | None, mode: str) -> None:
    """:func:`write_events` with the batch's persisted keys in ``held``, to which what is persisted here is added."""
    spark, keys = moved.sparkSession, held[0]
    here = None if _replaces(partition, mode) else read_table(spark, path, schemas.LEDGER)
    bounds = arrival_bounds(keys) if here is not None or (chain and ledger is not None) else None
    repeated = False
    if here is not None and bounds[0] is not None:
        own = _within(here, bounds)
        first = own.agg(F.min("inserted_at")).first()[0]
        if first is not None:  # a repeat
            repeated = True
            before = roots.newest_root(spark, path) if chain else None
            end = before and before["last_seq"]
            unfinished = own if end is None else own.filter(F.col("arrival_seq") > end)
            now = unfinished.agg(F.min("inserted_at")).first()[0] or now
            others = own.join(keys.select("arrival_seq"), "arrival_seq", "left_anti")
            ledger = here.filter(~F.col("arrival_seq").between(*bounds)).unionByName(others.select(*here.columns))
    tail = None
    if ledger is not None:
        tail = _byte_tail(ledger, keys).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(tail)
    rows = decided(keys, tail, bucket_width, now)
    if repeated:  # compared with what is stored before any of them is written
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(rows)

    def complete(some: DataFrame, seeds: DataFrame | None) -> DataFrame:
        return completed(moved, chain_links(some, seeds, segment_width) if chain else some, now, env, bucket_width)

    _finish(rows, complete, path, ledger, chain, segment_width, partition, mode, bounds)


def insert_if_absent(rows: DataFrame, stored: DataFrame | None, identity_col: str, order_col: str) -> DataFrame:
    """ON CONFLICT(identity) DO NOTHING, set-based: the first row (by ``order_col``) of each
    identity, minus identities already stored. Partial aggregation absorbs many copies of one row."""
    first = rows.groupBy(identity_col).agg(F.min_by(F.struct(*rows.columns), F.col(order_col)).alias("r")) \
        .select("r.*")
    if stored is None:
        return first
    return first.join(stored.select(identity_col), identity_col, "left_anti")


def append_history(changes: DataFrame, now: str, ledger: DataFrame | None = None, **kw) -> DataFrame:
    """A date-range backfill appended as ``historical_import`` events (same rules as S5)."""
    return append_events(changes.withColumn("event_type", F.lit("historical_import")), now, ledger, **kw)
