"""Detail listings, search and version history.

Listings with a row limit take the top rows first (``TakeOrderedAndProject``) and only then
look up account labels, broadcasting the bounded side; unbounded listings let Spark choose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave import schemas
from cashweave.functions import scalars
from cashweave.operators.reports import months_back_filter
from cashweave.operators.windows import DEFAULT_WIDTH, salted_row_number

MAX_LIMIT = 2000

# Columns of the detail view in its order, and the names its JSON columns expand to.
DETAIL_COLUMNS = (
    "transaction_id", "date", "authorized_date", "datetime", "authorized_datetime", "name", "merchant_name",
    "original_description", "amount", "iso_currency_code", "unofficial_currency_code", "pending", "removed",
    "superseded", "pending_transaction_id", "payment_channel", "transaction_type", "transaction_code",
    "category_json", "category_id", "personal_finance_category_json", "personal_finance_category_icon_url",
    "counterparties_json", "location_json", "payment_meta_json", "website", "logo_url", "merchant_entity_id",
    "check_number", "account_owner", "account_id", "first_seen_at", "state_event_id",
)

JSON_SCHEMAS = {
    "category_json": ("category", T.ArrayType(T.StringType())),
    "personal_finance_category_json": ("personal_finance_category", schemas.PERSONAL_FINANCE_CATEGORY),
    "counterparties_json": ("counterparties", T.ArrayType(schemas.COUNTERPARTY)),
    "location_json": ("location", schemas.LOCATION),
    "payment_meta_json": ("payment_meta", schemas.PAYMENT_META),
}
ACCOUNT_FIELDS = ("name", "official_name", "mask", "type", "subtype", "institution_name")


def newest_first(df: DataFrame, seq_col: str = "state_event_id") -> list:
    """O1: date descending with NULL dates last, then event descending."""
    return [F.col("date").desc_nulls_last(), F.col(seq_col).desc()]


def expand_json(df: DataFrame) -> DataFrame:
    """JSON text columns to nested values; empty or NULL text gives NULL; adds ``direction``."""
    out = df
    for col, (name, dtype) in JSON_SCHEMAS.items():
        if col in out.columns:
            out = out.withColumn(name, F.from_json(F.nullif(F.col(col), F.lit("")), dtype)).drop(col)
    return out.withColumn("direction", scalars.direction(F.col("amount")))


def _validate_limit(limit: int | None) -> None:
    if limit is not None and not (1 <= limit <= MAX_LIMIT):
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


def list_transaction_details(current: DataFrame, accounts_latest: DataFrame | None = None,
                             months_back: int | None = None, today=None, limit: int | None = None,
                             account_id: str | None = None, search: str | None = None,
                             include_removed: bool = False) -> DataFrame:
    """Detail rows of the current state, newest first, each id once at its latest version; all of them unless
    ``limit`` (1 to 2000) asks for the newest.

    ``include_removed`` also lists removed and superseded rows (P11); ``search`` matches
    ``%text%`` in name, merchant or original description, ASCII case folded, with ``%`` and
    ``_`` live as wildcards (P10).
    """
    _validate_limit(limit)
    rows = current
    if not include_removed:
        rows = rows.filter((F.col("removed") == 0) & (F.col("superseded") == 0))
    rows = months_back_filter(rows, months_back, today)
    if account_id:
        rows = rows.filter(F.col("account_id") == account_id)
    if search:
        rows = rows.filter(scalars.search_predicate(search, F.col("name"), F.col("merchant_name"),
                                                    F.col("original_description")))
    rows = rows.select(*[c for c in DETAIL_COLUMNS if c in rows.columns])
    order = newest_first(rows)
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    rows = expand_json(rows)
    if accounts_latest is not None:
        acct = accounts_latest.select("account_id", *[F.col(c).alias(f"_a_{c}") for c in ACCOUNT_FIELDS])
        if limit is not None:
            # The listing side is bounded by `limit` (at most MAX_LIMIT rows): broadcast it.
            rows = acct.join(F.broadcast(rows), "account_id", "right")
        else:
            rows = rows.join(acct, "account_id", "left")
        rows = rows.withColumn("account", F.struct(*[F.col(f"_a_{c}").alias(c) for c in ACCOUNT_FIELDS])) \
            .drop(*[f"_a_{c}" for c in ACCOUNT_FIELDS])
    return with_labels(rows)


def with_labels(df: DataFrame) -> DataFrame:
    """Status, category, account, location and counterparty labels."""
    out = df.withColumn("status", scalars.status_label(F.col("removed"), F.col("superseded"), F.col("pending")))
    if "personal_finance_category" in out.columns and "category" in out.columns:
        out = out.withColumn("category_label", scalars.category_label(
            F.col("personal_finance_category").getField("detailed"), F.col("category")))
    if "account" in out.columns:
        a = F.col("account")
        out = out.withColumn("account_label", scalars.account_label(a.getField("name"), a.getField("official_name"),
                                                                    a.getField("mask")))
    if "location" in out.columns:
        out = out.withColumn("location_label", scalars.location_label(F.col("location")))
    if "counterparties" in out.columns:
        out = out.withColumn("counterparty_names", scalars.counterparty_names(F.col("counterparties")))
    return out


VERSION_COLUMNS = (
    ("arrival_seq", "event_id"), ("event_type", "event_type"), ("event_class", "event_class"),
    ("supersedes_seq", "supersedes_event_id"), ("transaction_id", "transaction_id"),
    ("pending_transaction_id", "pending_transaction_id"), ("account_id", "account_id"), ("txn_date", "date"),
    ("authorized_date", "authorized_date"), ("txn_datetime", "datetime"), ("authorized_datetime", "authorized_datetime"),
    ("name", "name"), ("merchant_name", "merchant_name"), ("original_description", "original_description"),
    ("amount", "amount"), ("iso_currency_code", "iso_currency_code"),
    ("unofficial_currency_code", "unofficial_currency_code"), ("pending", "pending"),
    ("payment_channel", "payment_channel"), ("transaction_type", "transaction_type"),
    ("transaction_code", "transaction_code"), ("category_json", "category_json"), ("category_id", "category_id"),
    ("personal_finance_category_json", "personal_finance_category_json"),
    ("counterparties_json", "counterparties_json"), ("location_json", "location_json"),
    ("payment_meta_json", "payment_meta_json"), ("website", "website"), ("logo_url", "logo_url"),
    ("merchant_entity_id", "merchant_entity_id"), ("check_number", "check_number"),
    ("account_owner", "account_owner"), ("raw_json", "raw_json"), ("payload_hash", "payload_hash"),
    ("inserted_at", "inserted_at"), ("received_at", "received_at"),
)


def transaction_versions(ledger: DataFrame, transaction_id: str | None = None,
                         width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every stored version, numbered from 1 for the oldest, JSON expanded.

    With ``transaction_id`` this is a point scan (pushed to the Parquet reader), oldest version first; without
    it the history of every id is produced at once, in no order: ``version_number`` tells it.
    """
    rows = ledger
    if transaction_id is not None:
        rows = rows.filter(F.col("transaction_id") == transaction_id)
    rows = rows.select(*[F.col(s).alias(d) for s, d in VERSION_COLUMNS])
    if transaction_id is not None:
        rows = rows.withColumn("version_number", F.row_number().over(
            Window.partitionBy("transaction_id").orderBy("event_id"))).orderBy("event_id")
    else:
        rows = salted_row_number(rows, "transaction_id", "event_id", "version_number", width)
    # Parsed after the shuffle, which moves the compact JSON texts.
    rows = expand_json(rows)
    return rows.withColumn("raw", F.try_parse_json(F.nullif(F.col("raw_json"), F.lit("")))).drop("raw_json")


def transaction_history(ledger: DataFrame, transaction_id: str | None = None) -> DataFrame:
    """Short version rows; of one id oldest first, of all ids in no order (``event_id`` tells it)."""
    rows = ledger if transaction_id is None else ledger.filter(
        F.col("transaction_id") == transaction_id).orderBy("arrival_seq")
    return rows.select(F.col("arrival_seq").alias("event_id"), "event_type", "event_class",
                       F.col("supersedes_seq").alias("supersedes_event_id"), "transaction_id", "txn_date", "amount",
                       "name", "merchant_name", "pending", "payload_hash", "inserted_at")


def list_transactions(active: DataFrame, months_back: int | None = None, today=None, limit: int | None = None,
                      account_id: str | None = None) -> DataFrame:
    """Report input listing: active rows, newest first, with ``direction`` and parsed categories."""
    rows = months_back_filter(active, months_back, today)
    if account_id:
        rows = rows.filter(F.col("account_id") == account_id)
    rows = rows.select("transaction_id", "date", "name", "merchant_name", "amount", "category_json",
                       "personal_finance_category_json", "iso_currency_code", "pending", "removed", "superseded",
                       "account_id", "state_event_id")
    if limit is not None and limit > 0:
        rows = rows.orderBy(*newest_first(rows)).limit(limit)
    return expand_json(rows)


def list_accounts(accounts_latest: DataFrame) -> DataFrame:
    """Accounts with type and subtype, by account id."""
    return accounts_latest.select("account_id", "type", "subtype").orderBy("account_id")
