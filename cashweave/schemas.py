"""Explicit schemas: change-feed payloads, the event ledger, observations and dimensions.

No schema inference anywhere. Landed pages hold payloads as JSON text: typed columns are read from it, and
its canonical form (``raw_json``) keeps every field, listed here or not, for later reads and for the hash.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()
L = T.LongType()
I = T.IntegerType()
B = T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


PERSONAL_FINANCE_CATEGORY = _struct(("primary", S), ("detailed", S), ("confidence_level", S))
COUNTERPARTY = _struct(("name", S), ("type", S), ("logo_url", S), ("website", S), ("entity_id", S),
                       ("confidence_level", S))
LOCATION = _struct(("address", S), ("city", S), ("region", S), ("postal_code", S), ("country", S),
                   ("lat", D), ("lon", D), ("store_number", S))
PAYMENT_META = _struct(("by_order_of", S), ("payee", S), ("payer", S), ("payment_method", S),
                       ("payment_processor", S), ("ppd_id", S), ("reason", S), ("reference_number", S))

# One transaction as the change feed reports it.
TRANSACTION_PAYLOAD = _struct(
    ("transaction_id", S), ("account_id", S), ("pending_transaction_id", S), ("amount", D),
    ("date", S), ("authorized_date", S), ("datetime", S), ("authorized_datetime", S),
    ("name", S), ("merchant_name", S), ("original_description", S),
    ("iso_currency_code", S), ("unofficial_currency_code", S), ("pending", B),
    ("category", T.ArrayType(S)), ("category_id", S), ("check_number", S), ("payment_channel", S),
    ("transaction_type", S), ("transaction_code", S), ("website", S), ("logo_url", S),
    ("merchant_entity_id", S), ("account_owner", S), ("personal_finance_category_icon_url", S),
    ("personal_finance_category", PERSONAL_FINANCE_CATEGORY),
    ("counterparties", T.ArrayType(COUNTERPARTY)), ("location", LOCATION), ("payment_meta", PAYMENT_META),
)

REMOVAL_PAYLOAD = _struct(("transaction_id", S), ("account_id", S))

BALANCES = _struct(("available", D), ("current", D), ("limit", D), ("iso_currency_code", S),
                   ("unofficial_currency_code", S))
ACCOUNT_PAYLOAD = _struct(("account_id", S), ("name", S), ("official_name", S), ("type", S), ("subtype", S),
                          ("mask", S), ("balances", BALANCES))

# One landed change page (S1): the unit of atomic commit. An array of strings makes the JSON reader keep each
# payload object as its whole text, with fields it was never told of.
CHANGE_PAGE = _struct(
    ("item_id", S), ("page_seq", L), ("mode", S), ("added", T.ArrayType(S)), ("modified", T.ArrayType(S)),
    ("removed", T.ArrayType(S)), ("next_cursor", S), ("has_more", B),
)

# Event ledger columns in order (the reference's 46, with our names for the key and order).
LEDGER = _struct(
    ("arrival_seq", L), ("event_identity", S), ("event_type", S), ("event_class", S), ("supersedes_seq", L),
    ("transaction_id", S), ("pending_transaction_id", S), ("account_id", S), ("item_id", S),
    ("batch_id", S), ("cursor_fingerprint", S),
    ("txn_date", S), ("authorized_date", S), ("txn_datetime", S), ("authorized_datetime", S),
    ("name", S), ("merchant_name", S), ("original_description", S), ("amount", D),
    ("iso_currency_code", S), ("unofficial_currency_code", S), ("pending", I),
    ("payment_channel", S), ("transaction_type", S), ("transaction_code", S),
    ("category_json", S), ("category_id", S), ("personal_finance_category_json", S),
    ("personal_finance_category_icon_url", S), ("counterparties_json", S), ("location_json", S),
    ("payment_meta_json", S), ("website", S), ("logo_url", S), ("merchant_entity_id", S),
    ("check_number", S), ("account_owner", S),
    ("raw_json", S), ("payload_hash", S), ("received_at", S), ("inserted_at", S), ("env", S),
    ("app_version", S), ("schema_version", I), ("prev_ledger_hash", S), ("ledger_hash", S),
)

OBSERVATION = _struct(
    ("observation_seq", L), ("observation_identity", S), ("account_id", S), ("item_id", S),
    ("institution_id", S), ("institution_name", S), ("name", S), ("official_name", S), ("type", S),
    ("subtype", S), ("mask", S), ("iso_currency_code", S), ("unofficial_currency_code", S),
    ("current_balance", D), ("available_balance", D), ("limit_balance", D), ("source", S),
    ("raw_json", S), ("payload_hash", S), ("observed_at", S), ("env", S), ("app_version", S),
)

ITEMS = _struct(
    ("item_id", S), ("token_prefix", S), ("has_access_token", B), ("env", S), ("institution_id", S),
    ("institution_name", S), ("cursor", S), ("created_at", S), ("updated_at", S), ("active", I),
    ("disconnected_at", S),
)

SYNC_RUN_EVENT = _struct(
    ("sync_id", L), ("batch_id", S), ("item_id", S), ("started_at", S), ("finished_at", S), ("status", S),
    ("mode", S), ("starting_cursor_fingerprint", S), ("ending_cursor_fingerprint", S),
    ("added_count", L), ("modified_count", L), ("removed_count", L), ("inserted_event_count", L),
    ("duplicate_event_count", L), ("page_count", L), ("earliest_transaction_date", S),
    ("latest_transaction_date", S), ("error_class", S), ("error_message", S), ("app_version", S),
)

LEGACY_TRANSACTIONS = _struct(
    ("legacy_rowid", L), ("transaction_id", S), ("account_id", S), ("item_id", S), ("date", S),
    ("authorized_date", S), ("name", S), ("merchant_name", S), ("amount", D), ("iso_currency_code", S),
    ("category_json", S), ("personal_finance_category_json", S), ("pending", I), ("removed", I),
    ("raw_json", S), ("updated_at", S),
)

LEGACY_ACCOUNTS = _struct(
    ("legacy_rowid", L), ("account_id", S), ("item_id", S), ("name", S), ("official_name", S), ("type", S),
    ("subtype", S), ("mask", S), ("current_balance", D), ("available_balance", D), ("iso_currency_code", S),
    ("updated_at", S),
)

# Fixed values that must equal the reference's.
APP_VERSION = "0.2.2"
SCHEMA_VERSION = 2
EVENT_TYPES = ("added", "modified", "removed", "historical_import", "legacy_import", "reconciliation")
