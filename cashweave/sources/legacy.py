"""One-time import of legacy snapshot tables into the ledger and observations.

Each legacy row becomes a ``legacy_import`` state event; a row flagged removed also becomes a
``removed`` event right after it. Both come out of one ``explode`` (no self-union). The payload
is the surviving raw JSON object when there is one, else a payload rebuilt from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave import schemas
from cashweave.functions import hashing, privacy
from cashweave.operators.ledger import insert_if_absent

REMOVAL_SOURCE = "legacy_removed_flag"


def legacy_payload(df: DataFrame):
    """payload rebuilt from legacy columns; NULL keys dropped, pending as a boolean."""
    rebuilt = F.struct(
        F.col("account_id").alias("account_id"), F.col("amount").alias("amount"),
        F.col("authorized_date").alias("authorized_date"),
        F.from_json(F.nullif(F.col("category_json"), F.lit("")), T.ArrayType(T.StringType())).alias("category"),
        F.col("date").alias("date"), F.col("iso_currency_code").alias("iso_currency_code"),
        F.col("merchant_name").alias("merchant_name"), F.col("name").alias("name"),
        (F.coalesce(F.col("pending"), F.lit(0)) != 0).alias("pending"),
        F.from_json(F.nullif(F.col("personal_finance_category_json"), F.lit("")),
                    "primary string, detailed string, confidence_level string").alias("personal_finance_category"),
        F.col("transaction_id").alias("transaction_id"),
    )
    dtype = df.select(rebuilt.alias("p")).schema["p"].dataType
    return F.to_json(hashing.canonical_value(rebuilt, dtype))  # default options drop NULL fields


def import_legacy_transactions(legacy: DataFrame, now: str, ledger: DataFrame | None = None,
                               base_seq: int = 0) -> DataFrame:
    """Ledger rows for the legacy ``transactions`` snapshot.

    ``arrival_seq = base_seq + 2 * legacy_rowid + phase`` keeps the reference's row order. Ids that
    already have a ``legacy_import`` event in ``ledger`` are skipped, so a re-run adds nothing (T9).
    """
    rows = legacy.filter(F.coalesce(F.col("transaction_id"), F.lit("")) != "")
    if ledger is not None:
        done = ledger.filter(F.col("event_type") == "legacy_import").select("transaction_id")
        rows = rows.join(done, "transaction_id", "left_anti")
    # The surviving raw object through the exact canonicaliser (Arrow-batched Python, which sees nothing but
    # such objects), else the payload rebuilt from typed columns, in canonical form by built-ins.
    payload = F.coalesce(privacy.canonical_open_json(F.col("raw_json")), legacy_payload(rows))
    removal = F.to_json(F.struct(F.lit(REMOVAL_SOURCE).alias("source"), F.col("transaction_id").alias("transaction_id")))
    phases = F.array(
        F.struct(F.lit(0).alias("phase"), F.lit("legacy_import").alias("event_type"), payload.alias("text")),
        F.struct(F.lit(1).alias("phase"), F.lit("removed").alias("event_type"), removal.alias("text")))
    ex = rows.select("*", F.explode(phases).alias("ev")).filter(
        (F.col("ev.phase") == 0) | (F.coalesce(F.col("removed"), F.lit(0)) != 0))
    ex = ex.withColumn("arrival_seq", (F.lit(base_seq) + F.col("legacy_rowid") * 2 + F.col("ev.phase")).cast("long"))

    # supersedes: the id's newest stored event for phase 0, the phase-0 event for phase 1.
    if ledger is not None:
        prior = ledger.join(rows.select("transaction_id"), "transaction_id", "left_semi") \
            .groupBy("transaction_id").agg(F.max("arrival_seq").alias("_prior"))
        ex = ex.join(prior, "transaction_id", "left")
    else:
        ex = ex.withColumn("_prior", F.lit(None).cast("long"))
    supersedes = F.when(F.col("ev.phase") == 0, F.col("_prior")) \
        .otherwise((F.lit(base_seq) + F.col("legacy_rowid") * 2).cast("long"))
    klass = F.when(F.col("ev.event_type") == "removed", "removed").otherwise("state")
    digest = hashing.payload_hash(F.col("ev.text"))
    out = ex.select(
        "arrival_seq",
        F.col("ev.event_type").alias("event_type"), klass.alias("event_class"), supersedes.alias("supersedes_seq"),
        "transaction_id", F.lit(None).cast("string").alias("pending_transaction_id"), "account_id", "item_id",
        F.col("date").alias("txn_date"), "authorized_date", "name", "merchant_name", "amount",
        "iso_currency_code", "category_json", "personal_finance_category_json",
        F.when(F.coalesce(F.col("pending"), F.lit(0)) != 0, 1).otherwise(0).alias("pending"),
        F.col("ev.text").alias("raw_json"), digest.alias("payload_hash"),
        F.col("updated_at").alias("received_at"), F.lit(now).alias("inserted_at"),
        F.lit(schemas.APP_VERSION).alias("app_version"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
    )
    out = out.withColumn("event_identity", hashing.event_identity(
        F.when(F.coalesce(F.col("item_id"), F.lit("")) != "", F.col("item_id")), F.col("transaction_id"),
        F.col("event_class"), F.col("payload_hash"), F.col("supersedes_seq")))
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in schemas.LEDGER.fields])


def import_legacy_accounts(accounts: DataFrame, now: str, stored: DataFrame | None = None) -> DataFrame:
    """Legacy ``accounts`` rows as observations; ``observed_at`` is ``updated_at`` or ``now``."""
    rows = accounts.filter(F.coalesce(F.col("account_id"), F.lit("")) != "")
    data_cols = [c for c in accounts.columns if c != "legacy_rowid"]
    whole = F.struct(*[F.col(c) for c in sorted(data_cols)])
    dtype = rows.select(whole.alias("p")).schema["p"].dataType
    payload = F.to_json(hashing.canonical_value(whole, dtype))  # typed columns: built-ins, NULL fields dropped
    digest = hashing.payload_hash(payload)
    out = rows.select(
        F.col("legacy_rowid").alias("observation_seq"),
        hashing.observation_identity(F.coalesce(F.col("item_id"), F.lit("")), F.col("account_id"), digest,
                                     "legacy_import").alias("observation_identity"),
        "account_id", "item_id", F.lit(None).cast("string").alias("institution_id"),
        F.lit(None).cast("string").alias("institution_name"), "name", "official_name", "type", "subtype", "mask",
        "iso_currency_code", F.lit(None).cast("string").alias("unofficial_currency_code"), "current_balance",
        "available_balance", F.lit(None).cast("double").alias("limit_balance"),
        F.lit("legacy_import").alias("source"), payload.alias("raw_json"), digest.alias("payload_hash"),
        F.coalesce(F.col("updated_at"), F.lit(now)).alias("observed_at"), F.lit(None).cast("string").alias("env"),
        F.lit(schemas.APP_VERSION).alias("app_version"))
    out = insert_if_absent(out, stored, "observation_identity", "observation_seq")
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schemas.OBSERVATION.fields])
