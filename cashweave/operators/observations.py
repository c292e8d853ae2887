"""Append-only account observations.

An observation is recorded once per *globally new* identity (item, account, content hash):
a balance that returns to an earlier value is not recorded again (as in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave import schemas
from cashweave.functions import hashing, privacy
from cashweave.operators.ledger import insert_if_absent

SOURCE = "accounts_balance_get"


def append_account_observations(readings: DataFrame, now: str, stored: DataFrame | None = None,
                                env: str | None = None) -> DataFrame:
    """Rows to append for a batch of account readings.

    ``readings``: ``observation_seq, item_id, account`` (struct of the account payload) and optional
    ``institution_id, institution_name``. Returns :data:`schemas.OBSERVATION` rows, one per new
    identity (first reading wins), minus identities already in ``stored``.
    """
    atype_raw = readings.schema["account"].dataType
    atype = privacy.stripped_type(atype_raw)
    optional = [n for n in ("institution_id", "institution_name", "env") if n in readings.columns]
    # The stripped account travels as it is; its text and columns are spelt for the first reading of each identity.
    keyed = readings.select(F.col("observation_seq").cast("long").alias("observation_seq"), "item_id",
                            privacy.strip_secrets(F.col("account"), atype_raw).alias("account"), *optional)
    acc = F.col("account")

    # The hashed record: the stripped account payload with the item and institution merged in.
    record = {f.name: (acc.getField(f.name), f.dataType) for f in atype.fields}
    record["item_id"] = (F.col("item_id"), T.StringType())

    def record_text(*more: str) -> Column:
        fields = [(n, c, t) for n, (c, t) in record.items()] + [(n, F.col(n), T.StringType()) for n in more]
        return hashing.canonical_json(F.struct(*[c.alias(n) for n, c, _ in fields]),
                                      T.StructType([T.StructField(n, t, True) for n, _, t in fields]))

    # Institution keys are merged only when given (non-empty), so the record has them only then. Without the
    # columns there is one form of the record: building the other three takes the driver seconds.
    given = {n: F.coalesce(F.col(n), F.lit("")) != "" for n in ("institution_id", "institution_name") if n in optional}
    text = record_text()
    for n, is_given in given.items():
        text = F.when(is_given, record_text(n)).otherwise(text)
    if len(given) == 2:
        text = F.when(given["institution_id"] & given["institution_name"], record_text(*given)).otherwise(text)

    bal = acc.getField("balances") if "balances" in atype.fieldNames() else F.lit(None)

    def b(name: str, cast: str):
        return bal.getField(name).cast(cast) if "balances" in atype.fieldNames() else F.lit(None).cast(cast)

    def a(name: str):
        return acc.getField(name).cast("string") if name in atype.fieldNames() else F.lit(None).cast("string")

    def institution(name: str) -> Column:
        return F.when(given[name], F.col(name)) if name in given else F.lit(None).cast("string")

    keyed = keyed.filter(F.coalesce(a("account_id"), F.lit("")) != "").withColumn("payload_hash", hashing.payload_hash(text))
    keyed = keyed.withColumn("observation_identity", hashing.observation_identity(
        F.col("item_id").cast("string"), a("account_id"), F.col("payload_hash")))
    first = insert_if_absent(keyed, stored, "observation_identity", "observation_seq").select(
        "observation_seq", "observation_identity", "payload_hash",
        a("account_id").alias("account_id"),
        F.col("item_id").cast("string").alias("item_id"),
        institution("institution_id").alias("institution_id"),
        institution("institution_name").alias("institution_name"),
        a("name").alias("name"), a("official_name").alias("official_name"), a("type").alias("type"),
        a("subtype").alias("subtype"), a("mask").alias("mask"),
        b("iso_currency_code", "string").alias("iso_currency_code"),
        b("unofficial_currency_code", "string").alias("unofficial_currency_code"),
        b("current", "double").alias("current_balance"), b("available", "double").alias("available_balance"),
        b("limit", "double").alias("limit_balance"),
        F.lit(SOURCE).alias("source"),
        text.alias("raw_json"),
        F.lit(now).alias("observed_at"),
        (F.col("env") if "env" in optional else F.lit(env).cast("string")).alias("env"),
        F.lit(schemas.APP_VERSION).alias("app_version"),
    )
    return first.select(*[F.col(f.name).cast(f.dataType) for f in schemas.OBSERVATION.fields])
