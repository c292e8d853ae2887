"""Stand-in inputs built from the driver's test tables (mappings of FIXTURES.md).

These only shape rows into the schemas the jobs expect; they do none of the jobs' work.
The jobs must not (and do not) rely on how these rows are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave import schemas

# Fixed clock values of the fixtures.
FIXTURE_NOW = "2024-02-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload_struct(ptype: T.StructType = schemas.TRANSACTION_PAYLOAD, **given: Column) -> Column:
    """A payload struct of ``ptype``; fields not given are typed NULLs."""
    fields = []
    for f in ptype.fields:
        c = given.get(f.name)
        fields.append((c if c is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def l1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the ``events`` table as a transaction change feed (one change row per event)."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    et = F.col("event_type")
    is_err = et == "error"
    tid = F.concat(F.lit("u"), uid.cast("string"), F.lit("-w"), (F.col("event_id") % 7).cast("string"))
    bucket = F.floor(F.col("value") / 40) * 40
    amount = F.when(is_err, F.lit(None)).when(et == "signup", -bucket).otherwise(bucket).cast("double")
    pending = F.when(is_err, F.lit(None)).otherwise(et == "view")
    link = F.when(et == "purchase", F.concat(F.lit("u"), uid.cast("string"), F.lit("-w"),
                                               ((F.col("event_id") + 1) % 7).cast("string")))
    date = F.when(~is_err, F.date_format(F.add_months(F.trunc(F.col("ts").cast("date"), "month"),
                                                      (uid % 12).cast("int")), "yyyy-MM-dd"))
    merchant = F.when(uid % 4 == 0, F.lit(None)).when(uid % 4 == 1, F.lit("")) \
        .otherwise(F.concat(F.lit("M"), (uid % 20).cast("string")))
    name = F.when(uid % 8 == 0, F.lit(None)).otherwise(F.concat(F.lit("N"), (uid % 10).cast("string")))
    event_type = F.when(is_err, "removed").when(et == "view", "modified").when(et == "click", "historical_import") \
        .otherwise("added")
    payload = payload_struct(
        transaction_id=tid, account_id=F.concat(F.lit("a"), uid.cast("string")),
        amount=F.when(~is_err, amount), pending=pending, pending_transaction_id=link,
        date=date, merchant_name=F.when(~is_err, merchant), name=F.when(~is_err, name))
    return e.select(
        F.col("event_id").cast("long").alias("arrival_seq"),
        F.concat(F.lit("i"), (uid % 5).cast("string")).alias("item_id"),
        event_type.alias("event_type"),
        F.concat(F.lit("b"), F.floor(F.col("event_id") / 500).cast("string")).alias("batch_id"),
        F.lit(None).cast("string").alias("cursor_fingerprint"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
        F.lit("sandbox").alias("env"),
        payload.alias("payload"),
    )


def r1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` joined with ``customer`` as one ``added`` change row per order."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    amount = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    payload = payload_struct(
        transaction_id=F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        account_id=F.concat(F.lit("a"), F.col("o_custkey").cast("string")),
        amount=amount, pending=F.col("o_orderpriority") == "1-URGENT",
        date=F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"),
        merchant_name=F.col("c_mktsegment"), name=F.col("c_name"))
    return j.select(
        F.col("o_orderkey").cast("long").alias("arrival_seq"),
        F.concat(F.lit("i"), (F.col("o_custkey") % 100).cast("string")).alias("item_id"),
        F.lit("added").alias("event_type"),
        F.lit("r1").alias("batch_id"),
        F.lit(None).cast("string").alias("cursor_fingerprint"),
        F.lit(FIXTURE_NOW).alias("received_at"),
        F.lit("production").alias("env"),
        payload.alias("payload"),
    )


def ob1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OB1: every row of ``events`` as an account balance reading."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    balances = F.struct(F.lit(None).cast("double").alias("available"),
                        (F.floor(F.col("value") / 100) * 100).cast("double").alias("current"),
                        F.lit(None).cast("double").alias("limit"),
                        F.lit("USD").alias("iso_currency_code"),
                        F.lit(None).cast("string").alias("unofficial_currency_code"))
    account = F.struct(
        F.concat(F.lit("a"), uid.cast("string")).alias("account_id"),
        F.when(uid % 3 != 0, F.concat(F.lit("Acct "), uid.cast("string"))).alias("name"),
        F.lit(None).cast("string").alias("official_name"),
        F.lit("depository").alias("type"), F.lit("checking").alias("subtype"),
        (uid + 1000).cast("string").alias("mask"),
        balances.alias("balances"))
    return e.select(F.col("event_id").cast("long").alias("observation_seq"),
                    F.concat(F.lit("i"), (uid % 5).cast("string")).alias("item_id"),
                    account.alias("account"), F.lit("sandbox").alias("env"))


def it1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IT1: ``supplier`` rows as connected items."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    env = F.when(F.col("s_nationkey") % 3 == 0, "sandbox").when(F.col("s_nationkey") % 3 == 1, "production") \
        .otherwise("")
    token_env = F.when(env != "", env).when(k % 2 == 0, "sandbox").otherwise("production")
    active = F.when(F.col("s_acctbal") > 0, 1).otherwise(0)
    return s.select(
        F.concat(F.lit("i"), k.cast("string")).alias("item_id"),
        F.concat(F.lit("access-"), token_env, F.lit("-")).alias("token_prefix"),
        F.lit(True).alias("has_access_token"),
        env.alias("env"),
        F.concat(F.lit("ins_"), F.col("s_nationkey").cast("string")).alias("institution_id"),
        F.col("s_name").alias("institution_name"),
        F.when(k % 10 != 0, F.concat(F.lit("cursor-"), k.cast("string"))).alias("cursor"),
        F.lit(FIXTURE_NOW).alias("created_at"),
        F.lit(FIXTURE_NOW).alias("updated_at"),
        active.cast("int").alias("active"),
        F.when(active == 0, F.lit("2024-01-15T00:00:00Z")).alias("disconnected_at"),
    )


def it1_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves of every supplier item again: new environment and institution name, no institution id."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.select(F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("item_id"),
                    F.lit("access-production-").alias("token_prefix"), F.lit("production").alias("env"),
                    F.lit(None).cast("string").alias("institution_id"), F.col("n_name").alias("institution_name"))


def sr1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR1: ``orders`` as closed sync runs (F ok, O error, P still running)."""
    o = table(spark, sf_dir, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("running")
    ts = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        F.col("o_orderkey").cast("long").alias("sync_id"),
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("batch_id"),
        F.concat(F.lit("i"), (F.col("o_custkey") % 100).cast("string")).alias("item_id"),
        ts.alias("started_at"), F.when(st != "running", ts).alias("finished_at"), st.alias("status"),
        F.lit("sync").alias("mode"))


def bf1_backfill_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill status log from ``supplier``: a start row, then complete (balance > 1000) or error."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    final = F.when(F.col("s_acctbal") > 1000, "complete").otherwise("error")
    rows = F.array(F.struct(F.lit(0).alias("phase"), F.lit("running").alias("status")),
                   F.struct(F.lit(1).alias("phase"), final.alias("status")))
    e = s.select(k, F.explode(rows).alias("r"))
    return e.select(F.concat(F.lit("i"), k.cast("string")).alias("item_id"),
                    (k * 2 + F.col("r.phase")).cast("long").alias("seq"), F.col("r.status").alias("status"))


def lg1_legacy_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LG1: ``orders`` as legacy snapshot rows (P removed, O pending, raw JSON only on odd keys)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tid = F.concat(F.lit("t"), k.cast("string"))
    acct = F.concat(F.lit("a"), F.col("o_custkey").cast("string"))
    date = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    merchant = F.concat(F.lit("M"), (F.col("o_custkey") % 20).cast("string"))
    pending = F.col("o_orderstatus") == "O"
    raw = F.to_json(F.struct(acct.alias("account_id"), F.col("o_totalprice").alias("amount"), date.alias("date"),
                             F.lit("USD").alias("iso_currency_code"), merchant.alias("merchant_name"),
                             F.col("o_orderpriority").alias("name"), pending.alias("pending"),
                             F.lit("legacy_raw").alias("source"), tid.alias("transaction_id")))
    return o.select(
        k.cast("long").alias("legacy_rowid"), tid.alias("transaction_id"), acct.alias("account_id"),
        F.concat(F.lit("i"), (F.col("o_custkey") % 100).cast("string")).alias("item_id"),
        date.alias("date"), F.lit(None).cast("string").alias("authorized_date"),
        F.col("o_orderpriority").alias("name"), merchant.alias("merchant_name"),
        F.col("o_totalprice").alias("amount"), F.lit("USD").alias("iso_currency_code"),
        F.lit(None).cast("string").alias("category_json"),
        F.lit(None).cast("string").alias("personal_finance_category_json"),
        pending.cast("int").alias("pending"), (F.col("o_orderstatus") == "P").cast("int").alias("removed"),
        F.when(k % 2 == 1, raw).alias("raw_json"), F.lit(FIXTURE_NOW).alias("updated_at"))


def lg1_legacy_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy accounts from ``customer``."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("legacy_rowid"),
        F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("i"), (F.col("c_custkey") % 100).cast("string")).alias("item_id"),
        F.col("c_name").alias("name"), F.lit(None).cast("string").alias("official_name"),
        F.lit("depository").alias("type"), F.lit(None).cast("string").alias("subtype"),
        F.lit(None).cast("string").alias("mask"), F.col("c_acctbal").alias("current_balance"),
        F.lit(None).cast("double").alias("available_balance"), F.lit("USD").alias("iso_currency_code"),
        F.lit(None).cast("string").alias("updated_at"))


# Fixed message texts of the ER1 fixture, picked by event_id % 6.
ER1_MESSAGES = (
    "PRODUCT_NOT_READY: transactions not ready",
    "Rate limit exceeded: too many requests",
    "Read timed out after 30s",
    "Connection reset by peer",
    "database is locked",
    "unexpected failure for token access-sandbox-4f9a1c2b7d and key Zm9vYmFyYmF6cXV4cXV1eHF1dXhxdXV4cXV1eA",
)


def er1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER1: every row of ``events`` as a failed call (message, optional JSON body, exception type)."""
    e = table(spark, sf_dir, "events")
    msg = F.element_at(F.array(*[F.lit(m) for m in ER1_MESSAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.when(F.col("event_id") % 4 == 0,
                  F.lit('{"error_code":"ITEM_LOGIN_REQUIRED","error_message":"the login details changed"}'))
    typ = F.when(F.col("event_id") % 2 == 0, "ApiException").otherwise("RuntimeError")
    return e.select(F.col("event_id").cast("long").alias("event_id"), msg.alias("message"), body.alias("body"),
                    typ.alias("type_name"))


def pg1_pages(spark: SparkSession, sf_dir: str, block: int = 500) -> DataFrame:
    """PG1: the L1 feed as change pages, one page per (block of ``block`` events, item).

    ``historical_import`` rows ride in ``added`` (pages carry only the three lists).
    """
    ch = l1_changes(spark, sf_dir)
    page_seq = (F.floor(F.col("arrival_seq") / block) * 8 +
                F.substring(F.col("item_id"), 2, 8).cast("long")).cast("long")
    ch = ch.withColumn("page_seq", page_seq)

    def lst(types, removal=False):
        val = F.struct(F.col("payload.transaction_id").alias("transaction_id"),
                       F.col("payload.account_id").alias("account_id")) if removal else F.col("payload")
        item = F.when(F.col("event_type").isin(*types), F.struct(F.col("arrival_seq").alias("s"), val.alias("v")))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x.getField("v"))

    return ch.groupBy("page_seq", "item_id").agg(
        lst(["added", "historical_import"]).alias("added"),
        lst(["modified"]).alias("modified"),
        lst(["removed"], removal=True).alias("removed"),
        F.min("received_at").alias("received_at"),
    ).select("item_id", "page_seq", F.lit("sync").alias("mode"), "added", "modified", "removed",
             F.concat(F.lit("cursor-"), F.col("page_seq").cast("string")).alias("next_cursor"),
             F.lit(True).alias("has_more"), "received_at", F.lit("sandbox").alias("env"))


def sr1_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SR1 as run events: an opening row (running, mode sync) and, for finished runs, a closing
    row whose mode is left empty for failed runs (the view keeps the opening mode)."""
    runs = sr1_runs(spark, sf_dir)
    opening = F.struct(F.lit(0).alias("phase"), F.lit("running").alias("status"), F.lit("sync").alias("mode"),
                       F.lit(None).cast("string").alias("finished_at"))
    closing = F.struct(F.lit(1).alias("phase"), F.col("status").alias("status"),
                       F.when(F.col("status") == "ok", F.lit("sync")).alias("mode"),
                       F.col("finished_at").alias("finished_at"))
    ev = runs.select("sync_id", "batch_id", "item_id", "started_at",
                     F.explode(F.when(F.col("status") == "running", F.array(opening))
                               .otherwise(F.array(opening, closing))).alias("e"))
    return ev.select("sync_id", (F.col("sync_id") * 2 + F.col("e.phase")).cast("long").alias("event_seq"),
                     "batch_id", "item_id", "started_at", F.col("e.finished_at").alias("finished_at"),
                     F.col("e.status").alias("status"), F.col("e.mode").alias("mode"))


def open_pages(spark: SparkSession, sf_dir: str, block: int = 500) -> DataFrame:
    """Change pages as JSON lines (page_seq, value), with fields no schema lists and credentials inside.

    State payloads carry ``x_source``, ``x_step`` (0 or 1, so that it alone may change), an unlisted key in
    ``location``, and credential keys at two depths; every 97th event has an empty transaction id. Page
    numbers start above 2**31.
    """
    ch = l1_changes(spark, sf_dir)
    seq, p = F.col("arrival_seq"), F.col("payload")
    uid = F.substring("payload.account_id", 2, 20).cast("long")
    tid = F.when(seq % 97 == 0, F.lit("")).otherwise(p["transaction_id"]).alias("transaction_id")
    state = F.struct(
        tid, p["account_id"].alias("account_id"), p["pending_transaction_id"].alias("pending_transaction_id"),
        p["amount"].alias("amount"), p["date"].alias("date"), p["name"].alias("name"),
        p["merchant_name"].alias("merchant_name"), p["pending"].alias("pending"),
        F.when(uid % 2 == 0, F.lit("2024-01-01T00:00:00Z")).alias("datetime"),
        F.array(F.lit("Food"), F.concat(F.lit("K"), (uid % 3).cast("string"))).alias("category"),
        F.array(F.struct(F.concat(F.lit("Shop "), (uid % 5).cast("string")).alias("name"), F.lit("k").alias("api_key")))
        .alias("counterparties"),
        F.struct(F.concat(F.lit("p"), (uid % 4).cast("string")).alias("plus_code"),
                 F.concat(F.lit("C"), (uid % 7).cast("string")).alias("city")).alias("location"),
        F.concat(F.lit("f"), (uid % 3).cast("string")).alias("x_source"), (seq % 2).alias("x_step"),
        F.lit("access-sandbox-0123456789").alias("access_token"))
    gone = F.struct(tid, p["account_id"].alias("account_id"), F.concat(F.lit("r"), (uid % 2).cast("string")).alias("x_reason"))
    text = F.when(F.col("event_type") == "removed", F.to_json(gone)).otherwise(F.to_json(state))
    page = F.lit(3_000_000_000) + F.floor(seq / block) * 8 + F.substring("item_id", 2, 8).cast("long")

    def listed(*types):
        item = F.when(F.col("event_type").isin(*types), F.struct(seq.alias("s"), text.alias("v")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), ",")

    grouped = ch.withColumn("page_seq", page).groupBy("page_seq", "item_id").agg(
        listed("added", "historical_import").alias("a"), listed("modified").alias("m"), listed("removed").alias("r"))
    value = F.concat(F.lit('{"item_id":"'), F.col("item_id"), F.lit('","page_seq":'), F.col("page_seq").cast("string"),
                     F.lit(',"mode":"sync","added":['), F.col("a"), F.lit('],"modified":['), F.col("m"),
                     F.lit('],"removed":['), F.col("r"), F.lit('],"next_cursor":"cursor-'), F.col("page_seq").cast("string"),
                     F.lit('","has_more":true}'))
    return grouped.select("page_seq", value.alias("value"))
