"""Privacy jobs over whole tables.

All regex work runs in the JVM (``rlike``, ``regexp_replace``, ``regexp_extract_all``) over
whole texts; counts come from literal marker counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave.functions import hashing, privacy, scalars


def _staged(df: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """Add one column per redaction stage. Each stage is referenced twice (marker count and next
    stage), so Catalyst keeps it as its own projection: every regex runs once per row, and only
    on rows where some token shape occurs (``_hit``); other rows pass through unchanged."""
    names = ["_stage0"]
    out = df.withColumn("_stage0", F.col(text_col)).withColumn("_hit", privacy.maybe_token(F.col(text_col)))
    for i, pattern in enumerate(privacy.JAVA_TOKEN_PATTERNS, start=1):
        prev = F.col(f"_stage{i - 1}")
        out = out.withColumn(f"_stage{i}", F.when(F.col("_hit"), F.regexp_replace(prev, pattern, privacy.REDACTED))
                             .otherwise(prev))
        names.append(f"_stage{i}")
    return out, names


def redact_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """F19 over a text table: every token shape replaced, with the number of replacements."""
    staged, names = _staged(df.select(id_col, text_col), text_col)
    last = F.col(names[-1])
    n = privacy.marker_count(last) - privacy.marker_count(F.col(names[0]))
    return staged.select(F.col(id_col), last.alias("redacted_text"), n.cast("long").alias("redactions"))


def secret_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Q16: rows holding token shapes or private-key block headers, with a count per pattern.

    Pattern k's count is the growth in redaction markers between stage k-1 and stage k of
    F19 (literal counts over the staged texts). Texts failing the cheap necessary condition run
    one boundary-anchored pattern and nothing else; candidates run each token pattern once as a
    match test and, if they hold a token, once as the staged replacement.
    """
    key_block = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(privacy.KEY_BLOCK_PATTERN)).cast("long")
    hits = df.select(id_col, text_col).filter(
        privacy.has_token(F.col(text_col)) | F.coalesce(F.col(text_col).contains("PRIVATE KEY"), F.lit(False)))
    staged, names = _staged(hits.withColumn("_blocks", key_block), text_col)
    marks = staged.select(F.col(id_col), "_blocks", *[privacy.marker_count(F.col(n)).alias(f"_m{i}") for i, n in enumerate(names)])
    k = len(names) - 1
    cols = [(F.col(f"_m{i}") - F.col(f"_m{i - 1}")).cast("long").alias(f"pattern_{i}") for i in range(1, k + 1)]
    blocks = F.col("_blocks").alias(f"pattern_{k + 1}")
    out = marks.select(F.col(id_col), *cols, blocks, (F.col(f"_m{k}") - F.col("_m0") + F.col("_blocks")).cast("long")
                       .alias("findings"))
    return out.filter(F.col("findings") > 0)


def fingerprint_column(df: DataFrame, col: str, out_col: str | None = None, length: int = 16) -> DataFrame:
    """F7 on one column; the clear value is dropped."""
    out = out_col or f"{col}_fingerprint"
    return df.withColumn(out, hashing.fingerprint(F.col(col), length)).drop(col)


def classify_errors(errors: DataFrame, debug: bool = False) -> DataFrame:
    """F23/F24 over a failure log (message, body, type_name): error class and safe message."""
    return errors.select(
        *[c for c in errors.columns if c not in ("message", "body", "type_name")],
        privacy.classify_error(F.col("message"), F.col("body"), F.col("type_name")).alias("error_class"),
        privacy.safe_error_message(F.col("message"), F.col("body"), debug).alias("safe_message"),
        scalars.is_not_ready(F.get_json_object(F.col("body"), "$.error_code"), F.col("message")).alias("retryable"),
    )


_KEY = r'"((?:[^"\\]|\\.)*)"\s*:'


def credential_key_audit(df: DataFrame, json_col: str = "raw_json", id_col: str = "arrival_seq") -> DataFrame:
    """Q17: rows whose stored JSON has a credential key at any depth (normalised names)."""
    keys = F.regexp_extract_all(F.col(json_col), F.lit(_KEY), 1)
    norm = F.transform(keys, lambda k: privacy.normalized_field_name_col(k))
    banned = F.array(*[F.lit(n) for n in sorted(privacy.CREDENTIAL_FIELD_NAMES)])
    hits = F.array_intersect(norm, banned)
    return df.select(F.col(id_col), hits.alias("credential_keys")).filter(F.size("credential_keys") > 0)


def credential_key_summary(df: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """Q17 as one row: rows checked, rows holding a credential key, and the verdict."""
    keys = F.regexp_extract_all(F.col(json_col), F.lit(_KEY), 1)
    norm = F.transform(keys, lambda k: privacy.normalized_field_name_col(k))
    banned = F.array(*[F.lit(n) for n in sorted(privacy.CREDENTIAL_FIELD_NAMES)])
    hit = F.size(F.array_intersect(norm, banned)) > 0
    return df.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(hit).alias("rows_with_credential_keys")) \
        .withColumn("ok", F.col("rows_with_credential_keys") == 0)
