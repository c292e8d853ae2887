"""Per-row scalar expressions.

All are built-in Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
UNKNOWN_MERCHANT = "Unknown merchant"
NO_VALUE = "—"  # em dash shown for a missing label
MASK_DOTS = "••"


def safe_date(c: Column) -> Column:
    """F8: first 10 characters of the text, empty text as NULL; not validated."""
    return F.nullif(F.substring(c.cast("string"), 1, 10), F.lit(""))


def parse_date(c: Column) -> Column:
    """ISO date from the first 10 characters, NULL when that is not ``yyyy-MM-dd``."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def datetime_text(c: Column) -> Column:
    """ISO text or NULL (empty text becomes NULL)."""
    return F.nullif(c.cast("string"), F.lit(""))


def as_float(c: Column) -> Column:
    """double or NULL when not numeric."""
    return c.try_cast("double")


def month_key(d: Column) -> Column:
    """``yyyy-MM``."""
    return F.date_format(d, "yyyy-MM")


def month_floor_minus(today: _dt.date, k: int) -> Column:
    """first of ``today``'s month minus ``k`` months, as a DATE literal."""
    return F.add_months(F.trunc(F.lit(today), "month"), -k)


def event_class(event_type: Column) -> Column:
    """``removed`` for removals, ``state`` for everything else (unknown types included)."""
    return F.when(event_type == "removed", F.lit("removed")).otherwise(F.lit("state"))


def direction(amount: Column) -> Column:
    """>0 outflow, <0 inflow, zero or NULL neutral."""
    a = F.coalesce(amount, F.lit(0))
    return F.when(a > 0, F.lit("outflow")).when(a < 0, F.lit("inflow")).otherwise(F.lit("neutral"))


def merchant_label(merchant_name: Column, name: Column) -> Column:
    """Merchant name, else name, else the fixed unknown label; empty text falls through."""
    return F.coalesce(F.nullif(merchant_name, F.lit("")), F.nullif(name, F.lit("")), F.lit(UNKNOWN_MERCHANT))


def status_label(removed: Column, superseded: Column, pending: Column) -> Column:
    """Removed > Superseded > Pending > Posted."""
    return (F.when(F.coalesce(removed, F.lit(0)) != 0, F.lit("Removed"))
            .when(F.coalesce(superseded, F.lit(0)) != 0, F.lit("Superseded"))
            .when(F.coalesce(pending, F.lit(0)) != 0, F.lit("Pending"))
            .otherwise(F.lit("Posted")))


def category_label(pfc_detailed: Column, category: Column) -> Column:
    """Detailed category with ``_`` as space, lower case; else categories joined; else a dash."""
    detailed = F.when(F.coalesce(pfc_detailed, F.lit("")) != "",
                      F.lower(F.regexp_replace(pfc_detailed, "_", " ")))
    joined = F.when(F.coalesce(F.size(category), F.lit(0)) > 0, F.array_join(category, " / "))
    return F.coalesce(detailed, joined, F.lit(NO_VALUE))


def account_label(name: Column, official_name: Column, mask: Column) -> Column:
    """Name (or official name) with the masked suffix when there is one."""
    label = F.coalesce(F.nullif(name, F.lit("")), F.nullif(official_name, F.lit("")))
    m = F.nullif(mask, F.lit(""))
    return (F.when(label.isNotNull() & m.isNotNull(), F.concat(label, F.lit(" " + MASK_DOTS), m))
            .when(label.isNotNull(), label)
            .when(m.isNotNull(), F.concat(F.lit(MASK_DOTS), m))
            .otherwise(F.lit(NO_VALUE)))


def location_label(location: Column) -> Column:
    """P25: non-empty address, city, region, postal code joined; only when city or address is set."""
    parts = F.array(*[F.nullif(location.getField(k), F.lit("")) for k in ("address", "city", "region", "postal_code")])
    has_anchor = (F.coalesce(location.getField("city"), F.lit("")) != "") | \
                 (F.coalesce(location.getField("address"), F.lit("")) != "")
    return F.when(location.isNotNull() & has_anchor, F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "))


def counterparty_names(counterparties: Column) -> Column:
    """Non-empty counterparty names joined; NULL when there are no counterparties."""
    names = F.filter(F.transform(counterparties, lambda c: c.getField("name")),
                     lambda n: n.isNotNull() & (n != ""))
    return F.when(F.coalesce(F.size(counterparties), F.lit(0)) > 0, F.array_join(names, ", "))


def share_of_max(value: Column, max_abs: Column, zero_floor: float = 2.0, floor: float = 8.0) -> Column:
    """Bar width in percent of the largest absolute value, with minimum widths, clamped 0-100."""
    v = F.coalesce(value, F.lit(0)).cast("double")
    pct = F.abs(v) / F.greatest(max_abs.cast("double"), F.lit(1.0)) * 100
    width = F.greatest(pct, F.when(v == 0, F.lit(zero_floor)).otherwise(F.lit(floor)))
    return F.least(F.greatest(width, F.lit(0.0)), F.lit(100.0))


def infer_environment(env: Column, token_prefix: Column) -> Column:
    """sandbox/production from the token prefix, only where the environment is blank."""
    inferred = (F.when(token_prefix.startswith("access-sandbox-"), F.lit("sandbox"))
                .when(token_prefix.startswith("access-production-"), F.lit("production")))
    return F.when(F.coalesce(env, F.lit("")) == "", F.coalesce(inferred, env)).otherwise(env)


def is_not_ready(error_code: Column, message: Column) -> Column:
    """the retryable product-not-ready state, from the code or the message text."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (F.coalesce(error_code, F.lit("")) == "PRODUCT_NOT_READY") | text.contains("product_not_ready") | \
        text.contains("not ready")


_UPPER = string.ascii_uppercase
_LOWER = string.ascii_lowercase


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as the reference's LIKE does (``é`` and ``É`` stay different)."""
    return F.translate(c, _UPPER, _LOWER)


def like_to_regex(needle: str) -> str:
    """Translate ``%needle%`` LIKE semantics into a Java regex (``%`` and ``_`` stay wildcards)."""
    out = ["(?s)"]
    for ch in needle.translate(str.maketrans(_UPPER, _LOWER)):
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch.isascii() and not ch.isalnum():
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def search_predicate(needle: str, *cols: Column) -> Column:
    """P10: ``needle`` anywhere in any of the columns, ASCII-case-insensitive; NULL columns never match."""
    pattern = like_to_regex(needle)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(ascii_lower(c).rlike(pattern), F.lit(False))
    return cond
