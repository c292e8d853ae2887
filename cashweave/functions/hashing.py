"""Canonical JSON, content hashes and identity keys as JVM-side Column expressions.

Canonical form of a typed payload: struct fields sorted by name at every depth, compact
separators, NULL fields kept as ``null``, ``-0.0`` folded to ``0.0``, decimals as doubles,
dates as ISO text. ``to_json`` then prints it without leaving whole-stage codegen. Doubles that the JVM spells
with an exponent take the spelling of Python's ``repr`` (``1e+20``, ``1e-05``, ``123456789012345680.0``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _canonical_type(f.dataType), True)
                             for f in sorted(dtype.fields, key=lambda f: f.name)])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_canonical_type(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(T.StringType(), _canonical_type(dtype.valueType), True)
    if isinstance(dtype, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.StringType()
    return dtype


def canonical_value(c: Column, dtype: T.DataType) -> Column:
    """Rebuild ``c`` (of type ``dtype``) in canonical shape."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[canonical_value(c.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNull(), F.lit(None).cast(_canonical_type(dtype))).otherwise(rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: canonical_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(
            e.getField("key").cast("string").alias("key"),
            canonical_value(e.getField("value"), dtype.valueType).alias("value"))))
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        return F.when(d == 0, F.lit(0.0)).otherwise(d)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(c.cast("string"), " ", "T")
    return c


def _has_double(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_double(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_double(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_double(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType))


def _spelt_apart(c: Column, dtype: T.DataType) -> Column:
    """Does ``c`` hold a double outside the range in which the JVM and Python spell doubles alike?"""
    if isinstance(dtype, T.StructType):
        found = F.lit(False)
        for f in dtype.fields:
            if _has_double(f.dataType):
                found = found | _spelt_apart(c.getField(f.name), f.dataType)
    elif isinstance(dtype, T.ArrayType):
        found = F.exists(c, lambda x: _spelt_apart(x, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        found = F.exists(F.map_values(c), lambda x: _spelt_apart(x, dtype.valueType))
    else:
        size = F.abs(c.cast("double"))
        found = (size != 0) & ~((size >= 1e-3) & (size < 1e7))
    return F.coalesce(found, F.lit(False))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: expressions that name it often stay small."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shorter(parts: Column) -> Column:
    """One digit less where that reads back as the same number; ``parts`` has ``size``, ``digits`` and ``power``."""
    size, digits, power = (parts.getField(n) for n in ("size", "digits", "power"))
    down = F.substring(digits, F.lit(1), F.length(digits) - 1).cast("decimal(20,0)")
    # Digits behind the point and a lower power instead of a point: also right where a carry adds a digit.
    reads = lambda d: F.concat(d.cast("string"), F.lit("E"), (
        power - F.length(digits) + 2).cast("string")).cast("double") == size
    up_first = F.substring(digits, -1, 1) >= "5"
    grown = F.length((down + 1).cast("string")) - F.length(down.cast("string"))
    up = F.struct(size, (down + 1).cast("string").alias("digits"), (power + grown).alias("power"))
    return F.when(F.length(digits) < 2, parts).when(up_first & reads(down + 1), up) \
        .when(reads(down), F.struct(size, down.cast("string").alias("digits"), power)).when(reads(down + 1), up).otherwise(parts)


def _spelt(parts: Column) -> Column:
    """Fixed from 1e-4 up to 1e16, otherwise with a signed exponent of two digits or more."""
    power = parts.getField("power")
    digits = F.regexp_replace(parts.getField("digits"), "(?<=.)0+$", "")
    rest = F.substring(digits, 2, 40)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."),
                     F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.lit(40))).otherwise(F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
                    F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs(power)))
    return F.when((power >= 0) & (power < 16), whole).when((power < 0) & (power >= -4), small).otherwise(wide)


def double_text(c: Column) -> Column:
    """A double as Python's ``repr`` spells it: the shortest digits that read back as the same number. The JVM
    prints up to two digits more than that takes."""
    def spell(text: Column) -> Column:
        parts = F.struct(F.abs(c).alias("size"), F.translate(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), ".", "")
                         .alias("digits"), F.substring_index(text, "E", -1).cast("int").alias("power"))
        return F.when(~text.contains("E"), text).otherwise(
            _with(parts, lambda p: _with(_shorter(p), lambda q: _with(_shorter(q), _spelt))))

    return F.when(c == 0, F.lit("0.0")).otherwise(
        F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), _with(F.abs(c).cast("string"), spell)))


def _text(c: Column, dtype: T.DataType) -> Column:
    """JSON text of ``c`` piece by piece, so that each double is spelt by :func:`double_text`."""
    if isinstance(dtype, T.StructType):
        fields, pieces, run = sorted(dtype.fields, key=lambda f: f.name), [], []

        def close():
            if run:  # neighbours without a double are printed together
                piece = F.to_json(F.struct(*[canonical_value(c.getField(f.name), f.dataType).alias(f.name) for f in run]),
                                  {"ignoreNullFields": "false"})
                pieces.append(F.substring(piece, F.lit(2), F.length(piece) - 2))
                run.clear()

        for f in fields:
            if _has_double(f.dataType):
                close()
                name = json.dumps(f.name, ensure_ascii=False)
                pieces.append(F.concat(F.lit(f"{name}:"), _text(c.getField(f.name), f.dataType)))
            else:
                run.append(f)
        close()
        out = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, dtype.elementType)), ","), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            e.getField("key").cast("string").alias("key"), _text(e.getField("value"), dtype.valueType).alias("value"))))
        key = lambda e: F.to_json(F.array(e.getField("key")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(
            F.substring(key(e), F.lit(2), F.length(key(e)) - 2), F.lit(":"), e.getField("value"))), ","), F.lit("}"))
    else:
        out = double_text(c.cast("double"))
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def canonical_json(c: Column, dtype: T.DataType) -> Column:
    """canonical JSON text of a typed value; NULL input gives the text ``null``."""
    text = F.coalesce(F.to_json(canonical_value(c, dtype), {"ignoreNullFields": "false"}), F.lit("null"))
    if not _has_double(dtype):
        return text
    return F.when(_spelt_apart(c, dtype), _text(c, dtype)).otherwise(text)


def payload_hash(canonical_text: Column) -> Column:
    """SHA-256 hex of the canonical text."""
    return F.sha2(canonical_text, 256)


def sha256_parts(*parts: Column) -> Column:
    """SHA-256 over ``|``-joined parts, NULL parts as empty text.

    ``concat_ws`` would silently skip NULLs, so every part is coalesced first.
    """
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def event_identity(item_id: Column, transaction_id: Column, event_class: Column, digest: Column,
                   supersedes_seq: Column) -> Column:
    """unique key of one ledger row; the supersedes link keeps reverts distinct."""
    return sha256_parts(F.coalesce(item_id, F.lit("")), transaction_id, event_class, digest,
                        F.coalesce(supersedes_seq, F.lit(0).cast("long")))


def observation_identity(item_id: Column, account_id: Column, digest: Column, kind: str = "observation") -> Column:
    """identity of an account observation (``observation`` or ``legacy_import``)."""
    return sha256_parts(item_id, account_id, digest, F.lit(kind))


def ledger_hash(prev_hash: Column, identity: Column, digest: Column, inserted_at: Column) -> Column:
    """one link of the tamper-evidence chain."""
    return sha256_parts(F.coalesce(prev_hash, F.lit("")), identity, digest, inserted_at)


def fingerprint(c: Column, length: int = 16) -> Column:
    """short non-reversible fingerprint; NULL or empty input gives NULL."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")) \
        .otherwise(F.substring(F.sha2(c, 256), 1, length))
