"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: a disjunction of
conjunctions that every match must satisfy. The index maps a trigram to the ids of the texts that
hold it, cut into blocks of bounded size; the postings of a conjunction are intersected, and only
the candidates are verified with the expression itself. A rule without mandatory trigrams scans
every text. Letters are folded to lower case in the index, so one index serves all rules of a scan; it holds
the trigrams that these rules ask for and no others, and is built for each scan.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashweave.llm.common import let, pick, stored

#: Ids that one posting block is expected to hold at most.
BLOCK_ROWS = 4_096
#: Strings that a piece of an expression may stand for before it is taken as unknown.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# Fixed patterns: the three kinds of the base, then public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # the maximal runs of 24 and more: the same matches as [0-9a-f]+
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%+-]{1,64}:[A-Za-z0-9._~%+!*-]{3,64}@"),
)


def _exact(node) -> set[str] | None:
    """The lower-cased strings a parsed node can match, or None where they are too many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out = set()
        for kind, value in arg:
            if kind is C.LITERAL and value < 128:
                out.add(chr(value).lower())
            elif kind is C.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_all(b) for b in arg[1]]
        return None if None in parts or sum(map(len, parts)) > EXACT else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 8:
        one = _exact_all(arg[2])
        if one is None:
            return None
        out = set()
        for k in range(arg[0], arg[1] + 1):
            if len(one) ** k > EXACT:
                return None
            out |= {"".join(x) for x in product(one, repeat=k)}
        return out if len(out) <= EXACT else None
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > EXACT:
            return None
        out = {a + b for a in out for b in one}
    return out


def _least(options: set[frozenset]) -> set[frozenset]:
    """A disjunction without conjunctions that another one implies."""
    return {o for o in options if not any(x < o for x in options)}


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    out = _least({x | y for x in a for y in b})
    return out if len(out) <= EXACT else min(a, b, key=len)  # one of two conditions is a weaker one


def _of_strings(strings: set[str]) -> set[frozenset]:
    return _least({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _query(nodes) -> set[frozenset]:
    found, current = {frozenset()}, {""}
    for node in nodes:
        one = _exact(node)
        if one is not None and len(current) * len(one) <= EXACT:
            current = {a + b for a in current for b in one}
            continue
        found, current, (op, arg) = _both(found, _of_strings(current)), {""}, node
        if one is not None:
            current = one
        elif op is C.SUBPATTERN:
            found = _both(found, _query(arg[-1]))
        elif op is C.BRANCH:
            found = _both(found, _least(set().union(*(_query(b) for b in arg[1]))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found = _both(found, _query(arg[2]))
    return _both(found, _of_strings(current))


def trigram_query(pattern: str) -> list[list[str]]:
    """Conjunctions of trigrams of which every match holds one; [] if a match may hold none."""
    options = _query(list(P.parse(pattern)))
    return [] if frozenset() in options else sorted(sorted(o) for o in options)


def build_index(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Postings (block, gram, ids) of the given trigrams, stored. A block holds the ids of one range of the
    ids' hashes, about ``block_rows``, so no posting list grows with the table."""
    rows = pick(docs, key, text)
    blocks = max(1, -(-rows.count() // block_rows))
    low = F.lower(text)
    held = let(low, lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    found = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.struct(key).alias("id"),
                        F.explode(held).alias("gram"))
    return stored(found.groupBy("block", "gram").agg(F.collect_set("id").alias("ids")), "trigrams")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]], key: str) -> DataFrame:
    """(key, kinds): the rules whose trigram query a text satisfies."""
    none = F.array().cast(index.schema["ids"].dataType)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("m"))

    def matching(options):
        return reduce(F.array_union, [reduce(F.array_intersect, [
            F.coalesce(F.col("m")[g], none) for g in grams]) for grams in options])

    def labelled(kind, options):
        return F.transform(matching(options), lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))

    each = [labelled(kind, options) for kind, options in queries.items()]
    hits = lists.select(F.explode(F.concat(*each)).alias("x"))
    return hits.groupBy(F.col(f"x.id.{key}").alias(key)).agg(F.collect_set("x.kind").alias("kinds"))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int>>")


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches in code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the offsets.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.zip_with(pieces, matches, lambda p, m: F.struct(
        F.length(p).alias("p"), F.length(m).alias("m"))), groups,
        lambda x, g: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.length(g).alias("g")))

    def step(acc, x):
        start = acc["at"] + x["p"]
        end = start + x["m"]
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(
            x["g"] >= rule.least, F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end")))))
            .otherwise(acc["found"]).alias("found")))

    got = F.aggregate(rows, F.struct(F.lit(0).alias("at"), no_spans().alias("found")), step)["found"]
    return F.when(text.rlike(rule.pattern), got).otherwise(no_spans())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row for each row of ``docs``: key and ``found``, an array of (start, no, end, kind) sorted by start, then
    by the rules' order ``no``; offsets in code points, end exclusive.

    NULL text is empty and holds nothing. Rows with equal keys share their postings and are verified each;
    a NULL key is a key like any other. An empty table gives an empty result; other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    rows = pick(docs, key, text).withColumn(text, F.coalesce(text, F.lit("")))
    if indexed:
        grams = sorted({g for q in indexed.values() for o in q for g in o})
        hits = candidates(build_index(rows, grams, key, text), indexed, key).withColumnRenamed(key, "_key")
        rows = rows.join(hits, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, text, "kinds")

    def verified(no, rule):
        got = spans(F.col(text), rule)
        if rule.kind in indexed:
            got = F.when(F.array_contains("kinds", rule.kind), got).otherwise(no_spans())
        return F.transform(got, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"),
                                                   F.lit(rule.kind).alias("kind")))

    found = [verified(no, rule) for no, rule in enumerate(rules)]
    return rows.select(key, F.sort_array(F.concat(*found)).alias("found"))


def digest(found: DataFrame, key: str = "doc_id", rules=RULES) -> DataFrame:
    """Counts, joined spans and the digest of the base spans of :func:`scan`'s rows."""
    base = [r.kind for r in rules if r.base]

    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    own = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select(key, *counts, F.sha2(joined(own), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same result in DuckDB: every rule scans every text; pieces between matches give the offsets."""
    parts = []
    for no, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {no} AS no, '{r.kind}' AS kind, s AS start, e AS stop FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x:
             length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s,
           unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x:
             length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))) AS e,
           unnest(list_transform(g, lambda x: length(x))) AS n
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g,
                 string_split_regex(t, '{p}') AS p
          FROM d WHERE regexp_matches(t, '{p}'))) WHERE n >= {r.least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
             count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, no, stop)
               FILTER (no < 3) AS base,
             string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, no, stop) AS every
      FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


ORACLE_SQL = _oracle()
