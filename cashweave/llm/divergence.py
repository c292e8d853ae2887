"""Source divergence audit: how differently the sources of a language use its words.

A ``CountVectorizer`` of Spark ML fits each language's vocabulary (terms in ``min_df`` of its documents, no other bound on
its size) and turns the terms of a source's documents into exact sparse vectors; sums of these vectors by (language,
source) are the groups' counts. Distances between the groups of a language are evaluated from non-zero counts only.
All probabilities are whole numbers of 10**9 shares, so nothing depends on the order of a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, scratch, stored

#: A term is a run of letters: A-Z, a-z and everything beyond ASCII. What each byte becomes in a term, 0 where it ends one.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
MIN_DF, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: The largest vocabSize there is: the vocabulary is never cut.
WHOLE = 2 ** 31 - 1
#: Terms whose vocabulary one pass holds on the driver and on each executor, about. Larger vocabularies are
#: fitted in several passes, each over the terms of one hash range; the union is the same vocabulary.
PASS_TERMS = 1_000_000
#: One in so many terms is counted beforehand to tell the number of passes.
LOOK = 64
#: Bytes of texts whose terms are counted together before they are vectors, about; a longer text is alone.
PIECE = 8_000_000
#: Sources whose distances to all others one accumulator holds.
BLOCK = 512


def _terms(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another (A-Z and nothing else in lower case) and the number of each text.

    Bytes are looked at: in UTF-8 those of 0x80 and beyond all belong to code points that are no separators.
    """
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    low = LETTERS[data]
    of_term = low != 0
    first, last = of_term.copy(), of_term.copy()
    first[1:] &= ~of_term[:-1]
    last[:-1] &= ~of_term[1:]
    filled = ends[1:] > ends[:-1]
    for edge, at in ((first, ends[:-1][filled]), (last, ends[1:][filled] - 1)):
        edge[at] = of_term[at]  # no term goes on into the next text
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    places = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last + 1 - first, out=places[1:])
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(low[of_term]))
    return terms, np.diff(np.searchsorted(first, ends))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def bags(rows: DataFrame) -> DataFrame:
    """(lang, source, terms, n, counted) of rows (lang, source, text): a row a document with its distinct terms, and, for each
    some PIECE bytes of texts, rows by (lang, source, n) with the terms that occur n times there.

    Each term stands behind its language and U+0000. ``terms`` has what document frequencies need, ``counted`` every
    occurrence, as a term and how often; the other columns are NULL.
    """
    schema = T.StructType.fromDDL("lang string, source string, terms array<string>, n long, counted array<string>")

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else None
            at = 0
            while at < len(texts):
                till = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
                yield from piece(*(batch.column(k).slice(at, till - at).cast(pa.string()).dictionary_encode() for k in (0, 1)), texts.slice(at, till - at))
                at = till

    def piece(langs, sources, texts):
        terms, sizes = _terms(texts)
        terms = terms.dictionary_encode()
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        count = max(1, len(terms.dictionary))
        keys = np.sort(np.repeat(np.arange(len(texts)), sizes) * count + terms.indices.to_numpy())
        first = _runs(keys)
        n, doc, term = np.diff(np.append(first, len(keys))), keys[first] // count, keys[first] % count
        pairs, named = np.unique(lang[doc] * count + term, return_inverse=True)
        names = pc.binary_join_element_wise(langs.dictionary.take(pa.array(pairs // count)),
                                            terms.dictionary.take(pa.array(pairs % count)).cast(pa.string()), "\0")
        bag = _lists(np.bincount(doc, minlength=len(texts)), names.take(pa.array(named)))
        yield rows_of(langs.dictionary_decode(), sources.dictionary_decode(), bag, None, None)

        keys = source[doc] * len(names) + named  # a name tells its language
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _runs(keys)
        if not len(first):
            return
        n, source, named = np.add.reduceat(n[order], first), keys[first] // len(names), keys[first] % len(names)
        lang = pairs[named] // count
        order = np.lexsort((n, source, lang))
        n, source, lang, named = (x[order] for x in (n, source, lang, named))
        first = np.union1d(np.union1d(_runs(n), _runs(source)), _runs(lang))
        bag = _lists(np.diff(np.append(first, len(n))), names.take(pa.array(named)))
        yield rows_of(langs.dictionary.take(pa.array(lang[first])), sources.dictionary.take(pa.array(source[first])), None, pa.array(n[first]), bag)

    def rows_of(lang, source, *others):
        types = (pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()))
        others = [pa.nulls(len(lang), t) if x is None else x for x, t in zip(others, types, strict=True)]
        return pa.RecordBatch.from_arrays([lang, source, *others], names=schema.names)

    return rows.select("lang", "source", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _spread(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), term), F.lit(n))


def _hashed(bag: Column, n: int, k: int) -> Column:
    """The terms of a bag in the k-th of n hash ranges."""
    return F.filter(bag, lambda t: _spread(t, n) == k)


def _passes(documents: DataFrame, min_df: int) -> int:
    """Passes that keep each vocabulary near PASS_TERMS: one in LOOK terms is counted, over all documents."""
    part = documents.select(F.explode("terms").alias("t")).filter(_spread(F.col("t"), LOOK) == 0)
    kept = part.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_df).count()
    return max(1, math.ceil(1.2 * kept * LOOK / PASS_TERMS))


def _sums(vectors: DataFrame) -> DataFrame:
    """(source, cell, n): sums of sparse vectors (source, n, indices, values), n times each, by source.

    A batch's non-zero cells are summed where they lie, as one sort of (source, cell) numbers; the partial sums are
    added up after a shuffle of narrow rows.
    """
    schema = T.StructType.fromDDL("source string, cell int, n long")

    def run(batches):
        for batch in batches:
            cells, values = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            if not len(cells):
                continue
            names = batch.column(0).dictionary_encode()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            owner = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            keys = owner << 32 | cells
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            values = values.astype(np.int64) * np.repeat(batch.column(1).to_numpy(), sizes)
            total = np.add.reduceat(values[order], first)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys[first] >> 32)), pa.array((keys[first] & 0xFFFFFFFF).astype(np.int32)),
                                              pa.array(total)], names=schema.names)

    return vectors.mapInArrow(run, schema).groupBy("source", "cell").agg(F.sum("n").alias("n"))


def group_counts(docs: DataFrame, min_df: int = MIN_DF, text: str = "text", lang: str = "lang",
                 source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, source, term, n) with n > 0 over kept terms, (lang, source) of every group that occurs, (lang, size) kept terms.

    A term is fitted together with its language, behind U+0000, which no term holds: one CountVectorizer so keeps the
    vocabulary of every language apart in one pass, with document frequencies by language: it is fitted on each
    document's distinct terms. It then turns the terms of a source that occur n times in a piece of the table into one
    vector, which counts n times: so a frequent term is looked up once a piece, not at each occurrence. The model's
    vocabulary is written as a table, the vectors' non-zero cells are summed by source with partial sums before
    the shuffle; no dense vector is ever made.
    """
    rows = pick(docs, lang, source, text).select(
        F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    both = stored(bags(rows), "divergence-bags")
    documents, counted = both.filter("terms IS NOT NULL"), both.filter("counted IS NOT NULL")
    groups = stored(documents.select("lang", "source").distinct(), "divergence-groups")
    passes, out, sizes = _passes(documents, min_df), None, None
    for k in range(passes):
        def part(c, k=k):
            return (F.col(c) if passes == 1 else _hashed(F.col(c), passes, k)).alias("bag")
        model = CountVectorizer(inputCol="bag", outputCol="vector", minDF=float(min_df), vocabSize=WHOLE).fit(documents.select(part("terms")))
        path = scratch(docs.sparkSession, "divergence-model")
        model.write().save(path)
        words = docs.sparkSession.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("cell", "word"))
        vectors = model.transform(counted.select("source", "n", part("counted"))).select("source", "n", F.unwrap_udt("vector").alias("v"))
        sums = _sums(vectors.select("source", "n", "v.indices", "v.values"))
        cut = F.length("word") - F.locate("\0", F.reverse("word")) + 1  # place of the last U+0000
        words = words.select("cell", F.substring("word", F.lit(1), cut - 1).alias("lang"),
                             F.substring("word", cut + 1, F.length("word")).alias("term"))
        got = stored(sums.join(words, "cell").select("lang", "source", "term", "n"), "divergence-counts")
        size = words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
        out, sizes = (got, size) if out is None else (out.unionByName(got), sizes.unionByName(size))
    return out, groups, sizes.groupBy("lang").agg(F.sum("size").alias("size"))


def _share(n, total, size) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * size)), exact in long integers up to 9 * 10**13 terms.

    The division goes in two steps with the remainder of the first; an overflow would fail, not round.
    """
    steps, rest = 100_000, SCALE // 100_000
    under, over = total + PRIOR * size, (n + PRIOR) * F.lit(steps).cast("long")
    return 1 + F.call_function("div", over, under) * rest + F.call_function("div", (over % under) * rest, under)


def _overlaps(terms_of: DataFrame) -> DataFrame:
    """(lang, a, b, value): what terms that both a and b (a < b) have add to the distance, over that of ``_one_sided``.

    ``terms_of`` has (lang, block, items) sorted by the first two in each partition, items = (source number, p, p
    of count 0). An accumulator of BLOCK x sources is kept for one (lang, block) and handed on as rows when the
    next begins, so rows out follow partitions and not terms.
    """
    schema = T.StructType.fromDDL("lang string, a int, b int, value long")

    def rows(lang, block, acc):
        a, b = np.nonzero(acc)
        good = a + block * BLOCK < b
        a, b = a[good], b[good]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array((a + block * BLOCK).astype(np.int32)),
                                           pa.array(b.astype(np.int32)), pa.array(acc[a, b])], names=schema.names)

    def run(batches):
        now, acc = None, None
        for batch in batches:
            for lang, block, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (lang, block) != now:
                    if now is not None:
                        yield rows(*now, acc)
                    now, acc = (lang, block), np.zeros((BLOCK, 1), np.int64)
                at, p, none = (items.values.field(k).to_numpy() for k in range(3))
                if acc.shape[1] <= at.max():
                    acc = np.pad(acc, ((0, 0), (0, 2 * int(at.max()) + 1 - acc.shape[1])))
                own = at // BLOCK == block
                a, a_p, a_none = (x[own][:, None] for x in (at % BLOCK, p, none))
                acc[a, at[None, :]] += abs(a_p - p) - abs(a_p - none) - abs(a_none - p) + abs(a_none - none)
        if now is not None:
            yield rows(*now, acc)

    return terms_of.mapInArrow(run, schema)


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources and the terms that mark a source.

    Part ``pair`` has every other source of the language with the sum of |p - q| over all kept terms, part ``term``
    the ``top`` terms a source uses more often than its language, by p - q. NULL text, lang and source
    count as ''; groups without terms have count 0 everywhere, and 0 distance where a language keeps no term;
    ties go by the item's bytes; repeated rows count each; very long texts count whole; an empty table gives an
    empty result; other columns are ignored. Windows run within a language's list of sources, and within a
    source's terms cut to ``top`` before the shuffle.
    """
    counts, groups, sizes = group_counts(docs, min_df, text, lang, source)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))

    def number(c):
        return F.coalesce(c, F.lit(0)).cast("long").alias(c)

    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(of_lang, "lang", "left").select(
        "lang", "source", number("size"), number("total"), number("lang_total"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"))
    known = stored(known.withColumn("none", F.when(F.col("size") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("size")))
                                    .otherwise(F.lit(0).cast("long"))), "divergence-sources")
    # One row a term, with the sources that have it: as many at most as the language has.
    cells = counts.join(known, ["lang", "source"]).select(
        "lang", "term", "n", "lang_total", "size", F.struct("at", _share(F.col("n"), F.col("total"), F.col("size")).alias("p"), "none").alias("item"))
    by_term = stored(cells.groupBy("lang", "term").agg(
        F.collect_list("item").alias("items"), F.sum("n").alias("lang_n"), F.max("lang_total").alias("lang_total"), F.max("size").alias("size")).select(
        "lang", "term", "items", _share(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q")), "divergence-terms")
    each = by_term.select("lang", "term", "q", F.explode("items").alias("i")).select("lang", "term", "q", "i.*")

    # Distance of a and b: every kept term once with neither, then what a's terms and b's terms change to that each
    # for itself, by how often each probability occurs, then what the terms of both change to the sum of the two.
    one = each.groupBy("lang", "at", "none", "p").agg(F.count(F.lit(1)).alias("k")).select(
        "lang", F.col("at").alias("x"), F.col("none").alias("x0"), "p", "k")
    other = known.select("lang", F.col("at").alias("y"), F.col("none").alias("y0"))
    alone = one.join(other, "lang").filter("x <> y").select(
        "lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        (F.col("k") * (F.abs(F.col("p") - F.col("y0")) - F.abs(F.col("x0") - F.col("y0")))).alias("value"))
    alone = alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    left = known.select("lang", F.col("at").alias("a"), F.col("none").alias("a0"), "size")
    neither = left.join(other.toDF("lang", "b", "b0"), "lang").filter("a < b").select(
        "lang", "a", "b", (F.col("size") * F.abs(F.col("a0") - F.col("b0"))).alias("value"))
    items = by_term.filter(F.size("items") > 1)
    blocks = F.array_distinct(F.transform("items", lambda x: F.floor(x["at"] / BLOCK).cast("int")))
    both = _overlaps(items.select("lang", F.explode(blocks).alias("block"), "items").sortWithinPartitions("lang", "block"))
    half = neither.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = known.select("lang", F.col("at").alias("a"), "source")
    pairs = pairs.join(named, ["lang", "a"]).join(named.toDF("lang", "b", "item"), ["lang", "b"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    marks = each.filter("p > q").join(named.toDF("lang", "at", "source"), ["lang", "at"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(marks)


#: The same in SQL, over the dense grid of terms and groups.
ORACLE_SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term)
      GROUP BY 1, 2, 3),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
      FROM grid JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY 1, 2) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks)) WHERE part = 'pair' OR rank <= 50
"""
