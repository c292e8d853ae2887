"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut to bins. The score is a sum of lookup tables, one for each feature and for some pairs of
features, learned by cyclic gradient boosting of shallow trees: round after round visits the features in turn,
fits a small tree to the gradients over one feature's bins and adds a fraction of it to that table.
Scoring adds one table entry for each feature and pair, for a whole batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, stored

#: Labelled rows the model is fitted on at most (a random sample of them).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
#: Weight of the second derivative's prior in a leaf, and rows a leaf needs.
RIDGE, LEAF_ROWS = 1.0, 20
#: Score from which a text counts as good.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "log_chars", "word_length", "distinct_words", "top_word", "short_words", "long_words", "capitals",
    "digits", "marks", "symbols", "exclaims", "spaces", "non_ascii", "entropy", "lines", "line_length", "repeated_lines",
    "repeated_pairs", "capital_words", "marked_words", "compression", "bullets")

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = np.isin(_ASCII, [9, 10, 11, 12, 13, 32])
_MARK = ~(_LETTER | _DIGIT | _SPACE) & (_ASCII >= 32)
_SYMBOL = np.isin(_ASCII, [ord(c) for c in "#*$%&|<>"])


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; a text without words has zeros."""
    data = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    letters = max(1, int(count[_LETTER].sum()))
    share = count[count > 0] / size
    common = Counter(words)
    lengths = np.fromiter(map(len, words), np.int32, n)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    lead = sum(w[0].isupper() for w in words)
    tail = sum(not w[-1].isalnum() for w in words)
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), len(common) / n, common.most_common(1)[0][1] / n,
        (lengths <= 3).mean(), (lengths >= 14).mean(), count[_UPPER].sum() / letters, count[_DIGIT].sum() / size,
        count[_MARK].sum() / size, count[_SYMBOL].sum() / n, count[33] / n, count[_SPACE].sum() / size,
        count[128:].sum() / size, float(-(share * np.log2(share)).sum()), np.log1p(len(lines)), n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, n - 1), lead / n, tail / n,
        len(zlib.compress(data, 1)) / size, sum(x.lstrip()[:1] in "-*|•" for x in lines) / max(1, len(lines))]


_ROW = T.ArrayType(T.FloatType(), False)


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features): one narrow row for each row of ``docs``, stored."""
    rows = pick(docs, key, text)
    schema = T.StructType([rows.schema[0], T.StructField("features", _ROW)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = np.array([features(t) for t in part.column(1).to_pylist()], np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(got)], names=schema.names)

    return stored(rows.mapInArrow(run, schema), "features")


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _leaves(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """A regression tree over ordered bins: the leaf value of each bin."""
    out = np.full(len(gradient), gradient.sum() / (hessian.sum() + RIDGE))
    if depth and len(gradient) > 1:
        g, h, n = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1], np.cumsum(rows)[:-1]
        gain = g * g / (h + RIDGE) + (gradient.sum() - g) ** 2 / (hessian.sum() - h + RIDGE)
        gain[(n < LEAF_ROWS) | (rows.sum() - n < LEAF_ROWS)] = -1
        k = int(gain.argmax())
        if gain[k] > gradient.sum() ** 2 / (hessian.sum() + RIDGE):
            for part in (slice(0, k + 1), slice(k + 1, None)):
                out[part] = _leaves(gradient[part], hessian[part], rows[part], depth - 1)
    return out


def _leaves_2d(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels over two features' bins: one cut of the first, then one of the second in each half."""
    best, found = -1.0, None
    for k in range(1, gradient.shape[0]):
        values, gain = np.empty_like(gradient), 0.0
        for part in (slice(0, k), slice(k, None)):
            g, h, n = gradient[part].sum(0), hessian[part].sum(0), rows[part].sum(0)
            leaves = _leaves(g, h, n, 1)
            values[part] = leaves
            gain += float((leaves * g - 0.5 * leaves ** 2 * (h + RIDGE / len(h))).sum())
        if gain > best:
            best, found = gain, values
    return (np.zeros_like(gradient), 0.0) if found is None else (found, best)


@dataclass
class Model:
    """Bin edges, and the tables by feature and by pair of features; ``score`` is a probability."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        used = {f for pair in self.pairs for f in pair}
        cut = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for f in used}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[cut[a], cut[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables from features and 0/1 labels; without two classes the score is their share (0.5 if none)."""
    width = len(FEATURES)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    edges, coarse = [_edges(x[:, f], BINS) for f in range(width)], [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(float(np.log(share / (1 - share))), edges, tables, coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    total = np.full(len(y), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * _leaves(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), rows[f], 2)
            tables[f] += step
            total += step[bins[f]]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    shape = [len(e) + 1 for e in coarse]

    def grid(a, b, values=None):
        return np.bincount(cells[a] * shape[b] + cells[b], values, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    gains = {(a, b): _leaves_2d(grid(a, b, g), grid(a, b, h), grid(a, b))[1] for a in range(width) for b in range(a + 1, width)}
    model.pairs = sorted(sorted(gains, key=gains.get, reverse=True)[:PAIRS])
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    counts = [grid(a, b) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _leaves_2d(grid(a, b, g), grid(a, b, h), counts[k])[0]
            model.pair_tables[k] += step
            total += step[cells[a], cells[b]]
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text is a multiple of 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
          rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of a feature table that are not held out, a random ``rows`` of them at most.

    Rows without a label, a key or features teach nothing; the sample is drawn by hashes of the keys, so reruns agree.
    """
    known = pick(labels, key, label).filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    joined = stored(table.join(known, key).select(key, "features", F.col(label).cast("int").alias("label")), "labelled")
    total = joined.count()
    share = min(1.0, 0.97 * rows / max(1, total))
    drawn = joined.filter(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = drawn.limit(rows).toPandas().sort_values([key, "label"], kind="stable")
    x = np.array(got["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["label"].to_numpy(np.float64))


def score_table(table: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of a feature table."""
    schema = T.StructType([table.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=schema.names)

    return table.select(key, "features").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: key, held_out, score (0 .. 1, higher: likelier good) and predicted.

    Only the text makes the score. NULL, empty and blank texts have all features zero and a score like any;
    repeated rows are scored each; a NULL key is never held out and never learned from; an empty table
    gives an empty result; other columns are ignored. Texts are read once; features are narrow.
    """
    table = feature_table(docs, key, text)
    scored = score_table(table, train(table, labels, key, label), key)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows the classifier rejects. No shuffle of texts: the model is
    fitted from the feature table, then a second pass scores and drops rows where they lie."""
    model = train(feature_table(docs, key, text), labels, key)
    names = docs.columns
    at = names.index(text)
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = np.array([features(t) for t in part.column(at).to_pylist()], np.float32).astype(np.float64)
                yield part.filter(pa.array(model.score(x) >= THRESHOLD))

    return rows.mapInArrow(run, rows.schema).toDF(*names)
