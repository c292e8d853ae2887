"""Language identification by hierarchical discrimination.

A text is the square root of its relative frequencies of hashed letter n-grams (one to four letters, word ends
included). The first level is one linear support vector machine for each language family against the
rest; within the family found, one machine for each pair of its languages, and the language that wins
most of its pairs is the answer. So closely related languages are told apart by weights that were learned
on these two alone. The machines are fitted on the executors, each in its own group, from a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, stored

#: Texts the model is fitted on: at most this many, or LEAST_ROWS for each language where that is more.
TRAIN_ROWS, LEAST_ROWS = 6_000, 100
#: Words of the excerpts that each text of the sample also teaches as texts of their own, so that short texts are known.
EXCERPTS = (3, 12)
#: n-grams are hashed to 2 ** BITS features.
BITS, LONGEST = 13, 4
#: Epochs and cost of the solver; slope that turns a margin into a probability.
EPOCHS, COST, SLOPE = 12, 10.0, 4.0
#: Label of texts without a letter.
UNKNOWN = "und"
#: Texts and letters handled at once; a longer text is handled alone.
ROWS, LETTERS = 64, 1 << 18

# Language families by ISO 639-1 code. A language in none of them is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "sinitic": "zh yue wuu",
    "austronesian": "id jv mg mi ms sm su tl to",
    "bantu": "rw sn st sw xh zu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_D = 1 << BITS
_KEYS = np.random.default_rng(20240611).integers(0, 1 << 63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower: list[np.ndarray] = []


def family(lang: str) -> str:
    """The family of a language tag, told by its first part; the tag itself where none is known."""
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), lang)


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what is no letter."""
    if not _lower:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower.append(table)
    return _lower[0]


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of whole texts, one row of 2 ** BITS numbers each; a text without letters has zeros.

    Runs of other characters count as one word end. n-grams hold no word end but at their ends.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = "\0" + "\0\0".join(texts) + "\0"
    low = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = low != 0
    keep[1:] |= (low[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[0] = True
    low, owner = low[keep].astype(np.uint64), owner[keep]
    out = np.zeros(len(texts) * _D, np.int64)
    for n in range(1, LONGEST + 1):
        size = len(low) - n + 1
        if size <= 0:
            break
        value, good = np.full(size, _KEYS[LONGEST] ^ np.uint64(n)), owner[:size] == owner[n - 1:]
        for k in range(n):
            part = low[k:size + k]
            value += part * _KEYS[k]
            if n == 1 or 0 < k < n - 1:
                good &= part != 0
        if n == 2:
            good &= (low[:size] != 0) | (low[1:] != 0)
        value = (value ^ (value >> np.uint64(31))) * _KEYS[0] >> np.uint64(64 - BITS)
        out += np.bincount(owner[:size][good] * _D + value[good].astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), _D)


def vectors(texts: list[str | None]):
    """Yield (first, rows of unit length) for runs of texts of bounded size; a text without letters is all zeros."""
    at = 0
    while at < len(texts):
        end, letters = at, 0
        while end < len(texts) and end - at < ROWS and (end == at or letters + len(texts[end] or "") <= LETTERS):
            letters += len(texts[end] or "")
            end += 1
        got = counts([t or "" for t in texts[at:end]]).astype(np.float32)
        yield at, np.sqrt(got / np.maximum(got.sum(1, keepdims=True), 1))
        at = end


def _examples(text: str | None) -> list[str]:
    """A text of the sample and its excerpts, which start at places drawn from its length."""
    words = (text or "").split()
    return [text or ""] + [" ".join(words[at:at + n]) for n in EXCERPTS if len(words) > n
                           for at in [(len(text) * 2654435761 >> 7) % (len(words) - n)]]


def sample(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(lang, cells, values): sparse vectors of the texts to learn from, the same at each run.

    Languages share the sample evenly. Rows are drawn by hashes of key and text and then ranked by them, at most the
    language's share; ranks are cut before the shuffle, so that no task meets all rows of a language.
    """
    rows = pick(docs, key, lang, text).toDF("key", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(LEAST_ROWS, TRAIN_ROWS // max(1, len(per_lang)))
    drawn = rows.withColumn("_h", F.xxhash64(F.lit(11), "key", "text"))
    chances = sorted((c, n) for c, n in per_lang.items() if n > share)
    if chances:
        bound = F.create_map(*[F.lit(x) for c, n in chances for x in (c, 1.5 * share / n)])
        chance = F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit(1.0))
        drawn = drawn.filter(F.pmod("_h", F.lit(1 << 30)) < chance * (1 << 30))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "key"))).filter(
        F.col("_r") <= share).select("lang", "text")
    schema = T.StructType.fromDDL("lang string, cells array<int>, values array<float>")

    def run(batches):
        for batch in batches:
            labels, texts = [], []
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _examples(whole)
                labels += [name] * len(own)
                texts += own
            for at, part in vectors(texts):
                found = [np.flatnonzero(x) for x in part]
                some = [i for i, f in enumerate(found) if len(f)]
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([labels[at + i] for i in some], pa.string()),
                         pa.array([found[i].astype(np.int32) for i in some], pa.list_(pa.int32())),
                         pa.array([part[i][found[i]] for i in some], pa.list_(pa.float32()))], names=schema.names)

    return stored(ranked.mapInArrow(run, schema), "language-sample")


def machine(cells: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights and, last, the offset of a linear machine (squared hinge loss, dual coordinate descent); classes weigh alike."""
    weights, alpha = np.zeros(_D + 1), np.zeros(len(y))
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    ridge = 1 / (2 * COST * len(y) / (2 * share))
    rnd = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rnd.permutation(len(y)).tolist():
            c, v = cells[i], values[i]
            slope = y[i] * (weights[c] @ v + weights[_D]) - 1 + ridge[i] * alpha[i]
            new = max(alpha[i] - slope / (2 + ridge[i]), 0.0)  # vectors have length 1, the offset adds 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[c] += step * v
                weights[_D] += step
                alpha[i] = new
    return weights.astype(np.float32)


@dataclass
class Model:
    """Languages by family, and the machines: a column for each family, then one for each pair within a family."""

    families: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, first and second language in it
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of rows of :func:`vectors`; a row of zeros is UNKNOWN with score 0."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        n = len(self.families)
        chance = 1 / (1 + np.exp(-SLOPE * (x @ self.weights[:_D] + self.weights[_D]).astype(np.float64)))
        first = chance[:, :n] / chance[:, :n].sum(1, keepdims=True) if n > 1 else np.ones((len(x), 1))
        chosen = first.argmax(1)
        wins = [np.zeros((len(x), len(langs))) for langs in self.families]
        votes = [np.zeros((len(x), len(langs)), int) for langs in self.families]
        for k, (f, a, b) in enumerate(self.pairs):
            p = chance[:, n + k]
            wins[f][:, a] += p
            wins[f][:, b] += 1 - p
            votes[f][:, a] += p >= 0.5
            votes[f][:, b] += p < 0.5
        names, scores = [], np.zeros(len(x))
        for i, f in enumerate(chosen.tolist()):
            if not x[i].any():
                names.append(UNKNOWN)
                continue
            langs, own = self.families[f], wins[f][i]
            best = int(np.lexsort((-own, -votes[f][i]))[0]) if len(langs) > 1 else 0
            names.append(langs[best])
            scores[i] = first[i, f] * (own[best] / own.sum() if len(langs) > 1 else 1.0)
        return names, scores


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit the machines from the texts and languages of rows that are not held out.

    Each machine is a group of its own on the executors: rows go to every machine they teach, the bounded sample
    bounds the group. The driver gets the weights alone.
    """
    rows = sample(docs, key, text, lang)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    names = sorted({family(c) for c in langs})
    families = [[c for c in langs if family(c) == name] for name in names]
    pairs = [(f, a, b) for f, own in enumerate(families) for a, b in combinations(range(len(own)), 2)]
    tasks = [(k, c, 1 if c in own else -1) for k, own in enumerate(families) for c in langs if len(names) > 1]
    tasks += [(len(names) + k, families[f][i], 1 if i == a else -1) for k, (f, a, b) in enumerate(pairs) for i in (a, b)]
    weights = np.zeros((_D + 1, len(names) + len(pairs)), np.float32)
    if tasks:
        plan = docs.sparkSession.createDataFrame(tasks, "task int, lang string, side int")

        def fit(part):
            part = part.sort_values("side", kind="stable")
            found = machine(part["cells"].tolist(), part["values"].tolist(), part["side"].to_numpy())
            return type(part)({"task": part["task"].iloc[:1].to_numpy(), "weights": [found]})

        for r in rows.join(F.broadcast(plan), "lang").groupBy("task").applyInPandas(
                fit, "task int, weights array<float>").toLocalIterator():
            weights[:, r["task"]] = r["weights"]
    return Model(families, pairs, weights)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from the whole text and nothing else."""
    rows = pick(docs, key, text)
    schema = T.StructType([rows.schema[0], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                names, scores = [], []
                for _, x in vectors(part.column(1).to_pylist()):
                    got = model.predict(x)
                    names += got[0]
                    scores.append(got[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()),
                                                  pa.array(np.concatenate(scores))], names=schema.names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: key, held_out, lang_pred and score (0 to 1, higher: surer).

    Only the text makes a prediction. NULL, empty and letterless texts are ``und`` with score 0, and so is every text
    where nothing could be learned; with one known language all texts with letters are that, score 1.
    Equal texts get equal answers; very long texts count whole, alone in their batch; ties go to the
    language that sorts first; a NULL key is never held out and never learned from; an empty table gives an
    empty result; other columns are ignored.
    """
    found = identify(docs, train(docs, key, text, lang), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
