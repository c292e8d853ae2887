"""Token-id store: concatenated id arrays with Elias-Fano document boundaries.

A store is a folder of shards, one per range of document ids. A shard has two files:

* ``<name>.ids``: all ids of its documents in ascending document order, little-endian, 2 bytes
  each where every id of the vocabulary fits, else 4;
* ``<name>.ef``: the documents' end offsets as an Elias-Fano sequence with select samples, and
  the documents' own ids. n boundaries up to u take about n * (2 + log2(u / n)) bits.

``manifest`` (Parquet, one row a shard) names the files that count. A task writes under a name
of its own, so a lost or repeated attempt leaves a file that no manifest row names.
"""

from __future__ import annotations

import functools
import json
import math
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm import wordvec
from cashweave.llm.common import Cache, pick, read_all, read_ranges, write_once

MAGIC = b"EFTOK001"
#: Every so many ones of the high bits have their position stored.
SAMPLE = 128
#: Slots of a Python worker's word table (a power of 2), and cached parts of words (a generation).
TABLE_BITS, CACHED_PARTS = 21, 400_000
#: Parts handed to the tokenizer as one text.
TOGETHER = 500
#: Longer words are not cached.
CACHE_LENGTH = 64
# Starts the strings of the special tokens.
SPECIAL = b"<|"
#: Bytes of ids read at once.
READ_BYTES = 8 << 20
# ASCII marks that always stand apart from letters before them (no apostrophe: 's and the like).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

MANIFEST = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("width", T.IntegerType())])


class EliasFano:
    """A non-decreasing sequence of integers below 2^63 in near-minimal space.

    The low ``bits`` bits of each value are packed side by side; the high parts are a unary
    bitmap: value i sets bit ``high(i) + i``. ``select(i)`` walks from the nearest sample.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(math.floor(math.log2(top / n)))) if n and top >= n else 0
        low = values & np.uint64((1 << bits) - 1)
        spread = ((low[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones.astype(np.int64)] = 1
        return cls(n, bits, np.packbits(spread.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"),
                   ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        for b in range(self.bits):
            p = at + b
            out |= ((self.low[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values start .. stop-1; reads the high bits from the sample before ``start`` on."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        k = start // SAMPLE
        bit = int(self.samples[k])
        last = stop // SAMPLE + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.high) * 8
        flags = np.unpackbits(self.high[bit >> 3:(end + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(flags[bit & 7:])[start - k * SAMPLE:stop - k * SAMPLE] + bit
        i = np.arange(start, stop)
        return ((ones - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<QBQQQ", self.n, self.bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def load(cls, f) -> EliasFano:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a boundary file")
        n, bits, low, high, samples = struct.unpack("<QBQQQ", f.read(33))
        return cls(n, bits, np.frombuffer(f.read(low), np.uint8), np.frombuffer(f.read(high), np.uint8),
                   np.frombuffer(f.read(8 * samples), "<u8"))


class WordTable:
    """Ids of words by the words' 64-bit hashes: an open-addressing table probed for whole batches."""

    def __init__(self, kind: np.dtype, bits: int = TABLE_BITS):
        self.mask, self.limit = np.uint64((1 << bits) - 1), int(0.6 * (1 << bits))
        self.keys = np.zeros(1 << bits, np.uint64)
        self.start, self.count = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 20, kind), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at = hashes & self.mask
        while len(todo):
            key = self.keys[at]
            hit = key == hashes[todo]
            out[todo[hit]] = at[hit]
            go = ~hit & (key != 0)
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Store new, distinct hashes. A table that is full starts anew, larger if a batch asks for it."""
        if len(hashes) > self.limit:
            self.__init__(self.pool.dtype, max(1, (2 * len(hashes)).bit_length()))
        if self.words + len(hashes) > self.limit:
            self.keys[:] = 0
            self.used = self.words = 0
        data = np.frombuffer(b"".join(ids), self.pool.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.pool.dtype.itemsize
        while self.used + len(data) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(data)] = data
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.words = self.used + len(data), self.words + len(hashes)
        todo, at = np.arange(len(hashes)), hashes & self.mask
        while len(todo):
            slots, first = np.unique(at, return_index=True)
            first = first[self.keys[slots] == 0]
            self.keys[at[first]] = hashes[todo[first]]
            self.start[at[first]], self.count[at[first]] = starts[todo[first]], sizes[todo[first]]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + np.uint64(1)) & self.mask


# How a tokenizer must normalise and cut texts for its words to be encoded apart.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}


def word_wise(spec: dict) -> bool:
    """May words be encoded apart? Told from a tokenizer's file: its steps, word ends, and added tokens that begin as SPECIAL."""
    model = spec["model"]
    return (all(spec.get(k) == v for k, v in WORD_STEPS.items()) and model.get("type") == "BPE" and not model.get("dropout")
            and model.get("end_of_word_suffix") == "</w>" and spec.get("truncation") is None and all(
                t["content"].encode().startswith(SPECIAL) and not t["normalized"] and not t["lstrip"] for t in spec["added_tokens"]))


class WordEncoder:
    """Ids of whole texts, by words for a tokenizer that drops white space between its pre-tokens (:func:`word_wise`).

    Any other tokenizer gets whole texts. The normaliser of a word-wise one
    and its pre-tokenizer never look across white space and fold case, so a text's ids are those of its words side by side; the tokenizers library sees each distinct word once, and a table by word hashes
    gives the ids of a whole batch. A word of letters and trailing marks is two pre-tokens, which are looked
    up apart. Texts that may hold the string of a special token go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = word_wise(json.loads(self.tokenizer.to_str()))
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.table, self.parts = WordTable(self.type), Cache(CACHED_PARTS)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: one pre-token each, so many go through the tokenizer as one text."""
        out = []
        for at in range(0, len(words), TOGETHER):
            part = words[at:at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.type)
            raw, size = ids.tobytes(), self.type.itemsize
            cuts = [0, *((np.flatnonzero(self.closes[ids]) + 1) * size).tolist()]
            if len(cuts) == len(part) + 1:
                out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                out += self.mixed(part)
        return out

    def mixed(self, words: list[str]) -> list[bytes]:
        return [np.array(got.ids, self.type).tobytes()
                for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words. A word of letters and marks after them is cut where its pre-tokens are."""
        cuts, letters, other = [], set(), set()
        for w in words:
            core = w.rstrip(MARKS)
            if core and core.isalpha() and max(core) < "\u0250" and core[-1] != "\u0130":
                letters.add(core)
                tail = w[len(core):]
                if tail:
                    other.add(tail)
            else:
                core, tail = w, ""
                other.add(w)
            cuts.append((core, tail))
        parts = self.parts
        new = parts.lacking(letters | other)
        for group, how in ((list(new & letters), self.plain), (list(new - letters), self.mixed)):
            parts.young.update(zip(group, how(group), strict=True))
        got = parts.young
        out = [got[core] + got[tail] if tail else got[core] for core, tail in cuts]
        parts.drop([p for p in new if len(p) > CACHE_LENGTH])
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, each with ``end_id`` after it, ids of each text)."""
        whole = not self.by_words
        if not whole:
            hashes, counts, data, start, end = wordvec.located(texts)
            whole = SPECIAL in data.tobytes()
        if whole:
            found = [np.array([*self.tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], self.type)
                     for t in texts.to_pylist()]
            return np.concatenate(found), np.array(list(map(len, found)))
        table = self.table
        slots = table.find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if table.words + len(missing) > table.limit:  # all of the batch's words must be in it at once
                missing = np.arange(len(hashes))
                table.keys[:] = 0
                table.used = table.words = 0
            new, first = np.unique(hashes[missing], return_index=True)
            raw = data.tobytes()
            words = [raw[a:b + 1].decode() for a, b in zip(start[missing[first]].tolist(), end[missing[first]].tolist(),
                                                           strict=True)]
            table.add(new, self.learn(words))
            slots[missing] = table.find(hashes[missing])
        sizes, firsts = table.count[slots].astype(np.int64), table.start[slots]
        before = np.concatenate([[0], np.cumsum(sizes)])
        cuts = before[np.concatenate([[0], np.cumsum(counts)])]
        ids = table.pool[np.repeat(firsts - before[:-1], sizes) + np.arange(before[-1])]
        return np.insert(ids, cuts[1:], end_id), np.diff(cuts) + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Encode every whole text and write the store at ``path``; returns the stored manifest.

    ``end_id`` ends each document. Documents lie in ascending order of ``key`` (an integer), NULL
    first, rows with equal keys by text. Very long texts are encoded whole, alone in their piece. NULL and empty texts have the end id alone. An
    empty table writes a manifest without rows. Other columns are ignored. One range shuffle of the
    texts; ids never cross the network.
    """
    spark = docs.sparkSession
    rows = pick(docs, key, text).select(F.col(key).cast("long").alias(key), text)
    rows = rows.repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(
        F.col(key).asc_nulls_first(), F.xxhash64(text), text)

    def run(batches):
        own, name = encoder(tokenizer), f"shard-{uuid.uuid4().hex}"
        ends, keys, total, out = [], [], 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                out = write_once(path, f"{name}.ids")
            for at, n in wordvec.pieces(batch.column(1)):
                ids, sizes = own.encode(batch.column(1).slice(at, n), end_id)
                out.write(ids.tobytes())
                keys.append(batch.column(0).slice(at, n))
                ends.append(total + np.cumsum(sizes))
                total += len(ids)
        if out is None:
            return
        out.close()
        found = pa.chunked_array(keys)
        with write_once(path, f"{name}.ef") as f:
            f.write(EliasFano.of(np.concatenate(ends)).dump())
            f.write(np.packbits(found.is_valid().to_numpy(), bitorder="little").tobytes())
            f.write(found.fill_null(0).to_numpy().astype("<i8").tobytes())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(found), "n_tokens": total,
                                           "width": own.type.itemsize}], pa.schema([
            ("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
            ("width", pa.int32())]))

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard, with ``start``: the ids of all shards before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # One row for each shard of many megabytes of ids: a running sum over shards, not documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Documents of a store: key, start (ids before it in the whole store), n_tokens, ids_crc32 (of the ids
    as 4-byte little-endian integers) and, if asked for, the ids themselves (binary, such integers)."""
    manifest = read_manifest(spark, path)
    shards = max(1, manifest.count())
    fields = [T.StructField(key, T.LongType()), T.StructField("start", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * ids)

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                f = read_all(f"{path}/{shard['name']}.ef")
                bounds, n = EliasFano.load(f), shard["n_docs"]
                valid = np.unpackbits(np.frombuffer(f.read((n + 7) // 8), np.uint8), bitorder="little")[:n]
                keys = np.frombuffer(f.read(8 * n), "<i8")
                width, step, i, at = shard["width"], 4096, 0, 0
                while i < n:
                    ends = bounds.select(i, min(n, i + step)).astype(np.int64)
                    take = max(1, int(np.searchsorted(ends, at + READ_BYTES // width, "right")))
                    ends = ends[:take]
                    (raw,) = read_ranges(f"{path}/{shard['name']}.ids",
                                         [(at * width, (int(ends[-1]) - at) * width)])
                    own = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    cuts = np.concatenate([[0], ends - at])
                    parts = [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = [pa.array(keys[i:i + take], mask=valid[i:i + take] == 0),
                               pa.array(cuts[:-1] + at + shard["start"]), pa.array(np.diff(cuts)),
                               pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    if ids:
                        columns.append(pa.array(parts, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    i, at = i + take, int(ends[-1])

    return manifest.repartition(shards).mapInArrow(run, schema)
