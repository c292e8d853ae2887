"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merge loop keeps one bucket per merge rank; a bucket holds the positions of a linked list of
tokens whose pair has that rank. A two-level bitmap over the ranks (256-bit words) gives the lowest
non-empty bucket with two find-first-set steps, so n bytes cost O(n log n) however long a pre-token
is. Entries whose pair has changed since they were queued are skipped. Pre-tokens never merge with each
other, so all unseen ones of a batch share one list and one queue.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import Cache, pick

# White_Space of Unicode, which the rank files' pattern means by \s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a Python worker's caches (a generation) of chunks and of pre-tokens.
CACHED_CHUNKS, CACHED_PIECES = 200_000, 400_000
#: Longer pieces are not cached.
CACHE_LENGTH = 64
#: Documents encoded together.
BATCH = 256
# ASCII marks that are a pre-token of their own between letters and a space or the end.
# Fixed value: the pattern of the public tokenizer for which texts are cut at spaces.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by merge rank; ``first()`` is the lowest rank that holds any, or -1."""

    BITS = [1 << k for k in range(256)]

    def __init__(self, size: int):
        self.words = [0] * (size // 256 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Queue positions under a rank whose bucket is empty."""
        self.buckets[rank] = positions
        word = rank >> 8
        self.words[word] |= self.BITS[rank & 255]
        self.top |= 1 << word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def first(self) -> int:
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        return (word << 8) + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty a bucket; its positions from left to right."""
        word = rank >> 8
        self.words[word] ^= self.BITS[rank & 255]
        if not self.words[word]:
            self.top ^= 1 << word
        return sorted(self.buckets.pop(rank))


def portable(pattern: str) -> str:
    """``pattern`` with ``\\s`` and ``\\S`` as Unicode white space, which Python's classes exceed by four control characters."""
    out, at, depth = [], 0, 0
    while at < len(pattern):
        two = pattern[at:at + 2]
        if two in ("\\s", "\\S"):
            inverse = two == "\\S"
            out.append(f"[^{WHITE}]" if inverse else WHITE if depth else f"[{WHITE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            depth += (two[:1] == "[") - (two[:1] == "]" and depth > 0)
            out.append(two[:1])
            at -= 1
        at += 2
    return "".join(out)


class Codec:
    """Encoder and decoder of one rank table; ids are 4-byte little-endian in ``bytes``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.single = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.uint32)
        # The cut at spaces and the chunks of letters that need no pattern are right for this pattern alone.
        self.short_cuts = pattern == SPACED_WORDS
        found = regex.compile(portable(pattern), regex.V1).finditer
        self.split = lambda text: [m.group() for m in found(text) if m.end() > m.start()]
        white = regex.compile(f"[{WHITE}]")
        self.white = frozenset(c for c in map(chr, range(0x3001)) if white.match(c))
        self.queue = RankQueue(len(self.vocab))
        self.chunks, self.pieces = Cache(CACHED_CHUNKS), Cache(CACHED_PIECES)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token: always the lowest rank first, the leftmost of equal ones."""
        out: list[bytes | None] = [None] * len(pieces)
        parts = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None:
                parts.append(k)
            else:
                out[k] = whole.to_bytes(4, "little")
        if not parts:
            return out
        # One list for all; each pre-token is followed by a position that holds no token.
        data = b"\0".join([pieces[k] for k in parts]) + b"\0"
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        ends = np.cumsum([len(pieces[k]) + 1 for k in parts]) - 1
        gap = np.zeros(n, bool)
        gap[ends] = True
        first = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first[gap[:-1] | gap[1:]] = -1
        after = np.arange(1, n + 1)
        after[gap] = -1
        before = np.arange(-1, n - 1)
        before[1:][gap[:-1]] = -1
        current, after, before = [*first.tolist(), -1], after.tolist(), before.tolist()
        token, dead = self.single[raw].tolist(), bytearray(gap.tobytes())
        queue, get = self.queue, self.ranks.get
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        for rank, group in () if not len(order) else zip(first[order[starts]].tolist(), np.split(order, starts[1:]), strict=True):
            queue.put(rank, group.tolist())
        buckets, push, put = queue.buckets, queue.push, queue.put
        while (rank := queue.first()) >= 0:
            waiting = queue.take(rank)
            for at, i in enumerate(waiting):
                if current[i] != rank:
                    continue  # stale: the pair at i is another one by now
                gone = after[i]
                end = after[gone]
                after[i], before[end] = end, i
                token[i], current[gone], dead[gone] = rank, -1, 1
                lower, stop = False, after[end]
                new = get(data[i:stop]) if stop >= 0 else None
                if new is None:
                    current[i] = -1
                else:
                    current[i] = new
                    lower = new < rank
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        put(new, [i])
                left = before[i]
                if left >= 0:
                    new = get(data[left:end])
                    if new is None:
                        current[left] = -1
                    else:
                        current[left] = new
                        lower |= new < rank
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            put(new, [left])
                if lower:  # a lower rank has come up: it goes first, the rest of this bucket waits
                    for later in waiting[at + 1:]:
                        push(rank, later)
                    break
        alive = np.frombuffer(dead, np.uint8) == 0
        ids = np.array(token, "<u4")[alive].tobytes()
        cuts = [0, *(4 * np.cumsum(alive)[ends]).tolist()]
        for k, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
            out[k] = ids[a:b]
        return out

    def _cut(self, text: str) -> list[str]:
        """Cut a text before every space that a non-space follows: such a space always starts a
        pre-token of SPACED_WORDS, so chunks can be encoded apart. For another pattern its matches are the chunks."""
        if not self.short_cuts:
            return self.split(text)
        parts, white = text.split(" "), self.white
        chunks = parts[:1]
        for part in parts[1:]:
            if part and part[0] not in white:
                chunks.append(" " + part)
            else:
                chunks[-1] += " " + part
        return chunks

    def _learn(self, unseen: set[str]) -> None:
        """Ids of chunks. Most are letters, or letters and one mark: their pre-tokens need no pattern."""
        cuts = {}
        for chunk in unseen:
            if not chunk:
                cuts[chunk] = ()
                continue
            if not self.short_cuts:
                cuts[chunk] = (chunk,)
                continue
            body = chunk[1:] if chunk[0] == " " else chunk
            if body.isalpha():
                cuts[chunk] = (chunk,)
            elif body[-1:] in MARKS and body[:-1].isalpha():
                cuts[chunk] = (chunk[:-1], body[-1])
            else:
                cuts[chunk] = self.split(chunk)
        new = list(self.pieces.lacking(set().union(*cuts.values())))
        known, chunks = self.pieces.young, self.chunks.young
        known.update(zip(new, self.merge([p.encode("utf-8", "replace") for p in new]), strict=True))
        for chunk, pieces in cuts.items():
            chunks[chunk] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
        self.pieces.drop([p for p in new if len(p) > CACHE_LENGTH])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. Repeated chunks come from a cache that holds short ones."""
        split = [self._cut(t) if t else [] for t in texts]
        unseen = self.chunks.lacking(set().union(*split))
        if unseen:
            self._learn(unseen)
        known = self.chunks.young
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        self.chunks.drop([c for c in unseen if len(c) > CACHE_LENGTH])
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(load_ranks(path), pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
           decode: bool = True) -> DataFrame:
    """Ids of every whole text, and with ``decode`` the bytes that the ids stand for.

    Returns ``key``, ``token_ids`` (binary, 4 bytes an id, little-endian) and ``decoded`` (binary).
    ``ranks`` names the rank file, which every executor must be able to open; ``pattern``, any regular
    expression that both libraries read alike, splits texts before the merges. Very long texts are encoded whole. NULL and empty texts have no ids; repeated rows are encoded each;
    an empty table gives an empty result; other columns are ignored. Map-only: no shuffle.
    """
    rows = pick(docs, key, text)
    fields = [rows.schema[0], T.StructField("token_ids", T.BinaryType())]
    if decode:
        fields.append(T.StructField("decoded", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([own.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Length and SHA-256 digests of :func:`encode`'s columns."""
    return encoded.select(
        key, F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
