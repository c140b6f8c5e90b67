"""Byte-level BPE: text to token ids and back, by a rank file that is a parameter.

A text is cut by the tokenizer's pattern. The pieces that a worker hasn't met yet are
merged together: they are bucketed by length into padded matrices, a row per piece, and
in every round each row merges its leftmost pair of minimum rank. A pair's rank is looked
up in an open-addressing hash table over (left id, right id); a round narrows the matrix by
a column and drops the rows that are done. Pieces over LONG bytes are merged one at a time
in a flat array; there one round takes all places of the minimum pair where the vocabulary
proves that this equals taking them leftmost first, and where it doesn't, a heap of pairs over a linked
list goes on one by one, so that a run of a million bytes of any kind ends.

Defined results: a null text counts as empty and has no ids; long texts are cut
piecewise, never shortened; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import small_batches, table, unused

#: Longer pieces leave the matrices for the flat form.
LONG = 256
#: Cells of one matrix at most.
CELLS = 1 << 20
#: Pieces a worker remembers; beyond that it starts anew.
REMEMBERED = 120_000
#: Pieces held at once for one text.
STRETCH = 200_000
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of byte strings, and the hash table over the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        self.settled = np.ones(max(self.bytes_of, default=0) + 1, bool)
        get = ranks.get
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                if (a := get(word[:k])) is not None and (b := get(word[k:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
                    # a token whose later merges may come before its own: its places must be taken one by one
                    if rank < a:
                        self.settled[a] = False
                    if rank < b:
                        self.settled[b] = False
        self._table(np.array(keys, np.int64), np.array(values, np.int64))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        rest, step = np.arange(len(keys)), 0
        while len(rest):
            at = self._slot(keys[rest], step)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]
            stored = self.keys[at] == keys[rest]
            self.values[at[stored]] = values[rest[stored]]
            rest, step = rest[~stored], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge; ids below zero are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, np.int64)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        keys, step = left[rest] << 32 | right[rest], 0
        while len(rest):
            at = self._slot(keys, step)
            found = self.keys[at]
            hit = found == keys
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            rest, keys, step = rest[on], keys[on], step + 1
        return out.reshape(shape)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > LONG:
                out[i] = self._flat(piece)
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for power, members in buckets.items():
            rows = max(1, CELLS >> power)
            for k in range(0, len(members), rows):
                block = members[k : k + rows]
                for i, ids in zip(block, self._matrix([pieces[i] for i in block]), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), lengths.max()), -1, np.int64)
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                done = np.ones(len(rows), bool)
            else:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(rows)), at]
                done = least == NONE
            for i, row, n in zip(rows[done].tolist(), ids[done].tolist(), lengths[done].tolist(), strict=True):
                out[i] = row[:n]
            if done.all():
                break
            on = ~done
            rows, ids, ranks, lengths, at, least = rows[on], ids[on], ranks[on], lengths[on] - 1, at[on], least[on]
            own = np.arange(len(rows))
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[own, at] = least
            cols = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            left, right = at > 0, at < ranks.shape[1]
            ranks[own[left], at[left] - 1] = self.pair_ranks(ids[own[left], at[left] - 1], ids[own[left], at[left]])
            ranks[own[right], at[right]] = self.pair_ranks(ids[own[right], at[right]], ids[own[right], at[right] + 1])
            if (width := int(lengths.max())) < ids.shape[1]:
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
        return out

    def _flat(self, piece: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if self.settled[least]:
                starts = np.r_[True, np.diff(at) != 1]  # of runs of overlapping places: every other one merges
                at = at[(at - at[starts][np.cumsum(starts) - 1]) % 2 == 0]
            else:
                return self._linked(ids, ranks)
            ids[at] = least
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at) if len(ranks) else ranks
            near = np.unique(np.r_[at - np.arange(len(at)) - 1, at - np.arange(len(at))])
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.pair_ranks(ids[near], ids[near + 1])
        return ids.tolist()

    def _linked(self, found: np.ndarray, ranks: np.ndarray) -> list[int]:
        """The leftmost pair of least rank, one after the other: a heap of pairs over a linked list, so a piece costs n log n."""
        ids, now, n = found.tolist(), [*ranks.tolist(), NONE], len(found)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            least, k = heapq.heappop(heap)
            if now[k] != least:
                continue
            gone = after[k]
            ids[k], ids[gone], now[gone], after[k] = least, -1, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for one in (before[k], k):
                if one < 0:
                    continue
                pair = (ids[one], ids[after[one]]) if after[one] < n else (-1, -1)
                if pair not in known:
                    known[pair] = int(self.pair_ranks(np.array(pair[:1]), np.array(pair[1:]))[0]) if pair[0] >= 0 else NONE
                now[one] = known[pair]
                if now[one] != NONE:
                    heapq.heappush(heap, (now[one], one))
        return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder over one vocabulary and pattern, with a bounded memory of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def stretches(self, text: str) -> Iterator[list[str]]:
        if len(text) <= STRETCH:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, STRETCH)):
            yield some

    def learn(self, pieces: Iterable[str]) -> list[str]:
        """The pieces that were new."""
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.vocabulary.merge([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        return new

    def forget(self, new: list[str]) -> None:
        """Lets go of the newest pieces when there are too many; what was met early is what is met often."""
        if len(self.known) > REMEMBERED:
            for p in new:
                self.known.pop(p, None)

    def encode_batch(self, texts: list[str | None]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, a stretch at a time; to be used up in order."""
        short = [self.pattern.findall(t) if t and len(t) <= STRETCH else None for t in texts]
        new = self.learn(set(chain.from_iterable(x for x in short if x)))
        for text, pieces in zip(texts, short, strict=True):
            yield self._stretched(text, pieces)
        self.forget(new)

    def _stretched(self, text: str | None, pieces: list[str] | None) -> Iterator[list[int]]:
        if not text:
            return
        if pieces is not None:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))
            return
        for some in self.stretches(text):
            new = self.learn(set(some))
            yield list(chain.from_iterable(map(self.known.__getitem__, some)))
            self.forget(new)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(next(self.encode_batch([text]))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker process; the file is part of an installed package, so each executor has it."""
    return Codec(Vocabulary(read_ranks(path)), pattern)


def _small(batch: pa.RecordBatch, texts: list, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose texts are held at once."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with an array of token ids for each text; a column named like out gives way."""
    kept = df.drop(out)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in _small(batch, texts):
                ids = [list(chain.from_iterable(x)) for x in own.encode_batch(texts[a:b])]
                columns = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    return df.mapInArrow(run, schema)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", digest: str = "decoded_sha256") -> DataFrame:
    """df with an array of token ids for each text and the SHA-256 of what these decode to, in one pass and one worker."""
    kept = df.drop(out, digest)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), T.StructField(digest, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in _small(batch, texts):
                ids = [list(chain.from_iterable(x)) for x in own.encode_batch(texts[a:b])]
                digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
                columns = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string())], [*names, out, digest])

    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of each array of token ids; a null array has none."""
    kept = df.drop(out)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(data, pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding again.

    The ids stay in the worker, a stretch of one text at a time, so that a text's ids are never
    held whole and don't cross to the JVM.
    """
    kept = [c for c in df.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        names = _Names()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            counts, of_ids, of_bytes = [], [], []
            for a, b in _small(batch, texts):
                for stretches in own.encode_batch(texts[a:b]):
                    n, x, y = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in stretches:
                        x.update((" " if n else "").encode() + " ".join(map(names.__getitem__, ids)).encode())
                        y.update(own.decode(ids))
                        n += len(ids)
                    counts.append(n)
                    of_ids.append(x.hexdigest())
                    of_bytes.append(y.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, schema)


class _Names(dict):
    def __missing__(self, i: int) -> str:
        self[i] = name = str(i)
        return name


def default_files() -> tuple[str, str]:
    """The rank file and pattern of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded, decoded, and both digested."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_files())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents with their token ids, the number of these and the digest of what they decode to."""
    small_batches(spark)
    n = unused(docs, "token_ids", "decoded_sha256", "n_tokens")
    found = encode_and_decode(docs, *default_files(), out=n["token_ids"], digest=n["decoded_sha256"])
    return found.withColumn(n["n_tokens"], F.size(n["token_ids"]).cast("long"))
