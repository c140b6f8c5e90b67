"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors get one more coordinate, sqrt(M * M - |x| * |x|) with M the greatest norm, so that the largest inner product is the
least Euclidean distance. Each of TABLES tables hashes a vector by HASHES Gaussian projections, each cut into
intervals of one width; the outermost are unbounded, so a table has 3 ** HASHES buckets at most, whatever the number
of rows. A query visits its own bucket and perturbed ones in order of estimated success: the chance that a
near neighbour of it lies there, from the spread of the projections of neighbours in a bounded sample. It goes on until
the chances add up to the table's part of AIM; nothing else bounds the buckets or the candidates. Candidates are
ranked by the exact inner product and merged over tables.

Buckets are packed into shards of about SHARD rows by their counts (a bounded histogram); a bucket larger than a shard is
split over several. A query goes to the shards that hold a bucket it visits; rows go to one shard a table, whatever the
number of queries. A task holds the rows of one shard and streams its queries past them, in Arrow batches sorted by shard, so neither
side has a bound to keep. Queries that found fewer neighbours than there are go again over all buckets.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without vec_id; ties go to the smaller vec_id; of repeated vec_ids the best row counts; with fewer candidates than k
all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.shared import cut, table

K = 20
TABLES, HASHES, WIDTH, SEED = 4, 8, 1.0, 11
#: Chance to find a neighbour that the probes of all tables aim at.
AIM = 0.97
#: Rows that the fit of projections and spreads uses, about.
FIT_ROWS = 4_000
#: Rows of a shard.
SHARD = 20_000

_cdf = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), otypes=[float])


@dataclass(frozen=True)
class Index:
    """What all tasks need: projections and cuts, the greatest norm, and how neighbours' projections lie about a query's."""

    norm: float
    directions: np.ndarray  # TABLES x HASHES x (length + 1)
    centre: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray  # TABLES x HASHES x 2
    slope: float
    spread: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("nd,thd->nth", x, self.directions) - self.centre) / self.scale

    def grown(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))]

    def turned(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q * (self.norm / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        cell = (self.project(self.grown(x))[..., None] >= self.cuts).sum(axis=-1)
        return cell @ (3 ** np.arange(HASHES)[::-1])

    def probes(self, q: np.ndarray, aim: float) -> Iterator[list[np.ndarray]]:
        """For each query and table, buckets in order of estimated success, until their chances reach the aim."""
        at = self.project(self.turned(q))
        below = _cdf((self.cuts - self.slope * at[..., None]) / self.spread)
        chance = np.stack([below[..., 0], below[..., 1] - below[..., 0], 1 - below[..., 1]], axis=-1)
        share = 1.0 if aim >= 1 else 1 - (1 - aim) ** (1 / TABLES)
        for one in chance:
            out = []
            for each in one:
                p = each[0]
                for more in each[1:]:
                    p = (p[:, None] * more).ravel()
                order = np.argsort(-p, kind="stable")
                out.append(order if share >= 1 else order[: np.searchsorted(np.cumsum(p[order]), share) + 1])
            yield out


def valid(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id long, v array of double) of the rows that take part, written to the shared folder."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = cut(rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0)))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def fit(rows: DataFrame, n: int, seed: int = SEED) -> Index:
    """Projections, cuts and spreads from a sample of about FIT_ROWS rows, drawn by a hash of the id."""
    norm = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0])
    part = rows if n <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(FIT_ROWS / n * (1 << 20)))
    some = np.array([r["v"] for r in part.orderBy("id").limit(2 * FIT_ROWS).collect()])
    random = np.random.default_rng(seed)
    directions = random.normal(size=(TABLES, HASHES, some.shape[1] + 1))
    draft = Index(norm, directions, np.zeros((TABLES, HASHES)), np.ones((TABLES, HASHES)), np.zeros((TABLES, HASHES, 2)), 1.0, 1.0)
    raw = draft.project(draft.grown(some))
    centre, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-12
    offset = random.uniform(0.35, 0.65, size=(TABLES, HASHES))
    draft = Index(norm, directions, centre, scale, WIDTH * np.stack([-offset, 1 - offset], axis=-1), 1.0, 1.0)
    # the neighbour of the rank that K has in the whole, in the sample
    ask = some[: min(300, len(some))]
    near = ask @ some.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    rank = min(len(some) - 1, max(1, round(K * len(some) / n)))
    at = np.argsort(-near, axis=1)[:, rank - 1] if rank else np.arange(len(ask))
    q, x = draft.project(draft.turned(ask)).ravel(), draft.project(draft.grown(some[at])).ravel()
    slope = float(np.clip((q @ x) / max(1e-12, q @ q), 0, 1.5))
    spread = max(1e-3, float(np.sqrt(np.mean((x - slope * q) ** 2))))
    return Index(norm, directions, centre, scale, draft.cuts, slope, spread)


@dataclass(frozen=True)
class Shards:
    """For each table and bucket its first shard and over how many shards it is split."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def pack(cls, counts: np.ndarray, size: int) -> Shards:
        first, parts = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
        at = 0
        for t in range(len(counts)):
            room = 0
            for b, n in enumerate(counts[t].tolist()):
                if n > size:
                    parts[t, b] = -(-n // size)
                    first[t, b] = at + (room > 0)
                    at, room = first[t, b] + parts[t, b], 0
                    continue
                if room + n > size:
                    at, room = at + 1, 0
                first[t, b] = at
                room += n
            at += 1
        return cls(first, parts)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(), values.reshape(batch.num_rows, -1)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


#: What both sides of a shard are dealt as: rows (side 0) with their bucket, then queries (side 1) with those they visit.
_DEALT = "shard long, side int, id long, buckets binary, v array<double>"


def _batch(shard: np.ndarray, side: int, ids: np.ndarray, buckets: list[bytes], x: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int64()), pa.array(np.full(len(ids), side), pa.int32()), pa.array(ids, pa.int64()), pa.array(buckets, pa.binary()), _arrays(x)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "side", "id", "buckets", "v"])


def _dealt(rows: DataFrame, index: Index, shards: Shards) -> DataFrame:
    """Rows to the shard of their bucket, once a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = _ids(batch)
            found = index.buckets(x)
            for t in range(TABLES):
                b = found[:, t]
                shard = shards.first[t, b] + (ids * 2654435761 % (1 << 32)) % shards.parts[t, b]
                yield _batch(shard, 0, ids, [n.tobytes() for n in b.astype(np.int16)], x)

    return rows.mapInArrow(run, _DEALT)


def _sent(queries: DataFrame, index: Index, shards: Shards, aim: float) -> DataFrame:
    """Queries to each shard that holds a bucket they visit, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                ids, q = _ids(part)
                shard, own, buckets = [], [], []
                for i, tables in enumerate(index.probes(q, aim)):
                    for t, visited in enumerate(tables):
                        first, parts = shards.first[t, visited], shards.parts[t, visited]
                        visited, at = np.repeat(visited, parts), np.repeat(first, parts)
                        at = at + np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                        order = np.argsort(at, kind="stable")
                        at, visited = at[order], visited[order]
                        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        shard += at[edge].tolist()
                        own += [i] * len(edge)
                        buckets += [x.astype(np.int16).tobytes() for x in np.split(visited, edge[1:])]
                yield _batch(np.array(shard), 1, ids[own], buckets, q[own])

    return queries.mapInArrow(run, _DEALT)


class _Held:
    """The rows of one shard, and the k best of them in the buckets that queries visit."""

    def __init__(self, parts: list[pa.RecordBatch]):
        found = [_ids(p) for p in parts]
        self.ids, self.x = np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])
        bucket = np.frombuffer(b"".join(b for p in parts for b in p.column("buckets").to_pylist()), np.int16)
        self.names, self.at = np.unique(bucket, return_inverse=True)

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        ids, x = self.ids, self.x
        q_ids, q = _ids(queries)
        visits = queries.column("buckets").to_pylist()
        out_q, out_id, out_score = [], [], []
        for a in range(0, len(q_ids), 128):
            own = q[a : a + 128]
            seen = np.zeros((len(own), 3**HASHES), bool)
            for i, v in enumerate(visits[a : a + 128]):
                seen[i, np.frombuffer(v, np.int16)] = True
            scores = own @ x.T
            scores[~seen[:, self.names][:, self.at]] = -np.inf
            scores[q_ids[a : a + 128, None] == ids] = -np.inf
            last = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
            for i, row in enumerate(scores):
                # a margin over the rounding of the block product: equal vectors must tie exactly
                some = np.flatnonzero((row >= last[i] - 1e-9 * (1 + abs(last[i]))) & (row > -np.inf)) if last[i] > -np.inf else np.flatnonzero(row > -np.inf)
                exact = (x[some] * own[i]).sum(axis=1)
                order = np.lexsort((ids[some], -exact))[:k]
                out_q += [int(q_ids[a + i])] * len(order)
                out_id += ids[some][order].tolist()
                out_score += exact[order].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.float64())], ["query_id", "vec_id", "score"])


def _round(rows: DataFrame, queries: DataFrame, index: Index, shards: Shards, aim: float, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held, at = None, None
        for batch in batches:
            shard, side = batch.column("shard").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != at:
                    parts, held, at = [], None, shard[a]
                if side[a] == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    held = held or _Held(parts)
                    yield held.best(batch.slice(a, b - a), k)

    both = _dealt(rows, index, shards).unionByName(_sent(queries, index, shards, aim))
    found = both.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, ask: Column, id: str = "vec_id", vector: str = "embedding", k: int = K, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `ask` (on column id) picks, its k nearest others found."""
    rows = valid(df, id, vector)
    n = rows.count()
    queries = rows.where(ask)
    m = queries.count()
    if n < 2 or not m:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TABLES, 3**HASHES), np.int64)
        for batch in batches:
            if batch.num_rows:
                for t, b in enumerate(index.buckets(_ids(batch)[1]).T):
                    total[t] += np.bincount(b, minlength=3**HASHES)
        t, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(b), pa.array(total[t, b])], ["t", "b", "n"])

    # a row for each table and bucket at most: TABLES * 3 ** HASHES, whatever the number of rows
    histogram = np.zeros((TABLES, 3**HASHES), np.int64)
    for r in rows.mapInArrow(count, "t long, b long, n long").groupBy("t", "b").agg(F.sum("n").alias("n")).collect():
        histogram[r["t"], r["b"]] = r["n"]
    shards = Shards.pack(histogram, SHARD)
    found = cut(_round(rows, queries, index, shards, aim, k))
    if aim >= 1:
        return found
    few = found.groupBy("query_id").count().where(F.col("count") == min(k, n - 1)).select(F.col("query_id").alias("id"))
    rest = cut(queries.join(few, "id", "left_anti"))
    if rest.isEmpty():
        return found
    again = _round(rows, rest, index, shards, 1.0, k)
    return found.join(rest.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def op10_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
