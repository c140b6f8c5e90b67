"""SimHash near duplicates, found by a self-join of binary tries.

A document's fingerprint is the majority of the bits of its shingles' XXH64 values. Equal
fingerprints are one node. Fingerprints that differ in at most `budget` bits agree in one of
budget + 1 blocks of bits, so each is dealt once for every block, and all that agree in a block
form a binary trie. The trie is joined with itself: pairs of its nodes are walked down
together, level by level, and each pair carries the number of bits in which its two paths
differ; a pair is dropped as soon as that exceeds the budget. The walk is over ranges of a
sorted array, all pairs of a level at once, in portions of bounded size.

A task links what it finds by union-find and returns a spanning forest of near pairs, a row for each node at most,
never all pairs of a group; the forests of all tasks then go through connected components.
A block value that too many fingerprints share is split below: its trie is cut at a deeper
level, and each pair of subtries whose paths differ within the budget becomes a task of its
own; that goes on until no task is too large.

Defined results: null and empty texts and texts of white space alone have fingerprint zero and
are linked like any other; rows whose id is null take part, and links run through them, but they can't name a component (null
if all its members' ids are null); repeated ids are repeated rows with one component each; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.components import components
from marginalia.llm.exact import _set, located
from marginalia.llm.shared import cut, joined_counted, small_batches, table, unused, words, written

SEED = 42
#: Fingerprints that share a block value before its trie is cut deeper.
GROUP = 50_000
#: Node pairs walked at once; a step needs about 500 bytes for each.
FRONT = 1 << 16
#: Rows of tries that one partition holds, about.
ROWS_HELD = 60_000
#: Bits by which a task that is too large is cut deeper at once.
DEEPER = 8
#: Rows of places that may be sent to every executor.
SENT_ROWS = 100_000
#: Candidates of a node that are taken of what the tries find. What else there is, common shingles find.
NEAREST = 8
#: Links that meet one copy of a text in one place.
COPIES = 500


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], "<u8")
    length = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(length + 1) - length - 1
    end = (start + length)[shingle - 1 :]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=False)), "<u8", len(end))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The set of word shingles, as ascending hashes that are mixed from the XXH64 of the words; of fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n, k = len(words), min(len(words), shingle)
    each, out = np.array(list(map(xxhash.xxh64_intdigest, words)), "<u8"), np.full(n - k + 1, k, "<u8")
    for i in range(k):
        out = (out ^ each[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words."""
    hashes = _shingles(text, shingle)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """df without its text, with the fingerprint as a long (the same 64 bits, signed)."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found.view(np.int64))], [*kept, out])

    return df.mapInArrow(run, schema)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = parent[x]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unites a[k] with b[k]; returns the k that joined two sets, a spanning forest of what was united."""
    which, joined = np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        differ = a != b
        low, high, which = np.minimum(a, b)[differ], np.maximum(a, b)[differ], which[differ]
        order = np.lexsort((low, high))
        first = order[np.r_[True, np.diff(high[order]) != 0][: len(order)]]
        parent[high[first]] = low[first]
        joined.append(which[first])
        a, b = low, high
    return np.concatenate(joined)


class Segment(NamedTuple):
    """Bits of a key that are walked together, and how many bits may differ by their end (with all segments before)."""

    values: np.ndarray
    bits: int
    budget: int


def trie_join(keys: list[Segment], ranges: np.ndarray, parent: np.ndarray, at: np.ndarray, without: np.ndarray | None = None) -> list[np.ndarray]:
    """Unites, in `parent`, the nodes `at` of all keys within the budget; returns the pairs of places that joined two sets.

    without: pairs (i, j) that don't count, as i * n + j in ascending order.

    The keys ascend, without repeats, in every range. ranges: rows (from, to, from, to), the two tries to join; the
    same one twice joins a trie with itself. Pairs of subtries that are of one component already are left out, so
    that a dense family costs about its size and not its square.
    """
    n = len(keys[0].values)
    levels = [(k, bit) for k, segment in enumerate(keys) for bit in range(segment.bits - 1, -1, -1)]
    ones, joined = np.zeros(n + 1, np.int64), []
    work = [(0, ranges.astype(np.int64), np.zeros(len(ranges), np.int64))]
    while work:
        level, front, errors = work.pop()
        if len(front) > FRONT:
            half = len(front) // 2
            work += [(level, front[half:], errors[half:]), (level, front[:half], errors[:half])]
            continue
        if 4 * len(front) > n:
            root = _find(parent, at)
            changes = np.r_[0, 0, np.cumsum(root[1:] != root[:-1])]  # up to a place, from the one before
            a0, a1, b0, b1 = front.T
            one = (root[a0] == root[b0]) & (changes[a1] == changes[a0 + 1]) & (changes[b1] == changes[b0 + 1])
            front, errors = front[~one], errors[~one]
        if not len(front):
            continue
        a0, a1, b0, b1 = front.T
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            differ, near = 0, i != j
            for segment in keys:
                differ = differ + np.bitwise_count(segment.values[i] ^ segment.values[j]).astype(np.int64)
                near &= differ <= segment.budget
            if without is not None and len(without):
                code = i * n + j
                near &= without[np.minimum(np.searchsorted(without, code), len(without) - 1)] != code
            # the nearer ones first
            for part in (near & (2 * differ <= keys[-1].budget), near & (2 * differ > keys[-1].budget)):
                some = _unite(parent, at[i[part]], at[j[part]])
                joined.append(np.stack([i[part][some], j[part][some]]))
            a0, a1, b0, b1, errors = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], errors[~leaf]
            if not len(a0):
                continue
        k, bit = levels[level]
        np.cumsum((keys[k].values >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        children = np.concatenate([
            np.stack([a0, am, b0, bm, errors]), np.stack([am, a1, bm, b1, errors]),
            np.stack([a0, am, bm, b1, errors + 1]), np.stack([am, a1, b0, bm, errors + 1])[:, ~same],
        ], axis=1)
        a0, a1, b0, b1, errors = children
        on = (a1 > a0) & (b1 > b0) & (errors <= keys[k].budget) & ~((a0 == b0) & (a1 - a0 == 1))
        # all pairs of a level go on together, so a level's counts of ones are made once
        work.append((level + 1, np.stack([a0, a1, b0, b1], axis=1)[on], errors[on]))
    return joined


def forest(task: np.ndarray, side: np.ndarray, node: np.ndarray, keys: list[Segment], forests: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs (node, other, differing bits) that connect what the tries of all tasks connect.

    A task of side 0 is joined with itself, sides 1 and 2 of a task with each other. forests: how many spanning forests, no two of
    one pair, are taken one after the other; any cut that so many pairs or more cross is crossed by so many of them.
    """
    order = np.lexsort((*(k.values for k in reversed(keys)), side, task))
    task, side, node = task[order], side[order], node[order]
    keys = [k._replace(values=k.values[order]) for k in keys]
    ids, at = np.unique(node, return_inverse=True)
    parent = np.arange(len(ids))
    # equal keys are one leaf
    new = np.r_[True, (np.diff(task) != 0) | (np.diff(side) != 0) | np.logical_or.reduce([k.values[1:] != k.values[:-1] for k in keys])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same, of = np.flatnonzero(~new), lead[~new]
    some = _unite(parent, at[same], at[of])
    out = [(at[same[some]], at[of[some]], np.zeros(len(some), np.int64))]
    task, side, at, keys = task[new], side[new], at[new], [k._replace(values=k.values[new]) for k in keys]
    first = np.flatnonzero(np.r_[True, (np.diff(task) != 0) | (np.diff(side) != 0)])
    last = np.r_[first[1:], len(task)]
    own = (side[first] == 0) & (last - first > 1)
    left = np.flatnonzero((side[first[:-1]] == 1) & (side[first[1:]] == 2) & (task[first[:-1]] == task[first[1:]]))
    pairs = [np.stack([first[own], last[own], first[own], last[own]], axis=1), np.stack([first[left], last[left], first[left + 1], last[left + 1]], axis=1)]
    without = np.zeros(0, np.int64)
    for k in range(forests):
        joined = trie_join(keys, np.concatenate(pairs), np.arange(len(ids)) if k else parent, at, without)
        found = np.concatenate([np.zeros((2, 0), np.int64), *joined], axis=1)
        if not found.size:
            break
        i, j = found
        without = np.sort(np.concatenate([without, i * len(at) + j]))
        out.append((at[i], at[j], sum(np.bitwise_count(x.values[i] ^ x.values[j]).astype(np.int64) for x in keys)))
    u, v, differ = (np.concatenate(x) for x in zip(*out, strict=True))
    return ids[np.maximum(u, v)], ids[np.minimum(u, v)], differ


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks of 64 bits."""
    edges = [round(64 * k / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _turned(word: str, shift: int, width: int, bits: int) -> Column:
    """The bits of a word after a block, wrapping round, without the block's."""
    if bits == width:
        return F.lit(0).cast("long")
    at = shift + width
    low = F.shiftrightunsigned(word, at) if at < 64 else F.lit(0).cast("long")
    return low.bitwiseOR(F.shiftleft(word, bits - at)).bitwiseAND((1 << bits - width) - 1)


def subdivided(rows: DataFrame, budget: int, group: int) -> DataFrame:
    """Rows (task, side, used, word, left, ...) with no task of over `group` rows while bits of the word are left to cut it by.

    A task too large is cut `deeper` bits further down: the pair of paths (p, q), p < q, becomes a task of sides 1 and 2, the pair
    (p, p) one of side 0, where the bits in which p and q differ, with those used before, are within the budget.
    """
    done = None
    while True:
        counted = rows.where("left > 0").groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > group)
        hot = cut(counted.select("task", F.least(F.lit(DEEPER), F.ceil(F.log2(F.col("n") / group)).cast("int") + 2).alias("deeper")))
        if not (m := hot.count()):
            return rows if done is None else done.unionByName(rows)
        found = rows.join(F.broadcast(hot) if m <= SENT_ROWS else hot, "task", "left")
        plain = found.where("deeper is null or left = 0").drop("deeper")
        done = plain if done is None else done.unionByName(plain)
        masks = F.filter(F.array(*(F.lit(x).cast("long") for x in range(1 << DEEPER) if x.bit_count() <= budget)), lambda x: (x < F.expr("shiftleft(1L, deeper)")) & (F.bit_count(x) + F.col("used") <= budget))
        out = found.where("deeper is not null and left > 0").withColumn("deeper", F.least("deeper", "left")).withColumn("mask", F.explode(masks))
        out = out.withColumn("path", F.expr("word & (shiftleft(1L, deeper) - 1)")).withColumn("other", F.expr("path ^ mask"))
        one = F.when(F.col("side") == 0, F.least("path", "other")).when(F.col("side") == 1, F.col("path")).otherwise(F.col("other"))
        two = F.when(F.col("side") == 0, F.greatest("path", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("path"))
        side = F.when((F.col("side") > 0) | (F.col("mask") == 0), F.col("side")).when(F.col("path") < F.col("other"), 1).otherwise(2)
        kept = [c for c in rows.columns if c not in ("task", "side", "used", "word", "left")]
        rows = cut(out.select(
            F.xxhash64("task", one, two).alias("task"), side.alias("side"), (F.col("used") + F.bit_count("mask")).cast("int").alias("used"),
            F.expr("shiftrightunsigned(word, deeper)").alias("word"), (F.col("left") - F.col("deeper")).alias("left"), *kept,
        ))


def links(nodes: DataFrame, budget: int, group: int = GROUP) -> DataFrame:
    """Nodes (node long, fp long), a row for each fingerprint, to a forest (u, v) of those within budget bits."""
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1 if width < 64 else -1).alias("key"), _turned("fp", shift, width, 64).alias("word"), F.lit(64 - width).alias("left")) for k, (shift, width) in enumerate(_blocks(budget))]
    dealt = nodes.select("node", "fp", F.explode(F.array(*blocks)).alias("b")).select("node", "fp", F.xxhash64("b.block", "b.key").alias("task"), F.lit(0).alias("side"), F.lit(0).alias("used"), "b.word", "b.left")
    tasks = subdivided(dealt, budget, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's rows are narrow (28 bytes), and their number is the shuffle partition's, a setting of the session
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            whole = pa.concat_tables(held)
            task, side, fp, node = (whole.column(c).to_numpy() for c in ("task", "side", "fp", "node"))
            u, v, _ = forest(task, side, node, [Segment(fp.view(np.uint64), 64, budget)])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return tasks.select("task", "side", "fp", "node").repartition("task").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2, group: int = GROUP) -> DataFrame:
    """(id, fp, component_id) for each row: the least id that its fingerprint reaches through links within budget bits."""
    prints = cut(fingerprints(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), shingle=shingle))
    # the fingerprint itself is the node, so that those of rows without an id are nodes too
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), budget, group))
    rooted = cut(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root")))
    roots = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    named = cut(joined_counted(rooted, roots, ["root"], "fps", nodes.count()).select("fp", "n", "component_id"))
    return joined_counted(prints, named, ["fp"], "n", prints.count()).select(F.col("id").alias(id), "fp", "component_id")


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hex and component of every document: 3-word shingles, at most 2 differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Wide fingerprints: for a similarity that a few bits of 64 can't tell.

# They only name candidates: every link is held against the true Jaccard similarity of the two texts' shingle sets.

#: Words of a shingle and the Jaccard similarity from which texts are near duplicates. At 0.8 about 15 % of the bits differ.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Short fingerprints of 32 bits, and how many bits of one may differ: similar pairs meet in one of them (95 % at 0.8, 99 % at 0.85).
SHORTS, SHORT_BUDGET = 24, 2
#: Bits of a further fingerprint of 128 that may differ in a candidate: 0.8 gives 19 on average, with a deviation of 4.
WIDE_BUDGET = 32
#: Spanning forests of candidates that a task returns: more than one, as a candidate that fails must not hide one that holds.
FORESTS = 2
LONGS = SHORTS // 2 + 2
#: Slots of a set's parities at most.
MOST_BITS = 4096
#: Shuffle files go when their action is over, not when the driver next collects its garbage: the stage has dozens of actions, some of which move whole texts.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same; at its end the worker gives back what it holds but no longer uses, as workers that wait count in an executor's memory."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return lean


def _majority(words: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of words (rows x longs), by carry-save addition of whole words."""
    n, planes, total = len(words), [words], np.zeros((words.shape[1], 64), np.int64)
    weight = 0
    while planes:
        now, above = planes.pop(), []
        while len(now) > 2:
            k = len(now) // 3
            a, b, c, rest = now[:k], now[k : 2 * k], now[2 * k : 3 * k], now[3 * k :]
            half = a ^ b
            above.append((a & b) | (c & half))
            now = np.concatenate([half ^ c, rest])
        total += np.unpackbits(now.astype("<u8").view(np.uint8).reshape(len(now), -1), axis=1, bitorder="little").reshape(len(now), -1, 64).sum(axis=0, dtype=np.int64) << weight
        weight += 1
        if above:
            planes.append(np.concatenate(above))
    return np.packbits(2 * total > n, axis=1, bitorder="little").view("<u8").ravel()


def _wide(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    if not len(hashes):
        return np.zeros(longs, np.uint64)
    x = hashes[:, None] + np.arange(longs, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return _majority(x)


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, longs: int = LONGS) -> np.ndarray:
    """SimHash of 64 * longs bits of the set of shingles; a shingle's further bits are mixed from its hash."""
    return _wide(shingle_set(text, shingle), longs)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of each of 64 to MOST_BITS slots, at least 2 a shingle while that allows it, whether an odd number of the set's shingles falls into it.

    Two sets' parities differ in no more slots than the sets do in shingles. The lower half of the slots, with the upper half added to it, are the parities of half as many.
    """
    n = min(MOST_BITS, 1 << max(6, (2 * len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1, bitorder="little").view("<u8")


def wide_fingerprints(rows: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(at, id, text) to (at, id, size, shingles, odd, w): how many shingles the set has, a digest of it, its parities, and w an array of LONGS longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, odd, wide = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                odd.append(parities(found).tobytes())
                wide.append(_wide(found).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(odd, pa.binary()), pa.array(wide, pa.list_(pa.int64()))], ["at", "id", "size", "shingles", "odd", "w"])

    return rows.select("at", "id", "text").mapInArrow(_lean(run), f"at {rows.schema['at'].dataType.simpleString()}, id long, size long, shingles binary, odd binary, w array<long>")


def wide_links(nodes: DataFrame, budget: int = WIDE_BUDGET, group: int = GROUP) -> DataFrame:
    """(node, w) to candidates (u, v, differ, of_u, of_v), u > v, each node a component of its own: nodes whose short fingerprints nearly agree somewhere and whose 128 further bits do within budget.

    A trie's key is a short fingerprint and then the further bits, so the walk prunes by the one budget first and by the other below.
    """
    shorts = [F.shiftrightunsigned(F.col("w")[k // 2], 32 * (k % 2)).bitwiseAND(0xFFFFFFFF) for k in range(SHORTS)]
    blocks = [(0, 11), (11, 11), (22, 10)]
    deals = [F.struct(F.lit(3 * k + i).alias("block"), F.shiftrightunsigned(s, shift).bitwiseAND((1 << width) - 1).alias("key"), s.alias("short")) for k, s in enumerate(shorts) for i, (shift, width) in enumerate(blocks)]
    dealt = nodes.select("node", F.col("w")[LONGS - 2].alias("c0"), F.col("w")[LONGS - 1].alias("c1"), F.explode(F.array(*deals)).alias("d")).select("node", "c0", "c1", "d.*")
    if dealt.groupBy("block", "key").count().where(F.col("count") > group).isEmpty():
        # task and short fingerprint in one long: these rows are most of what the stage moves
        tasks = dealt.select(F.shiftleft(F.col("block").cast("long") * 2048 + F.col("key"), 32).bitwiseOR(F.col("short")).alias("packed"), "node", "c0", "c1")
        by = [F.shiftrightunsigned("packed", 32)]
    else:
        word, left = F.lit(0).cast("long"), F.lit(0)
        for i, (shift, width) in enumerate(blocks):
            word = F.when(F.col("block") % 3 == i, _turned("short", shift, width, 32)).otherwise(word)
            left = F.when(F.col("block") % 3 == i, 32 - width).otherwise(left)
        rows = dealt.select(F.xxhash64("block", "key").alias("task"), F.lit(0).alias("side"), F.lit(0).alias("used"), word.alias("word"), left.alias("left"), "short", "node", "c0", "c1")
        tasks = _parted(subdivided(rows, SHORT_BUDGET, group).select("task", "side", "short", "node", "c0", "c1"), group)
        by = [F.col("task")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            whole = pa.concat_tables(held)
            column = lambda c: whole.column(c).to_numpy()
            if "packed" in whole.column_names:
                packed = column("packed").view(np.uint64)
                task, short, side = (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(0xFFFFFFFF), np.zeros(len(packed), np.int8)
            else:
                task, short, side = column("task"), column("short").view(np.uint64), column("side")
            keys = [Segment(short, 32, SHORT_BUDGET), Segment(column("c0").view(np.uint64), 64, SHORT_BUDGET + budget), Segment(column("c1").view(np.uint64), 64, SHORT_BUDGET + budget)]
            u, v, differ = forest(task, side, column("node"), keys, FORESTS)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(differ, pa.int64())], ["u", "v", "differ"])

    # so many rows a partition whatever the session's settings: that is what a Python worker holds
    parts = max(1, -(-nodes.count() * len(deals) // ROWS_HELD))
    found = tasks.repartition(parts, *by).mapInArrow(_lean(run), "u long, v long, differ long")
    return found.groupBy("u", "v").agg(F.min("differ").alias("differ")).withColumns({"of_u": F.col("u"), "of_v": F.col("v")})


def _parted(rows: DataFrame, group: int) -> DataFrame:
    """Tasks that are too large though all bits of their short fingerprints agree, as families of over `group` copies do: dealt to parts, every two parts a task."""
    hot = cut(rows.groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > group).select("task", F.ceil(F.col("n") / group).cast("int").alias("parts")))
    if not (m := hot.count()):
        return rows
    found = rows.join(F.broadcast(hot) if m <= SENT_ROWS else hot, "task", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    found = found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # sides 1 and 2 meet in every pair of parts; a side 0 meets itself once and other parts across
    one = F.when(F.col("side") == 0, F.least("part", "other")).when(F.col("side") == 1, F.col("part")).otherwise(F.col("other"))
    two = F.when(F.col("side") == 0, F.greatest("part", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("part"))
    side = F.when((F.col("side") > 0) | (F.col("part") == F.col("other")), F.col("side")).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return found.select(F.xxhash64("task", one, two).alias("task"), side.alias("side"), "short", "node", "c0", "c1")


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """Of edges (u, v, copy_u, copy_v, of_u, of_v) those whose texts' sets of shingles have a Jaccard similarity of at least `similarity`, as links (of_u, of_v) named u and v; texts: (node, copy, text)."""
    a = texts.select(F.col("node").alias("u"), F.col("copy").alias("copy_u"), F.col("text").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("copy").alias("copy_v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, np.ndarray] = (None, np.zeros(0, "<u8"))
        for batch in batches:
            near = []
            for one, two in zip(batch.column("a"), batch.column("b"), strict=True):
                x, other = shingle_set(one.as_py(), shingle), two.as_py()
                if known[0] != other:
                    known = (other, shingle_set(other, shingle))
                shared = len(np.intersect1d(x, known[1], assume_unique=True))
                near.append(shared >= similarity * (len(x) + len(known[1]) - shared))
            yield batch.select(["of_u", "of_v"]).filter(pa.array(near, pa.bool_())).rename_columns(["u", "v"])

    return edges.join(a, ["u", "copy_u"]).join(b, ["v", "copy_v"]).select("of_u", "of_v", "a", "b").mapInArrow(_lean(run), "u long, v long")


def dealt_copies(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with copy_u and copy_v, and (node, copies): a node of many edges has a copy of its text for every COPIES of them."""
    n = edges.count()
    degrees = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
    for end in ("u", "v"):
        edges = joined_counted(edges, degrees.withColumnRenamed("node", end), [end], "n", n).withColumn(f"copy_{end}", F.pmod(F.xxhash64("u", "v"), F.ceil(F.col("n") / COPIES)).cast("int")).drop("n")
    return cut(edges), degrees.select("node", F.ceil(F.col("n") / COPIES).cast("int").alias("copies"))


def nearest_of_each(candidates: DataFrame, most: int = NEAREST) -> DataFrame:
    """Of candidates (u, v, differ) the `most` of each u that differ least: as many as there are nodes, about, however large their groups are."""
    nth = F.row_number().over(W.partitionBy("u").orderBy("differ", "v"))
    return candidates.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def united(edges: DataFrame) -> DataFrame:
    """components(), in one task where there are no more than SENT_ROWS edges: its rounds are dozens of stages, whatever they move."""
    if edges.count() > SENT_ROWS:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]) for b in batches if b.num_rows]
        if held:
            ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            u, v = at.reshape(2, -1)
            parent = np.arange(len(ids))
            _unite(parent, u, v)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[_find(parent, np.arange(len(ids)))])], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(_lean(run), "node long, component long")


def similar_nodes(edges: DataFrame, texts: DataFrame, found: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """Candidates (u, v, differ, of_u, of_v, copy_u, copy_v), u > v, of different components, and (node, component) of all nodes so far, to what verified candidates connect beyond that.

    First every node's nearest candidate is verified, then all that still lead from one component to another; what lies within a
    component needs no proof. What is verified links components, not nodes, so that a group's links are about as many as the components
    it still has.
    """
    edge = ["u", "v", "copy_u", "copy_v", "of_u", "of_v"]
    left = edges
    for first in (True, False):
        if left.isEmpty():
            break
        tried = cut(left.groupBy("u").agg(F.min(F.struct("differ", *edge)).alias("x")).select("x.*").select(*edge)) if first else left.select(*edge)
        new = cut(verified(tried, texts, similarity, shingle).distinct())
        more = not new.isEmpty()
        if more:
            step = cut(united(new).select(F.col("node").alias("component"), F.col("component").alias("joined")))
            sent = F.broadcast(step) if step.count() <= SENT_ROWS else step
            found = cut(found.join(sent, "component", "left").select("node", F.coalesce("joined", "component").alias("component")))
        if first:
            left = left.join(tried.select("u", "v"), ["u", "v"], "left_anti")
            if more:
                left = left.drop("of_u", "of_v")
                for end in ("u", "v"):
                    left = left.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
                left = left.where("of_u <> of_v")
            left = cut(left)
    return found


# What short fingerprints may miss: pairs by common rare shingles.

# Of two sets of similarity t the larger shares at least a part t of its shingles, so in any one order of all shingles both have the first that they
# share among their first (1 - t) * size + 1. Rare ones first, few sets meet there. The order decides what this costs, not what it finds.

#: Counters by which the frequency of a shingle is told, about: powers of two, that many bits of its hash.
COUNTER_BITS = 20
#: Pieces in which a task's counters are added up.
PIECES = 64
#: Rows of shingles that one partition holds, about.
SHINGLES_HELD = 200_000
#: Rows of shingles that a task deals to the partitions at once.
DEALT = 1 << 20
#: Bytes of a shingle's and a row's hash that go through the shuffle. Two that agree in these give a candidate more, never one less.
HASH = 5
#: Pairs of rows that are looked at once.
PAIRS = 1 << 19
#: Pairs of parities that are compared at once.
COMPARED = 1 << 14


def frequencies(rows: DataFrame, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Of all texts, how many have a shingle of each counter, on a scale of quarters of a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, "<u4")
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, (shingle_set(text.as_py(), shingle) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, PIECES)], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        levels = [np.ceil(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(levels, pa.binary())], ["piece", "counts"])

    found = {r["piece"]: r["counts"] for r in rows.select("text").mapInArrow(_lean(count), "piece int, counts binary").repartition("piece").mapInArrow(add, "piece int, counts binary").collect()}
    return np.concatenate([np.frombuffer(found[k], np.uint8) for k in range(PIECES)]) if found else np.zeros(1 << COUNTER_BITS, np.uint8)


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of whole numbers with their width in bytes, byte by byte, so that what is zero in all rows costs next to nothing in a shuffle."""
    return b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in columns)


def _unpacked(held: bytes, *widths: int) -> list[np.ndarray]:
    planes, out = np.frombuffer(held, np.uint8).reshape(sum(widths), -1), []
    for k, width in enumerate(widths):
        x = np.zeros((planes.shape[1], 8), np.uint8)
        x[:, :width] = planes[sum(widths[:k]) : sum(widths[: k + 1])].T
        out.append(x.view("<i8").ravel())
    return out


def prefixes(rows: DataFrame, levels: np.ndarray, parts: int, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(key, text) to (part, held): the first shingles of each set, rare ones first, dealt to parts by their hash.

    held has, packed, many rows of the rest of the hash, the key, the size of the set and how many of it come after.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            token, key, size, rest = np.concatenate(held, axis=1)
            part = (token.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            token, at = (token.view(np.uint64) // np.uint64(parts))[order], _runs(part[order])
            ends = [*at[1:].tolist(), len(order)]
            blobs = [_packed((token[i:j], HASH), (key[order[i:j]], HASH), (size[order[i:j]], 4), (rest[order[i:j]], 4)) for i, j in zip(at.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[order[at]]), pa.array(blobs, pa.binary())], ["part", "held"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                found = shingle_set(text.as_py(), shingle)
                n = min(len(found), len(found) - int(np.ceil(similarity * len(found) - 1e-6)) + 1)
                if n:
                    first = found[np.lexsort((found, levels[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))[:n]]
                    held.append(np.stack([first.view(np.int64), np.full(n, key), np.full(n, len(found)), len(found) - 1 - np.arange(n)]))
            if sum(x.shape[1] for x in held) >= DEALT:
                yield dealt()
                held.clear()
        if held:
            yield dealt()

    return rows.select("key", "text").mapInArrow(_lean(run), "part long, held binary")


def met(token: np.ndarray, size: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Which rows have another row of their token by whose size the two sets may be similar."""
    order = np.lexsort((size, token))
    fits = (token[order][1:] == token[order][:-1]) & (size[order][:-1] >= similarity * size[order][1:] - 1e-6)
    return order[(np.r_[False, fits] | np.r_[fits, False])[: len(order)]]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys change, from 0 on."""
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


class _Parities:
    """Parities of nodes, by how many slots they have."""

    def __init__(self, odd: dict[int, bytes]) -> None:
        self.ids = np.array(sorted(odd), np.int64)
        held = [np.frombuffer(odd[k], "<u8") for k in self.ids.tolist()]
        self.longs = np.array([len(x) for x in held])
        self.at = np.zeros((13, len(held)), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.longs).tolist():
            # in n longs, also those of 2 n: sets of similar sizes are at most so far apart
            own = [(k, x if len(x) == n else x[:n] ^ x[n:]) for k, x in enumerate(held) if len(x) in (n, 2 * n)]
            self.at[n.bit_length(), [k for k, _ in own]] = np.arange(len(own))
            self.rows[n] = np.stack([x for _, x in own])

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many slots the nodes a[k] and b[k] differ, 0 where their numbers of slots are too far apart."""
        a, b = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        least, most, out = np.minimum(self.longs[a], self.longs[b]), np.maximum(self.longs[a], self.longs[b]), np.zeros(len(a), np.int64)
        for n, rows in self.rows.items():
            on = np.flatnonzero((least == n) & (most <= 2 * n))
            for k in range(0, len(on), COMPARED):
                some, at = on[k : k + COMPARED], self.at[n.bit_length()]
                out[some] = np.bitwise_count(rows[at[a[some]]] ^ rows[at[b[some]]]).sum(axis=1, dtype=np.int64)
        return out


def sharing(token: np.ndarray, node: np.ndarray, component: np.ndarray, size: np.ndarray, rest: np.ndarray, similarity: float = SIMILARITY, odd: dict[int, bytes] | None = None, nearest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v, differ) of nodes of different components that have a token in common and may, by sizes, places and parities, be similar; differ: at least so many shingles are not common.

    In a token's group, the rows of its largest component meet only those of the others: so a large group of copies that are known as such costs nothing.
    odd: each node's parities. nearest: of the pairs of a node of those others with one component, only one that differs least of each PAIRS that are looked at.
    """
    known = _Parities(odd) if odd else None
    out = [np.zeros((3, 0), np.int64)]
    order = np.lexsort((size, token))
    token, node, component, size, rest = token[order], node[order], component[order], size[order].astype(np.int64), rest[order].astype(np.int64)
    if len(token):
        at = _runs(token)
        mixed = np.minimum.reduceat(component, at) != np.maximum.reduceat(component, at)
        on = np.repeat(mixed, np.diff(np.r_[at, len(token)]))
        token, node, component, size, rest = token[on], node[on], component[on], size[on], rest[on]
    if len(token):
        group = np.cumsum(np.r_[0, token[1:] != token[:-1]])
        by = np.lexsort((component, group))
        at = _runs(group[by], component[by])
        n = np.diff(np.r_[at, len(by)])
        best = np.lexsort((n, group[by][at]))
        last = np.r_[_runs(group[by][at][best])[1:], len(best)] - 1
        main = component[by][at][best[last]]
        a = np.flatnonzero(component != main[group])
        key = (group << 32) + size
        low = np.searchsorted(key, (group[a] << 32) + np.ceil(similarity * size[a] - 1e-6).astype(np.int64))
        high = np.searchsorted(key, (group[a] << 32) + np.floor(size[a] / similarity + 1e-6).astype(np.int64), "right")
        ends = np.cumsum(high - low)
        start = 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            count = (high - low)[start:stop]
            one = np.repeat(a[start:stop], count)
            two = np.arange(len(one)) + np.repeat(low[start:stop] - np.cumsum(count) + count, count)
            both, common = size[one] + size[two], 1 + np.minimum(rest[one], rest[two])
            near = (component[one] != component[two]) & (common >= similarity / (1 + similarity) * both - 1e-6)
            one, two, differ, both = one[near], two[near], (both - 2 * common)[near], both[near]
            if known:
                differ = np.maximum(differ, known.differ(node[one], node[two]))
                near = differ <= (1 - similarity) / (1 + similarity) * both + 1e-6
                one, two, differ = one[near], two[near], differ[near]
            if nearest:
                some = _least(np.stack([node[one], component[two], differ]))
                one, two, differ = one[some], two[some], differ[some]
            found = np.stack([np.maximum(node[one], node[two]), np.minimum(node[one], node[two]), differ])
            out.append(found[:, _least(found)])
            start = stop
    found = np.concatenate(out, axis=1)
    return tuple(found[:, _least(found)])


def _least(pairs: np.ndarray) -> np.ndarray:
    """Which of the rows (u, v, differ) has the least differ of its pair."""
    order = np.lexsort(pairs[::-1])
    return order[_runs(pairs[0][order], pairs[1][order])] if len(order) else order


def _key(at: str) -> Column:
    """A short hash of a row's place, narrow enough to go with every shingle."""
    return F.xxhash64(at).bitwiseAND((1 << 8 * HASH) - 1)


def meeting(rows: DataFrame, named: DataFrame, levels: np.ndarray, parts: int, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(at, text) and (at, node, component) of one row of each node to (token, node, size, rest): the first shingles that nodes of different components share.

    Most first shingles are in one text alone, so they go through a shuffle as packed bytes, and only those that meet another are
    rows, to which node and component are joined.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(part, held) for batch in batches for part, held in zip(batch.column("part").to_pylist(), batch.column("held").to_pylist(), strict=True)]
        if found:
            columns = [_unpacked(held, HASH, HASH, 4, 4) for _, held in found]
            token, key, size, rest = (np.concatenate(x) for x in zip(*columns, strict=True))
            token += np.repeat(np.array([part for part, _ in found], np.int64), [len(x[0]) for x in columns]) << 8 * HASH
            on = met(token, size, similarity)
            whole = pa.RecordBatch.from_arrays([pa.array(token[on]), pa.array(key[on]), pa.array(size[on], pa.int32()), pa.array(rest[on], pa.int32())], ["token", "key", "size", "rest"])
            yield from (whole.slice(k, 1 << 16) for k in range(0, len(on), 1 << 16))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            whole = pa.concat_tables(held)
            token, component = (whole.column(c).to_numpy() for c in ("token", "component"))
            order = np.argsort(token, kind="stable")
            at = _runs(token[order])
            several = np.minimum.reduceat(component[order], at) != np.maximum.reduceat(component[order], at)
            on = order[np.repeat(several, np.diff(np.r_[at, len(token)]))]
            yield from whole.select(["token", "node", "size", "rest"]).take(pa.array(on)).to_batches(1 << 16)

    dealt = prefixes(rows.select(_key("at").alias("key"), "text"), levels, parts, similarity, shingle).repartition(parts, "part")
    shared = dealt.mapInArrow(_lean(meet), "token long, key long, size int, rest int").join(named.select(_key("at").alias("key"), "node", "component"), "key")
    return shared.repartition(parts, "token").mapInArrow(_lean(mixed), "token long, node long, size int, rest int")


def missed(shared: DataFrame, named: DataFrame, parts: int, nearest: bool = False, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of `meeting` and (node, component, odd) to candidates (u, v, differ, of_u, of_v), u > v, among which are all pairs of similar texts of different components; nearest: as in `sharing`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if held:
            whole = pa.concat_tables(held)
            token, node, component, size, rest = (whole.column(c).to_numpy() for c in ("token", "node", "component", "size", "rest"))
            ids, at = np.unique(node, return_index=True)
            odd = dict(zip(ids.tolist(), whole.column("odd").take(pa.array(at)).to_pylist(), strict=True))
            u, v, differ = sharing(token, node, component, size, rest, similarity, odd, nearest)
            of_u, of_v = (component[at[np.searchsorted(ids, x)]] for x in (u, v))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, differ, of_u, of_v)], ["u", "v", "differ", "of_u", "of_v"])

    found = shared.join(named, "node").repartition(parts, "token").mapInArrow(_lean(run), "u long, v long, differ long, of_u long, of_v long")
    return found.groupBy("u", "v", "of_u", "of_v").agg(F.min("differ").alias("differ"))


def grouped(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, budget: int = WIDE_BUDGET, group: int = GROUP) -> DataFrame:
    """(at, id, text), `at` a row's place, to (at, id, keep): keep is (last, id, at) of the first row, by id, of those reached through similar texts.

    The tries of fingerprints find nearly all groups; then common shingles name what may lead from one group to another beyond that, so that no similar pair is left out.
    """
    with _set(rows.sparkSession, RELEASED):
        prints = written(wide_fingerprints(rows, shingle), "prints")
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "at")).alias("first")
        nodes = written(prints.groupBy("shingles").agg(first, F.min("w").alias("w"), F.min("odd").alias("odd"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")

        def connected(candidates: DataFrame, found: DataFrame) -> DataFrame:
            edges, copies = dealt_copies(cut(candidates))
            wanted = copies.join(nodes, "node").select("node", "copies", F.col("first.at").alias("at"))
            copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
            texts = written(rows.select("at", "text").join(wanted, "at").select("node", copy, "text"), "texts")
            return similar_nodes(edges, texts, found, similarity, shingle)

        found = connected(nearest_of_each(wide_links(nodes.select("node", "w"), budget, group)), nodes.select("node", F.col("node").alias("component")))
        named = nodes.select("node", F.col("first.at").alias("at")).join(found, "node")
        total = prints.agg(F.sum(F.ceil((1 - similarity) * F.col("size")) + 1)).first()[0] or 0
        parts = max(1, -(-total // SHINGLES_HELD))
        shared = written(meeting(rows, named, frequencies(rows, shingle), parts, similarity, shingle), "shared")
        # the nearest first: what they connect is left out of all the others
        for nearest in (True, False):
            found = connected(missed(shared, nodes.select("node", "odd").join(found, "node"), parts, nearest, similarity), found)
        rooted = cut(nodes.join(found, "node").select("shingles", "n", "first", F.col("component").alias("root")))
        roots = cut(rooted.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("nodes")))
        named = cut(joined_counted(rooted, roots, ["root"], "nodes", nodes.count()).select("shingles", "n", "keep"))
        return joined_counted(prints.select("at", "id", "shingles"), named, ["shingles"], "n", prints.count()).select("at", "id", "keep")


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """(id, component_id) of all rows: the least id reached through texts of similar shingles, null where none has one."""
    rows = located(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "at")
    return grouped(rows, **how).select(F.col("id").alias(id), F.col("keep.id").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays.

    A text without words says nothing of its likeness to others, so its document stays. Rows without doc_id rank last in their group.
    """
    small_batches(spark)
    n = unused(docs, "at")["at"]
    rows = located(docs, n)
    found = grouped(rows.where(words(F.col("text")) > 0).select(F.col(n).alias("at"), F.col("doc_id").cast("long").alias("id"), "text"))
    leaving = cut(found.where("at <> keep.at").select(F.col("at").alias(n)))
    sent = F.broadcast(leaving) if leaving.count() <= SENT_ROWS else leaving
    return rows.join(sent, n, "left_anti").select(docs.columns)
