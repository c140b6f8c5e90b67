"""Near and exact duplicates, components, mixing and the pipeline."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import exact, mixing, simhash
from marginalia.llm.components import components
from marginalia.llm.shared import words
from tests.llm.helpers import EDGES, clashing, edges, empty, same_as_sql


def plain_fingerprint(text, k=3):
    parts = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + k]) for i in range(len(parts) - k + 1)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def family(n, flips, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    out = [b ^ np.uint64(sum(1 << int(x) for x in draw.choice(64, draw.integers(0, flips), replace=False))) for b in base for _ in range(6)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("group", [50_000, 3, 1])
@pytest.mark.parametrize("budget", [0, 2, 3])
def test_trie_join_links_all_within_budget(spark, group, budget):
    prints = family(60, 5)
    nodes = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(prints)), "fp": prints.view(np.int64)}))
    found = dict(components(simhash.links(nodes, budget, group)).collect())
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= budget)


def test_trie_join_of_a_dense_family():
    prints = np.unique(np.array([1 << a | 1 << b | 1 << c for a in range(24) for b in range(a) for c in range(b)], np.uint64))
    node = np.arange(len(prints))
    u, v, differ = simhash.forest(np.zeros(len(node), int), np.zeros(len(node), int), node, [simhash.Segment(prints, 64, 2)])
    assert len(u) == len(node) - 1 and len(set(u.tolist()) | set(v.tolist())) == len(node)
    assert (differ == np.bitwise_count(prints[u] ^ prints[v])).all() and differ.max() <= 2


def test_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4400)]
    found = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    known = {frozenset(p) for p in pairs}
    expected = brute_components(nodes, lambda a, b: frozenset((a, b)) in known)
    assert found == {n: nodes[k] for n, k in zip(nodes, expected, strict=True)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints_equal_brute_force(spark):
    texts = [t for _, t, *_ in EDGES if t is None or len(t) < 1000] + ["A b\x0bC d", "one", "one two", "é É é É"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint("a b c d\u00a0e f") == plain_fingerprint("a b c d\u00a0e f")


def test_near_duplicates_of_edges(spark):
    rows = edges(spark)
    found = simhash.near_duplicates(rows).collect()
    assert len(found) == len(EDGES)
    prints = [plain_fingerprint(t) if t is None or len(t) < 1000 else simhash.fingerprint(t) for _, t, *_ in EDGES]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((i for (i, *_), k in zip(EDGES, roots, strict=True) if k == r and i is not None), default=None) for r in roots}
    expected = [(e[0], least[r]) for e, r in zip(EDGES, roots, strict=True)]
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in found))) == sorted(map(str, expected))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_run_through_rows_without_id(spark, monkeypatch):
    """Fingerprints 0, 3 and 15: the ends differ in four bits, and only a row without id lies between."""
    monkeypatch.setattr(simhash, "fingerprints", lambda df, **_: df.select("id", F.col("text").cast("long").alias("fp")))
    rows = spark.createDataFrame([(5, "0"), (None, "3"), (6, "15"), (None, "-1"), (None, "-1"), (9, "4095")], "doc_id long, text string")
    found = sorted((r["fp"], r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert found == [(-1, None), (-1, None), (0, 5), (3, 5), (15, 5), (4095, 9)]


def test_skewed_tries_are_cut_until_small(spark):
    """All fingerprints agree in their low 40 bits, so a block's tasks stay hot for many levels."""
    draw = np.random.default_rng(4)
    prints = np.unique(np.array([sum(1 << int(40 + x) for x in draw.choice(24, 3, replace=False)) for _ in range(400)], np.uint64))
    nodes = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(prints)), "fp": prints.view(np.int64)}))
    found = dict(components(simhash.links(nodes, 2, 20)).collect())
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)


def test_majority_of_bits():
    draw = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 64, 777):
        x = draw.integers(0, 2**63, (n, 3), dtype=np.int64).astype(np.uint64)
        ones = np.unpackbits(x.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(axis=0)
        assert (np.unpackbits(simhash._majority(x).view(np.uint8), bitorder="little") == (2 * ones > n)).all()


def copies(n_words, changes, seed):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(n_words)]
    out = list(base)
    for k in draw.sample(range(n_words), changes):
        out[k] = f"x{draw.randrange(10**6)}"
    return " ".join(base), " ".join(out)


def jaccard(a, b, k=simhash.WIDE_SHINGLE):
    x, y = set(simhash._shingles(a, k).tolist()), set(simhash._shingles(b, k).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_finds_near_copies_and_leaves_others(spark):
    rows, twins = [], []
    for k in range(60):
        a, b = copies(300, 3, k)  # similarity of five-word shingles about 0.9
        rows += [(2 * k, a), (2 * k + 1, b)]
        twins.append((2 * k, 2 * k + 1))
    found = dict(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    split = dict(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), group=2).collect())
    assert found == split and len(found) == 120
    assert all(found[a] == found[b] for a, b in twins)
    assert all(found[k] in (k, k - k % 2) for k in found)


def test_similar_equals_brute_force(spark):
    """Families whose members lie on both sides of the threshold: whoever is linked is so by true similarity."""
    draw, texts = random.Random(9), []
    for f in range(12):
        base = [f"f{f}w{draw.randrange(10**6)}" for _ in range(400)]
        for m in range(6):
            out = list(base)
            for k in draw.sample(range(400), 2 * m + f % 3):
                out[k] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(out))
    texts += ["", "", "one two", "one two", "one two three", None]
    found = simhash.similar(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    found = dict(found.collect())
    expected = brute_components(texts, lambda a, b: jaccard(a, b) >= simhash.SIMILARITY)
    near = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= simhash.SIMILARITY]
    assert len(near) > 50 and sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)
    # no link without proof: what is one component here is one by brute force
    assert all(expected[k] == expected[c] for k, c in found.items())


def test_similar_leaves_no_pair_out(spark):
    """Pairs and chains just above and below the threshold, of all sizes, with a passage that all share; tries that may differ in no bit find hardly any of them."""
    draw, texts = random.Random(5), []
    passage = [f"p{k}" for k in range(40)]
    for f in range(60):
        n = draw.choice([6, 12, 30, 80, 200])
        base = [f"f{f}w{k}" for k in range(n)] + passage[: draw.choice([0, 10, 40])]
        for m in range(3):
            out = list(base)
            for _ in range(m * max(1, n // 60)):
                out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(out + [f"y{k}" for k in range(m * n // 12)]))
    texts += ["", None, "one two"]
    expected = brute_components(texts, lambda a, b: jaccard(a, b) >= simhash.SIMILARITY)
    values = [jaccard(a, b) for k, a in enumerate(texts) for b in texts[:k]]
    assert sum(0.8 <= x < 0.9 for x in values) > 15 and sum(0.6 < x < 0.8 for x in values) > 15
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert dict(simhash.similar(rows, budget=0).collect()) == dict(enumerate(expected))
    assert dict(simhash.similar(rows).collect()) == dict(enumerate(expected))


def test_sharing_names_all_similar_pairs_of_different_components():
    draw = np.random.default_rng(3)
    base = draw.permutation(10**6)
    sets = [np.unique(np.r_[draw.choice(base[30 * f : 30 * f + 30], draw.integers(22, 30), replace=False), base[-5:]]) for f in range(8) for _ in range(25)]
    component = draw.integers(0, 3, len(sets)) + 10 * (np.arange(len(sets)) // 25)
    rows = [(x, k, component[k], len(s), len(s) - i - 1) for k, s in enumerate(sets) for i, x in enumerate(s[: len(s) - int(np.ceil(0.8 * len(s) - 1e-6)) + 1])]
    u, v, differ = simhash.sharing(*map(np.array, zip(*rows)))
    true = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    found = set(zip(u.tolist(), v.tolist()))
    wanted = {(a, b) for a in range(len(sets)) for b in range(a) if component[a] != component[b] and true(a, b) >= 0.8}
    assert len(wanted) > 100 and wanted <= found and len(found) == len(u)
    assert all(component[a] != component[b] and d <= len(np.setxor1d(sets[a], sets[b])) for a, b, d in zip(u, v, differ))


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_similar_leaves_no_shuffle_files(spark):
    """What the stage moves is gone when it has moved it, so that its peak of disk is its largest step and not the sum of all."""
    rows = spark.createDataFrame([(2 * k + j, t) for k in range(60) for j, t in enumerate(copies(300, 3, k))], "doc_id long, text string")
    before = shuffle_bytes(spark)
    found = simhash.similar(rows)
    end = time.time() + 20
    while shuffle_bytes(spark) > before and time.time() < end:
        time.sleep(0.5)
    assert shuffle_bytes(spark) <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
    assert found.count() == 120


def test_shingles_that_meet():
    """Packed columns come back whole; of shingles in one text alone, or in texts too unlike in size, no row is made."""
    draw = np.random.default_rng(7)
    columns = draw.integers(0, 1 << 40, (2, 500)), draw.integers(0, 1 << 32, (2, 500))
    held = simhash._packed(*((x, 5) for x in columns[0]), *((x, 4) for x in columns[1]))
    assert len(held) == 500 * 18 and (np.array(simhash._unpacked(held, 5, 5, 4, 4)) == np.concatenate(columns)).all()
    token, size = draw.integers(0, 300, 500), draw.integers(1, 60, 500)
    wanted = {a for a in range(500) for b in range(500) if a != b and token[a] == token[b] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])}
    found = simhash.met(token, size)
    assert set(found.tolist()) == wanted and len(found) == len(wanted) < 450
    assert simhash.met(token[:1], size[:1]).tolist() == simhash.met(token[:0], size[:0]).tolist() == []


def test_candidates_grow_with_the_nodes_and_not_with_the_square_of_a_group(spark, monkeypatch):
    """Near copies of one text on both sides of the threshold, in many small tasks: a few candidates for each node, and still the groups of brute force."""
    monkeypatch.setattr(simhash, "ROWS_HELD", 400)
    monkeypatch.setattr(simhash, "SHINGLES_HELD", 400)
    met, dealt = [], simhash.dealt_copies
    monkeypatch.setattr(simhash, "dealt_copies", lambda edges: met.append(edges.count()) or dealt(edges))
    draw, texts = random.Random(11), []
    base = [f"w{k}" for k in range(150)]
    for m in range(240):
        out = list(base)
        for k in draw.sample(range(150), 1 + m % 3 + 3 * (m % 12 == 0)):
            out[k] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(out))
    sets = [set(simhash.shingle_set(t, simhash.WIDE_SHINGLE).tolist()) for t in texts]
    true = lambda a, b: len(a & b) / len(a | b)
    values = [true(a, b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(x >= 0.8 for x in values) > 500 and sum(0.65 < x < 0.8 for x in values) > 10_000
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = dict(simhash.similar(rows).collect())
    expected = brute_components(sets, lambda a, b: true(a, b) >= simhash.SIMILARITY)
    assert found == dict(enumerate(expected)) and len(set(expected)) > 1
    assert sum(met) <= 12 * len(texts)


def test_few_edges_are_united_in_one_task(spark, monkeypatch):
    draw = np.random.default_rng(1)
    edges = spark.createDataFrame(pd.DataFrame(draw.integers(-200, 200, (150, 2)), columns=["u", "v"])).where("u <> v").distinct()
    few = sorted(simhash.united(edges).collect())
    monkeypatch.setattr(simhash, "SENT_ROWS", 10)
    assert few == sorted(simhash.united(edges).collect()) and len(few) > 100 and simhash.united(edges.limit(0)).count() == 0


def test_parities_differ_in_no_more_slots_than_sets_in_shingles(monkeypatch):
    """A bound from below, close enough to tell sets well below the threshold; sets of unlike numbers of slots are compared in the fewer."""
    monkeypatch.setattr(simhash, "COMPARED", 50)
    draw = np.random.default_rng(8)
    sets, pairs = [], []
    for n in (1, 2, 31, 33, 60, 66, 300, 500, 515, 2_000, 3_000):
        base = draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        for k in range(8):
            other = np.r_[base[k * n // 30 :], draw.integers(0, 2**63, k * n // 30, dtype=np.int64).astype(np.uint64)]
            sets.append(np.unique(other[: len(other) - k * n // 60]))
    odd = {7 * k: simhash.parities(x).tobytes() for k, x in enumerate(sets)}
    assert {len(x) for x in odd.values()} >= {8, 16, 128, 512} and max(map(len, odd.values())) == simhash.MOST_BITS // 8
    a, b = np.divmod(np.arange(len(sets) ** 2), len(sets))
    least = simhash._Parities(odd).differ(7 * a, 7 * b)
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (least <= apart).all() and (least[a == b] == 0).all() and simhash.parities(sets[0][:0]).tolist() == [0]
    near = (apart > 20) & (apart < 0.3 * (np.array([len(x) for x in sets])[a]))
    assert near.sum() > 100 and (least[near] >= 0.6 * apart[near]).all()


def test_sharing_by_parities_and_nearest():
    """Parities leave out pairs that places let through, never one of similarity 0.8; with nearest, of each node's pairs with a component one stays."""
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**63, 150, dtype=np.int64).astype(np.uint64)
    change = lambda n: np.unique(np.r_[draw.permutation(base)[n:], draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)])
    sets = [change(int(n)) for n in draw.integers(5, 24, 150)]
    component = draw.integers(0, 4, len(sets))
    often = dict(zip(*np.unique(np.concatenate(sets), return_counts=True), strict=True))
    rows = []
    for k, s in enumerate(sets):
        first = sorted(s.tolist(), key=lambda x: (often[x], x))[: len(s) - int(np.ceil(0.8 * len(s) - 1e-6)) + 1]
        rows += [(x >> 1, k, component[k], len(s), len(s) - i - 1) for i, x in enumerate(first)]
    columns, odd = [np.array(x, np.int64) for x in zip(*rows, strict=True)], {k: simhash.parities(s).tobytes() for k, s in enumerate(sets)}
    true = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    plain, some, one = ({(a, b) for a, b, _ in zip(*simhash.sharing(*columns, odd=o, nearest=n), strict=True)} for o, n in ((None, False), (odd, False), (odd, True)))
    wanted = {(a, b) for a in range(len(sets)) for b in range(a) if component[a] != component[b] and true(a, b) >= 0.8}
    assert len(wanted) > 100 and wanted <= some < plain and len(some) < 0.8 * len(plain)
    assert one < some and {component[a] for a, _ in one} | {component[b] for _, b in one} == set(range(4)) and len(one) <= 3 * len(sets)


def test_shingle_sets_have_the_similarity_of_the_texts():
    texts = [t for k in range(20) for t in copies(80, 3 + k % 5, k)] + ["A b C d E a B c D e a b c d e", "a b", "A  B", "b a", "", None]
    for a in texts:
        for b in texts:
            x, y = simhash.shingle_set(a, 5), simhash.shingle_set(b, 5)
            assert (x[1:] > x[:-1]).all()
            assert (len(np.intersect1d(x, y)) / len(np.union1d(x, y)) if len(x) + len(y) else 1.0) == jaccard(a, b)


def test_similar_of_edges(spark):
    found = simhash.similar(edges(spark)).collect()
    assert len(found) == len(EDGES) and simhash.similar(empty(spark)).count() == 0
    of = {str(r["doc_id"]): r["component_id"] for r in found}
    assert of["7"] == of["8"] == 7 and of["3"] == of["4"] == of["5"] == 3


def test_simhash_stage(spark):
    found = simhash.stage(spark, clashing(edges(spark)), "")
    kept = sorted(str(r["doc_id"]) for r in found.collect())
    # of the two rows of doc_id 8, copies of 7, none stays
    assert kept == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 9, None, None])) and found.columns == clashing(edges(spark)).columns
    assert simhash.stage(spark, empty(spark), "").count() == 0


def result(found):
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.sha2(F.lit(""), 256).alias("text_sha256") if "digest" not in found.columns else F.col("digest").alias("text_sha256"))


def test_exact_equals_sql(spark):
    same_as_sql(result(exact.deduplicated(edges(spark))), exact.ORACLE_SQL, documents=edges(spark))
    assert exact.deduplicated(empty(spark)).count() == 0


def test_exact_tells_collisions_apart(spark):
    """With a digest of one letter most groups hold several texts; comparing bytes must separate them all."""
    found = exact.deduplicated(edges(spark), digest=lambda t: F.substring(t, 1, 1))
    plain = exact.deduplicated(edges(spark))
    key = lambda df: sorted(str((r["id"], r["keep"]["id"], r["n"])) for r in df.collect())
    assert key(found) == key(plain)


def test_exact_stream_goes_on(spark, tmp_path):
    """State outlives a run: a second run over new files adds to the first one's groups and forgets nothing."""
    schema = "id long, digest string, file string, row long"
    first = spark.createDataFrame([(1, "a", "f", 0), (2, "b", "f", 1), (3, "a", "f", 2)], schema)
    first.coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    exact.start(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([(0, "a", "g", 0), (9, "b", "g", 1), (4, "c", "g", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    exact.start(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = {r["digest"]: (r["keep"]["id"], r["n"]) for r in exact.groups_of(spark, f"{tmp_path}/out").collect()}
    assert found == {"a": (3, 3), "b": (9, 2), "c": (4, 1)}


def test_exact_stage(spark):
    found = exact.stage(spark, clashing(edges(spark)), "")
    assert sorted(str(r["doc_id"]) for r in found.collect()) == sorted(map(str, [1, 2, 4, 5, 6, 8, 9, None])) and found.columns == clashing(edges(spark)).columns


def sized(df):
    return df.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))


def test_mixing_equals_sql(spark):
    # ids that repeat, on one size or on several, and ids that are missing
    more = spark.createDataFrame([(8, "same", "en", "b", 4), (8, "other words here", "en", "b", 4), (8, "same too", "en", "b", 4), (8, "also same", "en", "b", 4), (None, "no id as well", "en", "a", 1), (None, "none", "en", "a", 1)], edges(spark).schema)
    rows = edges(spark).unionByName(more)
    found = mixing.mixed(sized(rows)).select("doc_id", "size", "source_size", "target", "taken", "first_position")
    same_as_sql(found, mixing.ORACLE_SQL, documents=rows)
    assert mixing.mixed(sized(empty(spark))).count() == 0


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 1, 1000, 5], [0, 0, 7], [5], [100, 100, 100, 100, 100, 100, 100]])
def test_targets_fill_up(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    weights, targets, left, open_ = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))], [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 1e-9:  # share what is left by weight, stop who is full, and share again
        share = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * share >= 3 * sizes[k]}
        for k in full or open_:
            targets[k] = float(3 * sizes[k]) if full else weights[k] * share
            left -= targets[k]
        open_ -= full or open_
    assert [found[f"s{k}"] for k in range(len(sizes))] == pytest.approx(targets)


def test_targets_of_many_sources(spark):
    """More sources than a task should hold: the numbers run on from one range to the next."""
    names = [f"host{k:05d}" for k in range(2_000)]
    draw = random.Random(2)
    rows = [(name, draw.randrange(1, 10_000)) for name in [*names, None]]
    found = mixing.targets(spark.createDataFrame(rows, "source string, source_size long").repartition(7)).collect()
    weights = {r["source"]: r["weight"] for r in found}
    assert [weights[n] for n in [*names, None]] == [mixing.WEIGHTS[k % 3] for k in range(2_001)]
    assert sum(r["target"] for r in found) == pytest.approx(sum(n for _, n in rows)) and all(r["target"] <= 3 * r["source_size"] for r in found)


def test_schedule_follows_the_curriculum(spark):
    rows = spark.createDataFrame([(k, f"s{k % 3}", 10) for k in range(3000)], "doc_id long, source string, size long")
    found = mixing.schedule(rows).toPandas()
    assert found["position"].between(0, 1).all() and found["position"].is_monotonic_increasing
    taken = found.groupby("source")["taken"].sum()
    assert taken.to_dict() == {"s0": 18750, "s1": 7500, "s2": 3750}
    early = found[found["position"] < 0.5].groupby("source")["taken"].sum() / taken
    assert early["s0"] > 0.6 and abs(early["s1"] - 0.5) < 0.01 and early["s2"] < 0.4


def test_mixing_stage(spark):
    rows = clashing(edges(spark))
    found = mixing.stage(spark, rows, "")
    assert found.columns == rows.columns
    uses = found.select("doc_id", "source", words(F.col("text")).alias("n")).toPandas()
    targets = mixing.mixed(sized(rows)).toPandas()
    assert uses["n"].sum() == targets["taken"].sum()
    assert (uses["n"] == 0).sum() == sum(1 for e in EDGES if not (e[1] or "").strip(" \t\n"))
    assert mixing.stage(spark, empty(spark), "").count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    found = corpus_pipeline.run(spark, sf).toPandas()
    assert set(docs.columns) <= set(found.columns) and len(found)
    assert found["doc_id"].value_counts().max() <= mixing.REPEATS
    toxic = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    clean = set(toxic[toxic["toxic"] == 0]["doc_id"])
    rejected = {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert not rejected & clean
    import hashlib

    whole = found[found["text"].map(lambda t: hashlib.sha256((t or "").encode()).hexdigest()) == found["decoded_sha256"]]
    assert len(whole) == len(found)
