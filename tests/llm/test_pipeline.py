"""The pipeline as a whole against a plain version of its five stages, on a small table with planted copies."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import bpe, mixing, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """200 documents, with exact and near copies of some, nulls, blanks and an id that repeats."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    draw = random.Random(4)
    more, n = [], 10_000
    for _, text, lang, source, size in draw.sample([d for d in docs if 100 <= len((d[1] or "").split()) <= 600], 25):
        words = text.split(" ")
        words[draw.randrange(len(words))] = "replaced"
        more += [(n, text, lang, "copies", size), (n + 1, " ".join(words), lang, "copies", size)]
        n += 2
    more += [(20_000, None, None, None, None), (20_001, "", "en", None, 0), (20_002, " \n", "en", "x", 2), (20_003, "only five words of text", "en", "x", 23)]
    rows = spark.createDataFrame(docs + more, "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    return str(folder), docs + more


def plain_toxic(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out(F.col("doc_id"), 5, 0))
    lexicon = toxicity.Lexicon(model.words, model.stems)
    score = lambda text: 1 / (1 + math.exp(-(sum(a * b for a, b in zip(toxicity.features(text, lexicon), model.weights, strict=True)) + model.bias)))
    return [r for r in rows if score(r[1]) < 0.5]


def plain_exact(rows):
    last = {}
    for r in rows:
        last[r[1] or ""] = max(last.get(r[1] or "", r), r, key=lambda x: x[0])
    return list(last.values())


def plain_near(rows):
    def shingles(text):
        words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {r[0]: s for r in rows if (s := shingles(r[1]))}
    group = {i: i for i in sets}
    of = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    shared = Counter((min(a, b), max(a, b)) for own in of.values() for k, a in enumerate(own) for b in own[:k])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    return [r for r in rows if group.get(r[0], r[0]) == r[0]]


def plain_mix(rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    totals = Counter()
    for r in rows:
        totals[r[3]] += size[r[0]]
    totals = {s: n for s, n in totals.items() if n}
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (sum(totals.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * totals[s]}
        target |= {s: 3 * totals[s] if full else weight[s] * level for s in full or open_}
        open_ -= full or open_
    out = [r for r in rows if not size[r[0]]]
    for s in order:
        stream = sorted((r for r in rows if r[3] == s and size[r[0]]), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
        left = math.floor(target[s])
        for r in stream * mixing.REPEATS:
            take = min(left, size[r[0]])
            if take:
                out.append((r[0], r[1][: [m.end() for m in WORD.finditer(r[1])][take - 1]] if take < size[r[0]] else r[1], *r[2:]))
            left -= take
    return out


def test_pipeline_by_brute_force(spark, fixture):
    folder, rows = fixture
    stages, kept = [], rows
    for plain in (lambda x: plain_toxic(spark, folder, x), plain_exact, plain_near, plain_mix):
        kept = plain(kept)
        stages.append(kept)
    assert len(rows) > len(stages[0]) > len(stages[1]) > len(stages[2])
    path, pattern = bpe.default_files()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = sorted((r[0], r[1] or "", library.encode_ordinary(r[1] or "")) for r in stages[-1])
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["text"] or "", list(r["token_ids"])) for r in found) == expected
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in found)
