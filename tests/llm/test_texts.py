"""Byte-level BPE, lines, toxicity and quality."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from marginalia.llm import bpe, lines, quality, toxicity
from tests.llm.helpers import EDGES, clashing, edges, empty, same_as_sql

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    path, pattern = bpe.default_files()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefghijklmnopqrstuvwxyz", "éàß漢😀x", " \n\t", "theanding", "0123456789", "'s re"])
def test_bpe_is_the_librarys(library, alphabet):
    codec = bpe.codec(*bpe.default_files())
    draw = random.Random(alphabet)
    for n in (1, 2, 3, 7, 40, 255, 256, 257, 600, 5_000):
        text = "".join(draw.choice(alphabet) for _ in range(n))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "acgt", "a", "="])
def test_bpe_of_very_long_runs(library, alphabet):
    """Pieces of a million letters end, and shorter ones are the library's."""
    codec = bpe.codec(*bpe.default_files())
    draw = random.Random(alphabet)
    text = "".join(draw.choices(alphabet, k=1_000_000))
    assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode(text[:30_000]) == library.encode_ordinary(text[:30_000])


def test_bpe_forgets_and_cuts_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "STRETCH", 10)
    codec = bpe.Codec(bpe.codec(*bpe.default_files()).vocabulary, bpe.default_files()[1])
    texts = ["one two three four five six seven eight nine ten", "short", None, "", "one two short again and again"]
    found = [[i for s in x for i in s] for x in codec.encode_batch(texts)]
    assert found == [library.encode_ordinary(t or "") for t in texts]


def test_bpe_table(spark, library):
    rows = bpe.round_trip(edges(spark).select("doc_id", "text"), *bpe.default_files()).collect()
    expected = []
    for id, text, *_ in EDGES:
        ids = library.encode_ordinary(text or "")
        expected.append((id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert bpe.round_trip(empty(spark).select("doc_id", "text"), *bpe.default_files()).count() == 0


def test_bpe_stage_keeps_columns(spark):
    found = bpe.stage(spark, clashing(edges(spark)), DATA)
    assert found.count() == len(EDGES) and "token_ids" in found.columns and "_token_ids" in found.columns
    assert {r["token_ids"] for r in found.select("token_ids").collect()} == {"kept"}
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in found.collect())
    assert bpe.stage(spark, empty(spark), DATA).count() == 0


def _cut_by_hand(texts: list[str | None], least: int = lines.LEAST_RUN) -> list[tuple[list[tuple[int, int]], str | None]]:
    """Of texts in order of rank the spans that go, and what stays."""
    seen, out = set(), []
    for text in texts:
        spans, run = [], []
        for unit in [*re.finditer(lines.UNIT, text or ""), None]:
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), unit[0])).strip(" ") if unit else ""
            if norm and norm in seen:
                run.append((unit.start(), unit.end(), len(norm)))
                continue
            if sum(size for *_, size in run) >= least:
                spans.append((run[0][0], run[-1][1]))
            run = []
            seen.add(norm)
        kept = None if text is None else "".join(text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)], strict=True))
        out.append((spans, kept))
    return out


PASSAGE = "".join(f"Sentence {k} of a passage that stands in many texts says {'very ' * (k % 4)}little. " for k in range(6))


def test_lines_equal_sql(spark):
    rows = edges(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    more = spark.createDataFrame([(k, f"Own words {k}" + " and" * k + f" {PASSAGE}\nThe end {k}. é {PASSAGE.upper()}") for k in range(20, 24)], "doc_id long, text string")
    rows = rows.select("doc_id", "text").unionByName(more)
    found = lines.without_repeats(rows)
    listed = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",")
    same_as_sql(found.select("doc_id", F.size("removed").alias("n_removed"), listed.alias("removed"), "text"), lines.ORACLE_SQL, documents=rows)


def test_lines_by_brute_force_whatever_the_ids(spark):
    """Ids that repeat or are missing, on different and on equal texts: each row keeps its own spans."""
    texts = [(1, PASSAGE), (2, "Mid line " + PASSAGE + "tail"), (2, "Another row of the same id. " + PASSAGE), (3, "short. short. short."), (3, None), (4, ""), (5, "\n \n"),
             (6, "漢字だけの段落です。" * 30 + "終わり"), (7, "新しい。" + "漢字だけの段落です。" * 30), (None, "no id, own beginning! " + PASSAGE + "\nown end"), (None, "no id either; " + PASSAGE), (None, "a third without id and of nobody's words")]
    expected = _cut_by_hand([t for _, t in texts])
    found = lines.without_repeats(spark.createDataFrame([(*r, k) for k, r in enumerate(texts)], "doc_id long, text string, nth int")).collect()
    found = {r["nth"]: ([tuple(x) for x in r["removed"]], r["text"]) for r in found}
    # rows of one id are ranked by hashes, here those of 2 and of no id: all but their first sentences stand in row 0 already
    assert found == dict(enumerate(expected))
    assert [len(found[k][0]) for k in range(len(texts))] == [0, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 0]


def test_repeated_rows_leave_one(spark):
    rows = [(7, PASSAGE), (7, PASSAGE), (None, PASSAGE * 2), (None, PASSAGE * 2)]
    found = [r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == ["", "", "", PASSAGE]


def test_lines_of_all_documents(spark):
    """The real table against the brute force, in rank order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    expected = {r["doc_id"]: x for r, x in zip(rows, _cut_by_hand([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: ([tuple(x) for x in r["removed"]], r["text"]) for r in lines.without_repeats(docs).collect()} == expected


def test_lines_edges(spark):
    found = lines.without_repeats(clashing(edges(spark)), spans="spans")
    assert found.count() == len(EDGES) and found.where("doc_id = 3").first()["text"] is None
    assert set(clashing(edges(spark)).columns) < set(found.columns)
    assert lines.without_repeats(empty(spark)).count() == 0


def test_grammar_weighs_context():
    lexicon = toxicity.Lexicon({"oaf": 3.0}, {"bleck": 3.0})
    feature = lambda text: {toxicity.FEATURES[k]: w for m in toxicity.clauses(text, lexicon) for k, w in m}
    assert feature("that OAF over there") == {"insult": 3.0}
    assert feature("you oaf") == feature("oaf, that is you") == {"targeted insult": 3.0}
    assert feature("he is not an oaf") == {"negated insult": 3.0}
    assert feature("somebody said oaf") == {"reported insult": 3.0}
    assert feature("a bleckish thing") == {"insult": 3.0} and feature("a blecky. calm") == {"insult": 3.0}
    assert set(feature("kill you")) == {"targeted threat"} or set(feature("kill you")) == {"threat"}
    assert feature("somebody said so. that oaf") == {"insult": 3.0}  # a clause ends what was reported
    assert feature("nothing here") == {} and feature("") == {} and feature(None) == {}


def test_transducers_compose():
    double = toxicity.Transducer(0, lambda s, x: (s + 1, 2 * x))
    add = toxicity.Transducer(0, lambda s, x: (s, x + 1))
    assert (double @ add).run([1, 2]) == [3, 5] and (add @ double).run([1, 2]) == [4, 6]


def _accuracy(spark, query, label):
    found = query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (found["predicted"] == found[label]).mean()


def test_toxicity_held_out(spark):
    assert _accuracy(spark, toxicity.op6_transducer_toxicity, "toxic") >= 0.93


def test_quality_held_out(spark):
    assert _accuracy(spark, quality.op7_attention_quality, "quality") >= 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_edges(spark, module):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (2, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(edges(spark), labels, F.lit(True))
    scores = module.scored(clashing(edges(spark)), model, out="s").collect()
    assert len(scores) == len(EDGES) and all(0 <= r["s"] <= 1 for r in scores)
    nothing = module.fit(empty(spark), labels.where("false"), F.lit(True))
    assert module.scored(empty(spark), nothing).count() == 0
    assert all(0 <= r["score"] <= 1 for r in module.scored(edges(spark), nothing).collect())


def test_attention_gradient():
    random_ = np.random.default_rng(0)
    x, first, y = random_.normal(size=(9, quality.WIDTH)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    shapes = {"E": (quality.WIDTH, 4), "e": (4,), "V": (4, 3), "v": (3,), "U": (4, 3), "u": (3,), "w": (3,), "c": (4,), "b": ()}
    parts = {k: random_.normal(size=s) for k, s in shapes.items()}
    fixed = {"mean": np.zeros(quality.WIDTH), "std": np.ones(quality.WIDTH)}
    loss = lambda p: -np.mean(y * np.log(q := quality.forward(p | fixed, x, first)["p"]) + (1 - y) * np.log(1 - q))
    grad = quality._gradient(parts, quality.forward(parts | fixed, x, first), y, first)
    for name, value in parts.items():
        flat = np.atleast_1d(value).ravel()
        k = random_.integers(len(flat))
        moved = []
        for step in (1e-5, -1e-5):
            changed = flat.copy()
            changed[k] += step
            moved.append(loss(parts | {name: changed.reshape(value.shape)}))
        assert np.isclose((moved[0] - moved[1]) / 2e-5, np.atleast_1d(grad[name]).ravel()[k], atol=1e-6)


def test_long_texts_have_all_their_passages():
    many = quality.encode(" ".join(f"w{k}" for k in range(100_000)))
    some = quality.spread(many)
    assert len(some) == quality.FIT_PASSAGES and (some[0] == many[0]).all() and (some[-1] == many[-1]).all() and len(quality.spread(many[:5])) == 5
    assert len(quality.encode("a " * 1000)) == -(-1000 // quality.PASSAGE) and len(quality.encode(None)) == 1
