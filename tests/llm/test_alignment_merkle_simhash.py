"""Cross-tokenizer alignment, Merkle manifests and SimHash near duplicates against plain restatements."""

import random

import numpy as np
import pytest

from colweave.llm import alignment, merkle, simhash
from colweave.llm.tokens import tokenizer_path

from ..conftest import SF_SMALL
from . import brute, data


# alignment

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.B_FILE))


def aligned(df, **options):
    return [tuple(r) for r in alignment.alignment(df, **options).collect()]


def numbered(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_alignment_matches_whole_texts(llm_spark, libraries):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    want = brute.alignment([tuple(r) for r in docs.limit(60).collect()], *libraries)
    assert {r[0]: r[1:] for r in aligned(docs.limit(60))} == want


def test_alignment_of_any_text(llm_spark, libraries):
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", " \n", "\n ", "\u2581", "foo", "the", ".", " .", "...", "<|endoftext|>", "<s>", "</s>", "<0x41>", "日本", "é",
             "\u2009", "\u3000", "\x1c", "\x85", "\t", "'s", " 's", "1", "12", "İ", "ﬁ", "\U0001f600", "\x00", "   x", "aaaa"]
    texts = [None, "", " ", "  ", "a ", "\u2581", *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(1500))]
    want = brute.alignment(list(enumerate(texts)), *libraries)
    assert {r[0]: r[1:] for r in aligned(numbered(llm_spark, texts))} == want
    assert sum(w[0] > 0 for w in want.values()) > 1000 and sum(w[0] == 0 for w in want.values()) > 100


def test_alignment_of_awkward_rows(llm_spark, libraries, monkeypatch):
    rows = data.document_rows()
    df = data.documents(llm_spark, rows)
    got = aligned(df)
    assert len(got) == len(rows)
    want = brute.alignment([(i, r[1]) for i, r in enumerate(rows) if len(r[1] or "") < 20_000], *libraries)
    alone = aligned(data.documents(llm_spark, [r for r in rows if len(r[1] or "") < 20_000]))
    # null and repeated ids: compared as a bag
    assert sorted(r[1:] for r in alone) == sorted(want.values())
    assert aligned(data.empty(llm_spark)) == []
    # many small blocks give what one gives
    blocks = alignment.aligned_blocks(df, tokenizer_path(alignment.A_FILE), tokenizer_path(alignment.B_FILE), size=2000)
    assert blocks.filter("block is not null").count() > 3


def test_alignment_word_table_is_bounded(libraries, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CACHE_WORDS", 50)
    known = alignment.Aligner(tokenizer_path(alignment.A_FILE), tokenizer_path(alignment.B_FILE))
    assert known.safe
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(5)]
    fresh = [known.block(pa.array([t])) for t in texts]
    assert len(known.known) <= 50
    whole = known.block(pa.array(texts))
    assert [f["groups_sha256"][0] for f in fresh] == whole["groups_sha256"]
    # an unsafe vocabulary takes texts whole
    known.safe = False
    assert known.block(pa.array(texts))["groups_sha256"] == whole["groups_sha256"]


# Merkle manifest

def manifest_rows(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


def bag(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_manifest_matches_rule(llm_spark, fanout):
    rows = data.document_rows() + [(500, "Lone", "zz", "s", 4)]
    got = [tuple(r) for r in merkle.verified_manifest(data.documents(llm_spark, rows), fanout).collect()]
    assert bag(got) == bag(brute.merkle(manifest_rows(rows), fanout))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_few_rows(llm_spark):
    for rows in ([], [(1, "Text", "en", "s", 4)], [(1, "Text", None, "s", 4)] * 3, [(i, None, "en", None, None) for i in range(65)]):
        got = [tuple(r) for r in merkle.verified_manifest(data.documents(llm_spark, rows)).collect()]
        assert bag(got) == bag(brute.merkle(manifest_rows(rows)) if rows else [])


# SimHash

@pytest.mark.parametrize("radius", [2, 3, 4, 5])
def test_every_pair_shares_a_ball(radius):
    rng = random.Random(radius)
    for m in range(2, radius + 1):
        plan = simhash.plan_segments(m, radius)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randrange(radius + 1)):
                y ^= 1 << b
            assert any(((x >> first ^ y >> first) & (1 << bits) - 1).bit_count() <= r for first, bits, r in plan)


def test_near_fingerprints_are_connected(llm_spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # a hot value is dealt into many blocks
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    found = {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for x in base.tolist():
        for _ in range(80):
            y = x
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                y ^= 1 << b
            found.add(y)
    found = sorted(found)
    want = brute.reached(found, lambda a, b: (a ^ b).bit_count() <= 4)
    fps = llm_spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in found], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_fingerprints(fps).collect()]
    place = {x: i for i, x in enumerate(found)}
    label = simhash.roots(len(found), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
    assert [found[i] for i in label] == want
    with monkeypatch.context() as m:
        m.setattr(simhash, "best_plan", lambda n, radius=4: simhash.plan_segments(2, radius))
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_fingerprints(fps).collect()]
        label = simhash.roots(len(found), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
        assert [found[i] for i in label] == want


def test_simhash_matches_all_pairs(llm_spark):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    want = brute.simhash([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert got == want


def test_simhash_of_awkward_rows(llm_spark):
    rows = data.document_rows()
    df = data.documents(llm_spark, rows)
    got = [tuple(r) for r in simhash.simhash_components(df).collect()]
    assert len(got) == len(rows)
    known = data.distinct_ids(rows)
    want = brute.simhash([(r[0], r[1]) for r in known])
    assert {r[0]: r[1:] for r in got if r[0] is not None} == want
    lone = {r[1:] for r in got if r[0] is None}
    assert (want[0][0], 0) in lone and want[6] in lone  # null text with fingerprint 0; a copy of document 6
    assert simhash.simhash_components(data.empty(llm_spark)).count() == 0
    nameless = simhash.simhash_components(data.documents(llm_spark, [(None, "a b c d e f", "en", "s", 1)] * 2)).collect()
    assert [r["component_id"] for r in nameless] == [None, None]


def test_a_hot_fingerprint_is_dealt_over_tasks(llm_spark):
    rows = [(i, "the same words in most of all documents", "en", "s", 1) for i in range(3000)] + [(5000 + i, data.sentence(random.Random(i), 30), "en", "s", 1) for i in range(20)]
    got = simhash.simhash_components(data.documents(llm_spark, rows)).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["doc_id"] < 3000} == {0}


def test_long_texts_vote_in_parts(monkeypatch):
    text = data.sentence(random.Random(1), 900).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole
