"""Language identification, near duplicates, language-model scores and the pipeline."""

import random
import tracemalloc

import duckdb
import numpy as np
import pytest

from colweave.llm import langid, lm, neardup

from ..conftest import SF_MID, SF_SMALL
from . import brute, data
from .test_lines_items_quality import key


# language identification

def test_language_accuracy_on_held_out_documents(llm_spark):
    docs = llm_spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_MID}/documents.parquet'").fetchall())
    held = [d for d in lang if got[d]["held_out"]]
    assert set(got) == set(lang) and len(held) > 250
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.99 * len(held)


def test_prediction_sees_only_the_text(llm_spark):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    filters = langid.train(docs)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, filters).collect()}
    other = docs.selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert {-r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(other, filters).collect()} == one


def test_language_of_awkward_rows(llm_spark):
    df = data.documents(llm_spark)
    got = langid.identify(df).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4 and by[0]["score"] == 0
    assert langid.identify(data.empty(llm_spark)).count() == 0
    unlabelled = data.documents(llm_spark, [(r[0], r[1], None, *r[3:]) for r in data.document_rows()])
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_many_languages_take_more_words_of_bits(llm_spark):
    rng = random.Random(5)
    rows = []
    for lang in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 7)
        rows += [(1000 * lang + i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(60)), f"l{lang:02}", "s", 1) for i in range(9)]
    df = data.documents(llm_spark, rows)
    filters = langid.train(df)
    assert len(filters.masks) == 3
    got = langid.predict(df, filters, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(rows)


def test_copies_do_not_empty_a_language(llm_spark):
    rng = random.Random(11)

    def texts(letters, n):
        words = ["".join(rng.choices(letters, k=5)) for _ in range(30)]
        return [" ".join(rng.choices(words, k=60)) for _ in range(n)]

    own, other = texts("abcdefg", 4), texts("tuvwxyz", 20)
    rows = [(i, own[i % 4], "zz", "s", 1) for i in range(800)] + [(1000 + i, t, "bb", "s", 1) for i, t in enumerate(other)]
    df = data.documents(llm_spark, rows)
    filters = langid.train(df, sample=20)  # by rows one text of "zz" in 42 would be drawn
    assert filters.predict([t.encode() for t in own])[0] == ["zz"] * 4 and filters.predict([t.encode() for t in other])[0] == ["bb"] * 20


def test_long_texts_are_counted_whole():
    rng = np.random.default_rng(1)
    filters = langid.Filters(["a", "b"], [rng.integers(0, 4, 1 << 12).astype(np.uint32)], 12)
    text = " ".join(random.Random(4).choices(["one", "two", "seven", "été"], k=4000)).encode()
    whole = filters.shares([b"", text, b"short text", text])
    size, langid.BLOCK_BYTES = langid.BLOCK_BYTES, 333
    try:
        parts = filters.shares([b"", text, b"short text", text])
    finally:
        langid.BLOCK_BYTES = size
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert whole[1][1] == sum(len(langid.folded(text)) - n + 1 for n in langid.SIZES)


# near duplicates

def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def pair_rows():
    rng = random.Random(12)
    rows = data.distinct_ids(data.document_rows())
    texts = variants(rng, data.sentence(rng, 150, 4000), 60, 2) + variants(rng, data.sentence(rng, 400, 4000), 40, 6)
    texts += [data.sentence(rng, 12) for _ in range(10)] + ["tiny text", "Tiny  TEXT", "tiny text here"]
    shared = data.sentence(rng, 60, 4000)
    texts += [shared + " " + data.sentence(rng, 60 + i, 4000) for i in range(40)]
    return rows + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


def links_of(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_duplicates(df).collect()}


@pytest.mark.parametrize("block", [256, 9])
def test_links_match_all_pairs(llm_spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STAR", 20 if block == 9 else 512)
    monkeypatch.setattr(neardup._blocks, "__defaults__", (block,))
    monkeypatch.setattr(neardup._cross, "__defaults__", (block,))
    rows = pair_rows()
    want = brute.near_duplicates([(r[0], r[1]) for r in rows])
    assert links_of(data.documents(llm_spark, rows)) == want
    assert max(n for _, n in want.values()) > 30


@pytest.mark.parametrize("block", [256, 7])
def test_links_found_without_most_hubs(llm_spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "HUBS", 1)
    monkeypatch.setattr(neardup, "SPREAD", 1)
    monkeypatch.setattr(neardup._cross, "__defaults__", (block,))
    rows = pair_rows()[-150:]
    assert links_of(data.documents(llm_spark, rows)) == brute.near_duplicates([(r[0], r[1]) for r in rows])


def test_repeated_rows_and_null_ids(llm_spark):
    df = data.documents(llm_spark)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == df.count()
    assert {r["n_links"] for r in got if r["doc_id"] == 6} == {5}  # its copy, its repeat, upper case, null id, near copy
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) + ids.count(None) - (None in ids)
    assert 7 not in ids and 8 not in ids and {0, 1, 2, 3} <= set(ids)
    assert neardup.near_duplicates(data.empty(llm_spark)).count() == 0 == neardup.deduplicated(data.empty(llm_spark)).count()


def test_pruning_keeps_similar_pairs():
    least = neardup.least_equal()
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.VALUES
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (4000, neardup.VALUES), dtype=np.uint64).astype("<u4")
    same = rng.random(a.shape) < np.repeat([0.85, 0.8, 0.4, 0.1], 1000)[:, None]
    stay = np.bincount(neardup.surviving(a, np.where(same, a, a + 1)) // 1000, minlength=4)
    assert stay[0] == 1000 and stay[1] >= 999 and stay[2] <= 2 and stay[3] == 0


# language-model scores

def test_base_scores_match_rule(llm_spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 30)  # most words take the join
    rows = data.distinct_ids(data.document_rows())
    got = {r["doc_id"]: r for r in lm.score_documents(data.documents(llm_spark, rows)).collect()}
    want = brute.unigram([(r[0], r[1]) for r in rows])
    assert set(got) == set(want)
    for d, (held, n, known, train, base) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0


def test_scores_of_awkward_tables(llm_spark):
    df = data.documents(llm_spark)
    assert lm.score_documents(df).count() == df.count()
    assert lm.score_documents(data.empty(llm_spark)).count() == 0
    rows = [r for r in data.distinct_ids(data.document_rows()) if brute.unigram([(r[0], "x")])[r[0]][0]]
    got = lm.score_documents(data.documents(llm_spark, rows)).collect()  # nothing to learn from
    assert len(got) == len(rows) > 2 and {r["train_tokens"] for r in got} == {0} and {r["base_score"] for r in got} == {0.0}


def small_model(texts):
    signs = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)
    signs[lm.END] = len(texts)
    code = lm.prefix_code(signs)
    counts = [np.zeros((1 << bits, 2), np.int32) for _, bits in lm.PREDICTORS]
    bits = lm.Bits(texts, code, blocked=False)
    for c, slots in zip(counts, bits.slots()):
        np.add.at(c, (slots, bits.bit), 1)
    return lm.Mixer(code, [lm.log_odds(c) for c in counts]).fit(texts[:20], [np.minimum(c, lm.CAP).astype(np.uint8) for c in counts])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choices(["ta", "ri", "mo", "lek", "su", "an"], k=rng.randrange(1, 4))) for _ in range(80)]
    return [" ".join(rng.choices(words, k=80)).encode() for _ in range(300)]


def test_model_learns_and_scores_each_text_alone(corpus):
    model = small_model(corpus[:250])
    fresh = corpus[250:]
    together = model.score(fresh)
    assert np.allclose(together, [model.score([t])[0] for t in fresh], rtol=1e-5)
    rate = -together.sum() / np.log(2) / sum(map(len, fresh))
    assert rate < 0.45 * model.code[0][np.frombuffer(b"".join(fresh), np.uint8)].mean()
    long = b" ".join(fresh)  # several stretches
    assert len(long) > 2 * lm.STRETCH and -model.score([long])[0] / np.log(2) / len(long) < 1.1 * rate


def test_scores_are_probabilities(corpus):
    model = small_model([t[:40] for t in corpus[:60]])
    # every string of up to one symbol: its probability, and what is left for longer ones
    short = np.exp(model.score([b""] + [bytes([c]) for c in range(256)]))
    assert 0 < short.sum() < 1
    length, place, flat = model.code
    assert sum(2.0**-n for n in length) == pytest.approx(1.0)


def test_context_counts_add_up_by_levels(llm_spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    texts = [t.decode() for t in corpus[:90]]
    df = llm_spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    signs = np.bincount(np.frombuffer(b"".join(corpus[:90]), np.uint8), minlength=257)
    code = lm.prefix_code(signs)
    want = [np.zeros((1 << bits, 2), np.int64) for _, bits in lm.PREDICTORS]
    bits = lm.Bits(corpus[:90], code, blocked=False)
    for c, slots in zip(want, bits.slots()):
        np.add.at(c, (slots, bits.bit), 1)
    got = [np.zeros_like(c) for c in want]
    for r in lm.context_counts(df, code).collect():
        lm.add_block(got[r["t"]].reshape(-1)[2 * r["k"] * lm.SLOT_BLOCK :][: 2 * lm.SLOT_BLOCK], r["counts"])
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_segments_change_no_score_and_no_count(corpus, monkeypatch):
    model = small_model(corpus[:100])
    texts = [b" ".join(corpus[100:180]), b"", b" ".join(corpus[180:])[: 4 * lm.STRETCH], corpus[0]]
    whole = model.score(texts)
    slots = [np.bincount(s, minlength=1 << b) for s, (_, b) in zip(lm.Bits(texts, model.code, blocked=False).slots(), lm.PREDICTORS)]
    monkeypatch.setattr(lm, "SEGMENT", 2 * lm.STRETCH)
    monkeypatch.setattr(lm, "BATCH_BYTES", 3 * lm.STRETCH)
    parts = list(lm.segments(texts, model.code, blocked=False))
    assert len(parts) > 2 and len(texts[0]) > 3 * lm.SEGMENT and len(texts[2]) % lm.SEGMENT == 0
    assert np.allclose(model.score(texts), whole, rtol=1e-6)
    for i, (_, b) in enumerate(lm.PREDICTORS):
        found = sum(np.bincount(list(bits.slots())[i], minlength=1 << b) for _, bits in parts)
        assert np.array_equal(found, slots[i])


def test_long_text_needs_bounded_memory(corpus):
    model = small_model(corpus[:100])
    piece = b" ".join(corpus)
    peaks = []
    for size in (1 << 20, 4 << 20):
        text = (piece * (size // len(piece) + 1))[:size]
        tracemalloc.start()
        score = model.score([text])[0]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert np.isfinite(score) and score < 0
    assert peaks[1] < 1.2 * peaks[0] + (4 << 20)
    assert model.score([b"a" * (3 * lm.SEGMENT)])[0] < 0  # one word of three segments


def test_fit_leaves_own_counts_out_and_grows(llm_spark, corpus, monkeypatch):
    model = small_model(corpus[:100])
    bits = lm.Bits([corpus[0]], model.code, blocked=False)
    own = [np.zeros((1 << b, 2), np.uint8) for _, b in lm.PREDICTORS]  # counts of the text itself and no other
    for o, slots in zip(own, bits.slots()):
        np.add.at(o, (slots, bits.bit), 1)
    assert own[0].max() < lm.CAP
    for x, gate, y in model.unseen([corpus[0], corpus[0]], own):
        assert not gate.any() and not x[:-1].any() and len(y) == len(bits.bit)
    df = llm_spark.createDataFrame([(t.decode(),) for t in corpus] * 2 + [("",), (None,)], "text string")
    monkeypatch.setattr(lm, "FIT_TEXTS", 8)
    few, _ = lm.fit_sample(df)
    monkeypatch.setattr(lm, "FIT_SHARE", 0.5)
    monkeypatch.setattr(lm, "FIT_TASK_BYTES", 10000)
    many, tasks = lm.fit_sample(df)
    texts = [r["text"] for r in many.collect()]
    assert few.count() < 40 < 100 < len(texts) == len(set(texts)) and tasks > 3
    signs = np.bincount(np.frombuffer(b"".join(corpus), np.uint8), minlength=257)
    signs[lm.END] = len(corpus)
    fitted = lm.train_mixer(df.limit(450), lm.prefix_code(signs))
    start = lm.Mixer(fitted.code, fitted.tables)
    assert fitted.score(corpus[:50]).sum() > start.score(corpus[:50]).sum()


# pipeline

def test_pipeline_stages(llm_spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()
    for name, stage in pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        out = stage(llm_spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        out.write.parquet(path)
        docs = llm_spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF_SMALL}/documents.parquet'").fetchall())
            want = {d: t for d, _, _, t in brute.line_dedup([(d, source[d], t) for d, t in before.items()])}
            assert after == {d: t for d, t in want.items() if t == before[d] or t.strip()}
        elif name == "jaccard_join":
            assert set(after) == {c for c, _ in brute.near_duplicates(list(before.items())).values()}
        elif name == "decontamination":
            assert set(after) == {w[0] for w in brute.decontamination(list(before.items()), items) if not w[5]}
        before = after
    packed = pipeline.STAGES[-1][1](llm_spark, docs, SF_SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_pipeline_run(llm_spark):
    import corpus_pipeline as pipeline

    out = pipeline.run(llm_spark, SF_SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 150


def test_stages_take_awkward_rows(llm_spark):
    import corpus_pipeline as pipeline

    for df in (data.documents(llm_spark), data.empty(llm_spark)):
        for name, stage in pipeline.STAGES[:-1]:
            df = stage(llm_spark, df, SF_SMALL)
            assert df.columns == data.documents(llm_spark).columns, name
        assert pipeline.STAGES[-1][1](llm_spark, df, SF_SMALL).count() >= 0
    assert sorted([(1, None), (None, 2)], key=key)


def test_lm_fit_reads_all_training_texts(llm_spark, monkeypatch):
    """The fit of the starting weights takes every different training text, whatever their number."""
    corpus = [f"text {i} of " + "many words " * (i % 7 + 1) for i in range(600)]
    df = llm_spark.createDataFrame([(i, t) for i, t in enumerate([*corpus, *corpus[:50], "", None])], "doc_id long, text string")
    monkeypatch.setattr(lm, "FIT_TASK_BYTES", 10000)
    found, tasks = lm.fit_texts(df)
    assert sorted(r["text"] for r in found.collect()) == sorted(corpus)
    assert tasks == -(-sum(map(len, corpus)) // 10000)
    signs = np.bincount(np.frombuffer("".join(corpus).encode(), np.uint8), minlength=257)
    asked = []
    lm.train_mixer(df, lm.prefix_code(signs), lambda train: asked.append(train) or lm.fit_texts(train))
    assert len(asked) == 1 and lm.train_mixer.__defaults__ == (lm.fit_texts,)


def test_lm_unseen_texts_together_and_alone():
    """Inputs without a text's own counts are those of the text alone, of short ones together as of one in segments."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(n)).encode() for n in (3, 200, 0, 900, 60)]
    texts.append(texts[1])
    signs = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)
    signs[lm.END] = len(texts)
    code = lm.prefix_code(signs)
    bits = lm.Bits(texts, code, blocked=False)
    counts = [np.bincount(s * 2 + bits.bit, minlength=2 << b).reshape(-1, 2) for s, (_, b) in zip(bits.slots(), lm.PREDICTORS)]
    capped = [np.minimum(c, lm.CAP).astype(np.uint8) for c in counts]
    model = lm.Mixer(code, [lm.log_odds(c) for c in counts])
    x, gate, y = (np.concatenate(v, axis=-1) for v in zip(*model.unseen(texts, capped)))
    want = []
    for t in texts:
        own = lm.Bits([t], code)
        odds = []
        for slots, c, cap, table in zip(own.slots(), counts, capped, model.tables):
            mine = np.bincount(slots * 2 + own.bit, minlength=c.size).reshape(-1, 2)
            odds.append(np.where(cap.max(axis=1) == lm.CAP, table, lm.log_odds(c - mine))[slots])
        want.append((*model.inputs(own, odds), own.bit))
    wx, wg, wy = (np.concatenate(v, axis=-1) for v in zip(*want))
    assert x.shape == wx.shape and any((c == lm.CAP).any() for c in capped)
    got, all_of = np.vstack([x, gate, y]), np.vstack([wx, wg, wy])
    assert np.array_equal(got[:, np.lexsort(got)], all_of[:, np.lexsort(all_of)])


def test_lm_fit_goes_through_large_tasks_as_often_as_small_ones(corpus, monkeypatch):
    """Before, a task with 1 MB of texts or more went through them once, a smaller one three times."""
    model = small_model(corpus[:60])
    texts = [b" ".join(corpus[:12])[:2000]] * 550
    assert sum(map(len, texts)) > 1 << 20
    passes = []
    monkeypatch.setattr(model, "unseen", lambda texts, capped: passes.append(sum(map(len, texts))) or iter(()))
    for some in (texts[:3], texts):
        passes.clear()
        model.learn_weights(some, [])
        assert passes == [sum(map(len, some))] * 3


def test_lm_steps_on_the_jvm_are_those_in_numpy(llm_spark, monkeypatch):
    """Weights, outcomes and scores of the JVM's steps against those of Mixer, for short, long, empty and null texts."""
    monkeypatch.setattr(lm, "SEGMENT", 2 * lm.STRETCH)
    monkeypatch.setattr(lm, "BATCH_BYTES", 2 * lm.STRETCH)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{rng.integers(60)}" for _ in range(n)) for n in (900, 1, 6000, 40, 3000)] + ["ünï 日本 " * 50, "x" * 9000, ""]
    raw = [t.encode() for t in texts]
    signs = np.bincount(np.frombuffer(b"".join(raw), np.uint8), minlength=257)
    signs[lm.END] = len(raw)
    code = lm.prefix_code(signs)
    bits = lm.Bits(raw, code, blocked=False)
    counts = [np.bincount(s * 2 + bits.bit, minlength=2 << b).reshape(-1, 2) for s, (_, b) in zip(bits.slots(), lm.PREDICTORS)]
    odds, capped = [lm.log_odds(c) for c in counts], [np.minimum(c, lm.CAP).astype(np.uint8) for c in counts]
    assert max(map(len, raw)) > 2 * lm.SEGMENT and any((c == lm.CAP).any() for c in capped)
    model, kind = lm.Mixer(code, odds), "k int, value double, n double"
    start = model.weights.copy()
    seen = model.learn_weights(raw, capped)
    one, n = model.outcomes(raw, capped)
    model.set_refinement(one, n)
    df = llm_spark.createDataFrame([(t,) for t in [*texts, None]], "text string").coalesce(1)
    found = []
    for keep in (1 << 27, 200_000, 0):  # inputs of all texts, of some and of none are kept between rounds
        monkeypatch.setattr(lm, "FIT_KEEP_BYTES", keep)
        jvm = lm.engine(llm_spark, code)
        jvm.share(odds, capped)
        found.append(jvm.learned(df.filter("text is not null"), start, kind).orderBy("k").collect())
    assert found[0] == found[1] == found[2] and {r["n"] for r in found[0]} == {seen}
    assert np.allclose([r["value"] / seen for r in found[0]], model.weights.reshape(-1), atol=1e-4)
    got = jvm.outcomes(df.filter("text is not null"), model.weights, kind).orderBy("k").collect()
    assert np.array_equal([r["n"] for r in got], n) and np.array_equal([r["value"] for r in got], one)
    scores = [r[0] for r in df.select(jvm.score(df.text, model.weights, model.refine)).collect()]
    assert np.allclose(scores, model.score([*raw, b""]), rtol=1e-4)
    assert jvm.learned(df.limit(0), start, kind).count() == jvm.outcomes(df.limit(0), start, kind).count() == 0
