"""Token counts, packing, WARC archives: exact against the library, plain rules and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colweave.llm import packing, tokens, warc

from . import data
from .test_lines_items_quality import key, rows_of


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


ODD = [
    "<|startoftext|>hi<|ENDOFTEXT|> it's IT'S. a.b,c., ...,,, <|endoftext|>.", "İstanbul ΣΑΣ. naïve é Ḱ K  x y\x1cz\x85w 中文字. 😀👍🏽, 12,345.67 Ⅷ ﬁ",
    "", "   ", "x" * 5000, "İs ̇.", "d'accord, l'été. 'Re 'S s'S", "a\x00b\x0bc ﻿.", "<|startoftext |> <| STARTOFTEXT|>", "ǅ Ω. ŉ ß. ẞ,",
    "end).\n\t(start, é. 5., V., _., -.", "͸x. ́,",
]


def test_words_give_the_library_ids(library):
    enc = tokens.WordEncoder(tokens.tokenizer_path(), "ids")
    texts = ODD + [r[1] or "" for r in data.document_rows()]
    got = [b""] * len(texts)
    for i, raw in enc.ids([t.encode() for t in texts]):
        got[i] += raw
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé ß.,'\"!<|>\n\t09İ中😀́-sS"), max_size=40), max_size=4))
def test_any_text_gives_the_library_counts(texts):
    enc = tokens.encoder(tokens.tokenizer_path(), "count")
    want = [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert enc.counts([t.encode() for t in texts]).tolist() == want


def test_closing_stops_after_every_kind_of_letter():
    enc = tokens.encoder(tokens.tokenizer_path(), "count")
    letters = [chr(c) for c in (*range(0x250), *range(0x250, 0x2FA20, 37), 0x130, *range(0x958, 0x960), 0x9DC, 0xFB1D, 0xFB1F, 0x2ADC) if chr(c).isalpha()]
    texts = [f"x{c}{stop} y" for c in letters for stop in (".", ",", ".,")]
    want = [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert enc.counts([t.encode() for t in texts]).tolist() == want


def test_small_tables_and_segments_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 700)
    enc = tokens.WordEncoder(tokens.tokenizer_path(), "count")
    texts = [r[1] or "" for r in data.document_rows()][:25]
    monkeypatch.setattr(tokens, "segments", lambda t, s=tokens.segments: s(t, 300))
    assert enc.counts([t.encode() for t in texts]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_word_tables_of_a_worker_are_bounded():
    enc = tokens.WordEncoder(tokens.tokenizer_path(), "ids")
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(420_000)]
    for i in range(0, len(words), 20_000):
        for _ in enc.ids([" ".join(words[i : i + 20_000]).encode()]):
            pass
    assert 20_000 <= len(enc.full) <= 400_000 and len(enc.base) <= 400_000


def test_segments_end_at_white_space():
    text = (data.sentence(random.Random(1), 500) + "\n" + "y" * 400 + " end").encode()
    parts = list(tokens.segments(text, 100))
    assert b"".join(parts) == text and all(p[:1].isspace() for p in parts[1:]) and len(parts) > 5


def test_token_counts(llm_spark, library):
    rows = data.document_rows()
    got = rows_of(tokens.token_counts(data.documents(llm_spark)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(w[3] for w in want)
    assert tokens.token_counts(data.empty(llm_spark)).count() == 0


# packing

def placed_well(runs, used, histogram, capacity):
    ranks, bins = {}, {}
    for x, rank, n, at, per, offset in runs:
        for j in range(n):
            ranks.setdefault(x, []).append(rank + j)
            bins.setdefault(at + j // per, []).append((offset + j % per * x, x))
    assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(c)) for x, c in histogram.items()}
    assert len(bins) == used
    for pieces in bins.values():
        end = 0
        for offset, x in sorted(pieces):
            assert offset == end
            end += x
        assert end <= capacity


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_plans_place_every_piece(histogram, groups):
    runs, used = packing.plan_runs(histogram, 64, groups)
    placed_well(runs, used, histogram, 64)


def test_plan_is_near_the_bound():
    draw = np.minimum(2048, np.maximum(1, np.random.default_rng(5).lognormal(6.3, 0.9, 30_000).astype(int)))
    histogram = {int(x): int(c) for x, c in zip(*np.unique(draw, return_counts=True))}
    runs, used = packing.plan_runs(histogram, 2048)
    placed_well(runs, used, histogram, 2048)
    assert used <= 1.006 * draw.sum() / 2048 + 1
    many = {x: c * 1_000_000 for x, c in histogram.items()}  # the plan grows with the lengths, not with the pieces
    assert len(packing.plan_runs(many, 2048)[0]) < 5 * len(runs)


def test_plan_refuses_impossible_lengths():
    with pytest.raises(ValueError):
        packing.plan_runs({70: 1}, 64)


def test_packing_matches_the_library(llm_spark, library):
    rows = data.document_rows()
    out = packing.packed_documents(data.documents(llm_spark), 64, with_ids=True).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 64):
            part = np.array(ids[p : p + 64], "<u4").tobytes()
            want.append((r[0], p // 64, p, len(part) // 4, zlib.crc32(part), part))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 64
    assert len(bins) <= 1.05 * sum(w[3] for w in want) / 64 + 1
    assert packing.packed_documents(data.empty(llm_spark)).count() == 0


# WARC

PAGES = "page_id long, url string, html string, offset string, archive string, digest string"


def page_rows():
    big, small = "<p>" + "same payload " * 20, "tiny"
    rows = [(i, f"http://x.example/{i}", f"<html>{i}\r\n\r\nWARC/1.1\r\n é {'z' * i * 50}") for i in range(20)]
    rows += [(50 - i, f"http://copy.example/{i}", big) for i in range(10)]
    rows += [(60, "a url\r\nwith breaks", small), (61, None, small), (62, "u", None), (63, "u", ""), (None, "u", big), (None, None, None), (7, "again", "other " * 40)]
    rows += [rows[3], rows[22], (64, "long", "y" * 3_000_000)]
    return rows


def archive_rule(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        revisit = len(raw) >= 100 and to is not None and page != to
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def test_archives_round_trip(llm_spark):
    rows = page_rows()
    pages = llm_spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)
    got = rows_of(warc.archive_round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(got, key=key) == sorted(archive_rule(rows), key=key)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_selected_records_by_byte_ranges(llm_spark, monkeypatch):
    rows = page_rows()
    index = warc.write_archives(llm_spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES))
    some = index.filter("page_id % 3 = 0 AND record_type = 'response'")
    got = {(r["page_id"], r["payload"]) for r in warc.read_records(some, payload=True).collect()}
    kinds = archive_rule(rows)
    want = {(r[0], r[2] or "") for r, k in zip(rows, kinds) if r[0] is not None and r[0] % 3 == 0 and k[3] == "response"}
    assert got == want


def test_ranges_are_coalesced():
    rows = [{"offset": o, "length": 100} for o in (0, 100, 300, 200_000, 200_100, 9_000_000)]
    assert [(o, n, len(g)) for o, n, g in warc.ranges(rows)] == [(0, 400, 3), (200_000, 200, 2), (9_000_000, 100, 1)]
    wide = [{"offset": i * 1_000_000, "length": 1_000_000} for i in range(20)]
    assert all(n <= warc.READ_BYTES for _, n, _ in warc.ranges(wide)) and sum(len(g) for *_, g in warc.ranges(wide)) == 20


def test_archives_are_gzip_members_of_whole_records(llm_spark):
    rows = [(1, "http://a.example/", "<b>one</b>"), (2, "http://b.example/", "<b>two</b>")]
    index = warc.write_archives(llm_spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).coalesce(1)).orderBy("offset").collect()
    path = index[0]["archive"].removeprefix("file:").replace("//", "/")
    raw = open(path, "rb").read()
    assert sum(r["length"] for r in index) == len(raw)
    for r in index:
        record = zlib.decompress(raw[r["offset"] : r["offset"] + r["length"]], 31)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n")


def test_worker_forgets_tables_of_other_stages():
    """What one stage keeps in a Python worker is gone once a task of another stage begins there."""
    from colweave.llm import common, neardup, tokens

    enc = tokens.encoder(tokens.tokenizer_path(), "ids")
    list(enc.ids([b"some words to keep"]))
    assert tokens.encoder(tokens.tokenizer_path(), "ids") is enc
    common.begin("shingles", neardup._WORDS.clear)
    assert not tokens._ENCODERS
    neardup.shingles([b"some words to keep"])
    common.begin("shingles", neardup._WORDS.clear)
    assert len(neardup._WORDS) == 4
    common.begin("languages")
    assert not neardup._WORDS


def test_remembered_words_are_bounded(monkeypatch):
    from colweave.llm import neardup

    neardup._WORDS.clear()
    texts = [f"w{i} x{i} y{i} z{i} v{i} u{i}".encode() for i in range(50)]
    want = [neardup.shingles([t])[0].tolist() for t in texts]
    monkeypatch.setattr(neardup, "REMEMBERED", 20)
    assert [neardup.shingles([t])[0].tolist() for t in texts] == want
    assert len(neardup._WORDS) <= 20 + 6
