"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language would need one look-up per language. Stored
bit-sliced, position by position with a bit for every language, the filters
answer for all languages at once: the AND of an n-gram's few positions is the
set of languages that may contain it. A text's n-grams are counted by
language, the counts are corrected for each filter's rate of false positives,
and the language with the largest corrected share is the prediction.

Texts are taken as UTF-8 bytes with ASCII letters in lower case and everything
else in ASCII as blanks. An n-gram belongs to a language if it is at least
``SHARE`` times as frequent there as in the language where it is most
frequent, so a few mislabelled texts do not blur the filters. The filters are
learned from a bounded sample, about ``SAMPLE`` different texts of each language
however often each occurs, and have a fixed size; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import begin, store
from colweave.llm.tokens import binary_texts, gathered

#: Lengths of n-grams in bytes.
SIZES = (3, 5)
#: Different texts of each language to learn from (expected; at most a few per cent more).
SAMPLE = 3000
#: log2 of the positions of the filters, and positions of an n-gram.
POSITION_BITS = 21
HASHES = 2
SHARE = 0.2
MIN_COUNT = 2
#: Languages in one word of bits; more languages take more words.
WORD_BITS = 32
#: Texts whose best language has a smaller corrected share are in no known language.
MIN_SCORE = 0.4
#: Bytes of text looked up at once.
BLOCK_BYTES = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LETTER = re.compile(rb"[a-z]")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def folded(text: bytes) -> bytes:
    """The text as the n-grams see it, with a blank at either end; empty if it has no letter."""
    t = b" ".join(text.translate(_TABLE).split())
    if not t or not (_LETTER.search(t) or any(c.isalpha() for c in text.decode("utf-8", "replace"))):
        return b""
    return b" " + t + b" "


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Exact keys of the n-grams that start at each byte."""
    n = max(0, len(raw) - size + 1)
    key = np.full(n, size, np.uint64)
    for j in range(size):
        key = (key << np.uint64(8)) | raw[j : j + n]
    return key


def positions(keys: np.ndarray, which: int, bits: int) -> np.ndarray:
    k = keys * _MULTIPLIERS[which]
    k ^= k >> np.uint64(29)
    return ((k * _MULTIPLIERS[1 - which]) >> np.uint64(64 - bits)).astype(np.int64)


class Filters:
    """Languages and their bit-sliced filters: one array of masks for each word of languages."""

    def __init__(self, languages: list[str], masks: list[np.ndarray], bits: int):
        self.languages, self.masks, self.bits = languages, masks, bits
        rates = []
        for i in range(len(languages)):
            bit = (masks[i // WORD_BITS] >> np.uint32(i % WORD_BITS)) & np.uint32(1)
            rates.append(float(bit.mean()) ** HASHES)
        self.false_rate = np.array(rates)

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) share of n-grams in each language, corrected; n-grams of each text."""
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        total = np.zeros(len(texts), np.int64)
        block: list[tuple[int, bytes]] = []
        size, overlap = 0, max(SIZES) - 1
        for i, t in enumerate(texts):
            t = folded(t)
            for at in range(0, len(t), BLOCK_BYTES):
                block.append((i, t[at : at + BLOCK_BYTES + overlap], at + BLOCK_BYTES >= len(t)))
                size += len(block[-1][1])
                if size >= BLOCK_BYTES:
                    self._count(block, hits, total)
                    block, size = [], 0
        self._count(block, hits, total)
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), total

    def _count(self, block, hits, total) -> None:
        if not block:
            return
        raw = np.frombuffer(b"".join(b for _, b, _ in block), np.uint8)
        of = np.array([i for i, _, _ in block])
        length = np.array([len(b) for _, b, _ in block])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        for n in SIZES:
            keys = grams(raw, n)
            # a part that is not a text's last leaves n-grams beyond its block to the next part
            count = np.array([max(0, len(b) - n + 1) if last else min(BLOCK_BYTES, max(0, len(b) - n + 1)) for _, b, last in block])
            spots = [positions(keys, k, self.bits) for k in range(HASHES)]
            np.add.at(total, of, count)
            begin, end = np.minimum(start, len(keys)), np.minimum(start + count, len(keys))
            for w, masks in enumerate(self.masks):
                found = masks[spots[0]] & masks[spots[1]]
                for lang in range(w * WORD_BITS, min(len(self.languages), (w + 1) * WORD_BITS)):
                    sums = np.concatenate([[0], np.cumsum((found >> np.uint32(lang % WORD_BITS)) & np.uint32(1), dtype=np.int64)])
                    np.add.at(hits[:, lang], of, sums[end] - sums[begin])

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without letters or languages. Ties
        go to the language that sorts first."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        share, total = self.shares(texts)
        best = share.argmax(axis=1)
        score = np.where(total > 0, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best, total)], score


def train(labelled: DataFrame, sample: int = SAMPLE, bits: int = POSITION_BITS, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from labelled texts; rows without text or language are left out.

    Copies of a text count once, in the number of texts as in the sample. The
    driver receives the languages' numbers of texts and the filters, whose
    size is fixed by ``bits``.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    counts = {r[0]: r[1] for r in rows.select("lang", "h1", "h2").distinct().groupBy("lang").count().collect()}
    languages = sorted(counts)
    words = -(-len(languages) // WORD_BITS)
    size = 1 << bits
    if not languages:
        return Filters([], [], bits)
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 0.95 * sample / counts[k])))])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    draw = F.pmod(F.col("h1"), F.lit(1_000_000)) / 1_000_000
    drawn = rows.filter((draw < F.element_at(rate, F.col("lang"))) | (F.element_at(rate, F.col("lang")) >= 1))
    chosen = drawn.groupBy("lang", "h1", "h2").agg(F.first("text").alias("text")).select(F.element_at(number, F.col("lang")).alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("languages")
        for b in gathered(batches):
            lang = b.column("lang").to_numpy()
            texts = binary_texts(b.column("text"))
            for k in np.unique(lang):
                own = [folded(texts[i]) for i in np.flatnonzero(lang == k)]
                for n in SIZES:
                    parts = [grams(np.frombuffer(t, np.uint8), n) for t in own]
                    keys, c = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))],
                        names=["lang", "n", "key", "c"])

    gram_counts = store(
        chosen.mapInArrow(count, "lang int, n int, key long, c long").groupBy("lang", "n", "key").agg(F.sum("c").alias("c")), "gram-counts")
    totals = {(r["lang"], r["n"]): r["c"] for r in gram_counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    total = F.create_map(*[x for (k, n), c in totals.items() for x in (F.lit(k * 16 + n), F.lit(float(c)))]) if totals else None
    if total is None:
        return Filters(languages, [np.zeros(size, np.uint32) for _ in range(words)], bits)
    freq = gram_counts.withColumn("f", F.col("c") / F.element_at(total, F.col("lang") * 16 + F.col("n")))
    top = freq.groupBy("key").agg(F.max("f").alias("top"))
    # (word of languages, key) -> mask of the languages that the n-gram belongs to
    member = (
        freq.join(top, "key").filter((F.col("f") >= SHARE * F.col("top")) & (F.col("c") >= MIN_COUNT))
        .groupBy("key", (F.col("lang") / WORD_BITS).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, lang % {WORD_BITS})")).alias("mask"))
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy().view(np.uint64)
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(positions(keys, k, bits)), b.column("mask")], names=["word", "pos", "mask"])

    slices = member.select("key", "word", "mask").mapInArrow(spread, "word int, pos long, mask long").groupBy("word", "pos").agg(F.bit_or("mask").alias("mask"))
    got = slices.toArrow()
    masks = [np.zeros(size, np.uint32) for _ in range(words)]
    word, pos, mask = (got.column(c).to_numpy() for c in ("word", "pos", "mask"))
    for w in range(words):
        masks[w][pos[word == w]] = mask[word == w].astype(np.uint32)
    return Filters(languages, masks, bits)


def held_out(doc_id) -> "F.Column":
    """Documents that are not learned from: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, lang_pred and score (0 to 1) for every row, from the whole text alone.

    Null text, empty text and text without a letter get ``und`` and 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [id_col, *keep]
    src = docs.select(*[F.col(c) for c in names], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("languages")
        for b in gathered(batches, 4 << 20):
            lang, value = shared.value.predict(binary_texts(b.column("__text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang), pa.array(value)], names=[*names, "lang_pred", "score"])

    return src.mapInArrow(score, schema)


def accepted(docs: DataFrame, filters: Filters, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a known language.

    Rejected are ``und`` and scores below ``min_score``. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("languages")
        for b in gathered(batches, 4 << 20):
            lang, score = shared.value.predict(binary_texts(b.column(text_col)))
            yield b.filter(pa.array([x != "und" and y >= min_score for x, y in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the labelled rows that are not held out.

    One row per input row; a null id counts as not held out but is not learned
    from; an empty table gives an empty result.
    """
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return predict(docs, train(known, sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
