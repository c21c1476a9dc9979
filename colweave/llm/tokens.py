"""Token counts of whole texts with a public tokenizer file (Arrow functions, lengths only).

``word_bpe_49k.json`` drops white space, lower-cases, and never forms a token
across white space, so white space is a safe boundary: the tokens of a text
are the tokens of its white-space-separated words, in order. Words repeat, so
each Arrow task keeps a bounded table of words it has already encoded; only
new words reach the library, and all of them do. A text is taken in segments
of about ``SEGMENT_BYTES``, cut at white space, and segments are gathered
into batches of about ``BATCH_BYTES``, so neither one long text nor many short
ones decide how much memory a batch needs.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import begin

#: Segments of a long text end at the first white space after so many bytes.
SEGMENT_BYTES = 1 << 20
#: Bytes of text encoded together.
BATCH_BYTES = 4 << 20
#: Entries in each of the two word tables of a worker, which later tasks and other stages find in its memory: some 50 MB each.
CACHE_WORDS = 400_000
#: Words joined into one call of the library.
JOINED = 200

_SPACE = re.compile(rb"[ \t\n\r]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The text in pieces that end at white space, each of about ``size`` bytes."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while start < len(text):
        m = _SPACE.search(text, start + size) if start + size < len(text) else None
        end = m.start() if m else len(text)
        yield text[start:end]
        start = end


class WordEncoder:
    """Encodes texts word by word with the library; remembers words it has seen.

    The words of a batch are split and numbered by Arrow; only its distinct
    words are looked up, and only those not in the table are encoded. ``kind``
    decides what a word is worth: its number of tokens (``count``) or its token
    ids as little-endian unsigned 32-bit bytes (``ids``). Both tables are
    bounded; one that is full is cut back to the words of the batch at hand.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = kind
        self.none = 0 if kind == "count" else b""
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.full: dict[str, object] = {"": self.none}
        self.base: dict[str, object] = {"": self.none}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list:
        """The value of each word. A word of letters is one unit that ends with an end-of-word
        token, so such words are joined by blanks and the ids are cut after those tokens."""
        count = self.kind == "count"
        done: list[str] = []
        values: list = []
        other = [w for w in words if not w.isalpha()]
        plain = [w for w in words if w.isalpha()]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                other.extend(group)
                continue
            done.extend(group)
            if count:
                values.extend(np.diff(cuts, prepend=0).tolist())
            else:
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                values.extend([raw[i:j] for i, j in zip(at, at[1:])])
        found = dict(zip(done, values, strict=True))
        for w, ids in zip(other, self._ids(other), strict=True):
            found[w] = len(ids) if count else np.array(ids, dtype="<u4").tobytes()
        return [found[w] for w in words]

    @staticmethod
    def _stem(word: str) -> str:
        """The word without closing stops and commas, where they are units of their own: after
        a letter or a digit. After other signs they belong to one unit with these. What counts is the
        last character as the tokenizer sees it, in lower case and composed: some letters end in a mark there."""
        stem = word.rstrip(".,")
        if stem and not stem[-1].isascii():
            last = unicodedata.normalize("NFC", stem[-1].lower())[-1]
        else:
            last = stem[-1:]
        return stem if last.isalpha() or "0" <= last <= "9" else word

    def learn(self, new: list[str], batch: list[str]) -> None:
        """Put the new words of a batch into the table."""
        if len(self.full) + len(new) > CACHE_WORDS:
            self.full = {w: self.full[w] for w in batch if w in self.full} | {"": self.none}
        stems = [self._stem(w) for w in new]
        tails = [w[len(s) :] for w, s in zip(new, stems)]
        missing = list({s for s in [*stems, *tails] if s not in self.base})
        if len(self.base) + len(missing) > CACHE_WORDS:
            keep = {*stems, *tails, ""}
            self.base = {s: v for s, v in self.base.items() if s in keep}
        self.base.update(zip(missing, self._encode(missing), strict=True))
        base = self.base
        self.full.update((w, base[s] + base[t]) for w, s, t in zip(new, stems, tails))

    def batches(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, pa.Array, list]]:
        """For each batch of segments, in order: the index of each segment's text, the bounds of
        its words, the number of each word in the batch's vocabulary, the vocabulary's values."""
        held: list[bytes] = []
        of: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            for s in segments(t):
                # ASCII letters in lower case, as the tokenizer makes them, unless the
                # text could spell one of its special strings
                held.append(s if b"<|" in s else s.lower())
                of.append(i)
                size += len(s)
                if size >= BATCH_BYTES:
                    yield of, *self._values(held)
                    held, of, size = [], [], 0
        if held:
            yield of, *self._values(held)

    def _values(self, held: list[bytes]):
        split = pc.ascii_split_whitespace(pa.array(held, pa.string()))
        words = split.flatten().dictionary_encode()
        vocabulary = words.dictionary.to_pylist()
        full = self.full
        new = [w for w in vocabulary if w not in full]
        if new:
            self.learn(new, vocabulary)
        return np.asarray(split.offsets), words.indices, list(map(self.full.__getitem__, vocabulary))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        n = np.zeros(len(texts), np.int64)
        for of, bounds, words, values in self.batches(texts):
            sums = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[words.to_numpy()])])
            np.add.at(n, of, sums[bounds[1:]] - sums[bounds[:-1]])
        return n

    def ids(self, texts: list[bytes]) -> Iterator[tuple[int, memoryview]]:
        """(index of a text, bytes of the ids of its next segment), in order."""
        for of, bounds, words, values in self.batches(texts):
            taken = pa.array(values, pa.large_binary()).take(words)
            at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
            raw = memoryview(taken.buffers()[2]) if len(taken) else memoryview(b"")
            for i, a, b in zip(of, at[bounds[:-1]].tolist(), at[bounds[1:]].tolist()):
                yield i, raw[a:b]


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, kind: str) -> WordEncoder:
    """One encoder for each Python worker and kind of value (``count`` or ``ids``)."""
    key = (path, kind)
    begin(f"encoder {kind} {path}", lambda: _ENCODERS.pop(key, None))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, kind)
    return _ENCODERS[key]


def binary_texts(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens of every whole text.

    Returns ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``),
    one row per input row. Null and empty texts have no bytes and no tokens;
    null or repeated ids are kept as they are; other columns are not read, so
    their names cannot clash; an empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "count")
        for b in gathered(batches):
            texts = binary_texts(b.column("text"))
            n = enc.counts(texts)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(count, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Join short Arrow batches until they hold about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    # a worker lives on after its task: what Arrow keeps for later is given back
    pa.default_memory_pool().release_unused()
