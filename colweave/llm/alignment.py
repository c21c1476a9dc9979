"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers cut only inside what white space leaves whole: between a
character that is not white space and a blank, either has a token end (for the second this is
checked against its vocabulary). So texts are taken in words, each with
the blank before it; a word's groups and links are the same wherever it stands, and
each task aligns a word once, when it first meets it.

A group of one token on either side whose ids the identity map pairs (A id to
the B id of the same bytes) needs no look-up of pairs: how many documents hold it is counted in a vector as long as the
vocabulary, one for each task. Only other links are pairs that travel,
and of these each block of documents sends every different one once, with the number of its documents.
The counts of a block's pairs come back by a join on the pair; the block's documents are
then summed where they are stored. Nothing grows with the corpus but stored tables;
what is handed to tasks whole is bounded by the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from colweave.llm.common import store
from colweave.llm.tokens import gathered, tokenizer_path

#: Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20
#: Words a task remembers before it begins anew.
CACHE_WORDS = 200_000
#: Words encoded together.
JOINED = 200
_SPACED = re.compile(r"\s")
#: Bits of a pair's code that are the B id.
SHIFT = 32

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others follow from U+0100 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def a_vocabulary(tok) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    alphabet = byte_alphabet()
    out = []
    for i in range(tok.get_vocab_size()):
        entry = tok.id_to_token(i) or ""
        out.append(bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode())
    return out


def b_vocabulary(sp) -> list[bytes]:
    """The bytes of each piece: U+2581 is a blank, a byte piece its byte."""
    out = []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        out.append(bytes([int(piece[3:-1], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (n[0] numbers), then start[1], .."""
    total = int(n.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total) if len(n) else np.zeros(0, np.int64)


def _bounds(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each stretch of values."""
    total = _bounds(values)
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order; sorts, which takes less time here than hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Store:
    """Arrays of any lengths, one behind the other, added many at a time."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype), 0
        self.bounds, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(sizes) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.data[self.used : self.used + len(data)] = data
        self.bounds[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(data), self.n + len(sizes)

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.bounds[which + 1] - self.bounds[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.bounds[which], self.sizes(which))]


class Aligner:
    """Aligns words; remembers those it has seen, a bounded number."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = a_vocabulary(self.a), b_vocabulary(self.b)
        self.a_starts = np.array([x[:1] == b" " for x in self.a_bytes])
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # of pieces with the same bytes, whole pieces come before byte pieces, then the least id
        same: dict[bytes, int] = {}
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                same.setdefault(self.b_bytes[i], i)
        self.same = np.array([same.get(x, -1) for x in self.a_bytes])
        #: No piece has a blank behind another character, so no piece crosses from one word to the next.
        self.safe = all(b" " not in x.lstrip(b" ") for x in self.b_bytes)
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = [pa.array([d + end for d in digits]) for end in (b",", b"|", b";")]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes] = []  # the groups as written
        self.links = Store(np.int64)
        self.n = np.zeros((3, 1 << 12), np.int64)  # A tokens, B tokens, groups
        self.ok = np.zeros(1 << 12, bool)

    def a_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of all words, each behind a blank, and how many each word has. Words without white space
        are encoded many at a time: each begins with the one token that begins with a blank."""
        spaced = {i for i, w in enumerate(words) if not w or _SPACED.search(w)}
        plain = [i for i in range(len(words)) if i not in spaced]
        order, ids, n = [], [], []
        for at in range(0, len(plain), JOINED * 100):
            groups = [plain[i : i + JOINED] for i in range(at, min(at + JOINED * 100, len(plain)), JOINED)]
            for group, found in zip(groups, self.a.encode_batch_fast(["".join([" " + words[i] for i in g]) for g in groups], add_special_tokens=False)):
                found = np.array(found.ids, np.int64)
                starts = np.flatnonzero(self.a_starts[found])
                if len(starts) == len(group) and starts[0] == 0:
                    order.extend(group)
                    ids.append(found)
                    n.append(np.diff(starts, append=len(found)))
                else:
                    spaced.update(group)
        alone = sorted(spaced)
        for i, found in zip(alone, self.a.encode_batch_fast([" " + words[i] for i in alone], add_special_tokens=False)):
            order.append(i)
            ids.append(np.array(found.ids, np.int64))
            n.append(np.array([len(found.ids)]))
        ids, n = np.concatenate(ids), np.concatenate(n)
        place = np.argsort(np.array(order))
        return ids[_ranges(_bounds(n)[place], n[place])], n[place]

    def learn(self, words: list[str]) -> None:
        """Align words, each behind a blank, and number them on from those known."""
        raw = [b" " + w.encode() for w in words]
        a, na = self.a_ids(words)
        ib = self.b.encode(words, num_threads=1)
        if "" in words:  # a blank at the end of a text, which stands for itself
            ib[words.index("")] = [self.b.piece_to_id("▁")]
        nb = np.fromiter(map(len, ib), np.int64, len(ib))
        b = np.fromiter(chain.from_iterable(ib), np.int64, int(nb.sum()))
        size_a, size_b = _sums(self.a_size[a], _bounds(na)), _sums(self.b_size[b], _bounds(nb))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ok, text = (size_a == size) & (size_b == size), b"".join(raw)
        if not ok.all() or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != text or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != text:
            # a literal U+2581 and an unknown piece are not the bytes of the text
            parts = np.split(a, np.cumsum(na)[:-1])
            ok = np.array([b"".join([self.a_bytes[i] for i in x]) == t == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(raw, parts, ib)], bool)
            a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
            na, nb = na * ok, nb * ok
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = _distinct(np.concatenate([end_a, end_b]))  # every stretch between two ends lies in one token of either side: a link
        links = a[np.searchsorted(end_a, ends)] << SHIFT | b[np.searchsorted(end_b, ends)] if len(ends) else np.zeros(0, np.int64)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)  # group of each token
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        # tokens in the order of writing: the A tokens of a group, then its B tokens
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[of_b]
        ids = max(len(self.a_bytes), len(self.b_bytes))
        piece = np.zeros(len(a) + len(b), np.int64)
        piece[place_a] = a + ids * np.isin(end_a, cuts, assume_unique=True)
        piece[place_b] = b + 2 * ids * np.isin(end_b, cuts, assume_unique=True)
        written = pa.concat_arrays(self.digits).take(pa.array(piece))
        at = (np.frombuffer(written.buffers()[1], np.int32, len(piece) + 1)[np.concatenate([[0], np.cumsum(na + nb)])] if len(piece) else np.zeros(len(raw) + 1, np.int64)).tolist()
        data = written.buffers()[2].to_pybytes() if len(piece) else b""
        word_end = np.cumsum(size * ok)  # bytes of good words
        groups = np.diff(np.searchsorted(cuts, word_end, side="right"), prepend=0)
        first = len(self.text)
        while first + len(words) > self.n.shape[1]:
            self.n = np.concatenate([self.n, np.zeros_like(self.n)], axis=1)
            self.ok = np.concatenate([self.ok, np.zeros_like(self.ok)])
        self.n[:, first : first + len(words)] = na, nb, groups
        self.ok[first : first + len(words)] = ok
        self.text.extend([data[i:j] for i, j in zip(at, at[1:])])
        self.links.add(links, na + nb - groups)
        self.known.update(zip(words, range(first, first + len(words))))

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and the bounds of each text's words. Null and empty texts have none.

        A blank behind white space (or at the start) is no boundary: it stays in the word.
        """
        full = np.array([bool(n) for n in pc.binary_length(texts).fill_null(0).to_pylist()], bool)
        texts = texts.filter(pa.array(full))
        split = pc.split_pattern(texts, " ") if self.safe else pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        coded = split.flatten().dictionary_encode()
        vocabulary, words = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        bounds = np.asarray(split.offsets).astype(np.int64)
        open_end = np.array([not w or w[-1].isspace() for w in vocabulary], bool) if self.safe else np.zeros(len(vocabulary), bool)
        if open_end.any():
            parts, place = [], {w: i for i, w in enumerate(vocabulary)}
            for i, j in zip(bounds, bounds[1:]):
                part = words[i:j]
                if open_end[part].any():
                    part = np.array([place.setdefault(w, len(place)) for w in _closed([vocabulary[k] for k in part])], np.int64)
                parts.append(part)
            words, bounds, vocabulary = np.concatenate(parts), np.cumsum([0, *map(len, parts)]), list(place)
        new = [w for w in vocabulary if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = vocabulary
        if new:
            self.learn(new)
        slots = np.array([self.known[w] for w in vocabulary], np.int64)[words] if vocabulary else words
        sizes = np.zeros(len(full), np.int64)
        sizes[full] = np.diff(bounds)
        return slots, np.concatenate([[0], np.cumsum(sizes)])

    def block(self, texts: pa.Array) -> dict:
        """Everything about a block of documents: see ``BLOCK`` for the columns."""
        slots, bounds = self.number(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # one word whose bytes a tokenizer does not give back leaves its document without tokens
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.ok[slots]]] = True
        slots, doc = slots[~bad[doc]], doc[~bad[doc]]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        n = [_sums(x[slots], bounds) for x in self.n]
        text, listed = self.text, slots.tolist()
        sha = [hashlib.sha256(b"".join([text[k] for k in listed[i:j]])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        vocabulary, words = np.unique(slots, return_inverse=True)
        sizes = self.links.sizes(vocabulary)
        codes, links = np.unique(self.links.take(vocabulary), return_inverse=True)
        first = _bounds(sizes)
        # documents that hold a link: each different word of a document once, then each different link
        held = _distinct(doc * max(len(vocabulary), 1) + words)
        of, w = held // max(len(vocabulary), 1), held % max(len(vocabulary), 1)
        pairs = _distinct(np.repeat(of, sizes[w]) * max(len(codes), 1) + links[_ranges(first[w], sizes[w])])
        docs = np.bincount(pairs % max(len(codes), 1), minlength=len(codes))
        a, b = codes >> SHIFT, codes & ((1 << SHIFT) - 1)
        plain = self.same[a] == b
        return {
            "n_a": n[0], "n_b": n[1], "n_groups": n[2], "n_links": n[0] + n[1] - n[2], "groups_sha256": sha,
            "words": packed(words), "sizes": packed(np.diff(bounds)),
            "links": packed(links), "linked": packed(sizes), "codes_a": packed(a), "codes_b": packed(b),
            "pairs": codes[~plain], "docs": docs[~plain], "plain": (a[plain], docs[plain]),
        }


def _closed(words: list[str]) -> list[str]:
    """Words joined with the next where they are empty or end with white space; the last may be."""
    out, held = [], None
    for w in words:
        held = w if held is None else f"{held} {w}"
        if held and not held[-1].isspace():
            out.append(held)
            held = None
    return out if held is None else [*out, held]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs; the first byte tells how many."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


#: A stored row is a block of documents: lists with one entry for each document; words (the block's own
#: numbers) and how many each document has; links (numbers of codes) and how many each
#: word has; A and B ids of all codes; pairs: the codes off the fast path, docs: the documents of the block that
#: hold each. The last row of each task has a vector instead: by A id, the documents that hold it linked to its twin.
BLOCK = ("block long, ids array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,"
         " words binary, sizes binary, links binary, linked binary, codes_a binary, codes_b binary, pairs array<long>, docs array<long>, vector binary")
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` aligned within each document, as rows of ``BLOCK``. Store them before use: block numbers are those of one run."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = BLOCK.format(id=src.schema["id"].dataType.simpleString())
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        block, vector = TaskContext.get().partitionId() << 32, np.zeros(len(known.a_bytes), np.int64)

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in fields], schema=fields)

        for b in gathered(batches, size):
            found = known.block(b.column("text"))
            a, n = found.pop("plain")
            vector[a] += n
            yield row(block=block, ids=b.column("id"), **found)
            block += 1
        yield row(vector=vector.astype("<i8").tobytes())

    return src.mapInArrow(align, schema)


def plain_counts(vectors: DataFrame) -> DataFrame:
    """a, n: the vectors added up, those of a task in the task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("vector").to_pylist():
                v = np.frombuffer(v, "<i8")
                total = v if total is None else total + v
        if total is not None:
            a = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], names=["a", "n"])

    return vectors.select("vector").mapInArrow(add, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Tokens of A are those of a blank and the text, tokens of B those of the text (B sets the blank itself). Offsets at which
    tokens of both end cut them into groups; tokens that overlap are linked. The count of a pair of ids is the number of
    rows that hold it linked; n_best are the links whose count is the highest that their A id has, ties included, count_sum is the sum
    of all links' counts. Null and empty texts and texts that a tokenizer does not give back byte by byte (B reads U+2581 as a blank)
    have no tokens: zeros and ''. Repeated rows and null ids are rows like others; other columns are not read; an empty table gives an empty result.
    """
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    stored = store(aligned_blocks(docs, a_path, b_path, id_col, text_col), "aligned-blocks")
    blocks = stored.filter("block is not null")
    sent = store(blocks.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n")), "block-pairs")
    counts = store(sent.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # as many numbers as the vocabulary has ids
    plain = {r["a"]: r["n"] for r in plain_counts(stored.filter("vector is not null")).collect()}
    other = {r["a"]: r["n"] for r in counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("n")).collect()}
    size = max([*plain, *other], default=0) + 1
    of_twin, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    of_twin[list(plain)] = list(plain.values())
    for a, n in [*plain.items(), *other.items()]:
        best[a] = max(best[a], n)
    fetched = sent.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n")).alias("c"))
    fetched = fetched.select("block", F.col("c.pair").alias("known"), F.col("c.n").alias("counts"))
    columns = [c for c in blocks.columns if c not in ("pairs", "docs", "vector")]
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                def listed(c: str, k: int = k, batch: pa.RecordBatch = batch) -> pa.Array:
                    x = batch.column(c)[k].values
                    return pa.array([], pa.int64()) if x is None else x

                def numbers(c: str, k: int = k, batch: pa.RecordBatch = batch) -> np.ndarray:
                    return unpacked(batch.column(c)[k].as_py())

                a = numbers("codes_a")
                codes, pair, n = a << SHIFT | numbers("codes_b"), listed("known").to_numpy(), listed("counts").to_numpy()
                order = np.argsort(pair)
                at = np.minimum(np.searchsorted(pair, codes, sorter=order), max(len(pair) - 1, 0))
                count = of_twin[a]
                if len(pair):  # codes not sent are on the fast path
                    count = np.where(pair[order[at]] == codes, n[order[at]], count)
                links, first, words, ends = numbers("links"), _bounds(numbers("linked")), numbers("words"), _bounds(numbers("sizes"))
                sums = [_sums(_sums(x[links], first)[words], ends) for x in ((count == best[a]).astype(np.int64), count)]
                yield pa.RecordBatch.from_arrays(
                    [listed("ids"), *(listed(c) for c in names[1:5]), *map(pa.array, sums), listed("groups_sha256")], names=names)

    return blocks.select(*columns).join(fetched, "block", "left").mapInArrow(add, schema)
