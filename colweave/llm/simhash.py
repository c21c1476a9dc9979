"""SimHash near duplicates by multi-index hashing.

A fingerprint has 64 bits, one majority vote over the hashes of a text's
shingles for each. Two fingerprints that differ in at most ``RADIUS`` bits
differ, in one of their segments at least, by no more bits than that segment's
share; so every fingerprint stands in a table under the value of each segment
and asks, for each segment, for the values in a small Hamming ball. The ball is
listed from one side only: of two values the one that has the lowest differing
bit asks for the other. Fingerprints that meet under a value are compared whole.

Equal fingerprints are one row. How many segments there are follows from the
number of different fingerprints by estimated work alone; every number of
segments finds every pair. A value that many fingerprints share is dealt into
blocks, block against block, and a task hands back links to the least member
that it sees connected: fewer than it has fingerprints, however many pairs are near.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import spread_join, store
from colweave.llm.neardup import components
from colweave.llm.tokens import binary_texts, gathered

WORDS = 4
SEED = 42
BITS = 64
#: Differing bits of linked fingerprints.
RADIUS = 4
#: Shingles voting at a time, so that a long text needs no more memory.
CHUNK = 1 << 15
#: Fingerprints of a block where a segment's value is shared by more.
BLOCK = 1024
#: Pairs compared at a time.
PAIRS = 1 << 20
#: Cost of a shuffled row, in comparisons.
ROW_COST = 200


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text; 0 without words. Fewer words than a shingle has are one shingle."""
    tokens = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not tokens:
        return 0
    n = max(len(tokens) - words + 1, 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = tokens[at : at + CHUNK + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(t) + 1 for t in part]) - 1
        starts = [0, *(ends[: len(part) - words] + 1).tolist()] if len(part) >= words else [0]
        ends = ends[min(words, len(part)) - 1 :].tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id``, fp (the fingerprint as a signed long) of every row. Null texts have fingerprint 0."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            fp = np.array([fingerprint(t, words) for t in binary_texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return src.mapInArrow(vote, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def plan_segments(m: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of m segments: one of them at least differs by no more than its radius.

    The radii and the number of segments but one add up to ``radius``: were
    every segment to differ by more, the sum would be above ``radius``. A segment with
    radius -1 is not looked at.
    """
    total = radius - m + 1
    share = [total // m + (i < total % m) for i in range(m)]
    width = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(width[:i]), width[i], share[i]) for i in range(m) if share[i] >= 0]


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def best_plan(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """Of 2 to ``radius`` segments (Hamming balls of at least one bit) the number with the least estimated work for n fingerprints."""
    if radius < 2:
        raise ValueError("the radius must be 2 or more")

    def work(plan):
        # half of a ball is asked for, and every row meets those that share its value
        return sum((1 + len(_masks(bits, r)) / 2) * (ROW_COST + n / 2.0**bits) for _, bits, r in plan)

    return min((plan_segments(m, radius) for m in range(2, radius + 1)), key=work)


def _tables(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """fp, key (segment and value), own: whether the value is the fingerprint's own or one in its ball."""
    def segment(s: int, first: int, bits: int, radius: int) -> Column:
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

        def row(v: Column, own: bool) -> Column:
            return F.struct((v * len(plan) + s).alias("key"), F.lit(own).alias("own"))

        masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, radius)]).cast("array<long>")
        # of two values, the one with the lowest differing bit asks
        asks = F.filter(masks, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) != 0)
        return F.concat(F.array(row(value, True)), F.transform(asks, lambda m: row(value.bitwiseXOR(m), False)))

    rows = [segment(s, *p) for s, p in enumerate(plan)]
    return fps.select("fp", F.explode(F.concat(*rows)).alias("r")).select("fp", "r.key", "r.own")


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each is connected with by the links u-v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def _near(fp: np.ndarray, ends: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of near pairs: each row of ``left`` with the rows behind it up to the end of its group."""
    many = ends[left] - left - 1
    before = np.concatenate([[0], np.cumsum(many)])
    i = 0
    while i < len(left):
        j = max(int(np.searchsorted(before, before[i] + PAIRS, side="right")) - 1, i + 1)
        u = np.repeat(left[i:j], many[i:j])
        v = u + 1 + np.arange(len(u)) - np.repeat(before[i:j] - before[i], many[i:j])
        near = np.bitwise_count(fp[u] ^ fp[v]) <= radius
        yield u[near], v[near]
        i = j


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """a, b: fingerprints connected by steps of at most ``radius`` bits, enough to connect all that are.

    ``fps`` holds each fingerprint (fp) once and should be a stored table; ``n`` is their number.
    """
    rows = store(_tables(fps, best_plan(fps.count() if n is None else n, radius)), "segments")
    # values that more than a block share: own rows are dealt into nt blocks, all rows into nm
    large = store(
        rows.groupBy("key").agg(F.count("*").alias("all"), F.count_if("own").alias("owners"))
        .filter((F.col("all") > BLOCK) & (F.col("owners") > 0))
        .select("key", F.ceil(F.col("owners") / BLOCK).cast("int").alias("nt"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nm")), "large-segments")
    dealt = rows.join(large, "key", "left")
    t, m = (F.pmod(F.xxhash64("fp"), F.coalesce(c, F.lit(1))).cast("int") for c in ("nt", "nm"))
    place = "array<struct<t:int,m:int,asks:boolean>>"

    def places(last, spot):
        return F.transform(F.sequence(F.lit(0), last - 1), spot).cast(place)

    as_left = F.when(F.col("own"), places(F.col("nm"), lambda o: F.struct(t.alias("t"), o.alias("m"), F.lit(True).alias("asks")))).otherwise(F.array().cast(place))
    as_right = places(F.col("nt"), lambda o: F.struct(o.alias("t"), m.alias("m"), F.lit(False).alias("asks")))
    alone = F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("m"), F.col("own").alias("asks"))).cast(place)
    dealt = dealt.withColumn("p", F.explode(F.when(F.col("nt").isNull(), alone).otherwise(F.concat(as_left, as_right))))
    dealt = dealt.select("key", "p.t", "p.m", "fp", "p.asks").repartition("key", "t", "m").sortWithinPartitions("key", "t", "m", F.desc("asks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(x: pa.Table) -> pa.RecordBatch:
            fp = x.column("fp").to_numpy().view(np.uint64)
            asks = x.column("asks").to_numpy()
            starts = _starts(x)
            ends = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
            known, of = np.unique(fp, return_inverse=True)
            label = np.arange(len(known))
            for u, v in _near(fp, ends, np.flatnonzero(asks), radius):
                # what is connected already is told by its label
                label = roots(len(known), np.concatenate([np.arange(len(known)), of[u]]), np.concatenate([label, of[v]]))
            joined = np.flatnonzero(label != np.arange(len(known)))
            return pa.RecordBatch.from_arrays([pa.array(known[label[joined]].view(np.int64)), pa.array(known[joined].view(np.int64))], names=["a", "b"])

        for b in gathered(batches):
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            last = int(_starts(t)[-1])  # the last group may go on
            if last:
                yield links(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield links(held)

    return dealt.mapInArrow(compare, "a long, b long")


def _starts(t: pa.Table) -> np.ndarray:
    """Where a new (key, t, m) begins in sorted rows."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("key", "t", "m"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id_col``, fingerprint (16 hexadecimal digits) and component_id of every row.

    component_id is the smallest id reachable over fingerprints that differ in
    at most ``radius`` bits. Null, empty and blank texts have fingerprint 0, which is
    linked like any other. Repeated rows and rows without an id are linked by
    their fingerprints; a component that has no id at all has none (null). Other columns are not read, so
    their names cannot clash; an empty table gives an empty result.
    """
    signed = store(fingerprints(docs, id_col, text_col), "fingerprints")
    known = store(signed.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "known-fingerprints")
    labels = components(store(near_fingerprints(known.select("fp"), radius), "near-fingerprints"))
    named = store(known.join(labels.withColumnRenamed("cls", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "named-fingerprints")
    of = store(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "component-ids")
    facts = store(spread_join(named.select("fp", "comp", F.col("n").alias("docs")), of, "comp").select("fp", "component_id", F.col("docs").alias("n")), "fingerprint-components")
    return spread_join(signed, facts, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
