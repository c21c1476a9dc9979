"""Packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of lengths
describes the whole problem however many documents there are. On the driver,
which sees that histogram alone (at most ``capacity`` counts):

1. Lengths above ``capacity / SMALL`` are sorted and dealt into groups of equal
   cardinality; every length counts as the largest of its group.
2. Configurations, multisets of these few sizes that fit in a sequence, are
   chosen one after the other: the largest size still wanted, and the fullest
   sum that the other sizes make beside it. Each is used as often as the
   groups allow, so every step empties at least one group.
3. The actual pieces take the places of their groups: the rank of a piece among
   the pieces of its length tells its sequence.
4. The small pieces go, longest first, where they fit best, many at a time.

The result is a list of runs (``length``, ranks from .. to, first sequence,
pieces in each sequence, place of the first). Ranks are dealt out on the
executors: pieces are numbered within hashed buckets of a length, and the
buckets' counts give each bucket's first rank, so no length has to fit a task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colweave.llm.common import store
from colweave.llm.tokens import binary_texts, encoder, gathered, tokenizer_path

#: Lengths up to 1/SMALL of the capacity are small.
SMALL = 8
#: Groups of equal cardinality into which the large lengths are dealt.
GROUPS = 256
#: Pieces numbered together, about.
BUCKET_ROWS = 1 << 12

Run = tuple[int, int, int, int, int, int]


def _fullest(sizes: list[int], wanted: list[int], first: int, capacity: int) -> dict[int, int]:
    """Group -> copies: group ``first`` once and the fullest sum of groups beside it."""
    room = capacity - sizes[first]
    reached = np.full(room + 1, -1, np.int64)  # the group whose copy reached this sum first
    copies = np.zeros(room + 1, np.int64)
    reached[0] = len(sizes)
    for g, size in enumerate(sizes):
        have = wanted[g] - (g == first)
        if size > room or have <= 0:
            continue
        copies[:] = 0
        for _ in range(min(have, room // size)):
            new = np.flatnonzero((reached[size:] < 0) & (reached[:-size] >= 0) & (copies[:-size] < have)) + size
            if not len(new):
                break
            reached[new] = g
            copies[new] = copies[new - size] + 1
        if reached[room] >= 0:
            break
    total = int(np.flatnonzero(reached >= 0)[-1])
    chosen: dict[int, int] = defaultdict(int)
    chosen[first] = 1
    while total:
        g = int(reached[total])
        chosen[g] += 1
        total -= sizes[g]
    return dict(chosen)


def _grouped(histogram: dict[int, int], lengths: list[int], groups: int):
    """Groups of equal cardinality, largest lengths first: their sizes and their segments
    (length, first rank, pieces)."""
    total = sum(histogram[x] for x in lengths)
    if not total:
        return [], []
    per = -(-total // groups)
    sizes: list[int] = []
    segments: list[list[list[int]]] = []
    room = 0
    for x in sorted(lengths, reverse=True):
        rank, left = 0, histogram[x]
        while left:
            if not room:
                sizes.append(x)
                segments.append([])
                room = per
            n = min(left, room)
            segments[-1].append([x, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return sizes, segments


def plan_runs(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: int = SMALL) -> tuple[list[Run], int]:
    """Runs that place every piece of the histogram, and the number of sequences.

    A run (length, rank, n, sequence, per, offset) puts the pieces of that length
    with ranks rank .. rank + n - 1 into sequences from ``sequence`` on, ``per``
    in each, one behind the other from ``offset``. An empty histogram has none.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
    used = 0
    large = [x for x in histogram if x * small > capacity]
    sizes, segments = _grouped(histogram, large, groups)
    wanted = [sum(s[2] for s in g) for g in segments]
    for first in range(len(sizes)):
        while wanted[first]:
            config = _fullest(sizes, wanted, first, capacity)
            times = min(wanted[g] // m for g, m in config.items())
            bins = [(used, times, 0)]  # first sequence, sequences, filled
            used += times
            for g in (g for g, m in sorted(config.items()) for _ in range(m)):
                wanted[g] -= times
                filled = []
                for at, n, full in bins:
                    while n:
                        seg = segments[g][0]
                        k = min(n, seg[2])
                        runs.append((seg[0], seg[1], k, at, 1, full))
                        filled.append((at, k, full + seg[0]))
                        at, n, seg[1], seg[2] = at + k, n - k, seg[1] + k, seg[2] - k
                        if not seg[2]:
                            segments[g].pop(0)
                bins = filled
            for at, n, full in bins:
                if full < capacity:
                    free[capacity - full].append((at, n))
    rooms = sorted(free)
    for x in sorted((x for x in histogram if x * small <= capacity), reverse=True):
        rank, left = 0, histogram[x]

        def put(room: int, at: int, n: int, per: int, x: int = x) -> None:
            runs.append((x, rank, n * per, at, per, capacity - room))
            if rest := room - per * x:
                if not free[rest]:
                    insort(rooms, rest)
                free[rest].append((at, n))

        while left:
            i = bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms[i]
                at, n = free[room].pop()
                per = room // x
                if not free[room]:
                    rooms.pop(i)
            else:
                room, per = capacity, capacity // x
                at, n = used, -(-left // per)
                used += n
            if left >= n * per:
                put(room, at, n, per)
                rank, left = rank + n * per, left - n * per
                continue
            whole, rest = divmod(left, per)
            if whole:
                put(room, at, whole, per)
                rank += whole * per
            if rest:
                put(room, at + whole, 1, rest)
            if (spare := n - whole - bool(rest)) > 0:
                if not free[room]:
                    insort(rooms, room)
                free[room].append((at + whole + bool(rest), spare))
            left = 0
    return runs, used


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0,
                 with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: its ids, then ``end_id``.

    Only longer documents are cut; their last piece may be shorter. Null text
    counts as empty, so its only id is ``end_id``. Returns ``id_col``, piece,
    start, length, ids_crc32 and, if wanted, the ids (little-endian bytes).
    """
    path = tokenizer or tokenizer_path()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    last, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "ids")
        for b in gathered(batches):
            texts = binary_texts(b.column("text"))
            out: list[tuple[int, int, int, int, bytes | None]] = []
            held, at, piece = bytearray(), 0, 0

            def emit(to: int, doc: int) -> None:
                nonlocal piece, held
                while len(held) >= to and held:
                    raw = bytes(held[:step])
                    out.append((doc, piece, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                    del held[:step]
                    piece += 1

            for i, raw in enc.ids(texts):
                while at < i:  # the documents before are over
                    held += last
                    emit(1, at)
                    at, piece = at + 1, 0
                held += raw
                emit(step + 4, i)
            while at < len(texts):
                held += last
                emit(1, at)
                at, piece = at + 1, 0
            doc, number, length, crc, ids = (list(x) for x in zip(*out))
            number = np.array(number, np.int64)
            arrays = [b.column("id").take(pa.array(doc, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = GROUPS, small: int = SMALL,
         length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Place every row of ``pieces`` in a sequence: adds sequence_id and offset.

    ``pieces`` is read several times and should be a stored table. ``order``
    names columns that tell pieces apart; rows alike in all of them may change
    places, which changes nothing. An empty table gives an empty result.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(F.col(length_col).cast("long")).count().collect()}
    runs, _ = plan_runs(counts, capacity, groups, small)
    # sorted by length and rank, so that a piece's run is found by bisection
    grid = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6).T
    stride = max(counts.values(), default=0) + 1
    first = grid[0] * stride + grid[1]

    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by_length = Window.partitionBy("__length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(F.col(length_col).alias("__length"), F.col("__bucket")).agg(F.count("*").alias("__n"))
        .select("__length", F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(by_length), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy(length_col, "__bucket").orderBy(*order)
    ranked = (
        keyed.withColumn("__row", F.row_number().over(within) - 1)
        .join(starts, (F.col(length_col) == F.col("__length")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__rank", F.col("__start") + F.col("__row"))
    )
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rank = b.column(length_col).to_numpy().astype(np.int64), b.column("__rank").to_numpy()
            _, from_rank, _, at, per, offset = grid[:, np.searchsorted(first, x * stride + rank, side="right") - 1]
            nth = rank - from_rank
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(at + nth // per), pa.array(offset + nth % per * x)],
                names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "__rank").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place; see ``token_pieces`` and ``pack``."""
    return pack(store(token_pieces(docs, capacity, tokenizer, with_ids=with_ids), "pieces"), capacity)
