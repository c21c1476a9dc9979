"""Exact top-k retrieval that skips blocks of the searched side by bounds (JOIN-3, JOIN-5, JOIN-14, VEC-1).

The searched rows lie in cells that hold alike rows, each cut into blocks of
bounded size; they are shuffled once, to their block, and never copied. What is
sent to tasks whole is a summary of each cell, of a size bounded by parameters, which gives an upper bound
for the score of a query with any row of the cell:

* dense vectors: cells are rows by their nearest pivot and their distance ring around it. With the
  angle between query and pivot and the least and largest angle of the cell's rows, the
  triangle inequality gives the least angle that a row can have to the query;
* sparse vectors: cells are rows by their heaviest term. The summary is an
  inverted index of the largest weight of each term in each cell; terms are numbered by a hash, so that it
  has a fixed size (terms that share a number make the bound wider, never wrong).

Queries go to blocks twice. First each is sent to the cells with the highest bounds
that hold k rows, which gives it a k-th score; then to those other cells
alone whose bound reaches that score. A skipped cell holds no row of the result,
so the result is exact. A task holds one block and takes its queries as a
stream; a block that many queries ask for is held by several tasks. Blocks are as large as a task can hold:
what is shuffled grows with the number of blocks times the queries. A few queries (their
bytes have a bound) are sent to every task instead, and the searched rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .similarity import CELLS, TIE_DECIMALS

#: Rows and nonzeros of a block of sparse vectors.
BLOCK_ROWS = 2048
BLOCK_NONZEROS = 1_000_000
#: Rows and numbers of a block of dense vectors, and queries and rows scored at once.
DENSE_ROWS = 1 << 17
DENSE_NUMBERS = 1 << 23
TILE_QUERIES, TILE_ROWS = 512, 8192
#: Nonzeros (16 bytes each) up to which all queries are sent to every task.
SENT_NONZEROS = 1_000_000
#: Numbers in a summary (8 bytes each), pivots and rings around a pivot.
SUMMARY = 4_000_000
PIVOTS = 4096
RINGS = 16
#: Blocks in a group (times ``direct`` of the vectors), and groups, up to which every query goes to every block: bounds cost more than they save.
DIRECT, DIRECT_GROUPS = 8, 256
#: Queries of one block in one task.
QUERY_ROWS = 1 << 16
#: Bounds are compared with scores with this much room for rounding.
SLACK = 1e-9

KEYS = ["grp", "a", "b"]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


class Dense:
    """Vectors as arrays of one length; cells by pivot (a) and ring (b)."""

    columns = ["vec"]
    block_numbers, direct = DENSE_NUMBERS, 8

    def __init__(self, right: DataFrame, cells: int):
        self.rings = RINGS if cells > 1 else 1
        # a sample by hash, as many as there are cells to be had; duplicates only leave cells empty
        rows = right.orderBy(F.xxhash64("id")).limit(min(PIVOTS, cells)).select("vec").collect()
        self.pivots = _unit(np.array([r["vec"] for r in rows], "float64")) if rows else np.zeros((0, 1))

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(x) @ self.pivots.T, -1.0, 1.0))

    def placed(self, right: DataFrame) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if not x.num_rows:
                    continue
                m = _matrix(x.column("vec"))
                angle = self.angles(m)
                a = angle.argmin(axis=1)
                near = angle[np.arange(len(a)), a]
                ring = np.minimum((near * (2 * self.rings / math.pi)).astype("int64"), self.rings - 1)
                # a zero vector has no angle: its cell stands for any
                zero = ~m.any(axis=1)
                lo, hi = np.where(zero, 0.0, near), np.where(zero, math.pi, near)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(a), pa.array(ring), pa.array(lo), pa.array(hi)], schema=_with(x, "a long, b long, lo double, hi double"))

        return right.mapInArrow(place, _ddl(right) + ", a long, b long, lo double, hi double")

    @staticmethod
    def sizes() -> list[Column]:
        return [F.sum(F.size("vec").cast("long")).alias("nonzeros")]

    @staticmethod
    def step(n: int) -> int:
        return TILE_QUERIES

    def summary(self) -> list[Column]:
        return [*self.sizes(), F.min("lo").alias("lo"), F.max("hi").alias("hi")]

    def learn(self, cells: list, rows: DataFrame) -> None:
        self.a = np.array([c["a"] for c in cells], "int64")
        self.lo, self.hi = (np.array([c[k] for c in cells], "float64") for k in ("lo", "hi"))

    def bounds(self, x: pa.RecordBatch) -> np.ndarray:
        m = _matrix(x.column("vec"))
        angle = self.angles(m)[:, self.a]
        out = np.cos(np.maximum(0.0, np.maximum(angle - self.hi, self.lo - angle)))
        out[~m.any(axis=1)] = 1.0
        return out

    @staticmethod
    def held(x: pa.Table):
        b = _unit(_matrix(x.column("vec").combine_chunks()))

        def score(q: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            m = _unit(_matrix(q.column("vec")))
            for at in range(0, len(b), TILE_ROWS):
                yield at, m @ b[at : at + TILE_ROWS].T

        return score


class Sparse:
    """Vectors as lists of terms and weights, 0 or more; cells by the heaviest term (a)."""

    columns = ["terms", "weights"]
    block_numbers, direct = BLOCK_NONZEROS, 1

    def __init__(self, right: DataFrame, cells: int):
        self.buckets = cells
        self.n = 0

    def placed(self, right: DataFrame) -> DataFrame:
        heaviest = F.element_at("terms", F.array_position("weights", F.array_max("weights")).cast("int"))
        return right.withColumn("a", F.pmod(F.xxhash64(heaviest), F.lit(self.buckets))).withColumn("b", F.lit(0).cast("long"))

    @staticmethod
    def sizes() -> list[Column]:
        return [F.sum(F.size("terms").cast("long")).alias("nonzeros")]

    @staticmethod
    def step(n: int) -> int:
        return max(1, CELLS // n)

    summary = sizes

    def learn(self, cells: list, rows: DataFrame) -> None:
        self.n = len(cells)
        self.slots = max(64, SUMMARY // max(self.n, 1))
        number = rows.sparkSession.createDataFrame([(*[c[k] for k in KEYS], i) for i, c in enumerate(cells)], "grp string, a long, b long, cell int")
        each = rows.select(*KEYS, F.explode(F.arrays_zip("terms", "weights")).alias("e"))
        most = each.groupBy(*KEYS, F.pmod(F.col("e.terms"), F.lit(self.slots)).alias("slot")).agg(F.max("e.weights").alias("w"))
        found = most.join(F.broadcast(number), KEYS).select("cell", "slot", "w").toPandas()  # at most SUMMARY rows
        self.most = np.zeros((self.slots, self.n))
        self.most[found["slot"].to_numpy(), found["cell"].to_numpy()] = found["w"].to_numpy()

    def bounds(self, x: pa.RecordBatch) -> np.ndarray:
        terms, w = x.column("terms"), x.column("weights").flatten().to_numpy()
        sizes = np.diff(np.asarray(terms.offsets))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(self.most[terms.flatten().to_numpy() % self.slots] * w[:, None], starts, axis=0)

    @staticmethod
    def held(x: pa.Table):
        terms, own = x.column("terms").combine_chunks(), x.column("weights").combine_chunks().flatten().to_numpy()
        vocabulary, codes = np.unique(terms.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(x.num_rows), np.diff(np.asarray(terms.offsets)))
        # the rows that have each term, and their weights
        order = np.argsort(codes, kind="stable")
        posted, weight, first = row[order], own[order], np.searchsorted(codes[order], np.arange(len(vocabulary) + 1))

        def score(q: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            t = q.column("terms")
            flat, w = t.flatten().to_numpy(), q.column("weights").flatten().to_numpy()
            of = np.repeat(np.arange(q.num_rows), np.diff(np.asarray(t.offsets)))
            at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
            known = vocabulary[at] == flat
            at, of, w = at[known], of[known], w[known]
            many = first[at + 1] - first[at]
            before = np.concatenate([[0], np.cumsum(many)])
            total, i = np.zeros(q.num_rows * x.num_rows), 0
            while i < len(at):
                j = max(int(np.searchsorted(before, before[i] + CELLS, side="right")) - 1, i + 1)
                n = many[i:j]
                spot = np.repeat(first[at[i:j]] - before[i:j] + before[i], n) + np.arange(int(n.sum()))
                total += np.bincount(np.repeat(of[i:j] * x.num_rows, n) + posted[spot], weights=np.repeat(w[i:j], n) * weight[spot], minlength=len(total))
                i = j
            yield 0, total.reshape(q.num_rows, x.num_rows)

        return score


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _with(x: pa.RecordBatch, ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = x.schema
    for f in ddl.split(", "):
        name, kind = f.split()
        schema = schema.append(pa.field(name, kinds[kind]))
    return schema


def _route(kind, cells: list, k: int, by_group: bool, second: bool):
    """Arrow function: a query row for each cell that it is sent to.

    The first time, for every group, the cells with the highest bounds that hold k rows between them;
    the second time those others whose bound reaches the k-th score (``kth``: one entry for each group seen).
    """
    groups = np.array([c["grp"] for c in cells], object)
    rows = np.array([c["n"] for c in cells], "int64")
    where = {g: np.flatnonzero(groups == g) for g in dict.fromkeys(groups)}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(len(cells), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = batch.slice(at, step)
                x = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in x.columns], schema=x.schema)
                bounds, own = kind.bounds(x), x.column("grp").to_pylist()
                seen = [{s["rgroup"]: s["score"] for s in r} for r in x.column("kth").to_pylist()] if second else None
                row, cell = [], []
                for g, place in where.items():
                    b = bounds[:, place]
                    order = np.argsort(-b, axis=1, kind="stable")
                    held = np.cumsum(rows[place][order], axis=1)
                    first = np.zeros_like(b, bool)
                    np.put_along_axis(first, order, np.concatenate([np.zeros((len(b), 1), bool), held[:, :-1] >= k], axis=1), axis=1)
                    go = ~first
                    if second:
                        least = np.array([s.get(g, -np.inf) for s in seen])
                        go = ~go & (b >= least[:, None] - SLACK)
                    if by_group:
                        go[np.array([o == g for o in own], bool)] = False
                    i, j = np.nonzero(go)
                    row.append(i)
                    cell.append(place[j])
                row, cell = (np.concatenate(r) if r else np.zeros(0, "int64") for r in (row, cell))
                for i in range(0, max(len(row), 1), 4096):
                    take = pa.array(row[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([x.column(c).take(take) for c in ("id", "grp", *kind.columns)] + [pa.array(cell[i : i + 4096].astype("int32"))],
                                                     names=["id", "grp", *kind.columns, "cell"])

    return fn


def _best(tiles, lid: np.ndarray, rid: np.ndarray, k: int, threshold: float | None, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best columns of each row (score desc, right id asc).

    ``tiles`` are (first column, scores of all rows with a run of columns) from left to right, ``rid`` ascends: a later column
    has to be better than the k-th best so far, so few scores of a tile are looked at.
    """
    near = 10.0 ** -TIE_DECIMALS
    floor = -np.inf if threshold is None else threshold
    kth = np.full(len(lid), -np.inf)
    row, col, score = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
    own, end = (np.searchsorted(rid, lid, side) for side in ("left", "right")) if exclude_self else (None, None)
    for at, s in tiles:
        width = s.shape[1]
        if exclude_self:
            a, b = np.clip(own - at, 0, width), np.clip(end - at, 0, width)
            for i in np.flatnonzero(b > a):
                s[i, a[i] : b[i]] = -np.inf
        least = np.maximum(kth + near / 4, floor - near)
        opened = np.flatnonzero(kth == -np.inf)
        if len(opened):
            # rows without k columns yet: from the tile, no more than its k best, ties included
            t = s[opened]
            t[~np.isfinite(t)] = -np.inf
            kk = min(k, width)
            least[opened] = np.maximum(least[opened], np.partition(t, width - kk, axis=1)[:, width - kk] - near)
        r, c = np.nonzero(s >= least[:, None])
        found = np.round(s[r, c], TIE_DECIMALS)
        keep = np.isfinite(found) & (found >= floor) & (found > kth[r])
        if not keep.any():
            continue
        row, col, score = (np.concatenate(x) for x in ((row, r[keep]), (col, c[keep] + at), (score, found[keep])))
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        row, col, score, place = row[keep], col[keep], score[keep], place[keep]
        kth[row[place == k - 1]] = score[place == k - 1]
    return row, col, score


def _answer(kind, score, q: pa.RecordBatch, rid: np.ndarray, group: str, k: int, threshold: float | None, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    """The k best of the held rows for each query."""
    step = kind.step(len(rid))
    for s in range(0, q.num_rows, step):
        x = q.slice(s, step)
        x = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in x.columns], schema=x.schema)
        lid = x.column("id").to_numpy()
        row, col, found = _best(score(x), lid, rid, k, threshold, exclude_self)
        yield pa.RecordBatch.from_arrays([pa.array(lid[row]), pa.array(rid[col]), pa.array(found), pa.array([group] * len(row), pa.string())],
                                         names=["lid", "rid", "score", "rgroup"])


def _score(kind, k: int, threshold: float | None, exclude_self: bool):
    """Arrow function over rows sorted by block, the block's own rows first: each query's k best rows of the block."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own = None, [], None
        for batch in batches:
            tags = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "sub", "part", "asks"))))
            cuts = [i for i in range(len(tags)) if not i or tags[i] != tags[i - 1]] + [len(tags)]
            for i, j in zip(cuts, cuts[1:]):
                *now, asks = tags[i]
                if now != key:
                    key, held, own = now, [], None
                x = batch.slice(i, j - i)
                if not asks:
                    held.append(x)
                    continue
                if own is None:
                    t = pa.Table.from_batches(held).sort_by("id") if held else None
                    own, held = (t.column("id").to_numpy(), t.column("grp")[0].as_py(), kind.held(t)) if held else (), []
                if own:
                    rid, group, score = own
                    yield from _answer(kind, score, x, rid, group, k, threshold, exclude_self)

    return fn


SCORES = "lid long, rid long, score double, rgroup string"


def _scored(routed: DataFrame, blocks: DataFrame, kind, n_blocks: int, k: int, threshold: float | None, exclude_self: bool) -> DataFrame:
    """The k best rows of every block that a query is sent to."""
    parallel = 2 * routed.sparkSession.sparkContext.defaultParallelism
    parts = routed.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / QUERY_ROWS), F.lit(math.ceil(parallel / n_blocks))).cast("int").alias("parts"))
    columns = ["id", "grp", *kind.columns]
    right = blocks.join(parts, "cell").select("cell", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), *columns)
    subs = blocks.select("cell", "subs").distinct()
    asked = routed.join(parts, "cell").join(subs, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), *columns)
    both = right.unionByName(asked).repartition("cell", "sub", "part").sortWithinPartitions("cell", "sub", "part", "asks")
    return both.mapInArrow(_score(kind, k, threshold, exclude_self), SCORES)


def _direct(left: DataFrame, right: DataFrame, kind, groups: list, k: int, threshold: float | None, exclude_self: bool, by_group: bool, block_rows: int) -> DataFrame:
    """Every query to every block: cheapest while a group has few of them."""
    subs = {g["grp"]: _subs(kind, g, block_rows) for g in groups}
    n_left, n_right, tasks = left.count(), sum(g["n"] for g in groups), 2 * left.sparkSession.sparkContext.defaultParallelism

    def dealt(times: int) -> tuple[int, int]:
        n_blocks = times * sum(subs.values())
        return n_blocks, max(math.ceil(n_left / QUERY_ROWS), math.ceil(tasks / n_blocks))

    # as many tasks as run at once, with the fewest copies: every block goes to each part of the queries and vice versa
    times = min(range(1, math.ceil(tasks / sum(subs.values())) + 1), key=lambda x: n_left * dealt(x)[0] + n_right * dealt(x)[1])
    parts, subs = dealt(times)[1], {g: times * n for g, n in subs.items()}
    columns = ["id", "grp", *kind.columns]
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    number = F.create_map(*[x for i, (g, n) in enumerate(subs.items()) for x in (F.lit(g), F.struct(F.lit(i).alias("cell"), F.lit(n).alias("subs")))])
    held = right.withColumn("p", number[F.col("grp")]).select(
        "p.cell", F.pmod(F.xxhash64("id"), F.col("p.subs")).cast("int").alias("sub"), part, F.lit(False).alias("asks"), *columns)
    places = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("cell"), F.lit(s).alias("sub")) for i, (g, n) in enumerate(subs.items()) for s in range(n)])
    if by_group:
        places = F.filter(places, lambda p: p["g"] != F.col("grp"))
    asked = left.withColumn("p", F.explode(places)).select(
        "p.cell", "p.sub", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks"), *columns)
    both = held.unionByName(asked).repartition("cell", "sub", "part").sortWithinPartitions("cell", "sub", "part", "asks")
    return both.mapInArrow(_score(kind, k, threshold, exclude_self), SCORES)


def _sent(left: DataFrame, right: DataFrame, kind, k: int, threshold: float | None, exclude_self: bool) -> DataFrame | None:
    """All queries, where they are few, to every task: the searched rows are read once and not shuffled. Sides of one group."""
    if (left.agg(*kind.sizes()).first()["nonzeros"] or 0) > SENT_NONZEROS:
        return None
    queries = left.select("id", "grp", *kind.columns).toArrow().combine_chunks().sort_by("id")
    shared = left.sparkSession.sparkContext.broadcast(queries)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, score, best = shared.value, None, None
        for x in batches:
            if not asked.num_rows or not x.num_rows:
                continue
            score = score or kind.held(asked)
            lid = asked.column("id").to_numpy()
            step = kind.step(asked.num_rows)
            for at in range(0, x.num_rows, step):
                y = x.slice(at, step)
                y = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in y.columns], schema=y.schema)
                order = np.argsort(y.column("id").to_numpy(), kind="stable")
                rid = y.column("id").to_numpy()[order]
                tiles = ((0, np.ascontiguousarray(s[order].T)) for _, s in score(y))
                row, col, found = _best(tiles, lid, rid, k, threshold, exclude_self)
                best = _merged(best, (row, rid[col], found), k)
        if best is not None:
            row, rid, found = best
            yield pa.RecordBatch.from_arrays([pa.array(lid[row]), pa.array(rid), pa.array(found), pa.array([""] * len(row), pa.string())],
                                             names=["lid", "rid", "score", "rgroup"])

    return right.select("id", *kind.columns).mapInArrow(fn, SCORES)


def _merged(best, more, k: int):
    """The k best of two lists of (query, right id, score)."""
    row, rid, score = more if best is None else (np.concatenate(x) for x in zip(best, more))
    order = np.lexsort((rid, -score, row))
    row, rid, score = row[order], rid[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], rid[keep], score[keep]


def _subs(kind, cell, block_rows: int) -> int:
    return max(1, math.ceil(cell["n"] / block_rows), math.ceil((cell["nonzeros"] or 0) / kind.block_numbers))


def blocked_topk(left: DataFrame, right: DataFrame, kind_of, k: int, threshold: float | None = None,
                 exclude_self: bool = False, by_group: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lid, rid, score, rgroup, rank: for each row of ``left`` and each group of ``right`` the k rows with the highest scores.

    Both sides: id (long), grp (string) and the columns of ``kind_of`` (``Dense`` or ``Sparse``). With ``by_group``, rows of
    the same group are not compared. Ties go to the smaller id. Rows are scored in blocks, and blocks that cannot hold a row of the result are left out.
    """
    w = Window.partitionBy("lid", "rgroup").orderBy(F.round("score", TIE_DECIMALS).desc(), F.col("rid").asc())
    if kind_of is Sparse and not by_group:
        out = _sent(left, right, kind_of, k, threshold, exclude_self)
        if out is not None:
            return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    groups = right.groupBy("grp").agg(F.count("*").alias("n"), *kind_of.sizes()).collect()
    if not groups:
        return left.sparkSession.createDataFrame([], SCORES).withColumn("rank", F.lit(1))
    if max(_subs(kind_of, g, block_rows) for g in groups) <= DIRECT * kind_of.direct and len(groups) <= DIRECT_GROUPS:
        out = _direct(left, right, kind_of, groups, k, threshold, exclude_self, by_group, block_rows)
        return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    left, right = cut_lineage(left), cut_lineage(right)
    n = sum(g["n"] for g in groups)
    kind = kind_of(right, max(1, min(math.ceil(n / block_rows), SUMMARY // 64 // RINGS // len(groups))))
    placed = cut_lineage(kind.placed(right))
    cells = placed.groupBy(*KEYS).agg(F.count("*").alias("n"), *kind.summary()).orderBy(*KEYS).collect()  # one row for each cell
    kind.learn(cells, placed)
    subs = [_subs(kind, c, block_rows) for c in cells]
    number = left.sparkSession.createDataFrame(
        [(*[c[x] for x in KEYS], i, s) for i, (c, s) in enumerate(zip(cells, subs))], "grp string, a long, b long, cell int, subs int")
    blocks = placed.join(F.broadcast(number), KEYS).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    rows = left.select("id", "grp", *kind.columns)
    schema = _ddl(rows) + ", cell int"

    def answers(routed: DataFrame) -> DataFrame:
        return _scored(cut_lineage(routed), blocks, kind, sum(subs), k, threshold, exclude_self)

    need = k + exclude_self
    first = cut_lineage(answers(rows.mapInArrow(_route(kind, cells, need, by_group, False), schema)))
    best = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == k)
    kth = best.groupBy(F.col("lid").alias("id")).agg(F.collect_list(F.struct("rgroup", "score")).alias("kth"))
    nothing = F.array().cast("array<struct<rgroup:string,score:double>>")
    again = rows.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", nothing))
    out = first.unionByName(answers(again.mapInArrow(_route(kind, cells, need, by_group, True), schema)))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
