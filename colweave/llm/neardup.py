"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Texts with equal sets are one class, so
copies cost one row each and nothing more. Classes get MinHash values in
bands; classes that share a band are candidates. A candidate pair's MinHash
values are compared a few at a time: after each step the similarity has a Beta
posterior, and a pair is dropped once the probability that it reaches the
threshold is below ``TOLERANCE``. What is left is verified on the shingles.

No group of candidates is ever expanded into all its pairs:

1. Every class of a band's bucket is compared with one hub of that bucket
   (``SPREAD`` hubs for the bands of a group, ``HUBS`` rounds with other hubs for
   what stays apart), and links are merged into components.
2. Where a bucket still holds classes of different components, those outside its
   largest component are compared with the others in blocks of ``BLOCK`` classes
   inside tasks, first by MinHash values, then exactly. A task hands back
   only links that join what it does not yet see joined: fewer than it has classes.
3. All links lie within components. They are counted there, block against
   block, on whole shingle sets; a task hands back one sum for each class.

A pair at the threshold shares no band with a probability of (1 - 0.8^4)^32, about
5e-8, and is dropped by mistake with at most ``TOLERANCE``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import begin, store
from colweave.llm.quality import binomial_cdf
from colweave.llm.tokens import binary_texts, gathered

WORDS = 5
#: Threshold as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: MinHash values compared at a time, and the probability below which a pair is dropped.
STEP = 16
TOLERANCE = 1e-6
#: Classes compared with each other in one task, as a block.
BLOCK = 256
#: Rounds of hubs before classes are compared in blocks.
HUBS = 2
#: Hubs that the buckets of one group have in a round.
SPREAD = 4
#: Pairs of one hub that are verified together.
STAR = 512
#: Shingles hashed at once while MinHash values are made.
CHUNK = 1 << 15
#: Bytes of text whose signatures are made together, and hashed words that a worker remembers.
SIGN_BYTES = 1 << 20
REMEMBERED = 200_000

_ODD = np.random.default_rng(20240501).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(20240502).integers(0, 2**63, VALUES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORDS: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    out = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, one text behind the other, and the texts' bounds.

    Words are what ASCII white space separates, A-Z in lower case. A text of
    one to four words is one shingle; a text without words has none.
    """
    split = pc.ascii_split_whitespace(pa.array([b" ".join(t.lower().split()) for t in texts], pa.string()))
    words = split.flatten().dictionary_encode()
    per = _word_hashes(words.dictionary.to_pylist())
    h = per[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    at = np.asarray(split.offsets).astype(np.int64)
    n = at[1:] - at[:-1]
    n[[not t.strip() for t in texts]] = 0  # splitting nothing still gives an empty word
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(n, WORDS), count)
    out = size.astype(np.uint64)
    for j in range(WORDS):
        inside = size > j
        word = h[np.where(inside, start + j, 0)] if len(h) else np.zeros(len(start), np.uint64)
        out = np.where(inside, _mix(out * _BASE + word), out)
    return out, bounds


def _minhash(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts x VALUES) upper halves of the least hashes; texts must not be empty."""
    out = np.full((len(bounds) - 1, VALUES), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(x), CHUNK):
        hi = min(lo + CHUNK, len(x))
        first = np.searchsorted(bounds, lo, side="right") - 1
        last = np.searchsorted(bounds, hi, side="left")
        cuts = np.maximum(bounds[first:last], lo) - lo
        part = x[lo:hi]
        for j in range(VALUES):
            np.minimum(out[first:last, j], np.minimum.reduceat((part ^ _XOR[j]) * _ODD[j], cuts), out=out[first:last, j])
    return (out >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), cls (16-byte hash of the shingle set, null if empty), n (shingles), sig."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", _WORDS.clear)
        for b in gathered(batches, SIGN_BYTES):
            x, bounds = shingles(binary_texts(b.column("text")))
            full = np.flatnonzero(np.diff(bounds))
            values = _minhash(x, np.append(bounds[full], len(x))) if len(full) else np.zeros((0, VALUES), "<u4")
            cls: list[bytes | None] = [None] * b.num_rows
            sig: list[bytes | None] = [None] * b.num_rows
            n = np.zeros(b.num_rows, np.int64)
            for k, i in enumerate(full.tolist()):
                own = np.unique(x[bounds[i] : bounds[i + 1]])
                cls[i], n[i], sig[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), values[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(cls, pa.binary()), pa.array(n), pa.array(sig, pa.binary())], names=["id", "th", "cls", "n", "sig"])

    return src.mapInArrow(sign, f"id {kind}, th long, cls binary, n long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, VALUES)


def band_rows(classes: DataFrame) -> DataFrame:
    """key, band, cls: the bands of every class."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values = _matrix(b.column("sig")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
            for r in range(ROWS):
                key = _mix(key * _BASE + values[:, :, r])
            row = np.repeat(np.arange(b.num_rows), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), b.column("cls").take(pa.array(row))], names=["key", "band", "cls"])

    return classes.select("cls", "sig").mapInArrow(bands, "key long, band int, cls binary")


@lru_cache
def least_equal(num: int = NUM, den: int = DEN, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For every STEP values compared, the fewest equal ones with which a pair stays.

    With a uniform prior and m of n values equal the similarity is Beta(m + 1,
    n - m + 1), which reaches t with the probability that a binomial(n + 1, t) is at most m.
    """
    t = num / den
    return tuple(next(m for m in range(n + 1) if m == n or binomial_cdf(m, n + 1, t) >= tolerance) for n in range(STEP, VALUES + 1, STEP))


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two signature matrices whose pairs are not pruned."""
    rows = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for step, least in enumerate(least_equal()):
        lo = step * STEP
        equal = equal + (a[rows, lo : lo + STEP] == b[rows, lo : lo + STEP]).sum(axis=1)
        stay = equal >= least
        rows, equal = rows[stay], equal[stay]
    return rows


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the pairs whose MinHash values leave them a chance."""
    sig = classes.select("cls", "sig")
    both = (
        pairs.join(sig.withColumnsRenamed({"cls": "a", "sig": "sa"}), "a")
        .join(sig.withColumnsRenamed({"cls": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")
    )

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = pa.array(surviving(_matrix(x.column("sa")), _matrix(x.column("sb"))))
                yield pa.RecordBatch.from_arrays([x.column("a").take(keep), x.column("b").take(keep)], names=["a", "b"])

    return both.mapInArrow(prune, "a binary, b binary")


def _class_texts(docs: DataFrame, classes: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, text: the text of one document of each class in ``needed`` (column cls, distinct)."""
    reps = classes.join(needed, "cls").select("cls", F.col("rep.id").alias("__id"), F.col("rep.th").alias("__th"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    # repeated rows give a class more than one text, all alike
    return rows.join(reps, rows["id"].eqNullSafe(reps["__id"]) & (rows["th"] == reps["__th"])).groupBy("cls").agg(F.min("text").alias("text"))


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    x, bounds = shingles(texts)
    return [np.unique(x[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]


def _similar(inter, n, m):
    """Whether inter / (n + m - inter) is at least the threshold, in whole numbers."""
    return (NUM + DEN) * inter >= NUM * (n + m)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in a sorted partition, each as one table."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        rows = list(zip(*(b.column(k).to_pylist() for k in keys)))
        cuts = [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]] + [len(rows)]
        for i, j in zip(cuts, cuts[1:]):
            if rows[i] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = rows[i]
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs that reach the threshold. A hub's text travels once for each STAR pairs."""
    # stored, so that the join below has a plain shuffle on either side, which Spark splits where it is skewed
    large = store(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts")).filter("parts > 1"), "large-hubs")
    starred = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("s"))
    members = starred.join(texts.withColumnsRenamed({"cls": "b"}), "b").select("a", "s", "b", "text")
    hubs = starred.select("a", "s").distinct().join(texts.withColumnsRenamed({"cls": "a"}), "a").select("a", "s", F.lit(None).cast("binary").alias("b"), "text")
    rows = members.unionByName(hubs).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hub = None, None
        for x in batches:
            a, b = x.column("a").to_pylist(), x.column("b").to_pylist()
            keep = []
            for i, own in enumerate(_sets(binary_texts(x.column("text")))):
                if b[i] is None:
                    name, hub = a[i], own
                elif a[i] == name and _similar(len(np.intersect1d(hub, own, assume_unique=True)), len(hub), len(own)):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("a").take(take), x.column("b").take(take)], names=["a", "b"])

    return rows.mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """cls, comp: the least class of each connected component, for the classes that have an edge.

    Every round each class takes the least label among its neighbours and
    itself, and then its label's label, until nothing changes; labels are
    stored after each round.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("jump"))
        new = store(least.join(jump, "comp").select("cls", "was", F.least("comp", "jump").alias("comp")), "labels")
        labels = new.select("cls", "comp")
        if new.filter("comp != was").isEmpty():
            return labels


def _blocks(rows: DataFrame, group: list[str], size: int = BLOCK) -> DataFrame:
    """Rows of each group dealt into blocks, copied to every pair of blocks (i <= j) they are part of.

    A group of at most ``size`` rows is one block and is not copied. Adds blk,
    i, j; the copies grow with the number of blocks, the rows in a task do not.
    """
    large = store(rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("nb")).filter("nb > 1"), "large-groups")
    dealt = rows.join(large, group, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    return dealt.withColumn("o", other).withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "nb")


def _cross(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """a, b: verified links between different components that share a bucket, enough to join these.

    In each mixed bucket the largest component stands apart: its classes are
    not compared with each other, and only the rest is copied to its blocks.
    """
    named = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = store(
        per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("comps")).filter("comps > 1")
        .select("key", F.col("m.comp").alias("main"), F.ceil(F.col("m.n") / size).cast("int").alias("nm"),
                (F.col("all") - F.col("m.n")).alias("rest"), F.ceil((F.col("all") - F.col("m.n")) / size).cast("int").alias("nr")), "mixed-buckets")
    rows = named.join(mixed, "key").withColumn("rest_row", F.col("comp") != F.col("main"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cls"), F.when(F.col("rest_row"), F.col("nr")).otherwise(F.col("nm"))).cast("int"))

    def places(last, spot):
        return F.transform(F.sequence(F.lit(0), last - 1), spot)

    def group(i, kind, j):
        return F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))

    # kind 0: a block of the rest and a block of the largest component; kind 1: two blocks of the rest
    blk, none = F.col("blk"), F.array().cast("array<struct<i:int,kind:int,j:int>>")
    with_main = places(F.col("nm"), lambda j: group(blk, 0, j))
    with_rest = F.when(F.col("rest") > 1, places(F.col("nr"), lambda o: group(F.least(blk, o), 1, F.greatest(blk, o)))).otherwise(none)
    of_main = places(F.col("nr"), lambda i: group(i, 0, blk))
    dealt = rows.withColumn("g", F.explode(F.when(F.col("rest_row"), F.concat(with_main, with_rest)).otherwise(of_main)))
    dealt = dealt.select("key", "band", "cls", "comp", "rest_row", "blk", "g.i", "g.kind", "g.j")
    full = dealt.join(classes.select("cls", "sig"), "cls").join(texts, "cls")
    full = full.repartition("key", "i", "kind", "j").sortWithinPartitions("key", "i", "kind", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, kind, j), t in _groups(batches, ["key", "i", "kind", "j"]):
            t = t.combine_chunks()
            cls, sig, band = t.column("cls").to_pylist(), _matrix(t.column("sig")), t.column("band")[0].as_py()
            comp = np.unique(np.array([c.hex() for c in t.column("comp").to_pylist()]), return_inverse=True)[1]
            rest, blk = t.column("rest_row").to_numpy(zero_copy_only=False), t.column("blk").to_numpy()
            left = np.flatnonzero(rest & (blk == i))
            right = np.flatnonzero(~rest) if kind == 0 else np.flatnonzero(rest & (blk == j))
            texts, sets = t.column("text"), {}
            root = np.arange(comp.max() + 1)  # label of each component, as far as this group joins them
            out = []

            def own(x: int) -> np.ndarray:
                if x not in sets:
                    sets[x] = _sets([texts[x].as_py().encode()])[0]
                return sets[x]

            for x in left:
                other = right[right > x] if kind == 1 and i == j else right
                other = other[root[comp[other]] != root[comp[x]]]
                if not len(other):
                    continue
                for y in other[surviving(np.broadcast_to(sig[x], (len(other), VALUES)), sig[other])]:
                    if root[comp[x]] == root[comp[y]]:
                        continue
                    # every pair is looked at in the first bucket that it shares
                    if int(np.argmax((sig[x].reshape(BANDS, ROWS) == sig[y].reshape(BANDS, ROWS)).all(axis=1))) != band:
                        continue
                    a, b = own(x), own(y)
                    if _similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                        out.append((cls[x], cls[y]))
                        root[root == root[comp[y]]] = root[comp[x]]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return full.mapInArrow(compare, "a binary, b binary")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(signatures, classes, labels): everything up to the components of linked classes."""
    signed = store(signatures(docs, id_col, text_col), "signatures")
    classes = store(
        signed.filter("cls is not null").groupBy("cls").agg(
            F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("id"), F.count("*").alias("size"), F.min("sig").alias("sig")), "classes")
    bands = band_rows(classes)
    shared = store(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "buckets")
    members = store(bands.join(shared, "key"), "members")
    texts = store(_class_texts(docs, classes, members.select("cls").distinct(), id_col, text_col), "class-texts")

    edges, labels = None, None
    for r in range(HUBS + 1):
        if r < HUBS:
            # the hub of a bucket: another class in every round, and SPREAD of them for buckets alike
            named = members if labels is None else members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
            draw = F.struct(F.xxhash64(F.lit(r), F.col("band") % SPREAD, "cls").alias("d"), "cls", *([F.col("comp")] if labels is not None else []))
            hubs = store(named.groupBy("key").agg(F.min(draw).alias("h")).select("key", F.col("h.cls").alias("hub"), *([F.col("h.comp").alias("hc")] if labels is not None else [])), "hubs")
            near = named.join(hubs, "key").filter(F.col("cls") != F.col("hub"))
            if labels is not None:
                near = near.filter(F.col("comp") != F.col("hc"))
            pairs = near.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
            found = store(_verify(store(_prune(store(pairs, "pairs"), classes), "candidates"), texts), "links")
        else:
            found = store(_cross(members, labels, classes, texts), "links")
        edges = found if edges is None else edges.unionByName(found)
        if labels is None or not found.isEmpty():
            labels = components(edges)
    return signed, classes, labels, texts


def _count_links(classes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """cls, linked: documents in other classes at the threshold, counted within components."""
    rows = _blocks(store(labels.join(classes.select("cls", "size"), "cls"), "component-classes"), ["comp"])
    rows = rows.join(texts, "cls").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _groups(batches, ["comp", "i", "j"]):
            t = t.combine_chunks()
            sets = _sets(binary_texts(t.column("text")))
            blk, size = t.column("blk").to_numpy(), t.column("size").to_numpy()
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            linked = _linked(sets, left, right)
            sums = np.zeros(len(sets), np.int64)
            if i == j:
                np.fill_diagonal(linked, False)
                sums[left] = linked @ size[right]
            else:
                sums[left] = linked @ size[right]
                sums[right] = linked.T @ size[left]
            yield pa.RecordBatch.from_arrays([t.column("cls").combine_chunks() if isinstance(t.column("cls"), pa.ChunkedArray) else t.column("cls"), pa.array(sums)], names=["cls", "n"])

    return rows.mapInArrow(count, "cls binary, n long").groupBy("cls").agg(F.sum("n").alias("linked"))


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Boolean matrix: which sets on the left and right reach the threshold."""
    n = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 64:
        inter = np.array([[len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    else:
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        inter = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(known), columns):
            a, b = np.searchsorted(code, [lo, lo + columns])
            has = np.zeros((len(sets), columns), np.float32)
            has[owner[a:b], code[a:b] - lo] = 1
            inter += has[left] @ has[right].T
        inter = inter.astype(np.int64)
    return _similar(inter, n[left][:, None], n[right][None, :])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """Per document its group and, if wanted, its links; ``text_hash`` tells rows with one id apart.

    Returns ``id_col``, class_id (the least id of its group of linked
    documents), copy_id (the least id with the same shingle set), n_links (other
    documents at the threshold, copies among them) and n_shingles, one row per
    input row. Null and empty texts have no shingles: they are linked to nothing,
    and their ids are their own id. Repeated rows are copies of each other.
    """
    signed, classes, labels, texts = link_components(docs, id_col, text_col)
    named = store(classes.join(labels, "cls", "left").select("cls", "id", "rep", "size", F.coalesce("comp", "cls").alias("comp")), "named")
    of = store(named.groupBy("comp").agg(F.min("id").alias("class_id"), F.min("rep").alias("first")), "groups")
    facts = named.join(of, "comp").select("cls", F.col("id").alias("copy_id"), "size", "class_id", "first")
    if links:
        facts = facts.join(_count_links(classes, labels, texts), "cls", "left")
    else:
        facts = facts.withColumn("linked", F.lit(None).cast("long"))
    facts = store(facts, "class-facts")
    return signed.select("id", "th", "cls", "n").join(facts, "cls", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_id", "id").alias("copy_id"),
        *([(F.coalesce("size", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")] if links else []),
        F.col("n").alias("n_shingles"), F.col("th").alias("text_hash"),
        (F.col("cls").isNull() | F.struct("id", "th").eqNullSafe(F.col("first"))).alias("first_of_group"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the least id, with all its columns.

    Of rows alike in id and text one stays. Documents without words stay.
    """
    found = near_duplicates(docs, id_col, text_col, links=False)
    stay = store(
        found.filter("first_of_group").groupBy(F.col(id_col).alias("__d"), F.col("text_hash").alias("__t"))
        .agg((F.max(F.when(F.col("n_shingles") > 0, 1).otherwise(0)) * F.count("*") > 1).alias("__again")), "first-documents")
    text = F.xxhash64(docs[text_col].cast("string"))
    kept = [docs.join(s, docs[id_col].eqNullSafe(s["__d"]) & text.eqNullSafe(s["__t"]))
            for s in (stay.filter("NOT __again"), stay.filter("__again"))]
    once = kept[1].dropDuplicates(["__d", "__t"])
    return kept[0].select(*docs.columns).unionByName(once.select(*docs.columns))
