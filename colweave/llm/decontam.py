"""Benchmark decontamination by a prefix-filtered set join (built-in functions only).

A window of an item is contained in a document exactly when all its shingles
are, so by the prefix principle one shingle is enough to find every candidate:
the rarest. Shingles are short runs of words; the corpus is counted over all
documents for the shingles that items have: one pass writes the places where they stand,
which are counted, and every window is indexed by its
rarest one. A document position with that shingle names a candidate; its place
in the window gives the start (positional bound), the window's length must fit
in the document (length bound), and the words of all its shingles are then compared with
those that stand there.

Windows are joined in blocks of at most ``BLOCK_WINDOWS``, so what is broadcast
has a fixed bound; more windows mean more blocks, none is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import store

WINDOW = 13
#: Words in a shingle; a shorter window is one shingle.
SHINGLE = 4
#: Windows in one broadcast table.
BLOCK_WINDOWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed (``lower`` does just that to pure ASCII)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text: digits, letters and everything outside ASCII; null has none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def _shingles(words: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda at: _shingle(words, at, width))


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win, words): the windows of every item, win being their words joined by blanks.

    An item with fewer words than a window, but not none, is one window.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    return (
        words.filter(n > 0)
        .select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s"), window).alias("words"))
        .select("item", F.array_join("words", " ").alias("win"), "words")
        .distinct()
    )


class _Corpus:
    """Documents as one row per word position, with a first row (position 0) that has no word."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.col(text_col).cast("string")
        self.base = docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"),
            F.concat(F.array(F.lit(None).cast("string")), words_of(text)).alias("words"))

    def keyed(self, widths: list[int]) -> DataFrame:
        """doc_id, th, words, pos (0: the row of the document itself), key (shingle that starts there)."""
        rows = self.base.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "word"))
        keys = [
            F.when((F.col("pos") > 0) & (F.col("pos") + w <= F.size("words")), _shingle(F.col("words"), F.col("pos"), w))
            for w in widths
        ]
        if len(keys) == 1:
            return rows.select("doc_id", "th", "words", "pos", keys[0].alias("key"))
        # the row of the document itself has one key, null, whatever the number of widths
        keys = F.when(F.col("pos") > 0, F.array(*keys)).otherwise(F.array(F.lit(None).cast("long")))
        return rows.select("doc_id", "th", "words", "pos", F.explode(keys).alias("key"))


def _in_blocks(rows: DataFrame, blocks: int, on: str) -> list[DataFrame]:
    return [rows.filter(F.pmod(F.xxhash64(on), F.lit(blocks)) == b) for b in range(blocks)]


def _shingles_of(windows: DataFrame, widths: list[int]) -> DataFrame:
    """win, words, off, key, sh (its words): the shingles of every distinct window and where they start."""
    distinct = windows.select("win", "words").distinct()
    n = F.size("words")
    return reduce(DataFrame.unionByName, [
        distinct.filter(F.least(n, F.lit(SHINGLE)) == w)
        .select("win", "words", F.posexplode(_shingles(F.col("words"), w)).alias("off", "key"))
        .withColumn("sh", F.array_join(F.slice("words", F.col("off") + 1, w), " "))
        for w in widths
    ])


def _occurrences(corpus: _Corpus, shingles: DataFrame, blocks: int, widths: list[int]) -> DataFrame:
    """doc_id, th, n (words), pos, key, sh (the words there), stored: every place in the corpus where a shingle of an item
    starts, and a row with position 0 for every document."""
    rows = corpus.keyed(widths)
    parts = []
    known = shingles.groupBy("key").agg(F.max(F.size(F.split("sh", " "))).alias("width"))  # a key is of one width
    for b, block in enumerate(_in_blocks(known, blocks, "key")):
        hit = rows.join(F.broadcast(block), "key", "left")
        first = F.col("pos") == 0 if b == 0 else F.lit(False)
        there = F.when(F.col("pos") > 0, F.array_join(F.slice("words", F.col("pos") + 1, F.col("width")), " "))
        parts.append(hit.filter(F.col("width").isNotNull() | first).select("doc_id", "th", (F.size("words") - 1).alias("n"), "pos", "key", there.alias("sh")))
    return store(reduce(DataFrame.unionByName, parts), "item-shingles-found")


def _prefixes(shingles: DataFrame, found: DataFrame) -> DataFrame:
    """win, size, key, off: every window that may occur, with its rarest shingle and where that starts."""
    counts = found.filter("pos > 0").groupBy("key").agg(F.count("*").alias("df"))
    # a window with a shingle that no document has occurs nowhere
    return (
        shingles.join(counts, "key", "left").groupBy("win", F.size("words").alias("size"))
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "off")).alias("m"))
        .filter("m.df > 0").select("win", "size", "m.key", "m.off")
    )


def match_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, matches, item windows). Documents: doc_id, th (hash of the text) and n (words), one row for each
    row. Matches, for rows with an occurrence of a window, alike rows once: doc_id, th, spans
    (start and length of every occurrence) and wins. Item windows: item, win."""
    windows = store(item_windows(items, window, item_id, item_text), "item-windows")
    n_windows = windows.select("win").distinct().count()
    widths = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())
    corpus = _Corpus(docs, id_col, text_col)
    if not widths:
        rows = store(corpus.base.select("doc_id", "th", (F.size("words") - 1).alias("n")), "documents")
        none = rows.select("doc_id", "th", F.array().cast("array<struct<start:int,len:int>>").alias("spans"), F.array().cast("array<string>").alias("wins"))
        return rows, none.limit(0), windows.select("item", "win")
    # a window has up to `window` shingles, so blocks of shingles are bounded as well
    blocks = max(1, -(-n_windows // BLOCK_WINDOWS))
    shingles = store(_shingles_of(windows, widths), "item-shingles")
    found = _occurrences(corpus, shingles, blocks, widths)
    prefixes = store(_prefixes(shingles, found), "prefixes")
    start = F.col("pos") - F.col("off")
    # where the rarest shingle stands gives the start; the window must fit in the document
    hits = found.filter("pos > 0").dropDuplicates(["doc_id", "th", "pos", "key"])
    candidates = reduce(DataFrame.unionByName, [
        hits.join(F.broadcast(block), "key").filter((start >= 1) & (start + F.col("size") - 1 <= F.col("n")))
        .select("doc_id", "th", start.alias("start"), "size", "win")
        for block in _in_blocks(prefixes, blocks, "win")
    ])
    # a window stands where each of its shingles does, word by word: the places are at hand, no text is read again
    wanted = candidates.join(shingles.select("win", "off", "key", "sh"), "win").select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), "start", "size", "win", (F.col("start") + F.col("off")).alias("p"), F.col("key").alias("k"), F.col("sh").alias("s"))
    same = (F.col("t") == F.col("th")) & (F.col("p") == F.col("pos")) & (F.col("k") == F.col("key")) & F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("sh"))
    verified = (
        wanted.join(hits, same).groupBy("d", "t", "start", "size", "win").agg(F.count("*").alias("found"))
        .filter(F.col("found") == F.col("size") - F.least(F.col("size"), F.lit(SHINGLE)) + 1)
    )
    matches = store(
        verified.groupBy(F.col("d").alias("doc_id"), F.col("t").alias("th")).agg(
            F.sort_array(F.collect_set(F.struct((F.col("start") - 1).alias("start"), F.col("size").alias("len")))).alias("spans"),
            F.collect_set("win").alias("wins")), "item-matches")
    return found.filter("pos = 0").select("doc_id", "th", "n"), matches, windows.select("item", "win")


def _covered(spans: Column) -> Column:
    """Positions in at least one of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def step(acc, s):
        end = s["start"] + s["len"]
        new = F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + new).alias("hit"))

    return F.aggregate(spans, start, step, lambda a: a["hit"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of every document inside occurrences of item windows.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated
    (n_hit > 0 and ``min_share`` * n_hit >= n_words), one row per input row, and
    text_hash. Null and empty texts have no words; rows alike in id and text have alike
    results; null item ids are not counted; without items nothing is hit.
    """
    rows, matches, windows = match_windows(docs, items, window, id_col, text_col, item_id, item_text)
    items_of = (
        matches.select("doc_id", "th", F.explode("wins").alias("win"))
        .join(windows.filter("item is not null"), "win")
        .groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("__i"), F.col("th").alias("__j"), "items")
    )
    hits = (
        matches.join(items_of, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__j")), "left")
        .select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), _covered(F.col("spans")).alias("hit"), "items")
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_words, n_hit = F.col("n").cast("long"), F.coalesce("hit", F.lit(0)).cast("long")
    return rows.join(hits, (F.col("th") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left").select(
        F.col("doc_id").alias(id_col), n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (min_share * n_hit >= n_words)).alias("contaminated"), F.col("th").alias("text_hash"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, **options).filter("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct()
    # aliases keep the conditions clear of any column names the documents have
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__t"]), "left_anti")
