"""Quality rules whose cutoffs come with a guarantee (built-in functions only).

Each rule rejects documents on one side of a cutoff. Candidates for a cutoff
are a fixed grid, chosen before any label is seen. They make one chain of sets
of cutoffs: all rules one after the other at their mildest cutoff, then all at the next, and
so on. On labelled holdout documents, good ones rejected by
any rule of a set are counted by stratum; a set is admitted if an exact binomial
test shows that its rate of false rejections is below ALPHA, and the chain ends
at the first that is not. Tests in a fixed order need no correction within the
chain, only for the number of strata, so with confidence 1 - DELTA no stratum
loses more than ALPHA of its good documents. Among admitted sets the one that
tells bad from good best is used; a stratum with too few labels to admit any
has no rule. Copies of a text are no further evidence: each different text counts once in its stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Good documents that may be rejected, and the risk that the guarantee fails.
ALPHA = 0.02
DELTA = 0.05
#: A good document lost counts as so many bad ones kept when admitted cutoffs are compared.
COST = 10
#: Rule -> (feature, whether values above the cutoff are rejected, cutoffs). Features are whole
#: numbers: shares in thousandths, mean word length in hundredths of a character.
RULES: dict[str, tuple[str, bool, list[int]]] = {
    "symbols": ("symbol_share", True, [5, 10, 20, 30, 50, 75, 100, 150, 200, 300]),
    "repeats": ("repeat_share", True, [5, 10, 20, 30, 50, 75, 100, 125, 150, 175]),
    "dup_lines": ("dup_line_share", True, [20, 50, 100, 150, 200, 250, 300, 400, 500, 600]),
    "long_words": ("mean_word", True, [600, 650, 700, 750, 800, 850, 900, 1000, 1200, 1500]),
    "short_words": ("mean_word", False, [150, 200, 250, 300, 350, 400, 425, 450, 475, 500]),
}


def _repeat_words(words: Column, hashes: Column, spots: Column, width: int) -> tuple[Column, Column, Column]:
    """Expressions for three steps: hashes of all windows; (window, place) sorted, where hashes
    repeat; and the words in windows found more than once. Each step needs the one before as a column."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - width)
    step1 = F.when(n >= width, F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])))
    # the words themselves decide; words hold no blanks, so joined windows differ if their words do
    windows = F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("w"), i.alias("i")))
    step2 = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(windows))
    def again(x, k):
        return F.coalesce(F.get(spots, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(spots, k + 1)["w"] == x["w"], F.lit(False))

    twice = F.filter(spots, again)
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, i):
        return F.struct((i + width).alias("end"), (acc["n"] + F.least(F.lit(width), i + width - acc["end"])).alias("n"))

    step3 = F.coalesce(F.aggregate(at, zero, add, lambda a: a["n"]), F.lit(0).cast("long"))
    return step1, step2, step3


def base_features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 5) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    Null and empty texts have zeros. Other columns are not read, so their
    names cannot clash.
    """
    text = F.col("__text")
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text")).withColumn(
        "__w", F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")))
    has_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = F.col("__w")
    step1, step2, step3 = _repeat_words(words, F.col("__h"), F.col("__s"), width)
    rows = rows.select(
        *keep, words.alias("__w"), F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.coalesce(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        has_word.alias("__l"), step1.alias("__h"))
    dup_lines = F.when(F.col("__l").isNull(), 0).otherwise(F.size("__l") - F.size(F.array_distinct("__l")))
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", dup_lines.cast("long").alias("n_dup_lines"),
                       F.when(F.col("__l").isNull(), 0).otherwise(F.size("__l")).cast("long").alias("n_lines"), step2.alias("__s"))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", step3.alias("n_repeat_words"))


def _share(a: str, b: str, scale: int) -> Column:
    """floor(scale * a / b), null where b is 0."""
    return F.expr(f"CASE WHEN {b} > 0 THEN ({scale} * {a}) DIV {b} END")


def rule_features(base: DataFrame) -> DataFrame:
    return base.withColumns({
        "symbol_share": _share("n_symbols", "word_chars", 1000),
        "repeat_share": _share("n_repeat_words", "n_words", 1000),
        "dup_line_share": _share("n_dup_lines", "n_lines", 1000),
        "mean_word": _share("word_chars", "n_words", 100),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the regularised incomplete beta function I(1-p; n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _rejects(rule: str, cutoff: Column) -> Column:
    feature, above, _ = RULES[rule]
    return F.coalesce(F.col(feature) > cutoff if above else F.col(feature) < cutoff, F.lit(False))


def chain() -> list[tuple[str, int]]:
    """(rule, cutoff) in the order of the tests. The set of a step is what the steps up to it reject, so sets grow."""
    grids = {rule: sorted(cutoffs, reverse=above) for rule, (_, above, cutoffs) in RULES.items()}
    return [(rule, grid[k]) for k in range(max(map(len, grids.values()))) for rule, grid in grids.items() if k < len(grid)]


def first_step() -> Column:
    """Number of the first step of the chain that rejects a row, the chain's length if none does."""
    steps = chain()
    return F.coalesce(*[F.when(_rejects(rule, F.lit(c)), j) for j, (rule, c) in enumerate(steps)], F.lit(len(steps)))


def calibrate(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """Stratum -> last step of the chain that is used, from labelled rows (stratum, h1, h2, base_failed, first, good).

    Rows that fail the base rules are left out: the method decides on the
    others. Rows with equal h1 and h2 in a stratum are copies and count once, as good if all are. The summary
    has one row for each stratum, such as a language, and one column for each step.
    """
    steps = len(chain())
    rows = (
        labelled.filter(~F.col("base_failed")).groupBy("stratum", "h1", "h2", "first").agg(F.min("good").alias("good"))
        .groupBy("stratum").pivot("first", list(range(steps + 1))).agg(
            F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect()
    )
    out: dict[str, int] = {}
    for r in rows:
        n_good, n_bad = (sum(r[f"{j}_{kind}"] or 0 for j in range(steps + 1)) for kind in ("good", "bad"))
        best, good, bad = 0.0, 0, 0
        for j in range(steps):
            good, bad = good + (r[f"{j}_good"] or 0), bad + (r[f"{j}_bad"] or 0)
            if not n_good or binomial_cdf(good, n_good, alpha) > delta / len(rows):
                break
            gain = (bad / n_bad if n_bad else 0.0) - COST * good / n_good
            if gain > best:
                best, out[r["stratum"]] = gain, j
    return out


def rejected(used: dict[str, int]) -> Column:
    """Whether the steps used in a row's stratum reject it."""
    if not used:
        return F.lit(False)
    last = F.create_map(*[x for s, j in sorted(used.items()) for x in (F.lit(s), F.lit(j))])
    return F.coalesce(F.col("first") <= F.try_element_at(last, F.col("stratum")), F.lit(False))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    One row per input row. Strata are languages; null is one of its own, and so is an empty name. A
    document labelled more than once counts as good only if all its labels
    say so; null labels and null ids are left out of the holdout. Without
    labels only the base rules reject. Ties between steps go to the
    first of the chain.
    """
    text = F.col("text").cast("string")
    marked = docs.select("doc_id", "lang", "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    base = rule_features(base_features(marked, keep=("doc_id", "lang", "h1", "h2"))).withColumn("first", first_step())
    base = store(base.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))), "features")
    good = (
        labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__d"))
        .agg((F.min("quality") > 0).alias("good"))
    )
    used = calibrate(base.join(good, base["doc_id"] == good["__d"]), alpha, delta)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected(used)).alias("kept"))
