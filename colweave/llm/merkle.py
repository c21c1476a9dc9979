"""Merkle manifest of a dataset: one tree for each group, one over the groups' roots.

A node is known by its group and its place in its level. On every level each node
sends its digest to the places of its siblings, which follow from its own place
(place XOR 1 in a binary tree, the other slots of its run otherwise), and an
equijoin on group and place hands every node what it was sent. Then the nodes in slot zero, which know their
whole run, emit the parents. No level needs a window or a collected group, and
no task sees more than its share of places, however the rows are spread over groups.
From the top down, every node appends its siblings to the path of its parent, so a
leaf ends up with all that its proof needs.

Digests are SHA-256; an inner node hashes the joined lower-case hexadecimal
digests of its run. They are kept as 32 bytes in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import store
from colweave.operators.ordering import global_index

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<l:binary,r:binary>>"


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value as its part of a leaf: '-' for null, else its UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def siblings(i: Column, n: Column, fanout: int) -> Column:
    """The places of a node's run, its own among them, in a level of n nodes."""
    if fanout == 2:
        run = F.array_sort(F.array(i, i.bitwiseXOR(F.lit(1))))
        return F.filter(run, lambda j: j < n)
    first = i - i % fanout
    return F.sequence(first, F.least(first + (fanout - 1), n - 1))


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (g, i, n, h and others) with l and r: the digests before and behind each in its run, joined."""
    sent = nodes.select("g", F.explode(siblings(F.col("i"), F.col("n"), fanout)).alias("i"), F.struct(F.col("i").alias("from"), "h").alias("s"))
    run = F.sort_array(F.collect_list("s"))

    def joined(keep) -> Column:
        return F.aggregate(F.filter(F.col("run"), keep), F.lit(b""), lambda acc, x: F.concat(acc, x["h"]))

    return (
        nodes.join(sent, ["g", "i"]).groupBy(*[F.col(f"`{c}`") for c in nodes.columns]).agg(run.alias("run"))
        .select(*[F.col(f"`{c}`") for c in nodes.columns], joined(lambda x: x["from"] < F.col("i")).alias("l"), joined(lambda x: x["from"] > F.col("i")).alias("r"))
    )


def grow(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all trees, leaves first. ``leaves``: g (group), i (place), n (leaves of the
    group), h (digest). A node that stands alone in its level (n = 1) is the root of its group.

    Every level is a stored table that has l and r as well.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    levels, nodes = [], leaves
    while True:
        level = store(with_siblings(nodes, fanout), "merkle-level")
        levels.append(level)
        if level.filter("n > 1").isEmpty():
            return levels
        i, n = F.col("i"), F.col("n")
        nodes = level.filter((n > 1) & (i % fanout == 0)).select(
            "g", F.floor(i / fanout).alias("i"), F.ceil(n / fanout).alias("n"), F.unhex(F.sha2(hexed(F.concat("h", "r")), 256)).alias("h"))


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """g, h: the root of every group."""
    tops = [x.filter("n = 1").select("g", "h") for x in levels]
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return out


def with_paths(levels: list[DataFrame], fanout: int = FANOUT, above: DataFrame | None = None) -> DataFrame:
    """The leaves with path: the siblings of each node on the way from the leaf to the root of its
    group, and then those of ``above`` (g, path) for that group, if given."""
    end = F.array().cast(PATH)
    paths = None
    for level in reversed(levels):
        columns = [F.col(f"`{c}`") for c in level.columns if c not in ("l", "r")]
        top = level.filter("n = 1")
        if above is None:
            done = top.select(*columns, end.alias("path"))
        else:
            done = top.join(above, "g").select(*columns, "path")
        if paths is not None:
            up = paths.select(F.col("g").alias("__g"), F.col("i").alias("__i"), F.col("path").alias("__path"))
            below = level.filter("n > 1").join(up, (F.col("g") == F.col("__g")) & (F.floor(F.col("i") / fanout) == F.col("__i")))
            done = done.unionByName(below.select(*columns, F.concat(F.array(F.struct("l", "r")), F.col("__path")).alias("path")))
        paths = done
    return paths


def proof_digest(path: Column) -> Column:
    """One digest over the siblings of a path: level by level, left to right."""
    whole = F.aggregate(path, F.lit(b""), lambda acc, x: F.concat(acc, x["l"], x["r"]))
    return F.sha2(hexed(whole), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf (32 bytes) and the siblings on its path, in hexadecimal digits."""
    return F.aggregate(path, hexed(leaf), lambda acc, x: F.sha2(F.concat(hexed(x["l"]), acc, hexed(x["r"])), 256))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with i, their place within their group g in ``order``, and n, the rows of the group.

    Rows alike in ``order`` are told apart by a running number, so many of them do not end in one range.
    """
    numbered = store(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-rows")
    at = store(global_index(numbered, [F.col(c).asc_nulls_first() for c in ("g", *order, "__row")], "__at").drop("__row"), "merkle-places")
    groups = at.groupBy("g").agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    return at.join(groups, "g").withColumn("i", F.col("__at") - F.col("__first")).drop("__at", "__first")


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS,
             tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """id, leaf, seen (digests), group root, root and path of every row.

    A leaf is the digest of ``columns``; ``seen`` is that of the row as somebody else holds it, with the values
    in ``tampered`` in place of the columns of that name. In a group, leaves ascend by id (null first) and
    then digest. Groups are ordered by their values' UTF-8 bytes, null first, and their roots
    are the leaves of one more tree.
    """
    values = [F.col(f"`{c}`") for c in columns]
    seen = [(tampered or {}).get(c, v) for c, v in zip(columns, values)]
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        leaf_digest(*values).alias("h"), leaf_digest(*seen).alias("seen"))
    levels = grow(placed(leaves, ["id", "h"]), fanout)
    subroots = store(roots_of(levels), "merkle-subroots")
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    upper = grow(placed(tops, ["of"]), fanout)
    above = with_paths(upper, fanout).select(F.col("of").alias("g"), "path")
    # the one root of all: every group has it beside its own
    root = roots_of(upper).select(F.col("h").alias("root"), F.lit("").alias("__all"))
    facts = store(
        subroots.withColumn("__all", F.lit("")).join(root, "__all").select("g", F.col("h").alias("subroot"), "root"), "merkle-roots")
    return with_paths(levels, fanout, above).join(facts, "g").select(
        "id", F.col("h").alias("leaf"), "seen", "subroot", "root", "path")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def verified_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    The trees are those of the rows as they are; the proof is then tried on rows of which every
    document whose unsigned CRC-32 of its decimal id is divisible by 3 has its text in lower case
    (A-Z): folded_root is what leaf and siblings give, verified whether it is the root.
    Nulls are values of their own ('-'), an empty text is ``0:``; a null id is never tampered with.
    Repeated rows are leaves each; the lone row of a group is its subroot, the lone group's subroot the root.
    Other columns are not read; an empty table gives an empty result.
    """
    id_text = F.col("doc_id").cast("string")
    hit = F.coalesce(F.crc32(id_text.cast("binary")) % 3 == 0, F.lit(False))
    text = F.col("text").cast("string")
    rows = manifest(docs, tampered={"text": F.when(hit, lower_ascii(text)).otherwise(text)}, fanout=fanout)
    folded = fold(F.col("seen"), F.col("path"))
    return rows.select(
        F.col("id").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
