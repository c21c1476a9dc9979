"""Training-data jobs (AGG-7, FN-32..37, FLT-6, JOIN-11, WIN-10, WIN-11, AGG-21).

Every draw the original scripts take from a global random generator is a
seeded hash of the row key here (``seeded_unit``), so results do not depend
on partitioning and can be checked in SQL. Uniform draws "k of a group" use a
dense per-group index (bucketed ranks, never one window over a whole group)
and an equi-join on the drawn index: no pair enumeration inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_text
from ..functions.hashing import seeded_unit
from .ordering import global_index

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _u(seed: int, *parts) -> Column:
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return seeded_unit(key, seed)


# ------------------------------------------------------------ distinct values
def distinct_values(vc: DataFrame, table_order: list[str], limit_distinct: int = 100, keep: int = 50) -> DataFrame:
    """Per column name: its values by count desc; the first table (in ``table_order``) holding a name wins.

    Columns with more than ``limit_distinct`` values keep their ``keep`` most frequent.
    ``(col_name, table_id, value, cnt, pos)``; ``pos`` is the 1-based list position.
    """
    order = F.create_map(*[x for i, t in enumerate(table_order) for x in (F.lit(t), F.lit(i))])
    owner = vc.select("table_id", "col_name").distinct().withColumn("_o", order[F.col("table_id")])
    owner = owner.groupBy("col_name").agg(F.min_by("table_id", "_o").alias("table_id"))
    v = vc.join(owner, ["col_name", "table_id"], "left_semi")
    nd = v.groupBy("col_name").agg(F.count(F.lit(1)).alias("_nd"))
    w = Window.partitionBy("col_name").orderBy(F.col("cnt").desc(), F.col("value"))
    # the bound on the rank lets Spark keep that many values of a column before they are shuffled
    most = max(limit_distinct, keep)
    ranked = v.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most).join(nd, "col_name")
    return ranked.filter((F.col("_nd") <= limit_distinct) | (F.col("pos") <= keep)).select(
        "col_name", "table_id", "value", "cnt", "pos"
    )


def values_json(dv: DataFrame) -> DataFrame:
    """``{column: [values…]}`` rows, one per column (SNK-3 payload)."""
    lists = dv.groupBy("col_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values")
    )
    return lists.select("col_name", F.to_json(F.create_map(F.col("col_name"), F.col("values"))).alias("json"))


# ------------------------------------------------------------ augmentation
def exact_augmentation(dv: DataFrame, seed: int = 42, max_values: int = 15, rename_p: float = 0.3) -> DataFrame:
    """Exact variants and the original entry per column (FN-35).

    Rows ``(col_name, kind, name, values ARRAY<STRING>)`` with kind in
    (``original``, ``exact``): two exact variants ``<name>_1`` and
    ``<alt>_2``; ``alt`` replaces one character with probability ``rename_p``
    (always when the column has no values); each variant samples 1..15 values.
    """
    lists = dv.groupBy("col_name").agg(
        F.collect_list(F.struct("value", "pos")).alias("_vals"), F.count(F.lit(1)).alias("_n")
    )
    name = F.col("col_name")
    u_pos = _u(seed, name, "pos")
    u_chr = _u(seed, name, "chr")
    pos = F.floor(u_pos * F.length(name)).cast("int") + 1
    ch = F.substring(F.lit(ALPHABET), (F.floor(u_chr * len(ALPHABET)) + 1).cast("int"), 1)
    replaced = F.concat(
        F.call_function("substr", name, F.lit(1), pos - 1), ch, F.call_function("substr", name, pos + 1)
    )
    alt = F.when((_u(seed, name, "rename") < rename_p) | (F.col("_n") < 1), replaced).otherwise(name)

    def draw(tag: str, size: Column) -> Column:
        keyed = F.transform("_vals", lambda s: F.struct(_u(seed, name, tag, s["value"]).alias("k"), s["value"].alias("v")))
        return F.transform(F.slice(F.array_sort(keyed), 1, size), lambda s: s["v"])

    cap = F.least(F.col("_n"), F.lit(max_values))
    k1 = (F.floor(_u(seed, name, "k1") * cap) + 1).cast("int")
    k2 = (F.floor(_u(seed, name, "k2") * cap) + 1).cast("int")
    in_order = F.transform(F.array_sort(F.transform("_vals", lambda s: F.struct(s["pos"].alias("p"), s["value"].alias("v")))), lambda s: s["v"])
    original = F.when(F.col("_n") < max_values, in_order).otherwise(draw("orig", F.lit(max_values)))
    base = lists.select(
        "col_name",
        F.array(
            F.struct(F.lit("original").alias("kind"), name.alias("name"), original.alias("values")),
            F.struct(F.lit("exact").alias("kind"), F.concat(name, F.lit("_1")).alias("name"),
                     F.when(F.col("_n") < 1, F.array().cast("array<string>")).otherwise(draw("s1", k1)).alias("values")),
            F.struct(F.lit("exact").alias("kind"), F.concat(alt, F.lit("_2")).alias("name"),
                     F.when(F.col("_n") < 1, F.array().cast("array<string>")).otherwise(draw("s2", k2)).alias("values")),
        ).alias("_e"),
    )
    return base.select("col_name", F.inline("_e"))


def augmentation_map(aug: DataFrame) -> DataFrame:
    """Nested JSON shape ``{col: {kind: {name: [values]}}}`` (the augmentation file, SRC-8)."""
    inner = aug.groupBy("col_name", "kind").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("m"))
    outer = inner.groupBy("col_name").agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("kinds"))
    return outer.select(F.to_json(F.create_map(F.col("col_name"), F.col("kinds"))).alias("json"))


def read_augmentation(df_json: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse augmentation JSON text into ``(col_name, kind, name, values)`` with three explodes (SRC-8)."""
    schema = "map<string, map<string, map<string, array<string>>>>"
    m = df_json.select(F.from_json(F.col(json_col), schema).alias("m"))
    a = m.select(F.explode("m").alias("col_name", "kinds"))
    b = a.select("col_name", F.explode("kinds").alias("kind", "names"))
    return b.select("col_name", "kind", F.explode("names").alias("name", "values"))


def parse_alternatives(df: DataFrame, text_col: str) -> DataFrame:
    """``'name, v1, v2; name2, v1'`` -> ``(idx, alt_name, values)`` rows (FN-32).

    Newlines are removed per entry; an entry without ``', '`` gives no values.
    """
    parts = F.split(F.col(text_col), "; ")
    e = df.select("*", F.posexplode(parts).alias("idx", "_m")).withColumn("_m", F.regexp_replace("_m", "\n", ""))
    head = F.split(F.col("_m"), ", ", 2)
    return e.select(
        *[c for c in df.columns if c != text_col], "idx",
        F.element_at(head, 1).alias("alt_name"),
        F.when(F.size(head) > 1, F.split(F.element_at(head, 2), ", ")).otherwise(F.array().cast("array<string>")).alias("values"),
    )


def training_items(aug: DataFrame, augmentation: str = "exact_semantic") -> DataFrame:
    """Items ``(class_id, name, values)`` for contrastive training (FN-37, FN-34, FLT-6).

    A kind is used when it is a substring of ``augmentation`` or is ``original``;
    exact names lose their ``_<suffix>``; values are cleaned; class = column.
    """
    use = (F.instr(F.lit(augmentation), F.col("kind")) > 0) | (F.col("kind") == "original")
    a = aug.filter(use)
    name = F.when(F.col("kind") == "exact", F.regexp_replace("name", "_[^_]*$", "")).otherwise(F.col("name"))
    # class ids rank the distinct column names only (one row per column)
    classes = global_index(a.select("col_name").distinct(), [F.col("col_name")], "class_id").withColumn("class_id", F.col("class_id").cast("int"))
    return a.join(classes, "col_name").select(
        "class_id", "kind", name.alias("name"),
        F.filter(F.transform("values", lambda v: clean_text(v)), lambda v: v.isNotNull()).alias("values"),
    )


# ------------------------------------------------------------ triplets from ground truth
def hard_negatives(gt: DataFrame) -> DataFrame:
    """Same role, different entity/block/semantic column, distinct target (JOIN-11).

    ``gt``: ``(source_column, target_column, role[, entity][, block][, semantic_column])``.
    """
    extra = [c for c in ("entity", "block", "semantic_column") if c in gt.columns]
    same_pair = "pair_id" in gt.columns
    a = gt.alias("a")
    b = gt.select(F.col("role").alias("b_role"), *([F.col("pair_id").alias("b_pair")] if same_pair else []),
                  *[F.col(c).alias(f"b_{c}") for c in extra], F.col("target_column").alias("negative"))
    cond = F.col("a.role") == F.col("b_role")
    if same_pair:
        cond = cond & (F.col("a.pair_id") == F.col("b_pair"))
    j = a.join(b, cond)
    for c in extra:
        j = j.filter(F.col(f"a.{c}") != F.col(f"b_{c}"))
    j = j.filter(F.col("negative") != F.col("a.target_column"))
    return j.select(F.col("a.source_column").alias("source_column"), F.col("a.target_column").alias("target_column"), "negative").distinct()


def triplets(gt: DataFrame, target_columns: DataFrame, n_neg: int = 4, seed: int = 42) -> DataFrame:
    """Up to ``n_neg`` negatives per positive: hard ones first, then other target columns (WIN-11).

    ``gt`` and ``target_columns`` carry ``pair_id`` (one source/target table pair);
    ``target_columns``: ``(pair_id, target_column)``. Draw order is a seeded hash.
    Group sizes here are schema widths (columns of one target table).
    """
    hard = hard_negatives(gt).withColumn("_prio", F.lit(0))
    pos = gt.select("pair_id", "source_column", "target_column").distinct()
    # every other column of the pair's target table is a candidate (schema-sized group),
    # joined on the pair id carried as data
    tc = target_columns.select("pair_id", F.col("target_column").alias("negative"))
    other = pos.join(tc, "pair_id").drop("pair_id").filter(F.col("negative") != F.col("target_column"))
    other = other.withColumn("_prio", F.lit(1))
    cand = hard.unionByName(other)
    cand = cand.groupBy("source_column", "target_column", "negative").agg(F.min("_prio").alias("_prio"))
    key = _u(seed, F.col("source_column"), F.col("target_column"), F.col("negative"))
    w = Window.partitionBy("source_column", "target_column").orderBy("_prio", key, "negative")
    return cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_neg).select(
        "source_column", F.col("target_column").alias("positive_target_col"), F.col("negative").alias("negative_target_col"),
        F.col("_prio").alias("is_random"),
    )


# ------------------------------------------------------------ label-space draws
def dense_index(df: DataFrame, group: str, order: str, width: int = 1 << 20) -> DataFrame:
    """0-based index of each row inside its group by ``order`` and the group size, without a whole-group window."""
    b = df.withColumn("_bkt", F.floor(F.col(order) / F.lit(width)))
    counts = b.groupBy(group, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    sizes = counts.groupBy(group).agg(F.sum("_bn").alias("gsize"))
    wi = Window.partitionBy(group, "_bkt").orderBy(order)
    r = b.join(counts, [group, "_bkt"]).withColumn("gidx", F.col("_off") + F.row_number().over(wi) - 1)
    return r.join(sizes, group).drop("_bkt", "_bn", "_off")


def balanced_batches(items: DataFrame, batch_size: int = 16, per_class: int = 2, seed: int = 42) -> DataFrame:
    """Class-balanced batches (WIN-10): per batch, ``batch_size // per_class`` classes, ``per_class`` rows each.

    ``items``: ``(id, label)``; number of batches = rows // batch_size.
    Only classes with at least ``per_class`` rows take part; with fewer such
    classes than a batch needs the batches cannot be filled, which is an error.
    Classes per batch and rows per class are distinct indexes drawn by hash
    (``_distinct_draws``), then found by an equi-join, so neither batches x
    classes nor a class as a whole is ever laid out. Returns ``(batch, label, id)``.
    """
    n_batches = items.count() // batch_size
    n_cls = batch_size // per_class
    idx = dense_index(items, "label", "id").filter(F.col("gsize") >= per_class)
    labels = global_index(idx.select("label", "gsize").distinct(), [F.col("label")], "lidx")
    n_labels = labels.count()
    if n_batches and n_labels < n_cls:
        raise ValueError(f"a batch takes {n_cls} classes of {per_class} rows; {n_labels} classes have that many")
    batches = items.sparkSession.range(n_batches).withColumnRenamed("id", "batch")
    classes = _distinct_draws(batches, n_cls, F.lit(n_labels), seed, "cls", ["batch"], "lidx")
    chosen = classes.join(labels, "lidx").select("batch", "label", "gsize")
    draws = _distinct_draws(chosen, per_class, F.col("gsize"), seed, "row", ["batch", "label"], "gidx")
    return draws.join(idx.select("label", "gidx", "id"), ["label", "gidx"]).select("batch", "label", "id")


def _distinct_draws(df: DataFrame, k: int, size: Column, seed: int, tag: str, key: list[str], name: str) -> DataFrame:
    """``k`` rows for each row of ``df``, with distinct indexes below ``size`` (at least k).

    The first index is uniform; every later one steps on by one to as much as
    leaves room for the others, so the steps sum up to less than ``size``.
    """
    parts = [F.col(c) for c in key]
    out = df.withColumn("_first", F.floor(_u(seed, f"{tag}0", *parts) * size).cast("long")).withColumn("_far0", F.lit(0).cast("long"))
    for j in range(1, k):
        room = size - 1 - F.col(f"_far{j - 1}") - (k - 1 - j)
        out = out.withColumn(f"_far{j}", F.col(f"_far{j - 1}") + F.floor(_u(seed, f"{tag}{j}", *parts) * room).cast("long") + 1)
    spread = out.withColumn("_far", F.explode(F.array(*[F.col(f"_far{j}") for j in range(k)])))
    return spread.withColumn(name, F.pmod(F.col("_first") + F.col("_far"), size)).drop("_first", "_far", *[f"_far{j}" for j in range(k)])


def embedding_triplets(vecs: DataFrame, seed: int = 42) -> DataFrame:
    """One (anchor, positive, negative) per item: positive another item of its label, negative an item of another label."""
    idx = dense_index(vecs.select("id", "label"), "label", "id")
    # label ordinals over the distinct labels only (one row per class)
    labs = global_index(idx.select("label").distinct(), [F.col("label")], "lidx")
    labs = labs.withColumn("n_labels", F.lit(labs.count()))  # one scalar to the driver
    a = idx.join(labs, "label").filter(F.col("gsize") >= 2).filter(F.col("n_labels") >= 2)
    pidx = F.pmod(F.col("gidx") + 1 + F.floor(_u(seed, "p", F.col("id")) * (F.col("gsize") - 1)).cast("long"), F.col("gsize"))
    nl = F.pmod(F.col("lidx") + 1 + F.floor(_u(seed, "nl", F.col("id")) * (F.col("n_labels") - 1)).cast("long"), F.col("n_labels"))
    a = a.select(F.col("id").alias("anchor"), "label", pidx.alias("p_idx"), nl.alias("n_lidx"))
    pos = idx.select("label", F.col("gidx").alias("p_idx"), F.col("id").alias("positive"))
    nlab = labs.select(F.col("lidx").alias("n_lidx"), F.col("label").alias("n_label"))
    negs = idx.select(F.col("label").alias("n_label"), "gidx", "gsize", F.col("id").alias("negative"))
    t = a.join(pos, ["label", "p_idx"]).join(nlab, "n_lidx")
    nsize = negs.select("n_label", F.col("gsize").alias("n_size")).distinct()
    t = t.join(nsize, "n_label").withColumn("gidx", F.floor(_u(seed, "n", F.col("anchor")) * F.col("n_size")).cast("long"))
    return t.join(negs.select("n_label", "gidx", "negative"), ["n_label", "gidx"]).select("anchor", "positive", "negative")


def triplet_loss(trips: DataFrame, vecs: DataFrame, margin: float = 0.2, eps: float = 1e-6) -> DataFrame:
    """Mean ``max(0, d(a,p) - d(a,n) + margin)``, euclidean on unit vectors, ``eps`` added to differences (AGG-21)."""
    from .similarity import normalize_expr

    u = vecs.select("id", normalize_expr("vec").alias("u"))
    t = (
        trips.join(u.select(F.col("id").alias("anchor"), F.col("u").alias("ua")), "anchor")
        .join(u.select(F.col("id").alias("positive"), F.col("u").alias("up")), "positive")
        .join(u.select(F.col("id").alias("negative"), F.col("u").alias("un")), "negative")
    )

    def dist(x, y):
        d = F.zip_with(x, y, lambda p, q: (p - q + F.lit(eps)) * (p - q + F.lit(eps)))
        return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v))

    loss = F.greatest(F.lit(0.0), dist(F.col("ua"), F.col("up")) - dist(F.col("ua"), F.col("un")) + F.lit(margin))
    return t.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n_triplets"))
