"""Brute-force checks for the registered queries that have no SQL oracle."""

import difflib
import random
import re

import duckdb

from .conftest import SF_SMALL


def _prefix(names):
    lo, hi = min(names), max(names)
    i = 0
    while i < min(len(lo), len(hi)) and lo[i] == hi[i]:
        i += 1
    return lo[:i]


def _align(a, b):
    a = re.sub(r"[^a-zA-Z0-9]", "", a).lower()
    b = re.sub(r"[^a-zA-Z0-9]", "", b).lower()
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    if len(l) > 2 * len(s) or not s:
        return 0.0
    hits, last = 0, -1
    for ch in s:
        i = l.find(ch, last + 1)
        if i >= 0 and (last == -1 or i - last <= 2):
            hits, last = hits + 1, i
    return hits / len(s)


def _ratio(a, b):
    if not a or not b:
        return 0.0
    return int(round(100 * difflib.SequenceMatcher(None, a, b).ratio())) / 100.0


def test_fuzzy_candidates_brute_force(spark):
    import __spark_entry__ as E
    from colweave.plans.oracle import value_names_sql
    from colweave.plans.registry import ALIGN_PAIRS

    names = {}
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    for t, c in con.execute(value_names_sql()).fetchall():
        names.setdefault(t, set()).add(c)
    got = {(r["src_table"], r["src_col"], r["tgt_table"], r["tgt_col"]): r["score"] for r in E.queries()["fuzzy_candidates"](spark, SF_SMALL).collect()}
    want = {}
    for s, t in ALIGN_PAIRS:
        sc, tc = sorted(names[s]), sorted(names[t])
        ps, pt = _prefix(sc), _prefix(tc)
        for a in sc:
            for b in tc:
                x, y = (a.replace(ps, "") if ps else a), (b.replace(pt, "") if pt else b)
                score = None
                if _align(x, y) >= 0.95:
                    score = _align(x, y)
                if _ratio(x, y) >= 0.6:
                    score = _ratio(x, y)
                if score is not None:
                    want[(s, a, t, b)] = score
    assert got == want and len(want) > 20


def test_prefix_filter_loses_no_pair(spark):
    from colweave.operators import candidates as CA

    rng = random.Random(12)
    words = ["".join(rng.choices("aabcde_XY9", k=rng.randrange(1, 14))) for _ in range(150)]
    words += [w[:-1] + "z" for w in words if len(w) > 5] + ["", "q"]
    cols = spark.createDataFrame([("st"[i % 2], w, i) for i, w in enumerate(dict.fromkeys(words))], "table_id string, col_name string, col_pos int")
    pairs = spark.createDataFrame([("s", "t")], "src_table string, tgt_table string")
    s, t = ([r["col_name"] for r in cols.filter(f"table_id = '{x}'").collect()] for x in "st")
    ps, pt = _prefix(s), _prefix(t)
    strip = lambda w, p: w.replace(p, "") if p else w
    want = {(a, b): _ratio(strip(a, ps), strip(b, pt)) for a in s for b in t}
    got = {(r["src_col"], r["tgt_col"]): r["fuzzy"] for r in CA.fuzzy_pairs(cols, cols, pairs).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.6} and len(got) > 50
    aligned = {(r["src_col"], r["tgt_col"]): r["alignment"] for r in CA.aligned_pairs(cols, cols, pairs).collect()}
    want = {(a, b): _align(strip(a, ps), strip(b, pt)) for a in s for b in t}
    assert aligned == {k: v for k, v in want.items() if v >= 0.95} and aligned


def test_greedy_one_to_one_brute_force(spark):
    import __spark_entry__ as E
    from colweave.plans.registry import _preds_gt

    p, _ = _preds_gt(spark, SF_SMALL)
    rows = sorted(((r["score"], r["source"], r["target"]) for r in p.collect()), key=lambda x: (-x[0], x[1], x[2]))
    used_s, used_t, want = set(), set(), set()
    for sc, s, t in rows:
        if s in used_s or t in used_t:
            continue
        used_s.add(s); used_t.add(t); want.add((str(s), str(t)))
    got = {(r["src_col"], r["tgt_col"]) for r in E.queries()["greedy_one_to_one"](spark, SF_SMALL).collect()}
    assert got == want


def test_assignment_rescaled_invariants(spark):
    import __spark_entry__ as E

    rows = E.queries()["assignment_rescaled"](spark, SF_SMALL).collect()
    assigned = [r for r in rows if r["assigned"]]
    rest = [r for r in rows if not r["assigned"]]
    assert len({r["src_col"] for r in assigned}) == len(assigned) == len({r["tgt_col"] for r in assigned})
    if rest and assigned:
        assert max(r["score"] for r in rest) <= min(r["score"] for r in assigned) - 0.01 + 1e-9


def test_strategy_merge_and_corpus_shapes(spark):
    import __spark_entry__ as E

    m = E.queries()["match_corpus"](spark, SF_SMALL)
    rows = m.collect()
    order = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "benchmark", "conversations"]
    assert rows and all(order.index(r["src_table"]) < order.index(r["tgt_table"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["src_table"], r["src_col"], r["tgt_table"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_murmur3_priority_sampling_brute_force(spark):
    from colweave.functions.hashing import fibonacci_fraction, murmur3_32
    from colweave.operators import sampling as S
    from colweave.operators.profile import value_counts
    from colweave.sources.catalog import Table, cells

    rows = [(i, f"w{(i * 7) % 23}") for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, c string")
    vc = value_counts(cells([Table("t", df, "rid", ("c",))], clean=False), clean=True)
    got = S.samples(vc, 10, "priority_sampling", hash_fn="murmur3").first()["samples"]
    counts = {}
    for _, v in rows:
        counts[v] = counts.get(v, 0) + 1
    prio = {v: c / max(fibonacci_fraction(murmur3_32(v.encode(), 42)), 1e-12) for v, c in counts.items()}
    want = [v for v, _ in sorted(prio.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]
    assert got == want


def test_input_stats_counts(spark):
    import __spark_entry__ as E

    r = E.queries()["input_stats"](spark, SF_SMALL).first()
    assert (r["ncols_src"], r["ncols_tgt"]) == (5, 4)
    assert r["nrows_src"] == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert r["nmatches"] == E.queries()["match_tables"](spark, SF_SMALL).count()


def test_query_prefix_option(spark):
    from colweave.plans.pipeline import MatchOptions, match_tables
    from colweave.sources.catalog import load_catalog

    c, s = load_catalog(spark, SF_SMALL, ["customer", "supplier"])
    m = match_tables(spark, c, s, MatchOptions(query_prefix="query: ")).collect()
    top1 = {r["src_col"]: r["tgt_col"] for r in m if r["rank"] == 1}
    assert top1["c_name"] == "s_name"
