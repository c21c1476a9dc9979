"""Line dedup, decontamination, quality rules and sharding against plain restatements."""

import math
import random

import duckdb
import pytest

from colweave.llm import decontam, linededup, quality, sharding

from . import brute, data

ITEMS = "item_id long, text string, words string, `key` string, win string"


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


# line dedup

def test_lines_match_rule(llm_spark):
    rows = data.distinct_ids(data.document_rows())
    got = rows_of(linededup.without_boilerplate(data.documents(llm_spark, rows)), "doc_id", "n_lines", "n_removed", "text")
    want = brute.line_dedup([(r[0], r[3], r[1]) for r in rows])
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) >= 12  # a line stays in the first document that has it


def test_lines_of_repeated_rows(llm_spark):
    # rows alike in id and text are each cleared of the line once
    rows = [(i, f"own {i}\nshared by all sites", "en", f"s{i}", 1) for i in range(6)]
    got = rows_of(linededup.without_boilerplate(data.documents(llm_spark, rows + [rows[3]] * 4)), "doc_id", "n_removed", "text")
    assert sorted(got) == sorted([(0, 0, rows[0][1])] + [(i, 1, f"own {i}") for i in (1, 2, 3, 3, 3, 3, 3, 4, 5)])


def test_lines_without_a_site_are_on_none(llm_spark):
    rows = [(i, f"own {i}\nshared without sites", "en", None, 1) for i in range(30)]
    assert linededup.without_boilerplate(data.documents(llm_spark, rows)).filter("n_removed > 0").isEmpty()


def test_lines_keep_rows_and_columns(llm_spark):
    df = data.documents(llm_spark)
    out = linededup.without_boilerplate(df)
    assert out.columns == [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert out.count() == df.count()
    assert linededup.without_boilerplate(data.empty(llm_spark)).count() == 0


def test_lines_near_threshold_are_counted_exactly(llm_spark):
    rows = []
    for spread in range(2, 16):
        rows += [(1000 * spread + i, f"a line for a spread of {spread} sites", "en", f"s{i}", 1) for i in range(spread)]
    got = rows_of(linededup.without_boilerplate(data.documents(llm_spark, rows)), "doc_id", "n_removed")
    removed = {s: sum(n for d, n in got if d // 1000 == s) for s in range(2, 16)}
    assert removed == {s: (s - 1 if s >= 5 else 0) for s in range(2, 16)}


def test_long_lines_fall_on_fewer_sites(llm_spark):
    rows = []
    for spread in range(2, 13):
        line = " ".join(f"word{spread}x{j}" for j in range(50))
        short = line.rsplit(" ", 1)[0]  # 49 words
        # half of the documents on one hot source
        rows += [(1000 * spread + i, f"{line}\n{short}", "en", f"s{max(0, i - spread)}", 1) for i in range(2 * spread)]
    got = rows_of(linededup.without_boilerplate(data.documents(llm_spark, rows), min_sites=10), "doc_id", "n_removed")
    removed = {s: sum(n for d, n in got if d // 1000 == s) for s in range(2, 13)}
    assert removed == {s: ((s >= 5) + (s >= 10)) * (2 * s - 1) for s in range(2, 13)}


def test_short_lines_on_many_sites_go(llm_spark):
    rows = [(i, f"own words of document {i}\nLes.\n\n\t\n \r\n=", "en", f"s{i}", 1) for i in range(12)]
    got = rows_of(linededup.without_boilerplate(data.documents(llm_spark, rows)), "doc_id", "n_lines", "n_removed", "text")
    want = brute.line_dedup([(r[0], r[3], r[1].replace("\t", "").replace("\r", "")) for r in rows], min_chars=1)
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want) and sum(r[2] for r in got) == 2 * 11  # blank lines stay
    assert all(r[3] == f"own words of document {r[0]}\n\n\t\n \r" for r in got if r[0])


# decontamination

def item_rows(docs):
    rng = random.Random(8)
    texts = [r[1] for r in docs if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(t.split()[5:25])) for i, t in enumerate(texts[:6])]
    items += [(50, "word"), (51, "TWO, words!"), (52, None), (53, "???"), (54, ""), (55, data.sentence(rng, 40)), (56, "Straße 日本語")]
    return items + [items[0], (None, items[1][1]), (60, items[0][1]), (57, "a b c d e f g h i j a b c d e f g h i j")]


def contaminated(spark, docs, items):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in items], ITEMS)
    return decontam.contamination(data.documents(spark, docs), df)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_items_match_rule(llm_spark):
    docs = data.document_rows()
    items = item_rows(docs)
    got = rows_of(contaminated(llm_spark, docs, items), *COLUMNS)
    want = brute.decontamination([(r[0], r[1]) for r in docs], items)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[5] for w in want) > 5


@pytest.mark.parametrize("per_block", [1, 7])
def test_items_in_blocks(llm_spark, monkeypatch, per_block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", per_block * 8)
    docs = data.document_rows()[:14]
    items = item_rows(docs)[:3] + [(50, "word"), (51, "two words")]
    got = rows_of(contaminated(llm_spark, docs, items), *COLUMNS)
    assert sorted(got, key=key) == sorted(brute.decontamination([(r[0], r[1]) for r in docs], items), key=key)


def test_items_empty_tables(llm_spark):
    docs = data.document_rows()
    got = contaminated(llm_spark, docs, [])
    assert got.count() == len(docs) and got.filter("contaminated or n_hit > 0").isEmpty()
    assert contaminated(llm_spark, [], [(1, "some words")]).count() == 0


def test_decontaminated_keeps_clean_rows(llm_spark):
    docs, items = data.document_rows(), [(1, " ".join(data.document_rows()[6][1].split()[10:40]))]
    df = data.documents(llm_spark, docs)
    out = decontam.decontaminated(df, llm_spark.createDataFrame([(*r, "x", "y", "z") for r in items], ITEMS))
    bad = [w for w in brute.decontamination([(r[0], r[1]) for r in docs], items) if w[5]]
    assert out.columns == df.columns and out.count() == len(docs) - len(bad) and bad


# quality rules

def test_quality_base_matches_rule(llm_spark):
    docs = data.document_rows()
    docs += [(300, "same line here\nsame line here\n\n\nx\nx\n # * $ % & | < >", None, None, None)]
    base = quality.rule_features(quality.base_features(data.documents(llm_spark, docs)))
    got = rows_of(base, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(got, key=key) == sorted(((r[0], *brute.quality_base(r[1])) for r in docs), key=key)


@pytest.mark.parametrize("n,p", [(1, 0.3), (40, 0.01), (500, 0.004), (3000, 0.02)])
def test_binomial_tail_is_exact(n, p):
    for k in range(0, min(n, 60) + 1, 3):
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_quality_cutoffs_keep_their_promise(llm_spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 5 == 0
        text = data.sentence(rng, 30) + (" ###" * 8 if bad or rng.random() < 0.0005 else "")
        rows.append((i, text, "en" if i % 2 else "xx", "s", 1))
        labels.append((i, 0 if bad else 1))
    rows += [(9001, "short", "en", "s", 1), (9002, None, None, None, None), (None, data.sentence(rng, 20), "en", "s", 1)]
    labels += [(9002, None), (None, 1), (7, 1), (5, 1)]
    df, lab = data.documents(llm_spark, rows), llm_spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, lab).collect()}
    assert len(got) == len(rows)
    good = [i for i in range(6000) if i % 5]
    assert sum(not got[i]["kept"] for i in good) <= quality.ALPHA * len(good)
    assert sum(got[i]["kept"] for i in range(0, 6000, 5)) < 60
    assert not got[9001]["kept"] and not got[9002]["kept"] and got[None]["kept"]


def test_quality_few_hundred_labels_admit_rules(llm_spark):
    # 400 and 300 good labels by language, none with symbols; 100 in a third are too few
    rng = random.Random(6)
    rows, labels = [], []
    for lang, n in (("en", 400), ("fr", 300), (None, 100)):
        for i in range(n + 60):
            d = len(rows)
            rows.append((d, data.sentence(rng, 30) + (" ###" * 4 if i >= n else ""), lang, "s", 1))
            labels.append((d, int(i < n)))
    df, lab = data.documents(llm_spark, rows), llm_spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df, lab).collect()}
    assert all(kept[d] for d, good in labels if good)
    assert [sum(kept[r[0]] for r, (_, good) in zip(rows, labels) if not good and r[2] == lang) for lang in ("en", "fr", None)] == [0, 0, 60]


def chain_rows(spark, rows):
    """Labelled rows (stratum, h1, good, features) with the step that rejects them first."""
    columns = "stratum string, h1 long, good boolean, symbol_share long, repeat_share long, dup_line_share long, mean_word long"
    return spark.createDataFrame(rows, columns).selectExpr("*", "0L AS h2", "false AS base_failed").withColumn("first", quality.first_step())


def test_quality_chain_counts_unions(llm_spark):
    # the first two steps of symbols reject no good label; the second of repeats makes it 3 % of them, where the chain ends
    steps = quality.chain()
    assert len(steps) == 50 and [r for r, _ in steps[:5]] == list(quality.RULES) and steps[5] == ("symbols", 200) and steps[6] == ("repeats", 150)
    rows = [("en", i, True, 0, 160 if i < 30 else 0, 0, 550) for i in range(1000)]
    rows += [("en", 2000 + i, False, 220, 0, 0, 550) for i in range(30)] + [("en", 3000 + i, False, 0, 0, 0, 1600) for i in range(20)]
    used = quality.calibrate(chain_rows(llm_spark, rows))
    assert used == {"en": 5}  # long words fell at step 3, symbols at step 5: more than one rule acts
    kept = chain_rows(llm_spark, rows).withColumn("no", quality.rejected(used)).groupBy("good").agg({"no": "max", "*": "count"})
    assert {r["good"]: r["max(no)"] for r in kept.collect()} == {True: False, False: True}


def test_quality_copies_are_no_evidence(llm_spark):
    # 400 labels admit a set; 40 different texts, ten times each, do not
    bad = [("en", 9000 + i, False, 400, 0, 0, 550) for i in range(40)]
    assert quality.calibrate(chain_rows(llm_spark, [("en", i, True, 0, 0, 0, 550) for i in range(400)] + bad)) == {"en": 0}
    assert quality.calibrate(chain_rows(llm_spark, [("en", i % 40, True, 0, 0, 0, 550) for i in range(400)] + bad)) == {}
    rng = random.Random(7)
    text = data.sentence(rng, 30)
    rows = [(0, text, "en", "s", 1)] * 400 + [(i, text, "en", "s", 1) for i in range(1, 200)] + [(1000 + i, data.sentence(rng, 30) + " ###" * 4, "en", "s", 1) for i in range(40)]
    labels = llm_spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows], "doc_id long, quality int")
    got = quality.quality_rules(data.documents(llm_spark, rows), labels)
    assert got.count() == len(rows) and got.filter("NOT kept").isEmpty()


def test_quality_without_labels_or_rows(llm_spark):
    labels = llm_spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_rules(data.documents(llm_spark), labels)
    assert got.filter("kept = base_failed").isEmpty()
    assert quality.quality_rules(data.empty(llm_spark), labels).count() == 0


# sharding

def test_shards_are_near_equal_and_gapless(llm_spark):
    docs = data.document_rows()
    docs += [(1000 + i, data.sentence(random.Random(i), 5 + i % 90), "en", "s", 1) for i in range(600)]
    got = sharding.shard_by_bytes(data.documents(llm_spark, docs)).collect()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, brute.crc(r[1])) for r in docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(16))
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sharding.shard_by_bytes(data.empty(llm_spark)).count() == 0


def test_repeated_rows_are_dealt_over_shards(llm_spark):
    rows = [(i, data.sentence(random.Random(i), 40), "en", "s", 1) for i in range(500)]
    rows += [(7, data.sentence(random.Random(7), 400), "en", "s", 1)] * 250
    got = sharding.shard_by_bytes(data.documents(llm_spark, rows)).collect()
    loads = [sum(r["size"] for r in got if r["shard"] == k) for k in range(16)]
    assert len(got) == len(rows) and max(loads) < 1.05 * sum(loads) / 16
    assert {r["map_version"] for r in got} == {2}  # the map in turn, edited for the sizes


def test_placement_follows_the_stored_map(llm_spark, tmp_path):
    rows = [(i, data.sentence(random.Random(i), 5 + i % 90), "en", "s", 1) for i in range(300)]
    got = sharding.shard_by_bytes(data.documents(llm_spark, rows), map_path=str(tmp_path)).collect()
    first, second = ({r["virtual_slot"]: r["shard"] for r in sharding.read_map(llm_spark, str(tmp_path), v).collect()} for v in (1, 2))
    assert first == {s: s % 16 for s in range(sharding.SLOTS)} and all(second[r["virtual_slot"]] == r["shard"] for r in got)
    sums = {s: (sum(r["size"] for r in got if r["virtual_slot"] == s), 0) for s in {r["virtual_slot"] for r in got}}
    assert list(second.values()) == sharding.rebalanced([s % 16 for s in range(sharding.SLOTS)], sums, 16)
    version, _ = sharding.rebalance(llm_spark, str(tmp_path), 2, sums, 16)
    assert version == 2  # nothing to move: no new version


def test_map_versions_move_whole_slots(llm_spark, tmp_path):
    rng = random.Random(2)
    sums = {s: (rng.randrange(1, 2000), 3) for s in range(512)}
    first = sharding.rebalanced(sharding.first_map(16, 512), sums, 16)
    loads = [sum(sums[s][0] for s in range(512) if first[s] == k) for k in range(16)]
    assert max(loads) - min(loads) <= 2000
    grown = sharding.rebalanced(first, sums, 17)
    loads = [sum(sums[s][0] for s in range(512) if grown[s] == k) for k in range(17)]
    assert max(loads) < 1.1 * sum(loads) / 17
    assert all(b == 16 for a, b in zip(first, grown) if a != b and b == 16)
    assert sum(a != b for a, b in zip(first, grown)) < 100
    assert max(sharding.rebalanced(grown, sums, 12)) == 11
    path = str(tmp_path)
    sharding.write_map(llm_spark, path, 1, first, sums)
    sharding.write_map(llm_spark, path, 2, grown, sums)
    assert [r["shard"] for r in sharding.read_map(llm_spark, path, 1).orderBy("virtual_slot").collect()] == first
    assert [r["shard"] for r in sharding.read_map(llm_spark, path, 2).orderBy("virtual_slot").collect()] == grown


def test_oracles_agree(llm_spark):
    from colweave.llm.oracle import oracles
    from colweave.llm.queries import registry

    from ..conftest import SF_SMALL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in oracles().items():
        got = registry()[name](llm_spark, SF_SMALL)
        found = con.execute(sql)
        order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns), name
        back = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted((tuple(r[i] for i in order) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in back) for r in found.fetchall()), key=key), name
