"""DuckDB SQL for those queries of the text operators that SQL can express.

Language identification, near duplicates, language-model scores (learned or
hashed models), token counts and packing (a tokenizer) and sharding (DuckDB has
no crc32) are tested against plain restatements instead.
"""

from __future__ import annotations

from colweave.llm.linededup import MIN_CHARS, MIN_SITES
from colweave.llm.quality import ALPHA, COST, DELTA, RULES, chain

LINES = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line) AS key FROM l),
b AS (
  SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT k.*, b.key IS NOT NULL AND b.home <> k.doc_id AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ITEMS = f"""
WITH i AS (SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 12], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

PAGES = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, url,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def manifest_sql(levels: int = 7) -> str:
    """Trees of at most 8^levels leaves: the digests of every level by place, and each leaf's way up."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, leaves: str) -> str:
        """{name}k: g, i, n, h of level k; {name}r: g and root."""
        parts = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            parts.append(
                f"{name}{k} AS (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h"
                f" FROM {name}{k - 1} WHERE n > 1 GROUP BY g, i // 8, (n + 7) // 8)")
        for k in range(levels + 1):  # whole runs, to cut siblings from
            parts.append(f"{name}w{k} AS (SELECT g, i // 8 AS p, string_agg(h, '' ORDER BY i) AS w FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8)")
        parts.append(f"{name}r AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
        return ", ".join(parts)

    def way(name: str, out: str, rows: str, start: str) -> str:
        """Up through a tree: the siblings so far (sib) and the digest that follows from ``start`` (f)."""
        parts = [f"{out}0 AS (SELECT *, '' AS {out}sib, {start} AS {out}f FROM {rows})"]
        for k in range(levels + 1):
            slot = f"((i // {8 ** k}) % 8)"
            parts.append(
                f"{out}{k + 1} AS (SELECT x.* EXCLUDE ({out}sib, {out}f),"
                f" {out}sib || CASE WHEN w IS NULL THEN '' ELSE left(w, 64 * {slot}) || substr(w, 64 * {slot} + 65) END AS {out}sib,"
                f" CASE WHEN w IS NULL THEN {out}f ELSE sha256(left(w, 64 * {slot}) || {out}f || substr(w, 64 * {slot} + 65)) END AS {out}f"
                f" FROM {out}{k} x LEFT JOIN {name}w{k} y ON x.g = y.g AND x.i // {8 ** (k + 1)} = y.p)")
        return ", ".join(parts)

    return f"""
WITH t AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(n))),
d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
    sha256({head} || {field.format("text")}) AS leaf, sha256({head} || {field.format(low)}) AS lowered,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit
  FROM documents, t),
l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{tree("a", "SELECT g, i, n, leaf AS h FROM l")},
{tree("b", "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM ar")},
bi AS (SELECT g AS og, row_number() OVER (ORDER BY g) - 1 AS j, h AS subroot FROM ar),
{way("a", "u", "l", "CASE WHEN hit THEN lowered ELSE leaf END")},
m AS (SELECT doc_id, leaf, subroot, '' AS g, j AS i, usib, uf FROM u{levels + 1} x JOIN bi ON x.g = bi.og),
{way("b", "v", "m", "uf")}
SELECT doc_id, leaf, subroot, h AS root, sha256(usib || vsib) AS proof_sha256, vf AS folded_root, vf = h AS verified
FROM v{levels + 1}, br
"""


def quality_sql() -> str:
    """Base columns, then the same tests: the steps of the chain up to the first that the exact binomial tail does not admit, the best gain."""
    steps = chain()
    first = " ".join(f"WHEN {RULES[rule][0]} {'>' if RULES[rule][1] else '<'} {c} THEN {j}" for j, (rule, c) in enumerate(steps))
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, text IS NULL AS missing FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(s, s + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars END AS symbol_share,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat_share,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_line_share,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS mean_word FROM b),
y AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT *, CASE {first} ELSE {len(steps)} END AS step FROM f),
x AS (
  SELECT stratum, text, step, min(good::INT) = 1 AS good FROM o JOIN y USING (doc_id) JOIN (SELECT DISTINCT doc_id, text FROM d) USING (doc_id)
  WHERE NOT base_failed GROUP BY stratum, text, step),
n AS (
  SELECT s.stratum, j, count(*) FILTER (good) AS ng, count(*) FILTER (NOT good) AS nb,
    count(*) FILTER (good AND step <= j) AS kg, count(*) FILTER (NOT good AND step <= j) AS kb
  FROM x s, range({len(steps)}) r(j) GROUP BY ALL),
a AS (
  SELECT *, kb / greatest(nb, 1) - {COST} * kg / ng AS gain, ng > 0 AND list_sum(list_transform(range(0, kg + 1), lambda i: exp(
    lgamma(ng + 1) - lgamma(i + 1) - CASE WHEN ng = i THEN 0 ELSE lgamma(ng - i + 1) END
    + i * ln({ALPHA!r}) + (ng - i) * ln(1 - {ALPHA!r})))) <= {DELTA!r} / (SELECT count(DISTINCT stratum) FROM x) AS passes
  FROM n),
e AS (SELECT stratum, min(j) FILTER (NOT passes) AS stop FROM a GROUP BY stratum),
z AS (SELECT stratum, arg_min(j, struct_pack(g := -gain, j := j)) AS last FROM a JOIN e USING (stratum) WHERE j < coalesce(stop, {len(steps)}) AND gain > 0 GROUP BY stratum)
SELECT o.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(step > last, true) AS kept
FROM o LEFT JOIN z ON o.stratum = z.stratum
"""


def oracles() -> dict[str, str]:
    return {
        "op2_line_dedup": LINES,
        "op3_decontamination": ITEMS,
        "op7_warc": PAGES,
        "op9_quality_rules": quality_sql(),
        "op12_merkle_manifest": manifest_sql(),
    }
