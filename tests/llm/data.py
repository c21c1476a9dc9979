"""Small awkward tables: nulls everywhere, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

CLASH = ("words", "key", "pos", "size", "n", "row", "cls", "line", "site", "th", "id", "lang_pred", "length", "rank", "start", "item")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("w" + "abcdefghij"[rng.randrange(vocabulary) % 10] + str(rng.randrange(vocabulary)) for _ in range(n))


def document_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(sentence(rng, 40) for _ in range(700))
    texts = [None, "", "   \n\t ", "word", "two words", "!!! 123 ???", base, base, " ".join(near), base.upper(), long, "x" * 30_000,
             "a b c d e f g h i j " * 30, "Ünïcödé ñandú straße 日本語 \U0001f600 ok", "line\r\nwith\rreturns\n\nand blanks  \n", sentence(rng, 10)]
    texts += [sentence(rng, rng.randrange(3, 80)) for _ in range(30)]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 14}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (None, "lone text without id", "en", "s1", 20)]
    rows += [rows[6], rows[20], rows[20]]  # repeated rows
    shared = "this very line is on a great many sites of the web"
    rows += [(100 + i, f"{sentence(rng, 20)}\n {shared} \n{sentence(rng, 20)}", "en", f"s{i}", 1) for i in range(12)]
    rows.append((200, shared, "en", "s3", 1))
    return rows


def documents(spark, rows=None):
    rows = document_rows() if rows is None else rows
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])


def distinct_ids(rows):
    """Rows with ids that are known and not repeated, for rules told by id."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out
