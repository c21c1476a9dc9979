"""Plain restatements of the text operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontamination(docs, items, window=13):
    """doc rows (doc_id, text), item rows (item_id, text) -> list of result tuples."""
    index = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - window + 1)):
            if w:
                index[tuple(w[i : i + window])].add(None if item is None else str(item))
    lengths = {len(k) for k in index}
    out = []
    for doc, text in docs:
        w = ITEM_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in index:
                    hit.update(range(i, i + n))
                    found |= index[key] - {None}
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def line_dedup(docs, min_sites=5, min_chars=1):
    """doc rows (doc_id, site, text) with distinct ids -> (doc_id, n_lines, n_removed, text)."""
    sites, home = defaultdict(set), {}
    for doc, site, text in docs:
        for line in (text or "").split("\n") if text is not None else []:
            key = line.strip(" ")
            if len(key) >= min_chars and key.strip("\t\r\f\v "):
                sites[key].add(site)
                home[key] = min(home.get(key, doc), doc)
    bad = {k for k, s in sites.items() if len(s - {None}) >= min_sites}
    out = []
    for doc, _, text in docs:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad or home[x.strip(" ")] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality_base(text, width=5):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + width)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def crc(text):
    return zlib.crc32((text or "").encode())


def near_duplicates(docs, num=4, den=5):
    """doc rows (doc_id, text) -> {doc_id: (class_id, n_links)} by comparing all pairs that share a shingle."""
    sets = {}
    for doc, text in docs:
        w = [x.translate(UPPER) for x in SPACED.findall(text or "")]
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    index = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            index[x].append(doc)
    parent, links = {d: d for d in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, s in sets.items():
        shared = Counter(o for x in s for o in index[x] if o < doc)
        for o, n in shared.items():
            if den * n >= num * (len(s) + len(sets[o]) - n):
                links[doc] += 1
                links[o] += 1
                a, b = sorted((root(doc), root(o)))
                parent[b] = a
    return {d: (root(d), links[d]) for d in sets}


def unigram(docs):
    """doc rows (doc_id, text) -> {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    def tokens(text):
        return [w.translate(UPPER) for w in SPACED.findall(text or "")] + [None]

    def held(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2

    count = Counter(t for doc, text in docs if not held(doc) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = {}
    for doc, text in docs:
        ts = tokens(text)
        out[doc] = (held(doc), len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
    return out


def simhash(docs, words=4, radius=4):
    """(doc_id, text) with distinct ids -> {doc_id: (fingerprint, component_id)}, all pairs compared."""
    import xxhash

    prints = {}
    for doc, text in docs:
        w = SPACED.findall((text or "").translate(UPPER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(len(w) - words + 1, 1))] if w else []
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return {d: (f"{p:016x}", c) for (d, p), c in zip(prints.items(), reached(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius))}


def reached(nodes, linked):
    """The smallest node that each is connected with."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(n) for n in nodes]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_tree(leaves, fanout=8):
    """(root, for each leaf the siblings left and right of each node on its way)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // fanout * fanout :][:fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at = [i // fanout for i in at]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def merkle(rows, fanout=8):
    """(doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    def leaf(doc, source, lang, n, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: merkle_tree([leaf(*r) for r in groups[g]], fanout) for g in order}
    root, above = merkle_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above):
        for r, path in zip(groups[g], trees[g][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(*r[:4], r[4].translate(UPPER)) if hit and r[4] is not None else leaf(*r)
            for left, right in path + up:
                fold = sha(left + fold + right)
            out.append((r[0], leaf(*r), trees[g][0], root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return out


def alignment(docs, a, b):
    """(key, text) with distinct keys, whole texts through both libraries -> {key: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)}."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in printable}
    for x in range(256):
        if x not in printable:
            alphabet[chr(256 + len(alphabet) - len(printable))] = x
    links, facts = {}, {}
    for doc, text in docs:
        if not text:
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in ib]
        ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(ib, pieces)]
        if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            continue
        ends_a, ends_b = ([sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (ba, bb))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(tuple([i for i, e in zip(ids, ends) if low < e <= high] for ids, ends in ((ia, ends_a), (ib, ends_b))))
        starts_a, starts_b = [0, *ends_a], [0, *ends_b]
        links[doc] = [(x, y) for x, s, e in zip(ia, starts_a, ends_a) for y, t, f in zip(ib, starts_b, ends_b) if s < f and t < e]
        facts[doc] = (len(ia), len(ib), len(cuts), sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    held = Counter(p for pairs in links.values() for p in set(pairs))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return {
        d: (*facts[d][:3], len(links[d]), sum(held[p] == best[p[0]] for p in links[d]), sum(held[p] for p in links[d]), facts[d][3])
        if d in facts else (0, 0, 0, 0, 0, 0, "") for d, _ in docs}
