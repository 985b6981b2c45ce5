"""Plain Python versions of the queries' contracts, one document at a time or all against all."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substrings(docs, window=50):
    """doc_id -> (n_words, n_removed, sha of what is kept)."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept)))
    return out


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, N, base_score)."""
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(ts), sum(t in counts for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        for d, ts in tokens.items()
    }


def simhash(text) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], bits=3):
    """doc_id -> smallest doc_id reachable over links of up to ``bits`` bits."""
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in prints}


def secrets(text):
    """(n_assign, n_access, n_hex, sha of the base spans)."""
    text = text or ""
    spans, counts = [], []
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found = [m for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        counts.append(len(found))
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return (*counts, sha(",".join(s[2] for s in sorted(spans))))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """(n_email, n_ip, n_card, n_phone, sha of the base spans)."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    spans, counts = [], []
    for kind, pattern, right in kinds:
        found = [m for m in re.finditer(pattern, text) if right(m)]
        counts.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, sha(",".join(spans)))


def contamination(docs, items, window=10):
    """doc_id -> (n_words, n_hit, n_items, sha of the items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = CLEAN.findall(lower(text or ""))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = {}
    for d, text in docs:
        w = CLEAN.findall(lower(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def edits(docs):
    """doc_id -> (n_chars, sha of the edited text)."""
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for i, (d, text) in enumerate(order):
        moved = len(text) // 3
        out[d] = (len(text), sha(text[: len(text) - moved] + order[(i + 1) % len(order)][1][:moved]))
    return out


def alignments(docs, a, b, bytes_a, bytes_b):
    """doc -> (n_a, n_b, n_groups, n_links, n_best, count_sum, sha of the groups), whole texts, all pairs of tokens compared.

    ``a`` and ``b`` encode a text, ``bytes_*`` give an id's bytes. ``docs`` is a list, so that ids may repeat.
    """
    rows, counts = [], Counter()
    for _, text in docs:
        ids = (a(" " + text), b(text)) if text else ([], [])
        spans = []
        for side, raw in zip(ids, (bytes_a, bytes_b)):
            at, out = 0, []
            for i in side:
                out.append((at, at + len(raw(i)), i))
                at += len(raw(i))
            spans.append(out)
        spelt = [b"".join(raw(i) for i in side) for side, raw in zip(ids, (bytes_a, bytes_b))]
        if not text or any(s != (" " + text).encode() for s in spelt):
            rows.append(None)
            continue
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans))
            low = high
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        counts.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if r is None
        else (*r[:3], len(r[3]), sum(counts[p] == highest[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), sha(r[4]))
        for r in rows
    ]


def merkle(rows):
    """For rows (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof sha, folded root, verified, in order."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def level(nodes):
        return [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]

    def tree(nodes):
        """The root, and for each leaf its (before, after) from below."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, i in zip(paths, at):
                run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
                path.append(("".join(run[: i % 2]), "".join(run[i % 2 + 1 :])))
            nodes, at = level(nodes), [i // 2 for i in at]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *tree([leaf(r) for r in mine])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for row, path in zip(mine, paths):
            doc, n = row[0], row[3]
            if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0:
                n += 1
            node = leaf((*row[:3], n, row[4]))
            for before, after in path + top:
                node = sha(before + node + after)
            proof = sha("".join(b + a for b, a in path + top))
            out.append((doc, leaf(row), subroot, root, proof, node, node == root))
    return out
