"""Plain forms of the operators' contracts, one text after the other, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def licenses(text):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    ws = words(text, ALNUM)
    found = [(i, label) for phrase, label in base.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(ws), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def contamination(docs, items):
    windows = {}
    for name, text in items:
        ws = words(text, ALNUM)
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[i : i + 13]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws, hit, names = words(text, ALNUM), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(ws[i : i + n])]
        out.append((doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def shingles(text, size=5):
    ws = words(text, SPACED)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)])


def near(docs, percent=85):
    sets = {}
    for doc_id, text in docs:
        sets.setdefault(shingles(text), []).append(doc_id)
    keys = [s for s in sets if s]
    index, parent = {}, list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(keys):
        shared = Counter(j for x in s for j in index.get(x, ()))
        for j, common in shared.items():
            if 100 * common >= percent * (len(s) + len(keys[j]) - common):
                parent[root(k)] = root(j)
        for x in s:
            index.setdefault(x, []).append(k)
    least = {}
    for k, s in enumerate(keys):
        least[root(k)] = min([*sets[s], least.get(root(k), float("inf"))])
    comp = {d: least[root(k)] for k, s in enumerate(keys) for d in sets[s]}
    return [(d, len(shingles(t)), comp.get(d, d), comp.get(d, d) == d) for d, t in docs]


def quality_counts(text):
    ws = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    named = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(named.encode()).hexdigest()


def repeated_bytes(texts, size=200):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in blobs for i in range(len(b) - size + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def unigrams(docs):
    def tokens(text):
        return [*words(text, SPACED), None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0

    counts = Counter(t for d, x in docs if not held(d) for t in tokens(x))
    total, kinds = sum(counts.values()), len(counts)
    return [(d, held(d), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens(x))) for d, x in docs]


def targets(sizes, repeats=3):
    """(source, size) pairs in order of their sources: targets by weights 1, 2, 3."""
    total, weight = sum(sizes), [k % 3 + 1 for k in range(len(sizes))]
    capped = set()
    while True:
        rest, free = total - repeats * sum(sizes[k] for k in capped), sum(w for k, w in enumerate(weight) if k not in capped)
        out = [repeats * n if k in capped else rest * weight[k] / free for k, n in enumerate(sizes)]
        over = {k for k, n in enumerate(sizes) if k not in capped and out[k] > repeats * n}
        if not over:
            return out
        capped |= over


BLANK = re.compile(r"[\x20\x09-\x0D]")
AUTOMATON = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(conv, turn, role, text):
    conv_s, turn_s, role, text = (" " if x is None else str(x) for x in (conv, turn, role, text))
    kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def repair(rows):
    """One conversation: all (cost, audit, roles) of least cost by rows and states, one row after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = BLANK.sub("", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    states = {0: (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for q, (cost, audit, out) in list(table.items()):
                for r, then in AUTOMATON[q].items():
                    if r in "ua":
                        better(table, then, (cost + 5, audit + "I", (*out, ({"u": "user", "a": "assistant"}[r], ""))))
        return table

    states = inserted(states)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (cost, audit, out) in states.items():
            better(new, q, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if role[:1] in AUTOMATON[q]:
                better(new, AUTOMATON[q][role[:1]], (cost + extra, audit + "K", (*out, (role, text))))
            for r, name in (("u", "user"), ("a", "assistant")):
                if r in AUTOMATON[q]:
                    better(new, AUTOMATON[q][r], (cost + 1 + extra, audit + "R", (*out, (name, text))))
        states = inserted(new)
    cost, audit, out = min(states[q] for q in (0, 3) if q in states)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def repairs(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend(damage(conv, turn, role, text))
    return [(c, *repair(r)) for c, r in convs.items()]


def vector_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(x * 256) for x in v], lab) for i, v, lab in kept]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[v[p * d : p * d + d] for _, v, _ in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[p * d : p * d + d]
                groups.setdefault(nearest(p, x)[1], []).append(x)
            new = list(book[p])
            for k, xs in groups.items():
                new[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
            book[p] = new
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    out, labels = [], Counter()
    for i, v, lab in kept:
        found = [nearest(p, v[p * d : p * d + d]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
        labels[lab] += out[-1][2]
    return [(i, code, error, labels[lab], sha) for i, code, error, lab in out]
