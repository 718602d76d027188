"""The contracts of the operators in plain Python, over a list of (doc_id, text, source)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def no_overlap(hits):
    return [m for m in hits]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def exact_groups(rows):
    """Per row: (keep_id, group_size, sha)."""
    groups = defaultdict(list)
    for i, (d, t, _) in enumerate(rows):
        groups[SPACE.sub(" ", t or "")].append(i)
    out = {}
    for text, members in groups.items():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = (min(ids) if ids else None, len(members), sha(text))
    return out


def fingerprint(text):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows):
    fps = [fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [d for d in members[find(i)] if d is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def byte_repeats(rows, window=400):
    texts = [(t or "").encode() for _, t, _ in rows]
    starts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (d, _, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(t), sum(gone), runs, sha(kept)))
    return out


def word_repeats(rows, window=50):
    least = {}
    order = lambda d: (d is None, d or 0)
    split = [words(t) for _, t, _ in rows]
    for (d, _, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, order(d)), order(d))
    out = []
    for (d, _, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def rule_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def targets(sizes):
    """Target of each source: water filling by weight with a cap of three times the size."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * level >= 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(rows, items, top=10):
    """``(item_id, rank, doc_id, score)`` of every distinct (item_id, text), over all rows."""
    docs = [(d, terms(t)) for d, t, _ in rows]
    n_docs, total = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    counted = [(d, len(t), Counter(t)) for d, t in docs]
    out = []
    for item, text in set(items):
        scores = []
        for d, n, tf in counted:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = 0
            for w in set(terms(text)):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, rank, d, -score))
    return out


def phrases(rows, top=2000, least=10):
    """``(lang, rank, phrase, a, l, r, n, score)`` over rows ``(doc_id, text, source, lang)``."""
    f, n = Counter(), Counter()
    for _, t, _, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    by_lang = defaultdict(list)
    for (lang, p), a in found.items():
        if any(len(q) > len(p) and lg == lang and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (lg, q), b in found.items() if len(q) == 3):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, xs in by_lang.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(xs)[:top], 1)
    ]


def license_base(text, base):
    w = terms(text)
    spots = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in spots]
    return len(w), len(spots), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in spots}))
