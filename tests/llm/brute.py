"""The corpus operators once more, slowly and plainly, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def weighted_shingles(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1.0 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def jaccard(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a or b else 0.0


def near_duplicate_classes(rows, threshold=0.8):
    """{doc_id: least doc_id of its class} for rows of (doc_id, text)."""
    rows = sorted(rows)
    bags = [weighted_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            # probability Jaccard is at most n common shingles of n, so few common ones settle it
            if same or (bags[i] and bags[j] and len(bags[i].keys() & bags[j].keys()) * 2 > max(len(bags[i]), len(bags[j])) and probability_jaccard(bags[i], bags[j]) >= threshold - 1e-9):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def repeated_bytes(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} for rows of (doc_id, text)."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            window = body[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(window)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[key] = (len(body), sum(gone), spans, kept)
    return out


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def mixing_targets(sizes, weights=(5, 2, 1)):
    """{source: target} from {source: size}: 150 % of all, at most twice each, the excess by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
