"""Plain Python versions of the operators, to hold results against."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items):
    """(doc_id, n_words, n_hit, item ids) by every window at every place."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((doc, len(w), len(hit), tuple(sorted(found, key=str))))
    return out


def near_items(docs, items, slack=5):
    """How many items each document has both rarest terms of a window of, at most slack words nearer or farther."""
    counts = defaultdict(int)
    for _, text in docs:
        for w in words(text):
            counts[w.lower()] += 1
    out = []
    anchors = set()
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            low = sorted((counts[w[p].lower()], p) for p in range(s, s + n))[:2]
            if low[0][0]:
                anchors.add((item, tuple((p, w[p]) for _, p in low)))
    for _, text in docs:
        at, found = defaultdict(list), set()
        for p, w in enumerate(words(text)):
            at[w].append(p)
        for item, ((p1, x1), *rest) in anchors:
            if not rest and at.get(x1) or rest and any(abs((a - p1) - (b - rest[0][0])) <= slack for a in at.get(x1, ()) for b in at.get(rest[0][1], ())):
                found.add(item)
        out.append(len(found))
    return out


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for i, (kind, pattern) in enumerate(zip(KINDS, PATTERNS, strict=True)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end()))
    return [(KINDS[i], a, b) for a, i, b in sorted(out)]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_classes(docs, threshold=0.8):
    """(class id, links) by position: all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    inverted, links = defaultdict(list), [0] * len(docs)
    for k, s in enumerate(sets):
        for g in s:
            inverted[g].append(k)
    for k, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for o in inverted[g]:
                if o > k:
                    near[o] += 1
        for o, n in near.items():
            if n / (len(s) + len(sets[o]) - n) >= threshold:
                links[k] += 1
                links[o] += 1
                root[find(k)] = find(o)
    low = {}
    for k, (doc, _) in enumerate(docs):
        ids = [doc] if doc is not None else []
        r = find(k)
        low[r] = min([*([low[r]] if low.get(r) is not None else []), *ids], default=None)
    return [(low[find(k)], links[k]) for k in range(len(docs))]


def sha256(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


LETTERS36 = set("abcdefghijklmnopqrstuvwxyz0123456789")


def ascii_lower(text):
    return text.translate(LOWER)


def secrets(text):
    """(start, end, kind) of assigned values and long tokens with a digit, the assigned ones first; provider formats aren't in the data."""
    text, out = text or "", []
    for m in re.finditer(r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth|credential|private_?key)['\"]?\s{0,3}(?:=>|:=|=|:)\s{0,3}['\"]?([^\s'\",;]{8,})", text):
        out.append((*m.span(1), "assigned"))
    taken = list(out)
    for m in re.finditer(r"[A-Za-z0-9_+/=-]+", text):
        if len(m.group()) >= 12 and re.search("[0-9]", m.group()) and not any(a < m.end() and m.start() < b for a, b, _ in taken):
            out.append((*m.span(), "long"))
    return out


def packed_bins(lengths, capacity):
    """Best-two-fit over a list of lengths, a bin at a time: largest first, then the smallest gives way to two that fill its gap better."""
    left, out = sorted(lengths), []
    while left:
        rest, gap, used = list(left), capacity, []
        while fit := [x for x in rest if x <= gap]:
            rest.remove(fit[-1])
            used.append(fit[-1])
            gap -= fit[-1]
        small = min(used)
        pairs = [(a + b, -a) for k, a in enumerate(rest) for b in rest[k + 1 :] if small < a + b <= gap + small] if gap else []
        if pairs:
            both, a = max(pairs)
            used.remove(small)
            used += [-a, both + a]
        for x in used:
            left.remove(x)
        out.append(sorted(used, reverse=True))
    return sorted(out)
