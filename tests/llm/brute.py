"""Plain versions of the operators over {doc_id: text}, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, fold=False):
    raw = text.encode()
    return WORD.findall(raw.lower() if fold else raw)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def statistics(text):
    w = words(text)
    counts = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def groups(docs):
    """{doc_id: (set size, smallest linked doc_id)}"""
    sets = {}
    for d, t in docs.items():
        w = words(t, True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, s in sets.items():
        for other, both in Counter(o for x in s for o in holders[x] if o < d).items():
            if 100 * both >= 75 * (len(s) + len(sets[other]) - both):
                a, b = find(d), find(other)
                top[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in docs}


def stripped_bytes(docs, size=50):
    """{doc_id: (bytes, removed, spans, SHA-256 of the rest)}"""
    first = {}
    for d in sorted(docs):
        raw = docs[d].encode()
        for i in range(len(raw) - size + 1):
            first.setdefault(raw[i : i + size], d)
    out = {}
    for d, t in docs.items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = len(raw), sum(gone), spans, sha(bytes(c for c, g in zip(raw, gone) if not g))
    return out


def stripped_words(docs, size=13):
    """{doc_id: (words, removed, the words that stay)}"""
    first = {}
    for d in sorted(docs):
        w = words(docs[d])
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in docs.items():
        w = words(t)
        gone = {i + k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < d for k in range(size)}
        out[d] = len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def base_scores(docs):
    """{doc_id: (held out, tokens, known, training tokens, base score)}"""
    tokens = {d: [*words(t, True), None] for d, t in docs.items()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    count = Counter(x for d in docs if d not in held for x in tokens[d])
    n, v = sum(count.values()), len(count)
    return {d: (d in held, len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in tokens.items()}


# --- clusters, personal data, filters ----------------------------------------------------


def clusters(rows, size=64, k=40, rounds=5):
    """[(vec_id, cluster, distance, cluster inertia, inertia, SHA-256 of the centroid)] of (vec_id, vector) rows."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}".encode()), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(place(v)[1], []).append(v)
        for c, vs in mine.items():
            centers[c] = [sum(col) // len(vs) for col in zip(*vs)]
    placed = [(i, *place(v)) for i, v in kept]
    inside = Counter()
    for _, d, c in placed:
        inside[c] += d
    return [(i, c, d, inside[c], sum(inside.values()), sha(",".join(map(str, centers[c])).encode())) for i, d, c in placed]


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal(text):
    """[(start, kind number, end, value)] of the base patterns."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            if _passes(kind, m.group()):
                value = m.group().lower() if kind == "email" else ".".join(str(int(p)) for p in m.group().split(".")) if kind == "ip" else re.sub("[^0-9]", "", m.group())
                out.append((m.start(), k, m.end(), value))
    return sorted(out)


def terms(word):
    t = word.lower().strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
    return () if not any(c.isalpha() for c in t) else (t, t[:4] + "*") if len(t) > 4 else (t,)


def disclosures(texts, reach=8, alpha=0.9, support=2):
    """Per text: (counts of the four kinds, base spans, terms that it must hide: {term: generalised})."""
    spans = [personal(t) for t in texts]
    n, n_term, n_entity, n_kind, n_both, near = len(texts), Counter(), Counter(), Counter(), Counter(), []
    for t, ss in zip(texts, spans):
        every = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        n_term.update({x for *_, w in every for x in terms(w)})
        apart = [w for w in every if not any(a < w[1] and w[0] < b for a, _, b, _ in ss)]
        around = {}
        for a, k, b, v in ss:
            left, right = [w for w in apart if w[0] <= a][-reach:], [w for w in apart if w[0] >= b][:reach]
            around.setdefault((k, v), set()).update(x for *_, w in left + right for x in terms(w))
        near.append(around)
        n_entity.update(list(around))
        n_kind.update({k for k, _ in around})
        n_both.update((e, x) for e, xs in around.items() for x in xs)

    def reveals(e, x):
        ic, pmi = math.log2(n / n_entity[e]), math.log2(n_both[e, x] * n / (n_term[x] * n_entity[e]))
        return n_both[e, x] >= support and pmi >= alpha * ic and pmi > math.log2(n / n_kind[e[0]])

    return [(ss, {x for e, xs in around.items() for x in xs if reveals(e, x)}) for ss, around in zip(spans, near)]


def audited(rows, good, toxic):
    """{(part, order, step): (kept, removed, redundant, unique fails, good lost, toxic lost, shapley)} of (doc_id, text, lang) rows, order by order."""
    from itertools import permutations

    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = {}
    for d, t, lang in rows:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and least[t] < d,
        }
        parts.setdefault(lang or "", []).append((d, {f for f, x in fails.items() if x}))
    out, share = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[part, f] += len(gone)
                failing = sum(f in x[1] for x in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}
