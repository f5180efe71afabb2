"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()


def near_duplicates(docs):
    """{doc_id: (n, component)}."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(docs, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what is left)}."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def leaks(docs, items, threshold=0.5, k1=1.2, b=0.75):
    """{(doc_id, item_id)}: BM25 of every passage against every piece, then the overlap check."""
    import math
    from collections import Counter

    from voxloom.llm.decontaminate import ANSWER, PASSAGE, QUESTION, QUESTION_ALONE, question_and_answer

    half = PASSAGE // 2
    split = lambda t: re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    indexed = []
    for i, t in items:
        w = split(t)
        k = max(1, -(-len(w) // half))
        cuts = [len(w) * j // k for j in range(k + 1)]
        indexed += [(i, t, x, len(w) - y, Counter(w[x:y])) for x, y in zip(cuts, cuts[1:]) if y > x]
    df = Counter(t for *_, c in indexed for t in c)
    mean = sum(sum(c.values()) for *_, c in indexed) / len(indexed)
    weigh = lambda c: {t: math.log(1 + (len(indexed) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * sum(c.values()) / mean)) for t, n in c.items()}
    weights = [weigh(c) for *_, c in indexed]
    grams = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    out = set()
    for d, text in docs:
        w = split(text)
        for at in range(0, len(w), half):
            passage = set(w[at : at + PASSAGE])
            for (i, t, before, after, _), own in zip(indexed, weights):
                if sum(x for term, x in own.items() if term in passage) < threshold * sum(own.values()) - 1e-5:
                    continue
                q, a = (split(x) for x in question_and_answer(t))
                if not q or not a:
                    q = a = split(t)
                n = max(1, min(5, len(q)))
                near = w[max(0, at - before - half) : at + PASSAGE + after + half]
                of_q = len(grams(q, n) & grams(near, n)) / len(grams(q, n))
                of_a = len(set(a) & set(near)) / len(set(a))
                if (of_q >= QUESTION and of_a >= ANSWER) or of_q >= QUESTION_ALONE:
                    out.add((d, i))
    return out


def grams(raw, dim=4096):
    """{place: how often} of the hashed 2- and 3-grams that hold a letter."""
    from collections import Counter

    v = [b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b > 127 or 97 <= b <= 122 else 32 for b in raw]
    v = [b + 32 if i and v[i - 1] == 0xC3 and 0x80 <= b < 0x9F else b for i, b in enumerate(v)]
    out = Counter()
    for n, add, times in ((2, 1, 2654435761), (3, 1 << 25, 2246822519)):
        for i in range(len(v) - n + 1):
            g = v[i : i + n]
            if any(b not in (32, 48) for b in g):
                out[((int.from_bytes(bytes(g), "big") + add) * times % 2**32) >> 20] += 1
    return out


def nearest_centroid(text, model):
    """(language, cosine) by plain sums."""
    import math

    w = {k: (1 + math.log(n)) * float(model.idf[k]) for k, n in grams(text.encode()).items()}
    norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
    sims = [sum(x * float(c[k]) for k, x in w.items()) / norm for c in model.centroids]
    best = max(range(len(sims)), key=lambda j: (sims[j], -j))
    return model.langs[best], sims[best]
