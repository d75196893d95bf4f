"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter

import xxhash

from tierstats.llm import decontam

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def strip_repeats(rows, k=35):
    """rows (id, text) -> sorted (id, n_words, n_removed, kept_sha256)."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p + o for p in range(len(w) - k + 1) if seen[tuple(w[p : p + k])] > 1 for o in range(k)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=str)


def line_dedup(rows, least=10):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    docs = Counter(k for _, k in {(i, key(x)) for i, t in rows for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and docs[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def fingerprint(text, k=4):
    w = WORD.findall(low(text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """prints: id -> fingerprint; id -> smallest id reachable."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(out))


def em(patterns, labelers, rounds=50, shared=10.0):
    """Expectation-maximisation as pii.reliabilities states it, one count at a time: each pattern's posterior."""
    post = {(k, p): 1 / (1 + math.exp(1 - 2 * sum({"-": -1, "0": 0, "+": 1}[c] for c in p[:labelers]))) for k, p, _ in patterns}
    kinds = {k for k, *_ in patterns}
    for _ in range(rounds):
        own, pooled, private, total = Counter(), Counter(), Counter(), Counter()
        for k, p, n in patterns:
            q = post[k, p]
            private[k] += n * q
            total[k] += n
            for lab in range(labelers):
                for c, w in ((0, n * (1 - q)), (1, n * q)):
                    own[k, lab, c, p[lab]] += w
                    pooled[lab, c, p[lab]] += w
        rate = lambda lab, c, v: (pooled[lab, c, v] + 1) / (sum(pooled[lab, c, x] for x in "-0+") + 3)
        like = lambda k, lab, c, v: (own[k, lab, c, v] + shared * rate(lab, c, v)) / (sum(own[k, lab, c, x] for x in "-0+") + shared)
        prior = {k: (private[k] + 1) / (total[k] + 2) for k in kinds}
        for k, p, _ in patterns:
            score = math.log(prior[k] / (1 - prior[k])) + sum(math.log(like(k, lab, 1, p[lab]) / like(k, lab, 0, p[lab])) for lab in range(labelers))
            post[k, p] = 1 / (1 + math.exp(-max(-30, min(30, score))))
    return [post[k, p] for k, p, _ in patterns]


def leaks(docs, items, window=8, enough=5, shortest=4, least_words=3):
    """rows (id, text) -> sorted (id, item, start, exact), window by window; tokens and slots are the operator's."""
    slot = "\x01"

    def families(text):
        tokens, forms = decontam.canonical(text or "")
        more = decontam.with_capitals(text or "", forms)
        return {0: (tokens, forms)} | ({1: (tokens, more)} if more else {})

    def key(tokens, forms, at, k):
        part = forms[at : at + k]
        return tuple(tokens[at : at + k]) if sum(f[0] != slot for f in part) < min(k, least_words) else tuple(part)

    def slots(tokens, forms, at, k):
        return [t for t, f in zip(tokens[at : at + k], forms[at : at + k], strict=True) if f[0] == slot]

    def longest(places):
        best = run = 0
        for p in sorted(places):
            run = run + 1 if p - 1 in places else 1
            best = max(best, run)
        return best

    out = set()
    for d, text in docs:
        for item, words in items:
            found = {}
            for family, (it, form) in families(words).items():
                if family not in families(text):
                    continue
                dt, df = families(text)[family]
                k = min(window, len(it))
                n = len(it) - k + 1 if it else 0
                need = min(n, enough)
                for start in range(1 - n, len(dt)):
                    if k < shortest and len(dt) != k:
                        continue
                    hits = {i: (slots(it, form, i, k), slots(dt, df, start + i, k)) for i in range(n) if 0 <= start + i <= len(dt) - k and key(it, form, i, k) == key(dt, df, start + i, k)}
                    alike = {i for i, (a, b) in hits.items() if a == b}
                    good = bool(hits) and longest(alike) >= need
                    for first in [i for i in hits if i - 1 not in hits]:
                        run = first
                        pairs = set()
                        while run in hits:
                            pairs |= set(zip(*hits[run], strict=True))
                            run += 1
                        if run - first >= need and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                            good = True
                    if good:
                        found.setdefault(start, []).append(len(alike) == len(hits))
            out |= {(d, item, start, all(same)) for start, same in found.items()}
    return sorted(out)
