"""Plain Python versions of what the queries return."""

import hashlib
import math
import re
import zlib
from collections import Counter


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def fold(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def secrets(t):
    out = []
    for m in re.finditer(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or ""):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(out)]


def luhn(s):
    d = [int(x) for x in s][::-1]
    return (sum(d[0::2]) + sum((2 * x - 9 if 2 * x > 9 else 2 * x) for x in d[1::2])) % 10 == 0


def pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


def rule_counts(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    seen, hit = Counter(win), set()
    for k, x in enumerate(win):
        if seen[x] > 1:
            hit |= set(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def bench(docs, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")) if x]
    known = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in known}
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def base_scores(docs, held):
    tokens = {i: words(low(t or "")) + [None] for i, t in docs}
    c = Counter(x for i in tokens if not held[i] for x in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for i, t in tokens.items()}
