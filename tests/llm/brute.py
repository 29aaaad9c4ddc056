"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import math
import re

BASE = [
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    out = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


def normal_below(z):
    t = 1 / (1 + 0.2316419 * abs(z))
    upper = math.exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return upper if z < 0 else 1 - upper


def candidate_class(token, encodings, excess):
    """(encoding, length class) and bin of p of a candidate, one step after the other."""
    core = token.rstrip("=")
    name, alphabet = next((n, a) for n, a in encodings if set(core) <= set(a))
    codes = [alphabet.index(c) + 1 for c in core]
    n, k = len(codes), len(alphabet)
    chi = k * sum(codes.count(c) ** 2 for c in set(codes)) / n - n
    middle = k / 2 + 0.5
    above = sum(c > middle for c in codes)
    runs = 1 + sum((a > middle) != (b > middle) for a, b in zip(codes, codes[1:]))
    lagged = sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))
    expected = 2 * above * (n - above) / n + 1
    spread = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
    runs_z, serial_z = (runs - expected) / math.sqrt(spread), lagged / ((k * k - 1) / 12 * math.sqrt(n - 1))
    shift = (n - 1) * excess[name]
    mean = k - 1 + shift
    root = 2 * (1 + shift / mean) / (9 * mean)
    text_z = ((max(chi, 0) / mean) ** (1 / 3) - 1 + root) / math.sqrt(root)
    two_sided = lambda z: 2 * (1 - normal_below(abs(z)))
    p = 1.0
    if expected > 2.5 and two_sided(runs_z) >= 0.01 and two_sided(serial_z) >= 0.01:
        own = [normal_below(text_z), 1 - two_sided(abs(runs_z) + 0.5 / math.sqrt(spread)), 1 - two_sided(abs(serial_z) + 6 / ((k * k - 1) * math.sqrt(n - 1)))]
        own = [math.log(max(x, 1e-300)) for x in own]
        t = -2 * own[0] - (own[1] + own[2]) / 2
        p = min(1.0, math.exp(-2 * t) * (1 + 2 * t) + (2 / 1.5) ** 2 * (math.exp(-t / 2) - math.exp(-2 * t) * (1 + 1.5 * t)))
    return (name, min(int(math.log2(n / 5)), 8)), max(0, min(math.floor(-math.log10(max(p, 1e-300)) * 10), 400))


def all_spans(rows, encodings, excess):
    """The listed spans of each of rows (id, text): the base ones, and free candidates that pass the control over all rows."""
    free, bins = {}, {}
    for i, text in rows:
        base = base_spans(text)
        free[i] = []
        for m in CANDIDATE.finditer(text or ""):
            if not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                own, b = candidate_class(m[0], encodings, excess)
                free[i].append((m.start(), m.end(), own, b))
                bins.setdefault(own, []).append(b)
    least = {}
    for own, found in bins.items():
        ok = [b for b in set(found) if 10 ** (-b / 10) <= 0.05 * sum(x >= b for x in found) / len(found)]
        least[own] = min(ok, default=401)
    return {i: listed(sorted(base_spans(text) + [(a, 3, b, "random") for a, b, own, p in free[i] if p >= least[own]])) for i, text in rows}
