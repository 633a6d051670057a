"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from itertools import combinations

import numpy as np

BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def base_spans(text):
    found = []
    for order, (kind, pattern, ok) in enumerate(BASE):
        flags = re.I | re.A if kind == "assign" else 0
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def plain_battery(token):
    """(encoding, n, z, least p-value) of the randomness battery."""
    from usageloom.llm.secrets import ENCODINGS

    encoding, alphabet = next((name, alphabet) for name, (pattern, alphabet) in ENCODINGS.items() if re.search(pattern, token))
    if encoding in ("hex", "base32", "base36"):
        token = token.lower()
    v = np.array([alphabet.index(c) for c in token.replace("-", "+").replace("_", "/")], float)
    n, k = len(v), len(alphabet)
    upper = lambda x: math.erfc(x / math.sqrt(2)) / 2
    counts = np.bincount(v.astype(int), minlength=k)
    chi = ((counts - n / k) ** 2 / (n / k)).sum()
    shape = (k - 1) ** 2 / (2 * (k - 1) * (1 - 1 / n))
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 1 / (9 * shape))) / math.sqrt(1 / (9 * shape))
    high = v >= k / 2
    n1, n0 = int(high.sum()), int((~high).sum())
    p_runs = p_serial = 0.0
    if n1 and n0:
        mean = 1 + 2 * n1 * n0 / n
        variance = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
        runs = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = 2 * upper(abs(runs - mean) / math.sqrt(variance))
    if v.std():
        r = ((v - v.mean()) * (np.roll(v, -1) - v.mean())).mean() / v.var()
        p_serial = 2 * upper(abs(r + 1 / (n - 1)) * math.sqrt(n))
    return encoding, n, z, min(upper(z), p_runs, p_serial)


def random_spans(rows):
    """{id: spans} of the kind random over all rows (id, text) with distinct ids."""
    found = []
    for i, text in rows:
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text)]
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text or ""):
            if not re.fullmatch("[0-9]+", m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
                found.append((i, m.start(), m.end(), not re.search("[0-9]", m[0]), *plain_battery(m[0])))
    text = {}
    for encoding in {f[4] for f in found}:
        words = [f for f in found if f[4] == encoding and f[3]]
        if len(words) >= 50:
            skew = sum(f[6] for f in words) / sum(f[5] for f in words)
            text[encoding] = skew, math.sqrt(sum((f[6] - skew * f[5]) ** 2 / f[5] for f in words) / len(words))

    def p_text(f):
        if f[7] < 0.01 / 3:
            return 1.0
        skew, spread = text.get(f[4], (None, None))
        p = 0.0 if skew is None else math.erfc(-(f[6] - skew * f[5]) / (spread * math.sqrt(f[5])) / math.sqrt(2)) / 2
        # Rounded up to a bin's upper bound.
        return 10 ** (-min(math.floor(-20 * math.log10(max(p, 1e-300))), 600) / 20)

    strata = {}
    for f in found:
        strata.setdefault((f[4], sum(f[5] >= x for x in (20, 24, 32, 48, 96, 192))), []).append((p_text(f), f))
    out = {i: [] for i, _ in rows}
    for tests in strata.values():
        order = sorted(p for p, _ in tests)
        good = [p for rank, p in enumerate(order, 1) if p < 1 and p <= 0.05 * rank / len(order)]
        for p, f in tests:
            if good and p <= max(good):
                out[f[0]].append((f[1], f[2]))
    return {i: [f"random:{a}:{b}" for a, b in sorted(x)] for i, x in out.items()}


def gram_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def classes(n, links):
    label = list(range(n))
    for i, j in links:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near_classes(rows):
    """{id: (class_id, n_links)} of rows (id, text) with distinct ids."""
    rows = sorted(rows)
    sets = [gram_set(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = classes(len(rows), links)
    n = np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return {rows[i][0]: (rows[label[i]][0], int(n[i])) for i in range(len(rows))}


def near_vectors(rows, threshold=0.9):
    """{id: (n_links, component)} of rows (id, vector or None) with distinct ids."""
    rows = sorted(rows, key=lambda r: r[0])
    units = []
    for _, v in rows:
        a = np.array([np.nan if x is None else x for x in v] if v is not None else [], float)
        units.append(a / np.sqrt((a * a).sum()) if len(a) and np.isfinite(a).all() and np.abs(a).max() > 0 else None)
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    label, n = classes(len(rows), links), np.zeros(len(rows), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return {rows[i][0]: (int(n[i]), rows[label[i]][0]) for i in range(len(rows))}


def dedup_lines(rows, min_chars=40, min_docs=5):
    """{id: (n_lines, n_dropped, text)} of rows (id, text) with distinct ids."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def normal(text):
    import regex

    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (text or "").lower()).strip()


def best_distance(item, text):
    """The least edit distance of item to any substring of text."""
    if not text:
        return len(item)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(t) + 1, np.int64)
    steps = np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the text
    return int(row.min())


def plain_toxicity(rows, toxic):
    """{id: 0 or 1} of rows (id, text), learnt from {id: label}: the n-grams themselves, unhashed, and accelerated gradient descent."""

    def grams(text):
        padded = " " + " ".join((text or "").lower().split()) + " "
        return {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)} if padded.strip() else set()

    sets = {i: grams(t) for i, t in rows}
    counts, n = [{}, {}], [0, 0]
    for i, y in toxic.items():
        n[y] += 1
        for g in sets[i]:
            counts[y][g] = counts[y].get(g, 0) + 1
    number, scale = {}, []
    total = [sum(c.values()) + len(counts[0].keys() | counts[1].keys()) for c in counts]
    for g in counts[0].keys() | counts[1].keys():
        q, p = (counts[y].get(g, 0) for y in (0, 1))
        mean = (p + q) / sum(n)
        z = (p / n[1] - q / n[0]) / max(math.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1])), 1e-12)
        number[g] = len(scale)
        # A ratio that four standard errors speak for is half believed.
        scale.append((math.log((p + 1) / total[1]) - math.log((q + 1) / total[0])) * z * z / (z * z + 16))
    scale = np.array(scale)
    sparse = {i: np.array([number[g] for g in s if g in number], int) for i, s in sets.items()}
    ids, y = list(toxic), np.array(list(toxic.values()))
    row, column = np.repeat(np.arange(len(ids)), [len(sparse[i]) for i in ids]), np.concatenate([sparse[i] for i in ids])
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    step = 2.0 / np.bincount(row, weights=scale[column] ** 2).max()
    w, b, at, before = np.zeros(len(scale)), 0.0, (np.zeros(len(scale)), 0.0), 1.0
    for _ in range(400):
        z = np.bincount(row, weights=(scale * at[0])[column], minlength=len(ids)) + at[1]
        r = (1 / (1 + np.exp(-z)) - y) * weight
        new = at[0] - step * (scale * np.bincount(column, weights=r[row], minlength=len(scale)) + 1e-3 * at[0]), at[1] - step * r.sum()
        after = (1 + math.sqrt(1 + 4 * before * before)) / 2
        at = tuple(x + (before - 1) / after * (x - old) for x, old in zip(new, (w, b), strict=True))
        (w, b), before = new, after
    return {i: int((scale * w)[x].sum() + b + 0.5 * math.log(n[1] / n[0]) >= 0) for i, x in sparse.items()}


def sha(data):
    return hashlib.sha256(data).hexdigest()
