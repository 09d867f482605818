"""Plain versions of the operators, written from their contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(rows):
    """rows of (id, fingerprint) to the least id reachable over links of two bits."""
    prints, parent = sorted({f for _, f in rows}), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(prints):
        find(a)
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = d if r not in least else min(least[r], d)
    return [least.get(find(f)) for _, f in rows]


def lines(rows, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    n = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    return [(d, len(ls), sum(n[key(x)] >= least for x in ls), sha("\n".join(x for x in ls if n[key(x)] < least))) for d, ls in split]


def passages(rows, length=50):
    split = [(d, words(t)) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - length + 1) if d is not None else ():
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - length + 1) if d is not None else ():
            if first[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def measures(text):
    w, t = words(text), text or ""
    found = defaultdict(list)
    for i in range(len(w) - 7):
        found[tuple(w[i : i + 8])].append(i)
    again = {i + j for at in found.values() if len(at) > 1 for i in at for j in range(8)}
    ls = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(again)


def spans(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[j - 1] + 1))
        row = now
    return min(row)


def mixture(rows):
    """rows of (id, text, source) to {source: (size, target)}, by resharing until no target is above its cap."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(size.values())
    capped = set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        shares = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / shares for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not above:
            return {s: (size[s], target[s]) for s in order}
        capped |= above


def cut_in_the_middle(doc_id, text):
    """(n, form, prefix, middle, output) of operator 11."""
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, t
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def clusters(rows, k=8, rounds=10, scale=1024, seed=3):
    """(id, cluster, distance, inertia of the cluster, inertia, centroid) of operator 12, for rows of (id, kept vector)."""
    made = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in made)
    centers = [v for _, v in first[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda j: (apart(v, centers[j]), j))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in made:
            own[nearest(v)].append(v)
        centers = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if own[j] else c for j, c in enumerate(centers)]
    told = [(i, j := nearest(v), apart(v, centers[j])) for i, v in made]
    each = Counter()
    for _, j, d in told:
        each[j] += d
    return [(i, j, d, each[j], sum(each.values()), centers[j]) for i, j, d in told]


def similar_components(rows, shingle=2, percent=80):
    """(id, size, component, kept) of operator 13, over every pair that has a shingle in common."""
    made = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        made.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    parent, holders = list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(made):
        for j, n in Counter(j for x in a for j in holders[x]).items():
            if 100 * n >= percent * (len(a) + len(made[j]) - n):
                parent[find(i)] = find(j)
        for x in a:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(made[i]), c := least.get(find(i)), d is not None and d == c) for i, (d, _) in enumerate(rows)]
