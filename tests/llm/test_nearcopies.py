"""The pipeline's near duplicates against every pair of documents."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from cases import hostile, real, table

import corpus_pipeline
from sagaframe.llm import nearcopies


def shingled(text):
    w = brute.words((text or "").translate(brute.LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(rows):
    """The pairs of rows (id, text) with a five-word Jaccard index of 0.8 or more, as places."""
    made = [shingled(t) for _, t in rows]
    return [(i, j) for i, a in enumerate(made) for j, b in enumerate(made[:i]) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)]


def components(rows):
    """rows of (id, text) to the least id reachable over similar pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in similar(rows):
        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def copies(seed):
    """Originals of 60 to 250 words with copies that have 0 to 9 words replaced, some of them copies of copies."""
    r = random.Random(seed)
    out = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 250))) for _ in range(15)]
    for _ in range(90):
        w = r.choice(out).split()
        for _ in range(r.randrange(0, 10)):
            w[r.randrange(len(w))] = f"x{r.randrange(3000)}"
        out.append(" ".join(w))
    ids = r.sample(range(1000), len(out))
    return [(d, t) for d, t in zip(ids, out)]


def check(rows, got):
    """No pair that isn't reachable by brute force is together, and 99 % of the similar pairs are."""
    want, pairs = components(rows), similar(rows)
    assert all(len({want[i] for i, g in enumerate(got) if g == c}) == 1 for c in set(got))
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_finds_copies_with_replaced_words(spark, seed):
    rows = copies(seed)
    df = hostile(spark, [(d, t, None, None) for d, t in rows])
    assert len(set(components(rows))) < len(rows) - 20
    got = dict(map(tuple, nearcopies.near_copies(df).collect()))
    check(rows, [got[d] for d, _ in rows])
    kept = corpus_pipeline.deduplicated(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, c in got.items() if d == c)


def test_near_copies_of_odd_texts(spark):
    df, rows = table(spark, 2)
    rows = [(d, t) for d, t, *_ in rows]
    want = components(rows)
    assert Counter(map(tuple, nearcopies.near_copies(df).collect())) == Counter((d, c) for (d, _), c in zip(rows, want))
    kept = nearcopies.representatives(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(set(want))
    assert nearcopies.representatives(hostile(spark, [])).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated rows, repeated ids and rows without an id."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (2, a), (1, a + " more"), (None, a), (None, b), (None, b), (7, None), (8, ""), (None, " ")]
    kept = nearcopies.representatives(hostile(spark, [(d, t, None, None) for d, t in rows])).select("doc_id", "text").collect()
    assert Counter((r["doc_id"], (r["text"] or "")[:1]) for r in kept) == Counter([(1, "a"), (None, "b"), (7, "")])


def test_near_copies_of_the_table(spark):
    df, rows = real(spark, "/root/testdata/sf0.01")
    got = dict(map(tuple, nearcopies.near_copies(df).collect()))
    check(rows, [got[d] for d, _ in rows])


def test_large_group(spark):
    """A group of many different near copies with outsiders, whose buckets have several leads and components."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(400):
        w = list(base)
        for _ in range(r.randrange(0, 16)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = dict(map(tuple, nearcopies.near_copies(hostile(spark, [(d, t, None, None) for d, t in rows])).collect()))
    check(rows, [got[d] for d, _ in rows])


def test_balls():
    """The probes of a segment are different values, the value itself among them, and flip the least certain bits first."""
    made = np.random.default_rng(1).integers(-40, 40, (9, nearcopies.SEGMENTS * nearcopies.WIDTH + 64))
    probes, exact = nearcopies.balls(made)
    assert exact.sum() == 9 * nearcopies.SEGMENTS
    for row, values, at in zip(made, probes, exact):
        for i, (v, x) in enumerate(zip(values, at)):
            votes = row[i * nearcopies.WIDTH : (i + 1) * nearcopies.WIDTH]
            own = sum(1 << b for b, n in enumerate(votes) if n > 0)
            assert len(set(v)) == nearcopies.PROBES and v[x].tolist() == [own]
            assert own ^ (1 << int(np.abs(votes).argmin())) in v
