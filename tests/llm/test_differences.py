"""Pairs around a lead, by their differences from it: none is left out, and few are met."""

import random

import pytest

from sagaframe.llm import differences, minhash, nearcopies


def group(seed, n, most):
    """Sets made from one by up to ``most`` changes, some of them from one another."""
    r = random.Random(seed)
    made = {0: frozenset(range(150))}
    for i in range(1, n):
        s = set(made[0] if r.random() < 0.7 else made[r.randrange(i)])
        for _ in range(r.randrange(most)):
            how = r.random()
            if how < 0.8:
                s.discard(r.choice(sorted(s)))
            if how > 0.2:
                s.add(r.randrange(1000, 10**6) if r.random() < 0.7 else r.randrange(1000, 1040))
        made[i] = frozenset(s)
    return made


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 80), (3, 60)])
def test_similar_pairs_around_a_lead(spark, seed, percent):
    made = group(seed, 400, 30 if percent == 80 else 60)
    alike = lambda i, j: 100 * len(made[i] & made[j]) >= percent * len(made[i] | made[j])
    want = {(i, j) for j in made for i in range(j) if alike(i, j) and not (alike(0, i) and alike(0, j))}
    groups = spark.createDataFrame([(0, i, i) for i in made], "lead long, node long, root long")
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in made.items()], "node long, shingles array<long>")
    got = {tuple(r) for r in differences.similar(groups, sets, percent).collect()}
    assert want and want <= got
    assert len(got) < 8_000  # of 79,800
    one = spark.createDataFrame([(0, i, 7) for i in made], "lead long, node long, root long")
    assert differences.similar(one, sets, percent).isEmpty()


def counted(monkeypatch, module, name):
    """How many pairs a module's function gets, from its first call on."""
    n, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda pairs, *rest: n.append(pairs.count()) or f(pairs, *rest))
    return n


def texts(shingle):
    """Copies of one text, a third of them with a bit less than an index of 0.8 to it."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(900):
        w = list(base)
        for _ in range(r.randrange(1, 3) if d % 3 else r.randrange(18 // shingle, 28 // shingle)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("module, name, shingle", [(minhash, "confirmed", 2), (nearcopies, "_verified", 5)])
def test_copies_beside_a_group_are_not_compared_with_all_of_it(spark, monkeypatch, module, name, shingle):
    n = counted(monkeypatch, module, name)
    df = spark.createDataFrame(texts(shingle), "doc_id long, text string")
    found = module.near_duplicates(df) if module is minhash else module.near_copies(df)
    assert found.select("component_id").distinct().count() > 100
    print(name, n)
    assert sum(n) < 15_000  # 180,000 pairs of a copy beside the group with one in it
