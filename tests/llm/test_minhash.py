"""Operator 13: MinHash near-dedup against every pair."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from cases import hostile, real, table
from test_nearcopies import copies
from pyspark.sql import functions as F

from sagaframe.llm import minhash, queries


def compare(rows, got):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter(brute.similar_components(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_texts(spark, seed):
    df, rows = table(spark, seed)
    got = minhash.near_duplicates(df).collect()
    blank = [r for r in got if r["n_shingles"] == 0]
    assert all(r["component_id"] == r["doc_id"] for r in blank)
    worded = [(d, t) for d, t, *_ in rows if brute.words(t)]
    compare(worded, [r for r in got if r["n_shingles"]])
    assert minhash.near_duplicates(hostile(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_copies_with_replaced_words(spark, seed):
    rows = copies(seed)
    compare(rows, minhash.near_duplicates(hostile(spark, [(d, t, None, None) for d, t in rows])).collect())


def test_group_around_one_text(spark):
    """Copies of one text, most of them near it, few near one another, and copies of copies."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(500):
        w = list(base) if d % 9 or not rows else r.choice(rows)[1].split()
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    r.shuffle(rows)
    compare(rows, minhash.near_duplicates(hostile(spark, [(d, t, None, None) for d, t in rows])).collect())


def test_sets_and_nodes_by_join(spark, monkeypatch):
    rows = copies(6)
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 0)
    compare(rows, minhash.near_duplicates(hostile(spark, [(d, t, None, None) for d, t in rows])).collect())


def test_other_thresholds(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "z"), (4, "Z "), (5, "z y"), (6, None)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(hostile(spark, [(d, t, None, None) for d, t in rows]), shingle=1, percent=77).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_signatures_estimate_the_index():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 1200, np.uint64)
    a, b = hashes[:1000], hashes[200:]
    same = np.mean([(minhash.signature(x) == minhash.signature(y)).mean() for x, y in (((a * np.uint64(f)), (b * np.uint64(f))) for f in range(1, 200, 2))])
    assert abs(same - 800 / 1200) < 0.03
    bits = np.mean([np.bitwise_count((minhash.sketch(a * np.uint64(f)) ^ minhash.sketch(b * np.uint64(f))).view(np.uint64)).sum() for f in range(1, 60, 2)])
    assert abs(bits / minhash.BITS - 200 / 1200) < 0.02
    values = minhash.signature(hashes)
    assert (values.view(np.uint64) % minhash.COORDINATES == np.arange(minhash.COORDINATES)).all()


def test_table(spark):
    _, rows = real(spark, "/root/testdata/sf0.01")
    compare(rows, queries.op13_minhash(spark, "/root/testdata/sf0.01").collect())
