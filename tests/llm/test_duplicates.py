"""Operators 1, 6 and 8: near duplicates, repeated lines, repeated passages."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from cases import hostile, real, table
from pyspark.sql import functions as F

from sagaframe.llm import linededup, simhash, substring
from sagaframe.llm.graph import connected_components


def told(rows, prints=None):
    prints = prints or [(d, brute.fingerprint(t)) for d, t, *_ in rows]
    return Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute.components(prints)))


@pytest.mark.parametrize("cap", [100, 1])
def test_near_duplicates(spark, cap):
    df, rows = table(spark, 1)
    got = simhash.near_duplicates(df, bucket_cap=cap)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == told(rows)


def test_near_duplicates_of_the_table(spark):
    df, rows = real(spark)
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == told(rows)


@pytest.mark.parametrize("cap", [1000, 3])
def test_links_lose_none_in_hot_buckets(spark, cap):
    r = random.Random(cap)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << i for i in r.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3) for _ in range(30)}
    values |= {(base[0] & ~0xFFFFFFFF) | r.getrandbits(32) for _ in range(200)}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for _, v in rows], "fp long")
    roots = {x["node"] % (1 << 64): x["root"] % (1 << 64) for x in connected_components(simhash.links(fps, cap)).collect()}
    groups, want = {}, {}
    for (i, v), c in zip(rows, brute.components(rows)):
        groups.setdefault(roots.get(v, v), set()).add(v)
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_no_fingerprints(spark):
    assert simhash.near_duplicates(hostile(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect() if r["node"] != r["root"]}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, -1])
def test_lines(spark, limit):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(("Common line", " common LINE\t", "rare %d" % r.randrange(40), "", "  ", "é", "É", "menu | home")) for _ in range(r.randrange(0, 9)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Common line"), (103, "Common line"), (None, "common line\nown"), (None, None)]
    df = hostile(spark, [(d, t, None, None) for d, t in rows])
    got = linededup.dedup_lines(df, broadcast_bytes=limit).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept"))
    assert Counter(map(tuple, got.collect())) == Counter(brute.lines(rows))
    assert linededup.dedup_lines(hostile(spark, []), broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [linededup.BROADCAST_BYTES, -1])
def test_lines_of_the_table(spark, limit):
    df, rows = real(spark)
    got = linededup.dedup_lines(df, broadcast_bytes=limit).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept"))
    assert Counter(map(tuple, got.collect())) == Counter(brute.lines(rows))


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    slots = linededup.PerfectHash(keys).slots(keys)
    assert sorted(slots) == list(range(len(keys)))
    index = linededup.LineIndex(np.concatenate([keys, keys[:2]]), np.arange(len(keys) + 2, dtype=np.uint64), np.arange(len(keys) + 2) + 10)
    assert (index.count(keys, np.arange(len(keys), dtype=np.uint64)) == np.arange(len(keys)) + 10).all()
    assert list(index.count(keys[:2], np.array([len(keys), len(keys) + 1], np.uint64))) == [len(keys) + 10, len(keys) + 11]
    assert (index.count(keys, np.full(len(keys), 2**40, np.uint64)) == 0).all()


def passages(df, **kw):
    return Counter(map(tuple, substring.remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()))


@pytest.mark.parametrize("kw", [{}, {"broadcast_anchors": -1}, {"passage_cap": 1}, {"row_cap": 3}])
def test_passages(spark, kw):
    df, rows = table(spark, 3, 40)
    assert passages(df, **kw) == Counter(brute.passages([(d, t) for d, t, *_ in rows]))


@pytest.mark.parametrize("kw", [{}, {"passage_cap": 2}])
def test_driver_holds_few_bits(spark, monkeypatch, kw):
    """However many anchors there are, what goes out from the driver has a fixed size; a filter that lets nearly all through changes no result."""
    r, sent, broadcast = random.Random(9), [], type(spark.sparkContext).broadcast
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(4000)) for _ in range(30)]
    rows = [(3 * i + k, " ".join(t.split()[200 * k :]) + f" end{k}") for i, t in enumerate(texts) for k in range(3)] + [(-1, texts[4]), (None, texts[5])]
    monkeypatch.setattr(substring, "FILTER_BITS", 1 << 16, raising=False)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x[0] if isinstance(x, tuple) else x) or broadcast(self, x))
    want = brute.passages(rows)
    assert passages(hostile(spark, [(d, t, None, None) for d, t in rows]), **kw) == Counter(want) and sum(n for *_, n, _ in want) > 200_000
    assert sent and max(x.nbytes for x in sent) <= 1 << 13


def test_anchor_filter(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63, 300_000)
    bits = substring.anchor_filter(spark.createDataFrame([(x,) for x in h[:100_000].tolist()], "h long").repartition(5), 100_000)
    assert substring._let_through(bits, h[:100_000]).all() and substring._let_through(bits, h[100_000:]).mean() < 0.01
    assert not substring._let_through(substring.anchor_filter(spark.createDataFrame([], "h long"), 0), h).any()


@pytest.mark.parametrize("length", [3, 13])
def test_short_passages(spark, length):
    df, rows = table(spark, 4, 25)
    assert passages(df, length=length) == Counter(brute.passages([(d, t) for d, t, *_ in rows], length))


def test_passages_of_the_table(spark):
    df, rows = real(spark)
    assert passages(df) == Counter(brute.passages(rows))
    assert passages(hostile(spark, [])) == Counter()


def test_automaton():
    automaton = substring.SuffixAutomaton()
    automaton.add(b"c a b d e".split(), 3)
    assert automaton.meet(b"a b c a b d".split(), 3, 5) == [5, 5, 3, 3]
    assert automaton.firsts(b"b c a b d e x a".split(), 3) == [5, 3, 3, 3, None, None]


@pytest.mark.parametrize("seed", range(5))
def test_automaton_of_many(seed):
    """Growing automata against every window of every earlier sequence."""
    r, automaton, seen = random.Random(seed), substring.SuffixAutomaton(), {}
    for doc in range(40):
        words = [r.randrange(3) for _ in range(r.randrange(0, 30))]
        windows = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
        for w in windows:
            seen.setdefault(w, doc)
        assert automaton.meet(words, 4, doc) == [seen[w] for w in windows]


def test_ids_of_passages(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect()) == [(1, 0), (2, 60)]
    assert substring.remove_repeats(df).schema["doc_id"].dataType.simpleString() == "int"
    with pytest.raises(TypeError):
        substring.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))
