"""Operators 11 and 12: fill-in-the-middle and centroid clustering."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from cases import hostile, real, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagaframe.llm import centroids, fim, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "𝄞", " ", "\n", " ", "word", "\t\r"]), max_size=40).map("".join))
def test_boundary_lists(text):
    ends = fim.boundaries(text.encode())
    want = np.cumsum([len(x) for x in brute.re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)], dtype=int).tolist()
    assert ends.tolist() == want
    kept = fim.elias_fano(ends)
    assert [fim.select(*kept, i) for i in range(len(want) + 1)] == [0, *want]


def test_long_list():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 400, 50_000))
    kept = fim.elias_fano(ends)
    assert all(fim.select(*kept, i) == ends[i - 1] for i in (1, 2, 777, 25_000, 49_999, 50_000))
    assert len(kept[2]) + len(kept[3]) < 50_000 * 10 / 8 + 100  # bits: 7 low ones and under 3 others for each


@pytest.mark.parametrize("bound", [fim.BROADCAST_HASHES, 0])
def test_fill_in_the_middle(spark, monkeypatch, bound):
    monkeypatch.setattr(fim, "BROADCAST_HASHES", bound)
    df, rows = table(spark, 4)
    marked = [(900 + i, f"some text with {m} in it {i}") for i, m in enumerate(("<P>", "<S>", "<M>", "<", "P>", "<S") * 6)]
    rows = [(d, t) for d, t, *_ in rows] + marked
    got = fim.transform(df.select("doc_id", "text", "key", "src").union(spark.createDataFrame([(*m, 0, 0) for m in marked], "doc_id long, text string, key int, src int")))
    out = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out) == Counter((d, *brute.cut_in_the_middle(d, t)) for d, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((d, t or "") for d, t in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}
    assert fim.transform(hostile(spark, [])).count() == 0


def test_index_holds_each_text_once(spark):
    df = hostile(spark, [(i, ("same text", "other  text ", None)[i % 3], None, None) for i in range(90)])
    lists = fim.index(df.select(F.coalesce("text", F.lit("")).alias("text"))).collect()
    assert {(r["text"], r["n"], r["chars"]) for r in lists} == {("same text", 2, 9), ("other  text ", 3, 12), ("", 0, 0)} and len(lists) == 3


def vectors(seed, n=300, dims=64):
    """Vectors in a few close groups, with copies, ties, and those that aren't kept."""
    r = random.Random(seed)
    groups = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    out = [(i, [x + r.uniform(-0.05, 0.05) * (i % 4) for x in r.choice(groups)]) for i in range(n)]
    out += [(1000 + i, list(out[7][1])) for i in range(60)] + [out[3], (None, out[4][1]), (None, out[5][1])]
    odd = [(2000, None), (2001, []), (2002, [0.5] * (dims - 1)), (2003, [0.5] * (dims + 1)), (2004, [None] + [0.0] * (dims - 1)), (2005, [float("nan")] + [0.0] * (dims - 1)), (2006, [float("inf")] * dims), (2007, [float("-inf")] + [0.0] * (dims - 1))]
    r.shuffle(out)
    return out, odd


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 64)])
def test_clusters(spark, monkeypatch, seed, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    kept, odd = vectors(seed)
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in kept]
    df = spark.createDataFrame(kept + odd, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("id", "vector", "cluster", "distance", "n", "sums", "label")})
    got = centroids.cluster(df).collect()
    assert Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got) == Counter(brute.clusters(kept))


def test_few_vectors_and_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert centroids.cluster(make([])).count() == 0 and centroids.cluster(make([(1, None), (2, [1.0])])).count() == 0
    few = [(i, [float(i // 2)] * 3) for i in range(4)]
    got = centroids.cluster(make(few), dims=3).collect()
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in got) == Counter((i, j, d) for i, j, d, *_ in brute.clusters(few))
    with pytest.raises(Exception, match="is beyond"):
        centroids.cluster(make([(1, [1e6, 0.0, 0.0])]), dims=3).count()


def test_balls_settle_vectors_without_looking_at_them():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 3, (500, 8)) + far for far in (0, 5000, -9000)]).astype(np.int32)
    order, nodes = centroids.grow(x)
    assert sorted(order.tolist()) == list(range(1500)) and (nodes["sums"][0] == x.sum(0)).all()
    centers = np.array([[0] * 8, [5000] * 8, [-9000] * 8, [20_000] * 8])
    balls, rows, nearest = centroids.descend(x[order], nodes, centers)
    assert len(rows) < 300 and sum(nodes["stops"][n] - nodes["starts"][n] for n, _ in balls) + len(rows) == 1500
    told = np.full(1500, -1)
    told[rows] = nearest
    for n, c in balls:
        told[nodes["starts"][n] : nodes["stops"][n]] = c
    assert (told == centroids.squared(x[order], centers).argmin(1)).all()


def test_distances_are_exact_when_large():
    x = np.array([[1 << 26, -(1 << 26)] * 32, [3] * 64], np.int64)
    assert centroids.squared(x, x)[0, 1] == sum((int(a) - 3) ** 2 for a in x[0])


def test_queries(spark):
    got = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    texts = dict(real(spark)[1])
    assert all(r["restored_sha256"] == brute.sha(texts[r["doc_id"]] or "") and r["output_sha256"] == brute.sha(brute.cut_in_the_middle(r["doc_id"], texts[r["doc_id"]])[4]) for r in got) and len(got) == len(texts)
