"""Centroid clustering in whole numbers, with ball trees that assign many vectors at once.

Each task packs the vectors it reads into blocks and builds a metric tree over each block: a ball has the mean of
its vectors, a radius around it, their number and their exact sum. A round sends the few centroids to the trees.
Going down a tree, the triangle inequality rules out centroids that can be nearest to no vector of a ball; where
one is left, the whole ball is its, by number and sum alone, and where several are left at a leaf, the leaf's
vectors are compared exactly. Ties go to the smaller number: floating point only ever rules out what is further
away by more than its error, and a tie is never ruled out, so every tie is settled exactly.

What leaves a task is one row for each centroid, however many vectors it read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut

#: Vectors of a tree and of a leaf.
BLOCK, LEAF = 4096, 24
#: Components are at most this large, so that squared distances of up to 256 components fit a long.
LIMIT = 1 << 26
_PARTS = (("starts", np.int32), ("stops", np.int32), ("lefts", np.int32), ("radii", np.float64), ("sums", np.int64))


def whole(vector: Column, scale: int, dims: int) -> Column:
    """floor(scale * x) of each component; null unless there are ``dims``, none null or not finite. Beyond LIMIT it fails."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.when(F.size(vector) == dims, vector)
    far = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}, so that distances needn't fit a long"))
    scaled = lambda x: x.cast("double") * scale
    return F.when(F.coalesce(F.forall(size, lambda x: x.isNotNull()), F.lit(False)) & fine, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) <= LIMIT, F.floor(scaled(x))).otherwise(far.cast("long"))))


def grow(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, nodes) of a ball tree over rows of whole numbers; the children of a node stand side by side, -1 marks a leaf."""
    x, order = vectors.astype(np.float64), np.arange(len(vectors))
    nodes: list[list] = [[0, len(vectors), -1, 0.0, None]]
    for node in nodes:
        start, stop = node[:2]
        rows = order[start:stop]
        node[4] = vectors[rows].sum(0, dtype=np.int64)
        away = np.sqrt(np.square(x[rows] - node[4] / (stop - start)).sum(1))
        node[3] = float(away.max())
        if stop - start > LEAF and (vectors[rows] != vectors[rows[0]]).any():
            one = x[rows[away.argmax()]]
            two = x[rows[np.square(x[rows] - one).sum(1).argmax()]]
            along = x[rows] @ (two - one)
            middle = (stop - start) // 2
            order[start:stop] = rows[np.argpartition(along, middle, kind="introselect")]
            node[2] = len(nodes)
            nodes += [[start, start + middle, -1, 0.0, None], [start + middle, stop, -1, 0.0, None]]
    return order, {name: np.array([n[i] for n in nodes], kind) for i, (name, kind) in enumerate(_PARTS)}


def trees(vectors: DataFrame) -> DataFrame:
    """(ids, vectors, starts, stops, lefts, radii, sums): a row for each tree of at most BLOCK vectors (id, vector) of one task."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            dense = np.asarray(block["vector"].combine_chunks().flatten()).astype(np.int32).reshape(len(block), -1)
            order, nodes = grow(dense)
            ids = block["id"].combine_chunks().take(pa.array(order))
            parts = [pa.array([nodes[n].tobytes()], pa.binary()) for n, _ in _PARTS]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([dense[order].tobytes()], pa.binary()), *parts], ["ids", "vectors", *(n for n, _ in _PARTS)])

        n = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, BLOCK - n)
                held.append(part)
                at, n = at + len(part), n + len(part)
                if n == BLOCK:
                    yield made()
                    held.clear()
                    n = 0
        if n:
            yield made()

    return vectors.mapInArrow(run, f"ids array<{kind}>, vectors binary, " + ", ".join(f"{n} binary" for n, _ in _PARTS))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids): in floating point where every number in between is below 2^53, else in longs."""
    big = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * vectors.shape[1] * big * big < 1 << 53 else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return (np.square(x).sum(1)[:, None] - 2 * (x @ c.T) + np.square(c).sum(1)).astype(np.int64)


def descend(vectors: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((node, centroid) of the balls that have one nearest centroid, rows left, their nearest centroids)."""
    means = nodes["sums"] / (nodes["stops"] - nodes["starts"])[:, None]
    balls: list[tuple[int, int]] = []
    rows, masks = [np.zeros(0, np.int64)], [np.zeros((0, len(centroids)), bool)]
    at, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(at):
        apart = np.where(open_, np.sqrt(np.square(means[at][:, None, :] - centroids).sum(2)), np.inf)
        least, radius = apart.min(1), nodes["radii"][at]
        open_ &= apart - radius[:, None] <= (least + radius + 1e-9 * (1 + least + radius))[:, None]
        settled = open_.sum(1) == 1
        balls += zip(at[settled].tolist(), open_[settled].argmax(1).tolist())
        at, open_ = at[~settled], open_[~settled]
        lefts = nodes["lefts"][at].astype(np.int64)
        for node, mask in zip(at[lefts < 0], open_[lefts < 0]):
            own = np.arange(nodes["starts"][node], nodes["stops"][node])
            rows.append(own)
            masks.append(np.broadcast_to(mask, (len(own), len(mask))))
        inner, open_ = lefts[lefts >= 0], open_[lefts >= 0]
        at, open_ = np.concatenate([inner, inner + 1]), np.concatenate([open_, open_])
    left = np.concatenate(rows)
    far = np.where(np.concatenate(masks), squared(vectors[left], centroids), np.iinfo(np.int64).max)
    return balls, left, far.argmin(1)  # the first of equal ones


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.ListScalar, np.ndarray, dict[str, np.ndarray]]]:
    for i in range(len(batch)):
        part = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
        nodes = {n: part(n, kind) for n, kind in _PARTS}
        yield batch.column("ids")[i], part("vectors", np.int32).reshape(-1, dims), nodes | {"sums": nodes["sums"].reshape(-1, dims)}


def _moved(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of each one's vectors, or itself where it has none."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, vectors, nodes in _read(batch, dims):
                balls, rows, nearest = descend(vectors, nodes, centroids)
                for node, c in balls:
                    counts[c] += nodes["stops"][node] - nodes["starts"][node]
                    sums[c] += nodes["sums"][node]
                for c in range(k):
                    own = vectors[rows[nearest == c]]
                    counts[c] += len(own)
                    sums[c] += own.sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = grown.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(dims))).alias("sums"))
    out = centroids.copy()
    for r in total.where("n > 0").collect():  # as many rows as centroids
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def _assigned(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    dims = centroids.shape[1]
    kind = grown.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, nodes in _read(batch, dims):
                balls, rows, nearest = descend(vectors, nodes, centroids)
                cluster = np.zeros(len(vectors), np.int32)
                cluster[rows] = nearest
                for node, c in balls:
                    cluster[nodes["starts"][node] : nodes["stops"][node]] = c
                distance = np.square(vectors - centroids[cluster]).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return grown.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) for each kept vector; ``centroid`` is its whole numbers.

    Vectors with another number of components, or with one that is null or not finite, are left out. The first
    centroids are the ``k`` kept vectors with the smallest SHA-256 of ``seed:id`` (a null id counts as empty, rows
    of one id go by their components), fewer where there are fewer; centroids may be equal, the later ones are
    then empty and stay. Repeated rows are rows of their own. A component whose multiple by ``scale`` is beyond
    LIMIT is an error, not a wrong distance. An empty table gives no rows. Other columns aren't read.
    """
    kept = table.select(F.col(id_col).alias("id"), whole(F.col(vector_col), scale, dims).alias("vector")).where("vector IS NOT NULL")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r["vector"] for r in kept.select(digest.alias("digest"), "id", "vector").orderBy("digest", "id", "vector").limit(k).collect()]
    grown = cut(trees(kept))
    centroids = np.array(first, np.int64).reshape(-1, dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(grown, centroids)
    told = cut(_assigned(grown, centroids))
    each = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum"))
    sums = {r["cluster"]: int(r["_sum"]) for r in each.collect()}  # as many rows as centroids
    rows = [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sorted(sums.items())]
    ends = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return told.join(F.broadcast(ends), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL: a pair of statements for each round."""
    told = """a{i} AS MATERIALIZED (SELECT r, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (
  SELECT v.r, c.j, v.s + c.s - 2 * CAST(list_dot_product(CAST(v.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS d FROM v, c{i} c) GROUP BY r)"""
    moved = """c{n} AS MATERIALIZED (SELECT j, x, CAST(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) AS BIGINT) AS s FROM (
  SELECT j, coalesce(y, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(m ORDER BY e) AS y FROM (
    SELECT j, e, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT j, e, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS e FROM v JOIN a{i} USING (r)) GROUP BY j, e)) GROUP BY j) USING (j)))"""
    steps = ",\n".join(told.format(i=i) + ",\n" + moved.format(i=i, n=i + 1) for i in range(rounds))
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT *, CAST(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) AS BIGINT) AS s FROM (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x, s FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x, s FROM v ORDER BY h LIMIT {k})),
{steps},
{told.format(i=rounds)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""
