"""Maximum inner product search with score-aware (anisotropic) four-bit quantisation.

A vector is cut into subspaces of two components, each coded by one of sixteen
centroids. Codes and centroids minimise a loss that weighs the residual parallel
to the vector ``ETA`` times the perpendicular one, since the parallel residual is
what moves large inner products. The centroids are fitted on at most ``SAMPLE``
vectors (``SAMPLE_BYTES``) chosen by id hash; every vector is coded.

A query's table lookups estimate all scores of a share of the candidates. The
best are scored exactly in double precision, and then every other one whose
estimate may still be too low: by its residual along itself, and by ``DEVIATIONS``
times what the residual across adds to an inner product at random. So the number
that is reranked follows the data, without a cap.

Queries are dealt into blocks of about ``QUERIES``, and each block meets every
share of candidates once, in one task, which keeps the best ``k``; the shares'
results are merged. Equal vectors of a share are ranked once, with their smallest
ids. Vectors that are null, zero, of another dimension than most or hold a null or
non-finite component take no part, nor do rows with a null id. Rows that repeat an
id are candidates with each of their vectors, and the id counts with its best one;
as a query it has its smallest vector (component by component). A query never
finds its own id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytemill.llm.common import read

NEAREST = 20
EVERY = 20
SUB = 2
CENTROIDS = 16
SAMPLE, SAMPLE_BYTES = 8192, 1 << 25
ROUNDS = 6
DEVIATIONS = 3.0
#: Queries and candidates that meet in one task, about, and queries with their tables made at once.
QUERIES = 16_384
CANDIDATES = 8192
TABLES = 256
#: (d - 1) T^2 / (1 - T^2) for d = 64 and T = 0.2, the share of the norm from which scores matter.
ETA = 2.6


def _fit(x: np.ndarray) -> np.ndarray:
    """Centroids (subspaces, CENTROIDS, SUB) of the rows of ``x``."""
    n, dim = x.shape
    books = np.zeros((dim // SUB, CENTROIDS, SUB))
    codes = np.zeros((n, dim // SUB), np.int64)
    for s in range(dim // SUB):  # Lloyd's algorithm, from evenly spaced rows in order of the first component
        part = x[:, s * SUB : (s + 1) * SUB]
        book = part[np.argsort(part[:, 0], kind="stable")[np.linspace(0, n - 1, CENTROIDS).astype(int)]].copy()
        for _ in range(ROUNDS):
            codes[:, s] = ((part[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(CENTROIDS):
                if (of := codes[:, s] == c).any():
                    book[c] = part[of].mean(axis=0)
        books[s] = book
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(2):
        codes = _code(x, books)
        parallel = _parallel(x, unit, books, codes)
        for s in range(dim // SUB):
            at = slice(s * SUB, (s + 1) * SUB)
            part, u = x[:, at], unit[:, at]
            rest = parallel - ((part - books[s][codes[:, s]]) * u).sum(axis=1)
            goal = part + (ETA - 1) * u * (rest + (part * u).sum(axis=1))[:, None]
            for c in range(CENTROIDS):
                of = codes[:, s] == c
                if of.any():
                    normal = of.sum() * np.eye(SUB) + (ETA - 1) * u[of].T @ u[of]
                    books[s, c] = np.linalg.solve(normal, goal[of].sum(axis=0))
            parallel = rest + ((part - books[s][codes[:, s]]) * u).sum(axis=1)
    return books


def _parallel(x: np.ndarray, unit: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The residual's component along each vector."""
    near = books[np.arange(len(books)), codes].reshape(len(x), -1)
    return ((x - near) * unit).sum(axis=1)


def _code(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The centroid of each vector and subspace: nearest first, then by coordinate descent on the anisotropic loss."""
    parts = x.reshape(len(x), len(books), SUB)
    codes = np.stack([((parts[:, s, None] - books[s]) ** 2).sum(axis=2).argmin(axis=1) for s in range(len(books))], axis=1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    units = unit.reshape(parts.shape)
    parallel = _parallel(x, unit, books, codes)
    for s in range(len(books)):
        residual = parts[:, s, None] - books[s]
        along = (residual * units[:, s, None]).sum(axis=2)
        rest = parallel - along[np.arange(len(x)), codes[:, s]]
        loss = (residual**2).sum(axis=2) + (ETA - 1) * (rest[:, None] + along) ** 2
        codes[:, s] = loss.argmin(axis=1)
        parallel = rest + along[np.arange(len(x)), codes[:, s]]
    return codes


class Share:
    """A share of the candidates, whole: equal vectors are one row with their smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors, codes = ids[order], np.ascontiguousarray(vectors[order]), codes[order]
        keys = vectors.view(f"V{vectors.shape[1] * vectors.itemsize}").ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        members = np.argsort(group, kind="stable")  # ids rise inside a group
        self.ids, self.k, self.books = ids[members], k, books
        self.begin = np.searchsorted(group[members], np.arange(len(first)))
        self.size = np.minimum(np.diff(np.append(self.begin, len(members))), k + 1)  # one more, as a query may be among them
        x = vectors[first].astype(float)
        self.columns = np.ascontiguousarray(x.T)
        self.codes = np.ascontiguousarray(codes[first].T).astype(np.intp)
        four = np.stack([codes[first] & 15, codes[first] >> 4], axis=2).reshape(len(first), -1)
        residual = x - books[np.arange(len(books)), four].reshape(x.shape)
        along = np.abs((residual * (x / np.linalg.norm(x, axis=1, keepdims=True))).sum(axis=1))
        across = np.sqrt(np.maximum((residual**2).sum(axis=1) - along**2, 0))
        #: How far a score may lie above its estimate, for a query of norm one.
        self.reach = (along + DEVIATIONS * across / np.sqrt(max(1, x.shape[1] - 1))).astype(np.float32)

    def nearest(self, query_id: int, query: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the best ``k``; table: of 256 entries for two four-bit codes each."""
        score = table[0].take(self.codes[0])
        for s in range(1, len(self.codes)):
            score += table[s].take(self.codes[s])
        n = self.k
        while True:  # until the best hold enough ids, as an id may have several vectors
            n *= 2
            near = np.argpartition(-score, n)[:n] if len(score) > n else np.arange(len(score))
            value, vec = self._best(query_id, query, near)
            if len(value) == self.k or n >= len(score):
                break
        if len(value) == self.k:  # whatever may reach the last of them is compared exactly, too
            near = np.flatnonzero(score + np.float32(np.linalg.norm(query)) * self.reach >= value[-1])
            value, vec = self._best(query_id, query, near)
        return value, vec

    def _best(self, query_id: int, query: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = np.zeros(len(near))
        for q, column in zip(query, self.columns, strict=True):  # component by component, in double precision
            exact += q * column[near]
        n = self.k + 1  # the own id may be among the best
        while True:
            if len(near) > n:
                last = np.partition(exact, len(exact) - n)[len(exact) - n]
                vec, value = self._ranked(query_id, near[exact >= last], exact[exact >= last])
            else:
                vec, value = self._ranked(query_id, near, exact)
            if len(vec) == self.k or len(near) <= n:
                return value, vec
            n *= 2  # ids with several vectors took the places

    def _ranked(self, query_id: int, near: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[near]
        places = np.repeat(self.begin[near], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        vec, value = self.ids[places], np.repeat(exact, size)
        other = vec != query_id
        vec, value = vec[other], value[other]
        top = np.lexsort((vec, -value))
        _, first = np.unique(vec[top], return_index=True)  # an id with several vectors: its best one
        top = top[np.sort(first)][: self.k]
        return vec[top], value[top]

    def all_nearest(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), TABLES):
            q = queries[at : at + TABLES]
            tables = np.einsum("qsd,scd->qsc", q.reshape(len(q), len(self.books), SUB), self.books).astype(np.float32)
            tables = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(q), -1, CENTROIDS**2)
            found = [self.nearest(*x) for x in zip(ids[at : at + TABLES].tolist(), q, tables, strict=True)]
            columns = [np.repeat(ids[at : at + TABLES], [len(v) for v, _ in found]), np.concatenate([i for _, i in found]), np.concatenate([v for v, _ in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def search(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score double"
    sizes = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count()
    common = sizes.where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        empty = spark.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim = common["dim"]
    wide = dim + -dim % (2 * SUB)  # zeros at the end change no inner product
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    )
    counts = valid.agg(F.count("*").alias("all"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).first()
    steps, size = 1 << 20, min(SAMPLE, max(256, SAMPLE_BYTES // (8 * dim)))
    chosen = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < min(steps, size * steps // max(1, counts["all"])))
    sample = np.array(sorted(r["embedding"] for r in chosen.select("embedding").limit(2 * size).collect()), float).reshape(-1, dim)
    books = _fit(np.pad(sample, ((0, 0), (0, wide - dim)))) if len(sample) else np.zeros((wide // SUB, CENTROIDS, SUB))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.pad(_vectors(b.column(1), dim).astype(float), ((0, 0), (0, wide - dim)))
                codes = _code(x, books).astype(np.uint8)
                packed = codes[:, 0::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "embedding", "codes"])

    kind = valid.schema["embedding"].dataType.simpleString()
    blocks = max(1, ceil(counts["queries"] / QUERIES))
    shares = max(1, ceil(counts["all"] / CANDIDATES))
    candidates = valid.dropDuplicates(["vec_id", "embedding"]).mapInArrow(index, f"vec_id long, embedding {kind}, codes binary").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shares)).cast("int").alias("share"), "vec_id", "embedding", "codes"
    )
    queries = valid.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        "vec_id",
        "embedding",
        F.lit(None).cast("binary").alias("codes"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block and share; one share and its queries are held at a time."""
        now: tuple[int, int] | None = None
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, x, codes, asked = (np.concatenate(c) for c in zip(*held, strict=True))
            if asked.any() and not asked.all():
                wide_x = np.pad(x, ((0, 0), (0, wide - dim)))
                yield from Share(ids[~asked], wide_x[~asked], codes[~asked], books, k).all_nearest(ids[asked], wide_x[asked].astype(float))

        for b in batches:
            key = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if to == at:
                    continue
                if now != (here := (int(key[0, at]), int(key[1, at]))):
                    if held:
                        yield from out()
                    now, held = here, []
                part = b.slice(at, to - at)
                asked = np.asarray(part.column(4).is_null())
                codes = np.frombuffer(b"".join(part.column(4).fill_null(bytes(wide // SUB // 2)).to_pylist()), np.uint8).reshape(to - at, -1)
                held.append((np.asarray(part.column(2)), _vectors(part.column(3), dim), codes, asked))
        if held:
            yield from out()

    met = queries.union(candidates).repartition("block", "share").sortWithinPartitions("block", "share")
    found = met.mapInArrow(scan, result).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
