"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves with a codebook each; the product of the codebooks is a grid of cells. Every vector lies
in its own cell and visits cells in the order of a lower bound on their distance (multi-sequence traversal over the two
sorted lists of half distances). The traversal ends when the bound exceeds the distance that the similarity allows, so the
recall aimed at is 1: no link can be missed. Two vectors visit each other's cells; of the two visits only the one to the
later cell is made. Pairs within a cell are verified by blocked products in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, forest, one_thread, table

SIMILARITY = 0.98
#: Vectors that each codebook is fitted on, vectors in a block of a cell.
SAMPLE, BLOCK = 4096, 512
#: Centroids of each half: as many as give the largest label this many vectors a cell, between these bounds. The grid grows
#: with the vectors, so that the share of it that a vector visits falls; few vectors do not pay for many visits.
IN_CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 256, 2, 64
#: Vectors whose visits make up one batch.
_SLICE = 512
#: What rounding may add to a distance, in the bound only.
SLACK = 1e-6


@dataclass
class Grid:
    """Two codebooks, for the two halves of vectors; apart[h][i, j] are distances between centroids."""

    books: tuple[np.ndarray, np.ndarray]
    apart: tuple[np.ndarray, np.ndarray]

    def half_bounds(self, h: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half vector, and a lower bound on its distance to any point of each cell.

        A point whose nearest centroid is j lies beyond the plane between j and any other centroid i; the distance to
        that plane bounds the distance to the point.
        """
        c, apart = self.books[h], self.apart[h]
        d2 = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)
        near = d2.argmin(1)
        bound = np.zeros_like(d2)
        for i in range(len(c)):
            with np.errstate(divide="ignore", invalid="ignore"):
                to_plane = np.where(apart[i][None, :] > 0, (d2 - d2[:, i : i + 1]) / (2 * apart[i][None, :]), 0)
            np.maximum(bound, to_plane, out=bound)
        return near, np.maximum(bound - SLACK, 0)


def traverse(a: np.ndarray, b: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of a[i]**2 + b[j]**2 as long as that is at most `most`: a heap over two sorted lists."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = (a[oa] ** 2).tolist(), (b[ob] ** 2).tolist()
    heap, seen = [(sa[0] + sb[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield int(oa[i]), int(ob[j])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(sa) and m < len(sb) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (sa[k] + sb[m], k, m))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded number of vectors; the first ones are spread by farthest-point steps."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = [x[0]]
    d = ((x - c[0]) ** 2).sum(1)
    for _ in range(min(k, len(x)) - 1):
        if d.max() <= 1e-12:
            break
        c.append(x[int(d.argmax())])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def fit_grid(points: DataFrame, kind: str, centroids: int | None = None, sample: int = SAMPLE) -> Grid:
    """Codebooks from the `sample` vectors of the smallest id hashes; vectors of other lengths than the first are left out."""
    if centroids is None:
        largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        centroids = min(max(math.ceil(math.sqrt(largest / IN_CELL)), LEAST_CENTROIDS), MOST_CENTROIDS)
    raw = [bytes(r["raw"]) for r in points.select("rep", "raw").orderBy(F.xxhash64("rep"), "rep").limit(sample).toLocalIterator()]
    x = units([r for r in raw if len(r) == len(raw[0])], kind) if raw else np.zeros((0, 2))
    half = x.shape[1] // 2
    books = tuple(k_means(y, centroids) for y in (x[:, :half], x[:, half:]))
    return Grid(books, tuple(np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0)) for c in books))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of rows that can link: no null among them, all components finite, not all zero."""
    e = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.where("vec_id is not null and label is not null and embedding is not null").where(finite & F.exists("embedding", lambda v: v != 0))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of vectors of one length."""
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_bytes(groups: DataFrame, kind: str) -> DataFrame:
    """rep, label, mult, embedding -> with the components as bytes (`raw`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, kind).tobytes() for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary())], ["rep", "label", "mult", "raw"])

    return groups.select("rep", "label", "mult", "embedding").mapInArrow(run, "rep long, label long, mult long, raw binary")


def probes(points: DataFrame, grid: Grid, kind: str, similarity: float) -> DataFrame:
    """rep, label, mult, raw, cell, home: each vector in its own cell (home) and in every later one that may hold a neighbour."""
    sent = points.sparkSession.sparkContext.broadcast(grid)  # 2 * MOST_CENTROIDS half vectors
    most = 2 - 2 * similarity + SLACK

    def visits(raw: list[bytes], g: Grid) -> tuple[list[int], list[int], list[bool]]:
        bytes_wide = sum(b.shape[1] for b in g.books) * np.dtype(kind).itemsize
        at, cells, home = [], [], []
        fits = [i for i, r in enumerate(raw) if len(r) == bytes_wide]
        for i, r in enumerate(raw):
            if len(r) != bytes_wide:  # vectors of another length have a cell for each length
                at.append(i), cells.append(-len(r)), home.append(True)
        if fits:
            m, half = units([raw[i] for i in fits], kind), g.books[0].shape[1]
            (na, ba), (nb, bb) = g.half_bounds(0, m[:, :half]), g.half_bounds(1, m[:, half:])
            for r, i in enumerate(fits):
                own = int(na[r]) * len(g.books[1]) + int(nb[r])
                found = {ca * len(g.books[1]) + cb for ca, cb in traverse(ba[r], bb[r], most)}
                for c in sorted({own, *(c for c in found if c > own)}):
                    at.append(i), cells.append(c), home.append(c == own)
        return at, cells, home

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            for lo in range(0, b.num_rows, _SLICE):
                part = b.slice(lo, _SLICE)
                at, cells, home = visits(part.column(3).to_pylist(), sent.value)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(cells, pa.int64()), pa.array(home, pa.bool_())], ["rep", "label", "mult", "raw", "cell", "home"])

    return points.mapInArrow(run, "rep long, label long, mult long, raw binary, cell long, home boolean")


def verify(placed: DataFrame, kind: str, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n): b null: n links that a has in a pair of blocks; else a link of the spanning forest there.

    A visitor from another cell and the vector of this one get their link both; two vectors at home here meet twice, once as
    visitors each, and only the visitor gets it.

    A cell is dealt into blocks by id hash; every pair of a block of visitors and a block of its own vectors is one small
    group, so that no cell, however full, meets in one task, and pairs never become rows.
    """
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / block).cast("int").alias("own_blocks"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("own_blocks > 0")
    p = placed.join(sizes, ["label", "cell"])
    mixed = F.xxhash64("rep", "cell")
    visits = p.select("label", "cell", F.pmod(mixed, F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("j"), "rep", "mult", "raw", "home", F.lit(False).alias("own"))
    owns = p.where("home").select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(mixed, F.col("own_blocks")).alias("j"), "rep", "mult", "raw", "home", F.lit(True).alias("own"))
    both = visits.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long")).unionByName(owns.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long")))

    def links(t: pa.Table) -> pa.Table:
        one_thread()
        own = t.column("own").to_numpy().astype(bool)
        rep, mult, raw = t.column("rep").to_numpy(), t.column("mult").to_numpy(), t.column("raw").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        if own.any() and not own.all():
            y, x = (units([raw[k] for k in np.flatnonzero(of)], kind) for of in (own, ~own))
            near = (x @ y.T >= similarity) & (rep[~own][:, None] != rep[own][None, :])
            guest = ~t.column("home").to_numpy().astype(bool)[~own]
            for ids, n in ((rep[~own], near @ mult[own]), (rep[own], near[guest].T @ mult[~own][guest])):
                for k in np.flatnonzero(n):
                    out[0].append(int(ids[k])), out[1].append(None), out[2].append(int(n[k]))
            a, b = np.nonzero(near)
            for u, v in forest(rep[~own][a], rep[own][b]):
                out[0].append(u), out[1].append(v), out[2].append(0)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])

    return both.groupBy("label", "cell", "i", "j").applyInArrow(links, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, centroids: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Rows with equal labels link from `similarity` on. Rows with a null id or label and vectors that are null, zero or hold
    null or non-finite components link with nothing and are their own component; vectors of different lengths never link.
    Equal vectors of a label are one point with a multiplicity: copies link with one another and share all else. Rows with
    one id are one node: equal ones count once, the links of different ones with rows of other ids add up, and components
    are joined through all of them. An empty table gives an empty result.
    """
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"))
    able = usable(vectors)
    grouped = able.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    points = checkpointed(grouped.withColumn("rep", F.monotonically_increasing_id()))  # a name of its own for each point
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"  # floats are kept as they are
    raw = checkpointed(as_bytes(points, kind))
    found = checkpointed(verify(probes(raw, fit_grid(raw, kind, centroids, sample), kind, similarity), kind, similarity))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    copies = checkpointed(able.join(points, ["label", "embedding"]).groupBy("vec_id", "rep").agg(F.count("*").alias("same"), *(F.first(c).alias(c) for c in ("label", "least", "mult"))))
    several = copies.groupBy("vec_id").agg(F.count("*").alias("points")).where("points > 1")
    # links among the vectors of one id do not count: those of an id and a label are a cell, verified as all cells are
    mine = checkpointed(copies.join(several.select("vec_id"), "vec_id").join(raw.select("rep", "raw"), "rep").select(F.monotonically_increasing_id().alias("rep"), F.col("rep").alias("point"), "vec_id", "label", "least", F.col("same").alias("mult"), "raw"))
    inner = verify(mine.select("rep", "label", "mult", "raw", F.col("vec_id").alias("cell"), F.lit(True).alias("home")), kind, similarity)
    inner = inner.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("inner")) if not mine.isEmpty() else None
    linked = copies.join(counts, "rep", "left")
    if inner is not None:
        linked = linked.join(mine.join(inner, "rep").select(F.col("point").alias("rep"), "vec_id", "inner"), ["rep", "vec_id"], "left")
    else:
        linked = linked.withColumn("inner", F.lit(None).cast("long"))
    count = F.col("mult") - F.col("same") + F.coalesce("links", F.lit(0)) - F.coalesce("inner", F.lit(0))
    linked = linked.groupBy("vec_id").agg(F.sum(count).cast("long").alias("n_links"), F.min("least").alias("least"))
    ends = points.select(F.col("rep").alias("p"), "least")
    edges = found.where("b is not null").join(ends, F.col("a") == F.col("p")).select(F.col("least").alias("x"), "b").join(ends, F.col("b") == F.col("p")).select(F.col("x").alias("a"), F.col("least").alias("b"))
    merged = components(edges.unionAll(mine.select(F.col("vec_id").alias("a"), F.col("least").alias("b"))))
    linked = linked.join(merged, linked["least"] == merged["node"], "left").select(F.col("vec_id").alias("__id"), "n_links", F.coalesce("component", "least").alias("component_id"))
    out = rows.join(linked, rows["vec_id"] == linked["__id"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
