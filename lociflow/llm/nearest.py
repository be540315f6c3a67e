"""Nearest neighbours by inner product: low-dimensional stable projections in kd-trees, verified until a chi-square test stops the search."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.sources.shared import written

#: Dimensions of the projections, and how surely a neighbour as near as the k-th has been seen when a search stops.
DIMENSIONS, SURE = 8, 0.97
#: Rows of one cell's part and queries of one visit that meet in a task, rows of a leaf, and rows drawn to fit the upper tree (the index holds every row).
CELL_ROWS, QUERY_ROWS, LEAF_ROWS, SAMPLE_ROWS = 8192, 4096, 512, 1 << 16


def chi_square_bound(sure: float, dimensions: int) -> float:
    """x with P[chi-square of that many (even) dimensions <= x] = sure."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
        low, high = (x, high) if below < sure else (low, x)
    return high


def projection(dim: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Gaussian (2-stable) projections of vectors of dim components and one more; the same in every task."""
    return np.random.default_rng([2027, dim, dimensions]).standard_normal((dimensions, dim + 1))


def projected(x: np.ndarray, most: float | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The projections of rows that are filled up to the norm `most` by one more component, which turns the largest inner product into the least distance; queries (most None) get none."""
    a = projection(x.shape[1], dimensions)
    rest = 0.0 if most is None else np.sqrt(np.maximum(most**2 - np.einsum("ij,ij->i", x, x), 0))[:, None] * a[:, -1]
    return x @ a[:, :-1].T + rest


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of x's and y's rows, component after component, so that equal vectors get equal products wherever they lie."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def least_of_equal(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Which rows to keep: of equal vectors the `most` smallest ids, each once. No more of them can be among the nearest of any query, as ties go to the smaller id."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]
    kind = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, kind))
    k, i = kind[order], ids[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
    order, k = order[fresh], k[fresh]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order[np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k)))) < most]


@dataclass
class Tree:
    """Upper kd-trees: one for each length of vectors and band of norms. A cell is a leaf; boxes are by the cuts alone, so that every row lies in one."""

    dim: np.ndarray
    most: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cuts: dict

    def cell_of(self, key: tuple[int, int], p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)

        def down(node, rows):
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                right = p[rows, node[0]] > node[1]
                down(node[2], rows[~right])
                down(node[3], rows[right])

        down(self.cuts[key], np.arange(len(p)))
        return out

    def gaps(self, cells: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Squared distances of each p (queries by cells by dimensions) from the cells' boxes."""
        gap = np.maximum(np.maximum(self.low[cells] - p, p - self.high[cells]), 0)
        return np.einsum("...k,...k->...", gap, gap)


def fit_tree(bands: list, sample: dict, cell_rows: int, dimensions: int) -> Tree:
    """Cuts at medians of the sample, in the dimension in which it spreads most, into cells of about cell_rows rows or at least eight drawn ones."""
    made: list[tuple] = []
    cuts = {}

    def cut(key, p, want, most, rows, low, high):
        if want > 1 and len(p) >= 16 and (spread := p.max(0) - p.min(0)).max() > 0:
            k = int(spread.argmax())
            at = np.median(p[:, k])
            right = p[:, k] > at
            if not right.any():
                at = p[p[:, k] < at, k].max()
                right = p[:, k] > at
            share = right.mean()
            upto, beyond = high.copy(), low.copy()
            upto[k] = beyond[k] = at
            return k, float(at), cut(key, p[~right], want * (1 - share), most, rows * (1 - share), low, upto), cut(key, p[right], want * share, most, rows * share, beyond, high)
        made.append((key[0], most, rows, low, high))
        return len(made) - 1

    for r in bands:
        key = r["dim"], r["band"]
        p = sample.get(key, np.zeros((0, dimensions)))
        cuts[key] = cut(key, p, r["n"] / cell_rows, r["most"], r["n"], np.full(dimensions, -np.inf), np.full(dimensions, np.inf))
    dim, most, rows, low, high = zip(*made)
    return Tree(np.array(dim), np.array(most), np.array(rows, float), np.array(low), np.array(high), cuts)


def _rows(column, kind) -> np.ndarray:
    """The vectors of a binary column, in double precision."""
    return np.stack([np.frombuffer(z.as_buffer(), kind) for z in column]).astype(np.float64)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id, dim, band (of the norm, rounded to a power of two), norm, v (components as bytes) of the rows that take part; and the components' type."""
    kind = "<f4" if "float" in df.schema[vector_col].dataType.simpleString() else "<f8"

    def take(batches):
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                wide = x.astype(np.float64)
                with np.errstate(all="ignore"):
                    norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
                good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                if len(good):
                    band = np.floor(np.log2(norm[good]) + 0.5).astype(np.int32)
                    ids = batch.column(0).take(pa.array(at[good]))
                    columns = [ids, pa.array(np.full(len(good), dim, np.int32)), pa.array(band), pa.array(norm[good]), pa.array([r.tobytes() for r in x[good]], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "band", "norm", "v"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(take, "vec_id long, dim int, band int, norm double, v binary"), kind


def _by_band(batch):
    """The batch's rows of each (dim, band), with their numbers."""
    dim, band = (batch.column(c).to_numpy() for c in ("dim", "band"))
    for key in sorted(set(zip(dim.tolist(), band.tolist()))):
        at = np.flatnonzero((dim == key[0]) & (band == key[1]))
        yield key, batch.take(pa.array(at))


def kd_leaves(p: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree's leaves: rows in leaf order, where each leaf begins (with the end behind), and the leaves' bounds."""
    order, ends, todo = np.arange(len(p)), [0], [(0, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf_rows:
            ends.append(b)
            continue
        part = p[order[a:b]]
        k, half = int((part.max(0) - part.min(0)).argmax()), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, k], half)]
        todo += [(a + half, b), (a, a + half)]
    ends = np.array(ends)
    return order, ends, np.minimum.reduceat(p[order], ends[:-1]), np.maximum.reduceat(p[order], ends[:-1])


def search_cell(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, known: np.ndarray, most: float, k: int, bound: float, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to k nearest of x to each query, as query number, row number, product; none that is worse than the k-th product already known (-inf: none is).

    Each query goes through the leaves in the order of their distance from its projection. In a leaf it verifies the rows whose projections lie within the radius, the k-th distance so far
    stretched by the chi-square bound; when the next leaf lies beyond the radius, the test holds and the query stops. The step is made for all queries at one leaf together.
    """
    p = projected(x, most)
    order, ends, low, high = kd_leaves(p, leaf_rows)
    p, x, ids = p[order], x[order], ids[order]
    length = np.sqrt(np.einsum("ij,ij->i", q, q))
    pq = projected(q * (most / length)[:, None], None)
    gap = np.maximum(np.maximum(low[None] - pq[:, None], pq[:, None] - high[None]), 0)
    gap = np.einsum("qlk,qlk->ql", gap, gap)
    path = np.argsort(gap, axis=1)
    gap = np.take_along_axis(gap, path, 1)
    best = np.full((len(q), k), -np.inf)
    kth, noise = known.copy(), 1e-12 * most
    found: list[tuple] = []

    def radius(rows):
        near = np.maximum(2 * most**2 - 2 * kth[rows] * (most / length[rows]), 0)
        return np.where(np.isneginf(kth[rows]), np.inf, bound * near + 1e-6 * most**2)

    going, squares = np.arange(len(q)), np.einsum("ij,ij->i", p, p)
    for step in range(len(ends) - 1):
        going = going[gap[going, step] <= radius(going)]
        leaf_of = path[going, step]
        for leaf in np.unique(leaf_of):
            rows, part = going[leaf_of == leaf], slice(ends[leaf], ends[leaf + 1])
            away = squares[part] - 2 * pq[rows] @ p[part].T + np.einsum("ij,ij->i", pq[rows], pq[rows])[:, None]
            product = q[rows] @ x[part].T
            product[(away > radius(rows)[:, None]) | (ids[part] == q_ids[rows][:, None])] = -np.inf
            hit = product >= kth[rows][:, None] - noise * length[rows][:, None]
            hit &= ~np.isneginf(product)
            some = np.flatnonzero(hit.any(1))
            if len(some):
                at, row = np.nonzero(hit[some])
                found.append((rows[some[at]], row + ends[leaf], product[some[at], row]))
                both = np.concatenate([best[rows[some]], product[some]], axis=1)
                best[rows[some]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[rows[some]] = np.maximum(kth[rows[some]], best[rows[some]].min(1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, product = (np.concatenate(c) for c in zip(*found))
    good = product >= kth[a] - noise * length[a]
    a, b = a[good], b[good]
    product = exact_products(q[a], x[b])
    last = np.lexsort((ids[b], -product, a))
    a, b, product = a[last], b[last], product[last]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    top = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) < k
    return a[top], order[b[top]], product[top]


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` names (a condition on vec_id) its k rows of largest inner product, those of its own id left out.

    Every row is indexed in a cell of a kd-tree over its projection, fitted on a drawn sample of sample_rows rows; a cell of more than cell_rows rows is dealt in parts. A query first
    searches the cells it lies in, then all parts of all cells within the radius that its k-th product so far allows. A row that is among the true nearest is found with a probability of
    `sure` or more; products are those of the original vectors, in double precision. Vectors of different lengths don't meet, and bands of norms have cells of their own, so that
    a few long vectors don't blur the distances of the others.

    Defined cases: null ids and vectors that are null, empty, zero or hold a null or non-finite component take no part, as query or candidate; rows with equal id and vector count once; an
    id with several vectors is a candidate with each and asks with the first of them by bytes; ties go to the smaller id; a query without candidates has no rows; an empty table gives no rows;
    other columns are left out.
    """
    spark, bound = df.sparkSession, chi_square_bound(sure, DIMENSIONS)
    schema = "query_id long, vec_id long, score double"
    rows, kind = vectors(df, id_col, vector_col)
    bands = rows.groupBy("dim", "band").agg(F.max("norm").alias("most"), F.count(F.lit(1)).alias("n")).orderBy("dim", F.desc("band")).collect()
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = {(r["dim"], r["band"]): r["most"] for r in bands}

    def project(batches):
        for batch in batches:
            for key, part in _by_band(batch):
                p = projected(_rows(part.column("v"), kind), most[key])
                yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("band"), pa.array([x.tobytes() for x in p], pa.binary())], ["dim", "band", "p"])

    share = sample_rows / sum(r["n"] for r in bands)
    drawn: dict = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share * (1 << 30)).mapInArrow(project, "dim int, band int, p binary").collect():
        drawn.setdefault((r["dim"], r["band"]), []).append(np.frombuffer(bytes(r["p"])))
    tree = fit_tree(bands, {key: np.stack(p) for key, p in drawn.items()}, cell_rows, DIMENSIONS)

    def place(batches):
        for batch in batches:
            for key, part in _by_band(batch):
                x = _rows(part.column("v"), kind)
                keep = least_of_equal(part.column("vec_id").to_numpy(), x, k + 1)
                cell = tree.cell_of(key, projected(x[keep], most[key]))
                part = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column("vec_id"), part.column("v")], ["cell", "vec_id", "v"])

    index = written(rows.mapInArrow(place, "cell int, vec_id long, v binary"), "index")
    parts = {r["cell"]: max(1, -(-r["n"] // cell_rows)) for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = written(rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "dim")).alias("x")).select("query_id", "x.v", "x.dim"), "queries")

    def homes(q: np.ndarray, dim: int) -> np.ndarray:
        """Each query's first cells: the one it lies in, in each band from the longest norms on, until a thousand rows are there."""
        out, rows_there = [], 0
        for r in bands:
            if r["dim"] == dim and rows_there < max(1000, 4 * k):
                out.append(tree.cell_of((dim, r["band"]), projected(q * (r["most"] / np.linalg.norm(q, axis=1))[:, None], None)))
                rows_there += r["n"]
        return np.stack(out, axis=1)

    def visits(first: bool):
        """Rows cell, from (the first part to search), query_id, v, known of the queries in batches (query_id, v, dim, known)."""

        def route(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    for at in np.array_split(np.flatnonzero(dims == dim), 1 + batch.num_rows // 256):
                        if not len(at):
                            continue
                        part = batch.take(pa.array(at))
                        q, known = _rows(part.column("v"), kind), part.column("known").to_numpy(zero_copy_only=False).astype(float)
                        home = homes(q, int(dim))
                        if first:
                            who, cell = np.repeat(np.arange(len(q)), home.shape[1]), home.ravel()
                            begin = np.zeros(len(cell), np.int32)
                        else:
                            cells = np.flatnonzero(tree.dim == dim)
                            length = np.linalg.norm(q, axis=1)[:, None]
                            far = np.maximum(2 * tree.most[cells] ** 2 - 2 * known[:, None] * tree.most[cells] / length, 0)
                            far = np.where(np.isnan(known)[:, None], np.inf, bound * far + 1e-6 * tree.most[cells] ** 2)
                            one = projected(q / length, None)
                            who, cell = np.nonzero(tree.gaps(cells, one[:, None] * tree.most[cells][:, None]) <= far)
                            cell = cells[cell]
                            begin = (home[who] == cell[:, None]).any(1).astype(np.int32)
                        rows_out = part.select(["query_id", "v", "known"]).take(pa.array(who))
                        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(begin), *rows_out.columns], ["cell", "begin", "query_id", "v", "known"])

        return route

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        if not rows.num_rows or not asking.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = rows.column("vec_id").to_numpy(), _rows(rows.column("v").combine_chunks(), kind)
        keep = least_of_equal(ids, x, k + 1)
        q_ids, known = asking.column("query_id").to_numpy(), np.nan_to_num(asking.column("known").to_numpy().astype(float), nan=-np.inf)
        a, b, product = search_cell(ids[keep], x[keep], q_ids, _rows(asking.column("v").combine_chunks(), kind), known, float(tree.most[rows.column("cell")[0].as_py()]), k, bound)
        return pa.table({"query_id": q_ids[a], "vec_id": ids[keep][b], "score": product})

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        there = written(asking.mapInArrow(visits(first), "cell int, begin int, query_id long, v binary, known double"), "visits")
        busy = [(r["cell"], 1 if first else parts[r["cell"]], -(-r["n"] // query_rows)) for r in there.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect() if r["cell"] in parts]
        sizes = F.broadcast(spark.createDataFrame(busy, "cell int, asked int, shares int"))
        whole = F.broadcast(spark.createDataFrame([(c, n) for c, n in parts.items()], "cell int, dealt int"))
        cells = index.join(whole, "cell").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "dealt").cast("int")).where("part < asked")
        cells = cells.select("cell", "part", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "vec_id", "v")
        those = there.join(sizes, "cell").where("begin < asked").select("cell", F.explode(F.expr("sequence(begin, asked - 1)")).alias("part"), F.pmod(F.xxhash64("query_id"), "shares").cast("int").alias("share"), "query_id", "v", "known")
        return cells.groupBy("cell", "part", "share").cogroup(those.groupBy("cell", "part", "share")).applyInArrow(meet, schema)

    near = written(searched(asked.withColumn("known", F.lit(None).cast("double")), True), "near")
    scores = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.expr(f"get(s, {k - 1})").alias("known"))
    more = searched(asked.join(scores, "query_id", "left"), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings to each row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
