"""Exact top-k inner-product search with cover trees over queries and data.

A tree splits its points by a separated net: farthest-first centres, each point under its nearest one, so the
centres of a level lie further apart than its covering radius. For a group of queries around p with radius s and
a group of data around c with radius r no inner product exceeds <p, c> + |p| r + |c| s + s r; a pair of nodes below
the worst kth score of the query group is pruned, else the wider node is opened. Pairs are taken best bound first,
so good scores come early. Nothing is approximated: what is left at the leaves is scored in full.

On a cluster the queries are written as files of bounded size in the shared folder. Each task indexes blocks of its own
rows and goes through these files, a query block at a time, so the search is a grid of query blocks by data blocks in
one job, without a loop on the driver, and only each data block's k best candidates of each query are shuffled. Of
more rows than a block a share is searched first: what it finds bounds each query's kth score from below, so the
blocks of the rest prune from the start and hand on few candidates."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .common import materialize, new_path, trimmed

#: Centres of a split; points and queries of a leaf; queries of a file; vectors of a tree.
FAN, LEAF, QUERY_LEAF, QUERY_BLOCK, DATA_BLOCK = 12, 512, 128, 8192, 131_072
#: A node whose leaves have radii of more than this share of its own on average stays a leaf: its parts are no smaller
#: balls, so pruning among them would not pay. Scores of a pair of leaves that are held at a time.
FLAT, CELLS = 0.75, 2_000_000
_STEPS, _NO_ID = 1 << 30, np.iinfo(np.int64).max


class CoverTree:
    """Nodes in arrays: centre, covering radius, children, and the range of `order` that holds the node's points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.points = points
        order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.range: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, points[0] if len(points) else None)] if len(points) else []
        while todo:
            a, b, up, centre = todo.pop()
            own = order[a:b]
            x = points[own]
            far = np.sqrt(np.maximum(((x - centre) ** 2).sum(axis=1), 0))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(far.max()) * (1 + 1e-12))
            self.children.append([])
            self.range.append((a, b))
            if up >= 0:
                self.children[up].append(node)
            if b - a <= leaf or far.max() == 0:
                continue
            near, label = far, np.zeros(b - a, dtype=np.int64)
            centres = [centre]
            for k in range(1, fan):
                pick = int(near.argmax())
                if near[pick] == 0:
                    break
                centres.append(x[pick])
                d = np.sqrt(np.maximum(((x - x[pick]) ** 2).sum(axis=1), 0))
                label[d < near] = k
                near = np.minimum(near, d)
            place = np.argsort(label, kind="stable")
            order[a:b] = own[place]
            cuts = np.searchsorted(label[place], np.arange(len(centres) + 1))
            for k, c in enumerate(centres):
                if cuts[k + 1] > cuts[k]:
                    todo.append((a + int(cuts[k]), a + int(cuts[k + 1]), node, c))
        below = [0.0] * len(self.centre)  # radii of the leaves under each node, by their points
        for node in reversed(range(len(self.centre))):
            size = self.range[node][1] - self.range[node][0]
            below[node] = sum(below[c] for c in self.children[node])
            if not self.children[node] or below[node] > FLAT * self.radius[node] * size:
                self.children[node], below[node] = [], self.radius[node] * size
        self.order = order
        self.sorted = points[order]
        self.centres = np.array(self.centre) if self.centre else np.zeros((0, points.shape[1] if points.ndim == 2 else 0))
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.radii = np.array(self.radius)


class TopK:
    """The k best candidates of each query so far: higher scores first, then smaller ids. Places that are not taken have
    a lower bound of the kth score and no id."""

    def __init__(self, queries: int, k: int, bounds: np.ndarray | None = None):
        self.k = k
        self.scores = np.repeat((np.full(queries, -np.inf) if bounds is None else bounds)[:, None], k, axis=1)
        self.ids = np.full((queries, k), _NO_ID)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[rows, -1]
        r, c = np.nonzero(scores >= least[:, None])
        if len(r) > 4 * self.k * len(rows) and scores.shape[1] > self.k:  # only the k best new ones of a row, with all ties of the last
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
            r, c = np.nonzero(scores >= least[:, None])
        if not len(r):
            return
        some, r = np.unique(r, return_inverse=True)
        own = rows[some]
        place = np.concatenate((np.repeat(np.arange(len(own)), self.k), r))
        s = np.concatenate((self.scores[own].reshape(-1), scores[some[r], c]))
        i = np.concatenate((self.ids[own].reshape(-1), ids[c]))
        order = np.lexsort((i, -s, place))
        first = np.searchsorted(place[order], np.arange(len(own)))
        best = order[first[:, None] + np.arange(self.k)]  # each row has k at least
        self.scores[own], self.ids[own] = s[best], i[best]


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, found: TopK) -> int:
    """Offers to `found` every data point that may be among a query's k best; returns the pairs of leaves scored."""
    if not len(queries.order) or not len(data.order):
        return 0

    def bound(q: int, nodes) -> np.ndarray:
        return data.centres[nodes] @ queries.centres[q] + queries.norms[q] * data.radii[nodes] + (data.norms[nodes] + data.radii[nodes]) * queries.radii[q]

    scored = 0
    slack = 1e-6
    top = float(bound(0, [0])[0])
    heap = [(-top, 0, 0)]
    while heap:
        minus, q, d = heapq.heappop(heap)
        a, b = queries.range[q]
        rows = queries.order[a:b]
        if -minus + slack < found.scores[rows, -1].min():
            continue
        wide_q = queries.children[q] and (not data.children[d] or queries.radii[q] * data.norms[d] >= data.radii[d] * queries.norms[q])
        if wide_q:
            for c in queries.children[q]:
                heapq.heappush(heap, (-float(bound(c, [d])[0]), c, d))
        elif data.children[d]:
            kids = np.array(data.children[d])
            limits = bound(q, kids)
            worst = found.scores[rows, -1].min()
            for limit, c in zip(limits.tolist(), kids.tolist()):
                if limit + slack >= worst:
                    heapq.heappush(heap, (-limit, q, c))
        else:
            x, y = data.range[d]
            width = max(1, CELLS // (b - a))
            for at in range(x, y, width):
                own = data_ids[data.order[at : min(at + width, y)]]
                s = queries.sorted[a:b] @ data.sorted[at : at + len(own)].T
                s[query_ids[rows][:, None] == own[None, :]] = -np.inf
                found.offer(rows, s, own)
            scored += 1
    return scored


def _vectors(column) -> np.ndarray:
    """[rows, dimension] of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_dimension(table) -> dict[int, pa.Table]:
    dims = table.column("dim").to_numpy()
    return {d: table.filter(pa.array(dims == d)) for d in np.unique(dims).tolist()}


def _of_dimension(table, dim: int) -> np.ndarray:
    column = table.column("v")
    return _vectors(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column) if dim else np.zeros((len(table), 0))


def _search(folder: str, k: int, block: int):
    """For each block of data rows the k best of each query of the same dimension that reach the query's bound. The
    queries are read from the files in `folder`."""

    def run(batches):
        names = sorted(n for n in storage.list_names(folder) if n.endswith(".parquet"))
        held: dict[int, list] = {}

        def results(dim):
            x, ids = (np.concatenate(p) for p in zip(*held.pop(dim)))
            data = CoverTree(x)
            for name in names:
                with storage.open_input(f"{folder}/{name}") as f:
                    own = _by_dimension(pq.read_table(f)).get(dim)
                if own is None:
                    continue
                numbers, query_ids = own.column("query").to_numpy(), own.column("vec_id").to_numpy()
                found = TopK(len(query_ids), k, own.column("bound").to_numpy())
                dual_search(CoverTree(_of_dimension(own, dim), leaf=QUERY_LEAF), query_ids, data, ids, found)
                q, r = np.nonzero((found.ids < _NO_ID) & (found.scores > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(query_ids[q]), pa.array(found.ids[q, r]), pa.array(found.scores[q, r].astype(np.int64))], ["query", "query_id", "vec_id", "score"])

        for b in batches:
            for dim, part in _by_dimension(b).items():
                held.setdefault(dim, []).append((_of_dimension(part, dim), part.column("vec_id").to_numpy()))
                if sum(len(i) for _, i in held[dim]) >= block:
                    yield from results(dim)
        for dim in list(held):
            yield from results(dim)

    return trimmed(run)


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v): rows with an id and a vector of finite components, each as floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return kept.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * float(scale)).cast("double")).alias("v"))


def _best(data: DataFrame, queries: DataFrame, k: int, query_block: int, data_block: int) -> DataFrame:
    """(query, query_id, vec_id, score, rank): the k best rows of `data` for each of `queries` (query, vec_id, dim, v, bound)."""
    folder = new_path(data.sparkSession, "topk-queries")
    queries.write.option("maxRecordsPerFile", query_block).parquet(folder)
    found = data.mapInArrow(_search(folder, k, data_block), "query long, query_id long, vec_id long, score long")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k other rows with the
    highest inner product of the scaled integer vectors, ties to the smaller vec_id; all of them, if fewer.

    Rows without vec_id, and vectors that are null or hold a null or non-finite component, take no part. Vectors meet
    those of the same length only; two empty ones score 0. Repeated equal rows are one query, and candidates as often
    as they come, but never of their own vec_id; a repeated vec_id with another vector is another query. No rows or no
    queries: an empty table. Other columns are not read. Sums are exact while they stay below 2^53."""
    data = usable(vectors, scale)
    queries = data.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    queries = materialize(queries.withColumn("query", F.monotonically_increasing_id()), "topk-numbered")
    unbound = queries.withColumn("bound", F.lit(float("-inf")))
    total = data.count()
    if total <= data_block:
        return _best(data, unbound, k, query_block, data_block).select("query_id", "rank", "vec_id", "score")
    share = (data_block / total) ** 0.5
    is_first = F.pmod(F.xxhash64("vec_id"), F.lit(_STEPS)) < int(share * _STEPS)
    first = materialize(_best(data.where(is_first), unbound, k, query_block, data_block).drop("rank"), "topk-first")
    bounds = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("known"))
    bound = queries.join(bounds, "query", "left").withColumn("bound", F.coalesce("known", F.lit(float("-inf")))).drop("known")
    rest = _best(data.where(~is_first), bound, k, query_block, data_block).drop("rank")
    return _ranked(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


SQL = """
with data as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v, len(embedding) as dim
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
queries as (select distinct vec_id, v, dim from data where vec_id % 50 = 0),
pairs as (
  select q.vec_id as query_id, q.v as qv, d.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from queries q join data d on q.dim = d.dim and q.vec_id <> d.vec_id
),
ranked as (select *, row_number() over (partition by query_id, qv order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
