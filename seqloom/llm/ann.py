"""Nearest neighbours by balanced posting lists around centroids.

Vectors are lifted by one coordinate so that the largest inner product becomes the smallest
distance.  Centroids come from a bounded sample (``SAMPLE`` vectors) by splitting the
largest cluster at its median until the lists have their size, so lists stay balanced.  A
graph of near centroids, held in every task, is searched best-first.  A vector goes to its
nearest list and, as a boundary vector, to further lists that are nearly as near; a query
visits all lists within a ratio of its smallest distance.  The ratio belongs to the table:
a bounded sample of queries is compared with every vector, and the ratio is the least that
leads the sample to its share ``REACH`` of true neighbours.  Lists and their queries are cut
into blocks of bounded size, so a list that holds a third of all rows is many tasks, and a
task returns no more than ``k`` neighbours per query.  Scores are computed anew in
double precision on the original vectors.

Rows with a null id, or vectors that are null, empty, zero, or hold null or non-finite
components take no part (huge and tiny ones do; scores beyond the doubles are infinite and
tie, and a vector that dwarfs all others makes the lists of those long), nor do vectors of another width than the most common one (the
smallest on ties).  Ties go to the smaller id and a row repeated under one id counts once.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .columns import partitions, small_batches

SAMPLE = 20_000  # vectors the centroids are fitted on, at most
LIST = 500  # vectors of a list before replication
COPIES, NEAR = 4, 1.15  # lists of a boundary vector, and how much farther they may be
RATIO = 1.09  # least distance ratio within which a query visits lists
PROBES, REACH = 200, 0.96  # queries compared with all vectors, and the share of their neighbours the ratio reaches
VECTORS, QUERIES = 4096, 2048  # of one block of a list
DENSE = 4  # a query whose beam would hold a DENSE-th of the centroids, and still not all within its ratio, measures all
DEGREE, LONG = 12, 4  # near and far links of a centroid
BEAM = 48  # centroids kept on the way


@dataclass
class Graph:
    """Centroids with links; ``search`` walks it for many points at once."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        square = (centroids**2).sum(1)
        near = np.argsort(square[:, None] + square - 2 * centroids @ centroids.T, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        far = np.random.default_rng(0).integers(0, n, (n, LONG))
        ring = (np.arange(n) + 1)[:, None] % n  # keeps every centroid within reach
        return cls(centroids, np.hstack([near, far, ring]), np.unique(np.linspace(0, n - 1, 8).astype(int)))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest centroids found, nearest first."""
        n, rows = len(x), np.arange(len(x))
        beam = min(beam, len(self.centroids))
        seen = np.zeros((n, len(self.centroids)), bool)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        fresh, again = _once(np.broadcast_to(self.entries, (n, len(self.entries))))
        while True:
            d = np.sqrt(np.maximum(((self.centroids[fresh] - x[:, None]) ** 2).sum(2), 0))
            d = np.where(seen[rows[:, None], fresh] | again, np.inf, d)
            seen[rows[:, None], fresh] = True
            all_ids, all_d = np.hstack([ids, fresh]), np.hstack([dist, d])
            all_done = np.hstack([done, np.isinf(d)])
            order = np.lexsort((all_ids, all_d))[:, :beam]
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_d, all_done))
            open_ = ~done
            if not open_.any():
                return ids, dist
            best = open_.argmax(1)
            done[rows, best] = True
            fresh, again = _once(self.links[np.where(open_.any(1), ids[rows, best], self.entries[0])])

    def within(self, x: np.ndarray, ratio: float, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Lists of every row, and which lie within ``ratio`` times its smallest distance (``least`` at least).

        The graph is searched first, at every size.  For rows whose beam does not hold them all it
        widens; at a share of ``1 / DENSE`` of the centroids, all are measured for such a row.
        """
        n, rows, width = len(self.centroids), np.arange(len(x)), min(beam, len(self.centroids))
        ids = np.zeros((len(x), width), np.int64)
        near = np.zeros(ids.shape, bool)
        while len(rows):
            found, dist = self.search(x[rows], beam)
            reach = ratio * np.maximum(dist[:, :1], least)
            settled = (dist[:, -1] > reach[:, 0]) | (beam >= n)
            ids, near = _set(ids, near, rows[settled], found[settled], (dist <= reach)[settled])
            rows = rows[~settled]
            beam *= 2
            if DENSE * beam >= n:
                break
        if len(rows):
            dist = self.distances(x[rows])
            found = np.broadcast_to(np.arange(n), dist.shape)
            ids, near = _set(ids, near, rows, found, dist <= ratio * np.maximum(dist.min(1, keepdims=True), least))
        return ids, near

    def distances(self, x: np.ndarray) -> np.ndarray:
        """From every row to every centroid."""
        square = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1)
        return np.sqrt(np.maximum(square - 2 * x @ self.centroids.T, 0))


def _set(ids, near, rows, found, within):
    """Both tables with the rows found, widened where these are wider; they stay as they are if none was."""
    if not len(rows):
        return ids, near
    more = found.shape[1] - ids.shape[1]
    if more > 0:
        ids, near = (np.pad(a, ((0, 0), (0, more))) for a in (ids, near))
    ids[rows, : found.shape[1]], near[rows, : found.shape[1]] = found, within
    return ids, near


def _once(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of links sorted, and which of them repeat the one before."""
    links = np.sort(links, axis=1)
    same = np.zeros(links.shape, bool)
    same[:, 1:] = links[:, 1:] == links[:, :-1]
    return links, same


def lift(x: np.ndarray) -> np.ndarray:
    """Vectors of length one at most with a last coordinate that makes them one long."""
    rest = np.sqrt(np.maximum(1 - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def fit(sample: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids of clusters halved, always the largest, until there are enough."""
    rng = np.random.default_rng(0)
    clusters = [np.arange(len(sample))]
    while len(clusters) < lists:
        members = clusters.pop(max(range(len(clusters)), key=lambda i: len(clusters[i])))
        if len(members) < 2:
            clusters.append(members)
            break
        x = sample[members]
        ends = x[rng.choice(len(members), 2, replace=False)]
        for _ in range(rounds):
            side = np.argsort(x @ (ends[1] - ends[0]), kind="stable")
            halves = side[: len(side) // 2], side[len(side) // 2 :]
            ends = np.stack([x[h].mean(0) for h in halves])
        clusters += [members[h] for h in halves]
    return np.unique(np.stack([sample[c].mean(0) for c in clusters]), axis=0)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vec`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(key).alias("vec_id"), v.alias("vec")).where(F.col("vec_id").isNotNull())
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("vec") == (width["w"] if width else 0))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def shrunk(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors in units of the longest one, whose length is ``2 ** longest``."""
    half = 2.0 ** (longest / 2)  # the length itself may be beyond the doubles
    return x / half / half


def aimed(x: np.ndarray) -> np.ndarray:
    """Queries lifted; only directions matter, so all are as long as the longest vector, one."""
    x = x / np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components are not doubles
    return lift(x / np.sqrt((x**2).sum(1))[:, None])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows; those beyond the doubles are infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = x @ q.T
        odd = ~np.isfinite(out)
        if odd.any():  # sums of the overflown parts need not be infinite, nor have a sign
            small = np.ldexp(np.ldexp(x, -520) @ np.ldexp(q, -520).T, 1040)
            out[odd] = small[odd]
    return out


def assign(graph: Graph, longest: float, reach: tuple[float, float] | None = None):
    """Rows ``list, id, vec`` for every list that a vector, or with ``reach`` a query, belongs to."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vec"])
            if reach:
                ids, near = graph.within(aimed(x), *reach)
            else:
                ids, dist = graph.search(lift(shrunk(x, longest)), BEAM)
                ids, dist = ids[:, :COPIES], dist[:, :COPIES]
                near = dist <= NEAR * dist[:, :1]
            row, at = np.nonzero(near & (ids >= 0))
            taken = pa.array(row)
            columns = [pa.array(ids[row, at].astype(np.int32)), batch["vec_id"].take(taken), batch["vec"].take(taken)]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "id", "vec"])

    return place


def _probe(q_ids: np.ndarray, q: np.ndarray, ratios: np.ndarray, k: int):
    """Rows ``q, id, score, ratio`` of each probe's best of a task; ``ratio`` leads it to that row's list."""
    most = k * COPIES  # a vector has a row in each of its lists

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score, ratio = (np.empty((len(q), 0), t) for t in (np.int64, float, float))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch["id"].to_numpy()
            own_score = products(q, _matrix(batch["vec"]))
            own_score[own == q_ids[:, None]] = -np.inf
            score = np.hstack([score, own_score])
            ids = np.hstack([ids, np.broadcast_to(own, own_score.shape)])
            ratio = np.hstack([ratio, ratios[:, batch["list"].to_numpy()]])
            if score.shape[1] > most:
                best = np.argpartition(score, -most, axis=1)[:, -most:]
                ids, score, ratio = (np.take_along_axis(a, best, 1) for a in (ids, score, ratio))
        row, at = np.nonzero(score > -np.inf)
        columns = [pa.array(row.astype(np.int32)), *[pa.array(a[row, at]) for a in (ids, score, ratio)]]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "id", "score", "ratio"])

    return probe


def fitted(posts: DataFrame, asked: DataFrame, graph: Graph, k: int) -> tuple[float, float]:
    """The ratio that leads ``PROBES`` queries to ``REACH`` of their true neighbours, and the least distance it is taken of."""
    rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow()
    if not rows.num_rows:
        return RATIO, 0.0
    q_ids, q = rows["vec_id"].to_numpy(), _matrix(rows["vec"])
    dist = graph.distances(aimed(q))
    nearest_list = dist.min(1, keepdims=True)
    least = max(nearest_list.mean() / 2, 1e-3)  # a query on a centroid still looks around
    ratios = dist / np.maximum(nearest_list, least)
    seen = posts.mapInArrow(_probe(q_ids, q, ratios, k), "q int, id long, score double, ratio double")
    seen = seen.groupBy("q", "id").agg(F.max("score").alias("score"), F.min("ratio").alias("ratio"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = seen.withColumn("rank", rank).where(F.col("rank") <= k).select("ratio").toArrow()["ratio"].to_numpy()
    wanted = np.quantile(true, REACH, method="higher") * (1 + 1e-9) if len(true) else RATIO
    return max(RATIO, float(wanted)), float(least)


def _best(k: int):
    """The ``k`` best of one block of a list for each of its queries."""

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        asked, near, scores = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids, x = vectors["id"].to_numpy(), _matrix(vectors["vec"])
            ids, first = np.unique(ids, return_index=True)
            x = x[first]
            asked = queries["id"].to_pylist()
            near, scores = zip(*[_top(ids, x, q_id, q, k) for q_id, q in zip(asked, _matrix(queries["vec"]))])
        return pa.table({"query_id": asked, "near": near, "scores": scores}, schema=FOUND)

    return search


def _top(ids, x, q_id, q, k):
    rough = products(x, q)
    rough[ids == q_id] = -np.inf
    if len(ids) > k:
        bound = np.partition(rough, -k)[-k]
        slack = 1e-9 * (1 + abs(bound)) if np.isfinite(bound) else 0
        keep = np.flatnonzero((rough >= bound - slack) & (ids != q_id))
    else:
        keep = np.flatnonzero(ids != q_id)
    with np.errstate(over="ignore", invalid="ignore"):
        score = (x[keep] * q).sum(1)
    score = np.where(np.isfinite(score), score, rough[keep])
    order = np.lexsort((ids[keep], -score))[:k]
    return ids[keep][order], score[order]


FOUND = pa.schema([("query_id", pa.int64()), ("near", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _merge(k: int):
    """Ranks over what the blocks of a query's lists found; a neighbour in two lists counts once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), FOUND)
        q = np.repeat(rows["query_id"].to_numpy(), pc.list_value_length(rows["near"]).to_numpy())
        v, s = (pc.list_flatten(rows[c]).to_numpy() for c in ("near", "scores"))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])][: len(q)]
        q, v, s = q[new], v[new], s[new]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) + 1
        top = rank <= k
        columns = [pa.array(q[top]), pa.array(rank[top].astype(np.int32)), pa.array(v[top]), pa.array(s[top])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

    return merge


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the neighbours found of every row of ``queries``."""
    spark = table.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = usable(table, key, vector)
    top = F.array_max(F.transform("vec", F.abs))

    def length(t):  # as a power of two; ``t`` is found once a row
        return F.log2(t) + F.log2(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v / t * (v / t))) / 2

    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.transform(F.array(top), length)[0])).first()
    if not n:
        return spark.createDataFrame([], schema)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = lift(shrunk(_matrix(rows["vec"]), longest))
    width = sample.shape[1] - 1
    graph = Graph.of(fit(sample, max(1, min(n // LIST, len(sample) // 8))))

    asked = usable(queries, key, vector).where(F.size("vec") == width)
    placed = "list int, id long, vec array<double>"
    posts = cut(vectors.mapInArrow(assign(graph, longest), placed))
    visits = cut(asked.mapInArrow(assign(graph, longest, fitted(posts, asked, graph, k)), placed))
    blocks = (
        posts.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("v"))
        .join(visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q")), "list")
    )

    def dealt(df, own, other):
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own)
        others = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return df.join(blocks, "list").select("list", mine, others, "id", "vec")

    keys = ["list", "v", "q"]
    found = (
        dealt(posts, "v", "q").groupBy(*keys)
        .cogroup(dealt(visits, "q", "v").groupBy(*keys))
        .applyInArrow(_best(k), "query_id long, near array<long>, scores array<double>")
    )
    return found.repartition(partitions(spark), "query_id").mapInArrow(_merge(k), schema)
