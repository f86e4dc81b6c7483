"""Nearest neighbours by largest inner product over pruned directed graphs.

1. Equal vectors are one node; of its ids only the ``k + 1`` smallest can be among
   anyone's nearest, so no more are kept.
2. Nodes are dealt to cells by the nearest of some centroids, fitted on a bounded
   sample; a cell of more than ``shard_rows`` nodes is split by a hash.  Every
   node is in one shard, and a shard is all that a task holds.
3. Each shard gets a directed graph.  Nodes are inserted in batches of doubling
   size: a greedy search proposes the nodes it went through as neighbours, and
   robust pruning keeps the nearest, drops what is ``relax`` times nearer to it
   than to the node, and goes on, so that the edges kept point in different
   directions.  Edges back are pruned in the same way.  A second round searches
   again, over the whole graph.  Inner products become distances by one more
   component that gives all vectors of a shard one length.
4. A query goes to the cells whose centroids it is nearest to, to all shards of
   them, and is searched there with a beam.  How many cells: as many as hold
   ``cover`` of the true neighbours in the sample, measured there by brute force.
5. The nodes found are scored in double precision on the original vectors, in one
   order of summation, so equal vectors have equal scores.

Rows whose id or vector is null, and vectors that are empty, zero or hold a null
or a non-finite component, take no part.  A vector meets those of its own length
only.  Rows that repeat an id and vector count once; rows that share an id but
not the vector are candidates of their own under that id, and as queries all of
them give results.  An empty table gives none.  Other columns are not looked at.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trophos.plans.scratch import Scratch

#: Nodes of a shard, queries of a task; edges of a node, width of the beam.
SHARD_ROWS, QUERY_ROWS, DEGREE, BEAM = 8192, 4096, 32, 64
#: Vectors that centroids and the number of cells are fitted on, and queries among them; centroids at most.
SAMPLE, PROBE_QUERIES, CELLS = 16_384, 256, 1024
#: Nodes that are inserted, or queries that are searched, at once.
BATCH = 512


# --- graph of one shard -------------------------------------------------------


def distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes."""
    diff = x[ids] - q[:, None, :]
    return np.einsum("brd,brd->br", diff, diff)


def greedy_search(x, edges, q, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of many queries in step.  Per query: the beam's nodes and distances, nearest first, and the nodes
    it went through; -1 where there are none."""
    n, b = len(x), len(q)
    ids = np.full((b, beam), -1, np.int64)
    far = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    far[:, 0] = distances(x, ids[:, :1], q)[:, 0]
    seen = np.zeros((b, n + 1), bool)
    seen[:, entry] = seen[:, n] = True
    through = []
    while True:
        open_at = np.where(done, np.inf, far)
        at = open_at.argmin(axis=1)
        rows = np.flatnonzero(np.isfinite(open_at[np.arange(b), at]))
        if not len(rows):
            break
        at = at[rows]
        done[rows, at] = True
        node = ids[rows, at]
        step = np.full(b, -1, np.int64)
        step[rows] = node
        through.append(step)
        near = edges[node]  # n where a node has fewer edges
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        row, at = np.nonzero(fresh)
        diff = x[near[row, at]]
        diff -= q[rows[row]]
        d = np.full(near.shape, np.inf)
        d[row, at] = np.einsum("pd,pd->p", diff, diff)
        all_d = np.concatenate([far[rows], d], axis=1)
        all_ids = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[rows], ~fresh], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(rows))[:, None]
        far[rows], ids[rows], done[rows] = all_d[take, best], all_ids[take, best], all_done[take, best]
    order = far.argsort(axis=1, kind="stable")
    take = np.arange(b)[:, None]
    return ids[take, order], far[take, order], np.stack(through, axis=1)


def robust_prune(x, nodes, candidates, degree: int, relax: float) -> np.ndarray:
    """Edges (len(nodes), degree) of nodes from their candidates; -1 where there is none; len(x) marks no edge."""
    n = len(x)
    own = candidates.copy()
    own[(own < 0) | (own == n)] = n
    own[own == nodes[:, None]] = n
    own.sort(axis=1)  # a candidate that is listed again goes
    own[:, 1:][own[:, 1:] == own[:, :-1]] = n
    d = np.where(own < n, distances(x, np.minimum(own, n - 1), x[nodes]), np.inf)
    order = d.argsort(axis=1, kind="stable")[:, : 4 * degree]
    take = np.arange(len(nodes))[:, None]
    own, d = own[take, order], d[take, order]
    alive = np.isfinite(d)
    v = x[np.minimum(own, n - 1)]
    square = np.einsum("bcd,bcd->bc", v, v)
    edges = np.full((len(nodes), degree), n, np.int64)
    rows = np.arange(len(nodes))
    for slot in range(degree):
        first = alive.argmax(axis=1)  # sorted by distance
        has = alive[rows, first]
        if not has.any():
            break
        edges[has, slot] = own[rows, first][has]
        between = square + square[rows, first][:, None] - 2 * np.einsum("bcd,bd->bc", v, v[rows, first])
        alive &= ~(relax * relax * between <= d) | ~has[:, None]
        alive[rows[has], first[has]] = False
    return edges


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = 1.2) -> tuple[np.ndarray, int]:
    """Edges (n, degree) with n for no edge, and the node where searches start.

    While it grows, a node may have twice as many edges, so that edges back seldom make it prune.
    """
    n = len(x)
    edges = np.full((n, 2 * degree), n, np.int64)
    entry = int(np.square(x - x.mean(axis=0)).sum(axis=1).argmin())
    order = np.random.default_rng(17).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for whole in (False, True):
        at = 0 if whole else 1
        while at < n:
            size = BATCH if whole else min(BATCH, max(1, at))
            nodes = order[at : at + size]
            at += size
            _, _, through = greedy_search(x, edges, x[nodes], entry, beam)
            edges[nodes, degree:] = n
            edges[nodes, :degree] = robust_prune(x, nodes, np.concatenate([through, edges[nodes]], axis=1), degree, relax)
            _link_back(x, edges, nodes, degree, relax)
    edges.sort(axis=1)
    full = np.flatnonzero(edges[:, degree] < n)
    for a in range(0, len(full), BATCH):
        own = full[a : a + BATCH]
        edges[own, :degree] = robust_prune(x, own, edges[own], degree, relax)
    return edges[:, :degree], entry


def _link_back(x, edges, nodes, degree: int, relax: float) -> None:
    """The edges of ``nodes`` in the other direction; nodes with too many are pruned."""
    n, width = len(x), edges.shape[1]
    source, target = np.repeat(nodes, degree), edges[nodes, :degree].ravel()
    source, target = source[target < n], target[target < n]
    missing = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[missing], target[missing]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    owners, first, count = np.unique(target, return_index=True, return_counts=True)
    while len(owners):  # some edges of each owner at a time
        part = np.minimum(count, width)
        place = np.arange(int(part.max()))
        extra = np.where(place < part[:, None], source[np.minimum(first[:, None] + place, len(source) - 1)], n)
        both = np.sort(np.concatenate([edges[owners], extra], axis=1), axis=1)
        fits = (both < n).sum(axis=1) <= width
        edges[owners[fits]] = both[fits, :width]
        full = np.flatnonzero(~fits)
        for a in range(0, len(full), BATCH):
            own = full[a : a + BATCH]
            edges[owners[own], degree:] = n
            edges[owners[own], :degree] = robust_prune(x, owners[own], both[own], degree, relax)
        first, count = first + part, count - part
        owners, first, count = owners[count > 0], first[count > 0], count[count > 0]


def with_one_length(x: np.ndarray) -> np.ndarray:
    """One more component that makes all rows as long as the longest: the nearest then have the largest products."""
    square = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))[:, None]], axis=1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


# --- cells --------------------------------------------------------------------


@dataclass
class Cells:
    """Centroids by length of vectors, and how many of them a query visits."""

    centroids: dict[int, np.ndarray]
    probes: dict[int, int]

    def nearest(self, vectors: list, count: bool) -> list[list[int]]:
        """Numbers of the nearest cells of each vector, one or as many as queries visit."""
        out: list = [[0]] * len(vectors)
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths):
            centroids = self.centroids.get(int(length))
            own = np.flatnonzero(lengths == length)
            if centroids is None or len(centroids) < 2:
                continue
            x = _unit(np.array([vectors[i] for i in own], float))
            take = self.probes[int(length)] if count else 1
            for i, cells in zip(own, _ranked(x @ centroids.T)[:, :take].tolist()):
                out[i] = cells
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(size > 0, size, 1)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _ranked(likeness: np.ndarray) -> np.ndarray:
    return np.argsort(-likeness, axis=1, kind="stable")


def fit_cells(sample: list, cells: int, k: int, cover: float) -> Cells:
    """Spherical k-means of the sample's directions, for each length of vectors."""
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = Cells({}, {})
    for length, vectors in by_length.items():
        raw = np.array(vectors, float)
        x = _unit(raw)
        count = max(1, min(cells, len(x) // 64))
        pick = np.random.default_rng(5)
        centroids = x[pick.choice(len(x), count, replace=False)]
        for _ in range(15):
            nearest = (x @ centroids.T).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, x)
            empty = np.bincount(nearest, minlength=count) == 0
            sums[empty] = x[pick.choice(len(x), int(empty.sum()))]
            centroids = _unit(sums + 1e-300)
        nearest = (x @ centroids.T).argmax(axis=1)
        out.centroids[length] = centroids
        out.probes[length] = _probes(raw, x, centroids, nearest, k, cover)
    return out


def _probes(raw, x, centroids, nearest, k: int, cover: float) -> int:
    """Cells to visit so that ``cover`` of the true neighbours of sampled queries are in them."""
    queries = np.arange(min(PROBE_QUERIES, len(x)))
    likeness = raw[queries] @ raw.T
    likeness[queries, queries] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1 or len(centroids) < 2:
        return len(centroids)
    true = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    rank = np.empty((len(queries), len(centroids)), np.int64)
    rank[queries[:, None], _ranked(x[queries] @ centroids.T)] = np.arange(len(centroids))
    needed = np.take_along_axis(rank, nearest[true], axis=1)
    return int(np.quantile(needed, cover, method="higher")) + 1


# --- Spark ----------------------------------------------------------------------


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Distinct (vec_id, vector) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("vector", lambda c: c != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & some)


def nodes_of(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, vector, ids) of distinct vectors with their ``k + 1`` smallest ids, and (vec_id, vector) of all rows."""
    rows = rows.distinct()
    least = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("place", least).where(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "ids"), rows


def _cell_of(cells: Cells, count: bool) -> Column:
    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(cells.nearest(vectors.to_pylist(), count), pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.col("vector"))


def build_index(
    rows: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, cover: float = 0.995,
    degree: int = DEGREE, beam: int = BEAM, relax: float = 1.2,
) -> tuple[DataFrame, Cells, DataFrame]:
    """(index, cells, rows): written (shard, cell, node, vector, ids, edges, entry); fitted cells; usable rows.

    ``edges`` hold the places of neighbours within the shard, in the order of ids and vector.
    """
    scratch = Scratch(rows.sparkSession)
    nodes, rows = nodes_of(usable(rows), k)
    nodes = scratch.keep(nodes, "nodes")
    total = nodes.count()
    sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    cells = fit_cells([r["vector"] for r in sample], min(CELLS, -(-total // shard_rows)), k, cover)
    dealt = nodes.withColumn("cell", F.get(_cell_of(cells, False), F.lit(0))).withColumn("length", F.size("vector"))
    dealt = scratch.keep(dealt, "dealt")
    sizes = dealt.groupBy("length", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    sizes = scratch.keep(sizes, "sizes")
    dealt = dealt.join(sizes, ["length", "cell"])
    part = F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int")
    dealt = dealt.select(F.struct("length", "cell", part.alias("part")).alias("shard"), "node", "vector", "ids")

    def grown(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        x = with_one_length(_matrix(table["vector"]))
        edges, entry = build_graph(x, degree, beam, relax)
        edges = pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32()))
        return table.append_column("edges", edges).append_column("entry", pa.array(np.full(len(x), entry, np.int32)))

    schema = f"shard {dealt.schema['shard'].dataType.simpleString()}, node long, vector array<double>, ids array<long>"
    index = dealt.groupBy("shard").applyInArrow(grown, f"{schema}, edges array<int>, entry int")
    return scratch.keep(index, "index"), cells, rows


def _in_order(table: pa.Table) -> pa.Table:
    """The nodes of a shard in one order, however they came."""
    least = np.array([i[0] for i in table["ids"].to_pylist()])
    return table.take(np.lexsort((*_matrix(table["vector"]).T[::-1], least)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(index: DataFrame, cells: Cells, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(node, vec_id, score) of the ``k + 1`` nearest found to each (node, vector) of ``queries``, itself included."""
    scratch = Scratch(index.sparkSession)
    wide = queries.select("node", "vector", F.size("vector").alias("length"), F.explode(_cell_of(cells, True)).alias("cell"))
    shards = index.select("shard").distinct().select("shard", F.col("shard.length").alias("length"), F.col("shard.cell").alias("cell"))
    wide = scratch.keep(wide.join(shards, ["length", "cell"]).select("shard", "node", "vector"), "sent")
    # queries of a shard in blocks, each beside the shard's graph
    blocks = wide.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    blocks = scratch.keep(blocks, "blocks")
    wide = wide.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    graph = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _searched(left, right, k, beam)

    graph = graph.select("shard", "block", "node", "vector", "ids", "edges", "entry").groupBy("shard", "block")
    wide = wide.select("shard", "block", "node", "vector").groupBy("shard", "block")
    found = graph.cogroup(wide).applyInArrow(run, "node long, vec_id long, score double")
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")


def _searched(graph: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    schema = pa.schema([("node", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(graph) or not len(queries):
        return schema.empty_table()
    graph = _in_order(graph)
    vectors = _matrix(graph["vector"])
    x = with_one_length(vectors)
    edges, entry = _matrix(graph["edges"]).astype(np.int64), int(graph["entry"][0].as_py())
    ids = graph["ids"].to_pylist()
    names, q = np.asarray(queries["node"]), _matrix(queries["vector"])
    # a query is searched as long as the shard's vectors, which changes no order
    size = np.sqrt(np.einsum("nd,nd->n", x, x).max()) / np.sqrt(np.einsum("nd,nd->n", q, q))
    scaled = np.concatenate([q * size[:, None], np.zeros((len(q), 1))], axis=1)
    parts = []
    for a in range(0, len(q), BATCH):
        found, _, _ = greedy_search(x, edges, scaled[a : a + BATCH], entry, max(beam, k + 1))
        row, at = np.nonzero(found >= 0)
        node = found[row, at]
        score = inner_products(q[a + row], vectors[node])
        # the best k + 1 nodes of each query hold its best k + 1 ids
        order = np.lexsort((np.array([ids[i][0] for i in node]), -score, row))
        row, node, score = row[order], node[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, node, score = (c[place <= k] for c in (row, node, score))
        counts = np.array([len(ids[i]) for i in node])
        parts.append(pa.table({
            "node": np.repeat(names[a + row], counts),
            "vec_id": np.array([i for n in node for i in ids[n]], np.int64),
            "score": np.repeat(score, counts),
        }))
    return pa.concat_tables(parts).cast(schema)


def nearest_neighbours(rows: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    index, cells, usable_rows = build_index(rows, k, **options)
    scratch = Scratch(rows.sparkSession)
    asked = usable_rows.where(F.col("vec_id") % every == 0)
    # one search for each distinct vector
    nodes = index.select("node", "vector")
    asked = scratch.keep(asked.join(nodes, "vector").select("vec_id", "node", "vector"), "asked")
    distinct = asked.select("node").distinct().join(nodes, "node")
    found = scratch.keep(search(index, cells, distinct, k), "found")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "node").join(found, "node")
    pairs = pairs.where(F.col("vec_id") != F.col("query_id"))
    place = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")

