"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, merged (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Distinct vectors a graph holds on average.
SHARD_ROWS = 12_288
#: Queries that meet a graph in one task.
QUERY_ROWS = 16_384
M, M0 = 16, 32
EF_BUILD, EF_SEARCH = 64, 160
BATCH = 512
EXPAND = 4


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all norms are equal and the largest inner product is the nearest point."""
    norm2 = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(norm2.max(initial=0) - norm2, 0))[:, None].astype(np.float32)], 1).astype(np.float32)


def beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in step: (ids, similarities), best first, -1 where there are none.

    links: a row of neighbour ids for each node, -1 for no more. entries: start nodes for each query.
    """
    n = len(q)
    seen = np.zeros((n, len(v) + 1), bool)
    seen[:, -1] = True
    rows = np.arange(n)[:, None]
    entries = np.where(entries < 0, len(v), entries)
    entries = np.sort(entries, 1)
    entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = len(v)
    ids = np.full((n, ef), -1)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)

    def offer(at: np.ndarray, new: np.ndarray) -> None:
        fresh = ~seen[at[:, None], new]
        seen[at[:, None], new] = True
        s = np.full(new.shape, -np.inf, np.float32)
        i, j = np.nonzero(fresh)
        s[i, j] = np.einsum("nd,nd->n", v[new[i, j]], q[at[i]])
        all_s = np.concatenate([sims[at], s], 1)
        all_i = np.concatenate([ids[at], np.where(fresh, new, -1)], 1)
        all_d = np.concatenate([done[at], ~fresh], 1)
        top = np.argsort(-all_s, 1, kind="stable")[:, :ef]
        r = np.arange(len(at))[:, None]
        ids[at], sims[at], done[at] = all_i[r, top], all_s[r, top], all_d[r, top]

    offer(np.arange(n), entries)
    while True:
        open_ = ~done
        at = np.flatnonzero(open_.any(1))
        if not len(at):
            return ids, sims
        pick = open_[at] & (np.cumsum(open_[at], 1) <= EXPAND)
        order = np.argsort(~pick, 1, kind="stable")[:, :EXPAND]
        r = np.arange(len(at))[:, None]
        real = pick[r, order]
        nodes = np.where(real, ids[at][r, order], -1)
        done[at] |= pick
        new = np.where(real[:, :, None], links[nodes], -1).reshape(len(at), -1)
        new = np.sort(np.where(new < 0, len(v), new), 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = len(v)
        offer(at, new)


def diverse(v: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to m of which none is nearer to a chosen one than to the row's node."""
    b, c = cand.shape
    x = v[cand]
    between = np.einsum("bid,bjd->bij", x, x)
    kept = np.zeros((b, c), bool)
    near = np.full((b, c), -np.inf, np.float32)
    for k in range(c):
        ok = (cand[:, k] >= 0) & (near[:, k] < sims[:, k]) & (kept.sum(1) < m)
        kept[:, k] = ok
        near = np.where(ok[:, None], np.maximum(near, between[:, k]), near)
    # Room that is left goes to the nearest others.
    rank = np.where(kept, 0, np.where(cand >= 0, 1, 2))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    r = np.arange(b)[:, None]
    out = np.where(rank[r, order] < 2, cand[r, order], -1)
    return np.pad(out, ((0, 0), (0, max(0, m - out.shape[1]))), constant_values=-1)


def top_of(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, 1, kind="stable")[:, :k]
    r = np.arange(len(ids))[:, None]
    return np.where(np.isfinite(sims[r, order]), ids[r, order], -1), sims[r, order]


def connect(v: np.ndarray, links: np.ndarray, new: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> None:
    """Link new nodes to chosen candidates, and those back, pruning full rows by the same rule."""
    links[new] = diverse(v, cand, sims, m)
    dst = links[new].ravel()
    src = np.repeat(new, m)[dst >= 0]
    dst = dst[dst >= 0]
    order = np.lexsort((src, dst))
    dst, src = dst[order], src[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    for width in (m, 4 * m, 1 << 30):  # few nodes get many links at once: no wide matrix for all
        some = np.flatnonzero((count <= width) & (count > (0 if width == m else width // 4 if width == 4 * m else 4 * m)))
        for at in np.array_split(some, max(1, len(some) // 512)):
            if not len(at):
                continue
            extra = np.full((len(at), int(count[at].max())), -1)
            where = np.arange(extra.shape[1])[None, :] < count[at][:, None]
            extra[where] = src[np.concatenate([np.arange(f, f + c) for f, c in zip(first[at], count[at])])]
            own = np.sort(np.concatenate([links[nodes[at]], extra], 1), 1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
            s = np.where(own >= 0, np.einsum("bcd,bd->bc", v[own], v[nodes[at]]), -np.inf).astype(np.float32)
            own, s = top_of(own, s, 4 * m)
            links[nodes[at]] = diverse(v, own, s, m)


class Graph:
    """Flat neighbour arrays: layer 0 over all vectors, each upper layer over the nodes drawn into it."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray] | None = None, links: list[np.ndarray] | None = None):
        self.vectors, self.lifted = vectors, lifted(vectors)
        if links is not None:
            self.members, self.links = members, links
            return
        n = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(n).random(n)) / np.log(M)).astype(int)
        self.members, self.links = [np.arange(n)], [np.full((n, M0), -1, np.int32)]
        for top in range(1, int(level.max(initial=0)) + 1):
            inside = np.flatnonzero(level >= top)
            if len(inside) < 2:
                break
            self.members.append(inside)
            self.links.append(np.full((len(inside), M), -1, np.int32))
        for layer in range(len(self.members) - 1, -1, -1):
            self._build(layer)

    def _build(self, layer: int) -> None:
        v, links = self.lifted[self.members[layer]], self.links[layer]
        m, n, at = links.shape[1], len(v), 0
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, max(64, at))))
            among = v[new] @ v[new].T
            np.fill_diagonal(among, -np.inf)
            ids, sims = np.broadcast_to(new, among.shape), among
            if at:
                found, s = beam(v[:at], links[:at], v[new], self._entries(layer, v[new], at), EF_BUILD)
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([s, among], 1)
            connect(v, links, new, *top_of(ids, sims.astype(np.float32), EF_BUILD), m)
            at = int(new[-1]) + 1

    def _entries(self, layer: int, q: np.ndarray, limit: int) -> np.ndarray:
        """Start nodes in a layer (as places in it, below limit) from a search of the layers above it."""
        best = None
        for up in range(len(self.members) - 1, layer, -1):
            v = self.lifted[self.members[up]]
            start = np.zeros((len(q), 1), int) if best is None else np.searchsorted(self.members[up], best)
            found, _ = beam(v, self.links[up], q, start, 8)
            best = np.where(found >= 0, self.members[up][found], self.members[up][0])[:, :4]
        if best is None:
            return np.zeros((len(q), 1), int)
        place = np.searchsorted(self.members[layer], best)
        return np.where(place < limit, place, 0)

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Ids of up to k vectors of large inner product with each query, -1 where there are fewer."""
        out = np.full((len(q), k), -1)
        n = len(self.vectors)
        for a in range(0, len(q), BATCH):
            x = np.pad(q[a : a + BATCH].astype(np.float32), ((0, 0), (0, 1)))
            start = np.tile(np.arange(n), (len(x), 1)) if n <= ef else self._entries(0, x, n)
            ids, _ = beam(self.lifted, self.links[0], x, start, max(ef, k))
            out[a : a + BATCH, : min(k, ids.shape[1])] = ids[:, :k]
        return out

    def blob(self) -> list[bytes]:
        size = np.array([*self.vectors.shape, len(self.members), *map(len, self.members)], np.int64)
        return [size.tobytes(), self.vectors.astype(np.float32).tobytes(), b"".join(x.astype(np.int32).tobytes() for x in self.members), b"".join(x.tobytes() for x in self.links)]

    @staticmethod
    def read(blob: list[bytes]) -> Graph:
        n, d, layers, *sizes = np.frombuffer(blob[0], np.int64).tolist()
        members, links, flat, rows, a, b = [], [], np.frombuffer(blob[2], np.int32), np.frombuffer(blob[3], np.int32), 0, 0
        for k, size in enumerate(sizes):
            m = M if k else M0
            members.append(flat[a : a + size].astype(np.int64))
            links.append(rows[b : b + size * m].reshape(size, m))
            a, b = a + size, b + size * m
        return Graph(np.frombuffer(blob[1], np.float32).reshape(n, d), members, links)


def usable(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)"
    )


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, shard, ids (array of arrays), g0..g3 (the graph): every usable vector, equal vectors as one node with its
    k + 1 smallest ids (no answer of k can use more)."""
    of_vector = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = usable(rows).distinct().withColumn("rn", F.row_number().over(of_vector)).where(F.col("rn") <= k + 1)
    nodes = materialize(nodes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))

    def build(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        v = np.asarray(t.column("embedding").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        ids = t.column("ids").combine_chunks()
        order = np.lexsort(v.T)  # shuffled rows come in any order; the graph must not depend on it
        order = order[np.random.default_rng(len(v)).permutation(len(v))]
        g = Graph(np.ascontiguousarray(v[order])).blob()
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": t.column("shard").slice(0, 1), "ids": pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))), **{f"g{i}": pa.array([x], pa.binary()) for i, x in enumerate(g)}})

    built = nodes.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids array<array<long>>, g0 binary, g1 binary, g2 binary, g3 binary")
    return materialize(built, "index")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k rows of largest inner product.

    Shards hold about shard_rows distinct vectors each, by a hash of the vector; each is one graph stored as flat
    arrays. Queries are dealt in blocks of about query_rows; a task takes one block and one graph, so its memory is
    bounded; the shards' best k are merged. Scores are inner products of the original vectors in double precision, ties go to the
    smaller id, a query's own id is no answer. Null, zero and non-finite vectors (or with null components) take no part
    on either side, nor do ids that are null; a vector meets only those of its own dimension; repeated (id, vector)
    rows count once; query rows of one id but different vectors are one query with the best of their answers; no rows
    give no rows; extra columns are ignored.
    """
    index = build_index(rows, k, shard_rows)
    asked = materialize(usable(queries).distinct().withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    places = asked.select("dim", "block").distinct().join(index.select("dim", "shard"), "dim")  # one row a graph and block
    left = index.join(places.select("dim", "shard", "block"), ["dim", "shard"])
    right = asked.join(places, ["dim", "block"]).select("dim", "shard", "block", "vec_id", "embedding")

    def ask(graph: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if graph.num_rows and block.num_rows:
            g = Graph.read([graph.column(f"g{i}")[0].as_py() for i in range(4)])
            ids = graph.column("ids").combine_chunks().flatten()
            off, flat = np.asarray(ids.offsets) - ids.offsets[0].as_py(), np.asarray(ids.flatten())
            own = block.column("vec_id").to_numpy()
            q = np.asarray(block.column("embedding").combine_chunks().flatten(), np.float32).reshape(len(own), -1)
            found = g.search(q, k + 1, ef)
            wide = q.astype(np.float64)
            for i in range(len(own)):
                at = found[i][found[i] >= 0]
                score = g.vectors[at].astype(np.float64) @ wide[i]
                vec = flat[np.concatenate([np.arange(off[j], off[j + 1]) for j in at])]
                score = np.repeat(score, (off[at + 1] - off[at]))
                keep = vec != own[i]
                vec, score = vec[keep], score[keep]
                top = np.lexsort((vec, -score))[:k]
                out["query_id"] += [own[i]] * len(top)
                out["vec_id"] += vec[top].tolist()
                out["score"] += score[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    key = ["dim", "shard", "block"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from places: told apart for the cogroup
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(ask, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
