"""Approximate nearest neighbours by cosine over robust-pruned directed graphs.

Rows are dealt by a hash of their ids to shards of a bounded number of rows, so that equal or very common vectors do not share
a task by their value. Inside a shard equal vectors are one node with the ids of all their rows. Nodes enter the graph in
batches, in an order that a hash of the vector fixes: a greedy beam search over the graph so far proposes neighbours, and the
relaxed pruning rule keeps the nearest proposal and drops those that lie ``alpha`` times nearer to it than to the node, again
and again, so that edges stay few and diverse. A node whose edges of both directions grow beyond the slack is pruned anew. A
second pass proposes again for every node over the whole graph. The graphs are stored, one row per shard; every query runs a
beam search in each shard, the nodes of its beam are scored exactly, and the best rows of all shards are merged.

The index holds every row; what a query can miss is a row whose node no beam reached. Distances inside the graph are of unit vectors in single precision; the returned score is
the cosine of the original vectors in double precision. Vectors that are null, zero or hold a null or non-finite component
take no part; shorter ones count as padded with zeros. Null ids take no part. Equal scores go to the smaller id. Repeated ids
are separate candidates, but no row with the query's own id; each of several query rows under one id has its own list, told
apart by ``query_row``. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.ball_codes import matrix, usable
from frameloom.llm.staging import stage
from frameloom.llm.textbytes import mix

SHARD_ROWS = 8192
QUERY_ROWS = 4096
DEGREE = 32
SLACK = 16
BEAM = 64
ALPHA = 1.15
BATCH = 256
#: New edges into one node that are weighed at once, the nearest first.
PROPOSED = 64


class Graph(NamedTuple):
    vectors: np.ndarray  # nodes x components, doubles
    edges: np.ndarray  # nodes x (degree + slack), -1 where there is none
    entry: int


def scaled(values: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square overflows or vanishes; cosines stay the same."""
    _, power = np.frexp(np.abs(values).max(axis=1, initial=0.0))
    return np.ldexp(values, -power[:, None])


def units(values: np.ndarray) -> np.ndarray:
    return (values / np.sqrt((values * values).sum(axis=1))[:, None]).astype(np.float32)


def beam_search(vectors: np.ndarray, edges: np.ndarray, entry: int, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest nodes found for every asked vector, nearest first, their distances, and the nodes that were expanded.

    Vectors are unit vectors and distances squared; places without a node are -1 and infinite.
    """
    n, rows = len(asked), np.arange(len(asked))
    seen = np.zeros((n, len(vectors)), dtype=bool)
    seen[:, entry] = True
    nodes, far = np.full((n, beam), -1), np.full((n, beam), np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    nodes[:, 0], far[:, 0], done[:, 0] = entry, 2 - 2 * (asked @ vectors[entry]), False
    path = []
    while True:
        rows = rows[~done[rows].all(axis=1)]
        if not len(rows):
            break
        spot = (~done[rows]).argmax(axis=1)
        at = nodes[rows, spot]
        done[rows, spot] = True
        step = np.full(n, -1)
        step[rows] = at
        path.append(step)
        near = edges[at]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        who, col = np.nonzero(fresh)
        new = near[who, col]
        seen[rows[who], new] = True
        square = np.full(near.shape, np.inf, dtype=np.float32)
        square[who, col] = 2 - 2 * np.einsum("ij,ij->i", vectors[new], asked[rows[who]])
        all_far = np.concatenate([far[rows], square], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, axis=1), axis=1, kind="stable"), axis=1)
        far[rows] = np.take_along_axis(all_far, best, axis=1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], np.where(fresh, near, -1)], axis=1), best, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], axis=1), best, axis=1)
    return nodes, far, np.stack(path, axis=1) if path else np.zeros((n, 0), dtype=np.int64)


def prune(vectors: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node of ``own`` among the proposed nodes (-1: none), nearest first."""
    proposed = np.where(proposed == own[:, None], -1, proposed)
    proposed = np.sort(proposed, axis=1)  # equal proposals stand together
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    far = 2 - 2 * np.einsum("ijk,ik->ij", vectors[proposed], vectors[own])
    far[proposed < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    proposed, far = np.take_along_axis(proposed, order, axis=1), np.take_along_axis(far, order, axis=1)
    held = vectors[proposed]
    between = 2 - 2 * (held @ held.transpose(0, 2, 1))
    alive, out = proposed >= 0, np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for slot in range(degree):
        rows = rows[alive[rows].any(axis=1)]
        if not len(rows):
            break
        pick = alive[rows].argmax(axis=1)
        out[rows, slot] = proposed[rows, pick]
        alive[rows] &= alpha * alpha * between[rows, pick] > far[rows]
        alive[rows, pick] = False
    return out


def _add_back(vectors: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back from the neighbours of the ``new`` nodes; a node with too many is pruned."""
    width = edges.shape[1]
    col = np.argwhere(edges[new] >= 0)
    source, target = new[col[:, 0]], edges[new[col[:, 0]], col[:, 1]]
    apart = 1 - np.einsum("ij,ij->i", vectors[source], vectors[target])
    order = np.lexsort((apart, target))
    source, target = source[order], target[order]
    nodes, head, many = np.unique(target, return_index=True, return_counts=True)
    slot = np.arange(len(target)) - np.repeat(head, many)
    keep = slot < PROPOSED
    proposed = np.full((len(nodes), PROPOSED), -1)
    proposed[np.repeat(np.arange(len(nodes)), many)[keep], slot[keep]] = source[keep]
    proposed[(proposed[:, :, None] == edges[nodes][:, None, :]).any(axis=2)] = -1
    free = np.sort(np.concatenate([edges[nodes], proposed], axis=1), axis=1)[:, ::-1]  # nodes first, -1 last
    size = (free >= 0).sum(axis=1)
    roomy = size <= width
    edges[nodes[roomy]] = free[roomy, :width]
    full = np.flatnonzero(~roomy)
    for at in range(0, len(full), BATCH):
        part = full[at: at + BATCH]
        cut = int(size[part].max())
        edges[nodes[part]] = -1
        edges[nodes[part], :degree] = prune(vectors, nodes[part], free[part, :cut], degree, alpha)


def build_graph(values: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
    """Graph over the rows of ``values``, which are distinct."""
    vectors = units(scaled(values))
    n = len(vectors)
    edges = np.full((n, degree + SLACK), -1)
    entry = int((vectors @ vectors.mean(axis=0)).argmax())
    # the entry first, the others in an order without meaning
    key = mix(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    order = np.concatenate([[entry], order[order != entry]])
    for turn in range(2):
        at = 1 if turn == 0 else 0
        while at < n:
            new = order[at: at + min(at or BATCH, BATCH)]
            nodes, _, path = beam_search(vectors, edges, entry, vectors[new], beam)
            proposed = np.concatenate([nodes, path, edges[new]] if turn else [nodes, path], axis=1)
            edges[new] = -1
            edges[new, :degree] = prune(vectors, new, proposed, degree, alpha)
            _add_back(vectors, edges, new, degree, alpha)
            at += len(new)
    return Graph(values, edges, entry)


def _ready(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.where(usable(vector) & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
    return rows.where(F.exists("v", lambda x: x != 0))


def _blobs(df: DataFrame, group: str, pieces: int, key: str, width: int) -> DataFrame:
    """One row per group: its keys and vectors. A hash of the row's key deals them, so a group has about as many as asked for."""

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.tobytes() for r in matrix(b.column(2), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=[group, "key", "v"])

    keyed = df.select(F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int").alias(group), F.col(key).alias("key"), "v")
    key_type = dict(keyed.dtypes)["key"]
    packed = keyed.mapInArrow(blob, f"{group} int, key {key_type}, v binary")
    return packed.repartition(pieces, group).groupBy(group).agg(F.collect_list(F.struct("key", "v")).alias(f"{group}_rows"))


def _vectors(rows: pa.ListScalar, width: int) -> tuple[pa.Array, np.ndarray]:
    values = rows.values
    return values.field(0), np.frombuffer(b"".join(values.field(1).to_pylist()), np.float64).reshape(len(values), width)


def index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM,
          alpha: float = ALPHA) -> DataFrame:
    """Stored graphs, one row per shard: shard, width, ids and many (ids per node), vectors, edges, entry."""
    ready = stage(_ready(rows, vec_id, vector), "vectors")
    n, width = ready.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, values = _vectors(batch.column(1)[i], width)
                ids = keys.to_numpy()
                values = values + 0.0  # no negative zeros
                order = np.lexsort((ids, *values.T[::-1]))
                ids, values = ids[order], values[order]
                head = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(axis=1)]))
                graph = build_graph(values[head], degree, beam, alpha)
                many = np.diff([*head, len(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i: i + 1], pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([many], pa.list_(pa.int32())),
                     pa.array([graph.vectors.tobytes()], pa.binary()), pa.array([graph.edges.astype(np.int32).tobytes()], pa.binary()), pa.array([graph.entry], pa.int32())],
                    names=["shard", "width", "ids", "many", "vectors", "edges", "entry"])

    shards = _blobs(ready, "shard", max(1, -(-n // shard_rows)), "id", width)
    return stage(shards.mapInArrow(build, "shard int, width int, ids array<long>, many array<int>, vectors binary, edges binary, entry int"), "graphs")


class Shard:
    """A stored graph, ready for queries."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, graph: Graph):
        self.ids, self.graph = ids, graph
        self.ends = np.cumsum(many)
        self.starts = self.ends - many
        self.scaled = scaled(graph.vectors)
        self.units = units(self.scaled)

    def search(self, own: np.ndarray, asked: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query's place, id, score) of the k best rows found for every query."""
        wide = scaled(asked)
        nodes, _, _ = beam_search(self.units, self.graph.edges, self.graph.entry, units(wide), max(beam, k + 1))
        found = nodes >= 0
        a, b = wide[np.nonzero(found)[0]], self.scaled[nodes[found]]
        score = np.full(nodes.shape, -np.inf)
        score[found] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        least = self.ids[self.starts[nodes]]
        for q in range(len(own)):
            rows, filled = [], 0
            for spot in np.lexsort((least[q], -score[q])):
                if filled >= k or not found[q, spot]:
                    break  # a node has a row at least, so k nodes have the k best
                node = nodes[q, spot]
                ids = self.ids[self.starts[node]: self.ends[node]]
                at = np.searchsorted(ids, own[q], side="left"), np.searchsorted(ids, own[q], side="right")
                ids = np.concatenate([ids[: min(k, at[0])], ids[at[1]: at[1] + k]])[:k]
                rows.extend((-score[q, spot], int(i)) for i in ids)
                filled += len(ids) > 0
            yield from ((q, i, float(-s)) for s, i in sorted(rows)[:k])


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS,
           beam: int = BEAM) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: the ``k`` rows nearest to each query by cosine, as far as the beams found them."""
    asked = _ready(queries, vec_id, vector).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.struct("row", "id"))
    asked = stage(asked.select("key", "v"), "queries")
    m, q_width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    shards, width = graphs.agg(F.count("*"), F.max("width")).first()
    wide, blocks = max(width or 0, q_width or 0), max(1, -(-m // query_rows))
    dealt = _blobs(asked, "block", blocks, "key", wide).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(1, shards) - 1))))
    every = max(1, shards)
    met = graphs.repartition(every, "shard").join(dealt.repartition(every, "shard"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                now = b.column(0)[i].as_py()
                if now != held:
                    own = b.column(1)[i].as_py()
                    ids, many = (b.column(c)[i].values.to_numpy() for c in (2, 3))
                    vectors = np.frombuffer(b.column(4)[i].as_py(), np.float64).reshape(-1, own)
                    vectors = np.pad(vectors, ((0, 0), (0, wide - own)))
                    edges = np.frombuffer(b.column(5)[i].as_py(), np.int32).reshape(len(vectors), -1).astype(np.int64)
                    shard, held = Shard(ids, many, Graph(vectors, edges, b.column(6)[i].as_py())), now
                keys, values = _vectors(b.column(7)[i], wide)
                row, own_ids = keys.field(0).to_numpy(), keys.field(1).to_numpy()
                for at in range(0, len(row), BATCH):
                    part = slice(at, at + BATCH)
                    found = list(shard.search(own_ids[part], values[part], k, beam))
                    place = np.array([f[0] for f in found], dtype=np.int64) + at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[place]), pa.array(own_ids[place]), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                        names=["query_row", "query_id", "vec_id", "score"])

    best = met.select("shard", "width", "ids", "many", "vectors", "edges", "entry", "block_rows").mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
