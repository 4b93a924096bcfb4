"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances: every vector gets one more component that brings all to the same length (0 for a query),
so the nearest vectors are those with the highest products. Pivots come from a bounded sample. The vectors are dealt by a
hash of their ids and rows to shards of a bounded number of rows; inside a shard they are keyed and sorted by nearest pivot and
distance from it, and cut into annuli. The triangle inequality gives a lower bound on the distance of every annulus from a
query. Queries are searched in blocks: each first takes the annuli of its best bounds, then all others whose bound is not beyond
its k-th best so far, one matrix product for all queries of the block that need an annulus.

A task holds a group of shards, and the blocks of one lane of queries pass through it; the k best go on from shard to shard. Groups
and lanes have a bounded number of shards and blocks, and their rows are dealt by number: there is no join whose side could
be broadcast. The best of all groups are merged. Every row is in the index and every query meets every group, so results are exact, and equal
or very common vectors do not share a task by their value.

Components are floor(64 * x) as integers. Products are exact: single or double precision where all sums stay below 2**24 or 2**53,
Python integers beyond, limited to the range of a long. Vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros. Equal scores go to the smaller id. Repeated ids are separate candidates, but no row with
the query's own id; every query row has its own list, also where rows or ids are repeated. Null ids take no part. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.staging import stage

SHARD_ROWS = 8192
QUERY_ROWS = 512
SAMPLE = 2048
PIVOTS = 48
ANNULUS = 48
#: Annuli that a query takes before it has k rows.
FIRST = 4
#: Queries whose scores, Python integers, are held at once.
BIG = 16
#: A task holds at most so many shards, and so many blocks of queries pass through it.
GROUP, LANE = 32, 256


def quantised(vector: str) -> Column:
    """floor(64 * x) of each component; null if the vector takes no part."""
    v = F.col(f"`{vector}`")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x.cast("double") * 64)))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


class Best:
    """The k best rows so far of every query of a block, ties to smaller ids; ``floor`` is the k-th score."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.who, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.floor, self.full = np.full(n, -np.inf), np.zeros(n, bool)
        self.found, self.waiting = [], 0

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries ``who``, merged once there are some for each."""
        self.found.append((who, scores.astype(np.int64), ids))
        self.waiting += len(who)
        if self.waiting > 2 * self.k * self.n:
            self.merge()

    def merge(self) -> None:
        who, scores, ids = (np.concatenate(x) for x in zip((self.who, self.scores, self.ids), *self.found, strict=True))
        order = np.lexsort((ids, ~scores, who))  # ~: descending, without overflow
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, np.arange(self.n))[who]
        last = place == self.k - 1
        self.full[who[last]] = True
        self.floor[who[last]] = scores[order[last]]
        kept = place < self.k
        self.who, self.scores, self.ids = who[kept], scores[order[kept]], ids[order[kept]]
        self.found, self.waiting = [], 0


class Shard:
    """Vectors sorted by nearest pivot and distance from it, cut into annuli."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, norm: float, kind: type):
        exact = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(norm - (exact**2).sum(axis=1), 0))
        lifted = np.concatenate([exact, lift[:, None]], axis=1)
        square = (lifted**2).sum(axis=1)[:, None] - 2 * lifted @ pivots.T + (pivots**2).sum(axis=1)
        near = square.argmin(axis=1)
        far = np.sqrt(np.maximum(square[np.arange(len(near)), near], 0))
        order = np.lexsort((ids, far, near))
        self.ids, self.vectors = ids[order], vectors[order].astype(kind)
        near, far = near[order], far[order]
        edge = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        starts = np.unique(np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(edge, [*edge[1:], len(near)], strict=True)]))
        self.starts, self.stops = starts, np.concatenate([starts[1:], [len(near)]]).astype(np.int64)
        self.pivot, self.inner, self.outer = near[starts], far[starts], far[self.stops - 1]
        self.cells = np.searchsorted(starts, edge)  # first annulus of every pivot
        self.pivots, self.norm, self.kind = pivots, norm, kind
        self.compared = 0

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each annulus."""
        exact = queries.astype(np.float64)
        size = (exact**2).sum(axis=1)[:, None]
        to_pivot = np.sqrt(np.maximum(size - 2 * exact @ self.pivots[:, :-1].T + (self.pivots**2).sum(axis=1), 0))[:, self.pivot]
        bound = np.maximum(np.maximum(to_pivot - self.outer, self.inner - to_pivot), 0)
        # as a score: distance^2 = size + norm - 2 * product; a little room for rounding
        return np.maximum((size + self.norm - bound**2) / 2 + 1e-6 * (size + self.norm) + 1e-6, -(2.0**63))

    def search(self, own: np.ndarray, queries: np.ndarray, best: Best) -> None:
        """Improve ``best`` by the rows here whose id is not the query's own."""
        asked, reach = queries.astype(self.kind), self.reach(queries)
        taken = np.zeros(reach.shape, bool)
        if len(new := np.flatnonzero(~best.full)):
            first = np.argsort(-reach[new], axis=1, kind="stable")[:, :FIRST]
            taken[new[:, None], first] = True
            for ring in np.unique(first):
                self._compare(own, asked, best, np.flatnonzero(taken[:, ring]), ring, ring + 1)
            best.merge()
        for cell in np.argsort(-np.maximum.reduceat(reach, self.cells, axis=1).mean(axis=0), kind="stable"):
            a, b = self.cells[cell], self.cells[cell + 1] if cell + 1 < len(self.cells) else len(self.starts)
            need = (reach[:, a:b] >= best.floor[:, None]) & ~taken[:, a:b]
            rings, who = np.flatnonzero(need.any(axis=0)), np.flatnonzero(need.any(axis=1))
            if len(rings):
                self._compare(own, asked, best, who, a + rings[0], a + rings[-1] + 1, taken)
        best.merge()

    def _compare(self, own: np.ndarray, asked: np.ndarray, best: Best, who: np.ndarray, a: int, b: int, taken: np.ndarray | None = None) -> None:
        """Scores of the queries ``who`` against the annuli from ``a`` to before ``b``, but those they have taken."""
        if self.kind is object and len(who) > BIG:
            for at in range(0, len(who), BIG):
                self._compare(own, asked, best, who[at: at + BIG], a, b, taken)
            return
        rows = slice(self.starts[a], self.stops[b - 1])
        scores = asked[who] @ self.vectors[rows].T
        if self.kind is object:
            scores = _limited(scores)
        self.compared += scores.size
        at = np.flatnonzero(scores >= best.floor[who].astype(np.float32 if self.kind is np.float32 else np.float64)[:, None])
        query, row = who[at // scores.shape[1]], at % scores.shape[1] + rows.start
        good = self.ids[row] != own[query]
        if taken is not None:
            good &= ~taken[query, np.searchsorted(self.starts, row, side="right") - 1]
        best.add(query[good], scores.ravel()[at[good]], self.ids[row[good]])


def _limited(scores: np.ndarray) -> np.ndarray:
    """Python integers, held in the range of a long."""
    return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores.ravel()], dtype=np.int64).reshape(scores.shape)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def tiles(shards: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Groups of shards and lanes of query blocks: about ``tasks`` pairs of them, more where a task would hold too many."""
    groups = min(shards, max(-(-shards // GROUP), math.isqrt(2 * tasks)))
    return groups, min(blocks, max(-(-blocks // LANE), -(-tasks // groups)))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS,
           query_rows: int = QUERY_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the highest inner product with each query."""

    def ready(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), quantised(vector).alias("v")).where("id is not null and v is not null")
        return kept.withColumn("row", F.monotonically_increasing_id())

    table, asked = stage(ready(rows), "vectors"), stage(ready(queries), "queries")
    greatest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = [F.count("*"), F.max(F.size("v")), F.max(greatest), F.max(square)]
    n, width, most, norm = table.agg(*facts).first()
    m, q_width, q_most, _ = asked.agg(*facts).first()
    width, most, q_most, norm = max(width or 0, q_width or 0), most or 0.0, q_most or 0.0, norm or 0.0
    sums = most * q_most * max(width, 1)
    kind = np.float32 if max(sums, most, q_most) < 2**24 else np.float64 if max(sums, most) < 2**53 else object
    stored = next((t for t in (np.int8, np.int16, np.int32) if max(most, q_most) <= np.iinfo(t).max), np.int64)
    # by row, too: one id may have many
    part = F.pmod(F.xxhash64("id", "row", F.lit("pivot")), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    sample = _matrix(table.where(part).select("v").toArrow().column("v").combine_chunks(), width).astype(np.float64)  # about SAMPLE rows
    lift = np.sqrt(np.maximum(norm - (sample**2).sum(axis=1), 0))
    chosen = choose_pivots(np.concatenate([sample, lift[:, None]], axis=1), pivots)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    groups, lanes = tiles(shards, blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bytes_ = pa.py_buffer(_matrix(b.column(2), width).astype(stored).tobytes())
            ends = pa.py_buffer((np.arange(b.num_rows + 1) * width * np.dtype(stored).itemsize).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, bytes_]), b.column(3)], names=["piece", "id", "v", "row"])

    def dealt(df: DataFrame, piece: Column) -> DataFrame:
        return df.select(piece.cast("int").alias("piece"), "id", "v", "row").mapInArrow(packed, "piece int, id long, v binary, row long")

    # hashes deal the rows, so a shard or a lane has about as many as asked for; queries come after the shards
    left = dealt(table, F.pmod(F.xxhash64("id", "row"), F.lit(shards)))
    left = left.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("group", F.col("piece") % groups)
    right = dealt(asked, F.lit(shards))
    right = right.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = left.unionByName(right).select((F.col("lane") * groups + F.col("group")).alias("tile"), "piece", "id", "v", "row")
    met = met.repartitionById(groups * lanes, "tile").select("piece", "id", "v", "row").sortWithinPartitions("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_piece, parts = [], None, []

        def close() -> None:
            if parts:
                held.append(Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), chosen, norm, kind))
                parts.clear()

        for b in batches:
            piece, ids, row = (b.column(i).to_numpy() for i in (0, 1, 3))
            vectors = np.frombuffer(b"".join(b.column(2).to_pylist()), stored).reshape(len(ids), width)
            edge = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else []
            for a, z in zip(edge, [*edge[1:], len(piece)], strict=True):
                if piece[a] != open_piece:
                    close()
                    open_piece = piece[a]
                if open_piece < shards:
                    parts.append((ids[a:z], vectors[a:z]))
                    continue
                for at in range(a, z, query_rows):
                    part = slice(at, min(at + query_rows, z))
                    best = Best(part.stop - at, k)
                    for shard in held:
                        shard.search(ids[part], vectors[part], best)
                    cols = [row[part][best.who], ids[part][best.who], best.ids, best.scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
