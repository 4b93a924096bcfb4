"""Vector codes: product parts coded by ball k-means.

Components become integers, floor(scale * x), and a vector is cut into equal consecutive parts; each part position has a
codebook. The members of an entry form a ball around it. With the ball's radius r, only entries within 2 r of its own can be
nearer to any member: these are its neighbours. A member at distance d is in the stable core if no neighbour lies within
2 d; else it stands in an annular ring, and only the neighbours within 2 d are its candidates, compared exactly. Balls are
taken per batch of rows, so no pass is needed for radii. All comparisons are of exact integers, doubles below 2**53 and Python
integers beyond; equal distances go to the lower index. A round writes the rows with their codes; sums and counts of every
entry are added up by Spark, and only the codebooks (parts x entries) reach the driver and are broadcast.

Rows whose vector is null or holds a null or non-finite component are dropped. Vectors of unequal length count as padded with
zeros to a common multiple of the parts; components are held to the range of a long, and so are errors. First entries are the
rows of the smallest ids, of one id those with the smaller vector first, rows without an id after all others; with fewer rows
than entries the codebook has as many entries as rows. Repeated rows are coded one by one. An empty table gives an empty
result, and further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.llm.staging import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Neighbours are compared so many at a time, nearest first.
RING = 32
#: A label with more than this share of the rows is looked up by broadcast, of which there are fewer than 1,000.
HEAVY = 1000
_LONG = 2.0**63


def usable(vector: str):
    """Neither null nor with a null or non-finite component."""
    v = F.col(f"`{vector}`")
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.asarray(column.value_lengths())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in the range of a long, still as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -_LONG, _LONG - 1024)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, ties to the lower index, and its squared distance."""
    square = distances(x, centres)
    code = square.argmin(axis=1)
    return code, square[np.arange(len(x)), code]


class Balls:
    """Codebook of one part position with every entry's others, sorted by distance."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        apart = distances(centres, centres)
        self.others, self.apart = [], []
        for i in range(len(centres)):
            rest = np.delete(np.arange(len(centres)), i)
            rest = rest[np.argsort(apart[i, rest], kind="stable")]
            self.others.append(rest)
            self.apart.append(apart[i, rest])
        self.compared = 0

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codes and squared distances of rows that now have ``code``."""
        code = code.astype(np.int64)
        own = ((x - self.centres[code]) ** 2).sum(axis=1)
        best, near = own.copy(), code.copy()
        order = np.argsort(code, kind="stable")
        edges = np.flatnonzero(np.diff(code[order])) + 1
        for rows in np.split(order, edges) if len(order) else []:
            entry = code[rows[0]]
            radius = own[rows].max()
            n = int(np.searchsorted(self.apart[entry], 4 * radius, side="right"))
            if not n:
                continue  # a ball without neighbours
            ring = np.searchsorted(self.apart[entry][:n], 4 * own[rows], side="right")
            rows, ring = rows[ring > 0], ring[ring > 0]  # the stable core stays
            for at in range(0, n, RING):
                rows, ring = rows[ring > at], ring[ring > at]
                if not len(rows):
                    break
                asked = np.sort(self.others[entry][at: min(at + RING, n)])
                spot, square = nearest(x[rows], self.centres[asked])
                self.compared += len(rows) * len(asked)
                spot = asked[spot]
                nearer = (square < best[rows]) | ((square == best[rows]) & (spot < near[rows]))
                best[rows[nearer]], near[rows[nearer]] = square[nearer], spot[nearer]
        return near, best


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


class Coder:
    """Turns stored rows (id, label, v, code) into arrays and back; v holds all components in one width of integer."""

    def __init__(self, width: int, parts: int, most: float):
        self.parts, self.part = parts, width // parts
        self.store = next((t for t in (np.int16, np.int32) if most < np.iinfo(t).max), np.int64)
        # four times a squared distance has to stay exact
        self.kind = np.float64 if 16 * self.part * most * most < 2**53 else object

    def pack(self, values: np.ndarray) -> pa.Array:
        whole = values.astype(self.store)
        return pa.array([r.tobytes() for r in whole], pa.binary())

    def unpack(self, column: pa.Array) -> list[np.ndarray]:
        """One array of rows per part position."""
        flat = np.frombuffer(b"".join(column.to_pylist()), self.store).reshape(len(column), self.parts, self.part)
        return [self.exact(flat[:, p]) for p in range(self.parts)]

    def exact(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.float64) if self.kind is np.float64 else values.astype(np.int64).astype(object)

    def codes(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), self.parts)


def _assigned(table: DataFrame, coder: Coder, books: np.ndarray, first: bool) -> DataFrame:
    """The rows with the code and error that ``books`` give them."""
    held = table.sparkSession.sparkContext.broadcast(books)  # parts x entries x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(coder.exact(b)) for b in held.value]
        for batch in batches:
            old = None if first else coder.codes(batch.column(3))
            codes, error = np.zeros((batch.num_rows, coder.parts), np.uint8), np.zeros(batch.num_rows, coder.kind)
            for p, x in enumerate(coder.unpack(batch.column(2))):
                code, square = nearest(x, balls[p].centres) if first else balls[p].assign(x, old[:, p])
                codes[:, p], error = code, error + square
            limited = pa.array([min(int(e), 2**63 - 1) for e in error], pa.int64())
            packed = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, limited], names=["id", "label", "v", "code", "error"])

    schema = T.StructType([*table.select("id", "label", "v").schema, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return table.select("id", "label", "v", *([] if first else ["code"])).mapInArrow(run, schema)


def _moved(table: DataFrame, coder: Coder, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of its parts' mean; entries without parts stay."""
    entries = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((coder.parts, entries, coder.part), dtype=object)
        count = np.zeros((coder.parts, entries), dtype=np.int64)
        for batch in batches:
            codes = coder.codes(batch.column(1))
            for p, x in enumerate(coder.unpack(batch.column(0))):
                own = codes[:, p]
                order = np.argsort(own, kind="stable")
                head = np.flatnonzero(np.diff(own[order], prepend=-1))
                if len(order):
                    added = np.add.reduceat(x[order], head, axis=0)  # a batch's sums are exact
                    sums[p, own[order[head]]] += added.astype(np.int64).astype(object) if coder.kind is np.float64 else added
                count[p] += np.bincount(own, minlength=entries)
        part, entry = np.nonzero(count)
        text = [[str(v) for v in row] for row in sums[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(text, pa.list_(pa.string()))],
                                         names=["part", "entry", "n", "s"])

    partial = table.select("v", "code").mapInArrow(run, "part int, entry int, n long, s array<string>")
    total = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(coder.part)]
    out = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(coder.part)]
    return out


def fit(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Stored id, label, code (a byte per part), error of the usable rows, and the codebooks (parts x entries x components)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte per part, so entries must be 1 to 256")
    v = F.col(f"`{vector}`").cast("array<double>").alias("v")
    ready = rows.where(usable(vector)).select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), v)
    most = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    width, most = ready.agg(F.max(F.size("v")), F.max(most)).first()
    width = -(-(width or 0) // parts) * parts
    coder = Coder(width, parts, min((most or 0.0) * scale + 1, _LONG))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), coder.pack(quantised(matrix(b.column(2), width), scale))], names=["id", "label", "v"])

    # the first entries, at most 256 rows
    seeds = ready.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    start = quantised(matrix(seeds, width), scale).astype(np.int64)
    books = np.stack(np.split(start, parts, axis=1)).astype(object)
    packed = stage(ready.mapInArrow(pack, T.StructType([*ready.select("id", "label").schema, T.StructField("v", T.BinaryType())])), "vectors")
    if not len(seeds):
        return stage(packed.select("id", "label", F.col("v").alias("code"), F.lit(0).cast("long").alias("error")), "codes"), books
    table = packed
    for r in range(rounds):
        after = stage(_assigned(table, coder, books, r == 0), "codes")
        discard(table)
        table, books = after, _moved(after, coder, books)
    last = stage(_assigned(table, coder, books, rounds == 0).drop("v"), "codes")
    discard(table)
    return last, books


def encode(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row."""
    coded, books = fit(rows, vec_id, vector, label, parts, entries, rounds, scale)
    sums = stage(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    total = sums.select(F.col("label").alias("_label"), F.least("total", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"), "n")
    many = coded.count() / HEAVY
    heavy = F.broadcast(total.where(F.col("n") > many))
    same = F.col("label").eqNullSafe(F.col("_label"))
    found = coded.join(heavy, same).unionByName(coded.join(heavy, same, "left_anti").join(total.where(F.col("n") <= many), same))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
