"""N-gram Jaccard join by prefix trees.

Which documents meet: the hash range of shingles is cut into K segments, K above the number of shingles in which two linked
sets can differ, so linked sets agree on at least one whole segment. A document sends one signature per segment (about a
fifth of its shingles); signatures that only one text has are dropped, and so is a document of whose segments too few are
left; of the others only the rarest are needed. This is exact at every size. What remains are near copies, grouped by the
signatures they share.

How they are joined: groups are cut into chunks, and each pair of chunks is joined in one task. The sets of one chunk stand
in a prefix tree in one global order (common shingles first), sets of the other walk down it, so an overlap with a shared
prefix is computed once; a subtree is left as soon as the overlap so far and the shingles that remain on both sides cannot
reach the required overlap. A task returns each document's number of links and only those links that connect something.

Exact copies are one node with a count, so copies are never expanded into pairs. A group of copies of any size combines
before the shuffle; a large group of near copies becomes many chunk pairs. Text travels only for documents that remain.
A document with fewer words than a shingle is one shingle. Null texts and texts without words have an empty set, link with
nothing and are their own component. Repeated rows count as copies. Null ids are never a component's id, unless all are.
An empty table gives an empty result. Sets are identified by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.components import components
from frameloom.llm.staging import bounded, keep_row, stage
from frameloom.llm.textbytes import Words, annotate, mix, parts

#: Sets in one chunk of a group; a task holds the texts of two chunks.
CHUNK = 96
FILTER_BITS = 27
_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def token_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within the text, and where each text begins."""
    h, bounds = words.hashes(), words.bounds
    count = np.diff(bounds)
    out, lengths = [], np.zeros(len(count), dtype=np.int64)
    shingle = np.zeros(max(len(h) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        shingle += h[j: j + len(shingle)] * _STEPS[j]
    shingle = mix(shingle)
    for i, n in enumerate(count):
        if not n:
            continue
        if n < size:
            own = h[bounds[i]: bounds[i + 1]]
            tokens = mix(np.array([(own * _STEPS[:n]).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
        else:
            tokens = np.sort(shingle[bounds[i]: bounds[i + 1] - size + 1])
            keep = np.ones(len(tokens), dtype=bool)
            np.not_equal(tokens[1:], tokens[:-1], out=keep[1:])
            tokens = tokens[keep]
        lengths[i] = len(tokens)
        out.append(tokens)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), starts


def node_of(tokens: np.ndarray) -> int:
    """Identity of a set."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64))[0].astype(np.int64))


class Segments:
    """Size classes and how many segments each takes, for links of at least ``percent`` of the union.

    A pair belongs to the class of its smaller set, and its larger set signs for that class too.
    """

    def __init__(self, percent: int, spread: float, most: int):
        self.percent = percent
        floors = [1]
        while floors[-1] <= most:
            floors.append(max(floors[-1] + 1, floors[-1] * 8 // 5))
        self.floors = floors
        self.pieces = [max(1, int(np.ceil(spread * (self._differ(top - 1) + 1)))) for top in floors[1:]]

    def _differ(self, smaller: int) -> int:
        return smaller * (100 - self.percent) // self.percent

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, segments, segments that must be shared) for a set of n."""
        own = bisect_right(self.floors, n) - 1
        out = [(own, self.pieces[own], self.pieces[own] - self._differ(n))]
        least = -(-n * self.percent // 100)
        for c in range(own - 1, -1, -1):
            top = self.floors[c + 1] - 1
            if top < least:
                break
            differ = (100 - self.percent) * (top + n) // (100 + self.percent)
            out.append((c, self.pieces[c], max(1, self.pieces[c] - differ)))
        return out


def signatures(tokens: np.ndarray, c: int, k: int, need: int) -> tuple[np.ndarray, int]:
    """One value per segment of the hash range: the hashes inside it, added up; and how many must be shared.

    Empty segments agree between any two sets, so they are left out, and so many fewer must be shared; that leaves one at
    least, or else all segments count and one must be shared.
    """
    segment = ((tokens >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), cut)
    full, empty = segment[cut], k - len(cut)
    if need <= empty:
        every = np.zeros(k, dtype=np.uint64)
        every[full] = sums
        sums, full = every, np.arange(k)
    return mix(sums + mix(full.astype(np.uint64) + np.uint64(c << 32))), max(1, need - empty)


def signed(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, spread: float) -> DataFrame:
    """Per document and size class: doc_id, node, n, first (one row of a document has it), scheme, need, sigs."""
    schema = "doc_id long, node long, n long, first boolean, scheme int, need int, sigs array<long>"
    names = ["doc_id", "node", "n", "first", "scheme", "need", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Segments(percent, spread, 1 << 12)
        for batch in batches:
            rows, sigs, at = [], [], 0
            ids = batch.column(0).to_pylist()
            for words in parts(batch.column(1), lower=True):
                tokens, starts = token_sets(words, size)
                for i in range(len(starts) - 1):
                    own = tokens[starts[i]: starts[i + 1]]
                    key, n = ids[at], len(own)
                    at += 1
                    if not n:
                        rows.append((key, None, 0, True, None, None, 0))
                        continue
                    if n >= plan.floors[-1]:
                        plan = Segments(percent, spread, 2 * n)
                    node = node_of(own)
                    for j, (c, k, need) in enumerate(plan.of(n)):
                        values, least = signatures(own, c, k, need)
                        sigs.append(values)
                        rows.append((key, node, n, j == 0, c, least, len(values)))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            flat = np.concatenate(sigs).astype(np.int64) if sigs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[6])]).astype(np.int32)), pa.array(flat))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=t) for c, t in zip(cols, types, strict=False)), lists], names=names)

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, schema)


def sift(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """sig, node, scheme, need of the signatures in ``rows`` that are probably shared, so that few rows meet in the join.

    The filter is one bit for each of 2**27 remainders, 16 MB whatever the data; with more shared signatures it lets more
    pass, and the join decides.
    """
    place = F.pmod(F.col("sig"), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = shared.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**21 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint64)
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = held.value
        for batch in batches:
            sigs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            at = (sigs.astype(np.uint64) & np.uint64((1 << FILTER_BITS) - 1))
            hit = (mask[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(3).value_lengths()))[hit])
            yield pa.RecordBatch.from_arrays([pa.array(sigs[hit]), *(batch.column(k).take(row) for k in range(3))], names=["sig", "node", "scheme", "need"])

    full = rows.where("node is not null").select("node", "scheme", "need", "sigs")
    return full.mapInArrow(run, "sig long, node long, scheme int, need int")


def candidates(rows: DataFrame, peels: int = 2) -> DataFrame:
    """sig, node, scheme, need of signatures that different sets share, less sets of which too few segments are shared."""
    every = rows.where("node is not null").select(F.explode("sigs").alias("sig"), "node")
    shared = stage(every.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig"), "shared")
    left = stage(sift(rows, shared).join(shared, "sig").groupBy("sig", "node").agg(F.first("scheme").alias("scheme"), F.first("need").alias("need")), "postings")
    for _ in range(peels):
        enough = stage(left.groupBy("node", "scheme").agg(F.count("*").alias("m"), F.max("need").alias("least"))
                       .where("m >= least").select("node", "scheme"), "enough")
        held = left.join(bounded(enough), ["node", "scheme"], "left_semi")
        again = stage(held.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig"), "shared")
        left = stage(held.join(bounded(again), "sig", "left_semi"), "postings")
    return left


def rarest(posts: DataFrame) -> DataFrame:
    """sig, node: of a set's m signatures, of which a partner shares ``need``, the m - need + 1 rarest; one is shared.

    The order by count and signature is the same for all sets, so signatures of passages that many documents share come last
    and hardly ever bring anyone together.
    """
    often = stage(posts.groupBy("sig").agg(F.count("*").alias("often")), "often")
    own = Window.partitionBy("node", "scheme")
    ranked = posts.join(bounded(often), "sig").select(
        "sig", "node", "need", F.row_number().over(own.orderBy("often", "sig")).alias("r"), F.count("*").over(own).alias("m"))
    return stage(ranked.where("r <= m - need + 1").select("sig", "node"), "rarest")


def meeting(led: DataFrame) -> DataFrame:
    """a, b: each node with the least of its leads, and that one with the others. ``led``: node, lead.

    This connects what shares a lead with one edge per node; edges between leads are the same for many nodes.
    """
    # no more leads than signatures of a text, or than chunks that a text's own chunk meets
    near = led.groupBy("node").agg(F.min("lead").alias("top"), F.collect_set("lead").alias("leads"))
    own = near.select(F.col("node").alias("a"), F.col("top").alias("b"))
    others = near.select(F.explode("leads").alias("a"), F.col("top").alias("b"))
    return own.union(others.distinct()).where("a <> b")


class Trie:
    """Prefix tree of sets of ranks; an edge is a bit set, a leaf is the place of a set."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.sets, self.width = sets, width
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.root = self._grow(0, len(sets), 0)

    def _bits(self, ranks: np.ndarray) -> int:
        flags = np.zeros(self.width, dtype=np.uint8)
        flags[ranks] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def _grow(self, lo: int, hi: int, depth: int):
        """(edge bits, last rank, depth at its end, least size, greatest size, leaf, children) of sets lo to hi in order."""
        first, last = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        sizes = [len(self.sets[i]) for i in self.order[lo:hi]]
        leaf, at, children = None, lo, []
        if sizes[0] == end:
            leaf, at = self.order[lo], lo + 1
        while at < hi:
            token, stop = self.sets[self.order[at]][end], at + 1
            while stop < hi and self.sets[self.order[stop]][end] == token:
                stop += 1
            children.append(self._grow(at, stop, end))
            at = stop
        return self._bits(first[depth:end]), int(first[end - 1]) if end else -1, end, min(sizes), max(sizes), leaf, children

    def partners(self, ranks: np.ndarray, percent: int) -> list[int]:
        """Sets whose overlap with ``ranks`` is at least ``percent`` of the union."""
        bits, sorted_ranks, n, found = self._bits(ranks), ranks.tolist(), len(ranks), []
        stack = [(self.root, 0)]
        while stack:
            (edge, last, end, least, most, leaf, children), overlap = stack.pop()
            overlap += (edge & bits).bit_count()
            rest = n - bisect_right(sorted_ranks, last)
            if (100 + percent) * (overlap + min(rest, most - end)) < percent * (n + least):
                continue
            if leaf is not None and (100 + percent) * overlap >= percent * (n + end):
                found.append(leaf)
            stack.extend((child, overlap) for child in children)
        return found


def join_chunks(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int) -> list[tuple[int, int | None, int]]:
    """(node, None, links) per linked set and (node, least node of its component here, 0); sets are (node, copies, tokens).

    With ``right`` None the sets of ``left`` are joined among themselves.
    """
    every = left + (right or [])
    tokens, place, seen = np.unique(np.concatenate([s[2] for s in every]), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.lexsort((tokens, -seen))] = np.arange(len(tokens))
    cuts = np.cumsum([len(s[2]) for s in every])[:-1]
    ranked = [np.sort(rank[p]) for p in np.split(place, cuts)]
    base = 0 if right is None else len(left)
    trie = Trie(ranked[base:], len(tokens))
    links, parent, out = [0] * len(every), list(range(len(every))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(left)):
        for j in trie.partners(ranked[i], percent):
            j += base
            if right is None and j <= i:
                continue
            links[i] += every[j][1]
            links[j] += every[i][1]
            parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, own in enumerate(every):
        least[top(i)] = min(least.get(top(i), own[0]), own[0])
    out.extend((own[0], least[top(i)], 0) for i, own in enumerate(every) if own[0] != least[top(i)])
    return out + [(every[i][0], None, n) for i, n in enumerate(links) if n]


def linked(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, links of each group and pair of chunks; ``groups`` has cluster, i, j, chunk, node, copies, text."""
    keys = ["cluster", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close():
            if len(held) > 1:
                same = key[1] == key[2]
                sides = [[v[1:] for v in held.values() if v[0] == c] for c in key[1:]]
                if same:
                    yield from join_chunks(sides[0], None, percent)
                elif sides[0] and sides[1]:
                    yield from join_chunks(sides[0], sides[1], percent)

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["a", "b", "links"])

        for batch in batches:
            rows, at = [], 0
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for words in parts(batch.column(6), lower=True):
                tokens, starts = token_sets(words, size)
                for i in range(len(starts) - 1):
                    now = (cols[0][at], cols[1][at], cols[2][at])
                    chunk, node, copies = cols[3][at], cols[4][at], cols[5][at]
                    at += 1
                    if now != key:
                        rows.extend(close())
                        key, held = now, {}
                    own = tokens[starts[i]: starts[i + 1]]
                    if node not in held and node_of(own) == node:  # an id may have several texts
                        held[node] = (chunk, node, copies, own.copy())
            yield batch_of(rows)
        yield batch_of(list(close()))

    dealt = groups.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "chunk", "node", "copies", "text").mapInArrow(run, "a long, b long, links long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, spread: float = 1.3, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents linked with it) of every document."""
    return _joined(docs, doc_id, text, size, percent, spread, chunk).drop("node", "label")


def _joined(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, spread: float, chunk: int) -> DataFrame:
    """The columns of ``join``, and node and the node that stands for its component, null where there are no words."""
    rows = stage(signed(docs, doc_id, text, size, percent, spread), "signed")
    ids = rows.where("first").select("doc_id", "node", "n")
    nodes = stage(ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "nodes")
    posts = rarest(candidates(rows))
    leads = stage(posts.groupBy("sig").agg(F.min("node").alias("lead")), "leads")
    group = components(stage(meeting(posts.join(bounded(leads), "sig")), "meeting"))
    sizes = stage(group.groupBy("label").agg(F.count("*").alias("many")), "groups")
    members = stage(
        group.join(bounded(sizes), "label").join(nodes, "node")
        .withColumn("chunks", F.ceil(F.col("many") / chunk).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .select(F.col("label").alias("cluster"), "chunk", "chunks", "node", "copies", "doc"), "members")
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_doc"), F.col(f"`{text}`").alias("text"))
    found = body.join(bounded(members), F.col("_doc").eqNullSafe(F.col("doc")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    groups = found.select("*", other).select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "copies", "text")
    links = stage(linked(groups, size, percent), "links")
    labels = components(stage(meeting(links.where("b is not null").select(F.col("a").alias("node"), F.col("b").alias("lead"))), "linked"))
    degrees = links.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = stage(nodes.join(labels, "node", "left").join(degrees, nodes["node"] == degrees["a"], "left")
                  .select("node", "doc", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "known")
    least = stage(known.groupBy("label").agg(F.min("doc").alias("component")), "least")
    final = stage(known.join(least, "label").select("node", "label", "component", "links"), "final")
    return ids.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "node", "label",
    )


def _nodes(size: int):
    """Node of every text; null where there are no words."""

    def derive(column: pa.Array) -> list[pa.Array]:
        out = []
        for words in parts(column, lower=True):
            tokens, starts = token_sets(words, size)
            out.extend(node_of(tokens[a:b]) if b > a else None for a, b in itertools.pairwise(starts))
        return [pa.array(out, pa.int64())]

    return derive


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, spread: float = 1.3, chunk: int = CHUNK) -> DataFrame:
    """One document of each component, one with the least id, with its columns as it came.

    Documents without words or without an id all stay. An id that stands on several texts stays once for each component
    that has it as its least id, so no text is lost that is linked with nothing; repeated rows stay once.
    """
    found = _joined(docs, doc_id, text, size, percent, spread, chunk)
    stay = found.where(F.col("node").isNotNull() & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id", "label").agg(F.min("node").alias("stays"))
    rows = keep_row(docs, F.col(f"`{doc_id}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = annotate(rows, lambda: _nodes(size), "node long").select("row.row", "row.key", "node")
    several = F.col("node").isNull() | F.col("key").isNull()
    kept = rows.where(~several).join(stay, (F.col("key") == F.col("doc_id")) & (F.col("node") == F.col("stays")))
    return kept.dropDuplicates(["key", "node"]).select("row.*").union(rows.where(several).select("row.*"))
