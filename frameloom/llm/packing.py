"""Best-fit packing by minimum bin slack over the lengths of all pieces.

Texts become token ids in Arrow batches; a text longer than a sequence is cut into full pieces with a shorter first one.
Only the histogram of piece lengths (at most ``limit`` rows, whatever the data) reaches the driver. There each pattern
starts with the longest length left, a bitset subset-sum over the available lengths finds the fullest combination with it,
and the pattern is repeated until one of its lengths runs out, so there are at most ``limit`` patterns with at most 63
different lengths each (1 + 2 + ... + 63 < 2048). Pieces find their place by their rank among equal lengths; a length that
many pieces share is ranked in blocks, so no task sorts a whole length.

A null or empty text has the end id alone. Repeated rows are separate pieces. An empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.staging import stage

LIMIT = 2048
END_ID = 0
#: Entries of the word cache of one Python worker; beyond it the cache starts anew.
CACHE_WORDS = 400_000
BLOCK = 1_000

# Cutting before a run of ASCII white space never splits a pre-token, unless other white space stands beside it.
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_PLAIN = re.compile("[\x00-ɏ]*")


class WordEncoder:
    """Token ids of a byte-level BPE vocabulary, with the ids of words met before kept in a bounded cache.

    Words of Latin characters go through the rank file, which holds the same vocabulary and is faster; everything else
    goes through the tokenizer file itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _OTHER_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words, cache = _CHUNK.findall(text), self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = self._ids(w)
            return b"".join([cache[w] for w in words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(tokenizer: str, ranks: str) -> WordEncoder:
    import public_tokenizers

    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = WordEncoder(public_tokenizers.path(tokenizer), public_tokenizers.path(ranks), public_tokenizers.PATTERN)
    return _ENCODERS[tokenizer]


def cut_lengths(total: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids: full ones, after a shorter first one if need be."""
    first = total % limit
    return [first] * (first > 0) + [limit] * (total // limit)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, tokenizer: str = "byte_bpe_50k.json",
           ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks)
        for batch in batches:
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(body.as_py() or "") + end
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, limit)):
                    part = ids[4 * at: 4 * (at + n)]
                    out.append((key, k, at, n, zlib.crc32(part), part)[: 5 + with_ids])
                    at += n
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=False)], names=names)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Of the lengths with counts, the combination with the largest sum up to ``room``; long lengths first among equals."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in counts.items() if c > 0 and x <= room), reverse=True):
        most, part = min(counts[length], room // length), 1
        while most > 0:
            take = min(part, most)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            most -= take
            part *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def patterns(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, {length: pieces}) until no piece is left."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        use = fullest(limit - seed, rest)
        use[seed] = use.get(seed, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, use))
    return out


def places(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces per sequence, offset) of each pattern and length."""
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, use in patterns(counts, limit):
        offset = 0
        for n in sorted(use, reverse=True):
            k = use[n]
            out.append((n, used[n], used[n] + k * times, sequence, k, offset))
            used[n] += k * times
            offset += k * n
        sequence += times
    return out


def pack(parts: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``parts`` (a stored table of pieces) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    blocks = spark.createDataFrame([(n, -(-c // block)) for n, c in counts.items()], "length long, blocks long")
    keyed = (parts.join(F.broadcast(blocks), "length")
             .withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = (keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
             .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (keyed.withColumn("r", F.row_number().over(inside) - 1)
              .join(first, ["length", "block"]).withColumn("r", F.col("r") + F.col("before")).drop("before", "block"))
    spots = spark.createDataFrame(places(counts, limit), "length long, lo long, hi long, first long, k long, at long")
    found = ranked.join(F.broadcast(spots), "length").where((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    nth = F.col("r") - F.col("lo")
    return found.select(*parts.columns, F.expr("first + (r - lo) div k").alias("sequence_id"),
                        (F.col("at") + nth % F.col("k") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stage(pieces(docs, **options), "pieces"), options.get("limit", LIMIT))
