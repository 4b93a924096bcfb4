"""Toxicity by class-conditional Kneser-Ney models over words and word pairs.

An expression's probability in a class is its probability in both, which cancels, times how much likelier the class is where
the expression stands. That is estimated from counts per class less a discount each; what the discounts leave goes to the
next form: from the pair to its second word, from there to the folded word (A-Z lowered, symbols at its edges stripped),
from there to the share of toxic expressions in all. The counts weigh by how probable it is that the expression differs from
its next form, which is never 0. So a rare expression counts by what is known of it, however little, and
one never met has the ratio of the longest form of it that was met, or adds nothing. A text counts an expression once, and
equal texts of the sample count as one, so that neither a repeated line nor a group of copies passes for evidence. A text's
score is the difference of the two log-likelihoods per word, mapped to 0..1 by a logistic curve fitted to the same labelled
texts, each by the counts of all others.

The models learn from a sample of labelled documents, at most about ``per_class`` of each class, chosen by a hash of the id.
Words are told apart by 64-bit hashes and numbered by them, so that a pair is one long of two numbers; pairs are counted by
Spark and packed by the tasks that hold them (sorted, differences, byte planes, deflated), about three bytes each. No expression
is left out. The packed model, so large as the sample has expressions, passes through the driver and is broadcast; a worker
unpacks it once. Only the sampled ids are broadcast to find their texts.

A null or empty text has no words and gets the score of a difference of 0. A null id is never learned from. Repeated rows
are scored one by one; a document labelled both ways counts as toxic. Without labels of both classes every score is 0. An
empty table gives an empty result, and further columns travel in ``row``.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import bounded, discard, stage
from frameloom.llm.textbytes import _LOWER, Words, annotate, mix, parts, sums_per_text

DISCOUNT = 0.75
TELLING = 0.02  # share of expressions expected to differ from their next form
ALONE, FOLDED = 1, 2  # in place of the word before
PER_CLASS = 16_384
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def packed(values: np.ndarray) -> bytes:
    """Integers or floats by byte planes, deflated; sorted integers as differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes(), 1)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(wide, -1).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values


class Model:
    """Packed counts of the sample's expressions and the curve that turns a difference into a score."""

    def __init__(self, words: list[bytes], folds: list[bytes], pairs: list[tuple], share: float):
        self.words, self.folds = words, folds  # sorted hashes; all, less_t and less_o of ``_known``
        self.pairs = pairs  # per task: numbers of both words in one long, toxic texts and texts that have the pair; how many pairs
        self.share, self.slope, self.shift, self.name = share, 1.0, 0.0, uuid.uuid4().hex

    def tables(self, *forms: int) -> list[Table]:
        """Ratios of all expressions by the given forms: 0 all texts, 1 less a toxic and 2 less an ordinary one."""
        base = np.float32(np.log(self.share / (1 - self.share)))
        words, folds = unpacked(self.words[0], np.uint64), unpacked(self.folds[0], np.uint64)
        before = np.append(words, np.uint64(0))  # the beginning of a text has the number after the last word
        above = [unpacked(self.words[1 + form], np.float32) for form in forms]
        n = len(words) + len(folds) + sum(p[3] for p in self.pairs)
        keys, given = np.empty(n, dtype=np.uint64), [np.empty(n, dtype=np.float32) for _ in forms]

        def put(at: int, key: np.ndarray, *p: np.ndarray) -> int:
            keys[at: at + len(key)] = key
            for out, x in zip(given, p, strict=True):
                out[at: at + len(key)] = np.log(x / (1 - x)) - base
            return at + len(key)

        at = put(0, _pair(np.full_like(words, ALONE), words), *above)
        at = put(at, _pair(np.full_like(folds, FOLDED), folds), *(unpacked(self.folds[1 + form], np.float32) for form in forms))
        for key, toxic, texts, _ in self.pairs:  # one task's at a time
            pairs, t, c = unpacked(key, np.uint64), unpacked(toxic, np.int32).astype(np.float32), unpacked(texts, np.int32).astype(np.float32)
            w = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = put(at, _pair(before[(pairs >> np.uint64(32)).astype(np.int64)], words[w]), *(_less(t, c, form, p[w]) for form, p in zip(forms, above, strict=True)))
        order = np.argsort(keys)
        keys = keys[order]
        for i, x in enumerate(given):
            given[i] = x[order]
        del order
        table = Table(keys, None)
        return [table.valued(x) for x in given]

    @property
    def keys(self) -> np.ndarray:
        return self.tables(0)[0].keys

    @property
    def ratio(self) -> np.ndarray:
        return self.tables(0)[0].values


_held: dict[tuple, list[Table]] = {}


def _unpacked_once(model: Model, *forms: int) -> list[Table]:
    """The tables of a model, kept by the worker for its next tasks."""
    if (model.name, forms) not in _held:
        _held.clear()
        _held[model.name, forms] = model.tables(*forms)
    return _held[model.name, forms]


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % by


def _before(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of the word before each word; 0 at the beginning of a text."""
    out = np.zeros_like(h)
    out[1:] = h[:-1]
    out[bounds[:-1][bounds[:-1] < len(h)]] = 0
    return out


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0xD6E8FEB86659FD93) + w)


def _folded(words: Words) -> np.ndarray:
    """Hash of the folded form of each word; 0 for a word of symbols only."""
    n, body = len(words.data), _LOWER[words.data]
    solid, place = ~_SYMBOL[body], np.arange(n)
    after = np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    a, b = after[words.starts], before[words.ends - 1] + 1
    at = np.flatnonzero(a < words.ends)
    out = np.zeros(len(a), dtype=np.uint64)
    out[at] = Words(body, words.offsets).span(a[at], b[at])
    return out


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, per_class: int, held_out_by: int) -> tuple[DataFrame, float]:
    """text and toxic of the sampled documents, stored; and the log of how much denser the toxic class was sampled."""
    learn = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", held_out_by) != 0))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, per_class / n[c]) if n.get(c) else 1.0 for c in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(rate[1] * (1 << 20))).otherwise(int(rate[0] * (1 << 20)))
    chosen = F.broadcast(learn.where(draw).select(F.col("doc_id").alias("_chosen"), "toxic"))  # about 2 * per_class rows at most
    body = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    texts = body.join(chosen, F.col("_id") == F.col("_chosen")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    return stage(texts, "toxic-sample"), float(np.log(rate[1] / rate[0]))


def _once(key: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each distinct key, and in how many toxic and how many texts it is."""
    _, first = np.unique(mix(key + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)  # once per text
    _, head, place = np.unique(key[first], return_index=True, return_inverse=True)
    t = np.bincount(place, weights=toxic[text[first]], minlength=len(head)).astype(np.int64)
    return first[head], t, np.bincount(place, minlength=len(head)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and toxic texts that have a word (v is ``ALONE``; f is its folded form) or a folded word."""
    for batch in batches:
        toxic, at = batch.column(1).to_numpy(zero_copy_only=False), 0
        for words in parts(batch.column(0)):
            h, fold = words.hashes(), _folded(words)
            every = at + np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
            some = np.flatnonzero(fold)
            for v, w, f, text in ((ALONE, h, fold, every), (FOLDED, fold[some], np.zeros(len(some), np.uint64), every[some])):
                spot, t, c = _once(w, text, toxic)
                cols = [pa.array(np.full(len(spot), v, dtype=np.int64)), pa.array(w[spot].astype(np.int64)), pa.array(f[spot].astype(np.int64)), pa.array(t), pa.array(c)]
                yield pa.RecordBatch.from_arrays(cols, names=["v", "w", "f", "t", "c"])
            at += len(words.bounds) - 1


def _count_pairs(held):
    """Texts and toxic texts that have a pair of numbered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(held.value, np.uint64)
        for batch in batches:
            toxic, at = batch.column(1).to_numpy(zero_copy_only=False), 0
            for words in parts(batch.column(0)):
                distinct, place = np.unique(words.hashes(), return_inverse=True)
                own = np.searchsorted(known, distinct)[place].astype(np.uint64)
                before = np.append(np.uint64(len(known)), own[:-1])[: len(own)]
                before[words.bounds[:-1][words.bounds[:-1] < len(own)]] = len(known)
                key = (before << np.uint64(32)) + own
                spot, t, c = _once(key, at + np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds)), toxic)
                yield pa.RecordBatch.from_arrays([pa.array(key[spot].astype(np.int64)), pa.array(t + (c << 32))], names=["key", "n"])
                at += len(words.bounds) - 1

    return run


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        key, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key)
        n = n[order]
        blobs = [packed(key[order].astype(np.uint64)), packed((n & 0xFFFFFFFF).astype(np.int32)), packed((n >> 32).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in blobs), pa.array([len(key)])], names=["key", "t", "c", "pairs"])


def _choose(test, yes, no):
    return F.when(test, yes).otherwise(no) if isinstance(test, Column) else np.where(test, yes, no)


def _toxic_given(t, c, above):
    """Probability of the toxic class where t of c texts are toxic; ``above`` is that of the next form. Columns or arrays.

    The discounted counts weigh as much as it is probable, by their likelihood with and without a share of their own (less
    half a log for fitting it), that the expression differs from its next form. No count weighs nothing.
    """
    log, exp = (F.log, F.exp) if isinstance(t, Column) else (np.log, np.exp)
    kinds = _choose(t > 0, 1, 0) + _choose(c > t, 1, 0)
    some, many = _choose(t > 0, t, 1), _choose(c > 0, c, 1)  # no logarithm of 0, no quotient by 0
    rest = _choose(c > t, c - t, 1)
    own = (_choose(t > DISCOUNT, t - DISCOUNT, 0.0) + DISCOUNT * kinds * above) / many
    gain = (_choose(t > 0, t * log(some / (many * above)), 0.0) + _choose(c > t, (c - t) * log(rest / (many * (1 - above))), 0.0) - log(c + 1.0) / 2)
    tells = 1 / (1 + (1 - TELLING) / TELLING * exp(-gain))
    return _choose(c > 0, above + tells * (own - above), above)


def _less(t, c, form: int, above):
    """The toxic class by all texts (0), by all but one toxic (1) and by all but one ordinary text (2)."""
    if form == 1:
        t, c = _choose(t > 0, t - 1, 0), _choose(c > 0, c - 1, 0)
    elif form == 2:
        c = _choose(c > t, c - 1, t)
    return _toxic_given(t, c, above)


def _known(share: float, *above: str) -> list[Column]:
    """all, less_t and less_o of the counts t and c, by the next form's."""
    over = [F.coalesce(F.col(a), F.lit(share)) for a in above] or [F.lit(share)] * 3
    return [_less(F.col("t"), F.col("c"), form, over[form]).alias(name) for form, name in enumerate(("all", "less_t", "less_o"))]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, held_out_by: int = 5) -> Model | None:
    """Count, compare and calibrate; None if a class has no text."""
    chosen, denser = sample(docs, labels, doc_id, text, per_class, held_out_by)
    spark = docs.sparkSession
    counts = stage(chosen.select("text", "toxic").mapInArrow(_count, "v long, w long, f long, t long, c long")
                   .groupBy("v", "w").agg(F.max("f").alias("f"), F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-counts")
    total, toxic = counts.where(F.col("v") == ALONE).agg(F.sum("c"), F.sum("t")).first()
    if not total or not 0 < toxic < total:
        return None
    share = toxic / total
    names = ["all", "less_t", "less_o"]
    folds = stage(counts.where(F.col("v") == FOLDED).select("w", *_known(share)), "toxic-folds")
    next_form = bounded(folds.select(F.col("w").alias("w_next"), *[F.col(x).alias(f"{x}_next") for x in names]))
    words = (counts.where(F.col("v") == ALONE).join(next_form, F.col("f") == F.col("w_next"), "left")
             .select("w", *_known(share, *[f"{x}_next" for x in names])))

    def taken(rows: DataFrame) -> list[bytes]:
        """Hashes and ratios of the words of the sample, sorted and packed."""
        found = rows.select("w", *[F.col(x).cast("float").alias(x) for x in names]).toArrow()
        keys = found.column("w").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        return [packed(keys[order]), *(packed(found.column(x).to_numpy()[order]) for x in names)]

    word_blobs, fold_blobs = taken(words), taken(folds)
    discard(counts, folds)
    numbers = spark.sparkContext.broadcast(word_blobs[0])
    pairs = chosen.select("text", "toxic").mapInArrow(_count_pairs(numbers), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = pairs.mapInArrow(_pack_pairs, "key binary, t binary, c binary, pairs long").collect()  # a few bytes for each pair of the sample
    numbers.destroy()
    model = Model(word_blobs, fold_blobs, [tuple(r) for r in found], share)
    held = spark.sparkContext.broadcast(model)

    def measure():
        tables = _unpacked_once(held.value, 1, 2)
        return lambda column: [pa.array(differences(column, t)) for t in tables]

    x = F.when(F.col("row.toxic") == 1, F.col("less_t")).otherwise(F.col("less_o")).alias("x")
    scored = annotate(chosen, measure, "less_t double, less_o double").select(x, "row.toxic").toArrow()
    model.slope, shift = calibrate(scored.column(0).to_numpy(), scored.column(1).to_numpy())
    model.shift, model.held = shift - denser, held
    discard(chosen)
    return model


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with a weak pull towards 0 slope."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    coef = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ coef, -30, 30)))
        grad = a.T @ (y - p) - np.array([0.01, 0]) * coef
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hess, grad)
        coef += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(coef[0] / scale), float(coef[1])


class Table:
    """Values of some 64-bit keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.by = np.uint64(64 - min(26, max(16, len(keys).bit_length() + 2)))
        self.near = np.zeros(1 << (64 - int(self.by)), dtype=bool)
        self.near[(keys >> self.by).astype(np.int64)] = True

    def valued(self, values: np.ndarray) -> Table:
        """Other values of the same keys."""
        other = copy.copy(self)
        other.values = values
        return other

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are in the table, and their values."""
        at = np.flatnonzero(self.near[(asked >> self.by).astype(np.int64)])
        if not len(at):
            return at, np.zeros(0)
        spot = np.minimum(np.searchsorted(self.keys, asked[at]), len(self.keys) - 1)
        hit = self.keys[spot] == asked[at]
        return at[hit], self.values[spot[hit]]


def differences(column: pa.Array, table: Table) -> np.ndarray:
    """Toxic less ordinary log-likelihood per word of every text."""
    out = []
    for words in parts(column):
        h, value = words.hashes(), np.zeros(len(words.starts))
        left = np.arange(len(h))
        for v, w in ((_before(h, words.bounds), h), (np.full_like(h, ALONE), h), (np.full_like(h, FOLDED), None)):
            w = _folded(words) if w is None else w
            at, found = table.find(_pair(v[left], w[left]))
            value[left[at]] = found
            left = np.delete(left, at)
        out.append(sums_per_text(value, words.bounds) / np.maximum(np.diff(words.bounds), 1))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row`` and ``score`` of every document."""
    if model is None:
        return annotate(docs, lambda: lambda column: [pa.array(np.zeros(len(column)))], "score double", text)
    held, slope, shift = model.held, model.slope, model.shift

    def measure():
        table, = _unpacked_once(held.value, 0)
        return lambda column: [pa.array(1 / (1 + np.exp(-np.clip(slope * differences(column, table) + shift, -30, 30))))]

    return annotate(docs, measure, "score double", text)


def keep_civil(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they came."""
    return score(docs, train(docs, labels, **options)).where("score < 0.5").select("row.*")
