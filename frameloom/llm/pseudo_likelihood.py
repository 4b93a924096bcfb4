"""Scoring by masked pseudo-likelihood.

A bidirectional window network predicts each word from the two words before and the two behind it: the position's
embeddings are added, pass through tanh, and a two-level softmax gives the probability of the word's class and of the word
in its class, so the conditional probabilities of a position add up to 1. A document's score is the sum of the conditional
log-probabilities of all its words.

The network has a vocabulary of fixed size: the most frequent words, counted over the whole corpus; other words share hashed
entries. What it predicts for a shared entry is divided among the words of the entry by their counts over the whole corpus:
a word's share is its count less a discount, and what the discounts leave is spread evenly over the 64-bit hashes of the
entry, so the shares of an entry add up to 1 and a word never met has a small share too. The table of counts grows with the
corpus and stays distributed: the most frequent ``HEAD`` words are broadcast, the others are joined by word.

Training predicts every word of every document, whole corpus, once: its position falls in one of two rounds by hash. In a
round each partition trains a copy in numpy from the common state, and the copies are averaged, weighted by their words, in
groups of at most ``FAN`` until few are left. The size of the network, and so what the averages gather per copy, does not grow.

Null and empty texts have no word and score 0. Repeated rows are scored one by one. Further columns travel in ``row``. With an
empty table nothing is learned and the result is empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.staging import stage
from frameloom.llm.textbytes import annotate, mix, parts, sums_per_text

CLASSES = 32
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS
FREQUENT = 768
SHARED = VOCABULARY - FREQUENT  # a power of two
PAD = VOCABULARY
WIDTH = 32
WINDOW = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 2048
RATE = 0.1
FAN = 32
SCORED = 1 << 13  # positions scored at once, so that their class scores stay in a cache
#: Words whose counts are broadcast; the counts of all others are joined.
HEAD = 1 << 19
DISCOUNT = 0.75
_ONES = np.ones(CLASSES, dtype=np.float32)  # classes and words of a class are as many
_SHAPES = {"embed": (len(WINDOW), VOCABULARY + 1, WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,),
           "to_word": (CLASSES, WIDTH, PER_CLASS), "word_bias": (CLASSES, PER_CLASS)}


class Counts(NamedTuple):
    """What is known of the words that share entries."""

    words: np.ndarray  # sorted hashes of the most frequent of them
    n: np.ndarray
    total: np.ndarray  # occurrences of each entry's words
    kinds: np.ndarray  # different words of each entry
    every: bool  # no other word was counted

    def log_share(self, entry: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probability of a word counted n times among those of its entry; 0 times for a word never met."""
        even = SHARED / 2.0**64
        total = self.total[entry]
        part = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * self.kinds[entry] * even) / np.maximum(total, 1)
        return np.log(np.where(total > 0, part, even))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words, 0 for those that are not here."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[spot] == hashes, self.n[spot], 0)


class Lexicon:
    """Ids of word hashes: frequent words have their own, the others share by hash.

    ``counts`` and ``rest``, a stored table of the words (word, n) that are not in it, divide the shared entries.
    """

    def __init__(self, frequent: np.ndarray, counts: Counts | None = None, rest: DataFrame | None = None):
        self.frequent, self.counts, self.rest = frequent, counts, rest
        self.order = np.argsort(frequent)
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = FREQUENT + (hashes % np.uint64(SHARED)).astype(np.int64)
        at = np.flatnonzero(self.near[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(at):
            spot = np.minimum(np.searchsorted(self.frequent, hashes[at], sorter=self.order), len(self.frequent) - 1)
            hit = self.frequent[self.order[spot]] == hashes[at]
            out[at[hit]] = self.order[spot[hit]]
        return out


def contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The words around each position, one row per offset of the window; PAD beyond the text."""
    n = len(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((len(WINDOW), n), PAD, dtype=np.int64)
    for k, off in enumerate(WINDOW):
        a, b = max(0, -off), n - max(0, off)
        if b > a:
            same = text[a:b] == text[a + off: b + off]
            out[k, a:b][same] = ids[a + off: b + off][same]
    return out


class Network:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        return cls({k: (rng.normal(0, 0.1, s) if k in ("embed", "to_class", "to_word") else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()})

    def pack(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in _SHAPES])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at: at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.p["embed"][0].take(around[0], axis=0)
        for k in range(1, len(WINDOW)):
            total += self.p["embed"][k].take(around[k], axis=0)
        total += self.p["bias"]
        return np.tanh(total, out=total)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= (z @ _ONES)[:, None]  # a product adds up short rows faster than a sum
        return z

    def log_probability(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each word given the words around it."""
        out = np.empty(len(ids))
        for a in range(0, len(ids), SCORED):
            own, h = ids[a: a + SCORED], self.hidden(around[:, a: a + SCORED])
            group, member = own // PER_CLASS, own % PER_CLASS
            z = h @ self.p["to_class"] + self.p["class_bias"]
            z -= z.max(axis=1, keepdims=True)
            value = z[np.arange(len(own)), group] - np.log(np.exp(z, out=z) @ _ONES)
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                at = order[cuts[c]: cuts[c + 1]]
                if len(at):
                    z = h[at] @ self.p["to_word"][c] + self.p["word_bias"][c]
                    z -= z.max(axis=1, keepdims=True)
                    value[at] += z[np.arange(len(at)), member[at]] - np.log(np.exp(z, out=z) @ _ONES)
            out[a: a + len(own)] = value
        return out

    def gradients(self, ids: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log-probability."""
        n = len(ids)
        order = np.argsort((ids // PER_CLASS).astype(np.int16), kind="stable")
        ids, around = ids[order], around[:, order]  # a class is one slice
        h, every = self.hidden(around), np.arange(n)
        group, member = ids // PER_CLASS, ids % PER_CLASS
        slices = [(c, slice(a, b)) for c, (a, b) in enumerate(itertools.pairwise(np.searchsorted(group, np.arange(CLASSES + 1)))) if a < b]
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "embed"}
        d = -self._softmax(h @ self.p["to_class"] + self.p["class_bias"])
        d[every, group] += 1
        g["to_class"], g["class_bias"] = h.T @ d, d.sum(axis=0)
        back = d @ self.p["to_class"].T
        d = np.concatenate([h[at] @ self.p["to_word"][c] + self.p["word_bias"][c] for c, at in slices])
        d = -self._softmax(d)
        d[every, member] += 1
        for c, at in slices:
            g["to_word"][c], g["word_bias"][c] = h[at].T @ d[at], d[at].sum(axis=0)
            back[at] += d[at] @ self.p["to_word"][c].T
        back *= 1 - h * h
        g["bias"] = back.sum(axis=0)
        place = (around + np.arange(len(WINDOW))[:, None] * (VOCABULARY + 1)).ravel().astype(np.int16)  # fits, and sorts by radix
        order = np.argsort(place, kind="stable")
        place = place[order]
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        g["embed"] = np.zeros((len(WINDOW) * (VOCABULARY + 1), WIDTH), dtype=np.float32)
        g["embed"][place[heads]] = np.add.reduceat(back.take(order % n, axis=0), heads, axis=0)
        g["embed"] = g["embed"].reshape(_SHAPES["embed"])
        return {k: v / n for k, v in g.items()}


class Trainer:
    """AdaGrad ascent on a copy of the network."""

    def __init__(self, net: Network):
        self.net, self.words = net, 0
        self.sums = {k: np.full(s, 1e-6, dtype=np.float32) for k, s in _SHAPES.items()}

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        for k, g in self.net.gradients(ids, around).items():
            self.sums[k] += g * g
            self.net.p[k] += RATE * g / np.sqrt(self.sums[k])
        self.words += len(ids)


def vocabulary(docs: DataFrame, text: str = "text") -> Lexicon:
    """The most frequent words, by counts over all documents; ties by hash. The counts of all others divide the entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.unique(w.hashes(), return_counts=True) for w in parts(batch.column(0), lower=True)]
            if seen:
                words, back = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([s[1] for s in seen]), minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], names=["word", "n"])

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow().column(0).to_numpy()
    own = docs.sparkSession.createDataFrame([(int(w),) for w in top], "word long")
    rare = counts.join(F.broadcast(own), "word", "left_anti")  # FREQUENT rows
    entry = F.col("word").bitwiseAND(SHARED - 1).cast("int").alias("entry")
    total, kinds = np.zeros(SHARED), np.zeros(SHARED)
    for r in rare.groupBy(entry).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        total[r["entry"]], kinds[r["entry"]] = r["n"], r["kinds"]
    # the least count from which on words are broadcast; the different counts are few, as their sum is at most all words
    often = rare.groupBy("n").agg(F.count("*").alias("many")).toArrow()
    n, many = (often.column(i).to_numpy() for i in range(2))
    order = np.argsort(-n)
    fit = np.flatnonzero(np.cumsum(many[order]) <= HEAD)
    least = int(n[order][fit[-1]]) if len(fit) else int(n.max(initial=0)) + 1
    head = rare.where(F.col("n") >= least).toArrow()  # HEAD rows at most
    words, held = head.column("word").to_numpy().astype(np.uint64), head.column("n").to_numpy()
    order = np.argsort(words)
    found = Counts(words[order], held[order], total, kinds, len(words) == int(many.sum()))
    return Lexicon(top.astype(np.uint64), found, None if found.every else rare.where(F.col("n") < least))


def _average(rows: DataFrame) -> DataFrame:
    """One row for each ``FAN`` rows of part, words, params."""

    def mean(pdf):
        import pandas as pd

        weight = pdf["words"].to_numpy(np.float64)
        total = sum(w * np.frombuffer(p, np.float32).astype(np.float64) for w, p in zip(weight, pdf["params"], strict=True))
        return pd.DataFrame({"part": [pdf["group"].iloc[0]], "words": [int(weight.sum())], "params": [(total / max(weight.sum(), 1)).astype(np.float32).tobytes()]})

    return rows.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group").applyInPandas(mean, "part long, words long, params binary")


def round_of(hashes: np.ndarray, bounds: np.ndarray, rounds: int) -> np.ndarray:
    """Which round trains a position; by its word and its place in the text, so each time a text is read the same."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    return (mix(hashes + mix(place.astype(np.uint64))) >> np.uint64(32)) % np.uint64(rounds)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Lexicon, Network]:
    """Count the vocabulary, then train and average ``rounds`` times over all documents, each position in one round."""
    context = docs.sparkSession.sparkContext
    lexicon, net = vocabulary(docs, text), Network.fresh()
    for k in range(rounds):
        state = context.broadcast((lexicon.frequent, net.pack()))

        def run(batches: Iterator[pa.RecordBatch], state=state, k=k) -> Iterator[pa.RecordBatch]:
            words_of, flat = state.value
            lex, trainer = Lexicon(words_of), Trainer(Network.unpack(flat))
            for batch in batches:
                for words in parts(batch.column(0), lower=True):
                    hashes = words.hashes()
                    ids = lex.ids(hashes)
                    around = contexts(ids, words.bounds)
                    chosen = np.flatnonzero(round_of(hashes, words.bounds, rounds) == k)
                    for a in range(0, len(chosen), BATCH):
                        at = chosen[a: a + BATCH]
                        trainer.step(ids[at], around[:, at])
            if trainer.words:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.words]),
                                                  pa.array([trainer.net.pack().tobytes()], pa.binary())], names=["part", "words", "params"])

        copies = stage(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "part long, words long, params binary"), "copies")
        while copies.count() > FAN:
            copies = stage(_average(copies), "copies")
        few = copies.orderBy("part").toArrow()
        weight = few.column("words").to_numpy().astype(np.float64)
        if len(weight):
            flats = [np.frombuffer(p, np.float32) for p in few.column("params").to_pylist()]
            net = Network.unpack(sum(w * f for w, f in zip(weight / weight.sum(), flats, strict=True)))
    return lexicon, net


def score(docs: DataFrame, model: tuple[Lexicon, Network], text: str = "text") -> DataFrame:
    """``row``, n_words and log_likelihood of every document."""
    lexicon, counts = model[0], model[0].counts
    state = docs.sparkSession.sparkContext.broadcast((lexicon.frequent, tuple(counts), model[1].pack()))

    def measure():
        lex, known, net = Lexicon(state.value[0]), Counts(*state.value[1]), Network.unpack(state.value[2])

        def derive(column: pa.Array) -> list[pa.Array]:
            n, total, left, cuts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for words in parts(column, lower=True):
                hashes = words.hashes()
                ids = lex.ids(hashes)
                value = net.log_probability(ids, contexts(ids, words.bounds))
                at = np.flatnonzero(ids >= FREQUENT)
                times = known.find(hashes[at])
                here = (times > 0) | known.every
                value[at[here]] += known.log_share(ids[at[here]] - FREQUENT, times[here])
                away = at[~here]
                n.append(np.diff(words.bounds))
                total.append(sums_per_text(value, words.bounds))
                left.append(hashes[away].astype(np.int64))
                cuts.append(np.searchsorted(away, words.bounds[1:]) + cuts[-1][-1])
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(cuts)), pa.array(np.concatenate(left))).cast(pa.list_(pa.int64()))
            return [pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(total)), lists]

        return derive

    scored = annotate(docs, measure, "n_words long, log_likelihood double, left array<long>", text)
    if counts.every:
        return scored.drop("left")
    scored = stage(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
    asked = scored.select("place", F.explode("left").alias("word")).groupBy("place", "word").agg(F.count("*").alias("times"))
    stats = docs.sparkSession.createDataFrame([(e, float(a), float(b)) for e, (a, b) in enumerate(zip(counts.total, counts.kinds, strict=True))], "entry int, total double, kinds double")
    even = F.lit(SHARED / 2.0**64)
    part = (F.greatest(F.coalesce("n", F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * even) / F.greatest("total", F.lit(1.0))
    share = F.log(F.when(F.col("total") > 0, part).otherwise(even))
    found = asked.join(lexicon.rest, "word", "left").join(F.broadcast(stats), F.col("word").bitwiseAND(SHARED - 1) == F.col("entry"))  # SHARED rows
    sums = found.groupBy("place").agg(F.sum(F.col("times") * share).alias("rest"))
    return scored.join(sums, "place", "left").select("row", "n_words", (F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0))).alias("log_likelihood"))
