"""Language by a linear-chain conditional random field over the words of a text.

A word's features are its hashed affixes (first and last one to three bytes), its byte trigrams and the word itself (the
lexicon). The chain is trained in numpy by the gradient of the log-likelihood on code-switched sequences: stretches of words
from texts of different languages, one after the other, so that transitions are learned too. A text's languages are the
posteriors of its words by forward-backward, and its prediction the label with the greatest mean posterior.

The classifier learns from a sample of labelled documents, about ``per_lang`` of each language, chosen by a hash of the
text and id; the sample is what reaches the driver, so its bound is a parameter. Prediction runs in Arrow batches over whole
texts; forward-backward advances many texts of similar length together; a task holds one batch of texts and their scores.

A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing could be learned. Ties go
to the smaller label. Repeated rows are predicted one by one, further columns travel in ``row``, an empty table gives an
empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.textbytes import Words, annotate, mix, parts
from frameloom.llm.toxicity import remainder

BITS = 16
PER_LANG = 300
UNKNOWN = "und"
#: Words of one training sequence, and of one stretch in it.
SEQUENCE, STRETCH = 48, 12
GROUP_WORDS = 1 << 20


class Field(NamedTuple):
    labels: list[str]
    emission: np.ndarray  # features x labels
    transition: np.ndarray  # from x to
    start: np.ndarray


def features(words: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature bucket and word place of every feature of the words given by their spans."""
    kinds, places = [], []
    every = np.arange(len(starts))
    length = ends - starts

    def add(at: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> None:
        kinds.append((mix(words.span(a, b) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64))
        places.append(at)

    add(every, starts, ends, 1)
    for n in (1, 2, 3):
        long = every[length >= n]
        add(long, starts[long], starts[long] + n, 10 + n)
        add(long, ends[long] - n, ends[long], 20 + n)
    inner = np.maximum(length - 2, 0)
    at = np.repeat(every, inner)
    first = starts[at] + np.arange(len(at)) - np.repeat(np.cumsum(inner) - inner, inner)
    add(at, first, first + 3, 30)
    return np.concatenate(kinds), np.concatenate(places)


class Emissions:
    """Score of every label for words; those of the words met last are kept in a table of fixed size."""

    SLOTS = 20

    def __init__(self, emission: np.ndarray):
        self.emission = emission
        self.keys = np.zeros(1 << self.SLOTS, dtype=np.uint64)
        self.values = np.zeros((1 << self.SLOTS, emission.shape[1]), dtype=np.float32)

    def __call__(self, words: Words) -> np.ndarray:
        h = words.hashes()
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            new, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            spot = missed[first]
            kind, place = features(words, words.starts[spot], words.ends[spot])
            order = np.argsort(place, kind="stable")
            heads = np.searchsorted(place[order], np.arange(len(spot)))
            scores = np.add.reduceat(self.emission[kind[order]], heads, axis=0)
            out[missed] = scores[back]
            self.keys[slot[spot]], self.values[slot[spot]] = new, scores
        return out


def posteriors(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of every label of every word by forward-backward, several texts at a time."""
    out = np.empty_like(scores)
    length = np.diff(bounds)
    by_length = np.argsort(-length, kind="stable")
    step = np.exp(transition - transition.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    at = 0
    while at < len(by_length) and length[by_length[at]]:
        n = int(length[by_length[at]])
        own = by_length[at: at + max(1, GROUP_WORDS // n)]
        own = own[length[own] > 0]
        at += len(own)
        alive = np.searchsorted(-length[own], -np.arange(n), side="left")  # texts longer than t come first
        place = bounds[own]
        forward = np.empty((n, len(own), len(start)))
        now = local[place] * np.exp(start - start.max())
        forward[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, n):
            k = alive[t]
            now = (forward[t - 1, :k] @ step) * local[place[:k] + t]
            forward[t, :k] = now / now.sum(axis=1, keepdims=True)
        back = np.ones((len(own), len(start)))
        for t in range(n - 1, -1, -1):
            k = alive[t]
            both = forward[t, :k] * back[:k]
            out[place[:k] + t] = both / both.sum(axis=1, keepdims=True)
            if t:
                past = (back[:k] * local[place[:k] + t]) @ step.T
                back[:k] = past / past.sum(axis=1, keepdims=True)
    return out


def _gradient(kind, place, weights, transition, start, gold):
    """Log-likelihood gradient of sequences of equal length: gold is (sequences, words)."""
    m, n = gold.shape
    scores = np.add.reduceat(weights[kind], np.searchsorted(place, np.arange(m * n)), axis=0).reshape(m, n, -1)
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, first = np.exp(transition), np.exp(start)
    size = len(start)
    forward, back = np.empty((n, m, size)), np.empty((n, m, size))
    forward[0] = local[:, 0] * first
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        now = (forward[t - 1] @ step) * local[:, t]
        forward[t] = now / now.sum(axis=1, keepdims=True)
    back[n - 1] = 1
    for t in range(n - 1, 0, -1):
        past = (back[t] * local[:, t]) @ step.T
        back[t - 1] = past / past.sum(axis=1, keepdims=True)
    own = forward * back
    own /= own.sum(axis=2, keepdims=True)
    one = np.eye(size)
    truth = one[gold]
    d_word = truth - own.transpose(1, 0, 2)
    pair = forward[:-1, :, :, None] * step * (back[1:] * local.transpose(1, 0, 2)[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    d_step = np.einsum("mta,mtb->ab", truth[:, :-1], truth[:, 1:]) - pair.sum(axis=(0, 1))
    return d_word.reshape(m * n, size), d_step, d_word[:, 0].sum(axis=0)


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.2, seed: int = 7) -> Field | None:
    """Learn the field from labelled texts by AdaGrad over batches of code-switched sequences."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(labels)}
    stretches = []  # (kinds, words) per stretch
    for text, lang in zip(texts, langs, strict=True):
        for words in parts(pa.array([text])):
            n = len(words.starts)
            for a in range(0, n, STRETCH):
                # the last stretch reaches back, and a text that is shorter than a stretch goes round
                own = np.arange(a, a + STRETCH) - max(0, a + STRETCH - n) if n >= STRETCH else np.resize(np.arange(n), STRETCH)
                kind, place = features(words, words.starts[own], words.ends[own])
                order = np.argsort(place, kind="stable")
                stretches.append((kind[order], place[order], code[lang]))
    size = len(labels)
    weights, transition, start = np.zeros((1 << BITS, size)), np.zeros((size, size)), np.zeros(size)
    if not stretches:
        return Field(labels, weights, transition, start)
    sums = [np.full(x.shape, 1e-2) for x in (weights, transition, start)]
    per = SEQUENCE // STRETCH
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        order = np.concatenate([order, order[: -len(order) % per]]) if len(order) >= per else np.resize(order, per)
        sequences = order.reshape(-1, per)
        # half of the sequences stay in one language, so that staying is likelier than switching
        by_lang = np.argsort([stretches[i][2] for i in order], kind="stable")
        pure = order[by_lang].reshape(-1, per)
        sequences = np.concatenate([sequences, pure])[rng.permutation(2 * len(sequences))]
        for a in range(0, len(sequences), 64):
            batch = sequences[a: a + 64]
            kind = np.concatenate([stretches[i][0] for i in batch.ravel()])
            place = np.concatenate([stretches[i][1] + STRETCH * j for j, i in enumerate(batch.ravel())])
            gold = np.repeat([[stretches[i][2] for i in row] for row in batch], STRETCH, axis=1)
            d_word, d_step, d_start = _gradient(kind, place, weights, transition, start, gold)
            touched, back = np.unique(kind, return_inverse=True)
            d_kind = np.stack([np.bincount(back, weights=d_word[place, c], minlength=len(touched)) for c in range(size)], axis=1)
            sums[0][touched] += d_kind**2
            weights[touched] += rate * d_kind / np.sqrt(sums[0][touched])
            for x, d, s in ((transition, d_step, sums[1]), (start, d_start, sums[2])):
                s += d**2
                x += rate * d / np.sqrt(s)
    return Field(labels, weights.astype(np.float32), transition, start)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, held_out_by: int = 4, held_out: int = 2) -> Field | None:
    """Fit the field on a sample of the labelled documents outside the held-out remainder."""
    body = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    learn = body.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("id", held_out_by) != held_out))  # not for a null id
    keys = learn.select("lang", F.xxhash64("id", "text").alias("key")).distinct()
    n = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not n:
        return None
    rate = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, int(min(1.0, per_lang / c) * (1 << 20)))])
    draw = F.pmod(F.xxhash64("id", "text", F.lit("lang")), F.lit(1 << 20)) < rate[F.col("lang")]
    got = learn.where(draw).select("text", "lang", "id").distinct().toArrow()  # about per_lang rows of each language
    order = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return fit([t for t, _ in order], [x for _, x in order])


def identify(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` of every document."""
    if field is None:
        return annotate(docs, lambda: lambda c: [pa.array([UNKNOWN] * len(c)), pa.array(np.zeros(len(c)))], "lang_pred string, score double", text)
    held = docs.sparkSession.sparkContext.broadcast(field)

    def measure():
        own = Field(*held.value)
        emit = Emissions(own.emission)
        names = np.array([*own.labels, UNKNOWN], dtype=object)

        def derive(column: pa.Array) -> list[pa.Array]:
            scores, bounds = [], [np.zeros(1, np.int64)]
            for words in parts(column):
                scores.append(emit(words))
                bounds.append(words.bounds[1:] + bounds[-1][-1])
            bounds = np.concatenate(bounds)
            word = posteriors(np.concatenate(scores), bounds, own.transition, own.start)
            upto = np.concatenate([np.zeros((1, len(own.labels))), np.cumsum(word, axis=0, dtype=np.float64)])
            mean = (upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
            best, score = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], dtype=bool)
            best[~letters], score[~letters] = len(own.labels), 0
            return [pa.array(names[best], type=pa.string()), pa.array(score)]

        return lambda column: derive(column) if len(column) else [pa.array([], pa.string()), pa.array([], pa.float64())]

    return annotate(docs, measure, "lang_pred string, score double", text)
