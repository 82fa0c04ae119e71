"""Language identification by a linear-chain conditional random field over the words of a text.

Every word with a letter is a position of the chain. Features: affixes (prefixes and suffixes of
1-4 characters), inner n-grams of 1-3 characters, hashed into ``BUCKETS`` rows, and a lexicon of
the frequent words of the training sample with rows of their own. Transitions between languages
are learned with the features, by stochastic gradients of the exact conditional likelihood on
code-switched sequences made of passages of training texts. Prediction labels the words of the whole
text by forward-backward; the text's language has the largest mean marginal, which is the score.

Training takes a sample bounded in rows and words: ``per_language`` texts of each language, fewer as
languages grow beyond ``rows / per_language`` but one of each at least, the first by hash, and of a
text longer than ``passage`` words a passage from anywhere in it. Every language is learned. Prediction
covers every word of every text. Only the text is read.

Chains of a batch are laid end to end with a fresh start at each text and cut into stretches that
NumPy runs side by side; products of transfer matrices join the stretches, so the marginals are
those of the uncut chains however long a text is. A window of texts holds about ``CELLS`` numbers.

Null text or one without a letter (Unicode category L): ``und`` with score 0; so is everything if nothing can be learned
from. Ties go to the first language by code point. Repeated rows are predicted alike; extra columns
pass through, ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismgrid.llm.common import small_batches

BUCKETS = 1 << 18
PER_LANGUAGE, ROWS = 1200, 64 * 1200
LEXICON_MIN, LEXICON = 4, 100_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Words of a training passage, and numbers that a window of positions holds (by languages).
PASSAGE, CELLS = 1_000, 2_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words end to end, and the word each belongs to.

    Characters get hashed n-grams between border marks; an n-gram at a border is an affix. The
    whole word, if the lexicon has it, is row BUCKETS + its place.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    ends = np.cumsum(length)
    left = np.arange(len(code)) - (ends - length)[owner]  # place in the word
    right = ends[owner] - np.arange(len(code))  # characters from here to the end
    rows, owners = [], []
    h = np.zeros(len(code), _U)
    for n in range(1, 6):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = _mix(h[:m] * _U(0x100000001B3) + code[n - 1 :] + _U(n))
        inside = right[:m] >= n
        if n == 1:
            inside &= (left[:m] > 0) & (right[:m] > 1)
        if n > 3:  # longer ones only at a border
            inside &= (left[:m] == 0) | (right[:m] == n)
        rows.append((h[inside] % _U(BUCKETS)).astype(np.int64))
        owners.append(owner[:m][inside])
    if len(lexicon):
        key = word_keys(code, owner, left, len(words))
        at = np.minimum(np.searchsorted(lexicon, key), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == key)
        rows.append(BUCKETS + at[known])
        owners.append(known)
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], owners[order]


def word_keys(code, owner, left, count: int) -> np.ndarray:
    """A 64-bit key per word from its characters and their places."""
    key = np.zeros(count, _U)
    np.add.at(key, owner, _mix(code + (left.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)))
    return key


def keys_of(words: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), length)
    return word_keys(code, owner, np.arange(len(code)) - (np.cumsum(length) - length)[owner], len(words))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + lexicon, languages), float32
    lexicon: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word; sums over its features scaled by the root of their number."""
        rows, owner = features(words, self.lexicon)
        out = np.zeros((len(words), len(self.languages)))
        if len(rows):
            n = np.bincount(owner, minlength=len(words))
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[heads]] = np.add.reduceat(self.weights[rows], heads, axis=0)
            out /= np.sqrt(np.maximum(n, 1))[:, None]
        return out


class Stretches:
    """Chains laid end to end, cut into stretches that NumPy runs side by side; ``fresh`` marks first
    positions, ``transitions`` and ``start`` are logs. ``read(a, b)`` gives the log potentials of
    positions a to b; no more than ``cells`` of them (by languages) are held at once."""

    def __init__(self, n, read, fresh, transitions, start, stretch: int = 256, cells: int = CELLS):
        self.n, self.read, self.fresh, self.stretch = n, read, fresh, stretch
        self.size = len(start)
        self.step, self.begin = np.exp(transitions), np.tile(np.exp(start), (self.size, 1))  # begin: from whatever came before
        self.cut = -(-n // stretch)
        held = max(1, cells // (stretch * self.size))
        self.chunks = [(c, min(c + held, self.cut)) for c in range(0, self.cut, held)]

    def _potentials(self, first: int, last: int):
        a, b = first * self.stretch, min(last * self.stretch, self.n)
        e = np.ones(((last - first) * self.stretch, self.size))
        own = self.read(a, b)
        e[: b - a] = np.exp(own - own.max(axis=1, keepdims=True))
        new = np.ones(len(e), bool)
        new[: b - a] = self.fresh[a:b]
        return e.reshape(last - first, self.stretch, self.size), new.reshape(last - first, self.stretch)

    def posteriors(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, posteriors from there on), a bounded number of positions at a time."""
        scale = lambda a, axes: a / a.sum(axis=axes, keepdims=True)
        # Transfer matrix of each stretch: from the state before it to its last state.
        whole = np.tile(np.eye(self.size), (self.cut, 1, 1))
        for first, last in self.chunks:
            e, new = self._potentials(first, last)
            own = whole[first:last]
            for t in range(self.stretch):
                move = np.where(new[:, t, None, None], self.begin, self.step)
                own = scale(own @ move * e[:, t, None, :], (1, 2))
            whole[first:last] = own
        # State before each stretch, and what follows after it.
        into, after = np.empty((self.cut, self.size)), np.empty((self.cut, self.size))
        state = np.full(self.size, 1 / self.size)
        for c in range(self.cut):
            into[c] = state
            state = state @ whole[c]
            state /= state.sum()
        state = np.ones(self.size)
        for c in range(self.cut - 1, -1, -1):
            after[c] = state
            state = whole[c] @ state
            state /= state.sum()
        for first, last in self.chunks:
            e, new = self._potentials(first, last)
            forward = np.empty((self.stretch, last - first, self.size))
            state = into[first:last]
            for t in range(self.stretch):
                state = np.where(new[:, t, None], state.sum(axis=1, keepdims=True) * self.begin[:1], state @ self.step) * e[:, t]
                state = scale(state, 1)
                forward[t] = state
            post, state = np.empty((last - first, self.stretch, self.size)), after[first:last]
            for t in range(self.stretch - 1, -1, -1):
                post[:, t] = scale(forward[t] * state, 1)
                seen = e[:, t] * state
                state = np.where(new[:, t, None], (seen * self.begin[:1]).sum(axis=1, keepdims=True), seen @ self.step.T)
                state = scale(state, 1)
            yield first * self.stretch, post.reshape(-1, self.size)[: self.n - first * self.stretch]


def marginals(potential: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, start: np.ndarray, stretch: int = 256, cells: int = CELLS):
    """Posterior of each position of chains laid end to end from their log potentials (n, L)."""
    run = Stretches(len(potential), lambda a, b: potential[a:b], fresh, transitions, start, stretch, cells)
    return np.concatenate([post for _, post in run.posteriors()])


def _words(text: str) -> list[str]:
    return [w for w in text.lower().split() if _LETTER.search(w)]


def train(sample: pd.DataFrame, length: int = 48, sequences: int = 6000, epochs: int = 3, seed: int = 3) -> Model | None:
    """Fit on ``sample(text, lang)``. Sequences of ``length`` words hold one to four passages of
    texts of any languages; gradients are those of the conditional log-likelihood."""
    texts = [(w, lang) for text, lang in zip(sample["text"], sample["lang"], strict=True) if (w := _words(text or ""))]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    size, index = len(languages), {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    counts: dict[str, int] = {}
    for words, _ in texts:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, n in counts.items() if n >= LEXICON_MIN), key=lambda w: (-counts[w], w))[:LEXICON]
    lexicon = np.unique(keys_of(common)) if common else np.empty(0, _U)
    by_language = [[w for w, lang in texts if index[lang] == i] for i in range(size)]
    chains, gold = [], []
    for _ in range(sequences):
        chain, label = [], []
        while len(chain) < length:
            i = int(rng.integers(size))
            words = by_language[i][int(rng.integers(len(by_language[i])))]
            at = int(rng.integers(len(words)))
            part = words[at : at + int(rng.integers(6, length + 1))]
            chain += part
            label += [i] * len(part)
        chains.append(chain[:length])
        gold.append(label[:length])
    flat = [w for chain in chains for w in chain]
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    rows, owner = features(list(unique), lexicon)
    begin = np.searchsorted(owner, np.arange(len(unique) + 1))
    codes, gold = codes.reshape(sequences, length), np.array(gold)
    w = np.zeros((BUCKETS + len(lexicon), size), np.float32)
    square = np.full_like(w, 1e-6)
    move, move_sq = np.zeros((size, size)), np.full((size, size), 1e-6)
    model = Model(languages, w, lexicon, move, np.full(size, -np.log(size)))
    batch = 200
    for _ in range(epochs):
        order = rng.permutation(sequences)
        for at in range(0, sequences, batch):
            own = order[at : at + batch]
            word, back = np.unique(codes[own], return_inverse=True)
            pieces = begin[word + 1] - begin[word]
            take = np.repeat(begin[word] - np.cumsum(pieces) + pieces, pieces) + np.arange(pieces.sum())
            r, scale = rows[take], 1 / np.sqrt(np.maximum(pieces, 1))
            heads = np.cumsum(pieces) - pieces
            emit = np.add.reduceat(w[r], heads, axis=0) * scale[:, None]
            p = emit[back.reshape(len(own), length)]
            forward, pair_sum, post = _expect(p, move)
            # Observed minus expected, per distinct word, then per feature row.
            grad = -post
            np.put_along_axis(grad, gold[own][..., None], np.take_along_axis(grad, gold[own][..., None], 2) + 1, 2)
            per_word = np.zeros((len(word), size))
            np.add.at(per_word, back.ravel(), grad.reshape(-1, size))
            per_word = np.repeat(per_word * scale[:, None], pieces, axis=0)
            touched, spot = np.unique(r, return_inverse=True)
            g = np.stack([np.bincount(spot, per_word[:, k], len(touched)) for k in range(size)], axis=1)
            square[touched] += (g * g).astype(np.float32)
            w[touched] += (0.3 * g / np.sqrt(square[touched])).astype(np.float32)
            w[touched] *= 0.9995
            seen = np.zeros((size, size))
            np.add.at(seen, (gold[own][:, :-1].ravel(), gold[own][:, 1:].ravel()), 1)
            g = seen - pair_sum
            move_sq += g * g
            move += 0.3 * g / np.sqrt(move_sq)
    return model


def _expect(p: np.ndarray, move: np.ndarray):
    """Forward messages, expected transitions summed, and marginals of chains of equal length."""
    n, length, size = p.shape
    e, step = np.exp(p - p.max(axis=2, keepdims=True)), np.exp(move)
    forward, backward = np.empty((length, n, size)), np.empty((length, n, size))
    forward[0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        f = forward[t - 1] @ step * e[:, t]
        forward[t] = f / f.sum(axis=1, keepdims=True)
    backward[-1] = 1
    pairs = np.zeros((size, size))
    for t in range(length - 2, -1, -1):
        seen = e[:, t + 1] * backward[t + 1]
        joint = forward[t][:, :, None] * step[None] * seen[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = seen @ step.T
        backward[t] = b / b.sum(axis=1, keepdims=True)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    return forward, pairs, post.transpose(1, 0, 2)


def mean_marginals(words: list[list[str]], model: Model, cells: int = CELLS) -> np.ndarray:
    """Mean marginal of each text (texts, languages); zeros for a text without words."""
    out = np.zeros((len(words), len(model.languages)))
    size = np.array([len(w) for w in words], np.int64)
    flat = [w for each in words for w in each]
    if not flat:
        return out
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    del flat
    fresh, ends = np.zeros(len(codes), bool), np.cumsum(size)
    fresh[(ends - size)[size > 0]] = True
    emit = model.emissions(list(unique))
    run = Stretches(len(codes), lambda a, b: emit[codes[a:b]], fresh, model.transitions, model.start, cells=cells)
    for at, post in run.posteriors():
        heads = np.unique(np.concatenate([[0], np.flatnonzero(fresh[at : at + len(post)])]))
        out[np.searchsorted(ends, at + heads, "right")] += np.add.reduceat(post, heads, axis=0)
    return out / np.maximum(size, 1)[:, None]


def score_texts(texts: list[str | None], model: Model, cells: int = CELLS) -> np.ndarray:
    """:func:`mean_marginals` of all texts, a bounded number of words (or one text) at a time."""
    out, held, count = [], [], 0
    for text in texts:
        held.append(_words(text or ""))
        count += len(held[-1])
        if count * len(model.languages) >= cells:
            out.append(mean_marginals(held, model, cells))
            held, count = [], 0
    return np.concatenate([*out, mean_marginals(held, model, cells)])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS, passage: int = PASSAGE) -> Model | None:
    """Learn every language of ``labelled(doc_id, text, lang)`` from a sample bounded in rows and words."""
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    known = known.filter(F.col("text").rlike(r"\p{L}"))  # as _LETTER; others teach nothing
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_of"))
    languages = counts.count()
    if not languages:
        return None
    most = max(1, min(per_language, rows // languages))
    known = known.withColumn("at", F.xxhash64(F.lit(17), "doc_id", "text"))
    # Hashes thin each language to some more than are wanted before any text is shuffled; the rest is exact.
    share = F.pmod(F.col("at"), F.lit(1 << 30)) / float(1 << 30)
    thin = known.join(F.broadcast(counts) if languages <= 10_000 else counts, "lang").filter(share * F.col("_of") < 2 * most + 30)
    # Of a long text a passage anywhere in it, cut on the executors: the driver's share is bounded in words too.
    begin = F.pmod("at", F.greatest(F.size("words") - passage + 1, F.lit(1))).cast("int") + 1
    cut = thin.withColumn("words", F.split(F.trim("text"), r"\s+")).withColumn("text", F.array_join(F.slice("words", begin, passage), " "))
    first = Window.partitionBy("lang").orderBy("at", "text")
    picked = cut.select("text", "lang", "at").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    sample = picked.select("text", "lang", "at").toPandas()
    return train(sample.sort_values(["at", "lang", "text"], kind="stable"))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        found, scores = [], []
        means = score_texts(texts.to_pylist(), sent.value) if sent.value is not None else np.zeros((len(texts), 1))
        for mean in means:
            best = int(mean.argmax())
            found.append(sent.value.languages[best] if mean[best] > 0 else UNKNOWN)
            scores.append(float(min(max(mean[best], 0.0), 1.0)))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", run(F.col("text"))).select(*rest, "_p.lang_pred", "_p.score")
