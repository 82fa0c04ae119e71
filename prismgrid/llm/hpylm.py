"""Hierarchical Pitman-Yor bigram model, seated by Gibbs sampling over shards.

Every word w before which u stands eats at restaurant u; all restaurants share one parent over
single words, whose base is uniform. A restaurant's tables for a dish are the parent's customers.
Predictive probability of w after u, with c customers, t tables, discount d, strength s:

    P(w|u) = (c_uw - d t_uw) / (s + c_u) + (s + d t_u) / (s + c_u) * P(w)

Seating is sampled customer by customer: one leaves, and joins an old table or opens a new one
with the probabilities of the process. Whether the table it leaves vanishes depends, given c
and t, on a ratio of generalised Stirling numbers (the arrangement is integrated out). The ratios
are tabulated up to ``EXACT`` customers; of the few pairs with more all customers are seated in one step,
t being drawn from the same conditional distribution (:mod:`stirling`), so no pair is left out.

Shards of the word before hold whole restaurants, but for words that would fill a shard: these
restaurants are dealt over several shards by the word, which add up their customers and tables
between rounds (at most two rows a shard go by the driver) and sweep beside each other within one.
Shards of the word hold the parent in the same way. Each round sends table counts up and the parent's
customers and tables (averaged over samples of its own seating) down, then sweeps; the seating goes on from
round to round. Predictive probabilities are averaged over the samples of the last round and sent back
to the batches, which hold the postings. What is gathered follows the corpus; only sums of a few numbers
reach the driver.

Null text is empty: one end token. Empty corpus: empty result. If no text is learned from,
probabilities are uniform. Repeated rows count as often as they occur. Documents of equal id are
scored by row. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import shards as S
from prismgrid.llm.common import drop_staged, release, small_batches, staged
from prismgrid.llm.stirling import leave_ratio, resample

#: Customers of a pair up to which they are seated one by one.
EXACT = 2048
STRENGTH = 1.0


def sweep(c, t, place, tables, parent, discount: float, strength: float, rng) -> None:
    """One Gibbs sweep over all customers, in place. ``place`` is each pair's restaurant,
    ``tables`` the tables per restaurant, ``parent`` the parent's probability of the dish."""
    ratio = leave_ratio(round(discount, 6), EXACT)
    many = np.flatnonzero((c > 1) & (c <= EXACT))
    many = many[np.argsort(-c[many], kind="stable")]
    size = c[many]
    for step in range(int(size[0]) if len(many) else 0):
        now = many[: np.searchsorted(-size, -step, "left")]  # pairs with more than ``step`` customers
        gone = rng.random(len(now)) < ratio[c[now], t[now]]
        left = t[now] - gone
        fresh = (strength + discount * (tables[place[now]] - gone)) * parent[now]
        opened = rng.random(len(now)) * (fresh + c[now] - 1 - discount * left) < fresh
        change = opened.astype(np.int64) - gone
        t[now] += change
        np.add.at(tables, place[now], change)
    for i in np.flatnonzero(c > EXACT):
        rest = tables[place[i]] - t[i]
        t[i] = resample(int(c[i]), float(rest), float(parent[i]), discount, strength, rng)
        tables[place[i]] = rest + t[i]


#: What a message between shards holds: words with counts for the parent, the totals of a shard, the part of a
#: split restaurant, a shard's own seating; or the parent's answer.
WORDS, TOTAL, SPLIT, STATE = 0, 1, 2, 3
MESSAGE = "kind int, to int, source int, block binary, n long, n1 long, n2 long"
_COLUMNS = ["kind", "to", "source", "block", "n", "n1", "n2"]


def _messages(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


@dataclass(frozen=True)
class Corpus:
    """What all shards know of the corpus at a round."""

    keys: np.ndarray  # shard -> part
    split: S.Splits
    discount: float = 0.5
    n: int = 0
    vocabulary: int = 0
    customers: int = 0  # of the parent
    tables: float = 0.0
    held: np.ndarray | None = None  # customers of each split restaurant
    seated: np.ndarray | None = None  # its tables


def _merge(group: pd.DataFrame) -> tuple[S.Merged, np.ndarray]:
    group = group.sort_values("batch")
    return S.Merged(list(group["block"])), group["batch"].to_numpy()


def _up(merged: S.Merged, part: int, t: np.ndarray, corpus: Corpus) -> list[tuple]:
    """What a shard tells the others: per word its training count and tables, its share of the split
    restaurants, its totals, and its own seating for the next round."""
    count, tables = merged.by_second(merged.count), merged.by_second(t)
    shards = corpus.split.shards
    rows = [
        (WORDS, int(corpus.keys[s]), part, S.pack(S.gaps(merged.second[own]), count[own], tables[own]), 0, 0, 0)
        for s, own in S.by_target(merged.second, shards)[1]
    ]
    at = corpus.split.at(merged.first)
    customers, seated = merged.by_first(merged.count), merged.by_first(t)
    rows += [(SPLIT, -1, part, b"", int(at[u]), int(customers[u]), int(seated[u])) for u in np.flatnonzero(at >= 0)]
    sums = int(merged.count.sum()), int((merged.count == 1).sum()), int((merged.count == 2).sum())
    return [*rows, (TOTAL, -1, part, b"", *sums), (STATE, part, part, S.pack(t), 0, 0, 0)]


def _parents(up: DataFrame, corpus: Corpus, seed: int, sweeps: int, samples: int) -> DataFrame:
    """The parent's counts for each asking shard: training count, customers, tables (a mean over samples, in
    thousandths). Other shards' words keep the tables of the round before."""

    def seat(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source")
        parts = [S.unpack(b) for b in group["block"]]
        words, at = np.unique(np.concatenate([S.ungaps(p[0]) for p in parts]), return_inverse=True)
        count = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        c = np.bincount(at, np.concatenate([p[2] for p in parts]), len(words)).astype(np.int64)
        t = np.minimum(c, 1)
        mean = t * 1000
        if corpus.vocabulary:  # all words are known: sample
            rng = np.random.default_rng([seed, int(key[0])])
            place, tables = np.zeros(len(words), np.int64), np.array([max(corpus.tables, t.sum())])
            base = np.full(len(words), 1 / (corpus.vocabulary + 1))
            seen = np.zeros(len(words))
            for k in range(sweeps + samples - 1):
                sweep(c, t, place, tables, base, corpus.discount, STRENGTH, rng)
                seen += t if k >= sweeps - 1 else 0
            mean = np.round(1000 * seen / samples).astype(np.int64)
        rows, n = [], 0
        for source, p in zip(group["source"], parts, strict=True):
            own = at[n : n + len(p[0])]
            n += len(p[0])
            rows.append((WORDS, source, int(key[0]), S.pack(count[own], c[own], mean[own]), 0, 0, 0))
        rows.append((TOTAL, -1, int(key[0]), b"", int(np.count_nonzero(count)), int(c.sum()), int(t.sum())))
        S.trim()
        return _messages(rows)

    return up.filter(F.col("kind") == WORDS).groupBy("to").applyInPandas(seat, MESSAGE)


def _replies(merged: S.Merged, messages: pd.DataFrame, corpus: Corpus):
    """(training count, customers, tables) of the parent for each word of the shard."""
    order, own = S.by_target(merged.second, corpus.split.shards)
    out = np.zeros((3, len(order)))
    blocks = dict(zip(messages["source"], messages["block"], strict=True))
    for s, at in own:
        out[:, at] = np.stack([x.astype(np.float64) for x in S.unpack(blocks[int(corpus.keys[s])])])
    return out[0].astype(np.int64), out[1], out[2] / 1000


@dataclass(frozen=True)
class _Round:
    """One round over the shards: the seating of one."""

    corpus: Corpus
    seed: int
    turn: int
    last: bool
    sweeps: int
    samples: int

    def runner(self):
        def run(key, group: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
            if not len(group):  # a part that holds no bigrams
                return _messages([])
            out = self.seat(int(key[0]), group, messages)
            S.trim()
            return _messages(out)

        return run

    def seat(self, part: int, group: pd.DataFrame, messages: pd.DataFrame) -> list[tuple]:
        """Seat a shard's customers; its messages or, at last, the values of each batch's bigrams."""
        corpus, d = self.corpus, self.corpus.discount
        m, batches = _merge(group)
        words = messages["kind"] == WORDS
        known, c0, t0 = _replies(m, messages[words], corpus)
        base = 1 / (corpus.vocabulary + 1)
        parent = np.maximum(c0 - d * t0 + (STRENGTH + d * corpus.tables) * base, 1e-300) / (STRENGTH + corpus.customers)
        t = S.unpack(messages.loc[messages["kind"] == STATE, "block"].iloc[0])[0].astype(np.int64)
        customers, tables = m.by_first(m.count), m.by_first(t)
        at = corpus.split.at(m.first)
        far = at >= 0  # what the other parts of a split restaurant hold
        customers[far], tables[far] = corpus.held[at[far]], corpus.seated[at[far]]
        rng = np.random.default_rng([self.seed, self.turn, part])
        above = parent[m.w]
        for _ in range(self.sweeps):
            sweep(m.count, t, m.u, tables, above, d, STRENGTH, rng)
        if not self.last:
            return _up(m, part, t, corpus)
        p = np.zeros(len(t))
        for k in range(self.samples):
            if k:
                sweep(m.count, t, m.u, tables, above, d, STRENGTH, rng)
            p += m.count - d * t + (STRENGTH + d * tables[m.u]) * above
        logp = np.log10(p / self.samples / (STRENGTH + customers[m.u])).astype(np.float32)
        known = known[m.w]
        shards = np.uint64(corpus.split.shards)
        homes = corpus.keys[(S.mix64(batches.astype(np.uint64)) % shards).astype(np.int64)]
        return [
            (WORDS, int(home), part, S.pack(logp[where], known[where]), int(batch), 0, 0)
            for home, batch, where in zip(homes, batches, m.where, strict=True)
        ]


def score(
    docs: DataFrame,
    train: str,
    shards: int | None = None,
    rounds: int = 2,
    sweeps: int = 3,
    samples: int = 3,
    words: int = 800_000,
    seed: int = 7,
    shard_words: int = 2_000_000,
    waves: int = 4,
) -> DataFrame:
    """Score all texts with a model of those whose boolean column ``train`` is true.

    Returns per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity``: tokens are words and one end; ``n_known`` of them occur in training;
    ``base_score`` is the add-half unigram log10 probability, ``score`` the model's log10
    probability. Shards are as many as hold ``shard_words`` words each unless given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = S.text_bytes(docs)
    shards, waves = shards or S.shard_count(size, shard_words), S.wave_count(size, waves)
    split = S.splits(docs, shards, words)
    corpus = Corpus(S.bucket_keys(shards), split)
    place = {int(k): i for i, k in enumerate(corpus.keys)}
    dealt = (S.deal(S.in_wave(docs, wave, waves), split, words, train, wave=wave) for wave in range(waves))
    blocks = S.staged_by(dealt, "part", shards, "bigrams", by="kind")
    small_batches(spark, 32)  # rows are blocks of tens of kilobytes from here on
    held = blocks.filter(F.col("kind") == S.KEYS).select("part", "batch", "block")

    def first_up(key, group: pd.DataFrame) -> pd.DataFrame:
        m, _ = _merge(group)
        out = _up(m, int(key[0]), np.minimum(m.count, 1), corpus)
        del m
        S.trim()
        return _messages(out)

    up = staged(held.groupBy("part").applyInPandas(first_up, MESSAGE), "up")
    total = up.filter(F.col("kind") == TOTAL).agg(F.sum("n"), F.sum("n1"), F.sum("n2")).first()
    n, n1, n2 = (int(x or 0) for x in total)
    # The usual estimate of a discount from how many pairs occur once and twice.
    discount = round(min(max(n1 / (n1 + 2 * n2), 0.1), 0.95), 6) if n1 else 0.5
    corpus = replace(corpus, discount=discount, n=n)

    for turn in range(rounds):
        shares = up.filter(F.col("kind") == SPLIT).groupBy("n").agg(F.sum("n1").alias("c"), F.sum("n2").alias("t")).collect()
        both = np.zeros((2, len(split.words)), np.int64)
        for r in shares:  # at most two words a shard
            both[:, r["n"]] = r["c"], r["t"]
        down = staged(_parents(up, corpus, seed + 1000 * turn, sweeps, samples), "down")
        sums = down.filter(F.col("kind") == TOTAL).agg(F.sum("n"), F.sum("n1"), F.sum("n2")).first()
        vocabulary, customers, tables = (int(x or 0) for x in sums)
        corpus = replace(corpus, vocabulary=vocabulary, customers=customers, tables=tables, held=both[0], seated=both[1])
        state = _Round(corpus, seed, turn, turn == rounds - 1, sweeps, samples)
        told = down.filter(F.col("kind") == WORDS).unionByName(up.filter(F.col("kind") == STATE))
        told = told.select(F.col("to").alias("part"), "kind", "source", "block")
        new = held.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(state.runner(), MESSAGE)
        if not state.last:
            new = staged(new, "up")
            drop_staged(up), drop_staged(down)
            up = new
    values = new.select(F.col("to").alias("part"), F.col("n").alias("batch"), "source", F.lit(-1).alias("kind"), "block")
    own = blocks.filter(F.col("kind") != S.KEYS)

    def finish(key, own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        for batch, mine in own.groupby("batch", sort=True):
            ids, counts, flags = pickle.loads(mine.loc[mine["kind"] == S.HEAD, "block"].iloc[0])
            pair, doc, times = S.read_postings(mine.loc[mine["kind"] == S.POSTINGS, "block"].iloc[0])
            sent = values[values["batch"] == batch]
            sent = sent.iloc[np.argsort([place[k] for k in sent["source"]])]  # the batch wrote its shards in this order
            parts = [S.unpack(b) for b in sent["block"]]
            logp, known = (np.concatenate([p[k] for p in parts]).astype(np.float64) for k in (0, 1))
            plain = np.log10((known + 0.5) / (n + 0.5 * (vocabulary + 1)))
            per_text = lambda v, doc=doc, pair=pair, times=times, ids=ids: np.bincount(doc, v[pair] * times, len(ids))
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([i[0] for i in ids], dtype="Int64"),
                        "held_out": ~flags,
                        "n_tokens": counts + 1,
                        "n_known": per_text((known > 0).astype(np.float64)).astype(np.int64),
                        "base_score": per_text(plain),
                        "score": per_text(logp),
                    }
                )
            )
        S.trim()
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    done = staged(own.groupBy("part").cogroup(values.groupBy("part")).applyInPandas(finish, schema), "scores")
    drop_staged(up), drop_staged(down), S.drop_table(blocks)
    release(spark)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        perplexity.alias("perplexity"),
    )
