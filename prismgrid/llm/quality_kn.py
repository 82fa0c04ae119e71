"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

    P(w|u) = (c_uw - D(c_uw)) / c_u + backoff(u) * P(w),  P(w) = (k_w - D'(k_w)) / sum k + rest / (V + 1)

k_w is the number of words that w follows; both orders have three discounts, for 1, 2 and more. Every
word of the trusted texts is in the model; what is left of the lower order is shared alike by its V
words and one unknown word, which stands for all others.

Counts are gathered and merged in shards of the word before (:mod:`shards`); what is known of a word as
such lies in shards of the words. Documents meet the merged counts in the same shards (a sharded count
join): a shard asks for the lower order of the words its documents hold and sends the probabilities of
each batch's bigrams back to it. Only counts of counts and the totals of split contexts, two a shard
at most, reach the driver. Documents go through in ``waves`` by hash, all of them, so that the
exchange takes a part of the disk at a time.

A document is accepted if its length-adjusted log perplexity is at most the threshold of its
language: the ``quantile`` of trusted texts that were held out of training. The adjustment draws short
texts toward their language's median as if they had ``prior_words`` more words of it. Languages without
held-out texts use all held-out texts.

Null or empty texts have no words and are rejected. Null languages form a language of their
own. If nothing is trusted every non-empty document is accepted. Repeated label rows: trusted if
any says so. Rows are scored one by one, whatever their doc_id. Extra columns are ignored, and passed
through by :func:`keep`.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import shards as S
from prismgrid.llm.common import drop_staged, may_hold, release, small_batches, staged

QUANTILE, PRIOR_WORDS = 0.999, 20.0
#: What a message between shards holds: words with numbers, a piece of a split context, counts of counts,
#: merged bigrams, values for a batch.
WORDS, SPLIT, BINS, MODEL, VALUES = 0, 1, 2, 3, 4
MESSAGE = "kind int, part int, source int, block binary, n long, n1 long, n2 long"
_COLUMNS = ["kind", "part", "source", "block", "n", "n1", "n2"]
_NONE = np.empty(0, np.int64)


def _messages(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more from how many occur 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    step = lambda k: k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
    return np.array([0.0, *(min(max(step(k), 0.05), k - 0.05) for k in (1, 2, 3))])


@dataclass(frozen=True)
class Knowledge:
    """What all shards know of the model."""

    keys: np.ndarray  # shard -> part
    split: S.Splits
    upper: np.ndarray | None = None  # discounts of bigrams
    lower: np.ndarray | None = None  # and of words
    total: int = 0  # distinct bigrams
    types: int = 0
    rest: float = 1.0  # what the lower order leaves to all words alike
    contexts: np.ndarray | None = None  # of each split word: customers, and bigrams seen once, twice, more

    def word(self, kinds: np.ndarray) -> np.ndarray:
        """Lower-order probability of words that follow ``kinds`` others."""
        even = self.rest / (self.types + 1)
        if not self.total:
            return np.full(len(kinds), even)
        return np.maximum(kinds - self.lower[np.minimum(kinds, 3)], 0) / self.total + even

    def asked(self, words: np.ndarray, part: int, values: list[np.ndarray]) -> list[tuple]:
        """Ascending words with numbers, to where the words are kept."""
        return [
            (WORDS, int(self.keys[s]), part, S.pack(S.gaps(words[own]), *[v[own] for v in values]), 0, 0, 0)
            for s, own in S.by_target(words, self.split.shards)[1]
        ]

    def answers(self, words: np.ndarray, messages: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        blocks = dict(zip(messages["source"], messages["block"], strict=True))
        for s, at in S.by_target(words, self.split.shards)[1]:
            out[at] = S.unpack(blocks[int(self.keys[s])])[0]
        return out


def _bins(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def _train(knowledge: Knowledge):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        """A shard's merged bigrams, its words and contexts."""
        part = int(key[0])
        m = S.Merged(list(group.sort_values("batch")["block"]))
        _, runs = np.unique(m.u, return_counts=True)
        rows = [(MODEL, part, part, S.pack(S.gaps(m.first), runs, S.gaps(m.second), m.w, m.count), 0, 0, 0)]
        rows += knowledge.asked(m.second, part, [np.bincount(m.w, minlength=len(m.second))])
        rows += [(BINS, -1, part, b"", k + 1, int(n), 0) for k, n in enumerate(_bins(m.count))]
        sums = _context(m.u, m.count, len(m.first))
        at = knowledge.split.at(m.first)
        rows += [(SPLIT, -1, part, b"", int(at[u]), k, int(sums[k, u])) for u in np.flatnonzero(at >= 0) for k in range(4)]
        S.trim()
        return _messages(rows)

    return run


def _context(u: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Of each word before: customers, and bigrams seen once, twice, more."""
    return np.stack([np.bincount(u, count, size)] + [np.bincount(u[np.minimum(count, 3) == k], minlength=size) for k in (1, 2, 3)]).astype(np.int64)


def _words(key, group: pd.DataFrame) -> pd.DataFrame:
    """How many words each word follows, over all shards, and counts of these counts."""
    parts = [S.unpack(b) for b in group["block"]]
    words, at = np.unique(np.concatenate([S.ungaps(p[0]) for p in parts]), return_inverse=True)
    kinds = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    rows = [(WORDS, int(key[0]), -1, S.pack(S.gaps(words), kinds), 0, 0, 0)]
    rows += [(BINS, -1, -1, b"", k + 1, int(n), 0) for k, n in enumerate(_bins(kinds))]
    rows.append((BINS, -1, -1, b"", 0, len(words), int(kinds.sum())))
    S.trim()
    return _messages(rows)


def _ask(knowledge: Knowledge):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        """The words that documents hold in a shard."""
        words = np.unique(np.concatenate([S.ungaps(S.unpack(b)[2]) for b in group["block"]]))
        S.trim()
        return _messages(knowledge.asked(words, int(key[0]), []))

    return run


def _answer(key, asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    known, kinds = _NONE.view(np.uint64), _NONE
    if len(kept):
        gap, kinds = S.unpack(kept["block"].iloc[0])
        known = S.ungaps(gap)
    rows = []
    for source, block in zip(asked["source"], asked["block"], strict=True):
        words = S.ungaps(S.unpack(block)[0])
        rows.append((WORDS, int(source), int(key[0]), S.pack(_looked_up(known, kinds, words)), 0, 0, 0))
    S.trim()
    return _messages(rows)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of ascending keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int64)


def _value(knowledge: Knowledge):
    """log10 P of each bigram of each batch in a shard."""

    def run(key, group: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return _messages([])
        part, k = int(key[0]), knowledge
        group = group.sort_values("batch")
        words = np.unique(np.concatenate([S.ungaps(S.unpack(b)[2]) for b in group["block"]]))
        lower = k.word(k.answers(words, messages[messages["kind"] == WORDS]))
        model = messages.loc[messages["kind"] == MODEL, "block"]
        first = second = _NONE.view(np.uint64)
        pairs = count = _NONE
        if len(model):
            first, runs, second, w, count = S.unpack(model.iloc[0])
            first, second, count = S.ungaps(first), S.ungaps(second), count.astype(np.int64)
            u = np.repeat(np.arange(len(first)), runs)
            pairs = u * len(second) + w
            sums = _context(u, count, len(first))
            at = k.split.at(first)
            sums[:, at >= 0] = k.contexts[:, at[at >= 0]]
            mass = (k.upper[1:, None] * sums[1:]).sum(axis=0) / np.maximum(sums[0], 1)
        shards, rows = np.uint64(k.split.shards), []
        for batch, block in zip(group["batch"], group["block"], strict=True):
            before, runs, after, w, _ = S.read_block(block)
            iu, iw = _looked_up(first, np.arange(1, len(first) + 1), before), _looked_up(second, np.arange(1, len(second) + 1), after)
            u = np.repeat(iu, runs)
            p = lower[np.searchsorted(words, after)][w]
            known = np.flatnonzero(u)
            if len(known):
                own = u[known] - 1
                c = np.where(iw[w[known]] > 0, _looked_up(pairs, count, own * len(second) + iw[w[known]] - 1), 0)
                p[known] = np.maximum(c - k.upper[np.minimum(c, 3)], 0) / np.maximum(sums[0, own], 1) + mass[own] * p[known]
            # A split word's context is known in all its shards, with or without bigrams there.
            far = k.split.at(before)
            far = np.repeat(np.where((far >= 0) & (iu == 0), far, -1), runs)
            lone = np.flatnonzero(far >= 0)
            if len(lone):
                own = k.contexts[:, far[lone]]
                p[lone] *= np.where(own[0] > 0, (k.upper[1:, None] * own[1:]).sum(axis=0) / np.maximum(own[0], 1), 1.0)
            home = k.keys[int((S.mix64(np.array([batch], np.uint64)) % shards)[0])]
            rows.append((VALUES, int(home), part, S.pack(np.log10(p).astype(np.float32)), int(batch), 0, 0))
        S.trim()
        return _messages(rows)

    return run


def _summed(extra: list[str], place: dict[int, int]):
    def finish(key, own: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["doc_id", *extra, "n_tokens", "log10_p"])]
        for batch, mine in own.groupby("batch", sort=True):
            ids, counts, _ = pickle.loads(mine.loc[mine["kind"] == S.HEAD, "block"].iloc[0])
            pair, doc, times = S.read_postings(mine.loc[mine["kind"] == S.POSTINGS, "block"].iloc[0])
            sent = values[values["n"] == batch]
            sent = sent.iloc[np.argsort([place[k] for k in sent["source"]])]  # the batch wrote its shards in this order
            logp = np.concatenate([S.unpack(b)[0] for b in sent["block"]]).astype(np.float64)
            total = np.bincount(doc, logp[pair] * times, len(ids))
            out.append(pd.DataFrame(ids, columns=["doc_id", *extra], dtype=object).assign(n_tokens=counts + 1, log10_p=total))
        S.trim()
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    return finish


def learn(train: DataFrame, split: S.Splits, words: int) -> tuple[Knowledge, DataFrame, DataFrame]:
    """What is known of the model, its merged bigrams and its words by part."""
    spark, shards = train.sparkSession, split.shards
    knowledge = Knowledge(S.bucket_keys(shards), split)
    dealt = S.deal(train, split, words).filter(F.col("kind") == S.KEYS)
    seen = staged(dealt.groupBy("part").applyInPandas(_train(knowledge), MESSAGE), "counts")
    release(spark)
    kept = staged(seen.filter(F.col("kind") == WORDS).groupBy("part").applyInPandas(_words, MESSAGE), "words")
    bins = lambda df: {r["n"]: (r["a"], r["b"]) for r in df.filter(F.col("kind") == BINS).groupBy("n").agg(F.sum("n1").alias("a"), F.sum("n2").alias("b")).collect()}
    upper, lower = bins(seen), bins(kept)
    of = lambda b: np.array([b.get(k, (0, 0))[0] for k in range(1, 5)])
    types, total = lower.get(0, (0, 0))
    contexts = np.zeros((4, len(split.words)), np.int64)
    for r in seen.filter(F.col("kind") == SPLIT).groupBy("n", "n1").agg(F.sum("n2").alias("c")).collect():  # four numbers a split word
        contexts[r["n1"], r["n"]] = r["c"]
    low = discounts(of(lower))
    once, twice = of(lower)[:2]
    rest = (low[1] * once + low[2] * twice + low[3] * (types - once - twice)) / total if total else 1.0
    knowledge = replace(knowledge, upper=discounts(of(upper)), lower=low, total=int(total), types=int(types), rest=float(rest), contexts=contexts)
    return knowledge, seen, kept


def perplexities(
    docs: DataFrame, train: DataFrame, words: int = 800_000, waves: int = 6, shards: int | None = None, shard_words: int = 3_000_000, drop_train: bool = False
) -> DataFrame:
    """Log10 probability of every text of ``docs`` under a model of the texts of ``train``.

    ``docs(doc_id, text, *extra)`` gives ``doc_id, *extra, n_tokens, log10_p``. With ``drop_train`` the staged table ``train`` is deleted once it is learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = S.text_bytes(docs)
    shards, waves = shards or S.shard_count(size, shard_words), S.wave_count(size, waves)
    split = S.splits(docs, shards, words)
    knowledge, seen, kept = learn(train.select("doc_id", "text"), split, words)
    if drop_train:
        drop_staged(train)
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = {int(k): i for i, k in enumerate(knowledge.keys)}
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *extra])
    schema += ", n_tokens long, log10_p double"
    model = seen.filter(F.col("kind") == MODEL)
    known = kept.filter(F.col("kind") == WORDS)
    scored = []
    for wave in range(waves):
        small_batches(spark)
        dealt = S.deal(S.in_wave(docs, wave, waves), split, words, extra=tuple(extra))
        blocks = S.staged_by([dealt], "part", shards, "bigrams", by="kind")
        small_batches(spark, 32)  # rows are blocks of tens of kilobytes from here on
        held = blocks.filter(F.col("kind") == S.KEYS).select("part", "batch", "block")
        asked = held.groupBy("part").applyInPandas(_ask(knowledge), MESSAGE)
        told = staged(asked.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(_answer, MESSAGE), "told")
        sent = held.groupBy("part").cogroup(told.unionByName(model).groupBy("part")).applyInPandas(_value(knowledge), MESSAGE)
        rest = blocks.filter(F.col("kind") != S.KEYS)
        done = rest.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(_summed(extra, place), schema)
        scored.append(staged(done, "scored"))
        drop_staged(told), S.drop_table(blocks)
        del dealt, blocks, held, asked, told, sent, rest, done
        release(spark)
    drop_staged(seen), drop_staged(kept)
    out = scored[0]
    for one in scored[1:]:
        out = out.unionByName(one)
    return out


def _row_keys() -> list[F.Column]:
    """128 bits that stand for a row: equal for rows of equal id, text and language alone."""
    parts = [c for name in ("doc_id", "lang", "text") for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"_k{i}") for i in (1, 2)]


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, prior_words: float, **params) -> DataFrame:
    """What :func:`judge` returns, with the row keys."""
    trusted = labels.filter("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    # A fifth of the trusted texts is held out and sets the thresholds.
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5))
    learned = trusted.filter(part != 0).select("doc_id")
    # Texts are thinned by a bitmap of ids before the exact join shuffles them, at any size of the labels.
    some = docs.select("doc_id", "text").filter(may_hold(learned, "doc_id"))
    train = staged(some.join(learned.hint("merge"), "doc_id", "left_semi"), "train")
    release(docs.sparkSession)
    held_out = F.coalesce(F.col("trusted") & (part == 0), F.lit(False))
    scored = staged(perplexities(docs.select("doc_id", "text", "lang", *_row_keys()), train, drop_train=True, **params), "scored")
    rate = -F.col("log10_p") / F.col("n_tokens")
    scored = scored.join(trusted, "doc_id", "left").withColumn("held_out", held_out).withColumn("rate", rate)
    usual = scored.filter("held_out and n_tokens > 1")
    middle = usual.groupBy("lang").agg(F.percentile_approx("rate", 0.5, F.lit(10_000)).alias("middle"))
    middle = staged(middle.withColumnRenamed("lang", "_lang"), "middle")
    of_lang = F.col("lang").eqNullSafe(F.col("_lang"))
    whole = usual.agg(F.percentile_approx("rate", 0.5, F.lit(10_000)).alias("any")).first()["any"]
    weight = F.col("n_tokens") / (F.col("n_tokens") + prior_words)
    high = lambda c: F.percentile_approx(c, quantile, F.lit(10_000))

    def near(df: DataFrame) -> DataFrame:
        df = df.join(middle, of_lang, "left").withColumn("middle", F.coalesce("middle", F.lit(whole).cast("double"))).drop("_lang")
        return df.withColumn("adjusted", F.coalesce(F.col("middle") + (F.col("rate") - F.col("middle")) * weight, F.col("rate")))

    usual = near(usual)
    bound = usual.groupBy("lang").agg(high("adjusted").alias("high")).withColumnRenamed("lang", "_lang")
    bound_any = usual.agg(high("adjusted").alias("high")).first()["high"]
    judged = near(scored).join(bound, of_lang, "left")
    limit = F.coalesce("high", F.lit(bound_any).cast("double"))
    return judged.select(
        "_k1",
        "_k2",
        "doc_id",
        "lang",
        "n_tokens",
        "log10_p",
        F.pow(F.lit(10.0), "rate").alias("perplexity"),
        F.pow(F.lit(10.0), "adjusted").alias("adjusted"),
        F.pow(F.lit(10.0), limit).alias("threshold"),
        ((F.col("n_tokens") > 1) & F.coalesce(F.col("adjusted") <= limit, F.lit(True))).alias("accepted"),
    )


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_words: float = PRIOR_WORDS, **params) -> DataFrame:
    """Per document ``doc_id, lang, n_tokens, log10_p, perplexity, adjusted, threshold, accepted``."""
    return _judged(docs, labels, quantile, prior_words, **params).drop("_k1", "_k2")


def keep(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_words: float = PRIOR_WORDS, **params) -> DataFrame:
    """The accepted rows of ``docs``, same columns. Rows are told apart by id, text and language."""
    good = staged(_judged(docs, labels, quantile, prior_words, **params).filter("accepted").select("_k1", "_k2").distinct(), "good")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_row_keys())
    return rows.join(good, ["_k1", "_k2"], "left_semi").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
