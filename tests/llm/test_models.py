"""The language models: seating of large pairs, split restaurants, what the model is worth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.llm import hpylm, shards, stirling

DISCOUNTS = (0.3, 0.7, 0.9)


def exact_log(c, d):
    """log S(c, t) for t = 0..c by the recurrence."""
    log = np.full(c + 2, -np.inf)
    log[0] = 0
    for k in range(1, c + 1):
        t = np.arange(1, k + 1)
        log[t], log[0] = np.logaddexp(log[t - 1], np.log(np.maximum(k - 1 - d * t, 1e-300)) + log[t]), -np.inf
    return log[: c + 1]


@pytest.mark.parametrize("d", DISCOUNTS)
def test_integrals_equal_the_recurrence(d):
    c = 700
    t = np.arange(1, c + 1)
    exact = exact_log(c, d)[1:] + np.array([math.lgamma(k + 1) for k in t]) + t * np.log(d) - math.lgamma(c + 1)
    error = np.abs(stirling.log_sum_is(c, t, d) - exact)
    assert np.percentile(error, 95) < 0.02 and error.max() < 0.3


@pytest.mark.parametrize("d", DISCOUNTS)
@pytest.mark.parametrize(("rest", "parent"), [(3, 0.3), (50, 0.01), (5000, 0.05)])
def test_large_pairs_are_seated_by_their_distribution(d, rest, parent):
    """A pair of over EXACT customers against the exact distribution of its tables."""
    c = 2500
    t = np.arange(1, c + 1)
    weight = exact_log(c, d)[1:] + np.cumsum(np.log(1.0 + d * (rest + t - 1))) + t * np.log(parent)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean, spread = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    rng = np.random.default_rng(0)
    seen, n = [], 600
    for _ in range(n):
        seated, tables = np.ones(1, np.int64), np.array([rest + 1])
        hpylm.sweep(np.array([c]), seated, np.zeros(1, np.int64), tables, np.array([parent]), d, 1.0, rng)
        assert tables[0] == rest + seated[0]
        seen.append(int(seated[0]))
    assert abs(np.mean(seen) - mean) < 4 * spread / math.sqrt(n) + 1e-3 and abs(np.std(seen) / spread - 1) < 0.15


def test_the_table_of_ratios_is_that_of_the_numbers():
    r, log = stirling.leave_ratio(0.7, 60), exact_log(60, 0.7)
    assert np.allclose(r[60, 1:61], np.exp(exact_log(59, 0.7)[:60] - log[1:61]), rtol=1e-5)


def chains(spark, n=240, size=60, words=30):
    """Texts of a Markov chain, whose words say a lot about the next one."""
    rng = np.random.default_rng(7)
    steps = rng.dirichlet(np.full(words, 0.05), words)
    rows = []
    for i in range(n):
        at, out = int(rng.integers(words)), []
        for _ in range(size):
            at = int(rng.choice(words, p=steps[at]))
            out.append(f"w{at}")
        rows.append((i, " ".join(out)))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 != 1)


def test_split_restaurants_score_as_whole_ones(spark):
    docs = chains(spark)
    whole = {r["doc_id"]: r for r in hpylm.score(docs, "train", shards=1, words=2000).collect()}
    split = {r["doc_id"]: r for r in hpylm.score(docs, "train", shards=24, words=2000).collect()}
    assert len(shards.splits(docs.select("doc_id", "text"), 24, 2000).words)
    off = [abs(split[i]["score"] / whole[i]["score"] - 1) for i in whole]
    assert max(off) < 0.02 and np.mean(off) < 0.005
    assert all(whole[i]["base_score"] == pytest.approx(split[i]["base_score"]) and whole[i]["n_known"] == split[i]["n_known"] for i in whole)
    own = [r for r in whole.values() if r["held_out"]]
    assert sum(r["score"] for r in own) > 0.75 * sum(r["base_score"] for r in own)  # both are negative


def test_every_part_is_a_bucket_of_its_own(spark):
    for n in (1, 7, 24):
        rows = [(int(k),) for k in shards.bucket_keys(n)]
        got = spark.createDataFrame(rows, "part int").select(F.pmod(F.hash("part"), F.lit(n)).alias("b")).collect()
        assert [r["b"] for r in got] == list(range(n))


def test_a_bigram_in_every_text_costs_one_entry_a_batch():
    texts = ["the same opening words " + f"x{i}" for i in range(500)]
    hashes, counts = shards.word_hashes(texts)
    split = shards.Splits(4, np.empty(0, np.uint64), np.empty(0, np.int64))
    blocks, postings = shards.bigram_blocks(*shards.with_ends(hashes, counts), np.ones(500, np.int64), split)
    merged = [shards.read_block(b) for _, b in blocks]
    assert sum(len(m[3]) for m in merged) == 3 + 1 + 2 * 500 and sum(int(m[4].sum()) for m in merged) == len(hashes) + 500
    pair, doc, times = shards.read_postings(postings)
    assert np.array_equal(np.bincount(doc, times, 500), counts + 1) and pair.max() + 1 == 4 + 2 * 500
