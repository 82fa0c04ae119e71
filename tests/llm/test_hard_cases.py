"""Very long texts, hot keys, repeated rows and clashing column names."""

import time
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from prismgrid.llm import bpe, common, cover_tree, langid_crf, mixing, pii, url_filter


def test_url_filter_passes_columns_of_any_name(spark):
    log = spark.createDataFrame([("host", "a.com", "add", 1)], "rule string, key string, action string, at int")
    names = "url string, fetch_time int, best string, _at string, _row string, key string, valid_from string, blocked string"
    rows = spark.createDataFrame([("http://a.com/x", 3, "b", "c", "d", "e", "f", "old"), (None, None, *"bcdef", "old")], names)
    got = url_filter.filter_urls(rows, log).orderBy("fetch_time").collect()
    assert [r["blocked"] for r in got] == [False, True]
    assert all([r[c] for c in ("best", "_at", "_row", "key", "valid_from")] == list("bcdef") for r in got)
    assert got[1]["rule"] == "host" and got[1]["host"] == "a.com" and got[1]["path1"] == "x"


def test_bpe_of_very_long_runs():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in (" " * 5000 + "x", " " * 5000, "a" + "\n" * 6000 + " b", "a" + " \t" * 4096 + "!", "\u3000" * 5000 + "z", "x\x1c" * 5000 + "!\x1c" + "  " * 3000 + "\x1c y"):
        assert bpe.encode_text(enc, text, 64).tolist() == enc.encode_ordinary(text)
    for text in (" " * 5_000_000 + "x", "\n" * 2_000_000, "a" * 1_000_000):
        assert enc.decode_bytes(bpe.encode_text(enc, text).tolist()) == text.encode()


def test_mixed_corpus_with_clashing_names_and_repeated_rows(spark):
    rows = [(None, "s", "same words here", 1, "x", 7) for _ in range(40)] + [(5, "s", "same words here", i, "y", 8) for i in range(30)]
    rows += [(9, "t", " ".join(["w"] * 900), 0, "z", 9), (10, None, None, 0, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int, _size string, k1 int")
    plan, mixed = mixing.mix(docs, group_rows=7).collect(), mixing.apply_mix(docs, group_rows=7).collect()
    taken = Counter()
    for r in plan:
        taken[r["doc_id"]] += r["copies"]
    assert len(plan) == len(rows) and Counter(r["doc_id"] for r in mixed) == +taken
    assert {(r["_size"], r["k1"]) for r in mixed} <= {("x", 7), ("y", 8), ("z", 9)}
    own = [r for r in plan if r["source"] == "s"]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * 7 and max(r["copies"] for r in plan) <= 3
    uneven = Counter((r["doc_id"], r["copies"]) for r in mixed)
    assert max(uneven[5, i] for i in range(30)) - min(uneven[5, i] for i in range(30)) <= 1


def test_language_of_texts_without_letters_and_of_long_ones(spark):
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ein ist ich mit auch".split()}
    text = lambda lang, n, s: " ".join(np.random.default_rng(s).choice(words[lang], n))
    rows = [(i, text(k, 80, i), k) for k in words for i in range(40)] + [(99, text("en", 5000, 1), "en")]
    model = langid_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), passage=60)
    odd = [(1, "\u00bd \u00b2 \u2160 12"), (2, text("de", 300_000, 2)), (3, text("en", 70_000, 3)), (4, "")] + [(10 + i, text("de", 3, i)) for i in range(20)]
    got = {r["doc_id"]: r for r in langid_crf.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0.0) and got[4]["lang_pred"] == "und"
    assert got[2]["lang_pred"] == "de" and got[3]["lang_pred"] == "en" and all(got[10 + i]["lang_pred"] == "de" for i in range(20))
    texts = [t for _, t in odd if len(t) < 10_000]
    assert np.allclose(langid_crf.score_texts(texts, model), langid_crf.score_texts(texts, model, cells=50))


def test_personal_data_in_a_text_of_many_spans(spark):
    n = 40_000
    line = "mail u{0:06d}@example.com, call +1 (202) 555-{1} or 202-555-{1}"
    text = " ".join(line.format(i, i % 9000 + 1000) for i in range(n))
    docs = spark.createDataFrame([(1, text, "old"), (2, "é x@y.z", "old"), (None, None, None)], "doc_id long, text string, spans string")
    began = time.perf_counter()
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert time.perf_counter() - began < 60
    size = len(line.format(0, 1000)) + 1
    assert [(s["start"], s["end"]) for s in got[1] if s["kind"] == "email"] == [(size * i + 5, size * i + 24) for i in range(n)]
    assert sum(s["base"] for s in got[1]) == 2 * n and len(got[1]) == 3 * n and got[None] == []
    assert masked[1]["text"] == " ".join(["mail <EMAIL>, call <PHONE> or <PHONE>"] * n)
    assert (masked[2]["text"], masked[2]["spans"], masked[None]["text"]) == ("é <EMAIL>", "old", None)


def test_pairs_among_vectors_of_many_lengths(spark):
    rows = [(2 * n + k, [1.0] * n) for n in range(1, 1006) for k in (0, 1)] + [(9999, [1.0, 1.001])]
    got = {r["vec_id"]: r for r in cover_tree.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and got[9999]["component_id"] == 4 and got[4]["n_links"] == 2
    assert all(got[2 * n + 1]["component_id"] == 2 * n and got[2 * n]["n_links"] == 1 for n in range(3, 1006))


def test_clustered_vectors_leave_few_block_pairs(spark):
    """Blocks compared grow with the clusters, not with their square."""
    seen = []
    for clusters in (8, 32):
        rng = np.random.default_rng(3)
        centre = np.linalg.qr(rng.normal(size=(64, 64)))[0][:clusters]
        x = centre.repeat(40, axis=0) + 0.02 * rng.normal(size=(clusters * 40, 64))
        u = cover_tree.unit(x)
        pivots = u[cover_tree.farthest_first(u, clusters)]
        own = (u @ pivots.T).argmax(axis=1)
        cells = {(64, k): (40, max(np.linalg.norm(u[own == k] - pivots[k], axis=1))) for k in range(clusters)}
        seen.append(sum(len(near) for *_, near in cover_tree.near_cells({64: pivots}, cells, 0.9, 4096)))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = cover_tree.near_pairs(df, block=10).collect()
        near = cover_tree.unit(x) @ cover_tree.unit(x).T >= 0.9
        assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(i, int(near[i].sum()) - 1) for i in range(len(x))]
    assert seen == [8, 32]


def test_a_bitmap_of_ids_loses_none(spark):
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    wide = {r[0] for r in rows.filter(common.may_hold(ids, "doc_id")).collect()}
    assert wide >= set(range(0, 3000, 3)) and len(wide) < 1010
    assert {r[0] for r in rows.filter(common.may_hold(ids, "doc_id", 64)).collect()} >= set(range(0, 3000, 3))
    assert rows.filter(common.may_hold(ids.limit(0), "doc_id")).count() == 0


def test_a_bitmap_of_ids_is_not_spelt_out_in_plans(spark):
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"))
    rows = spark.range(3000).select(F.col("id").alias("doc_id")).filter(common.may_hold(ids, "doc_id"))
    rows.collect()
    assert len(rows._jdf.queryExecution().toString()) < 100_000


def test_blocks_meet_without_being_shuffled(spark):
    x = np.random.default_rng(4).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1, 8) for i, v in enumerate(x)], "cid long, embedding array<float>, weight long, size int")
    found = cover_tree._linked(common.staged(df, "points"), 0.9, 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning" not in plan
    got = {r["cid"]: r["n"] for r in found.groupBy("cid").agg(F.sum("links").alias("n")).collect()}
    u = cover_tree.unit(x.astype(np.float32))
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert got == {i: n for i, n in enumerate(near.tolist()) if n}
