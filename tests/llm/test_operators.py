"""The training-data operators against brute force on small fixtures, odd input included."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from prismgrid.llm import shards as shards_module
from prismgrid.llm import ann_scan, bpe, common, cover_tree, hpylm, langid_crf, mixing, near_text, pii, quality_kn, shards, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, extra string"
WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def corpus(spark, n: int = 40):
    rows = [(i, prose(i, 30 + i), "en", f"s{i % 3}", "x") for i in range(n)]
    rows += [(100, rows[0][1], "en", "s0", "x"), (101, None, None, None, None), (102, "", "en", "s1", None), (103, "  \t ", "de", "s2", "y")]
    rows += [(104, rows[1][1] + " changed", "en", "s0", "x"), (104, rows[1][1] + " changed", "en", "s0", "x"), (None, "a null id", "en", "s1", "x")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- personal data ----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            g, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in g.split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            )
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts():
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "a@b.c_d@e.f", "..@x-.y.z.", "@", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "12 34", "1  2", "-", " ", "+1 (202) 555-0100", "+", "++1 2", "300.1.1.1", "1.2.3.4", ".5", "001.02.3.4", "é", "𝒳", "\n", "9", "(", ")", "x", "555-0100", "at", "4222222222222"]
    return ["".join(rng.choice(pieces, int(rng.integers(1, 14)))) for _ in range(600)] + ["", "a" * 3000 + "@", "1." * 900, "+1" * 300, "7" * 2000, "1 2" * 400]


def test_base_spans_equal_plain_patterns(spark):
    texts = odd_texts()
    got = pii.find(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")).collect()
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] >= 0 else None
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == base_spans(text), text


def test_model_adds_announced_phone_without_touching_base(spark):
    rows = [(i, f"call me at phone {200 + i}-555-{1000 + i} or +1 (202) 555-0{100 + i}") for i in range(30)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all({s["base"] for s in r["spans"]} == {True, False} for r in got)


def test_mask(spark):
    docs = spark.createDataFrame([(1, "mail bob@example.com now", 24, "e"), (2, None, 0, "e"), (3, "é 10.0.0.1!", 11, "e")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.mask(docs.withColumn("candidates", F.lit(1))).collect()}
    assert got[1]["text"] == "mail <EMAIL> now" and got[1]["n_chars"] == 16
    assert got[2]["text"] is None and got[3]["text"] == "é <IP>!"
    assert {(r["spans"], r["candidates"]) for r in got.values()} == {("e", 1)} and pii.mask(docs.limit(0)).count() == 0


def test_em_finds_the_better_labeler():
    votes = [("email", (1, 1, 0, 1), 900), ("email", (-1, 1, 0, -1), 60), ("email", (1, -1, 0, 1), 40), ("email", (-1, -1, 0, -1), 300)]
    model = pii.fit(votes)
    assert model.reliability["email", "format"] > model.reliability["email", "gazetteer"]


# --- language models --------------------------------------------------------------------------


def test_word_hashes_are_of_words():
    texts = ["The cat\tthe  CAT", None, "", "dog\x0bcat", "x" * 5000 + " cat"]
    h, n = shards.word_hashes(texts)
    words = [w for t in texts for w in common.words_of(t)]
    assert n.tolist() == [len(common.words_of(t)) for t in texts]
    seen = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_hashing_windows_do_not_matter(monkeypatch):
    texts = [prose(i, 50) for i in range(20)] + ["", "y" * 700]
    whole = shards.word_hashes(texts)
    monkeypatch.setattr(shards, "WINDOW", 64)
    for a, b in zip(whole, shards.word_hashes(texts), strict=True):
        assert np.array_equal(a, b)


def test_pack_round_trip():
    arrays = [np.array([3, 70000, 2**60], np.uint64), np.empty(0, np.int64), np.array([0.5, -1.25]), np.arange(300)]
    for a, b in zip(arrays, shards.unpack(shards.pack(*arrays)), strict=True):
        assert np.array_equal(a, b)


def test_pitman_yor_base_score_and_order(spark, monkeypatch):
    monkeypatch.setattr(shards_module, "WAVE", 100)  # several waves into one table
    docs = corpus(spark).withColumn("train", F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)))
    rows, got = docs.collect(), hpylm.score(docs, "train", shards=3, words=200).collect()
    counts = Counter()
    for r in rows:
        if r["train"]:
            counts.update([*common.words_of(r["text"]), "end"])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (r["doc_id"] if r["doc_id"] is not None else -1, len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
        for r in rows
        for t in [[*common.words_of(r["text"]), "end"]]
    )
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert have == want and {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 for r in got)


def test_pitman_yor_probabilities_sum_to_one():
    """Of one restaurant over a whole vocabulary, whatever the seating."""
    rng = np.random.default_rng(0)
    c = np.array([5, 2, 1, 0, 0], np.int64)
    t, tables, parent = np.minimum(c, 1), np.array([3]), np.full(5, 0.2)
    for _ in range(4):
        hpylm.sweep(c, t, np.zeros(5, np.int64), tables, parent, 0.7, 1.0, rng)
        assert tables[0] == t.sum() and (t <= c).all() and (t[c > 0] >= 1).all()
        p = (c - 0.7 * t + (1 + 0.7 * tables[0]) * parent) / (1 + c.sum())
        assert abs(p.sum() - 1) < 1e-12


def test_seating_has_the_right_mean():
    """Tables of one dish: the Gibbs chain against the exact distribution of seatings."""
    d, s, p, n = 0.5, 1.0, 0.3, 4
    stirling = np.zeros((n + 1, n + 1))
    stirling[0, 0] = 1
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            stirling[c, t] = stirling[c - 1, t - 1] + (c - 1 - d * t) * stirling[c - 1, t]
    weight = np.array([stirling[n, t] * np.prod([s + d * k for k in range(t)]) * p**t for t in range(n + 1)])
    exact = (weight * np.arange(n + 1)).sum() / weight.sum()
    m = 4000
    c, t, tables = np.full(m, n), np.ones(m, np.int64), np.ones(m, np.int64)
    rng, seen = np.random.default_rng(1), []
    for i in range(30):
        hpylm.sweep(c, t, np.arange(m), tables, np.full(m, p), d, s, rng)
        seen += [t.mean()] if i >= 5 else []
    assert abs(np.mean(seen) - exact) < 0.02


def test_language_models_on_nothing(spark):
    assert hpylm.score(empty(spark).withColumn("train", F.lit(True)), "train", shards=2).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_kn.judge(empty(spark), labels).count() == 0


@pytest.mark.parametrize("shards", [3, 40])
def test_kneser_ney_against_dictionaries(spark, shards, monkeypatch):
    monkeypatch.setattr(shards_module, "WAVE", 100)
    texts = [prose(i, 25) for i in range(12)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    probe = spark.createDataFrame([(1, texts[0] + " unseen words"), (2, "zebra the of"), (3, None), (4, texts[3])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_kn.perplexities(probe, train, words=40, waves=2, shards=shards).collect()}
    of = lambda t: ["<s>", *(t or "").split(), "</s>"]
    pairs = Counter(p for t in texts for p in zip(of(t), of(t)[1:], strict=False))
    kinds = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5, 0.05), k - 0.05) for k in (1, 2, 3))]

    d, e = discounts(pairs.values()), discounts(kinds.values())
    total = sum(kinds.values())
    even = sum(e[min(k, 3)] for k in kinds.values()) / total / (len(kinds) + 1)
    lower = lambda w: max(kinds[w] - e[min(kinds[w], 3)], 0) / total + even

    def p(u, w):
        own = [c for (a, _), c in pairs.items() if a == u]
        c = pairs[u, w]
        if not own:
            return lower(w)
        return (c - d[min(c, 3)]) / sum(own) + sum(d[min(k, 3)] for k in own) / sum(own) * lower(w)

    every = [*kinds, "zebra"]
    assert abs(sum(p("the", w) for w in every) - 1) < 1e-9
    for r in probe.collect():
        want = sum(math.log10(p(u, w)) for u, w in zip(of(r["text"]), of(r["text"])[1:], strict=False))
        assert abs(got[r["doc_id"]]["log10_p"] - want) < 1e-5 and got[r["doc_id"]]["n_tokens"] == len(of(r["text"])) - 1


def test_quality_keeps_prose_and_drops_junk(spark):
    good = [(i, prose(i, 80), "en") for i in range(400)]
    junk = [(1000 + i, " ".join(f"qz{i}{k}%%" for k in range(60)), "en") for i in range(10)]
    odd = [(2000, None, "en"), (2001, "", None)]
    docs = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(0, 1)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_kn.keep(docs, labels).collect()}
    assert not kept & {r[0] for r in junk + odd} and len(kept) >= 392


# --- near-duplicates ---------------------------------------------------------------------------


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [tuple(map(int, rng.integers(100, 200, 2))) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = components_of({x for e in links for x in e}, links)
    assert got == want


def test_fingerprint_is_the_contract():
    text = "One two THREE four  five"
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)


@pytest.mark.parametrize("block", [16_384, 7])
def test_links_lose_none(spark, block):
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            x = int(b)
            for bit in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    want = components_of(fps, [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3])
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()
    got = components_of(fps, [(r["src"], r["dst"]) for r in found])
    assert got == want


def test_near_duplicates_and_one_of_each_stays(spark):
    docs = corpus(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {0, 100} <= next(v for v in by.values() if 0 in v) and {101, 102, 103} in by.values()
    kept = simhash.deduplicate(docs).collect()
    assert len({r["doc_id"] for r in kept}) == len(kept) and kept[0].asDict().keys() == set(docs.columns)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    texts = {i: prose(50 + i, 40) for i in range(4)}
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[3])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (3, texts[3])])


def test_pipeline_links_all_texts_of_similarity_0_8(spark):
    import corpus_pipeline

    rng, passage = np.random.default_rng(4), " ".join(f"p{i}" for i in range(30))
    texts = [None, " ", "two words"]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        texts.append(" ".join(words) + (" " + passage if base % 2 else ""))
        for cut in range(1, 40, 3):  # similarities around and over the bound
            copy = words.copy()
            copy[cut // 2 : cut // 2 + cut // 2] = [f"c{x}" for x in rng.integers(0, 10**6, cut // 2)]
            texts.append(" ".join(copy) + (" " + passage if base % 2 else ""))
    texts += [texts[5].upper(), texts[5]]
    sets = [set(near_text.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = components_of(range(len(texts)), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(comp.values()) and 14 < len(kept) < len(texts) - 50
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_loose_copies_of_one_text_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng, base = np.random.default_rng(6), [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):  # most pairs share half of their shingles, some reach the bound
        copy = base.copy()
        for at in rng.choice(150, 2 if i < 30 else 9, replace=False):
            copy[at] = f"c{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    sets = [set(near_text.shingles(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp, looked, verified = components_of(range(len(texts)), pairs), [], near_text._verified

    def counted(pairs, *args):
        looked.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near_text, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_text.deduplicate(docs).collect()} == set(comp.values())
    assert 30 < len(pairs) < 3000 and sum(looked) < 3000  # of 44,850


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(7)
    for size in (1, 30, 5000):
        sets = [np.unique(rng.integers(0, 2**64, size, np.uint64)) for _ in range(6)]
        sets = [np.unique(np.concatenate([a[: size // 2], b])) for a in sets for b in sets]
        cid, n = np.arange(len(sets)), np.array([len(x) for x in sets])
        known = near_text.Sketches(cid, n, np.array([*map(near_text.sketch, sets[:-1]), None], object))
        pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i)])
        near = known.near(pairs, 0.8, chunk=100)
        shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
        similar = shared >= 0.8 * (n[pairs].sum(axis=1) - shared)
        assert near[similar].all() and near[(pairs == len(sets) - 1).any(axis=1)].all() and (size != 30 or not near.all())


def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x[100:200] = x[:20].repeat(5, axis=0) + 0.08 * rng.normal(size=(100, 16))
    x[200:220] = x[0]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(900, None, "e"), (901, [0.0] * 16, "e"), (902, [float("nan")] * 16, "e"), (903, [None] + [1.0] * 15, "e"), (904, [], "e"), (905, [1.0, 2.0], "e"), (906, [2.0, 4.0], "e")]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize("block", [4096, 40])
def test_cover_tree_pairs_are_exact(spark, block):
    got = {r["vec_id"]: r for r in cover_tree.near_pairs(vectors(spark), block=block).collect()}
    rows = [r for r in vectors(spark).collect() if r["vec_id"] < 300]
    x = np.array([r["embedding"] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = components_of(range(300), [tuple(map(int, p)) for p in np.argwhere(near)])
    for i in range(300):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), comp[i], comp[i] == i)
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in (900, 901, 902, 903, 904)] == [(0, k) for k in (900, 901, 902, 903, 904)]
    assert (got[905]["n_links"], got[906]["component_id"]) == (1, 905) and len(got) == 307
    assert cover_tree.near_pairs(vectors(spark).limit(0)).count() == 0


def test_links_across_nodes_in_any_order():
    angles = np.radians([0.0, 26.5, 8.0])
    few = cover_tree.traverse(np.stack([np.cos(angles), np.sin(angles)], axis=1), None, np.ones(3, np.int64), 0.9)
    assert few.count.tolist() == [1, 1, 2] and few.label.tolist() == [0, 0, 0]
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(40, 8)).repeat(15, axis=0)
        x = cover_tree.unit(rng.permutation(x + 0.25 * rng.normal(size=x.shape)))
        found = cover_tree.traverse(x, None, np.ones(len(x), np.int64), 0.9)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        assert (found.count == near.sum(axis=1)).all()
        comp = components_of(range(len(x)), [tuple(map(int, p)) for p in np.argwhere(near)])
        assert [comp[i] for i in found.label] == [comp[i] for i in range(len(x))]
        assert len(set(found.label.tolist())) == len(set(comp.values()))


def test_levels_that_divide_nothing_are_left_out():
    rng = np.random.default_rng(3)
    far = cover_tree.unit(rng.normal(size=(300, 64)))
    close = cover_tree.unit(far[:20].repeat(15, axis=0) + 0.03 * rng.normal(size=(300, 64)))
    both = cover_tree.unit(np.concatenate([far[:150], close[:150] + 0.02 * rng.normal(size=(150, 64))]))
    rings = cover_tree.unit(rng.normal(size=(300, 3)) @ rng.normal(size=(3, 64)))
    assert len(cover_tree.nets(far)) == 1 < len(cover_tree.nets(rings))
    for x, y in ((far, close), (close, far), (rings, both), (both, rings), (rings, close), (close, both)):
        found = cover_tree.traverse(x, y, np.ones(600, np.int64), 0.9)
        near = x @ y.T >= 0.9
        assert (found.count == np.concatenate([near.sum(axis=1), near.sum(axis=0)])).all()
        comp = components_of(range(600), [(int(i), 300 + int(j)) for i, j in np.argwhere(near)])
        assert [comp[i] for i in found.label] == [comp[i] for i in range(600)]
    assert cover_tree.traverse(rings, None, np.ones(300, np.int64), 0.9).count.sum() == (rings @ rings.T >= 0.9).sum() - 300


def test_nets_cover_their_members():
    x = cover_tree.unit(np.random.default_rng(1).normal(size=(200, 3)))
    levels = cover_tree.nets(x)
    fine = levels[-1]
    for n in range(len(fine.centre)):
        assert (np.linalg.norm(x[fine.below(n)] - fine.centre[n], axis=1) <= fine.radius[n] + 1e-9).all()
    assert len(levels[0].centre) <= len(levels[1].centre)


def test_dimension_scan_recall_and_order(spark):
    v = vectors(spark)
    got = ann_scan.search(v, v.filter("vec_id % 10 = 0"), k=5).collect()
    rows = [r for r in v.collect() if r["vec_id"] < 300]
    x = np.array([r["embedding"] for r in rows])
    hits = total = 0
    for q in range(0, 300, 10):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in own)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:5]
        hits, total = hits + len(set(best) & {r["vec_id"] for r in own}), total + 5
    assert hits / total >= 0.9
    few = ann_scan.search(v.limit(4), v.limit(2), k=20).collect()
    assert len(few) == 6 and ann_scan.search(v.limit(0), v.limit(0)).count() == 0


# --- URLs, tokens, mixing, languages ----------------------------------------------------------


def test_temporal_list_join(spark):
    events = [
        ("host", "a.com", "add", 10), ("host", "a.com", "remove", 20), ("host", "a.com", "add", 30), ("host", "a.com", "add", 31), ("domain", "b.org", "add", 5),
        ("path", "c.net/x", "add", 1), ("host", "c.net", "add", 15), ("host", "d.com", "add", 7), ("host", "d.com", "remove", 7), ("host", None, "add", 1), ("odd", "a.com", "add", 1),
    ]
    log = spark.createDataFrame(events, "rule string, key string, action string, at int")
    urls = ["http://a.com/", "https://u@A.com:80/q", "http://w.b.org/x/y", "http://c.net/x/1", "http://c.net/z", "http://d.com", "ftp://none.example/", None, "", "nonsense"]
    rows = [(i * 100 + t, u, t, "kept") for i, u in enumerate(urls) for t in (0, 7, 10, 19, 20, 30, 40)] + [(-1, urls[0], None, "kept"), (10, urls[0], 10, "kept")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetch_time int, host string"), log).collect()
    active = {("host", "a.com"): [(10, 20), (30, 99)], ("domain", "b.org"): [(5, 99)], ("path", "c.net/x"): [(1, 99)], ("host", "c.net"): [(15, 99)]}
    match = {0: [("host", "a.com")], 1: [("host", "a.com")], 2: [("domain", "b.org")], 3: [("path", "c.net/x"), ("host", "c.net")], 4: [("host", "c.net")]}
    assert len(got) == len(rows)
    for r in got:
        hits = [k for k in match.get(urls.index(r["url"]), []) for a, b in active[k] if r["fetch_time"] is not None and a <= r["fetch_time"] < b]
        assert (r["n_active"], r["blocked"], r["rule"]) == (len(hits), bool(hits), hits[0][0] if hits else None)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, fetch_time int"), log).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = bpe.encoding(path, pattern)
    rng = np.random.default_rng(5)
    pieces = ["word", " ", "  ", "\n", "\n\n ", "é", "𝒳", "12", "'s", "!?", "\t", " the", " ", "　"]
    texts = ["".join(rng.choice(pieces, 60)) for _ in range(60)] + ["", None, " " * 300, "a" * 2000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, path, pattern, long_text=40), path, pattern).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.encode(docs.limit(0), path, pattern).count() == 0


def test_ids_are_decoded_without_an_object_each():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["", "one two", "naïve 𝒳", " " * 50]
    lists = pa.array([None, *(enc.encode_ordinary(t) for t in texts), None], pa.list_(pa.int32()))
    assert bpe.decode_lists(enc, lists).to_pylist() == [b"", *(t.encode() for t in texts), b""]
    assert bpe.decode_lists(enc, lists[2:4]).to_pylist() == [b"one two", "naïve 𝒳".encode()]
    assert len(bpe.decode_lists(enc, lists[:0])) == 0
    masked = pa.ListArray.from_arrays(pa.array([0, 2, 4]), pa.array([1, 2, 3, 4], pa.int32()), mask=pa.array([True, False]))
    assert bpe.decode_lists(enc, masked).to_pylist() == [b"", enc.decode_bytes([3, 4])]
    many = pa.array([list(range(1000, 3000))] * 500, pa.list_(pa.int32()))
    took = []
    for step in (lambda: bpe.decode_lists(enc, many), many.to_pylist):
        start = time.process_time()
        step()
        took.append(time.process_time() - start)
    assert took[0] < 0.6 * took[1]  # about 0.15


@pytest.mark.parametrize("group_rows", [4096, 5])
def test_mixing_meets_its_targets(spark, group_rows):
    docs = corpus(spark)
    got = mixing.mix(docs, group_rows=group_rows).collect()
    assert len(got) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, free, target = sum(size.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s] + 1e-9}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        free -= full
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own)
    again = mixing.mix(docs.repartition(3), group_rows=group_rows).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again) and mixing.mix(empty(spark)).count() == 0


def test_pivotal_keeps_the_mass():
    rng = np.random.default_rng(2)
    totals = []
    for seed in range(300):
        sizes, parts = rng.integers(1, 50, 30).tolist(), [0.37] * 30
        out = mixing.pivotal(list(range(30)), sizes, parts, seed, False)
        assert sum(0 < p < 1 for p in out) <= 1
        assert abs(np.dot(out, sizes) - 0.37 * sum(sizes)) < 1e-6
        totals.append(mixing.pivotal(list(range(30)), sizes, parts, seed, True)[0])
    assert abs(np.mean(totals) - 0.37) < 0.1


def test_mixed_corpus_repeats_rows(spark):
    docs = corpus(spark)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.apply_mix(docs).collect()) == +taken


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(6)
    potential, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    start = np.full(3, -np.log(3))
    fresh = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    got = langid_crf.marginals(potential, fresh, move, start, stretch=2)
    assert np.allclose(got, langid_crf.marginals(potential, fresh, move, start, stretch=2, cells=6), atol=1e-12)
    want = np.zeros((7, 3))
    for a, b in ((0, 4), (4, 7)):
        for path in np.ndindex(*[3] * (b - a)):
            w = np.exp(sum(potential[a + i, s] for i, s in enumerate(path)) + sum(move[p, q] for p, q in zip(path, path[1:], strict=False)))
            for i, s in enumerate(path):
                want[a + i, s] += w
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(got - want).max() < 1e-12


def test_crf_labels_switched_text(spark):
    other = "der die und das nicht ein ist ich mit auch auf sich werden haben wird noch nach über einem kann".split()
    text = lambda words, s: " ".join(np.random.default_rng(s).choice(words, 60))
    rows = [(i, text(WORDS, i), "en", "x") for i in range(60)] + [(100 + i, text(other, i), "de", "x") for i in range(60)] + [(900, None, "en", "x"), (901, "only text", None, "x")]
    model = langid_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    post = langid_crf.marginals(model.emissions(WORDS[:12] + other[:12]), np.arange(24) == 0, model.transitions, model.start)
    assert [model.languages[k] for k in post.argmax(axis=1)] == ["en"] * 12 + ["de"] * 12
    odd = [(1, text(other, 99), "a"), (2, None, "a"), (3, "123 !!", "a"), (4, "", "a")]
    got = {r["doc_id"]: r for r in langid_crf.predict(spark.createDataFrame(odd, "doc_id long, text string, lang_pred string"), model).collect()}
    assert got[1]["lang_pred"] == "de" and 0 <= got[1]["score"] <= 1
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4))
    assert langid_crf.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_crf_learns_every_language(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid_crf, "train", lambda sample: seen.append(sample))
    rows = [(i, f"word{i}", f"l{i % 70:02d}") for i in range(700)] + [(900, "rare", "zz"), (901, "12", "zz"), (902, "none", None)]
    langid_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4)
    assert set(seen[0]["lang"]) == {f"l{i:02d}" for i in range(70)} | {"zz"} and len(seen[0]) == 281
    langid_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=142)
    assert seen[1]["lang"].nunique() == 71 and len(seen[1]) == 141


def test_digests_of_an_empty_text(spark, tmp_path):
    from prismgrid.llm import queries

    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    none = hashlib.sha256(b"").hexdigest()
    r = queries.op8_byte_bpe(spark, str(tmp_path)).first()
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, none, none)
    r = queries.op1_pii_weak_supervision(spark, str(tmp_path)).first()
    assert (r["n_email"], r["base_sha256"], r["spans"]) == (0, none, "")
