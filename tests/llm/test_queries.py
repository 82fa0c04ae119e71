"""Every registered query of the subpackage over whole small tables, against a plain version of its contract."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import base_spans, components_of

import __spark_entry__ as entry
from prismgrid.llm import common, near_text, pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").df().astype({"doc_id": int}).to_dict("records")


def text_of(d):
    return d["text"] if isinstance(d["text"], str) else None


def result(spark, name):
    return entry.queries()[name](spark, SF)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def test_op1_base_spans_of_all_documents(spark, docs):
    df = result(spark, "op1_pii_weak_supervision")
    kind = types(df)
    assert [kind[f"n_{k}"] for k in pii.KINDS] == ["bigint"] * 4 and kind["base_sha256"] == kind["spans"] == "string"
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, r = base_spans(text_of(d)), got[d["doc_id"]]
        labels = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(labels).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(labels) <= set(every) and len(every) == len(set(every))
        places = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in every)]
        assert places == sorted(places)


def test_op2_base_scores_and_split(spark, docs):
    df = result(spark, "op2_hierarchical_pitman_yor")
    assert types(df) | {} == {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
        "base_score": "double", "score": "double", "perplexity": "double",
    }
    got = {r["doc_id"]: r for r in df.collect()}
    tokens = {d["doc_id"]: [*common.words_of(text_of(d)), "end"] for d in docs}
    counts = Counter()
    for i, t in tokens.items():
        if remainder(i, 5) != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (remainder(i, 5) == 1, len(t), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    own = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def embeddings():
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def test_op3_all_links(spark):
    df = result(spark, "op3_cover_tree_pairs")
    kind = types(df)
    assert (kind["n_links"], kind["component_id"], kind["kept"]) == ("bigint", "bigint", "boolean")
    ids, x = embeddings()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = components_of(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}
    assert got == {int(i): (int(near[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op4_recall_at_20(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    df = entry.queries()["op4_adaptive_dimension_scan"](spark, f"/root/testdata/{sf}")
    assert [types(df)[c] for c in ("query_id", "rank", "vec_id", "score")] == ["bigint", "int", "bigint", "double"]
    got = defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append(r)
    at = {int(i): k for k, i in enumerate(ids)}
    hits = total = 0
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        score = x @ x[at[q]]
        assert [r["rank"] for r in own] == list(range(1, 1 + min(20, len(ids) - 1)))
        assert all(abs(r["score"] - score[at[r["vec_id"]]]) < 1e-9 and r["vec_id"] != q for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        best = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        hits, total = hits + len(set(best) & {r["vec_id"] for r in own}), total + len(best)
    print("recall at 20:", sf, hits / total)
    assert hits / total >= 0.95


def test_op5_perplexities_thresholds_and_decisions(spark, docs):
    """Kneser-Ney by dictionaries, the quantile by sorting."""
    got = {r["doc_id"]: r for r in result(spark, "op5_kneser_ney_quality").collect()}
    quality = dict(duckdb.sql(f"select doc_id, max(quality) from '{SF}/labels.parquet' group by 1").fetchall())
    part = {r[0]: r[1] for r in spark.createDataFrame([(d["doc_id"],) for d in docs], "i long").select("i", F.pmod(F.xxhash64(F.lit(5), "i"), F.lit(5))).collect()}
    tokens = {d["doc_id"]: [1, *common.words_of(text_of(d)), 2] for d in docs}
    pairs = Counter()
    for i, t in tokens.items():
        if quality.get(i) == 1 and part[i] != 0:
            pairs.update(zip(t, t[1:], strict=False))
    kinds, context = Counter(w for _, w in pairs), defaultdict(list)
    for (u, _), c in pairs.items():
        context[u].append(c)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5, 0.05), k - 0.05) for k in (1, 2, 3))]

    d, e, total = discounts(pairs.values()), discounts(kinds.values()), sum(kinds.values())
    even = sum(e[min(k, 3)] for k in kinds.values()) / total / (len(kinds) + 1)
    lower = lambda w: max(kinds[w] - e[min(kinds[w], 3)], 0) / total + even
    back = {u: sum(d[min(c, 3)] for c in own) / sum(own) for u, own in context.items()}
    size = {u: sum(own) for u, own in context.items()}

    def p(u, w):
        c = pairs[u, w]
        return lower(w) if u not in size else max(c - d[min(c, 3)], 0) / size[u] + back[u] * lower(w)

    rate, held = {}, defaultdict(list)
    for doc in docs:
        i, t = doc["doc_id"], tokens[doc["doc_id"]]
        logp = sum(math.log10(p(u, w)) for u, w in zip(t, t[1:], strict=False))
        assert got[i]["log10_p"] == pytest.approx(logp, abs=1e-4 * len(t)) and got[i]["n_tokens"] == len(t) - 1
        rate[i] = -logp / (len(t) - 1)
        if quality.get(i) == 1 and part[i] == 0 and len(t) > 2:
            held[doc["lang"]].append(i)
    rank = lambda values, q: sorted(values)[max(math.ceil(q * len(values)), 1) - 1]
    every = [i for own in held.values() for i in own]
    middle = {lang: rank([rate[i] for i in own], 0.5) for lang, own in held.items()}
    any_middle = rank([rate[i] for i in every], 0.5)
    lang_of = {doc["doc_id"]: doc["lang"] for doc in docs}

    def adjusted(i):
        m, n = middle.get(lang_of[i], any_middle), len(tokens[i]) - 1
        return m + (rate[i] - m) * n / (n + 20)

    high = {lang: rank([adjusted(i) for i in own], 0.999) for lang, own in held.items()}
    any_high = rank([adjusted(i) for i in every], 0.999)
    for i, t in tokens.items():
        limit = high.get(lang_of[i], any_high)
        assert math.log10(got[i]["threshold"]) == pytest.approx(limit, abs=1e-4)
        if abs(adjusted(i) - limit) > 1e-4:
            assert got[i]["accepted"] == (len(t) > 2 and adjusted(i) <= limit)


def test_op6_fingerprints_and_components(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op6_simhash_segment_popcount").collect()}
    prints = {}
    for d in docs:
        words = common.words_of(text_of(d))
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    comp = components_of(list(prints), links)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", comp[i]) for i, f in prints.items()}


def test_op7_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(entry.oracle_sql()["op7_url_temporal_list_join"]).df()
    have = result(spark, "op7_url_temporal_list_join").toPandas()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert sorted(want.columns) == sorted(have.columns) and key(want) == key(have)


def test_op8_ids_and_bytes(spark, docs):
    import tiktoken
    from prismgrid.llm import bpe

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    got = {r["doc_id"]: r for r in result(spark, "op8_byte_bpe").collect()}
    for d in docs:
        text, r = text_of(d) or "", got[d["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op9_targets_and_taken(spark, docs):
    rows = result(spark, "op9_pivotal_mixing").collect()
    again = result(spark, "op9_pivotal_mixing").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    size = {d["doc_id"]: len(common.words_of(text_of(d))) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(s for s in total if s is not None) + [s for s in total if s is None]
    weight, free, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), {}
    while True:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s] + 1e-9}
        if not full:
            break
        target |= {s: 3.0 * total[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s) for s in names)


def test_op10_held_out_accuracy(spark, docs):
    df = result(spark, "op10_crf_language_id")
    got = {r["doc_id"]: r for r in df.collect()}
    langs = {d["lang"] for d in docs if d["lang"]}
    right = seen = 0
    for d in docs:
        r, text = got[d["doc_id"]], text_of(d)
        assert r["held_out"] == (remainder(d["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        assert r["lang_pred"] in langs
        if r["held_out"] and d["lang"]:
            right, seen = right + (r["lang_pred"] == d["lang"]), seen + 1
    assert right / seen > 0.9


def test_pipeline_stages_each_on_its_input(spark, docs):
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = rows.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        if n < 4:
            assert out.columns == columns
            out = common.staged(out, f"stage-{n}")
        states.append([r.asDict() for r in out.collect()])
        rows = out
    quality, near, masked, mixed, coded = states
    accepted = {r["doc_id"] for r in result(spark, "op5_kneser_ney_quality").collect() if r["accepted"]}
    assert {r["doc_id"] for r in quality} == accepted and len(quality) > 0.7 * len(docs)
    # One document of each group stays: the smallest id of those linked by similarity (or almost equal fingerprints).
    sets = {r["doc_id"]: set(near_text.shingles(r["text"]).tolist()) for r in quality}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert {r["doc_id"] for r in near} == set(components_of(ids, pairs).values())
    assert [r["doc_id"] for r in sorted(masked, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in near)
    for r in masked:
        assert not [s for s in base_spans(r["text"]) if s[0] == "email"] and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in masked} and max(copies.values()) <= 3
    by_id = {r["doc_id"]: r["text"] for r in masked}
    assert all(r["text"] == by_id[r["doc_id"]] for r in mixed)
    from prismgrid.llm import bpe

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert len(coded) == len(mixed) and all(r["round_trip"] and list(r["ids"]) == enc.encode_ordinary(r["text"]) for r in coded)
