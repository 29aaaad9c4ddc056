"""Bounds and cases of the operators: ids of other types, short items, many languages, hot blocks, clashing names, empty tables."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.llm import bpe, decontaminate, language, urls

WORDS = [f"w{k}" for k in range(400)]


def brute_contained(docs, items):
    words = lambda t: re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())
    out = []
    for d, t in docs:
        for i, u in set(items):
            w, v = words(t), words(u)
            n = min(5, len(v))
            own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if own and len(own & have) >= 0.8 * len(own):
                out.append((d, i, len(own), len(own & have)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_items_of_any_length_and_type(spark, kind):
    r = random.Random(9)
    name = (lambda k: f"item-{k}") if kind == "string" else (lambda k: k)
    items = [(name(k), " ".join(r.choice(WORDS[:40]) for _ in range(n))) for k, n in enumerate([1, 1, 2, 2, 3, 4, 4, 5, 6, 9, 30, 60])] + [(name(50), ""), (name(51), None), (name(52), "ÉTÉ"), (name(53), "!!")]
    items += [items[4], (name(60), items[8][1])]
    docs = [(f"d{k}", " ".join(r.choice(WORDS[:45]) for _ in range(r.randint(0, 50)))) for k in range(60)]
    docs += [(f"e{k}", f"{' '.join(r.choice(WORDS) for _ in range(30))}\n{(t or '').upper()}, {' '.join(r.choice(WORDS) for _ in range(2000))}") for k, (_, t) in enumerate(items)] + [("n", None), ("d0", "été w1"), ("d0", "été w1")]
    d = spark.createDataFrame([(i, t, "h", 1, "x") for i, t in docs], "doc_id string, text string, __vd_hits string, item_id int, id string")
    b = spark.createDataFrame([(i, t, "h") for i, t in items], f"item_id {kind}, text string, hits string")
    got = decontaminate.contaminated(d, b)
    assert sorted(((x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in got.collect()), key=repr) == brute_contained(docs, items)
    clean = decontaminate.remove(d, b)
    assert clean.columns == d.columns
    dirty = {x[0] for x in brute_contained(docs, items)}
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(i for i, _ in docs if i not in dirty)
    assert decontaminate.remove(d.limit(0), b).count() == 0 and decontaminate.remove(d, b.limit(0)).count() == len(docs)


def test_languages_and_windows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(language, "MOST_TEXTS", 12)
    rows = [(k, f"text number {k}", "en") for k in range(300)] + [(k, "alike", "fr") for k in range(300, 500)] + [(k, f"drei {k}", "de") for k in range(500, 540)] + [(k, "x", f"junk{k}") for k in range(600, 640)]
    got = language._sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 6).collect()
    by = {x: [r["text"] for r in got if r["lang"] == x] for x in {r["lang"] for r in got}}
    assert {x: len(t) for x, t in by.items()} == {"en": 4, "fr": 4, "de": 4}
    long = "é" * 300_000
    windows = spark.createDataFrame([(long,), ("short",), ("",)], "text string").select(language._learned(F.col("text")).alias("w")).collect()
    assert len(windows[0]["w"]) == language.WINDOWS_EACH and all(len(w) == language.WINDOW for w in windows[0]["w"])
    assert [bytes(w) for w in windows[1]["w"]] == [b"short"] and [bytes(w) for w in windows[2]["w"]] == [b""]
    whole = spark.createDataFrame([("a" * 1000,)], "text string").select(language._learned(F.col("text")).alias("w")).collect()[0]["w"]
    assert b"".join(map(bytes, whole)) == b"a" * 1000


def test_convolution_against_plain_loops(spark):
    net = language.Network(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(4)
    net.p["bias"] += rng.normal(0, 0.1, net.p["bias"].shape).astype(np.float32)
    texts = ["plain text", "ä" * 200, "x" * 700, "Ünïcode " * 50, "1234", None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", language.predicted(F.col("text"), net).alias("x")).collect()
    for k, text in enumerate(texts):
        data = (text or "").encode()
        logits = []
        for s in range(0, max(1, len(data)), language.WINDOW):
            w = data[s : s + language.WINDOW].ljust(language.WINDOW, b"\0")
            pooled = []
            for f in range(net.mask.shape[1]):
                width = language.WIDTHS[f // language.FILTERS]
                kernel = net.p["filters"].reshape(language.SPAN, language.EMBEDDING, -1)[:, :, f]
                best = max(sum(float(net.p["table"][w[p + j]] @ kernel[j]) for j in range(width)) for p in range(language.WINDOW - language.SPAN + 1))
                pooled.append(max(0.0, best + float(net.p["bias"][f])))
            logits.append(np.array(pooled) @ net.p["out"] + net.p["out_bias"])
        mean = np.mean(logits, axis=0)
        prob = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        x = got[k]["x"]
        if any(map(str.isalpha, text or "")):
            assert x["lang_pred"] == "abc"[int(prob.argmax())] and abs(x["score"] - prob.max()) < 1e-4
        else:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_urls_by_block_join(spark, monkeypatch, sent):
    monkeypatch.setattr(urls, "SENT", sent)
    monkeypatch.setattr(urls, "KEYS_EACH", 1)
    rows = [(k, f"http://site{k % 50}.org/p{k % 3}/") for k in range(300)] + [(1000 + k, "http://hot.org/x?y=1") for k in range(400)] + [(2000 + k, None) for k in range(300)] + [(5, "no scheme"), (5, "no scheme"), (None, "HTTP://WWW.HOT.ORG/x/")]
    pages = spark.createDataFrame([(i, u, "b", 1) for i, u in rows], "page_id long, url string, block string, n int")
    listed = spark.createDataFrame([("http://hot.org/x",), ("http://site7.org/p1",), (None,), ("junk",)], "url string")
    got = urls.judge(pages, listed, [("allow", "hot.org/none")])
    assert got.count() == len(rows)
    blocked = [x["page_id"] for x in got.where("verdict = 'block'").collect()]
    assert sorted(blocked, key=repr) == sorted([i for i, u in rows if u and ("hot.org" in u.lower() or u == "http://site7.org/p1/")], key=repr)
    assert urls.judge(pages.limit(0), listed, []).count() == 0
    assert urls.judge(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_encoding_keeps_columns_that_clash(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Hello world", "mine"), (2, None, "too")], "doc_id long, text string, __vd_bpe string")
    got = bpe.encode_documents(df, public.path("byte_bpe_50k.json"))
    assert got.columns == [*df.columns, "bpe_ids", "bpe_n_tokens", "bpe_decoded"]
    assert [r["__vd_bpe"] for r in got.orderBy("doc_id").collect()] == ["mine", "too"]
    assert bpe.token_digests(df.limit(0), public.path("byte_bpe_50k.json")).collect() == []


def test_digests_of_the_tokenizers_library(spark):
    import hashlib

    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    spec = json.load(open(path))
    spec["truncation"] = spec["padding"] = None
    plain = tokenizers.Tokenizer.from_str(json.dumps(spec))
    texts = ["Hello world", "", "naïve été 日本 🙂", " two  spaces\n\nlines\t", "don't I'll 12345", "x" * 3000, "<|endoftext|> inside"]
    got = bpe.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in got:
        ids = plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
