"""The pipeline's stages one by one on planted documents, and all of them on an empty table."""

import random

import corpus_pipeline
import pytest

from verdance.llm import language
from verdance.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __vd_lang string, id string"


def save(spark, folder, docs, items):
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages(spark, tmp_path, tokenizer):
    r = random.Random(11)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    words = lambda lang, n: [("".join(r.choice(letters[lang]) for _ in range(6))) for _ in range(n)]
    docs = [(i, " ".join(words(lang, 70)), lang) for i in range(300) for lang in ["aa" if i % 2 else "bb"]]
    near = docs[0][1].split()
    near[40] = "jjjjjj"
    passage, item = " ".join(words("aa", 60)), " ".join(words("aa", 30))
    own = {k: " ".join(words("aa", 20)) for k in (1002, 1003, 1004)}
    docs += [(1000, " ".join(near), "bb"), (1001, docs[2][1], "bb"), (1002, f"{own[1002]}\n{passage}", "aa"), (1003, f"{own[1003]}\n{passage}", None)]
    docs += [(1004, f"{own[1004]} {item} {' '.join(words('aa', 9))}", "aa"), (1005, None, "aa"), (1006, "", None), (1007, "12 !!", "bb")]
    save(spark, tmp_path, docs, [(1, item), (2, None), (3, "")])
    texts, at, kept = {i: t for i, t, _ in docs}, spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, str(tmp_path)), f"test-{name}")
        kept[name] = {x["doc_id"]: x for x in at.collect()}
        if name != "bpe":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars", "__vd_lang", "id"]
    assert set(kept["language"]) == set(texts) - {1005, 1006, 1007}
    assert set(kept["lines"]) == set(kept["language"]) - {1001}
    assert {i: x["text"] for i, x in kept["lines"].items()} == {i: own[1003] if i == 1003 else texts[i] for i in kept["lines"]}
    assert set(kept["lines"]) - set(kept["near_duplicates"]) == {1000}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1004}
    assert set(kept["bpe"]) == set(kept["decontamination"])
    for i, x in kept["bpe"].items():
        ids = tokenizer.encode(kept["decontamination"][i]["text"], add_special_tokens=False).ids
        assert x["bpe_restored"] and x["bpe_n_tokens"] == len(ids) and bytes(x["bpe_ids"]) == b"".join(k.to_bytes(4, "little") for k in ids)


def test_empty_tables(spark, tmp_path, tokenizer):
    save(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "bpe_n_tokens", "bpe_ids", "bpe_restored"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [x["doc_id"] for x in language.reject(docs, language.fit(docs)).collect()] == [1]
