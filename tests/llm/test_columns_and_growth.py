"""Stages keep any column, repeated rows and texts without boundaries cost linear work, many languages are learnt."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import common, decontam, langid, registry, suffix_dedup, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
NAMES = ["items", "n_words", "word_spans", "byte_spans", "copy", "spans", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_key", "_id", "_text",
         "score", "rejected", "lang_pred", "ids", "round_trip", "node", "key", "component", "n_links", "text_hash", "places", "doc", "rows", "a.b", "with space"]


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


def sample(rng):
    sound = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["öst", "ung", "sch", "ar"]}
    return [(k, " ".join("".join(rng.choices(sound[lang], k=3)) for _ in range(rng.randint(20, 60))), lang, "s", None)
            for k in range(60) for lang in [("aa", "bb")[k % 2]]]


def test_stages_and_pipeline_keep_any_column(spark, tmp_path):
    rows = sample(random.Random(2))
    rows += [(60, rows[4][1], "aa", "s", 1), (61, None, None, None, None), rows[7]]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES]).repartition(3)
    bench = [(1, " ".join(rows[9][1].split()[:12]))]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    last = len(corpus_pipeline.STAGES) - 1
    piped = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, piped):
            out = stage(spark, given, str(tmp_path))
            new = ["ids", "round_trip"] if k == last else []
            names = [c for c in docs.columns if c not in new and (k < last or c != "text")]
            assert [c for c in out.columns if c not in new] == names and set(new) <= set(out.columns), name
            got = out.collect()
            assert got and all(r[c] == f"{c}:{r.doc_id}" for r in got for c in NAMES if c not in new), name
        piped = common.cut(out, "piped")
    left = decontam.decontaminate(docs, spark.createDataFrame(bench, "item_id bigint, text string"), "spans")
    assert left.columns == docs.columns and all(r[c] == f"{c}:{r.doc_id}" for r in left.collect() for c in NAMES if r.doc_id is not None)


def test_repeated_rows_of_one_id_cost_linear_work(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    other = text[:700] + "".join(rng.choice("xyz") for _ in range(300))
    took = {}
    for r in (300, 600):
        docs = spark.createDataFrame([(5, text)] * r + [(9, other), (2, "short")], "doc_id bigint, text string")
        t0 = time.time()
        got = suffix_dedup.repeated_passages(docs).collect()
        took[r] = time.time() - t0
        assert sorted((x.doc_id, x.n_removed, x.n_spans) for x in got) == sorted([(5, 0, 0)] * r + [(9, 700, 1), (2, 0, 0)])
    assert took[600] < 1.5 * took[300] + 5


def test_texts_without_boundaries(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    texts = ["日本" + "".join(rng.choice("語文字列長") for _ in range(n)) for n in (10, 900, 40_000)] + ["x" * 5000 + " y" * 4000, "é" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, chunk=256, overlap=16).collect()}
    tok = token_counts.tokenizer(path)
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    # characters encoded for 10 M without a boundary, by the sizes of the rounds
    n, wide, total = 10_000_000, 512, 0
    while True:
        chunk = max(32_768, 8 * wide)
        count = 1 if wide >= n else -(-n // chunk)
        total += n + 2 * wide * (count - 1)
        if count == 1:
            break
        wide *= 8
    assert total <= 8 * n
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_more_than_256_languages(spark):
    rng = random.Random(3)
    rows = [(k, f"{chr(0x4E00 + 7 * (k % 300))}" * 20 + " " + rng.choice("abc"), f"l{k % 300}", "s", 1) for k in range(1200)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert len(model.langs) > 290  # those with a row that is not held out
    got = langid.predict(spark.createDataFrame(rows[:300], DOCS), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 200


def test_earlier_wrappers_return_their_contract(spark, tmp_path):
    path = str(tmp_path)
    rows = sample(random.Random(5)) + [(900, None, None, None, None), (901, "", "aa", "s", 0)]
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    want = {"op2_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op6_sentencepiece": {"doc_id", "n_pieces", "ids_sha256", "round_trip"},
            "op7_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op8_ngram_join": {"doc_id", "n_links", "class_id", "kept"},
            "op9_quality_ranking": {"doc_id", "held_out", "score", "predicted"}, "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}}
    import zlib
    for name, columns in want.items():
        out = registry.queries()[name](spark, path)
        got = {r.doc_id: r for r in out.collect()}
        assert columns <= set(out.columns) and set(got) == {r[0] for r in rows}, name
        if "held_out" in columns:
            assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items()), name
        if name == "op2_language_id":
            assert got[900].lang_pred == got[901].lang_pred == "und" and sum(got[k].lang_pred == lang for k, _, lang, *_ in rows[:60]) >= 55
        if name == "op9_quality_ranking":
            assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
        if name == "op7_token_counts":
            assert got[900].n_tokens == 0 and not got[900].over_limit
