"""Phrase mining, token-id files and the Merkle manifest on small fixtures: brute force, round trips, edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import common, merkle, phrases, registry, token_counts, token_store

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


def clashing(df):
    for c in ("id", "h", "r", "k", "f", "phrase", "rank", "tree", "pos", "n", "digest", "part", "row", "claim", "leaf", "task", "file", "start"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def corpus():
    rng = random.Random(3)
    words = ["The", "the", "of", "New", "york", "ñu", "x\x00y", "a-b", "'q'", "deep", "Learning", "machine"]
    def text(n):
        out = []
        for _ in range(n):
            out.append(rng.choice(["new  York city", "deep\tlearning model", "of the", " ".join(rng.choices(words, k=3))]))
            out.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]))
        return "".join(out)
    texts = [text(rng.randint(1, 40)) for _ in range(60)] + [None, "", " ", "...", "word", "<|endoftext|> a<|endoftext|>b", "tab\tend\t", "é" * 50, text(2000)]
    rows = [(k, t, rng.choice(["en", "fr", None, "und"]), rng.choice(["s", "s", "t", None, ""]), len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[1], "en", None, None), (None, None, None, None, None), (-7, texts[2], "en", "neg", 1), (1 << 62, "far", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(corpus(), DOCS)).repartition(5).cache()


def brute_phrases(rows, threshold, max_words=5, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und" if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOW)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    many = {p: c for p, c in f.items() if c >= threshold}
    inner = {}
    for (lang, p), c in many.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i:i + k]] = max(inner.get((lang, p[i:i + k]), 0), c)
    out = {}
    for (lang, p), a in many.items():
        if len(p) > 1 and inner.get((lang, p), 0) < a:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, l, rr, n[lang], -s) for lang, v in out.items() for r, (s, a, p, l, rr) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("threshold,top,bits,held", [(3, 2000, 27, 1 << 21), (2, 5, 20, 50), (12, 2000, 21, 1)])
def test_phrases_brute_force(docs, threshold, top, bits, held):
    got = phrases.collocations(docs, threshold=threshold, top=top, filter_bits=bits, held=held).collect()
    want = brute_phrases(corpus(), threshold, top=top)
    assert sorted(tuple(r) for r in got) == want and len(want) > 3


def test_phrases_long_text_in_cuts(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["aa", "b", "ccc", "dd.", "e\tf"]) for _ in range(3000))
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
    cols = [phrases.Segment(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64), 0, 0)]
    import pyarrow as pa
    cut = list(phrases.segments(pa.array([text]), 5))
    lang = np.array([7], np.uint64)
    for k in range(1, 6):
        want = Counter(cols[0].keys(np.flatnonzero(cols[0].windows(k)), k, lang).tolist())
        assert len(cut) > 20 and Counter(x for s in cut for x in s.keys(np.flatnonzero(s.windows(k)), k, lang).tolist()) == want


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.repeat(np.arange(20, dtype=np.uint64), 100), rng.integers(100, 1 << 40, 30000, dtype=np.uint64)])
    rng.shuffle(keys)
    mg = phrases.MisraGries(len(keys) // 100 + 1)
    for lo in range(0, len(keys), 500):
        mg.merge([np.unique(keys[lo:lo + 500], return_counts=True)])
        assert len(mg.keys) <= mg.capacity
    assert 0 < mg.cut < 100 and set(range(20)) <= set(mg.at_least(100).tolist())


def test_phrases_big_numbers_and_empty(spark, docs, monkeypatch):
    assert phrases.collocations(docs.limit(0)).count() == 0
    rows = [("en", 0, "", 10 ** 13), ("en", 1, "a", 9 * 10 ** 12), ("en", 1, "b", 8 * 10 ** 12), ("en", 2, "a b", 7 * 10 ** 12)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: spark.createDataFrame(rows, "lang string, k int, phrase string, f bigint"))
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert got == [("en", 1, "a b", 7 * 10 ** 12, 9 * 10 ** 12, 8 * 10 ** 12, 10 ** 13, 1000 * 7 * 10 ** 25 // (72 * 10 ** 24))]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 3), (1000, 10 ** 6), (70000, 10 ** 9), (3000, 2000), (0, 1), (300, 2 ** 62)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = token_store.EliasFano.encode(v, u)
        assert (e.slice(0, n) == v).all()
        for _ in range(20 if n else 0):
            i = int(rng.integers(0, n))
            j = int(rng.integers(i, n + 1))
            assert (e.slice(i, j) == v[i:j]).all() and e.select(i) == v[i]
        assert 8 * (len(e.low) + len(e.high)) <= n * (2 + np.log2(max(1, u / max(1, n))) + 1) + 24


@pytest.mark.parametrize("shard_ids,read_docs", [(1 << 27, 1 << 14), (300, 3), (1, 1)])
def test_token_files_round_trip(spark, docs, shard_ids, read_docs):
    folder = token_store.shared_folder(spark, "ids-test")
    token_store.write_ids(docs, folder, BPE, shard_ids=shard_ids)
    got = sorted(token_store.read_ids(spark, folder, read_docs).collect(), key=lambda r: r.start)
    tok = token_counts.tokenizer(BPE)
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    rows = corpus()
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r[0], ids(r[1])) for r in rows)


def test_token_files_random_access_empty_and_refusal(spark, docs):
    folder = token_store.shared_folder(spark, "ids-test")
    listed = token_store.write_ids(docs.repartition(1), folder, BPE).collect()
    store, root = token_store._open(folder)
    with store.open_input_file(f"{root}/{listed[-1].file}") as f:
        shard = token_store.Shard(f)
        last = shard.document(shard.n - 1)
        assert shard.document_ids(shard.n - 1, shard.n) == [1 << 62] and last[-1] == 0 and len(last) == 2
    folder = token_store.shared_folder(spark, "ids-test")
    assert token_store.write_ids(docs.limit(0), folder, BPE).count() == 0 and token_store.read_ids(spark, folder).count() == 0
    with pytest.raises(ValueError):
        token_store.write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"))


def brute_merkle(rows):
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    made = {}
    for i, t, lang, s, n in rows:
        full = leaf((i, s, lang, n, t))
        claim = leaf((i, s, lang, n, t and t.translate(LOW))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else full
        made.setdefault((s is not None, (s or "").encode()), []).append(((i is not None, i or 0), full, claim))
    def tree(nodes):
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, p in enumerate(at):
                lo = p - p % 16
                paths[k].append((p - lo, level[lo:p] + level[p + 1:lo + 16]))
                at[k] = p // 16
            level = [H("".join(level[k:k + 16])) for k in range(0, len(level), 16)]
        return level[0], paths
    names = sorted(made)
    subs = [tree([x[1] for x in sorted(made[s])]) for s in names]
    root, over = tree([s for s, _ in subs])
    out = []
    for name, (sub, paths), up in zip(names, subs, over):
        for (i, full, claim), path in zip(sorted(made[name]), paths):
            cur = claim
            for p, others in path + up:
                cur = H("".join(others[:p] + [cur] + others[p:]))
            out.append((i[1] if i[0] else None, full, sub, root, H("".join(x for _, o in path + up for x in o)), cur, cur == root))
    return out


def test_merkle_brute_force(spark, tmp_path):
    many = [(1000 + k, f"Text {k % 7}", "en", ("s", f"q{k % 40}")[k % 2], k) for k in range(700)]
    rows = corpus() + many
    path = str(tmp_path)
    clashing(spark.createDataFrame(rows, DOCS)).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = registry.queries()["op13_merkle_manifest"](spark, path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_merkle(rows))


def test_merkle_proofs_and_edges(spark):
    lone = spark.createDataFrame([(5, None, "ab" * 32, None)], "id bigint, source string, leaf string, claim string")
    row = merkle.prove(lone, with_proofs=True).first()
    assert row.subroot == row.root == row.folded_root == row.leaf and row.verified and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.prove(lone.limit(0)).count() == 0
    many = spark.range(300).select("id", (F.col("id") % 3).alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("claim"))
    seen = set()
    for height in (1, 2, 3):
        rows = merkle.prove(many, with_proofs=True, height=height).collect()
        assert len(rows) == 300 and all(r.verified and merkle.fold(r.leaf, merkle.unpack_proof(bytes(r.proof))) == r.root for r in rows)
        seen.add(tuple(sorted(rows)))
    assert len(seen) == 1


def test_wrappers_return_their_contract(spark, tmp_path):
    path = str(tmp_path)
    clashing(spark.createDataFrame(corpus(), DOCS)).write.parquet(f"{path}/documents.parquet")
    q = registry.queries()
    assert q["op11_phrase_collocations"](spark, path).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = q["op12_token_store"](spark, path)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    tok = token_counts.tokenizer(BPE)
    want = Counter((r[0], zlib.crc32(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in corpus())
    assert Counter((r.doc_id, r.ids_crc32) for r in got.collect()) == want
