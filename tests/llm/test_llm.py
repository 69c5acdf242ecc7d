"""Training-data operators on small fixtures: brute force, round trips, edge rows."""

import hashlib
import math
import os
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, common, decontam, embed_dedup, graph, langid, licenses, ngram_join, pieces, quality, suffix_dedup, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepare(spark)


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ö", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, empty, null, tiny, long and repeated rows."""
    rng = random.Random(4)
    passage = prose(rng, 40)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    near = base[5].split(" ") if len(base[5]) > 200 else prose(rng, 100).split(" ")
    near2 = near[:]
    near2[len(near2) // 2] = "CHANGED"
    texts = base + [base[3], base[3], " ".join(near), " ".join(near2), None, "", "a", "?!", "x y", "x  Y",
                    base[7] + "\n" + passage, passage + " " + base[8], "the " * 400, "the " * 500, prose(rng, 9000)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], (None, base[1], None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).repartition(5).cache()


def test_chat_round_trip_and_layouts(spark):
    talks = [(1, 0, "user", "hi <|end|> & &lt; [INST]"), (1, 1, "assistant", "</s>yes\n<s>"), (2, 0, "system", None), (2, 1, "user", ""),
             (2, 2, "assistant", "x"), (3, 0, "assistant", "first"), (4, 0, None, "a"), (4, 0, None, "a"), (None, 0, "user", "n"),
             (5, 0, "us\ner", "<|turn|>")]
    df = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of(df)))
    got = out.select("conv_id", "layout", chat.read_back(F.col("formatted")).alias("back"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, _, r, t in talks:
        want.setdefault(c, []).append((r or "", t or ""))
    assert {r.conv_id: [tuple(x) for x in r.back] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    assert {r.conv_id: r.layout for r in got} == {1: "prompt_response", 2: "instruction_input_output", 3: "sharegpt",
                                                  4: "messages", 5: "messages", None: "messages"}


def test_chat_other_layouts_and_unknown(spark):
    df = spark.createDataFrame([(1, '{"question":"q","answer":7}'), (2, '{"other":1}'), (3, None), (4, '{"instruction":"i","output":null}')],
                               "conv_id bigint, j string").select("conv_id", F.expr("parse_json(j)").alias("record"))
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {1: ("question_answer", [("user", "q"), ("assistant", "7")]), 2: ("unknown", []), 3: ("unknown", []),
                   4: ("instruction_output", [("user", "i"), ("assistant", "")])}
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["öst", "ung", "sch"]}
    rows = [(k, " ".join(rng.choice(sound[lang]) * 2 for _ in range(30)), lang, "s", 1) for k in range(200) for lang in [("aa", "bb")[k % 2]]]
    rows += [(900, None, "aa", "s", 0), (901, "12 !?", "bb", "s", 0), (902, "", None, None, None), (None, "ka ka", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(3))
    model = langid.train(df)
    got = langid.predict(df.drop("lang"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].lang_pred == lang for k, _, lang, _, _ in rows[:200])
    assert all(by[k].lang_pred == "und" and by[k].rejected and by[k].score == 0 for k in (900, 901, 902))
    assert by[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in langid.predict(df.filter("doc_id < 5"), None).collect()} == {"und"}


def test_decontamination_parts_and_brute_force(spark, docs):
    rows = corpus()
    items = [(1, " ".join(words_of(rows[7][1] or "")[:15]) or "none"), (2, "x Y"), (2, "x Y"), (3, None), (4, "?"), (None, rows[9][1]), (5, "zz")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = words_of(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[k:k + m]), set()).add("null" if i is None else str(i))
    def brute(text):
        w, hit, ids = words_of(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    ids |= windows[tuple(w[k:k + m])]
        return len(w), len(hit), tuple(sorted(ids))
    want = sorted((str(r[0]), *brute(r[1])) for r in rows)
    for limit in (1 << 20, 1):  # one broadcast, and one for every item
        got = decontam.scan(docs, bench, broadcast_bytes=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, sum(s.end - s.begin for s in r.word_spans), tuple(r["items"])) for r in got) == want
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[3] for w in want)
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "spans").collect()}
    assert all(brute(t)[1] == 0 for t in cut.values()) and cut[44] is None
    assert decontam.scan(docs, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_licenses(spark):
    mit = dict(licenses.LICENSES)["MIT"]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "sub-license").upper()), (2, "Text.\nLicenced under the MIT Licence.\nmore"),
            (3, None), (4, ""), (5, mit + " And more."), (5, "All rights reserved."), (None, "SPDX-License-Identifier: MPL-2.0")]
    got = sorted(((r.doc_id or 0), r.license, tuple(r.notices), r.n_notice_lines) for r in
                 licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit(1))).collect())
    assert got == sorted([(1, "MIT", (), 0), (2, None, ("MIT",), 1), (3, None, (), 0), (4, None, (), 0), (5, None, (), 0),
                          (5, None, ("all-rights-reserved",), 1), (0, "MPL-2.0", ("MPL-2.0",), 1)], key=lambda r: (r[0], r[2] != ()))


def test_license_files(spark):
    """Titles before the body, and body lines that begin with 'copyright'."""
    text = dict(licenses.LICENSES)
    wrapped = text["MIT"].replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE").replace("The above copyright", "The above\ncopyright")
    assert wrapped.count("\n") == 2
    head = {"MIT": ["MIT License", "The MIT License (MIT)\n====="], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License"],
            "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
            "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"]}
    cases = [(k, f"{t}\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n{text[k]}") for k, ts in head.items() for t in ts]
    cases += [(k, "BSD License\n" + re.sub(r" [123]\. ", "\n* ", text[k])) for k in ("BSD-2-Clause", "BSD-3-Clause")]
    cases += [("MIT", wrapped), ("MIT", f"MIT License\nCopyright The Authors\n{wrapped}"), ("MIT", f"Copyright © 2020 Some One\n{wrapped}"),
              ("MIT", f"Copyright The Authors\n{text['MIT']}"), (None, "MIT License"), (None, "MIT License\nCopyright 2020 X"),
              (None, f"MIT License\nCopyright 2020 X\n{text['MIT']}\nCopyright holders may do more."), (None, f"Preface\nMIT License\n{text['MIT']}")]
    # the loose rule (no line that begins with 'copyright') still finds this one, as before
    cases[-2] = ("MIT", cases[-2][1].replace("MIT License\n", ""))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(cases))] == [k for k, _ in cases]


@pytest.mark.parametrize("name, want", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"),
                                        ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_license_texts(spark, name, want):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no common licence texts here")
    with open(path) as f:
        text = f.read()
    rows = [(0, text), (1, "\r\n".join(text.replace("[yyyy] [name of copyright owner]", "2020 Some One").split("\n"))), (2, text + "\nmore"),
            (3, " ".join(x for x in text.split("\n") if not x.strip().startswith(("Copyright (", "Copyright ["))))]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == got[1] == got[3] == want and got[2] is None


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = []
    for k in range(300):
        v = base[k % 60] * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0.05, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] * 16, 1),
             (305, [None] * 16, 1), (306, [], 1), (307, rows[0][1][:5], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("x"))
    ok = [k for k, r in enumerate(rows) if r[1] and r[2] is not None and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    adj = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    adj[a].add(b)
    want = []
    for k in adj:
        seen, todo = {k}, [k]
        while todo:
            for y in adj[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        want.append((str(rows[k][0]), len(adj[k]), str(min((rows[x][0] for x in seen if rows[x][0] is not None), default=None))))
    got = [(str(r.vec_id), r.n_links, str(r.component)) for r in embed_dedup.near_duplicates(df, block=8).collect()]
    assert sorted(got) == sorted(want)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_itq_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    itq = embed_dedup.learn(x, 3000, 0.93, 0.995)
    u = embed_dedup.unit(x)
    side = rng.normal(size=u.shape)
    side = embed_dedup.unit(side - (side * u).sum(axis=1, keepdims=True) * u)
    met = (itq.keys(u) == itq.keys(0.93 * u + math.sqrt(1 - 0.93 ** 2) * side)).any(axis=1).mean()
    assert met >= 0.97


def test_itq_recall_of_large_groups():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    u = embed_dedup.unit(x)
    side = rng.normal(size=u.shape)
    side = embed_dedup.unit(side - (side * u).sum(axis=1, keepdims=True) * u)
    for largest in (1 << 20, 1 << 24):
        itq = embed_dedup.learn(x, largest, 0.93, 0.995)
        met = (itq.keys(u) == itq.keys(0.93 * u + math.sqrt(1 - 0.93 ** 2) * side)).any(axis=1).mean()
        assert met >= 0.99 and itq.tables <= 64
    assert embed_dedup.learn(x[:, :1], 1 << 24, 0.93, 0.995).tables == 1
    with pytest.raises(ValueError):
        embed_dedup.learn(x, 1 << 24, 0.1, 0.995, most_tables=2)


def test_components_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def ngram_brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None)
    adj = [{b for b in range(len(rows)) if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
           for a in range(len(rows))]
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for y in adj[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out.append((str(rows[k][0]), len(adj[k]), str(min((rows[x][0] for x in seen if rows[x][0] is not None), default=None))))
    return sorted(out)


def test_ngram_join_against_brute_force(spark, docs):
    want = ngram_brute(corpus())
    for block in (512, 2):
        got = sorted((str(r.doc_id), r.n_links, str(r.component)) for r in ngram_join.join(docs, block=block).collect())
        assert got == want
    kept = ngram_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) == len({w[2] for w in want})
    assert ngram_join.join(docs.limit(0)).count() == 0
    assert 1 - (1 - 0.8 ** ngram_join.prefix_depth(0.8)) ** ngram_join.TREES >= 0.9995


def test_forest_shortens_until_the_recall():
    t = Fraction(4, 5)
    for n in range(1, 31):
        sims = {Fraction(i, n + m - i) for m in range(1, 60) for i in range(min(n, m) + 1)}
        assert ngram_join.lowest_similarity(n, t) == min((x for x in sims if t <= x < 1), default=None), n
    for sim in (0.8, 5 / 6, 0.9, 0.99):
        k = ngram_join.ascent(sim)
        met = [1 - math.prod(1 - sim ** d for d in ngram_join.depths(x)) for x in (k, max(k - 1, 0))]
        assert met[0] >= ngram_join.RECALL and (k == 0 or met[1] < ngram_join.RECALL)
    deep = [ngram_join.depths(k) for k in range(ngram_join.TREES * (ngram_join.MAX_DEPTH - 1) + 1)]
    assert all(x <= y for a, b in zip(deep, deep[1:]) for x, y in zip(b, a))  # one order for all classes


def test_forest_links_small_sets_and_one_hot_prefix(spark):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base[:40 + k]) for k in range(41)] + [" ".join(base[k:k + 9 + k % 7]) for k in range(60)]
    texts += [" ".join(rng.sample(base, rng.randint(5, 12))) for _ in range(60)]
    texts += [" ".join(base[:k]) for k in range(5, 40)]  # sets of 1, 2, 3 ... shingles, each in the next
    rows = [(k, x, "en", "s", len(x)) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for block in (512, 8):
        got = sorted((str(r.doc_id), r.n_links, str(r.component)) for r in ngram_join.join(docs, block=block).collect())
        assert got == ngram_brute(rows)


def passages_brute(rows, window=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1) if i is not None else ():
            first[b[k:k + window]] = min(i, first.get(b[k:k + window], i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1) if i is not None else ():
            if first[b[k:k + window]] < i:
                gone[k:k + window] = b"\x01" * window
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_suffix_dedup_against_brute_force(spark, docs):
    want = passages_brute(corpus())
    for more in ({}, {"hot_docs": 1}, {"spool_rows": 50}):
        got = suffix_dedup.repeated_passages(docs, **more).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    left = suffix_dedup.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert left.count() == sum(not (w[2] and w[2] == w[1]) for w in want)
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_suffix_dedup_window_in_two_phases(spark):
    """A run of equal grams is thinned from its own start: each text keeps other anchors of the common window."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    least = sorted((word(16) for _ in range(4000)), key=lambda x: suffix_dedup.gram_hashes(np.frombuffer(x.encode(), np.uint8))[0])
    rows = []
    for k, gram in enumerate(least[:8]):
        shared = f"{gram}1{gram}2{gram}"
        rows += [(2 * k, word(60) + shared + word(60)), (2 * k + 1, word(60) + f"{gram}3{shared}4{gram}" + word(60))]
    want = passages_brute(rows)
    assert [w[2] for w in sorted(want, key=lambda w: int(w[0]))] == [0, 50] * 8
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_collection_bwt_classes():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 30))).encode() for _ in range(60)]
    name, size, cls = suffix_dedup.Collection(strings, 1 << 20).equal_windows(4)
    by = {}
    for n, s, c in zip(name, size, cls):
        by.setdefault(c, set()).add(strings[n][len(strings[n]) - s:][:4])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set().union(*by.values()))
    assert len(name) == sum(max(0, len(s) - 3) for s in strings)


def test_pieces_equal_library_and_round_trip(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = pieces.Pieces(path)
    rng = random.Random(6)
    texts = [r[1] for r in corpus()] + ["  a  b ", "\ta\n", "日本語😀", "a▁b", "<s>", "z" * 900, " "] + \
        ["".join(rng.choice("ab é\n日xyz ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    memo = {}
    got = p.encode([t or "" for t in texts], memo)
    assert [g.tolist() for g in got] == p.sp.encode([t or "" for t in texts])
    long = " ".join(["word  wörd"] * 200_000)
    assert p.encode([long], memo)[0].tolist() == p.sp.encode(long)
    out = pieces.encode(docs, path)
    assert out.filter(~F.col("round_trip")).count() == 0
    back = pieces.decode(out.select("doc_id", "ids"), path).filter("doc_id = 0").first()
    assert back.text == corpus()[0][1]


def test_viterbi_against_brute_force(spark):
    table = [("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("ba", 4, -4.0), ("aba", 5, -5.5), ("bb", 6, -1.5)]
    score = {p: s for p, _, s in table}
    def best(w):
        if not w:
            return 0.0
        return max(score.get(w[:k], -100.0 if k == 1 else -1e9) + best(w[k:]) for k in range(1, min(3, len(w)) + 1))
    rng = random.Random(8)
    ws = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(40)})
    got = pieces.viterbi_words(spark.createDataFrame([(w,) for w in ws], "word string"), spark.createDataFrame(table, "piece string, id int, score double"), 3).collect()
    name = {i: p for p, i, _ in table}
    assert {r.word for r in got} == set(ws)
    for r in got:
        assert r.score == pytest.approx(best(r.word))
        assert len("".join(name.get(i, "c") for i in r.ids)) == len(r.word)


def test_token_counts_and_resynchronisation(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [r[1] for r in corpus()] + ["<|endoftext|> it's 12,5", "x" * 3000, "é" * 500 + " á b", "\x1c a b c", "日本" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {k: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for k, t in enumerate(texts)}
    for chunk, overlap in ((32_768, 512), (200, 8)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path, chunk, overlap).collect()}
        assert got == want
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 60) if k % 3 else " ".join(["spam"] * 40) + " ***" * 9, "en", "s", 1) for k in range(300)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None), rows[4]]
    df = spark.createDataFrame(rows, DOCS).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(1, None), (None, 1), (7, 5)], "doc_id bigint, quality int")
    model = quality.train(df, labels)
    got = quality.keep_best(quality.score(df, model), 0.2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert quality.score(df, quality.train(df, labels.limit(0))).agg(F.min("score")).first()[0] == pytest.approx(0.5)
    assert quality.keep_best(quality.score(df.limit(0), model)).count() == 0


def test_quality_long_lines():
    """Lines of any length count as repeats only if all their bytes are equal."""
    cut = quality._CUT
    a, b = b"a" + b"x" * (3 * cut), b"b" + b"x" * (3 * cut)
    edge, over = b"y" * cut, b"y" * (cut + 1)
    for lines in ([a, b], [a, a, b], [b"s", a, b"s", a, b], [edge, b"z", edge, over, b"", over, edge], [a, b"", b""], [b"q" * 7, over, over], [b"", a + b"1", a + b"2", b"x"]):
        got = quality.shape(np.frombuffer(b"\n".join(lines), np.uint8))[7]
        assert got == len(set(lines)) / len(lines)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 2 and words_of(r[1])]
    rows = [(k, t, ("en", "de")[k % 2], "s", len(t)) for k, (_, t, *_) in enumerate(rows)]
    item = prose(rng, 25)
    rows.append((len(rows), prose(rng, 30) + " " + item, "en", "s", 1))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()}
    left = [r for r in rows if r[0] in kept]
    first = {int(c) for _, _, c in ngram_brute(left)}
    left = [r for r in left if r[0] in first]
    gone = {int(w[0]): w for w in passages_brute(left)}
    want = {r[0] for r in left if not (gone[r[0]][2] and gone[r[0]][2] == gone[r[0]][1]) and item not in r[1]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    p = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        if gone[r.doc_id][2] == 0:
            assert list(r.ids) == p.sp.encode(rows[r.doc_id][1])
