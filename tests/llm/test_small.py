"""Hard cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import exact_dedup, huffman, langid, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, url_filter
from glyphloom.llm.tokens import Encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["node", "u", "score", "gone", "copies", "epochs", "h", "ids", "part"]


def words(n, seed, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    shared = words(30, 1)
    data = [(0, None), (1, ""), (2, " \n\t"), (3, "A b c"), (4, "a B C"), (5, words(9000, 2)), (6, f"{shared}\n{words(40, 3)}"), (7, f"{words(40, 4)}\n{shared}"), (7, f"{words(40, 4)}\n{shared}"), (8, words(60, 5)), (9, words(60, 5)), (10, words(60, 5) + " extra"), (None, words(60, 5)), (11, "日本語 12 'tis <|endoftext|> İx"), (12, "12 34 !!")]
    rows = [(i, t, random.Random(k).choice(["en", "de", None]), random.Random(k + 9).choice(["a", "b", None]), None) for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(-1) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_the_library(name, kind):
    e = Encoder(vocabulary(name), kind, cache=50)
    r = random.Random(3)
    texts = ["", " ", "  a", "\n x", "it's we're", "a!!  ?b 12ab", "İx!! ÀÉ× ÷", "<|endoftext|> x", "日本 語", "é\tè\r\n", "x y"]
    texts += ["".join(r.choice(" \n\ta1b!É.'<|éx  ") for _ in range(r.randrange(40))) for _ in range(600)]
    raw = [t.encode() for t in texts]
    ids, cut = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    for i, t in enumerate(texts):
        assert e.tokenizer.encode(t, add_special_tokens=False).ids == ids[cut[i] : cut[i + 1]].tolist()


def test_remembered_pre_tokens_are_small():
    e = Encoder(vocabulary("word_bpe_49k.json"), "word")
    text = " ".join(f"{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}y{chr(97 + i // 676 % 26)}z{chr(97 + i // 17576)}" for i in range(60_000)).encode()
    tracemalloc.start()
    ids, _ = e.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == e.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    n, before = len(e.at), tracemalloc.get_traced_memory()[0]
    e._forget()
    assert n >= 60_000 and (before - tracemalloc.get_traced_memory()[0]) / 60_000 < 100
    tracemalloc.stop()


def test_huffman_lengths_and_round_trip(spark, odd, empty, tmp_path):
    counts = np.array([0, 1, 1, 2, 4, 8, 1 << 20, 3])
    lengths = huffman.limited_lengths(counts, 5)
    assert lengths[0] == 0 and lengths.max() <= 5 and sum(2.0**-n for n in lengths[lengths > 0].tolist()) == 1
    ids = np.random.default_rng(1).choice([1, 2, 3, 4, 5, 6, 7], 1000)
    _, codes = huffman.canonical(lengths)
    bits, lanes = huffman.pack_bits(ids, lengths, codes)
    assert (huffman.Decoder(lengths)(bits, lanes, 1000) == ids).all()
    huffman.encode_corpus(odd, f"file://{tmp_path}/h", vocabulary("byte_bpe_50k.json"))
    got = sorted(collected(huffman.decode_corpus(spark, f"file://{tmp_path}/h")), key=lambda r: r["start"])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted((np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in odd.collect()))
    assert sorted(bytes(r["ids"]) for r in got) == want
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] is None for r in got].index(True) == 0 and [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    huffman.encode_corpus(empty, f"file://{tmp_path}/e", vocabulary("byte_bpe_50k.json"))
    assert not collected(huffman.decode_corpus(spark, f"file://{tmp_path}/e"))


def test_packing(odd, empty):
    got = collected(packing.pack_documents(odd, vocabulary("word_bpe_49k.json")))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))] and sum(r["length"] for r in rows) <= 2048
    docs = defaultdict(int)
    for r in got:
        docs[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert docs[0, 1] == docs[1, 1] == docs[2, 1] == 1 and all(n % k[1] == 0 for k, n in docs.items())
    assert not collected(packing.pack_documents(empty, vocabulary("word_bpe_49k.json")))
    assert [len(w) for _, w in packing.packed([2048] * 3)] == [1, 1, 1] and packing.packed([]) == []


def test_exact_duplicates(spark, odd, empty):
    got = collected(exact_dedup.exact_duplicates(odd))
    text = {(r["text_sha256"]): [] for r in got}
    for r in got:
        text[r["text_sha256"]].append(r)
    for rows in text.values():
        assert {r["group_size"] for r in rows} == {len(rows)} and sum(r["kept"] for r in rows) == 1
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert {r["keep_id"] for r in rows} == {max(ids, default=None)}
    assert not collected(exact_dedup.exact_duplicates(empty))
    hot = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "same").otherwise(F.col("id").cast("string")).alias("text"))
    r = exact_dedup.exact_duplicates(hot, keep="min").where("group_size > 1").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"), F.min("group_size").alias("g"), F.max("keep_id").alias("i")).first()
    assert (r.n, r.k, r.g, r.i) == (400, 1, 400, 0)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/1", "https://a.example.com/en/2?x", "http://x.net/es/3#f", "http://x.net/es", "http://x.net/de/4", "http://x.org", "http://b.com/a/b/c/d/e", "http://x.net/es/3#f"] + [f"http://x.net/fr/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in collected(url_filter.url_verdicts(pages))}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[4] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[5][2:] == ("net/es/", "block") and got[6][2] is None and got[7] == ("x.net", "/de/4", None, "allow") and got[8] == ("x.org", "", None, "allow")
    assert got[9][2:] == ("com/", "allow") and len(got) == len(urls)
    assert not collected(url_filter.url_verdicts(pages.limit(0)))


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    marked = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines, dup, past = t.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in past
            past.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality_rules(spark, odd, empty):
    r = random.Random(5)
    loop = words(12, 7)
    texts = [" ".join([loop] * 4), f"x y\n{loop}\nx y\n x y\nx y", "#a $$ é ü <b>\x1c c", *("".join(r.choice("ab \n#é\t") for _ in range(r.randrange(200))) for _ in range(40)), *(" ".join(r.choice("ab") for _ in range(60)) for _ in range(10))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in collected(quality_rules.quality_verdicts(df, None)):
        want = brute_statistics(texts[row["doc_id"]])
        assert tuple(row[c] for c in quality_rules.COUNTS) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert len(collected(quality_rules.quality_verdicts(odd, None))) == 15 and not collected(quality_rules.quality_verdicts(empty, None))


def test_trees_keep_monotone_constraints():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 2))
    y = (x[:, 0] + 0.5 * np.sin(4 * x[:, 0]) + 0.3 * r.normal(size=1500) < 0).astype(int)
    t = quality_rules.grown(x, y, np.ones(1500), np.array([-1, 0]), trees=30)
    line = np.stack([np.linspace(-3, 3, 300), np.zeros(300)], 1)
    assert (np.diff(t.scores(line)) <= 1e-12).all() and ((t.scores(x) > 0.5) == y).mean() > 0.85


def test_classifiers_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = collected(quality_classifier.quality_scores(odd, quality_classifier.fitted(odd, labels)))
    assert len(got) == 15 and {r["score"] for r in got} == {0.5}
    assert quality_rules.fitted(odd, labels) is None and langid.fitted(empty) is None
    texts = [(i, " ".join(random.Random(i).choices(["ab", "bc", "abc"] if i % 2 else ["xy", "yz", "xyz"], k=40)), "l1" if i % 2 else "l2") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fitted(docs)
    own = collected(langid.languages(docs, model))
    assert sum(r["lang"] == r["lang_pred"] for r in own) >= 198 and all(0 <= r["score"] <= 1 for r in own)
    got = {r["text"]: r for r in collected(langid.languages(odd, model))}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got["12 34 !!"]["lang_pred"] == "und" and got[None]["score"] == 0 and got[None]["rejected"]
    assert not collected(langid.languages(empty, model)) and {r["lang_pred"] for r in collected(langid.languages(odd, None))} == {"und"}


def test_line_dedup(spark, odd, empty):
    assert line_dedup.patience([1, 2, 3, 4], [0, 2, 3, 9, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([1, 1, 2], [1, 1, 1, 2]) == [(0, 0), (1, 1), (2, 3)]
    got = collected(line_dedup.deduplicated_lines(odd))
    assert len(got) == 15 and set(odd.columns) < set(got[0])
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[0][0]["text"] is None and by[1][0]["text"] == "" and by[6][0]["n_removed"] == 0
    assert [r["text"] for r in by[7]] == [words(40, 4)] * 2 and by[8][0]["n_removed"] == 0 and by[9][0]["text"] == "" and by[10][0]["n_removed"] == 0
    assert by[None][0]["text"] == words(60, 5) and not collected(line_dedup.deduplicated_lines(empty))


def test_mixing(spark, odd, empty):
    got = collected(mixing.mixed(odd, max_epochs=3))
    assert all(1 <= r["copies"] <= 4 for r in got) and set(CLASH) <= set(got[0]) and not collected(mixing.mixed(empty))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(words(10, 1)).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 1500, "big").otherwise("s").alias("source"))
    total = mixing.mixed(docs, share=0.5, max_epochs=1).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).first().n
    assert 9900 <= total <= 10000


def brute_components(data, size=5):
    sets, parent = {}, {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("cap", [16, 3])
def test_ngram_join_equals_brute_force(spark, odd, empty, cap):
    r = random.Random(cap)
    pool = [f"w{i}" for i in range(2000)]
    data = []

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1])] = r.choice([[], [r.choice(pool)]])
            w = w or ["w"]
        return w

    passage = r.choices(pool, k=40)
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 10, 15, 30, 80, 300]:
        base = r.choices(pool, k=n)
        data += [base] + [edited(base, r.randint(0, max(1, n // 20))) for _ in range(4)]
    base = r.choices(pool, k=90)
    data += [edited(base, r.randint(0, 4)) for _ in range(60)] + [r.choices(pool, k=8) + passage + r.choices(pool, k=r.choice([0, 4, 8, 30])) for _ in range(60)]
    data = [(i, " ".join(w)) for i, w in enumerate(data)] + [(900, ""), (901, None), (902, "A b"), (903, "a  B\n")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in collected(ngram_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string"), cap=cap))}
    assert got == brute_components(data)
    if cap == 16:
        rows = collected(ngram_join.similar_documents(odd))
        by = {x["doc_id"]: x["component_id"] for x in rows}
        assert len(rows) == 15 and by[4] == 3 and by[9] == by[10] == 8 and by[0] == 0 and by[None] is None and by[7] == 7
        assert not collected(ngram_join.similar_documents(empty))


def test_crc_of_ids(spark):
    ids = np.array([1, 2, 70000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(ids)


def test_blocks_link_what_brute_force_links(spark, monkeypatch):
    r = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    passage = r.choices(pool, k=60)
    data = [(i, " ".join([*r.choices(pool, k=r.randint(4, 9)), *passage, *r.choices(pool, k=r.randint(0, 9))])) for i in range(120)]
    data += [(200 + i, data[i * 7][1] + " more") for i in range(12)]
    seen = []
    monkeypatch.setattr(ngram_join, "SHORT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    monkeypatch.setattr(ngram_join, "LEAST", 1)
    whole = ngram_join.compared
    monkeypatch.setattr(ngram_join, "compared", lambda held, *more: seen.append((out := whole(held, *more)).count()) or out)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in collected(ngram_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string"), cap=3))}
    assert got == brute_components(data) and seen
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5], [9], [1, 2, 3, 4, 6])]
    every = np.arange(5)
    found = ngram_join.block_links(np.array([len(x) for x in sets]), np.concatenate(sets), np.array([0, 1, 2, 3, 1]), every, every, 75)
    assert {frozenset(x) for x in found} <= {frozenset(x) for x in [(0, 1), (1, 2), (0, 4)]} and len(found) == 2


@pytest.mark.parametrize("short", [64, 8])
def test_ngram_join_counts_all_links(spark, monkeypatch, short):
    r = random.Random(21)
    pool = [f"w{i}" for i in range(3000)]
    passage, base = r.choices(pool, k=60), r.choices(pool, k=70)
    data = [(i, " ".join([*r.choices(pool, k=r.randint(2, 9)), *passage, *r.choices(pool, k=r.randint(0, 9))])) for i in range(90)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(pool)
        data.append((200 + i, " ".join(w)))
    data += [(300 + i, " ".join(r.choices(pool, k=30))) for i in range(10)] + [(400, data[0][1] + " more"), (401, data[0][1])]
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in data}
    distinct = set(sets.values())
    want = {i: sum(1 for y in distinct if y != x and 100 * len(x & y) >= 75 * len(x | y)) for i, x in sets.items()}
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    monkeypatch.setattr(ngram_join, "LEAST", 1)
    rows = collected(ngram_join.similar_documents(spark.createDataFrame(data, "doc_id long, text string"), cap=3))
    assert {x["doc_id"]: x["n_links"] for x in rows} == want
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == brute_components(data)
