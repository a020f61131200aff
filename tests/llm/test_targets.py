"""Target weights of the mix against iterative water-filling; samples of many classes; ids of equal documents; the shared folder."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import common, huffman, mixing, quality_classifier, sampling
from glyphloom.llm.tokens import vocabulary


def filled(budget, nodes):
    """Budgets of nodes {name: (weight, capacity)}: fill whoever is over, give the rest to the others, until nobody is."""
    out, live, left = {}, dict(nodes), budget
    while live:
        total = sum(w for w, _ in live.values())
        over = [n for n, (w, c) in live.items() if left * w / total >= c]
        if not over:
            return out | {n: left * w / total for n, (w, _) in live.items()}
        for n in over:
            out[n] = live.pop(n)[1]
            left -= out[n]
    return out


def test_target_weights(spark):
    rows, n = [], 0
    for dom, lang, source, docs in (("p", "en", "a", 40), ("p", "en", "b", 10), ("p", "de", "c", 30), ("q", "en", "d", 60), ("q", None, "e", 20)):
        for _ in range(docs):
            rows.append((n, " ".join(["w"] * 10), lang, source, dom))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dom string")
    domain = lambda s: F.when(s.isin("a", "b", "c"), "p").otherwise("q")
    targets = {("p",): 0.7, ("p", "de"): 0.5, ("q", None): 0.9}
    got = defaultdict(int)
    for r in mixing.mixed(docs, share=1.0, max_epochs=2, domain=domain, targets=targets).collect():
        got[r["source"]] += r["copies"] * r["n_tokens"]
    capacity = {"a": 800, "b": 200, "c": 600, "d": 1200, "e": 400}
    weight = lambda t: math.floor(math.sqrt(t) * math.sqrt(math.sqrt(t)))
    top = filled(1600, {"p": (0.7, 1600), "q": (0.3, 1600)})
    p = filled(top["p"], {"de": (0.5, 600), "en": (0.5, 1000)})
    en = filled(p["en"], {"a": (weight(400), 800), "b": (weight(100), 200)})
    q = filled(top["q"], {"e": (0.9, 400), "d": (0.1, 1200)})
    want = {**en, "c": p["de"], **q}
    assert all(abs(got[s] - want[s]) <= 10 and got[s] <= capacity[s] for s in want), (dict(got), want)
    for bad in ({("p",): -1.0}, {("p",): 0.8, ("q",): 0.4}):
        with pytest.raises(ValueError):
            mixing.mixed(docs, domain=domain, targets=bad).count()


def test_every_class_is_sampled(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 150).cast("string").alias("label"))
    got = {r["label"]: r["n"] for r in sampling.spread(ids, "label", 5, 3).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert len(got) > 140 and 2.5 < np.mean(list(got.values())) < 7.5
    assert {r["label"] for r in sampling.spread(ids, "label", 20, 3, total=300).collect()} and sampling.spread(ids, "label", 20, 3, total=300).count() < 600
    assert sampling.spread(ids, "label", 50, 3).count() == 3000


def test_a_third_label_doesnt_count(spark):
    r = np.random.default_rng(4)
    words = {0: "aa ab ba bb zz", 1: "the of and to in", 2: "x y z u v"}
    rows = [(i, " ".join(r.choice(words[y].split(), 30))) for i, y in enumerate([1] * 120 + [0] * 80 + [2] * 300)]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate([1] * 120 + [0] * 80 + [2] * 300)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["score"] for x in quality_classifier.quality_scores(docs, quality_classifier.fitted(docs, labels)).collect()}
    assert np.mean([found[i] for i in range(120)]) > 0.8 and np.mean([found[i] for i in range(120, 200)]) < 0.2


def test_ids_belong_to_their_documents(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [f"text number {i} of some, with w{i * 7}\n" * (i % 4) for i in range(40)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    results = []
    for k in (1, 4):
        at = str(tmp_path / f"h{k}")
        huffman.encode_corpus(docs.repartition(k), at, vocabulary("byte_bpe_50k.json"))
        results.append(sorted((r["start"], r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in huffman.decode_corpus(spark, at).collect()))
    assert results[0] == results[1]
    want = defaultdict(list)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, at = defaultdict(list), 0
    for start, i, n, crc in results[0]:
        assert start == at
        at += n
        got[i].append((n, crc))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [(-1 if i is None else i) for _, i, _, _ in results[0]]
    assert order == sorted(order)


def test_ids_leave_a_worker_in_small_batches(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    limit, taken = "spark.sql.execution.arrow.maxBytesPerBatch", []
    spark.conf.unset(limit)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: taken.append(f) or whole(self, f, *a, **b))
    huffman.encode_corpus(docs, f"file://{tmp_path}/b", vocabulary("byte_bpe_50k.json"))
    assert int(spark.conf.get(limit)) <= 4 << 20
    monkeypatch.setattr(huffman, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 3)}))
    texts = [f"text {i} of some words, and more of them " * 100 for i in range(2000)]
    batch = pa.record_batch([pa.array(range(2000), pa.int64()), pa.array([*texts[:-1], None])], ["doc_id", "text"])
    out = list(taken[0](iter([batch])))
    assert batch.nbytes > 8e6 and max(b.nbytes for b in out) < 2e6
    rows = [r for b in out for r in b.select(["part", "doc_id", "at", "n"]).to_pylist()]
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    n = [len(e.ids) + 1 for e in tokenizer.encode_batch([*texts[:-1], ""], add_special_tokens=False)]
    assert [r["n"] for r in rows[:-1]] == n and [r["at"] for r in rows[:-1]] == [0, *np.cumsum(n)[:-1].tolist()]
    assert [r["doc_id"] for r in rows[:-1]] == list(range(2000)) and rows[-1] == {"part": 3, "doc_id": None, "at": -1, "n": sum(n)}


def test_ids_of_large_vocabularies_keep_their_bytes():
    import pyarrow as pa

    for top in (65_535, 65_536, 200_000):
        class Fake:
            tokenizer = type("T", (), {"get_vocab_size": staticmethod(lambda top=top: top + 1)})

            def encode(self, data, offsets, top=top):
                return np.array([top, 0, 7], np.uint32), np.array([0, 3, 3])

        ids, total = huffman.tokenised(iter([pa.record_batch([pa.array([5, 6]), pa.array(["abc", None])], ["doc_id", "text"])]), Fake(), 0, 0)
        assert [huffman.ids_in(x, n - 1).tolist() for x, n in zip(ids["ids"].to_pylist(), ids["n"].to_pylist(), strict=True)] == [[top, 0, 7], []]
        counts = np.frombuffer(total["counts"].to_pylist()[0], np.int64)
        assert counts[top] == 1 and counts[0] == 3 and counts.sum() == 5 == total["n"].to_pylist()[0]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session)


def test_copies_under_one_id_are_dealt_out(spark):
    from glyphloom.llm import exact_dedup

    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).when(F.col("id") < 4100, None).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") < 4200, "same").otherwise(F.col("id").cast("string")).alias("text"))
    for keep, who in (("max", 4199), ("min", 7)):
        got = exact_dedup.exact_duplicates(rows.repartition(3), keep)
        r = got.where("group_size > 1").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"), F.min("group_size").alias("g"), F.max("keep_id").alias("i"), F.min("keep_id").alias("j")).first()
        assert (r.n, r.k, r.g, r.i, r.j) == (4200, 1, 4200, who, who) and got.count() == 5000


def test_language_of_a_long_text_in_pieces(spark, monkeypatch):
    from glyphloom.llm import langid

    r = np.random.default_rng(6)
    model = langid.Model(("a", "b"), r.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 0.0)
    text = " ".join("".join(r.choice(list("abcdefgh"), r.integers(1, 9))) for _ in range(20_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = model.scores(data, offsets)
    monkeypatch.setattr(langid, "SCORED", 4096)
    pieces = model.scores(data, offsets)
    assert np.abs(whole - pieces).max() < 0.01
    solid = np.frombuffer(b"x" * 50_000, np.uint8)
    assert np.isfinite(model.scores(solid, np.array([0, 50_000]))).all()


def test_sums_of_texts_with_empty_ones():
    from glyphloom.llm import quality_rules

    data = np.frombuffer(b"aab#a#", np.uint8)
    assert quality_rules._sums(data == 97, np.array([0, 0, 2, 2, 5, 6, 6])).tolist() == [0, 2, 0, 1, 0, 0] and quality_rules._sums(data[:0] == 97, np.array([0, 0])).tolist() == [0]
