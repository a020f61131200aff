"""Each stage of the corpus pipeline against brute force on what the stage before it left, and the whole run."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from glyphloom.llm import common
from glyphloom.llm.tokens import vocabulary
from tests.llm.test_line_dedup import brute
from tests.llm.test_small import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(5)
    syllables = {"en": ["the", "ing", "and", "ther", "ou", "wh"], "de": ["ein", "sch", "ung", "lich", "zu", "kei"]}

    def text(lang, n):
        return " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(n))

    shared = {lang: [text(lang, 14) for _ in range(6)] for lang in syllables}
    rows = []
    for i in range(150):
        lang = r.choice(["en", "de"])
        body = [text(lang, r.randint(8, 40)) for _ in range(r.randint(1, 4))]
        if i % 5 == 0:
            body.insert(r.randrange(len(body) + 1), r.choice(shared[lang]))
        rows.append((i, "\n".join(body), lang, f"s{i % 3}"))
    for i in range(150, 170):
        base = rows[i - 150][1].split()
        base[len(base) // 2] = "thing"
        rows.append((i, " ".join(base), rows[i - 150][2], "s1"))
    rows += [(170, None, "en", "s0"), (171, "", None, "s0"), (172, "12 34", "de", None), (173, rows[3][1], rows[3][2], "s2")]
    at = tmp_path_factory.mktemp("corpus")
    ids, texts, langs, sources = zip(*rows, strict=True)
    table = pa.table({"doc_id": ids, "text": texts, "lang": langs, "source": sources, "n_chars": [len(t or "") for t in texts], "score": [float(i) for i in ids], "copies": [7] * len(ids), "n_lines": ["x"] * len(ids)})
    pq.write_table(table, at / "documents.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = corpus_pipeline.written(stage(spark, docs, folder), name)
        if name != "packed":
            assert docs.columns == columns
        held[name] = [r.asDict() for r in docs.collect()]
    left = {r["doc_id"]: r for r in held["language"]}
    assert not {170, 171, 172} & set(left) and len(left) >= 165 and all(left[i] == before[i] for i in left)

    ids = sorted(left)
    split, count, gone = brute([left[i]["text"] for i in ids])
    after = {r["doc_id"]: r for r in held["lines"]}
    for i, t, n, g in zip(ids, split, count, gone, strict=True):
        words = [x for k, x in enumerate(t) if n[k] and k not in g]
        assert ([x for x in after[i]["text"].split("\n") if WORD.search(x)] if i in after else []) == words
        if i in after:
            assert after[i]["n_chars"] == len(after[i]["text"]) and after[i]["score"] == float(i) and after[i]["n_lines"] == "x"

    component = brute_components([(i, r["text"]) for i, r in after.items()])
    unlike = {r["doc_id"]: r for r in held["near_duplicates"]}
    assert set(unlike) == {i for i in after if component[i][1] == i} and all(unlike[i] == after[i] for i in unlike)

    mixed = Counter(r["doc_id"] for r in held["mix"])
    assert set(mixed) <= set(unlike) and max(mixed.values()) <= corpus_pipeline.EPOCHS and all(r == unlike[r["doc_id"]] for r in held["mix"])
    tokens = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
    assert abs(tokens(held["mix"]) - tokens(unlike.values())) <= 0.2 * tokens(unlike.values())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in held["packed"]:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, n in mixed.items():
        total = len(tokenizer.encode(unlike[i]["text"], add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in pieces[i]) == n * total and {r["doc_tokens"] for r in pieces[i]} == {total}
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert w[-1]["offset"] + w[-1]["length"] <= 2048
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(w, w[1:], strict=False)) and w[0]["offset"] == 0
    assert sorted(map(str, (tuple(sorted(r.items())) for r in held["packed"]))) == sorted(map(str, (tuple(sorted(r.asDict().items())) for r in corpus_pipeline.run(spark, folder).collect())))


def test_an_empty_corpus(spark, folder, tmp_path):
    pq.write_table(pq.read_table(f"{folder}/documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_stages_start_on_a_heap_given_back(spark, folder, monkeypatch):
    monkeypatch.setattr(common, "release", lambda spark: None)  # only what tasks collect counts
    counts = getattr(getattr(spark._jvm.org.apache.spark.metrics, "GarbageCollectionMetrics$"), "MODULE$")
    docs, full = spark.read.parquet(f"{folder}/documents.parquet"), lambda: list(counts.getMetricValues(None))[2]
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, folder)
        assert full() >= before + spark.sparkContext.defaultParallelism, name
