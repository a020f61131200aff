"""Line dedup against brute force over all pairs of documents."""

import random
import re

import pytest

from glyphloom.llm import line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def brute(texts, least=5):
    """For each text, its lines with a word that stand in a run of `least` words, than which no shorter one holds the line, that an earlier text has too."""
    split = [t.split("\n") for t in texts]
    count = [[len(WORD.findall(x)) for x in t] for t in split]
    out = []
    for j, t in enumerate(split):
        gone = set()
        earlier = {tuple(s[a:b]) for i in range(j) for s in [split[i]] for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for x in range(len(t)):
            if not count[j][x]:
                continue
            around = [(a, b) for a in range(x + 1) for b in range(x + 1, len(t) + 1) if sum(count[j][a:b]) >= least]
            tight = [(a, b) for a, b in around if not any((c, d) != (a, b) and a <= c and d <= b for c, d in around)]
            for a, b in tight:
                if tuple(t[a:b]) in earlier:
                    gone.update(range(a, b))
        out.append(gone)
    return split, count, out


def aligned(a, b, count, least=5):
    """Lines of b in blocks of `least` words of one alignment with a."""
    gone, block, was = [], [], (-2, -2)
    for i, j in [*line_dedup.patience(a, b), (-2, -2)]:
        if block and (i, j) != (was[0] + 1, was[1] + 1):
            if sum(count[x] for x in block) >= least:
                gone += block
            block = []
        block.append(j)
        was = (i, j)
    return set(gone)


def check(spark, texts):
    split, count, want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.deduplicated_lines(docs).collect()}
    total = 0
    for j, t in enumerate(split):
        worded = [x for k, x in enumerate(t) if count[j][k] and k not in want[j]]
        left = got[j]["text"].split("\n")
        assert [x for x in left if WORD.search(x)] == worded, j
        assert got[j]["n_lines"] == len(t) and len(t) - got[j]["n_removed"] == (len(left) if got[j]["n_removed"] < len(t) else 0)
        pairwise = set().union(*(aligned(split[i], t, count[j]) for i in range(j))) if j else set()
        assert {k for k in pairwise if count[j][k]} <= want[j]
        total += len(want[j])
    return total


@pytest.mark.parametrize("seed", [12, 13])
def test_line_dedup_equals_brute_force_over_all_pairs(spark, seed):
    r = random.Random(seed)
    pool = [words(r.choice([1, 2, 3, 6, 9]), 1000 + k) for k in range(25)] + ["", " "]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 12))) for _ in range(60)]
    a, b, c = (words(8, 2000 + k) for k in range(3))
    texts += [f"{a}\n{b}\n{c}", f"{c}\nx", f"{b}\nz\n{a}\ny", f"{b}\n{a}\n{c}\n{a}"]
    assert check(spark, texts) > 100


def test_lines_of_two_first_holders_meet_in_a_third(spark):
    assert check(spark, ["a b c", "d e f", "a b c\nd e f", "a b c\nd e f"]) == 2


def test_passages_out_of_order_and_repeated(spark):
    x = [words(7, 70 + k) for k in range(6)]
    assert check(spark, ["\n".join(x), "\n".join(reversed(x)), "\n".join([x[0]] * 4 + ["new", x[3]] * 2)]) == 12


def test_blank_lines_inside_a_block_go_with_it(spark):
    a, b = words(9, 1), words(9, 2)
    docs = spark.createDataFrame([(1, f"{a}\n\n{b}\n\nend"), (2, f"x\n\n{a}\n\n{b}\n\ny"), (3, f"{a}\n\n\n{b}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_lines(docs).collect()}
    assert got[2] == "x\n\n\ny" and got[3] == "\n"


def test_a_text_beyond_one_chunk(spark):
    lines = [words(12, 50_000 + k, 10**6) for k in range(16_000)]
    long = "\n".join(lines)
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, "\n".join([lines[9], "own words here", lines[15_999]])), (3, long + "\nlast")], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.deduplicated_lines(docs).collect()}
    assert got[1] == (long, 0) and got[2] == ("own words here", 2) and got[3] == ("last", 16_000)


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 7, 9)], "doc_id long, text string, h long, gone long")
    got = sorted(line_dedup.deduplicated_lines(docs).select("doc_id", "text", "h", "gone", "n_removed").collect())
    assert [tuple(r) for r in got] == [(1, "a b c d e", 7, 8, 0), (2, "", 7, 9, 1)]


def test_passes_cover_what_one_alignment_crosses():
    a, b = list(range(50)), list(reversed(range(50)))
    chains = line_dedup.passes(a, b)
    assert sorted(j for c in chains for _, j in c) == list(range(50))
    for c in chains:
        assert all(p < q and s < t for (p, s), (q, t) in zip(c, c[1:], strict=False)) and all(a[i] == b[j] for i, j in c)
