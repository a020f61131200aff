"""URL filter: templates judged by hand."""

import pytest

from glyphloom.llm import url_filter


def verdicts(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: r for r in url_filter.url_verdicts(pages).collect()}


@pytest.mark.parametrize("n", [4, 24, 25])
def test_unlabelled_branches_follow_their_siblings_whatever_their_number(spark, monkeypatch, n):
    rules = tuple(("block", f"net/k{'abcdefghijklmnopqrstuvwxyz'[i]}/") for i in range(n))
    urls = [f"http://x.net/k{'abcdefghijklmnopqrstuvwxyz'[i]}/{j}" for i in range(n) for j in range(3)] + ["http://x.net/other/1", "http://y.net/other/1"]
    urls += [f"http://z.net/fine/{j}" for j in range(80)]
    rules = (*rules, ("allow", "z.net/"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_filter.url_verdicts(pages, rules).collect()}
    share = min(0.5, 3 * n / (3 * n + 80))
    want = (n + 4 * share) / (n + 4)
    other = got["http://x.net/other/1"]
    assert abs(other["purity"] - want) < 1e-12 and other["verdict"] == ("block" if want >= 0.8 else "allow")
    assert got["http://y.net/other/1"]["verdict"] == "allow" and got["http://z.net/fine/3"]["verdict"] == "allow"


def test_deep_templates_are_told_apart(spark):
    urls = [f"http://x.org/a/b/c/d/e/f/good/{i}" for i in range(3)] + ["http://x.org/", "http://x.org", "http://x.org/a-long-slug-of-words/7", "http://x.org/0123456789abcdef01/p"]
    got = verdicts(spark, urls)
    assert got[urls[0]]["template"] == "a/b/c/d/e/f/good/#" and got["http://x.org/"]["template"] == "" and got["http://x.org"]["path"] == ""
    assert got["http://x.org/a-long-slug-of-words/7"]["template"] == "*/#" and got["http://x.org/0123456789abcdef01/p"]["template"] == "@/p"
