from tallyspark.llm import queries, url_filter

RULES = queries.URL_RULES


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, verdict string, path string")
    return {r.page_id: r for r in url_filter.judged(pages, RULES).collect()}


def test_host_path_and_longest_rule(spark):
    cases = [
        ("https://Shop.COM/a?b#c", "shop.com", "/a", "com/", "allow"),
        ("https://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://b.www.example.com/en/x", "b.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://wwwexample.com/en/x", "wwwexample.com", "/en/x", "com/", "allow"),
        ("ftp://x.net/es/1://y", "x.net", "/es/1://y", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, c in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == c[1:]
    plain = [("http://x.net/ES/1", "x.net", "/ES/1"), ("http://a.com?q=/en/", "a.com", ""), ("http://x.com#/", "x.com", ""), (None, "", ""), ("no scheme.com/", "", ""), ("", "", ""), ("://", "", ""), ("http://ÄB.Net/fr", "Äb.net", "/fr")]
    got = judged(spark, [c[0] for c in plain])
    for i, c in enumerate(plain):
        assert (got[i].host, got[i].path, got[i].rule) == (c[1], c[2], None)
        assert got[i].verdict in ("allow", "block")


def test_purity_of_templates(spark):
    """A branch of blocked pages rejects its unlabelled neighbours, other branches stay."""
    rules = [("block", "h.org/bad/1"), ("allow", "h.org/good/1")]
    urls = [f"http://h.org/bad/{i}/p" for i in range(10, 20)] + [f"http://h.org/bad/{i}/p" for i in range(20, 26)] + [f"http://h.org/good/{i}" for i in range(10, 20)] + ["http://h.org/good/7", "http://h.org/other"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.url if "url" in r else urls[r.page_id]: r for r in url_filter.judged(pages, rules).collect()}
    assert rows["http://h.org/bad/20/p"].template == "/bad/*/p"
    assert {rows[f"http://h.org/bad/{i}/p"].verdict for i in range(20, 26)} == {"block"}
    assert rows["http://h.org/good/7"].verdict == rows["http://h.org/other"].verdict == "allow"


def test_repeated_rows_many_children_and_empty_tables(spark, monkeypatch):
    urls = ["http://y.org/" + "abcdefghij"[i % 10] * (1 + i // 10) + "/z" for i in range(60)] + ["http://y.org/a/z"] * 3 + ["http://y.org" + "/deep" * 4000]
    want = judged(spark, urls)
    assert len(want) == len(urls)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    got = judged(spark, urls)
    assert {i: (r.verdict, r.template) for i, r in got.items()} == {i: (r.verdict, r.template) for i, r in want.items()}
    assert {r.template for i, r in got.items() if i < 60} == {"/*/z"}
    assert judged(spark, []) == {}


def test_branches_without_labels_are_not_blocked_by_their_siblings(spark):
    for n in (3, 4, 400):
        urls = [f"http://x.net/{a}/{i}" for a in ("es", "fr") for i in range(n)] + [f"http://x.net/{a}/{i}" for a in ("en", "de") for i in range(20)] + ["http://x.net/"]
        got = judged(spark, urls)
        assert {got[i].verdict for i in range(2 * n)} == {"block"}
        assert {got[i].verdict for i in range(2 * n, len(urls))} == {"allow"}


def test_alike_siblings_are_pooled_and_others_are_not():
    assert url_filter.pooled([(0, 9), (9, 10), (10, 10)]) == [(0, 9), (19, 20), (19, 20)]
    assert url_filter.pooled([(1, 4), (2, 4)]) == [(3, 8), (3, 8)]
    assert url_filter.pooled([]) == []


def test_siblings_share_evidence_apart_from_their_parent(spark):
    """Two sections with few blocked pages each are rejected together beside a clean one."""
    rules = [("block", "h.org/p/1"), ("block", "h.org/q/1"), ("allow", "h.org/good/1")]
    urls = [f"http://h.org/{s}/{'1x' if i < 3 else '2x'}{'abcdefgh'[i]}" for s in "pq" for i in range(4)] + [f"http://h.org/good/{i}" for i in range(100, 140)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judged(pages, rules).collect()}
    assert got[3].rule is None and got[3].verdict == got[7].verdict == "block"
    assert got[3].purity == got[7].purity == (6 + 2) / (6 + 8) and got[8].purity == 2 / 48


def test_templates_do_not_move_with_the_number_of_rows(spark):
    slugs = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(60)]
    few = [f"http://y.org/{s}/z/one/two/{t}" for s in slugs for t in ("v", "w")]
    more = few * 10 + [f"http://y.org/{s}/z/one/two/{t}/{i}" for s in slugs for t in ("v", "w") for i in range(9)]
    for urls in (few, few * 10, more):
        got = judged(spark, urls)
        assert {got[i].template for i in range(len(few))} == {"/*/z/one/two/v", "/*/z/one/two/w"}


def test_segments_beyond_the_third_count(spark):
    rules = [("block", "h.org/a/b/c/bad/1"), ("allow", "h.org/a/b/c/good/1")]
    urls = [f"http://h.org/a/b/c/{s}/{i}" for s in ("bad", "good") for i in (*range(10, 20), *range(20, 25))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judged(pages, rules).collect()}
    assert {got[i].verdict for i in range(15)} == {"block"} and {got[i].verdict for i in range(15, 30)} == {"allow"}


def test_templates_without_labels_are_judged_by_other_hosts(spark):
    urls = [f"http://a{h}.example.com/en/{i}" for h in range(4) for i in range(10)]  # blocked by a rule
    urls += [f"http://b{h}.com/de/{i}" for h in range(4) for i in range(10)]  # allowed by a rule
    urls += [f"http://c.net/{x}/{i}" for x in ("en", "de", "xx", "es") for i in range(5)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["path"]: (r["verdict"], round(r["purity"], 3)) for r in url_filter.judged(pages, RULES).filter("host = 'c.net'").collect()}
    # distinct paths of each host: digits are one template, paths are counted
    blocked = (40 + 8 * 0.25) / 48
    allowed = (0 + 8 * 0.25) / 48
    assert {got[f"/en/{i}"] for i in range(5)} == {("block", round(blocked, 3))}
    assert {got[f"/de/{i}"] for i in range(5)} == {("allow", round(allowed, 3))}
    assert {got[f"/xx/{i}"] for i in range(5)} == {("allow", 0.25)}
    assert {got[f"/es/{i}"][0] for i in range(5)} == {"block"}
