from tidemark.llm import hosts as H


def judge(spark, pages, labels, **kw):
    p = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, rule string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r["page_id"]: r for r in H.judge(p, lab, **kw).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.COM/en/1?x=/y", "http://a.example.com/en/1", "http://example.com", "http://example.com/", "http://xexample.com/en/1",
            "https://net/es/1", "ftp://shop.NET/fr/2#f", "http://shop.net/de/2", None, "no scheme/here", "http://", "://h#p", "http://u://v/w", "x\n://h/a\nb?c"]
    got = judge(spark, list(enumerate(urls)), [])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("example.com", "", None, "allow"), ("example.com", "/", "com/", "allow"), ("xexample.com", "/en/1", "com/", "allow"),
        ("net", "/es/1", "net/es/", "block"), ("shop.net", "/fr/2", "net/fr/", "block"), ("shop.net", "/de/2", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("u:", "//v/w", None, "allow"),
        ("h", "/a\nb", None, "allow")]


def test_bad_host_is_blocked_and_a_small_host_is_shrunk(spark):
    pages, labels = [], []
    for i in range(400):                       # good hosts, 5 % bad
        pages.append((i, f"https://h{i % 20}.good.org/en/{i}"))
        labels.append((i, int(i % 20 != i // 20 % 20), 0))
    for i in range(400, 460):                  # a bad host, 95 % bad
        pages.append((i, f"https://spam.bad.org/en/{i}.html"))
        labels.append((i, int(i % 20 == 0), 0))
    pages += [(1000, "https://new.good.org/en/9999"), (1001, "https://other.bad.org/x")]
    pages.append((1002, "https://once.good.org/en/2000/"))
    labels.append((2000, 0, 1))
    got = judge(spark, pages, labels, rules=())
    assert {got[i]["verdict"] for i in range(400)} == {"allow"}
    assert {got[i]["verdict"] for i in range(400, 460)} == {"block"}
    assert got[1000]["verdict"] == "allow" and got[1002]["verdict"] == "allow"          # one bad page is no proof
    assert got[1001]["bad_lower"] > got[1000]["bad_lower"]                              # its domain's evidence


def test_edge_cases(spark):
    assert judge(spark, [], []) == {}
    got = judge(spark, [(1, "http://a.co.uk/en/5"), (1, "http://a.co.uk/en/5"), (None, None)], [(5, None, None), (5, 0, None), (None, 0, 1)])
    assert len(got) == 2 and got[1]["verdict"] == "allow"
    levels = {r["host"]: (r["domain"], r["suffix"]) for r in H.with_levels(
        spark.createDataFrame([("x.shop.co.uk",), ("b.example.com:80",), ("com",), ("",)], "host string")).collect()}
    assert levels == {"x.shop.co.uk": ("shop.co.uk", "co.uk"), "b.example.com:80": ("example.com", "com"), "com": ("com", "com"), "": ("", "")}


def test_very_long_urls_and_a_limit_relative_to_the_overall_rate(spark):
    long = "https://" + "a" * 5000 + ".org/" + "p/" * 50_000 + "7"
    got = judge(spark, [(1, long), (2, "https://b.org/8")], [(7, 0, 0), (8, 1, 0)])
    assert got[1]["host"] == "a" * 5000 + ".org" and len(got[1]["path"]) == 100_002
    pages, labels = [], []
    for i in range(1000):                      # 20 % bad everywhere, 60 % at one host of eight
        pages.append((i, f"https://h{i % 8}.site.org/x/{i}"))
        labels.append((i, int(i % 10 >= (6 if i % 8 == 3 else 2)), 0))
    got = judge(spark, pages, labels, rules=())
    assert {i % 8 for i in range(1000) if got[i]["verdict"] == "block"} == {3}
