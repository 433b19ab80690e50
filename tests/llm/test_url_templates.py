import re

from siltworks.llm.url_templates import RULES, Tree, labelled_tree, url_verdicts

PAGE = "page_id long, url string, verdict string, template string"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], PAGE)


def test_parts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.Org/x", "https://www.example.org/es/1?a=/b", "http://example.org/en/12", "http://example.org/en/2", "http://org", "http://org/", "http://norg/x",
        "http://a.com/fr/", "http://a.com/de/x#y", "http://a.com#/de/", "http://b://c/d", "http://É.Com/fr/é", "x?u=http://a.com/fr/1", "http://a.com?/fr/", "ftp://u:p@h.com:80/de/1", "http://a.com/fr/1", "http://a.com/fr/1",
    ]
    got = {r.page_id: r for r in url_verdicts(frame(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict


def test_templates_learn_from_labels(spark):
    rules = (("bad.net", "/ads/a", "block"), ("bad.net", "/news/", "allow"))
    urls = [f"http://bad.net/ads/a{i}" for i in range(60)] + [f"http://bad.net/ads/b{i}" for i in range(9)] + [f"http://bad.net/news/{i}.html" for i in range(60)] + [f"http://bad.net/other/{i}" for i in range(40)]
    got = url_verdicts(frame(spark, urls), rules).collect()
    unruled = {r.path.split("/")[1]: r.verdict for r in got if r.rule is None}
    assert unruled == {"ads": "block", "other": "allow"}
    assert {r.template for r in got if r.path.startswith("/news/")} == {"/=news/*0.a"}


def test_alike_branches_merge(spark):
    rules = (("h.net", "/x", "block"), ("h.net", "/y", "block"), ("h.net", "/z", "allow"))
    urls = [f"http://h.net/{b}/{i}" for b in ("x1", "y1", "z1") for i in range(40)]
    templates = {r.path.split("/")[1]: r.template for r in labelled_tree(frame(spark, urls), rules, Tree()).collect()}
    assert templates["x1"] == templates["y1"] != templates["z1"]


def test_small_sections_of_a_large_host_are_branches(spark):
    rules = (("x.net", "/s1/", "block"), ("x.net", "/big/1", "allow"))
    urls = [f"http://x.net/big/{i}" for i in range(800)] + [f"http://x.net/s{k}/p{i}" for k in range(1, 30) for i in range(40)]
    got = url_verdicts(frame(spark, urls), rules).collect()
    assert len(got) == len(urls) and {r.verdict for r in got if r.rule is None and r.path.startswith("/s")} == {"allow"}
    assert len({r.template.split("/")[1] for r in got}) == 30


def test_deep_segments_are_levels(spark):
    urls = [f"http://d.net/a/b/c/d/e/{k}/{i}.html" for k in ("x", "y") for i in range(20)] + ["http://d.net/a", "http://d.net"]
    got = url_verdicts(frame(spark, urls), (("d.net", "/a/b/c/d/e/x/", "block"),)).collect()
    assert len(got) == len(urls)
    assert sorted({r.template for r in got}) == ["", "/=a", "/=a/=b/=c/=d/=e/=x/*0.a", "/=a/=b/=c/=d/=e/=y/*0.a"]


def test_empty(spark):
    assert url_verdicts(frame(spark, [])).count() == 0
