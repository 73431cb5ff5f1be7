import random
import re

from glossa.llm import urlfilter as u

URLS = ["https://www.Example.com/en/1", "http://a.example.com/en/x?y#z", "https://example.com/en", "https://x.net/es/1", "https://net/fr/", "https://notnet/fr/", "https://x.org/ads/1", "http://casino.org/", "https://x.org/fine", "no url", None, "://", "https://h#f/en/", "https://h?x=/ads/", "https://example.com.evil.org/en/", "ftp://x.com", "https://É.com/", "http://" + "a" * 50_000 + ".net/es/", "a://b://c/d", "https://x.wwwexample.com/en/", "http://x.org/LOGIN/", "http://a\n.org/ads/x", "http://tracking.ads.org"]


def brute(url):
    m = re.search(r"(?s)^.*?://(.*)$", url or "")
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", m[1]).groups() if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in u.LIST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(re.search(p, (host + path).lower()) for p in u.PATTERNS) else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, x, "<html>", "clash") for i, x in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(pages).collect()}
    assert got == {i: brute(x) for i, x in enumerate(URLS)}
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_only_candidates_run():
    index = u.RuleIndex([u.pattern_rule("block", rf"/w{i}/") for i in range(1000)] + u.default_rules())
    assert len(index.candidates("x.org/w7/")) == 1
    assert index.judge("x.org", "/w7/").verdict == "block" and index.judge("x.org", "/w7") is None


def test_index_misses_nothing():
    rules = u.default_rules()
    index = u.RuleIndex(rules)
    for url in filter(None, URLS):
        host, path = u.split_url(url)
        fitting = [r for r in rules if re.match(r.pattern, host + path if r.exact else (host + path).lower())]
        assert index.judge(host, path) == max(fitting, key=lambda r: r.length, default=None), url


def test_empty(spark):
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


FILTERS = """! a comment
[Adblock Plus 2.0]
||ads.example.org^
||tracker.net/pixel*/img^
@@||ads.example.org/ok/
/banner/*/top.
|start.example/
.swf|
/[a-z]+[0-9]{4}x/
example.com##.box
||other.org^$third-party""".split("\n")


def test_read_filters():
    rules = u.read_filters(FILTERS)
    assert len(rules) == 7
    index = u.RuleIndex(rules)
    said = lambda host, path: getattr(index.judge(host, path), "verdict", None)
    assert said("ads.example.org", "/x") == said("sub.ads.example.org", "") == "block"
    assert said("ads.example.org", "/ok/1") == "allow" and said("badads.example.org", "/x") is None
    assert said("tracker.net", "/pixel99/img") == "block" and said("tracker.net", "/pixel/imgs") is None
    assert said("a.b", "/banner/1/top.png") == "block" and said("a.b", "/banner/top.png") is None
    assert said("start.example", "/") == "block" and said("www.start.example", "/") is None
    assert said("a.b", "/movie.SWF") == "block" and said("a.b", "/movie.swf2") is None
    assert said("a.b", "/abc1234x") == "block" and said("other.org", "/") is None


def test_index_is_complete():
    """Every rule that fits is among the candidates."""
    rng = random.Random(2)
    rules = u.default_rules() + u.read_filters(FILTERS)
    index, parts = u.RuleIndex(rules), ["ads", "example", "org", "com", "net", ".", "/", "-", "_", "banner", "1", "top", "pixel", "img", "en", "www", "tracker", "X", "login", "ad", "swf", "abc1234x"]
    for _ in range(3000):
        host, path = "".join(rng.choices(parts, k=4)).replace("/", "").lower(), "/" + "".join(rng.choices(parts, k=6))
        lowered = (host + path).lower()
        fitting = {i for i, r in enumerate(rules) if re.match(r.pattern, host + path if r.exact else lowered)}
        assert fitting <= set(index.candidates(lowered))


def test_a_long_list_is_joined(spark):
    rng = random.Random(3)
    rules = u.default_rules() + u.read_filters(FILTERS) + [u.host_rule("block", f"h{i}.org", "/") for i in range(30)]
    hosts = ["www.example.com", "a.net", "h3.org", "x.h7.org", "ads.example.org", "tracker.net", "plain.io", "start.example"]
    rows = [(i % 50, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'es/', 'ok/', 'login', 'pixel1/img', 'abc1234x', ''])}") for i in range(200)] + [(None, None), (None, "no scheme"), (1, "http://H3.org/"), (1, "http://H3.org/")]
    pages = spark.createDataFrame([(*r, "no") for r in rows], "page_id long, url string, no string")
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, u.filter_urls(pages, rules).collect()))
    assert len(want) == len(rows)
    for most in (2, 20):
        assert sorted(map(key, u.filter_urls(pages, rules, most=most).collect())) == want
    assert u.filter_urls(pages.limit(0), rules, most=2).count() == 0


OPTIONS = """/BannerAd[0-9]+/
||Other.org^$document,important
@@||other.org/fine^
/CaseAd[a-z]/$match-case
||CamelCase.net/Path^$match-case,doc
||third.org^$third-party
||gone.org^$popup
||gone.org^$popup,badfilter
/unclosed(/
adserv
example.com##.box
||net.org^$script,domain=x.org
! nothing""".split("\n")


def test_options_and_cases():
    rules, reasons = u.read_list(OPTIONS)
    assert reasons == {"options": 2, "badfilter": 2, "expression": 1, "element": 1, "comment": 1} and len(rules) == len(OPTIONS) - 7
    index = u.RuleIndex(rules)
    said = lambda host, path: getattr(index.judge(host, path), "verdict", None)
    assert said("x.org", "/BannerAd12/") == said("x.org", "/myBANNERAD1") == said("x.org", "/bannerad1") == "block" and said("x.org", "/bannerad/") is None
    assert said("other.org", "/fine/") == "block"  # important
    assert said("x.org", "/CaseAdx") == "block" and said("x.org", "/casead" + "x") is None and said("x.org", "/CASEADX") is None
    assert said("camelcase.net", "/Path") is None and said("CamelCase.net", "/Path/") == "block"
    assert said("third.org", "/") is None and said("gone.org", "/") is None and said("x.org", "/myadserver/") == "block"


def test_literals():
    assert u.literals(r"/banner[0-9]+ad/") == [("banner",), ("ad",)]
    assert u.literals(r"^(foo|ba(r|z)x+)?end") == [("end",)]
    assert u.literals(r"(?:alpha|beta)tail{2}(opt)*") == [("alpha", "beta"), ("tai",), ("l",)]
    assert u.literals(r"[a-z]+") == [] and u.literals(r"a|[0-9]") == []


def test_many_expressions_leave_few_candidates(spark):
    """100,000 expressions without a whole token: a URL tries a handful."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    words = [word() for _ in range(100_000)]
    rules = u.read_filters([f"/{w}[0-9]+(x|y)/" for w in words])
    assert len(rules) == 100_000 and all(r.needs for r in rules)
    index = u.RuleIndex(rules)
    assert not index.always and not index.compiled
    for w in words[:50]:
        url = f"x.org/{word()}/my{w}12x/{word()}.html"
        assert len(index.candidates(url)) < 30 and index.judge("", url).verdict == "block" and index.judge("", url.replace("12x", "12z")) is None
    pages = spark.createDataFrame([(i, f"https://h.org/{w.upper()}7y") for i, w in enumerate(words[:20])] + [(99, "https://h.org/none")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.filter_urls(pages, rules).collect()}
    assert got == {**{i: "block" for i in range(20)}, 99: "allow"}


def test_expressions_are_among_the_candidates():
    rng = random.Random(12)
    parts = ["foo", "bar", "[0-9]", "(?:a|bc)", "x?", "(?:one|two|)", "\\.", "ab{2}", "(?:end)+", "q*", "[^/]", "\\d+", "^", "longword", "(?=k)", "(red|blue)"]
    lines = ["/" + "".join(rng.choices(parts, k=rng.randrange(1, 5))) + "/" for _ in range(300)]
    rules, _ = u.read_list(lines)
    index, pieces = u.RuleIndex(rules), ["foo", "bar", "7", "a", "bc", "x", "one", "two", ".", "abb", "end", "q", "longword", "kk", "red", "blue", "/", "Z"]
    for _ in range(1000):
        lowered = "".join(rng.choices(pieces, k=8)).lower()
        assert {i for i, r in enumerate(rules) if re.match(r.pattern, lowered)} <= set(index.candidates(lowered)), lowered


def test_long_lists_with_expressions_are_joined(spark):
    rules = u.default_rules() + u.read_filters([*FILTERS, *OPTIONS])
    urls = ["http://x.org/BannerAd12/", "http://x.org/CaseAdx", "http://x.org/caseadx", "http://a.b/myadserver", "http://other.org/fine/", None, "http://a.b/abc1234x", "x", "http://x.org/BannerAd12/"]
    pages = spark.createDataFrame([(None if i == 3 else i, x, 1) for i, x in enumerate(urls)], "page_id long, url string, words int")
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, u.filter_urls(pages, rules).collect()))
    assert len(want) == len(urls) and sum("block" in w for w in want) == 6
    for most in (2, 15):
        assert sorted(map(key, u.filter_urls(pages, rules, most=most).collect())) == want
