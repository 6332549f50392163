import pytest

from helicase.llm.html_text import extract_main_text, main_text
from helicase.llm.url_filter import candidates_by_join, filter_urls, host_rule, pattern_rule, rule_index

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = [
    None, "", "no scheme.net/en/", "http://Example.NET/en/x", "http://a.example.net/EN/x", "https://x.net", "https://x.net?q", "https://notexample.net/en/",
    "http://example.com/de/1", "http://example.com/des", "http://b.org/fr/2#t", "http://casino-win.example.com/en/", "http://mycasino.example.com/en/",
    "http://a.com/health/casino/", "http://x.edu/adult", "ftp://h/p?ads=1", "http://a.net://b.org/fr/", "HTTP://ADULT-x.example.org/en/", "http://é.net/ü",
]


def judge(url):
    """Host, path, rule and verdict by scanning every rule."""
    host = path = ""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for name, verdict in RULES:
        h, _, p = name.partition("/")
        if url and "://" in url and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    import re

    from helicase.llm.url_filter import BLOCK_PATTERNS, EXCEPT_PATTERNS
    fits = lambda ps: url is not None and any(re.search(pattern_rule(p).regex, low) for p in ps)
    own = "block" if fits(BLOCK_PATTERNS) and not fits(EXCEPT_PATTERNS) else "allow"
    return host, path, best and best[0], best[1] if best else own


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, RULES).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert filter_urls(df.where("false"), RULES).count() == 0


def test_index_by_join_agrees(spark):
    from pyspark.sql import functions as F

    from helicase.llm import url_filter

    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    index = rule_index([host_rule(*r) for r in RULES] + [pattern_rule("^ads^"), pattern_rule("plain")], {"en": 5})
    known = df.select(F.col("page_id").alias("id"), "url")
    a = {r.id: sorted(c.name for c in r.candidates) for r in candidates_by_join(known, index).collect()}
    b = {r.id: sorted(c.name for c in r.candidates) for r in url_filter.candidates_by_literal(known, index).collect()}
    assert a == b and all("plain" in c for c in a.values())


def test_rules_are_indexed_by_literal_tokens():
    assert pattern_rule("^cheap^pills^").tokens == ("cheap", "pills")
    assert pattern_rule("||shop*market^").tokens == ()
    assert pattern_rule("casino").tokens == ()
    assert set(host_rule("example.net/en/", "allow").tokens) == {"example", "net", "en"}
    assert set(host_rule("example.net/en", "allow").tokens) == {"example", "net"}
    assert list(rule_index([host_rule("example.net/en/", "allow")], {"example": 9, "net": 3, "en": 5})) == ["net"]


def test_rule_lists_as_text():
    from helicase.llm.url_filter import patterns_of

    text = """[Adblock Plus 2.0]
! Title: test
||ads.example.com^
@@||good.example.com/ads^
/banner/*/img^
|http://exact.
||x.com^$important
||y.com^$third-party
example.com##.ad
example.com#@#.ad
/regex[0-9]/
@@/regex/
# a comment
0.0.0.0 tracker.net
127.0.0.1  Evil.ORG # yes
::1 six.net

*"""
    assert patterns_of(text.split("\n")) == (
        ["||ads.example.com^", "@@||good.example.com/ads^", "/banner/*/img^", "|http://exact.", "||x.com^", "||tracker.net^", "||evil.org^", "||six.net^"],
        ["||y.com^$third-party", "example.com##.ad", "example.com#@#.ad", "/regex[0-9]/", "@@/regex/", "*"])


def test_thousands_of_rules_by_both_ways(spark, monkeypatch):
    """Whole verdicts over a list of 3,000 rules: joined by token, looked up in the plan, and every rule run on every URL."""
    import random
    import re

    from helicase.llm import url_filter
    from helicase.llm.url_filter import patterns_of, pattern_rule

    r = random.Random(7)
    names = [f"w{i}" for i in range(400)]
    lines = [f"||{r.choice(names)}.{r.choice(['com', 'net', 'org'])}^" for _ in range(1200)] + [f"^{r.choice(names)}^{r.choice(names)}^" for _ in range(1200)]
    lines += [f"/{r.choice(names)}/*.gif" for _ in range(300)] + [f"@@||{r.choice(names)}.com/{r.choice(names)}^" for _ in range(290)] + ["plain7", "|ftp:", "^ads^"] * 3 + ["! comment"]
    patterns, others = patterns_of(lines)
    assert len(patterns) > 2990 and not others
    urls = [f"http://{r.choice(['', 'a.'])}{r.choice(names)}.{r.choice(['com', 'net', 'de'])}/{r.choice(names)}{r.choice('/-.')}{r.choice(names)}{r.choice(['.gif', '', '?ads=1'])}" for _ in range(250)]
    urls += ["ftp://x/plain7", None, "", "http://q.de/xplain7x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")

    def told():
        return sorted(map(str, filter_urls(df, RULES, patterns=patterns).collect()))

    joined = told()
    rules = [(pattern_rule(p), re.compile(pattern_rule(p).regex)) for p in patterns]
    for row in filter_urls(df, RULES, patterns=patterns).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row.url or "")
        fit = [x.verdict for x, regex in rules if row.url is not None and regex.search(low)]
        if row.rule is None:
            assert row.verdict == ("block" if "block" in fit and "allow" not in fit else "allow"), row
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 100_000)
    assert len({tuple(x) for x in patterns}) > 2000 and told() == joined


PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<br>b\n c", "a b c"), ("<p", ""),
    ("<html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body><nav><a href=a>Home</a></nav><article><h1>Head</h1>"
     "<p>First, one.<p>Second <b>bold</b> &lt;x&gt; &eacute;.</p><form><input> name</form><aside>Side</aside></article><footer>Foot</footer></body>",
     "Head\n\nFirst, one.\n\nSecond bold <x> é."),
    ("<body><div class='menu'><a href=x>Home</a> <a>About</a></div><div id=content><h2>Title here</h2><p>First para, with <b>bold</b> text and more.</p>"
     "<p>Second paragraph, a longer one; yes.</p></div><div class=comments><p>Nice post, thanks!</p></div><div id=sidebar><p>Other, stuff here.</p></div></body>",
     "Title here\n\nFirst para, with bold text and more.\n\nSecond paragraph, a longer one; yes."),
    ("<article><p>text one.</p><section class='comments'><article><p>hi</p></article></section><div class='cookie-notice'>We use cookies.</div></article>", "text one."),
    ("<main><div>a</div>tail text<div>b</div></main>", "a\n\ntail text\n\nb"),
    ("<article><h1>x &am", "x &am"), ("<!-- <p>no</p> --><article>yes</article>", "yes"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[5]], "page_id long, url string, html string, text string")
    got = sorted(extract_main_text(df).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.text, r.n_chars) == (PAGES[r.page_id][1], len(PAGES[r.page_id][1]))
    assert extract_main_text(df.where("false")).count() == 0
    long = "<article>" + "<p>word, " * 20000 + "</article>"
    assert main_text(long).count("\n\n") == 19999


@pytest.mark.parametrize("attribute", ['style="overflow: hidden"', 'title="the hidden city"', "title='x role=menu class=nav'", 'data-x="a" title=" hidden "', "href=/x/hidden"])
@pytest.mark.parametrize("tag", ["article", "div", "p"])
def test_values_are_no_attribute_names(tag, attribute):
    inner = f"<{tag} {attribute}>First, one.</{tag}>"
    assert main_text(f"<body>{inner}</body>") == "First, one."
    assert main_text(f"<article><h1>Head</h1>{inner}</article>") == "Head\n\nFirst, one."


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN", 'title="a" hidden', 'hidden=""', "aria-hidden='true'", 'style="x" class="nav"', "data-a=1 role=menu"])
def test_attributes_that_rule_out(attribute):
    assert main_text(f"<article>yes<div {attribute}>no</div></article>") == "yes"


PROSE = "A sentence of the article, with some words in it; and then another, a bit longer than the first."


@pytest.mark.parametrize("root", ["article", "main"])
def test_paths_select_within_a_marked_root(root):
    links = "<ul>" + "".join(f"<li><a href=/{i}>Story number {i}, here</a></li>" for i in range(5)) + "</ul>"
    advert = "<div><a href=/buy>Cheap pens, today only!</a></div><section><p><a href=/x><b>Win</b> a prize today.</a> Go</p></section>"
    page = f"<{root}><h1><a href=/self>Head</a></h1><p>{PROSE}</p>{links}<p>{PROSE} <a href=/y>Linked</a></p>{advert}<p>{PROSE}</p></{root}>"
    assert main_text(page) == "\n\n".join(["Head", PROSE, PROSE + " Linked", PROSE])


def test_short_text_within_a_marked_root_stays():
    long = PROSE * 40
    parts = ["Red", "Green", "Blue"]
    page = f"<article><p>{long}</p><ul>{''.join(f'<li>{x}</li>' for x in parts)}</ul><h2>Sum</h2><p>Ja.</p><p>{long}</p><table><tr><td>1<td>2<td><a href=/x>three</a></table></article>"
    assert main_text(page) == "\n\n".join([long, *parts, "Sum", "Ja.", long, "1", "2", "three"])
    assert main_text("<article><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></article>") == "One\n\nTwo"


def test_article_split_over_containers():
    first = "".join(f"<p>{PROSE}</p>" for _ in range(7))
    menu = "<div><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></div>"
    page = f"<body>{menu}<div><section><h2>One</h2>{first}</section></div><div><h2>Two</h2><p>{PROSE}</p><p>Short, yes.</p><p>{PROSE}</p></div><span>&copy; 2020 us</span></body>"
    assert main_text(page) == "\n\n".join(["One", *[PROSE] * 7, "Two", PROSE, "Short, yes.", PROSE])


@pytest.mark.parametrize("wrap", ["<table><tr><td>{}</table>", "<section><blockquote><p>{}</p></blockquote></section>", "<center>{}</center>"])
def test_content_at_another_path(wrap):
    page = "<body><div><div>" + f"<p>{PROSE}</p>" * 12 + "</div></div>" + wrap.format(PROSE) + "</body>"
    assert main_text(page) == "\n\n".join([PROSE] * 13)


def test_short_second_article():
    page = "<body><div><article>" + f"<p>{PROSE}</p>" * 30 + f"</article></div><article><p>Short, yes.</p></article><div>Not in either, as it is.</div></body>"
    assert main_text(page) == "\n\n".join([PROSE] * 30 + ["Short, yes."])


def test_deep_nesting_is_linear():
    import time

    deep = "<div>text, " * 20_000
    start = time.perf_counter()
    assert main_text(f"<article>{deep}</article>").count("text,") == 20_000
    assert main_text(deep).count("text,") == 20_000
    assert main_text("<p>" + "<b>x " * 20_000 + "</b>" * 20_000).count("x") == 20_000
    # end tags that close nothing, above many open elements
    assert main_text("<i><div>yes" + "<b>" * 20_000 + "</i>" * 20_000) == "yes"
    assert main_text("<p><table>yes" + "<b>" * 20_000 + "<div>" * 20_000) == "yes"
    assert main_text("<ul><li>" + "<ol>" + "<b>" * 20_000 + "<li>yes" * 20_000).count("yes") == 20_000
    assert time.perf_counter() - start < 20


def test_sums_and_ancestors_of_paths():
    from helicase.llm.html_text import _Paths

    paths = _Paths()
    made = [(), ("div",), ("div", "p"), ("div", "ul"), ("div", "ul", "li"), ("p",)]
    number = {(): 0}
    for p in made[1:]:
        number[p] = paths.child(number[p[:-1]], p[-1])
        assert paths.child(number[p[:-1]], p[-1]) == number[p]
    own = {number[p]: 10.0 ** i for i, p in enumerate(made)}
    for p in made:
        assert paths.summed(own)[number[p]] == sum(10.0 ** i for i, q in enumerate(made) if q[:len(p)] == p)
        assert paths.under({number[("div", "ul")], number[("p",)]})[number[p]] == (p[:2] == ("div", "ul") or p == ("p",))
        assert paths.depths()[number[p]] == len(p)
