"""Quality rules, license scans, line dedup, HTML extraction and URL filters."""

from __future__ import annotations

import html
import json
import re
import time

import brute
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayrow.llm import html_text, licenses, line_dedup, quality, url_filters
from strayrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, kept string, rule string, _lines string"


def docs(spark, rows):
    """(doc_id, text, source) rows with columns named like results."""
    return spark.createDataFrame([(*r, "k", "r", "l") for r in rows], SCHEMA)


# Quality rules

PROSE = " ".join(f"word{k} and other{k}" for k in range(40)) + "."


def judged(spark, texts, **kwargs):
    rows = quality.judge(docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), **kwargs).collect()
    return {r["doc_id"]: r for r in rows}


def test_quality_counts(spark):
    text = "a b c a b c\na b c a b c\n\n  \nx# $y"
    got = judged(spark, [text, None, "", "é日 b"], rules=quality.RULES)
    assert [got[0][c] for c in quality.COUNTS] == [14, 16, 2, 1, 12]
    assert [got[1][c] for c in quality.COUNTS] == [0, 0, 0, 0, 0]
    assert [got[2][c] for c in quality.COUNTS] == [0, 0, 0, 0, 0]
    assert got[3]["word_chars"] == 3
    assert {got[k]["rejected_by"] for k in range(4)} == {"few_words"}


def test_quality_rules_reject_junk_and_keep_prose(spark):
    shouting = " ".join(f"WORD{k}!!" for k in range(80))
    symbols = " ".join(f"word{k}###" for k in range(80))
    again = "one and the same line of words again\n" * 20
    lines = "\n".join([*[f"{k} a{k} b{k} c{k}" for k in range(20)], *["menu"] * 30])
    got = judged(spark, [PROSE, shouting, symbols, again, lines, "a " * 30 + PROSE + " x" * 100], rules=quality.RULES)
    assert [got[k]["rejected_by"] for k in range(5)] == [
        None, "capitals", "symbols", "repeated_windows", "repeated_lines",
    ]
    assert got[0]["kept"] and not got[3]["kept"]


def test_quality_order_does_not_change_verdicts(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    verdicts = [
        {tuple(r) for r in quality.judge(table, rules).select("doc_id", "kept").collect()}
        for rules in (quality.RULES, quality.RULES[::-1], quality.order_rules(table))
    ]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_quality_cascade_stops_at_the_first_rejection():
    tried = []

    def rule(name, verdict):
        return quality.Rule(name, lambda f: tried.append(name) or verdict)

    rules = [rule("a", False), rule("b", True), rule("c", True)]
    assert quality.rejecting(quality.Features(b"x"), rules) == "b"
    assert tried == ["a", "b"]


def test_quality_order_is_by_rejections_per_cost(spark):
    def slow(features):
        return sum(range(20_000)) > 0

    rules = [
        quality.Rule("slow", slow),
        quality.Rule("never", lambda f: False),
        quality.Rule("fast", lambda f: True),
    ]
    order = quality.order_rules(docs(spark, [(k, "text", "s") for k in range(50)]), rules)
    assert [r.name for r in order] == ["fast", "slow", "never"]
    assert [r.name for r in quality.order_rules(docs(spark, []), rules)] == ["slow", "never", "fast"]


def test_keep_good_keeps_all_columns(spark):
    table = docs(spark, [(1, PROSE, "s"), (1, PROSE, "s"), (2, "junk", "s"), (None, None, None), (None, PROSE, None)])
    kept = quality.keep_good(table)
    assert kept.schema == table.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1]
    assert quality.keep_good(docs(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t.#é", max_size=40))
def test_quality_repeats_equal_a_plain_count(text):
    words = brute.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    features = quality.Features(text.encode())
    assert (features.n_words, features.n_repeat_words) == (len(words), len(covered))
    assert features.word_chars == sum(map(len, words))
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    assert features.n_dup_lines == len(lines) - len(set(lines))


# License scans


def scanned(spark, texts):
    rows = licenses.scan_licenses(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    return {r["doc_id"]: r for r in rows}


def test_license_phrases_and_notices(spark):
    texts = [
        "The MIT License, the mit-license and the\nMIT  LICENSE.",
        "Released under teh MIT Licence.",
        "é Licensed under CC BY-NC 4.0.",
        "GNU General Public License general public license",
        None,
        "",
        "mitlicense apache 2 license",
    ]
    got = scanned(spark, texts)
    assert [got[0][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")] == [
        10, 3, 1, 8, "mit", "mit",
    ]
    assert (got[1]["base_labels"], got[1]["labels"], got[1]["n_base"]) == ("", "mit", 0)
    span = got[1]["spans"][0]
    assert texts[1][span["start"] : span["end"]] == "Released under teh MIT Licence" and span["edits"] == 3
    assert 0.8 < got[1]["score"] < 1
    span = got[2]["spans"][0]
    assert texts[2][span["start"] : span["end"]] == "Licensed under CC BY-NC 4.0" and got[2]["labels"] == "cc-by-nc"
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["labels"]) == (2, 1, 4, "gpl")
    for k in (4, 5):
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["labels"], got[k]["score"]) == (0, 0, None, "", 0.0)
    assert got[6]["labels"] == ""


def test_license_seeds_lose_no_notice():
    """Any text within the allowed edits holds one of the seeds."""
    import random

    rng = random.Random(3)
    scanner = licenses.Scanner()
    for notice in licenses.NOTICES:
        for _ in range(60):
            text = list(notice.text)
            for _ in range(notice.errors):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                text[at : at + (kind != 1)] = rng.choice("qzx") if kind else ""
            found = scanner.spans(("before " * 30 + "".join(text) + " after" * 30).encode())
            assert notice.label in {f[0] for f in found}, "".join(text)


def test_license_phrases_equal_a_plain_count(spark, sf):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scan"](spark, sf).collect()}
    assert len(got) == table.count()
    for owner, text in table.select("doc_id", "text").collect():
        w = words.findall(text.translate(brute.LOWER))
        places = [
            (i, label)
            for phrase, label in licenses.PHRASES
            for i in range(len(w))
            if w[i : i + len(phrase.split())] == phrase.split()
        ]
        r = got[owner]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_scan_of_nothing_and_of_a_long_text(spark):
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    got = scanned(spark, ["the mit license " * 50_000])
    assert got[0]["n_base"] == 50_000 and got[0]["last_word"] == 149_998


def edits_by_end(text, notice):
    """Fewest edits that turn a piece of the text, ending at each place, into the notice; plainly."""
    column = list(range(len(notice) + 1))
    found = []
    for letter in text:
        above, column = column, [0]
        for k, wanted in enumerate(notice):
            column.append(min(above[k] + (letter != wanted), above[k + 1] + 1, column[k] + 1))
        found.append(column[-1])
    return found


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for k, y in enumerate(b):
            row.append(min(last[k] + (x != y), last[k + 1] + 1, row[k] + 1))
    return row[-1]


def check_spans(text, scanner, notices):
    """Spans of each notice against the plain table of edits."""
    lowered = text.translate(brute.LOWER)
    found = scanner.finds(lowered.encode())
    for notice in notices:
        ends = edits_by_end(lowered, notice.text)
        possible = [k + 1 for k, edits in enumerate(ends) if edits <= notice.errors]
        mine = [f for f in found if f[0] == notice.label]
        assert bool(mine) == bool(possible)
        for _, start, end, edits, share in mine:
            assert edit_distance(lowered[start:end], notice.text) == edits <= notice.errors
            assert share == 1 - edits / len(notice.text)
        for (_, _, end, *_), (_, start, *_) in zip(mine, mine[1:]):
            assert end <= start
        if mine:
            assert min(f[3] for f in mine) == min(ends)
        # Whatever else matches overlaps a span that is reported.
        longest = len(notice.text) + notice.errors
        for end in possible:
            assert any(s < end and end - longest < e for _, s, e, *_ in mine)


OWN = [n for k, n in enumerate(licenses.NOTICES) if n.label not in {m.label for m in licenses.NOTICES[:k]}]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_license_spans_equal_a_plain_search(monkeypatch, chunk):
    import random

    monkeypatch.setattr(licenses, "CHUNK", chunk)
    rng = random.Random(chunk)
    scanner = licenses.Scanner(OWN)
    for _ in range(25):
        text = ""
        for _ in range(rng.randrange(6)):
            notice = rng.choice(OWN)
            letters = list(notice.text)
            for _ in range(rng.randrange(notice.errors + 3)):
                at = rng.randrange(len(letters))
                kind = rng.randrange(3)
                letters[at : at + (kind != 1)] = rng.choice(["e", "é", " ", "日"]) if kind else ""
            text += "".join(letters) + rng.choice(["", " ", ". And Then é ", "license "])
        check_spans(text, scanner, OWN)


def test_license_query_reports_the_spans_of_its_labels(spark, sf):
    for r in QUERIES["op8_license_scan"](spark, sf).collect():
        labels = {s["label"] for s in json.loads(r["spans"])}
        assert ",".join(sorted({*filter(None, r["base_labels"].split(",")), *labels})) == r["labels"]


@pytest.mark.parametrize("unit", ["license ", "é licensed ", "licensed under cc by 4.0 ", "under the ", "a"])
def test_license_scan_of_a_million_characters(unit):
    start = time.perf_counter()
    spans = licenses.Scanner().spans((unit * (1_000_000 // len(unit))).encode())
    assert time.perf_counter() - start < 60
    assert len([s for s in spans if s[0] == "cc-by"]) == (40_000 if "cc" in unit else 0)


# Line dedup


def test_line_dedup_equals_a_plain_version(spark):
    rows = [(k, f"own line {k}\n menu \r\n\nshared {k % 7}\nown end {k}", ["a", "b", None][k % 3]) for k in range(90)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "menu", "c"), (103, "menu", "a"), (5, rows[5][1], rows[5][2])]
    table = docs(spark, rows)
    cleaned = line_dedup.drop_boilerplate(table, ratio=0.2, least=3, counts=True)
    assert cleaned.columns == [*table.columns, "n_lines", "n_dropped"]
    want = brute.without_boilerplate([(s, t) for _, t, s in rows], 0.2, 3)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    got = [(r["doc_id"], r["text"], r["source"]) for r in cleaned.collect()]
    assert sorted(got, key=key) == sorted([(k, w, s) for (k, _, s), w in zip(rows, want)], key=key)
    counts = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in cleaned.collect()}
    assert counts[100] == (0, 0) and counts[101] == (1, 0) and counts[103] == (1, 1) and counts[102] == (1, 0)


def test_copies_do_not_take_each_others_lines(spark):
    rows = [(k, "a page\nthat was copied\nmenu", "a") for k in range(9)] + [(20 + k, f"own {k}\nmenu", "a") for k in range(9)]
    cleaned = line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.2, least=3).collect()
    assert {r["text"] for r in cleaned} == {"a page\nthat was copied", *[f"own {k}" for k in range(9)]}


def edited_copies(n):
    """``n`` copies of a text of 20 lines, each with another word of its own in one line."""
    lines = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(20)]
    return ["\n".join([*lines[: k % 20], lines[k % 20] + f" edit{k}", *lines[k % 20 + 1 :], "menu"]) for k in range(n)]


def test_near_copies_do_not_take_each_others_lines(spark):
    copies = edited_copies(30)
    rows = [(k, t, "a") for k, t in enumerate(copies)] + [(None, copies[0], "a"), (3, copies[4], "b"), (40, None, "a")]
    rows += [(100 + k, f"own {k}\nmenu", "a") for k in range(20)]
    cleaned = line_dedup.drop_boilerplate(docs(spark, rows), copies=(5, (4, 5))).collect()
    got = sorted((r["source"], r["text"]) for r in cleaned if r["text"] is not None)
    want = [("a", t.removesuffix("\nmenu")) for t in [*copies, copies[0], *(f"own {k}" for k in range(20))]]
    assert got == sorted([*want, ("b", copies[4])]) and len(cleaned) == len(rows)


def test_line_dedup_without_broadcast_is_the_same(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.lit("one").alias("source"))
    both = []
    for limit in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", limit)
        both.append(sorted(map(tuple, line_dedup.drop_boilerplate(table, least=2).collect())))
    assert both[0] == both[1]
    assert both[0] != sorted(map(tuple, table.collect()))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


# HTML extraction

BROKEN = [
    "<a ", "<a", "<a x=\"1>", "<a '\"", "<a \">", "<x>", "</y>", "<!x", "</script ", "<b class=ad>", "<li><ul>", "<!--",
    "<p><div><x></y>",
]


@pytest.mark.parametrize("unit", BROKEN)
@pytest.mark.parametrize("before, after", [("", ""), ("<script>", ""), ("<p>", "\"")])
def test_broken_markup_is_read_in_linear_time(unit, before, after):
    def seconds(size):
        page = before + unit * (size // len(unit)) + after
        start = time.perf_counter()
        html_text.read_blocks(page)
        return time.perf_counter() - start

    # Twenty times the text; a quadratic reader would take 400 times as long.
    assert seconds(400_000) < 100 * max(seconds(20_000), 0.005)


def test_tags_end_where_quotes_allow():
    def texts(page):
        return [t for _, t in html_text.read_blocks(page)]

    assert texts("<p title='a>b'>x<p title=\"c>'d\">y") == ["x", "y"]
    assert texts("a <b \"c> d") == ['a <b "c> d']
    assert texts("a <p 'x <p \"y>\" z> b <i>c</i>") == ["a <p 'x", "b c"]
    assert texts("1 < 2 <3 </ <!d <!-- x") == ["1 < 2 <3 </ <!d"]
    assert texts("<script>a</script x>b<style>c</style") == ["b"]
    assert texts("<p>a<div><p>b</div>c<ul><li>d<li>e<ul><li>f</ul>g") == list("abcdefg")

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head>
<body class="has-sidebar"><header>H</header><nav><ul><li>m1<li>m2</ul></nav><!-- c <article>no</article> -->
<div id="cookie-notice">We use</div><main><article><h1>Ti<b>tle</b> one</h1><p>foo<br>bar &lt;b&gt; &nbsp;
caf&eacute; a<b>b</b>c<p>second<div class="ad">buy</div><ul><li>x<li>y</ul><script>var t="</p>";</script>
<form>name <input> <button>go</button></form><section class="comments"><article class="comment">nice</article>
</section><p>end 1 < 2 && 3 &amp</article></main><aside>side</aside><footer>&copy; f</footer></body></html>"""


def extracted(spark, rows, **kwargs):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    return {r["page_id"]: r for r in html_text.extract_text(pages, **kwargs).collect()}


def test_main_text_of_a_marked_article(spark):
    got = extracted(spark, [(1, "http://a.net/1", PAGE), (2, None, None), (3, "x", ""), (4, "x", "plain < text")])
    assert got[1]["text"] == "Title one foo bar <b> café abc second x y end 1 < 2 && 3 &"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[2]["url"], got[3]["text"]) == ("", None, "")
    assert got[4]["text"] == "plain < text"


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark):
    menu = "home news about contact all the other pages here"
    rows = [(k, f"http://Site.net/{k}", f"<body><div>{menu}</div><p>{k} is what only page {k} says.</p></body>") for k in range(5)]
    rows.append((9, "http://other.net/", f"<body><div>{menu}</div></body>"))
    rows.append((10, "http://site.net/10", f"<article>{menu}</article><div>{menu}</div>"))
    rows.append((4, rows[4][1], rows[4][2]))
    got = extracted(spark, rows)
    for k in range(5):
        assert got[k]["text"] == f"{k} is what only page {k} says."
        assert got[k]["n_boilerplate"] == 9
    assert got[9]["text"] == menu  # no other page of that host
    assert got[10]["text"] == menu and got[10]["n_boilerplate"] == 9  # an article stays whole


@pytest.mark.parametrize("name", [
    "content-sidebar-wrap", "elementor-widget-container", "search-result-text", "post-related-content", "form-wrapper",
])
def test_names_of_content_wrappers_do_not_silence_it(name):
    for page in (f"<div class='{name}'>text</div>", f"<article><div class='{name}'>text</div></article>",
                 f"<div id='{name}'><main>text</main></div>"):
        assert [t for kind, t in html_text.read_blocks(page) if kind != "out"] == ["text"]


def test_compound_names_around_an_article_do_not_silence_it():
    def kinds(page):
        return [kind for kind, _ in html_text.read_blocks(page)]

    assert kinds("<div class=content-sidebar>a<article>b</article></div>") == ["out", "main"]
    assert kinds("<main><div class=content-sidebar>a<article>b</article></div></main>") == ["out", "main"]
    assert kinds("<article>a<div class=post-comments><article>b</article></div></article>") == ["main", "out"]
    assert kinds("<div class=sidebar><article>a</article></div><p class=ad-2>b</p><p id=cookie-notice>c") == ["out"] * 3


def test_a_page_at_two_urls_is_no_repetition(spark):
    menu = "home news about contact all the other pages here"
    page = f"<div>{menu}</div><p>one two three four five six seven eight nine ten</p>"
    urls = ["http://a.net/1", "http://a.net/1?ref=x", "http://a.net/1/", "http://b.net/1"]
    rows = [(k, u, page) for k, u in enumerate(urls)] + [(8, "http://a.net/1#top", page.replace("<p>", "<p data-n=7>"))]
    text = f"{menu} one two three four five six seven eight nine ten"
    got = extracted(spark, rows)
    assert {(r["text"], r["n_boilerplate"]) for r in got.values()} == {(text, 0)}
    got = extracted(spark, [*rows, (9, "http://a.net/2", f"<div>{menu}</div><p>another page")])
    assert {k: (r["text"], r["n_boilerplate"]) for k, r in got.items() if k not in (3, 9)} == dict.fromkeys(
        (0, 1, 2, 8), (text.removeprefix(f"{menu} "), 9)
    )
    assert (got[3]["text"], got[9]["text"]) == (text, "another page")


def test_html_equals_a_plain_extraction(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op3_html_text"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        article = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        want = " ".join(html.unescape(article).split())
        r = got[page["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), page["url"])


def test_html_of_nothing_and_of_odd_markup(spark):
    assert extracted(spark, []) == {}
    odd = "<article>a<p>b</div></section>c</article></article><p>" + "<div>" * 3000 + "deep" + "<b" * 50
    assert extracted(spark, [(1, "u", odd), (2, "u2", "<script>x"), (3, "u3", "<!-- open <p>x")])[1]["text"].startswith("a b c deep")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab p\"'=!-&;", max_size=60))
def test_any_markup_is_read(text):
    html_text.main_text(html_text.read_blocks(text), set())


# URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("ORG", "", "block"), (None, "/", "block"), ("org", None, "allow")]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate(brute.LOWER), m[2]
    best = None
    for h, p, v in rules:
        h, p = (h or "").translate(brute.LOWER), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), len(h), h + p, v)) if best else (len(h + p), len(h), h + p, v)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules_equal_a_plain_version(spark):
    urls = [
        "http://net/", "http://x.NET/a?b#c", "http://x.net", "https://example.net/en/q", "http://a.example.net/en/xy",
        "http://b.a.example.net/en/xy", "http://aexample.net/en/x", "ftp://z.org", "http://org.com/", "no url", None, "",
        "://net/", "http://a.b.c.d.e.org/p#x://y", "http://example.net/en", "http://..net/", "http://x.net/" + "p" * 5000,
        "http://a.example.net/en/x", "http://a.example.net/en/x", "http://é.net/ü",
    ]
    table = spark.createDataFrame([(k, u, "mine", "h") for k, u in enumerate(urls)], "page_id long, url string, verdict string, extra string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(table, rules).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        r = got[k]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(url, RULES), url
        assert (r["url"], r["extra"]) == (url, "h")


def test_many_nested_rules(spark):
    rules = [(h, "/" + "/".join("p" * n) + "/" * bool(n), v) for h, v in (("net", "block"), ("a.net", "allow"), ("com", "block")) for n in range(30)]
    urls = [f"http://{h}/" + "p/" * n for h in ("net", "a.net", "x.a.net", "b.com", "z.de") for n in range(0, 40, 3)]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(7)
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(table, frame).collect()}
    for k, url in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == plain_verdict(url, rules), url


def test_url_filter_without_rules_or_urls(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filters.judge_urls(urls, none, default="block").collect()] == [(1, "http://a.net/", "a.net", "/", None, "block")]
    rules = spark.createDataFrame(RULES, none.schema)
    assert url_filters.judge_urls(urls.limit(0), rules).count() == 0


def test_url_filter_plan_has_no_python(spark, sf):
    plan = QUERIES["op1_url_filters"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op1_url_filters", "op5_quality_rules", "op10_line_dedup"])
def test_query_equals_sql(spark, sf, name):
    from strayrow.llm.oracles import SQL

    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), SQL[name]) == []


def test_nodes_of_a_large_loose_group_are_written_once_for_each_tile(spark, monkeypatch):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from strayrow.functions.materialize import pin
    from strayrow.llm import jaccard

    draw = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for n in range(140):
        words = list(base)
        for k in range(draw.randint(1, 3)):
            words[draw.randrange(100)] = f"x{n}y{k}"
        texts.append(" ".join(words))
    sets = [jaccard.shingles(t.encode(), 5) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            if 5 * both >= 4 * (len(x) + len(y) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    across, seen = jaccard._across, []

    def counted(rows, num, den, best):
        rows = pin(rows)
        out = pin(across(rows, num, den, best))
        seen.append((best, rows.count(), out.count()))
        return out

    # No first links, so that the tiles hold all nodes as components of their own.
    monkeypatch.setattr(jaccard, "_across", counted)
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *_: pairs.where(F.lit(False)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert found == dict(enumerate(label))
    assert [best for best, *_ in seen][0] and all(out <= rows for best, rows, out in seen if not best)


def test_components_of_few_links_leave_few_files(spark, monkeypatch):
    from strayrow.functions.materialize import Scratch
    from strayrow.llm import components as module

    kept, keep = [], Scratch.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        kept.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(Scratch, "keep", watched)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.range(300).selectExpr("id + 1 AS a", "id AS b").where("a % 50 <> 0")
        found = {r["node"]: r["component"] for r in module.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {n: n // 50 * 50 for n in range(301) if n != 300}
    assert len(kept) > 2 and all(files == 1 for name, files in kept if name != "edges")
