import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pytest

from vecframe.llm import html_extract as h

D = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string"


def node(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return f"word{rng.randrange(40)}"
    tag = rng.choice(["div", "section", "ul"])
    return (tag, [node(rng, depth - 1) for _ in range(rng.randrange(1, 4))])


def source(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(source, x[1]))}</{x[0]}>"


def all_parts(x):
    if not isinstance(x, str):
        yield source(x)
        for c in x[1]:
            yield from all_parts(c)


def words(x, bad):
    if isinstance(x, str):
        return x
    return "\n" if source(x) in bad else "\n" + "".join(words(c, bad) for c in x[1]) + "\n"


def removed(x, bad):
    return 0 if isinstance(x, str) else 1 if source(x) in bad else sum(removed(c, bad) for c in x[1])


def test_same_as_brute_force_on_trees(spark):
    rng = random.Random(2)
    shared = [node(rng, 3) for _ in range(6)]
    rows, trees = [], []
    for i in range(80):
        host = f"h{i % 3}"
        parts = [rng.choice(shared) if rng.random() < 0.5 else node(rng, 3) for _ in range(4)]
        trees.append((host, ("div", [f"own{i} ", *parts])))
        rows.append((i, f"https://{host}.com/{i}", f"<html><body>{source(trees[-1][1])}</body></html>"))
    count, size = Counter(), Counter(host for host, _ in trees)
    for host, t in trees:
        count.update((host, p) for p in set(all_parts(t)))
    got = {r.page_id: r for r in h.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r.page_id: r for r in h.extract_text(spark.createDataFrame(rows, SCHEMA), held=0).collect()}
    for i, (host, t) in enumerate(trees):
        bad = {p for (x, p), n in count.items() if x == host and n >= max(h.MIN_PAGES, -(-size[x] * h.MIN_SHARE // 1))}
        want = "\n".join(x.strip() for x in words(t, bad).split("\n") if x.strip())
        assert (got[i].text, got[i].n_removed) == (want, removed(t, bad))


def test_markup_that_pages_leave_open():
    text = lambda page: h.extract(page, frozenset())[0]
    assert text("<p>a<p>b<ul><li>c<li>d</ul>e") == "a\nb\nc\nd\ne"
    assert text("<head><title>x</title></head><body>y &amp; z<script>if (a < b) '</p>'</script>!") == "y & z\n!"
    assert text("a<!-- <p>no</p> -->b<br/>c") == "ab\nc"
    assert text("") == "" and text("<") == "<" and text("</div></div>x") == "x" and text("<div" * 2000) is not None
    assert text("<div>" * 3000 + "deep") == "deep"


class Naive(HTMLParser):
    """Events of a page by the standard library's parser, and its elements by plain loops over a stack."""

    HIDDEN = {"script", "style", "noscript", "template", "iframe", "head", "svg"}
    VOID = set("area base br col embed hr img input link meta param source track wbr".split())
    BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())

    def __init__(self, page):
        super().__init__()
        self.page, self.lines, self.events, self.stack, self.elements = page, [0], [], [], []
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()
        self.end_from(0, len(page))

    def at(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def end_from(self, k, end):
        for tag, start in self.stack[k:]:
            self.elements.append((start, end, tag))
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        a = self.at()
        self.events.append((a, "block" if tag in self.BLOCK else "", ""))
        while self.stack and tag in {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "head": ["body"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"]}.get(self.stack[-1][0], []):
            self.end_from(len(self.stack) - 1, a)
        if tag in self.BLOCK - {"br", "body"}:
            for k in reversed(range(len(self.stack))):
                if self.stack[k][0] == "p":
                    self.end_from(k, a)
                    break
                if self.stack[k][0] in self.BLOCK | {"html", "head"}:
                    break
        if tag in self.VOID:
            self.elements.append((a, a + len(self.get_starttag_text()), tag))
        else:
            self.stack.append((tag, a))

    def handle_endtag(self, tag):
        a = self.at()
        self.events.append((a, "block" if tag in self.BLOCK else "", ""))
        for k in reversed(range(len(self.stack))):
            if self.stack[k][0] == tag:
                self.end_from(k + 1, a)
                self.end_from(k, self.page.index(">", a) + 1)
                break

    def handle_data(self, data):
        self.events.append((self.at(), "text", data))

    def parts(self):
        return [(a, b, self.page[a:b]) for a, b, tag in self.elements if tag not in self.VOID | self.HIDDEN | {"html", "body"}]

    def text(self, template):
        cut = sorted((a, -b, part in template) for a, b, part in self.parts() if part in template)
        cut += [(a, -b, False) for a, b, tag in self.elements if tag in self.HIDDEN]
        out, gone, end = [], 0, -1
        spans = []
        for a, b, bad in sorted(cut):
            if a >= end:
                spans.append((a, -b))
                gone, end = gone + bad, -b
        for at, kind, data in self.events:
            if any(a <= at < b for a, b in spans):
                out.append("\0")
            elif kind == "text":
                out.append(data.replace("\n", " "))
            elif kind == "block":
                out.append("\0")
        return "\n".join(t for t in (" ".join(x.split()) for x in "".join(out).split("\0")) if t), gone


def test_query_against_another_parser(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").toPandas()
    hosts = [urlsplit(u).hostname or "" for u in pages.url]
    naive, count, of = [Naive(x) for x in pages.html], Counter(), defaultdict(set)
    for host, n in zip(hosts, naive):
        if n.page not in of[host]:
            of[host].add(n.page)
            count.update((host, part) for part in {part for *_, part in n.parts()})
    bad = defaultdict(set)
    for (host, part), n in count.items():
        if n >= max(h.MIN_PAGES, -(-len(of[host]) * h.MIN_SHARE // 1)):
            bad[host].add(part)
    got = h.op7(spark, D).toPandas().set_index("page_id")
    assert (got.n_removed > 0).sum() > 100
    tidy = lambda t: "\n".join(x for x in (" ".join(x.split()) for x in t.split("\n")) if x)
    for i, host, n in zip(pages.page_id, hosts, naive):
        assert (tidy(got.text[i]), got.n_removed[i]) == n.text(bad[host]), i


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "</span>" * 100_000 + "end",
    "<b>" * 100_000 + "</i>" * 100_000 + "end",
    "<div>" * 100_000 + "end" + "</div>" * 100_000,
    "<p>" + "<b>" * 100_000 + "<br>" * 100_000 + "end",
    "<p><body>" + "<b>" * 100_000 + "<hr>" * 100_000 + "end",
    "end" + "<!" * 200_000,
    "end" + "<a '" * 200_001,
    "end<!--" * 50_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.thread_time()
    assert h.extract(page, frozenset([1]))[0].replace("\n", "").startswith("end")
    h.hashed(page)
    assert time.thread_time() - began < 5


def test_copies_of_a_page_are_one_page(spark):
    rows = [(i, "http://copy.org/", "<p>only here</p>") for i in range(6)] + [(10 + i, "http://other.org/", f"<p>menu</p><b>{i}</b>") for i in range(6)] * 2
    got = {r.page_id: (r.text, r.n_removed) for r in h.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: ("only here", 0) for i in range(6)} | {10 + i: (str(i), 1) for i in range(6)}


def test_hashes_are_those_of_the_parts():
    rng = random.Random(4)
    page = "".join(rng.choice("ab<é\U0001f600\0") for _ in range(3000))
    spans = [sorted((rng.randrange(3001), rng.randrange(3001))) for _ in range(4000)] + [[i, i + rng.randrange(1, 4)] for i in range(2990)]
    got = h.hashes_of(page, np.array([a for a, _ in spans]), np.array([b for _, b in spans])).tolist()
    of = {}
    for (a, b), x in zip(spans, got):
        assert of.setdefault(page[a:b], x) == x
    assert len(set(of.values())) == len(of)


def test_share_of_a_large_host(spark):
    part = lambda name, i, of: f"<p>{name}</p>" if i < of else ""
    rows = [(i, f"http://big.org/{i}", f"<div>page {i}</div>{part('quoted', i, 519)}{part('menu', i, 520)}") for i in range(10_400)]
    got = {r.page_id: (r.text, r.n_removed) for r in h.extract_text(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {i: (f"page {i}" + "\nquoted" * (i < 519), int(i < 520)) for i in range(10_400)}


def test_odd_rows(spark):
    rows = [(i, u, f"<div>menu</div><p>text {i}</p>") for i, u in enumerate(["http://A.com/x", "http://a.com:80/y", "http://u@a.com", None, "", "a.com", "http://a.com?q", "http://a.com#f", "http://a.com", "http://a.com"])]
    rows += [(None, "http://a.com", None), (11, None, ""), (12, "http://a.com", "<p>" + "long " * 100_000 + "</p>")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS host_name", "3 AS subtrees", "4 AS `a.b`", "5 AS raw", "6 AS n_removed")
    got = h.extract_text(pages)
    assert got.columns == [*[c for c in pages.columns if c != "html"], "_text", "_n_removed"]
    by = {r.page_id: (r._text, r._n_removed) for r in got.collect()}
    assert by[0] == ("text 0", 1) and by[9] == ("text 9", 1) and by[None] == (None, 0) and by[11] == ("", 0) and by[3] == ("menu\ntext 3", 0)
    assert len(by[12][0]) > 400_000 and len(by) == 13
    assert h.extract_text(pages.limit(0)).count() == 0
