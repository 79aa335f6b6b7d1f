"""Text of HTML pages without their site's template.

Every element subtree of a page is hashed, the different pages of each host that have it are
counted in Spark, and subtrees that recur across many of them are deleted before the text
is taken. The tree is built in one scan for tags, which closes what pages leave open. The
scan and the hashing of all subtrees, however deep, take time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..partitions import spread
from .common import forget, fresh, map_arrow, name, releasing, small, written

#: A subtree is template if at least so many different pages of the host have it, and such a
#: share of the host's different pages, however many those are.
MIN_PAGES = 5
MIN_SHARE = 0.05
HELD = 500_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_HIDDEN = frozenset("script style noscript template iframe head svg".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"p": _BLOCK - {"br", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
_ROOTS = ("html", "body", "head")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
#: Not template: elements without content, the page itself and what is hidden anyway.
_NEVER = _VOID | _HIDDEN | {"html", "body"}
_SPACE = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def subtrees(page: str) -> list[tuple[int, int, str]]:
    """(start, end, tag) of every element of a page, in order of their starts."""
    out: list[list] = []
    stack: list[int] = []
    #: how many elements of a name are open; of each open element, where on the stack the
    #: nearest paragraph or block is, itself included
    opened: dict[str, int] = {}
    nearest: list[int] = []
    at = 0

    def close(k: int, end: int) -> None:
        for i in stack[k:]:
            out[i][1] = end
            opened[out[i][2]] -= 1
        del stack[k:], nearest[k:]

    while m := _TAG.search(page, at):
        start, at = m.span()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                k = len(stack) - 1
                while out[stack[k]][2] != tag:
                    k -= 1
                found = stack[k]
                close(k, start)
                out[found][1] = at
            continue
        while stack and tag in _ENDS.get(out[stack[-1]][2], ()):
            close(len(stack) - 1, start)
        if tag in _ENDS["p"] and stack and nearest[-1] >= 0 and out[stack[nearest[-1]]][2] == "p":
            # a paragraph left open ends here even if inline elements in it are open too
            close(nearest[-1], start)
        out.append([start, at, tag])
        if tag in _VOID or page[at - 2 : at] == "/>":
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = out[-1][1] = end.end() if end else len(page)
            continue
        nearest.append(len(stack) if tag in _BLOCK or tag in _ROOTS else nearest[-1] if nearest else -1)
        stack.append(len(out) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    for i in stack:
        out[i][1] = len(page)
    return [tuple(x) for x in out]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = [_powers(x, 1 << 16) for x in _BASES]


def hashes_of(page: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a page: polynomials in its characters, from running sums, and then mixed."""
    c = np.frombuffer(page.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = (c + np.uint64(1)) * _MIX[1]
    c ^= c >> np.uint64(31)
    up, down = (p[: len(c) + 1] for p in (_POWERS if len(c) < len(_POWERS[0]) else [_powers(x, len(c) + 1) for x in _BASES]))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0]
    for m in _MIX:
        h ^= h >> np.uint64(32)
        h *= m
    return (h ^ h >> np.uint64(29)).view(np.int64)


def hashed(page: str) -> list[tuple[int, int, str, int]]:
    """The subtrees that may be template, with hashes of their source."""
    parts = [x for x in subtrees(page) if x[2] not in _NEVER]
    if not parts:
        return []
    h = hashes_of(page, np.array([x[0] for x in parts]), np.array([x[1] for x in parts])).tolist()
    return [(*x, k) for x, k in zip(parts, h)]


def extract(page: str, template: set[int] | frozenset[int]) -> tuple[str, int]:
    """(text, how many outermost template subtrees were deleted) of a page.

    Script, style, head and other hidden elements give no text; blocks begin new lines;
    entities are decoded and runs of spaces become one.
    """
    parts, gone, hide, at = [], 0, 0, 0
    trees = subtrees(page)
    known = hashes_of(page, np.array([x[0] for x in trees]), np.array([x[1] for x in trees])).tolist() if template and trees else [0] * len(trees)
    for (a, b, tag), h in zip(trees, known):
        if a < hide:
            continue
        bad = bool(template) and tag not in _NEVER and h in template
        if bad or tag in _HIDDEN:
            parts.append(page[at:a])
            gone += bad
            parts.append("<p>")
            at = hide = b
    parts.append(page[at:])
    out, at, kept = [], 0, "".join(parts)
    while m := _TAG.search(kept, at):
        out.append(kept[at : m.start()])
        if m[2] and m[2].lower() in _BLOCK:
            out.append("\x00")
        at = m.end()
    out.append(kept[at:])
    text = _SPACE.sub(" ", entities.unescape("".join(out).replace("\n", " ")).replace("\x00", "\n"))
    return _LINES.sub("\n", text).strip(), gone


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; "" if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) hashes that recur on many different pages of a host: copies of a page on a host count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.array(list({h for *_, h in hashed(x.as_py().decode("utf-8", "surrogateescape"))}), np.int64) for x in b.column(1)]
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["host", "page", "subtree"])

    rows = pages.filter(name(html).isNotNull()).select(host_of(name(url)).alias("host"), name(html).cast("binary").alias("raw"), F.xxhash64(name(html)).alias("page"))
    size = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(min_pages), F.ceil(F.col("n") * min_share))
    counts = spread(rows).mapInArrow(releasing(run), "host string, page long, subtree long").distinct().groupBy("host", "subtree").agg(F.count("*").alias("c")).filter(F.col("c") >= min_pages)
    return counts.join(size, "host").filter(F.col("c") >= least).select("host", "subtree")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", count: str = "n_removed", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, held: int = HELD) -> DataFrame:
    """``pages`` with the text outside template subtrees in place of the html.

    Pages without a host are a site of their own, "". Copies of a page count as one page of
    their host, so what only they share is no template. Up to ``held`` template hashes are
    sent to every task once, more are joined by host, with the same result. A null html gives a null text with 0
    subtrees removed, an empty one an empty text. Every row stays, repeated ones too. A new
    column whose name is taken gets a leading underscore.
    """
    rest = [c for c in pages.columns if c != html]
    text, removed, host, key, hashes, raw_html = fresh(rest, out, count, "host_name", "host_key", "subtrees", "raw_html")
    per = written(templates(pages, url, html, min_pages, min_share).groupBy(F.col("host").alias(key)).agg(F.collect_list("subtree").alias(hashes)), "templates")
    total = per.agg(F.sum(F.size(hashes))).first()[0] or 0
    rows = pages.select(*map(name, rest), host_of(name(url)).alias(host), name(html).cast("binary").alias(raw_html))
    sent = None
    if total <= held:
        sent = pages.sparkSession.sparkContext.broadcast({r[0]: frozenset(r[1]) for r in per.collect()})
        forget(per)
        rows = rows.select(*map(name, rest), host, F.lit(None).cast("array<long>").alias(hashes), raw_html)
    else:
        rows = rows.join(small(per, total), F.col(host) == F.col(key), "left").select(*map(name, rest), host, hashes, raw_html)
    k = len(rest)
    schema = rows.select(*map(name, rest), F.lit("").alias(text), F.lit(0).cast("long").alias(removed)).schema
    schema[text].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = dict(sent.value) if sent else {}
        for b in batches:
            texts, counts = [], []
            for i, (h, raw) in enumerate(zip(b.column(k).to_pylist(), b.column(k + 2))):
                raw = raw.as_py()
                if raw is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                if sent is None and h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = frozenset(b.column(k + 1)[i].as_py() or ())
                t, n = extract(raw.decode("utf-8", "replace"), known.get(h, frozenset()))
                texts.append(t)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*rest, text, removed])

    return map_arrow(rows, run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
