"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags.  Tags score negative; a word scores the log odds that it lies in the main text, by the
elements around it, up to 1, which is positive unless these elements speak against it.  Then it and the tags beside it score
next to nothing below zero, so that an advert amid an article can't cut it in two.  One linear scan finds the contiguous region
with the largest sum, and its words of a positive score are the text.

The weights come from labelled pages, which are those of the table that mark their text with one ``<article>`` (or
``<main>``) element: a logistic regression of the words on the names of the elements around them and on the pieces of these
elements' classes, ids and roles, and log odds of each tag.  The labelling element itself is no feature.  What the labelled
pages say nothing of keeps its prior weight; no piece decides alone, since weights add up.  A common factor for the tags is
chosen on a third of the pages that the other weights haven't seen.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import map_batches

#: Labelled pages to fit on, at most; the longest page among them.
SAMPLE, SAMPLE_CHARS = 512, 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not markup, or not text.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
HIDDEN = RAW | {"head", "svg", "math", "canvas", "object", "audio", "video", "select", "datalist"}
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Prior weights of elements, and of pieces of classes, ids and roles (marked by a dot).
PRIOR = (
    {f: -4.0 for f in "nav footer aside form button menu dialog fieldset header".split()}
    | {f".{f}": -3.0 for f in (
        "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
        "alert popup modal overlay newsletter subscribe subscription sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
        "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar "
        "pagination pager login signup search contentinfo complementary"
    ).split()}
    | {f".{f}": 4.0 for f in "content article post entry story main body text page wrapper container layout site has".split()}
)
#: Names that any part of a page may have: they need much evidence.
COMMON = frozenset("html body div section span p ul ol li dl dt dd table tbody thead tr td th a b i em strong h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center font small br img hr".split())


@dataclass
class Weights:
    """Scores: of a word without further evidence, of features of the elements around it, of tags by name, of other tags."""

    word: float = 1.0
    features: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.1
    aside: float = -0.001

    def around(self, features: tuple[str, ...]) -> float:
        return sum(self.features.get(f, 0.0) for f in features)


def _features(name: str, attributes: str, seen: dict[tuple[str, str], tuple[str, ...]]) -> tuple[str, ...]:
    """An element's name and the pieces of its class, id and role."""
    key = (name, attributes)
    if key not in seen:
        pieces = {p.lower() for a in _ATTRIBUTE.finditer(attributes) for p in _PIECE.findall(a[2] or a[3] or a[4] or "")} if "=" in attributes and name not in ("html", "body") else ()
        seen[key] = (name, *sorted(f".{p}" for p in pieces))
    return seen[key]


def _parse(page: str, seen: dict | None = None) -> list[tuple[str, str, tuple[str, ...], int]]:
    """Tokens in order: ("", text, (), 0) or (tag, "", features, end), a tag being ``<name`` or ``</name`` and ``end`` the number of the
    token that ends the element (its own, if none does).  What is hidden is left out."""
    found: list[tuple[str, str, tuple[str, ...]]] = []
    seen, at = {} if seen is None else seen, 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            found.append(("", page[at : m.start()], ()))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            found.append((f"</{name}", "", ()))
            continue
        attributes = m[3] if m[2] else m[6]
        found.append((f"<{name}", "", _features(name, attributes, seen)))
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            found.append((f"</{name}", "", ()))
            at = end.end() if end else len(page)
    if at < len(page):
        found.append(("", page[at:], ()))
    # where each element ends: a stack for each name
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = defaultdict(list)
    for k, (tag, _, _) in enumerate(found):
        if tag[:2] == "</":
            if open_[tag[2:]]:
                ends[open_[tag[2:]].pop()] = k
        elif tag and tag[1:] not in VOID:
            if tag == "<p" and open_["p"]:
                ends[open_["p"].pop()] = k
            open_[tag[1:]].append(k)
    out: list[tuple[str, str, tuple[str, ...], int]] = []
    number, k = {}, 0
    while k < len(found):
        tag, text, features = found[k]
        number[k] = len(out)
        if tag[1:] in HIDDEN and tag[:2] != "</" and ends.get(k, k) > k:
            for x in range(k, ends[k] + 1):
                number[x] = len(out)
            out.append((f"</{tag[1:]}", "", (), 0))
            k = ends[k]
        else:
            out.append((tag, text, features, k))
        k += 1
    return [(tag, text, features, number[ends.get(end, end)] if features else 0) for tag, text, features, end in out]


def _join(parts: list[tuple[str, str]]) -> str:
    """The text of (tag, text) in order: blocks are parted by a space."""
    return " ".join("".join(html.unescape(text) if not tag else "" if tag.lstrip("</") in INLINE else " " for tag, text in parts).split())


def scores(tokens: list[tuple[str, str, tuple[str, ...], int]], w: Weights) -> list[float]:
    """The score of each token; a text's is that of its words together."""
    out, odds, back, inside = [], w.word, defaultdict(float), 0
    for k, (tag, text, features, end) in enumerate(tokens):
        if tag[:2] != "</":  # a closing tag belongs to its element
            odds -= back.pop(k, 0.0)
        if not tag:
            out.append((min(odds, 1.0) if odds > 0 else w.aside) * len(text.split()))
            continue
        if tag in ("<article", "<main"):
            inside += 1
        elif tag in ("</article", "</main") and inside:
            inside -= 1
        if features and end > k and not (tag == "<header" and inside):  # an article's own header holds its title
            around = w.around(features)
            odds += around
            back[end] += around
        out.append(w.tags.get(tag, w.other) if odds > 0 else w.aside)
        odds -= back.pop(k, 0.0) if tag[:2] == "</" else 0.0
    return out


def region(values: list[float]) -> tuple[int, int]:
    """The contiguous part with the largest sum (the first and longest such); empty if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, k
        total += v
        if total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def extract_text(page: str | None, w: Weights, seen: dict | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tokens = _parse(page, seen)
    values = scores(tokens, w)
    a, b = region(values)
    return _join([(t[0], t[1]) for t, v in zip(tokens[a:b], values[a:b], strict=True) if t[0] or v > 0])


def labelled(page: str) -> tuple[list, int, int] | None:
    """The tokens of a page and the first and last one of its marked text, if it has one ``<article>`` or else one ``<main>``."""
    tokens = _parse(page)
    tags = [t[0] for t in tokens]
    box = "article" if tags.count("<article") == 1 else "main"
    if tags.count(f"<{box}") != 1 or f"</{box}" not in tags:
        return None
    return tokens, tags.index(f"<{box}") + 1, len(tags) - 1 - tags[::-1].index(f"</{box}")


def _regression(counts: dict[tuple[str, ...], list[float]]) -> tuple[float, dict[str, float]]:
    """Weights of a word and of features by Newton's method, from words inside and outside by the features around them."""
    names = sorted({f for key in counts for f in key})
    x = np.zeros((len(counts), len(names) + 1))
    x[:, 0] = 1
    for i, key in enumerate(counts):
        for f, n in Counter(key).items():
            x[i, names.index(f) + 1] = n
    n = np.array(list(counts.values()), float)
    n *= 1000 / n.sum()  # so many words speak against the priors
    mean = np.array([1.0, *(PRIOR.get(f, 0.0) for f in names)])
    hold = np.array([100.0, *(100.0 if f in COMMON else 0.5 for f in names)])
    w = mean.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n[:, 0] - n.sum(axis=1) * p) - hold * (w - mean)
        bend = (x * (n.sum(axis=1) * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), dict(zip(names, w[1:].tolist(), strict=True))


def fit(pages: list[str]) -> Weights:
    """Weights from labelled pages; the priors without any."""
    cases = [c for c in map(labelled, pages) if c]
    if not cases:
        return Weights()
    held = [c for k, c in enumerate(cases) if k % 3 == 2] or cases
    seen = [c for k, c in enumerate(cases) if k % 3 != 2]
    counts: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for tokens, a, b in seen:
        live: list[tuple[int, tuple[str, ...]]] = []
        for at, (tag, text, features, end) in enumerate(tokens):
            live = [x for x in live if x[0] > at]
            if not tag:
                around = tuple(sorted(f for _, fs in live for f in fs if f not in ("article", "main")))
                if not a <= at < b:
                    counts[around][1] += len(text.split())
                elif not any(PRIOR.get(f, 0) < 0 for f in around):  # a marked text may hold adverts and comments, which it doesn't speak for
                    counts[around][0] += len(text.split())
            elif features and end > at and at != a - 1:
                live.append((end, features))
    word, found = _regression({k: v for k, v in counts.items() if sum(v)} or {(): [1.0, 0.0]})
    # tags where no element speaks against the text
    w, tags = Weights(word, PRIOR | found), (Counter(), Counter())
    for tokens, a, b in seen:
        for at, (t, v) in enumerate(zip(tokens, scores(tokens, w), strict=True)):
            if v != w.aside and at not in (a - 1, b):
                tags[not a <= at < b][t[0] or "word"] += 1 if t[0] else len(t[1].split())
    total = [max(t.pop("word", 1), 1) for t in tags]
    odds = {t: math.log((tags[0][t] + 0.5) / total[0]) - math.log((tags[1][t] + 0.5) / total[1]) for t in {*tags[0], *tags[1]}}
    best: tuple[int, float, Weights] | None = None
    for factor in (0.25, 1.0, 4.0):
        w = Weights(word, PRIOR | found, {t: min(max(factor * v, -8.0), -0.1) for t, v in odds.items()})
        right = accuracy(held, w)
        if best is None or right > best[0]:
            best = (right, factor, w)
    return best[2]


def accuracy(cases: list[tuple[list, int, int]], w: Weights) -> int:
    """Of how many labelled pages the scan gives back just the marked text's words of a positive score."""
    right = 0
    for tokens, a, b in cases:
        values = scores(tokens, w)
        shown = lambda lo, hi: [k for k in range(lo, hi) if not tokens[k][0] and values[k] > 0]  # noqa: B023, E731
        right += shown(*region(values)) == shown(a, b) != []
    return right


def fit_table(pages: DataFrame, html_col: str = "html") -> Weights:
    """Fit on up to ``SAMPLE`` different labelled pages, those of the smallest hashes, so that reruns agree."""
    marked = pages.select(F.col(html_col).alias("html")).where("html rlike '(?i)<(article|main)[ >]'").where(f"length(html) <= {SAMPLE_CHARS}").withColumn("hash", F.xxhash64("html"))
    picked = [r.hash for r in marked.select("hash").distinct().orderBy("hash").limit(SAMPLE).collect()]
    if not picked:
        return Weights()
    rows = marked.where(F.col("hash") <= picked[-1]).dropDuplicates(["hash"])  # the sample's pages only
    return fit([r.html for r in sorted(rows.collect(), key=lambda r: r.hash)])


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (its code points) per row.

    A null or empty page, or one without words, gives the empty text; repeated rows give a row each; an empty table none.
    Columns named text or n_chars are replaced.
    """
    w = weights or fit_table(pages, html_col)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict = {}
            texts = [extract_text(p.as_py(), w, seen) for p in b.column(len(others))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(others))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"])

    picked = pages.select(*others, html_col)
    schema = picked.drop(html_col).schema.add("text", "string").add("n_chars", "long")
    return map_batches(picked, run, schema)
