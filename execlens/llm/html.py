"""Main text of web pages by equivalence-class template deduction.

Tokens are elements and texts, told apart by the path of elements around them.  A token's occurrence
vector is its count on each page of its host; tokens of equal vectors form an equivalence class.  A
class is valid where at least half of the host's pages hold it and each of its elements lies in
elements of valid classes; so classes nest, each in that of its elements' parents.  Classes that occur
once on their pages are the template's skeleton, others are lists within it.  What is no template
token is a slot's content, and slots take the path of the innermost template element around them.

The element of the template whose slots hold most of the host's text outside boilerplate is where
its articles are, and slots below it are extracted.  Pages that lack it have another layout and are
their own template.  Only what a template can't know is told by names of elements and classes:
what `article` and `main` stand for, and adverts, menus, forms and comments inside them.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

# Fixed values of HTML: elements whose content is no text of the page, elements without content,
# elements that break a line of text, and elements that hold others.
RAW = "script|style|noscript|template|iframe|svg|textarea|select|button|object|canvas|audio|video|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article aside body center details dialog div dl fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul span a".split())
# What an element's name or its class, id and role say about it
AWAY = frozenset("nav footer aside form head dialog menu fieldset".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox banner promo promotion sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recirc comment comments disqus replies reviews widget toolbar pagination pager skip tags search".split()
)
# Words that say nothing about what an element holds: a class of one of the words above and of these says no more than the one
PLAIN_WORDS = frozenset("area bar block body bottom box buttons center container content form holder inner item items left link links list main module outer page panel post posts right section site slot top unit view wrap wrapper".split())
SITE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|site-header|page-header)(?:$|[\s_-])", re.I)
REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|responses)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|post|post-content|entry|entry-content|story|story-body|content|main|maincontent|main-content)(?:$|[\s_-])", re.I)

# a self-closed raw element holds nothing, and of those without an end tag only three hide the rest of the page
PIECES = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})(?:\s[^>]*)?(?<!/)>.*?</(?P=raw)\s*>|<(?:script|style|textarea)(?:\s[^>]*)?(?<!/)>.*$|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Support: a class of texts is template where its texts are on all of so many pages, at least; on fewer they may be an article's that is copied.
SUPPORT = 8
#: Templates of all hosts together up to this size are broadcast.
BROADCAST_BYTES = 32 << 20


def host_of(url: str | None) -> str:
    """Host of an address in lower case, without user and port; empty where there is none."""
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].split(":")[0].lower() if m else ""


def element(name: str, attrs: str) -> str:
    """An element's token: its name, and its class, id and role where it has any."""
    named = " ".join(v.strip("\"'").strip().lower() for _, v in ATTR.findall(attrs)) if "=" in attrs else ""
    return f"{name}.{named}" if named else name


def walk(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """The page's tokens as (kind, path, what): kind open, close, text, break or space.

    An end tag closes the nearest open element of its name; without one it is passed over.  A list
    item or table cell ends its open sibling.
    """
    stack: list[str] = []
    for m in PIECES.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", tuple(stack), text
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        close, attrs = (m["close"], m["attrs"]) if m["name"] else (m["close2"], m["attrs2"])
        if name == "br":
            yield "space", tuple(stack), name
            continue
        if close:
            if name in HOLDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].split(".")[0] == name:
                        yield "close", tuple(stack[: i + 1]), name
                        del stack[i:]
                        break
        elif name not in VOID and name in HOLDS and not attrs.endswith("/"):
            if name in ("li", "td", "th", "tr") and stack and stack[-1].split(".")[0] == name:
                stack.pop()
            stack.append(element(name, attrs))
            yield "open", tuple(stack), name
        if name in BLOCK:
            yield "break", tuple(stack), name


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _away_name(named: str) -> bool:
    """Whether one of the classes names boilerplate, and nothing but it."""
    for x in named.split():
        words = [w for w in re.split(r"[_-]+", x) if w]
        if any(w in AWAY_WORDS for w in words) and all(w in AWAY_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words):
            return True
    return False


@lru_cache(1 << 16)
def _article(x: str) -> bool:
    name, _, named = x.partition(".")
    return name in ("article", "main") or "articlebody" in named or named.split()[-1:] == ["main"]


@lru_cache(1 << 16)
def _away(x: str) -> bool:
    name, _, named = x.partition(".")
    return name in AWAY or bool(named) and _away_name(named)


@lru_cache(1 << 16)
def _remarks(x: str) -> bool:
    return bool(REMARKS.search(x.partition(".")[2]))


def in_article(path: tuple[str, ...]) -> bool | None:
    """Whether a slot of this path is an article's by names; None where nothing around it is named as one.

    Paths count from the innermost article, so that an element left open before it does no harm.
    """
    at = next((i for i in range(len(path) - 1, -1, -1) if _article(path[i])), None)
    if at is None:
        return None
    return not any(map(_remarks, path)) and not any(map(_away, path[at + 1 :]))


def counts(path: tuple[str, ...]) -> bool:
    """Whether a slot's text counts when the place of the articles is looked for."""
    by_name = in_article(path)
    return not any(_away(x) or SITE_HEADER.search(x.partition(".")[2]) or x.startswith("header") for x in path) if by_name is None else by_name


def chain(path: tuple[str, ...]) -> str:
    """A path without elements that stand within lines."""
    return "/".join(x for x in path if not x.startswith(("span", "a.")) and x != "a")


def text_token(path: tuple[str, ...], text: str) -> str:
    return f"{chain(path)}#{hashlib.md5(text.encode()).hexdigest()[:16]}"


def page_tokens(page: str) -> tuple[Counter, Counter]:
    """Counts of the page's tokens, and the characters of text that counts within each element, all depths below it included."""
    count, chars = Counter({"": 1}), Counter()
    within: Counter = Counter()
    for kind, path, what in walk(page):
        if kind == "open":
            count["/".join(path)] += 1
        elif kind == "text" and (t := squeeze(what)):
            count[text_token(path, t)] += 1
            within[path] += len(t)
    for path, n in within.items():
        if counts(path):
            for i in range(len(path) + 1):
                chars["/".join(path[:i])] += n
    return count, chars


def _h64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def valid_classes(tokens: dict[str, tuple[int, int]], n: int) -> dict[int, list[str]]:
    """Valid classes (tokens by vector) of a host of n pages, from each token's number of pages and vector.

    A class is valid where at least half of the pages hold it and each of its tokens lies in an element of a valid class.
    """
    classes: dict[int, list[str]] = {}
    for t, (pages, vector) in tokens.items():
        if 2 * pages >= n:
            classes.setdefault(vector, []).append(t)
    while True:
        known = {t for ts in classes.values() for t in ts}
        bad = [v for v, ts in classes.items() if any(t and _parent(t) not in known for t in ts)]
        if not bad:
            return {v: sorted(ts) for v, ts in classes.items()}
        for v in bad:
            del classes[v]


def _parent(token: str) -> str:
    """The element around an element or a text."""
    return token.partition("#")[0] if "#" in token else token.rpartition("/")[0]


def content_root(chars: dict[str, int]) -> str:
    """The element whose slots hold the articles, among elements with the text that counts below them ("" is the page).

    That named as an article with the most text, or else the deepest that holds over half of it all, or one named as
    content around that.
    """
    named = [p for p in chars if p and _article(p.rpartition("/")[2]) and not any(map(_remarks, p.split("/")))]
    if named:
        best = max(chars[p] for p in named)
        return min((p for p in named if chars[p] == best), key=lambda p: (p.count("/"), p))
    half = [p for p in chars if 2 * chars[p] > chars.get("", 0)]
    if not half:
        return ""
    root = max(half, key=lambda p: (p.count("/") + bool(p), p))
    parts = root.split("/")
    for i in range(len(parts), 0, -1):
        if MAIN_NAMES.search(parts[i - 1].partition(".")[2]):
            return "/".join(parts[:i])
    return root


def templates(pages: DataFrame) -> DataFrame:
    """(host, n, root, texts): of each host the number of pages, the place of its articles, and the texts outside articles that are template tokens.

    Occurrence vectors are compared by a hash that combines (page, count) over all pages without an
    order, so that a host's vectors are never gathered: tasks send one row per host and token.
    Tokens on fewer than half of the pages drop out after the sums, so a host's template has at most
    twice as many tokens as its pages have on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, page, row in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "row")]):
                count, chars = page_tokens(page or "")
                for token, n in count.items():
                    v = seen.setdefault((host, token), [0, 0, 0])
                    v[0] += 1
                    v[1] ^= _h64(f"{row} {n}")
                    v[2] += chars.get(token, 0)
            if seen:
                keys, values = list(seen), list(seen.values())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.int64())], ["host", "token", "pages", "vector", "chars"])

    rows = pages.select(_host(F.col("url")).alias("host"), "html", "row").mapInArrow(run, "host string, token string, pages long, vector long, chars long")
    sums = rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"))
    # texts of fewer pages, most of all rows, are never template
    sums = materialize(sums.where(~F.col("token").contains("#") | (F.col("pages") >= SUPPORT)))
    of_host = sums.groupBy("host").agg(F.count("*").alias("n"), F.max(F.when(F.col("token") == "", F.col("pages"))).alias("all"))
    met = join_hot(sums, of_host, ["host"], sums.count()).drop("n").withColumnRenamed("all", "n")
    kept = met.where((2 * F.col("pages") >= F.col("n")) & (~F.col("token").contains("#") | (F.col("pages") == F.col("n"))))
    grouped = kept.groupBy("host").agg(F.first("n").alias("n"), F.collect_list(F.struct("token", "pages", "vector", "chars")).alias("tokens"))

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(host, n, *template({t["token"]: (t["pages"], t["vector"], t["chars"]) for t in tokens}, n)) for host, n, tokens in zip(*[b.column(c).to_pylist() for c in ("host", "n", "tokens")])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())))], ["host", "n", "root", "texts"])

    return grouped.mapInArrow(deduce, "host string, n long, root string, texts array<string>")


def template(tokens: dict[str, tuple[int, int, int]], n: int) -> tuple[str, list[str]]:
    """The place of the articles, and template texts, of a host of n pages, from each token's pages, vector and text that counts."""
    classes = valid_classes({t: x[:2] for t, x in tokens.items()}, n)
    once = tokens[""][1]
    root = content_root({t: tokens[t][2] for ts in classes.values() for t in ts if "#" not in t})
    # texts of the page's own class: once on every page; within an article a text stays, it may be the article's own
    texts = [t for t in classes.get(once, ()) if "#" in t and not any(map(_article, _parent(t).split("/")))]
    return root, texts


def extract(page: str, texts: frozenset[str] = frozenset(), root: str | None = None) -> str:
    """Text of the page's slots below the element root: blocks in page order, one a line.  A page without it is its own template."""
    tokens = list(walk(page))
    if root is None or root and not any(kind == "open" and "/".join(path) == root for kind, path, _ in tokens):
        root = content_root(page_tokens(page)[1])
    depth = len(root.split("/")) if root else 0
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            if t := squeeze("".join(held)):
                blocks.append(t)
            held.clear()

    known: dict[tuple[str, ...], bool] = {}
    for kind, path, what in tokens:
        if kind == "break" or kind in ("open", "close") and what in BLOCK:
            end()
            continue
        if kind == "open" or kind == "close":
            continue
        ok = known.get(path)
        if ok is None:
            # below the root, or in an article that an element left open has put elsewhere
            named = in_article(path)
            below = "/".join(path[:depth]) == root
            ok = known[path] = named if named is not None else below and not any(_away(x) or SITE_HEADER.search(x.partition(".")[2]) or x.startswith("header") for x in path[depth:])
        if not ok:
            continue
        if kind == "space":
            held.append(" ")
        elif texts and (t := squeeze(what)) and text_token(path, t) in texts:
            held.append(" ")  # the same on every page: a template token and no slot
        else:
            held.append(_html.unescape(what))
    end()
    return "\n".join(blocks)


def _host(url: Column) -> Column:
    """host_of as a Column."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.substring_index(F.substring_index(authority, "@", -1), ":", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row.

    A null html is empty and gives an empty text; pages of a null or odd address share the host "";
    repeated rows give repeated results; an empty table gives no rows.  Pages meet their host's template by a
    broadcast while all templates are small, and else by a join that keeps a large host spread.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    made = materialize(templates(p.withColumn("row", F.xxhash64("page_id", "url", F.octet_length("html")))))
    size = made.agg(F.sum(F.octet_length("host") + F.octet_length("root") + F.octet_length(F.array_join("texts", " ")) + 64).alias("bytes"), F.sum("n").alias("n")).first()
    hosted = p.withColumn("host", _host(F.col("url")))
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(made.drop("n")), "host")
    else:
        joined = join_hot(hosted, made, ["host"], size["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(page or "", frozenset(t), r) for page, t, r in zip(b.column("html").to_pylist(), b.column("texts").to_pylist(), b.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(p.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "texts", "root").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
