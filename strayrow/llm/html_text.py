"""Main text of web pages: marked articles, and what a host's pages do not repeat.

A page is read into blocks of text in page order; scripts, styles, comments and markup go, character
references are decoded. A block is *main* inside a marked article, *out* inside menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, else *open*: pages without a marked
article have only open and out blocks. A class, id or role marks an element as out by its whole name
or by the last word of a compound name ("cookie-notice", not "notice-text"). What a compound name
marks outside of an article does not silence a main element or an article inside.

In place of a host suffix array: of the token streams of all blocks that are not main, of all pages
of a host, every suffix gives its first ``RUN`` tokens as a hash, and equal heads are grouped. No
suffixes are sorted and no longer repeats are sought. A head that stands on two distinct pages is a
repeated window; all tokens that such windows cover are the host's boilerplate. It is cut from open blocks, and what is left
of them, the unique runs, joins the text. Main blocks stay whole even if another page repeats them.
Windows meet by (host, head) after a partial aggregation, so neither a hot host nor a hot head
gathers in one task.

Edge cases: null or empty html gives an empty text; a null url has an empty host; rows of a
host whose pages read as the same blocks, under whatever urls, are one page when repetitions are
sought, and each gets its result; pages that differ in some words are distinct; an unclosed element
ends where an outer one ends, a tag without an end is text; a page is read in time linear in its
length, whatever its markup; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin
from strayrow.llm.url_filters import host_and_path

RUN = 8
BROADCAST_PAGES = 250_000

#: A tag without ``<`` inside, as nearly all are; a failure reads no farther than the next ``<``.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>"
)
_NAME_END = re.compile(r"[\s/>]")
_TAG_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template title textarea select svg math iframe object head".split())
RAW = frozenset("script style title textarea iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
OUT = frozenset("nav header footer aside form menu button dialog".split())
#: Names, and last words of compound names, of a class, id or role that mark an element as not main.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar aside cookie cookies "
    "consent gdpr notice popup modal newsletter subscribe signup share sharing social related "
    "recommended comment comments respond replies disqus form search login widget".split()
)
#: A name that begins so tells about the page, not about the element.
QUALIFIERS = frozenset("has with no without layout page is".split())
MAIN = frozenset(["article", "main"])
SOFT, WHOLE = 1, 2
MAIN_ROLES = frozenset(["main", "article"])
#: An element that closes an open one of the same group, if no other stands between.
_CLOSES = {t: {t} for t in ("li", "option", "tr")} | {
    t: {"dt", "dd"} for t in ("dt", "dd")
} | {t: {"td", "th"} for t in ("td", "th")}


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Whole names, and last words of compound names; numbers at the end do not count."""
    whole: set[str] = set()
    heads: set[str] = set()
    if "=" not in attributes:
        return whole, heads
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            words = _WORD.findall(name)
            while len(words) > 1 and words[-1].isdigit():
                words.pop()
            if words and words[0] not in QUALIFIERS:
                (heads if len(words) > 1 else whole).add(words[-1])
    return whole, heads


class _Markup:
    """Finds the tags, comments and declarations of a page, front to back, in linear time.

    What a search found is remembered until it is passed, and a quote from which no tag ends is
    never tried again, so broken markup is not read once for every ``<``.
    """

    def __init__(self, page: str):
        self.page = page
        self.ahead: dict[re.Pattern | str, tuple[int, int]] = {}
        self.endless: set[int] = set()

    def next(self, what: re.Pattern | str, at: int) -> int:
        """Place of the first ``what`` from ``at`` on, or the page's size."""
        since, place = self.ahead.get(what, (0, -1))
        if not since <= at <= place:
            if isinstance(what, str):
                place = self.page.find(what, at)
            else:
                match = what.search(self.page, at)
                place = match.start() if match else -1
            place = place if place >= 0 else len(self.page)
            self.ahead[what] = (at, place)
        return place

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, with quoted values skipped, or the page's size."""
        page, size = self.page, len(self.page)
        passed = []
        while True:
            at = self.next(_TAG_STOP, at)
            if at == size or at in self.endless:
                self.endless.update(passed)
                return size
            if page[at] == ">":
                return at
            passed.append(at)
            at = page.find(page[at], at + 1) + 1
            if not at:
                self.endless.update(passed)
                return size

    def token(self, at: int) -> tuple[int, int, str | None, str, str]:
        """Start, end, slash, name and attributes of the next token from ``at`` on.

        The name is empty for comments and declarations; without a token the start is the page's size.
        """
        page, size = self.page, len(self.page)
        start = at - 1
        while True:
            start = page.find("<", start + 1)
            if start < 0:
                return size, size, None, "", ""
            tag = _TAG.match(page, start)
            if tag:
                return start, tag.end(), tag[1], tag[2].lower(), tag[3]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, None, "", ""
            if page.startswith(("<!", "<?"), start):
                end = self.next(">", start + 2)
                if end < size:
                    return start, end + 1, None, "", ""
                continue
            slash = "/" if page.startswith("/", start + 1) else ""
            name = start + 1 + len(slash)
            letter = page[name : name + 1]
            if not (letter.isascii() and letter.isalpha()):
                continue
            stop = self.next(_NAME_END, name + 1)
            end = self.tag_end(stop) if stop < size else size
            if end < size:
                return start, end + 1, slash, page[name:stop].lower(), page[stop:end]


def read_blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of the page's blocks; kind is main, open or out."""
    blocks: list[tuple[str, str]] = []
    #: Open elements: tag, whether it is out (SOFT: an article inside is not), main (WHOLE: in an
    #: article), silent (each with what is around it).
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    #: Places in the stack of the open elements of a tag.
    places: dict[str, list[int]] = {}
    parts: list[str] = []

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, out, main, _ = stack[-1]
            blocks.append(("out" if out else "main" if main else "open", text))
        parts.clear()

    def last(tags: Iterable[str]) -> int:
        found = 0
        for t in tags:
            if places.get(t):
                found = max(found, places[t][-1])
        return found

    def close(tags: Iterable[str], stop: Iterable[str] = ()) -> None:
        k = last(tags)
        if k and k >= last(stop):
            while len(stack) > k:
                places[stack.pop()[0]].pop()

    markup = _Markup(page)
    at = 0
    size = len(page)
    while at < size:
        start, end, slash, tag, attributes = markup.token(at)
        if start > at and not stack[-1][3]:
            parts.append(page[at:start])
        if start == size:
            break
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            end_block()
        if slash:
            k = last((tag,))
            if k:
                if tag in INLINE and stack[k - 1][1:] != stack[-1][1:]:
                    end_block()
                close((tag,))
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            close(("p",), ("div", "article", "section", "td", "th", "li", "button", "main"))
            if tag in _CLOSES:
                close(_CLOSES[tag], ("ul", "ol", "dl", "table", "select", "menu"))
        if attributes.endswith("/"):
            continue
        _, out, main, silent = stack[-1]
        whole, heads = _names(attributes)
        roles = whole if "role" in attributes.lower() else set()
        marked = WHOLE if tag == "article" or "article" in roles else SOFT if tag in MAIN or roles & MAIN_ROLES else 0
        if marked and out == SOFT:
            out = 0
        if tag in OUT or whole & OUT_NAMES and tag not in ("html", "body"):
            out = WHOLE
        elif heads & OUT_NAMES and tag not in ("html", "body"):
            out = max(out, WHOLE if main == WHOLE else SOFT)
        now = (tag, out, max(main, marked), silent or tag in SILENT)
        if tag in INLINE:
            if now[1:] == stack[-1][1:]:
                continue  # changes nothing; its end tag is ignored
            end_block()
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = min(size, markup.next(">", end.end()) + 1) if end else size
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(now)
    end_block()
    return blocks


def tokens_outside(blocks: list[tuple[str, str]]) -> list[str]:
    return [t for kind, text in blocks if kind != "main" for t in text.split(" ")]


def heads(tokens: list[str], run: int) -> np.ndarray:
    """Hashes of the first ``run`` tokens of every suffix that has as many."""
    return np.array(
        [xxhash.xxh3_64_intdigest(" ".join(tokens[k : k + run])) for k in range(len(tokens) - run + 1)],
        np.uint64,
    ).view(np.int64)


def content(blocks: list[tuple[str, str]]) -> int:
    """Hash of a page's blocks, whatever the markup."""
    return xxhash.xxh3_64_intdigest("\n".join(f"{kind} {text}" for kind, text in blocks)) - (1 << 63)


def main_text(blocks: list[tuple[str, str]], covered: set[int]) -> str:
    """Main blocks, and of open blocks the tokens that are not covered, joined by blanks."""
    out, place = [], 0
    for kind, text in blocks:
        if kind == "main":
            out.append(text)
            continue
        tokens = text.split(" ")
        if kind == "open":
            out += [t for k, t in enumerate(tokens, place) if k not in covered]
        place += len(tokens)
    return " ".join(out)


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run: int = RUN,
) -> DataFrame:
    """Id, url, ``text``, ``n_chars`` (code points) and ``n_boilerplate`` (tokens outside the
    main blocks that the host's pages repeat)."""
    host, _ = host_and_path(F.col(f"`{url_col}`").cast("string"))
    raw = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
        F.xxhash64(host, F.col(f"`{html_col}`").cast("string")).alias("page"),
        host.alias("host"),
    )

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [read_blocks(p or "") for p in batch.column(2).to_pylist()]
            found = [heads(tokens_outside(b), run) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([content(b) for b in blocks], pa.int64()),
                    pa.array([any(kind == "open" for kind, _ in b) for b in blocks], pa.bool_()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["page", "host", "content", "open", "heads"],
            )

    suffixes = (
        raw.select("page", "host", "html")
        .mapInArrow(streams, "page long, host string, content long, open boolean, heads array<long>")
        .select("page", "host", "content", "open", F.posexplode("heads").alias("place", "head"))
    )
    suffixes = pin(suffixes)
    repeated = (
        suffixes.groupBy("host", "head")
        .agg(F.min("content").alias("first"), F.max("content").alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("host", "head")
    )
    tokens = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + run - 1))))
    covered = pin(
        suffixes.join(repeated, ["host", "head"], "left_semi")
        .groupBy(F.col("page").alias("_page"), "open")
        .agg(F.collect_set("place").alias("places"))
        # Only open blocks lose tokens; of other pages the count is enough.
        .select("_page", F.size(tokens).cast("long").alias("cut"), F.when(F.col("open"), tokens).alias("tokens"))
    )
    if covered.count() <= BROADCAST_PAGES:
        covered = F.broadcast(covered)
    placed = raw.join(covered, F.col("page") == F.col("_page"), "left").select("id", "url", "html", "cut", "tokens")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                main_text(read_blocks(page or ""), set(covered or ()))
                for page, covered in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                    batch.column(3).fill_null(0),
                ],
                names=[id_col, url_col, "text", "n_chars", "n_boilerplate"],
            )

    kinds = dict(raw.dtypes)
    return placed.mapInArrow(
        texts,
        f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long, n_boilerplate long",
    )
