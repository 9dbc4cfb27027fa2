"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text that stands in them; each page votes for the generalised tag-class
paths of its best ones; Spark sums the votes per host; every page is extracted again by all the paths that won on its host,
with what stands right beside them in their parent. Class names lower a container's score; they take an element out of the
text only if it holds less than half of the page's running text, or readers' comments.
"""

from __future__ import annotations

import html as _entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settled

#: Share of a host's votes that a path needs, and a path with the same parent as one that has it.
SHARE, BESIDE = 0.1, 0.02
#: Paths that a page votes for.
VOTES = 5
#: What the score of a container is multiplied by if it is named as what is no article.
PENALTY = 0.2
#: Bytes of the winners' table, at most, that is sent to every executor; a larger one is joined by shuffle.
SENT_BYTES = 16 << 20

# The elements of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_OUT = frozenset("script style textarea title xmp iframe noembed noframes head nav footer aside form button select template svg noscript menu dialog object canvas header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = _HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption summary".split())
_BLOCK = _TEXTUAL | frozenset("html body div article section main header footer nav aside ul ol dl table thead tbody tfoot tr form fieldset figure details address hr center option menu dialog".split())
_CLOSES_P = _BLOCK - {"html", "body"}
_CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Words of class, id and role that name what is no part of an article.
_NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead share sharing social "
    "related recommended newsletter subscribe subscription signup login search toolbar pagination pager widget skip".split()
)
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Names that tell how a page is laid out, not what an element is.
_LAYOUT = re.compile(r"(?:has|no|with|without)[-_]", re.IGNORECASE)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in _RAW}
_WORD = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """A page's elements and blocks of text in order.

    Of each element: tag, parent, path, whether it is out of the text, and whether it is named as no article (1) or as
    comments (2); of each block: element, text, characters in links.
    """

    def __init__(self, html: str | None):
        self.tags, self.parents, self.paths, self.out, self.named = ["#"], [-1], [""], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._read(html or "")
        self._hide()

    def _hide(self) -> None:
        """Leave out the blocks of comments, and of elements named as no article that hold no more than half of the running text."""
        if not any(self.named):
            return
        n = len(self.tags)
        head = [tag in ("h1", "main") for tag in self.tags]
        for i in range(n - 1, 0, -1):
            head[self.parents[i]] = head[self.parents[i]] or head[i]
        self._leave_out([self.named[i] == 2 and not head[i] for i in range(n)])
        running = [0] * n
        for element, text, linked in self.blocks:
            running[element] += len(text) - linked
        for i in range(n - 1, 0, -1):
            running[self.parents[i]] += running[i]
        self._leave_out([self.named[i] == 1 and 2 * running[i] <= running[0] for i in range(n)])

    def _leave_out(self, hidden: list[bool]) -> None:
        for i in range(1, len(hidden)):
            hidden[i] = hidden[i] or hidden[self.parents[i]]
        self.blocks = [b for b in self.blocks if not hidden[b[0]]]

    def _flush(self, element: int) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append((element, text, min(self._linked, len(text))))
        self._parts, self._linked = [], 0

    def _read(self, html: str) -> None:
        stack, pos, links = [0], 0, 0
        tags, out = self.tags, self.out

        def holder() -> int:
            return next((i for i in reversed(stack) if tags[i] in _BLOCK), 0)

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                i = stack[-1]
                if tags[i] in _BLOCK:
                    self._flush(i)
                links -= tags[i] == "a"
                stack.pop()

        def say(raw: str) -> None:
            if out[stack[-1]]:
                return
            text = _entities.unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if links:
                self._linked += len(text)

        while m := _TAG.search(html, pos):
            if m.start() > pos:
                say(html[pos : m.start()])
            pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "br" or tag == "p" and not any(tags[i] == "p" for i in stack):
                    self._parts.append(" ")
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == tag:
                        close(depth)
                        break
                    if tag not in _BLOCK and tags[stack[depth]] in _BLOCK:
                        break  # an inline end tag doesn't close a block
                continue
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag in _CLOSES_P:
                self._close_open(stack, close, ("p",), ("article", "section", "div", "td", "th", "li", "body", "blockquote", "main", "button"))
            if tag in _CLOSED_BY:
                names, stop = _CLOSED_BY[tag]
                self._close_open(stack, close, tuple(names.split()), stop)
            if tag in _BLOCK:
                self._flush(holder())
            if tag in _VOID:
                continue
            self._open(tag, m[3] or "", stack)
            if tags[-1] == "a":
                links += 1
            if tag in _RAW:
                end = _ENDS[tag].search(html, pos)
                pos = end.start() if end else len(html)
                if not end:
                    break
        else:
            if pos < len(html):
                say(html[pos:])
        close(1)
        self._flush(0)

    def _close_open(self, stack: list[int], close, names: tuple, stop: tuple) -> None:  # noqa: ANN001
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in names:
                close(depth)
                return
            if tag in stop:
                return

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        parent = stack[-1]
        step, named = tag, 0
        if "=" in attributes:
            for m in _NAMES.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                words = {w.lower() for x in value.split() if not _LAYOUT.match(x) for w in _WORD.findall(x)}
                named = max(named, 2 * (not _COMMENTS.isdisjoint(words)), not _NOT_TEXT.isdisjoint(words))
                if m[1].lower() == "class":
                    step += "".join("." + x for x in sorted({_DIGITS.sub("0", c.lower()) for c in value.split()})[:3])
        if tag in ("html", "body", "main") or tag in _HEADINGS or tag == "article" and named == 1:
            named = 0
        hidden = tag in _OUT or named > 0 and tag not in _BLOCK  # in the middle of a block it goes at once
        if tag == "header" and any(self.tags[i] == "article" for i in stack):
            hidden = False  # an article's own head; only its headings are kept
        kept_head = tag not in _HEADINGS and self.tags[parent] == "header"
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(f"{self.paths[parent]}/{step}")
        self.out.append(self.out[parent] or hidden or kept_head)
        self.named.append(named)
        stack.append(len(self.tags) - 1)

    def _container(self, element: int) -> int:
        return self.parents[element] if self.tags[element] in _TEXTUAL else element

    def scores(self) -> dict[int, float]:
        """Running text of each container: all of what stands right in it, half of what stands a level deeper."""
        found: dict[int, float] = defaultdict(float)
        for element, text, linked in self.blocks:
            value = (len(text) - linked) * (1 - linked / len(text))
            first = self._container(element)
            if first > 0:
                found[first] += value
                above = self.parents[first]
                if above > 0 and self.tags[above] != "html":
                    found[above] += value / 2
        if any(self.named):
            weight = [1.0] * len(self.tags)
            for i in range(1, len(weight)):
                weight[i] = weight[self.parents[i]] * (PENALTY if self.named[i] else 1)
            found = {i: score * weight[i] for i, score in found.items()}
        return found

    def votes(self) -> list[tuple[str, float]]:
        """The paths of the best containers, with their shares of the page's score."""
        by: dict[str, float] = defaultdict(float)
        for element, score in self.scores().items():
            by[self.paths[element]] += score
        best = sorted(by.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        total = sum(score for _, score in best)
        return [(path, score / total) for path, score in best if score > 0] if total > 0 else []

    def text(self, winners: list[str], beside: list[str] = ()) -> str:
        """The blocks in all elements of winning paths, else in the page's own best; with those of paths beside them, and
        with headings and running text that stand right in their parent, or in an article above them."""
        paths = set(self.paths)
        for chosen in ({w for w in winners if w in paths}, {path for path, _ in self.votes()[:1]}):
            if chosen:
                parents = {path.rpartition("/")[0] for path in chosen}
                chosen = chosen | {path for path in beside if path in paths and path.rpartition("/")[0] in parents}
                got = self._inside(chosen)
                if got:
                    return "\n".join(got)
        return "\n".join(text for _, text, _ in self.blocks)

    def _inside(self, chosen: set[str]) -> list[str]:
        n = len(self.paths)
        inside, above = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parents[i]] or self.paths[i] in chosen
        held = {element for element, _, _ in self.blocks if inside[element]}
        for element in held:
            i = element
            while not (self.paths[i] in chosen and not inside[self.parents[i]]):
                i = self.parents[i]
            i, near = self.parents[i], True
            while i > 0 and self.tags[i] not in ("html", "body"):
                above[i] = above[i] or near or self.tags[i] in ("article", "main")
                i, near = self.parents[i], False
        headed = any(self._headed(element) for element in held)
        out = []
        for element, text, linked in self.blocks:
            container = self._container(element)
            right_above = above[container] and (2 * linked < len(text) or self.tags[element] in _HEADINGS)
            title = not headed and self.tags[element] == "h1" and self.tags[container] == "body"
            if inside[element] or bool(held) and (right_above or title):
                out.append(text)
        return out if held else []

    def _headed(self, element: int) -> bool:
        return self.tags[element] == "h1"


def host_of(url: str | None) -> str:
    """The host in lower case, without user, port and a leading www.; empty if there is none."""
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return (m[1] if m else "").lower().removeprefix("www.").rstrip(".")


def _host_column():  # noqa: ANN202
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.|\.+$", "")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, beside): for each host the paths that won, best first, and those that count beside a winner.

    Takes the columns url and html.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, s) for h, t in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for p, s in Page(t).votes()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["host", "path", "vote"])

    votes = pages.select(_host_column().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string, vote double")
    votes = votes.groupBy("host", "path").agg(F.sum(F.round("vote", 6).cast("decimal(28,6)")).alias("votes"))
    total = votes.groupBy("host").agg(F.sum("votes").alias("all"), F.max("votes").alias("most"))
    near = votes.join(total, "host").where((F.col("votes") >= BESIDE * F.col("all")) | (F.col("votes") == F.col("most")))
    won = (F.col("votes") >= SHARE * F.col("all")) | (F.col("votes") == F.col("most"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path", won.alias("won"))))
    paths = lambda own: F.transform(F.filter("ranked", own), lambda x: x["path"])
    return near.groupBy("host").agg(ranked.alias("ranked")).select("host", paths(lambda x: x["won"]).alias("paths"), paths(lambda x: ~x["won"]).alias("beside"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a row of pages: the id, the url, text (main text, empty if none) and n_chars.

    Null html has no text; a null url, or one without a host, counts to one host of its own; repeated rows give a row
    each and a vote each; ids may be null; an empty table gives no rows; other columns are not read. Pages are read
    whole. Votes are summed before they move; the hosts' paths go to every executor while they are under SENT_BYTES and
    are joined by shuffle, split by skew, otherwise.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    won = settled(host_paths(own))
    size = won.agg(F.sum(F.length("host") + F.length(F.array_join(F.concat("paths", "beside"), ",")) + 64)).first()[0] or 0
    rows = own.withColumn("host", _host_column()).join(F.broadcast(won) if size <= SENT_BYTES else won, "host", "left")
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("html", "paths", "beside")]
            texts = [Page(t).text(p or [], q or []) for t, p, q in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    found = rows.select("id", "url", "html", "paths", "beside").mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
