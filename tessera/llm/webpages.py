"""Main text of web pages by consensus host paths: containers are scored, paths voted on by host, and pages read again along the winning path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut, small_batches, with_group

# Elements by what they do to text.
RAW = frozenset("script style noscript template svg textarea title iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section td".split())
ASIDE = frozenset("aside button dialog footer head menu nav select".split())
#: Left out too, unless a heading or the article lies in them.
MAYBE = frozenset("form header".split())
#: An opening tag of the key closes an open element of its values, if nothing else lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
# Words of class names, ids and roles.
BAD = frozenset("ad ads adsbygoogle adslot adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs consent cookie cookies copyright cta foot footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
WORSE = frozenset("comment commentlist comments disqus popular recommended related replies reply respond".split())
GOOD = frozenset("article blog content entry main page post story text".split())
OWN = frozenset("article entry post story".split())

#: A tag; without a closing quote or bracket it ends at the next bracket, so that no text is read twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^>]*+>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAIL = 8
#: A container keeps this many of a block's characters; each level above keeps half of what the one below does.
LEVELS = 4


class Page:
    """Elements and text blocks of a page, in one pass over its tags; it takes any text and never fails."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.bad, self.holds = [""], [-1], [""], [0], [False]
        self.blocks: list[tuple[int, list[str], int]] = []  # element, runs of text, characters inside links
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        names = found.get("class", "")
        bad = 2 if tag in ASIDE else 1 if tag in MAYBE else 0
        if found and not bad and tag not in ("body", "html", "main"):
            words = {w.lower() for n in " ".join(found.values()).split() if not n.lower().startswith(("has-", "with-", "no-")) for w in WORD.findall(n)}
            bad = 2 if words & WORSE else 1 if words & BAD and tag != "article" else 0
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.bad.append(bad)
        self.holds.append(False)
        at = len(self.tag) - 1
        if tag in ("main", "h1") or (tag == "article" and not bad):  # what these lie in is no boilerplate by its name alone
            up = parent
            while up > 0 and not self.holds[up]:
                self.holds[up] = True
                up = self.parent[up]
        return at

    def _parse(self, html: str) -> None:
        stack, opened = [0], {}
        runs: list[str] = []
        linked, owner, links = 0, 0, 0

        def flush() -> None:
            nonlocal runs, linked
            if runs:
                self.blocks.append((owner, runs, linked))
            runs, linked = [], 0

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                name = self.tag[stack.pop()]
                opened[name] -= 1
                links -= name == "a"

        at, search = 0, TAG.search
        while True:
            m = search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                if not runs:
                    owner = stack[-1]
                runs.append(text)
                if links:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            ends = m[1] if m[2] else m[4]
            if ends:
                if name in BLOCK:
                    flush()
                if opened.get(name):
                    to = len(stack) - 1
                    while self.tag[stack[to]] != name:
                        to -= 1
                    close(to)
                elif name == "br":
                    runs.append(" ")
                continue
            if name in BLOCK:
                flush()
                if opened.get("p") and self._open_p(stack):
                    close(self._open_p(stack))
                top = self.tag[stack[-1]]
                if top in CLOSES.get(name, ()):
                    close(len(stack) - 1)
                    if name == "tr" and self.tag[stack[-1]] == "tr":
                        close(len(stack) - 1)
            elif name == "br":
                runs.append(" ")
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                if end or name in ("script", "style"):
                    at = end.end() if end else len(html)
                continue
            if name in VOID or (m[3] or m[6] or "").endswith("/"):
                if name in VOID or name not in BLOCK:
                    continue
            if name == "a" and links:  # links do not nest
                to = len(stack) - 1
                while self.tag[stack[to]] != "a":
                    to -= 1
                close(to)
            stack.append(self._open(name, m[3] or m[6] or "", stack[-1]))
            opened[name] = opened.get(name, 0) + 1
            links += name == "a"
        flush()

    def _open_p(self, stack: list[int]) -> int:
        """Depth of an open paragraph that only inline elements lie in; 0 without one."""
        to = len(stack) - 1
        while to > 0 and self.tag[stack[to]] not in BLOCK:
            to -= 1
        return to if to > 0 and self.tag[stack[to]] == "p" else 0

    def boilerplate(self) -> list[bool]:
        """For each element whether it is, or lies in, a menu, header, footer, sidebar, notice, advert, form or comments."""
        out, inside = [False], [False]
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            inside.append(inside[up] or self.tag[i] in ("article", "main") or (self.tag[i] != "body" and any(w.lower() in OWN for w in WORD.findall(self.names[i]))))
            own = self.bad[i] == 2 or (self.bad[i] == 1 and not self.holds[i])
            if self.bad[i] == 1 and self.tag[i] == "header":
                own = not (inside[i] and self.holds[i])
            out.append(out[up] or own)
        return out

    def paths(self) -> list[str]:
        """Each element's generalised tag-class path: the last TAIL steps and a checksum of all; digits and ids do not count."""
        out, sums = [""], [0]
        for i in range(1, len(self.tag)):
            names = sorted({re.sub(r"[\d_-]*\d[\w-]*", "", n.lower()) for n in self.names[i].split()} - {""})
            step = ".".join([self.tag[i], *names])[:80]
            up = self.parent[i]
            tail = out[up].rpartition("#")[0].split(">")[-TAIL + 1 :] if out[up] else []
            sums.append(crc32(step.encode("utf-8", "replace"), sums[up]))
            out.append(">".join([*tail, step]) + f"#{sums[i]:08x}")
        return out

    def scores(self) -> dict[int, int]:
        """Containers with the characters of text outside links that they hold, halved with each container in between, times a factor of their kind."""
        bad, found = self.boilerplate(), {}
        for element, runs, linked in self.blocks:
            if bad[element]:
                continue
            size = len(" ".join("".join(runs).split())) - linked
            at, weight = element, 1 << LEVELS
            while at >= 0 and weight and size > 0:
                if self.tag[at] in CONTAINER or at == 0:
                    found[at] = found.get(at, 0) + size * weight
                    weight >>= 1
                at = self.parent[at]
        return {i: n * self._factor(i) for i, n in found.items()}

    def _factor(self, i: int) -> int:
        if i == 0:  # the page itself, for pages without a container
            return 1
        if self.tag[i] == "article":
            return 6
        if self.tag[i] == "main":
            return 4
        return 3 if {w.lower() for w in WORD.findall(self.names[i])} & GOOD and self.tag[i] != "body" else 2

    def votes(self) -> dict[str, int]:
        """Each container path's share of the best score, in thousandths: the page's vote."""
        scores = self.scores()
        top = max(scores.values(), default=0)
        paths = self.paths() if top else []
        best: dict[str, int] = {}
        for i, n in scores.items():
            best[paths[i]] = max(best.get(paths[i], 0), 1000 * n // top)
        return {p: n for p, n in best.items() if p and n >= 100}

    def text(self, path: str | None) -> str:
        """The blocks inside the containers of the path, one a line; inside the page's own best container where it has none of that path."""
        scores = self.scores()
        if not scores:
            return ""
        paths = self.paths() if path else []
        top = max(scores, key=lambda i: (scores[i], -i))
        roots = {i for i in scores if path and paths[i] == path}
        if 10 * sum(scores[i] for i in roots) < scores[top]:
            roots = {top}
        bad, inside, lines = self.boilerplate(), [0 in roots], []
        for i in range(1, len(self.tag)):
            inside.append(i in roots or inside[self.parent[i]])
        for element, runs, _ in self.blocks:
            if inside[element] and not bad[element]:
                line = " ".join(unescape("".join(runs)).split())
                if line:
                    lines.append(line)
        return "\n".join(lines)


def host_of(url: Column) -> Column:
    """The host of a url in small letters; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^:/?#\s]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, n_pages): for each host of pages(host, html) the path with the most votes, the first of equal ones; empty without votes.

    Each batch adds its own votes first, and Spark adds those of a task before the shuffle, so that a host with a third of all pages
    sends a few rows a task.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for host, html in zip(k.column(batch, "host").to_pylist(), k.column(batch, "html").to_pylist(), strict=True):
                total.setdefault((host, ""), [0, 0])[1] += 1
                for path, n in Page(html or "").votes().items():
                    total.setdefault((host, path), [0, 0])[0] += n
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), *(pa.array([x[i] for x in total.values()], pa.int64()) for i in (0, 1))], names=["host", "path", "votes", "n_pages"])

    votes = pages.where("host is not null").mapInArrow(vote, "host string, path string, votes long, n_pages long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n_pages").alias("n_pages"))
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("_b"), F.sum("n_pages").alias("n_pages")).select("host", F.col("_b.path").alias("path"), "n_pages")


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row inside `row` (no name can clash), with host, path, text and n_chars: the main text of its page.

    A page's containers are scored by the text they hold outside links; all pages of a host vote for their containers' tag-class
    paths, and each page is read again along its host's winning path. Pages without a host, or without a container of that path, are
    read by their own best container. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are
    left out, by element or by the words of class, id and role. Blocks (paragraphs, headings, list items, cells) are lines; references
    are decoded, runs of white space become one space. A null page is empty and an empty page gives an empty text; whole pages are
    read; an empty table gives an empty result; repeated rows each give a text and a vote.

    The winning paths of hosts with many pages are broadcast (they are few, see with_group); the others meet their pages in a join.
    """
    small_batches(df.sparkSession, 256)
    pages = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    winners = cut(host_paths(pages.select("host", "html")))
    total = winners.agg(F.sum("n_pages")).first()[0] or 0
    known = with_group(pages.where("host is not null"), winners, "host", "n_pages", total).select("row", "host", "html", "path")
    alone = pages.where("host is null").select("row", "host", "html", F.lit(None).cast("string").alias("path"))

    @F.arrow_udf("string")
    def read_again(html: pa.Array, path: pa.Array) -> pa.Array:
        out = pa.array([Page(h or "").text(p) for h, p in zip(html.to_pylist(), path.to_pylist(), strict=True)], pa.string())
        k.rest()
        return out

    read = known.unionByName(alone).select("row", "host", "path", read_again("html", "path").alias("text"))
    return read.select("row", "host", "path", "text", F.char_length("text").cast("long").alias("n_chars"))
