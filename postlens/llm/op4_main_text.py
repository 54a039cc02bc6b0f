"""Main text of web pages: page structure, and a suffix array per host.

A page is cut into blocks (its block-level tags) by one pass over its tags.  Blocks in
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and the like
are told by tag, role, or the words of their class and id; they are not text.  If the page
has an ``article`` (or else ``main``) element, only its blocks can be text, else all others.

What the markup does not name is found by repetition.  The token streams of a host's pages,
all blocks in page order, are concatenated and their suffixes sorted (prefix doubling up to
``LONG`` tokens), which puts equal substrings side by side.  A run of ``LONG`` tokens that
starts in enough distinct pages of the host is boilerplate: the tokens under such runs go
and the unique runs between them stay.  Enough is ``SHARE`` of the pages (and at least
``PAGES``) for pages without an article element, and ``ARTICLE_SHARE`` (``ARTICLE_PAGES``)
inside one, where a passage that some pages have in common is more likely to be text.
Boilerplate is never most of an article: if half of it is covered, the page is a copy and
keeps its text.

A host with much text is dealt by a hash of the page id over arrays of about
``ARRAY_BYTES`` of html, so no task holds a whole host, but its runs are judged on the whole
host.  A run that k of the host's pages have is on k / arrays pages of one array at least;
runs that reach this in some array are noted in a filter of ``SLOTS`` bits per host.  All
arrays give their page counts of the runs that pass it, the counts are summed by run, and
the sums go back to the arrays that hold the run.

Character references are decoded, white space in a block becomes one space, blocks are
joined by one line feed.  Null html gives an empty text.  Null or hostless urls give pages
that are judged alone.  Repeated rows each give a row and count as one page.
"""

from __future__ import annotations

import html as _html
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import Words, map_arrow, mix, stage, table
from postlens.llm.registry import register

LONG = 8               #: tokens of a substring that counts as long
PAGES, SHARE = 3, 0.05
ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.5
ARRAY_BYTES = 8_000_000
SLOTS = 1 << 17        #: bits of a large host's filter of runs

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>"'<]*+)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|[^<]++|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SKIP_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_SKIP = {"nav", "header", "footer", "aside", "form", "button", "select", "noscript", "svg", "template", "dialog",
         "menu", "object", "canvas", "head", "audio", "video", "map", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "thead",
          "tbody", "tfoot", "caption", "blockquote", "pre", "section", "article", "main", "figure", "figcaption", "hr",
          "address", "details", "summary", "fieldset", "body", "html", "center"} | _SKIP
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
          "menu", "menubar", "toolbar"}
#: words of a class or id that name what is not the article
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adbox", "adsense", "sponsor", "sponsored", "promo",
          "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
          "overlay", "newsletter", "subscribe", "subscription", "paywall", "sidebar", "widget", "widgets", "menu", "nav",
          "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "header", "masthead", "footer", "comment",
          "comments", "commentlist", "respond", "reply", "replies", "discussion", "disqus", "related", "recommended",
          "share", "sharing", "social", "login", "signup", "register", "search", "searchbox", "toolbar", "pagination",
          "pager", "copyright", "skiplink", "hidden"}
_OPEN, _MAIN, _OTHER = 0, 1, 2


def _named(tag: str, attrs: str) -> bool:
    """Whether a start tag opens something that is not text."""
    if tag in _SKIP:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if not _NAMES.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
        elif name == "role":
            if value in _ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; kind: article, other element, or neither."""
    if not html:
        return []
    out: list[list] = []           # [kind, text, inside article, inside main]
    stack: list[tuple[str, bool, bool, bool]] = []
    skip = article = main = False  # of the innermost open element
    buf: list[str] = []
    low = None

    def flush():
        if buf:
            text = " ".join(_html.unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append([skip, text, article, main])
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                buf.append(s)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            elif tag in ("td", "th"):
                buf.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    _, skip, article, main = stack[-1] if stack else ("", False, False, False)
                    break
            continue
        if tag in _SKIP_RAW:
            if not m[0].endswith("/>"):
                low = low or html.lower()
                end = low.find("</" + tag, at)
                if end < 0:
                    break
                at = html.find(">", end) + 1 or n
            continue
        if tag in _BLOCK:
            flush()
        elif tag in ("br", "td", "th"):
            buf.append(" ")
        if tag in _VOID or m[0].endswith("/>"):
            continue
        if tag in ("p", "li") and any(s[0] == tag for s in stack[-4:]):
            for i in range(len(stack) - 1, -1, -1):    # a new paragraph or item ends an open one
                if stack[i][0] == tag:
                    del stack[i:]
                    _, skip, article, main = stack[-1] if stack else ("", False, False, False)
                    break
                if stack[i][0] in _BLOCK:
                    break
        skip = skip or _named(tag, m[3])
        article = article or (tag == "article" and not skip)
        main = main or (tag == "main" and not skip)
        stack.append((tag, skip, article, main))
    flush()
    by = 2 if any(b[2] and not b[0] for b in out) else 3 if any(b[3] and not b[0] for b in out) else 0
    return [(_OTHER if b[0] or by and not b[by] else _MAIN if by else _OPEN, b[1]) for b in out]


def _streams(pages: DataFrame) -> DataFrame:
    """(id, part, host, tokens, kinds): a page's token codes (24 bits each), and the kind and
    number of tokens of each of its blocks (5 bytes each)."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch | None:
        at = [i for i, h in enumerate(b.column(2).to_pylist()) if h]
        found = [blocks(b.column(3)[i].as_py()) for i in at]
        at, found = [i for i, f in zip(at, found) if f], [f for f in found if f]
        if not at:
            return None
        w = Words([t for f in found for _, t in f])
        size = w.count.astype("<i4")
        kind = np.array([k for f in found for k, _ in f], np.uint8)
        entry = np.concatenate([kind[:, None], size[:, None].view(np.uint8).reshape(-1, 4)], axis=1)
        code = (w.hash >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        block = np.cumsum([0] + [len(f) for f in found])
        cut = np.concatenate([[0], np.cumsum(w.count)])[block]
        return pa.RecordBatch.from_arrays(
            [b.column(i).take(pa.array(at, pa.int64())) for i in range(3)]
            + [pa.array([code[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
               pa.array([entry[i:j].tobytes() for i, j in pairwise(block)], pa.binary())],
            ["id", "part", "host", "tokens", "kinds"])
    return map_arrow(pages, fn, "id long, part long, host string, tokens binary, kinds binary")


def repeat_counts(streams: list[np.ndarray], long: int) -> np.ndarray:
    """For every token of the concatenated streams, the number of streams in which the run
    of ``long`` tokens that starts there occurs; 0 where the stream ends before."""
    size = np.array([len(s) for s in streams], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(streams)), size)
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) + 1
    left = np.repeat(np.cumsum(size), size) - np.arange(len(page))     # tokens to the page's end
    done = 1
    while done < long:                                                 # sort by up to twice as many tokens
        step = min(done, long - done)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        after[left <= step] = 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        done += step
    order = np.lexsort((page, rank))                                   # the suffix array
    r, p = rank[order], page[order]
    fresh = np.concatenate([[True], r[1:] != r[:-1]])
    other = fresh | np.concatenate([[True], p[1:] != p[:-1]])
    node = np.cumsum(fresh) - 1
    pages = np.bincount(node, weights=other).astype(np.int64)[node]
    out = np.zeros(len(page), np.int64)
    out[order] = pages
    out[left < long] = 0
    return out


def _under(starts: np.ndarray, long: int) -> np.ndarray:
    cover = np.zeros(len(starts) + long, np.int64)
    at = np.flatnonzero(starts)
    cover[at] += 1
    cover[at + long] -= 1
    return np.cumsum(cover[:len(starts)]) > 0


def _least_pages(n: int) -> tuple[float, float]:
    """Pages of n that make a run boilerplate: outside and inside an article."""
    return max(PAGES, SHARE * n), max(ARTICLE_PAGES, ARTICLE_SHARE * n)


def _judge(count: np.ndarray, kinds: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Per stream, the tokens that are boilerplate; count: the pages of the host's n that
    have the run that starts at each token; kinds: of each token."""
    kind = np.concatenate(kinds) if kinds else np.zeros(0, np.uint8)
    some, most = _least_pages(n)
    gone = np.where(kind == _MAIN, _under(count >= most, LONG), _under(count >= some, LONG) & (kind == _OPEN))
    out = []
    for g, k in zip(np.split(gone, np.cumsum([len(k) for k in kinds])[:-1]), kinds):
        main = k == _MAIN
        if main.any() and 2 * (g & main).sum() >= main.sum():
            g = g & ~main
        out.append(g)
    return out


def _run_digests(tokens: np.ndarray) -> np.ndarray:
    """A hash of the run of LONG tokens that starts at each token."""
    t = np.concatenate([tokens.astype(np.uint64), np.zeros(LONG, np.uint64)])
    h = np.zeros(len(tokens), np.uint64)
    for i in range(LONG):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + t[i:i + len(tokens)])
    return h.view(np.int64)


_GONE = "id long, part long, gone binary"
_ARRAY = f"{_GONE}, host string, deal long, pages long, plain boolean, ids binary, parts binary, sizes binary, " \
         "tokens binary, kinds binary, counts binary"


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_fields = [pa.field(c.split()[0], _TYPES[c.split()[1]]) for c in _ARRAY.split(", ")]


def _gone_rows(ids: np.ndarray, parts: np.ndarray, gone: list[np.ndarray]) -> list[pa.Array]:
    at = [i for i, g in enumerate(gone) if g.any()]
    return [pa.array(ids[at], pa.int64()), pa.array(parts[at], pa.int64()),
            pa.array([np.packbits(gone[i]).tobytes() for i in at], pa.binary())]


def _ints(column: pa.Array, i: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(column[i].as_py(), kind)


def _large_hosts(arrays: DataFrame) -> DataFrame:
    """The rows of _GONE of the arrays of hosts that have several."""
    hosts = stage(arrays.groupBy("host").agg(F.sum("pages").alias("n"), F.count("*").alias("arrays"),
                                             F.max("plain").alias("plain")), "host_pages")

    def slots(b: pa.RecordBatch) -> pa.RecordBatch:
        host, slot = [], []
        for i in range(b.num_rows):
            some, most = _least_pages(b.column(3)[i].as_py())
            least = (some if b.column(5)[i].as_py() else most) / b.column(4)[i].as_py()
            count = _ints(b.column(2), i, "<i4")
            found = _run_digests(_ints(b.column(1), i, "<i4"))[(count > 0) & (count >= least)]
            found = np.unique(found % SLOTS)
            slot.append(found)
            host += [b.column(0)[i].as_py()] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(np.concatenate(slot), pa.int32())], ["host", "slot"])
    noted = arrays.select("host", "tokens", "counts").join(hosts, "host").select("host", "tokens", "counts", "n", "arrays", "plain")
    filters = stage(map_arrow(noted, slots, "host string, slot int").groupBy("host")
                    .agg(F.collect_set("slot").alias("slots")), "filters")              # SLOTS entries at most

    def runs(b: pa.RecordBatch) -> pa.RecordBatch:
        host, deal, run, n = [], [], [], []
        for i in range(b.num_rows):
            passes = np.zeros(SLOTS, bool)
            passes[b.column(4)[i].values.to_numpy()] = True
            count = _ints(b.column(3), i, "<i4")
            digest = _run_digests(_ints(b.column(2), i, "<i4"))
            at = np.flatnonzero((count > 0) & passes[digest % SLOTS])
            found, first = np.unique(digest[at], return_index=True)
            run.append(found)
            n.append(count[at[first]])
            host += [b.column(0)[i].as_py()] * len(found)
            deal += [b.column(1)[i].as_py()] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(deal, pa.int64()), pa.array(np.concatenate(run), pa.int64()),
                                           pa.array(np.concatenate(n), pa.int64())], ["host", "deal", "run", "n"])
    found = stage(map_arrow(arrays.select("host", "deal", "tokens", "counts").join(filters, "host"), runs,
                            "host string, deal long, run long, n long"), "runs")
    total = (found.groupBy("host", "run").agg(F.sum("n").alias("total")).join(hosts, "host")
             .where(F.col("total") >= F.when(F.col("plain"), F.greatest(F.lit(PAGES), SHARE * F.col("n")))
                    .otherwise(F.greatest(F.lit(ARTICLE_PAGES), ARTICLE_SHARE * F.col("n")))).select("host", "run", "total"))
    marks = stage(found.join(total, ["host", "run"]).groupBy("host", "deal").agg(
        F.collect_list(F.struct("run", "total")).alias("marks")), "marks")              # runs of one array

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i in range(b.num_rows):
            marks = b.column(6)[i].values
            run, total = marks.field("run").to_numpy(), marks.field("total").to_numpy()
            order = np.argsort(run)
            run, total = run[order], total[order]
            digest = _run_digests(_ints(b.column(3), i, "<i4"))
            place = np.minimum(np.searchsorted(run, digest), len(run) - 1)
            count = np.where((run[place] == digest) & (_ints(b.column(5), i, "<i4") > 0), total[place], 0)
            kinds = np.split(_ints(b.column(4), i, "u1"), np.cumsum(_ints(b.column(2), i))[:-1])
            out.append(pa.RecordBatch.from_arrays(_gone_rows(_ints(b.column(0), i), _ints(b.column(1), i), _judge(
                count, kinds, b.column(7)[i].as_py())), ["id", "part", "gone"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(x.num_rows for x in out) else None
    rows = (arrays.select("host", "deal", "ids", "parts", "sizes", "tokens", "kinds", "counts").join(marks, ["host", "deal"])
            .join(hosts.select("host", "n"), "host")
            .select("ids", "parts", "sizes", "tokens", "kinds", "counts", "marks", "n"))
    return map_arrow(rows, judge, _GONE)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(id, part, gone): a bit per token of each page that has boilerplate in its text."""
    hosts = stage(pages.where("host <> ''").groupBy("host").agg(
        F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0))) / ARRAY_BYTES).alias("arrays")), "hosts")
    rows = (_streams(pages).join(hosts, "host")
            .select("host", "arrays", F.pmod(F.xxhash64("id"), "arrays").alias("deal"), "id", "part", "tokens", "kinds"))

    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("part", "ascending")])
        ids, parts = t["id"].to_pylist(), t["part"].to_pylist()
        t = t.take([i for i in range(len(ids)) if not i or (ids[i], parts[i]) != (ids[i - 1], parts[i - 1])])
        streams, kinds = [], []
        for code, entry in zip(t["tokens"], t["kinds"]):
            raw = np.frombuffer(code.as_py(), np.uint8).reshape(-1, 3).astype(np.int64)
            streams.append(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16)
            block = np.frombuffer(entry.as_py(), np.uint8).reshape(-1, 5)
            kinds.append(np.repeat(block[:, 0], np.ascontiguousarray(block[:, 1:]).view("<i4")[:, 0]))
        count = repeat_counts(streams, LONG)
        if t["arrays"][0].as_py() == 1:
            gone = _judge(count, kinds, len(streams))
            at = pa.array([i for i, g in enumerate(gone) if g.any()], pa.int64())
            cols = [t["id"].take(at), t["part"].take(at), pa.array([np.packbits(gone[i.as_py()]).tobytes() for i in at], pa.binary())]
            return pa.table(cols + [pa.nulls(len(at), f.type) for f in _fields[3:]], pa.schema(_fields))
        kind, missing = np.concatenate(kinds), np.iinfo(np.int64).min
        number = lambda c: np.array([missing if x is None else x for x in t[c].to_pylist()], "<i8").tobytes()
        row = [None, None, None, t["host"][0].as_py(), t["deal"][0].as_py(), len(streams), bool((kind == _OPEN).any()),
               number("id"), number("part"), np.array([len(s) for s in streams], "<i8").tobytes(),
               np.concatenate(streams).astype("<i4").tobytes(), kind.tobytes(), count.astype("<i4").tobytes()]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _fields)], pa.schema(_fields))
    judged = stage(rows.groupBy("host", "deal").applyInArrow(fn, _ARRAY), "arrays")
    gone, arrays = judged.where("host is null").select("id", "part", "gone"), judged.where("host is not null")
    return gone if arrays.isEmpty() else gone.unionByName(_large_hosts(arrays))


def page_text(found: list[tuple[int, str]], gone: bytes | None) -> str:
    """The text of a page's blocks, less the tokens marked in gone."""
    want = _MAIN if any(k == _MAIN for k, _ in found) else _OPEN
    if not gone:
        return "\n".join(t for k, t in found if k == want)
    bits = np.unpackbits(np.frombuffer(gone, np.uint8))
    out, at = [], 0
    for kind, text in found:
        raw = text.encode("utf-8", "surrogatepass").split()
        stay = [w for w, g in zip(raw, bits[at:at + len(raw)]) if not g]
        at += len(raw)
        if kind == want and stay:
            out.append(text if len(stay) == len(raw) else b" ".join(stay).decode("utf-8", "surrogatepass"))
    return "\n".join(out)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.pmod(F.xxhash64(F.col(html_col)), F.lit(1 << 16)).alias("part"),
                       host.alias("host"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    # written first, so that its size is known: if it is small the pages needn't be shuffled
    gone = stage(boilerplate(src.select("id", "part", "host", "html")), "boilerplate")
    rows = src.drop("host").join(gone, ["id", "part"], "left").select("id", "url", "html", "gone")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [page_text(blocks(h.as_py()), g.as_py()) for h, g in zip(b.column(2), b.column(3))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                                           pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])
    out = map_arrow(rows, fn, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col}) if (id_col, url_col) != ("id", "url") else out


@register("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the article's text."""
    return main_text(table(spark, sf_dir, "pages"))
