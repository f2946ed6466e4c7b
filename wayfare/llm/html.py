"""Main text of web pages by equivalence classes of template tokens.

Tokens (tags with their class, and whole text runs) of the pages of a host that have the same occurrence vector, the same
count on every page, form an equivalence class: the template's own tokens occur together, content does not. Vectors are
compared by a sum of page hashes times counts, so classes are found by one pre-aggregated shuffle of (host, token).
Classes of enough tokens and pages whose tokens keep one order are valid; nested by where they lie between the tokens of
the class around them they make the host's template. What lies between template tokens are its slots; a slot's place in
the template (navigation, advert, article ...) decides whether its text is the article's. Layouts of a few pages have
classes too, if tags are among their tokens (``MINORITY``).

Blocks of template text are dropped everywhere, inside articles only those of a class with tags (content may recur, but not
as often as a tag on each page), and unless they make up half of an article: then the article itself is repeated on other
pages and stays whole. An article element is a hint that counts its text ``HINT`` times:
where articles without the page's h1 hold less than that of the text around them, they are teasers and the slots around
them are the main text.

Defined cases: a null page is empty, its text too; pages of hosts with fewer than ``MIN_PAGES`` pages, or without a host,
have no template and go by the open elements alone; repeated pages count as pages of their own; broken and cut-off markup
is read as far as it goes; a page without an article element gives the slots of the element with most text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batches, materialize

MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.5, 3
#: Least share of a host's pages for a layout of its own; it bounds a host's template. How often an article's text counts.
MINORITY, HINT = 0.05, 2

#: What HTML elements and the usual names of page parts mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PARTS = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select option textarea input label head title menu dialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices "
    "popup modal newsletter subscribe promo promotion sponsor sponsored share sharing social related recommended comment comments commentlist reply replies respond disqus "
    "footer header masthead pagination pager widget toolbar login signup search skip copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
ARTICLE = frozenset("article main".split())
WHOLE = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Quotes count after an equals sign only; nothing is tried twice, so markup that never ends costs one look.
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, signature, text): kinds are open, close and text; text of scripts and the like is left out."""
    at, n = 0, len(page)
    last = page.rfind(">") + 1
    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        end = m.start() if m else n
        if end > at:
            run = page[at:end]
            # a tag that is cut off at the end of the page is markup
            if not m and (cut := re.search(r"<[/!a-zA-Z][^>]*$", run)):
                run = run[: cut.start()]
            if run.strip():
                yield "text", "", "", run
        if not m or m.group().startswith("<!--") and not m.group().endswith("-->"):
            return
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            yield "close", name, f"</{name}", ""
            continue
        raw = m.group(3)
        named = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        words = " ".join(x for k in ("class", "id", "role") if (x := named.get(k)))
        if "hidden" in named or "display:none" in named.get("style", "").replace(" ", ""):
            words = f"{words} hidden".lstrip()
        yield "open", name, f"<{name} {words}" if words else f"<{name}", words
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            yield "close", name, f"</{name}", ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def flat(run: str) -> str:
    return " ".join(entities.unescape(run).split())


def _mark(name: str, words: str) -> bool:
    """Whether an element is a part of the page other than its article.

    Classes of the whole page and of headings, whose ids repeat their text, say nothing of it, nor do ``has-sidebar`` and the like.
    """
    if name in PARTS or name == "header":
        return True
    if not words or name in WHOLE or name in HEADINGS:
        return False
    each = [w for w in words.split() if not w.startswith(("has-", "with-", "no-"))]
    found = set(re.split(r"[^a-z0-9]+", " ".join(each)))
    return bool(found & NAMES or found & ROLES or "hidden" in each)


def text_token(run: str) -> str:
    """The token of a text run: short runs stand for themselves, others for their hash."""
    import xxhash

    t = flat(run)
    return "#" + (t if len(t) <= 16 else xxhash.xxh3_64_hexdigest(t.encode("utf-8", "surrogatepass")))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, total, vector, place): the occurrences of each token, pre-aggregated by batch."""
    import xxhash

    for b in it:
        seen: dict[tuple[str, str], list] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not host:
                continue
            r = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 24
            here: dict[str, list] = {"": [1, 0]}
            k = 0
            for kind, _, sign, run in tokens(page):
                k += 1
                x = here.setdefault(text_token(run) if kind == "text" else sign, [0, 0])
                x[0] += 1
                x[1] += k
            for t, (c, place) in here.items():
                x = seen.setdefault((host, t), [0, 0, 0, 0.0])
                x[0] += 1
                x[1] += c
                x[2] += r * c
                x[3] += place / c / (k + 1)
        if seen:
            v = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in seen]), pa.array([t for _, t in seen]), pa.array([x[0] for x in v], pa.int64()), pa.array([x[1] for x in v], pa.int64()), pa.array([float(x[2] % (1 << 52)) for x in v], pa.float64()), pa.array([x[3] for x in v], pa.float64())],
                ["host", "token", "pages", "total", "vector", "place"],
            )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) for ``pages(host, html)``: classes of (pages, total, tokens in order), the widest first.

    The vector sums stay below 2**52 for each batch and are added as decimals, so equal vectors have equal sums.
    """
    c = pages.select("host", "html").mapInArrow(_counted, "host string, token string, pages long, total long, vector double, place double")
    c = c.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.sum("place").alias("place"))
    sizes = c.where("token = ''").select(F.col("host").alias("_host"), F.col("pages").alias("n")).where(f"n >= {MIN_PAGES}")
    c = c.where(f"token <> '' AND pages >= {MIN_PAGES}").join(sizes, F.col("host") == F.col("_host")).where(f"pages >= n * {MINORITY}")
    classes = c.groupBy("host", "n", "pages", "total", (F.col("vector") % F.lit(1 << 52).cast("decimal(38,0)")).alias("vector")).agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("t"))
    # valid: enough tokens, or the frame of every page; a layout of fewer pages has tags of its own
    classes = classes.where(f"pages = n OR size(t) >= {MIN_TOKENS} AND (pages >= n * {MIN_SHARE} OR exists(t, x -> x.token LIKE '<%' AND x.token NOT LIKE '</%'))")
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("fewer"), "total", F.col("t.token").alias("tokens")))).alias("template"))


def extract(page: str, template: list[tuple[int, list[str]]] | None = None) -> list[str]:
    """The blocks of the article. template: (total less pages, tokens) of its classes; classes that occur once a page frame slots."""
    frame: set[str] = set()
    fixed: set[str] = set()
    bound: set[str] = set()  # texts that occur as often as some tag on every page; others may be content that recurs
    for more, names in template or ():
        if more == 0:
            frame |= {t for t in names if t[0] == "<"}
        fixed |= {t for t in names if t[0] == "#"}
        if any(t[0] == "<" and t[1] != "/" for t in names):
            bound |= {t for t in names if t[0] == "#"}
    # a token frames slots only where it occurs once here as well
    once: dict[str, int] = {}
    stream = list(tokens(page))
    for kind, _, sign, _ in stream:
        if kind != "text":
            once[sign] = once.get(sign, 0) + 1
    frame = {t for t in frame if once.get(t) == 1}

    stack: list[tuple[str, bool, bool, int]] = []  # name, other part, article, number of the element
    slot = opened = 0
    blocks: list[tuple[str, int, tuple, int, bool, bool]] = []  # text, its article (0: none, -1: main), path, slot, h1, template
    buffer: list[str] = []
    own: list[bool] = []

    def flush() -> None:
        """Ends a block; its elements and slot matter where no article is marked."""
        if buffer:
            t = flat("".join(buffer))
            same = bool(own) and all(own)
            buffer.clear()
            own.clear()
            if t:
                path = tuple(k for n, _, _, k in stack if n not in INLINE and n not in ("p", "li", "ul", "ol") and n not in HEADINGS)
                unit = next((x[3] for x in stack if x[0] == "article"), -1 if any(x[2] for x in stack) else 0)
                blocks.append((t, unit, path, slot, any(x[0] == "h1" for x in stack), same))

    for kind, name, sign, run in stream:
        if kind == "text":
            other = any(x[1] for x in stack)
            inside = any(x[2] for x in stack)
            heading = inside and any(x[0] in HEADINGS for x in stack) and all(x[0] == "header" for x in stack if x[1])
            if other and not heading:
                continue
            same = bool(fixed) and bool(run.strip()) and text_token(run) in (bound if inside else fixed)
            if not inside and same:
                continue  # the template's own text
            if run.strip():
                own.append(same)  # in an article a whole block is the template's or none of it
            buffer.append(run)
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            buffer.append(" ") if buffer else None
        if kind == "open":
            if sign in frame:
                slot += 1
            if name not in VOID:
                if name in ("p", "li") or name in HEADINGS:
                    # an open paragraph ends where the next block begins
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name or name == "p" and stack[k][0] in HEADINGS:
                            if name != "li":
                                del stack[k:]
                            break
                        if stack[k][0] not in INLINE:
                            break
                opened += 1
                stack.append((name, _mark(name, run), name in ARTICLE or "main" in run.split() and name in ("div", "section"), opened))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if sign in frame:
                slot += 1
    flush()
    for unit in {b[1] for b in blocks if b[1] and b[5]}:
        # mostly template text: the article itself is repeated
        of = [b for b in blocks if b[1] == unit]
        if 2 * sum(len(b[0]) for b in of if b[5]) < sum(len(b[0]) for b in of):
            blocks = [b for b in blocks if b[1] != unit or not b[5]]
    cards = sum(len(b[0]) for b in blocks if b[1] > 0)
    around = [b for b in blocks if b[1] == -1] or _most([b for b in blocks if b[1] == 0])
    teasers = not any(b[1] > 0 and b[4] for b in blocks) and sum(len(b[0]) for b in around) > HINT * cards
    if teasers and cards:
        return [b[0] for b in around]
    if any(b[1] for b in blocks):
        return [b[0] for b in blocks if b[1]]
    return [b[0] for b in around]


def _most(blocks: list[tuple]) -> list[tuple]:
    """The slots under the element with most text."""
    size: dict[tuple, int] = {}
    for b in blocks:
        size[(b[2], b[3])] = size.get((b[2], b[3]), 0) + len(b[0])
    if not size:
        return []
    best = max(size, key=lambda k: (size[k], k))
    return [b for b in blocks if b[2][: len(best[0])] == best[0] or (b[2], b[3]) == best]


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages."""

    def hosts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string()), b.column(2)], ["id", "url", "host", "html"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                out.append("\n\n".join(extract(page, [(c["total"] + c["fewer"], c["tokens"]) for c in t or ()])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    batches(pages.sparkSession)
    kind = pages.schema[id_column].dataType.simpleString()
    p = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("html"))
    p = p.mapInArrow(hosts, f"id {kind}, url string, host string, html string")
    # written first, so that its size is known: it is broadcast only below Spark's threshold, else joined with skew handling
    t = materialize(templates(p)).withColumnRenamed("host", "_host")
    return p.join(t, F.col("host") == F.col("_host"), "left").select("id", "url", "html", "template").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
