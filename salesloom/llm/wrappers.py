"""Operator 7: HTML extraction by wrappers inferred per host.

A page is read as a stream of block tags and text slots. Pages of one host come
from a few templates, so their streams are aligned with each other step by step:
what follows itself becomes a repeated group, what only some pages have becomes
an optional group, and differing text becomes a slot. The result is a
union-free expression, the host's wrapper. Its slots are labelled once per host
from the tags around them (menus, notices, forms, comments and the like are
furniture); a page's text is
then what stands in the other slots, of a page with text in article or main
elements in those.

A text that stands at the same path on every page of the host which has that path
is template text and not part of an article, given `ALIKE` different pages with the
path. This is counted by path, for the streams of the alignment hold paths only.

Streams are folded and made distinct before anything is grouped, so a host's
group holds templates and not pages. They are numbered per host and aligned in
groups of at most `TOGETHER`, in rounds until a host has one wrapper. Page texts
meet their wrapper in a join dealt by `SALTS`, with the slots compressed.

Defined results: a null or empty html has an empty text; a page without any
article slot has an empty text; unclosed tags, comments and scripts end where
their parent or the page ends; a null URL or one without a host belongs to the
empty host; very long pages are read whole; repeated rows are extracted each; an
empty table gives an empty table; extra columns are not used.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.session import stored

SALTS = 16
TOGETHER = 16  # wrappers that one task aligns as a group
ALIKE = 3  # different pages; fewer may be copies of an article with small changes

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select".split())
BLOCK = frozenset(
    """html head body address article aside blockquote center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul caption""".split()
)
FURNITURE = frozenset("head nav header footer aside form fieldset menu dialog button label".split()) | RAW
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
# Words in a class or an id that mark an element as furniture.
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies
    consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidenav
    side nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar
    comment comments disqus reply replies respond share sharing social related recommended widget widgets""".split()
)
ENDS_ITSELF = {  # a start tag that ends an open element of the same kind
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
MAIN = ("article", "main")  # elements that hold an article
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _marked(name: str, attributes: str) -> bool:
    """Whether a class, id or role makes an element furniture."""
    if name in ("html", "body", *MAIN):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() in ("class", "id") and FURNITURE_WORDS & set(re.split(r"[^a-z]+", value)):
            return True
        if key.lower() == "role" and FURNITURE_ROLES & set(value.split()):
            return True
        if key.lower() == "aria-hidden" and value == "true":
            return True
    return False


def page_slots(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The stream of block tags and slots (# and path) of a page, and its slots as (path, text).

    A path names the open block elements from the root; furniture is marked `!`.
    """
    stream: list[str] = []
    slots: list[tuple[str, str]] = []
    open_: list[tuple[str, str]] = []  # (element, label in the path); inline elements have no label
    text: list[str] = []
    path = ""

    def flush() -> None:
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            slots.append((path, said))
            stream.append(f"#{path}")

    def repath() -> str:
        return "/".join(label for _, label in open_ if label)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if depth is None:
                continue
            if any(label for _, label in open_[depth:]):
                flush()
                stream.extend(f"/{e}" for e, label in reversed(open_[depth:]) if label and e != "p")
            del open_[depth:]
            path = repath()
            continue
        marked = _marked(name, attributes or "")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            text.append(" ")
        if name not in BLOCK and not marked and name not in FURNITURE:
            if name not in VOID and not attributes.rstrip().endswith("/"):
                open_.append((name, ""))
            continue
        flush()
        ended = (*ENDS_ITSELF.get(name, ()), "p")
        for k in range(len(open_) - 1, -1, -1):  # only within the nearest element that may hold it
            if open_[k][0] in ("ul", "ol", "dl", "table", "div", "section", "aside", "blockquote", *MAIN):
                break
            if open_[k][0] in ended:
                del open_[k:]
        label = name + "!" * (marked or name in FURNITURE)
        if name not in VOID:
            open_.append((name, label))
        stream.append(label)
        path = repath()
    flush()
    return stream, slots


# A wrapper is a list of items: a tag or slot (str), or [mark, items] with mark ? (optional) or + (repeated).


def folded(items: list, most: int = 8) -> list:
    """Neighbouring equal groups as one repeated group, shortest groups first."""
    for width in range(1, most + 1):
        out: list = []
        at = 0
        while at < len(items):
            group = items[at : at + width]
            reach = at + width
            while len(group) == width and items[reach : reach + width] == group:
                reach += width
            if reach > at + width:
                out.append(group[0] if width == 1 and isinstance(group[0], list) and group[0][0] == "+" else ["+", group])
                at = reach
            else:
                out.append(items[at])
                at += 1
        items = out
    return _absorbed(items)


def _absorbed(items: list) -> list:
    """A group that stands plainly beside its own repetition belongs to it."""
    out: list = []
    for item in items:
        if isinstance(item, list) and item[0] == "+":
            body = item[1]
            while len(out) >= len(body) and out[len(out) - len(body) :] == body:
                del out[len(out) - len(body) :]
        out.append(item)
        for k in range(len(out) - 2, max(-1, len(out) - 10), -1):
            if isinstance(out[k], list) and out[k][0] == "+" and out[k + 1 :] == out[k][1]:
                del out[k + 1 :]
                break
    return out


def _required(item) -> list:
    """What stands in a group, without its mark."""
    return [item] if isinstance(item, str) else item[1]


def aligned(a: list, b: list) -> list:
    """The least general wrapper found that covers two wrappers."""
    if a == b:
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _alike(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and _alike(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return folded(out)


def _alike(x, y) -> bool:
    """Items that may share a place: equal ones, or groups whose bodies begin alike."""
    if x == y:
        return True
    p, q = _required(x), _required(y)
    return (isinstance(x, list) or isinstance(y, list)) and bool(p) and bool(q) and _first(p) == _first(q)


def _first(items: list) -> str:
    return items[0] if isinstance(items[0], str) else _first(items[0][1])


def _joined(x, y):
    if x == y:
        return x
    marks = {v[0] for v in (x, y) if isinstance(v, list)}
    mark = "*" if "*" in marks or marks == {"?", "+"} else "+" if "+" in marks else "?"
    body = aligned(_required(x), _required(y))
    return [mark, body]


def _optional(item):
    if isinstance(item, str):
        return ["?", [item]]
    return ["*" if item[0] in "+*" else "?", item[1]]


def accepts(wrapper: list, stream: list[str]) -> bool:
    """Whether a wrapper derives a stream."""

    def ends(items: list, begins: frozenset[int]) -> frozenset[int]:
        for item in items:
            if isinstance(item, str):
                begins = frozenset(k + 1 for k in begins if k < len(stream) and stream[k] == item)
                continue
            mark, body = item
            reached = set(begins) if mark in "?*" else set()
            front = ends(body, begins)
            while front - reached:
                reached |= front
                front = ends(body, front) if mark in "+*" else frozenset()
            begins = frozenset(reached)
        return begins

    return len(stream) in ends(wrapper, frozenset([0]))


def merged(wrappers: list[list]) -> list:
    """One wrapper for all, aligned pair by pair so that each is read as few times as possible."""
    while len(wrappers) > 1:
        wrappers = [aligned(*wrappers[k : k + 2]) if k + 1 < len(wrappers) else wrappers[k] for k in range(0, len(wrappers), 2)]
    return wrappers[0] if wrappers else []


def article_place(path: str) -> int | None:
    """The rank of the place that a slot path stands in: 0 in an element of MAIN, 1 elsewhere, None in furniture."""
    labels = path.split("/")
    if any(x.endswith("!") for x in labels):
        return None
    return 0 if any(kind in labels for kind in MAIN) else 1


def article_slots(wrapper: list) -> dict[str, int]:
    """The slots of a wrapper that hold articles, by path, with the rank of their place."""
    found: dict[str, int] = {}
    for item in wrapper:
        if isinstance(item, list):
            found |= article_slots(item[1])
        elif item.startswith("#") and article_place(item[1:]) is not None:
            found[item[1:]] = article_place(item[1:])
    return found


def article_text(slots: list[tuple[str, str]], article: dict[str, int]) -> str:
    """The text of a page's article slots: what is in MAIN elements, or all where the page has no text in them."""
    best = min((article[p] for p, _ in slots if p in article), default=None)
    return "\n\n".join(said for p, said in slots if article.get(p) == best and best is not None)


def _hosts(urls: list[str | None]) -> list[str]:
    rests = [u.partition("://")[2] if u and "://" in u else "" for u in urls]
    return [re.split(r"[/?#]", r, maxsplit=1)[0].lower() for r in rests]


WRAPPER = "host string, wrapper string"
TEMPLATE = "host string, wrapper string, page bigint, paths array<bigint>, said array<struct<path: bigint, text: bigint>>"


def _number(*of: str) -> int:
    """A 64-bit hash of texts."""
    return int.from_bytes(hashlib.blake2b("\0".join(of).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its folded stream, a hash of all its slots, and hashes of its paths and of texts at a path, furniture left out."""
    for batch in batches:
        out = []
        for host, page in zip(_hosts(batch.column("url").to_pylist()), batch.column("html").to_pylist()):
            stream, slots = page_slots(page or "")
            numbers = {path: _number(path) for path, _ in slots if article_place(path) is not None}
            said = {(numbers[path], _number(path, text)) for path, text in slots if path in numbers}
            whole = _number(*(x for slot in slots for x in slot))
            out.append((host, json.dumps(folded(stream)), whole, [*numbers.values()], [{"path": p, "text": t} for p, t in said]))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "wrapper", "page", "paths", "said"])


def _constant(templates: DataFrame) -> DataFrame:
    """The template texts of each host: host, constant (hashes of path and text)."""
    once = templates.dropDuplicates(["host", "page"])
    paths = once.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")).where(f"n >= {ALIKE}")
    texts = once.select("host", F.inline("said")).groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(f"n >= {ALIKE}")
    return texts.join(paths, ["host", "path", "n"]).groupBy("host").agg(F.collect_list("text").alias("constant"))


def _aligned(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a host's wrappers."""
    wrapper = merged([json.loads(w) for w in sorted(group.wrapper, key=lambda s: (len(s), s))])
    return pd.DataFrame({"host": [group.host.iloc[0]], "wrapper": [json.dumps(wrapper)]})


def _dealt(wrappers: DataFrame) -> DataFrame:
    """Wrappers with `part`, which at most `TOGETHER` of a host share: they are numbered through in order of host and length."""
    order = ["host", F.length("wrapper"), "wrapper"]
    rows = wrappers.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows, "wrapper-order").withColumn("task", F.shiftright("at", 33))
    before, offsets = 0, []
    for task, n in sorted((r.task, r["count"]) for r in rows.groupBy("task").count().collect()):
        offsets.append((task, before))
        before += n
    spark = wrappers.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(offsets, "task bigint, before bigint")), "task")
    rows = rows.select("host", "wrapper", F.expr(f"before + (at & {(1 << 33) - 1}L)").alias("number"))
    first = rows.groupBy("host").agg(F.min("number").alias("first"))
    return rows.join(first, "host").select("host", "wrapper", F.expr(f"(number - first) div {TOGETHER}").alias("part"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host of (url, html): host, wrapper in JSON, constant (hashes of template texts)."""
    templates = stored(pages.select("url", "html").mapInArrow(_templates, TEMPLATE), "page-templates")
    found = stored(templates.select("host", "wrapper").distinct(), "page-streams")
    while not found.groupBy("host").count().where("count > 1").isEmpty():
        found = stored(_dealt(found).groupBy("host", "part").applyInPandas(_aligned, WRAPPER).distinct(), "page-wrappers")
    return found.join(_constant(templates), "host", "left")


@lru_cache(maxsize=512)
def _article(wrapper: str) -> dict[str, int]:
    return article_slots(json.loads(wrapper))


def varying(slots: list[tuple[str, str]], constant: list[int] | None) -> list[tuple[str, str]]:
    """The slots without template texts."""
    gone = frozenset(constant or ())
    return [(p, said) for p, said in slots if _number(p, said) not in gone] if gone else slots


def extract(pages: DataFrame, wrappers: DataFrame, key: str = "page_id") -> DataFrame:
    """The article text of each page of (key, url, html) by its host's wrapper: key, url, text, n_chars."""
    kind = pages.schema[key].dataType
    given = pages.select(F.col(key).alias("key"), "url", "html")
    slot_schema = T.StructType([T.StructField("key", kind)] + [T.StructField(n, t) for n, t in (("url", T.StringType()), ("host", T.StringType()), ("slots", T.BinaryType()))])
    text_schema = T.StructType([T.StructField(key, kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            slots = [pack(json.dumps(page_slots(p or "")[1], ensure_ascii=False).encode()) for p in batch.column(2).to_pylist()]
            hosts = _hosts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(slots, pa.binary())], slot_schema.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packs, wrapper, constant = (batch.column(k).to_pylist() for k in (2, 3, 4))
            texts = [article_text(varying(json.loads(unpack(s)), c), _article(w)) for s, w, c in zip(packs, wrapper, constant)]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], text_schema.names)

    salted = given.mapInArrow(read, slot_schema).withColumn("salt", F.pmod(F.xxhash64("slots"), F.lit(SALTS)).cast("int"))
    spread = wrappers.select("host", "wrapper", "constant", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = salted.join(spread, ["host", "salt"])
    return met.select("key", "url", "slots", "wrapper", "constant").mapInArrow(apply, text_schema)
