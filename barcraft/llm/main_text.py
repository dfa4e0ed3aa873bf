"""Operator 12: main text of pages by equivalence classes of template tokens.

Pages of a host come from templates.  Tokens (block-level tags and text blocks with their element
paths) that occur equally often on every page of their host form an equivalence class; a large and
frequent one is template, not content, if its tokens keep one order on all pages and its
occurrences nest in one place of the class around them.  Valid classes make the host's template;
what pages have between its tokens are slots, and the text comes from them.

Occurrence vectors are compared by sums of hashes of (page, count), so a host's pages are never
brought together: vectors, the evidence on order and nesting, and the link shares of slots are all
partial sums by (host, something).  A host's template has only tokens that half of its pages have,
so it is at most twice as long as its average page and is joined to pages as one row.

From the slots, an element that is named as an article or main part (article, main, their roles)
gives the page's text whole, repeated texts too, but for what is around an article by its own name
(menus, headers, footers, sidebars, notices, adverts, forms, comments).  Pages without one
give the slots that are no lists of links, without the template's own texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barcraft.llm.html_tokens import Page, read_page
from barcraft.llm.scratch import Scratch

#: Tokens of a class, pages of a host that have it (and that share of the host's pages).
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 3, 3, 0.5

_TOKENS = "host string, uid long, marked boolean, tokens array<long>, sizes array<int>, linked array<int>, kinds array<long>, times array<int>"
_EVIDENCE = "host string, class int, valid boolean, shape long, place long"
_LINKS = "host string, slot long, size long, linked long"


def host_of(url: Column) -> Column:
    """Lower-case host and port of a URL, null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(found != "", found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(values: list[int]) -> int:
    return _signed(xxhash.xxh64_intdigest(np.array(values, np.int64).tobytes()))


def _signature(page_id: int | None, url: str | None, html: str | None) -> int:
    return _signed(xxhash.xxh64_intdigest((html or "").encode(), xxhash.xxh64_intdigest(f"{page_id} {url}".encode())))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    for batch in batches:
        rows: dict[str, list] = {x.split(" ")[0]: [] for x in _TOKENS.split(", ")}
        columns = [batch.column(c).to_pylist() for c in ("host", "page_id", "url")]
        for host, page_id, url, html in zip(*columns, batch.column("html"), strict=True):
            html = html.as_py()
            page = read_page(html, cache)
            tokens = [_signed(t) for t in page.tokens]
            sizes, linked = [0] * len(tokens), [0] * len(tokens)
            for b in page.blocks:
                sizes[b.at], linked[b.at] = b.size, b.linked
            count = Counter(tokens)
            for name, value in zip(rows, (host, _signature(page_id, url, html), page.marked, tokens, sizes, linked, list(count), list(count.values())), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=_TOKEN_SCHEMA)


_TOKEN_SCHEMA = pa.schema(
    [("host", pa.string()), ("uid", pa.int64()), ("marked", pa.bool_()), ("tokens", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("linked", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)


def classes_of(tokens: DataFrame, least_tokens: int = CLASS_TOKENS, least_pages: int = CLASS_PAGES, share: float = CLASS_SHARE) -> DataFrame:
    """(host, classes): per host the large and frequent classes, each a sorted list of tokens."""
    each = tokens.select("host", "uid", F.explode(F.arrays_zip("kinds", "times")).alias("t")).select("host", F.col("t.kinds").alias("token"), F.xxhash64("uid", "t.times").alias("h"), F.col("t.times").alias("times"))
    high, low = F.shiftright("h", 32), F.col("h").bitwiseAND(0xFFFFFFFF)
    vectors = each.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum(high).alias("high"), F.sum(low).alias("low"))
    hosts = tokens.groupBy("host").agg(F.count("*").alias("of"))
    frequent = vectors.where(F.col("pages") >= least_pages).join(hosts, "host").where(F.col("pages") >= share * F.col("of"))
    classes = frequent.groupBy("host", "pages", "times", "high", "low").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= least_tokens)
    return classes.groupBy("host").agg(F.sort_array(F.collect_list("tokens")).alias("classes"))


def page_evidence(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, bool, int, int]]:
    """(class, valid on this page, its order, its place) of the classes that the page has.

    Valid: the class's tokens come in one order, over and over, and no larger class (of equal
    ones the earlier) has only some of its tokens inside an occurrence.  Place: the class
    around it and the gap there, the same for every occurrence."""
    of = {t: k for k, c in enumerate(classes) for t in c}
    at: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        if (k := of.get(t)) is not None:
            at.setdefault(k, []).append(i)
    marks = {k: np.array(v) for k, v in at.items()}
    out = []
    for k, mine in marks.items():
        size = len(classes[k])
        order = [tokens[i] for i in mine]
        valid = len(order) % size == 0 and order == order[:size] * (len(order) // size)
        place = []
        if valid:
            begin, end = mine[::size], mine[size - 1 :: size]
            narrow = None
            for other, theirs in marks.items():
                m = len(classes[other])
                if other == k or len(theirs) % m:
                    continue
                before, until = np.searchsorted(theirs, begin), np.searchsorted(theirs, end)
                if (before == until).all():
                    gaps = before % m
                    if (gaps == 0).all():
                        continue
                    if (gaps != gaps[0]).any():
                        valid &= (len(classes[other]), -other) < (size, -k)
                    else:  # around this class; the innermost has the latest token before it
                        nearest = int(theirs[before[0] - 1])
                        if narrow is None or nearest > narrow:
                            narrow, place = nearest, [classes[other][0], int(gaps[0])]
                elif ((before % m != 0) | (until % m != 0)).any():
                    valid &= (m, -other) < (size, -k)
        out.append((k, bool(valid), _hash(order[:size]), _hash(place)))
    return out


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(host, *found) for host, tokens, classes in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "classes")), strict=True) for found in page_evidence(tokens, classes)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["host", "class", "valid", "shape", "place"])


def templates_of(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, template): the tokens of classes that are ordered and nested alike on all pages."""
    seen = tokens.join(classes, "host").select("host", "tokens", "classes").mapInArrow(_evidence, _EVIDENCE)
    agreed = seen.groupBy("host", "class").agg(F.min("valid").alias("valid"), F.min("shape") == F.max("shape"), F.min("place") == F.max("place")).toDF("host", "class", "valid", "one_shape", "one_place")
    valid = agreed.where("valid and one_shape and one_place").groupBy("host").agg(F.collect_list("class").alias("those"))
    chosen = F.transform(F.array_sort("those"), lambda k: F.element_at("classes", k + 1))
    return valid.join(classes, "host").select("host", F.flatten(chosen).alias("template"))


def slots_of(tokens: list[int], template: set[int]) -> list[int | None]:
    """Per token the slot it is in, named by the template token before it (0: none); None for the
    template's own tokens."""
    slot, out = 0, []
    for t in tokens:
        if t in template:
            slot = t
            out.append(None)
        else:
            out.append(slot)
    return out


def _slot_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, int], list[int]] = {}
        for host, tokens, template, sizes, linked in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "template", "sizes", "linked")), strict=True):
            for slot, size, links in zip(slots_of(tokens, set(template)), sizes, linked, strict=True):
                if slot is not None and size:
                    sums = total.setdefault((host, slot), [0, 0])
                    sums[0] += size
                    sums[1] += links
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())],
            names=["host", "slot", "size", "linked"],
        )


def link_slots_of(tokens: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, link_slots): slots whose text is mostly links, over all pages that name no article."""
    parts = tokens.where("not marked").join(templates, "host").select("host", "tokens", "template", "sizes", "linked").mapInArrow(_slot_links, _LINKS)
    sums = parts.groupBy("host", "slot").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    return sums.where(2 * F.col("linked") > F.col("size")).groupBy("host").agg(F.collect_list("slot").alias("link_slots"))


def extract(page: Page, template: set[int], link_slots: set[int]) -> list[str]:
    """The page's main blocks in page order."""
    blocks = [b for b in page.blocks if b.text]
    if page.marked:
        return [b.text for b in blocks if b.main]
    slots = slots_of([_signed(t) for t in page.tokens], template)
    prose = [b for b in blocks if 2 * b.linked <= b.size]
    inside = [b.text for b in prose if slots[b.at] is not None and slots[b.at] not in link_slots]
    return inside or [b.text for b in prose]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    for batch in batches:
        templates, links = batch.column("template").to_pylist(), batch.column("link_slots").to_pylist()
        texts = ["\n".join(extract(read_page(html.as_py(), cache), set(t or ()), set(k or ()))) for html, t, k in zip(batch.column("html"), templates, links, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def site_templates(pages: DataFrame, scratch: Scratch, least_tokens: int = CLASS_TOKENS, least_pages: int = CLASS_PAGES, share: float = CLASS_SHARE) -> DataFrame:
    """(host, template, link_slots) of the hosts that have one; pages has host, page_id, url, html."""
    sited = pages.where(F.col("host").isNotNull())
    tokens = scratch.write("tokens", sited.mapInArrow(_token_rows, _TOKENS), compression="zstd")
    classes = scratch.write("classes", classes_of(tokens, least_tokens, least_pages, share))
    templates = scratch.write("valid", templates_of(tokens, classes))
    found = scratch.write("templates", templates.join(link_slots_of(tokens, templates), "host", "left"))
    scratch.keep_only("templates")
    return found


def main_text(pages: DataFrame, least_tokens: int = CLASS_TOKENS, least_pages: int = CLASS_PAGES, share: float = CLASS_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty html has the empty text.  A page without a host (a null or relative url) and
    those of hosts with fewer than ``least_pages`` pages have no template and are judged on their
    own.  Rows are pages each for themselves, repeated ids, urls and rows too, and each counts for
    its host's template.  Pages of any length are read whole; elements deeper than 512 are not kept
    apart.  White space is what Unicode calls so, no-break spaces among it; ``br`` is white space.
    Other columns are ignored.  An empty table gives none.
    """
    scratch = Scratch(pages.sparkSession, "main-text")
    sited = pages.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")
    templates = site_templates(sited, scratch, least_tokens, least_pages, share)
    page_type, url_type = (dict(pages.dtypes)[c] for c in ("page_id", "url"))
    return sited.join(templates, "host", "left").select("page_id", "url", "html", "template", "link_slots").mapInArrow(_texts, f"page_id {page_type}, url {url_type}, text string, n_chars long")
