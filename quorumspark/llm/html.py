"""Main text of web pages: markup first, and a host suffix array for what markup leaves open.

A page is read once, in one pass over its tags, and written as blocks to the shared folder. Menus, headers, footers, sidebars, notices, adverts, forms and comments
that are marked as such, by element or by a whole class, id or role name, are furniture and never count; names that prose may have too ("related", "search") count only with a form or mostly links inside. Where a page has an article (or main) element, its blocks are the text, whole: what pages of a host
have in common inside their articles is theirs. Two kinds of pages leave something open, which the suffix array decides: a page that marks no article (the text outside of its furniture), and a page
of several article elements of which some, but not all, are mostly links and so may be cards of other stories (those articles).

1. every page gives its host a token stream, what is open first, then furniture (after its cards, what stands outside of its articles too; of a page that leaves nothing open, what stands outside of its article first);
2. the suffixes of a host's streams (each by its first `window` tokens) are dealt to suffix buckets by host and first tokens;
3. each bucket is sorted; suffixes that agree in all `window` tokens and come from pages with different texts are repeated: pages that are copies of each other count once;
4. tokens of an open page covered by repeated substrings are boilerplate and its unique runs are kept, unless fewer than `min_own` of its tokens are its own: then it is
   an edited copy of another page, which repeats because of that, and stays whole. An article that is mostly links is a card, and left out, if fewer than `min_own` of its tokens are its own.

Of equal suffixes in a batch one goes on for all, but for those of open pages, so a host's footer costs its bucket one row a batch.
"""

import hashlib
import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import dealt_by, small_batches, written

#: Elements whose text is never shown or never part of an article, elements that make blocks, elements that are prose themselves, and words of class, id or role that mark page furniture.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title", "head")
FURNITURE = frozenset("nav header footer aside form button select menu dialog audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = frozenset("br td th wbr option img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre code figure figcaption table td th tr dl dt dd ol ul li span a b i em strong small mark math".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements adsbygoogle adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices alert popup newsletter subscribe signup paywall sidebar nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot copyright comment comments commentlist reply replies respond disqus pagination pager contentinfo".split())
#: Words that name furniture or prose alike, which need evidence, and words that go with either kind in a name.
DOUBTFUL = frozenset("banner menu side search related recommended recommendations discussion share sharing social widget widgets promotion subscription modal overlay skip complementary".split())
FILLERS = frozenset("box wrap wrapper container inner outer block section list item items area bar slot unit site page post posts article blog entry left right top bottom main primary secondary button buttons link links form text title icon row col column panel holder region google global content body".split())
_RAW = "|".join(r for r in RAW if r != "head")
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S | re.I)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")


def _named(attributes, use_id):
    """Whether a whole class, id or role name is made of furniture words (and fillers): "sure" or "doubtful", else ""."""
    found = ""
    for m in _MARKED.finditer(attributes):
        if m[1].lower() == "id" and not use_id:
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w for w in _WORD.split(name.lower() if name.isupper() else re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()}
            marks = words & (MARKS | DOUBTFUL)
            if marks and words <= MARKS | DOUBTFUL | FILLERS:
                if marks & MARKS:
                    return "sure"
                found = "doubtful"
    return found


def _inside(page, start, name):
    """What stands between an element's opening tag, which ends at `start`, and its closing one."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(page, start):
        depth += -1 if m[1] else 1
        if not depth:
            return page[start : m.start()]
    return page[start:]


_LINKS = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)
_ANY = re.compile(r"<[^>]*>")


def _evident(inner):
    """Evidence that a doubtful element is furniture: a form or control in it, no text of its own, or links that make up half of its text."""
    if re.search(r"<(?:form|input|button|select)\b", inner, re.I):
        return True
    length = lambda x: len("".join(_ANY.sub(" ", x).split()))
    return 2 * sum(length(m) for m in _LINKS.findall(inner)) >= length(inner)


def _furniture(name, attributes, page, end):
    """Furniture by its element, or because it is hidden, or by a whole class, id or role name; a name that prose may have too needs evidence inside. A heading is never furniture by name, a paragraph or other prose not by its id."""
    if name in FURNITURE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    if name in HEADINGS:
        return False
    kind = _named(attributes, name not in PROSE)
    return kind == "sure" or kind == "doubtful" and name not in PROSE and _evident(_inside(page, end, name))


def blocks_of(page: str):
    """(blocks of articles, of main elements, of the rest, of furniture): [text] each, in page order; then the number of the outermost article element of each block of articles, and the numbers of those that are links by half of their text or more."""
    found = {"article": [], "main": [], "": [], "furniture": []}
    parts, depth = [], {"article": 0, "main": 0}
    numbers, sizes, in_link = [], [], False  # sizes: characters of text and of links in each article element
    skip = name_skipped = None  # nesting of the furniture element that is being left out
    at = 0

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            where = "furniture" if skip is not None else "article" if depth["article"] else "main" if depth["main"] else ""
            found[where].append(text)
            if where == "article":
                numbers.append(len(sizes) - 1)

    for m in _TAG.finditer(page):
        parts.append(page[at : m.start()])
        if depth["article"] and skip is None:
            sizes[-1][0] += m.start() - at
            sizes[-1][1] += (m.start() - at) * in_link
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "a":
            in_link = not closing
        if name in SPACES:
            parts.append(" ")
        elif name in BLOCKS or name in FURNITURE:
            flush()
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in depth and skip is not None and (closing or not _furniture(name, attributes, page, at)):
            if not (name_skipped == name and closing and skip > 1):
                # an article begins or ends: furniture that was not closed ends here
                flush()
                ended = name_skipped == name and closing
                skip = name_skipped = None
                if ended:
                    continue
        if skip is not None:
            if name == name_skipped:
                skip += -1 if closing else 1
                if not skip:
                    flush()
                    skip = name_skipped = None
            continue
        if not closing and _furniture(name, attributes, page, at):
            flush()
            skip, name_skipped = 1, name
        elif name in depth:
            flush()
            if name == "article" and not closing and not depth[name]:
                sizes.append([0, 0])
            depth[name] = max(0, depth[name] + (-1 if closing else 1))
    parts.append(page[at:])
    flush()
    return found["article"], found["main"], found[""], found["furniture"], numbers, {k for k, (text, links) in enumerate(sizes) if text and 2 * links >= text}


def _parsed(kept):
    def run(batches):
        for b in batches:
            text, rest, card, stream, is_open, name = [], [], [], [], [], []
            for page in b.column("html").to_pylist():
                article, middle, outside, furniture, numbers, linked = blocks_of(page or "")
                found = article or middle
                cards = linked if 0 < len(linked & {*numbers}) < len({*numbers}) else ()
                is_open.append(not found or bool(cards))
                text.append("" if is_open[-1] else "\n".join(found))
                rest.append(found if cards else [] if found else outside)
                card.append([k if k in cards else -1 for k in numbers] if cards else [])
                if cards:
                    stream.append("\n".join([*(t for t, k in zip(article, numbers, strict=True) if k in cards), _BORDER, *outside, _BORDER, *furniture]))
                else:
                    stream.append("\n".join([*outside, _BORDER, *furniture]))
                name.append(int.from_bytes(hashlib.blake2b(" ".join([*found, _BORDER, *outside, _BORDER, *furniture]).encode(), digest_size=8).digest(), "little", signed=True))
            columns = [pa.array(text, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(card, pa.list_(pa.int32())), pa.array(stream, pa.string()), pa.array(is_open), pa.array(name, pa.int64())]
            yield pa.record_batch([*(b.column(c) for c in (*kept, "host", "u1", "u2")), *columns], [*kept, "host", "u1", "u2", "text", "rest", "card", "stream", "is_open", "name"])

    return run


#: Stands between a stream's parts: a substring that has it is not compared.
_BORDER = "\x01"
_BORDER_HASH = A.Words(np.array([1], np.uint8), np.array([0, 1])).hash[0]


def _suffixes(window, buckets):
    # lo and hi: the least and the greatest name of the pages that have the suffix
    kind = np.dtype([("host", "<u8"), ("t", "<u4", (window,)), ("u1", "<i8"), ("u2", "<i8"), ("at", "<i4"), ("open", "<i4"), ("lo", "<u8"), ("hi", "<u8")])

    def grouped(x):
        order = np.lexsort((*(x["t"][:, k] for k in range(window - 1, -1, -1)), x["host"]))
        s = x[order]
        new = np.ones(len(x), bool)
        new[1:] = (s["host"][1:] != s["host"][:-1]) | (s["t"][1:] != s["t"][:-1]).any(axis=1)
        cut = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        if len(x):
            s["lo"], s["hi"] = np.minimum.reduceat(s["lo"], cut)[number], np.maximum.reduceat(s["hi"], cut)[number]
        return s, cut

    def deal(batches):
        for b in batches:
            host = np.array([hash_text(h or "") for h in b.column("host").to_pylist()], np.uint64)
            u1, u2, is_open, name = (np.array(b.column(c)) for c in ("u1", "u2", "is_open", "name"))
            for i, j, data, offsets in A.slices(b.column("stream")):
                w = A.Words(data, offsets)
                n = np.maximum(w.counts - window + 1, 0)
                if not n.sum():
                    continue
                row = np.repeat(np.arange(j - i), n)
                begin = w.first[:-1][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                border = np.concatenate(([0], np.cumsum(w.hash == _BORDER_HASH)))
                inside = border[begin + window] == border[begin]
                row, begin = row[inside], begin[inside]
                x = np.empty(len(begin), kind)
                x["host"], x["u1"], x["u2"] = host[i + row], u1[i + row], u2[i + row]
                x["t"] = (w.hash >> np.uint64(32)).astype(np.uint32)[begin[:, None] + np.arange(window)]
                # furniture of an open page only helps to find what repeats
                x["at"], x["open"] = begin - w.first[row], is_open[i + row] & (border[begin] == border[w.first[row]])
                x["lo"] = x["hi"] = name.view(np.uint64)[i + row]
                x, cut = grouped(x)
                first = np.zeros(len(x), bool)
                first[cut] = True
                x = x[first | (x["open"] > 0)]
                bucket = (A.mix(x["host"] ^ (x["t"][:, 0].astype(np.uint64) << np.uint64(32)) ^ x["t"][:, 1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                x = x[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket, kind="stable")
                cut = A.runs(bucket)
                yield pa.record_batch([pa.array(bucket[cut]), A.blobs(x.view(np.uint8).reshape(-1, kind.itemsize), np.append(cut[1:], len(x)) if len(cut) else cut)], ["bucket", "suffixes"])

    def sort(table):
        x, _ = grouped(A.joined(table.column("suffixes"), np.uint8).view(kind))
        x = x[(x["lo"] != x["hi"]) & (x["open"] > 0)]
        return pa.table([pa.array(x[c].copy()) for c in ("u1", "u2", "at")], ["u1", "u2", "at"])

    return deal, sort


def hash_text(text):
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _own(n, gone, window):
    """Which of n tokens no window that begins at `gone` covers."""
    edge = np.zeros(n + window + 1, np.int64)
    np.add.at(edge, np.array(gone, np.int64), 1)
    np.add.at(edge, np.array(gone, np.int64) + window, -1)
    return np.cumsum(edge)[:n] == 0


def without_cards(blocks, card, gone, window, min_own):
    """The blocks of a page's articles without those of cards (card: a number, -1 for other blocks) of which too little is their own."""
    of = np.repeat(np.array(card), [len(t.split(" ")) if k >= 0 else 0 for t, k in zip(blocks, card, strict=True)])
    n, own = np.bincount(of), np.bincount(of[_own(len(of), gone, window)], minlength=of.max() + 1)
    return [t for t, k in zip(blocks, card, strict=True) if k < 0 or own[k] >= min_own * n[k]]


def unique_runs(rest, gone, window, min_own):
    """The blocks of an open page without the tokens that windows beginning at `gone` cover; all of them if too little would be left."""
    flat = [block.split(" ") for block in rest]
    n = sum(map(len, flat))
    keep = _own(n, gone, window)
    if keep.sum() < min_own * n:
        return rest
    out, at = [], 0
    for words in flat:
        left = [w for w, k in zip(words, keep[at : at + len(words)], strict=True) if k]
        at += len(words)
        if left:
            out.append(" ".join(left))
    return out


def _chosen(kept, window, min_own):
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("rest", "card", "gone")), strict=True)
            texts = ["\n".join(without_cards(rest, card, gone or [], window, min_own) if card else unique_runs(rest, gone or [], window, min_own)) for rest, card, gone in rows]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return run


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple = ("page_id", "url"), window: int = 8, min_own: float = 0.1, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(*keep, text): the main text of each page, one row for each input row.

    Blocks are joined by a line feed, white space inside a block is one space, character references are decoded. A null or
    empty html gives an empty text; a null url is a host of its own; pages that repeat exactly are one page (a row each); other columns are not looked at. An empty table gives an empty
    result. A page of any length is parsed whole in its task (a few times its bytes). `bucket_bytes` of html go to a suffix bucket, which is sorted in memory; a run that a
    host repeats in very many open pages stays in one bucket, with a row of 80 bytes a page.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), "://([^/?#]*)", 1)), F.lit(""))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    kept = [f"_keep{i}" for i in range(len(keep))]
    use = pages.select(*(F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)), html.alias("html"), host.alias("host"), F.xxhash64(url_col, html).alias("u1"), F.xxhash64(html, F.lit(1), F.col(url_col)).alias("u2"))
    fields = ", ".join(f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True))
    parsed = written(use.mapInArrow(_parsed(kept), f"{fields}, host string, u1 long, u2 long, text string, rest array<string>, card array<int>, stream string, is_open boolean, name long"))
    n_bytes = parsed.agg(F.coalesce(F.sum(F.octet_length("stream")), F.lit(0))).first()[0]
    deal, sort = _suffixes(window, max(1, math.ceil(16 * n_bytes / bucket_bytes)))
    dealt = parsed.select("host", "u1", "u2", "stream", "is_open", "name").mapInArrow(deal, "bucket long, suffixes binary")
    hits = dealt_by(dealt, "bucket").applyInArrow(sort, "u1 long, u2 long, at int").groupBy("u1", "u2").agg(F.collect_set("at").alias("gone"))
    # only pages that leave something open meet the array's findings
    undecided = parsed.where("is_open").join(hits, ["u1", "u2"], "left").select(*kept, "rest", "card", "gone")
    out = parsed.where("NOT is_open").select(*kept, "text").union(undecided.mapInArrow(_chosen(kept, window, min_own), f"{fields}, text string"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "text")
