"""Main text of web pages: the maximum-scoring contiguous run of words (positive) and tags (negative).

A page becomes a line of tokens. Each has a kind, from where it stands: words by block and link; tags by name; both, on pages that have a landmark element
(article, main), by whether they stand in it. A kind's weight is its log-likelihood ratio between content and the rest, counted on labelled pages. One
linear scan finds the run with the largest sum; what that run holds outside removed elements (menus, forms, adverts, comments and so on) is the text.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

#: Comments; elements of raw text; tags, in which a quote counts only after an equals sign and only if it is closed; other marks; text, to which a `<` that begins none of these belongs.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|title|textarea|template|noscript|svg|math|xmp|noframes)(?=[\s/>])(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|((?:[^<]|<(?![a-zA-Z/!?]))+)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PARTS = re.compile(r"[^a-z0-9]+")

#: Elements that part blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Other elements of HTML, whose tags have kinds of their own; all further names share one.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label map mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var colgroup slot".split()
)
#: Elements that are never part of the main text.
REMOVED = frozenset("nav footer aside form button select menu iframe dialog head object audio video canvas fieldset datalist".split())
#: Classes, ids and roles that mark an element as not part of the main text, as a whole, or if all of their parts are among these and QUALIFIERS.
REMOVED_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social related recommended comment comments commentlist disqus replies reply respond widget toolbar pagination pager skip search copyright disclaimer"
    " contentinfo complementary topbar alert".split()
)
#: Words that leave the meaning of a removed name as it is ("site-footer", "comment-list-2", "ad_box").
QUALIFIERS = frozenset(
    "site page main top bottom left right primary secondary global post article entry blog list box bar wrapper wrap container block section area inner outer content links link"
    " form item items js module panel region group thread user reader threaded policy message text row slot unit buttons button icons media mobile desktop".split()
)
#: A header by name is a page's, not an article's, only in these words.
PAGE_HEADERS = frozenset("header siteheader pageheader".split())
HEADER_QUALIFIERS = frozenset("site page top global main wrapper wrap container inner bar".split())
LANDMARKS = frozenset(("article", "main"))
_PLAIN_NAMES = frozenset("html body article main b i em strong a br u code small sub sup h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold a whole page's text although their name says otherwise.
_MAY_WRAP = frozenset("div section form fieldset span td table center p ul li dd".split())

WORD, TAG = 0, 1
Token = tuple[int, str, str, bool]


class _Open:
    __slots__ = ("landmark", "name", "number", "removed")

    def __init__(self, name: str, number: int, removed: bool, landmark: bool):
        self.name, self.number, self.removed, self.landmark = name, number, removed, landmark


def _removed_name(name: str) -> bool:
    """Whether one class, id or role names something that isn't main text."""
    parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
    if any(x in PAGE_HEADERS for x in parts) and all(x in PAGE_HEADERS or x in HEADER_QUALIFIERS for x in parts):
        return True
    return any(x in REMOVED_NAMES for x in parts) and all(x in REMOVED_NAMES or x in QUALIFIERS for x in parts)


def _named_removed(given: dict[str, str]) -> bool:
    return any(_removed_name(name) for k in ("class", "id", "role") if k in given for name in given[k].split())


def _scan(page: str, spared: frozenset[int]) -> tuple[list[Token], int, Counter]:
    """The tokens; how many words outside links are kept; how many each outermost removed element (by number of its tag) holds. Spared elements are kept."""
    out: list[Token] = []
    stack: list[_Open] = []
    held: Counter = Counter()
    removed = landmark = links = kept = tags = 0
    block, outermost = "none", -1

    def close(upto: int) -> None:
        nonlocal removed, landmark, links
        while len(stack) > upto:
            x = stack.pop()
            removed -= x.removed
            landmark -= x.landmark
            links -= x.name == "a"

    for m in _TOKEN.finditer(page):
        raw, slash, name, attributes, text = m.groups()
        if text is not None:
            if not links:
                n = len(text.split())
                if removed:
                    held[outermost] += n
                else:
                    kept += n
            if not removed:
                out.append((WORD, f"{block}/a" if links else block, _html.unescape(text) if "&" in text else text, landmark > 0))
            continue
        if name is None:
            if raw and not removed and raw.lower() in ("script", "style", "svg"):
                out.append((TAG, "raw", "", landmark > 0))
            continue
        name = name.lower()
        kind = name if name in BLOCKS or name in INLINE or name in VOID else "other"
        part = " " if name in BLOCKS else ""
        if slash:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), -1)
            was = removed
            if at >= 0 and not (removed and any(x.removed for x in stack[at + 1 :]) and name in ("p", "b", "i", "a", "span")):
                close(at)
            if part:
                block = "none"
            if not was:
                out.append((TAG, f"/{kind}", part, landmark > 0))
            elif not removed:
                out.append((TAG, "removed", " ", landmark > 0))
            continue
        tags += 1
        given = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t\r") else {}
        named = name not in _PLAIN_NAMES and _named_removed(given)
        mark = (name in LANDMARKS or given.get("role") == "main" or given.get("itemprop") == "articlebody") and not _named_removed(given)
        if part and name != "br":  # a block ends an open paragraph
            at = len(stack) - 1
            while at >= 0 and stack[at].name not in BLOCKS:
                at -= 1
            if at >= 0 and stack[at].name == "p":
                close(at)
        if name == "body" or (mark and removed):  # an element left open doesn't swallow the main text
            close(0)
        gone = not mark and (
            name in REMOVED
            or (name == "header" and not landmark)
            or named
            or (name not in ("html", "body") and ("hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")))
        )
        if gone and tags in spared:
            gone = False
        if not removed and not gone:
            out.append((TAG, kind, part, landmark > 0 or mark))
        elif not removed:
            out.append((TAG, "removed", " ", landmark > 0))
        if part and name != "br":
            block = name
        if name not in VOID and not attributes.endswith("/"):
            if gone and not removed:
                outermost = tags if name in _MAY_WRAP or named else 0
            stack.append(_Open(name, tags, gone, mark))
            removed += gone
            landmark += mark
            links += name == "a"
    return out, kept, held


#: A removed element isn't removed if it holds this many words outside links and this many times what is kept of the page.
WRAPPER_WORDS, WRAPPER_TIMES = 25, 20


def tokens(page: str) -> list[Token]:
    """(WORD or TAG, kind, text, inside a landmark) in page order. What is removed leaves one TAG of kind `removed`; a block's end is a TAG with text " ".

    An element whose name says otherwise but that wraps almost all of the page's text is kept.
    """
    spared: frozenset[int] = frozenset()
    while True:
        line, kept, held = _scan(page, spared)
        del held[0], held[-1]
        most = max(held, key=lambda k: (held[k], -k), default=0)
        if not most or held[most] < WRAPPER_WORDS or held[most] < WRAPPER_TIMES * kept:
            return line
        spared |= {most}


def _kinds(line: list[Token]) -> Iterator[tuple[int, str, str]]:
    """Each token's type, kind and text; on pages with a landmark the kind begins with the side on which the token stands."""
    marked = any(inside for *_, inside in line)
    for token, kind, text, inside in line:
        yield token, f"{'in' if inside else 'out'} {kind}" if marked else kind, text


def count_kinds(page: str) -> Counter:
    """(token type, kind, in content) -> number, of a page whose landmark element labels its content; others teach nothing. Kinds count with and without their side."""
    found: Counter = Counter()
    line = tokens(page)
    if any(inside for *_, inside in line):
        for (token, sided, text), (_, kind, _, inside) in zip(_kinds(line), line, strict=True):
            n = len(text.split()) if token == WORD else 1
            found[token, sided, inside] += n
            found[token, kind, inside] += n
    return found


def default_weight(token: int, kind: str) -> float:
    """Of kinds that no labelled page shows."""
    if token == TAG:
        return -0.02 if kind.startswith("in ") else -0.1
    if kind.startswith("out "):
        return -4.0
    return -0.5 if kind.endswith("li/a") else 0.3 if kind.endswith("/a") else 1.0


def weights_of(counts: Counter) -> dict[tuple[int, str], float]:
    """Log-likelihood ratios of the kinds, held within [0.5, 4] for words and [-0.3, -0.02] for tags; words outside a landmark weigh -4 to 0.5, words of links -0.5 at least."""
    n = {inside: 1 + sum(v for (_, _, i), v in counts.items() if i is inside) for inside in (True, False)}
    out = {}
    for token, kind in {k[:2] for k in counts}:
        ratio = math.log((counts[token, kind, True] + 1) / n[True]) - math.log((counts[token, kind, False] + 1) / n[False])
        if token == TAG:
            out[token, kind] = -0.02 if kind.startswith("in ") else -min(0.3, max(0.02, -ratio))
        elif kind.startswith("out "):
            out[token, kind] = default_weight(token, kind)
        else:
            out[token, kind] = min(4.0, max(-0.5 if kind.endswith("/a") and not kind.startswith("in ") else 0.5, ratio))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """First and last + 1 place of the contiguous run with the largest sum; of equal runs the first; (0, 0) if no sum is positive."""
    best = total = 0.0
    span, start = (0, 0), 0
    for i, value in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: dict[tuple[int, str], float]) -> str:
    """The main text; "" for a null or empty page and for one without a positive run."""
    if not page:
        return ""
    line = list(_kinds(tokens(page)))
    values = []
    for token, kind, text in line:
        w = weights.get((token, kind))
        if w is None:
            w = default_weight(token, kind)
        values.append(len(text.split()) * w if token == WORD else w)
    return " ".join("".join(text for *_, text in line[slice(*best_run(values))]).split())


def fit(pages: DataFrame, html_col: str = "html") -> dict[tuple[int, str], float]:
    """Weights from all given labelled pages; there are a few hundred kinds at most, whatever the pages, as only names of HTML have kinds of their own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                found += count_kinds(page.as_py() or "")
        rows = [(t, k, i, n) for (t, k, i), n in found.items()]
        yield pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.int64()))], ["token", "kind", "inside", "n"])

    counted = pages.select(F.col(html_col).alias("__sl_html")).mapInArrow(count, "token int, kind string, inside boolean, n long").groupBy("token", "kind", "inside").agg(F.sum("n").alias("n"))
    return weights_of(Counter({(r["token"], r["kind"], r["inside"]): r["n"] for r in counted.collect()}))


def html_extract(pages: DataFrame, html_col: str = "html", sample_rows: int = 400, id_col: str = "page_id", weights: dict | None = None) -> DataFrame:
    """pages, without the HTML, with text (main text, "" if none) and n_chars (its code points). A page is read whole, in time linear in it, by one task.

    Weights come from `weights`, or are learned from `sample_rows` pages at most that label their main text with an article or main element
    (those of the smallest hashes of the id). Repeated rows are extracted each by itself. Columns named text or n_chars are replaced.
    """
    small_batches(pages.sparkSession)
    if weights is None:
        labelled = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("__sl_html")).where(F.col("__sl_html").rlike(r"(?i)<(article|main)[\s>]"))
        chosen = labelled.select("_id", F.xxhash64("_id").alias("_h")).orderBy("_h").limit(sample_rows)
        weights = fit(labelled.join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi"), "__sl_html")
    kept = pages.drop("text", "n_chars").withColumn("__sl_html", F.col(html_col))
    if html_col in kept.columns:
        kept = kept.drop(html_col)
    names = [c for c in kept.columns if c != "__sl_html"]
    schema = kept.select(*names).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = pa.array([extract(x.as_py(), weights) for x in batch.column(len(names))], pa.string())
            yield pa.record_batch([*(batch.column(i) for i in range(len(names))), texts], [*names, "text"])

    return kept.select(*names, "__sl_html").mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
