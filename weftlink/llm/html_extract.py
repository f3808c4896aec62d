"""Main text of web pages by consensus over the paths of a host's containers."""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names and class words.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("blockquote dd p pre".split())
SENTENCE = 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article blockquote body div main section td".split())
DROPPED = frozenset("aside button datalist dialog footer form head menu nav noscript option search select title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": set()}
NOISE = frozenset("ad adbox ads adsense adslot advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies dialog disqus footer masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split())
# Words that only say where a part stands or what it is made of, next to which a noise word still names the part.
FURNITURE = frozenset("area article articles author bar block blocks body bottom box boxes btn button buttons card col column container content cta entry fixed footer form global google group grid header holder icon icons id inline inner item items js left link links list main message modal outer overlay page panel post posts primary reader right rail row secondary section site slot small space sticky text title top unit user users view wrap wrapper".split())
HEADERS = frozenset("header page-header site-header top-header".split())
RAW = frozenset("iframe math noembed object script style svg template textarea xmp".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4][\"'\u2019\u201d\u00bb\u300d)\]]*$")


def _label(tag: str, rest: str) -> tuple[str, str]:
    """The generalised step of an element (tag and classes without digits) and what its names say of it.

    That is "noise" if one of its names holds a noise word and furniture words only, "maybe" if a noise word stands next
    to others (a social history, an ad-hoc group), else empty. A / in a class becomes a blank, which no class holds, as /
    joins the steps of a path.
    """
    if not rest or "=" not in rest and "hidden" not in rest:
        return tag, ""
    step, says = tag, ""
    for m in _NAMED.finditer(rest):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or value in HEADERS:
            says = "noise"
        for token in value.split():
            words = set(_WORD.findall(token))
            if not NOISE.isdisjoint(words):
                says = "noise" if words <= NOISE | FURNITURE else says or "maybe"
        if name == "class":
            step = f"{tag}." + ".".join(sorted(set(re.sub(r"\d+", "#", value).split()))).replace("/", " ")
    return step, "" if tag in ("html", "body", "article", "main") else says


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, str, int]]:
    """(container path, block tag, text, characters in links) of each text block outside of dropped parts, in page order.

    An element whose names only may be noise is dropped if at least half of its characters stand in links.
    """
    out: list = []
    doubtful: list[tuple[int, int]] = []  # first block and block after the last of elements that may be noise
    page = page or ""
    stack: list[tuple[str, str, bool, int]] = []  # tag, step, dropped, first block if it may be noise, else -1
    run: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text and not (stack and stack[-1][2]):
                path = tuple(x[1] for x in stack if x[0] in CONTAINERS)
                out.append((path, stack[-1][0] if stack else "", text, linked))
            run.clear()
        linked = 0

    def closed(elements: list) -> None:
        doubtful.extend((x[3], len(out)) for x in elements if x[3] >= 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        end = m["end"] or m["end2"]
        if tag == "a":
            in_link = 0 if end else 1
        if tag == "br":
            run.append("\n")
        if tag not in BLOCKS and tag not in DROPPED:
            continue
        flush()
        if end:
            if any(x[0] == tag for x in stack):
                i = max(i for i, x in enumerate(stack) if x[0] == tag)
                closed(stack[i:])
                del stack[i:]
                in_link = 0
            continue
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            closed(stack[-1:])
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    closed(stack[i:])
                    del stack[i:]
                    if tag not in ("tr",):
                        break
                elif stack[i][0] in STOPS[tag]:
                    break
        step, says = _label(tag, m["rest"] or m["rest2"] or "")
        inside = any(x[0] in ("article", "main") for x in stack)
        dropped = bool(stack and stack[-1][2]) or says == "noise" or tag in DROPPED or tag == "header" and not inside
        stack.append((tag, step, dropped, len(out) if says == "maybe" else -1))
    if at < len(page):
        run.append(page[at:])
    flush()
    closed(stack)
    if doubtful:
        chars, links = (list(itertools.accumulate((f(x) for x in out), initial=0)) for f in (lambda x: len(x[2]), lambda x: x[3]))
        gone = [False] * len(out)
        for first, last in doubtful:
            if 2 * (links[last] - links[first]) >= chars[last] - chars[first]:
                gone[first:last] = [True] * (last - first)
        out = [x for x, g in zip(out, gone, strict=True) if not g]
    return out


def scores(found: list) -> dict[str, float]:
    """Score of each container path: characters outside links of its own blocks, and half of those one container below."""
    out: dict[str, float] = {}
    for path, tag, text, linked in found:
        weight = max(0, len(text) - 2 * linked) * (0.3 if tag == "li" else 1.0)
        for up in range(min(2, len(path))):
            out_path = "/".join(path[: len(path) - up])
            bonus = 1.25 if path[len(path) - up - 1].split(".")[0] in ("article", "main") else 1.0
            out[out_path] = out.get(out_path, 0.0) + weight * bonus / (up + 1)
    return out


def _articles(steps: list[str] | tuple[str, ...]) -> list[int]:
    return [i for i, step in enumerate(steps) if step.split(".")[0] in ("article", "main")]


def best_path(found: list) -> str | None:
    """The best-scored path, or that of the article or main nearest around it."""
    ranked = sorted(scores(found).items(), key=lambda x: (-x[1], x[0]))
    if not ranked:
        return None
    steps = ranked[0][0].split("/")
    inside = _articles(steps)
    return "/".join(steps[: inside[-1] + 1] if inside else steps)


def _prose(found: list) -> bool:
    """Whether blocks are text rather than teasers or furniture.

    Half of their characters, headings aside, must stand in paragraphs of at least ``SENTENCE`` characters that end with
    a sentence mark, and a fifth at most in links. Shorter ones, like a call to read on, are no evidence.
    """
    chars = sum(len(text) for _, _, text, _ in found)
    plain = [(tag, text) for _, tag, text, _ in found if tag not in HEADINGS]
    whole = sum(len(text) for tag, text in plain if tag in PROSE and len(text) >= SENTENCE and _SENTENCE.search(text))
    return 0 < sum(len(text) for _, text in plain) <= 2 * whole and 5 * sum(linked for *_, linked in found) <= chars


def text_under(found: list, path: str | None) -> str:
    """Blocks under the containers with this path, joined by two newlines; all blocks if path is None.

    The own blocks of the containers around them come with them, as headings and leads often stand there: those within
    the outermost article or main, or, outside of both, of all containers. Blocks that are mostly links do not. So do
    the other containers in these that hold prose, unless they are articles of their own.
    """
    want = tuple(path.split("/")) if path is not None else ()
    if not any(own[: len(want)] == want for own, _, _, _ in found):
        return ""
    least = next((i + 1 for i in _articles(want)), 0)
    beside: dict[tuple[str, ...], list] = {}
    kept = []
    for i, (own, _, text, linked) in enumerate(found):
        if own[: len(want)] == want:
            kept.append(i)
            continue
        same = next((n for n, (x, y) in enumerate(zip(own, want, strict=False)) if x != y), min(len(own), len(want)))
        if same < least:
            continue
        if same == len(own):
            if len(text) > 2 * linked:
                kept.append(i)
        elif not _articles(own[same:]):
            beside.setdefault(own[: same + 1], []).append(i)
    for places in beside.values():
        if _prose([found[i] for i in places]):
            kept.extend(places)
    return "\n\n".join(found[i][2] for i in sorted(kept))


def extract(page: str | None, winners: list[str] | None) -> str:
    """The text under the first winning path that the page has, else under the page's own best container."""
    found = blocks(page)
    for path in winners or ():
        if text := text_under(found, path):
            return text
    return text_under(found, best_path(found))


def consensus(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """(host, winners): the container paths with at least ``least_share`` of a host's votes, most votes first.

    A page votes for its best path. Votes are summed per task, then per host and path, before they are gathered, and a
    host has at most 1 / least_share winners; ties go to the path that sorts first.
    """

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows: dict[tuple[str, str], int] = {}
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                path = best_path(blocks(page.as_py()))
                if path is not None:
                    rows[host, path] = rows.get((host, path), 0) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows]), pa.array([k[1] for k in rows]), pa.array(list(rows.values()), pa.int64())], ["host", "path", "n"])

    votes = pages.select("host", F.col("html").cast("string")).where("html is not null").mapInArrow(vote, "host string, path string, n long")
    tally = votes.groupBy("host", "path").agg(F.sum("n").alias("n"))
    total = tally.groupBy("host").agg(F.sum("n").alias("total"))
    ranked = tally.join(total, "host").where(F.col("n") >= least_share * F.col("total")).select("host", F.struct((-F.col("n")).alias("n"), "path").alias("rank"))
    return ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list("rank")), lambda x: x["path"]).alias("winners"))


def main_text(pages: DataFrame, broadcast_hosts: int = 200_000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Null or empty html: empty text. Null urls share the host "". Repeated rows are kept, ties between containers go to
    the path that sorts first, other columns are ignored, whatever their names; an empty table gives no rows. A page of
    any length is read whole, in linear time. Up to ``broadcast_hosts`` hosts, a count that is taken first, the winners
    are broadcast; beyond, pages are joined by host, and AQE splits a hot one.
    """
    from . import common

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/?#]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    winners = common.settle(consensus(rows), "host-paths")
    small = winners.count() <= broadcast_hosts
    joined = rows.join(F.broadcast(winners) if small else winners, "host", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [extract(page.as_py(), paths) for page, paths in zip(b.column("html"), b.column("winners").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "winners").mapInArrow(run, "page_id long, url string, text string, n_chars long")
