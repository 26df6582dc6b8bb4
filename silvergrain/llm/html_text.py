"""Main text of web pages by differencing each page with those of nearest URL.

Elements and roles that the markup itself gives to frames (menus, footers,
forms, scripts) go first. What is left is compared, line by line, with other
pages of the host: distinct pages are sorted by host and path, each is paired
with those next to it, their lines are aligned by longest common subsequence,
and shared lines are deleted. Several neighbours vote: a line goes if most of
them share it. Inside an article or main element the markup speaks for a line:
there all of them have to share it, and to outnumber the markup's own votes.
Neighbours that are versions of one page, alike among themselves but not the bulk
of their host, count as one page and are compared with others only.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.llm.common import broadcast_if_small, cut, partitions
from silvergrain.operators.ordering import running_sums, with_next

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=]+|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)|(["'])))?""")
# Names of elements, roles and types.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "select", "xmp"}
NESTED = {"svg", "template", "object", "select"}
DROPPED = {"annotation", "annotation-xml", "head", "nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "search", "datalist", "label", "canvas", "audio", "video", "applet", "map"}
WRAPPERS = {"form", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status", "comment"}
TYPES = {"comment", "usercomments", "sitenavigationelement", "wpheader", "wpfooter", "wpsidebar", "wpadblock"}
#: Places before and after a page, in the order of URLs, at which its partners stand.
STEPS = (1, 2, 4, 8)
#: Votes that the markup has for a line of an article. (Of one or two partners a shared passage of the story itself can't be told from frame.)
MARKUP = 2
#: Neighbours are versions of one page where the lines that both hold make up this part (over, under) of the lines of either.
ALIKE = (4, 5)
#: Pages that one task compares.
BLOCK_PAGES = 256
MARK = 16


def tag_at(page: str, at: int) -> tuple[str, bool, dict[str, str], int, bool] | None:
    """(name, closing, attributes, place behind, whether it closes itself) of the tag whose < stands at at; None if the page ends in it."""
    named = NAME.match(page, at + 1)
    name, at = named[1].lower(), named.end()
    known = at
    has: dict[str, str] = {}
    while at < len(page):
        if page[at] == ">":
            return name, named[0][0] == "/", has, at + 1, known < at and page[at - 1] == "/"
        m = ATTRIBUTE.match(page, at)
        if not m:  # spaces or slashes before the end
            at += 1
            continue
        if m[5]:  # a quote that never closes
            return None
        has.setdefault(m[1].lower(), next((v for v in m.group(2, 3, 4) if v is not None), ""))
        at = known = m.end()
    return None


def end_of_raw(page: str, lower: str, name: str, at: int) -> int:
    """Where the content of an element ends that goes whole, from behind its start tag; at itself if an element that may hold others never ends."""
    if name not in NESTED:
        end = lower.find(f"</{name}", at)
        return len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
    depth, here = 1, at
    for m in re.compile(f"<(/?){name}(?![a-z0-9-])").finditer(lower, at):
        if m.start() < here:  # inside a tag that was read already
            continue
        tag = tag_at(page, m.start())
        if tag is None:
            return len(page)
        here = tag[3]
        depth += -1 if m[1] else 0 if tag[4] and name == "svg" else 1
        if not depth:
            return here
    return at


def _kind(name: str, has: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """(dropped, holds the article). An article's own header is part of it."""
    if name in DROPPED and not (name == "header" and inside):
        return True, False
    if not has:
        return False, name in ("article", "main")
    role = has.get("role", "").strip().lower()
    if "hidden" in has or has.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", has.get("style", ""), re.I):
        return True, False
    if role in ROLES or has.get("itemtype", "").strip().lower().rsplit("/", 1)[-1] in TYPES:
        return True, False
    return False, name in ("article", "main") or role in ("main", "article") or has.get("itemprop", "").strip().lower() == "articlebody"


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(line, whether in the article's element) of the page's blocks, in page order.

    Blocks in elements that are dropped are left out, with two exceptions. A
    form or fieldset that holds an article, or all that a page has, only wraps it. An
    article in another dropped element counts where it is longer than all that
    stands outside. Of several articles the one with the only h1, else the longest, is
    the page's; one inside another is a reader's comment unless it is
    more than half of it. A br ends a block.
    """
    found: list[tuple[str, bool, int, tuple[int, ...], bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool, tuple[int, int, int] | None]] = []
    # elements being dropped, wrappers among them apart; both start anew inside an article that they hold
    dropped = wrapped = inside = 0
    rescue, articles, opened = 0, (), 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, inside > 0, 3 if wrapped else rescue, articles, any(e[0] == "h1" for e in stack)))
            parts.clear()

    def pop(to: int) -> None:
        nonlocal dropped, wrapped, inside, rescue, articles
        while len(stack) > to:
            _, d, a, is_article, outer = stack.pop()
            dropped -= d == 1
            wrapped -= d == 2
            inside -= a
            if is_article:
                articles = articles[:-1]
            if outer:
                dropped, wrapped, rescue = outer

    at, lower = 0, None
    while at < len(page):
        less = page.find("<", at)
        text_end = len(page) if less < 0 else less
        if not dropped and text_end > at:
            parts.append(page[at:text_end])
        if less < 0:
            break
        after = page[less + 1 : less + 3]
        if after[:1] in ("!", "?") or (after[:1] == "/" and after[1:] and not (after[1].isascii() and after[1].isalpha())):
            if page.startswith("<!--", less):
                end = less + 4 if page.startswith(">", less + 4) else page.find("-->", less + 4)
                at = len(page) if end < 0 else end + (1 if end == less + 4 and page[end] == ">" else 3)
            else:
                end = page.find(">", less)
                at = len(page) if end < 0 else end + 1
            continue
        if not NAME.match(page, less + 1) or not (after.lstrip("/")[:1].isascii() and after.lstrip("/")[:1].isalpha()):
            if not dropped:
                parts.append("<")
            at = less + 1
            continue
        tag = tag_at(page, less)
        if tag is None:
            break
        name, closing, has, at, closed = tag
        if name in BLOCK:
            flush()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if depth >= 0:
                pop(depth)
            continue
        if name in VOID or (closed and (name == "svg" or any(e[0] == "math" for e in stack))):
            continue
        if name in RAW:
            if lower is None:
                lower = page.lower()
                lower = lower if len(lower) == len(page) else re.sub("[A-Z]", lambda m: m[0].lower(), page)
            at = end_of_raw(page, lower, name, at)
            continue
        d, a = _kind(name, has, inside > 0)
        starts = a and (name in ("article", "main") or "role" in has or "itemprop" in has)
        if starts and dropped:
            # a dropped element that is never closed ends where the article starts
            lost = next((k for k, e in enumerate(stack) if e[1] == 1 and not re.compile(f"</{re.escape(e[0])}", re.I).search(page, at)), -1)
            if lost >= 0:
                pop(lost)
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "menu"):
                    break
        outer = None
        if starts and not inside and (dropped or wrapped):
            outer, rescue, dropped, wrapped = (dropped, wrapped, rescue), 2 if dropped else rescue, 0, 0
        is_article = a and (name == "article" or has.get("role", "").strip().lower() == "article")
        if is_article:
            opened += 1
            articles = (*articles, opened)
        kind = 0 if not d else 2 if name in WRAPPERS and not (set(has) & {"role", "hidden", "aria-hidden", "style"}) and not inside else 1
        stack.append((name, kind, a, is_article, outer))
        dropped += kind == 1
        wrapped += kind == 2
        inside += a
    flush()
    return _chosen(found)


def _chosen(found: list[tuple[str, bool, int, tuple[int, ...], bool]]) -> list[tuple[str, bool]]:
    """The lines that lines_of returns, of (line, in an article or main, 0 or what it is kept out by, articles around it, in an h1)."""
    size = lambda rows: sum(len(r[0]) for r in rows)
    own, held, wrapped = ([r for r in found if r[2] == k] for k in (0, 2, 3))
    if held and not any(r[1] for r in own) and size(held) > size(own):
        own = held
    own = own or wrapped
    tops = list(dict.fromkeys(r[3][0] for r in own if r[3]))
    if len(tops) > 1:
        titled = {r[3][0] for r in own if r[3] and r[4]}
        best = titled.pop() if len(titled) == 1 else max(tops, key=lambda t: size([r for r in own if r[3][:1] == (t,)]))
        own = [r for r in own if not r[3] or r[3][0] == best]
    lengths: dict[int, int] = {}
    for r in own:
        for t in r[3]:
            lengths[t] = lengths.get(t, 0) + len(r[0])
    return [(r[0], r[1]) for r in own if all(2 * lengths[t] > lengths[r[3][0]] for t in r[3][1:])]


def common_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b.

    Lines that the other lacks play no part and common ends are cut off; the
    rest is done by bit-parallel rows, of halves of a (Hirschberg) where all
    rows would take too much memory.
    """
    in_a, in_b = set(a), set(b)
    places = [k for k, x in enumerate(a) if x in in_b]
    a, b = [a[k] for k in places], [x for x in b if x in in_a]
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    middle = _aligned(a[lo : len(a) - hi], b[lo : len(b) - hi])
    return [places[k] for k in [*range(lo), *(lo + k for k in middle), *range(len(a) - hi, len(a))]]


def _rows(a: list, b: list) -> Iterator[int]:
    """After each row of a: a 0 bit where the length of the common subsequence with b's prefix grows."""
    full = (1 << len(b)) - 1
    where: dict = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> list[int]:
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for k in range(len(b)):
        out.append(out[-1] + (not v >> k & 1))
    return out


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 1 << 30:
        half = len(a) // 2
        front, back = _lengths(a[:half], b), _lengths(a[:half - 1 : -1], b[::-1])
        split = max(range(len(b) + 1), key=lambda k: front[k] + back[len(b) - k])
        return _aligned(a[:half], b[:split]) + [half + k for k in _aligned(a[half:], b[split:])]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    out, j = [], len(b) - 1
    i = len(a)
    while i and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif not rows[i - 1] >> j & 1:
            i -= 1
        else:
            i -= 1
            j -= 1
            out.append(i)
    return out[::-1]


def main_places(inside: bytes) -> list[int]:
    """Places of a page's candidates: the lines in the article's element, or all where there is none."""
    return [k for k, a in enumerate(inside) if a] or list(range(len(inside)))


def kept_lines(marks: list[bytes], inside: bytes, partners: list[list[bytes]]) -> list[int]:
    """Places, among a page's candidates, of the lines that stay.

    A line goes if most partners share it, in an article if all do and are
    more than MARKUP. Without partners all stay.
    """
    marked = any(inside)
    candidates = main_places(inside)
    open_ = {marks[k] for k in candidates}
    if marked:
        for p in partners:
            open_ &= set(p)
    if len(partners) <= (MARKUP if marked else 0) or not open_:
        return list(range(len(candidates)))
    votes = dict.fromkeys(candidates, 0)
    for p in partners:
        for k in common_lines(marks, p):
            if k in votes:
                votes[k] += 1
    need = len(partners) if marked else len(partners) // 2 + 1
    return [i for i, k in enumerate(candidates) if votes[k] < need]


def are_versions(a: dict, b: dict) -> bool:
    """Whether the candidates of two pages (marks, inside, sizes) are alike, by code points of the lines that both hold."""
    count = [Counter(m[k] for k in main_places(p["inside"])) for p, m in ((a, _split(a["marks"])), (b, _split(b["marks"])))]
    length = {m: n for p in (a, b) for m, n in zip(_split(p["marks"]), p["sizes"], strict=True)}
    shared, either = (sum(n * length[m] for m, n in c.items()) for c in (count[0] & count[1], count[0] | count[1]))
    return either > 0 and ALIKE[1] * shared >= ALIKE[0] * either


def mark_of(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=MARK).digest()


def _split(marks: bytes) -> list[bytes]:
    return [marks[a : a + MARK] for a in range(0, len(marks), MARK)]


def _key(marks: list[bytes], inside: bytes) -> bytes:
    return hashlib.blake2b(b"".join(marks) + inside, digest_size=MARK).digest()


LIGHT = "page_id long, host string, path string, key binary, marks binary, inside binary, sizes array<int>"
FULL = "page_id long, url string, host string, key binary, lines array<string>"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"key": [], "marks": [], "inside": [], "sizes": []}
        for page in batch["html"].to_pylist():
            lines = lines_of(page or "")
            marks, inside = [mark_of(t) for t, _ in lines], bytes(a for _, a in lines)
            out["key"].append(_key(marks, inside))
            out["marks"].append(b"".join(marks))
            out["inside"].append(inside)
            out["sizes"].append([len(t) for t, _ in lines])
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], *(pa.array(out[k], pa.binary()) for k in ("key", "marks", "inside")), pa.array(out["sizes"], pa.list_(pa.int32()))], names=["page_id", "host", "path", *out])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = [], []
        for page in batch["html"].to_pylist():
            lines = lines_of(page or "")
            marked = any(a for _, a in lines)
            keys.append(_key([mark_of(t) for t, _ in lines], bytes(a for _, a in lines)))
            texts.append([t for t, a in lines if a or not marked])
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], pa.array(keys, pa.binary()), pa.array(texts, pa.list_(pa.string()))], names=["page_id", "url", "host", "key", "lines"])


def _first_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """starts: 0 for a version of the page before, 1 for all others."""
    for batch in batches:
        starts = [int(b is None or not are_versions(a, b)) for a, b in zip(batch["mine"].to_pylist(), batch["before"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("host", "path", "page_id", "key")), pa.array(starts, pa.int32())], names=["host", "path", "page_id", "key", "starts"])


DECIDED = pa.schema([("host", pa.string()), ("key", pa.binary()), ("keep", pa.list_(pa.int32())), ("run", pa.int64()), ("partners", pa.list_(pa.binary()))])


def _decide(rows: pa.Table) -> pa.Table:
    """Of a block's own pages those that lose a line, with the places of the lines that stay, and those that stand for versions, with their partners."""
    rows = rows.sort_by("rank")
    hosts, keys, own, runs = (rows[c].to_pylist() for c in ("host", "key", "own", "run"))
    raw, inside = rows["marks"].to_pylist(), rows["inside"].to_pylist()
    marks = [_split(m) for m in raw]
    out = []
    for i, mine in enumerate(own):
        if not mine:
            continue
        near = [j for s in STEPS for j in (i - s, i + s) if 0 <= j < len(own) and hosts[j] == hosts[i]]
        keep = kept_lines(marks[i], inside[i], [marks[j] for j in near])
        lost = len(keep) < len(main_places(inside[i]))
        if lost or runs[i] is not None:
            out.append({"host": hosts[i], "key": keys[i], "keep": keep if lost else None, "run": runs[i], "partners": None if runs[i] is None else [raw[j] for j in near]})
    return pa.Table.from_pylist(out, schema=DECIDED)


def _decide_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for pages that come with their partners."""
    for batch in batches:
        keeps = [kept_lines(_split(m), i, [_split(x) for x in p]) for m, i, p in zip(*(batch[c].to_pylist() for c in ("marks", "inside", "partners")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["host"], batch["key"], pa.array(keeps, pa.list_(pa.int32()))], names=["host", "key", "keep"])


def _runs(once: DataFrame) -> DataFrame:
    """host, key, run (null unless versions of one page), lead (whether the page is compared itself) of each distinct page.

    A run is a stretch of pages in the order of paths, each alike to the one
    before it. Runs of two pages and more that hold no more than half of the
    host's pages are versions of one page; a larger one is what the host looks
    like, and what its pages share is frame.
    """
    order = ["path", "page_id", "key"]
    pairs = with_next(once.select("host", *order, F.struct("marks", "inside", "sizes").alias("mine")), ["host"], [F.desc(c) for c in order], "mine", "before")
    flags = cut(pairs.mapInArrow(_first_versions, "host string, path string, page_id long, key binary, starts int"), "flags")
    runs = cut(running_sums(flags, ["host"], [F.asc(c) for c in order], "starts", "run"), "runs")
    each = runs.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
    hosts = runs.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    versions = each.where("n > 1").join(broadcast_if_small(hosts), "host").where("2 * n <= of").select("host", "run", F.lit(True).alias("versions"))
    known = runs.join(broadcast_if_small(cut(versions, "versions")), ["host", "run"], "left")
    return known.select("host", "key", F.when(F.col("versions"), F.col("run")).cast("long").alias("run"), (F.col("versions").isNull() | (F.col("starts") == 1)).alias("lead"))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: id, url, text (empty if none), n_chars.

    Pages of a host with the same lines are one page, wherever they stand, and
    return as often as they come. A page's partners are the distinct pages of
    its host STEPS places before and after it in the order of paths (of equal
    paths the smaller id comes first), versions of one page (see _runs) being one;
    their order alone counts, so neither the number of tasks nor of files
    changes a result. A page without another one keeps all lines; one whose
    lines all partners share keeps none, in an article from MARKUP + 1 partners on. Null pages are empty, null urls are one host. Very long
    pages are worked on whole; further columns are ignored, whatever their
    names. An empty table gives an empty one.

    Pages are parsed twice, so that only hashes of lines (16 bytes each) are
    sorted; text meets the pages that lose lines in a join that spreads each
    page's copies.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    named = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"), F.col(html_column).alias("html"))
    marked = named.select("page_id", "host", "path", "html").mapInArrow(_marks, LIGHT)
    once = marked.groupBy("host", "key").agg(F.min(F.struct("path", "page_id")).alias("f"), *(F.first(c).alias(c) for c in ("marks", "inside", "sizes")))
    order = ["host", "path", "page_id", "key"]
    n = partitions(pages.sparkSession)
    once = cut(once.select("host", "f.path", "f.page_id", "key", "marks", "inside", "sizes"), "distinct")
    placed = once.drop("sizes").join(_runs(once), ["host", "key"])
    ordered = placed.where("lead").drop("lead").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # a row per task
    starts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ordered.join(F.broadcast(starts.select("part", "start")), part == F.col("part")).withColumn("rank", F.col("start") + within)
    far, block, place = max(STEPS), F.floor(F.col("rank") / BLOCK_PAGES), F.col("rank") % BLOCK_PAGES
    seen_by = F.array_compact(F.array(block, F.when((place < far) & (block > 0), block - 1), F.when(place >= BLOCK_PAGES - far, block + 1)))
    blocks = ranked.select("rank", "host", "key", "run", "marks", "inside", block.alias("home"), F.explode(seen_by).alias("block")).withColumn("own", F.col("home") == F.col("block")).drop("home")
    decided = cut(blocks.groupBy("block").applyInArrow(_decide, "host string, key binary, keep array<int>, run long, partners array<binary>"), "decided")
    spread = 16
    theirs = decided.where("partners IS NOT NULL").select("host", "run", "partners", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"))
    members = placed.where("NOT lead").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int")).join(theirs, ["host", "run", "salt"])
    others = members.select("host", "key", "marks", "inside", "partners").mapInArrow(_decide_versions, "host string, key binary, keep array<int>")
    keep = cut(decided.where("keep IS NOT NULL").select("host", "key", "keep").unionByName(others), "keep")
    salted = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    whole = named.select("page_id", "url", "host", "html").mapInArrow(_lines, FULL).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(spread)).cast("int"))
    text = F.array_join(F.coalesce(F.transform("keep", lambda k: F.get("lines", k)), F.col("lines")), "\n")
    out = whole.join(salted, ["host", "key", "salt"], "left").select("page_id", "url", text.alias("text"))
    return out.select(F.col("page_id").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars"))
