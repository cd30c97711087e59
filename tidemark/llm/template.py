"""Main text of web pages by equivalence-class template deduction.

Tokens are tags and text, told apart by the path of elements they stand in: a run of up to RUN_WORDS words between two tags is
taken word by word, a longer one as a whole. Over the pages of a host, tokens with the same
occurrence vector (count on every page) form an equivalence class; large and frequent classes whose tokens keep one order are
the template, nested by the elements that enclose them. What varies between template tokens are slots. The main slot is the
innermost template element that holds all varying words outside boilerplate; its text is taken block by block.

An occurrence vector is never gathered: pages add up, by exclusive or, a hash of (page, count) for each token, so equal vectors
have equal sums and partial sums of any partitions combine. Hosts of few pages share one template deduced over all of them.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, mixed

#: A host with fewer pages is served by the common template.
MIN_PAGES = 3
#: A template token stands on this share of a host's pages at least.
FREQUENT = 0.5
RUN_WORDS = 16
#: Templates up to this many bytes together are sent to every task; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20

# fixed values: names of HTML elements
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mfrac msqrt mroot msub msup msubsup munder mover munderover".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg annotation annotation-xml object title".split())
#: Elements a slash before the end of the start tag closes.
FOREIGN = frozenset("svg annotation annotation-xml".split())
BOILER_TAGS = frozenset("head nav header footer aside form button select dialog menu".split())
NEVER_BOILER = frozenset("html body main article".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply "
    "replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "widget widgets toolbar pagination pager".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SELF_CLOSED = re.compile(r"""(?<!=)(?:\A|["'\s/]|(?:\A|["'\s/])[^\s"'>/=]+)/\Z""")


def attributes_of(inside: str | None) -> dict[str, str]:
    """Attributes of a start tag by whole name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(inside or ""):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def is_boiler(name: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """By the element, its role, or the first word of one of its class names or of its id: 'sidebar-left', not 'with-sidebar'."""
    if name in NEVER_BOILER:
        return False
    if name in BOILER_TAGS and not (name == "header" and inside_article):
        return True
    if "hidden" in attributes or attributes.get("role", "").lower() in BOILER_ROLES:
        return True
    for label in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        head = re.split(r"[-_:.]|(?<=[a-z])(?=[A-Z])", label, maxsplit=1)[0].lower()
        if head in BOILER_WORDS and not (head == "header" and inside_article):
            return True
    return False


class Element:
    """An open structural element: its name, the hash of its path, and whether it is boilerplate or lies in some.

    own: whether it is boilerplate by itself; inner: whether it is or lies in some, marks around an article or main aside.
    """

    __slots__ = ("boiler", "inner", "name", "own", "path")

    def __init__(self, name: str, path: int, above: Element | None = None, own: bool = False):
        self.name, self.path, self.own = name, path, own
        self.boiler = own or (above is not None and above.boiler)
        self.inner = own or (above is not None and above.inner and name not in ("article", "main"))


def walk(page: str | None):
    """Events of a page in order: (kind, stack, value) with kind 'tag' (value: name, '/name' for an end) or 'text'.

    Inline elements and paragraphs are tags but not part of the path, since they are often left open.
    """
    if not page:
        return
    stack = [Element("", 0)]
    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            yield "text", stack, page[at:]
            return
        if found.start() > at:
            yield "text", stack, page[at : found.start()]
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name not in INLINE and name != "p" and any(e.name == name for e in stack):
                while stack[-1].name != name:
                    stack.pop()
                stack.pop()
            yield "tag", stack, "/" + name
            continue
        if name in FOREIGN and SELF_CLOSED.search(found[3]):
            yield "tag", stack, name
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            yield "tag", stack, name
            at = close.end() if close else end
            continue
        if name in INLINE or name in VOID or name == "p":
            yield "tag", stack, name
            continue
        attributes = attributes_of(found[3])
        label = f"{name}.{attributes.get('class', '')}#{attributes.get('id', '')}"
        above = stack[-1]
        own = is_boiler(name, attributes, any(e.name == "article" for e in stack))
        stack.append(Element(name, xxhash.xxh64_intdigest(label.encode(), above.path), above, own))
        yield "tag", stack, name


class Weights:
    """Which marks of a page to believe, by the words of its texts.

    A mark on an element around articles is wrong if it hides more words than all unmarked text has, and no article is unmarked.
    """

    def __init__(self):
        self.plain = self.hidden = self.article = 0

    def add(self, stack: list[Element], words: int) -> None:
        top = stack[-1]
        if not top.boiler:
            self.plain += words
            self.article += words * any(e.name in ("article", "main") for e in stack)
        elif not top.inner:
            self.hidden += words

    @property
    def inner(self) -> bool:
        return not self.article and self.hidden > self.plain


def run_tokens(run: str, path: int) -> list[int]:
    words = run.split()
    if len(words) > RUN_WORDS:
        words = [" ".join(words)]
    return [xxhash.xxh64_intdigest(w.encode(), path) for w in words]


def page_tokens(page: str | None) -> list[int]:
    """Hashes of all tokens of a page, in order: tags and text, with their path."""
    out = []
    for kind, stack, value in walk(page):
        if kind == "tag":
            out.append(xxhash.xxh64_intdigest(value.encode(), stack[-1].path ^ 1))
        else:
            out += run_tokens(value, stack[-1].path)
    return out


def element_token(element: Element) -> int:
    """The token of an element's start tag."""
    return xxhash.xxh64_intdigest(element.name.encode(), element.path ^ 1)


def _token_sums(batches):
    """Per host and token: pages with it, occurrences, exclusive-or of hash(page, count). Token 0 stands for the page itself."""
    import pyarrow as pa

    held: dict[str, list] = defaultdict(list)
    waiting = 0

    def flush():
        hosts, columns = [], []
        for host, parts in held.items():
            token, count, mark = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            token, count, mark = token[order], count[order], mark[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            pages = np.diff(np.append(starts, len(token)))
            columns.append((token[starts], pages, np.add.reduceat(count, starts), np.bitwise_xor.reduceat(mark, starts)))
            hosts += [host] * len(starts)
        held.clear()
        if hosts:
            token, pages, count, mark = (np.concatenate(c) for c in zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts), pa.array(token.view(np.int64)), pa.array(pages.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(mark.view(np.int64))],
                ["host", "token", "pages", "n", "mark"],
            )

    for batch in batches:
        for host, url, page in zip(batch["host"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            token, n = np.unique(np.array(page_tokens(page), np.uint64), return_counts=True)
            page_hash = np.uint64(xxhash.xxh64_intdigest((url or "") + "\0" + (page or "")))
            token, n = np.concatenate([[np.uint64(0)], token]), np.concatenate([[1], n])
            held[host].append((token, n, mixed(page_hash + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            waiting += len(token)
        if waiting > 2_000_000:
            yield from flush()
            waiting = 0
    yield from flush()


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def template_tokens(pages: DataFrame) -> DataFrame:
    """site, token, mark, pages, n: tokens on at least FREQUENT of the pages of a site. mark names the equivalence class.

    A site is a host, or '*' for all hosts of fewer than MIN_PAGES pages. Null urls count as host ''.
    """
    sums = cut_lineage(
        pages.select(host_of(F.col("url")).alias("host"), "url", "html")
        .mapInArrow(_token_sums, "host string, token bigint, pages bigint, n bigint, mark bigint")
        .groupBy("host", "token")
        .agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.expr("bit_xor(mark)").alias("mark"))
    )
    counted = sums.where("token = 0")
    hosts = counted.select("host", F.when(F.col("pages") >= MIN_PAGES, F.col("host")).otherwise("*").alias("site"))
    sites = hosts.join(counted.select("host", "pages"), "host").groupBy("site").agg(F.sum("pages").alias("of"))
    # tokens of one page of a large host cannot be frequent; they need not travel
    merged = (
        sums.where("token <> 0").join(hosts, "host")
        .groupBy("site", "token").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.expr("bit_xor(mark)").alias("mark"))
    )
    return merged.join(sites, "site").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= FREQUENT * F.col("of")))


def _with_site(pages: DataFrame, per_site: DataFrame, column: str) -> DataFrame:
    """``pages`` with the blob of their host's site, or of '*' where the host has none."""
    spark = pages.sparkSession
    size = per_site.agg(F.sum(F.length(column))).first()[0] or 0
    common = [bytes(r[column]) for r in per_site.where("site = '*'").select(column).collect()]
    per_host = per_site.where("site <> '*'").withColumnRenamed("site", "__site")
    if size <= BROADCAST_BYTES:
        per_host = F.broadcast(per_host)
    joined = pages.withColumn("__host", host_of(F.col("url"))).join(per_host, F.col("__host") == F.col("__site"), "left")
    other = spark.createDataFrame([(bytearray(common[0]) if common else None,)], f"{column} binary").first()[0]
    return joined.withColumn(column, F.coalesce(column, F.lit(bytes(other)) if other is not None else F.lit(None).cast("binary")))


_PAIR = np.dtype([("token", np.uint64), ("mark", np.uint64)])


def _pairs_of(rows: DataFrame) -> DataFrame:
    """Tokens and class marks of each site as one blob, sorted by token."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            blobs = []
            for pairs in batch["pairs"].to_pylist():
                own = np.array([(p["token"] & 0xFFFFFFFFFFFFFFFF, p["mark"] & 0xFFFFFFFFFFFFFFFF) for p in pairs], _PAIR)
                blobs.append(np.sort(own, order="token").tobytes())
            yield pa.RecordBatch.from_arrays([batch["site"], pa.array(blobs, pa.binary())], ["site", "template"])

    return rows.groupBy("site").agg(F.collect_list(F.struct("token", "mark")).alias("pairs")).mapInArrow(pack, "site string, template binary")


class Memo(dict):
    """Blobs read by pages of a task, decoded once each."""

    def __init__(self, decode):
        super().__init__()
        self.decode = decode

    def __missing__(self, blob):
        if len(self) > 512:
            self.clear()
        value = self[blob] = self.decode(blob)
        return value


def _decode_pairs(blob: bytes | None):
    pairs = np.frombuffer(blob or b"", _PAIR)
    return pairs["token"], pairs["mark"], set(pairs["token"].tolist())


def _orders_and_words(batches):
    """Per site: how often each class shows each order of its tokens; and the varying words under each template element.

    Element 0 stands for all of them, also those under no template element.
    """
    import pyarrow as pa

    memo = Memo(_decode_pairs)
    orders: dict[tuple, int] = defaultdict(int)
    words: dict[tuple, int] = {}
    for batch in batches:
        for site, blob, page in zip(batch["site"].to_pylist(), batch["template"].to_pylist(), batch["html"].to_pylist(), strict=True):
            tokens, marks, known = memo[blob]
            if not len(tokens):
                continue
            found, weights = [], Weights()
            texts: list[tuple] = []
            for kind, stack, value in walk(page):
                top = stack[-1]
                if kind == "tag":
                    found.append(xxhash.xxh64_intdigest(value.encode(), top.path ^ 1))
                    continue
                own = run_tokens(value, top.path)
                found += own
                varying = sum(t not in known for t in own) if len(own) != 1 else (own[0] not in known) * len(value.split())
                weights.add(stack, len(value.split()))
                if varying and not top.inner:
                    texts.append((varying, top.boiler, [t for e in stack[1:] if (t := element_token(e)) in known]))
            for varying, boiler, chain in texts:
                if boiler and not weights.inner:
                    continue
                for above, token in zip([0, 0, *chain], [0, *chain], strict=False):
                    key = (site, token, above)
                    words[key] = words.get(key, 0) + varying
            every = np.array(found, np.uint64)
            at = np.minimum(np.searchsorted(tokens, every), len(tokens) - 1)
            inside = tokens[at] == every
            every, mark = every[inside], marks[at[inside]]
            order = np.argsort(mark, kind="stable")
            every, mark = every[order], mark[order]
            for own in np.split(every, np.flatnonzero(mark[1:] != mark[:-1]) + 1) if len(every) else ():
                period = len(np.unique(own))
                runs = own.reshape(-1, period) if len(own) % period == 0 else None
                regular = runs is not None and bool((runs == runs[0]).all())
                digest = xxhash.xxh64_intdigest(own[:period].tobytes()) if regular else 0
                place = int(np.searchsorted(tokens, own[0]))
                orders[(site, int(marks[place]), digest)] += 1
    rows = [(s, "order", m, d, n) for (s, m, d), n in orders.items()] + [(s, "words", t, a, n) for (s, t, a), n in words.items()]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([signed(r[2]) for r in rows]), pa.array([signed(r[3]) for r in rows]), pa.array([r[4] for r in rows])],
            ["site", "kind", "x", "y", "n"],
        )


def choose(site_rows: list[dict], of_class: dict[int, int]) -> int:
    """The token of the main element of a site (0: none): descend from the top while one child in a valid class holds all words.

    What lies outside it is then template text or boilerplate on every page, so no slot is left behind.
    A class is valid if its tokens keep one order on at least nine tenths of the pages where they occur.
    """
    seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
    below: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in site_rows:
        if r["kind"] == "order":
            seen[r["x"]].append((r["n"], r["y"]))
        else:
            below[r["y"]].append((r["n"], r["x"]))
    valid = {m for m, found in seen.items() if 10 * max((n for n, y in found if y), default=0) >= 9 * sum(n for n, _ in found)}
    at, every = 0, sum(n for n, t in below[0] if not t)
    while children := [(n, t) for n, t in below[at] if t and of_class.get(t) in valid]:
        n, token = max(children)
        if n < every:
            break
        at = token
    return at


def _choose_all(batches):
    """Rows sorted by site to one row per site."""
    import pyarrow as pa

    def one(site, rows):
        of_class = {r["x"]: r["y"] for r in rows if r["kind"] == "class"}
        token = choose([r for r in rows if r["kind"] != "class"], of_class)
        return pa.RecordBatch.from_arrays([pa.array([site]), pa.array([(token & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")], pa.binary())], ["site", "main"])

    site, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["site"] != site:
                yield one(site, rows)
                rows = []
            site = r["site"]
            rows.append(r)
    if rows:
        yield one(site, rows)


def main_elements(pages: DataFrame) -> DataFrame:
    """site, main: the token of the element that holds the main text of each site's pages, as 8 bytes (0: none found)."""
    frequent = cut_lineage(template_tokens(pages.select("url", "html")))
    marked = _with_site(pages.select("url", "html"), cut_lineage(_pairs_of(frequent)), "template")
    seen = (
        marked.select(F.coalesce("__site", F.lit("*")).alias("site"), "template", "html")
        .where("template IS NOT NULL")
        .mapInArrow(_orders_and_words, "site string, kind string, x bigint, y bigint, n bigint")
        .groupBy("site", "kind", "x", "y").agg(F.sum("n").alias("n"))
    )
    classes = frequent.select("site", F.lit("class").alias("kind"), F.col("token").alias("x"), F.col("mark").alias("y"), F.lit(1).cast("bigint").alias("n"))
    return seen.unionAll(classes).repartition("site").sortWithinPartitions("site").mapInArrow(_choose_all, "site string, main binary")


def block_text(page: str | None, main: int = 0) -> str:
    """Text of the main element without boilerplate, blocks joined by one space. Marks around the main element do not count.

    Without a main element on the page: of its article or main elements, else of the whole page. If all text is marked as
    boilerplate, the marks are not believed.
    """
    best = {"main": [], "article": [], "all": [], "inner main": [], "inner article": [], "inner all": [], "marked": []}
    weights = Weights()
    for kind, stack, value in walk(page):
        top = stack[-1]
        if kind == "tag":
            if value.lstrip("/") not in INLINE:
                for parts in best.values():
                    parts.append(" ")
            continue
        text = entities.unescape(value)
        weights.add(stack, len(value.split()))
        article = any(e.name in ("article", "main") for e in stack)
        at = next((i for i, e in enumerate(stack) if i and element_token(e) == main), 0) if main else 0
        below = at and any(e.own for e in stack[at + 1 :])
        best["marked"].append(text)
        for kind, marked, around in (("", top.boiler, stack[at].boiler), ("inner ", top.inner, stack[at].inner)):
            if at and not (below if around else marked):
                best[f"{kind}main"].append(text)
            if not marked:
                best[f"{kind}all"].append(text)
                if article:
                    best[f"{kind}article"].append(text)
    if weights.inner:
        best |= {name: best[f"inner {name}"] for name in ("main", "article", "all")}
    for name in ("main", "article", "all", "marked"):
        if text := " ".join("".join(best[name]).split()):
            return text
    return ""


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [
            block_text(page, int.from_bytes(main, "little") if main else 0)
            for page, main in zip(batch["html"].to_pylist(), batch["main"].to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty page has the empty text. Null urls are one host. Repeated rows are pages of their own. Copies of one page are
    not enough for a template of content: within the main element all text is kept, constant or not.
    """
    own = pages.select("page_id", "url", "html")
    marked = _with_site(own, cut_lineage(main_elements(own)), "main")
    kind = pages.schema["page_id"].dataType.simpleString()
    return marked.select("page_id", "url", "html", "main").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
