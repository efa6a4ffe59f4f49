"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, named by their path, and its text blocks, named by path and wording. Over the
different pages of a host each token has an occurrence vector; tokens with equal vectors form a class. A class is
valid if it holds an element, if its tokens keep one order on all its pages, and if it nests: all that it hangs on
outside itself belongs to one other class. The class of the root is the frame; from there valid classes hang on
valid ones, level by level, and that tree is the host's template. What it does not fix are slots.

The template says which slot is the article: a marked element (article, main) in the frame. Other marked elements of
such a host, like the cards of related articles, go. Text inside a marked article is never taken for template text.
Where a page marks no article, text blocks in the template go and the rest stays. Parts that HTML itself, a role or
a whole class name calls a menu, notice, advert, form, comment or the like are no slots of the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_tables, materialize, salted
from tessera.llm.url_filter import host_of

#: A class needs so many of the host's different pages, as a share and at least.
SHARE, FLOOR = 0.5, 3

#: Remembered start tags of a task.
CACHE = 50_000

TOKENS = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|</[^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTES = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Fixed values of HTML: elements without an end, elements whose content is not markup, elements within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements that a new one of the first kind closes, up to an enclosing one that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"})}
CLOSES |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_ENDS_AT = frozenset("article aside blockquote body button caption details div dd dt fieldset figure footer form header html li main nav section table td th".split())

PROSE_TAGS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())

#: Names of parts that are not the article.
BOILERPLATE_TAGS = frozenset("aside button canvas dialog fieldset footer form head input legend menu nav noscript object script select style svg template textarea title iframe".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Last words of class names and ids, but for neutral ones.
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertisements advertising adverts alert aside banner breadcrumb breadcrumbs byline comment commentlist "
    "comments consent cookie cookies copyright dialog disqus feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination paywall popup promo promotion related reply replies respond responses search share sharing "
    "sidebar signup sponsor sponsored subscribe tagcloud teaser toolbar widget widgets".split()
)
NEUTRAL_WORDS = frozenset(
    "area bar bottom box button buttons col column container global group icons inner item items left link links list main outer panel posts primary right "
    "row secondary section site slot thread top unit wrap wrapper".split()
)
LINKING_WORDS = frozenset("for free has have hide in is no non not on show with without".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies response responses".split())
ARTICLE_WORDS = frozenset({"articlebody"})
MAIN, BOILER, LINK, PROSE = 1, 2, 4, 8
#: Kinds of tokens.
ELEMENT, TEXT, MARKED = 0, 1, 2


def names_boilerplate(names: list[str]) -> bool:
    """Whether a class name or id says that a part is no article: what a compound ends in names the part.

    `cookie-notice` and `post-share` do, `ad-slot` as well, since `slot` says nothing; `social-science` does not, nor
    does `content-with-sidebar`, which names what there is beside it.
    """
    for name in names:
        parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name) if not w.isdigit()]
        said = [w for w in parts if w not in NEUTRAL_WORDS]
        if said and said[-1] in BOILERPLATE_WORDS and not any(w in LINKING_WORDS for w in parts):
            return True
    return False


class Parser:
    """Blocks and tokens of pages; remembers start tags it has seen."""

    def __init__(self) -> None:
        self.tags: dict[tuple[str, str], tuple[str, int]] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def tag(self, name: str, attrs: str) -> tuple[str, int]:
        """The token name of an element (tag, classes and id without digits) and what it says of its content."""
        known = self.tags.get((name, attrs))
        if known is not None:
            return known
        found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTES.finditer(attrs)} if attrs.strip() else {}
        label = re.sub(r"\d+", "", " ".join(found.get(k, "") for k in ("class", "id") if k in found)).lower()
        names = [x for c in ("class", "id") for x in found.get(c, "").split()]
        boiler = names_boilerplate(names)
        role = found.get("role", "").lower()
        kind = 0
        if name in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            kind |= BOILER
        elif name in ("article", "main"):
            kind |= BOILER if any(x.lower() in COMMENT_WORDS for x in names) or (name == "article" and boiler) else MAIN
        elif name not in ("html", "body") and boiler:
            kind |= BOILER
        elif role in ("main", "article") or found.get("itemprop", "").lower() in ARTICLE_WORDS:
            kind |= MAIN
        if name == "a":
            kind |= LINK
        if name in PROSE_TAGS:
            kind |= PROSE
        if len(self.tags) >= CACHE:
            self.tags.clear()
        self.tags[name, attrs] = (f"{name}.{label}" if label else name), kind
        return self.tags[name, attrs]

    def path(self, parent: int, name: str) -> int:
        known = self.paths.get((parent, name))
        if known is None:
            if len(self.paths) >= CACHE:
                self.paths.clear()
            known = self.paths[parent, name] = xxhash.xxh64_intdigest(f"{parent}/{name}".encode("utf-8", "surrogatepass")) >> 1
        return known

    def parse(self, page: str) -> tuple[list[tuple[str, int, int, int]], dict[tuple[int, int], list[int]]]:
        """Blocks (text, token, kind, outermost marked element around) in page order; and of each (kind of token, token)
        how often it occurs, where first, and in which element."""
        blocks: list[tuple[str, int, int, int]] = []
        tokens: dict[tuple[int, int], list[int]] = {(ELEMENT, 0): [1, 0, 0]}
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, path, kind with that of all around, outermost marked element
        held: list[str] = []
        linked = [True]
        where = [(0, 0, 0)]

        def note(kind: int, token: int, parent: int) -> None:
            seen = tokens.get((kind, token))
            if seen is None:
                tokens[kind, token] = [1, len(tokens), parent]
            else:
                seen[0] += 1

        def flush() -> None:
            text = " ".join("".join(held).split())
            if text:
                path, kind, marked = where[0]
                token = xxhash.xxh64_intdigest(f"{path}|{text}".encode("utf-8", "surrogatepass")) >> 1
                blocks.append((text, token, kind & ~LINK | (LINK if linked[0] else 0), marked))
                if not kind & (BOILER | MAIN):
                    note(TEXT, token, path)
            held.clear()
            linked[0] = True

        def say(raw: str) -> None:
            text = entities.unescape(raw) if "&" in raw else raw
            if not text.isspace():
                if linked[0] and not any(x.strip() for x in held):
                    # the block belongs to the innermost element that is not part of a line
                    around = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
                    where[0] = (around[1], stack[-1][2], stack[-1][3])
                linked[0] = linked[0] and bool(stack[-1][2] & LINK)
            held.append(text)

        at, size = 0, len(page)
        while at < size:
            m = TOKENS.match(page, at)
            if m is None:
                break
            at = m.end()
            if m["text"] is not None:
                say(m["text"])
                continue
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["close"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    if any(e[0] not in INLINE for e in stack[depth:]) or any(e[2] & BOILER > stack[depth - 1][2] & BOILER for e in stack[depth:]):
                        flush()
                    del stack[depth:]
                elif name not in INLINE:
                    flush()
                continue
            label, kind = self.tag(name, m["attrs"])
            if name == "header" and not any(e[0] == "article" for e in stack):
                kind |= BOILER
            if name not in INLINE or kind & BOILER:
                flush()
            if name not in INLINE and name not in VOID and name not in RAW:
                ends, holders = CLOSES.get(name, ({"p"}, P_ENDS_AT))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in holders:
                        break
            parent, inherited, marked = stack[-1][1:]
            path = self.path(parent, label)
            if kind & MAIN and not marked and not (kind | inherited) & BOILER:
                marked = path
            note(MARKED if marked == path else ELEMENT, path, parent)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            elif name not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append((name, path, inherited | kind, marked))
        flush()
        return blocks, tokens


def slots(blocks: list[tuple[str, int, int, int]]) -> tuple[bool, list[tuple[str, int]]]:
    """Whether a page marks an article, and the blocks that may be its text, each with what the template knows it by:
    the marked element around it, or else the block's own token."""
    open_blocks = [b for b in blocks if not b[2] & BOILER]
    inside = [(b[0], b[3]) for b in open_blocks if b[3]]
    if inside:
        return True, inside
    return False, [(b[0], b[1]) for b in open_blocks if b[2] & PROSE or not b[2] & LINK]


PARSED = (
    "page_id long, url string, host string, page long, marked boolean, texts array<string>, owners array<long>, "
    "kinds array<int>, tokens array<long>, counts array<int>, firsts array<int>, parents array<long>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, host) as PARSED says: blocks with what owns them, and tokens with kind, number, first place and parent."""

    def lists(rows: list[list], kind: pa.DataType) -> pa.Array:
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for r in rows for x in r], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = ["texts", "owners", "kinds", "tokens", "counts", "firsts", "parents"]
        for batch in batches:
            keys, marks, out = [], [], [[] for _ in kinds]
            for html in batch.column(2):
                page = html.as_py() or ""
                blocks, tokens = parser.parse(page)
                marked, kept = slots(blocks)
                keys.append(xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1)
                marks.append(marked)
                listed = [(k, t, n, at, up) for (k, t), (n, at, up) in tokens.items()] if page else []
                for column, values in zip(out, ([b[0] for b in kept], [b[1] for b in kept], *([x[i] for x in listed] for i in range(5)))):
                    column.append(values)
            cols = [batch.column(0), batch.column(1), batch.column(3), pa.array(keys, pa.int64()), pa.array(marks, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [lists(c, k) for c, k in zip(out, kinds)], names=["page_id", "url", "host", "page", "marked", *names])

    return pages.select(F.col("page_id").cast("long"), "url", "html", "host").mapInArrow(run, PARSED)


def templates(pages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(host, token, kind, frame): the tokens of each host's template, for rows of PARSED; frame marks the root's class.
    Also the tables written on the way, to be deleted after use.

    Copies of a page count once, by the hash of their whole html. The occurrence vector of a token is summed up
    as an exclusive or over (page, count), a partial aggregate, so no host's pages meet in one task; order is
    checked page by page, and nesting class by class.
    """
    zipped = pages.select("host", "page", F.explode(F.arrays_zip("kinds", "tokens", "counts", "firsts", "parents")).alias("t"))
    seen = zipped.select("host", "page", F.col("t.tokens").alias("token"), F.col("t.kinds").alias("kind"), F.col("t.counts").alias("n"), F.col("t.firsts").alias("at"), F.col("t.parents").alias("parent"))
    once = seen.groupBy("host", "token", "kind", "page").agg(F.max("n").alias("n"), F.min("at").alias("at"), F.min("parent").alias("parent"))
    vectors = once.groupBy("host", "token", "kind").agg(F.count(F.lit(1)).alias("support"), F.expr("bit_xor(xxhash64(page, n))").alias("vector"), F.min("parent").alias("parent"))
    vectors = materialize(vectors.where(F.col("support") >= FLOOR), "vectors")
    sizes = vectors.where(f"token = 0 and kind = {ELEMENT}").select("host", F.col("support").alias("pages"))
    enough = F.greatest(F.lit(FLOOR), F.ceil(F.col("pages") * SHARE))
    supported = vectors.join(sizes, "host").where(F.col("support") >= enough)
    supported = materialize(supported.select("host", "token", "kind", "parent", F.xxhash64("host", "support", "vector").alias("cls")), "supported")

    told = F.count_if(F.col("kind") != ELEMENT) > 0  # classes of bare elements fix no text and choose no article, but others hang on them
    classes = supported.groupBy("cls").agg(F.count_if(F.col("kind") != TEXT).alias("elements"), told.alias("told"))
    ordered = salted(once.select("host", "token", "kind", "page", "at"), supported.select("host", "token", "kind", "cls"), ["host", "token", "kind"], "page")
    ordered = ordered.groupBy("cls", "page").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("at", "token"))).getField("token")).alias("order"))
    ordered = ordered.groupBy("cls").agg((F.min("order") == F.max("order")).alias("ordered"))
    holders = supported.where(F.col("kind") != TEXT).select("host", F.col("token").alias("parent"), F.col("cls").alias("up"))
    hung = supported.join(holders, ["host", "parent"]).where("cls <> up").groupBy("cls").agg(F.min("up").alias("up"), F.max("up").alias("other"))
    valid = classes.join(ordered, "cls").join(hung, "cls", "left").where("elements > 0 and ordered and (up is null or up = other)")
    valid = materialize(valid.select("cls", "told", "up"), "valid")

    steps = [vectors, supported, valid]
    level = valid.where("up is null")
    nested = level.select("cls", "told", F.lit(True).alias("frame"))
    while not level.isEmpty():
        level = materialize(valid.join(level.select(F.col("cls").alias("up")), "up", "left_semi"), "level")
        steps.append(level)
        nested = nested.union(level.select("cls", "told", F.lit(False)))
    return supported.where(F.col("kind") != ELEMENT).join(nested.where("told"), "cls").select("host", "token", "kind", "frame"), steps


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages; other columns of pages, whatever their names, are not read.

    Null and empty html give the empty text. Rows with equal or null ids and urls stay separate rows; pages
    without a host are taken as one host's. An empty table gives an empty result. Texts of any length are read
    whole; broken markup is read as far as it goes: an unclosed tag or comment at the end holds no text.

    Each page is parsed once. What meets the template are tokens, not texts; only pages that lose blocks to it are
    joined by row.
    """
    rows = parsed(pages.select("page_id", "url", "html", host_of("url").alias("host"))).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "parsed")
    template, steps = templates(rows)
    template = materialize(template, "templates")
    drop_tables(rows.sparkSession, steps)
    owned = rows.select("row", "host", "marked", F.explode(F.array_distinct("owners")).alias("token"))
    # of a marked page, what is in no frame goes if anything is in one; of others, what is in the template
    fixed = template.where(f"(kind = {MARKED} and frame) or kind = {TEXT}").select("host", "token", (F.col("kind") == MARKED).alias("marked"))
    met = salted(owned, fixed.withColumn("met", F.lit(True)), ["host", "token", "marked"], "row", "left")
    lost = F.collect_set(F.when(F.col("marked") != F.coalesce("met", F.lit(False)), F.col("token")))
    changed = met.groupBy("row").agg(lost.alias("lost"), F.count_if(F.col("met")).alias("n")).where("n > 0 and size(lost) > 0").select("row", "lost")
    changed = materialize(changed, "lost")
    joined = rows.join(changed, "row", "left")
    kept = F.filter(F.arrays_zip("texts", "owners"), lambda b: ~F.array_contains(F.coalesce("lost", F.array().cast("array<long>")), b["owners"]))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8(pages: DataFrame) -> DataFrame:
    return extracted(pages)
