"""Main content of web pages.

A page becomes an array of blocks (one small parsing step per page, Arrow in and out); everything
after that is column expressions over the array: removal rules, content selectors, the text-density
decision with its neighbour features, image rewriting, reassembly and quality checks. A page's
blocks never leave its row, so the job shuffles nothing and scales with the number of pages.
"""

from __future__ import annotations

import re
from html import escape
from urllib.parse import quote, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.htmlparse import CLOSES_P, DROPPED_TAGS, VOID_TAGS, PageParser
from articleflow.functions.text import collapse_ws, content_hash, source_hash, text_or_empty
from articleflow.functions.urls import IMAGE_PROXY_PREFIX, image_proxy_url
from articleflow.operators.selectors import STEPS, let, matched, page_nodes, removed, selector_steps
from articleflow.operators.sizing import attach, spread

# Tags kept in extracted HTML.
ALLOWED_TAGS = (
    "html body div p a em i b strong span br ul ol li h1 h2 h3 h4 h5 h6 blockquote figure "
    "figcaption img iframe video table thead tbody tr td th pre code sup sub audio source"
).split()

_INLINE = set("a em i b strong span br sup sub code u s small mark abbr cite q time label font".split())

_BLOCK_SQL = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            T.StructField("path", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("inner", T.StringType()),
            T.StructField("link_chars", T.IntegerType()),
            T.StructField("src", T.StringType()),
            T.StructField("number", T.IntegerType()),
        ]
    )
)
_BLOCK_ARROW = pa.list_(
    pa.struct(
        [
            ("tag", pa.string()),
            ("path", pa.string()),
            ("text", pa.string()),
            ("inner", pa.string()),
            ("link_chars", pa.int32()),
            ("src", pa.string()),
            ("number", pa.int32()),
        ]
    )
)


class _Blocks(PageParser):
    """Cuts a page into runs of inline content, each with the path of elements around it.

    A path step reads ``/tag#number{attribute="value"}…`` with values percent-encoded, so that
    selectors can be regular expressions over the path.
    """

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.blocks: list[dict] = []
        self.open: list[tuple[str, str]] = []
        self.count = 0
        self.dropped = 0
        self._fresh()

    def _fresh(self) -> None:
        self.text: list[str] = []
        self.inner: list[str] = []
        self.marks: list[str] = []
        self.link_chars = 0

    def _step(self, tag: str, attrs) -> str:
        self.count += 1
        return f"/{tag}#{self.count}" + "".join(
            f'{{{k}="{quote(v or "", safe=" _-.:,;()")}"}}' for k, v in attrs
        )

    def _path(self) -> str:
        return "".join(step for _, step in self.open)

    def _number(self) -> int:
        tag, step = self.open[-1] if self.open else ("", "/#0")
        return int(step[len(tag) + 2 :].split("{", 1)[0])

    def _block_tag(self) -> str:
        return next((t for t, _ in reversed(self.open) if t not in _INLINE), "div")

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.inner.extend(f"</{t}>" for t in reversed(self.marks))
        if text:
            self.blocks.append(
                {
                    "tag": self._block_tag(),
                    "path": self._path(),
                    "text": text,
                    "inner": "".join(self.inner).strip(),
                    "link_chars": self.link_chars,
                    "src": None,
                    "number": self._number(),
                }
            )
        self._fresh()

    def _close_to(self, index: int) -> None:
        if any(t not in _INLINE for t, _ in self.open[index:]):
            self._flush()
        del self.open[index:]

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.dropped += 1
            return
        if tag == "img":
            self._flush()
            at = dict(attrs)
            src = (at.get("src") or "").strip()
            if src and not src.startswith(("data:", IMAGE_PROXY_PREFIX.split("?")[0])):
                try:
                    src = urljoin(self.base, src)
                except ValueError:
                    pass
            alt = at.get("alt") or ""
            path = self._path() + self._step(tag, attrs)
            self.blocks.append(
                {"tag": "img", "path": path, "text": "", "inner": escape(alt), "link_chars": 0, "src": src, "number": self.count}
            )
            return
        if tag in _INLINE:
            if tag in ALLOWED_TAGS:
                shown = [(k, v) for k, v in attrs if k in ("href", "title")]
                self.inner.append(
                    f"<{tag}" + "".join(f' {k}="{escape(v or "")}"' for k, v in shown) + ">"
                )
                if tag != "br":
                    self.marks.append(tag)
            if tag == "br":
                self.text.append("\n")
                return
            self.open.append((tag, self._step(tag, attrs)))
            return
        self._flush()
        if tag in CLOSES_P and self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in VOID_TAGS:
            self.open.append((tag, self._step(tag, attrs)))

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.dropped = max(0, self.dropped - 1)
            return
        index = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if index is None:
            return
        if tag in self.marks:
            while self.marks:
                top = self.marks.pop()
                self.inner.append(f"</{top}>")
                if top == tag:
                    break
        self._close_to(index)

    def handle_data(self, data):
        if self.dropped:
            return
        self.text.append(data)
        self.inner.append(escape(data, quote=False))
        if any(t == "a" for t, _ in self.open):
            self.link_chars += len(" ".join(data.split()))

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        return self.blocks


@F.arrow_udf(_BLOCK_SQL)
def _page_blocks(html: pa.Array, url: pa.Array) -> pa.Array:
    out = []
    for body, base in zip(html.to_pylist(), url.to_pylist()):
        if body is None:
            out.append(None)
            continue
        parser = _Blocks(base or "")
        parser.feed(body)
        out.append(parser.finish())
    return pa.array(out, type=_BLOCK_ARROW)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Pages (url, html, …) with an array of blocks in place of the HTML."""
    return pages.withColumn("blocks", _page_blocks(F.col("html"), F.col("url")))


# --- selectors -----------------------------------------------------------------------------

_XPATH_STEP = re.compile(r"(//?)([\w*-]+)((?:\[[^\[\]]*\])*)")
_PREDICATE = re.compile(
    r"""\[\s*(?:@([\w-]+)\s*=\s*(?:'([^']*)'|"([^"]*)")
        |contains\(\s*@([\w-]+)\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)
        |@([\w-]+))\s*\]""",
    re.X,
)


def _encoded(value: str) -> str:
    return re.escape(quote(value, safe=" _-.:,;()"))


def xpath_pattern(xpath: str | None) -> str | None:
    """Regular expression over block paths for a selector; None for what it cannot express.

    Understood are child and descendant steps with ``@a``, ``@a='v'`` and ``contains(@a,'v')``.
    """
    if not xpath or not xpath.strip():
        return None
    text, pos, pattern = xpath.strip(), 0, ""
    while pos < len(text):
        step = _XPATH_STEP.match(text, pos)
        if not step:
            return None
        axis, tag, predicates = step.groups()
        looks = ""
        at = 0
        while at < len(predicates):
            p = _PREDICATE.match(predicates, at)
            if not p:
                return None
            eq, v1, v2, part, c1, c2, has = p.groups()
            if eq:
                looks += rf'(?=[^/]*\{{{eq}="{_encoded(v1 if v1 is not None else v2)}"\}})'
            elif part:
                looks += rf'(?=[^/]*\{{{part}="[^"]*{_encoded(c1 if c1 is not None else c2)}[^"]*"\}})'
            else:
                looks += rf'(?=[^/]*\{{{has}=")'
            at = p.end()
        name = "[^/#]+" if tag == "*" else re.escape(tag)
        pattern += ("(?:/[^/]+)*?" if axis == "//" else "") + rf"/{name}#{looks}[^/]*"
        pos = step.end()
    return f"^({pattern})(?:/|$)"


def glob_pattern(glob: str) -> str:
    """Regular expression over block paths for a tag glob."""
    body = re.escape(glob).replace(r"\*", "[^/#]*").replace(r"\?", "[^/#]")
    return rf"/{body}#"


# Elements removed on every page: asides, navigation and sidebars.
_UNIVERSAL = (
    r'/(?:aside|nav)#|\{class="[^"]*sidebar-widget|'
    r'\{class="(?:[^"]*(?: |%0A|%09))?sidebar(?:(?: |%0A|%09)[^"]*)?"\}|\{role="complementary"\}'
)

# The same elements as selectors, for pages whose own selector counts places.
_UNIVERSAL_SELECTORS = (
    "//aside",
    "//nav",
    "//*[contains(@class, 'sidebar-widget')]",
    "//*[contains(concat(' ', normalize-space(@class), ' '), ' sidebar ')]",
    "//*[@role='complementary']",
)

# Elements whose text is never the article's.
_NEVER_CONTENT = r"/(?:title|footer|form|button|select|menu|dialog)#"

COMPILED = (
    "select_pattern string, remove_pattern string, unwrap_tags array<string>, unsupported array<string>, "
    f"select_steps {STEPS}, remove_steps array<{STEPS}>"
)


def compile_rules(config: DataFrame) -> DataFrame:
    """Feed settings to patterns and steps: feed_id and the columns of :data:`COMPILED`.

    A selector that a pattern over paths can express becomes one; others become steps over the page's elements
    (:mod:`articleflow.operators.selectors`). What neither understands is listed in ``unsupported``.
    """

    def compiled(batches):
        for batch in batches:
            rows = []
            for feed_id, rules in zip(batch["feed_id"], batch["extract_rules"]):
                rules = rules or {}
                select = rules.get("content_xpath")
                pattern = xpath_pattern(select)
                steps = selector_steps(select) if pattern is None else None
                bad = [select] if select and select.strip() and pattern is None and steps is None else []
                removes = [glob_pattern(g) for g in _items(rules.get("remove_tags"))]
                remove_steps = []
                for xpath in _items(rules.get("remove_xpath")):
                    path = xpath_pattern(xpath)
                    counted = selector_steps(xpath) if path is None or steps is not None else None
                    if path is None and counted is None:
                        bad.append(xpath)
                    if path is not None:
                        removes.append(path)
                    if counted is not None:
                        remove_steps.append(counted)
                if steps is not None:
                    remove_steps.extend(selector_steps(x) for x in _UNIVERSAL_SELECTORS)
                rows.append(
                    (
                        feed_id,
                        pattern,
                        "|".join(f"(?:{r})" for r in removes) or None,
                        _items(rules.get("unwrap_tags")),
                        bad,
                        steps,
                        remove_steps,
                    )
                )
            yield pd.DataFrame(
                rows,
                columns=[
                    "feed_id", "select_pattern", "remove_pattern", "unwrap_tags", "unsupported", "select_steps", "remove_steps",
                ],
            )

    return config.select("feed_id", "extract_rules").mapInPandas(
        compiled, f"feed_id bigint, {COMPILED}"
    )


def _items(values) -> list[str]:
    return [] if values is None else list(values)


# --- rules and scoring over the block array --------------------------------------------------


def _without_removed(blocks: Column, remove: Column) -> Column:
    # Patterns never match empty text. Extraction keeps the last compiled pattern, a match test
    # against a column would compile it per block.
    own = F.coalesce(remove, F.lit("(?!)"))

    def hit(b: Column) -> Column:
        return F.length(F.call_function("regexp_extract", b["path"], own, F.lit(0))) > 0

    return F.filter(blocks, lambda b: ~F.rlike(b["path"], F.lit(_UNIVERSAL)) & ~hit(b))


def _unwrapped(blocks: Column, tags: Column) -> Column:
    """Blocks whose paths lack the given elements; the blocks themselves stay."""
    names = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), "|")
    pattern = F.when(F.length(names) > 0, F.concat(F.lit("/(?:"), names, F.lit(")#[^/]*"))).otherwise(
        F.lit("(?!)")
    )
    return F.transform(
        blocks, lambda b: b.withField("path", F.regexp_replace(b["path"], pattern, F.lit("")))
    )


def _words(b: Column) -> Column:
    return F.when(F.length(b["text"]) > 0, F.size(F.split(b["text"], " "))).otherwise(F.lit(0))


def _link_density(b: Column) -> Column:
    return F.least(
        F.lit(1.0), F.coalesce(F.try_divide(b["link_chars"], F.length(b["text"])), F.lit(0.0))
    )


def _measured(blocks: Column) -> Column:
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["tag"].alias("tag"),
            b["path"].alias("path"),
            b["text"].alias("text"),
            b["inner"].alias("inner"),
            b["src"].alias("src"),
            b["number"].alias("number"),
            _words(b).alias("words"),
            _link_density(b).alias("density"),
        ),
    )


def _judged(blocks: Column) -> Column:
    """Blocks with the decision ``content``: the published decision tree over word counts and link density
    of a block and its neighbours, looking past an image. Images follow the block before them;
    headings need fewer words.
    """

    def decide(b: Column, i: Column) -> Column:
        def beside(step: int) -> Column:
            near = F.get(blocks, i + step)
            return F.when(near["tag"] == "img", F.get(blocks, i + 2 * step)).otherwise(near)

        prev, nxt = beside(-1), beside(1)
        prev_density = F.coalesce(prev["density"], F.lit(0.0))
        prev_words = F.coalesce(prev["words"], F.lit(0))
        next_words = F.coalesce(nxt["words"], F.lit(0))
        after_text = (
            (b["words"] > 16) | (next_words > 15) | (prev_words > 4)
        )
        after_links = (b["words"] > 40) | (next_words > 17)
        text = (b["density"] <= 0.333333) & F.when(prev_density <= 0.555556, after_text).otherwise(
            after_links
        )
        heading = F.rlike(b["tag"], F.lit("^h[1-6]$")) & (next_words > 4)
        return F.when(b["tag"] == "img", prev_words > 16).otherwise(text | heading)

    return F.transform(blocks, lambda b, i: b.withField("content", decide(b, i)))


def _image(b: Column) -> Column:
    keep = (
        (text_or_empty(b["src"]) == "")
        | F.startswith(b["src"], F.lit("data:"))
        | F.startswith(b["src"], F.lit(IMAGE_PROXY_PREFIX.split("?")[0]))
    )
    src = F.when(keep, text_or_empty(b["src"])).otherwise(image_proxy_url(b["src"]))
    return F.concat(F.lit('<img src="'), src, F.lit('" alt="'), b["inner"], F.lit('">'))


def _plain_image(b: Column) -> Column:
    return F.concat(F.lit('<img src="'), text_or_empty(b["src"]), F.lit('" alt="'), b["inner"], F.lit('">'))


def _as_html(blocks: Column, proxy_images: bool) -> Column:
    allowed = F.array(*[F.lit(t) for t in ALLOWED_TAGS])

    def one(b: Column) -> Column:
        tag = F.when(F.array_contains(allowed, b["tag"]), b["tag"]).otherwise(F.lit("div"))
        tag = F.when(b["tag"].isin("html", "body"), F.lit("div")).otherwise(tag)
        wrapped = F.concat(
            F.lit("<"), tag, F.lit(">"), b["inner"], F.lit("</"), tag, F.lit(">")
        )
        return F.when(b["tag"] == "img", _image(b) if proxy_images else _plain_image(b)).otherwise(wrapped)

    return F.array_join(F.transform(blocks, one), "")


def _as_text(blocks: Column) -> Column:
    return F.array_join(
        F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: F.length(t) > 0), "\n"
    )


def _first_match(blocks: Column, pattern: Column) -> Column:
    """Path of the first element the selector matches; null without selector or match."""
    matches = F.transform(
        blocks, lambda b: F.call_function("regexp_extract", b["path"], pattern, F.lit(1))
    )
    return F.get(F.filter(matches, lambda p: F.length(p) > 0), F.lit(0))


def _inside(blocks: Column, root: Column) -> Column:
    """Blocks of one element; none for a null path."""
    below = F.concat(root, F.lit("/"))
    return F.filter(
        blocks,
        lambda b: F.coalesce((b["path"] == root) | F.startswith(b["path"], below), F.lit(False)),
    )


def _flag(flags: Column, i: Column) -> Column:
    return F.coalesce(F.get(flags, i), F.lit(False))


def _picked_by_steps(blocks: Column, page: Column, gone: Column, steps: Column) -> Column:
    """Blocks of the first element the steps pick; none where they pick nothing."""

    def inside(on: Column) -> Column:
        root = F.get(F.filter(page["nodes"], lambda n: _flag(on, n["number"])), F.lit(0))
        return let(
            root,
            lambda r: F.filter(
                blocks, lambda b: F.coalesce((b["number"] >= r["number"]) & (b["number"] <= r["last"]), F.lit(False))
            ),
        )

    return let(matched(page, steps, gone), inside)


def quality(text: Column, html_text: Column) -> tuple[Column, Column]:
    """(too_short, missed_start) of extracted HTML against the extracted text."""
    too_short = F.length(html_text) < F.length(text) * 0.4
    start = collapse_ws(F.substring(text, 1, 100))
    missed = (F.length(start) > 0) & ~F.contains(collapse_ws(html_text), start)
    return too_short, missed


def extract_articles(
    pages: DataFrame,
    config: DataFrame | None = None,
    known: DataFrame | None = None,
    proxy_images: bool = True,
    selected: bool = False,
) -> DataFrame:
    """Text, HTML and content hash of each page, with the outcome of the quality checks.

    ``pages``: url, html and optionally feed_id and source_hash. ``config``: compiled rules (see
    :func:`compile_rules`). ``known``: (url, source_hash) already extracted; those pages are left
    out before any parsing. Pages without content come back with nulls. ``selected`` adds the text of what
    the page's own selector picks, used or not, as selected_text.
    """
    if "source_hash" not in pages.columns:
        pages = pages.withColumn("source_hash", source_hash(F.col("html")))
    if known is not None:
        pages = pages.join(known.select("url", "source_hash"), ["url", "source_hash"], "left_anti")
    pages = spread(pages)
    if config is not None:
        pages = attach(pages, config, "feed_id")
    else:
        pages = pages.withColumns(
            {
                "select_pattern": F.lit(None).cast("string"),
                "remove_pattern": F.lit(None).cast("string"),
                "unwrap_tags": F.lit(None).cast("array<string>"),
                "unsupported": F.array().cast("array<string>"),
                "select_steps": F.lit(None).cast(STEPS),
                "remove_steps": F.lit(None).cast(f"array<{STEPS}>"),
            }
        )
    df = page_blocks(pages)
    page, by_steps = F.col("_page"), F.col("select_steps").isNotNull()
    if config is None:
        df = df.drop("html")
    else:
        needed = by_steps | (F.size("remove_steps") > 0)
        df = df.withColumn("_page", page_nodes(F.when(needed, F.col("html")))).drop("html")
        df = df.withColumn("_gone", removed(page, F.col("remove_steps")))
        left = let(F.col("_gone"), lambda g: F.filter("blocks", lambda b: ~_flag(g, b["number"])))
        df = df.withColumn("blocks", F.when(page.isNotNull(), left).otherwise(F.col("blocks")))
    df = df.withColumn(
        "blocks",
        _measured(
            _without_removed(_unwrapped(F.col("blocks"), F.col("unwrap_tags")), F.col("remove_pattern"))
        ),
    )
    df = df.withColumn(
        "scored", F.filter("blocks", lambda b: ~F.rlike(b["path"], F.lit(_NEVER_CONTENT)))
    )
    df = df.withColumn("chosen", F.filter(_judged(F.col("scored")), lambda b: b["content"]))
    df = df.withColumn("root", _first_match(F.col("blocks"), F.col("select_pattern")))
    picked = _inside(F.col("blocks"), F.col("root"))
    if config is not None:
        steps = _picked_by_steps(F.col("blocks"), page, F.col("_gone"), F.col("select_steps"))
        picked = F.when(by_steps, steps).otherwise(picked)
    df = df.withColumn("picked", picked)
    picked = F.transform("picked", lambda b: b.withField("content", F.lit(True)))
    body = F.when(F.size("picked") > 0, picked).otherwise(F.col("chosen"))
    df = df.withColumns({"content_text": _as_text(F.col("chosen")), "body": body})
    df = df.withColumn("html_text", _as_text(F.col("body")))
    too_short, missed = quality(F.col("content_text"), F.col("html_text"))
    df = df.withColumns({"too_short": too_short, "missed_start": missed})
    fall_back = F.col("too_short") | F.col("missed_start")
    shown = F.when(fall_back, F.col("chosen")).otherwise(F.col("body"))
    df = df.withColumn("content_html", _as_html(shown, proxy_images))
    nothing = (F.length("content_text") == 0) & (F.length("content_html") == 0)
    extracted = F.coalesce(~nothing, F.lit(False))
    rules = ("select_pattern", "remove_pattern", "unwrap_tags", "unsupported", "select_steps", "remove_steps")
    carried = [c for c in pages.columns if c not in ("html", *rules)]
    return df.select(
        *carried,
        extracted.alias("fetched"),
        F.size("blocks").alias("block_count"),
        "too_short",
        "missed_start",
        F.when(extracted, F.col("content_text")).alias("content_text"),
        F.when(extracted, F.col("content_html")).alias("content_html"),
        F.when(extracted, content_hash(F.col("content_text"), F.col("content_html"))).alias("content_hash"),
        "unsupported",
        *([_as_text(F.col("picked")).alias("selected_text")] if selected else []),
    )
