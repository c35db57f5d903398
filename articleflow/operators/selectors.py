"""XPath selectors over web pages as expressions on an array of numbered elements.

A page becomes one array of elements in document order. Each carries its number, the number of its last
descendant, its parent, its children and the elements around it, so an axis is a look at a flag by number or
an interval test. A selector is data: an array of steps, folded over the elements by ``aggregate``. Every page
may therefore have selectors of its own, nothing is shuffled, and a step is linear in the elements times their depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from articleflow.functions.htmlparse import CLOSES_P, DROPPED_TAGS, VOID_TAGS, PageParser
from articleflow.operators.sizing import spread

# --- elements -------------------------------------------------------------------------------

_INTS = T.ArrayType(T.IntegerType())
_NODE = (
    T.StructType()
    .add("number", "integer")
    .add("last", "integer")
    .add("parent", "integer")
    .add("tag", "string")
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("kids", _INTS)
    .add("above", _INTS)
    .add("first", "integer")
    .add("stop", "integer")
    .add("own", _INTS)
)
PAGE = T.StructType().add("runs", T.ArrayType(T.StringType())).add("nodes", T.ArrayType(_NODE))

# Elements that a sibling of the same kind ends, and the elements this does not reach beyond.
_ENDED_BY_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_BUTTON_SCOPE = {"#document", "table", "td", "th", "button", "object"}


class _Nodes(PageParser):
    """Numbers the elements of a page as the block parser does; number 0 is the document.

    Elements without content are no nodes, images excepted.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.dropped = 0
        self.in_run = False
        self.open.append(self._add("#document", []))

    def _add(self, tag: str, attrs) -> int:
        number, parent = len(self.nodes), self.open[-1] if self.open else -1
        self.nodes.append(
            {
                "number": number,
                "last": number,
                "parent": parent,
                "tag": tag,
                "attrs": list({k: v or "" for k, v in reversed(attrs)}.items()),
                "kids": [],
                "above": list(self.open),
                "first": len(self.runs),
                "stop": len(self.runs),
                "own": [],
            }
        )
        if parent >= 0:
            self.nodes[parent]["kids"].append(number)
        return number

    def _close_to(self, depth: int) -> None:
        for number in self.open[depth:]:
            self.nodes[number].update(last=len(self.nodes) - 1, stop=len(self.runs))
        del self.open[depth:]

    def _end_open(self, tags: set[str], bounds: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]]["tag"]
            if tag in tags:
                self._close_to(depth)
                return
            if tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        self.in_run = False
        if tag in DROPPED_TAGS:
            self.dropped += 1
            return
        if tag == "img":
            self._add(tag, attrs)
        if tag in VOID_TAGS:
            return
        if tag in CLOSES_P:
            self._end_open({"p"}, _BUTTON_SCOPE)
        if tag in _ENDED_BY_SIBLING:
            self._end_open(*_ENDED_BY_SIBLING[tag])
        self.open.append(self._add(tag, attrs))

    def handle_endtag(self, tag):
        self.in_run = False
        if tag in DROPPED_TAGS:
            self.dropped = max(0, self.dropped - 1)
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                self._close_to(depth)
                return

    def handle_comment(self, data):
        self.in_run = False

    def handle_data(self, data):
        if self.dropped:
            return
        if self.in_run:
            self.runs[-1] += data
            return
        self.nodes[self.open[-1]]["own"].append(len(self.runs))
        self.runs.append(data)
        self.in_run = True

    def finish(self) -> dict:
        self.close()
        self._close_to(0)
        return {"runs": self.runs, "nodes": self.nodes}


@F.arrow_udf(PAGE)
def page_nodes(html: pa.Array) -> pa.Array:
    """Elements and text runs of a page; null for a null page."""
    out = []
    for body in html.to_pylist():
        if body is None:
            out.append(None)
            continue
        parser = _Nodes()
        parser.feed(body)
        out.append(parser.finish())
    return pa.array(out, type=to_arrow_type(PAGE))


# --- selectors as data ----------------------------------------------------------------------

STEPS = (
    "array<struct<axis:string,name:string,"
    "tests:array<struct<of:string,how:string,form:string,value:string,place:int,from_end:boolean>>,any:array<array<int>>>>"
)

# Fixed values of XPath: the axes understood here.
_AXES = (
    "child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self",
    "following", "preceding", "following-sibling", "preceding-sibling",
)
_STEP = re.compile(r"(?:(?:([\w-]+)\s*::\s*)?([A-Za-z_][\w.-]*|\*)|(\.\.?))")
_STRING = r"""(?:'([^']*)'|"([^"]*)")"""
_VALUE = r"(normalize-space\(\s*(?:@[\w:.-]+|\.|text\(\))?\s*\)|concat\(\s*(?:' '|\" \")\s*,\s*normalize-space\(\s*@[\w:.-]+\s*\)\s*,\s*(?:' '|\" \")\s*\)|@[\w:.-]+|\.|text\(\))"
_LAST = r"last\(\)(?:\s*-\s*(\d+))?"
_FUNCTION = re.compile(rf"(contains|starts-with)\(\s*{_VALUE}\s*,\s*{_STRING}\s*\)")
_COMPARED = re.compile(rf"{_VALUE}\s*(!?=)\s*{_STRING}")
_PLACED = re.compile(rf"position\(\)\s*(!=|<=|>=|=|<|>)\s*(?:(\d+)|{_LAST})")
_PLACE = re.compile(rf"(\d+)|{_LAST}")
_HELD = re.compile(rf"({_VALUE})(?!\s*[=!(])")
_CHILD = re.compile(r"([A-Za-z_][\w-]*|\*)(?![\w(:-])")


class _Unknown(ValueError):
    """A selector beyond what is understood."""


class _Bracket:
    """One predicate as any-of-all lists of signed test numbers."""

    def __init__(self, text: str, pos: int) -> None:
        self.text, self.pos, self.tests = text, pos, []
        self.any = self._either()

    def _skip(self) -> None:
        while self.text[self.pos : self.pos + 1].isspace():
            self.pos += 1

    def _take(self, pattern: str) -> bool:
        self._skip()
        m = re.compile(pattern).match(self.text, self.pos)
        if m:
            self.pos = m.end()
        return bool(m)

    def _either(self) -> list[list[int]]:
        out = self._both()
        while self._take(r"or\b"):
            out = out + self._both()
        return out

    def _both(self) -> list[list[int]]:
        out = self._one()
        while self._take(r"and\b"):
            right = self._one()
            out = [a + b for a in out for b in right]
        return out

    def _one(self) -> list[list[int]]:
        negated = self._take(r"not\s*\(")
        if negated or self._take(r"\("):
            inner = self._either()
            if not self._take(r"\)"):
                raise _Unknown(self.text)
            if not negated:
                return inner
            flipped: list[list[int]] = [[]]
            for all_of in inner:
                flipped = [kept + [-i] for kept in flipped for i in all_of]
            return flipped
        self.tests.append(self._test())
        return [[len(self.tests)]]

    def _match(self, pattern: re.Pattern) -> re.Match | None:
        self._skip()
        m = pattern.match(self.text, self.pos)
        if m:
            self.pos = m.end()
        return m

    def _test(self) -> dict:
        if m := self._match(_FUNCTION):
            return _text_test(m[2], m[1], m[3] if m[3] is not None else m[4])
        if m := self._match(_COMPARED):
            return _text_test(m[1], m[2], m[3] if m[3] is not None else m[4])
        if m := self._match(_PLACED):
            return _place_test(m[1], m[2], m[3])
        if m := self._match(_PLACE):
            return _place_test("=", m[1], m[2])
        if m := self._match(_HELD):
            return _text_test(m[1], "exists", "")
        if m := self._match(_CHILD):
            return _text_test(".", "child", m[1])
        raise _Unknown(self.text)


def _text_test(of: str, how: str, value: str) -> dict:
    form = "padded" if of.startswith("concat") else "normal" if of.startswith("normalize") else "raw"
    inner = re.search(r"@[\w:.-]+|text\(\)", of)
    return {"of": inner[0] if inner else ".", "how": how, "form": form, "value": value, "place": 0, "from_end": False}


def _place_test(how: str, place: str | None, back: str | None) -> dict:
    from_end = place is None
    return {"of": "place", "how": how, "form": "", "value": "", "place": int((back or 0) if from_end else place), "from_end": from_end}


def selector_steps(xpath: str | None) -> list[dict] | None:
    """A selector as steps (see :data:`STEPS`); None for an empty one or one that is not understood.

    Understood are absolute paths over all axes but attributes and namespaces, ``and``, ``or``, ``not()``, tests of
    attributes, of ``text()`` and of the whole text, children by name, and positions on the axes child,
    following-sibling and preceding-sibling.
    """
    if not xpath or not xpath.strip():
        return None
    text = xpath.strip()
    text = text[1:] if text.startswith(".//") else text
    try:
        return _path(text)
    except _Unknown:
        return None


def _path(text: str) -> list[dict]:
    steps, pos = [], 0
    while pos < len(text):
        if not text.startswith("/", pos):
            raise _Unknown(text)
        if text.startswith("//", pos):
            steps.append({"axis": "descendant-or-self", "name": None, "tests": [], "any": []})
            pos += 1
        pos += 1
        m = _STEP.match(text, pos)
        if not m or (m[1] or "child") not in _AXES:
            raise _Unknown(text)
        axis = {".": "self", "..": "parent"}.get(m[3], m[1] or "child")
        steps.append({"axis": axis, "name": None if m[3] else m[2].lower(), "tests": [], "any": []})
        pos, placed = m.end(), False
        while text.startswith("[", pos):
            bracket = _Bracket(text, pos + 1)
            if not bracket._take(r"\]"):
                raise _Unknown(text)
            pos = bracket.pos
            if any(t["of"] == "place" for t in bracket.tests):
                if axis.endswith("-sibling"):
                    if placed or not _one_place(bracket):
                        raise _Unknown(text)
                    for t in bracket.tests:
                        t["of"] = axis if t["of"] == "place" else t["of"]
                elif axis != "child":
                    raise _Unknown(text)
                placed = True
            steps.append({"axis": None, "name": None, "tests": bracket.tests, "any": bracket.any})
    if not steps:
        raise _Unknown(text)
    return steps


def _one_place(bracket: _Bracket) -> bool:
    """A place counted from several elements holds for one of them, so it may be neither denied nor combined."""
    places = {n for n, t in enumerate(bracket.tests, 1) if t["of"] == "place"}
    plain = all(bracket.tests[n - 1]["how"] == "=" and not bracket.tests[n - 1]["from_end"] for n in places)
    return plain and all(-n not in c for c in bracket.any for n in places) and all(len(places & set(c)) <= 1 for c in bracket.any)


# --- evaluation -----------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes a value once for all uses inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def element_text(page: Column, n: Column) -> Column:
    """All text below an element."""
    return F.array_join(F.slice(page["runs"], n["first"] + 1, n["stop"] - n["first"]), "")


def _moved(nodes: Column, on: Column, step: Column) -> Column:
    """Flags of the elements a step's axis and name lead to."""

    def flag(i: Column) -> Column:
        return _true(F.get(on, i))

    def named(reach: Callable[[Column], Column]) -> Column:
        name = step["name"]
        return F.transform(
            nodes,
            lambda n: (name.isNull() | ((n["number"] > 0) & ((name == "*") | (n["tag"] == name)))) & _true(reach(n)),
        )

    def flagged(of: str) -> Column:
        return F.transform(F.filter(nodes, lambda n: flag(n["number"])), lambda n: n[of])

    def around(n: Column) -> Column:
        return F.exists(n["above"], flag)

    def within(n: Column) -> Column:
        return F.when(n["last"] > n["number"], F.exists(F.sequence(n["number"] + 1, n["last"]), flag))

    def itself(n: Column) -> Column:
        return flag(n["number"])

    def edges(pick) -> Column:
        return F.transform(nodes, lambda p: pick(F.filter(p["kids"], flag)))

    axis = step["axis"]
    return (
        F.when(axis == "child", named(lambda n: flag(n["parent"])))
        .when(axis == "descendant", named(around))
        .when(axis == "descendant-or-self", named(lambda n: itself(n) | around(n)))
        .when(axis == "self", named(itself))
        .when(axis == "parent", named(lambda n: F.exists(n["kids"], flag)))
        .when(axis == "ancestor", named(within))
        .when(axis == "ancestor-or-self", named(lambda n: itself(n) | _true(within(n))))
        .when(axis == "following", let(F.array_min(flagged("last")), lambda m: named(lambda n: n["number"] > m)))
        .when(axis == "preceding", let(F.array_max(flagged("number")), lambda m: named(lambda n: n["last"] < m)))
        .when(
            axis == "following-sibling",
            let(edges(F.array_min), lambda e: named(lambda n: n["number"] > F.get(e, n["parent"]))),
        )
        .when(
            axis == "preceding-sibling",
            let(edges(F.array_max), lambda e: named(lambda n: n["number"] < F.get(e, n["parent"]))),
        )
    )


def _spaced(value: Column, form: Column) -> Column:
    normal = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), "[ \\t\\r\\n]+", " "))
    return F.when(form == "normal", normal).when(form == "padded", F.concat(F.lit(" "), normal, F.lit(" "))).otherwise(value)


def _kept(page: Column, on: Column, came: Column, hidden: Column, step: Column) -> Column:
    """Flags of the elements a predicate leaves."""
    nodes = page["nodes"]

    def texts(t: Column, n: Column) -> Column:
        own = F.transform(n["own"], lambda i: F.get(page["runs"], i))
        value = (
            F.when(t["of"] == ".", element_text(page, n))
            .when(t["of"] == "text()", F.get(own, F.lit(0)))
            .otherwise(F.try_element_at(n["attrs"], F.substring(t["of"], F.lit(2), F.lit(2**31 - 1))))
        )
        value = _spaced(value, t["form"])
        anywhere = (t["of"] == "text()") & (t["form"] == "raw")
        kids = F.filter(n["kids"], lambda k: ~_true(F.get(hidden, k)))
        return (
            F.when(t["how"] == "contains", F.contains(F.coalesce(value, F.lit("")), t["value"]))
            .when(t["how"] == "starts-with", F.startswith(F.coalesce(value, F.lit("")), t["value"]))
            .when((t["how"] == "=") & anywhere, F.exists(own, lambda s: s == t["value"]))
            .when((t["how"] == "!=") & anywhere, F.exists(own, lambda s: s != t["value"]))
            .when(t["how"] == "=", value == t["value"])
            .when(t["how"] == "!=", value != t["value"])
            .when(t["how"] == "exists", F.when(t["form"] == "raw", value.isNotNull()).otherwise(F.length(value) > 0))
            .when(t["how"] == "child", F.exists(kids, lambda k: (t["value"] == "*") | (F.get(nodes, k)["tag"] == t["value"])))
        )

    def placed(t: Column, n: Column, alive: Column) -> Column:
        beside = F.get(alive, n["parent"])
        index = F.when(t["from_end"], F.size(beside) - 1 - t["place"]).otherwise(t["place"] - 1)
        at = F.get(beside, F.when(index >= 0, index))
        below, beyond = F.coalesce(n["number"] < at, index >= 0), F.coalesce(n["number"] > at, index < 0)
        same = _true(n["number"] == at)
        return (
            F.when(t["how"] == "=", same)
            .when(t["how"] == "!=", ~same)
            .when(t["how"] == "<", below)
            .when(t["how"] == "<=", below | same)
            .when(t["how"] == ">", beyond)
            .otherwise(beyond | same)
        )

    def counted(t: Column, n: Column, alive: Column) -> Column:
        beside = F.get(alive, n["parent"])

        def from_here(c: Column) -> Column:
            after = F.get(F.filter(beside, lambda a: a > c), t["place"] - 1)
            before = F.get(F.reverse(F.filter(beside, lambda a: a < c)), t["place"] - 1)
            return _true(F.get(came, c)) & _true(F.when(t["of"] == "following-sibling", after).otherwise(before) == n["number"])

        return F.exists(F.get(nodes, n["parent"])["kids"], from_here)

    def holds(i: Column, n: Column, alive: Column) -> Column:
        t = F.get(step["tests"], F.abs(i) - 1)
        result = (
            F.when(t["of"] == "place", placed(t, n, alive))
            .when(F.endswith(t["of"], F.lit("-sibling")), counted(t, n, alive))
            .otherwise(texts(t, n))
        )
        return _true(result) == (i > 0)

    def left(alive: Column) -> Column:
        return F.transform(
            nodes,
            lambda n: _true(F.get(on, n["number"]))
            & F.exists(step["any"], lambda c: F.forall(c, lambda i: holds(i, n, alive))),
        )

    alive = F.transform(nodes, lambda p: F.filter(p["kids"], lambda k: _true(F.get(on, k))))
    return let(alive, left)


def matched(page: Column, steps: Column, hidden: Column | None = None) -> Column:
    """One flag per element of the page: whether the selector picks it. Hidden elements are as if removed."""
    nodes = page["nodes"]
    hidden = F.transform(nodes, lambda n: F.lit(False)) if hidden is None else hidden
    start = F.transform(nodes, lambda n: n["number"] == 0)

    def fold(state: Column, step: Column) -> Column:
        on = state["on"]
        moved = F.zip_with(_moved(nodes, on, step), hidden, lambda m, h: _true(m) & ~h)
        next_on = F.when(step["axis"].isNotNull(), moved).otherwise(_kept(page, on, state["came"], hidden, step))
        came = F.when(step["axis"].isNotNull(), on).otherwise(state["came"])
        return F.struct(next_on.alias("on"), came.alias("came"))

    return F.aggregate(steps, F.struct(start.alias("on"), start.alias("came")), fold, lambda s: s["on"])


def removed(page: Column, rules: Column) -> Column:
    """One flag per element: whether it goes by one of the selectors, applied in turn; a page's only root element stays."""
    nodes = page["nodes"]

    def fold(gone: Column, steps: Column) -> Column:
        def spread_down(on: Column) -> Column:
            def hit(i: Column) -> Column:
                alone = (F.get(nodes, i)["parent"] == 0) & (F.size(F.get(nodes, F.lit(0))["kids"]) == 1)
                return _true(F.get(on, i)) & (i > 0) & ~alone

            return F.transform(nodes, lambda n: _true(F.get(gone, n["number"])) | hit(n["number"]) | F.exists(n["above"], hit))

        return let(matched(page, steps, gone), spread_down)

    return F.aggregate(rules, F.transform(nodes, lambda n: F.lit(False)), fold)


def select_elements(pages: DataFrame, selectors: list[str]) -> DataFrame:
    """One row per page, selector and element picked: place (from 1, in page order), tag and whole text.

    ``pages`` holds html; its other columns stay, unless they are named selector, place, tag or text. Null and
    empty pages give no rows. A selector that is not understood raises ``ValueError``.
    """
    compiled = [{"selector": s, "steps": selector_steps(s)} for s in selectors]
    bad = [c["selector"] for c in compiled if c["steps"] is None]
    if bad:
        raise ValueError(f"selectors not understood: {bad}")
    carried = [c for c in pages.columns if c not in ("html", "selector", "place", "tag", "text")]
    asked = F.from_json(F.lit(json.dumps(compiled)), f"array<struct<selector:string,steps:{STEPS}>>")
    df = spread(pages).select(*carried, page_nodes(F.col("html")).alias("_page"))
    page = F.col("_page")

    def found(ask: Column) -> Column:
        picked = let(
            matched(page, ask["steps"]),
            lambda on: F.filter(page["nodes"], lambda n: _true(F.get(on, n["number"]))),
        )
        return F.transform(
            picked,
            lambda n, i: F.struct(
                ask["selector"].alias("selector"), (i + 1).alias("place"), n["tag"].alias("tag"), element_text(page, n).alias("text")
            ),
        )

    df = df.where(page.isNotNull()).select(*carried, F.explode(F.flatten(F.transform(asked, found))).alias("_found"))
    return df.select(*carried, "_found.*")
