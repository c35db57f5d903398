"""Secret scans: fixed patterns plus sliding-window entropy of candidate strings, in SQL functions only.

A candidate is a run of one character class, at least one window long. A window slides over it; the
count of each character is kept and changed only for the character that enters and the one that
leaves. Where the window's Shannon entropy reaches the class's bound, its place is a secret;
windows that touch become one span. The allow-list excuses '/'-separated pieces of a candidate; a
window is passed over if such pieces fill half of it, so a key next to an excused piece is found.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 20


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the three base kinds.
_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX_LEAST = 24
HEX = f"[0-9a-f]{{{HEX_LEAST},}}"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``letters`` (also a regex class body) whose windows reach ``bits`` of entropy."""

    kind: str
    letters: str
    body: str
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SecretRules:
    """``needs``: a candidate without these is no secret (prose has no digits inside words).
    ``allow``: pieces that match any of these patterns, with the slashes around them, are excused."""

    window: int = 20
    classes: tuple[CharacterClass, ...] = field(
        default_factory=lambda: (
            CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", "0-9A-Fa-f", 3.0),
            CharacterClass(
                "entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", "A-Za-z0-9+/_-", 3.8
            ),
        )
    )
    needs: str = "[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]"
    allow: tuple[str, ...] = ("(?i)example", "(?i)placeholder", "(?i)changeme", "^[0-9/_+-]+$", "/[a-z]+/")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _ends(text: Column, pattern: str) -> Column:
    """End (exclusive) of each piece before a match: with the match's own length, its place."""
    return F.transform(F.split(text, pattern, -1), F.length)


def _spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Matches as array<struct<s, rank, kind, e, word>>: pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    long = lambda c: c.cast("long")
    empty = F.array().cast("array<struct<s:long,rank:int,kind:string,e:long,word:string>>")
    start = F.struct(long(F.lit(0)).alias("at"), empty.alias("out"))

    def step(state: Column, item: Column) -> Column:
        s = state["at"] + item["gap"]
        e = s + F.length(item["found"])
        span = F.struct(
            long(s).alias("s"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), long(e).alias("e"),
            item["found"].alias("word"),
        )
        good = item["found"].isNotNull() & (F.length(item["value"]) >= least)
        out = F.when(good, F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct(long(F.coalesce(e, s)).alias("at"), out.alias("out"))

    zipped = F.arrays_zip(_ends(text, pattern).alias("gap"), found.alias("found"), value.alias("value"))
    spans = F.aggregate(zipped, start, step, lambda state: state["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _excused(word: Column, rules: SecretRules) -> Column:
    """1 for every character of a piece that the allow-list excuses and for the slash behind it, else 0."""
    pieces = F.split(word, "/", -1)

    def marks(piece: Column, i: Column) -> Column:
        before = F.when(i > 0, "/").otherwise("")
        behind = F.when(i < F.size(pieces) - 1, "/").otherwise("")
        return _let(F.concat(before, piece, behind), lambda x: F.array_repeat(_allowed(x, rules), F.length(piece) + 1))

    return F.flatten(F.transform(pieces, marks))


def _allowed(text: Column, rules: SecretRules) -> Column:
    """Each pattern by itself: flags of one hold for no other."""
    hit = F.lit(False)
    for pattern in rules.allow:
        hit = hit | text.rlike(pattern)
    return hit.cast("int")


def _dense(word: Column, at: Column, rules: SecretRules, cls: CharacterClass, rank: int) -> Column:
    """Spans of the windows of one candidate that reach the class's entropy."""
    w, letters = rules.window, cls.letters
    # Entropy is log2(w) - sum(c * log2(c)) / w, so the sum may be at most w * (log2(w) - bits).
    cost = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(w + 2)])
    most = math.floor(w * (math.log2(w) - cls.bits) * _SCALE)
    none = F.array().cast("array<struct<s:long,rank:int,kind:string,e:long>>")
    first = F.struct(
        F.array_repeat(F.lit(0), len(letters)).alias("n"),
        F.lit(0).alias("sum"), F.lit(0).alias("excused"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out"),
    )

    def closed(state: Column) -> Column:
        span = F.struct(
            (at + state["s"]).cast("long").alias("s"), F.lit(rank).alias("rank"), F.lit(cls.kind).alias("kind"),
            (at + state["e"]).cast("long").alias("e"),
        )
        return F.when(state["s"] >= 0, F.array_append(state["out"], span)).otherwise(state["out"])

    def slide(item: Column) -> Column:
        codes, marks = item["codes"], item["marks"]
        mark = lambda i: F.coalesce(F.get(marks, i), F.lit(0))

        def step(state: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            more, less = F.get(state["n"], enters), F.get(state["n"], leaves)
            less_after = less + F.when(leaves == enters, 1).otherwise(0)
            total = (
                state["sum"] + F.get(cost, more + 1) - F.get(cost, more)
                + F.when(leaves >= 0, F.get(cost, less_after - 1) - F.get(cost, less_after)).otherwise(0)
            )
            counts = F.transform(
                state["n"],
                lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0),
            )
            excused = state["excused"] + mark(i) - F.when(i >= w, mark(i - w)).otherwise(0)
            hit = (i >= w - 1) & (total <= most) & (excused * 2 < w)
            joins = hit & (state["e"] >= i - w + 1)
            fresh = hit & ~joins
            return F.struct(
                counts.alias("n"),
                total.cast("int").alias("sum"),
                excused.cast("int").alias("excused"),
                F.when(fresh, i - w + 1).otherwise(state["s"]).cast("int").alias("s"),
                F.when(hit, i + 1).otherwise(state["e"]).cast("int").alias("e"),
                F.when(fresh, closed(state)).otherwise(state["out"]).alias("out"),
            )

        places = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.aggregate(places, first, step, closed)

    codes = F.transform(F.split(word, "(?!^)(?!$)"), lambda c: F.instr(F.lit(letters), c) - 1)
    return _let(F.struct(codes.alias("codes"), _excused(word, rules).alias("marks")), slide)


def _entropy(text: Column, cls: CharacterClass, rank: int, rules: SecretRules) -> Column:
    runs = _spans(text, f"[{cls.body}]{{{rules.window},}}", cls.kind, rank)
    judged = F.filter(runs, lambda x: x["word"].rlike(rules.needs))
    return F.flatten(F.transform(judged, lambda x: _dense(x["word"], x["s"], rules, cls, rank)))


def _may_assign(text: Column) -> Column:
    return F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))


def _has_long_run(text: Column, rules: SecretRules) -> Column:
    """Whether any kind that is a run of characters can occur: one pass where each kind would need its own."""
    # Letters one by one: ranges and unions of classes take Java's matcher twice the time.
    letters = set("0123456789abcdef").union(*(c.letters for c in rules.classes))
    one = f"[{''.join(re.escape(c) for c in sorted(letters))}]"
    return text.rlike(f"(?<!{one}){one}{{{min(rules.window, HEX_LEAST)}}}")


def scan(docs: DataFrame, rules: SecretRules | None = None, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: array<struct<s, rank, kind, e>> by place, then kind as listed
    (``assign``, ``access``, ``hex``, then the entropy classes).

    Places are code points, ends exclusive. A null or empty text has no spans. Rows never meet, so
    repeated rows and ids are judged alike, other columns stay, and nothing is shuffled.
    """
    rules = rules or SecretRules()
    if out_col in docs.columns:
        docs = docs.drop(out_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    drop_word = lambda spans: F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["e"].alias("e"))
    )
    none = F.array().cast("array<struct<s:long,rank:int,kind:string,e:long>>")
    in_runs = [drop_word(_spans(text, HEX, "hex", 2))]
    in_runs += [_entropy(text, cls, 3 + k, rules) for k, cls in enumerate(rules.classes)]
    # Most texts hold no secret, and a cheap look tells so.
    parts = [
        F.when(_may_assign(text), drop_word(_spans(text, ASSIGN, "assign", 0, 2, ASSIGN_LEAST))).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), drop_word(_spans(text, ACCESS, "access", 1))).otherwise(none),
        F.when(_has_long_run(text, rules), F.concat(*in_runs)).otherwise(none),
    ]
    return docs.withColumn(out_col, F.array_sort(F.concat(*parts)))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]", rules: SecretRules | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``; overlapping spans give one mask.

    A text without secrets, a null one included, stays as it is; ``n_chars`` (if there) follows.
    """
    spans = scan(docs, rules, out_col="__secrets")
    text = F.col("text")

    def step(state: Column, x: Column) -> Column:
        inside = x["s"] < state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (x["s"] - state["at"]).cast("int"))
        out = F.when(inside, state["out"]).otherwise(F.array_append(state["out"], F.concat(gap, F.lit(mask))))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
    )
    clean = F.aggregate(F.col("__secrets"), first, step, rest)
    out = spans.withColumn("text", F.when(F.size("__secrets") > 0, clean).otherwise(text)).drop("__secrets")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out


def report(docs: DataFrame, rules: SecretRules | None = None) -> DataFrame:
    """Per row: id, counts of the base kinds, digest of the base spans, and all spans."""
    spans = F.col("__spans")
    base = F.filter(spans, lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter(spans, lambda x: x["rank"] == k)).cast("long")
    return scan(docs.select("doc_id", "text"), rules, out_col="__spans").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
