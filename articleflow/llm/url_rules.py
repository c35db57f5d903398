"""URL filters: fixed host and path rules, then rules mined from labels by FP-growth, in SQL functions only.

A URL's tokens are six at most by definition (whole host, its last two labels, first path part,
file ending, scheme, first query name), so item sets can't explode. At a support of ``support``
there are at most 2^6 / ``support`` frequent sets, which bounds the mined rules by the parameter,
whatever the table's size; they travel as a constant.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"

# Fixed values: (verdict, host, path) of the rules the query applies.
FIXED_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Mining:
    """Support is the share of labelled URLs that hold the tokens and are blocked."""

    support: float = 0.005
    confidence: float = 0.6


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, sorted; none for a null URL or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    parts = {
        "host=": host,
        "site=": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "part=": F.regexp_extract(path, r"^/([^/]+)/", 1),
        "ending=": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
        "scheme=": F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1),
        "query=": F.regexp_extract(url, r"\?([^=&#]+)", 1),
    }
    named = [F.when(value != "", F.concat(F.lit(name), value)) for name, value in parts.items()]
    return F.when(host != "", F.array_sort(F.array_compact(F.array(*named)))).otherwise(
        F.array().cast("array<string>")
    )


def mine(labelled: DataFrame, options: Mining = Mining()) -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of the rules that end in a block, from columns ``url``, ``blocked``.

    Rules that contain the tokens of another one add nothing and are left out.
    """
    items = tokens_of(F.col("url"))
    marked = F.when(F.col("blocked"), F.concat(items, F.array(F.lit(BLOCK)))).otherwise(items)
    rows = labelled.where("url is not null and blocked is not null").select(marked.alias("items"))
    if rows.isEmpty():
        return []
    model = FPGrowth(
        itemsCol="items", minSupport=options.support, minConfidence=options.confidence
    ).fit(rows)
    found = (
        model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
        .select("antecedent", "confidence")
        .collect()
    )
    kept: list[tuple[frozenset[str], float]] = []
    for row in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        tokens = frozenset(row.antecedent)
        if not any(known <= tokens for known, _ in kept):
            kept.append((tokens, row.confidence))
    return [(tuple(sorted(tokens)), confidence) for tokens, confidence in kept]


def matches(tokens: Column, rules: list[tuple[tuple[str, ...], float]]) -> Column:
    """Whether all tokens of some rule are there: an inverted index from token to rule numbers
    gives the rules a URL touches, and a rule fires if it is touched once for each of its tokens."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[int]] = {}
    for number, (words, _) in enumerate(rules):
        for word in words:
            index.setdefault(word, []).append(number)
    entries = chain.from_iterable(
        (F.lit(word), F.array(*map(F.lit, numbers))) for word, numbers in index.items()
    )
    lookup, sizes = F.create_map(*entries), F.array(*[F.lit(len(words)) for words, _ in rules])
    none = F.array().cast("array<int>")
    touched = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lookup, t), none)))
    fires = lambda all_: F.exists(
        F.array_distinct(all_), lambda r: F.size(F.filter(all_, lambda x: x == r)) == F.get(sizes, r)
    )
    return F.transform(F.array(touched), fires)[0]


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits the host or a parent of it, else nulls."""
    rule = verdict = None
    for decision, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text = F.lit(name + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, F.lit(decision)) if verdict is None else verdict.when(fits, F.lit(decision))
    return rule, verdict


def judge(
    pages: DataFrame, labelled: DataFrame, options: Mining = Mining(), rules=FIXED_RULES
) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    Where no fixed rule fits, a mined rule that fires blocks and anything else is allowed. Null URLs
    and URLs without ``://`` have no tokens and are allowed. Rows never meet: repeated ids and rows
    are judged alike, and one host may own any share of the table.
    """
    mined = mine(labelled, options)
    out = pages.select("page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        tokens_of(F.col("url")).alias("tokens"),
    )
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    own = F.when(matches(F.col("tokens"), mined), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
