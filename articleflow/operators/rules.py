"""Saved filters: JSON rules compiled to one expression over all filters."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.text import text_or_empty
from articleflow.operators.ordering import all_of
from articleflow.operators.sizing import attach
from articleflow.schemas import RULE
from articleflow.session import cut_lineage

# Fields and actions of the rule language.
FIELDS = ("title", "content", "author", "url", "feed_title")
ACTIONS = ("mark_read", "star")
OPS = ("contains", "not_contains", "equals", "starts_with")

# Filters evaluated by one expression; more filters make more expressions in the same projection.
FILTERS_PER_BLOCK = 500


@dataclass(frozen=True)
class SavedFilter:
    id: int
    name: str
    rules: tuple[dict, ...]
    auto_action: str | None = None


def parse_rules(text: str) -> tuple[dict, ...]:
    """Rules from JSON; raises ValueError on what is not a list of objects."""
    rules = json.loads(text or "[]")
    if not isinstance(rules, list) or not all(isinstance(r, dict) for r in rules):
        raise ValueError("rules must be a list of objects")
    return tuple(rules)


def valid_rules(col: Column) -> Column:
    """Rules column from a JSON column; null where the JSON is not a rule list."""
    return F.from_json(col, T.ArrayType(RULE), {"mode": "PERMISSIVE"})


def read_filters(filters: DataFrame) -> list[SavedFilter]:
    """Active filters of the settings table: those with rules and an action.

    The table is user configuration. Rows are fetched one partition at a time.
    """
    active = filters.where(
        (F.size(F.coalesce("rules", F.array().cast(T.ArrayType(RULE)))) > 0)
        & (text_or_empty(F.col("auto_action")) != "")
    )
    return [
        SavedFilter(r["id"], r["name"], tuple(x.asDict() for x in r["rules"]), r["auto_action"])
        for r in active.orderBy("id").toLocalIterator()
    ]


def list_filters(filters: DataFrame) -> DataFrame:
    return filters.orderBy(F.desc("created_at"), F.desc("id"))


def _lowered(entries: DataFrame) -> DataFrame:
    """Entries with a lower-case copy of each rule field, made once for all filters."""
    present = [c for c in FIELDS if c in entries.columns]
    return entries.select(
        "entry_id", *[F.lower(text_or_empty(F.col(c))).alias(f"_{c}") for c in present]
    )


def _field(name: str | None, columns: set[str]) -> Column:
    if name in FIELDS and f"_{name}" in columns:
        return F.col(f"_{name}")
    if name in FIELDS and name in columns:
        return F.lower(text_or_empty(F.col(name)))
    return F.lit("")


def rule_condition(rule: dict, columns: set[str]) -> Column:
    value = F.lit((rule.get("value") or "").lower())
    field = _field(rule.get("field"), columns)
    op = rule.get("op")
    if op == "contains":
        return F.contains(field, value)
    if op == "not_contains":
        return ~F.contains(field, value)
    if op == "equals":
        return field == value
    if op == "starts_with":
        return F.startswith(field, value)
    return F.lit(True)


def rules_condition(rules, columns) -> Column:
    """All rules hold. Unknown operators are ignored, unknown fields read as empty text."""
    return all_of([rule_condition(r, set(columns)) for r in rules])


def _compiled(filters: list[SavedFilter], columns: list[str]) -> Column:
    hits = [
        F.when(
            rules_condition(f.rules, columns),
            F.struct(
                F.lit(f.id).cast("bigint").alias("filter_id"),
                F.lit(f.auto_action).alias("action"),
            ),
        )
        for f in filters
    ]
    return F.array_compact(F.array(*hits))


def _holds(columns: list[str]):
    """Whether a rule given as data holds for the lower-cased fields of a row."""
    present = [c for c in FIELDS if f"_{c}" in columns]

    def value_of(name: Column) -> Column:
        return reduce(
            lambda acc, c: F.when(name == c, F.col(f"_{c}")).otherwise(acc), present, F.lit("")
        )

    def holds(rule: Column) -> Column:
        field, value = value_of(rule["field"]), rule["value"]
        return (
            F.when(rule["op"] == "contains", F.contains(field, value))
            .when(rule["op"] == "not_contains", ~F.contains(field, value))
            .when(rule["op"] == "equals", field == value)
            .when(rule["op"] == "starts_with", F.startswith(field, value))
            .otherwise(F.lit(True))
        )

    return holds


def _driven(filters: list[SavedFilter], columns: list[str]) -> Column:
    """The same matches with the rules as constant data, so the plan does not grow with them."""
    rows = [
        {
            "filter_id": f.id,
            "action": f.auto_action,
            "rules": [
                {k: str(r.get(k) or "") for k in ("field", "op")}
                | {"value": (r.get("value") or "").lower()}
                for r in f.rules
            ],
        }
        for f in filters
    ]
    schema = T.ArrayType(
        T.StructType(
            [
                T.StructField("filter_id", T.LongType()),
                T.StructField("action", T.StringType()),
                T.StructField("rules", T.ArrayType(RULE)),
            ]
        )
    )
    table = F.from_json(F.lit(json.dumps(rows)), schema)
    holds = _holds(columns)
    matching = F.filter(table, lambda f: F.forall(f["rules"], holds))
    return F.transform(
        matching,
        lambda f: F.struct(f["filter_id"].alias("filter_id"), f["action"].alias("action")),
    )


def match_filters(
    entries: DataFrame, filters: list[SavedFilter], compiled_up_to: int = 50
) -> DataFrame:
    """(entry_id, filter_id, action) for every filter an entry satisfies; one pass, no join.

    A few filters become plain conditions inside generated code. Many filters become constant data
    walked per entry, in blocks, so that any number of filters is handled.
    """
    active = [f for f in filters if f.rules and f.auto_action]
    entries = _lowered(entries)
    empty = F.array().cast("array<struct<filter_id:bigint,action:string>>")
    if not active:
        hits = empty
    elif len(active) <= compiled_up_to:
        hits = _compiled(active, entries.columns)
    else:
        blocks = [
            _driven(active[i : i + FILTERS_PER_BLOCK], entries.columns)
            for i in range(0, len(active), FILTERS_PER_BLOCK)
        ]
        hits = F.concat(*blocks)
    return entries.select("entry_id", F.explode(hits).alias("hit")).select(
        "entry_id", "hit.filter_id", "hit.action"
    )


# Characters of the longest run a filter is filed under, and of the start that entries' runs are preselected by.
GRAM = 16
HEAD = 3


def _windows(chars: Column) -> Column:
    """Up to ``GRAM`` characters from every place of an array of characters on, each once."""
    return F.array_distinct(F.transform(chars, lambda c, i: F.array_join(F.slice(chars, i + 1, GRAM), "")))


def match_filter_table(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """(entry_id, filter_id, action) as ``match_filters`` gives them, for any number of saved filters.

    ``filters``: id, rules, auto_action. They stay a table: each is filed under one run of characters
    (gram) that an entry must have to match, the rarest among the entries, and entries meet
    filters where they have that gram in that field; the few pairs left are verified rule by rule. A gram
    is a whole value or ``GRAM`` characters of a longer one, so values that differ late still keep apart.
    Entries offer runs only where one starts like a gram of that field. Rules that demand nothing
    (negations, unknown operators, empty values) can't be filed; a filter of such rules alone is filed
    under the empty gram, which every entry has. A demand on a field entries don't have matches nothing.
    """
    lowered = _lowered(entries)
    text = lambda c: text_or_empty(c)
    rule = lambda r: F.struct(
        text(r["field"]).alias("field"), text(r["op"]).alias("op"), F.lower(text(r["value"])).alias("value")
    )
    active = filters.where((F.size("rules") > 0) & (text(F.col("auto_action")) != "")).select(
        F.col("id").cast("bigint").alias("filter_id"), F.col("auto_action").alias("action"),
        F.transform("rules", rule).alias("rules"),
    )
    active = cut_lineage(active)
    each = active.select("filter_id", F.explode("rules").alias("r")).where(F.col("r.field").isin(*FIELDS))
    # At most one row per field comes to the driver; fields that no rule names are not read.
    named = {f"_{r['field']}" for r in each.select("r.field").distinct().collect()}
    lowered = lowered.select("entry_id", *[c for c in lowered.columns if c in named])
    demands = each.where(F.col("r.op").isin("contains", "equals", "starts_with") & (F.col("r.value") != ""))
    chars = demands.select("filter_id", "r.field", F.least(F.length("r.value"), F.lit(GRAM)).alias("n"), F.split("r.value", "").alias("chars"))
    cuts = F.transform(F.sequence(F.lit(0), F.size("chars") - F.col("n")), lambda i: F.array_join(F.slice("chars", i + 1, F.col("n")), ""))
    wanted = cut_lineage(chars.select("filter_id", "field", F.explode(F.array_distinct(cuts)).alias("gram")).distinct())

    asked = wanted.select("field", "gram").distinct()
    head = F.substring("gram", 1, HEAD).alias("head")
    heads = asked.groupBy("field", head).agg(F.collect_set(F.length("gram")).alias("lengths"))
    met = cut_lineage(_offered(lowered, heads).join(asked, ["field", "gram"], "left_semi"))
    counts = met.groupBy("field", "gram").agg(F.count("*").alias("n"))
    rated = wanted.join(counts, ["field", "gram"], "left")
    filed = rated.groupBy("filter_id").agg(
        F.min_by(F.struct("field", "gram"), F.struct(F.coalesce("n", F.lit(0)), "field", "gram")).alias("at")
    )
    filed = cut_lineage(filed.select("filter_id", "at.field", "at.gram"))
    free = active.join(filed, "filter_id", "left_anti").select("filter_id", F.lit("").alias("field"), F.lit("").alias("gram"))
    everywhere = lowered.select("entry_id", F.lit("").alias("field"), F.lit("").alias("gram"))
    pairs = attach(met.unionByName(everywhere), filed.unionByName(free), ["field", "gram"], how="inner")
    pairs = pairs.select("entry_id", "filter_id").distinct()
    full = attach(pairs, active, "filter_id", how="inner").join(lowered, "entry_id")
    return full.where(F.forall("rules", _holds(lowered.columns))).select("entry_id", "filter_id", "action")


def _offered(lowered: DataFrame, heads: DataFrame) -> DataFrame:
    """(entry_id, field, gram): runs of the entries that start with a head (field, head, lengths) and have one of its lengths."""
    present = [c for c in FIELDS if f"_{c}" in lowered.columns]
    if not present:
        return lowered.select("entry_id", F.lit("").alias("field"), F.lit("").alias("gram")).where(F.lit(False))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("text")) for c in present]))
    split = lowered.select("entry_id", fields.alias("f")).select("entry_id", "f.field", F.split("f.text", "").alias("chars"))
    split = split.join(F.broadcast(heads.select("field").distinct()), "field", "left_semi")
    runs = split.select("entry_id", "field", F.explode(_windows(F.col("chars"))).alias("run"))
    starts = F.array_distinct(F.array(*[F.substring("run", 1, n) for n in range(1, HEAD + 1)]))
    begun = runs.select("entry_id", "field", "run", F.explode(starts).alias("head"))
    some = attach(begun, heads, ["field", "head"], how="inner").select("entry_id", "field", "run", F.explode("lengths").alias("n"))
    long_enough = some.where(F.length("run") >= F.col("n"))
    return long_enough.select("entry_id", "field", F.substr("run", F.lit(1), F.col("n")).alias("gram")).distinct()


def filter_actions(matches: DataFrame, at: Column) -> DataFrame:
    """Matches as rows of the action log; ``star`` sets the star, it does not flip it."""
    return matches.where(F.col("action").isin(*ACTIONS)).select(
        F.col("entry_id").alias("id"),
        "action",
        F.lit(None).cast("string").alias("value"),
        at.alias("ts"),
        F.col("filter_id").alias("seq"),
    )
