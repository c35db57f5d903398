"""Prompt library as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import slugify
from articleflow.operators.ordering import over_groups
from articleflow.schemas import schema_of
from articleflow.session import cut_lineage

# Built-in prompts by id and name; the wording is this library's own.
BUILTIN = [
    ("default", "Concise", "Summarise the article in two or three sentences. Give the summary only."),
    ("bullets", "Bullet points", "Summarise the article as three to six short bullets, each starting with '- '."),
    ("eli5", "ELI5", "Explain the main idea of the article to a beginner in two to four plain sentences."),
    ("skeptic", "Skeptic's take", "State the central claim in a few sentences and name its weakest assumption."),
]


def builtin_prompts(spark: SparkSession) -> DataFrame:
    rows = [(slug, name, text, True, None) for slug, name, text in BUILTIN]
    return spark.createDataFrame(rows, schema_of("summary_prompts"))


def list_prompts(prompts: DataFrame, position: str | None = None) -> DataFrame:
    """Prompts in list order, built-in ones first; ``position`` names a column for the place, from 1."""
    if position:
        keyed = prompts.withColumns({"_all": F.lit(1), "_own": ~F.col("is_builtin")})
        order = ["_own", "name", "id"]
        placed = over_groups(keyed, ["_all"], order, lambda g: g.running_sum(F.lit(1), position).result())
        prompts = placed.drop("_all", "_own")
    return prompts.orderBy(F.desc("is_builtin"), "name", "id")


def _number(col: Column, base: Column) -> Column:
    """Number of a slug within its base: 1 for the base itself, n for ``base_n`` (n >= 2), else null."""
    rest = F.substr(col, F.length(base) + 1)
    digits = F.regexp_extract(rest, r"^_([1-9]\d{0,8})$", 1)
    n = F.when(digits != "", digits.cast("bigint"))
    return F.when(col == base, F.lit(1).cast("bigint")).when(n >= 2, n)


def _bases(col: Column) -> Column:
    """Bases a stored slug may stand in the way of: itself, and the part before a number."""
    return F.array_distinct(F.array(col, F.regexp_replace(col, r"_[1-9]\d{0,8}$", "")))


def unique_slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Slug of each saved name (seq, name), with the lowest free suffix in order of ``seq``.

    ``taken``: column ``slug``. The r-th request for a base gets its r-th free number: r plus the
    count of taken numbers below it. With j numbers taken up to and including n, n - j free ones
    lie below n, so a taken number counts for r when n - j < r. Both counts are running sums over
    ordered groups, which stay balanced when one base gets most requests. Where two bases ask for
    the same slug the earlier request keeps it and the later ones are numbered again.
    """
    waiting = names.select("seq", "name", slugify(F.col("name")).alias("base"))
    used = taken.select("slug").distinct()
    done = None
    while True:
        holders = (
            used.select("slug", F.explode(_bases(F.col("slug"))).alias("base"))
            .select("base", _number(F.col("slug"), F.col("base")).alias("n"))
            .where("n IS NOT NULL")
            .join(waiting.select("base"), "base", "left_semi")
        )
        held = over_groups(
            holders, ["base"], ["n"], lambda g: g.running_sum(F.lit(1), "j").result()
        )
        blocks = held.select(
            "base",
            (F.col("n") - F.col("j")).alias("pos"),
            F.lit(1).alias("kind"),
            F.lit(None).cast(waiting.schema["seq"].dataType).alias("seq"),
            F.lit(None).cast("string").alias("name"),
            F.col("n").alias("tie"),
        )
        ranked = over_groups(
            waiting, ["base"], ["seq"], lambda g: g.running_sum(F.lit(1), "r").result()
        )
        asked = ranked.select(
            "base", F.col("r").alias("pos"), F.lit(0).alias("kind"), "seq", "name", F.col("r").alias("tie")
        )
        placed = over_groups(
            blocks.unionByName(asked),
            ["base"],
            ["pos", "kind", "tie"],
            lambda g: g.running_sum(F.col("kind"), "blocked").result(),
        ).where("kind = 0")
        n = F.col("pos") + F.col("blocked")
        slug = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string")))
        offered = placed.select("seq", "name", "base", slug.alias("slug"))
        first = offered.groupBy("slug").agg(F.min("seq").alias("seq"))
        won = cut_lineage(offered.join(first, ["slug", "seq"], "left_semi"))
        done = won if done is None else done.unionByName(won)
        waiting = cut_lineage(waiting.join(won.select("seq"), "seq", "left_anti"))
        if waiting.isEmpty():
            return done.select("seq", "name", "slug")
        used = used.unionByName(won.select("slug")).distinct()


def summary_requests(snapshots: DataFrame, prompts: DataFrame, ids: list[str]) -> DataFrame:
    """Requests (entry_id, version, text, prompt_id, system_prompt) for the chosen prompts.

    The prompts asked for are a short list, so each row is repeated by an array, without a join.
    """
    chosen = prompts.where(F.col("id").isin(ids)).select("id", "system_prompt").collect()
    if len(chosen) < len(set(ids)):
        raise ValueError("unknown prompt")
    table = F.array(
        *[
            F.struct(F.lit(r["id"]).alias("prompt_id"), F.lit(r["system_prompt"]).alias("system_prompt"))
            for r in chosen
        ]
    )
    rows = snapshots.where(F.length("content_text") > 0).withColumn("_p", F.explode(table))
    return rows.select(
        "entry_id",
        "version",
        F.col("content_text").alias("text"),
        "_p.prompt_id",
        "_p.system_prompt",
    )
