"""Settings per site, found by the host of an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions.urls import bare_host, host, parse_pairs
from articleflow.operators.sizing import attach


def parse_settings(raw: DataFrame) -> DataFrame:
    """Rows (domain, raw) to settings; blank domains and texts without a pair are left out."""
    rows = raw.select(
        F.lower(F.trim("domain")).alias("domain"), parse_pairs(F.col("raw")).alias("settings")
    )
    return rows.where((F.col("domain") != "") & (F.size("settings") > 0))


def settings_for(urls: DataFrame, settings: DataFrame, url: str = "url") -> DataFrame:
    """Each address with the settings of its exact host, else of the host without ``www.``.

    Two equi-joins on the host replace an OR condition. The host is distinct per join side, so the
    addresses are never aggregated again, and with few settings they are not shuffled either.
    """
    exact = settings.select(
        F.col("domain").alias("_host"),
        F.col("domain").alias("_exact_domain"),
        F.col("settings").alias("_exact"),
    )
    bare = settings.select(
        F.col("domain").alias("_bare"),
        F.col("domain").alias("_bare_domain"),
        F.col("settings").alias("_bare_settings"),
    )
    keyed = urls.withColumns({"_host": host(F.col(url)), "_bare": bare_host(F.col(url))})
    joined = attach(attach(keyed, exact, "_host"), bare, "_bare")
    return joined.withColumns(
        {
            "domain": F.coalesce("_exact_domain", "_bare_domain"),
            "settings": F.coalesce("_exact", "_bare_settings"),
        }
    ).drop("_host", "_bare", "_exact_domain", "_exact", "_bare_domain", "_bare_settings")


def list_settings(settings: DataFrame) -> DataFrame:
    """Domains in alphabetical order with the number of their values."""
    return settings.select("domain", F.size("settings").alias("pairs")).orderBy("domain")
