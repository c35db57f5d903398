"""Column functions over addresses."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address prefixes of the archive copy and of the image proxy.
ARCHIVE_PREFIX = "https://web.archive.org/web/"
IMAGE_PROXY_PREFIX = "/proxy/image?url="


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def percent_encode(col: Column) -> Column:
    """Percent-encoding that leaves only unreserved characters as they are."""
    form = F.url_encode(col)
    form = F.replace(form, F.lit("+"), F.lit("%20"))
    form = F.replace(form, F.lit("%7E"), F.lit("~"))
    return F.replace(form, F.lit("*"), F.lit("%2A"))


def archive_url(url: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_PREFIX), percent_encode(url))


def image_proxy_url(src: Column) -> Column:
    return F.concat(F.lit(IMAGE_PROXY_PREFIX), percent_encode(src))


def _join(base: str | None, href: str | None) -> str | None:
    if href is None:
        return None
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link. Links that already name a scheme do not travel to Python."""
    absolute = F.rlike(href, F.lit(r"^https?://[^/?#]+/[^.?#;]*$"))
    return F.when(absolute, href).otherwise(
        _resolve(F.when(~absolute, base), F.when(~absolute, href))
    )


def parse_pairs(col: Column) -> Column:
    """``k=v; k2=v2`` to a map: the first ``=`` splits, the last key wins, the rest is dropped."""
    parts = F.filter(F.split(col, ";"), lambda p: F.contains(p, F.lit("=")))

    def put(seen: Column, p: Column) -> Column:
        key = F.btrim(F.substring_index(p, "=", 1))
        value = F.btrim(F.substr(p, F.instr(p, "=") + 1))
        return F.map_concat(F.map_filter(seen, lambda k, _: k != key), F.create_map(key, value))

    return F.aggregate(parts, F.expr("cast(map() as map<string,string>)"), put)
