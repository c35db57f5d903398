"""Model calls per article: tags, embeddings and summaries from callables the user supplies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.text import first_words, parse_tags, text_or_empty
from articleflow.operators.sizing import spread
from articleflow.session import cut_lineage

# Words sent per task, and shortest text it is called for.
LIMITS = {"summarise": (4000, 100), "classify": (2000, 50), "embed": (1200, 1)}

EMBED_WIDTH = 64


def model_input(text: Column, task: str) -> Column:
    """Text cut to the task's number of words; null where the text is too short to ask."""
    words, shortest = LIMITS[task]
    return F.when(F.length(text_or_empty(text)) >= shortest, first_words(text, words))


def call_model(
    df: DataFrame, fn: Callable[[list[str]], list], prompt: Column, out: str, kind: str
) -> DataFrame:
    """Add ``out`` and ``<out>_error`` from ``fn``, called with batches of prompts.

    A failing batch of several is retried prompt by prompt, so one bad article costs itself only; its
    error lands in the error column. Null prompts never reach the model. Set the number of partitions
    before this stage to the number of calls the model server takes at once.
    """
    result = T.StructType(
        [
            T.StructField("value", T.DataType.fromDDL(kind)),
            T.StructField("error", T.StringType()),
        ]
    )

    def one(text: str):
        try:
            return fn([text])[0], None
        except Exception as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def answer(texts: list[str]) -> list[tuple]:
        if len(texts) == 1:
            return [one(texts[0])]
        try:
            values = fn(texts)
        except Exception:
            return [one(t) for t in texts]
        if len(values) != len(texts):
            return [one(t) for t in texts]
        return [(v, None) for v in values]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None, None)] * len(batch)
            asked = [i for i, v in enumerate(batch) if v is not None]
            if asked:
                for i, row in zip(asked, answer([batch.iloc[i] for i in asked])):
                    rows[i] = row
            yield pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    answered = df.withColumn("_answer", F.pandas_udf(run, result)(prompt))
    return answered.withColumns(
        {out: F.col("_answer.value"), f"{out}_error": F.col("_answer.error")}
    ).drop("_answer")


def classify(df: DataFrame, fn, text: str = "content_text") -> DataFrame:
    """Add ``tags``, parsed from the model's comma-separated answer."""
    asked = call_model(df, fn, model_input(F.col(text), "classify"), "_raw", "string")
    return asked.withColumns(
        {"tags": parse_tags(F.col("_raw")), "tags_error": F.col("_raw_error")}
    ).drop("_raw", "_raw_error")


def embed(df: DataFrame, fn, text: str = "content_text") -> DataFrame:
    return call_model(df, fn, model_input(F.col(text), "embed"), "embedding", "array<double>")


def summarise(requests: DataFrame, fn, text: str = "text") -> DataFrame:
    """Add ``summary`` to summary requests (see ``prompts.summary_requests``).

    ``fn`` receives the instruction and the text of each request, separated by an empty line.
    """
    prompt = F.concat("system_prompt", F.lit("\n\n"), model_input(F.col(text), "summarise"))
    return call_model(requests, fn, prompt, "summary", "string")


_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object))


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def _tag_words(texts: pd.Series) -> pd.Series:
    """Distinct candidate words of a text and their counts."""
    return texts.map(lambda text: dict(Counter(w for w in _words(text) if 4 <= len(w) < 50)))


def keyword_tags(entries: DataFrame, n: int = 5, text: str = "content") -> DataFrame:
    """Tags without a model: (entry_id, tag, rank) of the words that are frequent in an entry and
    rare elsewhere.

    The words of every entry are stored once, one row per distinct word, and shuffled twice: to
    the number of entries that have the word, and back to their entry, whose words are ranked.
    """
    total = entries.count()
    narrow = spread(entries.select("entry_id", F.col(text).alias("text")))
    numbered = narrow.select(F.monotonically_increasing_id().alias("row"), F.col("entry_id").cast("bigint"), "text")
    # Stored, so that the numbers of the rows stay the same in both readings.
    words = cut_lineage(numbered.select("row", "entry_id", F.explode(_tag_words("text")).alias("tag", "times")))
    known = words.groupBy("tag").agg(F.count(F.lit(1)).alias("df"))
    score = F.col("times") * F.log((F.lit(total) + 1) / (F.col("df") + 1))
    scored = words.join(known, "tag").withColumn("score", score)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "tag")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("entry_id", "tag", "rank")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Vector without a model: signed hashes of the words, added up in ``EMBED_WIDTH`` places."""

    def vector(text: str | None) -> np.ndarray:
        words = _words(text)
        if not words:
            return np.zeros(EMBED_WIDTH)
        h = _hashes(words)
        sign = np.where((h >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
        place = (h % np.uint64(EMBED_WIDTH)).astype(int)
        return np.bincount(place, weights=sign, minlength=EMBED_WIDTH)

    return texts.map(vector)
