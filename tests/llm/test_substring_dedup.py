import hashlib
import random
import re

from pyspark.sql import functions as F

from articleflow.llm import substring_dedup
from articleflow.llm.substring_dedup import SubstringDedup


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - 12) if i is not None else ():
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("x"))
    got = substring_dedup.dedup(docs, SubstringDedup(**options))
    assert sorted((tuple(r) for r in got.drop("kept_text").collect()), key=str) == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], shard=500, stream=20_000)


def test_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "é", " x", "😀", "c,"])
    passage = [f"p{k}" for k in range(60)]
    rows = [(None, " ".join(passage)), (3, None), (4, ""), (5, " \t\n"), (7, "a " * 5000), (6, "a " * 12), (8, "a\n" * 14)]
    rows += [(9, " ".join(passage)), (9, " ".join(passage)), (9, "other " + " ".join(passage[20:40])), (2, " ".join(passage[30:50]))]
    rows += [(10 + k, " ".join([word() for _ in range(30)] + passage[k : k + 25] + [word()] * k)) for k in range(30)]
    rows += [(50 + k, "\x0b".join(passage)) for k in range(40)]
    check(spark, rows, shard=10, stream=300)
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_a_long_source_spreads_over_shards(spark):
    words = [f"s{k}" for k in range(100_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[500:800])), (4, "only here " * 3)]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit(0).cast("long"))
    met = substring_dedup.passages(docs, SubstringDedup()).collect()
    given = [len(r.windows) for r in met if r.windows]
    assert sum(given) == 100_000 - 12 and len(given) >= 3 and max(given) < 60_000
