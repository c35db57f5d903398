import re
from collections import Counter

import corpus_pipeline
from articleflow.llm import quality
from pyspark.sql import functions as F
from test_secrets import brute as secrets_of
from test_substring_dedup import brute as repeats_of

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def kept_by_brute_force(rows):
    bags = {r.doc_id: shingles(r.text) for r in rows}
    label = {i: i for i in bags}
    links = []
    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = bags[i], bags[j]
            total = sum((a | b).values())
            if total and sum((a & b).values()) / total >= 0.8:
                links.append((i, j))
    for _ in ids:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {i for i in ids if label[i] == i}


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        old = {r.doc_id: r for r in before}
        if name != "packing":
            assert made.columns == columns
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
            assert {r.doc_id for r in rows} == good and all(old[r.doc_id] == r for r in rows)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in rows} == kept_by_brute_force(before)
        elif name == "substring dedup":
            lost = {i: gone for i, _, gone, _ in repeats_of([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id for r in rows} == set(lost)
            for r in rows:
                assert (r.text == old[r.doc_id].text) == (not lost[r.doc_id])
        elif name == "secret scans":
            assert len(rows) == len(before)
            for r in rows:
                assert (r.text == old[r.doc_id].text) == (not secrets_of(old[r.doc_id].text))
                assert not [x for x in secrets_of(r.text) if x[1] < 3]
        else:
            tokens = {}
            for r in rows:
                tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            assert tokens.keys() == old.keys()
            for parts in tokens.values():
                assert sum(n for _, n, _ in parts) == parts[0][2]
        docs, before = made, rows


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, "x y z", "en", None, 5), (2, "", None, "a", 0), (3, "w " * 9000, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema).withColumn("score", F.lit(1)).withColumn("row", F.lit("r"))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            ids = [r.doc_id for r in docs.collect()]
            if not given:
                assert not ids


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    rows = scored.where(quality.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)


def test_near_dedup_loses_no_text_of_a_repeated_id(spark):
    one, two = " ".join(f"one{i}" for i in range(30)), " ".join(f"two{i}" for i in range(30))
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (7, two)], "doc_id long, text string")
    made = {(r.doc_id, r.text) for r in corpus_pipeline.one_per_class(spark, docs, SF).collect()}
    assert {text for _, text in made} == {one, two} and {i for i, _ in made} == {1, 5}
