"""A third, or all, of the rows with one id or none: samples, joins and models hold."""

import random

import pytest
from pyspark.sql import functions as F

from awardlens.llm import language, ngram_join, quality_classifier, toxicity
from awardlens.llm.common import bounded_sample

ENGLISH = "the of and to in is that it was for on are with as his they be at this".split()
GERMAN = "der die und das nicht ist von mit dem den des sich auf ein eine als auch".split()


def corpus(spark, shape, n=3000):
    rng = random.Random(4)
    ids = {
        "third": lambda k: 7 if k % 3 == 0 else k,
        "null third": lambda k: None if k % 3 == 0 else k,
        "all": lambda k: 7,
        "all null": lambda k: None,
    }[shape]
    rows = []
    for k in range(n):
        words = ENGLISH if k % 2 else GERMAN
        text = " ".join(rng.choices(words, k=30)) + f" {rng.random()}"
        rows.append((ids(k), text, "en" if k % 2 else "de"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


SHAPES = ["third", "null third", "all", "all null"]


@pytest.mark.parametrize("shape", SHAPES)
def test_samples_are_full(spark, shape):
    docs = corpus(spark, shape)
    for seed in range(4):
        counts = {r["lang"]: r["count"] for r in bounded_sample(docs, "lang", 100, seed).groupBy("lang").count().collect()}
        assert counts == {"en": 100, "de": 100}
    copies = docs.union(docs.limit(1).crossJoin(spark.range(5000)).drop("id"))
    found = bounded_sample(copies, "lang", 100)
    assert found.count() == found.distinct().count() == 200
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('l', id % 1500) AS lang")
    assert bounded_sample(many.union(many.where("lang = 'l3'")), "lang", 5, max_groups=10).select("lang").distinct().count() == 10


@pytest.mark.parametrize("shape", SHAPES)
def test_models_learn(spark, shape):
    docs = corpus(spark, shape)
    models = language.fit(docs, per_language=50)
    assert set(models) == {"de", "en"}
    found = language.identify(docs.limit(200), models)
    assert found.count() == 200
    rows = quality_classifier.classify(docs.limit(600), per_side=50)
    assert rows.count() == 600 and rows.where("score IS NULL").count() == 0
    labels = docs.select("doc_id", (F.col("lang") == "en").cast("int").alias("toxic"))
    toxicity.score(docs.limit(50), toxicity.fit(docs, labels, per_label=20)).collect()


@pytest.mark.parametrize("shape", SHAPES)
def test_near_copies_stay_linear_with_repeated_ids(spark, shape):
    docs = corpus(spark, shape, 900)
    near = docs.withColumn("text", F.concat("text", F.lit(" end")))  # each has a partner with the same id
    both = docs.union(near).union(docs)
    found = ngram_join.near_copies(both)
    assert found.count() == 2700
    assert found.where("class_size < 3").count() == 0
    signed, _ = ngram_join._classes_of(both)
    assert signed.count() == 2700
    kept = [row.text for row in ngram_join.keep_one_each(both).collect()]
    assert len(kept) <= 900 and len(set(kept)) == len(kept)
    alone = {text.removesuffix(" end") for text in kept}
    assert len(alone) == len(kept)  # of a text and its near copy one stays


def test_texts_meet_their_own_classes_only(spark):
    texts = [f"text number {k} of all those without an id" for k in range(300)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    wanted = spark.createDataFrame(
        [(k, k, 1, ngram_join._digest(ngram_join.words_of(t)), None, 1, t) for k, t in enumerate(texts)],
        "root long, number long, size long, digest binary, first_id long, blocks long, text string",
    ).withColumn("first_hash", F.xxhash64("text")).drop("text")
    for repeated in (False, True):
        rows = ngram_join._texts_of_classes(docs, wanted, repeated).collect()
        assert sorted(row.text for row in rows) == sorted(texts)
    thrice = docs.union(docs).union(docs)
    assert ngram_join._texts_of_classes(thrice, wanted, True).count() == 300
