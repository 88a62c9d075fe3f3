"""The pipeline's stages, one after another, on awkward and on given documents."""

from collections import Counter

import corpus_pipeline
from pagewatch.llm import quality
from tests.llm.data import documents
from tests.llm.test_documents import brute_exact
from tests.llm.test_near import brute_kept

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    return out


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    read, good, single, apart, mixed, ids = stages(spark, docs)
    for df in (good, single, apart, mixed):
        assert df.schema.names == read.schema.names
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    verdicts = quality.graded(docs, quality.learn(docs, labels)).filter("kept")
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(r["id"] for r in verdicts.collect())
    marked = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    lost = marked - {d for d, _ in rows(good)}
    failed = {r["id"] for r in quality.graded(docs, None).filter("base_failed").collect()}
    assert not lost - failed  # clean documents stay
    kept = {d for d, _ in rows(single)}
    want, groups = brute_exact(rows(good))
    assert kept == {k[1] for k in want} and single.count() == groups
    want, groups = brute_kept(rows(single))
    assert {d for d, _ in rows(apart)} == want and apart.count() == groups
    assert {d for d, _ in rows(mixed)} <= {d for d, _ in rows(apart)}
    assert Counter(r["doc_id"] for r in ids.collect()) == Counter(d for d, _ in rows(mixed))


def test_awkward_and_empty_documents(spark):
    for docs in (documents(spark), documents(spark, [])):
        out = stages(spark, docs)
        assert out[-2].columns == docs.columns
    long_ = documents(spark, [f"word{i % 60} text{i} more{i}" + " filler words here" * 2 + f" x{k} " + " ".join(f"w{j}" for j in range(80)) for i in range(3) for k in range(3)])
    assert stages(spark, long_)[-1].count() >= 1
