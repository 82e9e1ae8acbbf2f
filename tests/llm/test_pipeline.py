import re
import sys
from itertools import combinations

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_joins import grams

from unitwise.llm import mixing, packing, quality
from unitwise.session import staged_since, staged_tables

SF = "/root/testdata/sf0.001"


def test_every_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, function in pipeline.STAGES:
        function(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs, out)
        if name != "best_fit_packing":
            assert out.columns == columns
        docs = out

    before, after = kept["quality_classifier"]
    want = quality.classify(before, labels).filter("predicted = 1")
    assert {r.doc_id for r in want.collect()} == {r.doc_id for r in after.collect()}

    before, after = kept["exact_dedup"]
    bare = lambda t: re.sub("[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in before.collect():
        best.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(min(own)[1] for own in best.values())

    before, after = kept["ngram_jaccard_join"]
    rows = {r.doc_id: grams(r.text) for r in before.collect()}
    near = lambda a, b: rows[a] and 100 * len(rows[a] & rows[b]) >= 75 * len(rows[a] | rows[b])
    stay = {r.doc_id for r in after.collect()}
    assert not [p for p in combinations(sorted(stay), 2) if near(*p)]
    linked = {x for p in combinations(sorted(rows), 2) if near(*p) for x in p}
    assert set(rows) - linked <= stay

    before, after = kept["mixing"]
    copies = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rated = mixing.mixing(before, mixing.domains_of(labels)).collect()
    assert all(abs(copies.get(r.doc_id, 0) - r.rate) < 1 for r in rated)

    before, after = kept["best_fit_packing"]
    assert after.filter("piece = 0").count() == before.count()
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert fill.filter(f"n > {packing.CAPACITY} OR n <> e").count() == 0


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], docs.schema)
    for _, function in pipeline.STAGES:
        assert function(spark, docs.limit(0), SF).count() == 0
        assert function(spark, odd, SF).count() <= 3 * len(odd.columns)


def test_stages_built_before_either_is_written_keep_their_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mark = staged_tables()
    one = pipeline.near_copies(spark, docs, SF)
    two = pipeline.near_copies(spark, docs.limit(50), SF)
    read = {name.split("/")[-2] for name in one.inputFiles() + two.inputFiles()}
    assert {path.rsplit("/", 1)[1] for path in staged_since(mark)} <= read
    assert two.count() <= 50 < one.count()
    left = staged_tables()
    out = pipeline.run(spark, SF)
    assert staged_tables() == left and out.count() > 0


def test_pipeline_is_registered_with_its_steps():
    assert [f.__name__ for _, f in pipeline.STAGES] == [
        "quality_classifier", "exact_copies", "near_copies", "mix_domains", "pack"]
    assert pipeline.ORACLE_SQL is None and "unitwise.llm.quality" in sys.modules
