import corpus_pipeline
from flowlens.llm import mixing, simhash, toxicity
from flowlens.llm.common import scratch_path, table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "source mixing", "best-fit packing"]
    columns, sizes = docs.columns, [docs.count()]
    grammar = toxicity.learn(docs, table(spark, sf, "labels"))
    rejected = {r["doc_id"] for r in toxicity.score_documents(docs, grammar).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "toxicity":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()} == rejected
        if name == "line dedup":
            assert sizes[-1] == sizes[-2] and docs.where("n_chars <> length(text)").count() == 0
        if name == "SimHash near-dedup":
            assert sizes[-1] == simhash.near_duplicates(before).select("component_id").distinct().count()
        if name == "source mixing":
            assert sizes[-1] == mixing.mix(before).selectExpr("sum(copies)").first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == sizes[-1]


def test_stages_with_odd_rows_and_empty_tables(spark, sf, odd, none):
    """Nulls in any column, empty and long texts, a repeated row, clashing names."""
    rows = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    (_, toxic), (_, lines), (_, near), (_, mix), (_, packing) = corpus_pipeline.STAGES
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    kept = toxic(spark, odd, sf)
    assert kept.columns == odd.columns and {"3", "5", "None"} <= set(rows(kept))
    cut = lines(spark, odd, sf)
    assert cut.columns == odd.columns and rows(cut) == rows(odd)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[2] == "" and cut.where("doc_id = 3 and text is null").count() == 1
    assert cut.where("removed_lines <> 'own'").count() == 0
    assert rows(near(spark, odd, sf)) == ["1", "3", "7", "8", "9", "None"]
    path = scratch_path(spark, "odd")
    odd.write.parquet(path)
    mixed = mix(spark, spark.read.parquet(path), sf)
    assert mixed.columns == odd.columns and {"3", "5", "6"}.isdisjoint(rows(mixed)) and mixed.where("size <> 'own'").count() == 0
    packed = packing(spark, odd, sf)
    assert packed.where("doc_id in (3, 5) and length = 1").count() == 2 and packed.where("doc_id = 8").count() == 2


def test_the_stages_put_together(spark, sf):
    """run() gives what its stages give one after another, whatever order the rows come in."""
    want = table(spark, sf, "documents").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "again")
        stage(spark, want, sf).write.parquet(path)
        want = spark.read.parquet(path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
