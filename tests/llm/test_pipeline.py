import corpus_pipeline
from paddock.llm.queries import ORACLE_SQL, QUERIES


def test_stages_and_registration():
    import __spark_entry__ as entry
    numbers = [name.split("_")[0] for name in QUERIES]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "jaccard_join", "substring_dedup", "decontamination", "sentence_pieces"]


def test_every_stage_acts_and_keeps_the_columns(spark, docs_of):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    fresh = " ".join(f"fresh{i}" for i in range(120))
    planted = spark.createDataFrame(
        [(9001, fresh + " tail one", "en", "src1", 1), (9002, fresh + " tail two", "en", "src1", 1),
         (9003, " ".join(f"own{i}" for i in range(200)) + " " + " ".join(f"fresh{i}" for i in range(60)), "en", "src1", 1),
         (9004, " ".join(f"leak{i}" for i in range(90)) + " " + item, "en", "src1", 1),
         (9005, " ".join(f"clean{i}" for i in range(90)), "en", "src1", 1), (9006, None, None, None, None),
         (None, "a row without an id", "en", "src1", 19)], docs.schema)
    now = docs.unionByName(planted)
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        now = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(now.count())
    left = {r.doc_id: r for r in now.collect()}
    assert 9005 in left and 9001 in left and 9002 not in left and 9004 not in left
    assert left[9003].text.split()[-1] == "own199" and left[9003].n_chars == len(left[9003].text)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < docs.count() + 7
    ids = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert ids.count() == now.count() and ids.filter("NOT exact").count() == 0


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0


def test_near_duplicates_drops_repeated_rows_by_one_rule(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    nulls = [(None, text, "en", "s", 1), (None, text, "en", "s", 1)]
    rows = [(7, text, "fr", "s2", None), (7, text, "en", "s1", 5), (7, text, "en", "s1", 5), (7, other, "de", None, 1),
            (8, other, "en", "s", 1), (9, text + " x", "en", "s", 1)]
    for given in (nulls, nulls + rows, rows):
        out = [tuple(r) for r in corpus_pipeline.near_duplicates(
            spark, spark.createDataFrame(given, schema).repartition(3), "").collect()]
        want = (nulls if given[0] == nulls[0] else []) + ([(7, text, "en", "s1", 5), (7, other, "de", None, 1)] if
                                                          len(given) > 2 else [])
        assert sorted(out, key=str) == sorted(want, key=str)
