import zlib

import corpus_pipeline
from vitrine.llm import queries


def test_stages_keep_columns_and_apply(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "SimHash near-dedup")).collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and 0 in ids and 1 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["piece"] == 0 for r in packed) == docs.count()


def test_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_junk_goes_and_clean_documents_stay(spark, tmp_path):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    good = [" ".join(word() for _ in range(80)) for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(60)]
    rows = list(enumerate(good + bad + good[:5]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    ids = {x["doc_id"] for x in kept.select("doc_id").collect()}
    assert not ids & set(range(150, 210)) and len(ids & set(range(150))) >= 148
    left = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path)).select("doc_id").collect()}
    assert left == {i for i in ids if i < 150}


def test_queries_are_named_by_number():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert zlib.crc32(b"") == 0


def test_rows_without_an_id_or_with_a_repeated_one_stay(spark):
    import random

    r = random.Random(11)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(80))
    t = [text() for _ in range(9)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (1, t[3]), (1, t[4]), (2, t[5]), (3, t[5]), (3, t[6]), (None, t[7]), (4, t[7]), (5, t[8]), (5, t[8]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(corpus_pipeline.drop_near_duplicates(spark, docs, "").collect(), key=str)
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (1, t[3]), (1, t[4]), (2, t[5]), (3, t[6]), (4, t[7]), (5, t[8]), (None, None)]
    assert got == sorted((docs.sparkSession.createDataFrame(want, docs.schema)).collect(), key=str)
