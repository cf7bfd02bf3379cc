import corpus_pipeline
from quarrylens.llm import near_dedup

A, B = ("alpha " + " ".join(f"{c}{i}" for i in range(40)) for c in "ab")


def test_stages_keep_one_row_of_each_class(spark):
    rows = [(1, A, 0), (1, A, 0), (2, A, 0), (2, B, 0), (None, B, 0), (3, B + " x", 0), (None, "c d", 0), (None, "c d", 1), (8, None, 0), (9, "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x_id int").repartition(3)
    exact = corpus_pipeline.drop_copies(spark, df, "")
    assert exact.columns == df.columns
    want = [(1, A, 0), (2, B, 0), (3, B + " x", 0), (8, None, 0), (9, "e", 0), (None, "c d", 0)]
    assert sorted(map(tuple, exact.collect()), key=str) == sorted(want, key=str)
    near = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, df, "").select("doc_id", "text").collect()), key=str)
    assert near == sorted([(1, A), (2, B), (8, None), (9, "e"), (None, "c d")], key=str)


def test_an_id_stands_for_all_its_texts(spark):
    rows = [(5, A), (7, B), (6, A), (6, B), (9, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(df).collect())
    assert got == [(5, 5), (6, 5), (6, 5), (7, 5), (9, 9)]
