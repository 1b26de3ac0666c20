import corpus_pipeline
from docloom.llm import quality


def test_stages_on_a_folder_of_tables(spark, make, write):
    body = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    passage = "this passage of well over fifty characters is shared by two documents"
    rows = [(1, body), (2, body), (3, other + " " + passage), (4, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 " + passage), (5, "short"), (6, None)]
    folder = write(make(rows), "documents")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen.append({r.doc_id: r for r in docs.collect()})
    assert set(seen[0]) == {1, 2, 3, 4}
    assert seen[1][1].text == body and seen[1][2].text == ""
    assert 1 in seen[2] and passage in seen[2][4].text
    assert passage not in seen[3][4].text and passage in seen[3][3].text
    assert set(seen[4]) == set(seen[3])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "ids"} <= set(got.columns) and got.count() > 100
    good = {r.doc_id for r in quality.op3(spark, "/root/testdata/sf0.001").where("kept").collect()}
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} <= good
