from conftest import SMALL

import corpus_pipeline
from corpusloom.llm.queries import ORACLES, QUERIES
from corpusloom.session import written


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        rows = out.count()
        assert 0 < rows
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert rows <= docs.count()
            docs = written(out, name.replace(" ", "_"))
    packed = corpus_pipeline.run(spark, SMALL).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 4096
