import re

import corpus_pipeline
from frameloom.llm import queries
from tests.llm.test_text_operators import components, plain_words


def test_stages_on_a_small_table(spark, labelled, documents, tmp_path):
    docs, labels = labelled
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.unionByName(documents.filter("doc_id is not null").withColumn("doc_id", documents["doc_id"] + 1000)).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, marks = df.columns, {r.doc_id: r for r in labels.collect()}
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(df.collect())
        assert df.columns == columns or k == 4
    assert not any(not marks[r.doc_id].quality for r in seen[0] if r.doc_id in marks)
    assert sum(marks[r.doc_id].quality for r in seen[0] if r.doc_id in marks) >= 0.98 * sum(m.quality for m in marks.values())
    assert sum(marks[r.doc_id].toxic for r in seen[1] if r.doc_id in marks) <= 2
    want = components([(r.doc_id, r.text) for r in seen[1]])
    assert {r.doc_id for r in seen[2]} == {i for i in want if want[i] == i}
    assert {r.doc_id for r in seen[3]} <= {r.doc_id for r in seen[2]}
    assert len(seen[4]) == len(seen[3]) and all(r.n_tokens == len(r.ids) for r in seen[4])
    assert all(plain_words(r.text) for r in seen[3])


def test_empty_table(spark, labelled, no_documents, tmp_path):
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
