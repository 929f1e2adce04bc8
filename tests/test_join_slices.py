"""The near-duplicate join hashes texts in small slices, whatever the batch holds."""

from folio.llm import metric_join


def test_hashing_takes_a_megabyte_at_a_time(spark, monkeypatch):
    hash_all = metric_join.shingle_sets

    def bounded(column, size):
        assert column.nbytes < 1_500_000, column.nbytes
        return hash_all(column, size)

    monkeypatch.setattr(metric_join, "shingle_sets", bounded)
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(2000)) for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in metric_join.classify(rows).collect()}
    assert found == {i: i - i % 2 for i in range(400)}
