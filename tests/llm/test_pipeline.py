"""The pipeline's stages against brute force, and odd tables."""
import numpy as np

import corpus_pipeline
from presswork.llm import simhash
from presswork.llm.common import worker_slot


def _kept(rows):
    """Ids that stay: the smallest of each component of fingerprints within three bits; rows without an id go only beside one with."""
    prints = [simhash.fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    ids = {}
    for r, row in zip(root, rows):
        ids.setdefault(r, []).append(row[0])
    return sorted(min(i) for i in ids.values())


def test_near_duplicate_stage_keeps_one_of_each(spark, corpus):
    rows = [r for r in corpus.rows]
    base = " ".join(f"w{i * 7919 % 1013}" for i in range(600))
    rows += [(2000 + k, base.replace(f" w{7919 * k % 1013} ", f" changed{k} ", 1), None, None, None) for k in range(1, 30)]
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, corpus.frame(spark, rows), "").orderBy("doc_id").collect()]
    assert got == _kept(rows)
    assert len(got) < len(rows) - 20


def test_stage_with_odd_rows(spark, corpus):
    docs = corpus.frame(spark, [*corpus.rows, (None, "without an id", None, None, None), (None, None, None, None, None)])
    docs = docs.selectExpr("*", "lang AS fp", "source AS tk", "1 AS component_id", "doc_id AS _id")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert got.filter("text = 'without an id'").count() == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def _tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_runs_on_odd_tables(spark, corpus, tmp_path):
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sf = _tables(spark, tmp_path / "odd", corpus.frame(spark, [*corpus.rows, (None, None, None, None, None)]), labels)
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and all(r["offset"] + r["length"] <= 4096 for r in got)
    sf = _tables(spark, tmp_path / "empty", corpus.frame(spark, []), labels.limit(0))
    assert corpus_pipeline.run(spark, sf).count() == 0


def _own_mb():
    with open("/proc/self/status") as lines:
        return next(int(x.split()[1]) for x in lines if x.startswith("RssAnon")) / 1024


def test_a_worker_gives_back_what_the_operator_before_kept():
    """Between stages a worker lies idle beside the executor's heap."""
    worker_slot("one")["rows"] = [np.ones(512) for _ in range(30_000)]
    above = np.ones(512)  # keeps the allocator's end where it is
    most = _own_mb()
    assert worker_slot("another") == {}
    assert above.sum() and _own_mb() < most - 60


def test_stages_send_short_batches(spark, corpus):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for asked, got in (("10000", 1000), ("0", 1000), ("7", 7)):
            spark.conf.set(key, asked)
            corpus_pipeline.drop_repeated_strings(spark, corpus.frame(spark), "")
            assert int(spark.conf.get(key)) == got
    finally:
        spark.conf.set(key, before)


def test_packing_patterns_need_no_python_workers(spark, corpus, tmp_path):
    """A list of rows would be unpacked by workers of their own, beside those that encode."""
    corpus.frame(spark).write.parquet(f"{tmp_path}/docs")
    plan = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/docs"), "")._jdf.queryExecution().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
