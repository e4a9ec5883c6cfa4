"""Each stage of the pipeline on its own input, against a plain version."""

import pyarrow as pa
import pytest

import corpus_pipeline
from recollect.llm import decontam, pieces, quality, tables

from .test_neardup import plain
from .test_pii import plain as spans


def test_stages(spark, documents, sf_dir):
    columns, docs = documents.columns, documents
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = tables.written(stage(spark, docs, sf_dir), "stage")
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "quality classifier":
            good = {r.doc_id for r in quality.score_documents(docs, tables.read(spark, sf_dir, "labels")).where("score >= 0.5").collect()}
            assert after.keys() == good
        elif name == "MinHash near-dedup":
            want = plain([(k, r.text) for k, r in before.items()], 5)
            assert after.keys() == {k for k, (_, c) in want.items() if c == k}
        elif name == "benchmark decontamination":
            leaks = {r.doc_id for r in decontam.matches(docs, tables.read(spark, sf_dir, "benchmark")).collect()}
            assert after.keys() == before.keys() - leaks
        elif name == "PII":
            assert after.keys() == before.keys()
            for k, r in after.items():
                if spans(before[k].text):
                    assert not spans(r.text) and len(r.text) == r.n_chars
                else:
                    assert r.text == before[k].text
        else:
            assert after.keys() == before.keys() and all(r.lossless for r in after.values())
            assert {r.doc_id: r.text for r in pieces.decode(out).collect()} == {k: r.text for k, r in before.items()}
            continue
        assert out.columns == columns
        docs = out


def test_leaks_go_whatever_the_columns_are_called(spark):
    from recollect.llm import decontam

    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"before {item} after", 7, 8), (2, "clean words", 7, 8), (None, None, 7, 8)], "doc_id long, text string, _key int, row int")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]


def test_workers_drop_what_a_task_held():
    from recollect.llm import tables

    dropped = []

    def work(batches):
        for x in batches:
            if x < 0:
                raise ValueError(x)
            yield x + 1

    assert list(tables.lean(work, lambda: dropped.append(1))([1, 2])) == [2, 3] and dropped == [1]
    with pytest.raises(ValueError):
        list(tables.lean(work, lambda: dropped.append(2))([1, -1]))
    assert dropped == [1, 2]


def test_no_piece_model_stays_in_a_worker(spark):
    from recollect.llm import pieces

    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)
    pieces.encode(docs).collect()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pieces.model_of.cache_info().currsize])], ["n"])

    assert {r.n for r in spark.range(8).mapInArrow(held, "n long").collect()} == {0}
