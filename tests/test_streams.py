"""State between runs of a stream, the index task, and redaction down to the files."""

from pathlib import Path

import pyarrow.parquet as pq

from lectern.operators import review, search
from lectern.sources.store import Store
from lectern.streaming import log, tasks


def reads(spark, path, rows):
    spark.createDataFrame(rows, "document_id string, page_no int, at long").coalesce(1).write.mode("append").parquet(path)


def test_counts_survive_restarts_and_repeated_batches(spark, tmp_path):
    source, checkpoint = f"file://{tmp_path}/reads", f"file://{tmp_path}/checkpoint"
    store = Store(spark, f"file://{tmp_path}/store")
    keys = ["document_id", "page_no"]

    def run():
        stream = log.tail(spark, source, "document_id string, page_no int, at long")
        log.into_store(stream, store, "reads", log.counted(keys), checkpoint).awaitTermination()
        return {(r["document_id"], r["page_no"]): (r["n"], r["first_at"], r["last_at"]) for r in store.table("reads").collect()}

    reads(spark, source, [("a", 1, 5), ("a", 1, 3), ("b", 1, 4)])
    assert run() == {("a", 1): (2, 3, 5), ("b", 1): (1, 4, 4)}
    reads(spark, source, [("a", 1, 9), ("c", 2, 1)])
    expected = {("a", 1): (3, 3, 9), ("b", 1): (1, 4, 4), ("c", 2): (1, 1, 1)}
    assert run() == expected
    # The stream stops after the store's commit and before its own: its last batch comes again.
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    version = store.version()
    assert run() == expected
    assert store.version() == version


def test_the_index_task_and_stream_index_what_is_new(spark, tmp_path):
    index = search.Index(Store(spark, f"file://{tmp_path}/store"), "pages", ["doc_id"])
    pages = spark.range(10).selectExpr("id AS doc_id", "concat('page about item', id) AS text")
    task = tasks.catalogue("2024-01-10", chunk=4, index=index)["search-index"]
    assert task({"pages": pages}) == {"chunks": 3, "indexed": 10}
    assert task({"pages": pages}) == {"chunks": 3, "indexed": 0}
    source = f"file://{tmp_path}/pages"
    spark.createDataFrame([(3, "another text"), (70, "a page on streams")], "doc_id long, text string").write.parquet(source)
    for _ in range(2):
        log.into_index(log.tail(spark, source, "doc_id long, text string"), index, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r["doc_id"] for r in index.search("page").collect()} == {*range(10), 70} - {3}


def test_redacted_words_are_in_no_file(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    pages = spark.createDataFrame([("d1", 1, "the zebra clause"), ("d1", 2, "more zebra"), ("d2", 1, "plain clause")], "document_id string, page_no int, text string")
    events = spark.createDataFrame([(1, "i1", "d1", "amend", '{"x":"zebra"}', None, "zebra said", "h1"), (2, "i2", "d2", "amend", '{"x":"horse"}', None, None, "h2"), (3, "i1", None, "amend", '{"x":"zebra"}', None, None, "h3")], "seq long, row_id string, document_id string, action string, new_value string, previous_value string, note string, row_hash string")
    store.transaction({"pages": pages.where("page_no = 1")})
    store.transaction({"pages": pages, "log": events})
    index = search.Index(store, "search", ["document_id", "page_no"])
    index.add(pages)
    review.redact(store, spark.createDataFrame([("d1",)], "document_id string"), {"pages": ["text"]}, index=index)
    assert {(r["document_id"], r["page_no"], r["text"]) for r in store.table("pages").collect()} == {("d1", 1, None), ("d1", 2, None), ("d2", 1, "plain clause")}
    assert [(r["seq"], r["new_value"], r["row_hash"]) for r in store.table("log").orderBy("seq").collect()] == [(1, None, "h1"), (2, '{"x":"horse"}', "h2"), (3, None, "h3")]
    assert {r["document_id"] for r in index.search("clause").collect()} == {"d2"} and index.search("zebra").count() == 0
    for f in Path(tmp_path).rglob("*"):
        if f.suffix == ".parquet":
            assert "zebra" not in str(pq.read_table(f).to_pylist()), f
        elif f.is_file():
            assert b"zebra" not in f.read_bytes()
