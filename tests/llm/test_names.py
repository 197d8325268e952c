"""Stages keep every further column, whatever its name, and every row that they should."""

import pytest

from lectern.llm import decontaminate, line_dedup, quality_rules, simhash
from tests.llm.helpers import frame

NAMES = ["_q_text", "_q_kept", "_l_gone", "_d_doc", "a.b", "row", "h1", "h2", "sig", "left", "begin", "end", "gone_from", "fp", "root", "n", "h", "_salt", "b`c", "kept"]
WORDS = " ".join(f"word{i}" for i in range(40))


@pytest.fixture
def docs(spark):
    own = frame(spark, [WORDS, WORDS + " tail", "a\nb\nc", "q\na\nb\nc", None, ""])
    return own.toDF(*own.columns).selectExpr("*", *[f"{i} AS `{n.replace('`', '``')}`" for i, n in enumerate(NAMES)])


def test_every_stage_keeps_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, "nothing of this kind stands anywhere")], "item_id long, text string")
    for stage in (quality_rules.keep, line_dedup.clean, simhash.survivors, lambda d: decontaminate.clean(d, items)):
        out = stage(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept
        assert all(list(r)[5:] == list(range(len(NAMES))) for r in kept)
        assert stage(docs.where("false")).count() == 0


def test_survivors_keep_different_texts_of_one_doc_id(spark):
    docs = frame(spark, ["a b c d", "quite another text than that one", "a b c d", "a b c d"], [1, 1, 1, 2])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.survivors(docs).collect()) == [(1, "a b c d"), (1, "quite another text than that one")]


def test_contaminated_rows_without_doc_id_go(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = frame(spark, [f"{WORDS} {item} {WORDS}", f"{WORDS} {item} {WORDS}", WORDS, None], [None, 4, 5, None])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in decontaminate.clean(docs, items).collect()), key=repr) == sorted([(5, WORDS), (None, None)], key=repr)
