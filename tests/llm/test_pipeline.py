import random

import corpus_pipeline
from lectern.llm import line_dedup, packing
from tests.llm.helpers import SCHEMA
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_line_dedup import brute as deduped
from tests.llm.test_quality_rules import brute_kept
from tests.llm.test_packing import brute_ids, sound
from tests.llm.test_simhash import brute_print, brute_roots

BENCH = "item_id long, text string"


def tables(spark, folder):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n))
    items = [para(20) for _ in range(5)]
    texts = ["\n".join(para(rng.randint(5, 30)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    shared = "\n".join(para(8) for _ in range(5))
    texts += [f"{para(30)}\n{shared}\n{para(30)}" for _ in range(5)]
    texts += [texts[0], texts[1] + " tail", f"{para(40)} {items[0]} {para(40)}", "short", None, "", " ".join(w + "####" for w in para(60).split()), "same words again and on " * 30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return dict(enumerate(items))


def test_run_equals_brute_force(spark, tmp_path):
    items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], 0) for r in docs.collect()]
    assert sorted(texts) == sorted(i for i, k in brute_kept(rows).items() if k)
    assert 40 <= len(texts) < docs.count()
    order = sorted(texts)
    out = deduped([texts[i] for i in order])
    texts = {i: out[k] for k, i in enumerate(order) if out[k] != "" or "" == texts[i]}
    order = sorted(texts)
    roots = brute_roots([brute_print(texts[i]) for i in order])
    texts = {i: texts[i] for k, i in enumerate(order) if roots[k] == k}
    for d, _, _ in contained(texts, items):
        texts.pop(d, None)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in rows}) == sorted(texts)
    for r in rows:
        ids = brute_ids(texts[r["doc_id"]])
        assert r["length"] == min(packing.LENGTH, len(ids) - r["start"])
    sound(rows)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("lang", "lang").selectExpr("*", "1 AS extra", "2 AS blob")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_line_stage_sets_n_chars(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "en", "s", 5), (2, "a\nb\nc\nd", "en", "s", 7)], SCHEMA)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.clean(docs).collect()) == [(1, "a\nb\nc", 5), (2, "d", 1)]
