"""The pipeline's stages, each against what it was given."""

import random

import corpus_pipeline as cp
from shapeloom.llm import near_dups, quality

from .test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 20)
    rows = []
    for i in range(240):
        t = " ".join(f"{rng.randrange(10**6)}$$$" for _ in range(60)) if i % 12 == 5 else prose(rng, 60)
        t = rows[-1][1] if i % 10 == 9 else f"{t} {item} {prose(rng, 30)}" if i % 16 == 2 else t
        rows.append((i, t, "en", "ab"[i % 2], len(t), i))
    rows += [(500, None, None, None, None, None), (None, prose(rng, 40), "en", "a", 1, 1), rows[0]]
    d = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, 0 if "$$$" in t else 1, 0) for i, t, *_ in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    now = d
    for name, stage in cp.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = now.collect(), out.collect()
        if name != "token_ids":
            assert out.columns == d.columns
        ids = {r["doc_id"] for r in after}
        if name == "quality":
            assert not any("$$$" in (r["text"] or "") for r in after) and None in ids and 500 not in ids
            assert {r["doc_id"] for r in before if r["text"] and "$$$" not in r["text"]} == ids
        if name == "near_dups":
            texts = [r["text"] for r in after]
            assert len(texts) == len(set(texts)) and {r["text"] for r in before} == set(texts)
        if name == "decontaminate":
            assert ids == {r["doc_id"] for r in before if item not in r["text"]}
        if name == "mix":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and max(map(after.count, after)) <= 3
        if name == "token_ids":
            assert len(after) == len(before)
        now = out
    assert cp.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0


def test_operators_carry(spark):
    d = spark.createDataFrame([(1, "a b c", "en", 5)], "doc_id long, text string, lang string, x long")
    assert near_dups.link(d, carry="x").first()["x"] == 5
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(d, none, carry="x").first()["x"] == 5
