from collections import Counter

import corpus_pipeline
from orrerylake.llm import decontaminate, quality_rules

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(benchmark)
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF).cache()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(kept[-1][1] if kept else ids), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept.append((name, ids))
        now = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").select("doc_id").collect()}
    assert set(kept[0][1]) == good
    # One of each group: no two equal texts stay, and each text that went has an equal or similar one that stayed.
    single = kept[1][1]
    assert max(Counter(texts[i] for i in single).values()) == 1
    assert {texts[i] for i in good if list(texts.values()).count(texts[i]) > 1} & {texts[i] for i in single}
    assert set(kept[2][1]) == {i for i in single if not any(m[4] for m in matcher.find(texts[i]))}
    assert 0 < len(kept[3][1]) < len(kept[2][1]) and sorted(kept[4][1]) == sorted(kept[3][1])
    slots = [(r.shard, r.slot) for r in now.collect()]
    for s, n in Counter(x for x, _ in slots).items():
        assert sorted(t for x, t in slots if x == s) == list(range(n))


def test_run_gives_what_the_stages_give(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[-3:] == ["tokens", "shard", "slot"] and got.count() > 0


def test_run_bears_nulls_repeats_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (None, text + " more", None, None, None), (3, None, "en", None, 0), (4, "", None, "src2", 0), (5, "x " * 200_000, "de", "src2", 1), (6, "short", "en", "src1", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, some in (("some", rows), ("none", [])):
        home = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(home / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0)] if some else [], "doc_id bigint, quality int, toxic int").write.parquet(str(home / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "an item that stands in no document at all")] if some else [], "item_id bigint, text string").write.parquet(str(home / "benchmark.parquet"))
        docs, seen = spark.read.parquet(str(home / "documents.parquet")), []
        for stage, f in corpus_pipeline.STAGES[:3]:
            docs = f(spark, docs, str(home))
            seen.append([r.doc_id for r in docs.collect()])
        # One of the row that stands twice and its near copy stays, and goes through.
        assert seen == ([[1, 1, None], [1], [1]] if some else [[], [], []]) or sorted(map(str, seen[0])) == ["1", "1", "None"] and seen[1:] == [[1], [1]]
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(home)).collect()} <= {1}


def test_own_columns_stay(spark, tmp_path):
    """Columns named like those that the stages make keep their values and types through all stages."""
    own = ["rule", "kept", "counts", "size", "tokens", "shard", "slot", "text_crc32", "mix", "matches", "_key", "_rid", "toxicity"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", *[f"concat('{c}-', doc_id) AS {c}" for c in own])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in own)
