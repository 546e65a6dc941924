import corpus_pipeline
from tessella.llm import decontam, langid
from tests.conftest import SMALL


def test_stages_in_order_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns, name
        frames.append(docs)
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3]
    assert set(langid.identified(frames[1], langid.fit(frames[1])).select("lang_pred").toPandas().lang_pred) >= {"en"}
    texts = [r.text for r in frames[2].collect()]
    assert len(texts) == len(set(texts))
    assert decontam.contaminated(frames[3], spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    words = lambda f: sum(len(r.text.split()) for r in f.collect())
    assert 1.2 < words(frames[4]) / words(frames[3]) < 1.8
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == seen[4]
    assert sorted(r.start for r in last)[-1] + max(last, key=lambda r: r.start).n_tokens == sum(r.n_tokens for r in last)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0, name


def test_odd_rows(spark):
    """Nulls in any column, ties, repeated rows, empty and long texts and clashing columns pass all stages."""
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = whole.where("text IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(30)
    text, long = good.first().text, " ".join(f"word{i} und so" for i in range(60_000))
    rows = [(None, text, "en", "a", 3), (7, None, "en", None, None), (8, "", None, "b", 0), (9, "² 123", "de", "a", 5), (9, long, None, None, 9), (9, long, None, None, 9), (None, text + " and more of it than before", None, "c", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = odd.selectExpr(*[f"CAST({c} AS {dict(whole.dtypes)[c]}) AS {c}" for c in whole.columns]).unionByName(good)
    docs = docs.selectExpr("*", "1 AS _row", "'x' AS _id", "2L AS fp", "'y' AS key", "3 AS size", "4 AS start", "'z' AS _hash", "5 AS block", "6 AS shard")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
        assert {(r._row, r._id, r.fp, r.key, r["size"], r.start, r._hash, r.block, r.shard) for r in docs.collect()} == {(1, "x", 2, "y", 3, 4, "z", 5, 6)}, name
    # Language: the null, empty and letterless texts go. Near duplicates: one of the long rows, and one of the first text's, stay.
    assert counts[0] == 34
    assert counts[1] <= 32
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == counts[3]
