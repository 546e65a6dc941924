import zlib

from tessella.llm import langid
from tests.conftest import SMALL


def test_held_out_documents_are_identified(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = langid.query(spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) >= 0.97
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_prediction_looks_at_the_text_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    a = {r.doc_id: r.lang_pred for r in langid.identified(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.identified(docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "'s' AS source"), model).collect()}
    assert {k + 1: v for k, v in a.items()} == b


def test_mixtures_are_found():
    import numpy as np

    one, two = "der die das und nicht mit sich auf für ist im dem nicht ein eine als auch es an werden", "the and of to that with for are this from have they which would their been there when"
    counts = {}
    for lang, text in (("de", one), ("en", two)):
        grams, _, _ = langid.trigrams([text * 20])
        counts[lang] = np.bincount(grams, minlength=langid.TABLE)
    model = langid.Model.learned(counts)
    found = langid.infer(model, [one * 6 + " " + two * 3, one * 9, two])
    assert found[0][0] == "de" and 0.55 < found[0][1] < 0.8
    assert found[1][:2] == ("de", 1.0) and found[2][:2] == ("en", 1.0)


def test_a_mixture_may_have_all_languages_and_is_that_of_plain_em():
    import numpy as np

    words = {k: " ".join(a + b for a in part for b in part) for k, part in {"aa": ["bam", "dol", "gir", "kep"], "bb": ["xuq", "vyz", "jow", "zyx"], "cc": ["éla", "çon", "ôti", "ûre"], "dd": ["ßer", "ärn", "öhl", "üch"], "ee": ["ñat", "íco", "óba", "úga"]}.items()}
    counts = {}
    for lang, text in words.items():
        grams, _, _ = langid.trigrams([text * 10])
        counts[lang] = np.bincount(grams, minlength=langid.TABLE)
    model = langid.Model.learned(counts)
    text = " ".join(words[k] for k in "aa aa aa bb bb cc cc dd ee".split())
    lang, score, mixture = langid.infer(model, [text])[0]
    assert lang == "aa" and len(mixture.split()) == 5
    # Plain expectation-maximisation, one word and language at a time.
    grams, starts, _ = langid.trigrams([text])
    logs = np.add.reduceat(model.table[grams], starts, axis=0).astype(float)
    p = np.exp(logs - logs.max(1)[:, None]) * (1 - langid.BACKGROUND) + langid.BACKGROUND
    share = [0.2] * 5
    for _ in range(langid.ROUNDS):
        total = [0.0] * 5
        for word in p:
            whole = sum(s * x for s, x in zip(share, word, strict=True))
            for k in range(5):
                total[k] += share[k] * word[k] / whole
        share = [t / len(p) for t in total]
    assert abs(share[0] - score) < 1e-6


def test_odd_rows(spark):
    rows = [(1, "das ist gut und schön", "de"), (2, None, "de"), (3, "", None), (4, "123 !? 45", "en"), (5, "the cat and the dog", "en"), (5, "the cat and the dog", "en"), (None, "und das ist", None), (8, "the and " * 100_000, "en"), (9, "…é…", None), (10, "² ½ ①", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'z' AS _row")
    got = langid.identified(docs, langid.fit(docs)).collect()
    assert sorted(r.doc_id or 0 for r in got if r.lang_pred == "und") == [2, 3, 4, 10]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 5, 8, 9]
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}
    assert langid.identified(docs.limit(0), langid.fit(docs)).count() == 0
