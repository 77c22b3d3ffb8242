import zlib

import numpy as np
import pytest

from wardline.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    truth = {r.doc_id: r for r in docs.collect()}
    rows = langid.language_of_documents(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id].text))
    held = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean(held) > 0.98


def test_mixed_documents(spark):
    docs = spark.read.parquet(SF)
    model = langid.fit(docs)
    pure = docs.join(langid.proportions(docs, model).filter("size(langs) = 1 AND score > 0"), "doc_id").filter("lang = lang_pred AND n_chars > 2000")
    by = {l: pure.filter(pure.lang == l).orderBy("doc_id").first().text.split() for l in ("en", "fr", "de")}
    for parts in ({"en": 300, "fr": 100}, {"de": 150, "en": 150}, {"fr": 200, "de": 120, "en": 80}):
        text = " ".join(w for l, n in parts.items() for w in by[l][:n])
        row = langid.proportions(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
        assert set(row.langs) == set(parts)
        for l, share in zip(row.langs, row.shares):
            assert share == pytest.approx(parts[l] / sum(parts.values()), abs=0.12)


def test_expectation_maximisation_against_plain():
    rng = np.random.default_rng(3)
    like = rng.uniform(0.02, 1, (60, 3)) ** 4
    like /= like.max(axis=1, keepdims=True)
    got = langid.mixture(np.log(like).astype(np.float32), np.array([60]), 0.0, rounds=3000)[0]
    p = np.full(3, 1 / 3)
    for _ in range(3000):
        r = like * p
        p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    assert got == pytest.approx(p, abs=0.03)


def test_word_ngrams_do_not_depend_on_neighbours():
    words = [b"a", "größe".encode(), b"x" * 50]
    codes, starts = langid.gram_codes(words, 1 << 12)
    for w, part in zip(words, np.split(codes, starts[1:])):
        assert part.tolist() == langid.gram_codes([w], 1 << 12)[0].tolist() and len(part) == len(w)


def test_hard_rows(spark):
    docs = spark.createDataFrame(
        [(None, "the cat", "en"), (1, None, "en"), (2, "", None), (3, "12 — 34!", "en"), (4, "le chat", "fr"), (4, "le chat", "fr"),
         (5, "the dog " * 40_000, "en"), (6, "ß", "fr"), (7, "the", None)],
        "doc_id bigint, text string, lang string",
    ).selectExpr("*", "1 AS score", "'x' AS langs", "2 AS LANG_PRED")
    rows = langid.language_of_documents(docs).collect()
    assert len(rows) == 9
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (1, 2, 3)) for r in rows)
    assert langid.language_of_documents(docs.limit(0)).count() == 0
    nothing = langid.proportions(docs, langid.fit(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
