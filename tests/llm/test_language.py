import random
import zlib

import numpy as np

from skirmish.llm import language

from .helpers import SCHEMA, awkward, clashing, frame

STEMS = {"aa": "the and ing tion er wh sh", "bb": "der die ung keit sch lich ein", "cc": "le la eau oux tion que ment", "dd": "el los ado ción que rr ña"}


def texts(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 4]
        stems = STEMS[lang].split()
        rows.append((i, " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return rows


def test_held_out_accuracy(spark):
    rows = texts()
    docs = clashing(frame(spark, rows))
    model = language.train(language.training_rows(docs), sample=50)
    got = language.predict(docs.drop("lang").withColumnRenamed("n", "lang"), model).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert [r["held_out"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got]
    assert len(held) > 50 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_texts_without_letters_and_awkward_rows(spark):
    model = language.train(language.training_rows(frame(spark, texts(80))))
    rows = awkward() + [(900, "12 34 -- _", "aa", "s", 0), (901, "½ ² ① Ⅷ", "aa", "s", 0), (902, "½ ² ª", "aa", "s", 0), (None, "ung keit", None, None, None)]
    got = {r["doc_id"]: r for r in language.predict(frame(spark, rows), model).collect()}
    for doc, text, *_ in rows:
        letters = any(c.isalpha() for c in text or "")
        assert (got[doc]["lang_pred"] in STEMS) == letters and (letters or (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0))
    kept = language.keep_known(frame(spark, rows), model)
    assert kept.columns == frame(spark, []).columns
    want = {d for d, r in got.items() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_without_training_rows_nothing_is_determined(spark):
    model = language.train(language.training_rows(spark.createDataFrame([], SCHEMA)))
    assert {r["lang_pred"] for r in language.predict(frame(spark), model).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_one_language(spark):
    model = language.train(language.training_rows(frame(spark, [(i, "abc def", "xx", "s", 0) for i in range(9)])))
    assert model.predict("abc")[0] == "xx"


def test_codewords_keep_their_distance():
    for n, least in ((2, 1), (4, 4), (7, 32), (20, 8), (60, 8)):
        code = language.codewords(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= least


def test_one_wrong_bit_is_corrected():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((language.BUCKETS, code.shape[1]), np.float32), np.full(code.shape, 1 / code.shape[1]))
    for i in range(4):
        for wrong in range(code.shape[1]):
            margin = code[i] * 5.0
            margin[wrong] *= -1
            model.margins = lambda text, m=margin: m
            assert model.predict("x")[0] == "abcd"[i]


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "größe und weite " * 70_000
    whole = language.ngram_counts(text)
    assert whole.sum() == 3 * len(text) - 3


def plain_counts(text):
    """Hashed n-grams, one by one."""
    fold = [ord(c) if ord(c) > 0xFFFF or c.isalpha() else 32 for c in text.lower()]
    out = np.zeros(language.BUCKETS)
    for n in (1, 2, 3):
        for i in range(len(fold) - n + 1):
            h = fold[i] * 2654435761 % (1 << 32)
            for j, factor in zip(range(1, n), (2246822519, 3266489917)):
                h = (h ^ (fold[i + j] + j + 1)) * factor % (1 << 32)
            out[h >> (32 - language.BUCKET_BITS)] += 1
    return out


def test_training_and_decoding_against_a_plain_version(spark):
    rows = [r for r in texts(60)]
    model = language.train(language.training_rows(frame(spark, rows)))
    train = [(t, lang) for d, t, lang, *_ in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in train})
    code = language.codewords(len(langs))
    share = []
    for lang in langs:
        c = sum(plain_counts(t) for t, la in train if la == lang) + 0.5
        share.append(c / c.sum())

    def margins(text):
        counts = plain_counts(text)
        out = []
        for bit in range(code.shape[1]):
            one = np.mean([p for p, c in zip(share, code[:, bit]) if c > 0], 0)
            other = np.mean([p for p, c in zip(share, code[:, bit]) if c < 0], 0)
            out.append(float(counts @ np.log(one / other)) / max(1.0, counts.sum()) ** 0.5)
        return out

    worth = {}
    for i, lang in enumerate(langs):
        told = [margins(t) for t, la in train if la == lang]
        good = [(sum(np.sign(m[b]) == code[i, b] for m in told) + 1) / (len(told) + 2) for b in range(code.shape[1])]
        w = [max(g - 0.5, 0.01) for g in good]
        worth[lang] = [x / sum(w) for x in w]
    for _, text, *_ in rows:
        m = margins(text)
        loss = {lang: sum(w * np.log1p(np.exp(-code[i, b] * m[b])) for b, w in enumerate(worth[lang])) for i, lang in enumerate(langs)}
        best = min(loss, key=loss.get)
        got, score, *_ = model.predict(text)
        assert got == best and abs(score - 1 / sum(np.exp(loss[best] - x) for x in loss.values())) < 1e-3


def test_too_many_languages_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.train(language.training_rows(frame(spark, texts(40))))
