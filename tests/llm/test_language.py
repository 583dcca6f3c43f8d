import random

import pytest

from paperloom.llm import language as lang

WORDS = {
    "en": "the plan is checked with every new report before they sign it and nothing else",
    "de": "der Bericht wird vor jeder neuen Prüfung mit dem Plan verglichen und dann unterschrieben",
    "fr": "le rapport est vérifié avec chaque nouveau plan avant la signature et rien de plus",
    "ja": "報告書は新しい計画と一緒に確認されています。署名の前に見直しを行います。",
    "zh": "报告在每次新的计划之前都会被检查，然后再签字，没有其他要求。",
}


def sentence(rng, code):
    if code in ("ja", "zh"):
        cut = rng.randrange(5)
        return WORDS[code][cut:]
    words = WORDS[code].split()
    rng.shuffle(words)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    names = {"en": ["en", "EN", "eng", "English", "en-US"], "de": ["de", "Deutsch", "ger"], "fr": ["fr", "fr_CA"], "ja": ["ja", "jpn"], "zh": ["zh", "zh-Hans"]}
    rows, truth = [], {}
    for i in range(300):
        code = rng.choice(list(WORDS))
        lines = [sentence(rng, code) for _ in range(4)]
        languages, label = {code}, rng.choice(names[code])
        if i % 10 == 0:
            label = rng.choice(["", None, "und", "??"])
        elif i % 10 == 1:
            wrong = rng.choice([c for c in WORDS if c != code])
            label = rng.choice(names[wrong])
        elif i % 10 == 2:
            other = rng.choice([c for c in WORDS if c != code])
            lines.insert(2, "- " + sentence(rng, other))
            languages.add(other)
        elif i % 10 == 3:
            lines[0] += f" ({WORDS['fr'][:10]})"
            lines = ["---", "id: 5", "---", *lines, "```", "the code is not checked = 1", "```"]
        rows.append((i, "\n".join(lines), label))
        if i % 10 < 3:
            truth[i] = languages
    rows += [(900, "x = 5\n{\n  \"id\": 3\n}\n0x12 0x44", None), (901, None, None), (902, "", "en"), (903, " \n", None), (904, sentence(rng, "en") * 3000, "en")]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string"), truth


def test_labels_and_mixed_documents(spark, corpus):
    docs, truth = corpus
    found = lang.segments(docs, lang.fit(docs))
    got = {}
    for r in lang.wrong_labels(found).collect():
        got.setdefault(r.doc_id, set()).add(r.true_lang)
    assert got == truth
    rows = found.collect()
    assert all(0 < r.confidence <= 1 and r.first_line <= r.last_line for r in rows)
    assert {r.doc_id for r in rows}.isdisjoint({900, 901, 902, 903})
    assert abs(sum(r.share for r in lang.documents_languages(found).filter("doc_id = 2").collect()) - 1) < 1e-9


def test_long_documents_teach_their_language(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(sentence(rng, "de") for _ in range(320)), "de") for i in range(5)]
    rows += [(i, "\n".join(sentence(rng, "en") for _ in range(4)), "en") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert min(len(t) for _, t, code in rows if code == "de") > lang.SAMPLE_LENGTH
    model = lang.fit(docs)
    assert model.languages == ["de", "en"] and lang.wrong_labels(lang.segments(docs, model)).count() == 0


def test_no_labels_and_empty(spark, corpus):
    docs, _ = corpus
    assert lang.fit(docs.filter("lang = '??'")) is None
    assert lang.segments(docs, None).count() == 0
    assert lang.segments(docs.limit(0), lang.fit(docs)).count() == 0


def test_unseen_words_fall_back_to_grams(corpus):
    docs, _ = corpus
    model = lang.fit(docs)
    assert model.languages[model.lines([["prüfungsbericht", "unterschriebenen"]])[0][0]] == "de"


def test_batches_give_what_single_lines_give(corpus):
    docs, _ = corpus
    model = lang.fit(docs)
    texts = [r.text or "" for r in docs.collect()] + ["see <a href='x y'>https://x.example/a</a> `not this` but the plan (v2) is checked", "\n\n", "5"]
    for text, judged in zip(texts, lang.judged_lines(model, texts)):
        lines = lang.natural_lines(text)
        assert [n for n, *_ in judged] == [n for n, _ in lines] and [n for *_, n in judged] == [len(w) for _, w in lines]
        if lines:
            best, sure = model.lines([w for _, w in lines])
            assert [b for _, b, _, _ in judged] == best.tolist() and all(abs(s - x) < 1e-6 for (_, _, s, _), x in zip(judged, sure))
