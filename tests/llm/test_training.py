import pytest

from cellgrove.llm import language


class Seen(Exception):
    pass


def test_every_labelled_mail_trains(spark, monkeypatch):
    n = 1700  # above the former sample of 1,500 mails per language
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    docs = spark.createDataFrame([(i, f"Subject: x\n\nthe word {letters(i)} stands here.", "en") for i in range(n)], "doc_id bigint, text string, lang string")

    def stop(words):
        raise Seen({r.word for r in words.collect()})

    monkeypatch.setattr(language, "train", stop)
    with pytest.raises(Seen) as e:
        language.fit(docs)
    assert {letters(i) for i in range(n)} <= e.value.args[0]
