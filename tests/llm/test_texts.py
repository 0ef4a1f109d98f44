import base64
import random

import numpy as np
import pytest

from cellgrove.llm import mail
from cellgrove.llm.language import LANGUAGES, fit, label_cases, label_language, mail_languages, mail_stretches, word_scores
from cellgrove.llm.leaks import leak_report, leaked_items
from pyspark.sql import functions as F


def test_plain_and_empty_mails():
    assert mail.parts(None) == [] and mail.parts("") == [] and mail.body(None) == ""
    p = mail.parts("Subject: a\nContent-Type: text/plain\n\n> quoted\n>> more\nown")
    assert mail.words(mail.unquoted(p[0].text)) == ["quoted", "more", "own"]
    assert mail.parts("no headers at all")[0].text.strip().endswith("at all")


def multipart(*parts, close=True, boundary="b1"):
    return f'Subject: x\nContent-Type: multipart/mixed; boundary="{boundary}"\n\n' + "".join(f"--{boundary}\n{p}\n" for p in parts) + (f"--{boundary}--\n" if close else "")


def test_encodings_and_boundaries():
    latin = base64.b64encode("grün und süß".encode("iso-8859-1")).decode()
    a = f"Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: base64\n\n{latin[:7]}\n{latin[7:]}\n"
    b = "Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>caf=C3=A9 so=\nft <b>bo</b>ld&nbsp;&#233;</p><!-- no --><style>x</style>"
    c = 'Content-Type: text/plain; name="a.txt"\nContent-Disposition: attachment\n\nattached words'
    d = "Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA"
    for close in (True, False):
        p = mail.parts(multipart(a, b, c, d, close=close).replace("\n", "\r\n"))
        assert [x.kind for x in p] == ["plain", "html", "plain"] and p[2].attached
        assert p[0].text == "grün und süß" and mail.words(p[1].text) == ["café", "soft", "bold", "é"]
    nested = multipart("Content-Type: multipart/alternative; boundary=in\n\n--in\n\none\n--in\nContent-Type: text/html\n\n<div>two</div>\n--in--\n", c)
    assert [mail.words(x.text)[0] for x in mail.parts(nested)] == ["one", "two", "attached"]


def test_unreadable_encoding_is_kept():
    assert mail.parts("Content-Transfer-Encoding: base64\n\n!")[0].text == ""
    assert mail.parts("Content-Transfer-Encoding: strange\n\nabc")[0].text == "abc"


def test_body_drops_signature_and_second_copy():
    text = "Hello dear friends of the house.\n\n-- \nAnn Bell\nDesk 4\nTel 0555-0137\n\nThis notice stays here.\n\nOn Wed, 1 Mar 2023 09:08:49 +0900, Ann Bell wrote:\n> earlier words\n"
    rich = "Content-Type: text/html\n\n<p>Hello dear friends of the house.</p><p>--&nbsp;</p><p>Ann Bell</p><p>Desk 4</p><p>This notice stays here.</p><p>earlier words</p>"
    b = mail.body(multipart("Content-Type: text/plain\n\n" + text, rich))
    assert mail.words(b) == "hello dear friends of the house this notice stays here earlier words".split()
    only = mail.body("Content-Type: text/html\n\n" + rich.split("\n\n", 1)[1])
    assert "bell" not in mail.words(only) and "notice" in mail.words(only)


WORDS = [f"w{a}{b}" for a in "bcdfg" for b in "aeiouxyz"]


def passage(rng, n):
    return [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]


def test_leaks_equal_brute_force(spark, rows):
    rng = random.Random(1)
    items = {i: passage(rng, 40) for i in range(1, 9)}
    docs, want = [], set()
    for d in range(1, 80):
        own = passage(rng, 30)
        i, n = rng.randint(1, 8), rng.choice([11, 12, 13, 25])
        s = rng.randint(0, 40 - n)
        piece = items[i][s : s + n]
        lines = " ".join(own[:9] + [w.upper() if rng.random() < 0.3 else w for w in piece] + own[9:])
        body = "\n".join("> " + lines[k : k + 60] if 0 else lines for k in [0]).replace(" ", "\n> ", 3)
        kind = d % 3
        raw = f"Subject: s\n\n{body}" if kind == 0 else "Subject: s\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(body.encode()).decode() if kind == 1 else f"Content-Type: text/html\n\n<p>{lines.replace(' ', '&nbsp;', 2)}</p>"
        docs.append((d, raw, "x"))
        if n >= 12:
            want.add((d, i))
    docs += [(100, None, "x"), (101, "", "x"), (None, docs[0][1], "x"), (102, "Subject: a\n\n" + " ".join(items[1]) * 400, "x")] + [(200, *docs[0][1:])]
    want.add((102, 1))
    want |= {(200, i) for d, i in want if d == docs[0][0]}
    it = [(i, " ".join(w), "t") for i, w in items.items()] + [(50, "too short to leak", "t"), (51, None, "t"), (None, "x", "t")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    f = spark.createDataFrame(it, "item_id bigint, text string, suite string")
    got = leaked_items(df, f).where("edits = 0").select("doc_id", "item_id")
    assert rows(got) == sorted(want, key=repr)
    assert rows(leaked_items(df, f, block_chars=600).where("edits = 0").select("doc_id", "item_id")) == sorted(want, key=repr)  # items in several blocks
    assert rows(leaked_items(df, f, edits=0)) == sorted(((*x, 0) for x in want), key=repr)
    assert rows(leaked_items(df, f, edits=2).where("edits = 0").select("doc_id", "item_id")) == sorted(want, key=repr)
    assert leaked_items(df.limit(0), f).count() == 0 and leaked_items(df, f.limit(0)).count() == 0
    n = {r.item_id: r.n_docs for r in leak_report(got, f.where("item_id is not null")).collect()}
    assert n[50] == 0 and sum(n.values()) == len(want)


def test_passages_with_edits_are_found(spark):
    rng = random.Random(5)
    items = {i: passage(rng, 40) for i in range(1, 6)}
    docs, want = [], {}
    for d in range(60):
        i, e = 1 + d % 5, d % 4  # 0 to 3 edits, all within every run of 12 words: in the middle of 14
        s = rng.randint(0, 26)
        piece = " ".join(items[i][s : s + 14])
        middle = [k for k in range(len(piece) // 2 - 6, len(piece) // 2 + 6) if piece[k] != " "]
        for k in sorted(rng.sample(middle, e), reverse=True):
            piece = piece[:k] + rng.choice(["", "q", "q" + piece[k]]) + piece[k + 1 :]
        docs.append((d, "Subject: s\n\n" + " ".join([*passage(rng, 20), piece, *passage(rng, 20)])))
        want[d, i] = e
    df, f = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")

    def apart(pattern, text, most):  # fewest edits with which the pattern lies in the text
        d = [0] * (len(text) + 1)
        for i, a in enumerate(pattern, 1):
            new = [i]
            for j, b in enumerate(text, 1):
                new.append(min(d[j - 1] + (a != b), d[j] + 1, new[-1] + 1))
            d = new
        return min(d)

    true = {}
    for (d, i), e in want.items():
        text = " " + " ".join(mail.words(docs[d][1].split("\n\n", 1)[1])) + " "
        true[d, i] = min(apart(" " + " ".join(items[i][k : k + 12]) + " ", text, 3) for k in range(29)) if e else 0
    for most in (0, 1, 2):
        got = {(r.doc_id, r.item_id): r.edits for r in leaked_items(df, f, edits=most).collect()}
        assert got == {k: e for k, e in true.items() if e <= most}


def test_charsets_are_looked_up():
    for name in ("windows-1252", "koi8-r", "utf-16", "ISO-8859-15", "no-such-charset"):
        text = "дом" if name == "koi8-r" else "déjà"
        data = base64.b64encode(text.encode(name if name != "no-such-charset" else "utf-8")).decode()
        assert mail.parts(f"Content-Type: text/plain; charset={name}\nContent-Transfer-Encoding: base64\n\n{data}")[0].text == text
    assert mail.parts("Content-Type: text/plain; charset=hex\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"abc").decode())[0].text == "abc"


def test_long_texts_are_cut_without_loss(monkeypatch):
    from cellgrove.llm import leaks

    monkeypatch.setattr(leaks, "PIECE", 50)
    text = " ".join(f"word{i}" for i in range(200))
    cut = list(leaks._pieces(text, 30))
    assert len(cut) > 5 and all(any(text[i : i + 30] in c for c in cut) for i in range(len(text) - 30))
    assert cut[0].startswith("word0 ") and cut[-1].endswith("word199") and all(not c.startswith("ord") for c in cut)


SAMPLES = {
    "en": "the report of the old house was there when they came with the other things that we have for you and the work goes on. please let me know whether this is the right one.",
    "de": "der bericht über das alte haus war nicht da als sie mit den anderen sachen kamen und die arbeit geht weiter. bitte sag mir ob das der richtige ist und wann ihr kommt.",
    "fr": "le rapport de la vieille maison était là quand ils sont venus avec les autres choses que nous avons pour vous et le travail continue. dis moi si cela te convient.",
    "ru": "отчёт о старом доме был там когда они пришли с другими вещами которые у нас есть для вас и работа идёт дальше. скажи мне подходит ли это.",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr", "ru"][i % 4]
        w = SAMPLES[lang].replace(".", "").split()
        text = ". ".join(" ".join(rng.choices(w, k=9)) for _ in range(4))
        label = {"en": "en-GB", "de": "DEU", "fr": "fr_FR", "ru": "ru"}[lang] if i % 10 else rng.choice(["de", "en", None, "xx", ""])
        rows.append((i, f"Subject: s\n\n{text}.", label, lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, true string")


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN-gb", "eng", "pt_BR", " de ", "mul", "und", "", None, "english", "uk")], "l string")
    assert [r[0] for r in df.select(label_language(F.col("l"))).collect()] == ["en", "en", "en", "pt", "de", None, None, None, None, None, None]


def test_languages_of_held_out_mails(spark, labelled):
    model = fit(labelled.where("doc_id < 160"))
    held = labelled.where("doc_id >= 160")
    got = {r.doc_id: r.lang for r in mail_languages(held, model).collect()}
    true = {r.doc_id: r.true for r in held.collect()}
    assert np.mean([got.get(i) == t for i, t in true.items()]) > 0.97
    p = word_scores(model, ["the", "und"])
    assert LANGUAGES[p[0].argmax()] == "en" and LANGUAGES[p[1].argmax()] == "de" and (p < 0).all()


def test_mixed_empty_and_unlabelled_mails(spark, labelled):
    model = fit(labelled)
    mixed = f"Subject: s\n\n{SAMPLES['en']}\n\n{SAMPLES['ru']}\n"
    docs = [(1, mixed, "en"), (2, f"Subject: s\n\n{SAMPLES['fr']}", "fr-CH"), (3, f"Subject: s\n\n{SAMPLES['fr']}", None), (4, "", "en"), (5, None, None), (6, "Subject: s\n\n12 34", "en"), (7, f"Subject: s\n\n{SAMPLES['de']}", "en"), (8, f"Subject: s\n\n{SAMPLES['de']}", "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("share", F.lit(1))
    found = mail_languages(df, model)
    cases = sorted(map(tuple, label_cases(df, found).collect()))
    assert cases == [(1, "en"), (1, "ru"), (3, "fr"), (7, "de"), (8, "de")]
    s = sorted(tuple(r)[:3] for r in mail_stretches(df, model).where("doc_id <= 2").collect())
    assert s == [(1, 1, "en"), (1, 2, "ru"), (2, 1, "fr")]
    with pytest.raises(ValueError):
        fit(df.limit(0))
