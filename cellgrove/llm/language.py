"""Languages of mails and of their stretches, by character language models trained on the labelled mails themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.mail import body, chunks, sentences
from cellgrove.plans import cut, kept

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: ISO 639-2 codes (both forms, where there are two) of the languages above.
THREE_LETTERS = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt", "rus": "ru"}
ORDER = 5
#: Log odds by which a training mail's label is believed for each of its sentences.
LABEL_FAVOUR = 6.0
#: Part of the labelled mails' sentences that calibrated rejection may refuse.
REJECT = 0.002


def label_language(label: Column) -> Column:
    """The two letters of the language that a label names (two or three letters, any case, with or without region)."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})([-_].*)?$", 1))
    named = F.create_map(*[F.lit(x) for k, v in THREE_LETTERS.items() for x in (k, v)])
    return F.when(head.isin(*LANGUAGES), head).otherwise(F.try_element_at(named, head))


@dataclass
class Model:
    """Per order: sorted hashes of n-grams with their discounted probabilities, and of contexts with their weights."""

    languages: tuple[str, ...]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: np.ndarray
    worst: float = np.inf
    strange: float = np.inf  # entropy of a character of a word that no language knows, from the calibration


_B = np.uint64(0x9E3779B97F4A7C15)


def _codes(word: str, n: int) -> np.ndarray:
    """The word's characters with a blank after it and n blanks before it."""
    return np.frombuffer((" " * n + word + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _hashes(strings: list[str], k: int) -> np.ndarray:
    """A 64-bit hash of each string of k characters."""
    if not strings:
        return np.zeros(0, dtype=np.uint64)
    c = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(strings), k)
    h = np.full(len(strings), k, dtype=np.uint64)
    for j in range(k):
        h = (h + c[:, j]) * _B
        h ^= h >> np.uint64(29)
    return h


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    got = values[at]
    got[keys[at] != wanted] = missing
    return got


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Natural log probability of each word (its end included) under each language: interpolated Kneser-Ney."""
    padded = [_codes(w, ORDER - 1) for w in words]
    lengths = np.array([len(p) - (ORDER - 1) for p in padded])
    text = np.concatenate(padded)
    starts = np.cumsum([0] + [len(p) for p in padded[:-1]])
    first = np.repeat(starts + ORDER - 1 - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())  # the characters to predict
    p = np.tile(model.base, (len(first), 1))
    for k in range(1, ORDER + 1):
        h = np.full(len(first), k, dtype=np.uint64)
        c = np.full(len(first), k - 1, dtype=np.uint64)
        for j in range(k - 1, -1, -1):
            if j:
                c = (c + text[first - j]) * _B
                c ^= c >> np.uint64(29)
            h = (h + text[first - j]) * _B
            h ^= h >> np.uint64(29)
        p = _find(*model.grams[k - 1], h, 0.0) + _find(*model.contexts[k - 1], c, 1.0) * p
    return np.add.reduceat(np.log(p), np.cumsum(np.r_[0, lengths[:-1]]), axis=0)


def train(words: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model from lang, word, n (counts over all mails). Spark counts the n-grams of every order; what comes to the
    driver for the discounts and the hash arrays are the distinct n-grams and no more."""
    pad = " " * (ORDER - 1)
    s = F.concat(F.lit(pad), F.col("word"), F.lit(" "))
    grams = words.withColumn("s", s).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))))
    level = cut(grams.groupBy("lang", F.substring(F.col("s"), F.col("i"), F.lit(ORDER)).alias("g")).agg(F.sum("n").alias("c")))
    levels = [level.select(F.lit(ORDER).alias("k"), "lang", "g", "c")]
    for k in range(ORDER - 1, 0, -1):  # how many different characters stand before the shorter n-gram
        level = level.groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(level.select(F.lit(k).alias("k"), "lang", "g", "c"))
    every = reduce(DataFrame.unionByName, levels).toPandas()
    tables: list[tuple[pd.DataFrame, pd.DataFrame]] = []
    for k in range(1, ORDER + 1):
        t = every[every["k"] == k].assign(ctx=lambda x: x["g"].str[:-1])
        n1, n2 = (t["c"].eq(i).groupby(t["lang"]).sum() for i in (1, 2))
        d = t["lang"].map((n1 / (n1 + 2 * n2)).where(n1 * n2 > 0, 0.5))
        both = t.assign(d=d).groupby(["lang", "ctx"])
        g = t.assign(v=(t["c"] - d) / both["c"].transform("sum"))[["lang", "g", "v"]]
        w = both.agg(all=("c", "sum"), kinds=("c", "size"), d=("d", "first")).reset_index()
        tables.append((g, w.assign(v=w["d"] * w["kinds"] / w["all"]).rename(columns={"ctx": "g"})[["lang", "g", "v"]]))
    del every
    code = {v: i for i, v in enumerate(languages)}

    def matrix(t: pd.DataFrame, k: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
        names, inverse = np.unique(t["g"].to_numpy(dtype=object).astype(str), return_inverse=True) if len(t) else (np.zeros(0, str), np.zeros(0, int))
        if k:
            names = [x.ljust(k) for x in names]  # NumPy drops nothing but NULs; blanks at the end stay
        h = _hashes(list(names), k)
        m = np.full((len(h), len(languages)), missing, dtype=np.float32)
        m[inverse, t["lang"].map(code).to_numpy(dtype=int)] = t["v"].to_numpy(dtype=np.float32)
        order = np.argsort(h)
        return h[order], m[order]

    alphabet = max(2, tables[0][0]["g"].nunique())
    return Model(languages, [matrix(g, k, 0.0) for k, (g, _) in enumerate(tables, 1)], [matrix(w, k - 1, 1.0) for k, (_, w) in enumerate(tables, 1)], np.full(len(languages), 1.0 / (2 * alphabet)))


class _Scorer:
    """Scores of the words of a batch, with those of earlier batches kept up to a bound."""

    KEEP = 200_000

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.languages)))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.KEEP:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            for i in range(0, len(new), 20_000):
                self.table = np.concatenate([self.table, word_scores(self.model, new[i : i + 20_000])])
            for w in new:
                known[w] = len(known)
        return self.table[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]


def _stretches(scorer: _Scorer, texts: list[str | None], labels: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The figures of _judged for the sentences of texts."""
    return _judged(scorer, [sentences(body(t)) for t in texts], labels)


def _split(said: Iterable[str]) -> list[list[list[str]]]:
    """Words of the sentences, one a line, of each text."""
    return [[s.split(" ") for s in t.split("\n")] if t else [] for t in said]


def _judged(scorer: _Scorer, texts: list[list[list[str]]], labels: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sentences of all texts: text number, words, the language without rejection, language (-1: rejected), confidence, entropy.

    labels (language numbers, one per text) favour the label in each sentence, as training does.
    """
    doc, size, flat = [], [], []
    for i, t in enumerate(texts):
        for s in t:
            doc.append(i)
            size.append(len(s))
            flat.extend(s)
    if not flat:
        return tuple(np.zeros(0, dtype=t) for t in (int, int, int, int, float, float))
    doc, size = np.array(doc), np.array(size)
    starts = np.cumsum(np.r_[0, size[:-1]])
    single = scorer(flat)
    each = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) + 1
    chars = np.add.reduceat(each, starts)
    whole = np.add.reduceat(single, starts, axis=0)
    cross = -whole / chars[:, None]
    entropy, likely = cross.min(axis=1), cross.argmin(axis=1)
    # a word's probability under a language is interpolated with that of a strange word (a name, a code), which is the
    # same for all languages: such a word adds the same to each cross-entropy
    if np.isfinite(scorer.model.strange):
        single = np.logaddexp(single, np.log(0.01) - scorer.model.strange * each[:, None])
    score = np.add.reduceat(single, starts, axis=0)
    if labels is not None:
        score[np.arange(len(score)), labels[doc]] += LABEL_FAVOUR
    best = (-score / chars[:, None]).argmin(axis=1)  # the lowest cross-entropy per character
    top = score[np.arange(len(score)), best]
    confidence = 1 / np.exp(np.clip(score - top[:, None], -50, 0)).sum(axis=1)
    # a short or ambiguous sentence goes with the sentence before it in its mail, or the one after it
    known = (entropy <= scorer.model.worst) | (confidence >= 0.9)
    sure = known & (confidence >= 0.99)
    for way in (np.arange(1, len(doc)), np.arange(len(doc) - 2, -1, -1)):
        step = -1 if len(way) and way[0] == 1 else 1
        for j in way[~sure[way]] if len(way) else []:
            if sure[j + step] and doc[j + step] == doc[j] and score[j, best[j + step]] > top[j] - 5 and known[j]:
                best[j], sure[j] = best[j + step], True
    return doc, size, likely, np.where(known, best, -1), confidence, entropy


def fit(docs: DataFrame, reject: float = REJECT, rounds: int = 2) -> Model:
    """Trains on all labelled mails, decoded once.

    Labels are partly wrong and mails partly mixed, so each further round counts every sentence for the language that
    the model of the round before gives it. Rejection is calibrated on the same mails: the entropy above which the given
    part of their sentences lies. Needs a mail of some language; without any, fitting fails with a ValueError.
    """
    spark = docs.sparkSession
    told = docs.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label is not null and doc_id is not null")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            yield pd.DataFrame({"label": pdf["label"], "said": ["\n".join(" ".join(x) for x in sentences(body(t))) for t in pdf["text"]]})

    said = kept(told.select("label", "text").mapInPandas(decode, "label string, said string"))  # words hold no blanks

    def read_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "said"):
            rows = [(lab, x) for lab, t in zip(pdf["label"], pdf["said"], strict=True) for x in t.split()]
            yield pd.DataFrame(rows, columns=["lang", "word"]).value_counts().reset_index(name="n")

    def relabelled(model):
        def read_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer, number = _Scorer(model.value), {v: i for i, v in enumerate(model.value.languages)}
            for pdf in chunks(batches, "said"):
                texts = _split(pdf["said"])
                _, size, _, best, _, _ = _judged(scorer, texts, pdf["label"].map(number).to_numpy(dtype=int))
                flat = [x for t in texts for s in t for x in s]
                at = np.repeat(best, size)
                rows = pd.DataFrame({"lang": np.asarray(model.value.languages, dtype=object)[at], "word": flat})[at >= 0]
                yield rows.value_counts().reset_index(name="n")

        return read_again

    def entropies(model):
        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = _Scorer(model.value)
            for pdf in chunks(batches, "said"):
                _, size, _, _, _, e = _judged(scorer, _split(pdf["said"]))
                yield pd.DataFrame({"e": e[size >= 4]})

        return measure

    schema = "lang string, word string, n bigint"
    make = read_words
    for _ in range(rounds):
        words = said.mapInPandas(make, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = cut(words)
        if not words.limit(1).count():
            raise ValueError("no labelled mail to train on")
        model = train(words)
        edge = said.select("said").mapInPandas(entropies(spark.sparkContext.broadcast(model)), "e double").agg(F.percentile_approx("e", F.lit(1 - reject), F.lit(10_000))).first()[0]
        if edge is not None:
            model.worst = model.strange = 1.25 * edge
        make = relabelled(spark.sparkContext.broadcast(model))
    return model


def mail_languages(docs: DataFrame, model: Model | None = None, share: float = 0.25) -> DataFrame:
    """doc_id, lang, n_words, share, confidence: one row per mail and language with at least that share of its words.

    docs: doc_id, text, lang (the label, only used for training where no model is given); other columns are ignored.
    Each sentence of the decoded body gets the language with the lowest entropy per character, or none if that lies
    above the calibrated bound and no language stands out; words that no language knows are neutral, and a mail of
    which every sentence would be rejected keeps the likeliest languages; confidence is the mean posterior over the language's words. A null or empty text, or one
    without words, has no language. Repeated mails get a row each; ties of the entropy go to the first of LANGUAGES.
    """
    model = model or fit(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shipped.value)
        names = np.asarray(shipped.value.languages, dtype=object)
        for pdf in chunks(batches):
            doc, size, likely, best, confidence, _ = _stretches(scorer, list(pdf["text"]))
            some = np.bincount(doc[best >= 0], minlength=len(pdf)) > 0
            best = np.where(some[doc], best, likely)  # a mail of which every sentence is rejected keeps its likeliest languages
            n = np.zeros((len(pdf), len(names)))
            sure = np.zeros((len(pdf), len(names)))
            ok = best >= 0
            np.add.at(n, (doc[ok], best[ok]), size[ok])
            np.add.at(sure, (doc[ok], best[ok]), size[ok] * confidence[ok])
            total = np.bincount(doc, weights=size, minlength=len(pdf))
            i, j = np.nonzero((n > 0) & (n >= share * total[:, None]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[i], "lang": names[j], "n_words": n[i, j].astype(np.int64), "share": n[i, j] / total[i], "confidence": sure[i, j] / n[i, j]})

    return docs.select("doc_id", "text").mapInPandas(judge, "doc_id bigint, lang string, n_words bigint, share double, confidence double")


def mail_stretches(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, stretch, lang, n_words, confidence: neighbouring sentences of one language, numbered from 1 in the mail.

    A null lang is a rejected stretch. Edge cases as in mail_languages.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shipped.value)
        names = np.asarray([*shipped.value.languages, None], dtype=object)
        for pdf in chunks(batches):
            doc, size, _, best, confidence, _ = _stretches(scorer, list(pdf["text"]))
            if not len(doc):
                continue
            starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])])
            n = np.add.reduceat(size, starts)
            number = np.arange(len(starts)) - np.searchsorted(doc[starts], doc[starts]) + 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[doc[starts]], "stretch": number.astype(np.int32), "lang": names[best[starts]], "n_words": n.astype(np.int64), "confidence": np.add.reduceat(size * confidence, starts) / n})

    return docs.select("doc_id", "text").mapInPandas(judge, "doc_id bigint, stretch int, lang string, n_words bigint, confidence double")


def label_cases(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, lang of the mails that are in more than one language, or whose label does not name their language."""
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min("lang").alias("only"))
    labels = docs.select("doc_id", label_language(F.col("lang")).alias("label"))
    cases = n.join(labels, "doc_id").where((F.col("k") > 1) | ~F.col("only").eqNullSafe(F.col("label"))).select("doc_id").distinct()
    return found.join(cases, "doc_id", "left_semi").select("doc_id", "lang").distinct()
