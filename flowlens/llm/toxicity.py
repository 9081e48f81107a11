"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded texts."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import materialize

# Look-alikes of Latin letters, and digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
              "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
              "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a lexicon word is no insult; learned ones are added.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "pond scum")
PREFIXES = range(4, 8)
#: (term, toxic) counts that a task holds at most, but for those of one text more.
HELD = 50_000


@functools.lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    """Accents off (Latin up to Extended Additional, full-width forms), look-alikes and substitutes to letters."""
    table = {}
    for c in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        table[c] = SUBSTITUTES.get(plain, plain)
    table |= {ord(k): v for k, v in (LOOKALIKES | SUBSTITUTES).items()}
    return table | {ord(c): "" for c in INVISIBLE}


_MARK = re.compile(r"(?<=\w)[!|](?=\w)")
_OTHER = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower-cased words with one space before and after each."""
    if not text:
        return " "
    text = text.lower()
    if "!" in text or "|" in text:
        text = _MARK.sub("i", text)
    return f" {_OTHER.sub(' ', text.translate(_fold_table())).strip()} "


class Model(NamedTuple):
    """Terms are folded text pieces: ' word ' for a whole word, ' part' for the beginning of one."""
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    line: tuple[float, float, float]   #: intercept and slopes of the logistic line
    pad: int = 50                      #: words added to a text's length, so that short texts do not jump


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _automaton(weights: dict[str, float], exceptions: tuple[str, ...]):
    machine = ahocorasick.Automaton()
    for term, weight in weights.items():
        machine.add_word(term, (len(term), weight))
    for phrase in exceptions:
        machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if len(machine):
        machine.make_automaton()
    return machine


def hits(machine, folded: str) -> dict[int, float]:
    """Weight of each hit word by the place where it starts; the best of its terms counts, words in exceptions do not."""
    if not len(machine):
        return {}
    best: dict[int, float] = {}
    free = []
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight is None:
            free.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in free:
        for at in [a for a in best if start <= a < end]:
            del best[at]
    return best


def _features(machine, folded: str, pad: int) -> tuple[float, float]:
    """Summed weight, and the same by length."""
    total = sum(hits(machine, folded).values())
    return math.log1p(total), math.log1p(1000 * total / (folded.count(" ") - 1 + pad)) if total else 0.0


def scorer(model: Model):
    """Column function: text -> score between 0 and 1. NULL and empty texts get the score of a text without hits."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(model.weights, model.exceptions)
        a, b, c = model.line
        for texts in batches:
            pairs = (_features(machine, fold(t), model.pad) for t in texts)
            yield pd.Series([1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x + c * y)))) for x, y in pairs], dtype="float64")
    return score


def held_out(key: Column) -> Column:
    """One document in five, by the checksum of its id; never used in learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _summed(found_in):
    """Map function: (term, toxic, n) over the terms that ``found_in`` gives of each text, handed on when `HELD` are held."""
    def frame(counts):
        return pd.DataFrame([(t, y, n) for (t, y), n in counts.items()], columns=["term", "toxic", "n"])

    def run(batches):
        counts = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts.update((t, toxic) for t in found_in(text))
                if len(counts) > HELD:
                    yield frame(counts)
                    counts.clear()
        if counts:
            yield frame(counts)
    return run


def _counted(known: frozenset[str] | None):
    return _summed(lambda text: _terms(text) if known is None else _terms(text) & known)


def _phrases(weights: dict[str, float]):
    def run(batches):
        machine = _automaton(weights, ())

        def around(text):
            found = set()
            for at in hits(machine, text):
                end = text.index(" ", at + 1)
                before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
                found |= ({text[before + 1:end]} if before >= 0 else set()) | ({text[at + 1:after]} if after > 0 else set())
            return found
        return _summed(around)(batches)
    return run


def _fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic line by Newton steps with a small ridge."""
    x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-3, 1e-2, 1e-2])
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
          support: float = 0.005, least: int = 4, odds: float = 4.0, certainty: float = 15.0, sample: int = 20_000) -> Model:
    """Lexicon, exceptions and logistic line from the labelled rows that are not held out.

    A term (a folded word, or the first four to seven letters of one) enters
    the lexicon if ``support`` of the toxic documents hold it (``least``
    documents at least), its log odds ratio is ``odds`` or more, and the
    likelihood ratio statistic of its counts is ``certainty`` or more. All counts run over all labelled
    rows as Spark aggregates. Each document gives a term once, so no more than
    mean terms per document / ``support`` terms can pass the first cut: that
    bounds what the driver and the tasks hold. Phrases of two words around a
    lexicon word that stand mostly in clean documents become exceptions by the
    same cuts. The line is fitted on at most ``sample`` rows of each class,
    taken in the order of an id hash.

    Labels may grow with the corpus, so the texts meet them in a sort-merge
    join at every size. Rows with a NULL text or label, or no label, teach nothing; of several
    labels of one id the highest counts. Without both classes the lexicon is
    empty and the line constant.
    """
    marks = labels.where(labels[toxic_col].isNotNull()).groupBy(labels[id_col].alias("id")) \
        .agg((F.max(toxic_col) > 0).cast("int").alias("toxic")).where(~held_out(F.col("id")))
    folded = F.pandas_udf(lambda s: s.map(fold), "string")
    rows = materialize(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
                       .join(marks.hint("merge"), "id").select("id", "toxic", folded("text").alias("text")))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model({}, (), (4.0 if toxic else -4.0, 0.0, 0.0))
    schema, cut = "term string, toxic int, n long", max(least, math.ceil(support * toxic))
    texts = rows.select("text", "toxic")
    frequent = texts.where("toxic = 1").mapInPandas(_counted(None), schema) \
        .groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= cut)
    seen = {r["term"]: r["n"] for r in frequent.collect()}
    among = texts.where("toxic = 0").mapInPandas(_counted(frozenset(seen)), schema).groupBy("term").agg(F.sum("n").alias("n"))
    other = {r["term"]: r["n"] for r in among.collect()}

    def odds_of(t: int, c: int) -> tuple[float, float]:
        ratio = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
        expected = (t + c) * toxic / (toxic + clean), (t + c) * clean / (toxic + clean)
        return ratio, 2 * sum(n * math.log(n / e) for n, e in zip((t, c), expected) if n)

    weights = {}
    for term, n in seen.items():
        ratio, certain = odds_of(n, other.get(term, 0))
        if ratio >= odds and certain >= certainty:
            weights[term] = ratio
    around = texts.mapInPandas(_phrases(weights), schema).groupBy("term").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")) \
        .where(F.col("c") >= max(least, math.ceil(support * clean / 10)))
    learned = []
    for r in around.collect():
        ratio, certain = odds_of(r["t"], r["c"])
        if ratio <= -odds and certain >= certainty:
            learned.append(r["term"])
    exceptions = tuple(sorted({fold(p).strip() for p in EXCEPTIONS} | set(learned)))
    pad = Model._field_defaults["pad"]

    def featured(batches):
        machine = _automaton(weights, exceptions)
        for batch in batches:
            pairs = [_features(machine, t, pad) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [p[0] for p in pairs], "y": [p[1] for p in pairs]})

    part = F.xxhash64("id")
    drawn = pd.concat([
        rows.where(F.col("toxic") == y).orderBy(part, "text").limit(sample).select("text", "toxic")
        .mapInPandas(featured, "toxic int, x double, y double").toPandas() for y in (0, 1)])
    y = drawn["toxic"].to_numpy()
    weight = np.where(y == 1, toxic / max(1, (y == 1).sum()), clean / max(1, (y == 0).sum())) / (toxic + clean) * len(y)
    return Model(weights, exceptions, _fit_line(drawn[["x", "y"]].to_numpy(), y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from 0.5 on).

    Only the text enters the score. Every text is folded and matched whole;
    the summed weight of its hit words, and the same divided by its length in
    words, go through the logistic line. NULL and empty texts score as texts
    without hits; rows with NULL or repeated ids are returned as they are.
    Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                       scorer(model)(docs[text_col]).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
