"""Operator 3, language ID by hierarchical discrimination: first the language family, then one-versus-one linear
support vector machines between the languages of that family. Features are mean counts of hashed character n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import id_fold
from lakeleaf.llm.ngrams import codes, hashed, letters

#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr")}
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (1, 2, 3)
    bits: int = 14
    #: Bounds of the training sample: rows of each language, and characters of all its rows.
    rows_per_language: int = 800
    chars_per_language: int = 3_000_000
    #: Short windows of each sampled text are learnt too, so that short texts are judged well.
    window: int = 60
    cost: float = 10.0
    epochs: int = 12


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"={lang}")


def features(text: str, s: Settings) -> np.ndarray | None:
    """Bucket numbers of all n-grams; None if the text has no letter."""
    cp = codes(text)
    return None if len(cp) <= 1 and not letters()[cp].any() else np.concatenate(hashed(cp, s.lengths, s.bits))


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float, epochs: int) -> np.ndarray:
    """Linear SVM (hinge loss) by dual coordinate descent. rows: indices and values, a constant feature included."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            new = min(max(alpha[i] - (y[i] * float(w[at] @ v) - 1) / norms[i], 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


@dataclass
class Model:
    """table: for each bucket (and last the constant) the weight in every machine; machines: the two names of each,
    families first."""

    settings: Settings
    languages: list[str]
    table: np.ndarray | None = None
    machines: list[tuple[str, str]] = field(default_factory=list)

    def predict(self, text: str) -> tuple[str, float]:
        found = features(text, self.settings)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        if self.table is None:
            return self.languages[0], 1.0
        margins = self.table[found].sum(axis=0, dtype=np.float64) * (SCALE / len(found)) + self.table[-1]
        chances = dict(zip(self.machines, 1 / (1 + np.exp(-np.clip(2 * margins, -40, 40)))))
        families = sorted({family_of(x) for x in self.languages})
        family, sure = self.best(families, chances)
        lang, surer = self.best(sorted(x for x in self.languages if family_of(x) == family), chances)
        return lang, sure * surer

    @staticmethod
    def best(names: list[str], chances: dict[tuple[str, str], float]) -> tuple[str, float]:
        """Most duels won, then the larger sum of chances, then the name; with the least chance in its duels."""
        mine = {x: [chances[x, y] if (x, y) in chances else 1 - chances[y, x] for y in names if y != x] for x in names}
        top = max(names, key=lambda x: (sum(p >= 0.5 for p in mine[x]), sum(mine[x])))
        return top, min([1.0, *mine[top]])


#: Mean counts times this are the features, so that the constant and the counts weigh alike.
SCALE = 30.0


def fit(sample: dict[str, list[str]], s: Settings = Settings()) -> Model:
    """sample: texts of each language."""
    rows, langs = [], []
    for lang in sorted(sample):
        for i, text in enumerate(sample[lang]):
            at = (i * 7919) % max(1, len(text) - s.window)
            for piece in (text, text[at : at + s.window]):
                if (found := features(piece, s)) is not None:
                    index, n = np.unique(found, return_counts=True)
                    rows.append((np.append(index, 1 << s.bits), np.append(n * (SCALE / len(found)), 1.0)))
                    langs.append(lang)
    known = sorted(set(langs))
    if len(known) < 2:
        return Model(s, known)
    families = sorted({family_of(x) for x in known})
    duels = [(a, b, family_of) for a, b in combinations(families, 2)]
    for f in families:
        duels += [(a, b, str) for a, b in combinations([x for x in known if family_of(x) == f], 2)]
    columns = []
    for a, b, kind in duels:
        own = [i for i, x in enumerate(langs) if kind(x) in (a, b)]
        columns.append(svm([rows[i] for i in own], np.array([1.0 if kind(langs[i]) == a else -1.0 for i in own]), (1 << s.bits) + 1, s.cost, s.epochs))
    return Model(s, known, np.stack(columns, axis=1).astype(np.float32), [(a, b) for a, b, _ in duels])


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from text and lang where crc32(doc_id as text) mod 4 is not 2, both non-null.

    Of each language the rows with the smallest hashes of doc_id are taken, up to the bounds of ``s``. A first pass
    counts rows by language, so that only about that many rows leave the executors.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(id_fold("doc_id", 4) != 2)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)).alias("place")
    share = F.lit(1.25 * s.rows_per_language + 40) / F.col("n")
    rows = known.join(counts, "lang").select("lang", "text", place, "doc_id", share.alias("share")).filter("place < share").drop("share")
    sample: dict[str, list[str]] = {}
    chars: dict[str, int] = {}
    for r in rows.orderBy("place", "doc_id", "text").toLocalIterator():
        own = sample.setdefault(r["lang"], [])
        if len(own) < s.rows_per_language and (not own or chars[r["lang"]] + len(r["text"]) <= s.chars_per_language):
            own.append(r["text"])
            chars[r["lang"]] = chars.get(r["lang"], 0) + len(r["text"])
    return fit(sample, s)


def language_id(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out (crc32(doc_id as text) mod 4 is 2), lang_pred, score; one row per input row.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learnt. An
    empty table gives an empty result; repeated rows are repeated, other columns are ignored. Very long texts are read
    whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sent.value.predict(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x[0] for x in found], "score": [float(x[1]) for x in found]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (id_fold(doc_id, 4) == 2).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
