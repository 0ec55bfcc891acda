"""Language identification by hierarchical discrimination.

A linear support vector machine for each family (against the rest) decides the language family of a text, then
one-versus-one linear support vector machines separate the languages inside it. Features are byte n-grams of
the lower-cased text, hashed into a fixed number of places, as roots of relative frequencies.

Defined results: ``und`` with score 0 for a null text or one without a letter; ``und`` for every text when
nothing can be learned; a single learned language is predicted with score 1; rows with a null language or null
text teach nothing; repeated rows are predicted each. Only the text is read by a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from forecast_duel.llm.common import hash_share

#: Most rows of a language that the machines are fitted on.
ROWS_PER_LANGUAGE = 500
PLACES = 4096
DIMENSIONS = 256 + 2 * PLACES
#: Families of closely related languages. A language that is not named is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
}
LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> np.ndarray:
    """One row a text: roots of the shares of 1-, 2- and 3-byte strings."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts):
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if not len(data):
            continue
        row[:256] = np.bincount(data, minlength=256)
        if len(data) > 1:
            pair = data[:-1] * np.uint32(256) + data[1:]
            row[256 : 256 + PLACES] = np.bincount((pair * np.uint32(2654435761)) >> np.uint32(20), minlength=PLACES)
        if len(data) > 2:
            triple = pair[:-1] * np.uint32(256) + data[2:]
            row[256 + PLACES :] = np.bincount((triple * np.uint32(2246822519)) >> np.uint32(20), minlength=PLACES)
        row /= len(data)
    return np.sqrt(out)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, y of -1 and 1) by accelerated gradient steps.

    The weights are scaled so that the sigmoid of the margin is a fair probability on the rows.
    """
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    curve = 2.0 * float((weight * (x1**2).sum(axis=1)).sum()) + penalty
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    w = v = np.zeros(x1.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(np.float32(0), 1 - y * (x1 @ v))
        gradient = np.float32(penalty) * v - np.float32(2.0) * ((weight * slack * y) @ x1)
        new = v - gradient / np.float32(curve)
        v = new + np.float32(step / (step + 3.0)) * (new - w)
        w = new
    margin, scale = y * (x1 @ w), 1.0
    for _ in range(30):  # Newton steps on the logistic loss of scale * margin, held by a weak prior
        p = 1.0 / (1.0 + np.exp(np.clip(scale * margin, -50, 50)))
        scale += (float((weight * p * margin).sum()) - 1e-4 * scale) / (float((weight * p * (1 - p) * margin**2).sum()) + 1e-4)
        scale = float(np.clip(scale, 0.1, 50.0))
    return scale * w[:-1], scale * float(w[-1])


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[tuple[str, ...], ...]  # the languages of each family
    names: tuple[str, ...]
    family_weights: np.ndarray  # families x dimensions
    family_bias: np.ndarray
    pairs: tuple[tuple[int, int, int], ...]  # family, language, language: positive for the first
    pair_weights: np.ndarray
    pair_bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[str | None], np.ndarray]:
        """Language, family and score of each text."""
        x = features(texts)
        p_family = 1.0 / (1.0 + np.exp(-(x @ self.family_weights.T + self.family_bias)))
        p_family = (p_family + 1e-9) / (p_family + 1e-9).sum(axis=1, keepdims=True)
        family = p_family.argmax(axis=1)
        margin = x @ self.pair_weights.T + self.pair_bias if self.pairs else np.zeros((len(texts), 0))
        votes = [np.zeros((len(texts), len(f))) for f in self.families]
        for k, (f, a, b) in enumerate(self.pairs):
            p = 1.0 / (1.0 + np.exp(-np.clip(margin[:, k], -50, 50)))
            votes[f][:, a] += p
            votes[f][:, b] += 1.0 - p
        languages, chosen, score = [], [], np.zeros(len(texts))
        for i, f in enumerate(family):
            own = votes[f][i]
            share = own / own.sum() if len(own) > 1 else np.ones(1)
            best = int(share.argmax())
            languages.append(self.families[f][best])
            chosen.append(self.names[f])
            score[i] = min(1.0, p_family[i, f] * share[best])
        return languages, chosen, score


def train(texts: list[str], languages: list[str], families: dict[str, str] = FAMILIES) -> LanguageModel | None:
    if not texts:
        return None
    known = sorted(set(languages))
    groups: dict[str, list[str]] = {}
    for language in known:
        groups.setdefault(families.get(language, language), []).append(language)
    names = tuple(sorted(groups))
    x, y = features(texts), np.array(languages, object)
    of = np.array([families.get(language, language) for language in languages], object)
    if len(names) > 1:
        fitted = [machine(x, np.where(of == f, 1.0, -1.0)) for f in names]
        weights, bias = np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted])
    else:
        weights, bias = np.zeros((1, DIMENSIONS)), np.full(1, 50.0)
    pairs, pw, pb = [], [], []
    for k, f in enumerate(names):
        for a, b in combinations(range(len(groups[f])), 2):
            rows = (y == groups[f][a]) | (y == groups[f][b])
            w, c = machine(x[rows], np.where(y[rows] == groups[f][a], 1.0, -1.0))
            pairs.append((k, a, b))
            pw.append(w)
            pb.append(c)
    return LanguageModel(tuple(tuple(groups[f]) for f in names), names, weights.astype(np.float32), bias, tuple(pairs),
                         np.array(pw, np.float32).reshape(-1, DIMENSIONS), np.array(pb))


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 rows_per_language: int = ROWS_PER_LANGUAGE, families: dict[str, str] = FAMILIES) -> LanguageModel | None:
    """Learn from ``docs``: for each language the ``rows_per_language`` rows with the smallest hashes.

    A first filter by hash leaves about twice the wanted rows of each language, so that no task sorts a language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count()
    share = hash_share("text")
    order = Window.partitionBy("lang").orderBy("share", "text")
    sample = (
        rows.withColumn("share", share)
        .join(F.broadcast(counts), "lang")  # one row a language: as many as the model has classes
        .where(F.col("share") * F.col("count") <= 2.0 * rows_per_language + 20)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rows_per_language)
        .select("lang", "text", "rank")
    )
    got = sorted((r["lang"], r["rank"], r["text"]) for r in sample.toLocalIterator())
    return train([t for _, _, t in got], [language for language, _, _ in got], families)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, family and score of every row."""
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()),
                           T.StructField("family", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                texts = part.column("_text").to_pylist()
                lang, family, score = ["und"] * len(texts), [None] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
                if rows:
                    got = model.predict([texts[i] for i in rows])
                    for k, i in enumerate(rows):
                        lang[i], family[i], score[i] = got[0][k], got[1][k], got[2][k]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(family, pa.string()), pa.array(score)],
                    names=[id_col, "lang_pred", "family", "score"])

    return source.mapInArrow(run, schema)
