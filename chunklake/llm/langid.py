"""Language ID by hierarchical discrimination.

First the language's family is predicted (linear support vector machines, one against one, over all families), then one-versus-
one linear support vector machines separate the languages of that family. Features are hashed byte bigrams and trigrams of
the whole text. The score is the family's probability times the language's, each from the machines' summed margins.

Fitting uses a bounded sample: about ``per_language`` labelled documents of each language (by a hash of doc_id), fewer where there are so
many languages that they would be more than ``most_rows`` in total, but one of each at least; so the driver holds about ``most_rows`` rows
of DIMS numbers and one for each language, whatever the corpus. Every language is learned. The ``most_languages`` most frequent ones
get machines; all others are one family (REST) in which the nearest mean of a language's vectors decides, as pairs of machines would grow with
the square of their number.

Cases: null text, or text without a letter, gives ``und`` and score 0; rows without a language or text are not learned from; one
known language only: it is predicted with score 1; no labelled row at all: ``und``; repeated rows get one answer each, the same;
other columns aren't read (``identified`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import replacing
from chunklake.llm.features import collected, ngrams, unit_hash
from chunklake.llm.tokens import chunks

DIMS = 2048
#: A-Z in lower case; letters and what is beyond ASCII stay, the rest is a blank.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
NON_LETTERS = bytes(c for c in range(256) if c >= 128 or not chr(c).isalpha())
#: Families of languages by ISO code; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu se",
    "indic": "bn gu hi mr ne or pa sa si ur",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
REST = "(rest)"
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes weighted alike (accelerated gradient descent). y: 1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)  # the last one is the bias; x isn't copied to hold a column for it
    ahead, rate = w.copy(), np.float32(1 / (4 + ridge))  # rows have length sqrt(2) at most
    for t in range(steps):
        pull = weight * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - rate * (ridge * ahead - 2 * np.append(x.T @ pull, pull.sum()))
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """s with which 1 / (1 + exp(-s * margin)) fits y best."""
    return min((0.5 * 1.3**k for k in range(20)), key=lambda s: np.logaddexp(0, -s * margin * y).mean())


@dataclass
class OneVersusOne:
    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        out = cls(sorted(set(labels.tolist())))
        found = []
        for a, b in combinations(out.classes, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            y = np.where(labels[rows] == a, 1, -1).astype(np.float32)
            own = x if len(rows) == len(x) else x[rows]
            w, bias = svm(own, y)
            found.append((w, bias, slope(own @ w + bias, y)))
        if found:
            out.weights, out.bias, out.slopes = (np.array(v, np.float32) for v in zip(*found, strict=True))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), len(self.classes)))
        if len(self.classes) > 1:
            margin = (x @ self.weights.T + self.bias) * self.slopes
            for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
                z[:, a] += margin[:, k] / 2
                z[:, b] -= margin[:, k] / 2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


@dataclass
class NearestMean:
    """For very many classes: one vector each, however many there are."""

    classes: list[str]
    means: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> NearestMean:
        classes = sorted(set(labels.tolist()))
        means = np.stack([x[labels == c].mean(0) for c in classes])
        return cls(classes, (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)).astype(np.float32))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = 20.0 * (x @ self.means.T).astype(np.float64)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


@dataclass
class Model:
    families: OneVersusOne
    languages: dict[str, OneVersusOne | NearestMean]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, family and score of each row."""
        p = self.families.probabilities(x)
        chosen = p.argmax(1)
        lang, score = np.full(len(x), "und", object), np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                own = self.languages[name]
                q = own.probabilities(x[rows])
                best = q.argmax(1)
                lang[rows] = np.array(own.classes, object)[best]
                score[rows] = p[rows, k] * q[np.arange(len(rows)), best]
        return lang, np.array(self.families.classes, object)[chosen] if self.families.classes else lang, score


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(text.translate(None, NON_LETTERS)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def vectors(texts: list[bytes]) -> np.ndarray:
    return ngrams(texts, LETTERS, DIMS)


def fit(docs: DataFrame, per_language: int = 1000, most_languages: int = 50, most_rows: int = 20_000) -> Model:
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    place = [unit_hash(21).alias("u"), F.xxhash64("text").alias("t")]
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("low")).orderBy(F.desc("n"), "lang").collect()  # one row for each language
    if not counts:
        return Model(OneVersusOne([]), {})
    wanted = min(per_language, most_rows / len(counts))
    shares = docs.sparkSession.createDataFrame([(r.lang, wanted / r.n, *r.low) for r in counts], "_lang string, _share double, _u double, _t long")
    lowest = (place[0] == F.col("_u")) & (place[1] == F.col("_t"))  # a small share may take no other document of a language
    sampled = labelled.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where((place[0] < F.col("_share")) | lowest)
    labels, x = collected(sampled, F.col("lang"), vectors)
    own = {r.lang for r in counts[:most_languages]}
    y = np.array(labels, object)
    fam = np.array([family(v) if v in own else REST for v in labels], object)
    languages = {f: (NearestMean if f == REST else OneVersusOne).fit(x[fam == f], y[fam == f]) for f in sorted(set(fam.tolist()))}
    return Model(OneVersusOne.fit(x, fam), languages)


def _answers(model: Model, texts: list[bytes | None]) -> tuple[list[str], list[str], list[float]]:
    lang, fam, score = np.full(len(texts), "und", object), np.full(len(texts), "und", object), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if has_letter(t)] if model.families.classes else []
    if rows:
        lang[rows], fam[rows], score[rows] = model.predict(vectors([texts[i] for i in rows]))
    return lang.tolist(), fam.tolist(), np.clip(score, 0, 1).tolist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, family_pred and score of every document."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in chunks(iter([b])):
                lang, fam, score = _answers(model, c.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(fam, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "family_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(batches, "doc_id long, lang_pred string, family_pred string, score double")


def accepted(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs with a predicted language (one of ``languages``, if given) and a score of ``least`` or more.

    The rows pass through Python whole, so that texts aren't shuffled.
    """
    schema = docs.schema

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = b.schema.names.index("text")
            for c in chunks(iter([b]), at):
                lang, _, score = _answers(model, c.column(at).cast(pa.binary()).to_pylist())
                keep = [v != "und" and (languages is None or v in languages) and s >= least for v, s in zip(lang, score, strict=True)]
                yield c.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(batches, schema)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, joined by doc_id."""
    p = predict(docs, model).groupBy(F.col("doc_id").alias("id")).agg(F.first("lang_pred").alias("l"), F.first("score").alias("s"))
    return replacing(docs.join(p, F.col("doc_id").eqNullSafe(F.col("id"))), lang_pred=F.col("l"), score=F.col("s")).drop("id", "l", "s")
