"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the whole lower-cased text (letters only, other characters as one space), square
roots of counts, scaled to length one. Families are separated by one-versus-one SVMs too. Training is stochastic
subgradient descent on the hinge loss with averaging, on a bounded sample of the labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import in_batches
from wattline.llm.registry import register, table

DIM = 4096
#: Labelled rows drawn per language, about (all of them where there are fewer). The only sample taken.
ROWS_PER_LANGUAGE = 800
UNKNOWN = "und"

#: Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs}

_LETTER = re.compile(r"[^\W\d_]")
# ASCII letters and all bytes of non-ASCII characters stay, the rest becomes a space
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def features(text: str) -> np.ndarray:
    """The hashed trigram vector of a whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIM, np.float32)
    gram = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    at = (gram * np.uint32(2654435761)) >> np.uint32(20)
    v = np.sqrt(np.bincount(at, minlength=DIM).astype(np.float32))
    return v / np.linalg.norm(v)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 15, penalty: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (y is -1 or 1); classes count alike whatever their sizes."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, seen, step = np.zeros_like(w), 0.0, 0, 0
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    weight = np.where(y > 0, share[1], share[-1])
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 32):
            rows = order[i : i + 32]
            step += 1
            rate = 1.0 / (1.0 + 0.01 * step)
            bad = y[rows] * (x[rows] @ w + b) < 1
            pull = (weight[rows] * y[rows] * bad) / len(rows)
            w = w * (1 - rate * penalty) + rate * (pull @ x[rows])
            b += rate * 0.1 * pull.sum()
            if epoch >= epochs // 2:
                seen += 1
                mean_w += (w - mean_w) / seen
                mean_b += (b - mean_b) / seen
    return mean_w, mean_b


@dataclass
class Model:
    """Pairs of names with a separating plane each: positive margins speak for the first name."""

    families: dict[str, list[str]]
    family_planes: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)
    planes: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0.5 to 1) of each row: the logistic of the weakest margin that decided."""
        names, margin = _vote(x, sorted(self.families), self.family_planes)
        out, score = [""] * len(x), margin
        for name in set(names):
            rows = [i for i, n in enumerate(names) if n == name]
            langs, inner = _vote(x[rows], self.families[name], self.planes)
            score[rows] = np.minimum(score[rows], inner)
            for i, lang in zip(rows, langs, strict=True):
                out[i] = lang
        return out, 1 / (1 + np.exp(-np.clip(2 * score, 0, 50)))


def _vote(x: np.ndarray, names: list[str], planes: dict) -> tuple[list[str], np.ndarray]:
    """One-versus-one vote: the name with most wins (then the largest margin sum), and its smallest margin."""
    if len(names) == 1:
        return names * len(x), np.full(len(x), 25.0)
    wins, total, least = (np.zeros((len(x), len(names))) for _ in range(3))
    least += 25.0
    for (a, b), (w, bias) in planes.items():
        if a in names and b in names:
            m = x @ w + bias
            for k, side in ((names.index(a), m), (names.index(b), -m)):
                wins[:, k] += side > 0
                total[:, k] += side
                least[:, k] = np.minimum(least[:, k], side)
    best = np.argmax(wins * 1e6 + total, axis=1)
    return [names[k] for k in best], np.maximum(least[np.arange(len(x)), best], 0)


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    fam = np.array([family_of(lang) for lang in langs])
    model = Model(families)
    for a, b in combinations(sorted(families), 2):
        rows = (fam == a) | (fam == b)
        model.family_planes[a, b] = train_svm(x[rows], np.where(fam[rows] == a, 1, -1))
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = (langs == a) | (langs == b)
            model.planes[a, b] = train_svm(x[rows], np.where(langs[rows] == a, 1, -1))
    return model


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def share_by_hash(id_col: str, rate: Column, seed: int) -> Column:
    """Keeps about ``rate`` of the rows, the same ones whenever it runs."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < rate * 1_000_000


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from the rows that ``learn`` allows and that have a language and a letter; None if there are none.

    One row per language is brought to the driver to count them (languages are few), then at most about
    ``per_language`` feature vectors of each.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(per_language / n)).otherwise(rate)
    drawn = rows.where(share_by_hash(id_col, rate, 4)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, "text", 4_000_000):
            frame = frame[[has_letter(t) for t in frame["text"]]]
            yield pd.DataFrame({"lang": frame["lang"], "v": [features(t).astype(np.float16).tobytes() for t in frame["text"]]})

    got = drawn.mapInPandas(vectors, "lang string, v binary").toPandas().sort_values(["lang", "v"])
    if got.empty:
        return None
    return fit(np.stack([np.frombuffer(v, np.float16) for v in got["v"]]).astype(np.float32), got["lang"].to_numpy())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) of each whole text, from the text alone.

    A text that is null or has no letter, and any text without a model, is ``und`` with score 0. Columns of these names
    are replaced; all others stay. Rows are taken one by one, so repeated rows and an empty table need no rule.
    """
    made = {"lang_pred": "string", "lang_score": "double"}
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{c} {t}" for c, t in made.items())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, text_col, 2_000_000):
            lang, score = [UNKNOWN] * len(frame), np.zeros(len(frame))
            rows = [i for i, t in enumerate(frame[text_col]) if model and has_letter(t)]
            if rows:
                texts = frame[text_col].tolist()
                found, score[rows] = model.predict(np.stack([features(texts[i]) for i in rows]))
                for i, name in zip(rows, found, strict=True):
                    lang[i] = name
            out = frame[kept].copy()
            out["lang_pred"], out["lang_score"] = lang, score
            yield out

    return docs.mapInPandas(run, schema)


@register("op4_family_svm")
def op4_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    model = train(docs, ~held_out)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
