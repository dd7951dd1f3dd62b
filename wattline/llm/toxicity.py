"""Toxicity by a small convolutional text classifier, written in numpy.

Words (letters and digits, lower case) get hashed embeddings: the sum of those of the whole word and of its beginnings,
which endings leave alone. Filters of several widths run over a whole text, each followed by a rectifier and the maximum
over all positions; a logistic layer weighs the maxima. For scoring, embedding times filter is tabulated per hash bucket,
so a text costs look-ups and additions.

A small balanced draw sets a common start; then every task trains a copy on all the labelled texts it holds, and the copies
are averaged: a hash bucket by the steps that touched it, all else by the texts read.

The decision threshold is calibrated by language, on all rows kept out of the gradient steps, which are counted by logit
in fine bins. The language is guessed from the text's function words; a language column is never read. A score is
shifted so that 0.5 is the threshold.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import discard, in_batches, stash
from wattline.llm.language import id_remainder, share_by_hash
from wattline.llm.registry import register, table

BUCKETS = 1 << 17
#: Beginnings of a word, in bytes, that are hashed beside the whole word.
BEGINNINGS = (4, 5, 6)
PARTS = 1 + len(BEGINNINGS)
EMBEDDING = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of each class, about (all where there are fewer), that set the common start, which leaves out rows with more
#: words. All rows, however long, are trained on after it.
START_PER_CLASS = 2000
START_WORDS = 5000
#: Rounds of training on all rows with averaging.
ROUNDS = 2
#: Words whose windows are laid out at once in training.
BLOCK_WORDS = 1 << 16
#: Calibration counts rows by logit, in bins of 1 / ``FINE`` up to ``FARTHEST`` either way.
FINE, FARTHEST = 256, 64

#: Frequent function words of some languages.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for"),
    "de": ("der", "die", "und", "den", "das", "ist", "von", "des", "ein", "zu"),
    "fr": ("le", "les", "et", "des", "est", "une", "dans", "pour", "qui", "du"),
    "es": ("el", "los", "las", "que", "por", "con", "una", "del", "y", "para"),
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def bucket_ids(text: str | None) -> np.ndarray:
    """Hash buckets (from 1; 0: none) of the words of a whole text and of their beginnings, one row per word."""
    found = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    out = np.zeros((len(found), PARTS), np.int32)
    digest, most = xxhash.xxh32_intdigest, np.uint32(BUCKETS - 1)
    out[:, 0] = np.array([digest(w) for w in found], np.uint32) % most + 1
    sizes = np.array([len(w) for w in found], np.int32)
    for k, n in enumerate(BEGINNINGS, 1):
        rows = np.flatnonzero(sizes >= n)
        out[rows, k] = np.array([digest(found[r][:n], k) for r in rows.tolist()], np.uint32) % most + 1
    return out


def _language_table() -> np.ndarray:
    out = np.zeros(BUCKETS, np.int8)
    for k, names in enumerate(LANGUAGES[1:], 1):
        for w in FUNCTION_WORDS[names]:
            out[bucket_ids(w)[:, 0]] = k
    return out


@dataclass
class Network:
    embedding: np.ndarray  # buckets x EMBEDDING; row 0 stays zero
    filters: list[np.ndarray]  # per width: (width * EMBEDDING) x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray  # of no dimension

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (BUCKETS, EMBEDDING)).astype(np.float32)
        e[0] = 0
        f = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(e, f, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros((), np.float32))

    def pooled(self, ids: np.ndarray, starts: np.ndarray, block: int = BLOCK_WORDS) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
        """Maxima per text and filter, with the positions of the maxima and the words' ids by place in a window; blocks of
        words bound the memory of long texts."""
        ends = np.append(starts[1:], len(ids))
        padded = np.vstack([ids, np.zeros((max(WIDTHS), PARTS), ids.dtype)])
        maxima = [np.full((len(starts), FILTERS), -1, np.float32) for _ in WIDTHS]
        places = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
        for at in range(0, len(ids), block):
            stop = min(at + block, len(ids))
            vectors = self.embedding[padded[at : stop + max(WIDTHS)]].sum(axis=1)
            first, last = int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, stop, side="left"))
            own = slice(first, last)
            cuts, stops = np.maximum(starts[own], at) - at, np.minimum(ends[own], stop) - at
            for k, w in enumerate(WIDTHS):
                x = np.hstack([vectors[j : j + stop - at] for j in range(w)])
                a = np.maximum(x @ self.filters[k] + self.bias[k], 0)
                top = np.maximum.reduceat(a, cuts, axis=0)
                place = np.stack([s + np.argmax(a[s:e], axis=0) for s, e in zip(cuts, stops, strict=True)]) + at
                better = top > maxima[k][own]
                maxima[k][own][better], places[k][own][better] = top[better], place[better]
        return np.hstack(maxima), places, [[padded[j : j + len(ids)] for j in range(w)] for w in WIDTHS]

    def dense(self) -> list[np.ndarray]:
        """All parameters but the embedding."""
        return [*self.filters, *self.bias, self.out, self.out_bias]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, memory: Memory, passes: int, batch: int = 16, rate: float = 0.01, seed: int = 0) -> None:
        """Adam steps on the weighted logistic loss; the gradient of a maximum goes to the window where it was reached."""
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                ids, starts = joined([texts[r] for r in rows])
                m, places, windows = self.pooled(ids, starts)
                p = 1 / (1 + np.exp(-np.clip(m @ self.out + self.out_bias, -30, 30)))
                d = ((p - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
                g_out, g_m = m.T @ d + 1e-4 * self.out, d[:, None] * self.out * (m > 0)
                g_f, g_b, touched, g_e = [], [], [], []
                for k in range(len(WIDTHS)):
                    g = g_m[:, k * FILTERS : (k + 1) * FILTERS]
                    seen = np.stack([x[places[k]] for x in windows[k]], axis=2)  # texts x filters x width x parts
                    x = self.embedding[seen].sum(axis=3).reshape(*places[k].shape, -1)
                    g_f.append(np.einsum("tf,tfx->xf", g, x))
                    g_b.append(g.sum(0))
                    touched.append(seen.reshape(-1))
                    g_e.append(np.repeat((g[:, :, None] * self.filters[k].T[None]).reshape(-1, EMBEDDING), PARTS, axis=0))
                memory.step += 1
                self.out_bias -= rate * d.sum()
                for q, grad, (a, b) in zip([*self.filters, *self.bias, self.out], [*g_f, *g_b, g_out], memory.moments, strict=True):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    q -= rate * (a / (1 - 0.9**memory.step)) / (np.sqrt(b / (1 - 0.999**memory.step)) + 1e-8)
                at, grads = np.concatenate(touched), np.concatenate(g_e)
                uniq, back = np.unique(at, return_inverse=True)
                total = np.zeros((len(uniq), EMBEDDING), np.float32)
                np.add.at(total, back, grads)
                memory.scale[uniq] += (total**2).mean(1, keepdims=True)
                memory.met[uniq] += 1
                self.embedding[uniq] -= 0.1 * total / np.sqrt(memory.scale[uniq])
                self.embedding[0] = 0


@dataclass
class Memory:
    """What the steps so far leave to the next ones."""

    step: int = 0
    moments: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=lambda: [(np.zeros_like(p), np.zeros_like(p)) for p in Network.new().dense()[:-1]])
    scale: np.ndarray = field(default_factory=lambda: np.full((BUCKETS, 1), 1e-6, np.float32))  # embeddings: Adagrad on the rows that a step touches
    met: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int64))  # steps that touched each row


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids one after another, and where each begins. Padding as wide as the widest filter goes before each text,
    so that a window that begins in a text never reaches the words of the next one."""
    pad = np.zeros((max(WIDTHS), PARTS), np.int32)
    ids = np.concatenate([x for t in texts for x in (pad, t)])
    sizes = np.array([len(t) + len(pad) for t in texts])
    return ids, np.cumsum(sizes) - sizes


class Scorer:
    """A trained network as look-up tables, with a shift per guessed language."""

    def __init__(self, net: Network):
        self.net, self.threshold = net, np.zeros(len(LANGUAGES))
        self._tabulate()

    def _tabulate(self) -> None:
        net = self.net
        self.tables = [[(net.embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        self.bias, self.out, self.out_bias = net.bias, net.out.astype(np.float64), net.out_bias
        self.language_of = _language_table()

    def __getstate__(self) -> tuple:
        """The network and the thresholds travel; the tables, six times as large, are made where they are used."""
        return self.net, self.threshold

    def __setstate__(self, state: tuple) -> None:
        self.net, self.threshold = state
        self._tabulate()

    def logits(self, texts: list[np.ndarray], block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text; blocks of words bound the memory of long texts."""
        ids, starts = joined(texts)
        best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        votes = np.zeros((len(texts), len(LANGUAGES)), np.int64)
        reach = max(WIDTHS) - 1
        for at in range(0, len(ids), block):
            span = ids[at : at + block + reach]
            n = min(block, len(ids) - at)
            first = int(np.searchsorted(starts, at, side="right")) - 1
            last = int(np.searchsorted(starts, at + n, side="left"))
            cuts = np.maximum(starts[first:last] - at, 0)
            for k, w in enumerate(WIDTHS):
                a = np.zeros((n, FILTERS), np.float32)
                for j in range(w):
                    for part in range(PARTS):
                        piece = self.tables[k][j][span[j : j + n, part]]
                        a[: len(piece)] += piece
                top = np.maximum.reduceat(a, cuts, axis=0) + self.bias[k]
                held = best[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(held, top, out=held)
            lang = self.language_of[span[:n, 0]]
            for k in range(1, len(LANGUAGES)):
                votes[first:last, k] += np.add.reduceat((lang == k).astype(np.int64), cuts)
        return best @ self.out + self.out_bias, np.argmax(votes, axis=1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        logit, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logit - self.threshold[lang], -40, 40)))

    def calibrate(self, counted: pd.DataFrame, least: int = 20) -> None:
        """Per guessed language the logit that gives the best F1; a language with few labels takes the common one.

        ``counted``: (lang, at, toxic, n), the toxic and all rows of each language and bin of logits.
        """
        common = _best_cut(counted)
        for k in range(len(LANGUAGES)):
            rows = counted[counted["lang"] == k]
            enough = rows["toxic"].sum() >= least and (rows["n"] - rows["toxic"]).sum() >= least
            self.threshold[k] = _best_cut(rows) if enough else common


def _best_cut(counted: pd.DataFrame) -> float:
    """The middle between the two neighbouring bins where a cut gives the best F1."""
    rows = counted.groupby("at")[["toxic", "n"]].sum().sort_index(ascending=False)
    at, hit, said = rows.index.to_numpy(), rows["toxic"].cumsum().to_numpy(), rows["n"].cumsum().to_numpy()
    if not len(at) or not hit[-1]:
        return 0.0
    k = int(np.argmax(2 * hit / (said + hit[-1])))
    return float(at[k] + at[k + 1] + 1) / 2 / FINE if k + 1 < len(at) else float(at[k]) / FINE - 1.0


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = START_PER_CLASS) -> Scorer | None:
    """A scorer from all labelled rows that ``learn`` (over the id) allows; None if one of the classes is missing.

    An id with several labels counts as toxic if one of them says so. A fifth of the rows, by a hash of the id, calibrates; all
    others are trained on. About ``per_class`` rows of each class set the common start.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic")).where(learn)
    texts = docs.where(learn).select(F.col(id_col), F.col(text_col).alias("text")).join(marked.hint("merge"), id_col)
    known = stash(texts.withColumn("_held", share_by_hash(id_col, F.lit(0.2), 66)), "labelled")
    sizes = {(r["_held"], r["_toxic"]): r["count"] for r in known.groupBy("_held", "_toxic").count().collect()}
    scorer = _trained(known, id_col, sizes, per_class) if {(False, 0), (False, 1)} <= sizes.keys() else None
    discard(known)
    return scorer


def _trained(known: DataFrame, id_col: str, sizes: dict, per_class: int) -> Scorer:
    spark = known.sparkSession
    ours = known.where("not _held")
    net, memory = Network.new(), Memory()

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, "text", 4_000_000):
            found = [bucket_ids(t) for t in frame["text"]]
            yield pd.DataFrame({"ids": [f.tobytes() for f in found], "toxic": frame["_toxic"]})[[len(f) <= START_WORDS for f in found]]

    rate = F.when(F.col("_toxic") == 1, F.lit(per_class / sizes[False, 1])).otherwise(F.lit(per_class / sizes[False, 0]))
    got = ours.where(share_by_hash(id_col, rate, 6)).select("text", "_toxic").mapInPandas(ids, "ids binary, toxic int").toPandas().sort_values(["toxic", "ids"])
    if len(got):
        found = [np.frombuffer(x, np.int32).reshape(-1, PARTS) for x in got["ids"]]
        net.fit(found, got["toxic"].to_numpy(), np.ones(len(got), np.float32), memory, min(40, max(6, 24_000 // len(got))))

    # both classes weigh the same in all
    weight = {c: (sizes[False, 0] + sizes[False, 1]) / 2 / sizes[False, c] for c in (0, 1)}
    cells = [f"e{k}" for k in range(EMBEDDING)]
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((net, memory))

        def learn_all(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, memory = copy.deepcopy(shared.value)
            memory.met[:] = 0
            read = 0
            for frame in in_batches(frames, "text", 4_000_000):
                y = frame["_toxic"].to_numpy()
                own.fit([bucket_ids(t) for t in frame["text"]], y, np.where(y == 1, weight[1], weight[0]).astype(np.float32), memory, 1, rate=0.003)
                read += len(y)
            if read:
                at = np.flatnonzero(memory.met)
                dense = _rows_of(own)
                n = np.concatenate([memory.met[at], np.full(len(dense), read)])
                scale = np.concatenate([memory.scale[at, 0] - shared.value[1].scale[at, 0], np.zeros(len(dense))])
                sums = np.vstack([own.embedding[at], dense]).astype(np.float64) * n[:, None]
                yield pd.DataFrame({"at": np.concatenate([at, BUCKETS + np.arange(len(dense))]), "n": n, "scale": scale, **dict(zip(cells, sums.T, strict=True))})

        schema = "at long, n long, scale double, " + ", ".join(f"{c} double" for c in cells)
        added = ours.select("text", "_toxic").mapInPandas(learn_all, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "scale", *cells)]).toPandas()
        at, mean = added["at"].to_numpy(), (added[cells].to_numpy() / added["n"].to_numpy()[:, None]).astype(np.float32)
        word = at < BUCKETS
        net.embedding[at[word]] = mean[word]
        net.embedding[0] = 0
        memory.scale[at[word], 0] += added["scale"].to_numpy()[word].astype(np.float32)
        _set_rows(net, mean[~word][np.argsort(at[~word])])

    scorer = Scorer(net)
    shared = spark.sparkContext.broadcast(scorer)

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_batches(frames, "text", 4_000_000):
            logit, lang = shared.value.logits([bucket_ids(t) for t in frame["text"]])
            at = np.floor(np.clip(logit, -FARTHEST, FARTHEST) * FINE).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "at": at, "toxic": frame["_toxic"].to_numpy()})

    apart = known.where("_held") if {(True, 0), (True, 1)} <= sizes.keys() else ours
    counted = apart.select("text", "_toxic").mapInPandas(tally, "lang int, at long, toxic long")
    scorer.calibrate(counted.groupBy("lang", "at").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).toPandas())
    return scorer


def _rows_of(net: Network) -> np.ndarray:
    """All parameters but the embedding, in rows as wide as an embedding."""
    flat = np.concatenate([p.ravel() for p in net.dense()])
    return np.append(flat, np.zeros(-len(flat) % EMBEDDING, np.float32)).reshape(-1, EMBEDDING)


def _set_rows(net: Network, rows: np.ndarray) -> None:
    flat = rows.ravel()
    for p in net.dense():
        p[...], flat = flat[: p.size].reshape(p.shape), flat[p.size :]


def score_toxicity(docs: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_pred`` (1 from 0.5 on) of each whole text.

    A null text counts as empty; an empty text is scored like any other; without a scorer every score is 0. Columns of
    these names are replaced; all others stay. Rows are taken one by one, so repeated rows and an empty table need no rule.
    """
    made = {"toxicity": "double", "toxic_pred": "int"}
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{c} {t}" for c, t in made.items())])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in in_batches(frames, text_col, 4_000_000):
            score = model.scores([bucket_ids(t) for t in frame[text_col]]) if model else np.zeros(len(frame))
            out = frame[kept].copy()
            out["toxicity"], out["toxic_pred"] = score, (score >= 0.5).astype(np.int32)
            yield out

    return docs.mapInPandas(run, schema)


@register("op6_cnn_toxicity")
def op6_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 5) == 0
    scorer = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = score_toxicity(docs, scorer)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_pred").alias("predicted"))
