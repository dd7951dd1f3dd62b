"""Document log-likelihood under a gated recurrent language model.

Counts. All tokens (words, and one end per text) of the training documents are counted by a 64-bit key, exactly.
Model. A gated recurrent unit reads the previous token; its state gives a softmax over classes and, in a class of frequent
words, a softmax over its words. Frequent words are dealt into classes by rank; every other word, known or not, belongs to
a class by its last two bytes, in which its probability comes from the counts, with one place for unknown words.
Training. Truncated back-propagation through time over all training documents: a first pass over a sample sets a common
start, then every task trains a copy on all the training documents it holds, and the copies are averaged by tokens.
Scoring. Texts are read in windows in parallel lanes; the state is carried from window to window through a whole document,
however long, and begins anew at the next one. Counts of frequent words travel to all tasks (a bounded table); those of
the others are joined by key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import in_batches, stash
from wattline.llm.language import id_remainder
from wattline.llm.registry import register, table

HIDDEN = 16
#: Words with an output of their own, and the classes they are dealt into.
FREQUENT, WORD_CLASSES = 2048, 48
#: Classes of all other words, by their last two bytes. A power of two: the low bits of a key.
ENDINGS = 64
CLASSES = WORD_CLASSES + ENDINGS
#: Counts that travel to all tasks: those of the most frequent words, at most so many (16 bytes each). Others are joined.
TRAVELLING = 1 << 18
LANES, WINDOW = 512, 16
#: Documents that set the common start: about so many.
START_DOCUMENTS = 1500
CHUNK_CHARS = 4_000_000
#: Positions whose class softmax is held at once, so that it stays in a core's cache. Changes no result but by rounding.
OUTPUT_ROWS = 1024
#: Bytes that are hashed at once (more only for a longer word).
HASH_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Key of the end of a text (a word gets it by chance with a likelihood of 2 ** -64 only).
END = np.int64(10)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n or more; kept and grown by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 2**64))])
    _powers[base] = have
    return have


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts, ends included, and the tokens of each text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A key mixes a polynomial hash of the word's bytes; its low
    bits are the class of the last two bytes.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    text_ends = np.cumsum([len(d) + 1 for d in data])  # place of the line break behind each text
    h = np.zeros(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(buffer), HASH_BYTES))
    for a, b in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
        if b > a:
            low, high = starts[a] - 1, ends[b - 1]
            with np.errstate(over="ignore"):
                total = np.cumsum(_BYTE[buffer[low:high]] * _power_table(_R, high - low)[: high - low], dtype=np.uint64)
                h[a:b] = _mix((total[ends[a:b] - 1 - low] - total[starts[a:b] - 1 - low]) * _power_table(_R_INV, high - low)[starts[a:b] - low])
    before = np.where(ends - starts > 1, buffer[ends - 2], 0).astype(np.int64)
    ending = (buffer[ends - 1].astype(np.int64) * 31 + before * 7) % ENDINGS
    keys = ((h & _U(2**64 - ENDINGS)) | ending.astype(np.uint64)).view(np.int64)
    owner = np.searchsorted(text_ends, starts)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(len(keys) + len(texts), END, np.int64)
    out[np.arange(len(keys)) + owner] = keys
    return out, sizes


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, c): occurrences of each token in all texts. Each task sends the distinct keys it met."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in in_batches(frames, text_col, CHUNK_CHARS // 2):
            k, c = np.unique(token_keys(frame[text_col].tolist())[0], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, c]), len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield pd.DataFrame({"key": keys, "c": n})
                keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pd.DataFrame({"key": keys, "c": n})

    return docs.select(text_col).mapInPandas(tally, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words by class, and what is known of the classes of the others."""

    total: int  # N
    distinct: int  # V
    keys: np.ndarray  # travelling keys, sorted
    counts: np.ndarray
    symbol: np.ndarray  # symbol of each travelling key, -1 for those without an output of their own
    class_of: np.ndarray  # of each frequent word, by symbol
    members: list[np.ndarray]  # symbols of each word class
    rest_log10: np.ndarray  # per ending: log10 of (N_k + 0.1 (V_k + 1)) over the other words

    @property
    def end_symbol(self) -> int:
        return int(self.symbol[np.searchsorted(self.keys, END)])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input symbol of each key (frequent words, then ``FREQUENT`` + ending), and its count, -1 where it must be joined."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        met = self.keys[at] == keys
        symbol = np.where(met, self.symbol[at], -1)
        return np.where(symbol >= 0, symbol, FREQUENT + (keys & (ENDINGS - 1))).astype(np.int32), np.where(met, self.counts[at], -1)


def vocabulary(counts: DataFrame) -> Vocabulary | None:
    """From the stored counts; None if nothing was counted."""
    ending = F.col("key").bitwiseAND(F.lit(ENDINGS - 1))
    sums = {r["e"]: (r["n"], r["v"]) for r in counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    if not sums:
        return None
    # the lowest count that travels, from a histogram of counts in sixteenths of an octave
    octave = F.floor(F.log2(F.col("c")) * 16).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count("*").alias("v")).collect(), reverse=True):
        if held + r["v"] > TRAVELLING - 1:
            break
        least, held = r["o"], held + r["v"]
    chosen = F.col("key") == int(END)
    top = counts.where(chosen if least is None else chosen | (octave >= least)).toPandas().sort_values(["c", "key"], ascending=[False, True])
    keys, c = top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    rank = np.flatnonzero((np.arange(len(keys)) < FREQUENT - 1) | (keys == END))
    symbol = np.full(len(keys), -1, np.int32)
    symbol[rank] = np.arange(len(rank))
    # classes of about equal mass in square roots of counts, most frequent words first
    mass = np.cumsum(np.sqrt(c[rank]))
    class_of = np.minimum(WORD_CLASSES - 1, (mass - np.sqrt(c[rank])) * WORD_CLASSES / mass[-1]).astype(np.int32)
    n_rest, v_rest = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for e, (n, v) in sums.items():
        n_rest[e], v_rest[e] = n, v
    np.subtract.at(n_rest, keys[rank] & (ENDINGS - 1), c[rank])
    np.subtract.at(v_rest, keys[rank] & (ENDINGS - 1), 1)
    order = np.argsort(keys)
    return Vocabulary(
        sum(n for n, _ in sums.values()), sum(v for _, v in sums.values()), keys[order], c[order], symbol[order], class_of,
        [np.flatnonzero(class_of == k) for k in range(WORD_CLASSES)], np.log10(n_rest + 0.1 * (v_rest + 1)),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """``x`` is used up."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exponentials(logit: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray | None]:
    """exp of the logits and what was taken off each row before (None: nothing); ``logit`` is used up.

    ``anchor``: a column of large bias. No row's sum leaves the range of float32.
    """
    top = None
    if logit.size and (logit.max() > 60 or logit[:, anchor].min() < -60):
        top = logit.max(axis=1)
        logit -= top[:, None]
    return np.exp(logit, out=logit), top


def _gradient_at(s: np.ndarray, w: np.ndarray, bias: np.ndarray, at: np.ndarray, scale: np.float32) -> tuple[np.ndarray, ...]:
    """Gradients by ``s``, ``w`` and ``bias`` of ``scale`` times the summed loss of softmax(s @ w.T + bias) in columns ``at``."""
    q = s @ w.T
    q += bias
    q, _ = _exponentials(q, int(bias.argmax()))
    total = q @ np.ones(q.shape[1], q.dtype)
    q[np.arange(len(at)), at] -= total
    share = scale / total
    return (q @ w) * share[:, None], q.T @ (s * share[:, None]), share @ q


def _log_softmax_at(logit: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of (logit + bias) in column ``at`` of each row; ``logit`` is used up."""
    logit += bias
    picked = logit[np.arange(len(at)), at].astype(np.float64)
    shares, top = _exponentials(logit, int(bias.argmax()))
    if top is not None:
        picked -= top
    return picked - np.log(shares @ np.ones(logit.shape[1], logit.dtype))


class Model:
    """Gated recurrent unit with a class-factored softmax; all parameters in float32 arrays by name."""

    def __init__(self, vocab: Vocabulary, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        freq = np.zeros(FREQUENT)
        own = vocab.symbol >= 0
        freq[vocab.symbol[own]] = vocab.counts[own]
        class_n = np.bincount(vocab.class_of, freq[: len(vocab.class_of)], CLASSES)
        class_n[WORD_CLASSES:] = 10**vocab.rest_log10
        self.vocab = vocab
        self.p = {
            "x": rng.normal(0, 0.2, (FREQUENT + ENDINGS, 3 * h)),  # input symbol to gates
            "u": rng.normal(0, h**-0.5, (h, 3 * h)),
            "b": np.concatenate([np.full(h, 1.0), np.zeros(2 * h)]),
            "wc": rng.normal(0, 0.05, (h, CLASSES)),
            "bc": np.log(class_n + 1),
            "ww": rng.normal(0, 0.05, (FREQUENT, h)),
            "bw": np.log(freq + 1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def copy(self) -> Model:
        out = object.__new__(Model)
        out.vocab, out.p = self.vocab, {k: v.copy() for k, v in self.p.items()}
        return out

    def targets(self, symbols: np.ndarray) -> np.ndarray:
        """Class of each symbol."""
        own = symbols < FREQUENT
        return np.where(own, self.vocab.class_of[np.where(own, symbols, 0)], WORD_CLASSES + symbols - FREQUENT)

    def gates(self, symbols: np.ndarray) -> np.ndarray:
        """What the input symbols add to the gates."""
        return (self.p["x"] + self.p["b"]).take(symbols, axis=0)

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states after the input symbols, and what their gradient needs."""
        return self.advance(self.gates(symbols), h)

    def advance(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``step``, from rows ``g`` of ``gates``, which a whole window looks up at once."""
        n = HIDDEN
        u = h @ self.p["u"]
        zr = _sigmoid(g[:, : 2 * n] + u[:, : 2 * n])
        z, r, un = zr[:, :n], zr[:, n:], u[:, 2 * n :]
        cand = r * un
        cand += g[:, 2 * n :]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= z
        new += cand
        return new, z, r, cand, un

    def log10_output(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol's class, and for frequent words also of the word in it."""
        cls = self.targets(symbols)
        out = np.empty(len(states))
        for a in range(0, len(states), OUTPUT_ROWS):
            some = slice(a, a + OUTPUT_ROWS)
            out[some] = _log_softmax_at(states[some] @ self.p["wc"], self.p["bc"], cls[some])
        rows, classes = self._by_class(symbols, cls)
        held, own = states[rows], symbols[rows]
        for part, words in classes:
            out[rows[part]] += _log_softmax_at(held[part] @ self.p["ww"][words].T, self.p["bw"][words], own[part] - words.start)
        return out / np.log(10)

    def _by_class(self, symbols: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """Positions of frequent words, ordered by class, and for each class of several words its part of them and its symbols.

        Classes follow the rank, so the symbols of one are neighbours.
        """
        rows = np.flatnonzero(symbols < FREQUENT)
        rows = rows[np.argsort(cls[rows].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(cls[rows], np.arange(WORD_CLASSES + 1)).tolist()
        several = [k for k in range(WORD_CLASSES) if cuts[k + 1] > cuts[k] and len(self.vocab.members[k]) > 1]
        return rows, [(slice(cuts[k], cuts[k + 1]), slice(int(self.vocab.members[k][0]), int(self.vocab.members[k][-1]) + 1)) for k in several]

    def log10_tokens(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 output of every token of some whole documents, given one after another."""
        begins = np.cumsum(sizes) - sizes
        longest = int(sizes.max())
        lanes = max(1, min(LANES, len(sizes), int(sizes.sum()) // max(longest, 64) + 1))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (n + int(sizes[d]), k))
        held.sort(key=lambda ds: -int(sizes[ds].sum()))
        spans = [np.concatenate([np.arange(begins[d], begins[d] + sizes[d]) for d in ds]) for ds in held if ds]
        length = np.array([len(s) for s in spans])
        out = np.zeros(len(symbols))
        end = self.vocab.end_symbol
        h, last = np.zeros((len(spans), HIDDEN), np.float32), np.full(len(spans), end, symbols.dtype)
        window = max(WINDOW, 16_384 // len(spans))
        for start in range(0, int(length[0]), window):
            stop = min(start + window, int(length[0]))
            active = int((length > start).sum())
            grid = np.zeros((stop - start, active), np.int64)
            given = np.arange(start, stop)[:, None] < length[:active]  # not so behind a lane's end, after which it is not read again
            for k in range(active):
                part = spans[k][start:stop]
                grid[: len(part), k] = part
            y = symbols[grid]
            x = np.vstack([last[None, :active], y[:-1]])
            carries = (x != end).astype(np.float32)[:, :, None]  # where it is 0, a document begins
            g, states, h = self.gates(x), np.empty((*x.shape, HIDDEN), np.float32), h[:active]
            for t in range(len(x)):
                states[t] = h = self.advance(g[t], h * carries[t])[0]
            last = y[-1]
            out[grid[given]] = self.log10_output(states[given], y[given])
        return out

    def train(self, symbols: np.ndarray, memory: dict, rate: float) -> None:
        """One pass of truncated back-propagation over a stream of documents, cut into lanes; each update reads one window.

        Every token is a target once: all positions of a window enter its loss.
        """
        n, width, end = HIDDEN, max(1, min(LANES, len(symbols) // 64)), self.vocab.end_symbol
        steps = -(-len(symbols) // width)
        stream = np.append(symbols, np.full(steps * width - len(symbols), -1, symbols.dtype)).reshape(width, steps).T
        h, last = np.zeros((width, n), np.float32), np.full(width, end, np.int32)
        for start in range(0, steps, WINDOW):
            y = stream[start : start + WINDOW]
            x = np.vstack([last[None], y[:-1]])
            x = np.where(x < 0, end, x)
            carries = (x != end).astype(np.float32)[:, :, None]  # where it is 0, a document begins
            g, kept, tape = self.gates(x), [], []
            for t in range(len(y)):
                before = h * carries[t]
                h, *gates = self.advance(g[t], before)
                tape.append((before, *gates))
                kept.append(h)
            last = np.where(y[-1] < 0, end, y[-1]).astype(np.int32)
            every = np.concatenate(kept)
            flat = y.reshape(-1)
            given = np.flatnonzero(flat >= 0)  # all but the fill of the last lane
            grads, d_given = self._output_gradient(every[given], flat[given])
            d_all = np.zeros_like(every)
            d_all[given] = d_given
            d_all = d_all.reshape(len(y), width, n)
            d_gate, du, dh = np.zeros((len(y), width, 3 * n), np.float32), np.zeros_like(self.p["u"]), np.zeros((width, n), np.float32)
            for t in range(len(y) - 1, -1, -1):
                before, z, r, cand, un = tape[t]
                dh = dh + d_all[t]
                part = dh * (1 - z)
                d_cand = part * (1 - cand * cand)
                d = d_gate[t]
                np.multiply(part * z, before - cand, out=d[:, :n])
                np.multiply(d_cand * un, r * (1 - r), out=d[:, n : 2 * n])
                d[:, 2 * n :] = d_cand
                inner = d.copy()
                inner[:, 2 * n :] *= r
                du += before.T @ inner
                dh *= z
                dh += inner @ self.p["u"].T
                dh *= carries[t]
            flat_gate, flat_x = d_gate.reshape(-1, 3 * n), x.reshape(-1).astype(np.int16)
            order = np.argsort(flat_x, kind="stable")
            met = flat_x[order]
            first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
            uniq = met[first]
            grads |= {"u": du, "b": np.ones(len(flat_gate), np.float32) @ flat_gate}
            self._update("x", np.add.reduceat(flat_gate[order], first, axis=0), memory, rate, uniq)
            for k, g in grads.items():
                self._update(k, g, memory, rate)

    def _output_gradient(self, states: np.ndarray, symbols: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over the given positions."""
        scale = np.float32(1 / len(symbols))
        cls = self.targets(symbols)
        d = np.empty_like(states)
        grads = {k: np.zeros_like(self.p[k]) for k in ("wc", "bc", "ww", "bw")}
        for a in range(0, len(states), OUTPUT_ROWS):
            some = slice(a, a + OUTPUT_ROWS)
            d[some], wc, bc = _gradient_at(states[some], self.p["wc"].T, self.p["bc"], cls[some], scale)
            grads["wc"] += wc.T
            grads["bc"] += bc
        rows, classes = self._by_class(symbols, cls)
        held, own = states[rows], symbols[rows]
        inner = np.zeros_like(held)
        for part, words in classes:
            inner[part], grads["ww"][words], grads["bw"][words] = _gradient_at(held[part], self.p["ww"][words], self.p["bw"][words], own[part] - words.start, scale)
        d[rows] += inner
        return grads, d

    def _update(self, name: str, grad: np.ndarray, memory: dict, rate: float, rows: np.ndarray | None = None) -> None:
        """RMSprop-like steps with a slow decay; ``rows`` limits it to some rows."""
        seen = memory.setdefault(name, np.full_like(self.p[name], 1e-8))
        at = slice(None) if rows is None else rows
        seen[at] = 0.99 * seen[at] + 0.01 * grad * grad
        self.p[name][at] -= np.clip(rate * grad / (np.sqrt(seen[at]) + 1e-7), -10 * rate, 10 * rate)


def fit(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", start_documents: int = START_DOCUMENTS) -> Model:
    """A model trained on all texts of ``docs``: a common start, then copies per task, averaged by the tokens they read."""
    spark = docs.sparkSession
    n = docs.count()
    model = Model(vocab)
    names = sorted(model.p)
    sent = spark.sparkContext.broadcast(model)
    share = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1_000_000)) < F.lit(1_000_000 * start_documents / max(n, 1))

    def learn(shared, passes: int, rate: float):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, memory, read = shared.value, {}, 0
            own = own.copy()
            for frame in in_batches(frames, text_col, CHUNK_CHARS):
                symbols = own.vocab.look_up(token_keys(frame[text_col].tolist())[0])[0]
                for _ in range(passes):
                    own.train(symbols, memory, rate)
                read += len(symbols)
            if read:
                yield pd.DataFrame({"name": names, "tokens": read, "values": [own.p[k].astype(np.float64).ravel() * read for k in names]})

        return run

    def averaged(rows: DataFrame) -> None:
        """Sums over tasks as whole arrays, in two steps of about the square root of the tasks each; the driver reads one parameter set."""

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"name": frame["name"].iloc[:1], "tokens": [frame["tokens"].sum()], "values": [np.sum(np.stack(frame["values"]), axis=0)]})

        schema = "name string, tokens long, values array<double>"
        lanes = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
        some = rows.groupBy("name", F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")).applyInPandas(add, schema)
        got = some.groupBy("name").applyInPandas(add, schema).toPandas()
        for name, tokens, values in got.itertuples(index=False, name=None):
            model.p[name] = (np.asarray(values) / tokens).astype(np.float32).reshape(model.p[name].shape)

    schema = "name string, tokens long, values array<double>"
    texts = docs.select(id_col, text_col)
    start = texts.where(share).select(text_col).repartition(1).mapInPandas(learn(sent, 4, 0.01), schema)
    averaged(start)
    sent = spark.sparkContext.broadcast(model)
    averaged(texts.select(text_col).mapInPandas(learn(sent, 1, 0.003), schema))
    return model


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``learn`` tells the training rows. A null text counts as empty: one token, the end. base_score: sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))). score: the model's log10 probability of the whole text. Rows are scored one by
    one, so repeated rows give equal scores; without training rows both scores are of a uniform guess (c = N = V = 0) and
    an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    training = docs.where(learn).select(id_col, text_col)
    counts = stash(count_tokens(training, text_col), "counts")
    vocab = vocabulary(counts)
    model = fit(training, vocab, id_col, text_col) if vocab else None
    sent = spark.sparkContext.broadcast(model)
    total, distinct = (vocab.total, vocab.distinct) if vocab else (0, 0)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        base_norm = np.log10(total + 0.1 * (distinct + 1))
        for frame in in_batches(frames, "text", 2 * CHUNK_CHARS):
            keys, sizes = token_keys(frame["text"].tolist())
            begins = np.cumsum(sizes) - sizes
            if model is None:
                out = frame[["id"]].assign(n_tokens=sizes, known=0, counted=-1.0 * sizes, base=-base_norm * sizes, model=-base_norm * sizes, rare=[np.zeros(0, np.int64)] * len(frame))
                yield out
                continue
            symbols, c = model.vocab.look_up(keys)
            gained = model.log10_tokens(symbols, sizes)
            rest = symbols >= FREQUENT
            gained[rest] -= model.vocab.rest_log10[symbols[rest] - FREQUENT]
            # log10(c + 0.1) enters the base for all tokens and the model for those without an output of their own
            logs = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1), 0.0)
            rare = c < 0
            cuts = np.append(0, np.cumsum(np.add.reduceat(rare.astype(np.int64), begins)))
            found = keys[rare]
            out = frame[["id"]].copy()
            out["n_tokens"] = sizes
            out["known"] = np.add.reduceat((c > 0).astype(np.int64), begins)
            out["base"] = np.add.reduceat(logs, begins) - base_norm * sizes
            out["model"] = np.add.reduceat(gained + np.where(rest, logs, 0.0), begins)
            out["counted"] = 0.0
            out["rare"] = [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(run, f"id {kind}, n_tokens long, known long, counted double, base double, model double, rare array<long>")
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # the others' counts by key: a key absent there was never met in training
    rare = scored.select("row", F.explode("rare").alias("key")).join(counts, "key", "left").groupBy("row")
    rare = rare.agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("logs"), F.count("c").alias("met"))
    logs = F.coalesce("logs", F.lit(0.0)) + F.col("counted")
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


@register("op1_gated_lm")
def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 10) == 0
    out = score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
