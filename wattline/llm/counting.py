"""Token counts by a finite-state transducer compiled from the tokenizer.

A state is what the rest of a text can depend on: the automaton's node for the text read so far and, for every suffix of
it that a piece may still grow from, the last token before that suffix and how many tokens fewer had been emitted there.
Reading a character leads to one state and emits a count (below zero where earlier tokens merge). States and transitions
are compiled when first met and kept in tables per worker, so that texts run through array look-ups alone.

Texts are cut into chunks anywhere. A chunk's map (start state -> end state, count) is computed for the start state that
a short look back suggests, and again for the right one where that guess fails; the maps of a text are then composed by
a parallel prefix scan over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wattline.llm.common import in_batches
from wattline.llm.encoding import model_path
from wattline.llm.pieces import FREE, SPACE, Pieces, pieces
from wattline.llm.registry import register, table

CHUNK = 256
LOOK_BACK = 40
#: States that a worker keeps at once; it starts afresh beyond. Bounds memory, not results.
MOST_STATES = 200_000
_SPACE_CLASS = 4


class Transducer:
    """Compiled on demand. Classes 0 to 3: characters outside the vocabulary by their UTF-8 length; others one each."""

    def __init__(self, model: Pieces):
        self.model = model
        self.class_of = np.full(0x110000, -1, np.int16)
        self.chars: list[str | None] = [None] * 4 + [SPACE]
        self.class_of[[ord(" "), ord(SPACE)]] = _SPACE_CLASS
        self._chains: dict[int, list[int]] = {}
        self.spaces, q = set(), model.children[0].get(SPACE)  # nodes that spell space marks alone
        while q is not None:
            self.spaces.add(q)
            q = model.children[q].get(SPACE)
        self.forget()

    def forget(self) -> None:
        self.width = 128
        while self.width < len(self.chars):
            self.width *= 2
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int16)
        self.start = self.intern((0, ((FREE, 0),)))

    def intern(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return found

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The class of each code point; characters met for the first time get one."""
        out = self.class_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                c = chr(code)
                if not self.model.known_char(c):
                    self.class_of[code] = len(c.encode("utf-8", "surrogatepass")) - 1
                    continue
                if len(self.chars) >= self.width:
                    self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                    self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])
                    self.width *= 2
                self.class_of[code] = len(self.chars)
                self.chars.append(c)
            out = self.class_of[codes]
        return out

    def _chain(self, q: int) -> list[int]:
        """Depths of a node and of its suffixes, smallest first."""
        found = self._chains.get(q)
        if found is None:
            d, r = [], q
            while r:
                d.append(self.model.depth[r])
                r = self.model.fail[r]
            found = self._chains[q] = [0, *reversed(d)]
        return found

    def compile(self, state: int, cls: int) -> None:
        """Fill one cell of the tables."""
        m = self.model
        q, held = self.keys[state]
        if cls < 4:
            self.next[state, cls], self.emit[state, cls] = self.start, cls + 1
            return
        c = self.chars[cls]
        before = dict(zip(self._chain(q), held, strict=True))
        if c == SPACE and q not in self.spaces:
            # no piece joins a space mark to what is before it, so what came before is of no more account
            before, q = {0: (FREE, 0)}, 0
        r = m.step(q, c)
        for token, length in m.matches[r]:
            last, fewer = before[length - 1]
            if m.compatible(last, token):
                emitted = fewer + 1
                break
        else:
            raise AssertionError("no last token for a prefix")
        after = [(token, 0)] + [(before[d - 1][0], before[d - 1][1] - emitted) for d in self._chain(r)[1:]]
        target = self.intern((r, tuple(after)))
        self.next[state, cls], self.emit[state, cls] = target, emitted

    def run(self, state: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of many chunks at once; ``classes[t, lane]``, lanes with the longest chunks first."""
        state, count = state.copy(), np.zeros(len(state), np.int64)
        active = np.searchsorted(-lengths, -np.arange(len(classes)), side="left")
        for t in range(len(classes)):
            n = active[t]
            if not n:
                break
            cls, at = classes[t, :n], state[:n]
            flat = at.astype(np.int64) * self.width + cls
            target = self.next.ravel()[flat]
            if target.min() < 0:
                missing = np.flatnonzero(target < 0)
                for s, k in set(zip(at[missing].tolist(), cls[missing].tolist(), strict=True)):
                    self.compile(s, k)
                target = self.next.ravel()[flat]
            count[:n] += self.emit.ravel()[flat]
            state[:n] = target
        return state, count

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, without begin or end tokens."""
        if len(self.keys) > MOST_STATES:
            self.forget()
        encoded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(e) + 1 if len(e) else 0 for e in encoded], np.int64)  # with the space mark put before a text
        total = int(sizes.sum())
        out = np.zeros(len(texts), np.int64)
        if not total:
            return out
        space = np.array([ord(" ")], np.uint32)
        cls = self.classes(np.concatenate([x for e in encoded if len(e) for x in (space, e)]))
        begins = np.cumsum(sizes) - sizes
        pieces_of = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), pieces_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        at = begins[owner] + nth * CHUNK
        length = np.minimum(CHUNK, begins[owner] + sizes[owner] - at)
        # the state that a look back over the characters before a chunk suggests
        look = np.where(nth > 0, LOOK_BACK, 0)
        start = self._lanes(cls, np.full(len(owner), self.start, np.int32), at - look, look)[0]
        end, count = self._lanes(cls, start, at, length)
        follows = nth > 0
        while True:
            wrong = np.flatnonzero(follows[1:] & (start[1:] != end[:-1])) + 1
            if not wrong.size:
                break
            start[wrong] = end[wrong - 1]
            end[wrong], count[wrong] = self._lanes(cls, start[wrong], at[wrong], length[wrong])
        _, _, through = compose(owner, start, end, count)
        final = np.cumsum(pieces_of)[sizes > 0] - 1
        out[sizes > 0] = through[final]
        return out

    def _lanes(self, cls: np.ndarray, start: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-length, kind="stable")
        longest = int(length.max(initial=0))
        if not longest:
            return start.copy(), np.zeros(len(start), np.int64)
        grid = np.minimum(at[order] + np.arange(longest)[:, None], len(cls) - 1)
        state, count = self.run(start[order], cls[grid], length[order])
        back_s, back_c = np.empty_like(state), np.empty_like(count)
        back_s[order], back_c[order] = state, count
        return back_s, back_c


def compose(owner: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inclusive prefix scan of chunk maps: for each chunk, the map of its text from the first chunk through this one.

    A map takes ``start`` to ``end`` and emits ``count``; two maps compose where the first ends as the second starts.
    Spans double in each of log2(chunks) steps.
    """
    start, end, count = start.copy(), end.copy(), count.copy()
    first = np.searchsorted(owner, owner, side="left")
    reach = np.arange(len(owner))  # first chunk that the map at a place covers so far
    while (open_ := np.flatnonzero(reach > first)).size:
        left = reach[open_] - 1
        if (end[left] != start[open_]).any():
            raise AssertionError("chunk maps do not compose")
        count_new, start_new, reach_new = count[open_] + count[left], start[left], reach[left]
        count[open_], start[open_], reach[open_] = count_new, start_new, reach_new
    return start, end, count


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(pieces(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of each whole text.

    Columns of these names are replaced; all others stay. A null text counts as empty: 0 bytes, 0 tokens. Rows are taken
    one by one, so repeated rows and an empty table need no rule.
    """
    made = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{c} {t}" for c, t in made.items())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for frame in in_batches(frames, text_col, 1_000_000):
            texts = [t or "" for t in frame[text_col]]
            out = frame[kept].copy()
            out["n_bytes"] = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            out["n_tokens"] = machine.counts(texts)
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    return docs.mapInPandas(run, schema)


@register("op3_transducer_counts")
def op3_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, model_path()).drop("text")
