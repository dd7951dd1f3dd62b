"""SentencePiece encoding and decoding of whole texts.

Words (a run of spaces and what follows) are encoded through the prefix table of ``Pieces.encode_word``; each worker
keeps the ids of words it has met. A text's ids are those of its words in turn, then the end id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wattline.llm.common import in_batches
from wattline.llm.pieces import SPACE, Pieces, pieces
from wattline.llm.registry import register, table

MODEL = "piece_bpe_32k.model"
#: Words that a worker keeps at once: a half of them since the last change, the other half before it; the older half goes first. Bounds memory, not results.
KEPT_WORDS = 250_000
_WORD = re.compile(" +[^ ]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Word -> its ids as decimals joined by spaces. ``odd`` has the words that do not decode to themselves."""

    def __init__(self, model: Pieces):
        self.model, self.odd, self.before = model, {}, {}

    def __missing__(self, word: str) -> str:
        out = self.before.get(word)
        if out is None:
            ids = self.model.encode_word(word.replace(" ", SPACE))
            back = self.model.decode(ids)
            if back != word:
                self.odd[word] = back
            out = " ".join(map(str, ids))
        self[word] = out
        return out

    def make_room(self, kept: int) -> None:
        if len(self.odd) > kept // 2:
            self.odd, self.before = {}, {}
            self.clear()
        elif len(self) > kept // 2:
            self.before = dict(self)
            self.clear()


_words: dict[str, _Words] = {}


def encode_text(text: str | None, known: _Words, kept_words: int = KEPT_WORDS) -> tuple[str, str]:
    """The ids (decimals joined by a space, the end id last) and the decoded text; a null text counts as empty."""
    if not text:
        return str(known.model.eos), ""
    found = _WORD.findall(" " + text.replace(SPACE, " "))
    known.make_room(kept_words)
    ids = " ".join([*map(known.__getitem__, found), str(known.model.eos)])
    back = "".join([known.odd.get(w, w) for w in found]) if known.odd else "".join(found)
    return ids, back[1:]


def known_words(path: str) -> _Words:
    if path not in _words:
        _words[path] = _Words(pieces(path))
    return _words[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str | None = "ids", decoded_col: str | None = None, digests: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """``docs`` with the ids of each whole text (array<int>, end id last), its decoded text, or digests of both.

    Adds ``n_tokens``; ``ids_col`` and ``decoded_col`` where named; with ``digests`` also ``ids_sha256`` and
    ``decoded_sha256``. Columns of these names are replaced; all others stay. A null text counts as empty: the end id
    alone. Rows are taken one by one, so repeated rows and an empty table need no rule.
    """
    made = {"n_tokens": "long"} | ({ids_col: "array<int>"} if ids_col else {}) | ({decoded_col: "string"} if decoded_col else {})
    made |= {"ids_sha256": "string", "decoded_sha256": "string"} if digests else {}
    kept = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"`{c}` {t}" for c, t in made.items())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = known_words(path)
        for frame in in_batches(frames, text_col, 1_000_000):
            rows = [encode_text(t, known, kept_words) for t in frame[text_col]]
            out = frame[kept].copy()
            out["n_tokens"] = [i.count(" ") + 1 for i, _ in rows]
            if ids_col:
                out[ids_col] = [np.fromstring(i, np.int32, sep=" ") for i, _ in rows]
            if decoded_col:
                out[decoded_col] = [t for _, t in rows]
            if digests:
                out["ids_sha256"] = [hashlib.sha256(i.encode()).hexdigest() for i, _ in rows]
                out["decoded_sha256"] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, t in rows]
            yield out

    return docs.mapInPandas(run, schema)


@register("op7_sentencepiece_codec")
def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, model_path(), ids_col=None, digests=True).drop("text")
