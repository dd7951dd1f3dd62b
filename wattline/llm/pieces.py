"""The pieces of a SentencePiece BPE model: merge rules, pair compatibility and a match automaton.

Shared by the encoder (``encoding``) and the token counter (``counting``). Only the vocabulary is read from the model
file; pieces are applied here. Models must leave texts as they are but for spaces (no normaliser), fall back to bytes,
and hold no piece with a space mark after another character, so that words part before a space mark.
"""

from __future__ import annotations

from functools import lru_cache

SPACE = "▁"
#: In place of a previous token: nothing before, or something no piece joins with.
FREE = -1


class Pieces:
    """Merge scores, reachable pieces, byte ids and the automaton of one model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = sp.eos_id()
        self.byte_ids = {}
        self.text_of: dict[int, str] = {}
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text_of[i] = sp.id_to_piece(i)
        if len(self.byte_ids) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.text_of.values()) or sp.encode("① a  b", out_type=str)[0] != SPACE:
            raise ValueError("this needs a BPE model with byte fallback, no normaliser and no space mark inside a piece")
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.id_of = {p: i for i, p in self.text_of.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self._pairs: dict[int, bool] = {}
        self._automaton([p for p in self.id_of if self.merge(p) == [p]])

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: join the best-scored adjacent pair, leftmost first, while there is one."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: BPE of their joined text gives these two again."""
        if left == FREE:
            return True
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(a + b) == [a, b]
        return known

    def _automaton(self, reachable: list[str]) -> None:
        """Trie of the reachable pieces with suffix links; ``matches`` of a node: (token, length), longest first."""
        self.goto, self.depth, own = [{}], [0], [None]
        for p in reachable:
            q = 0
            for c in p:
                nxt = self.goto[q].get(c)
                if nxt is None:
                    nxt = self.goto[q][c] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[q] + 1)
                    own.append(None)
                q = nxt
            own[q] = self.id_of[p]
        self.children = [dict(x) for x in self.goto]
        self.fail, self.matches = [0] * len(own), [()] * len(own)
        queue = list(self.children[0].values())
        for q in queue:
            if own[q] is not None:
                self.matches[q] = ((own[q], self.depth[q]), *self.matches[self.fail[q]])
            else:
                self.matches[q] = self.matches[self.fail[q]]
            for c, r in self.children[q].items():
                self.fail[r] = self.step(self.fail[q], c)
                queue.append(r)

    def step(self, q: int, c: str) -> int:
        """The automaton's next node; learned moves are kept."""
        nxt = self.goto[q].get(c)
        if nxt is None:
            nxt = 0 if q == 0 else self.step(self.fail[q], c)
            self.goto[q][c] = nxt
        return nxt

    def known_char(self, c: str) -> bool:
        return c in self.children[0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (space marks, then other characters).

        The prefix table holds each prefix's unique last token: among the automaton's matches that end there, the one
        that is compatible with the last token of the prefix before it. Ids are then read off backwards.
        """
        goto, matches, pairs, heads = self.goto, self.matches, self._pairs, self.children[0]
        last, lengths, q = [FREE], [0], 0
        for i, c in enumerate(word, 1):
            if c not in heads:
                last.append(FREE)
                lengths.append(1)
                q = 0
                continue
            nxt = goto[q].get(c)
            q = self.step(q, c) if nxt is None else nxt
            for token, length in matches[q]:
                before = last[i - length]
                fits = before == FREE or pairs.get(before << 20 | token)
                if fits or (fits is None and self.compatible(before, token)):
                    last.append(token)
                    lengths.append(length)
                    break
            else:
                raise AssertionError(f"no last token for a prefix of {word!r}")
        ids, i = [], len(word)
        while i:
            token = last[i]
            if token == FREE:
                ids.extend(self.byte_ids[b] for b in reversed(word[i - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(token)
            i -= lengths[i]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte tokens read as UTF-8, space marks as spaces; control ids say nothing."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of.get(i, ""))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per Python worker and model."""
    return Pieces(path)
