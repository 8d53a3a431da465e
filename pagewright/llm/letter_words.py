"""Ids of many words of Latin letters at once, for byte-level BPE with word-end marks.

The merges become a rank table of byte strings, a word's end mark being one more
byte that joins the last letter before all else.  A table of ranks merges any two
neighbours whose bytes together are a token, the merge list only the pairs that it
names.  The two differ nowhere if each token's own bytes, merged by the list, give
that token: wherever two neighbours make up a token's bytes, what was merged inside
those bytes so far is what would have been merged in the token alone.
``LetterWords.of`` checks this for the whole list and declines a tokenizer that fails.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

_MARK, _END = "</w>", b"\x00"
#: Letters whose lower case is one letter and that normalisation leaves as they are.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
_WORD = re.compile(f"[{LETTERS}]+").fullmatch


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, others from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges by the list: always the pair named first, the leftmost of equals."""
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), len(ranks)))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class LetterWords:
    """Encodes words of ``LETTERS``; see ``of``."""

    def __init__(self, table: dict[bytes, int], ids: dict[int, int]):
        self.coder = tiktoken.Encoding("letters", pat_str=r"[^\x00]+\x00", mergeable_ranks=table, special_tokens={})
        self.ids = np.zeros(max(table.values()) + 1, dtype=np.int64)
        self.ends = np.zeros(len(self.ids), dtype=bool)
        for rank, i in ids.items():
            self.ids[rank] = i
        for token, rank in table.items():
            self.ends[rank] = token.endswith(_END)

    @classmethod
    def of(cls, tokenizer, checked: bool = False) -> LetterWords | None:
        """For a ``tokenizers`` tokenizer, or None where the table can't be relied on; ``checked``: it is known that it can."""
        model = json.loads(tokenizer.to_str())["model"]
        if model.get("end_of_word_suffix") != _MARK or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            return None
        letter, vocabulary = _byte_letters(), model["vocab"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        ranks = {pair: i for i, pair in enumerate(merges)}
        spelt = lambda t: bytes(letter[c] for c in t.removesuffix(_MARK)) + (_END if t.endswith(_MARK) else b"")
        atoms = [c + _MARK for c in letter]
        if not all(t in vocabulary for t in [*atoms, *letter, *("".join(p) for p in merges)]):
            return None
        table, ids = {}, {}
        for rank, token in enumerate([*atoms, *("".join(p) for p in merges), *letter]):
            held = table.setdefault(spelt(token), rank)
            if held != rank:
                if token in letter:
                    continue  # a single zero byte is the end mark too
                return None
            ids[rank] = vocabulary[token]
        table.setdefault(_END, len(atoms) + len(merges) + len(letter))
        for pair in [] if checked else merges:
            token = "".join(pair)
            body = token.removesuffix(_MARK)
            if len(_merged([*body[:-1], body[-1] + token[len(body) :]], ranks)) > 1:
                return None
        return cls(table, ids)

    @staticmethod
    def takes(word: str) -> bool:
        """Whether all of a word are letters, in lower case."""
        return _WORD(word) is not None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word ends in them."""
        ranks = self.coder.encode_to_numpy("".join(f"{w}\0" for w in words), disallowed_special=()).astype(np.int64)
        return self.ids[ranks], np.flatnonzero(self.ends[ranks]) + 1
