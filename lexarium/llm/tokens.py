"""Tokenising with a public byte-level BPE vocabulary.

The vocabulary is read from the JSON file of the ``tokenizers`` library.  Ids
are found by ``tiktoken`` over the same merges, several times faster; a text it
can't take (regular-expression limits on extreme runs) goes through
``tokenizers`` itself.  Both give the same ids (tests compare them).  A text that
spells out a special token such as ``<|endoftext|>`` can be read in two ways, see
``Tokens.ids`` and ``Tokens.marked_ids``.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The published pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Encoder made from the text of a tokenizer's JSON file."""

    _made: dict[int, "Tokens"] = {}

    def __init__(self, source: str):
        import tiktoken

        self.source, self._slow = source, None
        spec = json.loads(source)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.parts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        back = _byte_of()
        ranks = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        self.fast = tiktoken.Encoding("lexarium", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, source: str) -> "Tokens":
        """One encoder a process for each source."""
        key = hash(source)
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(source)
        return cls._made[key]

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.source)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    @property
    def greatest(self) -> int:
        """The greatest id that ordinary text can encode to."""
        return max(self.fast._mergeable_ranks.values())

    def marked_ids(self, text: str) -> np.ndarray:
        """Ids as ``tokenizers`` gives them by itself: special tokens that a text spells out become their own ids."""
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [self.ids(text[at : m.start()]), np.array([self.special[m[0]]], "<u4")]
            at = m.end()
        return np.concatenate([*out, self.ids(text[at:])]) if out else self.ids(text)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text in which nothing is special."""
        try:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        except BaseException as e:  # the library's own panics derive from BaseException
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.slow(text), "<u4")


def source_of(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()
