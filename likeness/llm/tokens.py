"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks.

A text is cut where the tokenizer's own first step always cuts; each new chunk is encoded once by
the library, a seen one is looked up. The ids are those of encoding the whole text: texts that
hold a special token or white space outside ASCII go to the library as a whole.
"""

from __future__ import annotations

import re

_WS, _L, _P = r" \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?*%$&#|()"
_WORD = rf"[{_L}]+(?=[{_P}]*(?:[{_WS}]|\Z))"
#: How texts of a vocabulary file may be cut: plain words apart from the signs after them, else up to white space;
#: with the one space before them, or bare.
BYTE_LEVEL = re.compile(rf" ?{_WORD}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
BARE_WORDS = re.compile(rf"{_WORD}|[^{_WS}]+")
#: Letters whose lower case may depend on the library.
FOREIGN = re.compile("[\u0130\u0250-\U0010ffff]")
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")


class ChunkEncoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids as bytes, one value per text.

    ``limit`` bounds the remembered chunks; longer chunks than ``longest`` are not remembered.
    ``folds``: the vocabulary knows lower case only, so texts may be looked up in lower case.
    """

    def __init__(self, path: str, cut: re.Pattern, limit: int = 800_000, longest: int = 64, folds: bool = False):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.cut, self.limit, self.longest, self.folds = cut, limit, longest, folds
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.known: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        from array import array  # "I" is 4 bytes on all platforms of the library

        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if ODD.search(t) or self.special and self.special.search(t)]
        apart = dict(zip(whole, self._direct([texts[i] for i in whole])))
        if self.folds:
            texts = [t if FOREIGN.search(t) else t.lower() for t in texts]
        chunks = [self.cut.findall(t) if i not in apart else [] for i, t in enumerate(texts)]
        if len(self.known) > self.limit:
            self.known = {}
        new = list(set().union(*chunks).difference(self.known))
        found = dict(zip(new, self._direct(new))) if new else {}
        self.known.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        long = {k: v for k, v in found.items() if len(k) > self.longest}
        get = self.known.__getitem__ if not long else lambda c: long[c] if c in long else self.known[c]
        return [apart[i] if i in apart else b"".join(map(get, c)) for i, c in enumerate(chunks)]
