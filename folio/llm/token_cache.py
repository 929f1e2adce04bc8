"""Token ids of whole texts, with one encoding per distinct chunk.

The public word tokenizer never joins characters across white space, so a
text's ids are the ids of its white-space chunks laid end to end.  Chunks repeat
a lot; each worker encodes a chunk once and keeps its ids in two generations of
a cache, so that common chunks stay and memory is bounded.  A chunk of plain
letters with punctuation behind it is two tokens' worth of work: the letters go
straight to the merge model, the punctuation is looked up.  Any other chunk goes
through the whole tokenizer.
"""

from __future__ import annotations

import functools
import os
import string

import numpy as np

from ._common import CACHES

#: Characters on which ``str.split`` and the tokenizer's white space may differ; such texts are encoded whole.
UNSURE = frozenset("\x1c\x1d\x1e\x1f\x85᠎​﻿")
#: Letters up to here have one code point each when composed and in lower case.
LAST_PLAIN = "ɏ"
#: Each run of these behind letters is one pre-token; none of them composes with a letter before it.
PUNCTUATION = string.punctuation
MOST_CHUNKS = 250_000


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Generations(dict):
    """A dict that makes missing values and forgets those not used for a generation."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.tails = Generations(self._whole, 10_000)
        self.chunks = Generations(self._chunk, MOST_CHUNKS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _chunk(self, chunk: str) -> bytes:
        lower = chunk.lower()
        core = lower.rstrip(PUNCTUATION)
        if core.isalpha() and (core.isascii() or max(core) <= LAST_PLAIN):
            tail = lower[len(core) :]
            return self._core(core) + self.tails[tail] if tail else self._core(core)
        return self._whole(chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not any(map(text.__contains__, UNSURE)):
                out.append(b"".join(map(self.chunks.__getitem__, text.split())))
            else:
                out.append(self._whole(text))
            for cache in (self.chunks, self.tails):
                cache.turn()
        return out


encoder = functools.lru_cache(2)(Encoder)
CACHES.append(encoder.cache_clear)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without special tokens added."""
    return encoder(path).encode(texts)
