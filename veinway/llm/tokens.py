"""Whole texts to token ids with a byte-level `tokenizers` file, fast enough for large corpora.

Byte-level pre-tokenisation always cuts where white space follows another character, and between a
letter or digit and most ASCII punctuation. Texts are cut there, each piece is encoded once by the
library and remembered, and a text's ids are the joined pieces: the same ids as for the whole text.
"""

import re
from collections.abc import Callable
from itertools import pairwise

import numpy as np

from veinway.llm.common import kept

#: Unicode's White_Space characters, as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space with the word after it, up to the punctuation that ends its letters and digits; the rest; white space at the end.
PIECES = re.compile(f"[{WHITE}]*[^\\W_]++(?:(?=[!-&(-/:-@[-`{{-~])|[^{WHITE}]*)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
IS_WHITE = re.compile(f"[{WHITE}]").fullmatch


class Pieces:
    """Remembers what `make` gives for each piece, in two generations of `remember_mb` / 2 at most.

    When the younger generation is full it becomes the older one, whose pieces move back when they
    are met again; the rest goes. An entry counts about 200 bytes besides its text and ids.
    """

    def __init__(self, make: Callable[[list[str]], dict[str, bytes]], remember_mb: int, longest: int):
        self.make, self.most, self.longest = make, remember_mb * 500_000, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.used = 0

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """For each text, given as pieces, what its pieces give, joined."""
        every = set().union(*texts)
        if self.used > self.most:
            self.known, self.older, self.used = {}, self.known, 0
        known, older = self.known, self.older
        new = [x for x in every if x not in known]
        if new:
            found = {x: older[x] for x in new if x in older}
            found.update(self.make([x for x in new if x not in found]))
            known.update(found)
            self.used += sum(200 + len(x) + len(ids) for x, ids in found.items())
        out = [b"".join(map(known.__getitem__, p)) for p in texts]
        for x in new:
            if len(x) > self.longest:
                self.used -= 200 + len(x) + len(known.pop(x))
        return out


class PieceEncoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit bytes.

    Special tokens that a text holds are found as the library finds them by default: a text is cut
    at them first, and what stands between them is encoded alone.
    """

    def __init__(self, path: str, remember_mb: int = 240, longest: int = 48):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character for each byte
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special, self.at_special = special, re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.pieces = Pieces(self._ids, remember_mb, longest)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.fromiter(x.ids, "<u4", len(x.ids)) for x in found]

    def _ids(self, pieces: list[str], together: int = 200) -> dict[str, bytes]:
        """The ids of each piece. Those that begin and do not end with white space are encoded joined, and cut by their bytes."""
        free, alone = [], []
        for x in pieces:
            (free if IS_WHITE(x[0]) and not IS_WHITE(x[-1]) else alone).append(x)
        out = {x: ids.tobytes() for x, ids in zip(alone, self._each(alone), strict=True)}
        for at in range(0, len(free), 4_000):
            part = free[at : at + 4_000]
            flat = np.concatenate(self._each(["".join(part[i : i + together]) for i in range(0, len(part), together)]))
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in part), np.int64, len(part)))
            cuts = [0, *(4 * np.searchsorted(np.cumsum(self.n_bytes[flat]), ends) + 4).tolist()]
            ids = flat.tobytes()
            out.update(zip(part, [ids[a:b] for a, b in pairwise(cuts)], strict=True))
        return out

    def _cut(self, text: str) -> list[str]:
        if not any(x in text for x in self.special):
            return PIECES.findall(text)
        parts = self.at_special.split(text)  # every second one is a special token
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else PIECES.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.pieces.joined([self._cut(t) for t in texts])


def encoder(path: str, remember_mb: int = 240) -> PieceEncoder:
    """One a Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("pieces", path, remember_mb), lambda: PieceEncoder(path, remember_mb))
