"""Byte-level BPE as a finite-state transducer, and streaming decoding.

The encoder reads a pre-token byte by byte. For every prefix the last token of its encoding is the
one token that ends there and forms a valid pair with the last token before it. A state is the
last token emitted and the bytes read since; tokens are emitted once all tokens that could still
end later have the same beginning. States and arrows are made when first needed (lazy
determinisation) and kept up to a bound, so common words run along known arrows.
"""

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import kept
from veinway.llm.tokens import PIECES, Pieces


BYTES = [bytes((i,)) for i in range(256)]


class State:
    """context: the token emitted last, or -1; node: the longest suffix of the bytes read that begins a token;
    lasts: of every position from the context on, the last token of the encoding that ends there."""

    __slots__ = ("arrows", "context", "end", "lasts", "node", "pending")

    def __init__(self, context: int, pending: bytes, node: int, lasts: tuple[int, ...]):
        self.context, self.pending, self.node, self.lasts = context, pending, node, lasts
        self.arrows: dict[int, tuple[tuple[int, ...], State]] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    """Tokens are a trie whose nodes know their longest proper suffix in it, so that the positions
    where a token may still begin are a node and its suffixes, and the tokens that end at a byte too."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 350_000):
        self.ranks, self.most_states = ranks, most_states
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for i, b in self.token.items()}
        self.children: list[dict[int, int]] = [{}]  # by node, byte -> node
        self.ends, self.depth, self.parent, self.byte = [-1], [0], [0], [0]  # ends: the token that a node is
        for b, i in ranks.items():
            node = 0
            for byte in b:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.parent.append(node)
                    self.byte.append(byte)
                    self.children.append({})
                node = after
            self.ends[node] = i
        self.suffix: list[int] = [-1] * len(self.ends)
        self.found: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
        self.spines: dict[int, tuple[list[tuple[bytes, int, float]], list[tuple[bytes, int, float]]]] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = State(-1, b"", 0, (-1,))

    def suffix_of(self, node: int) -> int:
        """The node of the longest proper suffix that begins a token."""
        if self.suffix[node] < 0:
            above = self.parent[node]
            self.suffix[node] = 0 if not above else self.step(self.suffix_of(above), self.byte[node])
        return self.suffix[node]

    def step(self, node: int, byte: int) -> int:
        children = self.children
        while True:
            after = children[node].get(byte)
            if after is not None:
                return after
            if not node:
                return 0
            node = self.suffix_of(node)

    def endings(self, node: int) -> tuple[list[tuple[int, int]], list[int]]:
        """(tokens that end at a node with their sizes, the longest first; how far back tokens may still begin, the farthest first)."""
        found = self.found.get(node)
        if found is None:
            tokens, back, at = [], [], node
            while at:
                if self.ends[at] >= 0:
                    tokens.append((self.ends[at], self.depth[at]))
                back.append(self.depth[at])
                at = self.suffix_of(at)
            found = self.found[node] = (tokens, back)
        return found

    def merges(self, piece: bytes) -> list[tuple[bytes, bytes]]:
        """The merges that byte-pair encoding makes in a token, lowest rank and leftmost first."""
        parts, made = [piece[i : i + 1] for i in range(len(piece))], []
        while len(parts) > 1:
            rank, best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            made.append((parts[best], parts[best + 1]))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return made if len(parts) == 1 else [(b"", b"")]

    def edges_of(self, token: int) -> tuple[list, list]:
        """What stands at the token's left and right end while it is merged: (part, rank, rank of what it goes into)."""
        if token not in self.spines:
            piece = self.token[token]
            made = self.merges(piece)
            out = []
            for side in (0, 1):
                part, spine = piece, []
                above = float("inf")
                while True:
                    rank = -1 if len(part) == 1 else self.ranks[part]
                    spine.append((part, rank, above))
                    split = next((m for m in made if m[0] + m[1] == part), None) if len(part) > 1 else None
                    if split is None:
                        break
                    part, above = split[side], rank
                out.append(spine)
            self.spines[token] = (out[0], out[1]) if made != [(b"", b"")] else ([], [])
        return self.spines[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether the two tokens stand next to each other in some encoding; before -1 the token stands alone.

        They do unless a part at the right end of the first and one at the left end of the second
        are there at the same time and their merge comes before either goes into a larger part.
        """
        key = (before + 1) << 24 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            left = self.edges_of(token)[0]
            found = bool(left)
            if found and before >= 0:
                ranks = self.ranks
                for a, rank_a, above_a in self.edges_of(before)[1]:
                    for b, rank_b, above_b in left:
                        rank = ranks.get(a + b)
                        if rank is not None and max(rank, rank_a) < above_a and max(rank, rank_b) <= above_b and rank_a < above_b and rank_b < above_a:
                            found = False
            self.pairs[key] = found
        return found

    def arrow(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """What is emitted on reading a byte, and the state after it."""
        lasts, size = state.lasts, self.size
        node, n = self.children[state.node].get(byte), len(lasts)
        if node is None:
            node = self.step(state.node, byte)
        tokens, back = self.found.get(node) or self.endings(node)
        for token, many in tokens:
            if many == 1:  # exactly one token ends here, and all longer ones do not
                break
            ok = self.pairs.get((lasts[n - many] + 1) << 24 | token)
            if ok or ok is None and self.follows(lasts[n - many], token):
                break
        lasts = (*lasts, token)
        # all ways to places where a token may begin have in common what leads to the last place that they all pass
        common = n
        for many in back:
            at = n - many
            while common != at:
                if common > at:
                    common -= size[lasts[common]]
                else:
                    at -= size[lasts[at]]
            if not common:
                break
        out, context, pending = (), state.context, state.pending + BYTES[byte]
        if common:
            out, context, pending = self._path(lasts, common), lasts[common], pending[common:]
            lasts = lasts[common:]
        after = self.states.get((context, pending))
        if after is None:
            after = self.states[context, pending] = State(context, pending, node, lasts)
        return out, after

    def _path(self, lasts: tuple[int, ...], at: int) -> tuple[int, ...]:
        """The tokens from the context to a position."""
        out = []
        while at:
            out.append(lasts[at])
            at -= self.size[lasts[at]]
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(self.states) > self.most_states:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            arrow = state.arrows.get(byte)
            if arrow is None:
                arrow = state.arrows[byte] = self.arrow(state, byte)
            if arrow[0]:
                out += arrow[0]
            state = arrow[1]
        if state.end is None:
            state.end = self._path(state.lasts, len(state.lasts) - 1)
        out += state.end
        return out


class ByteBpe:
    """Whole texts to ids and back. Pieces that were met are remembered, up to about `remember_mb`."""

    def __init__(self, path: str, pattern: str, remember_mb: int = 200, longest: int = 48):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.bytes_of = [self.transducer.token[i] for i in range(max(ranks.values()) + 1)]
        self.pieces = Pieces(self._new, remember_mb, longest)

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        encode, matches = self.transducer.encode, self.pattern.findall
        return {x: array("I", [i for m in matches(x) for i in encode(m.encode("utf-8"))]).tobytes() for x in pieces}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes.

        Texts are cut where white space follows another character and between letters or digits and
        punctuation: every match of the pattern ends there.
        """
        return self.pieces.joined([PIECES.findall(t) for t in texts])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode_stream(self, ids: Iterable[int], errors: str = "replace", together: int = 1) -> Iterator[str]:
        """Text as the ids come in, `together` at a time; a character split over tokens waits for its last byte.

        The machine's state is the bytes of a character that is not complete. Bytes that are no
        UTF-8 become U+FFFD, or what else `errors` says.
        """
        machine, bytes_of = codecs.getincrementaldecoder("utf-8")(errors), self.bytes_of.__getitem__
        for some in batched(ids, together):
            if text := machine.decode(b"".join(map(bytes_of, some))):
                yield text
        if text := machine.decode(b"", True):
            yield text

    def decode_bytes(self, ids: Iterable[int], together: int = 4096) -> Iterator[bytes]:
        """The decoded bytes, through the same machine; bytes that are no UTF-8 come out as they were."""
        for text in self.decode_stream(ids, "surrogateescape", together):
            yield text.encode("utf-8", "surrogateescape")


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One a Python worker."""
    return kept(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text. Null and empty texts have no ids; every row gives one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                coded = bpe.encode_all([t or "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "ids": [np.frombuffer(x, "<i4") for x in coded]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), decoded as a stream. Null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode_stream(ids if ids is not None else (), together=4096)) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "text": texts})

    return coded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the decimal ids, decoded_sha256 of the bytes decoded from them.

    Null texts count as empty: no ids, digests of nothing. Repeated rows each give a row, null
    doc_ids are kept, an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, n, coded, decoded = batch.iloc[at : at + 500], [], [], []
                for found in bpe.encode_all([t or "" for t in part["text"]]):
                    ids = np.frombuffer(found, "<u4").tolist()
                    n.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    digest = hashlib.sha256()
                    for some in bpe.decode_bytes(ids):
                        digest.update(some)
                    decoded.append(digest.hexdigest())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_tokens": n, "ids_sha256": coded, "decoded_sha256": decoded})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
