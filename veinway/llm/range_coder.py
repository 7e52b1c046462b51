"""Adaptive context-mixing range coder for token ids, over many independent blocks at once.

Each block starts from nothing. For every id the two ids before it (order 2) and the one before it
(order 1) each predict one id. The two confidences together name a context of the mixer, which has
learned in this block how often predictions like these are right, and gives order 2 and order 1
their shares of the range. What is left belongs to order 0: adaptive counts of all ids, small ids
one by one, larger ones in classes that grow with the id. One range-coder step codes the id. The
blocks of a call are the lanes of numpy vectors, so that a step costs a few vector operations for
thousands of blocks.
"""

import zlib

import numpy as np

WIDTH, LANES = 2048, 2048  # ids in a block, blocks that are coded together
SCALE = 31  # bits of the frequency scale
COUNTS = 14  # bits of the scale of order 0
ORDER1, ORDER2 = 9, 9  # bits of the prediction tables
MOST_BITS = 20
RATE, LEAST, MOST = 4, 64, 56000  # the mixer: its shift, the least and the largest share of 65536
SHARES = np.array([64, 20000, 33000, 42000, 48000, 51000, 53000, 55000], np.int32)  # at first, by confidence
#: The confidence after a miss and after a hit.
NEXT = np.array([[n >> 1, min(n + 1, 7)] for n in range(8)], np.uint32).ravel()
HEAD = np.dtype([("ids", "<u4"), ("words", "<u4"), ("crc", "<u4")])
U = np.uint64
LOW32 = U(0xFFFFFFFF)


class Classes:
    """Classes of ids for order 0: 64 of one id each, then 16 to each power of two."""

    def __init__(self, id_bits: int):
        if not 1 <= id_bits <= MOST_BITS:
            raise ValueError(f"ids of {id_bits} bits; 1 to {MOST_BITS} are known")
        self.id_bits = id_bits
        self.first = np.array([*range(64), *(16 + i << k for k in range(2, 1 + max(0, id_bits - 4)) for i in range(16))], np.int64)
        self.first = self.first[self.first < max(64, 1 << id_bits)]
        self.bits = np.array([0] * 64 + [int(x).bit_length() - 5 for x in self.first[64:]], np.int64)
        self.many = len(self.first)
        self.kind = (np.searchsorted(self.first, np.arange(1 << id_bits), "right") - 1).astype(np.int16)
        self.levels = [1 << k for k in reversed(range((self.many - 1).bit_length()))]


class Model:
    """Predictions and counts of all lanes; find() gives shares, learn() takes the ids that came."""

    def __init__(self, lanes: int, classes: Classes):
        self.classes, self.t = classes, 0
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2, self.mixer = lane << ORDER1, lane << ORDER2, lane << 6
        self.one, self.two = np.zeros(lanes << ORDER1, np.uint32), np.zeros(lanes << ORDER2, np.uint32)  # id << 3 | confidence
        by_two, by_one = np.divmod(np.arange(64), 8)
        self.share2, self.share1 = np.tile(SHARES[by_two], lanes), np.tile(SHARES[by_one] * 3 // 4 + 16, lanes)
        self.width = classes.many + 1
        self.counts = np.ones((lanes, classes.many), np.int32)
        # classes of many ids count more at first, so that every id has a place
        self.counts += ((1 << np.maximum(classes.bits - 3, 0)) >> 2).astype(np.int32)
        self.rows = lane * self.width
        self.before, self.last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.rebuild()

    def rebuild(self) -> None:
        """The cumulative counts of order 0, on a scale where every class has a place."""
        ends = np.cumsum(self.counts, 1, dtype=np.int32)
        ends = (ends * (((1 << COUNTS) - self.classes.many) / ends[:, -1:])).astype(np.int32) + np.arange(1, self.width, dtype=np.int32)
        self.starts = np.zeros((len(ends), self.width), np.int32)
        self.starts[:, 1:] = ends
        self.starts = self.starts.ravel()

    def find(self) -> None:
        """Sets the places and ids of both predictions and their shares of the scale."""
        last, before = self.last, self.before
        self.at1 = self.base1 + ((last * np.uint32(0x9E3779B1)) >> np.uint32(32 - ORDER1))
        self.at2 = self.base2 + ((((last * np.uint32(0x85EBCA6B)) ^ (before * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - ORDER2))
        e1, e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = e1 >> np.uint32(3), e2 >> np.uint32(3)
        self.n1, self.n2 = e1 & np.uint32(7), e2 & np.uint32(7)
        self.at = self.mixer + ((self.n2 << np.uint32(3)) | self.n1)
        self.q2, self.q1 = self.share2.take(self.at), self.share1.take(self.at)
        self.w2 = self.q2.astype(np.int64) << (SCALE - 16)
        left = ((65536 - self.q2).astype(np.int64) * self.q1) >> (32 - SCALE)
        self.w12 = self.w2 + left * (self.id1 != self.id2)

    def learn(self, ids: np.ndarray, missed: np.ndarray, kinds: np.ndarray) -> None:
        """missed: the lanes whose id was coded by order 0, kinds: the classes of these ids."""
        fresh = (ids << np.uint32(3)) | np.uint32(1)
        hits = []
        for at, own, n, table in ((self.at1, self.id1, self.n1, self.one), (self.at2, self.id2, self.n2, self.two)):
            hit = ids == own
            n = NEXT.take((n << np.uint32(1)) | hit)
            table[at] = np.where(n > 0, (own << np.uint32(3)) | n, fresh)
            hits.append(hit)
        q1, q2 = self.q1, self.q2
        self.share2[self.at] = q2 + ((np.where(hits[1], MOST, LEAST) - q2) >> RATE)
        self.share1[self.at] = q1 + ((np.where(hits[0], MOST, LEAST) - q1) >> RATE) * ~hits[1]
        self.before, self.last = self.last, ids
        self.counts[missed, kinds] += 16
        self.t += 1
        if self.t in (16, 48, 112) or self.t % 128 == 0:
            self.rebuild()

    def share(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of each lane's id on the scale, the lanes coded by order 0, and the classes of their ids."""
        is2 = ids == self.id2
        start = np.where(is2, 0, self.w2)
        size = np.where(is2, self.w2, self.w12 - self.w2)
        missed = np.flatnonzero(~(is2 | (ids == self.id1)))
        own = ids.take(missed)
        kinds = self.classes.kind.take(own).astype(np.int64)
        at, w12 = self.rows.take(missed) + kinds, self.w12.take(missed)
        unit = ((1 << SCALE) - w12) >> COUNTS
        first = self.starts.take(at)
        small = (unit * (self.starts.take(at + 1) - first)) >> self.classes.bits.take(kinds)
        start[missed] = w12 + unit * first + small * (own - self.classes.first.take(kinds))
        size[missed] = small
        return start, size, missed, kinds

    def named(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size, lanes of order 0, their classes) for a value on the scale in each lane."""
        is2 = value < self.w2
        ids = np.where(is2, self.id2, self.id1)
        start = np.where(is2, 0, self.w2)
        size = np.where(is2, self.w2, self.w12 - self.w2)
        missed = np.flatnonzero(value >= self.w12)
        kinds = np.zeros(len(missed), np.int64)
        if len(missed):
            rest = value.take(missed) - self.w12.take(missed)
            unit = ((1 << SCALE) - self.w12.take(missed)) >> COUNTS
            v = np.minimum(rest / unit, (1 << COUNTS) - 1).astype(np.int32)  # small enough to divide exactly
            rows, last = self.rows.take(missed), self.classes.many - 1
            for step in self.classes.levels:
                ahead = np.minimum(kinds + step, last)
                kinds = np.where(self.starts.take(rows + ahead) <= v, ahead, kinds)
            at = rows + kinds
            first = self.starts.take(at)
            small = (unit * (self.starts.take(at + 1) - first)) >> self.classes.bits.take(kinds)
            within = np.minimum((rest - unit * first) // small, (np.int64(1) << self.classes.bits.take(kinds)) - 1)
            ids[missed] = self.classes.first.take(kinds) + within
            start[missed] = self.w12.take(missed) + unit * first + small * within
            size[missed] = small
        return ids, start, size, missed, kinds


def encode_blocks(blocks: np.ndarray, id_bits: int = 16) -> list[np.ndarray]:
    """The code words of each row of ids; all rows have the same length. Ids of more than id_bits raise ValueError."""
    lanes, n = blocks.shape
    classes = Classes(id_bits)
    if blocks.size and int(blocks.max()) >> id_bits:
        raise ValueError(f"id {int(blocks.max())} has more than {id_bits} bits")
    model = Model(lanes, classes)
    columns = np.ascontiguousarray(blocks.T, np.uint32)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    words, used = np.zeros((lanes, n * 2 + 2), np.uint32), np.zeros(lanes, np.int64)
    for ids in columns:
        model.find()
        start, size, missed, kinds = model.share(ids)
        step = span >> U(SCALE)
        low += step * start.view(U)
        span = step * size.view(U)
        short = np.flatnonzero(span <= LOW32)
        if len(short):
            lo, sp = low[short], span[short]
            apart = ((lo ^ (lo + sp - U(1))) >> U(32)) != 0
            sp = np.where(apart, (U(0) - lo) & LOW32, sp)
            words[short, used[short]] = (lo >> U(32)).astype(np.uint32)
            used[short] += 1
            low[short], span[short] = lo << U(32), sp << U(32)
        model.learn(ids, missed, kinds)
    for _ in range(2):
        words[np.arange(lanes), used] = (low >> U(32)).astype(np.uint32)
        used += 1
        low <<= U(32)
    return [words[i, : used[i]] for i in range(lanes)]


def decode_blocks(words: list[np.ndarray], n: int, id_bits: int = 16) -> np.ndarray:
    """The ids of blocks of n ids each."""
    lanes = len(words)
    model = Model(lanes, Classes(id_bits))
    ends = np.cumsum([len(w) + 2 for w in words])
    flat = np.concatenate([np.concatenate([w, np.zeros(2, np.uint32)]) for w in words]).astype(U)
    at = ends - np.array([len(w) + 2 for w in words])
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    code = flat[at] << U(32) | flat[at + 1]
    at = at + 2
    out = np.zeros((n, lanes), np.uint32)
    for t in range(n):
        model.find()
        step = span >> U(SCALE)
        value = np.minimum((code - low) // step, U((1 << SCALE) - 1)).view(np.int64)
        ids, start, size, missed, kinds = model.named(value)
        low += step * start.view(U)
        span = step * size.view(U)
        short = np.flatnonzero(span <= LOW32)
        if len(short):
            lo, sp = low[short], span[short]
            apart = ((lo ^ (lo + sp - U(1))) >> U(32)) != 0
            sp = np.where(apart, (U(0) - lo) & LOW32, sp)
            code[short] = code[short] << U(32) | flat[np.minimum(at[short], len(flat) - 1)]
            at[short] += 1
            low[short], span[short] = lo << U(32), sp << U(32)
        out[t] = ids
        model.learn(ids, missed, kinds)
    return np.ascontiguousarray(out.T)


def pack_ids(many: list[np.ndarray], id_bits: int = 16) -> list[bytes]:
    """For each array of ids its blocks: a table of their heads, then their code words."""
    cuts = [(k, i, min(WIDTH, len(ids) - i)) for k, ids in enumerate(many) for i in range(0, len(ids), WIDTH)]
    coded: dict[tuple[int, int], np.ndarray] = {}
    for width in {c[2] for c in cuts}:
        same = [c for c in cuts if c[2] == width]
        for at in range(0, len(same), LANES):
            part = same[at : at + LANES]
            block = np.stack([many[k][i : i + width] for k, i, _ in part]).astype(np.uint32)
            for (k, i, _), w in zip(part, encode_blocks(block, id_bits), strict=True):
                coded[k, i] = w
    out = []
    for k, ids in enumerate(many):
        own = [(i, coded[k, i]) for i in range(0, len(ids), WIDTH)]
        heads = np.array([(min(WIDTH, len(ids) - i), len(w), zlib.crc32(ids[i : i + WIDTH].astype("<u4").tobytes())) for i, w in own], HEAD)
        out.append(np.uint32(len(own)).tobytes() + heads.tobytes() + b"".join(w.astype("<u4").tobytes() for _, w in own))
    return out


def unpack_ids(many: list[bytes], id_bits: int = 16) -> list[np.ndarray]:
    """The ids of each packed array; a block whose checksum differs raises ValueError."""
    blocks: list[tuple[int, int, int, np.ndarray]] = []
    heads_of = []
    for k, data in enumerate(many):
        n = int(np.frombuffer(data, "<u4", 1)[0])
        heads = np.frombuffer(data, HEAD, n, 4)
        words = np.frombuffer(data, "<u4", offset=4 + n * HEAD.itemsize)
        ends = np.cumsum(heads["words"])
        heads_of.append(heads)
        blocks += [(k, j, int(h["ids"]), words[e - h["words"] : e]) for j, (h, e) in enumerate(zip(heads, ends, strict=True))]
    found: dict[tuple[int, int], np.ndarray] = {}
    for width in {b[2] for b in blocks}:
        same = [b for b in blocks if b[2] == width]
        for at in range(0, len(same), LANES):
            part = same[at : at + LANES]
            for (k, j, _, _), ids in zip(part, decode_blocks([b[3] for b in part], width, id_bits), strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != heads_of[k]["crc"][j]:
                    raise ValueError(f"checksum of block {j} differs")
                found[k, j] = ids
    return [np.concatenate([found[k, j] for j in range(len(h))] or [np.zeros(0, np.uint32)]) for k, h in enumerate(heads_of)]
