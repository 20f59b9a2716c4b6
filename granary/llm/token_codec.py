"""Adaptive context-mixing range coder for token ids.

A block holds up to BLOCK ids and starts from an empty model. Its ids are cut
into lanes of equal length that are coded side by side with numpy: at each step
one id of every lane is coded with the same model, then the model learns all of
them. Coder and decoder take the same steps, so nothing but the ids is stored.

Model. Order 0 is a frequency table over the alphabet. Order 1 and order 2 each
remember, for the last id and for a hash of the last two ids, the id that
followed and how often it was right in a row. The three predictions are mixed
into one distribution: the two remembered ids get the share of cases in which
ids remembered with those counts were right so far, and order 0 gets the rest.
The mixture drives a range coder with 48-bit ranges, whose carries are settled
at the end.

Block layout, all little-endian: magic, number of ids, alphabet, lanes, bytes
per lane, lane bytes, CRC-32 of the ids as unsigned 32-bit numbers, CRC-32 of
everything before. decode() raises ValueError for a damaged block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"GRC1"
BLOCK = 1 << 20
LANES = 4096
#: Ids per lane at least, so that small blocks aren't all overhead.
SHORTEST = 64
TOTAL = 1 << 24
FLOOR = 16  # least order-0 frequency, of TOTAL: with at least an eighth of the mixture, no id's share rounds to nothing
SLOT_BITS = 6
SLOT = 1 << SLOT_BITS
LOW_BITS, DIGIT = 32, 16
MOST_IDS = 1 << 19
CONTEXTS = 1 << 18
HEAD = struct.Struct("<4sIII")


#: What a state tells: how often order 2 and order 1 were right in a row (three bits each), whether they agree, and whether each was right now.
STATES = np.arange(512)
#: How often each counts as right in a row after that.
NEXT1, NEXT2 = (np.where(hit, np.minimum(sure + 1, 7), sure >> 1).astype(np.int32) for hit, sure in ((STATES & 2, STATES >> 3 & 7), (STATES & 1, STATES >> 6)))


def pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The lowest two bits of a state: two answers, order 1's first."""
    return (one.view(np.int8) << 1 | two.view(np.int8)).astype(np.int64)


class Mixer:
    """The model of one block. A remembered entry is an id and, in its last three bits, how often it was right in a row.

    What is looked up has 32 bits, so that more of it stays in the processor's caches; what looks up has 64."""

    def __init__(self, alphabet: int, lanes: int, inverse: bool = False):
        self.inverse = inverse  # whether find() will be asked
        self.n, self.counts, self.unread = alphabet, np.zeros(alphabet, np.int64), []
        self.last = np.full(lanes, alphabet, np.int64)  # the id before; alphabet stands for none
        self.before = self.last
        self.table1, self.table2 = np.zeros(alphabet + 1, np.int32), np.zeros(CONTEXTS, np.int32)
        self.right = np.zeros((128, 3))
        self.right[:] = (0.2, 0.2, 1.0)
        self.step, self.refresh = 0, 1
        self.added = np.zeros((128, 4), np.int64)
        self.rebuild()
        self.look()

    def rebuild(self) -> None:
        """Order-0 cumulative frequencies, where every id keeps at least FLOOR, and the shares of each case."""
        if self.unread:
            self.counts += np.bincount(np.concatenate(self.unread), minlength=self.n)
            self.unread = []
        seen = int(self.counts.sum())
        spread = (TOTAL - FLOOR * self.n) / (seen + 0.02 * self.n + 1)
        freq = FLOOR + np.floor((self.counts + 0.02) * spread).astype(np.int64)
        freq[int(freq.argmax())] += TOTAL - int(freq.sum())
        self.cum = np.concatenate([[0], np.cumsum(freq)])
        self.ends = self.cum[1:]
        if self.inverse:  # the id at every SLOT-th place; FLOOR bounds how many more begin before the next
            self.slots = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(-(-self.cum // SLOT)))

    def look(self) -> None:
        """Predictions and shares for the next step."""
        self.at2 = (self.before * 0x9E3779B1 + self.last * 0x85EBCA6B >> 7) & (CONTEXTS - 1)
        entry1, entry2 = self.table1[self.last], self.table2[self.at2]
        self.p1, self.p2 = entry1 >> 3, entry2 >> 3
        self.same = self.p1 == self.p2
        self.case = (((entry2 & 7) << 6) + ((entry1 & 7) << 3) + self.same.astype(np.int32) * 4).astype(np.int64)
        share = self.right[:, :2] / self.right.sum(1, keepdims=True)
        self.added[:, 1:3] = (share * (TOTAL * 7 >> 3)).astype(np.int64) + 1
        self.added[:, 3] = self.added[:, 1] + self.added[:, 2]
        self.share = self.added.ravel()  # by state: what the remembered ids add to an id's share, as far as they name it
        self.w0 = (TOTAL - self.share[3:])[self.case]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' intervals begin, and how wide they are."""
        self.ids = ids.astype(np.int32)
        self.state = self.case + pairs(self.p1 == self.ids, self.p2 == self.ids)
        low = self.cum[ids] * self.w0 >> 24
        width = (self.ends[ids] * self.w0 >> 24) - low + self.share[self.state]
        low += self.share[self.case + pairs(self.p1 < self.ids, self.p2 < self.ids)]
        return low, width

    def find(self, target: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the targets."""
        a, b = np.minimum(self.p1, self.p2).astype(np.int64), np.maximum(self.p1, self.p2).astype(np.int64)
        first = 1 + (self.p1 <= self.p2).view(np.int8) + self.same.view(np.int8)  # whose share ends with a's: order 2's, order 1's or both
        past_a = (target >= (self.ends[a] * self.w0 >> 24) + self.share[self.case + first]).view(np.int8)
        past_b = (target >= (self.ends[b] * self.w0 >> 24) + TOTAL - self.w0).view(np.int8)
        rest = target - self.share[self.case + (past_a * first + past_b * (3 - first))]
        # below 2^49 by below 2^25: a quotient that isn't whole is further from the next whole number than a double's rounding
        place = np.minimum((((rest + 1 << 24) - 1) / self.w0).astype(np.int64), TOTAL - 1)
        ids = self.slots[place >> SLOT_BITS].astype(np.int64)
        at = np.flatnonzero(place >= self.ends[ids])
        while len(at):
            ids[at] += 1
            at = at[place[at] >= self.ends[ids[at]]]
        return np.minimum(ids, a + past_a * (b - a) + past_b * np.int64(MOST_IDS))

    def learn(self, ids: np.ndarray) -> None:
        """Takes the ids whose intervals were asked last."""
        seen = np.bincount(self.state, minlength=512).reshape(128, 4)
        self.right += np.stack([seen[:, 1] + seen[:, 3], seen[:, 2], seen[:, 0]], 1)
        self.right[self.right.sum(1) > 50_000] *= 0.5
        new = self.ids << 3
        self.table1[self.last] = new + NEXT1[self.state]
        self.table2[self.at2] = new + NEXT2[self.state]
        self.unread.append(ids)
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step >= self.refresh:
            self.rebuild()
            self.refresh = self.step + min(16, 1 + self.step // 2)
        self.look()


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes and ids per lane; the last lane may be shorter."""
    lanes = max(1, min(LANES, n // SHORTEST))
    length = -(-n // lanes)
    return -(-n // length), length


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """One block. Ids must be below alphabet, and alphabet at most MOST_IDS."""
    n = len(ids)
    if n > BLOCK or not 1 <= alphabet <= MOST_IDS or (n and (ids.min() < 0 or ids.max() >= alphabet)):
        raise ValueError("a block takes at most BLOCK ids below the alphabet")
    head = HEAD.pack(MAGIC, n, alphabet, 0)
    if not n:
        return seal(head, ids)
    lanes, length = lanes_of(n)
    grid = np.zeros(lanes * length, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
    mixer = Mixer(alphabet, lanes)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, 1 << LOW_BITS + DIGIT)
    digits, place, mask = np.zeros((length * 2 + 8) * lanes, np.uint32), np.arange(lanes), (1 << LOW_BITS) - 1

    def emit(at: np.ndarray) -> None:
        some = low[at]
        digits[place[at]] = some >> LOW_BITS
        place[at] += lanes
        low[at] = (some & mask) << DIGIT

    for step in range(length):
        active = grid[step]
        start, width = mixer.interval(active)
        unit = size >> 24
        low += unit * start
        size = unit * width
        at = np.flatnonzero(size <= 1 << LOW_BITS)
        while len(at):
            emit(at)
            size[at] <<= DIGIT
            at = at[size[at] <= 1 << LOW_BITS]
        mixer.learn(active)
    for _ in range(3):
        emit(np.arange(lanes))
    digits = digits.reshape(-1, lanes)[: int(place.max()) // lanes]  # digits by lanes
    carry = np.zeros(lanes, np.uint32)
    for row in digits[::-1]:
        whole = row + carry
        row[:], carry = whole & 0xFFFF, whole >> 16
    used = np.where(digits.any(0), len(digits) - (digits[::-1] != 0).argmax(0), 0)  # zeros at a lane's end needn't be stored
    body = digits.T.astype("<u2", order="C")[np.arange(len(digits)) < used[:, None]].tobytes()
    return seal(HEAD.pack(MAGIC, n, alphabet, lanes) + used.astype("<u4").tobytes() + body, ids)


def seal(front: bytes, ids: np.ndarray) -> bytes:
    front += struct.pack("<I", zlib.crc32(np.asarray(ids).astype("<u4").tobytes()))
    return front + struct.pack("<I", zlib.crc32(front))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block."""
    if len(block) < HEAD.size + 8 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, alphabet, lanes = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    if not n:
        return np.zeros(0, np.int64)
    want, length = lanes_of(n)
    if want != lanes:
        raise ValueError("damaged block")
    used = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    body = np.frombuffer(block, "<u2", int(used.sum()), HEAD.size + 4 * lanes).astype(np.int64)
    body = np.concatenate([body, np.zeros(1, np.int64)])
    ends = np.cumsum(used)
    place = ends - used

    def digit(at: np.ndarray) -> np.ndarray:
        here = place[at]
        place[at] += 1
        return np.where(here < ends[at], body[np.minimum(here, len(body) - 1)], 0)

    code = np.zeros(lanes, np.int64)  # what is left of the number above low
    for _ in range(3):
        code = (code << DIGIT) | digit(np.arange(lanes))
    mixer, size = Mixer(alphabet, lanes, inverse=True), np.full(lanes, 1 << LOW_BITS + DIGIT)
    grid = np.zeros((length, lanes), np.int64)
    for step in range(length):
        unit = size >> 24
        ids = mixer.find(np.minimum((code / unit).astype(np.int64), TOTAL - 1))  # code is below 2^48, unit below 2^25: exact as in find()
        start, width = mixer.interval(ids)
        code -= unit * start
        size = unit * width
        at = np.flatnonzero(size <= 1 << LOW_BITS)
        while len(at):
            code[at] = (code[at] << DIGIT) | digit(at)
            size[at] <<= DIGIT
            at = at[size[at] <= 1 << LOW_BITS]
        mixer.learn(ids)
        grid[step] = ids
    out = grid.T.ravel()[:n]
    if zlib.crc32(out.astype("<u4").tobytes()) != struct.unpack("<I", block[-8:-4])[0]:
        raise ValueError("damaged block")
    return out
