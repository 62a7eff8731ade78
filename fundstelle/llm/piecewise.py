"""The BPE pattern's pieces of many texts at once, and the ids of pieces that came before."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
SLOTS_LOG2 = 20
#: Pieces that are looked up at once: their arrays stay in the processor's cache.
STEP = 1 << 15
MAX_IDS = 8
#: A piece's bytes and its length are one key of 16 bytes.
MAX_KEY = 15
Encoder = Callable[[bytes], list[int]]
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(MAX_KEY + 1)], np.uint64)


def _classes() -> np.ndarray:
    """The class of each code point of the BMP; what isn't the same in Unicode 3.2 and now may differ in the library, too."""
    old = unicodedata.ucd_3_2_0
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(1 << 16, UNSURE, np.uint8)
    for i in range(1 << 16):
        now = unicodedata.category(chr(i))
        if now != "Cn" and now[0] != "Z" and now == old.category(chr(i)):
            out[i] = kind.get(now[0], OTHER)
    out[_WHITE] = SPACE
    return out


_CLASSES = _classes()
_OF_BYTE = np.concatenate([_CLASSES[:128], np.full(128, UNSURE, np.uint8)])


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of sound UTF-8 belongs to."""
    cls = _OF_BYTE[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2)):
        at = lead[(buf[lead] >= low) & (buf[lead] < high)]
        if len(at):
            cp = buf[at].astype(np.int32) & (0x3F >> more)
            for j in range(1, more + 1):
                cp = cp << 6 | (buf[at + j] & 0x3F)
            for j in range(more + 1):
                cls[at + j] = _CLASSES[cp]
    return cls


def split(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces that ``bpe.PATTERN`` finds in each row, and whether each row is one that is left whole.

    A row is left whole if it has characters whose class isn't certain. The others' pieces are runs of one class with a
    blank in front of them; of a run of white space its last sign stands alone, or goes with what follows.
    """
    n, rows = len(buf), len(offs) - 1
    whole = np.zeros(rows, bool)
    if not n:
        return np.zeros(0, np.int64), whole
    cls = byte_classes(buf)
    firsts = offs[:-1][np.diff(offs) > 0]
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    cut = first[:n].copy()
    cut[1:] |= cls[1:] != cls[:-1]
    run = cut.copy()

    after = np.flatnonzero(run & (cls != SPACE) & ~first[:n])
    last = after - 1
    blank = buf[last] == 32
    cut[after[blank]] = False
    cut[last[blank]] = True
    last = last[~blank & (cls[last] == SPACE)]
    while len(back := np.flatnonzero(buf[last] & 0xC0 == 0x80)):
        last[back] -= 1
    cut[last] = True

    mark = np.flatnonzero((buf == 0x27) & run & cut)
    mark = mark[~first[mark + 1]]
    if len(mark):
        a = buf[mark + 1]
        b = np.where(first[mark + 2], 0, buf[np.minimum(mark + 2, n - 1)])
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut[mark[one | two] + 1] = False
        ends = np.concatenate([mark[one] + 2, mark[two] + 3])
        cut[ends[ends < n]] = True

    unsure = np.flatnonzero(cls == UNSURE)
    if len(unsure):
        whole[np.searchsorted(offs, unsure, side="right") - 1] = True
        cut &= ~np.repeat(whole, np.diff(offs))
        cut[firsts] = True
    return np.flatnonzero(cut), whole


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start[i]``, ``start[i] + 1`` and so on, ``counts[i]`` of each."""
    ends = np.cumsum(counts)
    return np.repeat(start - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceIds:
    """Ids of short pieces in a table of ``2 ** slots_log2`` places, each with the piece that came there last.

    The whole piece is compared, so what is found is right; what isn't is encoded and takes the place. A place
    takes 49 bytes.
    """

    def __init__(self, slots_log2: int = SLOTS_LOG2):
        n = 1 << slots_log2
        self.shift = np.uint64(64 - slots_log2)
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.count = np.zeros(n, np.uint8)
        self.ids = np.zeros(n * MAX_IDS, np.int32)

    def __call__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray, piece_ids: Encoder, text_ids: Encoder) -> tuple[np.ndarray, np.ndarray]:
        """The ids of byte ranges and their number in each; ``text_ids`` encodes the ``whole`` ones, ``piece_ids`` the others."""
        words = np.concatenate([buf, np.zeros(24 - len(buf) % 8, np.uint8)]).view("<u8")
        raw = buf.tobytes()
        done = [self._step(words, raw, start[i : i + STEP], end[i : i + STEP], whole[i : i + STEP], piece_ids, text_ids) for i in range(0, len(start), STEP)]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def _step(self, words: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, whole: np.ndarray, piece_ids: Encoder, text_ids: Encoder) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        short = (size <= MAX_KEY) & ~whole
        n = np.minimum(size, MAX_KEY)
        at, right = start >> 3, (start & 7).astype(np.uint64) << np.uint64(3)
        left = np.uint64(63) - right  # and one more: a shift by 64 isn't defined
        one, a, b, c = np.uint64(1), words[at], words[at + 1], words[np.minimum(at + 2, len(words) - 1)]
        low = (a >> right | b << left << one) & _MASK[n]
        high = (b >> right | c << left << one) & _MASK[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        slot = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        slot ^= slot >> np.uint64(32)
        slot = (slot * np.uint64(0x94D049BB133111EB) >> self.shift).astype(np.int64)
        hit = short & (self.low[slot] == low) & (self.high[slot] == high)
        miss = np.flatnonzero(~hit)

        made: dict[bytes, list[int]] = {}
        new, new_at = [], []
        fresh: list[int] = []
        sizes = []
        for i, p, q, text, brief in zip(miss.tolist(), start[miss].tolist(), end[miss].tolist(), whole[miss].tolist(), short[miss].tolist()):
            piece = raw[p:q]
            if text:
                ids = text_ids(piece)
            elif (ids := made.get(piece)) is None:
                ids = made[piece] = piece_ids(piece)
                if brief and len(ids) <= MAX_IDS:
                    new.append(i)
                    new_at.append(len(fresh))
            sizes.append(len(ids))
            fresh += ids
        made_ids = np.array(fresh, np.int32)

        counts = self.count[slot].astype(np.int64)
        counts[miss] = sizes
        out = np.empty(int(counts.sum()), np.int32)
        known = np.repeat(hit, counts)
        out[known] = self.ids[_spread(slot[hit] * MAX_IDS, counts[hit])]
        out[~known] = made_ids
        if new:
            place, first = np.unique(slot[new], return_index=True)
            i = np.array(new)[first]
            self.low[place], self.high[place], self.count[place] = low[i], high[i], counts[i]
            self.ids[_spread(place * MAX_IDS, counts[i])] = made_ids[_spread(np.array(new_at)[first], counts[i])]
        return out, counts
