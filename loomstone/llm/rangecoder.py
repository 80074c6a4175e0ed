"""Adaptive context-mixing range coder of token ids, many independent blocks at a time in numpy.

Each block starts from a fresh model and has a checksum of its own. A block is a lane of the arrays; all lanes
take the same step together. For each id, order 2 predicts the id last seen after the same two ids, order 1 the two
last seen after the same id, and order 0 has a frequency for every id that the block has used so far. What comes is one
of five symbols: the order-2 id, the newer or the older order-1 id, an id of the order-0 table, or a new one. Three
adaptive distributions of the symbol, in contexts made of the orders' confidence and of the last symbols, are mixed
with weights that follow their likelihood. An id of the order-0 table is coded by its frequency; the table's sums are
made anew every few steps. A new id is coded as its class, its number of bits, by an adaptive distribution, and the
bits below the highest as they are. Distributions are kept as the bounds of their symbols' ranges, which move towards
those of what came. As in prediction by partial matching, an order is told only of the ids that higher orders missed.
All arithmetic is of integers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
#: Ids of a block, and blocks coded side by side.
BLOCK, LANES = 8192, 1024
MAGIC = b"LSIDRC2\0"
#: Bits of a distribution's total and of the weights' sum; entries of the order-1, order-2 and order-0 tables. Beyond the last, new ids stay new.
TOTAL, WEIGHT, TABLE, KEPT = 16, 14, 2048, 4096
TOP, BOTTOM = U(1 << 48), U(1 << 32)
HIT2, HIT1, OLDER, KNOWN, NEW, SYMBOLS = 0, 1, 2, 3, 4, 5
#: Classes of new ids: ids of k bits for k from 0 to 28 are class max(0, k - 1).
CLASSES = 28
#: Least share of a symbol and of a weight; how slowly distributions, classes and weights follow.
FLOOR, LEAST, SLOW, SLOW_CLASS, SLOW_WEIGHT = 32, 256, 5, 5, 5
#: Steps between sums of the order-0 table, and what an id weighs when it is new and for each time it comes again.
EVERY, FIRST, AGAIN = 32, 1, 2


def _aims(symbols: int) -> np.ndarray:
    """For each symbol, the bounds that distributions move to when it comes: nearly all is its own."""
    at = np.arange(symbols + 1)
    out = np.where(at[None, :] <= np.arange(symbols)[:, None], at * FLOOR, (1 << TOTAL) - (symbols - at) * FLOOR)
    return out.astype(np.int32)


AIMS, CLASS_AIMS = _aims(SYMBOLS), _aims(CLASSES)


class Model:
    """What n lanes know; methods take the number m of lanes still going, which are the first."""

    def __init__(self, n: int):
        self.lanes = np.arange(n)
        # an id and how sure it is, in one number: id << 3 | sureness; of order 1 also the id before
        self.seen2, self.seen1, self.older = (np.zeros(n * TABLE, np.int32) for _ in range(3))
        even = ((np.arange(SYMBOLS + 1) << TOTAL) // SYMBOLS).astype(np.int32)
        self.by2, self.by1, self.by0 = (np.tile(even, (n * 64, 1)) for _ in range(3))
        self.w2, self.w1 = np.full(n, (1 << WEIGHT) // 3, np.int32), np.full(n, (1 << WEIGHT) // 3, np.int32)
        self.classes = np.tile(((np.arange(CLASSES + 1) << TOTAL) // CLASSES).astype(np.int32), (n, 1))
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.history = np.full(n, NEW * 9, np.int64)
        # order 0: ids in the order in which they came, their weights, the sums of these, and how many are summed
        self.ids, self.weights, self.sums = np.zeros(n * KEPT, np.int32), np.zeros((n, KEPT), np.int32), np.zeros(n * (KEPT + 1), np.int32)
        self.kept, self.summed = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def sum_up(self, m: int) -> None:
        """Make the order-0 table's sums anew."""
        width = int(self.kept[:m].max(initial=0))
        if width:
            self.sums.reshape(-1, KEPT + 1)[:m, 1 : width + 1] = np.cumsum(self.weights[:m, :width], axis=1, dtype=np.int32)
        self.summed[:m] = self.kept[:m]

    def predict(self, m: int) -> np.ndarray:
        """The bounds of the symbols' ranges, of 2 ** TOTAL (m x 6)."""
        lanes, one, history = self.lanes[:m], self.last1[:m], self.history[:m]
        self.at1 = lanes * TABLE + (one * 0x9E3779B1 >> 7 & TABLE - 1)
        self.at2 = lanes * TABLE + (one * 0x2C1B3C6D + self.last2[:m] * 0x9E3779B1 >> 9 & TABLE - 1)
        seen2, seen1 = self.seen2.take(self.at2), self.seen1.take(self.at1)
        self.guess2, self.guess1, self.guess0 = seen2 >> 3, seen1 >> 3, self.older.take(self.at1)
        self.sure2, self.sure1 = seen2 & 7, seen1 & 7
        same = self.guess2 == self.guess1
        self.row2 = lanes * 64 + (self.sure2 << 3 | same << 2 | self.sure1 >> 1)
        self.row1 = lanes * 64 + (self.sure1 << 3 | history & 7)
        self.row0 = lanes * 64 + history
        self.own2, self.own1, self.own0 = self.by2.take(self.row2, 0), self.by1.take(self.row1, 0), self.by0.take(self.row0, 0)
        w2, w1 = self.w2[:m, None], self.w1[:m, None]
        # each factor is below 2 ** 16 and the weights add up to 2 ** WEIGHT, so 32 bits hold the sum
        return self.own0 + ((self.own2 - self.own0) * w2 + (self.own1 - self.own0) * w1 >> WEIGHT)

    def update(self, m: int, ids: np.ndarray, symbol: np.ndarray) -> None:
        at = np.arange(m) * (SYMBOLS + 1) + symbol
        share = [own.take(at + 1) - own.take(at) for own in (self.own2, self.own1, self.own0)]
        w2, w1 = self.w2[:m], self.w1[:m]
        part2, part1 = w2 * (share[0] >> 2), w1 * (share[1] >> 2)
        whole = part2 + part1 + ((1 << WEIGHT) - w2 - w1) * (share[2] >> 2) + 1 >> WEIGHT
        whole = np.maximum(whole, 1)
        most = (1 << WEIGHT) - 2 * LEAST
        new2 = np.clip(w2 + (np.minimum(part2 // whole, 1 << WEIGHT) - w2 >> SLOW_WEIGHT), LEAST, most)
        new1 = np.clip(w1 + (np.minimum(part1 // whole, 1 << WEIGHT) - w1 >> SLOW_WEIGHT), LEAST, most)
        over = np.maximum(new2 + new1 - ((1 << WEIGHT) - LEAST), 0)
        self.w2[:m], self.w1[:m] = new2 - np.where(new2 >= new1, over, 0), new1 - np.where(new2 >= new1, 0, over)
        aim = AIMS.take(symbol, 0)
        for table, row, own in ((self.by2, self.row2, self.own2), (self.by1, self.row1, self.own1), (self.by0, self.row0, self.own0)):
            table[row] = own + (aim - own >> SLOW)
        known = ids << 3
        hit = self.guess2 == ids
        self.seen2[self.at2] = np.where(hit, known | np.minimum(self.sure2 + 1, 7), np.where(self.sure2 > 1, self.guess2 << 3 | self.sure2 >> 1, known))
        hit = self.guess1 == ids
        self.seen1[self.at1] = np.where(hit, known | np.minimum(self.sure1 + 1, 7), known)
        self.older[self.at1] = np.where(hit, self.guess0, self.guess1)
        self.history[:m] = (self.history[:m] << 3 | symbol) & 63
        self.last2[:m], self.last1[:m] = self.last1[:m], ids

    def add(self, lanes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New ids of lanes that go into the order-0 table; returns their places, -1 where it is full."""
        at = self.kept[lanes]
        room = at < KEPT
        own = lanes[room]
        self.ids[own * KEPT + at[room]] = ids[room]
        self.weights[own, at[room]] = FIRST
        self.kept[own] += 1
        return np.where(room, at, -1)

    def learn_class(self, lanes: np.ndarray, own: np.ndarray, kind: np.ndarray) -> None:
        self.classes[lanes] = own + (CLASS_AIMS.take(kind, 0) - own >> SLOW_CLASS)


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(ids.astype(np.float64))[1] - 1, 0)


def due(step: int) -> bool:
    """Whether the order-0 table is summed up before a step: often at first, then every EVERY steps."""
    return step % EVERY == 0 or step < 4 * EVERY and step % 8 == 0


class Coder:
    """Carry-less range coding of n lanes: 64-bit bounds, 16 bits out or in at a time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.words, self.width, self.at, self.code = words.reshape(-1), words.shape[1], np.zeros(n, np.int64), None
        self.start = np.arange(n) * self.width

    def begin_decoding(self) -> None:
        self.code = np.zeros(len(self.low), np.uint64)
        for _ in range(4):
            self.code = self.code << U(16) | self.words.take(self.start + self.at)
            self.at += 1

    def narrow(self, lanes: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.ndarray) -> None:
        """Take size steps of lanes' ranges from the begin-th on."""
        low, rng = self.low[lanes] + begin.astype(np.uint64) * step, size.astype(np.uint64) * step
        left = None
        l, r = low, rng
        while True:
            same = (l ^ (l + r)) < TOP
            go = np.nonzero(same | (r < BOTTOM))[0]
            if not len(go):
                break
            left = go if left is None else left[go]
            l, r, same = l[go], r[go], same[go]
            r = np.where(same, r, (~l + U(1)) & (BOTTOM - U(1)))
            n = lanes[left]
            place = self.start[n] + self.at[n]
            if self.code is None:
                self.words[place] = (l >> U(48)).astype(np.uint16)
            else:
                self.code[n] = self.code[n] << U(16) | self.words.take(place)
            self.at[n] += 1
            l, r = l << U(16), r << U(16)
            low[left], rng[left] = l, r
        self.low[lanes], self.range[lanes] = low, rng

    def value(self, lanes: np.ndarray, step: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """In which step of the range the code lies, `most` at most."""
        return np.minimum(((self.code[lanes] - self.low[lanes]) // step).astype(np.int64), most)

    def end_encoding(self) -> None:
        for _ in range(4):
            self.words[self.start + self.at] = (self.low >> U(48)).astype(np.uint16)
            self.low <<= U(16)
            self.at += 1


def ranks(ids: np.ndarray) -> np.ndarray:
    """For each id of each lane a number of its own in the lane, below the number of steps."""
    n, most = ids.shape
    out = np.empty((n, most), np.uint16 if most <= 1 << 16 else np.int32)
    for at in range(0, n, 64):  # few lanes at a time, for what sorting takes
        part = ids[at : at + 64]
        order = np.argsort(part, axis=1, kind="stable")
        held = np.take_along_axis(part, order, 1)
        new = np.zeros(part.shape, np.int32)
        new[:, 1:] = held[:, 1:] != held[:, :-1]
        np.put_along_axis(out[at : at + 64], order, np.cumsum(new, axis=1).astype(out.dtype), 1)
    return out


def _raw(coder: Coder, lanes: np.ndarray, bits: np.ndarray, value: np.ndarray | None) -> np.ndarray:
    """Code `bits` bits (at most 30) of lanes as they are, at most 15 at a time; without a value, decode them."""
    out = np.zeros(len(lanes), np.int64)
    for shift in (15, 0):
        some = np.nonzero(bits > shift)[0]
        if not len(some):
            continue
        own, size = lanes[some], np.minimum(bits[some] - shift, 15)
        step = coder.range[own] >> size.astype(np.uint64)
        part = coder.value(own, step, (1 << size) - 1) if value is None else value[some] >> shift & (1 << size) - 1
        coder.narrow(own, part, np.ones(len(own), np.int64), step)
        out[some] |= part << shift
    return out


def encode_lanes(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (lanes x longest) with lengths that never grow from lane to lane -> 16-bit words (lanes x most), words of each."""
    n, most = ids.shape
    words = np.zeros((n, 4 * most + 8), np.uint16)  # at most 26 bits for a symbol and a class, and 27 bits of an id
    model, coder, columns = Model(n), Coder(words), np.ascontiguousarray(ids.T)
    rank = np.ascontiguousarray(ranks(ids).T)
    place = np.full(n * most, KEPT, np.int16)  # of each id in the order-0 table, by its number in the lane
    going = np.searchsorted(-lengths, -np.arange(most), side="left")
    for t in range(most):
        m = int(going[t])
        if due(t):
            model.sum_up(m)
        now, lanes = columns[t, :m], model.lanes[:m]
        bounds = model.predict(m)
        number = lanes * most + rank[t, :m]
        where = place.take(number)
        symbol = np.where(where < model.summed[:m], KNOWN, NEW)
        symbol = np.where(model.guess2 == now, HIT2, np.where(model.guess1 == now, HIT1, np.where(model.guess0 == now, OLDER, symbol)))
        at = np.arange(m) * (SYMBOLS + 1) + symbol
        first = bounds.take(at)
        coder.narrow(lanes, first, bounds.take(at + 1) - first, coder.range[:m] >> U(TOTAL))
        known = np.nonzero(symbol == KNOWN)[0]
        if len(known):
            at = known * (KEPT + 1)
            first = model.sums.take(at + where[known])
            step = coder.range[known] // model.sums.take(at + model.summed[known]).astype(np.uint64)
            coder.narrow(known, first, model.sums.take(at + where[known] + 1) - first, step)
            model.weights[known, where[known]] += AGAIN
        new = np.nonzero(symbol == NEW)[0]
        if len(new):
            value = now[new].astype(np.int64)
            kind = class_of(value)
            own = model.classes.take(new, 0)
            at = np.arange(len(new)) * (CLASSES + 1) + kind
            first = own.take(at)
            coder.narrow(new, first, own.take(at + 1) - first, coder.range[new] >> U(TOTAL))
            bits = np.maximum(kind, 1)
            _raw(coder, new, bits, value & (1 << bits) - 1)
            model.learn_class(new, own, kind)
            added = model.add(new, value)
            unplaced = (place.take(number[new]) == KEPT) & (added >= 0)
            place[number[new[unplaced]]] = added[unplaced]
        model.update(m, now, symbol)
    coder.end_encoding()
    return words, coder.at


def decode_lanes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids (lanes x longest) of what encode_lanes made; words need 8 columns more than the longest lane."""
    n, most = len(words), int(lengths.max(initial=0))
    model, coder = Model(n), Coder(words)
    coder.begin_decoding()
    out = np.zeros((most, n), np.int32)
    going = np.searchsorted(-lengths, -np.arange(most), side="left")
    for t in range(most):
        m = int(going[t])
        if due(t):
            model.sum_up(m)
        lanes = model.lanes[:m]
        bounds = model.predict(m)
        step = coder.range[:m] >> U(TOTAL)
        value = coder.value(lanes, step, (1 << TOTAL) - 1)
        symbol = (bounds[:, 1:SYMBOLS] <= value[:, None]).sum(axis=1)
        at = np.arange(m) * (SYMBOLS + 1) + symbol
        first = bounds.take(at)
        coder.narrow(lanes, first, bounds.take(at + 1) - first, step)
        now = np.where(symbol == HIT2, model.guess2, np.where(symbol == HIT1, model.guess1, model.guess0))
        known = np.nonzero(symbol == KNOWN)[0]
        if len(known):
            at, count = known * (KEPT + 1), model.summed[known]
            total = model.sums.take(at + count)
            step = coder.range[known] // total.astype(np.uint64)
            value = coder.value(known, step, total - 1)
            # the last place whose sum isn't above the value
            where, reach = np.zeros(len(known), np.int64), 1 << int(count.max()).bit_length() - 1
            while reach:
                try_ = where + reach
                inside = try_ < count
                where = np.where(inside & (model.sums.take(at + np.where(inside, try_, 0)) <= value), try_, where)
                reach >>= 1
            first = model.sums.take(at + where)
            coder.narrow(known, first, model.sums.take(at + where + 1) - first, step)
            model.weights[known, where] += AGAIN
            now[known] = model.ids.take(known * KEPT + where)
        new = np.nonzero(symbol == NEW)[0]
        if len(new):
            own = model.classes.take(new, 0)
            step = coder.range[new] >> U(TOTAL)
            value = coder.value(new, step, (1 << TOTAL) - 1)
            kind = (own[:, 1:CLASSES] <= value[:, None]).sum(axis=1)
            at = np.arange(len(new)) * (CLASSES + 1) + kind
            first = own.take(at)
            coder.narrow(new, first, own.take(at + 1) - first, step)
            value = _raw(coder, new, np.maximum(kind, 1), None)
            value = np.where(kind > 0, value | 1 << kind, value)
            model.learn_class(new, own, kind)
            model.add(new, value)
            now[new] = value
        out[t, :m] = now
        model.update(m, now, symbol)
    return out.T


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk: header, a line for each block (ids, 16-bit words, crc32 of the ids as 32-bit numbers), and the blocks' words.

    Ids must be below 2 ** 28.
    """
    if len(ids) and (int(ids.max()) >= 1 << 28 or int(ids.min()) < 0):
        raise ValueError("ids must be from 0 to 2 ** 28 - 1")
    n = -(-len(ids) // block)
    heads, bodies = [], []
    for first in range(0, n, LANES):
        part = ids[first * block : (first + LANES) * block]
        lanes = -(-len(part) // block)
        lengths = np.full(lanes, block, np.int64)
        lengths[-1] = len(part) - (lanes - 1) * block
        laid = np.zeros((lanes, min(block, len(part))), np.int32)
        laid.reshape(-1)[: len(part)] = part
        words, sizes = encode_lanes(laid, lengths)
        for k in range(lanes):
            own = part[k * block : k * block + lengths[k]]
            heads.append(struct.pack("<III", lengths[k], sizes[k], zlib.crc32(own.astype("<u4").tobytes())))
            bodies.append(words[k, : sizes[k]].astype("<u2").tobytes())
    return b"".join([MAGIC, struct.pack("<II", n, block), *heads, *bodies])


def decode(data: bytes) -> np.ndarray:
    """The ids of a chunk; ValueError if a block's checksum is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("these aren't coded ids")
    n, block = struct.unpack_from("<II", data, 8)
    heads = np.frombuffer(data, "<u4", 3 * n, 16).reshape(n, 3).astype(np.int64)
    at = 16 + 12 * n
    out = []
    for first in range(0, n, LANES):
        own = heads[first : first + LANES]
        words = np.zeros((len(own), int(own[:, 1].max()) + 8), np.uint16)
        for k, size in enumerate(own[:, 1].tolist()):
            words[k, :size] = np.frombuffer(data, "<u2", size, at)
            at += 2 * size
        ids = decode_lanes(words, own[:, 0])
        for k, (length, _, crc) in enumerate(own.tolist()):
            if zlib.crc32(ids[k, :length].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {first + k} is damaged")
            out.append(ids[k, :length])
    return np.concatenate(out) if out else np.zeros(0, np.int64)
