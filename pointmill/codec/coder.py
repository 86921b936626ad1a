"""The range coder of compressed chunks and its adaptive models.

Encoder and Decoder have the same calls: symbol(), bit() and raw() take a value and return one. The encoder writes what it
is given; the decoder ignores it and returns what it reads. So each model and each item is written once, for both ways.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

TOP, WHOLE = 1 << 24, (1 << 32) - 1


class Symbols:
    """An adaptive model of n symbols: counts, and the shares that they had when last rebuilt."""

    __slots__ = ("counts", "cycle", "left", "n", "shares")
    _fresh: dict[int, list[int]] = {}  # noqa: RUF012

    def __init__(self, n: int):
        self.n, self.counts = n, [1] * n
        if n not in self._fresh:
            self.rebuild()
            self._fresh[n] = self.shares
        self.shares = self._fresh[n]
        self.cycle = self.left = (n + 6) >> 1

    def rebuild(self) -> None:
        total = sum(self.counts)
        if total > 1 << 15:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            total = sum(self.counts)
        scale = (1 << 31) // total
        self.shares = [0, *(scale * c >> 16 for c in accumulate(self.counts[:-1]))]

    def turn(self) -> None:
        """After a cycle's last symbol."""
        self.rebuild()
        self.cycle = self.left = min(5 * self.cycle >> 2, 8 * (self.n + 6))


class Bit:
    """An adaptive model of one bit, with 13 bits of probability."""

    __slots__ = ("cycle", "left", "share", "total", "zeros")

    def __init__(self) -> None:
        self.zeros, self.total, self.share, self.cycle, self.left = 1, 2, 4096, 4, 4

    def seen(self, bit: int) -> None:
        self.zeros += not bit
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << 13:
            self.total, self.zeros = (self.total + 1) >> 1, (self.zeros + 1) >> 1
            self.total += self.zeros == self.total
        self.share = ((1 << 31) // self.total) * self.zeros >> 18
        self.cycle = self.left = min(5 * self.cycle >> 2, 64)


class Encoder:
    def __init__(self) -> None:
        self.out, self.base, self.length = bytearray(), 0, WHOLE

    def _take(self, low: int, high: int) -> None:
        """Goes on with the part from low to high of the present range."""
        base = self.base + low
        if base > WHOLE:
            self._carry()
            base &= WHOLE
        length = high - low
        while length < TOP:
            self.out.append(base >> 24)
            base, length = base << 8 & WHOLE, length << 8
        self.base, self.length = base, length

    def _carry(self) -> None:
        """Into what is written."""
        at = len(self.out) - 1
        while self.out[at] == 255:
            self.out[at] = 0
            at -= 1
        self.out[at] += 1

    # a point takes a dozen symbols: symbol() of both ways does what _take() does, without its call
    def symbol(self, model: Symbols, s: int) -> int:
        length, shares = self.length, model.shares
        step = length >> 15
        low = shares[s] * step
        base = self.base + low
        length = (shares[s + 1] * step if s + 1 < model.n else length) - low
        if base > WHOLE:
            self._carry()
            base &= WHOLE
        while length < TOP:
            self.out.append(base >> 24)
            base, length = base << 8 & WHOLE, length << 8
        self.base, self.length = base, length
        model.counts[s] += 1
        model.left -= 1
        if not model.left:
            model.turn()
        return s

    def bit(self, model: Bit, bit: int) -> int:
        middle = model.share * (self.length >> 13)
        self._take(middle if bit else 0, self.length if bit else middle)
        model.seen(bit)
        return bit

    def raw(self, n: int, value: int) -> int:
        """n bits as they are; of more than 19 the low 16 go first."""
        low = value
        if n > 19:
            self.raw(16, value & 0xFFFF)
            n, low = n - 16, value >> 16
        unit = self.length >> n
        self._take(low * unit, (low + 1) * unit)
        return value

    def finish(self) -> bytes:
        """The bytes, at least four, with what the decoder needs beyond the last symbol."""
        long = self.length > 1 << 25
        self._take(*((TOP, 3 << 23) if long else (1 << 23, (1 << 23) + (1 << 15))))
        return bytes(self.out) + bytes(3 if long else 2)


class Decoder:
    def __init__(self, data: bytes | memoryview):
        if len(data) < 4:
            raise ValueError("a coded stream has four bytes at least")
        self.data, self.at, self.size, self.length = data, 4, len(data), WHOLE
        self.value = int.from_bytes(data[:4], "big")

    def _take(self, low: int, high: int) -> None:
        value, length = self.value - low, high - low
        while length < TOP:
            value = value << 8 | (self.data[self.at] if self.at < self.size else 0)
            self.at += 1
            length <<= 8
        self.value, self.length = value, length

    def symbol(self, model: Symbols, _: int | None = None) -> int:
        length, shares, value = self.length, model.shares, self.value
        step = length >> 15
        s = bisect_right(shares, value // step) - 1
        low = shares[s] * step
        value -= low
        length = (shares[s + 1] * step if s + 1 < model.n else length) - low
        while length < TOP:
            value = value << 8 | (self.data[self.at] if self.at < self.size else 0)
            self.at += 1
            length <<= 8
        self.value, self.length = value, length
        model.counts[s] += 1
        model.left -= 1
        if not model.left:
            model.turn()
        return s

    def bit(self, model: Bit, _: int | None = None) -> int:
        middle = model.share * (self.length >> 13)
        bit = int(self.value >= middle)
        self._take(middle if bit else 0, self.length if bit else middle)
        model.seen(bit)
        return bit

    def raw(self, n: int, _: int | None = None) -> int:
        low, size = 0, n
        if n > 19:
            low, size = self.raw(16), n - 16
        unit = self.length >> size
        s = self.value // unit
        self._take(s * unit, (s + 1) * unit)
        return s << 16 | low if n > 19 else s


def signed(value: int, bits: int = 32) -> int:
    """The signed number of the same low bits."""
    half = 1 << (bits - 1)
    return ((value + half) & ((1 << bits) - 1)) - half


class Integers:
    """Signed whole numbers of `bits` bits: the size class by a model of each instance, the rest by models that all share."""

    __slots__ = ("bits", "classes", "k", "rest", "zero")

    def __init__(self, bits: int, instances: int = 1):
        self.bits, self.k = bits, 0
        self.classes: list[Symbols | None] = [None] * instances
        self.zero, self.rest = Bit(), [None] * 32

    def code(self, io: Encoder | Decoder, value: int | None = None, instance: int = 0) -> int:
        """The value: the size class k is the least with -(2^k - 1) <= value <= 2^k; k stays for later contexts."""
        classes = self.classes[instance]
        if classes is None:
            classes = self.classes[instance] = Symbols(self.bits + 1)
        if value is not None:
            value = int(value)
            k = (value - 1).bit_length() if value > 0 else (-value).bit_length()
            io.symbol(classes, k)
        else:
            k = io.symbol(classes)
        self.k = k
        if k == 32:
            return -(1 << 31)
        if not k:
            return io.bit(self.zero, value)
        model = self.rest[k]
        if model is None:
            model = self.rest[k] = Symbols(1 << min(k, 8))
        place = None if value is None else value - 1 if value > 0 else value + (1 << k) - 1
        if k <= 8:
            place = io.symbol(model, place)
        else:
            low = k - 8
            top = io.symbol(model, None if place is None else place >> low)
            place = top << low | io.raw(low, None if place is None else place & ((1 << low) - 1))
        return place + 1 if place >> (k - 1) else place - (1 << k) + 1


class Median:
    """The approximate median of a run of numbers: five sorted slots, from which the largest or the smallest goes."""

    __slots__ = ("largest", "slots")

    def __init__(self) -> None:
        self.slots, self.largest = [0] * 5, True

    @property
    def value(self) -> int:
        return self.slots[2]

    def add(self, v: int) -> None:
        slots, median = self.slots, self.slots[2]
        slots.pop(4 if self.largest else 0)
        slots.insert(bisect_right(slots, v), v)
        self.largest = v < median or (v == median and not self.largest)
