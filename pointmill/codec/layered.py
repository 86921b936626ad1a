"""Items of layered chunks (formats 6 to 10): each kind of field has a stream of its own, and models for each scanner channel.

step(ios, want, context) codes one record as in items, over the item's layers. The first item tells the others the context.
Versions 3 and 4 differ in which context the other items get while the channel stays, and in a slip that files of version 3
have: after a change to a channel that was met before, the last value of the channel before is used and replaced.
"""

from __future__ import annotations

from pointmill.codec.coder import Integers, Symbols
from pointmill.codec.items import RETURNS16, Gps, Io, Places, changed_bytes, coloured, models

#: Layers of the core item.
RETURNS, HEIGHT, CLASS, FLAGS, LIGHT, ANGLE, USER, SOURCE, TIME = range(9)


class _Channel:
    """The models and last values of one scanner channel."""

    def __init__(self, v: list[int], number: int):
        self.x, self.y, self.z, self.light, self.n, self.r = v[0], v[1], v[2], v[3], v[4] >> 4, v[4] & 15
        self.flags, self.kind, self.user, self.angle, self.source, self.time = v[5] & 0xCF, v[6], v[7], v[8], v[9], v[10]
        self.number, self.new_time = number, 0
        self.heights, self.lights = [self.z] * 8, [self.light] * 8
        self.masks, self.channels, self.ns, self.rs, self.same_time = models(128), Symbols(3), models(16), models(16), Symbols(13)
        self.places, self.kinds, self.flag_models, self.users = Places(), models(256), models(64), models(256)
        self.light_models, self.angles, self.sources = Integers(16, 4), Integers(16, 2), Integers(16)
        self.gps = Gps(self.time, extended=True)

    @property
    def kind_of_return(self) -> int:
        """3 for the only return, 2 for the first, 1 for the last, 0 for one between."""
        return (3 if self.n < 2 else 2) if self.r == 1 else int(self.r >= self.n)

    @property
    def packed(self) -> int:
        """The flags without the channel, as they are coded."""
        return self.flags & 15 | self.flags >> 2 & 0x30

    def values(self) -> list[int]:
        return [self.x, self.y, self.z, self.light, self.n << 4 | self.r, self.flags | self.number << 4, self.kind, self.user, self.angle, self.source, self.time]


class Core14:
    """x, y, z, intensity, returns, flags, class, user data, scan angle, source id and GPS time (its bits) of formats 6 to 10."""

    size, layers = 30, 9

    def __init__(self, seed: tuple, version: int = 3):
        self.version, self.now = version, seed[5] >> 4 & 3
        self.channels: list[_Channel | None] = [None] * 4
        self.channels[self.now] = _Channel(list(seed), self.now)
        self.context = self.now  # what the other items get

    def step(self, ios: list[Io], want: tuple | None, _: int | None = None) -> tuple:
        before, mask = self.channels[self.now], None
        if want is not None:
            target = want[5] >> 4 & 3
            known = self.channels[target] or before
            turn = (want[4] & 15) - known.r & 15
            mask = {0: 0, 1: 1, 15: 2}.get(turn, 3) | (want[4] >> 4 != known.n) << 2 | (want[8] != known.angle) << 3
            mask |= (want[10] != known.time) << 4 | (want[9] != known.source) << 5 | (target != self.now) << 6
        mask = ios[RETURNS].symbol(before.masks[before.kind_of_return * 2 + before.new_time], mask)
        if mask & 64:
            step = ios[RETURNS].symbol(before.channels, None if want is None else (target - self.now - 1) & 3)
            self.now = (self.now + step + 1) % 4
            if self.channels[self.now] is None:
                self.channels[self.now] = _Channel(before.values(), self.now)
            self.context = self.now
        else:
            self.context = 0 if self.version == 3 else self.now
        c = self.channels[self.now]
        self._fields(c, ios, want, mask)
        return tuple(c.values())

    @staticmethod
    def _fields(c: _Channel, ios: list[Io], want: tuple | None, mask: int) -> None:
        timed, of = mask >> 4 & 1, lambda k: None if want is None else want[k]
        if mask & 4:
            c.n = ios[RETURNS].symbol(c.ns[c.n], None if want is None else want[4] >> 4)
        r = None if want is None else want[4] & 15
        if mask & 3 == 3:
            c.r = ios[RETURNS].symbol(c.rs[c.r], r) if timed else (c.r + 2 + ios[RETURNS].symbol(c.same_time, None if r is None else (r - c.r - 2) & 15)) & 15
        else:
            c.r = (c.r + (0, 1, 15)[mask & 3]) & 15
        c.new_time, kind = timed, c.kind_of_return
        group, level = RETURNS16[c.n][c.r], min(abs(c.n - c.r), 7)
        if mask & 32:
            c.source = (c.source + c.sources.code(ios[SOURCE], None if want is None else want[9] - c.source)) & 0xFFFF
        if timed:
            c.time = c.gps.step(ios[TIME], of(10))[0]
        if mask & 8:
            angle = c.angle + c.angles.code(ios[ANGLE], None if want is None else want[8] - c.angle, timed)
            c.angle = (angle + (1 << 15) & 0xFFFF) - (1 << 15)
        # a layer without bytes: nothing in it has changed in the whole chunk
        if ios[CLASS] is not None:
            c.kind = ios[CLASS].symbol(c.kinds[(c.kind & 31) << 1 | (kind == 3)], of(6))
        c.x, c.y, c.z = c.places.step(ios[RETURNS], ios[HEIGHT], (c.x, c.y, c.heights[level]), want, group * 2 + timed, c.n == 1)
        c.heights[level] = c.z
        if ios[FLAGS] is not None:
            flags = ios[FLAGS].symbol(c.flag_models[c.packed], None if want is None else want[5] & 15 | want[5] >> 2 & 0x30)
            c.flags = flags & 15 | (flags & 0x30) << 2
        if ios[LIGHT] is not None:
            place = kind * 2 + timed
            c.light = (c.lights[place] + c.light_models.code(ios[LIGHT], None if want is None else want[3] - c.lights[place], kind)) & 0xFFFF
            c.lights[place] = c.light
        if ios[USER] is not None:
            c.user = ios[USER].symbol(c.users[c.user >> 2], of(7))


class _Contexts:
    """Last values by context. A context that is met first begins with the value of the one before."""

    def __init__(self, seed: tuple, context: int, slip: bool):
        self.last: list[tuple | None] = [None] * 4
        self.last[context], self.now, self.slip = seed, context, slip

    def enter(self, context: int) -> int:
        """The context whose last value counts and is replaced."""
        known, before = self.last[context] is not None, self.now
        if not known:
            self.last[context] = self.last[before]
        self.now = context
        return before if self.slip and known else context


class Rgb14:
    """The colours of formats 7, 8 and 10, as six bytes."""

    size, layers = 6, 1

    def __init__(self, seed: tuple, version: int = 3, context: int = 0):
        self.values = _Contexts(seed, context, version == 3)
        self.models = [(Symbols(128), models(256)) for _ in range(4)]

    def step(self, ios: list[Io], want: tuple | None, context: int) -> tuple:
        place = self.values.enter(context)
        if ios[0] is None:
            return self.values.last[context]
        out = self.values.last[place] = coloured(ios[0], *self.models[context], self.values.last[place], want, sparse=True)
        return out


class RgbNir14:
    """Colours and infrared of formats 8 and 10, as eight bytes in two layers."""

    size, layers = 8, 2

    def __init__(self, seed: tuple, version: int = 3, context: int = 0):
        self.values = _Contexts(seed, context, version == 3)
        self.models = [(Symbols(128), models(256), Symbols(4), models(256)) for _ in range(4)]

    def step(self, ios: list[Io], want: tuple | None, context: int) -> tuple:
        place = self.values.enter(context)
        last, (masks, colours, nir_masks, nirs) = self.values.last[place], self.models[context]
        rgb = last[:6] if ios[0] is None else coloured(ios[0], masks, colours, last, want, sparse=True)
        nir = last[6:] if ios[1] is None else changed_bytes(ios[1], nir_masks, nirs, last[6:], None if want is None else want[6:])
        out = self.values.last[place] = (*rgb, *nir)
        return out


class Bytes14:
    """Extra bytes of formats 6 to 10, a layer for each; the slip of version 3 is in all versions."""

    def __init__(self, seed: tuple, version: int = 3, context: int = 0):
        self.layers = self.size = len(seed)
        self.values = _Contexts(seed, context, slip=True)
        self.models = [models(256) for _ in range(4)]

    def step(self, ios: list[Io], want: tuple | None, context: int) -> tuple:
        place = self.values.enter(context)
        last, own = self.values.last[place], self.models[context]
        out = tuple(b if ios[k] is None else (b + ios[k].symbol(own[k], None if want is None else (want[k] - b) & 255)) & 255 for k, b in enumerate(last))
        self.values.last[place] = out
        return out
