"""The codec of compressed points: sizes in bytes that the format gives for known data, and round trips."""

import numpy as np
import pytest

from pointmill.codec import chunks, coder, items, layered


def twister32(seed):
    draw = np.random.RandomState(seed)
    while True:
        yield from np.frombuffer(draw.bytes(4 * 624), "<u4").tolist()


def twister64(seed):
    """The 64-bit generator of the same family, with its published constants."""
    mask, n, m = (1 << 64) - 1, 312, 156
    s = [seed]
    for i in range(1, n):
        s.append((6364136223846793005 * (s[-1] ^ s[-1] >> 62) + i) & mask)
    while True:
        for i in range(n):
            x = s[i] & 0xFFFFFFFF80000000 | s[(i + 1) % n] & 0x7FFFFFFF
            s[i] = s[(i + m) % n] ^ x >> 1 ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        for x in s:
            x ^= x >> 29 & 0x5555555555555555
            x ^= x << 17 & 0x71D67FFFEDA60000
            x ^= x << 37 & 0xFFF7EEE000000000
            yield x & mask ^ (x & mask) >> 43


def real(draw):
    return np.array([float(next(draw)) / float((1 << 64) - 1) * 2e6 - 1e6]).view("<u8")[0].item()


def core10(draw):
    x, y, z = (coder.signed(next(draw)) for _ in range(3))
    return x, y, z, next(draw) & 0xFFFF, next(draw) & 255, next(draw) & 255, next(draw) & 255, next(draw) & 255, next(draw) & 0xFFFF


def core14(draw):
    x, y, z = (coder.signed(next(draw)) for _ in range(3))
    light, r, n, flags, channel, direction, edge = next(draw) & 0xFFFF, *(next(draw) & w for w in (15, 15, 15, 3, 1, 1))
    return x, y, z, light, n << 4 | r, flags | channel << 4 | direction << 6 | edge << 7, next(draw) % 23, next(draw) & 255, coder.signed(next(draw), 16), next(draw) & 0xFFFF, real(draw)


def colour(draw, n=3):
    return tuple(b for _ in range(n) for b in divmod(next(draw) & 0xFFFF, 256)[::-1])


def coded(item, values):
    io = coder.Encoder()
    for v in values:
        item.step(io, v)
    return io.finish()


def decoded(item, data, n):
    io = coder.Decoder(data)
    return [item.step(io, None) for _ in range(n)]


def mutated():
    """1000 points: three fixed ones, then random changes of fields."""
    out = [(143, 234, 32, 0, 7 | 7 << 3 | 1 << 6 | 1 << 7, 21 | 1 << 6, 23, 13, 123), (1312312, 235, 36, 123, 0, 17 | 7 << 5, 0, 0, 0), (1312, -42, 36544, 42, 3 | 2 << 3 | 1 << 6, 1, 255, 32, 1)]
    draw = twister32(0)
    while len(out) < 1000:
        p, changed = list(out[-1]), next(draw) % 64
        for bit, field, wide in ((5, 4, 255), (4, 3, 0xFFFF), (3, 5, 255), (2, 6, 255), (1, 7, 255), (0, 8, 0xFFFF)):
            if changed >> bit & 1:
                p[field] = next(draw) & wide
        p[:3] = [coder.signed(next(draw)) for _ in range(3)]
        out.append(tuple(p))
    return out


def test_generator():
    draw = twister64(5489)
    assert [next(draw) for _ in range(10_000)][-1] == 9981545732273789042


def test_core10_size():
    points = mutated()
    data = coded(items.Core10(points[-1]), points)
    assert len(data) == 17377
    assert decoded(items.Core10(points[-1]), data, 1000) == points


def test_core14_size():
    draw, first = twister64(0), (0, 0, 0, 0, 0x11, 0, 12, 0, 0, 0, 0)
    points = [first, *(core14(draw) for _ in range(999))]
    item, ios = layered.Core14(first), [coder.Encoder() for _ in range(9)]
    for p in points[1:]:
        item.step(ios, p)
    layers = [io.finish() for io in ios]
    assert sum(map(len, layers)) + 4 * 9 == 30852
    item, ios = layered.Core14(first), [coder.Decoder(x) for x in layers]
    assert [item.step(ios, None) for _ in points[1:]] == points[1:]


# fixed values: times of the format's size tests, and the bytes that they take in the plain and in the extended kind
BREAKS = [7888823421312.0 * i if i % 50 < 5 else float(i % 5) for i in range(1000)]
RESTS = [0.2131233 + 0.5123 * i if i % 50 < 5 else 0.0 for i in range(1000)]
LARGE = [15666123123 * float(i) + 1e34 if i % 50 < 5 else 1e-65 - 1e-76 * i if i % 50 < 10 else 1e13 + 0.5123 * i if i % 50 < 15 else 15666123123123123123.0 * i + 1e34 for i in range(1000)]
SMALL = [1e-10 + float(i) * k * 1e-20 for k in (1, 501, 1, -11) for i in range(10)]
GPS_SIZES = [(0.0, [0, 1, 2, 3, 1, 0, 2], 29, 32), (12.0, list(range(2000)), 10376, 10376), (12.0, BREAKS, 6895, 6894), (12.0, RESTS, 900, 934), (12.0, LARGE, 1102, 1199), (12.0, SMALL, 130, 130)]


@pytest.mark.parametrize("extended", [False, True])
@pytest.mark.parametrize("case", range(len(GPS_SIZES)))
def test_gps_sizes(case, extended):
    bits = lambda v: np.array(v, float).view("<u8").tolist()
    seed, times, *sizes = GPS_SIZES[case]
    (seed,), times = bits([seed]), bits(times)
    data = coded(items.Gps(seed, extended=extended), times)
    assert len(data) == sizes[extended]
    assert [t for (t,) in decoded(items.Gps(seed, extended=extended), data, len(times))] == times


def test_gps_any_times():
    """Steady times with breaks, multiples, turns and other frames."""
    rng = np.random.default_rng(1)
    steps = rng.choice([7, 7, 7, 14, 70, 3500, 7000, -7, -70, -700, 0, 1 << 40, -(1 << 40), (1 << 31) - 1, -(1 << 31)], 3000)
    times = (np.cumsum(steps + rng.integers(-1, 2, 3000)) + (1 << 62)).astype("<u8").tolist()
    for extended in (False, True):
        data = coded(items.Gps(5, extended=extended), times)
        assert [t for (t,) in decoded(items.Gps(5, extended=extended), data, 3000)] == times


@pytest.mark.parametrize(("version", "few", "many"), [(2, 18, 6221), (1, 22, 6172)])
def test_colour_sizes(version, few, many):
    bytes_of = lambda *c: tuple(b for v in c for b in (v & 255, v >> 8))
    basic = [bytes_of(5, 6, 7), bytes_of(5, 6, 7), bytes_of(12345, 12345, 12345), bytes_of(1347, 64, 4563)]
    data = coded(items.Rgb12(bytes_of(1, 2, 3), version), basic)
    assert len(data) == few and decoded(items.Rgb12(bytes_of(1, 2, 3), version), data, 4) == basic
    draw = twister32(42)
    values = [colour(draw) for _ in range(1000)]
    data = coded(items.Rgb12((0,) * 6, version), values)
    assert len(data) == many and decoded(items.Rgb12((0,) * 6, version), data, 1000) == values


def test_table_sizes():
    counts, sizes = [1000] * 10 + [300], [4000 * i for i in range(10)] + [42]
    data = chunks.table_bytes(counts, sizes)
    assert len(data) == 34
    assert [(c, s) for c, _, s, _ in chunks.read_table(data, 1000, sum(counts))] == list(zip(counts, sizes, strict=True))
    counts, sizes = [30 * i for i in range(20)], [40 + i for i in range(20)]
    data = chunks.table_bytes(counts, sizes)
    assert len(data) == 49
    got = chunks.read_table(data, chunks.VARIABLE, sum(counts))
    assert [g[0] for g in got] == counts and [g[3] for g in got] == [8 + sum(sizes[:k]) for k in range(20)]


def raw_of(kinds, rows):
    return np.concatenate([np.array(list(c), k).view(np.uint8).reshape(len(rows), -1) for k, c in zip(kinds, zip(*rows, strict=True), strict=True)], axis=1)


def whole_size(parts, counts):
    return 8 + sum(map(len, parts)) + len(chunks.table_bytes(counts, list(map(len, parts))))


SIX = np.dtype("6u1")


def test_chunk_sizes():
    d, draw = chunks.Descriptor(2, 100, (chunks.Item(chunks.POINT10, 20, 2),)), twister64(42)
    rows = []
    for _ in range(100):
        rows.append((core10(draw),))
        real(draw)
    raw = raw_of([chunks._BYTES[chunks.POINT10]], rows)
    assert whole_size([chunks.encode(raw, d)], [100]) == 2138
    d = chunks.Descriptor(2, chunks.VARIABLE, (chunks.Item(chunks.GPSTIME11, 8, 2), chunks.Item(chunks.RGB12, 6, 2), chunks.Item(chunks.POINT10, 20, 2)))
    draw, rows = twister64(42), []
    for _ in range(200):
        p = core10(draw)
        t = (real(draw),)
        rows.append((t, colour(draw), p))
    raw = raw_of([chunks._BYTES[chunks.GPSTIME11], SIX, chunks._BYTES[chunks.POINT10]], rows)
    cuts = [(0, 10), (10, 30), (30, 150), (150, 151), (151, 200)]
    parts = [chunks.encode(raw[a:b], d) for a, b in cuts]
    assert whole_size(parts, [b - a for a, b in cuts]) == 7213
    assert all((chunks.decode(x, b - a, d) == raw[a:b]).all() for x, (a, b) in zip(parts, cuts, strict=True))
    d, draw = chunks.items_of(7), twister64(2024)
    rows = [(core14(draw), colour(draw)) for _ in range(150)]
    raw = raw_of([chunks._BYTES[chunks.POINT14], SIX], rows)
    part = chunks.encode(raw, d)
    assert whole_size([part], [150]) == 5929
    assert (chunks.decode(part, 150, d) == raw).all()


@pytest.mark.parametrize("fmt", [0, 1, 2, 3, 6, 7, 8])
@pytest.mark.parametrize(("n", "extra"), [(1, 0), (2, 3), (700, 2)])
def test_any_records(fmt, n, extra):
    """Random bytes as records, and records that hardly change."""
    d, rng = chunks.items_of(fmt, extra), np.random.default_rng(fmt)
    for high in (256, 2):
        raw = rng.integers(0, high, (n, d.length)).astype(np.uint8)
        assert (chunks.decode(chunks.encode(raw, d), n, d) == raw).all()


@pytest.mark.parametrize("version", [3, 4])
def test_versions_of_layers(version):
    base = chunks.items_of(8, 2)
    d = chunks.Descriptor(3, chunks.VARIABLE, tuple(chunks.Item(i.type, i.size, version) for i in base.items))
    raw = np.random.default_rng(3).integers(0, 256, (300, d.length)).astype(np.uint8)
    assert (chunks.decode(chunks.encode(raw, d), 300, d) == raw).all()
    assert chunks.described(d.payload()) == d


@pytest.mark.parametrize("item", [(chunks.POINT10, 21, 2), (chunks.POINT10, 20, 1), (chunks.WAVE13, 29, 1), (chunks.WAVE14, 29, 3), (99, 1, 1), (chunks.BYTE, 0, 2)])
def test_bad_descriptors(item):
    with pytest.raises(ValueError):
        chunks.Descriptor(2, 1, (chunks.Item(*item),))


def test_bad_chunks():
    d = chunks.items_of(6)
    raw = np.zeros((5, 30), np.uint8)
    with pytest.raises(ValueError):
        chunks.encode(raw[:0], d)
    data = chunks.encode(raw, d)
    for bad, n in ((data, 6), (data + b"x", 5)):
        with pytest.raises(ValueError):
            chunks.decode(bad, n, d)
    with pytest.raises(ValueError):
        chunks.items_of(4)
    with pytest.raises(ValueError):
        chunks.read_table(chunks.table_bytes([3], [10]), 3, 7)
    with pytest.raises(ValueError):
        coder.Decoder(b"abc")


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_integers(bits):
    rng = np.random.default_rng(bits)
    low = -(1 << (bits - 1))
    values = [0, 1, -1, low, -low - 1, low + 1, *(int(v) >> int(s) for v, s in zip(rng.integers(low, -low, 3000), rng.integers(0, bits, 3000), strict=True))]
    io, model = coder.Encoder(), coder.Integers(bits, 2)
    for k, v in enumerate(values):
        model.code(io, v, k % 2)
    io, model = coder.Decoder(io.finish()), coder.Integers(bits, 2)
    assert [model.code(io, None, k % 2) for k in range(len(values))] == values


def test_bits_and_raw():
    rng = np.random.default_rng(0)
    flips, sizes = (rng.random(5000) < 0.03).astype(int).tolist(), rng.integers(1, 33, 500).tolist()
    values = [int(rng.integers(0, 1 << s)) for s in sizes]
    io, model = coder.Encoder(), coder.Bit()
    for b in flips:
        io.bit(model, b)
    for s, v in zip(sizes, values, strict=True):
        io.raw(s, v)
    data = io.finish()
    io, model = coder.Decoder(data), coder.Bit()
    assert [io.bit(model) for _ in flips] == flips and [io.raw(s) for s in sizes] == values
    assert coder.Encoder().finish() == b"\x01\0\0\0" or len(coder.Encoder().finish()) == 4
