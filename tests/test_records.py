"""User records, reductions with a state of one's own, and change masks against plain Python."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pointmill.functions import columns as C
from pointmill.functions import records as R
from pointmill.operators.intervals import largest_batch
from pointmill.operators.reduce import Bounds, reduce
from pointmill.plans.points import points
from pointmill.plans.spatial import Moments

CORE = [c for c in R.PARTS["core10"]]


def table(spark, more=("gps_time", "red", "green", "blue")):
    return spark.range(5).select(F.col("id").alias("point_index"), *(F.col("id").cast("int").alias(c) for c in CORE), *((F.col("id") * 10).cast("double").alias(c) for c in more))


def test_order_of_ways(spark):
    """A hook goes before an assignment, that before a base; later parts replace what earlier ones set; the rest is default."""
    hook = {"gps": lambda p: {"a": p["gps_time"] + 1}}
    first = R.UserRecord("r", {"a": ("f8", 7.0), "b": ("u2", 3)}, ("core10", "gps"), {"gps": {"b": "gps_time"}, "rgb": {"a": "red"}}, hook)
    row = R.mapped(table(spark, ("gps_time",)), first).where("point_index = 2").first()
    assert (row.a, row.b, row.gps_time, row.x) == (21.0, 3, 0, 2)
    row = R.mapped(table(spark), first).where("point_index = 2").first()
    assert (row.a, row.b) == (20.0, 3)  # the colours come later
    assert R.mapped(table(spark, ()), R.UserRecord("r", {"a": ("i4", -5)}, ("core10",))).first().a == -5
    for bad in (lambda: R.UserRecord("r", bases=("core11",)), lambda: R.UserRecord("r", {"a": ("u3", 0)}), lambda: R.mapped(table(spark, ()), R.UserRecord("r", bases=("rgb",))), lambda: R.mapped(table(spark), R.UserRecord("r", assigned={"gps": {"q": "gps_time"}}))):
        with pytest.raises(ValueError):
            bad()


def test_fields_as_bytes(spark):
    """All types of extra bytes, at their ends."""
    kinds = {f"f_{k}": (k, 0) for k, _ in R.TYPES}
    record = R.UserRecord("r", kinds, ("core10",))
    ends = {"f_u1": 255, "f_i1": -128, "f_u2": 65535, "f_i2": -32768, "f_u4": 2**32 - 1, "f_i4": -(2**31), "f_u8": 2**63 - 1, "f_i8": -(2**63), "f_f4": 0.5, "f_f8": -1e300}
    rows = table(spark, ()).select("x", *(F.expr(f"cast({v!r} AS {dict(R.TYPES)[kinds[n][0]]})").alias(n) if "f" not in kinds[n][0] else F.lit(v).cast(dict(R.TYPES)[kinds[n][0]]).alias(n) for n, v in ends.items()))
    packed = R.stored(rows, record)
    assert len(packed.first().extra_bytes) == R.size(record) == 42
    assert R.described(R.description(record)) == {n: k for n, (k, _) in kinds.items()}
    back = R.unpacked(packed, R.described(R.description(record))).first()
    assert {n: back[n] for n in ends} == ends
    for bad in (b"x" * 191, bytes(192)):
        with pytest.raises(ValueError):
            R.described(bad)
    with pytest.raises(Exception, match="nulls"):
        R.stored(rows.withColumn("f_u2", F.lit(None).cast("int")), record).collect()


def test_reduction(spark):
    p = points(spark, "/root/testdata/sf0.001").select("x", "y", "z")
    kind = "n long, " + ", ".join(f"cov_{a}{b} double" for a, b in Moments.PAIRS)
    rows = [tuple(r) for r in p.collect()]
    mean = lambda v: Fraction(sum(v), len(v))
    want = mean([x * y for x, y, _ in rows]) - mean([r[0] for r in rows]) * mean([r[1] for r in rows])
    for parts in (1, 7, 130):
        got = reduce(p.repartition(parts), Moments, Moments.add, Moments.merge, Moments.row, kind).collect()
        assert len(got) == 1 and got[0].n == 1000 and abs(Fraction(got[0].cov_xy) - want) < Fraction(1, 900)
    none = reduce(p.limit(0), Moments, Moments.add, Moments.merge, Moments.row, kind).first()
    assert none.n == 0 and none.cov_xx is None


def test_reduction_keeps_order(spark):
    """combine need not be commutative: states are joined in the order of the partitions."""
    df = spark.range(0, 300, 1, 150)
    got = reduce(df, list, lambda s, b: s + b.column(0).to_pylist(), lambda a, b: a + b, lambda s: {"all": s}, "all array<long>").first()
    assert got.all == list(range(300))


def test_change_masks(spark):
    """Channels that are met first, repeated and returning, against a plain loop; a chunk's first record has none."""
    names = ["chunk", "at", "scanner_channel", "return_number", "number_of_returns", "scan_angle", "gps_time", "point_source_id"]
    rows = [(k // 40, k, (k * k // 7) % 4, (k * 5) % 16, k // 9 % 3, k // 5 % 2, float(k // 4), k // 11 % 2) for k in range(130)]
    got = {r.at: r.mask for r in C.change_masks14(spark.createDataFrame(rows, names).repartition(3), "chunk", "at").collect()}
    want = {}
    for chunk in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == chunk]
        last, before = {own[0][2]: own[0]}, own[0]
        for r in own[1:]:
            old = last.get(r[2], before)
            turn = (r[3] - old[3]) % 16
            mask = {0: 0, 1: 1, 15: 2}.get(turn, 3) + sum((r[i] != old[i]) << b for i, b in ((4, 2), (5, 3), (6, 4), (7, 5))) + ((r[2] != before[2]) << 6)
            want[r[1]] = mask
            last[r[2]] = before = r
    assert got == want and len(got) == 126


@pytest.mark.parametrize("fmt", [0, 1, 2, 3, 6, 7])
def test_foreign_points(spark, fmt):
    """Each field's bits, signs kept, for every format; a null stays null."""
    own = {n: b for p in R.FORMATS[fmt] for n, b in R.FOREIGN[p].items()}
    names = sorted({n for n, _ in own.values()} - {"rgb"})
    values = [-70_001, -129, -1, 0, 3, 37, 255, 300, 70_000, None]
    rows = [(k, *(v if v is None or n != "gps_time" else float(v) for n in names), [v, 65_536 + k, 9]) for k, v in enumerate(values)]
    kind = "point_index long, " + ", ".join(f"{n} {'double' if n == 'gps_time' else 'long'}" for n in names) + ", rgb array<long>"
    got = R.from_foreign(spark.createDataFrame(rows, kind), fmt).orderBy("point_index").collect()
    signed = {"x", "y", "z", "scan_angle", "scan_angle_rank"}
    for r, v in zip(got, values, strict=True):
        for n, (source, bits) in own.items():
            want = v if source != "rgb" else (v, 65_536 + r.point_index, 9)[bits]
            bits = 16 if source == "rgb" else bits
            if want is not None and bits < 64:
                half = 1 << (bits - 1)
                want = (want + half) % (1 << bits) - half if n in signed else want % (1 << bits)
            assert r[n] == want, n
    for bad in (4, 5, 8, 11):
        with pytest.raises(ValueError, match="format"):
            R.from_foreign(spark.createDataFrame(rows, kind), bad)


def test_bounds(spark):
    kind = "x double, y double"
    df = spark.createDataFrame([(1.5, 2.0), (None, 99.0), (-3.0, None), (0.0, -7.0)], kind)
    run = lambda d: tuple(reduce(d, Bounds, Bounds.add, Bounds.merge, Bounds.row, Bounds.KIND).first())
    assert run(df.repartition(4)) == (0.0, -7.0, 1.5, 2.0)
    assert run(df.limit(0)) == run(df.where("x IS NULL")) == (None,) * 4
    b = Bounds()
    assert not b.contains(0, 0) and b.update(1, 2).contains(1, 2) and not b.contains(1, 3) and b.update(0, 5).contains(0.5, 3)
    assert b.merge(Bounds()).row() == {"min_x": 0.0, "min_y": 2.0, "max_x": 1.0, "max_y": 5.0}


def test_batches_and_texts(spark):
    chunks = spark.createDataFrame([(0, 5), (1, 5), (2, 9), (3, 1), (4, 10)], "chunk_id long, n_points long")
    assert [tuple(largest_batch(chunks, n).first()) for n in (1, 2, 3, 9)] == [(4, 10), (0, 10), (0, 19), (0, 30)]
    assert largest_batch(chunks.limit(0), 3).count() == 0
    texts = spark.sql("SELECT array(1, 2, null) AS a UNION ALL SELECT array() UNION ALL SELECT null").select(C.array_text("a").alias("t")).collect()
    assert [r.t for r in texts] == ["[1, 2]", "[]", None]
    both = spark.range(0, 65536, 257).select("id", C.colour_of(*C.colour_bytes("id")).alias("c")).where("id <> c")
    assert both.count() == 0
