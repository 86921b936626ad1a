import hashlib

import pytest

import corpus_pipeline
from pointmill.llm import op4_decontaminate, op7_lines, op8_simhash
from pointmill.llm.common import vocabulary

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()
ITEM = " ".join(WORDS[::-1])
LINE = "A line that is long enough to be a key, forty letters."


def text(k, n=60):
    return " ".join(f"{WORDS[(i * (k + 3) + i // 7) % 20]}{(i * k) % 11}" for i in range(n))


ROWS = [
    *((i, text(i), "en", f"host{i % 3}.org", 9) for i in range(1, 12)),
    (None, text(30), "en", "host1.org", None),
    (None, text(31), None, None, None),
    (None, text(30), "en", "host1.org", None),
    (5, text(40), "en", "host2.org", 3),
    (5, f"{text(41)} {ITEM} {text(42, 30)}", "en", "host2.org", 3),
    (5, text(43), "en", "host2.org", 3),
    (20, text(1), "de", "host0.org", 3),
    *((50 + i, f"{text(50 + i)}\n{LINE}\n{text(60 + i)}", "en", "host0.org", 3) for i in range(6)),
    (70, None, "en", "host0.org", 0),
    (71, "", None, "host0.org", 0),
    (72, "too short", "en", None, 0),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, fp int"


def plain(rows):
    """The stages by hand: rows that the rules keep, without repeated lines, one of each group, without the item."""
    rows = [(r[0], r[1]) for r in rows if len((r[1] or "").split()) >= 20]
    rows = [(i, t) for i, _, _, t in op7_lines.brute(rows)]
    prints = [op8_simhash.fingerprint(t.encode()) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[b] for b in range(len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 4) for a in range(len(rows))]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(group[k], k)
    return [r for k, r in enumerate(rows) if k in first.values() and ITEM not in r[1]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, 1) for r in ROWS], KIND).repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, "x")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "decontaminate", "encode"]


def test_run_equals_stages_by_hand(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = []
    for i, t in plain(ROWS):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert 10 < len(want) < len(ROWS) and sum(w[0] == 5 for w in want) >= 2 and any(w[0] is None for w in want)


def test_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), folder).count() == 0
