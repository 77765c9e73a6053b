"""Golden cases and invariants of the splitter."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.chunking import SplitterConfig, chunk_records, completed_prefix, split
from pyspark.sql import functions as F


def plain(text, c):
    """The rule, step by step."""
    if len(text) <= c.chunk_size:
        return [("", text)]
    out, start = [], 0
    while start < len(text):
        hard = min(start + c.chunk_size, len(text))
        end = hard
        if hard < len(text) and c.max_lookback:
            low = max(start, hard - c.max_lookback)
            window = text[low:hard]
            for marks in (["\n\n"], ["\n"], ["!", ".", "?"], [" "]):
                ends = [window.rfind(m) + len(m) for m in marks if m in window]
                if ends:
                    end = low + max(ends)
                    break
        end = hard if end <= start else end
        out.append((text[max(0, start - c.overlap_size) : start], text[start:end]))
        start = end
    return out


def chunks(spark, texts, c):
    rows = split(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), c).orderBy("id", "chunk_number").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r.id].append((r.overlap_text, r.chunk_text))
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("text, config, want", [
    ("No way! You did that?! Absolutely.", (12, 6, 0), ["No way!"]),
    ("abcdefghijklmno", (5, 2, 0), ["abcde", "fghij", "klmno"]),
    ("short", (10, 5, 3), ["short"]),
    ("", (10, 5, 3), [""]),
])
def test_golden(spark, text, config, want):
    found = [x for _, x in chunks(spark, [text], SplitterConfig(*config))[0]]
    assert "".join(found) == text
    assert found[: len(want)] == want


def test_priority_of_separators(spark):
    found = chunks(spark, ["Alpha beta.\n\nGamma delta.\nTheta iota? Kappa lambda mu"], SplitterConfig(22, 12, 4))[0]
    assert found[0][1] == "Alpha beta.\n\n"
    assert found[1][1].endswith("\n")
    assert found[1][0] == "a.\n\n"


def test_workers_hold_few_texts_at_once(spark):
    """Batches are bounded by rows and bytes, and no more than SLICE texts stand as lists of Python objects."""
    from weftline.operators import chunking

    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(name)
    n = 3 * chunking.SLICE + 1
    docs = spark.range(n, numPartitions=1).selectExpr("id", "if(id % 7 = 3, null, repeat(concat('word', id, '. '), 40)) as text")
    rows = split(docs, SplitterConfig(100, 20, 10)).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    whole = {}
    for r in sorted(rows, key=lambda r: (r.id, r.chunk_number)):
        whole[r.id] = whole.get(r.id, "") + r.chunk_text
    assert whole == {i: f"word{i}. " * 40 for i in range(n) if i % 7 != 3}


def test_many_texts_against_the_rule(spark):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choices("ab c.\n!?é😀", k=draw.randint(0, 200))) for _ in range(150)]
    for config in (SplitterConfig(12, 6, 3), SplitterConfig(7, 7, 20), SplitterConfig(5, 0, 2), SplitterConfig(1, 1, 0), SplitterConfig(9, 30, 4)):
        assert chunks(spark, texts, config) == [plain(t, config) for t in texts]


@pytest.mark.parametrize("bad", [(0, 0, 0), (5, -1, 0), (5, 0, -1)])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        SplitterConfig(*bad)
    with pytest.raises(TypeError):
        SplitterConfig(True, 0, 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.!", max_size=120), st.integers(1, 20), st.integers(0, 25), st.integers(0, 9))
def test_rule_partitions_any_text(text, size, look, overlap):
    found = [x for _, x in plain(text, SplitterConfig(size, look, overlap))]
    assert "".join(found) == text and all(len(x) <= size for x in found)


def test_null_text_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "a b", 8)], "id int, text string, start int").select("id", "text", F.col("start").alias("extra"))
    assert [(r.id, r.extra, r.chunk_text) for r in split(rows, SplitterConfig(2, 1, 0)).collect()] == [(2, 8, "a "), (2, 8, "b")]


def test_records(spark):
    import hashlib
    import uuid

    world = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    rows = split(spark.createDataFrame([(4, "abcdef")], "book int, text string"), SplitterConfig(4))
    got = chunk_records(rows, F.lit(world), F.lit("w"), F.col("book"), F.lit("s.txt")).orderBy("chunk_number").collect()
    assert [r.chunk_position for r in got] == ["1/2", "2/2"]
    assert got[1].chunk_file == "book_04_chunk_0002.json"
    assert got[1].point_id == str(uuid.uuid5(uuid.UUID(world), "book:4:chunk:2"))
    assert got[0].text_hash == hashlib.sha256(b"abcd").hexdigest()


def test_completed_prefix(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, None), ("c", 1, True)], "k string, n int, ok boolean")
    assert {r.k: r.completed for r in completed_prefix(rows, ["k"], "n", F.col("ok")).collect()} == {"a": 2, "b": 0, "c": 1}
