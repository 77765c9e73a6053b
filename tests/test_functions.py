"""Expressions against plain Python."""

import hashlib
import json
import re
import uuid

from pyspark.sql import functions as F

from weftline.functions import identity, status, text
from weftline.operators import worlds


def test_strip_and_keys(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = ["".join(spaces) + "a b" + "".join(spaces), "a", "", " \t", "x  y", *spaces]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r.i: r for r in rows.select("i", text.strip(F.col("v")).alias("s"), text.is_blank(F.col("v")).alias("b"), text.name_key(F.col("v")).alias("k"), text.name_key_folded(F.col("v")).alias("f")).collect()}
    for i, v in enumerate(values):
        assert got[i].s == v.strip() and got[i].b == (not v.strip()) and got[i].k == " ".join(v.split()).lower() and got[i].f == " ".join(v.split()).casefold()


def test_uuid5_and_candidates(spark):
    names = ["", "x", "é😀", "book:1:chunk:2"] + [f"n{i}" for i in range(60)]
    ns = str(uuid.uuid4())
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(identity.uuid5(F.lit(ns), F.col("n"))).collect()] == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]
    other = rows.limit(1).select(identity.candidate_id(F.lit(None).cast("string"), F.lit("r"), F.lit(1), F.lit(1), F.col("n"))).first()[0]
    assert uuid.UUID(other).version == 4


def test_profile_key(spark):
    args = [("google", "model-1", 3072, "RETRIEVAL_DOCUMENT", 2)]
    rows = spark.createDataFrame(args, "p string, m string, d int, t string, v int")
    names = dict(zip(("provider_id", "model_id", "dimensions", "task_type", "profile_version"), args[0]))
    key = hashlib.sha256(json.dumps(names, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = rows.select(identity.profile_key(*map(F.col, "pmdtv")).alias("k"), identity.collection_name("nodes", *map(F.col, "pmdtv")).alias("c")).first()
    safe = re.sub("[^a-z0-9_]+", "_", "nodes_google_model-1_3072_RETRIEVAL_DOCUMENT_v2".lower()).strip("_")[:64]
    assert (got.k, got.c) == (key, f"{safe}_{key}")


def test_slugs_names_suffixes(spark):
    rows = spark.createDataFrame([("My  World!",), ("***",), ("a/b.TXT",), ("x.tar.gz",), (".hidden",)], "v string")
    got = rows.select(text.slug(F.col("v")), text.suffix(F.col("v")), text.display_filename(F.col("v"))).collect()
    assert [r[0] for r in got] == ["my-world", "world", "a-b-txt", "x-tar-gz", "hidden"]
    assert [r[1] for r in got] == ["", "", ".txt", ".gz", ""]
    assert [r[2] for r in got] == ["My World!", "***", "b", "x.tar", ".hidden"]


def test_rollups(spark):
    rows = [("done", "embedded"), ("bad", "failed"), ("mix", "failed"), ("mix", "embedded"), ("wait", "failed"), ("wait", "pending")]
    found = spark.createDataFrame(rows, "k string, s string").groupBy("k").agg(status.embedding_rollup(F.col("s")).alias("r"))
    assert {r.k: r.r for r in found.collect()} == {"done": "completed", "bad": "failed", "mix": "partial", "wait": "partial"}
    rows = [("mix", "manifested"), ("mix", "failed_dependency"), ("wait", "waiting_dependency"), ("wait", "failed")]
    found = spark.createDataFrame(rows, "k string, s string").groupBy("k").agg(status.manifestation_rollup(F.col("s")).alias("r"))
    assert {r.k: r.r for r in found.collect()} == {"mix": "failed", "wait": "partial"}


def test_asset_rules(spark):
    rows = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\ntest"), ".png", "image"), (bytearray(b"nope"), ".png", "image"), (bytearray(b""), ".ttf", "font"), (bytearray(b"RIFFxxxxWEBP"), ".webp", "image"), (bytearray(b"x"), ".exe", "image"), (bytearray(b"\xff\xd8\xff"), ".jpg", "image"), (bytearray(b"\0\0\0 ftypmif1\0\0\0\0avif"), ".avif", "image")], "c binary, s string, k string")
    assert [r[0] for r in rows.select(status.asset_error(F.col("c"), F.col("s"), F.col("k"))).collect()] == [None, "IMAGE_SIGNATURE_INVALID", "ASSET_EMPTY", None, "ASSET_TYPE_UNSUPPORTED", None, None]
    safe = spark.createDataFrame([("image", "a", "x.png"), ("image", "a", "../x"), ("video", "a", "x"), ("font", "", "x"), (None, "a", "x")], "k string, a string, n string")
    assert [r[0] for r in safe.select(status.safe_record(F.col("k"), F.col("a"), F.col("n"))).collect()] == [True, False, False, False, False]


def test_token_gate_fails_closed(spark):
    rows = spark.createDataFrame([(None, 5), (6, 5), (5, 5), (5, None)], "c int, m int")
    assert [r[0] for r in rows.select(worlds.token_gate(F.col("c"), F.col("m"))).collect()] == ["COUNT_FAILED", "TOO_LARGE", "pass", "pass"]
    assert rows.select(worlds.token_gate(F.col("c"), F.col("m"), True)).collect()[3][0] == "LIMIT_MISSING"


def test_redacted_paths(spark):
    """A drive with a name behind it becomes the mark and that name."""
    lines = {
        r"loaded C:\Users\a b\books\one.txt": r"loaded <local-path>\one.txt", r"D:\x": r"<local-path>\x", r"E:\a\b\c.json; F:\d\e.json": r"<local-path>\c.json; <local-path>\e.json", "only G:\\": "only G:\\",
        r"C:\a\ " + "\\": r"<local-path>\ " + "\\", r"C:\a\\b": r"<local-path>\a\\b", "C:\\a\\:b": "<local-path>\\a\\:b", r"C:\a|b\c": r"<local-path>\a|b\c", "C:\\:x": "C:\\:x", "": "", "no path": "no path", r"\\share\x": r"\\share\x",
    }
    got = spark.createDataFrame([(k,) for k in lines] + [(None,)], "line string").select("line", text.redact_paths(F.col("line")).alias("out")).collect()
    assert {r.line: r.out for r in got} == lines | {None: None}


def test_times_without_a_zone_are_utc_in_any_session(spark):
    want = {"2024-05-06T07:08:09": 1714979289, "2024-05-06 07:08:09.5": 1714979289, "2024-05-06T07:08:09Z": 1714979289, "2024-05-06T07:08:09+02:00": 1714972089, "2024-05-06": 1714953600, "on 2024": None, "": None}
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = spark.createDataFrame([(k,) for k in want], "t string").select("t", F.unix_seconds(status.utc_timestamp(F.col("t"))).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r.t: r.s for r in got} == want
