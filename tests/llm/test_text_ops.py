"""Byte-level BPE, secrets, media, token counts, toxicity: round trips, brute force and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, media, queries, secrets, token_counts, toxicity

TEXTS = ["", None, "a", " \n\n  x\t", "don't 'S 'll stop", "é€😀ÿ ß naïve", "１２３ ²³ Ⅷ 一二", "\x1c\x1d\x85\xa0 b", "x" * 3000, "word " * 4000, "<|endoftext|>", "​﻿\U0001f468‍\U0001f469"]
DOCS = "doc_id long, text string, lang string, source string, extra int"


def docs(spark, texts=TEXTS):
    rows = [(i, t, None if i % 5 == 1 else "en", f"s{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None), rows[2]], DOCS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_other_library(spark, reference):
    got = byte_bpe.digests(docs(spark), queries.RANKS, P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_any_character(reference):
    codec = byte_bpe.codec(queries.RANKS, P.PATTERN)
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice(["a", " ", "\n", "'", "s", "1", chr(draw.randrange(0x2500)), chr(draw.randrange(0xE000, 0x10FFFF))]) for _ in range(draw.randrange(12)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text) and codec.decode(ids).decode() == text
        spans = codec.offsets(text, ids)
        assert all(a < b for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text)))


def test_bpe_encode_and_decode_frames(spark):
    rows = byte_bpe.encode(docs(spark), queries.RANKS, P.PATTERN)
    back = byte_bpe.decode(rows, queries.RANKS, P.PATTERN).filter("doc_id is not null").collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    half = spark.createDataFrame([(1, byte_bpe.codec(queries.RANKS, P.PATTERN).encode("😀")[:1])], "doc_id long, ids array<int>")
    assert byte_bpe.decode(half, queries.RANKS, P.PATTERN).first().text == "�"
    assert byte_bpe.encode(docs(spark).limit(0), queries.RANKS, P.PATTERN).count() == 0


def base_spans(text):
    """The contract's patterns, one by one."""
    kinds = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6, 1), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]
    found = [(k, m.start(), m.end()) for k, p, n, g in kinds for m in p.finditer(text) if m.end(g) - m.start(g) >= n]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_base_spans(spark):
    draw = random.Random(8)
    parts = ["token", "API_KEY", "apikey", "Secret", "pass", "word", ": ", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é", "\n", "abc", "0123456789abcdef", "Key", "passwd="]
    texts = ["secret: token: abcdefg", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ""] + ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(600)]
    scanner = secrets.Scanner(secrets.example_credentials())
    got = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scanner).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for x, _, _ in want) for k in secrets.KINDS[:3])
        assert [s for s in scanner.spans(t) if s[0] != "format"] == want


def test_secrets_held_out_formats(spark):
    scanner = secrets.Scanner(secrets.example_credentials())
    fresh = [w for k, w in secrets.example_credentials(30, seed=123)]
    found = sum(any(a <= 4 and b >= 4 + len(w) for _, a, b in scanner.spans(f"use {w} now")) for w in fresh)
    assert found >= 0.97 * len(fresh)
    plain = [w for w in secrets.ordinary_runs(30, seed=77) if len(w) >= 16 and not base_spans(w)]
    assert sum(bool(scanner.spans(f"see {w} here")) for w in plain) <= 0.02 * len(plain)
    assert secrets.Scanner([]).spans(f"use {fresh[0]} now") == []
    rows = secrets.scan(docs(spark, [f"use {fresh[0]} now", None, ""]), scanner).collect()
    assert [r.value for r in rows] == [fresh[0]]


def test_secrets_of_any_length():
    draw = random.Random(5)
    run = lambda n: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k=n))
    scanner = secrets.Scanner(secrets.example_credentials())
    for payload in (700, 1410, 20_000):
        word = f"eyJ{run(40)}.eyJ{run(payload)}.{run(42)}x"
        assert scanner.spans(f"use {word} now") == [("format", 4, 4 + len(word))]
    assert scanner.spans("see " + "-".join(["theinganderenver"] * 100) + "1 here") == []


def test_secrets_candidates_of_any_form(spark):
    labelled = [("pin", "".join(random.Random(i).choices("0123456789", k=10))) for i in range(40)] + [("word", "Q" + "".join(random.Random(i).choices("QXZJVKW", k=13))) for i in range(60)]
    scanner = secrets.Scanner(labelled)
    word = "Q" + "".join(random.Random(99).choices("QXZJVKW", k=13))
    assert scanner.spans(f"see ={word}. now") == [("format", 5, 5 + len(word))]
    plain = "Readers of the 3d atlas (v2, 4th edition, 2024-05-17) call +49 30 1234567 or write to a1b2 at example.com; facade, defaced, ... --- 0x1f"
    assert secrets.Scanner(secrets.example_credentials()).spans(plain) == []
    scanner.ordinary.update(map(str, range(secrets.REMEMBERED)))
    assert scanner.spans(f"other {word}x {word}")[-1][2] == 6 + 2 * len(word) + 2 and len(scanner.ordinary) < secrets.REMEMBERED
    full = secrets.Scanner(secrets.example_credentials())
    for w in [w for _, w in secrets.example_credentials(20, seed=5)] + secrets.ordinary_runs(20, seed=6) + ["a1b2c3", "q"]:
        bare = w.strip(secrets._SIGNS)
        assert full.judged(w) == (full.ratio(bare) >= max(secrets.EVIDENCE, full.threshold * len(bare)))
    none = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert secrets.digests(none, scanner).count() == 0 and secrets.scan(none, scanner).count() == 0


def test_toxicity_counts_long_obfuscated_words():
    at = toxicity.NAMES.index("obfuscated")
    word = "lorem" * 10 + "1psum"
    assert len(word) > 40 and toxicity.features(f"a {word} b")[at] == toxicity.features("a l1psum b")[at] > 0


def test_media_round_trip(spark):
    got = media.digests(docs(spark)).filter("doc_id is not null").collect()
    for r in got:
        data = (TEXTS[r.doc_id] or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    for n in (64, 4096, 4160, 300_032):
        data = random.Random(n).randbytes(n)
        assert media.examine(media.write_avi(data))[0] == data


def test_media_general_decoder_agrees():
    data = random.Random(2).randbytes(64 * 20)
    frame = media.read_avi(media.write_avi(data))[1][0]
    quick = media.read_jpeg(frame)[0]
    # The same codes in a table with a second symbol, which the quick way does not take.
    wider = frame.replace(b"\xff\xc4\x00\x14\x10" + b"\x01" + bytes(15) + b"\x08", b"\xff\xc4\x00\x15\x10" + b"\x01\x01" + bytes(14) + b"\x08\x00")
    assert wider != frame
    assert np.array_equal(media.read_jpeg(wider)[0], quick)


def test_media_shots_and_errors(spark):
    dark, light = np.eye(16)[0], np.eye(16)[12]
    assert media.shots(np.array([dark] * 5 + [light] * 4)) == [(0, 5), (5, 9)]
    assert media.shots(np.array([dark] * 3)) == [(0, 3)] and media.shots(np.zeros((0, 16))) == []
    clip = media.write_avi(bytes(64))
    no_index = clip.replace(b"idx1", b"JUNK")
    assert media.read_avi(no_index)[1] == media.read_avi(clip)[1]
    rows = spark.createDataFrame([(1, bytearray(clip)), (2, bytearray(b"RIFF")), (3, None), (4, bytearray(clip[:-40]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.clips(rows).collect()}
    assert got[1].error is None and got[1].end_s == pytest.approx(1 / media.RATE) and all(got[i].error for i in (2, 3, 4))
    assert media.to_media(docs(spark)).count() == len(TEXTS) + 2


def test_token_rollups(spark, tmp_path, reference):
    count = lambda frame, sign=1: token_counts.counted(frame, "v1", queries.RANKS, P.PATTERN, sign=sign)
    store = token_counts.Rollup(spark, str(tmp_path / "store"))
    rows = docs(spark)
    assert store.totals().count() == 0
    assert store.commit("all", count(rows)) and not store.commit("all", count(rows))
    want = {}
    for r in rows.collect():
        n, t, c = want.get((r.source, r.lang), (0, 0, 0))
        want[r.source, r.lang] = (n + 1, t + len(reference.encode_ordinary(r.text or "")), c + len(r.text or ""))
    read = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in store.totals().collect()}
    assert read() == want
    assert store.commit("revise", token_counts.revised(count(rows.filter("doc_id = 9")), count(rows.filter("doc_id = 9").withColumn("text", F.lit("word")))))
    n, t, c = want["s0", "en"]
    want["s0", "en"] = (n, t - len(reference.encode_ordinary(TEXTS[9])) + 1, c - len(TEXTS[9]) + 4)
    assert read() == want
    assert store.commit("none", count(rows.limit(0))) and read() == want
    store.commit("drop", count(rows.filter("source is null"), -1))
    assert (None, None) not in read()
    with pytest.raises(ValueError):
        store.commit("too much", count(rows.filter("source is null"), -1))
    assert not store.commit("drop", count(rows)) and (None, None) not in read()


def toxic_corpus(n=600, seed=4):
    draw = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "you", "table", "river", "stone", "and"]
    out = []
    for i in range(n):
        bad = draw.random() < 0.2
        text = [draw.choice(words) for _ in range(draw.randint(0, 80))]
        if bad:
            for _ in range(3):
                text.insert(draw.randint(0, len(text)), draw.choice(["idiot", "scum!", "l0ser", "PATHETIC"]))
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_held_out(spark):
    corpus = toxic_corpus()
    rows = spark.createDataFrame([(i, t) for i, t, _ in corpus] + [(None, "null id"), (0, corpus[0][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, m) for i, _, m in corpus] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(rows, labels)
    got = toxicity.score(rows, model).collect()
    assert len(got) == len(corpus) + 2
    marks = {i: m for i, _, m in corpus}
    late = [r for r in got if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == marks[r.doc_id] for r in late) >= 0.97 * len(late)
    blind = toxicity.train(rows, labels.limit(0))
    assert {r.score for r in toxicity.score(rows, blind).collect()} == {0.0}


def test_isotonic_is_the_least_squares_fit():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0])
    knots, values = toxicity.isotonic(x, y)
    assert np.allclose(np.interp(x, knots, values), [0, 0.5, 0.5, 0.5, 0.5, 1])


def test_secrets_values_of_assignments():
    scanner = secrets.Scanner(secrets.example_credentials())
    word = next(w for k, w in secrets.example_credentials(1, seed=99) if k == "payment key")
    spans = scanner.spans(f'api_key = "{word}"')
    assert ("assign", 0, 11 + len(word)) in spans and ("format", 11, 11 + len(word)) in spans


def test_token_counts_query_equals_a_plain_count(spark):
    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(queries.RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        held = want.setdefault((r.source, r.lang), [0, 0, 0])
        for i, n in enumerate((1, len(plain.encode_ordinary(r.text or "")), len(r.text or ""))):
            held[i] += n
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op6_token_counts(spark, sf).collect()}
    assert got == want
