"""Whitening, periodic runs and packing: against brute force on small tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import packing, periodic, queries, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_residues_give_whole_numbers_back():
    moduli = whitening.primes(10**30)
    assert len(set(moduli)) == len(moduli) and all(p < 1 << whitening.BITS for p in moduli)
    for x in (0, 1, -1, 10**30, -(10**30), 123456789):
        assert whitening.remaindered([x % p for p in moduli], moduli) == x


def vectors(n=60, d=5, seed=1):
    draw = np.random.default_rng(seed)
    rows = (draw.normal(size=(n, d)) * [3, 1, 0.5, 40, 1000]).astype(np.float32)
    return [(i, [float(c) for c in r], i) for i, r in enumerate(rows)]


def test_whitening_against_whole_numbers(spark):
    rows = vectors()
    odd = [(100, None, 0), (101, [1.0, None, 1.0, 1.0, 1.0], 0), (102, [1.0, float("nan"), 1.0, 1.0, 1.0], 0), (103, [float("inf")] * 5, 0), (104, rows[3][1], 0), (None, rows[4][1], 0), (105, [], 0), (106, [2.0], 0), (107, [3.0], 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, whitening int")
    got = {r.vec_id: r.whitening_ for r in whitening.whiten(df, components=16).collect()}
    assert set(got) == {*range(60), 104, None, 105, 106, 107}
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    v = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(5)] for i in range(5)])
    e = np.linalg.eigvalsh(v)[::-1]
    for i in range(60):
        assert got[i].n == n and int(got[i].deviation) == sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
        assert np.allclose(got[i].explained, e / np.trace(v), rtol=1e-9) and got[i].identity_error < 1e-9
    w = np.array([got[i]["values"] for i in range(60)])
    assert np.allclose(w.T @ w / n, np.eye(5), atol=1e-9) and np.allclose(w.mean(0), 0, atol=1e-9)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    axes = np.linalg.lstsq(centred, w * np.sqrt(e), rcond=None)[0]
    assert np.allclose(v @ axes, axes * e, atol=1e-7 * e[0]) and np.allclose(axes.T @ axes, np.eye(5), atol=1e-9)
    assert got[104] == got[3] and got[None] == got[4] and got[105]["values"] == []
    # Lengths are spaces of their own: two vectors of one entry, at one deviation each.
    assert abs(got[106]["values"][0]) == pytest.approx(1) and got[106].n == 2 and got[107]["values"][0] == -got[106]["values"][0]


def test_whitening_far_from_zero_and_without_variance(spark):
    df = spark.createDataFrame([(1, [1e18, 0.0]), (2, [1e18 + 1e6, 0.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.whitening for r in whitening.whiten(df).collect()}
    # 1e18 and 1e18 + 1e6 are both beyond 62 bits once scaled, and so one vector.
    assert got[1] == got[2] == got[3] and got[1].n == 2 and int(got[1].deviation) == 1 << 126 and got[1]["values"][1] is None and got[1].explained == [1.0, None]
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 3 and all(r.whitening.n == 1 and r.whitening["values"] == [None, None] and int(r.whitening.deviation) == 0 for r in one)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_query_has_a_row_a_component(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert [c for c, _ in got.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(got.dtypes)["deviation"] == "bigint"
    rows = got.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("identity_error").alias("e")).collect()
    assert all(r.n == 16 and r.e < 1e-9 for r in rows)


def brute_runs(words):
    """Every stretch with its smallest period, that no neighbour extends, of six words and four periods or more."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(all(a == b for a, b in zip(stretch, stretch[p:])) for p in range(1, q)):
                found.append((i, len(stretch), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loops(count, seed=4, alphabet="ab"):
    draw = random.Random(seed)
    for _ in range(count):
        parts = []
        for _ in range(draw.randrange(5)):
            parts += [draw.choice(alphabet) for _ in range(draw.randrange(4))] * draw.randrange(1, 9)
        yield " ".join(parts)


def test_stretches_against_brute_force(monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 64)
    for text in [*loops(400), *loops(200, 5, "abc")]:
        words = text.split()
        ids = periodic.numbered(words)
        runs = periodic.smallest(periodic.stretches(ids, 1, len(words)))
        assert runs == brute_runs(words), text
        # Ranges of lags find the same.
        assert periodic.smallest([r for low in range(1, 40, 3) for r in periodic.stretches(ids, low, low + 2)]) == runs
        assert periodic.collapsed(words, runs) == brute_kept(words, runs)


def test_runs_of_frames_with_ranges_of_lags(spark, monkeypatch):
    texts = [None, "", " \n", "a", "b  c\tb c b\x0bc b c\n", *loops(60), " ".join(["x", "y", "z"] * 30), " ".join(["a"] * 100), " ".join(["a b c d e f g h i j k"] * 9)]
    rows = [(i, t, "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[-1], (None, texts[-2], "p"), (None, None, "p")], "doc_id long, text string, periodic string")
    want = sorted((str(i), [*brute_runs((t or "").split())], brute_kept((t or "").split(), brute_runs((t or "").split()))) for i, t, _ in docs.collect())
    for lags in (4096, 2):
        monkeypatch.setattr(periodic, "LAGS", lags)
        found = periodic.find(docs)
        got = sorted((str(r.doc_id), [tuple(x) for x in r.periodic_.runs], r.periodic_.collapsed) for r in found.collect())
        assert got == want and found.columns == ["doc_id", "text", "periodic", "periodic_"]
    assert periodic.find(docs.limit(0)).count() == 0


def test_periodic_query_follows_its_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    planted = 0
    for r in docs:
        words = WORDS.findall(r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 600 and h % 10:
            continue  # brute force takes its time
        runs = brute_runs(words)
        planted += h % 10 == 0 and bool(runs)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(brute_kept(words, runs).encode()).hexdigest()
    assert planted > 5


TOKENIZER = P.path("byte_bpe_50k.json")


def test_cuts():
    assert packing.cut(1, 4) == [0, 1] and packing.cut(4, 4) == [0, 4] and packing.cut(5, 4) == [0, 1, 5] and packing.cut(8, 4) == [0, 4, 8] and packing.cut(11, 4) == [0, 3, 7, 11]


def test_pieces_equal_the_library(spark):
    texts = ["", None, "don't 'S  \n\n x\t", "é€😀ÿ ß naïve ２３", "<|endoftext|> word", "word " * 500, "a" * 700]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (0, "")], "doc_id long, text string")
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    got = packing.pieces(docs, TOKENIZER, P.PATTERN, 64).collect()
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        found = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.piece, r.start))[:: 2 if i == 0 else 1]
        assert [x for r in found for x in r.ids] == ids and [r.start for r in found] == packing.cut(len(ids), 64)[:-1]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) == 64 or r.piece == 0 for r in found)


def test_a_worker_forgets_what_it_does_not_use(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    own = packing.Encoder(TOKENIZER, P.PATTERN)
    for text in ("a b c d", "é d e", "f", "a b 😀", ""):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own) + len(own.before) < 12


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= s]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("sizes", [
    [], [100], [1] * 7, [51] * 40, [100] * 5 + [60, 40, 39, 1], [34] * 90, [random.Random(2).randrange(1, 101) for _ in range(300)], [random.Random(3).randrange(30, 51) for _ in range(200)],
    [random.Random(4).randrange(1, 8) for _ in range(500)] + [70] * 30,
])
def test_packing_is_gapless_and_close_to_best_fit(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    got = packing.pack(rows, "id", "length", 100).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, sizes[r.id]))
    for held in places.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 100
    best = best_fit_decreasing(sizes, 100)
    assert len(places) <= best + max(2, best // 30)


def test_what_tasks_leave_meets_by_rank():
    assert packing.meetings([(0, 3, 0), (1, 2, 2), (2, 0, 9), (4, 1, 1)]) == [(0, 1, 3, 1, 0), (1, 0, 2, 2, 0), (0, 0, 1, 2, 2)]
    assert packing.meetings([(0, 0, 4), (1, 5, 0)]) == []


def test_packed_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 300), (1, "word " * 300), (None, None), (2, "a b c")], "doc_id long, text string")
    got = packing.packed(docs, TOKENIZER, P.PATTERN, 128).collect()
    assert sum(r.length for r in got) == sum(len(r.ids) for r in got) and sum(r.ids[-1] == 0 for r in got) == 4
    assert packing.packed(docs.limit(0), TOKENIZER, P.PATTERN, 128).count() == 0
