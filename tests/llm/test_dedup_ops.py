"""URL filters, decontamination, suffix dedup, near dedup, line dedup, the pipeline: against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import components, decontamination, line_dedup, near_dedup, queries, suffix_dedup, url_filters

FOLDER = "/root/testdata/sf0.001"


def text_of(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    frame = queries.QUERIES[name](spark, FOLDER).select(*columns)
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def judged(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[3] if best else "allow")


def test_url_filters(spark):
    draw = random.Random(6)
    labels, paths = ["com", "net", "a", "b", "www", "co"], ["", "/", "/a", "/a/b", "/a/bc", "/b/"]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    rules = list({(host(), draw.choice(paths)): None for _ in range(60)})
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    urls = [None, "", "x", "http://", "://", "http://A.COM", "http://com?x", "http://a.com:80/a"] + [f"http://{host().upper() if draw.random() < 0.2 else host()}{draw.choice(paths)}{draw.choice(['', '?q=/a', '#f', 'zz'])}" for _ in range(500)]
    urls += ["http://www.a.com/a/b"] * 300
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[8], "x")], "page_id long, url string, host string")
    got = url_filters.judge(pages, spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("a.b", None, "block")], "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[8 if r.page_id is None else r.page_id], rules)
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r.rule for r in url_filters.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {None}


def brute_removals(texts, length=200):
    held = [(t or "").encode() for t in texts]
    seen = Counter(b[j : j + length] for b in held for j in range(len(b) - length + 1))
    out = []
    for b in held:
        mark = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                mark[j : j + length] = b"\1" * length
        runs = sum(mark[i] and not (i and mark[i - 1]) for i in range(len(mark)))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


def repeated_texts():
    draw = random.Random(9)
    fresh = lambda n: "".join(draw.choices("abcdefgh \n", k=n))
    shared, edge = fresh(260), fresh(200)
    texts = [None, "", "short", "z" * 700, "ab" * 300, fresh(900), fresh(199), edge, edge + "x", "y" + edge[1:], "é" * 150 + shared, shared[5:] + "é" * 150]
    texts += [fresh(draw.randint(0, 300)) + shared + fresh(draw.randint(0, 300)) for _ in range(30)]
    own = fresh(230)
    texts += [own + fresh(50) + own, texts[5], texts[5][:450] + "!" + texts[5][450:], texts[5][:199] + "?"]
    return texts


def test_suffix_dedup(spark):
    texts = repeated_texts()
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, d string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removals(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removals(texts)
    assert suffix_dedup.removals(rows.limit(0)).count() == 0


def test_suffix_dedup_of_grams_too_large_to_sort():
    """The same strings whether a gram's contexts are sorted or dealt by digest."""
    import pyarrow as pa

    texts = [t.encode() for t in repeated_texts() if t]
    owners, offsets, held = next(suffix_dedup._pieces(texts))
    piece, gram, start, n = suffix_dedup.samples(held)
    made = sorted({(int(g), held[p][s : s + k - 1 + 200], int(k)) for p, g, s, k in zip(piece, gram, start, n)})
    rows = [(g, hashlib.md5(x).digest(), k, False, x) for g, x, k in made]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()])], names=["gram", "c", "n", "many", "context"])

    def strings(limit):
        old, suffix_dedup.SORTED = suffix_dedup.SORTED, limit
        try:
            out = [r for b in suffix_dedup._sorted_contexts(iter([batch])) for r in b.to_pylist()]
        finally:
            suffix_dedup.SORTED = old
        times = Counter(r["string"] for r in out if r["string"])
        assert bool(times) == (limit < 1000)
        return {(r["c"], i) for r in out if r["string"] is None or times[r["string"]] > 1 for i in range(r["start"], r["stop"])}

    assert strings(600) == strings(2_000_000)


def brute_groups(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_texts():
    draw = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(90)]
    rows = [None, "", "one two", "ONE two", "one  two\t", " \x0b "] + [text_of(draw, words, 60) for _ in range(40)]
    for edits in (1, 2, 3, 4, 5, 6) * 12:
        copy = list(base)
        for _ in range(edits):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append(" ".join(copy))
    for i in range(8):  # a chain whose ends are far apart
        rows.append(" ".join([*base[i * 2 :], *[f"c{k}" for k in range(i * 2)]]))
    return rows + rows[6:9]


@pytest.mark.parametrize("block", [2048, 8])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = list(enumerate(near_texts()))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "null id row", "x")], "doc_id long, text string, node string")
    got = near_dedup.groups(frame, width=4).collect()
    assert len(got) == len(rows) + 1
    want = brute_groups(rows, 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_dedup_of_a_large_group_moves_few_sets(spark, monkeypatch):
    """Near copies of one text beyond a block, of which the least id links with some only."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(draw.choice([1, 2, 3]) if i else 3):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    moved, compare = [], near_dedup._groups_to_compare

    def counted(left, *rest):
        found = compare(left, *rest)
        moved.append((left.count(), found.count()))
        return found

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "_groups_to_compare", counted)
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 4)
    assert moved[0][1] <= 3 * moved[0][0], moved


def test_near_dedup_compares_a_crowd_once_and_not_in_each_bucket(spark, monkeypatch):
    """Near copies of one text share many buckets, in each of which a few stay outside its largest component."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(draw.choice([1, 2, 3])):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    moved, compare = [], near_dedup._groups_to_compare

    def counted(left, *rest):
        found = compare(left, *rest)
        moved.append((left.select("bucket", "node").distinct().count(), found.count()))
        return found

    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "_groups_to_compare", counted)
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 4)
    assert moved[0][1] * 3 <= moved[0][0], moved


def test_near_dedup_ids_with_two_texts(spark):
    rows = [(5, "a b c d e"), (1, "a b c d e"), (5, "f g h i j"), (9, "f g h i j"), (7, "k l m n o")]
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]
    assert near_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(1)
    for n in (1, 2, 30, 1000):
        bins = near_dedup.sketch(np.unique(draw.integers(0, 2**63, n).astype(np.uint64)))
        assert bins.max() < np.iinfo(np.uint64).max
    a = draw.integers(0, 2**63, 2000).astype(np.uint64)
    error = [abs(np.mean(near_dedup.sketch(a[:900]) == near_dedup.sketch(a[k : 900 + k])) - (900 - k) / (900 + k)) for k in (50, 100, 300, 600)]
    assert max(error) < 0.12


def test_intersections_by_both_ways():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.int64)) for _ in range(70)] + [np.unique(draw.integers(0, 9000, 50).astype(np.int64)) for _ in range(20)]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)) if i != j)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(None, 3), (7, 7)]
    top = {}
    root = lambda x: x if top.setdefault(x, x) == x else root(top[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a is not None and a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_cases(spark):
    shared = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(1, f"a\n{shared}\nb"), (2, f"one more\nline here\n{shared}"), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "x\r\ny"), (2, f"one more\nline here\n{shared}"), (None, f"{shared}\nnull id"), (8, shared)]
    frame = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id long, text string, doc string, row string")
    got = line_dedup.dedup_lines(frame).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "doc", "row", "line_dedup"]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text == f"{shared}\nnull id"  # null ids come first
    assert by[3][0].text is None and by[4][0].text == "" and by[5][0].text == by[6][0].text == "\n\n\n\n" and by[7][0].text == "x\r\ny"
    assert by[1][0].text.startswith("a") and len(by[1][0].text) < 100 and len(by[8][0].text) < len(shared) / 2
    assert by[2][0].text == by[2][1].text and by[2][0].line_dedup.removed_lines > 0


def test_line_dedup_shuffles_texts_once(spark):
    rows = [(i, f"own {i}\nsame one\nsame two\nsame three\nsame four\nsame five\nend {i}") for i in range(6)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "Generate explode(filter" not in plan and sum(r.line_dedup.removed_lines for r in found.collect()) > 0


def test_line_dedup_stage_takes_content_defined_chunks(spark):
    """Chunks of a few short lines go in the pipeline's stage too, wherever dedup_lines takes them."""
    shared = "\n".join(f"s {i}" for i in range(9))
    rows = [(i, f"own text {i}\n{shared}\nlast {i}", 0) for i in range(4)] + [(9, f"\n\nblank first\n\n\n{shared}\n\n", 0), (10, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    chunks = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup_stage(spark, docs, FOLDER).collect()}
    assert len(got) == 6 and got[0].text == rows[0][1] and got[10].text is None
    for i in (1, 2, 3):
        assert chunks[i].line_dedup.removed_lines > 1 and set(got[i].text.split("\n")) <= set(chunks[i].text.split("\n"))
        assert got[i].text.startswith(f"own text {i}") and got[i].n_chars == len(got[i].text)
    assert got[9].text.startswith("\n\nblank first") and {x for r in got.values() for x in (r.text or "").split("\n")} >= set(shared.split("\n"))


def test_passages_of_few_lines(spark):
    """Shared passages of one, two and three lines of over 50 words go whole, whatever stands around them."""
    draw = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    line = lambda n: text_of(draw, words, n) + "."
    shared = [[line(30) + " " + line(4) + " " + line(25)], [line(40), line(15)], [line(30), line(3), line(30)], [line(4), line(55), line(3)]]
    rows, own = [], {}
    for k, lines in enumerate(shared):
        for i in range(3):
            before, after = [line(draw.randint(2, 20)) for _ in range(2)], [line(draw.randint(2, 20)) for _ in range(2)]
            rows.append((10 * k + i, "\n".join([*before, *lines, *after])))
            own[10 * k + i] = "\n".join([*before, *(lines if i == 0 else []), *after])
    inside = line(12) + " " + line(14)
    rows += [(50, f"{line(30)} {inside} {line(20)}"), (51, f"{line(25)} {inside} {line(30)}"), (52, None), (53, "\n\nx\n\n"), (54, rows[0][1]), (54, rows[0][1]), (55, "\n\nx\n\n")]
    got = line_dedup.dedup_passages(spark.createDataFrame([(i, t, "d", "r") for i, t in rows], "doc_id long, text string, doc string, line_dedup string")).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "doc", "line_dedup", "line_dedup_"]
    by = {r.doc_id: r.text for r in got}
    assert {i: by[i] for i in own} == own
    assert by[50] == rows[12][1] and by[51] == rows[13][1].replace(inside + " ", "")
    assert by[52] is None and by[53] == by[55] == "\n\nx\n\n" and by[54] == ""
    stage = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int"), FOLDER)
    assert {r.doc_id: r.text for r in stage.collect()} == by


def brute_leaks(texts, items):
    """Verbatim items, with white space made equal."""
    flat = lambda t: " ".join((t or "").split())
    return {(i, k) for i, t in texts for k, x in items if flat(x) and flat(x) in flat(t)}


def test_decontamination(spark):
    con = duckdb.connect()
    texts, items = (con.execute(f"SELECT * FROM (SELECT {c}, text FROM '{FOLDER}/{t}.parquet')").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    got = decontamination.leaks(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(texts, items)
    assert all(r.verbatim for r in got)


def test_decontamination_of_changed_parameters(spark, monkeypatch):
    item = "If the man Anna buys 12 apples for 3 dollars and Bob buys 6 pears, then Anna pays 12 euros more today."
    fit = "Some text before. If the man Carl buys 40 apples for 9 miles and Dora buys 7 pears, then Carl pays 40 euros more today. And after."
    unfit = "If the man Carl buys 40 apples for 9 miles and Dora buys 7 pears, then Eve pays 41 euros more today."
    docs = spark.createDataFrame([(1, fit, 0), (2, unfit, 0), (3, item, 0), (4, None, 0), (5, "", 0), (None, item, 0), (6, "two  words", 0), (3, item, 0)], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    for bound in (decontamination.BROADCAST_WINDOWS, 0):  # both kinds of join
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
        got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
        assert set(got) == {(1, 1), (3, 1), (None, 1), (6, 4)}
        assert not got[1, 1].verbatim and got[1, 1].changed > 0 and got[3, 1].verbatim and got[3, 1].coverage == 1
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), bench).count() == 0


def test_decontamination_in_other_case_and_of_numbers(spark):
    item = "On Monday the baker Anna Berg of Oslo sold Bob Lund nine loaves and then Carl Moe the last cake."
    sums = "12 + 7 = 19; 4 * 5 = 20; 81 / 9 = 9; 3 - 2 = 1"
    rows = [(1, f"BEFORE IT. {item.upper()} AFTER IT."), (2, f"before. {item.lower()} after."), (3, f"So {sums}, he said."), (4, "So 13 + 8 = 21; 5 * 6 = 30; 72 / 9 = 8; 4 - 2 = 2, he said."), (5, item), (None, item.upper()), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id) for r in decontamination.leaks(docs, bench).collect()))
    assert got == [(0, 1), (1, 1), (2, 1), (3, 2), (5, 1)]


def test_decontamination_of_sums_with_other_numbers(spark):
    items = [(1, "Compute 3 + 4 * 5 - 6 / 2 + 17."), (2, "What is 3 + 4?"), (3, "Solve 12 km + 5 km = 17 km − 2 × 3."), (4, "12 + 7 = 19; 4 * 5 = 20; 81 / 9 = 9; 3 - 2 = 1")]
    texts = {
        1: "Compute 3 + 4 * 5 - 6 / 2 + 17.", 2: "So: compute 9 + 8 * 2 - 5 / 7 + 31, please.", 3: "Compute 9 - 8 * 2 - 5 / 7 + 31.", 4: "Compute 9 + 8 * 2. Later - 5 / 7 + 31.", 5: "What is 8 + 9?",
        6: "well solve 40 km + 2 km = 42 km - 7 * 8", 7: "13 + 8 = 21; 5 * 6 = 30; 72 / 9 = 8; 4 - 2 = 2", 8: "Compute 3 + 3 * 3 - 3 / 3 + 3.", 9: "15 + 6 = 21; 3 * 7 = 27; 40 / 8 = 8; 2 - 7 = 5", 10: "what is 3 + 4",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Other signs, a broken passage and the bare question are other texts; so is 7, whose 9 stands for 9 and for 8.
    assert set(got) == {(1, 1), (2, 1), (8, 1), (6, 3), (9, 4), (10, 2)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].changed == 6


def test_pipeline_stages(spark):
    """Each stage on its own input against its brute-force form."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        rows = after.collect()
        if name == "line dedup":
            assert after.columns == columns and {r.doc_id for r in rows} == set(before) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in rows} == {i for i, (_, c) in brute_groups(before.items(), 5).items() if i == c}
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(before) - {r.doc_id for r in rows} == {i for i, _ in brute_leaks(before.items(), items)}
        elif name == "byte-level BPE":
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before.items()}
            break
        else:
            assert after.columns == columns and len(rows) > 0.7 * len(before)
        docs = spark.createDataFrame(rows, docs.schema)
        before = {r.doc_id: r.text for r in rows}


def test_near_dedup_stage_of_repeated_rows_and_null_ids(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(3, words), (3, words), (None, words), (7, words + " tail"), (None, "another text that nothing else is like"), (None, "another text that nothing else is like"), (9, None), (9, None), (11, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("?"))).collect())
    assert got == [(-1, "another text that nothing else is like"), (3, words), (9, "?"), (11, "")]
