"""Operator 9: line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of the last two lines ends a chunk wherever it is divisible by DIVISOR, so an inserted
or deleted line moves boundaries near it only. Chunks of two non-blank lines or more that occur again anywhere are
removed everywhere but at their first place, least by (id, text hash, start), where their SHA-256 is the same.

Distribution: chunk hashes are written once, counted with map-side combination, and those that repeat meet their
occurrences again; no chunk carries its text. The occurrences of a hot hash are dealt over salts, to each of which its
first place is copied. Documents are shuffled once, by their own key, for the result.

Defined cases: null text stays null and has no lines removed. A text without a repeated chunk is unchanged to the byte;
one whose every chunk goes becomes empty and its row stays. Lines end at \\n alone, so \\r stays in its line. Rows that
agree in id and text are one document for the choice of first places and get the same result; null ids come first.
Extra columns are returned as they are, whatever their names.

These chunks are those of the query's SQL and miss passages of few lines. dedup_passages() takes every repeated passage
of whole units: a unit is a line (with the blank lines behind it), or a sentence of a line of more than PARAGRAPH words.
From each unit on, and up to each unit, the fewest units that hold LEAST words are a passage; where the same passage
starts anywhere earlier, all of its units go. So a repeated run of units of 2 * LEAST words goes whole, whatever stands
around it, and of every unit's text the first place stays. Passages are compared by 128 bits of hash, without white
space at their units' ends. A passage that repeats within itself (a line over and over) shrinks to its first period.
With a divisor it takes repeated chunks as well, of lines with the blank lines behind them, so that short ones go too. All
is judged on the input, and first places have one order, so the first place of every unit's text still stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, copied, dealt, fresh, hot, let, materialise

#: One line in so many ends a chunk.
DIVISOR = 3
_NEWLINE, _SPACES = "\n", " \t\n\v\f\r"
#: Words of the shortest passage, and of the longest line that is not cut into sentences.
LEAST, PARAGRAPH = 10, 50
_LINE_END, _SENTENCE_END = r"\n(?![\x20\x09\x0B-\x0D]*(?:\n|\z))", r"(?<=[.!?]\x20)(?=[^\x20])"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR, end: str = _NEWLINE) -> Column:
    """array<struct<at, n, text>>: the chunks of a text in order, by first line and lines; joined by newlines they are the text."""

    def ends(h: Column) -> Column:
        last = F.size(h) - 1
        rolled = lambda i: F.get(h, i) * 31 + F.coalesce(F.get(h, i - 1), F.lit(0)) * 17
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) % divisor == 0))

    def cut(lines: Column, e: Column) -> Column:
        start = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        body = lambda x, k: F.slice(lines, start(k) + 1, x - start(k) + 1)
        return F.transform(e, lambda x, k: let(body(x, k), lambda b: F.struct(start(k).alias("at"), F.size(b).alias("n"), F.array_join(b, _NEWLINE).alias("text"))))

    return let(F.split(text, end, -1), lambda lines: let(F.transform(lines, line_hash), lambda h: let(ends(h), lambda e: cut(lines, e))))


def _many(text: Column) -> Column:
    """Whether a chunk has two lines or more that are not blank."""
    return text.rlike(r"[^\x20\x09-\x0D][^\n]*\n(?s:.*)[^\x20\x09-\x0D]")


def _later(hashed: DataFrame, label: str) -> DataFrame:
    """The rows of hashed (doc, at, n, h, g) whose h and g stand at an earlier place (doc, at) too."""
    counted = materialise(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), f"repeated-{label}")
    heavy = hot(counted, ["h"], counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    again = materialise(dealt(hashed, heavy, ["h"], ["doc", "at"]).join(copied(counted.select("h"), heavy, ["h"]), ["h", "salt"]), f"again-{label}")
    first = again.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"))
    return again.join(copied(first, heavy, ["h"]), ["h", "g", "salt"]).filter(F.struct("doc", "at") != F.col("first"))


def _later_chunks(keyed: DataFrame, held: Column, divisor: int, end: str) -> DataFrame:
    """(doc, at, n) of chunks that stand somewhere before; SHA-256 stands for their bytes."""
    occurs = keyed.select("doc", F.explode(chunks(held, divisor, end)).alias("c")).filter((F.col("c.n") > 1) & _many(F.col("c.text")))
    hashed = occurs.select("doc", F.col("c.at").alias("at"), F.col("c.n").alias("n"), F.xxhash64("c.text").alias("h"), F.unhex(F.sha2("c.text", 256)).alias("g"))
    return _later(materialise(hashed, "chunks"), "chunks").select("doc", "at", "n").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """docs with repeated chunks taken out of text, and a last column line_dedup (or fresh() of that): struct<removed_chunks, removed_lines, lines>."""
    plain = F.coalesce(F.col(text), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(plain).alias("t"), F.xxhash64(plain, F.lit(1)).alias("u")).alias("doc"), whole.alias("row"))
    held = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))

    gone = _later_chunks(keyed, held, divisor, _NEWLINE).groupBy("doc").agg(F.collect_set("at").alias("starts"), F.sum("n").alias("lines"))
    return _rebuilt(keyed.join(gone, "doc", "left"), docs, text, divisor)


def _rebuilt(found: DataFrame, docs: DataFrame, text: str, divisor: int) -> DataFrame:
    left = F.array_join(F.transform(F.filter(chunks(F.col(f"row.`{text}`"), divisor), lambda c: ~F.array_contains("starts", c["at"])), lambda c: c["text"]), _NEWLINE)
    stripped = F.when(F.col("starts").isNull(), F.col(f"row.`{text}`")).otherwise(left)
    columns = [stripped.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    lines = F.when(F.col(f"row.`{text}`").isNull(), 0).otherwise(F.size(F.split(F.col(f"row.`{text}`"), _NEWLINE, -1)))
    told = F.struct(F.coalesce(F.size("starts"), F.lit(0)).alias("removed_chunks"), F.coalesce("lines", F.lit(0).cast("long")).alias("removed_lines"), lines.alias("lines"))
    return found.select(*columns, told.alias(fresh("line_dedup", docs.columns)))


def units(text: Column) -> Column:
    """array<struct<line, text, body, words>>: lines, or their sentences, in order; body has no white space at its end."""
    def unit(line: Column, x: Column) -> Column:
        return F.struct(line.alias("line"), x.alias("text"), F.rtrim(x, F.lit(_SPACES)).alias("body"), F.regexp_count(x, F.lit(WORD)).alias("words"))

    cut = lambda x: F.when(F.regexp_count(x, F.lit(WORD)) > PARAGRAPH, F.split(x, _SENTENCE_END, -1)).otherwise(F.array(x))
    return F.flatten(F.transform(F.split(text, _LINE_END, -1), lambda x, i: F.transform(cut(x), lambda y: unit(i, y))))


def passages(held: Column) -> Column:
    """array<struct<at, n, text>>: for each unit, the fewest units from it on and up to it with LEAST words."""
    def spans(words: Column) -> Column:
        # Every unit but a first blank one has a word. The fold holds 1000 * units + words until these are enough.
        step = lambda a, w: F.when(a % 1000 >= LEAST, a).otherwise(a + 1000 + F.least(w, F.lit(LEAST)))
        fewest = lambda some: let(F.aggregate(some, F.lit(0), step), lambda a: F.when(a % 1000 >= LEAST, (a / 1000).cast("int")))
        on = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.when(w >= LEAST, 1).otherwise(fewest(F.slice(words, i + 1, LEAST + 1))).alias("n")))
        before = lambda i: F.reverse(F.slice(words, F.greatest(i - LEAST, F.lit(0)) + 1, F.least(i, F.lit(LEAST)) + 1))
        up = F.transform(words, lambda w, i: F.when(w < LEAST, let(fewest(before(i)), lambda n: F.when(n.isNotNull(), F.struct((i - n + 1).alias("at"), n.alias("n"))))))
        both = lambda o: F.concat(o, F.filter(up, lambda s: s.isNotNull() & ~F.get(o, s["at"])["n"].eqNullSafe(s["n"])))
        return F.filter(let(on, both), lambda s: s["n"].isNotNull())

    body = lambda u, s: F.array_join(F.transform(F.slice(u, s["at"] + 1, s["n"]), lambda x: x["body"]), _NEWLINE)
    return let(held, lambda u: F.transform(let(F.transform(u, lambda x: x["words"]), spans), lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), body(u, s).alias("text"))))


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int | None = None) -> DataFrame:
    """docs without the passages (with a divisor also the chunks) that stand somewhere before, and a last column line_dedup (or fresh() of that): struct<removed_units, removed_words, units>."""
    plain = F.coalesce(F.col(text), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(plain).alias("t")).alias("doc"), whole.alias("row"))
    held = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    every = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("no")

    # Two independent 64-bit hashes stand for a passage; texts cross the network for the result alone.
    named = lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), F.xxhash64(p["text"]).alias("h"), F.xxhash64(F.lit(1), p["text"]).alias("g"))
    hashed = materialise(keyed.select("doc", F.explode(F.transform(passages(units(held)), named)).alias("p")).select("doc", "p.*"), "passages")
    gone = _later(hashed, "passages").select("doc", every).groupBy("doc").agg(F.collect_set("no").alias("nos"))
    found = keyed.join(gone, "doc", "left")
    if divisor:
        cut = _later_chunks(keyed, held, divisor, _LINE_END).select("doc", every).groupBy("doc").agg(F.collect_set("no").alias("lines"))
        found = found.join(cut, "doc", "left")
    else:
        found = found.withColumn("lines", F.lit(None).cast("array<int>"))

    own, touched = F.col(f"row.`{text}`"), F.col("nos").isNotNull() | F.col("lines").isNotNull()
    has = lambda some, i: F.coalesce(F.array_contains(some, i), F.lit(False))
    out = lambda x, i: has("nos", i) | has("lines", x["line"])
    part = lambda kept: lambda x, i: F.concat(F.when((i > 0) & (x["line"] != F.get(kept, i - 1)["line"]), _NEWLINE).otherwise(""), x["text"])
    # Units are cut again only where some go.
    joined = let(F.filter(units(own), lambda x, i: ~out(x, i)), lambda kept: F.array_join(F.transform(kept, part(kept)), ""))
    columns = [F.when(touched, joined).otherwise(own).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    lost = let(F.filter(units(own), out), lambda u: F.struct(F.size(u).alias("units"), F.aggregate(u, F.lit(0), lambda a, x: a + x["words"]).alias("words")))
    none = F.struct(F.lit(0).alias("units"), F.lit(0).alias("words"))
    told = let(F.when(touched, lost).otherwise(none), lambda x: F.struct(x["units"].alias("removed_units"), x["words"].alias("removed_words"), F.when(own.isNull(), 0).otherwise(F.size(units(own))).alias("units")))
    return found.select(*columns, told.alias(fresh("line_dedup", docs.columns)))
