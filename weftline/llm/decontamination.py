"""Operator 2: benchmark decontamination by templates, with DataFrame functions only.

Canonical form: capitalised words inside a sentence become a name placeholder, numbers a number placeholder, and unit
words behind a number a unit placeholder; arithmetic signs behind a number are tokens; the rest is split at everything
but letters and digits, and lower-cased. Windows of WINDOW template tokens with LITERALS ordinary words or more are hashed. Texts whose windows cover a share of
COVERAGE of an item's windows are candidates; for these alone the values of the slots are read again. Along each
diagonal (text position less item position) the pairs (item value, text value) must be a function from item values to
text values: then the passage is the item, possibly with other parameters. The windows of consistent diagonals must
still reach COVERAGE. An item without such a window, but with EVIDENCE words and signs, has all its windows instead, and
must stand in the text as a whole, along one diagonal.

Names cannot be told in passages in capitals or in small letters, and an item may be short of words and
signs. So a plain form, lower-cased and without placeholders, is compared as well, all of its windows, and the hits are
united. A pair that reached COVERAGE by templates is judged by these, unless the plain form holds every window.

Distribution: the windows of documents meet the benchmark's distinct window hashes by a broadcast join while these are
at most BROADCAST_WINDOWS (counted first), and by a shuffled join beyond; nothing else of the documents is shuffled but
hits, and the texts of candidates.

Defined cases: null texts and items have no tokens and match nothing. An item of fewer than WINDOW tokens is one window
of its own length; by templates it needs LITERALS ordinary words or EVIDENCE words and signs. Repeated items match each. Rows that agree in id and text give
one row for an item. Null ids are returned as null. Extra columns are ignored. Private-use characters U+E000 to U+E007
are dropped from the input, as they stand for placeholders.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, let, materialise

WINDOW, LITERALS, COVERAGE, EVIDENCE = 5, 3, 0.5, 5
BROADCAST_WINDOWS = 500_000
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Signs of arithmetic and the tokens that stand for them.
SIGNS = {"+": "\ue003", "-−": "\ue004", "*×": "\ue005", "/÷": "\ue006", "=": "\ue007"}
_LAST, _SIGN = SIGNS["="], "".join(SIGNS)
UNITS = "km m cm mm mi mile miles ft feet inch inches yards kg g mg lb lbs pounds ounces oz l ml liters litres gallons s sec seconds min minutes h hours days weeks months years percent dollars euros cents usd eur mph kmh degrees celsius fahrenheit watts volts".split()
_NAME = r"(?<=[\p{L}\p{N},;)] )\p{Lu}\p{L}+"
_NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,:/][0-9]+)*"
_UNIT = rf"(?<={NUMBER} {{1,2}})(?i:{'|'.join(UNITS)})(?!\p{{L}})"


def _clean(text: Column) -> Column:
    """text, empty for null, without the placeholders' characters; most texts have none, and a search is cheaper than a copy."""
    held = F.coalesce(text, F.lit(""))
    return F.when(held.rlike(f"[{NAME}-{_LAST}]"), F.regexp_replace(held, f"[{NAME}-{_LAST}]", "")).otherwise(held)


def _numbered(named: Column) -> Column:
    return F.when(named.rlike("[0-9]"), F.regexp_replace(named, _NUMBER, f" {NUMBER} ")).otherwise(named)


def _unit_marked(numbered: Column) -> Column:
    return F.when(F.contains(numbered, F.lit(NUMBER)), F.regexp_replace(numbered, _UNIT, UNIT)).otherwise(numbered)


def _signed(marked: Column) -> Column:
    """Signs behind a number or unit become tokens; few texts have any."""
    def each(c: Column) -> Column:
        for signs, token in SIGNS.items():
            c = F.regexp_replace(c, rf"(?<=[{NUMBER}{UNIT}] {{0,2}})[{re.escape(signs)}]", f" {token} ")
        return c

    return F.when(marked.rlike(rf"[{NUMBER}{UNIT}] {{0,2}}[{re.escape(_SIGN)}]"), each(marked)).otherwise(marked)


def _split(text: Column, pattern: str) -> Column:
    """The parts between matches; only the first and the last can be empty, and go."""
    def inner(t: Column) -> Column:
        first = F.when(F.get(t, 0) == "", 2).otherwise(1)
        last = F.size(t) - F.when(F.get(t, F.size(t) - 1) == "", 1).otherwise(0)
        return F.slice(t, first, F.greatest(last - first + 1, F.lit(0)))

    return let(F.split(F.lower(text), pattern), inner)


def tokens(text: Column, plain: bool = False) -> Column:
    """The template tokens of a text, or its plain ones."""
    if plain:
        return _split(_clean(text), r"[^\p{L}\p{N}]+")
    marked = let(F.regexp_replace(_clean(text), _NAME, NAME), lambda named: let(let(_numbered(named), _unit_marked), _signed))
    return _split(marked, rf"[^\p{{L}}\p{{N}}{NAME}-{_LAST}]+")


def slots(text: Column, plain: bool = False) -> Column:
    """array<array<string>>: in order, the values of the name, number and unit placeholders, of which plain tokens have none."""
    if plain:
        return F.array(*[F.array().cast("array<string>")] * 3)
    plain = _clean(text)
    named = F.regexp_replace(plain, _NAME, NAME)
    numbered = _numbered(named)
    found = lambda c, pattern: F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.lower)
    return F.array(found(plain, _NAME), found(named, _NUMBER), found(numbered, _UNIT))


def windows(held: Column, length: int) -> Column:
    """The hashes of all windows of length tokens."""
    def of(t: Column) -> Column:
        return F.when(F.size(t) >= length, F.transform(F.sequence(F.lit(1), F.size(t) - length + 1), lambda i: F.xxhash64(F.slice(t, i, length)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(held, lambda w: F.xxhash64(w)), of)


def window_rows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows without tokens and with h: a row for each window of each of lengths, hashed as windows() does.

    Shifted arrays are zipped and exploded, so that windows are hashed in generated code; the hash of an array is that of
    its elements as columns.
    """
    rest = [c for c in rows.columns if c != "tokens"]
    each = rows.select(*rest, F.transform("tokens", lambda w: F.xxhash64(w)).alias("e"))
    last = F.greatest(F.size("e"), F.lit(1))
    shifted = each.select(*rest, *[F.slice("e", i + 1, last).alias(f"w{i}") for i in range(max(lengths))])
    places = shifted.select(*rest, F.explode(F.arrays_zip(*[f"w{i}" for i in range(max(lengths))])).alias("w"))
    ends = lambda n: F.when(F.col(f"w.w{n - 1}").isNotNull(), F.xxhash64(*[F.col(f"w.w{i}") for i in range(n)]))
    if len(lengths) == 1:
        return places.select(*rest, ends(lengths[0]).alias("h")).filter("h is not null")
    return places.select(*rest, F.explode(F.array(*map(ends, lengths))).alias("h")).filter("h is not null")


def _placed(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, at, kind and value of each slot of rows (keys, tokens, slots): the n-th placeholder has the n-th value."""
    marks = [NAME, NUMBER, UNIT]
    found = rows.select(*keys, "slots", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.filter(F.transform("tokens", lambda t, i: F.when(t == m, i)), lambda x: x.isNotNull()).alias("at")) for k, m in enumerate(marks)])).alias("s"))
    found = found.select(*keys, F.col("s.kind").alias("kind"), F.get("slots", F.col("s.kind")).alias("values"), F.posexplode("s.at").alias("n", at))
    return found.select(*keys, at, "kind", F.get("values", F.col("n")).alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, window: int = WINDOW) -> DataFrame:
    """(key, item, windows, matched, coverage, slots, changed, verbatim, text_hash) for each text that holds an item.

    text_hash is xxhash64 of the text (empty for null), by which rows without an id can be told apart.
    """
    args = (docs, benchmark, key, text, item, item_text, coverage, window)
    found, candidates = _leaks(*args, False)
    more, _ = _leaks(*args, True)
    if candidates is None:
        return more
    found, more = materialise(found, "template-leaks"), materialise(more, "plain-leaks")
    found = found.withColumn(fresh("plain", [key, item]), F.lit(False))
    more = more.withColumn(found.columns[-1], F.lit(True))
    held = candidates.select(F.col("c_id").alias("__id"), F.col("t").alias("__t"), F.col("item").alias("__item"))
    pair = F.col(key).eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__t")) & (F.col(item) == F.col("__item"))
    part = more.filter("matched < windows").join(held, pair, "left_anti")
    rows = found.unionByName(more.filter("matched = windows")).unionByName(part)
    best = rows.groupBy(key, item, "text_hash").agg(F.min_by(F.struct(*[c for c in found.columns if c not in (key, item, "text_hash")]), found.columns[-1]).alias("__row"))
    return best.select(key, item, "__row.*", "text_hash").select(*found.columns[:-1])


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, coverage: float, window: int, plain: bool) -> tuple[DataFrame, DataFrame | None]:
    """Hits by one form, and the candidates (c_id, t, item) before their slots were read; None without items."""
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text), plain).alias("tokens"), slots(F.col(item_text), plain).alias("slots")).filter(F.size("tokens") > 0)
    # Items and their windows are read many times below: as tables they keep the plans, and the driver, small.
    items = materialise(items.withColumn("length", F.least(F.size("tokens"), F.lit(window))), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # as many as a window has tokens at most
    if not lengths:
        return docs.limit(0).select(F.col(key), *(F.lit(None).cast(t).alias(c) for c, t in ((item, benchmark.schema[item].dataType), ("windows", "long"), ("matched", "long"), ("coverage", "double"), ("slots", "long"), ("changed", "long"), ("verbatim", "boolean"), ("text_hash", "long")))), None
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("length") + 1), lambda i: F.slice("tokens", i, F.col("length")))).alias("at", "tokens")
    parts = items.select("item", "length", at)
    ordinary = F.size(F.filter("tokens", lambda t: ~t.isin(NAME, NUMBER, UNIT, *SIGNS.values())))
    shown = F.size(F.filter("tokens", lambda t: ~t.isin(NAME, NUMBER, UNIT)))
    wordy = ordinary >= F.least(F.lit(LITERALS), F.col("length"))
    # An item has its wordy windows; without any it has all of them, and only as a whole.
    rich = items.select("item", (shown >= EVIDENCE).alias("rich")).groupBy("item").agg(F.bool_or("rich").alias("rich"))
    marked = parts.withColumns({"h": F.xxhash64(F.transform("tokens", lambda w: F.xxhash64(w))), "wordy": wordy}).withColumn("whole", ~F.bool_or("wordy").over(Window.partitionBy("item")))
    parts = materialise(marked.join(rich, "item").filter(F.col("wordy") | (F.col("whole") & F.col("rich"))).select("item", "length", "at", "h", "whole"), "item-windows")
    totals = parts.groupBy("item").agg(F.countDistinct("at").alias("total"), F.bool_or("whole").alias("whole"))
    enough = F.col("total") * F.when(F.col("whole"), 1.0).otherwise(coverage)
    hashes = parts.select("h").distinct()
    if hashes.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)

    keyed = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    tokened = keyed.select("id", "t", tokens(F.col("text"), plain).alias("tokens"))
    hits = window_rows(tokened, lengths).join(hashes, "h").distinct()
    met = hits.join(parts.select("h", "item", "at"), "h").groupBy("id", "t", "item").agg(F.countDistinct("at").alias("n"))
    candidates = met.join(totals, "item").filter(F.col("n") >= enough).select(F.col("id").alias("c_id"), "t", "item")

    candidates = materialise(candidates, "candidates")

    # The texts of candidates alone are read again, with positions and values.
    chosen = candidates.select("c_id", "t").distinct()
    same = keyed["id"].eqNullSafe(chosen["c_id"]) & (keyed["t"] == chosen["t"])
    read = keyed.join(chosen, same, "left_semi").dropDuplicates(["id", "t"]).select(F.xxhash64("id", "t").alias("doc"), "id", "t", tokens(F.col("text"), plain).alias("tokens"), slots(F.col("text"), plain).alias("slots"))
    asked = candidates.select(F.xxhash64("c_id", "t").alias("doc"), "item").join(parts.drop("whole"), "item")
    spots = None
    for n in lengths:
        one = read.select("doc", F.posexplode(windows(F.col("tokens"), n)).alias("pos", "h")).withColumn("length", F.lit(n))
        spots = one if spots is None else spots.union(one)
    found = asked.join(spots, ["doc", "h", "length"]).select("doc", "item", "at", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
    covered = found.select("doc", "item", "diagonal", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("ipos")).distinct()
    theirs = _placed(items.select("item", "tokens", "slots"), ["item"], "ipos").withColumnRenamed("value", "expected")
    ours = _placed(read, ["doc"], "pos")
    pairs = covered.join(theirs, ["item", "ipos"]).withColumn("pos", F.col("ipos") + F.col("diagonal")).join(ours, ["doc", "pos", "kind"])
    judged = pairs.groupBy("doc", "item", "diagonal").agg(
        F.count("*").alias("slots"), F.sum(F.when(F.col("expected") != F.col("value"), 1).otherwise(0)).alias("changed"),
        F.countDistinct("kind", "expected").alias("given"), F.countDistinct("kind", "expected", "value").alias("read"),
    )
    # A passage whose slots contradict each other is another text in the same template.
    kept = found.join(judged, ["doc", "item", "diagonal"], "left").filter("given is null or given = read")
    along = kept.groupBy("doc", "item", "diagonal").agg(F.collect_set("at").alias("ats"), F.max(F.coalesce("slots", F.lit(0))).alias("slots"), F.min(F.coalesce("changed", F.lit(0))).alias("changed"))
    out = along.groupBy("doc", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"), F.max(F.size("ats")).alias("longest"), F.max("slots").alias("slots"), F.min("changed").alias("changed"))
    out = out.join(totals, "item").filter(F.when(F.col("whole"), F.col("longest")).otherwise(F.col("matched")) >= enough).join(read.select("doc", "id", "t"), "doc")
    return out.select(F.col("id").alias(key), F.col("item").alias(item), F.col("total").alias("windows"), "matched", F.round(F.col("matched") / F.col("total"), 6).alias("coverage"), "slots", "changed", (F.col("changed") == 0).alias("verbatim"), F.col("t").alias("text_hash")), candidates
