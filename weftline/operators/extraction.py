"""PRJ10-PRJ14, AGG1, JN1, FLT5, FLT6, WIN2, WIN6: model responses to graph candidates of a chunk."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import candidate_id, edge_key, node_key
from ..functions.text import SPACE, strip

#: The end mark of a complete response, and the codes of broken ones.
MARKER = "---COMPLETE---"
INCOMPLETE, INVALID_JSON, INVALID_SCHEMA = "EXTRACTION_RESPONSE_INCOMPLETE", "EXTRACTION_RESPONSE_INVALID_JSON", "EXTRACTION_RESPONSE_INVALID_SCHEMA"
_NODE, _EDGE = ("display_name", "description"), ("source_display_name", "target_display_name", "description")


def json_body(response: Column) -> Column:
    """PRJ12: what should be the JSON object: the lines within a fence, else the first { to the last }, else all."""
    before = strip(F.substring(response, F.lit(1), F.instr(response, MARKER) - 1))
    inner = F.regexp_replace(F.regexp_replace(before, r"^```[^\n]*\n?", ""), rf"(^|\n)[{SPACE}]*```$", "")
    braces = F.regexp_extract(before, r"(?s)\{.*\}", 0)
    return F.when(F.startswith(before, F.lit("```")), strip(inner)).when(braces != "", braces).otherwise(before)


def _of_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def json_value(text: Column) -> Column:
    """SC20: the variant of a text that is one JSON value and nothing else, or null.

    The parser stops behind the first value; as the first of two in an array, a value with a tail loses the second.
    """
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]'))), "$", "array<variant>")
    whole = (F.size(pair) == 2) & F.coalesce(F.try_variant_get(F.get(pair, 1), "$", "string") == "end", F.lit(False))
    return F.when(whole, F.get(pair, 0))


def _all_typed(items: Column, fields: tuple[str, ...]) -> Column:
    """PRJ13, PRJ14: every item is an object whose fields are strings, neither coerced nor missing."""
    good = lambda e: F.when(_of_kind(e, "OBJECT"), F.least(*[_of_kind(F.try_variant_get(e, f"$.{f}", "variant"), "STRING") for f in fields])).otherwise(False)
    return F.coalesce(F.forall(items, good), F.lit(False))


def parse(responses: DataFrame, response: str = "response") -> DataFrame:
    """PRJ12-PRJ14: responses with error (null if good), nodes and edges; strength stays a variant.

    Any wrong item fails the whole response. The session needs spark.sql.variant.allowDuplicateKeys for repeated keys.
    """
    text = F.coalesce(F.col(response), F.lit(""))
    rows = responses.withColumn("__whole", F.contains(text, F.lit(MARKER))).withColumn("__json", json_value(F.when(F.col("__whole"), json_body(text))))
    rows = rows.withColumn("__nodes", F.try_variant_get("__json", "$.nodes", "array<variant>")).withColumn("__edges", F.try_variant_get("__json", "$.edges", "array<variant>"))
    error = (
        F.when(~F.col("__whole"), INCOMPLETE).when(F.col("__json").isNull(), INVALID_JSON).when(~_of_kind(F.col("__json"), "OBJECT"), INVALID_SCHEMA)
        .when(~_all_typed(F.col("__nodes"), _NODE) | ~_all_typed(F.col("__edges"), _EDGE), INVALID_SCHEMA)
    )
    get = lambda e, f, t: F.try_variant_get(e, f"$.{f}", t)
    nodes = F.transform("__nodes", lambda e: F.struct(*[get(e, f, "string").alias(f) for f in _NODE]))
    edges = F.transform("__edges", lambda e: F.struct(*[get(e, f, "string").alias(f) for f in _EDGE], whole_strength(get(e, "strength", "variant")).alias("strength")))
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    return rows.withColumn("nodes", F.when(good, nodes)).withColumn("edges", F.when(good, edges)).drop("__whole", "__json", "__nodes", "__edges")


def _no_constant(name: str):
    raise ValueError(name)


def response_value(response: str) -> tuple[dict | None, str | None]:
    """PRJ12-PRJ14 for one response where it is received, before its attempt is judged: its object, or what is wrong with it."""
    before, mark, _ = response.partition(MARKER)
    if not mark:
        return None, INCOMPLETE
    body = before.strip()
    if body.startswith("```"):
        lines = body.split("\n")[1:]
        body = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines).strip()
    elif -1 < body.find("{") < body.rfind("}"):
        body = body[body.find("{") : body.rfind("}") + 1]
    try:
        value = json.loads(body, parse_constant=_no_constant)
    except ValueError:
        return None, INVALID_JSON
    lists = [(value.get("nodes"), _NODE), (value.get("edges"), _EDGE)] if isinstance(value, dict) else [(None, ())]
    good = all(isinstance(items, list) and all(isinstance(x, dict) and all(isinstance(x.get(f), str) for f in fields) for x in items) for items, fields in lists)
    return (value, None) if good else (None, INVALID_SCHEMA)


def whole_strength(value: Column) -> Column:
    """FLT5: the integer from 1 to 10 in a variant, or null; booleans, decimals and strings are none."""
    number = F.when(_of_kind(value, "BIGINT"), F.try_variant_get(value, "$", "bigint"))
    return F.when(number.between(1, 10), number.cast("int"))


def merge_nodes(raw: DataFrame, keys: list[str], world: Column, run: Column, book: Column, chunk: Column) -> DataFrame:
    """AGG1: (keys, display_name, description, first_seq, node_id) of raw nodes (keys, seq, display_name, description).

    Names merge exactly, within their chunk; different descriptions are joined in order of first sight. Both aggregates
    combine before they are shuffled, and the second reuses the first's partitioning by keys.
    """
    clean = raw.select(*keys, "seq", strip(F.col("display_name")).alias("display_name"), strip(F.col("description")).alias("description")).filter("display_name <> '' and description <> ''")
    first = clean.groupBy(*keys, "display_name", "description").agg(F.min("seq").alias("seq"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda s: s["description"])
    merged = first.groupBy(*keys, "display_name").agg(F.array_join(texts, "\n\n").alias("description"), F.min("seq").alias("first_seq"))
    return merged.withColumn("node_id", candidate_id(world, run, book, chunk, node_key(F.col("display_name"))))


def merge_edges(raw: DataFrame, nodes: DataFrame, keys: list[str], world: Column, run: Column, book: Column, chunk: Column) -> DataFrame:
    """JN1, FLT5, WIN2: valid edges of all passes of a chunk, numbered in order, with ids and endpoint ids.

    Endpoints are looked up among the nodes of all passes, so a later pass can rescue an early edge. Equal edges stay.
    """
    named = lambda side: nodes.select(*keys, F.col("display_name").alias(f"{side}_display_name"), F.col("node_id").alias(f"{side}_node_id"))
    clean = raw.select(*keys, "seq", *[strip(F.col(c)).alias(c) for c in _EDGE], "strength").filter("strength between 1 and 10 and description <> ''")
    found = clean.join(named("source"), [*keys, "source_display_name"]).join(named("target"), [*keys, "target_display_name"])
    found = found.withColumn("edge_number", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    key = edge_key(F.col("edge_number"), F.col("source_display_name"), F.col("target_display_name"), F.col("description"), F.col("strength"))
    return found.withColumn("edge_id", candidate_id(world, run, book, chunk, key))


def initial_prompt(instructions: str, chunk_text: Column, overlap: Column) -> Column:
    """PRJ10: instructions, context and chunk, under headings, separated by blank lines; blank context is (none)."""
    shown = F.coalesce(F.nullif(strip(F.coalesce(overlap, F.lit(""))), F.lit("")), F.lit("(none)"))
    return F.concat_ws("\n\n", F.lit(instructions.strip()), F.lit("### Context before the chunk (reference only)"), shown, F.lit("### Chunk"), chunk_text)


def pass_prompt(instructions: str, text: str, overlap: str, earlier: list[str]) -> str:
    """PRJ10, PRJ11 for one chunk: the initial form, and for a glean what is known: earlier passes, merged nodes and edges."""
    parts = [instructions.strip(), "### Context before the chunk (reference only)", overlap.strip() or "(none)", "### Chunk", text]
    if earlier:
        known = [response_value(r)[0] or {} for r in earlier]
        nodes: dict[str, list[str]] = {}
        for x in (x for v in known for x in v.get("nodes", [])):
            said = nodes.setdefault(x["display_name"].strip(), [])
            if x["description"].strip() not in said:
                said.append(x["description"].strip())
        edges = [f"- {x['source_display_name'].strip()} -> {x['target_display_name'].strip()}: {x['description'].strip()} (strength {x.get('strength')})" for v in known for x in v.get("edges", [])]
        named = [f"- {name}: {' '.join(said)}" for name, said in nodes.items()]
        parts += ["### Earlier passes", *earlier, "### Known nodes", "\n".join(named) or "(none)", "### Known edges", "\n".join(edges) or "(none)"]
    return "\n\n".join(parts)
