"""Identities that must match byte for byte: hashes, name-based UUIDs, file and collection names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    """SC7: lower-case hex digest of the text's UTF-8 bytes."""
    return F.sha2(text, 256)


def uuid5(namespace: Column, name: Column) -> Column:
    """SC8: the name-based UUID (version 5) of name in a namespace given as UUID text."""
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_point_id(world: Column, book: Column, chunk: Column) -> Column:
    return uuid5(world, F.format_string("book:%d:chunk:%d", book, chunk))


def candidate_id(world: Column, run: Column, book: Column, chunk: Column, key: Column) -> Column:
    """Deterministic if every part is there; a random id otherwise."""
    name = F.concat(F.lit("graph-candidate:"), run, F.lit(":book:"), book.cast("string"), F.lit(":chunk:"), chunk.cast("string"), F.lit(":"), key)
    return F.coalesce(uuid5(F.nullif(world, F.lit("")), name), F.uuid())


def node_key(name: Column) -> Column:
    return F.concat(F.lit("node:"), name)


def edge_key(index: Column, source: Column, target: Column, description: Column, strength: Column) -> Column:
    return F.concat(F.lit("edge:"), F.concat_ws(":", index.cast("string"), source, target, description, strength.cast("string")))


def node_point_id(world: Column, run: Column, book: Column, node: Column) -> Column:
    return uuid5(world, F.concat(F.lit("graph-node:"), run, F.lit(":book:"), book.cast("string"), F.lit(":node:"), node))


def node_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit("\n\n"), description)


def chunk_filename(book: Column, chunk: Column) -> Column:
    """SC11: zero-padded, never cut."""
    return F.format_string("book_%02d_chunk_%04d.json", book, chunk)


def _quoted(c: Column) -> Column:
    """A JSON string as an ASCII-only writer would put it, for values of printable ASCII."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def profile_key(provider: Column, model: Column, dimensions: Column, task: Column, version: Column) -> Column:
    """SC17: 16 hex digits over the compact JSON of five fields with sorted keys."""
    json = F.concat(
        F.lit('{"dimensions":'), dimensions.cast("string"), F.lit(',"model_id":'), _quoted(model), F.lit(',"profile_version":'), version.cast("string"),
        F.lit(',"provider_id":'), _quoted(provider), F.lit(',"task_type":'), _quoted(task), F.lit("}"),
    )
    return F.substring(F.sha2(json, 256), 1, 16)


def collection_name(kind: str, provider: Column, model: Column, dimensions: Column, task: Column, version: Column) -> Column:
    """SC17: kind is chunks or nodes."""
    base = F.lower(F.concat(F.lit(f"{kind}_"), provider, F.lit("_"), model, F.lit("_"), dimensions.cast("string"), F.lit("_"), task, F.lit("_v"), version.cast("string")))
    safe = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.concat(F.substring(safe, 1, 64), F.lit("_"), profile_key(provider, model, dimensions, task, version))
