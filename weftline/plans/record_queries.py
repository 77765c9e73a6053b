"""Queries over records: models, profiles, stored states, uploads, slots, times, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status, text
from ..operators import chunking, manifestation, worlds
from ..sources import models, stored
from .registry import query, table


@query("model_lookup", """
        WITH m AS (SELECT 'm' || (p_partkey % 500) AS model_id, arg_min(p_name, p_partkey) AS call_name FROM part GROUP BY 1)
        SELECT l_orderkey, l_linenumber, call_name FROM lineitem LEFT JOIN m ON model_id = 'm' || (l_partkey % 700)""")
def model_lookup(spark, sf_dir):
    """EP10: parts as models, of which several have one id; the first is meant, and some ids are of none."""
    held = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 500).cast("string")).alias("model_id"), F.col("p_partkey").alias("place"), F.col("p_name").alias("call_name"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), (F.col("l_partkey") % 700).cast("string")).alias("model_id"))
    return asked.join(models.first_models(held), "model_id", "left").select("l_orderkey", "l_linenumber", "call_name")


@query("profile_lock", """
        WITH m AS (SELECT 'm' || p_partkey AS model_id, p_partkey % 3 <> 0 AS able, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 64 END AS dims, 1000 + p_size AS tokens FROM part),
        j AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS held, dims, tokens, CASE WHEN NOT coalesce(able, false) THEN 'UNSUPPORTED_EMBEDDING_MODEL' WHEN dims IS NULL THEN 'EMBEDDING_MODEL_CONTRACT_INCOMPLETE' END AS error
              FROM lineitem LEFT JOIN m ON model_id = 'm' || (l_partkey + 5))
        SELECT l_orderkey, l_linenumber, CASE WHEN error IS NULL THEN 'parts' ELSE 'own' END AS provider_id, CASE WHEN error IS NULL THEN dims ELSE held END AS dimensions,
               CASE WHEN error IS NULL THEN tokens ELSE 7 END AS max_input_tokens, l_linenumber AS batch, error FROM j""")
def profile_lock(spark, sf_dir):
    """PRJ19: parts as models, lines as profiles; some models cannot embed, lack a limit or are unknown."""
    k = F.col("p_partkey")
    limits = F.map_filter(F.create_map(F.lit("maxInputTokens"), F.lit(1000) + F.col("p_size"), F.lit("maxEmbeddingDimensions"), F.when(k % 7 != 0, F.col("p_size") * 64)), lambda _, v: v.isNotNull())
    surfaces = F.when(k % 3 == 0, F.array(F.lit("chat"))).otherwise(F.array(F.lit("chat"), F.lit("embedding")))
    held = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("model_id"), F.lit("parts").alias("provider_id"), surfaces.alias("surfaces"), limits.alias("limits"))
    extra = F.create_map(F.lit("max_input_tokens"), F.lit(7), F.lit("batch"), F.col("l_linenumber"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), (F.col("l_partkey") + 5).cast("string")).alias("model_id"), F.lit("own").alias("provider_id"), F.col("l_quantity").cast("int").alias("dimensions"), extra.alias("extra_settings"))
    found = models.locked_profiles(asked, held)
    setting = lambda name: F.try_element_at("extra_settings", F.lit(name)).alias(name)
    return found.select("l_orderkey", "l_linenumber", "provider_id", "dimensions", setting("max_input_tokens"), setting("batch"), "error")


_SAID = ["REQUESTS_PER_DAY of the project", "TPM of this api key", "too many requests", "quota of project, PER DAY"]


@query("runtime_states", f"""
        WITH f AS (SELECT event_id, ts, CASE WHEN user_id % 4 = 0 THEN 'p' || (user_id % 6) END AS project_id, 'c' || user_id AS credential_name, 'm' || (event_id % 2) AS model, ({_SAID!r})[(event_id % 4 + 1)::INT] AS message, CASE WHEN event_id % 5 <> 0 THEN event_id % 90 END AS retry_after FROM events WHERE event_id % 3 <> 0),
        g AS (SELECT *, upper(message) AS u, CASE WHEN project_id IS NULL THEN 'local:credential:' || credential_name ELSE 'local:project:' || project_id END AS quota_scope FROM f),
        h AS (SELECT *, CASE WHEN contains(u, 'PER_DAY') OR contains(u, 'PER DAY') THEN 'rpd' WHEN contains(u, 'TPM') THEN 'tpm' ELSE 'rpm' END AS kind, CASE WHEN contains(u, 'PROJECT') THEN 'project' WHEN contains(u, 'API KEY') THEN 'credential' ELSE 'model' END AS limit_scope FROM g),
        k AS (SELECT *, quota_scope || CASE WHEN limit_scope = 'model' THEN ':model:' || model ELSE ':all-models' END AS scope_key FROM h)
        SELECT scope_key, arg_max(kind, (ts, event_id)) AS last_limit_type, arg_max(limit_scope, (ts, event_id)) AS limit_scope, arg_max(credential_name, (ts, event_id)) AS credential_name,
               arg_max(message, (ts, event_id)) AS last_error_message, epoch_us(max_by(CASE WHEN kind <> 'rpd' THEN ts + to_seconds(coalesce(retry_after, 60)) ELSE TIMESTAMP '1970-01-01' END, (ts, event_id))) AS cooldown_us FROM k GROUP BY 1""")
def runtime_states(spark, sf_dir):
    """SRC14, SC13, SC16: two of three events as rate limits of their users' credentials; a bucket's last one counts."""
    u, e = F.col("user_id"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.lit("local").alias("provider_id"), F.when(u % 4 == 0, F.concat(F.lit("p"), (u % 6).cast("string"))).alias("project_id"), F.concat(F.lit("c"), u.cast("string")).alias("credential_name"),
        F.concat(F.lit("m"), (e % 2).cast("string")).alias("model"), F.when(e % 3 != 0, 429).otherwise(500).alias("code"), F.element_at(F.array(*map(F.lit, _SAID)), (e % 4 + 1).cast("int")).alias("message"), F.when(e % 5 != 0, (e % 90).cast("int")).alias("retry_after"),
    )
    found = models.cooled(rows, "model", "ts", ["ts", "event_id"])
    return found.select("scope_key", "last_limit_type", "limit_scope", "credential_name", "last_error_message", F.coalesce(F.unix_micros(F.col("cooldown_until").cast("timestamp")), F.lit(0)).alias("cooldown_us"))


@query("stored_slots", """
        SELECT n_regionkey AS slot, min(n_name) AS name, count(*) > 1 AS ambiguous FROM nation WHERE n_regionkey > 0 OR n_nationkey = 0 GROUP BY 1""")
def stored_slots(spark, sf_dir):
    """SRC10: regions as slots and nations as their files; one slot has a single file."""
    rows = table(spark, sf_dir, "nation").filter("n_regionkey > 0 or n_nationkey = 0").select(F.col("n_regionkey").alias("slot"), F.col("n_name").alias("name"))
    return stored.stored_slots(rows, "slot", "name")


@query("slot_directories", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN len((o_orderkey % 1000)::VARCHAR) > 1 THEN (o_orderkey % 1000)::INT END WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 1000)::INT END AS slot FROM orders")
def slot_directories(spark, sf_dir):
    """FLT16: plain, padded, suffixed and foreign directory names."""
    k = F.col("o_orderkey") % 1000
    plain, padded = F.concat(F.lit("book_"), k.cast("string")), F.format_string("book_%02d", k)
    name = F.when(F.col("o_orderkey") % 4 == 0, plain).when(F.col("o_orderkey") % 4 == 1, padded).when(F.col("o_orderkey") % 4 == 2, F.concat(padded, F.lit("b"))).otherwise(F.concat(F.lit("a"), padded))
    return table(spark, sf_dir, "orders").select("o_orderkey", stored.slot_number(name).alias("slot"))


@query("vector_dimensions", "SELECT l_orderkey, l_linenumber, 'VECTOR_COLLECTION_MISMATCH' AS error FROM lineitem WHERE l_linenumber <> 3 OR l_orderkey % 10 = 0")
def vector_dimensions(spark, sf_dir):
    """SNK9: vectors of as many dimensions as a line's number, some of them missing, for a collection of three."""
    vector = F.when(F.col("l_orderkey") % 10 != 0, F.array_repeat(F.lit(1.0), F.col("l_linenumber")))
    return stored.dimension_error(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vector.alias("v")), "v", 3).select("l_orderkey", "l_linenumber", "error")


@query("world_titles", """
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' x' ELSE 'dir-' || c_custkey END AS title FROM customer""")
def world_titles(spark, sf_dir):
    """PRJ16: a name, else the title that the interface saved, else the directory; blank ones are none."""
    k = F.col("c_custkey")
    name, saved = F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit("\t"))).when(k % 3 == 1, "  "), F.when(k % 3 == 1, F.concat("c_mktsegment", F.lit("\n x "))).when(k % 2 == 0, "")
    return table(spark, sf_dir, "customer").select(k, worlds.world_title(name, saved, F.concat(F.lit("dir-"), k.cast("string"))).alias("title"))


@query("pending_skeleton", "SELECT 'w' AS world_uuid, (doc_id % 50)::INT AS book_number, doc_id AS chunk_number, 'f' || doc_id AS chunk_file, sha256(text) AS text_hash, 'pending' AS status, 0 AS retry_count FROM documents")
def pending_skeleton(spark, sf_dir):
    """PRJ4: documents as chunk records."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.lit("w").alias("world_uuid"), (d % 50).cast("int").alias("book_number"), d.alias("chunk_number"), F.concat(F.lit("f"), d.cast("string")).alias("chunk_file"), F.sha2("text", 256).alias("text_hash"))
    return chunking.pending_states(rows, "text_hash")


@query("asset_names", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey")
def asset_names(spark, sf_dir):
    """TOP7: a shelf of assets in order of their names."""
    return worlds.by_name(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "p_name")


@query("utc_times", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN epoch_us(date_trunc('second', ts)) END AS micros FROM events")
def utc_times(spark, sf_dir):
    """SC12: a time in ISO form with no zone, as Zulu time, with an offset, and broken."""
    k, at = F.col("event_id") % 4, F.date_trunc("second", "ts")
    plain = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    said = F.when(k == 0, plain).when(k == 1, F.concat(plain, F.lit("Z"))).when(k == 2, ahead).otherwise(F.concat(F.lit("on "), plain))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(status.utc_timestamp(said).cast("timestamp")).alias("micros"))


_CLASSES = ["ServiceUnavailable", "TransientError", "OSError", "ConnectionError", "ClientError", "ValueError"]


@query("graph_errors", "SELECT event_id, CASE WHEN event_id % 7 < 4 THEN 'NEO4J_UNAVAILABLE' ELSE 'NEO4J_WRITE_FAILED' END AS code FROM events")
def graph_errors(spark, sf_dir):
    """SC21: events as failed writes of six known classes and one without a class."""
    kind = F.try_element_at(F.array(*map(F.lit, _CLASSES)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", status.graph_error(kind).alias("code"))


@query("upload_checks", """
        WITH a AS (SELECT p_partkey AS k, ['.png', '.JPG', '.webp', '.ttf', '.gif'][(p_partkey % 5 + 1)::INT] AS suffix, CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'font' END AS kind, p_partkey % 11 = 0 AS empty, p_partkey % 3 = 0 AS good FROM part)
        SELECT k AS p_partkey, CASE WHEN suffix = '.gif' OR (kind = 'image') = (suffix = '.ttf') THEN 'ASSET_TYPE_UNSUPPORTED' WHEN empty THEN 'ASSET_EMPTY' WHEN kind = 'image' AND NOT (good AND suffix = '.png') THEN 'IMAGE_SIGNATURE_INVALID' END AS error,
               CASE suffix WHEN '.png' THEN 'image/png' WHEN '.JPG' THEN 'image/jpeg' WHEN '.webp' THEN 'image/webp' WHEN '.ttf' THEN 'font/ttf' END AS content_type, 'my part ' || k AS name FROM a""")
def upload_checks(spark, sf_dir):
    """FLT14, SC6, SC18, SC19: parts as uploads, of which a third begin as PNG files do."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("C:\\in\\ my  part "), k.cast("string"), F.element_at(F.array(*map(F.lit, [".png", ".JPG", ".webp", ".ttf", ".gif"])), (k % 5 + 1).cast("int")))
    content = F.when(k % 11 == 0, F.unhex(F.lit(""))).when(k % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.col("p_name").cast("binary"))
    rows = table(spark, sf_dir, "part").select(k, name.alias("file"), content.alias("content"), F.when(k % 2 == 0, "image").otherwise("font").alias("kind"))
    suffix = text.suffix(F.col("file"))
    return rows.select(k, status.asset_error(F.col("content"), suffix, F.col("kind")).alias("error"), status.content_type(suffix).alias("content_type"), text.display_filename(F.col("file")).alias("name"))


@query("safe_assets", "SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 5 = 0 AND o_orderkey % 9 <> 0 AS safe FROM orders")
def safe_assets(spark, sf_dir):
    """FLT15: orders as asset records of known, unknown and no kind, with bare and other file names, some without an id."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 < 2, "image").when(k % 4 == 2, "font").when(k % 8 == 3, "sound")
    file = F.element_at(F.array(*map(F.lit, ["a.png", "../a.png", "b\\a.png", "..", ""])), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, status.safe_record(kind, F.when(k % 9 == 0, "").otherwise(k.cast("string")), file).alias("safe"))


@query("book_totals", """
        SELECT coalesce(a.book, b.book) AS book, coalesce(n, 0) AS nodes, coalesce(e, 0) AS edges FROM (SELECT doc_id % 50 AS book, count(*) AS n FROM documents GROUP BY 1) a
        FULL JOIN (SELECT l_orderkey % 60 AS book, count(*) AS e FROM lineitem GROUP BY 1) b ON a.book = b.book""")
def book_totals(spark, sf_dir):
    """AGG5: documents as nodes, lines as edges; some books have edges alone."""
    nodes, edges = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("book")), table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 60).alias("book"))
    return manifestation.book_totals(nodes, edges, "book")


@query("chunk_numbers", "SELECT c_nationkey AS book_number, c_custkey % 100 AS chunk_number FROM customer UNION SELECT (o_custkey % 25)::INT, o_orderkey % 120 FROM orders")
def chunk_numbers(spark, sf_dir):
    """SET2: customers as nodes, orders as edges."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book_number"), (F.col("c_custkey") % 100).alias("chunk_number"))
    edges = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("book_number"), (F.col("o_orderkey") % 120).alias("chunk_number"))
    return manifestation.chunk_numbers(nodes, edges, ["book_number", "chunk_number"])


class _Sink:
    """A graph sink that takes its rows, refuses them, or is away."""

    def __init__(self, kind: str):
        self.kind = kind

    def write_nodes(self, rows) -> None:
        if self.kind == "away":
            raise manifestation.GraphStoreUnavailable(self.kind)
        if self.kind == "refusing":
            raise ValueError(self.kind)
        rows.write.format("noop").mode("overwrite").save()


@query("write_outcomes", """
        WITH s AS (SELECT c_custkey, c_custkey % 3 = 0 AS embedded, CASE WHEN c_custkey % 5 = 0 THEN 'written' ELSE 'pending' END AS w, (c_custkey % 4)::INT AS n FROM customer)
        SELECT sink, c_custkey, CASE WHEN embedded AND w = 'pending' AND sink = 'taking' THEN 'written' WHEN embedded AND w = 'pending' AND sink = 'refusing' AND n + 1 >= 3 THEN 'failed' ELSE w END AS write_status,
               n + CASE WHEN embedded AND w = 'pending' AND sink = 'refusing' THEN 1 ELSE 0 END AS retry_count FROM s, (VALUES ('taking'), ('refusing'), ('away')) t(sink)""")
def write_outcomes(spark, sf_dir):
    """ST12, SNK8: customers as node states, written to three sinks; failed writes of earlier runs are tried again."""
    k = F.col("c_custkey")
    written = F.when(k % 5 == 0, "written").when(k % 5 == 1, "failed").otherwise("pending")
    states = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, "embedded").when(k % 3 == 1, "failed").otherwise("pending").alias("embedding_status"), written.alias("write_status"), (k % 4).cast("int").alias("retry_count"))
    found = [manifestation.write_nodes(states, _Sink(kind))[0].select(F.lit(kind).alias("sink"), "c_custkey", "write_status", "retry_count") for kind in ("taking", "refusing", "away")]
    return found[0].union(found[1]).union(found[2])


@query("node_points", """
        SELECT p_partkey AS node_id, p_partkey % 150 AS book_number, s_name AS source_filename, p_name AS display_name, 'local' AS provider_id, 16 AS dimensions, 'm' AS embedding_model_id,
               substr(sha256('{"dimensions":16,"model_id":"m","profile_version":1,"provider_id":"local","task_type":"D"}'), 1, 16) AS embedding_profile_key
        FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def node_points(spark, sf_dir):
    """SNK4, PRJ7: parts as nodes, suppliers as their chunks; some nodes' chunks are not there."""
    k = F.col("p_partkey")
    states = table(spark, sf_dir, "part").select(k.alias("node_id"), k.cast("string").alias("point_id"), (k % 150).alias("book_number"), F.lit(1).alias("chunk_number"), F.col("p_name").alias("display_name"), F.col("p_brand").alias("text_hash"))
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_number"), F.lit(1).alias("chunk_number"), F.col("s_name").alias("source_filename"))
    vectors = states.select("node_id", F.array(F.lit(1.0)).alias("vector"))
    profile = {"provider_id": "local", "model_id": "m", "dimensions": 16, "task_type": "D", "profile_version": 1}
    found = manifestation.vector_rows(vectors, states, chunks, "w", profile)
    return found.select("node_id", "book_number", "source_filename", "display_name", "provider_id", "dimensions", "embedding_model_id", "embedding_profile_key")
