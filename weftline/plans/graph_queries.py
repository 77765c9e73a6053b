"""Queries over conversations as extracted graphs: a conversation is a chunk, a turn is a pass."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import identity, status
from ..operators import extraction, manifestation, reconcile
from ..sources.stored import kept, shared_folder
from .registry import NAMESPACE, RUN, query, sql_strip, sql_uuid5, table

def _world():
    return F.lit(NAMESPACE)


#: Responses by turn and conversation, whole and broken in each way.
_CASES = [
    ('{"nodes":[{"display_name":"', '","description":"a turn"}],"edges":[]}\n---COMPLETE---'),
    ('{"nodes":[{"display_name":"', '","description":"a turn"}],"edges":[]}'),
    ('```json\n{"nodes":[{"display_name":"', '","description":"b"}],"edges":[]}\n```\n---COMPLETE--- more'),
    ('{"nodes":{"display_name":"', '"},"edges":[]}---COMPLETE---'),
    ('{"nodes":[{"display_name":"', '"],"edges":[]}---COMPLETE---'),
    ('Sure: {"nodes":[],"edges":[{"source_display_name":"', '","target_display_name":"x","description":"d","strength":7}]} done\n---COMPLETE---'),
    ('{"nodes":[{"display_name":1,"description":"', '"}],"edges":[]}---COMPLETE---'),
    ('{"nodes":[],"edges":[{"source_display_name":"', '","target_display_name":"x","description":"d","strength":7.5}]}---COMPLETE---'),
    ('[{"nodes":"', '"}]---COMPLETE---'),
    ('```\n{"nodes":[],"edges":[],"more":"', '"}\n``` text after\n---COMPLETE---'),
    ('{"nodes":[],"edges":[{"source_display_name":"', '","target_display_name":"x","description":"d","strength":true}]}---COMPLETE---'),
]
_CASES_SQL = "CASE (conv_id + turn) % 11 " + " ".join("WHEN {} THEN '{}' || role || '{}'".format(i, a.replace("\n", "' || chr(10) || '"), b.replace("\n", "' || chr(10) || '")) for i, (a, b) in enumerate(_CASES)) + " END"
_TYPED = "coalesce(json_type(e.item, '$.{}') = 'VARCHAR', false)"


@query("extraction_parse", f"""
        WITH r AS (SELECT {_CASES_SQL} AS response FROM conversations),
        cut AS (SELECT instr(response, '---COMPLETE---') AS pos, {sql_strip("substr(response, 1, greatest(instr(response, '---COMPLETE---') - 1, 0))")} AS before FROM r),
        body AS (SELECT pos, CASE WHEN starts_with(before, '```') THEN trim(regexp_replace(regexp_replace(before, '^```[^\\n]*\\n?', ''), '(^|\\n)[ \\t]*```$', ''), chr(10) || ' ')
                        WHEN regexp_extract(before, '(?s)\\{{.*\\}}') <> '' THEN regexp_extract(before, '(?s)\\{{.*\\}}') ELSE before END AS b FROM cut),
        typed AS (SELECT pos, b, pos > 0 AND json_valid(b) AS good, CASE WHEN pos > 0 AND json_valid(b) THEN b::JSON END AS j FROM body),
        judged AS (SELECT CASE WHEN pos = 0 THEN 'EXTRACTION_RESPONSE_INCOMPLETE' WHEN NOT good THEN 'EXTRACTION_RESPONSE_INVALID_JSON'
                        WHEN json_type(j) <> 'OBJECT' OR json_type(j, '$.nodes') IS DISTINCT FROM 'ARRAY' OR json_type(j, '$.edges') IS DISTINCT FROM 'ARRAY' THEN 'EXTRACTION_RESPONSE_INVALID_SCHEMA'
                        WHEN EXISTS (SELECT 1 FROM (SELECT unnest(typed.j->'$.nodes[*]') AS item) e WHERE NOT ({" AND ".join(_TYPED.format(f) for f in ("display_name", "description"))}))
                          OR EXISTS (SELECT 1 FROM (SELECT unnest(typed.j->'$.edges[*]') AS item) e WHERE NOT ({" AND ".join(_TYPED.format(f) for f in ("source_display_name", "target_display_name", "description"))})) THEN 'EXTRACTION_RESPONSE_INVALID_SCHEMA'
                        ELSE 'ok' END AS code, j FROM typed)
        SELECT code, count(*) AS responses, coalesce(sum(CASE WHEN code = 'ok' THEN json_array_length(j, '$.nodes') END), 0)::BIGINT AS nodes, coalesce(sum(CASE WHEN code = 'ok' THEN json_array_length(j, '$.edges') END), 0)::BIGINT AS edges,
               count(*) FILTER (WHERE code = 'ok' AND json_type(j, '$.edges[0].strength') IN ('UBIGINT', 'BIGINT')) AS strengths
        FROM judged GROUP BY code""")
def extraction_parse(spark, sf_dir):
    """PRJ12-PRJ14, FLT5, SC20."""
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_CASES)))
    made = F.coalesce(*[F.when(k == i, F.concat(F.lit(a), "role", F.lit(b))) for i, (a, b) in enumerate(_CASES)])
    found = extraction.parse(table(spark, sf_dir, "conversations").select(made.alias("response")))
    whole = F.coalesce(F.get("edges", F.lit(0))["strength"].isNotNull(), F.lit(False))
    return found.groupBy(F.coalesce("error", F.lit("ok")).alias("code")).agg(
        F.count("*").alias("responses"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("nodes"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges"), F.count_if(whole).alias("strengths"))


def _raw_nodes(spark, sf_dir, turns=None):
    """Names are roles; descriptions are the texts, some of them blank."""
    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    c = turns.select("conv_id", F.col("turn").alias("seq"), "role", "text")
    text = F.when(F.col("conv_id") % 7 == 3, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return c.select("conv_id", "seq", F.concat(F.lit("\t"), "role").alias("display_name"), text.alias("description"))


def _nodes(spark, sf_dir, turns=None):
    return extraction.merge_nodes(_raw_nodes(spark, sf_dir, turns), ["conv_id"], _world(), F.lit(RUN), F.lit(1), F.col("conv_id"))


_NODES_SQL = f"""
        raw AS (SELECT conv_id, turn AS seq, role AS name, {sql_strip("CASE WHEN conv_id % 7 = 3 THEN ' ' ELSE ' ' || text || chr(10) END")} AS d FROM conversations),
        firsts AS (SELECT conv_id, name, d, min(seq) AS seq FROM raw WHERE d <> '' AND name <> '' GROUP BY ALL),
        nodes AS (SELECT conv_id, name AS display_name, string_agg(d, chr(10) || chr(10) ORDER BY seq, d) AS description, min(seq) AS first_seq FROM firsts GROUP BY conv_id, name),
        ids AS (SELECT *, {sql_uuid5(f"'{NAMESPACE}'", f"'graph-candidate:{RUN}:book:1:chunk:' || conv_id || ':node:' || display_name")} AS node_id FROM nodes)"""


@query("node_merge", f"WITH {_NODES_SQL} SELECT conv_id, display_name, sha256(description) AS description_hash, first_seq FROM nodes")
def node_merge(spark, sf_dir):
    """AGG1, WIN6, FLT6, SC3."""
    return _nodes(spark, sf_dir).select("conv_id", "display_name", F.sha2("description", 256).alias("description_hash"), "first_seq")


@query("candidate_ids", f"WITH {_NODES_SQL} SELECT conv_id, display_name, node_id, {sql_uuid5(f'{chr(39)}{NAMESPACE}{chr(39)}', f'{chr(39)}graph-node:{RUN}:book:1:node:{chr(39)} || node_id')} AS point_id FROM ids")
def candidate_ids(spark, sf_dir):
    """SC8: candidate ids and node point ids."""
    return _nodes(spark, sf_dir).select("conv_id", "display_name", "node_id", identity.node_point_id(_world(), F.lit(RUN), F.lit(1), F.col("node_id")).alias("point_id"))


def _raw_edges(spark, sf_dir, turns=None):
    """Each turn points from its role to one chosen by its number; strengths run from 0 to 11, so some are invalid."""
    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    c = turns.select("conv_id", F.col("turn").alias("seq"), "role", "text")
    to = F.get(F.array(F.lit("user"), F.lit("assistant"), F.lit("nobody")), (F.col("seq") % 3).cast("int"))
    return c.select("conv_id", "seq", F.col("role").alias("source_display_name"), to.alias("target_display_name"), F.col("text").alias("description"), ((F.col("conv_id") + F.col("seq")) % 12).cast("int").alias("strength"))


def _edges(spark, sf_dir, nodes=None, turns=None):
    return extraction.merge_edges(_raw_edges(spark, sf_dir, turns), nodes if nodes is not None else _nodes(spark, sf_dir), ["conv_id"], _world(), F.lit(RUN), F.lit(1), F.col("conv_id"))


_EDGES_SQL = f"""
        raw_edges AS (SELECT conv_id, turn AS seq, role AS s, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'nobody' END AS t, {sql_strip("text")} AS d, ((conv_id + turn) % 12)::INT AS strength FROM conversations),
        edges AS (SELECT e.*, a.node_id AS source_node_id, b.node_id AS target_node_id, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.seq) AS edge_number
                  FROM raw_edges e JOIN ids a ON a.conv_id = e.conv_id AND a.display_name = e.s JOIN ids b ON b.conv_id = e.conv_id AND b.display_name = e.t WHERE e.strength BETWEEN 1 AND 10 AND e.d <> ''),
        edge_ids AS (SELECT *, {sql_uuid5(f"'{NAMESPACE}'", f"'graph-candidate:{RUN}:book:1:chunk:' || conv_id || ':edge:' || edge_number || ':' || s || ':' || t || ':' || d || ':' || strength")} AS edge_id FROM edges)"""


@query("edge_merge", f"WITH {_NODES_SQL}, {_EDGES_SQL} SELECT conv_id, edge_number, source_node_id, target_node_id, strength, edge_id FROM edge_ids")
def edge_merge(spark, sf_dir):
    """JN1, FLT5, WIN2."""
    return _edges(spark, sf_dir).select("conv_id", F.col("edge_number").cast("long").alias("edge_number"), "source_node_id", "target_node_id", "strength", "edge_id")


@query("glean_rescue", f"""WITH {_NODES_SQL}, {_EDGES_SQL}
        SELECT e.conv_id, e.edge_id FROM edge_ids e JOIN nodes a ON a.conv_id = e.conv_id AND a.display_name = e.s JOIN nodes b ON b.conv_id = e.conv_id AND b.display_name = e.t
        WHERE greatest(a.first_seq, b.first_seq) > e.seq""")
def glean_rescue(spark, sf_dir):
    """JN1, SET3: edges whose end is first named in a later pass."""
    nodes = _nodes(spark, sf_dir)
    seen = lambda side: nodes.select("conv_id", F.col("display_name").alias(f"{side}_display_name"), F.col("first_seq").alias(f"{side}_seq"))
    found = _edges(spark, sf_dir, nodes).join(seen("source"), ["conv_id", "source_display_name"]).join(seen("target"), ["conv_id", "target_display_name"])
    return found.filter(F.greatest("source_seq", "target_seq") > F.col("seq")).select("conv_id", "edge_id")


_STATUS = ["extracted", "skipped", "failed", "pending", "partial"]


@query("extraction_rollup", """
        SELECT conv_id, CASE WHEN count(*) FILTER (WHERE s < 2) = count(*) THEN 'completed' WHEN count(*) FILTER (WHERE s = 2) > 0 AND count(*) FILTER (WHERE s > 2) = 0 AND count(*) FILTER (WHERE s < 2) = 0 THEN 'failed' ELSE 'partial' END AS rollup
        FROM (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN turn % 2 WHEN conv_id % 4 = 1 THEN 2 ELSE turn % 5 END AS s FROM conversations) GROUP BY conv_id""")
def extraction_rollup(spark, sf_dir):
    """AGG3 of extraction."""
    k = F.when(F.col("conv_id") % 4 == 0, F.col("turn") % 2).when(F.col("conv_id") % 4 == 1, 2).otherwise(F.col("turn") % 5).cast("int")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.get(F.array(*map(F.lit, _STATUS)), k).alias("status"))
    return rows.groupBy("conv_id").agg(status.extraction_rollup(F.col("status")).alias("rollup"))


def _two_sides(spark, sf_dir):
    """Stored and fresh rows: some chunks changed, some only on one side."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.filter("conv_id % 13 <> 4"), c.filter("conv_id % 17 <> 5").withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("+"))).otherwise(F.col("text")))


_STALE_SQL = """
        old AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 13 <> 4), fresh AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN text || '+' ELSE text END AS text FROM conversations WHERE conv_id % 17 <> 5),
        a AS (SELECT conv_id, list_sort(list({'t': turn, 'r': role, 'x': text})) AS sig FROM old GROUP BY conv_id), b AS (SELECT conv_id, list_sort(list({'t': turn, 'r': role, 'x': text})) AS sig FROM fresh GROUP BY conv_id),
        stale AS (SELECT conv_id FROM a FULL JOIN b USING (conv_id) WHERE a.sig IS DISTINCT FROM b.sig)"""


@query("stale_chunks", f"WITH {_STALE_SQL} SELECT conv_id FROM stale")
def stale_chunks(spark, sf_dir):
    """JN4, AGG6, SET1."""
    old, fresh = _two_sides(spark, sf_dir)
    return reconcile.stale_chunks(old, fresh, ["conv_id"], ["turn", "role", "text"])


@query("node_reconcile", f"""WITH {_STALE_SQL}
        SELECT f.conv_id || ':' || f.turn AS node_id, CASE WHEN o.conv_id IS NOT NULL AND f.conv_id NOT IN (SELECT conv_id FROM stale) AND o.text = f.text THEN CASE o.turn % 3 WHEN 0 THEN 'written' WHEN 1 THEN 'failed' ELSE 'pending' END ELSE 'pending' END AS status
        FROM fresh f LEFT JOIN old o USING (conv_id, turn)""")
def node_reconcile(spark, sf_dir):
    """JN5."""
    old, fresh = _two_sides(spark, sf_dir)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_id")
    t = F.col("turn") % 3
    saved = old.select(key, "conv_id", F.sha2("text", 256).alias("text_hash"), F.when(t == 0, "written").when(t == 1, "failed").otherwise("pending").alias("status"))
    now = fresh.select(key, "conv_id", F.sha2("text", 256).alias("text_hash"), F.lit("pending").alias("status"))
    return reconcile.reconciled(now, saved, reconcile.stale_chunks(old, fresh, ["conv_id"], ["turn", "role", "text"]), "node_id", ["conv_id"], ["text_hash"], ["status"]).select("node_id", "status")


def _node_states(spark, sf_dir):
    n = F.col("conv_id") + F.length("display_name")
    return _nodes(spark, sf_dir).select("conv_id", "node_id", F.when(n % 5 == 0, "failed").when(n % 5 == 1, "pending").otherwise("embedded").alias("embedding_status"), F.when(n % 7 == 0, "failed").when(n % 7 == 1, "pending").otherwise("written").alias("write_status"))


_NODE_STATES_SQL = """
        states AS (SELECT conv_id, node_id, CASE WHEN (conv_id + length(display_name)) % 5 >= 2 AND (conv_id + length(display_name)) % 7 >= 2 THEN 'manifested'
                   WHEN (conv_id + length(display_name)) % 5 = 0 OR (conv_id + length(display_name)) % 7 = 0 THEN 'failed' ELSE 'pending' END AS state FROM ids)"""


@query("edge_dependencies", f"""WITH {_NODES_SQL}, {_EDGES_SQL}, {_NODE_STATES_SQL}
        SELECT status, retry_count, count(*) AS edges FROM (
            SELECT CASE WHEN e.edge_number % 6 = 5 THEN 'written' WHEN a.state = 'failed' OR b.state = 'failed' THEN 'failed_dependency' WHEN a.state = 'manifested' AND b.state = 'manifested' THEN 'pending' ELSE 'waiting_dependency' END AS status,
                   CASE WHEN e.edge_number % 6 = 4 AND a.state = 'manifested' AND b.state = 'manifested' THEN 0 ELSE 2 END AS retry_count
            FROM edge_ids e LEFT JOIN states a ON a.node_id = e.source_node_id LEFT JOIN states b ON b.node_id = e.target_node_id) GROUP BY ALL""")
def edge_dependencies(spark, sf_dir):
    """JN6, AGG2."""
    k = F.col("edge_number") % 6
    edges = _edges(spark, sf_dir).select("edge_id", "source_node_id", "target_node_id", F.when(k == 5, "written").when(k == 4, "failed").when(k == 3, "waiting_dependency").otherwise("pending").alias("status"), F.lit(2).alias("retry_count"))
    return manifestation.edge_dependencies(edges, _node_states(spark, sf_dir)).groupBy("status", "retry_count").agg(F.count("*").alias("edges"))


@query("manifest_outcomes", f"""WITH {_NODES_SQL}
        SELECT node_id, CASE WHEN k % 4 < 2 THEN 'embedded' WHEN tries + 1 >= 3 THEN 'failed' ELSE 'pending' END AS embedding_status, CASE WHEN k % 4 < 2 THEN 0 ELSE tries + 1 END AS retry_count,
               CASE WHEN k % 4 = 2 THEN 'PROVIDER_FAILED' WHEN k % 4 = 3 THEN 'NODE_EMBEDDING_MISSING' END AS last_error_code
        FROM (SELECT node_id, conv_id + length(display_name) AS k, (conv_id % 3)::INT AS tries FROM ids)""")
def manifest_outcomes(spark, sf_dir):
    """JN9, ST11: vectors for half of the nodes, failures for a quarter, nothing for the rest."""
    nodes = _nodes(spark, sf_dir).withColumn("k", (F.col("conv_id") + F.length("display_name")) % 4)
    pending = nodes.select("node_id", (F.col("conv_id") % 3).cast("int").alias("retry_count"))
    found = manifestation.embedding_outcomes(pending, nodes.filter("k < 2").select("node_id", F.array(F.lit(1.0)).alias("vector")), nodes.filter("k = 2").select("node_id", F.lit("PROVIDER_FAILED").alias("code")))
    return found.select("node_id", "embedding_status", "retry_count", "last_error_code")


@query("graph_edge_write", f"WITH {_NODES_SQL}, {_EDGES_SQL}, known AS (SELECT node_id FROM ids WHERE conv_id % 4 <> 1) SELECT edge_id FROM edge_ids WHERE source_node_id IN (SELECT node_id FROM known) AND target_node_id IN (SELECT node_id FROM known)")
def graph_edge_write(spark, sf_dir):
    """JN7, SNK6: nodes of some chunks are not in the graph."""
    nodes = _nodes(spark, sf_dir)
    known = nodes.filter("conv_id % 4 <> 1").select("node_id", _world().alias("world_uuid"))
    return manifestation.writable_edges(_edges(spark, sf_dir, nodes).select("edge_id", "source_node_id", "target_node_id", _world().alias("world_uuid")), known).select("edge_id")


@query("delete_chunk_scope", f"WITH {_NODES_SQL}, {_EDGES_SQL} SELECT 'node' AS kind, node_id AS id FROM ids WHERE conv_id % 9 <> 2 UNION ALL SELECT 'edge', edge_id FROM edge_ids WHERE conv_id % 9 <> 2")
def delete_chunk_scope(spark, sf_dir):
    """FLT2, JN12, JN13: what is left when some chunks go."""
    nodes = _nodes(spark, sf_dir)
    left, edges = reconcile.delete_chunk(nodes, _edges(spark, sf_dir, nodes), F.col("conv_id") % 9 == 2)
    return left.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).union(edges.select(F.lit("edge"), "edge_id"))


@query("prompt_assembly", """
        SELECT conv_id, turn, sha256('Name what the chunk holds.' || chr(10) || chr(10) || '### Context before the chunk (reference only)' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '(none)' ELSE role END || chr(10) || chr(10) || '### Chunk' || chr(10) || chr(10) || text) AS prompt_hash FROM conversations""")
def prompt_assembly(spark, sf_dir):
    """PRJ10: blank context is shown as none."""
    c = table(spark, sf_dir, "conversations")
    prompt = extraction.initial_prompt("Name what the chunk holds.\n", F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit(" \n")).otherwise(F.concat(F.lit(" "), "role")))
    return c.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_hash"))


_FRESH_SQL = "conversations AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN text || '+' ELSE text END AS text FROM conversations WHERE conv_id % 17 <> 5)"


@query("graph_after_changes", f"WITH {_FRESH_SQL}, {_NODES_SQL}, {_EDGES_SQL} SELECT 'node' AS kind, node_id AS id, sha256(description) AS said FROM ids UNION ALL SELECT 'edge', edge_id, sha256(d) FROM edge_ids")
def graph_after_changes(spark, sf_dir):
    """ST10, FLT2, JN12, JN13, SNK5-SNK7: a store with the graph of the stored turns forgets what changed chunks made and takes their
    fresh rows; what it holds then is the graph of the fresh turns. All is sent twice, as behind a lost acknowledgement.
    """
    graph = manifestation.TableGraph(f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    sides = []
    for turns in _two_sides(spark, sf_dir):
        named = kept(_nodes(spark, sf_dir, turns))
        nodes = named.select("conv_id", "node_id", "description", _world().alias("world_uuid"))
        sides.append((nodes, kept(_edges(spark, sf_dir, named, turns).select("conv_id", "edge_id", "source_node_id", "target_node_id", "description", "strength", _world().alias("world_uuid")))))
    (old_nodes, old_edges), (nodes, edges) = sides
    differ = lambda a, b, *fields: reconcile.stale_chunks(a, b, ["conv_id"], list(fields))
    stale = kept(differ(old_nodes, nodes, "node_id", "description").union(differ(old_edges, edges, "edge_id", "description", "strength")).distinct())
    of = lambda rows: rows.join(stale, "conv_id", "left_semi")
    for send, rows in ((graph.write_nodes, old_nodes), (graph.write_edges, old_edges), (graph.delete_edges, of(old_edges)), (graph.delete_nodes, of(old_nodes)), (graph.write_nodes, of(nodes)), (graph.write_edges, of(edges))):
        send(rows)
        send(rows)
    held = graph.nodes.rows(nodes).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "description").union(graph.edges.rows(edges).select(F.lit("edge"), "edge_id", "description"))
    return held.select("kind", "id", F.sha2("description", 256).alias("said"))
