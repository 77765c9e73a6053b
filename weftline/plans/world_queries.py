"""Queries over generic rows: upserts, quotas, credentials, worlds, assets, settings, error classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status, text
from ..operators import reconcile, scheduling, worlds
from ..sources import stored
from .registry import query, table


@query("upsert_last_wins", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def upsert_last_wins(spark, sf_dir):
    """JN11."""
    return reconcile.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("warning_dedup", "SELECT DISTINCT event_type, user_id % 10 AS code FROM events")
def warning_dedup(spark, sf_dir):
    """AGG10."""
    return reconcile.distinct_warnings(table(spark, sf_dir, "events").withColumn("code", F.col("user_id") % 10), ["event_type", "code"])


@query("quota_offered_load", """
        SELECT event_id, count(*) OVER w AS requests_60s, (sum(user_id) OVER w)::BIGINT AS tokens_60s FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def quota_offered_load(spark, sf_dir):
    """WIN3: event types as buckets, user ids as token counts."""
    return scheduling.offered_load(table(spark, sf_dir, "events"), "event_type", "ts", "user_id").select("event_id", "requests_60s", "tokens_60s")


@query("quota_admission", """
        WITH RECURSIVE e AS (SELECT event_id, event_type AS b, epoch_us(ts) AS t, user_id::BIGINT AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
        s AS (SELECT b, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted, []::STRUCT(t BIGINT, n BIGINT)[] AS recent, NULL::BIGINT AS d, 0::BIGINT AS today FROM (SELECT DISTINCT b FROM e)
              UNION ALL
              SELECT b, k, event_id, ok, CASE WHEN ok THEN list_append(kept, {'t': t, 'n': n}) ELSE kept END, d, today + ok::BIGINT
              FROM (SELECT *, len(kept) < 2 AND coalesce(list_sum(list_transform(kept, lambda x: x.n)), 0) + n <= 200 AND today < 40 AS ok
                    FROM (SELECT e.b, e.k, e.event_id, e.t, e.n, list_filter(s.recent, lambda x: x.t >= e.t - 60000000) AS kept, e.t // 86400000000 AS d, CASE WHEN s.d = e.t // 86400000000 THEN s.today ELSE 0 END AS today
                          FROM s JOIN e ON e.b = s.b AND e.k = s.k + 1)))
        SELECT event_id, admitted FROM s WHERE k > 0""")
def quota_admission(spark, sf_dir):
    """WIN3, WIN4; the SQL takes the requests one by one, as the rule says."""
    quota = scheduling.Quota(requests_per_minute=2, tokens_per_minute=200, requests_per_day=40)
    found = scheduling.admitted(table(spark, sf_dir, "events"), "event_type", "ts", "user_id", "event_id", quota)
    return found.select(F.col("order").alias("event_id"), "admitted")


@query("round_robin", "SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 7)::INT AS slot FROM events")
def round_robin(spark, sf_dir):
    """WIN5."""
    return scheduling.rotation(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 7, F.date_trunc("hour", "ts")).select("event_id", F.col("slot").cast("int").alias("slot"))


_CREDENTIALS_SQL = """
        WITH c AS (SELECT c_custkey, 'c' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey % 50) END AS project, c_custkey % 10 <> 0 AS enabled, CASE WHEN c_custkey % 4 = 0 THEN ['m2'] WHEN c_custkey % 4 = 1 THEN [] ELSE ['m1', 'm2'] END AS models FROM customer),
        s AS (SELECT *, CASE WHEN coalesce(project, '') <> '' THEN 'local:project:' || project ELSE 'local:credential:' || name END AS scope FROM c WHERE enabled AND (len(models) = 0 OR list_contains(models, 'm1'))),
        cool AS (SELECT 'local:credential:c' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ':all-models' WHEN 2 THEN ':model:m1' ELSE ':model:m2' END AS scope_key, o_orderdate AS until FROM orders
                 UNION ALL SELECT 'local:project:p' || (o_custkey % 50) || ':all-models', o_orderdate FROM orders WHERE o_orderkey % 97 = 0),
        live AS (SELECT DISTINCT scope_key FROM cool WHERE until > TIMESTAMP '1997-06-01')"""


@query("credential_availability", _CREDENTIALS_SQL + """
        SELECT c_custkey FROM s WHERE scope NOT IN (SELECT scope_key FROM live) AND scope || ':all-models' NOT IN (SELECT scope_key FROM live) AND scope || ':model:m1' NOT IN (SELECT scope_key FROM live)
        AND scope NOT IN (SELECT 'local:credential:c' || s_suppkey FROM supplier)""")
def credential_availability(spark, sf_dir):
    """FLT7, FLT8, SC15, SC16: customers as credentials, orders as cooldowns, suppliers as requests in flight."""
    k = F.col("c_custkey")
    models = F.when(k % 4 == 0, F.array(F.lit("m2"))).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("m1"), F.lit("m2")))
    held = table(spark, sf_dir, "customer").select(k, F.lit("local").alias("provider_id"), F.concat(F.lit("c"), k.cast("string")).alias("credential_name"), F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 50).cast("string"))).alias("project_id"), (k % 10 != 0).alias("enabled"), models.alias("allowed_models"))
    orders = table(spark, sf_dir, "orders")
    o = F.col("o_orderkey") % 4
    end = F.when(o == 0, "").when(o == 1, ":all-models").when(o == 2, ":model:m1").otherwise(":model:m2")
    cool = orders.select(F.concat(F.lit("local:credential:c"), F.col("o_custkey").cast("string"), end).alias("scope_key"), F.col("o_orderdate").alias("cooldown_until"))
    cool = cool.union(orders.filter("o_orderkey % 97 = 0").select(F.concat(F.lit("local:project:p"), (F.col("o_custkey") % 50).cast("string"), F.lit(":all-models")), "o_orderdate"))
    busy = table(spark, sf_dir, "supplier").select(F.concat(F.lit("local:credential:c"), F.col("s_suppkey").cast("string")).alias("scope_key"))
    found = scheduling.available(scheduling.eligible(held, "m1"), cool, busy, "m1", F.lit("1997-06-01").cast("timestamp"))
    return found.select("c_custkey")


@query("scheduler_wait", "SELECT user_id, greatest(0.1, least(2.0, min(value / 50))) AS wait FROM events GROUP BY user_id")
def scheduler_wait(spark, sf_dir):
    """AGG9."""
    return scheduling.wait_seconds(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 50), ["user_id"], "s")


_MESSAGES = [
    (429, "Quota exceeded: REQUESTS_PER_DAY for project 12"), (429, "limit: tokens_per_minute"), (429, "Too many requests"), (429, "This api key is over its RPD"), (429, "credential quota, TPM"),
    (500, "internal, project 3"), (503, "overloaded"), (400, "bad request per day"), (None, "unknown"), (429, None),
    (None, "project over quota"), (None, "api key bad"), (None, None),
]
_MESSAGES_SQL = ", ".join(f"({i}, {'NULL' if c is None else c}, {'NULL' if m is None else chr(39) + m + chr(39)})" for i, (c, m) in enumerate(_MESSAGES))


@query("rate_limit_classify", f"""
        SELECT event_id, CASE WHEN code = 429 THEN CASE WHEN contains(u, 'REQUESTS_PER_DAY') OR contains(u, 'PER DAY') OR contains(u, 'RPD') THEN 'rpd' WHEN contains(u, 'TOKENS_PER_MINUTE') OR contains(u, 'TPM') THEN 'tpm' ELSE 'rpm' END END AS limit_type,
               CASE WHEN code = 429 AND contains(u, 'PROJECT') THEN 'project' WHEN code = 429 AND (contains(u, 'API KEY') OR contains(u, 'API_KEY') OR contains(u, 'CREDENTIAL')) THEN 'credential' ELSE 'model' END AS scope, coalesce(code >= 500 OR code = 429, false) AS retryable
        FROM (SELECT event_id, code::INT AS code, upper(coalesce(event_type || ': ' || message, '')) AS u FROM events JOIN (VALUES {_MESSAGES_SQL}) v(id, code, message) ON id = event_id % {len(_MESSAGES)})""")
def rate_limit_classify(spark, sf_dir):
    """SC14: events as answers of providers, with messages of every class."""
    said = F.get(F.array(*[F.struct(F.lit(c).cast("int").alias("code"), F.lit(m).cast("string").alias("message")) for c, m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", said.alias("said"))
    kind, scope, again = status.rate_limit(F.col("said.code"), F.concat("event_type", F.lit(": "), "said.message"))
    return rows.select("event_id", kind.alias("limit_type"), scope.alias("scope"), again.alias("retryable"))


@query("hub_order", "SELECT c_custkey, c_name FROM customer ORDER BY coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, c_custkey) DESC, lower(c_name)")
def hub_order(spark, sf_dir):
    """TOP4: customers as worlds, some of them used."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("used"))
    return worlds.hub_order(rows, "used", "c_custkey", "c_name").select("c_custkey", "c_name")


@query("slug_and_key", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'world') AS slug, lower(trim(regexp_replace(n, '\\s+', ' ', 'g'))) AS name_key FROM (SELECT p_partkey, '  ' || p_name || ' & ' || upper(p_brand) || chr(9) AS n FROM part)")
def slug_and_key(spark, sf_dir):
    """SC4, SC5."""
    name = F.concat(F.lit("  "), "p_name", F.lit(" & "), F.upper("p_brand"), F.lit("\t"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.name_key(name).alias("name_key"))


@query("duplicate_names", "SELECT lower(p_name) AS name_key, count(*) AS worlds FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    """AGG12."""
    return worlds.duplicate_names(table(spark, sf_dir, "part"), "p_name")


@query("asset_impact", "WITH assets AS (SELECT DISTINCT c_mktsegment AS asset_id FROM customer UNION ALL SELECT 'unused') SELECT a.asset_id, count(c_custkey) AS worlds FROM assets a LEFT JOIN customer ON c_mktsegment = a.asset_id GROUP BY 1")
def asset_impact(spark, sf_dir):
    """JN10: market segments as assets."""
    held = table(spark, sf_dir, "customer")
    assets = held.select(F.col("c_mktsegment").alias("asset_id")).distinct().union(spark.createDataFrame([("unused",)], "asset_id string"))
    return worlds.delete_impact(held, assets, "c_mktsegment")


@query("asset_resolution", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'default' END AS asset_id FROM customer")
def asset_resolution(spark, sf_dir):
    """JN10: three segments are known assets."""
    assets = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("MACHINERY",)], "asset_id string")
    return worlds.resolved_assets(table(spark, sf_dir, "customer"), assets, "c_mktsegment", "default").select("c_custkey", "asset_id")


@query("model_surface", """
        WITH m AS (SELECT c_custkey, 'm' || c_custkey AS model_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::INT * 10 END AS cap, c_custkey % 2 = 1 AS own, (c_custkey % 100)::INT AS k FROM customer WHERE c_custkey % 3 <> 2)
        SELECT model_id, 'top_k' AS setting_id, CASE WHEN own THEN k ELSE 40 END AS default_value, CASE WHEN own THEN 2 * k ELSE 100 END AS max_value FROM m
        UNION ALL SELECT model_id, 'max_output', coalesce(cap, 1024), coalesce(cap, 4096) FROM m""")
def model_surface(spark, sf_dir):
    """FLT12, PRJ17: customers as models, some for chat, some with a limit, some with settings of their own, all with an unknown one."""
    k = F.col("c_custkey")
    number = lambda c: c.cast("int")
    none = F.lit(None)
    setting = lambda name, limit, default, most: F.struct(F.lit(name).alias("setting_id"), limit.cast("string").alias("limit_key"), number(default).alias("default_value"), number(most).alias("max_value"))
    own = k % 2 == 1
    settings = F.array(setting("top_k", none, F.when(own, k % 100), F.when(own, k % 100 * 2)), setting("max_output", F.lit("maxOutput"), none, none), setting("unknown", none, F.lit(1), F.lit(1)))
    surfaces = F.when(k % 3 == 0, F.array(F.lit("chat"))).when(k % 3 == 1, F.array(F.lit("chat"), F.lit("embedding"))).otherwise(F.array(F.lit("embedding")))
    limits = F.when(k % 4 == 0, F.create_map(F.lit("maxOutput"), number(k * 10))).otherwise(F.create_map().cast("map<string,int>"))
    models = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k.cast("string")).alias("model_id"), surfaces.alias("surfaces"), limits.alias("limits"), settings.alias("settings"))
    definitions = spark.createDataFrame([("top_k", 40, 100), ("max_output", 1024, 4096)], "setting_id string, default_value int, max_value int")
    return worlds.model_settings(models, definitions, "chat")


_LINES_SQL = r"""CASE p_partkey % 6 WHEN 0 THEN 'loaded C:\Users\' || p_name || '\books\' || p_brand || '.txt' WHEN 1 THEN p_name WHEN 2 THEN 'D:\' || p_brand
                 WHEN 3 THEN 'from E:\a\' || p_name || '; F:\d\' || p_brand WHEN 4 THEN p_name || ' only G:\' END"""


@query("path_redaction", f"""
        WITH lines AS (SELECT p_partkey, {_LINES_SQL} AS line FROM part),
        parts AS (SELECT p_partkey, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS part FROM (SELECT p_partkey, string_split(regexp_replace(line, '([A-Za-z]:\\\\)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM lines)),
        cut AS (SELECT *, regexp_matches(part, '^[A-Za-z]:\\\\[^\\\\/:*?"<>|\r\n]') AS path, string_split(substr(part, 4), chr(92)) AS names FROM parts),
        kept AS (SELECT p_partkey, n, CASE WHEN path THEN '<local-path>' || chr(92) || names[len(names)] ELSE part END AS part FROM cut)
        SELECT t.p_partkey, string_agg(part, '' ORDER BY n) AS line FROM lines t LEFT JOIN kept ON kept.p_partkey = t.p_partkey GROUP BY t.p_partkey""")
def path_redaction(spark, sf_dir):
    """PRJ18: parts as log lines with no path, one or two, and with a drive alone."""
    k, name, brand = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_brand")
    line = (
        F.when(k == 0, F.concat(F.lit("loaded C:\\Users\\"), name, F.lit("\\books\\"), brand, F.lit(".txt"))).when(k == 1, name).when(k == 2, F.concat(F.lit("D:\\"), brand))
        .when(k == 3, F.concat(F.lit("from E:\\a\\"), name, F.lit("; F:\\d\\"), brand)).when(k == 4, F.concat(name, F.lit(" only G:\\")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.redact_paths(line).alias("line"))


@query("pipeline_complete", "SELECT c_mktsegment AS world, bool_and(c_custkey % 50 <> 7 OR c_mktsegment = 'BUILDING') AS complete FROM customer GROUP BY 1")
def pipeline_complete(spark, sf_dir):
    """FLT17, AGG8: customers as books of a segment's world."""
    done = (F.col("c_custkey") % 50 != 7) | (F.col("c_mktsegment") == "BUILDING")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("world"), F.when(done, "completed").otherwise("partial").alias("status"))
    return worlds.pipeline_complete(rows, ["world"], "status")


@query("catalogue_union", "SELECT r_name AS name, true AS built_in FROM region UNION ALL SELECT n_name, false FROM nation")
def catalogue_union(spark, sf_dir):
    """SET5: regions as built-in assets, nations as the user's."""
    return worlds.catalogue(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("preferred_record", "SELECT n_regionkey, arg_min(n_name, CASE WHEN n_nationkey % 5 <> 3 THEN 1000 ELSE 0 END + n_nationkey) AS name FROM nation GROUP BY 1")
def preferred_record(spark, sf_dir):
    """TOP6: nation key modulo 5 as platform."""
    rows = table(spark, sf_dir, "nation").withColumn("platform", F.col("n_nationkey") % 5)
    return worlds.preferred(rows, ["n_regionkey"], "platform", "n_nationkey", "n_name").withColumnRenamed("n_name", "name")


@query("null_dropping_json", """
        SELECT c_custkey, json_merge_patch('{}', to_json({'id': c_custkey, 'name': CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'segment': CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END}))::VARCHAR AS record FROM customer""")
def null_dropping_json(spark, sf_dir):
    """PRJ8: customers as records, some of them without a name or a segment."""
    k = F.col("c_custkey")
    record = stored.record_json(k.alias("id"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return table(spark, sf_dir, "customer").select(k, record.alias("record"))
