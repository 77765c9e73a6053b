"""SRC14, SRC15, PRJ19, EP10: the catalogue of models, what a profile may ask of them, and the stored states of their quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.status import cooldown_until, failure_bucket, quota_scope, rate_limit
from ..operators.reconcile import last_wins
from .stored import Snapshots, read_json

_MANIFEST = "providers array<struct<id string, displayName string, apiKeyFilePath string, modelFiles array<string>>>"
_MODEL = "id string, displayName string, callName string, surfaces array<string>, limits map<string,int>, settings array<struct<settingId string, limitKey string>>"
STATES = "scope_key string, provider_id string, credential_name string, project_id string, quota_scope string, model_id string, limit_scope string, last_limit_type string, cooldown_until timestamp, last_error_message string"


def read_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """SRC15: one row a model that root/providers.json lists, with its provider and its place in the list.

    A listed file that is not there is a row with error MODEL_FILE_MISSING, one that is not JSON has MODEL_FILE_INVALID;
    files that no provider lists are left out.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    above = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()
    manifest = spark.read.schema(_MANIFEST).option("multiLine", "true").json(f"{root}/providers.json")
    providers = manifest.select(F.posexplode("providers").alias("a", "p"))
    listed = providers.select("a", F.col("p.id").alias("provider_id"), F.col("p.displayName").alias("provider_name"), F.col("p.apiKeyFilePath").alias("api_key_path"), F.posexplode("p.modelFiles").alias("b", "file"))
    # A file's address is percent-encoded, and a plus sign in it is one.
    address = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z0-9+.-]+:(?://[^/]*)?/+", "/"), F.lit("+"), F.lit("%2B")))
    files = read_json(spark, root, _MODEL).withColumn("file", F.substring(address, F.lit(len(above.rstrip("/")) + 2), F.length(address)))
    found = listed.join(files, "file", "left")
    error = F.when(F.col("path").isNull(), "MODEL_FILE_MISSING").when(F.col("_corrupt_record").isNotNull() | F.col("id").isNull(), "MODEL_FILE_INVALID")
    return found.select(
        F.struct("a", "b").alias("place"), "provider_id", "provider_name", "api_key_path", F.col("id").alias("model_id"), F.col("displayName").alias("display_name"), F.col("callName").alias("call_name"),
        F.coalesce("surfaces", F.array().cast("array<string>")).alias("surfaces"), "limits", "settings", error.alias("error"),
    )


def first_models(models: DataFrame, place: str = "place") -> DataFrame:
    """EP10: one row a model id, the first in the catalogue's order; rows without an id are none."""
    rest = [c for c in models.columns if c != "model_id"]
    first = models.filter("model_id is not null").groupBy("model_id").agg(F.min_by(F.struct(*rest), F.col(place)).alias("__m"))
    return first.select("model_id", *[F.col(f"__m.{c}").alias(c) for c in rest])


def contract_error(model_there: Column, surfaces: Column, limits: Column) -> Column:
    """PRJ19: why a model cannot embed, or null."""
    able = F.coalesce(model_there & F.array_contains(surfaces, "embedding"), F.lit(False))
    whole = F.try_element_at(limits, F.lit("maxInputTokens")).isNotNull() & F.try_element_at(limits, F.lit("maxEmbeddingDimensions")).isNotNull()
    return F.when(~able, "UNSUPPORTED_EMBEDDING_MODEL").when(~F.coalesce(whole, F.lit(False)), "EMBEDDING_MODEL_CONTRACT_INCOMPLETE")


def locked_profiles(profiles: DataFrame, models: DataFrame) -> DataFrame:
    """PRJ19: profiles (model_id, provider_id, dimensions, extra_settings map<string,int>, ...) at their model's maxima.

    provider_id and dimensions become the model's, extra_settings gets its max_input_tokens; what else a profile has stays.
    A model that is unknown, cannot embed or lacks a limit leaves the profile as it is, with an error.
    """
    known = models.select("model_id", F.lit(True).alias("__there"), F.col("provider_id").alias("__provider"), "surfaces", "limits")
    found = profiles.join(known, "model_id", "left")
    error = contract_error(F.col("__there"), F.col("surfaces"), F.col("limits"))
    own = F.map_filter(F.coalesce("extra_settings", F.create_map().cast("map<string,int>")), lambda k, v: k != "max_input_tokens")
    settings = F.map_concat(own, F.create_map(F.lit("max_input_tokens"), F.try_element_at("limits", F.lit("maxInputTokens"))))
    at = lambda value, name: F.when(error.isNull(), value).otherwise(F.col(name)).alias(name)
    changed = {"provider_id": at(F.col("__provider"), "provider_id"), "dimensions": at(F.try_element_at("limits", F.lit("maxEmbeddingDimensions")), "dimensions"), "extra_settings": at(settings, "extra_settings")}
    return found.select(*[changed.get(c, F.col(c)) for c in profiles.columns], error.alias("error"))


def cooled(failures: DataFrame, model: str, at: str, order: list[str]) -> DataFrame:
    """SC13, SC14, SC16: the state that each bucket has after its last rate limit.

    failures: (provider_id, project_id, credential_name, code, message, retry_after, and the columns model, at, order). Other
    errors than rate limits cool nothing down. A day's limit has no end: it holds for the run, and only its kind is kept.
    """
    kind, scope, _ = rate_limit(F.col("code"), F.col("message"))
    of = quota_scope(F.col("provider_id"), F.col("project_id"), F.col("credential_name"))
    rows = failures.withColumns({"last_limit_type": kind, "limit_scope": scope, "quota_scope": of}).filter("last_limit_type is not null")
    rows = rows.withColumn("scope_key", failure_bucket(F.col("quota_scope"), F.col(model), F.col("limit_scope")))
    end = F.when(F.col("last_limit_type") != "rpd", cooldown_until(F.col(at), F.col("retry_after")))
    found = rows.select(
        "scope_key", "provider_id", "credential_name", "project_id", "quota_scope", F.when(F.col("limit_scope") == "model", F.col(model)).alias("model_id"), "limit_scope", "last_limit_type",
        end.alias("cooldown_until"), F.col("message").alias("last_error_message"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)],
    )
    return last_wins(found, ["scope_key"], [f"__{i}" for i in range(len(order))]).drop(*[f"__{i}" for i in range(len(order))])


class RuntimeStates:
    """SRC14: the cooldowns of all quota buckets as a table; none were stored yet: no rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self._table = Snapshots(spark, folder)

    def read(self) -> DataFrame:
        return self._table.read(STATES)

    def record(self, states: DataFrame) -> None:
        """Buckets of states in place of the stored ones; other buckets stay."""
        held = self.read()
        self._table.write(held.join(states.select("scope_key"), "scope_key", "left_anti").select(*held.columns).unionByName(states.select(*held.columns)))
