"""PRJ15-PRJ17, JN10, AGG12, TOP4, TOP6, TOP7, SET5, FLT12, FLT17: worlds, assets and the model catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, name_key


def hub_order(worlds: DataFrame, last_used: str, modified: str, title: str) -> DataFrame:
    """TOP4: newest use first, else newest change; then by lower title."""
    return worlds.orderBy(F.coalesce(F.col(last_used), F.col(modified)).desc(), F.lower(title))


def by_name(assets: DataFrame, name: str, *then: str) -> DataFrame:
    """TOP7: a shelf of assets in order of their names, whatever the case."""
    return assets.orderBy(F.lower(name), name, *then)


def duplicate_names(worlds: DataFrame, title: str) -> DataFrame:
    """AGG12: (name_key, worlds) of keys that several worlds share."""
    return worlds.groupBy(name_key(F.col(title)).alias("name_key")).agg(F.count("*").alias("worlds")).filter("worlds > 1")


def world_title(name: Column, ui_title: Column, directory: Column) -> Column:
    """PRJ16: the metadata's name, else the title of the user interface, else the directory."""
    given = lambda c: F.nullif(collapse(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(given(name), given(ui_title), directory)


def resolved_assets(worlds: DataFrame, assets: DataFrame, selected: str, default: str) -> DataFrame:
    """JN10: worlds with asset_id, the selected asset if it exists, else the default."""
    known = assets.select(F.col("asset_id").alias(selected), F.lit(True).alias("__there"))
    return worlds.join(known, selected, "left").withColumn("asset_id", F.when(F.col("__there"), F.col(selected)).otherwise(default)).drop("__there")


def delete_impact(worlds: DataFrame, assets: DataFrame, selected: str) -> DataFrame:
    """JN10: (asset_id, worlds): how many worlds select each asset."""
    counted = worlds.groupBy(F.col(selected).alias("asset_id")).agg(F.count("*").alias("worlds"))
    return assets.select("asset_id").join(counted, "asset_id", "left").select("asset_id", F.coalesce("worlds", F.lit(0)).alias("worlds"))


def repaired(worlds: DataFrame, deleted: Column, selected: str, default: str) -> DataFrame:
    """JN10: worlds whose selected asset was deleted select the default."""
    return worlds.withColumn(selected, F.when(F.col(selected) == deleted, default).otherwise(F.col(selected)))


def catalogue(defaults: DataFrame, users: DataFrame) -> DataFrame:
    """SET5: built-in and user assets as one."""
    return defaults.withColumn("built_in", F.lit(True)).unionByName(users.withColumn("built_in", F.lit(False)), allowMissingColumns=True)


def preferred(records: DataFrame, keys: list[str], platform: str, order: str, value: str) -> DataFrame:
    """TOP6: each key's value from platform 3 if there is one, else the first."""
    return records.groupBy(*keys).agg(F.min_by(value, F.struct((F.col(platform) != 3).alias("other"), F.col(order))).alias(value))


def model_settings(models: DataFrame, definitions: DataFrame, surface: str) -> DataFrame:
    """FLT12, PRJ17: settings of the models on a surface: definition, the model's overrides, then its limit as default and maximum.

    models: (model_id, surfaces, limits map, settings array<struct<setting_id, limit_key, default_value, max_value>>).
    Settings without a definition are dropped. The definitions are few and joined by id.
    """
    one = models.filter(F.array_contains("surfaces", surface)).select("model_id", "limits", F.explode("settings").alias("s"))
    limit = F.try_element_at(F.col("limits"), F.col("s.limit_key"))
    found = one.withColumn("setting_id", F.col("s.setting_id")).join(definitions.select("setting_id", F.col("default_value").alias("__d"), F.col("max_value").alias("__m")), "setting_id")
    return found.select("model_id", "setting_id", F.coalesce(limit, F.col("s.default_value"), F.col("__d")).alias("default_value"), F.coalesce(limit, F.col("s.max_value"), F.col("__m")).alias("max_value"))


def pipeline_complete(stages: DataFrame, keys: list[str], status: str) -> DataFrame:
    """FLT17, AGG8: whether every stage of a key is completed."""
    return stages.groupBy(*keys).agg(F.bool_and(F.col(status) == "completed").alias("complete"))


def token_gate(count: Column, limit: Column, needs_limit: bool = False) -> Column:
    """FLT13: pass, TOO_LARGE, or COUNT_FAILED, which blocks; no limit passes unless one is needed."""
    none = F.lit("LIMIT_MISSING" if needs_limit else "pass")
    return F.when(count.isNull(), "COUNT_FAILED").when(limit.isNull(), none).when(count > limit, "TOO_LARGE").otherwise("pass")
