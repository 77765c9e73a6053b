"""The catalogue of models, profiles at their model's maxima, stored quota states."""

import datetime as dt
import json

from pyspark.sql import functions as F

from weftline.sources import models


def write(folder, name, value):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def catalogue(spark, folder):
    write(folder, "providers.json", {"providers": [
        {"id": "one", "displayName": "One", "apiKeyFilePath": "keys/one", "modelFiles": ["one/big+ small.json", "one/gone.json", "one/bad.json"]},
        {"id": "two", "displayName": "Two", "apiKeyFilePath": "keys/two", "modelFiles": ["two/a.json", "two/chat.json"]}, {"id": "none", "displayName": "None", "apiKeyFilePath": "k", "modelFiles": []},
    ]})
    write(folder, "one/big+ small.json", {"id": "e", "displayName": "E", "callName": "e-1", "surfaces": ["embedding"], "limits": {"maxInputTokens": 100, "maxEmbeddingDimensions": 64}, "settings": [{"settingId": "s", "limitKey": "maxInputTokens", "min": 1}]})
    write(folder, "one/bad.json", "{no json")
    write(folder, "two/a.json", {"id": "e", "displayName": "E again", "callName": "e-2", "surfaces": ["embedding"]})
    write(folder, "two/chat.json", {"id": "c", "displayName": "C", "callName": "c", "surfaces": ["chat", "embedding"], "limits": {"maxInputTokens": 5}})
    write(folder, "two/unlisted.json", {"id": "u", "displayName": "U", "callName": "u"})
    return models.read_catalogue(spark, str(folder))


def test_catalogue_and_lookup(spark, tmp_path):
    found = catalogue(spark, tmp_path / "a b")
    rows = [(r.provider_id, r.model_id, r.call_name, r.error) for r in found.orderBy("place").collect()]
    assert rows == [("one", "e", "e-1", None), ("one", None, None, "MODEL_FILE_MISSING"), ("one", None, None, "MODEL_FILE_INVALID"), ("two", "e", "e-2", None), ("two", "c", "c", None)]
    assert {r.model_id: r.call_name for r in models.first_models(found).collect()} == {"e": "e-1", "c": "c"}


def test_profiles_at_maxima(spark, tmp_path):
    known = models.first_models(catalogue(spark, tmp_path / "c"))
    rows = [("e", "old", 8, {"max_input_tokens": 1, "x": 2}, "kept"), ("e", "old", None, None, "k"), ("c", "old", 8, {}, "k"), ("u", "old", 8, {}, "k"), (None, "old", 8, None, None)]
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, model_id string, provider_id string, dimensions int, extra_settings map<string,int>, task_type string")
    got = [tuple(r) for r in models.locked_profiles(asked, known).orderBy("i").collect()]
    assert got[0] == (0, "e", "one", 64, {"max_input_tokens": 100, "x": 2}, "kept", None) and got[1] == (1, "e", "one", 64, {"max_input_tokens": 100}, "k", None)
    assert [g[-1] for g in got[2:]] == ["EMBEDDING_MODEL_CONTRACT_INCOMPLETE", "UNSUPPORTED_EMBEDDING_MODEL", "UNSUPPORTED_EMBEDDING_MODEL"]
    assert got[2][2:5] == ("old", 8, {}) and got[4][1:] == (None, "old", 8, None, None, "UNSUPPORTED_EMBEDDING_MODEL")


def test_states_are_stored_by_bucket(spark, tmp_path):
    at = dt.datetime(2024, 5, 1, 12)
    kind = "provider_id string, project_id string, credential_name string, code int, message string, retry_after int, model string, at timestamp"
    store = models.RuntimeStates(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    first = spark.createDataFrame([("g", None, "a", 429, "rpm", 10, "m", at), ("g", "p", "b", 429, "project tpm", None, "m", at), ("g", None, "c", 500, "down", None, "m", at), ("g", None, "a", None, None, None, None, None)], kind)
    store.record(models.cooled(first, "model", "at", ["at"]))
    later = spark.createDataFrame([("g", None, "a", 429, "per day", 10, "m", at)], kind)
    store.record(models.cooled(later, "model", "at", ["at"]))
    got = {r.scope_key: (r.model_id, r.limit_scope, r.last_limit_type, r.cooldown_until) for r in store.read().withColumn("cooldown_until", F.col("cooldown_until").cast("string")).collect()}
    assert got == {"g:credential:a:model:m": ("m", "model", "rpd", None), "g:project:p:all-models": (None, "project", "tpm", "2024-05-01 12:01:00")}
