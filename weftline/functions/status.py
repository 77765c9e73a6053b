"""Status words, their roll-ups, and the classification of errors and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status words of the stages.
PENDING, EMBEDDED, FAILED, PARTIAL, SKIPPED, EXTRACTED = "pending", "embedded", "failed", "partial", "skipped", "extracted"
WRITTEN, MANIFESTED, COMPLETED = "written", "manifested", "completed"
WAITING_DEPENDENCY, FAILED_DEPENDENCY = "waiting_dependency", "failed_dependency"
RETRIES = 3


def count_where(condition: Column) -> Column:
    """AGG2."""
    return F.count_if(condition)


def embedding_rollup(status: Column) -> Column:
    """AGG3 of chunk embedding: failed only if nothing succeeded and nothing is pending."""
    done, failed, pending = (F.count_if(status == s) for s in (EMBEDDED, FAILED, PENDING))
    return F.when(done == F.count("*"), COMPLETED).when((failed > 0) & (pending == 0) & (done == 0), FAILED).otherwise(PARTIAL)


def extraction_rollup(status: Column) -> Column:
    """AGG3 of extraction: skipped counts as done, partial as pending."""
    done, failed, pending = F.count_if(status.isin(EXTRACTED, SKIPPED)), F.count_if(status == FAILED), F.count_if(status.isin(PENDING, PARTIAL))
    return F.when(done == F.count("*"), COMPLETED).when((failed > 0) & (pending == 0) & (done == 0), FAILED).otherwise(PARTIAL)


def manifestation_rollup(status: Column) -> Column:
    """AGG3 of manifestation over node and edge states: failed if any failed and nothing is pending, successes or not."""
    done, failed = F.count_if(status.isin(MANIFESTED, WRITTEN)), F.count_if(status.isin(FAILED, FAILED_DEPENDENCY))
    return F.when(done == F.count("*"), COMPLETED).when((failed > 0) & (done + failed == F.count("*")), FAILED).otherwise(PARTIAL)


def node_status(embedding: Column, write: Column) -> Column:
    """manifested if both parts are done, failed if one failed, else pending."""
    return F.when((embedding == EMBEDDED) & (write == WRITTEN), MANIFESTED).when((embedding == FAILED) | (write == FAILED), FAILED).otherwise(PENDING)


def after_failure(retries: Column) -> tuple[Column, Column]:
    """ST11: (status, retries) after one more failed attempt."""
    return F.when(retries + 1 >= RETRIES, FAILED).otherwise(PENDING), retries + 1


def after_attempt(status: Column, retries: Column, rate_limited: Column, retryable: Column) -> tuple[Column, Column]:
    """ST3: a rate limit spends no retry; a failure that can't be retried ends at once."""
    spent = F.when(rate_limited, retries).otherwise(retries + 1)
    return F.when(rate_limited | (retryable & (spent < RETRIES)), PENDING).otherwise(FAILED), spent


#: What a provider's message says of a limit's kind and place.
DAILY, TOKENS = ("REQUESTS_PER_DAY", "PER DAY", "RPD"), ("TOKENS_PER_MINUTE", "TPM")
OF_PROJECT, OF_CREDENTIAL = ("PROJECT",), ("API KEY", "API_KEY", "CREDENTIAL")


def rate_limit(code: Column, message: Column) -> tuple[Column, Column, Column]:
    """SC14: (limit type, scope, retryable) of a provider's error; type is null unless the code is 429, and all else is of the model."""
    said = F.upper(F.coalesce(message, F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(said, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(said, F.lit(words[0]))
    limited = F.coalesce(code == 429, F.lit(False))
    kind = F.when(has(*DAILY), "rpd").when(has(*TOKENS), "tpm").otherwise("rpm")
    scope = F.when(~limited, "model").when(has(*OF_PROJECT), "project").when(has(*OF_CREDENTIAL), "credential").otherwise("model")
    return F.when(limited, kind), scope, F.coalesce((code >= 500) | limited, F.lit(False))


def graph_error(error_class: Column) -> Column:
    """SC21: whether a graph store was unavailable, which leaves work pending, or refused a write."""
    return F.when(error_class.isin("ServiceUnavailable", "TransientError", "OSError", "ConnectionError"), "NEO4J_UNAVAILABLE").otherwise("NEO4J_WRITE_FAILED")


def quota_scope(provider: Column, project: Column, name: Column) -> Column:
    """SC15: credentials of one project share a quota."""
    return F.when(F.coalesce(project, F.lit("")) != "", F.concat(provider, F.lit(":project:"), project)).otherwise(F.concat(provider, F.lit(":credential:"), name))


def bucket_keys(scope: Column, model: Column) -> Column:
    """SC16: the three places where a cooldown for a scope and model may stand."""
    return F.array(scope, F.concat(scope, F.lit(":all-models")), F.concat(scope, F.lit(":model:"), model))


def failure_bucket(scope: Column, model: Column, limit_scope: Column) -> Column:
    return F.when(limit_scope == "model", F.concat(scope, F.lit(":model:"), model)).otherwise(F.concat(scope, F.lit(":all-models")))


def cooldown_until(now: Column, retry_after: Column) -> Column:
    """SC13: 60 seconds unless the provider says otherwise."""
    return now + F.make_interval(secs=F.coalesce(retry_after, F.lit(60)))


def utc_timestamp(text: Column) -> Column:
    """SC12: ISO-8601; without a zone it is UTC, whatever the session's zone; null if it is none."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = ~F.contains(text, F.lit(":")) | text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(day, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


#: Content types by suffix.
CONTENT_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".avif": "image/avif", ".ttf": "font/ttf", ".otf": "font/otf"}


def content_type(suffix: Column) -> Column:
    """SC18: null for other suffixes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair]), suffix)


def image_signature(content: Column, suffix: Column) -> Column:
    """SC19: whether the first bytes are those of the suffix's image kind."""
    begins = lambda at, hexed: F.substring(content, at, len(hexed) // 2) == F.unhex(F.lit(hexed))
    return (
        F.when(suffix == ".png", begins(1, "89504E470D0A1A0A")).when(suffix.isin(".jpg", ".jpeg"), begins(1, "FFD8FF"))
        .when(suffix == ".webp", begins(1, "52494646") & begins(9, "57454250")).when(suffix == ".avif", begins(5, "66747970") & F.hex(F.substring(content, 9, 24)).rlike("^(?:..)*?(?:61766966|61766973)"))
        .otherwise(False)
    )


def asset_error(content: Column, suffix: Column, kind: Column, limit: int = 2 * 1024 * 1024) -> Column:
    """FLT14: the first rule an upload breaks, or null."""
    image, font = suffix.isin(".png", ".jpg", ".jpeg", ".webp", ".avif"), suffix.isin(".ttf", ".otf")
    return (
        F.when(~F.when(kind == "image", image).otherwise(font), "ASSET_TYPE_UNSUPPORTED").when(F.length(content) == 0, "ASSET_EMPTY").when(F.length(content) > limit, "ASSET_TOO_LARGE")
        .when((kind == "image") & ~image_signature(content, suffix), "IMAGE_SIGNATURE_INVALID")
    )


def safe_record(kind: Column, asset_id: Column, stored: Column) -> Column:
    """FLT15: a known kind, an id, and a bare file name."""
    return F.coalesce(kind.isin("image", "font") & (asset_id != "") & (stored != "") & ~stored.rlike(r"[/\\]") & ~stored.isin(".", ".."), F.lit(False))
