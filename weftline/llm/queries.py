"""The queries of this package and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, line_dedup, media, near_dedup, packing, periodic, secrets, suffix_dedup, token_counts, toxicity, url_filters, whitening
from .shared import WORD, let, materialise, shared_dir, table

#: The vocabulary of the token queries; operators take any path.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


#: The rules of the url query: host, beginning of the path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"), secrets.Scanner(secrets.example_credentials()))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_secret_scans that fixed patterns define, which SQL can find as well."""
    return op4_secret_scans(spark, sf_dir).drop("spans")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by way of inserts, a third of them with an estimated count, their revision by the true
    counts, deletes of a fifth and their return; each batch is sent twice, as by a retry, and the second is left alone.
    """
    store = token_counts.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    rows = materialise(token_counts.counted(table(spark, sf_dir, "documents"), "byte_bpe_50k", RANKS, PATTERN, also=("doc_id",)), "counted")
    part = lambda n: F.coalesce(F.pmod("doc_id", F.lit(n)) == 0, F.lit(False))
    estimated = rows.withColumn("n_tokens", F.when(part(3), F.ceil(F.col("n_chars") / 4)).otherwise(F.col("n_tokens")))
    gone = rows.filter(part(5))
    batches = {"inserts": estimated, "revised": token_counts.revised(estimated.filter(part(3)), rows.filter(part(3))), "deletes": token_counts.deleted(gone), "back": gone}
    for name, batch in batches.items():
        store.commit(name, batch)
        store.commit(name, batch)
    return store.totals()


def token_rollup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op6_token_counts that SQL can take: documents and characters behind the same batches."""
    return op6_token_counts(spark, sf_dir).select("source", "lang", "n_docs", "n_chars")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("line_dedup.lines").cast("long").alias("n_lines"), F.col("line_dedup.removed_lines").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline does it: also passages of one line or few, and of sentences, which the SQL of op9_line_dedup leaves."""
    found = line_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("line_dedup.units").alias("n_units"), F.col("line_dedup.removed_units").alias("n_removed"), F.col("line_dedup.removed_words").alias("words_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "whitening.*")
    each = found.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("values", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.values").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, chosen by crc32 of the id, repeat a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda at: F.array_join(F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, at["a"] + (i - at["a"]) % at["p"]))), " "))

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    made = let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, made).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "periodic.*")
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), ""))
    placed = found.withColumn("first", first)
    return placed.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.period")).alias("period"),
        F.floor(F.col("first.length") * 1000 / -F.col("first.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, PATTERN, 2048, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_secret_scans": op4_secret_scans,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_media_columns": op7_media_columns,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit_packing": op13_best_fit_packing,
    "secret_base_spans": secret_base_spans,
    "token_rollup_documents": token_rollup_documents,
}

#: Kind, pattern and least length of base spans; letters of the keywords stand in both cases, as (?i) would also fold U+017F.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BASE_KINDS = (("assign", _ASSIGN, f"length(regexp_extract(m, $${_ASSIGN}$$, 1)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24"))
_MARKED_SQL = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, string_split(regexp_replace(t, $$({p})$$, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM texts" for k, (_, p, _) in enumerate(_BASE_KINDS))
_LONG_ENOUGH_SQL = " ".join(f"WHEN {k} THEN {test}" for k, (_, _, test) in enumerate(_BASE_KINDS))
_KIND_SQL = ", ".join(f"'{kind}'" for kind, _, _ in _BASE_KINDS)

_URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_URL_RULES_SQL}),
        urls AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
            FROM pages),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
            FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.n = 1""",
    "op9_line_dedup": f"""
        WITH split AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        numbered AS (SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM split),
        hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM numbered),
        cut AS (SELECT *, (h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 17) % {line_dedup.DIVISOR} = 0 AS ends FROM hashed),
        placed AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM cut),
        chunk AS (SELECT doc_id, no, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')) AS full_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM placed GROUP BY doc_id, no),
        ranked AS (SELECT *, CASE WHEN full_lines >= 2 THEN row_number() OVER (PARTITION BY body ORDER BY doc_id, no) ELSE 1 END AS place FROM chunk)
        SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE place > 1), 0)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE place = 1), '')) AS kept_sha256
        FROM ranked GROUP BY doc_id""",
    "secret_base_spans": f"""
        WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '~~') AS t FROM documents),
        marked AS ({_MARKED_SQL}),
        part AS (SELECT doc_id, k, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM marked),
        placed AS (SELECT doc_id, k, i, split_part(x, chr(2), 1) AS m, coalesce(sum(length(x) - (i > 1)::INT) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM part),
        spans AS (SELECT doc_id, k, a, [{_KIND_SQL}][k + 1] || ':' || a || ':' || (a + length(m)) AS span FROM placed WHERE i > 1 AND CASE k {_LONG_ENOUGH_SQL} END)
        SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
               sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE span IS NOT NULL), '')) AS base_sha256
        FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id""",
    "token_rollup_documents": "SELECT source, lang, count(*) AS n_docs, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents GROUP BY source, lang",
}
