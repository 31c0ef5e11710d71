"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.llm import (
    decontaminate, exact, lines, packing, phrases, prefixes, quality, rules, secrets, sharding, simhash, sql, toxicity, warc,
)
from dateline.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    """The tokenizer file and its ranks, from the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(_table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write_archives(_table(spark, folder, "pages"), scratch_path(spark, "archives"))
    return warc.described(warc.read_records(index))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_shared_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assigned(_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), *tokenizer_files())


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.leaks(docs, benchmark).drop("mark")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.with_components(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[rule.kind for rule in secrets.BASE]))
    counts = [F.array_size(_of_kind(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans")
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.learned(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.judged(_table(spark, folder, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *base, "base_failed", "kept")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_nodes(_table(spark, folder, "conversations")).drop("node")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_prefix_trie": op13_prefix_trie,
}

_STRIP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"



def _spans_sql(place: int, rule: secrets.Rule) -> str:
    """One row a match: the matches and the gaps between them give the places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, start, start + length(m) AS stop
        FROM (SELECT doc_id, m, p, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS start
            FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps) AS p, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i
                FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs,
                    regexp_extract_all(text, '{pattern}', {rule.group}) AS ps FROM documents)))
        WHERE length(p) >= {rule.least}"""


_SPELLED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
SQL = {
    "op11_collocations": sql.COLLOCATIONS,
    "op13_prefix_trie": sql.PREFIX_NODES,
    "op1_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
        groups AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM normal n JOIN groups g ON n.norm = g.norm""",
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op9_secrets": f"""
        WITH found AS ({" UNION ALL ".join(_spans_sql(i, rule) for i, rule in enumerate(secrets.RULES))})
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            sha256(coalesce({_SPELLED} FILTER (place < {len(secrets.BASE)}), '')) AS base_sha256,
            coalesce({_SPELLED}, '') AS spans
        FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
            SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        shared AS (
            SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        judged AS (
            SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
            FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
