"""Registered queries of the operators over the test tables, with their contracts' columns, and their SQL twins."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import alignment, bpe, byte_bpe, exact_dedup, hmm_lm, language_id, license_scan, near_dedup, packing, periodic_runs, quality_rules, toxicity, url_filter
from riskloom.llm.common import divisible, table

BYTE_BPE, WORD_BPE, RANKED_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder)).withColumnRenamed("digest", "text_sha256")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language_id.identify(documents(spark, folder), ~divisible("doc_id", 5))
    return found.withColumn("held_out", divisible("doc_id", 5))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), vocabulary(BYTE_BPE))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, folder), words=2)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), vocabulary(WORD_BPE))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_lm.fit_and_score(documents(spark, folder), ~divisible("doc_id", 10)).withColumnRenamed("trained", "held_out").withColumn("held_out", ~F.col("held_out"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.clean(documents(spark, folder))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.classify(documents(spark, folder), table(spark, folder, "labels"), ~divisible("doc_id", 5))
    return found.withColumn("held_out", divisible("doc_id", 5)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: Words of hosts that the list of the production query names, wherever they stand as a label.
LISTED_LABELS = ("cheap-pills", "free-bets", "spam-farm")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """The list of the production query: from each listed label on, the hosts that the table has."""
    host = url_filter.host_of(F.col("url"))
    names = pages.select(F.explode(url_filter.parents(host)).alias("host")).where(F.element_at(F.split("host", r"\."), 1).isin(*LISTED_LABELS))
    return names.distinct()


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, listed_hosts(pages))


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row of ``op11``: of one document in ten, all from some place on repeat with some period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.summary(documents(spark, folder), change=with_period)


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, folder), vocabulary(RANKED_BPE))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(documents(spark, folder), vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_language_id, op4_bpe, op5_near_dedup, op6_packing, op7_lm_scoring,
                                   op8_quality_rules, op9_toxicity, op10_url_filter, op11_periodic_runs,
                                   op12_byte_bpe, op13_alignment)}

_OP1 = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)"""

_LABELS = ", ".join(f"'{x}'" for x in LISTED_LABELS)
_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
_OP10 = rf"""WITH u AS (SELECT page_id, coalesce(contains(url, '://'), false) AS whole,
  substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, CASE WHEN whole THEN translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) ELSE '' END AS host,
  CASE WHEN whole THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(name, verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)}),
f AS (SELECT page_id, host, path, name, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
l AS (SELECT page_id, list_has_any(string_split(host, '.'), [{_LABELS}]) AS listed FROM p)
SELECT p.page_id, p.host, p.path, f.name AS rule, coalesce(f.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM p JOIN l USING (page_id) LEFT JOIN f ON f.page_id = p.page_id AND f.n = 1"""

ORACLES = {"op1_exact_dedup": _OP1, "op10_url_filter": _OP10}
