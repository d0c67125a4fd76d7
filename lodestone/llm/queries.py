"""The thin queries over the corpus tables: each applies an operator, with production
parameters, to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Path of the byte-level BPE vocabulary, a file of an installed library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shingle=5, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _remainder(3) == 1)
    out = identify_languages(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_in_batches

    return remove_in_batches(_table(spark, sf_dir, "documents"), width=13, digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _remainder(4) == 2)
    out = score_toxicity(docs, _table(spark, sf_dir, "labels"), ~F.col("held_out"), keep=("doc_id", "held_out"), threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted", "n_misspelt")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", F.col("model").alias("model_language"), "ppl_low", "ppl_high")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source and language are the directories, and a document that is
    little else than a license is a license file."""
    from .licenses import scan_licenses

    part = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in ("source", "lang", "doc_id")]
    files = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", *part))
    return scan_licenses(files, keep=("doc_id", "path"), license_file=F.col("mostly_license"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), _remainder(7) != 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"'[^\x20\x09-\x0D]+'"

#: The SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM b WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM k)),
g AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM k) WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS m FROM g JOIN i USING (k, gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, m AS n_shared, m / n AS containment FROM s JOIN n USING (item_id) WHERE 100 * m >= 80 * n
""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[p:p + 1], ' ')) AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, component) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, component FROM r JOIN e ON node = a),
c AS (SELECT node AS doc_id, min(component) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM w JOIN f USING (win) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS m FROM x GROUP BY doc_id) USING (doc_id)
""",
}
