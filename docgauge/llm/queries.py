"""The operators of this subpackage as queries over the shared tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.tokens import token_counts

    return token_counts(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.packing import pack

    return pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.substrings import without_repeats

    kept = without_repeats(_documents(spark, sf_dir), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.quality import quality

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(_documents(spark, sf_dir)).select(*columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), words=3)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.pii import TYPES, with_surrogates

    # A demonstration key; real runs pass their own.
    made = with_surrogates(_documents(spark, sf_dir), key=b"docgauge demonstration key")
    count = lambda kind: F.size(F.filter("entities", lambda e: e["type"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select("doc_id", *[count(kind) for kind in TYPES], "text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.secret_scan import find_secrets

    open_ = F.filter("spans", lambda s: s["layers"] == "")
    count = lambda kind: F.size(F.filter(open_, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = lambda s: F.when(s["layers"] == "", s["kind"]).otherwise(F.concat_ws("/", s["layers"], s["kind"]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    found = find_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(open_), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.lines import without_repeated_lines

    kept = without_repeated_lines(_documents(spark, sf_dir), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.decontam import contaminated

    return contaminated(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.lmscore import backoff_scores

    scores = backoff_scores(_documents(spark, sf_dir), order=3, alpha=0.4)
    return scores.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.whitening import whitened

    made = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.resample import resampled

    return resampled(_documents(spark, sf_dir), _benchmark(spark, sf_dir), run=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgauge.llm.stage import new_path
    from docgauge.llm.warc import through_archives

    return through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "archives"), least=100).drop("error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_warc": op13_warc,
}

#: White space at the ends, as RE2 writes it.
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

_LINES = rf"""
lines AS (
  SELECT doc_id, line, position,
         translate(regexp_replace(line, '{_ENDS}', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position
        FROM documents)
),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)"""

#: CRC-32 of the words of a table w(word), by bytes and a table of 256 made by rule.
_CRC = r"""
steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(word)) + 1), lambda k: ('0x' || substr(hex(encode(word)), 2 * k - 1, 2))::BIGINT)),
                               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), steps
)"""

ORACLE_SQL: dict[str, str] = {
    "op12_importance_resampling": rf"""
WITH split AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM documents
  UNION ALL
  SELECT 1, 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
words AS (SELECT side, row, unnest(list) AS word FROM split),
{_CRC},
placed AS (SELECT w.side, w.row, h.bucket FROM words w JOIN hashed h ON w.word = h.word),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counts) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts
),
weighed AS (
  SELECT s.row, s.doc_id, len(s.list) AS n_features, CAST(coalesce(floor(sum(g.gain) / count(g.gain)), 0) AS BIGINT) AS weight
  FROM split s LEFT JOIN placed p ON s.side = p.side AND s.row = p.row LEFT JOIN gains g ON p.bucket = g.bucket
  WHERE s.side = 0 GROUP BY s.row, s.doc_id, len(s.list)
),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM weighed
),
ordered AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS rank FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN o.rank <= (SELECT count(*) FROM ordered) * 10 // 100 THEN o.rank END AS rank
FROM scored s LEFT JOIN ordered o ON s.row = o.row""",
    "op13_warc": r"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM digests
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM firsts""",
    "op10_lm_scoring": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
words AS (
  SELECT doc_id, len(words) AS n_words, place, words[place] AS g1,
         CASE WHEN place > 1 THEN words[place - 1] || ' ' || words[place] END AS g2,
         CASE WHEN place > 2 THEN words[place - 2] || ' ' || words[place - 1] || ' ' || words[place] END AS g3
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM split)
),
others AS (
  SELECT doc_id, place, (SELECT count(*) FROM words) - n_words AS c0,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
         CASE WHEN place > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) END AS c2,
         CASE WHEN place > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) END AS c3
  FROM words
),
histories AS (
  SELECT *, lag(c1) OVER before AS h1, lag(c2) OVER before AS h2 FROM others WINDOW before AS (PARTITION BY doc_id ORDER BY place)
),
scored AS (
  SELECT doc_id,
         CASE WHEN c3 > 0 THEN ln(c3 / h2)
              WHEN c2 > 0 THEN ln(c2 / h1) + CASE WHEN place > 2 THEN ln(0.4) ELSE 0 END
              ELSE CASE WHEN c1 > 0 THEN ln(c1 / c0) ELSE -ln(c0 + 1) END + least(place - 1, 2) * ln(0.4) END AS score,
         CASE WHEN place = 1 OR c3 > 0 OR (place = 2 AND c2 > 0) THEN 0 ELSE 1 END AS backed
  FROM histories
)
SELECT s.doc_id, len(s.words) AS n_words, CAST(coalesce(sum(d.backed), 0) AS BIGINT) AS n_backed_off,
       round(coalesce(sum(d.score), 0), 5) AS log_score, round(sum(d.score) / nullif(len(s.words), 0), 6) AS mean_log_score
FROM split s LEFT JOIN scored d ON s.doc_id = d.doc_id
GROUP BY s.doc_id, len(s.words)""",
    "op2_substring_dedup": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 19], ' ') AS sequence
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS place FROM split)
),
later AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY sequence ORDER BY doc_id, place) AS n FROM windows) WHERE n > 1
),
covered AS (
  SELECT DISTINCT doc_id, place + step AS place FROM later, range(20) AS steps(step)
),
each_word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) AS text, count(*) AS n
  FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.place = c.place
  WHERE c.place IS NULL GROUP BY e.doc_id
)
SELECT s.doc_id, len(s.words) AS n_words, len(s.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
    "op8_line_dedup": f"""
WITH {_LINES}
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.first_doc < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.position) FILTER (WHERE f.first_doc IS NULL OR f.first_doc >= l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON l.key = f.key
GROUP BY l.doc_id""",
}
