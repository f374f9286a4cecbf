"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, jaccard, language, lines, quality, token_counts, toxicity, warc
from .common import crc_mod, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Language of each document: (doc_id, held_out, lang_pred, score), a row for each input row.

    A NULL text, or one without a letter, is 'und' with score 0; a NULL doc_id is not
    held out. Ties go to the first language in order. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.filter(~held_out), path or tokenizer("byte_bpe_multi_50k.tiktoken"))
    got = language.identify(docs, model).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: (doc_id, n_shingles, component_id), a row for each input row.

    A NULL or empty text has no shingles and is alone; a NULL doc_id is linked with
    nothing and has component NULL. Rows that repeat an id and a text are in one group.
    An empty table gives an empty one.
    """
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, removed words and verdict of each document, a row for each input row.

    A NULL text counts as empty and fails the base rules; documents with NULL source
    share one. Repeated rows are one document in the counts and each get the verdict.
    An empty table gives an empty one.
    """
    return lines.quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document: (doc_id, held_out, score, predicted), a row for each input row.

    A NULL text counts as empty; a NULL doc_id is not held out. With labels of one class
    or none the score is constant. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_texts(docs, model), 0.5)


def _scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids and round trip of each document as hashes: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each input row.

    A NULL text counts as empty, which has no tokens. An empty table gives an empty one.
    """
    return bpe.round_trip(table(spark, sf_dir, "documents"), path or tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and found again through the index by URL: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A NULL html is an empty payload, a NULL url is looked up as such. Of rows that repeat
    the smallest page_id of a payload all are responses; rows with NULL page_id revisit
    it. An empty table gives an empty one.
    """
    pages = table(spark, sf_dir, "pages")
    got = warc.read_records(warc.find_captures(pages, warc.archive_pages(pages)))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of each document: (doc_id, n_bytes, n_tokens, over_limit), a row for each input row.

    A NULL text counts as empty. An empty table gives an empty one.
    """
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path or tokenizer("word_bpe_49k.json"), limit=2048).withColumnRenamed("id", "doc_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page: (page_id, url, text, n_chars), a row for each input row.

    A NULL or empty html has an empty text; pages without host share one style tree.
    An empty table gives an empty one.
    """
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item, with the copies' number and least distance."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.count("*").alias("n_matches"), F.min("distance").alias("distance"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document: (doc_id, held_out, score, predicted), a row for each input row.

    A NULL text, or one without words, has the least score; a NULL doc_id is not held out.
    With labels of one class or none all scores are 0.5 or the least. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score_texts(docs, field), 0.3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_jaccard, op3_quality_rules, op4_toxicity, op5_bpe, op6_warc, op7_token_counts, op8_html_text, op9_decontamination, op10_quality)}


_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({{0}}, '{_SPACE}+'), lambda x: x <> '')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, d.m AS component_id FROM (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {_WORDS.format("text")} AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
marked AS (SELECT rid, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 8)) AS t(p) GROUP BY rid),
lines AS (SELECT * FROM (SELECT rid, doc_id, host, text, line, len({_WORDS.format("line")}) AS n, trim(regexp_replace(regexp_replace({_LOWER.format("line")}, '[0-9]+', '0', 'g'), '{_SPACE}+', ' ', 'g')) AS norm FROM (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE n > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT (doc_id, text)) AS docs FROM d GROUP BY host),
freq AS (SELECT l.host, l.norm FROM (SELECT host, norm, max(n) AS size, count(DISTINCT (doc_id, text)) AS c FROM lines GROUP BY ALL) l JOIN hosts ON l.host = hosts.host
WHERE c > least(CASE WHEN size <= 2 THEN 100 WHEN size >= 6 THEN 10 ELSE 20 END, greatest(4, docs / 2))),
gone AS (SELECT rid, sum(n) AS n FROM lines JOIN freq USING (host, norm) GROUP BY rid),
m AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed
FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN marked USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(removed AS BIGINT) AS removed_words,
n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed >= 0.5 * n_words AS kept FROM m"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(h), 5 * k + 1, 5) AS BIGINT) >> {0}) & 31), 1)"
OP6 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {" || ".join(_DIGIT.format(b) for b in (15, 10, 5, 0))}), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": OP2, "op3_quality_rules": OP3, "op6_warc": OP6}
