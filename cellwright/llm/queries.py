"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import classifier, collocations, exact, html, licenses, mixing, pii, repeats, rules, search, simhash, substrings, tokens
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(tokens.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("found")


_WORD, _SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
_DOCS = f"docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents)"

OP2_SQL = f"""
WITH RECURSIVE {_DOCS},
sized AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(text))) AS ord FROM docs),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sums),
total AS (SELECT sum(source_size) AS t FROM sums),
levels(n, level) AS (
  SELECT 0, CAST(-1 AS DOUBLE)
  UNION ALL
  SELECT n + 1, (SELECT ((SELECT t FROM total) - coalesce(sum(cap) FILTER (cap <= w * level), 0)) / CAST(nullif(sum(w) FILTER (cap > w * level), 0) AS DOUBLE) FROM weighed)
  FROM levels WHERE level IS NOT NULL AND n <= (SELECT count(*) FROM weighed)),
level AS (SELECT max(level) AS level FROM levels),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * level) AS target FROM weighed, level),
placed AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((SELECT sum(greatest(0, least(size, floor(target) - ahead - p * source_size))) FROM (VALUES (0), (1), (2)) x(p)) AS BIGINT) AS taken
FROM placed
"""

OP4_SQL = f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def _rule_sql() -> str:
    tests = []
    for _, measure, least, most in rules.THRESHOLDS:
        if least is not None:
            tests.append(f"{measure} >= {least}")
        if most is not None:
            tests.append(f"{measure} <= {most}")
    return " AND ".join(tests)


OP6_SQL = f"""
WITH {_DOCS},
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM docs),
win AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 2, 0) + 1)) AS i, words FROM docs),
spelled AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS w FROM win),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM spelled) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: list_contains({rules.STOP_WORDS!r}, lower(w)))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda l: rtrim(l, ' ') LIKE '%...' OR rtrim(l, ' ') LIKE '%…')) AS n_ellipsis_lines,
    len(list_filter(lines, lambda l: regexp_matches(ltrim(l, ' '), '^[-*•]'))) AS n_bullet_lines
  FROM docs JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipsis_line_share,
    CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END AS bullet_line_share
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rule_sql()} AS kept FROM shares
"""

OP10_SQL = f"""
WITH {_DOCS},
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 49, 0) + 1)) AS i FROM docs)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(50)) AS k)),
spelled AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM spelled ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP11_SQL = f"""
WITH found AS (SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS terms FROM documents),
sizes AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM found),
wanted AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term FROM benchmark),
tfs AS (SELECT doc, doc_id, n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM found) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
dfs AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, sizes GROUP BY term),
scored AS (SELECT item_id, wanted.text, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN tfs USING (term) JOIN dfs USING (term), sizes GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= {search.TOP}
"""

_ENDS = r"[.,;:!?\x0A-\x0D]"

OP12_SQL = f"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, part FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_ENDS}')) AS part FROM documents)),
worded AS (SELECT lang, piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS words FROM pieces),
spots AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
spelled AS (SELECT lang, k AS n_words, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3)) x(k) WHERE i + k - 1 <= len(words)),
counts AS (SELECT lang, n_words, phrase, count(*) AS f FROM spelled GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE n_words = 1 GROUP BY lang),
found AS (SELECT lang, phrase, n_words, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE n_words > 1 AND f >= {collocations.LEAST}),
longer AS (SELECT lang, array_to_string(words[i:i + 1], ' ') AS phrase, max(a) AS most FROM found, (VALUES (1), (2)) x(i) WHERE n_words = 3 GROUP BY ALL),
kept AS (SELECT found.* FROM found LEFT JOIN longer USING (lang, phrase) WHERE n_words = 3 OR most IS NULL OR 100 * most < 50 * a),
cuts AS (SELECT kept.lang, kept.phrase, a, k, h.f AS l, t.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM kept, (VALUES (1), (2)) x(k), counts h, counts t
  WHERE k < kept.n_words AND h.lang = kept.lang AND t.lang = kept.lang AND h.phrase = array_to_string(words[1:k], ' ') AND t.phrase = array_to_string(words[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_mixing, op3_pii, op4_exact_dedup, op5_simhash, op6_quality_rules, op7_quality_classifier, op8_html_extraction, op9_suffix_dedup, op10_substring_dedup,
        op11_lexical_search, op12_collocations, op13_licenses)
}
ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
