"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import best_position, exact_dedup, knn_quality, line_index, minhash, mixture, packing, periodic_runs, phrase_dedup, pseudonyms, rank_language, secret_ledger, simhash
from palimpsest.llm.common import documents, table


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labelled texts that are not held out."""
    docs = documents(spark, sf_dir)
    return knn_quality.score(docs, knn_quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal values, and how many of each kind it has."""
    return pseudonyms.pseudonymise(documents(spark, sf_dir))


def op4_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return rank_language.identify(docs, rank_language.profiles(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component of near copies."""
    return simhash.near_groups(documents(spark, sf_dir))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's calibrated weight, its probability and whether it is drawn."""
    return mixture.mix(documents(spark, sf_dir))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 400 bytes."""
    return phrase_dedup.summary(phrase_dedup.deduplicated(documents(spark, sf_dir)), with_text=True)


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spans of its secrets, scanned once for each distinct text."""
    return secret_ledger.secrets(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that of the next document."""
    return minhash.edited_fingerprints(documents(spark, sf_dir))


def op11_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of smaller id holds too."""
    return line_index.summary(line_index.deduplicated(documents(spark, sf_dir)))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """`docs` in which, from word a on, every tenth id's text goes on in a period of p of its own words (a, p by the id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, periodic_runs.words_of(F.col("text")))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("g % n"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    said = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("n") > 0, said).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of words, and its text with each run cut to one period."""
    return periodic_runs.summary(periodic_runs.collapsed(_with_periodic_tails(documents(spark, sf_dir))))


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return best_position.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn_quality": op1_knn_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_rank_language": op4_rank_language,
    "op5_simhash": op5_simhash,
    "op6_mixture": op6_mixture,
    "op7_phrase_dedup": op7_phrase_dedup,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash": op10_minhash,
    "op11_line_index": op11_line_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_position": op13_best_position,
}

#: Pattern, group that must have so many characters, and the places of its matches, in SQL.
_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    ("assign", _ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
]
_SECRETS = " UNION ALL ".join(
    f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
           (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
           length(m[i]) AS n, length(v[i]) >= {least} AS ok
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
               string_split_regex(text, '{pattern}') AS p
        FROM d))"""
    for rank, (kind, pattern, group, least) in enumerate(_KINDS)
)
_SECRET_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT doc_id, rank, kind, start, concat(kind, ':', start, ':', start + n) AS span FROM ({_SECRETS}) WHERE ok),
    g AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
        FROM s GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op8_secret_ledger": _SECRET_SQL,
    "op11_line_index": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        k AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ),
        f AS (SELECT key, min(doc_id) AS keep_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > keep_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep_id IS NULL OR doc_id = keep_id), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY doc_id
    """,
    "op13_best_position": r"""
        WITH parts AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ),
        d AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY doc_id),
        s AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM d),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        t AS (SELECT term, doc_id, count(*) AS tf FROM parts SEMI JOIN q USING (term) GROUP BY term, doc_id),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
        r AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // terms))))::BIGINT AS score
            FROM q JOIN t USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 50
    """,
}
