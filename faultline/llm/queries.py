"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bin_completion,
    chat_format,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    periodic_runs,
    pii,
    quality_rules,
    token_alignment,
    token_counts,
    vector_dedup,
    warc_store,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The vocabulary of byte_bpe_50k.json as ranks; its encoder gives the same ids in a quarter of the time.
PACKING_RANKS = "byte_bpe_50k.tiktoken"
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema
    )
    return chat_format.chat_digests(chat_format.chat_examples(turns.unionByName(probe)))


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer(PACKING_RANKS))


def op5_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), percent=85, width=4)


def op8_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op10_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(_table(spark, sf_dir, "embeddings"))


def op11_same_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_alignment.token_links(docs, tokenizer(PACKING_RANKS), tokenizer("piece_bpe_32k.model"))


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_completely(_table(spark, sf_dir, "documents"), tokenizer(PACKING_RANKS))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repetitions(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_boosted_pii,
        op2_chat_prefixes,
        op3_license_digests,
        op4_best_fit_packing,
        op5_heap_token_counts,
        op6_host_quality,
        op7_count_rtree_join,
        op8_warc_store,
        op9_raked_mixing,
        op10_pivot_vectors,
        op11_same_token_map,
        op12_bin_completion,
        op13_periodic_runs,
    )
}

OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant' OR i = n))::BIGINT AS n_examples
FROM o GROUP BY conv_id
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), repw AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id
), lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT w.doc_id, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repw.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repw USING (doc_id)
), r AS (
  SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 10 * n_symbols > n_words AS r3 FROM s
), h AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS f FROM (
    SELECT source, unnest([1, 2, 3]) AS rule, unnest([r1, r2, r3]) AS bad FROM r WHERE source IS NOT NULL)
  GROUP BY source, rule
), m AS (
  SELECT rule, least(greatest(avg(f / n), 1e-3), 1 - 1e-3) AS mean, var_pop(f / n) AS raw, var_pop(f / n) - mean * (1 - mean) * avg(1 / n) AS var FROM h GROUP BY rule
), k AS (
  SELECT rule, mean, least(greatest(CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 WHEN raw > 0 THEN 1e6 ELSE 2 END, 2), 1e6) AS wt FROM m
), v AS (
  SELECT source, (mean * wt + f) / (wt + n) AS rate, wt + n AS total FROM h JOIN k USING (rule)
), x AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5) AS rejected FROM v GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 OR r2) AS base_failed,
  NOT (r1 OR r2) AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected, r.source
FROM r LEFT JOIN x ON r.source = x.source
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id <> owner THEN owner END AS refers_to
FROM p
"""



OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], chr(32)) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON r.d = l.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(c) AS c FROM reach GROUP BY d) k ON k.d = documents.doc_id
"""


def _canonical_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for pattern in (license_scan.COPYRIGHT_LINE, license_scan.RESERVED_LINE):
        out = f"regexp_replace({out}, '{pattern}', chr(10), 'g')"
    for a, b in license_scan.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _license_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in sorted(license_scan.TEXTS.items()))
    return f"""
    WITH known AS (SELECT sha256({_canonical_sql("t")}) AS digest, min(id) AS license_id FROM (VALUES {known}) AS v(id, t) GROUP BY 1),
    d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS canonical_sha256 FROM documents)
    SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known ON digest = canonical_sha256
    """


def _mixing_sql(power: float = 0.7, fraction: float = 0.5, rounds: int = 12) -> str:
    dims = mixing.DIMS
    full = f"w >= tokens * {mixing.FULL!r}"
    parts = [
        r"""d AS (SELECT doc_id, source, lang,
          CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[0-9]{4}') THEN 'record'
            WHEN contains(coalesce(text, ''), chr(10)) THEN 'lines' ELSE 'prose' END AS topic,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        f"t AS (SELECT {fraction} * sum(tokens) AS wanted FROM c)",
    ]
    for x in dims:
        parts.append(f"m_{x} AS (SELECT {x}, sum(tokens) AS held, pow(sum(tokens), {power}) AS pull FROM c GROUP BY {x})")
        parts.append(f"k_{x}_0 AS (SELECT (SELECT wanted FROM t) / sum(pull) AS k FROM m_{x})")
        for i in range(rounds):
            k = f"(SELECT k FROM k_{x}_{i})"
            over = f"pull * {k} >= held * {mixing.FULL!r}"
            parts.append(
                f"k_{x}_{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN {over} THEN 0 ELSE pull END) > 0 THEN "
                f"((SELECT wanted FROM t) - sum(CASE WHEN {over} THEN held ELSE 0 END)) / sum(CASE WHEN {over} THEN 0 ELSE pull END) ELSE {k} END AS k FROM m_{x})"
            )
        parts.append(f"g_{x} AS (SELECT {x}, least(held, pull * (SELECT k FROM k_{x}_{rounds})) AS goal_{x} FROM m_{x})")
    joins = " ".join(f"JOIN g_{x} ON c.{x} IS NOT DISTINCT FROM g_{x}.{x}" for x in dims)
    parts.append(f"w0 AS (SELECT c.*, {', '.join(f'goal_{x}' for x in dims)}, tokens * {fraction} AS w FROM c {joins})")
    parts.append("e0 AS (SELECT 1.0 AS off)")
    n = 0
    for block in range(mixing.SWEEPS // mixing.BLOCK):
        for x in dims * mixing.BLOCK:
            s, f = (f"sum({v}) OVER (PARTITION BY {x})" for v in ("w", f"CASE WHEN {full} THEN w ELSE 0 END"))
            factor = f"CASE WHEN goal_{x} > s THEN greatest(1, coalesce((goal_{x} - f) / nullif(s - f, 0), 1)) ELSE coalesce(goal_{x} / nullif(s, 0), 1) END"
            parts.append(
                f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (w, s, f), CASE WHEN (SELECT off FROM e{block}) <= {mixing.TOLERANCE!r} THEN w ELSE least(tokens, w * {factor}) END AS w "
                f"FROM (SELECT *, {s} AS s, {f} AS f FROM w{n}))"
            )
            n += 1
        off = ", ".join(f"(SELECT sum(abs(s - g)) FROM (SELECT sum(w) AS s, min(goal_{x}) AS g FROM w{n} GROUP BY {x}))" for x in dims)
        parts.append(f"e{block + 1} AS MATERIALIZED (SELECT greatest({off}) / (SELECT wanted FROM t) AS off)")
    parts.append(f"p AS (SELECT source, lang, topic, round(coalesce(w / nullif(tokens, 0), 0), 9) AS probability FROM w{n})")
    return (
        "WITH " + ", ".join(parts) + " SELECT doc_id, d.source, d.lang, d.topic, n_tokens, probability, "
        "('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < probability AS sampled FROM d JOIN p "
        "ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic"
    )


ORACLE: dict[str, str] = {
    "op2_chat_prefixes": OP2_SQL,
    "op3_license_digests": _license_sql(),
    "op6_host_quality": OP6_SQL,
    "op7_count_rtree_join": OP7_SQL,
    "op8_warc_store": OP8_SQL,
    "op9_raked_mixing": _mixing_sql(),
}
