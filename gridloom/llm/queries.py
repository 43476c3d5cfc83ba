"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import repair_chats
from .common import table
from .exact_dedup import exact_dedup
from .licences import licences
from .lm import lm_scores
from .mixing import mix_rates
from .near_dedup import near_dedup
from .quality import quality_rules
from .secrets import secrets
from .segment import sampled_segmentations
from .substrings import repeated_substrings


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


#: Domains of the labelled documents and the shares of the tokens that they are to have.
DOMAINS = ("clean", "poor", "toxic")
SHARES = (0.94, 0.05, 0.01)


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain.alias("domain"))


def op5_mix_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), DOMAINS, SHARES)


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: they are laid out as source/language/document; short ones with a licence are licence files."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return licences(docs, "doc_id", "path", "text", F.col("n_chars") < 400)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of each text, each with a digest of what it decodes to; the last one's also beside them."""
    rows = sampled_segmentations(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "samples", F.size("samples").cast("long").alias("n_samples"), "decoded_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


# What of the above SQL can say: the contracts' base columns, targets and round trips, of the same operators over the same tables.


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def mix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rates make of each domain's tokens, as parts of all of them: the targets."""
    rows = op5_mix_rates(spark, sf_dir)
    sums = rows.agg(*[(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens")).alias(d) for d in DOMAINS], F.min("rate").alias("least"))
    return sums.select(*[F.round(d, 3).alias(d) for d in DOMAINS], (F.col("least") >= 0).alias("nonnegative"))


def base_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_repeated_substrings(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def segment_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sample of a text decodes to."""
    rows = op9_segmentations(spark, sf_dir)
    return rows.select("doc_id", F.array_distinct(F.transform("samples", lambda x: x["decoded_sha256"])).alias("d")).select("doc_id", F.array_join("d", ",").alias("decoded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_repair": op1_chat_repair,
    "op2_quality_rules": op2_quality_rules,
    "op3_secrets": op3_secrets,
    "op4_lm_scores": op4_lm_scores,
    "op5_mix_rates": op5_mix_rates,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_licences": op7_licences,
    "op8_near_dedup": op8_near_dedup,
    "op9_segmentations": op9_segmentations,
    "op10_exact_dedup": op10_exact_dedup,
    "base_quality": base_quality,
    "base_secrets": base_secrets,
    "base_lm": base_lm,
    "mix_totals": mix_totals,
    "base_substrings": base_substrings,
    "segment_round_trip": segment_round_trip,
}

ORACLES: dict[str, str] = {
    "base_quality": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
        k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
        o AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o
    """,
    "base_secrets": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least, string_split_regex(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gap, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS own FROM d
              UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
              UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d),
        e AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(m) + 1)) AS i, gap, m, own FROM a),
        f AS (SELECT doc_id, kind, rank, least, length(own[i]) AS size, i, length(m[i]) AS n, length(gap[i]) AS before FROM e),
        s AS (SELECT *, sum(before + n) OVER (PARTITION BY doc_id, kind ORDER BY i) - n AS start FROM f),
        h AS (SELECT * FROM s WHERE size >= least),
        o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans FROM h GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN o USING (doc_id)
    """,
    "base_lm": r"""
        WITH RECURSIVE r AS (SELECT i, i AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM r WHERE n < 8),
        z AS (SELECT list(c ORDER BY i) AS z FROM r WHERE n = 8),
        d AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, z[xor(c & 255, b) + 1])), 4294967295) % 10 = 0 AS held_out,
              list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS w FROM documents, z),
        t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
        c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        s AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 3) AS base_score
        FROM t LEFT JOIN c USING (w), s GROUP BY doc_id, held_out, n
    """,
    "mix_totals": "SELECT CAST(0.94 AS DOUBLE) AS clean, CAST(0.05 AS DOUBLE) AS poor, CAST(0.01 AS DOUBLE) AS toxic, TRUE AS nonnegative",
    "base_substrings": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        x AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 399)) AS i, h FROM d WHERE len(h) >= 800),
        k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM x),
        y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
        j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM y),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM j),
        s AS (SELECT doc_id, g, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, g),
        q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS b FROM s),
        u AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (lo - b) AS BIGINT)), '' ORDER BY lo) || substr(any_value(h), CAST(2 * max(hi) + 1 AS BIGINT)) AS rest FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id)
    """,
    "segment_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded FROM documents",
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
        s AS (SELECT doc_id, unnest(g) AS s, len(g) AS n FROM g),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE 100 * k >= 85 * (nx + ny - k)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS pos, doc_id AS root FROM g UNION SELECT e.y, r.root FROM r JOIN e ON r.pos = e.x),
        m AS (SELECT pos AS doc_id, min(root) AS component_id FROM r GROUP BY pos)
        SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept,
               CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(g, '|'))) END AS class_id
        FROM g JOIN m USING (doc_id)
    """,
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}
