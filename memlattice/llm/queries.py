"""The numbered operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import alignment, exact_dedup, gif_media, importance, langid, neardup, ngram_lm, packing, rans_store, secret_scan, sharding, url_reputation, viterbi_pieces
from memlattice.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`; the held-out third is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.training_fold())
    return found.select("doc_id", (~langid.training_fold()).alias("held_out"), "lang_pred", "score", "rejected")


#: Fixed rules of the page filter.
URL_RULES = (
    url_reputation.Rule("net", "/", "block"),
    url_reputation.Rule("example.net", "/en/", "allow"),
    url_reputation.Rule("example.com", "/de/", "block"),
    url_reputation.Rule("org", "/fr/", "allow"),
)


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of `pages`; a page's outcome is the label of its number."""
    outcomes = url_reputation.page_outcomes(_table(spark, sf_dir, "labels"))
    found = url_reputation.judge_urls(_table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled")


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` stored as a GIF, read back and digested."""
    media = gif_media.media_from_texts(_table(spark, sf_dir, "documents"))
    return gif_media.digest_table(written(media, "media", compression="zstd"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of `documents` into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op5_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of `documents` on two-word shingles at 0.8."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts of `documents` under a model of six sevenths of them."""
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"), ngram_lm.training_fold())


def op7_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded to piece ids and decoded again."""
    return viterbi_pieces.encode_and_decode(_table(spark, sf_dir, "documents"))


def op8_rans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of `documents`, coded into files in doc_id order and read back."""
    return rans_store.encode_and_read(_table(spark, sf_dir, "documents"), end_id=2)


def op9_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in shards 0 to 7 of near-equal bytes, equal texts together."""
    docs = _table(spark, sf_dir, "documents")
    found = sharding.vector_shards(docs, 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of `documents`, refined by length, prefix hash and full hash."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of `documents`: the fixed patterns, and runs that the Markov models find random."""
    docs = _table(spark, sf_dir, "documents")
    weights = secret_scan.markov_weights(secret_scan.labelled_samples(docs))
    return secret_scan.scan_digest(docs, weights)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by bytes over all texts of `documents`."""
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of `documents` drawn towards the word runs of `benchmark`."""
    docs = _table(spark, sf_dir, "documents")
    target = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_centroid_language,
        op2_host_reputation,
        op3_gif_media,
        op4_best_two_fit,
        op5_minhash_components,
        op6_kneser_ney,
        op7_streaming_viterbi,
        op8_rans_store,
        op9_vector_shards,
        op10_exact_dedup,
        op11_markov_secrets,
        op12_token_alignment,
        op13_importance_resampling,
    )
}

def _secrets_sql() -> str:
    """The scan in SQL: rows for matches, windows for places, joins for weights."""
    kinds, ctes, rest = secret_scan.BASE, [], "texts"

    def matches(name: str, source: str, pattern: str, group: int) -> str:
        rx = pattern.replace("'", "''")
        return f"""{name}_lists AS (
            SELECT r, string_split_regex(t, '{rx}') AS parts, regexp_extract_all(t, '{rx}', 0) AS hits, regexp_extract_all(t, '{rx}', {group}) AS inner_parts
            FROM {source} WHERE regexp_matches(t, '{rx}')
        ), {name}_rows AS (
            SELECT r, parts[i] AS part, hits[i] AS hit, inner_parts[i] AS val, i, len(hits) AS m, parts[len(parts)] AS tail
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_lists)
        ), {name} AS (
            SELECT *, sum(length(part) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit) AS s, sum(length(part) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS e FROM {name}_rows
        )"""

    for rank, (name, pattern, group, least) in enumerate(kinds):
        ctes.append(matches(f"k{rank}", "texts", pattern, group))
        ctes.append(matches(f"b{rank}", rest, pattern, group))
        ctes.append(f"""rest{rank} AS (
            SELECT r, coalesce(blank, t) AS t FROM {rest} LEFT JOIN (
                SELECT r, string_agg(part || CASE WHEN length(val) >= {least} THEN repeat(' ', length(hit)) ELSE hit END, '' ORDER BY i) || any_value(tail) AS blank FROM b{rank} GROUP BY r
            ) USING (r))""")
        rest = f"rest{rank}"
    base = " UNION ALL ".join(f"SELECT r, {rank} AS rank, '{name}' AS kind, s, e, val FROM k{rank} WHERE length(val) >= {least}" for rank, (name, _, _, least) in enumerate(kinds))
    ctes.append(matches("added", rest, secret_scan.CANDIDATE, 0))
    return f"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        {", ".join(ctes)}, base AS ({base}),
        drawn AS (
            SELECT r, sha256('random:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM texts
            WHERE ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT < (SELECT ceil(least(1.0::DOUBLE, {secret_scan.SAMPLE_ROWS}::DOUBLE / greatest(count(*), 1)) * 4294967296) FROM documents)
        ), samples AS (
            SELECT digest AS v, true AS random FROM drawn UNION ALL SELECT to_base64(unhex(digest)), true FROM drawn
            UNION ALL SELECT val, true FROM base JOIN drawn USING (r)
            UNION ALL SELECT v, false FROM (SELECT unnest(regexp_extract_all(t, '{secret_scan.SHORT_RUN}', 0)) AS v FROM {rest} JOIN drawn USING (r)) WHERE length(v) <= {secret_scan.LONGEST_SHORT}
        ), moved AS (
            SELECT random, CASE WHEN i = 1 THEN '' ELSE substr(v, i - 1, 1) END AS a, substr(v, i, 1) AS b, n
            FROM (SELECT *, unnest(range(1, length(v) + 1)) AS i FROM (SELECT v, random, count(*) AS n FROM samples WHERE regexp_full_match(v, '[A-Za-z0-9+/_=-]+') GROUP BY ALL))
        ), letters AS (
            SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS b
        ), every AS (
            SELECT a, letters.b, kind FROM (SELECT b AS a FROM letters UNION ALL SELECT ''), letters, (VALUES (true), (false)) AS k (kind)
        ), counted AS (
            SELECT e.a, e.b, e.kind, coalesce(sum(n), 0) AS n FROM every e LEFT JOIN moved m ON m.a = e.a AND m.b = e.b AND m.random = e.kind GROUP BY ALL
        ), seen AS (
            SELECT b, kind, sum(n) + {secret_scan.SMOOTHING}::DOUBLE AS n FROM counted GROUP BY b, kind
        ), leaned AS (
            SELECT b, kind, n / sum(n) OVER (PARTITION BY kind) AS own FROM seen
        ), shares AS (
            SELECT a, b, kind, (n + {secret_scan.LEAN}::DOUBLE * own) / (sum(n) OVER (PARTITION BY a, kind) + {secret_scan.LEAN}::DOUBLE) AS p FROM counted JOIN leaned USING (b, kind)
        ), weights AS (
            SELECT x.a, x.b, floor(1000 * ln(x.p / y.p))::BIGINT AS w FROM shares x JOIN shares y USING (a, b) WHERE x.kind AND NOT y.kind
        ), scored AS (
            SELECT v, sum(w) AS score FROM (
                SELECT v, CASE WHEN i = 1 THEN '' ELSE substr(v, i - 1, 1) END AS a, substr(v, i, 1) AS b
                FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM (SELECT DISTINCT hit AS v FROM added WHERE regexp_matches(hit, '[A-Za-z]')))
            ) JOIN weights USING (a, b) GROUP BY v
        ), spans AS (
            FROM base UNION ALL SELECT r, {len(kinds)}, '{secret_scan.ADDED}', s, e, hit FROM added JOIN scored ON hit = v WHERE score > {secret_scan.MARGIN}
        ), found AS (
            SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_markov,
                   string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (rank < 3) AS b, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) AS a
            FROM spans GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov,
               sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
        FROM texts LEFT JOIN found USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op2_host_reputation": """
        WITH parts AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), worst AS (
            SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN coalesce(toxic, quality) IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1
        ), hosts AS (
            SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k,
                   array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix
            FROM split LEFT JOIN worst USING (page_id) GROUP BY host
        ), domains AS (
            SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
        ), suffixes AS (
            SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL
        ), overall AS (
            SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM suffixes
        ), s0 AS (
            SELECT suffix, n, k, m AS parent FROM suffixes, overall
        ), r0 AS (
            SELECT least(greatest(coalesce((sum(n * (k / n - parent) ** 2) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.001), 0.001), 0.5) AS rho FROM s0 WHERE n > 0
        ), s1 AS (
            SELECT domain, d.suffix, d.n, d.k, (s0.k + (1 - rho) / rho * s0.parent) / (s0.n + (1 - rho) / rho) AS parent FROM domains d JOIN s0 USING (suffix), r0
        ), r1 AS (
            SELECT least(greatest(coalesce((sum(n * (k / n - parent) ** 2) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.001), 0.001), 0.5) AS rho FROM s1 WHERE n > 0
        ), s2 AS (
            SELECT host, h.n, h.k, (s1.k + (1 - rho) / rho * s1.parent) / (s1.n + (1 - rho) / rho) AS parent FROM hosts h JOIN s1 USING (domain, suffix), r1
        ), r2 AS (
            SELECT least(greatest(coalesce((sum(n * (k / n - parent) ** 2) - sum(parent * (1 - parent))) / nullif(sum(parent * (1 - parent) * (n - 1)), 0), 0.001), 0.001), 0.5) AS rho FROM s2 WHERE n > 0
        ), beta AS (
            SELECT host, n, k + (1 - rho) / rho * parent AS a, n - k + (1 - rho) / rho * (1 - parent) AS b FROM s2, r2
        ), ruled AS (
            SELECT page_id, split.host, path, coalesce(n, 0)::BIGINT AS n_labelled,
                   coalesce(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) > 0.5 AS bad,
                   CASE WHEN ('.' || split.host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                        WHEN ('.' || split.host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                        WHEN ('.' || split.host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                        WHEN ('.' || split.host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
            FROM split LEFT JOIN beta ON split.host = beta.host
        )
        SELECT page_id, host, path, rule, n_labelled,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_markov_secrets": _secrets_sql(),
}
