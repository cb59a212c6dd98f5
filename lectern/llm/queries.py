"""The contract queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import class_model, fill_middle, hard_negatives, license_scan, mixing, quality, sentence_pieces, token_counts, token_shards, top_k
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.near_dedup import near_dedup
from lectern.llm.scratch import Scratch, read
from lectern.llm.url_filter import Rule, filter_urls

RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-shards').root}/shards"
    token_shards.write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_shards.read_documents(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept; then three edits a document: a cut at a third, an insertion, an added last line."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    trees = token_counts.saved_trees(read(spark, sf_dir, "documents"), path)
    n = F.length("text")
    cut = F.struct(F.floor(n / 3).alias("start"), F.lit(12).alias("length"), F.lit("").alias("insert"))
    put = F.struct(F.floor(n / 2).alias("start"), F.lit(0).alias("length"), F.lit("'s [2 notes] ").alias("insert"))
    end = F.struct(n.cast("long").alias("start"), F.lit(0).alias("length"), F.lit("\nThe end.").alias("insert"))
    return token_counts.count_edited(trees.withColumn("edits", F.array(cut, put, end)), path)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


def op11_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.class_scores(read(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every hundredth id; the label of every seventh id is taken for the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_shards": op4_token_shards,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_near_dedup": op10_near_dedup,
    "op11_class_model": op11_class_model,
    "op12_fill_middle": op12_fill_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)



def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{license_scan.COPYRIGHT_LINE}', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
    for old, new in license_scan.SPELLINGS:
        out = rf"regexp_replace({out}, '\b{old}\b', '{new}', 'g')"
    return out


_KNOWN_ROWS = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in license_scan.KNOWN.items() for text in texts
)

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        ) WHERE rank <= 5
    """,
    "op2_license_scan": f"""
        WITH known AS (
            SELECT min(license) AS license, sha256(c) AS digest
            FROM (SELECT license, {_canonical_sql("text")} AS c FROM (VALUES {_KNOWN_ROWS}) AS k(license, text))
            WHERE c <> '' GROUP BY sha256(c)
        ),
        units AS (
            SELECT doc_id, 0 AS line_no, text FROM documents
            UNION ALL
            SELECT doc_id, CAST(line_no AS INTEGER), lines[line_no]
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, 1 + len(lines)) AS r(line_no)
        ),
        digests AS (SELECT doc_id, line_no, sha256({_canonical_sql("text")}) AS digest FROM units)
        SELECT doc_id, line_no, license, digest FROM digests JOIN known USING (digest)
    """,
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS place,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ),
        s AS (
            SELECT *, 3 * source_size AS cap,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
        ),
        levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
            FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        final AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE cap >= weight * level),
        t AS (
            SELECT source, source_size, least(cap::DOUBLE, weight * final.level) AS target FROM levels, final
        ),
        run AS (
            SELECT d.*, source_size, target, floor(target / nullif(source_size, 0)) AS passes,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * coalesce(passes + CASE WHEN 2 * before + size <= 2 * (target - passes * source_size)
                                    THEN 1 ELSE 0 END, 0) AS BIGINT) AS taken
        FROM run
    """,
    "op7_url_filter": rf"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
        parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC,
                                      length(rule_host) DESC) AS n
            FROM parts JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (page_id)
    """,
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
            ) JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
            WHERE 100 * c >= 75 * (p.n + q.n - c)
        ),
        r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
    """,
    "op12_fill_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS key,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
            FROM documents
        ),
        h AS (
            SELECT *, CAST(len(lines) AS BIGINT) AS n,
                   list_transform(range(0, 4), lambda k: CAST('0x' || substr(key, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT)) AS h
            FROM t
        ),
        f AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                        WHEN h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ),
        p AS (
            SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
                   array_to_string(lines[b + 1:], '') AS suffix
            FROM f
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
                SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same
            ) WHERE r <= 5
        ),
        n AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
}
