"""Registered queries of this package: each applies one operator to its whole table.

The operators are imported where they are used, so that a task only loads the one it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from loregraph.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op10_segment_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loregraph.llm.segment_bpe import encode_documents

    path = public_tokenizers.path(TOKENIZER)
    return encode_documents(read_table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)


@query("op1_lz_fingerprint")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.lz_fingerprint import fingerprint_documents

    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query("op9_quality_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.quality_neighbours import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_language_gru")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.language_gru import identify

    return identify(read_table(spark, sf_dir, "documents"))


_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, CAST((i // 8) * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1, 1)), '')"""


@query("op4_warc_shards", f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.warc_shards import read_archive, write_archive
    from loregraph.session import new_folder

    folder = new_folder(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, with_payload=False).drop("url", "payload")


@query("op8_ngram_join", r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s),
u AS (SELECT doc_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT c.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, least(c.doc_id, coalesce(g.low, c.doc_id)) AS group_id
FROM c LEFT JOIN (SELECT x, count(*) AS n_links FROM p GROUP BY x) l ON l.x = c.doc_id
LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) g ON g.x = c.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.ngram_join import ngram_join

    return ngram_join(read_table(spark, sf_dir, "documents"))


@query("op3_license_diagonals")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.license_diagonals import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op5_spaced_seeds")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.spaced_seeds import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("h")


@query("op7_secret_tests")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.secret_tests import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query("op2_pii_votes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.pii_votes import scan_pii

    return scan_pii(read_table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.periodic_runs import periodic_runs, run_digests, with_repeats

    return run_digests(periodic_runs(with_repeats(read_table(spark, sf_dir, "documents"))))


# crc32 of a number as text: bytes one by one, bits one by one
_CRC = """xor(list_reduce(list_transform(string_split('~' || {x}::VARCHAR, ''), lambda c: CASE WHEN c = '~' THEN 4294967295 ELSE ascii(c)::BIGINT END),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, k: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END)), 4294967295)"""


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS w,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(w ORDER BY k) AS w, {_CRC.format(x="c")} % 9 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(b.w, [])[:o.h], o.w[o.h + 1:]) AS w FROM o LEFT JOIN o b ON b.c = o.c - o.c % 5),
p AS (SELECT c, d, w[:d] AS p, d = len(w) AS last, octet_length(encode(CASE WHEN d > 0 THEN w[d].t ELSE '' END)) AS bytes
      FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(m.n_children, 0) AS n_children FROM n
      LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p[:n.d - 1]
      LEFT JOIN (SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2) m ON m.d = n.d AND m.p = n.p),
a AS (SELECT p[:e] AS p, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
      FROM (SELECT *, unnest(range(d + 1)) AS e FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.d AS depth, k.parent_conv_id, k.n_convs, k.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.d = k.d AND a.p = k.p""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.prefix_trie import conversation_trie

    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def _posterior(groups: str, names: str) -> str:
    """SQL of the posterior of a level (``seen, blocked, prior, worth``), as ``prior, worth``."""
    return f"""SELECT {names}, (blocked + k * prior) / (seen + k) AS prior, seen + k AS worth FROM (
        SELECT *, greatest(0.05, 1 / (1 / (spread + 1) + 1 / (worth + 1)) - 1) AS k FROM {groups}, (
            SELECT least(1 / least(0.95, greatest(1e-4, CASE WHEN pairs > 0 THEN over / pairs ELSE 0.95 END)) - 1, greatest(1, n)) AS spread FROM (
                SELECT sum((blocked - seen * prior) * (blocked - seen * prior) - seen * prior * (1 - prior)) AS over,
                       sum(seen * prior * (1 - prior) * (seen - 1)) AS pairs, count(*) FILTER (WHERE seen > 0) AS n FROM {groups})))"""


@query("op13_host_reputation", rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM u),
b AS (SELECT host, count(rule) AS seen, count(*) FILTER (WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')) AS blocked,
             regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS bare FROM p GROUP BY host),
h0 AS (SELECT host, seen, blocked, bare, CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare
        WHEN regexp_matches(bare, '(^|\.)(ac|co|com|edu|gov|net|or|org)\.[a-z][a-z]$') THEN array_to_string(string_split(bare, '.')[-2:], '.')
        ELSE string_split(bare, '.')[-1] END AS suffix FROM b),
h1 AS (SELECT *, CASE WHEN length(bare) > length(suffix) + 1 THEN string_split(left(bare, length(bare) - length(suffix) - 1), '.')[-1] ELSE '' END AS name FROM h0),
h AS (SELECT *, CASE WHEN name = '' THEN suffix ELSE name || '.' || suffix END AS domain FROM h1),
a AS (SELECT ((coalesce(sum(blocked), 0) + 0.5) / (coalesce(sum(seen), 0) + 1.0))::DOUBLE AS prior, (coalesce(sum(seen), 0) + 1.0)::DOUBLE AS worth FROM h),
s0 AS (SELECT suffix, sum(seen) AS seen, sum(blocked) AS blocked, any_value(a.prior) AS prior, any_value(a.worth) AS worth FROM h, a GROUP BY suffix),
s AS ({_posterior("s0", "suffix")}),
d0 AS (SELECT x.*, s.prior, s.worth FROM (SELECT domain, suffix, sum(seen) AS seen, sum(blocked) AS blocked FROM h GROUP BY domain, suffix) x JOIN s USING (suffix)),
d AS ({_posterior("d0", "domain, suffix")}),
g0 AS (SELECT h.host, h.seen, h.blocked, d.prior, d.worth FROM h JOIN d ON h.domain = d.domain AND h.suffix = d.suffix),
g AS ({_posterior("g0", "host")}),
v AS (SELECT host, prior AS share, greatest(0.0, prior - 1.645 * sqrt(prior * (1 - prior) / (worth + 1))) AS bound FROM g)
SELECT p.page_id, p.host, p.path, p.rule,
       CASE WHEN p.rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN p.rule IS NOT NULL THEN 'allow'
            WHEN v.bound >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(v.share, 4) AS share, round(v.bound, 4) AS bound
FROM p JOIN v ON p.host = v.host""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loregraph.llm.host_reputation import judge_pages

    return judge_pages(read_table(spark, sf_dir, "pages"))


if find_spec("corpus_pipeline") is not None:

    @query("pipeline")
    def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)
