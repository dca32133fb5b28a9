"""The queries of this package, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.align import align_report
from loomgraph.llm.bpe import bpe_report
from loomgraph.llm.common import table
from loomgraph.llm.decontam import leaks
from loomgraph.llm import disclosure
from loomgraph.llm.langmix import language_report
from loomgraph.llm.linecrf import quality_report
from loomgraph.llm.linededup import line_report
from loomgraph.llm.middle import middle_report
from loomgraph.llm.mixing import mix
from loomgraph.llm.ngramjoin import join_documents
from loomgraph.llm.ngramlm import lm_report
from loomgraph.llm.secrets import RULES, secret_report
from loomgraph.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _match_sql(kind: str, k: int, pattern: str, group: int, test: str) -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, i, m, g, gap FROM (
        SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(list_slice(gaps, 1, len(ms))) AS gap
        FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS gs, string_split_regex(text, {p}) AS gaps FROM d))"""


SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_match_sql(r.kind, n, r.pattern, r.group, r.test) for n, r in enumerate(RULES))}),
p AS (SELECT doc_id, kind, k, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, kind, k, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p
      WHERE kind = 'hex' OR (kind = 'assign' AND length(g) >= 8) OR (kind = 'access' AND length(g) >= 16)),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)"""


@query("op1_secret_scan", SECRETS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(table(spark, folder, "documents"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op7_exact_topk", TOPK_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), "vec_id", "embedding")


LINES_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, b.key IS NOT NULL AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


SHINGLES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)"""


@query("op8_ngram_jaccard_join", SHINGLES_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return join_documents(table(spark, folder, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_quality_crf")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_language_mixture")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return language_report(table(spark, folder, "documents"))


@query("op5_target_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_lm_score")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lm_report(table(spark, folder, "documents"))


@query("op4_disclosure")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.report(table(spark, folder, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return align_report(table(spark, folder, "documents"))


MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
      list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d),
c AS (SELECT *, len(us) AS n, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS lo, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS hi,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
           WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:lo], '') AS a, array_to_string(us[lo + 1:hi], '') AS m, array_to_string(us[hi + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return middle_report(table(spark, folder, "documents"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_report(table(spark, folder, "documents"))
