"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, language_id, line_dedup, lm_score, pii, quality, secret_scan, sentencepiece, substring_dedup
from plumbline.llm import spans as S
from plumbline.llm.common import materialize, own_dir, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    counts = [S.count(F.col("__base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(S.written(F.col("__base")).cast("binary"), 256).alias("base_sha256"), S.written(F.concat("__base", "__found")).alias("spans"), F.size("__found").cast("long").alias("n_discovered"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), sentencepiece.load(spark))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = lm_score.fit(docs, lm_score.train_rows())
    return lm_score.score(docs, model, counts, ~lm_score.train_rows())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a ledger of its own, so that every call scans its whole table; secret_ledger goes on with one
    found = secret_scan.report(table(spark, sf_dir, "documents"), secret_scan.Ledger(spark, f"{own_dir(spark)}/{uuid.uuid4().hex}"))
    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("__spans", lambda s: s["kind"].isin(kinds))
    counts = [S.count(F.col("__spans"), k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(S.written(base).cast("binary"), 256).alias("base_sha256"), S.written(F.col("__spans")).alias("spans"), "blob")


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of all documents against one ledger: of the second, in which every other text has one more line, only new blobs are scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger, out = secret_scan.Ledger(spark, f"{own_dir(spark)}/{uuid.uuid4().hex}"), []
    longer = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\ntoken=abcdefgh"))).otherwise(F.col("text"))
    for n, version in enumerate((docs, docs.withColumn("text", longer), docs)):
        paths = version.select(secret_scan.address(F.col("text")).alias("blob"))
        todo = materialize(secret_scan.unseen(paths.distinct(), ledger.rows()))
        if todo.head(1):
            ledger.append(secret_scan.scan(version, todo))
        out.append(todo.agg(F.lit(n).alias("version"), F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.size("todo")), F.lit(0)).alias("pairs")))
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_sentencepiece, op4_language_id, op5_quality, op6_decontaminate, op7_jaccard_join, op8_line_dedup, op9_lm_score, op10_secret_scan, secret_ledger)
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"

ORACLE: dict[str, str] = {
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE n AS (SELECT text, min(doc_id) AS least, count(*) AS copies, [x FOR x IN regexp_split_to_array({_LOWER}, '[ \t-\r]+') IF x <> ''] AS w
       FROM documents WHERE regexp_matches(text, '[^ \t-\r]') GROUP BY text),
s AS (SELECT DISTINCT least, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT least, w, unnest(range(1, CAST(greatest(len(w) - 4, 1) + 1 AS BIGINT))) AS i FROM n)),
c AS (SELECT least, count(*) AS k FROM s GROUP BY least),
p AS (SELECT a.least AS x, b.least AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.least <> b.least GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN c cx ON x = cx.least JOIN c cy ON y = cy.least WHERE m >= 0.8 * (cx.k + cy.k - m) - 1e-9),
r AS (SELECT least AS node, least AS reach FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
cls AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
l AS (SELECT x, count(*) AS links FROM e GROUP BY x)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, CAST(coalesce(l.links, 0) AS BIGINT) AS n_links, CAST(coalesce(n.copies - 1, 0) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN n ON d.text = n.text LEFT JOIN cls ON n.least = cls.node LEFT JOIN l ON n.least = l.x""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, i, line, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN string_split(trim(line), ' ')] AS t
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(1, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT))) AS i FROM d WHERE text IS NOT NULL)),
h AS (SELECT *, len(t) AS n, CAST(floor((len(t) - {line_dedup.LEADING}) / 2) AS BIGINT) AS half FROM l WHERE NOT (len(t) = 1 AND t[1] = '')),
k AS (SELECT rid, i, 'all ' || n || ' ' || array_to_string(t, ' ') AS key FROM h WHERE n < {line_dedup.SHORT}
      UNION ALL SELECT rid, i, 'first ' || n || ' ' || array_to_string(t[1 : {line_dedup.LEADING} + half], ' ') FROM h WHERE n >= {line_dedup.SHORT}
      UNION ALL SELECT rid, i, 'second ' || n || ' ' || array_to_string(t[1 : {line_dedup.LEADING}], ' ') || ' | ' || array_to_string(t[{line_dedup.LEADING} + half + 1 : n], ' ') FROM h WHERE n >= {line_dedup.SHORT}),
often AS (SELECT key FROM k JOIN d USING (rid) GROUP BY key HAVING count(DISTINCT d.text) >= {line_dedup.MIN_DOCS}),
hit AS (SELECT DISTINCT rid, i FROM k JOIN often USING (key)),
kept AS (SELECT l.rid, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (hit.i IS NULL), '') AS text, count(*) AS n, count(hit.i) AS gone
         FROM l LEFT JOIN hit ON l.rid = hit.rid AND l.i = hit.i GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN kept.gone > 0 THEN kept.text ELSE d.text END AS text, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.gone, 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN kept USING (rid)""",
    "secret_ledger": f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || 'token=abcdefgh' ELSE text END AS text FROM a)
SELECT 0 AS version, count(DISTINCT text) AS blobs, CAST(count(DISTINCT text) * {len(secret_scan.RULES)} AS BIGINT) AS pairs FROM a
UNION ALL SELECT 1, count(*), CAST(count(*) * {len(secret_scan.RULES)} AS BIGINT) FROM b WHERE text NOT IN (SELECT text FROM a)
UNION ALL SELECT 2, 0, 0""",
}
