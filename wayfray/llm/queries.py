"""The registered queries of these operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, html_text, lexical, lines, mixing, near_dup, neighbours, packing, pii, quality, search, substrings, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op2_substrings(spark: SparkSession, d: str) -> DataFrame:
    return substrings.drop_repeated(table(spark, d, "documents"), with_text=False).drop("kept")


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_path())


def op4_lines(spark: SparkSession, d: str) -> DataFrame:
    out = lines.drop_recurring_lines(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents"))


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    s = toxicity.scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return s.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


def op8_search(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(table(spark, d, "embeddings"), F.col("id") % 50 == 0)


def op9_html(spark: SparkSession, d: str) -> DataFrame:
    return html_text.main_texts(table(spark, d, "pages"))


def op10_minhash(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, d, "documents"), k=2).drop("th")


def op11_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("id") % 100 == 0)


def op12_lexical(spark: SparkSession, d: str) -> DataFrame:
    return lexical.ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op13_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def queries() -> dict:
    all_ = (op1_mixing, op2_substrings, op3_packing, op4_lines, op5_quality, op6_pii, op7_toxicity, op8_search, op9_html, op10_minhash, op11_neighbours, op12_lexical, op13_audit)
    return {f.__name__: f for f in all_}


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_W}) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, i) AS k FROM w),
c AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY k DESC) AS free FROM r),
l AS (SELECT arg_min((total - before) / free, k) AS level FROM c WHERE w * ((total - before) / free) <= 2.0::DOUBLE * source_size),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT level FROM l)) AS target FROM w),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM e"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
own AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM win JOIN own USING (g) WHERE owner < doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END) AS w FROM l),
f AS (SELECT doc_id, pos, w, len(w) AS n, (len(w) + 3) // 4 AS s FROM w WHERE len(w) > 0),
q AS (SELECT *, w[1:s] AS q0, w[s+1:2*s] AS q1, w[2*s+1:3*s] AS q2, w[3*s+1:4*s] AS q3 FROM f),
t AS (
  SELECT doc_id, w, n, w[1:3] AS head, unnest(CASE WHEN n < 8 THEN [{'k': -1, 'a': w, 'b': w, 'c': w}]
    ELSE [{'k': 0, 'a': q0, 'b': q1, 'c': q2}, {'k': 1, 'a': q0, 'b': q1, 'c': q3}, {'k': 2, 'a': q0, 'b': q2, 'c': q3}, {'k': 3, 'a': q1, 'b': q2, 'c': q3}] END) AS t FROM q),
u AS (SELECT DISTINCT doc_id, n, head, t FROM t),
r AS (SELECT n, head, t, min(doc_id) AS first FROM u GROUP BY ALL HAVING count(*) >= 3),
o AS (SELECT t.w, min(r.first) AS first FROM (SELECT DISTINCT w, n, head, t FROM t) t JOIN r USING (n, head, t) GROUP BY t.w),
g AS (SELECT doc_id, pos FROM f JOIN o USING (w) WHERE doc_id IS DISTINCT FROM first),
k AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_dropped, count(f.pos) AS n_lines
  FROM l LEFT JOIN g USING (doc_id, pos) LEFT JOIN f USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN d.text IS NULL OR k.n_dropped = 0 THEN d.text WHEN regexp_matches(coalesce(k.text, ''), '[^\x20\x09-\x0D]') THEN k.text ELSE '' END) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, {_W} AS w, coalesce(text, '') AS t FROM documents),
win AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, unnest(is_) AS i FROM (SELECT doc_id, g, list(i) AS is_ FROM win GROUP BY ALL HAVING count(*) > 1)),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 3)) AS i FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR (n_dup_lines > 3 AND 4 * n_dup_lines > n_words) OR 100 * n_repeat_words > 50 * n_words AS rule_failed,
         [10 * n_symbols > n_words OR 50 * n_symbols > n_words, word_chars > 12 * n_words OR word_chars < 3 * n_words,
          (n_dup_lines > 3 AND 4 * n_dup_lines > n_words) OR (n_dup_lines > 1 AND 20 * n_dup_lines > n_words), 100 * n_repeat_words > 20 * n_words] AS doubt FROM c),
f AS (SELECT doc_id, source, unnest([0, 1, 2, 3, 4]) AS rule, unnest(list_prepend(base_failed OR rule_failed, doubt)) AS x FROM r),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (x) AS k FROM f GROUP BY ALL),
q AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
z AS (SELECT source, rule, m, (k + m * a) / (n + a) AS s FROM (SELECT *, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1e6 END AS a FROM h JOIN q USING (rule))),
t AS (SELECT rule, sqrt(avg((s - m) * (s - m))) AS d FROM z GROUP BY rule),
g AS (SELECT source, list(CASE WHEN rule = 0 THEN s > 0.5 ELSE s > m + d + 1e-9 END ORDER BY rule) AS bad FROM z JOIN t USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rule_failed AND NOT bad[1] AND NOT (bad[2] AND doubt[1] OR bad[3] AND doubt[2] OR bad[4] AND doubt[3] OR bad[5] AND doubt[4]) AS kept
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, w[i:i+1] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
b AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
cc(node, label) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM b
  UNION
  SELECT b.b, min(cc.label) FROM cc JOIN b ON b.a = cc.node JOIN recurring.cc z ON z.node = b.b WHERE cc.label < z.label GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(cc.label, d.doc_id) AS component_id, coalesce(cc.label, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cc ON cc.node = d.doc_id"""


OP12 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM t WHERE len(w) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * nn) // l AS m FROM t, s WHERE len(w) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
c AS (
  SELECT item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c JOIN m USING (r)) WHERE rank <= 10"""

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_W} AS w FROM documents),
y AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d LEFT JOIN y USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, step, o[step] AS f, list_sum(list_transform(o[1:step-1], lambda i: 1 << i)) AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, o, step, f, sum(n) FILTER (mask & (coalesce(gone, 0)::INT | (1 << f)::INT) = 0) AS kept, sum(n) FILTER (mask & coalesce(gone, 0)::INT = 0 AND mask >> f & 1 = 1) AS removed,
         sum(n) FILTER (mask & coalesce(gone, 0)::INT <> 0 AND mask >> f & 1 = 1) AS redundant, sum(n) FILTER (mask = 1 << f) AS unique_fails,
         sum(good) FILTER (mask & coalesce(gone, 0)::INT = 0 AND mask >> f & 1 = 1) AS good_lost, sum(toxic) FILTER (mask & coalesce(gone, 0)::INT = 0 AND mask >> f & 1 = 1) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda i: 'ABCDE'[i + 1]), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_substrings": OP2, "op4_lines": OP4, "op5_quality": OP5, "op8_search": OP8, "op10_minhash": OP10, "op12_lexical": OP12, "op13_audit": OP13}
