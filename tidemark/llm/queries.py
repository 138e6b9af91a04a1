"""The operators' registered queries, each with SQL where SQL can say the same."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemark.llm import credentials, embedding_dedup, langid, lm_score, merkle, mixing, multi_index, pieces, quality, simhash, token_counts, toxicity, variants
from tidemark.llm.common import table


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether decoding returns the text."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(fold("doc_id", 5) != 0, F.lit(False)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of every document; rounded so that the order of adding up cannot show."""
    scored = lm_score.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer())


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "importance", "gumbel_key", "selected")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with the frequent form they are one edit from; nulls, empty texts and repeated rows: see :mod:`variants`."""
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, counted and digested; nulls, empty texts and repeated rows: see :mod:`credentials`."""
    return credentials.digests(credentials.findings(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document; of ids whose hash 7 divides a tampered row is checked. Nulls: see :mod:`merkle`."""
    shown = F.when(fold("doc_id", 7) == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": shown})


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_multi_index": op7_multi_index,
    "op8_token_counts": op8_token_counts,
    "op9_source_mix": op9_source_mix,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_credential_links": op12_credential_links,
    "op13_merkle_manifest": op13_merkle_manifest,
}

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in e if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) = v.vec_id AS kept
FROM v"""

OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, ws, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents))
), seq AS (
  SELECT doc_id, w AS w3, lag(w, 1) OVER o AS w2, lag(w, 2) OVER o AS w1 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w3, count(*) AS n FROM seq GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS n FROM seq WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM seq WHERE w1 IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT s.doc_id, CASE
      WHEN t.n >= 2 THEN CAST(t.n AS DOUBLE) / h.n
      ELSE (CASE WHEN s.w1 IS NULL THEN 1.0 ELSE 0.4 END) * (CASE
        WHEN b.n >= 2 THEN CAST(b.n AS DOUBLE) / g.n
        ELSE (CASE WHEN s.w2 IS NULL THEN 1.0 ELSE 0.4 END) * u.n / (SELECT count(*) FROM seq) END) END AS p
  FROM seq s JOIN c1 u ON u.w3 = s.w3
  LEFT JOIN c1 g ON g.w3 = s.w2
  LEFT JOIN c2 b ON b.w2 = s.w2 AND b.w3 = s.w3
  LEFT JOIN c2 h ON h.w2 = s.w1 AND h.w3 = s.w2
  LEFT JOIN c3 t ON t.w1 = s.w1 AND t.w2 = s.w2 AND t.w3 = s.w3
), sums AS (SELECT doc_id, count(*) AS n, sum(ln(CAST(p AS DOUBLE))) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0.0), 3) AS log_score FROM documents d LEFT JOIN sums USING (doc_id)"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, (SELECT CAST(sum(s) AS BIGINT) FROM per) AS total FROM per
), filled AS (
  SELECT *, row_number() OVER r AS place, CAST(coalesce(sum(3 * s) OVER before, 0) AS BIGINT) AS held, CAST(sum(w) OVER rest AS BIGINT) AS left_w
  FROM weighed WINDOW r AS (ORDER BY 3.0 * s / w, source), before AS (ORDER BY 3.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY 3.0 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT total, held, left_w FROM filled WHERE CAST(3 * s AS DOUBLE) * left_w > CAST(w AS DOUBLE) * (total - held) ORDER BY place LIMIT 1
), goal AS (
  SELECT f.source, f.s, CASE WHEN CAST(3 * f.s AS DOUBLE) * l.left_w <= CAST(f.w AS DOUBLE) * (l.total - l.held) THEN CAST(3 * f.s AS DOUBLE)
    ELSE CAST(f.w * (l.total - l.held) AS DOUBLE) / CAST(l.left_w AS DOUBLE) END AS target
  FROM filled f, level l
), ordered AS (
  SELECT d.doc_id, d.size, g.s, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('0:', coalesce(CAST(d.doc_id AS VARCHAR), ''))), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, s AS source_size, target,
  CASE WHEN s = 0 THEN 0 ELSE (budget // s) * size + least(size, greatest(0, budget - (budget // s) * s - before)) END AS taken
FROM ordered"""

CRC_SQL = """
  bits AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))
  )"""


def crc_sql(codes: str) -> str:
    """crc32 of a list of byte values; needs ``bits``."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, bits.t[1 + (xor(c, b) & 255)])), 4294967295)"


def field_sql(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


TEXT = {c: f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")}
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL}, marked AS (
  SELECT *, {field_sql(TEXT['doc_id'])} || {field_sql(TEXT['source'])} || {field_sql(TEXT['lang'])} AS front,
    coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-') AS back,
    CASE WHEN {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS bumped
  FROM documents, bits
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(front || {field_sql(TEXT['n_chars'])} || back) AS h, sha256(front || {field_sql('CAST(bumped AS VARCHAR)')} || back) AS shown
  FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaves
), nodes AS (
  SELECT CAST(0 AS BIGINT) AS lvl, grp, idx, h, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT lvl + 1, grp, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), CAST((any_value(n) + 1) // 2 AS BIGINT) FROM nodes WHERE n > 1 GROUP BY lvl, grp, idx // 2
), tops AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT CAST(0 AS BIGINT) AS lvl, idx, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), CAST((any_value(n) + 1) // 2 AS BIGINT) FROM upper WHERE n > 1 GROUP BY lvl, idx // 2
), steps AS (  -- a lone last node has no sibling and is hashed alone
  SELECT p.grp, p.idx, o.lvl, coalesce(CASE WHEN s.idx % 2 = 0 THEN 'L' ELSE 'R' END || s.h, 'L') AS step
  FROM placed p JOIN nodes o ON o.grp = p.grp AND o.n > 1 AND o.idx = p.idx >> o.lvl LEFT JOIN nodes s ON s.grp = o.grp AND s.lvl = o.lvl AND s.idx = xor(o.idx, 1)
  UNION ALL
  SELECT p.grp, p.idx, 1000 + o.lvl, coalesce(CASE WHEN s.idx % 2 = 0 THEN 'L' ELSE 'R' END || s.h, 'L')
  FROM placed p JOIN tops t ON t.grp = p.grp JOIN upper o ON o.n > 1 AND o.idx = t.idx >> o.lvl LEFT JOIN upper s ON s.lvl = o.lvl AND s.idx = xor(o.idx, 1)
), paths AS (SELECT grp, idx, list(step ORDER BY lvl) AS steps FROM steps GROUP BY grp, idx),
walked AS (
  SELECT p.*, coalesce(steps, CAST([] AS VARCHAR[])) AS steps FROM placed p LEFT JOIN paths w ON w.grp = p.grp AND w.idx = p.idx
), folds AS (
  SELECT grp, idx, CAST(1 AS BIGINT) AS k, steps, shown AS a FROM walked
  UNION ALL
  SELECT grp, idx, k + 1, steps, sha256(CASE WHEN steps[k][1] = 'L' THEN steps[k][2:] || a ELSE a || steps[k][2:] END) FROM folds WHERE k <= len(steps)
), done AS (
  SELECT p.doc_id, p.h AS leaf, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
    sha256(coalesce(list_aggregate(list_transform(p.steps, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256, f.a AS folded_root
  FROM walked p JOIN tops t ON t.grp = p.grp JOIN folds f ON f.grp = p.grp AND f.idx = p.idx AND f.k = len(p.steps) + 1
)
SELECT *, folded_root = root AS verified FROM done"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT *, {crc_sql("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))")} AS h
  FROM runs, bits
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, k FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = b GROUP BY a
), ruled AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM ruled
  UNION ALL SELECT k.word, k.next, r.form FROM walk k JOIN ruled r ON r.word = k.next
)
SELECT r.word, r.form, k.root, r.n, r.n_near, r.form_n FROM ruled r JOIN walk k ON k.word = r.word AND k.next IS NULL"""


def hits_sql(i: int, kind: str) -> str:
    """Matches of one kind; RE2 has no look behind, which only saves time in the patterns."""
    pattern = re.sub(r"\(\?<!.*?\]\)", "", credentials.KINDS[kind][0]).replace("'", "''")
    kept = {"assign": "length(v[i]) >= 6", "key_id": "length(v[i]) >= 3", "blob": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]')"}.get(kind, "true")
    group = 2 if kind in ("assign", "key_id") else 0
    return f"""SELECT row, {i} AS kind, i, length(g[i]) AS gap, length(m[i]) AS len, {kept} AS ok FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT row, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM docs))"""


PART_SQL = "[" + ", ".join(f"'{part}'" for _, part in credentials.KINDS.values()) + "][kind + 1]"
NAME_SQL = "[" + ", ".join(f"'{kind}'" for kind in credentials.KINDS) + "][kind + 1]"
OP12_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents), hits AS (
  {" UNION ALL ".join(hits_sql(i, kind) for i, kind in enumerate(credentials.KINDS))}
), spans AS MATERIALIZED (
  SELECT row, kind, {PART_SQL} AS part, b - len AS a, b FROM (SELECT *, sum(gap + len) OVER (PARTITION BY row, kind ORDER BY i) AS b FROM hits) WHERE ok
), weak AS (
  SELECT w.row, w.kind, w.part, w.a, w.b, bool_or(p.part = 'identifier') AS identifier, bool_or(p.part = 'secret') AS secret, bool_or(p.kind < 3 AND p.a < w.b AND w.a < p.b) AS known
  FROM spans w JOIN spans p ON p.row = w.row AND p.a - w.b <= {credentials.REACH} AND w.a - p.b <= {credentials.REACH}
  WHERE w.kind >= 3 GROUP BY ALL
), kept AS (
  SELECT row, kind, a, b FROM spans WHERE kind < 3
  UNION ALL SELECT row, kind, a, b FROM weak WHERE NOT known AND CASE part WHEN 'identifier' THEN secret WHEN 'secret' THEN identifier ELSE identifier AND secret END
), told AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_weak,
    string_agg({NAME_SQL} || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
    string_agg({NAME_SQL} || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a, kind) AS spans
  FROM kept GROUP BY row
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
FROM docs d LEFT JOIN told USING (row)"""

SQL = {"op11_spelling_variants": OP11_SQL, "op12_credential_links": OP12_SQL, "op13_merkle_manifest": OP13_SQL, "op3_embedding_dedup": OP3_SQL, "op6_lm_score": OP6_SQL, "op9_source_mix": OP9_SQL}
