"""Queries that apply each operator to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from launchgrid.llm import (
    bpe, collocations, html_text, huffman, minhash, near_vectors, packing, sentence_spans, suffixes, tokens, toxicity, tree_search, vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL["op7_near_vectors"] = """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_sum([c * c FOR c IN embedding::DOUBLE[]])) AS n FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
  reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
  c AS (SELECT node, min(seen) AS low FROM reach GROUP BY node),
  d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
  FROM embeddings e LEFT JOIN c ON e.vec_id = c.node LEFT JOIN d ON e.vec_id = d.a"""

SQL["op9_minhash"] = """WITH RECURSIVE d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
  reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
  low AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(low.low, d.doc_id)) AS kept
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id"""

SQL["op10_suffixes"] = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
  s AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
  f AS (SELECT k, min(doc_id) AS f FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
  hits AS (SELECT s.doc_id, s.i FROM s JOIN f USING (k) WHERE f.f < s.doc_id),
  marks AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hits),
  runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marks),
  spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
  ends AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id),
  kept AS (SELECT d.doc_id, h, coalesce(gone, 0) AS gone, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN h ELSE
      array_to_string([substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END) + 1, 2 * ((CASE WHEN k > len(a) THEN len(h) // 2 ELSE a[k] END) - (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)))
        FOR k IN range(1, len(a) + 2)], '') END AS rest FROM d LEFT JOIN ends USING (doc_id))
  SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, n::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""

SQL["op11_collocations"] = """WITH d AS (SELECT coalesce(lang, 'und') AS lang,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
  p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
  w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS ws FROM p),
  s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
  g AS (SELECT lang, k.k AS words, array_to_string(list_slice(ws, i, i + k.k - 1), ' ') AS phrase
    FROM s, (VALUES (1), (2), (3)) k(k) WHERE i + k.k - 1 <= len(ws)),
  c AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
  cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE words > 1 AND f >= 10),
  longer AS (SELECT lang, phrase, max(a) AS a FROM (
      SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM cand WHERE words = 3
      UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE words = 3) GROUP BY ALL),
  live AS (SELECT cand.* FROM cand LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * cand.a),
  cuts AS (SELECT lang, phrase, a, 1 AS k, ws[1] AS first, array_to_string(ws[2:], ' ') AS rest FROM live
    UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM live WHERE words = 3),
  scored AS (SELECT t.lang, t.phrase, t.a, t.k, x.f AS l, y.f AS r, (1000000::HUGEINT * t.a * t.a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts t JOIN c x ON x.lang = t.lang AND x.phrase = t.first JOIN c y ON y.lang = t.lang AND y.phrase = t.rest),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
  SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds written out: each assigns every part to its nearest entry, then takes means."""
    steps = [f"""v AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  x AS (SELECT vec_id, label, p.p AS p, list_slice(v, p.p * len(v) // {parts} + 1, (p.p + 1) * len(v) // {parts}) AS v
    FROM v, (SELECT unnest(range({parts})) AS p) p),
  b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, x.v, min([list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, b.v)])::BIGINT, b.e]) AS m
    FROM x JOIN b{r} b ON b.p = x.p GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, m[2] AS e, i, sum(c)::HUGEINT AS t, count(*) AS n
    FROM (SELECT p, m, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
  b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, e, list(((t - ((t % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY ALL) s ON s.p = b.p AND s.e = b.e)""")
    return "WITH " + ",\n  ".join(steps) + f""",
  rows AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
  digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rows, digest"""


SQL["op13_vector_codes"] = _codes_sql()


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


@query
def op4_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return tree_search.search(base, base.where("vec_id % 20 = 0"), 20)


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_spans(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


@query
def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))
