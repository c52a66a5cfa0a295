"""The queries of the training-data operators and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bilinear_lm, byte_bpe, cover_tree, jaccard_join, language_id, line_dedup, media_ogg, packing, substring_dedup, url_filter
from .common import table


def _on(name: str, op: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(table(spark, sf_dir, name))
        return out.select(*columns) if columns else out

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": _on("documents", media_ogg.op1_ogg),
    "op2_bpe": _on("documents", byte_bpe.op2_bpe),
    "op3_jaccard": _on("documents", jaccard_join.op3_jaccard),
    "op4_substring": _on("documents", substring_dedup.op4_substring),
    "op5_urls": _on("pages", url_filter.op5_urls),
    "op6_pack": _on("documents", packing.op6_pack),
    "op7_lines": _on("documents", line_dedup.op7_lines),
    "op8_embeddings": _on("embeddings", cover_tree.op8_embeddings),
    "op9_language": _on("documents", language_id.op9_language),
    "op10_lm": _on("documents", bilinear_lm.op10_lm),
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: Pairs of links in both directions become the least id that each node reaches.
_REACH = """reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least AS (SELECT a AS id, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)"""

#: The operators whose results plain SQL gives too; tests compare the others with brute force or public libraries.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE both_have >= 0.8 * (s.n + t.n - both_have)), {_REACH}
    SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(degree.n, 0) AS n_links, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
    FROM documents LEFT JOIN least ON least.id = doc_id LEFT JOIN degree ON degree.id = doc_id""",
    "op4_substring": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, range(50) t(k)),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op8_embeddings": f"""WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95), {_REACH}
    SELECT vec_id, coalesce(degree.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
    FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN degree ON degree.id = vec_id""",
}
