"""The queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import p01_overlap, p02_leaks, p03_near, p04_scan, p05_mixture, p06_markup, p07_cutoff, p08_encode, p09_pack, p10_sentences

_LATEST_SCORES = """
    SELECT doc_id, bucket, quality_score AS score FROM (
        SELECT doc_id, quality_score, lower(trim(mixture_bucket, E' \\t\\n\\r')) AS bucket,
               row_number() OVER (PARTITION BY doc_id ORDER BY scored_at DESC NULLS LAST, quality_score DESC NULLS LAST,
                                  lower(trim(mixture_bucket, E' \\t\\n\\r')) DESC NULLS LAST) AS k
        FROM document_features WHERE doc_id IS NOT NULL) WHERE k = 1"""
_VALID = f"""
    records AS (SELECT r.*, s.keep_percent FROM ({_LATEST_SCORES}) r
        JOIN (SELECT lower(trim(bucket)) AS bucket, keep_percent FROM mixture_spec) s USING (bucket)
        WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n,
        row_number() OVER (PARTITION BY bucket ORDER BY score DESC) AS place FROM records),
    cuts AS (SELECT bucket, any_value(keep_percent) AS keep_percent, any_value(n) AS n, any_value((keep_percent * n + 99) // 100) AS k,
        min(score) FILTER (WHERE place <= (keep_percent * n + 99) // 100) AS cutoff FROM ranked GROUP BY bucket)"""

#: Examples as classes of equal numbers and words: which evaluation and training records hold them.
_SEPARATORS = ",'\u2019\u00a0\u2009\u202f".replace("'", "''")
_OVERLAP = rf"""
    sides AS (SELECT DISTINCT example_id AS id, lower(trim(split, E' \t\n\r')) AS split, unnest([{{'field': 0, 'text': prompt}}, {{'field': 1, 'text': completion}}], recursive := true)
        FROM sft_examples WHERE example_id IS NOT NULL AND split IS NOT NULL AND trim(split, E' \t\n\r') <> ''),
    parsed AS (SELECT id, split = 'train' AS train, field, list_sort(regexp_extract_all(lower(text), '\p{{L}}+')) AS words,
            list_sort(flatten(list_transform(regexp_extract_all(text, '\p{{Nd}}+(?:[{_SEPARATORS}]\p{{Nd}}+)*'),
                lambda chain: string_split(list_reduce(regexp_split_to_array(chain, '[{_SEPARATORS}]'), lambda done, g: CASE WHEN length(g) = 3 THEN done || g ELSE done || '|' || g END), '|')))) AS numbers
        FROM sides WHERE text IS NOT NULL),
    usable AS (SELECT *, dense_rank() OVER (ORDER BY field, numbers, words) AS cls FROM parsed WHERE len(words) + len(numbers) >= CASE field WHEN 0 THEN 1 ELSE 25 END),
    classes AS (SELECT cls, any_value(field) AS field, any_value(numbers) AS numbers, any_value(words) AS words FROM usable GROUP BY cls),
    counted AS (SELECT cls, w, row_number() OVER (PARTITION BY cls, w) AS again FROM (SELECT cls, unnest(words) AS w FROM classes)),
    meeting AS (SELECT a.cls AS a, b.cls AS b, len(a.words) AS m, len(b.words) AS n FROM classes a JOIN classes b USING (field, numbers)
        WHERE a.cls IN (SELECT cls FROM usable WHERE NOT train) AND b.cls IN (SELECT cls FROM usable WHERE train)),
    common AS (SELECT a, b, count(*) AS k FROM meeting JOIN counted x ON x.cls = a JOIN counted y ON y.cls = b AND y.w = x.w AND y.again = x.again GROUP BY a, b),
    alike AS (SELECT a, b FROM meeting LEFT JOIN common USING (a, b) WHERE 4 * coalesce(k, 0) >= 3 * (m + n - coalesce(k, 0)))"""
_NEAR = r"""
    words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 20),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p01_overlap.p1_found,
    "p1_report": p01_overlap.p1_report,
    "p2_found": p02_leaks.p2_found,
    "p2_report": p02_leaks.p2_report,
    "p3_found": p03_near.p3_found,
    "p3_groups": p03_near.p3_groups,
    "p4_found": p04_scan.p4_found,
    "p4_repair": p04_scan.p4_repair,
    "p5_copies": p05_mixture.p5_copies,
    "p5_report": p05_mixture.p5_report,
    "p6_found": p06_markup.p6_found,
    "p6_clean": p06_markup.p6_clean,
    "p7_found": p07_cutoff.p7_found,
    "p7_cutoffs": p07_cutoff.p7_cutoffs,
    "p8_ids": p08_encode.p8_ids,
    "p9_containers": p09_pack.p9_containers,
    "p9_fill": p09_pack.p9_fill,
    "p10_found": p10_sentences.p10_found,
    "p10_sentences": p10_sentences.p10_sentences,
}

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_OVERLAP} SELECT DISTINCT least(x.id, y.id) AS example_id_a, greatest(x.id, y.id) AS example_id_b FROM alike JOIN usable x ON x.cls = a AND NOT x.train JOIN usable y ON y.cls = b AND y.train WHERE x.id <> y.id",
    "p3_found": f"WITH {_NEAR} SELECT a AS doc_id_a, b AS doc_id_b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * k >= 3 * (x.n + y.n - k)",
    "p7_found": f"WITH {_VALID} SELECT DISTINCT doc_id FROM records JOIN cuts USING (bucket) WHERE score >= cutoff",
    "p7_cutoffs": f"""WITH {_VALID} SELECT bucket AS source, any_value(c.keep_percent)::INTEGER AS keep_percent, any_value(n)::BIGINT AS n_records,
        any_value(k)::BIGINT AS n_wanted, any_value(cutoff) AS cutoff, count(*) FILTER (WHERE score >= cutoff) AS n_kept
        FROM records JOIN cuts c USING (bucket) GROUP BY bucket""",
}
