"""Registered queries of the training-data operators, and their SQL."""
from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, kd_search, language_id, line_dedup, packing, quality_model, quality_rules as rules, simhash, spelling, spot_signatures, suffix_dedup, toxicity


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this library where the session was started without it in PYTHONPATH."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_kd_search(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return kd_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_simhash(spark, sf):
    return simhash.simhash_query(_table(spark, sf, "documents"))


def op3_toxicity(spark, sf):
    return toxicity.toxicity_query(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op4_language_id(spark, sf):
    return language_id.language_query(_table(spark, sf, "documents"))


def op5_suffix_dedup(spark, sf):
    return suffix_dedup.suffix_query(_table(spark, sf, "documents"))


def op6_packing(spark, sf):
    return packing.pack(_table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_bpe_round_trip(spark, sf):
    return bpe.round_trip(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_quality_rules(spark, sf):
    return rules.quality_rules(_table(spark, sf, "documents"))


def op9_quality_model(spark, sf):
    return quality_model.classify(_table(spark, sf, "documents"))


def op10_line_dedup(spark, sf):
    return line_dedup.line_verdicts(_table(spark, sf, "documents"))


def op11_spelling_variants(spark, sf):
    return spelling.variants(_table(spark, sf, "documents"))


def op12_document_fingerprints(spark, sf):
    return spot_signatures.fingerprint_query(_table(spark, sf, "documents"))


def op13_collocations(spark, sf):
    return collocations.collocations(_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_search": op1_kd_search,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_packing": op6_packing,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_model": op9_quality_model,
        "op10_line_dedup": op10_line_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_kd_search": """WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op5_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte,
                CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS w
              FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d)),
            f AS (SELECT w, min(doc_id) AS first FROM b WHERE w IS NOT NULL GROUP BY w),
            s AS (SELECT b.doc_id, i, byte, coalesce(first < b.doc_id, false) AS starts FROM b LEFT JOIN f USING (w)),
            c AS (SELECT doc_id, i, byte, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM s),
            e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
            g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
            SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
              sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
        "op10_line_dedup": rf"""WITH l AS (
              SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no,
                unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
            w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
            a AS (SELECT doc_id, line_no, w, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM w WHERE len(w) > 0),
            f AS (SELECT w, min(pos) AS pos FROM a GROUP BY w),
            n AS (SELECT * FROM f WHERE len(w) >= {line_dedup.MIN_NEAR}),
            v AS (SELECT pos, cut, list_concat(w[:cut - 1], w[cut + 1:]) AS r FROM (SELECT pos, w, unnest(range(1, len(w) + 1)) AS cut FROM n)),
            gone AS (
              SELECT v.pos FROM v JOIN (SELECT r, cut, min(pos) AS first FROM v GROUP BY r, cut) USING (r, cut) WHERE first < v.pos
              UNION SELECT v.pos FROM v JOIN n ON v.r = n.w WHERE n.pos < v.pos
              UNION SELECT n.pos FROM v JOIN n ON v.r = n.w WHERE v.pos < n.pos
              UNION SELECT a.pos FROM a JOIN f USING (w) WHERE f.pos < a.pos),
            s AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (WHERE g.pos IS NOT NULL), '') AS removed_lines
              FROM a LEFT JOIN gone g USING (pos) GROUP BY doc_id)
            SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
            FROM documents LEFT JOIN s USING (doc_id)""",
        # The checksum over bytes by its table of 256 entries; near words by the variants with one code point deleted.
        "op11_spelling_variants": rf"""WITH RECURSIVE
            r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
            k AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
            t AS (SELECT list(list_reduce(list_concat([i], range(8)),
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS s(i)),
            b AS (SELECT id, run, k, flatten(list_transform(string_split(id || ':' || run, ''),
                lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)) AS bytes FROM k),
            h AS (SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes),
                lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM b, t),
            d AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
            w AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
            u AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS cut FROM w),
            v AS (SELECT word, n, cut, CASE WHEN cut = 0 THEN word ELSE substr(word, 1, cut - 1) || substr(word, cut + 1) END AS v FROM u),
            p AS (SELECT DISTINCT a.word, b.word AS near, b.n FROM v a JOIN v b USING (v)
              WHERE a.word <> b.word AND (a.cut = b.cut OR a.cut = 0 OR b.cut = 0)),
            g AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
            m AS (SELECT word, min(near) AS near FROM p JOIN g USING (word) WHERE n = most GROUP BY word),
            f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.FORM_RATIO} * w.n THEN near END AS form,
                CASE WHEN most >= {spelling.FORM_RATIO} * w.n THEN most END AS form_n FROM w LEFT JOIN g USING (word) LEFT JOIN m USING (word)),
            c AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
            SELECT f.word, form, c.at AS root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL""",
        "op12_document_fingerprints": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
            w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{spot_signatures.WORD}')) AS word FROM d
              WHERE lang IN (SELECT lang FROM d GROUP BY lang HAVING count(*) >= {spot_signatures.LANG_SHARE} * (SELECT count(*) FROM d))),
            c AS (SELECT lang, word, count(*) AS k, sum(count(*)) OVER (PARTITION BY lang) AS n FROM w GROUP BY lang, word),
            common AS (SELECT coalesce(list(DISTINCT word), []) AS common FROM c WHERE k >= {spot_signatures.ANCHOR_SHARE} * n),
            f AS (SELECT doc_id, text, length(text) AS n, length(text) // 4 AS m,
              coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d),
            e AS (SELECT doc_id, n, text, substr(text, 1, n - m) || substr(following, 1, m) AS edited FROM f),
            t AS (SELECT doc_id, kind, regexp_extract_all(lower(text), '{spot_signatures.WORD}') AS w, common
              FROM (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e), common),
            p AS (SELECT doc_id, kind, w, list_filter(w, lambda x: NOT list_contains(common, x)) AS c,
              list_filter(range(1, len(w) + 1), lambda i: list_contains(common, w[i])) AS p FROM t),
            s AS (SELECT doc_id, kind, w, list_concat(
                list_transform(list_filter(range(1, len(p) + 1), lambda j: p[j] - j < len(c)),
                  lambda j: array_to_string(list_concat([w[p[j]]], c[p[j] - j + 1:p[j] - j + {spot_signatures.CHAIN}]), ' ')),
                list_transform(list_filter(range(1, len(c) + 1), lambda k: substr(md5(c[k]), 1, 1) < '2'),
                  lambda k: array_to_string(c[k:k + {spot_signatures.CHAIN}], ' '))) AS s FROM p),
            x AS (SELECT doc_id, kind, CASE WHEN len(s) > 0 THEN list_sort(list_distinct(s)) ELSE ['= ' || array_to_string(w, ' ')] END AS x FROM s),
            a AS (SELECT doc_id, x, coalesce(lead(x) OVER (ORDER BY doc_id), first_value(x) OVER (ORDER BY doc_id)) AS y FROM x WHERE kind = 0),
            b AS (SELECT doc_id, x FROM x WHERE kind = 1)
            SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, md5(array_to_string(a.x, chr(10))) AS fingerprint,
              md5(array_to_string(b.x, chr(10))) AS edited_fingerprint,
              len(list_intersect(a.x, b.x))::DOUBLE / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) AS near_edited,
              len(list_intersect(a.x, a.y))::DOUBLE / (len(a.x) + len(a.y) - len(list_intersect(a.x, a.y))) AS near_next
            FROM e JOIN a USING (doc_id) JOIN b USING (doc_id)""",
        "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram
              FROM w, range(1, 4) AS s(size)),
            f AS (SELECT lang, size, gram, count(*) AS k FROM g GROUP BY ALL),
            n AS (SELECT lang, sum(k) AS n FROM f WHERE size = 1 GROUP BY lang),
            c AS (SELECT lang, size, gram, string_split(gram, ' ') AS w, k FROM f WHERE size > 1 AND k >= {collocations.LEAST}),
            h AS (SELECT lang, gram, k, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
              FROM (SELECT *, unnest(range(1, size)) AS cut FROM c)),
            cuts AS (SELECT h.lang, h.gram, h.k AS a, cut, l.k AS l, r.k AS r, (1000000::HUGEINT * h.k * h.k) // (l.k::HUGEINT * r.k) AS score
              FROM h JOIN f l ON l.lang = h.lang AND l.gram = head JOIN f r ON r.lang = h.lang AND r.gram = tail),
            best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
            longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS gram, k FROM c WHERE size = 3),
            covered AS (SELECT lang, gram, max(k) AS most FROM longer GROUP BY ALL),
            kept AS (SELECT best.* FROM best LEFT JOIN covered USING (lang, gram) WHERE most IS NULL OR 100 * most < {collocations.COVERED} * a),
            o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM kept)
            SELECT lang, rank, gram AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= {collocations.TOP}""",
    }
