"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, bpe, html_extract, importance, licenses, mixing, personal_data, quality_classifier, quality_rules, simhash, token_store, topk, toxicity
from .common import table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantized(vectors["embedding"]).alias("q"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u, a.vec_id AS query_id, b.vec_id, b.u AS bu, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.u <> b.u AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id, bu)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def _op6_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sets = ", ".join(f"({quoted(label)}, {licenses.width_of(sentence)}, [{', '.join(map(quoted, licenses.template_words(sentence)))}])" for label, sentence in licenses.TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g') AS t FROM documents),
w AS (SELECT u, doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM d),
p AS (SELECT u, unnest(range(1, len(w) + 1)) AS i, w FROM w WHERE list_contains(w, 'license')),
hit AS (SELECT u, i - 1 AS i, CASE WHEN w[i] = 'mit' THEN 'mit' WHEN w[i] = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM p
        WHERE (w[i] IN ('mit', 'apache') AND w[i + 1] = 'license') OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')),
base AS (SELECT u, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS l FROM hit GROUP BY u),
sets(label, width, s) AS (VALUES {sets}),
cut AS (SELECT u, width, w, unnest(range(0, (len(w) + width - 1) // width)) AS k FROM w, (SELECT DISTINCT width FROM sets)),
blocks AS (SELECT u, width, list_distinct(w[k * width + 1 : (k + 2) * width]) AS b FROM cut),
found AS (SELECT u, label, len(list_intersect(b, s)) / len(s)::DOUBLE AS c FROM blocks JOIN sets USING (width) WHERE list_has_any(b, s)),
best AS (SELECT u, list(DISTINCT label) AS l, max(c) AS c FROM found WHERE c >= 0.8 - 1e-9 GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.l, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(best.l, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (u) LEFT JOIN best USING (u)
"""


def op7_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    """Sites are the sources, paths their languages: the nearest that the table has to hosts and paths."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), docs["source"], docs["lang"])


def op9_bpe(spark, sf_dir):
    path = tokenizer("word_bpe_49k.json")
    docs = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_store(spark, sf_dir):
    store = token_store.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.digest(store)


def op11_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal_data.report(docs, personal_data.fit(docs))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gap AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS c FROM rep),
cov AS (SELECT doc_id, sum(c) AS n FROM gap GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_excl
      FROM w LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_upper > 30 * word_chars
            OR 100 * n_excl > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 10 * word_chars > 120 * n_words OR 10 * word_chars < 25 * n_words) AS kept
FROM m
"""


def queries():
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_top_k": op2_top_k,
        "op3_html_extract": op3_html_extract,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_mixing": op7_mixing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_bpe": op9_bpe,
        "op10_token_store": op10_token_store,
        "op11_importance": op11_importance,
        "op12_alignment": op12_alignment,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql():
    return {"op1_quality_rules": OP1_SQL, "op2_top_k": OP2_SQL, "op6_license_scan": _op6_sql()}
