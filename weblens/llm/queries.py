"""Queries of the training-data operators: the thin ``opN_<name>`` builders
over the tables of a data folder, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm import (
    collocations, decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, pii, piece_bpe, sharding, substring_dedup, toxicity, whitening, word_bpe,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"),
        F.concat_ws(",", "spans").alias("spans"), "n_added",
    )


def piece_model() -> str:
    """Path of the public merge-type model."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(_table(spark, sf_dir, "documents"), piece_model())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).drop("kept_text")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def word_model() -> str:
    """Path of the public tokenizer with word ends."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_table(spark, sf_dir, "documents"), word_model())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviation as long; null where it needs more than 64 bits."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_word_bpe": op11_word_bpe,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op13_collocations": f"""
WITH p AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, ws[s:s + k - 1] AS w
      FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, w, count(*)::HUGEINT AS c FROM g GROUP BY lang, k, w),
t AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2 AND c >= 30),
cuts AS (SELECT lang, w, c, unnest(generate_series(1, k - 1)) AS i, k FROM cand),
sc AS (SELECT x.lang, x.w, x.c AS a, x.i, h.c AS l, t.c AS r, (2000000 * x.c) // (h.c + t.c) AS score
       FROM cuts x JOIN f h ON h.lang = x.lang AND h.w = x.w[1:x.i] JOIN f t ON t.lang = x.lang AND t.w = x.w[x.i + 1:x.k]),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, i) = 1),
inn AS (SELECT lang, w[s:s + m - 1] AS w, max(c) AS most
        FROM (SELECT lang, w, c, m, unnest(generate_series(1, k - m + 1)) AS s FROM cand, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
keep AS (SELECT low.*, array_to_string(low.w, ' ') AS phrase FROM low LEFT JOIN inn USING (lang, w) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM keep) JOIN t USING (lang)
WHERE rank <= 2000""",
    "op6_ngram_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[s:s + least(5, len(ws)) - 1], ' ') AS g
       FROM (SELECT r, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS s FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d USING (r) JOIN d o ON o.r = reach.o LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n""",
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s
             FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
dw AS (SELECT row_no, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
       FROM (SELECT row_no, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT row_no, s, n, item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY row_no),
its AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS item FROM hit) GROUP BY row_no)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (row_no) LEFT JOIN its USING (row_no)""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
w AS (SELECT r, s, array_to_string(ws[s:s + 34], ' ') AS g
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS s FROM d WHERE len(ws) >= 35)),
rep AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS p FROM w SEMI JOIN rep USING (g)),
word AS (SELECT r, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN hit USING (r, p) GROUP BY r),
gone AS (SELECT r, count(*) AS c FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
}
