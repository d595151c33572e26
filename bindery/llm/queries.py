"""The registered queries of the operators, with their production parameters, and the SQL that some can be held against.

Each query reads its whole table, goes through its operator and derives the columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import collocations, decontaminate, html, langid, lines, lm, maxscore, mixing, pieces, quality, shards, simhash, toxicity
from bindery.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _crc_rest(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def _toxicity_held_out():
    return F.coalesce(_crc_rest(3) == 1, F.lit(False))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    return table(spark, sf_dir, "labels").where(~_toxicity_held_out()).select("doc_id", "toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _toxicity_held_out()
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_result(table(spark, sf_dir, "documents"))


def sharding_result(docs: DataFrame) -> DataFrame:
    out = shards.shard_documents(docs, n_shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_crc_rest(4) == 2, F.lit(False))
    out = langid.identify(table(spark, sf_dir, "documents"), train=~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed vocabularies have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.tokenise(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op1_line_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT row_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d
), k AS (
  SELECT row_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l
), f AS (
  SELECT line_key FROM k WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT row_id) >= 10
), m AS (
  SELECT k.row_id, count(*) AS n_lines, count(f.line_key) AS n_dropped,
         coalesce(string_agg(CASE WHEN f.line_key IS NULL THEN line END, chr(10) ORDER BY pos), '') AS kept
  FROM k LEFT JOIN f ON k.line_key = f.line_key GROUP BY k.row_id
)
SELECT d.doc_id, m.n_lines, m.n_dropped, sha256(m.kept) AS kept_sha256 FROM d JOIN m ON d.row_id = m.row_id
""",
    "op2_lm_scoring": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), l AS (
  SELECT row_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM d
), t AS (
  SELECT row_id, pos, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM l WINDOW p AS (PARTITION BY row_id ORDER BY pos)
), o1 AS (
  SELECT row_id, w, count(*) AS n FROM t GROUP BY ALL
), o2 AS (
  SELECT row_id, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL
), o3 AS (
  SELECT row_id, u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL
), c1 AS (  -- of each document's n-grams, the occurrences in other documents
  SELECT row_id, w, sum(n) OVER (PARTITION BY w) - n AS c FROM o1
), c2 AS (
  SELECT row_id, v, w, sum(n) OVER (PARTITION BY v, w) - n AS c FROM o2
), c3 AS (
  SELECT row_id, u, v, w, sum(n) OVER (PARTITION BY u, v, w) - n AS c FROM o3
), words AS (
  SELECT row_id, (SELECT count(*) FROM l) - len(ws) AS others FROM d
), s AS (
  SELECT t.row_id, CASE
    WHEN c3.c > 0 THEN log10(c3.c / uv.c)
    WHEN c2.c > 0 THEN log10(c2.c / v.c) + CASE WHEN t.u IS NULL THEN 0 ELSE log10(0.4) END
    ELSE log10(greatest(w.c, 0.5) / greatest(others, 1)) + CASE WHEN t.v IS NULL THEN 0 WHEN t.u IS NULL THEN 1 ELSE 2 END * log10(0.4)
  END AS value
  FROM t JOIN words USING (row_id)
  JOIN c1 w ON w.row_id = t.row_id AND w.w = t.w
  LEFT JOIN c1 v ON v.row_id = t.row_id AND v.w = t.v
  LEFT JOIN c2 ON c2.row_id = t.row_id AND c2.v = t.v AND c2.w = t.w
  LEFT JOIN c2 uv ON uv.row_id = t.row_id AND uv.v = t.u AND uv.w = t.v
  LEFT JOIN c3 ON c3.row_id = t.row_id AND c3.u = t.u AND c3.v = t.v AND c3.w = t.w
), m AS (
  SELECT row_id, avg(value) AS score FROM s GROUP BY row_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(m.score, 6) AS score FROM d LEFT JOIN m ON d.row_id = m.row_id
""",
    "op3_decontamination": r"""
WITH dw AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), iw AS (
  SELECT row_number() OVER () AS item_row, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT row_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT row_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM dw WHERE len(w) > 0)
), its AS (
  SELECT DISTINCT item_row, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT item_row, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM iw WHERE len(w) > 0)
), q AS (
  SELECT item_row, count(*) AS n_item FROM its GROUP BY item_row
), hits AS (
  SELECT row_id, item_row, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY row_id, item_row
)
SELECT dw.doc_id, iw.item_id, n_shared, n_item, n_shared / n_item AS containment
FROM hits JOIN q USING (item_row) JOIN dw USING (row_id) JOIN iw USING (item_row)
WHERE n_shared >= 0.8 * n_item
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), b AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark
), q AS (
  SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS t FROM b) GROUP BY ALL
), figures AS (
  SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), m AS (
  SELECT row_id, doc_id, ts, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, figures WHERE len(ts) > 0
), tf AS (
  SELECT row_id, doc_id, m, t, count(*) AS tf FROM (SELECT row_id, doc_id, m, unnest(ts) AS t FROM m) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, figures GROUP BY t, n_docs
), i AS (
  SELECT row_id, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact FROM tf JOIN w USING (t)
), s AS (
  SELECT item, item_id, doc_id, row_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY ALL
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
""",
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM p
), t AS (
  SELECT lang, unnest(ws) AS w0, unnest(ws[2:]) AS w1, unnest(ws[3:]) AS w2 FROM w
), g AS (
  SELECT lang, w0 AS phrase, 1 AS m FROM t WHERE w0 IS NOT NULL
  UNION ALL SELECT lang, w0 || ' ' || w1, 2 FROM t WHERE w1 IS NOT NULL
  UNION ALL SELECT lang, w0 || ' ' || w1 || ' ' || w2, 3 FROM t WHERE w2 IS NOT NULL
), f AS (
  SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10
), k AS (
  SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f)) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[: k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1 :], ' ')
), least AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE len(ws) = 3
  ) GROUP BY ALL
), n AS (
  SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM least JOIN n USING (lang) LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
""",
}
