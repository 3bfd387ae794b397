"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivec.llm import (
    decontaminate, language, licences, lines, lmscore, matroska, neardup, packing, sharding, spelling, suffix, toxicity, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), lmscore.one_in(5, 0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_texts(docs, labels, lmscore.one_in(4, 2))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(_table(spark, sf_dir, "documents")))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.as_media(_table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(_table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.remove_repeated_units(_table(spark, sf_dir, "documents")))


def op10_lattice_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lattice_scores(_table(spark, sf_dir, "documents"), lmscore.one_in(7, 2))


def op11_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16))


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
hit AS (SELECT r, s, p.n, item_id FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM pos) p
        JOIN win USING (n, g)),
covered AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""



def _op6_sql() -> str:
    known = ", ".join(f"({k}, '{s}')" for k, s in licences.SENTENCES.items())

    def matches(needed: tuple[int, ...]) -> str:
        return "regexp_matches(ids, '(^|,)" + "(,|,.*,)".join(map(str, needed)) + "(,|$)')"

    ranked = sorted(licences.RULES, key=lambda rule: -len(rule[1]))
    main = " ".join(f"WHEN {matches(needed)} THEN '{name}'" for name, needed in ranked)
    every = ", ".join(f"CASE WHEN {matches(needed)} THEN '{name}' END" for name, needed in licences.RULES)
    return f"""
WITH known(id, s) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id,
      string_split(regexp_replace(text, '([.!?;:])[ \t\n\x0B\f\r]+', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM documents),
u AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS position FROM d),
m AS (SELECT r, position, id FROM u
      JOIN known ON trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) = s),
g AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY position) AS ids, min(position) AS first FROM m GROUP BY r),
f AS (SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS ids, first FROM d LEFT JOIN g USING (r))
SELECT doc_id, n_known::BIGINT AS n_known, ids AS sentence_ids, CASE {main} END AS licence,
       array_to_string(list_sort(list_distinct([{every}])), ',') AS licences,
       coalesce(first, -1)::BIGINT AS first_position FROM f
"""


_OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, t, string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)) AS ls FROM d),
u AS (SELECT r, doc_id, t, len(ls) AS n, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM a WHERE t <> ''),
w AS (SELECT r, doc_id, n, k, l || CASE WHEN k < n OR t LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS raw,
      trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	

]+', ' ', 'g')) AS s FROM u),
p AS (SELECT *, s <> '' AS filled, sum(strlen(raw)) OVER (PARTITION BY r ORDER BY k) AS until FROM w),
q AS (SELECT *, filled AND row_number() OVER (PARTITION BY s, filled ORDER BY doc_id, k) > 1 AS gone FROM p),
g AS (SELECT r, max(n) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
      sum(strlen(raw)) FILTER (WHERE gone) AS bytes_removed, string_agg(raw, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept,
      string_agg((until - strlen(raw))::BIGINT || '-' || until::BIGINT, ',' ORDER BY k) FILTER (WHERE gone) AS spans
      FROM q GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(bytes_removed, 0)::BIGINT AS bytes_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(spans, '') AS spans, coalesce(kept, '') AS text
FROM d LEFT JOIN g USING (r)
"""

# The checksum is folded over the bytes with its table of 256 remainders; near words share a word with one
# code point taken out at one place (replaced), or one is the other with a code point taken out.
_OP13_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i, list_reduce([i::UBIGINT] || list_transform(range(8), lambda k: 0::UBIGINT),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS remainders FROM step),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, unnest(regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT head, run, count(*) AS c FROM runs GROUP BY ALL),
coded AS (SELECT run, c, hex(encode(head || run)) AS h, remainders FROM counted, crc),
summed AS (
  SELECT run, c, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(h) // 2), lambda k:
         (16 * (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) + instr('0123456789ABCDEF', h[2 * k + 2]) - 1)::UBIGINT),
         lambda a, b: xor(remainders[(xor(a, b) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT)::BIGINT AS h FROM coded),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word,
         sum(c)::BIGINT AS n
  FROM summed GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS MATERIALIZED (
  SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (
  SELECT DISTINCT word, other, other_n FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION ALL SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
    UNION ALL SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word)),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT follow.word, forms.form FROM follow JOIN forms ON follow.at = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN follow t ON t.word = f.word JOIN forms l ON l.word = t.at AND l.form IS NULL
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_license_scan": op6_license_scan,
    "op7_media_matroska": op7_media_matroska,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_lattice_lm_score": op10_lattice_lm_score,
    "op11_best_fit_sharding": op11_best_fit_sharding,
    "op12_cholesky_whitening": op12_cholesky_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op3_benchmark_decontamination": _OP3_SQL, "op6_license_scan": _op6_sql(), "op9_line_dedup": _OP9_SQL,
           "op13_spelling_variants": _OP13_SQL}
