"""The registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontaminate import decontaminate

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.6, overlap=0.8)
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


SQL_OP4 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"), words=3, seed=42, radius=2)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.records import encode_and_read_back

    return encode_and_read_back(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.tokens import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"), max_copies=3, weights=(1, 2, 3)).drop("copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents"), run=3, long=200).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL_OP2 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d WHERE len(ls) >= 3),
h AS (SELECT doc_id, i, md5(array_to_string(ls[i:i + 2], chr(10))) AS k FROM s),
f AS (SELECT k, min((doc_id, i)) AS first FROM h GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM h JOIN f USING (k) WHERE (doc_id, i) > first),
a AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
o AS (SELECT line, min((doc_id, i)) AS first FROM a WHERE length(line) >= 200 GROUP BY line HAVING count(*) > 1),
q AS (SELECT doc_id, i FROM a JOIN o USING (line) WHERE (doc_id, i) > first),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM r UNION ALL SELECT doc_id, i AS j FROM q) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


SQL_OP7 = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
n AS (SELECT *, row_number() OVER (ORDER BY encode(key)) - 1 AS nth FROM t),
l AS (SELECT *, nth % 3 + 1 AS weight, source_size * 3 AS bound FROM n),
v AS (SELECT *, bound::DOUBLE / weight AS level FROM l),
u AS (SELECT *, coalesce(sum(bound) OVER up, 0)::BIGINT AS gone, coalesce(sum(weight) OVER up, 0)::BIGINT AS used,
  sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights FROM v
  WINDOW up AS (ORDER BY level, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (total - gone)::DOUBLE / (weights - used) AS pace FROM u),
f AS (SELECT level AS f_level, nth AS f_nth, pace AS f_pace FROM p WHERE level > pace ORDER BY level, nth LIMIT 1),
g AS (SELECT key, source_size, CASE WHEN f_pace IS NULL OR level < f_level OR (level = f_level AND nth < f_nth) THEN bound::DOUBLE ELSE weight * f_pace END AS target
  FROM p LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS copies FROM g),
r AS (SELECT *, target - copies * source_size AS rest FROM c),
b AS (SELECT key, h, sum(size)::BIGINT AS here FROM d GROUP BY key, h),
s AS (SELECT b.key, h, here, sum(here) OVER (PARTITION BY b.key ORDER BY h) AS upto, rest FROM b JOIN r USING (key)),
m AS (SELECT key, arg_min(h, h) AS spot, arg_min(upto, h) AS upto, arg_min(here, h) AS here, any_value(rest) AS rest FROM s WHERE upto > rest GROUP BY key),
x AS (SELECT key, spot + CASE WHEN abs(upto - rest) < abs(rest - (upto - here)) THEN 1 ELSE 0 END AS below FROM m)
SELECT doc_id, size, source_size, target, (size * least(copies + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM d JOIN r USING (key) LEFT JOIN x USING (key)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.pii import find_pii

    return find_pii(read(spark, sf_dir, "documents"), accept=0.8, support=3, common=20)


SQL_OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id),
e AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM e
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.substring_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), window=35).drop("kept_text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.spelling import group_variants

    return group_variants(read(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, rate=199)


SQL_OP11 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
b AS (SELECT run, n, list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, p, substr(word, 1, p - 1) AS ahead, substr(word, p + 1) AS behind FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
near AS (SELECT x.word, y.word AS other, y.n FROM s x JOIN s y ON x.p = y.p AND x.ahead = y.ahead AND x.behind = y.behind AND x.word <> y.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = s.ahead || s.behind UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = s.ahead || s.behind),
best AS (SELECT word, other, n AS most, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL),
root AS (SELECT path.word, path.at AS root FROM path JOIN f ON f.word = path.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(read(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS ks, ('0x' || hx[1:8])::BIGINT AS h1, ('0x' || hx[9:16])::BIGINT AS h2,
  ('0x' || hx[17:24])::BIGINT AS h3, ('0x' || hx[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ks) AS n, least(h1 % (len(ks) + 1), h2 % (len(ks) + 1)) AS a, greatest(h1 % (len(ks) + 1), h2 % (len(ks) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(ks[1:a], ''), '') AS pre, coalesce(array_to_string(ks[a + 1:b], ''), '') AS mid, coalesce(array_to_string(ks[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.language_model import score_documents

    return score_documents(read(spark, sf_dir, "documents"), folds=5, held=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_quality, op2_line_dedup, op3_decontamination, op4_exact_dedup, op5_token_records, op6_token_counts, op7_mixing, op8_simhash, op9_pii, op10_substring_dedup, op11_spelling_variants, op12_fill_in_middle, op13_language_model)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": SQL_OP2, "op4_exact_dedup": SQL_OP4, "op7_mixing": SQL_OP7, "op10_substring_dedup": SQL_OP10, "op11_spelling_variants": SQL_OP11, "op12_fill_in_middle": SQL_OP12}
