"""The queries of the operators in this folder over the whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import alignment, decontaminate, maintext, mixing, passages, pii, simhash, spelling, suffixes, telephony, tokens, toxicity, warc
from voxframe.workspace import new_path, write_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Scores from here on are toxic.
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintext.extract(table(spark, sf_dir, "pages"), maintext.fitted(), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("_vx_main").alias("text"), F.length("_vx_main").cast("long").alias("n_chars"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(spark, tokens.write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), TOKENIZER))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, "verify", errors="raise").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    rows = write_table(rows, "sizes")
    taken = mixing.mix(rows, size="size")
    return taken.select("doc_id", "size", F.col("_vx_source_size").alias("source_size"), F.col("_vx_target").alias("target"), (F.col("size") * F.col("_vx_copies")).alias("taken"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.fitted(), keep=["doc_id"]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_vx_score").alias("score"), F.when(F.col("_vx_score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.locate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digest(found)


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.read(telephony.store(table(spark, sf_dir, "documents"), codec=list(telephony.CODECS)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents"), typo=97))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"], longest=False)
    gone = F.aggregate("_vx_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("_vx_n_words").alias("n_words"), gone.alias("n_removed"), F.sha2(F.col("_vx_kept").cast("binary"), 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES, keep=["doc_id"], digest=True)
    return found.select("doc_id", *[F.col(f"_vx_{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.col("_vx_groups").alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash_near_dedup, op3_main_text, op4_token_output, op5_warc, op6_source_mixing, op7_personal_data, op8_toxicity, op9_benchmark_decontamination, op10_telephony_audio, op11_spelling_variants, op12_repeated_passages, op13_token_alignment)}

ORACLE_SQL = {
    "op6_source_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(rk - 1) % 3 + 1]::BIGINT AS w, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w::DOUBLE, rk) AS pos FROM w),
c AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS num,
        sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS den FROM o),
k AS (SELECT arg_min(num, pos) AS num, arg_min(den, pos) AS den, min(pos) AS pos FROM c WHERE num::HUGEINT * w <= cap::HUGEINT * den),
t AS (SELECT source, rk, source_size, CASE WHEN c.pos >= k.pos THEN (k.num * w)::DOUBLE / k.den::DOUBLE ELSE cap::DOUBLE END AS target FROM c LEFT JOIN k ON true),
r AS (SELECT *, target - whole * source_size AS rest FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)),
z AS (SELECT rk, size, rest, sum(k * size) OVER (PARTITION BY rk ORDER BY size DESC)::BIGINT AS above, sum(k * size * size) OVER (PARTITION BY rk)::HUGEINT AS squares,
        sum(k * size * size) OVER (PARTITION BY rk ORDER BY size DESC)::HUGEINT AS square FROM (SELECT source, size, count(*)::HUGEINT AS k FROM d WHERE size > 0 GROUP BY ALL) x JOIN r ON x.source IS NOT DISTINCT FROM r.source WHERE rest > 0),
y AS (SELECT rk, any_value(rest) AS rest, any_value(squares) AS squares, min({'size': size, 'above': above, 'below': squares - square}) FILTER (above::DOUBLE + (squares - square)::DOUBLE / size::DOUBLE <= rest) AS c FROM z GROUP BY rk),
x AS (SELECT rk, c.size AS sure, rest - coalesce(c.above, 0) AS remains, coalesce(c.below, squares)::DOUBLE AS below FROM y),
u AS (SELECT d.doc_id, d.size, r.*, sure, remains, CASE WHEN below > 0 THEN remains / below ELSE 0 END AS f, (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '|11'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN x ON r.rk = x.rk),
p AS (SELECT *, coalesce(size >= sure, false) AS certain, CASE WHEN coalesce(size >= sure, false) OR f = 0 THEN NULL ELSE least(f * greatest(size, 1), 1.0::DOUBLE) END AS p FROM u),
q AS (SELECT *, (u / (1 - u)) * ((1 - p) / p) AS q FROM p),
n AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY rk, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT END AS cum FROM q)
SELECT doc_id, size, source_size, target,
  size * (whole + certain::BIGINT + CASE WHEN cum <= remains OR cum - remains < remains - (cum - size) THEN 1 ELSE 0 END) AS taken FROM n
""",
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS c FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99), 500)) AS o FROM d)),
s AS (SELECT doc_id, o + i AS p, md5_number(substr(c, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, o, c, unnest(range(0, len(c) // 2 - 99)) AS i FROM t)),
f AS (SELECT m, min((doc_id, p)) AS first FROM s GROUP BY m HAVING count(*) > 1),
k AS (SELECT doc_id, p FROM s JOIN f USING (m) WHERE (doc_id, p) <> first),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM k),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM u GROUP BY doc_id, run),
c AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
x AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (SELECT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') AS digest, top FROM g)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN b USING (h)
""",
    "op9_benchmark_decontamination": """
WITH i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
ip AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p + 1 : p + n], ' ') AS k FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
m AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS k FROM dp) JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_spelling_variants": """
WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || [0::BIGINT for _ in range(8)], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT doc, w, count(*) AS k, hex(encode(doc || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY doc, w),
h AS (SELECT w, k, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::BIGINT for i in range(len(x) // 2)], lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM g, t),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN c % 97 = 0 THEN substr(w, 1, c % length(w)) || substr(w, c % length(w) + 2) ELSE w END AS word, k FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
e AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM e a JOIN e b USING (x, i) WHERE a.word <> b.word UNION SELECT e.word, x FROM e JOIN v o ON o.word = x UNION SELECT x, e.word FROM e JOIN v o ON o.word = x),
m AS (SELECT a, count(*) AS n_near, min({'n': -v.n, 'w': v.word}) AS top FROM p JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.w END AS form, CASE WHEN -top.n >= 2 * n THEN -top.n END AS form_n FROM v LEFT JOIN m ON a = word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM f JOIN c ON c.word = f.word JOIN f z ON z.word = c.root WHERE z.form IS NULL
""",
    "op12_repeated_passages": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS p FROM d),
h AS (SELECT doc_id, p, md5_number(array_to_string(w[p + 1 : p + 13], ' ')) AS m FROM p),
f AS (SELECT m, min(doc_id) AS first FROM h GROUP BY m HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM h JOIN f USING (m) WHERE doc_id > first) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w[q + 1], ' ' ORDER BY q) AS kept FROM (SELECT doc_id, w, unnest(range(len(w))) AS q FROM d) a ANTI JOIN (SELECT doc_id, unnest(gone) AS q FROM g) b USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
""",
}
