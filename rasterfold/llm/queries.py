"""The subpackage's queries (name -> function of session and folder) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.llm.common import table

#: Categories of the chain, in order; see toxic_labels.
CATEGORIES = ["low_quality", "toxic"]


def toxic_labels(labels: DataFrame) -> DataFrame:
    """The two marks that labels has, as categories: low quality (quality marked 0) and toxic. A mark that is null counts as neither."""
    return labels.select("doc_id", (1 - F.coalesce(F.col("quality"), F.lit(1))).alias("low_quality"), F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic"))


def tokenizer_path(name: str) -> str:
    """Public vocabulary files stay where they are; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end=1)


def op3_learned_partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.sentencepiece_trie import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), toxic_labels(table(spark, sf_dir, "labels")), CATEGORIES)


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rasterfold.llm.bpe_replay import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterfold.llm.fim import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_best_fit_packing, op3_learned_partition_search, op4_sentencepiece, op5_exact_dedup, op6_quality, op7_ngram_join, op8_toxicity, op9_balanced_shards, op10_license_scan, op11_byte_bpe, op12_lexical_search, op13_fill_in_middle, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Maximal runs of what isn't ASCII, or is an ASCII letter or digit.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    from rasterfold.llm.license_scan import TEMPLATES

    values = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
    grams = "list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])"
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z]+'), lambda w: w <> '')"
    return f"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words} AS ws FROM t),
tg AS (SELECT license, unnest(list_distinct({grams})) AS g FROM tw),
ts AS (SELECT license, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS step FROM tg GROUP BY license),
dw AS (SELECT doc_id, {words} AS ws FROM documents),
dl AS (SELECT doc_id, {grams} AS gs FROM dw WHERE len(ws) >= 5),
d AS (SELECT doc_id, unnest(gs) AS g, unnest(range(0, len(gs))) AS p FROM dl),
hit AS (SELECT d.doc_id, tg.license, d.g, d.p, n, step FROM d JOIN tg USING (g) JOIN ts USING (license)),
inw AS (SELECT *, p // step AS w FROM hit UNION ALL SELECT *, p // step - 1 AS w FROM hit WHERE p // step > 0),
win AS (SELECT doc_id, license, w, count(DISTINCT g)::DOUBLE / max(n) AS containment, min(p) AS first_word FROM inw GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment, min(first_word)::BIGINT AS first_word FROM win WHERE containment >= 0.8 GROUP BY doc_id, license"""


ORACLE_SQL = {
    "op1_chat_format": """
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, len(l)::BIGINT AS n_turns, 0::BIGINT AS part, array_to_string(list_transform(l, lambda s: '<|im_start|>' || s.r || chr(10) || s.x || '<|im_end|>' || chr(10)), '') AS text
FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l) AND NOT EXISTS (SELECT 1 FROM t b WHERE b.l = a.l AND b.conv_id < a.conv_id)""",
    "op5_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op7_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
l AS (SELECT u, v FROM c WHERE 100 * i >= 90 * (n + m - i)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.v FROM r JOIN b ON r.y = b.u)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(y) AS component_id FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, len(g)""",
    "op10_license_scan": _license_sql(),
    "op12_lexical_search": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term),
i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
p AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS s FROM f JOIN d USING (doc_id) JOIN w USING (term), g),
s AS (SELECT item_id, doc_id, sum(c * s)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_fill_in_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS d FROM documents),
k AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS a, ('0x' || d[9:16])::BIGINT % (n + 1) AS b, ('0x' || d[17:24])::BIGINT % 100 AS r, ('0x' || d[25:32])::BIGINT % 100 AS m FROM h),
c AS (SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN m < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
x AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid ELSE '<S>' || s || '<P>' || p || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
}
