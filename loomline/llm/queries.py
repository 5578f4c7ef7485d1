"""One query for each training-data operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontaminate, embed, extract, lm, minhash, search, secrets, shards, token_counts, toxicity
from .common import table

CONTROL = "</s>[INST] ok [/INST]"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null page has an empty one."""
    return extract.digest(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed.digest(table(spark, sf_dir, "embeddings"))


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return minhash.digest(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, folded from a log of parts, edits and regenerations, as read back from its
    formatted text, and one full of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digest(chat.streamed_log(turns.unionByName(extra)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted shards."""
    return shards.digest(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return token_counts.digest(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_decontamination,
        op3_embedding_dedup,
        op4_prob_minhash,
        op5_chat_format,
        op6_toxicity,
        op7_byte_bpe,
        op8_secret_scan,
        op9_lm_scores,
        op10_sharding,
        op11_ranked_search,
        op12_token_counts,
        op13_collocations,
    )
}

_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

ORACLES = {
    "op2_decontamination": f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS size
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM docs, sizes WHERE len(w) >= size),
found AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v
    ON v.size = p.size AND v.win = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS spot FROM found),
runs AS (
  SELECT doc_id, count(*) AS words FROM (SELECT doc_id, spot - row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS run FROM spots) GROUP BY doc_id, run),
hits AS (SELECT doc_id, sum(words)::BIGINT AS n_hit, coalesce(sum(words) FILTER (words > 50), 0)::BIGINT AS n_long FROM runs GROUP BY doc_id),
which AS (SELECT doc_id, count(item_id)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
judged AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_long, 0) AS n_long, coalesce(n_items, 0) AS n_items, coalesce(ids, '') AS ids,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN which USING (doc_id))
SELECT doc_id, n_words, n_hit, n_items, sha256(ids) AS items_sha256, contaminated, CASE WHEN contaminated THEN n_hit ELSE n_long END AS n_removed
FROM judged""",
    "op3_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a, unit b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links, min(other)::BIGINT AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id""",
    "op5_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(role || text) + len(regexp_extract_all(role || text, '\\\\|</?s>|<<?/?SYS>|<\\||\\[/?INST\\]')) + length('<|turn|><|body|><|end|>') AS size FROM turns),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(size)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said""",
    "op10_sharding": """
SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op11_ranked_search": """
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT d, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
facts AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
weights AS (SELECT item_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM wanted JOIN df USING (term), facts),
scored AS (
  SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM weights JOIN tf USING (term) JOIN sized USING (d), facts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50""",
    "op13_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
one AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM lists) GROUP BY ALL),
two AS (
  SELECT lang, g.a AS w1, g.b AS w2, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS g FROM lists WHERE len(w) > 1) GROUP BY ALL),
three AS (
  SELECT lang, g.a AS w1, g.b AS w2, g.c AS w3, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]})) AS g FROM lists WHERE len(w) > 2) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
often AS (SELECT * FROM three WHERE f >= 10),
covers AS (SELECT lang, w1, w2, max(f) AS top FROM (SELECT lang, w1, w2, f FROM often UNION ALL SELECT lang, w2, w3, f FROM often) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.w1 = t.w1 JOIN one q ON q.lang = t.lang AND q.w1 = t.w2
  LEFT JOIN covers v ON v.lang = t.lang AND v.w1 = t.w1 AND v.w2 = t.w2 WHERE t.f >= 10 AND coalesce(100 * v.top < 50 * t.f, TRUE)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, p.f, q.f
  FROM often t JOIN one p ON p.lang = t.lang AND p.w1 = t.w1 JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, p.f, q.f
  FROM often t JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN one q ON q.lang = t.lang AND q.w1 = t.w3),
scored AS (SELECT *, (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000""",
}
