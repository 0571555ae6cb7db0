"""One query per operator over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import chat, decontam, divergence, hard_negatives, html_text, langid, mixing, near_dup, pitman_yor, quality, secret_scan, sharding, toxicity
from fieldtally.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_report(table(spark, sf_dir, "documents"))


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
OP2 = rf"""
WITH d AS (SELECT doc_id, source, {WORDS} AS size, md5(concat(doc_id::VARCHAR, '|mix')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) - cap AS capped,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight DESC, source DESC NULLS FIRST) AS weights FROM w),
l AS (SELECT max(level) AS level FROM (SELECT ((SELECT sum(source_size) FROM s) - capped)::DOUBLE / weights::DOUBLE AS level, cap, weight FROM r)
      WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target FROM w, l),
p AS (SELECT doc_id, size, source_size, target,
             sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t USING (source) UNION ALL
      SELECT doc_id, size, source_size, target, sum(size) OVER (ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size
      FROM d JOIN t ON d.source IS NULL AND t.source IS NULL)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size))
        + greatest(0, least(size, round(target)::BIGINT - start - 2 * source_size)))::BIGINT AS taken
FROM p
"""


@query("op2_source_mix", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def _draw(node: str, weight: float) -> str:
    bits = f"CAST(concat('0x', substr(md5(concat(coalesce(doc_id::VARCHAR, ''), '|{node}')), 1, 13)) AS BIGINT)"
    return f"struct_pack(d := -ln(({bits}::DOUBLE + 1.0) / 4503599627370497.0) / {weight}, n := '{node}')"


def _least(children: dict[str, float]) -> str:
    return f"list_min([{', '.join(_draw(n, w) for n, w in children.items())}]).n"


def _shards(n: int, into: str) -> str:
    tree = sharding.TREE if n == 16 else sharding.grown(sharding.TREE)
    regions = {r: sum(x.weight for x in tree if x.region == r) for r in dict.fromkeys(x.region for x in tree)}
    rack = " ".join(f"WHEN '{r}' THEN {_least({k: sum(x.weight for x in tree if x.rack == k) for k in dict.fromkeys(x.rack for x in tree if x.region == r)})}" for r in regions)
    leaf = " ".join(f"WHEN '{k}' THEN {_least({str(x.shard): x.weight for x in tree if x.rack == k})}" for k in dict.fromkeys(x.rack for x in tree))
    return f"""{into} AS (SELECT doc_id, CAST(CASE rack {leaf} END AS INT) AS {into}
        FROM (SELECT doc_id, CASE region {rack} END AS rack FROM (SELECT doc_id, {_least(regions)} AS region FROM documents)))"""


#: checks everything but the checksum and the order of slots, which DuckDB has no function for
OP4_BALANCE = f"""
WITH {_shards(16, 'shard')}, {_shards(17, 'grown_shard')}
SELECT d.doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'key' AS law, shard, grown_shard
FROM documents d JOIN shard USING (doc_id) JOIN grown_shard USING (doc_id)
"""


@query("op4_hash_tree_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


@query("llm_shard_placement", OP4_BALANCE)
def shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placement part of op4 alone, for comparison with SQL."""
    return sharding.shard_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "law", "shard", F.col("grown_shard"))


@query("op10_prob_min_hash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8 = f"""
WITH i AS (SELECT item_id, {_LIST} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, k0, k0 + least(len(w), 13) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k0 FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_LIST} AS w FROM documents),
dw AS (SELECT doc_id, n, k0, list_slice(w, k0, k0 + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k0 FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, k0, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k0, k0 + n)) AS pos FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op8_winnowing", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: a conversation whose texts hold what looks like the template's control strings
TRICKY = r"\### Assistant: </turn> ok"


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.conversation_report(rows.unionByName(tricky))


@query("op5_word_backoff")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


@query("op7_blob_ledger")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query("op6_site_templates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


@query("op9_pitman_yor")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_report(table(spark, sf_dir, "documents"))


OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) for x in embedding] AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op13_angular_negatives", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=moved)


OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_count FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS lang_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(m.n, 0) + 2 * l.v) AS p,
             1 + 1000000000::HUGEINT * (k.lang_count + 2) // (l.lang_n + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op11_noisy_channel")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
