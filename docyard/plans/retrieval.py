"""Registered queries of the retrieval side: recall per chunk setting, approximate search, wide embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docyard.functions.hashing import chunk_hash
from docyard.functions.text import bind_column
from docyard.operators import chunking as K
from docyard.operators import lsh as L
from docyard.operators.embed import hashed_counts
from docyard.operators.gold import SHARE, SHINGLE, gold_chunks
from docyard.operators.search import SHARD_VECTORS, MIN_SHARDS, cosine_topk
from docyard.plans import sqltext as S
from docyard.plans.catalog import (EMBED_SIZE, FIXED_SQL, OVERLAP_PCT, REPORT_SETTINGS, SIZE, normalize_types, packing_sql,
                                   register)
from docyard.session import cut_lineage
from docyard.sources.tables import corpus_documents, read_table

TOPK = 5
#: Width of the default embedding when chunk settings are compared.
RECALL_WIDTH = 256


# ---------------------------------------------------------------- recall@5 per chunk setting
def _chunks_sql(n: int, strategy: str, size: int, pct: float) -> str:
    ov = int(size * pct)
    if strategy != "fixed":
        return f"""({packing_sql(size, ov)} SELECT {n} AS setting, s.doc_id, s.chunk_index,
substr(d.text, CAST(s.start_char + 1 AS BIGINT), CAST(s.end_char - s.start_char AS BIGINT)) AS text
FROM sem s JOIN documents d ON d.doc_id = s.doc_id)"""
    step = size - ov
    return f"""(WITH t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, toks, unnest(range(0, {S.chunk_count('n', size, step)})) AS chunk_index FROM c)
SELECT {n} AS setting, doc_id, chunk_index, array_to_string(toks[chunk_index*{step}+1:chunk_index*{step}+{size}], '') AS text FROM k)"""


def _shingles_sql(words: str) -> str:
    return (f"CASE WHEN len({words}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({words}) - {SHINGLE - 1}, 1) + 1), "
            f"lambda i: array_to_string({words}[i:i+{SHINGLE - 1}], ' '))) END")


def _recall_sql() -> str:
    chunks = "\nUNION ALL\n".join(_chunks_sql(n, *s) for n, s in enumerate(REPORT_SETTINGS))
    names = ", ".join(f"({n}, '{s}', {size}, {int(size * pct)})" for n, (s, size, pct) in enumerate(REPORT_SETTINGS))
    return f"""
WITH names AS (SELECT * FROM (VALUES {names}) x(setting, chunk_strategy, chunk_size, overlap_tokens)),
ch AS MATERIALIZED (SELECT setting, doc_id, chunk_index, regexp_extract_all(lower(text), {S.lit(S.WORD)}) AS words FROM ({chunks})),
pa AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), {S.lit(S.WORD)}) AS words FROM benchmark),
ps AS (SELECT item_id, {_shingles_sql('words')} AS hs FROM pa),
pe AS (SELECT item_id, len(hs) AS size, unnest(hs) AS h FROM ps),
ce AS (SELECT setting, doc_id, chunk_index, unnest({_shingles_sql('words')}) AS h FROM ch),
gold AS MATERIALIZED (SELECT setting, doc_id, chunk_index, item_id FROM ce JOIN pe USING (h)
         GROUP BY setting, doc_id, chunk_index, item_id, size HAVING count(*) >= ceil({SHARE} * size)),
cv AS (SELECT setting, doc_id, chunk_index, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % {RECALL_WIDTH} AS pos,
              sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END) AS n
       FROM (SELECT setting, doc_id, chunk_index, md5(unnest(words)) AS m FROM ch) GROUP BY ALL),
pv AS (SELECT item_id, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % {RECALL_WIDTH} AS pos,
              sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END) AS n
       FROM (SELECT item_id, md5(unnest(words)) AS m FROM pa) GROUP BY ALL),
cn AS (SELECT setting, doc_id, chunk_index, sqrt(sum(n * n)::DOUBLE) AS z FROM cv GROUP BY ALL),
pn AS (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS z FROM pv GROUP BY ALL),
dots AS (SELECT setting, doc_id, chunk_index, item_id, sum(cv.n * pv.n)::DOUBLE AS d FROM cv JOIN pv USING (pos) GROUP BY ALL),
sc AS (SELECT ch.setting, ch.doc_id, ch.chunk_index, pa.item_id, coalesce(d / nullif(pn.z * cn.z, 0), 0.0) AS score
       FROM ch JOIN pa ON TRUE LEFT JOIN dots ON dots.setting = ch.setting AND dots.doc_id = ch.doc_id
            AND dots.chunk_index = ch.chunk_index AND dots.item_id = pa.item_id
            LEFT JOIN cn ON cn.setting = ch.setting AND cn.doc_id = ch.doc_id AND cn.chunk_index = ch.chunk_index
            LEFT JOIN pn ON pn.item_id = pa.item_id),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY setting, item_id ORDER BY score DESC, doc_id, chunk_index) <= {TOPK}),
per AS (SELECT gold.setting, gold.item_id, count(*) AS gold, count(top.doc_id) AS hits
        FROM gold LEFT JOIN top ON top.setting = gold.setting AND top.item_id = gold.item_id AND top.doc_id = gold.doc_id
             AND top.chunk_index = gold.chunk_index GROUP BY ALL)
SELECT chunk_strategy, CAST(chunk_size AS BIGINT) AS chunk_size, CAST(overlap_tokens AS BIGINT) AS overlap_tokens,
       count(*) AS gold_passages, CAST(sum(gold) AS BIGINT) AS gold_chunks, CAST(sum(hits) AS BIGINT) AS hits,
       round(count(*) FILTER (WHERE hits > 0) / count(*), 6) AS recall,
       round(sum(hits) / sum(least(gold, {TOPK})), 6) AS gold_found
FROM per JOIN names USING (setting) GROUP BY ALL
"""


def _setting_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of every setting: setting, id (sorts as document, then chunk), text."""
    out = None
    for n, (strategy, size, pct) in enumerate(REPORT_SETTINGS):
        c = K.chunk(docs, strategy, size, pct, offsets=False).select(
            F.lit(n).alias("setting"), F.format_string("%d/%015d/%09d", F.lit(n), "doc_id", "chunk_index").alias("id"), "text")
        c = c if strategy == "fixed" else cut_lineage(c)  # two readers: sentence packing passes through Python, so it is kept once
        out = c if out is None else out.unionByName(c)
    return out


def chunk_recall(docs: DataFrame, passages: DataFrame, k: int = TOPK, width: int = RECALL_WIDTH) -> DataFrame:
    """Per chunk setting, recall@k of the default embedding: each passage asks for the chunks that hold it.

    ``recall``: share of the passages (that some chunk holds) with a gold chunk among the first k; ``gold_found``: gold chunks
    found, of those that k places could hold.
    """
    chunks = _setting_chunks(docs)
    gold = gold_chunks(passages, chunks, ("setting", "id"))
    settings = F.explode(F.sequence(F.lit(0), F.lit(len(REPORT_SETTINGS) - 1)))
    # every chunk and passage is embedded once, and kept: the vectors have no other reader than the search
    texts = chunks.select("setting", "id", "text", F.lit(None).cast(passages.schema["passage_id"].dataType).alias("passage_id"))
    texts = texts.unionByName(passages.select("passage_id", "text", F.lit(-1).alias("setting")), allowMissingColumns=True)
    kept = cut_lineage(texts.select("setting", "id", "passage_id", hashed_counts("text", width).alias("v")))
    vectors = kept.filter("setting >= 0").select("setting", "id", "v")
    asked = kept.filter("setting < 0").select("passage_id", "v", settings.alias("setting")).select(
        "setting", F.concat_ws("/", "setting", "passage_id").alias("query_id"), "v")
    size = docs.agg(F.sum(F.length("content"))).first()[0] or 0   # a token has four characters or so
    shards = max(MIN_SHARDS, -(-size // (4 * SIZE * SHARD_VECTORS)))
    top = cosine_topk(vectors, asked, k, "id", "v", "v", "setting", shards)
    per = (gold.withColumn("query_id", F.concat_ws("/", "setting", "passage_id"))
           .join(top.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
           .groupBy("setting", "passage_id").agg(F.count(F.lit(1)).alias("gold"), F.count("_hit").alias("hits")))
    return per.groupBy("setting").agg(
        F.count(F.lit(1)).alias("gold_passages"), F.sum("gold").alias("gold_chunks"), F.sum("hits").alias("hits"),
        F.round(F.count_if(F.col("hits") > 0) / F.count(F.lit(1)), 6).alias("recall"),
        F.round(F.sum("hits") / F.sum(F.least("gold", F.lit(k))), 6).alias("gold_found"))


@register("chunk_recall", _recall_sql())
def q_chunk_recall(spark, sf):
    """Recall@5 of the benchmark passages for each listed chunk setting."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    passages = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    r = chunk_recall(docs, passages)
    name = lambda i, kind: F.get(F.array(*[F.lit(v) for v in kind]), F.col("setting")).alias(i)
    return normalize_types(r.select(
        name("chunk_strategy", [s for s, _, _ in REPORT_SETTINGS]), name("chunk_size", [n for _, n, _ in REPORT_SETTINGS]),
        name("overlap_tokens", [int(n * p) for _, n, p in REPORT_SETTINGS]),
        "gold_passages", "gold_chunks", "hits", "recall", "gold_found"))


# ---------------------------------------------------------------- approximate search
#: Every so manyth vector asks.
QUERY_STEP = 20

LSH_SQL = f"""
WITH size AS (SELECT greatest({L.BITS}, CAST(ceil(log2(greatest(1, count(*) / {float(L.BUCKET_VECTORS)}))) AS INTEGER)) AS bits FROM embeddings),
pl AS MATERIALIZED (SELECT t, b, d, CASE WHEN substr(md5(t || ':' || b || ':' || d), 1, 1) < '8' THEN 1 ELSE -1 END AS s
       FROM (SELECT unnest(range(0, {L.TABLES})) AS t), (SELECT unnest(range(0, (SELECT bits FROM size))) AS b),
            (SELECT unnest(range(0, {EMBED_SIZE})) AS d)),
x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings
      WHERE len(embedding) = {EMBED_SIZE}),
pr AS MATERIALIZED (SELECT vec_id, t, b, sum(floor({L.RESOLUTION} * v)::BIGINT * s) AS p FROM x JOIN pl USING (d) GROUP BY ALL),
code AS MATERIALIZED (SELECT vec_id, t, sum(CASE WHEN p > 0 THEN 1 << b ELSE 0 END)::BIGINT AS c FROM pr GROUP BY ALL),
masks AS (SELECT m FROM (SELECT unnest(range(0, 1 << (SELECT bits FROM size))) AS m) WHERE bit_count(m) <= {L.CROSSED}),
cost AS (SELECT vec_id, t, m, sum(CASE WHEN (m >> b) & 1 = 1 THEN abs(p) ELSE 0 END) AS k
         FROM pr JOIN masks ON vec_id % {QUERY_STEP} = 0 GROUP BY ALL),
probe AS (SELECT cost.vec_id, t, xor(code.c, m::BIGINT) AS c FROM cost JOIN code USING (vec_id, t)
          QUALIFY row_number() OVER (PARTITION BY cost.vec_id, t ORDER BY k, m) <= {L.PROBES}),
cand AS (SELECT DISTINCT probe.vec_id AS query_id, code.vec_id FROM probe JOIN code USING (t, c) WHERE probe.vec_id <> code.vec_id),
vn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id),
ex AS MATERIALIZED (SELECT a.vec_id AS query_id, b.vec_id, sum(a.v * b.v) / (any_value(q.n) * any_value(c.n)) AS score
       FROM x a JOIN x b ON a.vec_id % {QUERY_STEP} = 0 AND a.d = b.d AND a.vec_id <> b.vec_id
            JOIN vn q ON q.vec_id = a.vec_id JOIN vn c ON c.vec_id = b.vec_id GROUP BY a.vec_id, b.vec_id),
near AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
         FROM cand JOIN ex USING (query_id, vec_id) QUALIFY rank <= {TOPK})
"""


def _others(ranked: DataFrame) -> DataFrame:
    """The first TOPK vectors other than the query itself, of TOPK + 1 ranked ones (ids are unique)."""
    own = F.max(F.when(F.col("vec_id") == F.col("query_id"), F.col("rank")))
    place = ranked.groupBy("query_id").agg(own.alias("_own"))
    rest = ranked.join(place, "query_id").filter(F.col("vec_id") != F.col("query_id"))
    return (rest.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("_own"), 1).otherwise(0)).drop("_own")
            .filter(F.col("rank") <= TOPK))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@register("cosine_topk_lsh", LSH_SQL + """
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM near
""")
def q_cosine_topk_lsh(spark, sf):
    """Approximate top-5 other vectors of every 20th vector."""
    e = read_table(spark, sf, "embeddings")
    r = _others(L.cosine_topk_lsh(e, _asked(e), TOPK + 1))
    return normalize_types(r.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score")))


@register("lsh_recall", LSH_SQL + f"""
, top AS (SELECT query_id, vec_id FROM ex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {TOPK})
SELECT count(DISTINCT top.query_id) AS queries, count(*) AS exact, count(near.vec_id) AS found,
       round(count(near.vec_id) / count(*), 6) AS recall
FROM top LEFT JOIN near ON near.query_id = top.query_id AND near.vec_id = top.vec_id
""")
def q_lsh_recall(spark, sf):
    """Recall of the approximate top-5 against the exact one."""
    e = read_table(spark, sf, "embeddings")
    near = _others(L.cosine_topk_lsh(e, _asked(e), TOPK + 1)).select("query_id", "vec_id", F.lit(1).alias("_hit"))
    exact = _others(cosine_topk(e, _asked(e), TOPK + 1))
    both = exact.join(near, ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("exact"), F.count("_hit").alias("found"),
                    F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


# ---------------------------------------------------------------- the default embedding at full width
WIDE = 1024


@register("embed_hashed_1024", FIXED_SQL + f"""
, words AS (SELECT doc_id, chunk_index, md5(unnest(regexp_extract_all(lower(text), {S.lit(S.WORD)}))) AS h FROM w),
sums AS (SELECT doc_id, chunk_index, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {WIDE} AS pos,
                sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS n FROM words GROUP BY ALL),
grid AS (SELECT doc_id, chunk_index, unnest(range(0, {WIDE})) AS pos FROM w)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, count(*) AS dim, count(*) FILTER (WHERE coalesce(n, 0) <> 0) AS nonzero,
       sha256(string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY pos)) AS counts_sha256
FROM grid LEFT JOIN sums USING (doc_id, chunk_index, pos) GROUP BY doc_id, chunk_index
""")
def q_embed_hashed_1024(spark, sf):
    """The counts behind the default model's vectors of every fixed chunk, at a width of 1024."""
    c = K.chunk_fixed(corpus_documents(spark, sf), SIZE, OVERLAP_PCT, offsets=False).select("doc_id", "chunk_index", "text")
    v = bind_column(c, "v", hashed_counts("text", WIDE))
    return normalize_types(v.select(
        "doc_id", "chunk_index", F.size("v").alias("dim"), F.size(F.array_remove("v", 0)).alias("nonzero"),
        chunk_hash(F.array_join(F.col("v").cast("array<string>"), ",")).alias("counts_sha256")))
