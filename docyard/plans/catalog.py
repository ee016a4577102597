"""Registered queries over the given tables, each with its DuckDB oracle.

Each query is ``(spark, sf_dir) -> DataFrame`` over whole tables. Integer
outputs are BIGINT and floats DOUBLE on both sides so schemas compare equal;
every computed column carries the same alias in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, LongType, DoubleType, ShortType, ByteType

from docyard.functions import text as T
from docyard.functions.hashing import chunk_hash, point_id
from docyard.operators import chunking as K
from docyard.operators import dedup as D
from docyard.operators.clean import clean_text
from docyard.operators.tokenize import regex_token_count
from docyard.plans import sqltext as S
from docyard.sources.tables import corpus_documents, read_table, stream_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def normalize_types(df: DataFrame) -> DataFrame:
    """Widen INT to BIGINT and FLOAT to DOUBLE so result schemas are stable."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            cols.append(F.col(f.name).cast(LongType()).alias(f.name))
        elif isinstance(f.dataType, FloatType):
            cols.append(F.col(f.name).cast(DoubleType()).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# Default chunking settings (512 tokens, 15% overlap -> 76 tokens).
SIZE = 512
OVERLAP_PCT = 0.15
STEP = SIZE - int(SIZE * OVERLAP_PCT)


# ---------------------------------------------------------------- cleaning
@register("normalize_unicode", f"""
SELECT doc_id, {S.normalize_unicode('text')} AS content FROM documents
""")
def q_normalize_unicode(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_unicode("text").alias("content"))


@register("strip_boilerplate", f"""
SELECT doc_id, {S.strip_boilerplate('text')} AS content FROM documents
""")
def q_strip_boilerplate(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.strip_boilerplate("text").alias("content"))


@register("clean_whitespace", f"""
SELECT doc_id, {S.normalize_whitespace('text')} AS content FROM documents
""")
def q_clean_whitespace(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.normalize_whitespace("text").alias("content"))


@register("clean_text", f"""
SELECT doc_id, content, CAST(length(content) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {S.clean('text')} AS content FROM documents)
""")
def q_clean_text(spark, sf):
    d = corpus_documents(spark, sf)
    c = clean_text(d, "content")
    return c.select("doc_id", "content", F.length("content").cast("bigint").alias("n_chars"))


@register("normalize_query", f"""
SELECT conv_id, turn, role, q AS query, length(q) = 0 AS is_empty
FROM (SELECT conv_id, turn, role, {S.normalize_query('text')} AS q FROM conversations)
""")
def q_normalize_query(spark, sf):
    """Every turn as query text."""
    c = read_table(spark, sf, "conversations")
    q = c.select("conv_id", "turn", "role", T.normalize_query("text").alias("query"))
    return q.withColumn("is_empty", F.length("query") == 0)


# ---------------------------------------------------------------- tokens and fixed chunks
@register("token_counts", f"""
SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n_tokens FROM documents
""")
def q_token_counts(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", regex_token_count("text").cast("bigint").alias("n_tokens"))


FIXED_SQL = f"""
WITH t AS (SELECT doc_id, source AS tenant_id, {S.tokens('text')} AS toks FROM documents),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, tenant_id, toks, n, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
w AS (SELECT doc_id, tenant_id, chunk_index,
             length(array_to_string(toks[1:chunk_index*{STEP}], '')) AS start_char,
             array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '') AS text,
             len(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}]) AS n_tokens
      FROM k)
"""


@register("chunk_fixed", FIXED_SQL + """
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_char AS BIGINT) AS start_char,
       CAST(start_char + length(text) AS BIGINT) AS end_char, CAST(n_tokens AS BIGINT) AS n_tokens,
       sha256(text) AS chunk_hash
FROM w
""")
def q_chunk_fixed(spark, sf):
    d = corpus_documents(spark, sf)
    c = K.chunk_fixed(d, SIZE, OVERLAP_PCT)
    return normalize_types(c.select("doc_id", "chunk_index", "start_char", "end_char", "n_tokens",
                                    chunk_hash("text").alias("chunk_hash")))


@register("chunk_hash_point_id", FIXED_SQL + f"""
, h AS (SELECT doc_id, chunk_index, sha256(text) AS chunk_hash FROM w)
, u AS (SELECT *, {S.sha1_name('chunk_hash')} AS s1 FROM h)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash, {S.uuid5_from_sha1('s1')} AS point_id FROM u
""")
def q_chunk_hash_point_id(spark, sf):
    d = corpus_documents(spark, sf)
    c = K.chunk_fixed(d, SIZE, OVERLAP_PCT, offsets=False)
    h = c.select("doc_id", "chunk_index", chunk_hash("text").alias("chunk_hash"))
    return normalize_types(h.withColumn("point_id", point_id("chunk_hash")))


# ---------------------------------------------------------------- flagship: new chunks per source
FLAGSHIP_SQL = f"""
WITH d AS (SELECT doc_id, source AS tenant_id, printf('%s/%08d.txt', source, doc_id) AS source_path,
                  {S.clean('text')} AS content FROM documents),
kept AS (SELECT * FROM d WHERE length(content) >= 100),
t AS (SELECT doc_id, tenant_id, source_path, {S.tokens('content')} AS toks FROM kept),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, tenant_id, source_path, toks, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
w AS (SELECT tenant_id, source_path, chunk_index,
             sha256(array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '')) AS chunk_hash FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY nullif(tenant_id, ''), chunk_hash ORDER BY source_path, chunk_index) AS rn FROM w)
SELECT tenant_id, CAST(count(*) AS BIGINT) AS total_chunk_count,
       CAST(count(*) FILTER (WHERE rn = 1) AS BIGINT) AS new_chunk_count,
       CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS skipped_count
FROM r GROUP BY tenant_id
"""


@register("new_chunks_per_source", FLAGSHIP_SQL)
def q_new_chunks_per_source(spark, sf):
    """documents -> clean -> min length -> fixed chunks -> hash -> in-batch dedup -> counts."""
    d = corpus_documents(spark, sf)
    cleaned = T.with_column_where(d, "content", T.apply_steps(F.col("content"), T.default_cleaning_steps()),
                                  lambda c: F.length(c) >= 100)
    chunks = D.with_identity(K.chunk_fixed(cleaned, SIZE, OVERLAP_PCT, offsets=False)).select("tenant_id", "chunk_hash")
    counts = D.in_batch_counts(chunks, "tenant_id")
    return normalize_types(counts.select("tenant_id", "total_chunk_count", "new_chunk_count", "skipped_count"))


# ---------------------------------------------------------------- sentences and sentence packing
def sentences_sql(src: str = "SELECT doc_id, text AS content FROM documents") -> str:
    """CTEs ending in ``s2(doc_id, idx, text, start_char, end_char, n_tokens, pa, pb, n)``."""
    return f"""
p AS (SELECT doc_id, content, {S.sentence_pieces('content')} AS pieces FROM ({src})),
e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pi FROM p),
o AS (SELECT doc_id, pi, piece,
             coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pi
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM e),
s0 AS (SELECT doc_id, pi, {S.strip('piece')} AS text,
              off + length(piece) - length({S.lstrip('piece')}) AS start_char,
              off + length({S.rstrip('piece')}) AS end_char FROM o),
s1 AS (SELECT doc_id, text, start_char, end_char, len({S.tokens('text')}) AS n_tokens,
              row_number() OVER (PARTITION BY doc_id ORDER BY pi) - 1 AS idx FROM s0 WHERE text <> ''),
s2 AS (SELECT *, sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
              sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS pb,
              count(*) OVER (PARTITION BY doc_id) AS n FROM s1)"""


def packing_sql(size: int, overlap: int, src: str = "SELECT doc_id, text AS content FROM documents") -> str:
    """Recursive-CTE statement of sentence packing; ends in ``sem(doc_id, chunk_index, start_char, end_char, n_tokens)``."""
    return f"""WITH RECURSIVE {sentences_sql(src)},
en AS (SELECT a.doc_id, a.idx AS i, a.n,
              greatest(a.idx + 1, coalesce(max(b.idx) + 1, a.idx + 1)) AS e
       FROM s2 a LEFT JOIN s2 b ON b.doc_id = a.doc_id AND b.idx >= a.idx AND b.pa <= a.pb + {size}
       GROUP BY a.doc_id, a.idx, a.n),
ov AS (SELECT en.doc_id, en.i, en.n, en.e,
              coalesce(max(c.idx) FILTER (WHERE {overlap} > 0 AND last_s.pa - c.pb >= {overlap}), en.i) AS sx
       FROM en JOIN s2 last_s ON last_s.doc_id = en.doc_id AND last_s.idx = en.e - 1
               JOIN s2 c ON c.doc_id = en.doc_id AND c.idx >= en.i AND c.idx < en.e
       GROUP BY en.doc_id, en.i, en.n, en.e),
nx AS (SELECT doc_id, i, n, e, CASE WHEN sx <= i THEN e ELSE sx END AS nxt FROM ov),
rec(doc_id, i, chunk_index) AS (
    SELECT DISTINCT doc_id, 0, 0 FROM s2
    UNION ALL
    SELECT r.doc_id, x.nxt, r.chunk_index + 1 FROM rec r JOIN nx x ON x.doc_id = r.doc_id AND x.i = r.i
    WHERE x.e < x.n),
sem AS (SELECT r.doc_id, r.chunk_index, f.start_char, l.end_char, l.pa - f.pb AS n_tokens
        FROM rec r JOIN nx x ON x.doc_id = r.doc_id AND x.i = r.i
                   JOIN s2 f ON f.doc_id = r.doc_id AND f.idx = r.i
                   JOIN s2 l ON l.doc_id = r.doc_id AND l.idx = x.e - 1)"""


@register("sentences", f"""WITH {sentences_sql()}
SELECT doc_id, CAST(idx AS BIGINT) AS sentence_index, text, CAST(start_char AS BIGINT) AS start_char,
       CAST(end_char AS BIGINT) AS end_char, CAST(n_tokens AS BIGINT) AS n_tokens FROM s2
""")
def q_sentences(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return normalize_types(K.sentences(d))


@register("chunk_semantic", packing_sql(SIZE, int(SIZE * OVERLAP_PCT)) + """
SELECT s.doc_id, CAST(s.chunk_index AS BIGINT) AS chunk_index, CAST(s.start_char AS BIGINT) AS start_char,
       CAST(s.end_char AS BIGINT) AS end_char, CAST(s.n_tokens AS BIGINT) AS n_tokens,
       sha256(substr(d.text, CAST(s.start_char + 1 AS BIGINT), CAST(s.end_char - s.start_char AS BIGINT))) AS chunk_hash
FROM sem s JOIN documents d ON d.doc_id = s.doc_id
""")
def q_chunk_semantic(spark, sf):
    d = corpus_documents(spark, sf)
    c = K.chunk_semantic(d, SIZE, OVERLAP_PCT)
    return normalize_types(c.select("doc_id", "chunk_index", "start_char", "end_char", "n_tokens",
                                    chunk_hash("text").alias("chunk_hash")))


# The four chunking settings the chunking comparison lists.
REPORT_SETTINGS = (("fixed", 512, 0.10), ("fixed", 512, 0.20), ("fixed", 1024, 0.15), ("semantic", 512, 0.15))


def _fixed_rows_sql(size: int, pct: float) -> str:
    step = size - int(size * pct)
    return f"""(WITH t AS (SELECT doc_id, {S.tokens('text')} AS toks FROM documents),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, toks, unnest(range(0, {S.chunk_count('n', size, step)})) AS chunk_index FROM c)
SELECT doc_id, len(toks[chunk_index*{step}+1:chunk_index*{step}+{size}]) AS n_tokens FROM k)"""


def _report_sql() -> str:
    parts = []
    for strategy, size, pct in REPORT_SETTINGS:
        ov = int(size * pct)
        if strategy == "fixed":
            body = _fixed_rows_sql(size, pct)
        else:
            body = f"({packing_sql(size, ov)} SELECT doc_id, n_tokens FROM sem)"
        parts.append(f"SELECT '{strategy}' AS chunk_strategy, CAST({size} AS BIGINT) AS chunk_size, "
                     f"CAST({ov} AS BIGINT) AS overlap_tokens, CAST(count(*) AS BIGINT) AS n_chunks, "
                     f"CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents, "
                     f"round(avg(n_tokens), 4) AS avg_chunk_tokens FROM {body}")
    return "\nUNION ALL\n".join(parts)


@register("chunk_report", _report_sql())
def q_chunk_report(spark, sf):
    """Chunk count and average tokens for each listed chunking setting, over all documents.

    Fixed windows are counted from one token count per document (no windows
    are cut); sentence packing is run for the sentence setting.
    """
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    fixed = [(size, pct) for strategy, size, pct in REPORT_SETTINGS if strategy == "fixed"]
    counted = d.select("doc_id", regex_token_count("content").alias("n"))
    per_setting = counted.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit("fixed").alias("chunk_strategy"), F.lit(size).alias("chunk_size"),
                 F.lit(int(size * pct)).alias("overlap_tokens"),
                 K.fixed_window_counts("n", size, pct).alias("w"))
        for size, pct in fixed])))
    fixed_stats = per_setting.groupBy("chunk_strategy", "chunk_size", "overlap_tokens").agg(
        F.sum("w.chunks").alias("n_chunks"), F.count_if(F.col("w.chunks") > 0).alias("n_documents"),
        F.round(F.sum("w.tokens") / F.sum("w.chunks"), 4).alias("avg_chunk_tokens"))
    runs = [fixed_stats]
    for strategy, size, pct in REPORT_SETTINGS:
        if strategy == "fixed":
            continue
        c = K.chunk(d, strategy, size, pct)
        runs.append(c.groupBy(F.lit(strategy).alias("chunk_strategy"), F.lit(size).alias("chunk_size"),
                              F.lit(int(size * pct)).alias("overlap_tokens")).agg(
            F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"),
            F.round(F.avg("n_tokens"), 4).alias("avg_chunk_tokens")))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return normalize_types(out)


# ---------------------------------------------------------------- dedup against an index
# The index is what an earlier run stored: the chunks of the documents that
# already carry labels (a reviewed batch), keyed by (tenant, hash).
DEDUP_SQL = f"""
WITH t AS (SELECT doc_id, source AS tenant_id, printf('%s/%08d.txt', source, doc_id) AS source_path,
                  {S.tokens('text')} AS toks FROM documents),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, tenant_id, source_path, toks, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
h AS (SELECT doc_id, tenant_id, source_path, chunk_index,
             sha256(array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '')) AS chunk_hash FROM k),
idx AS (SELECT DISTINCT tenant_id, chunk_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
r AS (SELECT *, row_number() OVER (PARTITION BY nullif(tenant_id, ''), chunk_hash
                                   ORDER BY source_path, chunk_index) AS rn FROM h),
new AS (SELECT * FROM r WHERE rn = 1 AND NOT EXISTS (
          SELECT 1 FROM idx WHERE idx.chunk_hash = r.chunk_hash
                              AND (nullif(r.tenant_id, '') IS NULL OR idx.tenant_id = r.tenant_id)))
"""


def _chunk_keys(spark, sf) -> DataFrame:
    """Chunk keys of every document: lazy and narrow, no text is kept behind the hash."""
    chunks = K.chunk_fixed(corpus_documents(spark, sf), SIZE, OVERLAP_PCT, offsets=False)
    return chunks.select("doc_id", "tenant_id", "source_path", "chunk_index", chunk_hash("text").alias("chunk_hash"))


def _indexed_keys(spark, sf) -> DataFrame:
    """The chunk keys, marked where an earlier run has indexed them (the labelled documents): one chunking, narrow rows joined."""
    labelled = read_table(spark, sf, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return _chunk_keys(spark, sf).join(labelled, "doc_id", "left")


def _first_chunks(keys: DataFrame) -> DataFrame:
    return normalize_types(keys.select("_o.doc_id", "_o.chunk_index", F.col("_h").alias("chunk_hash")))


@register("dedup_in_batch", DEDUP_SQL + """
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash FROM r WHERE rn = 1
""")
def q_dedup_in_batch(spark, sf):
    return _first_chunks(D.first_keys(_chunk_keys(spark, sf), carry=("doc_id",)))


@register("dedup_against_index", DEDUP_SQL + """
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash FROM new
""")
def q_dedup_against_index(spark, sf):
    return _first_chunks(D.marked_keys(_indexed_keys(spark, sf), "indexed", carry=("doc_id",)).filter("not _held"))


@register("dedup_bucketed_index", DEDUP_SQL + """
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash FROM new
""")
def q_dedup_bucketed_index(spark, sf):
    """The same check against an index kept as a table bucketed by hash, as a large one would be."""
    from docyard.session import cut_lineage, drop_path, scratch_path
    from docyard.sinks.hash_index import append_index, drop_index, read_index
    keys = cut_lineage(_indexed_keys(spark, sf))
    folder = scratch_path(spark, "hash-index")
    name = "index_" + folder[-12:]
    append_index(keys.filter("indexed"), name, 8, folder)
    try:
        firsts = D.first_keys(keys, carry=("doc_id",))
        return _first_chunks(cut_lineage(D.new_keys(firsts, read_index(spark, name))))
    finally:
        drop_index(spark, name)
        drop_path(spark, folder)


@register("dedup_counts", DEDUP_SQL + """
SELECT h.tenant_id, CAST(count(*) AS BIGINT) AS total_chunk_count,
       CAST(count(new.chunk_hash) AS BIGINT) AS new_chunk_count,
       CAST(count(*) - count(new.chunk_hash) AS BIGINT) AS skipped_count
FROM h LEFT JOIN new ON new.doc_id = h.doc_id AND new.chunk_index = h.chunk_index
GROUP BY h.tenant_id
""")
def q_dedup_counts(spark, sf):
    return normalize_types(D.tenant_counts(D.marked_keys(_indexed_keys(spark, sf), "indexed")))


@register("existing_hashes", DEDUP_SQL + """
SELECT h.doc_id, CAST(h.chunk_index AS BIGINT) AS chunk_index, h.chunk_hash FROM h
WHERE EXISTS (SELECT 1 FROM idx WHERE idx.chunk_hash = h.chunk_hash
                               AND (nullif(h.tenant_id, '') IS NULL OR idx.tenant_id = h.tenant_id))
""")
def q_existing_hashes(spark, sf):
    from docyard.session import cut_lineage
    keys = cut_lineage(_indexed_keys(spark, sf))  # read twice: as the index, and against it
    return normalize_types(D.existing_in_index(keys, keys.filter("indexed").select("tenant_id", "chunk_hash").distinct())
                           .select("doc_id", "chunk_index", "chunk_hash"))


@register("hashes_by_tenant", DEDUP_SQL + """
SELECT nullif(tenant_id, '') AS tenant_id, CAST(count(DISTINCT chunk_hash) AS BIGINT) AS distinct_hashes,
       CAST(count(*) AS BIGINT) AS chunks FROM h GROUP BY 1
""")
def q_hashes_by_tenant(spark, sf):
    return normalize_types(D.hashes_by_tenant(_chunk_keys(spark, sf)))


# ---------------------------------------------------------------- language id and full cleaning
def lang_sql(sample_expr_src: str) -> str:
    """CTEs: a trigram profile trained on the labelled documents with even ids, then scores
    for ``sample_expr_src`` = SELECT doc_id, sample; ends in ``lid(doc_id, language, confidence)``."""
    norm = lambda e: f"' ' || trim(regexp_replace(lower({e}), '[^\\pL]+', ' ', 'g')) || ' '"
    return f"""
tr AS (SELECT lang, {norm('text')} AS s FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 0),
tg AS (SELECT lang, substr(s, i, 3) AS gram FROM (SELECT lang, s, unnest(range(1, length(s) - 1)) AS i FROM tr)),
prof AS (SELECT lang, gram, count(*) AS n FROM tg GROUP BY lang, gram),
den AS (SELECT lang, ln(t + v) AS z FROM (SELECT lang, sum(n) AS t FROM prof GROUP BY lang),
                                          (SELECT count(DISTINCT gram) AS v FROM prof)),
smp AS (SELECT doc_id, {S.strip('substr(sample, 1, 2000)')} AS sample FROM ({sample_expr_src})),
sn AS (SELECT doc_id, {norm('sample')} AS s FROM smp WHERE sample <> ''),
sg AS (SELECT doc_id, substr(s, i, 3) AS gram FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM sn)),
ng AS (SELECT doc_id, count(*) AS n FROM sg GROUP BY doc_id),
mw AS (SELECT sg.doc_id, p.lang, sum(ln(p.n + 1)) AS w FROM sg JOIN prof p ON p.gram = sg.gram GROUP BY sg.doc_id, p.lang),
sc AS (SELECT ng.doc_id, den.lang, coalesce(mw.w, 0) - ng.n * den.z AS score
       FROM ng CROSS JOIN den LEFT JOIN mw ON mw.doc_id = ng.doc_id AND mw.lang = den.lang),
best AS (SELECT doc_id, arg_max(lang, score) AS lang, max(score) AS top FROM sc GROUP BY doc_id),
lid AS (SELECT b.doc_id, CASE WHEN 1.0 / sum(exp(sc.score - b.top)) >= 0.9 THEN b.lang END AS language,
               1.0 / sum(exp(sc.score - b.top)) AS confidence
        FROM sc JOIN best b ON b.doc_id = sc.doc_id GROUP BY b.doc_id, b.lang)"""


def _language_model(spark, sf):
    """The language model trained on the labelled documents with even ids; the others test it."""
    from docyard.operators.language import fit_language_model
    return fit_language_model(read_table(spark, sf, "documents").filter("doc_id % 2 = 0"), "text", "lang")


@register("language_id", f"""WITH {lang_sql('SELECT doc_id, text AS sample FROM documents')}
SELECT d.doc_id, lid.language, round(lid.confidence, 4) AS confidence
FROM documents d LEFT JOIN lid ON lid.doc_id = d.doc_id
""")
def q_language_id(spark, sf):
    from docyard.operators.language import detect_language
    model = _language_model(spark, sf)
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    out = detect_language(d, model, "text", 0.9, confidence_col="confidence")
    return out.select("doc_id", "language", F.round("confidence", 4).alias("confidence"))


@register("clean_documents", f"""WITH cl AS (SELECT doc_id, {S.clean('text')} AS content FROM documents),
kept AS (SELECT * FROM cl WHERE length(content) >= 100),
{lang_sql('SELECT doc_id, content AS sample FROM kept')}
SELECT kept.doc_id, kept.content, lid.language FROM kept JOIN lid ON lid.doc_id = kept.doc_id
WHERE lid.language = 'en'
""")
def q_clean_documents(spark, sf):
    from docyard.config import IngestConfig
    from docyard.operators.clean import clean_documents
    model = _language_model(spark, sf)
    d = corpus_documents(spark, sf)
    out = clean_documents(d, IngestConfig(), model)
    return out.select("doc_id", "content", "language")


# ---------------------------------------------------------------- loaders
@register("html_extract", f"""WITH {S.html_extract_sql()}
SELECT page_id, content, title, url FROM hx WHERE content <> ''
""")
def q_html_extract(spark, sf):
    from docyard.sources.html import html_documents
    p = read_table(spark, sf, "pages")
    return html_documents(p).select("page_id", "content", "title", "url")


def _markdown_source_sql() -> str:
    nl = "chr(10)"
    return (f"'---' || {nl} || 'source: ' || source || {nl} || 'lang: ' || coalesce(lang, '') || {nl} || '---' "
            f"|| {nl} || '# ' || replace(text, {nl}, {nl} || {nl} || '## ')")


def _markdown_source(d: DataFrame) -> DataFrame:
    """Markdown derived from each document: front matter, a title line, every later line a heading."""
    raw = F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\nlang: "), F.coalesce("lang", F.lit("")),
                   F.lit("\n---\n# "), F.regexp_replace("text", "\n", "\n\n## "))
    return d.select("doc_id", raw.alias("raw"))


_MD_CONTENT, _MD_TITLE = S.markdown_sql("raw")


@register("markdown_extract", f"""
WITH m AS (SELECT doc_id, {_markdown_source_sql()} AS raw FROM documents),
x AS (SELECT doc_id, {_MD_CONTENT} AS content, {_MD_TITLE} AS h1_title FROM m)
SELECT doc_id, content, h1_title FROM x WHERE content <> ''
""")
def q_markdown_extract(spark, sf):
    from docyard.sources.loaders import markdown_documents
    md = _markdown_source(read_table(spark, sf, "documents"))
    return markdown_documents(md, "raw").select("doc_id", "content", "h1_title")


@register("explode_pages", f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents),
e AS (SELECT doc_id, pages, generate_subscripts(pages, 1) AS i FROM p)
SELECT doc_id, CAST(i AS BIGINT) AS page_number, CAST(len(pages) AS BIGINT) AS page_count,
       {S.strip('pages[i]')} AS content
FROM e WHERE {S.strip('pages[i]')} <> ''
""")
def q_explode_pages(spark, sf):
    """Each document's lines stand for the pages of a PDF."""
    from docyard.sources.loaders import explode_pages
    d = read_table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return normalize_types(explode_pages(d).select("doc_id", "page_number", "page_count", "content"))


@register("flatten_blocks", f"""
WITH b AS (SELECT conv_id AS doc_id, CASE role WHEN 'system' THEN 'table' ELSE 'paragraph' END AS kind,
                  turn AS ordinal, CASE role WHEN 'user' THEN 'Heading 2' ELSE 'Normal' END AS style,
                  {S.strip('text')} AS t FROM conversations),
g AS (SELECT doc_id,
             {S.strip("coalesce(string_agg(t, chr(10) || chr(10) ORDER BY (kind = 'table'), ordinal, t) FILTER (WHERE t <> ''), '')")} AS content,
             CAST(count(*) FILTER (WHERE kind <> 'table' AND t <> '' AND starts_with(coalesce(style, ''), 'Heading')) AS BIGINT) AS heading_count,
             CAST(count(*) FILTER (WHERE kind = 'table') AS BIGINT) AS table_count
      FROM b GROUP BY doc_id)
SELECT * FROM g WHERE content <> ''
""")
def q_flatten_blocks(spark, sf):
    """Conversation turns as Word blocks: system turns are tables, user turns are headings."""
    from docyard.sources.loaders import flatten_blocks
    c = read_table(spark, sf, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"),
                      F.when(F.col("role") == "system", "table").otherwise("paragraph").alias("kind"),
                      F.col("turn").alias("ordinal"),
                      F.when(F.col("role") == "user", "Heading 2").otherwise("Normal").alias("style"),
                      "text")
    return normalize_types(flatten_blocks(blocks).select("doc_id", "content", "heading_count", "table_count"))


@register("format_dispatch", """
WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name FROM pages),
s AS (SELECT page_id, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) AS suffix FROM n),
f AS (SELECT page_id, suffix,
             CASE WHEN lower(suffix) IN ('.pdf') THEN 'pdf'
                  WHEN lower(suffix) IN ('.html', '.htm') THEN 'html'
                  WHEN lower(suffix) IN ('.md', '.markdown') THEN 'markdown'
                  WHEN lower(suffix) IN ('.docx') THEN 'docx' END AS format FROM s)
SELECT page_id, suffix, format, CASE WHEN format IS NULL THEN 'No loader found for ' || suffix END AS error_message FROM f
""")
def q_format_dispatch(spark, sf):
    from docyard.sources.loaders import dispatch
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return dispatch(p, "url").select("page_id", "suffix", "format", "error_message")


FILE_SUFFIXES = (".html", ".htm", ".md", ".pdf", ".txt")


@register("load_outcomes", f"""
WITH f AS (SELECT page_id, 'pages/' || page_id || list_extract({list(FILE_SUFFIXES)}, CAST(page_id % 5 + 1 AS BIGINT)) AS source_path,
                  page_id % 5 AS kind, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS body FROM pages)
SELECT source_path, CASE kind WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'markdown' WHEN 3 THEN 'pdf' END AS format,
       CASE WHEN kind = 4 THEN 'No loader found for .txt'
            WHEN kind = 3 THEN 'No decoder for pdf files: give their pages or blocks as a table'
            WHEN body = '' THEN 'File holds no text' END AS error_message,
       kind < 3 AND body <> '' AS is_document
FROM f
""")
def q_load_outcomes(spark, sf):
    """Every page as a file of some kind (some of them empty): documents and rejects together are all files."""
    from docyard.sources.loaders import load_outcomes
    p = read_table(spark, sf, "pages")
    suffix = F.get(F.array(*map(F.lit, FILE_SUFFIXES)), (F.col("page_id") % 5).cast("int"))
    body = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("html"))
    files = p.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), suffix).alias("source_path"),
                     body.cast("binary").alias("content"))
    return load_outcomes(files).select("source_path", "format", "error_message",
                                       F.col("content").isNotNull().alias("is_document"))


@register("html_nested", f"""
WITH d AS (SELECT doc_id, {S.strip("replace(replace(replace(text, '&', ' '), '<', ' '), '>', ' ')")} AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, {S.lit(S.LINE_SEP)}), lambda x: x), lambda x: x <> '') AS lines FROM d)
SELECT doc_id, {S.strip("array_to_string(lines, chr(10))")} AS content, 'page ' || doc_id AS title, 'doc/' || doc_id AS url
FROM l WHERE {S.strip("array_to_string(lines, chr(10))")} <> ''
""")
def q_html_nested(spark, sf):
    """Documents as pages with a teaser article inside the header, an empty canonical link and a nav in the article."""
    from docyard.sources.html import html_documents
    d = read_table(spark, sf, "documents")
    body = F.regexp_replace("text", "[&<>]", " ")
    key = F.col("doc_id").cast("string")
    page = F.concat(F.lit("<html><head><title>page "), key, F.lit("</title><link rel='canonical' href=''>"
                    "<link rel='canonical' href='late'></head><body><header><article>teaser</article><main>x</main></header>"
                    "<nav><p>menu</nav><article><nav>inner</nav>"), body, F.lit("</article><article>second</article><footer>end</footer>"))
    pages = d.select("doc_id", page.alias("html"), F.concat(F.lit("doc/"), key).alias("url"))
    return html_documents(pages).select("doc_id", "content", "title", "url")


# ---------------------------------------------------------------- upsert view and job audit trail
@register("upsert_latest", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def q_upsert_latest(spark, sf):
    """Events as an upsert log keyed by (user, event type): the latest row per key wins."""
    from docyard.sinks.points import latest_by_key
    e = read_table(spark, sf, "events").withColumn("_seq", F.struct("ts", "event_id"))
    return latest_by_key(e, ("user_id", "event_type"), "_seq").select("user_id", "event_type", "event_id", "value")


JOB_EVENTS_SQL = """
WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, 'events/user-' || user_id AS source_path,
         'tenant-' || CAST(floor(CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) / 20) AS INTEGER) AS tenant_id,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
                         WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status,
         ts AS event_at, event_id AS seq, value,
         CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) AS k
  FROM events),
je AS (
  SELECT job_id, source_path, tenant_id, status, event_at, seq,
         CASE WHEN status = 'failed' THEN 'error event ' || seq END AS error_message,
         CASE WHEN status = 'done' THEN CAST(floor(value) AS INTEGER) END AS chunk_count,
         CASE WHEN status = 'done' THEN k END AS skipped_count,
         CASE WHEN status IN ('done', 'failed') THEN value END AS duration_seconds
  FROM ev WHERE status IS NOT NULL),
a AS (SELECT *, sum(CAST(status = 'queued' AS INTEGER)) OVER w AS nq FROM je
      WINDOW w AS (PARTITION BY job_id ORDER BY event_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CAST(status = 'running' AND nq >= 1 AS INTEGER) AS relig FROM a),
c AS (SELECT *, sum(relig) OVER w AS rc FROM b
      WINDOW w AS (PARTITION BY job_id ORDER BY event_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CAST(status IN ('done', 'failed') AND rc >= 1 AS INTEGER) AS telig FROM c),
f AS (SELECT *, sum(telig) OVER w AS tc FROM d
      WINDOW w AS (PARTITION BY job_id ORDER BY event_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, (status = 'queued' AND nq = 1) AS is_create, (relig = 1 AND rc = 1) AS is_run,
             (telig = 1 AND tc = 1) AS is_end FROM f),
h AS (SELECT *, is_create OR is_run OR is_end AS valid,
             max(CASE WHEN is_end THEN status END) OVER w AS terminal,
             max(CASE WHEN is_create THEN event_at END) OVER w AS created_at,
             max(CASE WHEN is_end AND status = 'done' THEN event_at END) OVER w AS indexed_at
      FROM g
      WINDOW w AS (PARTITION BY job_id ORDER BY event_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN valid THEN NULL
                     WHEN nq - CAST(status = 'queued' AS INTEGER) < 1 THEN 'ingestion job not found: ' || job_id
                     ELSE 'invalid job status transition: ' ||
                          CASE WHEN tc - telig >= 1 THEN terminal WHEN rc - relig >= 1 THEN 'running' ELSE 'queued' END
                          || ' -> ' || status END AS rejection FROM h),
cur AS (SELECT job_id, source_path, tenant_id, status, error_message, chunk_count, skipped_count,
               duration_seconds, created_at, indexed_at FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_at DESC, seq DESC) AS rn
          FROM v WHERE valid) WHERE rn = 1),
cur0 AS (SELECT v.job_id, first(v.source_path ORDER BY v.event_at, v.seq) AS source_path0,
                first(v.tenant_id ORDER BY v.event_at, v.seq) AS tenant_id0 FROM v WHERE valid GROUP BY v.job_id),
jobs AS (SELECT cur.job_id, cur0.source_path0 AS source_path, cur0.tenant_id0 AS tenant_id, status, error_message,
                chunk_count, skipped_count, duration_seconds, created_at, indexed_at
         FROM cur JOIN cur0 ON cur0.job_id = cur.job_id)
"""


def _job_events(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """The events table (or a stream of it) read as job status requests (click events carry none)."""
    e = read_table(spark, sf, "events") if events is None else events
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running")
               .when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed"))
    ev = e.select(F.col("user_id").cast("string").alias("job_id"),
                  F.concat(F.lit("events/user-"), F.col("user_id").cast("string")).alias("source_path"),
                  F.concat(F.lit("tenant-"), F.floor(k / 20).cast("int").cast("string")).alias("tenant_id"),
                  status.alias("status"), F.col("ts").alias("event_at"), F.col("event_id").alias("seq"),
                  "value", k.alias("k")).filter(F.col("status").isNotNull())
    st = F.col("status")
    return ev.select("job_id", "source_path", "tenant_id", "status", "event_at", "seq",
                     F.when(st == "failed", F.concat(F.lit("error event "), F.col("seq").cast("string")))
                      .alias("error_message"),
                     F.when(st == "done", F.floor("value").cast("int")).alias("chunk_count"),
                     F.when(st == "done", F.col("k")).alias("skipped_count"),
                     F.when(st.isin("done", "failed"), F.col("value")).alias("duration_seconds"))


def _current_jobs(spark, sf) -> DataFrame:
    from docyard.sinks.jobs import current_jobs, validate_transitions
    return current_jobs(validate_transitions(_job_events(spark, sf)))


def _micros(c: str):
    """Epoch microseconds of a wall-clock (NTZ) timestamp, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


@register("job_transitions", JOB_EVENTS_SQL + """
SELECT job_id, seq, status, valid, rejection FROM v
""")
def q_job_transitions(spark, sf):
    from docyard.sinks.jobs import validate_transitions
    v = validate_transitions(_job_events(spark, sf))
    return v.select("job_id", "seq", "status", "valid", "rejection")


@register("job_transitions_stream", JOB_EVENTS_SQL + """
SELECT job_id, seq, status, valid, rejection FROM v
""")
def q_job_transitions_stream(spark, sf):
    """The same log as a stream, checked against per-job state."""
    from docyard.streaming.job_state import validated_log
    v = validated_log(_job_events(spark, sf, stream_table(spark, sf, "events")))
    return v.select("job_id", "seq", "status", "valid", "rejection")


@register("job_current", JOB_EVENTS_SQL + """
SELECT job_id, source_path, tenant_id, status, error_message, CAST(chunk_count AS BIGINT) AS chunk_count,
       CAST(skipped_count AS BIGINT) AS skipped_count, round(duration_seconds, 6) AS duration_seconds,
       epoch_us(created_at) AS created_at_us, epoch_us(indexed_at) AS indexed_at_us FROM jobs
""")
def q_job_current(spark, sf):
    j = _current_jobs(spark, sf)
    return normalize_types(j.select("job_id", "source_path", "tenant_id", "status", "error_message", "chunk_count",
                                    "skipped_count", F.round("duration_seconds", 6).alias("duration_seconds"),
                                    _micros("created_at").alias("created_at_us"),
                                    _micros("indexed_at").alias("indexed_at_us")))


@register("job_lookup", JOB_EVENTS_SQL + """
SELECT job_id, status FROM jobs WHERE job_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
""")
def q_job_lookup(spark, sf):
    """Point lookups of a set of job ids (the labelled ids); unknown ids give no row."""
    from docyard.sinks.jobs import get_job
    ids = read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("job_id"))
    return get_job(_job_events(spark, sf), ids).select("job_id", "status")


@register("recent_jobs", JOB_EVENTS_SQL + """
SELECT tenant_id, job_id, CAST(rn AS BIGINT) AS rank, epoch_us(created_at) AS created_at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, job_id) AS rn FROM jobs)
WHERE rn <= 50
""")
def q_recent_jobs(spark, sf):
    from docyard.sinks.jobs import recent_jobs
    r = recent_jobs(_current_jobs(spark, sf), None, 50)
    return normalize_types(r.select("tenant_id", "job_id", "rank", _micros("created_at").alias("created_at_us")))


@register("audit_report", JOB_EVENTS_SQL + """
SELECT source_path, status, CAST(chunk_count AS BIGINT) AS chunk_count, CAST(skipped_count AS BIGINT) AS skipped_count
FROM jobs ORDER BY created_at DESC, job_id LIMIT 10
""")
def q_audit_report(spark, sf):
    from docyard.sinks.jobs import audit_report
    return normalize_types(audit_report(_current_jobs(spark, sf), 10))


# ---------------------------------------------------------------- vectors, search, recall
@register("l2_normalize", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS nrm FROM v),
u AS (SELECT vec_id, nrm, CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS w FROM n)
SELECT vec_id, CAST(len(w) AS BIGINT) AS dim, round(nrm, 6) AS norm_in,
       round(sqrt(list_reduce(list_transform(w, lambda x: x * x), lambda a, b: a + b)), 6) AS norm_out,
       round(w[1], 6) AS x0 FROM u
""")
def q_l2_normalize(spark, sf):
    from docyard.operators.embed import l2_normalize, vector_norm
    e = read_table(spark, sf, "embeddings")
    u = e.select("vec_id", vector_norm("embedding").alias("nrm"), l2_normalize("embedding").alias("w"))
    return normalize_types(u.select("vec_id", F.size("w").alias("dim"), F.round("nrm", 6).alias("norm_in"),
                                    F.round(vector_norm("w"), 6).alias("norm_out"),
                                    F.round(F.element_at("w", 1), 6).alias("x0")))


TOPK = 5
COSINE_SQL = f"""
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
q AS (SELECT label AS query_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, pos),
qn AS (SELECT query_id, sqrt(sum(m * m)) AS nq FROM q GROUP BY query_id),
vx AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM vx GROUP BY vec_id),
dt AS (SELECT q.query_id, vx.vec_id, sum(q.m * vx.x) AS d FROM q JOIN vx ON vx.pos = q.pos GROUP BY q.query_id, vx.vec_id),
sc AS (SELECT dt.query_id, dt.vec_id, dt.d / (qn.nq * vn.nv) AS score
       FROM dt JOIN qn ON qn.query_id = dt.query_id JOIN vn ON vn.vec_id = dt.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc),
top AS (SELECT * FROM rk WHERE rank <= {TOPK})
"""


def _ranked(spark, sf):
    from docyard.operators.search import centroid_queries, cosine_topk
    e = read_table(spark, sf, "embeddings")
    return cosine_topk(e, centroid_queries(e, "label"), TOPK)


@register("cosine_topk", COSINE_SQL + """
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM top
""")
def q_cosine_topk(spark, sf):
    """Top-5 vectors by cosine for each label's centroid."""
    r = _ranked(spark, sf)
    return normalize_types(r.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score")))


@register("context_assembly", COSINE_SQL + """
, ctx AS (SELECT top.query_id, count(*) AS n_chunks,
                 string_agg(d.text, chr(10) || chr(10) ORDER BY top.rank) AS context
          FROM top JOIN documents d ON d.doc_id = top.vec_id GROUP BY top.query_id)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(n_chunks AS BIGINT) AS n_chunks, sha256(context) AS context_sha256,
       CAST(length(context) AS BIGINT) AS context_chars FROM ctx
""")
def q_context_assembly(spark, sf):
    """Ranked hit texts joined per query (documents paired with vectors by id)."""
    from docyard.operators.search import assemble_context
    texts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    c = assemble_context(_ranked(spark, sf), texts)
    return normalize_types(c.select("query_id", "n_chunks", F.sha2("context", 256).alias("context_sha256"),
                                    F.length("context").alias("context_chars")))


@register("recall_at_k", COSINE_SQL + f"""
, gold AS (SELECT label AS query_id, vec_id FROM embeddings),
g AS (SELECT query_id, count(*) AS gold_count FROM gold GROUP BY query_id),
h AS (SELECT top.query_id, count(*) FILTER (WHERE gold.vec_id IS NOT NULL) AS hits
      FROM top LEFT JOIN gold ON gold.query_id = top.query_id AND gold.vec_id = top.vec_id GROUP BY top.query_id)
SELECT CAST(h.query_id AS BIGINT) AS query_id, CAST(h.hits AS BIGINT) AS hits, CAST(g.gold_count AS BIGINT) AS gold_count,
       round(h.hits / g.gold_count, 6) AS recall, round(h.hits / {float(TOPK)}, 6) AS precision
FROM h JOIN g ON g.query_id = h.query_id
""")
def q_recall_at_k(spark, sf):
    """recall@5 of centroid queries, gold = every vector with the query's label."""
    from docyard.operators.search import recall_at_k
    e = read_table(spark, sf, "embeddings")
    gold = e.select(F.col("label").alias("query_id"), "vec_id")
    r = recall_at_k(_ranked(spark, sf), gold, TOPK)
    return normalize_types(r.select("query_id", "hits", "gold_count", F.round("recall", 6).alias("recall"),
                                    F.round("precision", 6).alias("precision")))


EMBED_SIZE = 64


@register("embed_hashed", FIXED_SQL + f"""
, words AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), {S.lit(S.WORD)})) AS word FROM w),
hashed AS (SELECT doc_id, chunk_index, md5(word) AS h FROM words),
signed AS (SELECT doc_id, chunk_index, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {EMBED_SIZE} AS pos,
                  CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM hashed),
sums AS (SELECT doc_id, chunk_index, pos, sum(s) AS n FROM signed GROUP BY ALL),
grid AS (SELECT doc_id, chunk_index, pos FROM w, (SELECT unnest(range(0, {EMBED_SIZE})) AS pos)),
full_grid AS (SELECT g.doc_id, g.chunk_index, g.pos, coalesce(sums.n, 0) AS n
              FROM grid g LEFT JOIN sums USING (doc_id, chunk_index, pos)),
vec AS (SELECT doc_id, chunk_index, sum(n * n) AS sq, string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS counts
        FROM full_grid GROUP BY ALL)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST({EMBED_SIZE} AS BIGINT) AS dim,
       CASE WHEN sq > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, counts FROM vec
""")
def q_embed_hashed(spark, sf):
    """Fixed chunks of every document under the default model: width, norm, and the counts behind the vector."""
    from docyard.operators.embed import hashed_embedding, vector_norm
    d = corpus_documents(spark, sf)
    c = K.chunk_fixed(d, SIZE, OVERLAP_PCT, offsets=False).select("doc_id", "chunk_index", "text")
    v = hashed_embedding(c, "text", "embedding", EMBED_SIZE, counts_col="counts")
    return normalize_types(v.select("doc_id", "chunk_index", F.size("embedding").alias("dim"),
                                    F.round(vector_norm("embedding"), 4).alias("norm"),
                                    F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts")))


# ---------------------------------------------------------------- the stored points
@register("points_current", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def q_points_current(spark, sf):
    """A base and runs appended after it, one with smaller sequences than the base holds."""
    from docyard.sinks.points import current_view
    e = read_table(spark, sf, "events").withColumn("ingest_seq", F.struct("ts", "event_id"))
    key = ("user_id", "event_type")
    base = current_view([e.filter("event_id % 3 = 0")], key)
    late, early = e.filter("event_id % 3 = 1"), e.filter("event_id % 3 = 2")
    return current_view([base, late, early], key).select("user_id", "event_type", "event_id", "value")


@register("index_scan", DEDUP_SQL + """
SELECT tenant_id, chunk_hash FROM idx
""")
def q_index_scan(spark, sf):
    """The (tenant, hash) pairs an earlier run stored."""
    return _indexed_keys(spark, sf).filter("indexed").select("tenant_id", "chunk_hash").distinct()


@register("point_count", DEDUP_SQL + """
SELECT tenant_id, CAST(count(DISTINCT chunk_hash) AS BIGINT) AS points FROM h GROUP BY tenant_id
""")
def q_point_count(spark, sf):
    """Current points per tenant when every document's chunks are upserted."""
    from docyard.sinks.points import current_view, points_per_tenant
    rows = _chunk_keys(spark, sf).withColumn("point_id", point_id("chunk_hash")).withColumn("ingest_seq", F.struct("source_path", "chunk_index"))
    return normalize_types(points_per_tenant(current_view([rows], ("tenant_id", "point_id"))))


TENANT_TOPK_SQL = f"""
WITH v AS (SELECT {S.uuid5_from_sha1('h')} AS id, tenant_id, vec_id, embedding FROM (
             SELECT vec_id, embedding, 'group-' || (label % 3) AS tenant_id,
                    {S.sha1_name("CAST(vec_id AS VARCHAR)")} AS h FROM embeddings)),
vx AS (SELECT id, tenant_id, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM v),
vn AS (SELECT id, sqrt(sum(x * x)) AS n FROM vx GROUP BY id),
dt AS (SELECT a.id AS query_id, b.id, sum(a.x * b.x) AS d FROM vx a JOIN vx b
         ON a.vec_id % 20 = 0 AND a.tenant_id = b.tenant_id AND a.pos = b.pos GROUP BY a.id, b.id),
sc AS (SELECT dt.query_id, dt.id, d / (q.n * c.n) AS score FROM dt JOIN vn q ON q.id = dt.query_id JOIN vn c ON c.id = dt.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
SELECT query_id, id AS point_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 5
"""


@register("cosine_topk_by_tenant", TENANT_TOPK_SQL)
def q_cosine_topk_by_tenant(spark, sf):
    """Top-5 points (UUID ids) by cosine within the query's own tenant; every 20th vector asks."""
    from docyard.operators.search import cosine_topk
    e = read_table(spark, sf, "embeddings")
    p = e.select(point_id(F.col("vec_id").cast("string")).alias("point_id"), "embedding", "vec_id",
                 F.concat(F.lit("group-"), (F.col("label") % 3).cast("string")).alias("tenant_id"))
    q = p.filter("vec_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding", "tenant_id")
    r = cosine_topk(p, q, 5, id_col="point_id", tenant_col="tenant_id")
    return normalize_types(r.select("query_id", "point_id", "rank", F.round("score", 6).alias("score")))


# ---------------------------------------------------------------- the ingest flow's counters
INGEST_SQL = f"""WITH cl AS (SELECT doc_id, source AS tenant_id, printf('%s/%08d.txt', source, doc_id) AS source_path,
                   {S.clean('text')} AS content FROM documents),
kept AS (SELECT * FROM cl WHERE length(content) >= 100),
{lang_sql('SELECT doc_id, content AS sample FROM kept')},
en AS (SELECT kept.* FROM kept JOIN lid ON lid.doc_id = kept.doc_id WHERE lid.language = 'en'),
t AS (SELECT doc_id, tenant_id, source_path, {S.tokens('content')} AS toks FROM en),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, tenant_id, source_path, toks, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
h AS (SELECT doc_id, tenant_id, source_path, chunk_index,
             sha256(array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '')) AS chunk_hash FROM k),
idx AS (SELECT DISTINCT tenant_id, chunk_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels)),
r AS (SELECT *, row_number() OVER (PARTITION BY nullif(tenant_id, ''), chunk_hash ORDER BY source_path, chunk_index) AS rn FROM h),
new AS (SELECT * FROM r WHERE rn = 1 AND NOT EXISTS (
          SELECT 1 FROM idx WHERE idx.chunk_hash = r.chunk_hash
                              AND (nullif(r.tenant_id, '') IS NULL OR idx.tenant_id = r.tenant_id))),
dc AS (SELECT source AS tenant_id, count(*) AS document_count FROM documents GROUP BY 1),
ec AS (SELECT tenant_id, count(*) AS cleaned_document_count FROM en GROUP BY 1),
hc AS (SELECT tenant_id, count(*) AS total_chunk_count FROM h GROUP BY 1),
nc AS (SELECT tenant_id, count(*) AS chunk_count FROM new GROUP BY 1)
SELECT dc.tenant_id, CAST(document_count AS BIGINT) AS document_count,
       CAST(coalesce(cleaned_document_count, 0) AS BIGINT) AS cleaned_document_count,
       CAST(coalesce(total_chunk_count, 0) AS BIGINT) AS total_chunk_count,
       CAST(coalesce(chunk_count, 0) AS BIGINT) AS chunk_count,
       CAST(coalesce(total_chunk_count, 0) - coalesce(chunk_count, 0) AS BIGINT) AS skipped_count
FROM dc LEFT JOIN ec USING (tenant_id) LEFT JOIN hc USING (tenant_id) LEFT JOIN nc USING (tenant_id)
"""


@register("ingest_counters", INGEST_SQL)
def q_ingest_counters(spark, sf):
    """The full flow's counters per tenant: clean + language + fixed chunks + dedup against
    the index an earlier run left (the labelled documents' chunks)."""
    from docyard.config import IngestConfig
    from docyard.plans.ingest import IngestPlan, chunk_table, counters
    from docyard.session import cut_lineage
    model = _language_model(spark, sf)
    d = corpus_documents(spark, sf)
    # the earlier run indexed the labelled documents; the chunks' ids and hashes, which three
    # readers share behind the cleaning and language steps, are kept once (no text)
    chunks = cut_lineage(chunk_table(d, IngestConfig(), model, offsets=False)
                         .select("doc_id", "tenant_id", "source_path", "chunk_index", "chunk_hash"))
    labelled = read_table(spark, sf, "labels").select("doc_id")
    index = chunks.join(labelled, "doc_id", "left_semi").select("tenant_id", "chunk_hash")
    keys = D.new_keys(D.first_keys(chunks), index.distinct())
    return normalize_types(counters(IngestPlan(d, chunks, keys), by=("tenant_id",)))


@register("build_points", f"""
WITH t AS (SELECT doc_id, source AS tenant_id, printf('%s/%08d.txt', source, doc_id) AS source_path,
                  {S.tokens('text')} AS toks FROM documents),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT doc_id, tenant_id, source_path, toks, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
w AS (SELECT doc_id, tenant_id, source_path, chunk_index,
             length(array_to_string(toks[1:chunk_index*{STEP}], '')) AS start_char,
             array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '') AS text FROM k),
h AS (SELECT *, sha256(text) AS chunk_hash FROM w),
u AS (SELECT *, {S.sha1_name('chunk_hash')} AS s1 FROM h)
SELECT {S.uuid5_from_sha1('s1')} AS point_id, tenant_id,
       CAST(to_json({{'tenant_id': tenant_id, 'source_path': source_path, 'format': 'text', 'chunk_strategy': 'fixed',
                'doc_id': doc_id, 'chunk_index': CAST(chunk_index AS INTEGER), 'start_char': CAST(start_char AS INTEGER),
                'end_char': CAST(start_char + length(text) AS INTEGER), 'text': text, 'chunk_hash': chunk_hash}}) AS VARCHAR) AS payload
FROM u
""")
def q_build_points(spark, sf):
    """Point id and JSON payload (metadata, then the payload fields) of every fixed chunk."""
    from docyard.sinks.points import build_points, payload_json
    d = corpus_documents(spark, sf).drop("given_language")
    c = build_points(K.chunk_fixed(d, SIZE, OVERLAP_PCT))
    p = payload_json(c, ("tenant_id", "source_path", "format", "chunk_strategy"))
    return p.select("point_id", "tenant_id", "payload")


# further queries register themselves in the same tables
from docyard.plans import flows, retrieval  # noqa: E402,F401
