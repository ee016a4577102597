"""Loaders as DataFrame functions: markdown, page lists, block lists, dispatch.

* ``markdown_documents``  front matter, first-level title, heading markers, blank lines.
* ``explode_pages``       one document per non-empty page (page lists stand in for PDF).
* ``flatten_blocks``      paragraphs then tables of a block list (stands in for Word files).
* ``dispatch``            suffix -> format, or the "No loader found" message.
* ``load_outcomes``       every listed file as documents or as one reject row with its message.

All native column expressions; the only grouping is ``flatten_blocks``,
whose group is one document (its output row holds that document anyway).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docyard.functions.text import PY_WS, bind_column, py_strip, split_lines, with_column_where

# Fixed values, must match: suffixes each loader accepts (compared in lower case), in dispatch order.
LOADER_SUFFIXES = (
    ("pdf", (".pdf",)),
    ("html", (".html", ".htm")),
    ("markdown", (".md", ".markdown")),
    ("docx", (".docx",)),
)
# Suffixes a directory walk picks up (exact case).
DIRECTORY_SUFFIXES = (".pdf", ".html", ".md", ".docx")
NO_LOADER = "No loader found for "

FRONT_MATTER = rf"(?s)\A---{PY_WS}*\n.*?\n---{PY_WS}*(?:\n|\z)"
H1 = rf"(?md)^#{PY_WS}+(.+?){PY_WS}*$"
HEADING_PREFIX = rf"^#{{1,6}}{PY_WS}+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def universal_newlines(col: Column | str) -> Column:
    """Text-mode reading: CRLF and CR become LF."""
    return F.regexp_replace(_c(col), r"\r\n?", "\n")


def markdown_documents(df: DataFrame, raw_col: str = "raw", keep_empty: bool = False) -> DataFrame:
    """Markdown text -> (content, h1_title); rows without text are dropped (or kept with a NULL content)."""
    body = F.regexp_replace(universal_newlines(raw_col), FRONT_MATTER, "")
    w = df.withColumn("_md", body)
    h1 = F.when(F.col("_md").rlike(H1), py_strip(F.regexp_extract("_md", H1, 1)))
    lines = F.transform(split_lines("_md"), lambda l: py_strip(F.regexp_replace(l, HEADING_PREFIX, "")))
    content = py_strip(F.array_join(F.filter(lines, lambda l: l != F.lit("")), "\n"))
    keep = [c for c in df.columns if c != raw_col]
    out = w.select(*keep, "_md", h1.alias("h1_title"), F.lit("markdown").alias("format"))
    if keep_empty:
        out = bind_column(out, "content", content).withColumn("content", F.when(F.col("content") != "", F.col("content")))
    else:
        out = with_column_where(out, "content", content, lambda c: c != F.lit(""))
    return out.select(*keep, "content", "h1_title", "format")


def explode_pages(df: DataFrame, pages_col: str = "pages") -> DataFrame:
    """One row per page with stripped non-empty text; numbers count every page."""
    keep = [c for c in df.columns if c != pages_col]
    out = df.select(*keep, F.size(pages_col).alias("page_count"),
                    F.posexplode(pages_col).alias("_pos", "_page"))
    return (out.select(*keep, (F.col("_pos") + 1).alias("page_number"), "page_count",
                       py_strip("_page").alias("content"), F.lit("pdf").alias("format"))
               .filter(F.col("content") != F.lit("")))


def flatten_blocks(blocks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Block rows (doc, kind, ordinal, style, text) -> one document per doc.

    Non-empty stripped paragraphs in order, then non-empty stripped tables in
    order, joined by a blank line. ``heading_count`` counts kept paragraphs
    whose style starts with ``Heading``; ``table_count`` counts every table.
    """
    is_table = F.col("kind") == F.lit("table")
    t = py_strip("text")
    parts = F.struct(F.when(is_table, 1).otherwise(0).alias("r"), F.col("ordinal").alias("o"), t.alias("t"))
    agg = blocks.groupBy(doc_col).agg(
        F.sort_array(F.collect_list(F.when(t != F.lit(""), parts))).alias("_parts"),
        F.count_if((~is_table) & (t != F.lit("")) & F.coalesce(F.col("style"), F.lit("")).startswith("Heading"))
         .alias("heading_count"),
        F.count_if(is_table).alias("table_count"),
    )
    content = py_strip(F.array_join(F.transform("_parts", lambda p: p["t"]), "\n\n"))
    return (agg.select(doc_col, content.alias("content"), "heading_count", "table_count",
                       F.lit("docx").alias("format"))
               .filter(F.col("content") != F.lit("")))


def path_suffix(path: Column | str) -> Column:
    """``PurePath(path).suffix``: last dot of the last component, not leading or trailing."""
    name = F.regexp_extract(F.regexp_replace(_c(path), "/+$", ""), "([^/]*)$", 1)
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def dispatch(df: DataFrame, path_col: str = "source_path") -> DataFrame:
    """Add ``suffix``, ``format`` (first loader accepting it) and ``error_message``."""
    suffix = path_suffix(path_col)
    low = F.lower(suffix)
    fmt = F.lit(None).cast("string")
    for name, sufs in reversed(LOADER_SUFFIXES):
        fmt = F.when(low.isin(*sufs), F.lit(name)).otherwise(fmt)
    w = df.withColumn("suffix", suffix).withColumn("format", fmt)
    return w.withColumn("error_message",
                        F.when(F.col("format").isNull(), F.concat(F.lit(NO_LOADER), F.col("suffix"))))


NO_DECODER = "No decoder for {} files: give their pages or blocks as a table"
BAD_TEXT = "File is not valid UTF-8"
EMPTY = "File holds no text"
DOCUMENT_FIELDS = ("source_path", "format", "content", "title", "url", "h1_title", "error_message")


def local_path(path: Column | str) -> Column:
    """A file URI without its scheme; every other URI as it is."""
    return F.regexp_replace(_c(path), "^file:(?://(?=/))?", "")


def file_uri(path: Column | str) -> Column:
    """A path as a URI, its special characters percent-encoded; a path that has a scheme stays a URI."""
    c = _c(path)
    coded = F.array_join(F.transform(F.split(c, "/"), lambda part: F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))), "/")
    return F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c).otherwise(F.concat(F.lit("file://"), coded))


def _glob(suffixes, case_sensitive: bool) -> str:
    """A file name pattern; without case every letter stands for both of its forms."""
    if case_sensitive:
        return "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s.lstrip("."))
                            for s in suffixes) + "}"


def scan_directory(spark, path: str, suffixes=DIRECTORY_SUFFIXES, case_sensitive: bool = True) -> DataFrame:
    """Recursive file listing as rows (source_path, raw bytes), kept by suffix while listing.

    The directory walk keeps exact-case suffixes by default, as the reference does.
    """
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", _glob(suffixes, case_sensitive)).load(path)
            .select(local_path("path").alias("source_path"), "content", "length"))


def html_file_documents(text: DataFrame) -> DataFrame:
    """HTML files (source_path, raw and carried columns) -> one row per file; content NULL when it holds no text."""
    from docyard.sources.html import html_documents

    return html_documents(text.withColumnRenamed("raw", "html").withColumn("url", file_uri("source_path")), keep_empty=True)


def markdown_file_documents(text: DataFrame) -> DataFrame:
    """Markdown files (source_path, raw and carried columns) -> one row per file; content NULL when it holds no text."""
    return markdown_documents(text, "raw", keep_empty=True)


#: Format -> loader: (source_path, raw, carried columns) -> at least one row per file, its content NULL when there is none.
#: Formats without a loader are rejected by name.
LOADERS = {"html": html_file_documents, "markdown": markdown_file_documents}


def format_outcomes(files: DataFrame, name: str, loaders=None) -> DataFrame:
    """Files of one format (source_path, content bytes) -> documents and rejects, in one pass over the bytes."""
    known = LOADERS if loaders is None else {**LOADERS, **loaders}
    if name not in known:  # the bytes are never read
        return files.select("source_path", F.lit(name).alias("format"), F.lit(NO_DECODER.format(name)).alias("error_message"))
    text = F.col("content").cast("string")
    docs = known[name](files.select("source_path", F.is_valid_utf8(text).alias("_valid"),
                                    F.when(F.is_valid_utf8(text), text).alias("raw")))
    valid = F.col("_valid") if "_valid" in docs.columns else F.lit(True)
    why = F.when(F.col("content").isNull(), F.when(F.coalesce(valid, F.lit(False)), F.lit(EMPTY)).otherwise(F.lit(BAD_TEXT)))
    return docs.withColumn("error_message", why).withColumn("format", F.lit(name)).drop("_valid")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for c in DOCUMENT_FIELDS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def load_outcomes(files: DataFrame, loaders=None) -> DataFrame:
    """Files (source_path, content bytes) -> documents and rejects; no file goes without a row.

    A reject has no content and says why in ``error_message``: no loader for its suffix, no decoder for its
    format, bytes that are not UTF-8, or no text left. ``loaders`` replaces or adds formats.
    """
    seen = dispatch(files, "source_path")
    parts = [seen.filter(F.col("format").isNull()).select("source_path", F.lit(None).cast("string").alias("format"),
                                                          "error_message")]
    parts += [format_outcomes(seen.filter(F.col("format") == name), name, loaders) for name, _ in LOADER_SUFFIXES]
    return _together(parts)


def load_files(spark, path: str, tenant_id: str | Column | None = None, case_sensitive: bool = True,
               loaders=None, suffixes=DIRECTORY_SUFFIXES) -> DataFrame:
    """Directory -> documents and reject rows (``error_message`` set), with ids and base metadata.

    Every format is listed with its own name pattern, so each file is opened once, and not at all when its
    format has no loader.
    """
    from docyard.operators.chunking import document_id

    parts = []
    for name, accepted in LOADER_SUFFIXES:
        mine = [x for x in accepted if not case_sensitive or x in suffixes]
        if mine:
            parts.append(format_outcomes(scan_directory(spark, path, mine, case_sensitive), name, loaders))
    out = base_metadata(_together(parts))
    out = attach_tenant(out, tenant_id if tenant_id is not None else F.lit(None).cast("string"))
    return out.withColumn("doc_id", document_id("tenant_id", "source_path", "page_number" if "page_number" in out.columns else None))


def with_extra(df: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Merge free-form metadata into the ``extra`` map of every document; the given values win."""
    if not extra:
        return df
    given = F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])
    if "extra" not in df.columns:
        return df.withColumn("extra", given)
    kept = F.map_filter(F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
                        lambda k, _: ~k.isin(*extra))
    return df.withColumn("extra", F.map_concat(kept, given))


def base_metadata(df: DataFrame) -> DataFrame:
    """Load time (UTC) next to the source path and format each loader sets."""
    return df.withColumn("loaded_at", F.current_timestamp())


def attach_tenant(df: DataFrame, tenant_id: str | Column) -> DataFrame:
    """Overwrite ``tenant_id`` on every document (a literal or a per-row column)."""
    value = tenant_id if isinstance(tenant_id, Column) else F.lit(tenant_id)
    return df.withColumn("tenant_id", value)
