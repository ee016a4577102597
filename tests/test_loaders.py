"""S1-S8: html, markdown, page lists, block lists, dispatch, directory scan."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from docyard.sources import loaders as L
from docyard.sources.html import html_documents, text_nodes

PAGE = """<html><head><title> Tide tables </title>
<link rel="stylesheet" href="x.css"><link rel="alternate canonical" href="https://tides.test/tables"></head>
<body><header>Harbour office<article>Not this teaser</article></header><nav>Ports | Boats</nav>
<article><h2>High water</h2>At noon,<i>roughly</i>.
<ul><li>Low &lt; high<li>Neap tides</ul><style>i{}</style></article>
<main><p>Main wins over article.</p>  <footer>inner</footer><div>Second &amp; last</div></main><footer>Office hours</footer></body></html>"""

NOTES = """---
tags: none
---

Preface line
#  Rigging notes
##   Ropes
  Some text.

###### Deep
####### seven marks stay
"""


def pages(spark, *htmls):
    df = spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(htmls)], "id long, url string, html string")
    return {r["id"]: r for r in html_documents(df).collect()}


def test_html_page(spark):
    row = pages(spark, PAGE)[0]
    assert (row["title"], row["url"], row["format"]) == ("Tide tables", "https://tides.test/tables", "html")
    assert row["content"].split("\n") == ["Main wins over article.", "Second & last"]
    no_main = pages(spark, PAGE.replace("main>", "section>"))[0]
    assert no_main["content"].split("\n") == ["High water", "At noon,", "roughly", ".", "Low < high", "Neap tides"]


def test_html_root_is_looked_for_after_removal(spark):
    got = pages(spark, "<header><article>teaser</article><main>x</main></header><article>real text</article>",
                "<body><main></main><article>x</article></body>", "<body>out<article>A</article>B</body>",
                "<nav><body>no</nav><p>rest", "<p>a<!-- c -->b</p>", "<body><script>var t='</p>';</script>ok</body>")
    assert {k: r["content"] for k, r in got.items()} == {0: "real text", 2: "A", 3: "rest", 4: "a\nb", 5: "ok"}


def test_html_title_and_canonical(spark):
    got = pages(spark, "<title> </title><body>z</body>", "<body>z</body>", "<title></title><body>z</body>",
                "<link rel=canonical href=''><link rel=canonical href=late><body>z", "<link rel=canonical><body>z",
                "<link rel='x' href=no><link rel=Canonical href=yes><body>z")
    assert [got[k]["title"] for k in range(3)] == ["", None, None]
    assert [got[k]["url"] for k in range(3, 6)] == ["u3", "u4", "yes"]


def test_html_parsing_is_linear():
    start = time.time()
    for page in ("<li>" * 50_000 + "x", "<div>y" * 50_000, "<b>z</i>" * 50_000):
        text_nodes(page)
    assert time.time() - start < 6


def test_markdown_page(spark):
    row = L.markdown_documents(spark.createDataFrame([("n.md", NOTES)], "source_path string, raw string")).first()
    assert row["h1_title"] == "Rigging notes"
    assert row["content"].split("\n") == ["Preface line", "Rigging notes", "Ropes", "Some text.", "Deep", "####### seven marks stay"]


def test_markdown_title_rules_match_python(spark):
    import re
    h1 = re.compile(r"(?m)^#\s+(.+?)\s*$")
    raws = {"a": "#   \ntext", "b": "no heading", "c": "---\nx: 1\n---\n\n", "d": "intro\n#   ",
            "e": "x\n#  Title  \n# Other", "f": "####### seven\nbody"}
    df = spark.createDataFrame(list(raws.items()), "source_path string, raw string")
    got = {r["source_path"]: r for r in L.markdown_documents(df).collect()}
    assert "c" not in got
    for k, raw in raws.items():
        if k in got:
            m = h1.search(raw)
            assert got[k]["h1_title"] == (m.group(1).strip() if m else None)
    assert got["d"]["h1_title"] == "" and got["b"]["h1_title"] is None


def test_pages(spark):
    df = spark.createDataFrame([("d", "x.pdf", ["Page one text", "   ", "Page three"])],
                               "doc_id string, source_path string, pages array<string>")
    rows = L.explode_pages(df).orderBy("page_number").collect()
    assert [(r["page_number"], r["page_count"], r["content"]) for r in rows] == [
        (1, 3, "Page one text"), (3, 3, "Page three")]


def test_blocks(spark):
    rows = [("d", "paragraph", 0, "Heading 1", " Title "), ("d", "paragraph", 1, "Normal", "Body"),
            ("d", "paragraph", 2, "Heading 2", "  "), ("d", "table", 3, None, "Column A\tColumn B\n1\t2"),
            ("d", "table", 4, None, "  ")]
    df = spark.createDataFrame(rows, "doc_id string, kind string, ordinal int, style string, text string")
    r = L.flatten_blocks(df).first()
    assert "Column A\tColumn B" in r["content"]
    assert r["content"] == "Title\n\nBody\n\nColumn A\tColumn B\n1\t2"
    assert (r["heading_count"], r["table_count"]) == (1, 2)


def test_dispatch(spark):
    paths = ["a/b.PDF", "x.htm", "y.markdown", "z.docx", "notes.txt", "dir/", ".bashrc"]
    df = spark.createDataFrame([(p,) for p in paths], "source_path string")
    got = {r["source_path"]: (r["format"], r["error_message"]) for r in L.dispatch(df).collect()}
    assert got["a/b.PDF"][0] == "pdf" and got["x.htm"][0] == "html" and got["y.markdown"][0] == "markdown"
    assert got["notes.txt"] == (None, "No loader found for .txt")
    assert got[".bashrc"] == (None, "No loader found for ")


def _files(**content):
    root = tempfile.mkdtemp(prefix="docyard-files-")
    os.makedirs(f"{root}/sub")
    for name, data in content.items():
        with open(f"{root}/{name.replace('__', '/').replace('_dot_', '.')}", "wb") as fh:
            fh.write(data if isinstance(data, bytes) else data.encode())
    return root


def test_every_file_gives_documents_or_a_reject(spark):
    root = _files(sub__a_dot_md=NOTES, b_dot_html=PAGE, bad_dot_md=b"# T\n\xff\xfe broken", empty_dot_html="<nav>only menu</nav>",
                  paper_dot_pdf=b"%PDF-1.4 ...", report_dot_docx=b"PK...", c_dot_txt="left alone", d_dot_HTM="<body>upper</body>")
    rows = {os.path.basename(r["source_path"]): r for r in L.load_files(spark, root, tenant_id="harbour").collect()}
    assert set(rows) == {"a.md", "b.html", "bad.md", "empty.html", "paper.pdf", "report.docx"}
    why = {k: r["error_message"] for k, r in rows.items()}
    assert why["a.md"] is None and why["b.html"] is None
    assert why["bad.md"] == L.BAD_TEXT and why["empty.html"] == L.EMPTY
    assert why["paper.pdf"].startswith("No decoder for pdf") and why["report.docx"].startswith("No decoder for docx")
    assert all((r["content"] is None) == (r["error_message"] is not None) for r in rows.values())
    assert {r["tenant_id"] for r in rows.values()} == {"harbour"} and len({r["doc_id"] for r in rows.values()}) == 6
    assert all(r["loaded_at"] is not None and r["format"] for r in rows.values())
    relaxed = L.load_files(spark, root, case_sensitive=False)
    assert "d.HTM" in {os.path.basename(r["source_path"]) for r in relaxed.collect()}


def test_own_loader_and_unknown_suffix(spark):
    files = spark.createDataFrame([("x/a.pdf", bytearray(b"page one")), ("x/b.xyz", bytearray(b"?")), ("x/c.md", bytearray(b"# C"))],
                                  "source_path string, content binary")
    own = {"pdf": lambda t: t.withColumnRenamed("raw", "content")}
    got = {r["source_path"]: (r["format"], r["content"], r["error_message"]) for r in L.load_outcomes(files, own).collect()}
    assert got == {"x/a.pdf": ("pdf", "page one", None), "x/b.xyz": (None, None, "No loader found for .xyz"),
                   "x/c.md": ("markdown", "C", None)}


def test_urls_and_paths(spark):
    paths = ["/a b/ü.html", "hdfs://nn/x.html", "s3a://bucket/y.html"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["u"] for r in df.select(L.file_uri("p").alias("u")).collect()] == [
        "file:///a%20b/%C3%BC.html", "hdfs://nn/x.html", "s3a://bucket/y.html"]
    df = spark.createDataFrame([("file:/a/b",), ("file:///a/b",), ("hdfs://nn/a",), ("/a/b",)], "p string")
    assert [r["u"] for r in df.select(L.local_path("p").alias("u")).collect()] == ["/a/b", "/a/b", "hdfs://nn/a", "/a/b"]


def test_extra_metadata_wins(spark):
    df = spark.createDataFrame([(1, {"a": "old", "b": "kept"}), (2, None)], "id int, extra map<string,string>")
    got = {r["id"]: r["extra"] for r in L.with_extra(df, {"a": "new"}).collect()}
    assert got == {1: {"a": "new", "b": "kept"}, 2: {"a": "new"}}
    assert L.with_extra(df.drop("extra"), {"k": "v"}).first()["extra"] == {"k": "v"}
