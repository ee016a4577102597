import random

from docyard.llm import linededup as L
from helpers import PYTHON_NODES, docs, edge_rows, words


def brute_in_order(rows, min_sites=L.MIN_SITES):
    sites, first = {}, {}
    for doc, text, source in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" ")
            if len(key) >= L.MIN_CHARS:
                sites.setdefault(key, set())
                if source is not None:
                    sites[key].add(source)
                if doc is not None:
                    first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(sites.get(x.strip(" "), ())) >= min_sites
                                         and x.strip(" ") in first and first[x.strip(" ")] != doc)]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def brute(rows):
    return sorted(brute_in_order(rows), key=str)


def spread_rows():
    rng = random.Random(2)
    rows = [(r[0], r[1], "s0") for r in edge_rows()]
    for n in range(1, 14):  # a line on n sites, below, at and over the threshold, several times each
        for k in range(2 * n):
            rows.append((1000 * n + k, f"{words(rng, 6)}\n  boilerplate line number {n}\nshort\nboilerplate line number {n}", f"s{k % n}"))
    rows.append((None, "boilerplate line number 12\nown words of this row", "s3"))
    rows.append((77, "boilerplate line number 12", None))
    return rows


def test_report_matches_brute_force(spark):
    rows = spread_rows()
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in L.line_report(docs(spark, rows, clash=True)).collect()), key=str)
    assert got == brute(rows)


def test_many_sites_are_decided_by_the_sketch(spark):
    rows = [(k, "shared by a thousand sites", f"site{k}") for k in range(1000)] + [(5000, "seen once only, here", "site1")]
    got = {r["doc_id"]: r["n_removed"] for r in L.line_report(docs(spark, rows), min_sites=100).collect()}
    assert got.pop(0) == 0 and got.pop(5000) == 0 and set(got.values()) == {1}


def test_stage_keeps_rows_columns_and_null_texts(spark):
    rows = spread_rows()
    df = docs(spark, rows, clash=True)
    out = L.drop_boilerplate(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    want = sorted(((d, None, None) if t is None else (d, new, len(new))
                   for (d, t, _), (_, _, _, new) in zip(rows, brute_in_order(rows))), key=str)
    assert got == want


def test_no_python_in_the_plan(spark, capsys):
    L.line_report(docs(spark, spread_rows())).explain("formatted")
    assert not PYTHON_NODES.search(capsys.readouterr().out)


def test_empty_table(spark):
    assert L.line_report(docs(spark, [])).count() == 0
