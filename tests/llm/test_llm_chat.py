import random

from docyard.llm import chat as C
from helpers import PYTHON_NODES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        speaker = (role or "").strip(" ") or C.UNKNOWN
        key = (conv, turn, speaker, text or "")
        turns[key] = turns.get(key, 0) + 1
    out = []
    for conv in {k[0] for k in turns}:
        mine = sorted((k for k in turns if k[0] == conv), key=lambda k: (k[1] is None, k[1] or 0, k[2], k[3]))
        for view in sorted({k[2] for k in mine} - {C.SYSTEM}):
            at = 0
            for place, k in enumerate(mine):
                role = "assistant" if k[2] == view else "system" if k[2] == C.SYSTEM else "user"
                name = k[2].translate(str.maketrans("<|>\n\r\t ", "_______"))
                head = f"<|{role}{' name=' + name if role == 'user' else ''}|>\n"
                segment = head + k[3].replace("<|", "< |") + "<|end|>\n"
                mask = (at + len(head), at + len(segment) - 1) if role == "assistant" else (at, at)
                out.append((conv, view, place, k[1], role, k[2], segment, at, *mask, turns[k]))
                at += len(segment)
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["ann", "bob", "system", "c d|x", "ann "]), rng.choice(["hi", "", "é😀", "a<|end|>b", None, "long " * 50]))
            for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, f"p{t % 3}", f"turn {t}") for t in range(500)]  # many blocks
    rows += [(51, 0, "system", "only system")] + [(52, 1, None, None), (52, 1, " ", ""), (None, None, "ann", "x"), (None, 3, "bob", "y")]
    rows += [(53, 0, "ann", "same")] * 40 + [(53, 0, "bob", "tie"), (53, 0, "ann", "tie"), (53, -70, "bob", "first")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "conv_id")
    for c in ("segment", "block", "speaker", "perspective", "start"):
        df = df.selectExpr("*", f"'extra' as {c}")
    out = C.rotate(df)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_masks_hold_the_text_of_the_perspective(spark):
    rows = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi there"), (1, 2, "ann", "bye")]
    out = C.rotate(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    for view, want in (("ann", ["hello<|end|>", "bye<|end|>"]), ("bob", ["hi there<|end|>"])):
        mine = [r for r in out if r["perspective"] == view]
        text = "".join(r["segment"] for r in mine)
        assert [text[r["mask_start"]:r["mask_end"]] for r in mine if r["role"] == "assistant"] == want


def test_no_python_in_the_plan_and_empty_table(spark, capsys):
    out = C.rotate(spark.createDataFrame([], SCHEMA))
    out.explain("formatted")
    assert not PYTHON_NODES.search(capsys.readouterr().out) and out.count() == 0
