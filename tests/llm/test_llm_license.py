import random
import re

from docyard.llm import license as L
from helpers import PYTHON_NODES, docs, edge_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    """Every column by a plain scan: rules one by one, intervals against all others."""
    w = WORD.findall((text or "").translate(LOWER))
    line = " " + " ".join(w) + " " if w else " "
    found = []
    for number, label, _, pattern, priority, weight, base in L.RULES:
        for m in re.finditer(pattern, line, re.ASCII):
            start = line[:m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, priority, number, label, weight, base))
    left = []
    for d in found:
        inside = any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2]
                     and ((e[0], -e[1], e[2], e[3]) < (d[0], -d[1], d[2], d[3])) for e in found)
        overlapped = any(e[2] < d[2] and e[0] < d[1] and e[1] > d[0] for e in found)
        if not inside and not overlapped:
            left.append(d)
    base = [d for d in found if d[6]]
    labels = {d[4] for d in base + left}
    return (len(w), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted({d[4] for d in base})), ",".join(sorted(labels)), max((d[5] for d in base + left), default=0.0))


def texts():
    rng = random.Random(6)
    parts = ["MIT License", "mit-license", "licensed under the Apache License, Version 2.0", "GNU General Public License v3",
             "the GNU Lesser General Public License version 2.1", "All rights reserved.", "CC BY-NC 4.0", "Released under",
             "a copy of the", "Mozilla Public Licence 2.0", "SPDX-License-Identifier: MIT", "mit", "license", "Apache", "public domain",
             "3-clause BSD license", "wörter", "é", "words", ",", "\n", "Copyright (c) 2019", "permit license", "mit licenseé",
             "lİcense", "MIT LICENSE", "general  public\nlicense", "x" * 30]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(250)]


def columns(r):
    return (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])


def test_matches_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    got = {r["doc_id"]: columns(r) for r in L.scan(docs(spark, rows)).collect()}
    for k, t in rows:
        assert got[k] == brute(t), t


def test_edges(spark):
    rows = edge_rows() + [(20, "mit license " * 20_000), (21, "MIT License"), (21, "MIT License")]
    out = L.scan(docs(spark, rows, clash=True)).collect()
    assert len(out) == len(rows)
    got = sorted(((r["doc_id"], *columns(r)) for r in out), key=str)
    short = [(d, *brute(t)) for d, t in rows if d != 20]
    assert [g for g in got if g[0] != 20] == sorted(short, key=str)
    assert next(g for g in got if g[0] == 20) == (20, 40_000, 20_000, 0, 39_998, "mit", "mit", 0.7)
    assert L.scan(docs(spark, [])).count() == 0


def test_hundreds_of_rules_hold_their_keywords(spark):
    assert len(L.RULES) > 300
    for _, _, gate, pattern, _, _, _ in L.RULES:
        assert gate == gate.lower() and re.compile(pattern)


def test_no_python_in_the_plan(spark, capsys):
    L.scan(docs(spark, [(1, "x")])).explain("formatted")
    assert not PYTHON_NODES.search(capsys.readouterr().out)


AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
       'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
       'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
       'Software is furnished to do so')
MIT_TERMS = (", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
             f"copies or substantial portions of the Software.\n\n{AS_IS}")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
       "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
       "and the following disclaimer in the documentation and/or other materials provided with the distribution.\n")
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products."
BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n4. "
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
GNU = "under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License"
BODIES = [
    ("mit,no-warranty", MIT + MIT_TERMS), ("mit-0,no-warranty", f"{MIT}.\n\n{AS_IS}"),
    ("no-warranty,x11", f"{MIT}{MIT_TERMS}\n\nExcept as contained in this notice, the name of the X Consortium shall not be used"),
    ("ncsa", MIT.replace("deal in", "deal with")),
    ("isc", f"{ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd", f'{ISC}.\n\nTHE SOFTWARE IS PROVIDED "AS IS"'), ("bsd-2-clause", BSD + BSD_END),
    ("bsd-3-clause", f"{BSD}3. {BSD_3}\n\n{BSD_END}"), ("bsd-4-clause", f"{BSD}{BSD_4}{BSD_3}\n\n{BSD_END}"), ("bsd", BSD[:160]),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("apache-2.0", "you may not use this file except in compliance with the License."),
    ("gpl,gpl-2.0", GNU.format("General Public License", 2)), ("gpl,gpl-3.0", GNU.format("General Public License", 3)),
    ("gpl,lgpl-2.1", GNU.format("Lesser General Public License", 2.1)), ("agpl-3.0,gpl", GNU.format("Affero General Public License", 3)),
    ("", "Permission is hereby granted, free of charge. Redistribution and use are fine."),
]


def test_bodies_without_a_name(spark):
    got = {r["doc_id"]: columns(r) for r in L.scan(docs(spark, [(k, t) for k, (_, t) in enumerate(BODIES)])).collect()}
    for k, (labels, text) in enumerate(BODIES):
        assert got[k] == brute(text), text
        assert got[k][5] == labels, text


def test_bodies_hold_their_keywords():
    for label, keyword, _, _, pattern in L.BODIES:
        assert keyword in pattern, label
