"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A text's words (runs of digits, ASCII letters and non-ASCII characters) are put side by side with single blanks.
Rules find licence names in phrases, passages of licence bodies and file headers, and notices that name no licence; other bodies
(most long licences) are found by the name they hold. They are regular expressions over that line of words, each with a keyword, a priority, a weight and a label. A keyword prefilter
decides per text which rules run at all; most texts run none. Every match becomes a detection, an interval of words.
Detections compete per text: one whose interval lies inside another of at least its priority is suppressed (of equal
intervals the first rule stays), and one that overlaps a stronger one is suppressed as well. Labels and the score come from the
detections left; the base phrases' labels and places stay whatever suppresses them.

Positions are running sums of blanks between matches, suppression is running maxima of interval ends, both as windows over
one text's detections: linear in the text, and only counts and rule numbers are shuffled, never the text.

Defined results: a null or empty text has no words and no detection (empty labels, score 0); repeated rows
are scanned row by row; a text with very many detections is one window, sorted outside memory where it must be; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import table

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Hand-written signatures: label, keyword that every match holds, the licence's name as a pattern over words.
_L = "licen[cs]e"
_V = "(?: v| version)?"
LICENSES = (
    ("mit", "mit licen", f"mit {_L}"), ("mit-0", "mit no attribution", f"mit no attribution {_L}"), ("x11", "x11 licen", f"(?:mit )?x11 {_L}"),
    ("expat", "expat licen", f"expat {_L}"), ("isc", "isc licen", f"isc {_L}"),
    ("apache-1.1", "apache", f"apache (?:software )?{_L}{_V} 1 1"), ("apache-2.0", "apache", f"apache (?:software )?{_L}{_V} 2(?: 0)?"),
    ("apache", "apache", f"apache (?:software )?{_L}"),
    ("gpl-1.0", "general public", f"(?:gnu )?general public {_L}{_V} 1(?: 0)?"),
    ("gpl-2.0", "general public", f"(?:gnu )?general public {_L}{_V} 2(?: 0)?"),
    ("gpl-3.0", "general public", f"(?:gnu )?general public {_L}{_V} 3(?: 0)?"),
    ("gpl", "general public", f"(?:gnu )?general public {_L}"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?"), ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "general public", f"(?:gnu )?(?:lesser|library) general public {_L}{_V} 2(?: 1)?"),
    ("lgpl-3.0", "general public", f"(?:gnu )?lesser general public {_L}{_V} 3(?: 0)?"),
    ("lgpl", "general public", f"(?:gnu )?(?:lesser|library) general public {_L}"), ("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", "general public", f"(?:gnu )?affero general public {_L}{_V} 3(?: 0)?"),
    ("agpl", "general public", f"(?:gnu )?affero general public {_L}"), ("agpl", "agpl", "(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("bsd-2-clause", "bsd", f"(?:bsd 2 clause(?: {_L})?|(?:simplified|2 clause|two clause) bsd {_L})"),
    ("bsd-3-clause", "bsd", f"(?:bsd 3 clause(?: {_L})?|(?:new|modified|revised|3 clause|three clause) bsd {_L})"),
    ("bsd-4-clause", "bsd", f"(?:bsd 4 clause(?: {_L})?|(?:original|4 clause|four clause) bsd {_L})"),
    ("0bsd", "bsd", f"(?:0bsd|zero clause bsd(?: {_L})?)"), ("bsd", "bsd", f"bsd {_L}"),
    ("mpl-1.1", "mozilla", f"mozilla public {_L}{_V} 1 1"), ("mpl-2.0", "mozilla", f"mozilla public {_L}{_V} 2(?: 0)?"),
    ("mpl", "mozilla", f"mozilla public {_L}"), ("epl-1.0", "eclipse", f"eclipse public {_L}{_V} 1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public {_L}{_V} 2(?: 0)?"), ("epl", "eclipse", f"eclipse public {_L}"),
    ("cddl", "common development", f"common development and distribution {_L}"), ("cpl", "common public", f"common public {_L}"),
    ("eupl", "european union", f"european union public {_L}"), ("osl", "open software", f"open software {_L}"),
    ("afl", "academic free", f"academic free {_L}"), ("artistic-1.0", "artistic licen", f"artistic {_L}{_V} 1(?: 0)?"),
    ("artistic-2.0", "artistic licen", f"artistic {_L}{_V} 2(?: 0)?"), ("artistic", "artistic licen", f"artistic {_L}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}"), ("boost", "boost", f"boost software {_L}(?:{_V} 1(?: 0)?)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc0", "creative commons", "creative commons zero"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"), ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?"), ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?"), ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", f"creative commons attribution(?: [1-4] [05])?(?: international)?(?: {_L})?"),
    ("cc-by-sa", "creative commons", f"creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: {_L})?"),
    ("cc-by-nc", "creative commons", f"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: {_L})?"),
    ("creative-commons", "creative commons", f"creative commons {_L}"),
    ("openssl", "openssl", f"openssl {_L}"), ("php", "php licen", f"php {_L}"), ("python", "python", f"python(?: software foundation)? {_L}"),
    ("ruby", "ruby licen", f"ruby {_L}"), ("ofl", "open font", f"(?:sil )?open font {_L}"),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {_L}"), ("odbl", "open database", f"open database {_L}"),
    ("ms-pl", "microsoft", f"microsoft public {_L}"), ("ms-rl", "microsoft", f"microsoft reciprocal {_L}"),
    ("postgresql", "postgresql", f"postgresql {_L}"), ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    ("upl", "universal permissive", f"universal permissive {_L}"), ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}"),
)
# Templates: priority (1 is strongest), weight, pattern; NAME is the licence's name, ID its label's words.
TEMPLATES = (
    (1, 1.0, "(?:licen[cs]ed|released|distributed|published|provided|available|redistributed) under (?:the )?(?:terms of (?:the )?)?NAME"),
    (1, 1.0, "spdx licen[cs]e identifier ID"),
    (2, 0.9, "(?:subject to|governed by|covered by|see|read) (?:the )?(?:terms of (?:the )?)?NAME"),
    (2, 0.9, "(?:a )?copy of (?:the )?NAME"),
    (3, 0.7, "NAME"),
)
# Passages of licence bodies and file headers, found without the licence's name. _then: a passage that follows after at most so many words;
# it is no part of the match, so what else stands between is not suppressed.
def _then(words: int, passage: str) -> str:
    return "(?=(?: [^ ]++){0,%d}? (?:%s) )" % (words, passage)


_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software"
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met")
_ISC = "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"
_GNU = f"general public {_L} as published by the free software foundation (?:either )?version"
_FREEDOM = "designed to take away your freedom to share and change"
_CHARGE, _USE, _FORMS = "permission is hereby granted free of charge", "permission to use copy modify", "in source and binary forms"
_GNU_GATE, _GRANT = "as published by the free software foundation", "hereby grants"
# Label, keyword, priority, weight, pattern. A passage that only one member of a family has is the stronger one.
BODIES = (
    ("mit-0", _CHARGE, 1, 0.9, _MIT + _then(60, "furnished to do so the software is provided")),
    ("ncsa", _CHARGE, 1, 0.9, _MIT + _then(12, "to deal with the software")),
    ("x11", _CHARGE, 1, 0.9, _MIT + _then(220, "except as contained in this notice the names?")),
    ("mit", _CHARGE, 2, 0.9, _MIT),
    ("boost", _CHARGE, 2, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ofl", _CHARGE, 2, 0.9, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("upl", "associated documentation and or data", 2, 0.9,
     "permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("isc", _USE, 2, 0.9, f"{_ISC} provided that"), ("0bsd", _USE, 2, 0.9, f"{_ISC} the software is provided"),
    ("postgresql", _USE, 2, 0.9, "permission to use copy modify and distribute this software and its documentation for any purpose "
                                 "without fee and without a written agreement"),
    ("hpnd", _USE, 2, 0.9, "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation "
                           "for any purpose (?:and without fee is hereby granted|is hereby granted without fee)"),
    ("w3c", "permission to copy modify", 2, 0.9, "permission to copy modify and distribute this software and its documentation "
                                                 "with or without modification for any purpose and without fee or royalty"),
    ("apache-1.1", _FORMS, 1, 0.9, _BSD + _then(90, "the end user documentation included with the redistribution")),
    ("bsd-4-clause", _FORMS, 1, 0.9, _BSD + _then(90, "all advertising materials mentioning features or use of this software")),
    ("bsd-3-clause", _FORMS, 2, 0.9, _BSD + _then(90, "neither the names?|may not be used to endorse or promote products")),
    ("bsd-2-clause", _FORMS, 2, 0.9, _BSD + _then(70, "provided with the distribution this software is provided by")),
    ("bsd", _FORMS, 3, 0.7, _BSD),
    ("zlib", "origin of this software", 2, 0.9,
     "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered software", 2, 0.9, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck you want to", 2, 0.9,
     f"(?:do what the fuck you want to public {_L}|you just do what the fuck you want to)"),
    ("apache-2.0", "except in compliance with the licen", 2, 0.9,
     f"you may not use this (?:file|work|software|project|library|product) except in compliance with the {_L}"),
    ("apache-2.0", _GRANT, 2, 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free"),
    ("mpl-2.0", _GRANT, 2, 0.9, "each contributor hereby grants you a world wide royalty free non exclusive license"),
    ("cddl", _GRANT, 2, 0.9, "claims the initial developer hereby grants you a world wide royalty free non exclusive license"),
    ("mpl-1.1", _GRANT, 3, 0.7, "the initial developer hereby grants you a world wide royalty free non exclusive license"),
    ("python", _GRANT, 2, 0.9, "psf hereby grants licensee a non ?exclusive royalty free world wide license"),
    ("gpl-1.0", _GNU_GATE, 1, 1.0, f"gnu {_GNU} 1"), ("gpl-2.0", _GNU_GATE, 1, 1.0, f"gnu {_GNU} 2"),
    ("gpl-3.0", _GNU_GATE, 1, 1.0, f"gnu {_GNU} 3"), ("lgpl-2.1", _GNU_GATE, 1, 1.0, f"(?:lesser|library) {_GNU} 2(?: 1)?"),
    ("lgpl-3.0", _GNU_GATE, 1, 1.0, f"lesser {_GNU} 3"), ("agpl-3.0", _GNU_GATE, 1, 1.0, f"affero {_GNU} 3"),
    ("gpl-2.0", _FREEDOM, 2, 0.9, f"{_FREEDOM} it by contrast the gnu general public {_L} is intended"),
    ("lgpl", _FREEDOM, 2, 0.9, f"{_FREEDOM} it by contrast the gnu general public licenses are intended"),
    ("gpl-3.0", _FREEDOM, 2, 0.9, f"{_FREEDOM} the works by contrast the gnu general public {_L} is intended"),
    ("agpl-3.0", _FREEDOM, 2, 0.9, f"{_FREEDOM} the works by contrast our general public licenses are intended"),
    ("lgpl-3.0", "incorporates the terms and conditions", 2, 0.9,
     f"lesser general public {_L} incorporates the terms and conditions of version 3"),
    ("cc0", "permanently relinquish those rights", 2, 0.9, "certain owners wish to permanently relinquish those rights to a work"),
    ("artistic-1.0", "the intent of this document", 2, 0.9,
     "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "a given free software package", 2, 0.9,
     "establishes the terms under which a given free software package may be copied modified distributed"),
)
# Signatures that name no licence: label, keyword, priority, weight, pattern.
NOTICES = (
    ("all-rights-reserved", "all rights reserved", 3, 0.5, "all rights reserved"),
    ("public-domain", "public domain", 2, 0.8, "(?:dedicated|released|placed) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", 3, 0.5, "public domain"),
    ("copyright", "copyright", 4, 0.3, "copyright (?:c )?[12][0-9]{3}"),
    ("no-warranty", "warranty", 4, 0.3, "without warranty of any kind"),
    ("license", "licen", 4, 0.3, "(?:see|read) (?:the )?licen[cs]e (?:file )?for (?:more )?details"),
)
PRIORITIES = (1, 2, 3, 4)


def build_rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """(number, label, keyword, pattern, priority, weight, base) in order of the rules."""
    out = []
    for label, keyword, name in LICENSES:
        words = label.replace("-", " ").replace(".", " ")
        for priority, weight, template in TEMPLATES:
            gate = "spdx licen" if "ID" in template else keyword  # what every match of this rule holds
            out.append((label, gate, template.replace("NAME", f"(?:{name})").replace("ID", words), priority, weight, False))
    out += [(label, keyword, pattern, priority, weight, False) for label, keyword, priority, weight, pattern in BODIES + NOTICES]
    out += [(label, phrase, phrase, 4, 0.6, True) for phrase, label in BASE]
    return [(k, label, gate, f"(?i)(?<= )(?:{pattern})(?= )", priority, weight, base)
            for k, (label, gate, pattern, priority, weight, base) in enumerate(out)]


RULES = build_rules()


def word_line(text: Column) -> Column:
    """`` w0 w1 ... wn ``: the text's words with single blanks around them (no words: one blank)."""
    words = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _rule_table(rules) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(gate).alias("keyword"), F.lit(pattern).alias("pattern"))
                     for k, _, gate, pattern, _, _, _ in rules])


def detections(docs: DataFrame, rules=None) -> DataFrame:
    """One row per detection (row, doc_id, n_words, rule, start, stop), and one without a rule for texts that have none."""
    rules = RULES if rules is None else rules
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_line(F.coalesce("text", F.lit(""))).alias("line"))
    keywords = sorted({gate for _, _, gate, _, _, _, _ in rules})
    # one test per keyword, not a lambda over the keywords: a lambda would lower-case the text anew for each
    gated = lines.withColumn("low", F.lower("line")).withColumn(
        "hits", F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(k)), F.lit(k)) for k in keywords])))
    found = F.transform(
        F.filter(_rule_table(rules), lambda r: F.array_contains(F.col("hits"), r["keyword"])),
        lambda r: F.struct(r["rule"].alias("rule"),
                           F.transform(F.split(F.col("line"), r["pattern"], -1), _blanks).alias("between"),
                           F.transform(F.regexp_extract_all(F.col("line"), r["pattern"], F.lit(0)), _blanks).alias("inside")))
    per_rule = gated.select(
        "row", "doc_id", F.greatest(F.lit(0), _blanks(F.col("line")) - 1).cast("long").alias("n_words"),
        F.when(F.size("hits") > 0, F.filter(found, lambda f: F.size(f["inside"]) > 0)).alias("found"))
    places = (per_rule.select("row", "doc_id", "n_words", F.explode_outer("found").alias("f"))
              .select("row", "doc_id", "n_words", F.col("f.rule").alias("rule"), F.posexplode_outer(F.transform(
                  F.col("f.inside"), lambda x, i: F.struct(F.get(F.col("f.between"), i).alias("before"), x.alias("inside"))))
                  .alias("i", "place"))
              .select("row", "doc_id", "n_words", "rule", "i", "place.before", "place.inside").repartition("row"))
    so_far = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("before") + F.col("inside")).over(so_far) - F.col("inside") - 1).cast("long")
    return (places.withColumn("start", start).withColumn("stop", F.col("start") + F.col("inside") + 1)
            .select("row", "doc_id", "n_words", "rule", "start", "stop"))


def _of_rule(rules, at: int) -> Column:
    """A property of the rule, looked up by its number."""
    return F.get(F.array(*[F.lit(r[at]) for r in rules]), F.col("rule"))


def scan(docs: DataFrame, rules=None) -> DataFrame:
    """Per row of ``docs``: words, base places and labels, labels of all detections left, and a score."""
    rules = RULES if rules is None else rules
    d = (detections(docs, rules).withColumn("label", _of_rule(rules, 1)).withColumn("priority", _of_rule(rules, 4))
         .withColumn("weight", _of_rule(rules, 5)).withColumn("base", F.coalesce(_of_rule(rules, 6), F.lit(False))))
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(before) for p in PRIORITIES}
    ahead = {p: F.min(F.when(F.col("priority") < p, F.col("start"))).over(after) for p in PRIORITIES[1:]}
    for p in PRIORITIES:
        d = d.withColumn(f"reach_{p}", reach[p])
        if p in ahead:
            d = d.withColumn(f"ahead_{p}", ahead[p])
    lost = F.lit(False)
    for p in PRIORITIES:
        mine = F.col(f"reach_{p}") >= F.col("stop")  # contained in one of at least this priority
        if p > PRIORITIES[0]:
            mine = mine | (F.col(f"reach_{p - 1}") > F.col("start")) | (F.col(f"ahead_{p}") < F.col("stop"))
        lost = F.when(F.col("priority") == p, F.coalesce(mine, F.lit(False))).otherwise(lost)
    d = d.withColumn("left", F.col("rule").isNotNull() & ~lost)
    base, left = F.col("base"), F.col("left")
    listed = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return d.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, F.lit(1))).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | left).alias("labels"),
        F.coalesce(F.max(F.when(base | left, F.col("weight"))), F.lit(0.0)).cast("double").alias("score")).drop("row")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
