"""License scans: known sentences, then rules over their order.

A text's lines and its sentences are normalised and looked up among the known licence sentences;
what is known becomes the sequence of sentence numbers in the order in which they first stand in the text. A rule is an ordered list of
sentence numbers with room for a few others between them; a licence is recognised when a rule of it
matches and no longer rule that contains it does. All of it is one projection of
DataFrame functions: no shuffle, no Python.

Defined cases: null and empty texts have no sentences and no licences; a sentence that is repeated counts
where it first stands; repeated documents and null keys each get a row; no documents give no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other known sentences that may stand between two of a rule's.
GAP = 3
SENTENCE_END = r"[.!?;:]+\s+|\n\s*\n"
#: Every known sentence has one of these words.
WORDS = ("licen", "copyright", "permission", "warrant", "spdx", "redistribut", "public domain", "gnu ", "provided that", "liab", "rights reserved", "released under", "mpl was not")
#: The words in a text as it stands, where comment marks and line ends may part them.
LIKELY = "|".join(w.replace(" ", "[^a-z0-9]+") for w in WORDS)

# Wording of public licences, normalised as ``normalised`` does.
FIXED = {
    "all-rights": "all rights reserved",
    "mit-name": "the mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-v": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-1.1": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "gnu-purpose": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "epl-1.0": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc0": "this work is dedicated to the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
CC_TERMS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("2 0", "2 5", "3 0", "4 0")
#: What a GNU notice calls its work.
WORKS = ("program", "library", "file", "software")
#: The third clause of BSD-3-Clause names a holder, which is put aside.
HOLDER, ANY_HOLDER = "^neither the name of .* nor the names of", "neither the name of a holder nor the names of"
GNU = {"gpl": "general public license", "lgpl": "lesser general public license", "agpl": "affero general public license"}
SPDX = ("mit", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 3 0 only", "agpl 3 0 only", "epl 1 0", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "unlicense")


def _known() -> tuple[dict[str, str], dict[str, list[str]]]:
    """name -> normalised sentence; licence -> names of one rule. Longer rules are made of several sentences."""
    known, rules = dict(FIXED), {}
    for v in ("1 1", "2 0"):
        for k, verb in enumerate(("licensed under the apache license version", "this work is licensed under the apache license version", "released under the apache license version")):
            known[f"apache-{v}-{k}"] = f"{verb} {v}"
            rules[f"Apache-{v.replace(' ', '.')}/{k}"] = [f"apache-{v}-{k}"]
        for k, verb in enumerate(("licensed under the apache license version", "the asf licenses this file to you under the apache license version")):
            known[f"apache-{v}-notice-{k}"] = f"{verb} {v} the license"
            rules[f"Apache-{v.replace(' ', '.')}/notice/{k}"] = [f"apache-{v}-notice-{k}", "apache-use"]
            rules[f"Apache-{v.replace(' ', '.')}/full/{k}"] = [f"apache-{v}-notice-{k}", "apache-use", "apache-copy", "apache-basis", "apache-see"]
    for w in WORKS:
        known[f"gnu-hope-{w}"] = f"this {w} is distributed in the hope that it will be useful but without any warranty"
    for short, long in GNU.items():
        for w in WORKS:
            known[f"{short}-received-{w}"] = f"you should have received a copy of the gnu {long} along with this {w}"
        known[f"{short}-terms"] = f"you can redistribute it and or modify it under the terms of the gnu {long} as published by the free software foundation"
    for v in ("2", "2 1", "3"):
        known[f"gnu-{v}-later"] = f"either version {v} of the license or at your option any later version"
        known[f"gnu-{v}-only"] = f"version {v} of the license"
        # The version stands in a sentence of its own after "Foundation;", in the same one after "Foundation,".
        for (short, long), (which, name) in product(GNU.items(), (("later", "-or-later"), ("only", ""))):
            own = f"{short.upper()}-{v.replace(' ', '.')}{name}"
            known[f"{short}-{v}-terms-{which}"] = f"{known[f'{short}-terms']} {known[f'gnu-{v}-{which}']}"
            rules[f"{own}/notice/one"] = [f"{short}-{v}-terms-{which}"]
            rules[f"{own}/notice/two"] = [f"{short}-terms", f"gnu-{v}-{which}"]
    for (short, long), v in product(GNU.items(), ("2", "2 1", "3")):
        for k, verb in enumerate(("this work is licensed under the gnu", "licensed under the gnu", "released under the gnu", "this program is licensed under the gnu")):
            known[f"{short}-{v}-{k}"] = f"{verb} {long} version {v}"
            rules[f"{short.upper()}-{v.replace(' ', '.')}/{k}"] = [f"{short}-{v}-{k}"]
            for w in WORKS:
                rules[f"{short.upper()}-{v.replace(' ', '.')}/{k}/full/{w}"] = [f"{short}-{v}-{k}", f"gnu-hope-{w}", "gnu-purpose", f"{short}-received-{w}"]
    for t, v in product(CC_TERMS, CC_VERSIONS):
        name = f"CC-{t.replace(' ', '-').upper()}-{v.replace(' ', '.')}"
        for k, verb in enumerate(("licensed under cc", "this work is licensed under cc", "released under cc", "licensed under a cc")):
            known[f"cc-{t}-{v}-{k}"] = f"{verb} {t} {v}"
            rules[f"{name}/{k}"] = [f"cc-{t}-{v}-{k}"]
    for s in SPDX:
        known[f"spdx-{s}"] = f"spdx license identifier {s}"
        rules[f"SPDX:{s.replace(' ', '-')}/0"] = [f"spdx-{s}"]
    endorsed = "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    # After "Inc." only the clause's rest is a sentence.
    for h, begins in (("whole", "neither the name of a holder nor"), ("rest", "nor")):
        known[f"bsd-names-{h}"] = f"{begins} {endorsed}"
        rules[f"BSD-3-Clause/full/{h}"] = ["bsd-grant", "bsd-source", "bsd-binary", f"bsd-names-{h}", "bsd-warranty"]
    rules |= {
        "MIT/name": ["mit-name"],
        "MIT/released": ["mit-released"],
        "MIT/licensed": ["mit-licensed"],
        "MIT/full": ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"],
        "MIT/named": ["mit-name", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"],
        "MIT/grant": ["mit-grant", "mit-notice"],
        "ISC/full": ["isc-grant"],
        "BSD-2-Clause/full": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"],
        "MPL-2.0/header": ["mpl-subject"],
        "MPL-2.0/notice": ["mpl-v", "mpl-copy"],
        "MPL-2.0/notice-s": ["mpl-v", "mpl-copy-s"],
        "MPL-1.1/notice": ["mpl-1.1"],
        "EPL-1.0/notice": ["epl-1.0"],
        "EPL-2.0/notice": ["epl-2.0"],
        "CC0-1.0/dedication": ["cc0"],
        "Unlicense/full": ["unlicense"],
        "Proprietary/reserved": ["all-rights"],
    }
    return known, rules


KNOWN, RULES = _known()
NAMES = list(KNOWN)
NUMBER = {name: i + 1 for i, name in enumerate(NAMES)}


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), HOLDER, ANY_HOLDER)


def rule_pattern(names: list[str]) -> str:
    """Over sentence numbers, each with a space before and after."""
    return " " + rf" (?:[0-9]+ ){{0,{GAP}}}".join(str(NUMBER[n]) for n in names) + " "


def sentence_ids(text: Column) -> Column:
    """Array of sentence numbers in the order in which the sentences first stand."""
    pieces = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, SENTENCE_END)))
    listed = F.array(*(F.lit(KNOWN[n]) for n in NAMES))
    # Normalised once each; only pieces with one of the words are looked at.
    likely = F.filter(pieces, lambda p: F.lower(p).rlike(LIKELY))
    found = F.transform(likely, lambda p: F.struct(F.call_function("instr", text, p).alias("at"), F.array_position(listed, normalised(p)).cast("int").alias("id")))
    first = F.array_sort(F.filter(found, lambda x: x["id"] > 0))
    return F.array_distinct(F.transform(first, lambda x: x["id"]))


def recognise(ids: Column) -> Column:
    """Sorted licence names whose rules match ``ids`` and lie in no longer matching rule."""
    said = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(rule_pattern(names)).alias("pattern"), F.array(*(F.lit(o) for o in _larger(r))).cast("array<string>").alias("larger")) for r, names in RULES.items()))
    hits = F.filter(rules, lambda r: F.call_function("rlike", said, r["pattern"]))
    names = F.transform(hits, lambda r: r["rule"])
    most = F.filter(hits, lambda r: ~F.arrays_overlap(r["larger"], names))
    return F.array_sort(F.array_distinct(F.transform(most, lambda r: F.substring_index(r["rule"], "/", 1))))


def _larger(rule: str) -> list[str]:
    return [o for o, names in RULES.items() if set(RULES[rule]) < set(names)]


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids (array of numbers of known sentences), licences (array of names)."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    likely = F.lower(own).rlike(LIKELY)
    ids = docs.select(key, F.when(likely, sentence_ids(own)).otherwise(F.array().cast("array<int>")).alias("sentence_ids"))
    return ids.select(key, "sentence_ids", F.when(F.size("sentence_ids") > 0, recognise(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")).alias("licences"))


def license_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``op10``: the digest of ``scan``."""
    found = scan(docs, key=key, text=text)
    return found.select(key, F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({NUMBER[n]}, {quoted(KNOWN[n])})" for n in NAMES)
    rules = ", ".join(f"({quoted(r)}, {quoted(r.split('/')[0])}, {quoted(rule_pattern(n))}, [{', '.join(map(quoted, _larger(r)))}]::VARCHAR[])" for r, n in RULES.items())
    return rf"""
WITH k(id, sentence) AS (VALUES {known}),
r(rule, licence, pattern, larger) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
p AS (SELECT n, t, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '[.!?;:]+\s+|
\s*
')))) AS piece FROM d),
f AS (SELECT n, id, min(instr(t, piece)) AS place FROM p JOIN k ON sentence = regexp_replace(trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')), '{HOLDER}', '{ANY_HOLDER}') GROUP BY n, id),
s AS (SELECT n, count(*) AS n_sentences, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place, id) AS ids, ' ' || string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place, id) || ' ' AS said FROM f GROUP BY n),
h AS (SELECT n, rule, licence, larger FROM s JOIN r ON regexp_matches(said, pattern)),
g AS (SELECT n, list(rule) AS rules FROM h GROUP BY n),
l AS (SELECT n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM h JOIN g USING (n) WHERE NOT list_has_any(larger, rules) GROUP BY n)
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM d LEFT JOIN s USING (n) LEFT JOIN l USING (n)
"""
