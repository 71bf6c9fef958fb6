"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut into sentences, at line ends and, a second time, with single line ends taken as spaces (wrapped
licence texts). Sentences are normalised (A-Z lower-cased, everything but letters, digits, ``.`` and
``+`` to one space) and looked up in a fixed table of known licence sentences. The identifiers found,
in text order, are matched against ordered rules; a rule's sentences are used up by its match, so
that a whole licence is not reported again as a mere reference. For the query, as for its SQL, the reading with more used
sentences stands; on a tie, the one by lines. ``scan`` also gives what either reading finds.

Defined results: null, empty and wordless texts have no licence; repeated rows are scanned apart;
known sentences that no rule uses are reported as ``unmatched``; other columns are not read. A row
is worked on alone, without a shuffle; the tables are literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table, text_or_empty

# Normalised sentences of public licence texts and notices, with our identifiers.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-title-abbr": "the mit license mit",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-title": "apache license",
    "apache-version": "version 2.0 january 2004",
    "apache-licensed": "licensed under the apache license version 2.0",
    "apache-the-license": "licensed under the apache license version 2.0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-language": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "licensed under the bsd license",
    "bsd-2-licensed": "licensed under the bsd 2 clause license",
    "bsd-3-licensed": "licensed under the bsd 3 clause license",
    "gpl-redistribute-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-redistribute-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-work-2": "this work is licensed under the gnu general public license version 2",
    "gpl-work-3": "this work is licensed under the gnu general public license version 3",
    "gpl-licensed-2": "licensed under the gnu general public license version 2",
    "gpl-licensed-3": "licensed under the gnu general public license version 3",
    "lgpl-licensed-21": "licensed under the gnu lesser general public license version 2.1",
    "lgpl-licensed-3": "licensed under the gnu lesser general public license version 3",
    "agpl-licensed-3": "licensed under the gnu affero general public license version 3",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl-licensed": "licensed under the mozilla public license version 2.0",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-nd": "licensed under cc by nd 4.0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0-waive": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-licensed": "licensed under cc0 1.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "public-domain": "this work is in the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2.0",
    "spdx-bsd-3": "spdx license identifier bsd 3 clause",
    "spdx-gpl-2": "spdx license identifier gpl 2.0 only",
    "spdx-gpl-3": "spdx license identifier gpl 3.0 or later",
    "reserved": "all rights reserved",
}

#: In order; the sentences of a rule must follow each other among the known ones.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-the-license", "apache-compliance", "apache-copy", "apache-basis", "apache-language"]),
    ("Apache-2.0", ["apache-licensed", "apache-compliance", "apache-copy", "apache-basis", "apache-language"]),
    ("Apache-2.0", ["apache-title", "apache-version"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-redistribute-2", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-redistribute-3", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    *[("Apache-2.0", [s]) for s in ("apache-the-license", "apache-licensed", "spdx-apache")],
    *[("MIT", [s]) for s in ("mit-released", "mit-licensed", "mit-project", "mit-title-abbr", "mit-title-the", "mit-title", "spdx-mit")],
    ("ISC", ["isc-title"]),
    ("BSD-2-Clause", ["bsd-2-licensed"]),
    *[("BSD-3-Clause", [s]) for s in ("bsd-3-licensed", "spdx-bsd-3")],
    ("BSD", ["bsd-licensed"]),
    *[("GPL-2.0", [s]) for s in ("gpl-work-2", "gpl-licensed-2", "spdx-gpl-2")],
    *[("GPL-3.0", [s]) for s in ("gpl-work-3", "gpl-licensed-3")],
    ("GPL-3.0-or-later", ["spdx-gpl-3"]),
    ("LGPL-2.1", ["lgpl-licensed-21"]),
    ("LGPL-3.0", ["lgpl-licensed-3"]),
    ("AGPL-3.0", ["agpl-licensed-3"]),
    *[("MPL-2.0", [s]) for s in ("mpl-subject", "mpl-licensed")],
    *[("CC-BY-4.0", [s]) for s in ("cc-by", "cc-by-work")],
    *[("CC-BY-SA-4.0", [s]) for s in ("cc-by-sa", "cc-by-sa-work")],
    *[("CC-BY-NC-4.0", [s]) for s in ("cc-by-nc", "cc-by-nc-work")],
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    *[("CC0-1.0", [s]) for s in ("cc0-waive", "cc0-licensed")],
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["reserved"]),
]

#: Every known sentence has one of these words, also before it is normalised: any run of signs can stand between two.
HINT = r"(?i)licen[sc]e|copyright|permi|warrant|redistribut|reserved|public[^a-z]+domain|liab|january[^a-z]+2004|free[^a-z]+software"
_END = r"([.;:!?])[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sequence_of(text: Column) -> Column:
    """Identifiers of the known sentences, in text order, as ``<a><b>``."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    plain = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9.+\n]+", " ")
    parts = F.transform(F.split(plain, "\n"), lambda s: F.regexp_replace(s, "^[ .]+|[ .]+$", ""))
    named = F.transform(F.filter(parts, lambda s: F.length(s) >= 11), lambda s: F.element_at(known, s))
    return F.array_join(F.transform(F.filter(named, lambda i: i.isNotNull()), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")


def by_rules(sequence: Column) -> Column:
    """``(rest, found)``: what no rule uses, and the licences in the rules' order."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{s}>" for s in r)).alias("pattern")) for n, r in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda a, r: F.when(F.contains(a["rest"], r["pattern"]), F.struct(F.replace(a["rest"], r["pattern"], F.lit("|")).alias("rest"), F.concat(a["found"], F.array(r["name"])).alias("found"))).otherwise(a)
    return F.when(sequence != "", F.aggregate(rules, start, step)).otherwise(start)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``sentences`` (number of known ones), ``sequence``, ``licenses``, ``unmatched``, and ``either``: the licences of both readings, those of ``licenses`` first."""
    text = text_or_empty(text_col)
    ended = F.regexp_replace(F.col("_ls_text"), _END, "$1\n")
    wrapped = F.regexp_replace(F.regexp_replace(F.col("_ls_text"), "([^\n])\n(?=[^\n])", "$1 "), _END, "$1\n")
    found = df.withColumn("_ls_text", F.when(F.regexp_like(text, F.lit(HINT)), text).otherwise(""))
    found = found.withColumns({"_ls_line": sequence_of(ended), "_ls_wrap": sequence_of(wrapped)}).withColumns({"_ls_a": by_rules(F.col("_ls_line")), "_ls_b": by_rules(F.col("_ls_wrap"))})
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))
    used = lambda s, r: marks(F.col(s)) - marks(F.col(r)["rest"])
    wrap = used("_ls_wrap", "_ls_b") > used("_ls_line", "_ls_a")
    sequence, verdict = F.when(wrap, F.col("_ls_wrap")).otherwise(F.col("_ls_line")), F.when(wrap, F.col("_ls_b")).otherwise(F.col("_ls_a"))
    found = found.withColumns({"_ls_s": sequence, "_ls_v": verdict})
    out = {"sentences": marks(F.col("_ls_s")).cast("long"), "sequence": F.col("_ls_s"), "licenses": F.array_distinct(F.col("_ls_v")["found"]), "unmatched": marks(F.col("_ls_v")["rest"]).cast("long"), "either": F.array_distinct(F.concat(F.col("_ls_v")["found"], F.col("_ls_a")["found"], F.col("_ls_b")["found"]))}
    return found.withColumns(out).drop("_ls_text", "_ls_line", "_ls_wrap", "_ls_a", "_ls_b", "_ls_s", "_ls_v")


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "sentences", "sequence", F.array_join("licenses", ",").alias("licenses"), "unmatched")


def _sql() -> str:
    values = ", ".join(f"('{s}', '<{i}>')" for i, s in SENTENCES.items())
    parts = [f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), k(s, i) AS (VALUES {values})"]
    ended = r"regexp_replace({}, '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g')"
    # RE2 has no look-ahead: twice, for lines of one character
    one = r"regexp_replace({}, '([^\n])\n([^\n])', '\1 \2', 'g')"
    wrapped = one.format(one.format("text"))
    for n, t in (("line", ended.format("text")), ("wrap", ended.format(wrapped))):
        plain = rf"regexp_replace(translate({t}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9.+\n]+', ' ', 'g')"
        parts.append(f"{n}_p AS (SELECT r, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT r, string_split({plain}, chr(10)) AS p FROM d))")
        parts.append(f"{n}_0 AS (SELECT r, coalesce(string_agg(k.i, '' ORDER BY pos), '') AS seq, coalesce(string_agg(k.i, '' ORDER BY pos), '') AS rest, '' AS found FROM {n}_p LEFT JOIN k ON regexp_replace({n}_p.s, '^[ .]+|[ .]+$', '', 'g') = k.s GROUP BY r)")
        for j, (name, rule) in enumerate(RULES):
            pattern = "".join(f"<{s}>" for s in rule)
            add = f"CASE WHEN contains(rest, '{pattern}') AND NOT contains(found || ',', ',{name},') THEN found || ',{name}' ELSE found END"
            parts.append(f"{n}_{j + 1} AS (SELECT r, seq, replace(rest, '{pattern}', '|') AS rest, {add} AS found FROM {n}_{j})")
    m, marks = len(RULES), "len({0}) - len(replace({0}, '<', ''))"
    used = lambda t: f"{marks.format(f'{t}.seq')} - ({marks.format(f'{t}.rest')})"
    pick = lambda c: f"CASE WHEN {used('b')} > {used('a')} THEN b.{c} ELSE a.{c} END"
    return (
        f"WITH {', '.join(parts)}, v AS (SELECT d.doc_id, {pick('seq')} AS seq, {pick('rest')} AS rest, {pick('found')} AS found FROM d JOIN line_{m} a USING (r) JOIN wrap_{m} b USING (r)) "
        f"SELECT doc_id, ({marks.format('seq')})::BIGINT AS sentences, seq AS sequence, substr(found, 2) AS licenses, ({marks.format('rest')})::BIGINT AS unmatched FROM v"
    )


OP6_SQL = _sql()
