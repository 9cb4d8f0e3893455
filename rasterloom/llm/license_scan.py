"""Licence scan by sentence rules, with DataFrame functions only.

A text is normalised (lower case, letters, digits and the dots of version numbers, single
spaces, marks for line feeds and punctuation) and searched for known licence sentences. A
sentence starts and ends at a line feed, at punctuation or at an end of the text; within
it may stand line feeds, ``:`` and ``;``, so that wrapped notices are found. Known are the
sentences of `SENTENCES`, `NOTICES` and the GNU headers, as they stand; every sentence of
the form "[this work is] licensed under [the] NAME [or later] [see license]" over all names of
`licence_names()`; and SPDX tags, of which an expression gives an identifier for each licence.

The identifiers found, in text order, are matched against ordered rules: a
rule is a sequence of sentence identifiers, which must follow one another among the
identifiers of the text. Rules stand from specific to general; at each place the first
rule that fits claims the sentences, so that a general rule only sees what is left.

Tables of sentences, names and rules are fixed values and small; they travel in the plan.

Defined results: null and empty texts have no licence; a sentence counts each time it
occurs; very long texts are scanned whole; an empty table gives an empty one and repeated rows
are scanned each; other columns pass through, but for
`sentence_ids`, `rules` and `licences`, which are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of licence notices and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-condition",
    "the software is provided as is without warranty of any kind": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-free",
    "under the terms of the gnu general public license version 3": "gpl3-terms",
    "licensed under cc by nc 4.0": "ccbync-notice",
    "licensed under cc by 4.0": "ccby-notice",
    "licensed under cc by sa 4.0": "ccbysa-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "all rights reserved": "reserved",
}

# Sentences of the licences' standard notices, in full.
NOTICES = {
    "licensed under the apache license version 2.0 the license": "apache2-notice",
    "apache license version 2.0 january 2004": "apache2-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
    "to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed": "as-is",
    "gnu general public license version 3 29 june 2007": "gpl3-notice",
    "gnu general public license version 2 june 1991": "gpl2-notice",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3.0-notice",
    "gnu lesser general public license version 2.1 february 1999": "lgpl-2.1-notice",
    "gnu affero general public license version 3 19 november 2007": "agpl-3.0-notice",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "as-is",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0": "mpl-2.0-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0": "mpl-2.0-notice",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-notice",
    "this font software is licensed under the sil open font license version 1.1": "ofl-1.1-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl-2.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0": "epl-1.0-notice",
    "the person who associated a work with this deed has dedicated the work to the public domain": "cc0-notice",
}

#: Headers of the GNU licences: the works they name, and how they name the version.
GNU_WORKS = ("this program", "this library", "this software", "this file")
GNU_VERSIONS = ("either version {} of the license or at your option any later version", "version {} of the license", "version {} only", "version {}")

# Licences with versions, by the names they go by; 2.0 is also called 2.
VERSIONED = {
    "AGPL": (("gnu affero general public license", "gnu agpl", "agpl"), ("1.0", "3.0")),
    "Apache": (("apache license", "apache software license", "apache"), ("1.0", "1.1", "2.0")),
    "APSL": (("apple public source license", "apsl"), ("1.0", "1.1", "1.2", "2.0")),
    "Artistic": (("artistic license", "perl artistic license"), ("1.0", "2.0")),
    "BSL": (("boost software license", "boost license"), ("1.0",)),
    "CC-BY": (("cc by", "creative commons attribution"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "CC-BY-NC": (("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "CC-BY-NC-ND": (("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("2.0", "2.5", "3.0", "4.0")),
    "CC-BY-NC-SA": (("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "CC-BY-ND": (("cc by nd", "creative commons attribution noderivatives"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "CC-BY-SA": (("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "CC0": (("cc0", "creative commons zero"), ("1.0",)),
    "CDDL": (("common development and distribution license", "cddl"), ("1.0", "1.1")),
    "CECILL": (("cecill free software license", "cecill"), ("1.0", "2.0", "2.1")),
    "CPL": (("common public license", "cpl"), ("1.0",)),
    "EPL": (("eclipse public license", "epl"), ("1.0", "2.0")),
    "EUPL": (("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2")),
    "GFDL": (("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3")),
    "GPL": (("gnu general public license", "gnu gpl", "gpl"), ("1.0", "2.0", "3.0")),
    "LGPL": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    "LPPL": (("latex project public license", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
    "MPL": (("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    "MulanPSL": (("mulan permissive software license", "mulan psl"), ("1.0", "2.0")),
    "ODbL": (("open database license", "odbl"), ("1.0",)),
    "OFL": (("sil open font license", "open font license", "ofl"), ("1.0", "1.1")),
    "OSL": (("open software license", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    "PHP": (("php license",), ("3.0", "3.01")),
    "ZPL": (("zope public license", "zpl"), ("1.1", "2.0", "2.1")),
}

# Licences without versions, and the names they go by.
UNVERSIONED = {
    "0BSD": ("zero clause bsd", "bsd zero clause", "0bsd"),
    "Beerware": ("beerware", "beer ware"),
    "BSD": ("bsd", "bsd style"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"),
    "BSD-4-Clause": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "curl": ("curl",),
    "HPND": ("historical permission notice and disclaimer", "hpnd"),
    "ISC": ("isc",),
    "MIT": ("mit", "expat", "x11 mit"),
    "MIT-0": ("mit no attribution", "mit 0"),
    "NCSA": ("university of illinois ncsa open source", "ncsa"),
    "PostgreSQL": ("postgresql",),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public"),
    "X11": ("x11",),
    "Zlib": ("zlib", "zlib libpng"),
}

# Ordered rules (licence, sentence identifiers that follow one another).
RULES = [
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy", "apache2-basis")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance")),
    ("GPL-3.0", ("gpl-free", "gpl3-terms")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "as-is")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant", "as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("0BSD", ("0bsd-grant", "as-is")),
    ("MPL-2.0", ("mpl-form", "mpl-2.0-notice")),
]

# Licences that one sentence alone tells; the rules of one sentence come last.
ALONE = {
    "mit-grant": "MIT", "bsd-grant": "BSD", "isc-grant": "ISC", "0bsd-grant": "0BSD", "mpl-form": "MPL-2.0", "apache2-notice": "Apache-2.0", "mit-notice": "MIT",
    "gpl3-notice": "GPL-3.0", "gpl3-terms": "GPL-3.0", "gpl2-notice": "GPL-2.0", "ccbync-notice": "CC-BY-NC-4.0", "ccby-notice": "CC-BY-4.0", "ccbysa-notice": "CC-BY-SA-4.0",
    "reserved": "Proprietary",
}

# What stands around a licence's name in a notice.
SUBJECT = r"(?:(?:this|the) (?:work|software|program|project|library|file|code|source code|package|module|repository|document|documentation|content|font|dataset) (?:is|are) )?"
VERB = r"(?:dual )?(?:licensed|released|distributed|published|provided|(?:made )?available) under (?:the )?(?:terms of (?:the )?)?"
TAIL = r"(?: international| unported| generic| universal)?(?: public)?(?: licen[sc]e)?(?: only| or later| or any later version| or at your option any later version)?(?: see (?:the )?licen[sc]e(?: file)?(?: for (?:more )?(?:details|information))?)?"


def gnu_headers() -> dict[str, str]:
    """Sentences of the GNU licences' headers, by work, licence and version."""
    found = {}
    for spdx, kind, version in (("gpl2", "general", "2"), ("gpl3", "general", "3"), ("lgpl-2.0", "library general", "2"), ("lgpl-2.1", "lesser general", "2.1"), ("lgpl-3.0", "lesser general", "3"), ("agpl-3.0", "affero general", "3")):
        for work in GNU_WORKS:
            for form in GNU_VERSIONS:
                terms = f"{work} is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation "
                found[terms + form.format(version)] = f"{spdx}-notice"
    return found


def licence_names() -> dict[str, str]:
    """Normalised names of licences, with and without versions, and the licences."""
    found = {name: licence for licence, names in UNVERSIONED.items() for name in names}
    for family, (stems, versions) in VERSIONED.items():
        for stem in stems:
            found[stem] = family
            for version in versions:
                for v in {version, version.removesuffix(".0")}:
                    found |= {way.format(stem, v): f"{family}-{version}" for way in ("{} version {}", "{} {}", "{} v{}", "{}v{}")}
    return found


def spdx_names() -> dict[str, str]:
    """Normalised SPDX identifiers and the licences."""
    known = [*UNVERSIONED, *(f"{family}-{v}" for family, (_, versions) in VERSIONED.items() for v in versions)]
    return {name.lower().replace("-", " "): name for name in known}


def sentences() -> dict[str, str]:
    """All sentences that are known as they stand, and their identifiers."""
    return SENTENCES | NOTICES | gnu_headers()


def single_rules() -> dict[str, str]:
    """Identifiers that are rules of their own, and the licences."""
    licences = {*licence_names().values(), *spdx_names().values()}
    return ALONE | {f"{x.lower()}-{kind}": x for x in licences for kind in ("notice", "spdx")}


#: Words that every known sentence has some of: only texts with them are normalised.
MARKS = r"(?i)licen|permission|warrant|redistribut|rights\W+reserved|public\W+domain|spdx|\bmpl\b|advertising\W+materials|(released|distributed|published|provided|available)\W+under"

#: Marks in normalised text: ``|`` for ``.``, ``!`` or ``?`` before white space, where a
#: sentence ends; ``~`` for a line feed, ``;`` or ``:``, where it can end or go on.
SENTENCE_END, LINE_END = r"[.!?;:]*[.!?][.!?;:]*(?=\s|$)", r"\n|[;:]+(?=\s|$)"


def normalise(text: Column) -> Column:
    """The text's words and marks, with single spaces, as `` | words ~ words | ``."""
    kept = F.regexp_replace(F.lower(text), r"[|~]", " ")
    kept = F.regexp_replace(F.regexp_replace(kept, SENTENCE_END, " | "), LINE_END, " ~ ")
    kept = F.regexp_replace(kept, r"[^a-z0-9.|~]+|\.(?!\d)", " ")
    return F.concat(F.lit(" | "), F.trim(F.regexp_replace(kept, " +", " ")), F.lit(" | "))


def _any(words: list[str]) -> str:
    """One of the texts, the longest that fits."""
    return "(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=len, reverse=True)) + ")"


#: "licensed under NAME": group 1 is the name. An SPDX tag: group 1 is the expression.
FRAME = f"{SUBJECT}{VERB}({_any([*licence_names()])}){TAIL}"
TAG = f"spdx(?: license identifier)? ({_any([*spdx_names()])}(?: only| or later)?(?: (?:or|and) {_any([*spdx_names()])}(?: only| or later)?)*)"


def _pattern() -> str:
    """Known sentences between two marks, the longest first; spaces may hold line ends."""
    frame = re.compile(FRAME)
    plain = [s for s in sentences() if not frame.fullmatch(s)]  # those of a longer form than a frame
    whole = "|".join([_any(plain), re.sub(r"\((?!\?)", "(?:", FRAME), re.sub(r"\((?!\?)", "(?:", TAG)])
    return r"(?<=[|~] )(" + whole.replace(" ", "(?: ~)* ") + r")(?= [|~])"


def _map(table: dict[str, str]) -> Column:
    """A table as a literal map."""
    return F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in table.items())), F.lit("\n"), F.lit("="))


def _ids(sentence: Column) -> Column:
    """Identifiers of a known sentence: several for an SPDX expression, else one."""
    expression = F.split(F.regexp_replace(sentence, "^spdx( license identifier)? ", ""), " (?:or|and) (?!later)")
    tags = F.transform(expression, lambda x: F.concat(F.lower(F.try_element_at(_map(spdx_names()), F.regexp_replace(x, " (only|or later)$", ""))), F.lit("-spdx")))
    name = F.regexp_extract(sentence, f"^{FRAME}$", 1)
    notice = F.concat(F.lower(F.try_element_at(_map(licence_names()), name)), F.lit("-notice"))
    return F.when(sentence.startswith("spdx "), tags).otherwise(F.array(F.coalesce(F.try_element_at(_map(sentences()), sentence), notice)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    found = F.flatten(F.transform(F.regexp_extract_all(normalise(text), F.lit(_pattern())), lambda s: _ids(F.replace(s, F.lit(" ~"), F.lit("")))))
    return F.when(text.rlike(MARKS), found).otherwise(F.array().cast("array<string>"))


def _rules() -> list[tuple[str, tuple[str, ...]]]:
    return RULES + [(licence, (one,)) for one, licence in single_rules().items()]


def matches(ids: Column) -> Column:
    """Rules met: array of struct(rule, licence), in rule order, with what each claims."""
    # identifiers joined as |a|b|; a claimed stretch becomes #, which no rule matches
    line = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(name).alias("licence"), F.lit("".join(f"|{x}|" for x in seq)).alias("seq")) for i, (name, seq) in enumerate(_rules())])
    start = F.struct(line.alias("rest"), F.array().cast("array<struct<rule:int,licence:string,times:int>>").alias("hits"))

    def step(acc: Column, rule: Column) -> Column:
        times = ((F.length(acc["rest"]) - F.length(F.replace(acc["rest"], rule["seq"], F.lit("")))) / F.length(rule["seq"])).cast("int")
        hit = F.array(F.struct(rule["rule"].alias("rule"), rule["licence"].alias("licence"), times.alias("times")))
        return F.struct(
            F.replace(acc["rest"], rule["seq"], F.lit("#")).alias("rest"),
            F.when(times > 0, F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"),
        )

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step, lambda a: a["hits"])).otherwise(
        F.array().cast("array<struct<rule:int,licence:string,times:int>>")
    )


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `sentence_ids`, `rules` and `licences` (distinct names, sorted)."""
    out = docs.withColumn("sentence_ids", sentence_ids(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("rules", matches(F.col("sentence_ids")))
    return out.withColumn("licences", F.array_sort(F.array_distinct(F.transform("rules", lambda r: r["licence"]))))


def _oracle() -> str:
    """The same tables in SQL: a text's pieces between marks, and all runs of pieces that
    make a known sentence; of runs that overlap, the first and longest stays."""
    quoted = lambda pairs: ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())
    plain = re.sub(r"\((?!\?)", "(?:", TAG)
    longest = max(len(s.split(" ")) for s in sentences())
    line, steps, count, names_hit = "line", [], [], []
    for i, (licence, seq) in enumerate(RULES):
        s = "".join(f"|{x}|" for x in seq)
        steps.append(f"r{i} AS (SELECT *, replace({line}, '{s}', '#') AS l{i}, CAST((length({line}) - length(replace({line}, '{s}', ''))) / {len(s)} AS INT) AS n{i} FROM {'d' if i == 0 else f'r{i - 1}'})")
        line = f"l{i}"
        count.append(f"n{i}")
        names_hit.append(f"CASE WHEN n{i} > 0 THEN '{licence}' END")
    return rf"""
WITH RECURSIVE exact(s, id) AS (VALUES {quoted(sentences())}), name(s, licence) AS (VALUES {quoted(licence_names())}),
tag(s, licence) AS (VALUES {quoted(spdx_names())}), alone(id, licence) AS (VALUES {quoted(single_rules())}),
a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[|~]', ' ', 'g'), '[.!?;:]*[.!?][.!?;:]*([ \t\n\x0B\f\r]|$)', ' | \1', 'g') AS t FROM documents
      WHERE regexp_matches(text, '{MARKS.removeprefix("(?i)")}', 'i')),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n|[;:]+([ \t\n\x0B\f\r]|$)', ' ~ \1', 'g'), '[^a-z0-9.|~]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\.+(\.[0-9])', ' \1', 'g'), '\.+([^0-9.]|$)', ' \1', 'g') AS t FROM b),
g AS (SELECT doc_id, unnest(string_split(t, '|')) AS t, generate_subscripts(string_split(t, '|'), 1) AS g FROM c),
p AS (SELECT doc_id, g, [x FOR x IN [trim(regexp_replace(y, ' +', ' ', 'g')) FOR y IN string_split(t, '~')] IF x <> ''] AS pieces FROM g),
k AS (SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM p),
w AS (SELECT doc_id, g, k, unnest(range(k, least(len(pieces), k + {longest}) + 1)) AS e, pieces FROM k
      WHERE regexp_matches(pieces[k], '^({"|".join(sorted({s.split(" ")[0] for s in sentences()} | set("this the dual licensed released distributed published provided made available spdx".split())))})( |$)')),
x AS (SELECT doc_id, g, k, e, array_to_string(pieces[k:e], ' ') AS s FROM w),
f AS (SELECT *, regexp_extract(s, '^{FRAME}$', 1) AS name, CASE WHEN regexp_matches(s, '^{plain}$') THEN
        string_split(regexp_replace(replace(regexp_replace(s, '^spdx( license identifier)? ', ''), ' or later', ' orlater'), ' (or|and) ', '/', 'g'), '/') END AS tags FROM x),
u AS (SELECT doc_id, g, k, e, s, name, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth FROM f WHERE tags IS NOT NULL
      UNION ALL SELECT doc_id, g, k, e, s, name, NULL, 1 FROM f WHERE tags IS NULL),
i AS (SELECT doc_id, g, k, e, nth, coalesce(lower(tag.licence) || '-spdx', exact.id, lower(name.licence) || '-notice') AS id FROM u
      LEFT JOIN tag ON tag.s = regexp_replace(u.tag, ' (only|orlater)$', '') LEFT JOIN exact ON exact.s = u.s LEFT JOIN name ON name.s = u.name),
h AS (SELECT doc_id, g, k, e, list(id ORDER BY nth) AS ids FROM i WHERE id IS NOT NULL GROUP BY ALL),
l AS (SELECT doc_id, g, k, max(e) AS e, arg_max(ids, e) AS ids FROM h GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, k) AS rn FROM l),
v AS (SELECT doc_id, rn, g, e, k, ids, true AS kept FROM o WHERE rn = 1
      UNION ALL SELECT o.doc_id, o.rn, o.g, CASE WHEN o.g > v.g OR o.k > v.e THEN o.e ELSE v.e END, o.k, o.ids, o.g > v.g OR o.k > v.e
      FROM v JOIN o ON o.doc_id = v.doc_id AND o.rn = v.rn + 1),
j AS (SELECT doc_id, string_agg(array_to_string(ids, '||'), '||' ORDER BY rn) AS ids, sum(len(ids)) AS n FROM v WHERE kept GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, CASE WHEN n > 0 THEN '|' || ids || '|' ELSE '' END AS line FROM documents LEFT JOIN j USING (doc_id)),
{", ".join(steps)},
one AS (SELECT doc_id, count(*) AS n, list(DISTINCT licence) AS licences FROM (SELECT doc_id, unnest(string_split(replace({line}, '#', '|'), '|')) AS id FROM r{len(RULES) - 1}) JOIN alone USING (id) GROUP BY doc_id)
SELECT doc_id, n_sentences::BIGINT AS n_sentences, ({" + ".join(count)} + coalesce(one.n, 0))::BIGINT AS n_matches,
       coalesce(array_to_string(list_sort(list_distinct(list_concat([x FOR x IN [{", ".join(names_hit)}] IF x IS NOT NULL], coalesce(one.licences, [])))), ','), '') AS licences
FROM r{len(RULES) - 1} LEFT JOIN one USING (doc_id)
"""


ORACLE = _oracle()
