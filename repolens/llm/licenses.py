"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences, these are normalised, and known ones get an identifier. The identifiers of a text, in order, are matched against rules, each a run of identifiers that names a licence. Rules are tried in their order; a run that matched is taken out before the next rule is tried, so longer rules come first and a sentence counts for one licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

#: Licence (SPDX), and its names in sentences such as "released under the ... licence", normalised, without article.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0 license"),
    "Apache-1.1": ("apache software license version 1.1", "apache license version 1.1"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gplv2", "gpl-2.0 license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gplv3", "gpl-3.0 license"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lgpl version 2.1", "lgpl v2.1", "lgpl-2.1 license"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl version 3", "lgpl v3", "lgpl-3.0 license"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl version 3", "agpl v3", "agplv3", "agpl-3.0 license"),
    "MIT": ("mit license", "mit licence", "mit open source license", "expat license"),
    "MIT-0": ("mit no attribution license", "mit-0 license"),
    "BSD-2-Clause": ("bsd 2-clause license", "bsd-2-clause license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3-clause license", "bsd-3-clause license", "new bsd license", "modified bsd license", "revised bsd license"),
    "BSD-4-Clause": ("bsd 4-clause license", "original bsd license"),
    "0BSD": ("zero-clause bsd license", "bsd zero clause license", "0bsd license"),
    "ISC": ("isc license", "isc licence"),
    "MPL-1.1": ("mozilla public license version 1.1", "mozilla public license 1.1"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "EPL-1.0": ("eclipse public license v1.0", "eclipse public license version 1.0", "eclipse public license - v 1.0"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license version 2.0"),
    "CDDL-1.0": ("common development and distribution license version 1.0", "cddl 1.0"),
    "CDDL-1.1": ("common development and distribution license version 1.1", "cddl 1.1"),
    "EUPL-1.2": ("european union public licence version 1.2", "eupl version 1.2", "eupl v1.2"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license"),
    "Artistic-1.0": ("artistic license 1.0", "artistic license version 1.0"),
    "Artistic-2.0": ("artistic license 2.0", "artistic license version 2.0"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Unlicense": ("unlicense", "unlicense license"),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl", "wtfpl license"),
    "PSF-2.0": ("python software foundation license", "python software foundation license version 2", "psf license"),
    "PHP-3.01": ("php license version 3.01", "version 3.01 of the php license"),
    "PostgreSQL": ("postgresql license", "postgresql licence"),
    "OFL-1.1": ("sil open font license version 1.1", "sil open font license"),
    "ODbL-1.0": ("open database license", "open database license odbl", "open data commons open database license"),
    "MS-PL": ("microsoft public license", "microsoft public license ms-pl"),
    "MS-RL": ("microsoft reciprocal license", "microsoft reciprocal license ms-rl"),
    "NCSA": ("university of illinois ncsa open source license", "ncsa open source license"),
    "Ruby": ("ruby license", "ruby s license"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "cc0", "creative commons zero v1.0 universal"),
    "CC-BY-3.0": ("cc by 3.0", "creative commons attribution 3.0 unported license"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-3.0": ("cc by-sa 3.0", "creative commons attribution-sharealike 3.0 unported license"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by-nc-nd 4.0", "creative commons attribution-noncommercial-noderivatives 4.0 international license"),
}

#: Further normalised sentences of licence notices and texts -> identifier. A sentence ends at a colon or semicolon, too.
TEXTS = {
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www.apache.org licenses license-2.0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "apache license version 2.0 january 2004": "ApacheTitle2",
    "this program is free software": "GPLProgram",
    "this library is free software": "LGPLLibrary",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLFree",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLFree",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPLFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPLFreeLater2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLFreeLater3",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPLFreeLater3",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPLOnly2",
    "either version 2 of the license or at your option any later version": "Later2",
    "either version 2.1 of the license or at your option any later version": "Later21",
    "either version 3 of the license or at your option any later version": "Later3",
    "version 2 of the license": "Only2",
    "version 3 of the license": "Only3",
    "version 2.0 january 2004": "ApacheTitle2",
    "version 2.0 january 2004 http www.apache.org licenses": "ApacheTitle2",
    "gnu general public license": "GPLName",
    "gnu lesser general public license": "LGPLName",
    "version 2 june 1991": "June1991",
    "version 3 29 june 2007": "June2007",
    "version 2.1 february 1999": "February1999",
    "version 3 19 november 2007": "November2007",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MITGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "MIT0Grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "NoLiability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDAdvert",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPLForm2",
    "this software is provided as-is without any express or implied warranty": "ZlibAsIs",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "boost software license - version 1.0 - august 17th 2003": "BoostTitle",
    "this is free and unencumbered software released into the public domain": "Unencumbered",
    "you just do what the fuck you want to": "WTFTerms",
    "this work is dedicated to the public domain": "PublicDomain",
    "this software is dedicated to the public domain": "PublicDomain",
    "this file is in the public domain": "PublicDomain",
    "this work is in the public domain": "PublicDomain",
    "this software is in the public domain": "PublicDomain",
    "released into the public domain": "PublicDomain",
}

#: Licence, and the run of identifiers that stands for it. The order counts; references by name (NAMES) and SPDX lines come after these.
RUNS = (
    ("GPL-2.0-or-later", ("GPLProgram", "GPLFree", "Later2")),
    ("GPL-3.0-or-later", ("GPLProgram", "GPLFree", "Later3")),
    ("GPL-2.0", ("GPLProgram", "GPLFree", "Only2")),
    ("GPL-3.0", ("GPLProgram", "GPLFree", "Only3")),
    ("GPL-2.0", ("GPLOnly2",)),
    ("LGPL-2.1-or-later", ("LGPLLibrary", "LGPLFree", "Later21")),
    ("LGPL-3.0-or-later", ("LGPLLibrary", "LGPLFree", "Later3")),
    ("LGPL-3.0-or-later", ("GPLProgram", "LGPLFree", "Later3")),
    ("AGPL-3.0-or-later", ("GPLProgram", "AGPLFree", "Later3")),
    ("GPL-2.0-or-later", ("GPLFree", "Later2")),
    ("GPL-3.0-or-later", ("GPLFree", "Later3")),
    ("GPL-2.0-or-later", ("GPLFreeLater2",)),
    ("GPL-3.0-or-later", ("GPLFreeLater3",)),
    ("AGPL-3.0-or-later", ("AGPLFree", "Later3")),
    ("AGPL-3.0-or-later", ("AGPLFreeLater3",)),
    ("GPL-2.0", ("GPLName", "June1991")),
    ("GPL-3.0", ("GPLName", "June2007")),
    ("LGPL-2.1", ("LGPLName", "February1999")),
    ("LGPL-3.0", ("LGPLName", "June2007")),
    ("AGPL-3.0", ("November2007",)),
    ("Apache-2.0", ("=Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheAsIs")),
    ("Apache-2.0", ("=Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheUrl")),
    ("Apache-2.0", ("=Apache-2.0", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheTitle2",)),
    ("MIT", ("MITGrant", "MITNotice", "AsIs", "NoLiability")),
    ("MIT", ("MITGrant", "MITNotice", "AsIs")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT-0", ("MIT0Grant", "AsIs")),
    ("ISC", ("ISCGrant",)),
    ("0BSD", ("ZeroGrant",)),
    ("BSD-4-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAdvert")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("MPL-2.0", ("MPLForm2",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("BSL-1.0", ("BoostTitle",)),
    ("Unlicense", ("Unencumbered",)),
    ("WTFPL", ("WTFTerms",)),
    ("Public-Domain", ("PublicDomain",)),
)

#: What references by name, and SPDX lines, are brought to; identifiers of both are = and the licence.
REFERENCE, SPDX = "licensed under ", "spdx-license-identifier "
#: Identifier of a sentence that names or grants a licence (LIKE) but isn't known.
UNKNOWN = "UNKNOWN"
FAMILIES = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
LATER = tuple(f"{x}-or-later" for x in FAMILIES)
#: Known sentences -> identifiers. SPDX names of the families carry a suffix, of which -only changes nothing.
SENTENCES = (
    TEXTS
    | {REFERENCE + name: f"={licence}" for licence, names in NAMES.items() for name in names}
    | {SPDX + x.lower(): f"={x}" for x in (*NAMES, *LATER)}
    | {f"{SPDX}{x.lower()}{end}": f"={x}{kind}" for x in FAMILIES for end, kind in (("-only", ""), ("+", "-or-later"))}
)
RULES = RUNS + tuple((x, (f"={x}",)) for x in (*NAMES, *LATER)) + ((UNKNOWN, (UNKNOWN,)),)

#: Words of which each known sentence holds one, whatever it is led by (a reference says that something is under a licence, or uses one): texts without them aren't cut. Each lies within a word, as lines are joined and white space is folded only when a text is cut.
TRIGGERS = ("licenc", "licens", "permission", "redistribut", "software", "dedicated", "public", "either", "copyright", "apache", "acknowledgement", "version", "fuck", "under", "use")
TRIGGER = "|".join(TRIGGERS)
#: Regular expressions of the cutting and the normalising, alike in Java and RE2: marks of comments at the beginnings of lines; SPDX lines; lines that go on after a comma or an opening bracket, or with a small letter, an opening mark or a word in capitals; stops; all that isn't kept.
LEADER = r"(^|\n)[ \t]*(?://+!?|#+!?|/?\*+/?|;+|--+|%+|<!--|\.\.|dnl\b)[ \t]*"
SPDX_LINE = r"(?i)SPDX-License-Identifier[ \t]*:[ \t]*([A-Za-z0-9.+\-()]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+\-()]+)*)"
JOIN_COMMA, JOIN_NEXT = r"[,(][ \t]*\r?\n[ \t]*", r"\r?\n[ \t]*([a-z(]|[A-Z][A-Z])"
STOP, OTHER = r"[.!?;:]+([ \t\r\n]|$)", r"[^a-z0-9.+\-\n]+"
#: The ways to say that something is under a licence, which become REFERENCE, and an end that says no more.
LEAD = r"^(?:(?:this|the|our|all) [a-z ]{2,40}? (?:is|are) )?(?:dual[ -])?(?:licensed|relicensed|released|distributed|published|available|made available) under (?:the terms (?:and conditions )?of )?(?:the |an |a )?"
TAIL = r"^(licensed under .+?)(?: the license| which (?:accompanies this distribution and )?is available at.*)$"
#: Other ways, which name a licence only if what follows is a known name: something is under it, or somebody uses it.
LOOSE, LOOSE_END = r"^(?:[a-z][a-z ]{1,40}? (?:is|are) under |we use )(?:the terms (?:and conditions )?of )?(?:the |an |a )?", r" (?:for|in) (?:this|our|the|all) [a-z ]{2,40}$"
#: What parts the licences of an expression or a reference, and an exception, which leaves the licence as it is.
CHOICE, EXCEPTION = " (?:or|and) ", " with .*$"
#: What a part may begin and end with, and the end that a name from SPDX doesn't have.
ARTICLE, PLURAL, CALLED = "^(?:either )?(?:the |an |a )?", "(licen[cs]e)s$", " licen[cs]e$"
LIKE = r"^(?:licensed under .*licen[cs]e|spdx-license-identifier |permission is hereby granted|redistribution and use in|permission to use copy)"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text. Marks of comments at the beginnings of lines go. A line ends a sentence, unless it ends in a comma or an opening bracket, or the next one goes on with a small letter, a bracket or a word in capitals; so do stops before white space. Of a sentence A-Z in lower case, digits and . + - stay, all else is a space; spaces and the marks . - go at both ends; the ways to say that something is under a licence become one."""
    t = F.regexp_replace(text, LEADER, "$1")
    t = F.regexp_replace(t, SPDX_LINE, "\nSpdx-license-identifier $1.\n")
    t = F.regexp_replace(t, JOIN_COMMA, ", ")
    t = F.regexp_replace(t, JOIN_NEXT, " $1")
    t = F.regexp_replace(t, STOP, "\n")
    t = F.regexp_replace(ascii_lower(t), OTHER, " ")
    return F.transform(F.split(t, "\n"), lambda s: F.regexp_replace(F.regexp_replace(F.btrim(s, F.lit(" .-")), LEAD, REFERENCE), TAIL, "$1"))


def parts(sentence: Column, known: Column) -> Column:
    """The sentences that a sentence stands for: one for each licence of an SPDX expression, or of a reference that isn't known as a whole. An exception to a licence goes."""
    each = lambda head: F.transform(F.split(F.substr(sentence, F.lit(len(head) + 1)), CHOICE), lambda x: F.concat(F.lit(head), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, EXCEPTION, ""), ARTICLE, ""), PLURAL, "$1")))
    several = sentence.startswith(REFERENCE) & ~F.coalesce(F.map_contains_key(known, sentence), F.lit(False)) & sentence.rlike(CHOICE)
    return F.when(sentence.startswith(SPDX), each(SPDX)).when(several, each(REFERENCE)).otherwise(F.array(sentence))


def identifiers(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order, and UNKNOWN for others that name or grant a licence."""
    known = F.map_from_arrays(F.array(*map(F.lit, SENTENCES)), F.array(*map(F.lit, SENTENCES.values())))
    loose = lambda s: F.when(s.rlike(LOOSE), F.regexp_replace(F.regexp_replace(s, LOOSE, REFERENCE), LOOSE_END, ""))
    called = lambda s: F.when(s.startswith(REFERENCE), F.concat(F.lit(SPDX), F.regexp_replace(F.substr(s, F.lit(len(REFERENCE) + 1)), CALLED, "")))
    identifier = lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, called(s)), F.try_element_at(known, loose(s)), F.when(s.rlike(LIKE), UNKNOWN))
    triggered = F.coalesce(ascii_lower(text).rlike(TRIGGER), F.lit(False))
    return F.when(triggered, F.filter(F.transform(F.flatten(F.transform(sentences(text), lambda s: parts(s, known))), identifier), lambda i: i.isNotNull())).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences that the rules find in a sequence of identifiers, each once, in the order of the rules."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(run) + "|").alias("run")) for name, run in RULES))
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["run"]), F.struct(F.replace(acc["left"], r["run"], F.lit("|/|")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found"))).otherwise(acc)
    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(rules, start, step, lambda acc: acc["found"]))).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every whole text: id_col, sentence_ids and licences (both comma-joined), n_sentences (known ones, and unknown ones that name or grant a licence: these make the licence UNKNOWN).

    Null and empty texts have none. A row depends on its text alone: nothing is shuffled, and repeated rows, ties and null ids need no rule. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), identifiers(F.col(text_col)).alias("ids"))
    return rows.select(F.col("id").alias(id_col), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences(F.col("ids")), ",").alias("licences"), F.size("ids").cast("long").alias("n_sentences"))


def oracle() -> str:
    """The same in DuckDB's SQL: sentences as rows, joined with a table of known ones; the rules one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = lambda head: f"list_transform(string_split_regex(substr(s, {len(head) + 1}), '{CHOICE}'), lambda x: '{head}' || regexp_replace(regexp_replace(regexp_replace(x, '{EXCEPTION}', ''), '{ARTICLE}', ''), '{PLURAL}', '\\1'))"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    steps = [(LEADER, r"'\1'"), (SPDX_LINE, r"chr(10) || 'Spdx-license-identifier \1.' || chr(10)"), (JOIN_COMMA, "', '"), (JOIN_NEXT, r"' \1'"), (STOP, "chr(10)")]
    cut = "text"
    for pattern, by in steps:
        cut = f"regexp_replace({cut}, {quote(pattern)}, {by}, 'g')"
    cut = f"string_split(regexp_replace(translate({cut}, '{UPPER}', '{LOWER}'), '{OTHER}', ' ', 'g'), chr(10))"
    rules = ["r0 AS (SELECT doc_id, n, '|' || coalesce(ids, '') || '|' AS left_, CAST([] AS VARCHAR[]) AS found FROM seq)"]
    for k, (name, run) in enumerate(RULES):
        text = quote("|" + "||".join(run) + "|")
        rules.append(f"r{k + 1} AS (SELECT doc_id, n, replace(left_, {text}, '|/|') AS left_, CASE WHEN contains(left_, {text}) AND NOT list_contains(found, {quote(name)}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM r{k})")
    return f"""
        WITH known(s, id) AS (VALUES {known}),
        cut AS (SELECT doc_id, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS k FROM documents WHERE text IS NOT NULL),
        plain AS (SELECT doc_id, k, regexp_replace(regexp_replace(trim(s, ' .-'), {quote(LEAD)}, '{REFERENCE}'), {quote(TAIL)}, '\\1') AS s FROM cut),
        split AS (SELECT doc_id, k, unnest(p) AS s, generate_subscripts(p, 1) AS j FROM (SELECT doc_id, k, CASE WHEN starts_with(s, '{SPDX}') THEN {each(SPDX)} WHEN starts_with(s, '{REFERENCE}') AND s NOT IN (SELECT s FROM known) AND regexp_matches(s, '{CHOICE}') THEN {each(REFERENCE)} ELSE [s] END AS p FROM plain)),
        named AS (SELECT doc_id, k, j, coalesce(known.id, called.id, loose.id, CASE WHEN regexp_matches(split.s, {quote(LIKE)}) THEN '{UNKNOWN}' END) AS id FROM split LEFT JOIN known USING (s)
            LEFT JOIN known AS called ON starts_with(split.s, '{REFERENCE}') AND called.s = '{SPDX}' || regexp_replace(substr(split.s, {len(REFERENCE) + 1}), '{CALLED}', '')
            LEFT JOIN known AS loose ON regexp_matches(split.s, {quote(LOOSE)}) AND loose.s = regexp_replace(regexp_replace(split.s, {quote(LOOSE)}, '{REFERENCE}'), {quote(LOOSE_END)}, '')),
        found AS (SELECT doc_id, string_agg(id, ',' ORDER BY k, j) AS joined, string_agg(id, '||' ORDER BY k, j) AS ids, count(*) AS n FROM named WHERE id IS NOT NULL GROUP BY doc_id),
        seq AS (SELECT doc_id, coalesce(n, 0) AS n, ids FROM documents LEFT JOIN found USING (doc_id)),
        {", ".join(rules)}
        SELECT r.doc_id, coalesce(found.joined, '') AS sentence_ids, array_to_string(r.found, ',') AS licences, r.n AS n_sentences
        FROM r{len(RULES)} AS r LEFT JOIN found USING (doc_id)
    """
