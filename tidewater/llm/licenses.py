"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences. Each sentence, reduced to its words in lower case, is mapped to the
identifier of a known licence sentence; what remains of a document is the sequence of identifiers and
their places. A rule is an ordered list of identifiers: it matches where they follow one another in
that order, with at most `gap` other sentences between two neighbours. A rule whose match is part of
a longer rule's is not reported beside it (see RULES).

A sentence ends at . ! or ? before white space, at : before a line break, or at an empty line; a line of comment marks only is
empty, and so is a copyright line, which says who owns a work, not how it is licensed. All marks vanish in
the reduction, so headers in code comments read like plain ones. A single line break is white space
(licence texts are wrapped), but where the sentence so read is unknown, its lines are tried one by one.

Every document is searched; texts without any of the words in WORDS, one of which each known sentence
has, skip the cutting. Nothing but the fixed rules is broadcast.

Defined cases: a null or empty text has no licence; each row gets its own result, repeated rows too; a
null doc_id stays null; extra columns are ignored; an empty table gives an empty result. No licence is
the empty string. Very long texts are cut whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Sentences of public licences and licence notices, by identifier.
SENTENCES = {
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-1": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-3": "Licensed under the Apache License, Version 2.0.",
    "apache-4": "Apache License Version 2.0, January 2004",
    "apache-5": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-4": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-5": "This work is licensed under the GNU General Public License, version 2.",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-4": "Released under the MIT License.",
    "mit-5": "Licensed under the MIT License.",
    "bsd-5": "Released under the BSD 3-Clause License.",
    "bsd-6": "Released under the BSD 2-Clause License.",
    "bsd-7": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-8": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl-6": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-2": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-2": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-1": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "postgresql-1": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "ofl-1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0-1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication.",
    "cc0-2": "Licensed under CC0 1.0.",
    "artistic-1": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "cc-1": "Licensed under CC BY 4.0.",
    "cc-2": "Licensed under CC BY-SA 4.0.",
    "cc-3": "Licensed under CC BY-NC 4.0.",
    "cc-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-5": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-6": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
}
#: Other forms of these sentences.
VARIANTS = {
    "apache-2": ["You may obtain a copy of the License at", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-3": ["Released under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "Licensed under the Apache License 2.0."],
    "mit-4": ["Released under the MIT license, see LICENSE."],
    "mit-5": ["This project is licensed under the MIT License.", "This software is licensed under the MIT License.", "Distributed under the MIT License."],
    "bsd-5": ["Licensed under the BSD 3-Clause License."],
    "bsd-6": ["Licensed under the BSD 2-Clause License."],
    "cc0-2": ["This work is licensed under CC0 1.0 Universal."],
}
#: Licences that a one-line tag (SPDX-License-Identifier) can name.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "OFL-1.1", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
]
SENTENCES |= {f"tag-{tag.lower()}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
VARIANTS |= {f"tag-{tag.lower()}": [f"License: {tag}"] for tag in TAGS}
#: Ordered rules (licence, identifiers, the licences whose match makes this one superfluous).
RULES = [
    ("MIT", ["mit-1", "mit-2", "mit-3"], []),
    ("MIT", ["mit-4"], []),
    ("MIT", ["mit-5"], []),
    ("ISC", ["isc-1"], []),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"], ["BSD-3-Clause", "BSD-4-Clause"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"], ["BSD-4-Clause"]),
    ("BSD-3-Clause", ["bsd-5"], []),
    ("BSD-2-Clause", ["bsd-6"], []),
    ("BSD-4-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-7", "bsd-4"], []),
    ("Apache-2.0", ["apache-1", "apache-2"], []),
    ("Apache-2.0", ["apache-3"], []),
    ("Apache-2.0", ["apache-4", "apache-5"], []),
    ("GPL-2.0-or-later", ["gpl-1", "gpl-3"], []),
    ("GPL-3.0-or-later", ["gpl-2", "gpl-3"], []),
    ("GPL-3.0-only", ["gpl-4"], []),
    ("GPL-2.0-only", ["gpl-5"], []),
    ("MPL-2.0", ["mpl-1"], []),
    ("CC-BY-4.0", ["cc-1"], []),
    ("CC-BY-SA-4.0", ["cc-2"], []),
    ("CC-BY-NC-4.0", ["cc-3"], []),
    ("CC-BY-4.0", ["cc-4"], []),
    ("CC-BY-SA-4.0", ["cc-5"], []),
    ("CC-BY-NC-4.0", ["cc-6"], []),
    ("Unlicense", ["unlicense-1"], []),
    ("0BSD", ["0bsd-1"], []),
    ("LGPL-2.1-or-later", ["lgpl-1", "lgpl-3"], []),
    ("LGPL-3.0-or-later", ["lgpl-2", "lgpl-3"], []),
    ("AGPL-3.0-or-later", ["agpl-1", "gpl-3"], []),
    ("EPL-2.0", ["epl-1"], []),
    ("Zlib", ["zlib-1", "zlib-2"], []),
    ("BSL-1.0", ["bsl-1"], []),
    ("BSL-1.0", ["bsl-2"], []),
    ("WTFPL", ["wtfpl-1"], []),
    ("PostgreSQL", ["postgresql-1"], []),
    ("OFL-1.1", ["ofl-1"], []),
    ("CC0-1.0", ["cc0-1"], []),
    ("CC0-1.0", ["cc0-2"], []),
    ("Artistic-2.0", ["artistic-1"], []),
]
RULES += [(tag, [f"tag-{tag.lower()}"], []) for tag in TAGS]
WORDS = "(?i)licen|permission|warrant|redistribut|public domain|you may obtain a copy|terms and conditions|you can obtain one|advertising materials"
#: Sentences between two neighbours of a rule.
GAP = 3

#: A copyright line, without what goes before its words.
OWNED = r"^[^\na-z0-9]*(?:copyright|\(c\)|©)[^\n]*"
#: Ends of sentences.
END = r"(?<=[.!?])[ \t\n\x0b\f\r]+|(?<=:)[ \t\r]*\n|\n[ \t\r]*(?:[#*/;%!|-]+[ \t\r]*)*\n"


#: Reduced sentences with an owner's name in them (or its rest, behind the full stop of an abbreviation), and what stands in its place.
NAMED = "^(?:.+ )?nor the names of (?:its|the|their|any) contributors"
OWNER = "neither the name of the copyright holder nor the names of its contributors"


def reduced(sentence: str) -> str:
    """A known sentence's words in lower case, as `words` makes them of a column."""
    return re.sub(NAMED, OWNER, re.sub(r"[^0-9a-z\x80-\uffff]+", " ", sentence.lower()).strip())


def words(sentence: Column) -> Column:
    """ASCII upper case to lower, all else than letters of any script and digits to single spaces; any owner's name as OWNER."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.trim(F.regexp_replace(lower, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")), NAMED, OWNER)


def forms(sentences: dict[str, str]) -> dict[str, str]:
    """The identifier of every form of every sentence, by its reduced piece.

    A sentence that itself has ends inside (`v. 2.0`) is known by its longest piece, as cutting makes them.
    """
    return {max((reduced(p) for p in re.split(END, s)), key=len): name for name, first in sentences.items() for s in (first, *VARIANTS.get(name, []))}


def known(sentences: dict[str, str]) -> Column:
    """The map from a known sentence, cut and reduced, to its identifier."""
    return F.create_map(*(F.lit(x) for pair in forms(sentences).items() for x in pair))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES, gap: int = GAP) -> DataFrame:
    """(doc_id, n_sentences, matches, licenses): matches are the known sentences in order, as structs of
    place and identifier; licenses are the sorted names of the rules that match."""
    table_ = known(sentences)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # (?d): only \n ends a line, as in SQL.
    cut = F.when(F.col("text").rlike(WORDS), F.split(F.regexp_replace("text", "(?imd)" + OWNED, ""), END)).otherwise(F.array().cast("array<string>"))

    def found(sentence: Column, place: Column) -> Column:
        """The sentence's identifier, or else those of its lines."""
        whole = table_[words(sentence)]
        each = F.transform(F.split(sentence, "\n"), lambda line: F.struct(place.alias("place"), table_[words(line)].alias("id")))
        return F.when(whole.isNotNull(), F.array(F.struct(place.alias("place"), whole.alias("id")))).when(
            sentence.rlike(WORDS), F.filter(each, lambda x: x["id"].isNotNull())
        )

    some = F.flatten(F.filter(F.transform(F.col("cut"), found), lambda x: x.isNotNull()))
    rows = rows.select("doc_id", cut.alias("cut")).select("doc_id", F.size("cut").alias("n_sentences"), some.alias("matches"))
    # The sequence as text: identifiers, with | where more than gap other sentences lie between two.
    sequence = F.aggregate(
        "matches",
        F.struct(F.lit(" ").alias("text"), F.lit(None).cast("int").alias("last")),
        lambda a, x: F.struct(F.concat(a["text"], F.when(x["place"] - a["last"] > gap + 1, F.lit("| ")).otherwise(F.lit("")), x["id"], F.lit(" ")).alias("text"), x["place"].alias("last")),
    )["text"]
    rows = rows.withColumn("sequence", sequence)
    hits = F.array(*(F.when(F.col("sequence").rlike("[^|]*? ".join(f" {re.escape(i)}(?= )" for i in ids).replace("[^|]*?  ", "[^|]*? ")), F.lit(name)) for name, ids, _ in rules))
    rows = rows.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(hits))))
    for name, _, longer in rules:
        if longer:
            both = F.arrays_overlap("licenses", F.array(*map(F.lit, longer)))
            rows = rows.withColumn("licenses", F.when(both, F.array_remove("licenses", name)).otherwise(F.col("licenses")))
    return rows.select("doc_id", "n_sentences", "matches", "licenses")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("matches", lambda m: m["id"]), " ")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known_ = ", ".join(f"({quote(piece)}, {quote(name)})" for piece, name in forms(SENTENCES).items())
    clean = r"regexp_replace(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' ')" + f", '{NAMED}', '{OWNER}')"
    cases, drops = [], {}
    for name, ids, longer in RULES:
        pattern = " " + "([^|]* )?".join(f"{i} " for i in ids)
        cases.append(f"select doc_id, rid, {quote(name)} l from seq where regexp_matches(s, {quote(pattern)})")
        if longer:
            drops[name] = longer
    less = " and ".join(f"not (l = {quote(n)} and exists (select 1 from hit h2 where h2.rid = hit.rid and h2.l in ({', '.join(map(quote, longer))})))" for n, longer in drops.items())
    # RE2 has no lookbehind: a mark put after every end does its work.
    return rf"""
with known(k, id) as (values {known_}),
d as (select row_number() over () rid, doc_id, coalesce(text, '') text from documents),
s1 as (
  select rid, unnest(c) s, generate_subscripts(c, 1) place
  from (select rid, string_split_regex(regexp_replace(regexp_replace(text, {quote("(?im)" + OWNED)}, '', 'g'), '([.!?])[ \t\n\x0b\f\r]+|(:)[ \t\r]*\n', '\1\2' || chr(30), 'g'), '\x1e|\n[ \t\r]*(?:[#*/;%!|-]+[ \t\r]*)*\n') c
        from d where regexp_matches(text, {quote(WORDS)}))),
s2 as (select s1.*, known.id from s1 left join known on {clean.format("s")} = known.k),
lines as (
  select rid, place, unnest(string_split(s, chr(10))) line, generate_subscripts(string_split(s, chr(10)), 1) sub
  from s2 where id is null and regexp_matches(s, {quote(WORDS)})),
m as (
  select rid, place, 0 sub, id from s2 where id is not null
  union all
  select rid, place, sub, known.id from lines join known on {clean.format("line")} = known.k),
g as (select *, place - lag(place) over (partition by rid order by place, sub) step from m),
seq as (
  select d.doc_id, d.rid, count(*) n, string_agg(id, ' ' order by place, sub) ids,
         ' ' || string_agg(case when step > {GAP + 1} then '| ' else '' end || id || ' ', '' order by place, sub) s
  from g join d using (rid) group by all),
hit as ({" union ".join(cases)}),
named as (select rid, string_agg(distinct l, ',' order by l) licenses from hit where {less} group by rid)
select d.doc_id, coalesce(n, 0)::bigint n_matches, coalesce(ids, '') sentence_ids, coalesce(licenses, '') licenses
from d left join seq using (rid) left join named using (rid)
"""


OP7_SQL = _sql()
