"""License scans by recognised sentences.

A text is cut into pieces at line ends and after ``. ! ? ;`` before white space (not
where ``;`` or ``!`` begins a line as a comment mark) and normalised: A-Z lowered, runs
of other ASCII characters than letters, digits and ``+`` made one space, ends trimmed,
so that comment marks such as ``#``, ``*`` and ``//`` vanish. A piece, or a run of pieces
without a blank one between them, that reads as a sentence of the table is replaced by
its identifier, so hard-wrapped sentences are found wherever their lines end, and
titles and notices on a line of their own as well; the longest sentence counts. The
marks ``dnl``, ``rem`` and ``+`` before a line, and a number before a sentence, are
passed over. All other pieces are dropped. The identifiers of a document, in order,
are matched against the rules by rank: a rule is a sequence of identifiers that follow
one another, with at most ``GAP`` unknown pieces (blank ones too) between neighbours and
no known one. What a rule has matched is not used by later rules. A declared SPDX identifier
names its license itself and is the best one.

The tables of sentences and rules are parameters held in the plan (a few thousand
entries at most); the scan itself is one pass without a shuffle.

Defined cases: null and empty texts have no license; several licenses in one text
are all reported; repeated notices count as one license; repeated rows give
repeated results; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantfold.llm.common import let

GAP = 3

#: Identifier and sentence of public license texts and notices.
SENTENCES = [
    ("mit-notice", "Released under the MIT License"),
    ("mit-licensed", "Licensed under the MIT License"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice-long", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-comply", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0"),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl11-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
    ("mpl11-contents", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("gpl2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl21-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("agpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-author", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant-and", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("cc0-dedicated", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
]
#: Identifiers that a line ``SPDX-License-Identifier: ...`` may name.
SPDX = [
    "MIT", "MIT-0", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
]
SENTENCES += [(f"spdx:{name}", f"SPDX-License-Identifier: {name}") for name in SPDX]
#: Rank, license and the identifiers that must follow one another.
RULES = [
    (1, "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    (2, "MIT", ["mit-grant", "mit-condition"]),
    (3, "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    (4, "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-author"]),
    (5, "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    (6, "Apache-2.0", ["apache-notice-long", "apache-comply", "apache-copy"]),
    (7, "GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    (8, "GPL-3.0-or-later", ["gpl-free"]),
    (9, "GPL-3.0-only", ["gpl3-notice"]),
    (10, "Apache-2.0", ["apache-notice"]),
    (11, "Apache-2.0", ["apache-notice-long"]),
    (12, "MIT", ["mit-notice"]),
    (13, "MIT", ["mit-licensed"]),
    (14, "MIT", ["mit-title"]),
    (15, "ISC", ["isc-grant"]),
    (16, "CC-BY-NC-4.0", ["cc-by-nc-4"]),
    (17, "CC-BY-SA-4.0", ["cc-by-sa-4"]),
    (18, "CC-BY-4.0", ["cc-by-4"]),
    (19, "MPL-2.0", ["mpl2-notice"]),
    (20, "GPL-2.0-or-later", ["gpl2-later"]),
    (21, "GPL-2.0-only", ["gpl2-notice"]),
    (22, "GPL-2.0-only", ["gpl2-only"]),
    (23, "LGPL-2.1-or-later", ["lgpl21-later"]),
    (24, "LGPL-3.0-or-later", ["lgpl3-later"]),
    (25, "AGPL-3.0-or-later", ["agpl3-later"]),
    (26, "MPL-1.1", ["mpl11-notice"]),
    (27, "MPL-1.1", ["mpl11-contents"]),
    (28, "ISC", ["isc-grant-and"]),
    (29, "Zlib", ["zlib-grant"]),
    (30, "BSL-1.0", ["boost-notice"]),
    (31, "Unlicense", ["unlicense-free"]),
    (32, "CC0-1.0", ["cc0-dedicated"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2A\\x2C-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The same inside a line.
NOT_WORD_IN_LINE = NOT_WORD.replace("\\x00-\\x2A", "\\x00-\\x09\\x0B-\\x2A")
#: Marks that end a sentence before white space; not the comment marks ``;`` and ``!`` at the start of a line.
SENTENCE_END = "([.!?;])(?<!(?:^|\\n)[\\x20\\t]{0,40}[;!]{1,8})[\\x20\\x09-\\x0D]+"
#: Comment and change marks that normalisation leaves before a line, and a number before a sentence.
LINE_MARK, NUMBER = "(?:\\+ ?)?(?:(?:dnl|rem) )?", "(?:[0-9]{1,2} )?"
#: A sentence with a hole: whoever is named there stands for the copyright holder.
HOLDER = "neither the name of the copyright holder nor the names of its contributors"
_AND = f"(?: |\n{LINE_MARK})"
NAMED_HOLDER = _AND.join("neither the name of".split()) + _AND + "[^\n]{1,80}(?:\n[^\n]{1,80}){0,2}?" + _AND + _AND.join("nor the names of".split()) + _AND + "(?:its|their)" + _AND + "contributors"
#: Put around known sentences; not a character of a normalised text.
MARK = "\x01"


def normal_form(sentence: str) -> str:
    """A fixed sentence as it reads in a normalised text."""
    return re.sub(NOT_WORD, " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def normalised(text: Column) -> Column:
    """The normalised pieces of a text, each between line ends."""
    pieces = F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n")
    plain = F.regexp_replace(F.translate(pieces, UPPER, LOWER), NOT_WORD_IN_LINE, " ")
    lines = F.concat(F.lit("\n"), plain, F.lit("\n"))
    return F.replace(F.replace(lines, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))


def recognised(text: Column, sentences=SENTENCES) -> Column:
    """(unknown: pieces since the one before, id) of the known sentences of a text, in order."""
    known = {normal_form(s): name for name, s in sentences}
    if not known:
        return F.array().cast("array<struct<unknown:int,id:string>>")
    wrapped = [f"(?: |\n{LINE_MARK})".join(map(re.escape, s.split(" "))) for s in sorted(known, key=len, reverse=True)]
    whole = F.regexp_replace(normalised(text), NAMED_HOLDER, HOLDER)
    marked = F.regexp_replace(whole, f"\n{LINE_MARK}{NUMBER}({'|'.join(wrapped)})(?=\n)", f"\n{MARK}$1{MARK}")
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    ends = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    one_line = lambda s: F.regexp_replace(s, f"\n{LINE_MARK}", " ")

    def placed(parts: Column) -> Column:
        # every second part is a known sentence; what lies before it begins and ends with a line end
        at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct((ends(F.get(parts, i - 1)) - 1).alias("unknown"), F.element_at(names, one_line(F.get(parts, i))).alias("id")))

    return let(F.split(marked, MARK), placed)


def scan_licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES, gap: int = GAP) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (in order), licenses (sorted, distinct), best (of the best rank, null if none)."""
    apart = lambda x, i: (i > 0) & (x["unknown"] > gap)
    written = F.transform("found", lambda x, i: F.concat(F.when(apart(x, i), F.lit("<#>")).otherwise(F.lit("")), F.lit("<"), x["id"], F.lit(">")))
    declared = F.transform(F.filter(F.col("found.id"), lambda x: F.startswith(x, F.lit("spdx:"))), lambda x: F.substring(x, 6, 100))
    df = docs.select("doc_id", recognised(F.col("text"), sentences).alias("found"))
    df = df.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.concat_ws(",", F.col("found.id")).alias("sentence_ids"), F.concat_ws("", written).alias("left_over"), declared.alias("declared"))
    found = []
    for rank, name, ids in sorted(rules):
        sequence = F.lit("".join(f"<{i}>" for i in ids))
        found.append(F.when(F.col(f"hit{rank}"), F.lit(name)))
        df = df.withColumn(f"hit{rank}", F.contains(F.col("left_over"), sequence)).withColumn("left_over", F.replace(F.col("left_over"), sequence, F.lit("<#>")))
    by_rule = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(
        "doc_id", "n_sentences", "sentence_ids",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("declared", by_rule)))).alias("licenses"),
        F.coalesce(F.get("declared", F.lit(0)), *found).alias("best"),
    )
