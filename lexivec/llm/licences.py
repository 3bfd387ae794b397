"""Licence notices by sentence rules, in DataFrame functions.

A text is cut into segments at line ends and marks; a segment is normalised to lower-case letters and
digits with single spaces. Known licence sentences have identifiers; a sentence is one segment or several
that follow each other, because notices are wrapped at some column and stand behind comment marks, and
marks stand inside of sentences ("v. 2.0", "SPDX-License-Identifier: MIT"). No sentence goes on over an
empty segment, nor over a full stop before a capital. The longest of several sentences counts; its
position is that of its first segment.

The identifiers of a text, in its order, are matched against rules: a rule names a licence and the
identifiers it needs, in order; other sentences may stand between them. The rule with most sentences
decides the main licence, the first listed among equals.

Work is per row, nothing is shuffled. Defined results: null and empty texts have no sentences and no
licence; repeated sentences count once per rule; every row gives a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "licensed under the apache license version 2 0",
    6: "licensed under the apache license version 2 0 the license",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at",
    9: "this work is licensed under the gnu general public license version 3",
    10: "this program is free software",
    11: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    12: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    13: "licensed under cc by nc 4 0",
    14: "licensed under cc by 4 0",
    15: "licensed under cc by sa 4 0",
    16: "this work is licensed under a creative commons attribution 4 0 international license",
    17: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    18: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    19: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    20: "this is free and unencumbered software released into the public domain",
    21: "spdx license identifier mit",
    22: "spdx license identifier apache 2 0",
    23: "spdx license identifier gpl 3 0 or later",
    24: "spdx license identifier bsd 3 clause",
    25: "this source code form is subject to the terms of the mozilla public license v 2 0",
    26: "all rights reserved",
    27: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    28: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    29: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    30: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    31: "distributed under the boost software license version 1 0",
    32: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    33: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    34: "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    35: "this library is free software",
    36: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    37: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    38: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    39: "terms and conditions for use reproduction and distribution",
    40: "apache license",
    41: "version 2 0 january 2004",
    42: "spdx license identifier gpl 2 0 only",
    43: "spdx license identifier gpl 2 0 or later",
    44: "spdx license identifier gpl 3 0 only",
    45: "spdx license identifier lgpl 2 1 or later",
    46: "spdx license identifier lgpl 3 0 or later",
    47: "spdx license identifier agpl 3 0 or later",
    48: "spdx license identifier bsd 2 clause",
    49: "spdx license identifier isc",
    50: "spdx license identifier zlib",
    51: "spdx license identifier bsl 1 0",
    52: "spdx license identifier cc0 1 0",
    53: "spdx license identifier epl 2 0",
    54: "spdx license identifier mpl 2 0",
    55: "spdx license identifier unlicense",
    56: "spdx license identifier cc by 4 0",
    57: "spdx license identifier cc by sa 4 0",
}

# Rules in order, each a licence and the sentences it needs in their order.
RULES = [
    ("MIT", (3, 4)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (21,)),
    ("Apache-2.0", (6, 7, 8)),
    ("Apache-2.0", (6,)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (22,)),
    ("GPL-3.0", (10, 11)),
    ("GPL-3.0", (9,)),
    ("GPL-3.0", (23,)),
    ("GPL-2.0", (10, 12)),
    ("CC-BY-NC-4.0", (13,)),
    ("CC-BY-NC-4.0", (17,)),
    ("CC-BY-4.0", (14,)),
    ("CC-BY-4.0", (16,)),
    ("CC-BY-SA-4.0", (15,)),
    ("BSD-3-Clause", (18, 19)),
    ("BSD-3-Clause", (24,)),
    ("BSD-2-Clause", (18,)),
    ("Unlicense", (20,)),
    ("MPL-2.0", (25,)),
    ("Apache-2.0", (40, 41, 39)),
    ("BSD-3-Clause", (18, 27, 28, 19)),
    ("BSD-2-Clause", (18, 27, 28)),
    ("BSD-2-Clause", (48,)),
    ("ISC", (29,)),
    ("ISC", (49,)),
    ("Zlib", (30,)),
    ("Zlib", (50,)),
    ("BSL-1.0", (31,)),
    ("BSL-1.0", (51,)),
    ("CC0-1.0", (32,)),
    ("CC0-1.0", (52,)),
    ("EPL-2.0", (33,)),
    ("EPL-2.0", (53,)),
    ("EPL-1.0", (34,)),
    ("LGPL-2.1", (35, 36)),
    ("LGPL-2.1", (36,)),
    ("LGPL-2.1", (45,)),
    ("LGPL-3.0", (35, 37)),
    ("LGPL-3.0", (10, 37)),
    ("LGPL-3.0", (37,)),
    ("LGPL-3.0", (46,)),
    ("AGPL-3.0", (10, 38)),
    ("AGPL-3.0", (38,)),
    ("AGPL-3.0", (47,)),
    ("GPL-3.0", (44,)),
    ("GPL-2.0", (42,)),
    ("GPL-2.0", (43,)),
    ("MPL-2.0", (54,)),
    ("Unlicense", (55,)),
    ("CC-BY-4.0", (56,)),
    ("CC-BY-SA-4.0", (57,)),
    ("Proprietary", (26,)),
]

#: A segment ends at a line end, or at one of these marks before white space.
BREAK = r"([.!?;:])[ \t\n\x0B\f\r]+"
#: A sentence ends at one of these marks before a capital; comment marks and quotes may stand between them.
FULL = r"([.!?])[ \t\n\x0B\f\r]++(?=[^A-Za-z0-9]{0,16}[A-Z])"
#: A comment mark made of the same marks ends an empty segment that no sentence stops at.
MARK = r"(^|\n)([ \t]*[.!?;:]+)[ \t]++(?=[^ \t\n\x0B\f\r])"

_STOP, _MARK, _FOUND = "\x01", "\x02", "\x03"  # end of a sentence, of a mark, and start of a known sentence; no normalised text has them
_ENDS = f"\n{_STOP}{_MARK}"

#: Comment marks made of letters; all others go with the normalisation.
REMARK = "(?:(?:rem|dnl|c) )?"
#: Between two words of a sentence.
GAP = f"(?: |\n{_MARK}?{REMARK})"


def _pattern(sentences: dict[int, str]) -> str:
    """Known sentences that begin and end with segments; the longest is tried first."""
    longest = sorted(sentences.values(), key=len, reverse=True)
    known = "|".join(GAP.join(map(re.escape, s.split(" "))) for s in longest)
    return f"(?<![^{_ENDS}]){REMARK}({known})(?![^{_ENDS}])"


def sentence_ids(text: Column, sentences: dict[int, str] | None = None) -> Column:
    """Array of (position, id) of the known sentences of a text."""
    sentences = SENTENCES if sentences is None else sentences
    known = F.create_map(*(F.lit(x) for k, s in sentences.items() for x in (s, k)))
    pattern = _pattern(sentences)
    cut = F.regexp_replace(F.translate(text, _STOP + _MARK, "--"), MARK, f"$1$2{_MARK}")
    cut = F.regexp_replace(F.regexp_replace(cut, FULL, f"$1{_STOP}"), BREAK, "$1\n")
    plain = F.regexp_replace(F.lower(cut), f"[^a-z0-9{_ENDS}]+", " ")
    plain = F.trim(F.regexp_replace(plain, f" ?([{_ENDS}]) ?", "$1"))

    def marked(plain: Column) -> Column:
        segments = F.split(F.regexp_replace(plain, pattern, f"{_FOUND}$1"), f"[{_ENDS}]")
        begins = F.transform(segments, lambda s, k: F.when(F.startswith(s, F.lit(_FOUND)), k))
        return F.zip_with(
            F.filter(begins, lambda k: k.isNotNull()), F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)),
            lambda k, s: F.struct(k.alias("position"), F.try_element_at(known, F.regexp_replace(s, GAP, " ")).alias("id")),
        )

    found = F.element_at(F.transform(F.array(plain), marked), 1)  # the normalised text is used twice and made once
    return F.coalesce(found, F.array().cast("array<struct<position:int,id:int>>"))


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[int, str] | None = None,
    rules: list[tuple[str, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licence, licences, first_position) for every row; -1 is no position."""
    rules = RULES if rules is None else rules
    found = docs.select(F.col(doc_id).alias("doc_id"), sentence_ids(F.col(text), sentences).alias("found"))
    listed = F.concat_ws(",", F.transform("found", lambda m: m.id.cast("string"))).alias("sentence_ids")
    found = found.select("doc_id", "found", listed)

    def matches(needed: tuple[int, ...]) -> Column:
        pattern = "(^|,)" + "(,|,.*,)".join(str(k) for k in needed) + "(,|$)"
        return F.col("sentence_ids").rlike(pattern)

    matched = F.filter(
        F.array(*(F.when(matches(needed), F.lit(name)) for name, needed in rules)), lambda name: name.isNotNull()
    )
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))
    main = F.coalesce(*(F.when(matches(rules[k][1]), F.lit(rules[k][0])) for k in ranked))
    return found.select(
        "doc_id", F.size("found").cast("bigint").alias("n_known"), "sentence_ids", main.alias("licence"),
        F.concat_ws(",", F.array_sort(F.array_distinct(matched))).alias("licences"),
        F.coalesce(F.try_element_at("found", F.lit(1)).position, F.lit(-1)).cast("bigint").alias("first_position"),
    )
