"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences, each is normalised, and known ones become licence-sentence identifiers; the ordered
identifiers of a text are matched with licence rules, the first rule that fits a place deciding it. Licences are
often wrapped within sentences, and notices often stand alone on a line without a full stop: a sentence ends at its
punctuation or at a blank line, and where it is not known as a whole, its lines are looked up one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: A sentence ends at ., ! or ? before white space, or at a line with nothing but white space and comment marks.
SENTENCE_END = r"[.!?]+[\x20\x09\x0D\n]+|\n[\x20\x09\x0D*#/;-]*\n[\x20\x09\x0D\n]*"
#: Abbreviations that end no sentence, in lower case with what surrounds them, and what they become.
ABBREVIATIONS: tuple[tuple[str, str], ...] = ((" v. ", " v "), (" v.\n", " v "), (" ver. ", " ver "), (" no. ", " no "))
#: How a normalised tag line begins, the words between the licences of its expression, and a part of a name that has one of these.
TAG_LINE, OPERATORS, LATER = "spdx license identifier ", " (?:or|and|with) ", " or later"
#: What normalisation turns into one space, after A-Z are lower-cased.
OTHER = r"[^a-z0-9]+"
#: Every known sentence has one of these, so a text without any is not cut up.
CLUES = ("licen", "copyright", "permission", "redistribution", "rights", "warrant", "public domain", "copy", "liable")

# Licences that tags name, by their public short identifiers.
TAGGED: tuple[str, ...] = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
    # deprecated ones, still in use
    "AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
)
# Normalised sentences that well-known licences consist of or are referred to by.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-header",
    "apache license version 2 0": "apache-title",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "licensed under the apache license version 2 0 see license": "apache-ref",
    "licensed under the apache license version 2 0 see license for details": "apache-ref",
    "released under the mit license": "mit-ref",
    "licensed under the mit license see license": "mit-ref",
    "licensed under the mit license see license for details": "mit-ref",
    "licensed under the mit license see the license file for details": "mit-ref",
    "this project is licensed under the mit license see the license file for details": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit-0-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "distributed under the boost software license version 1 0": "boost-ref",
    "mozilla public license version 2 0": "mpl-title",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-copy",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "licensed under cc0 1 0": "cc0-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the mozilla public license version 2 0": "mpl-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-ref",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "all rights reserved": "reserved",
} | {f"spdx license identifier {' '.join(tag.lower().replace('-', ' ').replace('.', ' ').split())}": f"spdx-{tag}" for tag in TAGGED}
# Ordered identifiers that make up a licence; a longer rule stands before those it contains.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-ref", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-ref", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("MIT-0", ("mit-0-grant",)),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-2.0", ("gpl2-grant", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0", ("gpl2-grant",)),
    ("GPL-3.0", ("gpl3-ref", "gpl-copy")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref", "gpl-copy")),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-2.1", ("lgpl21-grant", "lgpl-warranty", "lgpl-copy")),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-grant", "lgpl-warranty", "lgpl-copy")),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("AGPL-3.0", ("agpl3-grant", "gpl-warranty", "agpl-copy")),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("AGPL-3.0", ("agpl3-ref",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source")),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("MPL-2.0", ("mpl-ref",)),
    ("MPL-2.0", ("mpl-title",)),
    ("all-rights-reserved", ("reserved",)),
) + tuple((tag, (f"spdx-{tag}",)) for tag in TAGGED)


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    if unclear := [s for s in sentences if not any(c in s for c in CLUES)]:
        raise ValueError(f"sentences without a clue: {unclear}")
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    normal = lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("+"), F.lit(f"{LATER} ")), OTHER, " "))
    one = lambda n: F.array_compact(F.array(F.try_element_at(known, n)))

    def of_line(s: Column) -> Column:
        """Identifiers of a single line: of each licence of a tag's expression, else of the line as a sentence."""
        n = normal(s)
        parts = F.split(F.replace(F.substr(n, F.lit(len(TAG_LINE) + 1)), F.lit(LATER), F.lit("+")), OPERATORS)
        tags = F.transform(parts, lambda p: F.try_element_at(known, F.concat(F.lit(TAG_LINE), F.replace(F.trim(p), F.lit("+"), F.lit(LATER)))))
        return F.when(n.startswith(TAG_LINE), F.array_compact(tags)).otherwise(one(n))

    def of_piece(s: Column) -> Column:
        """Those of a sentence of several lines, or of its lines where it isn't known as a whole."""
        whole = one(normal(s))
        return F.when(~s.contains("\n"), of_line(s)).when(F.size(whole) > 0, whole).otherwise(F.flatten(F.transform(F.split(s, "\n"), of_line)))

    clear = lower_ascii(text)
    for a, b in ABBREVIATIONS:
        clear = F.replace(clear, F.lit(a), F.lit(b))
    ids = F.flatten(F.transform(F.split(clear, SENTENCE_END), of_piece))
    clue = F.lower(text)
    maybe = F.lit(False)
    for c in CLUES:
        maybe |= clue.contains(c)
    return F.when(maybe, ids).otherwise(F.array().cast("array<string>"))


def matched(ids: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """Sorted licences whose rules fit; each rule takes its identifiers out before the next one is tried."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f";{i};" for i in rule)).alias("ids")) for name, rule in rules])
    start = F.struct(F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("found"))

    def take(s: Column, r: Column) -> Column:
        found = F.when(s["left"].contains(r["ids"]), F.array_append(s["found"], r["name"])).otherwise(s["found"])
        return F.struct(F.replace(s["left"], r["ids"], F.lit("#")).alias("left"), found.alias("found"))

    return F.array_sort(F.array_distinct(F.aggregate(each, start, take)["found"]))


def licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses): arrays for every row, empty for null, empty or unlicensed texts.

    Repeated rows repeat; a sentence found twice stands twice among sentence_ids. Very long texts are read whole; an
    empty table gives an empty result; other columns don't take part, whatever their names.
    """
    # the rules only run where a sentence was found
    found = docs.select("doc_id", sentence_ids(F.coalesce(F.col("text"), F.lit("")), sentences).alias("sentence_ids"))
    none = F.array().cast("array<string>")
    return found.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"), rules)).otherwise(none).alias("licenses"))
