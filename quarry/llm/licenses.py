"""License scans by sentence rules, in DataFrame operations only.

A text's sentences are normalised and mapped to the identifiers of known licence sentences; the
identifier sequence is then matched against ordered licence rules, longer ones first, each
match using up its identifiers.
"""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Sentences of public licences and licence notices, normalised.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit_line": "released under the mit license",
    "mit_line_2": "licensed under the mit license",
    "mit_title": "mit license",
    "apache_grant": "licensed under the apache license version 2.0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "apache_line": "licensed under the apache license version 2.0",
    "apache_title": "apache license version 2.0",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_line": "licensed under the bsd license",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "gpl3_line": "this work is licensed under the gnu general public license version 3",
    "gpl2_line": "this work is licensed under the gnu general public license version 2",
    "lgpl_line": "this work is licensed under the gnu lesser general public license version 3",
    "agpl_line": "this work is licensed under the gnu affero general public license version 3",
    "mpl_terms": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense_domain": "this is free and unencumbered software released into the public domain",
    "unlicense_free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc_by_line": "licensed under cc by 4.0",
    "cc_by_sa_line": "licensed under cc by sa 4.0",
    "cc_by_nc_line": "licensed under cc by nc 4.0",
    "cc_by_nd_line": "licensed under cc by nd 4.0",
    "cc_by_work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc0_line": "this work is dedicated to the public domain under cc0 1.0",
    "reserved": "all rights reserved",
}

#: (licence, sentence identifiers in order).  Rules with more sentences are tried first.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("Apache-2.0", ("apache_grant", "apache_use", "apache_copy", "apache_law", "apache_see")),
    ("Apache-2.0", ("apache_grant", "apache_use")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details", "gpl_received")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope")),
    ("MPL-2.0", ("mpl_terms", "mpl_copy")),
    ("Unlicense", ("unlicense_domain", "unlicense_free")),
    ("MIT", ("mit_grant",)), ("MIT", ("mit_line",)), ("MIT", ("mit_line_2",)), ("MIT", ("mit_title",)),
    ("Apache-2.0", ("apache_grant",)), ("Apache-2.0", ("apache_line",)), ("Apache-2.0", ("apache_title",)),
    ("BSD", ("bsd_grant",)), ("BSD", ("bsd_line",)),
    ("GPL-3.0-or-later", ("gpl_free",)), ("GPL-2.0-or-later", ("gpl2_free",)),
    ("GPL-3.0", ("gpl3_line",)), ("GPL-2.0", ("gpl2_line",)), ("LGPL-3.0", ("lgpl_line",)), ("AGPL-3.0", ("agpl_line",)),
    ("MPL-2.0", ("mpl_terms",)), ("ISC", ("isc_grant",)), ("Unlicense", ("unlicense_domain",)),
    ("CC-BY-4.0", ("cc_by_line",)), ("CC-BY-SA-4.0", ("cc_by_sa_line",)), ("CC-BY-NC-4.0", ("cc_by_nc_line",)), ("CC-BY-ND-4.0", ("cc_by_nd_line",)),
    ("CC-BY-4.0", ("cc_by_work",)), ("CC0-1.0", ("cc0_line",)), ("All-rights-reserved", ("reserved",)),
)

#: Sentence ends: marks before a blank or the end, a line feed, a list number or comment sign around it.
KEEP, END = r"[^a-z0-9.;:!?\n]+", r" *(?:[.;:!?]+(?: +|\n|$)|\n)[ .;:!?\n]*"


def sentences(text: Column) -> Column:
    """The normalised sentences: lower case, runs of other characters than letters, digits and marks one space."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), KEEP, " ")), END)


#: Words of known sentences that real texts put a mark before; the sentences above have none.
BREAKS = {
    "gpl_free": ("you can redistribute", "either version"), "gpl2_free": ("you can redistribute", "either version"),
    "gpl_hope": ("without even",), "mpl_copy": ("mozilla.org",),
}


def spellings() -> dict[str, str]:
    """The identifiers by sentence, "; " where a mark may be within."""
    found = {}
    for name, sentence in SENTENCES.items():
        breaks = BREAKS.get(name, ())
        for chosen in chain.from_iterable(combinations(breaks, n) for n in range(len(breaks) + 1)):
            form = sentence.replace(". ", "; ")
            for words in chosen:
                form = form.replace(f" {words}", f"; {words}")
            found[form] = name
    return found


KNOWN = spellings()
#: How known sentences begin, word by word.
BEGUN = sorted({" ".join(words[:n]).rstrip(";") for words in (k.split(" ") for k in KNOWN) for n in range(1, len(words))})
LONGEST = max(len(k.split(" ")) for k in KNOWN)


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) plus found: (position, sentence) of the known sentences.

    Texts are split at marks and line feeds; a known sentence is one part or several in a row that have single
    line feeds between them, or marks where it has one.  Blank lines end it.  The longest
    sentence from a part counts, and none that begins within an earlier one.
    """
    normal = F.trim(F.regexp_replace(F.lower("text"), KEEP, " "))
    rows = rows.withColumn("normal", normal).withColumn("parts", F.split("normal", END))
    some = F.exists("parts", lambda s: s.isin(BEGUN))
    rows = rows.withColumn("gaps", F.when(some, F.regexp_extract_all("normal", F.lit(END), F.lit(0))).otherwise(F.array().cast("array<string>")))
    names = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for s, i in KNOWN.items()))

    def name(s: Column) -> Column:
        return F.when(s.isin(list(KNOWN)), F.try_element_at(names, s))

    def state(text: Column, live: Column, end: Column, sentence: Column) -> Column:
        return F.struct(text.alias("text"), live.alias("live"), end.alias("end"), sentence.alias("sentence"))

    def longer(a: Column, j: Column) -> Column:
        gap = F.get("gaps", j - 1)
        text = F.concat(a["text"], F.when(gap.rlike("[.;:!?]"), F.lit("; ")).otherwise(F.lit(" ")), F.get("parts", j))
        more = ~gap.rlike(r"\n[^\n]*\n")
        hit = F.when(more, name(text))
        live = F.coalesce(more & text.isin(BEGUN), F.lit(False))
        return F.when(a["live"], state(text, live, F.when(hit.isNotNull(), j).otherwise(a["end"]), F.coalesce(hit, a["sentence"]))).otherwise(a)

    def reach(x: Column) -> Column:
        last = F.least(F.size("parts") - 1, x["at"] + LONGEST)
        after = F.when(x["part"].isin(BEGUN) & (last > x["at"]), F.sequence(x["at"] + 1, last)).otherwise(F.array().cast("array<int>"))
        got = F.aggregate(after, state(x["part"], x["part"].isin(BEGUN), x["at"], name(x["part"])), longer)
        return F.struct(x["at"].alias("position"), got["sentence"].alias("sentence"), got["end"].alias("end"))

    starts = F.filter(F.transform("parts", lambda s, i: F.struct(i.alias("at"), s.alias("part"))), lambda x: x["part"].isin(BEGUN) | x["part"].isin(list(KNOWN)))
    rows = rows.withColumn("met", F.filter(F.transform(starts, reach), lambda x: x["sentence"].isNotNull()))
    inside = lambda x: F.exists("met", lambda y: (y["position"] < x["position"]) & (x["position"] <= y["end"]))
    return rows.withColumn("found", F.filter("met", lambda x: ~inside(x)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences (known ones), sequence (position:identifier list), licenses (sorted names), n_matches.

    One row per row of ``docs``, without a shuffle: a row's sequence is matched in place.  A text
    without known sentences has empty strings and zeros; null text counts as empty.  Repeated rows give equal results,
    empty tables empty ones; ids may be null; extra columns are ignored.  A position is
    that of a sentence's first part, text being split at marks and line feeds.  Sentences between known ones don't break a rule.
    """
    rows = identified(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")))
    rows = rows.select(id_col, "found", F.array_join(F.transform("found", lambda x: F.concat(F.lit("<"), x["sentence"], F.lit(">"))), "").alias("rest"))
    names, counts = [], []
    rest = F.col("rest")
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    for n, (_, ids) in enumerate(ordered):
        pattern = "".join(f"<{i}>" for i in ids)
        step = F.replace(rest, F.lit(pattern), F.lit("|"))
        # one column a rule, so that no expression holds the chain of all before
        rows = rows.withColumns({f"c{n}": F.when(F.length(rest) > 0, (F.length(rest) - F.length(step)) / (len(pattern) - 1)).otherwise(0.0).cast("long"), "rest": step})
        rest = F.col("rest")
    for n, (name, _) in enumerate(ordered):
        names.append(F.when(F.col(f"c{n}") > 0, F.lit(name)))
        counts.append(F.col(f"c{n}"))
    return rows.select(
        id_col, F.size("found").cast("long").alias("n_sentences"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["position"].cast("string"), x["sentence"])), ",").alias("sequence"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",").alias("licenses"), sum(counts[1:], counts[0]).alias("n_matches"),
    )
