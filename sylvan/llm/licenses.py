"""License scans by sentence rules (operator 10, JVM side only).

A text is cut into sentences (also across wrapped lines).  A normalised sentence is mapped to the
identifier of a known license sentence: a sentence of a license text, a grant ("licensed under
..."), an SPDX tag or a copyright line.  The identifiers of a document, in order, are matched
against ordered rules; a rule takes the identifiers it matched, so that a longer license is not
reported again as its part.  All work stays inside the row; texts without a license word are left
after one search.

Defined results: null and empty texts have no sentences; a grant of an unknown license gives no
identifier but counts in ``n_license_like``; the same license twice is reported once; repeated rows
each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: A sentence without one of these is no license sentence.
CUE = "licen[cs]e|copyright|permission|warrant|redistribut|public domain|spdx|free software|all rights reserved|obtain a copy|hope that it"


def _names() -> dict[str, str]:
    """Normalised names of licenses, without "the" before and "license" after, to SPDX identifiers."""
    out = {"mit": "MIT", "x11": "X11", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "boost software license 1.0": "BSL-1.0", "bsl-1.0": "BSL-1.0", "cc0": "CC0-1.0", "cc0 1.0": "CC0-1.0", "cc0-1.0": "CC0-1.0"}
    for alias in ("apache 2.0", "apache-2.0", "apache 2", "apache license version 2.0", "apache license 2.0", "apache software license version 2.0"):
        out[alias] = "Apache-2.0"
    for n in (2, 3, 4):
        for alias in (f"bsd-{n}-clause", f"bsd {n}-clause", f"{n}-clause bsd"):
            out[alias] = f"BSD-{n}-Clause"
    for alias in ("new bsd", "modified bsd", "revised bsd"):
        out[alias] = "BSD-3-Clause"
    for alias in ("simplified bsd", "freebsd"):
        out[alias] = "BSD-2-Clause"
    gnu = [("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2.1", "3")), ("AGPL", "gnu affero general public license", ("3",))]
    for short, long, versions in gnu:
        for v in versions:
            full = v if "." in v else f"{v}.0"
            for number in {v, full}:
                low = short.lower()
                for alias in (f"{long} version {number}", f"{long} v{number}", f"{long} {number}", f"gnu {low} version {number}", f"gnu {low} v{number}", f"{low} version {number}", f"{low} v{number}", f"{low}v{number}", f"{low}-{number}", f"{low} {number}"):
                    out[alias] = out[f"{alias} only"] = out[f"{alias}-only"] = f"{short}-{full}-only"
                    for later in (" or later", "-or-later", " or any later version", " or at your option any later version", "+"):
                        out[f"{alias}{later}"] = f"{short}-{full}-or-later"
    for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        words = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
        long = "-".join(words[p] for p in parts.split("-"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for alias in (f"cc {parts} {v}", f"cc-{parts}-{v}", f"cc-{parts} {v}", f"creative commons {long} {v}", f"creative commons {long} {v} international", f"creative commons {long} {v} unported", f"creative commons {parts} {v}"):
                out[alias] = f"CC-{parts.upper()}-{v}"
    for v in ("1.1", "2.0"):
        for alias in (f"mozilla public license version {v}", f"mozilla public license {v}", f"mpl {v}", f"mpl-{v}"):
            out[alias] = f"MPL-{v}"
    for v in ("1.0", "2.0"):
        for alias in (f"eclipse public license version {v}", f"eclipse public license {v}", f"epl-{v}", f"epl {v}"):
            out[alias] = f"EPL-{v}"
    return out


NAMES = _names()
#: Sentences of published license texts, lower case, marks left out, and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-obtain",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "all rights reserved": "all-rights",
}
#: Ordered rules: license, identifiers that occur in this order, others between them allowed.  The first rules win.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-grant", "mit-notice")), ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("grant:Apache-2.0", "apache-comply", "apache-obtain")),
    ("GPL-3.0-or-later", ("gpl3-later", "gnu-warranty", "gpl-copy")), ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gnu-warranty", "gpl-copy")), ("GPL-2.0-or-later", ("gpl2-later",)), ("Unlicense", ("unlicense-domain",)),
]
#: What stands before the name in a grant; the name may be followed by "license".
GRANT = r"^(?:(?:this|the|all) (?:work|file|code|source code|software|program|project|content|text|document|documentation|material)(?: is| are)? )?(?:also )?(?:dual-)?(?:licen[cs]ed|released|distributed|published|provided|available|made available) under (?:the )?(?:terms of )?(?:the )?(.+?)(?: the licen[cs]e| licen[cs]e)?$"
COPYRIGHT = r"^copyright (?:c )?[0-9]{4}"
SPDX = r"^spdx-license-identifier (.+)$"
#: Cuts: after a full stop with white space behind it, after a colon at the end of a line, and at blank lines.
END_MARK, BLANK = r"([.!?])[\x20\x09-\x0D]+|([:;])[\x20\x09]*\n", r"\n[\x20\x09-\x0D]*\n"
DROPPED, EDGES = r"[^a-z0-9.+/-]+", r"^[ ./+-]+|[ ./-]+$"


def normalised(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(s), DROPPED, " "), EDGES, "")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def identifier(sentence: Column) -> Column:
    """The identifier of a sentence, or null."""
    def known(n: Column) -> Column:
        named = lambda pattern, kind: F.concat(F.lit(f"{kind}:"), _lookup(NAMES, F.regexp_extract(n, pattern, 1)))
        return (F.when(n.rlike(COPYRIGHT), F.lit("copyright")).when(n.rlike(SPDX), named(SPDX, "spdx")).when(n.rlike(GRANT), named(GRANT, "grant")).otherwise(_lookup(SENTENCES, n)))

    return let(normalised(sentence), lambda n: F.when(n.rlike(CUE), known(n)).when(n.rlike(GRANT), known(n)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_license_like, sentence_ids and licenses (comma-joined, sorted) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = F.split(F.regexp_replace(text, END_MARK, "$1$2\n\n"), BLANK)

    def ids(chunk: Column) -> Column:
        # a chunk is a sentence, wrapped or not; else its lines are tried on their own
        return let(F.array(identifier(chunk)), lambda own: F.when(own[0].isNotNull(), own).otherwise(F.transform(F.split(chunk, "\n"), identifier)))

    # as wide as the rules: what normalisation turns into a blank may stand between the words
    any_cue = "(?i)" + f"{CUE}|(?:licen[cs]ed|released|distributed|published|provided|available) under".replace(" ", DROPPED)
    found = docs.select("doc_id", F.when(text.rlike(any_cue), F.filter(F.flatten(F.transform(chunks, ids)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("ids"),
                        F.when(text.rlike(any_cue), F.size(F.filter(chunks, lambda c: c.rlike(f"(?i){CUE}")))).otherwise(0).cast("long").alias("n_license_like"))
    # each rule in turn reports its license and takes its identifiers out of the sequence
    state = F.struct(F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("got"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(seq)).alias("pattern"), F.lit(rule_left(seq)).alias("left")) for name, seq in RULES])
    done = F.aggregate(rules, state, lambda acc, r: F.when(F.rlike(acc["rest"], r["pattern"]), F.struct(F.regexp_replace(acc["rest"], r["pattern"], r["left"]).alias("rest"), F.array_append(acc["got"], r["name"]).alias("got"))).otherwise(acc))
    direct = lambda s: F.transform(F.filter(F.split(s["rest"], " "), lambda x: x.rlike("^(?:grant|spdx):")), lambda x: F.regexp_replace(x, "^[a-z]+:", ""))
    licenses = let(done, lambda s: F.array_sort(F.array_distinct(F.concat(s["got"], direct(s)))))
    return found.select("doc_id", "n_license_like", F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, F.array_join(licenses, ",")).otherwise("").alias("licenses"))


def rule_pattern(seq: tuple[str, ...]) -> str:
    """The identifiers in order, each closed by blanks, with the fewest others between them."""
    return " " + r"((?:\S+ )*?)".join(s.replace(".", r"\.") + " " for s in seq)


def rule_left(seq: tuple[str, ...]) -> str:
    """What stays of a match: the identifiers between."""
    return " " + "".join(f"${i}" for i in range(1, len(seq)))
