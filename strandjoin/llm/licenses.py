"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences; sentences with a word that licences use are normalised (lower case,
comment marks and punctuation dropped, white space folded; lines that only
name a copyright holder are passed over) and searched for known licence sentences, each with an identifier.
A known sentence may begin and end at any line, or part before a colon or semicolon, and may be wrapped.  A notice, "(this file is) licensed under
the" and a licence's name, may end at any word, and further names may follow after "or" or "and"; what is left between known sentences counts too if
all of it is one.  The document's sequence of identifiers is then
matched against ordered licence rules: a rule is a run of identifiers, longer and more specific rules
come first, and what a rule has matched is taken out before the next one looks.  Each run gives a licence with
the run's own version, or one for each identifier of an SPDX expression (an exception stays with its licence); equal ones are listed once.  Sentences with licence
words that are not known are kept as ``unknown`` in the sequence, so a run never reaches across one.  A whole licence text is recognised by
its title and its opening sentences; the sentences of its body are ``unknown``.

``status``: ``none`` (no licence words), ``known`` (every sentence with licence words was used by a rule),
``partial`` (some were), ``unknown`` (none was).

A null or empty text is ``none`` with empty results.  Texts without licence words cost one pattern
match; very long texts are taken whole.  Repeated rows get repeated results, ties cannot arise (rules are tried in their order), and an empty
table gives an empty one.  Columns named like the outputs are replaced, all others kept.  Everything is
one narrow projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, table, without

OUT = ("license_sentences", "n_license_sentences", "licenses", "license_status")

# Words that make a sentence worth a look.
CRITICAL = r"(?i)\b(licen[cs]e[ds]?|licensing|copyright|spdx|warrant(?:y|ies)|redistribut\w*|public\W+domain|permission\W+(?:is|to)|creative\W+commons|cc\W+by|cc ?0|rights\W+reserved|[al]?gplv?[0-9]*|altered\W+source|altered\W+from|as\W+is)\b"

# Names of licences in notices, after normalisation (versions as #), and their identifiers.
NAMES = {
    "apache license version #": "apache.notice",
    "apache license #": "apache.notice",
    "apache software license version #": "apache.notice",
    "apache # license": "apache.notice",
    "mit license": "mit.notice",
    "mit licence": "mit.notice",
    "expat license": "mit.notice",
    "isc license": "isc.notice",
    "zlib license": "zlib.notice",
    "zlib libpng license": "zlib.notice",
    "boost software license version #": "bsl.notice",
    "unlicense": "unlicense.notice",
    "eclipse public license version #": "epl.notice",
    "eclipse public license v #": "epl.notice",
    "eclipse public license #": "epl.notice",
    "european union public licence version #": "eupl.notice",
    "common development and distribution license version #": "cddl.notice",
    "artistic license version #": "artistic.notice",
    "artistic license #": "artistic.notice",
    "mozilla public license version #": "mpl.notice",
    "mozilla public license v #": "mpl.notice",
    "mozilla public license #": "mpl.notice",
    "gnu general public license version #": "gpl.notice",
    "gnu general public license v #": "gpl.notice",
    "gnu gpl version #": "gpl.notice",
    "gnu gpl v #": "gpl.notice",
    "gpl version #": "gpl.notice",
    "gpl v #": "gpl.notice",
    "gplv #": "gpl.notice",
    "gnu general public license version # or later": "gpl.plus",
    "gnu general public license version # or any later version": "gpl.plus",
    "gpl version # or later": "gpl.plus",
    "gplv # or later": "gpl.plus",
    "gnu lesser general public license version #": "lgpl.notice",
    "gnu lesser general public license version # or later": "lgpl.plus",
    "gnu library general public license version #": "lgpl.notice",
    "lgpl version #": "lgpl.notice",
    "lgplv #": "lgpl.notice",
    "gnu affero general public license version #": "agpl.notice",
    "gnu affero general public license version # or later": "agpl.plus",
    "agplv #": "agpl.notice",
    "bsd license": "bsd.notice",
    "new bsd license": "bsd.notice3",
    "modified bsd license": "bsd.notice3",
    "bsd 3 clause license": "bsd.notice3",
    "3 clause bsd license": "bsd.notice3",
    "simplified bsd license": "bsd.notice2",
    "bsd 2 clause license": "bsd.notice2",
    "2 clause bsd license": "bsd.notice2",
    "cc by nc nd #": "ccbyncnd.notice",
    "cc by nc sa #": "ccbyncsa.notice",
    "cc by nc #": "ccbync.notice",
    "cc by nd #": "ccbynd.notice",
    "cc by sa #": "ccbysa.notice",
    "cc by #": "ccby.notice",
    "cc 0 #": "cc0.notice",
    "cc 0": "cc0.notice",
    "creative commons attribution # international license": "ccby.notice",
    "creative commons attribution sharealike # international license": "ccbysa.notice",
    "creative commons attribution noncommercial # international license": "ccbync.notice",
    "creative commons attribution noncommercial sharealike # international license": "ccbyncsa.notice",
    "creative commons zero v # universal": "cc0.notice",
}

# Other known sentences after normalisation (versions as #) and their identifiers.
SENTENCES = {
    **{f"licensed under {name}": identifier for name, identifier in NAMES.items()},
    "licensed under the apache license version # the license": "apache.notice",
    "you may not use this file except in compliance with the license": "apache.comply",
    "you may obtain a copy of the license at": "apache.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache.asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache.see",
    "apache license version # january 2004": "apache.title",
    "mit license": "mit.title",
    "the mit license": "mit.title",
    "the mit license mit": "mit.title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.include",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit.liable",
    "isc license": "isc.title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd.grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc.asis",
    "this software is provided as is without any express or implied warranty": "zlib.asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib.grant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib.altered",
    "this notice may not be removed or altered from any source distribution": "zlib.notice2",
    "boost software license version # august 17 th 2003": "bsl.title",
    "distributed under the boost software license version #": "bsl.notice",
    "this is free and unencumbered software released into the public domain": "unlicense.notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v #": "epl.notice",
    "eclipse public license v #": "epl.title",
    "gnu general public license version # 29 june 2007": "gpl.title",
    "gnu general public license version # june 1991": "gpl.title",
    "gnu lesser general public license version # 29 june 2007": "lgpl.title",
    "gnu lesser general public license version # february 1999": "lgpl.title",
    "gnu affero general public license version # 19 november 2007": "agpl.title",
    "mozilla public license version #": "mpl.title",
    "creative commons legal code": "cc.legal",
    "cc 0 1.0 universal": "cc0.title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version": "gpl.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version # of the license": "gpl.only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation": "gpl.only",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "see the gnu general public license for more details": "gpl.see",
    "you should have received a copy of the gnu general public license along with this program": "gpl.received",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "lgpl.later",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "see the gnu lesser general public license for more details": "lgpl.see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version # of the license or at your option any later version": "agpl.later",
    "see the gnu affero general public license for more details": "agpl.see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd.asis",
    "released into the public domain": "pd.notice",
    "this work is in the public domain": "pd.notice",
    "all rights reserved": "rights",
    "this source code form is subject to the terms of the mozilla public license v #": "mpl.notice",
}

# Licence rules in the order in which they are tried; # is the version of the run's first sentence that has one.
RULES = (
    ("Apache-#", ("apache.notice", "apache.comply", "apache.copy", "apache.asis", "apache.see")),
    ("Apache-#", ("apache.notice", "apache.comply", "apache.copy")),
    ("Apache-#", ("apache.title",)),
    ("Apache-#", ("apache.notice",)),
    ("MIT", ("mit.title", "mit.grant", "mit.include", "mit.asis", "mit.liable")),
    ("MIT", ("mit.grant", "mit.include", "mit.asis", "mit.liable")),
    ("MIT", ("mit.grant", "mit.include", "mit.asis")),
    ("MIT", ("mit.grant", "mit.include")),
    ("MIT", ("mit.title",)),
    ("MIT", ("mit.notice",)),
    ("ISC", ("isc.title", "isc.grant", "isc.asis")),
    ("ISC", ("isc.grant", "isc.asis")),
    ("ISC", ("isc.grant",)),
    ("ISC", ("isc.title",)),
    ("ISC", ("isc.notice",)),
    ("0BSD", ("0bsd.grant", "isc.asis")),
    ("0BSD", ("0bsd.grant",)),
    ("Zlib", ("zlib.asis", "zlib.grant", "zlib.altered", "zlib.notice2")),
    ("Zlib", ("zlib.asis", "zlib.grant")),
    ("Zlib", ("zlib.grant",)),
    ("Zlib", ("zlib.notice",)),
    ("BSL-#", ("bsl.title",)),
    ("BSL-#", ("bsl.notice",)),
    ("Unlicense", ("unlicense.notice",)),
    ("EPL-#", ("epl.title",)),
    ("EPL-#", ("epl.notice",)),
    ("EUPL-#", ("eupl.notice",)),
    ("CDDL-#", ("cddl.notice",)),
    ("Artistic-#", ("artistic.notice",)),
    ("AGPL-#+", ("agpl.later", "gpl.warranty", "agpl.see")),
    ("AGPL-#+", ("agpl.later",)),
    ("AGPL-#+", ("agpl.plus",)),
    ("AGPL-#", ("agpl.title",)),
    ("AGPL-#", ("agpl.notice",)),
    ("LGPL-#+", ("lgpl.later", "gpl.warranty", "lgpl.see")),
    ("LGPL-#+", ("lgpl.later",)),
    ("LGPL-#+", ("lgpl.plus",)),
    ("LGPL-#", ("lgpl.title",)),
    ("LGPL-#", ("lgpl.notice",)),
    ("GPL-#+", ("gpl.later", "gpl.warranty", "gpl.see", "gpl.received")),
    ("GPL-#+", ("gpl.later", "gpl.warranty", "gpl.see")),
    ("GPL-#+", ("gpl.later",)),
    ("GPL-#+", ("gpl.plus",)),
    ("GPL-#", ("gpl.only", "gpl.warranty", "gpl.see")),
    ("GPL-#", ("gpl.only",)),
    ("GPL-#", ("gpl.title",)),
    ("GPL-#", ("gpl.notice",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.asis")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", ("bsd.notice3",)),
    ("BSD-2-Clause", ("bsd.notice2",)),
    ("BSD", ("bsd.notice",)),
    ("MPL-#", ("mpl.title",)),
    ("MPL-#", ("mpl.notice",)),
    ("CC-BY-NC-ND-#", ("ccbyncnd.notice",)),
    ("CC-BY-NC-SA-#", ("ccbyncsa.notice",)),
    ("CC-BY-NC-#", ("ccbync.notice",)),
    ("CC-BY-ND-#", ("ccbynd.notice",)),
    ("CC-BY-SA-#", ("ccbysa.notice",)),
    ("CC-BY-#", ("ccby.notice",)),
    ("CC0-1.0", ("cc.legal", "cc0.title")),
    ("CC0-1.0", ("cc0.title",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("SPDX:#", ("spdx",)),
    ("public-domain", ("pd.notice",)),
    ("proprietary", ("rights",)),
)

VERSION = r"[0-9]+(?:\.[0-9]+)*"
#: One identifier, and an expression of them.
SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?(?::[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)?"
SPDX_LIST = rf"[( \t]*{SPDX_ID}(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[( \t]+{SPDX_ID}(?:[ \t]*\))*)*"
SPDX = rf"(?i)spdx-license-identifier=({SPDX_LIST})"

#: A line that begins with a copyright holder, and where the holder may end in it.
HOLDER = r"(?i)^\W*(?:\(c\)\W*)?copyright\b"
HOLDER_END = r"(?i),\s*|\s[-–—]+\s|[()]|\s+(?=all\s+rights\s+reserved|(?:licensed|released)\s+under)"

#: What may stand before the name in a notice, and before a further name.
SUBJECT = r"(?:(?:this|the)[ |][a-z]+(?:[ |][a-z]+)?[ |](?:is|are|has[ |]been|have[ |]been)[ |])?"
VERB = r"(?:dual[ |])?(?:licensed|released|distributed|published|provided|available|made[ |]available)[ |]under[ |](?:the[ |])?(?:terms[ |](?:and[ |]conditions[ |])?of[ |](?:the[ |])?)?(?:an?[ |])?"
FURTHER = r"\G[ |]?(?:or|and)[ |](?:under[ |])?(?:the[ |])?"
NOTICE = "licensed under "


def _any(sentences: list[str]) -> str:
    written = lambda s: "[ |]".join("[0-9.]+" if w == "#" else w for w in s.split(" "))
    return "|".join(written(s) for s in sorted(sentences, key=lambda s: (-len(s), s)))


#: Known sentences in the text of ``lines``: each begins and ends with a line, and may be wrapped over several.
KNOWN = rf"(?<![^|])(?:{_any([s for s in SENTENCES if not s.startswith(NOTICE) or s[len(NOTICE):] not in NAMES])})(?![^|])"
#: A notice begins with a line, and ends with a word.
NAMED = rf"(?:(?<![^|]){SUBJECT}{VERB}|{FURTHER})(?:{_any(list(NAMES))})(?![^ |])"
FOUND = rf"({KNOWN}|{NAMED})"


def sentences(text: Column) -> Column:
    """Sentences of a text: comment marks go, SPDX lines stand alone; an abbreviated version (v. 2) ends none."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+)[ \t]?", "")
    t = F.regexp_replace(t, r"(?i)(spdx-license-identifier):\s*(" + SPDX_LIST + ")", "\n\n$1=$2\n\n")
    return F.split(t, r"(?i)(?<=[.!?])(?<!\bv\.)\s+|\n\s*\n")


def lines(sentence: Column) -> Column:
    """A sentence in lower case with words and version numbers only; ``|`` stands where a line, or a part before ``;`` or ``:``, ends.

    In a line that begins with copyright each part is one, as what follows the holder may be a licence.
    """
    s = F.regexp_replace(sentence, r"[;:]\s+", "\n")
    parts = lambda x: F.when(x.rlike(HOLDER), F.regexp_replace(x, HOLDER_END, "\n")).otherwise(x)
    s = F.when(s.rlike("(?m)" + HOLDER), F.array_join(F.transform(F.split(s, "\n"), parts), "\n")).otherwise(s)
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9.\n]+", " ")
    s = F.regexp_replace(s, r"(?<![0-9])\.|\.(?![0-9])", " ")
    s = F.regexp_replace(s, r"[0-9][0-9.]*", " $0 ")
    return trimmed(F.regexp_replace(F.regexp_replace(s, r"\s*\n\s*", "|"), " +", " "))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ |]+|[ |]+$", "")


def unknown(part: Column) -> Column:
    """Whether licence words stand in what is between known sentences, besides lines that only name a copyright holder."""
    other = F.filter(F.split(part, r"\|"), lambda x: ~x.startswith("copyright") | F.regexp_replace(x, "^copyright", "").rlike(CRITICAL))
    return F.array_join(other, " ").rlike(CRITICAL)


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``license_sentences`` (identifiers in order), their number, ``licenses`` (in order of rules) and ``license_status``."""
    held, sent, ruled = fresh(df, "_text", "_sent", "_state")
    df = without(df.withColumn(held, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), *OUT)
    text = F.col(held)
    versioned = {re.sub(VERSION, "#", s): i for s, i in SENTENCES.items() if "#" in s}
    known = F.create_map(*[F.lit(x) for pair in {**versioned, **SENTENCES}.items() for x in pair])

    def named(part: Column) -> Column:
        """Identifier and version of a part that is a known sentence, as it is or with # for each number."""
        whole = F.translate(part, "|", " ")
        plain = F.regexp_replace(whole, "^" + SUBJECT + VERB + "|^(?:or|and) (?:under )?(?:the )?", NOTICE)
        keys = [x for y in (whole, plain) for x in (y, F.regexp_replace(y, VERSION, "#"))]
        return F.struct(F.coalesce(*[F.try_element_at(known, k) for k in keys], F.lit("unknown")).alias("id"), F.regexp_extract(part, VERSION, 0).alias("version"))

    def recognise(s: Column) -> Column:
        spdx = F.regexp_extract(s, SPDX, 1)
        parts = F.transform(F.split(F.regexp_replace(lines(s), FOUND, "\n$1\n"), "\n"), trimmed)
        rest = F.filter(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(x.alias("part"), named(x).alias("named"))), lambda x: (x["named"]["id"] != "unknown") | unknown(x["part"]))
        return F.when(spdx != "", F.array(F.struct(F.lit("spdx").alias("id"), spdx.alias("version")))).otherwise(F.transform(rest, lambda x: x["named"]))

    worth = F.filter(sentences(text), lambda s: s.rlike(CRITICAL))
    found = F.when(text.rlike(CRITICAL), F.flatten(F.transform(worth, recognise))).otherwise(F.array().cast("array<struct<id:string,version:string>>"))

    def names(license: Column, run: Column) -> Column:
        """Of one run: its own version, or each identifier of its expression."""
        version = F.regexp_extract(run, "=([^,]+),", 1)
        each = F.filter(F.regexp_extract_all(version, F.lit(rf"(?i){SPDX_ID}(?:\s+WITH\s+{SPDX_ID})?"), F.lit(0)), lambda x: ~F.upper(x).isin("AND", "OR"))
        return F.when(run.startswith(",spdx="), F.transform(each, lambda x: F.replace(license, F.lit("#"), x))).otherwise(F.array(F.replace(license, F.lit("#"), version)))

    def apply(state: Column, rule: Column) -> Column:
        runs = F.regexp_extract_all(state["rest"], rule["run"], F.lit(0))
        out = F.concat(state["out"], F.flatten(F.transform(runs, lambda x: names(rule["license"], x))))
        return F.when(F.size(runs) > 0, F.struct(F.regexp_replace(state["rest"], rule["run"], F.lit(",used,")).alias("rest"), out.alias("out"))).otherwise(state)

    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit("".join(f",{re.escape(x)}=[^,]*," for x in run)).alias("run")) for name, run in RULES])
    zero = F.struct(F.concat(F.lit(","), F.array_join(F.transform(sent, lambda x: F.concat(x["id"], F.lit("="), x["version"])), ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("out"))
    state = F.when(F.size(sent) > 0, F.aggregate(rules, zero, apply))
    rest = F.col(ruled)["rest"]
    left = F.replace(rest, F.lit(",used,"), F.lit(""))
    status = F.when(F.size(sent) == 0, "none").when(left == "", "known").when(F.contains(rest, F.lit(",used,")), "partial").otherwise("unknown")
    return (
        df.withColumn(sent, found)
        .withColumn(ruled, state)
        .withColumn("license_sentences", F.transform(sent, lambda x: x["id"]))
        .withColumn("n_license_sentences", F.size(sent).cast("long"))
        .withColumn("licenses", F.coalesce(F.array_distinct(F.col(ruled)["out"]), F.array().cast("array<string>")))
        .withColumn("license_status", status)
        .drop(held, sent, ruled)
    )


def op1_license_scan(spark, sf_dir):
    """Licences of every whole text."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_license_sentences", F.array_join("license_sentences", ",").alias("license_sentences"), F.array_join("licenses", ",").alias("licenses"), "license_status")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
