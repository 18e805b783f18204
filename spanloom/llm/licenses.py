"""Licence scans: sentences to identifiers, identifier sequences to licences by ordered rules.

All in DataFrame functions. A text is cut into sentences, those with a licence word are normalised (lower case, runs of other
characters than letters and digits as one blank, a tail such as "see LICENSE" off) and looked up among the known licence sentences: wording
of notices and whole licences, and the short forms in which licences are named, SPDX tags included. The identifiers found, in
text order, form a sequence, and the rules are tried on it in order: a rule matches where its identifiers follow one another
(with any unknown sentences between), and what it matches is taken out, so later, shorter rules see only the rest. That all rights are
reserved, which stands in notices of free licences too, counts only where no other rule matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normalised form, from the end of a sentence back as far as their wording is the same everywhere (the
# holder's name stands before "names of its contributors"). None runs over a SENTENCE_END of the real text, such as the colon after "conditions" or the blank in "v. 2.0".
SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-warranty", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-header", "licensed under the apache license version 2 0 the license"),
    ("apache-except", "you may not use this file except in compliance with the license"),
    ("gpl-free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "see the gnu general public license for more details"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("either-2-later", "either version 2 of the license or at your option any later version"),
    ("lgpl-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("either-2-1-later", "either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-warranty", "see the gnu lesser general public license for more details"),
    ("agpl-free", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-warranty", "see the gnu affero general public license for more details"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("bsl-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("epl-materials", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("cc0-dedicated", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("perl-terms", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("apache-title", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("apache-terms", "terms and conditions for use reproduction and distribution"),
    ("gpl3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl2-title", "gnu general public license version 2 june 1991"),
    ("lgpl3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21-title", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl3-title", "gnu affero general public license version 3 19 november 2007"),
    ("copies-only", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mpl2-title", "mozilla public license version 2 0"),
    ("epl2-title", "eclipse public license v 2 0"),
    ("epl2-terms", "the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cc0-title", "cc0 1 0 universal"),
    ("cc-by-title", "creative commons attribution 4 0 international public license"),
    ("cc-by-sa-title", "creative commons attribution sharealike 4 0 international public license"),
    ("rights-reserved", "all rights reserved"),
)
# Licences with their kind and the names by which short forms call them, normalised.
NAMES = (
    ("MIT", "permissive", ("mit license", "mit licence", "mit")),
    ("ISC", "permissive", ("isc license", "isc")),
    ("BSD-2-Clause", "permissive", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause")),
    ("BSD-3-Clause", "permissive", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "revised bsd license", "modified bsd license", "bsd 3 clause")),
    ("Apache-2.0", "permissive", ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache 2 license")),
    ("Zlib", "permissive", ("zlib license", "zlib")),
    ("BSL-1.0", "permissive", ("boost software license version 1 0", "boost software license 1 0", "boost software license", "bsl 1 0")),
    ("Unlicense", "permissive", ("unlicense",)),
    ("CC0-1.0", "permissive", ("cc0 1 0", "cc0 1 0 universal license", "creative commons zero v1 0 universal license", "cc0")),
    ("CC-BY-4.0", "permissive", ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license")),
    ("MPL-2.0", "copyleft", ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0")),
    ("EPL-2.0", "copyleft", ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0")),
    ("LGPL-2.1-only", "copyleft", ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl v2 1", "lgplv2 1")),
    ("LGPL-3.0-only", "copyleft", ("gnu lesser general public license version 3", "gnu lesser general public license version 3 0", "gnu lesser general public license v3 0", "lgpl 3 0", "lgpl 3 0 only", "lgpl v3", "lgplv3")),
    ("AGPL-3.0-only", "copyleft", ("gnu affero general public license version 3", "gnu affero general public license version 3 0", "gnu affero general public license v3 0", "agpl 3 0", "agpl 3 0 only", "agpl v3", "agplv3")),
    ("GPL-2.0-only", "copyleft", ("gnu general public license version 2", "gnu general public license version 2 0", "gnu general public license v2 0", "gnu gpl v2", "gpl 2 0", "gpl 2 0 only", "gpl v2", "gplv2")),
    ("GPL-2.0-or-later", "copyleft", ("gnu general public license version 2 or later", "gpl 2 0 or later", "gplv2 or later")),
    ("GPL-3.0-only", "copyleft", ("gnu general public license version 3", "gnu general public license version 3 0", "gnu general public license v3 0", "gnu gpl v3", "gpl 3 0", "gpl 3 0 only", "gpl v3", "gplv3")),
    ("GPL-3.0-or-later", "copyleft", ("gnu general public license version 3 or later", "gpl 3 0 or later", "gplv3 or later")),
    ("CC-BY-SA-4.0", "copyleft", ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license")),
    ("CC-BY-NC-4.0", "noncommercial", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
)
#: What stands before a name that is to be looked up, in a normalised sentence.
FORM = " (?:(?:licensed|released|distributed|available|provided) under(?: the terms of)?(?: the)?|under the terms of the|spdx license identifier) (.*)$"
# Rules in order, each a licence, its kind and the sentences that must follow one another.
RULES = (
    ("BSD-4-Clause", "permissive", ("bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("BSD-3-Clause", "permissive", ("bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "permissive", ("bsd-source", "bsd-binary")),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty")),
    ("ISC", "permissive", ("isc-grant", "isc-warranty")),
    ("Apache-2.0", "permissive", ("apache-header", "apache-except")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-warranty")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl-free", "agpl-warranty")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-free", "lgpl-warranty")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-terms", "either-2-1-later", "lgpl-warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl-terms", "either-2-later", "gpl-warranty")),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-grant")),
    ("Unlicense", "permissive", ("unlicense-free", "unlicense-grant")),
    ("BSL-1.0", "permissive", ("bsl-grant",)),
    ("Apache-2.0", "permissive", ("apache-title", "apache-terms")),
    ("GPL-3.0-only", "copyleft", ("gpl3-title",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-title",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl3-title",)),
    ("LGPL-2.1-only", "copyleft", ("lgpl21-title",)),
    ("AGPL-3.0-only", "copyleft", ("agpl3-title",)),
    ("MPL-2.0", "copyleft", ("mpl2-title",)),
    ("EPL-2.0", "copyleft", ("epl2-title", "epl2-terms")),
    ("CC0-1.0", "permissive", ("cc0-title",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-title",)),
    ("CC-BY-4.0", "permissive", ("cc-by-title",)),
    ("EPL-2.0", "copyleft", ("epl-materials",)),
    ("CC0-1.0", "permissive", ("cc0-dedicated",)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "copyleft", ("perl-terms",)),
    ("MPL-2.0", "copyleft", ("mpl-notice",)),
) + tuple((licence, kind, (f"named-{licence}",)) for licence, kind, _ in NAMES)
#: What counts only where no rule matches.
LAST = ("Proprietary", "proprietary", ("rights-reserved",))
#: Kinds from the least to the most restrictive.
KINDS = ("permissive", "copyleft", "noncommercial", "proprietary")
SENTENCE_END = r"[.!?;:]\s+|\n\s*\n"
LICENCE_WORD = "licen|rights reserved|permission|permitted|redistribut|software|public domain|under|contributors|materials|terms and conditions|cc0"
SPDX = r"spdx-license-identifier:\s*([a-z0-9.+-]+)"
TAIL = " see (the )?(licen[cs]e|copying|notice).*$"


def _found(rules, seq):
    """Fold the ordered rules over the sequence: the licences matched so far, and the last rule where none was."""
    hits = []
    for name, kind, ids in rules:
        pattern = "".join(f"<{i}>" for i in ids)
        hits.append((name, kind, seq.contains(pattern)))
        seq = F.replace(seq, F.lit(pattern), F.lit("|"))
    return hits


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every whole text.

    ``docs``: ``doc_id``, ``text``; other columns are not read. Returns ``doc_id``, ``n_known`` (known licence sentences),
    ``sentence_ids`` (in text order, with ``>`` and ``<`` around each), ``licenses`` (names in rule order, separated by commas,
    each once; empty if none) and ``kind`` (the most restrictive of them, ``none`` without any). A sentence counts as known if
    it is one of the known ones or ends in one. Null and empty texts have none; null ids and repeated rows are kept; an empty
    table gives no rows.
    """
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f" {s}").alias("text")) for i, s in SENTENCES])
    names = F.create_map(*[F.lit(x) for licence, _, own in NAMES for name in own for x in (name, f"named-{licence}")])
    lower = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPDX, ". spdx-license-identifier $1. ")
    likely = F.filter(F.split(lower, SENTENCE_END), lambda s: s.rlike(LICENCE_WORD))
    normal = F.transform(likely, lambda s: F.regexp_replace(F.concat(F.lit(" "), F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), TAIL, ""))
    of = lambda s: F.coalesce(F.element_at(names, F.regexp_extract(s, FORM, 1)), F.get(F.filter(known, lambda k: F.endswith(s, k["text"])), F.lit(0))["id"])
    ids = F.filter(F.transform(normal, of), lambda i: i.isNotNull())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"))
    seq = base.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("sentence_ids"))
    hits = _found(RULES, F.col("sentence_ids"))
    some = reduce(Column.__or__, [hit for _, _, hit in hits])
    hits.append((*LAST[:2], ~some & F.col("sentence_ids").contains(f"<{LAST[2][0]}>")))
    flags = seq.select("*", F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, hit in hits])).alias("hits"))
    kind = F.coalesce(*[F.when(F.array_contains(F.col("hits.kind"), k), F.lit(k)) for k in reversed(KINDS)], F.lit("none"))
    return flags.select("doc_id", "n_known", "sentence_ids", F.array_join(F.array_distinct("hits.name"), ",").alias("licenses"), kind.alias("kind"))


def oracle_sql() -> str:
    """The same scan for DuckDB, over a table ``documents``."""
    known = ", ".join(f"{{'id': '{i}', 'text': ' {s}'}}" for i, s in SENTENCES)
    columns, seq = [], "sentence_ids"
    for k, (_, _, ids) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in ids)
        columns.append(f"contains({seq}, '{pattern}') AS r{k}")
        seq = f"replace({seq}, '{pattern}', '|')"
    rules = [*RULES, LAST]
    columns.append(f"({' OR '.join(f'r{k}' for k in range(len(RULES)))}) IS FALSE AND contains(sentence_ids, '<{LAST[2][0]}>') AS r{len(RULES)}")
    short = ", ".join(f"'{name}': 'named-{licence}'" for licence, _, own in NAMES for name in own)
    names = ", ".join(f"CASE WHEN r{k} THEN '{n}' END" for k, (n, _, _) in enumerate(rules))
    kinds = " ".join(f"WHEN {' OR '.join(f'r{k}' for k, r in enumerate(rules) if r[1] == kind)} THEN '{kind}'" for kind in reversed(KINDS))
    return f"""
WITH s AS (
  SELECT doc_id, list_transform(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '{SPDX}', '. spdx-license-identifier \\1. ', 'g'), '{SENTENCE_END}'), lambda s: regexp_matches(s, '{LICENCE_WORD}')),
    lambda s: regexp_replace(' ' || trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '{TAIL}', '')) AS sentences FROM documents
), i AS (
  SELECT doc_id, list_filter(list_transform(sentences, lambda s: coalesce(element_at(MAP {{{short}}}, regexp_extract(s, '{FORM}', 1))[1], list_filter([{known}], lambda k: ends_with(s, k.text))[1].id)), lambda x: x IS NOT NULL) AS ids FROM s
), q AS (
  SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS sentence_ids FROM i
), r AS (SELECT *, {', '.join(columns)} FROM q)
SELECT doc_id, n_known, sentence_ids,
  coalesce(array_to_string(list_reduce(list_prepend([], list_transform(list_filter([{names}], lambda x: x IS NOT NULL), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END), ','), '') AS licenses,
  CASE {kinds} ELSE 'none' END AS kind
FROM r
"""
