"""License scans: normalised sentences become identifiers of known licence sentences, and sequences of identifiers are
matched against ordered licence rules.

A text is cut into segments at line ends and after . ! ? before white space. A segment is normalised to its letters
a-z and digits, in lower case, as a list of words. Known sentences stand in a word trie; from the beginning of each
segment (behind a list mark, if it has one) the trie is walked over as many segments as the sentence is wrapped over,
and a sentence counts where it ends with a segment. The identifiers found, by position, form the text's sequence; a
rule fits if its identifiers stand in it in the rule's order, and the first rule that fits names the licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from reelmill.llm._shared import LOWER, UPPER

#: Fixed values: (identifier, sentence) of public licence notices.
NOTICES = (
    ("apache-2-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2-title", "Apache License Version 2.0, January 2004"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit-line", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl-2-line", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("mpl-2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-line", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse-org", "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse-author", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-advertise", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("lgpl-21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3-free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("isc-as-is", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("bsl-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("cc0-waive", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("rights-reserved", "All rights reserved."),
)
#: Public licence identifiers, and the names by which texts call them.
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0"),
    ("Apache-1.1", "Apache Software License, Version 1.1"),
    ("MIT", "MIT License"),
    ("MIT-0", "MIT No Attribution License"),
    ("ISC", "ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    ("BSD-4-Clause", "BSD 4-Clause License", "Original BSD License"),
    ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
    ("libpng-2.0", "PNG Reference Library License version 2"),
    ("GPL-1.0-only", "GNU General Public License, version 1"),
    ("GPL-2.0-only", "GNU General Public License, version 2", "GNU GPL v2"),
    ("GPL-3.0-only", "GNU General Public License, version 3", "GNU GPL v3"),
    ("GPL-2.0-or-later", "GNU General Public License, version 2 or later"),
    ("GPL-3.0-or-later", "GNU General Public License, version 3 or later"),
    ("LGPL-2.0-only", "GNU Library General Public License, version 2"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1 or later"),
    ("LGPL-3.0-or-later", "GNU Lesser General Public License, version 3 or later"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0-or-later", "GNU Affero General Public License, version 3 or later"),
    ("MPL-1.1", "Mozilla Public License, version 1.1"),
    ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-1.0", "Eclipse Public License 1.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("CDDL-1.0", "Common Development and Distribution License 1.0"),
    ("CPL-1.0", "Common Public License 1.0"),
    ("EUPL-1.1", "European Union Public Licence, version 1.1"),
    ("EUPL-1.2", "European Union Public Licence, version 1.2"),
    ("CECILL-2.1", "CeCILL Free Software License Agreement v2.1"),
    ("OSL-3.0", "Open Software License 3.0"),
    ("AFL-3.0", "Academic Free License v3.0"),
    ("Artistic-1.0", "Artistic License 1.0"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("PSF-2.0", "Python Software Foundation License 2.0"),
    ("Python-2.0", "Python License 2.0"),
    ("Ruby", "Ruby License"),
    ("PHP-3.01", "PHP License, version 3.01"),
    ("W3C", "W3C Software Notice and License"),
    ("OpenSSL", "OpenSSL License"),
    ("PostgreSQL", "PostgreSQL License"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("UPL-1.0", "Universal Permissive License v1.0"),
    ("MS-PL", "Microsoft Public License"),
    ("MS-RL", "Microsoft Reciprocal License"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    ("Unlicense", "Unlicense"),
    ("WTFPL", "Do What The F*ck You Want To Public License"),
    ("CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    ("CC-BY-3.0", "CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-3.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("ODbL-1.0", "Open Database License v1.0"),
    ("ODC-By-1.0", "Open Data Commons Attribution License v1.0"),
    ("GFDL-1.3-only", "GNU Free Documentation License, version 1.3"),
)
#: How a text says that it is under a licence of that name.
PHRASES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This project is licensed under the {}.")


def named_sentences(names: tuple = NAMES, phrases: tuple[str, ...] = PHRASES) -> tuple[tuple[str, str], ...]:
    """(identifier, sentence) of each phrase with each name, and of the tag line of each licence identifier."""
    out = [(f"named-{key}", phrase.format(name)) for key, *called in names for name in called for phrase in phrases]
    return (*out, *((f"tag-{key}", f"SPDX-License-Identifier: {key}") for key, *_ in names))


def named_rules(names: tuple = NAMES) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((key, (f"{how}-{key}",)) for key, *_ in names for how in ("named", "tag"))


SENTENCES = (*NOTICES, *named_sentences())
#: Fixed values: (licence, identifiers in order); the first that fits decides, and stricter rules stand first.
RULES = (
    ("Apache-2.0", ("apache-2-notice", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("Apache-2.0", ("apache-2-line",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse-org")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-org")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-author")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("Zlib", ("zlib-grant",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("LGPL-2.1-or-later", ("lgpl-21-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-line",)),
    ("GPL-2.0-only", ("gpl-2-line",)),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-form",)),
    ("EPL-2.0", ("epl-2-terms",)),
    ("EPL-1.0", ("epl-1-terms",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("WTFPL", ("wtfpl-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("Unlicense", ("unlicense",)),
    *named_rules(),
    ("Proprietary", ("rights-reserved",)),
)
_LOWER = str.maketrans(UPPER, LOWER)
_CUT = re.compile(r"\n|(?<=[.!?])[ \t\x0b\f\r]+")
_ODD = re.compile(r"[^a-z0-9]+")


_MARK = re.compile(r"[0-9]{1,2}|[a-z]")


@dataclass(frozen=True)
class Params:
    """sentences: (identifier, sentence), the first of equal sentences counts; rules: (licence, identifiers in order)."""

    sentences: tuple[tuple[str, str], ...] = SENTENCES
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES


def tables(sentences: DataFrame, rules: DataFrame) -> Params:
    """Params from tables sentences (id, sentence) and rules (no, license, ids array<string>), ordered by no. Both are
    reference tables of licences, whose size doesn't grow with the corpus."""
    known = tuple((r["id"], r["sentence"]) for r in sentences.orderBy("id", "sentence").collect())
    return Params(known, tuple((r["license"], tuple(r["ids"])) for r in rules.orderBy("no").collect()))


def normalise(sentence: str) -> str:
    return _ODD.sub(" ", sentence.translate(_LOWER)).strip()


def segments(text: str) -> list[list[str]]:
    """The words of each segment that has any."""
    return [s.split(" ") for part in _CUT.split(text) if (s := normalise(part))]


def _within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    rest = iter(long)
    return all(w in rest for w in short)


class Recogniser:
    """Known sentences as a trie of words, and the words of which any text with a known sentence has one."""

    def __init__(self, params: Params):
        self.params = params
        self.trie: dict = {}
        where: dict[str, set[int]] = {}
        for i, (name, sentence) in enumerate(params.sentences):
            node = self.trie
            for word in normalise(sentence).split(" "):
                node = node.setdefault(word, {})
                where.setdefault(word, set()).add(i)
            node.setdefault("", name)
        #: A sentence stands in a text word for word, so its longer words do; few of them cover all sentences.
        long = [w for w in where if len(w) > 5] or list(where)
        covers = {w: set().union(*(found for x, found in where.items() if w in x)) for w in long}
        open_, self.anchors = set(range(len(params.sentences))), []
        while open_:
            best = max(covers, key=lambda w: (len(covers[w] & open_), w))
            if not covers[best] & open_:
                covers = {w: set(found) for w, found in where.items()}  # sentences of short words alone
                continue
            self.anchors.append(best)
            open_ -= covers[best]
        #: For each rule the earlier rules of other licences that hold it: where one of these fits it names nothing new.
        rules = params.rules
        self.stricter = [[j for j in range(i) if wanted[0] in rules[j][1] and rules[j][0] != name and _within(wanted, rules[j][1])] for i, (name, wanted) in enumerate(rules)]

    def sequence(self, text: str | None) -> list[str]:
        """Identifiers of the known sentences of a text, by position, shorter ones first."""
        low = (text or "").translate(_LOWER)
        if not any(a in low for a in self.anchors):
            return []
        words: list[str] = []
        starts = []
        for part in segments(low):
            starts.append(len(words))
            words += part
        ends = {*starts[1:], len(words)}
        found = []
        for start in starts:
            for at in (start, start + 1) if start + 1 not in ends and _MARK.fullmatch(words[start]) else (start,):
                node = self.trie
                while at < len(words) and (node := node.get(words[at])):
                    at += 1
                    if at in ends and "" in node:
                        found.append(node[""])
        return found

    def licenses(self, sequence: list[str]) -> list[str]:
        """Licences whose rules fit, in the order of the rules."""
        fits: list[int] = []
        held = set(sequence)
        for i, (_, wanted) in enumerate(self.params.rules):
            if wanted[0] in held and _within(wanted, tuple(sequence)) and not any(j in fits for j in self.stricter[i]):
                fits.append(i)
        return list(dict.fromkeys(self.params.rules[i][0] for i in fits))


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, sentence_ids, license, licenses) for every row of docs; lists are joined by commas.

    license is null where no rule fits; sentence_ids and licenses are then as found, maybe ''. Null and empty texts
    have no sentences. A sentence may be wrapped over any number of lines. A text of any length is read whole, in time
    that grows with its length; of rules that fit equally the first in order counts. One pass without a shuffle;
    repeated rows are judged alike, an empty table gives an empty table, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recogniser(params)
        for batch in batches:
            ids = [known.sequence(t.as_py()) for t in batch.column(1)]
            fits = [known.licenses(s) for s in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([",".join(s) for s in ids], type=pa.string()), pa.array([f[0] if f else None for f in fits], type=pa.string()), pa.array([",".join(f) for f in fits], type=pa.string())],
                ["doc_id", "sentence_ids", "license", "licenses"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, sentence_ids string, license string, licenses string")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(params: Params = Params()) -> str:
    sentences = {normalise(s): name for name, s in reversed(params.sentences)}
    known = ", ".join(f"({_quote(name)}, {_quote(s)})" for s, name in sentences.items())
    heads = ", ".join(_quote(h) for h in sorted({s.split(" ")[0] for s in sentences}))
    most = max(s.count(" ") for s in sentences) + 2
    rules = ", ".join(f"({i}, {_quote(name)}, {_quote('%' + '%'.join(f'<{w}>' for w in wanted) + '%')})" for i, (name, wanted) in enumerate(params.rules))
    stricter = ", ".join(f"({i}, {j})" for i, found in enumerate(Recogniser(params).stricter) for j in found) or "(-1, -1)"
    return rf"""
WITH s AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\x0b\f\r]+', '\1' || chr(10), 'g'), chr(10))) AS seg,
         generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\x0b\f\r]+', '\1' || chr(10), 'g'), chr(10)), 1) AS i
  FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(translate(seg, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS seg FROM s),
p AS (SELECT doc_id, list(seg ORDER BY i) AS segs FROM c WHERE seg <> '' GROUP BY doc_id),
t AS (SELECT doc_id, segs, unnest(range(1, len(segs) + 1)) AS pos FROM p),
b AS (SELECT doc_id, pos, segs, regexp_matches(segs[pos], '^([0-9]{{1,2}}|[a-z]) ') AS mark FROM t),
h AS (SELECT doc_id, pos, mark, segs[pos:pos + {most - 1}] AS segs FROM b WHERE mark OR split_part(segs[pos], ' ', 1) IN ({heads})),
w AS (SELECT doc_id, pos, mark, segs, unnest(range(1, len(segs) + 1)) AS w FROM h),
x AS (SELECT doc_id, pos, w, mark, array_to_string(segs[1:w], ' ') AS run FROM w),
y AS (SELECT doc_id, pos, w, 0 AS behind, run FROM x UNION ALL SELECT doc_id, pos, w, 1, regexp_replace(run, '^([0-9]{{1,2}}|[a-z]) ', '') FROM x WHERE mark),
k(name, sentence) AS (VALUES {known}),
r(no, license, pattern) AS (VALUES {rules}),
o(no, by_no) AS (VALUES {stricter}),
m AS (SELECT doc_id, pos, behind, w, name FROM y JOIN k ON run = sentence),
q AS (SELECT doc_id, string_agg(name, ',' ORDER BY pos, behind, w) AS sentence_ids, string_agg('<' || name || '>', '' ORDER BY pos, behind, w) AS marks FROM m GROUP BY doc_id),
e AS (SELECT doc_id, license, no FROM q JOIN r ON marks LIKE pattern),
f AS (SELECT doc_id, license, min(no) AS no FROM e WHERE NOT EXISTS (SELECT 1 FROM o JOIN e f ON f.no = o.by_no WHERE o.no = e.no AND f.doc_id = e.doc_id) GROUP BY doc_id, license),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY no) AS licenses, arg_min(license, no) AS license FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(q.sentence_ids, '') AS sentence_ids, l.license, coalesce(l.licenses, '') AS licenses
FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
