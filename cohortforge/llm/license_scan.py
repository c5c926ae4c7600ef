"""License scan: known licence sentences give identifiers, ordered rules read their sequence."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.arrowtext import chunks
from cohortforge.llm.shared import small_batches

#: Normalised sentences of public licences and notices, and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4-ref",
    "all rights reserved": "all-rights",
}

#: Ordered rules: (sequence of identifiers, licence, group).  The first that fits at a place is taken.
RULES: tuple[tuple[tuple[str, ...], str, str], ...] = (
    (("mit-grant", "mit-notice"), "MIT", "permissive"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause", "permissive"),
    (("apache2-ref", "apache2-comply"), "Apache-2.0", "permissive"),
    (("gpl3-grant",), "GPL-3.0-or-later", "copyleft"),
    (("apache2-ref",), "Apache-2.0", "permissive"),
    (("mit-ref",), "MIT", "permissive"),
    (("mit-grant",), "MIT", "permissive"),
    (("gpl3-ref",), "GPL-3.0", "copyleft"),
    (("gpl2-ref",), "GPL-2.0", "copyleft"),
    (("cc-by-4-ref",), "CC-BY-4.0", "permissive"),
    (("cc-by-sa-4-ref",), "CC-BY-SA-4.0", "copyleft"),
    (("cc-by-nc-4-ref",), "CC-BY-NC-4.0", "restricted"),
    (("all-rights",), "proprietary", "restricted"),
)

#: Names that a reference may give a licence: identifier, licence, group, names.
_NAMES: list[tuple[str, str, str, list[str]]] = [
    ("mit-ref", "MIT", "permissive", ["mit license", "mit licence", "mit", "expat license"]),
    ("apache2-ref", "Apache-2.0", "permissive", ["apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0"]),
    ("bsd2-ref", "BSD-2-Clause", "permissive", ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license", "freebsd license"]),
    ("bsd3-ref", "BSD-3-Clause", "permissive", ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"]),
    ("isc-ref", "ISC", "permissive", ["isc license", "isc licence", "isc"]),
    ("zlib-ref", "Zlib", "permissive", ["zlib license", "zlib libpng license"]),
    ("bsl1-ref", "BSL-1.0", "permissive", ["boost software license version 1 0", "boost software license 1 0"]),
    ("unlicense-ref", "Unlicense", "permissive", ["unlicense"]),
    ("cc0-ref", "CC0-1.0", "permissive", ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"]),
    ("mpl2-ref", "MPL-2.0", "copyleft", ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0", "mpl version 2 0"]),
    ("epl1-ref", "EPL-1.0", "copyleft", ["eclipse public license version 1 0", "eclipse public license v 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0", "epl v1 0"]),
    ("epl2-ref", "EPL-2.0", "copyleft", ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0", "epl v2 0"]),
]
_LATER = ("or later", "or any later version", "or at your option any later version")
#: Grants in the words of the Free Software Foundation, from "under" on.
_GRANTS: dict[str, str] = {}
for _id, _spdx, _longs, _short, _version in (
    ("gpl2", "GPL-2.0", ["gnu general public license"], "gpl", "2"),
    ("gpl3", "GPL-3.0", ["gnu general public license"], "gpl", "3"),
    ("lgpl2", "LGPL-2.0", ["gnu library general public license", "gnu lesser general public license"], "lgpl", "2"),
    ("lgpl21", "LGPL-2.1", ["gnu lesser general public license"], "lgpl", "2 1"),
    ("lgpl3", "LGPL-3.0", ["gnu lesser general public license"], "lgpl", "3"),
    ("agpl3", "AGPL-3.0", ["gnu affero general public license"], "agpl", "3"),
):
    _numbers = [_version] if " " in _version else [_version, f"{_version} 0"]
    _all = [f"{n} {v}{x}" for n in [*_longs, f"gnu {_short}", _short] for v in ("version ", "v", "v ", "") for x in _numbers] + [f"{_short}v{x}" for x in _numbers]
    _NAMES += [(f"{_id}-ref", _spdx, "copyleft", _all), (f"{_id}-later-ref", f"{_spdx}-or-later", "copyleft", [f"{n} {x}" for n in _all for x in _LATER])]
    for _long in _longs:
        _by = f"under the terms of the {_long} as published by the free software foundation"
        for _v in _numbers:
            _GRANTS |= {f"{_by} {w}version {_v}{of} {x}": f"{_id}-grant" for w in ("", "either ") for of in ("", " of the license") for x in _LATER}
            _GRANTS |= {f"{_by} version {_v}{of}": f"{_id}-only-grant" for of in ("", " of the license")}
for _code, _words, _group in (
    ("by", "attribution", "permissive"),
    ("by-sa", "attribution sharealike", "copyleft"),
    ("by-nd", "attribution noderivatives", "restricted"),
    ("by-nc", "attribution noncommercial", "restricted"),
    ("by-nc-sa", "attribution noncommercial sharealike", "restricted"),
    ("by-nc-nd", "attribution noncommercial noderivatives", "restricted"),
):
    _forms = {_words, _words.replace("sharealike", "share alike").replace("noderivatives", "no derivatives").replace("noncommercial", "non commercial")}
    for _v in ("4.0", "3.0", "2.5", "2.0"):
        _n = _v.replace(".", " ")
        _short = f"cc {_code.replace('-', ' ')} {_n}"
        _all = [_short, f"creative commons {_short[3:]}", *(f"creative commons {f} {_n}{x}" for f in _forms for x in ("", " international", " unported"))]
        _NAMES.append((f"cc-{_code}-{_v[0] if _v[-1] == '0' else _v}-ref", f"CC-{_code.upper()}-{_v}", _group, _all))

_LEADS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "provided under", "covered by", "governed by", "subject to", "under the terms of", "license", "licence")

#: All that the scan knows: references by every name, and clauses of the licence texts.
CATALOGUE: dict[str, str] = {
    **{f"{lead} {the}{name}": id for id, _, _, names in _NAMES for name in names for lead in _LEADS for the in ("", "the ", "the terms of the ")},
    **_GRANTS,
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    **{f"permission to use copy modify and {o}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant" for o in ("", "or ")},
    **{f"this source code form is subject to the terms of the mozilla public license {v}2 0": "mpl2-ref" for v in ("v ", "v", "version ", "")},
    "waived all copyright and related or neighboring rights to": "cc0-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl1-grant",
    **SENTENCES,
}

#: Licences that an SPDX tag may name beyond those above.
_SPDX = {"0BSD": "permissive", "BSD-4-Clause": "permissive", "BSL-1.0": "permissive", "MIT-0": "permissive", "Python-2.0": "permissive", "PostgreSQL": "permissive", "NCSA": "permissive", "Artistic-2.0": "permissive", "WTFPL": "permissive", "MPL-1.1": "copyleft", "CDDL-1.0": "copyleft", "EUPL-1.2": "copyleft", "OFL-1.1": "permissive"}
_SPDX |= {name: group for _, name, group, _ in _NAMES}
_SPDX |= {f"{name}-only": group for _, name, group, _ in _NAMES if "GPL" in name and not name.endswith("later")}
SPDX: dict[str, tuple[str, str]] = {name.lower(): (name, group) for name, group in _SPDX.items()}
SPDX |= {f"{name.lower()}+": (f"{name}-or-later", group) for name, group in _SPDX.items() if "GPL" in name and name[-2:] in (".0", ".1")}

_BSD = ("bsd-grant", "bsd-source", "bsd-binary")
_TEXTS = (((*_BSD, "bsd-advertise", "bsd-endorse"), "BSD-4-Clause"), ((*_BSD, "bsd-endorse"), "BSD-3-Clause"), (_BSD, "BSD-2-Clause"))
ORDERED: tuple[tuple[tuple[str, ...], str, str], ...] = (
    *((("all-rights", *ids), name, "permissive") for ids, name in _TEXTS),  # the notice that heads these texts
    *((ids, name, "permissive") for ids, name in _TEXTS),
    *RULES,
    *(((f"{i}-grant",), f"{name}-or-later", "copyleft") for i, name in (("gpl2", "GPL-2.0"), ("lgpl2", "LGPL-2.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    *(((f"{i}-only-grant",), name, "copyleft") for i, name in (("gpl2", "GPL-2.0"), ("gpl3", "GPL-3.0"), ("lgpl2", "LGPL-2.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    *(((i,), name, group) for i, name, group, _ in _NAMES),
    (("isc-grant",), "ISC", "permissive"),
    (("0bsd-grant",), "0BSD", "permissive"),
    (("cc0-grant",), "CC0-1.0", "permissive"),
    (("unlicense-grant",), "Unlicense", "permissive"),
    (("zlib-altered",), "Zlib", "permissive"),
    (("bsl1-grant",), "BSL-1.0", "permissive"),
    *(((f"spdx-{key}",), name, group) for key, (name, group) in SPDX.items()),
)

#: What ends a sentence: a mark before white space, or a line break.
BREAK = r"[\n\r]+|[.!?;:]\s+"

_breaks = re.compile(BREAK)
_other = re.compile(r"[^a-z0-9]+")
_word = re.compile(r"[^a-z0-9]*([a-z0-9]+)")
_tag = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
_tag_word = re.compile(r"[a-z0-9.+-]*[a-z0-9+]")


def normalise(sentence: str) -> str:
    """Lower case, every run of other characters than letters and digits one space."""
    return _other.sub(" ", sentence.lower()).strip()


class Recogniser:
    def __init__(self, sentences: Mapping[str, str], rules: Sequence[tuple[tuple[str, ...], str, str]], inside: bool = False):
        self.sentences, self.rules, self.inside = dict(sentences), tuple(rules), inside
        self.prefixes = set() if inside else {s[:k] for s in self.sentences for k in range(1, len(s) + 1) if k == len(s) or s[k] == " "}
        self.tree: dict = {}
        for known, name in self.sentences.items() if inside else ():
            at = self.tree
            for w in known.split():
                at = at.setdefault(w, {})
            at[""] = name
        first = sorted({s.split()[0] for s in self.sentences})
        self.heads = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, [*first, "spdx-license-identifier:"])) + r")(?![^\W_])")
        self.starts = re.compile(r"(?:" + "|".join(map(re.escape, first)) + r")\b" if first else r"(?!)", re.IGNORECASE)

    def identifiers(self, text: str) -> list[str]:
        """Identifiers of the known sentences, in the order of the text.

        Inside: wherever they stand, see ``within``.  Else whole pieces: a sentence that is wrapped is put together from the pieces that follow one
        another, the longest known sentence first.
        """
        if self.inside:
            return self.within(text.lower())
        if not self.starts.search(text):
            return []
        pieces = _breaks.split(text)
        out, i = [], 0
        while i < len(pieces):
            found = 0
            if self.starts.match(pieces[i].lstrip(" \t\"'(*#/-")):
                joined = ""
                for j in range(i, len(pieces)):
                    more = normalise(pieces[j])
                    joined = f"{joined} {more}" if joined and more else joined or more
                    if joined in self.sentences:
                        found, name = j + 1 - i, self.sentences[joined]
                    if joined not in self.prefixes:
                        break
            if found:
                out.append(name)
            i += found or 1
        return out

    def within(self, low: str) -> list[str]:
        """Identifiers of the clauses that start and end at word boundaries of a lower-case text, the longest at a place, none over another.

        Any other characters and line breaks may stand between their words.  All
        licences that the expression of an SPDX tag names are identifiers too.
        """
        out, pos = [], 0
        while head := self.heads.search(low, pos):
            pos = head.end()
            if head[0] == "spdx-license-identifier:":
                tag = _tag.match(low, head.start())
                out += [f"spdx-{w}" for w in _tag_word.findall(tag[1]) if w in SPDX]
                pos = tag.end()
                continue
            at, end, name = self.tree[head[0]], pos, ""
            while True:
                if "" in at and not low[end : end + 1].isalnum():
                    name, pos = at[""], end
                more = _word.match(low, end)
                if more is None or more[1] not in at:
                    break
                at, end = at[more[1]], more.end()
            if name:
                out.append(name)
        return out

    def licences(self, ids: list[str]) -> list[tuple[str, str]]:
        """(licence, group) by the ordered rules; identifiers that no rule starts with are passed over."""
        out, i = [], 0
        while i < len(ids):
            for sequence, name, group in self.rules:
                if tuple(ids[i : i + len(sequence)]) == sequence:
                    out.append((name, group))
                    i += len(sequence)
                    break
            else:
                i += 1
        return out


_ORDER = ("restricted", "copyleft", "permissive")


def scan(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[tuple[str, ...], str, str]] = RULES, inside: bool = False) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses and license_group of every whole text.

    ``sentence_ids``: identifiers in text order, with commas; ``licenses``: what the
    rules make of them, in order, with commas; ``license_group``: the strictest group
    among these, ``none`` without any.  Null and empty texts have no sentence.  Rows that
    repeat and rows without a doc_id have a row each; other columns are not looked at.
    ``inside``: sentences are known at any word boundary, not only as whole pieces.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Recogniser(sentences, rules, inside))

    def run(batches):
        rec = held.value
        for batch in chunks(batches):
            n, names, licences, groups = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = rec.identifiers(text) if text else []
                found = rec.licences(ids)
                n.append(len(ids))
                names.append(",".join(ids))
                licences.append(",".join(x for x, _ in found))
                groups.append(next((g for g in _ORDER if any(x == g for _, x in found)), "none"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(licences, pa.string()), pa.array(groups, pa.string())], ["doc_id", "n_sentences", "sentence_ids", "licenses", "license_group"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_sentences long, sentence_ids string, licenses string, license_group string"
    )


def _oracle() -> str:
    """DuckDB SQL for texts whose licence sentences each stand in one piece and each make a rule."""
    single = {s[0]: (name, group) for s, name, group in RULES if len(s) == 1}
    rows = ", ".join(f"('{s}', '{i}', {repr(single[i][0]) if i in single else 'NULL'}, {repr(single[i][1]) if i in single else 'NULL'})" for s, i in SENTENCES.items())
    return rf"""
WITH known(sentence, id, license, grp) AS (VALUES {rows}),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{BREAK}') AS p FROM documents)),
hits AS (SELECT p.doc_id, p.pos, k.* FROM pieces p JOIN known k ON trim(regexp_replace(lower(p.piece), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
seen AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, string_agg(license, ',' ORDER BY pos) AS licenses,
  CASE WHEN bool_or(grp = 'restricted') THEN 'restricted' WHEN bool_or(grp = 'copyleft') THEN 'copyleft' WHEN bool_or(grp = 'permissive') THEN 'permissive' ELSE 'none' END AS grp
  FROM hits GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(s.n, 0)::BIGINT AS n_sentences, coalesce(s.ids, '') AS sentence_ids, coalesce(s.licenses, '') AS licenses, coalesce(s.grp, 'none') AS license_group
FROM documents d LEFT JOIN seen s ON s.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()
