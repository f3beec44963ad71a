"""License scans by template-markup matching.

A template is licence wording with markup for what may differ::

    released under the <<beginOptional>>terms of the <<endOptional>>mit license
    copyright <<var;words="1,6">> all rights reserved
    this <<var;match="work|program">> is licensed ...

Optional regions may be left out; a replaceable region takes any run of so many words, or one of its
alternatives. A template is compiled to an automaton over tokens, which accepts exactly the token
sequences with the mandatory wording; it is run from every place where its first words can stand, in
texts that hold its longest mandatory wording at all (in all texts, if it has none at its top level).

Words are ASCII digits and letters (A-Z lower-cased) and any characters beyond ASCII, in texts and
templates alike, so punctuation and layout play no part.

Defined results
---------------
* All places count, overlapping ones too; from one place the longest acceptance counts.
* A null or empty text has no words and no matches. Repeated rows each get their result. Long texts take
  time in proportion to their length.
* An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, texts
from .decontaminate import words

#: Phrases and the labels they stand for, whatever is around them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_SELF = "<<beginOptional>>this <<var;match=\"work|program|software|library|file|document\">> is <<endOptional>>"
_NOTICE = "it under the terms of the gnu {} general public license as published by the free software foundation <<beginOptional>>either <<endOptional>>version {}"
_WARRANTY = (
    "this software is provided by the <<var;match=\"copyright holders and contributors|copyright holder and contributors|regents and contributors|author|authors\">> as is and any express or implied"
    " warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " <<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<beginOptional>>2 <<endOptional>>redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution "
)


def _public(name: str, version: str) -> list[str]:
    """Notices of a public licence of that family: the short one, and the published one after "redistribute and or modify"."""
    spaced = f"{name} " if name else ""
    return [
        f"{_SELF}<<var;match=\"licensed|released|distributed\">> under the <<beginOptional>>terms of the <<endOptional>>gnu {spaced}general public license"
        f" <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version {version}",
        _NOTICE.format(name, version),
    ]


def _commons(name: str, short: str) -> list[str]:
    """Notices of a Creative Commons licence, by its long name, its short one or both."""
    terms = "licensed under <<var;match=\"a|the|\">> "
    long = f"creative commons attribution {name}".strip()
    return [
        f"{terms}<<beginOptional>>{long} <<endOptional>>cc {short} 4 0",
        f"{terms}{long} 4 0 <<beginOptional>>international <<endOptional>><<var;match=\"license|licence\">>",
    ]


#: Licence notices and texts in template markup (published wording).
TEMPLATES = {
    "mit": [
        "<<var;match=\"released|licensed|distributed\">> under the <<beginOptional>>terms of the <<endOptional>>mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " <<beginOptional>>the software <<endOptional>>to deal in the software without restriction",
    ],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software <<endOptional>>"
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the software the software is provided as is"
        " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the <<var;words=\"1,6\">> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of"
        " or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2.0": ["<<var;match=\"licensed|released|distributed\">> under the <<beginOptional>>terms of the <<endOptional>>apache license <<beginOptional>>version <<endOptional>>2 0 <<beginOptional>>the license<<endOptional>>"],
    "gpl-2.0": _public("", "2"),
    "gpl-3.0": _public("", "3"),
    "lgpl-2.1": _public("lesser", "2 1"),
    "lgpl-3.0": _public("lesser", "3"),
    "agpl-3.0": _public("affero", "3"),
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 <<beginOptional>>if a copy of the mpl was not distributed with this file you can obtain one at<<endOptional>>"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2-clause": [_BSD + _WARRANTY],
    "bsd-3-clause": [
        _BSD + "<<beginOptional>>3 <<endOptional>>neither the name of <<var;words=\"1,16\">> may be used to endorse or promote products derived from this software without specific prior written permission " + _WARRANTY
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "cc0-1.0": ["<<var;match=\"cc0 1 0 universal|creative commons zero v1 0 universal|cc0 1 0 public domain dedication\">>"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by-4.0": _commons("", "by"),
    "cc-by-nc-4.0": _commons("noncommercial", "by nc"),
    "cc-by-sa-4.0": _commons("sharealike", "by sa"),
    "copyright-notice": ["copyright <<var;words=\"1,8\">> all rights reserved"],
}


@dataclass
class Automaton:
    """States from 0; ``moves`` on a word, ``free`` moves on none, ``skips`` on any word."""

    moves: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    skips: list[set[int]] = field(default_factory=list)
    end: int = 0
    wording: bytes = b""

    def state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        self.skips.append(set())
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def prepare(self) -> Automaton:
        self.first = self.closure({0})
        self.any_first = any(self.skips[s] for s in self.first)
        self.starters = {w for s in self.first for w in self.moves[s]}
        return self

    def longest(self, text: list[bytes], at: int) -> int:
        """Where the longest acceptance from ``at`` ends, or -1."""
        states, best = self.first, -1
        for k in range(at, len(text)):
            reached = set()
            for s in states:
                reached.update(self.moves[s].get(text[k], ()))
                reached |= self.skips[s]
            if not reached:
                break
            states = self.closure(reached)
            if self.end in states:
                best = k + 1
        return best


_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


def parse(template: str) -> list:
    """Literal words, ("optional", parts) and ("var", alternatives or None, least, most)."""
    stack: list[list] = [[]]
    for k, piece in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            stack[-1] += words(piece)
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that did not begin: {template!r}")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            given = dict(re.findall(r'(\w+)="([^"]*)"', piece))
            if "match" in given:
                stack[-1].append(("var", [words(a) for a in given["match"].split("|")], 0, 0))
            else:
                least, most = map(int, given.get("words", "1,16").split(","))
                stack[-1].append(("var", None, least, most))
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {template!r}")
    return stack[0]


def compile_template(template: str) -> Automaton:
    auto = Automaton()

    def chain(parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = auto.state()
                auto.moves[at].setdefault(part, set()).add(to)
                at = to
            elif part[0] == "optional":
                to = chain(part[1], at)
                out = auto.state()
                auto.free[to].add(out)
                auto.free[at].add(out)
                at = out
            elif part[1] is not None:
                out = auto.state()
                for alternative in part[1]:
                    auto.free[chain(alternative, at)].add(out)
                at = out
            else:
                out = auto.state()
                for n in range(part[3]):
                    if n >= part[2]:
                        auto.free[at].add(out)
                    to = auto.state()
                    auto.skips[at].add(to)
                    at = to
                auto.free[at].add(out)
                at = out
        return at

    parts = parse(template)
    auto.end = chain(parts, auto.state())
    runs: list[list[bytes]] = [[]]
    for part in parts:
        if isinstance(part, bytes):
            runs[-1].append(part)
        else:
            runs.append([])
    longest = max(runs, key=lambda r: sum(map(len, r)))
    auto.wording = b" " + b" ".join(longest) + b" " if longest else b""
    return auto.prepare()


def to_regex(template: str) -> str:
    """The same language as a regular expression over words that are each followed by a space."""

    def write(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += part.decode() + " "
            elif part[0] == "optional":
                out += f"({write(part[1])})?"
            elif part[1] is not None:
                out += "(" + "|".join(write(a) for a in part[1]) + ")"
            else:
                out += f"([^ ]+ ){{{part[2]},{part[3]}}}"
        return out

    return write(parse(template))


def scan_text(text: str, base: dict[bytes, str], automata: list[tuple[str, Automaton]]) -> tuple[int, list[dict]]:
    """The number of words and all matches: label, base, start and end (words from 0)."""
    held = words(text)
    line = b" " + b" ".join(held) + b" "
    found = []
    for phrase, label in base.items():
        at, counted, start = line.find(phrase), 0, 0
        while at >= 0:
            start += line.count(b" ", counted, at)  # goes on from the last place, so a text is counted once
            counted = at
            found.append({"label": label, "base": True, "start": start, "end": start + phrase.count(b" ") - 1})
            at = line.find(phrase, at + 1)
    for label, auto in automata:
        if not auto.wording or auto.wording in line:
            for k, word in enumerate(held):
                if (auto.any_first or word in auto.starters) and (end := auto.longest(held, k)) >= 0:
                    found.append({"label": label, "base": False, "start": k, "end": end})
    return len(held), found


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words and matches (label, base, start, end)."""
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates

    def make():
        phrases = {b" " + b" ".join(words(p)) + b" ": label for p, label in base.items()}
        automata = [(label, compile_template(t)) for label, several in templates.items() for t in several]

        def step(batch):
            found = [scan_text(t, phrases, automata) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "n_words": [x[0] for x in found], "matches": [x[1] for x in found]}

        return step

    schema = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,start:long,end:long>>"
    return map_batches(id_text(docs, id_col, text_col), schema, make)


def license_digest(docs: DataFrame) -> DataFrame:
    found = license_scan(docs)
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.when(F.exists("matches", lambda m: ~m["base"]), 1.0).when(F.size("matches") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        score.alias("score"),
    )


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    held = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    starts = ", ".join(
        f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))})" for p in BASE
    )
    base = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in BASE.items())
    own = ", ".join(f"CASE WHEN regexp_matches(line, ' {to_regex(t)}') THEN '{label}' END" for label, several in TEMPLATES.items() for t in several)
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')".format
    return f"""
WITH d AS (SELECT doc_id, {held} AS w FROM documents),
m AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, flatten([{starts}]) AS s FROM d),
r AS (SELECT doc_id, w, s, [{base}] AS b, [{own}] AS o FROM m)
SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_base,
       list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
       {joined("b")} AS base_labels, {joined("list_concat(b, o)")} AS labels,
       CASE WHEN len(list_filter(o, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(s) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM r
"""


SQL = _sql()
