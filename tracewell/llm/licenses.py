"""License scans: fixed phrases, and license templates compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tracewell.llm.common import map_texts

# fixed values: phrases and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Templates: [[ ]] holds an optional region, {n} stands for any wording of at most n words;
# all other words are mandatory.  Wordings are those of the public licenses.
_AS_IS = "provided by [[ {12} ]] as is [[ and any express or implied warranties ]]"
TEMPLATES = {
    "GPL-2.0": "licensed under [[ the terms of ]] the gnu general public license [[ as published by the free software foundation ]] "
    "[[ either ]] version 2 [[ 0 ]] [[ of the license ]] [[ or at your option any later version ]]",
    "GPL-3.0": "licensed under [[ the terms of ]] the gnu general public license [[ as published by the free software foundation ]] "
    "[[ either ]] version 3 [[ 0 ]] [[ of the license ]] [[ or at your option any later version ]]",
    "GPL-3.0-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version",
    "Apache-2.0": "licensed under the apache license [[ version ]] 2 0",
    "Apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use {6} except in compliance with "
    "the license [[ you may obtain a copy of the license at {12} ]]",
    "CC-BY-4.0": "licensed under [[ a ]] [[ creative commons attribution ]] [[ cc by ]] 4 0 [[ international ]] [[ license ]]",
    "CC-BY-NC-4.0": "licensed under [[ a ]] cc by nc 4 0 [[ international ]] [[ license ]]",
    "MIT": "[[ released ]] [[ distributed ]] [[ licensed ]] under the [[ terms of the ]] mit license",
    "MIT-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "[[ including the next paragraph ]] shall be included in all copies or substantial portions of the software",
    "BSD-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met [[ 1 ]] redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "as-is": f"this software is {_AS_IS} without warranty of any kind",
}
PHRASE_SCORE, TEMPLATE_SCORE = 0.5, 1.0

# lower-case A-Z; all other ASCII but digits and a-z separates words
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Token automaton of a template: states are places in it, steps are words.

    ``steps`` has the mandatory word that leaves a state, ``skips`` the states reached
    without a word (past or into an optional region), ``any_word`` the states from which
    any word leads on (inside a replaceable region).
    """

    def __init__(self, template: str):
        self.steps: dict[int, tuple[bytes, int]] = {}
        self.skips: dict[int, list[int]] = {}
        self.any_word: dict[int, int] = {}
        state, opened = 0, []
        for token in template.split():
            if token == "[[":
                opened.append(state)
                state += 1
                self.skips.setdefault(opened[-1], []).append(state)
            elif token == "]]":
                begin = opened.pop()
                self.skips.setdefault(state, []).append(state + 1)
                self.skips[begin].append(state + 1)
                state += 1
            elif re.fullmatch(r"\{[0-9]+\}", token):
                end = state + int(token[1:-1])
                for s in range(state, end):
                    self.any_word[s] = s + 1
                    self.skips.setdefault(s, []).append(end)
                state = end
            else:
                self.steps[state] = (token.encode(), state + 1)
                state += 1
        if opened:
            raise ValueError(f"optional region is not closed: {template}")
        self.end = state
        self.begin = self.closed({0})
        self.first = {self.steps[s][0] for s in self.begin if s in self.steps}
        if self.end in self.begin or any(s in self.any_word for s in self.begin):
            raise ValueError(f"a template must begin with a mandatory or optional word: {template}")

    def closed(self, states: set[int]) -> set[int]:
        """With all states reached without a word."""
        found, todo = set(states), list(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def match(self, words: Sequence[bytes], start: int) -> int | None:
        """End of the longest match that starts at a word, or None."""
        states, stop = self.begin, None
        for i in range(start, len(words)):
            word = words[i]
            reached = {self.steps[s][1] for s in states if s in self.steps and self.steps[s][0] == word}
            reached |= {self.any_word[s] for s in states if s in self.any_word}
            if not reached:
                break
            states = self.closed(reached)
            if self.end in states:
                stop = i + 1
        return stop


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, t in templates.items()]
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, automaton in self.automata:
            for word in automaton.first:
                self.starts.setdefault(word, []).append((label, automaton))

    def scan(self, words: list[bytes]) -> tuple[list[dict], list[dict]]:
        """Places of phrases, and matches of templates, both by start and label."""
        joined = b" " + b" ".join(words) + b" "
        base = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            passed, place = 0, -1
            while at >= 0:
                place += joined.count(b" ", passed, at + 1)
                passed = at + 1
                base.append({"label": label, "start": place})
                at = joined.find(phrase, at + 1)
        matches = []
        if not self.starts.keys().isdisjoint(words):
            free = dict.fromkeys((label for label, _ in self.automata), 0)
            for i in [i for i, w in enumerate(words) if w in self.starts]:
                for label, automaton in self.starts[words[i]]:
                    if i >= free[label] and (stop := automaton.match(words, i)) is not None:
                        matches.append({"label": label, "start": i, "stop": stop})
                        free[label] = stop
        key = lambda m: (m["start"], m["label"])
        return sorted(base, key=key), sorted(matches, key=key)


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


PLACE = StructType([StructField("label", StringType()), StructField("start", LongType())])
MATCH = StructType([*PLACE.fields, StructField("stop", LongType())])


def scan(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
) -> DataFrame:
    """Add n_words, license_places, license_matches, license_score to every row; no shuffle.

    Places are word numbers from 0.  ``license_places`` has every place of a phrase,
    ``license_matches`` the leftmost, non-overlapping matches of each template: every
    mandatory word in order, optional regions present or absent, replaceable ones of
    any wording up to their length.  The score is 1 with a template, else 0.5 with a
    phrase, else 0.

    * null or empty text: no words, empty lists, score 0.
    * texts of any length are scanned whole, in time proportional to their length.
    * ties (two labels at one place) are all kept; repeated rows: each scanned.
    * an empty table stays empty; columns named like the new ones: ValueError.
    """
    chosen = tuple(phrases.items()), tuple(templates.items())

    def start():
        scanner = _scanner(*chosen)

        def run(texts):
            rows = []
            for t in texts:
                words = words_of(t or b"")
                base, matches = scanner.scan(words)
                rows.append((len(words), base, matches, TEMPLATE_SCORE if matches else PHRASE_SCORE if base else 0.0))
            return list(map(list, zip(*rows, strict=True)))

        return run

    new = StructType([
        StructField("n_words", LongType()), StructField("license_places", ArrayType(PLACE)),
        StructField("license_matches", ArrayType(MATCH)), StructField("license_score", DoubleType()),
    ])
    return map_texts(docs, text, list(docs.columns if keep is None else keep), new, start)
