"""License phrases and notices that the license scan looks for, as words."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words of one rolling gram: the shortest phrase has three.
GRAM = 3
#: Notices up to this many words have to stand whole, on one diagonal.
SHORT = 12
#: A longer notice is found with this share of its words; its diagonals merge over so many inserted or missing words.
LEAST_SHARE, MOST_BAND = 0.8, 8
#: Votes under which a diagonal of a longer notice is chance.
LEAST_VOTES = 3

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public notices by label. What stands in braces must be found, whatever the share of the rest.
NOTICES = [
    ("mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted {free of charge to any person obtaining a copy} of this software and associated documentation files the software to deal in the software"
            " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "apache license 2 0"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http {www apache org licenses license 2 0}"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license v3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of {the gnu general public license} as published by the free software"
              " foundation {either version 3 of} the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license v2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of {the gnu general public license} as published by the free software"
              " foundation {either version 2 of} the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "{redistribution and use in source and binary forms} with or without modification are permitted provided that the following conditions are met"
            " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "{neither the name of} the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
              " without specific prior written permission"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the {mozilla public license v 2 0} if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "{permission to use copy modify and or distribute this software for any purpose} with or without fee is hereby granted provided that the above copyright notice"
            " and this permission notice appear in all copies"),
    ("unlicense", "this is {free and unencumbered software} released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("cc0", "cc0 1 0 universal"),
    ("epl-2", "eclipse public license 2 0"),
    ("bsl", "boost software license version 1 0"),
]


@dataclass(frozen=True)
class Template:
    """One phrase or notice; ``must`` are the places of words that have to be covered."""

    number: int
    label: str
    words: tuple[str, ...]
    must: tuple[int, ...]
    base: bool

    @property
    def band(self) -> int:
        return 0 if self.whole else min(MOST_BAND, len(self.words) // 4)

    @property
    def whole(self) -> bool:
        return self.base or len(self.words) <= SHORT

    @property
    def least_votes(self) -> int:
        return len(self.words) - GRAM + 1 if self.whole else LEAST_VOTES

    @property
    def grams(self) -> list[str]:
        return [" ".join(self.words[i : i + GRAM]) for i in range(len(self.words) - GRAM + 1)]


def _template(number: int, label: str, text: str, base: bool) -> Template:
    marked = re.findall(r"[{}]|[^ {}]+", text)
    words: list[str] = []
    must: list[int] = []
    inside = False
    for m in marked:
        if m in "{}":
            inside = m == "{"
        else:
            if inside:
                must.append(len(words))
            words.append(m)
    if len(words) < GRAM:
        raise ValueError(f"a template needs {GRAM} words: {text}")
    return Template(number, label, tuple(words), tuple(must), base)


def templates(phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> list[Template]:
    """Phrases first, then notices, numbered in order."""
    p = PHRASES if phrases is None else phrases
    n = NOTICES if notices is None else notices
    return [_template(i, label, text, i < len(p)) for i, (label, text) in enumerate([(v, k) for k, v in p.items()] + list(n))]
