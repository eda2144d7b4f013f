"""Licence notices by Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and texts of common notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("proprietary", "All rights reserved."),
]
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that part words; every other character, all beyond ASCII included, is of a word.
PARTING = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

LONG = 100


def words_of(text: str) -> list[str]:
    return [w for w in re.split(PARTING, text.translate(str.maketrans(UPPER, SMALL))) if w]


def bigrams(text: str) -> list[str]:
    """A template's distinct word bigrams; one word is itself."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} if len(words) > 1 else set(words))


def whole_templates() -> list[tuple[str, str]]:
    """TEMPLATES, the headers that licences ask for, and the whole texts in the folder licenses; the clause that both BSD licences share is left to their texts."""
    header = lambda kind, version: f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    headers = [
        ("GPL-2.0", header("", "2")), ("GPL-3.0", header("", "3")), ("LGPL-2.1", header("Lesser ", "2.1")), ("LGPL-3.0", header("Lesser ", "3")),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ]
    texts = [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return [t for t in TEMPLATES if t[0] != "BSD-3-Clause"] + headers + texts


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that a set may have for a Dice coefficient of the threshold with n bigrams: 2 * smaller / (sum) must reach it."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, embedded: bool = False) -> DataFrame:
    """docs with license (of the best match, null if none), dice (its coefficient, 0 if none) and licenses (all that match, sorted).

    A text's units are its distinct lines, its paragraphs (parted by empty
    lines) and itself; lines may end in CRLF. A unit matches a template if the Dice coefficient of
    their sets of word bigrams reaches the threshold; sets whose sizes rule
    that out aren't compared. Of equal coefficients the first name wins. The
    templates, of any number, are literals in the plan: no join, no shuffle.
    embedded: windows of a template's length are units too,
    for it alone, in texts that hold as many of its bigrams as the threshold
    takes; they begin at each of the template's bigrams, or for templates of
    over LONG bigrams at every 32nd part of its length. Null, empty and
    wordless texts match nothing; rows that repeat are judged alike. Columns of
    these names are replaced.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, SMALL)
    units = F.array_distinct(F.concat(F.split(low, "\r?\n"), F.split(low, "(?:\r?\n){2,}"), F.array(low)))
    words = F.transform(units, lambda u: F.split(F.btrim(F.regexp_replace(u, PARTING, " ")), " "))
    two = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.filter(w, lambda x: x != ""))
    pairs = F.transform("__words", lambda w: F.array_distinct(two(w)))
    whole = two(F.split(F.btrim(F.regexp_replace(low, PARTING, " ")), " ")) if embedded else F.lit(None).cast("array<string>")

    def windows(text: str, own: list[str], literal: Column) -> Column:
        """The best coefficient of a window of the text's length."""
        length, least = max(1, len(words_of(text)) - 1), math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
        at = F.sequence(F.lit(0), F.size("__whole") - 1, F.lit(max(1, length // 32) if length > LONG else 1))
        if length <= LONG:
            at = F.filter(at, lambda i: F.array_contains(literal, F.get("__whole", i)))
        units = F.transform(at, lambda i: F.array_distinct(F.slice("__whole", i + 1, length)))
        scores = F.transform(units, lambda p: 2.0 * F.size(F.array_intersect(p, literal)) / (F.size(p) + len(own)))
        return F.when((F.size("__whole") >= least) & (F.size(F.array_intersect(F.col("__whole"), literal)) >= least), F.array_max(scores))

    def matched(name: str, text: str) -> Column:
        own = bigrams(text)
        low_size, high_size = size_bounds(len(own), threshold)
        fits = F.filter("__pairs", lambda p: F.size(p).between(low_size, high_size))
        literal = F.split(F.lit("|".join(own)), "[|]")
        both = F.array_max(F.transform(fits, lambda p: 2.0 * F.size(F.array_intersect(p, literal)) / (F.size(p) + len(own))))
        best = F.greatest(both, windows(text, own, literal)) if embedded else both
        return F.struct(F.lit(name).alias("name"), F.coalesce(best, F.lit(0.0)).alias("dice"))

    named = [matched(n, t) for n, t in templates if bigrams(t)]
    found = F.filter(F.array(*named), lambda x: x["dice"] >= threshold) if named else F.array().cast("array<struct<name:string,dice:double>>")
    best = F.array_sort("__found", lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    names = [f"`{c}`" for c in docs.columns if c.lower() not in ("license", "dice", "licenses", "__words", "__whole", "__pairs", "__found", "__best")]
    step = docs.select(*names, words.alias("__words"), whole.alias("__whole")).select(*names, "__whole", pairs.alias("__pairs")).select(*names, found.alias("__found")).select(*names, "__found", F.get(best, F.lit(0)).alias("__best"))
    return step.select(
        *names, F.col("__best.name").alias("license"), F.round(F.coalesce("__best.dice", F.lit(0.0)), 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda x: x["name"]))), ",").alias("licenses"),
    )
