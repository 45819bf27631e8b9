"""Licence notices in texts: exact phrases, and an exact set-similarity join with templates.

A template of ``n`` words is looked for in every block of ``2 n`` words of a text, which begin every ``n`` words, so each run of
``n`` words lies within a block. A block matches if it has at least ``threshold`` of the template's different words. The join
finds every such block: the words of all templates are ordered by how often they stand in all documents, rarest first,
and with ``o`` words to be shared a matching block

* has one of the template's first ``n - o + 1`` words in that order (prefix filter),
* has at least ``o`` different words that any template uses (length filter), and
* after the template's ``i``-th word still can gather ``o`` words from the rest of both (positional filter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.common import keyed, map_batches, schema, words

THRESHOLD = 0.8
#: Phrases whose every occurrence counts, and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Well-known licence notices as (label, text). Fixed values.
TEMPLATES = (
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("apache-text", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file, you can obtain one."),
    ("cc0-text", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


@dataclass(frozen=True)
class Template:
    """Different words of a template, rarest first, by number; ``needed`` of them make a match, ``step`` words part its blocks."""

    label: str
    terms: np.ndarray
    needed: int
    step: int


def vocabulary(templates: Sequence[tuple[str, str]], phrases: Sequence[str]) -> dict[bytes, int]:
    """Numbers of all words that templates and phrases use."""
    used = {word for _, text in templates for word in words(text)} | {word for text in phrases for word in words(text)}
    return {word: at for at, word in enumerate(sorted(used))}


def _numbers(known: dict[bytes, int], own: list[bytes]) -> np.ndarray:
    return np.array(list(map(known.get, own, [-1] * len(own))), dtype=np.int64)


def frequencies(docs: DataFrame, known: dict[bytes, int], text: str = "text") -> np.ndarray:
    """How often each word of the vocabulary stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for value in batch.column(text).to_pylist():
                total += np.bincount(_numbers(shared.value, words(value)) + 1, minlength=len(total))
        yield pa.RecordBatch.from_pydict({"term": np.arange(len(total) - 1), "n": total[1:]})

    parts = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(count, schema(("term", "long"), ("n", "long")))
    found = np.zeros(len(known), dtype=np.int64)
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row per word of the vocabulary
        found[row["term"]] = row["n"]
    return found


def ordered(templates: Sequence[tuple[str, str]], known: dict[bytes, int], frequency: np.ndarray, threshold: float) -> list[Template]:
    """Templates with their words in the global order; templates without words match nothing and are left out."""
    out = []
    for label, text in templates:
        own = words(text)
        terms = sorted({known[word] for word in own}, key=lambda t: (frequency[t], t))
        if terms:
            needed = max(1, math.ceil(round(threshold * len(terms), 9)))
            out.append(Template(label, np.array(terms, dtype=np.int64), needed, len(own)))
    return out


def block_matches(places: np.ndarray, numbers: np.ndarray, template: Template) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that match, and how many of the template's words they share, from the places of the vocabulary's words."""
    step, n = template.step, len(template.terms)
    rank = np.full(max([0, *numbers, *template.terms]) + 1, -1, dtype=np.int64)
    rank[template.terms] = np.arange(n)
    order = rank[numbers]
    block, order = places[order >= 0] // step, order[order >= 0]
    block, order = np.concatenate([block, block - 1]), np.concatenate([order, order])  # the block it begins, and the one before
    block, order = block[block >= 0], order[block >= 0]
    prefix = order <= n - template.needed
    if not prefix.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    candidates = np.unique(block[prefix])
    kept = np.isin(block, candidates)
    pairs = np.unique(block[kept] * n + order[kept])  # sorted by block, then by the global order
    block, order = pairs // n, pairs % n
    first = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(first, len(block)))
    within = np.arange(len(block)) - np.repeat(first, size)
    # what the block and the template have from here on bounds the overlap
    bound = within + np.minimum(np.repeat(size, size) - within, n - order)
    able = (size >= template.needed) & (np.minimum.reduceat(bound, first) >= template.needed) if len(first) else size > 0
    return block[first][able], size[able]


def phrase_places(places: np.ndarray, numbers: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand one after the other."""
    at = np.flatnonzero(numbers[: len(numbers) - len(phrase) + 1] == phrase[0]) if len(numbers) >= len(phrase) else np.zeros(0, np.int64)
    for offset in range(1, len(phrase)):
        at = at[(numbers[at + offset] == phrase[offset]) & (places[at + offset] == places[at] + offset)]
    return places[at]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    ``matches`` lists (label, first_word, end_word, score) of every block that holds at least ``threshold`` of a template's
    different words; ``score`` is the greatest of these shares, or 0. ``labels`` has those of phrases and templates.
    Null and empty texts have no words and no labels. Rows with equal keys are documents of their own.
    """
    docs = keyed(docs, key, text)
    known = vocabulary(templates, list(phrases))
    sought = ordered(templates, known, frequencies(docs, known, text), threshold)
    spelled = [(label, _numbers(known, words(phrase))) for phrase, label in phrases.items()]
    shared = docs.sparkSession.sparkContext.broadcast((known, sought, spelled))
    match = T.StructType().add("label", "string").add("first_word", "long").add("end_word", "long").add("score", "double")
    arrow = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
    out = T.StructType([*docs.select(key).schema.fields]).add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
    out = out.add("base_labels", "string").add("labels", "string").add("score", "double").add("matches", T.ArrayType(match))

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms, templates_, phrases_ = shared.value
        rows = []
        for value in batch.column(text).to_pylist():
            own = words(value)
            numbers = _numbers(terms, own)
            places = np.flatnonzero(numbers >= 0)
            numbers = numbers[places]
            starts, base, matches = [], set(), []
            for label, phrase in phrases_:
                at = phrase_places(places, numbers, phrase).tolist()
                starts += at
                base |= {label} if at else set()
            for template in templates_ if len(places) else ():
                blocks, sizes = block_matches(places, numbers, template)
                for block, size in zip(blocks.tolist(), sizes.tolist(), strict=True):
                    first = block * template.step
                    matches.append((template.label, first, min(len(own), first + 2 * template.step), size / len(template.terms)))
            labels = base | {m[0] for m in matches}
            score = max((m[3] for m in matches), default=0.0)
            ends = (min(starts), max(starts)) if starts else (None, None)
            rows.append((len(own), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, matches))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), arrow]
        arrays = [pa.array(column, of) for column, of in zip(zip(*rows, strict=True), kinds, strict=True)]
        arrays[-1] = pa.array([[dict(zip(("label", "first_word", "end_word", "score"), m, strict=True)) for m in r[-1]] for r in rows], arrow)
        yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], names=out.names)

    return map_batches(docs, find, out)
