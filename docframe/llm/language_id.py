"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.storage import add_columns, materialize, small_batches

SHIFT = 21  # a code point's bits
SPACE = re.compile(r"\s")


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def dense_grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The letters used, with the space first, and for n = 1, 2, 3 the n-grams with the number of their text.

    Case is folded; what isn't a letter separates words, and each word has one
    space before and after it. An n-gram is numbered by its letters' places in
    the alphabet, in the order of (n, code points).
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), dtype=np.uint32)
    text_of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    text_of = np.append(np.zeros(1, np.int64), text_of)[: len(points)]  # a text's letters, then the space after it
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    points, text_of, is_letter = points[keep], text_of[keep], is_letter[keep]
    seen = np.zeros(0x110000, dtype=bool)
    seen[points[is_letter]] = True
    alphabet = np.append(np.uint32(32), np.flatnonzero(seen).astype(np.uint32))
    place = np.zeros(0x110000, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    c = place[points] * is_letter
    a = len(alphabet)
    one = is_letter
    two = is_letter[:-1] | is_letter[1:]
    three = is_letter[1:-1]
    return alphabet, [
        (c[one], text_of[one]),
        ((a + c[:-1] * a + c[1:])[two], np.where(is_letter[:-1], text_of[:-1], text_of[1:])[two]),
        ((a + a * a + (c[:-2] * a + c[1:-1]) * a + c[2:])[three], text_of[1:-1][three]),
    ]


def gram_codes(ids: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Code points of the numbered n-grams, packed in an int64; the order is the same."""
    a, points = len(alphabet), alphabet.astype(np.int64)
    out = np.empty(len(ids), dtype=np.int64)
    one, three = ids < a, ids >= a + a * a
    two = ~one & ~three
    out[one] = points[ids[one]]
    x = ids[two] - a
    out[two] = points[x // a] << SHIFT | points[x % a]
    x = ids[three] - a - a * a
    out[three] = points[x // (a * a)] << 2 * SHIFT | points[x // a % a] << SHIFT | points[x % a]
    return out


def text_blocks(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers, and texts of about limit characters together. A longer text comes in parts, cut at white space, which no n-gram spans; each is a block, and all but its last have the row number -1 - row."""
    block, size, rows = [], 0, []
    for i, text in enumerate(batch.column("text")):
        text, at = text.as_py() or "", 0
        while len(text) - at > limit and (gap := SPACE.search(text, at + limit)):
            yield [-1 - i], [text[at : gap.end()]]
            at = gap.end()
        rows.append(i)
        block.append(text[at:])
        size += len(block[-1])
        if size >= limit or at:
            yield rows, block
            block, size, rows = [], 0, []
    if block:
        yield rows, block


def gram_counts(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a sorted list, in order, and how often each occurs."""
    if not len(own):
        return own, np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.diff(np.append(first, len(own)))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over a partition."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def summed(parts):
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [(codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64))]

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for rows, texts in text_blocks(batch):
            by_lang: dict[str, list[str]] = {}
            for i, text in zip(rows, texts):
                by_lang.setdefault(langs[i if i >= 0 else -1 - i], []).append(text)
            for lang, own in by_lang.items():
                alphabet, grams = dense_grams(own)
                parts = found.setdefault(lang, [])
                for ids, _ in grams:
                    if len(alphabet) <= 128:
                        counts = np.bincount(ids)
                        used = np.flatnonzero(counts)
                        counts = counts[used]
                    else:
                        used, counts = np.unique(ids, return_counts=True)
                    parts.append((gram_codes(used, alphabet), counts))
                if len(parts) > 60:
                    found[lang] = summed(parts)
    for lang, parts in found.items():
        (codes, counts) = summed(parts)[0]
        for at in range(0, len(codes), 50_000):
            c = codes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c), pa.array(counts[at : at + 50_000])], ["lang", "gram", "n"])


def train_profiles(docs: DataFrame, size: int = 300) -> DataFrame:
    """(lang, gram, place): each language's size most frequent n-grams (n = 1 to 3) in all given texts, place from 0; ties by code point.

    docs has text and lang; rows with a null lang teach nothing, null texts have no n-grams.
    """
    counts = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)  # each task keeps size before the shuffle
    return ranked.select("lang", "gram", (F.col("rank") - 1).alias("place"))


class Profiles:
    """The profiles as one matrix of places, for all languages at once."""

    def __init__(self, rows, size: int):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), self.langs.index(r["lang"])] = r["place"]

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        """The language at the least out-of-place distance from n-grams in order of frequency; ties to the first by name. Score: 1 less the distance's share of the greatest possible."""
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = len(self.grams) - 1
        places = self.places[np.where(self.grams[at] == codes, at, len(self.grams))]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(codes))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1 - float(apart[best]) / (self.size * len(codes))

    def languages(self, batch: pa.RecordBatch) -> Iterator[tuple[str, float]]:
        """The language of each text and its score."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # of the long text at hand
        for rows, texts in text_blocks(batch):
            alphabet, grams = dense_grams(texts)
            kind = np.int32 if len(alphabet) ** 3 * 1.1 < 2**31 else np.int64
            bounds = [np.searchsorted(t, np.arange(len(texts) + 1)) for _, t in grams]
            ids = [g.astype(kind) for g, _ in grams]
            for i, row in enumerate(rows):
                own, counts = gram_counts(np.sort(np.concatenate([g[b[i] : b[i + 1]] for g, b in zip(ids, bounds)])))
                if row < 0 or parts and i + 1 == len(rows):
                    parts.append((gram_codes(own.astype(np.int64), alphabet), counts))
                if row < 0:
                    continue
                if parts and i + 1 == len(rows):
                    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes))
                    parts = []
                    codes = codes[np.argsort(-counts, kind="stable")[: self.size]]
                else:
                    codes = gram_codes(own[np.argsort(-counts, kind="stable")[: self.size]].astype(np.int64), alphabet)
                yield self.nearest(codes) if len(codes) and self.langs else ("und", 0.0)


def identify_language(docs: DataFrame, training: DataFrame, size: int = 300, block_languages: int = 2000, carry: list[str] | None = None) -> DataFrame:
    """docs (of it, the columns in carry) with lang_pred (string) and score (0 to 1), learnt from training's text and lang.

    The profiles, size rows for each language, are broadcast in blocks of about
    block_languages languages; each block is a scan, and the best of all blocks
    is kept, ties to the first by name. `und` and 0 for texts that are null,
    empty or without a letter, and for all where training is empty. Of a very
    long text only the n-gram counts are held whole. Columns of these names in
    docs are replaced; others pass through. Repeated rows stay.
    """
    small_batches(docs.sparkSession)
    profiles = materialize(train_profiles(training, size))
    blocks = max(1, -(-profiles.select("lang").distinct().count() // block_languages))
    out = docs
    for block in range(blocks):
        own = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(Profiles(own.collect(), size))

        def predict(batch: pa.RecordBatch, shared=shared, block=block) -> Iterator[tuple[str, float]]:
            before = zip(*(batch.column(c).to_pylist() for c in ("lang_pred", "score"))) if block else None
            for lang, score in shared.value.languages(batch):
                if before and (last := next(before)) and last[0] != "und" and (lang == "und" or (-last[1], last[0]) < (-score, lang)):
                    lang, score = last
                yield lang, score

        last_block = block + 1 == blocks
        out = add_columns(out, "lang_pred string, score double", predict, carry if last_block else [c for c in out.columns if carry is None or c in (*carry, "text")])
    return out
