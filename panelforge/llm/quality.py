"""Repetition rules on documents, from the enhanced suffix array of their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.common import batch_of, map_rows, text_rows
from panelforge.llm.suffix import covered, maximal_repeats, suffix_array

SYMBOLS = b"#*$%&|<>"
#: Words of the texts that share a suffix array; a longer text has one alone.
WORDS_AT_ONCE = 300_000


def _symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, different in every text, and the first place of each text."""
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    return number + np.repeat(np.arange(len(texts)), sizes) * max(1, len(ids)), np.r_[0, np.cumsum(sizes)]


def repetition(texts: list[list[bytes]], window: int = 5, least: int = 8) -> list[tuple[int, int, int]]:
    """For each list of words: words in repeated windows, words covered by maximal repeats, longest repeat.

    The first number counts words in `window`-word windows found twice or
    more, the first included.  The second is the union of the spans of all
    occurrences of maximal repeats of `least` words or more; the third the
    words of the longest maximal repeat of `window` words or more.  One suffix
    array serves many texts: their symbols differ, so no repeat crosses.
    """
    symbols, first = _symbols(texts)
    n = len(symbols)
    sa, common = suffix_array(symbols)
    before = np.r_[np.int64(-1), symbols[:-1]]
    before[first[:-1][first[:-1] < n]] = -1 - np.arange(int((first[:-1] < n).sum()))
    longest_here = np.zeros(n, np.int64)
    longest_here[sa] = np.maximum(common, np.r_[common[1:], 0]) if n else common
    begins = np.flatnonzero(longest_here >= window)
    in_window = covered(begins, begins + window, n)
    starts, ends, longest = [], [], np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    for length, a, b in maximal_repeats(sa, common, before, window):
        where = sa[a:b]
        text = owner[where[0]]
        longest[text] = max(longest[text], length)
        if length >= least:
            starts.append(where)
            ends.append(where + length)
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    in_repeat = covered(join(starts), join(ends), n)
    count = lambda mask: np.bincount(owner[mask], minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    return list(zip(count(in_window).tolist(), count(in_repeat).tolist(), longest.tolist()))


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """Code points in words, symbol characters, lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= int((np.frombuffer(b"".join(words), np.uint8) & 0xC0 == 0x80).sum())
    return chars, sum(raw.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines))


def quality_rules(
    docs: DataFrame, least_words: int = 10, most_repeated: int = 20, least: int = 8, most_covered: float = 0.2, longest: int = 60, longest_share: float = 1.0
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept.

    base_failed: under `least_words` words, or more than `most_repeated`
    percent of the words in repeated 5-word windows.  kept: not failed,
    maximal repeats of `least` words or more cover at most the fraction
    `most_covered` of the words and the longest has at most `longest` words and,
    from `least` words on, at most the fraction `longest_share` of them.  A
    `most_covered` of `most_repeated` percent or more rejects nothing further:
    every covered word lies in a repeated window.
    Null and empty texts have no words and fail; texts of any length are read
    whole, a very long one in a suffix array of its own, whose memory grows
    with it; null doc_ids and repeated rows stay; an empty table gives none;
    other columns are not read.
    """

    def make():
        def of_some(raws):
            words = [x.split() for x in raws]
            for raw, w, (repeated, in_repeat, most) in zip(raws, words, repetition(words, 5, least)):
                chars, symbols, lines = base_counts(raw, w)
                failed = len(w) < least_words or 100 * repeated > most_repeated * len(w)
                kept = not failed and in_repeat <= most_covered * len(w) and most <= longest and (most < least or most <= longest_share * len(w))
                yield len(w), chars, symbols, lines, repeated, in_repeat, most, failed, kept

        def run(batch):
            rows, some, size = [], [], 0
            for raw in batch.column("raw").to_pylist():
                some.append(raw or b"")
                size += len(some[-1])
                if size > 6 * WORDS_AT_ONCE:
                    rows += of_some(some)
                    some, size = [], 0
            rows += of_some(some)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept")
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            return batch_of(doc_id=batch.column("doc_id"), **{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds))})

        return run

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    return map_rows(text_rows(docs), make, "doc_id long, " + ", ".join(f"{x} long" for x in longs) + ", base_failed boolean, kept boolean")
