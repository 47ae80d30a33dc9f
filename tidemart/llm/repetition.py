"""Quality rules with suffix-array repetition.

For each text the suffix array of its words gives the longest common prefix of neighbouring
suffixes. From them follow the maximal repeated passages (those that neither a longer passage
to the left nor one to the right contains), the union of their spans, the fraction of words
covered, and the longest repeat. A text fails when too much of it is repeated or when one
repeat is too long; base rules on length and short-range repetition come first.

Suffix arrays of many texts are built at once: the rank of a suffix starts with the text it
belongs to, so suffixes of different texts never tie, and only suffixes that still tie take part
in the next doubling. Work is bounded by slices of about four megabytes of text; one longer
text is a slice of its own. No shuffle.

Defined cases: a null or empty text has no words and fails the base rule on length; rows are
kept as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemart.llm.common import slices, texts, word_hashes

# Base rules: values fixed by the contract.
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_NOT_COUNTED = bytes({*_SPACES, *range(0x80, 0xC0)})  # spaces and UTF-8 continuation bytes


@dataclass(frozen=True)
class Limits:
    """Repeats of fewer than ``least_repeat`` words do not count; the rest may cover at most
    ``most_covered`` of the words, and none may have more than ``longest_repeat`` words."""

    least_repeat: int = 20
    most_covered: float = 0.3
    longest_repeat: int = 100


def _regroup(ranks: np.ndarray, at: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Split groups of equal rank at ``at`` by ``second``; a rank is the index of its group's
    first suffix in sorted order. Returns the positions that still tie."""
    first = ranks[at]
    order = np.lexsort((second, first))
    at, first, second = at[order], first[order], second[order]
    here = np.arange(len(at))
    new_first = np.concatenate([[True], first[1:] != first[:-1]])
    new_both = new_first | np.concatenate([[True], second[1:] != second[:-1]])
    group = np.maximum.accumulate(np.where(new_first, here, 0))
    part = np.maximum.accumulate(np.where(new_both, here, 0))
    ranks[at] = first + part - group
    ends = np.concatenate([new_both[1:], [True]])
    return at[~(new_both & ends)]


def suffix_levels(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until none tie. ``words``
    numbers the words; ``ends`` is the end of the text of each position."""
    n = len(words)
    ranks = np.zeros(n, np.int64)
    tied = _regroup(ranks, np.arange(n), words + ends * (int(words.max(initial=0)) + 1))
    levels, length = [ranks.astype(np.int32)], 1
    while len(tied):
        after = tied + length
        inside = after < ends[tied]
        second = np.where(inside, ranks[np.minimum(after, n - 1)] + 1, 0)
        tied = _regroup(ranks, tied, second)
        levels.append(ranks.astype(np.int32))
        length *= 2
    return levels


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position, the longest passage that starts there and once more in the text:
    the larger of the common prefixes with both neighbours in the suffix array."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    levels = suffix_levels(words, ends)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    pairs = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[pairs].copy(), right[pairs].copy()
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    np.maximum.at(best, left[pairs], common)
    np.maximum.at(best, right[pairs], common)
    return best


def repeated_spans(best: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: number of maximal repeats of ``least`` words or more, longest repeat, words
    covered; and begin and end of the merged spans, as positions in the slice."""
    n = len(best)
    long = best >= least
    first = np.zeros(n, bool)
    first[starts[sizes > 0]] = True
    maximal = long & (first | (np.concatenate([[0], best[:-1]]) != best + 1))
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(long)
    change[at] += 1
    np.add.at(change, at + best[at], -1)
    covered = np.cumsum(change[:-1]) > 0

    def per_text(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[starts + sizes] - total[starts]

    longest = np.zeros(len(sizes), np.int64)
    if n:
        longest[sizes > 0] = np.maximum.reduceat(np.where(long, best, 0), starts[sizes > 0])
    before = np.concatenate([[False], covered[:-1]]) & ~first
    after = np.concatenate([covered[1:] & ~first[1:], [False]]) if n else covered
    return (per_text(maximal), longest, per_text(covered), np.flatnonzero(covered & ~before),
            np.flatnonzero(covered & ~after) + 1)


def repeat_words(words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions in windows of ``window`` words that occur twice or more in their text."""
    n = len(words)
    covered = np.zeros(n, bool)
    at = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(at):
        return covered
    ranks = np.zeros(n, np.int64)
    tied = _regroup(ranks, np.arange(n), words + ends * (int(words.max()) + 1))
    for k in range(1, window):
        tied = tied[tied + window <= ends[tied]]
        if len(tied):
            # a unique window of k words is unique with more; only the tied go on
            tied = _regroup(ranks, tied, words[tied + k])
    for k in range(window):
        covered[tied + k] = True
    return covered


def _measure(batch: list[bytes], limits: Limits) -> dict[str, list]:
    split = [t.split() for t in batch]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends_of = np.cumsum(sizes)
    starts = ends_of - sizes
    hashes = word_hashes([w for words in split for w in words])
    words = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    ends = np.repeat(ends_of, sizes)
    repeats = np.concatenate([[0], np.cumsum(repeat_words(words, ends))])
    n_repeats, longest, covered, begin, end = repeated_spans(
        longest_repeats(words, ends), starts, sizes, limits.least_repeat)
    cut = np.searchsorted(begin, np.concatenate([starts, [len(words)]]))
    spans = [list(zip((begin[a:b] - s).tolist(), (end[a:b] - s).tolist(), strict=True))
             for a, b, s in zip(cut, cut[1:], starts, strict=False)]
    dup_lines = []
    for text in batch:
        lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    n_repeat_words = repeats[ends_of] - repeats[starts]
    failed = (sizes < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEAT_PERCENT * sizes)
    kept = ~failed & (covered <= limits.most_covered * sizes) & (longest <= limits.longest_repeat)
    return {"n_words": sizes, "word_chars": [len(t.translate(None, _NOT_COUNTED)) for t in batch],
            "n_symbols": [len(t.translate(None, _NOT_SYMBOLS)) for t in batch],
            "n_dup_lines": dup_lines, "n_repeat_words": n_repeat_words, "base_failed": failed,
            "kept": kept, "n_repeats": n_repeats, "longest_repeat": longest,
            "covered_words": covered, "spans": spans}


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(),
            "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(),
            "kept": pa.bool_(), "n_repeats": pa.int64(), "longest_repeat": pa.int64(),
            "covered_words": pa.int64(), "spans": _SPANS}


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All measures, the merged repeated spans (in words) and the verdict of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = _measure(texts(batch), limits)
            spans = [[{"start": a, "end": b} for a, b in x] for x in found.pop("spans")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[k], kind) for k, kind in _COLUMNS.items()
                                           if k != "spans"), pa.array(spans, _SPANS)],
                ["doc_id", *_COLUMNS])

    names = {pa.int64(): "bigint", pa.bool_(): "boolean",
             _SPANS: "array<struct<start:bigint,end:bigint>>"}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, ", ".join([f"doc_id {kind}", *(f"{k} {names[t]}" for k, t in _COLUMNS.items())]))
