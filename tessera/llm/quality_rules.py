"""Quality rules with suffix-array repetition.

A text's words are sorted as suffixes (prefix doubling over many texts at once; texts never match each other).
Neighbours in that order share a longest common prefix; a longest-common-prefix interval is a range of suffixes whose
neighbours all share so many words, and its string is a maximal repeated substring. The intervals aren't listed: the
longest string of any interval that a suffix is in is the larger of its prefixes with its two neighbours, and it holds
all shorter ones, so the union of these spans over all suffixes is that of all occurrences of all maximal repeats. Spans
of MIN_REPEAT words or more give the covered fraction; the longest common prefix is the longest repeat. A text is kept if
it passes the base rules, the fraction is at most MAX_COVERED per cent and no repeat is longer than MAX_REPEAT words.

The base rules count short repeats (three words). The fraction looks at passages: a text in which sentences or paragraphs
come twice can have few of its words in short repeats and still fail by it, while one line that stands twice in a short
text doesn't count.

Defined cases: null or empty text has no words and fails; equal rows give equal results, one for each row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import words as w
from tessera.llm.common import docs_of, map_arrow, slices, texts
from tessera.llm.suffixes import longest_repeats

MIN_REPEAT = 20
MAX_COVERED = 30
MAX_REPEAT = 200
SLICE_BYTES = 2 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def _marked(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n places the spans cover."""
    depth = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def _dup_lines(words: w.Words) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    data, n_docs = words.data, len(words.bounds) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([words.bounds[:-1], breaks + 1]))
    cuts = np.sort(np.concatenate([breaks, words.bounds[1:]]))
    doc = np.searchsorted(words.bounds[1:], cuts, "left")
    # a text's end is a cut after all line ends in it, so starts and ends pair up in order
    full = np.searchsorted(words.start, cuts) > np.searchsorted(words.start, start)
    start, cuts, doc = start[full], cuts[full], doc[full]
    if not len(start):
        return np.zeros(n_docs, np.int64)
    doc = np.searchsorted(words.bounds, start, "right") - 1
    key = w.mix(w.byte_hashes(data, start, cuts) ^ w.mix(doc.astype(w.U)))
    o = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[o][1:] == key[o][:-1]])
    return np.bincount(doc[o][again], minlength=n_docs)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    words = w.split(column)
    n, n_docs = len(words.start), len(column)
    repeats = longest_repeats(w.mix(words.hash ^ w.mix(words.doc.astype(w.U))))
    long, three = np.flatnonzero(repeats >= MIN_REPEAT), np.flatnonzero(repeats >= 3)
    chars = np.concatenate([[0], np.cumsum(~_CONTINUES[words.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, words.doc, repeats)
    return {
        "n_words": np.diff(words.first),
        "word_chars": words.per_doc(chars[words.end] - chars[words.start]),
        "n_symbols": symbols[words.bounds[1:]] - symbols[words.bounds[:-1]],
        "n_dup_lines": _dup_lines(words),
        "n_repeat_words": words.per_doc(_marked(n, three, 3)),
        "n_covered_words": words.per_doc(_marked(n, long, repeats[long])),
        "longest_repeat": longest,
    }


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (100 * m["n_covered_words"] <= MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), texts(batch.column(1))
        for lo, hi in slices(column, SLICE_BYTES):
            m = measure(column.slice(lo, hi - lo))
            failed, kept = _verdict(m)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in m.values()), pa.array(failed), pa.array(kept)], ["doc_id", *m, "base_failed", "kept"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, base_failed and kept."""
    return map_arrow(docs_of(docs), _rows, SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(batch.schema.get_field_index("text")))
            for lo, hi in slices(column, SLICE_BYTES):
                yield batch.slice(lo, hi - lo).filter(pa.array(_verdict(measure(column.slice(lo, hi - lo)))[1]))

    return map_arrow(docs, rows, docs.schema)
