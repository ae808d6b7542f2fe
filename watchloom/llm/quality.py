"""Quality rules, lines first: bad lines go, then documents that lost too much.

A line is judged on its own:

* ``symbols``: more of its characters are symbols than letters or digits;
* ``navigation``: at least three short items between separators (``|``, ``>``, bullets);
* ``boilerplate``: it holds one of the fixed phrases of notices and forms;
* ``repeated``: a line of the same text came before in the document.

Failing lines are removed. A document is rejected if more than ``MOST_LOST`` of
its words were in such lines. Two further rules are counted over whole texts
(``base_failed``): fewer than 50 words, or more than half of the words in
repeated three-word runs.

Given rows: a null or empty text has no words and is rejected; repeated rows
are judged alike; whole texts are judged, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from watchloom.llm.words import Words, pieces
from watchloom.session import ship_package

LEAST_WORDS = 50
MOST_LOST = 0.5
SYMBOLS = "[#*$%&|<>]"

# Fixed phrases, lower case.
PHRASES = (
    "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of service",
    "terms and conditions", "terms of use", "subscribe to our newsletter", "sign up for our", "click here to",
    "log in to", "licensed under", "enable javascript", "follow us on", "share this", "read more", "back to top",
    "powered by", "skip to content",
)
_PHRASE = regex.compile("|".join(map(regex.escape, PHRASES)))
_ITEM = regex.compile(r"\s*[|>»•·]+\s*")
_WORDY = regex.compile(r"[\p{L}\p{N}]")
_SYMBOL = regex.compile(r"[^\p{L}\p{N}\p{M}\p{P}\s]|[#*$%&|<>@]")


def line_fault(line: str) -> str | None:
    """Name of the first rule that a line breaks, apart from repetition."""
    if len(_SYMBOL.findall(line)) > len(_WORDY.findall(line)):
        return "symbols"
    items = [x for x in _ITEM.split(line) if x]
    if len(items) >= 3 and all(len(x.split()) <= 3 for x in items):
        return "navigation"
    if _PHRASE.search(line.lower()):
        return "boilerplate"
    return None


def repeated_words(words: Words, run: int = 3) -> np.ndarray:
    """Per text, the words that lie in a three-word run found twice or more in it."""
    total, size = len(words.codes), max(0, len(words.codes) - run + 1)
    covered = np.zeros(total, dtype=bool)
    if size:
        ends = np.repeat(words.starts[1:], words.counts)
        at = np.flatnonzero(np.arange(size) + run <= ends[:size])
        key = words.owners[at]
        for j in range(run):  # numbers of (text, words so far); exact, no hashes
            _, key = np.unique(key * len(words.vocabulary) + words.codes[at + j], return_inverse=True)
        again = at[np.bincount(key)[key] >= 2]
        for j in range(run):
            covered[again + j] = True
    done = np.concatenate([[0], np.cumsum(covered)])
    return done[words.starts[1:]] - done[words.starts[:-1]]


def cleaned(text: str) -> tuple[str, int, int]:
    """(text without failing lines, words in the lines removed, repeated lines with a word)."""
    seen: set[str] = set()
    faults: dict[str, bool] = {}
    kept, lost, repeats = [], 0, 0
    for line in text.split("\n"):
        words = len(line.encode().split())
        if not words:
            kept.append(line)
            continue
        if line in seen:
            repeats += 1
            lost += words
            continue
        seen.add(line)
        if line not in faults:
            faults[line] = line_fault(line) is not None
        if faults[line]:
            lost += words
        else:
            kept.append(line)
    return "\n".join(kept), lost, repeats


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def judge(documents: DataFrame, with_text: bool = True, least_words: int = LEAST_WORDS,
          most_lost: float = MOST_LOST) -> DataFrame:
    """Adds the counts of ``NUMBERS``, ``base_failed``, ``kept`` and, if wanted, ``clean_text``.

    Row by row, without a shuffle. Input columns of these names are replaced.
    """
    ship_package(documents.sparkSession)
    added = [*(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("base_failed", T.BooleanType()),
             T.StructField("kept", T.BooleanType())]
    if with_text:
        added.append(T.StructField("clean_text", T.StringType()))
    given = documents.drop(*(f.name for f in added))
    schema = T.StructType([*given.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = pc.fill_null(piece.column("text"), "")
            words = Words(texts)
            n = words.counts
            chars = np.asarray(pc.utf8_length(words.vocabulary), dtype=np.int64)
            total = np.concatenate([[0], np.cumsum(chars[words.codes])])
            word_chars = total[words.starts[1:]] - total[words.starts[:-1]]
            symbols = np.asarray(pc.count_substring_regex(texts, SYMBOLS), dtype=np.int64)
            repeat = repeated_words(words)
            clean = [cleaned(t) for t in texts.to_pylist()]
            lost = np.array([c[1] for c in clean], dtype=np.int64)
            dup = np.array([c[2] for c in clean], dtype=np.int64)
            failed = (n < least_words) | (100 * repeat > 50 * n)
            kept = ~failed & (lost <= most_lost * n)
            columns = [*map(pa.array, (n, word_chars, symbols, dup, repeat, lost, failed, kept))]
            if with_text:
                columns.append(pa.array([c[0] for c in clean], pa.string()))
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], schema.names)

    return given.mapInArrow(run, schema)
