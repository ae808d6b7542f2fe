"""Byte-level BPE: encoding with offsets, and decoding that copes with split characters.

Each match of the split pattern is encoded on its own by the tokenizers library's
model, over characters: every byte has a character of its own in the alphabet
of the vocabulary. Arrow cuts the texts where a match ends in any text, into stretches of
one match or a few; a batch holds far fewer different stretches than stretches, so each
different one is split and encoded once, remembered for later batches, and the ids are
laid out by table lookup.
Decoding maps the characters back to bytes. A character may be split over
several tokens, so ids decode to bytes, and offsets count bytes and characters:
a token that ends inside a character ends, in characters, before it.

Given rows: null and empty texts have no tokens and decode to empty bytes;
repeated rows are encoded alike; a text of any length is encoded whole. Special
tokens that occur in a text are ordinary text, or their ids if that is asked for (``added``).
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from watchloom.llm.words import pieces, whole
from watchloom.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
KNOWN_MATCHES = 600_000  # that a task remembers from one batch to the next
CUT = "\x00"
# The usual pattern ends a match between a letter and one of these, and before a space with one of those.
ENDS = r"(\pL)([\x01-\x40\x5B-\x60\x7B-\x7F])"
BEGINS = r"([^\x00]) ([!-~\pL\pN])"


def byte_alphabet() -> dict[str, int]:
    """Byte of each alphabet character: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str, pattern: str, added: bool = False):
        tokenizer = Tokenizer.from_file(path)
        self.tokenize = tokenizer.model.tokenize
        self.split = regex.compile(pattern).findall
        self.usual = pattern == public_tokenizers.PATTERN
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} if added else {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.around_added = f"({'|'.join(map(regex.escape, longest_first))})" if self.added else None
        alphabet = byte_alphabet()
        self.to_alphabet = str.maketrans({chr(b): c for c, b in alphabet.items()})
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        size = max([*vocabulary.values(), *added]) + 1
        tokens = [b""] * size
        for token, number in vocabulary.items():
            tokens[number] = added.get(number) or bytes(alphabet[c] for c in token)
        self.bytes_of = tokens
        self.length_of = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.firsts, self.sizes = array("I"), array("i"), array("i")
        for token, number in self.added.items():
            self._learn(token, [number])

    def _learn(self, stretch: str, ids: list[int]) -> int:
        number = self.known[stretch] = len(self.known)
        self.firsts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return number

    def match_ids(self, match: str) -> list[int]:
        """Ids of one match, by way of its bytes' characters."""
        raw = match if match.isascii() else match.encode().decode("latin-1")
        return [t.id for t in self.tokenize(raw.translate(self.to_alphabet))]

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        """Place of each stretch in the tables of what is known."""
        find, split, match_ids, out = self.known.get, self.split, self.match_ids, []
        for stretch in stretches:
            number = find(stretch)
            if number is None:
                one = self.usual and stretch.isascii() and stretch.removeprefix(" ").isalpha()
                ids = match_ids(stretch) if one else [i for match in split(stretch) for i in match_ids(match)]
                number = self._learn(stretch, ids)
            out.append(number)
        return np.array(out, dtype=np.int32)

    def _stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(stretches, starts): text i has those of starts[i]:starts[i + 1]; none reaches over the end of a match."""
        apart = f"{CUT}|{self.around_added}" if self.around_added else CUT
        if self.usual and not pc.any(pc.match_substring_regex(texts, apart)).as_py():
            texts = pc.replace_substring_regex(texts, ENDS, r"\1" + CUT + r"\2")
            lists = pc.split_pattern(pc.replace_substring_regex(texts, BEGINS, r"\1" + CUT + r" \2"), CUT)
            flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        else:
            found, ends = [], [0]
            parts_of = regex.compile(self.around_added).split if self.around_added else lambda text: [text]
            for text in texts.to_pylist():
                for part in parts_of(text):
                    found.extend([part] if part in self.added else self.split(part))
                ends.append(len(found))
            flat, starts = pa.array(found, pa.large_string()), np.array(ends, dtype=np.int64)
        kept = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
        if not kept.all():  # of empty texts and of texts that begin with a cut
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            flat = flat.filter(pa.array(kept))
        return flat, starts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, starts): text i has ids[starts[i]:starts[i + 1]]; null is empty."""
        given = whole(texts) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        stretches, starts = self._stretches(pc.fill_null(given, "").cast(pa.large_string()))
        if not len(stretches):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > KNOWN_MATCHES:
            self._forget()
        coded = stretches.dictionary_encode()
        places = self._numbers(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        firsts, sizes = (np.frombuffer(table, dtype=np.int32)[places] for table in (self.firsts, self.sizes))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat((firsts - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(self.flat, dtype=np.uint32)[at]
        return ids, np.concatenate([[0], ends])[starts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens; characters that tokens split come together again."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End of each token in bytes and in whole characters of the text."""
        ends = np.cumsum(self.length_of[ids])
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        inside = np.concatenate([(raw & 0xC0) == 0x80, [False]])[ends] if len(ids) else np.zeros(0, bool)
        return ends, begun[ends] - inside


@functools.cache
def codec(path: str, pattern: str, added: bool = False) -> Codec:
    return Codec(path, pattern, added)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def id_text(ids: np.ndarray) -> bytes:
    return b" ".join(map(b"%d".__mod__, ids.tolist()))


OUTPUT = {
    "ids": T.ArrayType(T.IntegerType()),
    "byte_ends": T.ArrayType(T.LongType()),
    "char_ends": T.ArrayType(T.LongType()),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "ids_crc32": T.LongType(),
}


def encoded(documents: DataFrame, outputs: tuple[str, ...] = ("ids", "byte_ends", "char_ends"),
            path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds columns of ``OUTPUT``, row by row, without a shuffle.

    ``decoded`` and the digests come from the ids, not from the text. A column
    of the input that has the name of an output is replaced.
    """
    spark = documents.sparkSession
    ship_package(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    given = documents.drop(*outputs)
    schema = T.StructType([*given.schema.fields, *(T.StructField(n, OUTPUT[n]) for n in outputs)])
    kinds = {"ids": pa.int32(), "byte_ends": pa.int64(), "char_ends": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for piece in pieces(batches, "text"):
            ids, starts = coder.encode(piece.column("text"))
            parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:])]
            columns = []
            spots = None
            raw = [coder.decode(p) for p in parts] if {"decoded", "decoded_sha256"} & set(outputs) else None
            for name in outputs:
                if name == "ids":
                    values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
                elif name in ("byte_ends", "char_ends"):
                    spots = spots or [coder.offsets(t, p) for t, p in zip(texts_of(piece.column("text")), parts)]
                    values = pa.array([s[name == "char_ends"] for s in spots], pa.list_(kinds[name]))
                elif name == "decoded":
                    values = pa.array(raw, pa.binary())
                elif name == "n_tokens":
                    values = pa.array(np.diff(starts))
                elif name == "ids_sha256":
                    values = pa.array([hashlib.sha256(id_text(p)).hexdigest() for p in parts], pa.string())
                elif name == "decoded_sha256":
                    values = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
                else:
                    values = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
                columns.append(values)
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], [*piece.schema.names, *outputs])

    return given.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None,
            pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``text`` from a column of ids; bytes that are no whole character become U+FFFD, a null list null."""
    ship_package(rows.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    given = rows.drop("text")
    schema = T.StructType([*given.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, dtype=np.int64)).decode("utf-8", "replace")
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"]
            )

    return given.mapInArrow(run, schema)
