"""The encoder's cuts by Arrow against the tokenizers and tiktoken libraries."""

import base64
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from watchloom.llm import bytebpe, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "it's", " '", "'ll", "x1", "42", "!?", "<|endo",
        "<|endoftext|>", "é", "ß", "漢字", "\U0001f469‍\U0001f467", "́", "\r\n", "_", "١",
        "Ⅷ", "\U0001e030", "\x00"]


def _texts(bits):
    pick = random.Random(7)
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 25))) for _ in range(1500)]


def _encoded(coder, texts, together):
    for low in range(0, len(texts), together):
        ids, starts = coder.encode(pa.array(texts[low : low + together]))
        yield from (ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:]))


def test_ids_are_those_of_the_libraries():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(PATH)
    # Without the last one, no batch needs the plain way; with few texts to a batch, both ways are taken.
    for bits in (BITS[:-1], BITS, [b for b in BITS if not b.startswith("<|") and b != "\x00"]):
        texts = _texts(bits)
        for together in (1, 40):
            plain = bytebpe.Codec(PATH, public_tokenizers.PATTERN)
            assert list(_encoded(plain, texts, together)) == [ordinary.encode_ordinary(t) for t in texts]
            added = bytebpe.Codec(PATH, public_tokenizers.PATTERN, added=True)
            assert list(_encoded(added, texts, together)) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_nulls_and_forgetting(monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN_MATCHES", 3)
    coder = bytebpe.Codec(PATH, public_tokenizers.PATTERN, added=True)
    ids, starts = coder.encode(pa.array([None, "", "one two three, four", "<|endoftext|>five"]))
    assert starts[:3].tolist() == [0, 0, 0]
    again, _ = coder.encode(["one two three, four", "<|endoftext|>five"])
    assert ids.tolist() == again.tolist() and 50256 in ids


def test_files_take_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", None, "x <|endoftext |>"]
    tokenfiles.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "files"))
    rows = tokenfiles.read(spark, str(tmp_path / "files")).orderBy("doc_id").collect()
    whole = Tokenizer.from_file(PATH)
    assert [r.ids for r in rows] == [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
