"""Token counts: texts are encoded in Arrow functions that return lengths only.

Long texts are split where a byte-level pre-tokeniser ends a token whatever follows, so the counts
of the pieces add up to that of the whole text.  Pieces are dealt into batches of equal bytes; of a
batch, each word with the space before it is encoded once, if the worker has not met it lately.
Tokenizers with other pre-tokenisers get whole texts, in batches of equal bytes as well.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import arrow_map, table, utf8

#: Characters of a piece before the next safe boundary, characters of a batch, characters of the
#: words a worker remembers, and the number of tokens beyond which a text is over the limit.
PIECE_CHARS, BATCH_CHARS, WORD_CHARS, TOKEN_LIMIT = 1 << 14, 1 << 18, 1 << 22, 512

#: A letter or digit before white space or plain punctuation, and ASCII letters beside digits.  No
#: token of a byte-level pre-tokeniser spans these places, and no match depends on what is beyond.
_BOUNDARY = re.compile(r"(?<=[^\W_])(?=[ \n.,;:!?、。，！？；：])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

#: White space before a space: the two may be one token with the space of the next word.
_UNEVEN = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def split_text(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that end at the first safe boundary after ``chars`` characters; a text
    without boundaries is one piece."""
    at = 0
    while len(text) - at > chars:
        found = _BOUNDARY.search(text, at + chars)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _splits_safely(spec: dict) -> bool:
    """Whether ``_BOUNDARY`` holds: no normalizer, a byte-level pre-tokeniser by itself, and no
    added token that could contain a boundary or take in what stands beside it."""
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _BOUNDARY.search(t["content"]) for t in added)
    )


@functools.lru_cache(maxsize=4)
def _encoder(name: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """From texts to their token counts, and whether texts may be split; one a worker."""
    path = _path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = file.read()
    model = Tokenizer.from_str(spec)
    model.no_truncation()
    model.no_padding()
    count, split = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], _splits_safely(json.loads(spec))
    return WordCounts(count) if split else count, split


def _batches(texts: Iterator[str], split: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of about ``BATCH_CHARS`` characters together, with the places of their texts."""
    rows, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        for piece in split_text(text, PIECE_CHARS) if split else (text,):
            if pieces and held + len(piece) > BATCH_CHARS:
                yield rows, pieces
                rows, pieces, held = [], [], 0
            rows.append(row)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield rows, pieces


def words_of(piece: str) -> list[str]:
    """A piece in words, each with what stands before it from a space on."""
    if _UNEVEN.search(piece):
        return _BEFORE_SPACE.split(piece)
    first, *rest = piece.split(" ")
    return [first, *[" " + w for w in rest]]


class WordCounts:
    """Tokens of pieces by their words, which are remembered up to ``WORD_CHARS`` characters."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count, self.known, self.held = count, {}, 0

    def __call__(self, pieces: list[str]) -> list[int]:
        each = [words_of(p) for p in pieces]
        new = sorted(set().union(*each).difference(self.known))
        self.known.update(zip(new, self.count(new)))
        self.held += sum(map(len, new))
        out = [sum(map(self.known.__getitem__, words)) for words in each]
        if self.held > WORD_CHARS:
            self.known, self.held = {}, 0
        return out


def token_counts(texts: Iterator[str], count: Callable[[list[str]], list[int]], split: bool, n: int) -> np.ndarray:
    """Tokens of each of ``n`` texts."""
    total = np.zeros(n, np.int64)
    for rows, pieces in _batches(texts, split):
        np.add.at(total, rows, count(pieces))
    return total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for every row of ``docs``.

    ``tokenizer`` is a file of the public tokenizers or an absolute path that all executors have, a
    ``.json`` for tokenizers or a ``.model`` for sentencepiece.  Nothing is added, truncated or
    padded; special strings in a text count as the library takes them by default.  Null and empty
    texts have no bytes and no tokens, bytes that are no UTF-8 count as replacement characters, and
    rows that repeat or have no id are counted as they come.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        count, split = _encoder(tokenizer)
        data = batch.column(1)
        texts = (data[i].as_py().decode("utf-8", "replace") for i in range(len(data)))
        return {"doc_id": batch.column(0), "n_bytes": pc.binary_length(data).cast("int64"), "n_tokens": token_counts(texts, count, split, len(data))}

    found = arrow_map(docs.select("doc_id", utf8(F.col("text"))), fn, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
