"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is tried: those that the library encodes alone as one token form a
set that is proved by trial, not assumed (a vocabulary string that no merge order reaches is left out).
A pre-token in the set counts one without merging; only the others are merged by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_file
from .pretokens import CHUNK, byte_string, pattern, plain, split_spaces, unassigned

#: Entries of the memo from chunk to count that a Python worker keeps; it is emptied when full.
MEMO_ENTRIES = 1_000_000

_STATE: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens of texts as one tokenizer file's library does, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = pattern()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.whole_tokens()
        self.memo: dict[str, int | None] = {}
        self.merged: dict[str, int] = {}

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        strings = self.tokenizer.decode_batch([[i] for i in range(self.tokenizer.get_vocab_size())], skip_special_tokens=False)
        strings = [s for s in dict.fromkeys(strings) if s and "�" not in s and s not in self.special]
        encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, encoded) if len(e) == 1 and self.pattern.findall(s) == [s])

    def merge(self, pre_token: str) -> int:
        """Tokens of a pre-token by the library's merges."""
        n = self.merged.get(pre_token)
        if n is None:
            n = self.merged[pre_token] = len(self.tokenizer.model.tokenize(byte_string(pre_token)))
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk: one for each whole pre-token, merges for the rest."""
        if chunk in self.whole:
            return 1
        if chunk.isascii():
            parts = (chunk,) if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else self.pattern.findall(chunk)
        elif unassigned(chunk):
            return len(self.tokenizer.encode(chunk, add_special_tokens=False))
        else:
            parts = self.pattern.findall(chunk)
        whole, merge = self.whole, self.merge
        return sum(1 if p in whole else merge(p) for p in parts)

    def learn(self, pieces: Iterable[str]) -> None:
        for piece in pieces:
            self.memo[piece] = self.chunk(" " + piece) if plain(piece) else None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings, which the library takes out first."""
        if not any(s in text for s in self.special):
            yield text, False
            return
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part:
                yield part, part in self.special

    def part(self, text: str) -> int:
        """Tokens of a text whose pieces the memo has."""
        first, *rest = split_spaces(text)
        if plain(first):
            try:
                return self.chunk(first) + sum(map(self.memo.__getitem__, rest))
            except TypeError:  # a piece with white space at an end
                pass
        return sum(map(self.chunk, CHUNK.findall(text)))

    def count(self, texts: list[str]) -> list[int]:
        new: set[str] = set()
        for text in texts:
            new.update(split_spaces(text))
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            self.merged.clear()
        self.learn(new.difference(self.memo))
        if not any(s in text for s in self.special for text in texts):
            return list(map(self.part, texts))
        out = []
        for text in texts:
            parts = list(self.pieces(text))
            self.learn({p for part, special in parts if not special for p in split_spaces(part)}.difference(self.memo))
            out.append(sum(1 if special else self.part(part) for part, special in parts))
        return out


def counter(path: str) -> Counter:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = Counter(path)
    return _STATE[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One pass without a shuffle; texts of any length are read whole.  A null text counts as empty
    (0 bytes, 0 tokens); null ids, repeated rows and other columns are carried or ignored as they are;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for part in slices(batches, 1):
            texts = part.column(1).to_pylist()
            n = count(texts)
            yield pa.record_batch(
                [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; see ``count_tokens`` for special cases."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))
