"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // 2048 pieces of the full length and one piece for each bit of the rest, largest
first. Every piece is a sequence of its own, so none crosses documents and nothing is padded; sequences of equal length
form a bucket, from which a trainer draws batches of one shape (``write_buckets``).

Each document is handled alone, without a shuffle. A text is tokenized word by word: the tokenizer drops white space and
never joins across it, so words are encoded once and their ids reused from a bounded table in the worker. Memory is that
table (KNOWN_CHARS characters of words in each of two generations), the words of GROUP_CHARS characters of texts, or of one
longer text and its ids.

The tables and the cutting of words hold for tokenizers that lower the case, drop white space and cut at punctuation. Any
other tokenizer file is refused by a check of its answers, rather than given wrong ids.

Defined cases: a null or empty text is the single end token, one piece of length 1; repeated rows and repeated ids are
packed like others, each with sequences of its own; a null doc_id goes through.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postloom.llm.common import fields, groups

VOCABULARY = "word_bpe_49k.json"
END, FULL = 1, 2048
KNOWN_CHARS = 4_000_000             # characters of the words whose ids a worker keeps, in each of two generations
LONG_WORD = 100                     # a longer word is encoded each time
GROUP_CHARS = 1_000_000             # bytes of texts handled together
GROUP = 200                         # words that are encoded as one text
# texts, and parts that must give the same ids
PROBES = (("Aa,b  (c)\n\tDÉ.", ("aa", ",", "b", "(", "c", ")", "dé", ".")), ("x!! y", ("x", "!!", "y")))
_TAIL = re.compile(rb"[.,!?;:](?<=[a-z].)")     # punctuation that ends a run of letters


class WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes."""
    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.young_chars = 0
        for text, parts in PROBES:
            whole, cut = ([i for t in ts for i in self.tokenizer.encode(t, add_special_tokens=False).ids] for ts in ([text], parts))
            if whole != cut:
                raise ValueError(f"{path} does not lower the case, drop white space and cut at punctuation")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [b"\xcc", b"\xcd", *{t.content.encode()[:2] for t in added}]     # the first two: U+0300 to U+036F
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)     # ids that end a word
        if suffix:
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    @classmethod
    def get(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def words(self, raw: bytes) -> list[bytes]:
        """Words of a text, in lower case and cut before punctuation after a letter: so a word is known whatever its case
        and whatever follows it. A text that may hold a special token, or a mark that composes with small letters only, is
        just split."""
        if not any(m in raw for m in self.marks):
            raw = _TAIL.sub(rb" \g<0>", raw.lower())
        return raw.split()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Words of letters are encoded many at a time and cut apart at the ids that end a word."""
        plain, alone, out = [], [], {}
        for w in words:
            (plain if w.isalpha() or w.decode("utf-8", "replace").isalpha() else alone).append(w)
        parts = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        made = self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)
        for part, x in zip(parts, made, strict=True):
            ids = np.array(x.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                raw, cuts = ids.tobytes(), ends.tolist()
                out.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:                        # the ids don't show where words end
                alone += part
        made = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False)
        out.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(alone, made, strict=True))
        return out

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """A table with the ids of all of ``words``."""
        if self.young_chars > KNOWN_CHARS:
            self.old, self.young, self.young_chars = self.young, {}, 0
        made, new = {}, []
        for w in set(filterfalse(self.young.__contains__, words)):
            ids = self.old.get(w)
            if ids is None:
                new.append(w)
            else:
                made[w] = ids
        made.update(self._encode(new))
        if max(map(len, made), default=0) > LONG_WORD:
            self._keep({w: x for w, x in made.items() if len(w) <= LONG_WORD})
            return self.young | made
        self._keep(made)
        return self.young

    def _keep(self, made: dict[bytes, bytes]) -> None:
        self.young.update(made)
        self.young_chars += sum(map(len, made))


def pieces_of(n: int, full: int = FULL) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    out = [(i, full) for i in range(0, n - full + 1, full)]
    at, rest = n - n % full, n % full
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, path: str | None = None, full: int = FULL) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row a piece.

    ``sequence_id`` numbers the pieces in the order of the input's partitions; it is unique, and the same on every run
    over the same files.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    if full & (full - 1):
        raise ValueError("the full length must be a power of two")
    key = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        ids = WordIds.get(path)
        for batch in batches:
            for part in groups(batch, "text", GROUP_CHARS):
                texts = [ids.words(x or b"") for x in part.column("text").cast(pa.binary()).to_pylist()]
                table = ids.learn(chain.from_iterable(texts))
                row, start, length, tokens, made = [], [], [], [], []
                for i, words in enumerate(texts):
                    whole = b"".join(map(table.__getitem__, words)) + end
                    n = len(whole) // 4
                    for s, size in pieces_of(n, full):
                        row.append(i)
                        start.append(s)
                        length.append(size)
                        tokens.append(n)
                        made.append(whole[4 * s:4 * (s + size)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(made, pa.binary()), pa.array(tokens, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"])

    made = fields(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {key}, start long, length long, ids binary, doc_tokens long")
    return made.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def ids_crc32() -> Column:
    return F.crc32("ids")


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", ids_crc32().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length."""
    packed.write.partitionBy("length").parquet(path)
