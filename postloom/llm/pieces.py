"""SentencePiece encoding and decoding for merge-type (BPE) models, without the library's encoder.

A merge-type model joins, again and again, the neighbours whose joined piece has the highest score, the leftmost first. The
result is the only sequence of pieces of which each adjacent pair is left alone when its own text is merged again. So a
text need not be merged: it is walked from left to right, taking the longest piece that an Aho-Corasick automaton finds at
each place and that is compatible with the piece before. Where none is, the place is marked in a bitfield as failed and the
piece before is replaced by its next shorter prefix. No place fails twice, so the work is linear in the text.

Texts are cut where no piece can reach across (before spaces, around line feeds, between Latin letters and other
characters); each pattern is used only if every piece of the model lies within one of its cuts, otherwise a plainer one, at
last the whole text. Cuts recur, so their ids are kept in a table of bounded size in the worker, as are checked pairs. New
cuts are first tiled together, in one pass of the automaton over all of them, and their pairs checked by look-up; only
those with an incompatible pair or an unknown character are walked one by one.

Decoding gathers the pieces' bytes, drops the space put before the text, and turns bytes that are no UTF-8 into U+FFFD.

Each document is handled alone, without a shuffle. Memory in a worker: the two tables, one group of texts of GROUP_CHARS
together, or the ids of one longer text.

Defined cases: a null text counts as empty and has no ids; repeated rows and ids go through; a null doc_id goes through; a
character outside the vocabulary becomes its UTF-8 bytes' pieces, or the unknown id in a model without them; the space
mark U+2581 in a text is a space.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from hashlib import sha256

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from postloom.llm.common import fields, groups

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
# finest first; a piece of the model must never span two matches
CUTS = (rf"\n| *[{LATIN}]+| *[^{LATIN} \n]+| +", r"\n| *[^ \n]+| +", r"(?s).+")
KNOWN_CHARS = 2_000_000             # characters of the cuts kept in a worker, in each of two generations
KNOWN_PAIRS = 300_000
LONG_CUT = 100                      # a longer cut is encoded each time
GROUP_CHARS = 1_000_000             # texts encoded together


class Pieces:
    """A model's pieces; ids are little-endian unsigned 32-bit."""
    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        library = SentencePieceProcessor(model_file=path)
        if library.normalize("  aﬁ \n") != f"{SPACE * 3}aﬁ{SPACE}\n":
            raise ValueError("only models with the identity normaliser, a dummy prefix and all spaces kept are supported")
        size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        self.name = [n.replace(SPACE, " ") for n in names]
        self.score = [library.get_score(i) for i in range(size)]
        self.id = {self.name[i]: i for i in range(size) if not special[i]}
        self.unknown = library.unk_id()
        self.is_byte = np.array([library.is_byte(i) for i in range(size)])
        self.byte = {int(names[i][1:-1], 16): i for i in np.flatnonzero(self.is_byte).tolist()}
        raw = [b"" if library.is_control(i) else " ⁇ ".encode() if i == self.unknown else bytes([int(names[i][1:-1], 16)])
               if self.is_byte[i] else self.name[i].encode() for i in range(size)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.length = np.array([len(x) for x in self.name], np.int64)
        self.automaton = ahocorasick.Automaton()
        for n, i in self.id.items():
            self.automaton.add_word(n, i)
        self.automaton.make_automaton()
        self.cut = next(p for p in map(re.compile, CUTS) if all(p.fullmatch(n) and p.match(n).end() == len(n) for n in self.id))
        self.size = self.length.tolist()
        # the longest piece that is a proper prefix of each piece, or -1
        self.shorter = [next((self.id[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in self.id), -1) for n in self.name]
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_chars = 0

    @classmethod
    def get(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    # --- one cut ---------------------------------------------------------------------

    def merged(self, text: str, seam: int) -> list[str]:
        """The merging itself, for the text of a pair of pieces; it stops when it reaches across ``seam``."""
        parts, ids, score = list(text), self.id, self.score
        value = [score[ids[x]] if (x := parts[i] + parts[i + 1]) in ids else None for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, v in enumerate(value):
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del value[at]
            for i in (at - 1, at):
                if 0 <= i < len(value):
                    value[i] = score[ids[x]] if (x := parts[i] + parts[i + 1]) in ids else None
            left = sum(map(len, parts[:at]))
            if left < seam < left + len(parts[at]):
                return parts

    def fits(self, key: int) -> bool:
        """Whether merging the text of two pieces leaves them as they are; (the first + 1) << 32 | the second, 0 for none."""
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            pair = [self.name[i] for i in ((key >> 32) - 1, key & 0xFFFFFFFF) if i >= 0]
            known = self.pairs[key] = self.merged("".join(pair), len(pair[0])) == pair
        return known

    def walk(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces, by backtracking."""
        size, shorter, known = self.size, self.shorter, self.pairs
        longest = [-1] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):       # ends ascend, so the last one written is the longest
            longest[end + 1 - size[piece]] = piece
        failed = bytearray(len(text) // 8 + 1)
        out: list[int] = []
        at, piece, before = 0, longest[0], 0
        while at < len(text):
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    key = before | piece
                    if known[key] if key in known else self.fits(key):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                before = piece + 1 << 32
                at, piece = end, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                before = out[-1] + 1 << 32 if out else 0
                at, piece = at - size[last], shorter[last]
        return out

    def encode_cut(self, text: str) -> list[int]:
        out: list[int] = []
        begin = 0
        for i, c in enumerate(text):
            if c not in self.id:
                out += self.walk(text[begin:i]) if i > begin else []
                out += [self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown]
                begin = i + 1
        return out + (self.walk(text[begin:]) if begin < len(text) else [])

    # --- many cuts -----------------------------------------------------------------------

    def _tiled(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of the cuts that the longest pieces tile with compatible pairs only."""
        found = np.array(list(self.automaton.iter_long("\n".join(cuts))), np.int64).reshape(-1, 2)
        size = np.array([len(c) for c in cuts], np.int64)
        last = np.cumsum(size + 1) - 2                       # place of each cut's last character
        end, piece = found[:, 0], found[:, 1]
        of = np.searchsorted(last, end)
        covered = np.bincount(of, self.length[piece], len(cuts)).astype(np.int64)
        inner = np.concatenate(([False], of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
        before = np.where(inner, np.concatenate(([-1], piece[:-1])) if len(of) else piece, -1)
        keys, back = np.unique((before + 1) << 32 | piece, return_inverse=True)
        good = np.array([self.fits(k) for k in keys.tolist()], bool)[back]
        whole = (covered == size) & (np.bincount(of, ~good, len(cuts)) == 0)
        raw, ends = piece.astype("<u4").tobytes(), 4 * np.searchsorted(of, np.arange(len(cuts) + 1))
        return {c: raw[a:b] for c, a, b, ok in zip(cuts, ends.tolist(), ends[1:].tolist(), whole.tolist()) if ok}

    def learn(self, cuts: Iterable[str]) -> dict[str, bytes]:
        """A table with the ids of all of ``cuts``."""
        if self.young_chars > KNOWN_CHARS:
            self.old, self.young, self.young_chars = self.young, {}, 0
        missing = [c for c in cuts if c not in self.young]
        made = {c: self.old[c] for c in missing if c in self.old}
        new = [c for c in missing if c not in made]
        made |= self._tiled([c for c in new if c != "\n"])
        for c in new:
            if c not in made:
                made[c] = np.array(self.encode_cut(c), "<u4").tobytes()
        short = {c: ids for c, ids in made.items() if len(c) <= LONG_CUT}
        self.young.update(short)
        self.young_chars += sum(map(len, short))
        return self.young if len(short) == len(made) else self.young | made

    # --- texts ---------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        table = self.learn(set().union(*cuts))
        return [b"".join(map(table.__getitem__, c)) for c in cuts]

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, in UTF-8."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        length = self.raw_length[at]
        first = np.repeat(self.raw_start[at] - (np.cumsum(length) - length), length)
        out = self.raw[first + np.arange(len(first))].tobytes()
        lead = int(np.argmax(length > 0))                    # control pieces have no bytes
        if out[:1] == b" " and not self.is_byte[at[lead]] and at[lead] != self.unknown:
            out = out[1:]
        if self.is_byte[at].any():
            try:
                out.decode()
            except UnicodeDecodeError:
                out = replaced(out)
        return out


def replaced(raw: bytes) -> bytes:
    """Each byte that is no part of a UTF-8 character as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if 0xC2 <= raw[at] < 0xE0 else 3 if 0xE0 <= raw[at] < 0xF0 else 4 if 0xF0 <= raw[at] < 0xF5 else 0
        try:
            raw[at:at + n].decode()
            good = 0 < n <= len(raw) - at
        except UnicodeDecodeError:
            good = False
        out.append(raw[at:at + n] if good else b"\xef\xbf\xbd")
        at += n if good else 1
    return b"".join(out)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(MODEL)


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    docs = fields(docs, "doc_id", "text")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text)."""
    path = _path(path)
    plain, key = _plain(docs)

    def run(batches):
        for batch in batches:
            for part in groups(batch, "text", GROUP_CHARS):
                made = Pieces.get(path).encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    return plain.mapInArrow(run, f"doc_id {key}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    path, key = _path(path), encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in groups(batch, "ids", 4 * GROUP_CHARS):
                made = [Pieces.get(path).decode(x or b"").decode() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded in one pass, so that no ids are moved."""
    path = _path(path)
    plain, key = _plain(docs)

    def run(batches):
        pieces = Pieces.get(path)
        for batch in batches:
            for part in groups(batch, "text", GROUP_CHARS):
                ids = pieces.encode([t or "" for t in part.column("text").to_pylist()])
                lists = [",".join(map(str, np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([sha256(x.encode()).hexdigest() for x in lists]),
                     pa.array([sha256(pieces.decode(x)).hexdigest() for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain.mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
