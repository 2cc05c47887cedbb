"""What postings and a few candidates have in common, counted in Arrow batches.

For candidates whose text is small enough to be sent to every task. A row is a posting and a block of candidates that want
it. Items of the row meet an index of the block's items, as a join would, but all sums of the row's pairs are made where the
row is: nothing is shuffled, and the row's texts are not copied for each pair.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from postloom import lookups
from postloom.functions.text import WORD_TOKEN

BLOCK = 64                  # candidates that share a row
CELLS = 2_000_000           # sums of the rows that are worked on at a time, about
SUMS = ("nth:int,dot:bigint,posting_shared:bigint,candidate_shared:bigint,matched_weight:double,matched:bigint,"
        "required_matched:bigint")
NAMES = [f.split(":")[0] for f in SUMS.split(",")]


class Index:
    """Items of blocks: which entries each (block, item) has. Built once a task from the collected rows."""

    def __init__(self, names: list[str], blocks: np.ndarray, n_blocks: int):
        self.values = pa.array(sorted(set(names)), pa.string())
        item = pc.index_in(pa.array(names, pa.string()), self.values).to_numpy(zero_copy_only=False).astype(np.int64)
        key = item * n_blocks + blocks
        self.order = np.argsort(key, kind="stable")
        self.keys, self.starts, self.counts = np.unique(key[self.order], return_index=True, return_counts=True)
        self.n_blocks = n_blocks

    def find(self, items: pa.Array) -> np.ndarray:
        """The number of each item, -1 where no block has it."""
        return pc.fill_null(pc.index_in(items, self.values), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def meet(self, items: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among ``items``, entry) for every item number and the entries that its block has for it."""
        known = np.flatnonzero(items >= 0)
        if not len(known) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = items[known] * self.n_blocks + blocks[known]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[at] == key
        known, at = known[same], at[same]
        n = self.counts[at]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(known, n), self.order[np.repeat(self.starts[at], n) + nth]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _ranks(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def rounded(x: np.ndarray, places: int = 3) -> np.ndarray:
    """As Spark rounds a double: half up, by the shortest decimal that names it."""
    scaled = x * 10 ** places
    out = np.rint(scaled) / 10 ** places
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


# --- what is made of a pair's keywords ----------------------------------------------

@dataclass
class Cells:
    """A cell is a pair and a keyword of its posting; cells stand by pair, and there in the order of gaps."""

    n_pairs: int
    pair: np.ndarray            # of each cell
    keyword: np.ndarray         # where its keyword stands in ``found``
    tier: np.ndarray            # 0 where the pair lacks it
    found: pa.StructArray       # keywords of all rows
    spot_cell: np.ndarray       # cells of the nearest bullets, nearest first
    spot_place: np.ndarray      # these bullets
    near: np.ndarray            # and their similarity
    bullet_index: np.ndarray    # of each place
    bullets: pa.Array | None

    def of(self, field: str, cells: np.ndarray) -> pa.Array:
        return pc.struct_field(self.found, field).take(pa.array(self.keyword[cells]))

    def listed(self, cells: np.ndarray, values: pa.Array) -> pa.Array:
        """One list a pair of the values of ``cells``, which stand by pair."""
        return _lists(np.bincount(self.pair[cells], minlength=self.n_pairs), values)

    def held(self) -> np.ndarray:
        """The cells that pairs have, by keyword."""
        names = pc.struct_field(self.found, "keyword").dictionary_encode()
        rank = np.empty(len(names.dictionary), np.int64)
        rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank))
        cells = np.flatnonzero(self.tier)
        return cells[np.lexsort((rank[names.indices.to_numpy()[self.keyword[cells]]], self.pair[cells]))]

    def missing(self, most: int | None = None) -> np.ndarray:
        """The cells that pairs lack, all or the first ``most`` of each."""
        cells = np.flatnonzero(self.tier == 0)
        return cells if most is None else cells[_ranks(np.bincount(self.pair[cells], minlength=self.n_pairs)) < most]

    def near_text(self, shown: pa.Array, most: int) -> tuple[np.ndarray, pa.Array]:
        """The cells with spots, and the first ``most`` of each as text; ``shown`` has the text of every place."""
        few = _ranks(np.unique(self.spot_cell, return_counts=True)[1]) < most
        cells, sizes = np.unique(self.spot_cell[few], return_counts=True)
        return cells, pc.binary_join(_lists(sizes, shown.take(pa.array(self.spot_place[few]))), "; ")


class Field(NamedTuple):
    """A column that batches make of each pair's keywords."""

    name: str
    type: str
    make: Callable[[Cells], pa.Array]
    spots: bool = False         # needs the nearest bullets


def _struct(**fields: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), list(fields))


def _matched_keywords(c: Cells) -> pa.Array:
    cells = c.held()
    return c.listed(cells, c.of("keyword", cells))


def _every(c: Cells) -> pa.Array:
    cells = np.arange(len(c.tier))
    return c.listed(cells, _struct(keyword=c.of("keyword", cells), section=c.of("section", cells),
                                   match_tier=pa.array(c.tier, mask=c.tier == 0)))


def _gaps(c: Cells) -> pa.Array:
    cells = c.missing()
    return c.listed(cells, _struct(**{f: c.of(f, cells) for f in ("keyword", "importance", "in_requirements", "section")}))


def _spots(c: Cells) -> pa.Array:
    cells, sizes = np.unique(c.spot_cell, return_counts=True)
    near = _struct(bullet_index=pa.array(c.bullet_index[c.spot_place].astype(np.int32)), similarity=pa.array(c.near))
    return c.listed(cells, _struct(keyword=c.of("keyword", cells), spots=_lists(sizes, near)))


def _missing_keywords(c: Cells) -> pa.Array:
    cells = c.missing()
    near = _struct(bullet_index=pa.array(c.bullet_index[c.spot_place]), bullet=c.bullets.take(pa.array(c.spot_place)),
                   similarity=pa.array(rounded(c.near)))
    spots = _lists(np.bincount(c.spot_cell, minlength=len(c.tier))[cells], near)
    return c.listed(cells, _struct(keyword=c.of("keyword", cells), importance=c.of("rounded", cells),
                                   in_requirements=c.of("in_requirements", cells), section=c.of("section", cells), spots=spots))


MATCHED = Field("matched_keywords", "array<string>", _matched_keywords)
EVERY = Field("every", "array<struct<keyword:string,section:string,match_tier:int>>", _every)
GAPS = Field("gaps", "array<struct<keyword:string,importance:double,in_requirements:boolean,section:string>>", _gaps)
SPOTS = Field("spots", "array<struct<keyword:string,spots:array<struct<bullet_index:int,similarity:double>>>>", _spots, True)
MISSING = Field("missing_keywords", "array<struct<keyword:string,importance:double,in_requirements:boolean,section:string,"
                "spots:array<struct<bullet_index:bigint,bullet:string,similarity:double>>>>", _missing_keywords, True)


class Best:
    """The pairs that may be among a candidate's ``k`` best: none with a score that ``k`` pairs seen before beat by ``slack``."""

    def __init__(self, k: int, slack: float, n_candidates: int):
        self.k, self.slack = k, slack
        self.who = np.repeat(np.arange(n_candidates), k)
        self.top = np.full(n_candidates * k, -np.inf)     # each candidate's best scores so far, falling

    def keep(self, who: np.ndarray, score: np.ndarray) -> np.ndarray:
        bar = self.top[self.k - 1::self.k] - self.slack
        some = np.flatnonzero(~(score < bar[who]))
        both, scores = np.concatenate([self.who, who[some]]), np.concatenate([self.top, score[some]])
        order = np.lexsort((-scores, both))
        self.top = scores[order[_ranks(np.bincount(both)) < self.k]]
        bar = self.top[self.k - 1::self.k] - self.slack
        return some[~(score[some] < bar[who[some]])]


class Meeting:
    """The function that ``mapInArrow`` runs. ``members``: block, slot and candidate_sq of each candidate; other tables hold its
    items by block and slot.

    ``words``: value, n. ``hits``: keyword, match_tier. ``vectors``: token, bullet_index, idf, weight, and ``bullets``:
    bullet_index, bullet; None leaves the spots out. ``fields`` are what a pair has beside its sums. ``best`` (k, slack), without
    fields, leaves out pairs that certainly are not among their candidate's k best; ``score`` gives that order from the sums.
    """

    def __init__(self, kept: list[str], members: pa.Table, words: pa.Table, hits: pa.Table, vectors: pa.Table | None,
                 bullets: pa.Table | None = None, fields: tuple[Field, ...] = (), best: tuple[int, float] | None = None, score: Callable | None = None):
        ints = lambda t, c: t[c].to_numpy().astype(np.int64)
        self.fields, self.best, self.score = fields, best, score
        self.kept, n_blocks = kept, int(members.num_rows and ints(members, "block").max() + 1)
        self.size = np.bincount(ints(members, "block"), minlength=n_blocks)
        self.first_member = np.cumsum(self.size) - self.size
        if best is not None:
            self.member_sq = np.zeros(members.num_rows)
            self.member_sq[self.first_member[ints(members, "block")] + ints(members, "slot")] = ints(members, "candidate_sq")
        self.words = Index(words["value"].to_pylist(), ints(words, "block"), n_blocks)
        self.word_slot, self.word_n = ints(words, "slot"), ints(words, "n").astype(float)
        self.hits = Index(hits["keyword"].to_pylist(), ints(hits, "block"), n_blocks)
        self.hit_slot, self.tier = ints(hits, "slot"), ints(hits, "match_tier")
        self.spots, self.place_bullet, self.place_text = vectors is not None, np.zeros(0, np.int64), pa.array([], pa.string())
        if vectors is None:
            return
        block, slot, bullet = (ints(vectors, c) for c in ("block", "slot", "bullet_index"))
        places, place = np.unique(np.stack([block, slot, bullet]), axis=1, return_inverse=True)
        self.n_places = np.bincount(places[0], minlength=n_blocks)
        self.first_place = np.cumsum(self.n_places) - self.n_places
        self.place_slot, self.place_bullet = places[1], places[2]
        said = {(r["block"], r["slot"], r["bullet_index"]): r["bullet"] for r in bullets.to_pylist()}
        self.place_text = pa.array([said[p] for p in zip(*places.tolist())], pa.string())
        token = vectors["token"].to_pylist()
        self.vectors = Index(token, block, n_blocks)
        self.place = place.reshape(-1) - self.first_place[block]
        self.idf = vectors["idf"].to_numpy()
        self.gain = self.idf * vectors["weight"].to_numpy()
        self.vocabulary = {t: i for i, t in enumerate(self.vectors.values.to_pylist())}
        one = np.unique(np.stack([block, slot, [self.vocabulary[t] for t in token]]), axis=1, return_index=True)[1] if token else np.zeros(0, np.int64)
        self.norms = Index([token[i] for i in one], block[one], n_blocks)
        self.norm_slot, self.norm_idf = slot[one], self.idf[one]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None if self.best is None else Best(*self.best, len(self.member_sq))
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch["block"].to_numpy().astype(np.int64)
            width = self.size[blocks] + (self.n_places[blocks] if self.spots else 0)
            cells = (pc.fill_null(pc.list_value_length(batch["keywords"]), 0).to_numpy() + 1) * width
            cuts = np.flatnonzero(np.diff(np.cumsum(cells) // CELLS)) + 1
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(int(first), int(end - first))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in self.kept), self.pairs(part, best)], [*self.kept, "pairs"])

    def pairs(self, part: pa.RecordBatch, best: Best | None) -> pa.Array:
        blocks = part["block"].to_numpy().astype(np.int64)
        row, size = np.arange(len(blocks)), self.size[blocks]
        n_pairs, first_pair = int(size.sum()), np.cumsum(size) - size
        add = lambda at, what: np.bincount(at, what, n_pairs)
        whole = lambda sums: pa.array(np.rint(sums).astype(np.int64))

        words, n = _flat(part["words"])
        word_row, tf = np.repeat(row, n), pc.struct_field(words, "n").to_numpy().astype(float)
        i, e = self.words.meet(self.words.find(pc.struct_field(words, "value")), blocks[word_row])
        pair, tf, ctf = first_pair[word_row[i]] + self.word_slot[e], tf[i], self.word_n[e]
        sums = [whole(add(pair, tf * ctf)), whole(add(pair, tf * tf)), whole(add(pair, ctf * ctf))]

        found, n = _flat(part["keywords"])
        names = pc.struct_field(found, "keyword")
        k_row, k_at = np.repeat(row, n), _ranks(n)
        first_cell = np.cumsum(size * n) - size * n
        i, e = self.hits.meet(self.hits.find(names), blocks[k_row])
        pair = first_pair[k_row[i]] + self.hit_slot[e]
        required = pc.fill_null(pc.equal(pc.struct_field(found, "section"), "required"), False).to_numpy(zero_copy_only=False)
        sums += [pa.array(add(pair, pc.struct_field(found, "importance").to_numpy()[i]).astype(float)), whole(add(pair, None)),
                 whole(add(pair, required[i].astype(float)))]
        sums = [pa.array(_ranks(size).astype(np.int32)), *sums]
        if not self.fields:
            return self._sums(part, size, sums, best)
        tier = np.zeros(int((size * n).sum()), np.int32)
        tier[first_cell[k_row[i]] + self.hit_slot[e] * n[k_row[i]] + k_at[i]] = self.tier[e]
        per_pair = np.repeat(n, size)
        keyword = np.repeat(np.repeat(np.cumsum(n) - n, size), per_pair) + _ranks(per_pair)
        none = np.zeros(0, np.int64)
        near = self._near(part, names, blocks, k_row, k_at, n, first_cell, tier) if self.spots else (none, none, np.zeros(0))
        cells = Cells(n_pairs, np.repeat(np.arange(n_pairs), per_pair), keyword, tier, found, *near, self.place_bullet, self.place_text)
        return _lists(size, pa.StructArray.from_arrays([*sums, *(f.make(cells) for f in self.fields)], [*NAMES, *(f.name for f in self.fields)]))

    def _sums(self, part: pa.RecordBatch, size: np.ndarray, sums: list[pa.Array], best: Best | None) -> pa.Array:
        """The pairs with their sums: all, or those that may be among the best."""
        if best is None:
            return _lists(size, pa.StructArray.from_arrays(sums, NAMES))
        row = np.repeat(np.arange(len(size)), size)
        who = self.first_member[part["block"].to_numpy().astype(np.int64)][row] + sums[0].to_numpy()
        inputs = {n: s.to_numpy() for n, s in zip(NAMES, sums)} | {c: part[c].to_numpy(zero_copy_only=False)[row] for c in ("total_weight", "posting_sq")}
        keep = best.keep(who, self.score(inputs | {"candidate_sq": self.member_sq[who]}))
        return _lists(np.bincount(row[keep], minlength=len(size)), pa.StructArray.from_arrays([s.take(pa.array(keep)) for s in sums], NAMES))

    def _near(self, part, names, blocks, k_row, k_at, n, first_cell, tier):
        """M7: (cell, place of the bullet, similarity) of the nearest bullets of missing keywords, by cell, nearest first."""
        known = lambda text: [v for t in token.findall(text) if (v := self.vocabulary.get(t)) is not None]
        token, asked, at = re.compile(WORD_TOKEN), [], 0
        words, sentence = names.to_pylist(), pc.struct_field(part["keywords"].flatten(), "sentence").to_pylist()
        for r, sentences in enumerate(part["lowered"].to_pylist()):
            cut: dict[int, list[int]] = {}
            for k in range(at, at + int(n[r])):
                own = known(words[k])
                s = sentence[k]
                if s is not None and s not in cut:
                    cut[s] = known(sentences[s])
                asked.append(own + (own if s is None else cut[s]))
            at += int(n[r])
        many = max(1, len(self.vocabulary))
        sizes = np.array([len(q) for q in asked], np.int64)
        flat = np.array([v for q in asked for v in q], np.int64)
        query, qtf = np.unique(np.repeat(np.arange(len(asked)), sizes) * many + flat, return_counts=True)
        k, tokens = query // many, query % many
        block = blocks[k_row]
        i, e = self.vectors.meet(tokens, block[k])
        width = self.n_places[block]
        first = np.cumsum(width) - width
        dots = np.bincount(first[k[i]] + self.place[e], qtf[i] * self.gain[e], int(width.sum()))
        size = self.size[block]
        first_norm = np.cumsum(size) - size
        i, e = self.norms.meet(tokens, block[k])
        norms = np.bincount(first_norm[k[i]] + self.norm_slot[e], (qtf[i] * self.norm_idf[e]) ** 2, int(size.sum()))
        some = np.flatnonzero(dots)
        k = np.searchsorted(first + width, some, side="right")
        place = some - first[k] + self.first_place[block[k]]
        slot, bullet = self.place_slot[place], self.place_bullet[place]
        near = dots[some] / np.sqrt(norms[first_norm[k] + slot])
        cell = first_cell[k_row[k]] + slot * n[k_row[k]] + k_at[k]
        good = (tier[cell] == 0) & (near > lookups.SPOT_FLOOR)
        cell, place, bullet, near = cell[good], place[good], bullet[good], near[good]
        # nearest first; of equally near bullets the later one, compared at 9 decimals
        order = np.lexsort((-bullet, -np.round(near, 9), cell))
        cell, place, near = cell[order], place[order], near[order]
        top = _ranks(np.unique(cell, return_counts=True)[1]) < self.cap
        return cell[top], place[top], near[top]

    cap = lookups.SPOT_CAP


def meet(rows: DataFrame, meeting: Meeting) -> DataFrame:
    """``rows`` (block, keywords in the order of gaps, words, lowered sentences, and the kept columns) with their pairs."""
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in meeting.kept)
    made = "".join(f",{f.name}:{f.type}" for f in meeting.fields)
    return rows.mapInArrow(meeting, f"{schema}, pairs array<struct<{SUMS}{made}>>")
