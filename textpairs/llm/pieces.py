"""Operator 1, SentencePiece encoding by sampling, and lossless decoding.

A text is taken as the model takes it: a space in front, every space a word mark. Its piece lattice
has an arc for each vocabulary piece that matches and, for a character without a piece, an arc of
its UTF-8 byte pieces; a literal word mark in the text goes through bytes too, so decoding gives
back every text exactly. A piece weighs 1 / (1 + merge rank), to the power ``theta``.

Forward filtering sums the weights of all segmentations up to each place; backward sampling then
walks from the end, taking an arc with its share of that sum. No piece holds a word mark behind another
character or a line end, so the lattice falls apart there and each different chunk of a batch
is filtered once, while every occurrence is sampled with its own draws. A draw depends on the seed, the
row's key and the place in the text only: the same row gives the same pieces in any batch,
partition or rerun. Chunks of up to ``LONG`` characters are filtered and walked together, a character
level at a time; a longer one, say a text without spaces, on its own from border to border.

Edge cases: null text gives null ids; empty text gives no ids; a null key draws as key 0 with its own
salt; rows with equal key and text are sampled alike; whole texts are read, in slices of about
``SLICE`` characters that hold several rows or a part of one, cut between chunks, so memory follows the
slice, the longest chunk and the row's ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, table

MODEL, SEED, THETA, SLICE, LONG = "piece_bpe_32k.model", 1, 1.0, 6_000_000, 1_000
MARK = "▁"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
BORDER = re.compile(r"\n|(?<=[^ \n]) ")  # a chunk starts here, whatever stands before
BLOCK = 1 << 16  # arcs or ids turned into Python objects at once
DENSE = 256  # codes with a row in the dense transition table


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over character codes."""

    def __init__(self, path: str):
        import sentencepiece
        if not os.path.isabs(path):
            import public_tokenizers
            path = public_tokenizers.path(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte = [i for i in range(n) if sp.is_byte(i)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in names.values()):
            raise ValueError("a piece spans a word or line border; chunks would not be independent")
        self.size = n
        self.byte_id = np.zeros(256, np.int32)
        for i in byte:
            self.byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
        self.bytes = [b""] * n
        for i in byte:
            self.bytes[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        for i, p in names.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        rank = {i: max(0.0, -sp.get_score(i)) for i in plain}
        total = sum(1 / (1 + r) for r in rank.values())
        self.logp = np.full(n, -np.log(1 + n) - np.log(total))
        for i, r in rank.items():
            self.logp[i] = -np.log(1 + r) - np.log(total)
        # codes by how many pieces use a character; 0 is a character of no piece
        use: dict[str, int] = {}
        for p in names.values():
            for c in set(p):
                use[c] = use.get(c, 0) + 1
        code = {c: k for k, c in enumerate(sorted(use, key=lambda c: (-use[c], c)), 1)}
        self.code = np.zeros(0x110000, np.uint16)
        for c, k in code.items():
            self.code[ord(" " if c == MARK else c)] = k
        children: list[dict[int, int]] = [{}]
        accept = [-1]
        for i, p in names.items():
            s = 0
            for c in p:
                k = code[c]
                if k not in children[s]:
                    children[s][k] = len(children)
                    children.append({})
                    accept.append(-1)
                s = children[s][k]
            accept[s] = i
        self.accept = np.array(accept, np.int32)
        inner = [s for s, x in enumerate(children) if x]
        self.row = np.zeros(len(children), np.int32)  # row of the dense table; 0: no child
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.dense = np.zeros((len(inner) + 1, DENSE), np.int32)
        rare = []
        for s in inner:
            for k, t in children[s].items():
                if k < DENSE:
                    self.dense[self.row[s], k] = t
                else:
                    rare.append((s << 16 | k, t))
        rare.sort()
        self.rare_key = np.array([x for x, _ in rare] + [1 << 62], np.int64)
        self.rare_to = np.array([x for _, x in rare] + [0], np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next trie state, 0 where there is none."""
        to = self.dense[self.row[state], np.minimum(code, DENSE - 1)]
        far = np.flatnonzero(code >= DENSE - 1)
        if len(far):
            key = state[far].astype(np.int64) << 16 | code[far]
            at = np.searchsorted(self.rare_key, key)
            wide = np.where(self.rare_key[at] == key, self.rare_to[at], 0)
            to[far] = np.where(code[far] >= DENSE, wide, to[far])
        return to


class Sampler:
    def __init__(self, path: str = MODEL, seed: int = SEED, theta: float = THETA, slice_: int = SLICE, long_: int = LONG):
        self.vocab = Vocabulary(path)
        self.seed, self.theta, self.slice, self.long = seed, theta, slice_, long_

    def _lattice(self, chunks: list[str]):
        """Filtered lattice of different chunks: first place and length of each; of the arcs, sorted
        by end, start, piece and cumulated share of their end's sum; each border's first arc."""
        voc = self.vocab
        points = np.frombuffer("\n".join(chunks).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(size + 1) - size - 1
        code = np.append(voc.code[points], 0).astype(np.int32)
        n = len(points)
        gap = np.zeros(n, bool)
        gap[(first + size)[:-1]] = True
        alive = np.flatnonzero(~gap).astype(np.int32)
        state = np.zeros(len(alive), np.int32)
        starts, ends, pids = [], [], []
        k = 0
        while len(alive):
            state = voc.step(state, code[np.minimum(alive + k, n)])
            k += 1
            pid = voc.accept[state]
            got = (state > 0) & (pid >= 0)
            starts.append(alive[got])
            ends.append(alive[got] + k)
            pids.append(pid[got])
            if k == 1:  # a character without a piece of its own: an arc of bytes
                lone = alive[~got]
                starts.append(lone)
                ends.append(lone + 1)
                pids.append(voc.size + points[lone].astype(np.int32))
            on = voc.row[state] > 0
            on &= state > 0
            alive, state = alive[on], state[on]
        start, end, pid = (np.concatenate(x) for x in (starts, ends, pids))
        order = np.argsort(end, kind="stable")
        start, end, pid = start[order], end[order], pid[order]
        weight = np.where(pid < voc.size, voc.logp[np.minimum(pid, voc.size - 1)], 0.0)
        wide = pid >= voc.size
        if wide.any():
            cp = pid[wide] - voc.size
            weight[wide] = voc.logp[voc.byte_id[0]] * (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        weight *= self.theta
        # level of a border: characters between the chunk's first place and it
        level = end - np.repeat(first, size + 1)[np.minimum(end, n) - 1]
        total = np.zeros(n + 2)
        share = np.empty(len(end))
        lengthy = np.flatnonzero(size > self.long)
        edges = np.searchsorted(end, np.stack([first[lengthy] + 1, first[lengthy] + size[lengthy] + 1]).astype(end.dtype))
        for c, lo, hi in zip(lengthy, *edges):
            self._filter(int(first[c]), int(size[c]), start[lo:hi], end[lo:hi], weight[lo:hi], share[lo:hi])
            level[lo:hi] = 0
        by = np.argsort(level.astype(np.uint16) if level.max() < 65_536 else level, kind="stable")
        by = by[np.count_nonzero(level == 0):]  # no arc of a short chunk has level 0
        cuts = np.flatnonzero(np.diff(level[by])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(by)]) if len(by) else ():
            arc = by[lo:hi]
            e = end[arc]
            new = np.empty(len(arc), bool)
            new[0] = True
            np.not_equal(e[1:], e[:-1], out=new[1:])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(arc)))
            w = total[start[arc]] + weight[arc]
            top = np.maximum.reduceat(w, at)
            w = np.exp(w - np.repeat(top, count))
            run = np.cumsum(w)
            before = np.concatenate([[0.0], run[at[1:] - 1]])
            mass = run[at + count - 1] - before
            total[e[at]] = top + np.log(mass)
            run = (run - np.repeat(before, count)) / np.repeat(mass, count)
            run[at + count - 1] = 1.0
            share[arc] = run
        door = np.searchsorted(end, np.arange(n + 1)).astype(np.int32)  # first arc into each border
        return first, size, start, pid, share, door

    @staticmethod
    def _filter(first: int, size: int, start, end, weight, share) -> None:
        """Fills in ``share`` of one chunk's arcs, in the order of their ends."""
        total = array("d", bytes(8 * (size + 1)))
        at, group = first + 1, []

        def close() -> list[float]:
            if len(group) == 1:
                total[at - first] = group[0]
                return [1.0]
            top, mass, run = max(group), 0.0, []
            for w in group:
                mass += exp(w - top)
                run.append(mass)
            total[at - first] = top + log(mass)
            return [x / mass for x in run]

        done = 0
        for lo in range(0, len(end), BLOCK):
            part, out = slice(lo, lo + BLOCK), []
            for s, e, w in zip(start[part].tolist(), end[part].tolist(), weight[part].tolist()):
                if e != at:
                    out += close()
                    at, group = e, []
                group.append(total[s - first] + w)
            if lo + BLOCK >= len(end):
                out += close()
            share[done:done + len(out)] = out
            done += len(out)

    @staticmethod
    def _walk(left: int, size: int, draw, door, share, pid, start, out) -> None:
        """Samples one chunk from its end: ``draw`` and ``out`` by border, the arcs as views."""
        node = left + size
        while node > left:
            arc, u = door[node], draw[node - left - 1]
            while share[arc] <= u:
                arc += 1
            out[node - left - 1] = pid[arc]
            node = start[arc]

    def _bytes_of(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with byte arcs written out, and how many ids each arc became."""
        wide = np.flatnonzero(out >= self.vocab.size)
        count = np.ones(len(out), np.int64)
        if not len(wide):
            return out, count
        kinds, inv = np.unique(out[wide], return_inverse=True)
        raw = [chr(x - self.vocab.size).encode() for x in kinds.tolist()]
        length = np.array([len(x) for x in raw])
        table_ = self.vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        offset = np.cumsum(length) - length
        count[wide] = length[inv]
        place = np.cumsum(count) - count
        ids = np.repeat(out, count)
        for b in range(4):
            has = length[inv] > b
            ids[place[wide[has]] + b] = table_[offset[inv[has]] + b]
        return ids, count

    def _parts(self, text: str):
        """(place, characters, chunks) of the text's parts of about a slice each, cut between chunks."""
        text, pos = " " + text, 0
        while pos < len(text):
            cut = BORDER.search(text, pos + self.slice) if len(text) - pos > self.slice else None
            end = cut.start() if cut else len(text)
            yield pos, end - pos, CHUNK.findall(text, pos, end)
            pos = end

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        found, number = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        rows, places, split, chars = [], [], [], 0

        def close():
            if rows:
                ids, count = self._sample(split, np.array(places), keys[rows])
                found.append(ids)
                np.add.at(number, rows, count)

        for i, t in enumerate(texts):
            for place, n, chunks in self._parts(t) if t else ():
                rows.append(i)
                places.append(place)
                split.append(chunks)
                chars += n
                if chars > self.slice:
                    close()
                    rows, places, split, chars = [], [], [], 0
        close()
        return np.concatenate(found), number

    def _draw(self, seed, place) -> np.ndarray:
        """Uniform draw for a border's place in its text."""
        x = _mix(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53

    def _sample(self, split: list[list[str]], places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of texts, given as chunks and the place they start at, and the ids of each."""
        per = np.fromiter(map(len, split), np.int64, len(split))
        kind, chunks = pd.factorize(np.array([c for part in split for c in part], dtype=object))
        first, size, start, pid, share, door = self._lattice(list(chunks))
        length = size[kind]
        stop = np.cumsum(length)  # behind each occurrence, in characters of the slice
        row = np.repeat(np.arange(len(split)), per)
        base = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(per)[:-1]])]
        seed = _mix(keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))[row]
        out = np.full(int(stop[-1]), -1, np.int32)
        left = first[kind]
        node, shift = left + length, stop - left - length  # node + shift: place in the slice
        within = shift - base[row] + places[row]
        views = [memoryview(x) for x in (door, share, pid, start)]
        for o in np.flatnonzero(length > self.long).tolist():
            lo, n = int(left[o]), int(length[o])
            draw = self._draw(seed[o], np.arange(lo + 1, lo + n + 1) + within[o])
            self._walk(lo, n, memoryview(draw), *views, memoryview(out[int(stop[o]) - n:int(stop[o])]))
        on = length <= self.long
        node, left, shift, within, seed = node[on], left[on], shift[on], within[on], seed[on]
        while len(node):
            u = self._draw(seed, node + within)
            arc = door[node]
            on = np.flatnonzero(share[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[share[arc[on]] <= u[on]]
            out[node + shift - 1] = pid[arc]
            node = start[arc].astype(np.int64)
            on = node > left
            node, left, shift, within, seed = node[on], left[on], shift[on], within[on], seed[on]
        full = out >= 0
        ids, count = self._bytes_of(out[full])
        tokens = np.zeros(len(out) + 1, np.int64)
        tokens[1:][full] = count
        tokens = np.cumsum(tokens)
        ends = np.concatenate([base[1:], [len(out)]])
        return ids, tokens[ends] - tokens[base]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int32)
        piece = self.vocab.bytes.__getitem__
        return b"".join(b"".join(map(piece, ids[lo:lo + BLOCK].tolist())) for lo in range(0, len(ids), BLOCK)).decode()[1:]


def _key(keys: pa.Array) -> np.ndarray:
    """Unsigned 64-bit key per row: integers as they are, anything else by its text's hash."""
    if pa.types.is_integer(keys.type):
        null = np.array(keys.is_null())
        return np.where(null, np.int64(-0x6A09E667F3BCC909), keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
    return np.array([xxhash.xxh64_intdigest(str(x)) for x in keys.to_pylist()], dtype=np.uint64)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED,
           theta: float = THETA) -> DataFrame:
    """key, ids (array), n_ids, lossless: whether decoding the ids gave back the text."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>, n_ids int, lossless boolean"
    sch = arrow_schema(schema)

    def run(batches):
        sampler = Sampler(model, seed, theta)
        for b in batches:
            texts, keys = b.column(1).to_pylist(), _key(b.column(0))
            lo = chars = 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars < SLICE and i + 1 < len(texts):
                    continue
                part = texts[lo:i + 1]
                ids, count = sampler.encode([t or "" for t in part], keys[lo:i + 1])
                at = np.concatenate([[0], np.cumsum(count)])
                same = [None if t is None else sampler.decode(ids[at[k]:at[k + 1]]) == t for k, t in enumerate(part)]
                null = np.array([t is None for t in part])
                offsets = pa.array(at.astype(np.int32), mask=np.append(null, False))
                arrays = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())).cast(sch.field(1).type)
                n = pa.array(count.astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, i + 1 - lo), arrays, n, pa.array(same, pa.bool_())], schema=sch)
                lo, chars = i + 1, 0

    return arrow_map(docs.select(key, text), run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """key and text of ids made by :func:`encode`; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, text string"
    sch = arrow_schema(schema)

    def run(batches):
        sampler = Sampler(model)
        for b in batches:
            texts = [None if x is None else sampler.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=sch)

    return arrow_map(encoded.select(key, F.col(ids)), run, schema)


def op1_sampled_pieces(spark, sf_dir) -> DataFrame:
    """Sampled segmentation of every whole text of ``documents``."""
    return encode(table(spark, sf_dir, "documents"))
