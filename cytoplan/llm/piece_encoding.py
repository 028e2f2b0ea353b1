"""Encoding and decoding with a SentencePiece model of merge type, by a table over prefixes.

For a text's every prefix the last piece of its encoding is unique. It is a piece that ends there (the automaton lists those) and
that goes with the last piece of the prefix before it: the merges of the two pieces' joined text give just these two. So the table
fills in one pass over the text, however long, and ids are read from its end backwards.

Texts are cut where no piece can reach across: before a space that follows another character, and around characters that no piece
holds. Equal segments are encoded once for each worker while its bounded cache lasts.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, span_hashes, text_chunks

NORMAL, UNKNOWN, CONTROL, DEFINED, BYTE = 1, 2, 3, 4, 6
SPACE = "▁"
#: Segments that a worker keeps before it starts anew.
CACHE_SEGMENTS = 500_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of one protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class PieceModel:
    """The pieces of a model file, and encoding and decoding of one segment."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        rules: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for key, value in _fields(raw):
            if key == 1:
                one = dict(_fields(value))
                self.pieces.append((one[1].decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
            elif key == 2:
                trainer = dict(_fields(value))
            elif key == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != 2 or rules.get(2) or rules.get(3, 1) != 1 or rules.get(4, 1) != 0 or rules.get(5, 1) != 1 or any(k == DEFINED for _, _, k in self.pieces):
            raise ValueError("only merge-type models with identity rules, a dummy prefix and no defined symbols are supported")
        self.id = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.score = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.byte = [0] * 256
        for i, (p, _, k) in enumerate(self.pieces):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.begin, self.end = self._control(trainer.get(46, b"<s>")), self._control(trainer.get(47, b"</s>"))
        letters = set("".join(self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any(c not in self.id for c in letters):
            raise ValueError("pieces reach across spaces, or hold characters that are no pieces")
        self.letters = letters
        self.cuts = np.array([c for c in range(128) if chr(c) not in letters and c != 32], np.uint8)
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(letters))) + "])")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._goes: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        surface = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b"" for p, _, k in self.pieces]
        self.surface_size = np.array(list(map(len, surface)), np.int64)
        self.surface_at = np.concatenate(([0], np.cumsum(self.surface_size)[:-1]))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _control(self, name: bytes | int) -> int:
        return next(i for i, (p, _, k) in enumerate(self.pieces) if k == CONTROL and p.encode() == name)

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored neighbours first, the leftmost of equal ones."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes(self, one: int, two: int) -> bool:
        """Whether two pieces can stand side by side in an encoding."""
        key = one << 32 | two
        found = self._goes.get(key)
        if found is None:
            a, b = self.pieces[one][0], self.pieces[two][0]
            if len(self._goes) > 600_000:
                self._goes.clear()
            found = self._goes[key] = self.merged(a + b) == [a, b]
        return found

    def stands(self, one: int) -> bool:
        """Whether a piece's text is encoded as that piece."""
        found = self._whole.get(one)
        if found is None:
            found = self._whole[one] = len(self.merged(self.pieces[one][0])) == 1
        return found

    def _table(self, text: str) -> list[int]:
        if text in self.id and self.stands(self.id[text]):
            return [self.id[text]]
        last, size = [-1] * len(text), [0] * len(text)
        goes = self.goes
        for end, (piece, n) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - n
            if self.stands(piece) if before < 0 else last[before] >= 0 and goes(last[before], piece):
                last[end], size[end] = piece, n
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """The ids of one segment in which spaces are SPACE. Runs of spaces have pieces of equal score, so those are merged plainly."""
        out: list[int] = []
        for i, part in enumerate(self.foreign.split(text)):
            if i % 2:
                out += [self.byte[b] for b in part.encode()]
            elif part:
                lead = re.search(SPACE + SPACE + "+", part)
                if lead is None:
                    out += self._table(part)
                else:
                    out += self._spaced(part)
        return out

    def _spaced(self, part: str) -> list[int]:
        """Pieces do not reach from another character to SPACE, so each run of SPACE starts anew; long runs only merge among themselves."""
        out: list[int] = []
        for run in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", part):
            n = len(run) - len(run.lstrip(SPACE))
            if n < 2:
                out += self._table(run)
                continue
            # All but the last SPACE of the run belong to pieces of SPACE alone, or the last does as well if no piece takes it.
            tail = self._table(run[n - 1 :]) if len(run) > n else []
            own = not tail or self.pieces[tail[0]][0] == SPACE
            out += [self.id[p] for p in self._run(n if own else n - 1)] + (tail[1:] if own else tail)
        return out

    @lru_cache(maxsize=4096)  # noqa: B019
    def _run(self, n: int) -> tuple[str, ...]:
        """n times SPACE. Equal scores merge from the left; a run is merged by halves of ever longer pieces, as the agenda does."""
        return tuple(self.merged_agenda(SPACE * n))

    def merged_agenda(self, text: str) -> list[str]:
        """As merged(), with a heap: n log n for long runs."""
        import heapq

        n = len(text)
        part: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or part[i] + part[j] != both or right[i] != j:
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]


class Encoder:
    """Encodes chunks of texts with a cache of segments."""

    def __init__(self, raw: bytes):
        self.model = PieceModel(raw)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.start, self.size, self.flat = array("q"), array("q"), array("i")

    def chunk(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without begin and end), and where each text's ids begin."""
        n, rows = len(data), len(offs) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if len(self.index) > CACHE_SEGMENTS:
            self.clear()
        space, cut = data == 32, np.isin(data, self.model.cuts)
        head = np.zeros(n + 1, bool)
        head[1:n] = (space[1:] & ~space[:-1]) | cut[1:] | cut[:-1]
        lone = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if n > 2 else ()
        for row in np.unique(np.searchsorted(offs, lone, "right") - 1) if len(lone) else ():
            head[offs[row] : offs[row + 1]] = False  # a text with SPACE itself is one segment
        begins = offs[:-1][np.diff(offs) > 0]
        head[begins] = True
        first = np.zeros(n + 1, bool)
        first[begins] = True
        start = np.flatnonzero(head[:n])
        end = np.append(start[1:], n)
        key = span_hashes(data, start, end) ^ (first[start].astype(U64) * U64(0x9E3779B97F4A7C15))
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        index, model, raw = self.index, self.model, data.tobytes()
        slot = np.empty(len(unique), np.int64)
        for i, k in enumerate(unique.tolist()):
            found = index.get(k)
            if found is None:
                lo = int(start[at[i]])
                text = raw[lo : int(end[at[i]])].decode().replace(" ", SPACE)
                ids = model.encode(SPACE + text if first[lo] else text)
                found = index[k] = len(self.start)
                self.start.append(len(self.flat))
                self.size.append(len(ids))
                self.flat.extend(ids)
            slot[i] = found
        slot = slot[back]
        size = np.frombuffer(self.size, np.int64)[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(np.frombuffer(self.start, np.int64)[slot] - total[:-1], size) + np.arange(total[-1])
        return np.frombuffer(self.flat, np.int32)[source], total[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids' pieces, and where each text's bytes begin; the dummy prefix is still there."""
        size = self.model.surface_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.model.surface_at[ids] - total[:-1], size) + np.arange(total[-1])
        return self.model.surface[source], total[bounds]


_OUT = "n_tokens long, ids binary, decoded string"


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(f.read())


def _encode(name: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        ends = np.array([encoder.model.begin, encoder.model.end], "<u4")
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, text):
                ids, at = encoder.chunk(data, offs)
                out, where = encoder.decode(ids, at)
                wide, count = ids.astype("<u4"), np.diff(at)
                blobs = [ends[:1].tobytes() + wide[a:b].tobytes() + ends[1:].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                raw = out.tobytes()
                # The first piece of a text gives up the space of the dummy prefix.
                texts = [raw[a + (a < b and raw[a] == 32) : b].decode(errors="replace") for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(count + 2), pa.array(blobs, pa.binary()), pa.array(texts, pa.string())], [*batch.schema.names, "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, n_tokens, ids (little-endian unsigned 32-bit integers, begin and end included) and decoded.

    The ids are those of the sentencepiece library with the same model, begin and end ids and no sampling; decoded is its decode(ids).
    A null or empty text has just the begin and end ids and decodes to an empty text. Repeated rows give repeated results; empty
    tables give an empty one. model_path is a file of the driver; it reaches executors as a distributed file.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.replace("\\", "/").rsplit("/", 1)[-1]
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_encode(name, "__text"), f"{schema}, {_OUT}").drop("__text")
