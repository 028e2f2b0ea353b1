"""Removal of every byte of a repeated 100-byte string, over all documents, by suffix arrays of the places that may repeat.

1. Every 100-byte window picks its least 32-byte gram (ties: the leftmost) as its anchor, so equal windows have equal anchors at the
   same place. One row per anchor: the gram's hash, the hash of its context (the bytes of all windows that picked it), the place.
   Hashes only choose what is compared. Contexts of equal hashes within a task are compared there, by the common prefix of their
   bytes, and all but the first of equal ones are repeats as a whole; so a hot passage leaves a row for each task, not for each document.
2. Dealt and sorted by the gram, the rows of grams that occur more than once go on; their contexts' bytes are fetched and dealt by the gram.
3. There the common prefix with its neighbour tells whether a context repeats one before it as a whole. Of the others, a two-stage
   suffix array and common prefixes of its neighbours give the classes of equal windows; all but the first of a class are repeats.
   The windows of grams with very many contexts go singly, dealt by the window, after the same comparison within each task.
4. The repeats of each document are united and cut out.

Every removed byte lies in a span whose bytes were compared. Memory in a task is bounded by Arrow batches and BATCH_BYTES; only counts
reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LETTERS, U64, aside, bounded_batches, materialize, mix, power_table, text_chunks
from .suffix_array import adjacent_common, common_prefix, padded, suffix_array

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Rows that a task combines at once, bytes of one suffix array, and contexts of one gram from which windows are dealt singly.
COMBINE_ROWS, BATCH_BYTES, HOT_CONTEXTS = 1_000_000, 1 << 20, 4000
#: Stands for a null doc_id: such a document comes last.
LAST_ID = 2**63 - 1

_ROW = "h long, c long, doc long, pack long"


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of the texts: gram hash, context hash, row, anchor's place, first and last window that picked it (places in data)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none, none
    total = np.zeros(n + 1, U64)
    np.cumsum(_LETTERS[data] * power_table("up", n), out=total[1:])
    down = power_table("down", n)
    gram = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    gram ^= gram >> U64(32)
    gram *= U64(0xBF58476D1CE4E5B9)
    bits = U64(max(8, int(n).bit_length()))
    least = (gram >> bits << bits) | np.arange(len(gram), dtype=U64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    size = np.diff(offs)
    good = np.zeros(n + 1, np.int8)
    long = size >= WINDOW
    np.add.at(good, offs[:-1][long], 1)
    np.add.at(good, offs[1:][long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(good[:n]) > 0)
    if not len(at):
        return none, none, none, none, none, none
    pick = (least[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    cut = np.flatnonzero(np.diff(pick)) + 1
    lo, hi, pick = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))], pick[np.concatenate(([0], cut))]
    end = hi + WINDOW
    context = mix((total[end] - total[lo]) * down[lo] + (end - lo).astype(U64))
    return mix(gram[pick]).view(np.int64), context.view(np.int64), np.searchsorted(offs, lo, "right") - 1, pick, lo, hi


def window_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each window of one context."""
    x = np.frombuffer(data, np.uint8)
    total = np.zeros(len(x) + 1, U64)
    np.cumsum(_LETTERS[x] * power_table("up", len(x)), out=total[1:])
    return mix((total[WINDOW:] - total[:-WINDOW]) * power_table("down", len(x))[: len(x) - WINDOW + 1]).view(np.int64)


def _pack(place: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Anchor's place (or a span's start), bytes from the first window to it, and windows after the first."""
    return place << 32 | before << 16 | more


def _combine(parts: list[tuple[np.ndarray, ...]], chunks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of first contexts, and spans of those that repeat one of the same task; parts hold where their bytes begin in the chunks."""
    h, c, doc, pack, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pack, doc, c, h))
    h, c, doc, pack, at = h[order], c[order], doc[order], pack[order], at[order]
    alike = np.flatnonzero((h[1:] == h[:-1]) & (c[1:] == c[:-1])) + 1
    size = (pack & 0xFFFF) + WINDOW
    again = np.zeros(len(h), bool)
    if len(alike):
        raw = padded(np.concatenate(chunks))
        again[alike] = (size[alike] == size[alike - 1]) & (common_prefix(raw, at[alike - 1], at[alike], size[alike]) >= size[alike])
    # A repeat found here goes on as a span of its document, marked by its negative pack.
    start = (pack >> 32) - (pack >> 16 & 0xFFFF)
    same_place = np.zeros(len(h), bool)
    same_place[1:] = again[1:] & (doc[1:] == doc[:-1]) & (pack[1:] == pack[:-1])
    span = again & ~same_place
    yield pa.RecordBatch.from_arrays([pa.array(x[~again]) for x in (h, c, doc, pack)], ["h", "c", "doc", "pack"])
    d, a, b = _united(doc[span], start[span], start[span] + size[span])
    if len(d):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix(d.astype(U64)).view(np.int64), b, d, -1 - a)], ["h", "c", "doc", "pack"])


def _united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united where they overlap or touch within a document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    head = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(head) - 1
    top = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # the furthest end so far in the document
    fresh = head.copy()
    fresh[1:] |= start[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, chunks, n, size = [], [], 0, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for lo, _, data, offs in text_chunks(batch):
            h, c, row, pick, first, last = anchors(data, offs)
            if len(h):
                parts.append((h, c, ids[lo + row], _pack(pick - offs[row], pick - first, last - first), size + first))
                chunks.append(data)
                n, size = n + len(h), size + len(data)
            if n >= COMBINE_ROWS:
                yield from _combine(parts, chunks)
                parts, chunks, n, size = [], [], 0, 0
    if parts:
        yield from _combine(parts, chunks)


_FOUND = "kind int, h long, c long, doc long, a int, n int"


def _open_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context and place become spans (kind 0) and the contexts to compare (kind 1), each n bytes from a.

    A gram's first row goes out once its second one is met; a row of the same place and context as the one before it is left out.
    A gram of more than HOT_CONTEXTS different contexts is named in a row of kind 2.
    """
    held = None  # the last row: h, c, doc, pack
    pending = None  # the only row of a gram so far
    kinds = 0  # different contexts of the last gram so far
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, pack = (batch.column(i).to_numpy() for i in range(4))
        spans = pack < 0
        out = [(0, h[spans], 0 * h[spans], doc[spans], -1 - pack[spans], c[spans] + 1 + pack[spans])]
        h, c, doc, pack = h[~spans], c[~spans], doc[~spans], pack[~spans]
        if len(h):
            same = np.concatenate(([held == (h[0], c[0], doc[0], pack[0])], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]) & (pack[1:] == pack[:-1])))
            follows_last = held is not None and held[0] == h[0]
            other = ~np.concatenate(([follows_last and held[1] == c[0]], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.add.reduceat(other.astype(np.int64), first)
            many[0] += kinds if follows_last else 0
            hot = many > HOT_CONTEXTS
            hot[0] &= not (follows_last and kinds > HOT_CONTEXTS)
            kinds = int(many[-1])
            if hot.any():
                zero = 0 * h[first[hot]]
                out.append((2, h[first[hot]], zero, zero, zero, zero))
            held = (h[-1], c[-1], doc[-1], pack[-1])
            h, c, doc, pack = h[~same], c[~same], doc[~same], pack[~same]
        if len(h):
            lead = np.concatenate(([follows_last], h[1:] == h[:-1]))
            wanted = lead | np.concatenate((lead[1:], [False]))
            start = (pack >> 32) - (pack >> 16 & 0xFFFF)
            size = (pack & 0xFFFF) + WINDOW
            if lead[0] and pending is not None:
                out.append((1, *(np.array([x]) for x in pending)))
                pending = None
            if not wanted[-1]:
                pending = (h[-1], c[-1], doc[-1], start[-1], size[-1])
            elif len(h) > 1 or not lead[0]:
                pending = None
            out.append((1, *(x[wanted] for x in (h, c, doc, start, size))))
        for kind, hh, cc, dd, aa, nn in out:
            if len(hh):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hh), kind, np.int32)), pa.array(hh), pa.array(cc), pa.array(dd), pa.array(aa.astype(np.int32)), pa.array(nn.astype(np.int32))], ["kind", "h", "c", "doc", "a", "n"])


_PART = "h long, c long, doc long, a int, part binary, hot boolean"


def _slice_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, other columns, text, list of contexts) becomes a row for each context with its bytes; a hot gram's becomes a row for each window.

    Windows that also occur earlier in the batch are compared here: of equal ones the first goes on, and the others are spans (no part).
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
    for batch in batches:
        docs, out, hot = batch.column(0).to_numpy(), [], []
        lists = batch.column(batch.num_columns - 1)
        ends, flat = lists.offsets.to_numpy(), lists.values
        h, c, a, n, is_hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        for lo, hi, data, offs in text_chunks(batch, batch.schema.names[-2]):
            raw = data.tobytes()
            x = slice(int(ends[lo]), int(ends[hi]))
            row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
            begin = offs[row] + a[x]
            fits = begin + n[x] <= offs[row + 1]  # else of a different text under the same doc_id
            take = np.flatnonzero(fits & ~is_hot[x])
            if len(take):
                parts = [raw[i : i + k] for i, k in zip(begin[take].tolist(), n[x][take].tolist(), strict=True)]
                out.append([pa.array(h[x][take]), pa.array(c[x][take]), pa.array(docs[lo + row[take]]), pa.array(a[x][take]), pa.array(parts, pa.binary()), pa.array(np.zeros(len(take), bool))])
            for i in np.flatnonzero(fits & is_hot[x]).tolist():
                hot.append((int(docs[lo + row[i]]), int(a[x][i]), raw[int(begin[i]) : int(begin[i] + n[x][i])]))
        for cols in out:
            yield pa.RecordBatch.from_arrays(cols, ["h", "c", "doc", "a", "part", "hot"])
        if hot:
            part, doc, at = [x[2] for x in hot], np.array([x[0] for x in hot]), np.array([x[1] for x in hot])
            rows = []
            seen = set()
            for d, p, text in hot:
                for j, w in enumerate(window_hashes(text).tolist()):
                    if (w, d, p + j) not in seen:
                        seen.add((w, d, p + j))
                        rows.append((w, d, p + j, text[j : j + WINDOW]))
            gone = _starts(*repeated_windows(part, doc, at, united=False))
            first = [r for r in rows if (r[1], r[2]) not in gone]
            if first:
                cols = list(zip(*first, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip((cols[0], cols[0], cols[1], cols[2], cols[3], [True] * len(first)), kinds, strict=True)], ["h", "c", "doc", "a", "part", "hot"])
            if gone:
                d, a0 = zip(*sorted(gone), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(mix(np.array(d).astype(U64)).view(np.int64)), pa.array([0] * len(d), pa.int64()), pa.array(list(d), pa.int64()), pa.array(list(a0), pa.int32()), pa.array([None] * len(d), pa.binary()), pa.array([True] * len(d))], ["h", "c", "doc", "a", "part", "hot"])


def _starts(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> set[tuple[int, int]]:
    return set(zip(doc.tolist(), start.tolist(), strict=True))


def repeated_windows(parts: list[bytes], doc: np.ndarray, start: np.ndarray, united: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, end) of the contexts' windows that also occur at an earlier place among these contexts."""
    size = np.array(list(map(len, parts)), np.int64)
    begin = np.cumsum(np.concatenate(([0], size[:-1] + 1)))
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    symbols = raw.astype(np.int16) + 1
    symbols[begin + size] = 0
    which = np.repeat(np.arange(len(parts)), size + 1)
    inside = np.arange(len(raw)) - begin[which]
    valid = inside <= (size[which] - WINDOW)
    order = suffix_array(symbols, WINDOW)
    order = order[valid[order]]
    same = adjacent_common(raw, order, WINDOW) >= WINDOW
    d, p = doc[which[order]], start[which[order]] + inside[order]
    place = np.lexsort((p, d))
    fresh = np.concatenate(([True], (d[place][1:] != d[place][:-1]) | (p[place][1:] != p[place][:-1])))
    rank = np.empty(len(order), np.int64)
    rank[place] = np.cumsum(fresh)  # a place that is there twice is no repeat of itself
    run = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.repeat(np.minimum.reduceat(rank, run), np.diff(np.append(run, len(order))))
    again = rank != least
    found = d[again], p[again], p[again] + WINDOW
    return _united(*found) if united else found


def _whole_repeats(table: pa.Table) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of contexts sorted by gram, context hash and place, those that are no whole repeat of one before them, and the spans of the others."""
    h, c, doc, a = (table[k].to_numpy() for k in ("h", "c", "doc", "a"))
    parts = table["part"].combine_chunks()
    offs = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    raw = padded(np.frombuffer(parts.buffers()[2], np.uint8)[: offs[-1]])
    size = np.diff(offs)
    alike = np.flatnonzero((h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (size[1:] == size[:-1])) + 1
    again = np.zeros(len(h), bool)
    again[alike] = common_prefix(raw, offs[alike - 1], offs[alike], size[alike]) >= size[alike]
    whose = np.flatnonzero(~again)[np.cumsum(~again) - 1]
    span = again & ((doc != doc[whose]) | (a != a[whose]))
    return table.filter(pa.array(~again)), (doc[span], a[span].astype(np.int64), a[span].astype(np.int64) + size[span])


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context hash and place: whole grams are taken together until there is enough text for a suffix array.

    Of a gram with more text than that, contexts that repeat one before them leave at once, so at most HOT_CONTEXTS different ones are held.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    last = None

    def spans(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        d, a, b = _united(d, a, b)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32))], ["doc", "a", "n"])

    def close() -> Iterator[pa.RecordBatch]:
        table, found = _whole_repeats(pa.Table.from_batches(held))
        yield from spans(*found)
        # The first contexts of grams that have several go to the suffix array.
        h = table["h"].to_numpy()
        several = np.concatenate(([False], h[1:] == h[:-1]))
        several[:-1] |= several[1:].copy()
        if several.any():
            some = table.filter(pa.array(several))
            yield from spans(*repeated_windows(some["part"].to_pylist(), some["doc"].to_numpy(), some["a"].to_numpy().astype(np.int64)))

    for whole in batches:
        early = pc.is_null(whole.column(whole.schema.get_field_index("part")))
        if pc.any(early).as_py():  # windows that were found before
            gone = whole.filter(early)
            yield pa.RecordBatch.from_arrays([gone.column(2), gone.column(3), pa.array(np.full(gone.num_rows, WINDOW, np.int32))], ["doc", "a", "n"])
            whole = whole.filter(pc.invert(early))
        for lo in range(0, whole.num_rows, 5000):
            batch = whole.slice(lo, 5000).select(["h", "c", "doc", "a", "part"])
            h = batch.column(0).to_numpy()
            if n >= BATCH_BYTES:
                cut = int(np.argmax(h != last)) if (h != last).any() else len(h)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(h):
                    yield from close()
                    held, n = [], 0
                    batch = batch.slice(cut)
                else:
                    table, found = _whole_repeats(pa.Table.from_batches(held))
                    yield from spans(*found)
                    held, n = table.to_batches(), max(BATCH_BYTES, table.nbytes)
                    continue
            held.append(batch)
            n += int(np.sum(pc.binary_length(batch.column(4)).to_numpy()))
            last = h[-1]
    if held:
        yield from close()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(other columns, text, spans) becomes (other columns, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    for batch in batches:
        spans = batch.column(batch.num_columns - 1).to_pylist()
        for lo, hi, data, offs in text_chunks(batch, "__text"):
            cols: list[list] = [[], [], [], [], []]
            for i in range(hi - lo):
                text = data[offs[i] : offs[i + 1]]
                removed = runs = 0
                if spans[lo + i]:
                    s = np.array([(x["a"], x["a"] + x["n"]) for x in spans[lo + i]], np.int64).clip(0, len(text))
                    _, a, b = _united(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
                    a, b = a[b > a], b[b > a]
                    edge = np.zeros(len(text) + 1, np.int8)
                    edge[a] += 1
                    edge[b] -= 1
                    removed, runs = int((b - a).sum()), len(a)
                    text = text[np.cumsum(edge[:-1]) == 0]
                rest = text.tobytes()
                for col, x in zip(cols, (int(offs[i + 1] - offs[i]), removed, runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            other = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 2)]
            names = [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([*other, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans (doc, a, n) of rows (doc, other columns, text) that are covered by windows which also start earlier: n bytes from a."""
    doc, text = rows.columns[0], rows.columns[-1]
    rows_of = rows.select(doc, text).toDF("doc", "text").mapInArrow(_anchor_rows, _ROW)
    found = materialize(rows_of.repartition("h").sortWithinPartitions("h", "c", "doc", "pack").mapInArrow(_open_contexts, _FOUND), "contexts")
    open_ = found.filter("kind = 1")
    hot = found.filter("kind = 2").select("h", F.lit(True).alias("hot"))
    asked = open_.join(hot, "h", "left").groupBy("doc").agg(F.collect_list(F.struct("h", "c", "a", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    # With all columns of the rows, so that this exchange of the texts serves the last join as well.
    parts = rows.join(asked.withColumnRenamed("doc", "__of"), F.col(doc) == F.col("__of")).select(*rows.columns, "asked").mapInArrow(_slice_contexts, _PART)
    compared = parts.repartition("h").sortWithinPartitions("h", "c", "doc", "a").mapInArrow(_sort_suffixes, "doc long, a int, n int")
    return found.filter("kind = 0").select("doc", "a", "n").unionByName(compared)


def cut_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for each row of docs (doc_id, text).

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller doc_id, or before in the same one.
    Strings never cross documents and are judged on the input. Null texts are empty; a null doc_id comes after all others. Rows that
    share a doc_id are one document: they are no repeats of each other, and a span found in one is cut from each. Other columns are
    ignored; empty tables give an empty result.
    """
    bounded_batches(docs)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(order.alias("__doc"), *keep, text.alias("__text"))
    spans = repeated_spans(texts).groupBy("doc").agg(F.collect_list(F.struct("a", "n")).alias("__spans")).select(F.col("doc").alias("__of"), "__spans")
    rows = texts.join(spans, F.col("__doc") == F.col("__of"), "left").select(*keep, "__text", "__spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(_cut, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs with their repeats cut from text, and n_chars of what is left. Bytes of characters that were cut apart go as well."""
    rows, back = aside(docs, ("doc_id", "text", "n_chars"))
    out = cut_repeats(rows, tuple(c for c in rows.columns if c not in ("text", "n_chars")))
    # make_valid_utf8 marks what is no text any more: a continuation byte without its lead, or a lead without its continuations.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col("n_removed") > 0, F.replace(text, F.lit("\ufffd"), F.lit(""))).otherwise(text)
    return back(out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


#: The digest in DuckDB's SQL: every window of every text, as hexadecimal digits.
ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n)) AS i FROM h),
b AS (SELECT p.doc_id, p.i, substr(h.x, 2 * p.i + 1, 2) AS byte, CASE WHEN p.i + 100 <= h.n THEN substr(h.x, 2 * p.i + 1, 200) END AS win FROM p JOIN h USING (doc_id)),
f AS (SELECT doc_id, i, byte, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 THEN i END AS again FROM b),
m AS (SELECT doc_id, i, byte, coalesce(i - max(again) OVER (PARTITION BY doc_id ORDER BY i) < 100, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM m),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN r USING (doc_id)
"""