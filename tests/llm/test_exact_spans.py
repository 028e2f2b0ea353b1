import hashlib
import random

import numpy as np
import pytest

from cytoplan.llm import exact_spans, suffix_array


def brute(rows):
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        mask, last = bytearray(len(b)), 0
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                for j in range(max(i, last), i + 100):
                    mask[j] = 1
                last = i + 100
            else:
                seen[w] = i
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        runs = sum(m and not p for m, p in zip(mask, b"\0" + bytes(mask), strict=False))
        out[key] = (len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()}


@pytest.mark.parametrize("hot", [4000, 1])
def test_matches_brute_force(table, prose, monkeypatch, hot):
    monkeypatch.setattr(exact_spans, "HOT_CONTEXTS", hot)
    assert got(exact_spans.cut_repeats(table(prose))) == brute(prose)


@pytest.mark.parametrize("rows", [50, 10**9])
def test_bounds_do_not_change_results(table, prose, monkeypatch, rows):
    monkeypatch.setattr(exact_spans, "BATCH_BYTES", 500)
    more = prose + [(1000 + i, t) for i, t in prose[:20]]
    assert got(exact_spans.cut_repeats(table(more, 5))) == brute(more)


@pytest.mark.parametrize("hot", [4000, 2])
def test_hashes_never_decide(table, prose, monkeypatch, hot):
    """With hashes of a few values, different contexts and windows fall together; only compared bytes tell them apart."""
    plain = exact_spans.anchors

    def poor(data, offs):
        h, c, *rest = plain(data, offs)
        return h % 3, c % 2, *rest

    monkeypatch.setattr(exact_spans, "anchors", poor)
    monkeypatch.setattr(exact_spans, "HOT_CONTEXTS", hot)
    windows = exact_spans.window_hashes
    monkeypatch.setattr(exact_spans, "window_hashes", lambda data: windows(data) % 5)
    rows = [r for r in prose if r[0] % 2 or r[0] > 100] + [(1000 + i, t) for i, t in prose[:20]]
    # Workers import the module anew, so the stages run here.
    texts = sorted(((i, (t or "").encode()) for i, t in rows))
    assert spans_here(texts) == {i: mask for (i, _), mask in zip(texts, removed(texts), strict=True)}


def removed(texts):
    """For each text in order, the bytes that go."""
    seen, out = set(), []
    for _, b in texts:
        mask = set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                mask |= set(range(i, i + 100))
            seen.add(b[i : i + 100])
        out.append(mask)
    return out


def spans_here(texts):
    """The stages of repeated_spans one after another in this process, over three tasks."""
    import pyarrow as pa

    def ordered(batches, by):
        t = pa.Table.from_batches(batches)
        return t.sort_by([(k, "ascending") for k in by]).combine_chunks().to_batches(max_chunksize=97)

    rows = []
    for task in range(3):
        own = texts[task::3]
        rows += exact_spans._anchor_rows([pa.RecordBatch.from_arrays([pa.array([i for i, _ in own]), pa.array([b for _, b in own], pa.binary())], ["doc", "text"])])
    found = list(exact_spans._open_contexts(ordered(rows, ["h", "c", "doc", "pack"])))
    out, asked, hot = {i: set() for i, _ in texts}, {}, set()
    for b in found:
        for r in b.to_pylist():
            if r["kind"] == 0:
                out[r["doc"]] |= set(range(r["a"], r["a"] + r["n"]))
            elif r["kind"] == 1:
                asked.setdefault(r["doc"], []).append(r)
            else:
                hot.add(r["h"])
    kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("a", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_())]))
    lists = [[{k: r[k] for k in ("h", "c", "a", "n")} | {"hot": r["h"] in hot} for r in asked[i]] for i, _ in texts if i in asked]
    some = [(i, b) for i, b in texts if i in asked]
    parts = list(exact_spans._slice_contexts([pa.RecordBatch.from_arrays([pa.array([i for i, _ in some]), pa.array([b for _, b in some], pa.binary()), pa.array(lists, kind)], ["doc", "text", "asked"])]))
    for b in exact_spans._sort_suffixes(ordered(parts, ["h", "c", "doc", "a"])):
        for r in b.to_pylist():
            out[r["doc"]] |= set(range(r["a"], r["a"] + r["n"]))
    return out


def test_repeats_within_a_document(table):
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(1, unit * 3), (2, "q" * 250), (3, "q" * 99), (4, "-" + unit[:99]), (5, "-" + unit[:100]), (6, "é" * 120), (7, "xé" * 20 + "é" * 80)]
    assert got(exact_spans.cut_repeats(table(rows))) == brute(rows)


def test_edge_cases(table):
    assert exact_spans.cut_repeats(table([])).collect() == []
    rng = random.Random(3)
    long = "".join(rng.choice("abc d") for _ in range(400))
    assert got(exact_spans.cut_repeats(table([(1, None), (2, ""), (None, long), (3, long)]))) == brute([(1, None), (2, ""), (None, long), (3, long)])
    twice = exact_spans.cut_repeats(table([(5, long), (5, long), (6, long)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(5, 0), (5, 0), (6, 400)]
    odd = table([(1, long), (2, long + "tail")]).selectExpr("*", "7 as kept", "8 as spans", "9 as h", "1 as doc", "'z' as n_bytes")
    cut = exact_spans.strip_repeats(odd)
    assert cut.columns == odd.columns and {r.doc_id: (r.text, r.n_chars, r.kept) for r in cut.collect()} == {1: (long, 400, 7), 2: ("tail", 4, 7)}


def test_cut_texts_stay_text(table):
    """A cut through a character removes what is left of it."""
    rows = [(1, "é" * 50 + "b" * 50), (2, "a" + "é" * 49 + "b" * 60)]
    for r in exact_spans.strip_repeats(table(rows)).collect():
        assert "�" not in r.text and r.n_chars == len(r.text)


@pytest.mark.parametrize("letters", [2, 4, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 50, 400):
        s = rng.integers(0, letters, n).astype(np.int16)
        order = suffix_array.suffix_array(s, 100)
        assert sorted(order.tolist()) == list(range(n))
        tails = [tuple(s[i : i + 100].tolist()) for i in order]
        assert tails == sorted(tails)
    assert suffix_array.suffix_array(np.zeros(0, np.int16), 9).tolist() == []
    flat = suffix_array.suffix_array(np.full(300, 3, np.int16), 100)
    assert flat[:99].tolist() == list(range(299, 200, -1))


def test_smaller_than_next():
    s = np.array([2, 2, 3, 1, 1, 2, 2, 1], np.int16)
    text = s.tolist()
    assert suffix_array.smaller_than_next(s).tolist() == [text[i:] < text[i + 1 :] for i in range(len(text))]


def test_common_prefixes():
    raw = np.frombuffer(b"abcabcabd" + b"x" * 40, np.uint8)
    order = np.array([0, 3, 6, 9, 10, 20])
    want = []
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = raw[a:].tobytes().ljust(60, b"\0"), raw[b:].tobytes().ljust(60, b"\0")
        want.append(min(16, next((i for i in range(16) if x[i] != y[i]), 16)))
    assert suffix_array.adjacent_common(raw, order, 16).tolist() == want
