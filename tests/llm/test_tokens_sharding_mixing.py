import base64
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

from cytoplan.llm import mixing, queries, sharding, token_files

VOCABULARY = queries.tokenizer("byte_bpe_50k.tiktoken")


def write(folder, tokens, name="000000.bin", kind="<u2"):
    (folder / name).write_bytes(np.array(tokens, kind).tobytes())


def lengths(tokens, end):
    out, n = [], 0
    for t in tokens:
        if t == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    files = [rng.integers(0, 4, 200).tolist(), [3] * 5, [1] * 50 + [3], [1] * 30, [3, 3, 1, 3, 1]]
    for i, f in enumerate(files):
        write(tmp_path, f, f"{i:06d}.bin")
    write(tmp_path, [], "000009.bin")
    rows = token_files.count_tokens(spark, f"file://{tmp_path}", 3, block).orderBy("file", "document").collect()
    for i, f in enumerate(files):
        own = [r for r in rows if r.file == i]
        assert [r.document for r in own] == list(range(len(own)))
        assert [r.n_tokens for r in own] == lengths(f, 3)
        at = 0
        for r in own:
            assert r.first_token == at
            at += r.n_tokens + 1


def test_wide_tokens_and_empty_folder(spark, tmp_path):
    write(tmp_path, [70000, 1, 2, 70001, 5], kind="<u4")
    assert [r.n_tokens for r in token_files.count_tokens(spark, f"file://{tmp_path}", 70001, 8).orderBy("document").collect()] == [3, 1]
    (tmp_path / "none").mkdir()
    assert token_files.count_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_counts_match_the_tokenizer(table, spark, prose):
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=token_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = prose + [(800, "<|endoftext|> in a text"), (800, "a repeated id")]
    folder, written = token_files.write_token_files(table(rows), VOCABULARY)
    out = written.join(token_files.count_tokens(spark, folder, block=512), ["file", "document"]).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    folder, written = token_files.write_token_files(table([]), VOCABULARY)
    assert written.join(token_files.count_tokens(spark, folder), ["file", "document"]).count() == 0


def brute_table(names, slots):
    import hashlib

    order = []
    for s in names:
        h = hashlib.md5(s.encode()).hexdigest()
        a, k = int(h[:12], 16) % slots, int(h[12:24], 16) % (slots - 1) + 1
        order.append([(a + j * k) % slots for j in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        s = turn % len(names)
        table[next(x for x in order[s] if x not in table)] = s
        turn += 1
    return [table[i] for i in range(slots)]


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 211)
    assert table == brute_table(names, 211)
    count = Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 211 / 2  # 211 / 7 must move
    for bad in (([], 211), (names, 210), (names, 5), (["a", "a"], 211), (names, 1_000_033)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(table):
    rows = [(i, None) for i in range(300)] + [(5, "x"), (None, "y")]
    out = sharding.place(table(rows).selectExpr("*", "'s' as shard", "'k' as slot")).collect()
    assert len(out) == 302 and len({r.shard for r in out if r.doc_id == 5}) == 1 and all(r.shard is not None for r in out)
    assert sharding.place(table([])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    duckdb_ = duckdb.connect()
    duckdb_.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    other = duckdb_.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(other.columns) == cols
    fix = lambda r: tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r)
    at = [other.columns.index(c) for c in cols]
    assert sorted(map(fix, df.select(*cols).collect())) == sorted(fix(tuple(r[i] for i in at)) for r in other.fetchall())


def filled(sizes):
    """Targets by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, open_, out = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    left = total
    while open_ and left > 1e-9:
        share = sum(weight[s] for s in open_)
        over = set()
        for s in open_:
            out[s] += left * weight[s] / share
        left = 0.0
        for s in open_:
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                over.add(s)
        open_ -= over
        if not over:
            break
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 50, None: 20}, {"z": 7}, {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 3}, {"a": 0, "b": 9}, {"a": 10, "b": 10, "c": 10, "d": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    want = filled(sizes)
    for r in mixing.targets(df).collect():
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6), (r, want)


def test_mix(table):
    rows = [(i, "w " * (i % 40 + 1), "en", "abc"[i % 3]) for i in range(600)] + [(700, None, "en", "a"), (701, "x\ty\n z", None, None), (701, "x\ty\n z", None, None)]
    docs = table(rows).selectExpr("*", "'mine' as size", "1 as target")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        words = len((r.text or "").split())
        assert r.size == words and 0 <= r.copies <= 2
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.copies * words
    for source, (target, taken) in by.items():
        if source:
            assert abs(taken - target) < 0.1 * target
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}
    emitted = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert all(emitted[r.doc_id] == r.copies * (2 if r.doc_id == 701 else 1) for r in out)
    assert mixing.emit(docs).columns == docs.columns and mixing.mix(table([])).count() == 0
