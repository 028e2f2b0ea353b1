import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cytoplan.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_statistics_match_brute_force(table, prose):
    rows = prose + [(500, "a b c d e a b c d e f"), (501, "x\nx\n \n\ny#\nx"), (502, "w " * 30000), (503, " ".join(f"q{i % 9000}" for i in range(20000))), (504, None)]
    out = {r.doc_id: r for r in quality.judge(table(rows)).collect()}
    assert len(out) == len(rows)
    for key, text in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        r = out[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_outliers(table):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(2, 9)))
    text = lambda: " ".join(word() for _ in range(int(rng.integers(60, 200))))
    rows = [(i, text(), None if i % 2 else "en", "big") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{word()}#$%&" for _ in range(100)), "en", "big") for i in range(30)]
    lone = [(2000, " ".join(f"{word()}$$$" for _ in range(100)), "xx", "lone")]  # passes the base rules
    out = {r.doc_id: r for r in quality.judge(table(rows + bad + lone)).collect()}
    assert all(out[i].kept for i, *_ in rows) and not any(out[i].kept for i, *_ in bad)
    # A group of one is judged by all documents.
    assert out[2000].pool == "*" and not out[2000].kept and {out[i].pool for i in range(300)} == {"=en\x1f=big", "null\x1f=big"}
    few = {r.doc_id: r for r in quality.judge(table(rows[:10] + lone)).collect()}
    assert few[2000].kept and few[2000].distance is None and few[2000].pool is None  # too few documents for a verdict
    assert quality.judge(table([])).count() == 0


def plain_estimate(x, share=quality.H):
    """Mean and covariance (in least deviations) of the share of rows whose determinant is least, over many starts and whole sorts."""
    rng, n, best = np.random.default_rng(5), len(x), None
    h = int(np.ceil(share * n))
    cov_of = lambda z: np.cov(z.T, bias=True) * quality.CONSISTENT + np.eye(z.shape[1])
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for k in range(30):
        some = x[rng.choice(n, 6, replace=False)] if k else x
        m, c, was = some.mean(0), cov_of(some), np.inf
        while True:
            near = x[np.argsort(far(m, c), kind="stable")[:h]]
            m, c = near.mean(0), cov_of(near)
            if (det := np.linalg.slogdet(c)[1]) >= was - 1e-9:
                break
            was = det
        if best is None or was < best[0]:
            best = (was, far(m, c))
    return best[1]


def test_verdicts_match_a_plain_estimate(table):
    """Two groups, one with a fifth of odd documents of several kinds: distances and verdicts as from whole sorts and many starts."""
    rng = np.random.default_rng(11)
    word = lambda lo, hi: "".join(rng.choice(list("abcdefgh"), rng.integers(lo, hi)))
    rows = []
    for i in range(400):
        kind = i % 25
        w = [word(2, 9) for _ in range(int(np.exp(rng.normal(4.5, 0.4))) + 12)]
        if kind == 0:
            w = [word(14, 30) for _ in w]
        elif kind in (1, 2):
            w = [x + "#%" for x in w]
        elif kind == 3:
            w = w[:12]
        elif kind == 4:
            w = "\n".join([" ".join(w[:11])] + [f"{a} {word(2, 9)}" for a in w[:9]] * 3).split(" ")
        rows.append((i, " ".join(w), "en" if i % 4 else "de", "web"))
    df = table(rows)
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    cut = {r.doc_id: np.array([r[k] for k in quality.K]) / quality.STEPS for r in quality.vector(quality.statistics(df)).collect()}
    for lang in ("en", "de"):
        ids = [i for i, _, x, _ in rows if x == lang and not out[i].base_failed]
        d = plain_estimate(np.array([cut[i] for i in ids]))
        got = np.array([out[i].distance for i in ids])
        assert len(ids) > 60 and np.allclose(np.sqrt(got), np.sqrt(d), rtol=0.15, atol=0.15)
        sure = np.abs(d - quality.CUTOFF) > 0.25 * quality.CUTOFF
        assert [out[i].kept for i, s in zip(ids, sure, strict=True) if s] == (d[sure] < quality.CUTOFF).tolist() and (d[sure] > quality.CUTOFF).any()


def test_a_large_group_is_judged_alike_over_any_partitions(spark):
    from pyspark.sql import functions as F

    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    word = F.lower(F.substring(F.md5(F.col("id").cast("string")), 1, 5))
    text = F.concat_ws(" ", F.array_repeat(F.lit("some"), 3), F.transform(F.sequence(F.lit(0), (6 + h(1, 14)).cast("int")), lambda i: F.concat(word, i.cast("string"))), F.repeat(F.lit("#"), (h(2, 40) - 34).cast("int")))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    seen = []
    for n in (1, 7, 29):
        out = quality.judge(docs.repartition(n))
        seen.append(tuple(out.agg(F.count("*"), F.count(F.when(F.col("kept"), 1)), F.sum(F.xxhash64("doc_id", "distance", "kept").cast("decimal(38,0)"))).first()))
    assert seen[0] == seen[1] == seen[2] and 0 < seen[0][1] < 100_000


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(1)
    k = (rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) * 100).astype(int)
    df = spark.createDataFrame([("g", 1, *map(int, r)) for r in k], "pool string, w long, " + ", ".join(f"{c} long" for c in quality.K))
    e = quality.estimate(df.groupBy("pool").agg(*quality.sums(df.w)))
    d = np.array([r.d for r in quality.distances(df.join(e, "pool").coalesce(1)).select("d", *quality.K).orderBy(*quality.K).collect()])
    x = k[np.lexsort(k.T[::-1])] / quality.STEPS
    s = np.cov(x.T, bias=True) * quality.CONSISTENT + np.eye(5)
    c = x - x.mean(0)
    assert np.allclose(d, np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c)) and np.isclose(e.first().logdet, np.linalg.slogdet(s)[1])


def test_toxicity_on_held_out_rows(spark):
    from cytoplan.llm.queries import op6_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    bad, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in bad) > 0.85 * len(bad) and sum(r.predicted for r in clean) < 0.01 * len(clean)


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together: no additive weights can tell this."""
    rng = np.random.default_rng(0)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    rows = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    buckets = np.concatenate([np.full(a.sum(), 11), np.full(b.sum(), 99)])
    m = toxicity.fit(rows, buckets, (a & b).astype(int))
    r, t = m.pairs(np.array([0, 1, 2, 2]), np.array([11, 99, 11, 99]))
    alone, other, both, none = m.scores(r, t, 4)
    assert both > 0.7 > 0.4 > max(alone, other, none)
    direct = m.bias + m.weight.sum() + m.factor[0] @ m.factor[1]
    assert np.isclose(both, 1 / (1 + np.exp(-direct)))


def test_training_learns_either_but_not_both(spark, table):
    """Two words that make a text toxic if just one of them is there: neither tells anything alone."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random(2) < 0.5
        text = [w for w in filler if rng.random() < 0.3] + ["insult"] * int(a) + ["mention"] * int(b)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a != b)))
    out = {r.doc_id: r for r in toxicity.predict(table(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert len(held) > 400 and sum(p == y for p, y in held) > 0.97 * len(held)


def brute_terms(text):
    """Distinct terms of a text, spelled out."""
    out = set()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        w = w.lower()
        out.add(("whole", w))
        out |= {(n, w[:n]) for n in (4, 5) if len(w) >= n}
    return out


def test_terms_and_scores_match_brute_force(spark, table, prose):
    import pyarrow as pa

    from cytoplan.llm import common

    texts = [t for _, t in prose] + ["Abcd abcd ABCDE abcdé", "word " * 70000 + "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    named, where = {}, {}
    for lo, _, data, offs in common.text_chunks(batch):
        row, bucket = toxicity.terms(data, offs)
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            where.setdefault(lo + r, set()).add(b)
    for i, t in enumerate(texts):
        for term in brute_terms(t):
            named.setdefault(term, set()).add(i)
        assert len(where.get(i, set())) <= len(brute_terms(t)) <= len(where.get(i, set())) + 3  # buckets may coincide
    rng = np.random.default_rng(1)
    index = np.full(toxicity.BUCKETS, -1, np.int16)
    known = sorted(set.union(*where.values()))[::3]
    index[known] = np.arange(len(known))
    m = toxicity.Machine(-1.0, index, rng.normal(size=len(known)) / 9, rng.normal(size=(len(known), toxicity.FACTORS)) / 9)
    got = {r.doc_id: r.score for r in toxicity.score(table(list(enumerate(texts))), m).collect()}
    for i in range(len(texts)):
        at = [index[b] for b in where.get(i, set()) if index[b] >= 0]
        total = m.bias + sum(m.weight[k] for k in at) + sum(m.factor[a] @ m.factor[b] for j, a in enumerate(at) for b in at[:j])
        assert np.isclose(got[i], 1 / (1 + np.exp(-np.clip(total, -30, 30))))


def test_toxicity_edge_cases(spark, table):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(5, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    docs = table([(i, ("vile " if i % 4 == 0 else "") + "calm words of day", "en", "a") for i in range(100)] + [(200, None), (201, ""), (202, "vile " * 9), (202, "vile " * 9), (None, "VILE!")])
    out = toxicity.predict(docs.selectExpr("*", "1 as score", "2 as terms"), labels).collect()
    assert len(out) == 105 and all(r.score is not None for r in out)
    by = {r.doc_id: r.predicted for r in out}
    assert by[202] == 1 and by[200] == by[201] == 0 and by[96] == 1 and by[97] == 0 and by[None] == 1
    at = toxicity.score(docs, toxicity.Machine(float(np.log(0.7 / 0.3)) + 1e-12, np.full(toxicity.BUCKETS, -1, np.int16), np.zeros(1), np.zeros((1, 4))))
    assert all(r.score >= toxicity.THRESHOLD for r in at.collect())
    two = [toxicity.train(table([(i % 80, f"{'vile' if i % 4 == 0 else 'fine'} {i // 80}") for i in range(160)], n), labels) for n in (1, 5)]
    assert two[0].bias == two[1].bias and np.array_equal(two[0].factor, two[1].factor)
    none = toxicity.predict(docs, labels.limit(0)).collect()
    assert len(none) == 105 and not any(r.predicted for r in none)
    assert toxicity.predict(table([]), labels).count() == 0
    odd = docs.selectExpr("*", "1 as score", "'t' as `__text`")
    kept = toxicity.keep_clean(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 200, 201}


def test_language_on_held_out_rows(spark):
    from cytoplan.llm.queries import op8_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(table):
    docs = [(i, "the cat and the dog of the house", "en") for i in range(30)] + [(100 + i, "der hund und die katze im haus", "de") for i in range(30)]
    docs += [(300, None), (301, "123 !? \n"), (302, ""), (303, "THE HOUSE"), (304, "und DIE Katze"), (305, "привет мир"), (306, "кот", None), (303, "THE HOUSE")]
    out = language_id.predict(table(docs).selectExpr("*", "1 as lang_pred", "2 as gram")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and [by[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    assert by[303].lang_pred == "en" and by[304].lang_pred == "de" and by[305].lang_pred in ("en", "de")
    assert not by[305].accepted and by[303].accepted and by[305].score < by[303].score
    assert language_id.predict(table([])).count() == 0
    assert {r.lang_pred for r in language_id.predict(table([(1, "abc", None), (2, "abc", None)])).collect()} == {"und"}


def test_models_are_distributions():
    """After any context of the training words, the probabilities of all symbols add up to nearly 1."""
    words = ["banana", "bandana", "cabana", "nab"]
    grams = Counter()
    mark = chr(language_id.MARK)
    for w in words:
        s = mark + w + mark
        for n in range(2, language_id.ORDER + 1):
            for i in range(len(s) - n + 1):
                if i == 0 or n == language_id.ORDER:
                    grams[s[i : i + n]] += 1
    import pandas as pd

    m = language_id.estimate("x", pd.DataFrame({"gram": list(grams), "n": list(grams.values())}))
    symbols = sorted(set("".join(words))) + [mark]

    def logp(context, c):
        s = np.array([ord(x) for x in context + c], np.uint32)
        hashes = [None, *(language_id.gram_hash(s, n) for n in range(1, language_id.ORDER + 1))]
        return -m.costs(s, np.array([0, len(s)]), hashes)[0]

    for context in (mark, mark + "b", mark + "ban"):
        steps = [logp(context, c) - (logp(context[:-1], context[-1]) if len(context) > 1 else 0) for c in symbols]
        assert 0.8 < np.exp(steps).sum() <= 1.001


def test_models_keep_all_grams(table, monkeypatch):
    """Two languages of over 200,000 grams each: every gram and context has the value that its language's whole counts give."""
    import pandas as pd

    rng = np.random.default_rng(4)
    rows, grams, mark = [], {"aa": Counter(), "bb": Counter()}, chr(language_id.MARK)
    for i, lang in enumerate(["aa", "bb"] * 30):
        words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrst"), (2500, 8))]
        rows.append((i, " ".join(words), lang))
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for w in words:
                x = mark + w + mark
                grams[lang].update([x[:n] for n in range(2, language_id.ORDER)] + [x[j : j + language_id.ORDER] for j in range(len(x) - language_id.ORDER + 1)])
    stored = language_id.train(table(rows))
    assert stored.langs == ("aa", "bb") and min(map(len, grams.values())) > 200_000
    monkeypatch.setattr(language_id, "KEPT_ENTRIES", 50_000)  # shards come and go
    shards = language_id._Shards(stored)
    want = [language_id.estimate(k, pd.DataFrame({"gram": list(c), "n": list(c.values())})) for k, c in grams.items()]
    got = shards.models(np.concatenate([x for m in want for x in (m.gram, m.context)]))
    for a, b in zip(want, got, strict=True):
        assert np.array_equal(a.gram, b.gram) and np.array_equal(a.context, b.context)
        assert np.allclose(a.logp, b.logp, atol=1e-5) and np.allclose(a.backoff, b.backoff, atol=1e-5)
        assert np.isclose(a.floor, b.floor) and np.isclose(a.usual, b.usual)


@pytest.mark.parametrize("bad", [b"\xff\xfe abc", b"caf\xc3"])
def test_bytes_that_are_no_text(bad):
    """Words of damaged bytes are taken with replacement marks, which are no letters."""
    data = np.frombuffer(bad + b"good", np.uint8)
    points, start, end, key, row = language_id.words(data, np.array([0, len(bad), len(data)]))
    assert len(start) == len(end) == len(key) == len(row) and set(row.tolist()) <= {0, 1}
