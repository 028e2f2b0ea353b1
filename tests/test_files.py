import gzip

import pytest

from cytoplan.sources import files, sinks


def test_matrix_round_trip(spark, tmp_path):
    entries = [(0, 0, 5), (1, 2, 7), (2, 5, 1), (3, 1, 12)]
    for kind in ("real", "integer"):
        sinks.write_matrix(spark.createDataFrame(entries, "row long, col long, n long"), str(tmp_path / kind), 4, 6, kind)
        lines = [r.value for r in spark.read.text(str(tmp_path / kind)).collect()]
        (tmp_path / f"{kind}.mtx").write_text("\n".join(sorted(lines, key=lambda x: (x[0] != "%", x != "4 6 4"))) + "\n")
        got = files.matrix_market(spark, str(tmp_path / f"{kind}.mtx")).collect()
        assert sorted(map(tuple, got)) == entries


def test_barcodes(spark, tmp_path):
    with gzip.open(tmp_path / "w.txt.gz", "wt") as f:
        f.write("ACGT\nTTTT\nNCGT\n\n")
    assert sorted(r.bc for r in files.barcodes(spark, str(tmp_path / "w.txt.gz")).collect()) == [27, 255]
    (tmp_path / "bad.txt").write_text("ACGT\nACG\n")
    with pytest.raises(Exception, match="another length"):
        files.barcodes(spark, str(tmp_path / "bad.txt")).collect()


def test_sample_list(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("# comment\nAA\tAA\tone\nAC\tAA\tone\n\nGG\tGG\ttwo\n")
    rows = [tuple(r) for r in files.sample_list(spark, str(p)).collect()]
    assert sorted(rows) == [(0, 0, "one", 0), (1, 0, "one", 0), (10, 10, "two", 1)]
    p.write_text("AA\tAA\tone\nAA\tGG\ttwo\n")
    with pytest.raises(ValueError):
        files.sample_list(spark, str(p))


def test_transcript_genes(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("t1\tg2\nt0\tg1\nt2\tg2\n")
    df, names, spliced = files.transcript_genes(spark, str(p), ["t0", "t1", "t2"])
    assert (names, spliced) == (["g2", "g1"], False) and [tuple(r) for r in df.orderBy("tid").collect()] == [(0, 1), (1, 0), (2, 0)]
    p.write_text("t0\tg\ts\nt1\tg\tU\n")
    df, names, spliced = files.transcript_genes(spark, str(p), ["t0", "t1"])
    assert spliced and [r.gid for r in df.orderBy("tid").collect()] == [0, 1]
    assert sinks.column_names(["a", "b"], True) == ["a", "b", "a-U", "b-U", "a-A", "b-A"]
    with pytest.raises(ValueError):
        files.transcript_genes(spark, str(p), ["t0", "t9"])


def test_class_labels_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(0, [1, 2]), (1, [3])], "eqid long, label array<long>")
    lines = [r.value for r in sinks.class_lines(labels, 9).collect()]
    assert lines == ["9", "2", "1\t2\t0", "3\t1"]
    (tmp_path / "l.txt").write_text("\n".join(lines))
    assert sorted((r.eqid, r.label) for r in files.class_labels(spark, str(tmp_path / "l.txt")).collect()) == [(0, [1, 2]), (1, [3])]


def test_sam_and_unmapped_counts(spark, tmp_path):
    import struct

    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t0\tchr\t1\t9\t5M\t*\t0\t0\tACGTA\t*\tUR:Z:AC\tAS:i:7\tCR:Z:GGNT\n")
    r = files.sam(spark, str(tmp_path / "a.sam")).first()
    assert (r["qname"], r.flag, r["name"], r.cb, r.ub) == ("r1", 0, "chr", "GGNT", "AC") and r.score == 7
    (tmp_path / "u.bin").write_bytes(b"".join(struct.pack("<QI", *x) for x in ((5, 2), (6, 1), (5, 3))))
    assert sorted(map(tuple, files.unmapped_counts(spark, str(tmp_path / "u.bin")).collect())) == [(5, 5), (6, 1)]


def test_stream_histogram(spark, tmp_path):
    from cytoplan.streaming import histograms

    spark.createDataFrame([(1,), (1,), (2,)], "bc long").write.parquet(str(tmp_path / "in"))
    q = histograms.start(histograms.histogram(histograms.reads(spark, str(tmp_path / "in"), "bc long")), "hist", str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("hist").collect())) == [(1, 2), (2, 1)]
    finally:
        q.stop()
