"""Readers of the text formats around read data. Plain and gzip files are told apart by Spark's codec rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import check_length, pack, reverse_complement


def barcodes(spark: SparkSession, path: str, length: int | None = None, reverse: bool = False) -> DataFrame:
    """bc of a list with one barcode per line. Blank lines and barcodes with N are left out; another length raises in its task."""
    lines = spark.read.text(path).select(F.upper(F.trim("value")).alias("s")).filter(F.col("s") != "")
    if length is None:
        head = lines.head()
        length = len(head[0]) if head else 1
    check_length(length)
    s = F.when(F.length("s") == length, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("a barcode of another length: "), F.col("s"))))
    kept = lines.select(s.alias("s")).filter(~F.col("s").contains("N"))
    return kept.select(pack(reverse_complement(F.col("s")) if reverse else F.col("s")).alias("bc"))


def sample_list(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """observed, canonical, name, ordinal. Lines hold a barcode; a barcode and a name; or observed, canonical and name.

    Blank lines and # comments are skipped. All barcodes have one length; an observed barcode has one canonical and a canonical one
    name, else ValueError. Canonical samples are numbered as they first appear. Sample lists are short, so the driver reads them.
    """
    rows, length, of, named = [], None, {}, {}
    for (line,) in spark.read.text(path).toLocalIterator():
        part = line.strip().split("\t") if "\t" in line else line.split()
        if not part or not part[0] or part[0].startswith("#"):
            continue
        observed, canonical, name = (part[0], part[0], part[1] if len(part) > 1 else part[0]) if len(part) < 3 else part[:3]
        if reverse:
            observed, canonical = (x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in (observed, canonical))
        for x in (observed, canonical):
            length = length or check_length(len(x))
            if len(x) != length or set(x) - set("ACGT"):
                raise ValueError(f"not a sample barcode of length {length}: {x}")
        if of.setdefault(observed, canonical) != canonical or named.setdefault(canonical, name) != name:
            raise ValueError(f"a conflicting line for {observed}")
        rows.append((observed, canonical, name))
    order = {c: i for i, c in enumerate(named)}
    code = lambda s: sum("ACGT".index(b) << (2 * (len(s) - 1 - i)) for i, b in enumerate(s))
    unique = dict.fromkeys((code(o), code(c), n, order[c]) for o, c, n in rows)
    return spark.createDataFrame(list(unique), "observed long, canonical long, name string, ordinal int")


def transcript_genes(spark: SparkSession, path: str, transcripts: list[str]) -> tuple[DataFrame, list[str], bool]:
    """(tid, gid), gene names and whether the map has splicing states, from two or three columns.

    Gene ids count the names as they first appear; with states S or U (any case) the spliced form is 2 g, the unspliced 2 g + 1. Every
    transcript of the header needs a line. The map is a reference annotation, so its size does not grow with the reads.
    """
    tid = {t: i for i, t in enumerate(transcripts)}
    genes: dict[str, int] = {}
    found: dict[int, int] = {}
    width = None
    for (line,) in spark.read.text(path).toLocalIterator():
        if not line.strip():
            continue
        part = line.rstrip("\n").split("\t")
        width = width or len(part)
        if len(part) != width or width not in (2, 3):
            raise ValueError(f"a map has two or three columns: {line}")
        if width == 3 and part[2].upper() not in ("S", "U"):
            raise ValueError(f"a splicing state is S or U: {line}")
        g = genes.setdefault(part[1], len(genes))
        if part[0] in tid:
            found[tid[part[0]]] = g if width == 2 else 2 * g + (part[2].upper() == "U")
    if len(found) < len(tid):
        raise ValueError(f"{len(tid) - len(found)} transcripts have no gene")
    return spark.createDataFrame(sorted(found.items()), "tid int, gid int"), list(genes), width == 3


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from 0), n of a coordinate file with real or integer entries; n is rounded to whole counts."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), "\\s+").alias("x")).filter(F.size("x") == 3)
    # The line of dimensions is the first: it is the one whose entry count is followed by that many lines.
    marked = lines.withColumn("at", F.monotonically_increasing_id())
    first = marked.agg(F.min("at")).first()[0]
    body = marked.filter(F.col("at") != F.lit(first if first is not None else -1))
    return body.select((F.col("x")[0].cast("long") - 1).alias("row"), (F.col("x")[1].cast("long") - 1).alias("col"), F.round(F.col("x")[2].cast("double")).cast("long").alias("n"))


def class_labels(spark: SparkSession, path: str) -> DataFrame:
    """eqid, label of a label file: two lines of counts, then genes and the class id, separated by tabs."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("x")).filter(F.size("x") > 1)
    return rows.select(F.element_at("x", -1).cast("long").alias("eqid"), F.transform(F.expr("slice(x, 1, size(x) - 1)"), lambda g: g.cast("long")).alias("label"))


def sam(spark: SparkSession, path: str, barcode_tag: str = "CR", umi_tag: str = "UR") -> DataFrame:
    """qname, flag, name, score, cb, ub of the alignments of a SAM text file; header lines are skipped, tags may be in any order."""
    x = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("x"))
    tag = lambda t: F.expr(f"substring(filter(x, y -> startswith(y, '{t}:'))[0], 6)")
    return x.select(F.col("x")[0].alias("qname"), F.col("x")[1].cast("int").alias("flag"), F.col("x")[2].alias("name"), tag("AS").cast("int").alias("score"), tag(barcode_tag).alias("cb"), tag(umi_tag).alias("ub"))


def unmapped_counts(spark: SparkSession, path: str) -> DataFrame:
    """bc, n of binary files of (64-bit barcode, 32-bit count) records, little-endian; equal barcodes add up.

    Files are read record by record with Spark's splits; a file that is no whole number of records raises.
    """
    import struct

    records = spark.sparkContext.binaryRecords(path, 12).map(lambda r: struct.unpack("<QI", bytes(r)))
    return spark.createDataFrame(records, "bc long, n long").groupBy("bc").agg(F.sum("n").alias("n"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a JSON metadata file."""
    return spark.read.json(path, multiLine=True)
