"""Readers and writers of the text and XML formats of the domain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import stored

PSM_COLUMNS = [
    ("spectrum_file", "string"), ("scan", "int"), ("annotation", "string"), ("protein", "string"), ("charge", "int"), ("mq_score", "double"), ("length", "double"),
    ("total_prm", "double"), ("median_prm", "double"), ("fraction_y", "double"), ("fraction_b", "double"), ("intensity", "double"), ("ntt", "double"), ("p_value", "double"),
    ("f_score", "double"), ("delta_any", "double"), ("delta", "double"), ("protein_id", "int"), ("db_pos", "long"), ("file_offset", "long"), ("lfdr", "double"),
]


def psm_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of result files that are not headers, with file, block and running number."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,res,csv,out,msgf,txt.bz2,res.bz2,csv.bz2,out.bz2,msgf.bz2}").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def read_psm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(psm, bad): rows of 20 or 21 tab columns with `rank` in input order per spectrum; all other rows as they are."""
    rows = psm_lines(spark, path).withColumn("c", F.split("value", "\t"))
    good = rows.where(F.size("c").isin(20, 21))
    cols = [F.try_element_at("c", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(PSM_COLUMNS)]
    w = Window.partitionBy("spectrum_file", "scan").orderBy("file", "block", "line")
    psm = good.select(*cols, "file", "block", "line", "changed").withColumn("rank", F.row_number().over(w)).drop("file", "block", "line")
    return psm, rows.where(~F.size("c").isin(20, 21)).select("file", "value")


def latest_results(psm: DataFrame) -> DataFrame:
    """Of each spectrum the rows of the newest file."""
    w = Window.partitionBy("spectrum_file", "scan").orderBy(F.desc("changed"))
    return psm.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def write_by_file(df: DataFrame, path: str) -> None:
    """A folder per file. Rows are dealt by ranges of the file, so that a task writes few folders and a folder is
    written by few tasks; a large file is split by a hash of its rows."""
    df.repartitionByRange("spectrum_file", F.xxhash64(*df.columns)).write.partitionBy("spectrum_file").parquet(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq)."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_replace(F.substring_index("v", "\n", 1), "\r", "")
    seq = F.regexp_replace(F.when(F.instr("v", "\n") > 0, F.substr("v", F.instr("v", "\n") + 1)).otherwise(F.lit("")), r"\s", "")
    return rows.where(F.trim("v") != "").select(F.substring_index(head, " ", 1).alias("name"), F.when(F.instr(head, " ") > 0, F.substr(head, F.instr(head, " ") + 1)).alias("description"), seq.alias("seq"))


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def write_fasta(df: DataFrame, path: str) -> None:
    """(name, seq), wrapped at 80 letters."""
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"))).alias("value")).write.text(path)


def read_trie(spark: SparkSession, trie: str, index: str) -> DataFrame:
    """S3: (seq_id, name, seq) of residues joined by ``*`` and 92-byte index records (offset long, database long as int, name)."""
    seqs = stored(spark.read.option("lineSep", "*").text(trie).where("value <> ''").select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    # numbers within each block of the file, and the blocks' sizes before it (a row per block)
    before = seqs.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    numbered = seqs.join(F.broadcast(before), "p").withColumn("seq_id", F.col("b") + F.row_number().over(Window.partitionBy("p").orderBy("i")) - 1)
    # fixed-length records, read by offset and split like any file; their order is the sequences'
    records = spark.sparkContext.binaryRecords(index, 92).zipWithIndex().map(lambda r: (r[1], bytes(r[0][12:92])))
    records = spark.createDataFrame(records, "seq_id long, raw binary")
    name = F.regexp_extract(F.decode("raw", "ISO-8859-1"), "^([^\\x00]*)", 1)
    return numbered.join(records.select("seq_id", name.alias("name")), "seq_id").select("seq_id", "name", F.col("value").alias("seq"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    schema = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(schema).csv(path)
    dot = lambda c, t: F.when(F.col(c) != ".", F.col(c)).try_cast(t).alias(c)
    return rows.select("seqid", "source", "type", "start", "end", dot("score", "double"), "strand", dot("phase", "int"), F.str_to_map("attributes", F.lit(";"), F.lit("=")).alias("attributes"))


def write_gff(df: DataFrame, path: str) -> None:
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase")]
    df.select(F.concat_ws("\t", *cells, attributes).alias("value")).write.text(path)


def read_genbank_cds(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, strand, protein_id, product, locus_tag, translation, n_parts) of CDS features."""
    rows = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_extract("value", r"(?m)^LOCUS\s+(\S+)", 1).alias("chrom"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\n {5}CDS +(.*?)(?=\n {5}\S|\n\S|$)"), F.lit(1))).alias("f"))
    where = F.regexp_replace(F.substring_index("f", "\n                     /", 1), r"\s", "")
    spots = F.transform(F.regexp_extract_all(where, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    note = lambda k: F.nullif(F.regexp_replace(F.regexp_extract("f", rf'(?s)/{k}="([^"]*)"', 1), r"\s+", "" if k == "translation" else " "), F.lit(""))
    return rows.select("chrom", F.array_min(spots).alias("start"), F.array_max(spots).alias("stop"), F.when(where.contains("complement"), "-").otherwise("+").alias("strand"), *[note(k).alias(k) for k in ("protein_id", "product", "locus_tag", "translation")], F.ceil(F.size(spots) / 2).cast("int").alias("n_parts"))


def peaks_of(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"(?m)^([0-9.]+[ \t]+[0-9.eE+-]+)"), F.lit(1))
    return F.transform(found, lambda p: F.struct(F.try_element_at(F.split(p, r"[ \t]+"), F.lit(1)).cast("double").alias("mz"), F.try_element_at(F.split(p, r"[ \t]+"), F.lit(2)).cast("double").alias("intensity")))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum_file, scan, title, precursor_mz, charge, parent_mass, peaks)."""
    rows = spark.read.option("lineSep", "BEGIN IONS").text(path).select("value", F.col("_metadata.file_path").alias("spectrum_file")).where(F.col("value").contains("PEPMASS="))
    tag = lambda k, p: F.regexp_extract("value", rf"(?m)^{k}={p}", 1)
    mz, z = tag("PEPMASS", r"([0-9.]+)").cast("double"), F.coalesce(tag("CHARGE", r"\+?(\d+)").try_cast("int"), F.lit(0))
    return rows.select("spectrum_file", tag("SCANS", r"(\d+)").try_cast("int").alias("scan"), tag("TITLE", "(.*)").alias("title"), mz.alias("precursor_mz"), z.alias("charge"), (mz * z - (z - 1) * 1.0078).alias("parent_mass"), peaks_of(F.substring_index("value", "END IONS", 1)).alias("peaks"))


def read_ms2(spark: SparkSession, path: str) -> DataFrame:
    """One row per scan and its first charge line."""
    rows = spark.read.option("lineSep", "\nS\t").text(path).select(F.regexp_replace("value", "^S\t", "").alias("v"), F.col("_metadata.file_path").alias("spectrum_file")).where(F.col("v").rlike(r"^\d+\t"))
    mz, z = F.regexp_extract("v", r"^\d+\t\d+\t([0-9.]+)", 1).cast("double"), F.coalesce(F.regexp_extract("v", r"(?m)^Z\t(\d+)", 1).try_cast("int"), F.lit(0))
    return rows.select("spectrum_file", F.regexp_extract("v", r"^(\d+)", 1).cast("int").alias("scan"), mz.alias("precursor_mz"), z.alias("charge"), (mz * z - (z - 1) * 1.0078).alias("parent_mass"), peaks_of(F.regexp_replace("v", r"^[^\n]*\n", "")).alias("peaks"))


def with_peaks(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Scans with `data` (pairs of 32-bit floats, `little` or not) as scans with peaks, about `size` bytes at a time: pairs
    stay in arrays, none is a Python object."""
    for batch in batches:
        data, little = batch.column("data"), batch.column("little").to_pylist()
        ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(little):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")), first + 1)
            parts = [np.frombuffer(b or b"", dtype="<f4" if order else ">f4", count=len(b or b"") // 8 * 2) for b, order in zip(data[first:last].to_pylist(), little[first:last], strict=True)]
            flat = np.concatenate([p.astype(np.float64) for p in parts])
            offsets = np.append(0, np.cumsum([len(p) // 2 for p in parts])).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(flat[0::2]), pa.array(flat[1::2])], ["mz", "intensity"])
            cells = [batch.column(c)[first:last] for c in ("spectrum_file", "scan", "ms_level", "precursor_mz")]
            yield pa.RecordBatch.from_arrays([*cells, pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["spectrum_file", "scan", "ms_level", "precursor_mz", "peaks"])
            first = last


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum_file, scan, ms_level, precursor_mz, peaks) of scans; peaks are base64 pairs of 32-bit floats in the
    byteOrder that their element names (little, little-endian, or else network). A file may break off: a scan without
    the end of its peaks keeps the whole pairs it has."""
    rows = spark.read.option("lineSep", "<scan ").text(path).where(F.col("value").rlike(r"^\s*num=")).select("value", F.col("_metadata.file_path").alias("spectrum_file"))
    mz = F.regexp_extract("value", r"<precursorMz[^>]*>([0-9.]+)", 1).try_cast("double")
    signs = F.regexp_replace(F.regexp_extract("value", r"(?s)<peaks[^>]*>([A-Za-z0-9+/=\s]*)", 1), r"\s", "")
    data = F.unbase64(F.substr(signs, F.lit(1), (F.floor(F.length(signs) / 4) * 4).cast("int")))  # whole groups of four
    little = F.regexp_extract("value", r'<peaks[^>]*byteOrder="([^"]*)"', 1).isin("little", "little-endian")
    scans = rows.select("spectrum_file", F.regexp_extract("value", r'num="(\d+)"', 1).cast("int").alias("scan"), F.regexp_extract("value", r'msLevel="(\d+)"', 1).try_cast("int").alias("ms_level"), mz.alias("precursor_mz"), data.alias("data"), little.alias("little"))
    return scans.mapInArrow(with_peaks, "spectrum_file string, scan int, ms_level int, precursor_mz double, peaks array<struct<mz:double,intensity:double>>")


def xml_attribute(element: Column, name: str) -> Column:
    """An attribute of an element's text, its entities replaced; null where it has none."""
    found = F.nullif(F.regexp_extract(element, rf'\s{name}="([^"]*)"', 1), F.lit(""))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(sign))
    return found


def read_pepxml(spark: SparkSession, path: str, scans: DataFrame | None = None) -> DataFrame:
    """(title, charge, aminos, protein, prefix, suffix, scan) of queries with a first-rank hit; scan numbers through
    (title, scan) if given, else where a query's scans start. Queries are cut out of the text, so a file may be split, and
    one that breaks off keeps the queries whose hit it has."""
    rows = spark.read.option("lineSep", "<spectrum_query").text(path).where(F.col("value").rlike(r"^\s"))
    query = F.concat(F.lit(" "), F.substring_index("value", ">", 1))
    hit = F.element_at(F.filter(F.concat(F.regexp_extract_all("value", F.lit(r"(<search_hit\s[^>]*>)"), F.lit(1)), F.array(F.lit(None).cast("string"))), lambda h: h.isNull() | h.rlike(r'\shit_rank="1"')), 1)
    rows = rows.select(query.alias("q"), hit.alias("h")).where("h is not null")
    out = rows.select(
        xml_attribute(F.col("q"), "spectrum").alias("title"), xml_attribute(F.col("q"), "start_scan").try_cast("int").alias("start_scan"), xml_attribute(F.col("q"), "assumed_charge").try_cast("int").alias("charge"),
        *[xml_attribute(F.col("h"), a).alias(n) for a, n in (("peptide", "aminos"), ("protein", "protein"), ("peptide_prev_aa", "prefix"), ("peptide_next_aa", "suffix"))],
    )
    if scans is None:
        return out.withColumnRenamed("start_scan", "scan")
    return out.join(scans, "title", "left").withColumn("scan", F.coalesce("scan", "start_scan")).drop("start_scan")


def read_known_genes(spark: SparkSession, path: str) -> DataFrame:
    """Exons (gene_id, chrom, strand, exon_no, start, stop) clipped to the coding range, from tab rows
    name, chrom, strand, txStart, txEnd, cdsStart, cdsEnd, exonCount, exonStarts, exonEnds."""
    schema = "gene_id string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, n int, starts string, ends string"
    rows = spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path)
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    ex = rows.select("gene_id", "chrom", "strand", "cds_start", "cds_end", F.posexplode(F.arrays_zip(numbers("starts").alias("a"), numbers("ends").alias("z"))).alias("exon_no", "e"))
    lo, hi = F.greatest("e.a", "cds_start"), F.least("e.z", "cds_end")
    return ex.where(lo < hi).select("gene_id", "chrom", "strand", "exon_no", (lo + 1).alias("start"), hi.alias("stop"))


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, alleles) of single-base variants of class snp, on the plus strand, merged by position.

    Tab rows: chrom, pos, strand, alleles, class, exceptions.
    """
    schema = "chrom string, pos long, strand string, alleles string, class string, exceptions string"
    rows = spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path).where("class = 'snp' and coalesce(exceptions, '') = ''")
    plus = F.when(F.col("strand") == "-", F.translate("alleles", "ACGT", "TGCA")).otherwise(F.col("alleles"))
    one = rows.select("chrom", "pos", F.explode(F.split(plus, "/")).alias("a")).where(F.length("a") == 1)
    return one.groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.collect_set("a")), "/").alias("alleles"))


def read_swissprot_ptm(spark: SparkSession, path: str) -> DataFrame:
    """(accession, pos, note) of MOD_RES features."""
    rows = spark.read.option("lineSep", "\n//").text(path)
    feature = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^FT   MOD_RES +(\d+[^\n]*)"), F.lit(1))).alias("f")
    return rows.select(F.regexp_extract("value", r"(?m)^AC   (\w+)", 1).alias("accession"), feature).select("accession", F.regexp_extract("f", r"^(\d+)", 1).cast("int").alias("pos"), F.trim(F.regexp_replace("f", r"^[\d\s]+", "")).alias("note"))


def read_mods(spark: SparkSession, path: str) -> DataFrame:
    """(mass, residues, position, name) of a tab catalogue."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("mass double, residues string, position string, name string").csv(path)


def peptidome_report(located: DataFrame) -> DataFrame:
    """(protein, aminos, spectra, places as file:scan list)."""
    place = F.concat_ws(":", "spectrum_file", "scan")
    return located.groupBy("protein", "aminos").agg(F.count("*").alias("spectra"), F.array_join(F.array_sort(F.collect_set(place)), ",").alias("places"))


def second_pass_db(sequences: DataFrame, chosen: DataFrame, key: str = "protein", peptides: int = 1) -> DataFrame:
    """Sequences of proteins with enough chosen peptides."""
    keep = chosen.groupBy(key).agg(F.count_distinct("aminos").alias("n")).where(F.col("n") >= peptides)
    return sequences.join(keep, key, "left_semi")
