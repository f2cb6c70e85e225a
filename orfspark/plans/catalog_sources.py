"""Queries of the readers: tables of the driver, written in a format and read back."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as S
from . import adapters as V
from .catalog import add
from .catalog_rest import folder


def written(df: DataFrame, value, spark, packed: str = "none") -> str:
    path = folder(spark)
    df.select(value.alias("value")).write.option("compression", packed).option("maxRecordsPerFile", 100_000 if packed != "none" else 0).text(path)  # packed files are read whole
    return path


def text(*parts) -> F.Column:
    """Strings and columns, written one after another."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- GenBank -------------------------------------------------------------------------------------------------------

PAD = " " * 21


def written_genbank(s, d):
    """A record per ORF name with its events as CDS features; every third is in two parts, every second complement."""
    f = V.features(s, d).withColumn("middle", F.floor((F.col("start") + F.col("stop")) / 2))
    span = F.when(F.col("event_id") % 3 == 0, text("join(", F.col("start"), "..", F.col("middle"), f",\n{PAD}", F.col("middle") + 1, "..", F.col("stop") + 1, ")")).otherwise(text(F.col("start"), "..", F.col("stop") + 1))
    span = F.when(F.col("event_id") % 2 == 0, text("complement(", span, ")")).otherwise(span)
    cds = text("     CDS             ", span, f'\n{PAD}/locus_tag="L', F.col("event_id"), f'"\n{PAD}/product="kinase of\n{PAD}', F.col("strand"), f'"\n{PAD}/protein_id="P', F.col("event_id"), f'"\n{PAD}/translation="MKV\n{PAD}LLA"')
    by = f.select("orf_name", cds.alias("cds")).groupBy("orf_name").agg(F.array_join(F.sort_array(F.collect_list("cds")), "\n").alias("all"))
    return written(by, text("LOCUS       C", F.col("orf_name"), "   900 bp    DNA\nFEATURES             Location/Qualifiers\n     source          1..900\n", F.col("all"), "\nORIGIN\n//"), s)


add("s6_read_genbank", lambda s, d: S.read_genbank_cds(s, written_genbank(s, d)).select("chrom", "start", "stop", "strand", "protein_id", "product", "locus_tag", "translation", "n_parts"),
    f"""WITH {V.FEATURES} SELECT 'C' || orf_name AS chrom, start, stop + 1 AS stop, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, 'P' || event_id AS protein_id, 'kinase of ' || strand AS product, 'L' || event_id AS locus_tag, 'MKVLLA' AS translation,
 CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n_parts FROM features""")

# --- spectra -------------------------------------------------------------------------------------------------------


def written_ms2(s, d):
    line = lambda p: F.concat((p["mz"] + 100).cast("string"), F.lit(" "), F.format_number(p["i"], 5))
    by = V.peaks(s, d).groupBy("spectrum").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mz", F.round("intensity", 5).alias("i")))), line), "\n").alias("lines"))
    mz = F.col("spectrum") % 900 + 300
    return written(by, text("S\t", F.col("spectrum"), "\t", F.col("spectrum"), "\t", mz, ".25\nI\tRTime\t1.5\nZ\t2\t900.5\nZ\t3\t1300.5\n", F.col("lines")), s)


add("s7_read_ms2", lambda s, d: S.read_ms2(s, written_ms2(s, d)).select("scan", "precursor_mz", "charge", F.round("parent_mass", 4).alias("parent_mass"), F.size("peaks").cast("long").alias("peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["intensity"]), 3).alias("total")),
    f"WITH {V.PEAKS} SELECT CAST(spectrum AS INT) AS scan, spectrum % 900 + 300.25::DOUBLE AS precursor_mz, 2 AS charge, round((spectrum % 900 + 300.25) * 2 - 1.0078, 4) AS parent_mass, count(*) AS peaks, round(sum(round(intensity, 5)), 3) AS total FROM peaks GROUP BY spectrum")


def written_mzxml(s, d, order: str):
    """A scan per spectrum; its peaks are base64 of 32-bit floats in the order named, every fourth file part breaking off."""

    @F.pandas_udf("string")
    def packed(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        kind = "<f4" if order == "little" else ">f4"
        return pd.Series([base64.b64encode(np.ravel(np.column_stack([m, i])).astype(kind).tobytes()).decode() for m, i in zip(mz, intensity, strict=True)])

    by = V.peaks(s, d).groupBy("spectrum").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    data = packed(F.col("p.mz"), F.col("p.intensity"))
    mz = text('<precursorMz precursorIntensity="1.0">', F.col("spectrum") % 900 + 300, ".5</precursorMz>")
    return written(by, text('<scan num="', F.col("spectrum"), '" msLevel="', F.col("spectrum") % 2 + 1, '" peaksCount="9">\n', F.when(F.col("spectrum") % 2 == 1, mz).otherwise(""), f'<peaks precision="32" byteOrder="{order}" pairOrder="m/z-int">', data, "</peaks>\n</scan>"), s)


MZXML = f"WITH {V.PEAKS} SELECT CAST(spectrum AS INT) AS scan, CAST(spectrum % 2 + 1 AS INT) AS ms_level, CASE WHEN spectrum % 2 = 1 THEN spectrum % 900 + 300.5::DOUBLE END AS precursor_mz, count(*) AS peaks, round(sum(mz * intensity), 3) AS total FROM peaks GROUP BY spectrum"


def mzxml(s, d, order):
    read = S.read_mzxml(s, written_mzxml(s, d, order))
    return read.select("scan", "ms_level", "precursor_mz", F.size("peaks").cast("long").alias("peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["mz"] * p["intensity"]), 3).alias("total"))


add("s8_read_mzxml_network", lambda s, d: mzxml(s, d, "network"), MZXML)
add("s8_read_mzxml_little", lambda s, d: mzxml(s, d, "little"), MZXML)

# --- search results in XML -----------------------------------------------------------------------------------------


def written_pepxml(s, p):
    """Hits as queries. A spectrum of one row is written where it is; rows of the others, known by a second rank, meet."""
    hit = text('<search_hit hit_rank="', F.col("rank"), '" peptide="PEP', F.col("aminos"), '" protein="P', F.col("protein"), '" peptide_prev_aa="K" peptide_next_aa="', F.when(F.col("is_decoy"), "-").otherwise("R"), '"/>')
    rows = p.select("spectrum_file", "scan", "rank", "several", F.when(F.col("rank") == 1, F.col("charge")).alias("z"), hit.alias("hit"))
    by = rows.where("several").groupBy("spectrum_file", "scan")
    by = by.agg(F.max("z").alias("z"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda h: h["hit"]), "").alias("hits"))
    by = by.unionByName(rows.where("not several").select("spectrum_file", "scan", "z", F.col("hit").alias("hits")))
    title = text("f", F.col("spectrum_file"), ".", F.col("scan"))
    return written(by, text('<spectrum_query spectrum="', title, '" start_scan="0" end_scan="0" assumed_charge="', F.col("z"), '"><search_result>', F.col("hits"), "</search_result></spectrum_query>"), s, "gzip")


def pepxml(s, d):
    p = V.ranked(V.table(s, d, "lineitem"))
    # a scan of each spectrum: its first row's
    scans = p.where("rank = 1").select(F.concat(F.lit("f"), F.col("spectrum_file").cast("string"), F.lit("."), F.col("scan").cast("string")).alias("title"), F.col("scan").cast("int").alias("scan"))
    return S.read_pepxml(s, written_pepxml(s, p), scans).select("title", "scan", "charge", "aminos", "protein", "prefix", "suffix")


add("s9_read_pepxml", pepxml,
    f"WITH {V.PSM} SELECT 'f' || spectrum_file || '.' || scan AS title, CAST(scan AS INT) AS scan, CAST(charge AS INT) AS charge, 'PEP' || aminos AS aminos, 'P' || protein AS protein, 'K' AS prefix, CASE WHEN is_decoy THEN '-' ELSE 'R' END AS suffix FROM psm WHERE rank = 1")

# --- genes, variants and catalogues --------------------------------------------------------------------------------


def written_genes(s, d):
    """A gene per event: three exons, of which the coding range cuts the first and ends inside the third."""
    f = V.features(s, d)
    a = F.col("start")
    many = lambda *x: F.concat(*[F.concat((a + k).cast("string"), F.lit(",")) for k in x])
    return written(f, F.concat_ws("\t", F.col("event_id").cast("string"), "strand", F.when(F.col("event_id") % 2 == 0, "-").otherwise("+"), a.cast("string"), (a + 900).cast("string"), (a + 50).cast("string"), (a + 700 + F.col("event_id") % 100).cast("string"), F.lit("3"), many(0, 300, 600), many(100, 400, 900)), s)


add("s10_read_known_genes", lambda s, d: S.read_known_genes(s, written_genes(s, d)),
    f"""WITH {V.FEATURES}, e AS (SELECT event_id, strand, start, unnest([0, 1, 2]) AS exon_no, unnest([50, 300, 600]) AS a, unnest([100, 400, 700 + event_id % 100]) AS z FROM features)
 SELECT CAST(event_id AS VARCHAR) AS gene_id, strand AS chrom, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, CAST(exon_no AS INT) AS exon_no, start + a + 1 AS start, start + z AS stop FROM e""")


def written_snps(s, d):
    f = V.features(s, d)
    k = F.col("event_id")
    alleles = F.when(k % 7 == 0, "A/-").when(k % 3 == 0, "A/G").otherwise("C/T")
    return written(f, F.concat_ws("\t", "strand", (F.col("start") % 5000).cast("string"), F.when(k % 2 == 0, "-").otherwise("+"), alleles, F.when(k % 11 == 0, "in-del").otherwise("snp"), F.when(k % 13 == 0, "MultipleAlignments").otherwise("")), s)


add("s10_read_snps", lambda s, d: S.read_snps(s, written_snps(s, d)),
    f"""WITH {V.FEATURES}, r AS (SELECT strand AS chrom, start % 5000 AS pos, event_id % 2 = 0 AS minus, CASE WHEN event_id % 7 = 0 THEN 'A-' WHEN event_id % 3 = 0 THEN 'AG' ELSE 'CT' END AS x FROM features WHERE event_id % 11 <> 0 AND event_id % 13 <> 0),
 a AS (SELECT chrom, pos, unnest(string_split(CASE WHEN minus THEN translate(x, 'ACGT', 'TGCA') ELSE x END, '')) AS a FROM r) SELECT chrom, pos, array_to_string(list_sort(list(DISTINCT a)), '/') AS alleles FROM a GROUP BY 1, 2""")


def written_swissprot(s, d):
    """An entry per supplier with its parts' sizes as modified residues."""
    li = V.table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_partkey").distinct()
    line = text("FT   MOD_RES     ", F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, " "), "    ", F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, " "), "       Phospho of ", F.col("l_partkey"), ".")
    by = li.select("l_suppkey", line.alias("x")).groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias("all"))
    return written(by, text("ID   X", F.col("l_suppkey"), "_YEAST\nAC   Q", F.col("l_suppkey"), "; P00001;\nFT   CHAIN         1    400       Something.\n", F.col("all"), "\nSQ   SEQUENCE\n//"), s)


add("s11_read_swissprot", lambda s, d: S.read_swissprot_ptm(s, written_swissprot(s, d)), "SELECT DISTINCT 'Q' || l_suppkey AS accession, CAST(l_quantity AS INT) AS pos, 'Phospho of ' || l_partkey || '.' AS note FROM lineitem")
add("s11_read_mods", lambda s, d: S.read_mods(s, written(V.table(s, d, "part"), F.concat_ws("\t", F.col("p_retailprice").cast("string"), "p_brand", "p_type", "p_name"), s)), "SELECT CAST(p_retailprice AS DOUBLE) AS mass, p_brand AS residues, p_type AS position, p_name AS name FROM part")
