import base64
import bz2
import struct

from orfspark.sources import tables as S
from orfspark.streaming import incremental as I


def test_psm(spark, tmp_path):
    line = "\t".join(["f.mgf", "7", "K.PEP.R", "prot", "2", "1.5", "3", "1", "1", "1", "1", "1", "2", "0.01", "1", "0", "0.1", "5", "9", "0"])
    (tmp_path / "a.txt").write_text("#head\n" + line + "\t0.5\n" + line + "\nbad\trow\n")
    (tmp_path / "b.txt.bz2").write_bytes(bz2.compress((line.replace("\t7\t", "\t8\t") + "\n").encode()))
    (tmp_path / "c.skip").write_text(line)
    psm, bad = S.read_psm(spark, str(tmp_path))
    assert sorted((r.scan, r["rank"], r.lfdr) for r in psm.collect()) == [(7, 1, 0.5), (7, 2, None), (8, 1, None)]
    assert bad.count() == 1 and S.latest_results(psm).count() == 3
    S.write_by_file(psm, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a one two\nACD\nEFG\n>b\n" + "K" * 170 + "\n>c\n")
    got = {r.name: (r.description, r.seq) for r in S.read_fasta(spark, str(p)).collect()}
    assert got == {"a": ("one two", "ACDEFG"), "b": (None, "K" * 170), "c": (None, "")}
    S.write_fasta(S.read_fasta(spark, str(p)).coalesce(1), str(tmp_path / "out"))
    lines = "".join(f.read_text() for f in (tmp_path / "out").glob("part*")).split("\n")
    assert max(map(len, lines)) == 80 and lines.count("K" * 80) == 2


def test_trie(spark, tmp_path):
    (tmp_path / "d.trie").write_text("ACD*EFG*")
    (tmp_path / "d.index").write_bytes(b"".join(struct.pack("<qi80s", 0, 0, n) for n in (b"p1", b"p2")))
    assert sorted((r.name, r.seq) for r in S.read_trie(spark, str(tmp_path / "d.trie"), str(tmp_path / "d.index")).collect()) == [("p1", "ACD"), ("p2", "EFG")]


def test_gff(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff-version 3\nc\ts\tCDS\t1\t9\t.\t+\t0\tID=x;Name=y z\nc\ts\tgene\t1\t9\t2.5\t-\t.\tID=q\n")
    df = S.read_gff(spark, str(tmp_path / "g.gff"))
    first = lambda d: sorted((r.type, r.start, r.score, r.phase, tuple(sorted(r.attributes.items()))) for r in d.collect())
    S.write_gff(df, str(tmp_path / "out"))
    assert first(df) == first(S.read_gff(spark, str(tmp_path / "out"))) == [("CDS", 1, None, 0, (("ID", "x"), ("Name", "y z"))), ("gene", 1, 2.5, None, (("ID", "q"),))]


def test_genbank(spark, tmp_path):
    text = 'LOCUS       NC_1  100 bp\nFEATURES             Location/Qualifiers\n     source          1..100\n     CDS             complement(join(3..20,\n                     30..50))\n                     /locus_tag="L1"\n                     /product="a long\n                     name"\n                     /translation="MK\n                     L"\n     gene            60..70\nORIGIN\n//\n'
    (tmp_path / "x.gbk").write_text(text)
    r = S.read_genbank_cds(spark, str(tmp_path / "x.gbk")).collect()
    assert [(x.chrom, x.start, x.stop, x.strand, x.locus_tag, x["product"], x.translation, x.n_parts, x.protein_id) for x in r] == [("NC_1", 3, 50, "-", "L1", "a long name", "MKL", 2, None)]


def test_spectra(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nTITLE=t1\nCHARGE=2+\nPEPMASS=500.5\nSCANS=12\n100.5 20\n200.25 3.5e2\nEND IONS\n\nBEGIN IONS\nTITLE=t2\nPEPMASS=300\nEND IONS\n")
    got = {r.title: r for r in S.read_mgf(spark, str(tmp_path / "x.mgf")).collect()}
    assert got["t1"].scan == 12 and abs(got["t1"].parent_mass - (1001 - 1.0078)) < 1e-9 and [tuple(p) for p in got["t1"].peaks] == [(100.5, 20.0), (200.25, 350.0)] and got["t2"].peaks == []
    (tmp_path / "x.ms2").write_text("H\tx\nS\t5\t5\t400.2\nZ\t2\t799.4\n100.1 5\n101.2 6\nS\t6\t6\t410\nZ\t1\t410\n")
    got = {r.scan: r for r in S.read_ms2(spark, str(tmp_path / "x.ms2")).collect()}
    assert got[5].charge == 2 and len(got[5].peaks) == 2 and got[6].peaks == []
    data = base64.b64encode(struct.pack(">4f", 100.5, 7, 200.25, 9)).decode()
    (tmp_path / "x.mzXML").write_text(f'<msRun><scan num="3" msLevel="2" peaksCount="2"><precursorMz precursorIntensity="1">512.3</precursorMz><peaks precision="32">{data}</peaks></scan><scan num="4" msLevel="1"><peaks precision="32"></peaks>')
    got = {r.scan: r for r in S.read_mzxml(spark, str(tmp_path / "x.mzXML")).collect()}
    assert (got[3].ms_level, got[3].precursor_mz) == (2, 512.3) and [tuple(p) for p in got[3].peaks] == [(100.5, 7.0), (200.25, 9.0)] and got[4].peaks == []


def test_small_tables(spark, tmp_path):
    (tmp_path / "k.txt").write_text("g1\tchr1\t+\t0\t100\t10\t80\t2\t0,50,\t20,100,\n")
    assert sorted((r.exon_no, r.start, r.stop) for r in S.read_known_genes(spark, str(tmp_path / "k.txt")).collect()) == [(0, 11, 20), (1, 51, 80)]
    (tmp_path / "s.txt").write_text("c\t5\t-\tA/G\tsnp\t\nc\t5\t+\tT/A\tsnp\t\nc\t6\t+\tA/GG\tsnp\t\nc\t7\t+\tA/C\tindel\t\n")
    assert sorted((r.pos, r.alleles) for r in S.read_snps(spark, str(tmp_path / "s.txt")).collect()) == [(5, "A/C/T"), (6, "A")]
    (tmp_path / "u.dat").write_text("ID   X\nAC   P12345;\nFT   MOD_RES      22     22       Phosphoserine.\n//\n")
    assert [tuple(r) for r in S.read_swissprot_ptm(spark, str(tmp_path / "u.dat")).collect()] == [("P12345", 22, "Phosphoserine.")]
    (tmp_path / "m.txt").write_text("#mass\n16\tM\t*\toxidation\n")
    assert S.read_mods(spark, str(tmp_path / "m.txt")).first().name == "oxidation"


def test_pepxml(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<r><spectrum_query spectrum="t1" start_scan="4" assumed_charge="2"><search_result><search_hit hit_rank="1" peptide="PEPK" protein="p" peptide_prev_aa="R" peptide_next_aa="A"/><search_hit hit_rank="2" peptide="XXX" protein="q" peptide_prev_aa="R" peptide_next_aa="A"/></search_result></spectrum_query></r>')
    r = S.read_pepxml(spark, str(tmp_path / "p.xml")).first()
    assert (r.scan, r.charge, r.aminos) == (4, 2, "PEPK")


def test_streams(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    events.limit(300).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = I.stream_results(spark, str(tmp_path / "in"), events.schema)
    query = I.stream_histogram(stream, ["event_type"], "value", 10.0).writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = I.stream_histogram(batch, ["event_type"], "value", 10.0)
    key = lambda df: sorted((r.event_type, r.bin, r.n) for r in df.collect())
    assert key(spark.sql("select * from hist")) == key(want)
    I.run_to_end(stream.select("event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    I.run_to_end(stream.select("event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    query = I.stream_discovery(stream, "user_id").writeStream.format("memory").queryName("disc").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert (spark.sql("select sum(new_keys) from disc").first()[0] or 0) <= batch.select("user_id").distinct().count()
