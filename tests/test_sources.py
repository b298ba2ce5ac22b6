import time

from pyspark.sql import functions as F

from variantlake.sources import readers, writers
from variantlake.streaming import upserts


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], 3), ("a", None, None)], "k string, l array<string>, n int")
    writers.tsv(df.coalesce(1), str(tmp_path / "t"), ["k"])
    got = readers.tsv(spark, str(tmp_path / "t")).collect()
    assert [tuple(r) for r in got] == [("a", None, None), ("b", "x,y", "3")]
    raw = readers.tsv(spark, str(tmp_path / "t"), blanks=False).orderBy("k").first()
    assert (raw.k, raw.l, raw.n) == ("a", "-", "-")


def test_vcf(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text("##fileformat=VCFv4.1\n##INFO=<ID=CSQ,Number=.,Type=String,Description=\"Format: Allele|Gene\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n13\t5\trs1\tA\tT,G\t.\tPASS\tAF=1,2;CSQ=a|b;F\n")
    r = readers.vcf(spark, str(p)).first()
    assert (r.chrom, r.pos, r.alts, r.info["AF"], r.info["F"]) == ("13", 5, ["T", "G"], ["1", "2"], [""])
    assert readers.vcf_subfields(spark, str(p), "CSQ") == ["Allele", "Gene"]
    df = spark.createDataFrame([(17, 9, "A", "T", "a;b: c", None), (2, 7, "G", "C", "-", "x")], "chrom int, pos long, ref string, alt string, u string, v string")
    assert [r.value for r in writers.vcf_lines(df, ["u", "v"]).collect()] == ["2\t7\t.\tG\tC\t.\t.\tv=x", "17\t9\t.\tA\tT\t.\t.\tu=a.b._c"]
    writers.vcf(df, str(tmp_path / "v"), ["u", "v"])
    assert readers.vcf(spark, str(tmp_path / "v" / "records")).count() == 2


def test_xml_and_json(spark, tmp_path):
    p = tmp_path / "a.xml"
    p.write_text('<R><V ID="01"><Genes><G>X</G><G>Y</G></Genes></V><V ID="2"><Genes><G>Z</G></Genes></V></R>')
    df = readers.xml(spark, str(p), "V", "_ID string, Genes struct<G:array<string>>").select("_ID", F.col("Genes.G").alias("genes"))
    assert [r["_ID"] for r in readers.with_gene(df, "genes", ["Y"]).collect()] == ["01"]
    a = spark.createDataFrame([(1, [("s", "x"), ("reviewed by expert panel", "y")]), (2, [("s", "z")])], "id int, assertions array<struct<status:string,v:string>>")
    assert [(r.id, r.assertion.v) for r in readers.first_reviewed(a, "assertions").collect()] == [(1, "y")]
    o = spark.createDataFrame([(1, ["somatic"]), (2, ["somatic", "germline"])], "id int, o array<string>")
    assert [r.id for r in readers.not_only_somatic(o, "o").collect()] == [2]


def test_coverage_bed_and_checksums(spark, tmp_path):
    cov = spark.createDataFrame([("chr13:5", "1.5", "2"), ("chrX:5", "1", "1"), ("chr13:99", "1", "1")], "locus string, mean string, median_approx string")
    genes = spark.createDataFrame([("13", 1, 10)], "chrom string, start long, end long")
    assert [tuple(r) for r in readers.coverage(cov, genes).collect()] == [("13", 5, 1.5, 2.0)]
    df = spark.createDataFrame([("chr13", 5, 5, "n", "Benign"), ("chr13", 5, 90, "m", "Pathogenic")], "c string, s long, e long, n string, p string")
    short, structural = writers.bed_rows(df, "c", "s", "e", "n", "p", [])
    assert [(r.chromStart, r.name) for r in short.collect()] == [(4, "n")] and [r.name for r in structural.collect()] == ["m"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    assert [tuple(r) for r in writers.checksums(files, ["a.txt"], []).collect()] == [("a.txt", "9dd4e461268c8034f5c8564e155c67a6")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, v long, ts timestamp"
    now = "timestamp '2024-01-01 00:00:00'"
    spark.sql(f"select 'a' k, 1L v, {now} ts union all select 'b', 1L, {now}").write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    run = lambda: upserts.upsert_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "v").awaitTermination()
    run()
    time.sleep(1)
    spark.sql(f"select 'a' k, 2L v, {now} ts").write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(upserts.latest(spark, str(tmp_path / "out"))).select("k", "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 2), ("b", 1)]
