import gzip

import pytest

from lineagelake.operators import mixture, profile
from lineagelake.sources import readers, writers
from lineagelake.streaming import incremental


def test_list(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("comment line\n# acc\tftp_path\tgenome_rep\nG1.2\tna\tFull\nG2.1\tx/y\tFull\n")
    rows = readers.genome_list(spark, str(tmp_path / "l.tsv")).orderBy("acc").collect()
    assert [tuple(r) for r in rows] == [("G1.2", None, "Full"), ("G2.1", "x/y", "Full")]
    assert readers.genome_list(spark, str(tmp_path / "l.tsv"), blank="").where("ftp_path = ''").count() == 1


def test_reads(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("".join(f"@r{i} extra\nACGT{'A' * i}\n+\nHHHH{'H' * i}\n" for i in range(50)))
    rows = readers.fastq(spark, str(tmp_path / "a.fastq.gz")).orderBy("read_id").collect()
    assert len(rows) == 50 and all(r.read_id == i and r.read_name == f"r{i}" and r.seq == "ACGT" + "A" * i for i, r in enumerate(rows))
    (tmp_path / "a.fa").write_text(">s1 x\nACG\nT\n>s2\nGG\n")
    rows = readers.fasta(spark, str(tmp_path / "a.fa")).orderBy("read_id").collect()
    assert [(r.read_name, r.seq, r.qual) for r in rows] == [("s1", "ACGT", "HHHH"), ("s2", "GG", "HH")]
    assert [r.seq_name for r in readers.fasta_names(spark, str(tmp_path / "a.fa")).collect()] == ["s1", "s2"]


def test_sam(spark, tmp_path):
    line = "\t".join(["3", "128", "s1|tax|9", "7", "60", "10M", "*", "0", "0", "ACGTACGTAC", "*", "NM:i:0", "ms:i:20", "AS:i:20", "AS:i:18"])
    (tmp_path / "a.sam").write_text("@SQ\tSN:s1|tax|9\tLN:500\n" + line + "\n")
    rows, head = readers.sam(spark, str(tmp_path / "a.sam"), "short")
    r = rows.first()
    assert (r.read_id, r.mate, r.ref, r.pos, r.score) == (3, 2, "s1|tax|9", 7, 20.0) and tuple(head.first()) == ("s1|tax|9", 500)
    rows, head = readers.sam(spark, str(tmp_path / "a.sam"), "long")
    assert rows.first().ref == "s1" and rows.first().score == 18.0 and head.first().ref == "s1"


def test_taxonomy(spark, tmp_path):
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n")
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    assert tuple(readers.taxonomy_names(spark, str(tmp_path / "names.dmp")).first()) == (1, "root", "scientific name")
    assert sorted(tuple(r) for r in readers.taxonomy_nodes(spark, str(tmp_path / "nodes.dmp")).collect()) == [(1, 1, "no rank"), (2, 1, "genus")]


def test_assignment_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(0, "a"), (1, "b")], "read_id long, read_name string")
    hits = spark.createDataFrame([(0, 5, 0.75, 1.0, 2.0, 0.5, 0.25), (0, 7, 0.25, 3.0, 4.0, 0.5, 0.25)], "read_id long, tax_id long, prop double, dist double, mean_dist double, depth_w double, core_w double")
    writers.assignments(reads, hits, str(tmp_path / "out"))
    rows = {r.read_id: r for r in readers.assignments(spark, str(tmp_path / "out")).collect()}
    assert rows[1].hits == [] and rows[1].depth_w is None and [tuple(h) for h in rows[0].hits] == [(5, 0.75, 1.0, 2.0), (7, 0.25, 3.0, 4.0)]
    assert [r.read_id for r in mixture.specific_reads(hits, [5]).collect()] == [0] and mixture.specific_reads(hits, [7]).count() == 0


def test_profiles_and_report(spark, tmp_path):
    for s, p in (("one", 40.0), ("two", 0.1)):
        (tmp_path / s).mkdir()
        (tmp_path / s / "profile.txt").write_text(f"Total\t100\t80.0\nUnmatched\t20.000\t0.000\nUncertain_match\t5.000\t6.250\ns1\t{p * .8:.4f}\t{p:.4f}\tA|B (3,4)\n")
    found = readers.profiles(spark, str(tmp_path))
    rows = {r.grp: r for r in profile.report(found, ["one", "two"], "s", low=1.0).collect()}
    assert rows["s1"].one == pytest.approx(32.0) and rows["s1"].two == 0 and rows["Unknown"].one == pytest.approx(68.0) and rows["Unknown"].two == pytest.approx(100.0)
    assert found.where("taxon = 'A|B'").count() == 2
    (tmp_path / "r.tsv").write_text("^A\tlab\nB\t\n")
    assert readers.rules(spark, str(tmp_path / "r.tsv")) == [("^A", "lab"), ("B", "*")]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "cat")
    for rows in ([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(src)
        incremental.start(spark, src, "id long, text string", out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 5]
    assert tuple(incremental.summary(spark, out).first()) == (3, 3)


def test_writers_and_their_readers(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, None)], "index long, name string, deleted string")
    assert writers.catalog(rows, at("c")) == 1
    assert sorted(r["index"] for r in readers.catalog(spark, at("c")).collect()) == [1, 3]
    assert readers.catalog(spark, at("c"), include_deleted=True).count() == 3
    assert writers.catalog(rows.where("index = 1"), at("c"), after=1) == 2 and readers.catalog(spark, at("c")).count() == 1 and readers.catalog(spark, at("c"), 1).count() == 2

    members = spark.createDataFrame([("db", 0, 1), ("db", 1, 2)], "mapdb string, shard int, tax_id long")
    seqs = spark.createDataFrame([("db", 0, "s1", 1), ("db", 1, "s2", 2)], "mapdb string, shard int, seq_name string, tax_id long")
    writers.mapping(members, seqs, at("m"))
    writers.mapping(members.withColumn("shard", members.shard + 2), seqs.withColumn("shard", seqs.shard + 2), at("m"), append=True)
    m, s = readers.mapping(spark, at("m"))
    assert sorted(r.shard for r in m.collect()) == [0, 1, 2, 3] and s.where("shard = 3").first().seq_name == "s2"

    writers.tsv(rows, at("t"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(at("t")).orderBy("index").collect()] == [("1", "a", None), ("2", "b", "x"), ("3", None, None)]
    writers.sketches(spark.createDataFrame([(1, "virus"), (2, "large")], "key long, bucket string"), at("s"))
    writers.sketches(spark.createDataFrame([(3, "virus")], "key long, bucket string"), at("s"))
    assert spark.read.parquet(at("s")).where("bucket = 'virus'").count() == 2
    writers.hits(spark.range(5), at("h"))
    assert spark.read.parquet(at("h")).count() == 5
    reads = spark.createDataFrame([(0, "r0", "ACGT", "HHHH"), (1, "r1", "AC", "HH")], "read_id long, read_name string, seq string, qual string")
    writers.fastq(reads, spark.createDataFrame([(1, 9)], "read_id long, first_tax long"), at("f"))
    assert [r.value for r in spark.read.text(at("f")).collect()] == ["@r1 1 9", "AC", "+", "HH"]
    writers.json_lines(rows.where("index = 2"), at("j"))
    assert spark.read.text(at("j")).first().value == '{"deleted":"x","index":2,"name":"b"}'


def test_fasta_is_numbered_over_partitions(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{i} x\nAC{'G' * (i % 7)}\nT\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.fasta(spark, str(tmp_path / "a.fa"))
        assert df.rdd.getNumPartitions() > 1
        rows = df.orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.read_id, r.read_name, r.seq) for r in rows] == [(i, f"s{i}", f"AC{'G' * (i % 7)}T") for i in range(3000)]
