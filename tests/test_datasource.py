import gzip
import random

import pytest

from lineagelake.functions import sql
from lineagelake.sources import datasource


def fastq(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"r{i}", "".join(rng.choices("ACGT", k=rng.randint(1, 60)))) for i in range(n)]
    # Qualities that begin like names and separators.
    quals = ["".join(rng.choices("@+!IH", k=len(s))) for _, s in rows]
    return rows, "".join(f"@{n} x y\n{s}\n+{n if i % 3 else ''}\n{q}\n" for i, ((n, s), q) in enumerate(zip(rows, quals))), quals


@pytest.mark.parametrize("split", [61, 400, 1 << 20])
def test_fastq_by_ranges(spark, tmp_path, split):
    datasource.register(spark)
    rows, text, quals = fastq(50)
    (tmp_path / "a.fastq").write_text(text)
    df = datasource.numbered(spark.read.format("reads").option("splitBytes", split).load(str(tmp_path / "a.fastq")))
    got = [(r.read_name, r.seq, r.qual) for r in df.orderBy("read_id").collect()]
    assert got == [(n, s, q) for (n, s), q in zip(rows, quals)]
    assert [r.read_id for r in df.select("read_id").orderBy("read_id").collect()] == list(range(50))


def test_folder_with_gzip_and_fasta(spark, tmp_path):
    datasource.register(spark)
    rows, text, _ = fastq(40)
    (tmp_path / "d/e").mkdir(parents=True)
    with gzip.open(tmp_path / "d/a.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "d/e/b.fa").write_text(">s1 one\nACG\r\nT T\n\n>s2\n>s3\nGG\n")
    (tmp_path / "d/.hidden").write_text("@x\n")
    (tmp_path / "d/empty.fastq").write_text("")
    for split in (9, 1000):
        df = datasource.numbered(spark.read.format("reads").option("splitBytes", split).load(str(tmp_path / "d")))
        got = [(r.read_name, r.seq, r.qual) for r in df.orderBy("read_id").collect()]
        assert [x[:2] for x in got[:40]] == rows and got[40:] == [("s1", "ACGTT", "HHHHH"), ("s2", "", ""), ("s3", "GG", "HH")]
    with pytest.raises(Exception, match="nothing-there"):
        spark.read.format("reads").load(str(tmp_path / "nothing-there")).count()


def test_sam_by_ranges(spark, tmp_path):
    datasource.register(spark)
    line = lambda i, tags: "\t".join([str(i), "0", "s1|tax|9", str(i), "60", "10M", "*", "0", "0", "ACGT", "*", *tags])
    text = "@SQ\tSN:s1|tax|9\tLN:500\n" + "".join(line(i, ["a:i:1", "b:i:2", f"AS:i:{i}", f"XX:i:{-i}"]) + "\n" for i in range(100)) + line(100, ["a"]) + "\n"
    (tmp_path / "a.sam").write_text(text)
    for split in (500, 8000):
        df = spark.read.format("sam").option("splitBytes", split).load(str(tmp_path / "a.sam"))
        rows = datasource.numbered(df.where("line is null"), "ord").orderBy("pos").collect()
        assert [(r.read_id, r.pos, r.score, r.ref) for r in rows[:3]] == [("0", 0, 0.0, "s1|tax|9"), ("1", 1, 1.0, "s1|tax|9"), ("2", 2, 2.0, "s1|tax|9")]
        assert len(rows) == 101 and rows[100].score is None and df.where("line is not null").count() == 1
    long = spark.read.format("sam").option("dialect", "long").load(str(tmp_path / "a.sam")).where("pos = 7").first()
    assert long.ref == "s1" and long.score == -7.0


def test_stream_of_files(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()
    held = str(tmp_path / "out")

    def run():
        q = spark.readStream.format("reads").option("path", str(tmp_path / "in")).load().writeStream.format("parquet").option("path", held).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    (tmp_path / "in/a.fa").write_text(">a\nAC\n>b\nG\n")
    run()
    (tmp_path / "in/b.fa").write_text(">c\nAC\n")
    run()
    run()
    assert sorted(r.read_name for r in spark.read.parquet(held).collect()) == ["a", "b", "c"]


def test_sql_functions(spark):
    sql.register(spark)
    sql.register(spark)
    r = spark.sql("SELECT barcode_parse('u1.s2.r3.p4.n5.m6.e7.c8.a9') AS x, barcode_parse('u1.s2') AS y, barcode_prefix('u1.s2.r3', 's') AS p, barcode_prefix('u1.s2', 'z') AS q, mash_distance(array(1L, 2L), array(1L, 2L), 21, 10) AS d, mash_distance(array(1L), array(2L), 21, 10) AS e, mash_overlap(array(1L, 2L, 3L), array(2L, 3L, 4L), 2) AS j").first()
    assert r.x.r == 3 and r.x.a == 9 and r.y is None and r.p == "u1.s2" and r.q is None and r.d == 0 and r.e == 1 and r.j == 0.5
    rows = spark.sql("SELECT t, i, h FROM VALUES ('ACGTA'), ('AC'), (NULL) AS v(t), LATERAL kmers(v.t, 3, true)").collect()
    assert [x.i for x in rows] == [0, 1, 2] and rows[0].h == rows[1].h
