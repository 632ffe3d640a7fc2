import gzip

from lineagelake.operators import truth


def test_read_tables_of_three_dialects(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "superkingdom"), (10, 2, "genus"), (11, 10, "species"), (12, 11, "strain"), (20, 1, "no rank")], "id long, parent long, rank string")
    merged = spark.createDataFrame([(99, 12), (11, 20)], "old long, new long")
    ranked = truth.rank_ids(nodes, merged)
    got = {r.taxid: (r.superkingdom, r.phylum, r.genus, r.species) for r in ranked.collect()}
    assert got[12] == (2, 0, 10, 11) and got[99] == got[12] and got[11] == (2, 0, 10, 11) and got[20] == (0, 0, 0, 0) and len(got) == 7
    with gzip.open(tmp_path / "cami.gz", "wt") as f:
        f.write("@v\n@s\n\n@@A\tB\tC\nr1\tx\t12\nr2\tx\t99\nr3\tx\tnone\n")
    reads = truth.read_table(spark, str(tmp_path / "cami.gz"), "CAMI")
    rows = {r.read: (r.superkingdom, r.species) for r in truth.truth(reads, ranked).collect()}
    assert rows == {"r1": ("2", "11"), "r2": ("2", "11"), "r3": ("0", "0")}
    (tmp_path / "kegg").write_text("head\nq\teco:b1\nq\tzzz:1\n")
    (tmp_path / "ncbi").write_text("head\nq\tNC_1.2\n")
    codes = spark.createDataFrame([("eco", 11), ("NC_1", 10)], "code string, taxid long")
    assert {(r.read, r.taxid) for r in truth.read_table(spark, str(tmp_path / "kegg"), "KEGG", codes).collect()} == {("eco:b1", 11), ("zzz:1", None)}
    assert [tuple(r) for r in truth.read_table(spark, str(tmp_path / "ncbi"), "NCBI", codes).collect()] == [("NC_1.2", 10)]


def test_votes_to_scores(spark):
    ranked = spark.createDataFrame([(5, 1, 3, 5), (6, 1, 3, 6), (7, 2, 4, 7)], "taxid long, superkingdom long, genus long, species long")
    members = spark.createDataFrame([(1, 1, 1, 5, True), (2, 1, 2, 6, False), (3, 3, 3, 7, True)], "tax_id long, grp long, unit long, taxid long, formal boolean")
    assigned = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (2, 2, 0.9, 6.0, 0.0), (3, 3, 1.0, 0.0, 12.0), (4, -1, 1.0, 0.0, 0.0)], "read_id long, tax_id long, prop double, dist double, mean_dist double")
    ranks = ("superkingdom", "genus", "species")
    guess = truth.predicted(assigned, members, ranked, ranks)
    got = {r.read: tuple(r)[1:] for r in guess.select("read", *ranks).collect()}
    # Group 1 votes for its formal species alone; far hits lose species, then genus.
    assert got == {1: ("1", "3", "5"), 2: ("1", "3", "0"), 3: ("2", "0", "0")}
    truths = spark.createDataFrame([(1, "1", "3", "5"), (2, "1", "3", "6"), (3, "1", "3", "0"), (9, "1", "3", "5")], "read long, superkingdom string, genus string, species string")
    rows = {r["rank"]: (r.n_true, r.n_false_positive, r.n_false_negative, r.n_both_unknown) for r in truth.rank_scores(truths, guess, ranks).collect()}
    assert rows == {"superkingdom": (2, 1, 1, 0), "genus": (2, 0, 1, 0), "species": (1, 0, 1, 1)}
