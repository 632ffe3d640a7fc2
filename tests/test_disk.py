from lineagelake.operators import alignment


def test_hits_are_stored_once_and_narrow(spark, monkeypatch):
    """Scored hits are written once; the levels of an address are kept by reference, not by hit."""
    written, kept = [], alignment.stored

    def watched(df):
        out = kept(df)
        written.append((len(df.columns), out.count()))
        return out

    monkeypatch.setattr(alignment, "stored", watched)
    hits = spark.createDataFrame([(r, t, t * 4, 10, 1.0, 99.0, 1) for r in range(200) for t in range(r % 4, 8)], "read_id long, tax_id long, seq_id long, site long, mut double, nom double, ord long")
    info = spark.createDataFrame([(t * 4, 5000, t) for t in range(8)], "seq_id long, seq_len long, tax_id long")
    addresses = spark.createDataFrame([(t, t % 2, t % 4, *[t] * 7) for t in range(8)], "tax_id long, u long, s long, r long, p long, n long, m long, e long, c long, a long")
    assert alignment.weigh(hits, info, addresses).count() >= 0
    assert sorted(n for _, n in written) == [8, hits.count()]
