import random
import re

import xxhash

from lineagelake.llm import graph, jaccard, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def got(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


def expected(rows):
    fps = [plain_fp(t) for _, t in rows]
    return sorted(zip([i for i, _ in rows], fps, plain_components([i for i, _ in rows], fps)), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == expected(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A B C d"), (None, "one"), (None, "lonely words here now"), (9, "x " * 9000), (9, "x " * 9000), (8, "É é \x85 \xa0 q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as u", "3 as component_id")
    assert got(simhash.near_duplicates(df)) == expected(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Dense clouds and blocks smaller than a hot segment's entries: same classes as all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(x - (x >> 63 << 64) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for pieces in (2, 3, 4):
        edges = simhash.links(df, 4, pieces)
        rows = edges.collect()
        assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4 for r in rows)
        root = {r.node: r.root for r in graph.components(edges).collect()}
        want = plain_components(fps, [x & (1 << 64) - 1 for x in fps])
        groups = {}
        for x, w in zip(fps, want):
            groups.setdefault(w, set()).add(root.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in graph.components(df).collect()}
    assert found == {i: 0 for i in range(1, 101)} | {501: 500}
    assert graph.components(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """No group is lost and none stays twice, whatever ids its rows have."""
    zeta, alpha, beta = ("zeta eta theta iota kappa lamda", "alpha beta gamma delta epsilon", "one two three four five six")
    rows = [(5, zeta, "a"), (5, alpha, "b"), (3, alpha, "c"), (5, beta, "d"), (5, beta, "d"), (7, zeta, "e"), (None, beta, "f"), (None, "nine ten eleven twelve", None), (None, "nine ten eleven twelve", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").selectExpr("*", "1 as row", "2 as root", "3 as text_hash", "4 as fp")
    for keep in (simhash.keep_one, jaccard.keep_one):
        got = sorted(((r.doc_id, r.text, r._key) for r in keep(df).collect()), key=str)
        assert got == sorted([(3, alpha, "c"), (5, zeta, "a"), (5, beta, "d"), (None, "nine ten eleven twelve", None)], key=str)
        assert keep(df).columns == df.columns and keep(df.limit(0)).count() == 0
