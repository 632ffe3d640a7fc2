import random
import re
import time

from lineagelake.llm import chat_quotes as cq


def normal(t):
    return re.sub(r"\s+", " ", re.sub(r"(?m)^[ \t]*(?:>[ \t]?)+", "", t).lower()).strip(" ")


def plain(rows):
    msgs = sorted({(c, t, role, text or "") for c, t, role, text in rows if c is not None and t is not None}, key=str)
    split = {}
    for k in msgs:
        parts = []
        for line in re.split(r"\r?\n", k[3]):
            marks = re.match(r"^[ \t]*((?:>[ \t]?)*)", line)
            level = marks[1].count(">")
            line = line[marks.end() :] if level else line
            if parts and parts[-1][0] == level:
                parts[-1][1] += "\n" + line
            else:
                parts.append([level, line])
        own = [x for n, x in parts if n == 0]
        quotes = [x for n, x in parts if n]
        content = "\n".join(own)
        split[k] = (own, re.sub(r"\n{3,}", "\n\n", content).strip(" ") if quotes else content, quotes)
    said = {}
    for k, (own, content, _) in split.items():
        for u in {normal(u) for u in [content, *own, *re.split(r"\n[ \t]*\n", content), *content.split("\n")]} - {""}:
            said.setdefault((k[0], u), []).append(k)
    out = {}
    for k, (_, content, quotes) in split.items():
        hits = []
        for q in quotes:
            for forms in ([q], re.split(r"\n[ \t]*\n", q), q.split("\n")):
                met = []
                for n in {normal(x) for x in forms} - {""}:
                    by = said.get((k[0], n), [])
                    if by and min(x[1] for x in by) < k[1]:
                        met.append(min(x[1] for x in by))
                if met:
                    hits.append(max(met))
                    break
        out[k] = [k[2], content, len(quotes), len(hits), max(hits, default=None)]
    turns = {}
    for k, r in out.items():
        turns.setdefault(k[:2], []).append((k, r))
    for k, r in out.items():
        up, depth = k[1], 0
        parent = r[4]
        while parent is not None:
            up, depth = parent, depth + 1
            (above,) = {x[1][4] for x in turns[k[0], up]} if len(turns[k[0], up]) == 1 else {None}
            parent = above
        r += [up, depth]
    return sorted(((k[0], k[1], *r[:7]) for k, r in out.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in cq.conversations(df).drop("variant").collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_quoted_threads_match_brute_force(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for c in range(12):
        told = []
        for t in range(rng.randint(1, 14)):
            body = "\n".join(" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 4)))
            quote = ""
            for _ in range(rng.randint(0, 2) if told else 0):
                src = rng.choice(told)
                every = src.split("\n")
                at = rng.randrange(len(every))
                piece = rng.choice([src, rng.choice(every), "\n".join(every[at : at + 2]), "\n".join([every[at], "words that nobody said"])])
                mark = rng.choice(["> ", ">", "> > ", ">>"])
                quote += "".join(f"{mark}{x}\n" for x in piece.upper().split("\n")) + rng.choice(["", "\n", "aside\n"])
            rows.append((c, t, rng.choice(["user", "assistant"]), quote + body))
            told.append(body)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert got(df) == want
    assert any(r[-1] > 1 for r in want)


def test_edge_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, ""), (None, 2, "user", "x"), (2, None, "user", "x"), (3, 0, "user", "The same long line"), (3, 0, "user", "The same long line"),
        (3, 1, "a", "> the  SAME long line\nyes"), (3, 2, "a", "> not said by anyone\nno"), (3, 3, "a", ">>> yes\n> > The same long line\r\n"), (4, 0, "u", "> later words here"), (4, 1, "u", "later words here"),
        (5, 0, "u", "word " * 30000), (5, 1, "u", "> " + "word " * 30000), *[(6, i, "u", f"> line number {i - 1:05}\n\nline number {i:05}") for i in range(70)], *[(7, i, "u", "hello hello\n> hello hello") for i in range(50)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.selectExpr("*", "1 as parent", "2 as content", "3 as hash")) == plain(rows)
    assert cq.conversations(df.limit(0)).count() == 0


def test_conversations_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_parts_of_messages(spark):
    """Lines, paragraphs and interleaved passages are linked, short ones to whoever said them first."""
    five = "first line here\nsecond line here\nthird line here\nfourth line here\nfifth line here"
    three = "paragraph one is\nof two lines\n\nparagraph two alone\n\nparagraph three last"
    rows = [
        (1, 0, "u", five), (1, 1, "a", "> second line here\n> third line here\nyes"), (2, 0, "u", three), (2, 1, "a", "> paragraph one is\n> of two lines\n>\n> paragraph two alone\nI see"),
        (3, 0, "u", "question that is long"), (3, 1, "a", "answer one is\nthis here\n> question that is long\nanswer two is\nthat there"), (3, 2, "u", "> answer two is\n> that there\nwhy"),
        (4, 0, "u", "Yes."), (4, 1, "a", "> Yes.\nfine"), (5, 0, "u", "Thanks"), (5, 1, "a", "Thanks"), (5, 2, "u", "> Thanks\nwho"), (6, 0, "u", "one version of it"), (6, 0, "u", "another version of it"), (6, 1, "a", "> another version of it\nthat one"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows)
    parents = {(r.conv_id, r.turn): r.parent for r in cq.conversations(df).collect()}
    assert [parents[k] for k in ((1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (5, 2), (6, 1))] == [0, 0, 0, 1, 0, 0, 0]


def test_later_sayings_take_no_link_away(spark):
    """A short quote stays linked if it is said again later, or by the one who quotes it."""
    rows = [(1, 1, "u", "Yes."), (1, 2, "a", "> Yes.\nfine"), (2, 1, "u", "Yes."), (2, 2, "a", "> Yes.\nfine"), (2, 3, "u", "Yes."), (3, 1, "u", "Yes."), (3, 2, "a", "> Yes.\nYes."), (4, 1, "u", "> Yes.\nYes.")]
    found = {(r.conv_id, r.turn): (r.n_linked, r.parent) for r in cq.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[c, 2] for c in (1, 2, 3)] == [(1, 1)] * 3 and found[4, 1] == (0, None)


def test_very_long_message(spark):
    """30,000 lines whose levels change, quoted whole."""
    text = "\n".join(f"{'> ' * (i % 3)}line number {i}" for i in range(30_000))
    df = spark.createDataFrame([(1, 0, "u", text), (1, 1, "a", "> " + text)], SCHEMA)
    began = time.time()
    rows = {r.turn: r for r in cq.conversations(df).collect()}
    assert time.time() - began < 60
    assert rows[0].n_quotes == 20_000 and rows[1].n_quotes > 19_000 and rows[1].parent == 0
