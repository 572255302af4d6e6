import random
from hashlib import sha256

import numpy as np

from bidlake.llm import recompress as R
from tests.oracle import assert_same, connect


def expected(rows):
    """(doc_id, n_words, n_removed, digest) of each row, by looking up every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(w) - len(kept), sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    assert sorted(map(tuple, R.dedup_report(df).collect()), key=str) == expected(rows)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(R.dedup_report(spark.read.parquet(f"{sf}/documents.parquet")), connect(sf), R.ORACLE_SQL)


def test_passages_runs_and_edges(spark):
    rnd = random.Random(2)
    vocab = ["a", "b", "é", "the", *(f"word{k}" for k in range(300))]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [make(n) for n in (12, 13, 14, 20, 60, 400)] + [["a"] * 30, ["a", "b"] * 20, ["a"] * 6 + ["b"] * 6 + ["word1"]]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += make(rnd.randrange(30)) + rnd.choice(passages)
        if rnd.random() < 0.3 and len(parts) > 30:
            parts[rnd.randrange(len(parts))] = "changed"
        rows.append((i * 3, rnd.choice([" ", "\n", "\t \r"]).join(parts + make(rnd.randrange(20)))))
    rows += [(1000 + k, rows[5][1]) for k in range(20)] + [(5, rows[5][1]), (5, rows[6][1]), (5, rows[6][1]), (None, rows[5][1]), (2000, None), (2001, ""), (2002, "  x  ")]
    rows += [(3000, "a " * 500), (3001, "a " * 13), (3002, "a " * 12), (2999, "b " * 40), (4000, "  ".join(passages[5] * 3))]
    check(spark, rows)


def test_few_words_that_repeat_everywhere(spark):
    rnd = random.Random(9)
    check(spark, [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(200)))) for i in range(150)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.dedup_report(df).count() == 0
    check(spark, [(1, "one two")])


def test_equal_windows_have_equal_anchors_wherever_they_are():
    rnd = random.Random(4)
    for vocab in ("abc", [f"w{k}" for k in range(50)], "a"):
        for _ in range(200):
            window = [rnd.choice(vocab).encode() for _ in range(13)]
            around = lambda: [rnd.choice(vocab).encode() for _ in range(rnd.randrange(20))]  # noqa: E731, B023
            a, b, c, d = around(), around(), around(), around()
            chunk = R.Chunk([a + window + b, c + window + d])
            found = chunk.anchors()
            assert found[chunk.window == len(a)][0] == found[chunk.window == chunk.first[1] + len(c)][0]
            one, two = chunk.digests.of(np.array([len(a), chunk.first[1] + len(c)]), np.array([len(a) + 13, chunk.first[1] + len(c) + 13]))
            assert one[0] == one[1] and two[0] == two[1]


def test_high_symbols_of_a_long_passage_are_shared():
    rnd = random.Random(6)
    make = lambda n: [f"w{rnd.randrange(1000)}".encode() for _ in range(n)]
    passage = make(600)
    chunk = R.Chunk([make(37) + passage + make(50), make(11) + passage + make(3)])
    doc, start, end = chunk.spans()
    one = chunk.digests.of(start, end)[0]
    shared = np.isin(one[doc == 0], one[doc == 1])
    covered = np.zeros(len(chunk.codes), bool)
    for s, e in zip(start[doc == 0][shared], end[doc == 0][shared], strict=True):
        covered[s:e] = True
    assert covered[37 : 37 + 600].mean() > 0.5 and not covered[:37].any()
