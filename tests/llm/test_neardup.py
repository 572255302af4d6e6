import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import neardup as N
from tests.oracle import assert_same, connect


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(N.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), N.NearDup(3, 85)), connect(sf), N.ORACLE_SQL)


def sets(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, width, percent):
    s = {i: sets(t, width) for i, t in docs}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_edited_copies_and_edges(spark, width, percent):
    rnd = random.Random(width)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two ", "É é", "É\x0bé"]
    hub = [word() for _ in range(120)]
    texts.append(" ".join(hub))
    for k in range(60):
        copy = list(hub)
        for _ in range(k % 8):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    shared = [word() for _ in range(40)]
    texts += [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, N.NearDup(width, percent)).collect()}
    assert got == components(docs, width, percent)
    kept = {r["doc_id"] for r in N.keep_one_of_each(df, N.NearDup(width, percent)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_repeated_and_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    rows = N.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("1", "1", True), ("1", "1", True), ("None", "None", False)]
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.keep_one_of_each(df).count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (8, 60, 900):
        near = []
        for _ in range(30):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            b = a.copy()
            b[: size // 8] = rng.integers(0, 2**63, size // 8, dtype=np.uint64)
            near.append((N.signature(np.unique(a), 240) == N.signature(np.unique(b), 240)).mean())
        true = (size - size // 8) / (size + size // 8)
        assert abs(np.mean(near) - true) < 0.05


def by_matrix(docs, width, percent):
    """Component of each document, from the common shingles of all pairs."""
    own = {i: sets(t, width) for i, t in docs}
    holders = {}
    for i, s in own.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    several = [h for h in holders.values() if len(h) > 1]
    hot = np.zeros((len(docs), len(several)), np.float32)
    for k, h in enumerate(several):
        hot[h, k] = 1
    size = np.array([len(own[i]) for i, _ in docs])
    common = hot @ hot.T
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size - common), 1)), strict=True):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i, _ in docs}


def found(spark, docs, width, percent):
    return {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), N.NearDup(width, percent)).collect()}


def test_near_pairs_among_texts_of_a_common_pool(spark):
    """No text has words of its own, so that buckets are full of strangers and a near pair is rarely at a centre."""
    rnd = random.Random(7)
    pool = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(40)]
    texts = [set(rnd.sample(range(40), 32)) for _ in range(2000)]
    for own in texts[::20]:
        texts.append(own - set(rnd.sample(sorted(own), 1)) | {rnd.choice([p for p in range(40) if p not in own])})
    docs = [(i, " ".join(pool[p] for p in sorted(own))) for i, own in enumerate(texts)]
    want = by_matrix(docs, 3, 85)
    assert sum(i != c for i, c in want.items()) >= 90
    got = found(spark, docs, 3, 85)
    assert {i: c for i, c in got.items() if want[i] != c} == {}


@pytest.mark.parametrize(("width", "percent", "changed", "count", "seed"), [(3, 85, 9, 300, 1), (3, 85, 9, 2000, 3), (5, 80, 8, 300, 4)])
def test_copies_of_a_hub_that_is_not_there(spark, width, percent, changed, count, seed):
    """All pairs are near the threshold, and no text is in the middle of the others."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    hub, docs = [word() for _ in range(600)], []
    for i in range(count):
        copy = list(hub)
        for k in rnd.sample(range(600), changed):
            copy[k] = word()
        docs.append((i, " ".join(copy)))
    want = by_matrix(docs, width, percent)
    got = found(spark, docs, width, percent)
    assert {i: c for i, c in got.items() if want[i] != c} == {}


def test_cells_of_a_bucket_meet_all_members(spark, monkeypatch):
    """A bucket cut into many cells, where each member is linked to the next one only."""
    monkeypatch.setattr(N, "CELL", 300)
    names = [bytes([k]) for k in range(40)]
    members = spark.createDataFrame([(1, n, 100) for n in names] + [(2, n, 100) for n in names[:2]], "key long, node binary, size long")
    linked = spark.createDataFrame([(n, names[0]) for n in names[:15]], "node binary, component binary")
    shingles = spark.createDataFrame([(n, list(range(7 * k, 7 * k + 100))) for k, n in enumerate(names)], "node binary, set array<long>")
    assert N._cells(members, linked, shingles).select("cell").distinct().count() > 5
    edges = [(bytes(r["u"])[0], bytes(r["v"])[0]) for r in N._bucket_links(members, linked, shingles, 80).collect()]
    assert {tuple(sorted(e)) for e in edges} == {(k, k + 1) for k in range(14, 39)}


def test_rows_that_repeat_an_id_are_judged_by_their_text(spark):
    text = " ".join(f"w{k}" for k in range(50))
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text + " x"), (2, other), (2, other), (3, None), (3, None), (None, text)]
    kept = N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), N.NearDup(5, 80)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, [(1, text), (2, other), (3, None), (3, None), (None, text)]))


def test_no_cell_holds_more_than_two_blocks(spark):
    """A bucket of 20,000 strangers: each cell has a bounded part of it, and each two of them meet in a cell."""
    n, size, cell = 20_000, 50, 50_000
    nodes = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.encode(F.col("id").cast("string"), "utf-8").alias("node"), F.lit(size).cast("long").alias("size"))
    none = spark.createDataFrame([], "node binary, component binary")
    sets = nodes.select("node", F.array(F.xxhash64("node")).alias("set"))
    cells = N._cells(nodes, none, sets, cell).groupBy("cell").agg(F.count_if("minor").alias("minor"), F.count_if("resident").alias("resident")).collect()
    assert len(cells) == 20 * 20 and max(max(r["minor"], r["resident"]) for r in cells) * size < 1.3 * cell
    assert sum(r["minor"] * r["resident"] for r in cells) == n * (n - 1)
    one = nodes.limit(40).select("node", F.lit(b"0").alias("component"))
    few = N._cells(nodes.limit(60).repartition(2), one, sets, cell).collect()
    assert {bytes(r["node"]) for r in few if r["minor"]} == {bytes(r["node"]) for r in nodes.limit(60).collect()} - {bytes(r["node"]) for r in one.collect()}


def test_few_whole_texts_meet_the_copies_in_a_join(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(f"w{rnd.randrange(9999)}" for _ in range(30))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1] + " x") for k in range(40)] + [(None, rows[7][1]), (9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = N.keep_one_of_each(docs, N.NearDup(5, 80))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id < 5000 or doc_id = 9000").collect()))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftAnti")
    assert "hit(" in plan[join:]  # texts are told apart before the join
    keys = docs.where("doc_id between 5000 and 8999").select("doc_id", F.xxhash64("text").alias("_copy"))
    marked = docs.withColumn("_copy", F.xxhash64("text"))
    maybe = marked.where(N._may_be_in(marked, keys))
    assert maybe.join(keys, ["doc_id", "_copy"], "left_semi").count() == 40 and maybe.count() < 140
