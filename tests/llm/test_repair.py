import heapq
import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from bidlake.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, kind string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last initial: what may follow


def cheapest(rows):
    """Least (cost, audit, repaired turns) over all edit scripts, by search in order of cost and audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, turns = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, turns
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        heapq.heappush(heap, (cost + 3, audit + "I", k, due[0], (*turns, f"{due}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, turns))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] and role[:1] in PATTERN[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, role[:1], (*turns, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", k + 1, due[0], (*turns, f"{due}:{text}")))
    raise AssertionError


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            show = lambda x: " " if x is None else str(x)
            hit = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            role, text = show(role), show(text)
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
            rows += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            solid = WORD.findall(text)
            judged.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, repaired = cheapest(judged)
        count = lambda f: sum(j[2] == f for j in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha256("\n".join(repaired).encode()).hexdigest())
    return out


def check(df, **options):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = R.repair_report(df, **options).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_given_conversations(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


@pytest.mark.parametrize("size", [5, 16_384])
def test_random_conversations(spark, size):
    rnd = random.Random(size)
    texts = ["Hello there.", "so?", "no end", "", " \t", None, "Yes!", "Ünd.", "a. b", "x!\n", *[f"text {k}." for k in range(20)]]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "ua"]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(roles[:3] if rnd.random() < 0.8 else roles), rnd.choice(texts), "k") for c in [None, *range(60)] for _ in range(rnd.randrange(1, 14))]
    rows += [(100, k // 2, ("user", "assistant")[k % 2], f"t{k % 40}.", "k") for k in range(300)]
    rows += [(101, 3, "user", "again.", "k")] * 40 + [(102, 1, "user", "same.", "k"), (102, 1, "user", "same.", "k"), (103, None, None, None, None)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark.createDataFrame([*rows, (dropped, 0, "user", "gone", "k")], SCHEMA), slice_rows=size)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(df).count() == 0


def test_every_block_agrees_with_its_steps():
    t = R.tables()
    rnd = random.Random(1)
    for _ in range(3000):
        vector, symbols = rnd.randrange(len(t.vectors)), bytes(rnd.randrange(9) for _ in range(R.BLOCK))
        code = sum(s * 9 ** (R.BLOCK - 1 - k) for k, s in enumerate(symbols))
        at, off = vector, 0
        for s in symbols[::-1]:
            off += int(t.step[1][at, s])
            at = int(t.step[0][at, s])
        assert (at, off) == (int(t.block[0][vector, code]), int(t.block[1][vector, code]))
    assert len(t.vectors) < 400


def test_ties_take_the_least_audit():
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "truncated")] + [("user", "blank")]
    codes = {k: R.GONE if k[1] == "blank" else 2 * "suat".index(k[0][0]) + (k[1] == "truncated") for k in kinds}
    for rows in product(kinds, repeat=4):
        symbols = bytes(codes[r] for r in rows)
        audit, state = R.trace(symbols, 0, R.START)
        at, total = R.tables().back(0, symbols)
        want = cheapest([(role, "x", fault) for role, fault in rows])
        assert (R.tables().vectors[at[-1]][R.START] + total, audit + R.ending(state)) == want[:2]
