import random

import numpy as np
import pytest

from bidlake.operators import fuzzy as Z

WORDS = "company name number registration telephone email address of the bidder vat tax reference postal physical no nr code closing date a b id".split()


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def typo(rnd, key):
    k = rnd.randrange(len(key) + 1)
    return " ".join(rnd.choice([key[:k] + key[k + 1 :], key[:k] + rnd.choice("abcdexyz ") + key[k:], key[:k] + key[k + 1 : k + 2] + key[k : k + 1] + key[k + 2 :]]).split())


def keys_of(rnd, n):
    out = set()
    while len(out) < n:
        key = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 6)))
        for _ in range(rnd.randrange(4)):
            key = typo(rnd, key) or "a"
        if rnd.random() < 0.2:
            key = key[: rnd.randrange(1, len(key) + 1)].strip() or "x"
        out.add(key)
    return sorted(out)


def test_subsequences():
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("abc ") for _ in range(rnd.randrange(90))), "".join(rnd.choice("abc ") for _ in range(rnd.randrange(90)))) for _ in range(400)] + [("", ""), ("a" * 64, "a" * 64), ("a" * 65, "a")]
    many = Z.ratios([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), r in zip(pairs, many, strict=True):
        want = 200 * table_lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert Z.subsequence(a, b) == table_lcs(a, b) and abs(r - want) < 1e-9 and abs(Z.ratio(a, b) - want) < 1e-9


def test_known_scores():
    assert Z.ratio("telephone numbre", "telephone number") == 93.75
    assert Z.weighted("the following", "name of the enterprise") == pytest.approx(85.5) and Z.ratio("the following", "name of the enterprise") < 75
    assert Z.weighted("mail", "email address") == pytest.approx(90) and Z.set_ratio("number of vat", "vat number") == 100


def expected(keys, aliases):
    out = {}
    for key in keys:
        best, echo = {}, False
        for alias, canonical in aliases.items():
            score = Z.weighted(key, alias) if key else 0
            second = max(Z.ratio(key, alias), Z.ratio(Z.sorted_words(key), Z.sorted_words(alias)))
            if score >= 85 and second >= 75:
                best[canonical] = max(best.get(canonical, 0), score)
            echo |= bool(key) and score >= 85 > 0 and second < 75
        ranked = sorted(((-s, c) for c, s in best.items()))
        if not ranked:
            out[key] = (None, None, "low_corroboration" if echo else "unmatched")
        else:
            close = len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 8
            out[key] = (ranked[0][1], round(-ranked[0][0], 6), "ambiguous" if close else "matched")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_look_up_agrees_with_all_pairs(spark, seed):
    rnd = random.Random(seed)
    keys = [*keys_of(rnd, 250), "", "a", "no", "no no name", "fooo foo bar"]
    aliases = {a: f"f{k % 17}" for k, a in enumerate(keys_of(rnd, 70) + ["name", "bar fooo", "e", "registration number of the company that bids"])}
    left = spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "key string")
    right = spark.createDataFrame([(a, c, k) for k, (a, c) in enumerate(aliases.items())] + [("name", "other", 900), (None, "none", 901), ("", "none", 902)], "alias string, canonical string, position int")
    got = {r["key"]: (r["canonical"], None if r["score"] is None else round(r["score"], 6), r["status"]) for r in Z.look_up(left, right).collect()}
    assert got.pop(None) == (None, None, "unmatched")
    want = expected(keys, aliases)
    assert got == want and {s for _, _, s in want.values()} == {"matched", "ambiguous", "low_corroboration", "unmatched"}


def test_plan_has_no_nested_loop_and_few_candidates(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 10)))
    aliases = sorted({f"{name()} {name()} {rnd.choice(WORDS)}" for _ in range(1000)})
    keys = sorted({typo(rnd, rnd.choice(aliases)) for _ in range(3000)})
    left, right = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(a,) for a in aliases], "alias string")
    found = Z.candidates(left, right)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() < 0.2 * len(keys) * len(aliases)
    assert Z.scored(found).where("score >= 85").select("key").distinct().count() > 0.95 * len(keys)


def test_empty(spark):
    keys, none = spark.createDataFrame([("name",), (None,)], "key string"), spark.createDataFrame([], "alias string, canonical string, position int")
    assert {r["status"] for r in Z.look_up(keys, none).collect()} == {"unmatched"}
    assert Z.look_up(keys.limit(0), none).count() == 0
    assert np.isfinite(Z.ratios([], [])).all()
