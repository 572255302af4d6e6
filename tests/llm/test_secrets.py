import hashlib
import math
import random
import re
from collections import Counter

from bidlake.llm import secrets as S

PATTERNS = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]
PARTS = [
    "password: token: abcdef", 'PASSWD="hunter22"', "secret=ab", "token = zzz.zz-", "api_key:'A/b+c='", "AKIA" + "Q" * 12, "AKIA" + "Q" * 16, "AKIAAKIA" + "X" * 14, "0123456789abcdef" * 2, "é😀 word", " ", "\n", "x",
    "wJa1rXUtnF3MIK7MDENGbPx9fiCYzQ5vT8kHs2Lo", "qzkvwjxmbyhgfdtrpnlcaeuio", "ZqKvWjXmByHgFdTrPnLcAeUiO", "/sample/", "xxxx", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "EXAMPLEKEY", "some/path/to-a_file", "geschwindigkeitsbegrenzung",
    "ghp_aB3dE5fG7hI9jK1lM2nO4pQ6r", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaa1",
]


def base(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return sorted(out)


def entropy_spans(text):
    for m in re.finditer(S.CANDIDATE, text or ""):
        v = m.group()
        if not re.search(S.SCORED, v) or any(re.search(p, v) for p in S.ALLOW):
            continue
        bits = next(b for _, p, b in S.CLASSES if re.search(p, v))
        ends = {e.start() for e in re.finditer(S.ALLOW_ENDS, v)}
        hot = set()
        for i in range(len(v) - S.WINDOW + 1):
            counts = Counter(v[i : i + S.WINDOW]).values()
            at = range(i, i + S.WINDOW)
            if not ends & set(at) and math.log2(S.WINDOW) - sum(n * math.log2(n) for n in counts) / S.WINDOW >= bits - 1e-6:
                hot |= set(at)
        runs = [k for k in sorted(hot) if k - 1 not in hot]
        for k in runs:
            yield m.start() + k, m.start() + next(e for e in range(k, len(v) + 1) if e not in hot)


def outside(span, base):
    left = [k for k in range(*span) if not any(b[0] <= k < b[2] for b in base)]
    for k in left:
        if k - 1 not in left:
            yield k, 3, next(e for e in range(k, span[1] + 1) if e not in left), "entropy"


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, ""] + [rnd.choice(["", " ", "."]).join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    texts.append(" ".join(f"password=abcdef{i}" for i in range(500)))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, base_spans string")
    for r in S.secret_report(df).collect():
        t = texts[r["doc_id"]]
        own = base(t)
        assert r["base_sha256"] == hashlib.sha256(written(own).encode()).hexdigest()
        kinds = Counter(s[3] for s in own)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        extra = [piece for s in entropy_spans(t) for piece in outside(s, own)]
        assert r["spans"] == written(sorted(own + extra))
    assert S.secret_report(df.limit(0)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = S.secret_report(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=abcdefgh b"), (2, "clean text"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in S.redact(df).collect()}
    assert got == {1: "a [SECRET] b", 2: "clean text", 3: None}


def test_parts_beside_a_base_span_are_reported(spark):
    key = "Zq8KwJa1rXUtnF3MIK7MD"
    text = f"{key}0123456789abcdef01234567{key}"
    row = S.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["spans"] == f"entropy:0:{len(key)},hex:{len(key)}:{len(key) + 24},entropy:{len(key) + 24}:{len(text)}"


def test_random_letters_are_found_and_long_words_are_not(spark):
    df = spark.createDataFrame([(1, "key qzkvwjxmbyhgfdtrpnlcaeuiosw end"), (2, "die geschwindigkeitsbegrenzung und donaudampfschiffahrtsgesellschaft")], "doc_id long, text string")
    assert [r["text"] for r in S.redact(df).sort("doc_id").collect()] == ["key [SECRET] end", "die geschwindigkeitsbegrenzung und donaudampfschiffahrtsgesellschaft"]


def test_redaction_leaves_no_rest_of_a_secret_around_a_base_span(spark):
    key = "wJa1rXUtnF3MIK7MDENGbPx9fiCYzQ5vT8kHs2Lo"
    runs = ["AKIA" + "Q7Z4M1X8B5N2C9V6" + "/" + key, key + "0123456789abcdef01234567" + key]
    df = spark.createDataFrame([(i, f"a {run} b") for i, run in enumerate(runs)], "doc_id long, text string")
    for r in S.redact(df).collect():
        left = r["text"]
        assert left.startswith("a ") and left.endswith(" b") and "[SECRET]" in left
        assert not any(key[i : i + 6] in left for i in range(len(key) - 5))
