"""Secret scans in native column expressions: no shuffle, no Python, one row in and one row out.

Base kinds are regular expressions. The method adds kind ``entropy``: over candidate strings of secret-like
characters a window slides by one character, its Shannon entropy kept by the counts of the character that
enters and the one that leaves; each run of windows at or above the threshold of the candidate's character
class marks its characters. A candidate is scored if it has letters and digits, or letters alone; letters
with separators and no digit are taken for paths and names. Whole candidates on the allow-list are left
out, and so are windows that hold an allow-listed word. Of an entropy span only the parts outside the base
spans are reported, so base and entropy spans together cover it and no rest of it stays when masked.

Positions are code points, end exclusive. Defined results: a null text counts as empty, an empty text has
no spans; repeated rows are scanned each on its own; other columns pass through; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, pattern, and the group whose length counts, at least.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# The same maximal runs, found without listing the short ones: a run that is long enough is one match either way.
LONG_RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character classes from narrow to wide, and the bits of entropy from which a window of them is marked.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("one case", r"^(?:[a-z]+|[A-Z]+)$", 3.7),
    ("letters", r"^[A-Za-z]+$", 4.0),
    ("alnum", r"^[A-Za-z0-9]+$", 3.75),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9),
)
SCORED = r"^(?:[A-Za-z]+|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]).*)$"
# Whole candidates: uuids, lower-case paths and slugs, short placeholders.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[/_=-]*[a-z]+([/_=-]+[a-z]*[0-9]{0,12})+$",
    r"(?i)^.{0,57}(example|sample|dummy|changeme)(key)?$",
)
# Words that no marked window holds; a match is the last character of the word.
ALLOW_ENDS = r"(?i)(?<=exampl)e|(?<=sampl)e|(?<=dumm)y|(?<=placeholde)r|(?<=changem)e|(?<=xxx)x|(?<=000000)0"
BREAK = "~"
SCALE = 1 << 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sums of an array of longs, by sums of blocks: n items cost n * (block + n / block^2)."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    whole = lambda n: F.floor(n / block).cast("int")

    def sums(items: Column) -> Column:
        count = whole(F.size(items)) + 1
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(items, b * block + 1, F.lit(block))))
        return let(
            let(blocks, lambda own: F.transform(own, lambda _, b: total(F.slice(own, F.lit(1), b)))),
            lambda before: F.transform(items, lambda _, i: before[whole(i)] + total(F.slice(items, whole(i) * block + 1, i % block))),
        )

    return let(lengths, sums)


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches whose group is long enough."""
    as_long = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def build(whole: Column) -> Column:
        gaps = as_long(F.split(text, pattern, -1))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        sizes = as_long(whole)
        # Before match i lie gaps 0..i and matches 0..i-1.
        before = F.zip_with(running(gaps), gaps, lambda a, b: a + b)
        starts = F.zip_with(before, running(sizes), lambda a, b: a + b)
        ends = F.zip_with(starts, sizes, lambda a, b: a + b)
        rows = F.arrays_zip(starts.alias("s"), ends.alias("e"), value.alias("v"))
        return F.transform(rows, lambda r: F.struct(r["s"].alias("start"), r["e"].alias("end"), r["v"].alias("value")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)
    found = F.filter(found, lambda r: r["end"].isNotNull() & (F.length(r["value"]) >= least))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def hot_runs(candidate: Column, threshold: Column) -> Column:
    """``array<struct<start, end>>``: where windows at or above the threshold lie, those that touch as one.

    The sum of n log2 n over the counts of a window changes by the count of the character that leaves and
    that of the one that enters, in whole units so that adding and removing cancel exactly.
    """
    weight = [round(n * math.log2(n) * SCALE) if n else 0 for n in range(WINDOW + 1)]
    gain = F.array(*[F.lit(weight[n + 1] - weight[n]).cast("long") for n in range(WINDOW)])
    most = round(math.log2(WINDOW) * WINDOW * SCALE)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def same(codes: Column, start: Column, length: Column, c: Column) -> Column:
        return F.size(F.filter(F.slice(codes, start, length), lambda x: x == c))

    def counted(codes: Column) -> Column:
        before = F.transform(codes, lambda c, i: same(codes, F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i, F.lit(WINDOW - 1)), c))
        after = F.transform(codes, lambda c, i: same(codes, i + 2, F.lit(WINDOW - 1), c))
        return F.struct(codes.alias("codes"), before.alias("before"), after.alias("after"))

    def fold(x: Column, limit: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("broken"), none.alias("runs"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

        def step(s: Column, i: Column) -> Column:
            leaves = F.when(i >= WINDOW, gain[x["after"][F.greatest(i - WINDOW, F.lit(0))]]).otherwise(F.lit(0).cast("long"))
            moved = F.struct((s["sum"] - leaves + gain[x["before"][i]]).alias("sum"), F.when(x["codes"][i] < 0, i).otherwise(s["broken"]).alias("broken"))
            return let(moved, lambda t: mark(s, t, i))

        def mark(s: Column, t: Column, i: Column) -> Column:
            hot = (i >= WINDOW - 1) & (i - t["broken"] >= WINDOW) & (F.lit(most).cast("long") - t["sum"] >= limit)
            apart = hot & (i - (WINDOW - 1) > s["end"])
            return F.struct(
                t["sum"].alias("sum"),
                t["broken"].alias("broken"),
                F.when(apart & (s["start"] >= 0), F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["runs"]).alias("runs"),
                F.when(apart, i - (WINDOW - 1)).otherwise(s["start"]).alias("start"),
                F.when(hot, i + 1).otherwise(s["end"]).alias("end"),
            )

        def finish(s: Column) -> Column:
            return F.when(s["start"] >= 0, F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["runs"])

        return F.aggregate(F.sequence(F.lit(0), F.size(x["codes"]) - 1), start, step, finish)

    characters = F.slice(F.split(F.regexp_replace(candidate, ALLOW_ENDS, BREAK), ""), F.lit(1), F.length(candidate))
    codes = F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    limit = (threshold * WINDOW * SCALE).cast("long")
    return let(F.struct(let(codes, counted).alias("x"), limit.alias("limit")), lambda r: fold(r["x"], r["limit"]))


def entropy_spans(text: Column) -> Column:
    """``array<struct<start, end>>`` of candidate parts with high entropy."""

    def of_class(value: Column) -> Column:
        out = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            out = F.when(value.rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    def suspicious(row: Column) -> Column:
        keep = row["value"].rlike(SCORED)
        for pattern in ALLOW:
            keep = keep & ~row["value"].rlike(pattern)
        return keep

    def placed(row: Column) -> Column:
        return F.transform(hot_runs(row["value"], of_class(row["value"])), lambda r: F.struct((row["start"] + r["start"]).alias("start"), (row["start"] + r["end"]).alias("end")))

    return F.flatten(F.transform(F.filter(match_spans(text, CANDIDATE), suspicious), placed))


def outside(span: Column, others: Column) -> Column:
    """The parts of ``span`` that none of ``others`` (sorted by start) covers."""
    start = F.struct(span["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("parts"))
    piece = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def step(s: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] > s["at"], F.concat(s["parts"], piece(s["at"], b["start"]))).otherwise(s["parts"]).alias("parts")
        )

    meeting = F.filter(others, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(meeting, start, step, lambda s: F.when(s["at"] < span["end"], F.concat(s["parts"], piece(s["at"], span["end"]))).otherwise(s["parts"]))


def secret_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (base spans and those of the method): ``array<struct<start, rank, end, kind>>`` by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def ranked(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(
        F.concat(*[ranked(match_spans(text, LONG_RUNS.get(kind, pattern), group, least), rank, kind) for rank, (kind, pattern, group, least) in enumerate(KINDS)])
    )
    spread = df.withColumns({"base_spans": base, "_hot": entropy_spans(text)})
    added = ranked(F.flatten(F.transform("_hot", lambda s: outside(s, F.col("base_spans")))), len(KINDS), "entropy")
    return spread.withColumn("secret_spans", F.array_sort(F.concat("base_spans", added))).drop("_hot")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: spans by kind, the digest of the base spans, and all spans."""
    found = secret_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans")
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace each secret of the text by ``mark``, those that meet or touch by one; a text without secrets stays as it is."""
    found = secret_spans(df, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, span: Column) -> Column:
        apart = (span["start"] > s["at"]) | (F.size(s["parts"]) == 0)
        kept = F.substr(text, (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(apart, F.concat(s["parts"], F.array(kept, F.lit(mark)))).otherwise(s["parts"]).alias("parts"))

    clean = F.aggregate("secret_spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, (s["at"] + 1).cast("int"))))
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, clean).otherwise(text)).drop("base_spans", "secret_spans")

