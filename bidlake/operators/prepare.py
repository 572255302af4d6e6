"""Projections, derivations, pairs, splits, encoding: plain column work around one or two shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.operators.ranks import quantiles, running_over


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame itself, or an error that names every missing column, before any work is done."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Every named column, as a typed null where the frame lacks it."""
    return df.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in kinds.items() if n not in df.columns])


def select_bid_columns(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """Fixed projection of rows with a known outcome, tagged with their source."""
    return df.where(F.col("bid_iswinning").isNotNull()).select(*columns, F.lit(source).alias("source_country"))


def ocds_to_bids(main: DataFrame, awards: DataFrame, suppliers: DataFrame, defaults: dict) -> DataFrame:
    """Three tables of a release joined into the unified bid schema; every award of a release is a win.

    Amounts are cast with null on failure; a buyer without id gets the digest of its name.
    """
    m, a, s = main.alias("m"), awards.alias("a"), suppliers.alias("s")
    joined = m.join(a, F.col("m.ocid") == F.col("a.main_ocid")).join(s, (F.col("s.main_ocid") == F.col("m.ocid")) & (F.col("s.awards_id") == F.col("a.id")))
    return joined.select(
        F.col("m.ocid").cast("string").alias("tender_id"),
        F.col("a.id").cast("string").alias("lot_id"),
        F.col("s.id").cast("string").alias("bidder_masterid"),
        F.col("s.name").alias("bidder_name"),
        F.coalesce(F.col("m.buyer_id").cast("string"), F.md5(F.coalesce("m.buyer_name", F.lit("")))).alias("buyer_masterid"),
        F.coalesce("m.buyer_country", F.lit(defaults["country"])).alias("buyer_country"),
        F.lit(True).alias("bid_iswinning"),
        F.col("a.value_amount").try_cast("double").alias("bid_price"),
        F.coalesce("m.tender_value_currency", F.lit(defaults["currency"])).alias("currency"),
        F.coalesce(F.length("a.description"), F.lit(0)).alias("lot_description_length"),
        F.datediff("m.end_date", "m.date").alias("submission_period"),
        F.year("m.date").alias("publish_year"),
    )


def build_pairs(bids: DataFrame) -> DataFrame:
    """Labelled (lot, bidder) pairs; rows without label, lot or bidder are left out."""
    known = bids.dropna(subset=["bid_iswinning", "lot_id", "bidder_masterid"])
    won = F.col("bid_iswinning")
    return known.select(
        F.concat_ws("_", "lot_id", "bidder_masterid").alias("pair_id"),
        *[c for c in bids.columns if c != "bid_iswinning"],
        won.cast("int").alias("did_win"),
        F.when(won, "winner").otherwise("real_loser").alias("pair_type"),
    )


def temporal_features(df: DataFrame, call: str = "call_date", deadline: str = "deadline", longest: int = 365) -> DataFrame:
    return df.withColumns(
        {
            "publish_month": F.month(call),
            "publish_quarter": F.quarter(call),
            "deadline_days": F.least(F.abs(F.datediff(deadline, call)), F.lit(longest)),
        }
    )


def sample_pairs(df: DataFrame, fraction: float, key: str, seed: str = "pairs") -> DataFrame:
    """A part of the rows chosen by hash of the key, so that reruns agree; 1.0 adds no predicate."""
    if fraction >= 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def size_ratio(estimate: Column, price: Column, average: Column) -> Column:
    size = F.coalesce(estimate.try_cast("double"), price.try_cast("double"))
    return F.when((size > 0) & (average > 0), size / average)


def source_tag(country: Column) -> Column:
    return F.when(country == "ZA", "SA").otherwise("GPPD")


def experience_tier(wins: Column) -> Column:
    """0 for none or null, then 1-5, 6-20, 21-50 and above (right-closed bins)."""
    w = F.coalesce(wins, F.lit(0))
    return F.when(w <= 0, 0).when(w <= 5, 1).when(w <= 20, 2).when(w <= 50, 3).otherwise(4)


def win_momentum(wins: Column, recency: Column) -> Column:
    return F.round(wins * recency, 4)


def supplier_momentum(rate: Column, recency: Column) -> Column:
    return F.coalesce(rate * recency, F.lit(0.0))


def feature_columns(df: DataFrame, excluded: list[str]) -> list[str]:
    """Columns that are features: not ids, dates, target or split."""
    return [f.name for f in df.schema.fields if f.name not in excluded and not isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)]


def align_features(df: DataFrame, order: list[str], medians: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """Exactly the model's columns in its order; a missing column or null is the median."""
    have = set(df.columns)
    return df.select(*keys, *[F.coalesce(F.col(c).cast("double") if c in have else F.lit(None).cast("double"), F.lit(float(medians.get(c, 0.0)))).alias(c) for c in order])


def tenant(df: DataFrame, owner: str, column: str = "company_id") -> DataFrame:
    """Rows of one owner. Rows without owner belong to nobody."""
    return df.where(F.col(column) == owner)


def convert_currency(df: DataFrame, rates: DataFrame, amount: str, currency: str = "currency", name: str = "amount_usd") -> DataFrame:
    """Amounts in USD by one table of rates (a row a currency); null for an unknown currency."""
    return df.join(F.broadcast(rates.select(F.col("currency").alias(currency), "usd_rate")), currency, "left").withColumn(name, F.col(amount) * F.col("usd_rate")).drop("usd_rate")


def default_country(country: Column, fallback: str = "ZA") -> Column:
    c = F.trim(F.coalesce(country, F.lit("")))
    return F.when(c.isin("", "Unknown", "nan", "None"), fallback).otherwise(country)


def override_features(base: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Values read from documents in the place of table values wherever they are not null."""
    shared = [c for c in parsed.columns if c != key and c in base.columns]
    renamed = parsed.select(key, *[F.col(c).alias(f"_p_{c}") for c in shared])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in shared else c for c in base.columns])


def what_if(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every base row under every named set of overrides (a null override keeps the base value)."""
    changed = [c for c in scenarios.columns if c != "scenario"]
    renamed = scenarios.select("scenario", *[F.col(c).alias(f"_s_{c}") for c in changed])
    crossed = base.crossJoin(F.broadcast(renamed))
    return crossed.select("scenario", *[F.coalesce(f"_s_{c}", c).alias(c) if c in changed else c for c in base.columns])


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only in a are ``missing``, keys only in b ``unknown``."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("unknown")))


def time_split_years(df: DataFrame, year: str = "publish_year", train: float = 0.6, val: float = 0.8) -> tuple[int, int]:
    """Cut years: those whose running share of rows is nearest the goals; the last year is kept for test.

    Only the table of years reaches the driver.
    """
    rows = df.groupBy(year).count().collect()
    total = sum(r["count"] for r in rows)
    years = sorted((r[year], r["count"]) for r in rows if r[year] is not None)
    if not years:
        raise ValueError("no years")
    running, shares = 0, []
    for y, n in years:
        running += n
        shares.append((y, running / total))
    candidates = shares[:-1] if len(shares) > 1 else shares
    nearest = lambda goal: min(candidates, key=lambda s: abs(s[1] - goal))[0]
    train_end, val_end, last = nearest(train), nearest(val), years[-1][0]
    if val_end <= train_end:
        val_end = train_end + 1
    if val_end >= last:
        val_end = last - 1
        if train_end >= val_end:
            train_end = val_end - 1
    return train_end, val_end


def time_split(df: DataFrame, year: str = "publish_year", train: float = 0.6, val: float = 0.8) -> DataFrame:
    """Add ``split``; a row without year is in none."""
    train_end, val_end = time_split_years(df, year, train, val)
    y = F.col(year)
    return df.withColumn("split", F.when(y.isNull(), F.lit(None)).when(y <= train_end, "train").when(y <= val_end, "val").otherwise("test"))


def check_split(df: DataFrame, least: int = 30, year: str = "publish_year") -> DataFrame:
    """One row: whether each split is large enough and the years of the splits do not overlap."""
    stats = df.groupBy("split").agg(F.count("*").alias("n"), F.min(year).alias("lo"), F.max(year).alias("hi"))
    one = lambda what, s: F.max(F.when(F.col("split") == s, F.col(what)))
    return stats.agg(
        F.coalesce(F.min(F.when(F.col("split").isNotNull(), F.col("n"))) >= least, F.lit(False)).alias("large_enough"),
        F.coalesce((one("hi", "train") < one("lo", "val")) & (one("hi", "val") < one("lo", "test")), F.lit(False)).alias("in_order"),
    )


def require_split(df: DataFrame, least: int = 30, year: str = "publish_year") -> DataFrame:
    """The frame itself, or an error where a split is too small or years of splits overlap."""
    state = check_split(df, least, year).first()
    if not (state["large_enough"] and state["in_order"]):
        raise ValueError("a split is too small" if not state["large_enough"] else "years of splits overlap")
    return df


def null_placeholders(df: DataFrame, placeholders: dict[str, str]) -> DataFrame:
    """Null where a column still holds its known placeholder; any other value stays. Columns that the frame lacks are skipped."""
    return df.withColumns({c: F.when(~F.col(c).eqNullSafe(F.lit(v)), F.col(c)) for c, v in placeholders.items() if c in df.columns})


def upcoming(events: DataFrame, day: str, as_of: Column, n: int, *ties: str) -> DataFrame:
    """The next n events from a day on."""
    return events.where(F.col(day) >= as_of).orderBy(day, *ties).limit(n)


def coerce_numeric(df: DataFrame, least: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """String columns as doubles where more than ``least`` of their values convert (one pass over all)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    if not texts:
        return df
    rates = df.agg(*[F.try_divide(F.count(F.col(c).try_cast("double")), F.count(c)).alias(c) for c in texts]).first()
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in texts and (rates[c] or 0) > least else c for c in df.columns])


def ordinal_dictionary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): sorted distinct training values of each column, from 0; a column of many values is many slices."""
    values = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where(F.col("value").isNotNull()).distinct()
    numbered = running_over(values.withColumn("_one", F.lit(1)), ["column"], ["value"], {"code": ("sum", "_one")}, exclusive=True)
    return numbered.select("column", "value", F.col("code").cast("int").alias("code"))


def ordinal_encode(df: DataFrame, dictionary: DataFrame, columns: list[str], unknown: int = -1, missing: int = -2, scoring: bool = False) -> DataFrame:
    """Codes in the place of values; Spark broadcasts each dictionary where it is small enough.

    In ``scoring`` values match trimmed and in lower case; of entries that become equal the last one counts.
    """
    out, form = df, (lambda c: F.lower(F.trim(c))) if scoring else (lambda c: c)
    for c in columns:
        own = dictionary.where(F.col("column") == c).groupBy(form(F.col("value")).alias("_v")).agg(F.max("code").alias("_c"))
        code = F.when(F.col(c).isNull(), missing).otherwise(F.coalesce("_c", F.lit(unknown)))
        out = out.join(own, form(F.col(c).cast("string")) == F.col("_v"), "left").withColumn(c, code.cast("int")).drop("_v", "_c")
    return out


def median_impute(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as the exact training median, 0 where training has no value."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    medians = {r["column"]: r["q"][0] for r in quantiles(long, [0.5]).collect()}  # one row a column
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))).alias(c) if c in columns else c for c in df.columns])


def bool_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else f.name for f in df.schema.fields])


def new_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Target rows, replaced or joined by the newest change of their key."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, F.desc("_new"), F.desc(version)).drop("_new")


def cascade_remove(parents: DataFrame, children: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the removed parents and their children."""
    gone = removed.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")
