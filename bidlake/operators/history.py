"""Point-in-time history of bidders and buyers: year totals, running totals, as-of joins, features.

Everything is aggregated to (key, year) before any window or join, so the work follows the number of
active years and not the square of the bids. A null key has no history: it is never grouped into one
giant "unknown" bidder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIDDER, BUYER, COUNTRY, YEAR = "bidder_name", "buyer_masterid", "buyer_country", "publish_year"
NEVER_WON_YEARS = 10.0


def entries_by_year(bids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, year): entries, wins, sum and count of priced wins, last year won."""
    priced = F.col("bid_iswinning") & F.col("bid_price").isNotNull()
    return (
        bids.where(F.col(YEAR).isNotNull())
        .dropna(subset=keys)
        .groupBy(*keys, YEAR)
        .agg(
            F.count("*").alias("entries"),
            F.count_if("bid_iswinning").alias("wins"),
            F.coalesce(F.sum(F.when(priced, F.col("bid_price"))), F.lit(0.0)).alias("price_sum"),
            F.count_if(priced).alias("priced_wins"),
            F.max(F.when(F.col("bid_iswinning"), F.col(YEAR))).alias("last_win_year"),
        )
    )


def cumulative(df: DataFrame, by: list[str], order: str, sums: list[str], maxima: list[str] = ()) -> DataFrame:
    """Running sums (``cum_*``) and running maxima (``run_*``) up to and including each row."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sums], *[F.max(c).over(upto).alias(f"run_{c}") for c in maxima])


def prior(df: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Sums over strictly earlier rows (``prior_*``), null in the first row of a group."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.sum(c).over(before).alias(f"prior_{c}") for c in sums])


def share(df: DataFrame, by: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's total."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def asof_left(left: DataFrame, stats: DataFrame, by: list[str], left_on: str, stats_on: str, columns: list[str], offset: int = 1) -> DataFrame:
    """``left`` with ``columns`` of the latest stats row of its key with ``stats_on <= left_on - offset``; null when none.

    Only the distinct (key, time) of ``left`` are interleaved with the stats and get the last stats row carried
    on, so that what a window task holds follows the times of a key and not its rows; an equi-join brings the
    result back. ``stats`` must be unique per (by, stats_on).
    """
    value = F.struct(*columns)
    probe = left.select(*by, left_on).dropna().distinct().select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(stats.select(value).schema[0].dataType).alias("_stats"))
    known = stats.dropna(subset=[*by, stats_on]).select(*by, (F.col(stats_on) + offset).cast(left.schema[left_on].dataType).alias("_t"), F.lit(0).alias("_side"), value.alias("_stats"))
    upto = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = known.unionByName(probe).withColumn("_stats", F.last("_stats", ignorenulls=True).over(upto)).where(F.col("_side") == 1)
    carried = carried.select(*by, F.col("_t").alias(left_on), *[F.col(f"_stats.{c}").alias(c) for c in columns])
    return left.join(carried, [*by, left_on], "left").select(*left.columns, *columns)


def category(cpvs: Column) -> Column:
    return F.substring(cpvs, 1, 2)


def prior_category_wins(bids: DataFrame, probes: DataFrame) -> DataFrame:
    """(bidder, year of probe, category): wins in strictly earlier years. Wins are summed by year first."""
    wins = bids.where("bid_iswinning").dropna(subset=[BIDDER, YEAR]).groupBy(BIDDER, category(F.col("tender_cpvs")).alias("category"), F.col(YEAR).alias("win_year")).agg(F.count("*").alias("n"))
    keys = probes.select(BIDDER, YEAR).dropna().distinct()
    joined = keys.join(wins, BIDDER).where(F.col("win_year") < F.col(YEAR))
    return joined.groupBy(BIDDER, YEAR, "category").agg(F.sum("n").alias("wins"))


def category_hhi(bids: DataFrame, probes: DataFrame) -> DataFrame:
    """(bidder, year): sum over categories of the squared share of earlier wins."""
    shared = share(prior_category_wins(bids, probes), [BIDDER, YEAR], "wins")
    return shared.groupBy(BIDDER, YEAR).agg(F.sum(F.col("share") * F.col("share")).alias("category_hhi"))


def countries_so_far(bids: DataFrame) -> DataFrame:
    """(bidder, year): distinct countries entered up to that year; first sightings are counted, nothing is joined."""
    first = bids.dropna(subset=[BIDDER, COUNTRY, YEAR]).groupBy(BIDDER, COUNTRY).agg(F.min(YEAR).alias(YEAR))
    new = first.groupBy(BIDDER, YEAR).agg(F.count("*").alias("new_countries"))
    return cumulative(new, [BIDDER], YEAR, ["new_countries"]).select(BIDDER, YEAR, F.col("cum_new_countries").alias("country_count"))


def earlier_in_years(left: DataFrame, totals: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """``left`` with the sums (name to column) over the years of its key before its own, 0 without any.

    ``totals``: one row a key and year (see ``entries_by_year``). A key's years stand in one row, a list as long as the key has years, so
    each table moves once.
    """
    years = totals.groupBy(*by).agg(F.collect_list(F.struct(F.col(YEAR).alias("y"), *sums.values())).alias("_years"))
    met = left.join(years, by, "left").withColumn("_years", F.filter("_years", lambda t: t["y"] < F.col(YEAR)))
    total = lambda c: F.coalesce(F.aggregate("_years", F.lit(0).cast("long"), lambda s, t: s + t[c]), F.lit(0).cast("long"))
    return met.select(*left.columns, *[total(c).alias(name) for name, c in sums.items()])


def incumbents(bids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``pit_is_incumbent``: 1 where the bidder won from that buyer in an earlier year, else 0."""
    first = bids.where("bid_iswinning").dropna(subset=[BIDDER, BUYER, YEAR]).groupBy(BIDDER, BUYER).agg(F.min(YEAR).alias("_first"))
    return pairs.join(first, [BIDDER, BUYER], "left").select(*pairs.columns, F.coalesce(F.col("_first") < F.col(YEAR), F.lit(False)).cast("int").alias("pit_is_incumbent"))


def _rate(wins: str, entries: str) -> Column:
    return F.when(F.col(entries) > 0, F.col(wins) / F.col(entries)).otherwise(F.lit(0.0))


def supplier_features(bids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The published supplier features of each pair, from years before the pair's own."""
    by_bidder = cumulative(entries_by_year(bids, [BIDDER]), [BIDDER], YEAR, ["entries", "wins", "price_sum", "priced_wins"], ["last_win_year"])
    by_country = cumulative(entries_by_year(bids, [BIDDER, COUNTRY]), [BIDDER, COUNTRY], YEAR, ["entries", "wins"])
    named = lambda df, **names: df.select(*[c for c in df.columns if c not in names.values()], *[F.col(v).alias(k) for k, v in names.items()])
    total = named(by_bidder, t_entries="cum_entries", t_wins="cum_wins", t_sum="cum_price_sum", t_priced="cum_priced_wins", t_last="run_last_win_year")
    # What depends on bidder, country and year alone is put together on the distinct ones, so the pairs meet it in one join.
    places = pairs.select(BIDDER, COUNTRY, YEAR).dropna(subset=[BIDDER, YEAR]).distinct()
    keys = places.select(BIDDER, YEAR).distinct()
    own = asof_left(keys, total, [BIDDER], YEAR, YEAR, ["t_entries", "t_wins", "t_sum", "t_priced", "t_last"])
    own = asof_left(own, countries_so_far(bids), [BIDDER], YEAR, YEAR, ["country_count"]).join(category_hhi(bids, keys), [BIDDER, YEAR], "left")
    there = asof_left(places, named(by_country, c_entries="cum_entries", c_wins="cum_wins"), [BIDDER, COUNTRY], YEAR, YEAR, ["c_entries", "c_wins"])
    own = there.join(own, [BIDDER, YEAR], "left").withColumnsRenamed({c: f"_{c}" for c in (BIDDER, COUNTRY, YEAR)})
    out = earlier_in_years(pairs.select("pair_id", BIDDER, COUNTRY, BUYER, YEAR), entries_by_year(bids, [BIDDER, BUYER]), [BIDDER, BUYER], {"b_entries": "entries", "b_wins": "wins"}).drop(BUYER)
    out = out.join(own, (F.col(BIDDER) == F.col(f"_{BIDDER}")) & F.col(COUNTRY).eqNullSafe(F.col(f"_{COUNTRY}")) & (F.col(YEAR) == F.col(f"_{YEAR}")), "left")
    counts = ["t_entries", "t_wins", "t_priced", "c_entries", "c_wins", "country_count", "b_entries", "b_wins"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"t_sum": F.round(F.coalesce("t_sum", F.lit(0.0)), 4), "category_hhi": F.coalesce("category_hhi", F.lit(0.0))})
    # Money sums are rounded far below a cent, so that means do not depend on the order in which tasks add.
    years = F.when(F.col("t_last").isNull(), F.lit(NEVER_WON_YEARS)).otherwise(F.greatest(F.lit(0.0), (F.col(YEAR) - F.col("t_last")).cast("double")))
    return out.withColumn("_years", years).select(
        "pair_id",
        F.col("t_entries").alias("pit_total_entries"),
        F.col("t_wins").alias("pit_total_wins"),
        _rate("t_wins", "t_entries").alias("pit_win_rate_overall"),
        _rate("c_wins", "c_entries").alias("pit_win_rate_country"),
        _rate("t_sum", "t_priced").alias("pit_avg_contract_value"),
        F.col("_years").alias("pit_last_win_years_ago"),
        F.log1p("t_wins").alias("pit_experience_score"),
        (1 / (1 + F.col("_years"))).alias("pit_recency_score"),
        (F.col("b_wins") > 0).cast("int").alias("pit_is_incumbent"),
        F.col("country_count").alias("pit_country_count"),
        (F.col("country_count") > 1).cast("int").alias("pit_is_international"),
        F.col("b_wins").alias("pit_buyer_win_count"),
        F.col("b_entries").alias("pit_buyer_entry_count"),
        _rate("b_wins", "b_entries").alias("pit_win_rate_buyer"),
        _rate("b_wins", "t_wins").alias("buyer_loyalty_score"),
        "category_hhi",
    )


def competition(pairs: DataFrame, unit: str = "lot_id", fallback: str = "tender_id", real_only: bool = False) -> DataFrame:
    """Rows of the same lot (its tender where the lot is null) and the chance of one among them."""
    counted = F.count_if(F.col("pair_type") != "synthetic_negative") if real_only else F.count("*")
    key = F.coalesce(F.concat(F.lit("L"), unit), F.concat(F.lit("T"), fallback))
    keyed = pairs.withColumn("_unit", key)
    sizes = keyed.groupBy("_unit").agg(counted.alias("actual_num_competitors"))
    return keyed.join(sizes, "_unit", "left").drop("_unit").withColumn("competition_baseline", F.try_divide(F.lit(1.0), F.col("actual_num_competitors")))


def buyer_year(bids: DataFrame) -> DataFrame:
    """(buyer, year): awards, sum and count of award prices, bids per tender, rows."""
    lots = bids.dropna(subset=[BUYER, YEAR])
    won = F.col("bid_iswinning")
    return lots.groupBy(BUYER, YEAR).agg(
        F.count_if(won).alias("awards"),
        F.coalesce(F.sum(F.when(won, F.col("bid_price"))), F.lit(0.0)).alias("price_sum"),
        F.count_if(won & F.col("bid_price").isNotNull()).alias("priced_awards"),
        F.countDistinct("lot_id").alias("lots"),
        F.count("*").alias("n_rows"),
    )


def buyer_history(bids: DataFrame, denominator: str = "priced") -> DataFrame:
    """(buyer, year): awards before that year, their mean price (over priced or ``all`` awards) and bids a lot.

    0 awards and null means in the buyer's first year; buyers are left-joined to pairs by (buyer, year).
    """
    before = prior(buyer_year(bids), [BUYER], YEAR, ["awards", "price_sum", "priced_awards", "lots", "n_rows"])
    per = "prior_priced_awards" if denominator == "priced" else "prior_awards"
    return before.select(
        BUYER,
        YEAR,
        F.coalesce("prior_awards", F.lit(0)).alias("buyer_total_past_awards"),
        F.try_divide(F.col("prior_price_sum"), F.col(per)).alias("buyer_avg_contract_value"),
        F.try_divide(F.col("prior_n_rows"), F.col("prior_lots")).alias("buyer_avg_competitors"),
    )


def buyer_specialisation(bids: DataFrame) -> DataFrame:
    """(buyer, category, year): share of the buyer's earlier awards that fell in the category, 0 if it had none."""
    won = bids.dropna(subset=[BUYER, YEAR])
    own = won.groupBy(BUYER, category(F.col("tender_cpvs")).alias("category"), YEAR).agg(F.count_if("bid_iswinning").alias("awards"))
    in_category = prior(own, [BUYER, "category"], YEAR, ["awards"]).select(BUYER, "category", YEAR, F.coalesce("prior_awards", F.lit(0)).alias("_own"))
    all_years = own.groupBy(BUYER, YEAR).agg(F.sum("awards").alias("awards"))
    overall = prior(all_years, [BUYER], YEAR, ["awards"]).select(BUYER, YEAR, F.coalesce("prior_awards", F.lit(0)).alias("_all"))
    return in_category.join(overall, [BUYER, YEAR]).select(BUYER, "category", YEAR, F.when(F.col("_all") > 0, F.col("_own") / F.col("_all")).otherwise(F.lit(0.0)).alias("buyer_specialisation"))


def buyer_openness(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of each buyer's training wins that went to non-incumbents; unseen buyers get the mean over buyers."""
    per = train.where(F.col("did_win") == 1).groupBy(BUYER).agg(F.round(F.avg(F.when(F.col("pit_is_incumbent") == 0, 1.0).otherwise(0.0)), 4).alias("buyer_openness"))
    mean = per.agg(F.round(F.avg("buyer_openness"), 4).alias("_mean"))
    return pairs.join(per, BUYER, "left").crossJoin(F.broadcast(mean)).withColumn("buyer_openness", F.coalesce("buyer_openness", "_mean")).drop("_mean")
