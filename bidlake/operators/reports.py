"""Operational reports: outcomes, costs, quotas, packs, compliance, quotes, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import forget_shuffles, materialize
from bidlake.operators.ranks import numbered_positions, running_over

# Limits by tier; prices in USD per million tokens; the VAT rate; required documents.
TIERS = [("starter", 0, 0), ("pro", 5, 3), ("enterprise", 50, 25)]
REQUIRED_DOCUMENTS = ["tax_clearance", "csd_report", "bbbee_certificate", "cipc_registration", "cidb_certificate"]
VAT = 0.15
COST_ALERT, LIMIT_ALERT = 50.0, 10


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def accuracy_stats(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by outcome; accuracy over decided rows; precision of PURSUE; mean probability when won and lost.

    Input: recommendation, actual_outcome (pending, won, lost, withdrawn), predicted_probability.
    """
    won, lost, pursue = F.col("actual_outcome") == "won", F.col("actual_outcome") == "lost", F.col("recommendation") == "PURSUE"
    kinds = [_count(F.col("actual_outcome") == k, k) for k in ("pending", "won", "lost", "withdrawn")]
    out = outcomes.groupBy(*by).agg(
        *kinds, _count((pursue & won) | (~pursue & lost), "_right"), _count(pursue & won, "_hit"), _count(pursue & (won | lost), "_said"),
        F.avg(F.when(won, F.col("predicted_probability"))).alias("mean_won"), F.avg(F.when(lost, F.col("predicted_probability"))).alias("mean_lost"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        *by, "pending", "won", "lost", "withdrawn", ratio(F.col("_right"), F.col("won") + F.col("lost")).alias("accuracy"), ratio(F.col("_hit"), F.col("_said")).alias("precision"),
        F.coalesce("mean_won", F.lit(0.0)).alias("mean_won"), F.coalesce("mean_lost", F.lit(0.0)).alias("mean_lost"),
    )


def accuracy_trend(outcomes: DataFrame, at: str) -> DataFrame:
    return accuracy_stats(outcomes.withColumn("month", F.date_trunc("month", at).cast("date")), ["month"]).select("month", "won", "lost", "accuracy")


def track_record(outcomes: DataFrame, by: str) -> DataFrame:
    """Wins, losses and win per cent; null, not 0, where nothing is decided."""
    out = outcomes.groupBy(by).agg(_count(F.col("actual_outcome") == "won", "wins"), _count(F.col("actual_outcome") == "lost", "losses"))
    return out.withColumn("win_pct", F.round(F.try_divide(100.0 * F.col("wins"), F.col("wins") + F.col("losses")), 2))


def pipeline_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total"), _count(F.col("recommendation") == "PURSUE", "pursue"), F.avg("predicted_probability").alias("mean_probability"))


def api_summary(calls: DataFrame) -> DataFrame:
    """One pass: calls, cost, rate-limited, errors, and the two alerts. Input: cost_usd, status, is_rate_limited."""
    limited = F.coalesce(F.col("is_rate_limited"), F.lit(False))
    out = calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), _count(limited, "rate_limited"), _count(F.col("status").startswith("error:") & ~limited, "errors"))
    return out.withColumns({"cost_alert": F.col("cost") > COST_ALERT, "limit_alert": F.col("rate_limited") > LIMIT_ALERT})


def log_report(log: DataFrame) -> DataFrame:
    """(endpoint, company, calls, errors): by endpoint, by company and overall, in one pass of grouping sets."""
    e, c = F.coalesce("endpoint", F.lit("Unknown")), F.coalesce("company", F.lit("Unknown"))
    named = log.select(e.alias("endpoint"), c.alias("company"), (F.col("severity") == "ERROR").alias("bad"))
    sets = named.groupingSets([[F.col("endpoint")], [F.col("company")], []], F.col("endpoint"), F.col("company"))
    return sets.agg(F.count("*").alias("calls"), _count(F.col("bad"), "errors"))


def usage_today(logs: DataFrame, companies: DataFrame, tiers: DataFrame, at: str = "ts") -> DataFrame:
    """(company, action, day): used, limit, remaining, allowed. ``tiers``: tier, action, daily."""
    used = logs.groupBy("company_id", "action_type", F.to_date(at).alias("day")).agg(F.count("*").alias("used"))
    limits = companies.join(F.broadcast(tiers), "tier").select("company_id", "action_type", "daily")
    out = used.join(limits, ["company_id", "action_type"], "left").withColumn("daily", F.coalesce("daily", F.lit(0)))
    return out.withColumns({"remaining": F.greatest(F.lit(0), F.col("daily") - F.col("used")), "allowed": F.col("used") < F.col("daily")})


def token_cost(calls: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """USD by group: tokens by the model's prices per million; an unknown model costs the highest."""
    top = prices.agg(F.max("usd_in").alias("_in"), F.max("usd_out").alias("_out"))
    priced = calls.join(F.broadcast(prices), "model", "left").crossJoin(F.broadcast(top))
    cost = (F.col("tokens_in") * F.coalesce("usd_in", "_in") + F.col("tokens_out") * F.coalesce("usd_out", "_out")) / 1e6
    return priced.groupBy(*by).agg(F.sum(cost).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def pack_rollup(items: DataFrame) -> DataFrame:
    """Per pack: flags total, acknowledged, outstanding, advisory; values total, unconfirmed. Input: pack_id, what (flag, value), advisory, done."""
    flag, value, advisory, done = F.col("what") == "flag", F.col("what") == "value", F.col("advisory"), F.col("done")
    return items.groupBy("pack_id").agg(
        _count(flag, "flags"), _count(flag & done, "acknowledged"), _count(flag & ~done & ~advisory, "outstanding"), _count(flag & advisory, "advisory"), _count(value, "filled"), _count(value & ~done, "unconfirmed")
    )


def pack_status(rollup: DataFrame, stored: DataFrame) -> DataFrame:
    """draft, processing and error stand; otherwise reviewed where nothing is open, else needs_review."""
    out = stored.join(rollup, "pack_id", "left")
    clear = (F.coalesce("outstanding", F.lit(0)) == 0) & (F.coalesce("unconfirmed", F.lit(0)) == 0)
    return out.select("pack_id", F.when(F.col("status").isin("draft", "processing", "error"), F.col("status")).when(clear, "reviewed").otherwise("needs_review").alias("status"))


def _first_labels(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, labels): the least ``most`` different labels of each group, in order; no more rows of a group are ever gathered."""
    ranked = rows.where(F.col("label").isNotNull()).select(*by, "label").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("label")))
    return ranked.where(F.col("_n") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def outstanding_groups(items: DataFrame, structural: list[str], labels: int = 6) -> DataFrame:
    """Items of structural reasons as one group each (count, pages, first labels); others stand alone."""
    grouped = F.col("reason").isin(structural)
    keyed = items.withColumn("group_key", F.when(grouped, F.col("reason")).otherwise(F.concat_ws(":", "reason", "item_key")))
    groups = keyed.groupBy("group_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("pages"))
    out = groups.join(_first_labels(keyed, ["group_key"], labels), "group_key", "left")
    return out.select("group_key", "n", "pages", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def missing_fields(wanted: DataFrame, profile: DataFrame, labels: int = 5) -> DataFrame:
    """Fields wanted but empty in the profile: count, first labels, locations, and the place (from 1) in the company's order, most needed first.

    ``wanted``: company_id, field, label, location (of a page or form, so there are few); ``profile``: company_id, field, value. Companies and fields are not null.
    """
    by = ["company_id", "field"]
    have = profile.where(F.trim(F.coalesce("value", F.lit(""))) != "").select(*by).distinct()
    open_ = wanted.join(have, by, "left_anti")
    places = F.array_sort(F.collect_set(F.when(F.col("location") != "", F.col("location"))))
    counted = open_.groupBy(*by).agg(F.count("*").alias("n"), places.alias("locations")).join(_first_labels(open_, by, labels), by, "left")
    need = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("n"), "field"))
    return counted.select(*by, "n", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "locations", need.alias("need"))


def merge_archive(documents: DataFrame) -> DataFrame:
    """Per (tenant, company): flags ORed, distinct files, distinct new files by kind, latest real identity."""
    real = F.when(~F.lower(F.trim("registration")).isin("pending", "n/a", "unknown", ""), F.col("registration"))
    return documents.groupBy("company_id", "company_name").agg(
        F.coalesce(F.bool_or(F.col("kind") == "cipc"), F.lit(False)).alias("cipc_uploaded"), F.coalesce(F.bool_or(F.col("kind") == "csd"), F.lit(False)).alias("csd_uploaded"),
        F.countDistinct("file").alias("files"), F.countDistinct(F.when(F.col("kind") == "cipc", F.col("file"))).alias("cipc_count"), F.countDistinct(F.when(F.col("kind") == "csd", F.col("file"))).alias("csd_count"),
        F.max_by(real, F.when(real.isNotNull(), F.col("at"))).alias("registration"),
    )


def compliance_grid(companies: DataFrame, documents: DataFrame, as_of: Column, required: list[str] = REQUIRED_DOCUMENTS) -> DataFrame:
    """Every company with every required type: valid, expiring_soon (30 days), expired or missing."""
    types = companies.sparkSession.createDataFrame([(t,) for t in required], "document_type string")
    latest = documents.groupBy("company_id", "document_type").agg(F.max("expiry_date").alias("expiry_date"), F.lit(True).alias("_has"))
    grid = companies.crossJoin(F.broadcast(types)).join(latest, ["company_id", "document_type"], "left")
    days = F.datediff("expiry_date", as_of)
    status = F.when(F.col("_has").isNull(), "missing").when(days < 0, "expired").when(days <= 30, "expiring_soon").otherwise("valid")
    return grid.select("company_id", "document_type", "expiry_date", status.alias("status"))


def compliance_status(grid: DataFrame, mandatory: tuple[str, ...] = ("tax_clearance", "csd_report")) -> DataFrame:
    """Worst status of each company (compliant, attention_needed, non_compliant) and its share of valid documents."""
    severity = F.when(F.col("status") == "expired", 2).when((F.col("status") == "missing") & F.col("document_type").isin(*mandatory), 2).when(F.col("status") == "expiring_soon", 1).otherwise(0)
    out = grid.groupBy("company_id").agg(F.max(severity).alias("_s"), F.round(100.0 * F.avg((F.col("status") == "valid").cast("int")), 2).alias("valid_pct"))
    return out.select("company_id", F.element_at(F.array(F.lit("compliant"), F.lit("attention_needed"), F.lit("non_compliant")), F.col("_s") + 1).alias("status"), "valid_pct")


def quote_totals(lines: DataFrame, by: str) -> DataFrame:
    """Subtotal of priced lines, unpriced lines, VAT and total; the total is null while a line has no price."""
    out = lines.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("quantity") * F.col("price"))), F.lit(0.0)).alias("subtotal"), F.count_if(F.col("price").isNull()).alias("unpriced"))
    full = F.col("unpriced") == 0
    return out.withColumns({"vat": F.when(full, F.col("subtotal") * VAT), "total": F.when(full, F.col("subtotal") * (1 + VAT))})


def quote_flags(quotes: DataFrame) -> DataFrame:
    """Lines that await a price; a list that cannot be read is one unresolved line (position -1). Input: quote_id, line_items JSON."""
    items = F.from_json("line_items", "array<struct<description:string,price:double>>")
    spread = quotes.withColumn("_items", items)
    lines = spread.where(F.col("_items").isNotNull()).select("quote_id", F.posexplode("_items").alias("position", "item")).where(F.col("item.price").isNull())
    broken = spread.where(F.col("_items").isNull()).select("quote_id", F.lit(-1).alias("position"))
    return lines.select("quote_id", "position").unionByName(broken)


def profile_completeness(profiles: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    absent = lambda names: F.array_compact(F.array(*[F.when(~filled(c), F.lit(c)) for c in names]))
    out = profiles.select("company_id", absent(fields).alias("missing"), absent(required).alias("missing_required"))
    return out.withColumns({"filled": F.lit(len(fields)) - F.size("missing"), "ready": F.size("missing_required") == 0})


def rank_batch(scored: DataFrame, key: str) -> DataFrame:
    """Disqualified rows last, then by probability (null as 0), then key, within a batch."""
    order = Window.partitionBy("batch_id").orderBy(F.col("disqualified").cast("int"), F.desc(F.coalesce("probability", F.lit(0.0))), key)
    return scored.withColumn("position", F.row_number().over(order))


def rolling_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events of the key in the ``seconds`` up to each event, that moment included.

    The count is the key's running total at the event less that just before the window; both are read off one running sum over the
    distinct times and window starts, in which a hot key is many slices. An event without time has no count.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    moments = events.select(F.col(key).alias("_who"), t.alias("_t")).where("_t is not null").groupBy("_who", "_t").agg(F.count("*").alias("_n"))
    marks = F.array(F.struct(F.col("_t").alias("v"), F.lit(1).alias("kind"), F.col("_n").alias("n")), F.struct((F.col("_t") - seconds * 1_000_000).alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")))
    upto = running_over(moments.select("_who", "_t", F.inline(marks)), ["_who"], ["v", "kind"], {"_upto": ("sum", "n")})
    recent = upto.groupBy("_who", "_t").agg(F.sum(F.when(F.col("kind") == 1, F.col("_upto")).otherwise(-F.col("_upto"))).alias("recent"))
    joined = events.withColumn("_at", t).join(recent, F.col("_at").eqNullSafe(F.col("_t")) & F.col(key).eqNullSafe(F.col("_who")), "left")
    return joined.select(*events.columns, "recent")


def _numbered(pairs: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The distinct values of the columns as struct ``_of``, numbered from 0, so that rows move with a small number for them; only these
    values stream through one task."""
    return materialize(pairs.select(F.struct(*columns).alias("_of")).distinct().repartition(1).select("_of", F.monotonically_increasing_id().alias(number)), "numbers")


def _with_number(df: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    return df.join(numbers, F.struct(*columns) == F.col("_of")).drop("_of")


def _place() -> Column:
    """Market and position as one number."""
    return (F.shiftleft("_m", 36) + F.col("_at")).alias("_place")


def _moved(numbered: DataFrame, key: str, seed: str, times: int) -> DataFrame:
    """(_place, _b): for each of so many permutations, the place in its market that each row's bidder takes."""
    source = numbered.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).select((F.col("_m") * times + F.col("_k") - 1).alias("_g"), F.xxhash64(F.lit(seed), "_k", key).alias("_h"), "_b")
    return numbered_positions(source, "_g", "_at").withColumn("_m", F.expr(f"_g div {times}")).select(_place(), "_b")


def market_permutation(pairs: DataFrame, market: list[str], key: str, bidder: list[str], seed: str = "market", times: int = 1) -> DataFrame:
    """Each row with the bidder of another place in its market: a seeded permutation of whole bidders.

    Two orders of the rows of a market, by hashes of different seeds, are joined by position; nothing is
    collected, and a bidder's id and name move together, as one number. With ``times`` above 1 each row comes once for
    each of so many permutations. A market's positions are made in parts, so a hot market is no one's task.
    """
    markets, bidders = _numbered(pairs, market, "_m"), _numbered(pairs, bidder, "_b")
    own = _with_number(pairs, markets, market)
    places = numbered_positions(own.withColumn("_h", F.xxhash64(F.lit(f"{seed}-place"), key)), "_m", "_at").select(*pairs.columns, _place())
    moved = _moved(_with_number(own, bidders, bidder), key, seed, times)
    names = bidders.select("_b", *[F.col(f"_of.{b}").alias(f"new_{b}") for b in bidder])
    return places.join(moved, "_place").join(names, "_b").select(*pairs.columns, *[f"new_{b}" for b in bidder])


def _with_shared(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``_shared``: whether the lot has another pair. Pairs without lot count as such."""
    own = Window.partitionBy("lot_id", F.when(F.col("lot_id").isNull(), F.col("pair_id")))
    return pairs.withColumn("_shared", F.col("lot_id").isNull() | (F.count("*").over(own) > 1))


def negative_keys(pairs: DataFrame, market: list[str], target: float = 0.15, trigger: float = 0.30, most: int = 10) -> DataFrame | None:
    """(lot_id, bidder_masterid, bidder_name, source): losing pairs from seeded permutations inside each market, none of them a real
    (lot, bidder), each once; ``source`` is the bidder whose place in the lot the pair takes. None where none are due.

    Only the two counts that set the number of permutations, and whether an id has several names, reach the driver. Markets and bidders
    move as numbers. A lot of one pair has one place, and no real pair but its own: what is made there stands together when
    it is made. Made and real pairs of the other lots meet in one grouping, dealt by lot. Of permutations that give the same pair, the least place stays.
    """
    counts = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum("did_win"), F.lit(0)).alias("w")).first()
    n, wins = counts["n"], counts["w"]
    if not n or wins / n <= trigger:
        return None
    times = max(1, min(most, int(wins / target - n) // n))
    pairs = pairs if "_shared" in pairs.columns else _with_shared(pairs)
    bidder = ["bidder_masterid", "bidder_name"]
    markets, bidders = _numbered(pairs, market, "_m"), _numbered(pairs, bidder, "_b")
    several_names = F.lit(not bidders.groupBy("_of.bidder_masterid").agg(F.count("*").alias("n")).where("n > 1").isEmpty())
    own = _with_number(pairs, markets, market).withColumn("_shared", F.col("_shared") | several_names)
    placed = numbered_positions(own.select("_m", F.xxhash64(F.lit("negative-place"), "pair_id").alias("_h"), "lot_id", "_shared", F.col("bidder_masterid").alias("source")), "_m", "_at")
    places = materialize(placed.select(_place(), "_h", "lot_id", "_shared", "source"), "places")
    del placed
    forget_shuffles(pairs.sparkSession)
    moved = materialize(_moved(_with_number(own, bidders, bidder), "pair_id", "negative", times), "moved")
    forget_shuffles(pairs.sparkSession)
    moved = moved.repartition("_place")
    names = bidders.select("_b", "_of.bidder_masterid", "_of.bidder_name")
    met = lambda shared: places.where(F.col("_shared") == shared).join(moved if shared else moved.distinct(), "_place").join(names, "_b").where(F.col("bidder_masterid") != F.col("source"))
    columns = ["lot_id", "bidder_masterid", "bidder_name", "source"]
    kind = "struct<place: bigint, source: string, bidder_name: string>"
    made = met(True).select("lot_id", "bidder_masterid", F.struct(F.col("_h").alias("place"), "source", "bidder_name").cast(kind).alias("_row"))
    real = own.where("_shared").select("lot_id", "bidder_masterid", F.lit(None).cast(kind).alias("_row"))
    # A pair with an id missing equals no real one.
    known = F.col("lot_id").isNotNull() & F.col("bidder_masterid").isNotNull()
    both = made.unionByName(real).repartition("lot_id").groupBy("lot_id", "bidder_masterid").agg(F.min("_row").alias("_row"), F.bool_or(F.col("_row").isNull() & known).alias("_real"))
    of_shared = both.where(~F.col("_real") & F.col("_row").isNotNull()).select("lot_id", "bidder_masterid", "_row.bidder_name", "_row.source")
    return met(False).select(*columns).unionByName(of_shared)


def _as_negatives(keyed: DataFrame) -> DataFrame:
    return keyed.withColumns({"pair_id": F.concat_ws("_", "lot_id", "bidder_masterid"), "did_win": F.lit(0), "pair_type": F.lit("synthetic_negative")})


def shared_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs written with what ``negative_keys`` asks of their lots, so that what they were made by need not stay on disk."""
    out = materialize(_with_shared(pairs), "pairs")
    forget_shuffles(pairs.sparkSession)
    return out


def narrow_negatives(pairs: DataFrame, market: list[str]) -> DataFrame:
    """``synthetic_negatives`` with the columns of a key, its bidder's name and its kind alone: what it takes from a pair's other columns is not needed."""
    columns = ["pair_id", "lot_id", "bidder_masterid", "bidder_name", "did_win", "pair_type"]
    pairs = pairs if "_shared" in pairs.columns else shared_pairs(pairs.select(*columns, *market))
    keys = negative_keys(pairs, market)
    return pairs.select(*columns).limit(0) if keys is None else _as_negatives(keys).select(*columns)


def synthetic_negatives(pairs: DataFrame, market: list[str], target: float = 0.15, trigger: float = 0.30, most: int = 10) -> DataFrame:
    """Losing pairs (see ``negative_keys``) with all columns of ``pairs``: a pair's other columns are those of the real pair whose place it takes.

    The pairs are written once, as they are read for the counts, for both orders, to leave real pairs out and for the other columns.
    """
    asked, pairs = pairs.columns, shared_pairs(pairs)
    keys = negative_keys(pairs, market, target, trigger, most)
    if keys is None:
        return pairs.select(*asked).limit(0)
    rest = [c for c in asked if c not in ("pair_id", "lot_id", "bidder_masterid", "bidder_name", "did_win", "pair_type")]
    # One row a lot and bidder, the least, should the pairs repeat one.
    least = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_rest")
    sources = pairs.groupBy(F.col("lot_id").alias("_lot"), F.col("bidder_masterid").alias("source")).agg(least)
    full = keys.join(sources, F.col("lot_id").eqNullSafe(F.col("_lot")) & keys["source"].eqNullSafe(sources["source"]), "left").select("lot_id", "bidder_masterid", "bidder_name", "_rest.*")
    return _as_negatives(full).select(*asked)


def quota_cut(files: DataFrame, quotas: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Files in order until the quota is used: run, the first over it refused, the rest not_processed. Only consuming files count."""
    counted = running_over(files.withColumn("_one", F.col("consumes").cast("int")), [by], order, {"_used": ("sum", "_one")}, exclusive=True)
    over = F.col("_used") >= F.coalesce("remaining", F.lit(0))
    seen = counted.join(quotas, by, "left").withColumn("_over", over)
    # The order is unique in a group, so the first over the quota is the least.
    first = seen.where("_over").groupBy(F.col(by).alias("_by")).agg(F.min(F.struct(*order)).alias("_first"))
    placed = seen.join(first, F.col(by).eqNullSafe(F.col("_by")), "left")
    decision = F.when(~F.col("_over"), "run").when(F.struct(*order) == F.col("_first"), "refused").otherwise("not_processed")
    return placed.select(*files.columns, decision.alias("decision"))


def accepted_messages(messages: DataFrame, channel: str, at: list[str], number: str) -> DataFrame:
    """Messages whose number exceeds every earlier number of their channel."""
    ran = running_over(messages, [channel], at, {"_high": ("max", number)}, exclusive=True)
    return ran.where(F.col("_high").isNull() | (F.col(number) > F.col("_high"))).drop("_high")


def next_seq(events: DataFrame, pack: str, order: list[str]) -> DataFrame:
    """Each event with its number in its pack, from 1."""
    return running_over(events.withColumn("_one", F.lit(1)), [pack], order, {"seq": ("sum", "_one")}).drop("_one")
