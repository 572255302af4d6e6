"""Queries over document extraction, matching and gating.

Texts that hold the patterns are composed from the given tables, so that the oracle knows the facts from
the columns and not from another regular expression.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.common import scratch, table
from bidlake.functions import blanks as B
from bidlake.functions import documents as D
from bidlake.operators import eligibility as E
from bidlake.operators import text_gate as G
from bidlake.plans.registry import query
from bidlake.streaming.jobs import append_stream


def day(column, days, pattern="yyyy-MM-dd"):
    """A date of the tables, so many days later and in the years that notices are of."""
    return F.date_format(F.col(column) + F.expr("INTERVAL 30 YEARS") + F.expr(f"INTERVAL {days} DAYS"), pattern)


def notices(spark, sf_dir):
    """One notice an order: value, bid, briefing, closing and end of validity, system stated or not, goals, threshold, procedure, supply."""
    o, k, status = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3, F.col("o_orderstatus")
    cents = lambda c: F.format_string("%.2f", F.col(c))
    closing = F.when(k == 0, F.concat(F.lit("The closing date and time: "), day("o_orderdate", 21, "d/M/yyyy"), F.lit(" at 11h00"))).when(k == 1, F.concat(F.lit("Deadline for all bids is  "), day("o_orderdate", 21, "d  MMMM yyyy"))).otherwise(F.concat(F.lit("SUBMISSION DATE "), day("o_orderdate", 21)))
    system = F.when(status == "F", "The applicable preference point system is 80/20").when(status == "O", "This bid will be evaluated on the 90/10 scale").otherwise("Both 80/20 and 90/10 are known")
    kind = F.when(k == 0, "Request for quotation: consulting").when(k == 1, "Invitation to bid for construction of roads").otherwise("Supply and delivery of pumps")
    text = F.concat(
        F.lit("Terms of reference. Estimated value: R "), cents("o_totalprice"), F.lit(". Bid price: R "), F.format_string("%.2f", F.floor(F.col("o_totalprice") / 2).cast("double")), F.lit(".\nA site meeting (all bidders) is on "), day("o_orderdate", 0),
        F.lit(".\n"), closing, F.lit(".\nValidity period until "), day("o_orderdate", 111), F.lit(".\n"), system, F.lit(", and R 50,000,000.00 is the limit. Specific goals"), F.when(status == "O", " of women").otherwise(""),
        F.lit(".\nBidders must score at least 70 points. "), kind, F.lit("."),
    )
    return o.select("o_orderkey", "o_custkey", "o_totalprice", text.alias("text"))


@query("d1_extract_money", """WITH v AS (SELECT o_orderkey, o_custkey % 3 AS k, round(o_totalprice, 2) AS v, CAST(floor(o_totalprice / 2) AS DOUBLE) AS b FROM orders), f AS (
SELECT *, list_filter(CASE k WHEN 0 THEN [v, b] WHEN 1 THEN [v, b] ELSE [b] END, lambda x: x > 1000 AND x <> 50000000) AS a FROM v)
SELECT o_orderkey, CASE WHEN k = 0 THEN v WHEN list_max(a) > list_min(a) THEN list_max(a) END AS value, CASE WHEN k = 0 THEN b ELSE list_min(a) END AS bid, CAST(len(list_distinct(a)) AS INTEGER) AS n_amounts FROM f""")
def extract_money(spark, sf_dir):
    """Notices with labelled amounts, with two amounts without labels, and with one."""
    kind, plain = F.col("o_custkey") % 3, table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("v"), F.format_string("%.2f", F.floor(F.col("o_totalprice") / 2).cast("double")).alias("b"))
    loose = F.when(kind == 1, F.concat(F.lit("For R "), "v", F.lit(" or ZAR "), "b", F.lit("; the limit of R 50,000,000.00 stands."))).otherwise(F.concat(F.lit("Up to $ "), "b", F.lit(".")))
    out = notices(spark, sf_dir).join(plain, "o_orderkey").select("o_orderkey", D.extract_money(F.when(kind == 0, F.col("text")).otherwise(loose), small=True).alias("m"))
    return out.select("o_orderkey", F.col("m.value").alias("value"), F.col("m.bid").alias("bid"), F.size("m.amounts").alias("n_amounts"))


@query("d2_extract_dates", """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 30 YEAR AS d FROM orders)
SELECT o_orderkey, CAST(d AS DATE) AS briefing, CAST(d + INTERVAL 21 DAY AS DATE) AS closing, CAST(d + INTERVAL 111 DAY AS DATE) AS award, CAST(greatest(0, date_diff('day', DATE '2028-01-01', CAST(d + INTERVAL 21 DAY AS DATE))) AS INTEGER) AS deadline_days FROM o""")
def extract_dates(spark, sf_dir):
    return notices(spark, sf_dir).select("o_orderkey", D.extract_dates(F.col("text"), F.lit("2028-01-01").cast("date")).alias("d")).select("o_orderkey", "d.*")


@query("d3_extract_terms", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '80/20' WHEN 'O' THEN '90/10' ELSE CASE WHEN o_totalprice < 50000000 THEN '80/20' ELSE '90/10' END END AS system, o_orderstatus NOT IN ('F', 'O') AS low_confidence, CASE WHEN o_orderstatus = 'O' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS goals_ratio,
CAST(70 AS INTEGER) AS functionality, CASE o_custkey % 3 WHEN 0 THEN 'RFQ' WHEN 1 THEN 'Open' END AS procedure, CASE o_custkey % 3 WHEN 0 THEN 'Services' WHEN 1 THEN 'Works' ELSE 'Goods' END AS supply FROM orders""")
def extract_terms(spark, sf_dir):
    return notices(spark, sf_dir).select("o_orderkey", D.extract_terms(F.col("text"), D.extract_money(F.col("text"))["value"]).alias("t")).select("o_orderkey", "t.*")


@query("d4_completeness", """WITH p AS (SELECT o_orderkey, o_custkey % 2 = 1 AS value, o_custkey % 2 = 1 AND (o_custkey % 3 = 0 OR floor(o_totalprice / 2) < 1000) AS bid, o_custkey % 5 = 0 AS closing, o_orderstatus = 'P' AS procedure, o_orderkey % 4 = 0 AS supply FROM orders)
SELECT o_orderkey, (7 - value::INT - bid::INT - closing::INT - procedure::INT - supply::INT) / 7.0::DOUBLE AS share, array_to_string(list_filter([CASE WHEN value THEN 'tender_value' END, CASE WHEN bid THEN 'bid_price' END, CASE WHEN closing THEN 'deadline_days' END,
CASE WHEN procedure THEN 'tender_proceduretype' END, CASE WHEN supply THEN 'tender_supplytype' END], lambda x: x IS NOT NULL), ',') AS missing, value OR bid OR value::INT + bid::INT + closing::INT + procedure::INT + supply::INT > 3 AS incomplete FROM p""")
def completeness(spark, sf_dir):
    """Notices that lack any of their parts."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    part = lambda shown, *text: F.when(shown, F.concat(*text)).otherwise("")
    text = F.concat(
        F.lit("Notice. "), part(k % 2 == 0, F.lit("Estimated value: R "), F.format_string("%.2f", "o_totalprice"), F.lit(". ")), part(k % 3 > 0, F.lit("Bid price: R "), F.format_string("%.2f", F.floor(F.col("o_totalprice") / 2).cast("double")), F.lit(". ")),
        part(k % 5 > 0, F.lit("Closing date: "), day("o_orderdate", 0), F.lit(". ")), F.when(F.col("o_orderstatus") == "F", "An RFQ. ").when(F.col("o_orderstatus") == "O", "An open tender. ").otherwise(""), part(F.col("o_orderkey") % 4 > 0, F.lit("For maintenance.")),
    )
    out = o.select("o_orderkey", D.extract_money(text).alias("m"), D.extract_dates(text, F.lit("1998-01-01").cast("date")).alias("d"), D.extract_terms(text).alias("t"))
    found = D.completeness(F.col("m"), F.col("d"), F.col("t"))
    return out.select("o_orderkey", found["share"].alias("share"), F.array_join(found["missing"], ",").alias("missing"), found["incomplete"].alias("incomplete"))


COMPANY_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'MAAA' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') END AS supplier_number, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 9 WHEN s_suppkey % 5 = 1 THEN s_suppkey % 8 + 1 WHEN s_suppkey % 5 = 2 THEN 1 WHEN s_suppkey % 5 = 3 THEN 2 END AS INTEGER) AS level,
'2001/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '/07' AS registration, CASE WHEN s_suppkey % 4 > 0 THEN 'FIRM ' || s_suppkey || ' (PTY) LTD' END AS company_name, CASE WHEN s_suppkey % 7 = 0 THEN 'Engineering Services,Road Construction' WHEN s_suppkey % 7 = 1 THEN 'Road Construction' ELSE '' END AS commodities,
CASE WHEN s_suppkey % 2 = 0 THEN 'Civil works' WHEN s_suppkey % 7 = 0 THEN 'Engineering Services' WHEN s_suppkey % 7 = 1 THEN 'Road Construction' END AS industry, CASE WHEN s_suppkey % 6 = 1 THEN '4GB' WHEN s_suppkey % 6 = 2 THEN '7CE' END AS cidb_grade FROM supplier"""


def companies(spark, sf_dir):
    """Reports with and without each part; non-compliance counts only where nothing else tells the level."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    level = F.when(k % 5 == 0, "The firm is non-compliant").when(k % 5 == 1, F.concat(F.lit("B-BBEE Status Level of Contributor: Level "), (k % 8 + 1).cast("string"), F.lit(", never non-compliant"))).when(k % 5 == 2, "% Owned by black people 100.00").when(k % 5 == 3, "% Owned by black people 60.50").otherwise("Nothing is stated")
    number = F.when(k % 3 > 0, F.concat(F.lit(" number maaa"), F.lpad(k.cast("string"), 7, "0"))).otherwise("")
    name = F.when(k % 4 > 0, F.concat(F.lit("\nLegal Name: Firm  "), k.cast("string"), F.lit(" (Pty) Ltd\n"))).otherwise("\nEnterprise Name: Postal box\n")
    trade = F.when(k % 7 == 0, "Segment: 81000000 - Engineering Services\n72141000 Road Construction\nClass: Engineering  Services\n").when(k % 7 == 1, "72141000 Road Construction\n").otherwise("")
    industry, grade = F.when(k % 2 == 0, "Nature of Business: Civil works\n").otherwise(""), F.when(k % 6 == 1, "Grading 4 GB").when(k % 6 == 2, "Grading 7CE").otherwise("Grading 7XX")
    return s.select("s_suppkey", F.concat(F.lit("Central supplier database report"), number, F.lit(". Registration 2001/"), F.lpad(k.cast("string"), 6, "0"), F.lit("/07. "), level, F.lit("."), name, trade, industry, grade).alias("text"))


@query("d5_extract_company", COMPANY_SQL)
def extract_company(spark, sf_dir):
    found = companies(spark, sf_dir).select("s_suppkey", D.extract_company(F.col("text")).alias("c")).select("s_suppkey", "c.*")
    return found.withColumn("commodities", F.array_join("commodities", ","))


@query("d24_accreditation_gaps", f"""WITH c AS ({COMPANY_SQL}) SELECT s_suppkey, CAST(CASE WHEN level IN (1, 2, 3, 4) THEN 3 WHEN level IN (5, 6) THEN 2 ELSE 1 END AS INTEGER) AS priority,
CASE WHEN level IN (1, 2) THEN 'level gives most points' WHEN level IN (3, 4) THEN 'level is competitive, a better one gives most points' WHEN level IN (5, 6) THEN 'level is below average, improve it' WHEN level IN (7, 8) THEN 'level is not competitive, improve it before large bids' ELSE 'no level, no points' END AS advice FROM c
UNION ALL SELECT s_suppkey, 1, 'register on the central supplier database' FROM c WHERE supplier_number IS NULL UNION ALL SELECT s_suppkey, 2, 'obtain a grading for works' FROM c WHERE cidb_grade IS NULL AND regexp_matches(lower(coalesce(industry, '')), 'construction|works')""")
def accreditation_gaps(spark, sf_dir):
    return D.accreditation_gaps(companies(spark, sf_dir).select("s_suppkey", D.extract_company(F.col("text")).alias("c")).select("s_suppkey", "c.*"), "s_suppkey")


TYPE_TEXTS = (
    "Your CSD report number", "Issued by an accredited B-BBEE body", "SARS tax PIN letter", "Grading designation 4GB", "Form CK2 of the close corporation", "A letter of Nedbank", "A testimonial by a client",
    "Printout of prices", "Tax compliance status and cidb grade", "",
)


@query("d6_document_type", """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'CSD_CERT' WHEN 1 THEN 'BBBEE_CERT' WHEN 2 THEN 'TAX_CLEARANCE' WHEN 3 THEN 'CIDB_CERT' WHEN 4 THEN 'CIPC_COR14_3' WHEN 5 THEN 'BANK_STATEMENT' WHEN 6 THEN 'TRACK_RECORD_LETTER' WHEN 8 THEN 'TAX_CLEARANCE' ELSE 'UNKNOWN' END AS type,
CASE p_partkey % 10 WHEN 7 THEN 0.2 WHEN 8 THEN 0.75 WHEN 9 THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, CASE p_partkey % 10 WHEN 0 THEN 'CSD_CERT' WHEN 1 THEN 'BBBEE_CERT' WHEN 2 THEN 'TAX_CLEARANCE' WHEN 3 THEN 'CIDB_CERT' WHEN 4 THEN 'CIPC_COR14_3' WHEN 5 THEN 'BANK_STATEMENT' WHEN 6 THEN 'TRACK_RECORD_LETTER' WHEN 8 THEN 'TAX_CLEARANCE,CIDB_CERT' ELSE '' END AS hits FROM part""")
def document_type(spark, sf_dir):
    """One text a part: of each type, of none, of two, and empty."""
    text = F.element_at(F.array(*map(F.lit, TYPE_TEXTS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", D.document_type(text).alias("t"))
    return found.select("p_partkey", "t.type", "t.confidence", F.array_join("t.hits", ",").alias("hits"))


@query("d7_region", """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'UK' WHEN 1 THEN 'UK' WHEN 2 THEN 'UK' WHEN 6 THEN 'UK' ELSE 'ZA' END AS region, CASE WHEN c_custkey % 7 IN (0, 1, 2, 6) THEN 'MEAT PCR 2015' ELSE 'PPPFA 80/20 & 90/10' END AS framework,
CASE WHEN c_custkey % 7 IN (0, 1, 2, 6) THEN 'Ensure CPV code alignment' ELSE 'Verify Tax Clearance Pin' END AS first_advice FROM customer""")
def region(spark, sf_dir):
    """Notices that name a region by a sign, by words, by currency, by both, or not at all."""
    k = F.col("c_custkey") % 7
    text = F.when(k == 0, "Value £5,000").when(k == 1, "See Contracts Finder.").when(k == 3, "Paid in rands").when(k == 4, "The PPPFA applies").when(k == 6, "United Kingdom or South Africa").otherwise("A notice")
    found = table(spark, sf_dir, "customer").select("c_custkey", D.region(text, F.when(k == 2, "gbp").when(k == 6, "ZAR")).alias("r"))
    return found.select("c_custkey", "r.region", "r.framework", F.col("r.recommendations")[0].alias("first_advice"))


@query("d8_normalize_label", "SELECT s_suppkey, 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key FROM supplier")
def normalize_label(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.normalize_label(F.concat(F.lit("1.2) "), F.regexp_replace("s_name", "Supplier", "Sùpplïér"), F.lit(" (if any): ....."))).alias("key"))


# Label, canonical field, heading, context, and the reason that must come out.
BLANKS = (
    ("SIGNATURE OF BIDDER", None, None, "form", "signature"), ("Capacity under which this bid is signed", None, None, "form", None), ("Getuie 1", None, None, "form", "signature"), ("________", None, None, "form", "signature"),
    ("Family member who is employed", None, None, "form", "declaration"), ("Company names", None, None, "declaration", None), ("Full name", None, None, "declaration", "declaration"), ("Full name", None, None, "form", None),
    ("Dated at", None, None, "form", "signing_date"), ("Closing date", None, None, "form", None), ("TOTAL BID PRICE", None, None, "form", "pricing"), ("Total number of items", None, None, "form", None), ("R ......", None, None, "form", "pricing"),
    ("Method statement", None, None, "form", "narrative"), ("Total number of items and comments", None, None, "form", "narrative"), (" ", None, None, "form", "empty"), (None, None, "Enquiries", "form", "empty"),
    ("Telephone number", None, "Enquiries may be DIRECTED TO", "form", "counterparty"), ("Telephone number", None, "Supplier information", "form", None), ("Offer", "bid_amount", None, "form", "pricing"), ("", "signature_date", "Issued by", "form", "signing_date"),
)
BLANKS_SQL = "[" + ", ".join("NULL" if b[4] is None else f"'{b[4]}'" for b in BLANKS) + "]"


def cycled(number, rows, column):
    return F.get(F.array(*[F.lit(r[column]).cast("string") for r in rows]), (number % len(rows)).cast("int"))


@query("d14_block_rules", f"SELECT event_id, {BLANKS_SQL}[event_id % {len(BLANKS)} + 1] AS reason FROM events")
def block_rules(spark, sf_dir):
    label, canonical, section, context = (cycled(F.col("event_id"), BLANKS, c) for c in range(4))
    return table(spark, sf_dir, "events").select("event_id", B.block_reason(label, context, canonical, section).alias("reason"))


# Label, status of its look-up, and the explanation that must come out.
UNFILLED = (
    ("If so, furnish particulars", "prose_fragment", "declaration"), ("Identity Number of director", "blocked", "declaration"), ("Any relationship (family, friend)?", "unmatched", "declaration"), ("R", "unmatched", "pricing_cell"), (" r : ", "blocked", "pricing_cell"),
    ("Delivery period", "unmatched", "tender_terms"), ("Warranty offered", "ambiguous", "tender_terms"), ("hereby certify", "prose_fragment", "prose"), ("Name", "blocked", "ambiguous_label"), ("Registration", "ambiguous", "ambiguous_label"), ("Colour", "unmatched", "unmatched"),
    ("Rand", "low_corroboration", "unmatched"), ("  ", "blocked", "unmatched"), (None, None, "unmatched"),
)


@query("d16_explain_unfilled", f"SELECT event_id, [{', '.join(repr(u[2]) for u in UNFILLED)}][event_id % {len(UNFILLED)} + 1] AS why FROM events")
def explain_unfilled(spark, sf_dir):
    label, status = (cycled(F.col("event_id"), UNFILLED, c) for c in range(2))
    return table(spark, sf_dir, "events").select("event_id", D.explain_unfilled(label, status).alias("why"))


FIELDS = [*D.WHITELIST, "bank_account", None]
HELD = (None, " Pending ", " x ", "9", '[{"name": "Ann B", "id_number": "80"}, {"name": " C "}, {"id_number": "1"}]')


@query("d17_fill_decisions", f"""WITH e AS (SELECT event_id, event_type, value / 5 AS score, [{', '.join('NULL' if f is None else repr(f) for f in FIELDS)}][event_id % {len(FIELDS)} + 1] AS field, [NULL, ' Pending ', ' x ', '9', '{HELD[4]}'][event_id % 5 + 1] AS held FROM events), v AS (
SELECT *, CASE WHEN field = 'director_names_and_id_numbers' THEN CASE WHEN held LIKE '[%' THEN 'Ann B (80); C' END WHEN held IS NULL OR held = ' Pending ' THEN NULL WHEN field = 'bbbee_level' AND held = '9' THEN NULL ELSE trim(held) END AS drawn FROM e), d AS (
SELECT *, CASE WHEN event_type = 'click' THEN 'blocked' WHEN field IS NULL THEN 'no_match' WHEN field = 'bank_account' THEN 'not_whitelisted' WHEN score < 88 THEN 'low_score' WHEN drawn IS NULL THEN 'no_value' ELSE 'fill' END AS decision FROM v)
SELECT event_id, decision, CASE WHEN decision = 'fill' THEN drawn END AS value, decision = 'low_score' OR (decision = 'fill' AND field IN ('bbbee_level', 'capacity')) AS low_confidence FROM d""")
def fill_decisions(spark, sf_dir):
    """Every field of the whitelist and two that are not on it, with and without values, placeholders and a list of directors."""
    field, held = cycled(F.col("event_id"), [(f,) for f in FIELDS], 0), cycled(F.col("event_id"), [(h,) for h in HELD], 0)
    decision = D.fill_decision(F.when(F.col("event_type") == "click", "signature"), field, F.col("value") / 5, held)
    return table(spark, sf_dir, "events").select("event_id", decision.alias("d")).select("event_id", "d.decision", "d.value", "d.low_confidence")


@query("d18_null_sentinels", "SELECT doc_id, CASE WHEN doc_id % 21 >= 19 THEN source END AS source, CAST(CASE WHEN doc_id % 10 NOT IN (0, 9) THEN doc_id % 10 END AS INTEGER) AS level FROM documents")
def null_sentinels(spark, sf_dir):
    """Each placeholder in turn, a blank, and sources as they are; levels 0 to 9."""
    held = F.get(F.array(*map(F.lit, [f" {x.title()} " for x in D.SENTINELS] + ["  "])), (F.col("doc_id") % 21).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", D.null_sentinels(F.when(F.col("doc_id") % 21 < 19, held).otherwise(F.col("source"))).alias("source"), D.null_level((F.col("doc_id") % 10).cast("int")).alias("level"))


# Label, and whether it is a field.
LABELS = (
    ("Name of bidder (tenderer)", True), ("Of:", False), ("yes", False), ("I, the undersigned, being a director", False), ("KINDLY NOTE the venue", False), ("Attach the certificate;", False), ("Price schedule –", False), ("of this tender", False), ("email", True),
    ("80", False), ("R 1,000.00", False), ("20 %", False), ("\t \n", False), (None, False), ("Value of work inclusive of tax (Rand)", True), ("VAT 15", True), ("A long caption of more than a dozen words that asks for one thing only, once", True),
)
LABELS_SQL = "[" + ", ".join(str(ok).lower() for _, ok in LABELS) + "]"


@query("d13_fillable", f"SELECT event_id, {LABELS_SQL}[event_id % {len(LABELS)} + 1] AS fillable FROM events")
def fillable(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.fillable(cycled(F.col("event_id"), LABELS, 0)).alias("fillable"))


@query("d20_validate_profiles", """WITH c AS (SELECT c_custkey, c_custkey % 2 AS e, c_custkey % 7 AS l, c_custkey % 5 AS a, c_custkey % 11 AS p FROM customer)
SELECT c_custkey, 'email' AS field, CAST(c_custkey AS VARCHAR) || '@x' AS value, 'format' AS problem FROM c WHERE e = 1 UNION ALL SELECT c_custkey, 'level', '9', 'format' FROM c WHERE l = 0
UNION ALL SELECT c_custkey, 'address', 'Road 1', 'format' FROM c WHERE a = 0 UNION ALL SELECT c_custkey, 'address', ' ', 'missing' FROM c WHERE a = 1 UNION ALL SELECT c_custkey, 'phone', '+27 82 123', 'format' FROM c WHERE p = 0""")
def validate_profiles(spark, sf_dir):
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(k, F.when(n % 2 == 1, "@x").otherwise("@x.org")).alias("email"), F.when(n % 7 == 0, "9").when(n % 7 == 1, "Level 3 Contributor").when(n % 7 == 2, "Non-compliant").otherwise("3").alias("level"),
        F.when(n % 11 == 0, "+27 82 123").when(n % 11 > 3, "(082) 123-4567").alias("phone"), F.when(n % 5 == 0, "Road 1").when(n % 5 == 1, " ").otherwise("Long Road 12, 0001").alias("address"), F.lit("4 123 456 789").alias("vat_number"),
    )
    return D.validate_profiles(c, "c_custkey", ["address", "email"])


@query("d21_valid_sa_id", "SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")
def valid_sa_id(spark, sf_dir):
    number = F.when(F.col("c_custkey") % 2 == 0, "8001015009087").otherwise("8001015009088")
    return table(spark, sf_dir, "customer").select("c_custkey", D.valid_sa_id(number).alias("valid"))


@query("d21_validate_directors", """WITH c AS (SELECT c_custkey, c_custkey % 6 AS k FROM customer)
SELECT c_custkey, CAST(-1 AS INTEGER) AS position, 'directors' AS field, 'missing' AS problem FROM c WHERE k IN (0, 1, 2) UNION ALL SELECT c_custkey, 0, 'id_number', 'invalid' FROM c WHERE k = 4
UNION ALL SELECT c_custkey, 0, 'is_state_employee', 'missing' FROM c WHERE k = 4 UNION ALL SELECT c_custkey, 1, 'id_number', 'passport' FROM c WHERE k = 4 UNION ALL SELECT c_custkey, 0, 'name', 'missing' FROM c WHERE k = 5 UNION ALL SELECT c_custkey, 0, 'id_number', 'missing' FROM c WHERE k = 5""")
def validate_directors(spark, sf_dir):
    """No list, an empty one, a broken one, a good one, and two with problems."""
    k = F.col("c_custkey") % 6
    lists = F.when(k == 1, "[]").when(k == 2, "no list").when(k == 3, '[{"name": "Ann B", "id_number": "800101 5009087", "is_state_employee": false}]').when(
        k == 4, '[{"name": "Cid D", "id_number": "8001015009088"}, {"name": "Eve F", "id_number": "P12X", "is_state_employee": "Yes"}]'
    ).when(k == 5, '[{"name": "G", "is_state_employee": true}]')
    return D.validate_directors(table(spark, sf_dir, "customer").select("c_custkey", lists.alias("directors")), "c_custkey")


@query("d22_profile_diff", """SELECT c_custkey, 'c_name' AS field, 'changed' AS status, CASE WHEN c_custkey % 9 > 0 THEN c_name END AS before, c_name || '!' AS after FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'c_name', 'changed', NULL, c_name FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 9 = 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'changed', NULL, c_mktsegment FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, 'directors', 'changed', CASE WHEN c_custkey % 9 > 0 THEN '{"a":1,"b":[2]}' END, CASE WHEN c_custkey % 5 > 0 THEN '{"a":1,"b":[2]}' ELSE '{"a":2}' END FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 'rating', 'ignored', NULL, 'A' FROM customer WHERE c_custkey % 6 = 0""")
def profile_diff(spark, sf_dir):
    """Names that change, companies without profile, JSON that says the same in other words, and a field that may not be written."""
    c, k = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    current = c.where(k % 9 > 0).withColumn("directors", F.lit('{"a":1, "b":[2]}'))
    proposed = c.withColumns({"c_name": F.when(k % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), "directors": F.when(k % 5 > 0, '{"b": [2],  "a": 1}').otherwise('{"a": 2}'), "rating": F.when(k % 6 == 0, "A")})
    return D.profile_diff(current, proposed, "c_custkey", ["c_name", "c_mktsegment", "directors"], ["directors"])


@query("d12_lessons", """WITH l AS (SELECT user_id AS company_id, event_type AS key, CASE WHEN event_id % 5 = 0 THEN 'not_a_field' ELSE 'mapping' END AS kind, ts, event_id FROM events)
SELECT company_id, key, max_by(kind, (ts, event_id)) AS kind, count(*) AS occurrences FROM l GROUP BY 1, 2""")
def lessons(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 5 == 0, "not_a_field").otherwise("mapping").alias("kind"), F.lit("email").alias("canonical_field"), F.struct("ts", "event_id").alias("taught_at"))
    return D.lessons(log).select("company_id", "key", "kind", "occurrences")


@query("d11_apply_lessons", "SELECT user_id AS company_id, event_id, CASE WHEN event_type = 'view' THEN 'phone' WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN 'email' ELSE 'address' END AS canonical FROM events")
def apply_lessons(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("label"), "event_id")
    taught = events.select("company_id", F.col("label").alias("key")).distinct().where("key IN ('view', 'click', 'error')").select("*", F.when(F.col("key") == "click", "not_a_field").otherwise("mapping").alias("kind"), F.when(F.col("key") != "click", "email").alias("canonical_field"))
    kinds = events.select("company_id", "label").distinct().select("*", (F.col("label") == "view").alias("confident"), F.when(F.col("label") == "view", "phone").otherwise("address").alias("canonical"))
    return events.join(D.apply_lessons(kinds, taught), ["company_id", "label"]).select("company_id", "event_id", "canonical")


@query("d19_resolve_ambiguous", "SELECT c_custkey AS company_id, 'contact' AS label, 'x' || c_nationkey AS value FROM customer WHERE c_custkey % 3 <> 1")
def resolve_ambiguous(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("value"))
    second = F.when(F.col("company_id") % 3 == 0, F.col("value")).when(F.col("company_id") % 3 == 1, F.lit("other")).otherwise(" ")
    profile = c.select("company_id", F.lit("email").alias("field"), "value").unionByName(c.select("company_id", F.lit("phone").alias("field"), second.alias("value")))
    return D.resolve_ambiguous(c.select("company_id", F.lit("contact").alias("label"), F.array(F.lit("email"), F.lit("phone")).alias("fields")), profile)


ALIASES = [("Company name", "company_name", 0), ("Name of company", "company_name", 1), ("E-mail address", "email", 2), ("Telephone number", "phone", 3), ("VAT number", "vat_number", 4)]


@query("d9_match_labels_exact", "SELECT event_id, CASE event_type WHEN 'view' THEN 'company_name' WHEN 'purchase' THEN 'email' END AS canonical FROM events WHERE event_type <> 'signup'")
def match_labels_exact(spark, sf_dir):
    kind = F.col("event_type")
    label = F.when(kind == "view", "2. NAME OF COMPANY (full):").when(kind == "purchase", "e-mail  address").when(kind == "signup", "Page").otherwise("Closing time")
    labels = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, position int")
    return D.match_labels_exact(labels, aliases, spark.createDataFrame([("page",)], "key string")).select("event_id", "canonical")


@query("d10_match_labels_fuzzy", "SELECT DISTINCT CASE event_type WHEN 'view' THEN 'telephone numbre' WHEN 'click' THEN 'email adress' ELSE 'closing time' END AS key, CASE event_type WHEN 'view' THEN 'matched' WHEN 'click' THEN 'matched' ELSE 'unmatched' END AS status FROM events")
def match_labels_fuzzy(spark, sf_dir):
    kind = F.col("event_type")
    label = F.when(kind == "view", "Telephone numbre").when(kind == "click", "E-mail adress").otherwise("Closing time")
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, position int")
    return D.match_labels_fuzzy(table(spark, sf_dir, "events").select(label.alias("label")), aliases).select("key", "status")


@query("d10_match_captions")
def match_captions(spark, sf_dir):
    """Captions of the links of all pages against those that three pages or more use."""
    caption = F.explode(F.regexp_extract_all("html", F.lit(r"<a href=[^>]*>([^<]+)</a>"), F.lit(1)))
    links = table(spark, sf_dir, "pages").select("page_id", caption.alias("label")).distinct()
    aliases = links.groupBy("label").count().where("count > 2").select(F.col("label").alias("alias"), D.normalize_label(F.col("label")).alias("canonical"), F.col("label").alias("position"))
    return D.match_labels_fuzzy(links, aliases)


@query("j10_label_lookup", """SELECT event_id, CASE event_type WHEN 'view' THEN 'phone' WHEN 'click' THEN 'email' END AS canonical,
CASE event_type WHEN 'view' THEN 'matched' WHEN 'click' THEN 'exact' WHEN 'purchase' THEN 'blocked' WHEN 'error' THEN 'prose_fragment' ELSE 'unmatched' END AS status FROM events""")
def label_lookup(spark, sf_dir):
    """Labels that are near an alias, equal to one, too general, prose, and unlike any."""
    kind = F.col("event_type")
    label = F.when(kind == "view", "iv) Telephone numbre ....").when(kind == "click", "E\u2013Mail Address").when(kind == "purchase", "Full Names:").when(kind == "error", "In the name of company").otherwise("Closing time")
    labels = table(spark, sf_dir, "events").select("event_id", label.alias("label")).withColumn("key", D.normalize_label(F.col("label")))
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string, position int")
    return labels.join(D.label_lookup(labels, aliases), "key").select("event_id", "canonical", "status")


def tenders(spark, sf_dir):
    """One tender text an order: a scorecard with or without points for a past, a place, papers, a briefing; a few are blank."""
    n = F.col("o_orderkey")
    card = (
        "Evaluation criteria: Functionality\nThe minimum qualifying score of 80% is required to be eligible.\nPast contract track record: Max points 30\nExperience of the team 15\n",
        "Bidders must score at least 40 points.\nScorecard\nTrack record weight: 50\nPlant weight: 50\n", "Past contracts: max points 90\nFunctionality threshold 60%\n", "A quotation is invited.\n",
    )
    place = ("Must be registered in eThekwini municipality.\n", "Offices located in the Western Cape province.\n", "", "", "")
    papers = ("Registration on the CSD is welcome.\n", "Bidders must be registered on the Central Supplier Database and with the CIDB.\n", "Bids without a tax clearance will be read; a compulsory SARS PIN is asked for.\n")
    visit = ("A compulsory site meeting will be held in Durban, KwaZulu-Natal.\n", "No visit in Gauteng.\n")
    of = lambda parts, k: F.element_at(F.array(*map(F.lit, parts)), (k % len(parts) + 1).cast("int"))
    text = F.concat(of(card, F.col("o_custkey")), of(place, n), of(papers, F.col("o_custkey") + n), of(visit, F.floor(n / 2)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 11 > 0, text).alias("text"))


def firms(spark, sf_dir):
    """Suppliers with or without wins, seats and papers."""
    k = F.col("s_suppkey")
    town, province = F.when(k % 4 == 0, "eThekwini").when(k % 4 == 1, "City of Cape Town").when(k % 4 == 3, "Johannesburg"), F.when(k % 4 == 0, "KwaZulu-Natal").when(k % 4 == 1, "Western Cape").otherwise("Gauteng")
    papers = [(k % 5 != 0).alias("has_csd"), (k % 5 != 1).alias("has_cidb"), F.when(k % 3 > 0, k % 3 == 1).alias("has_tax_clearance")]
    return table(spark, sf_dir, "supplier").select("s_suppkey", (k % 2).cast("int").alias("pit_total_wins"), town.alias("municipality"), province.alias("province"), *papers)


@query("d23_eligibility", """WITH o AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 4 END AS card, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 5 END AS place, CASE WHEN o_orderkey % 11 > 0 THEN (o_custkey + o_orderkey) % 3 END AS papers, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey // 2) % 2 END AS visit, count(*) AS n FROM orders GROUP BY ALL), p AS (
SELECT s_suppkey, n, coalesce(card = 0 AND s_suppkey % 2 = 0, false) AS functionality, coalesce((place = 0 AND s_suppkey % 4 IN (1, 3)) OR (place = 1 AND s_suppkey % 4 IN (0, 3)), false) AS locality,
coalesce(papers = 1 AND s_suppkey % 5 = 0, false) AS csd, coalesce(papers = 1 AND s_suppkey % 5 = 1, false) AS cidb, coalesce(papers = 2 AND s_suppkey % 3 = 2, false) AS tax, coalesce(visit = 0 AND s_suppkey % 4 <> 0 AND NOT (place = 1 AND s_suppkey % 4 = 1), false) AS far FROM o, supplier)
SELECT s_suppkey, CAST(coalesce(sum(n) FILTER (NOT (functionality OR locality OR csd OR cidb OR tax)), 0) AS BIGINT) AS eligible, CAST(coalesce(sum(n) FILTER (functionality), 0) AS BIGINT) AS functionality, CAST(coalesce(sum(n) FILTER (locality), 0) AS BIGINT) AS locality,
CAST(coalesce(sum(n) FILTER (csd), 0) AS BIGINT) AS csd, CAST(coalesce(sum(n) FILTER (cidb), 0) AS BIGINT) AS cidb, CAST(coalesce(sum(n) FILTER (tax), 0) AS BIGINT) AS tax, CAST(coalesce(sum(n) FILTER (far), 0) AS BIGINT) AS far, CAST(sum(n) AS BIGINT) AS tenders FROM p GROUP BY 1""")
def eligibility(spark, sf_dir):
    """For each supplier, how many of all tenders it may bid on, and why it may not; counted on classes, no pair of rows is made."""
    found = E.eligibility(tenders(spark, sf_dir), firms(spark, sf_dir))
    held = found.classes.join(found.docs.groupBy("tender_class").agg(F.count("*").alias("n")), "tender_class")
    sums = {"eligible": F.col("eligible"), **{f: F.array_contains("hard_failures", f) for f in ("functionality", "locality", "csd", "cidb", "tax")}, "far": F.size("warnings") > 0, "tenders": F.lit(True)}
    by_class = held.groupBy("firm_class").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in sums.items()])
    return found.firms.select("s_suppkey", "firm_class").join(by_class, "firm_class").drop("firm_class")


@query("d23_eligible_pairs", """WITH o AS (SELECT *, o_custkey % 4 AS card, o_orderkey % 5 AS place, (o_custkey + o_orderkey) % 3 AS papers FROM orders WHERE o_orderdate >= DATE '1998-07-01' AND o_orderkey % 11 > 0), p AS (
SELECT o_orderkey, s_suppkey, array_to_string(list_filter([CASE WHEN card = 0 AND s_suppkey % 2 = 0 THEN 'functionality' END, CASE WHEN (place = 0 AND s_suppkey % 4 IN (1, 3)) OR (place = 1 AND s_suppkey % 4 IN (0, 3)) THEN 'locality' END,
CASE WHEN papers = 1 AND s_suppkey % 5 = 0 THEN 'csd' END, CASE WHEN papers = 1 AND s_suppkey % 5 = 1 THEN 'cidb' END, CASE WHEN papers = 2 AND s_suppkey % 3 = 2 THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS failures FROM o, supplier)
SELECT o_orderkey, s_suppkey, failures FROM p WHERE failures LIKE '%,%,%'""")
def eligible_pairs(spark, sf_dir):
    """Pairs of the newest tenders and firms that fail in three ways or more."""
    newest = tenders(spark, sf_dir).join(table(spark, sf_dir, "orders").where("o_orderdate >= DATE '1998-07-01'").select("o_orderkey"), "o_orderkey", "left_semi")
    found = E.eligibility(newest, firms(spark, sf_dir))
    worst = found.classes.where(F.size("hard_failures") > 2).select("tender_class", "firm_class", F.array_join("hard_failures", ",").alias("failures"))
    return E.Eligibility(found.docs, found.firms, worst).pairs().select("o_orderkey", "s_suppkey", "failures")


@query("d25_head_gate", "SELECT doc_id, CASE WHEN length(trim(substring(coalesce(text, ''), 1, 1500))) < 40 THEN 'unreadable' WHEN quality = 1 THEN 'tender' ELSE 'not_tender' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def head_gate(spark, sf_dir):
    """Every document by a score that comes with it: its quality label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", G.head_gate(F.col("text"), F.col("quality").cast("double")).alias("verdict"))


@query("d25_head_classifier")
def head_classifier(spark, sf_dir):
    """Every document by the classifier, fitted on the labelled ones, saved and loaded; run as a stream of files."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "gate")
    G.save(G.fit_gate(docs.join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("quality").alias("label"))), f"{path}/model")
    model = G.load(f"{path}/model")
    docs.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{path}/in")
    append_stream(G.gate(stream, model), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")
