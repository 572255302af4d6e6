"""Extraction, classification and gating of tender texts, as column expressions.

Patterns stay in the common subset of Java and RE2. A null text gives null or empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.scoring import evaluation_system
from bidlake.operators import fuzzy
from bidlake.operators.eligibility import THRESHOLD

# How amounts and days are written, and what stands before a bid, a value, a briefing, a closing and an award.
NUMBER = r"([0-9][0-9\s,]{3,}(?:\.[0-9]{2})?)"
AMOUNT = r"(?:R|ZAR|\$)\s*" + NUMBER
BID_LABEL = r"(?i)(?:bid price|total price|contract sum|tender sum|tender price|offered price|pricing|amount)"
VALUE_LABEL = r"(?i)(?:estimated value|tender value|budget|project estimate|estimated budget)"
# Behind a label an amount needs four characters or more, or, as small ones have fewer, its currency and cents.
LABELLED = (r"[:\s]*(?:R|ZAR|\$)?[:\s]*" + NUMBER, r"[:\s]*(?:R|ZAR|\$)[:\s]*([0-9]{1,3}\.[0-9]{2})\b")
DAY = r"([0-9]{1,2}\s+[a-zA-Z]{3,9}\s+20[2-3][0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/20[2-3][0-9])"
DAY_LABELS = {"briefing": "briefing session|site meeting|compulsory briefing", "closing": "closing date|deadline|submission date", "award": "validity period|award date"}
# How a tender states its preference system, its goals, its procedure and what it buys, in order.
SYSTEM_STATED = r"(?i)(?:applicable\s+preference\s+point\s+system|system\s+for\s+this\s+tender\s+is|will\s+be\s+evaluated\s+on\s+the)[\s\w]*(80/20|90/10)"
GOALS, SHARED_GOALS = r"(?is)specific goals.{0,500}", r"(?i)hdi|locality|rdp|women"
PROCEDURES = {"RFQ": r"(?i)\b(?:request for quotation|rfq)\b", "Open": r"(?i)\b(?:request for proposal|rfp|open tender|invitation to bid)\b"}
SUPPLIES = {"Services": r"(?i)\b(?:services|consulting|maintenance)\b", "Goods": r"(?i)\b(?:goods|supply and delivery|equipment)\b", "Works": r"(?i)\b(?:works|construction|infrastructure)\b"}
# The smallest amount of interest, and the statutory limit that every notice quotes.
LEAST_AMOUNT, BOILERPLATE_AMOUNT = 1000.0, 50_000_000.0
# Placeholders that stand for no value, trimmed and in lower case; levels that stand for no level.
SENTINELS = (
    "pending", "n/a", "na", "n.a.", "tbc", "tba", "unknown", "none", "not applicable", "not available", "nil", "-", "--", "0", "null", "undefined", "to be confirmed", "to be advised",
)
SENTINEL_LEVELS = (0, 9)
# Document types in order, what their lower-case text holds, and their labels.
DOCUMENT_RULES = (
    ("CSD_CERT", r"central supplier database|maaa[0-9]{7}|csd supplier number|csd report", "CSD Registration Certificate"),
    ("BBBEE_CERT", r"b-bbee|bbbee|broad-based black economic|sworn affidavit|eme|qse|black owned", "B-BBEE Certificate / Affidavit"),
    ("TAX_CLEARANCE", r"sars|tax clearance|tax compliance status|tax pin", "Tax Clearance PIN / Certificate"),
    ("CIDB_CERT", r"cidb|construction industry development|crs number|grading designation", "CIDB Registration Certificate"),
    ("CIPC_COR14_3", r"cipc|cor14\.3|certificate of incorporation|registration of company|ck1|ck2", "CIPC / COR14.3 Company Registration"),
    ("BANK_STATEMENT", r"bank confirmation|account number|financial statement|bank letter|absa|fnb|standard bank|nedbank|capitec", "Bank Confirmation / Financial Statements"),
    ("TRACK_RECORD_LETTER", r"reference letter|appointment letter|testimonial|completion certificate|satisfactory performance|past contract", "Track Record / Reference Letter"),
)
UNKNOWN_TYPE = ("UNKNOWN", "Unclassified Document", "Unknown Document")
# What the upper-case text or the currency of a tender of each region holds, and what the region asks for.
UK_TEXT, UK_CURRENCY = r"£|CONTRACTS FINDER|UNITED KINGDOM", "GBP"
ZA_TEXT, ZA_CURRENCY = r"RANDS|BBBEE|PPPFA|SOUTH AFRICA", "ZAR"
REGIONS = {
    "ZA": ("Conquest-ZA (South Africa PPPFA)", "PPPFA 80/20 & 90/10", ("Verify Tax Clearance Pin", "Attach BBBEE Sworn Affidavit / SANAS Certificate")),
    "UK": ("Conquest-UK (United Kingdom MEAT)", "MEAT PCR 2015", ("Ensure CPV code alignment", "Verify social value statement compliance")),
}
# Letters of Latin scripts whose compatibility decomposition is one ASCII letter with marks, and those letters.
_PLAIN = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFKD", c))[0].isascii() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])}
ACCENTED, UNACCENTED = "".join(_PLAIN), "".join(_PLAIN.values())
# Keys too general to be matched at all, and words that open running prose instead of a caption.
GENERAL_LABELS = (
    "registration number", "registration no", "registration", "number", "no", "name", "names", "full name", "full names", "address", "code", "reference number", "status level", "level", "amount",
    "pin", "total", "other", "details", "description", "subject", "yes", "n a", "if yes", "if no", "particulars", "comments", "remarks",
)
PROSE_OPENERS = (
    "i", "in", "of", "and", "or", "the", "this", "that", "by", "at", "to", "with", "for", "if", "as", "we", "is", "are", "be", "hereby", "who", "which", "from", "on", "it", "any", "all", "do", "have", "was", "were",
)
# Fields that may be filled, each with the column of the profile that it is drawn from; those filled with less confidence; the least score.
WHITELIST = {
    "company_name": "company_name", "registration_number": "registration_number", "csd_number": "csd_number", "bbbee_level": "bbbee_level", "tax_reference_number": "tax_reference_number",
    "vat_registration_number": "vat_registration_number", "physical_address": "physical_address", "postal_address": "postal_address", "contact_person": "standard_contact_person", "telephone_number": "standard_phone",
    "cell_phone_number": "standard_cell", "fax_number": "standard_fax", "email_address": "standard_email", "tax_compliance_pin": "tax_compliance_pin", "capacity": "authorized_signatory_capacity",
    "director_names_and_id_numbers": "directors",
}
LESS_SURE, LEAST_SCORE = ("bbbee_level", "capacity"), 88.0
# Wording of sworn declarations, and of terms that a tender asks for.
SWORN = ("STATE INSTITUTION", "FURNISH PARTICULARS", "IF SO", "IN THE SERVICE OF THE STATE", "SURNAME AND NAME", "IDENTITY NUMBER", "ID NUMBER", "SHAREHOLDER", "DIRECTOR", "MEMBER", "RELATIONSHIP", "SPOUSE")
TERMS = ("LEAD TIME", "DELIVERY", "PACKAGING", "CHARGE", "WARRANTY", "GUARANTEE", "VALIDITY", "DISCOUNT", "AVAILABILITY", "TURNAROUND", "COMPLETION")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _holds(text: Column, words: str) -> Column:
    """``text.rlike(words)`` for words divided by ``|``: plain ones are searched for as they stand, which is many times faster."""
    plain, patterns = [], []
    for word in words.split("|"):
        (patterns if re.search(r"[][\\.^$*+?(){}]", word) else plain).append(word)
    found = [text.contains(F.lit(w)) for w in plain] + ([text.rlike("|".join(patterns))] if patterns else [])
    return reduce(lambda a, b: a | b, found)


def to_amount(text: Column) -> Column:
    return F.regexp_replace(text, "[ ,]", "").try_cast("double")


def extract_money(text: Column, small: bool = False) -> Column:
    """struct(amounts, bid, value): amounts over 1,000 in order; labelled ones first, else the least and, if larger than the bid, the greatest.

    With ``small`` also labelled amounts of fewer than four characters, where they have a currency and cents."""
    found = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), to_amount)
    amounts = F.array_distinct(F.filter(found, lambda a: a.isNotNull() & (a > LEAST_AMOUNT) & (a != BOILERPLATE_AMOUNT)))
    labelled = lambda label: F.nullif(F.coalesce(*[to_amount(_first(text, label + form)) for form in LABELLED[: 2 if small else 1]]), F.lit(BOILERPLATE_AMOUNT))
    bid = F.coalesce(labelled(BID_LABEL), F.array_min(amounts))
    value = F.coalesce(labelled(VALUE_LABEL), F.when(F.array_max(amounts) > bid, F.array_max(amounts)))
    return F.struct(amounts.alias("amounts"), bid.alias("bid"), value.alias("value"))


def parse_day(text: Column) -> Column:
    plain = F.regexp_replace(F.trim(text), r"\s+", " ")
    day = lambda form: F.try_to_date(plain, form)
    # A form that does not fit costs an exception, so marks tell which may fit.
    return F.when(plain.contains("-"), day("yyyy-MM-dd")).when(plain.contains("/"), day("d/M/yyyy")).otherwise(F.coalesce(day("d MMMM yyyy"), day("d MMM yyyy")))


def extract_dates(text: Column, as_of: Column) -> Column:
    """struct(briefing, closing, award, deadline_days): the first day behind each label on its line; days from ``as_of`` to closing, not under 0."""
    days = {name: parse_day(_first(text, rf"(?i)(?:{label})[^\n]*?{DAY}")) for name, label in DAY_LABELS.items()}
    return F.struct(*[c.alias(n) for n, c in days.items()], F.when(days["closing"].isNotNull(), F.greatest(F.lit(0), F.datediff(days["closing"], as_of))).alias("deadline_days"))


def extract_terms(text: Column, value: Column | None = None) -> Column:
    """struct(system, low_confidence, goals_ratio, functionality, procedure, supply).

    The preference system is the stated one, else that of the ``value``, with low confidence; without either it is unknown. Specific
    goals that go to more than the contribution level within 500 characters halve that level's part.
    """
    known = F.coalesce(text, F.lit(""))
    stated = _first(known, SYSTEM_STATED)
    system = F.coalesce(stated, evaluation_system(F.lit(None).cast("double") if value is None else value))
    goals = F.when(F.regexp_extract(known, GOALS, 0).rlike(SHARED_GOALS), 0.5).otherwise(1.0)
    low = F.lower(known)
    of = lambda kinds: F.coalesce(*[F.when(_holds(low, re.search(r"\(\?:(.*)\)", p)[1]) & known.rlike(p), F.lit(n)) for n, p in kinds.items()])
    functionality = _first(known, THRESHOLD).try_cast("int")
    return F.struct(system.alias("system"), stated.isNull().alias("low_confidence"), goals.alias("goals_ratio"), functionality.alias("functionality"), of(PROCEDURES).alias("procedure"), of(SUPPLIES).alias("supply"))


def completeness(money: Column | dict, dates: Column | dict, terms: Column | dict) -> Column:
    """struct(share, missing, incomplete) of the seven parts of a tender. System and threshold always count as read: their absence is an answer."""
    parts = {
        "evaluation_system": F.lit(True), "tender_value": money["value"].isNotNull(), "bid_price": money["bid"].isNotNull(), "deadline_days": dates["deadline_days"].isNotNull(),
        "tender_proceduretype": terms["procedure"].isNotNull(), "tender_supplytype": terms["supply"].isNotNull(), "functionality_threshold_pct": F.lit(True),
    }
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in parts.items()]))
    share = (len(parts) - F.size(missing)) / F.lit(float(len(parts)))
    return F.struct(share.alias("share"), missing.alias("missing"), ((share < 0.5) | ~parts["tender_value"] | ~parts["bid_price"]).alias("incomplete"))


# How a company report states its level, its ownership, its names, its trades and its grading.
LEVEL_STATED = r"(?i)(?:b-bbee status level|b-bbee level|b-bbee status|bbbee status level|bbbee level|b-bbee contributor level)[:\s]+(?:of contributor)?[:\s]*(?:level\s+)?([1-9])"
LEVEL_AFTER = r"(?i)level\s+([1-9])\s+(?:contributor)?\s*(?:to)?\s*(?:b-bbee|bbbee)"
OWNERSHIP = r"(?i)% owned by black people\s+([0-9]{1,3}\.[0-9]{2})"
REGISTRATION = r"([0-9]{4}/[0-9]{6}/[0-9]{2}|K[0-9]{9})"
COMPANY_NAME = r"(?i)(?:enterprise name|legal name|name of company|trading name)[:\s]+([A-Z0-9 ,().&-]+)"
NO_NAME = r"(?i)registration|postal|physical|enterprise"
COMMODITY = r"(?:(?:Segment|Family|Class|Commodity)\s*(?:Code)?\s*[:-]\s*(?:[0-9]{6,8}\s*[-–]\s*)?|\b[0-9]{8}\s+)([A-Za-z][A-Za-z ,&/'-]{6,80})"
INDUSTRY = r"(?i)(?:industry|industry classification|nature of business|business type|sector)\s*[:-]\s*([A-Za-z][A-Za-z ,&/'-]{4,80})"
GRADING = r"\b([1-9]) *((?:GB|CE|SB|EB|EP|ME|SD|SF|SG|SH|SI|SJ|SK|SL|SM|SN|SO|SQ))\b"
MOST_COMMODITIES = 12


def extract_company(text: Column) -> Column:
    """struct(supplier_number, level, registration, company_name, commodities, industry, cidb_grade).

    The level is the stated one, else by ownership (100 % is 1, 51 % or more 2, less 4), else 9 where non-compliant;
    the industry is the stated one, else the first trade.
    """
    owned = _first(text, OWNERSHIP).try_cast("double")
    stated = F.coalesce(_first(text, LEVEL_STATED), _first(text, LEVEL_AFTER)).try_cast("int")
    level = F.coalesce(stated, F.when(owned >= 100, 1).when(owned >= 51, 2).when(owned.isNotNull(), 4), F.when(text.rlike(r"(?i)non[- ]compliant"), 9))
    registration = F.coalesce(_first(text, r"(?i)(?:enterprise number|registration number|registration no)[:\s]+" + REGISTRATION), _first(text, rf"\b{REGISTRATION}\b"))
    name = F.upper(F.trim(F.regexp_replace(_first(text, COMPANY_NAME), r"\s+", " ")))
    trades = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(COMMODITY), F.lit(1)), lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" -,"))), lambda c: F.length(c) > 6))
    commodities = F.slice(trades, 1, MOST_COMMODITIES)
    return F.struct(
        F.upper(_first(text, r"(?i)(MAAA[0-9]{7})")).alias("supplier_number"), level.alias("level"), registration.alias("registration"), F.when((F.length(name) > 3) & ~name.rlike(NO_NAME), name).alias("company_name"),
        commodities.alias("commodities"), F.coalesce(F.btrim(F.regexp_replace(_first(text, INDUSTRY), r"\s+", " "), F.lit(" -,")), F.get(commodities, F.lit(0))).alias("industry"),
        F.when(text.rlike(GRADING), F.concat(F.regexp_extract(text, GRADING, 1), F.regexp_extract(text, GRADING, 2))).alias("cidb_grade"),
    )


def document_type(text: Column) -> Column:
    """struct(type, confidence, label, hits): first rule that hits; 0.95 alone, 0.75 among several, 0.2 for none, 0 for no text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = [F.when(_holds(low, p), F.lit(n)) for n, p, _ in DOCUMENT_RULES]
    hits, first = F.array_compact(F.array(*rules)), F.coalesce(*rules)
    empty = F.length(low) == 0
    confidence = F.when(empty, 0.0).when(F.size(hits) == 1, 0.95).when(F.size(hits) > 1, 0.75).otherwise(0.2)
    label = F.when(empty, UNKNOWN_TYPE[2])
    for name, _, title in DOCUMENT_RULES:
        label = label.when(first == name, title)
    return F.struct(F.coalesce(first, F.lit(UNKNOWN_TYPE[0])).alias("type"), confidence.alias("confidence"), label.otherwise(UNKNOWN_TYPE[1]).alias("label"), hits.alias("hits"))


def region(text: Column, currency: Column, override: Column | None = None) -> Column:
    """struct(region, engine, framework, recommendations): an override, else signals of the UK, then of ZA; ZA without any."""
    upper, money = F.upper(F.coalesce(text, F.lit(""))), F.upper(F.coalesce(currency, F.lit("")))
    signals = F.when(F.contains(money, F.lit(UK_CURRENCY)) | _holds(upper, UK_TEXT), "UK").when(F.contains(money, F.lit(ZA_CURRENCY)) | _holds(upper, ZA_TEXT), "ZA").otherwise("ZA")
    found = signals if override is None else F.when(override.isin(*REGIONS), override).otherwise(signals)
    advice = lambda name, k: F.array(*map(F.lit, REGIONS[name][k])) if k == 2 else F.lit(REGIONS[name][k])
    parts = [F.when(found == "UK", advice("UK", k)).otherwise(advice("ZA", k)).alias(c) for k, c in enumerate(("engine", "framework", "recommendations"))]
    return F.struct(found.alias("region"), *parts)


def normalize_label(label: Column) -> Column:
    """Matching key: no accents, leaders, numbering, brackets or punctuation, hyphens joined, lower case, single spaces."""
    plain = F.regexp_replace(F.translate(F.coalesce(label, F.lit("")), ACCENTED, UNACCENTED), "[\u2013\u2014]", "-")
    x = F.regexp_replace(F.regexp_replace(plain, r"[_.\u2026]{2,}|\n", " "), r"(?i)^\s*([0-9]+(\.[0-9]+)*[.)]?|([a-z]|[ivxlc]+)[.)])\s+", "")
    x = F.regexp_replace(F.lower(F.regexp_replace(x, r"\([^)]*\)", " ")), "-", "")
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def lesson_key(label: Column) -> Column:
    """Learned-label key: lower case, hyphens and slashes joined, digits kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[-/]", ""), r"[^a-z0-9]+", " "))


def explain_unfilled(label: Column, status: Column) -> Column:
    """Why a label without a field stays blank: declaration, pricing_cell, tender_terms, prose, ambiguous_label or unmatched, in this order.

    ``status`` is that of the look-up. What only the bidder can swear to comes first, whatever the look-up says.
    """
    text = F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")
    holds = lambda words: F.upper(text).rlike("|".join(words))
    found = F.when(text == "", "unmatched").when(holds(SWORN), "declaration").when(text.rlike(r"^[Rr]\s*[:.]?$"), "pricing_cell").when(holds(TERMS), "tender_terms")
    return found.when(status == "prose_fragment", "prose").when(status.isin("blocked", "ambiguous"), "ambiguous_label").otherwise("unmatched")


def fill_value(canonical: Column, value: Column) -> Column:
    """What a profile's value is drawn as: placeholders and levels that stand for none are null, a level reads ``Level n``, directors are a roster."""
    people = F.from_json(value, "array<struct<name:string,id_number:string>>")
    part = lambda d, c: F.nullif(F.trim(F.coalesce(d[c], F.lit(""))), F.lit(""))
    named = F.filter(people, lambda d: part(d, "name").isNotNull())
    roster = F.nullif(F.array_join(F.transform(named, lambda d: F.when(part(d, "id_number").isNotNull(), F.concat(part(d, "name"), F.lit(" ("), part(d, "id_number"), F.lit(")"))).otherwise(part(d, "name"))), "; "), F.lit(""))
    plain = F.trim(null_sentinels(value))
    level = F.when(~F.coalesce(plain.try_cast("int").isin(*SENTINEL_LEVELS), F.lit(False)), F.when(plain.rlike("^[0-9]+$"), F.concat(F.lit("Level "), plain)).otherwise(plain))
    return F.when(canonical == "director_names_and_id_numbers", roster).when(canonical == "bbbee_level", level).otherwise(plain)


def fill_decision(block: Column, canonical: Column, score: Column, value: Column) -> Column:
    """struct(decision, value, low_confidence): blocked > no_match > not_whitelisted > low_score > no_value > fill; ``value`` only where filled.

    Less confidence goes to scores that are too low and to the fields of ``LESS_SURE``.
    """
    drawn = fill_value(canonical, value)
    decision = F.when(block.isNotNull(), "blocked").when(canonical.isNull(), "no_match").when(~canonical.isin(*WHITELIST), "not_whitelisted").when(score < LEAST_SCORE, "low_score").when(drawn.isNull(), "no_value").otherwise("fill")
    low = (decision == "low_score") | ((decision == "fill") & canonical.isin(*LESS_SURE))
    return F.struct(decision.alias("decision"), F.when(decision == "fill", drawn).alias("value"), F.coalesce(low, F.lit(False)).alias("low_confidence"))


def null_sentinels(value: Column) -> Column:
    """The value, or null where it is blank or stands for none."""
    return F.when(~F.lower(F.trim(value)).isin(*SENTINELS, ""), value)


def null_level(level: Column) -> Column:
    """A contribution level, or null where it stands for an unread or missing one."""
    return F.when(~null_sentinels(level.cast("string")).try_cast("int").isin(*SENTINEL_LEVELS), level)


def valid_sa_id(number: Column) -> Column:
    """13 digits, plausible month and day, and a right check digit."""
    shape = number.rlike(r"^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{7}$")
    return F.coalesce(shape & F.call_function("luhn_check", number), F.lit(False))


# What each field of a profile must look like, once trimmed; numbers without white space, phones without marks.
PROFILE_RULES = {
    "registration_number": r"(?i)^[A-Z]{0,3}[0-9]{4}/[0-9]{6}/[0-9]{2}$", "supplier_number": r"(?i)^MAAA[0-9]{6,10}$", "tax_number": r"^[0-9]{10}$", "vat_number": r"^4[0-9]{9}$",
    "email": r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$", "phone": r"^(\+27|0)[0-9]{9}$", "level": r"(?i)^(level\s*[1-8]\b.*|[1-8]|.*non.*compl.*)$", "company_name": r"^.{2,}$", "address": r"^[\s\S]{8,}$",
}
IGNORED_MARKS = {"tax_number": r"\s", "vat_number": r"\s", "phone": r"[\s().-]"}


def validate_profiles(profiles: DataFrame, key: str, required: list[str] = ()) -> DataFrame:
    """(key, field, value, problem): ``format`` where a value breaks its field's rule, ``missing`` where a required one is blank."""
    fields = [f for f in PROFILE_RULES if f in profiles.columns]
    cleaned = {f: F.regexp_replace(F.trim(F.col(f).cast("string")), IGNORED_MARKS.get(f, "$^"), "") for f in fields}
    state = lambda f: F.when(F.coalesce(cleaned[f], F.lit("")) == "", F.lit("missing") if f in required else F.lit(None)).when(~cleaned[f].rlike(PROFILE_RULES[f]), "format")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), state(f).alias("problem")) for f in fields])
    return profiles.select(key, F.inline(F.filter(rows, lambda r: r["problem"].isNotNull())))


def validate_directors(profiles: DataFrame, key: str, directors: str = "directors") -> DataFrame:
    """(key, position, field, problem) of a JSON array of name, id_number and is_state_employee.

    ``position`` is -1 where there is no list, or none that can be read. A name needs two characters; an identity number
    of digits only must be a valid one; one with other characters is a passport and only warned of. The answer on state
    employment must be given: true, yes, 1, false, no or 0.
    """
    spread = profiles.withColumn("_d", F.from_json(directors, "array<struct<name:string,id_number:string,is_state_employee:string>>"))
    none = spread.where(F.coalesce(F.size("_d"), F.lit(0)) <= 0).select(key, F.lit(-1).alias("position"), F.lit("directors").alias("field"), F.lit("missing").alias("problem"))
    each = spread.select(key, F.posexplode("_d").alias("position", "d"))
    number = F.replace(F.trim(F.coalesce("d.id_number", F.lit(""))), F.lit(" "), F.lit(""))
    digits = number.rlike("^[0-9]+$")
    judged = {
        "name": F.when(F.length(F.trim(F.coalesce("d.name", F.lit("")))) < 2, "missing"),
        "id_number": F.when(number == "", "missing").when(digits & ~valid_sa_id(number), "invalid").when(~digits, "passport"),
        "is_state_employee": F.when(~F.lower(F.trim(F.coalesce("d.is_state_employee", F.lit("")))).isin("true", "yes", "1", "false", "no", "0"), "missing"),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("problem")) for f, c in judged.items()])
    return none.unionByName(each.select(key, "position", F.inline(F.filter(rows, lambda r: r["problem"].isNotNull()))))


def plain_json(value: Column) -> Column:
    """JSON in one spelling: fields in order, no spare white space; anything else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def profile_diff(current: DataFrame, proposed: DataFrame, key: str, writable: list[str], json_fields: list[str] = ()) -> DataFrame:
    """(key, field, status, before, after): each proposed change of a writable field as ``changed``, and each value proposed for another field as ``ignored``.

    A profile without changes has no ``changed`` row. Fields of JSON are compared by what they say; a company without profile has null before.
    """
    fields = [c for c in proposed.columns if c != key and c in writable]
    others = [c for c in proposed.columns if c != key and c not in writable]
    shown = lambda df, c: (plain_json(F.col(c).cast("string")) if c in json_fields else F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
    long = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), shown(df, c).alias(name)) for c in fields])))
    none = F.lit(None).cast("string")
    out = proposed.select(key, F.lit("").alias("field"), F.lit("").alias("status"), none.alias("before"), none.alias("after")).limit(0)
    if fields:
        both = long(proposed, "after").join(long(current, "before"), [key, "field"], "left").where(~F.col("before").eqNullSafe(F.col("after")))
        out = out.unionByName(both.select(key, "field", F.lit("changed").alias("status"), "before", "after"))
    if others:
        extra = proposed.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("after")) for c in others]))).where("after is not null")
        out = out.unionByName(extra.select(key, "field", F.lit("ignored").alias("status"), none.alias("before"), "after"))
    return out


def match_labels_exact(labels: DataFrame, aliases: DataFrame, blocked: DataFrame) -> DataFrame:
    """``canonical`` by equal keys (the first alias wins), null for blocked keys. ``aliases``: alias, canonical, position; ``blocked``: key."""
    known = aliases.select(normalize_label(F.col("alias")).alias("key"), "canonical", "position").groupBy("key").agg(F.min_by("canonical", "position").alias("canonical"))
    keyed = labels.withColumn("key", normalize_label(F.col("label")))
    bad = blocked.select(normalize_label(F.col("key")).alias("key")).distinct()
    return keyed.join(bad, "key", "left_anti").join(known, "key", "left")


def match_labels_fuzzy(labels: DataFrame, aliases: DataFrame, enough: float = fuzzy.ENOUGH, margin: float = fuzzy.MARGIN) -> DataFrame:
    """(key, canonical, score, status) of each distinct key: matched, ambiguous, low_corroboration or unmatched.

    Keys and aliases meet only where letters or words in common leave a match possible; see ``bidlake.operators.fuzzy``.
    """
    known = aliases.select(normalize_label(F.col("alias")).alias("alias"), "canonical", "position")
    return fuzzy.look_up(labels.select(normalize_label(F.col("label")).alias("key")), known, enough, margin).select("key", "canonical", "score", "status")


def label_lookup(labels: DataFrame, aliases: DataFrame, enough: float = fuzzy.ENOUGH) -> DataFrame:
    """(key, canonical, score, status) of each distinct key: blocked, exact, prose_fragment, else as the fuzzy match says.

    An empty or null label is unmatched; only keys without an equal alias go to the fuzzy match, and ``canonical`` is
    set only for the statuses exact and matched. Of equal aliases the first wins.
    """
    keys = labels.select(normalize_label(F.col("label")).alias("key")).distinct()
    known = aliases.select(normalize_label(F.col("alias")).alias("key"), "canonical", "position").groupBy("key").agg(F.min_by("canonical", "position").alias("_exact"))
    opener = F.split_part("key", F.lit(" "), F.lit(1)).isin(*PROSE_OPENERS)
    status = F.when(F.col("key") == "", "unmatched").when(F.col("key").isin(*GENERAL_LABELS), "blocked").when(F.col("_exact").isNotNull(), "exact").when(opener, "prose_fragment")
    first = keys.join(known, "key", "left").withColumn("status", status)
    rest = match_labels_fuzzy(first.where(F.col("status").isNull()).select(F.col("key").alias("label")), aliases, enough)
    sure = first.where(F.col("status").isNotNull()).select("key", F.when(F.col("status") == "exact", F.col("_exact")).alias("canonical"), F.when(F.col("status") == "exact", 100.0).otherwise(0.0).alias("score"), "status")
    return sure.unionByName(rest.withColumns({"canonical": F.when(F.col("status") == "matched", F.col("canonical")), "score": F.coalesce("score", F.lit(0.0))}))


def lessons(log: DataFrame) -> DataFrame:
    """(company_id, key): the latest meaning taught and how often it was taught."""
    return log.withColumn("key", lesson_key(F.col("label"))).groupBy("company_id", "key").agg(F.max_by(F.struct("kind", "canonical_field"), "taught_at").alias("m"), F.count("*").alias("occurrences")).select("company_id", "key", "m.kind", "m.canonical_field", "occurrences")


def apply_lessons(matches: DataFrame, taught: DataFrame) -> DataFrame:
    """A tenant's lesson counts only where the dictionary is not confident; not_a_field clears the match."""
    joined = matches.withColumn("key", lesson_key(F.col("label"))).join(taught, ["company_id", "key"], "left")
    field = F.when(F.col("confident"), F.col("canonical")).when(F.col("kind") == "not_a_field", F.lit(None)).otherwise(F.coalesce("canonical_field", "canonical"))
    return joined.select("company_id", "label", field.alias("canonical"))


def resolve_ambiguous(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """(company_id, label, value): a label of several candidate fields, only where all that are filled agree."""
    filled = profile.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    spread = candidates.select("company_id", "label", F.explode("fields").alias("field")).join(filled, ["company_id", "field"])
    return spread.groupBy("company_id", "label").agg(F.collect_set("value").alias("v")).where(F.size("v") == 1).select("company_id", "label", F.col("v")[0].alias("value"))


# Advice by contribution level, the pressing first: (levels, priority, advice); the last is for no level.
LEVEL_ADVICE = (((1, 2), 3, "level gives most points"), ((3, 4), 3, "level is competitive, a better one gives most points"), ((5, 6), 2, "level is below average, improve it"), ((7, 8), 1, "level is not competitive, improve it before large bids"), ((), 1, "no level, no points"))


def accreditation_gaps(parsed: DataFrame, key: str) -> DataFrame:
    """(key, priority, advice) rows, high priority first: one on the level always, the supplier database where the number lacks, a grading where a builder lacks it."""
    note = lambda priority, advice: F.struct(F.lit(priority).alias("priority"), F.lit(advice).alias("advice"))
    level = note(*LEVEL_ADVICE[-1][1:])
    for levels, priority, advice in LEVEL_ADVICE[:-1]:
        level = F.when(F.col("level").isin(*levels), note(priority, advice)).otherwise(level)
    builds = F.lower(F.coalesce("industry", F.lit(""))).rlike("construction|works")
    lacking = [F.when(F.col("supplier_number").isNull(), note(1, "register on the central supplier database")), F.when(F.col("cidb_grade").isNull() & builds, note(2, "obtain a grading for works"))]
    return parsed.select(key, F.explode(F.array_sort(F.array_compact(F.array(level, *lacking)))).alias("a")).select(key, "a.priority", "a.advice")
