"""Which blanks of a form may be filled: label rules as column expressions.

The lists and patterns are fixed values, in Java's regular expressions and without regard to case. A null label is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no label by themselves, openings of sworn prose, and ends of a clause that was cut off.
FUNCTION_WORDS = (
    "of", "and", "or", "the", "a", "an", "to", "in", "on", "at", "by", "for", "with", "as", "is", "are", "be", "been", "that", "this", "these", "those",
    "i", "we", "it", "if", "no", "yes", "not", "from", "per",
)
PROSE_OPENINGS = (
    "i, the undersigned", "do hereby", "i hereby", "we hereby", "in my capacity", "representative of", "on behalf of", "it is a condition", "failure to", "note:", "please note",
    "kindly note", "the tenderer", "each tenderer", "bidders are", "tenderers are", "in terms of", "subject to", "provided that",
)
CUT_OFF_ENDS = (",", ";", ".]", ".)", " -", "–", "—", ":-")
# Fields that are never filled whatever their label, and the reason.
BLOCKED_FIELDS = {"signature": "signature", "signature_date": "signing_date", "bid_amount": "pricing"}
# Headings of the buyer's own block.
COUNTERPARTY = (r"directed\s+to", r"enquir(?:y|ies)", r"technical\s+enquiries", r"for\s+(?:the\s+)?attention\s+of", r"procuring\s+institution", r"department\b", r"issued\s+by", r"on\s+behalf\s+of\s+the\s+(?:municipality|department|entity)")
# Plain facts that use a word of signing or of money.
EXEMPT = (
    r"^\s*capacity\b(?!.*\bsignature\b)", r"capacity\s+under\s+which", r"capacity\s+in\s+which", r"^\s*designation\b(?!.*\bsignature\b)", r"^\s*position\s+held\b",
    r"total\s+(?:number|no\.?|count|quantity|qty)\b", r"number\s+of\s+items\b", r"total\s+items\b",
)
# What makes a document a declaration of interest, and the labels of persons in one.
DECLARATION_DOCUMENT = (
    r"declaration\s+of\s+interest", r"bidder.{0,3}s\s+disclosure", r"declaration\s+on\s+employment\s+by\s+organ\s+of\s+state", r"general\s+declaration", r"\b[SM]BD\s*4\b", r"annexure\s+a\b.*declaration",
    r"in\s+the\s+service\s+of\s+the\s+state", r"employed\s+by\s+the\s+state", r"bid\s+is\s+not\s+in\s+conflict", r"register\s+for\s+tender\s+defaulters", r"list\s+of\s+restricted\s+suppliers",
)
DECLARED_PERSON = (r"full\s+name", r"\bidentity\s+number\b", r"\bid\s+number\b", r"name\s+of\s+organ\s+of\s+state", r"\bposition\s+(?:held|occupied)\b", r"supplier\s+registration\s+number", r"\bstatus\b", r"\bname\b")
# The reasons in their order, each with what its labels hold.
BLOCK_RULES = {
    "signature": (
        r"\bsignature[sd]?\b", r"\bsigned\b", r"\bsign(?:ing)?\s+(?:here|below|above|off)\b", r"\bplease\s+sign\b", r"\bsign\s*:", r"^\s*sign\b", r"\bsignatory\b", r"\bhandtekening\b", r"\bwitness(?:es)?\b",
        r"\bdeponent\b", r"\bcommissioner\s+of\s+oaths\b", r"\binitial(?:s|led)?\b", r"\bduly\s+authorised\s+signatory\b", r"\bparaaf\b", r"^\s*par\.?\s*$", r"\bgetuie\b", r"\bonderteken(?:ing|aar|d)?\b",
        r"\bmerk\s+hier\b", r"\b(?:uku)?sayina\b", r"\b(?:u|lo)?fakazi\b", r"\bfor\s+and\s+on\s+behalf\s+of\b", r"\bauthoris(?:ed|zed)\s+representative\b", r"\battested\s+by\b", r"\bsworn\s+before\b",
        r"\bthus\s+done\s+and\s+(?:signed|subscribed)\b", r"\bin\s+the\s+presence\s+of\b", r"\bexecuted\s+at\b", r"\bper\s+pro(?:curationem)?\b", r"^\s*p\.?\s*p\.?\s*[:.]?\s*$", r"^\s*per\s*[:.]",
        r"\b(?:company|official|rubber|bidder.?s)\s+stamp\b", r"\baffix\b[^.]{0,30}\bstamp\b", r"\bthumb\s*-?\s*print\b", r"\bmark\s+of\s+the\b", r"^\s*x?\s*[_\-–—]{3,}\s*$",
    ),
    "declaration": (
        r"declaration\s+of\s+interest", r"\bmbd\s*4\b", r"\bsbd\s*4\b", r"employed\s+by\s+the\s+state", r"\bstate\s+employee\b", r"in\s+the\s+service\s+of\s+the\s+state", r"\bpublic\s+office\s+bearer\b",
        r"connected\s+(?:to|with)\s+any\s+person\s+employed", r"relationship\s+with\s+(?:any\s+)?person(?:s)?\s+employed", r"\bconflict\s+of\s+interest\b", r"family\s+member.*employed",
    ),
    "signing_date": (r"date\s+(?:of\s+)?sign(?:ing|ature|ed)", r"signed\s+(?:on|at|this)\b", r"\bthus\s+(?:done\s+and\s+)?signed\b", r"dated?\s+at\b", r"\bthis\s+\d*\s*_*\s*day\s+of\b", r"\(day\)\s*of"),
    "pricing": (
        r"\bprice\b", r"\bpricing\b", r"\bamount\b", r"\bcost\b", r"\bfee\b", r"\brate\b", r"\btariff\b", r"\bquotation\b", r"\bquote\b", r"\btotal\b", r"\bsubtotal\b", r"\bsum\b",
        r"\bvat\s+(?:amount|inclusive|exclusive)\b", r"\bzar\b", r"\bbid\s+amount\b", r"\bbid\s+price\b", r"\bcontract\s+(?:value|sum|price)\b", r"\bR\s*[_.]{3,}", r"\brand\s+value\b",
    ),
    "narrative": (
        r"method\s+statement", r"\bmotivat(?:ion|e)\b", r"describe\s+your\b", r"\bdescription\s+of\s+(?:your|the)\s+(?:approach|methodology|experience)\b", r"\bapproach\s+and\s+methodology\b",
        r"\bplease\s+(?:explain|elaborate|describe|specify\s+in\s+detail)\b", r"\bproject\s+plan\b", r"\bexecutive\s+summary\b", r"\breasons?\s+(?:for|why)\b", r"\bcomments?\b",
    ),
}


def _holds(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _trimmed(label: Column) -> Column:
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")


def fillable(label: Column) -> Column:
    """Whether a detected blank is a field at all: its label is not empty, no piece of prose and no pre-printed number."""
    text = _trimmed(label)
    low = F.lower(text)
    prose = F.btrim(low, F.lit(".:,)")).isin(*FUNCTION_WORDS) | (text.rlike(r"^\p{Ll}") & F.contains(text, F.lit(" ")))
    for opening in PROSE_OPENINGS:
        prose = prose | F.startswith(low, F.lit(opening))
    for end in CUT_OFF_ENDS:
        prose = prose | F.endswith(text, F.lit(end))
    return (text != "") & ~prose & ~F.regexp_replace(text, "[ .,%R-]", "").rlike(r"^\d+$")


def document_context(text: Column) -> Column:
    """``declaration`` for a form that declares interests, else ``form``."""
    return F.when(_holds(text, DECLARATION_DOCUMENT), "declaration").otherwise("form")


def block_reason(label: Column, context: Column, canonical: Column | None = None, section: Column | None = None) -> Column:
    """Why a blank must not be filled, null if it may be.

    In this order: a blocked field; an empty label; a ``counterparty`` heading; a person's label in a declaration; the rules.
    Labels that ask for a plain fact pass the rules on signatures and prices, and no others.
    """
    text = _trimmed(label)
    field, heading = (F.lit(None).cast("string") if c is None else c for c in (canonical, section))
    plain = _holds(text, EXEMPT)
    out = F.lit(None).cast("string")
    for name, patterns in reversed(BLOCK_RULES.items()):
        hit = _holds(text, patterns)
        out = F.when(hit & ~plain if name in ("signature", "pricing") else hit, F.lit(name)).otherwise(out)
    out = F.when((context == "declaration") & _holds(text, DECLARED_PERSON), "declaration").otherwise(out)
    out = F.when(_holds(heading, COUNTERPARTY), "counterparty").otherwise(out)
    out = F.when(text == "", "empty").otherwise(out)
    for name, reason in BLOCKED_FIELDS.items():
        out = F.when(field == name, F.lit(reason)).otherwise(out)
    return out
