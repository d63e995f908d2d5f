"""Event types, keyword vocabulary and tunables, all as plain data.

A new event type or keyword is a new row here (or in a table the caller passes
instead): the operators read these rows and never name an event themselves.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EventType:
    id: str
    icon: str
    label: str
    enabled: bool
    min_confidence: float
    window_hours: int


# Alert presentation, confidence floor and cool-down per event.
EVENTS: tuple[EventType, ...] = (
    EventType("funding", "💰", "FUNDING", True, 0.7, 72),
    EventType("acquisition", "🤝", "ACQUISITION", True, 0.7, 72),
    EventType("launch", "🚀", "LAUNCH", True, 0.75, 168),
    EventType("expansion", "🌐", "EXPANSION", True, 0.75, 168),
    EventType("rebrand", "🏷️", "REBRAND", True, 0.75, 168),
    EventType("partnership", "🔗", "PARTNERSHIP", True, 0.8, 168),
)

# Keyword patterns. Family order is priority order, and the order
# inside a family decides which pattern is named as the reason.
FUNDING = (
    r"\braise[sd]?\b",
    r"\braising\b",
    r"\bfunding\b",
    r"\bfunded\b",
    r"\bfinancing\b",
    r"\bfunding round\b",
    r"\b(pre-?seed|seed)\s+(round|funding|financing|investment)\b",
    r"\bseries\s+[a-h]\b",
    r"\bgrowth equity\b",
    r"\bventure (capital|debt|round|financing)\b",
    r"\bdebt financing\b",
    r"\bcredit facility\b",
    r"\bterm loan\b",
    r"\b(investment|round) led by\b",
    r"\bled the round\b",
    r"\bsecure[sd]?\s+\$?\d",
    r"\bclose[sd]?\s+(a\s+)?\$?\d+(\.\d+)?\s*(m|b|million|billion)",
    r"\bcapital raise\b",
    r"\boversubscribed\b",
    r"\bstrategic investment\b",
)
ACQUISITION = (
    r"\bacquire[sd]?\b",
    r"\bacquiring\b",
    r"\bacquisition\b",
    r"\bto acquire\b",
    r"\bmerger\b",
    r"\bmerge[sd]?\b",
    r"\bmerging\b",
    r"\bdefinitive agreement\b",
    r"\bbuys\b",
    r"\bbought\b",
    r"\btakeover\b",
    r"\bbuyout\b",
    r"\bpurchase[sd]?\s+(a\s+)?(majority|controlling|stake)",
    r"\bcombin(e|es|ing|ation) with\b",
)
LAUNCH = (
    r"\blaunch(es|ed|ing)?\b",
    r"\bunveil(s|ed|ing)?\b",
    r"\bintroduc(e|es|ed|ing)\b",
    r"\brolls? out\b",
    r"\brolled out\b",
    r"\bdebut(s|ed|ing)?\b",
    r"\bgoes live\b",
    r"\bnow available\b",
    r"\bout of stealth\b",
    r"\bemerges from stealth\b",
    r"\bgeneral availability\b",
    r"\bbeta (launch|release)\b",
)
EXPANSION = (
    r"\bexpand(s|ed|ing)?\b",
    r"\bexpansion\b",
    r"\benters? the\b.{0,24}\bmarket\b",
    r"\bentry into\b",
    r"\bnow (available|live) in\b",
    r"\bopens? (a |its )?(new )?(office|hub|headquarters)\b",
    r"\b(secures?|receives?|granted|obtains?)\b.{0,30}\b(licen[cs]e|charter|approval|authoriz)",
    r"\bgoes international\b",
    r"\bcross-border expansion\b",
)
REBRAND = (
    r"\brebrand(s|ed|ing)?\b",
    r"\brenam(e|es|ed|ing)\b",
    r"\bnew (name|brand|identity)\b",
    r"\bchanges? its name\b",
    r"\bnow known as\b",
    r"\bwill be known as\b",
    r"\bunder a new brand\b",
)
PARTNERSHIP = (
    r"\bpartner(s|ed|ing|ship)\b",
    r"\bteams? up with\b",
    r"\bcollaborat(e|es|ed|ion)\b",
    r"\bjoins? forces\b",
    r"\balliance\b",
    r"\bintegrat(e|es|ed|ion) with\b",
    r"\bselects?\b.{0,30}\bto power\b",
    r"\bchooses\b.{0,30}\bto power\b",
    r"\bdistribution agreement\b",
    r"\bstrategic partnership\b",
)
# Terms that veto an otherwise matching item.
VETO = (
    r"\bshare (buyback|repurchase)\b",
    r"\bdividend\b",
    r"\bdistribution[s]?\s+(declared|announcement)\b",
    r"\bdeclares?\s+(monthly|quarterly|annual)?\s*distribution",
    r"\bmarket (report|research|forecast|size|outlook)\b",
    r"\bresearch report\b",
    r"\bis projected to (reach|grow)\b",
    r"\bcagr\b",
    r"\bearnings (call|report|release)\b",
    r"\bquarterly results\b",
    r"\bannual general meeting\b",
    r"\bwebinar\b",
    r"\bawards?\b.*\bwinner\b",
    r"\bappoints?\b.*\b(ceo|cfo|cto|coo|president|chair)\b",
)
# Names that suggest a financial technology filer on Form D.
FILER_HINT = (
    r"\bpay(ments?|tech)?\b",
    r"\bbank(ing)?\b",
    r"\blend(ing|er)?\b",
    r"\bcredit\b",
    r"\bfinanc(e|ial|ing)\b",
    r"\bfintech\b",
    r"\bwealth\b",
    r"\binvest(ing|ment)?\b",
    r"\binsur(ance|tech)\b",
    r"\bcrypto\b",
    r"\bblockchain\b",
    r"\bledger\b",
    r"\bwallet\b",
    r"\btreasury\b",
    r"\bmortgage\b",
    r"\bremit(tance)?\b",
    r"\bneobank\b",
    r"\btrading\b",
    r"\bbroker(age)?\b",
    r"\bcard(s)?\b",
    r"\bproptech\b",
    r"\brealty\b",
    r"\breal\s?estate\b",
    r"\bproperty\b",
    r"\brent(al|tech)?\b",
    r"\bescrow\b",
    r"\btitle\b",
    r"\bappraisal\b",
    r"\blease\b",
)
# Names of investment vehicles on Form D.
FILER_VEHICLE = (
    r"\bfund\s*(i{1,3}|iv|v|vi{1,3}|ix|x|\d+)?\b",
    r"\b(l\.?p\.?|lp)\b",
    r"\bpartners\b",
    r"\bventures?\b",
    r"\bcapital\b",
    r"\bmaster series\b",
    r"\ba series of\b",
    r"\bspv\b",
    r"\bopportunit(y|ies)\b",
    r"\bholdings? (i|ii|iii|\d+)\b",
    r"\breal estate (fund|partners|holdings|trust|income|opportunit|invest)",
    r"\bequity (fund|partners)\b",
)
# Filing items, the standard caption and money figures.
ITEM_101 = r"\bitem\s*1\.01\b"
ITEM_201 = r"\bitem\s*2\.01\b"
ITEM_101_CAPTION = "entry into a material definitive agreement"
MONEY = r"\$\s?\d|\b\d+(\.\d+)?\s*(m|bn|b|million|billion)\b"

FAMILIES: dict[str, tuple[str, ...]] = {
    "funding": FUNDING,
    "acquisition": ACQUISITION,
    "launch": LAUNCH,
    "expansion": EXPANSION,
    "rebrand": REBRAND,
    "partnership": PARTNERSHIP,
}

# Query parameters that name a campaign or a referrer.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_name", "utm_reader", "utm_brand", "utm_social",
    "utm_social-type", "fbclid", "gclid", "dclid", "msclkid", "twclid",
    "igshid", "mc_cid", "mc_eid", "ref", "referrer", "source", "src", "cmpid",
    "campaign_id", "sr_share", "guccounter", "guce_referrer",
    "guce_referrer_sig", "__twitter_impression", "_hsenc", "_hsmi",
    "hsctatracking", "yclid", "spm", "at_medium", "at_campaign",
)
# Editorial prefixes dropped from headlines.
TITLE_PREFIXES = (
    "exclusive", "breaking", "update", "updated", "correcting and replacing",
    "press release", "just in", "report", "scoop", "editor's pick",
)
# Corporate suffixes dropped from company names.
COMPANY_SUFFIXES = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "plc", "sa",
    "nv", "ag", "gmbh", "ab", "oy", "pty", "holdings", "group",
    "technologies", "technology", "labs", "financial",
)
# Named character references.
NAMED_ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "pound": "£", "euro": "€", "yen": "¥", "cent": "¢", "mdash": "—",
    "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“",
    "rdquo": "”",
}
REGIONS = ("US", "CA", "US+CA", "other", "unknown")
SEARCH_REGIONS = ("US", "CA", "US+CA")
SEARCH_DAYS = (1, 7, 30, 90, 365)

# Thresholds.
BODY_CHARS = 1500
SUMMARY_CHARS = 4000
THIN_SUMMARY_CHARS = 400
MIN_ARTICLE_CHARS = 200
MIN_TITLE_KEY_CHARS = 12
MAX_BATCH = 15
MAX_ARTICLE_FETCHES = 5
MAX_ATTEMPTS = 5
STUCK_SECONDS = 300
GAP_SECONDS = 300
STALE_SECONDS = 900
MIN_ERRORS_TO_WARN = 3
MAX_AGE_HOURS = 6
REJECTED_TTL_DAYS = 30
#: From this share of the primary model's daily limit on, only even cycles call it.
THROTTLE_AT = 0.8
BACKOFF_BASE_MS = 60_000
BACKOFF_MAX_MS = 600_000
CYCLES_PER_MONTH = 43_200
MEMORY_GB = 2
CPU_HOURS_LIMIT = 4
GB_HOURS_LIMIT = 360
INVOCATIONS_LIMIT = 1_000_000
WARN_PERCENT = 70
