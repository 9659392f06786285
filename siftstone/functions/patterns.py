"""Pattern and word-list constants, plus the helper that gives them Unicode word boundaries.

Everything in the block marked "fixed values" has to equal the published rubric for scores and drop counts to
come out the same, so it is stated as plain text and only ever combined by :func:`whole_words`.
"""

from __future__ import annotations

# Inside a character class: what counts as a word character (letters, all numbers, underscore). The ASCII part comes
# first because it answers most tests.
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
# Whitespace as Unicode text tools understand it (the JVM's \s is ASCII-only), as a class and as characters
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"


def starts(alternatives: str) -> str:
    """Look-ahead on the first letters of an alternation: one cheap class test rules out most positions."""
    firsts = {branch.lstrip("(?:")[0] for branch in alternatives.split("|")}
    return "(?=[" + "".join(sorted(firsts)) + "])"


def whole_words(alternatives: str) -> str:
    """Wrap an alternation whose branches start and end with word characters in word boundaries."""
    return rf"{starts(alternatives)}{NOT_AFTER_WORD}(?:{alternatives}){NOT_BEFORE_WORD}"


def whole_words_hint(alternatives: str) -> str:
    """What :func:`whole_words` finds and a little more, for an engine without look-around: the branches begin and end with ASCII word characters, so
    an ASCII boundary holds wherever the Unicode one does; branches that end with a class are not tested behind it."""
    branches = alternatives.split("|")
    plain = [b for b in branches if "\\p" not in b]
    loose = [b.removesuffix("+") for b in branches if "\\p" in b]
    return rf"\b(?:{'|'.join([rf'(?:{'|'.join(plain)})\b', *loose])})"


# ---- fixed values: word lists of the scoring rubric -------------------------------------------------------------
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
UNITS = (
    "ms|sec|secs|seconds|minutes|hours|days|g|kg|mg|ml|l|oz|lb|rpm|bar|psi|degc|degf|celsius|fahrenheit"
)
PERCENTILES = "p50|p90|p95|p99"
FIRST_PERSON = "i|we|my|our"
FIRST_HAND_VERBS = (
    "tried|tested|built|shipped|deployed|migrated|ran|saw|found|noticed|measured|benchmarked|reproduced|debugged|"
    "used|switched|paid|cancelled|installed|upgraded|rolled back|hit|fixed|broke|dialed|dialled|brewed|pulled|"
    "tasted|compared|changed|adjusted|logged|observed|recorded|cooked|baked|mixed|weighed"
)
FIRST_HAND_OWNED = "(?:our|my) (?:team|company|org|production|prod|deployment|workflow)"
PROCESS = (
    "tried|tested|ran|measured|benchmarked|timed|logged|observed|recorded|reproduced|debugged|built|shipped|deployed|"
    "migrated|installed|upgraded|rolled back|switched|changed|adjusted|compared|sampled|dialed|dialled|brewed|pulled|"
    "tasted|cooked|baked|mixed|weighed|configured|validated|verified"
)
OBSERVABLE = (
    r"screenshot|screen recording|video|demo|log|logs|trace|stack trace|error|repro|reproduced|benchmark|metric|"
    r"metrics|chart|table|graph|diff|commit|pull request|pr #?\p{Nd}+|issue #?\p{Nd}+|latency|throughput|photo|"
    r"before/after|before and after|result|results|measured|measurement|measurements"
)
COMPARISON = (
    "compared|versus|vs|before/after|before and after|a/b|baseline|regression|improved|worse|better|changed from|"
    "changed to"
)
SPECIFICITY = (
    "workflow|setup|configuration|settings|recipe|process|steps|method|workaround|rollout|deployment|tasting note|"
    "notes|details|ingredient|sample|batch|run|trial|experiment"
)
PROMO_WORDS = (
    "ad|sponsored|sponsorship|giveaway|coupon|discount|promo code|use code|referral|affiliate|sale|limited time|"
    "free shipping|merch|storefront|shop now|buy now|order now|pre[- ]?order|link in bio|dm me to order|dm us to order|"
    "grand opening|visit us at|book now|reserve now"
)
COMMERCE = "shop|buy|order|purchase|book|reserve|get yours|available now|on sale|sold out|restock"
CTA_FIXED = "link in bio|dm me|dm us"
CTA_VERBS = "click|tap|visit|follow|subscribe|join|sign up|shop|buy|order|book|reserve|get|download"
CTA_ENDINGS = "now|today|here|below|bio|link|for more|to order|to buy"
ANNOUNCEMENT = (
    "we'?re excited to announce|introducing|now available|launching|just launched|new drop|come visit|check out our"
)
PROMO_PHRASES = (
    "airdrop",
    "giveaway",
    "sponsored",
    "affiliate",
    "referral",
    "promo code",
    "coupon",
    "discount",
    "shop now",
    "buy now",
    "order now",
    "use code",
    "link in bio",
    "merch",
    "storefront",
    "invite code",
    "dm me",
    "dm us",
    "follow back",
    "whitelist",
    "mint live",
    "プレゼント企画",
)
STOP_TOKENS = (
    "about", "after", "again", "also", "and", "are", "because", "been", "before", "being", "but", "can", "for",
    "from", "get", "had", "has", "have", "here", "how", "into", "just", "link", "more", "now", "our", "out", "over",
    "post", "that", "the", "this", "today", "use", "was", "with", "you", "your",
)
QUERY_OPERATORS = (
    "from", "to", "lang", "type", "since", "until", "has", "exclude", "min_likes", "min-likes", "min_retweets",
    "min-retweets", "min_views", "min-views",
)
QUERY_PUNCTUATION = "\"'()[]{}<>.,!?;:"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".avif")
# ---- end of fixed values ----------------------------------------------------------------------------------------

# All patterns below expect text in lower case, see text.plain_lower(); '.' stops at a line feed only ((?d)). Where a pattern
# begins with a literal, the boundary test follows it, so that positions without the literal cost one comparison.
URL_RE = rf"(?=[htw])(?:https?://|www\.|t\.co/)[^{SPACE}]+"
HTTP_URL_RE = rf"https?://[^{SPACE}]+"
MENTION_RE = rf"@(?<![{WORD}]@)[A-Za-z0-9_]{{1,15}}"
HASHTAG_RE = rf"#(?<![{WORD}]#)[{WORD}]+"
CASHTAG_RE = rf"\$(?<![{WORD}]\$)[A-Za-z][A-Za-z0-9_]*"
NEAR_DUP_TOKEN_RE = r"[a-z0-9\x{131}][a-z0-9\x{131}_+-]*"

# the boundary before a detail is tested once for all kinds; branches keep their order
_DETAIL_STARTS = starts(f"{MONTHS}|{PERCENTILES}|{UNITS}|v")[:-2] + r"\p{Nd}])"
CONCRETE_DETAIL_RE = (
    rf"(?:\$[0-9]|{_DETAIL_STARTS}{NOT_AFTER_WORD}(?:\p{{Nd}}{{1,4}}(?:[.,]\p{{Nd}}+)?(?:%(?=[{WORD}])|{NOT_BEFORE_WORD})"
    rf"|20\p{{Nd}}{{2}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}{NOT_BEFORE_WORD}"
    rf"|(?:{MONTHS})[a-z]*{NOT_BEFORE_WORD}"
    rf"|v?\p{{Nd}}+\.\p{{Nd}}+{NOT_BEFORE_WORD}"
    rf"|(?:{PERCENTILES}|{UNITS}){NOT_BEFORE_WORD}))"
)
FIRST_HAND_RE = (
    rf"(?d)(?:{whole_words(FIRST_PERSON)}.{{0,64}}{whole_words(FIRST_HAND_VERBS)}|(?=[om]){NOT_AFTER_WORD}{FIRST_HAND_OWNED}{NOT_BEFORE_WORD})"
)
PROCESS_RE = whole_words(PROCESS)
OBSERVABLE_RE = whole_words(OBSERVABLE)
COMPARISON_RE = whole_words(COMPARISON)
SPECIFICITY_RE = whole_words(SPECIFICITY)
PROMO_RE = whole_words(PROMO_WORDS)
COMMERCE_RE = whole_words(COMMERCE)
CTA_RE = rf"(?d)(?:{whole_words(CTA_FIXED)}|{whole_words(CTA_VERBS)}.{{0,36}}{whole_words(CTA_ENDINGS)})"
ANNOUNCEMENT_RE = whole_words(ANNOUNCEMENT)

# A signal needs a text in which all hints of one of its groups occur; whether it holds is for the patterns above to say
SIGNAL_HINTS = {
    "process": ((whole_words_hint(PROCESS),),),
    "first_person": ((whole_words_hint(FIRST_PERSON), whole_words_hint(FIRST_HAND_VERBS)), (rf"\b{FIRST_HAND_OWNED}\b",)),
    "observable_text": ((whole_words_hint(OBSERVABLE),),),
    "comparison": ((whole_words_hint(COMPARISON),),),
    "specific": ((whole_words_hint(SPECIFICITY),),),
    "promo": ((whole_words_hint(PROMO_WORDS),),),
    "commerce": ((whole_words_hint(COMMERCE),),),
    "cta": ((whole_words_hint(CTA_FIXED),), (whole_words_hint(CTA_VERBS), whole_words_hint(CTA_ENDINGS))),
    "announcement": ((whole_words_hint(ANNOUNCEMENT),),),
    "concrete": ((rf"\p{{Nd}}|\b(?:{MONTHS})[a-z]*\b|\b(?:{UNITS})\b",),),
}

MARKDOWN_IMAGE_RE = rf"!\[[^\]]*\]\((https?://[^){SPACE}]+)\)"
HTML_IMAGE_RE = rf"""(?iu)<img(?![{WORD}])[^>]*?(?<![{WORD}])src=["'](https?://[^"']+)["']"""
