"""Rules that tell suggestions, replies and noise apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmurlake.functions.text import contains_any, found_rule, literals, matches
from murmurlake.functions.urls import ACTIVITY_URLS, SOCIAL_URLS, URL_CONFIDENCE, url_kind

# Name, pattern, confidence, kind; the first that matches wins.
PATTERNS = (
    ("bucket_list", r"\bbucket ?list\b", 0.95, "suggestion"),
    ("we_should", r"\bwe should\b(?!\s+(?:not|stop|avoid|have|be\s+careful))", 0.9, "suggestion"),
    ("must_visit", r"\b(?:must visit|must go|have to visit)\b", 0.9, "suggestion"),
    ("lets_go", r"\blet'?s go\b(?!\s+(?:home|back|now|already))", 0.85, "suggestion"),
    ("lets_try", r"\blet'?s try\b", 0.85, "suggestion"),
    ("wanna_go", r"\b(?:wanna|want to) go\b", 0.85, "suggestion"),
    ("should_we", r"\bshould we\b(?!\s+(?:not|stop))", 0.8, "suggestion"),
    ("lets_do", r"\blet'?s do\b", 0.8, "suggestion"),
    ("can_we", r"\bcan we\b.*?\b(?:go|try|do|visit|see)\b", 0.75, "suggestion"),
    ("would_be_fun", r"\bwould be (?:fun|cool|nice|awesome|amazing)\b.*?\b(?:to|if)\b", 0.75, "suggestion"),
    ("we_could", r"\bwe could\b(?!\s+(?:not|never))", 0.7, "suggestion"),
    ("one_day", r"\bone day\b.*?\b(?:go|visit|try|do|see)\b", 0.7, "suggestion"),
    ("next_time", r"\bnext time\b.*?\b(?:go|visit|try|do|see|should)\b", 0.7, "suggestion"),
    ("come_back", r"\bcome back\b.*?\b(?:and|to)\b", 0.65, "suggestion"),
    ("would_you_like", r"\bwould you like to\b", 0.8, "suggestion"),
    ("do_you_want", r"\bdo you (?:want|wanna)\b", 0.8, "suggestion"),
    ("i_want_to", r"\bi want to\b(?!\s+(?:die|cry|leave|sleep|quit|go home))", 0.6, "suggestion"),
    ("we_need_to", r"\bwe need to\b(?!\s+(?:stop|avoid|talk|figure|think|discuss))", 0.6, "suggestion"),
    ("looks_fun", r"\b(?:looks?|sounds?) (?:fun|amazing|awesome|incredible|beautiful|great|good)\b", 0.5, "agreement"),
    ("im_keen", r"\b(?:i'?m|we'?re|i'?d be|we'?d be) (?:keen|down)\b", 0.5, "agreement"),
    ("lets_book", r"\blet'?s book (?:it|that|this)\b", 0.5, "agreement"),
    ("check_out", r"\bcheck (?:this|it) out\b", 0.5, "suggestion"),
)
KEYWORDS = (
    r"\b(?:restaurant|cafe|coffee|bar|pub|brewery|winery|vineyard|brunch|dinner)\b",
    r"\b(?:beach|lake|river|waterfall|hot springs?|pool|swim|kayak|paddleboard|surf|dive|snorkel)\b",
    r"\b(?:hike|walk|trail|track|trek|mountain|hill|volcano|summit|peak)\b",
    r"\b(?:park|garden|reserve|sanctuary|forest|bush|national park)\b",
    r"\b(?:museum|gallery|exhibition|art|concert|show|theatre|movie|cinema|festival|event)\b",
    r"\b(?:market|farmers market|night market)\b",
    r"\b(?:hotel|airbnb|bach|accommodation|camping|glamping|resort|lodge)\b",
    r"\b(?:ski|snowboard|bungy|bungee|skydive|zipline|jet boat|luge|zorb)\b",
    r"\b(?:tour|cruise|trip|getaway|holiday|vacation|road trip|roadie)\b",
)
EXCLUSIONS = (
    r"\b(?:work|job|meeting|email|call|pay|bill|tax|deadline|project|boss|office)\b",
    r"\b(?:doctor|dentist|hospital|appointment|vet|mechanic|optometrist|physio)\b",
    r"\b(?:groceries|shopping|buy|sell|order|clean|cleaning|laundry|dishes|vacuum|chores)\b",
    r"\b(?:should not|shouldn't|can't|cannot|won't|wouldn't|don't)\b",
    r"\b(?:we went|we did|we visited|we tried|already been|been there)\b",
)
EXCLAMATIONS = ("amazing", "awesome", "beautiful", "delicious", "incredible")
AGREEMENTS = (
    "looks fun", "looks good", "looks great", "looks cool", "looks nice", "sounds fun", "sounds good", "sounds great",
    "so good", "so cool", "i'm keen", "i'm down", "let's book", "let's do it",
)
SUGGESTIONS = (
    "we should", "should we", "let's go", "let's try", "let's visit", "let's check", "want to go", "want to try",
    "want to visit", "wanna go", "wanna try", "wanna visit", "have to go", "have to try", "have to visit", "need to go",
    "need to try", "gotta try", "gotta go", "must visit", "must try", "check this out", "check it out", "this place",
    "this spot", "next time", "bucket list", "on my list", "adding to list",
)
PHRASES = EXCLAMATIONS + AGREEMENTS + SUGGESTIONS
#: Only signs of one code point are ever found in a text.
EMOJI = "🔥😍🤩🤤💯🙌👍💙💜✨🌟🏃🎉🌍🌎🌏🌴📍📌🍴☕🍺🍷"
TYPE_WORDS = (
    ("event", ("event", "concert", "show", "festival", "ticket", "gig", "performance")),
    ("place", ("restaurant", "cafe", "bar", "hotel", "resort", "beach", "park", "this place", "location", "spot")),
    ("activity", ("hike", "trek", "ski", "surf", "dive", "climb", "tour", "trip")),
    ("idea", ("one day", "someday", "bucket list", "dream", "wish")),
)
KEYWORD_BOOST, PHRASE_URL_BOOST, KEYWORD_URL_BOOST, CUSTOM_CONFIDENCE = 0.15, 0.25, 0.1, 0.7


def excluded(content: Column, more: Sequence[str] = ()) -> Column:
    return found_rule(content, EXCLUSIONS) | (matches(content, "|".join(f"(?:{p})" for p in more)) if more else F.lit(False))


def has_keyword(content: Column) -> Column:
    return found_rule(content, KEYWORDS)


def has_phrase(content: Column) -> Column:
    return contains_any(F.lower(content), PHRASES)


def first_pattern(content: Column, min_confidence: float = 0.5, custom: Sequence[str] = ()) -> Column:
    """struct(pattern, confidence, kind) of the first built-in rule that matches, boosted by keywords; a match below the least confidence ends
    the built-in rules, custom ones follow; null if nothing is left."""

    def chain(rules: Sequence[tuple[str, str, float, str]], own: bool = False) -> Column:
        made = None
        for name, regex, confidence, kind in rules:
            test = matches(content, regex) if own else found_rule(content, [regex])
            found = F.struct(F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"))
            made = F.when(test, found) if made is None else made.when(test, found)
        return made

    def boosted(rule: Column) -> Column:
        # A lambda binds the rule found, so the chain is evaluated once; keywords are looked for only in what matched.
        plus = F.when(has_keyword(content), KEYWORD_BOOST).otherwise(0.0)
        made = F.transform(F.filter(F.array(rule), lambda r: r.isNotNull()), lambda r: r.withField("confidence", F.least(F.lit(1.0), r["confidence"] + plus)))
        return F.get(F.filter(made, lambda r: r["confidence"] >= min_confidence), F.lit(0))

    # One alternation decides for most rows that no rule needs to be tried.
    built_in = boosted(F.when(found_rule(content, [p[1] for p in PATTERNS]), chain(PATTERNS)))
    if not custom:
        return built_in
    return F.coalesce(built_in, boosted(chain([(f"custom:{p}", p, CUSTOM_CONFIDENCE, "suggestion") for p in custom], own=True)))


def best_url(urls: Column) -> Column:
    """struct(url, kind, confidence) of the address of greatest confidence, the first of equals."""
    start = F.struct(F.lit(None).cast("string").alias("url"), F.lit("website").alias("kind"), F.lit(0.0).alias("confidence"))

    def step(best: Column, url: Column) -> Column:
        kind = url_kind(url)
        confidence = F.element_at(F.create_map(*[F.lit(x) for kv in URL_CONFIDENCE.items() for x in kv]), kind)
        return F.when(confidence > best["confidence"], F.struct(url.alias("url"), kind.alias("kind"), confidence.alias("confidence"))).otherwise(best)

    return F.aggregate(urls, start, step)


def includes_url(first: Column, content: Column) -> Column:
    kind = url_kind(first)
    return ~kind.isin(*SOCIAL_URLS) & (kind.isin(*ACTIVITY_URLS) | has_phrase(content))


def url_boosted(confidence: Column, content: Column) -> Column:
    phrased = F.when(has_phrase(content), F.least(F.lit(1.0), confidence + PHRASE_URL_BOOST)).otherwise(confidence)
    return F.when(has_keyword(content), F.least(F.lit(1.0), phrased + KEYWORD_URL_BOOST)).otherwise(phrased)


def phrase_hits(text: Column) -> Column:
    return F.filter(literals(PHRASES), lambda p: F.lower(text).contains(p))


def emoji_hits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([{EMOJI}])"), F.lit(1))


def intent_score(keywords: Column, emojis: Column) -> Column:
    return F.least(F.lit(1.0), F.least(F.lit(0.6), F.size(keywords) * 0.15) + F.least(F.lit(0.3), F.size(emojis) * 0.1))


def inferred_type(platform: Column, text: Column, intent: Column) -> Column:
    low = F.lower(text)
    made = F.when(platform == "google_maps", "place")
    for kind, words in TYPE_WORDS:
        made = made.when(contains_any(low, words), kind)
    return made.when(platform.isin("instagram", "tiktok") & (intent > 0.3), "place").otherwise("unknown")
