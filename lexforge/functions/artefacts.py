"""Publisher artefacts: ordered patterns that are each replaced by a blank, as one chain of expressions.

Later patterns see what earlier ones left. Patterns are Java regular expressions with Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import let

# ---- Fixed values: the 26 text patterns and the title patterns, in order, with the parts that several of them share.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
CAP = r"[A-Z][\w'’&-]*(?:\.(?!\w))?"
CAPS = rf"{CAP}(?: {CAP}){{0,4}}"
AGENCY = (
    r"Getty(?: [Ii]mages)?|Flickr(?: Creative Commons)?|Screen ?grab|Screen ?shot|Screen ?capture|screencap|Twitter|YouTube|"
    r"Facebook|Instagram|Reddit|Wikimedia(?: Commons)?|Wikipedia|Creative Commons|AP|AFP|EPA|Reuters|Bloomberg|Shutterstock|"
    r"Pool|file|video|C-SPAN|CNN|MSNBC|Fox(?: News)?|NBC|ABC|CBS|CNBC|PBS|BBC|RNC|DNC|"
    rf"{CAP}(?: {CAP}){{0,2}} (?:News|Times|Post|Journal|Tribune|Herald|Daily|Gazette|Beacon)(?![a-z])|[A-Z]{{3,5}}(?![a-z])"
)
TAG = (
    r"(?:NSFW |GRAPHIC |LIVE )?(?:VIDEOS?|TWEETS?|IMAGES?|PHOTOS?|PICS?|PICTURES?|AUDIO|SCREENSHOTS?|SCREENGRABS?|WATCH|LISTEN|"
    r"PODCAST|INFOGRAPHIC|DETAILS|LIVE ?BLOG|LIVE ?STREAM|LIVESTREAM|LIVE)"
)
FORMAT_TAG = rf"(?iu)[\[(]\s*{TAG}(?:\s*[/&+,]\s*{TAG})*(?:,[^\])}}]{{0,30}}| Documentary| w/ Transcript| and (?:Transcript|Photos?|Proof))?\s*[\])}}]"
TEXT_PATTERNS: list[tuple[str, str]] = [
    ("dateline", r"^\s*(?:[A-Z][A-Za-z0-9.'’/&-]*(?:[ ,]+[A-Z][A-Za-z0-9.'’/&-]*){0,6}\s*)?\((?:Reuters)\)\s*[-–—:]*\s*"),
    ("reuters", r"\(\s*Reuters\s*\)"),
    ("featured_image", r"(?ium)Featured? (?:image|photo)s?(?:\s*(?::|\bvia\b|\bby\b|\bfrom\b|\bcredits?:?|[-–]))?[^\n]*$"),
    ("read_more", r"(?ium)Read more:?[^\n]*$"),
    ("wire", r"(?iu)21st Century Wire says[^\n]*"),
    ("support_21wire", r"SUPPORT (?:21WIRE|OUR WORK)[^\n]*|@?\s?21WIRE\.TV"),
    ("continue_story", rf"Continue (?:this|the) (?:story|report|article)(?: (?:at|on|here)(?: {CAPS})?)?"),
    ("url", r"(?iu)(?:https?:\s*//\s*|www\.)\S+"),
    ("pic_twitter", r"(?iu)pic\.\s?twitter(?:\.\s?com)?(?:\s?/\s?\S+)?\.?"),
    ("http_stub", r"(?iu)\bhttps?:\s*\.?(?![\w/])"),
    ("tweet_stamp", rf"[-–—]?\s*\(\s*@?\w*\s*\)\s*(?:{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}:\d{{2}}\s*[AP]M\s*[-–—]\s*\d{{1,2}}\s+\w{{3}}\.?\s+\d{{4}}),?"),
    ("email", r"\b[\w.+-]+@[\w-]+\.\s?[\w.-]+\b"),
    ("handle", r"(?<![\w])@\w{1,30}"),
    ("paren_photo", r"\([^()\n]{0,40}\b[Pp]hoto(?:graph)?s? (?:by|credit|courtesy)[^()\n]{0,80}\)"),
    ("photo_credit", rf"(?m)\(?\b(?:Official {CAP}(?: {CAP}){{0,3}} )?(?:Photo(?:graph)?s?|Images?|Pictures?|Screenshots?|Screen ?grabs?|Screen ?captures?)"
                     rf"(?: [Cc]redits?| [Cc]ourtesy(?: of)?| [Ss]ource)?\s*(?::|\bby\b|\bvia\b|\bfrom\b)\s*[^\n.!?]{{0,80}}?(?:{AGENCY})(?: [Ii]mages)?(?: for {CAPS})?\s*\.?\)?|\bPhoto by\s*$"),
    ("image_credit", rf"\(?\b(?:[Pp]hoto|[Ii]mage|[Pp]icture)s? [Cc]redits?[ \t]*(?::|;|\bfrom\b|\bvia\b|\bby\b)?[ \t]*"
                     rf"(?:(?:{CAP}|via|on|of|by|from|cc|and|video|screen|capture|screenshot|screengrab|\d[\w.]*)[ \t/,&|-]*){{1,10}}\.?\)?"),
    ("getty", rf"(?:{CAP}(?: {CAP}){{0,3}}\s*(?:/|via|-)\s*)?Getty(?: [Ii]mages?)?(?: for {CAPS})?\.?"),
    ("via_source", rf"(?i:via):[ \t]*(?:[A-Za-z][\w'’&.-]*[ \t]?){{1,4}}|\bVia {CAPS}:"),
    ("source_line", rf"\bSources?:[ \t]*{CAPS}\.?|For entire story:?[ \t]*{CAPS}|(?:Go to {CAPS} |Click HERE )?for entire story\.?|\{{snip\}}"),
    ("watch_below", r"(?iu)(?<![A-Za-z])(?:You can |Please )?(?:Watch|Listen(?: to)?)(?:\s[^.\n:!?]{0,50}?)?\s?(?:below|here)(?: LIVE)?\s*[:.]?"
                    r"|(?<![A-Za-z])Watch(?: (?:the |this |it |the full |the whole )?(?:video|clip|interview|segment|footage|exchange|moment))?:"),
    ("heres_video", rf"\bHere(?:'s|’s| s| is) (?:the|a|another|his|her|their) (?:full |second |first |entire |whole )?"
                    rf"(?:video|clip|tweet|tweets|screenshot|screencap|screen ?shot|screen ?grab|screen ?capture|snapshot|footage|audio|segment|interview|exchange)"
                    rf"(?: (?:of|from) [^:.\n]{{0,40}})?(?:,? (?:via|courtesy of|courtesty of) {CAPS})?\s*[:.]?"),
    ("follow_twitter", rf"(?:(?:You can |Please )?[Ff]ollow (?:him|her|them|me|us|our \w+|@?{CAP}(?: {CAP}){{0,3}}) on (?:Facebook,? (?:and |or )?on )?Twitter|Follow on Twitter)"
                       r"(?:\s*(?:at|:)?\s*@[\w.]+)?(?:\s+at\b)?(?:,?\s+(?:or|and)\s+(?:like|add|friend|follow|join|email)[^.\n]{0,60})?(?: for [^.\n]{0,60})?\.?"),
    ("byline", rf"{CAP}(?: {CAP}){{1,3}} is (?:a|an|the) (?:[\w-]+ ){{0,3}}"
               r"(?:reporter|writer|editor|columnist|correspondent|contributor|journalist|producer)(?: and [\w ]{0,20})? "
               rf"(?:for|at|with|of) {CAPS}[^.\n]{{0,80}}\.?"),
    ("email_tips", r"\[ ?Email (?:him|her) ?\]|\bEmail (?:tips|suggestions|him|her|us|them)\b[^.\n]{0,60}\.?"),
    ("format_tag", FORMAT_TAG),
    ("empty_parens", r"\(\s*\)"),
]
OUTLETS = [
    "The New York Times", "Breitbart(?: News)?", "America['’]s Finest News Source", "TruthFeed", "Russia News Now",
    "New Eastern Outlook", "EndingFed News Network", "Daily Wire", "RedFlag News", "The Vineyard of the Saker",
    "RT Arabic", "RT", "Collective Evolution", "Russia & India Report", "Paul Craig Roberts", "Wikileaks",
    "Conservative Daily Post", "GomerBlog", "USAPoliticsNow", "The Federalist Papers", "New Century Times",
    "Morning News USA", "White House", "American Lookout", "OffGuardian", "The Knowledge You Crave", "MagaFeed",
    "ClickHole", "RIA", "Motivate3\\.com", "Jim Willie", "ICH", "New Earth Media", "Tyler Durden", "RealClearPolitics",
    "Jason Ditz", "CounterCurrents\\.org", "Top Right News", "Fort Russ", "Upside Down Media", "American Herald Tribune",
    "Bill Holter", "The Boston Globe", "The Washington Post", "Fox News", "CNN", "NPR", "POLITICO", "The Onion",
    "Infowars", "The Huffington Post", "HuffPost", "Sputnik(?: News)?", "The Daily Caller", "The Daily Beast",
    "Zero Hedge", "Global Research", "Activist Post", "Natural News", "The Duran", "Consortiumnews", "Reuters",
    "BBC News", "The Guardian", "The Hill", "Vox", "Salon", "Slate", "21st Century Wire",
]
TITLE_PATTERNS = [("format_tag", FORMAT_TAG), ("outlet_suffix", r"(?iu)\s+[-–—|]\s*(?:" + "|".join(OUTLETS) + r")\s*$")]
DANGLING = r"\s+[-–—|:]\s*$"
# ---- end of the fixed values


def _java(pattern: str) -> str:
    return "(?U)" + pattern


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")


def strip_text(text: Column) -> Column:
    for _, p in TEXT_PATTERNS:
        text = F.regexp_replace(text, _java(p), " ")
    return _tidy(text)


def strip_title(title: Column) -> Column:
    for _, p in TITLE_PATTERNS:
        title = F.regexp_replace(title, _java(p), " ")
    return _tidy(F.regexp_replace(_tidy(title), _java(DANGLING), ""))


def counts(text: Column) -> list[Column]:
    """Occurrences of each pattern in the text as it is: the features of the leakage classifier."""
    return [F.when(_may_match(text, name), F.regexp_count(text, F.lit(_java(p)))).otherwise(0).alias(name) for name, p in TEXT_PATTERNS]


#: What a text must hold for a pattern to match at all: plain words are searched for much faster than a pattern.
NEEDS = {
    "dateline": "Reuters", "reuters": "Reuters", "continue_story": "Continue th", "tweet_stamp": "(", "email": "@", "handle": "@", "paren_photo": "hoto", "getty": "Getty",
    "heres_video": "Here", "follow_twitter": "Twitter", "byline": " is ", "email_tips": "mail", "empty_parens": "(", "image_credit": "redit",
}


def _may_match(text: Column, name: str) -> Column:
    return F.contains(text, F.lit(NEEDS[name])) if name in NEEDS else F.lit(True)


def _step(state: Column, name: str, pattern: str) -> Column:
    """One pattern applied to (text so far, names so far). A lambda binds the state once; plain columns would be copied and grow with 2 ** steps.

    No pattern matches a single blank alone, so a text that has a match differs from what is left of it.
    """
    def apply(s: Column) -> Column:
        old, h = s.getField("t"), s.getField("h")
        new = F.when(_may_match(old, name), F.regexp_replace(old, pattern, " ")).otherwise(old)
        return let(new, lambda t: F.struct(t.alias("t"), F.when(t != old, F.concat(h, F.array(F.lit(name)))).otherwise(h).alias("h")))

    return let(state, apply)


def strip_frame(df: DataFrame, text: str = "text", title: str | None = "title") -> DataFrame:
    """df with stripped text and title, and hits: the names of the patterns that changed the row's text.

    A pattern is tested on what its predecessors left.
    """
    state = F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"), F.array().cast("array<string>").alias("h"))
    for name, p in TEXT_PATTERNS:
        state = _step(state, name, _java(p))
    out = df.withColumn("__s", state)
    out = out.withColumn(text, _tidy(F.col("__s.t"))).withColumn("hits", F.col("__s.h")).drop("__s")
    return out.withColumn(title, strip_title(F.coalesce(F.col(title), F.lit("")))) if title and title in df.columns else out


def hit_counts(stripped: DataFrame) -> DataFrame:
    """(pattern, n_docs) of a stripped frame, patterns without a hit included."""
    names = stripped.sparkSession.createDataFrame([(n,) for n, _ in TEXT_PATTERNS], "pattern string")
    found = stripped.select(F.explode("hits").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return names.join(found, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n_docs"))
