"""Column functions over text: tokens, sentences, stems by suffix, snippets, headings, identifiers, similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token patterns of the supported tokenisers.
TOKEN_PATTERNS = {
    "words": r"[A-Za-z][A-Za-z0-9'_-]*",
    "letters": r"[a-zA-ZÀ-ɏ']+",
    "unicode": r"(?U)\b\w+\b",
    "alpha2": r"\b[a-zA-Z]{2,}\b",
    "numbers": r"\b[a-zA-Z]+(?:'[a-zA-Z]+)?\b|\d+",
}
#: Words that carry no content in a query.
FILLER_WORDS = (
    "a an the of and or but if in on at to for with by from is are was were be been being as that this these those it "
    "its what which who whom how why where when please tell me about show give find search get look some any all each "
    "every more most such no not only own same so than too very just can will do did does have has had may might shall "
    "should would could am"
).split()
#: Suffixes of the two rule stemmers, tried in order, and the letters that must remain.
SUFFIXES_LONG = (("ing", "edly", "tion", "tions", "ed", "ly", "es", "er", "s"), 3)
SUFFIXES_SHORT = (("ing", "edly", "ed", "ly", "es", "s"), 2)


def tokens(text: Column, style: str = "words") -> Column:
    """Lower-cased tokens in order; null text gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERNS[style]), F.lit(0))
    return F.transform(found, F.lower)


def count_tokens(text: Column, style: str = "words") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERNS[style]), F.lit(0)))


def count_blank_separated(text: Column) -> Column:
    """White-space words, 1 at least."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")
    return F.greatest(F.lit(1), F.when(t == "", 0).otherwise(F.size(F.split(t, r"[ \t\r\n\f]+"))))


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space and a capital letter or quotation mark."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?])[ \t\r\n]+([A-Z\"'])", "$1\x01$2")
    return F.filter(F.transform(F.split(marked, "\x01"), F.trim), lambda s: s != "")


def without_fillers(toks: Column, words=FILLER_WORDS, least: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(toks, lambda x: ~F.array_contains(stop, x) & (F.length(x) >= least))


def suffix_stem(term: Column, rules=SUFFIXES_LONG) -> Column:
    """The first suffix that fits is cut, if more letters remain than the rule keeps."""
    suffixes, keep = rules
    out = None
    for s in suffixes:
        fits = term.endswith(s) & (F.length(term) > len(s) + keep)
        cut = F.substring(term, F.lit(1), F.length(term) - len(s))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(term)


def _accented() -> dict[str, str]:
    """Lower-case letters of the Latin blocks that Unicode takes apart into a letter a to z and marks."""
    blocks = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    apart = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in blocks if chr(i).islower()}
    return {letter: x[0] for letter, x in apart.items() if len(x) > 1 and "a" <= x[0] <= "z"}


_ACCENTED = _accented()


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters, whether one letter with its accent or marks of their own."""
    bare = F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.regexp_replace(bare, "[\u0300-\u036f]+", "")


def _window(text: Column, at: Column, before: int, width: int) -> Column:
    """Stretch of text around position at (from 1; 0: the head), with an ellipsis where cut."""
    start = F.greatest(F.lit(1), at - before)
    body = F.trim(F.regexp_replace(F.substring(text, start, F.lit(width)), r"[ \t\r\n]+", " "))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def snippet_first(text: Column, terms: list[str], width: int = 280) -> Column:
    """Around the first term, in the order of the query, that occurs."""
    low = F.lower(text)
    hits = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms]
    return _window(text, F.coalesce(*hits, F.lit(0)) if hits else F.lit(0), width // 3, width)


def snippet_earliest(text: Column, terms: list[str], before: int = 80, width: int = 300) -> Column:
    """Around whichever term occurs first in the text."""
    low = F.lower(text)
    hits = F.array_min(F.filter(F.array(*[F.instr(low, t.lower()) for t in terms]), lambda x: x > 0)) if terms else F.lit(None).cast("int")
    return _window(text, F.coalesce(hits, F.lit(0)), before, width)


def heading(text: Column, most_lines: int | None = None) -> Column:
    """First line of 4 to 79 letters that is all capitals or in title case; null if none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim)
    if most_lines:
        lines = F.slice(lines, 1, most_lines)
    pattern = r"^(?:[A-Z][A-Z ]{2,}[A-Z]|(?:[A-Z][a-z]+ +){1,5}[A-Z][a-z]+)$"
    return F.try_element_at(F.filter(lines, lambda x: (F.length(x) > 3) & (F.length(x) < 80) & x.rlike(pattern)), F.lit(1))


def year_guess(name: Column, text: Column) -> Column:
    """A year from 1600 to 2029 in the name, else in the first 500 letters of the text."""
    pattern = r"(?:^|[^0-9A-Za-z_])(1[6-9][0-9]{2}|20[0-2][0-9])(?:[^0-9A-Za-z_]|$)"
    of = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))
    return F.coalesce(of(name), of(F.substring(text, 1, 500))).try_cast("int")


def citation(title: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(", ", title, F.concat(F.lit("p. "), page.cast("string")), F.nullif(section, F.lit("")))


def chunk_key(path: Column, page: Column, start: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, page.cast("string"), start.cast("string"), end.cast("string")))


def file_type(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def title_from_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")


#: Elements whose content is not text, by profile.
HTML_DROPPED = {"plain": ("script", "style"), "head": ("script", "style", "head", "meta", "link"), "body": ("script", "style", "nav", "header", "footer")}
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column, profile: str = "plain") -> Column:
    """Text of a page: some elements dropped, tags as line ends, blanks and empty lines collapsed."""
    t = F.coalesce(html, F.lit(""))
    for tag in HTML_DROPPED[profile]:
        t = F.regexp_replace(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for entity, letter in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(letter))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def html_heading(html: Column, most: int = 80) -> Column:
    """Text of the first h1 to h3, cut to so many letters; null if none."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<h[1-3](?:\s[^>]*)?>(.*?)</h[1-3]\s*>", 1)
    flat = F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return F.nullif(F.substring(flat, 1, most), F.lit(""))


def token_set(text: Column, head: int | None = None) -> Column:
    """The distinct words of two letters or more, of the first `head` letters alone if that is given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low if head is None else F.substring(low, 1, head), F.lit("[a-z]{2,}"), F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero vector's length counts as 1."""
    norm = lambda v: F.when(dot(v, v) > 0, F.sqrt(dot(v, v))).otherwise(1.0)
    return dot(a, b) / (norm(a) * norm(b))


def unit_vector(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


#: Query intents and their patterns, in order.
INTENTS = (
    ("quote_seek", r"(?i)\b(quote|quotes|quoted|passage|passages|said|wrote|noted|remarked|stated|exclaimed|aphorism|saying|words)\b"),
    ("emotional_theme", r"(?i)\b(love|loss|grief|sorrow|joy|fear|hope|pain|anger|beauty|longing|yearning|tenderness|ache|melancholy|wonder|courage|despair|suffering|compassion|shame|guilt|pride|regret|nostalgia|loneliness|desire)\b"),
    ("definition", r"(?i)\b(define|definition|what is|what'?s|meaning|means|explain|concept of|notion of)\b"),
    ("example_seek", r"(?i)\b(example|examples|instance|instances|case|cases|such as|like|illustration|illustrate)\b"),
    ("comparison", r"(?i)\b(difference|differences|vs\.?|versus|compare|comparison|contrast|distinguish|between)\b"),
    ("narrative", r"(?i)\b(story|stories|scene|moment|chapter|episode|event|narrative|account|description|depict)\b"),
    ("person_seek", r"\b(who is|who was|biography|life of|about [A-Z][a-z]+)\b"),
)
#: One-label intents, the first that matches.
SINGLE_INTENTS = (
    ("quote", r"(?i)\b(quot\w*|said|says|stat\w+|phrase|passage)\b"),
    ("definition", r"(?i)\b(defin\w+|what\s+is|meaning\s+of|explain\w*)\b"),
    ("comparison", r"(?i)\b(compar\w*|versus|vs\.?|differ\w*|similar\w*)\b"),
    ("example", r"(?i)\b(example\w*|instance|illustrat\w*)\b"),
)
#: Chunk structures favoured by an intent.
INTENT_STRUCTURES = {
    "quote_seek": ("quote_block", "dialogue"),
    "definition": ("heading_body", "exposition"),
    "example_seek": ("list", "exposition"),
    "narrative": ("dialogue", "exposition"),
    "emotional_theme": ("quote_block", "poetry", "dialogue"),
    "comparison": ("exposition", "list"),
    "person_seek": ("exposition", "heading_body"),
    "general": (),
}


def intents(text: Column) -> Column:
    """All intents of a query, `general` if none."""
    found = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in INTENTS]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def single_intent(text: Column) -> Column:
    out = None
    for name, pattern in SINGLE_INTENTS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("general")


#: Beginnings that ask for a definition, and parts of words that tell an intent.
ASKS_DEFINITION = r"(?i)^(?:define|definition of|what is|what's|meaning of)[ \t\r\n]+[^\r\n]"
PARTS_OF_INTENTS = (("quotes", ("quote", "said", "passage")), ("definition", ("define", "meaning", "what is")))


def phrase_intent(text: Column) -> Column:
    """definition, phrase (something in quotation marks) or general."""
    return F.when(text.rlike(ASKS_DEFINITION), "definition").when(text.rlike('"[^"]{1,200}"'), "phrase").otherwise("general")


def substring_intent(text: Column) -> Column:
    """The first intent of which a part occurs anywhere, else general."""
    out = None
    for name, parts in PARTS_OF_INTENTS:
        found = F.greatest(*(F.lower(text).contains(x) for x in parts))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("general")


def structure(text: Column) -> Column:
    """struct<kind, density> of a chunk: list, quote_block, poetry, dialogue, heading_body or exposition, the first
    whose marks are there."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    words = count_blank_separated(t).cast("double")
    lists = count(r"(?m)^[ \t]*[-*•0-9]+[.)][ \t]")
    quoted = count('[“”"][^"]{10,300}[“”"]')
    verbs = count(r"(?i)\b(said|wrote|noted|remarked|observed|declared|argued|stated|exclaimed|replied|whispered)\b")
    marks, dashes = count('["“”‘’]'), count("[—–]|--")
    lines = F.filter(F.transform(F.split(t, "\n"), F.trim), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.size(F.split(x, r"[ \t]+")) <= 8)) / F.greatest(F.size(lines), F.lit(1))
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    one = F.lit(1.0)
    of = lambda kind, d: F.struct(F.lit(kind).alias("kind"), d.alias("density"))
    return (
        F.when(lists >= 2, of("list", F.least(one, lists / (words / 10))))
        .when((quoted >= 1) | (verbs >= 1), of("quote_block", F.least(one, (quoted + verbs) / (words / 20))))
        .when((short > 0.6) & (F.size(lines) >= 4), of("poetry", short))
        .when((marks / words > 0.04) | (dashes >= 2), of("dialogue", F.least(one, (marks + dashes * 2) / (words / 5))))
        .when((first != "") & (F.size(F.split(first, r"[ \t]+")) <= 8) & first.rlike("^[A-ZÀ-ÖØ-Þ]"), of("heading_body", F.lit(0.4)))
        .otherwise(of("exposition", F.lit(0.1)))
    )
