"""Text cleaning as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from labelloom.functions import lexicons
from labelloom.functions.arrays import SPACE, WORD, let, words

# Fixed value: what counts as a link or an address.  Spelled for Java: classes
# instead of \S and \w, which are ASCII there, and possessive quantifiers.
URL_OR_MAIL = (
    rf"http[^{SPACE[1:-1]}]+|www[^{SPACE[1:-1]}]+"
    r"|[\p{L}\p{N}_.-]++@[\p{L}\p{N}_.-]+"
)
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def whole_word(pattern: str) -> str:
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def _capital(letter: Column) -> Column:
    """Upper case; of a letter that becomes two, only the first."""
    upper = F.upper(letter)
    return F.concat(F.left(upper, F.lit(1)), F.lower(F.substring(upper, 2, 2)))


def title_case(text: Column) -> Column:
    """Capital after every character that is not a cased letter."""
    pieces = F.regexp_extract_all(
        F.lower(text), F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(0)
    )
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(_capital(F.left(p, F.lit(1))), F.substring(p, 2, 2**31 - 1)),
        ),
        "",
    )


def strip_legal_suffix(text: Column, whole: bool = False) -> Column:
    """Delete legal forms.  By default a form also matches as the beginning of
    a longer word; ``whole=True`` wants a word of its own."""
    if whole:
        longest_first = sorted(lexicons.LEGAL_SUFFIXES, key=len, reverse=True)
        pattern = whole_word("|".join(longest_first)) + r"\.?"
    else:
        pattern = rf"(?<!{WORD})(?:{'|'.join(lexicons.LEGAL_SUFFIXES)})\.?"
    return F.regexp_replace(text, pattern, "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clean_company_name(text: Column, whole: bool = False) -> Column:
    """Null stays null."""
    name = title_case(_strip(strip_legal_suffix(_strip(text.cast("string")), whole)))
    spaced = F.regexp_replace(name, rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]", " ")
    return _strip(F.regexp_replace(spaced, SPACE + "+", " "))


def normalize_terms(text: Column, terms: dict[str, str] = None) -> Column:
    """Expand abbreviations as whole words in any case; null gives ``""``.

    One alternation decides whether a text holds any abbreviation at all, so
    the other texts are scanned once and not once per abbreviation.
    """
    terms = lexicons.ABBREVIATIONS if terms is None else terms
    text = F.coalesce(text, F.lit(""))
    if not terms:
        return text
    any_term = "(?iu)" + whole_word("|".join(re.escape(t) for t in terms))

    def expand(t: Column) -> Column:
        for short, full in terms.items():
            pattern = "(?iu)" + whole_word(re.escape(short))
            t = F.regexp_replace(t, pattern, full.replace("$", r"\$"))
        return t

    return let(text, lambda t: F.when(F.rlike(t, F.lit(any_term)), expand(t)).otherwise(t))


def lower_normalized(text: Column, terms: dict[str, str] = None) -> Column:
    """``lower(normalize_terms(text))``.

    An ASCII text is lowered first.  Then a term it does not contain is ruled out
    by a plain search, and the pattern of any other begins with the term itself.
    """
    terms = lexicons.ABBREVIATIONS if terms is None else terms
    plain = F.lower(normalize_terms(text, terms))
    if not all(x.isascii() and x for pair in terms.items() for x in pair):
        return plain

    def step(short: str, full: str):
        # the whole word, spelled so that every search is for the term
        term = re.escape(short.lower())
        pattern = rf"{term}(?<![a-z0-9_]{term})(?![a-z0-9_])"

        def replaced(t: Column) -> Column:
            new = F.regexp_replace(t, pattern, re.sub(r"([\\$])", r"\\\1", full.lower()))
            return F.when(F.contains(t, F.lit(short.lower())), new).otherwise(t)

        return replaced

    lowered = F.lower(text)
    for short, full in terms.items():
        lowered = let(lowered, step(short, full))
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(plain)


def mark_phrases(text: Column) -> Column:
    """Phrases replaced by numbered placeholders.  Each hit lowers the whole
    text first, so only the last placeholder keeps its capitals."""
    def mark(phrase: str, placeholder: str):
        def step(t: Column) -> Column:
            hit = F.contains(F.lower(t), F.lit(phrase))
            marked = F.replace(F.lower(t), F.lit(phrase), F.lit(placeholder))
            return F.when(hit, marked).otherwise(t)

        return step

    # Fixed value: the form of the placeholder
    for i, phrase in enumerate(lexicons.PROTECTED_PHRASES):
        text = let(text, mark(phrase, f"TERM_{i}_PLACEHOLDER"))
    return text


def strip_urls(text: Column) -> Column:
    """Delete web and mail addresses; texts without their marks are not scanned."""
    def strip(t: Column) -> Column:
        at, http, www = (F.contains(t, F.lit(m)) for m in ("@", "http", "www"))
        return F.when(at | http | www, F.regexp_replace(t, URL_OR_MAIL, "")).otherwise(t)

    return let(text, strip)


def letters_only(text: Column) -> Column:
    """Every run of characters other than ASCII letters becomes one space."""
    return F.regexp_replace(text, "[^a-zA-Z]+", " ")


def drop_stop_words(tokens: Column, stop_words: list[str] = None) -> Column:
    dropped = lexicons.STOP_WORDS if stop_words is None else stop_words
    return F.filter(tokens, lambda t: ~t.isin(["", *dropped]))


def clean_tokens(
    text: Column,
    phrases: str = "restore",
    terms: dict[str, str] = None,
    stop_words: list[str] = None,
) -> Column:
    """Cleaned tokens before lemmatizing.

    ``phrases="restore"`` keeps the words of a protected phrase (they survive
    the letter filter by themselves); ``"observed"`` leaves the placeholder
    words in the text.
    """
    if phrases not in ("restore", "observed"):
        raise ValueError(f"Unknown phrase mode: {phrases}")
    text = lower_normalized(text, terms)
    if phrases == "observed":
        text = mark_phrases(text)
    return drop_stop_words(F.split(letters_only(strip_urls(text)), " "), stop_words)


def clean_text(text: Column, **options) -> Column:
    """Cleaned text with identity lemmas; null gives ``""``."""
    return F.array_join(clean_tokens(text, **options), " ")
