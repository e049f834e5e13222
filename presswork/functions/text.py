"""Text expressions: one narrow, JVM-side pass from raw text to kept words."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.binding import let

# White space as Python sees it, written so that Java and RE2 agree.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIP = r"[^\p{L}\p{N}_." + SPACE + "]"
SPACES = f"[{SPACE}]+"
# Runs are entered at their first character only and never given back (possessive), so that
# long junk runs cost linear time.
OUTER_SPACES = rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"
FINAL_DOTS = rf"(?<!\.)\.++(?=[{SPACE}]|\z)"
SENTENCE_BREAK = rf"(?<=[.!?])[{SPACE}]+|\n+"
LETTER = r"[A-Za-z]|\p{L}"

# White space but the blank and the line end, and the same places as above for Java after these have become blanks: led by
# a plain character, so that most places are turned away at once.
RARE_SPACES = "\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_FINAL_DOTS = r"\.(?<!\.\.)\.*+(?=[ \n]|\z)"
_PLAIN_BREAK = r"[ \n](?:(?<=[.!?][ \n])[ \n]*+|(?<=\n)\n*+)"

# Tags dropped by default (number, foreign/other, punctuation) and literal tokens.
DROP_TAGS = ("M", "X", "CH")
DROP_LITERALS = ("'", ",")

URL = r"(?:https?://|www\.)\S+"
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"

HTML_BLOCKS = r"(?is)<(script|style)\b.*?</(script|style)\s*>"
HTML_BLOCK_END = r"(?is)\A(.*</(?:script|style)\s*+>)"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"(?s)<[^>]*>"


def strip_chars(text: Column) -> Column:
    """Drop everything but letters, digits, underscore, dot and white space."""
    return F.regexp_replace(text, STRIP, "")


def plain_spaces(text: Column) -> Column:
    """Every white space but line ends as a blank: tokens are then cut at blanks, without a pattern compiled per sentence."""
    return F.translate(text, RARE_SPACES, " " * len(RARE_SPACES))


def between_blanks(line: Column) -> Column:
    """Tokens of a line with plain spaces."""
    return F.array_remove(F.split(line, " "), "")


def trim_spaces(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_SPACES, "")


def sentences(text: Column) -> Column:
    """Array of trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), trim_spaces), lambda s: s != "")


def words(sentence: Column) -> Column:
    """Array of tokens of one sentence; the closing dot is a token of its own."""
    return F.filter(F.split(F.regexp_replace(sentence, FINAL_DOTS, " ."), SPACES), lambda t: t != "")


def sentence_words(text: Column) -> Column:
    """Array (sentences) of arrays (tokens) of the stripped text."""
    # a closing dot stands before white space or the end, so it is found in the whole text as in its sentences
    dotted = F.regexp_replace(plain_spaces(strip_chars(text)), _FINAL_DOTS, " .")
    return F.filter(F.transform(F.split(dotted, _PLAIN_BREAK), between_blanks), lambda tokens: F.size(tokens) > 0)


def rule_tag(token: Column) -> Column:
    """``N`` with a letter, ``M`` with digits only, ``CH`` with neither."""
    return F.when(token.rlike(LETTER), "N").when(token.rlike(r"\p{N}"), "M").otherwise("CH")


def is_kept(token: Column, drop_tags=DROP_TAGS, drop_literals=DROP_LITERALS, tag: Column | None = None) -> Column:
    tag = rule_tag(token) if tag is None else tag
    return ~tag.isin(*drop_tags) & ~token.isin(*drop_literals)


def kept_words(text: Column, drop_tags=DROP_TAGS, drop_literals=DROP_LITERALS) -> Column:
    """Lower-cased kept tokens of a raw text, in order.

    Dots before white space close a sentence, so the tokens of all sentences are found without
    building the sentences. When numbers and punctuation are both dropped, as by default, the
    words with a letter are what is left.
    """
    stripped = strip_chars(text)
    if {"M", "CH"} <= set(drop_tags) and "N" not in drop_tags:
        plain = F.lower(F.regexp_replace(plain_spaces(stripped), _FINAL_DOTS, ""))
        kept = F.filter(F.split(plain, "[ \n]"), lambda t: t.rlike(LETTER))
        literals = [w.lower() for w in drop_literals if any(ch.isalpha() for ch in w)]
        return F.filter(kept, lambda t: ~t.isin(*literals)) if literals else kept
    kept = F.filter(words(stripped), lambda t: is_kept(t, drop_tags, drop_literals))
    return F.transform(kept, F.lower)


def processed_text(text: Column, drop_tags=DROP_TAGS, drop_literals=DROP_LITERALS) -> Column:
    """Kept words joined by one blank; ``''`` when nothing is kept, null for null."""
    return F.array_join(kept_words(text, drop_tags, drop_literals), " ")


def scrub_links_emails_numbers(text: Column) -> Column:
    """Replace links, e-mail addresses and numbers by blanks and squeeze white space."""
    for pattern in (URL, EMAIL, NUMBER):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _entity(name: Column) -> Column:
    """Character for an entity name (``amp``) or number (``#38``, ``#x26``); null if unknown."""
    names = {**html.entities.name2codepoint, "apos": ord("'")}
    table = F.create_map(*[F.lit(v) for k, cp in sorted(names.items()) for v in (k, chr(cp))])
    digits = F.regexp_extract(name, r"\A#0*+([0-9]{1,7})\z", 1)
    hex_digits = F.regexp_extract(name, r"\A#[xX]0*+([0-9A-Fa-f]{1,6})\z", 1)
    code = F.when(hex_digits != "", F.conv(hex_digits, 16, 10)).when(digits != "", digits).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.when(name.startswith("#"), number).otherwise(F.element_at(table, name))


def decode_entities(text: Column) -> Column:
    """Decode every named (HTML 4 and ``apos``) and numeric entity once, left to right."""
    pieces = F.split(text, "&")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"\A(#?[A-Za-z0-9]++);", 1)
        char = F.when(name != "", _entity(name))
        return F.when(char.isNotNull(), F.concat(char, F.substring(p, F.length(name) + 2, F.length(p)))).otherwise(
            F.concat(F.lit("&"), p))

    tail = F.transform(F.slice(pieces, 2, F.size(pieces)), piece)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))).otherwise(text)


def _blank_up_to_last(text: Column, pattern: str, tail_of) -> Column:
    """Matches of ``pattern`` to blanks, looking no further than the last closer.

    An opener without a closer would otherwise be followed to the end of the text each time.
    """
    def apply(t: Column) -> Column:
        def parts(tail: Column) -> Column:
            head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
            return F.concat(F.regexp_replace(head, pattern, " "), tail)

        return let(tail_of(t), parts)

    return let(text, apply)


def clean_html(html: Column) -> Column:
    """Visible text of an HTML body: blocks and comments out, tags to blanks, entities decoded."""
    text = _blank_up_to_last(
        html, HTML_BLOCKS, lambda t: F.substring(t, F.length(F.regexp_extract(t, HTML_BLOCK_END, 1)) + 1, F.length(t)))
    text = _blank_up_to_last(text, HTML_COMMENT, lambda t: F.substring_index(t, "-->", -1))
    text = _blank_up_to_last(text, HTML_TAG, lambda t: F.substring_index(t, ">", -1))
    return F.trim(F.regexp_replace(let(text, decode_entities), r"\s+", " "))


def _accent_pairs() -> tuple[str, str]:
    accented, plain = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            accented.append(chr(cp))
            plain.append(base)
    # these two have no Unicode decomposition
    return "".join(accented) + "đĐ", "".join(plain) + "dD"


ACCENTED, PLAIN = _accent_pairs()


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents (composed input)."""
    return F.translate(text, ACCENTED, PLAIN)


def stable_hash(value: Column, digits: int = 8) -> Column:
    """Non-negative integer from the leading hex digits of md5; the same in every engine."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def stable_uniform(value: Column) -> Column:
    """Number in [0, 1) from ``stable_hash``."""
    return stable_hash(value) / F.lit(float(1 << 32))
