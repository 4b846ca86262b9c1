"""Text expressions. Everything here is a JVM-side column; nothing calls Python per row."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# The characters Python treats as line ends and as whitespace, as Java regex source.
# Single characters below 256 and the guarded range keep the class at two tests per character.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
OTHER_LINE_END = f"\r\n|[{OTHER_LINE_ENDS}]"
SPACE_CHARS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
SPACE = f"[{SPACE_CHARS}]"
NOT_ONE_BLANK = f" {SPACE}+|[{SPACE_CHARS.replace(' ', '')}]{SPACE}*"  # a run that is not a single blank
NOT_SPACE = f"[^{SPACE_CHARS}]"
PARAGRAPH = "  \n"
PACK_SLICE = 128  # sentences packed at a time
SENTENCE_END = f"(?<=[.?!]){SPACE}+"

# ASCII spellings of characters that do not decompose into a base letter.
ASCII_SPELLING = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "\u00a0": " ",
    "ẞ": "SS", "‚": ",", "„": '"', "‹": "<", "›": ">", "«": "<<", "»": ">>", "•": "*", "·": "*", "−": "-",
    "‐": "-", "‑": "-", "‒": "-", "€": "EUR", "£": "GBP", "©": "(c)", "®": "(r)", "°": "deg", "×": "x", "\u00ad": "",
}
COMBINING = "[\u0300-\u036f]"
# Latin compatibility forms: spaces and marks, fractions and numerals, letter-like signs, ligatures, full width.
COMPATIBILITY_RANGES = [(0x00A0, 0x00C0), (0x2000, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` names it: a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines of a page: every kind of line end splits, and a final line end adds no empty line."""
    # All line ends become "\n" first, and only where a byte search finds others: most texts need no regex.
    has_others = reduce(or_, [F.contains(text, F.lit(end)) for end in OTHER_LINE_ENDS])
    ended = F.when(has_others, F.regexp_replace(text, OTHER_LINE_END, "\n")).otherwise(text)
    inner = F.when(F.endswith(ended, F.lit("\n")), F.left(ended, F.length(ended) - 1)).otherwise(ended)
    return F.when(ended == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\n", -1))


def line_lengths(text: Column) -> Column:
    return F.transform(lines(text), F.length)


def single_spaced(text: Column) -> Column:
    """The words of a text joined by single spaces."""
    return F.trim(F.regexp_replace(text, NOT_ONE_BLANK, " "))


def _words_in(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(
        F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1
    )


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return _words_in(single_spaced(text))


def is_not_blank(text: Column) -> Column:
    return text.rlike(NOT_SPACE)


def split_sentences(text: Column) -> Column:
    """Cut at whitespace that follows a full stop, question mark or exclamation mark."""
    return F.split(text, SENTENCE_END, -1)


def _packed(spaced: Column, max_words: int) -> Column:
    """Greedy packing of a single-spaced unit: its sentences are cut at blanks, and words count blanks."""
    # only the blank is left of all white space: a line end can mark where sentences end, and no regex has to look back
    marked = reduce(lambda t, end: F.replace(t, F.lit(f"{end} "), F.lit(f"{end}\n")), ".?!", spaced)
    sentences = F.transform(F.split(marked, "\n", -1), lambda s: F.struct(s.alias("text"), _words_in(s).alias("n")))

    def start(text: Column, n: Column) -> Column:
        return F.struct(F.array().cast("array<string>").alias("done"), text.alias("text"), n.alias("n"))

    def add(acc: Column, s: Column) -> Column:
        glue = F.when((acc["n"] > 0) & (s["n"] > 0), " ").otherwise("")
        fits = acc["n"] + s["n"] <= max_words
        more = F.struct(acc["done"].alias("done"), F.concat(acc["text"], glue, s["text"]).alias("text"), (acc["n"] + s["n"]).alias("n"))
        done = F.concat(acc["done"], F.array(acc["text"]))
        return F.when(fits, more).otherwise(F.struct(done.alias("done"), s["text"].alias("text"), s["n"].alias("n")))

    # Sentences are taken in slices, so that an accumulated array that is copied at each step stays short: the
    # slices carry the open part over, and finished parts are kept slice by slice.
    def add_slice(acc: Column, piece: Column) -> Column:
        last = acc["last"]
        return F.struct(
            F.concat(acc["done"], F.array(last["done"])).alias("done"),
            F.aggregate(piece, start(last["text"], last["n"]), add).alias("last"),
        )

    def finish(acc: Column) -> Column:
        last = acc["last"]
        rest = F.when(last["n"] > 0, F.array(last["text"])).otherwise(F.array().cast("array<string>"))
        return F.concat(F.flatten(acc["done"]), last["done"], rest)

    def in_slices(all_sentences: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(all_sentences) - 1, F.lit(PACK_SLICE))
        return F.transform(firsts, lambda i: F.slice(all_sentences, i + 1, F.lit(PACK_SLICE)))

    slices = F.element_at(F.transform(F.array(sentences), in_slices), 1)
    begin = F.struct(F.array().cast("array<array<string>>").alias("done"), start(F.lit(""), F.lit(0)).alias("last"))
    return F.aggregate(slices, begin, add_slice, finish)


def packed_parts(unit: Column, max_words: int) -> Column:
    """Parts of one unit: the unit itself, or if it has more than `max_words` words, its sentences
    packed greedily up to that number.

    A first sentence that is too long by itself leaves an empty part before it, and a sentence is
    never cut further, however long. Words of packed parts are separated by single spaces.
    """
    # one-element transform: normalises the spaces once for counting and for packing
    counted = F.element_at(
        F.transform(
            F.array(single_spaced(unit)),
            lambda s: F.when(_words_in(s) > max_words, _packed(s, max_words)).otherwise(F.array(unit)),
        ),
        1,
    )
    # a text with n words has at least 2n - 1 characters: most units need no count
    return F.when(F.length(unit) > 2 * max_words, counted).otherwise(F.array(unit))


def unit_array(text: Column, split_regex: str, max_words: int) -> Column:
    """Paragraph units of a text, oversized ones packed; the array position is the unit index."""
    return F.flatten(F.transform(F.split(text, split_regex, -1), lambda u: packed_parts(u, max_words)))


def _letter_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decompositions."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def _compatibility_forms() -> tuple[str, str, dict[str, str]]:
    """Characters with an ASCII compatibility form: those of one character, and the spellings of the others."""
    single, plain, spelled = [], [], {}
    for low, high in COMPATIBILITY_RANGES:
        for code in range(low, high):
            form = unicodedata.normalize("NFKD", chr(code)).replace("\u2044", "/")
            form = "".join(c for c in form if not unicodedata.combining(c))
            if not form.isascii() or not form or form == chr(code) or chr(code) in ASCII_SPELLING:
                continue
            if len(form) == 1:
                single.append(chr(code))
                plain.append(form)
            else:
                spelled[chr(code)] = form
    return "".join(single), "".join(plain), spelled


# Letters whose usual spelling does not follow from their name.
NAMED_LETTERS = {
    "GREEK RHO": "R", "GREEK CHI": "KH", "CYRILLIC GHE": "G", "CYRILLIC HA": "KH", "CYRILLIC IE": "E", "CYRILLIC YERU": "Y",
    "CYRILLIC HARD SIGN": '"', "CYRILLIC SOFT SIGN": "'", "CYRILLIC BYELORUSSIAN-UKRAINIAN I": "I", "CYRILLIC UKRAINIAN IE": "IE",
}
# Greek with its accented forms, Cyrillic of the living Slavic languages
NAMED_RANGES = [(0x0386, 0x03CF), (0x0400, 0x0460), (0x1F00, 0x2000)]


def _spelling(script: str, name: str) -> str:
    """A letter's spelling from its name: what a Greek name begins with, the consonants of a Cyrillic one."""
    if f"{script} {name}" in NAMED_LETTERS:
        return NAMED_LETTERS[f"{script} {name}"]
    if script == "GREEK":
        name = name.split()[-1]  # the final sigma is a sigma
        return re.match("[AEIOU]|[^AEIOU]+", name)[0]
    return name if name[0] == "Y" else re.sub("[AEIOU]", "", name) or name


def _named_letters() -> tuple[str, str, dict[str, str]]:
    """Greek and Cyrillic letters, spelt by their Unicode names: those of one letter, and the spellings of the others."""
    single, plain, spelled = [], [], {}
    for low, high in NAMED_RANGES:
        for code in range(low, high):
            base = unicodedata.normalize("NFD", chr(code))[0]
            found = re.fullmatch(r"(GREEK|CYRILLIC) (SMALL|CAPITAL) LETTER (.+)", unicodedata.name(base, ""))
            if not found:
                continue
            spelt = _spelling(found[1], found[3])
            spelt = spelt.lower() if found[2] == "SMALL" else spelt.capitalize()
            if len(spelt) == 1:
                single.append(chr(code))
                plain.append(spelt)
            else:
                spelled[chr(code)] = spelt
    return "".join(single), "".join(plain), spelled


_ACCENTED, _PLAIN = _letter_table()
_FORMS, _FORMS_PLAIN, _SPELLED = _compatibility_forms()
_OTHERS = f"[{''.join(_SPELLED)}]"
_NAMED, _NAMED_PLAIN, _NAMED_SPELLED = _named_letters()
_NAMED_SCRIPTS = "[\u0386-\u045f\u1f00-\u1fff]"


def _spelt_out(text: Column) -> Column:
    """Greek and Cyrillic letters in Latin ones."""
    out = F.translate(text, _NAMED, _NAMED_PLAIN)
    for letter, spelling in _NAMED_SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    return out


def _single_and_spelt(spellings: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """Characters spelled by one character or by none, for `translate`, and the spellings of the others."""
    single = sorted((c for c in spellings if len(spellings[c]) < 2), key=lambda c: -len(spellings[c]))
    return "".join(single), "".join(spellings[c] for c in single), {c: s for c, s in spellings.items() if len(s) > 1}


_MARKS, _MARKS_PLAIN, _MARKS_SPELLED = _single_and_spelt(ASCII_SPELLING)


def ascii_fold(text: Column) -> Column:
    """Latin letters without accents; ligatures, compatibility forms and typographic marks spelled out.

    Greek and Cyrillic letters are spelt by the names of the letters. Combining marks go. Other scripts stay as they
    are. Pure ASCII texts skip all passes, and texts without these letters, marks or compatibility forms the passes for
    them. `fold_text` is the same for one Python string.
    """
    named = F.when(text.rlike(_NAMED_SCRIPTS), _spelt_out(text)).otherwise(text)
    plain = F.translate(named, _ACCENTED + _FORMS + _MARKS, _PLAIN + _FORMS_PLAIN + _MARKS_PLAIN)
    folded = plain
    for mark, spelling in _MARKS_SPELLED.items():
        folded = F.replace(folded, F.lit(mark), F.lit(spelling))
    folded = F.when(text.rlike(f"[{''.join(_MARKS_SPELLED)}]"), folded).otherwise(plain)
    forms = F.regexp_replace(folded, COMBINING, "")
    for mark, spelling in _SPELLED.items():
        forms = F.replace(forms, F.lit(mark), F.lit(spelling))
    rare = text.rlike(f"{COMBINING}|{_OTHERS}")
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(~is_ascii, F.when(rare, forms).otherwise(folded)).otherwise(text)


# Later entries win, as the earlier passes of `ascii_fold` do: what a pass spells is ASCII and meets no later one.
_SPELLINGS = (
    _SPELLED
    | {chr(code): "" for code in range(0x0300, 0x0370)}
    | ASCII_SPELLING
    | dict(zip(_ACCENTED + _FORMS, _PLAIN + _FORMS_PLAIN, strict=True))
    | dict(zip(_NAMED, _NAMED_PLAIN, strict=True))
    | _NAMED_SPELLED
)


def fold_text(text: str) -> str:
    """`ascii_fold` of one Python string."""
    return text if text.isascii() else re.sub("[^\x00-\x7f]", lambda m: _SPELLINGS.get(m[0], m[0]), text)
