"""Text functions as Column expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and limits of the text metrics.
WORD_PATTERN = r"[\p{L}\p{Nl}\p{No}]+"
TOKEN_SIZES = (32, 64, 128, 256)
SHORT_WORDS = 3
# The characters that are white space in the Unicode sense, and the ends of lines.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = f"[{SPACES}]"
PARAGRAPH_BREAK = f"(?:\r?\n{SPACE_CLASS}*){{2,}}"
SENTENCE_BREAK = f"(?<=[.!?]){SPACE_CLASS}+"
LINE_BREAK = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

IDEOGRAPHS = "[\u3400-\u9fff\uf900-\ufaff\U00020000-\U00031fff]"

Tokenizer = Callable[[Column], Column]


@functools.cache
def letter_numbers() -> str:
    """Characters that are letters and numbers at once: ideographs for numbers."""
    ranges = (range(0x3400, 0xA000), range(0xF900, 0xFB00), range(0x20000, 0x32000))
    return "".join(c for r in ranges for c in map(chr, r) if c.isnumeric() and c.isalpha())


@functools.cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """What case folding does beyond lower case: characters for one character each, and for several."""
    changed = [c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold()]
    single = [c for c in changed if len(c.casefold()) == 1]
    return "".join(single), "".join(c.casefold() for c in single), {c: c.casefold() for c in changed if len(c.casefold()) > 1}


@functools.cache
def folded_beyond_lower() -> str:
    """The class of what `foldings` changes, but for ß, as ranges; of plain letters one test says no."""
    single, _, several = foldings()
    runs: list[list[int]] = []
    for k in sorted(map(ord, (set(single) | set(several)) - {"ß"})):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "[[^\\x00-\\x7F]&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Maximal runs of letters (and letter-like numbers); digits and underscores end a word."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))


def letters_marked(text: Column) -> Column:
    """The text with each run of letters as one w: what is left of it is short, and has no other letter."""
    return F.regexp_replace(text, r"\p{L}+", "w")


def words_marked(marked: Column) -> Column:
    """From `letters_marked`: each word as one w, all else as it was, so it has the text's paragraphs,
    sentences and runs of non-space characters."""
    return F.when(marked.rlike(r"[\p{Nl}\p{No}]"), F.regexp_replace(marked, r"[w\p{Nl}\p{No}]+", "w")).otherwise(marked)


def marks(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit("w"), F.lit("")))


def non_empty_parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(strip(text), pattern), strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return non_empty_parts(text, PARAGRAPH_BREAK)


def sentences(text: Column) -> Column:
    return non_empty_parts(text, SENTENCE_BREAK)


def whitespace_tokens(text: Column) -> Column:
    """The tokenizer that needs no model: runs of non-space characters."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " +"), lambda x: x != "")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def count_of(text: Column, char_class: str) -> Column:
    """How many characters are in the class, such as "a-z"; runs of them are taken out at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def count_in(text: Column, characters: str) -> Column:
    """How many characters are among these; for long lists, of which a pattern would be slow."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def ideographic_numbers(text: Column) -> Column:
    return F.when(text.rlike(IDEOGRAPHS), count_in(text, letter_numbers())).otherwise(0)


def numerics(text: Column) -> Column:
    return count_of(text, r"\p{N}") + ideographic_numbers(text)


def letters(text: Column) -> Column:
    return count_of(text, r"\p{L}")


def vowels(text: Column) -> Column:
    """Plain vowels only; those with accents don't count."""
    return count_of(text, "aeiouAEIOU")


def letter_ratio(text: Column) -> Column:
    return ratio(letters(text), F.length(text))


def vowel_ratio(text: Column) -> Column:
    return ratio(vowels(text), letters(text))


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))


def average_word_length(text: Column) -> Column:
    found = words(text)
    return ratio(total_length(found), F.size(found))


def _class(characters: str) -> str:
    return f"[{re.escape(characters)}]"


def _expanded(text: Column, several: dict[str, str]) -> Column:
    long = functools.reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), several.items(), text)
    return F.when(text.rlike(_class("".join(several))), long).otherwise(text)


def fold_case(text: Column) -> Column:
    """Full case folding: lower case, single characters beyond it, and those that become several."""
    before, after, several = foldings()
    return _expanded(F.translate(F.lower(text), before, after), several)


def folded_words(text: Column) -> Column:
    """The words, case-folded. Folding the whole text first gives the same words and is faster, unless
    it puts marks that end a word into one. Most texts need no more than lower case and ß."""
    before, after, several = foldings()
    inside = {c: x for c, x in several.items() if x.isalpha() and c != "ß"}
    marks = "".join(c for c, x in several.items() if not x.isalpha()) + "İ"
    sharp = lambda c: F.replace(c, F.lit("ß"), F.lit("ss"))
    low = F.lower(text)
    whole = words(_expanded(sharp(F.translate(low, before, after)), inside))
    full = F.when(text.rlike(_class(marks)), F.transform(words(text), fold_case)).otherwise(whole)
    return F.when(low.rlike(folded_beyond_lower()) | F.contains(text, F.lit("İ")), full).otherwise(words(sharp(low)))


def type_token_ratio(found: Column) -> Column:
    """Different words among all, once their case is folded; of equal words only one is folded."""
    return ratio(F.size(F.array_distinct(folded_words(F.array_join(F.array_distinct(found), " ")))), F.size(found))


def estimated_chunks(tokens: Column, size: int) -> Column:
    """Token windows of this size that the text fills; 0 if it has no tokens."""
    return F.ceil(tokens / size).cast("int")


def remove_markdown_images(text: Column) -> Column:
    """Drop `![alt](target "title")`, with parentheses in balance down to three levels; links,
    line feeds and escaped marks stay, and the blanks around an image become one, or none at the
    end of a line."""
    level = r"[^()\n]*"
    for _ in range(3):
        level = rf"(?:[^()\n]|\({level}\))*"
    image = rf"(?<!\\)!\[(?:[^\[\]\\]|\\.|\[[^\]]*\])*\]\({level}\)"
    marked = F.regexp_replace(text, rf"[ \t]*(?:{image}[ \t]*)+", "\u0001")
    marked = F.regexp_replace(marked, "(?m)^\u0001|\u0001$", "")
    return F.when(F.contains(text, F.lit("![")), F.replace(marked, F.lit("\u0001"), F.lit(" "))).otherwise(text)


def normalize_token_chunk_start(text: Column) -> Column:
    """Without the mark of a word piece that continues a word."""
    return F.regexp_replace(text, "^##", "")


def chunk_metric(text: Column, metric: str) -> Column:
    if metric not in ("char", "word"):
        raise ValueError("metric must be char or word")
    return F.length(text) if metric == "char" else F.size(words(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def parse_bool(text: Column) -> Column:
    value = F.lower(F.trim(text))
    return F.when(value.isin("1", "true", "yes"), True).when(value.isin("0", "false", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def build_strategy(method: Column, config: Column) -> Column:
    """Strategy key of a chunking run from its method and JSON configuration."""
    count, overlap = F.get_json_object(config, "$.token_count"), F.coalesce(F.get_json_object(config, "$.token_overlap"), F.lit("0"))
    window = F.concat(F.lit("token_window_"), count, F.when(overlap.cast("int") != 0, F.concat(F.lit("_overlap_"), overlap)).otherwise(F.lit("")))
    return F.when(method.isin("token", "token_window") & count.isNotNull(), window).otherwise(method)


def format_strategy(strategy: Column) -> Column:
    """The key as people read it."""
    count = F.regexp_extract(strategy, "^token_window_([0-9]+)", 1)
    overlap = F.regexp_extract(strategy, "_overlap_([0-9]+)$", 1)
    window = F.concat(F.lit("Token window ("), count, F.lit(" tokens"), F.when(overlap != "", F.concat(F.lit(", "), overlap, F.lit(" overlap"))).otherwise(F.lit("")), F.lit(")"))
    plain = F.replace(strategy, F.lit("_"), F.lit(" "))
    return F.when(count != "", window).otherwise(F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1_000_000))))
