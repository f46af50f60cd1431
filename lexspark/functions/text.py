"""Column functions over text. All are built-in expressions; byte and character lengths are told apart."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: Regular expression classes as RE2 means them; Java's \s and \b differ.
SPACE = r"[\t\n\f\r ]"
WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+\z", "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_prefix(x: Column | str, most: int) -> Column:
    """The longest run of whole characters from the start within ``most`` bytes."""

    def cut(short: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda i: F.octet_length(F.left(short, i)) <= most)
        return F.when(F.octet_length(short) <= most, short).otherwise(F.left(short, F.array_max(fits)))

    return let(F.left(col(x), F.lit(most)), cut)


def redact(x: Column | str) -> Column:
    """Replace private blocks, then each kind of secret in order. Texts without any hint of one are passed as they are."""
    x = col(x)
    # plain searches in one lower-cased copy: an alternation would be tried at every character
    some = let(F.lower(x), lambda low: reduce(or_, [F.contains(low, F.lit(hint)) for hint in lexicon.SECRET_HINTS]))
    out = F.regexp_replace(x, lexicon.PRIVATE_BLOCK, lexicon.PRIVATE_MARK)
    for pattern in lexicon.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, lexicon.SECRET_MARK)
    return F.when(some, out).otherwise(x)


def vocabulary_words(x: Column | str) -> Column:
    """Lower-case runs of letters, digits, _ and -, of 3 bytes or more, without stopwords; repeats included."""
    words = F.split(F.lower(col(x)), r"[^\p{L}\p{N}_-]+")
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*sorted(lexicon.STOPWORDS)))


def word_tokens(x: Column | str) -> Column:
    """Tokens of the word index: runs of letters and digits, lower case, Latin diacritics folded."""
    return _tokens(fold(F.lower(col(x))))


def bare_tokens(x: Column | str) -> Column:
    """word_tokens before they are folded: as many, since folding makes a letter of a letter."""
    return _tokens(F.lower(col(x)))


def _tokens(x: Column) -> Column:
    return F.array_remove(F.split(x, r"[^\p{L}\p{N}\p{Co}]+"), "")


def token_count(x: Column | str) -> Column:
    """How many word_tokens there are."""
    return F.size(bare_tokens(x))


#: Latin letters with diacritics and their bases.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


#: The same for Python's str.translate.
FOLDED = str.maketrans(_MARKED, _PLAIN)


def fold(x: Column | str) -> Column:
    """Texts of one byte per character have nothing to fold."""
    x = col(x)
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(x, _MARKED, _PLAIN))


def byte_levenshtein(a: Column | str, b: Column | str, most: Column | int | None = None) -> Column:
    """Edit distance over UTF-8 bytes (-1 beyond ``most``): each byte becomes one character before Spark counts."""
    bytes_ = lambda x: F.decode(F.encode(col(x), "UTF-8"), "ISO-8859-1")
    return F.levenshtein(bytes_(a), bytes_(b)) if most is None else F.levenshtein(bytes_(a), bytes_(b), most)


def max_edits(length: Column) -> Column:
    """Edits allowed for a word of so many bytes."""
    return F.when(length <= 4, 1).when(length <= 12, 2).otherwise(3)


def one_decimal(x: Column) -> Column:
    """One digit after the point; halves go to the even digit, and what is just below zero is -0.0, as in C."""
    rounded = F.bround(x.cast("double"), 1)
    return F.concat(F.when((rounded == 0) & (x < 0), "-").otherwise(""), F.format_string("%.1f", rounded))


def human_bytes(n: Column | str) -> Column:
    n = col(n)
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.concat(one_decimal(n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(one_decimal(n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(one_decimal(n / 1024**3), F.lit(" GB")))
    )


def head(x: Column | str, most: int) -> Column:
    """The first ``most`` characters, and … where some are cut."""
    x = col(x)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most)), F.lit("…")))


def head_tail(x: Column | str, most: int) -> Column:
    """Three quarters of ``most`` characters from the start, the others from the end, with … between."""
    x = col(x)
    front = most * 3 // 4
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(front)), F.lit("…"), F.right(x, F.lit(most - front))))
