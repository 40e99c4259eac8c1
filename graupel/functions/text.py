"""String functions: normal forms, scripts, suffixes, languages."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Script ranges, suffixes, junk fragments, language order.
SCRIPTS = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}"
HANGUL = r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}"
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}"
SUFFIXES = ("ex", "EX", "GX", "V", "VMAX", "VSTAR")
JUNK = ("hp", "기본", "진화", "進化", "から", "테라스탈")
LANGUAGES = ("ja", "ko", "zh-Hans", "en")
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_WIDE = "".join(chr(c) for c in (0x3000, *range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(c) for c in (0x20, *range(0x21, 0x7F)))


def id_in_url(url: Column) -> Column:
    """The number at the end of a URL's path; an error where there is none."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    found = F.regexp_extract(path, r"/(\d+)/?$", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no id in "), url)))


def squeezed(text: Column) -> Column:
    """White space of any kind made single spaces, none at the ends.  Single
    spaces aren't matched, so a text that needs no change is only scanned."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " "))


def stripped(text: Column) -> Column:
    """No white space of any kind at the ends; a text without is left as it is."""
    cut = F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(text, f"^{SPACE}+", "")), f"^{SPACE}+", ""))
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(SPACE)), cut).otherwise(text)


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.arrow_udf(ArrayType(StringType()))
def nfkc_each(lists: pa.Array) -> pa.Array:
    """Compatibility forms of the texts in each array, on the flat values."""
    flat = lists.flatten().dictionary_encode()
    plain = pa.array([unicodedata.normalize("NFKC", x) for x in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, plain.take(flat.indices), mask=lists.is_null())


def observation_key(text: Column) -> Column:
    """Compatibility form, single spaces, lower case."""
    return F.lower(squeezed(nfkc(text)))


def narrow(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as plain ASCII."""
    return F.translate(text, _WIDE, _NARROW)


def has_script(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{SCRIPTS}]"))


def has_latin(text: Column) -> Column:
    """Any letter or mark outside the supported scripts."""
    return F.rlike(text, F.lit(rf"[\p{{L}}\p{{M}}&&[^{SCRIPTS}]]"))


def title(text: Column) -> Column:
    """The canonical form of a title: narrow, single spaces (none between
    characters of the supported scripts alone), suffix ``ex`` mended."""

    def closed(plain: Column) -> Column:
        return F.when(has_script(plain) & ~has_latin(plain), F.replace(plain, F.lit(" "), F.lit(""))).otherwise(plain)

    def mended(plain: Column) -> Column:
        cut = F.substring(plain, F.lit(1), F.length(plain) - 1)
        return F.when(F.endswith(plain, F.lit("e")) & has_script(cut), F.concat(plain, F.lit("x"))).otherwise(plain)

    def canonical(plain: Column) -> Column:
        head = F.substring(plain, F.lit(1), F.length(plain) - 2)
        ends = F.lower(F.right(plain, F.lit(2))) == "ex"
        return F.when(ends & has_script(head), F.concat(stripped(head), F.lit("ex"))).otherwise(plain)

    return bound(bound(bound(squeezed(narrow(text)), closed), mended), canonical)


#: Characters that are each a grapheme of their own.
_SINGLE = r"\x20-\x7E\x{A0}-\x{AC}\x{AE}-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}"


def graphemes(text: Column) -> Column:
    """Length in user-perceived characters."""
    return F.when(F.rlike(text, F.lit(f"[^{_SINGLE}]")), F.length(F.regexp_replace(text, r"\X", "x"))).otherwise(F.length(text))


def digit_ratio(text: Column) -> Column:
    return share_of_digits(F.regexp_count(text, F.lit(r"\p{Nd}")), graphemes(text))


def share_of_digits(digits: Column, n: Column) -> Column:
    return F.when(n > 0, digits / n).otherwise(0.0)


def is_junk(text: Column) -> Column:
    def holds(low: Column) -> Column:
        out = F.lit(False)
        for fragment in JUNK:
            out = out | F.contains(low, F.lit(fragment))
        return out

    return bound(F.lower(F.replace(text, F.lit(" "), F.lit(""))), holds)


def has_suffix(text: Column) -> Column:
    """Ends in a mechanic suffix after white space or a supported script."""
    end = F.right(text, F.lit(max(map(len, SUFFIXES)) + 1))
    return F.rlike(end, F.lit(rf"(?:{SPACE}|[{SCRIPTS}])(?:{'|'.join(SUFFIXES)})\z"))


_BACKWARDS = "|".join(x[::-1] for x in SUFFIXES)


def without_suffixes(text: Column) -> Column:
    """Trailing suffixes and white space at both ends taken away; looked for in
    the reversed text, where they stand at its start."""
    cut = F.reverse(F.regexp_replace(F.reverse(text), f"^{SPACE}*(?:(?:{_BACKWARDS}){SPACE}*)*", ""))
    return F.regexp_replace(cut, f"^{SPACE}+", "")


def language(text: Column) -> Column:
    """Language of a title by its scripts, null where there is no sign of one."""
    return bound(
        without_suffixes(text),
        lambda t: F.when(F.length(t) == 0, None)
        .when(~has_script(t), F.when(has_latin(t), "en"))
        .when(F.rlike(t, F.lit(f"[{KANA}]")), "ja")
        .when(F.rlike(t, F.lit(f"[{HANGUL}]")), "ko")
        .when(F.contains(t, F.lit("的")) | F.rlike(t, F.lit(f"^[{IDEOGRAPHS}]+$")), "zh-Hans"),
    )


def plausible_title(text: Column) -> Column:
    """4 to 20 characters, letters, blanks, - and ' alone, a vowel, and not
    mostly capitals.  The rule that fails soonest is asked first, and each only
    where those before it hold; conditions joined by & may all be evaluated."""
    upper, lower = F.regexp_count(text, F.lit(r"[\p{Lu}\p{Lt}]")), F.regexp_count(text, F.lit(r"\p{Ll}"))
    plausible = ~((upper > lower) & (lower <= 1))
    for rule in (graphemes(text).between(4, 20), F.rlike(text, F.lit("[AEIOUaeiou]")), F.rlike(text, F.lit(r"^[\p{L}\p{M} '-]*$")), F.length(text) >= 4):
        plausible = F.when(rule, plausible).otherwise(False)
    return F.when(text.isNotNull(), plausible)


def needs_another_pass(text: Column, dominant: Column) -> Column:
    """Whether a chosen title (null: none) leaves room for a further pass."""
    differs = ~language(text).eqNullSafe(dominant)
    return F.when(text.isNull() | differs, True).when(has_script(text), ~has_suffix(text)).otherwise(~plausible_title(text))


def satisfies(text: Column, dominant: Column) -> Column:
    """Whether a title needs no further pass.  Only texts that end in a suffix
    or are plausible can, which most show at their first characters or their
    last; scripts and language are looked for in these alone."""
    may = F.when(has_suffix(text), True).otherwise(plausible_title(text))
    return F.when(may, ~needs_another_pass(text, dominant)).otherwise(False)


def shortened(text: Column, n: int = 18) -> Column:
    """Without white space at the ends; more than ``n`` user-perceived
    characters are cut to ``n`` and three dots."""
    return bound(stripped(text), lambda t: F.when(graphemes(t) > n, F.concat(F.regexp_extract(t, rf"^\X{{{n}}}", 0), F.lit("..."))).otherwise(t))


def two_decimals(number: Column) -> Column:
    """A number as shown: two digits behind the point, halves to even."""
    return F.format_string("%.2f", F.bround(number.cast("decimal(38, 12)"), 2).cast("double"))


def rect_text(box: Column) -> Column:
    """A rectangle as shown: place and size with two decimals each."""
    return F.concat_ws(", ", *(two_decimals(box[n]) for n in "xywh"))


def issue_path(parts: Column) -> Column:
    """Parts joined by dots, ``<root>`` where there are none."""
    return F.coalesce(F.nullif(F.array_join(parts, "."), F.lit("")), F.lit("<root>"))
