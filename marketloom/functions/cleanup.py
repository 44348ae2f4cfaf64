"""Column builders that tidy names and descriptions and print values. No Python runs on rows; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of pictographs and of the marks that join or vary them, as a class; what may stand at the
#: ends of a name and means nothing there; the character for three dots.
PICTOGRAPHS = r"\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FFFF}\x{200D}\x{FE0E}\x{FE0F}"
SEPARATORS = " \t\n\r-–—·:"
ELLIPSIS = "…"
#: Over this many letters, and over this share of capitals among them, a text is shouted.
SHOUT_LETTERS, SHOUT_SHARE = 5, 0.6
#: Words that make a description prose, and characters before the dots that make a cut name usable.
PROSE_WORDS, CUT_HEAD = 4, 8


def joined_tokens(text: Column, pattern: str) -> Column:
    """All matches of a pattern with one space between."""
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " ")


def without_pictographs(text: Column) -> Column:
    """Text without pictographs, runs of white space as one space, no separators at its ends."""
    bare = F.regexp_replace(text, f"[{PICTOGRAPHS}]", "")
    return F.btrim(joined_tokens(bare, r"(?U)\S+"), F.lit(SEPARATORS))


def tidy_name(name: Column) -> Column:
    """A name's words, plus signs and dashes that end a word as tokens with one space between; no dots at the end.

    Dashes inside a word stay there.
    """
    return F.rtrim(F.rtrim(joined_tokens(name, r"(?U)\+|-(?=\s|$)|(?:[^\s+-]|-(?!\s|$))+"), F.lit(". ")))


def sentence_case(text: Column) -> Column:
    """Shouted texts with a capital first and all else small; others stay as they are."""
    letters, capitals = (F.regexp_count(text, F.lit(x)) for x in (r"\p{L}", r"\p{Lu}"))
    shouted = (letters > SHOUT_LETTERS) & (capitals > SHOUT_SHARE * letters)
    return F.when(shouted, capital_first(F.lower(text))).otherwise(text)


def capital_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def tidy_sentence(text: Column) -> Column:
    """A description with regular punctuation; applying it twice changes nothing more.

    The text is a row of words, runs of marks and white space, and each token is written by its neighbours: white
    space not at the ends nor before a mark, as one space, or as line breaks where it holds some; two dots or more as
    an ellipsis, repeated commas and semicolons once; a space between a mark other than a comma and a letter. The
    first letter is a capital. A full stop ends what ends in a letter and is prose: four words, or a mark before the
    end. Items of lists (a dash, a bullet or a star first) get none.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\s+|\.+|,+|;+|[:!?…]|[^\s.,;:!?…]+"), F.lit(0))
    mark = lambda t: t.rlike(r"^[.,;:!?…]")
    blank = lambda t: t.rlike(r"(?U)^\s")

    def written(own: Column):
        def token(t: Column, i: Column) -> Column:
            before, after = F.get(own, i - 1), F.get(own, i + 1)
            lone = before.isNull() | after.isNull() | mark(after)
            space = F.when(lone, "").when(t.contains("\n"), F.regexp_replace(t, r"[^\n]+", "")).otherwise(" ")
            sign = F.when(t.startswith(".") & (F.length(t) > 1), ELLIPSIS).otherwise(F.left(t, F.lit(1)))
            apart = t.rlike(r"^\p{L}") & F.coalesce(before.rlike(r"^([;:!?]|\.$)"), F.lit(False))
            return F.when(blank(t), space).when(mark(t), sign).when(apart, F.concat(F.lit(" "), t)).otherwise(t)

        return F.array_join(F.transform(own, token), "")

    out = capital_first(F.element_at(F.transform(F.array(tokens), written), 1))
    prose = out.rlike(r"[.,;:]") | (F.regexp_count(out, F.lit(r"(?U)\w+")) >= PROSE_WORDS)
    open_end = out.rlike(r"\p{L}$") & ~out.rlike(r"^[-•*—–]")
    return F.concat(out, F.when(open_end & prose, ".").otherwise(""))


def full_name(name: Column, candidates: Column) -> Column:
    """The first of ``candidates`` that a name cut by an ellipsis may stand for, or the name.

    Cut at its dots, the name's first part (long enough to tell) begins the candidate and its last part ends it, and
    the candidate has more between them.
    """
    own = F.trim(name)
    parts = F.transform(F.split(own, rf"\.\.\.|{ELLIPSIS}"), F.trim)
    head, tail = F.element_at(parts, 1), F.element_at(parts, -1)
    rest = lambda c: F.length(c) - F.length(head) - F.length(tail)
    fits = F.filter(F.transform(candidates, F.trim), lambda c: F.startswith(c, head) & F.endswith(c, tail) & (rest(c) > 0))
    cut = (F.size(parts) > 1) & (F.length(head) >= CUT_HEAD)
    return F.coalesce(F.when(cut, F.get(fits, F.lit(0))), own)


def character_drift(a: Column, b: Column) -> Column:
    """The larger of the relative difference of lengths and the share of characters that only one text has."""
    x, y = (F.array_distinct(F.split(F.lower(t), "")) for t in (a, b))
    apart = 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    longer = F.greatest(F.length(a), F.length(b))
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    either = F.when(F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")), F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(empty, either).otherwise(F.greatest(F.abs(F.length(a) - F.length(b)) / longer, apart))


def share_tokens(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether two phrases share a token and at least ``least`` of the shorter one's; false if one is null."""
    x, y = (F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")) for t in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.coalesce((both > 0) & (both >= least * F.least(F.size(x), F.size(y))), F.lit(False))


def mean_weight(items: Column, field: str) -> Column:
    """Mean of a numeric field over an array of structs, without nulls; null if there is none."""
    values = F.filter(F.transform(items, lambda x: x[field].cast("double")), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values))


# --- printing ---------------------------------------------------------------------------------------------


def counted(n: Column, one: str, few: str, many: str) -> Column:
    """A number with the noun form that Polish takes after it."""
    is_few = F.pmod(n, F.lit(10)).between(2, 4) & ~F.pmod(n, F.lit(100)).between(12, 14)
    form = F.when(n == 1, one).when(is_few, few).otherwise(many)
    return F.concat_ws(" ", F.coalesce(n, F.lit(0)).cast("string"), form)


def duration_label(minutes: Column) -> Column:
    """``45min``, ``2h`` or ``1h 30min``."""
    hours, rest = F.floor(minutes / 60), F.pmod(minutes, F.lit(60))
    long = F.when(rest == 0, F.format_string("%dh", hours)).otherwise(F.format_string("%dh %dmin", hours, rest))
    return F.when(minutes.isNull(), None).when(minutes < 60, F.format_string("%dmin", minutes)).otherwise(long)


def price_label(text: Column, minor: Column) -> Column:
    """The price's own text, else whole units of the minor amount, else a dash."""
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.round(minor / 100).cast("long").cast("string"), F.lit(" zł")), F.lit("—"))


def amount_label(value: Column) -> Column:
    """``12,5 zł``: two decimals at most, none that are zero; empty if null."""
    digits = F.regexp_replace(F.regexp_replace(F.round(value, 2).cast("decimal(18,2)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.coalesce(F.concat(F.translate(digits, ".", ","), F.lit(" zł")), F.lit(""))


def quadrants(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """The four quarters of a box as an array of structs ``top, right, bottom, left``: north first, then east first."""
    y, x = (top + bottom) / 2, (left + right) / 2
    box = lambda t, r, b, l: F.struct(t.alias("top"), r.alias("right"), b.alias("bottom"), l.alias("left"))  # noqa: E731, E741
    return F.array(box(top, right, y, x), box(top, x, y, left), box(y, right, bottom, x), box(y, x, bottom, left))
