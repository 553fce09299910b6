"""Scalar text functions as Column expressions: they stay in generated code and push down with the plan.

White space is space, TAB, LF and CR unless said otherwise. Case is folded by lower case with sharp s
and final sigma unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliteration, particle suffixes, markers and patterns that results depend on.
TRANSLIT_LONG = (("щ", "sch"), ("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
TRANSLIT_FROM, TRANSLIT_TO = "абвгдеёзийклмнопрстуфхыэ", "abvgdeeziyklmnoprstufhye"
PLACEHOLDERS = ("untitled", "unknown", "no-title", "title", "na", "n-a", "none", "item-not-available", "anna-s-archive", "get")
PARTICLES = ("то", "либо", "нибудь", "таки")
HEADING_TAIL = r"([.:—\-]\s*.{0,80})?$"
HEADING_RANKS = (
    (1, r"^(том|книга|book|volume)\s+([0-9ivxlc]+|[а-яёa-z]+)"),
    (2, r"^(часть|part|раздел)\s+([0-9ivxlc]+|[а-яёa-z]+)"),
    (3, r"^(глава|chapter)\s+([0-9ivxlc]+|[а-яёa-z]+)"),
)
BARE_NUMBER = r"^([0-9]{1,4}|[IVXLC]{1,7})\.?$"
CAPS_MOST = 60
WORD_CHARS = r"[\p{L}\p{N}'’‘′‐‑−-]+"
STOP_WORDS = frozenset(
    "а бы в вы да для до же за и из к как ли мы на не но о об он она они оно от по при с со так то ты у что это я "
    "a an and are as at be but by for from he i in is it no not of on or she so that the they this to was we were with you".split()
)


def casefold(c: Column) -> Column:
    low = F.lower(F.replace(c, F.lit("İ"), F.lit("i")))  # which otherwise becomes an i and a dot above it
    return F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


#: Characters of a text that are folded first for its slug.
SLUG_HEAD = 400


def slug(c: Column, most: int) -> Column:
    """a-z, 0-9 and dashes; cut at the last dash that keeps it within ``most``; ``text`` if nothing is left."""

    def dashed(s: Column) -> Column:
        s = casefold(s)
        for a, b in TRANSLIT_LONG:
            s = F.replace(s, F.lit(a), F.lit(b))
        s = F.regexp_replace(F.translate(s, TRANSLIT_FROM, TRANSLIT_TO), "[^a-z0-9]+", "-")
        return F.regexp_replace(s, "^-+|-+$", "")

    def cut(x: Column) -> Column:
        head = F.substring(x, 1, most + 1)
        at_dash = F.when(F.instr(head, "-") > 0, F.regexp_replace(head, "-[^-]*$", "")).otherwise(F.substring(x, 1, most))
        return F.when(x == "", "text").when(F.length(x) > most, F.coalesce(F.nullif(F.regexp_replace(at_dash, "-+$", ""), F.lit("")), F.lit("text"))).otherwise(x)

    # the beginning of a text settles what is cut if its own slug is longer; a text of which much is left out is folded whole
    begun = F.transform(F.array(dashed(F.substring(c, 1, SLUG_HEAD))), lambda x: F.when((F.length(x) > most + 1) | (F.length(c) <= SLUG_HEAD), x).otherwise(dashed(c)))
    # bound, so that a long text is folded once
    return F.get(F.transform(begun, cut), 0)


def book_id(title: Column, author: Column, stem: Column, most: int = 60) -> Column:
    """Slug of author and title, else of the file's stem."""
    base = F.concat_ws(" ", F.nullif(author, F.lit("")), F.nullif(title, F.lit("")))
    return slug(F.coalesce(F.nullif(base, F.lit("")), stem), most)


def unicode_clean(c: Column) -> Column:
    """Invisible characters go, line ends become LF (composition is a separate step)."""
    return F.regexp_replace(F.regexp_replace(c, "[\u00ad\u200b\u200c\u200d\ufeff]", ""), "\r\n?", "\n")


def whitespace(c: Column) -> Column:
    """Runs of blanks become one, line ends lose theirs, three or more line feeds become two, outer ones go."""
    s = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "[ \\t]+\n", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "[ \\t]+$", ""), "\n{3,}", "\n\n")
    return F.regexp_replace(s, "^\n+|\n+$", "")


CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0D\\x0E-\\x1F\\x7F-\\x9F]"


def control_strip(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CONTROL)).cast("bigint")


def line_merge(c: Column) -> Column:
    """Lines become one; ``letter-`` at a line's end is glued to a lower-case letter of its alphabet, with the hyphen before a particle."""
    s = F.regexp_replace(c, "[ \\t]*\n[ \\t]*", "\n")
    s = F.regexp_replace(s, rf"(?iu)([а-яё])-\n(?=({'|'.join(PARTICLES)})(?![\p{{L}}]))", "$1-")
    s = F.regexp_replace(s, r"([А-Яа-яЁё])-\n(?=[а-яё])", "$1")
    s = F.regexp_replace(s, r"([A-Za-z])-\n(?=[a-z])", "$1")
    other = r"[\p{L}&&[^A-Za-zА-Яа-яЁё]]"
    s = F.regexp_replace(s, rf"({other})-\n(?=[\p{{Ll}}&&[^a-zа-яё]])", "$1")
    return F.trim(F.replace(s, F.lit("\n"), F.lit(" ")))


def heading_rank(c: Column) -> Column:
    """1 volume, 2 part, 3 chapter, bare number or short line of capitals; null if no heading."""
    out = F.lit(None).cast("int")
    caps = (F.length(c) <= CAPS_MOST) & c.rlike(r"\p{L}") & (F.upper(c) == c) & (F.lower(c) != c)
    out = F.when(c.rlike(f"(?i){BARE_NUMBER}") | caps, 3).otherwise(out)
    for rank, pattern in reversed(HEADING_RANKS):
        out = F.when(c.rlike(f"(?iu){pattern}{HEADING_TAIL}"), rank).otherwise(out)
    return out


def is_placeholder(title: Column) -> Column:
    return slug(title, 80).isin(*PLACEHOLDERS) | (F.length(F.trim(title)) < 2)


def repaired_title(title: Column) -> Column:
    """Null in place of a placeholder title."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when((t != "") & is_placeholder(t), F.lit(None)).otherwise(title)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \\t\\n\\r]+", " "), "^ | $", "")


def header_signature(c: Column) -> Column:
    """Runs of digits become #, white space is collapsed, case folded."""
    return casefold(collapsed(F.regexp_replace(c, "[0-9]+", "#")))


def canon_key(c: Column) -> Column:
    return casefold(collapsed(c))


def is_page_number(c: Column, most: int = 4) -> Column:
    core = F.regexp_replace(c, "^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return (core != "") & (F.length(core) <= most) & core.rlike("^([0-9]+|(?i)[ivxlcdm]+)$")


def path_title(path: Column) -> Column:
    """Titles of a path, without repeats of the one before, joined by a middle dot."""
    return F.array_join(F.filter(path, lambda x, i: (i == 0) | (F.get(path, i - 1) != x)), " · ")


def cut_300(c: Column, most: int = 300) -> Column:
    s = collapsed(c)
    head = F.substring(s, 1, most)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), F.lit("…")))


def summary(text: Column, least: int = 15) -> Column:
    """The first paragraph of ``least`` words, else the first with any, cut to 300 characters; headings, marks of lists, quotes and code don't count."""
    plain = F.filter(F.split(text, "\n\n"), lambda p: ~p.rlike(r"^(#{1,6} |> |- |\||`{3})") & p.rlike(r"[^ \t\r\n]"))
    long = F.filter(plain, lambda p: word_count(p) >= least)
    return cut_300(F.coalesce(F.get(long, 0), F.get(plain, 0), F.lit("")))


def language(c: Column) -> Column:
    """ru or en by half of the letters, else null."""
    n = F.regexp_count(c, F.lit(r"\p{L}"))
    cyrillic, latin = F.regexp_count(c, F.lit("[А-Яа-яЁё]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(n == 0, None).when(2 * cyrillic >= n, "ru").when(2 * latin >= n, "en")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def md_inline(c: Column) -> Column:
    """Images and links become their texts, automatic links their addresses."""
    s = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(s, r"<(https?://[^>\s]+)>", "$1")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_CHARS), F.lit(0))


def token_canon(c: Column) -> Column:
    """Folded, yo as ye, apostrophes and hyphens in one form; null without a letter or digit."""
    s = F.translate(casefold(c), "ё’‘′‐‑−", "е'''---")
    return F.when(s.rlike(r"[\p{L}\p{N}]"), s)


def marker_strip(c: Column) -> Column:
    """A line without its quote, bullet and number marks."""
    return F.regexp_replace(c, r"^(> |- |[0-9]+\. )+", "")


def footnote_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[0-9]+\]", "")


def significant(words: Column) -> Column:
    """Words that are no stop words; repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)))


def vowel_score(c: Column) -> Column:
    """1 less the distance of the share of vowels from 0.40; -1 without Cyrillic letters."""
    v, k = F.regexp_count(c, F.lit("[аеёиоуыэюяАЕЁИОУЫЭЮЯ]")), F.regexp_count(c, F.lit("[бвгджзйклмнпрстфхцчшщъьБВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ]"))
    return F.when(v + k == 0, -1.0).otherwise(1 - F.abs(v / (v + k) - 0.40))


def down(x: Column, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero``, linear between."""
    return F.when(x <= full, 1.0).when(x >= zero, 0.0).otherwise((zero - x) / (zero - full))


def trapezoid(c: Column, points: tuple[float, float, float, float]) -> Column:
    a, b, d, e = points
    return F.when((c >= b) & (c <= d), 1.0).when((c <= a) | (c >= e), 0.0).when(c < b, (c - a) / (b - a)).otherwise((e - c) / (e - d))


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def half_point(size: Column) -> Column:
    """Font size to half a point, halves to even."""
    return F.bround(size * 2, 0) / 2


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"[^ \t\n\r]+"), F.lit(0))), F.lit(0)).cast("bigint")
