"""Quality rules, native: each line is judged first, failing lines go, then documents that lost too much go.

Only DataFrame functions, row by row: no shuffle, no Python. Words are maximal runs of characters
other than space and TAB..CR.

Cases: a null or empty text has no words, so it fails the base rule and isn't kept; a null doc_id
is passed through; repeated rows are judged alike, one output row each; extra columns stay out of
``measured`` and are carried by ``cleaned``; an empty table gives an empty result. Texts of any
length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture in English, French, German and Spanish, as whole words.
BOILERPLATE = (
    "javascript", "cookies", "cookie policy", "lorem ipsum", "terms of (?:use|service)", "privacy policy", "all rights reserved", "click here", "subscribe now", "read more", "share this", "skip to content", "powered by",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "lire la suite", "cliquez ici", "se connecter", "s'inscrire", "s'abonner", "partager cet article",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "mehr lesen", "weiterlesen", "hier klicken", "jetzt anmelden", "newsletter abonnieren",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "leer más", "haga clic aquí", "iniciar sesión", "suscríbete",
)
#: The phrases, and calls to log in or sign up where nothing but a few words can follow.
PHRASES = r"(?:^|[^\p{L}\p{N}])(?:(?:" + "|".join(BOILERPLATE) + r")(?:[^\p{L}\p{N}]|\z)|(?:log|sign) (?:in|up)(?: (?:to|with|or|now|here))?(?:[^\p{L}\p{N}\x20]|\x20*\z))"
#: A line fails with a phrase for every so many of its words.
PHRASE_WORDS = 25
#: A line fails at this many links of a menu trail such as ``a | b | c``, or where this share of its words are separators.
MENU_LINKS, MENU_SHARE = 3, 0.2
#: A line fails if this share of its words carries a symbol, or is shouted with two exclamation marks.
SYMBOL_SHARE, SHOUT_SHARE = 0.3, 0.3
#: A line fails as a teaser if it ends in dots, and as a fragment if it has fewer words than this and no closing punctuation.
TEASER, CLOSED, FRAGMENT_WORDS = r"(?:\.{3}|…)[\x20\x09-\x0D]*\z", r"""[.!?:;,…»"”’'\x29\x5D}。！？、]+[\x20\x09-\x0D]*\z""", 3
#: Documents whose failed lines hold more than this share of their word characters are rejected.
LOST_SHARE = 0.3


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``let name = value in body``, with value computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_of(text: str) -> str:
    """SQL for the array of words of a text column; null has none."""
    trimmed = f"trim(BOTH '{SPACE_CHARS}' FROM coalesce({text}, ''))".replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\x0b", "\\u000B").replace("\x0c", "\\u000C")
    return f"CASE WHEN {trimmed} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+') END"


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """The verdict on one line that has a word: navigation, boilerplate, symbol and punctuation rules."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    menu = F.regexp_count(line, F.lit(r"(?:^|\s)[|»›•·>/]+(?=\s|$)"))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>{}~^=\\]{2,}"))
    shouts = F.regexp_count(line, F.lit(r"!{2,}"))
    phrases = F.regexp_count(F.lower(line), F.lit(PHRASES))
    return (
        (menu >= MENU_LINKS)
        | (menu > MENU_SHARE * n_words)
        | (symbols > SYMBOL_SHARE * n_words)
        | (shouts > SHOUT_SHARE * n_words)
        | (phrases * PHRASE_WORDS >= F.greatest(n_words, F.lit(1))) & (phrases > 0)
        | ~line.rlike(r"[\p{L}\p{N}]")
        | line.rlike(TEASER)
        | (n_words < FRAGMENT_WORDS) & ~line.rlike(CLOSED)
    )


#: Number of words in 3-word windows found twice or more: windows are sorted as (hash, place) packed
#: into one long, with as few bits for the place as the text needs; neighbours of equal hash count
#: only if their words are equal too. (A repeat is missed if the hash of a different window, of over 40 bits
#: up to four million words, is the same and its place is between the two.)
def _repeat_words() -> str:
    at = "CAST({0} & (shiftleft(1L, p) - 1) AS INT)"

    def equal(a: str, b: str) -> str:
        i, j = at.format(a), at.format(b)
        return f"(shiftrightunsigned({a}, p) = shiftrightunsigned({b}, p) AND w[{i}] = w[{j}] AND w[{i} + 1] = w[{j} + 1] AND w[{i} + 2] = w[{j} + 2])"

    twice = f"filter(s, (x, k) -> (k > 0 AND {equal('x', 's[k - 1]')}) OR (k < size(s) - 1 AND {equal('x', 's[k + 1]')}))"
    places = f"array_sort(transform({twice}, x -> {at.format('x')}))"
    covered = f"aggregate({places}, struct(-3 AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n), a -> a.n)"
    return _bind("windows", "s", _bind("place_bits", "p", _bind("words", "w", covered)))


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the base measures, base_failed, the cleaned text and the verdict ``kept``; ``carry``: columns to take along."""
    d = docs.select("doc_id", "text", *carry).withColumn("words", F.expr(words_of("text"))).withColumn("lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word))
    d = d.withColumn("place_bits", F.length(F.bin(F.size("words")))).withColumn("good", F.filter("lines", lambda x: ~line_fails(x)))
    d = d.withColumn(
        "windows",
        F.expr(
            "CASE WHEN size(words) < 4 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sort_array("
            + _bind("place_bits", "p", _bind("words", "w", "transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), p) | CAST(i AS BIGINT))"))
            + ") END"
        ),
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    chars = lambda c: F.length(F.regexp_replace(F.array_join(c, ""), SPACE, ""))
    d = d.select(
        "doc_id",
        "text",
        *carry,
        n(F.size("words")).alias("n_words"),
        n(F.length(F.array_join("words", ""))).alias("word_chars"),
        n(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        n(F.expr(_repeat_words())).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("good").cast("bigint").alias("n_good_lines"),
        n(chars("good")).alias("good_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("good_chars") >= (1 - LOST_SHARE) * F.col("word_chars")))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failed lines; all columns of ``docs``, in order.

    A document without failed lines keeps its text as it was; n_chars, if there, follows the text.
    """
    text = F.when(F.col("n_good_lines") == F.col("n_lines"), F.col("text")).otherwise(F.col("clean_text"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    # a filter on a projection that isn't deterministic stays above it: pushed below, it would repeat all the measures
    once = measured(row, ("row",)).withColumn("once", F.monotonically_increasing_id())
    kept = once.filter("kept AND once >= 0").withColumn("text", text)
    out = [F.col("text") if c == "text" else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*out)
