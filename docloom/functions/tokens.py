"""Tokens, concept classes and query rewriting as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
MOST_BYTES = 80
#: A query that contains the first gets the second added.
EXPANSIONS = (
    ("рпм", "rpm"), ("rpm", "рпм"), ("эмулятор", "emulator"), ("emulator", "эмулятор"), ("скриншот", "screenshot"), ("screenshot", "скриншот"),
    ("видео", "video"), ("video", "видео"), ("подпис", "sign signing signature"), ("sign", "подписание подпись"), ("установ", "install deploy"),
    ("install", "установка установить"), ("запуск", "run launch"), ("запустить", "run launch"), ("launch", "запуск"), ("собрат", "build"),
    ("build", "сборка собрать"), ("терминал", "cli shell"), ("командн", "cli shell"), ("mb2", "mb2 build"),
)
#: Concept, what a token of it contains, begins with, equals. The first that fits counts.
CONCEPTS = (
    ("emulator", ("эмулят",), (), ("emulator", "emulation")),
    ("rpm", (), ("пакет", "package"), ("рпм", "rpm")),
    ("sign", (), ("подпис", "sign", "signature", "rpmsign"), ()),
    ("install", (), ("устан", "install", "deploy", "развер"), ()),
    ("build", (), ("собр", "build"), ("mb2",)),
    ("launch", (), ("запус", "launch", "терминал"), ("run", "start", "cli", "terminal")),
    ("screenshot", (), ("скрин", "screenshot", "screengrab"), ()),
    ("record", (), ("запис",), ("record", "capture")),
    ("video", (), ("видео",), ("video",)),
)
#: Fixed values.
STOP_WORDS = ("как", "и", "в", "на", "из", "по", "для", "с", "или", "the", "a", "an", "to", "of")
HOWTO = ("как", "how", "установ", "install", "запуск", "запустить", "run", "launch", "собрат", "build", "подпис", "sign", "эмулятор", "emulator", "скриншот", "screenshot", "видео", "video")
QUERY_CHARS = ':()[]{}"\\^~*?!+-'
ACTIONS, CAPTURES = ("sign", "install", "build", "launch"), ("record", "screenshot")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits shorter than MOST_BYTES bytes.

    Only texts with a run of so many characters that it might have MOST_BYTES bytes are filtered token by token.
    """
    may = text.rlike(rf"[\p{{IsAlphabetic}}\p{{N}}]{{{MOST_BYTES // 4}}}")

    def short(parts: Column) -> Column:
        return F.when(may, F.filter(parts, lambda t: F.octet_length(t) < MOST_BYTES)).otherwise(parts)

    return once(F.array_remove(F.split(F.lower(text), SPLIT), ""), short)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: A token that no concept takes doesn't match this.
ANY_CONCEPT = "|".join([x for _, inside, _, _ in CONCEPTS for x in inside] + [f"^{x}" for _, _, begins, _ in CONCEPTS for x in begins] + [f"^{x}$" for _, _, _, equal in CONCEPTS for x in equal])


def concept(token: Column) -> Column:
    """A lower-case token's concept, else itself; null for stop words and tokens of less than three characters."""
    out = None
    for name, inside, begins, equal in CONCEPTS:
        fits = F.lit(False)
        for x in inside:
            fits = fits | F.contains(token, F.lit(x))
        for x in begins:
            fits = fits | F.startswith(token, F.lit(x))
        for x in equal:
            fits = fits | (token == x)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    plain = F.when(token.isin(*STOP_WORDS) | (F.char_length(token) < 3), None).otherwise(token)
    return F.when(token.rlike(ANY_CONCEPT), out.otherwise(plain)).otherwise(plain)


def canonical(text: Column) -> Column:
    """Distinct concepts of a text, in order."""
    parts = F.array_distinct(F.array_remove(F.split(F.lower(text), SPLIT), ""))
    return F.array_distinct(F.array_compact(F.transform(parts, concept)))


def expand(query: Column) -> Column:
    """The query with its expansions, each once."""
    low = F.lower(F.trim(query))
    added = F.array(*[F.when(F.contains(low, F.lit(a)), b) for a, b in EXPANSIONS])
    return F.concat_ws(" ", F.array_distinct(F.concat(F.array(F.trim(query)), F.array_compact(added))))


def is_howto(query: Column) -> Column:
    return F.lower(query).rlike("|".join(HOWTO))


def required_action(concepts: Column) -> Column:
    """The first action of a query's concepts, else its first way of capturing, else null."""
    found = [F.element_at(F.array_intersect(F.array(*[F.lit(x) for x in kind]), concepts), 1) for kind in (ACTIONS, CAPTURES)]
    sized = [F.when(F.size(F.array_intersect(F.array(*[F.lit(x) for x in kind]), concepts)) > 0, f) for kind, f in zip((ACTIONS, CAPTURES), found, strict=True)]
    return F.coalesce(*sized)


def coverage(query: Column, other: Column) -> Column:
    """The share of a query's concepts that the other has; 0 for no concept."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)) / F.size(query)).otherwise(0.0)


def sanitize_query(query: Column) -> Column:
    return F.translate(query, QUERY_CHARS, " " * len(QUERY_CHARS))


def shorten(text: Column, most: int) -> Column:
    if most <= 3:
        return text
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def shorten_front(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.lit("..."), F.right(text, F.lit(most - 3)))).otherwise(text)


def haystack(title: Column, source: Column, content: Column) -> Column:
    return F.concat_ws(" ", title, source, content)
