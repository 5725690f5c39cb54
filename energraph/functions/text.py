"""Text expressions shared by the operators, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Letters and digits only, in order and in lower case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


#: Fixed value: characters that count as whitespace.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def collapse(c: Column) -> Column:
    """Each run of whitespace one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


#: What ends a line, and digits that are no decimals, which number lists too.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
DIGIT = r"[\p{Nd}" + "".join(chr(i) for i in range(0x20000) if chr(i).isdigit() and not chr(i).isdecimal()) + "]"


def strip(c: Column) -> Column:
    """Without whitespace of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


#: What full case folding still changes in lower-case characters.
_FOLDS = {c: c.casefold() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.lower() == c != c.casefold()}
_SHORT = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_LONG = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full case folding: one character may become several, as in ß to ss."""
    low = F.translate(F.lower(c), "".join(_SHORT), "".join(_SHORT.values()))
    table = F.create_map(*[F.lit(x) for pair in _LONG.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(low.rlike("[" + "".join(_LONG) + "]"), spelled).otherwise(low)


def normal_entity(c: Column) -> Column:
    return casefold(collapse(c))


def normal_entities(names: Column) -> Column:
    """Normalised names, first occurrence kept, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), normal_entity), lambda x: x.isNotNull() & (x != "")))


def parse_listing(reply: Column) -> Column:
    """Lines without their bullet, or else their number; blank ones dropped."""
    lines = F.transform(F.split(reply, BREAK), strip)

    def item(line: Column) -> Column:
        return strip(F.when(line.rlike("^[-*+] "), F.substr(line, F.lit(3))).otherwise(F.regexp_replace(line, rf"^{DIGIT}+\. ", "")))

    return F.filter(F.transform(lines, item), lambda x: x != "")


#: A mark at the head of a line, and how a line begins that only announces the list.
MARK = rf"^{SPACE}*(?:[-*•]|\p{{Nd}}+[.)]){SPACE}*"
CHATTER = ("query", "queries", "here")
#: Fixed value: where a sentence ends within a line.
BOUNDARY = rf"(?<=[.!?]){SPACE}"


def parse_subqueries(reply: Column, question: Column, max_colors: int = 4) -> Column:
    """Sub-questions without list marks; chatter lines dropped, capped, the question if none is left."""
    bare = F.transform(F.split(reply, BREAK), lambda x: strip(F.regexp_replace(x, MARK, "")))
    wanted = F.filter(bare, lambda x: (x != "") & ~F.lower(x).rlike("^(?:" + "|".join(CHATTER) + ")"))
    return F.when(F.size(wanted) > 0, F.slice(wanted, 1, max_colors)).otherwise(F.array(question))


def parse_answer(reply: Column, max_words: int = 10) -> Column:
    """The first line, at most ``max_words`` words of it; empty when it says none."""
    first = strip(F.get(F.split(strip(F.coalesce(reply, F.lit(""))), BREAK), F.lit(0)))
    words = F.filter(F.split(first, SPACE + "+"), lambda w: w != "")
    return F.when(F.upper(first).startswith("NONE"), "").otherwise(F.array_join(F.slice(words, 1, max_words), " "))


def first_sentence(reply: Column) -> Column:
    """The first line that is not blank, up to its first end mark."""
    line = F.get(F.filter(F.transform(F.split(reply, BREAK), strip), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.get(F.split(line, BOUNDARY, 2), F.lit(0)), F.lit(""))


def snippet(text: Column, n: int) -> Column:
    """Whitespace flattened; cut with an ellipsis when longer than n."""
    flat = collapse(text)
    return F.when(F.char_length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def passage_of(c: Column) -> Column:
    """The passage that a proposition id belongs to."""
    return F.substring_index(c, "#", 1)
