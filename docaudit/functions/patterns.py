"""Patterns written for ECMAScript semantics, as Java expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space beyond what Java's \s has.
MORE_SPACE = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: White space, and what is none. Printable ASCII, nearly all signs, is told by its range alone, as Java asks the members of a class one by one.
SPACE, NON_SPACE = rf"[[^!-~]&&[\s[{MORE_SPACE}]]]", rf"[!-~[^\s{MORE_SPACE}]]"
_SPACE_IN_CLASS = rf"\s[[^\x00-\x7F]&&[{MORE_SPACE}]]"
NON_SPACES = NON_SPACE + "++"
#: A boundary of ASCII words; Java's own also counts letters beyond ASCII.
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
#: What is a word's sign for certain: before or after it, half of a boundary is enough, which goes several times faster.
_WORD_SIGN = r"(?:(?<!\\)\w|\\[dw]|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|\d-\d|\w)+\])"
_BEFORE_WORD, _AFTER_WORD = re.compile(_WORD_SIGN + r"(?![?*]|\{0)", re.ASCII), re.compile(_WORD_SIGN + r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?\Z", re.ASCII)


def _group(pattern: str) -> tuple[list[str], str] | None:
    """The choices of the plain group that pattern starts with, and what follows it."""
    body = re.match(r"\((?:\?:|(?!\?))", pattern)
    if not body:
        return None
    out, depth, start = [], 1, body.end()
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()|]", pattern[start:], re.DOTALL):
        at = body.end() + m.start()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0 or (depth == 1 and m[0] == "|"):
            out.append(pattern[start:at])
            start = at + 1
        if depth == 0:
            return out, pattern[at + 1 :]
    return None


def _before_word(rest: str) -> bool:
    """Whether what rest matches starts with a word's sign."""
    group = _group(rest)
    if group:
        return not re.match(r"[?*]|\{0", group[1]) and all(map(_before_word, group[0]))
    return bool(_BEFORE_WORD.match(rest))


def _after_word(before: str) -> bool:
    """Whether what before matches ends with a word's sign: by itself, or in each choice of a last group."""
    if not before.endswith(")"):
        return bool(_AFTER_WORD.search(before))
    for at in reversed([m.start() for m in re.finditer(r"\\.|\(", before) if m[0] == "("]):
        group = _group(before[at:])
        if group and group[1] == "":
            return all(_AFTER_WORD.search(x) for x in group[0])
    return False


def java(pattern: str, ignore_case: bool = False) -> str:
    """pattern with ASCII word boundaries, full white space, and $ that means the end of the text."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(r"(?<!\w)" if _before_word(pattern[i + 2 :]) else r"(?!\w)" if _after_word(pattern[:i]) else BOUNDARY)
        elif two == r"\s":
            out.append(_SPACE_IN_CLASS if in_class else SPACE)
        elif two == r"\S" and not in_class:
            out.append(NON_SPACE)
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "$" and not in_class:
            out.append(r"\z")
            i -= 1
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def _pieces(branch: str) -> list[str]:
    """Runs of signs that surely occur, of a branch whose escapes and classes are blanked."""
    return re.split("\0", re.sub(r".(?:[*?]|\{[^}]*\})|[.^$+]", "\0", branch))


def _plain(word: str) -> bool:
    return all(c.isascii() or c.upper() == c == c.lower() for c in word)


def needs_of(pattern: str) -> list[list[list[str]]]:
    """What a text with the pattern holds in any case: of one branch each of its parts, of a part one of its upper-case words; empty where a branch has no sure part.

    The part with the longest words comes first. Escapes, classes, groups and what may be missing count nothing, but for
    groups that are a choice of words. Single signs count only beside words, and if they are no letters.
    """
    if re.search(r"\\[^bsSdDwWAz\W]", pattern):
        return []
    choices, out = [], []
    left = re.sub(r"(?<!\\)([^\\\])}])\{([1-9])(?:,\d*)?\}", lambda m: m[1] * int(m[2]) + "()", pattern)
    left = re.sub(r"\\.|\[\^?(?:\\.|[^\]\\])+\]", "\0", left)

    def group(m: re.Match) -> str:
        body = m[1].removeprefix("?:")
        words = [max(re.split("[\uE000-\uF8FF]", "\uE000".join(_pieces(w))), key=len) for w in body.split("|")]
        if m[2] not in ("", "+") or body.startswith("?") or not all(re.fullmatch("[A-Za-z]{2,}", w) for w in words):
            return "\0"
        choices.append(words)
        return chr(0xE000 + len(choices) - 1)

    while "(" in left:
        left, n = re.subn(r"\(([^()]*)\)([*?+]?|\{[^}]*\})", group, left)
        if not n:
            return []
    for branch in left.split("|"):
        parts = [choices[ord(x) - 0xE000] if "\uE000" <= x <= "\uF8FF" else [x] for y in _pieces(branch) for x in re.split("([\uE000-\uF8FF])", y) if x]
        parts = sorted((ws for ws in parts if all(map(_plain, ws))), key=lambda ws: -min(map(len, ws)))
        if not parts or min(map(len, parts[0])) < 2:
            return []
        parts = [list(dict.fromkeys(w.upper() for w in ws)) for ws in parts if all(len(w) > 1 or not w.isalpha() for w in ws)]
        out.append([ws for k, ws in enumerate(parts) if ws not in parts[:k]])
    return out


def words_of(pattern: str) -> list[str] | None:
    """Upper-case words of which a text holds one at least, in any case, if it has the pattern; null where none of two signs or more is sure."""
    return list(dict.fromkeys(w for parts in needs_of(pattern) for w in parts[0])) or None


def has(text: Column, pattern: str, ignore_case: bool = True, upper: Column | None = None) -> Column:
    """Whether text has the pattern, false for null. Texts without its words, which are most, are not matched: a plain search goes many times faster.

    upper: a column of the text in upper case, where many patterns share it.
    """
    found, needs = text.rlike(java(pattern, ignore_case)), needs_of(pattern)
    if needs:
        upper = F.upper(text) if upper is None else upper
        any_of = lambda xs: reduce(Column.__or__, xs)
        found = F.when(any_of([reduce(Column.__and__, [any_of([F.contains(upper, F.lit(w)) for w in words]) for words in parts]) for parts in needs]), found)
    return F.coalesce(found, F.lit(False))


def find_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group)), F.array().cast("array<string>"))


def find(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match, null where there is none or where it is empty."""
    return F.nullif(F.regexp_extract(text, java(pattern, ignore_case), group), F.lit(""))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def trim(text: Column) -> Column:
    # A sign is asked first whether it is a space, and only then whether a run starts there: most are none.
    return F.regexp_replace(text, rf"\A{SPACE}++|{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+\z", "")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(replace(text, r"\s+", " "))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df: DataFrame, items: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys of df, pos and item: a row for each item of an array column whose items are never null.

    A plain explode() gets a filter on the array's size, which is put before the projection that makes the array, and so
    makes it, and the texts below it, once more; an outer one does not, and leaves a null item for an empty array.
    """
    return df.select(*keys, F.posexplode_outer(items).alias("pos", "item")).filter(F.col("item").isNotNull())


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(x + 0.5).cast("int")


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), trim), lambda x: x != "")


def first_seen(rows: Column, key) -> Column:
    """The rows of an array whose key no earlier row has, in their order; sorted twice, so long arrays are no trouble."""
    keyed = F.sort_array(F.transform(rows, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = let(keyed, lambda s: F.filter(s, lambda y, i: F.coalesce(F.get(s, i - 1)["k"] != y["k"], F.lit(True))))
    return F.transform(F.sort_array(F.transform(firsts, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def unique_ci(values: Column) -> Column:
    """Trimmed values in first-seen order, equal ones in any case once, with the first spelling; blank and null ones left out."""
    return first_seen(F.filter(F.transform(values, lambda x: trim(x)), lambda x: x.isNotNull() & (x != "")), F.upper)


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def compact(*items: Column) -> Column:
    """The items that are not null."""
    return F.array_compact(F.array(*items))


def reason(code: str, message: Column | str, stage: str, when: Column, impact: Column | int | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    impact = F.lit(impact).cast("int") if not isinstance(impact, Column) else impact.cast("int")
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(stage).alias("stage"), impact.alias("impact")))


REASONS = "array<struct<code:string,message:string,stage:string,impact:int>>"
