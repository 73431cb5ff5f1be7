"""Inline tags and model replies: table functions and parsers.

What needs places of matches, or takes steps that depend on each other, runs as Python
over batches of whole documents; a document is one row, so nothing is grouped.
"""

from __future__ import annotations

import ast
import bisect
import functools
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The four inline syntaxes, `<T>x</T>`, `<*T>x<*/T>`, `<*T*>x<*/T*>`, `<<<T>>>x<<</T>>>`.
SYNTAXES = (
    re.compile(r"<([^>]+)>([^<]*)</\1>"),
    re.compile(r"<\*([^>]+)>([^<]*)<\*/\1>"),
    re.compile(r"<\*([^>*]+)\*>([^<]*)<\*/\1\*>"),
    re.compile(r"<<<([^>]+)>>>([^<]*)<<</\1>>>"),
)
#: Well-formed tags of each prompt style, and runs of `<`.
COMPLIANT = (
    re.compile(r"(?<!<)<<<([A-Z_]+)>>>.*?(?<!<)<<</\1>>>", re.DOTALL),
    re.compile(r"(?<!<)<(?!<)([A-Z_]+)>.*?(?<!<)</\1>", re.DOTALL),
    re.compile(r"(?<!<)<\*(?!\*)([A-Z_]+)>.*?(?<!<)<\*/\1>", re.DOTALL),
    re.compile(r"(?<!<)<\*(?!\*)([A-Z_]+)\*>.*?(?<!<)<\*/\1\*>", re.DOTALL),
)
_OPENINGS = re.compile(r"<+")
_TAG = re.compile(r"<[^>]*>")


def tag_candidates(text: str, legacy: bool = False) -> list[tuple[int, int, str, str]]:
    """start, end, tag, value of inline tags, in order.

    Text of the third syntax also fits the second, with a star at the end of the tag;
    legacy keeps both candidates, otherwise the third wins.
    """
    found = sorted((m.start(), m.end(), m[1], m[2]) for p in SYNTAXES for m in p.finditer(text))
    return found if legacy else [x for x in found if not x[2].endswith("*")]


def untagged(text: str) -> str:
    """The text without what stands between a `<` and the next `>`; a `<` without one stays."""
    return _TAG.sub("", text)


#: From so many different values on, one automaton finds the places of all in one walk over the text.
MANY_VALUES = 8


def all_occurrences(text: str, values: Iterable[str]) -> dict[str, list[int]]:
    """All places where each value begins, overlapping ones too; an empty value has none."""
    out: dict[str, list[int]] = {v: [] for v in values}
    wanted = [v for v in out if v]
    if len(wanted) < MANY_VALUES:
        for v in wanted:
            at = text.find(v)
            while at >= 0:
                out[v].append(at)
                at = text.find(v, at + 1)
        return out
    automaton = ahocorasick.Automaton()
    for v in wanted:
        automaton.add_word(v, (len(v), out[v]))
    automaton.make_automaton()
    for end, (length, places) in automaton.iter(text):
        places.append(end - length + 1)
    return out


def occurrences(text: str, value: str) -> list[int]:
    """All places where the value begins, overlapping ones too."""
    return all_occurrences(text, [value])[value]


def apart_from_left(places: list[int], length: int, count: int | None = None) -> list[int]:
    """Of sorted places of something of a length those that do not overlap, from the left; the first `count`."""
    out: list[int] = []
    for p in places:
        if count is not None and len(out) == count:
            break
        if not out or p >= out[-1] + length:
            out.append(p)
    return out


def first_occurrences(text: str, value: str, count: int) -> list[int]:
    """The first `count` non-overlapping places from the left."""
    out, at = [], text.find(value) if value else -1
    while at >= 0 and len(out) < count:
        out.append(at)
        at = text.find(value, at + len(value))
    return out


class _Taken:
    """Disjoint, non-empty spans, kept in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return (i == 0 or self.ends[i - 1] <= start) and (i == len(self.starts) or self.starts[i] >= end)

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def expected_places(tagged: str, starts: list[int]) -> list[int]:
    """For each place of a `<`: the length of what stands before it, without tags.

    A tag that is open at a place takes nothing from the text before it.
    """
    ends, gone = [0], [0]
    for m in _TAG.finditer(tagged):
        ends.append(m.end())
        gone.append(gone[-1] + m.end() - m.start())
    return [at - gone[bisect.bisect_right(ends, at) - 1] for at in starts]


def _outwards(places: list[int], expected: int) -> Iterator[int]:
    """Sorted places by their distance from the expected one, the smaller first of two that are equally near."""
    right = bisect.bisect_left(places, expected)
    left = right - 1
    while left >= 0 or right < len(places):
        if right == len(places) or (left >= 0 and expected - places[left] <= places[right] - expected):
            yield places[left]
            left -= 1
        else:
            yield places[right]
            right += 1


def align(original: str, tagged: str, legacy: bool = False) -> list[tuple[int, int, str, str]]:
    """Inline tags as spans of the original: start, end, tag, value.

    Each takes the free occurrence of its value nearest to where the cleaned text has it
    (of equally near ones the first) and blocks it for those that follow; without a free
    one the tag is left out.
    """
    found, taken, out = tag_candidates(tagged, legacy), _Taken(), []
    places = all_occurrences(original, {c[3] for c in found})
    for (_, _, tag, value), expected in zip(found, expected_places(tagged, [c[0] for c in found]), strict=True):
        at = next((p for p in _outwards(places[value], expected) if taken.free(p, p + len(value))), None)
        if at is not None:
            taken.add(at, at + len(value))
            out.append((at, at + len(value), tag, value))
    return out


def place_entities(original: str, entities: dict[str, list[str]]) -> list[tuple[int, int, str, str]]:
    """Listed values as spans: the first occurrences of each, as many as it is listed."""
    different = {v for values in entities.values() for v in values}
    places = all_occurrences(original, different) if len(different) >= MANY_VALUES else None
    out = []
    for tag, values in entities.items():
        for value, count in Counter(values).items():
            found = first_occurrences(original, value, count) if places is None else apart_from_left(places[value], len(value), count)
            out += [(p, p + len(value), tag, value) for p in found]
    return out


def fold_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@functools.cache
def _one_case() -> dict[int, str]:
    """For str.translate: one character for all that are equal whatever their case.

    A character goes to the small form of its capital, where both are single characters.
    """
    out = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        lower = upper.lower()[0]
        if lower != c:
            out[code] = lower
    return out


def loose_matches(text: str, value: str) -> list[tuple[int, int]]:
    """Occurrences whatever the case and the accents; places hold for composed text."""
    return all_loose_matches(text, [value])[0]


def all_loose_matches(text: str, values: list[str]) -> list[list[tuple[int, int]]]:
    """loose_matches of each value; the text is folded, and walked, once."""
    whole = fold_marks(text).translate(_one_case())
    folded = [fold_marks(v).translate(_one_case()) for v in values]
    places = all_occurrences(whole, folded)
    return [[(p, p + len(v)) for p in apart_from_left(places[v], len(v))] for v in folded]


def longest_free(spans: list[tuple]) -> list[tuple]:
    """Longest first, in their order if equally long, those that touch no accepted one; returned in text order."""
    accepted, taken = [], _Taken()
    for s in sorted(spans, key=lambda s: s[0] - s[1]):
        if s[1] <= s[0] or taken.free(s[0], s[1]):
            accepted.append(s)
            if s[0] < s[1]:
                taken.add(s[0], s[1])
    return sorted(accepted, key=lambda s: s[:2])


def inline_to_bio(text: str) -> list[tuple[str, str]]:
    """Tokens between white space with B-, I- or O from `<TAG>...</TAG>` within a line."""
    out, at = [], 0
    for m in re.finditer(r"<([A-Z]+)>(.*?)</\1>", text):
        out += [(w, "O") for w in text[at : m.start()].split()]
        out += [(w, ("I-" if i else "B-") + m[1]) for i, w in enumerate(m[2].split())]
        at = m.end()
    return out + [(w, "O") for w in text[at:].split()]


def compliance(text: str, pattern: int = 1) -> tuple[int, list[tuple[int, str]]]:
    """Well-formed tags, and the runs of `<` outside of all of them with 20 characters around (line breaks as blanks)."""
    valid = [m.span() for m in COMPLIANT[pattern - 1].finditer(text)]
    starts = [a for a, _ in valid]
    # well-formed tags are disjoint: only the last that starts before a run can hold it
    held = lambda m: (i := bisect.bisect_right(starts, m.start())) > 0 and m.end() <= valid[i - 1][1]
    wrong = [m for m in _OPENINGS.finditer(text) if not held(m)]
    return len(valid), [(m.start(), text[max(0, m.start() - 20) : m.end() + 20].replace("\n", " ")) for m in wrong]


#: The pattern that a prompt asks for, by its number; others ask for the first.
PATTERNS = {8: 2, 9: 3, 10: 4, 11: 2}


def pattern_of(prompt: Column) -> Column:
    """The compliance pattern of a prompt, by the number of its place."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in PATTERNS.items() for x in pair))[prompt.cast("int")], F.lit(1))


def pack_lines(text: str, length: Callable[[str], int], limit: int, template: str = "{texto_clinico}") -> list[tuple[str, bool]]:
    """Lines joined while the prompt around them is shorter than the limit: chunks, and whether each is over it.

    Blank lines are skipped.  A line that overflows opens the next chunk unchecked.
    Characters are added up.  Other lengths do not add up, since tokens may reach over line
    breaks: each line is measured once, the sums say where about a chunk ends, and whole
    prompts are measured around that place alone.  This takes it that a prompt with more
    lines is not shorter.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    slots = template.count("{texto_clinico}")
    chars = length is len
    whole = lambda chunk: length(template.replace("{texto_clinico}", chunk))
    around = len(template) - slots * len("{texto_clinico}") if chars else whole("")
    about = [0]
    for line in lines:
        about.append(about[-1] + (len(line) + 1 if chars else max(1, length(line + "\n"))))
    out: list[tuple[str, bool]] = []
    at = 0
    while at < len(lines):
        # the end of the longest chunk whose prompt is short enough; the first line is taken whatever its length
        if chars:
            fits = lambda end, at=at: around + slots * (about[end] - about[at] - 1) < limit
        else:
            fits = functools.cache(lambda end, at=at: whole("\n".join(lines[at:end])) < limit)
        guess = bisect.bisect_left(about, about[at] + (limit - around) / max(slots, 1)) - 1
        end = _last_that_fits(fits, at + 1, len(lines), min(max(guess, at + 1), len(lines)))
        chunk = "\n".join(lines[at:end])
        out.append((chunk, not fits(end)))
        at = end
    return out


def _last_that_fits(fits: Callable[[int], bool], low: int, high: int, guess: int) -> int:
    """The last end in [low, high] that fits, all before it being thought to fit; low if none does.  Steps from the guess double until the end is passed, then halve."""
    step = 1
    if guess == low or fits(guess):
        good, bad = guess, high + 1
        while good < high and good + step < bad:
            if not fits(good + step):
                bad = good + step
                break
            good, step = good + step, min(2 * step, max(1, high - good - step))
        bad = min(bad, high + 1)
    else:
        good, bad = low, guess
        while bad - step > low:
            if fits(bad - step):
                good = bad - step
                break
            bad, step = bad - step, 2 * step
    while bad - good > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if fits(middle) else (good, middle)
    return good


def safe_limit(context: int, margin: float = 0.1) -> int:
    return int(context * (1 - margin))


def parse_reply(reply: str) -> dict | None:
    """A reply's object: a Python literal, else JSON, of all of it or from its first `{` to its last `}`; None if neither."""
    whole = reply.strip()
    inner = whole[whole.find("{") : whole.rfind("}") + 1] if "{" in whole and "}" in whole else ""
    for text in dict.fromkeys((whole, inner)):
        for parse in (ast.literal_eval, json.loads):
            try:
                found = parse(text)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            if isinstance(found, dict):
                return found
    return None


#: JSON as its standard has it: Spark's reader also takes other quotes, comments and leading zeros unless told not to.
_STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowNumericLeadingZeros": "false", "allowComments": "false", "allowUnquotedControlChars": "false", "allowBackslashEscapingAnyCharacter": "false", "mode": "PERMISSIVE"}


def is_json(text: Column) -> Column:
    """Is the text one JSON value?  A name may be repeated within an object."""
    # the reader stops after a first value; only one whole value parses both as the sole item of an array and as the value of an object
    item = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    value = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", _STRICT)
    return F.coalesce((F.size(item) == 1) & value.isNotNull() & (F.trim(text) != ""), F.lit(False))


def json_kind_column(reply: Column) -> Column:
    """How a reply holds JSON: `delimiters` (a json fence), `no_delimiters` (a plain fence), `raw`, or `malformed`."""
    ok = is_json
    # fixed values: the fences
    fence, plain = r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```"
    has_fence = F.rlike(reply, F.lit(fence))
    return (
        F.when(has_fence & ok(F.regexp_extract(reply, fence, 1)), "delimiters")
        .when(~has_fence & F.rlike(reply, F.lit(plain)) & ok(F.regexp_extract(reply, plain, 1)), "no_delimiters")
        .when(ok(F.trim(reply)), "raw")
        .otherwise("malformed")
    )


#: Rows that a table function gives back at once: bounds what it holds beside its input.
ROWS = 1 << 14


def _made(frames: Iterator[pd.DataFrame], keys: list[str], columns: list[str], names: list[str], make: Callable[..., list[tuple]]) -> Iterator[pd.DataFrame]:
    """The keys and what make(*columns) gives for each row, in frames of ROWS rows."""
    for frame in frames:
        out: list[tuple] = []
        for k, args in zip(frame[keys].itertuples(index=False, name=None), frame[columns].itertuples(index=False, name=None), strict=True):
            out += [(*k, *row) for row in make(*(("" if a is None else a) for a in args))]
            full = len(out) - len(out) % ROWS
            for at in range(0, full, ROWS):
                yield pd.DataFrame(out[at : at + ROWS], columns=[*keys, *names])
            out = out[full:] if full else out
        if out:
            yield pd.DataFrame(out, columns=[*keys, *names])


def rows_from(df: DataFrame, columns: list[str], keys: list[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """A table function: for each row, make(*columns) gives rows of `schema`, and the keys stand before them.

    Null arguments are empty strings.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    keys = [f.name for f in df.schema.fields if f.name in keys]
    names = [x.split()[0] for x in schema.split(", ")]
    run = functools.partial(_made, keys=keys, columns=columns, names=names, make=make)
    return df.select(*keys, *(c for c in columns if c not in keys)).mapInPandas(run, f"{types}, {schema}")


def _numbered(rows: list[tuple]) -> list[tuple]:
    return [(i, *r) for i, r in enumerate(rows, 1)]


SPAN_ROWS = "ord int, start long, end long, tag string, text string"


def aligned_spans(df: DataFrame, keys: list[str], original: str = "text", tagged: str = "tagged_text", legacy: bool = False) -> DataFrame:
    """keys, ord, start, end, tag, text of inline tags in the original text."""
    return rows_from(df, [original, tagged], keys, lambda o, t: _numbered(align(o, t, legacy)), SPAN_ROWS)


def loose_spans(df: DataFrame, keys: list[str], values: dict[str, str], text: str = "text") -> DataFrame:
    """Spans of the columns `values` (column: type), whatever case and accents, longest first without overlaps."""
    kinds = list(values.items())

    def make(t: str, *found: str) -> list[tuple]:
        places = all_loose_matches(t, [v.strip() for v in found])
        spans = [(a, b, kind, t[a:b]) for (_, kind), own in zip(kinds, places, strict=True) for a, b in own]
        return _numbered(longest_free(spans))

    return rows_from(df, [text, *values], keys, make, SPAN_ROWS)


def bio_tokens(df: DataFrame, keys: list[str], tagged: str = "tagged_text") -> DataFrame:
    return rows_from(df, [tagged], keys, lambda t: [(i, w, x) for i, (w, x) in enumerate(inline_to_bio(t))], "pos int, token string, label string")


def legacy_bio(text: str, labels: tuple[str, ...] = ("PER", "LOC", "ORG", "MISC")) -> list[tuple[str, str]]:
    """Tokens and labels of `<TAG>...</TAG>` as an older reader had them, kept for comparison with its output.

    A word that is glued to an opening tag is lost, and the span runs on to the next word
    that ends with the closing tag (or to the end of the text), so a tag around a single
    word takes in the words after it.  `inline_to_bio` has neither fault.
    """
    opening = re.compile("|".join(f"<{x}>" for x in labels))
    # a tag within a word stays as a marker
    marked = functools.partial(re.sub, f"<(/?)({'|'.join(labels)})>", lambda m: f"[{m[2]}_{'END' if m[1] else 'START'}]")
    out: list[tuple[str, str]] = []
    label, first = None, False
    for word in text.split():
        if label is None:
            m = opening.match(word)
            if m:
                label, first = m[0][1:-1], True
            else:
                out.append((marked(word), "O"))
            continue
        closing = f"</{label}>"
        out.append((marked(word.replace(closing, "") if word.endswith(closing) else word), ("B-" if first else "I-") + label))
        first = False
        if word.endswith(closing):
            label = None
    return out


def tag_counts_of(text: Column, pattern: int = 1) -> tuple[Column, Column]:
    """Numbers of well-formed tags, and of runs of `<` outside of them, by built-in functions alone."""
    tags = "(?s)" + COMPLIANT[pattern - 1].pattern
    # a well-formed tag follows no `<` and ends with `>`: a blank in its place joins no runs
    return F.regexp_count(text, F.lit(tags)).cast("long"), F.regexp_count(F.regexp_replace(text, tags, " "), F.lit(_OPENINGS.pattern)).cast("long")


def without_tags(text: Column) -> Column:
    """untagged() of a column."""
    return F.regexp_replace(text, _TAG.pattern, "")


def compliance_counts(df: DataFrame, keys: list[str], text: str = "text", pattern: int = 1) -> DataFrame:
    """keys, correct, wrong, contexts a document."""
    return rows_from(df, [text], keys, lambda t: [(n, len(w), [c for _, c in w]) for n, w in [compliance(t, pattern)]], "correct long, wrong long, contexts array<string>")


def chunked(df: DataFrame, keys: list[str], limit: int, length: Callable[[str], int] = len, template: str = "{texto_clinico}", text: str = "text") -> DataFrame:
    return rows_from(df, [text], keys, lambda t: [(i, c, over) for i, (c, over) in enumerate(pack_lines(t, length, limit, template))], "part int, chunk string, oversize boolean")
