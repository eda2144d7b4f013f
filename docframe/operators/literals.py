"""Many strings looked for at once: automata with failure links, built in the workers from blocks of bounded size."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 22  # of the strings that are broadcast together


def blocks(table: DataFrame, text: str, limit: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """table in parts, whose text has about limit characters each, one after the other on the driver; rows are dealt by hash.

    A string of more characters than limit is in a part with others; the size of
    a part is bounded by limit and the longest string.
    """
    total = table.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)), F.coalesce(F.max(F.length(text)), F.lit(0)), F.count("*")).first()
    n = max(1, -(-max(total[0], 64 * total[2]) // limit)) if total[2] else 0
    for i in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64(text), F.lit(n)) == i)
        yield part.toArrow()


class Finder:
    """Where any of some strings begins in a text. Values that share a string come together."""

    def __init__(self, strings: Iterable[str]):
        self.places: dict[str, list[int]] = {}
        for i, s in enumerate(strings):
            if s:
                self.places.setdefault(s, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for s, at in self.places.items():
            self.automaton.add_word(s, (len(s), at))
        if self.places:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(start, the numbers of the strings there), by their ends."""
        if self.places:
            for end, (length, at) in self.automaton.iter(text):
                yield end + 1 - length, at


_made: dict[str, object] = {}


class OnceAWorker:
    """What make gives, made on first use in each Python worker and kept for later tasks; a few are kept at a time.

    A class of the module, not a function within another: such a function goes
    to the workers with its own copy of the module's variables.
    """

    def __init__(self, make: Callable[[], object]):
        self.make, self.name = make, uuid.uuid4().hex

    def __call__(self) -> object:
        if self.name not in _made:
            while len(_made) >= 4:
                _made.pop(next(iter(_made)))
            _made[self.name] = self.make()
        return _made[self.name]


# --- what a pattern can't match without


@lru_cache(1)
def _every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(4096)
def same_letters(c: str) -> frozenset[str]:
    """The characters that a pattern takes for c where case is ignored."""
    return frozenset(re.findall(re.escape(c), _every_character(), re.I)) | {c}


class Fold:
    """One character for all that patterns take for the same, for the characters of some strings."""

    def __init__(self, characters: Iterable[str]):
        self.table: dict[int, str] = {}
        for c in sorted(set(characters)):
            if ord(c) not in self.table:
                for x in same_letters(c):
                    self.table.setdefault(ord(x), c)

    def __call__(self, text: str) -> str:
        return text.translate(self.table)


def required_literals(pattern: str, flags: int = 0) -> frozenset[str] | None:
    """Strings of which every match has one at least; None where none are known.

    Read off Python's own parse of the pattern: of parts that follow one another
    the one with the longest strings counts, of alternatives all do, and what
    may be absent doesn't.
    """
    try:
        from re import _constants as C
        from re import _parser
    except ImportError:
        return None
    found = _required(_parser.parse(pattern, flags), C)
    return found or None


def beginnings(pattern: str, flags: int = 0) -> frozenset[str] | None:
    """Strings of which every match begins with one; None where none are known.

    They go on as long as what follows is known; their tree has at most twice
    the pattern's characters and 64.
    """
    try:
        from re import _constants as C
        from re import _parser
    except ImportError:
        return None
    found = _beginnings(_parser.parse(pattern, flags), C, 2 * len(pattern) + MOST)
    return None if "" in found else frozenset(s for s in found if not any(s[:n] in found for n in range(len(s))))


MOST = 64  # alternatives of a pattern
MOST_BEGINNINGS = 32


def _worth(strings: frozenset[str]) -> tuple[int, int]:
    return min(map(len, strings)), -len(strings)


def _required(parsed, C) -> frozenset[str] | None:  # noqa: N803
    best: frozenset[str] | None = None
    run: list[str] = []

    def offer(strings: frozenset[str] | None) -> None:
        nonlocal best
        if strings and len(strings) <= MOST and min(map(len, strings)) and (best is None or _worth(strings) > _worth(best)):
            best = strings

    def end_run() -> None:
        if run:
            offer(frozenset(["".join(run)]))
            run.clear()

    for op, value in parsed:
        if op is C.LITERAL:
            run.append(chr(value))
        elif op is C.SUBPATTERN:
            inner = value[3]
            if all(o is C.LITERAL for o, _ in inner):
                run += [chr(v) for _, v in inner]
            else:
                end_run()
                offer(_required(inner, C))
        elif op is C.AT:
            continue
        else:
            end_run()
            if op is C.BRANCH:
                each = [_required(branch, C) for branch in value[1]]
                offer(frozenset().union(*each) if all(each) else None)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                offer(_required(value[2], C))
            elif op is C.ATOMIC_GROUP:
                offer(_required(value, C))
    end_run()
    return best


def _beginnings(parsed, C, limit: int) -> dict[str, bool]:  # noqa: N803
    """Strings with which matches begin, and whether what follows in the pattern follows them at once."""
    found = {"": True}
    for op, value in parsed:
        if not any(found.values()):
            break
        each = _first(op, value, C, limit)
        for follow in (each, {s[:1]: False for s in each}, {"": False}):
            longer: dict[str, bool] = {}
            for s, goes_on in found.items():
                for more, still in follow.items() if goes_on else [("", False)]:
                    longer[s + more] = longer.get(s + more, True) and goes_on and still
            if len(longer) <= MOST_BEGINNINGS and len({s[:n] for s in longer for n in range(1, len(s) + 1)}) <= limit:
                break
        found = longer
    return found


def _first(op, value, C, limit: int) -> dict[str, bool]:  # noqa: N803
    """As _beginnings, of one part; what takes no characters is the empty string, and what isn't known is one that doesn't go on."""
    if op is C.LITERAL:
        return {chr(value): True}
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {"": True}
    if op is C.IN and all(o is C.LITERAL or (o is C.RANGE and x[1] - x[0] < MOST) for o, x in value):
        return {chr(c): True for o, x in value for c in ([x] if o is C.LITERAL else range(x[0], x[1] + 1))}
    if op is C.SUBPATTERN:
        return _beginnings(value[3], C, limit)
    if op is C.ATOMIC_GROUP:
        return _beginnings(value, C, limit)
    if op is C.BRANCH:
        each = [_beginnings(branch, C, limit) for branch in value[1]]
        return {s: all(found.get(s, True) for found in each) for s in {s for found in each for s in found}}
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _beginnings(inner, C, limit)
        found = dict(once) if least < 2 else {}
        if most != 1:
            for s, goes_on in once.items():  # or once more, and so on
                for more in once if goes_on and len(once) <= MOST_BEGINNINGS else [""]:
                    found[s + more] = False
        return found if least else {**found, "": found.get("", True)}
    return {"": False}
