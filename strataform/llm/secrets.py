r"""Operator 3, secret scans: patterns, and a guess-cost dynamic programme on values in a credential's context.

The base kinds are patterns over the whole text. Where a text names a credential ("passphrase is ...", "pwd: ..."), the
value that follows is judged by what it costs to guess: the cheapest segmentation into dictionary words, dates, repeats,
keyboard walks and brute-force spans, each with a cost in powers of ten, found by dynamic programming over the value's
ends. A value of ``LEAST_COST`` or more is a span of the kind ``guess``, whether a base span covers it or not.

The dictionary is the corpus's own: the ``DICTIONARY`` most frequent words (runs of ASCII letters) of all texts, values in
a credential's context left out, ranked by their counts, after the few words of ``COMMON``. It is counted in Spark; so
many short words at most come to the driver and are sent to the tasks.

Every text is read whole in its own row, in Arrow batches; memory is bounded by one batch. A segment is of ``LONGEST``
characters at most, but for repeats, which may be as long as they are. So what a value costs is known to be enough once
the last ``LONGEST`` ends, and the starts of the repeats that are still going on, all cost ``LEAST_COST``; the programme
stops there, however long the value is.

Defined results: a null or empty text has no spans; a null doc_id is kept; repeated rows give repeated results; spans of
one start are ordered as the kinds are listed; of words with equal counts the first in alphabetical order ranks first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, ship, table, thrifty, values

KINDS = ("assign", "access", "hex", "guess")
#: "Letters there in either case" are ASCII letters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
#: Runs are maximal, so a minimum length in the pattern finds what dropping short runs afterwards would.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|passcode|secret|token|api[_-]?key|credentials?)["']?(?:\x20+(?:is|was)\x20+|\x20*(?:[:=]|=>|->)\x20*)["'`]?([^\s"'`,;]{6,})""", re.IGNORECASE | re.ASCII)
LEAST_COST = 10.0
LONGEST = 32
DICTIONARY = 20_000
#: Words of so many letters are counted.
WORD_LEAST, WORD_MOST = 3, 20
#: Words of passwords, the most common first. They rank before the corpus's own.
COMMON = "password qwerty letmein welcome admin login master dragon monkey football baseball sunshine princess shadow secret".split()
#: Rows of a keyboard; each stands a little to the right of the one above.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
LEET = str.maketrans("01345@$!", "oieasasi")


def keyboard() -> set[tuple[str, str]]:
    """Keys beside each other, in a row or between two rows (each key touches two of the row below)."""
    near = {(x, y) for row in ROWS for x, y in zip(row, row[1:], strict=False)}
    near |= {(upper[k], lower[j]) for upper, lower in zip(ROWS, ROWS[1:], strict=False) for k in range(len(upper)) for j in (k - 1, k) if 0 <= j < len(lower)}
    return near | {(y, x) for x, y in near}


NEXT_TO = keyboard()


def ranks(words: list[str]) -> dict[str, int]:
    """Places from 1 on, of ``COMMON`` and then of ``words``."""
    return {w: k for k, w in enumerate(dict.fromkeys([*COMMON, *words]), 1)}


def char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def case_cost(part: str) -> float:
    if part == part.lower():
        return 0.0
    return math.log10(2) if part[1:] == part[1:].lower() or part == part.upper() else math.log10(2) * sum(map(str.isupper, part))


class Guesses:
    """The guess costs of values, under a dictionary of words and their places."""

    def __init__(self, rank: dict[str, int]) -> None:
        self.rank = rank

    def word(self, part: str) -> float:
        low = part.lower()
        if low in self.rank:
            return math.log10(self.rank[low] + 1) + case_cost(part)
        plain = low.translate(LEET)
        return math.log10(self.rank[plain] + 1) + case_cost(part) + math.log10(4) if plain in self.rank else math.inf

    @staticmethod
    def date(part: str) -> float:
        if not DATE.fullmatch(part):
            return math.inf
        return math.log10(120 if len(part) == 4 else 365 * 120) + (0 if part.isdigit() else math.log10(4))

    @staticmethod
    def walk(part: str) -> float:
        """Neighbouring keys, three or more; each turn costs."""
        keys = part.lower().translate(SHIFTED)
        if len(keys) < 3 or any(pair not in NEXT_TO for pair in zip(keys, keys[1:], strict=False)):
            return math.inf
        turns = sum(keys[k] != keys[k - 2] and not _straight(keys[k - 2 : k + 1]) for k in range(2, len(keys)))
        return math.log10(40) + math.log10(4) * turns + math.log10(len(keys)) + case_cost(part)

    @staticmethod
    def repeat(part: str) -> float:
        """A unit of up to four characters, over and over: three times or more, a longer unit twice or more."""
        for unit in (1, 2, 3, 4):
            if len(part) % unit == 0 and len(part) // unit >= (3 if unit == 1 else 2) and part == part[:unit] * (len(part) // unit):
                return sum(map(char_cost, part[:unit])) + math.log10(len(part) // unit)
        return math.inf

    def part(self, part: str) -> float:
        """The least cost of ``part`` as one segment that isn't brute force."""
        return min(self.word(part), self.date(part), self.repeat(part), self.walk(part))

    def cost(self, value: str, enough: float = math.inf) -> float:
        """The least log10 of guesses over all segmentations of ``value``, or something from ``enough`` on if it is that much."""
        best, joint = [0.0], math.log10(2)
        runs = [0, 0, 0, 0, 0]  # runs[u]: from where on each character equals the one u before
        for end in range(1, len(value) + 1):
            least = best[-1] + char_cost(value[end - 1])
            for start in range(max(0, end - LONGEST), end - 2):
                if best[start] < least:
                    least = min(least, best[start] + self.part(value[start:end]) + joint * (start > 0))
            going = []
            for unit in (1, 2, 3, 4):
                if end - 1 - runs[unit] >= unit and value[end - 1] != value[end - 1 - unit]:
                    runs[unit] = end - unit
                going.append(runs[unit])
                for start in range(runs[unit], min(runs[unit] + unit, end - LONGEST)):  # a long repeat begins within its first unit
                    if (end - start) % unit == 0:
                        least = min(least, best[start] + self.repeat(value[start : start + unit] * 3) - math.log10(3) + math.log10((end - start) // unit) + joint * (start > 0))
            best.append(least)
            if least >= enough and min(best[-LONGEST:]) >= enough and all(min(best[s : s + 4]) >= enough for s in going):
                return least
        return best[-1]


def _straight(keys: str) -> bool:
    return any(keys in row or keys[::-1] in row for row in ROWS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


PLAIN = Guesses(ranks([]))


def guess_cost(value: str) -> float:
    """Without a corpus's dictionary."""
    return PLAIN.cost(value)


def segments(value: str, end: int) -> Iterator[tuple[int, float]]:
    """Starts and costs, without a corpus's dictionary, of what may end at ``end``; brute force left out."""
    return ((start, cost) for start in range(max(0, end - LONGEST), end - 2) if (cost := PLAIN.part(value[start:end])) < math.inf)


def guess_spans(text: str, base: list[tuple[int, int, int]], guesses: Guesses = PLAIN) -> list[tuple[int, int, int]]:
    """``base`` and the spans that the programme adds, in order."""
    found = list(base)
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}>!?:")
        if len(value) >= 6 and guesses.cost(value, LEAST_COST) >= LEAST_COST:
            found.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(rank) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = Guesses(rank.value)
        for b in batches:
            rows = []
            for text in values(b.column(1)):
                base = base_spans(text) if text else []
                every = guess_spans(text, base, guesses) if text else []
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The most frequent words of all texts, the most frequent first."""
    #: What stands in a credential's context is no word, or a secret that is copied often would be one.
    text = F.regexp_replace(F.col(text_col).cast("string"), f"(?i){CONTEXT.pattern}", " ")
    words = docs.select(F.explode(F.split(ascii_lower(text), "[^a-z]+")).alias("word")).where(F.length("word").between(WORD_LEAST, WORD_MOST))
    counts = words.groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(most).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, base_sha256, spans. ``words``: the dictionary, else that of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    rank = spark.sparkContext.broadcast(ranks(dictionary(docs, text_col) if words is None else words))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(thrifty(scanned(rank)), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
