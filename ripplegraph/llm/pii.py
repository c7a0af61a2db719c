"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns (e-mail, ip, card, phone) are found on the whole text and always reported. A semi-Markov
conditional random field then labels whole segments: features of a span as a whole (its shape, numbers of digits,
check sums, separators, the words before it) score candidate segments of at most MAX_TOKENS tokens, weights of pairs of types
score neighbouring segments, and dynamic programming over the tokens chooses boundaries and types together. It adds kinds that
patterns alone cannot tell (PERSON, IBAN, SSN, BIRTHDATE, ADDRESS) and variants of the base kinds that the patterns miss.

The weights maximise the conditional likelihood of the right segmentations (forward-backward over all segmentations gives
its gradient) of sentences made up by a seeded generator.

Every candidate segment holds a digit or an at sign, or stands close behind a cue word for persons. Where FAR tokens hold
none of these, no segment reaches from one side to the other, so a text is labelled part by part with the same result as
whole. Null and empty texts have no spans. Nothing is cut from long texts; time is in proportion to their length.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("person", "iban", "ssn", "birthdate", "address")
KINDS = (*BASE, *ADDED)
OUTSIDE = len(KINDS)  #: the label of a token that is in no entity
MAX_TOKENS = 14
CUE_REACH, NAME_TOKENS = 4, 4  #: a cue acts on segments that start so many tokens behind it; names are so long at most
BEHIND = MAX_TOKENS + CUE_REACH  #: tokens before a trigger that a segment with it can depend on
FAR = 2 * MAX_TOKENS + CUE_REACH
DIGITS = (4, 19)  #: digits of a candidate without letters
SEED, SENTENCES, EPOCHS, RATE, DECAY = 11, 600, 5, 0.5, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Words that may stand before personal data, by what they announce.
CUES = {
    "person": ["mr", "mrs", "ms", "dr", "prof", "name", "contact", "attn", "dear", "signed", "patient", "herr", "frau", "señor", "señora", "monsieur", "madame"],
    "iban": ["iban", "account", "bank"],
    "ssn": ["ssn", "social", "security"],
    "birthdate": ["born", "birth", "dob", "birthday", "geboren", "né", "née", "nacido", "nacida"],
    "address": ["address", "street", "lives", "resides", "adresse", "dirección"],
    "phone": ["phone", "tel", "telephone", "call", "mobile", "fax", "cell"],
    "email": ["email", "mail", "e-mail"],
    "card": ["card", "visa", "mastercard", "amex"],
    "ip": ["ip", "host", "server"],
}
STREETS = ["street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "boulevard", "blvd", "way", "square", "straße", "strasse", "rue", "calle", "weg", "platz"]
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec januar februar märz mai juni juli oktober dezember "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre"
).split()
_MONTHS = frozenset(MONTHS)
_BETWEEN = frozenset([".", ",", "-", "/", "st", "nd", "rd", "th", "of", "de", "er"])  # within a date
_CUE = {w: k for k, words in CUES.items() for w in words}
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_PERSON_CUES = frozenset(CUES["person"])
_TRIGGER = re.compile(r"[0-9@]|(?<![^\W\d_])(?:" + "|".join(map(re.escape, CUES["person"])) + r")(?![^\W\d_])", re.I)
_STREETS = frozenset(STREETS)
_JOINTS = frozenset("().-/")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind, in order."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        step = at + 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end(), 0))
            floor = step = m.end()
        at = text.find("@", step)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return [(s, e, BASE[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Line:
    """The tokens of a part of a text, with what span features need."""

    def __init__(self, text: str, begin: int = 0, tokens: list[tuple[int, int]] | None = None):
        """The tokens of the text from begin on, or the given ones."""
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text, begin)] if tokens is None else tokens
        self.words = [text[a:b].lower() for a, b in self.tokens]
        self.digits = [len(w) if w[0] in "0123456789" else 0 for w in self.words]
        self.cue: list[str] = []
        last, age = "", CUE_REACH + 1
        for w in self.words:  # the last cue word within the tokens before
            self.cue.append(last if age <= CUE_REACH else "")
            age += 1
            if w in _CUE:
                last, age = _CUE[w], 1

    def span(self, i: int, j: int) -> str:
        return self.text[self.tokens[i][0] : self.tokens[j - 1][1]]

    def _gap(self, j: int) -> str:
        """What stands between token j - 1 and token j."""
        return self.text[self.tokens[j - 1][1] : self.tokens[j][0]]

    def _end(self, i: int, good) -> int:
        """The end of the longest segment from i of good tokens on one line."""
        j, most = i, min(len(self.tokens), i + MAX_TOKENS)
        while j < most and good(j) and (j == i or "\n" not in self._gap(j)):
            j += 1
        return j

    def candidates(self) -> list[tuple[int, int]]:
        """Segments (first token, end) that may be entities: numbers, what is around one at sign, letters and digits with the check
        sum of an IBAN and no letter or digit next to them, streets with a number, dates with the name of a month, and capitalised words soon after
        a cue word for persons."""
        out: set[tuple[int, int]] = set()
        words, digits, n = self.words, self.digits, len(self.tokens)
        for i, w in enumerate(words):
            if digits[i] or w in "+(":
                total = 0
                for j in range(i, self._end(i, lambda k: digits[k] or words[k] in _JOINTS or k == i)):  # noqa: B023
                    total += digits[j]
                    if total > DIGITS[1] or digits[j] == 1 and j > i and self._alone(j):
                        break
                    if total >= DIGITS[0] and (digits[j] or w == "(" and words[j] == ")"):
                        out.add((i, j + 1))
            elif w == "@":
                first, last = i, i + 1
                while first and i - first < MAX_TOKENS // 2 and words[first - 1] != "@" and not self._gap(first):
                    first -= 1
                while last < n and last - i <= MAX_TOKENS // 2 and words[last] != "@" and not self._gap(last):
                    last += 1
                out.update((a, b) for a in range(first, i) if words[a][0].isalnum() for b in range(i + 2, last + 1) if words[b - 1][0].isalnum() and b - a <= MAX_TOKENS)
            elif w in _STREETS or w.endswith(("straße", "strasse")):
                for a in range(max(0, i - 4), i + 1):
                    if words[a][0].isalnum():
                        end = self._end(a, lambda k: True)
                        out.update((a, b) for b in range(i + 1, min(i + 5, end) + 1) if (digits[b - 1] or b == i + 1) and any(digits[a:b]))
            elif w in _MONTHS:
                out.update(self._dates(i))
            if len(w) == 2 and w.isascii() and w.isalpha() and i + 1 < n and digits[i + 1] and not self._gap(i + 1) and not self._stuck(i, i):
                size = 0
                for j in range(i, self._end(i, lambda k: words[k].isascii() and words[k].isalnum())):
                    size += len(words[j])
                    if 15 <= size <= 34 and not self._stuck(i, j) and _iban(self.span(i, j + 1)):
                        out.add((i, j + 1))
            if self.cue[i] == "person" and self._titled(i):
                end = self._end(i, self._titled)
                out.update((i, b) for b in range(i + 1, min(end, i + NAME_TOKENS) + 1))
        return sorted(out)

    def _stuck(self, i: int, j: int) -> bool:
        """Whether a letter, digit or low line stands right before token i or, for another token j, right after it."""
        before = self.text[self.tokens[i][0] - 1 : self.tokens[i][0]]
        after = self.text[self.tokens[j][1] : self.tokens[j][1] + 1] if j > i else ""
        return any(c.isalnum() or c == "_" for c in before + after)

    def _dates(self, i: int) -> Iterator[tuple[int, int]]:
        """Segments with a month's name at i: a day before it or after it, and then a year, with marks or small words between."""
        n = len(self.words)

        def number(k: int, step: int, sizes: tuple[int, ...]) -> int:
            """The nearest token on this side with so many digits, with two others between at most; -1 if there is none."""
            for _ in range(3):
                if not 0 <= k < n or "\n" in self._gap(max(k, k - step)):
                    return -1
                if self.digits[k]:
                    return k if self.digits[k] in sizes else -1
                if self.words[k] not in _BETWEEN:
                    return -1
                k += step
            return -1

        day = number(i - 1, -1, (1, 2))
        if day >= 0 and (year := number(i + 1, 1, (4,))) >= 0:
            yield day, year + 1
        elif (day := number(i + 1, 1, (1, 2))) >= 0 and (year := number(day + 1, 1, (4,))) >= 0:
            yield i, year + 1

    def _alone(self, k: int) -> bool:
        """Whether there is a space on either side of a token: a single digit so is no part of a number."""
        return bool(self._gap(k)) and k + 1 < len(self.tokens) and bool(self._gap(k + 1))

    def _titled(self, k: int) -> bool:
        return self.words[k].isalpha() and self.text[self.tokens[k][0]].isupper()

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Features of a span as a whole, without its type."""
        s = self.span(i, j)
        digits = sum(self.digits[i:j])
        out = ["bias", f"tokens:{min(j - i, 6)}", f"digits:{min(digits, 20)}", f"cue:{self.cue[i]}"]
        if len(s) <= 40:
            shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", s))
            if len(shape) <= 12:
                out.append(f"shape:{shape}")
        words = self.words[i:j]
        if digits or "@" in words:
            if base := base_spans(s):
                out += [f"base:{k}" for a, b, k in base if (a, b) == (0, len(s))] or ["base inside"]
            if _iban(s):
                out.append("iban")
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
                out.append("three two four")
            if m := re.fullmatch(r"([0-9]{1,4})([-./])([0-9]{1,2})\2([0-9]{1,4})", s):
                out.append("date" if any(1900 <= int(m[k]) <= 2030 for k in (1, 4)) and int(m[3]) <= 31 else "dotted")
            if any(w in _MONTHS for w in words):
                out.append(f"month:{any(1900 <= int(w) <= 2030 for w, d in zip(words, self.digits[i:j]) if d == 4)}")
            if any(w in _STREETS or w.endswith(("straße", "strasse")) for w in words):
                out += ["street and number", f"street ends:{words[-1] in _STREETS or words[-1].isdigit()}", f"street starts:{self._titled(i) or words[0].isdigit()}"]
        if all(w.isalpha() for w in words):
            out += [f"names:{len(words)}"]
            if j < len(self.words) and self._titled(j):
                out.append("goes on")
        before, after = (self.text[self.tokens[i][0] - 1 : self.tokens[i][0]], self.text[self.tokens[j - 1][1] : self.tokens[j - 1][1] + 1])
        if before.isalnum() or after.isalnum() or (before and before in "@+-") or (after and after in "@-"):
            out.append("cut")
        if after == "." and self.text[self.tokens[j - 1][1] + 1 : self.tokens[j - 1][1] + 2].isalnum():
            out.append("cut")
        return tuple(out)


class Model:
    """A segmentation's score is the sum of the scores of its segments (by type and feature; 0 for a token outside) and of
    the weights of the labels of neighbouring segments, the text's ends counting as outside."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights: dict[str, list[float]] = weights or {}
        self.moves = moves or [[0.0] * (OUTSIDE + 1) for _ in range(OUTSIDE + 1)]
        self.known: dict[tuple, list[tuple[int, float]]] = {}
        out = OUTSIDE
        # The most that a segment's neighbours can add to its score against outside tokens in its place.
        self.most = [max(self.moves[y][k] - self.moves[y][out] for y in range(out + 1)) + max(self.moves[k][z] - self.moves[out][z] for z in range(out + 1)) for k in range(out)]

    def scores(self, line: Line, i: int, j: int) -> list[tuple[int, float]]:
        """The kinds that a segment may be in a best labelling, and its scores as them."""
        begin, end = line.tokens[i][0], line.tokens[j - 1][1]
        # All that the features depend on.
        key = (line.text[begin:end], line.cue[i], line.text[begin - 1 : begin], line.text[end : end + 2], j < len(line.words) and line._titled(j))
        got = self.known.get(key)
        if got is None:
            some = [w for f in line.features(i, j) if (w := self.weights.get(f))]
            instead = (j - i - 1) * self.moves[OUTSIDE][OUTSIDE]
            got = [(k, x) for k, x in enumerate(map(sum, zip(*some))) if x + self.most[k] >= instead]
            if len(key[0]) < 100:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[key] = got
        return got

    def best(self, line: Line, found: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
        """The best labelling: segments (first token, end, type) in order; of equal ones that with fewer segments."""
        out: list[tuple[int, int, str]] = []
        ending: dict[int, list] = defaultdict(list)
        begin = end = 0
        for i, j in [*(line.candidates() if found is None else found), (len(line.tokens) + 2, 0)]:
            if ending and i > end:  # a token that no segment covers: what is before it is a part of its own
                out += self._best_part(ending, begin, end)
                ending.clear()
            if j and (scores := self.scores(line, i, j)):
                begin, end = (min(begin, i), max(end, j)) if ending else (i, j)
                ending[j].append((i, scores))
        return out

    def _best_part(self, ending: dict[int, list], begin: int, end: int) -> list[tuple[int, int, str]]:
        """The best labelling of the tokens from begin to end, what is around them being outside."""
        none, labels, moves = float("-inf"), range(OUTSIDE, -1, -1), self.moves
        value = [[none] * (OUTSIDE + 1) for _ in range(end - begin + 1)]
        back: list[list] = [[None] * (OUTSIDE + 1) for _ in range(end - begin + 1)]
        into: dict[tuple[int, int], tuple[float, int]] = {}  # the best way into a label at a place
        value[0][OUTSIDE] = 0.0

        def way(i: int, label: int) -> tuple[float, int]:
            got = into.get((i, label))
            if got is None:
                before = value[i]
                got = into[i, label] = max((before[y] + moves[y][label], y) for y in labels)
            return got

        for j in range(1, end - begin + 1):
            value[j][OUTSIDE], y = way(j - 1, OUTSIDE)
            back[j][OUTSIDE] = (j - 1, y)
            for i, scores in ending.get(begin + j, ()):
                for kind, score in scores:
                    total, y = way(i - begin, kind)
                    if total + score > value[j][kind]:
                        value[j][kind], back[j][kind] = total + score, (i - begin, y)
        j, y = end - begin, way(end - begin, OUTSIDE)[1]
        out = []
        while j:
            i, last = back[j][y]
            if y < OUTSIDE:
                out.append((begin + i, begin + j, KINDS[y]))
            j, y = i, last
        return out[::-1]


def made_up(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with marked entities, or with numbers that are none."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    title = lambda: word().capitalize()
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))

    def card() -> str:
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))])

    def iban() -> str:
        body = number(18)
        check = 98 - int(body + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
        s = f"DE{check:02d}{body}"
        return rng.choice([s, " ".join(s[k : k + 4] for k in range(0, len(s), 4))])

    year = lambda: str(rng.randint(1930, 2010))

    def spoken() -> str:
        day, month = rng.randint(1, 28), rng.choice(MONTHS).capitalize()
        return rng.choice([f"{day} {month} {year()}", f"{month} {day}, {year()}", f"{day}. {month} {year()}", f"{day} de {month} de {year()}"])

    make = {
        "email": lambda: f"{word()}.{word()}@{word()}.example.{rng.choice(['com', 'org', 'net'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{rng.randint(1, 99)} {number(3)} {number(4)} {number(3)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"]),
        "person": lambda: " ".join(title() for _ in range(rng.randint(1, 3))),
        "iban": iban,
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
        "birthdate": lambda: rng.choice([f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year()}", f"{year()}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{year()}", spoken()]),
        "address": lambda: rng.choice([f"{rng.randint(1, 999)} {title()} {rng.choice(['Street', 'Road', 'Avenue', 'Lane', 'St', 'Blvd'])}", f"{title()}straße {rng.randint(1, 200)}", f"Calle {title()} {rng.randint(1, 99)}"]),
    }
    noise = [lambda: str(rng.randint(0, 9999)), lambda: number(rng.choice([8, 12, 16, 20])), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"{year()}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", spoken, lambda: f"{rng.randint(1, 99)}%", lambda: number(32), lambda: f"CC BY {rng.randint(1, 4)}.0", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"{word()}@ {word()}", lambda: f"{number(3)} {title()} {word()}"]
    text, spans = " ".join(word() for _ in range(rng.randint(0, 6))), []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            if kind in ("person", "birthdate", "ssn") or rng.random() < 0.5:
                text += " " + rng.choice(CUES[kind]).capitalize() + rng.choice([" ", ": ", ". " if kind == "person" else " "])
            else:
                text += " "
            s = make[kind]()
            spans.append((len(text), len(text) + len(s), kind))
            text += s
        else:
            text += " " + rng.choice(noise)()
        text += rng.choice(["", "", ",", "."]) + " " + " ".join(word() for _ in range(rng.randint(0, 5)))
    return text, spans


class Lesson:
    """A sentence with its right segmentation, its candidates' features as numbers."""

    def __init__(self, text: str, spans: list[tuple[int, int, str]], number: dict[str, int]):
        line = Line(text)
        self.n, found = len(line.tokens), line.candidates()
        self.segments = found
        self.features = [[number.setdefault(f, len(number)) for f in line.features(i, j)] for i, j in found]
        first = {a: i for i, (a, _) in enumerate(line.tokens)}
        last = {b: i + 1 for i, (_, b) in enumerate(line.tokens)}
        place = {x: k for k, x in enumerate(found)}
        self.gold = {place[x]: KINDS.index(k) for a, b, k in spans if (x := (first.get(a, -1), last.get(b, -1))) in place}
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.starting: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, j) in enumerate(found):
            self.ending[j].append(k)
            self.starting[i].append(k)

    def gold_moves(self) -> np.ndarray:
        """How often each label follows each in the right segmentation, the ends being outside."""
        out = np.zeros((OUTSIDE + 1, OUTSIDE + 1))
        starts = {self.segments[k][0]: (self.segments[k][1], kind) for k, kind in self.gold.items()}
        at, last = 0, OUTSIDE
        while at < self.n:
            at, label = starts.get(at, (at + 1, OUTSIDE))
            out[last, label] += 1
            last = label
        out[last, OUTSIDE] += 1
        return out

    def expected(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """By forward-backward over all segmentations: the probability of each candidate as each kind, how often each label is
        expected to follow each, and the logarithm of the normaliser. scores: candidates x kinds."""
        n, labels = self.n, OUTSIDE + 1
        ahead, behind = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        ahead[0, OUTSIDE] = 0.0
        add = np.logaddexp.reduce
        for j in range(1, n + 1):
            ahead[j, OUTSIDE] = add(ahead[j - 1] + moves[:, OUTSIDE])
            if self.ending[j]:
                parts = [add(ahead[self.segments[k][0]][:, None] + moves[:, :OUTSIDE], axis=0) + scores[k] for k in self.ending[j]]
                ahead[j, :OUTSIDE] = add(parts, axis=0)
        behind[n] = moves[:, OUTSIDE]
        for i in range(n - 1, -1, -1):  # behind[i, y]: what follows a segment with label y that ends at i
            parts = [moves[:, OUTSIDE] + behind[i + 1, OUTSIDE]]
            parts += [add(moves[:, :OUTSIDE] + scores[k] + behind[self.segments[k][1], :OUTSIDE], axis=1) for k in self.starting[i]]
            behind[i] = add(parts, axis=0)
        total = add(ahead[n] + moves[:, OUTSIDE])
        p, follow = np.zeros((len(self.segments), OUTSIDE)), np.zeros((labels, labels))
        for k, (i, j) in enumerate(self.segments):
            each = np.exp(ahead[i][:, None] + moves[:, :OUTSIDE] + scores[k] + behind[j, :OUTSIDE] - total)
            p[k] = each.sum(0)
            follow[:, :OUTSIDE] += each
        follow[:, OUTSIDE] += np.exp(ahead[:-1] + moves[:, OUTSIDE] + behind[1:, OUTSIDE, None] - total).sum(0)
        follow[:, OUTSIDE] += np.exp(ahead[n] + moves[:, OUTSIDE] - total)
        return p, follow, float(total)


@cache
def trained(seed: int = SEED, sentences: int = SENTENCES, epochs: int = EPOCHS) -> Model:
    """The field's weights by stochastic gradient ascent on the conditional likelihood; the same on every machine of a kind."""
    rng, number = random.Random(seed), {}
    lessons = [Lesson(*made_up(rng), number) for _ in range(sentences)]
    w, moves = np.zeros((len(number), OUTSIDE)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    seen_w, seen_moves = np.full_like(w, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(epochs):
        rng.shuffle(lessons)
        for x in lessons:
            scores = np.array([w[f].sum(0) for f in x.features]) if x.features else np.zeros((0, OUTSIDE))
            p, follow, _ = x.expected(scores, moves)
            slope = -p
            for k, kind in x.gold.items():
                slope[k, kind] += 1
            if x.features:
                ids = np.concatenate([np.array(f) for f in x.features])
                rows, place = np.unique(ids, return_inverse=True)
                g = np.zeros((len(rows), OUTSIDE))
                np.add.at(g, place, np.repeat(slope, [len(f) for f in x.features], axis=0))
                g -= DECAY * w[rows]
                seen_w[rows] += g * g
                w[rows] += RATE * g / np.sqrt(seen_w[rows])
            g = x.gold_moves() - follow
            seen_moves += g * g
            moves += RATE * g / np.sqrt(seen_moves)
    return Model({f: w[i].tolist() for f, i in number.items()}, moves.tolist())


def _before(text: str, at: int) -> int:
    """Where the text starts that holds the BEHIND tokens before a position."""
    size = 16 * BEHIND
    while True:
        cut = max(0, at - size)
        # Read backwards, a text has the same tokens; the last one may go on beyond the slice.
        tokens = [m.end() for m, _ in zip(_TOKEN.finditer(text[cut:at][::-1]), range(BEHIND + 1))]
        if len(tokens) > BEHIND or not cut and len(tokens) == BEHIND:
            return at - tokens[BEHIND - 1]
        if not cut:
            return 0
        size *= 4


def parts(text: str) -> Iterator[Line]:
    """The parts of a text that may hold segments: from BEHIND tokens before a trigger on, until FAR tokens hold no other."""
    at = 0
    while m := _TRIGGER.search(text, at):
        begin = _before(text, m.start())
        tokens: list[tuple[int, int]] = []
        last = 0
        for t in _TOKEN.finditer(text, begin):
            tokens.append(t.span())
            if t.start() <= m.start() or _TRIGGER.fullmatch(t[0][:1]) or t[0].lower() in _PERSON_CUES:
                last = len(tokens)
            elif len(tokens) - last > FAR:
                break
        at = tokens[-1][1] if tokens and len(tokens) - last > FAR else len(text)
        yield Line(text, tokens=tokens)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and added spans), each by start, then kind in the order of KINDS.

    An added span never repeats or crosses a base span.
    """
    base = base_spans(text)
    added = []
    for line in parts(text):
        if found := line.candidates():
            added += [(line.tokens[i][0], line.tokens[j - 1][1], kind) for i, j, kind in model.best(line, found)]
    added.sort()
    free, at = [], 0
    inside = sorted((s, e) for s, e, _ in base)
    ends = list(accumulate((e for _, e in inside), max))
    for s, e, kind in added:  # a base span that starts before e and ends after s
        at = bisect_left(inside, (e,))
        if not at or ends[at - 1] <= s:
            free.append((s, e, kind))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + free, key=lambda x: (x[0], order[x[2]], x[1]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, text_col: str = "text", out_col: str = "personal") -> DataFrame:
    """docs with a struct column: base and spans, arrays of (kind, start, end) in code points, end exclusive. Null counts as empty.

    The driver learns the weights (some ten thousand numbers) and sends them along.
    """
    weights, moves = trained().weights, trained().moves
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    @F.arrow_udf(T.StructType([T.StructField("base", span), T.StructField("spans", span)]))
    def run(texts: pa.Array) -> pa.Array:
        model = Model(weights, moves)
        found = [all_spans(t.as_py() or "", model) for t in texts]
        dicts = [[[{"kind": k, "start": s, "end": e} for s, e, k in part] for part in both] for both in found]
        return pa.StructArray.from_arrays([pa.array([d[0] for d in dicts], _SPAN), pa.array([d[1] for d in dicts], _SPAN)], ["base", "spans"])

    return docs.withColumn(out_col, run(text_or_empty(text_col)))


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.col("personal.base")
    return found.select(
        "doc_id",
        *(_count(base, k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("personal.spans")).alias("spans"),
    )
