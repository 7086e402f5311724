"""Personal data: exact base rules, and a semi-Markov conditional random field for what they miss.

Method. Around digits and at-signs a text has islands of neighbouring tokens; outside them no entity
can lie. An island falls into atoms (letters, digits, single other characters). The CRF scores whole
candidate segments of up to ``MOST`` atoms by features of the span (digit count, checksum, shape,
separators, what touches it) for each entity type, single atoms as outside, and moves between types;
dynamic programming over (position, type) with bounded segments chooses boundaries and types jointly,
so that a phone number and a card number written side by side come apart. The weights are fitted here
by gradient ascent on the exact likelihood (forward-backward over segments), on islands generated
from a fixed seed; no corpus text is needed, so fitting costs the same at every size.

Spans. The base rules' spans always stay; the CRF adds segments that overlap none of them.

Defined results: null texts count as empty; empty texts have no spans; positions are code points, end
exclusive; equal texts get equal spans; of segmentations that score the same the one with the earlier
outside or kind stays; work is linear in the text's length, also for one long island or run of digits,
of which a window of ``STARTS`` atoms is held at a time; an empty table gives an empty table; further columns are ignored (``spans``) or kept (``redact``).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices

KINDS = ("email", "ip", "card", "phone")
#: Atoms of the longest segment, rounds and islands of fitting.
MOST, ROUNDS, ISLANDS = 20, 8, 300
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a match never begins inside a run of digits, as it would also begin at the run's start
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ISLAND = re.compile(r"(?<!\S)\S*[0-9@]\S*(?: \S*[0-9@]\S*)*")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# ---- features of candidate segments ---------------------------------------------------------

_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP_SHAPE = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
_PHONE_SHAPE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,3}")
_LOCAL_PHONE = re.compile(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}")
_GROUPS = re.compile(r"[0-9]{4}([ -][0-9]{4}){3}")


#: What each character of ASCII is, by code point.
_ASCII = [chr(c) for c in range(128)]
_DIGITS, _ALPHA, _ALNUM = (np.array([f(c) for c in _ASCII]) for f in (str.isdigit, str.isalpha, str.isalnum))
_IN_LOCAL, _IN_DOMAIN, _LEFT, _RIGHT, _OPENS = (np.array([c in x for c in _ASCII]) for x in (_LOCAL, _LOCAL - set("_%+"), set("+-.@_%"), set("-@_%"), set("+(")))


def _is(table: np.ndarray, code: np.ndarray, beyond=None) -> np.ndarray:
    """The table's answer for each character; ``beyond`` answers for those outside ASCII, else no."""
    out = table[np.minimum(code, 127)]
    far = code > 127
    if far.any():
        out[far] = False
        if beyond is not None:
            known, place = np.unique(code[far], return_inverse=True)
            out[far] = np.array([beyond(chr(c)) for c in known.tolist()])[place]
    return out


def _running(x: np.ndarray) -> np.ndarray:
    """Sums before each place, and of all."""
    return np.concatenate([[0], np.cumsum(x, dtype=np.int32)])


class Window:
    """Consecutive atoms of an island, the segments that begin at the first ``starts`` of them, and their features.

    ``text`` is the island's part from one character before the first atom; ``cuts`` are places in it.
    """

    def __init__(self, text: str, cuts: np.ndarray, starts: int):
        self.text, self.cuts = text, cuts
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code, n = code, len(cuts) - 1
        self.alnum = _is(_ALNUM, code, str.isalnum)
        digit, alpha = _is(_DIGITS, code), _is(_ALPHA, code, str.isalpha)
        self.digits, self.alphas = _running(digit), _running(alpha)
        self.plain = code[digit].astype(np.int32) - 48
        first = cuts[:-1]
        self.count = {c: _running(code == ord(c)) for c in " -.@\n"}
        size = np.diff(cuts)
        self.is_digit, self.size = digit[first], size
        words = _running(alpha[first])
        opens = (self.alnum[first] | _is(_OPENS, code[first]))[:starts]
        closes = np.concatenate([[False], self.alnum[cuts[1:] - 1]])
        i = np.flatnonzero(opens)[:, None]
        j = i + np.arange(1, MOST + 1)
        inside = j <= n
        j = np.minimum(j, n)
        a, b = cuts[i], cuts[j]
        n_digits, n_words = self.digits[b] - self.digits[a], words[j] - words[i]
        at, dots = (self.count[c][b] - self.count[c][a] for c in "@.")
        mail = (at == 1) & (n_words > 0) & (dots > 0)
        number = (at == 0) & (n_words == 0) & ((n_digits >= 7) & (n_digits <= 19) | (j - i == 7) & (dots == 3))
        line = self.count["\n"]
        row, column = np.nonzero(inside & closes[j] & (mail | number) & (line[b] == line[a]))
        self.i, self.j = i[row, 0], j[row, column]

    def _atoms(self, k: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Of segments of seven atoms: whether atoms 0, 2, 4, 6 are digits that hold, and 1, 3, 5 single characters that ``more`` allows."""
        out = np.ones(len(k), bool)
        for o in range(7):
            out &= more[k + o] if o % 2 else self.is_digit[k + o]
        return out

    def features(self) -> np.ndarray:
        """A row a segment."""
        a, b, code, text = self.cuts[self.i], self.cuts[self.j], self.code, self.text
        first, last = self.digits[a], self.digits[b]
        n = last - first
        has = {c: x[b] - x[a] for c, x in self.count.items()}
        out = np.zeros((len(a), N_FEATURES))
        out[:, 0] = 1
        for k, (low, high) in enumerate(((0, 6), (7, 9), (10, 12), (13, 15), (16, 16), (17, 19), (20, 1 << 30)), 1):
            out[:, k] = (n >= low) & (n <= high)
        # a checksum doubles every second digit from the last but one: running sums for both parities of the last place
        double = self.plain * 2 - 9 * (self.plain > 4)
        even = np.arange(len(self.plain)) % 2 == 0
        sums = np.stack([_running(np.where(even, self.plain, double)), _running(np.where(even, double, self.plain))])
        side = (last - 1) % 2
        out[:, 8] = (n >= 16) & (n <= 19) & ((sums[side, last] - sums[side, first]) % 10 == 0)
        if (one := has["@"] == 1).any():
            at = np.flatnonzero(code == 64)[self.count["@"][a[one]]]
            odd_local, odd_domain = _running(~_is(_IN_LOCAL, code)), _running(~_is(_IN_DOMAIN, code))
            dot = code == 46
            dots, bare = self.count["."], _running(dot & np.concatenate([[False], dot[:-1] | (code[:-1] == 64)]))
            end = b[one]
            out[one, 9] = (at > a[one]) & (odd_local[at] == odd_local[a[one]]) & (odd_domain[end] == odd_domain[at + 1]) & (dots[end] > dots[at + 1]) & (bare[end] == bare[at + 1]) & (code[end - 1] != 46)
        seven = np.flatnonzero(self.j - self.i == 7)
        if len(seven):
            k = self.i[seven]
            value = np.zeros(len(self.size), np.int32)
            short = self.is_digit & (self.size <= 3)
            start = self.digits[self.cuts[:-1]]
            for o in range(3):
                more = short & (self.size > o)
                value[more] = value[more] * 10 + self.plain[start[more] + o]
            mark = code[self.cuts[:-1]]
            byte, four = short & (value <= 255), self.is_digit & (self.size == 4)
            every = lambda x: x[k] & x[k + 2] & x[k + 4] & x[k + 6]
            out[seven, 10] = every(byte) & self._atoms(k, mark == 46)
            out[seven, 13] = every(four) & self._atoms(k, (mark == 32) | (mark == 45))
        begin, end = code[a], code[b - 1]
        for c, column, shape in ((43, 11, _PHONE_SHAPE), (40, 12, _LOCAL_PHONE)):
            for k in np.flatnonzero(begin == c).tolist():
                out[k, column] = shape.fullmatch(text, int(a[k]), int(b[k])) is not None
        out[:, 14], out[:, 15], out[:, 16] = has["@"] == 1, begin == 43, begin == 40
        out[:, 17] = self.alphas[b] > self.alphas[a]
        for k, c in enumerate(" -.", 18):
            out[:, k] = has[c] > 0
        out[:, 21], out[:, 22] = b - a == n, self.alnum[b - 1]
        out[:, 23], out[:, 25] = self.alnum[a - 1], _is(_LEFT, code[a - 1])
        out[:, 24], out[:, 26] = self.alnum[b], _is(_RIGHT, code[b])
        return out


N_FEATURES = 27
#: Atoms at which the segments of a window begin.
STARTS = 1 << 15


def windows(island: str):
    """(place of its first atom, place of its text, window): a line stands for what is before and after the island."""
    held, done = [], 0
    for m in _ATOM.finditer(island):
        held.append(m.start())
        if len(held) > STARTS + MOST:
            yield done, held[0] - 1, _window(island, held, STARTS)
            held, done = held[STARTS:], done + STARTS
    yield done, (held[0] if held else 0) - 1, _window(island, [*held, len(island)], len(held))


def _window(island: str, cuts: list[int], starts: int) -> Window:
    low, high = cuts[0], cuts[-1]
    text = (island[low - 1] if low else "\n") + island[low:high] + (island[high] if high < len(island) else "\n")
    return Window(text, np.array(cuts, np.int64) - (low - 1), starts)


class Lattice:
    """An island's atoms, candidate segments and their features; for short islands, as in fitting."""

    def __init__(self, island: str):
        self.island = island
        (_, at, window), *more = windows(island)
        assert not more, "an island of several windows is decoded, not fitted"
        self.cuts = (window.cuts + at).tolist()
        self.segments = list(zip(window.i.tolist(), window.j.tolist(), strict=True))
        self.n = len(self.cuts) - 1
        self.x = window.features()
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            self.ending[j].append(k)


def _logsum(x: np.ndarray, axis=None) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True)), axis=axis)


class SemiCRF:
    """Weights of segment features by entity type, and of moves between types (outside is 0)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def _scores(self, lattice: Lattice) -> np.ndarray:
        return lattice.x @ self.weights.T

    def _worth(self, window: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which segments may be entities of the best segmentation, of which types, and their scores.

        A type is left out if, whatever the neighbours, the segment's atoms score better outside.
        """
        score = window.features() @ self.weights.T
        gain = (self.moves[:, 1:] - self.moves[:, :1]).max(axis=0) + np.maximum(0, (self.moves[1:] - self.moves[0]).max(axis=1))
        outside = (window.j - window.i - 1) * self.moves[0, 0]
        may = score + gain >= outside[:, None] - 1e-9
        good = np.flatnonzero(may.any(axis=1))
        return good, may[good], score[good]

    def decode_island(self, island: str) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (kind, start, end) of an island, or of islands joined by line feeds.

        Where no segment reaches, every path is outside, so the groups of segments between such places
        are decoded one by one as they come.
        """
        out, group, reach, ends = [], [], 0, False
        for first, at, window in windows(island):
            good, may, score = self._worth(window) if len(window.i) else (window.i, None, None)
            if not len(good):
                continue
            i, j = window.i[good], window.j[good]
            last = (window.code[window.cuts[j]] == 10).tolist()
            y, rows = np.nonzero(may.T)
            of_row: list[list[tuple[int, float]]] = [[] for _ in good]
            for k, kind, value in zip(rows.tolist(), y.tolist(), score[rows, y].tolist(), strict=True):
                of_row[k].append((kind + 1, value))
            for s, end in zip(zip((i + first).tolist(), (j + first).tolist(), (window.cuts[i] + at).tolist(), (window.cuts[j] + at).tolist(), of_row, strict=True), last, strict=True):
                if group and s[0] > reach:
                    out += self._decoded(group, ends)
                    group = []
                group.append(s)
                if s[1] >= reach:
                    reach, ends = s[1], end
        return out + (self._decoded(group, ends) if group else [])

    def _decoded(self, group: list[tuple], ends: bool) -> list[tuple[int, int, int]]:
        """The entities of segments (first atom, end, start, end, types with scores) that touch one another; ``ends``: with the island."""
        group.sort(key=lambda s: (s[1], s[0]))
        moves, states, low = self.moves.tolist(), range(len(KINDS) + 1), float("-inf")
        at, k = min(s[0] for s in group), 0
        start = at
        best, back = {at: [0.0] + [low] * len(KINDS)}, {}
        for place in sorted({p for s in group for p in s[:2]} - {at}):
            into = [v + m[0] for v, m in zip(best[at], moves)]
            prev = into.index(max(into))
            own = [into[prev] + (place - at - 1) * moves[0][0]] + [low] * len(KINDS)
            back[place, 0] = (at, prev, 0, 0)
            while k < len(group) and group[k][1] == place:
                i, _, a, b, scores = group[k]
                v = best[i]
                for y, score in scores:
                    into = [x + m[y] for x, m in zip(v, moves)]
                    value = max(into)
                    if value + score > own[y]:
                        own[y], back[place, y] = value + score, (i, into.index(value), a, b)
                k += 1
            best[place] = own
            at = place
        last = best[at] if ends else [v + moves[y][0] for y, v in enumerate(best[at])]
        out, y = [], max(states, key=last.__getitem__)
        while at != start:
            i, prev, a, b = back[at, y]
            if y:
                out.append((y - 1, a, b))
            at, y = i, prev
        return out[::-1]

    def gradient(self, lattice: Lattice, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold entities and its slope, by forward-backward over segments."""
        score, n, kinds = self._scores(lattice), lattice.n, len(KINDS)
        forward = np.full((n + 1, kinds + 1), -1e9)
        forward[0, 0] = 0
        for j in range(1, n + 1):
            forward[j, 0] = _logsum(forward[j - 1] + self.moves[:, 0])
            if own := lattice.ending[j]:
                starts = [lattice.segments[k][0] for k in own]
                forward[j, 1:] = _logsum(_logsum(forward[starts][:, :, None] + self.moves[None, :, 1:], 1) + score[own], 0)
        backward = np.full((n + 1, kinds + 1), -1e9)
        backward[n] = 0
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(lattice.segments):
            starting[i].append(k)
        for i in range(n - 1, -1, -1):
            ways = [self.moves[:, 0] + backward[i + 1, 0]]
            if own := starting[i]:
                ends = [lattice.segments[k][1] for k in own]
                ways += list((self.moves[:, None, 1:] + (score[own] + backward[ends][:, 1:])[None]).transpose(1, 2, 0).reshape(-1, kinds + 1))
            backward[i] = _logsum(np.stack(ways), 0)
        total = float(_logsum(forward[n]))
        slope, moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for i in range(n):
            moves[:, 0] -= np.exp(forward[i] + self.moves[:, 0] + backward[i + 1, 0] - total)
        for k, (i, j) in enumerate(lattice.segments):
            p = np.exp(forward[i][:, None] + self.moves[:, 1:] + score[k] + backward[j, 1:] - total)
            moves[:, 1:] -= p
            slope -= p.sum(axis=0)[:, None] * lattice.x[k]
        at = {s: k for k, s in enumerate(lattice.segments)}
        atom = {c: k for k, c in enumerate(lattice.cuts)}
        value, prev, here = 0.0, 0, 0
        for y, a, b in gold + [(-1, len(lattice.island), 0)]:
            while here < atom[a]:
                value, prev, here = value + self.moves[prev, 0], self._move(moves, prev, 0), here + 1
            if y >= 0:
                k = at[atom[a], atom[b]]
                value += self.moves[prev, y + 1] + score[k, y]
                slope[y] += lattice.x[k]
                prev, here = self._move(moves, prev, y + 1), atom[b]
        return value - total, slope, moves

    @staticmethod
    def _move(moves: np.ndarray, a: int, b: int) -> int:
        moves[a, b] += 1
        return b


def generated(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """An island with its entities: alone, side by side, beside other numbers, or none at all."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = str(rng.randint(3, 6)) + digit(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    make = {
        0: lambda: f"{word()}{rng.choice(['', '.', '_', '+', '-'])}{rng.choice([digit(2), word(), ''])}".rstrip("._+-") + f"@{word()}{rng.choice(['', digit(1), '-' + word()])}.{word()}" + rng.choice(["", ".com", ".org"]),
        1: lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        2: card,
        3: lambda: rng.choice([f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", f"+{digit(2)} {digit(3)} {digit(3)} {digit(4)}", f"+{digit(2)}-{digit(3)}-{digit(4)}-{digit(2)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"+{digit(1)}.{digit(3)}.{digit(3)}.{digit(4)}"]),
    }
    others = [
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: digit(rng.randint(1, 6)), lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"v{digit(1)}.{digit(2)}.{digit(1)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))), lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16)), lambda: digit(rng.randint(8, 15)), lambda: digit(rng.randint(20, 30)),
        lambda: f"{digit(2)}.{digit(3)}.{rng.randint(256, 999)}.{digit(2)}", lambda: f"@{word()}", lambda: f"{digit(3)},{digit(3)},{digit(3)}", lambda: f"{digit(2)}:{digit(2)}:{digit(2)}", lambda: f"{word()}={digit(9)}",
    ]
    text, gold = "", []
    for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
        text += " " if text else ""
        if rng.random() < 0.6:
            y = rng.randrange(4)
            s, lead, tail = make[y](), rng.choice(["", "", "", "(", '"', "ip="]), rng.choice(["", "", "", ".", ",", ")"])
            if y == 3:
                lead = ""
            gold.append((y, len(text) + len(lead), len(text) + len(lead) + len(s)))
            text += lead + s + tail
        else:
            text += rng.choice(others)()
    return text, gold


@lru_cache(maxsize=1)
def fitted(seed: int = 5) -> SemiCRF:
    """The model, fitted by Adagrad on the likelihood of generated islands."""
    rng = random.Random(seed)
    data = []
    while len(data) < ISLANDS:
        text, gold = generated(rng)
        lattice = Lattice(text)
        known = {(lattice.cuts[i], lattice.cuts[j]) for i, j in lattice.segments}
        if all((a, b) in known for _, a, b in gold):
            data.append((lattice, gold))
    crf = SemiCRF(np.zeros((len(KINDS), N_FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    seen_w, seen_m = np.full_like(crf.weights, 1e-6), np.full_like(crf.moves, 1e-6)
    for _ in range(ROUNDS):
        for lattice, gold in data:
            _, g, m = crf.gradient(lattice, gold)
            g -= 0.002 * crf.weights
            seen_w += g * g
            seen_m += m * m
            crf.weights += 0.5 * g / np.sqrt(seen_w)
            crf.moves += 0.3 * m / np.sqrt(seen_m)
    return crf


class Finder:
    """Base rules and the fitted CRF in a worker; short islands met before are remembered, up to a bound."""

    def __init__(self, crf: SemiCRF):
        self.crf, self.known = crf, {}

    def decoded(self, island: str) -> list[tuple[int, int, int]]:
        return self._islands([island])[island]

    def _islands(self, islands: list[str]) -> dict[str, list[tuple[int, int, int]]]:
        """The entities of each island; those not known are decoded at once, as one text of lines."""
        if len(self.known) > KNOWN:
            self.known.clear()
        fresh = [x for x in dict.fromkeys(islands) if x not in self.known]
        out: dict[str, list[tuple[int, int, int]]] = {x: [] for x in fresh}
        ends = np.cumsum([len(x) + 1 for x in fresh]).tolist()
        for y, a, b in self.crf.decode_island("\n".join(fresh)):
            k = bisect_right(ends, a)
            low = ends[k - 1] if k else 0
            out[fresh[k]].append((y, a - low, b - low))
        self.known |= {x: found for x, found in out.items() if len(x) <= SHORT}
        return {x: out[x] if x in out else self.known[x] for x in islands}

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        return self.spans_all([text])[0]

    def spans_all(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """Of each text base spans and all spans, each (kind, start, end) by kind and start."""
        out = []
        for text in texts:
            base, met = base_spans(text), []
            begins, ends = _united(base)
            if "@" in text or _DIGIT.search(text):
                met = [(m.start(), m[0]) for m in _ISLAND.finditer(text) if m.end() - m.start() >= 7 and _open(text, *m.span(), begins, ends)]
            out.append((base, begins, ends, met))
        found = self._islands([x for *_, met in out for _, x in met])
        return [(base, sorted(base + [s for at, x in met for s in _clear(found[x], at, begins, ends)])) for base, begins, ends, met in out]


def _clear(found: list[tuple[int, int, int]], at: int, begins: list[int], ends: list[int]):
    """An island's entities, by their places in its text, that overlap no united span."""
    for y, a, b in found:
        k = bisect_right(ends, a + at)
        if k == len(ends) or begins[k] >= b + at:
            yield y, a + at, b + at


#: Characters of the longest island that is remembered, and their number.
SHORT, KNOWN = 200, 20_000


def _open(text: str, start: int, end: int, begins: list[int], ends: list[int]) -> bool:
    """Whether between the united spans of [start, end) there is room for an entity: an at-sign or four digits."""
    k = bisect_right(ends, start)
    while start < end:
        stop = min(begins[k], end) if k < len(begins) else end
        if stop - start >= 7:
            if text.find("@", start, stop) >= 0:
                return True
            n = 0
            for _ in _DIGIT.finditer(text, start, stop):
                n += 1
                if n == 4:
                    return True
        if k == len(begins):
            return False
        start, k = ends[k], k + 1
    return False


def _united(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """First and last places of the union of spans, ascending."""
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for y, a, b in spans)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans of every text."""
    crf = df.sparkSession.sparkContext.broadcast(fitted())

    def task():
        finder = Finder(crf.value)

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            found = finder.spans_all([t or "" for t in p.column("text").to_pylist()])
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            return pa.RecordBatch.from_arrays([p.column("doc_id"), *counts, digest, pa.array([_joined(x) for _, x in found], pa.string())], names=names)

        return each

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the union, named by the first."""
    out, done = [], 0
    for y, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[y].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with personal data in their texts replaced; null texts stay null."""
    crf = df.sparkSession.sparkContext.broadcast(fitted())

    def task():
        finder = Finder(crf.value)

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            texts = p.column(text_col).to_pylist()
            found = finder.spans_all([t or "" for t in texts])
            texts = [t if t is None else mask(t, every) for t, (_, every) in zip(texts, found, strict=True)]
            k = p.schema.get_field_index(text_col)
            return p.set_column(k, p.schema.field(k), pa.array(texts, p.schema.field(k).type))

        return each

    return map_slices(df, task, df.schema, text_col)
