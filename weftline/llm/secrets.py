"""Operator 4: secret scans by grammar inference.

Labelled credentials of each kind become a prefix tree with counts. States whose futures differ by no more than a
Hoeffding bound are merged (red-blue order, folding subtrees), which leaves one probabilistic automaton a kind: its
literal beginnings stay chains and its random parts become loops. Every maximal run of token characters is a candidate,
whatever its length and characters. It is scored by its log-likelihood ratio against a background of running text and hosts; it is
added as a span of kind "format" when the ratio is high both a character and in all, unless a base span is just that
run. So a labelled credential behind "token=" has its assign span and the span of its own value.

Base spans (assign, access, hex) are the fixed patterns of patterns(); they stay whatever the automata say. Offsets
are code points, ends exclusive.

Defined cases: null and empty texts have no spans. Texts are scanned whole, whatever their length. Repeated rows give
repeated results; extra columns are ignored. Without labelled credentials nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN, _LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+"), re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
#: Mean log-likelihood ratio a character (nats) from which a candidate is a credential.
THRESHOLD = 0.6
#: Log-likelihood ratio of a whole candidate (nats) below which it is no credential: a short run tells too little.
EVIDENCE = 25.0
#: Share of the background that gives every character the same chance.
EVEN = 0.02
#: Verdicts that a worker remembers, of runs of that many characters at most; more runs are judged anew.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Confidence parameter of the merge test.
ALPHA = 0.05
_SIGNS = "+/_.=-"
_ALPHABET = string.ascii_letters + string.digits + _SIGNS


def example_credentials(each: int = 40, seed: int = 7) -> list[tuple[str, str]]:
    """(kind, credential): made-up values in publicly documented formats, always the same."""
    draw = random.Random(seed)
    alnum, url = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-"
    run = lambda letters, n: "".join(draw.choices(letters, k=n))
    makers = {
        "repository token": lambda: "ghp_" + run(alnum, 36),
        "chat token": lambda: f"xoxb-{run(string.digits, 12)}-{run(string.digits, 12)}-{run(alnum, 24)}",
        "payment key": lambda: "sk_live_" + run(alnum, 24),
        "map key": lambda: "AIza" + run(url, 35),
        "access key": lambda: "AKIA" + run(string.ascii_uppercase + string.digits, 16),
        "package token": lambda: "npm_" + run(alnum, 36),
        "web token": lambda: f"eyJ{run(url, 33)}.eyJ{run(url, 60)}.{run(url, 43)}",
        "digest": lambda: run("0123456789abcdef", draw.choice((32, 40, 64))),
    }
    return [(kind, make()) for kind, make in makers.items() for _ in range(each)]


class Automaton:
    """A probabilistic automaton: for each state its visits, ends and counted transitions."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for w in words:
            state = 0
            self.visits[0] += 1
            for c in w:
                to = self.next[state].get(c)
                if to is None:
                    to = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.next[state][c] = to
                state = to
                self.visits[state] += 1
            self.ends[state] += 1
        self.count = [{c: self.visits[t] for c, t in row.items()} for row in self.next]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.tables = self._tables()

    def _alike(self, a: int, b: int) -> bool:
        """Whether no frequency of a's and b's futures differs by more than the bound."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            nx, ny = self.visits[x], self.visits[y]
            limit = self.bound * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))
            if abs(self.ends[x] / nx - self.ends[y] / ny) > limit:
                return False
            for c in self.count[x].keys() | self.count[y].keys():
                if abs(self.count[x].get(c, 0) / nx - self.count[y].get(c, 0) / ny) > limit:
                    return False
                if c in self.next[x] and c in self.next[y] and self.next[x][c] != self.next[y][c]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree of b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for c, to in self.next[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + self.count[y][c]
                if c in self.next[x]:
                    todo.append((self.next[x][c], to))
                else:
                    self.next[x][c] = to

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = sorted({to for r in red for to in self.next[r].values()} - known, key=lambda s: (-self.visits[s], s))
            if not blue:
                self.states = red
                return
            b = blue[0]
            into = next((r for r in red if self._alike(r, b)), None)
            if into is None:
                red.append(b)
                continue
            for r in red:
                for c, to in self.next[r].items():
                    if to == b:
                        self.next[r][c] = into
            self._fold(into, b)

    def _tables(self) -> dict[int, tuple[dict[str, tuple[float, int]], float, float]]:
        """State to (character to (log probability, state), log probability of others, of the end)."""
        out = {}
        for s in self.states:
            total = self.visits[s] + 1.0
            seen = {c: (math.log((n + 0.5 / len(_ALPHABET)) / total), self.next[s][c]) for c, n in self.count[s].items()}
            out[s] = seen, math.log(0.5 / len(_ALPHABET) / total), math.log((self.ends[s] + 0.5) / total)
        return out

    def score(self, word: str, least: float = -math.inf) -> float:
        """Log-likelihood of word; an unseen character keeps the state and costs its smoothed share.

        Each character can only lower it, so a word is left (with -inf) as soon as it is below least.
        """
        state, total, tables = 0, 0.0, self.tables
        for c in word:
            seen, other, _ = tables[state]
            p, state = seen.get(c, (other, state))
            total += p
            if total < least:
                return -math.inf
        return total + self.tables[state][2]


class Background:
    """Character pairs of ordinary long runs: host names, paths, words, numbers, rulers."""

    def __init__(self, words: list[str]):
        pairs: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for w in words:
            for a, b in zip("^" + w, w):
                pairs[a][b] += 1
        self.log: dict[tuple[str, str], float] = {}
        for a in "^" + _ALPHABET:
            total = sum(pairs[a].values()) + 0.02 * len(_ALPHABET)
            self.log |= {(a, b): math.log((1 - EVEN) * (pairs[a][b] + 0.02) / total + EVEN / len(_ALPHABET)) for b in _ALPHABET}

    def score(self, word: str) -> float:
        return sum(map(self.log.__getitem__, zip("^" + word, word)))


def ordinary_runs(each: int = 120, seed: int = 11) -> list[str]:
    """Made-up runs of token characters that are no credentials."""
    draw = random.Random(seed)
    syllables = "the and ing tion er ent ver ein che lich que eau ent os as ado cion men en de la st re on in at or is it es".split()
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    number = lambda n: "".join(draw.choices(string.digits, k=n))
    makers = (
        lambda: f"mail{number(1)}.{word()}.com", lambda: f"www.{word()}.org/{word()}/{word()}-{number(4)}.html", lambda: "_".join(word() for _ in range(4)) + number(2),
        lambda: number(16), lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: "-" * 24, lambda: "=" * 24, lambda: "-".join(word() for _ in range(4)),
        lambda: word() + word() + word() + word(), lambda: word().upper() + "_" + word().upper() + number(3), lambda: f"{number(3)}.{number(3)}.{number(3)}.{number(3)}",
        lambda: "".join(word().title() for _ in range(3)), lambda: f"{word()}.{word()}{word().title()}{word().title()}", lambda: f"{word().title()}.{word()}_{word()}={number(2)}",
        lambda: "".join(draw.choices(string.ascii_uppercase, k=draw.randint(2, 8))),
    )
    return [make() for make in makers for _ in range(each)]


class Scanner:
    """Base patterns, automata of the labelled kinds, and the background."""

    def __init__(self, labelled: list[tuple[str, str]], threshold: float = THRESHOLD, alpha: float = ALPHA):
        kinds: dict[str, list[str]] = defaultdict(list)
        for kind, word in labelled:
            if kind is not None and word and set(word) <= set(_ALPHABET):
                kinds[kind].append(word)
        self.automata = {kind: Automaton(words, alpha) for kind, words in sorted(kinds.items())}
        self.background = Background(ordinary_runs())
        self.threshold = threshold
        self.ordinary: set[str] = set()

    def ratio(self, word: str) -> float:
        """Log-likelihood ratio of the likeliest kind against the background."""
        best = max((a.score(word) for a in self.automata.values()), default=-math.inf)
        return best - self.background.score(word)

    def judged(self, run: str) -> bool:
        """Whether a run, without the signs at its ends, is a credential by its format: its ratio reaches what is needed."""
        word = run.strip(_SIGNS)
        least = self.background.score(word) + max(EVIDENCE, self.threshold * len(word))
        # No likelihood is over one, so a run that the background explains well needs no automaton.
        return least <= 0 and any(a.score(word, least) >= least for a in self.automata.values())

    def _candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the runs that are credentials by their format; runs that are none are judged once a worker."""
        good = set()
        for run in set(_RUN.findall(text)) - self.ordinary:
            if self.judged(run):
                good.add(run)
            elif len(run) <= REMEMBERED_LENGTH:
                if len(self.ordinary) >= REMEMBERED:
                    self.ordinary.clear()
                self.ordinary.add(run)
        for m in _RUN.finditer(text) if good else ():
            run = m.group()
            if run in good:
                start = m.start() + len(run) - len(run.lstrip(_SIGNS))
                yield start, start + len(run.strip(_SIGNS))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed in KINDS."""
        found = []
        low = text.lower()
        if any(k in low for k in _KEYS):
            found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        # Both other kinds lie within runs of token characters, which no match leaves.
        for a, b in [(m.start(), m.end()) for m in _LONG_RUN.finditer(text)]:
            found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
            found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text, a, b)]
        if self.automata:
            held = {(a, b) for _, a, b in found}
            found += [("format", a, b) for a, b in self._candidates(text) if (a, b) not in held]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start, end, value): one row a span."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, s[0], s[1], s[2], t[s[1] : s[2]]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in scanner.spans(t)]
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "kind", "start", "end", "value"])

    return arrow_map(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind}, kind string, start long, end long, value string")


def digests(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: counts of the base kinds, the digest of the base spans, and all spans as kind:start:end."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = [scanner.spans(t.as_py()) for t in batch.column(1)]
            joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in all_spans], pa.int64()) for k in KINDS[:3]]
            base = [hashlib.sha256(joined([s for s in spans if s[0] != "format"]).encode()).hexdigest() for spans in all_spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined(s) for s in all_spans], pa.string())], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
