"""Operator 3: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: each byte is written as one printable character
(the usual byte-to-character table), merges follow the ranks, and a piece that is a token itself is taken whole. Decoding
reverses that table: the tokens' characters are joined and each becomes its byte again.
The text is split into pieces first; each distinct piece is encoded once per worker while a bounded table holds it.

Defined cases: null text is the empty text, with no ids. Very long texts are one row as any other. Repeated rows
give repeated results. Extra columns are ignored; the key column keeps its name and type. Tokens may end inside a
character: offsets then name the characters that the token's bytes touch, and decode() of such ids gives the bytes,
with U+FFFD in the text form.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, slices

#: Pieces that a worker remembers, pieces that the library encodes at once, and characters whose pieces stand in memory at once.
REMEMBERED, AT_ONCE, CHARACTERS = 50_000, 4096, 1 << 18
#: Characters for which the standard library's classes agree with the pattern's: ASCII, Latin letters, common signs.
PLAIN = re.compile("[\t-\r\x20-\x7e\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-⁞₠-₵]*")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: The pattern of the rank file, for texts of PLAIN alone.
PLAIN_PIECES = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.general = pattern != _rank_pattern()
        self.characters = byte_characters()
        self.table = {i: c for i, c in enumerate(self.characters)}
        self.bytes = np.zeros(512, np.uint8)
        self.bytes[[ord(c) for c in self.characters]] = np.arange(256)
        spell = lambda token: token.decode("latin-1").translate(self.table)
        self.spelled = {r: spell(t) for t, r in self.ranks.items()}
        merges = [tuple(map(spell, self._parts(t, r))) for t, r in sorted(self.ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.model = Tokenizer(models.BPE(vocab={t: r for r, t in self.spelled.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def _parts(self, token: bytes, rank: int) -> list[bytes]:
        """The two tokens whose merge makes token: what the merges of lower rank leave of its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rates = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            i = min(range(len(rates)), key=rates.__getitem__)
            if rates[i] >= rank:
                raise ValueError(f"no merges make the token of rank {rank}")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; for common characters by an equal and faster expression."""
        if not self.general and PLAIN.fullmatch(text):
            return PLAIN_PIECES.findall(text)
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encodes those pieces that are not remembered."""
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        for a in range(0, len(new), AT_ONCE):
            spelled = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for p in new[a : a + AT_ONCE]]
            for piece, got in zip(new[a : a + AT_ONCE], self.model.encode_batch_fast(spelled, add_special_tokens=False)):
                ids = tuple(got.ids)
                self.known[piece] = ids, " ".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return list(chain.from_iterable(self.known[p][0] for p in pieces))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """(first, end) in code points for each id; a token that holds a part of a character spans that character."""
        data = text.encode("utf-8", "surrogatepass")
        starts = [(b & 0xC0) != 0x80 for b in data]
        before = [0, *accumulate(map(int, starts))]
        ends = list(accumulate(len(self.spelled[i]) for i in ids))
        return [(before[a + 1] - 1, before[b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids) -> bytes:
        """The ids' characters, each turned back into its byte; an id outside the vocabulary raises KeyError."""
        spelled = "".join(map(self.spelled.__getitem__, ids))
        return self.bytes[np.frombuffer(spelled.encode("utf-16-le"), np.uint16)].tobytes()


@lru_cache(maxsize=1)
def _rank_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, whose millions of lasting tuples the cycle collector need not visit."""
    # A worker has one core's share; threads of the library would each keep memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = Codec(path, pattern)
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)
    return made


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, starts array<int>, ends array<int>): token ids and their code-point spans."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts, CHARACTERS):
                ids = [own.encode(x) for x in texts[a:b]]
                spans = [own.offsets(x, i) for x, i in zip(texts[a:b], ids)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a)] + [pa.array(x, pa.list_(pa.int32())) for x in (ids, [[s for s, _ in y] for y in spans], [[e for _, e in y] for y in spans])],
                    names=[key, "ids", "starts", "ends"],
                )

    return arrow_map(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary, text string) from arrays of ids; null ids give null. Ends of split characters become U+FFFD."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([None if x is None else x.decode("utf-8", "replace") for x in data], pa.string())], names=[key, "data", "text"])

    return arrow_map(df.select(F.col(key), F.col(ids)), run, f"`{key}` {kind.simpleString()}, data binary, text string")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of a round trip: texts are encoded and the ids decoded again."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, names, back = [], [], []
            for a, b in slices(texts, CHARACTERS):
                split = [own.pieces(x) for x in texts[a:b]]
                own.learn(set(chain.from_iterable(split)))
                for pieces in split:
                    found = [own.known[p] for p in pieces]
                    ids = list(chain.from_iterable(x for x, _ in found))
                    counts.append(len(ids))
                    names.append(hashlib.sha256(" ".join([s for _, s in found]).encode()).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(df: DataFrame, path: str, pattern: str, columns: list[str], text: str = "text") -> DataFrame:
    """columns and n_tokens, the length of each text's encoding."""
    schema = df.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts, counts = batch.column(batch.num_columns - 1).to_pylist(), []
            for a, b in slices(texts, CHARACTERS):
                split = [own.pieces(x) for x in texts[a:b]]
                own.learn(set(chain.from_iterable(split)))
                counts += [sum([len(own.known[p][0]) for p in pieces]) for pieces in split]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*columns, "n_tokens"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return arrow_map(df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text")), run, f"{out}, n_tokens long")
