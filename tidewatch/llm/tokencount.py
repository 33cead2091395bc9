"""Exact token counts by prefix dynamic programming over byte-pair merges.

For every byte prefix of a piece the table holds the last token of that prefix's encoding and the number
of its tokens. The encoding of a prefix ends in the one token t for which (last token of the prefix
without t, t) is a pair that merging leaves alone; so a prefix costs a few look-ups and nothing is encoded
twice. Pieces are what the tokenizer's pre-tokenizer splits; their counts add up, and pieces seen before
are remembered.

Defined results
* null text: empty, no bytes and no tokens; null doc_id is kept; repeated rows: a row each;
* special strings inside a text count as one token each (the library's default);
* very long texts are counted whole, pieces of any length included;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship_package

#: The pre-tokenizer's fixed pattern; white space as Unicode defines it.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                      r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SPLIT_CONTRACTIONS = ("'r", "'v", "'l")
#: Pieces, prefixes and pairs remembered per worker; beyond it they are forgotten and found again.
REMEMBERED = 1_000_000
#: Longer pieces get a table of their own, smaller ones share the states of their prefixes.
LONG_PIECE = 200


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of every prefix, for the tokenizer file whose content is given."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        byte = _byte_of_char()
        decode = lambda s: bytes(byte[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[decode(a), decode(b)] = i
        specials = [t["content"] for t in spec["added_tokens"]]
        added = set(specials)
        self.vocab = frozenset(decode(t) for t in spec["model"]["vocab"] if t not in added)
        self.longest = max(map(len, self.vocab))
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._states: dict[bytes, tuple[int, bytes]] = {}
        self._pieces = _Pieces(self)

    def _merged(self, word: bytes) -> list[bytes]:
        """Merge a short byte string, lowest rank first."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Does encoding a + b give exactly these two tokens?"""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            found = self._pairs[a, b] = self._merged(a + b) == [a, b]
        return found

    def _is_whole(self, token: bytes) -> bool:
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self._merged(token) == [token]
        return found

    def state(self, prefix: bytes) -> tuple[int, bytes]:
        """Token count and last token of a prefix; shared by all pieces that begin with it."""
        found = self._states.get(prefix)
        if found is None:
            vocab, end = self.vocab, len(prefix)
            for start in range(max(0, end - self.longest), end):
                token = prefix[start:]
                if token in vocab:
                    if not start:
                        if self._is_whole(token):
                            found = (1, token)
                            break
                        continue
                    count, last = self.state(prefix[:start])
                    if self._stays(last, token):
                        found = (count + 1, token)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")
            if len(self._states) > REMEMBERED:
                self._states.clear()
            self._states[prefix] = found
        return found

    def table(self, piece: bytes) -> list[int]:
        """Token count of each byte prefix of one piece; entry 0 is 0."""
        if len(piece) <= LONG_PIECE:
            return [0, *(self.state(piece[:end])[0] for end in range(1, len(piece) + 1))]
        counts, last = [0], [b""]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in self.vocab and (self._stays(last[start], token) if start else self._is_whole(token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return counts

    def piece_count(self, piece: bytes) -> int:
        return self.state(piece)[0] if len(piece) <= LONG_PIECE else self.table(piece)[-1]

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at:m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pieces' tables."""
        if self.special is None or not self.special.search(text):
            return sum(map(self._pieces.__getitem__, PIECE.findall(text)))
        return sum(1 if special else sum(map(self._pieces.__getitem__, PIECE.findall(part)))
                   for part, special in self._segments(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for i in 0..len(text), each as if that prefix were encoded alone.

        A prefix splits like the whole text except for white space at its end, which then is one piece,
        for a contraction cut short, and inside a special string, which then is ordinary text.
        """
        out, base, tail = [0], 0, ""
        for part, special in self._segments(text):
            if special:
                before = base - self.count_plain(tail)
                out += [before + self.count_plain(tail + part[:i]) for i in range(1, len(part))]
                base += 1
                out.append(base)
                tail = ""
                continue
            tail = "".join(PIECE.findall(part)[-2:])  # enough to tell how more text would join it
            at, run, run_base = 0, 0, base
            for piece in PIECE.findall(part):
                table = self.table(piece.encode())
                size = 0
                for i, c in enumerate(piece):
                    size += len(c.encode())
                    if c.isspace() and WHITE.fullmatch(c):
                        if not run:
                            run_base = base + table[size - len(c.encode())] if i else base
                        run += 1
                        out.append(run_base + self.table(part[at + i + 1 - run:at + i + 1].encode())[-1])
                    else:
                        run = 0
                        out.append(base + (2 if piece[:i + 1] in _SPLIT_CONTRACTIONS and piece[i + 1:] else table[size]))
                base += table[-1]
                at += len(piece)
        return out

    def count_plain(self, text: str) -> int:
        return sum(self.table(p.encode())[-1] for p in PIECE.findall(text))


WHITE = regex.compile(r"\p{White_Space}")


class _Pieces(dict):
    """Counts of whole pieces seen so far."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self.counter.piece_count(piece.encode())
        if len(self) > REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_for(tokenizer_json: str) -> PrefixCounter:
    """One counter per worker process, so that pieces stay remembered from task to task."""
    if tokenizer_json not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[tokenizer_json] = PrefixCounter(tokenizer_json)
    return _COUNTERS[tokenizer_json]


def _held(df: DataFrame, tokenizer_path: str):
    """The tokenizer file, of fixed size, as a broadcast: executors need no file of their own."""
    ship_package(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit)."""
    held = _held(docs, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(held.value)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def with_prefix_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text and prefix_tokens: the token count of every code point prefix, entry 0 being 0."""
    held = _held(docs, tokenizer_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(held.value)
        for batch in batches:
            counts = [counter.prefix_counts(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int32()))],
                                             ["doc_id", "text", "prefix_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, text string, prefix_tokens array<int>")


def truncate_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """From ``with_prefix_counts``: the longest prefix of each text within the budget, without encoding again.

    Counts need not rise from prefix to prefix, so the last prefix that fits is taken.
    """
    fits = F.filter(F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return counted.withColumn("kept_chars", F.array_max(fits)).withColumn(
        "text", F.substring(F.col("text"), F.lit(1), F.col("kept_chars")))
