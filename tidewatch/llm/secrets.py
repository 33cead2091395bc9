"""Secret scans with a linear-chain conditional random field.

Three base patterns find secrets of known forms. The field tags each word as the beginning of a secret, inside one
or outside, from the word's shape, the hashed words around it, the hashed name it is assigned to and features of
the whole file, with learned transitions; Viterbi decoding picks the best tags. It is trained on the base finds of a
bounded sample of documents. So that it learns more than the patterns know,

* names and neighbours are hidden from half of the training, where shapes have to do alone, and
* words that look like random tokens but are of no known form have free tags: the likelihood sums over them, so they
  are not taught to be harmless, and end up where words of their shape and surroundings belong.

Its spans are added where they touch no base span; base spans always stay.

The scan weighs every word of a text. A word whose weight for outside is more than all that the text's suspicious
words could win together is outside on the best path, so only the words between such words are decoded, with the same
tags as decoding the text at once (``field_spans``).

Defined results
* null text: empty, no spans; texts of any length are scanned whole, to the last character;
* no base find in the sample: nothing is learned, the base spans are the result;
* repeated rows: a row each; null doc_id is kept; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import by_broadcast_if_small, cut, hash_sample, ship_package

#: Bounds of what is learned from: documents (half of them with a base find, if there are), stretches of words with
#: and without a find, and words of a stretch.
TRAIN_DOCS, TRAIN_STRETCHES, STRETCH_WORDS = 4000, 4000, 200
#: Words beside a word and names are told apart by so many hash values.
NEIGHBOURS = 512
PLAIN_BELOW = 20
TAGS = ("O", "B", "I")
KINDS = ("assign", "access", "hex", "field")
#: The base patterns for a first look at documents to learn from.
BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bounds of the words remembered by a task: their number and their characters.
_REMEMBERED, _REMEMBERED_CHARS = 300_000, 4_000_000
#: Characters that no plain word has, capitals inside a word, and words long enough to be worth a look.
_ODD = re.compile(r"[0-9=_+/@:]|[a-z][A-Z]|[^\x20\x09-\x0D]{%d,}" % PLAIN_BELOW)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns: leftmost, non-overlapping per kind, too short ones dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_values(text: str) -> list[Span]:
    """What training calls the secret of a base find: of an assignment the value, not the name."""
    found = [(m.start(2), m.end(2), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    return sorted(found + [s for s in base_spans(text) if s[2] != "assign"])


def _entropy(word: str) -> float:
    n = len(word)
    counts = map(word.count, dict.fromkeys(word)) if n <= 64 else Counter(word).values()
    return -sum([_share(c, n) for c in counts])


@lru_cache(100_000)
def _share(c: int, n: int) -> float:
    return c / n * math.log2(c / n)


_CLASSES = str.maketrans({c: k for k, cs in (("d", "0123456789"), ("l", "abcdefghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in cs})
_NOT_LETTER = re.compile(r"[\W\d_]+")


_MARKS = "\"'`,;()[]{}<>.!?"


def plain_letters(value: str) -> bool:
    """Lower-case letters, the first one in either case."""
    return value.isalpha() and (len(value) == 1 or value[1:].islower())


def parts(word: str) -> tuple[str, str | None, str]:
    """A word without marks around it, the name it assigns to (or None) and its value."""
    core = word.strip(_MARKS)
    if ":" in core or "=" in core:
        name, _, value = core.partition("=") if "=" in core.rstrip("=") else core.partition(":")
        if value.strip("\"'"):
            return core, name, value.strip("\"'")
    return core, None, core


def bucket(word: str) -> int:
    """Hash value of a word's letters; words without one are told by their marks."""
    return zlib.crc32((_NOT_LETTER.sub("", word).lower() or word[:1] + word[-1:]).encode("utf-8", "surrogatepass")) % NEIGHBOURS


LENGTHS, TURNS, ENTROPIES = (6, 9, 12, 16, 20, 28), (2, 4, 6, 9), (2.0, 2.5, 3.0, 3.4)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word's form, without its letters."""
    core, name, value = parts(word)
    plain = plain_letters(value)
    if plain:
        kinds, turns = ("l" if value.islower() else "lu"), 0
    else:
        marks = re.sub(r"[^dlu]", "s", value.translate(_CLASSES)) if value.isascii() else "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value)
        kinds = "".join(sorted(set(marks)))
        turns = sum(a != b for a, b in zip(marks, marks[1:]))
    # steps, not values: a longer or more mixed word than any seen has all the features of those seen
    out = [f"has {k}" for k in kinds] + ["letters and digits"] * ("d" in kinds and ("l" in kinds or "u" in kinds))
    out += [f"length>={n}" for n in LENGTHS if len(value) >= n] + [f"turns>={n}" for n in TURNS if turns >= n]
    if not plain:
        entropy = _entropy(value) if value else 0.0
        out += [f"entropy>={n}" for n in ENTROPIES if entropy >= n]
    if name is not None:
        out.append("assigned")
    if not plain:
        if value[:1] in "0123456789abcdef" and not value.strip("0123456789abcdef"):
            out.append("hexadecimal")
        if "@" in word or "www." in word or "://" in word:
            out.append("address")
        if not core[:1].isalpha() and re.fullmatch(r"[-+().\d/:%,]*", core):
            out.append("number")
        if "." in value:
            out.append(f"dots={min(3, value.count('.'))}")
    return tuple(out)


def word_features(word: str) -> list[str]:
    """Form of a word, and the name it assigns to."""
    name = parts(word)[1]
    return [*shape(word), f"name={bucket(name)}" if name is not None else "no name"]


def doubtful(word: str) -> bool:
    """Does a word look like a random token? Only training asks: such words of no known form have free tags."""
    core, _, value = parts(word)
    kinds = sum(any(test(c) for c in value) for test in (str.isdigit, str.isupper, str.islower))
    return len(value) >= 12 and kinds >= 2 and "@" not in word and "://" not in word and "www." not in word and bool(re.search(r"[A-Za-z]", value)) and _entropy(value) >= 3


def file_features(text: str) -> list[str]:
    """Features of the file as a whole: how much of it looks like settings or code."""
    marks = text.count("=") + text.count(":")
    return [f"file marks={min(6, marks.bit_length())}", f"file size={min(6, len(text).bit_length() // 3)}"]


#: One word: start, end, features.
Word = tuple[int, int, list[str]]


def stretches(text: str) -> Iterator[list[Word]]:
    """The parts of a text that are not all plain words, each with two words of context on both sides."""
    spots = [m.span() for m in _ODD.finditer(text)]
    if not spots:
        return
    words: list[tuple[int, int]] = []  # the odd words
    for a, b in spots:
        if words and a < words[-1][1]:
            continue
        start = a
        while start > 0 and not _blank(text[start - 1]):
            start -= 1
        words.append((start, _WORD.match(text, start).end()))
    file = file_features(text)
    group: list[tuple[int, int]] = []
    for word in words:
        if group:
            gap = [m.span() for m in islice(_WORD.finditer(text, group[-1][1], word[0]), 5)]
            if len(gap) <= 4 and len(group) < STRETCH_WORDS:  # no word of context is told twice
                group += [*gap, word]
                continue
            yield _described(text, group, file)
        group = [word]
    yield _described(text, group, file)


def _blank(c: str) -> bool:
    return c in " \t\n\x0b\x0c\r"


def _described(text: str, group: list[tuple[int, int]], file: list[str]) -> list[Word]:
    before: list[tuple[int, int]] = []
    end = group[0][0]
    while len(before) < 2:
        while end > 0 and _blank(text[end - 1]):
            end -= 1
        if end == 0:
            break
        start = end
        while start > 0 and not _blank(text[start - 1]):
            start -= 1
        before.insert(0, (start, end))
        end = start
    group = [*before, *group, *(m.span() for m in islice(_WORD.finditer(text, group[-1][1]), 2))]
    words = [text[a:b] for a, b in group]
    near = [bucket(w) for w in words]
    out = []
    for i, (a, b) in enumerate(group):
        around = [f"before={near[i - 1]}" if i else "first", f"after={near[i + 1]}" if i + 1 < len(near) else "last", f"before2={near[i - 2]}" if i > 1 else "early"]
        out.append((a, b, [*word_features(words[i]), *around, *file]))
    return out


#: Features that half of the training does without.
HIDDEN = ("before=", "before2=", "after=", "name=", "hexadecimal")


def hidden(features: Iterable[str]) -> list[str]:
    return [f for f in features if not f.startswith(HIDDEN)]


def tags_of(stretch: list[Word], spans: list[Span]) -> list[int]:
    """Tags of the words by the base spans that touch them."""
    out, open_end = [], -1
    for a, b, _ in stretch:
        hit = [s for s in spans if s[0] < b and a < s[1]]
        if not hit:
            out.append(0)
        else:
            out.append(2 if any(s[0] < open_end and s[0] < a for s in hit) else 1)
            open_end = max(s[1] for s in hit)
    return out


class Field:
    """Weights by feature and tag, and transitions between tags (row: from)."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names), 3))
        self.moves = np.zeros((3, 3))

    def emissions(self, stretch: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in stretch])

    def number(self, stretch: list[Word]) -> list[list[int]]:
        return [[self.names[f] for f in features if f in self.names] for _, _, features in stretch]

    def decode(self, stretch: list[Word]) -> list[int]:
        return self.best_tags(self.emissions(self.number(stretch)))

    def best_tags(self, emit: np.ndarray) -> list[int]:
        """Viterbi: the best tags of words that lie between outside words."""
        best, back = self.moves[0] + emit[0], []
        for e in emit[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e
        tag = int((best + self.moves[:, 0]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


#: Tags a word may have, by its number in the training table; free words may have any.
FREE = 3


def posterior(emit: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all tag paths, expected tags of each word and expected transitions; both ends lie outside."""
    n = len(emit)
    forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
    forward[0] = moves[0] + emit[0]
    for i in range(1, n):
        forward[i] = _log_sum(forward[i - 1][:, None] + moves, 0) + emit[i]
    backward[-1] = moves[:, 0]
    for i in range(n - 2, -1, -1):
        backward[i] = _log_sum(moves + (emit[i + 1] + backward[i + 1])[None, :], 1)
    total = float(_log_sum(forward[-1] + backward[-1], 0))
    marginal = np.exp(forward + backward - total)
    steps = np.zeros((3, 3))
    steps[0] += marginal[0]
    steps[:, 0] += marginal[-1]
    if n > 1:
        pairs = forward[:-1, :, None] + moves[None] + (emit[1:] + backward[1:])[:, None, :] - total
        steps += np.exp(pairs).sum(axis=0)
    return total, marginal, steps


def allowed(emit: np.ndarray, tags: list[int]) -> np.ndarray:
    """Emissions with the tags a word can't have ruled out."""
    out = np.where(np.arange(3)[None, :] == np.asarray(tags)[:, None], emit, -1e9)
    free = np.asarray(tags) == FREE
    out[free] = emit[free]
    return out


def gradient(emit: np.ndarray, moves: np.ndarray, tags: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the tags (summed over those of free words), and its slope by emissions and transitions."""
    total, marginal, steps = posterior(emit, moves)
    held, wanted, made = posterior(allowed(emit, tags), moves)
    return held - total, wanted - marginal, made - steps


#: Gradient steps, a stretch each; every stretch is seen once in each way at least.
STEPS = 20_000


def fit(examples: list[tuple[list[list[str]], list[int]]], rounds: int | None = None, rate: float = 0.2, l2: float = 1e-3) -> Field | None:
    """Maximise the conditional likelihood of the tags by adaptive gradient steps, stretch by stretch; every other step
    hides names and neighbours."""
    counts = Counter(f for words, _ in examples for features in words for f in features)
    if not any(t in (1, 2) for _, tags in examples for t in tags):
        return None
    field = Field({f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))})
    w, moves = field.weights, field.moves
    gw2, gm2 = np.full_like(w, 1e-2), np.full_like(moves, 1e-2)
    bare = {i for f, i in field.names.items() if f.startswith(HIDDEN)}
    numbered = []
    for words, tags in examples:
        full = [[field.names[f] for f in features if f in field.names] for features in words]
        numbered.append((full, [[f for f in fs if f not in bare] for fs in full], tags))
    order = np.random.default_rng(5)
    for turn in range(rounds or max(2, STEPS // max(1, len(numbered)))):
        for at in order.permutation(len(numbered)):
            full, some, tags = numbered[at]
            words = some if (turn + at) % 2 else full
            _, ge, gm = gradient(field.emissions(words), moves, tags)
            for features, g in zip(words, ge):
                if features:
                    g = g - l2 * w[features]
                    gw2[features] += g * g
                    w[features] += rate * g / np.sqrt(gw2[features])
            gm2 += gm * gm
            moves += rate * gm / np.sqrt(gm2)
    return field


class Known(dict):
    """Words seen by a task to numbers: what a word weighs by itself and how it tells of its neighbours."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.chars = field, 0
        table = lambda at: np.array([self.weigh([f"{at}={c}"]) for c in range(NEIGHBOURS)])
        self.before, self.after, self.before2 = table("before"), table("after"), table("before2")
        self.edges = {e: self.weigh([e]) for e in ("first", "last", "early")}
        self.shapes: dict[tuple, int] = {}
        self.quick: dict[tuple[bool, int], int] = {}
        self.forms: list[tuple[float, float, float]] = []
        # a word assigned to a name never seen is weighed as in the half of the training that hides names and neighbours
        self.heeds: list[float] = []
        # a word's entry holds its form and its hash value in one number
        inside = field.moves[1:, 1:].max() - field.moves[0, 0]
        self.inside, self.edge = inside, field.moves[0, 1:].max() + field.moves[1:, 0].max() - 2 * field.moves[0, 0]

    def weigh(self, features: Iterable[str]) -> np.ndarray:
        return self.field.weights[[self.field.names[f] for f in features if f in self.field.names]].sum(axis=0)

    def form(self, features: tuple[str, ...]) -> int:
        at = self.shapes.setdefault(features, len(self.shapes))
        if at == len(self.forms):
            self.forms.append(tuple(self.weigh(features)))
            name = features[-1]
            self.heeds.append(0.0 if name.startswith("name=") and name not in self.field.names else 1.0)
            self._table = None
        return at

    def __missing__(self, word: str) -> int:
        core = word.strip(_MARKS)
        if plain_letters(core):  # the form of most words is their length
            key = (core.islower(), bisect(LENGTHS, len(core)))
            if (at := self.quick.get(key)) is None:
                at = self.quick[key] = self.form(tuple(word_features(word)))
            entry = at * NEIGHBOURS + zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % NEIGHBOURS
        else:
            entry = self.form(tuple(word_features(word))) * NEIGHBOURS + bucket(word)
        self[word] = entry
        self.chars += len(word)
        return entry

    _table: np.ndarray | None = None
    _heeds: np.ndarray | None = None

    def emissions(self, text: str) -> np.ndarray:
        """What every word of the text weighs for each tag."""
        if len(self) > _REMEMBERED or self.chars > _REMEMBERED_CHARS:
            self.clear()
            self.chars = 0
        words = _WORD.findall(text)
        if not words:
            return np.zeros((0, 3))
        at, near = np.divmod(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), NEIGHBOURS)
        if self._table is None or len(self._table) < len(self.forms):
            self._table, self._heeds = np.array(self.forms), np.array(self.heeds)[:, None]
        out, heeds = self._table[at] + self.weigh(file_features(text)), self._heeds[at]
        out[1:] += self.before[near[:-1]] * heeds[1:]
        out[0] += self.edges["first"]
        out[:-1] += self.after[near[1:]] * heeds[:-1]
        out[-1] += self.edges["last"]
        out[2:] += self.before2[near[:-2]] * heeds[2:]
        out[:2] += self.edges["early"]
        return out

    def suspicious(self, emit: np.ndarray) -> np.ndarray:
        """Numbers of the words that may not be outside. A run of tags beside outside wins at most the sum of its words'
        gains and the edges, so a word whose loss is more than all gains of the text together is in no run."""
        gain = emit[:, 1:].max(axis=1) - emit[:, 0] + self.inside
        most = np.maximum(gain, 0).sum() + max(0.0, self.edge - self.inside)
        return np.nonzero(gain + most > -1e-9)[0]


def field_spans(text: str, field: Field, base: list[Span], known: Known | None = None) -> list[Span]:
    """Spans of the field that touch no base span. Marks around a secret and the name it is assigned to are left out."""
    out: list[Span] = []
    known = Known(field) if known is None else known
    emit = known.emissions(text)
    if not len(emit):
        return out
    some = known.suspicious(emit)
    if not len(some):
        return out
    words = None
    for run in np.split(some, np.nonzero(np.diff(some) > 1)[0] + 1):
        tags, i = field.best_tags(emit[run]), 0
        if not any(tags):
            continue
        words = words or [m.span() for m in _WORD.finditer(text)]
        stretch = words[run[0]:run[-1] + 1]
        while i < len(tags):
            if not tags[i]:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == 2:
                j += 1
            a, b = stretch[i][0], stretch[j - 1][1]
            value = parts(text[a:stretch[i][1]])[2]
            a = text.index(value, a) if value else a
            b = max(a + 1, a + len(text[a:b].rstrip("\"'`,;.)]}>")))
            if not any(s[0] < b and a < s[1] for s in base) and not (out and a < out[-1][1]):
                out.append((a, b, "field"))
            i = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def examples_of(text: str) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Stretches of a text with their tags; look-alikes of no known form are free."""
    base = secret_values(text)
    for stretch in stretches(text):
        tags = [FREE if t == 0 and doubtful(text[a:b]) else t for (a, b, _), t in zip(stretch, tags_of(stretch, base))]
        yield [features for _, _, features in stretch], tags


def train(docs: DataFrame, rows: int = TRAIN_DOCS, most: int = TRAIN_STRETCHES) -> Field | None:
    """Fit the field on stretches of a bounded sample of documents (by hash), those with a base find and others."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, tags = [], []
            for text in batch.column(0).to_pylist():
                for w, t in examples_of(text):
                    words.append(w)
                    tags.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.list_(pa.string()))), pa.array(tags, pa.list_(pa.int8()))], ["words", "tags"])

    # one look at all texts with the patterns; the picks are made from the hashes and flags it leaves
    texts = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("_h"))
    looks = cut(texts.select("_h", F.col("text").rlike(BASE).alias("_found")))
    counts = {r["_found"]: r["n"] for r in looks.groupBy("_found").agg(F.count("*").alias("n")).collect()}
    picks = None
    for found, n in counts.items():
        share = looks.where((F.col("_found") == found) & (F.pmod("_h", F.lit(1 << 40)) < F.lit(4.0 * rows * (1 << 40)) / F.lit(n)))
        # equal rows hash alike: one of them will do
        picked = share.select("_h").distinct().orderBy(F.pmod("_h", F.lit(1 << 40)), "_h").limit(rows // 2)
        picks = picked if picks is None else picks.unionByName(picked)
    if picks is None:
        return None
    made = texts.join(by_broadcast_if_small(picks), "_h", "left_semi").groupBy("_h").agg(F.first("text").alias("text")).select("text")
    found = cut(made.repartition(8).mapInArrow(work, "words array<array<string>>, tags array<tinyint>"))
    held = []
    for told in (True, False):
        some = found.where(F.exists("tags", lambda t: t.isin(1, 2)) == told)
        held += hash_sample(some.withColumn("_key", F.xxhash64("words", "tags")), "_key", most).select("words", "tags").collect()
    return fit(sorted(([list(f) for f in r["words"]], list(r["tags"])) for r in held))


def scan(docs: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        known = Known(field) if field else None
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                added = field_spans(text, field, base, known) if field else []
                kinds = Counter(s[2] for s in base)
                spans = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                out.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows_of = docs.select(F.col("doc_id").cast("long"), "text")
    return rows_of.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
