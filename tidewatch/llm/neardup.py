"""Near-duplicate detection with MinHash bands verified by odd sketches and then by full sets.

1. One pass over the texts gives each row the digest of its shingle set, 32 band keys of 4 MinHash values
   and an odd sketch: the 128 samples folded into a 512-bit parity map.
2. Rows with equal digests are one class; everything after works on classes.
3. Each band bucket links its members to its most central class (the one that meets the most others over all
   buckets). The XOR population count of two odd sketches estimates their similarity and drops pairs far below
   the threshold; the rest is confirmed on full sets.
4. Confirmed links are closed to components (alternating large-star and small-star steps). The members that
   meet a centre in some bucket are its family. A family in one component needs nothing more. In the others the
   members outside the largest component are compared with all members, in blocks of bounded size: by sketch,
   then exactly on full sets. A block gives out only the links that join components, not all its pairs, so no
   component is lost to the choice of the centre and no group is collected in one task.

A pair at the threshold shares no band with a chance of (1 - 0.8^4)^32 = 5e-8; the sketch bound stands
more than six deviations away from it.

Defined results
* null, empty or white-space texts: no shingles, linked with nothing, each row its own component;
* a text of fewer words than the width: the whole sequence is its one shingle;
* repeated rows: equal components; rows that share a doc_id but not a text are told apart by text;
* null doc_id: never the component's id while another row has one; alone, component_id is null and the
  row is kept;
* ``deduplicate`` keeps one row of each component whatever the ids, and every row without words; of rows that share id and
  text the one whose JSON comes first;
* empty table: empty result; extra columns are ignored by ``components`` and carried by ``deduplicate``.

The comparison within a family is quadratic in the members outside its largest component; no cap is set on it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_KEYS, by_broadcast_if_small, cut, ship_package

SAMPLES, BAND_ROWS, SKETCH_BITS = 128, 4, 512
BANDS = SAMPLES // BAND_ROWS
#: Sketches farther apart than this are of sets with an estimated similarity under 0.5.
MOST_BITS_APART = int(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * 0.5 / SKETCH_BITS)))
#: Rows of a block in the comparison of a family's members, and columns of the matrix that counts what they share.
BLOCK, _COLUMNS = 512, 4096
_REMEMBERED_WORDS = 200_000

_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MULTIPLY = _RANDOM.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BAND_MIX = _RANDOM.integers(0, 1 << 62, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_START = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED_WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are lower-cased (A-Z) and split at white space."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    out = np.full(n, span, np.uint64)
    for i in range(span):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        part = h[at:at + 512, None] ^ _XOR
        part *= _MULTIPLY
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = _BAND_START.copy()
    for i in range(BAND_ROWS):
        key = _mixed((key + rows[:, i]) * _BAND_MIX[i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of how often each of the 512 places is hit by a sample."""
    place = ((samples ^ _PLACE) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 9)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id long, text_md5 string, digest binary, n_shingles long, bands array<long>, sketch array<long>"


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, bands, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                digests.append(digest(shingles))
                samples = signature(shingles) if len(shingles) else None
                bands.append(band_keys(samples) if len(shingles) else [])
                sketches.append(odd_sketch(samples) if len(shingles) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(bands, longs), pa.array(sketches, longs)],
                ["doc_id", "text_md5", "digest", "n_shingles", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("text_md5"), F.col("text").cast("binary")).mapInArrow(work, _SIGNED)


def _bits_apart(a: str, b: str) -> Column:
    total = F.bit_count(F.element_at(a, 1).bitwiseXOR(F.element_at(b, 1)))
    for i in range(2, SKETCH_BITS // 64 + 1):
        total = total + F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i)))
    return total


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sizes allow the similarity and whose odd sketches don't rule it out."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("n_shingles").alias(f"{x}_n"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (_bits_apart("a_sketch", "b_sketch") <= MOST_BITS_APART))
            .select("a", "b", "a_n", "b_n"))


def _full_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, width: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, made again from one text of each."""
    wanted = by_broadcast_if_small(classes.join(cids.distinct(), "cid", "left_semi").select("cid", "digest", F.col("min_id").alias("_id"), F.col("min_md5").alias("_md5")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for cid, want, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shingles = shingle_set(text, width)
                if digest(shingles) == want:
                    cids.append(cid)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "shingles"])

    # by id and text, as many texts may share an id or have none; equal rows bring a class more than once, all alike
    texts = (docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("text_md5"), F.col("text").cast("binary").alias("text"))
             .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5"))).select("cid", "digest", "text"))
    return cut(texts.mapInArrow(work, "cid long, shingles array<long>").dropDuplicates(["cid"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have the similarity."""
    side = lambda x: sets.select(F.col("cid").alias(x), F.col("shingles").alias(f"{x}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return cut(pairs.join(side("b"), "b").join(side("a"), "a")
               .where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)).select("a", "b"))


def _common(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections where wanted, else 0."""
    out = np.zeros(wanted.shape)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 64:
        for i, j in pairs:
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    every = np.concatenate([*left, *right])
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only what is held twice can be common
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    shared = count[place] > 1
    owner, place = owner[shared], number[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(number[-1]) + 1, _COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + _COLUMNS])
        part = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        out += part[:len(left)] @ part[len(left):].T
    return out


def joining_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between rows (cid, comp, sketch, shingles) of two blocks that join components, a spanning forest of them."""
    sketches = [np.array([r[2] for r in rows], np.int64).view(np.uint64) for rows in (left, right)]
    apart = np.zeros((len(left), len(right)), np.int32)
    for word in range(sketches[0].shape[1]):
        apart += np.bitwise_count(sketches[0][:, None, word] ^ sketches[1][None, :, word])
    comps = [np.array([r[1] for r in rows]) for rows in (left, right)]
    n = [np.array([len(r[3]) for r in rows], np.float64) for rows in (left, right)]
    small, large = np.minimum(n[0][:, None], n[1][None]), np.maximum(n[0][:, None], n[1][None])
    wanted = (apart <= MOST_BITS_APART) & (comps[0][:, None] != comps[1][None]) & (100 * small >= percent * large)
    if not wanted.any():
        return []
    common = _common([r[3] for r in left], [r[3] for r in right], wanted)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(wanted & (100 * common >= percent * (n[0][:, None] + n[1][None] - common))):
        a, b = root(left[i][1]), root(right[j][1])
        if a != b:
            parent[a] = b
            out.append((left[i][0], right[j][0]))
    return out


def _family_links(stars: DataFrame, labels: DataFrame, classes: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links that join components inside the families of star centres. stars: a (centre), b (member)."""
    members = stars.select(F.col("a").alias("family"), F.col("b").alias("cid")).union(stars.select("a", F.col("a")).distinct())
    members = members.join(labels, F.col("cid") == F.col("node"), "left").select("family", "cid", F.coalesce("comp", "cid").alias("comp"))
    members = cut(members)
    by_comp = members.groupBy("family", "comp").agg(F.count("*").alias("n"))
    by_family = by_comp.groupBy("family").agg(F.max_by("comp", "n").alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n")).where("n > inside and n > 2")
    by_family = cut(by_family.select("family", "main", F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int").alias("outer"),
                                     F.ceil(F.col("inside") / BLOCK).cast("int").alias("inner")))
    mixed = members.join(by_family, "family")
    spread = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    mixed = mixed.withColumn("block", F.when(F.col("comp") == F.col("main"), F.col("outer") + spread("inner")).otherwise(spread("outer")))
    sets = sets_of(mixed.select("cid"))
    rows = mixed.join(classes.select("cid", "sketch"), "cid").join(sets, "cid")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)))
    rows = rows.select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cid", "comp", "sketch", "shingles", "outer")
    rows = rows.where("i < outer").drop("outer")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sketches = table.column("sketch").to_pylist()
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("shingles")]
        rows = list(zip(table.column("cid").to_pylist(), table.column("comp").to_pylist(), sketches, sets))
        blocks = table.column("block").to_pylist()
        one, two = ([r for r, b in zip(rows, blocks) if b == x] for x in (i, j))
        links = joining_links(one, two, percent) if one and two else []
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return cut(rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long"))


#: A node with more links than this is heavy: its links meet its least neighbour by broadcast or in SALTS parts.
HEAVY, SALTS = 500, 64


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (u, v) with m of least (u, m, n). The links of a heavy u are never one task's."""
    heavy = cut(least.where(F.col("n") > HEAVY).select(F.col("u").alias("_u"), F.col("m").alias("_m")))
    count = heavy.limit(BROADCAST_KEYS + 1).count()
    if not count:
        return rows.join(least.select("u", "m"), "u")
    if count <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(heavy), F.col("u") == F.col("_u"), "left")
    else:
        parts = heavy.select("_u", "_m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        marked = salted.join(parts, (F.col("u") == F.col("_u")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")
    light = marked.where("_m is null").select("u", "v").join(least.where(F.col("n") <= HEAVY).select("u", "m"), "u")
    return marked.where("_m is not null").select("u", "v", F.col("_m").alias("m")).unionByName(light)


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node of the edges (a, b), the smallest node it is connected with."""
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.union(links.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = cut(_with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = _with_least(large, least)
        links = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .union(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(links.select("v", "v").distinct())


def _labelled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their shingle sets' digests, the classes of equal sets (cid), and the labels (node, comp) of linked classes."""
    ship_package(docs.sparkSession)
    rows = cut(_signed(docs, width))
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = classes.select("digest", F.col("one.doc_id").alias("min_id"), F.col("one.text_md5").alias("min_md5"), "n_shingles", "bands", "sketch")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    bands = classes.select("cid", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(bands.join(buckets, "bucket"))
    meets = held.groupBy("cid").agg(F.sum("n").alias("meets"))
    centres = held.join(meets, "cid").groupBy("bucket").agg(F.max_by("cid", "meets").alias("centre"))
    stars = cut(held.join(centres, "bucket").where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct())
    sets_of = lambda cids: _full_sets(docs, classes, cids, width)
    likely = cut(_likely(stars, classes, percent))
    links = _confirmed(likely, sets_of(likely.select(F.explode(F.array("a", "b")).alias("cid"))), percent)
    labels = connected(links)
    more = _family_links(stars, labels, classes, sets_of, percent)
    if more.limit(1).count():
        labels = connected(labels.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(more))
    return rows, classes, cut(labels)


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, text_md5, n_shingles, component_id, kept (it is the component's first)."""
    rows, classes, labels = _labelled(docs, width, percent)
    named = labels.join(classes.select(F.col("cid").alias("node"), "min_id", "digest"), "node")
    first = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    linked = by_broadcast_if_small(named.join(first, "comp").select("digest", "component_id"))
    alone = classes.select("digest", "min_id")
    slim = rows.select("doc_id", "text_md5", "digest", "n_shingles")
    out = slim.join(alone, "digest", "left").join(linked, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "min_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_md5", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component, all columns as they are: the one of the smallest doc_id (a row
    without one comes last), then of the smallest text digest. Rows without words stay, each of them.

    Components are told by their classes, not by ids, so shared and null ids change nothing. Only rows to drop and
    rows that occur more than once are told from the others by id and digest; the rest pass without a shuffle.
    """
    rows, classes, labels = _labelled(docs, width, percent)
    node = labels.join(classes.select(F.col("cid").alias("node"), "digest"), "node").select("digest", "comp")
    worded = rows.where("n_shingles > 0").select("doc_id", "text_md5", "digest").groupBy("doc_id", "text_md5", "digest").agg(F.count("*").alias("n"))
    own = classes.select("digest", "cid")
    judged = worded.join(own, "digest").join(by_broadcast_if_small(node), "digest", "left").select(
        "doc_id", "text_md5", "n", F.coalesce("comp", "cid").alias("comp"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5").alias("order"))
    judged = cut(judged)
    winner = judged.groupBy("comp").agg(F.min("order").alias("best"), F.count("*").alias("held"))
    # components of one row have nothing to drop
    several = judged.join(winner.where("held > 1"), "comp")
    drop = by_broadcast_if_small(several.where("order <> best").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")))
    key = lambda: F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_md5").eqNullSafe(F.col("_md5"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))
    packed = packed.join(drop, key(), "left_anti")
    twice = judged.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).join(
        drop.select(F.col("_id").alias("_i"), F.col("_md5").alias("_m")), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_md5").eqNullSafe(F.col("_m")), "left_anti")
    twice = by_broadcast_if_small(twice)
    if not twice.limit(1).count():
        return packed.select("_row.*")
    once = packed.join(twice, key(), "left_anti").select("_row")
    many = packed.join(twice, key(), "left_semi").groupBy("doc_id", "text_md5").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return once.unionByName(many).select("_row.*")


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(2, len(words)) - 1], ' ') AS sh
  FROM w, unnest(generate_series(1, greatest(1, len(words) - 1))) AS t(i) WHERE len(words) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
freq AS (SELECT sh, count(*) AS f FROM s GROUP BY sh),
ranked AS (SELECT s.doc_id, s.sh, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.sh) AS r
           FROM s JOIN freq USING (sh) JOIN size USING (doc_id)),
prefix AS (SELECT doc_id, sh, n FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
         FROM prefix a JOIN prefix b ON a.sh = b.sh AND a.doc_id < b.doc_id
         WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.sh = a.sh
         GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
sym AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM sym UNION SELECT r.x, e.y FROM reach r JOIN sym e ON r.y = e.x),
comp AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN comp ON comp.x = w.doc_id
"""
