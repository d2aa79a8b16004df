"""Exact Jaccard join of documents over word n-grams: size-aware, heavy and light.

Each document is the set of its distinct word n-grams, as 64-bit hashes. Documents with equal sets are
one class. Two classes link when ``den`` * intersection >= ``num`` * union.

Light sets: for every partner size the overlap that a link needs is a number c; all subsets of size c
are enumerated (as a sum of hashes less those left out). Sets that share one link for certain.

Heavy sets: inverted lists, scanned for candidates. Hash space is cut into parts, the same for all sets
of a size class, and the n-grams of a set within a part make one key. A difference spoils one part of a
set, and a pair that links has D differences at most, so D of a set's keys at most are not in the other
set. Under any order of all keys, then, the first D + 1 keys of both sets have one in common. Keys are
ordered by how many sets have them, the rarest first: a set with more than D keys of its own can link
with nothing, and phrases that many documents share come last. Lists hold what is left of the first
D + 1 keys.

How often a key occurs is counted on packed columns: a task sorts the keys of its sets, settles those
that repeat within it, and deals the others by hash; whoever gets them reports only keys and sets
where a key repeats. A key costs about eight bytes in the shuffle, and a key of very many sets once per
packed chunk.

The boundary: the largest size up to which enumerating costs no more rows than lists would, a list row
counting ``LIST_COST`` rows for what it takes to test its candidates.

A list isn't turned into all its pairs. Its members are tested against one leader, first the one with
the fewest keys of its own, which stands in the middle of a group of near copies, then one by chance;
components of the links found are built; then only members outside a list's main component are
compared with members of other components. Pairs within a component need no test: the result are
components, and they are exact.

Sketches rule pairs out before they leave the join: 1536 bits, each the parity of how many elements of
a set fall on it. Bits that differ between two sketches are at most the elements that differ between
the sets, and for sets of up to some hundred elements hardly fewer, so nearly all pairs that are
emitted link.

Defined cases: a null text, and one without words, has an empty set and links with nothing; with fewer
than n words the whole sequence is the one n-gram; rows that repeat an id or a text are members of
their class; a null id is kept and is smallest of nothing; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, current_scratch, free_names, parallelism, with_salts

#: Rows of light keys that one row of a list is worth.
LIST_COST = 6
#: Numbers of 64 bits in the sketch of a set.
SIGNS = 24
SIGN_COLUMNS = [f"s{i}" for i in range(SIGNS)]
#: Keys and sets of a packed chunk; a set's place in it has 16 bits.
CHUNK_KEYS, CHUNK_SETS = 700_000, 60_000
#: Leaders are tried, in so many rounds at most, while comparing members outside the main components with all others
#: would take more comparisons than so many for each row of a list.
LEADER_ROUNDS, COMPARISONS = 6, 256

_RANDOM = np.random.default_rng(20240202)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD
    return h ^ (h >> np.uint64(29))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, a run without ASCII white space; A-Z are lower-cased."""
    if not data:
        return np.zeros(0, np.uint64)
    text = _LOWER[np.frombuffer(data, np.uint8)]
    space = np.concatenate([[True], _SPACE[text], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * _power(_BASE, len(text)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(text) + 1)[start] + (end - start).astype(np.uint64))


def shingles(data: bytes, n: int) -> np.ndarray:
    """The distinct n-grams of words as sorted hashes."""
    words = word_hashes(data)
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each bit of SIGNS numbers the parity of how many elements fall on it.

    Elements in which two sets differ are at least as many as bits in which their sketches do.
    """
    bits = np.bincount((mix(hashes + _ODD) % np.uint64(64 * SIGNS)).astype(np.int64), minlength=64 * SIGNS).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


class Plan:
    """Sizes, classes and keys for one threshold num / den."""

    def __init__(self, num: int, den: int, list_cost: int = LIST_COST) -> None:
        self.num, self.den = num, den
        self._differences: dict[int, int] = {}
        self.light = 0
        while self.light < 64 and self.light_rows(self.light + 1) <= list_cost * (self.differences(self.light + 1) + 1):
            self.light += 1

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets with these sizes: den * i >= num * (a + b - i)."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        """Sizes that a set of size n can link with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def light_rows(self, n: int) -> int:
        return sum(comb(n, self.overlap(n, m)) for m in self.partners(n) if m <= n or m <= self.light)

    def differences(self, n: int) -> int:
        """The most elements in which a set of size n and one that it links with differ."""
        if n not in self._differences:
            both = n + np.arange(self.partners(n)[0], self.partners(n)[-1] + 1)
            self._differences[n] = int((both + 2 * (-self.num * both // (self.num + self.den))).max())
        return self._differences[n]

    def classes(self, n: int) -> list[int]:
        """Size classes [2^c, 2^(c+1)) of a set and of the larger sets that it can link with."""
        low = n.bit_length() - 1
        high = (self.den * n // self.num).bit_length() - 1
        return list(range(low, high + 1))

    def list_keys(self, hashes: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """For each size class: its number, a set's keys in it, and how many of the rarest count."""
        n = len(hashes)
        if self.den * n // self.num <= self.light:
            return []
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes + _ODD), out=sums[1:])
        need = self.differences(n) + 1
        out = []
        for c in self.classes(n):
            # Parts: half as many again as the largest set of the class needs.
            parts = 4 + 3 * (self.differences((2 << c) - 1) + 1) // 2
            cuts = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
            edge = np.concatenate([[0], np.searchsorted(hashes, cuts), [n]])
            full = np.flatnonzero(edge[1:] > edge[:-1])
            tag = np.uint64(((c << 32) + 1) * int(_ODD) & _MASK)
            key = mix(mix(sums[edge[full + 1]] - sums[edge[full]]) + tag + full.astype(np.uint64))
            if len(full) < need:
                # So few parts hold anything that two such sets might only agree on empty ones.
                key = np.append(key, mix(np.array([(c << 40) + 5], np.uint64)))
            out.append((c, key, min(need, len(key))))
        return out

    def light_keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of 128 bits, in two halves, so that no two subsets of a corpus agree by chance."""
        if len(hashes) > self.light:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, same = self._subset_keys(hashes, int(_ODD))
        second, _ = self._subset_keys(hashes, _BASE)
        # The last bit of the first half tells keys for sets of one size from those for two sizes.
        return (first & np.uint64(_MASK - 1) | same).view(np.int64), second.view(np.int64)

    def _subset_keys(self, hashes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(hashes)
        own = [int(x) for x in mix(hashes + np.uint64(seed))]
        total, out, same = sum(own), [], []
        for m in self.partners(n):
            if m <= self.light:
                c = self.overlap(n, m)
                tag = (min(n, m) << 20) + max(n, m) + (c << 40)
                new = [((total - sum(left)) * 2 + 1) * (2 * tag + 1) & _MASK for left in combinations(own, n - c)]
                out += new
                same += [m == n] * len(new)
        return mix(np.array(out, np.uint64)), np.array(same, np.uint64)


def unit(sid: int, c: int) -> int:
    """An id for a set within a size class."""
    return ((sid ^ (c + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 + c) & _MASK


def split_key(keys: np.ndarray, deals: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a key is dealt, and the 40 bits that tell it from others there. Keys that agree in both
    count as one, which makes candidates more, never fewer."""
    return (keys >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32), keys & np.uint64((1 << 40) - 1)


def whole_key(keys: np.ndarray, deals: int) -> np.ndarray:
    at, rest = split_key(keys, deals)
    return (at << np.uint64(40) | rest).view(np.int64)


PACKED = "p int, high binary, low binary, owner binary, units binary, again_high binary, again_low binary, again_n binary, known_units binary, known_n binary"


def pack_keys(keys: np.ndarray, units: np.ndarray, deals: int) -> pa.RecordBatch:
    """One row for each deal of the keys of a chunk of sets; PACKED says with what.

    Keys of one set are packed with it (high and low bits, place of the set in units). Keys of several
    sets are packed once, with their number, and their sets' counts are known here.
    """
    at, rest = split_key(keys, deals)
    order = np.lexsort((units, rest, at))
    at, rest, units = at[order], rest[order], units[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (rest[1:] != rest[:-1])
    once = fresh.copy()
    once[1:] |= units[1:] != units[:-1]
    at, rest, units, fresh = at[once], rest[once], units[once], fresh[once]
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    alone = np.repeat(count == 1, count)
    known, known_n = np.unique(units[~alone], return_counts=True)
    known_at = known % np.uint64(deals)
    known_order = np.argsort(known_at, kind="stable")
    known, known_n, known_at = known[known_order], known_n[known_order], known_at[known_order]
    s_at, s_rest, s_units = at[alone], rest[alone], units[alone]
    a_at, a_rest, a_n = at[first[count > 1]], rest[first[count > 1]], count[count > 1]
    steps = np.arange(deals + 1, dtype=np.uint64)
    s_edge, a_edge, k_edge = (np.searchsorted(x, steps) for x in (s_at, a_at, known_at))
    rows: dict[str, list] = {f.split()[0]: [] for f in PACKED.split(", ")}
    for p in range(deals):
        s, a, k = (slice(e[p], e[p + 1]) for e in (s_edge, a_edge, k_edge))
        if s.start == s.stop and a.start == a.stop and k.start == k.stop:
            continue
        own, owner = np.unique(s_units[s], return_inverse=True)
        values = (p, (s_rest[s] >> np.uint64(8)).astype(np.uint32), s_rest[s].astype(np.uint8), owner.astype(np.uint16), own, (a_rest[a] >> np.uint64(8)).astype(np.uint32), a_rest[a].astype(np.uint8), a_n[a].astype(np.uint32), known[k], known_n[k].astype(np.uint32))
        for name, v in zip(rows, values, strict=True):
            rows[name].append(v if name == "p" else v.tobytes())
    return pa.record_batch([pa.array(v, pa.int32() if n == "p" else pa.binary()) for n, v in rows.items()], list(rows))


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a set's unit and how many of its keys other sets have too; kind 1: such a key and its count.

    Rows come in order of their deal, and no key is in two of them: one is held at a time.
    """
    known: list[np.ndarray] = []
    known_n: list[np.ndarray] = []
    held: list[dict] = []

    def settle() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        shared, units, counts = shared_of(held)
        known.append(units)
        known_n.append(counts)
        if shared.num_rows:
            yield shared
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            row["p"] = row["p"].as_py()
            if held and held[0]["p"] != row["p"]:
                yield from settle()
            held.append({k: v if k == "p" else v.as_py() for k, v in row.items()})
    yield from settle()
    if known:
        units, at = np.unique(np.concatenate(known), return_inverse=True)
        if len(units):
            yield pa.record_batch([pa.array(np.zeros(len(units), np.int32)), pa.array(units.view(np.int64)), pa.array(np.bincount(at, weights=np.concatenate(known_n)).astype(np.int64))], ["kind", "id", "n"])


def shared_of(rows: list[dict]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Of the packages of one deal the keys of several sets with their numbers, and units with how many of these they have."""
    key, own, n, known, known_n = [], [], [], [], []
    base = np.uint64(rows[0]["p"] << 40)
    for row in rows:
        for high, low, many in (("high", "low", False), ("again_high", "again_low", True)):
            k = np.frombuffer(row[high], np.uint32).astype(np.uint64)
            k <<= np.uint64(8)
            k |= np.frombuffer(row[low], np.uint8)
            k |= base
            key.append(k)
            own.append(np.zeros(len(k), np.uint64) if many else np.frombuffer(row["units"], np.uint64)[np.frombuffer(row["owner"], np.uint16)])
            n.append(np.frombuffer(row["again_n"], np.uint32) if many else np.ones(len(k), np.uint32))
        known.append(np.frombuffer(row["known_units"], np.uint64))
        known_n.append(np.frombuffer(row["known_n"], np.uint32))
    key, own, n, known, known_n = (np.concatenate(x) for x in (key, own, n, known, known_n))
    order = np.lexsort((own, key))
    key, own, n = key[order], own[order], n[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    once = fresh.copy()
    once[1:] |= own[1:] != own[:-1]
    first = np.flatnonzero(fresh)
    ids = counts = np.zeros(0, np.int64)
    if len(first):
        sets = np.add.reduceat(once.astype(np.int64), first)
        total = np.add.reduceat(n.astype(np.int64), first)
        many = (sets > 1) | (total > np.add.reduceat((own != 0).astype(np.int64), first))
        ids, counts = key[first[many]].view(np.int64), total[many]
        mine = own[np.repeat(many, np.diff(np.append(first, len(key)))) & once & (own != 0)]
        known, known_n = np.concatenate([known, mine]), np.concatenate([known_n.astype(np.int64), np.ones(len(mine), np.int64)])
    units, at = np.unique(known, return_inverse=True)
    return pa.record_batch([pa.array(np.ones(len(ids), np.int32)), pa.array(ids), pa.array(counts)], ["kind", "id", "n"]), units, np.bincount(at, weights=known_n, minlength=len(units)).astype(np.int64)


def set_ids(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """An id for a set, 0 for the empty one, and 64 more bits that tell whether two sets share an id."""
    if not len(hashes):
        return 0, 0
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=bytes([seed])).digest()
    return int.from_bytes(digest[:8], "little") >> 1 or 1, int.from_bytes(digest[8:], "little", signed=True)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node, comp: the smallest node of its component, for the nodes of links (a, b).

    Large-star and small-star steps in turn until nothing changes; each step is one grouping and one
    join, and what it makes is written, so no plan grows.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before, most = now, 2 * now.n  # a step makes no more edges than both directions of those there are
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), most)
        large = scratch.write(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), most)
        scratch.drop(least, edges)
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), most)
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), most)
        scratch.drop(least, large)


class JaccardJoin:
    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, list_cost: int = LIST_COST) -> None:
        self.plan, self.n = Plan(num, den, list_cost), n
        self.scratch = current_scratch(docs.sparkSession)
        #: Keys are dealt in so many packages; several go to a task, so tasks get about as many.
        self.deals = min(8 * parallelism(docs), 1 << 22)
        self.kind = docs.schema[id_col].dataType.simpleString()
        texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
        self.texts = texts.withColumn("rk", F.xxhash64("doc_id", F.sha2("data", 256)))

    def sets(self, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, sid, n_shingles), and one row for each set with its keys."""
        plan, n = self.plan, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "data"):
                sid, more, size, light, light2 = [], [], [], [], []
                for data in batch.column("data"):
                    hashes = shingles(data.as_buffer(), n)
                    own, rest = set_ids(hashes, seed)
                    sid.append(own)
                    more.append(rest)
                    size.append(len(hashes))
                    for half, keys in zip((light, light2), plan.light_keys(hashes), strict=True):
                        half.append(keys)
                column = lambda keys: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("rk"), pa.array(sid, pa.int64()), pa.array(more, pa.int64()), pa.array(size, pa.int64()), column(light), column(light2)], ["doc_id", "rk", "sid", "more", "n", "light", "light2"])

        self.seed = seed
        self.made = made = self.scratch.write(self.texts.mapInArrow(run, f"doc_id {self.kind}, rk long, sid long, more long, n long, light array<long>, light2 array<long>"))
        once = made.filter("n > 0").groupBy("sid").agg(
            F.min("rk").alias("rk"), F.min("n").alias("n"), F.min("more").alias("more"), F.max("more").alias("more2"), F.first("light").alias("light"), F.first("light2").alias("light2")
        )
        once = self.scratch.write(once)
        if once.filter("more <> more2").limit(1).count():
            return self.sets(seed + 1)  # different sets got one id; other ids then
        return made.select("doc_id", "sid", F.col("n").alias("n_shingles")), once

    def shared_keys(self) -> tuple[DataFrame, DataFrame]:
        """(unit, n_shared) of sets with keys that others have too, and (key, n_sets) of those keys."""
        plan, n, seed = self.plan, self.n, self.seed
        deals = self.deals

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: list[np.ndarray] = []
            units: list[int] = []
            size = 0
            for batch in by_bytes(batches, "data"):
                for data in batch.column("data"):
                    hashes = shingles(data.as_buffer(), n)
                    sid = set_ids(hashes, seed)[0]
                    for c, own, _ in plan.list_keys(hashes):
                        keys.append(own)
                        units.append(unit(sid, c))
                        size += len(own)
                    if size >= CHUNK_KEYS or len(units) >= CHUNK_SETS:
                        yield pack_keys(np.concatenate(keys), np.repeat(np.array(units, np.uint64), list(map(len, keys))), deals)
                        keys, units, size = [], [], 0
            if units:
                yield pack_keys(np.concatenate(keys), np.repeat(np.array(units, np.uint64), list(map(len, keys))), deals)

        packed = self.texts.select("data").mapInArrow(run, PACKED)
        found = packed.repartition(parallelism(self.texts), "p").sortWithinPartitions("p").mapInArrow(count_keys, "kind int, id long, n long")
        found = self.scratch.write(found)
        units = found.filter("kind = 0").groupBy(F.col("id").alias("unit")).agg(F.sum("n").alias("n_shared"))
        return units, found.filter("kind = 1").select(F.col("id").alias("key"), F.col("n").alias("n_sets"))

    def lists(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The inverted lists (key, sid, n) of at least two sets, and the contents of the sets in them."""
        plan, n, deals = self.plan, self.n, self.deals
        units, keys = self.shared_keys()

        def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of every set of a size its units, for sizes only: no text is needed."""
            for batch in batches:
                out = [(s, m, unit(s, c)) for s, m in zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), strict=True) if plan.den * m // plan.num > plan.light for c in plan.classes(m)]
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array(np.array([x[2] for x in out], np.uint64).view(np.int64))], ["sid", "unit"])

        of = sets.select("sid", "n").mapInArrow(spare, "sid long, unit long")
        open_units = self.scratch.write(of.join(units.hint("merge"), "unit").groupBy("sid").agg(F.collect_list(F.struct("unit", "n_shared")).alias("open")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sets that have fewer keys of their own than rule out all links."""
            for batch in by_bytes(batches, "data"):
                rows = []
                for sid, data, known in zip(batch.column("sid").to_pylist(), batch.column("data"), batch.column("open").to_pylist(), strict=True):
                    hashes = shingles(data.as_buffer(), n)
                    shared = {x["unit"] & _MASK: x["n_shared"] for x in known}
                    takes = []
                    for c, own, need in plan.list_keys(hashes):
                        # Keys that agree in what is kept of them count as one, here as in the lists.
                        n_keys = len(np.unique(whole_key(own, deals)))
                        alone = n_keys - min(n_keys, shared.get(unit(sid, c), 0))
                        if need > alone:
                            takes.append({"c": c, "take": need - alone, "alone": alone})
                    if takes:
                        rows.append((sid, hashes.tobytes(), takes))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("c", pa.int32()), ("take", pa.int64()), ("alone", pa.int64())])))], ["sid", "set", "takes"])

        chosen = open_units.join(sets.select("sid", "rk").hint("merge"), "sid")
        found = self.texts.select("rk", "data").join(chosen.hint("merge"), "rk").select("sid", "data", "open").mapInArrow(run, "sid long, set binary, takes array<struct<c:int,take:long,alone:long>>")
        active = self.scratch.write(found.groupBy("sid").agg(F.first("set").alias("set"), F.first("takes").alias("takes")))

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "set", 1 << 20):
                out: dict[str, list] = {"key": [], "sid": [], "c": [], "take": [], "alone": []}
                for sid, data, takes in zip(batch.column("sid").to_pylist(), batch.column("set"), batch.column("takes").to_pylist(), strict=True):
                    hashes = np.frombuffer(data.as_buffer(), np.uint64)
                    wanted = {x["c"]: x for x in takes}
                    for c, own, _ in plan.list_keys(hashes):
                        if c in wanted:
                            own = np.unique(whole_key(own, deals))
                            for name, v in (("key", own), ("sid", np.full(len(own), sid)), ("c", np.full(len(own), c)), ("take", np.full(len(own), wanted[c]["take"])), ("alone", np.full(len(own), wanted[c]["alone"]))):
                                out[name].append(v)
                yield pa.record_batch([pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in out.values()], list(out))

        rows = active.mapInArrow(explode, "key long, sid long, c long, take long, alone long")
        order = Window.partitionBy("sid", "c").orderBy("n_sets", "key")
        rows = rows.join(keys.hint("merge"), "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("take"))
        rows = self.scratch.write(rows.select("key", "sid", "alone"))
        self.listed = rows.count()
        two = self.scratch.write(rows.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).filter("a < z").select("key"), self.listed)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "set", 1 << 20):
                held = [np.frombuffer(data.as_buffer(), np.uint64) for data in batch.column("set")]
                signs = np.stack([sketch(x) for x in held]) if held else np.zeros((0, SIGNS), np.int64)
                yield pa.record_batch([batch.column("sid"), pa.array(list(map(len, held)), pa.int64()), *(pa.array(x) for x in np.ascontiguousarray(signs.T))], ["sid", "n", *SIGN_COLUMNS])

        signed = active.select("sid", "set").mapInArrow(sign, "sid long, n long, " + ", ".join(f"{x} long" for x in SIGN_COLUMNS))
        lists = self.scratch.write(rows.join(two.hint("merge"), "key").join(signed.hint("merge"), "sid").select("key", "sid", "n", "alone", *SIGN_COLUMNS), self.listed)
        self.scratch.drop(rows, two)
        return lists, active.select("sid", "set")

    def test(self, pairs: DataFrame, contents: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        num, den = self.plan.num, self.plan.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(den * common >= num * (len(both) - common))
                keep = pa.array(keep, pa.bool_())
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

        held = pairs.join(contents.select(F.col("sid").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
        held = held.join(contents.select(F.col("sid").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
        return self.scratch.write(held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))

    def likely(self, other: str):
        """Whether the sets of a row, with columns (n, s0 ...) and those with a prefix, may link."""
        num, den, n = self.plan.num, self.plan.den, f"{other}n"
        sizes = f"{den} * least(n, {n}) >= {num} * greatest(n, {n})"
        differ = " + ".join(f"bit_count({x} ^ {other}{x})" for x in SIGN_COLUMNS)
        most = f"n + {n} - 2 * (({num} * (n + {n}) + {num + den - 1}) div {num + den})"
        return F.expr(f"{sizes} AND {differ} <= {most}")

    def links(self, sets: DataFrame) -> DataFrame:
        """Links (a, b) between sets that make up all components."""
        scratch = self.scratch
        light = sets.select("sid", "n", F.explode(F.arrays_zip("light", "light2")).alias("k")).select("sid", "n", F.col("k.light").alias("key"), F.col("k.light2").alias("key2"))
        first = light.groupBy("key", "key2").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min_by("sid", F.struct("n", "sid")).alias("a"), F.min_by("sid", F.struct(-F.col("n"), "sid")).alias("b"), F.max("sid").alias("z"))
        # Sets of one size that share a key for two sizes don't link by it, each links with the other size.
        first = scratch.write(first.filter("(key & 1 = 1 AND a < z) OR low < high"))
        other = F.when(F.col("n") == F.col("high"), F.col("a")).otherwise(F.col("b"))
        found = light.join(first.hint("merge"), ["key", "key2"]).select("sid", other.alias("other")).filter("sid <> other")
        links = scratch.write(found.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct())

        lists, contents = self.lists(sets)
        tested, turn, last = None, 0, False
        while not last:
            if turn:
                comp = components(scratch, links).withColumnRenamed("node", "sid").hint("merge")
                now = lists.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
                now = scratch.write(now, self.listed)
                # The main component: the one with the most members.
                sizes = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("l"))
                main = scratch.write(sizes.filter("c > 1").select("key", F.col("l.comp").alias("l_comp"), (F.col("all") * (F.col("all") - F.col("l.m"))).cast("double").alias("cost")), self.listed)
                last = turn == LEADER_ROUNDS or (main.agg(F.sum("cost")).first()[0] or 0) <= COMPARISONS * self.listed
            else:
                now = scratch.write(lists.withColumn("comp", F.col("sid")), self.listed)
            if not last:
                # The leader: the member with the fewest keys of its own, then the least by a hash, so that lists with the same members agree.
                first = [F.xxhash64("sid", F.lit(turn))] if turn else [F.col("alone"), F.xxhash64("sid")]
                lead = now.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("z"), F.min(F.struct(*first, "sid", "comp", "n", *SIGN_COLUMNS)).alias("l")).filter("c <> z")
                lead = lead.select("key", F.col("l.sid").alias("l_sid"), F.col("l.comp").alias("l_comp"), *(F.col(f"l.{x}").alias(f"l_{x}") for x in ("n", *SIGN_COLUMNS)))
                open_lists = now.join(scratch.write(lead, self.listed).hint("merge"), "key").filter("comp <> l_comp")
                pairs = open_lists.filter(self.likely("l_")).select(F.least("sid", "l_sid").alias("a"), F.greatest("sid", "l_sid").alias("b"))
            else:
                open_lists = now.join(main.select("key", "l_comp").hint("merge"), "key").filter("comp <> l_comp")
                outside = scratch.write(open_lists.select("key", F.col("sid").alias("o_sid"), F.col("comp").alias("o_comp"), *(F.col(x).alias(f"o_{x}") for x in ("n", *SIGN_COLUMNS))), self.listed)
                pairs = now.join(outside.hint("merge"), "key").filter("comp <> o_comp").filter(self.likely("o_")).select(F.least("sid", "o_sid").alias("a"), F.greatest("sid", "o_sid").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
            # What a list gives is tested once a pair; lists of a few sets give about as many pairs as sets.
            pairs = scratch.write(pairs, 4 * self.listed)
            links = scratch.write(links.unionByName(self.test(pairs, contents)), 4 * self.listed)
            tested = pairs if tested is None else tested.unionByName(pairs)
            turn += 1
        return links

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, n_links: a row for each row of the input."""
        rows, sets = self.sets()
        links = self.links(sets)
        comp = components(self.scratch, links)
        known = rows.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        known = known.join(comp.hint("merge"), known.sid == comp.node, "left").select("sid", "least", "copies", F.coalesce("comp", "sid").alias("comp"))
        known = self.scratch.write(known)
        least = known.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
        named = self.scratch.write(known.join(least.select("comp", "component_id").hint("merge"), "comp").select("sid", "component_id", "copies"))
        # Nothing but the rows and the classes' names is read from now on.
        self.scratch.drop_others(self.made, named)
        # A class may hold a third of all rows.
        salted, spread = with_salts(rows, named, ["sid"], "copies", rows.count())
        return salted.join(spread, ["sid", "__salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", list_cost: int = LIST_COST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    n: words of an n-gram; num / den: the least Jaccard similarity of a link.
    """
    return JaccardJoin(docs, n, num, den, id_col, text_col, list_cost).run()


def without_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component.

    Rows that share an id stay or go together.
    """
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    (own,) = free_names(docs, "id")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own))
    return docs.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
