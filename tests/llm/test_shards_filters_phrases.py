"""Sharding, the audit of filters and collocations against plain versions, and on awkward tables."""

import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadtide.llm import filter_audit, phrases, queries, sharding

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None, "en", "s"), (2, "", "en", None), (3, "one", None, "s"), (3, "one", None, "s"), (4, "ONE two\tthree", "de", "t"), (None, "no id at all", "en", "t"), (None, "one", "en", "t"), (5, "é漢字 $x", "fr", "s"), (6, "ab " * 30_000, "en", "s")]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("h", "n", "part", "size", "bucket", "_place", "phrase", "f", "fails", "words", "low")})


def laid_out(rows, shards):
    """Whether slots are gapless in every shard and their numbers differ by one at most."""
    counts = Counter(r.shard for r in rows)
    each = [counts.get(s, 0) for s in range(shards)]
    slots = sorted((r.shard, r.slot) for r in rows)
    return sum(each) == len(rows) and max(each) - min(each) <= 1 and slots == sorted((s, k) for s in range(shards) for k in range(each[s]))


def test_shards_hold_every_record_once(spark, awkward):
    for docs, shards in ((awkward, 4), (awkward, 40), (spark.read.parquet(f"{SF}/documents.parquet"), 40)):
        rows = sharding.shard_digests(docs, shards).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        assert laid_out(rows, shards) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_shards_follow_the_plain_shuffle(spark):
    """The order is that of buckets, each sorted by its records' hashes and shuffled with the seed and its number."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    seed, shards = 7, 9
    buckets = sharding.TURNS * 4
    low, high = F.xxhash64(F.lit(seed), "doc_id", "text"), F.xxhash64(F.lit(seed + 1), "doc_id", "text", F.lit("again"))
    keyed = docs.select("doc_id", low.alias("low"), high.alias("high")).withColumn("bucket", F.pmod(F.xxhash64("low", F.lit(0).cast("long")), F.lit(buckets))).collect()
    order = []
    for b in range(buckets):
        own = sorted((r.low, r.high, r.doc_id) for r in keyed if r.bucket == b)
        picks = np.random.Generator(np.random.PCG64([seed, b])).integers(0, np.arange(len(own), 0, -1))
        for i, j in zip(range(len(own) - 1, 0, -1), picks):
            own[i], own[j] = own[j], own[i]
        order += [x[2] for x in own]
    got = [r.doc_id for r in sorted(sharding.sharded(docs, shards, seed).collect(), key=lambda r: (r.shard, r.slot))]
    assert got == order
    assert sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 10


def test_shards_of_equal_records_and_of_none(spark, tmp_path):
    same = spark.range(4000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    path = str(tmp_path / "out")
    rows = sharding.sharded(same, 6, path=path).collect()
    assert laid_out(rows, 6) and sum(r.doc_id == 1 for r in rows) == 2500
    assert sorted(p.name for p in Path(path).glob("shard=*")) == [f"shard={i}" for i in range(6)]
    spread = sharding.in_buckets(same, 1, 16, 4000, "bucket", "place").groupBy("bucket").count()
    assert spread.agg(F.max("count")).first()[0] < 1000
    assert sharding.shard_digests(same.limit(0), 40).collect() == []
    with pytest.raises(ValueError, match="shard"):
        sharding.sharded(same.withColumn("Shard", F.lit(1)), 3)


def audited(docs, labels):
    """filter_audit of A to E on lists, document by document and order by order."""
    first = {}
    for i, text, _ in docs:
        text = text or ""
        if i is not None:
            first[text] = min(first.get(text, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A"} if len(w) < 200 else set()
        own |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        own |= {"E"} if (text in first if i is None else i > first[text]) else set()
        fails.append((part or "", own, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        shares = Counter()
        for order in itertools.permutations("ABCDE"):
            here = list(own)
            for k, x in enumerate(order):
                go = [f for f in here if x in f[1]]
                here = [f for f in here if x not in f[1]]
                shares[x] += len(go)
                bad = [f for f in own if x in f[1]]
                out[part, "".join(order), k + 1] = [len(here), len(go), len(bad) - len(go), sum(f[1] == {x} for f in own), sum(f[2] for f in go), sum(f[3] for f in go)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shares[order[k - 1]])
    return out


def run_audit(docs, labels, monkeypatch):
    monkeypatch.setattr(queries, "read", lambda spark, d, table: {"documents": docs, "labels": labels}[table])
    rows = queries.op12_filter_audit(docs.sparkSession, "").collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit_of_filters_is_the_plain_one(spark, monkeypatch, awkward):
    dice = random.Random(5)
    word = lambda: dice.choice(["abc", "x$", "The", "de", "fg", "HI"] + [f"w{dice.randrange(300)}"] * 4)
    made = [(i, " ".join(word() for _ in range(dice.choice([5, 150, 250]))), dice.choice(["a", "b", None])) for i in range(150)]
    made += [(150 + i, made[i % 7][1], "a") for i in range(120)] + [(None, made[0][1], "b"), (0, made[0][1], "a"), (900, None, "c"), (901, "", "c")]
    dice.shuffle(made)
    labels = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 270, 2)] + [(4, 1, 1), (None, 1, 1)]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert run_audit(docs, tags, monkeypatch) == audited(made, labels)
    assert run_audit(awkward, tags, monkeypatch) == audited([(r[0], r[1], r[3]) for r in AWKWARD], labels)
    assert run_audit(docs.limit(0), tags, monkeypatch) == {}


def test_audit_refuses_what_it_cannot_do(spark, awkward):
    with pytest.raises(ValueError, match="up to 8"):
        filter_audit.filter_audit(awkward, awkward, {x: lambda t, w: t == "" for x in "ABCDEFGH"}, "I")


def mined(docs, least, top):
    """collocations() on lists."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k, left, right = min(((2_000_000 * a) // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang, p] = (score, a, left, right)
    gone = {(lang, p[i : i + m]) for (lang, p) in found for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * found[lang, p][1] >= 80 * found[lang, p[i : i + m]][1]}
    rows = []
    for lang in {x for x, _ in found}:
        own = sorted((-v[0], -v[1], " ".join(p).encode(), v) for (x, p), v in found.items() if x == lang and (x, p) not in gone)
        rows += [(lang, i + 1, p.decode(), v[1], v[2], v[3], n[lang], v[0]) for i, (_, _, p, v) in enumerate(own[:top])]
    return rows


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_collocations_are_the_plain_ones(spark, shard_bytes):
    dice = random.Random(3)
    vocabulary = ["a", "B", "b", "new", "York", "city", "the", "é", "漢字", "x\x1c", "﻿z", "|"]
    made = []
    for i in range(300):
        words = [dice.choice(vocabulary) for _ in range(dice.randrange(40))] + ["new", "York", "city"] * dice.randrange(3) + ["b"] * dice.randrange(6)
        made.append((dice.choice(["en", "de", None, "und", ""]), "".join(w + dice.choice([" ", " ", "  ", "\t", ", ", "\r\n", " ", "\x0b"]) for w in words)))
    made += [(None, None), ("en", ""), ("en", " .. \n")] + [made[0]] * 20
    docs = spark.createDataFrame(made, "lang string, text string").repartition(5).withColumns({"phrase": F.lit(1), "f": F.lit(2), "size": F.lit(3)})
    rows = phrases.collocations(docs, least=8, top=60, shard_bytes=shard_bytes).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)
    assert got == sorted(mined(made, 8, 60)) and len(got) > 100


def test_collocations_of_awkward_tables(spark, awkward):
    got = phrases.collocations(awkward, least=2).collect()
    assert sorted(tuple(r) for r in got) == sorted(mined([(r[2], r[1]) for r in AWKWARD], 2, 2000))
    assert phrases.collocations(awkward.limit(0), least=2).collect() == []


def test_intervals_of_a_suffix_array():
    ids = np.array([0, 1, 2, 1, 2, 3, 0, 1, 2, 3, 0])
    known = ids > 0
    reach = np.where(known, phrases.reaches(np.append(known[:-1] & known[1:], False), 4), 0)
    found = {(tuple(ids[p : p + n].tolist()), int(c)) for n, places, counts in phrases.intervals(ids, reach, (1, 2, 3, 4)) for p, c in zip(places, counts)}
    want = Counter(tuple(w[i : i + n]) for w in ([1, 2, 1, 2, 3], [1, 2, 3]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    assert found == set(want.items())
