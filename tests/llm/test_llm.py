"""The operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from leadtide.llm import bpe_tree, exact_dedup, html_text, jaccard_join, language_id, packing, suffix_dedup, token_counts, topk, warc

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None, "en"), (2, "", "en"), (3, "one", None), (3, "one", None), (4, "ONE two\tthree", "de"), (None, "no id at all", "en"), (5, "é漢字 <|endoftext|>   x", "fr"), (6, "ab " * 30_000, "en"), (7, "!!! 123", "en")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and further columns named like an operator's own."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "salt": F.lit(1), "h": F.lit("x"), "key": F.lit(2), "cls": F.lit(3), "id": F.lit(4), "length": F.lit(5)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<p>a<p>b  c\n d<br>e", "a\n\nb c d\ne"),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>after", "- x\n- y\n  - z\n- w\n\nafter"),
        ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>b<td>22</table>", "Name       N\nlong name  1\nb          22"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div><p hidden>x", "yes"),
        ("<style>.ad{display:none}</style><div class='x ad'>AD</div>ok", "ok"),
        ("<pre>\n a  b\n  c</pre><blockquote>q</blockquote>", " a  b\n  c\n\n> q"),
        ("1 < 2 &amp; 3 &lt; 4<!-- c --><script>var a='</p>'</script> z<b", "1 < 2 & 3 < 4 z"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<b><p>x</b>y</p>", "xy"),
        ("<p>a<b>b<i>c</b>d</i>e", "abcde"),
        ("<b hidden><p>x</b>y", "y"),
        ("<b><div><p>x</b>y<p>z", "xy\n\nz"),
        ("<a><table><tr><td>1</a>2<td>3</table>", "12  3"),
        ("<details>no<summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<input value=v><img alt=no>", "v"),
        ("", ""),
    ],
)
def test_page_text(page, shown):
    assert html_text.page_text(page) == shown


def test_page_text_keeps_all_visible_text(spark):
    """Against a plain parser of the standard library: the same words in the same order."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    rows = html_text.html_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        plain = Plain()
        plain.feed(pages[r.page_id])
        words = [w for w in r.text.split() if w != "-"]
        assert "".join(words) == "".join(w for w in "".join(plain.out).split() if w != "-")


def test_html_of_awkward_tables(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<b>x")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"id": F.lit(7), "text": F.lit("other")})
    found = sorted(((r.page_id or 0, r.text) for r in html_text.html_text(df).collect()))
    assert found == [(0, "x"), (1, ""), (2, ""), (3, "a"), (3, "a")]
    assert html_text.html_text(df.filter("false")).count() == 0


def test_queries_equal_their_sql(spark):
    from oracle import compare, duck

    from leadtide.llm import queries

    con = duck(SF)
    for name, statement in queries.ORACLE_SQL.items():
        assert compare(queries.QUERIES[name](spark, SF), con, statement) == "", name


def test_shared_folder(spark, tmp_path):
    from leadtide.llm import common

    top = common.shared_top(spark)
    assert "://" in top or top.startswith("file:/")
    scratch = common.Scratch(spark)
    kept, other = scratch.write(spark.range(3)), scratch.write(spark.range(4))
    scratch.drop_others(kept)
    assert kept.count() == 3 and len(scratch.own) == 1
    del other


def test_hot_keys_are_spread(spark):
    from leadtide.llm import common

    rows = spark.range(20_000).select(F.when(F.col("id") < 7000, 0).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").count()
    salted, spread = common.with_salts(rows, classes, ["k"], "count", 20_000)
    assert salted.filter("k = 0").groupBy("__salt").count().agg(F.max("count")).first()[0] <= 20_000 / 16 + 1
    assert salted.join(spread, ["k", "__salt"]).count() == 20_000 and spread.filter("k > 0").count() == 13_000


def test_warc_of_rows_without_ids(spark):
    rows = [(2, "b" * 100), (3, "b" * 100), (3, "b" * 100), (None, "b" * 100), (None, "c" * 100), (None, "c" * 100)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"url": F.lit("u"), "digest": F.lit("x"), "n": F.lit(1), "uri": F.lit(2), "__salt": F.lit(3)})
    found = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect())
    assert found == [(0, "response", None), (0, "response", None), (0, "revisit", 2), (2, "response", None), (3, "revisit", 2), (3, "revisit", 2)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, None, "a" * 200), (3, "u\r\nX: y", None), (4, "u", "é" * 60), (5, "u", "short"), (6, "u", "short")], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    assert found[2].record_type == "revisit" and found[2].refers_to == 1 and found[1].refers_to is None
    assert {found[i].record_type for i in (1, 3, 4, 5, 6)} == {"response"}
    for i, html in ((1, "a" * 200), (3, ""), (4, "é" * 60), (5, "short")):
        assert found[i].payload_bytes == len(html.encode()) and found[i].payload_digest == hashlib.sha256(html.encode()).hexdigest()
    member = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2000-01-01T00:00:00Z")
    with pytest.raises(warc.BadRecord):
        warc.parse(zlib.decompress(member, 31).replace(b"payload\r\n", b"Payload\r\n"))
    assert warc.warc_round_trip(pages.filter("false")).count() == 0


def test_language_on_held_out_rows(docs, awkward):
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.language_id(docs).filter("held_out").collect()
    right = [r.lang_pred == known[r.doc_id] for r in rows if known[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    found = language_id.language_id(awkward).collect()
    assert len(found) == len(AWKWARD)
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (1, 2, 7)} == {1: "und", 2: "und", 7: "und"}
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_id.known_language(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id IN (1, 2, 7)").count() == 0
    assert language_id.language_id(awkward.filter("false")).count() == 0


def test_language_against_plain_bayes(spark, monkeypatch):
    """The same n-grams counted and added up in plain Python, with pieces so short that texts are cut."""
    import math
    from collections import Counter

    monkeypatch.setattr(language_id, "PIECE", 7)
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcd" if i % 3 else "cdef") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))), "x" if i % 3 else "y") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    docs = df.collect()
    # A worker has its own copy of the module, so the functions are called here.
    counts = {"x": Counter(), "y": Counter()}
    n_docs = Counter()
    known = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5]
    plain = lambda t: [int(g) for n in (1, 2, 3) for s in range(len(t) - n + 1) for g in language_id.grams(t[s : s + n], (n,), 512)]
    for r in known:
        counts[r.lang].update(plain(r.text))
        n_docs[r.lang] += 1
        cut = [int(g) for piece, seen in language_id.pieces(r.text, (1, 2, 3)) for g in language_id.grams(piece, (1, 2, 3), 512, seen)]
        assert sorted(cut) == sorted(plain(r.text))
    want = {}
    for r in docs:
        sums = {x: math.log(n_docs[x] / len(known)) + sum(math.log(counts[x][g] + 0.5) - math.log(sum(counts[x].values()) + 256) for g in plain(r.text)) for x in "xy"}
        best = max(sums, key=lambda x: (sums[x], x == "x"))
        want[r.doc_id] = (best, 1 / sum(math.exp(v - sums[best]) for v in sums.values()))
    for r in language_id.language_id(df, buckets=512).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


def test_rare_languages_are_learned(spark):
    rows = [(i, "aaaa bbbb", "x") for i in range(3000)] + [(5000 + i, "zzzz yyyy", "rare") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.lang_pred for r in language_id.language_id(df, train_docs=50).filter("doc_id >= 5000").collect()}
    assert found == {"rare"}


def brute_components(rows, n, num, den):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50), (2, 70)])
def test_jaccard_against_brute_force(spark, n, num):
    rng = random.Random(n)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(4))
    rows = []
    for _ in range(50):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 12, 15, 20, 30, 60, 150]))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "A B c"), (904, "a b C"), (3, "an id that comes again and again")]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100)
    assert sorted(map(tuple, found.collect())) == brute_components(rows, n, num, 100)


def test_jaccard_on_documents_and_awkward_rows(docs, awkward):
    found = jaccard_join.jaccard_components(docs, 3, 90, 100)
    assert sorted(map(tuple, found.collect())) == brute_components(texts(docs), 3, 90, 100)
    rows = jaccard_join.jaccard_components(awkward).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 4), (None, 1, None), (5, 1, 5), (6, 1, 6), (7, 1, 7)]))
    assert jaccard_join.without_near_copies(awkward).columns == awkward.columns
    assert jaccard_join.jaccard_components(awkward.filter("false")).count() == 0


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Near copies of one text, some too far for a link, and a phrase in all others; few comparisons are allowed, so leaders take turns."""
    monkeypatch.setattr(jaccard_join, "COMPARISONS", 1)
    rng = random.Random(11)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.randrange(500)}"
    base, phrase = [word() for _ in range(90)], [word() for _ in range(12)]
    rows = []
    for i in range(300):
        own = list(base) if i % 3 else [word() for _ in range(60)] + phrase
        for _ in range(rng.randrange(1, 7) if i % 3 else 0):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute_components(rows, 5, 80, 100)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for n in (5, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 3 // 4], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        differ = int(sum(int(x).bit_count() for x in (jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64)))
        assert differ <= len(np.setxor1d(a, b)) and (n > 1000 or differ > 0.8 * len(np.setxor1d(a, b)))


def test_top_k_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(10_000, None), (10_100, [float("nan")] * 4), (10_200, [1.0, None, 2.0, 3.0]), (10_300, []), (10_400, [float("inf")] * 4)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, np.floor(1024 * np.array(r.embedding, np.float64)).astype(np.int64)) for r in df.collect()]
    want = set()
    for q, x in rows:
        if q % 100 == 0:
            ranked = sorted((-int(x @ y), i) for i, y in rows if i != q)[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    found = topk.top_k(df.unionByName(odd), F.col("vec_id") % 100 == 0, 10)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()} == want
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_top_k_of_ties_repeats_and_several_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3 if i % 7 else 40)]) for i in range(400)]
    rows += [(5, rows[5][1]), (11, rows[3][1]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "dims": F.lit(1), "v": F.lit(2), "rank": F.lit(3), "score": F.lit(4), "query_id": F.lit(5)})
    want = []
    for q, x in {q: min(v for i, v in rows if i == q) for q, _ in rows if q is not None and q % 10 == 0}.items():
        ranked = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(x, y, strict=True)), i) for i, y in rows if i is not None and i != q and len(y) == len(x))[:6]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    for blocks in (2048, 7):
        found = topk.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, 6, block_queries=blocks)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(want)
    # A floor from earlier batches drops nothing that counts.
    data = np.array([[rng.randrange(-50, 50) for _ in range(48)] for _ in range(300)])
    for k in (1, 5):
        free = [list(zip(a.tolist(), b.tolist(), strict=True)) for _, a, b in topk.search(data[:20], np.arange(20), data, np.arange(300), k)]
        floors = np.array([x[-1][1] for x in free])
        assert free == [list(zip(a.tolist(), b.tolist(), strict=True)) for _, a, b in topk.search(data[:20], np.arange(20), data, np.arange(300), k, floors=floors)]


def test_packing_fills_sequences_without_gaps(docs, awkward):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, awkward):
        placed = {}
        for r in packing.best_fit_packing(df, path).collect():
            placed.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id, r.start, r.ids_crc32))
        ids = {}
        for d, text in texts(df):
            own = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
            for at in range(0, len(own), 4096):
                ids.setdefault((d, at), set()).add(zlib.crc32(np.array(own[at : at + 4096], "<u4").tobytes()))
        total = 0
        for parts in placed.values():
            at = 0
            for offset, length, d, start, crc in sorted(parts):
                assert offset == at and crc in ids[d, start]
                at += length
            assert at <= 4096
            total += at
        assert len(placed) <= total / 4096 * 1.05 + 2
    assert packing.best_fit_packing(docs.filter("false"), path).count() == 0


def test_best_two_fit_uses_every_document_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    patterns = packing.best_two_fit(counts, 100)
    used = np.zeros(101, int)
    for own, times in patterns:
        assert sum(own) <= 100
        np.add.at(used, own, times)
    assert (used == counts).all()


def test_best_two_fit_against_a_plain_one():
    """Bin by bin over a list of documents: greedily the longest that fits, then its smallest for the two that fit best."""
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.randrange(5, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80))]
        left, bins = sorted(sizes, reverse=True), []
        while left:
            own, gap = [], capacity
            for x in list(left):
                if x <= gap:
                    own.append(x)
                    left.remove(x)
                    gap -= x
            if gap and own:
                room = gap + own[-1]
                pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i)]
                best = max((p for p in pairs if p <= room), default=0)
                if best > own[-1]:
                    i, j = next((i, j) for i in range(len(left)) for j in range(i) if left[i] + left[j] == best)
                    left.append(own.pop())
                    two = left[i], left[j]
                    for x in two:
                        left.remove(x)
                    own += two
                    left.sort(reverse=True)
            bins.append(own)
        found = packing.best_two_fit(np.bincount(sizes, minlength=capacity + 1), capacity)
        assert sorted(x for own, n in found for x in own * n) == sorted(sizes)
        # Pairs of one total may differ, so the number of bins may by few.
        assert abs(sum(n for _, n in found) - len(bins)) <= 1 + len(bins) // 20


def test_packing_with_another_tokenizer_file(tmp_path):
    """A file whose text handling isn't the one that is done by words is used by the library as a whole."""
    import json

    path = public_tokenizers.path("word_bpe_49k.json")
    own = json.load(open(path, encoding="utf-8"))
    own["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(own), encoding="utf-8")
    tokenizer = packing.WordTokenizer.of(str(other))
    text = "Some WORDS, é  1234"
    assert not tokenizer.by_words and np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.whole.encode(text, add_special_tokens=False).ids
    assert packing.WordTokenizer.of(path).by_words


def test_bpe_tree_equals_the_library(docs, awkward):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for leaf in (2, 7, 64):
        tree = bpe_tree.TreeBpe.of(path, public_tokenizers.PATTERN, leaf)
        for text in ("", "a", "Hello  world's   123 x\n\n\ty", "漢字 é     end", "no spaces at all" * 9, "don't stop " * 40):
            ids = tree.encode(text)
            assert ids == tree.encoding.encode_ordinary(text) and tree.decode(ids) == text.encode()
    tree = bpe_tree.TreeBpe.of(path, public_tokenizers.PATTERN, 4096)
    for df in (docs, awkward):
        want = {(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts(df) for ids in [tree.encoding.encode_ordinary(t or "")]}
        assert set(map(tuple, bpe_tree.bpe_round_trip(df, path, public_tokenizers.PATTERN).collect())) == want
        assert bpe_tree.bpe_round_trip(df, path, public_tokenizers.PATTERN).count() == df.count()
    assert bpe_tree.bpe_round_trip(docs.filter("false"), path, public_tokenizers.PATTERN).count() == 0


def brute_repeats(values, least):
    where = {}
    for i, v in enumerate(values):
        for s in range(len(v) - least + 1):
            where.setdefault(v[s : s + least], []).append((i, s))
    gone = [bytearray(len(v)) for v in values]
    for at in where.values():
        if len(at) > 1:
            for i, s in at:
                gone[i][s : s + least] = b"\1" * least
    return gone


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_against_brute_force(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdef ") for _ in range(500))
    rows = texts(docs)[:60] + [(9000 + i, "".join(rng.choice("xyz ") for _ in range(150)) + passage[i : 300 + 9 * i] + str(i) * 3) for i in range(12)]
    rows += [(9100, "z" * 450), (9101, None), (9102, passage), (9103, passage), (9104, "é" * 110 + passage[:150]), (9105, "é" * 111)]
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=200).collect()}
    values = [(t or "").encode() for _, t in rows]
    for (d, _), v, gone in zip(rows, values, brute_repeats(values, 200), strict=True):
        kept = bytes(b for b, g in zip(v, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (found[d].n_bytes, found[d].n_removed, found[d].n_spans, found[d].kept_sha256) == (len(v), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


def test_suffix_stage_keeps_whole_signs(awkward):
    left = suffix_dedup.without_repeats(awkward)
    assert left.columns == awkward.columns and left.schema["text"].dataType.simpleString() == "string"
    assert left.filter("doc_id = 6").count() == 0  # one passage again and again: nothing is left
    assert suffix_dedup.suffix_dedup(awkward.filter("false")).count() == 0
    assert suffix_dedup.whole_signs("aé漢b".encode(), 2, 5) == (3, 3)
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(awkward).collect())
    assert found == sorted((str(d), len((t or "").encode()), *((90_000, 1) if d == 6 else (0, 0))) for d, t, _ in AWKWARD)


def test_exact_dedup_groups(spark, awkward):
    found = exact_dedup.exact_dedup(awkward, keep="max")
    rows = {(r.doc_id, r.text_sha256): r for r in found.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1, empty].keep_id == 2 and rows[1, empty].group_size == 2 and not rows[1, empty].kept and rows[2, empty].kept
    one = exact_dedup.without_copies(awkward)
    assert one.columns == awkward.columns and one.count() == len(AWKWARD) - 2
    # A fingerprint that collides: the bytes decide.
    clash = exact_dedup.exact_dedup(awkward, keep="max", fingerprint=lambda text: F.unhex(F.lit("00")))
    assert sorted(map(str, clash.collect())) == sorted(map(str, found.collect()))
    assert exact_dedup.exact_dedup(awkward.filter("false")).count() == 0


def test_token_counts_equal_the_library(docs, awkward):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, awkward):
        want = sorted((str(d), len((t or "").encode()), n, n > 512) for d, t in texts(df) for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)])
        assert sorted((str(r[0]), *r[1:]) for r in map(tuple, token_counts.token_counts(df, path, 512).collect())) == want
    assert token_counts.token_counts(docs.filter("false"), path, 512).count() == 0


def test_token_counts_of_texts_with_blanks_and_special_strings():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    assert counter.parted
    rng = random.Random(4)
    signs = [" ", " ", "  ", "   ", "\n", "\t", "a", "don't", "é", "漢", "12", "!?", "<|endoftext|>", "<|", "\u00a0", "\u3000", "\x1c", "\x85", "it's"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    assert counter.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "suffix_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from leadtide.llm.common import materialise

    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, docs, SF))
        assert after.columns == docs.columns
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    # Exact and near copies are gone.
    assert docs.select("doc_id").distinct().count() == docs.count()
    odd = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(0), "cls": F.lit(3), "__id": F.lit(4), "sid": F.lit(5), "salt": F.lit(6)})
    for start in (odd, odd.filter("false")):
        left = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = materialise(stage(spark, left, SF))
            assert left.columns == start.columns
        assert {r.doc_id for r in left.collect()} <= {3, 4, 5, None}
        assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() == left.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
