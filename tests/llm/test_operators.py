import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgeloom.llm import decontaminate, language, packing, pseudo_likelihood, quality, registry, shingles, simhash, substring, tokens, toxicity, warc
from judgeloom.llm.common import fresh_path, sampled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "s", None), (5, f"before {PASSAGE} after", "en", "s", 1), (6, f"other start {PASSAGE}", None, "t", 1),
    (7, "one two", "en", "s", 7), (8, "one two", "fr", "s", 7), (8, "one two", "fr", "s", 7), (None, "one two", "en", "s", 7), (9, "same " * 80, "en", "s", 1), (10, "été à la plage, ñandú", "fr", "t", 9), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"fp": F.lit(1), "spans": F.lit("x"), "_id": F.lit(2), "n_words": F.lit("clash"), "bin_id": F.lit(0)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


# --- brute force ---


def brute_substrings(pairs, window=substring.WINDOW):
    words = [(i, (t or "").encode().split()) for i, t in pairs]
    seen = Counter(b" ".join(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {p for j in range(len(w) - window + 1) if seen[b" ".join(w[j : j + window])] > 1 for p in range(j, j + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def brute_components(prints, radius=2):
    ids = sorted(set(prints))
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    return {x: find(x) for x in ids}


def brute_hits(pairs, items, window=13):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if w else ():
            windows[tuple(w[j : j + n])].add(str(i))
    out = []
    for i, t in pairs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found |= windows[tuple(w[j : j + n])]
                    hit.update(range(j, j + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def brute_pack(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [b for b in bins if b["left"] >= length and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        best = min(fits, key=lambda b: (b["left"], b["moved"])) if fits else None
        if best is None:
            bins.append(best := {"left": capacity, "s": set(), "c": set(), "id": len(bins), "moved": 0})
        out.append((best["id"], capacity - best["left"]))
        best["left"] -= length
        best["moved"] = len(out)
        best["s"].add(source)
        best["c"].add(cluster)
    return out


# --- each operator ---


@pytest.mark.parametrize("options", [{}, {"hot": 1, "block_words": 50}])
def test_substrings(spark, docs, options):
    got = rows(substring.removal(docs, **options), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings([(r[0], r[1]) for r in ROWS])
    left = {r.doc_id: r.text for r in substring.cut(docs, **options).collect()}
    assert left[5] == "before after" and left[6] == "other start" and left[1] is None and left[3] == " \n\t " and left[9] == ""
    assert substring.cut(docs).columns == docs.columns


def test_substrings_on_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert rows(substring.removal(d)) == brute_substrings([tuple(r) for r in d.collect()])


def test_overlapping_repeats(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("ab"), 120)) for _ in range(6)] + [" ".join("abc"[i % 3] for i in range(200))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(substring.removal(d, window=9, anchor=3)) == brute_substrings(list(enumerate(texts)), 9)


def test_long_anchor(spark):
    rng = np.random.default_rng(7)
    pairs = [(k, " ".join(rng.choice(list("abcd"), 60))) for k in range(40)]
    d = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(substring.removal(d, window=6, anchor=1, block_words=50)) == brute_substrings(pairs, 6)


def test_template_lines(spark):
    """Long runs of one anchor in many documents, of which two share a passage: no block may part them."""
    rng = np.random.default_rng(3)
    line = lambda k: f"this is one and the same template line with number {k} in it only"
    pairs = []
    for i in range(60):
        numbers = (1000 * i + rng.permutation(1000))[:150].tolist()
        if i in (0, 59):
            numbers[70:75] = range(900_000, 900_005)
        pairs.append((i, "\n".join(map(line, numbers))))
    want = brute_substrings(pairs)
    assert sum(x[2] > 0 for x in want) == 2
    d = spark.createDataFrame(pairs, "doc_id long, text string")
    for options in ({}, {"block_words": 2000}, {"block_words": 20_000, "hot": 2000}):
        assert rows(substring.removal(d, **options)) == want, options


def test_simhash(spark, docs, sf):
    got = simhash.near_duplicates(docs).collect()
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert {1, 2, 3, None} <= zero and len(got) == len(ROWS)
    same = {r.component_id for r in got if r.doc_id in (7, 8)}
    assert same == {7}
    found = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    root = brute_components([int(r.fingerprint, 16) for r in found])
    first = defaultdict(lambda: 1 << 62)
    for r in found:
        first[root[int(r.fingerprint, 16)]] = min(first[root[int(r.fingerprint, 16)]], r.doc_id)
    assert all(r.component_id == first[root[int(r.fingerprint, 16)]] for r in found)


def test_covering_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12).tolist()
    prints = {0, *base}
    for b in base:
        for _ in range(8):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= 1 << k
            prints.add(x)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    root = brute_components(prints)
    sizes = Counter(root.values())
    for small in (simhash.SMALL, 0, 3):  # pair by pair, by hubs alone, and both
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, small=small).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        joined = simhash.components(simhash.links(nodes, small=small)).collect()
        assert {r.node % (1 << 64) for r in joined} == {x for x in prints if sizes[root[x]] > 1}
        assert len({r.root for r in joined}) == sum(n > 1 for n in sizes.values())
    masks = simhash.covering_masks(2)
    assert all(any(not (m >> i & 1) and not (m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def brute_near_copies(pairs, width=5, similarity=0.8):
    """The number of the first row of each row's group, by all pairs."""
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    root = list(range(len(sets)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_copy_rows():
    rng = np.random.default_rng(5)
    out = [(k, t) for k, t in enumerate([None, "", " \n", "one two", "One  TWO", "one two three"])]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for changes in [0, 1, 3, 4, 6, 6, 7, 8, 9, 14, 40]:
            words = list(base)
            for at in rng.integers(0, 300, changes).tolist():
                words[at] = f"new{rng.integers(0, 10**6)}"
            out.append((len(out), " ".join(words)))
    return out


@pytest.mark.parametrize("sizes", [(shingles.QUERIES, shingles.PASSING), (2, 3)])
def test_near_copies(spark, monkeypatch, sizes):
    monkeypatch.setattr(shingles, "QUERIES", sizes[0])
    monkeypatch.setattr(shingles, "PASSING", sizes[1])
    pairs = near_copy_rows()
    d = spark.createDataFrame(pairs, "doc_id long, text string")
    root = brute_near_copies(pairs)
    assert rows(simhash.keep_first(d), "doc_id") == sorted({(r,) for r in root}, key=str)
    assert len({r.component_id for r in simhash.near_duplicates(d).collect()}) > len(set(root)) + 40


def test_near_copies_meet_under_covering_masks(spark):
    """The stage's candidates are SimHash fingerprints that meet under a covering mask."""
    from judgeloom.llm import covering

    masks, rng = covering.draw_masks().tolist(), np.random.default_rng(6)
    places = range(covering.SHARED, covering.SHARED + covering.COVERED)
    for _ in range(300):  # any RADIUS covered bits are hidden by one, the shared bits by none
        flips = sum(1 << int(k) for k in rng.choice(places, covering.RADIUS, replace=False))
        assert any(not m & flips for m in masks) and all(m & 1 for m in masks)
    # A pair of 0.8 at least meets in a draw, sets of four and five hashes as well.
    for share, one, other in [(267, 33, 33), (4, 0, 1), (8, 1, 1)]:
        h = rng.integers(0, 1 << 63, (200, share + one + other), np.int64).astype(np.uint64)
        sets = [x for row in h for x in (row[: share + one], np.concatenate([row[:share], row[share + one :]]))]
        prints = covering.set_prints(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        d = spark.createDataFrame([(k, bytearray(p), len(sets[k]) <= covering.TINY, k) for k, p in enumerate(prints)], "node long, prints binary, tiny boolean, grp long")
        met = defaultdict(set)
        for r in covering.meetings(d, len(sets)).collect():
            met[r.t, r.key].add(r.node)
        together = {k // 2 for c in met.values() for k in c if k ^ 1 in c}
        assert together == set(range(200))


def test_clusters_against_all_pairs():
    from judgeloom.llm import covering

    rng, masks = np.random.default_rng(3), covering.draw_masks()
    flip = lambda x, bits, n: x ^ sum(1 << int(k) for k in rng.choice(bits, n, replace=False))
    base = [(int(rng.integers(0, 1 << 52)), int(rng.integers(0, 1 << 62))) for _ in range(20)]
    rows_ = [(flip(w, 52, rng.integers(0, 9)), flip(m, 62, rng.integers(0, 14))) for w, m in base for _ in range(25)]
    word, mark = np.array(rows_, np.uint64).T
    apart = word[:, None] ^ word
    near = np.any([(apart & m) == 0 for m in masks], 0) & (np.bitwise_count(apart).astype(int) + np.bitwise_count(mark[:, None] ^ mark) <= covering.APART)
    want = np.arange(len(word))
    while not np.array_equal(want, least := np.where(near, want, len(word)).min(1)):
        want = least
    assert np.array_equal(covering.clusters(word, mark, masks)[0], want)


def test_keep_first_of_odd_rows(spark, docs, none):
    kept = rows(simhash.keep_first(docs), "doc_id", "text")
    assert kept == sorted([(r[0], r[1]) for r in ROWS if r[0] in (1, 4, 5, 7, 9, 10)], key=str)  # the least id of the wordless, of copies, and of 5 and 6
    assert simhash.keep_first(docs).columns == docs.columns and simhash.keep_first(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "A b  c"), (5, "x"), (5, "y z"), (4, "y z")], "doc_id long, text string")
    assert rows(simhash.keep_first(nameless), "doc_id") == [(4,), (5,), (None,)]


def test_fingerprint_bits():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c a", "c a b", "a b c")]
    want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > 4)
    assert simhash._fingerprint(b"A b\tc a\nB c", 3) == want


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (20, "one, TWO"), (3, None), (4, "!!"), (None, "plage"), (5, LONG[:3000])], "item_id long, text string").withColumn("lang", F.lit(0))
    items = [("null" if r.item_id is None else r.item_id, r.text) for r in bench.collect()]
    want = brute_hits([(r[0], r[1]) for r in ROWS], items)
    assert rows(decontaminate.report(docs, bench)) == want
    blocks = rows(decontaminate.matches(docs, bench, block_bytes=500), "doc_id", "n_hit")
    assert blocks == sorted(((w[0], w[2]) for w in want), key=str)
    found = {r.doc_id: r.matches for r in decontaminate.matches(docs, bench).collect()}
    assert [(m["first"], m["last"], m["item_id"], m["item_first"]) for m in found[5]] == [(1, 61, "1", 0)]
    assert decontaminate.clean(docs, bench).count() == sum(not w[-1] for w in want)
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert rows(decontaminate.report(docs, bench, block_bytes=500)) == want
    assert rows(decontaminate.clean(docs, bench, block_bytes=500)) == rows(decontaminate.clean(docs, bench))
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_decontamination_of_repeats(spark):
    """A word repeated on both sides makes as many results as there are words, not as many as pairs of places."""
    test = decontaminate.TestSuffixes([("a", "x " * 1000), ("b", "x " * 5), ("c", "x y " * 40)])
    text, first, window = decontaminate.search(test, [[b"x"] * 100_000])
    assert len(text) == (100_000 - 12) + (100_000 - 4)
    rng = np.random.default_rng(4)
    texts = [(k, " ".join(rng.choice(["a", "b"], 200, p=[0.8, 0.2]))) for k in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(["a", "b"], n, p=[0.8, 0.2]))) for k, n in enumerate([3, 5, 20, 60, 13, 12])]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert rows(decontaminate.report(d, b)) == brute_hits(texts, items)
    words = {i: t.split() for i, t in texts} | {i: t.split() for i, t in items}
    for r in decontaminate.matches(d, b).collect():
        hit = set()
        for m in r.matches:
            n = m["last"] - m["first"]
            assert words[r.doc_id][m["first"] : m["last"]] == words[m["item_id"]][m["item_first"] : m["item_first"] + n]
            hit.update(range(m["first"], m["last"]))
        assert len(hit) == r.n_hit


def test_warc(spark):
    pages = [(3, "u", "a\r\n\r\nWARC/1.1\r\nb"), (1, None, "a\r\n\r\nWARC/1.1\r\nb"), (2, "x y\r\nz", ""), (None, "q", None), (4, "é", "é\0" * 999), (5, "é", "é\0" * 999), (5, "é", "é\0" * 999)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    records = warc.read_archive(spark, warc.write_archive(d, fresh_path(spark, "warc")))
    assert {r.page_id: r.payload for r in records.collect() if r.record_type == "response"} == {1: pages[0][2], 2: "", 4: pages[4][2]}
    got = rows(warc.digests(records), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(1, 16, "response", None), (3, 16, "revisit", 1), (2, 0, "response", None), (None, 0, "revisit", 2), (4, 2997, "response", None), (5, 2997, "revisit", 4), (5, 2997, "revisit", 4)], key=str)
    apart = warc.digests(warc.read_archive(spark, warc.write_archive(d, fresh_path(spark, "warc"), min_bytes=10)))
    assert {r.page_id for r in apart.collect() if r.record_type == "revisit"} == {3, 5}
    assert warc.digests(warc.read_archive(spark, warc.write_archive(d.limit(0), fresh_path(spark, "warc")))).count() == 0


def test_tokens(spark, docs, none):
    import xxhash
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    fresh.encode_special_tokens = True
    files = tokens.write_tokens(docs, fresh_path(spark, "tokens"), path, sequence=64)
    at, want = 0, []
    th = lambda t: 42 if t is None else simhash._signed(xxhash.xxh64_intdigest(t, 42))
    for i, t in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, th(r[1]))):
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(tokens.read_documents(files)) == sorted(want, key=str)
    assert tokens.read_documents(tokens.write_tokens(none, fresh_path(spark, "tokens"), path)).count() == 0


def test_random_access(spark, docs):
    """Every sequence of every shard, one of them with a document of many batches, equals the ids of the library in order."""
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    many = [(k, LONG[: 900 * k]) for k in range(60)] + [(99, LONG)] + [(100 + k, "w " * k) for k in range(300)]
    files = tokens.write_tokens(spark.createDataFrame(many, "doc_id long, text string"), fresh_path(spark, "tokens"), path, sequence=8)
    want = [x for _, t in many for x in [*fresh.encode(t, add_special_tokens=False).ids, 2]]
    for shard in files.manifest.orderBy("shard").collect():
        of_shard, f = want[shard["first"] : shard["first"] + shard.n_tokens], tokens.TokenFile(shard.path)
        n = -(-len(of_shard) // 8)
        got = [f[k] for k in range(n)]
        assert not any(x.flags.owndata for pair in got for x in pair)  # views of the mapped file
        assert np.concatenate([ids[mask == 1] for ids, mask in got]).tolist() == of_shard
        assert all(len(ids) == len(mask) == 8 and (k == n - 1 or mask.all()) for k, (ids, mask) in enumerate(got))
        for k in (n, n + tokens.BATCH, -1):
            with pytest.raises(IndexError):
                f[k]
    assert sum(s.n_tokens for s in files.manifest.collect()) == len(want)


def test_copies_of_one_id_fill_many_shards(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    hot = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text")).repartition(8)
    files = tokens.write_tokens(hot, fresh_path(spark, "tokens"), path)
    assert max(r.n_docs for r in files.manifest.collect()) < 1500
    assert tokens.read_documents(files).groupBy("ids_crc32").count().first()["count"] == 4000


def test_cached_tokenizer_is_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    coder = tokens.CachedTokenizer(P.path("byte_bpe_50k.json"), cache=40)
    fresh = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    fresh.encode_special_tokens = True
    rng = np.random.default_rng(3)
    parts = list(" \n.,!'$09abzÀé日\t\x1c\u200b -") + [" the", " of.\nIn", "'s", " 's", "<|endoftext|>", "ª", "²", "\u0301", "ẞ", "\u180e", "  ", "a.b", "\r\n", "\xa0", " \u2003", "\u3000x", "\x85"]
    for _ in range(300):
        texts = [None, *("".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(40))]
        ids, bounds = coder.encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == fresh.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_packing(spark, docs, none):
    rng = np.random.default_rng(2)
    for capacity in (10, 64):
        pieces = [(int(n), None if s == 3 else int(s), None if c == 9 else int(c)) for n, s, c in zip(np.sort(rng.integers(1, capacity + 1, 300))[::-1], rng.integers(0, 4, 300), rng.integers(0, 10, 300))]
        assert packing.pack_group(pieces, capacity) == brute_pack(pieces, capacity)
    got = packing.pack_texts(docs, capacity=64).collect()
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert length[4] == 30_001 and length[5] == 63 and length[2] == length[1] == 0
    bins = defaultdict(list)
    for r in got:
        if r.bin_id:
            bins[r.bin_id].append(r)
    assert all(sum(r.length for r in b) <= 64 and len({r.source for r in b if r.source}) == len([r for r in b if r.source]) for b in bins.values())
    assert len({r.bin_id for r in got if r.doc_id in (7, 8)}) == 3  # the three copies lie apart
    assert packing.pack_texts(none).count() == 0


def test_quality(spark, docs, none):
    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        often = Counter(zip(w, w[1:], w[2:]))
        inside = {p for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)

    odd = ["a b c a b c a", "x\n\nx\n x\nx", "#1 *\n\n", "a a a a", "é ü b", "\x1ca\x1cb", "\x0bq\x0bq", "l\nl\n\nm\nl"]
    for text in [*odd, *[r[1] for r in ROWS]]:
        assert quality.base_figures(text) == plain(text), text
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert got[1].base_failed and not got[2].kept and got[5].kept and not got[9].kept
    assert quality.judged(none, labels).count() == 0 and quality.judged(docs, labels.limit(0)).count() == len(ROWS)


def test_risk_control(spark):
    for k, n in ((0, 50), (3, 200), (40, 100)):
        p = quality.binomial_upper(k, n, 0.05)
        from math import comb

        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    for k, n, share, sure in ((0, 500, 0.01, 0.01), (0, 300, 0.01, 0.05), (3, 900, 0.01, 0.05), (2, 900, 0.01, 0.05), (0, 458, 0.01, 0.01), (50, 9000, 0.01, 1e-6)):
        assert quality.certified(k, n, share, sure) == (quality.binomial_upper(k, n, sure) <= share)


STATS = "doc_id long, stratum string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def test_cutoffs_tell_bad_from_good(spark):
    rng = np.random.default_rng(0)
    good = [(i, "en", i, 100, 500, int(s), 0, 0) for i, s in enumerate(rng.integers(0, 12, 320))]
    bad = [(5000 + i, "en", 5000 + i, 100, 500, 30 + i, 0, 0) for i in range(20)]
    few = [(9000 + i, "few", 9000 + i, 100, 500, 5 if i % 2 else 90, 0, 0) for i in range(40)]
    copies = [(20_000 + i, "copies", 7, 100, 500, 0, 0, 0) for i in range(700)] + [(30_000 + i, "copies", 30_000 + i, 100, 500, 80, 0, 0) for i in range(20)]
    labels = spark.createDataFrame([(r[0], int(r[5] < 20)) for r in good + bad + few + copies], "doc_id long, quality int")
    found = {r["_stratum"]: r for r in quality.cutoffs(spark.createDataFrame(good + bad + few + copies, STATS), labels).collect()}
    assert 0.28 <= found["en"]["_symbols"] < 0.4 and found["en"]["_rejected"] == 0 and found["en"]["_bound"] <= quality.ALPHA
    assert [found["en"][f"_{r[0]}"] for r in quality.RULES[1:]] == [None] * 4
    for name in ("few", "copies"):  # too few to promise anything; copies of one text are one trial
        assert [found[name][f"_{r[0]}"] for r in quality.RULES] == [None] * 5 and found[name]["_n"] < 30


def brute_cutoffs(rows, quality_of, alpha, delta):
    """Path and tests as the docstrings have them, row by row: {stratum: {rule: cutoff}}."""
    strata = sorted({r[1] for r in rows})
    of = {"n_words": 3, "word_chars": 4, "n_symbols": 5, "n_dup_lines": 6, "n_repeat_words": 7}

    def level(r, rule):
        ratio = r[of[rule[1]]] / r[of[rule[2]]]
        return next((k for k, c in enumerate(rule[4]) if (ratio > c if rule[3] == "over" else ratio < c)), len(rule[4]))

    half = {r[0]: r[8] for r in rows}
    paths = {}
    for s in strata:
        mine = [r for r in rows if r[1] == s]
        at, path = [-1] * 5, []
        while True:
            best = None
            for k, rule in enumerate(quality.RULES):
                for cut in range(at[k] + 1, len(rule[4])):
                    new = [quality_of[r[0]] for r in mine if half[r[0]] == 0 and at[k] < level(r, rule) <= cut]
                    last = [x for x in (quality_of[r[0]] for r in mine if half[r[0]] == 0 and level(r, rule) == cut) if not x]
                    if last:
                        key = (new.count(0) / (new.count(1) + 0.5), new.count(0), -k, -(cut - at[k] - 1))
                        best = max(best, (key, k, cut)) if best else (key, k, cut)
            if not best:
                break
            path.append(best[1:])
            at[best[1]] = best[2]
        paths[s] = path
    sure = delta / max(1, sum(bool(p) for p in paths.values()))
    out = {}
    for s in strata:
        held = [r for r in rows if r[1] == s and half[r[0]] == 1 and quality_of[r[0]]]
        now, out[s] = {}, {}
        for k, cut in paths[s]:
            now[k] = cut
            wrong = sum(any(level(r, quality.RULES[j]) <= c for j, c in now.items()) for r in held)
            if not held or quality.binomial_upper(wrong, len(held), sure) > alpha:
                break
            out[s] = {quality.RULES[j][0]: quality.RULES[j][4][c] for j, c in now.items()}
    return out


def test_cutoffs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows_ = []
    for s in ("a", "b", "c"):
        for _ in range(260):
            bad = rng.random() < 0.2
            rows_.append((len(rows_), s, len(rows_), 100, int(rng.integers(300, 700)) if not bad else int(rng.integers(250, 900)), int(rng.integers(0, 15)) + 20 * bad * (s != "b"), int(rng.integers(0, 6) + bad * rng.integers(0, 20)), int(rng.integers(0, 30)), bool(bad)))
    stats = spark.createDataFrame([r[:8] for r in rows_], STATS)
    half = {r.doc_id: r.half for r in stats.select("doc_id", F.pmod(F.xxhash64("th", F.lit(11)), F.lit(2)).alias("half")).collect()}
    quality_of = {r[0]: int(not r[8]) for r in rows_}
    labels = spark.createDataFrame(list(quality_of.items()), "doc_id long, quality int")
    want = brute_cutoffs([(*r[:8], half[r[0]]) for r in rows_], quality_of, 0.1, 0.1)
    got = quality.calibrate(stats, labels, 0.1, 0.1)
    assert got == {(s, name): c for s, found in want.items() for name, c in found.items()} and got


def test_promise_holds(spark):
    """Good and bad rows that nothing tells apart: of 60 strata none rejects more than ALPHA of its good documents."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 60, n)
    rows_, labels = [], []
    for s in range(60):
        for k, x in enumerate(draw(700)):
            rows_.append((len(rows_), f"s{s}", len(rows_), 100, 500, int(x), 0, 0))
            labels.append((len(labels), int(k % 3 > 0)))
    found = quality.calibrate(spark.createDataFrame(rows_, STATS), spark.createDataFrame(labels, "doc_id long, quality int"))
    share = lambda cutoff: np.mean([x / 100 > cutoff for x in range(60)])
    assert all(share(c) <= quality.ALPHA for c in found.values())


def test_every_stratum_is_calibrated(spark):
    """However many strata there are, each has its own cutoffs, and a row is judged by those of its stratum."""
    names, good, text = [f"l{k:03d}" for k in range(80)], 400, " ".join(f"w{i}" for i in range(60))
    lang = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("lang")
    rows_ = spark.range(len(names) * good).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + " "), F.col("id").cast("string"), F.when(F.col("id") < 20 * 80, F.lit(" #" * 9)).otherwise(F.lit(""))).alias("text"), lang)
    labels = rows_.select("doc_id", (F.col("doc_id") >= 20 * 80).cast("int").alias("quality"))
    found = quality.cutoffs(quality.figures(rows_), labels).collect()
    assert sorted(r["_stratum"] for r in found) == names and all(r["_symbols"] == 0.12 for r in found)
    new = spark.createDataFrame([(-1, text + " #" * 9, "l000"), (-2, text + " #" * 9, "l079"), (-3, text, "l079")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.judged(rows_.union(new), labels).filter("doc_id < 0").collect()} == {-1: False, -2: False, -3: True}


def test_sample_of_copies(spark):
    """Copies count once, whatever their number, and leave room for the other rows."""
    many = spark.range(9000).select(F.when(F.col("id") < 8900, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 8900, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = [r.text for r in sampled(many, 20).collect()]
    assert len(got) == len(set(got)) == 20
    got = [r.text for r in sampled(many, 500).collect()]
    assert len(got) == len(set(got)) == 101
    hot = spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("les mots").alias("text"), F.lit("fr").alias("lang"))
    assert [r.lang_pred for r in language.predict(hot.limit(1), language.fit(hot, ~language.held_out())).collect()] == ["fr"]
    assert sampled(many.limit(0), 5).count() == 0


def test_language(spark, docs, none, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(d, ~language.held_out())
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].rejected and got[10].lang_pred in model.languages
    both = language.op6(spark, sf).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in both]) > 0.95
    far = spark.createDataFrame([(1, "это совсем другой язык", None, None, 1), (2, "日本語の文章です", None, None, 1)], SCHEMA)
    assert language.predict(far, model, keep_columns=True).count() == 0
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op1(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = [r for r in got if r.toxic == 1]
    assert np.mean([r.predicted for r in hit]) >= 0.5 and np.mean([r.predicted for r in got if r.toxic == 0]) < 0.05
    assert all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, empty)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0} and toxicity.score(none, model).count() == 0
    p, u = np.eye(2)[[0] * 20], np.concatenate([np.eye(2)[[0] * 20], np.eye(2)[[1] * 80]])
    w, b = toxicity.nnpu(p, u, 0.2, 0)
    assert w[0] + b > 1 and w[1] + b < -1


def test_pseudo_likelihood(spark, docs, none):
    from dataclasses import replace
    from math import exp, log

    text = "the cat sat on the mat and the dog sat on the log " * 40
    d = spark.createDataFrame([(k, f"{text} rare{k}") for k in range(40)], "doc_id long, text string")
    model = pseudo_likelihood.train(d)
    blind = replace(model, network=replace(model.network, embed=0 * model.network.embed))
    before, after = (pseudo_likelihood.score(d, m).first().mean_logprob for m in (blind, model))
    assert after > before + 0.3  # the window tells much of a word
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, model).collect()}
    assert got[1].n_tokens == 0 and got[1].mean_logprob is None and got[2].sum_logprob == 0 and got[4].n_tokens == 30_000
    # The same sum, word by word.
    words = "the dog sat rare7 never".split()
    net, counts = model.network, {"the": 160 * 40, "dog": 40 * 40, "sat": 80 * 40, "rare7": 1, "never": 0.5}
    import pyarrow as pa

    _, _, cls, _, context = net.read(pa.array([" ".join(words)]))
    assert [tuple(c) for c in context[:2]] == [(pseudo_likelihood.EDGE, pseudo_likelihood.EDGE, context[0][2], context[0][3]), (pseudo_likelihood.EDGE, context[2][0], context[0][3], context[1][3])]
    total = 0.0
    for k, w in enumerate(words):
        v = np.tanh(sum(net.embed[c] * net.place[j] for j, c in enumerate(context[k])))
        z = (net.top @ v + net.bias).tolist()
        total += z[cls[k]] - log(sum(map(exp, z))) + log(counts[w]) - net.log_class[cls[k]]
    one = pseudo_likelihood.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), model).first()
    assert one.sum_logprob == pytest.approx(total, rel=1e-4)
    assert pseudo_likelihood.score(none, pseudo_likelihood.train(none)).count() == 0


def brute_risk(p, u, w, b, prior):
    """pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)]), row by row; and the second part as it is."""
    from math import exp, log

    loss = lambda x: log(1 + exp(-x))
    f = lambda x: sum(a * c for a, c in zip(x, w)) + b
    mean = lambda v: sum(v) / len(v)
    negative = mean([loss(-f(x)) for x in u]) - prior * mean([loss(-f(x)) for x in p])
    return prior * mean([loss(f(x)) for x in p]) + max(0, negative), negative


def test_positive_unlabelled_gradient():
    rng = np.random.default_rng(6)
    p, u = rng.integers(0, 2, (9, 4)).astype(float), rng.integers(0, 2, (30, 4)).astype(float)
    for b in (0.2, -6.0, 4.0):
        w = rng.normal(0, 1, 4)
        g, prior = toxicity.step_of(p, u, w, b, 0.6), 0.6
        below = brute_risk(p, u, w, b, prior)[1] < 0
        part = lambda w, b: -brute_risk(p, u, w, b, prior)[1] if below else brute_risk(p, u, w, b, prior)[0]  # noqa: B023, E731
        for k in range(5):
            e = np.eye(5)[k] * 1e-6
            assert g[k] == pytest.approx((part(w + e[:4], b + e[4]) - part(w - e[:4], b - e[4])) / 2e-6, rel=1e-4, abs=1e-7)


def test_risk_over_all_rows_never_rises(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{j}" for j in np.flatnonzero(rng.random(6) < (0.7 if k % 4 == 0 else 0.2))) or "none" for k in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa
    from judgeloom.llm.common import ALNUM_WORDS, hash_words

    words = np.sort(np.concatenate([hash_words(pa.array([f"t{j}"]), ALNUM_WORDS)[0] for j in range(6)]))
    u = np.zeros((300, 6))
    for k, t in enumerate(texts):
        _, at = toxicity.occurrences(pa.array([t]), words)
        u[k, at] = 1
    p = u[::8].astype(np.float32)
    w, b = rng.normal(0, 1, (3, 6)), rng.normal(0, 1, 3)
    after_w, after_b = toxicity._settled(d, {}, words, p, 0.25, w, b)
    before, after = ([brute_risk(p, u, x, y, 0.25)[0] for x, y in zip(*m)] for m in ((w, b), (after_w, after_b)))
    assert all(x <= y + 1e-9 for x, y in zip(after, before)) and min(x - y for x, y in zip(after, before)) < -0.01


def brute_language(model, text):
    """(language, similarity, whether it is rejected) by plain sums over trigrams of letters."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in text.encode()]
    padded, counts = [0, *letters, 0], Counter()
    for x, y, z in zip(padded, padded[1:], padded[2:]):
        if y:
            counts[(x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % (1 << 32) >> 20] += 1
    v = {k: float(np.log1p(n)) * float(model.idf[k]) for k, n in counts.items()}
    size = sum(x * x for x in v.values()) ** 0.5
    near = [sum(x * float(c[k]) for k, x in v.items()) / size for c in model.centroids]
    best = max(range(len(near)), key=lambda k: near[k])
    return model.languages[model.owner[best]], near[best], near[best] < model.floor[model.owner[best]]


def test_nearest_centroid_equals_brute_force(spark, sf, docs):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs.select(F.col("doc_id") + 10_000, "text"))
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~language.held_out())
    texts = {(r.doc_id, r.text) for r in d.collect()}
    got = language.predict(d, model).collect()
    by_id = defaultdict(list)
    for i, t in texts:
        by_id[i].append(brute_language(model, t))
    for r in got:
        assert any(r.lang_pred == x[0] and r.score == pytest.approx(x[1], abs=1e-4) and (r.rejected == x[2] or abs(x[1] - model.floor.min()) < 1e-4) for x in by_id[r.doc_id]), r


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    P = pseudo_likelihood
    f = lambda *s: rng.normal(0, 0.3, s)
    net = P.WindowNetwork(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), f(P.EDGE + 1, P.DIM), f(2 * P.SIDE, P.DIM), f(P.CLASSES, P.DIM), f(P.CLASSES), np.zeros(P.CLASSES))
    context, cls = rng.integers(0, 5, (40, 2 * P.SIDE)), rng.integers(0, P.CLASSES, 40)
    g = P.Sums()
    net.gradient(cls, context, g)
    assert g.loss == pytest.approx(-net.class_logs(cls, context).sum())
    embed = (g.embed * net.place[:, None, :]).sum(0)
    for part, grad, at in (("top", g.top, (3, 4)), ("embed", embed, (2, 5)), ("place", g.place, (1, 6)), ("bias", g.top[:, -1], (7,))):
        before = getattr(net, part)[at]
        loss = []
        for e in (1e-5, -1e-5):
            getattr(net, part)[at] = before + e
            loss.append(-net.class_logs(cls, context).sum())
        getattr(net, part)[at] = before
        assert grad[at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_model_does_not_depend_on_partitions(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.sum_logprob for r in pseudo_likelihood.score(d, pseudo_likelihood.train(d.repartition(n, "doc_id"))).collect()} for n in (1, 16))
    assert all(one[k] == pytest.approx(many[k], rel=1e-5, abs=1e-3) for k in one) and len(one) == d.count()


def test_every_word_has_its_own_probability(spark, monkeypatch):
    """Counts beyond the table that workers hold are joined: the same scores with a table of any size."""
    rows_ = [(k, " ".join(f"w{j * j % (7 + k)}" for j in range(30 + k)) + " once" * (k == 3)) for k in range(40)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    model = pseudo_likelihood.train(d)
    want = {r.doc_id: r.sum_logprob for r in pseudo_likelihood.score(d, model).collect()}
    few = pseudo_likelihood.commonest(model.counts, 5)
    assert len(few) <= 5 and [n for _, n in few] == sorted((n for _, n in few), reverse=True)
    from dataclasses import replace

    net = model.network
    keep = np.isin(net.hashes.view(np.int64), [w for w, _ in few]) | (net.rank < pseudo_likelihood.KNOWN)
    blind = replace(model, network=replace(net, log_n=np.where(np.isin(net.hashes.view(np.int64), [w for w, _ in few]), net.log_n, np.nan)))
    assert keep.all() and {r.doc_id: r.sum_logprob for r in pseudo_likelihood.score(d, blind).collect()} == pytest.approx(want)


def pipeline_rows(spark, sf):
    """The smallest table, and planted rows: odd ones, near copies, shared passages, benchmark passages."""
    rng = np.random.default_rng(12)
    found = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    english = [r for r in found if r[2] == "en" and len(r[1].split()) > 200][:6]
    out = list(found)
    add = lambda text, lang="en", source="s", i=None: out.append((10_000 + len(out) if i is None else i, text, lang, source, len(text or "")))
    for t in (None, "", " \n ", "1234 56", "%%%"):
        add(t)
    add(found[0][1], None, None)
    out.append(found[3])  # a repeated row
    for k, r in enumerate(english):
        words = r[1].split()
        for at in rng.integers(0, len(words), 1 + k).tolist():
            words[at] = "changed"
        add(" ".join(words))
    passage = " ".join(english[0][1].split()[:60])[::-1]
    add(f"{passage} and the end")
    add(f"so it begins {passage}")
    add(" ".join(bench[0][1].split()[:40]))
    return out, bench


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    import corpus_pipeline as pipeline

    rows_, bench = pipeline_rows(spark, sf)
    d = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = language.fit(d, ~language.held_out())
    left = [r for r in rows_ if not brute_language(model, r[1])[2]]
    assert {r[0] for r in rows_} > {r[0] for r in left}

    root = brute_near_copies([(r[0], r[1]) for r in left])
    first = defaultdict(list)
    for g, r in zip(root, left):
        first[g].append(r)
    keys = {(min(r[0] for r in g), next(r[1] for r in sorted(g, key=lambda r: r[0]))) for g in first.values()}
    left = [r for r in left if (r[0], r[1]) in keys]

    cut = []
    seen = Counter(tuple(w[j : j + 35]) for r in left for w in [r[1].encode().split()] for j in range(len(w) - 34))
    for r in left:
        w = r[1].encode().split()
        gone = {q for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for q in range(j, j + 35)}
        cut.append((r[0], b" ".join(x for q, x in enumerate(w) if q not in gone).decode() if gone else r[1], r[3]))
    assert any(a[1] != b[1] for a, b in zip(cut, left))

    dirty = [x[-1] for x in brute_hits([(k, r[1]) for k, r in enumerate(cut)], bench)]
    order = [x[0] for x in brute_hits([(k, r[1]) for k, r in enumerate(cut)], bench)]
    clean = [cut[k] for k, bad in zip(order, dirty) if not bad]
    assert len(clean) < len(cut)
    want = Counter()
    for i, t, _ in clean:
        n = len(t.split()) if t.isascii() else len(t.encode().split())
        want[i] += n + 1 if n else 0

    got = pipeline.run(spark, str(tmp_path)).collect()
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert length == want
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for name, b in bins.items():
        places = sorted((r.bin_offset, r.bin_offset + r.length) for r in b if name)
        assert all(x[1] <= y[0] for x, y in zip(places, places[1:])) and (not places or places[-1][1] <= packing.CAPACITY)
        assert name is None or len({r.source for r in b}) == len(b)


def test_pipeline_stages_on_odd_tables(spark, docs, none, sf):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names, and empty tables."""
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]
    known = pipeline.identify(spark, docs, sf)
    # ROWS are too few languages' worth to reject by distance; what has no letter goes.
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} <= {4, 5, 6, 7, 8, 9, 10, None} and all(r.text for r in known.collect())
    near = pipeline.near_duplicates(spark, docs, sf)
    assert near.columns == docs.columns and rows(near, "doc_id") == [(1,), (10,), (4,), (5,), (7,), (9,)]
    cut = {r.doc_id: r for r in pipeline.repeated_passages(spark, docs, sf).collect()}
    assert (cut[5].text, cut[5].n_chars, cut[1].text, cut[1].n_chars, cut[9].text) == ("before after", 12, None, None, "")
    clean = pipeline.contaminated(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    packed = pipeline.pack(spark, docs, sf).collect()
    assert len({(r.bin_id, r.bin_offset) for r in packed if r.bin_id}) == sum(bool(r.bin_id) for r in packed) and sum(r.bin_id is None for r in packed) == 4
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_ids_of_another_type(spark, sf):
    """Ids may be strings: the same rows as with numbers, wherever ids aren't put in order."""
    P = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame(ROWS, SCHEMA)
    named = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    labels = spark.createDataFrame([("5", 1, 0), ("6", 0, 1)], "doc_id string, quality int, toxic int")
    same = lambda f: rows(f(named)) == sorted(((None if r[0] is None else str(r[0]), *r[1:]) for r in f(d).collect()), key=str)
    assert same(substring.removal) and same(simhash.fingerprints) and same(lambda x: decontaminate.report(x, bench))
    model = pseudo_likelihood.train(d)
    assert same(lambda x: pseudo_likelihood.score(x, model)) and same(lambda x: language.predict(x, language.fit(d, F.lit(True))))
    assert {r.doc_id for r in simhash.keep_first(named).collect()} == {"1", "4", "5", "7", "9", "10"}
    assert {r.doc_id for r in packing.pack_texts(named).collect()} == {None, *map(str, range(1, 11))}
    assert quality.judged(named, labels).count() == len(ROWS) and toxicity.score(named, toxicity.fit(named, labels)).count() == len(ROWS)
    files = tokens.write_tokens(named, fresh_path(spark, "tokens"), P.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in tokens.read_documents(files).collect()} == {None, *map(str, range(1, 11))}


def test_shared_folder():
    from types import SimpleNamespace as N

    from judgeloom.llm import common

    conf = lambda **kv: N(get=lambda k, default=None: kv.get(k.replace(".", "_"), default))
    far = N(sparkContext=N(getConf=lambda: conf(), master="spark://x:7077", applicationId="a"), conf=conf())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    named = N(sparkContext=N(getConf=lambda: conf(spark_checkpoint_dir="hdfs://n/x/"), master="spark://x:7077"), conf=conf())
    assert common.shared_dir(named) == "hdfs://n/x"


def test_registry():
    assert {q.split("_")[0] for q in registry.queries()} == {f"op{k}" for k in range(1, 11)} and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    import compare

    assert compare.differences(registry.queries()[name](spark, sf), registry.oracle_sql()[name], compare.connect(sf)) == ""
