"""Each operator against a brute-force version on small texts with awkward rows."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sonogrid.llm import _text, bpe, components, exact_dedup, katz, language_id, mixing, ngram_join, order_minhash, quality, queries, url_filter, warc
from sonogrid.llm._learn import remainder

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `text_sha` string, token string"


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a"] * 6 + ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    texts = []
    for i in range(n):
        if i % 4 == 3 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 120))))
    texts += [None, "", " \n\t", "one", "Two words", "two  words", "two\nwords", "漢字", "long " * 3000, "x" * 5000]
    return [(i * 3, t, "en", f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows + rows[:2], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, k, num, den):
    sets, parent = {}, {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(spark, docs, k, num):
    rows, df = docs
    want = brute_components(rows, k, num, 100)
    got = ngram_join.jaccard_components(df, k, num, 100).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("early,direct,stars", [(1, 0, 0), (3, 0, 2), (16, 0, 6), (2, 1000, 6)])
def test_ngram_join_rounds(spark, docs, monkeypatch, early, direct, stars):
    rows, df = docs
    for name, value in {"BLOCK": 2, "MAX_BROADCAST_IDS": 1, "EARLY": early, "DIRECT": direct, "MAX_STARS": stars, "HOT_LEAST": 2, "SAMPLE": 2, "MAP_WORDS": 1, "LONG": 2, "PART": 3}.items():
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.jaccard_components(df, 2, 60, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2, 60, 100)


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a B c"), (None, "x"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == [(2, 1, 2), (4, 1, 2), (9, 0, 9), (None, 1, 2), (None, 1, None)]


def test_ngram_join_makes_a_pair_once(spark):
    """A group of near misses: the full round makes one row a pair."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(0, 120, 3), 7):
            words[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 3, 80, 100).collect()} == want


@pytest.mark.parametrize("n,m", [(5, 6), (40, 45), (300, 900), (1, 64)])
def test_maps_bound_the_difference(n, m):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 63, size, dtype=np.uint64) for size in (n, m))
    b[: n // 2] = a[: n // 2]
    wide = [ngram_join._parity(s, max(64, 2 << len(s).bit_length())).tobytes() for s in (a, b)]
    bound = ngram_join.least_difference(*wide)
    assert bound <= len(set(a.tolist()) ^ set(b.tolist())) and ngram_join.least_difference(wide[0], wide[0]) == 0 and bound > 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [8, 200, 256, 257, 1024, 4096])
def test_words_of_any_form_have_their_own_hash(spark, n):
    """Thue-Morse words and their complements, which no polynomial modulo a power of two tells apart."""
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer(f"{a} {b} {a}\0 {a}".encode(), np.uint8)
    found, _ = _text.words(raw, np.array([0, len(raw)]))
    assert len(set(found.tolist())) == 3 and found[0] == found[3]
    starts, ends = _text.runs((~_text.IS_SPACE[raw]).view(np.uint8), np.array([0, len(raw)]))
    assert _text.same_bytes(raw, starts, ends, np.array([0, 1, 2, 0])) and not _text.same_bytes(raw, starts, ends, np.array([0, 0, 2, 0]))
    df = spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y")], "doc_id long, text string")
    assert [r.component_id for r in ngram_join.jaccard_components(df, 3, 90, 100).orderBy("doc_id").collect()] == [1, 2]
    scored = katz.score_texts(df, F.col("doc_id") == 2).where("doc_id = 2").first()
    assert (scored.n_tokens, scored.n_known) == (4, 3)


def test_bpe_of_words_alike(spark):
    import public_tokenizers
    import tiktoken

    path = queries.vocabulary_path()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    a = thue_morse(4096)
    text = a + "\n" + a.translate(str.maketrans("ab", "ba"))
    got = bpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, keep_ids=True).first()
    assert got.ids == library.encode_ordinary(text) and got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_without_hashes(spark, docs, monkeypatch):
    """Where all hashes are equal the pieces are told apart by their bytes."""
    path = queries.vocabulary_path()
    coder = bpe.Encoder(bpe.load_ranks(path))
    raw = np.frombuffer("one two three two one".encode(), np.uint8)
    want = coder.encode(raw, np.array([0, len(raw)]))[0].tolist()
    monkeypatch.setattr(_text, "hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    assert coder.encode(raw, np.array([0, len(raw)]))[0].tolist() == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare.difference(spark, compare.connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) is None


def test_prefix_lengthens_with_cost(spark):
    costs = [(50, 51, 52, 53), (3, 1000, 2000, 3000), (0, 0, 0, 0), (900, 901, 2000, 2001)]
    got = spark.createDataFrame(costs, "f1 long, f2 long, f3 long, f4 long").selectExpr(f"{ngram_join.matches_by_cost()} as l").collect()
    assert [r.l for r in got] == [4, 1, 1, 2]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (10, 11), (50, 40), (40, 30), (30, 20), (20, 60), (60, 70), (5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20, 70: 20, 5: 5}


def test_contracted_links_connect_the_same(spark):
    links = [(1, 2), (2, 3), (3, 9), (10, 11), (50, 40), (40, 30), (30, 20), (20, 60), (60, 70), (5, 5)]
    first = components.contracted(spark.createDataFrame(links[:5], "a long, b long"))
    now = components.contracted(spark.createDataFrame(links[5:], "a long, b long"), first)
    assert now.where("u <= v").count() == 0
    got = {r.id: r.component for r in components.components(now.toDF("a", "b")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20, 70: 20}


def test_exact_dedup(spark, docs):
    rows, df = docs
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in rows}
    size = collections.Counter(norm[i] for i, *_ in rows + rows[:2])
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.keep_id, r.group_size) == (first[norm[r.doc_id]], size[norm[r.doc_id]])
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in got if r.kept) == sorted(first.values())
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0 and exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("words", [1, 3, 1 << 25])
def test_exact_dedup_filter_of_any_size(spark, docs, monkeypatch, words):
    """A filter that is too small lets all rows through to the shuffle and changes nothing."""
    rows, df = docs
    monkeypatch.setattr(exact_dedup, "MAX_WORDS", words)
    alive = len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in rows})
    assert exact_dedup.exact_duplicates(df).where("kept").count() == alive
    assert exact_dedup.drop_exact_duplicates(df).count() == alive
    hot = spark.range(500).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    got = exact_dedup.exact_duplicates(hot)
    assert got.where("kept").count() == 334 and got.agg(F.max("group_size")).first()[0] == 167


def exchanged_columns(df):
    """Names of the columns that each exchange of rows in the physical plan carries."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = []
    for line in re.findall(r"Exchange hashpartitioning.*?\n(.*)", text):
        found.append(set(re.findall(r"(\w+)#\d+", line)))
    return found


def test_exact_dedup_shuffles_no_text_it_has_no_equal_of(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_WORDS", 4)
    path = str(tmp_path / "d")
    spark.range(4000).selectExpr("id as doc_id", "if(id < 40, 'same', repeat(cast(id as string), 50)) as text").write.parquet(path)
    df = spark.read.parquet(path)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.count() == 3961
    assert not any("text" in c for c in exchanged_columns(exact_dedup.exact_duplicates(df)))
    # a filter of two words for one repeated text: nearly all rows are missed and stay where they are
    hashed = df.withColumn("sha", F.unhex(F.sha2(F.col("text"), 256)))
    once = hashed.groupBy("sha").count().where("count > 1").select("sha")
    sieve = exact_dedup._packed(exact_dedup.marked_bits(once, "sha", 2, 1))
    some, alone = exact_dedup.split_by_filter(hashed, "sha", sieve, 2)
    assert some.count() + alone.count() == 4000 and 40 <= some.count() < 200 and some.where("doc_id < 40").count() == 40
    assert not any("text" in c for c in exchanged_columns(alone))


def spark_hash(values, seed=42):
    """xxhash64 of SQL: the hash of each value seeds the next."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text):
    """Order MinHash over units, by sorting the k-mers anew for each sketch."""
    bits, size = order_minhash._HASH_BITS, order_minhash.SKETCHES
    units, at = [], 0
    while at < len(text):
        blank, ends = "\t\n\x0b\x0c\r ", lambda c: c in "aeo" or ord(c) >= 0x370
        to = at
        while to < len(text) and to - at < order_minhash.MAX_UNIT and text[to] not in blank and not ends(text[to]):
            to += 1
        to += to < len(text) and ends(text[to])
        to += to < len(text) and text[to] in blank
        units.append(text[at:to])
        at = to
    if not units:
        return ""
    k = order_minhash.K
    mers = [spark_hash(units[i : i + k]) >> 64 - bits for i in range(len(units) - k + 1)] if len(units) >= k else [spark_hash([" ".join(units)]) >> 64 - bits]
    nth, numbered = collections.Counter(), []
    for place, h in enumerate(mers):
        again = spark_hash([h.to_bytes(8, "little"), nth[h].to_bytes(4, "little")]) >> 64 - bits if nth[h] else h
        nth[h] += 1
        numbered.append((again, place))
    out = ""
    for j in range(size):
        ranked = sorted(numbered, key=lambda m: ((m[0] - j * ((1 << bits) // size)) % (1 << bits), m[1]))[: order_minhash.TUPLE]
        hashed = spark_hash([h.to_bytes(8, "little") for h, _ in sorted(ranked, key=lambda m: m[1])])
        out += f"{hashed:08x}"[-8:]
    return out


def brute_likeness(a, b):
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, 8 * order_minhash.SKETCHES, 8)]
    return 1.0 if a == b else 0.0 if not a or not b else sum(x == y for x, y in pairs) / order_minhash.SKETCHES


def brute_report(rows):
    """(doc_id, n_chars, sha of the edited text, ...) of each row, in the order that defines the next."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(spark_hash([r[1]])), r[1]))
    out = []
    for at, (i, t) in enumerate(ordered):
        nxt = ordered[(at + 1) % len(ordered)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        f, g, h = map(brute_fingerprint, (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, brute_likeness(f, g), brute_likeness(f, h)))
    return sorted(out, key=str)


UNBROKEN = ["x" * 900 + "y" * 300 + "x" * 300, "漢字仮名交じり文の例です。" * 30, "одно слово ещё", "ab" * 700, "😀😀é😀", "\x1c\x85 \u3000", " ", "one", ""]


@pytest.mark.parametrize("ids", [range(0, 400, 2), [-9 * 10**18, 9 * 10**18, -(2**63), 2**63 - 1, 0], [*range(180), 10**15], [7] * 60 + [None] * 60 + [3] * 5])
@pytest.mark.parametrize("rows", [512, 3])
def test_order_minhash(spark, monkeypatch, ids, rows):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", rows)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("the of a ion ing sch über".split()) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    data = [(i, (UNBROKEN + texts)[at % 159] if at % 11 else None) for at, i in enumerate(ids)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, text string, `range` string, mark int").repartition(3)
    got = order_minhash.edit_report(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_report(data)


def test_order_minhash_spreads_far_ids(spark):
    df = spark.range(20000).selectExpr("if(id = 0, 1000000000000000, id) as doc_id", "cast(id as string) as text")
    keyed = df.selectExpr("false as no_id", "~doc_id as down", "xxhash64(text) as mark")
    starts = order_minhash._starts(keyed)
    sizes = [r["count"] for r in keyed.withColumn("range", order_minhash._range_of(starts)).groupBy("range").count().collect()]
    assert sum(sizes) == 20000 and len(sizes) == len(starts) > 20 and max(sizes) < 4 * order_minhash.RANGE_ROWS


def test_order_minhash_empty_and_alone(spark):
    assert order_minhash.edit_report(empty(spark)).count() == 0
    one = order_minhash.edit_report(spark.createDataFrame([(7, "a b c", *["x"] * 2, 5, "y", "z")], SCHEMA)).first()
    assert one.near_next == 1.0


def likeness_of(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(*[order_minhash.fingerprint(F.col(x)).alias(x) for x in "ab"])
    return [r[0] for r in df.select(order_minhash.likeness(F.col("a"), F.col("b"))).collect()]


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(200)]
    turned = words[100:] + words[:100]
    mixed = [w for i in range(0, 200, 2) for w in (words[i + 1], words[i])]
    a, b, c = (" ".join(x) for x in (words, turned, mixed))
    t, m = likeness_of(spark, [(a, b), (a, c)])
    assert m < t < 0.9


@pytest.mark.parametrize("script", ["latin", "unbroken latin", "han"])
def test_order_minhash_falls_with_edit_distance(spark, script):
    rng = random.Random(4)
    signs = {"latin": "etaoinshrdlu    ", "unbroken latin": "etaoinshrdlucmfw", "han": [chr(0x4E00 + i) for i in range(900)]}[script]
    pairs = []
    shares = [0, 0.005, 0.02, 0.08, 0.3]
    for share in shares:
        for _ in range(8):
            text = [rng.choice(signs) for _ in range(1500)]
            edited = list(text)
            for _ in range(int(share * len(text))):  # each is an edit distance of one
                at = rng.randrange(len(edited))
                rng.choice([lambda: edited.pop(at), lambda: edited.insert(at, rng.choice(signs)), lambda: edited.__setitem__(at, rng.choice(signs))])()
            pairs.append(("".join(text), "".join(edited)))
    got = np.array(likeness_of(spark, pairs)).reshape(len(shares), -1).mean(axis=1)
    assert got[0] == 1 and (np.diff(got) < 0).all() and got[1] > 0.7 and got[2] > 0.25 and got[-1] < 0.2


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net/", "http://net/x", "https://m.EXAMPLE.net/en/1?x#y", "https://example.net/de/1",
            "http://xexample.com/de/9", "http://www.example.com/de/9", "http://w.org/fr/?", "http://w.org?/fr/", "http://spam-farm.example.org/en/1", "http://q.example.org/en/3"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id int, url string, html string, path string")
    got = {r.url: r for r in url_filter.judge_urls(df).collect()}
    for u, r in got.items():
        assert (r.host, r.path) == url_filter.split_url(u)
    assert [got[u].rule for u in urls] == [None, None, None, None, None, "net/", "net/", "example.net/en/", "net/", None, "example.com/de/", "org/fr/", None, None, None]
    assert got[urls[13]].verdict == "block" and got[urls[14]].verdict == "allow" and got[urls[7]].verdict == "allow" and got[urls[8]].verdict == "block"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = queries.vocabulary_path()
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    signs = ["a", "b", "s", "t", "'", "'s", "'re", "'ll", " ", "  ", "\n", "é", "漢字", "😀", "1", "٣", "½", ".", "!!", "　", "the", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None, "", "a" * 3000, "ab" * 2000, " " * 500, "z" * 65 + "q" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, path, keep_ids=True).collect():
        text = texts[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), path).count() == 0
    for piece in (b"segmentation", "Überprüfung".encode(), b"qqqqqqqqqqqqqqq"):
        assert bpe.merge_piece(piece, ranks) == library._encode_single_piece(piece)


def brute_katz(rows, held):
    """Plain dictionaries; the same formulas."""
    seqs = {}
    for i, t, *_ in rows:
        seqs[i] = [*WORD.findall((t or "").translate(LOW)), None]
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for i, s in seqs.items():
        if not held[i]:
            uni.update(s)
            for h, w in zip(["<s>", *s[:-1]], s):
                bi[h, w] += 1
                hist[h] += 1
    n = sum(uni.values())

    d1, d2 = good_turing(uni.values()), good_turing(bi.values())
    known = {w: c * d1.get(c, 1) / n for w, c in uni.items()}
    rest = max(1 - sum(known.values()), 1 / (n + 1))  # the unknown type's
    scale1 = (1 - rest) / sum(known.values())
    p1 = lambda w: known[w] * scale1 if w in known else rest
    seen = collections.defaultdict(list)
    for h, w in bi:
        seen[h].append(w)

    def p(w, h):
        if not hist[h]:
            return p1(w)
        pair = {x: bi[h, x] * d2.get(bi[h, x], 1) / hist[h] for x in seen[h]}
        left = 1 - sum(pair.values())
        scale = 1.0
        if left < 1e-9:
            scale, left = hist[h] / (hist[h] + 1), 1 / (hist[h] + 1)
        if w in pair:
            return pair[w] * scale
        return left / (1 - sum(p1(x) for x in seen[h])) * p1(w)

    out = {}
    for i, s in seqs.items():
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in s)
        out[i] = (len(s), sum(uni[w] > 0 for w in s), n, base, sum(math.log10(p(w, h)) for h, w in zip(["<s>", *s[:-1]], s)))
    for h in ["the", "of", "<s>", "no such word"]:
        assert abs(sum(p(w, h) for w in uni) + p("an unknown word", h) - 1) < 1e-9
    return out


def good_turing(counts, k=5):
    """Discount factors from a plain list of counts, by the published formula; half a count off where it has no answer."""
    n = collections.Counter(counts)
    try:
        last = (k + 1) * n[k + 1] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, k + 1)}
        ok = last < 1 and all(0 < v < 1 for v in d.values())
    except ZeroDivisionError:
        ok = False
    return d if ok else {r: (r - 0.5) / r for r in range(1, k + 1)}


@pytest.mark.parametrize("counts", [[1] * 100 + [2] * 40 + [3] * 20 + [4] * 11 + [5] * 7 + [6] * 5 + [9, 50], [1, 1, 2], [], [7] * 5])
def test_discounts(counts):
    of = np.array([len(counts), *[counts.count(r) for r in range(1, katz.K + 2)]], np.int64)
    got, want = katz.discounts(of), good_turing(counts)
    assert [got[r] for r in range(1, 6)] == pytest.approx([want[r] for r in range(1, 6)])


@pytest.mark.parametrize("blocks,buckets,widths", [(3, 2, [1]), (4, 4, [1]), (5, 3, [1, 1]), (3, 9, [3, 1]), (70, 17, [5, 2, 1, 1]), (2, 64, [16, 4, 1])])
def test_routes(monkeypatch, blocks, buckets, widths):
    monkeypatch.setattr(katz, "FAN", 4)
    routes = katz.Routes(blocks, buckets)
    assert routes.widths == widths
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    got = routes.asked("a", keys, np.arange(500), 0)
    assert len(got) <= 4 and (np.concatenate([katz._unpack_keys(k) for k in got["keys"]]) == keys).all()
    assert (np.concatenate([katz._unpack_values(v) for v in got["counts"]]) == np.arange(500)).all()


@pytest.mark.parametrize("block,bucket,fan", [(3_000_000, 2_000_000, 512), (300, 200, 512), (300, 200, 3), (500, 90, 2)])
def test_katz(spark, docs, monkeypatch, block, bucket, fan):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "FAN", fan)
    monkeypatch.setattr(katz, "BUCKET_KEYS", bucket)
    rows = docs[0]
    df = spark.createDataFrame(rows, SCHEMA)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    want = brute_katz(rows, held)
    got = katz.score_texts(df.repartition(3), remainder("doc_id", 5) == 1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held[r.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_katz_edges(spark):
    assert katz.score_texts(empty(spark), F.lit(False)).count() == 0
    df = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = katz.score_texts(df, F.lit(True)).collect()
    assert len(none) == 3 and all(r.score == 0 and r.train_tokens == 0 for r in none)
    assert {r.doc_id for r in katz.score_texts(df, F.lit(False)).collect()} == {None, 1}


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    body = ["<p>é</p>", None, "", "same", "same", "x" * 9000, "WARC/1.1\r\n\r\nContent-Length: 5", "same", None]
    rows = [(i, None if i == 3 else f"http://a/{i} é\n", body[i % 9]) for i in range(60, -1, -1)] + [(None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, html in sorted(r for r in rows if r[0] is not None):
        first.setdefault(html or "", i)
    records = warc.write_archives(df)
    for least in (0, 5):
        got = warc.read_archives(warc.normalise_archives(records, least)).collect()
        assert len(got) == len(rows)
        html = {i: (h or "").encode() for i, _, h in rows}
        for r in got:
            payload = html[r.page_id]
            assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            response = len(payload) < least or first[payload.decode()] == r.page_id
            assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", first[payload.decode()]))
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(df.limit(0)))).count() == 0


def test_warc_inflates_several_members_and_finds_cuts():
    records = b"".join(warc.build_record([("WARC-Type", "response")], b"a" * n) for n in (0, 7, 100_000))
    packed = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = packed.compress(records) + packed.flush()
    assert [len(b) for _, b in warc.Reader(warc.inflate(io.BytesIO(data * 2), 100))] == [0, 7, 100_000] * 2
    with pytest.raises(ValueError):
        list(warc.Reader(iter([records[:-50]])))


def test_language_id(spark):
    rng = random.Random(1)
    letters = {"en": "the of and ing tion", "de": "der und sch ung ein", "fr": "le et que eau é", "es": "el ción que os a"}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 4]
        rows.append((i, " ".join(rng.choice(letters[lang].split()) for _ in range(40)), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "12 !?", "fr"), (903, "漢字", None), (903, "漢字", None), (None, "the of the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(df, usable=remainder("doc_id", 4) != 2, carry=[("held_out", remainder("doc_id", 4) == 2), ("truth", F.col("lang"))]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert sum(r.lang_pred == r.truth for r in held) >= 0.98 * len(held)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    assert all(r.lang_pred != "und" for r in got if r.doc_id == 903)
    assert {r.lang_pred for r in language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 6, 30])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n or n == 1


def test_quality(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows = [(i, " ".join(word() + ("%%%" if i % 4 == 0 else "") for _ in range(60))) for i in range(300)] + [(900, None), (901, ""), (902, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels, remainder("doc_id", 3) == 1).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.98 * len(held)
    assert {r.score for r in quality.score_quality(df, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert quality.score_quality(df.limit(0), labels, F.lit(False)).count() == 0


def test_mixing(spark, docs, monkeypatch):
    rows, df = docs
    got = mixing.mix(df, keep=0.5).collect()
    assert len(got) == len(rows) + 2
    tokens = collections.Counter()
    for r in got:
        tokens[r.mix_source, r.mix_lang, r.mix_topic] += r.mix_tokens
    cells = sorted(tokens)
    weight = {(r.mix_source, r.mix_lang, r.mix_topic): r.cell_weight for r in got}
    for axis, power in enumerate(mixing.POWERS.values()):
        have, now = collections.Counter(), collections.Counter()
        for c in cells:
            have[c[axis]] += tokens[c] / sum(tokens.values())
            now[c[axis]] += weight[c]
        goal = {k: v**power for k, v in have.items()}
        for k in goal:
            assert now[k] == pytest.approx(goal[k] / sum(goal.values()), abs=1e-6)
    assert sum(r.mix_tokens * r.keep_probability for r in got) == pytest.approx(0.5 * sum(tokens.values()), rel=1e-6)
    for r in got:
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16) / 2**52
        assert r.mix_kept == (u < r.keep_probability)
    monkeypatch.setattr(mixing, "MAX_CELLS", 0)
    monkeypatch.setattr(mixing, "STEPS", 8)
    far = {(r.mix_source, r.mix_lang, r.mix_topic): r.cell_weight for r in mixing.mix(df, keep=0.5).collect()}
    for c in cells:
        assert far[c] == pytest.approx(weight[c], abs=1e-3)
    monkeypatch.undo()
    assert mixing.mix(empty(spark)).count() == 0
    odd = df.withColumn("source", F.lit(None).cast("string"))
    assert mixing.mixed(odd, keep=1.0).columns == df.columns


@pytest.mark.parametrize("n", range(1, 7))
def test_shingles_of_few_words(n):
    raw = np.frombuffer(" ".join("abcdef"[:n]).encode(), np.uint8)
    for k in (3, 5):
        found, to = _text.shingles(*_text.words(raw, np.array([0, len(raw)])), k)
        assert len(found) == to[-1] == max(1, n - k + 1) == len(set(found.tolist()))


def test_components_of_one_short_text(spark):
    df = spark.createDataFrame([(1, "only three words")], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.jaccard_components(df, k=5, num=80, den=100).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 1, 1)]


def test_mixing_margins_of_sample(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        n = 5 if i % 4 == 0 else rng.randint(90, 400)
        word = "!!!!" if i % 7 == 1 else "abcde"
        rows.append((i, " ".join([word] * n), rng.choice(["en"] * 5 + ["de", "fr"]), rng.choice(["a"] * 8 + ["b", "c"])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, keep=0.6).collect()
    total = sum(r.mix_tokens for r in got)
    assert sum(r.mix_tokens * r.keep_probability for r in got) == pytest.approx(0.6 * total, rel=1e-6)
    whole = 0
    for axis, power in mixing.POWERS.items():
        have, kept, short = collections.Counter(), collections.Counter(), {}
        for r in got:
            have[r[f"mix_{axis}"]] += r.mix_tokens
            kept[r[f"mix_{axis}"]] += r.mix_tokens * r.keep_probability
            short[r[f"mix_{axis}"]] = r[f"{axis}_shortfall"]
        goal = {k: (v / total) ** power for k, v in have.items()}
        goal = {k: v / sum(goal.values()) for k, v in goal.items()}
        full = set()
        while True:
            level = (0.6 * total - sum(have[k] for k in full)) / sum(goal[k] for k in goal if k not in full)
            more = {k for k in goal if k not in full and level * goal[k] > have[k]}
            if not more:
                break
            full |= more
        whole += len(full)
        for k in goal:
            assert kept[k] == pytest.approx(have[k] if k in full else level * goal[k], abs=1e-6 * total)
            assert short[k] == pytest.approx(goal[k] - kept[k] / (0.6 * total), abs=1e-6)
    assert whole and any(r.keep_probability < 1 for r in got)
    monkeypatch.setattr(mixing, "MAX_CELLS", 0)
    monkeypatch.setattr(mixing, "STEPS", 10)
    far = {r.doc_id: r for r in mixing.mix(df, keep=0.6).collect()}
    for r in got:
        assert far[r.doc_id].keep_probability == pytest.approx(r.keep_probability, abs=1e-3)
        assert far[r.doc_id].topic_shortfall == pytest.approx(r.topic_shortfall, abs=1e-4)


def mixing_rows():
    """Texts whose margins no sample fits together: most sources have one language."""
    rng = random.Random(9)
    rows = []
    for i in range(160):
        source = rng.choice(["a"] * 6 + ["a\0", "b", "b", "c", None])
        lang = {"a": "en", "b": "de"}.get(source) or rng.choice(["en", "fr"])
        rows.append((i, "word " * rng.randint(1, 90), lang, source, f"k{rng.randint(0, 2)}"))
    return rows + [(900, "", "xx", "a", "k0"), (901, None, "xx", "d", "k1")]


def test_mixing_places_agree(spark, monkeypatch):
    """Cells on the driver and cells as a table have the same results to the last bit, fit or no fit."""
    df = spark.createDataFrame(mixing_rows(), "doc_id long, text string, lang string, source string, kind string")
    monkeypatch.setattr(mixing, "STEPS", 2)
    monkeypatch.setattr(mixing, "BOUNDED_STEPS", 4)
    both = []
    for most in (20_000, 0):
        monkeypatch.setattr(mixing, "MAX_CELLS", most)
        got = mixing.mix(df, keep=0.9, powers={"topic": 0.8, "lang": 0.0, "source": 0.5}, topic_col="kind")
        both.append(sorted(map(tuple, got.select("doc_id", *mixing.RESULTS).collect())))
    assert len(both[0]) == 162 and both[0] == both[1]
    assert both[0][0][-2] > mixing.TOLERANCE and len({r[1] for r in both[0]}) == 6


def test_pipeline_mixture_places_agree(spark, monkeypatch):
    import corpus_pipeline

    rows = [r[:4] for r in mixing_rows() if r[0] < 900]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "BOUNDED_STEPS", 3)
    both = []
    for most in (20_000, 0):
        monkeypatch.setattr(mixing, "MAX_CELLS", most)
        both.append(sorted(r.doc_id for r in corpus_pipeline.mixture(spark, df, "").collect()))
    assert 0 < len(both[0]) < len(rows) and both[0] == both[1]


def test_pipeline_mixture_names_no_utf8(spark, monkeypatch):
    """Sources whose bytes are no UTF-8 stay apart, and rows keep their cell's rates, on the driver and on tables."""
    import corpus_pipeline

    rows = [r[:4] for r in mixing_rows() if r[0] < 900]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    code = F.when(F.col("source") == "a", "73FE").when(F.col("source") == "b", "73FF").otherwise(F.hex("source"))
    df = df.withColumn("source", F.unhex(code).cast("string"))
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "BOUNDED_STEPS", 3)
    near = mixing.mix(df).select(F.hex("mix_source").alias("name"), "cell_weight", "mix_gap").collect()
    assert {r.name for r in near} == {"", "73FE", "73FF", "6100", "63"} and all(r.cell_weight and r.mix_gap for r in near)
    both = []
    for most in (20_000, 0):
        monkeypatch.setattr(mixing, "MAX_CELLS", most)
        both.append(sorted(r.doc_id for r in corpus_pipeline.mixture(spark, df, "").select("doc_id").collect()))
    assert 0 < len(both[0]) < len(rows) and both[0] == both[1]


def test_mixing_order_of_cells():
    rng = np.random.default_rng(4)
    cells = [(f"s{a}", f"l{b}", f"t{c}") for a in range(9) for b in range(7) for c in range(5) if rng.random() < 0.7]
    tokens = np.ceil(np.exp(rng.normal(5, 2, len(cells))))
    order = rng.permutation(len(cells))
    p, short, gap = mixing.rake_bounded(cells, tokens, 0.8)
    q, far, apart = mixing.rake_bounded([cells[i] for i in order], tokens[order], 0.8)
    assert (p[order] == q).all() and (short[order] == far).all() and gap == apart
    assert (mixing.rake(cells, tokens)[order] == mixing.rake([cells[i] for i in order], tokens[order])).all()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows, df = docs
    langs = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))
    langs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    kept = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, df, ""), "")
    want = brute_components(rows, 5, 80, 100)
    sets = {i: c for i, (n, c) in want.items()}
    norm = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    alive = sorted(norm.values())
    again = brute_components([r for r in rows if r[0] in alive], 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in alive if again[i][1] == i)
    assert kept.columns == df.columns and sets


def offsets_of(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def kind_runs(text):
    """Runs of one kind of byte: small letters and bytes from 0x80, capitals, digits, other signs."""
    out, last = [], None
    for b in text.encode():
        kind = 0 if b in b"\t\n\x0b\x0c\r " else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4
        if kind and kind == last:
            out[-1] += bytes([b])
        elif kind:
            out.append(bytes([b]))
        last = kind
    return out


def test_word_vectors_by_plain_sums(spark):
    texts = ["the cat The 12 cats!!", "a", "", "one two three two one é漢 x9", "the cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = quality.word_vectors(df)
    bucket = lambda token: int(_text.hashes(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]))[0] >> np.uint64(40)) % quality.BUCKETS
    index = np.zeros((quality.BUCKETS, quality.DIM))
    for b in range(quality.BUCKETS):
        for e in (0, 1):
            index[b, quality.INDEX_AT[b, e]] = quality.INDEX_SIGN[b, e]
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for text in texts:
        cells = [bucket(t) for t in kind_runs(text)]
        for i, c in enumerate(cells):
            for j in range(max(0, i - quality.WINDOW), min(len(cells), i + quality.WINDOW + 1)):
                if i != j:
                    want[c] += index[cells[j]]
    want /= np.maximum(1, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.abs(got[:, : quality.DIM] - want).max() < 1e-6 and (got[:, quality.DIM :] == index).all()
    pooled = quality.pooled(got, *offsets_of(texts))
    for row, text in zip(pooled, texts):
        cells = [bucket(t) for t in kind_runs(text)]
        mean = got[cells].mean(axis=0) if cells else np.zeros(got.shape[1])
        assert np.abs(row[:-1] - mean).max() < 1e-5 and row[-1] == pytest.approx(math.log1p(len(cells)) / 10, abs=1e-6)


def test_network_and_temperature():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] + 0.8 * rng.normal(size=400) > 0).astype(float)  # not linear, and noisy
    model = quality.fit(x, y)
    w1, b1, w2, b2 = model["params"]
    for row, p in zip(x[:20], quality.predict(model, x[:20])):
        z = [(v - m) / s for v, m, s in zip(row, model["mean"], model["scale"])]
        hidden = [math.tanh(sum(z[i] * w1[i, j] for i in range(5)) + b1[j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, w2)) + b2[0]
        assert p == pytest.approx(1 / (1 + math.exp(-logit / model["temperature"])), abs=1e-9)
    assert ((quality.predict(model, x) >= 0.5) == y).mean() > 0.8
    order = np.random.Generator(np.random.PCG64(3)).permutation(400)[:80]  # the rows kept for the temperature
    loss = lambda t: float(np.logaddexp(0, -(2 * y[order] - 1) * quality._logits(model, x[order]) / t).mean())
    assert model["temperature"] > 1 and loss(model["temperature"]) < loss(1.0)
    assert quality.fit(x[:9], y[:9]) == {"share": y[:9].mean()}


def test_quality_with_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_TRAIN", 50)
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    df = spark.range(4000).selectExpr("1L as doc_id", "concat('word', id % 100, ' x') as text")
    labels = spark.createDataFrame([(1, 0), (1, 1)] * 300, "doc_id long, quality int")
    assert quality.score_quality(df, labels, F.lit(False)).count() == 4000 and 0 < seen[0] <= 50


def test_language_features_and_decoding():
    texts = ["Ab ab", "", "é漢", "xy"]
    raw, offsets = offsets_of(texts)
    got = language_id.features(raw, offsets)
    for row, text in zip(got, texts):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        want = collections.Counter(language_id.BUCKETS + b for b in data)
        for a, b, c in zip(data, data[1:], data[2:]):
            want[((a * 0x1F123BB5 + b * 0x2C1B3C6D + c * 0x297A2D39) >> 7) & (language_id.BUCKETS - 1)] += 1
        total = max(1, sum(want.values()))
        assert {i: pytest.approx(math.sqrt(n / total), rel=1e-5) for i, n in want.items()} == {i: row[i] for i in np.flatnonzero(row)}
    rng = np.random.default_rng(0)
    n, bits = 3, language_id.codewords(3).shape[1]
    model = {"code": language_id.codewords(n), "w": rng.normal(size=(4, bits)), "b": rng.normal(size=bits), "trust": rng.random((n, bits))}
    x = rng.normal(size=(30, 4))
    best, score, unsure = language_id.decode(model, x)
    for i in range(30):
        loss = [sum(model["trust"][lang, j] * math.log1p(math.exp(-model["code"][lang, j] * (x[i] @ model["w"][:, j] + model["b"][j]))) for j in range(bits)) for lang in range(n)]
        order = sorted(range(n), key=loss.__getitem__)
        assert best[i] == order[0] and unsure[i] == (loss[order[1]] - loss[order[0]] < language_id.AMBIGUOUS)
        assert score[i] == pytest.approx(1 / sum(math.exp(-bits * (v - loss[order[0]])) for v in loss))


def test_code_corrects_a_wrong_bit():
    """Codewords of six languages differ in so many bits that one wrong bit changes no decoding."""
    code = language_id.codewords(6)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3
    model = {"code": code, "w": np.eye(31, dtype=np.float32), "b": np.zeros(31), "trust": np.full((6, 31), 1 / 31)}
    for lang in range(6):
        wrong = np.repeat(code[lang][None] * 3.0, 31, axis=0)
        wrong[np.arange(31), np.arange(31)] *= -1
        assert (language_id.decode(model, wrong)[0] == lang).all()


def test_language_vectors_travel_packed():
    texts = ["the cat sat on the mat", "der Hund lief um das Haus", None, "", "x" * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en", "en", "de"]), pa.array(range(5), pa.int64()), pa.array(texts)], ["lang", "mark", "text"])
    (got,) = language_id._featured([batch])
    raw, offsets = _text.utf8(batch.column("text"))
    want = language_id.features(raw, offsets).astype(np.float16)
    packed = got.column("x").to_pylist()
    assert [zlib.decompress(x) for x in packed] == [x.tobytes() for x in want]
    assert sum(map(len, packed)) * 10 < want.nbytes


@pytest.mark.parametrize("ids", ["1L", "cast(null as long)", "id % 3"])
def test_language_id_with_ids_that_repeat(spark, monkeypatch, ids):
    monkeypatch.setattr(language_id, "MAX_TRAIN", 40)
    seen = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, y, n: seen.append(np.bincount(y).tolist()) or fit(x, y, n, 20))
    df = spark.range(3000).selectExpr(f"{ids} as doc_id", "if(id % 2 = 0, concat('the of and ', id % 400), concat('der und sch ', id % 400)) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    got = language_id.identify_languages(df, carry=[("lang_true", F.col("lang"))])
    assert got.count() == 3000 and len(seen[0]) == 2 and all(0 < n <= 20 for n in seen[0])
    assert got.where("lang_pred = lang_true").count() > 2900


def test_mixing_names_that_clash(spark):
    rows = [(i, f"word{i % 5} " * (i % 40 + 1), ["en", "de"][i % 2], f"s{i % 3}", 0.5, 1, "r", 9.0, "x", "y") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_probability double, own0 int, `mix.kept` string, mix_gap double, given_topic string, mix_draw string")
    got = mixing.mix(df)
    assert got.columns == [c for c in df.columns if c not in mixing.RESULTS] + mixing.RESULTS and got.count() == 120
    assert all(0 <= r.keep_probability <= 1 and r.own0 == 1 and r.mix_draw == "y" and r.mix_gap < 1e-6 for r in got.collect())
    kept = mixing.mixed(df)
    assert kept.columns == df.columns and 0 < kept.count() <= 120 and kept.where("keep_probability = 0.5 and mix_gap = 9").count() == kept.count()
    named = mixing.mix(df, topic_col="source")
    assert {r.mix_topic for r in named.collect()} == {"s0", "s1", "s2"}


def test_mixing_topics(spark):
    """Two vocabularies in each of two languages: topics tell the vocabularies apart, and words are the tokens."""
    rng = random.Random(6)
    bags = {(lang, kind): [f"{lang}{kind}{i}" for i in range(30)] for lang in ("en", "de") for kind in ("law", "sea")}
    rows = []
    for i in range(200):
        key = rng.choice(sorted(bags))
        rows.append((i, " ".join(rng.choice(bags[key]) for _ in range(rng.randint(20, 60))) + "\n", key[0], "s", key[1]))
    rows += [(900, None, "en", "s", "-"), (901, " \n", None, None, "-")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string")
    got = mixing.mix(df).collect()
    by_topic = collections.defaultdict(collections.Counter)
    for r in got:
        assert r.mix_tokens == len(WORD.findall(r.text or ""))
        by_topic[r.mix_topic][r.lang, r.kind] += 1
    assert set(by_topic.pop("")) == {("en", "-"), (None, "-")}
    assert sum(c.most_common(1)[0][1] for c in by_topic.values()) >= 190 and len(by_topic) >= 4


def test_mixing_vectors():
    texts = ["a b a", "", "The the"]
    x, n = mixing._vectors(*offsets_of(texts))
    assert n.tolist() == [3, 0, 2] and sorted(x[0][x[0] > 0].tolist()) == pytest.approx([math.sqrt(1 / 3), math.sqrt(2 / 3)]) and x[1].sum() == 0 and x[2].max() == 1


def test_url_training():
    """The weights against plain matrices, and the labelled table they are fitted on."""
    urls = url_filter.LABELLED_URLS
    got, bias = url_filter.train(epochs=20)
    x = np.zeros((len(urls), url_filter.N_BUCKETS))
    for row, (url, _) in zip(x, urls):
        key = "^" + "".join(url_filter.split_url(url)) + "$"
        for i in range(len(key) - 3):
            row[int(hashlib.md5(key[i : i + 4].encode()).hexdigest()[:3], 16)] += 1
        row /= math.sqrt(len(key) - 3)
    y = np.array([label for _, label in urls])
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(url_filter.N_BUCKETS), 0.0
    touched = (x > 0).any(axis=0)
    for _ in range(20):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        b -= 2.0 * err.sum()
        w -= 2.0 * (x.T @ err + 1e-4 * np.where(touched, w, 0))
    assert got == pytest.approx(w.tolist(), abs=2e-6) and bias == pytest.approx(b, abs=2e-6)
    w, b = url_filter.train()
    assert (((x @ np.array(w) + b) > 0) == (y == 1)).all()


def test_url_filter_keeps_own_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "mine", "too")], "page_id long, url string, url_key string, _url_key string")
    got = url_filter.judge_urls(df)
    assert got.columns == [*df.columns, "host", "path", "rule", "block_score", "verdict"] and got.first().url_key == "mine"


def test_warc_bounds_files_by_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    df = spark.range(200).selectExpr("id as page_id", "cast(null as string) as url", "cast(null as string) as html").coalesce(1)
    assert warc.write_archives(df).select("file").distinct().count() > 20


def test_scratch_is_cleared(spark):
    from sonogrid.llm import _store

    kept = _store.written(spark.range(5))
    assert kept.count() == 5 and _store.get_file(kept.inputFiles()[0])
    folder = _store._root(spark)
    _store.clear_scratch(spark)
    system, path = _store.open_fs(folder)
    assert system.get_file_info(path).type.name == "NotFound"


def test_pipeline_edges(spark, tmp_path):
    """An empty table, and columns named as the operators' own."""
    import corpus_pipeline

    rows = [(i, " ".join(f"{w}{i % 7}" for w in ["the", "of", "and"] * 9), "en" if i % 2 else "de", "s", 3, 0.5, "en", True, "z") for i in range(40)] + [(None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, lang_pred string, mix_kept boolean, own1 string")
    for name, table in (("none", df.limit(0)), ("some", df)):
        (tmp_path / name).mkdir()
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.count() <= 14 and (name == "some") == (got.count() > 0)
        docs = table
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, "")
            assert docs.columns == df.columns
