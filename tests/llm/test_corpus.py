"""The corpus operators against brute-force versions, on small fixtures with nulls, empty, long, equal and repeated rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import byte_bpe, decontaminate, language_id, phrase_dedup, pii, quality_rules, recurrence, registry, simhash, suffix_dedup, url_filter, warc
from rankloom.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [(1, "a" * 200), (2, "a" * 60), (3, "b " * 120), (3, "b " * 120), (4, " b" * 77 + " c"), (None, "a" * 100), (5, None), (6, ""), (0, "éa" * 40), (7, "x" + "éa" * 40), (8, "w w " * 30 + "é"), (9, "w " * 49), (-4, "w " * 51), (10, "\t\n 😀 \x0b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in ODD], "doc_id long, text string, kept string, id long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words_of(t):
    return (t or "").encode().split()


def brute_removed(rows, cut):
    first, out = {}, []
    units = [(i, cut(t)) for i, t in rows]
    for i, u in units:
        for k in range(len(u) - 49):
            w = tuple(u[k : k + 50])
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    for i, u in units:
        gone = bytearray(len(u))
        for k in range(len(u) - 49):
            if i is not None and first[tuple(u[k : k + 50])] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(u), sum(gone), [x for x, g in zip(u, gone) if not g]))
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_substring_dedup(spark, odd, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for module, cut, join in ((suffix_dedup, lambda t: (t or "").encode(), bytes), (phrase_dedup, words_of, b" ".join)):
        got = module.deduplicated(docs).drop("kept").collect()
        want = [(i, n, g, hashlib.sha256(join(k)).hexdigest()) for i, n, g, k in brute_removed(rows, cut)]
        assert sorted(((r[0], r[1], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted(want, key=str)


def test_substring_dedup_of_broken_runs(spark):
    """Document 2's 'a S b' is in document 1 as 'a S' and 'S b' apart, and S has 49 words: all of it goes."""
    rows = []
    for k in range(20):
        s = " ".join(f"s{k}x{i}" for i in range(49))
        rows += [(10 * k + 1, f"p{k} a {s} c{k} y{k} {s} b z{k}"), (10 * k + 2, f"q{k} a {s} b r{k}"), (10 * k + 3, f"a {s} c{k}"), (10 * k + 3, f"{s} b z{k}"), (10 * k + 4, f"a {s} b z{k}")]
    got = phrase_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_removed(rows, words_of)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted((i, n, g, b" ".join(k).decode()) for i, n, g, k in want)
    assert sum(g == 51 for _, _, g, _ in want) >= 20


@pytest.mark.parametrize("phrase_words", [60, 400, 250_000])
def test_automata_of_few_words(monkeypatch, phrase_words):
    """However few words an automaton may have, each window goes to the smallest document that has it."""
    monkeypatch.setattr(phrase_dedup, "PHRASE_WORDS", phrase_words)
    rng, raw = random.Random(6), []
    for _ in range(60):
        raw.append([b"%d" % rng.randrange(2) if rng.random() < 0.02 else b"w%d" % (i % 7) for i in range(rng.randrange(50, 92))])
    raw += [x[:60] for x in raw[:20]]
    windows, first = np.array([len(x) - 49 for x in raw]), np.array([rng.randrange(30) for _ in raw])
    least = {}
    for x, i in zip(raw, first.tolist()):
        for k in range(len(x) - 49):
            least[tuple(x[k : k + 50])] = min(least.get(tuple(x[k : k + 50]), i), i)
    want = [least[tuple(x[k : k + 50])] for x in raw for k in range(len(x) - 49)]
    assert phrase_dedup._block([b" ".join(x) for x in raw], windows, first).tolist() == want


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(100):
        s = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 70))], np.uint8)
        raw, order = s.tobytes(), suffix_dedup.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: raw[i:])
    assert suffix_dedup.common_prefixes(np.frombuffer(b"banana", np.uint8), np.array([5, 3, 1, 0, 4, 2])).tolist() == [0, 1, 3, 0, 0, 2]


def test_merged_intervals():
    i, s, e = recurrence.merged(np.array([2, 1, 2, 1, 2]), np.array([5, 0, 0, 3, 9]), np.array([9, 3, 4, 4, 12]))
    assert list(zip(s, e)) == [(0, 4), (0, 4), (5, 12)]


def test_empty_tables(spark, empty):
    for f in (suffix_dedup.deduplicated, phrase_dedup.deduplicated, simhash.near_components, byte_bpe.round_trip, pii.find, pii.sanitised, quality_rules.text_statistics):
        assert f(empty).count() == 0
    assert language_id.training_rows(empty, F.lit(True)) == []
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def random_words():
    """Words far wider than a matrix: of few letters, of common parts, and of any letters."""
    rng = random.Random(9)
    return ["".join(rng.choice(parts) for _ in range(n)) for parts, n in (("ab", 4000), (["tion", "ing", "the", "er", "qu", "s"], 2000), ("abcdefghijklmnopqrstuvwxyzéß漢", 6000))]


def test_bpe_is_tiktoken(spark, odd):
    bpe = byte_bpe.load(public_tokenizers.path(byte_bpe.DEFAULT), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ["", "it's 12345 <|endoftext|>", "aaaaaaaa" * 9, "日本語 😀", "ab" * 1500, "\x00\x01 " * 50, "x" * 512 + "y", " " * 9000, *random_words(), *(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    for t, code in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == enc.encode_ordinary(t) and bpe.decode(code) == t.encode()
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in byte_bpe.round_trip(odd).collect()}
    assert got == {(i, len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD}
    back = byte_bpe.decoded(byte_bpe.encoded(odd)).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in ODD)


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_simhash_components(spark, odd, bucket_rows):
    rng, base = random.Random(2), [f"w{i}" for i in range(200)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(200)] = "X" + str(rng.random())
        near.append((100 + i, " ".join(w)))
    near += [(None, near[k][1]) for k in (3, 5)] + [(None, " ".join(base[:100] + ["Y"] + base[101:]))]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    name = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(name.get(find(k), i), i)
    want = sorted(((i, f"{fps[k]:016x}", name.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, simhash.near_components(docs, bucket_rows=bucket_rows).collect()), key=str) == want


def test_links_through_a_row_without_an_id(spark, monkeypatch):
    """0 and 63 differ in 6 bits, but 7, which only a row without an id has, is within 3 bits of both."""
    rows = spark.createDataFrame([(0, 1), (7, None), (63, 2), (0, 5), (0xFFFF << 40, None)], "fp long, id long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = sorted(map(tuple, simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == [(1, 1), (2, 1), (5, 1), (None, 1), (None, None)]


@pytest.mark.parametrize("radius,parts", [(3, 1), (64, 32), (5, 3)])
def test_covering_masks_cover(radius, parts):
    masks = simhash.covering_masks(radius, parts=parts)
    rng = random.Random(3)
    for r in range(1, radius + 1):
        for _ in range(1000):
            d = sum(1 << b for b in rng.sample(range(64), r))
            meet = [m for m in masks if not m & d]
            assert meet and any(not f & d for f in simhash.finer_masks(meet[0], radius))


@pytest.mark.parametrize("slot_texts", [1, 3, 512])
def test_similar_components(spark, slot_texts):
    """Texts are one group if, and only if, a chain of pairs of 0.8 or more joins them."""
    rng, rows = random.Random(8), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(300)]
        for k, edits in enumerate((0, 1, 2, 4, 8, 16)):
            w = list(base)
            for at in rng.sample(range(300), edits):
                w[at] = f"x{rng.random()}"
            rows.append((10 * group + k, " ".join(w)))
    base = [f"h{i}" for i in range(60)]  # many copies with edits of their own: some pairs are alike, others hardly not
    for k in range(80):
        w = list(base)
        for at in rng.sample(range(60), rng.randrange(1, 4)):
            w[at] = rng.choice("ab") + str(at)
        rows.append((2000 + k, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "few words"), (None, rows[0][1]), rows[3], (None, "alone without an id " * 5), (None, "alone without an id " * 5)]
    sets = [set(simhash.shingle_hashes(t or "", 5)) for _, t in rows]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t or "", 5)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i, j in combinations(range(len(rows)), 2):
        if fps[i] == fps[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
            linked += fps[i] != fps[j]
    name, first = {}, {}
    for k, (i, t) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(name.get(find(k), i), i)
        first[find(k)] = min(first.get(find(k), (i is None, i or 0, t or "")), (i is None, i or 0, t or ""))
    docs = spark.createDataFrame([(i, t, "x", "r") for i, t in rows], "doc_id long, text string, id string, `row` string")
    got = simhash.similar_components(docs, slot_texts=slot_texts).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((i, name.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)
    assert linked > 100 and len({find(k) for k in range(len(rows)) if (rows[k][0] or 0) >= 2000}) > 1
    left = simhash.representatives(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == sorted(i for _, i, _ in first.values())


def test_pipeline_links_fingerprints(spark):
    """The pipeline's near-duplicates are joined by all of operator 9's links, also where the similarity is below 0.8."""
    long = " ".join(f"w{i}" for _ in range(4) for i in range(12))
    rows = [(k, f"{long} {' '.join(f'{c}{i}' for i in range(12))}") for k, c in ((1, "a"), (2, "b"))] + [(3, " ".join(f"z{i}" for i in range(300))), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    op9 = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs).collect()}
    assert op9 == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(set(op9.values()))


def test_similar_pairs_are_found(spark):
    """Every pair at 0.8 or more of documents is in one group, however many bits their fingerprints differ in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], set(simhash.shingle_hashes(r["text"] or "", 5))) for r in docs.collect()]
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    fps = {r["id"]: r["fp"] for r in simhash.fingerprints(docs, shingle=5).collect()}
    pairs = [(i, j) for (i, x), (j, y) in combinations(rows, 2) if len(x & y) >= 0.8 * len(x | y)]
    assert all(group[i] == group[j] for i, j in pairs)
    assert any((fps[i] ^ fps[j]).bit_count() > 5 for i, j in pairs)


def test_similar_sets():
    """8 of 10 members in common are enough, 7 of 9 are not; two empty sets are alike."""
    sets = [np.arange(a, b, dtype=np.uint64) for a, b in ((0, 10), (0, 8), (1, 10), (0, 0), (2, 9))]
    want = [[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for y in sets] for x in sets]
    assert [list(r) for r in simhash.alike(sets, sets, 0.8)] == want and want[0][:2] == [True, True] and not want[2][1] and want[3][3]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def good(k, v):
        n = re.sub("[^0-9]", "", v)
        luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(n) <= 19 and luhn, "phone": 8 <= len(n) <= 15}[k]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if good(k, m.group())]


def test_pii_base(spark):
    rng = random.Random(4)
    texts = ["a@b.c._x@d.e, 1.2.3.4.5.6.7.8 +1 (2) 3-4.5 678901 x@y é z@w.q.", "4111 1111 1111 1111 and 4111-1111-1111-1112 0300.1.2.3 +1234567", "a" * 5000 + " @ " + "1" * 5000 + "@a.b +" + "(" * 2000, "a@-.- +5--5555555-", None, ""]
    texts += ["".join(rng.choice("1234a.@+- (é") for _ in range(300)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["l"] for r in pii.find_base(docs).select("id", pii.listed(F.concat(*pii.BASE)).alias("l")).collect()}
    assert got == {i: ",".join(brute_spans(t)) for i, t in enumerate(texts)}


def test_pii_disclosing_terms(spark):
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice("the of and with from into over under near what when".split()) for _ in range(12))
    rows = [(i, f"{filler()} Zorblatt boss@acme.example {filler()}") for i in range(6)] + [(10 + i, filler()) for i in range(60)] + [(99, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert all("Zorblatt" not in out[i] and "[EMAIL]" in out[i] for i in range(6))
    assert all(out[i] == t for i, t in rows[6:])


def test_pii_terms_of_real_documents(spark):
    """The terms that the production parameters disclose on sf0.01 with names beside addresses in some documents, near copies of one
    text with another address among them, against counts of distinct texts by hand."""
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(i, f"{t} Zorblatt{'abc'[i % 3]} writes boss{i % 3}@acme.example" if t and i % 20 < 3 else t) for i, t in real]
    rows += [(-k, f"{real[5][1]} only{'xyz'[k % 3]} here versions@acme.example") for k in range(1, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = pii.find_base(docs).filter("text is not null").cache()
    got = {(r["entity"], r["term"]): r["pmi"] for r in pii.disclosures(docs, some).collect()}
    assert {t for e, t in got if "boss" in e} >= {"zorblatta", "zorblattb", "zorblattc"} and not any("versions" in e for e, _ in got)
    n, n_e, n_t, n_et, sizes = 0, Counter(), Counter(), Counter(), {}
    terms_of = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", t or "") if len(w) >= 3}
    for t in {r["text"] for r in docs.collect() if r["text"] is not None}:
        n += 1
        n_t.update(terms_of(t))
    for t, entities in {r["text"]: {f"{x['kind']}:{x['value']}" for k in pii.BASE for x in r[k]} for r in some.collect()}.items():
        n_e.update(entities)
        n_et.update((e, x) for e in entities for x in terms_of(t) if x not in e.lower())
        for e in entities:
            sizes.setdefault(e, []).append(len(terms_of(t)))
    others = lambda k: (k - 1) / (n - 1)
    pmi = {(e, t): np.log(others(k) / others(n_e[e]) / others(n_t[t])) for (e, t), k in n_et.items() if k > 1}
    def sure(k, m):
        p, z = (k - 1) / (m - 1), 1.645 / np.sqrt(m - 1)
        return (p + z * z / 2 - z * np.sqrt(p * (1 - p) + z * z / 4)) / (1 + z * z)

    want = {k: v for k, v in pmi.items() if (np.log(sure(n_et[k], n_t[k[1]])) - np.log(others(n_e[k[0]]))) * 1.5 >= -np.log(others(n_e[k[0]]))}
    many = Counter(e for e, _ in want)
    want = {k: v for k, v in want.items() if many[k[0]] <= max(3, 0.05 * np.mean(sizes[k[0]]))}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_pii_words_of_one_text_stay(spark):
    """However rare they are: no other text says that they belong to the address. Copies are one text."""
    rows = [(i, f"filler words of page number {i % 7} and {i}") for i in range(2000)]
    for copies in (1, 50):
        own = [(10_000 + i, "Contact bob@acme.example about the ordinary garden picnic on Saturday afternoon") for i in range(copies)]
        out = [r["text"] for r in pii.sanitised(spark.createDataFrame(rows + own, "doc_id long, text string")).collect() if r["doc_id"] >= 10_000]
        assert out == ["Contact [EMAIL] about the ordinary garden picnic on Saturday afternoon"] * copies


def test_pii_counts_of_copies(spark):
    """A term beside an entity in several texts discloses it, be each there once or a hundred times; their other words stay."""
    rows = [(i, f"filler words of page number {i % 7} and {i}") for i in range(2000)]
    rest = ["about garden plans", "on a rainy Tuesday", "from the harbour office", "with kind regards"]
    for copies in (1, 100):
        own = [(10_000 + i, f"Zorblatt writes boss@acme.example {r}") for i, r in enumerate(rest * copies)]
        rows += [(5_000 + i, f"she writes {r} number {i}") for i, r in enumerate(rest * 10)]
        out = [r["text"] for r in pii.sanitised(spark.createDataFrame(rows + own, "doc_id long, text string")).collect() if r["doc_id"] >= 10_000]
        assert sorted(set(out)) == sorted(f" writes [EMAIL] {r}" for r in rest) and len(out) == len(own)


def test_pii_versions_count_as_one_text(spark):
    """Where versions of a text hold an entity, a name beside it in other texts still goes, and the versions' words stay."""
    rows = [(i, f"filler words of page number {i % 7} and {i}") for i in range(2000)]
    for versions in (3, 40):
        rng = random.Random(versions)
        word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
        base = [word() for _ in range(30)]
        edited = [" ".join(word() if rng.random() < 0.1 else w for w in base) for _ in range(versions)]
        other = [" ".join(word() for _ in range(20)) for _ in range(4)]
        own = [f"{t} Zorblatt boss@acme.example" for t in [*edited, *other]]
        docs = spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(own)], "doc_id long, text string")
        out = {r["doc_id"] - 10_000: r["text"] for r in pii.sanitised(docs).collect() if r["doc_id"] >= 10_000}
        assert out == {i: f"{t}  [EMAIL]" for i, t in enumerate([*edited, *other])}


def test_language_gradients_and_accuracy(spark):
    m, rng = language_id.ByteBiGRU(3, 4), np.random.default_rng(1)
    x, y = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.loss(x, y)
    for k, w in m.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        w[i] += 1e-3
        up, _ = m.loss(x, y)
        w[i] -= 2e-3
        down, _ = m.loss(x, y)
        w[i] += 1e-3
        assert abs(g[k][i] - (up - down) / 2e-3) < 1e-4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, languages = language_id.train(language_id.training_rows(docs, ~registry.held_out()))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and of that with this")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model, languages).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"
    assert len(language_id.label_positions(model, languages, "é" * 70)) == 140
    held = docs.filter(registry.held_out() & F.col("lang").isNotNull())
    right = language_id.identify(held, model, languages).join(held.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").count()
    assert right >= 0.95 * held.count()


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/x?q"), (4, "http://a.example.net/en/1#t"), (5, "http://b.org/fr/"), (6, "http://example.com/de/x"), (7, "http://bad.site.com/"), (8, "http://good.site.com"), (9, "http://notexample.net?x"), (7, "http://bad.site.com/")]
    rows += [(100 + i, "http://bad.site.com/p") for i in range(50)] + [(200 + i, "http://good.site.com/p") for i in range(50)]
    outcomes = [(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(50)] + [(3, None), (None, 1)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    want = {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/x", "net/", "block"), 4: ("a.example.net", "/en/1", "example.net/en/", "allow"), 5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("example.com", "/de/x", "example.com/de/", "block"), 7: ("bad.site.com", "/", None, "block"), 8: ("good.site.com", "", None, "allow"), 9: ("notexample.net", "", None, "allow")}
    assert {k: tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) for k in want} == want


def test_url_reputation_of_unseen_hosts(spark):
    """A host without outcomes goes with its domain: blocked where that is bad beyond doubt, allowed elsewhere."""
    rows = [(1, "http://new.bad.io/x"), (2, "http://new.fine.io/x"), (3, "http://elsewhere.org/")]
    rows += [(100 + i, f"http://h{i % 20}.bad.io/p") for i in range(400)] + [(1000 + i, f"http://h{i % 20}.fine.io/p") for i in range(400)]
    outcomes = [(100 + i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(400)]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 100, 1000)] == ["block", "allow", "allow", "block", "allow"]
    assert got[1]["mean"] > 0.9 and got[2]["mean"] < 0.1 and 0.3 < got[3]["mean"] < 0.7


def test_warc(spark, tmp_path):
    big, rows = "é" * 600, []
    rows = [(1, "http://a", big), (5, None, big), (3, "u\r\nx", big), (2, "b", "small"), (4, "b", "small"), (6, "c", None), (7, "d", "x" * 200_000), (None, "e", big)]
    rows += [(10 + i, "f", f"page {i} " + "lorem ipsum " * 90) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write(pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    assert archives.count() > 1
    got = {r["page_id"]: r for r in warc.read(archives, payloads=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 5
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        assert revisit or bytes(got[i]["payload"]) == raw


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix dark jugs of lively phosphorescent quartz tonight."
    edited = item.replace("quick", "quikc").replace("seven", "sevn")
    rows = [(1, "xx " * 50 + item.upper() + " yy" * 9), (2, edited), (3, item[:30]), (4, None), (5, ""), (6, "clean text " * 40), (7, "\n".join(item.split())), (1, "again " + item)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}) == [(1, 1), (2, 1), (7, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 4, 5, 6]


def test_short_and_repetitive_passages(spark, monkeypatch):
    """Short passages are found whole, with edits in proportion, those without a q-gram as whole texts; counting in parts counts alike."""
    items = [(1, "is it true"), (2, "yes"), (3, "a" * 300), (4, " "), (5, "12345678"), (6, "One  Quite ordinary short passage")]
    texts = ["well, Is  it TRUE or not", "is it trua", "yes", "yes sir", "b" + "a" * 500, "", "x12345678y", "say: one quite ordinary short passage.", "one quite ordinary shart passage"]
    want = {(0, 1), (2, 2), (4, 3), (6, 5), (7, 6), (8, 6)}
    for hits in (decontaminate.HITS, 50):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        found = decontaminate.Passages(items).find(texts)
        assert set(found) == want and found[7, 6] == (0, 5, 37) and all(x[0] == (k == (8, 6)) for k, x in found.items())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def fewest_edits(segment, text):
    """Of an alignment of a segment with any part of a text, every cell of the table."""
    cost = np.zeros(len(text) + 1, int)
    ramp = np.arange(len(text) + 1)
    chars = np.frombuffer(text, np.uint8)
    for j, c in enumerate(segment, 1):
        new = np.append(j, np.minimum(cost[1:] + 1, cost[:-1] + (chars != c)))
        cost = np.minimum.accumulate(new - ramp) + ramp
    return cost.min()


def test_decontamination_against_all_alignments():
    """Every (text, passage) where a segment lies within its edits, no other, and the fewest edits; excerpts of 59 bytes always."""
    rng = random.Random(5)
    letters = "abcdef gh"
    line = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, "x" + line(n - 2) + "y") for k, n in enumerate((8, 15, 16, 26, 27, 38, 49, 50, 59, 60, 79, 80, 81, 119, 170, 300))]
    texts = ["", items[-1][1][:150], items[-1][1][150:]]  # the parts of one passage in two texts that adjoin
    for _, item in items * 6:
        at = rng.randrange(max(1, len(item) - 50))
        part = list(item[at : at + rng.choice((50, 59, 70, 100, 300))])
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice(([], [rng.choice(letters)], [part[k], "z"]))
        texts.append(line(rng.randrange(30)) + "".join(part) + line(rng.randrange(30)))
    want = {}
    for number, text in enumerate(map(decontaminate.normal, texts)):
        for k, item in items:
            raw = decontaminate.normal(item)
            for size, step in [grid for grid in decontaminate.GRIDS if grid[0] <= len(raw)] or [(len(raw), 1)]:
                most = min(int(size * decontaminate.EDITS), (size - 8) // 8)
                for at in {*range(0, len(raw) - size + 1, step), len(raw) - size}:
                    if (edits := fewest_edits(raw[at : at + size], text)) <= most:
                        want[number, k] = min(edits, want.get((number, k), edits))
    got = decontaminate.Passages(items).find(texts)
    assert {key: x[0] for key, x in got.items()} == want and 40 < len(want) < len(texts)
    cut = decontaminate.normal(items[-1][1])
    excerpts = [cut[at : at + 59].decode().strip() for at in range(len(cut) - 58)]
    found = decontaminate.Passages(items[-1:]).find(excerpts)
    assert len(found) >= len([x for x in excerpts if len(x) == 59])


def test_rows_without_an_id(spark):
    """A null id is no exemption, and a contaminated row takes no other row of its id along."""
    item = "The quick brown fox jumps over the lazy dog while seven wizards mix dark jugs of lively phosphorescent quartz tonight."
    rows = [(None, f"mail boss@acme.example or +1 234 567 8901: {item}"), (None, "write to a@b.example now"), (1, item), (1, "clean"), (None, "clean"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in decontaminate.decontaminated(docs, bench).collect()]
    assert sorted(left, key=str) == sorted([rows[1], *rows[3:]], key=str)
    out = [r["text"] for r in pii.sanitised(docs).collect()]
    assert len(out) == len(rows) and not any("@" in t or "8901" in t for t in out if t)


def test_quality_counts(spark, odd):
    text = "a b c a b c\nx #|\nx #|\n\n"
    assert quality_rules.counts_of(text)[:5] == (10, 12, 4, 1, 6)
    assert {r["n_words"] for r in quality_rules.text_statistics(odd).collect() if r["doc_id"] in (5, 6)} == {0}
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    rules = quality_rules.learn_rules(x, (x[:, 0] > 0.8) & (x[:, 1] < 0.5), ["u", "v"])
    assert len(rules) == 1 and {c[0] for c in rules[0]} == {"u", "v"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    stats = quality_rules.judged(s := quality_rules.text_statistics(docs), quality_rules.fit_rules(s, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = docs.join(stats.filter("kept").select("doc_id"), "doc_id")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(kept).collect()}
    assert kept.count() > len({*groups.values()})
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids == {i for i, g in groups.items() if i == g and i not in leaks}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_with_odd_columns(spark, tmp_path):
    """Columns named like the stages' own come through, rows without an id take part, an empty table stays empty."""
    names = ["kept", "n_words", "rule", "base_failed", "clean", "row", "_row", "n", "th", "content", "component"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.union(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long"))).select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names))
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for where, rows in (("odd", odd), ("none", odd.limit(0))):
        rows.write.parquet(f"file://{tmp_path}/{where}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{where}/labels.parquet")
        bench.write.parquet(f"file://{tmp_path}/{where}/benchmark.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, f"file://{tmp_path}/odd")
        assert now.columns == odd.columns
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in now.collect() for c in names)
    want = {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()} >= {(i, s) for i, s in want if i is not None}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
