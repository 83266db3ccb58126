"""Operators 11 and 12 against loops over the libraries' own results."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers as P
import pyarrow.orc as orc
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import token_alignment, token_files

SF = "/root/testdata/sf0.001"
ODD = [(1, "Hello, world! Hello again."), (1, "Hello, world! Hello again."), (None, "no id  here"), (2, None), (3, ""), (4, "low▁line"), (5, "nul\0 byte"), (6, "<|endoftext|> <s> <0x41> </s>"), (7, "x" * 3000), (8, "日本語のテキスト 😀😀 été"), (9, " "), (10, "\n\n\tindented  code\r\n"), (11, "".join(random.Random(3).choices("abcdefghij", k=4000))), (12, "ﬁ ½ Å")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, [1], "x", 2) for i, t in ODD], "doc_id long, text string, row int, pairs array<int>, links string, n_a int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_alignment(rows):
    """By sets of ends and loops over groups."""
    byte = {}
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            byte[chr(b)] = b
        else:
            byte[chr(spare)] = b
            spare += 1
    ta = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = []
    for i, text in rows:
        groups = []
        if text:
            a = [(x, bytes(byte[c] for c in ta.id_to_token(x))) for x in ta.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) and tb.is_byte(x) else p.replace("▁", " ").encode()) for x in tb.encode(text) for p in [tb.id_to_piece(x)]]
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                ends = []
                for side in (a, b):
                    at, out = 0, []
                    for _, t in side:
                        at += len(t)
                        out.append(at)
                    ends.append(out)
                both = sorted(set(ends[0]) & set(ends[1]))
                groups = [([x for (x, _), e in zip(a, ends[0]) if lo < e <= hi], [x for (x, _), e in zip(b, ends[1]) if lo < e <= hi]) for lo, hi in zip([0, *both], both)]
        docs.append((i, groups))
    count = Counter(p for _, g in docs for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, g in docs:
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        listing = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(listing.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs, hot", [(1 << 21, 17), (50, 4)])
@pytest.mark.parametrize("table", ["odd", "documents"])
def test_alignment(spark, odd, monkeypatch, table, pairs, hot):
    """Also with pairs in many parts and few hot pairs. Short texts, so that the loops end."""
    monkeypatch.setattr(token_alignment, "PAIRS", pairs)
    monkeypatch.setattr(token_alignment, "HOT_BITS", hot)
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 3000)
    got = token_alignment.alignment(docs)
    assert dict(got.dtypes) == {"doc_id": "bigint", **{c: "bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups_sha256": "string"}
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(w[1] for w in want) and (table != "odd" or sum(w[1] == 0 for w in want) >= 3)


def test_alignment_of_a_stretch_without_cuts():
    """Parts of pairs: every pair of a document in one part only, whatever the size of a group."""
    pair = token_alignment.load(P.path(token_alignment.DEFAULT_A), P.path(token_alignment.DEFAULT_B))
    texts = ["".join(random.Random(k).choices("日本語テキスト学中", k=800)) for k in range(3)] + ["", "a b"]
    old, token_alignment.PAIRS = token_alignment.PAIRS, 100
    try:
        numbers, parts = token_alignment.aligned(pair, texts)
        seen, links = Counter(), Counter()
        for doc, key, n in parts:
            seen.update(zip(doc.tolist(), key.tolist()))
            for d, x in zip(doc.tolist(), n.tolist()):
                links[d] += x
    finally:
        token_alignment.PAIRS = old
    assert set(seen.values()) == {1}
    assert [links[k] for k in range(5)] == numbers["n_links"].tolist()


def test_alignment_of_nothing(empty):
    assert token_alignment.alignment(empty).collect() == []


def brute_files(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = token_files.filed(docs)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = brute_files(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    assert sorted(map(tuple, got.collect())) == want


def test_token_files_of_odd_rows(odd, empty):
    """Ties in any order of theirs, nulls first."""
    got = sorted(map(tuple, token_files.filed(odd).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in brute_files(ODD))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert token_files.filed(empty).collect() == []


def scanned(frame):
    """Rows that the scans of an executed query gave."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_files_prune_and_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    docs = spark.range(0, 24000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hex(F.xxhash64("id", F.lit(k))) for k in range(3))).alias("text")).repartition(5)
    token_files.write_tokens(docs, str(tmp_path / "t"), files=3)
    files = sorted((tmp_path / "t").glob("*.orc"))
    read = [orc.ORCFile(f) for f in files]
    assert len(files) == 3 and all(f.nstripes > 1 and f.row_index_stride == token_files.STRIDE and f.compression == "ZSTD" for f in read)
    firsts = [f.read(columns=["doc_id"]).column(0).to_pylist() for f in read]
    assert sum(firsts, []) == list(range(0, 24000, 2))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        assert [r["doc_id"] for r in token_files.lookup(spark, str(tmp_path / "t"), [7000]).collect()] == [7000]
        assert 0 < scanned(token_files.lookup(spark, str(tmp_path / "t"), [7000])) <= token_files.STRIDE
        absent = [7001, 11003, 901]  # between ids that are there: only the Bloom filters know
        assert token_files.lookup(spark, str(tmp_path / "t"), absent).count() == 0
        assert sum(scanned(token_files.lookup(spark, str(tmp_path / "t"), [i])) for i in absent) == 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
        assert spark.read.orc(str(tmp_path / "t")).rdd.getNumPartitions() > 2 * len(files)  # tasks begin at stripes
        everything = sorted(map(tuple, token_files.read_tokens(spark, str(tmp_path / "t")).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r[1] for r in everything] == [sum(n for *_, n, _ in everything[:k]) for k in range(0, 1)] + [r[1] + r[2] for r in everything[:-1]]
    whole = [x for r in everything for x in r[3]]
    for a, b in ((0, 10), (len(whole) // 3 - 5, len(whole) // 3 + 700), (len(whole) - 3, len(whole) + 50), (len(whole), len(whole) + 1)):
        part = sorted(map(tuple, token_files.stretch(spark, str(tmp_path / "t"), a, b).collect()))
        assert [x for r in part for x in r[3]] == whole[a:b]
        assert not part or part[0][1] == a
