"""Tokenizer operators against the libraries and plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import align, bpe, middle, queries
from loomgraph.llm.minimal_hash import PairHash, build, shard_of
from loomgraph.llm.pieces import PieceEncoder, Splitter
from loomgraph.llm.textcodes import mix

FOLDER = "/root/testdata/sf0.001"
# Letters and digits that Unicode versions know or do not, marks, joined scripts, whitespace of all kinds.
ODD = ["ͰႠ࢏౜ a౜b 1\U00011de0 2", "\x1c\x1d \x85\xa0 x  \n\n y\t", "don't we'LL it's 'S", "x" * 300, " ", "\n", "é‍👩‍👩‍👧 漢字かな", "ab" * 500 + "\x00\x01"]
LONG = "".join(random.Random(1).choice("abcdefgh ") if i % 5000 else "\n" for i in range(60_000)) + "z" * 9_000


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*ODD, LONG])], "doc_id bigint, text string, id int, ids string")


@pytest.fixture(scope="module")
def library():
    with open(bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_merge_is_the_plain_loop(library):
    ranks = library[1]
    merger = bpe.Merger.of_ranks(ranks)
    draw = random.Random(7)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in [1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 200]:
        for letters in (b"a", b"ab", b"etaoin shr", bytes(range(256))):
            piece = bytes(draw.choice(letters) for _ in range(n))
            assert bpe.merge([ranks[bytes([c])] for c in piece], merger._order, merger._merged) == plain(piece)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for letters in ("ab", "etaoin shr", "éß漢") for _ in range(200)]
    assert merger(texts) == [np.array(plain(t.encode()) if t.encode() not in ranks else [ranks[t.encode()]], "<u4").tobytes() for t in texts]


def test_bpe_is_the_library_and_comes_back(spark, documents, odd, tricky, library):
    encoding = library[0]
    for df in (documents, odd, tricky):
        want = sorted(
            (str(r["doc_id"]), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"] or ""))
            for r in df.collect()
            for ids in [encoding.encode_ordinary(r["text"] or "")]
        )
        got = bpe.bpe_report(df)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_bpe_of_no_rows_and_unknown_ids(spark, empty):
    assert bpe.bpe_report(empty).collect() == []
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id int, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad).collect()


def test_pieces_of_long_texts_come_in_stretches(monkeypatch):
    split = Splitter()
    whole = [p for part in split(LONG) for p in part]
    monkeypatch.setattr("loomgraph.llm.pieces.LONG", 100)
    monkeypatch.setattr("loomgraph.llm.pieces.STRETCH", 7)
    parts = list(split(LONG))
    assert max(map(len, parts)) == 7 and [p for part in parts for p in part] == whole and "".join(whole) == LONG


def test_memo_may_be_emptied_at_any_time(monkeypatch, library):
    encoding, ranks = library
    merger = bpe.Merger.of_ranks(ranks)
    for memo, stretch in ((1 << 18, 1 << 18), (3, 5), (0, 1)):
        monkeypatch.setattr("loomgraph.llm.pieces.MEMO", memo)
        monkeypatch.setattr("loomgraph.llm.pieces.STRETCH", stretch)
        encode = PieceEncoder(merger).encode
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encode(["", *ODD])] == [encoding.encode_ordinary(t) for t in ["", *ODD]]


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_is_the_plain_rule(spark, documents, odd, tricky):
    marks = spark.createDataFrame([(i, t) for i in range(60) for t in ("a <P> b", "x <P", "P> <S", "< <M >é ü")], "doc_id int, text string")
    for df in (documents, odd, tricky, marks):
        want = sorted((str(r["doc_id"]), *map(str, plain_middle(r["doc_id"], r["text"]))) for r in df.collect())
        out = middle.fill_in_middle(df)
        assert sorted(tuple(map(str, r)) for r in out.collect()) == want
        back = sorted(sha(r["text"] or "") for r in df.collect())
        assert sorted(r["restored_sha256"] for r in middle.middle_report(df).collect()) == back
    forms = {r["form"] for r in middle.fill_in_middle(documents).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_middle_of_no_rows(empty):
    assert middle.middle_report(empty).collect() == []


def test_minimal_hash_gives_every_key_its_own_place():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 47, 50_000))
    bits = 3
    number = shard_of(mix(keys.astype(np.uint64)), bits)
    parts = [build(keys[number == s]) for s in range(1 << bits)]
    table = PairHash([(s, w) for s, w, _ in parts], 0, bits, [k for _, _, k in parts])
    assert sorted(table.places(keys)) == list(range(len(keys)))
    strangers = np.setdiff1d(rng.integers(0, 1 << 47, 50_000), keys)
    assert (table.places(strangers) == -1).all()
    assert sum(w.nbytes for _, w, _ in parts) * 8 < 5 * len(keys)
    assert len(build(np.zeros(0, np.int64))[2]) == 0 and list(build(np.array([7]))[2]) == [7]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(align.BYTE_MODEL)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=align.PIECE_MODEL)
    a_bytes = align.byte_vocabulary(open(align.BYTE_MODEL, "rb").read())[1].tokens.to_pylist()
    out, links = [], []
    for doc_id, text in rows:
        a = b = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes[i] for i in a) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
                a = b = []
        ends_a, ends_b, at = {}, {}, 0
        for k, i in enumerate(a):
            at += len(a_bytes[i])
            ends_a[at] = k
        at = 0
        for k, _ in enumerate(b):
            at += len(b_bytes[k])
            ends_b[at] = k
        both = sorted(ends_a.keys() & ends_b.keys())
        groups, x, y = [], 0, 0
        for end in both:
            groups.append(",".join(map(str, a[x : ends_a[end] + 1])) + "|" + ",".join(map(str, b[y : ends_b[end] + 1])))
            x, y = ends_a[end] + 1, ends_b[end] + 1
        out.append((doc_id, len(a), len(b), len(groups), ";".join(groups)))
        links.append([(a[ends_a[e]], b[ends_b[e]]) for e in both])
    count = Counter(p for one in links for p in one)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        (str(d), na, nb, ng, len(one), sum(count[p] == best[p[1]] for p in one), sum(count[p] for p in one), sha(g) if g else "")
        for (d, na, nb, ng, g), one in zip(out, links)
    )


@pytest.mark.parametrize("pairs_at_once, shard_pairs", [(align.PAIRS, align.SHARD_PAIRS), (2_000, 64)])
def test_alignment_is_the_plain_rule(spark, documents, odd, tricky, monkeypatch, pairs_at_once, shard_pairs):
    monkeypatch.setattr(align, "SHARD_PAIRS", shard_pairs)
    for df in (documents.repartition(5), odd.unionByName(tricky.select("doc_id", "text", F.lit(1).alias("id"), F.lit("").alias("ids"))).repartition(3)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = align.align_report(df, pairs_at_once=pairs_at_once)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_alignment(rows)


def test_alignment_of_no_rows(empty):
    assert align.align_report(empty).collect() == []


def test_byte_level_ids_are_the_library(documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(align.BYTE_MODEL)
    model.encode_special_tokens = True
    encode = PieceEncoder(align.byte_vocabulary(open(align.BYTE_MODEL, "rb").read())[0]).encode
    every = ["".join(map(chr, range(lo, lo + 0x100))) + "'s" for lo in [*range(0, 0xD800, 0x100), *range(0xE000, 0x20000, 0x100)]]
    texts = [*ODD, LONG, *every, *(r["text"] or "" for r in documents.collect())]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_are_plain_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<s> </s> <0x41> ▁x")], "doc_id int, text string")
    got = sorted((str(r[0]), *r[1:]) for r in align.align_report(df).collect())
    assert got == plain_alignment([(1, "a <|endoftext|> b"), (2, "<s> </s> <0x41> ▁x")])
    assert got[1][1:3] == (0, 0) and got[0][1] > 5


def test_queries_are_registered():
    assert {"op11_token_alignment", "op12_fill_in_middle", "op13_byte_bpe"} <= queries.QUERIES.keys()
    assert "op12_fill_in_middle" in queries.ORACLES


def test_rising_ids_take_less_than_six_bytes():
    from loomgraph.llm import ngramlm

    rng = np.random.default_rng(4)
    ids = np.sort(rng.integers(0, 1 << 48, 4_000).astype(np.uint64))
    for x in (ids, ids[:0], ids[::-1].copy(), np.concatenate([ids[:9], ids[:3], np.array([0, (1 << 48) - 1], np.uint64)])):
        assert np.array_equal(ngramlm._unpack_rising(ngramlm._pack_rising(x)), x)
    assert len(ngramlm._pack_rising(ids)) < 5.2 * len(ids)
