"""Token counts and cross-tokenizer alignment, held against the libraries and brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import alignment, token_counts, vocab

from .helpers import SCHEMA, rows_of, sentence

PARTS = ["a", "Zq", "the", "don't", "'s", "'ll", "'re", "'", "''", "'x", " ", "  ", "\n", " \n", "\t\t", "　", " ", "7", "12", "١",
         "½", "!", "?!", "-", "<|endoftext|>", "<|endof", "é", "é", "中文", "\U0001d518", "\U0001f600", "�", "▁", "'ſ",
         "ß", "'S", "'d'm", "\x00", "\x7f", "​", "՘", "0x1F", "__", "<s>", "</s>", "supercalifragilistic"]


@pytest.fixture(scope="module")
def wild():
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["".join(map(chr, rng.sample(every, 40))) for _ in range(300)]
    return [*texts, "", None, "<|endoftext|>", " <|endoftext|> x", "<|endoftext|><|endoftext|>", "x" * 70_000, " " * 5000 + "y"]


@pytest.fixture(scope="module")
def byte_level():
    return vocab.read("byte_bpe_50k.json")


def test_counts_are_those_of_the_library(spark, wild, byte_level):
    docs = spark.createDataFrame(rows_of(wild), SCHEMA).repartition(3)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, keep=["doc_id"]).collect()}
    library = vocab.byte_level_tokenizer(byte_level, special=True)
    for k, text in enumerate(wild):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = got[k + 1]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text or "").encode()), n > 1024), text


def test_pre_tokens_are_those_of_the_library(wild, byte_level):
    library = vocab.byte_level_tokenizer(byte_level, special=False)
    cutter = token_counts.PreTokens(library)
    for text in wild:
        if text:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, _ = cutter.cut(raw, np.array([0, len(raw)]))
            want = [len(text[:s].encode()) for _, (s, _) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert starts.tolist() == want, text


def test_the_shortcut_holds_only_strings_that_are_one_token(byte_level):
    found = token_counts.prove(byte_level)
    library = vocab.byte_level_tokenizer(byte_level, special=False)
    one = 0
    for token in vocab.byte_level_tokens(byte_level)[:3000]:
        try:
            text = (token or b"\xff").decode()
        except UnicodeDecodeError:
            continue
        raw = np.frombuffer(token, np.uint8)
        h = token_counts.W.span_hashes(raw, np.array([0]), np.array([len(raw)]))
        # a string of several pre-tokens may be merged as one, but never is one pre-token
        if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert found.has(h, np.array([len(raw)]))[0] == (len(library.encode(text).ids) == 1)
            one += 1
    assert one > 2000


def test_counts_of_odd_rows(spark, odd, clash, empty, byte_level):
    got = token_counts.token_counts(odd, keep=["doc_id"]).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id == 2} == {0}
    wide = token_counts.token_counts(clash.withColumn("n_tokens", F.lit("x")).withColumn("__x", F.lit(1)))
    assert set(wide.columns) == {*clash.columns, "__x", "n_bytes", "n_tokens", "over_limit"} - {"text"}
    assert sorted(r.n_tokens for r in wide.collect()) == sorted(r.n_tokens for r in got)
    assert token_counts.token_counts(empty).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.prove(vocab.read("word_bpe_49k.json"))


def brute(texts, byte_level):
    """Alignment by walking over both token lists of every text."""
    lib_a = vocab.byte_level_tokenizer(byte_level, special=False)
    lib_b = vocab.piece_tokenizer(vocab.read("piece_bpe_32k.model"))
    bytes_a, bytes_b = vocab.byte_level_tokens(byte_level), vocab.piece_tokens(lib_b)
    links, out = [], []
    for text in texts:
        want = b" " + (text or "").encode()
        a = lib_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = lib_b.encode(text) if text else []
        if not text or b"".join(bytes_a[x] for x in a) != want or b"".join(bytes_b[x] for x in b) != want:
            links.append([])
            out.append(None)
            continue
        groups, own, i, j, end_a, end_b = [], [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                end_a += len(bytes_a[a[i]])
                ga.append(a[i])
                i += 1
            else:
                end_b += len(bytes_b[b[j]])
                gb.append(b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                own.append((ga[-1], gb[-1]))
                ga, gb = [], []
        links.append(own)
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(x for own in links for x in own)
    most = collections.defaultdict(int)
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else
            (o[0], o[1], o[2], len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), o[3])
            for o, own in zip(out, links, strict=True)]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment_is_that_of_a_walk(spark, wild, byte_level, rng, frequent):
    texts = [sentence("de", 30, rng) for _ in range(40)] + wild[:250] + wild[1500:1560] + wild[-7:]
    texts += texts[:30] * 3 + [texts[0]] * 40
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, params=alignment.AlignParams(frequent=frequent)).collect()}
    want = brute(texts, byte_level)
    assert [got[k + 1] for k in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) > 200 and any(w[0] == 0 and t for w, t in zip(want, texts, strict=True))


def test_alignment_of_odd_rows(spark, odd, clash, empty):
    got = alignment.align(odd)
    assert sorted(got.columns) == sorted(alignment.align(clash).columns)
    rows = got.collect()
    assert len(rows) == odd.count() and {(r.n_a, r.groups_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, "")}
    assert len({(r.n_a, r.count_sum) for r in rows if r.doc_id in (9, 10)}) == 1
    assert alignment.align(empty).collect() == []
