import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gemello.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "a", "aaaaaaaa", " a  b\n\n c\r\n", "it's we'll 'S 's's d'don", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "été 日本語 😀 ²Ⅷ12", "\x00\x1c\x85", "   ", "#" * 500, "ab" * 3000]


ALIKE = [ODD[1]]
for _ in range(10):
    ALIKE[0] += ALIKE[0].translate(str.maketrans("ab", "ba"))
ALIKE.append(ALIKE[0].translate(str.maketrans("ab", "ba")))  # polynomial hashes modulo 2**64 can't tell these apart
ODD += [" " + " ".join(ALIKE), " ".join(ALIKE[::-1]), "word " * 40000, "lorem" * 6000]


def same(texts):
    b = bpe.loaded(PATH)
    ids, at = b.encode(pa.array(texts, pa.string()))
    ref = [r.ids for r in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:e].tolist() for a, e in zip(at, at[1:])] == ref
    assert b.decode(ids, at) == [LIBRARY.decode(r, skip_special_tokens=False) for r in ref]


def test_odd_texts():
    same(ODD + [None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sdmtlrve#1é")), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    same(texts)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    same(ODD)


def test_forgets_words_but_not_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    b = bpe.Bpe(PATH)
    for t in ["one two three four five six", "seven eight one two nine ten eleven"]:
        ids, _ = b.encode(pa.array([t]))
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_digests_with_clashing_columns(spark):
    rows = [(i, t, "old", 7) for i, t in enumerate(ODD)] + [(None, None, None, None), (0, "", "old", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    out = bpe.digests(df, PATH).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "ids_sha256", "n_tokens", "decoded_sha256"}
    for r in out:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_encoded_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    assert all(r.text == r.decoded for r in bpe.encoded(df, PATH).collect())


def test_histogram_answers_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(0, 5000, 400)] + [7] * 50 + [0, 0]
    hist = token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    got = {r.length: r for r in token_counts.limits(hist).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_up_to == sum(x <= limit for x in lengths) and r.docs_longer == sum(x > limit for x in lengths)
        assert r.tokens_up_to == sum(x for x in lengths if x <= limit) and r.tokens_longer == sum(x for x in lengths if x > limit)
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths) and r.total_tokens == sum(lengths)
    asked = {r.context_limit: r for r in token_counts.at_limits(hist, [1, 100, 10**6]).collect()}
    for limit, r in asked.items():
        assert (r.docs_longer, r.truncated_tokens) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    ordered = sorted(lengths)
    for r in token_counts.quantiles(token_counts.limits(hist), [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.length == ordered[max(0, -(-int(round(r.share * len(ordered) * 1000)) // 1000) - 1)]


def test_lengths_and_empty_histogram(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.lengths(df, PATH, keep=["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}
    assert token_counts.limits(token_counts.histogram(token_counts.lengths(df.limit(0), PATH))).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
