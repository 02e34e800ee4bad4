import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gemello.llm import labelled, quality_mil, toxicity_crf

VOCABULARY = [f"{a}{b}" for a in ("ta", "ro", "mi", "len", "so") for b in ("ka", "ne", "du", "vi", "par", "los")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)) + "."


def corpus(n=400, seed=3):
    """(doc_id, text, quality, toxic): junk has marks in part of the text, toxic texts hold words of two stems."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        text = prose(rng, rng.randint(60, 200))
        if not quality:
            text += "\n" + " ".join(w + "###" for w in prose(rng, 80).split())
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grob", "zwist"]) + rng.choice(["", "ka", "ne", "du", "vi"]) + "x")
            text = " ".join(words)
        rows.append((i, text, quality, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").cache()
    return rows, docs, labels


def test_quality_on_held_out_rows(tables):
    rows, docs, labels = tables
    out = quality_mil.classified(docs, labels).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == len(rows) and 50 < len(held) < 120
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_toxicity_on_held_out_rows(tables):
    rows, docs, labels = tables
    out = toxicity_crf.classified(docs, labels).collect()
    want = {r[0]: r[3] for r in rows}
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97


def test_toxic_spans(tables):
    rows, docs, labels = tables
    model = toxicity_crf.learned(docs, labels)
    out = toxicity_crf.scored(docs, model).collect()
    found = [r.text.lower()[s.start : s.end] for r in out for s in r.spans]
    assert len(found) > 100 and np.mean([w.startswith(("grob", "zwist")) for w in found]) > 0.97


def test_long_chains_against_a_plain_recursion():
    rng = np.random.default_rng(2)
    size = np.array([500, 3, 64, 65, 129, 1, 300])
    emission, move = rng.normal(-1, 2, size.sum()), rng.normal(0, 1.5, (2, 2))
    first = np.cumsum(size) - size
    got, pairs = toxicity_crf.marginals(emission, first, size, move)
    want, moves = [], np.zeros((2, 2))
    for f, n in zip(first, size):
        step = [np.exp(move) * np.array([1, np.exp(e)]) for e in emission[f : f + n]]
        ahead, back = [np.array([1.0, 0.0])], [np.ones(2)]
        for m in step:
            ahead.append(ahead[-1] @ m / (ahead[-1] @ m).sum())
        for m in reversed(step):
            back.append(m @ back[-1] / (m @ back[-1]).sum())
        back.reverse()
        for k in range(n):
            both = ahead[k + 1] * back[k + 1]
            want.append(both[1] / both.sum())
            joint = ahead[k][:, None] * step[k] * back[k + 1]
            moves += joint / joint.sum()
    assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_a_sentence_is_one_chain_whatever_its_length():
    t = toxicity_crf.tokens(pa.array(["word " * 500 + ". end", "x"]))
    assert t.size.tolist() == [500, 1, 1]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    emission, move = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2))
    first, size = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, pairs = toxicity_crf.marginals(emission, first, size, move)
    want, moves = np.zeros(9), np.zeros((2, 2))
    for f, n in zip(first, size):
        weights, paths = [], []
        for code in range(1 << n):
            path = [(code >> k) & 1 for k in range(n)]
            steps = list(zip([0, *path[:-1]], path))
            weights.append(np.exp(sum(move[a, b] for a, b in steps) + sum(emission[f + k] for k in range(n) if path[k])))
            paths.append((path, steps))
        for w, (path, steps) in zip(np.array(weights) / sum(weights), paths):
            want[f : f + n] += w * np.array(path)
            for a, b in steps:
                moves[a, b] += w
    assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_attention_sums_to_one_and_gradient_learns():
    x, bag = quality_mil.passages(pa.array(["a b c " * 100, None, "", "one"], pa.string()))
    assert np.diff(bag).tolist() == [7, 1, 1, 1]
    model = quality_mil.fitted(["a b c d e f"] * 20 + ["# $ % & # $"] * 20, [1] * 20 + [0] * 20)
    p, a = model.score(x, bag)
    assert np.allclose(np.add.reduceat(a, bag[:-1]), 1) and p.shape == (4,)
    q, _ = model.score(*quality_mil.passages(pa.array(["x y z u v w", "# # $ $ % %"])))
    assert q[0] > 0.7 > 0.3 > q[1]


@pytest.mark.parametrize("module", [quality_mil, toxicity_crf])
def test_defined_results(spark, tables, module):
    _, docs, labels = tables
    odd = spark.createDataFrame([(None, "x", "a"), (1, None, "a"), (1, None, "a"), (2, "", "a"), (3, "word " * 30000, "a")], "doc_id long, text string, score string")
    out = module.classified(odd, labels.limit(0)).collect()
    assert len(out) == 5 and not any(r.held_out for r in out if r.doc_id is None)
    model = module.learned(docs, labels)
    both = module.scored(odd, model).collect()
    assert len(both) == 5 and all(0 <= r.score <= 1 for r in both) and both[1].score == both[2].score
    assert module.scored(odd.limit(0), model).count() == 0


def test_sample_holds_nothing_out(spark, tables):
    rows, docs, labels = tables
    import zlib

    texts, values = labelled.sample(docs, labels, "toxic", 3, 1, {1: 20, 0: 30})
    ids = {t: i for i, t, _, _ in rows}
    assert values.count(1) == 20 and values.count(0) == 30 and all(zlib.crc32(str(ids[t]).encode()) % 3 != 1 for t in texts)
    assert labelled.sample(docs, labels, "toxic", 3, 1, {1: 20, 0: 30}) == (texts, values)


def test_long_texts_are_sampled_and_the_bound_is_on_all_characters(spark):
    docs = spark.createDataFrame([(i, "long word " * (8000 if i % 2 else 3)) for i in range(40)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, values = labelled.sample(docs, labels, "toxic", 3, 1, {1: 50, 0: 50})
    assert any(len(t) > 70_000 for t in texts) and set(values) == {0, 1}
    few, _ = labelled.sample(docs, labels, "toxic", 3, 1, {1: 50, 0: 50}, 250_000)
    assert 0 < sum(map(len, few)) <= 250_000 < sum(map(len, texts)) and set(few) <= set(texts)


def test_pipeline_stages(spark, tables, tmp_path):
    rows, docs, labels = tables
    copies = docs.where("doc_id < 30").selectExpr("doc_id + 1000 as doc_id", "concat(text, ' end') as text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s0", 0), (None, "lone words here", "en", None, 15)], docs.schema)
    docs.unionByName(copies).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as score", "'z' as taken")
    toxic, junk = {r[0] for r in rows if r[3]}, {r[0] for r in rows if not r[2]}
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert len(toxic & seen[0]) <= 0.05 * len(toxic) and len({r[0] for r in rows} - toxic - seen[0]) <= 5
    clean = {r[0] for r in rows} - toxic - junk
    assert len(junk & seen[1]) <= 0.05 * len(junk) + 2 and len(clean - seen[1]) <= 6
    assert not {d for d in seen[2] if d is not None and 1000 <= d < 1030 and d - 1000 in seen[1]} and clean & seen[1] <= seen[2]
    assert seen[4] == seen[3] <= seen[2] and set(now.columns) == {"doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in final.collect()) == sorted((r.doc_id or -1, r.n_tokens) for r in now.collect())
