import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gemello.llm import license_scan, ngram_rules, source_mix, word_pairs



def thue_morse(n):
    """A word of 2**n letters that polynomial hashes modulo 2**64 can't tell from its complement."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


ALIKE = [thue_morse(10), thue_morse(10).translate(str.maketrans("ab", "ba"))]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "# a$ b%% | <c>\nx\nx\n \n \nx ",
    "a b c d e f g h i j k l m n o p q r s t u v",
    "a b c d e f g h " * 3,
    "p q r s t u v w x " + "a b c d e f g h i " + "y z " + "a b c d e f g h i",
    "é ü ß\n" * 30,
    "w " * 5000,
    "n1 " + " ".join(f"k{i}" for i in range(20000)),
    "a\x0bb\x0cc\x1cd e",
]


def brute_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_rules_against_brute_force():
    got = np.array(ngram_rules.rules(pa.array(TEXTS, pa.string()))).T.tolist()
    assert got == [brute_rules(t) for t in TEXTS]


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcd e"), 4000))
    packed, _ = ngram_rules.grams(pa.array([text]))
    gram, n = np.unique(packed, return_counts=True)
    model = ngram_rules.fitted(gram, n)
    for context in [*np.unique(gram >> np.uint64(6))[:20].tolist(), 0o77_77_77]:
        every = np.array([(context << 6) | s for s in range(64)], np.uint64)
        assert abs(np.exp(model.log_prob(every)).sum() - 1) < 0.02


def test_rules_judge_documents(spark):
    rng = random.Random(4)
    syllables = ["ta", "ro", "mi", "len", "so", "ka"]
    good = [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(120)) for _ in range(150)]
    bad = [" ".join("".join(rng.choices("qxz9&%$", k=6)) for _ in range(120)) for _ in range(4)]
    rows = [(i, t, "xx", 1) for i, t in enumerate(good + bad)] + [(900, None, None, 1), (901, "", "xx", 1), (901, "", "xx", 1), (902, "short", "yy", 1), (None, good[0], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    out = ngram_rules.judged(df, ["doc_id"]).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].kept for i in range(150)) and not any(by[150 + i].kept for i in range(4))
    assert all(by[i].base_failed and by[i].log_perplexity is None for i in (900, 901)) and by[902].base_failed
    one_by_one = {(r.doc_id, r.kept, round(r.log_perplexity or 0, 9)) for r in ngram_rules.judged(df, ["doc_id"], most_entries=1).collect()}
    assert one_by_one == {(r.doc_id, r.kept, round(r.log_perplexity or 0, 9)) for r in out}
    assert ngram_rules.judged(df.limit(0), ["doc_id"]).count() == 0


def test_passages_of_other_languages():
    rng = random.Random(4)
    prose = lambda syllables, n: [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(120)) for _ in range(n)]
    one, two = prose(["ta", "ro", "mi", "len", "so", "ka"], 60), prose(["ouz", "ez", "vuy", "wyx"], 60)

    def model(texts):
        return ngram_rules.fitted(*np.unique(ngram_rules.grams(pa.array(texts))[0], return_counts=True))

    models = [model(one), model(two)]
    packed, at = ngram_rules.grams(pa.array([one[0] + " " + two[0], " ".join("".join(rng.choices("qxz9&%$", k=6)) for _ in range(120)), one[1]]))
    alone = [-models[0].log_prob(packed[a:b]).mean() - models[0].mean for a, b in zip(at, at[1:])]
    best = ngram_rules._best_segments(packed, at[:-1], np.diff(at), models)
    assert alone[0] > 0.5 and best[0] < 0.3 and best[1] > 1 and abs(best[2]) < 0.1


def test_license_scan(spark):
    mit = dict(license_scan.TEMPLATES[2:3])["mit"]
    words = mit.split()
    broken = " ".join(words[:30] + ["really"] + words[30:60] + words[62:])
    texts = {
        1: "MIT License here. The Mit-License again",
        2: "intro words " + mit + " tail",
        3: "intro words " + broken + " tail",
        4: "Licensed under CC BY-NC 4.0.",
        5: "licensed under the terms",
        6: "gnu general public license and apache license",
        7: None,
        8: "",
        9: "mit license",
        10: "filler " * 30000 + "apache license",
        11: "permission of any person to the software in conditions",
        12: "intro " + " ".join(words[:25] + ["other"] * 20 + words[45:70]) + " tail",
        13: " ".join(words[:16] + ["other"] * 40 + words[56:59]),
    }
    rows = [(*r, "x") for r in texts.items()] + [(4, texts[4], "x"), (None, texts[1], "x"), (4, "nothing to see", "x"), (None, "plain words", "x")]
    out = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.n_words not in (2, 3) or r.doc_id not in (4, None)}
    plain = [r for r in out if r.doc_id in (4, None) and r.n_words in (2, 3)]  # rows that share an id with another row, or lack one
    assert len(plain) == 2 and all((r.labels, r.score, r.n_base) == ("", 0.0, 0) for r in plain)
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (2, 0, 4, "mit")
    assert by[2].labels == by[3].labels == "mit" and by[2].base_labels == "" and by[2].score == 1.0 and 0.8 < by[3].score < 1
    assert (by[4].labels, by[4].score, by[5].labels, by[6].labels) == ("cc-by-nc", 1.0, "", "apache,gpl")
    assert by[7].n_words == by[8].n_words == 0 and by[7].first_word is None and by[9].labels == "" and (by[10].first_word, by[10].n_words) == (30000, 30002)
    assert by[11].labels == "" and by[None].base_labels == "mit"
    assert by[12].labels == by[13].labels == "mit" and by[12].score < 0.5
    span = [s for s in license_scan.spans(license_scan.keyed(spark.createDataFrame([(2, texts[2])], "doc_id long, text string"))).collect() if s.template == 2]
    assert len(span) == 1 and (span[0].start, span[0].end) == (2, 2 + len(license_scan._hashes_of(mit)))
    assert license_scan.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_base_places_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["mit", "MIT", "license", "License", "apache", "general", "public", "lic\u00e9nse", "x", thue_morse(10), thue_morse(10).translate(str.maketrans("ab", "ba"))]
    texts = [None, "", *["".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)], "mit " * 30000 + "license", "m" * 40000 + " apache license"]
    out = {r.doc_id: r for r in license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        hits = [(p, label) for phrase, label in license_scan.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        got = out[i]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None)
        assert got.base_labels == ",".join(sorted({label for _, label in hits})) and set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(","))


def test_targets():
    sources = source_mix.targets([("b", 100), (None, 50), ("a", 10), ("c", 0)])
    assert [s.name for s in sources] == ["a", "b", "c", None]
    assert sources[0].target == 20 and sources[2].target == 0
    assert abs(sum(s.target for s in sources) - 240) < 1e-9 and all(s.target <= 2 * s.size for s in sources)
    assert source_mix.targets([]) == []


def brute_taken(sources, docs):
    """Words of each document that a prefix of its source's repeated stream takes."""
    out = {}
    for i, s in enumerate(sources):
        goal = min(round(s.target), 2 * s.size)
        rounds, rest = divmod(goal, s.size) if s.size else (0, 0)
        for d in docs:
            if d.sid == i:
                out[d.doc_id, d.row] = rounds * d.size + min(max(rest - d.start, 0), d.size)
    return out


@pytest.mark.parametrize("block", [7, 64, 512])
def test_mix_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(300)] + [(7, "b", 40)] * 3 + [(None, None, 9)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, size long, mark long")
    mix = source_mix.mix(df, block)
    taken = mix.taken().collect()
    placed = mix.documents.collect()
    assert {(r.doc_id, r.row): r.taken for r in taken} == brute_taken(mix.sources, placed)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in taken) == sorted((d is None, d or 0, s or "", n) for d, s, n in rows)
    for s in mix.sources:
        own = [r for r in taken if r.source == s.name]
        assert abs(sum(r.taken for r in own) - s.target) <= 1 and all(r.taken <= 2 * r.size and r.source_size == s.size for r in own)
    again = sorted((r.doc_id or 0, r.size, r.taken) for r in source_mix.mix(df.repartition(3), block).taken().collect())
    assert again == sorted((r.doc_id or 0, r.size, r.taken) for r in taken)
    slots = mix.slots.collect()
    assert len({r.slot for r in slots}) == len(slots) and len({(r.sid, r.epoch, r.block) for r in slots}) == len(slots)


def test_schedule_is_spread_evenly(spark):
    sources = [source_mix.Source("a", 40_000, 60_000.0), source_mix.Source("b", 20_000, 20_000.0), source_mix.Source("c", 10_000, 20_000.0)]
    slots = sorted((r.slot, r.sid) for r in source_mix.schedule(spark, sources, 100).collect())
    for n in (100, 333, 700):
        first = [sid for slot, sid in slots if slot < n]
        assert all(abs(first.count(i) - n * share) <= 6 for i, share in enumerate((0.6, 0.2, 0.2)))


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(1, "a  b\nc d", "s", 8), (2, None, "s", 0), (3, "e f", None, 3)], "doc_id long, text string, source string, n_chars long")
    taken = spark.createDataFrame([(1, 4, 6), (2, 0, 0), (3, 2, 2)], "doc_id long, size long, taken long")
    named = docs.withColumn("name", F.col("doc_id"))
    out = sorted((r.text, r.n_chars) for r in source_mix.mixed_rows(named, taken.withColumnRenamed("doc_id", "name"), ["name"]).collect())
    assert out == [("a  b", 4), ("a  b\nc d", 8), ("e f", 3)]


@pytest.mark.parametrize("stored", [True, False])
def test_rows_of_equal_ids_and_texts_are_mixed_each(spark, tmp_path, stored):
    rows = [(1, "a b c", "s", "x")] * 3 + [(None, "a b c", "s", "y")] * 3 + [(None, None, None, "z"), (4, "d e", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _metadata string").repartition(2)
    if stored:
        docs.drop("_metadata").write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    named, by = source_mix.named_rows(docs)
    assert named.select(*by).distinct().count() == len(rows)
    mix = source_mix.mix(source_mix.sized(named, ["doc_id", "source", *by]), block=2)
    out = source_mix.mixed_rows(named, mix.taken(), by)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[x.name] - x.target) <= 1 for x in mix.sources) and sum(x.size for x in mix.sources) == 20


def test_empty_mix(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long, mark long")
    assert source_mix.mix(df).taken().count() == 0
    sized = source_mix.sized(spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string"), ["doc_id", "source"])
    assert {r.doc_id: r.size for r in sized.collect()} == {1: 2, 2: 0}
    assert source_mix.mix(sized.where(F.col("size") == 0)).taken().first().taken == 0


def test_models_by_groups_give_the_same_rows(spark):
    rng = random.Random(5)
    prose = lambda syllables, n: [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(120)) for _ in range(n)]
    many = lambda letters: ["".join(rng.choices(letters, k=3)) for _ in range(200)]
    one, two, three = prose(["ta", "ro", "mi", "len", "so", "ka"], 60), prose(many("bcdefgh"), 200), prose(many("pquvwxyz"), 200)
    mixed = [one[0] + " " + two[0], one[1] + " " + three[0]]
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "a") for t in one + mixed + mixed[:1]] + [(t, "b") for t in two] + [(t, None) for t in three] + [("", "d"), (None, "a")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shown = lambda most: {r.doc_id: (r.kept, r.in_band, round(r.best_perplexity or 0, 9), round(r.log_perplexity or 0, 9)) for r in ngram_rules.judged(df, ["doc_id"], most_entries=most).collect()}
    whole = shown(ngram_rules.MOST_ENTRIES)
    assert len(whole) == len(rows) and all(whole[i][2] < whole[i][3] - 0.1 for i in range(60, 63)), [whole[i] for i in range(60, 63)]
    assert shown(1) == whole


SF01 = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test data here")
def test_bands_on_labelled_rows_not_used_for_them(spark):
    documents, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")
    rows = ngram_rules.judged(documents, ["doc_id"]).where("not base_failed").join(known, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    junk, good = n[0, False] + n[0, True], n.get((1, False), 0) + n[1, True]
    assert n[0, False] >= 0.55 * junk and n.get((1, False), 0) <= 0.003 * good


def test_pair_totals_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "one", "A b", "a b c a b", "a b c a b", *[" ".join(rng.choices("aBcde", k=rng.randrange(1, 60))) for _ in range(50)]]
    split = [re.findall(r"\S+", (t or "").lower()) for t in texts]
    every = collections.Counter(p for w in split for p in zip(w, w[1:]))
    want = {}
    for t, w in zip(texts, split):
        own = collections.Counter(zip(w, w[1:]))
        if own:
            want[t] = sum(n * round(np.log(every[p] - n + 0.5) / word_pairs.UNIT) for p, n in own.items())
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for bucket in (word_pairs.BUCKET, 100):
        monkeypatch.setattr(word_pairs, "BUCKET", bucket)
        got = {r.text: r.total for r in df.distinct().withColumn("key", F.xxhash64("text")).join(word_pairs.known(df), "key").collect()}
        assert got == want


def test_shuffled_words_are_rejected(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices(["ta", "ro", "mi", "len", "so", "ka"], k=3)) for _ in range(200)]
    follow = {w: rng.choices(vocabulary, k=4) for w in vocabulary}

    def prose(n):
        out = [rng.choice(vocabulary)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    good = [prose(200) for _ in range(150)]
    shuffled = [rng.sample(prose(200), 200) for _ in range(4)]
    df = spark.createDataFrame([(i, " ".join(w), "xx") for i, w in enumerate(good + shuffled)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in ngram_rules.judged(df, ["doc_id"]).collect()}
    assert sum(by[i].kept for i in range(150)) >= 148
    assert not any(by[150 + i].kept or by[150 + i].base_failed for i in range(4))
