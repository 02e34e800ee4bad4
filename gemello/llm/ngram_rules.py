"""Quality rules: counts and repeats of whole texts, and perplexity bands of a corpus n-gram model.

The model is a modified Kneser-Ney model of order ORDER over text symbols, one for each language: letters without case,
a digit, the common marks and white space are symbols of their own, all other code points share hashed symbols, so an
alphabet has 64 symbols and an n-gram packs into 6 * ORDER bits. Spark counts every n-gram of every document; lower
orders are continuation counts of the next higher order. The model is stored in sorted arrays of hashed n-grams with
their interpolated probabilities, which has at most 64 ** ORDER entries a language whatever the corpus (`MOST_ENTRIES`
is checked before it is broadcast; beyond it groups of languages are scored one after another, and the segments of odd
documents by each group's models in turn, so that the bound doesn't change any result).
A document's perplexity is judged by its language's band: the median log-perplexity of all its documents, plus and minus
WIDE times the spread between the quartiles and the median, times 1 + SHORT / words as a mean over few words varies
more. Medians and quartiles come from exact counts in bins. A document that looks odd to its own language's model may
hold passages of other languages: its segments are then also scored by the other models, each against that model's own
mean, and the upper bound holds for the mean of the best of them (`best_perplexity`).
That model is bounded, so it can't know words. Beside it all neighbouring pairs of words of the corpus are counted in
partitioned tables that grow with it (`word_pairs`): `pair_rarity` is minus the mean logarithm of 0.5 + how often a
text's pairs stand in other texts, and has an upper bound of the same kind (PAIRS_WIDE, PAIRS_SHORT), so that a text whose
symbols look right but whose words or their order are no other text's is rejected.

Defined results: null and empty texts have no words, counts of 0 and no perplexity (never rejected by the band, but by
the base rule); a null language is one of its own; repeated rows are documents of their own; an empty table gives an
empty result; other columns pass only where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm import word_pairs
from gemello.llm.text import SPACE, appended, flat, hashes, mix, release, runs, slices, through, words

ORDER = 4
BITS = 6
MOST_ENTRIES = 1 << 22
FLUSH = 1 << 20
BIN = 0.005
#: Chosen on half of the labelled rows of sf0.1 (even doc_id): the most junk found with at most one good document in 800 rejected.
WIDE = (8.0, 5.5)
SHORT = 50.0
#: No good document of the same rows is rejected by these alone.
PAIRS_WIDE, PAIRS_SHORT = 3.0, 100.0
ODD, SEGMENT = 0.1, 200
#: Symbols: 0 pads the beginning; letters 1-26, digit 27, space 28, line end 29, then marks, then hashed others.
MARKS = ".,;:!?'\"()-/#*$%&|<>"

RULES = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rules(col: pa.Array, window: int = 8) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = flat(col)
    n = len(col)
    starts, ends, at = words(data, offsets)
    lead = np.append(0, np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data]))
    chars = lead[offsets[1:]] - lead[offsets[:-1]]
    marks = np.append(0, np.cumsum(_SYMBOL[data]))
    symbols = marks[offsets[1:]] - marks[offsets[:-1]]
    h = hashes(data, starts, ends)
    # lines: equal to an earlier one of the same text, with a word in it
    first, last = runs(data != 10, offsets)
    own = np.searchsorted(offsets, first, "right") - 1
    filled = np.append(0, np.cumsum(~SPACE[data]))
    line = filled[last] > filled[first]
    first, last, own = first[line], last[line], own[line]
    key = hashes(data, first, last) ^ mix(own.astype(np.uint64))
    dup = np.zeros(n, np.int64)
    if len(key):
        _, index = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[index] = False
        dup = np.bincount(own[again], minlength=n)
    # words in windows that occur twice or more in the text
    repeat = np.zeros(n, np.int64)
    if len(h) >= window:
        w = h[: len(h) - window + 1].copy()
        for k in range(1, window):
            w = mix(w) + h[k : len(h) - window + 1 + k]
        doc = np.repeat(np.arange(n), np.diff(at))
        inside = doc[: len(w)] == doc[window - 1 :]
        place = np.flatnonzero(inside)
        key = mix(w[place]) ^ mix(doc[place].astype(np.uint64) + np.uint64(1))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        many = place[counts[inverse] > 1]
        edge = np.bincount(many, minlength=len(h) + 1) - np.bincount(many + window, minlength=len(h) + 1)
        covered = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
        repeat = covered[at[1:]] - covered[at[:-1]]
    return [np.diff(at), chars, symbols, dup, repeat]


def alphabet() -> np.ndarray:
    """The symbol of each code point below 0x250; others are hashed."""
    table = np.zeros(0x250, np.uint64)
    for c in range(0x250):
        ch = chr(c).lower()[0]
        if "a" <= ch <= "z":
            table[c] = ord(ch) - 96
        elif ch.isdecimal() and c < 128:
            table[c] = 27
        elif c == 10:
            table[c] = 29
        elif ch.isspace():
            table[c] = 28
        elif ch in MARKS:
            table[c] = 30 + MARKS.index(ch)
        else:
            table[c] = 50 + ord(ch[0]) % 14
    return table


_TABLE = alphabet()


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of all texts, one ending at each symbol, and each text's offsets in them."""
    data, offsets = flat(col)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    at = lead[offsets]
    symbol = np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], (50 + points % 14).astype(np.uint64))
    once = np.ones(len(points), bool)  # runs of the same mark or white space are one symbol, else they look predictable
    once[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] < 28) | (symbol[1:] >= 50)
    once[at[:-1][at[:-1] < len(points)]] = True
    symbol, at = symbol[once], np.append(0, np.cumsum(once))[at]
    points = symbol
    where = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
    packed = symbol.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(points), np.uint64)
        before[k:] = symbol[:-k]
        before[where < k] = 0
        packed |= before << np.uint64(BITS * k)
    return packed, at


def counts(documents: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram stands in the texts of each language."""

    def run(batches):
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for at, size in slices(batch, 1):
                part = batch.slice(at, size)
                packed, ends = grams(part.column(1))
                langs = part.column(0).to_pylist()
                for lang in dict.fromkeys(langs):
                    own = [packed[ends[i] : ends[i + 1]] for i, x in enumerate(langs) if x == lang]
                    gram, n = np.unique(np.concatenate(own), return_counts=True)
                    if lang in held:
                        old, m = held[lang]
                        both, place = np.unique(np.concatenate([old, gram]), return_inverse=True)
                        gram, n = both, np.bincount(place, np.concatenate([m, n])).astype(np.int64)
                    held[lang] = gram, n
                if sum(len(g) for g, _ in held.values()) > FLUSH:
                    yield from out()
        yield from out()
        release()

    parts = through(documents.select(F.col("lang").cast("string").alias("lang"), "text"), run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted arrays for the highest order (hash, log-probability), and for contexts (the probability of unseen symbols)."""

    keys: np.ndarray
    logs: np.ndarray
    lower: list[tuple[np.ndarray, np.ndarray]]  # for each lower order: hashes of n-grams, interpolated probabilities
    back: list[tuple[np.ndarray, np.ndarray]]  # for each order from the highest: hashes of contexts, weights of the next lower order
    mean: float  # log-perplexity of the counts that the model comes from

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        """Natural log of P(last symbol | the symbols before it) of packed n-grams, backing off where unseen."""
        got, found = _look(self.keys, self.logs, _hashed(gram, 0))
        out = np.where(found, got, 0.0)
        miss = np.flatnonzero(~found)
        g, weight = gram[miss], np.ones(len(miss))
        done = np.zeros(len(miss))
        open_ = np.ones(len(miss), bool)
        for k in range(ORDER - 1):
            w, seen = _look(*self.back[k], _hashed(g >> np.uint64(BITS), 1 + k))
            weight = np.where(open_ & seen, weight * w, weight)
            g = g & np.uint64((1 << BITS * (ORDER - 1 - k)) - 1)
            p, there = _look(*self.lower[k], _hashed(g, 8 + k))
            done = np.where(open_ & there, np.log(np.maximum(weight * p, 1e-30)), done)
            open_ &= ~there
        unseen = self.back[-1][1][0] / (1 << BITS)  # of the order without a context
        done = np.where(open_, np.log(np.maximum(weight * unseen, 1e-30)), done)
        out[miss] = done
        return out


def _hashed(gram: np.ndarray, salt: int) -> np.ndarray:
    return mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return values[at], keys[at] == asked


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def fitted(gram: np.ndarray, n: np.ndarray) -> Model:
    """A modified Kneser-Ney model of the counts of all n-grams of the highest order."""
    gram, n = gram.astype(np.uint64), n.astype(np.int64)
    levels = [(gram, n)]
    for k in range(1, ORDER):  # continuation counts: by how many symbols an n-gram of the order below is preceded
        kept = levels[-1][0] & np.uint64((1 << BITS * (ORDER - k)) - 1)
        levels.append(np.unique(kept, return_counts=True))
    # from the lowest order up: probabilities interpolated with the order below
    below: tuple[np.ndarray, np.ndarray] | None = None
    probs, weights = [], []
    for k in range(ORDER - 1, -1, -1):
        g, c = levels[k]
        n1, n2, n3, n4 = (max(1, int((c == i).sum())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])
        context = g >> np.uint64(BITS)
        ctx, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, c)
        cut = d[np.minimum(c, 3)]
        weight = np.bincount(inverse, np.minimum(cut, c)) / total
        p = np.maximum(c - cut, 0) / total[inverse]
        if below is None:
            p = p + weight[inverse] / (1 << BITS)
        else:
            low, there = _look(*below, g & np.uint64((1 << BITS * (ORDER - 1 - k)) - 1))
            p = p + weight[inverse] * np.where(there, low, 1 / (1 << BITS))
        below = (g, p)
        probs.append((g, p))
        weights.append((ctx, weight))
    probs.reverse()
    weights.reverse()
    keys, logs = _sorted(_hashed(probs[0][0], 0), np.log(probs[0][1]))
    lower = [_sorted(_hashed(g, 8 + k), p) for k, (g, p) in enumerate(probs[1:])]
    back = [_sorted(_hashed(c, 1 + k), w) for k, (c, w) in enumerate(weights)]
    return Model(keys, logs, lower, back, float(-(n * np.log(probs[0][1])).sum() / max(n.sum(), 1)))


def models(grams_of: DataFrame) -> dict[str | None, Model]:
    rows = grams_of.toArrow()
    out = {}
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    codes = langs.indices.fill_null(len(langs.dictionary)).to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, int)
    names = [*langs.dictionary.to_pylist(), None]
    gram, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    for code in np.unique(codes).tolist():
        own = codes == code
        out[names[code]] = fitted(gram[own], n[own])
    return out


def scored(documents: DataFrame, model: dict[str | None, Model], keep: list[str], model_fields: bool = True, among_all: bool = True) -> DataFrame:
    """documents[keep] with the rules' counts, log_perplexity (a mean over the text's symbols; null without a model or text) and best_perplexity.

    Where `model` hasn't all languages (not among_all), odd_mean stands in place of best_perplexity: the own model's mean for odd documents, else null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(cols: list[pa.Array]) -> list:
        packed, at = grams(cols[0])
        langs = cols[1].to_pylist()
        total = np.zeros(len(packed))
        known = np.zeros(len(langs), bool)
        for lang in dict.fromkeys(langs):
            if (m := shared.value.get(lang)) is None:
                continue
            own = np.array([x == lang for x in langs])
            known |= own
            inside = np.repeat(own, np.diff(at))
            gram, inverse = np.unique(packed[inside], return_inverse=True)
            total[inside] = m.log_prob(gram)[inverse]
        sums = np.append(0, np.cumsum(total))
        n = np.diff(at)
        mean = -(sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)
        best = mean.copy()
        own_mean = np.array([m.mean if (m := shared.value.get(x)) else np.inf for x in langs])
        odd = np.flatnonzero(known & (n > 0) & (mean > own_mean + ODD))
        if not among_all:
            plain = np.ones(len(mean), bool)
            plain[odd] = False
            return [*rules(cols[0]), pa.array(mean, mask=~(known & (n > 0))), pa.array(own_mean, mask=plain)]
        if len(odd):
            best[odd] = own_mean[odd] + _best_segments(packed, at[odd], n[odd], list(shared.value.values()))
        none = ~(known & (n > 0))
        return [*rules(cols[0]), pa.array(mean, mask=none), pa.array(np.minimum(best, mean), mask=none)]

    d = documents.select(*dict.fromkeys([*keep, "text", "lang"])).withColumn("lang", F.col("lang").cast("string"))
    fields = [*RULES, T.StructField("log_perplexity", T.DoubleType()), T.StructField("best_perplexity" if among_all else "odd_mean", T.DoubleType())]
    return appended(d, ["text", "lang"], fields, work, [*dict.fromkeys([*keep, "lang"])])


def _least(packed: np.ndarray, first: np.ndarray, size: np.ndarray, some_models: list[Model]) -> np.ndarray:
    """Of all segments of texts given by their n-grams' ranges, the least excess over a model's own mean."""
    where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    gram, inverse = np.unique(packed[np.repeat(first, size) + where], return_inverse=True)
    begin = np.flatnonzero(where % SEGMENT == 0)
    length = np.diff(np.append(begin, len(where)))
    excess = [-np.add.reduceat(m.log_prob(gram)[inverse], begin) - m.mean * length for m in some_models]
    return np.min(excess, axis=0)


def _best_segments(packed: np.ndarray, first: np.ndarray, size: np.ndarray, all_models: list[Model]) -> np.ndarray:
    """Of texts given by their n-grams' ranges, the mean over segments of the least excess over a model's own mean."""
    least = np.append(0, np.cumsum(_least(packed, first, size, all_models)))
    ends = np.cumsum(-(-size // SEGMENT))
    return (least[ends] - least[ends - -(-size // SEGMENT)]) / size


def segments(texts: DataFrame, some_models: list[Model]) -> DataFrame:
    """key, segment, excess and n_grams of each segment of texts (key, text): its least excess over the mean of one of some_models."""
    shared = texts.sparkSession.sparkContext.broadcast(some_models)

    def run(batches):
        for batch in batches:
            for at, size in slices(batch, 1):
                part = batch.slice(at, size)
                packed, ends = grams(part.column(1))
                n = np.diff(ends)
                parts = -(-n // SEGMENT)
                least = _least(packed, ends[:-1], n, shared.value)
                place = np.arange(len(least)) - np.repeat(np.cumsum(parts) - parts, parts)
                row = np.repeat(np.arange(len(n)), parts)
                length = np.minimum(n[row] - place * SEGMENT, SEGMENT)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place), pa.array(least), pa.array(length)], names=["key", "segment", "excess", "n_grams"])
        release()

    return through(texts.select("key", "text"), run, "key string, segment long, excess double, n_grams long")


def bands(log_perplexity: DataFrame, wide: tuple[float, float] = WIDE, of: str = "log_perplexity") -> list[tuple[str | None, float, float, float]]:
    """(lang, median, how far below, how far above) from exact counts in bins of BIN over all documents of at least 20 words."""
    hist = log_perplexity.where(F.col(of).isNotNull() & (F.col("n_words") >= 20)).groupBy("lang", F.floor(F.col(of) / BIN).alias("bin")).count().collect()
    by: dict[str | None, list[tuple[int, int]]] = {}
    for r in hist:
        by.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = []
    for lang, own in by.items():
        own.sort()
        upto = np.cumsum([n for _, n in own])
        q = [(own[int(np.searchsorted(upto, s * upto[-1]))][0] + 0.5) * BIN for s in (0.25, 0.5, 0.75)]
        out.append((lang, q[1], wide[0] * max(q[1] - q[0], 2 * BIN), wide[1] * max(q[2] - q[1], 2 * BIN)))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or ""))


def judged(documents: DataFrame, keep: list[str], wide: tuple[float, float] = WIDE, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """documents[keep] with the rules' counts, log_perplexity, best_perplexity, pair_rarity, in_band, base_failed and kept."""
    from gemello.llm.text import shared_dir, written

    spark = documents.sparkSession
    where = shared_dir(spark)
    pairs = written(word_pairs.known(documents), f"{where}/pairs")
    documents = documents.withColumn("__text", F.xxhash64("text"))
    table = written(counts(documents), f"{where}/grams")
    sizes = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}
    groups: list[list[str | None]] = [[]]
    for lang in sorted(sizes, key=lambda x: (x is None, x or "")):
        if groups[-1] and sum(sizes[x] for x in groups[-1]) + sizes[lang] > most_entries:
            groups.append([])
        groups[-1].append(lang)
    def among(own: list[str | None]):
        names = [x for x in own if x is not None]
        return F.when(F.col("lang").isNull(), F.lit(None in own)).otherwise(F.col("lang").cast("string").isin(names))

    if len(groups) == 1:
        out = scored(documents, models(table), [*keep, "__text"])
    else:  # odd documents meet the models of all groups, one group at a time; equal texts of a language share a key
        text_of = F.md5(F.concat(F.coalesce(F.hex(F.col("lang").cast("string")), F.lit("-")), F.lit(" "), F.col("text")))
        keyed = documents.withColumn("__key", text_of)
        own_scores, excess = None, None
        for i, own in enumerate(groups):  # the first also takes languages without any n-gram
            picked = keyed.where(~among([x for g in groups[1:] for x in g]) if i == 0 else among(own))
            part = written(scored(picked, models(table.where(among(own))), [*keep, "__text", "__key"], among_all=False), f"{where}/own{i}")
            own_scores = part if own_scores is None else own_scores.unionByName(part)
        odd_keys = own_scores.where("odd_mean is not null").select("__key").distinct()
        odd = written(keyed.join(odd_keys, "__key", "left_semi").select(F.col("__key").alias("key"), "text").dropDuplicates(["key"]), f"{where}/odd")
        for i, own in enumerate(groups):
            part = written(segments(odd, list(models(table.where(among(own))).values())), f"{where}/segments{i}")
            excess = part if excess is None else excess.unionByName(part)
        least = excess.groupBy("key", "segment").agg(F.min("excess").alias("excess"), F.first("n_grams").alias("n_grams"))
        best = least.groupBy(F.col("key").alias("__key")).agg((F.sum("excess") / F.sum("n_grams")).alias("__best"))
        out = own_scores.join(best, "__key", "left").withColumn("best_perplexity", F.least("log_perplexity", F.col("odd_mean") + F.col("__best"))).drop("__key", "odd_mean", "__best")
    rare = -F.col("total") * word_pairs.UNIT / (F.col("n_words") - 1)
    out = out.join(pairs, F.col("__text") == F.col("key"), "left").withColumn("pair_rarity", rare).drop("__text", "key", "total")
    marked = written(out, f"{where}/scores")
    rarities = {lang: (middle, above) for lang, middle, _, above in bands(marked, (0.0, PAIRS_WIDE), "pair_rarity")}
    limits = [(*x, *rarities.get(x[0], (None, None))) for x in bands(marked, wide)]
    frame = spark.createDataFrame(limits, "band_lang string, middle double, below double, above double, rare_middle double, rare_above double")
    known = marked.join(frame, marked["lang"].eqNullSafe(frame["band_lang"]), "left")
    room = 1 + SHORT / F.greatest(F.col("n_words"), F.lit(1))
    off = F.col("log_perplexity") - F.col("middle")
    over = F.col("best_perplexity") - F.col("middle")
    in_band = F.coalesce((off >= -F.col("below") * room) & (over <= F.col("above") * room), F.lit(True))
    rare_room = 1 + PAIRS_SHORT / F.greatest(F.col("n_words"), F.lit(1))
    in_band &= F.coalesce(F.col("pair_rarity") - F.col("rare_middle") <= F.col("rare_above") * rare_room, F.lit(True))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    columns = [*keep, *(f.name for f in RULES), "log_perplexity", "best_perplexity", "pair_rarity"]
    return known.select(*columns, in_band.alias("in_band"), failed.alias("base_failed"), (~failed & in_band).alias("kept"))
