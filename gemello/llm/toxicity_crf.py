"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are runs of letters and digits, lower-cased; a sentence (up to a full stop, mark or line end, of any length) is a
chain of two states; long chains go block by block, from exact messages between their blocks. Each state's emission sums the weights of the token's features, the whole word and
its beginnings of some lengths in bytes, where it goes on beyond them; transitions join neighbours. Forward-backward
marginals of every token of the whole text give the offending offsets; the document's score is a logistic function of
their largest, their sum, their evidence (log-odds above a floor) and its density, fitted on a part of the sample that
the tagger it sees wasn't fitted on.

Documents carry labels, tokens don't; token labels follow from them by significance: features whose documents are toxic
beyond chance are chosen, the toxic documents that they explain are set aside, and those left are looked at again until
nothing significant is found. Tokens with a chosen feature in a toxic document are labelled toxic, all others not; toxic
documents that stay unexplained don't take part.

Learning takes at most SAMPLE[value] labelled documents of each label value (see labelled.sample); the model holds only
features of that sample, by 64-bit hash, so that no other word shares their weights. Defined results: null and empty
texts score 0; equal texts have equal scores; an empty table gives an empty result; without toxic labels every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gemello.llm.labelled import held_out, sample
from gemello.llm.text import appended, flat, hashes, mix, release, runs

SAMPLE = {1: 1200, 0: 2400}
BLOCK = 64
STEP_TOKENS = 1 << 18  # chains of about so many tokens are held at once while learning
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
CHANCE = 0.05
STEPS, RATE, DECAY = 30, 0.5, 2e-4
LEAST_SEEN, RIDGE = 3, 0.005
TOXIC, FLOOR = 0.5, 5.0

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[97:123] = _TOKEN[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Tokens:
    """The tokens of texts: word types, each token's type, its bytes, and the sentences as ranges of tokens."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray  # each text's offsets in the tokens
    kind: np.ndarray
    features: np.ndarray  # of each type
    first: np.ndarray  # of each sentence, the first token
    size: np.ndarray


def tokens(col: pa.Array) -> Tokens:
    data, offsets = flat(pc.utf8_lower(col) if len(col) else col)
    starts, ends = runs(_TOKEN[data], offsets)
    at = np.searchsorted(starts, offsets)
    words, example, kind = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[example], ends[example]
    features = np.empty((len(words), 1 + len(BEGINNINGS)), np.uint64)
    features[:, 0] = words
    for i, n in enumerate(BEGINNINGS, 1):
        longer = e - s > n
        features[:, i] = np.where(longer, mix(hashes(data, s, np.minimum(s + n, e)) + np.uint64(n)), 0)
    stops = np.append(0, np.cumsum(_STOP[data]))
    new = np.ones(len(starts), bool)
    new[1:] = stops[starts[1:]] > stops[ends[:-1]]
    new[at[:-1][at[:-1] < len(starts)]] = True
    begin = np.flatnonzero(new)
    return Tokens(data, offsets, starts, ends, at, kind, features, begin, np.diff(np.append(begin, len(starts))))


def many_tokens(texts: list[str], piece: int = 128) -> Tokens:
    """The tokens of many texts, taken a piece at a time; without their bytes."""
    parts = []
    for i in range(0, len(texts), piece):
        t = tokens(pa.array(texts[i : i + piece], pa.string()))
        parts.append((t.features, t.kind.astype(np.int32), t.at, t.first, t.size))
        del t
    all_features, kinds, ats, firsts, sizes = zip(*parts)
    del parts
    _, example, place = np.unique(np.concatenate([f[:, 0] for f in all_features]), return_index=True, return_inverse=True)
    types = np.cumsum([0, *map(len, all_features)])
    count = np.cumsum([0, *map(len, kinds)])
    features = np.empty((len(example), all_features[0].shape[1]), np.uint64)
    part = np.searchsorted(types, example, "right") - 1
    for k, f in enumerate(all_features):
        features[part == k] = f[example[part == k] - types[k]]
    own = np.concatenate([place[a + kind] for a, kind in zip(types, kinds)], dtype=np.int32, casting="same_kind")
    at = np.concatenate([[0], *[x[1:] + n for n, x in zip(count, ats)]])
    first = np.concatenate([x + n for n, x in zip(count, firsts)])
    empty = np.zeros(0, np.int64)
    return Tokens(np.zeros(0, np.uint8), empty, empty, empty, at, own, features, first, np.concatenate(sizes))


def _messages(e: np.ndarray, first: np.ndarray, size: np.ndarray, of: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive blocks of chains: the state probabilities before each block, and the backward weights after it.

    of: the chain of each block. A block's transfer matrix comes from running forward from either state; matrices of a
    chain's blocks are then applied one after another, those of all chains at once.
    """
    before, after = np.zeros((len(first), 2)), np.ones((len(first), 2))
    before[:, 0] = 1
    many = np.flatnonzero(np.bincount(of)[of] > 1)
    if not len(many):
        return before, after
    begin, length = first[many], size[many]
    f = np.zeros((2, 2, len(many)))  # from state, to state, block
    f[0, 0] = f[1, 1] = 1
    for t in range(int(length.max())):
        on = np.flatnonzero(length > t)
        own = e[begin[on] + t]
        g = f[:, :, on]
        a0 = g[:, 0] * m[0, 0] + g[:, 1] * m[1, 0]
        a1 = (g[:, 0] * m[0, 1] + g[:, 1] * m[1, 1]) * own
        total = (a0 + a1).sum(0)
        f[:, 0, on], f[:, 1, on] = a0 / total, a1 / total
    chain = of[many]
    start = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    blocks = np.diff(np.append(start, len(chain)))
    for k in range(1, int(blocks.max())):
        at = start[blocks > k] + k
        v = before[many[at - 1]]
        v = np.stack([v[:, 0] * f[0, s, at - 1] + v[:, 1] * f[1, s, at - 1] for s in (0, 1)], axis=1)
        before[many[at]] = v / v.sum(1, keepdims=True)
    for k in range(int(blocks.max()) - 1, 0, -1):
        at = start[blocks > k] + k
        v = after[many[at]]
        v = np.stack([f[s, 0, at] * v[:, 0] + f[s, 1, at] * v[:, 1] for s in (0, 1)], axis=1)
        after[many[at - 1]] = v / v.sum(1, keepdims=True)
    return before, after


def marginals(emission: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, the probability of the toxic state; of each state pair, the expected number of moves.

    emission: log-odds of the toxic state of each token; move: log-weights of moves between states (2, 2), and before
    the first token state 0 is assumed. Chains are cut into blocks of BLOCK tokens, which all go forward and back
    together, the longest first, from the exact messages at their ends.
    """
    out = np.zeros(len(emission))
    pairs = np.zeros((2, 2))
    if not len(first):
        return out, pairs
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(np.clip(move, -30, 30))
    blocks = -(-size // BLOCK)
    of = np.repeat(np.arange(len(first)), blocks)
    place = (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    first, size = first[of] + place, np.minimum(size[of] - place, BLOCK)
    before, after = _messages(e, first, size, of, m)
    order = np.argsort(-size, kind="stable")
    first, size, before, after = first[order], size[order], before[order], after[order]
    most = int(size[0])
    active = np.searchsorted(-size, -np.arange(most), "left")  # how many blocks have a token at each step
    ahead = []
    f0, f1 = before[:, 0], before[:, 1]
    for t in range(most):
        n = active[t]
        f0, f1 = f0[:n], f1[:n]
        own = e[first[:n] + t]
        a0, a1 = f0 * m[0, 0] + f1 * m[1, 0], (f0 * m[0, 1] + f1 * m[1, 1]) * own
        total = a0 + a1
        f0, f1 = a0 / total, a1 / total
        ahead.append((f0, f1))
    b0 = b1 = np.zeros(0)
    for t in range(most - 1, -1, -1):
        n = active[t]
        b0 = np.concatenate([b0, after[len(b0) : n, 0]])
        b1 = np.concatenate([b1, after[len(b1) : n, 1]])
        f0, f1 = ahead[t]
        p0, p1 = f0 * b0, f1 * b1
        p1 = p1 / (p0 + p1)
        out[first[:n] + t] = p1
        own = e[first[:n] + t]
        g0, g1 = ahead[t - 1] if t else (before[:, 0], before[:, 1])
        g0, g1 = g0[:n], g1[:n]
        x = [[g0 * m[0, 0] * b0, g0 * m[0, 1] * own * b1], [g1 * m[1, 0] * b0, g1 * m[1, 1] * own * b1]]
        total = x[0][0] + x[0][1] + x[1][0] + x[1][1]
        pairs += [[(v / total).sum() for v in row] for row in x]
        b0, b1 = m[0, 0] * b0 + m[0, 1] * own * b1, m[1, 0] * b0 + m[1, 1] * own * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return out, pairs


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    head: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emission(self, t: Tokens) -> np.ndarray:
        """The log-odds of each token."""
        f = t.features
        at = np.minimum(np.searchsorted(self.keys, f.reshape(-1)), max(len(self.keys) - 1, 0)).reshape(f.shape)
        w = np.where(self.keys[at] == f, self.weights[at], 0).sum(1) if len(self.keys) else np.zeros(len(f))
        return (self.bias + w)[t.kind]

    def marginals(self, t: Tokens) -> np.ndarray:
        return marginals(self.emission(t), t.first, t.size, self.move)[0]

    def scores(self, t: Tokens, p: np.ndarray) -> np.ndarray:
        """Document scores of the marginals; 0 where there is no token."""
        x = summed(t, p)
        return np.where(np.diff(t.at) > 0, 1 / (1 + np.exp(-np.clip(x @ self.head, -30, 30))), 0.0)


def summed(t: Tokens, p: np.ndarray) -> np.ndarray:
    """Of each text: the largest marginal, the logs of their sum and of their evidence, its density, and 1."""
    n = len(t.at) - 1
    doc = np.repeat(np.arange(n), np.diff(t.at))
    top = np.zeros(n)
    some = np.flatnonzero(np.diff(t.at))
    if len(some):
        top[some] = np.maximum.reduceat(p, t.at[some])
    q = np.clip(p, 1e-9, 1 - 1e-9)
    evidence = np.bincount(doc, np.maximum(0, np.log(q / (1 - q)) + FLOOR), n)
    density = evidence / np.sqrt(np.maximum(np.diff(t.at), 1))
    return np.stack([top, np.log1p(np.bincount(doc, p, n)), np.log1p(evidence), np.log1p(density), np.ones(n)], axis=1)


def token_labels(t: Tokens, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, whether it is toxic; of each text, whether its label is explained."""
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(t.at))
    n = len(t.features)
    pairs = np.unique(doc * np.int64(n) + t.kind)
    doc_of, kind_of = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
    bad_type = np.zeros(n, bool)
    bad_type[kind_of[toxic[doc_of]]] = True
    # only features of toxic texts can be chosen; each counts once a text, and a column of them is taken at a time
    keys = np.unique(t.features[bad_type].reshape(-1)) if n else np.zeros(0, np.uint64)
    place = np.empty(t.features.shape, np.int32)
    docs, found = [], []
    for i in range(t.features.shape[1]):
        at = np.minimum(np.searchsorted(keys, t.features[:, i]), max(len(keys) - 1, 0))
        place[:, i] = np.where(keys[at] == t.features[:, i], at, -1) if len(keys) else -1
        own = place[kind_of, i]
        both = np.unique(doc_of[own >= 0] * np.int64(max(len(keys), 1)) + own[own >= 0])
        docs.append((both // max(len(keys), 1)).astype(np.int32))
        found.append((both % max(len(keys), 1)).astype(np.int32))
    del kind_of, doc_of, pairs
    columns = list(zip(docs, found))  # never one array of all, which would be the largest thing that learning holds
    del docs, found

    def times(which: np.ndarray) -> np.ndarray:
        """How many of the texts in `which` have each feature."""
        return sum((np.bincount(k[which[d]], minlength=len(keys)) for d, k in columns), np.zeros(len(keys)))

    none = keys == 0  # stands for a beginning that the word doesn't go beyond
    chosen = np.zeros(len(keys), bool)
    explained = ~toxic
    clean = times(~toxic)
    for _ in range(50):
        open_ = toxic & ~explained
        if not open_.any():
            break
        rate = open_.sum() / (open_.sum() + (~toxic).sum())
        bad = times(open_)
        total = bad + clean
        p = np.clip(bad / np.maximum(total, 1), 1e-9, 1 - 1e-9)
        gain = bad * np.log(p / rate) + clean * np.log((1 - p) / (1 - rate))
        gain[(p < 0.8) | chosen | none] = 0
        # as many features as occur at least as often could have been lucky
        rivals = len(total) - np.searchsorted(np.sort(total), total, "left")
        found = gain > np.log(np.maximum(rivals, 1) / CHANCE)
        if not found.any():
            break
        best = found & (gain >= 0.5 * gain.max())
        chosen |= best
        for d, k in columns:
            explained[d[chosen[k]]] = True
    labels = (chosen[place] & (place >= 0)).any(1)[t.kind] & toxic[doc] if len(keys) else np.zeros(len(t.kind), bool)
    return labels, explained


def headed(texts: list[str], y: np.ndarray, tagger: Model) -> np.ndarray:
    """The weights of the document score, by Newton's method with a ridge; toxic ones weigh up to twice as much."""
    parts = []
    for i in range(0, len(texts), 128):
        t = tokens(pa.array(texts[i : i + 128], pa.string()))
        parts.append(summed(t, tagger.marginals(t)))
    x, y = np.concatenate(parts), y.astype(float)
    weight = np.where(y == 1, min(2.0, (1 - y.mean()) / max(y.mean(), 1e-9)), 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * w)
        w = w + np.clip(step, -2, 2)
    return w


def fitted(texts: list[str], toxic: list[int]) -> Model | None:
    """The tagger of all texts; the document score's weights come from every third text under a tagger of the others."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    third = np.arange(len(y)) % 3 == 2
    part = tagger([x for x, own in zip(texts, third, strict=True) if not own], y[~third])
    release()
    model = tagger(texts, y)
    release()
    if model is None:
        return None
    model.head = headed([x for x, own in zip(texts, third, strict=True) if own], y[third], part or model)
    return model


def tagger(texts: list[str], y: np.ndarray) -> Model | None:
    if not y.any():
        return None
    t = many_tokens(texts)
    release()
    labels, explained = token_labels(t, y)
    release()
    doc = np.repeat(np.arange(len(y)), np.diff(t.at))
    # sentences of explained texts; of clean texts as many sentences as it takes to know the common words
    sentence_doc = doc[t.first]
    use = explained[sentence_doc]
    del doc, sentence_doc
    first, size = t.first[use], t.size[use]
    own = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    kind, truth = t.kind[own], labels[own]
    del own, labels
    start = np.cumsum(size) - size
    keys, place = np.unique(t.features.reshape(-1), return_inverse=True)
    width = t.features.shape[1]
    often = np.bincount(place, np.repeat(np.bincount(t.kind, minlength=len(t.features)), width), len(keys)) >= LEAST_SEEN
    often[keys == 0] = False
    place = np.where(often, np.cumsum(often), 0)[place].astype(np.int32).reshape(t.features.shape)  # 0: no feature
    keys = np.append(np.uint64(0), keys[often])
    w, bias, move = np.zeros(len(keys)), -4.0, np.zeros((2, 2))
    gw, gb, gm = np.full(len(keys), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    before = np.append(False, truth[:-1])
    before[start] = False
    seen = np.array([[(~before & ~truth).sum(), (~before & truth).sum()], [(before & ~truth).sum(), (before & truth).sum()]], float)
    cuts = [*dict.fromkeys(np.searchsorted(start, range(0, len(truth), STEP_TOKENS)).tolist()), len(start)]
    upto = np.append(start, len(truth))
    scale = 1 / max(truth.sum(), 1)
    for _ in range(STEPS):
        emission, miss, pairs = bias + w[place].sum(1), np.zeros(len(t.features)), np.zeros((2, 2))
        for lo, hi in zip(cuts, cuts[1:]):
            on = slice(upto[lo], upto[hi])
            p, own = marginals(emission[kind[on]], start[lo:hi] - start[lo], size[lo:hi], move)
            miss += np.bincount(kind[on], (truth[on] - p) * scale, len(miss))
            pairs += own
        grad = np.bincount(place.reshape(-1), np.repeat(miss, width), len(keys)) - DECAY * w
        grad[0] = 0
        gw += grad * grad
        w += RATE * grad / np.sqrt(gw)
        b = miss.sum()
        gb += b * b
        bias += RATE * b / gb**0.5
        mg = (seen - pairs) * scale - DECAY * move
        mg[:, 0] = 0  # only the difference of two moves from a state matters
        gm += mg * mg
        move += 0.2 * RATE * mg / np.sqrt(gm)
    keep = np.abs(w) > 1e-3
    keep[0] = False
    return Model(keys[keep], w[keep], bias, move)


def learned(documents: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model | None:
    model = fitted(*sample(documents, labels, "toxic", modulus, remainder, SAMPLE))
    release()
    return model


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]


def scored(documents: DataFrame, model: Model | None, keep: list[str] | None = None, least: float = TOXIC) -> DataFrame:
    """documents[keep] with score, n_spans and spans: runs of tokens with marginals of `least` or more, as code points of the lower-cased text, end exclusive."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(cols: list[pa.Array]) -> list:
        n = len(cols[0])
        model = shared.value
        if model is None:
            return [np.zeros(n), np.zeros(n, np.int64), [[]] * n]
        t = tokens(cols[0])
        p = model.marginals(t)
        score = model.scores(t, p)
        spans: list[list] = [[] for _ in range(n)]
        bad = np.flatnonzero(p >= least)
        if len(bad):
            lead = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
            doc = np.searchsorted(t.at, bad, "right") - 1
            cut = np.append(True, (np.diff(bad) > 1) | (np.diff(doc) > 0))
            group = np.flatnonzero(cut)
            last = np.append(group[1:], len(bad)) - 1
            top = np.maximum.reduceat(p[bad], group)
            for d, a, b, m in zip(doc[group].tolist(), t.starts[bad[group]], t.ends[bad[last]], top.tolist(), strict=True):
                base = lead[t.offsets[d]]
                spans[d].append({"start": int(lead[a] - base), "end": int(lead[b] - base), "marginal": m})
        return [score, [len(s) for s in spans], spans]

    return appended(documents, ["text"], FIELDS, work, keep)


def classified(documents: DataFrame, labels: DataFrame, least: float = 0.7, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= least), n_spans and spans (start:end of each, comma-joined)."""
    out = scored(documents, learned(documents, labels, modulus, remainder), ["doc_id"])
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_spans", shown.alias("spans"))
