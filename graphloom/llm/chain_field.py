"""Language identification by a linear-chain conditional random field over words.

Every word has a label, so code-switched text is labelled word by word. A word's features are its character
n-grams, those at its ends with the boundary (affixes), and how lexicons of the languages rank it; transitions
between labels are learned with the features' weights, and marginals come from forward-backward over whole texts.
A document's language is the one with the highest mean marginal over its words with letters.

``label_words`` gives the words' own labels.

The field is fitted, in one task, to code-switched sequences that are joined from spans of at most ``MAX_DOCS`` documents
for each language, those whose hash is lowest. What the field takes on a worker, and the sample, grow with the number of
languages, of which none is left out, and with nothing else. Texts of a batch go through forward-backward in step; scores
of words are remembered in bounded memory.

Defined results. Null, empty and letterless texts: ``und`` with score 0. Rows with a null language teach nothing;
if no row can be learned from, everything is ``und``. Repeated rows each have a result. An empty table gives an
empty result. Columns other than doc_id, text and (to learn) lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import written
from graphloom.llm.nb_svm import held_out

DIM = 1 << 16
GRAMS = (1, 2, 3, 4, 5)
MAX_DOCS = 400
LEXICON = 4000
MEMORY_WORDS = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"\S+")


def word_features(words: list[str], lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature columns of all words one after another, and the index of the word of each."""
    raw = ("\n" + "\n".join(words) + "\n").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    word_of = np.cumsum(data == 10) - 1
    columns, owner = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        inner = np.zeros(len(h), np.int64)
        for k in range(n):
            h = h * np.uint64(257) + data[k : k + len(h)]
            if 0 < k < n - 1:
                inner += data[k : k + len(h)] == 10
        # No n-gram spans two words: a boundary may be its first or its last byte alone.
        good = inner == 0
        if n > 1:
            good &= ~((data[: len(h)] == 10) & (data[n - 1 :] == 10))
        else:
            good &= data != 10
        at = np.flatnonzero(good)
        columns.append((tk.mix(h[at] + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int64))
        owner.append(np.where(data[at] == 10, word_of[at], word_of[at]))
    keys, ranks = lexicon
    if len(keys):
        h = tk.word_hashes(data, breaks[:-1] + 1, breaks[1:])
        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = np.flatnonzero(keys[place] == h)
        columns.append(DIM + ranks[place[known]])
        owner.append(known)
    return np.concatenate(columns), np.concatenate(owner)


def _segments(scores: np.ndarray, lengths: np.ndarray):
    """Batches of sequences of like length: (their numbers, an array of sequence x step x label filled up with ones, lengths)."""
    order, first = np.argsort(lengths, kind="stable"), np.cumsum(lengths) - lengths
    k = 0
    while k < len(order):
        take = max(1, min(256, 300_000 // max(1, int(lengths[order[min(k + 255, len(order) - 1)]]))))
        rows = order[k : k + take]
        longest = int(lengths[rows].max())
        if longest:
            step = np.arange(longest)
            inside = step < lengths[rows][:, None]
            psi = np.ones((len(rows), longest, scores.shape[1]))
            s = scores[(first[rows][:, None] + step)[inside]]
            psi[inside] = np.exp(s - s.max(axis=1, keepdims=True))
            yield rows, psi, inside
        k += take


def marginals(psi: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: marginals of labels at each step, and the scaled forward messages; transition: exponentials of weights."""
    n, steps, labels = psi.shape
    forward = np.empty_like(psi)
    a = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = a
    for t in range(1, steps):
        a = (a @ transition) * psi[:, t]
        a /= a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    out, b, back = np.empty_like(psi), np.ones((n, labels)), transition.T
    for t in range(steps - 1, -1, -1):
        m = forward[:, t] * b
        out[:, t] = m / m.sum(axis=1, keepdims=True)
        b = (psi[:, t] * b) @ back
        b /= b.sum(axis=1, keepdims=True)
    return out, forward


class Field:
    def __init__(self, languages: list[str], lexicon: tuple[np.ndarray, np.ndarray], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transition = languages, lexicon, weights, transition

    def word_scores(self, words: list[str]) -> np.ndarray:
        columns, owner = word_features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[columns, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)


def build_lexicon(spans: list[tuple[int, list[str]]], labels: int, size: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (sorted) and, for each, a number that says which language has it most and how clearly."""
    count: dict[str, np.ndarray] = {}
    for y, words in spans:
        for w in words:
            count.setdefault(w, np.zeros(labels))[y] += 1
    common = sorted((w for w, c in count.items() if c.sum() >= 3), key=lambda w: (-count[w].sum(), w))[: size * labels]
    if not common:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = ("\n" + "\n".join(common) + "\n").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    h = tk.word_hashes(data, breaks[:-1] + 1, breaks[1:])
    shares = np.array([count[w] / count[w].sum() for w in common])
    rank = shares.argmax(axis=1) * 3 + np.digitize(shares.max(axis=1), (0.7, 0.95))
    order = np.argsort(h)
    return h[order], rank[order]


def train(spans: list[tuple[str, list[str]]], sequences: int = 3000, epochs: int = 4, seed: int = 11) -> Field | None:
    """A field from (language, words) spans; sequences are joined from one to four spans of any languages."""
    languages = sorted({lang for lang, _ in spans})
    if not languages:
        return None
    rng, k = np.random.default_rng(seed), len(languages)
    spans = sorted(((languages.index(lang), words) for lang, words in spans if words), key=lambda s: (s[0], s[1]))
    lexicon = build_lexicon(spans, k)
    by = [[words for y, words in spans if y == lab] for lab in range(k)]
    weights, transition = np.zeros((DIM + 3 * k, k)), np.zeros((k, k))
    grown, grown_t = np.full_like(weights, 1e-2), np.full_like(transition, 1e-2)
    if k == 1:
        return Field(languages, lexicon, weights, np.exp(transition))
    for epoch in range(epochs):
        for _ in range(max(1, sequences // 250)):
            words, truth, lengths = [], [], []
            for _ in range(250):
                n = 0
                for _ in range(int(rng.integers(1, 5))):
                    y = int(rng.integers(k))
                    whole = by[y][int(rng.integers(len(by[y])))]
                    a = int(rng.integers(max(1, len(whole) - 5)))
                    part = whole[a : a + int(rng.integers(3, 20))]
                    words += part
                    truth += [y] * len(part)
                    n += len(part)
                lengths.append(n)
            columns, owner = word_features(words, lexicon)
            scores = np.stack([np.bincount(owner, weights[columns, j], minlength=len(words)) for j in range(k)], axis=1)
            truth, lengths = np.array(truth), np.array(lengths)
            first, gradient, gradient_t = np.cumsum(lengths) - lengths, np.zeros((len(words), k)), np.zeros((k, k))
            moves = np.exp(transition)
            for rows, psi, inside in _segments(scores, lengths):
                m, forward = marginals(psi, moves)
                place = (first[rows][:, None] + np.arange(psi.shape[1]))[inside]
                gradient[place] = -m[inside]
                # Expected transitions: forward message, move, and marginal over what the move leads to.
                for t in range(1, psi.shape[1]):
                    live = inside[:, t]
                    ahead = forward[live, t - 1] @ moves
                    gradient_t -= np.einsum("ni,ij,nj->ij", forward[live, t - 1], moves, m[live, t] / np.maximum(ahead, 1e-300))
                    np.add.at(gradient_t, (truth[first[rows][live] + t - 1], truth[first[rows][live] + t]), 1)
            gradient[np.arange(len(words)), truth] += 1
            step = np.stack([np.bincount(columns, gradient[owner, j], minlength=len(weights)) for j in range(k)], axis=1) / 250 - 1e-4 * weights
            gradient_t = gradient_t / 250 - 1e-4 * transition
            grown += step * step
            grown_t += gradient_t * gradient_t
            weights += 0.3 * step / np.sqrt(grown)
            transition += 0.3 * gradient_t / np.sqrt(grown_t)
    return Field(languages, lexicon, weights, np.exp(transition))


def _train(batches):
    spans = [(lang, split(part)) for batch in batches for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist(), strict=True)]
    if (field := train(spans)) is not None:
        hashes, ranks = field.lexicon
        parts = [pa.array([field.languages]), pa.array([hashes.view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([ranks.tolist()], pa.list_(pa.int64())), pa.array([field.weights.tobytes()]), pa.array([field.transition.tobytes()])]
        yield pa.record_batch(parts, ["languages", "hashes", "ranks", "weights", "transition"])


def split(text: str) -> list[str]:
    return text.lower().split()


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, span_words: int = 120) -> Field | None:
    """A field from documents that are not held out and have a language: at most max_docs for each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A row for each language, as the field has.
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return None
    span = 1 << 30
    # Somewhat more than max_docs documents a language are put in order.
    shares = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(span * min(1.0, (1.2 * max_docs + 50) / n)))]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span))
    chosen = own.withColumn("place", place).filter(F.col("place") < share)
    # A long text teaches with one span of its words, from anywhere in it.
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size("w") - span_words, F.lit(0)) + 1).cast("int") + 1
    spans = chosen.select("lang", "place", "doc_id", words.alias("w")).filter(F.size("w") > 0).select("lang", "place", "doc_id", F.array_join(F.slice("w", first, F.lit(span_words)), " ").alias("part"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "part")
    spans = spans.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_docs)
    taught = written(spans.select("lang", "part"), "spans")
    found = taught.coalesce(1).mapInArrow(_train, "languages array<string>, hashes array<long>, ranks array<long>, weights binary, transition binary").first()
    if found is None:
        return None
    k = len(found["languages"])
    lexicon = np.array(found["hashes"], np.int64).view(np.uint64), np.array(found["ranks"], np.int64)
    return Field(list(found["languages"]), lexicon, np.frombuffer(found["weights"]).reshape(-1, k), np.frombuffer(found["transition"]).reshape(k, k))


class Labeller:
    """Marginals of the words of many texts at a time; remembers the scores of words in bounded memory."""

    def __init__(self, field: Field):
        self.field, self.known, self.table = field, {}, np.zeros((0, len(field.languages)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of all words, nan for one without letters: it says nothing about a language, and has no vote."""
        if len(self.known) > MEMORY_WORDS:
            self.known, self.table = {}, self.table[:0]
        at = list(map(self.known.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None))
            fresh = self.field.word_scores(new)
            fresh[[k for k, w in enumerate(new) if not (w.isalpha() or any(map(str.isalpha, w)))]] = np.nan
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, fresh])
            at = list(map(self.known.__getitem__, words))
        return self.table[np.array(at, np.int64)]

    def marginals(self, texts: list[list[str]]):
        """Yields (numbers of texts, marginals as text x step x label, steps inside the text, steps with a vote)."""
        scores = self.scores([w for t in texts for w in t])
        lengths = np.array(list(map(len, texts)))
        voting = ~np.isnan(scores[:, 0]) if len(scores) else np.zeros(0, bool)
        scores[~voting] = 0.0
        first = np.cumsum(lengths) - lengths
        for rows, psi, inside in _segments(scores, lengths):
            use = inside.copy()
            use[inside] = voting[(first[rows][:, None] + np.arange(psi.shape[1]))[inside]]
            yield rows, marginals(psi, self.field.transition)[0], inside, use


def _texts(batch: pa.RecordBatch):
    for lo, hi, data, offsets in tk.chunks(batch.column("text")):
        raw = data.tobytes()
        yield batch.slice(lo, hi - lo), [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _label(shared):
    def run(batches):
        field = shared.value
        labeller = Labeller(field) if field else None
        for batch in batches:
            for part, texts in _texts(batch):
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if labeller:
                    mean, votes = np.zeros((len(texts), len(field.languages))), np.zeros(len(texts))
                    for rows, m, _, use in labeller.marginals(list(map(split, texts))):
                        votes[rows] = use.sum(axis=1)
                        mean[rows] = (m * use[:, :, None]).sum(axis=1) / np.maximum(1, votes[rows])[:, None]
                    names = [field.languages[b] if v else UNKNOWN for b, v in zip(mean.argmax(axis=1), votes, strict=True)]
                    score = np.where(votes > 0, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.record_batch([part.column("doc_id"), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def _label_each(shared):
    def run(batches):
        field = shared.value
        labeller = Labeller(field) if field else None
        for batch in batches:
            for part, texts in _texts(batch):
                ids = part.column("doc_id").to_pylist()
                own = [[(m.start(), m[0]) for m in _WORD.finditer(t)] for t in texts]
                out = []
                if not labeller:
                    out = [(i, k, at, w, UNKNOWN, 0.0) for i, words in zip(ids, own, strict=True) for k, (at, w) in enumerate(words)]
                else:
                    for rows, m, _, use in labeller.marginals([[w.lower() for _, w in words] for words in own]):
                        best, most = m.argmax(axis=2), m.max(axis=2)
                        for r, t in enumerate(rows.tolist()):
                            out += [(ids[t], k, at, w, field.languages[best[r, k]] if use[r, k] else UNKNOWN, float(most[r, k]) if use[r, k] else 0.0) for k, (at, w) in enumerate(own[t])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)], ["doc_id", "place", "start", "word", "lang", "probability"])

    return run


def label_words(docs: DataFrame, field: Field | None) -> DataFrame:
    """A row for each word of each text: doc_id, place (its number in the text), start (code points), word, lang (its label; ``und`` without letters) and the label's probability.

    Without a field every label is ``und``. Null and empty texts have no words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_label_each(shared), "doc_id long, place long, start long, word string, lang string, probability double")


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_label(shared), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
