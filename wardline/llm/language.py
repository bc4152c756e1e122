"""Language of code-switched text by a linear-chain conditional random field.

Every word gets a label. A word speaks for labels by its features: the letters with which it
begins and ends, its n-grams, and the word itself if it is in the lexicon of the sample; labels of
neighbours speak for each other by learned transitions. Forward-backward gives each word's
probabilities, and a text has the language that holds most of them in sum.

The chain of a text may be long, and is never cut: words are taken in blocks, each block becomes a
matrix that carries label weights across it, the blocks of a text are chained, and then all
words of all blocks are passed again at once from the weights at the edges of their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import Shelf

UNKNOWN = "und"
#: Bounds of the fit: labelled rows of each language, and of all languages together.
ROWS_PER_LANGUAGE, ROWS = 200, 6_000
#: Hashed features; words of the sample in so many texts are in the lexicon.
FEATURES, LEXICON_TEXTS = 1 << 16, 3
#: Training chains: lengths of the stretches that are strung together, and of a chain.
STRETCH, CHAIN = 40, 240
ROUNDS, RATE, PENALTY = 50, 0.15, 1e-6
#: Words of a block, at least so many times the labels; words of a pass, and words times labels of a pass.
BLOCK, BLOCK_LABELS, WORDS_AT_ONCE, NUMBERS_AT_ONCE = 64, 16, 400_000, 6_000_000
REMEMBERED = 400_000
SEED = 29


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs between white space; those without a letter are told apart later."""
    return (text or "").lower().split()


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) numbers, words in order: n-grams with the edges marked, affixes, and the word in the lexicon.

    Two and three letters are taken anywhere, which includes the shorter affixes; four at either
    edge and five at the end, the edge counted. They are hashed for all words at once.
    """
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    left = ends[word] - at  # letters from here to the end of the word
    begins = left == lengths[word]
    owners, numbers = [], []
    with np.errstate(over="ignore"):
        for n, places in ((2, left >= 2), (3, left >= 3), (4, (left == 4) | begins & (left > 4)), (5, left == 5)):
            where = at[places]
            h = np.full(len(where), n, np.uint64)
            for i in range(n):
                h = (h ^ codes[where + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            owners.append(word[where])
            numbers.append((h % np.uint64(FEATURES)).astype(np.int64))
    known = [(i, FEATURES + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    owners.append(np.array([i for i, _ in known], dtype=np.int64))
    numbers.append(np.array([f for _, f in known], dtype=np.int64))
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(owner, kind="stable")
    return owner[order], number[order]


def word_weights(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """(word, label): summed weights of each word's features."""
    owner, number = features(words, lexicon)
    return np.stack([np.bincount(owner, weights[number, j], len(words)) for j in range(weights.shape[1])], axis=1)


@dataclass
class Field:
    """labels, transition weights (from, to), feature weights (feature, label), numbers of the words in the lexicon."""

    labels: list[str]
    transitions: np.ndarray
    weights: np.ndarray
    lexicon: dict[str, int]
    _at: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None
    _used: int = 0

    def __getstate__(self):
        return self.__dict__ | {"_at": {}, "_table": None}

    def _learn(self, tokens: set[str]) -> None:
        """Work out the weights of new tokens; row 0 of the table is for those without a letter."""
        if self._table is None or len(self._at) > REMEMBERED:
            self._at.clear()
            self._table, self._used = np.ones((1 << 14, len(self.labels))), 0
        new = [t for t in tokens if t not in self._at]
        words = [letters(t) for t in new]
        self._at.update((t, 0) for t, w in zip(new, words) if not w)
        new, words = [t for t, w in zip(new, words) if w], [w for w in words if w]
        if not new:
            return
        rows = word_weights(words, self.weights, self.lexicon)
        first = self._used + 1
        self._used += len(new)
        while self._used >= len(self._table):
            self._table = np.concatenate([self._table, np.ones_like(self._table)])
        self._table[first:self._used + 1] = np.exp(rows - rows.max(axis=1, keepdims=True))
        self._at.update(zip(new, range(first, self._used + 1)))

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """(text, label): mean probability of each label over the words of each text; 0 without words."""
        tokens = [words_of(t) for t in texts]
        self._learn(set().union(*tokens))
        chains = [np.fromiter(map(self._at.__getitem__, t), np.int64, len(t)) for t in tokens]
        chains = [c[c > 0] for c in chains]
        result = np.zeros((len(texts), len(self.labels)))
        at, most = 0, min(WORDS_AT_ONCE, NUMBERS_AT_ONCE // max(len(self.labels), 1))
        while at < len(chains):
            end, total = at, 0
            while end < len(chains) and (end == at or total + len(chains[end]) <= most):
                total, end = total + len(chains[end]), end + 1
            if total:
                result[at:end] = self._sums(chains[at:end])
            at = end
        return result / np.maximum([[len(c)] for c in chains], 1)

    def _sums(self, chains: list[np.ndarray]) -> np.ndarray:
        """Sums over the words of each chain. Only chains of several blocks need a matrix for each block, and blocks
        are longer with many labels, so that matrices stay few against the words."""
        lengths = np.array([len(c) for c in chains])
        emit = self._table[np.concatenate(chains)]
        move = np.exp(self.transitions - self.transitions.max())
        k = len(self.labels)
        block = max(BLOCK, BLOCK_LABELS * k)
        n_blocks = -(-lengths // block)
        # Blocks in descending length, so those that still have a word at a step come first.
        owner = np.repeat(np.arange(len(chains)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, n_blocks) + nth * block
        size = np.minimum(block, np.repeat(lengths, n_blocks) - nth * block)
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        start, size, owner, nth = start[order], size[order], owner[order], nth[order]
        live = np.searchsorted(-size, -np.arange(block), "left")  # blocks longer than s

        def unit(x):
            return x / x.max(axis=-1, keepdims=True)

        # Across each block: weights after its last word, for each label before its first.
        joined = np.flatnonzero(n_blocks[owner] > 1)
        slot = np.full(len(order), -1)
        slot[joined] = np.arange(len(joined))
        starts, longer = start[joined], np.searchsorted(-size[joined], -np.arange(block), "left")
        across = np.broadcast_to(np.eye(k), (len(joined), k, k)).copy()
        for s in range(block):
            m = longer[s]
            if not m:
                break
            step = (across[:m].reshape(-1, k) @ move).reshape(m, k, k) * emit[starts[:m] + s][:, None, :]
            across[:m] = step / step.max(axis=(1, 2), keepdims=True)
        # Along the blocks of each text, forwards and backwards.
        ahead, behind = np.ones((len(order), k)), np.ones((len(order), k))
        base = np.cumsum(n_blocks) - n_blocks
        for i in range(1, int(n_blocks.max())):
            texts = np.flatnonzero(n_blocks > i)
            now, before = place[base[texts] + i], place[base[texts] + i - 1]
            ahead[now] = unit(np.einsum("nk,nkj->nj", ahead[before], across[slot[before]]))
            texts = np.flatnonzero(n_blocks > i)
            now = place[base[texts] + n_blocks[texts] - 1 - i]
            after = place[base[texts] + n_blocks[texts] - i]
            behind[now] = unit(np.einsum("nkj,nj->nk", across[slot[after]], behind[after]))
        # Within the blocks, all at once.
        forward = []
        state = ahead
        for s in range(block):
            m = live[s]
            if not m:
                break
            state = unit((state[:m] @ move) * emit[start[:m] + s])
            forward.append(state)
        sums = np.zeros((len(chains), k))
        state = behind.copy()
        for s in range(len(forward) - 1, -1, -1):
            m = live[s]
            p = forward[s] * state[:m]
            p /= p.sum(axis=1, keepdims=True)
            for j in range(k):
                sums[:, j] += np.bincount(owner[:m], p[:, j], len(chains))
            state[:m] = unit((state[:m] * emit[start[:m] + s]) @ move.T)
        return sums


def train(texts: list[str], langs: list[str]) -> Field:
    """Adam on the log-likelihood of chains in which stretches of texts of all languages alternate."""
    labels = sorted(set(langs))
    seen: dict[str, int] = {}
    tokens, number, label = [], [], []
    for text, lang in zip(texts, langs):
        own = [seen.setdefault(w, len(seen)) for w in map(letters, words_of(text)) if w]
        for i in range(0, len(own), STRETCH):
            number.append(own[i:i + STRETCH])
            label.append(labels.index(lang))
        tokens.extend({*own})
    if not number:
        return Field(labels, np.zeros((len(labels),) * 2), np.zeros((FEATURES, len(labels))), {})
    spread = np.bincount(np.array(tokens), minlength=len(seen))
    lexicon = {w: n for n, w in enumerate(w for w, i in seen.items() if spread[i] >= LEXICON_TEXTS)}
    of_token, of_feature = features(list(seen), lexicon)
    bounds = np.searchsorted(of_token, np.arange(len(seen)))
    size = FEATURES + len(lexicon)

    # The same number of words of each language, strung together in random order.
    random, k = np.random.default_rng(SEED), len(labels)
    order = random.permutation(len(number))
    words = np.fromiter(chain.from_iterable(number[i] for i in order), np.int64)
    truth = np.fromiter(chain.from_iterable(repeat(label[i], len(number[i])) for i in order), np.int64)
    share = np.bincount(truth, minlength=k)
    length = min(CHAIN, len(words))
    n = len(words) // length
    words, truth = words[:n * length].reshape(n, length), truth[:n * length].reshape(n, length)
    weigh = (share.sum() / np.maximum(share, 1) / k)[truth]
    theta = [np.zeros((k, k)), np.zeros((size, k))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for turn in range(1, ROUNDS + 1):
        transitions, weights = theta
        table = np.add.reduceat(weights[of_feature], bounds, axis=0)
        emit = np.exp(table - table.max(axis=1, keepdims=True))[words]
        move = np.exp(transitions - transitions.max())
        forward = np.empty((length, n, k))
        state = np.ones((n, k))
        for s in range(length):
            state = (state @ move if s else state) * emit[:, s]
            state /= state.sum(axis=1, keepdims=True)
            forward[s] = state
        error = np.empty((n, length, k))
        slope = np.zeros((k, k))
        state = np.ones((n, k))
        for s in range(length - 1, -1, -1):
            p = forward[s] * state
            error[:, s] = p / p.sum(axis=1, keepdims=True)
            state = state * emit[:, s]
            if s:
                pair = forward[s - 1][:, :, None] * move * state[:, None, :]
                slope += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            state = state @ move.T
            state /= state.sum(axis=1, keepdims=True)
        np.subtract.at(slope, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        error[np.arange(n)[:, None], np.arange(length), truth] -= 1
        error *= weigh[:, :, None]
        flat = words.ravel()
        by_token = np.stack([np.bincount(flat, error[:, :, j].ravel(), len(seen)) for j in range(k)], axis=1)
        by_feature = np.stack(
            [np.bincount(of_feature, by_token[of_token, j], size) for j in range(k)], axis=1) / words.size
        slopes = [slope / words.size, by_feature + PENALTY * weights]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g ** 2
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9 ** turn)) / (
                np.sqrt(second[i] / (1 - 0.99 ** turn)) + 1e-6)
    return Field(labels, theta[0], theta[1], lexicon)


def fit(docs: DataFrame, train_rows: Column, rows_per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> Field:
    """Learn from at most `rows_per_language` texts of each value of `lang`, and at most `rows` in all.

    The rows with the smallest hashes of text and id are taken. Null langs and texts are
    left out. Languages without a letter in the sample can't be predicted; without any training
    row everything is `und`.
    """
    shelf = Shelf(docs.sparkSession, "language")
    lot = F.xxhash64(F.lit(SEED), "doc_id", F.octet_length("text"))
    ids = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & train_rows).select(
        "doc_id", "lang", lot.alias("lot"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id"))
    chosen = (ids.withColumn("nth", nth).filter(F.col("nth") <= rows_per_language)
              .orderBy("nth", "lot").limit(rows).select("doc_id", "lot").distinct())
    sample = shelf.keep(
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & train_rows)
        .withColumn("lot", lot).join(F.broadcast(chosen), ["doc_id", "lot"])  # at most `rows` rows
        .select("doc_id", "lot", "lang", "text").dropDuplicates(["doc_id", "lot", "lang"]), "sample")
    found = sample.orderBy("lot", "doc_id", "lang").collect()  # at most `rows` rows
    return train([r["text"] for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row, by its whole text.

    score is the mean probability of the predicted language over the words. Texts that are null or
    have no letter are `und` with score 0; ties go to the first language by code point.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for at in range(0, len(batch), 2_000):
                texts = batch.column("text")[at:at + 2_000].to_pylist()
                means = model.posteriors(texts) if model.labels else np.zeros((len(texts), 1))
                best = means.argmax(axis=1)
                top = means[np.arange(len(texts)), best]
                langs.extend(model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, top))
                scores.extend(np.minimum(top, 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
