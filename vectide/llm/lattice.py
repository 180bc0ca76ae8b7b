"""Language-model scoring by the marginal likelihood of a subword lattice.

A fixed vocabulary of pieces comes from a public tokenizer file. A word is spelled by every sequence of pieces that
join to it, single bytes included, and the probability of its spelling is the sum over all of them, by forward
recursion in log space. Pieces that open a word, and pieces that go on with it or end it, have weights of their own.
The word as a whole is one more edge of the lattice, weighted by its discounted count in the training documents; the
discounts' mass goes to the spellings. A text's probability is the product over its words and one end, times that of
its class, the language whose words fit it best. The marginal over spellings alone is returned beside it.

The public file holds merge ranks and no unigram probabilities, so the pieces' weights are fitted here: a start from
their ranks, a few rounds of expectation-maximisation over the words of all training documents, and a last round over
them by class. No part of it comes from a sample. The vocabulary itself is never changed: every piece keeps its bytes. Texts have their
A-Z in lower case and no blanks inside words, so pieces with a capital A-Z or an inner blank occur in no text.

A text's class comes from all its words by counts of hashed words, BUCKETS of them for each class, whatever their
number. Words that are frequent, at most HEAD_CELLS with their counts by class, are looked up in a broadcast array; the
others are joined by hash. That bound changes where a word's count comes from and no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectide.llm.common import as_text, discard, spare, stored, table
from vectide.llm.langid import held_out_part
from vectide.llm.words import BYTE_VALUES, HashTable, Words, blocks, mixed, powers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds over the words of all training documents before the last one, which is by class.
ROUNDS = 6
#: Frequent words that are broadcast, at most, and at most so many counts of them; distinct words that a task gathers
#: before it sends their counts; word scores that a worker keeps of each class.
HEAD, HEAD_CELLS, GATHER, CACHED = 1 << 18, 1 << 21, 200_000, 1 << 18
#: What the counts of words and of pieces are raised by; counters of words by hash, of each class.
ADD, PIECE_ADD, BUCKETS = 0.1, 0.01, 1 << 16
MARK = "▁"
#: Groups of at most so many words are worked on one by one; words of at most so many bytes have probabilities that no
#: double is too small for, and need no logs; leading bits of a sum that are looked up first.
FEW, PLAIN, MAYBE = 8, 24, 20


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a public vocabulary file as bytes in order of rank, the word mark as a blank, then the 256 single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    pieces = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
    own = set(pieces)
    return [*(p for p in pieces if p), *(bytes([b]) for b in range(256) if bytes([b]) not in own)]


def can_occur(piece: bytes) -> bool:
    """Whether a piece can be part of a blank and a word in lower case."""
    return not any(b in b" \t\n\v\f\r" for b in piece[1:]) and piece[:1] not in b"\t\n\v\f\r" and piece == piece.lower()


def piece_sums(pieces: list[bytes]) -> np.ndarray:
    """The hashes before they are mixed; the same sums over a text give its parts."""
    up, _ = powers(max(map(len, pieces)) + 1)
    return np.array([np.sum(BYTE_VALUES[np.frombuffer(p, np.uint8)] * up[: len(p)], dtype=np.uint64) for p in pieces], dtype=np.uint64)


def piece_hash(pieces: list[bytes]) -> np.ndarray:
    return mixed(piece_sums(pieces))


class Lattice:
    """Pieces in sorted order of hash with their log probabilities, and that of a word's end after its first piece. Pieces that cannot occur have the probability that none has used."""

    def __init__(self, pieces: list[bytes]):
        sums = piece_sums(pieces)
        order = np.argsort(h := mixed(sums))
        self.sizes = sorted({len(p) for p in pieces if can_occur(p)})
        self.longest = self.sizes[-1]
        self.table = HashTable(h[order])
        self.sums = sums[order]
        self.first = np.full(1 << MAYBE, -1, dtype=np.int32)  # a piece by its sum's first bits, which tells most strings at once
        self.first[self.sums >> np.uint64(64 - MAYBE)] = np.arange(len(order))
        self.opens = np.array([pieces[k][:1] == b" " for k in order])
        self.set_weights(1 / (order + 3.0), 1.0)

    def set_weights(self, weights: np.ndarray, words: float) -> None:
        """Expected counts of the pieces in table order, and the number of words."""
        w = weights + PIECE_ADD
        goes_on = w[~self.opens].sum() + words + PIECE_ADD
        self.logp = np.log(w / np.where(self.opens, w[self.opens].sum(), goes_on))
        self.end = float(np.log((words + PIECE_ADD) / goes_on))

    def weighted(self, weights: np.ndarray, words: float) -> Lattice:
        """The same pieces with other weights."""
        out = copy(self)
        out.set_weights(weights, words)
        return out

    def groups(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of like length: their numbers, and the piece of each length that ends at each of their bytes, -1 for none."""
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            widest = max(8, int(size[order[at]] * 5 // 4))
            end = int(np.searchsorted(size[order], widest, side="right"))
            end = min(end, at + max(1, (1 << 14) // widest))
            some = order[at:end]
            at, longest = end, int(size[some].max())
            place = start[some][:, None] + np.arange(longest)
            inside = np.arange(longest) < size[some][:, None]
            text = np.zeros((len(some), longest + 1), dtype=np.uint8)
            text[:, 0] = 32
            text[:, 1:][inside] = data[place[inside]]
            up, down = powers(longest + 1)
            sums = np.zeros((len(some), longest + 2), dtype=np.uint64)
            np.cumsum(BYTE_VALUES[text] * up[: longest + 1], axis=1, dtype=np.uint64, out=sums[:, 1:])
            found = np.full((longest + 2, min(self.longest, longest + 1), len(some)), -1, dtype=np.int32)
            ok = np.concatenate([np.ones((len(some), 1), bool), inside], axis=1)
            for n in self.sizes:
                if n > longest + 1:
                    break
                h = (sums[:, n:] - sums[:, :-n]) * down[: longest + 2 - n]
                own = self.first[h >> np.uint64(64 - MAYBE)]
                rows, cols = np.nonzero(ok[:, n - 1 :] & (own >= 0))
                h, own = h[rows, cols], own[rows, cols]
                other = np.flatnonzero(self.sums[own] != h)
                own[other] = self.table.find(mixed(h[other]))
                found[cols + n, n - 1, rows] = own
            yield some, found

    def forward(self, found: np.ndarray) -> np.ndarray:
        """alpha[t]: the log of the summed probability of all spellings of a word's first t bytes; the blank before it counts."""
        steps, _, words = found.shape
        edge = np.where(found >= 0, self.logp[found], -np.inf)
        alpha = np.full((steps, words), -np.inf)
        alpha[0] = 0
        for t in range(1, steps):
            n = min(self.longest, t)
            x = alpha[t - n : t][::-1] + edge[t, :n]
            top = x.max(axis=0)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[t] = top + np.log(np.exp(x - top).sum(axis=0))
        return alpha

    def plain(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of found pieces, and forward() without logs; for words of at most PLAIN bytes."""
        edge = np.append(np.exp(self.logp), 0.0)[found]
        alpha = np.zeros((len(found), found.shape[2]))
        alpha[0] = 1
        for t in range(1, len(found)):
            n = min(found.shape[1], t)
            alpha[t] = np.einsum("nw,nw->w", alpha[t - n : t][::-1], edge[t, :n])
        return edge, alpha

    def expected_plain(self, found: np.ndarray, last: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece in words of at most PLAIN bytes."""
        edge, alpha = self.plain(found)
        own = np.arange(len(last))
        beta = np.zeros_like(alpha)
        beta[last, own] = 1
        scale = times / alpha[last, own]
        for t in range(len(found) - 1, 0, -1):
            n = min(found.shape[1], t)
            back = edge[t, :n] * beta[t]
            edge[t, :n] = alpha[t - n : t][::-1] * back * scale
            beta[t - n : t][::-1] += back
        used = found >= 0
        return np.bincount(found[used], weights=edge[used], minlength=len(self.logp))

    def edges(self, found: np.ndarray) -> tuple[list[int], list[int], list[float], np.ndarray]:
        """One word's edges in order of their ends: starts, ends, log probabilities, pieces."""
        end, n = np.nonzero(found >= 0)
        piece = found[end, n]
        return (end - n - 1).tolist(), end.tolist(), self.logp[piece].tolist(), piece

    def forward_one(self, found: np.ndarray) -> list[float]:
        """forward() of a single word edge by edge, which is quicker for few and long words."""
        alpha = [0.0, *[-math.inf] * (len(found) - 1)]
        own: list[float] = []
        last = 0
        for a, b, p in zip(*self.edges(found)[:3], strict=True):
            if b != last and own:
                alpha[last] = _log_sum(own)
                own = []
            last = b
            own.append(alpha[a] + p)
        if own:
            alpha[last] = _log_sum(own)
        return alpha

    def expected_one(self, found: np.ndarray, size: int, times: float, out: np.ndarray) -> None:
        """Add a single word's expected counts to out."""
        alpha = self.forward_one(found)
        start, end, p, piece = self.edges(found)
        total = alpha[size + 1]
        beta = [-math.inf] * len(found)
        beta[size + 1] = 0.0
        share = np.zeros(len(piece))
        for k in range(len(piece) - 1, -1, -1):
            x = p[k] + beta[end[k]]
            if x > -math.inf:
                share[k] = math.exp(alpha[start[k]] + x - total)
                beta[start[k]] = _log_sum([beta[start[k]], x])
        np.add.at(out, piece, share * times)

    def word_scores(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The natural log of the probability of each word's spellings."""
        out = np.zeros(len(start))
        for some, found in self.groups(data, start, size):
            if len(some) <= FEW:
                out[some] = [self.forward_one(found[:, :, j])[size[k] + 1] + self.end for j, k in enumerate(some)]
            elif len(found) <= PLAIN + 2:
                out[some] = np.log(self.plain(found)[1][size[some] + 1, np.arange(len(some))]) + self.end
            else:
                out[some] = self.forward(found)[size[some] + 1, np.arange(len(some))] + self.end
        return out

    def cached_scores(self, g: Gathered) -> np.ndarray:
        """word_scores of distinct words, kept for later blocks of the same worker."""
        keys, scores = getattr(self, "kept", (np.zeros(0, np.uint64), np.zeros(0)))
        at = np.minimum(np.searchsorted(keys, g.hash), max(0, len(keys) - 1))
        new = keys[at] != g.hash if len(keys) else np.ones(len(g.hash), bool)
        out = np.zeros(len(g.hash))
        out[~new] = scores[at[~new]] if len(keys) else 0
        out[new] = self.word_scores(g.data, g.start[new], g.size[new])
        if len(keys) + new.sum() > CACHED:
            self.kept = (g.hash, out)
        else:
            keys, scores = np.concatenate([keys, g.hash[new]]), np.concatenate([scores, out[new]])
            order = np.argsort(keys, kind="stable")
            self.kept = (keys[order], scores[order])
        return out

    def expected(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece over all spellings of words that occur so often."""
        out = np.zeros(len(self.logp))
        for some, found in self.groups(data, start, size):
            if len(some) <= FEW:
                for j, k in enumerate(some):
                    self.expected_one(found[:, :, j], int(size[k]), float(count[k]), out)
                continue
            if len(found) <= PLAIN + 2:
                out += self.expected_plain(found, size[some] + 1, count[some])
                continue
            alpha, own = self.forward(found), np.arange(len(some))
            steps, last = len(found), size[some] + 1
            total = alpha[last, own]
            beta = np.full((steps, len(some)), -np.inf)
            beta[last, own] = 0
            times = count[some]
            for t in range(steps - 1, 0, -1):
                live = np.isfinite(beta[t])
                for n in range(1, min(self.longest, t) + 1):
                    use = live & (found[t, n - 1] >= 0)
                    if use.any():
                        x = self.logp[found[t, n - 1, use]] + beta[t, use]
                        share = np.exp(alpha[t - n, use] + x - total[use])
                        out += np.bincount(found[t, n - 1, use], weights=share * times[use], minlength=len(out)) if use.sum() > 1000 else 0
                        if use.sum() <= 1000:
                            np.add.at(out, found[t, n - 1, use], share * times[use])
                        beta[t - n, use] = np.logaddexp(beta[t - n, use], x)
        return out


@dataclass
class Gathered:
    """Distinct words with their bytes and counts."""

    hash: np.ndarray
    count: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray


def distinct(w: Words) -> tuple[Gathered, np.ndarray]:
    """The distinct words of a block, and which of them each word is."""
    h, first, inverse, count = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    return Gathered(h, count, w.data, w.start[first], (w.end - w.start)[first]), inverse


def merged(parts: list[Gathered]) -> Gathered:
    """Several blocks' distinct words as one."""
    lens = np.cumsum([0] + [int(p.size.sum()) for p in parts])
    data = np.zeros(lens[-1], dtype=np.uint8)
    starts = []
    for p, at in zip(parts, lens, strict=False):
        own = np.concatenate([[0], np.cumsum(p.size)])
        place = np.repeat(p.start - own[:-1], p.size) + np.arange(own[-1])
        data[at : at + own[-1]] = p.data[place]
        starts.append(at + own[:-1])
    h, first, inverse = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate([p.count for p in parts])).astype(np.int64)
    return Gathered(h, count, data, np.concatenate(starts)[first], np.concatenate([p.size for p in parts])[first])


_COUNTS = "class int, key long, word binary, n long"


def in_classes(w: Words, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, Words]]:
    """A block's words by class of their texts: the class, the texts' places, the words."""
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        yield int(c), at, w.subset(at)


def counted(docs: DataFrame) -> DataFrame:
    """class, key, word, n: how often each distinct word occurs in all rows (text, class)."""

    def rows_of(c: int, g: Gathered) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(g.size)])
        place = np.repeat(g.start - ends[:-1], g.size) + np.arange(ends[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(g.hash), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(g.data[place])]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g.hash), c, dtype=np.int32)), pa.array(g.hash.view(np.int64)), words, pa.array(g.count)], names=["class", "key", "word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Gathered]] = {}
        for texts, kept in blocks(batches, "text", ["class"]):
            for c, _, w in in_classes(Words(texts), kept.column(0).to_numpy()):
                parts.setdefault(c, []).append(merged([distinct(w)[0]]))  # keeps the distinct words' bytes only
            if sum(len(p.hash) for own in parts.values() for p in own) > 2 * GATHER:
                parts = {c: [merged(own)] for c, own in parts.items()}
                if sum(len(own[0].hash) for own in parts.values()) > GATHER:
                    yield from (rows_of(c, own[0]) for c, own in parts.items())
                    parts = {}
        yield from (rows_of(c, merged(own)) for c, own in parts.items())

    got = docs.select("text", "class").mapInArrow(work, _COUNTS)
    return stored(got.groupBy("class", "key", "word").agg(F.sum("n").alias("n")), "lm-counts")


def expected_pieces(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """class, piece, expected: the expected number of uses of each piece in all counted words."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            data = np.frombuffer(words.buffers()[2], np.uint8)
            for c in np.unique(of):
                at = np.flatnonzero(of == c)
                sums[int(c)] = sums.get(int(c), 0) + shared.value.expected(data, ends[:-1][at], np.diff(ends)[at], n[at])
        for c, e in sums.items():
            used = np.flatnonzero(e)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), c, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(e[used])], names=["class", "piece", "expected"])

    return counts.select("class", "word", "n").mapInArrow(work, "class int, piece int, expected double").groupBy("class", "piece").agg(F.sum("expected").alias("expected"))


def start_lattice(counts: DataFrame, path: str) -> Lattice:
    """Pieces with weights from all counted words of all classes together, by ROUNDS of expectation-maximisation; each round gives a row a piece."""
    lattice = Lattice(vocabulary(path))
    total = counts.agg(F.sum("n")).first()[0]
    every = counts.select(F.lit(0).alias("class"), "word", "n")
    for _ in range(ROUNDS if total else 0):
        got = expected_pieces(every, lattice).toArrow()
        weights = np.zeros(len(lattice.logp))
        weights[got["piece"].to_numpy()] = got["expected"].to_numpy()
        lattice = lattice.weighted(weights, total)
    return lattice


@dataclass
class Head:
    """Frequent words: sorted hashes, counts, and counts by class in rows; those rarer than least are not here."""

    least: int
    table: HashTable | None
    total: np.ndarray
    by_class: np.ndarray


def bucket_counts(counts: DataFrame, classes: int) -> np.ndarray:
    """How many words of each class have each value of their hash's last bits: as large as its parameters, whatever the number of words."""
    at = F.col("key").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("at")
    got = counts.groupBy("class", at).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BUCKETS, classes))
    out[got["at"].to_numpy(), got["class"].to_numpy()] = got["n"].to_numpy()
    return out


def head_words(words: DataFrame, classes: int, most: int = HEAD) -> Head:
    """The frequent words of a table (key, n, own: a map of class to n); the histogram that picks them has a row for each power of two of counts."""
    most = min(most, HEAD_CELLS // classes)
    steps = words.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect()
    least, rows = 1 << 62, 0
    for k, n in steps:
        rows += n
        if rows > most:
            break
        least = 1 << int(k)
    got = words.where(F.col("n") >= least).select("key", "n", *[F.coalesce(F.col("own")[c], F.lit(0)).alias(f"c{c}") for c in range(classes)]).toArrow().to_pandas()
    h = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Head(least, HashTable(h[order]) if len(h) else None, got["n"].to_numpy(np.int64)[order], got[[f"c{c}" for c in range(classes)]].to_numpy(np.int64)[order])


def score(
    docs: DataFrame, train: DataFrame, keep: tuple[str, ...] = ("doc_id",),
    id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", path: str = VOCABULARY,
) -> DataFrame:
    """keep columns and n_tokens, n_known, train_tokens, base_score, score, lattice_score of each row of docs; log10 throughout.

    score has whole words as edges of the lattice, lattice_score sums over the spellings alone. A null text is empty and
    has one token, the end. Classes come from training rows only, every language is one and a null class is one more; of
    classes that fit a text equally the more frequent one counts. Training rows count each time they occur. Without
    training rows all tokens are unknown and words are spelled with the first weights. Empty tables give no rows; other
    input columns may have any names; very long words have all their spellings summed.
    """
    spark = docs.sparkSession
    langs = train.where(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("name")).count()
    names = [r[0] for r in langs.orderBy(F.desc("count"), "name").collect()]  # a row a language
    size = len(names) + 1
    number = F.lit(len(names))
    if names:
        known = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
        number = F.coalesce(F.element_at(known, F.col(class_col)), number)
    train = train.select(F.col(id_col).alias("id"), as_text(text_col).alias("text"), number.cast("int").alias("class"))

    counts = counted(train)
    start = start_lattice(counts, path)
    words = counts.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("own"))  # a row a class
    words = stored(words, "lm-words")
    docs_of, tokens_of, kinds_of, discount = np.zeros(size), np.zeros(size), np.zeros(size), np.full(size, 0.5)
    for c, n in train.groupBy("class").count().collect():
        docs_of[c] = n
    once = F.count(F.when(F.col("n") == 1, 1))
    for c, kinds, n, ones, twos in counts.groupBy("class").agg(F.count("*"), F.sum("n"), once, F.count(F.when(F.col("n") == 2, 1))).collect():
        tokens_of[c], kinds_of[c] = n, kinds
        if ones and twos:
            discount[c] = ones / (ones + 2 * twos)
    ends = int(docs_of.sum())
    total, kinds = int(tokens_of.sum()) + ends, words.count() + (ends > 0)
    pieces = expected_pieces(counts, start).toArrow().to_pandas()
    lattices = []
    for c in range(size):
        own = pieces[pieces["class"] == c]
        weights = np.zeros(len(start.logp))
        weights[own["piece"].to_numpy(np.int64)] = own["expected"].to_numpy()
        lattices.append(start.weighted(weights, tokens_of[c]) if tokens_of[c] else start)
    # Of a class: all its tokens, the mass of the spellings, and log10 of its share and of an end. Without counts it is only spelled, and ends as often as not.
    all_of = tokens_of + docs_of
    spell = np.where(tokens_of > 0, discount * kinds_of / np.maximum(all_of, 1), 0.5)
    end_of = np.log10(np.where(tokens_of > 0, docs_of / np.maximum(all_of, 1), 0.5))
    share = np.log10(np.maximum(docs_of, 0.5) / max(ends, 1))
    head, hashed = head_words(words, size), bucket_counts(counts, size)
    discard(counts)

    def base(c):
        return np.log10((c + ADD) / (total + ADD * (kinds + 1)))

    logs = np.log((hashed + PIECE_ADD) / (tokens_of + PIECE_ADD * BUCKETS)).astype(np.float32)
    prior = np.where(tokens_of > 0, share * np.log(10), -1e9)  # a class without words is nobody's
    # Spellings alone: each word goes on with what an end leaves.
    goes_on = np.log10(np.where(tokens_of > 0, tokens_of / np.maximum(all_of, 1), 0.5))
    shared = spark.sparkContext.broadcast((lattices, head, logs))
    own_text = spare("_text", keep)
    rows = docs.select(*keep, as_text(text_col).alias(own_text))
    kept_fields = docs.select(*keep).schema
    extra = "n_tokens long, known long, base double, score double, lattice double, class int, tail array<long>, times array<int>, spelled array<float>"
    schema = StructType.fromDDL(f"{kept_fields.toDDL()}, {extra}" if keep else extra)

    def classify(w: Words) -> np.ndarray:
        """The likeliest class of each text by all its words."""
        at = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
        fit = [np.bincount(w.doc, weights=shared.value[2][at, c], minlength=w.n_docs) + prior[c] for c in range(size)]
        return np.stack(fit, axis=1).argmax(axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, head, _ = shared.value
        for texts, kept in blocks(batches, own_text, list(keep)):
            every = Words(texts)
            for c, at, w in in_classes(every, classify(every)):
                g, which = distinct(w)
                n = w.n_docs
                spelled = lattices[c].cached_scores(g) / np.log(10)
                place = head.table.find(g.hash) if head.table else np.full(len(g.hash), -1)
                here, place = place >= 0, np.maximum(place, 0)
                points = base(head.total[place]) if head.table else np.zeros(len(g.hash))
                own = np.maximum(head.by_class[place, c] - discount[c], 0) / max(all_of[c], 1) if head.table else np.zeros(len(g.hash))
                full = np.log10(own + spell[c] * 10.0 ** np.maximum(spelled, -300.0))
                full = np.where(own > 0, full, np.log10(spell[c]) + spelled)
                known = here[which]
                doc, word = w.doc[~known], which[~known]
                pair, times = np.unique(doc * np.int64(len(g.hash) + 1) + word, return_counts=True)
                doc, word = pair // (len(g.hash) + 1), pair % (len(g.hash) + 1)
                offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                sums = [np.bincount(w.doc[known], weights=x[which[known]], minlength=n) for x in (np.ones(len(here)), points, full)]
                yield pa.RecordBatch.from_arrays([
                    *(x.take(pa.array(at)) for x in kept.columns),
                    pa.array(w.per_doc() + 1),
                    pa.array(sums[0].astype(np.int64) + (ends > 0)),
                    pa.array(sums[1] + base(ends)),
                    pa.array(sums[2] + share[c] + end_of[c]),
                    pa.array(np.bincount(w.doc, weights=spelled[which] + goes_on[c], minlength=n) + share[c] + end_of[c]),
                    pa.array(np.full(n, c, dtype=np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(g.hash.view(np.int64)[word])),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(spelled[word].astype(np.float32))),
                ], names=schema.names)

    def by_class(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("class") + 1)

    half = stored(rows.mapInArrow(work, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-docs")
    tail = half.select("uid", "class", F.explode(F.arrays_zip("tail", "times", "spelled")).alias("t")).select("uid", "class", F.col("t.tail").alias("key"), "t.times", "t.spelled")
    rare = words.where(F.col("n") < head.least)
    tail = tail.join(rare.hint("merge"), "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    point = F.log10((F.col("c") + F.lit(ADD)) / F.lit(float(total + ADD * (kinds + 1))))
    own = F.greatest(F.coalesce(F.col("own")[F.col("class")], F.lit(0)) - by_class(discount), F.lit(0.0)) / by_class(np.maximum(all_of, 1))
    lone = by_class(np.log10(spell)) + F.col("spelled").cast("double")
    full = F.when(own > 0, F.log10(own + F.pow(F.lit(10.0), F.greatest(lone, F.lit(-300.0))))).otherwise(lone)
    tail = tail.groupBy("uid").agg(F.sum(F.col("times") * point).alias("more"), F.sum(F.col("times") * full).alias("more_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = half.drop("tail", "times", "spelled").join(tail.hint("merge"), "uid", "left")
    return out.select(
        *keep,
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        F.col("lattice").alias("lattice_score"),
    )


def op10_lattice_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = held_out_part("doc_id", 10)
    return score(docs.withColumn("held_out", part == 0), docs.where(part != 0), keep=("doc_id", "held_out"))
