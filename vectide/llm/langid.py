"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over runs of one to five characters, where letters are lower-cased, combining marks belong to
their letters, and whatever lies between is one space. A model is fitted on a bounded sample of labelled documents. Its n-grams are stored by order in
sorted arrays of 64-bit hashes; the arrays of all languages are then merged, so that one lookup gives the interpolated
log probability in every language. A document gets the language of the lowest cross-entropy per character. It is
accepted if that entropy is within what held-back documents of the language show at its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import as_text, join_small, spare, stored, table, tidy
from vectide.llm.words import HashTable

ORDER = 5
#: The bound of the fitting sample: documents and characters of a language, and characters of all languages together,
#: which share them evenly. A text of more than a PART-th of its language's share is left to those that fit.
MAX_DOCS, MAX_CHARS, MAX_ALL_CHARS, PART = 1000, 2_000_000, 16_000_000, 8
#: A tenth of the sample is held back for calibration. A document is rejected if it is MARGIN nats worse than the centre of
#: its language and what all but a hundredth of the held-back texts of all languages show at its length, up to LONG characters.
HELD_BACK, SURE, LONG, MARGIN = 10, 0.99, 400, 0.4
UNKNOWN = "und"

_STEP = 0xD1342543DE82EF95
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter, itself if it is a combining mark, or 0; and for each such value a random 64-bit value."""
    if not _tables:
        low = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low[c] = ord(x.lower()[0])
            elif unicodedata.category(x)[0] == "M":
                low[c] = c
        _tables["low"] = low
        _tables["alpha"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _tables["value"] = np.random.default_rng(77).integers(1, 2**63, 0x110000, dtype=np.uint64)
    return _tables["low"], _tables["value"]


class Chars:
    """Texts as padded rows of characters: codes, doc (of each code), pad (True before a text), n (characters of each text, 0 for one without a letter)."""

    def __init__(self, texts: list[str]):
        low, _ = _letters()
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = low[raw]
        doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        before = np.concatenate([[0], codes[:-1]])
        keep = (codes > 0) | (before > 0)
        codes, doc = codes[keep], doc[keep]
        self.n = np.bincount(doc, minlength=len(texts))
        self.lettered = np.bincount(doc, weights=_tables["alpha"][codes], minlength=len(texts)) > 0
        at = np.arange(len(codes)) + (ORDER - 1) * (doc + 1)
        size = len(codes) + (ORDER - 1) * len(texts)
        self.codes, self.pad = np.zeros(size, dtype=np.uint32), np.ones(size, dtype=bool)
        self.codes[at], self.pad[at] = codes, False
        self.first = np.concatenate([[0], np.cumsum(self.n + ORDER - 1)])[:-1]

    def grams(self) -> list[np.ndarray]:
        """The hash of the 1 to ORDER characters that end at each place."""
        value = _letters()[1][self.codes]
        out = [value]
        for k in range(1, ORDER):
            h = out[-1].copy()
            h[k:] += value[:-k] * np.uint64(pow(_STEP, k, 2**64))
            out.append(h)
        return out


@dataclass
class Model:
    """One language: by order sorted n-gram hashes with the discounted share and the n-gram's context and suffix, and contexts with their weight of the shorter order."""

    grams: list[np.ndarray]
    share: list[np.ndarray]
    context: list[np.ndarray]
    suffix: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]


def _counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(h, return_index=True, return_counts=True)


def fit(texts: list[str]) -> Model:
    """Kneser-Ney counts and discounts: raw counts at the highest order, numbers of distinct left neighbours below it."""
    chars = Chars(texts)
    hashes, places = chars.grams(), np.flatnonzero(~chars.pad)
    model = Model([], [], [], [], [], [])
    deeper = None
    for k in range(ORDER, 0, -1):
        at = places if deeper is None else deeper
        gram, first, count = _counts(hashes[k - 1][at])
        where = at[first]
        deeper = where  # one place for each distinct n-gram: counting its suffixes counts left neighbours
        context = hashes[k - 2][where - 1] if k > 1 else np.zeros(len(where), dtype=np.uint64)
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=count)
        model.grams.append(gram)
        model.share.append((count - discount) / total[inverse])
        model.context.append(context)
        model.suffix.append(hashes[k - 2][where] if k > 1 else np.zeros(len(where), dtype=np.uint64))
        model.contexts.append(ctx)
        model.weight.append(discount * np.bincount(inverse) / total)
    for x in (model.grams, model.share, model.context, model.suffix, model.contexts, model.weight):
        x.reverse()
    return model


class Models:
    """All languages: by order a table of n-grams with a log probability for each language, and of contexts with a log weight."""

    def __init__(self, languages: list[str], models: list[Model]):
        self.languages, n = languages, len(models)
        symbols = len(np.unique(np.concatenate([m.grams[0] for m in models]))) + 1
        self.logp, self.grams, self.logw, self.contexts = [], [], [], []
        below, below_table = None, None
        self.floor = np.zeros(n)
        for k in range(ORDER):
            keys = np.unique(np.concatenate([m.grams[k] for m in models]))
            suffix, context = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
            share = np.zeros((len(keys), n))
            for j, m in enumerate(models):
                at = np.searchsorted(keys, m.grams[k])
                share[at, j], suffix[at], context[at] = m.share[k], m.suffix[k], m.context[k]
            ctx = np.unique(np.concatenate([m.contexts[k] for m in models]))
            weight = np.ones((len(ctx), n))
            for j, m in enumerate(models):
                weight[np.searchsorted(ctx, m.contexts[k]), j] = m.weight[k]
            w = weight[np.searchsorted(ctx, context)]
            p = share + w * (1 / symbols if below is None else below[below_table.find(suffix)])
            if k == 0:
                self.floor = np.log(weight[0] / symbols).astype(np.float32)
            below, below_table = p, HashTable(keys)
            self.grams.append(below_table)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(HashTable(ctx))
            self.logw.append(np.log(weight).astype(np.float32))
        self.chunk = max(1 << 14, (1 << 21) // n)
        self.centre, self.spread, self.heat = np.zeros(n), np.inf, 10.0

    def place_scores(self, hashes: list[np.ndarray]) -> np.ndarray:
        """The log probability of the character at each place in each language."""
        size = len(hashes[0])
        out = np.zeros((size, len(self.languages)), dtype=np.float32)
        todo = np.arange(size)
        for k in range(ORDER - 1, -1, -1):
            found = self.grams[k].find(hashes[k][todo])
            hit = found >= 0
            out[todo[hit]] += self.logp[k][found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k:
                known = self.contexts[k].find(hashes[k - 1][np.maximum(todo - 1, 0)])
                seen = known >= 0
                out[todo[seen]] += self.logw[k][known[seen]]
            else:
                out[todo] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character of each text in each language, and the numbers of characters."""
        chars = Chars(texts)
        hashes, size = chars.grams(), len(chars.codes)
        sums = np.zeros((size, len(self.languages)), dtype=np.float32)
        for a in range(0, size, self.chunk):
            lo = max(0, a - 1)
            sums[a : a + self.chunk] = self.place_scores([h[lo : a + self.chunk] for h in hashes])[a - lo :]
        sums[chars.pad] = 0
        total = np.add.reduceat(sums, chars.first, axis=0, dtype=np.float64) if size else np.zeros((0, len(self.languages)))
        return -total / np.maximum(chars.n, 1)[:, None], np.where(chars.lettered, chars.n, 0)

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """The centre of each language's own entropy, the spread about it, and the heat that makes the scores of held-back texts likeliest."""
        h, n = self.entropies(texts)
        ok = n > 0
        h, n, labels = h[ok], n[ok], labels[ok]
        if not len(h):
            return
        for j in range(len(self.languages)):
            own = h[labels == j, j]
            if len(own):
                self.centre[j] = np.median(own)
        off = np.abs(h[np.arange(len(h)), labels] - self.centre[labels]) * np.sqrt(np.minimum(n, LONG))
        self.spread = max(float(np.quantile(off, SURE)), 1.0)

        def loss(heat: float) -> float:
            x = -heat * h
            x -= x.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]))

        self.heat = min((2.0**k for k in range(-1, 7)), key=loss)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and acceptance of each text."""
        h, n = self.entropies(texts)
        best = h.argmin(axis=1) if len(h) else np.zeros(0, dtype=int)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp(np.maximum(-self.heat * (h - low[:, None]), -700)).sum(axis=1)
        some = n > 0
        limit = self.centre[best] + MARGIN + self.spread / np.sqrt(np.clip(n, 1, LONG))
        langs = [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        return langs, np.where(some, score, 0.0), np.where(some, low, 0.0), some & (low <= limit)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """lang, text, k of at most max_docs documents a language and of its share of MAX_ALL_CHARS characters, at most MAX_CHARS.

    Documents are counted by language and those whose hash is in a share of its range are taken, a quarter more than
    needed on average; of these the first by hash remain, so that no task numbers more than a sample. A language whose
    texts are all longer than a PART-th of its share is learned from the beginning of its shortest one.
    """
    hashed = F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    rows = docs.select(hashed.alias("at"), F.col(lang_col).alias("lang"), as_text(text_col).alias("text")).where(F.col("lang").isNotNull())
    languages = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    room = min(MAX_CHARS, max(1, MAX_ALL_CHARS // max(1, languages.count())))
    length = F.length("text")
    fits = rows.where(length <= room // PART)
    counts = stored(fits.groupBy("lang").agg(F.count("*").alias("n")), "lang-fits")
    few = join_small(fits, counts.select("lang", (F.lit(1.25 * max_docs) / F.col("n")).alias("share")), "lang", F.xxhash64("at"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    few = few.where("at <= share").withColumn("k", first).where(f"k <= {max_docs}")
    upto = F.sum(length).over(Window.partitionBy("lang").orderBy("k"))
    few = few.withColumn("upto", upto).where(F.col("upto") <= room).select("lang", "text", "k")
    rest = rows.join(F.broadcast(counts.select("lang")) if counts.count() <= MAX_DOCS else counts.select("lang").hint("merge"), "lang", "left_anti")
    cut = F.min(F.struct(length.alias("size"), F.substring("text", 1, room).alias("text")))
    return few.unionByName(rest.groupBy("lang").agg(cut.alias("cut")).select("lang", "cut.text", F.lit(1).alias("k")))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS
) -> Models | None:
    """Models of the non-null languages of docs, from a bounded sample; None if no document has a language.

    A null text counts as empty. Repeated rows may be in the sample more than once; rows whose ids hash alike are taken
    in order of their texts. Other columns may have any names.
    """
    out = _learned(sample(docs, id_col, text_col, lang_col, max_docs))
    tidy(docs.sparkSession)
    return out


def _learned(rows: DataFrame) -> Models | None:
    """Models of a sample's languages; what they are made from is gone on return."""
    got = rows.toArrow().to_pandas().sort_values(["lang", "k"])
    languages = sorted(got["lang"].unique())
    if not languages:
        return None
    models, held, labels = [], [], []
    for j, lang in enumerate(languages):
        texts = list(got["text"][got["lang"] == lang])
        back = texts[::HELD_BACK] if len(texts) > 1 else texts
        models.append(fit([t for k, t in enumerate(texts) if k % HELD_BACK or len(texts) == 1]))
        held += back
        labels += [j] * len(back)
    out = Models(languages, models)
    out.calibrate(held, np.asarray(labels))
    return out


OUT = ("lang_pred", "score", "entropy", "accepted")


def identify(
    docs: DataFrame, models: Models | None, text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, ...] = OUT
) -> DataFrame:
    """keep columns and lang_pred, score, entropy, accepted of each row, or these four by other names.

    A null text or one without a letter is ``und`` with score 0 and not accepted; so is every text if no language was
    learned. Of languages that fit equally the first by name counts. Repeated rows give equal rows. Very long texts are
    read whole. An empty table gives no rows. Other input columns may have any names; a kept column with the name of an
    output is an error, which other names avoid.
    """
    from pyspark.sql.types import StructType

    if set(names) & set(keep):
        raise ValueError(f"kept columns have the names of outputs: {sorted(set(names) & set(keep))}")
    own = text_col if text_col in keep else spare("_text", keep)
    rows = docs.select(*keep) if own == text_col else docs.select(*keep, as_text(text_col).alias(own))
    schema = StructType(docs.select(*keep).schema.fields[:])
    for name, kind in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(own).to_pylist()]
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size, end = size + len(texts[end]), end + 1
                part = texts[at:end]
                if found:
                    langs, score, entropy, accepted = found.predict(part)
                else:
                    langs, score, entropy, accepted = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part), bool)
                cols = [batch.column(c).slice(at, end - at) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted)], names=schema.names)
                at = end

    return rows.mapInArrow(work, schema)


def held_out_part(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = train(docs.where(held_out_part("doc_id", 5) != 0))
    rows = docs.select("doc_id", (held_out_part("doc_id", 5) == 0).alias("held_out"), "text")
    return identify(rows, models, keep=("doc_id", "held_out"))
