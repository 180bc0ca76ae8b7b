"""Token counts as delta-maintained rollups.

Changes arrive in numbered batches. Inserts add a document and its tokens, deletes take both away, and revisions take
the old count away and add the new one, so a batch is a set of signed sums by source, language and tokenizer version.
A batch is summed before it is written, and a total is the sum of all committed batches. Nothing is ever read again
from the documents.

A batch is committed by the marker that Spark's committer writes when its folder is whole. A batch that is sent again
finds the marker and changes nothing; one that was cut off has none and is written anew. ``compact`` folds committed
batches into a base that lists them, and readers leave out batches that the newest whole base contains.

Token counts come from any column: ``vocabulary_counts`` gives those of public vocabulary files. The registered query
takes counts that SQL can repeat, by three patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectide.llm.common import as_text, shared_dir, stored, table, word_count
from vectide.llm.words import blocks

KEYS = ("source", "lang", "tokenizer")


class Rollups:
    """Totals (docs, tokens) by KEYS in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[str]:
        """Names of the committed folders of a kind, in order of names."""
        fs, p = self._hadoop(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n.removeprefix(f"{kind}-") for n in names if n.startswith(f"{kind}-") and fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")[1]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes (KEYS, docs, tokens); False if a batch of that name is there already."""
        if batch in self._whole("batch") or batch in self._folded()[1]:
            return False
        sums = changes.groupBy(*self.keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def _folded(self) -> tuple[str | None, set[str]]:
        """The newest whole base and the batches in it."""
        bases = self._whole("base")
        if not bases:
            return None, set()
        rows = self.spark.read.parquet(f"{self.path}/list-{bases[-1]}").collect()
        return bases[-1], {r[0] for r in rows}

    def totals(self) -> DataFrame:
        """docs and tokens by KEYS over all committed batches; a key whose documents have all gone stays with 0, and without a batch there is no row."""
        base, folded = self._folded()
        names = [f"base-{base}"] if base else []
        names += [f"batch-{b}" for b in self._whole("batch") if b not in folded]
        if not names:
            return self.spark.createDataFrame([], ", ".join([*(f"`{k}` string" for k in self.keys), "docs long, tokens long"]))
        parts = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}") for n in names])
        return parts.groupBy(*self.keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """Fold all committed batches into a new base; the list comes first, the base's marker makes it count."""
        base, folded = self._folded()
        every = sorted(folded | set(self._whole("batch")))
        number = f"{int(base or 0) + 1:09d}"
        self.spark.createDataFrame([(b,) for b in every], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list-{number}")
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{number}")


def signed(
    changes: DataFrame, keys: tuple[str, ...] = KEYS, op: str = "op", tokens: str = "tokens", old_tokens: str = "old_tokens"
) -> DataFrame:
    """Changes (keys, op: insert, delete or revise, tokens, old_tokens) as signed docs and tokens.

    A null count is 0 and null keys are keys of their own; repeated rows count each time. Any other op, null too, is an
    error when the rows are read. An empty table gives no rows; other columns may have any names.
    """
    kind, new, old = F.col(op), F.coalesce(tokens, F.lit(0)), F.coalesce(old_tokens, F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    count = F.when(kind == "insert", new).when(kind == "delete", -old).when(kind == "revise", new - old).otherwise(unknown.cast("long"))
    return changes.select(*keys, docs.cast("long").alias("docs"), count.cast("long").alias("tokens"))


def vocabulary_counts(
    docs: DataFrame, files: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """id, keep columns, and for each name in files the tokens of the text by the public vocabulary in that file.

    Files are those of the tokenizers library (.json) or of sentencepiece (.model). Texts are counted whole, without
    special tokens; a null text counts as empty and has none. Repeated rows repeat; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias(id_col), *[c for c in keep if c != id_col], as_text(text_col).alias("_text"))
    schema = StructType(rows.schema.fields[:-1])
    for name in files:
        schema.add(name, "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(path) for path in files.values()]
        for texts, kept in blocks(batches, "_text", [f.name for f in schema.fields[: -len(files)]]):
            texts = [t.decode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c(texts), pa.int64()) for c in counters)], names=schema.names)

    return rows.mapInArrow(work, schema)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function of texts that counts their tokens by the vocabulary in a file."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda texts: [len(x.ids) for x in found.encode_batch(texts, add_special_tokens=False)]


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


#: Words; runs of letters, runs of digits and single other characters; words that have a letter or a digit.
PIECES = r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"
SOLID = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, words, pieces, solid of each row; a null text counts as empty, null source and lang are keys."""
    text = as_text("text")
    return docs.select("doc_id", "source", "lang", word_count(text).alias("words"), _matches(text, PIECES).alias("pieces"), _matches(text, SOLID).alias("solid"))


def op9_token_rollups(spark, sf_dir):
    """All documents come in by two tokenizer versions; words-1 is recounted; what labels calls toxic is taken down; two batches come twice."""
    counts = stored(document_counts(table(spark, sf_dir, "documents")), "rollup-counts")
    store = Rollups(spark, f"{shared_dir(spark)}/vectide-rollups-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}-{counts._vectide_path[-8:]}")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()

    def change(rows, op, tokenizer, tokens, old):
        cols = [F.lit(op).alias("op"), F.lit(tokenizer).alias("tokenizer"), (F.col(tokens) if tokens else F.lit(None).cast("long")).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens")]
        return signed(rows.select("source", "lang", *cols))

    gone = counts.join(toxic, "doc_id", "left_semi")
    batches = [
        ("000001", change(counts, "insert", "words-1", "words", None)),
        ("000002", change(counts, "insert", "pieces-1", "pieces", None)),
        ("000003", change(counts.where("solid <> words"), "revise", "words-1", "solid", "words")),
        ("000004", change(gone, "delete", "words-1", None, "solid").unionByName(change(gone, "delete", "pieces-1", None, "pieces"))),
    ]
    for k, (name, rows) in enumerate(batches):
        store.commit(name, rows)
        if k == 1:
            store.compact()
    store.commit(*batches[0])
    store.commit(*batches[3])
    return store.totals()


OP9_SQL = rf"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(text, '{SOLID}')) AS solid, len(regexp_extract_all(text, '{PIECES}')) AS pieces FROM t),
k AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM c),
u AS (
  SELECT source, lang, 'words-1' AS tokenizer, solid AS n, gone FROM k
  UNION ALL SELECT source, lang, 'pieces-1', pieces, gone FROM k)
SELECT source, lang, tokenizer, count(*) FILTER (NOT gone) AS docs, coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS tokens
FROM u GROUP BY source, lang, tokenizer
"""
