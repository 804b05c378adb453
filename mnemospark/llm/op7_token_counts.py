"""Token counts as delta-maintained rollups.

A store folder holds, for each batch of changes, a ledger (signed documents and tokens
by document, source, language and tokenizer version) and its rollup (the same summed
over documents).  A change inserts counts of a document, deletes a document, or
revises it (deletes and inserts); deletions are the negated sums of what the ledger
holds.  Totals are the sums of the rollups of all committed batches, so they are
additive and never need the documents again.

Committed batches stand in a log of numbered files, each naming a batch and its attempt.
A batch reads the log, writes all it has into a folder of its attempt, and commits by
creating the log's next number, which only one writer can (rename without overwriting; on
a local disk a hard link).  A writer that finds the number taken reads the log again: if its
batch stands there now, it is done; if not, it starts over from the new state.  So a batch
that is repeated, raced or broken off counts once or not at all, and of two batches that
delete the same document the second finds nothing left.

Defined cases: null source, language or tokenizer is a group of its own; null doc_id is
a document like any other; repeated rows each count, and a delete removes all of them;
deleting an unknown document does nothing; null counts are 0; an empty batch commits;
further columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, wordcache

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenCounts:
    """A store of token counts in a folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> dict[str, str]:
        """Attempt of each committed batch, in the order of the log."""
        fs, p = self._path("commits")
        if not fs.exists(p):
            return {}
        names = sorted(f.getPath().getName() for f in fs.listStatus(p))
        return dict(self._entry(n).rsplit("@", 1) for n in names if n.isdigit())

    def _entry(self, name: str) -> str:
        fs, p = self._path(f"commits/{name}")
        src = fs.open(p)
        try:
            return bytes(src.readAllBytes()).decode()
        finally:
            src.close()

    def _commit(self, number: int, batch: str, attempt: str) -> bool:
        """Create the log's entry of this number; False if there is one."""
        fs, draft = self._path(f"drafts/{attempt}")
        _, entry = self._path(f"commits/{number:012d}")
        fs.mkdirs(entry.getParent())
        out = fs.create(draft, True)
        out.write(f"{batch}@{attempt}".encode())
        out.close()
        if fs.getUri().getScheme() != "file":
            return not fs.exists(entry) and fs.rename(draft, entry)
        local = [p.toUri().getPath() for p in (draft, entry)]
        try:
            os.link(*local)
        except FileExistsError:
            return False
        return True

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/batches/{batch}@{attempt}/{kind}" for batch, attempt in sorted(self.committed().items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer; groups that are empty again are left out."""
        return self._read("rollup", ROLLUP).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def held(self) -> DataFrame:
        """What the ledger holds: the sums by document and group."""
        return self._read("ledger", LEDGER).groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Commit a batch; False if it had been committed before.

        inserts, revised: doc_id, source, lang, tokenizer, n_tokens.  deletes: doc_id.
        """
        if not batch or any(c in batch for c in "@/\\ "):
            raise ValueError("a batch name has no @, slash or space")
        while True:
            log = self.committed()
            if batch in log:
                return False
            attempt = uuid.uuid4().hex
            at = f"{self.folder}/batches/{batch}@{attempt}"
            self._changes(at, inserts, deletes, revised)
            if self._commit(len(log), batch, attempt):
                return True
            shared.drop(self.spark, at)

    def _changes(self, at: str, inserts: DataFrame | None, deletes: DataFrame | None, revised: DataFrame | None) -> None:
        """Write ledger and rollup of a batch into its folder."""
        counted = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in GROUP], F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        parts = [counted(df) for df in (inserts, revised) if df is not None]
        gone = [df.select(F.col("doc_id").cast("long").alias("gone")) for df in (deletes, revised) if df is not None]
        if gone:
            out = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            held = self.held()
            parts.append(held.join(out.distinct(), F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("doc_id", *GROUP, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        rows = parts[0] if parts else self.spark.createDataFrame([], LEDGER)
        for p in parts[1:]:
            rows = rows.unionByName(p)
        ledger = shared.stored(rows, "ledger", f"{at}/ledger")
        ledger.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{at}/rollup")


def counts(docs: DataFrame, tokenizers: dict[str, str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of each row and tokenizer version; a path of None counts words."""

    def run(batches):
        encode = {name: wordcache.load(path).encode if path else None for name, path in tokenizers.items()}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(3)]
            for name, f in encode.items():
                n = [len(f(t)) // 4 if f else len(t.encode().split()) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", *GROUP, "n_tokens"])

    rows = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), shared.quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, delete those labelled toxic, revise those of low quality (their
    end id counts from now on), and send two of the batches again."""
    import public_tokenizers

    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    store = TokenCounts(spark, shared.scratch(spark, "token-counts"))
    store.apply("load", inserts=counts(docs, {"words-1": None, "byte_bpe_50k-1": public_tokenizers.path("byte_bpe_50k.json")}))
    toxic, poor = labels.filter("toxic = 1").select("doc_id"), labels.filter("toxic = 0 and quality = 0").select("doc_id").distinct()
    store.apply("toxic", deletes=toxic)
    store.apply("poor", revised=store.held().join(poor, "doc_id", "left_semi").withColumn("n_tokens", F.col("n_tokens") + F.col("n_docs")))
    store.apply("toxic", deletes=toxic)
    store.apply("load", inserts=counts(docs, {"words-1": None}))
    return store.totals()
