"""Token counts kept by deltas.

A batch holds changes: inserts, deletes (with the row as it was) and revisions (the row as it was and as it is). Each
becomes signed counts, summed by source, language and tokenizer version. A batch is committed once, as one folder
`batch=<id>` with Spark's success marker; a second commit of its id does nothing, and a commit that broke off left no
marker and is written anew. Totals are the sums over all committed batches, so no batch reads the corpus again.

Null sources and languages are groups of their own; null and empty texts have no tokens and count as documents. Batches
may be empty. Rows may repeat: each counts. A kind that is null or unknown, and a delete or revision in a batch without
the old row's columns, is an error: the commit fails and counts nothing. Further columns of a batch are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import blocks
from shelfmark.llm.shingles import word_hashes
from shelfmark.llm.tokens import ids

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: The tokenizer version that counts words between white space.
WORDS = "words/1"


def _counted(tokenizers: dict[str, str | None]):
    schema = pa.schema([("source", pa.string()), ("lang", pa.string()), ("sign", pa.int64()), ("chars", pa.int64()), ("tokenizer", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign, chars, text, source, lang = (batch.column(k) for k in ("sign", "chars", "text", "source", "lang"))
            for name, path in tokenizers.items():
                if path is None:
                    counts = []
                    for i, j, data, offsets in blocks(text):
                        _, doc = word_hashes(data, offsets)
                        own = [0] * (j - i)
                        for d in doc.tolist():
                            own[d] += 1
                        counts += own
                else:
                    counts = [len(ids(t.as_py(), path)) for t in text]
                yield pa.record_batch([source.cast(pa.string()), lang.cast(pa.string()), sign, chars, pa.array([name] * len(counts), pa.string()), pa.array(counts, pa.int64())], schema=schema)

    return run


def deltas(changes: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """Signed sums of changes (kind, source, lang, text, old_source, old_lang, old_text).

    kind: insert uses the row, delete the old one, revise both. tokenizers: version name to file, None for words.
    """
    old = {"old_source", "old_lang", "old_text"} <= set(changes.columns)
    known = ["insert", "delete", "revise"] if old else ["insert"]
    said = F.concat(F.lit("unknown kind of change" if old else "not an insert, and the batch has no old rows"), F.lit(": "), F.coalesce("kind", F.lit("null")))
    kind = F.when(F.col("kind").isin(known), F.col("kind")).otherwise(F.raise_error(said))
    rows = changes.where(kind.isin("insert", "revise") if old else kind == "insert").select("source", "lang", "text", F.lit(1).cast("long").alias("sign"))
    if old:
        before = changes.where(kind.isin("delete", "revise")).select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"), F.lit(-1).cast("long").alias("sign"))
        rows = rows.unionByName(before)
    rows = rows.select("source", "lang", "sign", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text")
    counted = rows.mapInArrow(_counted(tokenizers), "source string, lang string, sign long, chars long, tokenizer string, n long")
    sums = counted.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n")).alias("tokens"), F.sum(F.col("sign") * F.col("chars")).alias("chars"))
    return sums.where("docs <> 0 OR tokens <> 0 OR chars <> 0")


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str | None]):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        return self._files().exists(self._path(f"batch={quote(batch_id, safe='')}", "_SUCCESS"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was new. A batch counts from the moment its success marker is there."""
        if self.committed(batch_id):
            return False
        deltas(changes, self.tokenizers).write.mode("overwrite").parquet(f"{self.folder}/batch={quote(batch_id, safe='')}")
        return True

    def totals(self) -> DataFrame:
        files, found = self._files(), []
        if files.exists(self._path()):
            for status in files.listStatus(self._path()):
                if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.append(status.getPath().toString())
        rows = self.spark.read.schema(_SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 OR tokens <> 0 OR chars <> 0")
