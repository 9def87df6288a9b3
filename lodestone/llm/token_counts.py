"""Token counts as delta-maintained rollups.

A ledger holds additive totals of documents, tokens and characters by source, language and tokenizer version. A batch
of changes is a table of signed rows: +1 for an inserted text, -1 for a deleted one, both for a revised one. A
commit counts the changed texts, adds the signed counts up by group inside each task and then by key, writes a
few rows to a folder of its own, and then creates the batch's file, which names that folder. The file is created once: of several drivers that commit
the same id one succeeds, and the others' rows are never read. The totals are the sum over all batches, so they never need a second look at
documents that didn't change; compact() puts the sum of the batches so far in their place for readers.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import create_once, names_in, read_text

from .common import remove, shared_dir, trimmed
from .tokenizer import VOCABULARY, encoder

SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _counters(vocabulary: str) -> dict[str, Callable[[str], int]]:
    """Tokenizer version: a function that counts a text's tokens."""
    bpe = encoder(vocabulary)
    return {"byte_bpe_50k": lambda text: len(bpe.encode(text)) // 2, "white_space": lambda text: len(text.encode().split())}


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, totals = _counters(vocabulary), defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for sign, source, lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    text = text or ""
                    for name, f in count.items():
                        row = totals[source, lang, name]
                        row[0] += sign
                        row[1] += sign * f(text)
                        row[2] += sign * len(text)
            if len(totals) > 100_000:  # many groups: hand them on instead of keeping them
                yield _batch(totals)
                totals.clear()
        yield _batch(totals)

    return run


def _batch(totals: dict) -> pa.RecordBatch:
    keys, sums = list(totals), list(totals.values())
    columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([v[i] for v in sums], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, ["source", "lang", "tokenizer", "n_docs", "n_tokens", "n_chars"])


def count_changes(changes: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Signed totals by source, lang and tokenizer of changes (sign, source, lang, text).

    Null texts are empty, null signs count 0, null sources and languages are groups of their own. Repeated rows all
    count; an empty table gives no groups. Other columns are ignored.
    """
    rows = changes.select(F.coalesce(F.col("sign").cast("int"), F.lit(0)).alias("sign"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(trimmed(_count(vocabulary)), SCHEMA)
    return parts.groupBy("source", "lang", "tokenizer").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])


class TokenLedger:
    """Committed batches below a folder of the shared file system: counts/ has rows, batches/ID.json and sums/vN.json say which of them count."""

    def __init__(self, spark: SparkSession, path: str, *, vocabulary: str = VOCABULARY):
        self.spark, self.path, self.vocabulary = spark, path.rstrip("/"), vocabulary

    def committed(self) -> list[str]:
        return [unquote(n) for n in names_in(self.spark, f"{self.path}/batches", ".json")]

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batches/{quote(batch_id, safe='')}.json"

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and no change, if one with this id is there already."""
        if batch_id in self.committed():
            return False
        folder = f"counts/{uuid.uuid4().hex}"
        count_changes(changes, vocabulary=self.vocabulary).write.parquet(f"{self.path}/{folder}")
        if create_once(self.spark, self._batch(batch_id), json.dumps({"counts": folder})):
            return True
        remove(self.spark, f"{self.path}/{folder}")  # another driver was first
        return False

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Of the last sum: its number and the batches in it; and the folders to read: the sum's and those of the batches since."""
        sums = sorted(int(n[1:]) for n in names_in(self.spark, f"{self.path}/sums", ".json"))
        last = json.loads(read_text(self.spark, f"{self.path}/sums/v{sums[-1]}.json")) if sums else {"batches": [], "counts": None}
        since = sorted(set(self.committed()) - set(last["batches"]))
        folders = [json.loads(read_text(self.spark, self._batch(b)))["counts"] for b in since]
        return (sums[-1] if sums else 0), sorted({*last["batches"], *since}), ([last["counts"]] if sums else []) + folders

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        return rows.groupBy("source", "lang", "tokenizer").agg(*sums).where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars); groups without documents are left out."""
        return self._read(self._state()[2])

    def compact(self) -> bool:
        """Writes the sum of all batches so far, which totals() then reads in their place; False if there is nothing new or another driver was first."""
        number, batches, folders = self._state()
        if len(folders) < 2:
            return False
        folder = f"counts/{uuid.uuid4().hex}"
        self._read(folders).write.parquet(f"{self.path}/{folder}")
        return create_once(self.spark, f"{self.path}/sums/v{number + 1}.json", json.dumps({"batches": batches, "counts": folder}))


def inserted(docs: DataFrame) -> DataFrame:
    """docs as changes of sign +1."""
    return docs.select(F.lit(1).alias("sign"), "source", "lang", "text")


def deleted(docs: DataFrame) -> DataFrame:
    """docs as changes of sign -1."""
    return docs.select(F.lit(-1).alias("sign"), "source", "lang", "text")


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old rows with sign -1 and new rows with sign +1."""
    return deleted(before).unionByName(inserted(after))


def corpus_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals of a ledger whose batches come to docs: drafts inserted, drafts revised to their texts, all others inserted, copies inserted and deleted.

    A quarter of the rows (by a hash of their texts) starts as a draft, the first half of its text in a source named drafts; another quarter is inserted twice
    and deleted once. The batches are committed twice, which changes nothing, and summed up in between.
    """
    ledger = TokenLedger(docs.sparkSession, shared_dir(docs.sparkSession, "ledger"), vocabulary=vocabulary)
    quarter = F.pmod(F.xxhash64(F.col("text")), F.lit(4))
    drafts, copied = docs.where(quarter == 0), docs.where(quarter == 1)
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    early = drafts.select(F.lit("drafts").alias("source"), "lang", half.alias("text"))
    batches = {"drafts": inserted(early), "load": inserted(docs.where(quarter != 0)), "copies": inserted(copied), "revised": revised(early, drafts), "deleted": deleted(copied)}
    for batch_id, changes in batches.items():
        ledger.commit(batch_id, changes)
        if batch_id == "copies":
            ledger.compact()
    for batch_id, changes in batches.items():
        ledger.commit(batch_id, changes)
    return ledger.totals()
