"""Token counts of documents in flat token files without an index.

A flat file is nothing but unsigned 16-bit ids, each document's followed by an
end-of-document id; it comes as blocks of any sizes that know no boundaries.
Each block is searched for that id with one vectorised comparison.  Boundaries
that fall between blocks are stitched by a prefix scan over the blocks' sums, in
two levels, so that no task holds more than ``GROUP`` blocks of one file or one
row for each group of them.

Two separators in a row are an empty document.  Ids after a file's last separator
are a document that isn't closed (``closed`` false).  Empty blocks change nothing.
Null blocks count as empty.  A document may run over any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselite.llm import tokens
from tesselite.llm._util import map_texts, materialise, scratch_path

#: The end-of-document id, the tokenizer's own.
SEPARATOR = 49407
#: Ids of one block as written here.
BLOCK = 1 << 16
#: Blocks that one window of the scan's first level holds at most.
GROUP = 1024


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Of each block (file, block, data): n ids, where its separators leave off, and what they bound: places in the block and lengths."""
    rows = blocks.select("file", "block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, seps, head, tail, inner = [], [], [], [], []
            for data in b.column("data").to_pylist():
                ids = np.frombuffer(data or b"", "<u2")
                at = np.flatnonzero(ids == separator)
                n.append(len(ids))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append((at[:-1] + 1, np.diff(at) - 1))
            long = pa.int64()
            sizes = pa.array(np.cumsum([0, *(len(a) for a, _ in inner)]), pa.int32())
            flat = [pa.array(np.concatenate([np.empty(0, np.int64), *(i[c] for i in inner)]), long) for c in (0, 1)]
            bounded = pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays(flat, ["at", "tokens"]))
            yield pa.RecordBatch.from_pydict({"file": b.column("file"), "block": b.column("block"), "n": pa.array(n, long), "seps": pa.array(seps, long), "head": pa.array(head, long), "tail": pa.array(tail, long), "inner": bounded})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_texts(rows, run, f"file {kinds['file']}, block {kinds['block']}, n bigint, seps bigint, head bigint, tail bigint, inner array<struct<at:bigint,tokens:bigint>>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, group: int = GROUP) -> DataFrame:
    """(file, ordinal, start, tokens, closed) of every document of every flat file; start counts ids, separators too."""
    # the search runs once
    found = materialise(scan_blocks(blocks, separator), "separators").withColumn("g", F.floor(F.col("block") / group))
    inside = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = (
        found.withColumn("ids", F.coalesce(F.sum("n").over(inside), zero))
        .withColumn("docs", F.coalesce(F.sum("seps").over(inside), zero))
        # ids up to and with the block's last separator, from the group's start
        .withColumn("cut", F.when(F.col("seps") > 0, F.col("ids") + F.col("n") - F.col("tail")))
        .withColumn("before", F.max("cut").over(inside))
    )
    sums = found.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).alias("last"), F.max("block").alias("top"))
    # ids after the group's last separator: that block's tail, and all ids of the blocks behind it
    behind = found.join(sums.select("file", "g", F.col("last.block").alias("lb")), ["file", "g"]).groupBy("file", "g").agg(F.sum(F.when(F.col("block") > F.col("lb"), F.col("n")).otherwise(0)).alias("behind"))
    sums = sums.join(behind, ["file", "g"])
    over = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.partitionBy("file")
    carried = (
        sums.withColumn("ids0", F.coalesce(F.sum("n").over(over), zero))
        .withColumn("docs0", F.coalesce(F.sum("seps").over(over), zero))
        .withColumn("cut0", F.when(F.col("seps") > 0, F.col("ids0") + F.col("n") - F.col("last.tail") - F.col("behind")))
        .withColumn("before0", F.coalesce(F.max("cut0").over(over), zero))
        .withColumn("final", F.max("top").over(ends))
        .select("file", "g", "ids0", "docs0", "before0", "final")
    )
    at = local.join(carried, ["file", "g"]).withColumn("open", F.coalesce(F.col("ids0") + F.col("before"), F.col("before0"))).withColumn("at", F.col("ids0") + F.col("ids"))
    document = lambda start, n, closed: F.struct(start.alias("start"), n.alias("tokens"), F.lit(closed).alias("closed"))
    none = F.array().cast("array<struct<start:bigint,tokens:bigint,closed:boolean>>")
    # the block's first document may begin in a block before; those behind it lie within
    first = document(F.col("open"), F.col("at") - F.col("open") + F.col("head"), True)
    within = F.transform("inner", lambda x: document(F.col("at") + x["at"], x["tokens"], True))
    last_start = F.when(F.col("seps") > 0, F.col("at") + F.col("n") - F.col("tail")).otherwise(F.col("open"))
    rest = document(last_start, F.col("at") + F.col("n") - last_start, False)
    closing = F.when((F.col("block") == F.col("final")) & (rest["tokens"] > 0), F.array(rest)).otherwise(none)
    bounded = F.when(F.col("seps") > 0, F.concat(F.array(first), within)).otherwise(none)
    rows = at.select("file", (F.col("docs0") + F.col("docs")).alias("k"), F.posexplode(F.concat(bounded, closing)).alias("i", "d"))
    return rows.select("file", (F.col("k") + F.col("i")).alias("ordinal"), "d.start", "d.tokens", "d.closed")


def write_flat(documents: DataFrame, *, vocabulary: str | None = None, separator: int = SEPARATOR, block: int = BLOCK, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Tokenises documents into one flat file for each partition, kept as blocks in the shared folder.  Returns the
    blocks (file, block, data), and beside them who is the file's n-th document (file, ordinal, key)."""
    spark = documents.sparkSession
    path = vocabulary or tokens.vocabulary_path()
    rows = documents.select(documents[key].alias("_key"), documents["text"].alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    end = np.array([separator], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, encode, key_type = TaskContext.get().partitionId(), tokens.encoder(path, plain=True).encode, None
        held, size, n, ordinal, keys = [], 0, 0, 0, []

        def cut(all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, n, keys, ordinal
            raw, at = b"".join(held), 0
            while size - at >= 2 * block or all_of_it and (at < size or keys):
                part = raw[at : at + 2 * block]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.int64()), (n, pa.int64()), (part, pa.binary()), (ordinal, pa.int64()), (keys, pa.list_(key_type)))], names=["file", "block", "data", "first", "keys"])
                n, at, ordinal, keys = n + 1, at + len(part), ordinal + len(keys), []
            held, size = [raw[at:]], size - at

        for b in batches:
            key_type = b.schema.field("_key").type
            ids, texts = b.column("_key").to_pylist(), b.column("_text").to_pylist()
            for a in range(0, len(ids), tokens.TOGETHER):
                for k, x in zip(ids[a : a + tokens.TOGETHER], encode(texts[a : a + tokens.TOGETHER]), strict=True):
                    flat = np.frombuffer(x, "<u4").astype("<u2").tobytes()
                    held += [flat, end]
                    size += len(flat) + 2
                    keys.append(k)
                if size >= 2 * block:
                    yield from cut()
        if size:
            yield from cut(True)

    schema = f"file bigint, block bigint, data binary, first bigint, keys array<{kind}>"
    out = scratch_path(spark, "flat-tokens")
    map_texts(rows, run, schema).write.option("compression", "zstd").parquet(out)
    kept = spark.read.schema(schema).parquet(out)
    who = kept.select("file", "first", F.posexplode("keys").alias("i", key)).select("file", (F.col("first") + F.col("i")).alias("ordinal"), key)
    return kept.select("file", "block", "data"), who
