"""What the operators share: reading tables, shared intermediate tables, bounded filters and label samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Bits of the key filter: 2^26 bits in at most 2,048 rows of 4 KiB, so 8 MiB whatever the number of keys.
FILTER_BITS = 1 << 26
_PAGE_BITS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The table stays until release() is called (see sources.files), as results are read lazily.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch: what a worker holds is bounded by this and by the longest text, not by a number of rows.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow() with batches of at most BATCH_BYTES (set for the session, unless it has a lower bound)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def guarded(docs: DataFrame, *known: str):
    """``docs`` with all columns but the known ones renamed, so that none clashes, and what undoes it for a result."""
    inner = docs.select(*(docs[c].alias(c if c in known else f"_x{k}") for k, c in enumerate(docs.columns)))
    return inner, lambda out: out.select(*(out[i].alias(c) for i, c in zip(inner.columns, docs.columns, strict=True)))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed keys, at most 8 MiB however many keys there are. Absent keys may pass, present ones always do."""
    slots = keys.select(_slot(F.col(column)).alias("slot")).select(
        F.floor(F.col("slot") / _PAGE_BITS).cast("int").alias("_page"), (F.col("slot") % _PAGE_BITS).alias("_bit")
    )
    return slots.groupBy("_page").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))


def pass_filter(df: DataFrame, bitmap: DataFrame, key: Column, how: str = "keep") -> DataFrame:
    """Rows whose key may be in ``bitmap`` (keep), or a column ``_maybe`` that says so (mark). Broadcasts 8 MiB at most."""
    slot = _slot(key)
    page, bit = F.floor(slot / _PAGE_BITS).cast("int"), (slot % _PAGE_BITS).cast("int")
    marked = df.withColumn("_slot_page", page).withColumn("_slot_bit", bit).join(F.broadcast(bitmap), F.col("_slot_page") == F.col("_page"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(_slot_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"(shiftright({byte}, _slot_bit % 8) & 1) = 1"), F.lit(False))
    marked = marked.withColumn("_maybe", hit).drop("_slot_page", "_slot_bit", "_page", "_bits")
    return marked if how == "mark" else marked.filter("_maybe").drop("_maybe")


#: Characters of text that a label sample may bring to the driver.
SAMPLE_CHARS = 96 << 20


def label_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, most: int, chars: int = SAMPLE_CHARS, **more: Column):
    """Texts and labels of at most ``most`` labelled documents outside the held-out fold, as a pandas frame.

    The bounds are documented parameters of the trained operators: ``most`` documents, in the order of a hash of their
    ids, as long as their whole texts together have at most ``chars`` characters. Conflicting labels of one document
    count as their maximum; null labels are skipped; of several texts of one doc_id the least counts. ``more``: further
    columns of ``docs`` by name.
    """
    ids = (
        labels.select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("_id").isNotNull())
        .filter(remainder(F.col("_id"), divisor) != left_out)
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    texts = docs.select(docs["doc_id"].alias("_doc"), F.coalesce(docs["text"], F.lit("")).alias("text"), *(c.alias(k) for k, c in more.items()))
    # at most ``most`` ids and labels are broadcast
    drawn = stored(texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("_id", "text", "label", *more), "sample")
    so_far = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)  # ``most`` small rows
    sizes = drawn.groupBy("_id").agg(F.max(F.length("text")).alias("n"))
    fits = sizes.withColumn("_sum", F.sum("n").over(so_far)).filter(F.col("_sum") <= chars).select(F.col("_id").alias("_fit"))
    found = drawn.join(fits, F.col("_id") == F.col("_fit")).select("_id", "text", "label", *more).toPandas()
    return found.sort_values(["_id", "text"], ignore_index=True).drop_duplicates("_id", ignore_index=True)
