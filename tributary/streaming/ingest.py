"""A growing folder of documents: chunks of new ones are appended to a table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import chunks

DOCUMENT = "url string, content string, error string"


def stream(spark: SparkSession, folder: str, schema: str = DOCUMENT) -> DataFrame:
    """Documents of a folder as they arrive, JSON files or Parquet ones."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)


def chunk_stream(docs: DataFrame, id_: str = "url", text: str = "content", **sizes) -> DataFrame:
    """chunk_url (id#chunkN), chunk, tokens, text of usable documents; a chunk that came before doesn't come again.

    What is remembered are the chunks' names, as the index's own set of seen ones; it grows with the index.
    """
    usable = docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    if "error" in docs.columns:
        usable = usable.filter("error IS NULL")
    made = chunks(usable, id_, text, **sizes)
    return made.select(F.concat_ws("#chunk", F.col("id").cast("string"), F.col("chunk").cast("string")).alias("chunk_url"), "chunk", "tokens", "text").dropDuplicates(["chunk_url"])


def append_to(chunked: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a Parquet table: what is there now, or every five seconds."""
    writer = chunked.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
