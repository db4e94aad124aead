"""A stored table of token positions, for phrase searches over a corpus that grows.

The table lies in folders by batch and by bucket of the token. A row is one block of a token: its documents within one
range of ids, in order, with their positions, and the first and the last of them. A batch of new documents adds files
and rewrites none. A search reads the buckets of its tokens only, and within them the row groups that hold the tokens;
in a block it starts from the rarest token of a phrase and looks up the others for the documents that are left.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import phrase_tokens, tokens_of
from .phrases import _phrase_literals, fitting_windows

BUCKETS = 64
BLOCK_IDS = 4096
SCHEMA = (
    "token string, block bigint, n_docs bigint, first_doc bigint, last_doc bigint, "
    "postings array<struct<doc_id:bigint,places:array<int>>>, batch string, bucket int"
)


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _slots(docs: DataFrame) -> int:
    """Parts of a bucket: two a shuffle partition over all buckets, so that tasks get about as much each."""
    return 2 * -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_ids: int = BLOCK_IDS, buckets: int = BUCKETS) -> DataFrame:
    """(token, block, n_docs, first_doc, last_doc, postings, bucket) of integer ids, none null, each on one row.

    Tokens are shuffled once, by cell: the bucket of the token and a slot in it that follows token and block, so a token
    that most documents hold is spread over its blocks; a group holds the documents of one range of ids. A task has all
    rows of its cells and few buckets, so neither the groupings nor a writer by buckets shuffle again.
    """
    slots = _slots(docs)
    doc = F.col(id_col).cast("bigint")
    rows = docs.select(doc.alias("doc_id"), F.posexplode(tokens_of(F.col(text_col))).alias("place", "token"))
    block = F.floor(F.col("doc_id") / F.lit(block_ids)).cast("bigint")
    cell = _bucket(F.col("token"), buckets) * slots + F.pmod(F.xxhash64("token", block), F.lit(slots)).cast("int")
    dealt = rows.withColumn("_cell", cell).repartition("_cell")
    places = dealt.groupBy("_cell", "token", "doc_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    blocks = places.groupBy("_cell", "token", block.alias("block")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.array_sort(F.collect_list(F.struct("doc_id", "places"))).alias("postings"),
    )
    bucket = F.floor(F.col("_cell") / F.lit(slots)).cast("int").alias("bucket")
    return blocks.select("token", "block", "n_docs", "first_doc", "last_doc", "postings", bucket)


def add_batch(
    docs: DataFrame, path: str, batch: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, block_ids: int = BLOCK_IDS
) -> None:
    """Write the positions of new documents; those of earlier batches stay as they are.

    A batch of the same name is written anew. Ids must not stand in another batch; null texts hold no token.
    """
    blocks = token_blocks(docs, id_col, text_col, block_ids, buckets)
    # One file a bucket and task; rows in the order of tokens, so that a row group spans few of them.
    ordered = blocks.sortWithinPartitions("bucket", "token", "block")
    writer = ordered.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", str(8 << 20))
    writer.parquet(f"{path.rstrip('/')}/batch={batch}")


def read_blocks(spark: SparkSession, path: str, tokens: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The blocks of the tokens: other buckets' files are not read, nor row groups without the tokens."""
    wanted = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(list(tokens))), "array<string>")).alias("token"))
    numbers = sorted({row["bucket"] for row in wanted.select(_bucket(F.col("token"), buckets).alias("bucket")).collect()})
    table = spark.read.schema(SCHEMA).parquet(path)
    return table.filter(F.col("bucket").isin(numbers) & F.col("token").isin(list(tokens)))


def stored_phrase_search(
    spark: SparkSession, path: str, phrases: Sequence[str], slop: int = 4, buckets: int = BUCKETS
) -> DataFrame:
    """The rows of ``phrase_search`` over all batches, from the stored positions alone.

    First the keys of the blocks tell in which ones a phrase has all its tokens; only those come with their positions,
    one group for a phrase and block. In it the lists of documents are intersected, the rarest token's first, and the
    documents that are left get the positions of all tokens.
    """
    terms = {phrase: sorted(set(phrase_tokens(phrase))) for phrase in dict.fromkeys(phrases)}
    blocks = read_blocks(spark, path, sorted({token for found in terms.values() for token in found}), buckets)
    # Literals: a row per phrase and token, and a row per phrase.
    pairs = [{"phrase": phrase, "token": token, "n": len(found)} for phrase, found in terms.items() for token in found]
    literal = F.from_json(F.lit(json.dumps(pairs)), "array<struct<phrase:string,token:string,n:int>>")
    wanted = F.broadcast(spark.range(1).select(F.inline(literal)))
    sought = F.broadcast(spark.range(1).select(F.explode(_phrase_literals(list(terms))).alias("sought")))

    place = ["phrase", "batch", "block"]
    keys = blocks.select("token", "batch", "block").join(wanted, "token")
    full = keys.groupBy(*place, "n").agg(F.count(F.lit(1)).alias("_n")).filter("_n = n").select(*place)
    entry = F.struct("n_docs", "token", F.col("postings.doc_id").alias("docs"), F.col("postings.places").alias("places"))
    lists = (
        blocks.join(wanted, "token")
        .join(full, place, "left_semi")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(entry)).alias("lists"))
    )
    rest = F.slice("lists", F.lit(2), F.size("lists"))
    docs = F.aggregate(rest, F.get("lists", F.lit(0)).docs, lambda held, one: F.array_intersect(held, one.docs))

    def at(one: Column, doc: Column) -> Column:
        return F.struct(one.token, F.element_at(one.places, F.array_position(one.docs, doc).cast("int")))

    held = lists.select("phrase", "lists", F.explode(docs).alias("doc_id"))
    positions = F.map_from_entries(F.transform("lists", lambda one: at(one, F.col("doc_id"))))
    candidates = held.select("phrase", "doc_id", positions.alias("positions")).join(sought, F.col("phrase") == F.col("sought.phrase"))
    return fitting_windows(candidates.select("doc_id", "positions", "sought"), slop)
