"""Mixing sources to target weights: fixed-length blocks, source counts drawn for each output shard, permuted block indices.

Each source's words, in a fixed pseudorandom order of its documents, form one line that is cut into blocks of
``BLOCK`` words (the last one shorter). A source that gets T words takes whole passes over its line and a part of one more.

Output shards have ``SHARD_BLOCKS`` slots each. How many slots of a shard each source gets is drawn: a multinomial draw with the targets' shares, under the condition
that the counts over all shards add up to each source's slots, so the weights are met to the word. (It is drawn as a keyed permutation of all slots, cut into shards and counted.) A shard takes the
source's next slots after those of the shards before it, so the counts say which slots, and with them which blocks and documents, are in which shard.
In every pass slot k takes block ``p(k)``, where p is a keyed permutation of its own for each (seed, source, pass); the short block comes last and the source's final slot is cut.
Slots and document pieces meet in one join by (source, block index).

The keyed permutation of 0..m-1 is an additive Feistel network of six rounds over pairs (x, y), x under a = ceil(m / b), y under b = ceil(sqrt(m)); what
falls on the fewer than b places beyond m is mapped again until it is inside.

Targets: sources in code-point order, null last, weigh 5, 2, 1 in turn and share 150 % of all words; no target exceeds twice
its source, the excess goes to the others by weight. In the order of (limit / weight) the level of this water-filling is
the greatest of the levels ``(total - limits before) / weights from here``, which a window over the sources gives at once.

Everything is built-in functions: no Python on the executors, nothing collected but two counts. A hot source
is numbered over hash buckets and its slots are drawn in chunks and made by shard, so it uses as many tasks as its size.

Edge cases: null and blank texts have size 0 and nothing is taken of them; a source without words has target 0; a null
source is a source; rows that repeat a doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import done, forget, table, written

BLOCK = 1024
SHARE, LIMIT = 1.5, 2
WEIGHTS = (5, 2, 1)
SEED = 17
SHARD_BLOCKS = 2048
ROUNDS, WALK = 6, 24
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
SMALL_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source, source_size) -> the same with weight and target."""
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    numbered = sizes.withColumn("n", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    numbered = numbered.withColumn("weight", F.element_at(weights, (F.col("n") % len(WEIGHTS) + 1).cast("int")))
    by_limit = Window.partitionBy().orderBy(LIMIT * F.col("source_size") / F.col("weight"), "n")
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(LIMIT * F.col("source_size")).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levels = numbered.withColumn("level", level)
    top = F.max("level").over(everything)
    return levels.withColumn("target", F.least((LIMIT * F.col("source_size")).cast("double"), F.col("weight") * top)).drop("n", "level")


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("v"), F.coalesce("source", F.lit("")))


def _copy_number(text_hash) -> Column:
    """Rows of one doc_id, source and size are told apart by a running number in the order of their texts' hashes."""
    return F.row_number().over(Window.partitionBy("doc_id", "skey", "size").orderBy(text_hash))


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written sizes, the documents with their offset in their source's line, and the sources with targets."""
    base = docs.select("doc_id", "source", source_key().alias("skey"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("print"))
    base = sizes = written(base.withColumn("copy", _copy_number("print")).drop("print"), "sizes")
    n_docs = base.count()
    buckets = 64
    while buckets * 10_000 < n_docs and buckets < 1 << 20:
        buckets *= 2
    base = base.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(buckets)).cast("int"))
    sums = base.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    before = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    sources = source_targets(base.groupBy("skey").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")))
    sources = written(sources, "sources")
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1))
    placed = base.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before.hint("merge"), ["skey", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    return sizes, placed.select("doc_id", "skey", "size", "copy", "at"), sources


def permuted(value: str, size: str, *key: str) -> str:
    """SQL of the place of ``value`` under the keyed permutation of 0..size-1; all arguments are SQL of longs that are not null.

    A walk over the places beyond ``size`` ends within b steps; of WALK steps more than enough are left where b is greater, as each leaves with probability 1 - 1/b at least.
    """
    b = f"greatest(1L, cast(ceil(sqrt(cast({size} as double))) as bigint))"
    a = f"greatest(1L, ({size} + {b} - 1) div {b})"
    drawn = lambda half: f"xxhash64({', '.join(key)}, r, {half})"
    step = f"if(r % 2 = 0, named_struct('x', (s.x + pmod({drawn('s.y')}, s.a)) % s.a, 'y', s.y, 'a', s.a, 'b', s.b), named_struct('x', s.x, 'y', (s.y + pmod({drawn('s.x')}, s.b)) % s.b, 'a', s.a, 'b', s.b))"
    once = lambda v: f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('x', {v} div {b}, 'y', {v} % {b}, 'a', {a}, 'b', {b}), (s, r) -> {step}, s -> s.x * s.b + s.y)"
    return f"aggregate(sequence(1, cast(least({b}, {WALK}L) as int)), {once(value)}, (v, i) -> if(v < {size}, v, {once('v')}))"


def _source_slots(sources: DataFrame, block: int) -> DataFrame:
    """(skey, full, tail, each, rest, last, slots, base, total): the slots of each source and how many those of earlier sources are."""
    s = sources.where("source_size > 0").select("skey", "source_size", F.round("target").cast("long").alias("words"))
    s = s.withColumn("full", F.expr(f"source_size div {block}")).withColumn("tail", F.expr(f"source_size % {block}")).withColumn("each", F.col("full") + (F.col("tail") > 0).cast("long"))
    s = s.withColumn("rest", F.expr("words % source_size")).withColumn("last", F.expr(f"(rest + {block - 1}) div {block}")).withColumn("slots", F.expr("(words div source_size) * each + last")).where("slots > 0")
    order = Window.partitionBy().orderBy("skey")
    return s.withColumn("base", F.sum("slots").over(order) - F.col("slots")).withColumn("total", F.sum("slots").over(Window.partitionBy()))


def shard_draws(per_source: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, skey, n, first): how many slots of each output shard a source gets, and the source's slots that earlier shards took."""
    chunks = per_source.select("skey", "slots", "base", "total", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    n = int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = chunks.repartition(n, "skey", "chunk").withColumn("slot", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(slots, (chunk + 1) * {CHUNK}) - 1)")))
    shard = F.expr(f"{permuted('(base + slot)', 'total', f'{seed}L')} div {shard_blocks}")
    counts = k.select("skey", shard.alias("shard")).groupBy("shard", "skey").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def slots(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(skey, slot, pass, block, words, shard): every slot of the mix, the block it takes and how many of its words."""
    per_source = _source_slots(sources, block)
    k = shard_draws(per_source, shard_blocks, seed).join(per_source, "skey").withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    k = k.withColumn("pass", F.expr("slot div each")).withColumn("place", F.expr("slot % each"))
    index = F.when(F.col("place") == F.col("full"), F.col("full")).otherwise(F.expr(permuted("place", "full", f"{seed}L", "skey", "pass")))
    words = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest") - (F.col("last") - 1) * block).when(F.col("place") == F.col("full"), F.col("tail")).otherwise(block)
    return k.select("skey", "slot", "pass", index.alias("block"), words.alias("words"), F.col("shard").cast("int").alias("shard"))


def mix(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, placed, sources). parts has a row for each document piece of each slot:
    skey, at and doc_id name the document, [from_word, to_word) what the slot takes of it, in shard, slot and pass."""
    base, placed, sources = _placed(docs)
    placed = written(placed, "placed")
    forget(base)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    pieces = pieces.withColumn("from_word", F.expr(f"greatest(0L, block * {block} - at)")).withColumn("to_word", F.expr(f"least(size, (block + 1) * {block} - at)")).withColumn("start", F.expr(f"at + from_word - block * {block}"))
    parts = pieces.join(slots(sources, block, shard_blocks).hint("merge"), ["skey", "block"]).withColumn("to_word", F.expr("least(to_word, from_word + words - start)")).where("to_word > from_word")
    return parts.select("skey", "at", "doc_id", "size", "copy", "shard", "slot", "pass", "block", "start", "from_word", "to_word"), placed, sources


def near_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the sources; they are broadcast while there are at most SMALL_SOURCES of them."""
    few = sources.count() <= SMALL_SOURCES
    return df.join(F.broadcast(sources) if few else sources, "skey")


def taken_words(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, source) -> (doc_id, size, source_size, target, taken, first_shard, n_shards), one row for each input row;
    the last two: the least output shard that has a part of the document (null: none) and how many have one."""
    parts, placed, sources = mix(docs)
    held = parts.groupBy("skey", "at", "shard").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = held.groupBy("skey", "at").agg(F.sum("taken").alias("taken"), F.min("shard").alias("first_shard"), F.count("*").alias("n_shards")).withColumnRenamed("skey", "k").withColumnRenamed("at", "o")
    out = placed.join(taken.hint("merge"), (F.col("size") > 0) & (F.col("skey") == F.col("k")) & (F.col("at") == F.col("o")), "left")
    out = near_sources(out, sources.select("skey", "source_size", "target"))
    out = out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", F.coalesce("n_shards", F.lit(0)).alias("n_shards"))
    return done(out, "taken", [placed, sources])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and pass with the words taken of it, other columns unchanged.

    What a pass takes whole keeps its text as it is; parts are joined by spaces. Rows are dealt to tasks by the output shard of their first block and ordered by slot in it. Rows that repeat a doc_id are told apart by
    source, size and a running number.
    """
    parts, placed, _ = mix(docs)
    runs = parts.groupBy("skey", "doc_id", "size", "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("_ranges"), F.min(F.struct("shard", "slot", "start")).alias("_at"))
    runs = runs.select(*[F.col(c).alias(f"_run_{c}") for c in ("skey", "doc_id", "size", "copy")], "_ranges", "_at")
    columns = [F.col(c).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text", source_key().alias("skey"), word_count(F.col("text")).alias("size")).where("size > 0")
    if placed.where("copy > 1").isEmpty():
        keyed = keyed.withColumn("copy", F.lit(1))
    else:
        keyed = keyed.withColumn("copy", _copy_number(F.xxhash64("text")))
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("_run_doc_id")) & (F.col("skey") == F.col("_run_skey")) & (F.col("size") == F.col("_run_size")) & (F.col("copy") == F.col("_run_copy")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_ranges", lambda r: F.slice("_words", (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int")))), " ")
    got = F.aggregate("_ranges", F.lit(0).cast("long"), lambda a, r: a + r["to_word"] - r["from_word"])
    whole = got == F.col("size")
    joined = joined.withColumn("_words", F.when(~whole, words)).withColumn("_text", F.when(whole, F.col("text")).otherwise(cut))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    mixed = joined.select("_at", F.struct(*[new.get(c, F.col(f"_row._doc_{i}")).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    dealt = mixed.repartition(F.col("_at.shard")).sortWithinPartitions("_at")
    return dealt.select(*[F.col(f"_row._doc_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
