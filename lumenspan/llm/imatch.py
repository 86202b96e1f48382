"""I-Match document fingerprints in DataFrame expressions alone.

Terms whose share of documents lies inside a band form the lexicon; a share of at least LOW bounds its
size by (terms in an average document) / LOW, whatever the number of documents. The lexicon is dealt at
random into subsets of three densities, so that texts of any length have subsets that hold a few of their
terms. A fingerprint has one value for each subset: the hash of the sorted distinct terms of the text in
it (0000: none). Likeness is the share of equal values among the subsets that either text has terms in;
texts without any lexicon term are hashed by all of their terms, anew for every subset, so that the values
together tell such texts apart by 64 bits.

Terms are runs of letters and digits in lower case, kept as 64-bit hashes.

Neighbours in descending order of doc_id are found inside blocks of about BLOCK_ROWS rows, whose bounds are
quantiles of the ids; an id that many rows share is a run of blocks by a hash of the text. The first row of a
block is handed to the block before it through a table of at most BLOCKS rows.

Defined cases: null text is empty; equal texts have equal fingerprints; rows with equal ids are ordered by a
hash of the text and by the text, null ids come last in the descending order; a single row is its own
neighbour; an empty table gives no rows; extra columns are ignored; a block's texts are sorted in one task,
spilling, and a text is in memory as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenspan.session import stored

#: Share of documents that a lexicon term is in.
LOW, HIGH = 0.003, 0.1
#: (parts that the lexicon is dealt into, parts that are used)
DENSITIES = ((32, 32), (256, 32), (2048, 32))
SUBSETS = sum(used for _, used in DENSITIES)
#: Lexicon rows up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of a block of neighbours, and the most blocks that ids are cut into.
BLOCK_ROWS, BLOCKS = 4096, 1 << 14
_ALL = -1


def terms(text: Column) -> Column:
    """Distinct terms of a text; the empty string stands for none."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subset) of the terms inside the band, by counts over all documents."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("term"))
    kept = seen.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= max(1, low * n)) & (F.col("df") <= max(1, high * n)))
    subsets, base = [], 0
    for k, (parts, used) in enumerate(DENSITIES):
        part = F.pmod(F.xxhash64("term", F.lit(k)), F.lit(parts)).cast("int")
        subsets.append(F.when(part < used, part + base))
        base += used
    return kept.select("term", F.explode(F.filter(F.array(*subsets), lambda s: s.isNotNull())).alias("subset"))


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _id, _hash, _block): later blocks hold greater rows in the order of (id, hash of the text, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = rows.count()
    cuts = max(1, min(BLOCKS, -(-n // BLOCK_ROWS)))
    found = rows.agg(F.percentile_approx("_id", _constants([k / cuts for k in range(1, cuts)], "double"), 4 * cuts).alias("b")).first()["b"] if cuts > 1 else None
    # an id that is a bound k times has about k blocks to itself; the blocks of what lies above begin after them
    bounds: list[tuple[int, int]] = []
    for b in sorted(found or []):
        if bounds and bounds[-1][0] == b:
            bounds[-1] = b, bounds[-1][1] + 1
        else:
            bounds.append((b, 1))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    values, widths = _constants([b for b, _ in bounds], "bigint"), _constants([k for _, k in bounds], "int")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    # binary search: how many bounds are not above the id
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(values, low + step - 1) <= F.col("_id")), low + step).otherwise(low)) if bounds else F.lit(0)
    rows = rows.withColumn("_below", below)
    if bounds:
        own = (F.get(values, F.col("_below") - 1) == F.col("_id")) & (F.get(widths, F.col("_below") - 1) > 1)
        # the upper 31 bits of the hash, from the least to the greatest, deal the rows of one id
        part = F.floor((F.shiftright("_hash", 33) + (1 << 30)) * F.get(widths, F.col("_below") - 1) / float(1 << 31))
        rows = rows.withColumn("_block", F.col("_below").cast("long") * (2 * BLOCKS) + F.when(own, part).otherwise(F.when(F.col("_below") > 0, BLOCKS + 1).otherwise(0)))
    else:
        rows = rows.withColumn("_block", F.lit(0).cast("long"))
    return rows.drop("_below")


def _numbered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("_row", F.row_number().over(_descending()))


def _constants(values: list, kind: str) -> Column:
    """A constant array, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _descending() -> WindowSpec:
    return Window.partitionBy("_block").orderBy(F.desc("_id"), F.desc("_hash"), F.desc("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(_block, _row, doc_id, text, next_text, _edge) with the next document in descending doc_id order.

    _edge marks the last row of a block, whose next row lies in another block.
    """
    rows = _blocks(docs)
    blocks = stored(rows.groupBy("_block").agg(F.max(F.struct("_id", "_hash", "text")).alias("f")).select("_block", "f.text"), "firsts")
    rows = _numbered(rows)
    # the block that follows in descending order; after the last one comes the first
    follows = blocks.select("_block", F.coalesce(F.lag("_block").over(Window.orderBy("_block")), F.max("_block").over(Window.partitionBy())).alias("_to"))
    handed = follows.join(blocks.select(F.col("_block").alias("_to"), F.col("text").alias("_handed")), "_to").select("_block", "_handed")
    rows = rows.withColumn("_next", F.lead("text").over(_descending()))
    rows = rows.join(handed, "_block")
    return rows.select("_block", "_row", "doc_id", "text", F.coalesce("_next", "_handed").alias("next_text"), F.col("_next").isNull().alias("_edge"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the text replaced by as many code points (or all) from the start of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


#: Versions of a text that are hashed beside each other.
_OWN, _EDITED, _NEXT = 0, 1, 2
_SLOT = 128  # more than SUBSETS + 1


def _values(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(_block, _row, _which, _values, _meta): one number for each subset, for rows(_block, _row, _which, text, _meta).

    The partitioning of rows by _block serves all steps. A row without a term stands for the text itself: it
    keeps texts without lexicon terms, carries _meta, and holds the hash of all terms for them. A group is
    one number, (_row, _which, subset), so that what is sorted is narrow.
    """
    small = words.count() <= BROADCAST_ROWS
    every = words.sparkSession.createDataFrame([(0, _ALL)], "term long, subset int").select(F.lit(None).cast("long").alias("term"), "subset")
    whole = F.xxhash64(F.array_sort(terms(F.col("text"))))
    found = rows.select("_block", (F.col("_row").cast("long") * 4 + F.col("_which")).alias("_g"), F.explode(F.concat(terms(F.col("text")), F.array(F.lit(None).cast("string")))).alias("t"), F.concat_ws("|", whole.cast("string"), "_meta").alias("_m"))
    found = found.where("t IS NULL OR t <> ''").select("_block", "_g", F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("term"), F.when(F.col("t").isNull(), F.col("_m")).alias("_m"))
    lookup = words.union(every)
    joined = found.join(F.broadcast(lookup) if small else lookup, found["term"].eqNullSafe(lookup["term"])).select("_block", (F.col("_g") * _SLOT + F.col("subset") + 1).alias("_g"), found["term"], "_m")
    hashed = joined.groupBy("_block", "_g").agg(F.xxhash64(F.array_sort(F.collect_list("term"))).alias("_hash"), F.max("_m").alias("_m"))
    subset, text = (F.col("_g") % _SLOT - 1).cast("int"), F.floor(F.col("_g") / _SLOT).cast("long")
    digits = lambda value: (F.pmod(value, F.lit(65535)) + 1).cast("int")
    pair = F.struct(subset.alias("s"), digits(F.col("_hash")).alias("v"))
    gathered = hashed.groupBy("_block", text.alias("_g")).agg(F.map_from_entries(F.collect_list(pair)).alias("_map"), F.max("_m").alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    alone, whole = F.size("_map") == 1, F.substring_index("_m", "|", 1).cast("long")
    return gathered.select(
        "_block", F.floor(F.col("_g") / 4).cast("long").alias("_row"), (F.col("_g") % 4).cast("int").alias("_which"),
        F.transform(slots, lambda k: F.coalesce(F.try_element_at("_map", k), F.when(alone, digits(F.xxhash64(whole, k))).otherwise(F.lit(0)))).alias("_values"), F.expr("substring(_m, instr(_m, '|') + 1)").alias("_meta"),
    )


def shown(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values among the subsets that either has terms in."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    return F.size(F.filter(both, lambda x: x == 2)) / F.size(F.filter(both, lambda x: x > 0))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id and fingerprint of every document."""
    rows = _numbered(_blocks(docs)).select("_block", "_row", F.lit(_OWN).alias("_which"), "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_meta"))
    out = _values(rows, stored(lexicon(docs, low, high), "lexicon"))
    return out.select(F.when(F.col("_meta") != "", F.col("_meta")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), shown(F.col("_values")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that to the next document."""
    words = stored(lexicon(docs, low, high), "lexicon")
    rows = neighbours(docs).withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    facts = F.concat_ws("|", F.char_length("text").cast("string"), F.sha2("_edited", 256), F.col("doc_id").cast("string"))
    version = lambda which, text, meta=F.lit(""): F.struct(which.alias("w"), F.col(text).alias("x"), meta.alias("m"))
    texts = F.array(version(F.lit(_OWN), "text", facts), version(F.lit(_EDITED), "_edited"), version(F.when(F.col("_edge"), _NEXT), "next_text"))
    parts = rows.select("_block", "_row", F.explode(texts).alias("_t")).where("_t.w IS NOT NULL").select("_block", "_row", F.col("_t.w").alias("_which"), F.col("_t.x").alias("text"), F.col("_t.m").alias("_meta"))
    pick = lambda which, c: F.first(F.when(F.col("_which") == which, F.col(c)), ignorenulls=True)
    prints = _values(parts, words).groupBy("_block", "_row").agg(
        pick(_OWN, "_values").alias("_own"), pick(_EDITED, "_values").alias("_edited"), pick(_NEXT, "_values").alias("_next"), F.split(pick(_OWN, "_meta"), r"\|").alias("_facts"))
    prints = prints.withColumn("_next", F.coalesce("_next", F.lead("_own").over(Window.partitionBy("_block").orderBy("_row"))))
    return prints.select(
        F.get("_facts", F.lit(2)).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.get("_facts", F.lit(0)).cast("long").alias("n_chars"), F.get("_facts", F.lit(1)).alias("edited_sha256"),
        shown(F.col("_own")).alias("fingerprint"), shown(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
