"""Golden-dataset grid, validation and n-gram decontamination."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelab.functions.tables import written
from judgelab.functions.text import is_blank, ngrams, slug, tokens

DIFFICULTIES = ("easy", "medium", "hard", "adversarial")
EDGE_CASES = ("empty_input", "unicode_stress", "prompt_injection", "refusal_bait", "ambiguity", "format_trap")


def grid(topics: DataFrame, personas: list[str], difficulties: tuple[str, ...] = DIFFICULTIES, edges: tuple[str, ...] = EDGE_CASES, items_per_cell: int = 1) -> DataFrame:
    """Cells topic x persona x difficulty in that nesting, each with ``items_per_cell`` items whose edge case cycles.

    ``topics`` has (ordinal, topic, capability) and what else an item shall carry.  The lists are parameters and
    so fixed in size; only the topics are a table.
    """
    per_topic = len(personas) * len(difficulties)
    cells = topics.select("*", F.posexplode(F.array(*[F.lit(p) for p in personas])).alias("pi", "persona")).select("*", F.posexplode(F.array(*[F.lit(d) for d in difficulties])).alias("di", "difficulty"))
    cell = F.col("ordinal") * per_topic + F.col("pi") * len(difficulties) + F.col("di")
    items = cells.select("*", cell.cast("long").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(items_per_cell - 1))).alias("k")).drop("ordinal", "pi", "di")
    items = items.withColumn("number", F.col("cell") * items_per_cell + F.col("k"))  # the ordinal grows with every item
    edge = F.element_at(F.array(*[F.lit(e) for e in edges]), F.pmod(F.col("number") * items_per_cell + F.col("k"), F.lit(len(edges))).cast("int") + 1)
    return items.withColumn("edge_case", edge).withColumn("item_id", F.concat_ws("__", "topic", slug(F.col("persona")), "difficulty", "edge_case", F.col("k").cast("string")))



def coverage(items: DataFrame) -> DataFrame:
    return items.groupBy(F.concat_ws("|", "topic", "persona", "difficulty").alias("cell")).agg(F.count("*").alias("n"))


def validate(items: DataFrame) -> DataFrame:
    """(item_id, problem): empty or repeated ids, empty references, empty prompts outside the empty-input case.

    An id that n items have is a problem n - 1 times; ids are counted, not
    gathered, and a count is spelt out in steps of 4,096.
    """
    blank = lambda c: is_blank(F.coalesce(F.col(c), F.lit("")))
    found = F.array_compact(F.array(F.when(blank("item_id"), F.lit("empty item_id")), F.when(blank("reference"), F.lit("empty reference")), F.when(blank("prompt") & (F.col("edge_case") != "empty_input"), F.lit("empty prompt"))))
    rows = items.select("item_id", F.explode(found).alias("problem"))
    again = items.groupBy("item_id").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    steps = again.select("item_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).alias("from"))
    return rows.unionByName(steps.select("item_id", F.explode(F.array_repeat(F.lit("duplicate item_id"), F.least(F.lit(4096), F.col("n") - F.col("from")).cast("int"))).alias("problem")))


def corpus_ngrams(corpus: DataFrame, text: str, n: int = 8) -> DataFrame:
    """Distinct n-grams of the corpus, line by line."""
    lines = corpus.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line"))
    return lines.select(F.explode(ngrams(tokens("line"), n)).alias("gram")).distinct()


#: Slots of the n-gram filter, a byte each, at least and at most; a page is what one bitmap of Spark's holds.
SLOTS, PAGE = (1 << 20, 1 << 24), 32768


def _slots(gram: Column, slots: int) -> list[Column]:
    """Two places of an n-gram in the filter."""
    return [F.pmod(F.xxhash64(F.lit(seed), gram), F.lit(slots)) for seed in (1, 2)]


def gram_filter(grams: DataFrame, count: int):
    """A test that all of ``grams`` (gram) pass, and of other n-grams about one in seventy while there are at most a million.

    Its size is 16 bytes for each n-gram, between the bounds of ``SLOTS``: bits
    are set in bitmaps on the executors, and 4 KB a page come to the driver.
    """
    slots = SLOTS[0]
    while slots < 16 * count and slots < SLOTS[1]:
        slots *= 2
    at = grams.select(F.explode(F.array(*_slots(F.col("gram"), slots))).alias("at"))
    pages = at.groupBy(F.floor(F.col("at") / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % PAGE).alias("bits")).collect()
    held = np.zeros(slots, dtype=np.uint8)
    for r in pages:
        held[r["page"] * PAGE : (r["page"] + 1) * PAGE] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")[:PAGE]
    # A scalar subquery: tasks get the value with their code, and plans don't spell it out.
    table, one = grams.sparkSession.createDataFrame([(bytearray(held.tobytes()),)], "bits binary").scalar(), F.lit(bytearray(b"\x01"))

    def may_be(gram: Column) -> Column:
        first, second = (F.substring(table, s.cast("int") + 1, 1) == one for s in _slots(gram, slots))
        return first & second

    return may_be


def contamination(items: DataFrame, corpus: DataFrame, id_col: str, item_text: str, corpus_text: str, n: int = 8) -> DataFrame:
    """(id, gram) shared with the corpus.

    A filter of the items' distinct n-grams goes to the scan of the corpus, so
    that n-grams which can't match are never shuffled; a semi join then decides.
    """
    mine = written(items.select(id_col, F.explode(F.array_distinct(ngrams(tokens(item_text), n))).alias("gram")))
    may_be = gram_filter(mine.select("gram"), mine.count())
    lines = corpus.select(F.explode(F.split(F.col(corpus_text), "\n", -1)).alias("line"))
    near = lines.select(F.explode(ngrams(tokens("line"), n)).alias("gram")).filter(may_be(F.col("gram")))
    theirs = near.join(mine.select("gram").distinct(), "gram", "left_semi").distinct()
    return mine.join(theirs, "gram", "left_semi").select(id_col, "gram")


def flag_contaminated(items: DataFrame, corpus: DataFrame, id_col: str, item_text: str, corpus_text: str, n: int = 8) -> DataFrame:
    """Every item's id with n_hits, contaminated and its first five shared n-grams."""
    hits = contamination(items, corpus, id_col, item_text, corpus_text, n).groupBy(id_col).agg(F.count("*").alias("n_hits"), F.slice(F.array_sort(F.collect_set("gram")), 1, 5).alias("sample"))
    out = items.select(id_col).join(hits, id_col, "left")
    return out.select(id_col, F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.col("n_hits").isNotNull().alias("contaminated"), F.coalesce(F.array_join("sample", "; "), F.lit("")).alias("sample"))


def drop_contaminated(items: DataFrame, corpus: DataFrame, id_col: str, item_text: str, corpus_text: str, n: int = 8) -> DataFrame:
    return items.join(contamination(items, corpus, id_col, item_text, corpus_text, n), id_col, "left_anti")


#: Digests of a leaf of the tree, about.
LEAF = 64


def dataset_digest(items: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """One row (n_items, sha256): the root of a hash tree over the rows' digests, whatever their order and partitioning.

    Unlike digests are counted, and put into leaves by their first hex digits,
    as many as leave about ``LEAF`` of them in each; a leaf is the digest of its
    lines ``digest:count`` in order.  A parent is the digest of the nodes that
    differ in their last digit, 16 at most, up to the root.
    """
    rows = written(items.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    kinds, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    digits = digest_digits(kinds)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"], F.lit(":"), x["n"].cast("string")))
    nodes = rows.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("h"))
    for k in range(digits - 1, -1, -1):
        nodes = nodes.groupBy(F.substring("p", 1, k).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    root = nodes.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("sha256"))  # one node
    return root.select(F.lit(total).cast("long").alias("n_items"), "sha256")


def digest_digits(kinds: int) -> int:
    """Hex digits that leave at most ``LEAF`` digests to a leaf on average."""
    digits = 0
    while kinds > LEAF * 16**digits:
        digits += 1
    return digits
