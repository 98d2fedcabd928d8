"""Order MinHash: fingerprints of texts that react to the order of their words.

A text is its sequence of words, or of characters where words are as long as in texts that are
written without blanks. Every k-mer (run of k words) is numbered by its occurrence,
so repeats count. All numbered k-mers of a text lie on a ring by their hash; each of ``size``
evenly spaced marks, one ordering each, selects the ``pick`` k-mers that follow it. The
selected k-mers are put back into text order and hashed as a tuple. The share of marks at
which two texts agree estimates how much of their words, in order, they have in common.

All steps are expressions within a row: nothing but the text itself is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.base import fresh, text_of, written

K, SIZE, PICK = 2, 64, 2
WORDLESS = 20  # characters for each word above which a text is taken by characters
NOTHING = "cast(array() as array<bigint>)"


def _sketch(df: DataFrame, text: str, out: str, k: int, size: int, pick: int) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as ``out``; 0 words: an empty array.

    Each step is a column of its own, as a lambda's inner expressions are not shared. Arrays
    that a lambda looks into are named twice in it: one named once would be moved into the
    lambda by the optimizer and be computed for each element.
    Positions sit in the low bits of the hashes, so one sort of longs orders the k-mers and
    says where they stood. Fewer than ``k`` words are one k-mer. ``size``: a power of two.
    """
    names = {n: fresh(f"{out}_{n}", df) for n in
             ("w", "a", "n", "b", "s", "r", "t", "c", "m")}
    w, a, n, b, s, r, t, c, m = (f"`{x}`" for x in names.values())
    low = f"(shiftleft(1L, {b}) - 1)"
    ngram = ", ".join(f"{w}[i + {j}]" for j in range(k))
    steps = [
        ("w", f"array_remove(split(`{text}`, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"),
        ("w", f"transform(case when char_length(`{text}`) > {WORDLESS} * size({w}) and "
              f"size({w}) > 0 then split(`{text}`, '') else {w} end, x -> xxhash64(x))"),
        # hashes of the k-mers, at their position
        ("a", f"case when size({w}) = 0 then {NOTHING} when size({w}) < {k} "
              f"then array(xxhash64({w})) else transform(sequence(0, size({w}) - {k}), "
              f"i -> xxhash64({ngram})) end"),
        ("n", f"size({a})"),
        # bits for a position
        ("b", f"cast(ceil(log2({n} + {size} + 1)) as int)"),
        ("s", f"sort_array(transform({a}, (h, i) -> shiftleft(shiftright(h, {b}), {b}) + i))"),
        # where a run of equal k-mers begins; within a run positions ascend
        ("r", f"case when {n} = 0 then cast(array() as array<int>) else "
              f"filter(sequence(0, {n} - 1), j -> j = 0 or "
              f"shiftright({s}[j], {b}) != shiftright({s}[j - 1], {b})) end"),
        # the ring: hash of (k-mer, occurrence) above, position below; marks among them
        ("t", f"flatten(transform({r}, (f, i) -> transform(sequence(f, "
              f"coalesce(get({r}, i + 1), {n}) - 1), j -> shiftleft(shiftright(xxhash64("
              f"{a}[cast({s}[j] & {low} as int)], j - f), {b}), {b}) + ({s}[j] & {low}))))"),
        ("m", f"transform(sequence(0, {size - 1}), i -> shiftleft(shiftright((i - {size // 2}) * "
              f"{2 ** 64 // size}L, {b}), {b}) + {n} + i)"),
        ("t", f"sort_array(concat({t}, {m}))"),
        ("c", f"filter({t}, x -> (x & {low}) < {n})"),
        # places of the marks in the sorted ring; i marks stand before the i-th
        ("m", f"filter(sequence(0, size({t}) - 1), j -> ({t}[j] & {low}) >= {n})"),
        (None, f"case when {n} = 0 then {NOTHING} else transform({m}, (p, i) -> "
               f"aggregate(sort_array(transform(sequence(0, least({pick}, {n}) - 1), "
               f"r -> get({c}, (p - i + r) % size({c})) & {low})), 42L, "
               f"(h, x) -> xxhash64(h, get({a}, cast(x as int))))) end"),
    ]
    kept = df.columns
    for name, step in steps:
        df = df.withColumn(names[name] if name else out, F.expr(step))
    return df.select(*kept, out)


def fingerprinted(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K,
                  size: int = SIZE, pick: int = PICK) -> DataFrame:
    """``df`` with the fingerprint of ``text``, ``size`` hashes; null and empty text: none.

    Equal texts have equal fingerprints; rows are not compared, so ties and repeats do not
    matter; other columns stay.
    """
    source = fresh("whole", df)
    return _sketch(df.withColumn(source, text_of(text)), source, out, k, size, pick).drop(source)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places, 0 to 1; two empty fingerprints are alike, an empty one and
    another are not."""
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(hits / longest)


def neighbours(slim: DataFrame, key: str) -> DataFrame:
    """Every ``key`` with the next one in ascending order, the last with the first.

    Keys are range-partitioned, so each partition looks for its own next keys and only the
    first key of each partition is compared across them. ``slim`` has distinct keys.
    """
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(slim.repartitionByRange(n, key).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(key)
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    over = Window.orderBy("part")  # one row per partition
    heads = firsts.select("part", F.coalesce(
        F.lead("first").over(over), F.min("first").over(Window.partitionBy())).alias("after"))
    # the join comes first, so that a partition of the window is the range it read
    return (ranged.join(heads, "part")
            .withColumn("next", F.coalesce(F.lead(key).over(inside), F.col("after")))
            .drop("part", "after"))


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K,
                       size: int = SIZE, pick: int = PICK) -> DataFrame:
    """Each document, its text with the end replaced by the next one's beginning, and both
    likenesses: to the edited text and to the next document.

    Half of the code points, rounded down, are replaced. Null ids sort first. Rows with equal
    id and text are one document, each of the rows has its result; rows with equal id and
    unequal text follow each other by a hash of the text. One row is its own next. Fingerprints
    are texts of eight hex digits a place, of an empty text empty. Columns out: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    own = docs.select(
        F.struct(F.col(key).alias("id"), F.xxhash64(text_of(text)).alias("h")).alias("k"),
        text_of(text).alias("text"))
    order = written(neighbours(
        own.select("k", F.char_length("text").alias("n")).distinct(), "k"))
    half = F.expr("n div 2")
    # the beginnings that documents lend to the one before them, and who lends
    lent = (order.select(F.col("next").alias("k"), F.col("k").alias("to"), half.alias("half"))
            .join(own, "k")
            .select("to", F.col("k").alias("next"), F.expr("substring(text, 1, half)").alias("tail"))
            .groupBy("to").agg(F.first("tail").alias("tail"), F.first("next").alias("next")))
    rows = (own.join(lent.withColumnRenamed("to", "k"), "k")
            .withColumn("n", F.char_length("text"))
            .withColumn("edited", F.expr("concat(substring(text, 1, n - n div 2), tail)")))
    both = _sketch(_sketch(rows, "text", "fingerprint", k, size, pick),
                   "edited", "edited_fingerprint", k, size, pick)
    # half of each hash is kept: they meet once more
    out = written(both.select(
        "k", "next", F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[F.transform(c, lambda x: F.shiftright(x, 32).cast("int")).alias(c)
          for c in ("fingerprint", "edited_fingerprint")]))
    prints = out.select(F.col("k").alias("next"), F.col("fingerprint").alias("theirs")) \
        .dropDuplicates(["next"])
    return out.join(prints, "next").select(
        F.col("k.id").alias(key), "n_chars", "edited_sha256", as_text("fingerprint"),
        as_text("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("theirs")).alias("near_next"))


def as_text(hashes: str) -> Column:
    """32-bit hashes as one text of eight hex digits each."""
    digits = F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(
        x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "").alias(hashes)
