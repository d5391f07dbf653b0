"""Order MinHash fingerprints of documents, with built-in functions only.

The k-mers (``k`` consecutive words) of a text are numbered by occurrence, so
the third "a b c" differs from the first, and hashed. The hash space is a ring
with ``slots`` evenly spaced points; for each point the ``per_slot`` numbered
k-mers next after it are the minimal ones under that shift of the ring. They
are put back in text order and their tuple is hashed. Two texts agree in a
slot if they select the same k-mers and hold them in the same order, so the
share of equal slots falls with edits and with moved passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import let, materialize, nonempty, partitions

WORD_END = r"[\s]+"


def _numbered(kmers: Column) -> Column:
    """(s, p) of each k-mer: hash of k-mer and occurrence number, and position; ascending by s."""
    plain = F.transform(kmers, lambda h, p: F.struct(F.xxhash64(h, F.lit(0)).alias("s"), p.alias("p")))

    def runs(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        starts = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: (j == 0) | (F.get(ordered, j)["h"] != F.get(ordered, j - 1)["h"]),
        )

        def number(starts: Column) -> Column:
            run = lambda first, r: F.transform(
                F.sequence(first, F.coalesce(F.get(starts, r + 1) - 1, last)),
                lambda j: F.struct(F.xxhash64(F.get(ordered, j)["h"], j - first).alias("s"), F.get(ordered, j)["p"].alias("p")),
            )
            return F.flatten(F.transform(starts, run))

        return let(starts, number)

    by_kmer = F.sort_array(F.transform(kmers, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    repeated = F.size(F.array_distinct(kmers)) < F.size(kmers)
    return F.sort_array(F.when(repeated, let(by_kmer, runs)).otherwise(plain))


def _slots(ordered: Column, slots: int, per_slot: int) -> Column:
    """The tuple hash of each slot; ``ordered``: numbered k-mers ascending by hash, at least one."""
    bits = slots.bit_length() - 1
    slot_of = lambda e: F.shiftright(e["s"], 64 - bits).cast("int") + slots // 2
    size = F.size(ordered)
    changes = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (slot_of(F.get(ordered, i)) != slot_of(F.get(ordered, i - 1))),
    )

    def starts(changes: Column) -> Column:
        """Where the ring's points fall: the first k-mer at or after each."""
        reach = lambda i, r: F.array_repeat(
            i, slot_of(F.get(ordered, i)) - F.when(r == 0, F.lit(-1)).otherwise(slot_of(F.get(ordered, F.get(changes, r - 1))))
        )
        around = F.array_repeat(F.lit(0), slots - 1 - slot_of(F.get(ordered, size - 1)))
        return F.concat(F.flatten(F.transform(changes, reach)), around)

    def tuple_hash(start: Column) -> Column:
        chosen = F.transform(
            F.sequence(F.lit(0), F.least(F.lit(per_slot), size) - 1),
            lambda o: F.struct(F.get(ordered, (start + o) % size)["p"].alias("p"), F.get(ordered, (start + o) % size)["s"].alias("s")),
        )
        return F.shiftright(F.xxhash64(F.transform(F.sort_array(chosen), lambda e: e["s"])), 32).cast("int")

    return F.transform(let(changes, starts), tuple_hash)


def signature(text: Column, k: int = 3, slots: int = 64, per_slot: int = 2) -> Column:
    """Order MinHash signature: ``slots`` (a power of two) tuple hashes of 32 bits.

    A text of fewer than ``k`` words is one k-mer. Null, empty and blank texts
    have the empty signature. Equal texts have equal signatures.
    """
    if slots < 2 or slots & (slots - 1):
        raise ValueError("slots must be a power of two")

    def of_words(hashes: Column) -> Column:
        count = F.size(hashes)
        kmers = F.transform(
            F.sequence(F.lit(0), F.greatest(count - k, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k))),
        )
        return F.when(count > 0, let(let(kmers, _numbered), lambda o: _slots(o, slots, per_slot))).otherwise(
            F.array().cast("array<int>")
        )

    words = nonempty(F.split(F.coalesce(text, F.lit("")), WORD_END))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; two empty signatures are alike, an empty and another are not."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(equal / most)


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda h: F.right(F.lpad(F.hex(h), 16, "0"), F.lit(8))), ""))


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", **parameters) -> DataFrame:
    """``df`` with ``out``, the signature of each whole text; a column named ``out`` gives way."""
    return df.withColumn(out, signature(F.col(text_col), **parameters))


def neighbours(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, next_id, prev_id) in descending order of id, as a ring; one row per id.

    The ids are dealt by range, each range is ordered on its own, and only the
    ends of the ranges meet, one row for each. Null ids come last.
    """
    n = 4 * partitions(ids.sparkSession)
    ranged = ids.select(F.col(id_col).alias("id")).distinct().repartitionByRange(n, F.col("id").desc_nulls_last())
    ranged = materialize(ranged.withColumn("block", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("block").orderBy(F.col("id").desc_nulls_last())
    heads = ranged.groupBy("block").agg(F.max_by("id", F.struct(F.col("id").isNotNull(), F.col("id"))).alias("head"))
    ends = Window.orderBy("block")  # a row for each range, as many as partitions
    following = heads.withColumn("then", F.coalesce(F.lead("head").over(ends), F.first("head").over(ends)))
    following = following.select("block", "then")
    within = ranged.withColumn("next", F.lead(F.struct("id")).over(inside))
    out = within.join(F.broadcast(following), "block").select("id", F.coalesce("next.id", "then").alias("next_id"))
    back = out.select(F.col("next_id").alias("id"), F.col("id").alias("prev_id"))
    return out.join(back, "id")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    Edited: the last floor(n/2) code points give way to the first as many (or
    all) of the next document in descending order of id, the first after the
    last. Ids should be unique: rows that repeat an id meet each row of their
    neighbours. Rows with a null id have no neighbours and are left out.

    The text is shuffled once by id, and once more the part that goes into the
    document before; the signatures are written before, from an own scan.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    own = materialize(rows.select("id", F.char_length("text").cast("long").alias("n"), signature(F.col("text"), **parameters).alias("sig")), "signatures")
    ring = neighbours(own, "id")
    half = own.select(F.col("id").alias("prev_id"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    needs = ring.join(half, "prev_id").select("id", "prev_id", "need").distinct()
    given = rows.join(needs, "id").select(F.col("prev_id").alias("id"), F.left("text", "need").alias("tail"))
    text = rows.join(given, "id")
    n = F.char_length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), "tail")
    after = own.select(F.col("id").alias("next_id"), F.col("sig").alias("next_sig"))
    known = own.join(ring.select("id", "next_id"), "id").join(after, "next_id").select("id", "n", "sig", "next_sig")
    out = text.select("id", edited.alias("edited")).select(
        "id", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), signature(F.col("edited"), **parameters).alias("edited_sig")
    )
    return out.join(known, "id").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
