"""Multi-party perspective rotation: every participant's view of a dialogue, as training text with masks.

For each participant the dialogue is rendered with that speaker as ``assistant``, the others as named users and
system turns as they are; the mask covers what the assistant says, with its end marker.

A conversation is gathered by id and every view of it is one row. Only a conversation whose text is over ``ROW_CHARS``, which no
row should hold, is sorted over range partitions instead and rendered in several rows (``part`` 0, 1, ...) that follow each
other without a gap, so that no task holds a whole conversation when one id has a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm._common import materialise

#: Code points of a conversation, markers included, that one row holds.
ROW_CHARS = 1 << 24
#: Code points of output that a worker gathers before it hands them on.
BATCH_CHARS = 1 << 22
#: Groups in which the parts of a long conversation meet its participants, and participants in a list.
SPREAD, LISTED = 32, 256
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _clean(s: str | None) -> str:
    """Text in which no marker can be mistaken for one of ours."""
    return (s or "").replace("<|", "< |")


def render(turns: list[tuple[str | None, str | None]], who: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The text of (speaker, text) turns as ``who`` sees them, and its loss spans as code points, end exclusive."""
    parts, spans, at = [], [], 0
    for speaker, text in turns:
        own = who is not None and speaker == who
        head = f"{START}assistant\n" if own else f"{START}system\n" if speaker == SYSTEM else f"{START}user name={_clean(speaker) if speaker is not None else 'unknown'}\n"
        body = f"{_clean(text)}{END}"
        if own:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(parts), spans


def _views(batches) -> Iterator[pa.RecordBatch]:
    """Rows (conv, part, turns, participants) to one row for each participant; output goes on in batches of bounded size."""
    names = ("conv", "participant", "part", "n_turns", "rendered", "mask", "n_loss")
    for batch in batches:
        kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        rows, size = [], 0
        for k in range(batch.num_rows):
            conv, part, said, people = (c[k].as_py() for c in batch.columns)
            turns = [(t["who"], t["said"]) for t in said]
            for who in people:
                text, spans = render(turns, who)
                rows.append((conv, who, part, len(turns), text, ",".join(f"{a}:{b}" for a, b in spans), sum(b - a for a, b in spans)))
                size += len(text)
                if size >= BATCH_CHARS or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", row_chars: int = ROW_CHARS) -> DataFrame:
    """One row per conversation and participant: conv, participant, part (0), n_turns, rendered, mask, n_loss.

    ``mask`` is ``start:end`` of every loss span in ``rendered``, comma-joined. Participants are the distinct non-null speakers but
    ``system``; a conversation without any is rendered once with a null participant and an empty mask. Turns are in
    the order of turn, speaker, text (nulls first), which also settles ties; repeated rows are repeated turns; a null or empty
    text is an empty turn, a null speaker is ``unknown`` and nobody's view; rows with a null conversation id are one
    conversation; an empty table gives no rows. Texts are rendered whole. A view of more than ``row_chars`` code points has several
    rows, whose texts joined by ``part`` are the view, each with its own counts and mask. Other columns are ignored, whatever their names.
    """
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("who"), F.col(text_col).cast("string").alias("said"))
    size = (F.length(F.coalesce("said", F.lit(""))) + F.length(F.coalesce("who", F.lit(""))) + 64).cast("long")
    long = materialise(turns.groupBy("conv").agg(F.sum(size).alias("n")).filter(F.col("n") > row_chars).select("conv"), "long-conversations")
    short = turns.join(long, turns["conv"].eqNullSafe(long["conv"]), "left_anti")
    everyone = F.sort_array(F.collect_set(F.when(F.col("who") != SYSTEM, F.col("who"))))
    gathered = short.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("turns"), everyone.alias("people"))
    nobody = F.array(F.lit(None).cast("string"))
    lists = gathered.select("conv", F.lit(0).cast("long").alias("part"), "turns", F.when(F.size("people") > 0, F.col("people")).otherwise(nobody).alias("people"))
    if long.take(1):
        lists = lists.unionByName(_long_parts(turns.withColumn("size", size), long, row_chars).withColumn("people", F.coalesce("people", nobody)))
    kind = df.schema[conv_col].dataType.simpleString()
    return lists.mapInArrow(_views, f"conv {kind}, participant string, part long, n_turns long, rendered string, mask string, n_loss long").withColumnRenamed("conv", conv_col)


def _long_parts(turns: DataFrame, long: DataFrame, row_chars: int) -> DataFrame:
    """Parts of the long conversations, once for each list of participants.

    A sort over range partitions and sums of sizes per (conversation, partition) give the parts. The participants may be many, so
    they come in lists of about LISTED, and a conversation's parts meet the lists in SPREAD groups.
    """
    rows = turns.join(long.select(F.col("conv").alias("conv_")), turns["conv"].eqNullSafe(F.col("conv_")), "inner").drop("conv_")
    rows = materialise(rows.orderBy("conv", "turn", "who", "said", F.rand(7)).withColumn("at", F.monotonically_increasing_id()).withColumn("slot", F.spark_partition_id()), "long-turns")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = rows.groupBy("conv", "slot").agg(F.sum("size").alias("size")).select(F.col("conv").alias("conv_"), F.col("slot").alias("slot_"), before(Window.partitionBy("conv").orderBy("slot"), "size").alias("base"))
    own = rows.withColumn("own", before(Window.partitionBy("conv", "slot").orderBy("at"), "size"))
    placed = own.join(slots, own["conv"].eqNullSafe(F.col("conv_")) & (own["slot"] == F.col("slot_")), "inner").withColumn("part", F.floor((F.col("base") + F.col("own")) / row_chars))
    parts = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "said"))).alias("turns")).withColumn("salt", F.pmod("part", F.lit(SPREAD)))
    speakers = rows.filter(F.col("who") != SYSTEM).select("conv", "who").distinct()
    many = speakers.groupBy("conv").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("n")).select(F.col("conv").alias("conv_"), "n")
    told = speakers.join(many, speakers["conv"].eqNullSafe(F.col("conv_")), "inner").groupBy("conv", F.expr("pmod(xxhash64(who), n)").alias("list")).agg(F.sort_array(F.collect_list("who")).alias("people"))
    dealt = told.select(F.col("conv").alias("conv_"), "people", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt_"))
    return parts.join(dealt, parts["conv"].eqNullSafe(F.col("conv_")) & (parts["salt"] == F.col("salt_")), "left").select("conv", "part", "turns", "people")
