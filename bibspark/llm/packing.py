"""Operator 3: best-fit packing by hierarchical residual packing.

Items (pieces of documents) are dealt out evenly to nodes of bounded size and best-fit there in decreasing
order.  A node emits the bins that no later round could fill up and hands on the rest as items: its bins with
the most room, at most one for each child that the next node merges, as more could not gain anything there.
(Two bins of at most half a sequence never both remain, as best fit would have put them together, so a node
hands on at most one that could go into another's bin.)  The nodes merge as a tree, sixteen to one, and each
round best-fits the handed-on bins, until one node is left.  So no task's input grows with the table.
"""

from __future__ import annotations

import array
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import checkpointed, text_batches, text_or_empty

NODE_ITEMS = 16_384
FAN_IN = 16


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """(encode to ids, special strings, the tokenizers library's encode for texts that hold one of these).

    The vocabulary of a byte-level BPE file whose merges stand in the order of their results' ids is the same
    as a rank table, and the rank encoder gives the same ids several times faster.  Where a file is of another
    kind, all texts go to the tokenizers library.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    whole = lambda text: exact.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = _as_ranks(spec)
    if ranks is None:
        return whole, special, whole
    import tiktoken
    from public_tokenizers import PATTERN

    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, special, whole


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such files show as themselves
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if None in ids or ids != sorted(ids) or any(model["vocab"][c] >= ids[0] for c in shown):
        return None
    keep = {*shown, *(a + b for a, b in merges)}
    return {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t in keep}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit).

    A null text counts as empty (its only token is end_id).  A document of more than `capacity` tokens is cut
    into pieces of `capacity`; its first piece is what remains and may be shorter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches):
        fast, special, whole = _tokenizer(tokenizer_path)
        for batch, texts in text_batches(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(texts):
                got = whole(text) if any(s in text for s in special) else fast(text)
                data = memoryview(array.array("I", [*got, end_id]).tobytes())
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(bytes(data[4 * a : 4 * b]))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item by best fit in decreasing order, and the bins' fills.  Equal sizes keep their order."""
    bin_of, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their room; open_rooms has a bit for each room that some bin has
    open_rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        rooms[room - size].append(b)
        open_rooms |= 1 << (room - size)
    return bin_of, offset, fill


def _pack_node(table: pa.Table, capacity: int, hand_on: int) -> pa.Table:
    """Best-fit what is handed to a node: rows with one sequence_id are an item as they stand."""
    ids, first, inverse = np.unique(table["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
    offset, length = table["offset"].to_numpy(), table["length"].to_numpy()
    sizes = np.zeros(len(ids), np.int64)
    np.maximum.at(sizes, inverse, offset + length)
    bin_of, shift, fill = best_fit(sizes, capacity)
    fill = np.array(fill, np.int64)
    name = np.full(len(fill), np.iinfo(np.int64).max)
    np.minimum.at(name, bin_of, ids)
    carried = np.zeros(len(fill), bool)
    if hand_on:
        roomiest = np.argsort(fill, kind="stable")[:hand_on]
        carried[roomiest[fill[roomiest] < capacity]] = True
        carried |= 2 * fill <= capacity
    row_bin = bin_of[inverse]
    for column, values in (("sequence_id", name[row_bin]), ("offset", offset + shift[inverse]), ("carried", carried[row_bin])):
        table = table.set_column(table.column_names.index(column), column, pa.array(values))
    return table


def _node_packer(capacity: int, hand_on: int):
    return lambda table: _pack_node(table, capacity, hand_on)


def pack(items: DataFrame, *, capacity: int = 1024, length: str = "length", node_items: int = NODE_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Pack items of 1 to `capacity` tokens; adds sequence_id and offset to their columns.

    Every row is an item of its own, repeated rows included.  Items of full size are sequences at once.  A null
    or non-positive length takes no room and gives a null sequence_id and offset; a length over `capacity` is
    an error.  No items give no rows.  Columns named sequence_id, offset, node or carried are replaced.
    """
    items = items.drop("sequence_id", "offset", "node", "carried")
    payload = items.columns
    size = F.col(length).cast("long")
    rows = items.select(F.struct(*[F.col(c) for c in payload]).alias("row"), F.when(size > capacity, F.raise_error(F.lit("an item is longer than a sequence"))).otherwise(size).cast("long").alias("length"), F.monotonically_increasing_id().alias("sequence_id"))
    rows = checkpointed(rows)  # the numbers must not change when a task runs again
    packable = (F.col("length") > 0) & (F.col("length") < capacity)
    count = rows.filter(packable).count()
    nodes = max(1, -(-count // node_items))
    done = [rows.filter(~packable | F.col("length").isNull()).select("row", F.when(F.col("length") == capacity, F.col("sequence_id")).alias("sequence_id"), F.when(F.col("length") == capacity, F.lit(0)).cast("long").alias("offset"))]
    level = rows.filter(packable).select("row", "length", "sequence_id", F.lit(0).cast("long").alias("offset"), F.lit(False).alias("carried"), F.pmod(F.xxhash64("sequence_id"), F.lit(nodes)).alias("node"))
    while count:
        last = nodes == 1
        hand_on = 0 if last else fan_in
        schema = level.schema
        level = checkpointed(level.groupBy("node").applyInArrow(_node_packer(capacity, hand_on), schema))
        done.append(level.filter(~F.col("carried")).select("row", "sequence_id", "offset"))
        if last:
            break
        nodes = -(-nodes // fan_in)
        level = level.filter("carried").withColumn("carried", F.lit(False)).withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).select(*schema.names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(tokenized_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), capacity=capacity)
