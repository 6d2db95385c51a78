"""Packing by the dot-product heuristic for vector bins, under three limits at once.

Documents are tokenized whole and cut where a sequence would be full. Full pieces are sequences of their
own; the others are placed into bins with limits on tokens, segments and loss-bearing tokens. An open bin
takes, of the pieces that fit, the one whose demand has the largest dot product with what is left in the
bin, each dimension weighted by the mean demand; when none fits, the next bin opens.

A task packs what it reads, in pools of a few thousand rests, so there is no shuffle, no task grows with
the input, and a repeated task gives the same sequences.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Ids of the first of the sequences that a task may make.
TASK_STRIDE = 1 << 36
#: Rows and bytes of a batch of results.
OUT_BYTES = 8 << 20


def dot_product_bins(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins as lists of rows of ``demands``; every row must fit an empty bin.

    Rows of equal demand are interchangeable, so the search runs over kinds of demand, of which there are
    at most as many as different lengths.
    """
    if not len(demands):
        return []
    kinds, which = np.unique(demands, axis=0, return_inverse=True)
    members: list[list[int]] = [[] for _ in kinds]
    for row in range(len(demands) - 1, -1, -1):
        members[which.reshape(-1)[row]].append(row)
    left = np.array([len(x) for x in members])
    scaled = kinds / limits
    weighted = scaled * (demands / limits).mean(axis=0)
    bins = []
    while left.any():
        room, chosen = limits.astype(np.int64).copy(), []
        while True:
            fits = (left > 0) & (kinds <= room).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, weighted @ (room / limits), -1.0)
            kind = int(score.argmax())
            chosen.append(members[kind].pop())
            left[kind] -= 1
            room -= kinds[kind]
        bins.append(chosen)
    return bins


#: Code points of white space in a row that the fast coder cannot take; texts that have them take the other.
SPACES = 1 << 16


class Coder:
    """Ids of texts under a byte-level vocabulary, the same as those of the ``tokenizers`` file itself.

    The ranks file holds the same vocabulary for a coder that is several times as fast. Where
    ``special`` is set, the file's special strings inside a text become their ids, as that library has it
    unless told otherwise; else they are ordinary text.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, special: bool):
        import base64
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.encode_special_tokens = not special
        with open(vocabulary, encoding="utf8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"] if x["special"]}
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.allowed = set(added) if special else set()
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=known, special_tokens=added)
        self.spaces = re.compile(rf"\s{{{SPACES}}}")
        self.widths = np.zeros(max(*known.values(), *added.values(), 0) + 1, np.int64)
        for token, number in [*known.items(), *((x.encode(), n) for x, n in added.items())]:
            self.widths[number] = len(token)

    def ids(self, text: str) -> list[int]:
        if len(text) >= SPACES and self.spaces.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.allowed, disallowed_special=())

    def bearing(self, text: str, ids: np.ndarray, start: int, chars: int) -> np.ndarray:
        """Which ids end within the ``chars`` code points of a text from ``start`` (from 0)."""
        first = len(text[: max(0, start)].encode("utf-8", "surrogatepass"))
        last = first + len(text[max(0, start) : max(0, start) + max(0, chars)].encode("utf-8", "surrogatepass"))
        ends = np.cumsum(self.widths[ids])
        return (ends > first) & (ends <= last)


def cuts(bears: np.ndarray, capacity: int, max_loss: int) -> Iterator[tuple[int, int]]:
    """Pieces (start, end) of a document, as long as may be, of at most ``capacity`` ids and ``max_loss`` that bear loss.

    The first id of a piece bears none, as nothing precedes it.
    """
    borne = np.concatenate(([0], np.cumsum(bears)))
    start = 0
    while start < len(bears):
        end = int(np.searchsorted(borne, borne[start + 1] + max_loss, "right")) - 1
        end = min(len(bears), start + capacity, max(end, start + 1))
        yield start, end
        start = end


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    capacity: int = 1024,
    max_segments: int = 64,
    max_loss: int | None = None,
    loss: tuple[str, str] | None = None,
    end_id: int = 0,
    pool: int = 8192,
    special: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, loss_tokens, doc_tokens, sequence_id, offset, ids.

    A document's ids are those of its whole text under the byte-level ``vocabulary`` (a file of the
    ``tokenizers`` library, ``ranks`` and ``pattern`` being the same one for a faster coder, see ``Coder``
    for ``special``), and then ``end_id``. ``start`` counts the ids before the piece in its document,
    ``offset`` those before it in its sequence; ``ids`` holds the piece's ids as little-endian unsigned
    32-bit integers.

    A sequence has at most ``capacity`` ids, ``max_segments`` pieces and ``max_loss`` loss-bearing ids (any
    number, if None). ``loss`` names the columns with the first code point of a text that bears loss (from
    0) and the number of them, such as those of formatted chats; the end id bears loss if the text's last
    code point does. Without ``loss`` all ids bear it. A piece's first id bears none. Where a document has
    more loss-bearing ids than a sequence may hold, it is cut there.

    Null texts count as empty and have ``end_id`` alone; a null start or number counts as 0; null ids pass
    through; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    Pieces never mix between tasks, so which pieces share a sequence depends on how the input is split;
    only each task's last bins are left partly filled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    limits = np.array([capacity, max_segments, capacity if max_loss is None else max_loss])
    if min(limits) < 1:
        raise ValueError("a sequence must hold an id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, ranks, pattern, special)
        sequence = TaskContext.get().partitionId() * TASK_STRIDE
        out: dict[str, list] = defaultdict(list)
        names = ["doc_id", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "ids"]
        rests: list[tuple] = []
        id_type = None
        waiting = 0

        def emit(doc, start, ids, borne, total, number, offset):
            for name, value in zip(names, (doc, start, len(ids), borne, total, number, offset, ids.tobytes())):
                out[name].append(value)

        def flush():
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names)
            out.clear()
            return batch

        def place(last):
            """Packs the pool; poorly filled bins wait for the next one, except at the end."""
            nonlocal sequence, rests
            demands = np.array([(len(x[2]), 1, x[3]) for x in rests])
            again: list[int] = []
            bins = dot_product_bins(demands, limits)
            for chosen in sorted(bins, key=lambda x: demands[x, 0].sum()):
                poor = (demands[chosen].sum(axis=0) < limits * 0.97).all()
                if poor and not last and len(again) + len(chosen) <= pool // 4:
                    again += chosen
                    continue
                offset = 0
                for row in chosen:
                    emit(*rests[row], sequence, offset)
                    offset += len(rests[row][2])
                sequence += 1
            rests = [rests[row] for row in sorted(again)]

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            spans = zip(*(batch.column(c).to_pylist() for c in ("loss_start", "loss_chars"))) if loss else itertools.repeat(None)
            for doc, x, span in zip(batch.column("doc_id"), batch.column("text"), spans):
                text = x.as_py() or ""
                ids = np.array([*coder.ids(text), end_id], "<u4")
                bears = np.ones(len(ids), bool)
                if span:
                    begin, many = span[0] or 0, span[1] or 0
                    bears = np.append(coder.bearing(text, ids[:-1], begin, many), many > 0 and begin + many >= len(text))
                total, doc = len(ids), doc.as_py()
                for start, end in cuts(bears, capacity, int(limits[2])):
                    borne = int(bears[start + 1 : end].sum())
                    if end - start == capacity:
                        emit(doc, start, ids[start:end], borne, total, sequence, 0)
                        sequence += 1
                    else:
                        rests.append((doc, start, ids[start:end].copy(), borne, total))
                waiting += 4 * total
                if len(rests) >= pool:
                    place(last=False)
                if waiting >= OUT_BYTES and out:
                    yield flush()
                    waiting = 0
        if rests:
            place(last=True)
        if out:
            yield flush()

    spans = [docs[c].cast("bigint").alias(n) for c, n in zip(loss, ("loss_start", "loss_chars"))] if loss else []
    return docs.select("doc_id", "text", *spans).mapInArrow(
        each,
        f"doc_id {kind}, start bigint, length bigint, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary",
    )
