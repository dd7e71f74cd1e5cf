"""Best-fit packing of token pieces into sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timberline.llm.common import cut, forget, map_rows, spread
from timberline.llm.tokens import encoder

#: pieces that are packed together by one task
GROUP = 20_000


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Encoded documents cut into pieces of ``capacity`` ids: one row per piece.

    A document is its ids and then ``end_id``. Only longer ones are cut; the last piece may be
    shorter. Returns doc_id, piece, start, length and the crc32 of the ids as little-endian
    unsigned 32-bit integers. A null text is empty and gives one piece of the end id alone. Rows
    with a null or repeated doc_id are documents of their own. Other columns are not looked at.
    """
    def encode(batches: Iterator[list[list]]) -> Iterator[dict]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for ids, texts in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(ids, texts):
                data = enc.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
            yield out

    return map_rows(docs, ["doc_id", "text"], encode,
                    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that still takes it.

    Bins wait in one stack per free room; a bit mask of the rooms in use finds the best.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            stacks[room].append(b)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, tries: int = 4000) -> list[list[int]]:
    """Move documents between underfull bins until none of the moves fills them better.

    The emptiest bin gives: it moves a document away, exchanges one for one, or two for one, with
    any other underfull bin, always the exchange after which the sum of squared fills is
    largest. Each such step raises that sum, so the steps end; emptied bins go. Bins that can give
    nothing are set aside. It also ends when the number of bins meets the lower bound, or
    after ``tries`` steps, which bounds the time of a group and leaves a complete packing.
    """
    need = -(-int(lengths.sum()) // capacity)
    fill = [int(lengths[b].sum()) for b in bins]
    stuck: set[int] = set()
    alive = len(bins)
    for _ in range(tries):
        if alive <= need:
            break
        under = [k for k in range(len(bins)) if bins[k] and fill[k] < capacity]
        givers = [k for k in under if k not in stuck]
        if len(under) < 2 or not givers:
            break
        a = min(givers, key=lambda k: (fill[k], k))
        others = [k for k in under if k != a]
        theirs = np.array([-1] * len(others) + [i for k in others for i in bins[k]])  # -1: nothing comes back
        home = np.array(others + [k for k in others for _ in bins[k]])
        back = np.where(theirs < 0, 0, lengths[theirs])
        taker = np.array([fill[k] for k in home])
        mine = [(i,) for i in bins[a]]
        if len(bins[a]) <= 64:
            mine += [(i, j) for n, i in enumerate(bins[a]) for j in bins[a][n + 1:]]
        best, pick = 0, None
        for give in mine:
            net = int(lengths[list(give)].sum()) - back
            after = taker + net
            # the gain in squared fill is 2 * net * (taker + net - giver); it must be positive
            gain = np.where((net > 0) & (after <= capacity), net * (after - fill[a]), 0)
            if len(give) == 2:
                gain[theirs < 0] = 0  # two for one; moving two is two moves
            k = int(gain.argmax())
            if gain[k] > best:
                best, pick = int(gain[k]), (give, int(theirs[k]), int(home[k]), int(net[k]))
        if pick is None:
            stuck.add(a)
            continue
        give, back_piece, b, net = pick
        for i in give:
            bins[a].remove(i)
        bins[b].extend(give)
        if back_piece >= 0:
            bins[b].remove(back_piece)
            bins[a].append(back_piece)
        fill[a] -= net
        fill[b] += net
        stuck.discard(b)
        alive -= not bins[a]
    return [b for b in bins if b]


def pack(table: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Rows are dealt to groups of about ``group`` by a hash of all their columns, so a hot key is
    spread, and each group is packed by one task: best fit first, then the local search. A
    group leaves at most a few underfull sequences, a share of 1/``group`` of the rows.
    Repeated rows may share a hash; they are packed as rows of their own. Sequence ids are
    group * 2^32 + number. An empty table gives an empty one.
    """
    groups = spread(table.count(), group)
    keyed = table.withColumn("_group", F.pmod(F.xxhash64(*table.columns), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        lengths = pdf["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        sizes = np.array([len(b) for b in bins])
        cum = np.cumsum(lengths[order]) - lengths[order]
        first = np.cumsum(sizes) - sizes
        out = pdf.iloc[order].copy()
        out["sequence_id"] = (int(pdf["_group"].iloc[0]) << 32) + np.repeat(np.arange(len(bins)), sizes)
        out["offset"] = cum - np.repeat(cum[first], sizes)
        return out.drop(columns="_group")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return keyed.groupBy("_group").applyInPandas(one, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None,
                   group: int = GROUP) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` ids as the search finds.

    The pieces, six numbers each, are written once to the shared checkpoint folder, so that texts are
    encoded once. Returns one row per piece; see ``pieces`` for nulls and repeated ids.
    """
    return pack(cut(pieces(docs, capacity, end_id, tokenizer)), capacity, group)
