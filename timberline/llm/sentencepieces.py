"""SentencePiece encoding as a max-plus scan over chunks, and decoding.

A segmentation is a path through (end of token, token); its value adds up over tokens, so the best paths of
neighbouring pieces of text combine as max-plus matrices. For unigram models a token's weight is its score.
For BPE models it is 0, or minus infinity after a token it would have merged with: a sequence is the result of
merging exactly if every two neighbours are, so one path remains and it is the library's.

A giant document is cut into chunks anywhere. The state at a cut is the token that ends there or reaches over it.
Each chunk yields its transfer matrix (value of the best path from each entry to each exit state). Products of
``FAN`` neighbouring matrices make the next level of a tree; from its top the states at the borders are handed
down, level by level; then every chunk is traced back alone. No task sees more than ``FAN`` matrices of a document.
Where no token reaches over a border of words, the paths of a chunk meet there, so most matrices are cheap.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from timberline.llm.common import cut, map_rows, worker_state

CHUNK = 1 << 16
FAN = 16
State = tuple[int, str]  # how far the token reaches over the cut, and the token ("" at the start)
Matrix = dict[State, dict[State, float]]


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: best value over the states in between. It is associative."""
    out: Matrix = {}
    for entry, row in a.items():
        best: dict[State, float] = {}
        for state, value in row.items():
            for leave, more in b.get(state, {}).items():
                if value + more > best.get(leave, -math.inf):
                    best[leave] = value + more
        out[entry] = best
    return out


class Model:
    """Pieces and scores of a model file; ``unigram`` adds scores, else neighbours must not merge."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unigram = unigram
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = sp.is_byte(self.bytes[0])
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # below every piece, as the library has it
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.splits = not any(re.search("[^▁]▁", p) for p in self.ids)
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        self.whole: dict[str, bool] = {}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.starts: dict[str, tuple[list[str], bool]] = {}
        self.words: dict[str, bytes] = {}
        # signs that no piece has right after a letter: merging never crosses from a letter to one of them
        follow = {(p[k - 1], p[k]) for p in self.ids for k in range(1, len(p))}
        letters, after = {a for a, _ in follow if a.isalpha()}, {b for a, b in follow if a.isalpha()}
        self.letters, self.signs = frozenset(letters), "".join(c for c in ",.;:!?&()\"'*#|/-" if c not in after)

    def derivation(self, token: str) -> list[tuple[float, str, str]]:
        """Merging a string alone: before each merge its score and the outer symbols; last, no merge."""
        known = self.steps.get(token)
        if known is None:
            parts, known = list(token), []
            while True:
                best, at = -math.inf, -1
                for i in range(len(parts) - 1):
                    score = self.scores.get(parts[i] + parts[i + 1])
                    if score is not None and score > best:
                        best, at = score, i
                known.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.steps[token] = known
            self.whole[token] = len(parts) == 1
        return known

    def stays(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves the tokens a and b apart."""
        known = self.fits.get(a, {}).get(b)
        if known is None:
            left, right, i, j = self.derivation(a), self.derivation(b), 0, 0
            while True:
                mine, theirs = left[i][0], right[j][0]
                across = self.scores.get(left[i][2] + right[j][1], -math.inf)
                if across > mine and across >= theirs and across > -math.inf:  # equal scores: leftmost first
                    known = False
                    break
                if mine == theirs == -math.inf:
                    known = True
                    break
                if mine >= theirs:
                    i += 1
                else:
                    j += 1
            if self.n_fits > 1_500_000:
                self.fits.clear()
                self.n_fits = 0
            self.n_fits += 1
            self.fits.setdefault(a, {})[b] = known
        return known

    def value(self, before: str, token: str) -> float:
        """Weight of a token after another; minus infinity if it can't follow."""
        if self.unigram:
            return self.scores.get(token, self.unknown_score)
        return 0.0 if not before or self.stays(before, token) else -math.inf

    def tokens_at(self, text: str, at: int) -> list[str]:
        """Tokens that may start at a place: pieces, and the single character. Those of up to 4 characters are
        looked up by the next 4 characters, with a note whether a longer piece begins so."""
        near = text[at:at + 4]
        got = self.starts.get(near)
        if got is None:
            if len(self.starts) > 300_000:
                self.starts.clear()
            got = self.starts[near] = ([near[0]] + [near[:n] for n in range(2, len(near) + 1) if self._piece(near[:n])],
                                       len(near) == 4 and near in self.prefixes)
        if not got[1]:
            return got[0]
        out = got[0].copy()
        for n in range(5, min(self.longest, len(text) - at) + 1):
            piece = text[at:at + n]
            if piece not in self.prefixes:
                break
            if self._piece(piece):
                out.append(piece)
        return out

    def _piece(self, piece: str) -> bool:
        """Whether a string is a piece that segmentations may use: for BPE, one that merging it alone leaves whole."""
        if piece not in self.ids:
            return False
        if self.unigram:
            return True
        if piece not in self.whole:
            self.derivation(piece)
        return self.whole[piece]

    def lattice(self, text: str, entry: State, end: int) -> tuple[list[dict[str, tuple[float, str]]], dict[State, float]]:
        """All best paths from an entry state until they reach ``end``: per place the tokens that end there with value and
        the token before, and the values of the exit states. Unigram states forget their token."""
        ends: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(text) + 1)]
        over, token = entry
        ends[over][token] = (0.0, "")
        for at in range(over, end):
            here = ends[at]
            if not here:
                continue
            if self.unigram:  # only the best way to a place matters
                top = max(here, key=lambda t: here[t][0])
                here = {top: here[top]}
            starts = self.tokens_at(text, at)
            for before, (value, _) in here.items():
                for t in starts:
                    total = value + self.value(before, t)
                    if total > -math.inf and total > ends[at + len(t)].get(t, (-math.inf,))[0]:
                        ends[at + len(t)][t] = (total, before)
        leave: dict[State, float] = {}
        for at in range(end, len(text) + 1):
            for t, (value, _) in ends[at].items():
                state = (at - end, "" if self.unigram else t)
                if value > leave.get(state, -math.inf):
                    leave[state] = value
        return ends, leave

    def path(self, text: str, entry: State, end: int, leave: State | None = None) -> list[str]:
        """Tokens of the best path from an entry to an exit state (default: any that ends at ``end``)."""
        ends, _ = self.lattice(text, entry, end)
        at = end + (leave[0] if leave else 0)
        here = ends[at]
        token = leave[1] if leave and leave[1] else max(here, key=lambda t: here[t][0], default="")
        out = []
        while at > entry[0]:
            out.append(token)
            before = ends[at][token][1]
            at -= len(token)
            if self.unigram and at > entry[0]:
                before = max(ends[at], key=lambda t: ends[at][t][0])
            token = before
        return out[::-1]

    def to_ids(self, tokens: list[str]) -> bytes:
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.has_bytes:
                out += [self.bytes[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def merged(self, text: str) -> list[str]:
        """``path`` of a whole BPE text: there, one token at most can end at a place."""
        last: list[str | None] = [None] * (len(text) + 1)
        last[0] = ""
        starts, every = self.starts, self.fits
        for at, before in enumerate(last):  # filled ahead of the loop
            if before is None or at == len(text):
                continue
            got = starts.get(text[at:at + 4])
            tokens = self.tokens_at(text, at) if got is None or got[1] else got[0]
            if not before:
                for t in tokens:
                    last[at + len(t)] = t
                continue
            fits = every.get(before, {})
            for t in tokens:
                fit = fits.get(t)
                if fit or fit is None and self.stays(before, t):
                    last[at + len(t)] = t
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(out[-1])
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids of a stretch of text between borders that no token reaches over. Signs at the end of a word that never
        merge with a letter are looked up on their own."""
        got = self.words.get(word)
        if got is None:
            stem = word.rstrip(self.signs)
            if stem and len(stem) < len(word) and stem[-1] in self.letters:
                return self.word(stem) + self.word(word[len(stem):])
            got = self.to_ids(self.path(word, (0, ""), len(word)) if self.unigram else self.merged(word))
            if len(word) <= 64:
                if len(self.words) > 600_000:
                    self.words.clear()
                self.words[word] = got
        return got

    _WORD = re.compile("▁*[^▁]+|▁+")

    def encode(self, text: str) -> bytes:
        """Ids of a normalised text in one piece, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.word, self._WORD.findall(text))) if self.splits else self.word(text)

    def borders(self, text: str, end: int) -> tuple[int, int] | None:
        """The first and last border of words inside a chunk that lie beyond the reach of its entry states."""
        if not self.splits:
            return None
        first = re.compile("(?<=[^▁])▁").search(text, self.longest, end)
        if not first:
            return None
        last = max(first.start(), max((text.rfind(c + "▁", 0, end) + 1 for c in set(text[max(0, end - 4096):end]) - {"▁"}),
                                      default=0))
        return first.start(), last

    def entries(self, before: str, text: str) -> list[State]:
        """States a chunk may be entered in: tokens that end at its start or reach over it."""
        both, start = before + text[:self.longest], len(before)
        if not before:
            return [(0, "")]
        out: list[State] = []
        for at in range(max(0, start - self.longest), start):
            out += [(at + len(t) - start, "" if self.unigram else t)
                    for t in self.tokens_at(both, at) if at + len(t) >= start]
        return sorted(set(out))

    def transfer(self, before: str, text: str, end: int) -> Matrix:
        """The matrix of a chunk: text[:end], with what comes before it and after it."""
        inner = self.borders(text, end)
        if inner is None:
            return {e: self.lattice(text, e, end)[1] for e in self.entries(before, text)}
        first, last = inner
        middle = 0.0
        if self.unigram:
            ends, leave = self.lattice(text[:last], (first, ""), last)
            middle = max(leave.values(), default=0.0)
        tail = self.lattice(text[last:], (0, ""), end - last)[1]
        out: Matrix = {}
        for e in self.entries(before, text):
            if e[0] <= first:
                reached = [v for (over, _), v in self.lattice(text[:first], e, first)[1].items() if over == 0]
                if reached:
                    out[e] = {x: max(reached) + middle + v for x, v in tail.items()}
        return out

    def trace(self, text: str, end: int, entry: State, leave: State) -> bytes:
        """Ids of a chunk between two states: the tokens that begin in it after the entry's token."""
        inner = self.borders(text, end)
        if inner is None:
            return self.to_ids(self.path(text, entry, end, leave))
        first, last = inner
        return (self.to_ids(self.path(text[:first], entry, first)) + self.encode(text[first:last])
                + self.to_ids(self.path(text[last:], (0, ""), end - last, leave)))


def model(path: str | None = None, unigram: bool = False) -> Model:
    """The worker's model of a file (default: the public BPE model)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return worker_state(("pieces", path, unigram), lambda: Model(path, unigram))


def best_exit(whole: Matrix) -> State:
    """The state in which the best path of a whole document ends."""
    ways = whole[0, ""]
    return max((s for s in ways if s[0] == 0), key=lambda s: ways[s])


def between(matrices: list[Matrix], entry: State, leave: State) -> list[tuple[State, State]]:
    """Entry and exit state of each of some neighbouring matrices on the best path from ``entry`` to ``leave``."""
    value: dict[State, float] = {entry: 0.0}
    back: list[dict[State, State]] = []
    for m in matrices:
        best: dict[State, float] = {}
        came: dict[State, State] = {}
        for state, v in value.items():
            for after, more in m.get(state, {}).items():
                if v + more > best.get(after, -math.inf):
                    best[after], came[after] = v + more, state
        value = best
        back.append(came)
    state = leave
    out: list[tuple[State, State]] = []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def cut_states(chunks: DataFrame, n: int) -> DataFrame:
    """Entry and exit state (entry_over, entry, exit_over, leave) of every chunk of every document.

    ``chunks`` has row, chunk and matrix, ``n`` is the largest number of chunks of a document. Upwards, up to
    ``FAN`` neighbours of a level are composed into one node; downwards, a node's states give those of its children.
    """
    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        product = reduce(compose, [_unpacked(x) for x in pdf["matrix"]])
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "node": pdf["node"].iloc[:1] // FAN, "matrix": [_packed(product)]})

    def top(batches: Iterator[list[list]]) -> Iterator[dict]:
        for rows, data in batches:
            leave = [best_exit(_unpacked(x)) for x in data]
            yield {"row": rows, "node": [0] * len(rows), "entry_over": [0] * len(rows), "entry": [""] * len(rows),
                   "exit_over": [x[0] for x in leave], "leave": [x[1] for x in leave]}

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        one = pdf.iloc[0]
        found = between([_unpacked(x) for x in pdf["matrix"]], (int(one["entry_over"]), one["entry"]),
                        (int(one["exit_over"]), one["leave"]))
        return pd.DataFrame({"row": pdf["row"], "node": pdf["node"], "entry_over": [e[0] for e, _ in found],
                             "entry": [e[1] for e, _ in found], "exit_over": [x[0] for _, x in found],
                             "leave": [x[1] for _, x in found]})

    states = "row bigint, node int, entry_over int, entry string, exit_over int, leave string"
    family = (F.col("node") / FAN).cast("int").alias("family")
    levels = [cut(chunks.select("row", F.col("chunk").alias("node"), "matrix"))]
    while n > 1:
        levels.append(cut(levels[-1].groupBy("row", family).applyInPandas(up, "row bigint, node int, matrix string")))
        n = -(-n // FAN)
    at = map_rows(levels.pop(), ["row", "matrix"], top, states)
    while levels:
        children = levels.pop().withColumn("family", family)
        at = (children.join(at.withColumnRenamed("node", "family"), ["row", "family"])
              .groupBy("row", "family").applyInPandas(down, states))
    return at.withColumnRenamed("node", "chunk")


def _packed(m: Matrix) -> str:
    return json.dumps([[e, [[x, v] for x, v in row.items()]] for e, row in m.items()])


def _unpacked(data: str) -> Matrix:
    return {tuple(e): {tuple(x): v for x, v in row} for e, row in json.loads(data)}


def encode(docs: DataFrame, path: str | None = None, unigram: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Encode every whole text: doc_id and, as little-endian unsigned 32-bit integers, ``ids``.

    Texts are normalised by the model's own rules. Those of up to ``chunk`` characters are encoded where they are
    read; longer ones take the scan. A null text gives null ids, an empty one no ids. Rows with null or repeated
    ids are documents of their own. Other columns are not looked at.
    """
    def alone(batches: Iterator[list[list]]) -> Iterator[dict]:
        m = model(path, unigram)
        for doc_ids, texts in batches:
            yield {"doc_id": doc_ids, "ids": [None if x is None else m.encode(m.sp.normalize(x)) for x in texts]}

    def split(batches: Iterator[list[list]]) -> Iterator[dict]:
        m = model(path, unigram)
        for doc_ids, rows, texts in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "chunk", "before", "text", "size")}
            for doc_id, row, text in zip(doc_ids, rows, texts):
                plain = m.sp.normalize(text)
                for k, a in enumerate(range(0, max(1, len(plain)), chunk)):
                    part = (doc_id, row, k, plain[max(0, a - m.longest):a], plain[a:a + chunk + m.longest],
                            min(chunk, len(plain) - a))
                    for name, v in zip(out, part):
                        out[name].append(v)
            yield out

    def matrices(batches: Iterator[list[list]]) -> Iterator[dict]:
        m = model(path, unigram)
        for rows, chunks, before, texts, sizes in batches:
            yield {"row": rows, "chunk": chunks,
                   "matrix": [_packed(m.transfer(b, t, n)) for b, t, n in zip(before, texts, sizes)]}

    def traced(batches: Iterator[list[list]]) -> Iterator[dict]:
        m = model(path, unigram)
        for doc_ids, rows, chunks, texts, sizes, eo, e, xo, x in batches:
            yield {"doc_id": doc_ids, "row": rows, "chunk": chunks,
                   "ids": [m.trace(t, n, (a, b), (c, d)) for t, n, a, b, c, d in zip(texts, sizes, eo, e, xo, x)]}

    size = F.coalesce(F.length("text"), F.lit(0))
    short = map_rows(docs.select("doc_id", "text").filter(size <= chunk), ["doc_id", "text"], alone,
                     "doc_id bigint, ids binary")
    long = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").filter(size > chunk)
    chunks = cut(map_rows(long, ["doc_id", "row", "text"], split,
                          "doc_id bigint, row bigint, chunk int, before string, text string, size int", at_once=10))
    most = chunks.agg(F.max("chunk")).first()[0]
    if most is None:
        return short
    at = cut_states(map_rows(chunks, ["row", "chunk", "before", "text", "size"], matrices,
                             "row bigint, chunk int, matrix string"), most + 1)
    placed = chunks.join(at, ["row", "chunk"])
    pieces = map_rows(placed, ["doc_id", "row", "chunk", "text", "size", "entry_over", "entry", "exit_over", "leave"], traced,
                      "doc_id bigint, row bigint, chunk int, ids binary")
    # as many chunks as the document has, which is one row before and after
    joined = (pieces.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
              .select("doc_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids")))
    return short.union(joined)


def decode(encoded: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """The texts of ``ids`` (null stays null), with doc_id and the columns ``keep``."""
    fields = [f for f in encoded.schema.fields if f.name in ("doc_id", *keep)]

    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        sp = model(path).sp
        for *kept, data in batches:
            yield {**{f.name: c for f, c in zip(fields, kept)},
                   "text": [None if d is None else sp.decode(np.frombuffer(d, "<u4").tolist()) for d in data]}

    return map_rows(encoded, [*(f.name for f in fields), "ids"], run,
                    ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string")


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, crc32 of the ids, and the hash and number of characters of the decoded text."""
    def run(batches: Iterator[list[list]]) -> Iterator[dict]:
        sp = model(path).sp
        for doc_ids, data in batches:
            texts = [sp.decode(np.frombuffer(d or b"", "<u4").tolist()) for d in data]
            yield {"doc_id": doc_ids, "n_tokens": [len(d or b"") // 4 for d in data],
                   "ids_crc32": [zlib.crc32(d or b"") for d in data], "decoded_chars": [len(t) for t in texts],
                   "decoded_crc32": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]}

    return map_rows(encoded, ["doc_id", "ids"], run,
                    "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_chars bigint, decoded_crc32 bigint")
