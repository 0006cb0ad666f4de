"""SentencePiece encoding with a merge-type vocabulary, and decoding.

A text becomes ``▁`` plus itself with spaces as ``▁``, cut before each run of ``▁`` and where two characters
meet that stand side by side in no piece. No piece goes on over such a cut (for ``▁`` this is verified when
the model is loaded), so each chunk is encoded once and remembered. An agenda of adjacent symbol pairs gives the pairs with the
highest score first, of equal ones in a chunk the leftmost; merging them puts their new neighbours on the agenda.
One agenda holds the pairs of many new chunks, side by side and never joined, so that a score taken from it is
merged in all of them. Symbols that are no piece become byte pieces. In each Arrow batch the chunks not met before are encoded by the sentencepiece library
too, and a difference ends the job.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

SPACE = "▁"
#: Chunks remembered by a Python worker at most (the memory is emptied when full), and the longest one remembered.
REMEMBERED, LONG = 250_000, 60
#: Texts of a batch that are worked on at once, and characters of an agenda (a longer chunk has one of its own).
STEP, TOGETHER = 1024, 1 << 22
#: No rank, and the bits of a place in an agenda's entry.
NOTHING, PLACE = 1 << 22, 40
MODEL = "piece_bpe_32k.model"


class Agenda:
    """A priority queue of entries ``rank << PLACE | place``, held by bands of 64 ranks; an entry that is there twice counts once."""

    def __init__(self):
        self.bands: dict[int, list[np.ndarray]] = {}
        self.order: list[int] = []

    def push(self, entries: np.ndarray, which: np.ndarray | slice = slice(None)) -> None:
        entries = np.sort(entries[which])
        starts = np.nonzero(np.append(True, np.diff(entries >> PLACE + 6)))[0] if len(entries) else []
        for part in np.split(entries, starts[1:]) if len(entries) else []:
            band = int(part[0] >> PLACE + 6)
            if band not in self.bands:
                self.bands[band] = []
                heapq.heappush(self.order, band)
            self.bands[band].append(part)

    def pop(self, width: int) -> np.ndarray:
        """The entries of the lowest rank and of those less than ``width`` above it, in order; none at the end."""
        if not self.order:
            return np.zeros(0, dtype=np.int64)
        parts, least = [], min(int(x[0]) for x in self.bands[self.order[0]]) >> PLACE
        while self.order and self.order[0] << 6 < least + width:
            parts += self.bands.pop(heapq.heappop(self.order))
        entries = np.sort(np.concatenate(parts))
        entries = entries[np.append(True, entries[1:] != entries[:-1])]
        cut = int(np.searchsorted(entries, least + width << PLACE))
        self.push(entries[cut:])
        return entries[:cut]


class MergeCodec:
    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("this vocabulary merges over spaces")
        # Symbols are numbers: a piece's id, or a number past the vocabulary for other characters in pieces.
        self.symbols = dict(self.pieces)
        for ch in sorted({ch for p in self.pieces for ch in p} - self.pieces.keys()):
            self.symbols[ch] = size + len(self.symbols) - len(self.pieces)
        self.stranger = size + len(self.symbols)
        merged = [i for p, i in self.pieces.items() if len(p) > 1]
        rank = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in merged}, reverse=True))}
        #: (left symbol, right symbol) to (rank of the merged piece's score, its symbol), both packed in one number.
        pairs: dict[int, int] = {}
        for p, i in self.pieces.items():
            for cut in range(1, len(p)):
                left, right = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank[sp.get_score(i)] << 20 | i
        self.line_feed = self.bytes[10]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        packed = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.pair_ranks, self.pair_symbols = packed >> 20, (packed & 0xFFFFF).astype(np.int32)
        self.by_code = np.full(0x110000, self.stranger, dtype=np.int32)
        for ch, symbol in self.symbols.items():
            if len(ch) == 1:
                self.by_code[ord(ch)] = symbol
        self.known: dict[str, bytes] = {}
        # Marks that follow a letter in no piece; the text is cut between the two.
        joined = {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        self.marks = "".join(m for m in ".,;:!?|%&$*<>()[]\"'-" if not any(b == m and a.isalpha() for a, b in joined))
        own = re.escape(self.marks)
        rest = f"(?:[^{SPACE}{own}]+|(?<![^\\W\\d_])[{own}])*" if own else f"[^{SPACE}]*"
        self.chunk = re.compile(f"{SPACE}+{rest}" + f"|[{own}]{rest}" * bool(own))

    def chunks(self, text: str) -> list[str]:
        """Nothing for an empty text; else chunks that give the text when joined."""
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merge(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as 32-bit integers, by one agenda over all of them."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = sizes.cumsum()
        start = self.by_code[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)]
        # The last place belongs to no chunk; it is the neighbour of a chunk's ends.
        n = len(start)
        symbols = np.append(start, np.int32(-1))
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        before[ends - sizes] = after[ends - 1] = before[n] = after[n] = n
        home = np.searchsorted(ends, np.arange(n), side="right")
        agenda, width = Agenda(), 64
        found, _ = self.proposals(symbols, symbols[after])
        agenda.push(found << PLACE | np.arange(n + 1), found < NOTHING)
        while len(entries := agenda.pop(width)):
            # Several scores are taken at once; of these each chunk merges its own best one only, the others go back.
            rank, left = entries >> PLACE, entries & ((1 << PLACE) - 1)
            right = after[left]
            found, merged = self.proposals(symbols[left], symbols[right])
            # Others are stale: one of their symbols has been merged since.
            fresh = np.nonzero(found == rank)[0]
            fresh = fresh[np.lexsort((left[fresh], rank[fresh], home[left[fresh]]))]
            left, right, merged, rank = (x[fresh] for x in (left, right, merged, rank))
            head = np.append(True, home[left[1:]] != home[left[:-1]])[: len(left)]
            best = rank[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))] == rank
            waiting = rank[~best] << PLACE | left[~best]
            width = max(1, width // 2) if 2 * len(waiting) > len(left) else min(1 << 20, width * 2)
            left, right, merged, rank, later = self.apart(*(x[best] for x in (left, right, merged, rank)), symbols, after, home)
            follower = after[right]
            symbols[left], symbols[right] = merged, -1
            after[left], before[follower] = follower, left
            pairs = np.concatenate([before[left], left])
            found, _ = self.proposals(symbols[pairs], symbols[after[pairs]])
            agenda.push(found << PLACE | pairs, found < NOTHING)
            agenda.push(np.concatenate([waiting, later]))
        done = symbols[:-1]
        kept = np.concatenate([[0], (done >= 0).cumsum()])
        ids = done[done >= 0].tobytes()
        out = [ids[4 * a : 4 * b] for a, b in zip(kept[ends - sizes].tolist(), kept[ends].tolist(), strict=True)]
        for i in np.unique(np.searchsorted(ends, np.nonzero(done >= self.size)[0], side="right")).tolist():
            out[i] = self._with_bytes(chunks[i], done[ends[i] - sizes[i] : ends[i]])
        return out

    def proposals(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merged piece (NOTHING if there is none), and its symbol."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NOTHING), self.pair_symbols[at]

    def apart(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray, symbols: np.ndarray, after: np.ndarray, home: np.ndarray) -> tuple:
        """Of pairs with one rank a chunk those that can be merged at once, and the entries of those that must wait.

        Of pairs that share a symbol the first, third and so on are merged. Where a merged pair makes a pair that
        comes before the next one, all that follow it in its chunk wait.
        """
        touching = np.append(False, right[:-1] == left[1:])[: len(left)]
        if touching.any():
            i = np.arange(len(left))
            first = np.maximum.accumulate(np.where(touching, 0, i))
            left, right, merged, rank = (x[(i - first) % 2 == 0] for x in (left, right, merged, rank))
        near = np.nonzero(after[right[:-1]] == left[1:])[0]
        if len(near):
            found, _ = self.proposals(merged[near], symbols[left[near + 1]])
            early = near[found <= rank[near]] + 1
            if len(early):
                wait = dict(zip(home[left[early]].tolist()[::-1], early.tolist()[::-1], strict=True))
                go = np.array([i < wait.get(c, len(left)) for i, c in enumerate(home[left].tolist())])
                return left[go], right[go], merged[go], rank[go], rank[~go] << PLACE | left[~go]
        return left, right, merged, rank, left[:0]

    def _with_bytes(self, chunk: str, symbols: np.ndarray) -> bytes:
        """Ids of a chunk where a symbol that is no piece (always one character) is written in byte pieces."""
        ids = array("i")
        for ch, s in zip(chunk, symbols.tolist(), strict=True):
            if s >= self.size:
                ids.extend(self.bytes.get(b, self.unknown) for b in ch.encode())
            elif s >= 0:
                ids.append(s)
        return ids.tobytes()


    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Encode chunks by the agenda and check them against the library, many in one call.

        The chunks are joined by line feeds, which no piece but a byte piece holds, so that the library's ids
        are those of the chunks with that byte piece between them.
        """
        found: dict[str, bytes] = {}
        group, size = [], 0
        for c in chunks:
            if group and size + len(c) > TOGETHER:
                found.update(zip(group, self.merge(group), strict=True))
                group, size = [], 0
            group.append(c)
            size += len(c)
        if group:
            found.update(zip(group, self.merge(group), strict=True))
        asked = [c for c in chunks if "\n" not in c]
        line_feed = np.array([self.line_feed], dtype=np.int32).tobytes()
        for group in [asked[i : i + 256] for i in range(0, len(asked), 256)] + [[c] for c in chunks if "\n" in c]:
            # The library itself puts one space before a text.
            theirs = self.library.encode("\n" + "\n".join(group).replace(SPACE, " "))
            if np.array(theirs[2:], dtype=np.int32).tobytes() != line_feed.join([found[c] for c in group]):
                raise ValueError(f"the agenda and the library differ within {group[:2]!r}")
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with an end id."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = set().union(*cut).difference(known)
        known.update(self.learn(fresh))
        end = np.array([self.end], dtype=np.int32).tobytes()
        coded = [b"".join(map(known.__getitem__, cs)) + end for cs in cut]
        for c in fresh:
            if len(c) > LONG:
                del known[c]
        return [np.frombuffer(x, dtype=np.int32) for x in coded]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@cache
def codec(model_file: str) -> MergeCodec:
    """One a Python worker."""
    return MergeCodec(model_file)


def encode_decode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int, with the end id) and ``decoded`` for every row.

    ``model`` is the name of a public tokenizer file, found on each executor. Null and empty texts have the end
    id alone and decode to the empty text. Rows keep their order and repeats; an empty table gives no rows, and further
    columns are left out. A very long text is cut in chunks like any other; without a space it is one chunk, whose
    agenda takes some hundred bytes a character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = codec(public_tokenizers.path(model))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                ids = c.encode([t or "" for t in b.column("_text").to_pylist()])
                yield {"_id": b.column("_id"), "ids": ids, "decoded": [c.decode(x) for x in ids]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return arrow_map(rows, run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode_decode`` gives."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encode_decode(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return digests(table(spark, sf_dir, "documents"))
