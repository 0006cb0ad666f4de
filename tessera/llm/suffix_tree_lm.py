"""Language-model scoring with a probabilistic suffix tree over words.

The root holds the words' own distribution (add-one, one more class for words not met). A state is a context of one or
more words, as many as the data ask for: the root's children are the contexts of one word, and a context is examined if
it occurs ``LEAST`` times, the one without its first word is kept and the one without its last word was examined (so that
its count is known). It is kept if what follows it diverges from what its suffix says by a test:
its count times the divergence. A text is scored word by word from the state of the longest kept suffix of what came
before, down to the root: a follower that a state has stored has a smoothed probability there, any other one takes its
share of what is left by the distribution of the state's suffix, so every state's distribution sums to one.

Counting. Every context with a follower that occurs ``LEAST`` times counts: what is learned of a passage depends on its
own count, not on the size of the table. Texts are cut into parts of bounded size. A part sends its distinct n-grams of
one length, packed, to the slots of a hash; a slot adds up what all parts sent, and keeps what is frequent. The test is
an aggregation over the slots' sums; then each slot answers the parts that asked. Questions of a part are in an order that
it can work out again, so answers name places in it and repeat no question. An n-gram is sent only if those a word
shorter within it are frequent, so that longer ones are few, and the tree ends where no context is kept. Nothing but
totals goes to the driver; parts, slots and states are tables in the shared folder, states in buckets by part, so that
they stay where they are and only answers are shuffled.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, delete_folder, id_fold, shared_dir, table

#: The token after the last word; no word holds a line feed.
END = b"\n"
#: Least count of a context with its follower.
LEAST = 3
#: A context is kept if its count times the divergence (nats) from its suffix reaches this.
DIVERGENCE = 12.0
#: Weight of the suffix's distribution in a state's.
SMOOTH = 2.0
#: Tokens of a part, and of what a slot adds up, about.
PART, SLOT = 1_000_000, 1_500_000
#: Stands for any follower: the count of the context itself.
ANY = -1
#: log10 probabilities of places are held as whole numbers of this size.
GRAIN = 1e-6
#: Setting by which Spark removes the shuffle files of a query when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of texts that are taken apart at once, about; most buckets of a table of states.
PIECE, BUCKETS = 8_000_000, 4096
#: Columns of what a part asks about n-grams: context, follower, suffix's log10 probability in grains, count; and about
#: contexts: number, count. Columns of the answers: a frequent n-gram's number in its slot, steps to its place among those asked about,
#: count; and of a kept context: its place among those asked about, log10 of the share that it leaves.
GRAMS, CONTEXTS = (np.int64,) * 4, (np.int64,) * 2
FOUND, KEPT = (np.int64,) * 3, (np.int64, float)
#: Of a slot's frequent n-grams, for the slot of their context: context, count, suffix's log10 probability in grains of those
#: alone with their context there; else context and the sums of counts, probabilities and counts times log ratios.
ALONE, SUMMED = (np.int64,) * 3, (np.int64, np.int64, float, float)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on; a copy into place, as a transposed array's tobytes() is slow."""
    view = values.view(np.uint8).reshape(len(values), values.itemsize)
    out = np.empty(view.shape[::-1], dtype=np.uint8)
    out[:] = view.T
    return out.tobytes()


def from_planes(raw: bytes, size: int, n: int, at: int = 0) -> np.ndarray:
    """``n`` whole numbers of so many bytes."""
    planes_ = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    out = np.empty((n, size), dtype=np.uint8)
    for i in range(size):
        out[:, i] = planes_[i]
    return out.view(f"<i{size}").reshape(n)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers or doubles, compressed, in four bytes a value where all fit; the first is best in order."""
    out = []
    for i, c in enumerate(columns):
        raw = np.diff(c, prepend=0) if i == 0 else c.view(np.int64)
        small = not len(raw) or -(1 << 31) <= raw.min() and raw.max() < 1 << 31
        raw = raw.astype("<i4") if small else raw
        size = 4 if small else 8
        out += [bytes([size]), planes(raw)]
    return len(columns[0]).to_bytes(8, "little") + zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    n, raw, at, out = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:]), 0, []
    for i, kind in enumerate(kinds):
        size = raw[at]
        c = from_planes(raw, size, n, at + 1).astype(np.int64, copy=False)
        out.append(c.cumsum() if i == 0 else c.view(kind))
        at += 1 + n * size
    return out


def unpack_all(blobs: list[bytes], kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The columns of several packs, one pack after another."""
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate([np.zeros(0, dtype=kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds)]


def mixed(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A context's number from that of its suffix and the word before it: 64 bits of a hash."""
    x = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (word.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def slots_of(head: np.ndarray, next_: np.ndarray, slots: int) -> np.ndarray:
    return (mixed(head, next_).view(np.uint64) % np.uint64(slots)).astype(np.int64)


def contexts_slots(number: np.ndarray, slots: int) -> np.ndarray:
    return slots_of(number, np.full(len(number), ANY), slots)


def runs(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order by one or two columns, equal rows side by side, and where in it each run of them starts."""
    one = first
    if second is not None:
        small = not len(first) or all(c.min() >= 0 and c.max() < 1 << 31 for c in (first, second))
        first, second = (first, second) if small else (np.unique(c, return_inverse=True)[1] for c in (first, second))
        one = first << 32 | second
    order = np.argsort(one)
    one = one[order]
    change = np.ones(len(order), dtype=bool)
    change[1:] = one[1:] != one[:-1]
    return order, np.nonzero(change)[0]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of runs of values."""
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def by_slot(slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by slot, which keeps that of equal ones, and where in it each slot starts (and the last one ends)."""
    narrow = slot.astype(np.uint16) if slots < 1 << 16 else slot
    return np.argsort(narrow, kind="stable"), np.append(0, np.bincount(slot, minlength=slots).cumsum())


def cut(rows: DataFrame) -> DataFrame:
    """Parts of ``rows`` (``_id, text, train``): ids, flags and sizes of the texts, tokens as places in the part's word list.

    A part is a stretch of one partition, so that nothing is shuffled; ``n`` counts each word in its training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId() << 32
        ids, train, words, sizes, size = [], [], [], [], 0

        def finished() -> dict:
            coded, each = pa.chunked_array(words, pa.string()).dictionary_encode(), np.concatenate(sizes)
            known = coded.chunk(coded.num_chunks - 1).dictionary.cast(pa.binary()) if coded.num_chunks else []  # no word at all
            listed = [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), b" ")[0].as_py()] if len(known) else []
            all_ = np.full(each.sum(), len(known), dtype="<i4")
            inner = np.ones(len(all_), dtype=bool)
            inner[each.cumsum() - 1] = False
            all_[inner] = np.concatenate([np.zeros(0, dtype=np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)])
            n = np.bincount(all_[np.repeat(np.array(train, dtype=bool), each)], minlength=len(known) + 1)
            return {
                "part": [part], "ids": [ids], "train": [train], "sizes": [each], "n_tokens": [len(all_)],
                "tokens": [zstandard.compress(planes(all_), 3)], "words": [zstandard.compress(b" ".join([*listed, END]), 3)], "n": [zstandard.compress(n.astype("<i8").tobytes(), 1)],
            }

        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            starts = np.unique(np.searchsorted(length, np.arange(0, length[-1] + 1 if len(length) else 0, PIECE), side="right"))
            starts = np.unique(np.append(0, starts[starts < len(length)]))
            for start, end in zip(starts, [*starts[1:], len(length)], strict=True):
                split = pc.ascii_split_whitespace(pc.ascii_lower(texts[start:end]))
                found = split.flatten()
                some = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0  # blanks at a text's ends give empty ones
                ends = np.append(0, some.cumsum())[pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()]
                found = found.filter(pa.array(some))
                tokens = np.diff(ends, prepend=0) + 1
                at, lasts = 0, tokens.cumsum()
                while at < len(tokens):
                    done = lasts[at - 1] if at else 0
                    to = min(len(tokens), int(np.searchsorted(lasts, done + PART - size)) + 1)  # the text that fills the part is its last
                    words.append(found[ends[at - 1] if at else 0 : ends[to - 1]])
                    sizes.append(tokens[at:to])
                    ids += b.column("_id")[start + at : start + to].to_pylist()
                    train += [bool(t) for t in b.column("train")[start + at : start + to].to_pylist()]
                    size, at = size + int(lasts[to - 1] - done), to
                    if size >= PART:
                        yield finished()
                        part += 1
                        ids, train, words, sizes, size = [], [], [], [], 0
        if ids:
            yield finished()

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"part long, ids array<{kind}>, train array<boolean>, sizes array<long>, n_tokens long, tokens binary, words binary, n binary"
    return arrow_map(rows.select("_id", "text", "train"), run, schema)


def word_answers(parts: DataFrame, slots: int) -> DataFrame:
    """``part, packed`` (place in the part's list, number, count of all training texts); and a row ``total, words`` for each slot."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part, words, n in zip(b.column("part").to_pylist(), b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                words = zstandard.decompress(words).split(b" ")
                n = np.frombuffer(zstandard.decompress(n), dtype="<i8")
                slot = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % slots
                order, starts = by_slot(slot, slots)
                places = [order[a:b] for a, b in zip(starts, starts[1:]) if b > a]
                yield {
                    "slot": [int(slot[x[0]]) for x in places], "part": [part] * len(places), "packed": [pack(x, n[x]) for x in places],
                    "words": [zstandard.compress(b" ".join([words[i] for i in x.tolist()]), 1) for x in places],
                }

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        packs = [unpack(b, (np.int64, np.int64)) for b in group.column("packed").to_pylist()]
        coded = pa.chunked_array([pc.split_pattern(pa.array([zstandard.decompress(w)], pa.binary()), pattern=b" ").flatten() for w in group.column("words").to_pylist()]).dictionary_encode()
        asked = [(part, c.indices.to_numpy(), *p) for part, c, p in zip(group.column("part").to_pylist(), coded.chunks, packs, strict=True)]
        counts = np.zeros(len(coded.chunk(coded.num_chunks - 1).dictionary), dtype=np.int64)
        for _, at, _, n in asked:
            counts[at] += n
        # Numbers that differ between slots without a count of all words; frequent words have small ones, which pack well.
        numbers = np.empty(len(counts), dtype=np.int64)
        numbers[np.argsort(-counts)] = np.arange(len(counts)) * slots + key[0].as_py()
        return pa.table({
            "part": pa.array([x[0] for x in asked] + [None], pa.int64()), "packed": pa.array([pack(place, numbers[at], counts[at]) for _, at, place, _ in asked] + [None], pa.binary()),
            "total": pa.array([None] * len(asked) + [int(counts.sum())], pa.int64()), "words": pa.array([None] * len(asked) + [int((counts > 0).sum())], pa.int64()),
        })

    asked = arrow_map(parts.select("part", "words", "n"), ask, "slot int, part long, words binary, packed binary")
    return asked.groupBy("slot").applyInArrow(merge, "part long, packed binary, total long, words long")


@dataclass
class Places:
    """The places of a part whose next longer context is examined, in order.

    ``head``, ``seen``: number and count of that context. ``gram``: number of the n-gram that ends here and is as long as
    the context, -1 if it isn't frequent. ``logs``: log10 probability by the longest kept context so far, in grains.
    """

    at: np.ndarray
    head: np.ndarray
    seen: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    logs: np.ndarray

    def packed(self) -> bytes:
        return pack(self.at, self.head - self.before(), self.seen, self.word, self.gram, self.logs)

    @staticmethod
    def of(blob: bytes) -> Places:
        places = Places(*unpack(blob, (np.int64,) * 6))
        places.head = places.head + places.before()
        return places

    def before(self) -> np.ndarray:
        """The n-gram that ends at the place before, which is the context there: it is stored once. Zero if that place isn't examined."""
        out = np.zeros(len(self.at), dtype=np.int64)
        out[1:] = np.where(np.diff(self.at) == 1, self.gram[:-1], 0)
        return out

    def asked(self, slots: int) -> Asked:
        """What the part asks about; an n-gram only if the one without its first word is frequent."""
        order, first = runs(self.head, self.word)
        start = np.zeros(len(order), dtype=np.int64)
        start[first] = 1
        of = np.empty(len(order), dtype=np.int64)
        of[order] = start.cumsum() - 1
        one = order[first]
        heads = self.head[one]
        new = np.ones(len(heads), dtype=bool)
        new[1:] = heads[1:] != heads[:-1]
        likely = np.nonzero(self.gram[one] >= 0)[0]
        order, gram_starts = by_slot(slots_of(heads[likely], self.word[one[likely]], slots), slots)
        contexts, context_starts = by_slot(contexts_slots(heads[new], slots), slots)
        return Asked(of, one, new.cumsum() - 1, one[new], likely[order], gram_starts, contexts, context_starts)

    def advance(self, asked: Asked, number: np.ndarray, times: np.ndarray, left: np.ndarray) -> tuple[Places, np.ndarray]:
        """Take the answers: numbers (-1: not frequent) and counts of n-grams, what contexts leave (NaN: not kept).

        The places with longer contexts to examine, and what each ``logs`` gained. A longer context is examined where its
        suffix is kept and the context itself is a frequent n-gram, which is the one that ends at the place before.
        """
        seen, left, before = self.seen[asked.first][asked.context], left[asked.context], self.logs[asked.one]
        kept, frequent = ~np.isnan(left), number >= 0
        logs = np.rint(np.where(kept, np.nan_to_num(left) / GRAIN, 0.0) + before)
        some = np.nonzero(kept & frequent)[0]
        logs[some] = np.rint(np.log10((times[some] + SMOOTH * 10 ** (before[some] * GRAIN)) / (seen[some] + SMOOTH)) / GRAIN)
        logs = logs.astype(np.int64)
        rows = np.nonzero(kept[asked.of])[0]
        rows = rows[(rows > 0) & (self.at[rows - 1] == self.at[rows] - 1)]
        rows = rows[frequent[asked.of[rows - 1]]]
        old, new = asked.of[rows - 1], asked.of[rows]
        return Places(self.at[rows], number[old], times[old], self.word[rows], number[new], logs[new]), ((logs - before) * GRAIN)[asked.of]


@dataclass
class Asked:
    """The distinct n-grams of places (context and follower, in this order) and their contexts.

    ``of``: each place's n-gram. ``one``, ``context``: a place of each n-gram, its context. ``first``: a place of each
    context. ``grams``, ``contexts``: those asked about, by slot, and where in them each slot starts.
    """

    of: np.ndarray
    one: np.ndarray
    context: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    contexts: np.ndarray
    context_starts: np.ndarray

    def answers(self, slots: list[int], grams: list[bytes | None], contexts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed ``FOUND`` or ``KEPT`` of slots as number and count of each n-gram, and what each context leaves."""
        number, times, left = np.full(len(self.one), -1), np.zeros(len(self.one), dtype=np.int64), np.full(len(self.first), np.nan)
        for slot, found, kept in zip(slots, grams, contexts, strict=True):
            if found is not None:
                x, steps, n = unpack(found, FOUND)
                at = self.grams[self.gram_starts[slot] + steps.cumsum()]
                number[at], times[at] = x * (len(self.gram_starts) - 1) + slot, n
            if kept is not None:
                at, share = unpack(kept, KEPT)
                left[self.contexts[self.context_starts[slot] + at]] = share
        return number, times, left


def token_counts(tokens: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each token of a part, from its coded tokens and its words' packed numbers and counts."""
    raw = zstandard.decompress(tokens)
    local = from_planes(raw, 4, len(raw) // 4)
    number, count = unpack(numbers, (np.int64, np.int64))
    return number[local], count[local]


def root_places(word: np.ndarray, times: np.ndarray, sizes: np.ndarray, grains: np.ndarray) -> Places:
    """The places at the root: all behind a frequent word; ``grains``: log10 of the words' own probabilities."""
    gram = np.where(times >= LEAST, word, -1)
    inner = np.ones(len(word), dtype=bool)
    inner[sizes.cumsum() - sizes] = False
    at = np.nonzero(inner)[0]
    at = at[gram[at - 1] >= 0]
    return Places(at, gram[at - 1], times[at - 1], word[at], gram[at], grains[at])


def texts_of(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text of a part each place is in."""
    return np.repeat(np.arange(len(sizes)), sizes)[at]


def sums_by_text(sizes: np.ndarray, at: np.ndarray, values: np.ndarray) -> bytes:
    """Packed (text, sum of its values)."""
    texts = texts_of(sizes, at)
    sums = np.bincount(texts, weights=values, minlength=len(sizes))
    some = np.nonzero(sums)[0]
    return pack(some, sums[some])


def gathered(asked: DataFrame, slots: int) -> DataFrame:
    """What a slot finds of ``slot, part, grams, contexts`` (packed): rows ``slot, alone, summed`` for the slots of the contexts of
    n-grams that occur ``LEAST`` times, packed, and ``slot, part, grams, contexts`` with the answers about n-grams, packed
    ``FOUND``, and the contexts that are asked about. A frequent context sends each slot a row at most."""

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        packs = [unpack(b, GRAMS) for b in group.column("grams").to_pylist()]
        head, next_, before, n = (np.concatenate([p[i] for p in packs]) for i in range(4))
        cuts = np.cumsum([len(p[0]) for p in packs])[:-1]
        del packs
        order, first = runs(head, next_)
        times = sums(n[order], first)
        often = times >= LEAST
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), np.diff(np.append(first, len(order))))
        rows, times = order[first][often], times[often]
        mine = []
        for x in np.split(place, cuts):
            at = np.nonzero(x >= 0)[0]
            mine.append(pack(x[at], np.diff(at, prepend=0), times[x[at]]) if len(at) else None)
        heads, logs = head[rows], before[rows]
        starts = np.nonzero(np.append(True, heads[1:] != heads[:-1])[: len(heads)])[0]
        single = np.diff(np.append(starts, len(heads))) == 1
        to, (p, lone) = contexts_slots(heads[starts], slots), (sums(10 ** (logs * GRAIN), starts), starts[single])
        gain = sums(times * (np.log(times) - logs * (GRAIN * np.log(10))), starts)
        columns = [(heads[lone], times[lone], logs[lone]), tuple(x[~single] for x in (heads[starts], sums(times, starts), p, gain))]
        packs: dict[int, list[bytes | None]] = {}
        for which, (xs, slot_of) in enumerate(zip(columns, (to[single], to[~single]), strict=True)):
            order, ends = by_slot(slot_of, slots)
            xs = [x[order] for x in xs]
            for s in np.nonzero(np.diff(ends))[0].tolist():
                packs.setdefault(s, [None, None])[which] = pack(*(x[ends[s] : ends[s + 1]] for x in xs))
        m, q = len(packs), len(mine)
        binary = pa.binary()
        none = lambda n, kind=binary: pa.nulls(n, kind)
        return pa.table({
            "slot": pa.array([*packs, *[slot] * q], pa.int32()),
            "alone": pa.concat_arrays([pa.array([x[0] for x in packs.values()], binary), none(q)]), "summed": pa.concat_arrays([pa.array([x[1] for x in packs.values()], binary), none(q)]),
            "part": pa.concat_arrays([none(m, pa.int64()), group.column("part").combine_chunks().cast(pa.int64())]),
            "grams": pa.concat_arrays([none(m), pa.array(mine, binary)]), "contexts": pa.concat_arrays([none(m), group.column("contexts").combine_chunks().cast(binary)]),
        })

    return asked.groupBy("slot").applyInArrow(merge, "slot int, alone binary, summed binary, part long, grams binary, contexts binary")


def kept_contexts(contexts: list[bytes], alone: list[bytes], summed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, in order, of a slot's contexts that pass the test, and log10 of the share of their suffix's rest that they leave."""
    whole, seen = unpack_all(contexts, CONTEXTS)
    order, first = runs(whole)
    whole, seen = whole[order[first]], seen[order[first]].astype(float)
    head, n, logs = unpack_all(alone, ALONE)
    of, known, before, gain = unpack_all(summed, SUMMED)
    at = np.searchsorted(whole, np.concatenate([head, of]))
    total = lambda one, more: np.bincount(at, np.concatenate([one, more]), len(whole))
    known = total(n, known)
    before, gain = total(10 ** (logs * GRAIN), before), total(n * (np.log(n) - logs * (GRAIN * np.log(10))), gain)
    some = np.nonzero(known > 0)[0]
    whole, seen, known, before, gain = (x[some] for x in (whole, seen, known, before, gain))
    more, left_before = seen - known, np.maximum(1e-12, 1 - before)
    gain = gain - known * np.log(seen) + np.where(more > 0, more * np.log(np.maximum(more, 1) / seen / left_before), 0.0)
    left = np.log10(np.maximum(1e-12, 1 - (known + SMOOTH * before) / (seen + SMOOTH)) / left_before)
    return whole[gain >= DIVERGENCE], left[gain >= DIVERGENCE]


def answered(found: DataFrame) -> DataFrame:
    """``of_part, slot, grams, contexts``: packed ``FOUND`` of the n-grams that a part asked a slot about, or ``KEPT`` of the contexts."""

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts, contexts, alone, summed = (group.column(c).drop_null().to_pylist() for c in ("part", "contexts", "alone", "summed"))
        heads, left = kept_contexts(contexts, alone, summed)
        out, packs = [], []
        for part, blob in zip(parts, contexts, strict=True):
            asked_heads, _ = unpack(blob, CONTEXTS)
            at = np.minimum(np.searchsorted(heads, asked_heads), max(0, len(heads) - 1))
            hit = np.nonzero(heads[at] == asked_heads)[0] if len(heads) else at[:0]
            if len(hit):
                out.append(part)
                packs.append(pack(hit, left[at[hit]]))
        n = len(out)
        return pa.table({"of_part": pa.array(out, pa.int64()), "slot": pa.array([key[0].as_py()] * n, pa.int32()), "grams": pa.nulls(n, pa.binary()), "contexts": pa.array(packs, pa.binary())})

    of_contexts = found.select("slot", "part", "contexts", "alone", "summed").groupBy("slot").applyInArrow(answer, "of_part long, slot int, grams binary, contexts binary")
    of_grams = found.filter("part is not null and grams is not null").select(F.col("part").alias("of_part"), "slot", "grams", F.lit(None).cast("binary").alias("contexts"))
    return of_grams.unionAll(of_contexts)


def score_texts(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> tuple[DataFrame, int]:
    """``id_col, train_col, n_tokens, n_known, base_score, score`` for every row, learned from those with ``train_col``; the training tokens.

    Null and empty texts are an end token alone. A very long text is a part of its own. Repeated rows and null ids count
    and are scored each. An empty table gives no rows; without training texts all words are unknown. Further columns are
    left out.
    """
    spark = rows.sparkSession
    folder, catalogued = shared_dir(spark), f"suffix_tree_{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        """The rows as a table; the shuffle files of its writing go with it, as the driver's collection of garbage may come too late."""
        before = spark.conf.get(CLEANED)
        spark.conf.set(CLEANED, "true")
        try:
            df.write.parquet(f"{folder}/{name}")
        finally:
            spark.conf.set(CLEANED, before)
        return spark.read.parquet(f"{folder}/{name}")

    def by_part(df: DataFrame, name: str) -> DataFrame:
        """The rows as a table in buckets by part: what is joined by part is shuffled to them, they are not."""
        before = spark.conf.get(CLEANED)
        spark.conf.set(CLEANED, "true")
        try:
            df.write.format("parquet").bucketBy(buckets, "part").option("path", f"{folder}/{name}").saveAsTable(f"{catalogued}_{name}")
        finally:
            spark.conf.set(CLEANED, before)
        return spark.table(f"{catalogued}_{name}")

    def dropped(*names: str) -> None:
        """Tables of finished steps go at once."""
        for name in names:
            if name.startswith("level"):
                spark.sql(f"DROP TABLE IF EXISTS {catalogued}_{name}")
            delete_folder(spark, f"{folder}/{name}")

    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(train_col).alias("train"))
    kind = rows.schema["_id"].dataType.simpleString()
    parts = stored(cut(rows), "parts")
    n_tokens, n_parts = parts.agg(F.sum("n_tokens"), F.count("*")).first()
    slots, buckets = max(1, -(-(n_tokens or 0) // SLOT)), min(BUCKETS, max(1, n_parts // 2))
    words = stored(word_answers(parts, slots), "words")
    total, distinct = (x or 0 for x in words.agg(F.sum("total"), F.sum("words")).first())
    state = f"part long, ids array<{kind}>, sizes array<long>, train array<boolean>, tokens binary, numbers binary, places binary, n_places long, gained binary"

    def log_root(times: np.ndarray) -> np.ndarray:
        return np.log10((times + 1) / (total + distinct + 1))

    def places_of(tokens: bytes | None, numbers: bytes | None, places: bytes | None, sizes: np.ndarray) -> Places:
        """Those of a row of ``state``; at the root they follow from the tokens, which take less room."""
        if places is not None:
            return Places.of(places)
        word, times = token_counts(tokens, numbers)
        return root_places(word, times, sizes, np.rint(log_root(times) / GRAIN).astype(np.int64))

    def begin(key: tuple[pa.Scalar, ...], row: pa.Table, given: pa.Table) -> pa.Table:
        """A part at the root; ``gained`` has the texts' tokens, known tokens and base scores."""
        place, number, count = unpack_all(given.column("packed").to_pylist(), (np.int64,) * 3)
        numbers, counts = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        numbers[place], counts[place] = number, count
        tokens, packed, sizes = row.column("tokens")[0].as_py(), pack(numbers, counts), np.array(row.column("sizes")[0].as_py())
        word, times = token_counts(tokens, packed)
        starts = sizes.cumsum() - sizes
        base = pack(sizes, np.add.reduceat((times > 0).astype(np.int64), starts), np.add.reduceat(log_root(times), starts))
        n = len(root_places(word, times, sizes, times).at)
        columns = {c: row.column(c) for c in ("part", "ids", "sizes", "train", "tokens")}
        return pa.table(columns | {"numbers": pa.array([packed], pa.binary()), "places": pa.nulls(1, pa.binary()), "n_places": pa.array([n], pa.int64()), "gained": pa.array([base], pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i, part in enumerate(b.column("part").to_pylist()):
                sizes, train = np.array(b.column("sizes")[i].as_py()), np.array(b.column("train")[i].as_py())
                places = places_of(*(b.column(c)[i].as_py() for c in ("tokens", "numbers", "places")), sizes)
                asked = places.asked(slots)
                n = np.bincount(asked.of[train[texts_of(sizes, places.at)]], minlength=len(asked.one))
                grams, contexts = asked.one[asked.grams], asked.first[asked.contexts]
                of_grams, of_contexts = [x[grams] for x in (places.head, places.word, places.logs)] + [n[asked.grams]], [x[contexts] for x in (places.head, places.seen)]
                some = np.nonzero((np.diff(asked.gram_starts) > 0) | (np.diff(asked.context_starts) > 0))[0].tolist()
                packs = [[pack(*(c[starts[s] : starts[s + 1]] for c in columns)) for s in some] for columns, starts in ((of_grams, asked.gram_starts), (of_contexts, asked.context_starts))]
                yield {"slot": some, "part": [part] * len(some), "grams": packs[0], "contexts": packs[1]}

    def advance(key: tuple[pa.Scalar, ...], row: pa.Table, given: pa.Table) -> pa.Table:
        sizes = np.array(row.column("sizes")[0].as_py())
        places = places_of(*(row.column(c)[0].as_py() for c in ("tokens", "numbers", "places")), sizes)
        asked = places.asked(slots)
        longer, gained = places.advance(asked, *asked.answers(*(given.column(c).to_pylist() for c in ("slot", "grams", "contexts"))))
        none = {c: pa.nulls(1, row.schema.field(c).type) for c in ("ids", "tokens", "numbers")}
        new = {"places": [longer.packed()], "gained": [sums_by_text(sizes, places.at, gained)]}
        columns = {c: row.column(c) for c in ("part", "sizes", "train")} | none | {c: pa.array(x, pa.binary()) for c, x in new.items()} | {"n_places": pa.array([len(longer.at)], pa.int64())}
        return pa.table({c: columns[c] for c in row.schema.names})

    def score(key: tuple[pa.Scalar, ...], row: pa.Table, gains: pa.Table) -> pa.Table:
        n_tokens, n_known, base = unpack(row.column("gained")[0].as_py(), (np.int64, np.int64, float))
        ids, train = (row.column(c).combine_chunks().flatten() for c in ("ids", "train"))
        whole = base.copy()
        for blob in gains.column("gain").to_pylist():
            text, gained = unpack(blob, (np.int64, float))
            whole[text] += gained
        out = {"n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": whole}
        return pa.table({"_id": ids, "train": train} | {k: pa.array(v) for k, v in out.items()})

    given = words.filter("part is not null").select("part", "packed")
    live = by_part(parts.select("part", "ids", "sizes", "train", "tokens").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(begin, state), "level0")
    texts = stored(live.select("part", "ids", "train", "gained"), "texts")
    gains = spark.createDataFrame([], "of_part long, gain binary")
    dropped("parts", "words")
    level = 0
    while live.agg(F.sum("n_places")).first()[0]:
        level += 1
        found = stored(gathered(arrow_map(live, ask, "slot int, part long, grams binary, contexts binary"), slots), f"found{level}")
        live = by_part(live.filter("n_places > 0").groupBy("part").cogroup(answered(found).groupBy("of_part")).applyInArrow(advance, state), f"level{level}")
        gains = gains.unionAll(stored(live.select(F.col("part").alias("of_part"), F.col("gained").alias("gain")), f"gains{level}"))
        dropped(f"found{level}", f"level{level - 1}")  # what a level gained is read at the end
    dropped(f"level{level}")
    schema = f"_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"
    scored = texts.groupBy("part").cogroup(gains.groupBy("of_part")).applyInArrow(score, schema)
    return scored.withColumnsRenamed({"_id": id_col, "train": train_col}), total


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree scores of every document, learned from those whose id's crc32 modulo 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, total = score_texts(docs.withColumn("train", id_fold(F.col("doc_id"), 7) != 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
