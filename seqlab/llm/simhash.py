"""Near duplicates by SimHash fingerprints, found by a self-join of binary tries.

A fingerprint has 64 bits, and documents are linked if theirs differ in a few.
Sorted fingerprints are a binary trie: a node is a range with a common prefix.
The join goes down a trie from the pair (root, root), pairs of nodes together,
adds up the bits in which their prefixes differ, and leaves a pair as soon as
there are more than the budget allows.

Fingerprints that differ in at most ``budget`` bits agree in one of
``budget + 1`` parts. So there is a trie for each part, with the part's bits
on top, where no difference is left to allow: its subtries below them are
groups of their own, and are joined in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import saved, sorted_runs
from seqlab.llm.near_dup import components

BITS, SEED = 64, 42
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

#: Members of a group from which it is split, and of a block of what can't be split.
MOST_MEMBERS, BLOCK = 1 << 14, 1 << 16
#: Node pairs that are gone through at once.
_FRONT = 1 << 18


def fingerprint(text: str | None, size: int = 4, step: int = 1 << 15) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the hashes of its shingles, repeats included; 0 without words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, stops = np.concatenate([[0], ends[:-1]]), ends - 1
    n = max(1, len(words) - size + 1)
    stops = stops[min(size, len(words)) - 1 :]
    ones = np.zeros((8, 8), np.int64)
    for a in range(0, n, step):
        some = zip(starts[a : min(a + step, n)].tolist(), stops[a : a + step].tolist(), strict=True)
        octets = np.array([xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in some], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(octets[:, k], minlength=256) @ _BIT_OF
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big")


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "bits"])

    return sign


def _cuts(width: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` parts of ``width`` bits, from the lowest on."""
    cuts = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _part(bits: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))


def _rest(bits: Column, shift: int, width: int) -> Column:
    """The bits other than a part's, moved together."""
    low = bits.bitwiseAND(F.lit((1 << shift) - 1))
    return low if shift + width == BITS else F.shiftleft(F.shiftrightunsigned(bits, shift + width), shift).bitwiseOR(low)


class Tries:
    """Sorted ranges of fingerprints as tries, and the links found between them.

    Only a forest of the links is kept. A pair of nodes that lie in one
    component already has no other link to give, and is left too.
    """

    def __init__(self, values: np.ndarray, budget: int):
        self.values, self.budget = values, budget
        self.root = np.arange(len(values))
        self._changes()
        #: For each bit from the top, how many of the values before a place have it.
        self.ones = np.zeros((BITS, len(values) + 1), np.int32)
        for d in range(BITS):
            np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=self.ones[d, 1:], dtype=np.int32)

    def _changes(self) -> None:
        """How often the component changes before a place: a node of one component has as many at both ends."""
        self.changes = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])

    def _open(self, front: np.ndarray) -> np.ndarray:
        """The node pairs that are not empty, within the budget and not of one component."""
        a, b, c, d, differ = front.T
        front = front[(a < b) & (c < d) & (differ <= self.budget)]
        a, b, c, d, _ = front.T
        one = (self.root[a] == self.root[c]) & (self.changes[a] == self.changes[b - 1]) & (self.changes[c] == self.changes[d - 1])
        return front[~one]

    def _link(self, first: np.ndarray, second: np.ndarray) -> None:
        while True:
            a, b = self.root[first], self.root[second]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(far := self.root[self.root], self.root):
                self.root = far
            self._changes()

    def join(self, pairs: np.ndarray) -> None:
        """Go down pairs of ranges (from, to, from, to), each a trie with itself (equal ranges) or two tries."""
        stack = [(0, np.column_stack([pairs, np.zeros(len(pairs), np.int64)]))]
        while stack:
            depth, front = stack.pop()
            front = self._open(front)
            if len(front) > _FRONT:
                stack += [(depth, front[i : i + _FRONT // 2]) for i in range(0, len(front), _FRONT // 2)]
                continue
            a, b, c, d, _ = front.T
            itself, leaves = (a == c) & (b == d), (b - a == 1) & (d - c == 1)
            x, y = a[leaves & ~itself], c[leaves & ~itself]
            near = np.bitwise_count(self.values[x] ^ self.values[y]) <= self.budget
            if near.any():
                self._link(x[near], y[near])
            front, itself = front[~leaves], itself[~leaves]
            if not len(front):
                continue
            a, b, c, d, differ = front.T
            ones = self.ones[depth]
            m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])  # the values with the next bit come after those without
            across = [np.column_stack([a, m, k, d, differ + 1]), np.column_stack([m, b, c, k, differ + 1])[~itself]]  # of a node with itself one is the other
            stack.append((depth + 1, np.concatenate(across)))
            # equal bits are gone through first: they join what lies close
            stack.append((depth + 1, np.concatenate([np.column_stack([a, m, c, k, differ]), np.column_stack([m, b, k, d, differ])])))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.values[self.root[moved]], self.values[moved]


def _join(budget: int, gathered: int = 1 << 15):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[np.ndarray] = []
        pairs: list[tuple[int, int, int, int]] = []
        n = 0

        def found() -> pa.RecordBatch:
            tries = Tries(np.concatenate(sides), budget)
            tries.join(np.array(pairs, np.int64))
            sides.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in tries.forest()], names=["a", "b"])

        for run in sorted_runs(batches, GROUP):
            if run.num_rows < 2:
                continue
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            values, mine = run.column("bits").to_numpy().view(np.uint64), run.column("mine").to_numpy()
            own = [np.sort(values)] if i == j else [np.sort(values[mine == x]) for x in (i, j)]
            to = n + len(values)
            pairs.append((n, to, n, to) if i == j else (n, n + len(own[0]), n + len(own[0]), to))
            sides += own
            n = to
            if n >= gathered:  # small groups are gone through together
                yield found()
                n = 0
        if n:
            yield found()

    return join


GROUP = ["part", "value", "sub", "subvalue", "i", "j"]


def links(prints: DataFrame, *, budget: int = 4, most: int = MOST_MEMBERS, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints (``bits``) that differ in at most ``budget`` bits, a forest of each task's.

    Plan: a fingerprint goes to the ``budget + 1`` groups of its parts. A group
    of over ``most`` members is split by as many parts of its other bits, of
    which again one must agree; what is still over ``block`` is dealt to blocks
    by a hash, and pairs of blocks are joined, two tries each. So a task holds
    at most two blocks at once, whatever fingerprints are common.
    """
    parts, bits = _cuts(BITS, budget + 1), F.col("bits")
    if budget == 0:
        return prints.select(bits.alias("a"), bits.alias("b")).where("a <> b")
    of_part = F.array(*(F.struct(F.lit(p).alias("part"), _part(bits, *x).alias("value")) for p, x in enumerate(parts)))
    first = prints.select("bits", F.inline(of_part)).withColumns({"sub": F.lit(-1), "subvalue": F.lit(0).cast("long"), "blocks": F.lit(1)})
    large = saved(first.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "simhash-large").select("part", "value")
    if not large.isEmpty():
        subs = F.coalesce(*(F.when(F.col("part") == p, F.array(*(F.struct(F.lit(q).alias("sub"), _part(_rest(bits, *x), *y).alias("subvalue")) for q, y in enumerate(_cuts(BITS - x[1], budget + 1))))) for p, x in enumerate(parts)))
        split = first.drop("sub", "subvalue", "blocks").join(large, ["part", "value"]).select("part", "value", "bits", F.inline(subs))
        sizes = split.groupBy(*GROUP[:4]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = saved(sizes.select(*GROUP[:4], F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-groups")
        first = first.join(large, ["part", "value"], "left_anti").unionByName(split.join(sizes, GROUP[:4]))
    dealt = first.withColumn("mine", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")).withColumn("yours", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "yours")).withColumn("j", F.greatest("mine", "yours")).drop("yours", "blocks")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_join(budget), "a long, b long")


def simhash_components(docs: DataFrame, *, size: int = 4, budget: int = 4, most: int = MOST_MEMBERS, block: int = BLOCK) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``budget`` of 64 bits.

    Returns a row per input row: doc_id, fingerprint (16 lower-case hex digits)
    and component_id, the smallest doc_id that links reach, its own included.
    Words are runs without white space (0x20, 0x09 to 0x0D), A-Z lower-cased;
    shingles are ``size`` of them joined by spaces, repeats included (fewer
    words: all of them); their hash is XXH64 of the UTF-8 bytes with seed 42.

    Edge cases: texts without words (null, empty, white space) have fingerprint
    zero and are linked like any others. Repeated rows are rows each. Rows with
    a null doc_id are linked too; a component of nulls alone has a null id. An
    empty table gives no rows; other columns are ignored.

    Plan: equal fingerprints are one, combined before anything is joined; of
    links only forests leave a task (``links``), and components are found over
    written tables of their edges. Nothing grows with the pairs of a group.
    """
    if not 0 <= budget < BITS:
        raise ValueError("budget must be from 0 to 63")
    signed = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign(size), "doc_id long, bits long"), "simhash-prints")
    prints = saved(signed.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(prints.select("bits"), budget=budget, most=most, block=block))
    of = found.join(prints, found["id"] == prints["bits"]).select("bits", "comp", "first")
    named = of.join(of.groupBy("comp").agg(F.min("first").alias("component")), "comp").select(F.col("bits").alias("b"), "component")
    # written, so that the join below has an exchange on either side and a frequent fingerprint can be split
    named = saved(prints.join(named, F.col("bits") == F.col("b"), "left").select("bits", F.when(F.col("b").isNull(), F.col("first")).otherwise(F.col("component")).alias("component_id")), "simhash-named")
    return signed.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
