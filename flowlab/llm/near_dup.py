"""Documents linked by the Jaccard similarity of their word shingles, found by PartEnum signatures.

Sets are put into bands of similar size; bands overlap so that any two sets
that can be similar enough share one.  Within a band, sets of sizes s and t
are similar enough only if at most k = (1 - j) / (1 + j) * (s + t) elements
differ.  The domain of shingle hashes is cut into groups, a group into
``n2`` partitions; a signature is the hash of a set's elements in all but
``k2`` partitions of a group.  Of k // (k2 + 1) + 1 groups, one has at most
k2 differing elements, so two similar sets share a signature there.  A set
signs its groups in order until it has so many that no choice of partitions
is empty in; sets without so many (short ones, now and then) also sign their
k + 1 smallest single elements.  If two similar sets shared no group
signature, both would be of this kind, and their smallest elements meet.  So
no link is lost, at any size.

Rows of one signature are gathered per batch before the shuffle, so copies
and common passages do not make hot keys; copies of one set are one member,
told by a 64-bit hash of the set there and by 128 bits and its size
afterwards.  A signature's members are first compared with the one of them
that is in most signatures, one such comparison per document; links found so
are contracted.  The same is done once more with such a member of another
component, and then the pairs that share a signature across different
components are compared, signatures with equal members once.  Pairs whose
sizes or parity sketches (which differ in no more bits than the sets in
elements) rule a link out are dropped, inside the join by a short sketch and
by one with as many bits as the sets have elements, and after it by a long
one; the others are compared exactly, on the sets of 64-bit shingle hashes.  Long sketches and
sets are made from the texts of the documents concerned, which a task tells
by a bit table of bounded size, so texts are never shuffled.

Defined results: null and empty texts (n = 0) are linked with nothing; a
null doc_id is in no link and has a null component; documents of one set are
linked; rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.bits import BitTable
from flowlab.llm.graph import components
from flowlab.llm.tables import Tables
from flowlab.llm.text import NON_SPACE, U, Words, expand, groups, mix, shingle_hashes, slices

#: Bands of sets up to this size choose partitions; larger ones have k2 = 0.
FINE_BELOW = 256
_N2 = 4
#: Bits of a long parity sketch, a power of two, and 64-bit words of a short one.
SKETCH, SHORT = 8192, 4
_SHORT = [f"p{i}" for i in range(SHORT)]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each set begins.

    A text of fewer than ``size`` words, but not none, has one shingle: all its words.
    """
    words = Words(texts, NON_SPACE)
    h, doc = words.hashes(), words.doc()
    sh = shingle_hashes(h, size)
    whole = doc[:len(sh)] == doc[size - 1:]
    keys, owner = [sh[whole]], [doc[:len(sh)][whole]]
    for n in range(1, size):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            keys.append(shingle_hashes(h, n)[words.first[short]] + U(n))
            owner.append(short)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(words.counts) + 1))


class Bands:
    """Size bands for similarity ``percent`` / 100 and their parameters."""

    def __init__(self, percent: int):
        self.percent = percent
        low, high = [], []
        a = 1
        while a < 1 << 31:
            b = int(a * (100 / percent) ** 3)
            low.append(a)
            high.append(b)
            a = max(a + 1, -(-percent * (b + 1) // 100))
        self.low, self.high = np.array(low), np.array(high)
        k = self.differing(self.high, self.high)
        self.k2 = np.where((k > 0) & (self.high <= FINE_BELOW), 1, 0)
        need = k // (self.k2 + 1) + 1
        self.groups = np.where(need == 1, 1, need + -(-need * 8 // 100) + 1)

    def differing(self, s, t):
        """Most elements in which similar enough sets of these sizes differ."""
        return (100 - self.percent) * (s + t) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, band) for every band that a set is in."""
        first = np.searchsorted(self.high, sizes)
        sets, bands = [], []
        for more in range(4):
            band = np.minimum(first + more, len(self.low) - 1)
            fits = np.flatnonzero((sizes > 0) & (self.low[band] <= sizes) & (band == first + more))
            sets.append(fits)
            bands.append(band[fits])
        return np.concatenate(sets), np.concatenate(bands)

    def need(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """k of each set: the most by which it differs from a similar enough set of the band."""
        return self.differing(sizes, np.minimum(self.high[band], np.maximum(sizes, 100 * sizes // self.percent)))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end of the last."""
    n = len(keys[0])
    new = np.ones(n + 1, dtype=bool)
    if n:
        new[1:n] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    else:
        new[0] = False
    return np.append(np.flatnonzero(new[:n]), n)


def signatures(keys: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of the given sets; ``keys`` are sorted within a set."""
    sizes = np.diff(first)
    sets, band = bands.of(sizes)
    k = bands.need(sizes[sets], band)
    sums = np.concatenate([[U(0)], np.cumsum(mix(keys ^ U(0x5BF03635)), dtype=np.uint64)])
    out_set, out_sig = [], []

    def emit(instance, tag, value):
        salt = mix((band[instance].astype(np.uint64) << U(48)) ^ tag.astype(np.uint64))
        out_set.append(sets[instance])
        out_sig.append(mix(value ^ salt))

    def parts(chosen, per_group):
        """Runs of elements in one partition: (instance, partition, sum of hashes)."""
        counts = sizes[sets[chosen]]
        at = expand(first[sets[chosen]], counts)
        inst = np.repeat(np.arange(len(chosen)), counts)
        n = np.repeat(bands.groups[band[chosen]] * per_group, counts).astype(np.uint64)
        part = (((keys[at] >> U(32)) * n) >> U(32)).astype(np.int64)
        run = _runs(inst, part)
        begin = run[:-1]
        return inst[begin], part[begin], sums[at[run[1:] - 1] + 1] - sums[at[begin]]

    lacking = []
    coarse = np.flatnonzero(bands.k2[band] == 0)
    if len(coarse):
        inst, part, value = parts(coarse, 1)
        start = np.searchsorted(inst, np.arange(len(coarse) + 1))
        rank = np.arange(len(inst)) - start[inst]
        need = k[coarse] + 1
        take = rank < need[inst]
        emit(coarse[inst[take]], part[take], value[take])
        lacking.append(coarse[np.diff(start) < need])
    fine = np.flatnonzero(bands.k2[band] == 1)
    if len(fine):
        inst, part, value = parts(fine, _N2)
        group = part // _N2
        run = _runs(inst, group)
        begin = run[:-1]
        held = np.zeros((len(begin), _N2), dtype=np.uint64)
        row = np.repeat(np.arange(len(begin)), np.diff(run))
        held[row, part % _N2] = value
        there = np.zeros((len(begin), _N2), dtype=bool)
        there[row, part % _N2] = True
        occupied = there.sum(axis=1)
        usable = occupied > 1
        inst, group = inst[begin], group[begin]
        start = np.searchsorted(inst, np.arange(len(fine) + 1))
        before = np.concatenate([[0], np.cumsum(usable)])
        need = k[fine] // 2 + 1
        take = before[:-1] - before[start[inst]] < need[inst]
        total = held.sum(axis=1, dtype=np.uint64)
        for left_out in range(_N2):
            some = take & (occupied > there[:, left_out])
            emit(fine[inst[some]], group[some] * 8 + left_out + 1, total[some] - held[some, left_out])
        lacking.append(fine[before[start[1:]] - before[start[:-1]] < need])
    few = np.concatenate(lacking) if lacking else np.zeros(0, dtype=np.int64)
    if len(few):
        counts = np.minimum(k[few] + 1, sizes[sets[few]])
        at = expand(first[sets[few]], counts)
        inst = np.repeat(few, counts)
        emit(inst, np.full(len(inst), (1 << 47) + 7), keys[at])
    if not out_set:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(out_set), np.concatenate(out_sig)


def set_hashes(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    made = []
    for seed in (0x27D4EB2F, 0x165667B1):
        sums = np.concatenate([[U(0)], np.cumsum(mix(keys ^ U(seed)), dtype=np.uint64)])
        made.append((sums[first[1:]] - sums[first[:-1]]).astype(np.int64))
    return made


def short_sketches(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The parity of the number of elements in each of 64 * SHORT classes, 64 classes a word."""
    bit = U(1) << ((keys >> U(16)) & U(63))
    word = (keys >> U(8)) % U(SHORT)
    out = []
    for i in range(SHORT):
        folded = np.concatenate([[U(0)], np.bitwise_xor.accumulate(np.where(word == i, bit, U(0)))]) if len(keys) else np.zeros(1, dtype=np.uint64)
        out.append((folded[first[1:]] ^ folded[first[:-1]]).astype(np.int64))
    return out


def sized_sketches(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The parity of the number of elements in each of as many classes as the set has elements, up to a power of two (256 at least), 64 a word.

    The first half of the words, each xor-ed with its partner in the second half, is the sketch of half the classes.
    """
    out = []
    for a, b in pairwise(first.tolist()):
        words = max(4, 1 << max(0, (b - a - 1) // 64).bit_length())
        odd = np.bincount(((keys[a:b] >> U(24)) & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return out


def _describe(size):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, first = shingle_sets(part.column("text"), size)
                sized = sized_sketches(keys, first)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sized])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *map(pa.array, set_hashes(keys, first)), *map(pa.array, short_sketches(keys, first)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sized)))],
                    ["doc_id", "n", "h1", "h2", *_SHORT, "sized"])
    return run


def _sign(size, percent):
    """Signatures with the sets (by their hash, in order) that have them in a group of slices."""
    def run(batches):
        bands = Bands(percent)
        for parts in (g for batch in batches for g in groups(batch)):
            ids, sigs = [], []
            for part in parts:
                keys, first = shingle_sets(part.column("text"), size)
                row, sig = signatures(keys, first, bands)
                ids.append(set_hashes(keys, first)[0][row])
                sigs.append(sig)
            ids, sigs = np.concatenate(ids), np.concatenate(sigs)
            order = np.lexsort((ids, sigs))
            ids, sigs = ids[order], sigs[order]
            new = _runs(sigs, ids)[:-1]
            ids, sigs = ids[new], sigs[new]
            run_ = _runs(sigs)
            begin, counts = run_[:-1], np.diff(run_) - 1
            others = ids[expand(begin + 1, counts)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(others, pa.int64()),
                                             mask=pa.array(counts == 0))
            yield pa.RecordBatch.from_arrays([pa.array(sigs[begin].astype(np.int64)), pa.array(ids[begin]), lists], ["sig", "h1", "others"])
    return run


def _sets(size, table, made):
    """``made`` (bytes of a set) for the documents in the bit table."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(table.value.among(batch.column("doc_id")))
            for part in slices(batch):
                keys, first = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array([made(keys[a:b]) for a, b in pairwise(first.tolist())], pa.binary())], ["id", "n", "made"])
    return run


def _sketch(keys: np.ndarray) -> bytes:
    """The parity of the number of elements in each of SKETCH classes."""
    return np.packbits(np.bincount((keys & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _possible(percent):
    """Pairs that sizes and sketches do not rule out."""
    def run(batches):
        for batch in batches:
            n, m = np.array(batch.column("n_a"), dtype=np.int64), np.array(batch.column("n_b"), dtype=np.int64)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH // 8) for c in ("made_a", "made_b"))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ <= (100 - percent) * (n + m) // (100 + percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))
    return run


def _similar(percent):
    def run(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column("made_a").to_pylist(), batch.column("made_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                links.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(links, pa.bool_()))
    return run


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id: long, text)."""
    with Tables(docs.sparkSession) as tables:
        return _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, percent, tables)


def _linked(docs: DataFrame, size: int, percent: int, tables: Tables) -> DataFrame:
    spark = docs.sparkSession
    described = tables.keep(tables.store(docs.mapInArrow(_describe(size), f"doc_id long, n long, h1 long, h2 long, {', '.join(f'{p} long' for p in _SHORT)}, sized array<long>")))
    same = tables.keep(tables.store(described.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), *(F.max(p).alias(p) for p in _SHORT), F.max("sized").alias("sized"))))

    rows = docs.mapInArrow(_sign(size, percent), "sig long, h1 long, others array<long>")
    by_sig = Window.partitionBy("sig")
    rows = rows.withColumns({"low": F.min("h1").over(by_sig), "high": F.max(F.coalesce(F.get("others", F.size("others") - 1), "h1")).over(by_sig)}).filter("low <> high")
    members = (rows.select("sig", F.explode(F.concat(F.array("h1"), F.coalesce("others", F.array().cast("array<long>")))).alias("h1")).distinct()
               .join(same.select("h1", F.col("rep").alias("id")), "h1").select("sig", "id"))
    members = tables.store(members)
    degree = members.groupBy("id").agg(F.count("*").alias("degree"))
    ranked = members.select("sig", "id").join(degree, "id").select("sig", "id", F.struct("degree", (-F.col("id")).alias("minus")).alias("rank"))

    def made_for(ids: DataFrame, made) -> DataFrame:
        table = spark.sparkContext.broadcast(BitTable(ids))
        return docs.mapInArrow(_sets(size, table, made), "id long, n long, made binary").dropDuplicates(["id"])

    def both(pairs: DataFrame, made: DataFrame) -> DataFrame:
        a, b = (made.withColumnsRenamed({"id": x, "n": f"n_{x}", "made": f"made_{x}"}) for x in "ab")
        return pairs.join(a, "a").join(b, "b")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        ids = lambda p: p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
        possible = tables.store(both(pairs, made_for(ids(pairs), _sketch)).mapInArrow(_possible(percent), "a long, b long"))
        return tables.store(both(possible, made_for(ids(possible), np.ndarray.tobytes)).mapInArrow(_similar(percent), "a long, b long"))

    def one_each(met: DataFrame) -> DataFrame:
        """Of the members that each document met, the one it met in most signatures."""
        best = (met.groupBy("id", "other").agg(F.count("*").alias("shared")).groupBy("id")
                .agg(F.max_by("other", F.struct("shared", -F.col("other"))).alias("other")))
        return tables.store(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())

    short = [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _SHORT]

    def could(n, m, differ):
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (100 - percent) * (n + m))

    centre = ranked.groupBy("sig").agg((-F.max("rank")["minus"]).alias("other"))
    tried = one_each(members.join(centre, "sig").filter("id <> other"))
    links = verify(tried)

    def named() -> DataFrame:
        """Members of signatures that reach over components, with these."""
        found = components(links, tables)
        out = members.join(found, members["id"] == found["node"], "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
        mixed = out.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("sig")
        return tables.store(out.join(mixed, "sig", "left_semi"))

    now = named()
    tops = (now.select("sig", "id", "component").join(degree, "id")
            .groupBy("sig", "component").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("top")))
    first = tops.groupBy("sig").agg(F.max(F.struct("top", "component")).alias("t")).select("sig", F.col("t.component").alias("c1"), (-F.col("t.top.minus")).alias("o1"))
    second = tops.join(first, "sig").filter("component <> c1").groupBy("sig").agg((-F.max("top")["minus"]).alias("o2"))
    met = now.select("sig", "id", "component").join(first, "sig").join(second, "sig")
    again = one_each(met.select("sig", "id", F.when(F.col("component") == F.col("c1"), F.col("o2")).otherwise(F.col("o1")).alias("other"))).join(tried, ["a", "b"], "left_anti")
    links = links.union(verify(again))

    now = named()
    # Signatures with the same members tell the same: one of them stays.
    told = [F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1))), F.count("*"), F.min("id")]
    alike = now.groupBy("sig").agg(*[x.alias(f"t{i}") for i, x in enumerate(told)])
    now = tables.store(now.join(alike.groupBy(*[f"t{i}" for i in range(len(told))]).agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi"))
    sides = now.join(same.select(F.col("rep").alias("id"), "n", *_SHORT, "sized"), "id")
    per = sides.groupBy("sig", "component").agg(F.count("*").alias("count"), F.min(F.size("sized")).alias("words"))
    per = per.groupBy("sig").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.min("words").alias("words"))
    # Sketches first, so that both sides of the join by signature read one shuffle; all of one signature are folded to one length.
    halved = F.expr("zip_with(slice(sized, 1, size(sized) DIV 2), slice(sized, size(sized) DIV 2 + 1, size(sized) DIV 2), (p, q) -> p ^ q)")
    sides = sides.join(per, "sig").withColumn("minor", F.col("component") != F.col("main"))
    for _ in range(1 + math.ceil(3 * math.log2(100 / percent))):  # sizes within a band differ by less than (100 / percent)^3 times, and lengths by less than twice that
        sides = sides.withColumn("sized", F.when(F.size("sized") > F.col("words"), halved).otherwise(F.col("sized")))
    x, y = sides.filter("minor").alias("x"), sides.alias("y")
    differ = short[0]
    for s in short[1:]:
        differ = differ + s
    odd = F.expr("aggregate(zip_with(x.sized, y.sized, (p, q) -> bit_count(p ^ q)), 0, (a, b) -> a + coalesce(b, 0))")
    apart = (F.col("x.component") != F.col("y.component")) & (~F.col("y.minor") | (F.col("x.id") < F.col("y.id")))
    across = (x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart & could(F.col("x.n"), F.col("y.n"), differ) & could(F.col("x.n"), F.col("y.n"), odd))
              .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
              .join(tried, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti"))
    found = tables.keep(components(links.union(verify(tables.store(across))), tables))
    return (described.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
            .join(same.select("h1", "h2", F.col("n").alias("n_shingles"), "rep"), ["h1", "h2", "n_shingles"], "left")
            .join(found, F.col("rep") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")))
