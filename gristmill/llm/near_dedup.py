"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles.

A document is a weighted set: its shingles of ``k`` words, by how often each occurs. A signature
register holds the shingle whose exponential arrival is first; two documents agree in a register
with a probability that is their probability Jaccard similarity. Bands of registers propose
candidates, and the similarity of each candidate pair is computed exactly from the texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import words
from gristmill.llm.shared import drop_since, fresh_dir, lean, place, settle, small_batches

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5 registers: a pair at 0.8 shares a band but for 7 in 100,000; at 0.3 one pair in 18 does.
BANDS, ROWS = 24, 5
#: Members of one key of which all pairs are compared at once; those of larger groups are compared with a leader first.
FULL = 32


def weighted_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight (its occurrences); a text's shingles by ascending hash."""
    return weighted(*words.word_hashes(column), k)


def weighted(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, per = words.shingles(hashes, counts, k, short=True)
    doc = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((found, doc))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], found[at], np.diff(np.append(at, len(found)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures of n weighted sets: the element that arrives first at each register.

    The arrivals of an element are a Poisson process with its weight as rate, drawn from the element's
    hash; each arrival goes to one register. An element stops once its time is past the latest
    of its set's registers: no later arrival can be first. Sets without elements have all zeros.
    """
    best = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(element))
    seed = words.mix(element * np.uint64(0xD1342543DE82EF95))
    done, draw = 0, 1
    while len(element):
        step = (np.arange(done + 1, done + draw + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        u = words.mix(seed[:, None] + step)
        waits = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        arrival = time[:, None] + np.cumsum(waits, axis=1)
        slot = (doc[:, None] * registers + (((words.mix(u) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)).ravel()
        flat = arrival.ravel()
        np.minimum.at(best, slot, flat)
        wins = best[slot] == flat
        owner[slot[wins]] = np.repeat(element, draw)[wins]
        time = arrival[:, -1]
        active, place = np.unique(doc, return_inverse=True)
        latest = best.reshape(n, registers)[active].max(axis=1)
        go_on = time < latest[place]
        doc, element, weight, time, seed = doc[go_on], element[go_on], weight[go_on], time[go_on], seed[go_on]
        done, draw = done + draw, min(2 * draw, max(1, (1 << 20) // max(len(element), 1)))
    return owner.reshape(n, registers)


def aligned(left: tuple, right: tuple):
    """Shingles of pairs of weighted sets (pair, hash, weight), one row for each shingle of a pair, by ascending hash:
    pair, hash, its weight on the left and on the right."""
    row, hashes, weight = (np.concatenate(both) for both in zip(left, right, strict=True))
    own = np.arange(len(row)) < len(left[0])
    order = np.lexsort((hashes, row))
    row, hashes, weight, own = row[order], hashes[order], weight[order], own[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    x, y = (np.add.reduceat(np.where(side, weight, 0), at).astype(float) if len(at) else np.zeros(0) for side in (own, ~own))
    return row[at], hashes[at], x, y


def prob_jaccard(row: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Exact probability Jaccard similarity of each of n pairs of aligned weights; 0 where one side is empty."""
    with np.errstate(divide="ignore"):
        order = np.lexsort((x / y, row))
    row, x, y = row[order], x[order], y[order]
    # For element i the sum over j of max(x_j / x_i, y_j / y_i) is one of x from i on and one of y before i.
    total = np.bincount(row, x, n)
    opens = np.searchsorted(row, np.arange(n))
    before_x, before_y = np.cumsum(x) - x, np.cumsum(y) - y
    base_x, base_y = (np.append(b, 0.0)[opens][row] for b in (before_x, before_y))
    both = (x > 0) & (y > 0)
    r = row[both]
    share = 1 / ((total[r] - (before_x - base_x)[both]) / x[both] + (before_y - base_y)[both] / y[both])
    return np.bincount(r, share, n)


def exact_similarity(x: np.ndarray, y: np.ndarray) -> Fraction:
    """Probability Jaccard similarity of one pair of aligned whole weights, as a rational number."""
    kinds = Counter(zip(x.astype(int).tolist(), y.astype(int).tolist(), strict=True))
    return sum((Fraction(n * a * b, sum(m * max(c * b, d * a) for (c, d), m in kinds.items())) for (a, b), n in kinds.items() if a and b), Fraction(0))


#: Far more than the rounding of a sum of shares of any text.
ROUNDING = 1e-9


def reaches(row: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: np.ndarray, least: float) -> np.ndarray:
    """Whether each pair's exact similarity is at least ``least``, read as the decimal that it prints as.

    Pairs that repeat no shingle are decided on integers, others by their rational similarity where
    the floating-point one is within ``ROUNDING`` of ``least``.
    """
    n = len(similarity)
    p, q = Fraction(str(least)).as_integer_ratio()
    common, union, repeats = (np.bincount(row, w, n).astype(np.int64) for w in ((x > 0) & (y > 0), np.ones(len(row)), (x > 1) | (y > 1)))
    found = np.where(repeats == 0, (q * common >= p * union) & (common > 0), similarity >= least)
    close = np.flatnonzero((repeats > 0) & (np.abs(similarity - least) < ROUNDING))
    if len(close):
        order = np.argsort(row, kind="stable")
        opens, ends = (np.searchsorted(row[order], close, side) for side in ("left", "right"))
        for i, at, end in zip(close, opens, ends, strict=True):
            own = order[at:end]
            found[i] = exact_similarity(x[own], y[own]) >= Fraction(p, q)
    return found


SIGNED = "doc_id long, digest binary, total int, bands array<long>"
SETS = "id long, total int, shingles array<long>, weights array<int>"
#: Bytes of text that are signed at once, and shingles of pairs that are compared at once.
TEXT_BYTES = 1 << 20
PAIR_SHINGLES = 1 << 18


def _sign(k: int, bands: int, rows: int):
    """Digest of each text's sequence of words, number of its shingles and keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", TEXT_BYTES):
                n = part.num_rows
                hashes, counts = words.word_hashes(part.column("text"))
                digests = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split()) if t.is_valid else b"").digest() for t in part.column("text")]
                doc, shingle, weight = weighted(hashes, counts, k)
                signature = prob_minhash(doc, shingle, weight, n, bands * rows).reshape(n, bands, rows)
                keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (n, 1))
                for j in range(rows):
                    keys = words.mix(keys + signature[:, :, j])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(counts > 0, bands, 0))], pa.int32()), pa.array(keys[counts > 0].view(np.int64).ravel()))
                total = np.bincount(doc, weight, n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(total), lists], ["doc_id", "digest", "total", "bands"])

    return sign


def _shingle_sets(k: int):
    """The weighted shingles of each text, by ascending hash."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "text", TEXT_BYTES):
                n = part.num_rows
                doc, shingle, weight = weighted_shingles(part.column("text"), k)
                bounds = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=n))], pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (shingle.view(np.int64), weight.astype(np.int32))]
                lists[1] = pc.if_else(pa.array(np.bincount(doc, weight > 1, n) > 0), lists[1], None)  # null: all are 1
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.bincount(doc, weight, n).astype(np.int32)), *lists], ["id", "total", "shingles", "weights"])

    return sets


COMPARED = "a long, b long, total int, similar boolean"


def _compare(least: float):
    """For each pair whether it is similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.list_value_length(batch.column(f"shingles_{t}")).to_numpy(zero_copy_only=False).astype(np.int64) for t in "ab")
            for part in words.slices(batch, sizes, PAIR_SHINGLES):
                n = part.num_rows
                row, _, x, y = aligned(*(_flat(part, f"_{t}") for t in "ab"))
                similar = reaches(row, x, y, prob_jaccard(row, x, y, n), least)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), part.column("total_b"), pa.array(similar)], ["a", "b", "total", "similar"])

    return compare


def _flat(batch: pa.RecordBatch, end: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted sets of a batch's rows: row, hash, weight."""
    per = pc.list_value_length(batch.column(f"shingles{end}")).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(batch.num_rows), per)
    weight, own = np.ones(len(rows), np.int64), batch.column(f"weights{end}")
    weight[own.is_valid().to_numpy(zero_copy_only=False)[rows]] = own.flatten().to_numpy(zero_copy_only=False)
    return rows, batch.column(f"shingles{end}").flatten().to_numpy(zero_copy_only=False).view(np.uint64), weight


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("shingles")).to_numpy(zero_copy_only=False).astype(np.int64)
        for part in words.slices(batch, sizes, PAIR_SHINGLES):
            rows, key, weight = _flat(part)
            whole = [part.column(c).take(pa.array(rows)) for c in ("id", "total", "component")]
            extra = part.column("total").to_numpy() - np.bincount(rows, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*whole, pa.array(extra[rows].astype(np.int32)), pa.array(key.view(np.int64)), pa.array(weight.astype(np.int32))], ["id", "total", "component", "extra", "key", "weight"])


#: Parts of all shingles, by hash, in which those of a text are counted: the smaller counts of two texts sum to what they can have in common at most.
PARTS = 64


def _prefixes(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """key, id, total, extra, left, own, parts: of each member (id, component) shingles of which two similar members of different components have one in common.

    Two sets are similar only if the smaller ones of their relative weights sum to ``least`` or more over their common shingles. All of these
    come at or after the first of them in any order of all shingles, so that one is where at least ``least`` of either set's weight is left.
    Shingles that only one component has come first in the order (and are no keys), then rare ones, so few members share a key.
    ``left`` is the weight from the key on, ``own`` the weight that no other component has, ``extra`` the weight beyond one of each shingle,
    ``parts`` the number of shingles in each of ``PARTS`` that other components have too.
    """
    p, q = Fraction(str(least)).as_integer_ratio()
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: sets are few bytes, and many times as many as rows
    rows = sets.join(members, "id").repartition(n, "id").mapInArrow(lean(_one_by_one), "id long, total int, component long, extra int, key long, weight int")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_c"), F.max("component").alias("_d")).filter("_c != _d").select("key", "n")
    found = settle(rows.join(shared, "key").select("key", "id", "total", "extra", "weight", "n"))
    part = F.pmod("key", F.lit(PARTS))
    whole = found.groupBy("id").agg(F.sum("weight").alias("_shared"), F.array(*[F.count_if(part == i).cast("int") for i in range(PARTS)]).alias("parts"))
    before = Window.partitionBy("id").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = found.withColumn("_to", F.sum("weight").over(before)).join(whole, "id").withColumn("left", F.col("_shared") - F.col("_to") + F.col("weight"))
    return left.filter(F.col("left") * q >= F.col("total") * p).select("key", "id", "total", "extra", "left", (F.col("total") - F.col("_shared")).alias("own"), "parts")


def _may_reach(least: float) -> Column:
    """Whether members ``x`` and ``y`` of one key can be similar, if it is their first common one.

    Of shares a and b of two sets' weights that lie on their common shingles, the similarity is 1 / (1 / a + 1 / b - 1) at most. The common
    shingles are no more than what is left of either set, or than the smaller counts of each part; their weight is no more than their number and the extra weight.
    """
    p, q = Fraction(str(least)).as_integer_ratio()
    common = F.aggregate(F.zip_with("x.parts", "y.parts", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)
    limit = lambda shared: [F.least(F.col(f"{t}.left"), shared + F.col(f"{t}.extra")) for t in "xy"]
    total = lambda t: F.col(f"{t}.total").cast("long")
    holds = lambda u, v: (total("x") * v + total("y") * u) * p <= u * v * (p + q)
    return holds(*limit(F.least("x.left", "y.left"))) & holds(*limit(common))


def _across(members: DataFrame, least: float, block: int = 256) -> DataFrame:
    """a, b: the pairs of members (see ``_prefixes``, and component) of one key and different components that can be similar, the one of fewer shingles first.

    ``n`` is the number of the key's members, ``main`` its most frequent component, whose members are paired with the others alone.
    Those of a large group are dealt to blocks, each of which meets all members of other components than the main one.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    whole = F.struct("total", "id", "left", "extra", "parts", "component")
    x = members.select("key", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("_block"), whole.alias("x"), (F.col("component") == F.col("main")).alias("_main"))
    y = members.filter("component != main").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), whole.alias("y"))
    first = F.expr("x.total < y.total or x.total = y.total and x.id < y.id")
    pairs = x.join(y, ["key", "_block"]).filter((F.col("_main") | first) & (F.col("x.component") != F.col("y.component")) & _may_reach(least))
    return pairs.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("a"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("b")).distinct()


def _join_hot(big: DataFrame, small: DataFrame, key, many: int) -> DataFrame:
    """``big`` joined with ``small``, which has one row per key and in ``n`` how many rows of ``big`` have it.

    Keys of more than ``many`` rows of big are joined by broadcast, so none of their rows meet in one task; where the others are joined they find
    no partner. With ``many`` a thousandth of all documents there are at most a thousand such keys for each row of big per document. ``n`` is dropped.
    """
    key = [key] if isinstance(key, str) else list(key)
    hot, rest = (small.filter(where).drop("n") for where in (F.col("n") > many, F.col("n") <= many))
    return big.join(F.broadcast(hot), key).unionByName(big.join(rest, key))


def _with_sets(pairs: DataFrame, sets: DataFrame, many: int, fan: int = 64) -> DataFrame:
    """Pairs (a, b) with the weighted sets of both.

    One document may be the a of very many pairs: its pairs are dealt to as many copies of its set as
    there are ``fan`` pairs each, so no task gets them all.
    """
    degree = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("_copies", F.ceil(F.col("n") / fan).cast("int")))
    side = lambda t: [F.col(c).alias(f"{c}_{t}") for c in ("total", "shingles", "weights")]
    left = sets.join(degree.select(F.col("a").alias("id"), "_copies"), "id").select(F.col("id").alias("a"), *side("a"), F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    dealt = _join_hot(pairs, degree, "a", many).withColumn("_copy", F.pmod(F.xxhash64("b"), F.col("_copies")).cast("int")).drop("_copies")
    return dealt.join(sets.select(F.col("id").alias("b"), *side("b")), "b").join(left, ["a", "_copy"]).drop("_copy")


def components(links: DataFrame, many: int = 1000) -> DataFrame:
    """id, component (the smallest id of its component) for every end of the links (a, b).

    Each round takes the smallest label of the neighbours and then the label of the label, until
    no label changes. Labels stay in the cluster; the driver reads one count a round.
    """
    edges = settle(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"))
    labels = settle(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_least"), F.count(F.lit(1)).alias("n")).select("id", F.least("id", "_least").alias("component"), "n"))
    while True:
        near = _join_hot(edges, labels.withColumnRenamed("id", "v"), "v", many).groupBy(F.col("u").alias("id")).agg(F.min("component").alias("_near"))
        low = settle(labels.join(near, "id").select("id", "n", F.col("component").alias("_old"), F.least("component", "_near").alias("_low")))
        jump = low.groupBy("_low").agg(F.count(F.lit(1)).alias("n")).join(low.select(F.col("id").alias("_low"), F.col("_low").alias("_jump")), "_low")
        new = settle(_join_hot(low.withColumnRenamed("n", "_n"), jump, "_low", many).select("id", F.least("_low", "_jump").alias("component"), F.col("_n").alias("n"), (F.least("_low", "_jump") != F.col("_old")).alias("_changed")))
        labels = new.select("id", "component", "n")
        if new.filter("_changed").isEmpty():
            return labels.select("id", "component")


def merge_labels(labels: DataFrame, links: DataFrame, many: int = 1000) -> DataFrame:
    """``labels`` (id, component) after more links (a, b): only the components that these links join are searched again.

    Ends without a label count as components of their own. Links are reduced to pairs of components first,
    so a large component with many new links is one row for each other component.
    """
    half = links.join(labels.select(F.col("id").alias("b"), "component"), "b", "left").select("a", F.coalesce("component", "b").alias("_b")).distinct()
    joined = half.join(labels.select(F.col("id").alias("a"), "component"), "a", "left").select(F.coalesce("component", "a").alias("a"), F.col("_b").alias("b"))
    between = settle(joined.filter("a != b").distinct())
    if between.isEmpty():
        return labels
    merged = components(between, many)
    moved = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return settle(moved.union(merged.join(labels, "id", "left_anti")))


def _leaders(members: DataFrame, many: int, *first: Column) -> DataFrame:
    """a, b: of each key's members (key, id, total), a written table, the leader, that of fewest shingles and then of the smallest id, with all others.

    With ``first`` the leader is the one for which this is least, and of equal ones that of fewest shingles."""
    heads = members.groupBy("key").agg(F.min(F.struct(*first, "total", "id")).alias("_leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = _join_hot(members, settle(heads), "key", many)
    return rows.filter("id != _leader.id").select(F.col("_leader.id").alias("a"), F.col("id").alias("b")).distinct()


def _close(compared: DataFrame, sets: DataFrame, labels: DataFrame, bands: DataFrame, least: float, many: int, rounds: int | None) -> DataFrame:
    """``labels`` after the comparisons of what the leaders (``compared``) leave open; bands: id and its bands."""

    def mixed(rows: DataFrame, key: str) -> DataFrame:
        """Keys with members of different components, and how many members."""
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_c"), F.max("component").alias("_d")).filter("_c != _d").select(key, "n")

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def apart(rows: DataFrame) -> DataFrame:
        """Keys with members of different components, how many members, and the most frequent component."""
        per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_m"))
        return per.groupBy("key").agg(F.sum("_m").alias("n"), F.max(F.struct("_m", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("_of")).filter("_of > 1").drop("_of")

    ends = lambda: (F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high"))
    of = settle(named(compared.select("a", F.col("b").alias("id"))))
    members = settle(_join_hot(of, settle(mixed(of, "a")), "a", many).select("id", "component").distinct())
    keyed = settle(_prefixes(members, sets, least))
    done = compared.select(*ends())
    for last in (False, True)[:rounds and rounds - 1]:
        now = named(keyed)
        groups = settle(apart(now))
        now = settle(now.join(groups, "key"))
        found = _across(now if last else now.filter(F.col("n") <= FULL), least)
        if not last:
            # The centre of near copies has least of its own; that of fewest shingles may be as far from it as any.
            hot = settle(now.filter(F.col("n") > FULL).select("key", "id", "total", (F.col("own") / F.col("total")).alias("_own")))
            found = found.union(_leaders(hot, many, F.col("_own"))).distinct()
        found = found.select("a", "b", *ends()).join(done, ["_low", "_high"], "left_anti").select("a", "b")
        for end in "ab":
            found = found.join(bands.select(F.col("id").alias(end), F.col("bands").alias(f"_{end}")), end)
        found = settle(found.filter(F.arrays_overlap("_a", "_b")).select("a", "b"))
        if not found.isEmpty():
            new = settle(_with_sets(found, sets, many).mapInArrow(lean(_compare(least)), COMPARED))
            labels, done = merge_labels(labels, new.filter("similar").select("a", "b"), many), done.union(found.select(*ends()))
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int | None = None) -> DataFrame:
    """One row per input row: doc_id, copy_id (smallest id with the same words), class_id (smallest id of its class).

    Documents with the same sequence of words are copies (by its SHA-256); one of them, the representative, stands
    for all. Classes are the connected components of the pairs of representatives that share a band and
    whose probability Jaccard similarity is at least ``similarity``.

    A bucket's members are not paired with one another. All are compared with the bucket's leader, the member of fewest shingles (then the
    smallest id). Where a leader leaves members of different components, these are put into groups by their rarest shingles (see ``_prefixes``):
    two of them that are similar and share a band are in one group. The second comparison is of all pairs across components in groups of
    up to ``FULL`` members and of larger groups' members with their centres, which have least of their own, the third of what pairs across
    components these leave. Pairs that a bound shows to be too far apart (see ``_may_reach``) are not compared. So no link between texts that
    share a band is lost. Members that are like one another to nearly the least similarity but not quite, in groups of thousands,
    can take as many comparisons as they have pairs.
    ``rounds`` bounds the number of comparisons for those who can do without some links; None, the default, does not.

    Null and empty texts have no words: they are copies of one another and near to nothing else. A text
    of fewer than ``k`` words has one shingle, of all its words. Rows that share an id are one document; if their texts
    differ, each proposes candidates and the smallest is compared. Null ids stand for no class: such rows get
    the class of their copies that have an id, else null. An empty table gives an empty result;
    other columns are ignored, whatever their names. A very long text is worked on alone, by one task.
    """
    small_batches(docs.sparkSession)
    many = max(docs.count() // 1000, 100)
    rows_in = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = settle(rows_in.mapInArrow(lean(_sign(k, bands, rows)), SIGNED))
    copies = settle(signed.groupBy("digest").agg(F.min("doc_id").alias("copy_id"), F.any_value("total").alias("total"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    begun = place()
    entries = settle(copies.filter(F.col("copy_id").isNotNull()).select(F.explode("bands").alias("key"), F.col("copy_id").alias("id"), "total"))
    pairs = settle(_leaders(entries, many))
    labels = None
    if not pairs.isEmpty():
        ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        texts = rows_in.join(ids, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"))
        sets = settle(texts.mapInArrow(lean(_shingle_sets(k)), SETS))
        new = settle(_with_sets(pairs, sets, many).mapInArrow(lean(_compare(similarity)), COMPARED))
        labels = components(new.filter("similar").select("a", "b"), many)
        if rounds is None or rounds > 1:
            labels = _close(new, sets, labels, copies.select(F.col("copy_id").alias("id"), "bands"), similarity, many, rounds)
        final = fresh_dir(docs.sparkSession, "labels")
        labels.write.mode("overwrite").parquet(final)
        labels = docs.sparkSession.read.parquet(final)
    classes = copies.select("digest", "copy_id", "n")
    drop_since(docs.sparkSession, begun)
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("id", "copy_id"), "copy_id", "left")
    else:
        classes = classes.withColumn("component", F.col("copy_id"))
    classes = classes.select("digest", "copy_id", F.coalesce("component", "copy_id").alias("class_id"), "n")
    return _join_hot(signed.select("doc_id", "digest"), classes, "digest", many).select("doc_id", "copy_id", "class_id")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its class of near duplicates.

    Rows of one id are one document, of which one row stays; empty and null texts are copies of one another, of which
    one stays. Rows without an id belong to no class and stay. An empty table stays empty; other columns are kept as they are,
    whatever their names.
    """
    classes = near_dedup(docs, id_col, text_col, **parameters).filter("doc_id is not null")
    ids = classes.groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("doc_id") == F.col("class_id")).alias("_first"))
    gone = settle(ids.filter("not _first or _n > 1"))  # few as a rule, so the other rows' texts stay where they are
    kept = docs.join(gone.select(id_col), id_col, "left_anti").select(*docs.columns)
    repeated = docs.join(gone.filter("_first").select(id_col), id_col, "left_semi").dropDuplicates([id_col])
    return kept.union(repeated.select(*docs.columns))
