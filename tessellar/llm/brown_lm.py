"""Language-model scores from a Brown class bigram.

P(word | previous word) = WEIGHT * P(class | previous class) * P(word | class) + (1 - WEIGHT) * the base probability of the
word, so that a word whose class was learned from few contexts is not lost on it. The end of a text has a class of its own. All other
words have one of CLASSES classes, which are learned from their neighbours:

* The most frequent words, KNOWN at most, are exchanged: each is moved to the class that raises the likelihood of the class
  bigrams most, in sweeps in which groups of words take turns, until a sweep raises it no more than TOLERANCE of itself. Moves of
  a group that do not raise it together are undone. Where the vocabulary is no larger than KNOWN, these are all words. Rarer ones stand
  together in POOLS by their last two bytes meanwhile, as contexts of the others.
* Each rarer word then gets the class that its own neighbours, counted over all training texts, favour by the same measure. A
  pool's class is left to words that no training text has.

Class transitions are smoothed towards class frequencies, emissions by 0.5. Counts are Spark aggregates over all training
texts. Exchange is seeded by the SEEDS most frequent words and the pools, moved one after another over their own squared table, whose
size the parameters fix; other words begin in the class of their pool. In a round a task holds all neighbours of its words
and picks their classes by the class-by-class table, which is sent to it with the class of each word. Scoring sends the KNOWN
words to the tasks as a dictionary of bounded size; the rest of a text's distinct words are joined with the vocabulary and its
classes, and meet their text again by row.

Training texts are those whose crc32(doc_id as text) mod 5 is not 1 (a null doc_id trains). A-Z are lower-cased, words
are runs of other than the six ASCII blanks, and each text has one end, which also is the context of its first word.
Null text is empty: its end alone. Rows that repeat count each; words that tie in count go by their bytes; very long texts
take time and memory in proportion; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, fold, keep, map_texts, small_batches

KNOWN = 100_000
SEEDS, CLASSES, POOLS, SWEEPS = 500, 64, 256, 5
#: Words take turns in so many groups; a sweep of all groups that raises the likelihood by less than this share of itself is
#: the last.
TURNS, TOLERANCE = 4, 5e-3
#: Stands for a word whose class comes by a join.
ABSENT = 255
#: Units are dealt to so many buckets; neighbours counted at once in a task; units placed at once.
BUCKETS, AT_ONCE, PLACED = 256, 2_000_000, 128
#: Pseudo-counts of a class transition, spread by class frequency; and the share of the classes in a word's probability.
SPREAD, WEIGHT = 4.0, 0.8
#: The end of a text among words; no word is empty.
END = b""


def pool_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % POOLS


def pool() -> Column:
    """The pool of column ``word``."""
    return F.expr(f"cast(crc32(substring(word, -2, 2)) % {POOLS} as int)")


def rows_with_bucket(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(crc_bucket("doc_id", 5), F.lit(0)).alias("bucket"))


def vocabulary(train: DataFrame) -> DataFrame:
    """word (binary, END included), c."""

    def run(cols: dict) -> dict:
        seen: Counter = Counter()
        for x in cols["text"]:
            seen.update(fold(x).split())
        seen[END] = len(cols["text"])
        return {"word": list(seen.keys()), "c": list(seen.values())}

    return map_texts(train.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the least count, on a scale of eighths of a doubling, that no more than ``most`` words reach; by
    count and word. The driver gets some hundred sums and then those words, however many tasks there are."""
    step = F.floor(F.log2("c") * 8).alias("step")
    left, least = most, None
    for r in sorted(words.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        left -= r.n
        if left < 0:
            break
        least = r.step
    if least is None:
        return []
    found = words.where(F.floor(F.log2("c") * 8) >= least).collect()
    return sorted(((bytes(r.word), r.c) for r in found), key=lambda x: (-x[1], x[0]))


class Numbers(dict):
    """Numbers of the words that a task knows; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


def neighbours(train: DataFrame, units: dict[bytes, int]) -> DataFrame:
    """Counts of neighbouring units: END (0), the clustered words, and the pools. A row has int32 arrays: words (units),
    sizes (entries of each), others (twice the neighbour, and 1 where it comes before the unit), and int64 n. All entries
    of a unit are in one row; END has only those where it comes first."""
    size, most = 1 + len(units) + POOLS, len(units)
    small_batches(train.sparkSession)
    known = train.sparkSession.sparkContext.broadcast(units)
    sent = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("n", pa.binary())])
    packed = pa.schema([(k, pa.binary()) for k in ("words", "sizes", "others", "n")])

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        first, second = pair // size, pair % size
        back = second > 0
        word, other = np.concatenate([first, second[back]]), np.concatenate([2 * second, 2 * first[back] + 1])
        n = np.concatenate([n, n[back]])
        bucket = np.where(word > 0, word, other >> 1) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        codes, n, bucket = (word * (2 * size) + other)[order], n[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        for part in np.array_split(np.flatnonzero(np.diff(ends)), 8):
            if len(part):
                cut = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in part], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), cut(codes), cut(n.astype("<i4"))], schema=sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n = Numbers(known.value), [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                words = fold(x).split()
                at = np.zeros(len(words) + 2, np.int64)
                own = np.fromiter(map(unit.__getitem__, words), np.int64, len(words))
                for k in np.flatnonzero(own < 0):
                    own[k] = most + 1 + pool_of(words[k])
                at[1:-1] = own
                held.append(at[:-1] * size + at[1:])
                n += len(at)
                if n >= AT_ONCE:
                    yield from dealt(held)
                    held, n = [], 0
        if held:
            yield from dealt(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        more = 0
        for batch in batches:
            for c, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new.append((np.frombuffer(c, "<i8"), np.frombuffer(k, "<i4").astype(np.int64)))
                more += len(new[-1][0])
            if more > max(len(codes), AT_ONCE):
                codes, n = summed(np.concatenate([codes, *(x for x, _ in new)]), np.concatenate([n, *(x for _, x in new)]))
                new, more = [], 0
        codes, n = summed(np.concatenate([codes, *(x for x, _ in new)]), np.concatenate([n, *(x for _, x in new)]))
        word, others = codes // (2 * size), (codes % (2 * size)).astype("<i4")
        first = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word)) if len(word) else np.zeros(1, np.int64)
        at = 0
        while at < len(first) - 1:
            stop = max(at + 1, int(np.searchsorted(first, first[at] + 200_000, "right")) - 1)
            part = slice(first[at], first[stop])
            held = (word[first[at:stop]].astype("<i4"), np.diff(first[at : stop + 1]).astype("<i4"), others[part], n[part])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], schema=packed)
            at = stop

    rows = train.select("text").mapInArrow(count, "bucket int, codes binary, n binary")
    return rows.repartition("bucket").mapInArrow(pack, "words binary, sizes binary, others binary, n binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield tuple(np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(row, ("<i4", "<i4", "<i4", "<i8"), strict=True))


def between_groups(pairs: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring groups, of which each unit has one."""
    known = pairs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = np.zeros(size * size), known.value
        for batch in batches:
            for words, sizes, others, n in unpacked(batch):
                ahead = others % 2 == 0
                table += np.bincount((of[np.repeat(words, sizes)] * size + of[others >> 1])[ahead], n[ahead], size * size)
        cells = np.flatnonzero(table)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells].astype(np.int64))], names=["pair", "n"])

    got = pairs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size * size)
    out[[r.pair for r in got]] = [r.n for r in got]
    return out.reshape(size, size)


def x_log(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1e-12))


def likelihood(between: np.ndarray) -> float:
    return float(x_log(between).sum() - x_log(between.sum(1)).sum() - x_log(between.sum(0)).sum())


def best_classes(between: np.ndarray, at: np.ndarray, ahead: np.ndarray, behind: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each of some units, of class ``at`` >= 1, the class >= 1 where it raises the likelihood most while the others
    stay. ahead and behind are its counts by class, without its ``own`` pairs with itself. Only cells that a unit has counts
    in change, so the work grows with the classes beside a unit, not with all pairs of classes."""
    n, size = ahead.shape
    one, to = np.arange(n), np.arange(1, size)
    mine = to == at[:, None]
    gain = np.zeros((n, size - 1))
    inner = np.diag(between)[1:] - mine * (ahead[one, at] + behind[one, at] + own)[:, None]
    for table, more, back in ((between, ahead, behind), (between.T, behind, ahead)):
        unit, j = np.nonzero(more)
        added = more[unit, j][:, None]
        cells = table[1:, j].T - mine[unit] * added  # the unit taken out of its class
        home = j == at[unit]
        cells[home] -= back[unit[home], 1:] + mine[unit[home]] * own[unit[home], None]
        raised = x_log(cells + added) - x_log(cells)
        other = np.flatnonzero(j > 0)
        raised[other, j[other] - 1] = 0  # the cell of a class with itself is counted below
        if len(unit):
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            gain[unit[first]] += np.add.reduceat(raised, first, axis=0)
        mass, whole = table.sum(1)[1:], (more.sum(1) + own)[:, None]
        left = mass - mine * whole
        gain -= x_log(left + whole) - x_log(left)
    gain += x_log(inner + ahead[:, 1:] + behind[:, 1:] + own[:, None]) - x_log(inner)
    best = np.argmax(gain, axis=1)
    return np.where(gain[one, best] > gain[one, at - 1] + 1e-9, 1 + best, at)


def exchange(counts: np.ndarray) -> np.ndarray:
    """Class of each unit of a small table; unit 0, the end, has class 0, the others are moved one after another."""
    owner = np.concatenate([[0], 1 + np.arange(len(counts) - 1) % CLASSES])
    member = np.eye(1 + CLASSES)[owner]
    between = member.T @ counts @ member
    busy = np.flatnonzero(counts.sum(0)[1:] + counts.sum(1)[1:]) + 1
    for _ in range(SWEEPS):
        moved = 0
        for w in busy:
            ahead, behind, own, at = counts[w] @ member, counts[:, w] @ member, counts[w, w], owner[w]
            ahead[at] -= own  # the unit's own pairs go with it
            behind[at] -= own
            best = best_classes(between, owner[w : w + 1], ahead[None], behind[None], np.array([own]))[0]
            if best == at:
                continue
            moved += 1
            for c, sign in ((at, -1), (best, 1)):
                between[c] += sign * ahead
                between[:, c] += sign * behind
                between[c, c] += sign * own
            owner[w] = best
            member[w] = 0
            member[w, best] = 1
        if not moved:
            break
    return owner


def moves(pairs: DataFrame, owner: np.ndarray, between: np.ndarray, turn: int) -> np.ndarray:
    """owner after each unit whose turn it is has chosen by the counts as they are."""
    size = len(between)
    known = pairs.sparkSession.sparkContext.broadcast((owner, between))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, table), out = known.value, []
        for batch in batches:
            for words, sizes, others, n in unpacked(batch):
                ends = np.concatenate([[0], np.cumsum(sizes)])
                mine = np.flatnonzero((words > 0) & ((words // BUCKETS + words) % TURNS == turn))
                for some in np.array_split(mine, -(-len(mine) // PLACED)) if len(mine) else ():
                    entry = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in some])
                    row = np.repeat(np.arange(len(some)), sizes[some])
                    other, times = others[entry], n[entry].astype(float)
                    itself = (other >> 1) == words[some][row]
                    cell = (row * 2 + other % 2) * size + of[other >> 1]
                    sums = np.bincount(cell[~itself], times[~itself], len(some) * 2 * size).reshape(-1, 2, size)
                    own = np.bincount(row[itself & (other % 2 == 0)], times[itself & (other % 2 == 0)], len(some))
                    best = best_classes(table, of[words[some]], sums[:, 0], sums[:, 1], own)
                    out.append((words[some].astype("<i4"), best.astype("<i4")))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*out, strict=True)], names=["words", "classes"])

    new = owner.copy()
    for r in pairs.mapInArrow(run, "words binary, classes binary").collect():  # KNOWN numbers, packed
        new[np.frombuffer(r["words"], "<i4")] = np.frombuffer(r["classes"], "<i4")
    return new


def cluster(pairs: DataFrame, clustered: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and the counts of neighbouring classes."""
    first, size = min(SEEDS, len(clustered)), 1 + CLASSES
    pools = np.array([pool_of(w) for w in clustered[first:]], np.int64)
    group = np.concatenate([np.arange(1 + first), 1 + first + pools, 1 + first + np.arange(POOLS)])
    owner = exchange(between_groups(pairs, group, 1 + first + POOLS))[group]
    between = between_groups(pairs, owner, size)
    while True:
        before = likelihood(between)
        for turn in range(TURNS):
            tried = moves(pairs, owner, between, turn)
            table = between_groups(pairs, tried, size)
            if likelihood(table) > likelihood(between):
                owner, between = tried, table
        if likelihood(between) - before <= TOLERANCE * abs(before):
            return owner, between


#: A context is (class before, class after) as one number; MIXED is added where the word before has no class of its own either.
SIDE, MIXED = 128, 128 * 128


def contexts(train: DataFrame, classes: dict[bytes, int], pools: np.ndarray) -> DataFrame:
    """word, context, n of the words without a class of their own yet. A neighbour that has none either counts with its pool's class."""
    known = train.sparkSession.sparkContext.broadcast((classes, pools))
    schema = pa.schema([("word", pa.binary()), ("context", pa.int32())])
    small_batches(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, spelled = Numbers(known.value[0]), known.value[1]
        for batch in batches:
            held: list[bytes] = []
            found: list[np.ndarray] = []
            for x in batch.column(0).to_pylist():
                words = fold(x).split()
                own = np.zeros(len(words) + 2, np.int64)
                own[1:-1] = np.fromiter(map(of.__getitem__, words), np.int64, len(words))
                rare = np.flatnonzero(own < 0)
                if len(rare):
                    seen = [words[k] for k in (rare - 1).tolist()]
                    mixed = own[rare - 1] < 0
                    own[rare] = spelled[np.fromiter(map(pool_of, seen), np.int64, len(seen))]
                    held += seen
                    found.append(mixed * MIXED + own[rare - 1] * SIDE + own[rare + 1])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(np.concatenate(found).astype(np.int32))], schema=schema)

    return train.select("text").mapInArrow(run, "word binary, context int").groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


def own_classes(found: DataFrame, pools: np.ndarray, between: np.ndarray) -> DataFrame:
    """word, old (its pool's class), class, contexts, n: the class that each word's contexts favour. Words that stand once are
    told by their pool's class and one context, so a task works out each such case once."""
    lists = found.groupBy("word").agg(F.collect_list(F.struct("context", "n")).alias("c")).select("word", "c.context", "c.n")  # of rare words
    schema = pa.schema([("word", pa.binary()), ("old", pa.int32()), ("class", pa.int32()), ("contexts", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])
    size = len(between)

    def best(unit: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = lambda side: np.bincount(unit * size + side, n, len(at) * size).reshape(-1, size)
        return best_classes(between, at, sums(after), sums(before), np.zeros(len(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.zeros((size, size, size), np.int32)  # pool's class, before, after -> class; 0: not worked out yet
        for batch in batches:
            if not batch.num_rows:
                continue
            at = pools[np.fromiter(map(pool_of, batch.column(0).to_pylist()), np.int64, batch.num_rows)]
            place, times = batch.column(1).flatten().to_numpy() % MIXED, batch.column(2).flatten().to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            before, after, unit = place // SIDE, place % SIDE, np.repeat(np.arange(len(at)), sizes)
            out = np.zeros(len(at), np.int32)
            first = np.cumsum(sizes) - sizes
            once = (sizes == 1) & (times[first] == 1)
            cell = (at[once], before[first[once]], after[first[once]])
            new = np.unique(np.stack([x[single[cell] == 0] for x in cell]), axis=1)
            if new.shape[1]:
                k = np.arange(new.shape[1])
                single[tuple(new)] = best(k, new[1], new[2], np.ones(len(k)), new[0])
            out[once] = single[cell]
            rest = np.flatnonzero(~once)
            if len(rest):
                number = np.full(len(at), -1)
                number[rest] = np.arange(len(rest))
                mine = number[unit] >= 0
                out[rest] = best(number[unit[mine]], before[mine], after[mine], times[mine], at[rest])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(out), batch.column(1), batch.column(2)], schema=schema)

    return lists.mapInArrow(run, "word binary, old int, class int, contexts array<int>, n array<long>")


def moved_pairs(rare: DataFrame, size: int) -> np.ndarray:
    """What the counts of neighbouring classes gain and lose as each rare word leaves its pool's class for its own. A pair of
    two of them moves with the first; the second stands in it with its pool's class."""
    each = rare.where("old <> class").select("old", "class", F.explode(F.arrays_zip("contexts", "n")).alias("x")).select("old", "class", "x.contexts", "x.n")
    place = F.col("contexts") % MIXED
    sides = F.array(F.struct(F.lit(True).alias("ahead"), (place % SIDE).alias("j"), F.lit(True).alias("counts")), F.struct(F.lit(False).alias("ahead"), F.floor(place / SIDE).cast("int").alias("j"), (F.col("contexts") < MIXED).alias("counts")))
    ends = F.array(F.struct(F.col("old").alias("c"), (-F.col("n")).alias("d")), F.struct(F.col("class").alias("c"), F.col("n").alias("d")))
    both = each.select(F.explode(sides).alias("s"), ends.alias("e")).where("s.counts").select("s.ahead", "s.j", F.explode("e").alias("e"))
    out = np.zeros((size, size))
    for r in both.groupBy("ahead", "j", F.col("e.c").alias("c")).agg(F.sum("e.d").alias("d")).collect():  # two for each pair of classes at most
        out[(r.c, r.j) if r.ahead else (r.j, r.c)] += r.d
    return out


@dataclass
class Model:
    """What scoring tasks need, of a size set by the parameters."""

    numbers: dict[bytes, int]  # the KNOWN most frequent words
    logs: np.ndarray  # log10 of their smoothed counts
    classes: np.ndarray
    pools: np.ndarray  # classes of words that no training text has, by pool
    cells: np.ndarray  # log10 of what a smoothed count is multiplied by, by the classes of the previous word and of its own
    unit: float  # log10 of the base denominator
    end: tuple[float, int]  # log10 of the smoothed count, known


def fit(train: DataFrame) -> tuple[Model, DataFrame, int]:
    """(model; word, c, class of the words beyond its dictionary; N)."""
    words = keep(vocabulary(train), "lm-vocabulary")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    named = words.where(F.length("word") > 0)
    top = most_frequent(named, KNOWN)
    pairs = keep(neighbours(train, {w: 1 + k for k, (w, _) in enumerate(top)}), "lm-neighbours")
    owner, between = cluster(pairs, [w for w, _ in top])
    size, classes, pools = 1 + CLASSES, owner[1 : 1 + len(top)], owner[1 + len(top) :]
    c = np.array([x for _, x in top], float)
    mass, kinds = np.zeros(size), np.zeros(size)  # tokens and distinct words of each class, with one yet unknown for each pool
    mass[0], kinds[0] = between.sum(0)[0], 1
    np.add.at(mass, classes, c)
    np.add.at(kinds, classes, 1)
    np.add.at(kinds, pools, 1)
    found = contexts(train, {w: int(k) for (w, _), k in zip(top, classes, strict=True)}, pools)
    if v - 1 <= len(top):
        found = found.limit(0)  # the dictionary has all words
    rare = keep(own_classes(found, pools, between), "lm-rare")
    between = between + moved_pairs(rare, size)
    beyond = keep(rare.select("word", "class").join(named, "word"), "lm-beyond")
    for r in beyond.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        mass[r["class"]] += r.c
        kinds[r["class"]] += r.n
    whole = between.sum(0)
    share = (whole + 0.5) / (whole.sum() + 0.5 * size)
    steps = (between + SPREAD * share) / (between.sum(1, keepdims=True) + SPREAD)
    unit = float(np.log10(n + 0.5 * (v + 1)))
    cells = np.log10(WEIGHT * steps / (mass + 0.5 * np.maximum(kinds, 1)) + (1 - WEIGHT) * 10.0**-unit)
    numbers = {w: k for k, (w, _) in enumerate(top)}
    return Model(numbers, np.log10(c + 0.5), classes, pools, cells, unit, (float(np.log10(mass[0] + 0.5)), int(mass[0] > 0))), beyond, n


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    rows = rows_with_bucket(docs)
    model, beyond, n = fit(rows.where("bucket <> 1"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict) -> dict:
        m = sent.value
        number = Numbers(m.numbers)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "logs", "steps", "line", "which", "words")}
        for x in cols["text"]:
            text = fold(x).split()
            at = np.fromiter(map(number.__getitem__, text), np.int64, len(text))
            frequent = at >= 0
            c = np.zeros(len(text) + 2, np.uint8)
            c[1:-1] = ABSENT
            c[1:-1][frequent] = m.classes[at[frequent]]
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(text[k], len(seen)) for k in np.flatnonzero(~frequent).tolist()]
            out["n_tokens"].append(len(text) + 1)
            out["n_known"].append(int(frequent.sum()) + m.end[1])
            out["logs"].append(float(m.logs[at[frequent]].sum()) + m.end[0])
            out["steps"].append(None if seen else float(m.cells[c[:-1], c[1:]].sum()))
            out["line"].append(c.tobytes() if seen else None)
            out["which"].append(np.array(which, "<i4").tobytes())
            out["words"].append(list(seen))
        return {"row": cols["row"], "doc_id": cols["doc_id"], "held_out": [b == 1 for b in cols["bucket"]], **out}

    parts = map_texts(rows.withColumn("row", F.monotonically_increasing_id()), run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, steps double, line binary, which binary, words array<binary>")
    parts = keep(parts, "lm-parts")
    rare = parts.where("line is not null").select("row", F.posexplode("words").alias("at", "word"))
    spelled = F.element_at(F.array(*[F.lit(int(k)) for k in model.pools]), pool() + 1)
    met = rare.join(beyond, "word", "left").select("row", "at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", spelled).alias("class"))
    lists = met.groupBy("row").agg(F.collect_list(F.struct("at", "c", "class")).alias("found"))  # a text's own words
    rest = parts.where("line is not null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "line", "which").join(lists, "row")
    rest = rest.select("doc_id", "held_out", "n_tokens", "n_known", "logs", "line", "which", "found.at", "found.c", "found.class")
    own_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("steps", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch at once: its texts' classes end to end, the places without one filled from the joined words."""
        cells = sent.value.cells
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            lines, whichs = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            c, which = np.frombuffer(b"".join(lines), np.uint8).copy(), np.frombuffer(b"".join(whichs), "<i4").astype(np.int64)
            starts = np.cumsum([0, *map(len, lines)])
            of_place = np.repeat(np.arange(rows), [len(w) // 4 for w in whichs])
            n_words = np.diff(batch.column(7).offsets.to_numpy())
            base = np.cumsum(n_words) - n_words
            slot = np.repeat(base, n_words) + batch.column(7).flatten().to_numpy()
            count, kind = np.zeros(len(slot)), np.zeros(len(slot), np.uint8)
            count[slot], kind[slot] = batch.column(8).flatten().to_numpy(), batch.column(9).flatten().to_numpy()
            word = base[of_place] + which
            c[np.flatnonzero(c == ABSENT)] = kind[word]
            steps = np.append(cells[c[:-1], c[1:]], 0.0)
            steps[starts[1:] - 1] = 0  # from one text to the next
            logs = batch.column(4).to_numpy() + np.bincount(of_place, np.log10(count[word] + 0.5), rows)
            seen = batch.column(3).to_numpy() + np.bincount(of_place, count[word] > 0, rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seen), pa.array(logs), pa.array(np.add.reduceat(steps, starts[:-1]))], schema=own_schema)

    own = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "steps"]
    whole = parts.where("line is null").select(*own).unionByName(rest.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, steps double"))
    base = (F.col("logs") - F.col("n_tokens") * F.lit(model.unit)).alias("base_score")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base, (F.col("logs") + F.col("steps")).alias("score"))
