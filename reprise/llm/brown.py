"""LM scoring by a class-based bigram model (Brown et al.), with classes found by exchange clustering.

Counts come from all training documents. The exchange algorithm first moves the most frequent words between seed classes while
that raises the likelihood. Then every word that occurs at least SEEN times, whatever their number, is counted by the seed
classes (or shapes) of its neighbours, in a sparse table, and passes over that table move each to the class that gains most;
the number of classes grows with the number of words. Words seen less often or never have their shape as class; the end of a
text is a class of its own. A text's probability is the product of class transitions and word emissions, both smoothed.

The most frequent words are looked up in each task's own table, whose size is bounded. Any other word of a text gets its count
and class by a join with the table of all words; those words are rare by construction, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.labelled import fold
from reprise.storage import materialize

FOLDS, HELD_OUT = 7, 2
#: Words that seed classes, and the seed classes; words in a task's table, and bytes of such a word on average, at most (12.8 MB in all).
CLUSTERED, CLASSES = 1024, 64
#: Occurrences from which on a word is clustered; passes that move words before the last one; weight of the overall profile in a class's.
SEEN, PASSES, PRIOR = 2, 3, 10.0
TABLE_WORDS, TABLE_BYTES = 200_000, 64
#: Bytes of a word from which on it is never in the table.
LONG_WORD = 4096
SHAPES = 32
#: Smoothing of transitions and of emissions.
ALPHA, DELTA = 0.1, 0.5
#: Bytes of text whose words are held at once, but for longer texts.
_SLICE = 16_000_000
_DIGITS = b"0123456789"


def shape(word: bytes) -> int:
    """One of SHAPES coarse classes: how a word ends, its length, digits, letters beyond ASCII."""
    if word.isalpha():  # ASCII letters
        return 4 * (len(word) >= 8) + 16 * (len(word) > 64)
    last = word[-1:]
    end = 1 if last == b"." else 2 if last == b"," else 0 if last.isalnum() or last >= b"\x80" else 3
    digit = len(word) > 64 or len(word.translate(None, _DIGITS)) < len(word)
    return end + 4 * (len(word) >= 8) + 8 * (not word.isascii()) + 16 * digit


def slices(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """A column of texts in parts of about _SLICE bytes: (from, to, distinct words, codes of all words in order, words of each text).

    Words are those of A-Z in lower case between the characters [\\x20\\x09-\\x0D]; null has none.
    """
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, "right")) - 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, to - at)))
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = pc.index(words, "").as_py()
        if none >= 0:  # ahead of white space at an end, or all of an empty text
            held = codes != none
            n = np.bincount(np.repeat(np.arange(len(n)), n)[held], minlength=len(n))
            codes = codes[held]
            codes = codes - (codes > none).astype(np.int32)
            words = pa.concat_arrays([words.slice(0, none), words.slice(none + 1)])
        yield at, to, words, codes, n
        at = to


def _numbered(words: pa.Array, known: pa.Array, other: Callable[[bytes], int]) -> np.ndarray:
    """The place of each word in ``known``, or what ``other`` gives."""
    out = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    missing = np.flatnonzero(out < 0)
    out[missing] = [other(w) for w in words.take(pa.array(missing)).cast(pa.binary()).to_pylist()]
    return out


def _ended(values: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """Values of texts one behind another, with ``end`` ahead of, between and behind them."""
    out = np.full(len(values) + len(n) + 1, end, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(1, len(n) + 1), n)] = values
    return out


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int, rounds: int = 12) -> np.ndarray:
    """The class of each symbol. pairs: counts of (left, right) symbols; the first ``movable`` symbols may move among ``classes``.

    Words start in turn by rank, and move, most frequent first, to the class that gains most; ties keep the lower class.
    """
    n = len(pairs)
    pairs = pairs.astype(float)
    label = np.r_[np.arange(movable) % classes, classes + np.arange(n - movable)]
    total = classes + n - movable
    member = np.zeros((n, total))
    member[np.arange(n), label] = 1
    right, left = pairs @ member, pairs.T @ member  # by symbol: counts with each class after, before
    grid = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            a, self_ = label[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[a] -= self_
            l[a] -= self_
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= self_
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + l) - _xlogx(cols)).sum(axis=1)
            k = np.arange(classes)
            own = grid[k, k]
            gain += _xlogx(own + r[:classes] + l[:classes] + self_) + _xlogx(own) - _xlogx(own + r[:classes]) - _xlogx(own + l[:classes])
            out, into = grid.sum(axis=1)[:classes], grid.sum(axis=0)[:classes]
            gain -= _xlogx(out + r.sum() + self_) - _xlogx(out) + _xlogx(into + l.sum() + self_) - _xlogx(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += self_
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return label


@dataclass
class Model:
    words: bytes  # the table's words, joined by one space, most frequent first
    counts: np.ndarray
    label: np.ndarray  # class of each symbol: the table's clustered words, shapes, end
    clustered: int
    transition: np.ndarray  # log10 by (class before, class)
    spread: np.ndarray  # by class: what its counts are divided by, log10
    total: int
    distinct: int
    vocabulary: DataFrame  # (word, c, cls) of all training words
    coded: DataFrame  # all rows of the documents, their words replaced by classes


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs``; summed in each task first. Ends of texts aren't in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, codes, _ in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, most: int = TABLE_WORDS) -> pd.DataFrame:
    """The most frequent words, in order: ``most`` of them, or fewer where they would take more than most * TABLE_BYTES bytes.

    The histogram of a fine scale of counts (at most 1024 rows) says where to cut, so no task and no driver sorts more than the last step's words
    that still fit. Words of over LONG_WORD bytes are left out.
    """
    short = vocabulary.where(F.octet_length("word") <= LONG_WORD).withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    held, size, cut = 0, 0, 1 << 30
    last = None
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("size")).collect(), key=lambda r: -r["step"]):
        if held + r["n"] > most or size + r["size"] > most * TABLE_BYTES:
            # of the step that doesn't fit, as many as there's room for at its mean length
            last = r["step"], int(min(most - held, (most * TABLE_BYTES - size) * r["n"] // max(1, r["size"])))
            break
        held, size, cut = held + r["n"], size + r["size"], r["step"]
    found = short.where(F.col("step") >= cut)
    if last and last[1] > 0:
        found = found.unionByName(short.where(F.col("step") == last[0]).orderBy(F.desc("c"), "word").limit(last[1]))
    return found.select(*vocabulary.columns).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def count_pairs(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of neighbouring symbols over all rows; each text begins and ends with the end symbol. At most (words + SHAPES + 1)**2 rows reach the driver."""
    n = len(words) + SHAPES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = _strings(words), len(words)
        grid = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, _, own, codes, sizes in slices(batch.column(0)):
                s = _ended(_numbered(own, known, lambda w: other + shape(w))[codes].astype(np.int64), sizes, n - 1)
                grid += np.bincount(s[:-1] * n + s[1:], minlength=n * n)
        at = np.nonzero(grid)[0]
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(at[k : k + 100_000]), "c": pa.array(grid[at[k : k + 100_000]])})

    found = docs.select("text").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    grid = np.zeros(n * n, np.int64)
    grid[found["pair"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return grid.reshape(n, n)


def count_neighbours(docs: DataFrame, words: list[bytes], label: np.ndarray) -> DataFrame:
    """(word, c, near) of every word of ``docs``; near: int64 of (kind << 40) + count, by the kind of the word before (0 to X - 1) and after (X on).

    ``words`` have their ``label`` as kind, other words their shape's, the end its own; X kinds in all.
    """
    own, kinds = len(words), int(label.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _strings(words)
        for batch in batches:
            for _, _, names, codes, sizes in slices(batch.column(0)):
                kind = np.r_[label[-1], label[_numbered(names, seeds, lambda w: own + shape(w))]].astype(np.int32)
                s = _ended(codes + np.int32(1), sizes, 0)
                k, at = kind[s], np.flatnonzero(s)
                key = np.empty(2 * len(at), np.int64)
                for part, side, shift in ((key[: len(at)], at - 1, 0), (key[len(at) :], at + 1, kinds)):
                    np.multiply(s[at], 2 * kinds, out=part, dtype=np.int64)
                    part += k[side] + shift
                key.sort()
                heads = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
                n, key = np.diff(np.r_[heads, len(key)]), key[heads]
                starts = np.r_[np.searchsorted(key, np.arange(1, len(names) + 1) * 2 * kinds), len(key)]
                near = ((key % (2 * kinds)) << 40) + n
                rows = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(near.astype(np.int64))])
                yield pa.RecordBatch.from_arrays([names, rows], ["word", "near"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(names, parts):
            first = [i for i, w in enumerate(names) if not i or names[i - 1] != w]
            word = np.zeros(len(names), np.int64)
            word[first[1:]] = 1
            word = np.repeat(np.cumsum(word), [len(p) // 8 for p in parts])
            flat = np.frombuffer(b"".join(parts), np.int64)
            key = word * 2 * kinds + (flat >> 40)
            order = np.argsort(key, kind="stable")  # runs in order, one a part
            key = key[order]
            heads = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            n, key = np.add.reduceat(flat[order] & ((1 << 40) - 1), heads), key[heads]
            starts = np.r_[np.searchsorted(key, np.arange(len(first)) * 2 * kinds), len(key)]
            k = key % (2 * kinds)
            c = np.add.reduceat(np.where(k < kinds, n, 0), starts[:-1])  # one word before each
            rows = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer((k << 40) + n)])
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in first], pa.string()), pa.array(c), rows], ["word", "c", "near"])

        names, parts = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            parts += batch.column(1).to_pylist()
            cut = len(names)
            while cut and names[cut - 1] == names[-1]:  # more of the last word may follow
                cut -= 1
            if cut:
                yield out(names[:cut], parts[:cut])
                names, parts = names[cut:], parts[cut:]
        if names:
            yield out(names, parts)

    rows = docs.select("text").mapInArrow(run, "word string, near binary")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(merged, "word string, c long, near binary")


def _dense(near: list[bytes], width: int) -> np.ndarray:
    """One row a word: its counts by kind of neighbour."""
    flat = np.frombuffer(b"".join(near), np.int64)
    out = np.zeros((len(near), width), np.float32)
    out[_rows(near), flat >> 40] = flat & ((1 << 40) - 1)
    return out


def _rows(near: list[bytes]) -> np.ndarray:
    """The word that each count belongs to."""
    return np.repeat(np.arange(len(near)), [len(x) // 8 for x in near])


def _summed(near: list[bytes], cls: np.ndarray, classes: int, width: int) -> np.ndarray:
    """Counts by class and kind of neighbour, one behind another; from what there is, not from all kinds of each word."""
    flat = np.frombuffer(b"".join(near), np.int64)
    return np.bincount(cls[_rows(near)] * width + (flat >> 40), flat & ((1 << 40) - 1), classes * width)


def _fit_of(profiles: np.ndarray) -> np.ndarray:
    """What an occurrence next to each kind adds to a word's likelihood in each class: log (class's count by kind / class's count), smoothed."""
    every = profiles.sum(axis=0) + 1e-3
    size = profiles.sum(axis=1, keepdims=True)
    return np.log((profiles + PRIOR * every / every.sum()) / (size + PRIOR)).astype(np.float32).T


def assign(counted: DataFrame, words: list[bytes], label: np.ndarray, seeds: int) -> tuple[DataFrame, int]:
    """((word, c, cls), number of classes): each word seen SEEN times or more in one of the classes, any other in its shape's, after them.

    The seed classes and the most frequent words, as classes of their own, begin; there are as many classes as ``seeds`` times the
    fourth root of how often as many words as the seeds' are clustered. Kinds of neighbours are fixed, so each pass raises the likelihood.
    """
    width = 2 * (int(label.max()) + 1)
    often = counted.where(F.col("c") >= SEEN)
    n = often.count()
    classes = min(max(n, 1), round(seeds * max(1.0, n / max(1, len(words))) ** 0.25)) if n > len(words) else seeds
    first = often.orderBy(F.desc("c"), "word").limit(max(len(words), classes - seeds)).collect()
    profiles = np.zeros((classes, width))
    if first:
        rows, at = _dense([r["near"] for r in first], width), {w: k for w, k in zip(words, label, strict=False)}
        for r, x in zip(first, rows, strict=True):
            if r["word"].encode() in at:
                profiles[at[r["word"].encode()]] += x
        profiles[seeds:] = rows[: classes - seeds]

    def best(near: list[bytes], fit_: np.ndarray) -> np.ndarray:
        return (_dense(near, width) @ fit_).argmax(axis=1)

    for _ in range(PASSES):
        fit_ = _fit_of(profiles)

        def run(batches: Iterator[pa.RecordBatch], fit_=fit_) -> Iterator[pa.RecordBatch]:
            grid = np.zeros(classes * width)
            for batch in batches:
                near = batch.column(0).to_pylist()
                grid += _summed(near, best(near, fit_), classes, width)
            at = np.nonzero(grid)[0]
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(grid[at])})

        found = often.select("near").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        profiles = np.zeros(classes * width)
        profiles[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        profiles = profiles.reshape(classes, width)
    last = _fit_of(profiles)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cls = np.array([classes + shape(w.encode()) if k < SEEN else 0 for w, k in zip(names, c, strict=True)], np.int32)
            at = np.nonzero(c >= SEEN)[0]
            if len(at):
                cls[at] = best(batch.column(2).take(pa.array(at)).to_pylist(), last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls)], ["word", "c", "cls"])

    return materialize(counted.mapInArrow(name, "word string, c long, cls int"), "classes"), classes


def code(docs: DataFrame, vocabulary: DataFrame, top: pd.DataFrame, ends: int, classes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, base and emit (sums over its words and end), cls (int32, a class for each word)."""
    words, counts, of_word = b" ".join(w.encode() for w in top["word"]), top["c"].to_numpy(np.int64), top["cls"].to_numpy(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = _strings(words.split())
        c = np.r_[counts, ends].astype(float)
        base, emit = np.log10(c + 1), np.log10(c + DELTA)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, to, own, codes, n in slices(batch.column("text")):
                at = _numbered(own, known, lambda w: -1 - shape(w))
                kind = np.where(at < 0, at, of_word[np.maximum(at, 0)] if len(of_word) else at).astype(np.int32)[codes]
                at, text = at[codes], np.repeat(np.arange(len(n)), n)
                found = at >= 0
                missing = np.flatnonzero(~found)
                sums = [np.bincount(text[found], values[at[found]], len(n)) + values[-1] for values in (base, emit)]
                rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text[missing], minlength=len(n)))], pa.int32()), own.take(pa.array(codes[missing])))
                cls = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.r_[0, np.cumsum(n)] * 4).astype(np.int32)), pa.py_buffer(kind)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(begin, to - begin), "held_out": batch.column("held_out").slice(begin, to - begin), "uid": pa.array(np.arange(uid, uid + len(n))),
                    "n_tokens": pa.array(n + 1), "n_known": pa.array(np.bincount(text[found], minlength=len(n)) + (ends > 0)), "base": pa.array(sums[0]), "emit": pa.array(sums[1]), "cls": cls, "rare": rare,
                })
                uid += len(n)

    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The joined words' classes in place of their shapes'."""
        for batch in batches:
            made = []
            for own, fix in zip(batch.column("cls").to_pylist(), batch.column("fix").to_pylist(), strict=True):
                cls = np.frombuffer(own, np.int32).copy()
                missing = np.nonzero(cls < 0)[0]
                cls[missing] = classes - 1 - cls[missing]
                if fix:
                    f = np.array(fix, np.int64)
                    cls[missing[f >> 32]] = f & 0xFFFFFFFF
                made.append(cls.tobytes())
            kept = [c for c in batch.schema.names if c not in ("cls", "fix")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, "cls"])

    schema = "doc_id long, held_out boolean, uid long, n_tokens long, n_known long, base double, emit double, cls binary, rare array<string>"
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    local = materialize(rows.mapInArrow(run, schema), "local")
    rare = local.select("uid", F.posexplode("rare").alias("j", "word")).join(vocabulary, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    place = F.when(F.col("cls") < classes, F.shiftleft(F.col("j").cast("long"), 32) + F.col("cls"))
    more = rare.groupBy("uid").agg(
        F.sum(F.log10(F.col("c") + 1)).alias("more_base"), F.sum(F.log10(F.col("c") + DELTA)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.collect_list(place).alias("fix")
    )
    zero = F.lit(0.0)
    both = local.drop("rare").join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more_base", zero)).alias("base"),
        (F.col("emit") + F.coalesce("more", zero)).alias("emit"), "cls", "fix",
    )
    return materialize(both.mapInArrow(patch, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, cls binary"), "coded")


def count_classes(coded: DataFrame, n: int) -> np.ndarray:
    """Counts of neighbouring classes over all rows; each text begins and ends with the last class. At most n**2 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, end = np.zeros(n * n, np.int64), np.array([n - 1], np.int32).tobytes()
        for batch in batches:
            s = np.frombuffer(end + b"".join(x + end for x in batch.column(0).to_pylist()), np.int32).astype(np.int64)
            grid += np.bincount(s[:-1] * n + s[1:], minlength=n * n)
        at = np.nonzero(grid)[0]
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "c": pa.array(grid[at])})

    found = coded.select("cls").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    grid = np.zeros(n * n, np.int64)
    grid[found["pair"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    return grid.reshape(n, n)


def fit(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, int]:
    """The model of all rows of ``docs`` whose id isn't held out; ``clustered`` words seed at least ``classes`` classes. With the number of texts."""
    training = docs.where(fold("doc_id", FOLDS) != HELD_OUT).select("text")
    ends = training.count()
    words = [r["word"].encode() for r in count_words(training).orderBy(F.desc("c"), "word").limit(clustered).collect()]
    seeds = min(classes, max(1, len(words)))
    label = exchange(count_pairs(training, words), len(words), seeds)
    vocabulary, classes = assign(materialize(count_neighbours(training, words, label), "neighbours"), words, label, seeds)
    sums = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0) + ends, int(sums["v"]) + (ends > 0)
    top = frequent(vocabulary)
    own, k = int((top["c"] >= SEEN).sum()), classes + SHAPES + 1
    coded = code(docs, vocabulary, top, ends, classes)
    counts = count_classes(coded.where("not held_out"), k)
    transition = np.log10((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * k))
    kinds = np.zeros(k)  # distinct words by class
    kinds[-1] = 1
    for r in vocabulary.groupBy("cls").agg(F.count("*").alias("v")).collect():
        kinds[r["cls"]] = r["v"]
    spread = np.log10(counts.sum(axis=0) + DELTA * (kinds + 1))
    label = np.r_[top["cls"].to_numpy(np.int64)[:own], classes + np.arange(SHAPES + 1)]
    return Model(b" ".join(w.encode() for w in top["word"]), top["c"].to_numpy(np.int64), label, own, transition, spread, total, distinct, vocabulary, coded), ends


def score(fitted: tuple[Model, int]) -> DataFrame:
    """Per row that the model has coded: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    model, _ = fitted
    transition, spread = model.transition, model.spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([len(spread) - 1], np.int32)
        for batch in batches:
            steps = []
            for own in batch.column("cls").to_pylist():
                cls = np.r_[last, np.frombuffer(own, np.int32), last]
                steps.append(transition[cls[:-1], cls[1:]].sum() - spread[cls[1:]].sum())
            kept = [c for c in batch.schema.names if c != "cls"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(steps, pa.float64())], [*kept, "steps"])

    rows = model.coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, steps double")
    score_ = F.col("steps") + F.col("emit")
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))).alias("base_score"),
        score_.alias("score"), F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"),
    )


def score_texts(docs: DataFrame) -> DataFrame:
    """Fit on all documents that aren't held out (crc32 of the id as text, modulo 7, is 2) and score every row of ``docs`` (doc_id, text).

    A null text is an empty one: it has its end alone. A null id isn't held out; repeated rows count and score as often as
    they occur; without training text every count is zero; an empty table gives no rows.
    """
    return score(fit(docs))
