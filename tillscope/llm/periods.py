"""Runs of repeated word sequences, and texts without the repeats.

A run is a stretch of words with smallest period q, at least ``TIMES`` * q and ``LEAST`` words
long, that cannot be extended. Each of its words occurs at least ``TIMES`` times in it (with
period 1, ``LEAST`` times). So a text is cut at every word that occurs less often than that in
the segment it lies in, and segments shorter than ``LEAST`` go. Cutting makes words rarer, so
the segments are cut again until none changes; prose mostly vanishes in two or three rounds,
for all texts of a batch at once. What survives is scanned lag by lag: words that equal those
q places on. A run of period q covers ``TIMES`` multiples of q in a row, so only those places
are looked at, and n log n comparisons serve all lags; stretches around equal ones are extended
with a search of doubling steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, LEAST = 4, 6
SLICE = 2 << 20  # characters of text that are searched together, unless one text has more


def surviving(word: np.ndarray, segment: np.ndarray):
    """Start and end of the segments that are left when rare words have split them.

    ``word``: ids; ``segment``: number of the text that each belongs to, ascending.
    """
    place = np.arange(len(word))
    while len(place):
        # occurrences of each word in its segment
        key = segment.astype(np.int64) << 32 | word[place]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        count = np.diff(np.append(first, len(key)))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(count >= TIMES, count)
        # segments are stretches of frequent words in one old segment
        cut = ~often[1:] | ~often[:-1] | (segment[1:] != segment[:-1]) | (np.diff(place) != 1)
        start = np.flatnonzero(np.concatenate(([True], cut)))
        size = np.diff(np.append(start, len(place)))
        keep = np.repeat(often[start] & (size >= LEAST), size)
        if keep.all() and len(start) == segment[-1] - segment[0] + 1:
            return place[start], place[start] + size
        number = np.repeat(np.arange(len(start)), size)[keep]
        place = place[keep]
        segment = np.cumsum(np.concatenate(([0], np.diff(number) != 0))) if len(place) else number
    return np.empty(0, int), np.empty(0, int)


def _reach(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in direction ``step``, equal the one ``lag`` on."""
    low, size = at, 64
    while True:
        if step > 0:
            end = min(low + size, len(w) - lag)
            same = w[low:end] == w[low + lag:end + lag]
        else:
            end = max(low - size, -1)
            same = w[end + 1:low + 1][::-1] == w[end + 1 + lag:low + 1 + lag][::-1]
        if not same.all():
            return abs(low - at) + int(same.argmin())
        if abs(end - low) < size:
            return abs(end - at)
        low, size = end, size * 2


def scanned(w: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one segment, by lag and start."""
    n, found = len(w), {}
    for q in range(1, n // TIMES + 1):
        # places k q, (k + 1) q, ... that all hold what lies one lag on
        last = n - (TIMES - 1) * q
        at = np.arange(0, last, q)
        for j in range(TIMES - 1):
            at = at[w[at + j * q] == w[at + (j + 1) * q]]
            if not len(at):
                break
        # within such a run the places from k q on, up to a lag, match as well
        step = 1
        while len(at) > 1 and step < q:
            at = at[w[at + step] == w[at + step + q]]
            step *= 2
        done = 0
        for a in at.tolist():
            if a < done:
                continue
            ahead = _reach(w, a, q, 1)
            behind = _reach(w, a - 1, q, -1) if a else 0
            start, length = a - behind, ahead + behind + q
            done = a + ahead
            if length >= max(LEAST, TIMES * q):
                # a multiple of a run's period finds the same stretch again
                found.setdefault((start, length), q)
    return [(start, length, q) for (start, length), q in found.items()]


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, a list of words, by start and period."""
    ids: dict = {}
    size = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64,
                       int(size.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    edge = np.cumsum(size) - size
    start, end = surviving(word, np.repeat(np.arange(len(texts)), size))
    for s, e in zip(start.tolist(), end.tolist()):
        # texts without words share their edge with the next one
        text = int(np.searchsorted(edge, s, side="right")) - 1
        out[text].extend((s - int(edge[text]) + a, length, q)
                         for a, length, q in scanned(word[s:e]))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def with_loops(words: list, number: int) -> list:
    """Words of which the end loops, by a number: the trial edit of the query.

    One in ten numbers: words from a = (number // 10) % n on repeat with a period that fits
    3 to 10 times into what is left.
    """
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def found(docs: DataFrame, text: str = "text", number: Column | None = None) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start and period, and
    ``collapsed``, the kept words joined by one blank.

    ``number``: a column whose value edits the words first, see ``with_loops``; a null one edits
    nothing. Null, empty and wordless texts have no runs and collapse to the empty text. Rows
    stand alone, so repeated rows, keys and ties do not matter; columns of ``docs`` that are
    called ``runs`` or ``collapsed`` are replaced. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    slim = docs.select(*[F.col(f"`{c}`") for c in others],
                       F.col(f"`{text}`").cast("binary").alias("runs"),
                       (F.lit(None) if number is None else number).cast("long").alias("collapsed"))
    kinds = [f.simpleString().split(":", 1)[1] for f in slim.schema.fields]
    place = len(others)

    def run(batches):
        for whole in batches:
            start = size = 0
            lengths = whole.column(place).to_pylist()
            for i, raw in enumerate(lengths):
                size += len(raw or b"")
                if size > SLICE or i == len(lengths) - 1:
                    yield edited(whole.slice(start, i + 1 - start))
                    start, size = i + 1, 0

    def edited(batch):
        texts = [(raw or b"").split() for raw in batch.column(place).to_pylist()]
        texts = [w if h is None else with_loops(w, h)
                 for w, h in zip(texts, batch.column(place + 1).to_pylist())]
        runs = runs_of(texts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                   ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(place)]
            + [pa.array([[dict(zip(("start", "length", "period"), r)) for r in some]
                         for some in runs], kind),
               pa.array([b" ".join(collapsed(w, r)).decode("utf-8", "replace")
                         for w, r in zip(texts, runs)])], names=others + ["runs", "collapsed"])
    schema = ", ".join([f"`{c}` {k}" for c, k in zip(others, kinds)]
                       + ["runs array<struct<start: long, length: long, period: long>>",
                          "collapsed string"])
    return slim.mapInArrow(run, schema)


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of ``found``: key, n_runs, the run of greatest length over period (start, length,
    period, exponent_milli) and checksums of all runs and of the collapsed text."""
    # exact: a / b > c / d as a d > c b; ties by start, then period, which is the arrays' order
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(
        x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(
        F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return df.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
