"""Exact removal of repeated byte strings, by anchors and a hash-compared suffix sort.

A window, ``WIDTH`` bytes that start at some place of some text, is repeated when the same
bytes start at another place; every byte of a repeated window goes.  To sort all suffixes
of a corpus would move many times its size, so suffixes meet by content first:

1. Equal texts are one text with a number of copies; with two or more, all its windows are
   repeated.
2. Each window picks an anchor: the leftmost of its ``GRAM``-byte strings with the least
   hash.  Equal windows pick equal anchors at equal places, so windows whose anchor occurs
   nowhere else are not repeated.  Runs of windows with one anchor are a row: its hash, and
   the hash of all bytes the run covers.
3. Runs that cover the same bytes around the same anchor settle one another: repeated.
   Where an anchor has differing surroundings, one run of each is cut into packs of a few
   windows, which settle one another in the same way by what all of a pack's windows hold.
   Where packs agree in part, the suffixes that start at their windows are sorted, in
   batches of texts: a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes; equal neighbours are verified
   byte for byte.  Each batch's distinct windows are then counted over all batches.
4. The repeated windows go back to their texts.

No step collects a group: anchors and windows are counted with partial sums before they
move, and joins back to a hot anchor split.  Each step is written down and the files of its
shuffles go when it ends, so the disk holds one step's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import bounded_batches, discard, materialised_alone, whole_text

WIDTH, GRAM = 200, 48
#: Windows sorted at once, and windows of a pack at most.
SORTED, PACK = 60_000, 8
BASE = 0x9E3779B97F4A7C15 | 1
LOW = (1 << 16) - 1

ANCHORS = "text_key binary, place bigint, gram bigint, context bigint"
PACKS = "text_key binary, place bigint, core bigint, whole bigint"
WINDOWS = "text_key binary, at bigint, window bigint, mixed bigint"
REMOVED = "text_key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, by doubling."""
    out = np.ones(n + 1, np.uint64)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more] * np.uint64(pow(BASE, done, 1 << 64))
        done += more
    return out


class Prefixes:
    """Prefix polynomial hashes of some bytes: the hash of any stretch by two look-ups.

    The hash of a stretch is the sum of its bytes' scattered values times falling powers of
    an odd base, modulo 2^64; stored as sums over rising inverse powers, so that all of
    them come from one running sum.
    """

    def __init__(self, data: np.ndarray):
        inverse = pow(BASE, -1, 1 << 64)
        n = len(data)
        self.power = powers(n)
        falling = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            more = min(done, n + 1 - done)
            falling[done : done + more] = falling[:more] * np.uint64(pow(inverse, done, 1 << 64))
            done += more
        values = scattered(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[data]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * falling[:n], dtype=np.uint64)])

    def of(self, begin: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The hash of the stretches, the same for equal bytes wherever they lie."""
        return (self.sums[begin + length] - self.sums[begin]) * self.power[begin]


def suffix_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``width`` bytes, and where a new string begins in it.

    A bottom-up mergesort over all runs at once: a suffix's place in a merged pair of runs
    is its place in its own plus its rank in the other, found by binary search; a comparison
    finds the common extension by binary search over prefix hashes and looks at the next
    byte.  Neighbours that compare as equal are compared byte for byte.
    """
    hashes = Prefixes(data)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), width, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = hashes.of(a, middle) == hashes.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    # The first eight bytes as a number decide most comparisons.
    head = np.zeros(len(data) - min(8, width) + 1, np.uint64)
    for k in range(min(8, width)):
        head = (head << np.uint64(8)) | data[k : len(head) + k]

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        x, y = head[a], head[b]
        less = x < y
        close = np.flatnonzero(x == y)
        if len(close):
            a, b = a[close], b[close]
            common = extension(a, b)
            inside = np.minimum(common, width - 1)
            less[close] = np.where(common >= width, ties[close], data[a + inside] < data[b + inside])
        return less

    order = starts.astype(np.int64)
    n, run = len(order), 1
    place = np.arange(n)
    while run < n:
        own = place // run
        begin = np.minimum((own ^ 1) * run, n)
        end = np.minimum(begin + run, n)
        low, high = begin.copy(), end.copy()
        second = own % 2 == 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            # The other side's element goes first if smaller; on ties the first run's goes first.
            smaller = before(order[middle], order[open_], second[open_])
            low[open_] = np.where(smaller, middle + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], middle)
        merged = np.empty_like(order)
        merged[np.minimum(own & ~1, own) * run + (place - own * run) + (low - begin)] = order
        order = merged
        run *= 2
    new = np.ones(n, bool)
    if n > 1:
        like = np.flatnonzero(hashes.of(order[1:], width) == hashes.of(order[:-1], width))
        for part in np.array_split(like, max(1, len(like) // 20_000)):
            bytes_ = np.arange(width)
            same = (data[order[part + 1][:, None] + bytes_] == data[order[part][:, None] + bytes_]).all(1)
            new[part[same] + 1] = False
    return order, new


def anchors_of(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: first and last start, the anchor's place and hash, the hash of what the run covers."""
    n = len(data) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Prefixes(data)
    grams = scattered(hashes.of(np.arange(len(data) - gram + 1), gram))
    # The leftmost least of each window's grams: by doubling, smaller value first, then the left one.
    reach = width - gram + 1
    best = np.arange(len(grams))
    done = 1
    while done < reach:
        step = min(done, reach - done)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        done += step
    change = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    first, last, anchor = change, np.append(change[1:], n) - 1, best[change]
    context = scattered(hashes.of(first, last - first + width) + (last - first + 1).astype(np.uint64) * np.uint64(BASE))
    # The anchor's place in its run is part of what equal runs have in common.
    context = scattered(context ^ (anchor - first).astype(np.uint64))
    return first, last, anchor, grams[anchor], context


def _anchor_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each run; ``place`` has its first window, its length less one and its anchor's distance from the first."""
    for batch in batches:
        found = [anchors_of(np.frombuffer(t.encode(), np.uint8)) for t in batch["text"]]
        first, last, anchor, gram, context = (np.concatenate([f[k] for f in found]) for k in range(5))
        keys = [key for key, f in zip(batch["text_key"], found) for _ in range(len(f[0]))]
        yield pd.DataFrame({"text_key": keys, "place": first << 32 | (last - first) << 16 | (anchor - first), "gram": gram.view(np.int64), "context": context.view(np.int64)})


def _windows_of(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Each start from ``first`` on, ``more`` further ones."""
    return np.repeat(first - np.cumsum(more + 1) + more + 1, more + 1) + np.arange(int((more + 1).sum()))


def _pack_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each pack of the open runs, up to PACK windows in a row at one distance from their anchor.

    ``place`` has its first window, its length less one and the first's distance from the
    end of a full pack; ``core`` is the hash of the bytes that any window of the pack would
    hold, ``whole`` that of all bytes the pack covers.
    """
    for batch in batches:
        out = []
        for key, text, places in zip(batch["text_key"], batch["text"], batch["places"]):
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = Prefixes(data)
            places = np.sort(places)
            first, more, away = places >> 32, (places >> 16) & LOW, places & LOW
            at, anchor = _windows_of(first, more), np.repeat(first + away, more + 1)
            number = (anchor - at + WIDTH) // PACK
            # Windows of a run stand in order, so a pack's are neighbours.
            change = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (anchor[1:] != anchor[:-1])]))
            count = np.diff(change, append=len(at))
            at, number = at[change], number[change]
            end = anchor[change] - (number * PACK - WIDTH)
            core = scattered(hashes.of(end, WIDTH - PACK + 1) ^ (number.astype(np.uint64) << np.uint64(48)))
            whole = scattered(scattered(hashes.of(at, WIDTH - 1 + count)) ^ ((end - at) << 8 | count).astype(np.uint64))
            out.append(pd.DataFrame({"text_key": [key] * len(at), "place": at << 32 | (count - 1) << 16 | (end - at), "core": core.view(np.int64), "whole": whole.view(np.int64)}))
        if out:
            yield pd.concat(out)


def _sorted_windows(held: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Sort the suffixes at some windows; a row for each, with two numbers that are equal for equal strings.

    ``held`` has a text's key, bytes that its windows cover, the windows' places in the text
    and in those bytes.
    """
    bases = np.cumsum([0, *(len(data) for _, data, _, _ in held)])
    data = np.concatenate([data for _, data, _, _ in held])
    starts = np.concatenate([inside + base for (_, _, _, inside), base in zip(held, bases)])
    order, new = suffix_ranks(data, starts, WIDTH)
    heads = order[new]
    digests = np.array([int.from_bytes(hashlib.blake2b(data[s : s + WIDTH].tobytes(), digest_size=8).digest(), "little") for s in heads.tolist()], np.uint64)
    by_start = np.empty(len(data), np.int64)
    by_start[order] = np.cumsum(new) - 1
    return pd.DataFrame(
        {
            "text_key": [key for key, _, at, _ in held for _ in range(len(at))],
            "at": np.concatenate([at for _, _, at, _ in held]),
            "window": digests[by_start[starts]].view(np.int64),
            "mixed": Prefixes(data).of(starts, WIDTH).view(np.int64),
        }
    )


def _window_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of all texts' open packs, sorted a bounded number at a time; a long text's in several parts."""
    for batch in batches:
        held, size = [], 0
        for key, text, places in zip(batch["text_key"], batch["text"], batch["places"]):
            data = np.frombuffer(text.encode(), np.uint8)
            places = np.sort(places)
            windows = _windows_of(places >> 32, (places >> 16) & LOW)
            for at in np.array_split(windows, -(-len(windows) // SORTED)):
                low = int(at[0])
                # Bytes between windows are left out, so what is held grows with the windows alone.
                step = np.zeros(int(at[-1]) - low + WIDTH + 1, np.int8)
                step[at - low] += 1
                step[at - low + WIDTH] -= 1
                covered = np.cumsum(step[:-1], dtype=np.int64) > 0
                held.append((key, data[low : int(at[-1]) + WIDTH][covered], at, (np.cumsum(covered) - 1)[at - low]))
                size += len(at)
                if size >= SORTED:
                    yield _sorted_windows(held)
                    held, size = [], 0
        if size:
            yield _sorted_windows(held)


def _removed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, copies, places in zip(batch["text_key"], batch["text"], batch["copies"], batch["places"]):
            data = np.frombuffer(text.encode(), np.uint8)
            step = np.zeros(len(data) + 1, np.int64)
            if copies > 1 and len(data) >= WIDTH:
                step[0], step[-1] = 1, -1
            if places is not None:
                np.add.at(step, places >> 32, 1)
                np.add.at(step, (places >> 32) + ((places >> 16) & LOW) + WIDTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = data[~gone].tobytes()
            out.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REMOVED.split(", ")])


def without_repeats(documents: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``with_bytes`` also kept.

    A null text is empty; texts of fewer than WIDTH bytes lose nothing; matches never cross
    texts; a null doc_id stays; repeated rows repeat one another's text, so both lose it
    all; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("text_key", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    anchors = rows.filter(F.octet_length("text") >= WIDTH).select("text_key", "text").mapInPandas(_anchor_rows, ANCHORS)
    anchors = materialised_alone(anchors, "anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    met = anchors.join(grams, "gram").groupBy("text_key", "place", "gram", "context").agg(F.count("*").alias("runs"))
    met = materialised_alone(met, "met")
    discard(anchors)
    contexts = met.groupBy("gram", "context").agg(F.sum("runs").alias("runs"), F.min(F.struct("text_key", "place")).alias("one"))
    contexts = materialised_alone(contexts, "contexts")
    kinds = contexts.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    # One run of each context stands for all that cover the same bytes.
    open_runs = contexts.join(kinds, "gram", "left_semi").groupBy("one.text_key").agg(F.collect_list("one.place").alias("places"))
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    packs = texts.select("text_key", "text").join(open_runs, "text_key").mapInPandas(_pack_rows, PACKS)
    packs = materialised_alone(packs, "packs")
    # As with runs: packs alike settle one another, and windows are compared where packs agree in part.
    cores = packs.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).filter("n > 1")
    near = packs.join(cores.select("core", (F.col("low") == F.col("high")).alias("alike")), "core").select("text_key", "place", "alike")
    near = materialised_alone(near, "near")
    discard(packs)
    open_packs = near.filter("NOT alike").groupBy("text_key").agg(F.collect_list("place").alias("places"))
    windows = texts.select("text_key", "text").join(open_packs, "text_key").mapInPandas(_window_rows, WINDOWS)
    windows = materialised_alone(windows, "windows")
    counted = windows.groupBy("window", "mixed").agg(F.count("*").alias("n")).filter("n > 1").select("window", "mixed")
    single = windows.join(counted, ["window", "mixed"]).select("text_key", F.shiftleft("at", 32).alias("place"))
    settled = met.join(contexts.filter("runs > 1").select("gram", "context"), ["gram", "context"]).select("text_key", "place")
    repeated = settled.unionByName(near.filter("alike").select("text_key", "place")).unionByName(single)
    marked = materialised_alone(repeated.groupBy("text_key").agg(F.collect_list("place").alias("places")), "marked")
    for done in (met, contexts, near, windows):
        discard(done)
    removed = texts.join(marked, "text_key", "left").select("text_key", "text", "copies", "places").mapInPandas(_removed, REMOVED)
    kept = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    return rows.select("doc_id", "text_key").join(removed.select("text_key", *kept), "text_key").select("doc_id", *kept)
