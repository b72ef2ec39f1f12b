"""Evaluation passages in training text (problem 8)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.llm.texts import WORD, Codes, NumberFilter, shingles
from featherloom.session import materialize

#: Two moduli and bases of the running hash of a tiling.
HASHES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _powers(base: int, mod: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), np.int64)
    done = 1
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * pow(base, done, mod) % mod
        done += more
    return out


class _Running:
    """Karp-Rabin hashes of all stretches of a length, from the running sums of the numbers times the powers of a base."""

    def __init__(self, numbers: np.ndarray, room: int):
        self.size, self.sums = len(numbers), []
        for mod, base in HASHES:
            powers = _powers(base, mod, room)
            sums = np.concatenate([[0], np.cumsum((numbers + 1) * powers[: len(numbers)] % mod)])
            self.sums.append((mod, sums, powers[::-1]))

    def of(self, length: int) -> np.ndarray:
        found = np.zeros(max(0, self.size - length + 1), np.int64)
        for mod, sums, back in self.sums:
            # the power that is still missing brings stretches of all places to the same one
            found = found << 31 | (sums[length:] - sums[: self.size - length + 1]) % mod * back[: self.size - length + 1] % mod
        return found


def _open_starts(is_open: np.ndarray, length: int) -> np.ndarray:
    closed = np.concatenate([[0], np.cumsum(~is_open)])
    return np.flatnonzero(closed[length:] == closed[:-length]) if len(is_open) >= length else np.zeros(0, np.int64)


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, ties by place; no place is in two tiles.

    Each round finds the greatest length at which an open stretch of a equals one of b, by running hashes and bisection (a shared stretch has
    shared shorter ones), and marks all matches of that length, left to right, that don't overlap. Lengths fall from round to round, so there are at
    most sqrt(2 min(len a, len b)) rounds of n log n, whatever repeats the texts have. Every match is compared before it is marked.
    """
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    tiles: list[tuple[int, int, int]] = []
    if min(len(x), len(y)) < least:
        return tiles
    hash_x, hash_y = (_Running(v, max(len(x), len(y))) for v in (x, y))
    open_x, open_y = np.ones(len(x), bool), np.ones(len(y), bool)

    def common(length: int):
        i, j = _open_starts(open_x, length), _open_starts(open_y, length)
        if not len(i) or not len(j):
            return None
        u, v = hash_x.of(length)[i], hash_y.of(length)[j]
        if not (hit := np.isin(u, v)).any():
            return None
        return i[hit], u[hit], j, v

    most = min(len(x), len(y))
    while (found := common(least)) is not None:
        low, high = least, most + 1
        while high - low > 1:
            if (more := common(middle := (low + high) // 2)) is None:
                high = middle
            else:
                low, found = middle, more
        starts, keys, others, other_keys = found
        wanted = np.isin(other_keys, keys)
        places: dict[int, list[int]] = defaultdict(list)
        for j, key in zip(others[wanted][::-1].tolist(), other_keys[wanted][::-1].tolist()):
            places[key].append(j)  # the leftmost last
        end, marked = 0, False
        for i, key in zip(starts.tolist(), keys.tolist()):
            of = places[key]
            if i < end:
                continue
            while of:
                j = of.pop()
                # what this round has marked is as long as the stretch, so it covers one of its ends
                if open_y[j] and open_y[j + low - 1] and np.array_equal(x[i : i + low], y[j : j + low]):
                    open_x[i : i + low] = open_y[j : j + low] = False
                    tiles.append((i, j, low))
                    end, marked = i + low, True
                    break
        most = low - 1
        if not marked and low == least:
            break  # nothing but equal hashes of unlike stretches is left
        if most < least:
            break
    return tiles


def _seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            numbers, of = shingles(list(map(words, batch.column(1).to_pylist())), codes, least)
            pairs = np.unique(np.stack([numbers.view(np.int64), of]), axis=1) if len(of) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), batch.column(0).take(pa.array(pairs[1]))], names=["seed", "item_key"])

    return run


def _hits(sent, least: int):
    """The texts with a seed that passes the filter, and these seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codes = sent.value, Codes()
        for batch in batches:
            numbers, of = shingles(list(map(words, batch.column(1).to_pylist())), codes, least)
            hit = NumberFilter.passing(table, numbers)
            numbers, of = numbers[hit], of[hit]
            rows, first = np.unique(of, return_index=True)
            seeds = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(numbers.view(np.int64)))
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, seeds], names=["doc", "text", "seeds"])

    return run


_OUT = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("longest", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.int64())])


def _tile(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in _OUT]
            for doc, text, item, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                number: dict[str, int] = {}
                b = [number.setdefault(w, len(number)) for w in words(own)]
                a = [number.setdefault(w, len(number)) for w in words(text)]
                if tiles := tile(a, b, least):
                    for column, x in zip(out, (doc, item, max(n for _, _, n in tiles), sum(n for _, _, n in tiles), len(b), len(tiles))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_OUT)

    return run


def leaked_items(docs: DataFrame, doc_col: str, doc_text: str, items: DataFrame, item_col: str, item_text: str, least: int = 12, most_bits: int = 27) -> DataFrame:
    """(doc, item, longest, covered, item_words, tiles) of each document and item that share a stretch of ``least`` words.

    Seeds are the stretches of ``least`` words, as running hashes. Those of the items make up a filter of bounded size (see NumberFilter), which every task gets;
    only the seeds of documents that pass it, and the texts of those documents, go on. They are joined with the seeds of the items by number, so neither
    documents nor items pass through the driver. Each pair of a document and an item is tiled greedily: longest is the longest tile, covered the
    words in tiles, which passages in another order share as well. Words are lower-cased runs of letters and digits; whatever stands between them doesn't count.

    A seed that a third of all documents have is a skewed key of a join of two columns of numbers, which adaptive execution splits; pairs are made distinct before any text moves.
    Null, empty and shorter texts have no rows; rows of equal ids are looked at each by itself; no items, no rows.
    """
    number = F.monotonically_increasing_id()
    own = materialize(items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("item_text")).filter("item_text <> ''").withColumn("item_key", number))
    seeds = materialize(own.select("item_key", "item_text").mapInArrow(_seeds(least), "seed long, item_key long"))
    rows = docs.select(F.col(f"`{doc_col}`").cast("long").alias("doc"), F.col(f"`{doc_text}`").cast("string").alias("text")).filter("text <> ''")
    hit = materialize(rows.mapInArrow(_hits(NumberFilter(seeds, "seed", most_bits).sent, least), "doc long, text string, seeds array<long>").withColumn("doc_key", number))
    pairs = hit.select("doc_key", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds, "seed").select("doc_key", "item_key").distinct()
    both = pairs.join(hit.select("doc_key", "doc", "text"), "doc_key").join(own, "item_key").select("doc", "text", "item", "item_text")
    return both.mapInArrow(_tile(least), "doc long, item long, longest long, covered long, item_words long, tiles long")
