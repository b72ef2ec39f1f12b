"""What the operators share: words, terms, form fields and identifiers by content."""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A maximal run of Unicode letters or digits.
WORD = re.compile(r"[^\W_]+")
#: The same of at least two characters.
TERM = re.compile(r"[^\W_]{2,}")
#: What separates the fields of a form.
FIELD_END = re.compile(r"[;|\n\r]")


def ident(value: str | bytes, size: int = 16) -> bytes:
    """The identifier of a value: a digest, so that every task gives a value the same one without a shared counter."""
    return blake2b(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value, digest_size=size).digest()


def content(text: str) -> str:
    """Lower-cased letters and digits only."""
    return "".join(WORD.findall(text.lower()))


def fields(text: str) -> list[str]:
    """The raw fields of a form."""
    return FIELD_END.split(text)


class Codes(dict):
    """64-bit numbers of words and fields by content; kept while they are few."""

    def __missing__(self, word: str) -> int:
        found = int.from_bytes(ident(word, 8), "little")
        if len(self) < 1_000_000:
            self[word] = found
        return found


def shingles(texts: list[list[str]], codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit number, text) of each run of k words, in the order of the texts: a running hash of the words' codes, mixed."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.fromiter(map(codes.__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)), sizes)
    count = max(0, len(ids) - k + 1)
    numbers = np.zeros(count, np.uint64)
    for j in range(k):
        numbers *= np.uint64(0x9E3779B97F4A7C15)
        numbers += ids[j : count + j]
    numbers ^= numbers >> np.uint64(32)
    numbers *= np.uint64(0xD6E8FEB86659FD93)
    numbers ^= numbers >> np.uint64(32)
    whole = of[:count] == of[k - 1 :] if count else np.zeros(0, bool)
    return numbers[whole], of[:count][whole]


class NumberFilter:
    """Which 64-bit numbers of a column there may be: of each, three bits of one 64-bit word are set.

    At most 2^most_bits bits, whatever the number of numbers; a fuller filter lets more through and loses none. Numbers are to be spread evenly, as hashes are.
    """

    def __init__(self, numbers: DataFrame, column: str, most_bits: int = 27):
        count = numbers.count()
        size = 1 << max(6, min(most_bits, (16 * count).bit_length()) - 6)
        bit = lambda shift: f"shiftleft(1L, CAST(shiftrightunsigned(`{column}`, {shift}) & 63 AS INT))"
        # at most one row a word
        table = numbers.groupBy(F.expr(f"shiftrightunsigned(`{column}`, 20) & {size - 1}L").alias("word")).agg(F.expr(f"bit_or({bit(0)} | {bit(6)} | {bit(12)})").alias("bits")).toArrow()
        found = np.zeros(size, np.int64)
        found[table["word"].to_numpy()] = table["bits"].to_numpy()
        self.sent = numbers.sparkSession.sparkContext.broadcast(found.view(np.uint64))

    @staticmethod
    def passing(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        one, six = np.uint64(1), np.uint64(63)
        bits = one << (numbers & six) | one << (numbers >> np.uint64(6) & six) | one << (numbers >> np.uint64(12) & six)
        return table[(numbers >> np.uint64(20) & np.uint64(len(table) - 1)).astype(np.int64)] & bits == bits
