"""Text that was read with a wrong character encoding (problem 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherloom.operators.order import running_total
from featherloom.session import materialize

#: Encodings of one byte a character that a text may have been read with, or written in. Each also reads the bytes it
#: leaves open, and each reads C1 controls, as control characters, as lenient readers do.
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1254", "iso8859_15", "iso8859_2", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
#: Further encodings that UTF-8 may have been read with: of one byte, and of one or two bytes a character.
READ_AS = (*SINGLE, "cp1253", "cp1257")
DOUBLE = ("gbk", "cp932", "big5", "cp949")
#: A stretch of characters beyond ASCII; no encoding here changes ASCII.
STRETCH = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
#: The byte order mark, general punctuation, euro and trade mark, symbols, variation selectors and emoji. What their UTF-8 bytes
#: look like in another reading is no clean text, so one of them tells a wrong reading even where the corpus never has it.
#: Other characters of three bytes don't: a clean "é »" with its hard blank is one of them, and "уже" is by cp866.
TELLING = re.compile("[\ufeff\u2000-\u206f\u20ac\u2122\u2600-\u27bf\ufe00-\ufe0f\U0001f000-\U0001faff]")


def _table(encoding: str) -> dict[str, int]:
    found = {}
    for byte in range(0x80, 0x100):
        try:
            found[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            pass
    for byte in range(0x80, 0xA0):
        found.setdefault(chr(byte), byte)
    return found


BYTES = {e: _table(e) for e in READ_AS}
CHARS = {e: {b: c for c, b in reversed(BYTES[e].items())} for e in SINGLE}
#: What two-byte readings show: ideographs, kana and half-width forms.
EASTERN = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")


def undo_utf8(stretch: str, read_as: str) -> tuple[str, list[str]]:
    """The stretch with every valid UTF-8 sequence among its bytes as the character it stands for, and these characters.

    A two-byte reading is undone where all bytes of the stretch are UTF-8, as it makes one character of the ends of two.
    """
    if read_as in DOUBLE:
        if not EASTERN.search(stretch):
            return stretch, []
        try:
            now = stretch.encode(read_as).decode("utf-8")
        except UnicodeError:
            return stretch, []
        return now, [c for c in now if not c.isascii()]
    table = BYTES[read_as]
    raw = [table.get(c, -1) for c in stretch]
    out, k, found = [], 0, []
    while k < len(raw):
        lead = raw[k]
        size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        rest = raw[k + 1 : k + size]
        if size and len(rest) == size - 1 and all(0x80 <= b < 0xC0 for b in rest):
            try:
                out.append(bytes(raw[k : k + size]).decode("utf-8"))
                found.append(out[-1])
                k += size
                continue
            except UnicodeDecodeError:
                pass
        out.append(stretch[k])
        k += 1
    return "".join(out), found


class Chars:
    """How often the corpus has each character, garbled or not: one number for each of the characters there are."""

    def __init__(self, counts: np.ndarray, unusual: float = 1e-3):
        """Usual characters are the most frequent ones beyond ASCII that make up all but the part ``unusual`` of those."""
        self.counts = counts
        by_count = np.sort(counts[128:])[::-1]
        upto = np.cumsum(by_count)
        self.usual = max(1, int(by_count[min(int(np.searchsorted(upto, (1 - unusual) * upto[-1])), len(upto) - 1)]))
        self.suspect = lru_cache(maxsize=200_000)(self._suspect)

    def _suspect(self, stretch: str) -> bool:
        """Whether some inverse reading finds UTF-8 in the stretch: a usual character, a telling one, or three and more sequences.

        (Neighbours of other scripts also make up UTF-8 sequences, but of characters that hardly any text has.)
        """
        if LOST in stretch:
            return True
        n = self.counts
        for encoding in (*(READ_AS if len(stretch) > 1 else ()), *DOUBLE):
            now = stretch
            for _ in range(3):  # a text may have been misread more than once
                now, found = undo_utf8(now, encoding)
                if not found:
                    break
                if len(found) >= 3 and encoding not in DOUBLE or TELLING.search(now):
                    return True
                if encoding in DOUBLE:
                    if all(n[ord(c)] >= max(self.usual, *(n[ord(x)] for x in stretch)) for c in found):
                        return True
                elif any(n[ord(c)] >= self.usual for c in found):
                    return True
        return False


def packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of code points without those that are 0: what is sent to the tasks."""
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def unpacked(sent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(0x110000, np.int64)
    out[sent[0]] = sent[1]
    return out


def char_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each code point: at most one row for each that there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0x110000, np.int64)
        for batch in batches:
            points = np.frombuffer("".join(filter(None, batch.column(0).to_pylist())).encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.bincount(points)
            counts[: len(found)] += found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], names=["char", "n"])

    table = texts.mapInArrow(run, "char long, n long").groupBy("char").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(0x110000, np.int64)
    counts[table["char"].to_numpy()] = table["n"].to_numpy()
    return counts


def _count_pairs(sent):
    """Counts of neighbouring characters, numbered as left << 21 | right, without pairs that touch a suspect stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspect = Chars(unpacked(sent.value)).suspect
        plain = np.zeros(1 << 14, np.int64)  # both of ASCII
        others: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in others]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in others]))
            return codes, counts

        def out(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        def clean(match: re.Match) -> str:
            return "\0" if suspect(match[0]) else match[0]

        for batch in batches:
            texts = [STRETCH.sub(clean, t) for t in batch.column(0).to_pylist() if t]
            points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            left, right = points[:-1], points[1:]
            whole = (left > 0) & (right > 0)
            ascii_pair = (left | right) < 128
            plain += np.bincount((left << 7 | right)[whole & ascii_pair], minlength=1 << 14)
            others.append(np.unique((left << 21 | right)[whole & ~ascii_pair], return_counts=True))
            held += len(others[-1][0])
            if held > 2_000_000:
                others[:] = [merged()]
                held = len(others[0][0])
                if held > 1_000_000:
                    yield out(*others.pop())
                    held = 0
        if others:
            yield out(*merged())
        seen = np.flatnonzero(plain)
        yield out(seen >> 7 << 21 | seen & 127, plain[seen])

    return run


def weights(codes: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    """The share of each pair in the corpus's mutual information, 0 at least. What is seen once or twice says nothing and weighs nothing."""
    some = counts >= 3
    n, sides = counts[some].astype(float), (left[codes[some] >> 21], right[codes[some] & 0x1FFFFF])
    out = np.zeros(len(codes))
    out[some] = np.maximum(0.0, n / total * np.log2(n / sides[0] * (total / sides[1])))
    return out


@dataclass(frozen=True)
class Sums:
    """What is known of all pairs together: how often each code point is the left and the right one of a pair, the number of pairs, and the weight under which a pair is improbable.

    That weight is measured: the pairs beyond ASCII of smaller weights make up a given part of all such pairs, at any size and in any scripts. Pairs that weigh nothing are always improbable.
    """

    left: np.ndarray
    right: np.ndarray
    total: int
    least: float

    def __reduce__(self):
        return _sums, (packed(self.left), packed(self.right), self.total, self.least)


def _sums(left: tuple, right: tuple, total: int, least: float) -> Sums:
    return Sums(unpacked(left), unpacked(right), total, least)


def corpus_sums(pairs: DataFrame, doubted: float = 0.115) -> Sums:
    """Sums of (code, n). At most one number a code point, twice, reaches the driver."""

    def side(number: str) -> np.ndarray:
        table = pairs.groupBy(F.expr(number).alias("char")).agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(0x110000, np.int64)
        out[table["char"].to_numpy()] = table["n"].to_numpy()
        return out

    left, right = side("shiftright(code, 21)"), side("code & 2097151L")
    total = max(1, int(left.sum()))
    sent = pairs.sparkSession.sparkContext.broadcast((packed(left), packed(right)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [unpacked(x) for x in sent.value]
        for batch in batches:
            codes, counts = (batch.column(k).to_numpy() for k in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights(codes, counts, *sides, total))], names=["code", "n", "weight"])

    beyond = pairs.select("code", "n").filter("shiftright(code, 21) >= 128 OR code & 2097151L >= 128").mapInArrow(weigh, "code long, n long, weight double")
    placed = running_total(beyond, ["weight", "code"], "n")
    n, lightest = placed.agg(F.sum("n"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    cut = placed.filter(F.col("before") + F.col("n") >= F.lit(doubted * (n or 0))).agg(F.min("weight")).first()[0]
    return Sums(left, right, total, max(cut or 0.0, lightest or 1e-4))


class PairModel:
    """What the corpus says of two neighbouring characters.

    A pair's weight is its share of the corpus's mutual information, p(ab) log2(p(ab) / p(a)p(b)): high for pairs that are
    both frequent and bound to each other, low for rare ones and for those that meet by chance. (The logarithm alone would not
    do: a letter that always stands for another is bound to the neighbours of that other just as firmly.)
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, sums: Sums):
        """codes and counts are those of all pairs that are asked for; a pair that isn't there counts as never seen."""
        order = np.argsort(codes)
        self.codes, self.counts, self.sums, self.total, self.least = codes[order], counts[order], sums, sums.total, sums.least
        self.n: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.utf8: dict[tuple[str, str, str], str | None] = {}
        self.single: dict[tuple[str, str, str], list[tuple[tuple[str, str], float, str]]] = {}

    def count(self, pair: str) -> int:
        found = self.n.get(pair)
        if found is None:
            code = ord(pair[0]) << 21 | ord(pair[1])
            at = int(np.searchsorted(self.codes, code))
            if len(self.n) >= 300_000:
                self.n.clear()
            found = self.n[pair] = int(self.counts[at]) if at < len(self.codes) and self.codes[at] == code else 0
        return found

    def improbable(self, pair: str) -> float:
        """How far the pair's weight lies under the measured one, in bits; pairs of ASCII characters, which no encoding changes, count against a run."""
        if pair.isascii():
            return -1.0
        found = self.scores.get(pair)
        if found is None:
            code = np.array([ord(pair[0]) << 21 | ord(pair[1])], np.int64)
            weight = float(weights(code, np.array([self.count(pair)], np.int64), self.sums.left, self.sums.right, self.total)[0])
            if len(self.scores) >= 300_000:
                self.scores.clear()
            found = self.scores[pair] = max(-8.0, min(8.0, math.log2(self.least / max(weight, 1e-12))))
        return found

    def bits(self, text: str) -> float:
        """The surprise of the pairs of a text."""
        return sum(math.log2(self.total / (self.count(a + b) + 0.5)) for a, b in zip(text, text[1:]))

    def known(self, text: str, least: int = 3) -> bool:
        left, right = self.sums.left, self.sums.right
        return all(left[ord(c)] + right[ord(c)] >= least for c in text)


def runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """All maximal scoring segments of improbable pairs as (start, end) of characters, in linear time.

    Of the segments open so far, one that starts lower and ends lower than the new one is joined with it and all between; where
    none starts lower, the open ones are final. Pairs of ASCII characters, which all score -1, are taken together.
    """
    done: list[tuple[int, int]] = []
    opened: list[tuple[int, int, float, float]] = []
    total, at, last = 0.0, 0, len(text) - 2
    improbable = model.improbable
    for match in STRETCH.finditer(text):
        for k in range(max(match.start() - 1, 0), min(match.end() - 1, last) + 1):
            total -= k - at
            at = k + 1
            score = improbable(text[k : k + 2])
            if score <= 0:
                total += score
                continue
            start, end, low, high = k, k + 2, total, total + score
            total = high
            while True:
                j = len(opened) - 1
                while j >= 0 and opened[j][2] >= low:
                    j -= 1
                if j < 0:
                    done += [x[:2] for x in opened]
                    opened = [(start, end, low, high)]
                    break
                if opened[j][3] >= high:
                    opened.append((start, end, low, high))
                    break
                start, low = opened[j][0], opened[j][2]
                del opened[j:]
    return done + [x[:2] for x in opened]


def _within(text: str, model: PairModel) -> list[tuple[int, int]]:
    """The stretches beyond ASCII that an improbable run touches."""
    if len(text) == 1 and not text.isascii():
        return [(0, 1)]
    inside = runs(text, model)
    found, k = [], 0
    for match in STRETCH.finditer(text) if inside else ():
        while k < len(inside) and inside[k][1] <= match.start():
            k += 1
        if k < len(inside) and inside[k][0] < match.end():
            found.append(match.span())
    return found


def _kept(memo: dict, key: tuple, make, most: int = 100_000):
    """Stretches come again and again between the same characters; short ones are looked at once."""
    found = memo.get(key, memo)
    if found is memo:
        found = make(*key)
        if len(key[1]) <= 32:
            if len(memo) >= most:
                memo.clear()
            memo[key] = found
    return found


def _best_utf8(before: str, stretch: str, after: str, model: PairModel, depth: int = 3, gain: float = 2.0) -> str | None:
    """The stretch as it was before one to ``depth`` wrong readings of UTF-8.

    That is the reading that is more probable by ``gain`` bits a pair and consists of characters that the corpus knows; where none is,
    the shortest that has a telling character among known ones, and then one of three or more such sequences.
    """
    best, least = None, model.bits(before + stretch + after) / (len(before + stretch + after) - 1 or 1) - gain
    told = many = None
    for encoding in (*READ_AS, *DOUBLE):
        now = stretch
        for _ in range(depth):
            now, found = undo_utf8(now, encoding)
            if not found:
                break
            if encoding in DOUBLE and not (TELLING.search(now) or len(found) > 2 or before.isalnum() or after.isalnum()):
                continue  # an ideograph by itself may well be meant
            cost = model.bits(before + now + after) / (len(before + now + after) - 1 or 1)
            if cost < least and model.known(now):
                best, least = now, cost
            elif TELLING.search("".join(found)) and model.known(TELLING.sub("", now)):
                told = now if told is None or len(now) < len(told) else told
            elif many is None and len(found) >= 3 and not model.known(now) and encoding not in DOUBLE:
                many = now
    return next((x for x in (best, told, many) if x is not None), None)


def reread(stretch: str) -> Iterator[tuple[tuple[str, str], str]]:
    """((read as, written in), stretch) of each two encodings of one byte a character."""
    for wrong in SINGLE:
        table = BYTES[wrong]
        for right in SINGLE:
            chars = CHARS[right]
            yield (wrong, right), "".join(chars.get(table[c], c) if c in table else c for c in stretch)


def _codes_of(texts: set[str]) -> frozenset[int]:
    return frozenset(ord(a) << 21 | ord(b) for t in texts for a, b in zip(t, t[1:]))


@lru_cache(maxsize=100_000)
def _reading_codes(before: str, stretch: str, after: str, depth: int = 3) -> frozenset[int]:
    """The numbers of all pairs that any reading of a stretch has."""
    readings = {stretch, *(now for _, now in reread(stretch))}
    for encoding in (*READ_AS, *DOUBLE):
        now = stretch
        for _ in range(depth):
            now, found = undo_utf8(now, encoding)
            if not found:
                break
            readings.add(now)
    return _codes_of({before + r + after for r in readings})


def _rereadings(before: str, stretch: str, after: str, model: PairModel) -> list[tuple[tuple[str, str], float, str]]:
    """((read as, written in), bits gained, stretch) of each other reading that gains any."""
    found, now_bits = [], model.bits(before + stretch + after)
    for pair, now in reread(stretch):
        if now != stretch and model.known(now) and (more := now_bits - model.bits(before + now + after)) > 0:
            found.append((pair, more, now))
    return found


def restore(text: str, model: PairModel, chars: Chars, enough: float = 10.0, clear: float = 4.0) -> tuple[str, int, int]:
    """(text as it was before wrong readings, stretches restored, characters lost).

    Only stretches in improbable runs are looked at. A stretch is first read back as UTF-8, each by itself; what is left
    is read back from one encoding of one byte a character to another, the same for the whole text: of all pairs of
    encodings the one that makes its stretches most probable, if that gains ``enough`` bits in all, of stretches that gain
    more than ``clear`` each; then all that gain anything are read back.
    """
    lost = text.count(LOST)
    if text.isascii():
        return text, 0, 0
    spans = _within(text, model)
    out, at, fixed = [], 0, 0
    left: list[tuple[int, int]] = []  # what is left, by places in out
    size = 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for start, end in spans:
        put(text[at:start])
        stretch, at = text[start:end], end
        now = None
        if chars.suspect(stretch):
            now = _kept(model.utf8, (text[start - 1 : start], stretch, text[end : end + 1]), lambda *key: _best_utf8(*key, model))
        if now is not None:
            fixed += 1
            put(now)
        else:
            left.append((size, size + len(stretch)))
            put(stretch)
    put(text[at:])
    text = "".join(out)
    gains: dict[tuple[str, str], float] = {}
    changes: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
    for start, end in left:
        key = text[max(0, start - 1) : start], text[start:end], text[end : end + 1]
        for pair, more, now in _kept(model.single, key, lambda *key: _rereadings(*key, model)):
            if more > clear:
                gains[pair] = gains.get(pair, 0.0) + more
            changes.setdefault(pair, []).append((start, end, now))
    best = max(gains, key=gains.get, default=None)
    if best is None or gains[best] < enough:
        return text, fixed, lost
    for start, end, now in reversed(changes[best]):
        text = text[:start] + now + text[end:]
        fixed += 1
    return text, fixed, lost


_OUT = pa.schema([("id", pa.int64()), ("restored", pa.string()), ("stretches", pa.int64()), ("lost", pa.int64())])


def _judged(ids: list, texts: list, model: PairModel, chars: Chars) -> list[pa.Array]:
    out: list[list] = [[], [], [], []]
    for row, text in zip(ids, texts):
        now, fixed, lost = restore(text, model, chars)
        if fixed or lost:
            for column, value in zip(out, (row, now, fixed, lost)):
                column.append(value)
    return [pa.array(x, f.type) for x, f in zip(out, _OUT)]


def _restore(sent, sent_sums, sent_chars):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chars = PairModel(*sent.value, sent_sums.value), Chars(unpacked(sent_chars.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_judged(batch.column(0).to_pylist(), batch.column(1).to_pylist(), model, chars), schema=_OUT)

    return run


def _needed(readings: bool):
    """(code, chunk) of the pairs beyond ASCII of the texts of a chunk, with ``readings`` also of those that any reading of their stretches has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set[int]] = {}
            for text, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(chunk, set())
                for m in STRETCH.finditer(text):
                    key = text[max(0, m.start() - 1) : m.start()], m[0], text[m.end() : m.end() + 1]
                    own |= _reading_codes(*key) if readings else _codes_of({"".join(key)})
            codes = [c for own in found.values() for c in own]
            chunks = [k for k, own in found.items() for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(chunks, pa.int64())], names=["code", "chunk"])

    return run


def _in_chunks(rows: DataFrame, pairs: DataFrame, sent_sums, sent_chars, chunk_rows: int) -> DataFrame:
    """garbled without the table of all pairs in any task: each chunk of texts gets the counts of the pairs that it asks for, by a join.

    First those of its own pairs, which tell the texts with improbable runs; then, of these alone, those of all readings.
    """
    docs = materialize(rows.withColumn("chunk", F.floor(F.monotonically_increasing_id() / chunk_rows).cast("long")))

    def with_counts(docs: DataFrame, readings: bool):
        wanted = docs.select("text", "chunk").mapInArrow(_needed(readings), "code long, chunk long").distinct()
        return docs.groupBy("chunk").cogroup(wanted.join(pairs, "code").select("chunk", "code", "n").groupBy("chunk"))

    def model_of(table: pa.Table) -> PairModel:
        return PairModel(table["code"].to_numpy(), table["n"].to_numpy(), sent_sums.value)

    def touched(texts: pa.Table, table: pa.Table) -> pa.Table:
        model = model_of(table)
        return texts.filter(pa.array([LOST in t or bool(_within(t, model)) for t in texts["text"].to_pylist()], pa.bool_()))

    def judged(texts: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(_judged(texts["id"].to_pylist(), texts["text"].to_pylist(), model_of(table), Chars(unpacked(sent_chars.value))), schema=_OUT)

    some = materialize(with_counts(docs, False).applyInArrow(touched, "id long, text string, chunk long"))
    return with_counts(some, True).applyInArrow(judged, "id long, restored string, stretches long, lost long")


def pair_table(texts: DataFrame, sent_chars=None) -> DataFrame:
    """(code, n) of all pairs of neighbouring characters, however many."""
    sent_chars = sent_chars or texts.sparkSession.sparkContext.broadcast(packed(char_counts(texts)))
    return materialize(texts.mapInArrow(_count_pairs(sent_chars), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))


def garbled(df: DataFrame, id_col: str, text: str, table_pairs: int = 4_000_000, chunk_rows: int = 2_000) -> DataFrame:
    """(id, restored, stretches, lost) of each text that has a stretch of wrongly decoded characters.

    The characters of all texts are counted, then neighbouring ones, without stretches that some inverse reading finds UTF-8 in (see Chars), so that
    garbled text doesn't vouch for itself. Each text's improbable runs are isolated and inverse readings tested inside
    them (see PairModel, runs and restore). restored has what could be read back, stretches says how many were; lost
    counts replacement characters, whose originals are gone and which stay as they are.

    Every task gets three numbers for each code point that the texts have (27 MB if they have all) and the counts of up to table_pairs pairs, 16 bytes each. Of more pairs, no task gets
    all: texts in chunks are joined with the counts that they ask for, which gives the same rows. Null and empty texts have no rows; rows of
    equal ids are judged each by itself. In the usual way texts are whole in one task and nothing but counts is shuffled.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    send = df.sparkSession.sparkContext.broadcast
    sent_chars = send(packed(char_counts(rows.select("text"))))
    pairs = pair_table(rows.select("text"), sent_chars)
    sent_sums = send(corpus_sums(pairs))
    # ASCII reads the same in all encodings here
    beyond = rows.filter(F.octet_length("text") != F.length("text"))
    if pairs.count() > table_pairs:
        return _in_chunks(beyond, pairs, sent_sums, sent_chars, chunk_rows)
    table = pairs.toArrow()  # at most table_pairs rows
    sent = send((table["code"].to_numpy(), table["n"].to_numpy()))
    return beyond.mapInArrow(_restore(sent, sent_sums, sent_chars), "id long, restored string, stretches long, lost long")
