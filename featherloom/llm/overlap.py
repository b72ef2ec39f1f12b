"""Same or nearly same records across splits (problem 2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherloom.llm.texts import WORD, Codes, fields
from featherloom.session import materialize

#: First words by which a suffix is entered; texts of up to SHORT + 1 words are also, or only, entered by single words.
RUN, SHORT = 3, 12
#: Two steps change at most so many runs (two swaps: four each), so many words, so many fields of a form.
BROKEN_RUNS, BROKEN_WORDS, BROKEN_FIELDS = 8, 2, 2
#: Forms of so many distinct fields or more are entered by threes of fields, those of up to FEW + 1 by words.
FEW = 5


def canonical(text: str, form: bool) -> str:
    """The lower-cased words with blanks between; of a form, its fields that have a word, sorted, a line each."""
    if not form:
        return " ".join(WORD.findall(text.lower()))
    return "\n".join(sorted(filter(None, (" ".join(WORD.findall(f)) for f in fields(text.lower())))))


def within_steps(a: list[str], b: list[str], steps: int) -> bool:
    """Whether a becomes b by at most so many steps, each replacing, adding or dropping one word or swapping two neighbours."""
    if abs(len(a) - len(b)) > steps:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b) <= steps
    if not steps:
        return False
    if max(len(a), len(b)) == 1:
        return True
    rest = steps - 1
    return (
        within_steps(a[1:], b[1:], rest)
        or within_steps(a[1:], b, rest)
        or within_steps(a, b[1:], rest)
        or (len(a) > 1 and within_steps([a[1], a[0], *a[2:]], b, rest))
        or (len(b) > 1 and within_steps(a, [b[1], b[0], *b[2:]], rest))
    )


def _least_steps(a: list[str], b: list[str], most: int) -> int:
    return next((k for k in range(most + 1) if within_steps(a, b, k)), most + 1)


def near(x: str, y: str, form: bool, steps: int = 2) -> bool:
    """Whether two canonical texts are within so many steps; fields of forms are matched in any order."""
    if not form:
        return within_steps(x.split(" "), y.split(" "), steps)
    both = Counter(x.split("\n")), Counter(y.split("\n"))
    left, right = ([f.split(" ") for f in (both[k] - both[1 - k]).elements()] for k in (0, 1))
    if max(len(left), len(right)) > steps:  # every field that has no equal takes a step
        return False
    left += [[]] * (len(right) - len(left))
    right += [[]] * (len(left) - len(right))
    if len(left) <= 1:
        return all(within_steps(a, b, steps) for a, b in zip(left, right))

    def cost(left: list[list[str]], right: list[list[str]], open_steps: int) -> bool:
        if not left:
            return True
        return any((used := _least_steps(left[0], b, open_steps)) <= open_steps and cost(left[1:], right[:k] + right[k + 1 :], open_steps - used) for k, b in enumerate(right))

    return cost(left, right, steps)


_RECORDS = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("form", pa.bool_()), ("words", pa.string())])


def _read(form_source: str, train: str, held: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _RECORDS]
            for row, text, split, source in zip(*(batch.column(k).to_pylist() for k in range(4))):
                split = split.strip().lower() if split else ""
                if not text or (split != train and split not in held):
                    continue
                form = source == form_source
                if plain := canonical(text, form):
                    for column, value in zip(out, (row, split != train, form, plain)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _RECORDS)], schema=_RECORDS)

    return run


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_FORM_WORD, _FIELD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def starts(forms: list[bool], texts: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the start, entry it belongs to, place) of every start of the texts; entry 4 r + kind is of text r, place is -1 but for kind 0.

    Kinds: 0 runs of three words of a text, 1 words of a short text, 2 fields of a form, 3 words of a form of few distinct fields.
    """
    numbers: list[np.ndarray] = [np.zeros(0, np.uint64)]
    owners: list[np.ndarray] = [np.zeros(0, np.int64)]
    places: list[np.ndarray] = [np.zeros(0, np.int64)]

    def flat(of: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for _, w in of], np.int64)
        ids = np.fromiter((codes[w] for _, ws in of for w in ws), np.uint64, int(sizes.sum()))
        return ids, np.repeat(np.array([r for r, _ in of], np.int64), sizes), np.repeat(sizes, sizes)

    def add(found: np.ndarray, of: np.ndarray, at: np.ndarray | None = None) -> None:
        numbers.append(found)
        owners.append(of)
        places.append(np.full(len(found), -1, np.int64) if at is None else at)

    ids, owner, size = flat([(r, t.split(" ")) for r, (f, t) in enumerate(zip(forms, texts)) if not f])
    if len(ids) >= RUN:
        runs = sum(ids[k : len(ids) - RUN + 1 + k] * _MIX[k] for k in range(RUN))
        whole = (owner[: len(runs)] == owner[RUN - 1 :]) & (size[: len(runs)] >= SHORT)
        at = np.arange(len(owner)) - np.searchsorted(owner, owner)
        add(runs[whole], 4 * owner[: len(runs)][whole], at[: len(runs)][whole])
    few = size <= SHORT + 1
    add(ids[few] * _MIX[3], 4 * owner[few] + 1)
    split = [(r, t.split("\n")) for r, (f, t) in enumerate(zip(forms, texts)) if f]
    # repeats of a field don't count: two steps take or add at most two distinct fields each way
    kinds = {r: len(set(fs)) for r, fs in split}
    ids, owner, _ = flat([(r, fs) for r, fs in split if kinds[r] >= FEW])
    add(ids * _FIELD, 4 * owner + 2)
    ids, owner, _ = flat([(r, " ".join(fs).split(" ")) for r, fs in split if kinds[r] <= FEW + BROKEN_FIELDS - 1])
    add(ids * _FORM_WORD, 4 * owner + 3)
    return np.concatenate(numbers), np.concatenate(owners), np.concatenate(places)


def signatures(texts: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits, one for each word; number of words) of each text. Two steps take or add at most two words each way: four bits."""
    split = [t.replace("\n", " ").split(" ") for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter((codes[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    bits = np.uint64(1) << (ids >> np.uint64(59))
    return (np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes) if len(texts) else bits), sizes


#: A mark packs 32 bits of a text's words, its number of words, and the words before and after the start: 10, 11, 11 bits. ANY stands for places that say nothing.
ANY = 2047


def marks(bits: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    after = sizes - places - RUN
    known = (places >= 0) & (sizes < 1023)
    before, after = (np.where(known, x, ANY) for x in (places, after))
    return (bits << np.uint64(32) | np.minimum(sizes, 1023).astype(np.uint64) << np.uint64(22) | before.astype(np.uint64) << np.uint64(11) | after.astype(np.uint64)).view(np.int64)


def may_be_near(x: str, y: str) -> Column:
    """What marks of two texts must fulfil to be within two steps: at most four bits and two words apart, and where the shared start
    stands once in both, the words added or dropped before and after it are two at most. (A start that no step touches keeps its place but for those.)"""
    a, b = F.col(x), F.col(y)
    part = lambda c, shift, mask: F.shiftrightunsigned(c, shift).bitwiseAND(mask)
    apart = lambda shift, mask: F.abs(part(a, shift, mask) - part(b, shift, mask))
    unknown = (part(a, 11, ANY) == ANY) | (part(b, 11, ANY) == ANY)
    return (F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 32)) <= 4) & (apart(22, 1023) <= 2) & (unknown | (apart(11, ANY) + apart(0, ANY) <= 2))


def _count_starts(chunk: int = 50_000, least: int = 3):
    """Counts of starts that come ``least`` times or more within a chunk of wordings: those that are frequent anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, kept, records = Codes(), [], 0

        def out() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept]), return_counts=True)
            many = counts >= least
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many])], names=["start", "n"])

        for batch in batches:
            kept.append(starts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), codes)[0])
            records += batch.num_rows
            if records >= chunk:
                yield out()
                kept, records = [], 0
        yield out()

    return run


def rarest(numbers: np.ndarray, owners: np.ndarray, places: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, owner, place, count) of the starts that are entered; place is -1 of starts that a text has more than once, count 0 of starts that aren't frequent.

    Starts are in one order everywhere: by the count of the frequent ones, then by number. Call a start kept if a step touches none of its words in at least
    one place. Two texts within two steps have the same kept starts, and all but the broken ones of their distinct starts are kept, so the first kept one is among the first
    broken + 1 of either; of fields, the first three kept are among the first broken + 3, and each three of those is one entry.
    """
    at = np.minimum(np.searchsorted(frequent, numbers), max(len(frequent) - 1, 0))
    weight = np.where(frequent[at] == numbers, counts[at], 0) if len(frequent) else np.zeros(len(numbers), np.int64)
    order = np.lexsort((numbers, weight, owners))
    numbers, owners, places, weight = numbers[order], owners[order], places[order], weight[order]
    new = np.ones(len(numbers), bool)
    new[1:] = (numbers[1:] != numbers[:-1]) | (owners[1:] != owners[:-1])
    once = new.copy()
    once[:-1] &= new[1:]
    places = np.where(once, places, -1)
    numbers, owners, places, weight = numbers[new], owners[new], places[new], weight[new]
    rank = np.arange(len(owners)) - np.searchsorted(owners, owners)
    most = np.array([BROKEN_RUNS + 1, BROKEN_WORDS + 1, BROKEN_FIELDS + 3, BROKEN_WORDS + 1])
    first = rank < most[owners % 4]
    numbers, owners, places, weight, rank = numbers[first], owners[first], places[first], weight[first], rank[first]
    fields = owners % 4 == 2
    entries = [(numbers[~fields], owners[~fields], places[~fields], weight[~fields])]
    numbers, owners, weight, rank = numbers[fields], owners[fields], weight[fields], rank[fields]
    lists = [(numbers[rank == k], owners[rank == k], weight[rank == k]) for k in range(BROKEN_FIELDS + 3)]
    for i, j, k in combinations(range(BROKEN_FIELDS + 3), 3):
        # owners that have a k-th field have those before
        of = lists[k][1]
        (x, least), (y, _) = ((lists[m][0][at], lists[m][2][at]) for m in (i, j) for at in (np.searchsorted(lists[m][1], of),))
        three = np.sort(np.stack([x, y, lists[k][0]]), axis=0)
        entries.append(((three * np.array(_MIX[:3])[:, None]).sum(axis=0, dtype=np.uint64), of, np.full(len(of), -1, np.int64), least))
    return tuple(np.concatenate(x) for x in zip(*entries))


_SIZE = np.uint64(0x2545F4914F6CDD1D)


def _enter(sent, spread: int, hot: int):
    """Entries (start, text, mark). A start in ``hot`` wordings or more is entered together with the number of words, with ``spread`` also for those near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        codes = Codes()
        for batch in batches:
            forms, words = (batch.column(k).to_pylist() for k in range(2))
            texts = batch.column(2).to_numpy()
            numbers, owners, places, weight = rarest(*starts(forms, words, codes), frequent, counts)
            of = owners // 4
            bits, sizes = signatures(words, codes)
            marked = marks(bits[of], sizes[of], places)
            big = weight >= hot
            keys = [numbers[~big], *((numbers[big] + (np.minimum(sizes[of[big]], 1023) + d).astype(np.uint64) * _SIZE) for d in range(-spread, spread + 1))]
            rows = np.concatenate([np.flatnonzero(~big), *[np.flatnonzero(big)] * (2 * spread + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(texts[of[rows]]), pa.array(marked[rows])], names=["start", "text", "mark"])

    return run


def _verify(steps: int):
    """The pairs within so many steps whose contents differ; pairs of the same content are found by their contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for form, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                same = sorted(x.replace(" ", "").split("\n")) == sorted(y.replace(" ", "").split("\n"))
                keep.append(not same and near(x, y, form, steps))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


@dataclass(frozen=True)
class Splits:
    """records: (id, held, form, words), a row each; wordings: (form, words, trained, tested, text), each wording once. text is a 64-bit number of the wording."""

    records: DataFrame
    wordings: DataFrame


def read_splits(df: DataFrame, id_col: str, text: str, split: str, source: str, form_source: str = "web_form", train: str = "train", held: tuple[str, ...] = ("test", "validation")) -> Splits:
    columns = [F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"), F.col(f"`{split}`").cast("string"), F.col(f"`{source}`").cast("string")]
    records = materialize(df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).mapInArrow(_read(form_source, train, held), "id long, held boolean, form boolean, words string"))
    wordings = records.groupBy("form", "words").agg(F.max(~F.col("held")).alias("trained"), F.max("held").alias("tested")).withColumn("text", F.xxhash64("words", "form"))
    return Splits(records, materialize(wordings))


def split_overlaps(df: DataFrame, id_col: str, text: str, split: str, source: str, form_source: str = "web_form", train: str = "train", held: tuple[str, ...] = ("test", "validation"), table_starts: int = 200_000, short: bool = False, hot: int = 200) -> DataFrame:
    """(train_id, held_id, same): each pair of a row of the training split and one of a held-out split whose contents are the same, or whose words become equal by at most two steps.

    The distinct wordings make up a sparse suffix array: of each text those suffixes are entered whose first three words are its
    rarest, nine of them, which two texts within two steps always share one of (see rarest; short texts and forms are
    entered by words and fields). The array is partitioned and sorted by these starts, as the sides of a sort-merge join; neighbouring suffixes of both splits under the same start
    are candidates if the bits of their words and the words before and after allow it (see may_be_near). Each candidate's texts are read once more and compared exactly, over their whole length.

    Which starts are rare is counted over all wordings; only the order of starts depends on it, no pair does. At most
    table_starts counts are sent to the tasks: those that make up a table_starts-th of all or more. A start that comes ``hot`` times or more is split by the
    number of words, the held-out side being entered under the five numbers that two steps reach; what is skewed beyond that adaptive execution splits.

    Contents are compared without blanks, case and punctuation, those of form_source by field in any order, and a form is never
    the same as another text. Splits are compared without case and outer blanks; rows of other or null splits, null texts
    and texts without a letter or digit are left out. Texts of one or two words that share none are within two steps all the same; they
    are compared with ``short``, every short wording with every other, in blocks, and left out without it. Longer ones always share a word.
    Pairs are sought between wordings; only the found pairs are given for all rows, as wanted. Rows of equal ids are given once.
    """
    of = read_splits(df, id_col, text, split, source, form_source, train, held)
    records, wordings = of.records, of.wordings
    counts = materialize(wordings.select("form", "words").mapInArrow(_count_starts(), "start long, n long").groupBy("start").agg(F.sum("n").alias("n")))
    least = -(-(counts.agg(F.sum("n")).first()[0] or 0) // table_starts)
    # at most table_starts rows: the counts sum to table_starts x least at most
    frequent = counts.filter(F.col("n") >= least).toPandas()
    starts_of, n = frequent["start"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    order = np.argsort(starts_of)
    sent = df.sparkSession.sparkContext.broadcast((starts_of[order], n[order]))

    def entered(side: str, name: str, spread: int) -> DataFrame:
        rows = wordings.filter(side).select("form", "words", "text").mapInArrow(_enter(sent, spread, hot), "start long, text long, mark long")
        return rows.select("start", F.col("text").alias(name), F.col("mark").alias(f"mark_{name}"))

    x, y = entered("trained", "x", 0), entered("tested", "y", BROKEN_WORDS)
    candidates = x.join(y, "start").filter((F.col("x") != F.col("y")) & may_be_near("mark_x", "mark_y")).select("x", "y")
    if short:
        few = wordings.filter(F.size(F.split("words", "[ \n]")) <= BROKEN_WORDS)
        block = few.filter("trained").select("form", F.col("text").alias("x"), F.pmod("text", F.lit(32)).cast("int").alias("block"))
        every = few.filter("tested").select("form", F.col("text").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("block"))
        candidates = candidates.unionByName(block.join(every, ["form", "block"]).filter("x <> y").select("x", "y"))
    candidates = candidates.distinct()
    first = wordings.filter("trained").select(F.col("text").alias("x"), F.col("form").alias("form_x"), F.col("words").alias("a"))
    second = wordings.filter("tested").select(F.col("text").alias("y"), "form", F.col("words").alias("b"))
    read = candidates.join(second, "y").join(first, "x").filter("form = form_x").select("form", "a", "b")
    # 128 bits of a wording or content stand for it
    wide = lambda c: F.struct(F.xxhash64(c, "form").alias("one"), F.xxhash64("form", c).alias("other"))
    found = materialize(read.mapInArrow(_verify(2), "form boolean, a string, b string").select(wide(F.col("a")).alias("train"), wide(F.col("b")).alias("held")))
    plain = F.translate("words", " ", "")
    content = F.when(F.col("form"), F.array_join(F.sort_array(F.split(plain, "\n")), "\n")).otherwise(plain)
    keyed = records.select("id", "held", wide(F.col("words")).alias("wording"), wide(content).alias("content"))
    trained, tested = keyed.filter("NOT held"), keyed.filter("held")
    near_rows = found.join(trained.select(F.col("wording").alias("train"), F.col("id").alias("train_id")), "train").join(tested.select(F.col("wording").alias("held"), F.col("id").alias("held_id")), "held")
    same_rows = trained.select("content", F.col("id").alias("train_id")).join(tested.select("content", F.col("id").alias("held_id")), "content")
    return same_rows.select("train_id", "held_id", F.lit(True).alias("same")).unionByName(near_rows.select("train_id", "held_id", F.lit(False).alias("same"))).filter("train_id <> held_id")


def _suffixes(least: int):
    """(start, text, place) of every suffix of at least so many words; a suffix ends with its field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, powers = Codes(), np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(least)], np.uint64)
        for batch in batches:
            words = [f.split(" ") for t in batch.column(0).to_pylist() for f in t.split("\n")]
            sizes = np.array([len(w) for w in words], np.int64)
            of = np.repeat(np.arange(batch.num_rows), [t.count("\n") + 1 for t in batch.column(0).to_pylist()])
            ids = np.fromiter((codes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
            unit = np.repeat(np.arange(len(words)), sizes)
            texts = of[unit] if len(unit) else unit
            place = np.arange(len(unit)) - np.searchsorted(texts, texts)
            n = max(0, len(ids) - least + 1)
            numbers = sum((ids[k : n + k] * powers[k] for k in range(least)), np.zeros(n, np.uint64))
            numbers = (numbers ^ (numbers >> np.uint64(29))) * _MIX[1]
            whole = unit[:n] == unit[least - 1 :]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[whole].view(np.int64)), batch.column(1).take(pa.array(texts[:n][whole])), pa.array(place[:n][whole].astype(np.int32))], names=["start", "text", "place"])

    return run


def split_coverage(df: DataFrame, id_col: str, text: str, split: str, source: str, form_source: str = "web_form", train: str = "train", held: tuple[str, ...] = ("test", "validation"), least: int = 8) -> DataFrame:
    """(id, words, covered, longest) of each held-out row: its words, those in spans that a training text has as well, and the longest such span.

    The suffix array of all distinct wordings, partitioned and sorted by the first ``least`` words (by a 64-bit number of them): where a held-out suffix has a
    training neighbour with that prefix in common, its first ``least`` words are a shared span; overlapping and touching spans of a row are merged. Fields of a form are texts of
    their own: no span goes over their ends, and they stand in alphabetical order. Rows of other splits and those without a word have no row here; rows without a span have 0.
    """
    of = read_splits(df, id_col, text, split, source, form_source, train, held)
    suffixes = lambda side: of.wordings.filter(side).select("words", "text").mapInArrow(_suffixes(least), "start long, text long, place int")
    shared = suffixes("tested").join(suffixes("trained").select("start").distinct(), "start", "left_semi")
    # at most one place a word of a text
    places = shared.groupBy("text").agg(F.sort_array(F.collect_list("place")).alias("places"))
    empty = F.struct(F.lit(0).alias("covered"), F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.lit(0).alias("longest"))

    def merge(s: Column, place: Column) -> Column:
        begin = F.when(place <= s["end"], s["begin"]).otherwise(place)
        end = place + least
        return F.struct((s["covered"] + F.when(place <= s["end"], end - s["end"]).otherwise(least)).cast("int").alias("covered"), begin.alias("begin"), end.alias("end"), F.greatest(s["longest"], end - begin).alias("longest"))

    merged = places.select("text", F.aggregate("places", empty, merge).alias("m")).select("text", "m.covered", "m.longest")
    rows = of.records.filter("held").select("id", F.xxhash64("words", "form").alias("text"), F.size(F.split("words", "[ \n]")).alias("words"))
    return rows.join(merged, "text", "left").select("id", "words", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("longest", F.lit(0)).alias("longest"))
