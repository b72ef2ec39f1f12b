import base64
import collections
import math
import random
import re

import pytest

from featherloom.llm import formats, garbled, leaks, overlap, programs, queries, sampling, terms, tokens
from featherloom.session import table

SQL = queries.oracle_sql()
RANKS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = [None, "", "   ", "...", "a", "Ünïcode ½ ² ͡ x", "word " * 20_000, "\x00퟿😀", "same text here", "same text here"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_queries_without_sql_run(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0


# extra columns whose names the operators use inside
EXTRA = ", term string, record long, key string, start long, bits long, fold int"


def frame(spark, rows, schema):
    n = len(EXTRA.split(",")) - 1
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], schema + EXTRA)


def features(spark, rows):
    return frame(spark, rows, "id long, text string, held string, words string, category int, name string")


def test_operators_on_odd_texts(spark):
    rows = [(i, t, "train" if i % 2 else "test", "web_form" if i % 3 == 0 else "chat", None if i == 4 else 1, None) for i, t in enumerate(ODD)]
    df = features(spark, [*rows, rows[-1], rows[-1]])
    counts = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, "text").collect()}
    assert counts["word"] == (20_000, 1) and counts["same"] == (4, 4) and counts[None] == (0, 11) and "a" not in counts
    assert terms.term_scores(df, "id", "text").filter("term = 'same'").count() == 4
    assert {tuple(r) for r in formats.copies(df, "id", "text", "words", "category").collect()} == set()
    assert {r.copies for r in formats.collapse(df, "id", "text", "words", "category").collect() if r.first_id == 9} == {3}
    assert {(r.train_id, r.held_id) for r in overlap.split_overlaps(df, "id", "text", "held", "words").collect()} == set()
    assert programs.NearPrograms(df, "id", "text").groups().count() > 0
    assert leaks.leaked_items(df, "id", "text", df.limit(0), "id", "text").count() == 0
    assert garbled.garbled(df, "id", "text").count() == 0
    ids = {r.id: r.ids for r in tokens.encode_texts(df, "id", "text", RANKS).collect()}
    assert ids[0] == ids[1] == [] and len(ids[6]) >= 20_000


def test_operators_on_empty_tables(spark):
    df = features(spark, [])
    assert terms.marked_terms(df, "text").count() == 0
    assert terms.leading_terms(terms.term_scores(df, "id", "text", best=2)).count() == 0
    assert formats.copies(df, "id", "text", "words", "category").count() == 0
    assert overlap.split_overlaps(df, "id", "text", "held", "words").count() == 0
    assert programs.NearPrograms(df, "id", "text").row_pairs().count() == 0
    assert leaks.leaked_items(df, "id", "text", df, "id", "text").count() == 0
    assert garbled.garbled(df, "id", "text").count() == 0
    assert tokens.encode_texts(df, "id", "text", RANKS).count() == 0
    targets = spark.createDataFrame([(1, "one", 10_000, 2)], "category int, name string, weight int, least int")
    found = sampling.sample_by_targets(df, targets, "id", "category", "name", "weight", "least")
    assert found.rows.count() == 0 and [(r.quota, r.short) for r in found.report.collect()] == [(0, True)]


def test_terms_of_a_bounded_table_are_the_same(spark, sf_dir):
    df = table(spark, sf_dir, "features")
    whole = {(r.id, r.term, round(r.z, 9)) for r in terms.term_scores(df, "row_id", "query").collect()}
    small = {(r.id, r.term, round(r.z, 9)) for r in terms.term_scores(df, "row_id", "query", table_terms=50).collect()}
    assert whole == small


def test_terms_flush_between_records(spark):
    df = spark.createDataFrame([(f"common w{i} common",) for i in range(50)], "t string")
    counts = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, "t", flush_at=3).collect()}
    assert counts["common"] == (100, 50)


def test_quotas():
    t = [sampling.Target(1, 5000, 2, 100), sampling.Target(2, 3000, 2, 4), sampling.Target(3, 2000, 5, 100), sampling.Target(4, 0, 3, 1)]
    q = sampling.allocate(20, t)
    assert sum(q.values()) == 20 and q[2] == 4 and q[3] >= 5 and q[4] == 1
    assert sampling.allocate(2, t) == {1: 2, 2: 2, 3: 5, 4: 1}  # the floors
    assert sum(sampling.allocate(10_000, t).values()) == 205
    rng = random.Random(1)
    for _ in range(300):
        t = [sampling.Target(k, rng.randrange(100), rng.randrange(4), rng.randrange(30)) for k in range(8)]
        size = rng.randrange(150)
        q = sampling.allocate(size, t)
        low, high = sum(min(x.least, x.available) for x in t), sum(x.available for x in t)
        assert all(min(x.least, x.available) <= q[x.key] <= x.available for x in t)
        assert sum(q.values()) == max(low, min(size, high))


def test_report_says_what_is_missing(spark):
    df = spark.createDataFrame([(i, 1 if i < 20 else 2, None) for i in range(1000)], "id long, category int, name string")
    targets = spark.createDataFrame([(1, "one", 5000, 2), (2, "two", 5000, 1), (3, "three", 0, 4)], "category int, name string, weight int, least int")
    report = {r.category: (r.quota, r.short, r.missing, r.extra) for r in sampling.sample_by_targets(df, targets, "id", "category", "name", "weight", "least").report.collect()}
    assert report == {1: (20, True, 30.0, 0.0), 2: (80, False, 0.0, 30.0), 3: (0, True, 0.0, 0.0)}


def test_sample_takes_the_smallest_keys(spark):
    import hashlib

    df = spark.createDataFrame([(i, 1 if i % 3 else None, "One-" if i % 2 else " o_n e") for i in range(3000)] + [(-1, 7, "x")], "id long, category int, name string")
    targets = spark.createDataFrame([(1, "one", 10_000, 2), (2, "two", 0, 1)], "category int, name string, weight int, least int")
    found = sampling.sample_by_targets(df, targets, "id", "category", "name", "weight", "least", cut_rows=5)
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:300]
    assert {r.id for r in found.rows.collect()} == set(want)
    assert {r.category: r.short for r in found.report.collect()} == {1: False, 2: True}


def test_copies_of_a_hot_group(spark):
    rows = [(i, "Card-Payment!" if i % 3 == 0 else "x; y" if i % 3 == 1 else f"t{i}", "web_form" if i % 3 == 1 else "chat", None) for i in range(6000)]
    rows += [(7000, "Y| |X", "web_form", None), (7001, "x y", "chat", None), (7002, "card payment", "web_form", None)]
    df = spark.createDataFrame(rows, "id long, text string, source string, intent int")
    got = {tuple(r) for r in formats.copies(df, "id", "text", "source", "intent", hot_groups=10).collect()}
    assert got == {(0, i) for i in range(3, 6000, 3)} | {(1, i) for i in range(4, 6000, 3)} | {(1, 7000)}


def test_steps():
    near = overlap.within_steps
    a = "a b c d e".split()
    assert near(a, "a b c d e".split(), 0) and near(a, "b a c e d".split(), 2) and near(a, "a x c y e".split(), 2)
    assert near(a, "c d e".split(), 2) and near(a, "x a b c d e y".split(), 2) and not near(a, "x y z d e".split(), 2)
    assert near("c a".split(), "a b c".split(), 2) and near("a x c".split(), "c a".split(), 2)
    form = lambda t: overlap.canonical(t, True)
    assert overlap.near(form("a: b c|d: e f|g=h"), form("g:h;d=e f;a b x"), True)
    assert not overlap.near(form("a b|c d|e f"), form("a x|c y|e z"), True)


def test_overlaps_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(160):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 11, 12, 13, 14, 20, 35]))]
        form = rng.random() < 0.4
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(copy))
                step = rng.randrange(4)
                if step == 0:
                    copy[k] = rng.choice(words)
                elif step == 1:
                    copy.insert(k, rng.choice(words))
                elif step == 2 and len(copy) > 2:
                    del copy[k]
                elif k + 1 < len(copy):
                    copy[k], copy[k + 1] = copy[k + 1], copy[k]
            if form:
                parts = [" ".join(copy[i : i + 3]) for i in range(0, len(copy), 3)]
                rng.shuffle(parts)
                texts.append(("; ".join(parts), "web_form"))
            else:
                texts.append((", ".join(copy).upper(), "chat"))
    rows = [(i, t, rng.choice(["train", " Train", "test ", "VALIDATION", "other"]), s) for i, (t, s) in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, split string, source string")
    got = {(r.train_id, r.held_id) for r in overlap.split_overlaps(df, "id", "text", "split", "source").collect()}
    want = set()
    for i, x, p, s in rows:
        for j, y, q, u in rows:
            if p.strip().lower() == "train" and q.strip().lower() in ("test", "validation") and s == u:
                a, b = overlap.canonical(x, s == "web_form"), overlap.canonical(y, s == "web_form")
                if a.split() and set(a.split()) & set(b.split()) and overlap.near(a, b, s == "web_form"):
                    want.add((i, j))
    assert got == want and len(want) > 20


def test_overlaps_of_repeated_words_and_fields(spark):
    rng = random.Random(8)
    rows = [(0, "status yes;status yes;status yes;status yes;note no;note no;note no;note no", "train", "web_form"), (1, "status yes;status yes;status yes;status yes;note no;note no;note no;note off", "test", "web_form")]
    for i in range(2, 500):
        form = rng.random() < 0.6
        kinds = [f"{rng.choice('ab')} {rng.choice('cdefgh')}" for _ in range(rng.randrange(1, 7))]
        parts = [rng.choice(kinds) for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 9, 12, 20]))]
        rows.append((i, (";" if form else " ").join(parts), rng.choice(["train", "test"]), "web_form" if form else "chat"))
    df = spark.createDataFrame(rows, "id long, text string, split string, source string")
    want = set()
    plain = {i: overlap.canonical(t, s == "web_form") for i, t, _, s in rows}
    for i, _, p, s in rows:
        for j, _, q, u in rows:
            if p == "train" and q == "test" and s == u and overlap.near(plain[i], plain[j], s == "web_form"):
                want.add((i, j))
    for hot in (2, 200):
        got = {(r.train_id, r.held_id) for r in overlap.split_overlaps(df, "id", "text", "split", "source", short=True, hot=hot).collect()}
        assert {x for x in want - got} == set() and {x for x in got - want} == set()
    assert (0, 1) in want and len(want) > 200


def test_coverage_by_hand(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(0, " ".join(words[:20]), "train", "chat"), (1, " ".join(["x", *words[2:12], "y", *words[11:20], "w2"]), "test", "chat"), (2, "w1 w2", "test", "chat"), (3, None, "test", "chat"), (4, "b; " + " ".join(words[5:13]) + "|a", "validation", "web_form")]
    df = spark.createDataFrame(rows, "id long, text string, split string, source string")
    assert {tuple(r) for r in overlap.split_coverage(df, "id", "text", "split", "source").collect()} == {(1, 22, 19, 10), (2, 2, 0, 0), (4, 10, 8, 8)}
    assert overlap.split_coverage(df.limit(0), "id", "text", "split", "source").count() == 0


def test_short_texts_without_a_common_word(spark, tmp_path):
    rows = [(1, "lost card", "train", "chat"), (2, "Refund?", "test", "chat"), (3, "new pin", "validation", "chat"), (4, "a new pin", "test", "chat"), (5, "x: y", "train", "web_form"), (6, "u: v", "test", "web_form"), (7, "b; c", "test", "web_form")]
    spark.createDataFrame(rows, "row_id long, query string, source_split string, source string").write.parquet(f"{tmp_path}/features.parquet")
    assert {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 3), (5, 6)}


def test_programs_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = [[f"x{rng.randrange(300)} = y{rng.randrange(300)} + {rng.randrange(99)}" for _ in range(30)] for _ in range(15)]
    texts = []
    for lines in base:
        for _ in range(4):
            copy = [line for line in lines if rng.random() > 0.1]
            rng.shuffle(copy) if rng.random() < 0.3 else None
            texts.append("\n".join(copy))
    df = spark.createDataFrame([*enumerate(texts), (1000, texts[0]), (1001, None), (1002, "a b")], "id long, text string")
    near = programs.NearPrograms(df, "id", "text")
    sets = {i: set(programs.runs(t)) for i, t in enumerate([*texts])} | {1000: set(programs.runs(texts[0]))}
    want = {(a, b) for a in sets for b in sets if a < b and programs.share(sets[a], sets[b]) >= 0.6}
    assert {tuple(r) for r in near.row_pairs().collect()} == want and (0, 1000) in want
    group = {r.id: r.group for r in near.groups().collect()}
    assert all(group[a] == group[b] for a, b in want) and set(group) == set(sets)
    assert programs.aligned_share("a\nb\nc", "a\nc") == 0.8


def test_hot_groups(spark):
    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randrange(9_000)}" for _ in range(12)) for _ in range(12)]
    other = lines[:-1] + ["another end of the same program"]
    rows = [(i, "\n".join(lines) if i % 3 == 0 else "\n".join(other[::-1]) if i % 3 == 1 else " ".join(f"x{rng.randrange(9_000)}" for _ in range(60))) for i in range(300)]
    near = programs.NearPrograms(spark.createDataFrame(rows, "id long, text string").repartition(6), "id", "text")
    hot = [i for i in range(300) if i % 3 < 2]
    assert {tuple(r) for r in near.row_pairs().collect()} == {(a, b) for a in hot for b in hot if a < b}
    assert [tuple(r) for r in near.pairs.select("a", "b", "reordered").collect()] == [(0, 1, True)]
    groups = {r.id: (r.group, r.links) for r in near.groups().collect()}
    assert all(groups[i] == (0, 1) for i in hot) and all(groups[i] == (i, 0) for i in range(2, 300, 3))
    item = " ".join(f"v{k}" for k in range(15))
    docs = spark.createDataFrame([(i, f"{i} {item} {i}" if i % 3 == 0 else f"none {i}") for i in range(300)], "doc long, text string").repartition(6)
    items = spark.createDataFrame([(1, item), (2, item + " more")], "item long, text string")
    found = leaks.leaked_items(docs, "doc", "text", items, "item", "text").collect()
    assert sorted((r.doc, r.item) for r in found) == [(i, k) for i in range(0, 300, 3) for k in (1, 2)] and {r.longest for r in found} == {15}
    split = spark.createDataFrame([(i, "please raise the limit of my card for the trip to the sea next week" if i % 3 else f"please raise the limit of my card number {i} for the trip to the sea next week", "train" if i % 2 else "test", "chat") for i in range(200)], "id long, text string, split string, source string")
    want = {(a, b) for a in range(1, 200, 2) for b in range(0, 200, 2)}
    got = [(r.train_id, r.held_id) for r in overlap.split_overlaps(split, "id", "text", "split", "source", hot=3).collect()]
    assert set(got) == want and len(got) == len(want)


def test_sketch_of_long_and_short_texts():
    import numpy as np

    sketch = programs.Sketch(64, 4, 12, 3, 2, 7)
    rng = np.random.default_rng(1)
    many = rng.integers(0, 2**63, 300_000, dtype=np.uint64)
    for numbers in (many[:1], many[:2], np.repeat(many[:2], 50), many):
        distinct = np.unique(numbers, return_inverse=True)
        keys, bits = sketch.of(numbers, *distinct)
        again = sketch.of(numbers, *distinct, room=1000 if len(numbers) < 1000 else 1_000_000)
        assert len(keys) == 76 and len(bits) == 4 and (keys == again[0]).all() and (bits == again[1]).all()
    one, other = (sketch.of(x, *np.unique(x, return_inverse=True))[0] for x in (many[:100], many[:100][::-1]))
    assert (one[:64] == other[:64]).all() and (one[64:] != other[64:]).any()


def test_alignment_bounds_common_runs():
    rng = random.Random(4)
    for _ in range(100):
        lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(12)]
        other = [x for x in lines if rng.random() < 0.8]
        a, b = "\n".join(lines), "\n".join(other)
        assert programs.bounded_by_alignment(a, b) <= len(set(programs.runs(a)) & set(programs.runs(b)))
    assert programs.bounded_by_alignment("a b c d\nx", "y\n a b c d") == 2 and programs.bounded_by_alignment("", "a b c") == 0


def test_programs_of_reordered_and_repeated_lines(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        lines = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(14)) for _ in range(12)]
        texts += ["\n".join(lines), "\n".join(lines[::-1]), "\n".join(lines + lines[2:8] * 4)]
    sets = [set(programs.runs(t)) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if programs.share(sets[a], sets[b]) >= 0.6}
    got = programs.NearPrograms(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").row_pairs()
    assert {tuple(r) for r in got.collect()} == want and len(want) == 120


def test_programs_of_a_common_frame_cost_little_disk(spark):
    rng = random.Random(12)
    frame = [" ".join(f"f{line}_{k}" for k in range(10)) for line in range(8)]
    line = lambda: " ".join(f"w{rng.randrange(9_000)}" for _ in range(8))
    texts = [[*frame[:4], *(line() for _ in range(18)), *frame[4:]] for _ in range(20_000)]
    texts += [[line() if 4 <= k < 8 else x for k, x in enumerate(t)] for t in texts[:200]] + [t[::-1] for t in texts[200:400]]
    rows = list(enumerate(map("\n".join, texts)))
    sets = {i: set(programs.runs(rows[i][1])) for i in (*range(400), *range(20_000, 20_400))}
    assert all(programs.share(sets[i], sets[20_000 + i]) >= 0.6 for i in range(400))
    df = spark.createDataFrame(rows, "id long, text string").repartition(6).cache()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    near = programs.NearPrograms(df, "id", "text")
    assert {tuple(r) for r in near.row_pairs().collect()} == {(i, 20_000 + i) for i in range(400)}
    assert (written() - before) / len(rows) < 4_000  # 34,471 with bands of fixed length
    df.unpersist()


def test_bands_among_many_texts_still_find_pairs():
    import numpy as np

    rng, sketch = np.random.default_rng(5), programs.Sketch(64, 4, 12, 3, 2, 7)
    frame = rng.integers(0, 2**63, 60, dtype=np.uint64)
    frequent = programs.Frequent(frame, np.full(60, 900), 1_000, 1e6)
    frequent.runs, frequent.weights, frequent.rest = np.sort(frame), np.full(60, 0.1, np.float32), np.float32(5)
    odds = frequent.odds(np.concatenate([frame, rng.integers(0, 2**63, 140, dtype=np.uint64)]), 0.6)
    samples, weights = [], []
    for _ in range(300):
        both, one, other = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (90, 50, 50))
        for own in (np.concatenate([frame, both, one]), np.concatenate([frame, both, other])):
            own = np.sort(own)
            places = sketch.parts(own, own, np.arange(len(own)))[0]
            samples.append(own[places])
            weights.append(frequent.weigh(own)[places])
    bands = programs.bands_for(np.array([odds]), (1 - 0.6**4) ** 64, 256)
    keys = sketch.grown(np.stack(samples), np.stack(weights), bands, frequent.enough)
    same = keys[::2] == keys[1::2]
    assert same.any(axis=1).all() and abs(same.mean() - odds) < 0.02
    unlike = (keys[::2][1:] == keys[1::2][:-1]).mean()
    fixed = sketch.fixed(np.stack(samples))
    assert unlike * 10 < (fixed[::2][1:] == fixed[1::2][:-1]).mean()


def reference_encoding(name=RANKS):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(name, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_another_encoder(spark):
    codec, other = tokens.Codec(open(RANKS, "rb").read()), reference_encoding()
    rng = random.Random(2)
    letters = "ab etnshiéß日 \n<|>😀'0.,"
    texts = ["<|endoftext|>", "a" * 5000, " " * 500, "".join(map(chr, range(1, 600))), *("".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300))]
    for text in texts:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ids = tokens.encode_texts(df, "id", "text", RANKS)
    back = {r.id: r.t for r in ids.select("id", tokens.decode_ids(ids, "ids", RANKS).alias("t")).collect()}
    assert back == dict(enumerate(texts))


def test_tokens_of_another_vocabulary():
    name = f"{queries.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    codec, other = tokens.Codec(open(name, "rb").read()), reference_encoding(name)
    for text in ("Überweisung nach Köln, où est passé 東京?", "x" * 999, "не найдено 404"):
        assert codec.encode(text) == other.encode_ordinary(text)


def test_tiles():
    a = [1, 2, 3, 4, 5, 9, 6, 7, 8, 1, 2, 3]
    b = [6, 7, 8, 0, 1, 2, 3, 4, 5]
    assert leaks.tile(a, b, 3) == [(0, 4, 5), (6, 0, 3)]
    assert leaks.tile([1, 1, 1, 1], [1, 1, 1], 2) == [(0, 0, 3)] and leaks.tile([], b, 3) == []
    rng = random.Random(4)
    for _ in range(100):
        a, b = [[rng.randrange(3) for _ in range(30)] for _ in range(2)]
        longest = max((n for i in range(30) for j in range(30) for n in range(1, 31 - max(i, j)) if a[i : i + n] == b[j : j + n]), default=0)
        tiles = leaks.tile(a, b, 4)
        assert max((n for *_, n in tiles), default=0) == (longest if longest >= 4 else 0)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles)


def test_tiles_of_repeats():
    import time

    began = time.time()
    one, two = [1, 2] * 25_000, [2, 1] * 100
    assert leaks.tile(one, two, 12) == [(1, 0, 200)]
    assert leaks.tile(one, one, 12) == [(0, 0, 50_000)]
    assert sum(n for *_, n in leaks.tile(one, [1, 2, 1] * 2_000, 3)) >= 3
    assert time.time() - began < 5


def old_tile(a, b, least):
    """Greedy string tiling done plainly."""
    open_a, open_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and open_a[i + n] and open_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if all(open_a[i : i + best]) and all(open_b[j : j + best]):
                open_a[i : i + best] = open_b[j : j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiles_are_those_done_plainly():
    rng = random.Random(6)
    for _ in range(150):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(2)]
        assert leaks.tile(a, b, 3) == old_tile(a, b, 3)


def test_leaks_by_seeds(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, item.upper().replace(" ", "\n--")), (2, item[:60]), (3, None), (1, f"x {item} y")], "doc long, item string")
    items = spark.createDataFrame([(5, item), (6, None), (7, "short"), (8, f"zero {item}")], "item long, text string")
    for bits in (6, 27):  # a filter that lets everything through, and one that doesn't
        got = sorted((r.doc, r.item, r.longest) for r in leaks.leaked_items(docs, "doc", "item", items, "item", "text", most_bits=bits).collect())
        assert got == [(1, 5, 13), (1, 5, 13), (1, 8, 13), (1, 8, 13)]


CLEAN = ["Le modèle préféré gagne à Gómere, où l’équipe a créé la donnée.", "Für die Überweisung wurden zwei Tage benötigt, das ist zu lang für mich.", "La señora llamó a la línea de atención por una comisión pequeña.", "NÃO FOI POSSÍVEL CONCLUIR A OPERAÇÃO AMANHÃ À AGÊNCIA", "где моя карта", "日本語の問い合わせ", "naïve café — “yes” 😀 £12 and 30 €"]


@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "mac_roman", "cp1251", "cp437"])
@pytest.mark.parametrize("times", [1, 2])
def test_garbled_text_is_found_and_read_back(spark, codec, times):
    rows = [(i, t) for i, t in enumerate(CLEAN * 30)]
    bad = {}
    for k, text in enumerate(CLEAN[:3]):
        now = text
        try:
            for _ in range(times):
                now = now.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        bad[1000 + k] = (now, text)
    df = spark.createDataFrame(rows + [(i, x) for i, (x, _) in bad.items()] + [(2000, "lost �"), (2001, None), (2002, "")], "id long, text string")
    found = {r.id: r.restored for r in garbled.garbled(df, "id", "text").collect()}
    assert set(found) == set(bad) | {2000}
    assert all(found[i] == text for i, (_, text) in bad.items())


def test_one_byte_readings(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 30)]
    bad = {1000: CLEAN[0].replace("’", "'"), 1001: CLEAN[2]}
    df = spark.createDataFrame(rows + [(i, t.encode("cp1252").decode("cp1251")) for i, t in bad.items()], "id long, text string")
    assert {r.id: r.restored for r in garbled.garbled(df, "id", "text").collect()} == bad


@pytest.mark.parametrize("codec", ["gbk", "cp932", "big5", "cp1253"])
def test_readings_of_two_bytes(spark, codec):
    texts = ["the café in Köln", "El niño pasó por la montaña", "ask for £1390 now"]
    rows = [(i, t) for i, t in enumerate((CLEAN + texts) * 30)]
    bad = {}
    for k, text in enumerate(texts):
        try:
            bad[1000 + k] = (text.encode("utf-8").decode(codec), text)
        except UnicodeDecodeError:
            continue
    clean = ["問い合わせ 茅台 每", "где моя карта", "Ωραία η κάρτα"]
    df = spark.createDataFrame(rows + [(i, x) for i, (x, _) in bad.items()] + [(2000 + k, t) for k, t in enumerate(clean)], "id long, text string")
    found = {r.id: r.restored for r in garbled.garbled(df, "id", "text").collect()}
    assert found == {i: text for i, (_, text) in bad.items()} and bad


def test_misread_characters_that_the_corpus_never_has(spark):
    texts = ["\ufeffWhere is my card?", "thanks a lot 🚀 see you", "pay it\u2003now"]
    bad = {1000 + k: (t.encode("utf-8").decode(c), t) for k, (t, c) in enumerate((t, c) for t in texts for c in ("cp1252", "mac_roman", "cp437"))}
    bad[2000] = ("ï»¿Where is my card?", texts[0])
    bad[2001] = ("ï»¿".encode().decode("cp1252") + "Where is my card?", texts[0])
    clean = ["voilà\u00a0» et touché\u00a0»", "уже она", "touché—“ non"]
    rows = [*enumerate(CLEAN[:5] * 30), *((i, x) for i, (x, _) in bad.items()), *((3000 + k, t) for k, t in enumerate(clean))]
    found = {r.id: r.restored for r in garbled.garbled(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert found == {i: text for i, (_, text) in bad.items()}


def test_every_pair_of_characters_is_kept(spark):
    import numpy as np
    import pandas as pd

    texts = [chr(0x4E00 + k // 600) + chr(0x4E00 + k % 600) for k in range(320_000)] + ["né"] * 3
    pairs = garbled.pair_table(spark.createDataFrame(pd.DataFrame({"text": texts})))
    table, sums = pairs.toPandas(), garbled.corpus_sums(pairs)
    assert len(table) == 320_001 and sums.total == table["n"].sum() == 320_003
    model = garbled.PairModel(table["code"].to_numpy(), table["n"].to_numpy(), sums)
    assert model.count("né") == 3 and model.known("né") and model.count("én") == 0
    order = np.argsort(w := garbled.weights(table["code"].to_numpy(), table["n"].to_numpy(), sums.left, sums.right, sums.total))
    assert sums.least == max(w[order][np.searchsorted(np.cumsum(table["n"].to_numpy()[order]), 0.115 * sums.total)], w[w > 0].min())


def test_garbled_text_without_the_table_of_pairs(spark, sf_dir):
    odd = [(10**6 + k, t) for k, t in enumerate([None, "", "é", "Ã©", "lost \ufffd", "caf\u8305 x", "Â¡", "\U0001f680", "cafÃ© " * 200])]
    df = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(odd, "i long, t string"))
    want = {tuple(r) for r in garbled.garbled(df, "doc_id", "text").collect()}
    got = [tuple(r) for r in garbled.garbled(df, "doc_id", "text", table_pairs=0, chunk_rows=7).collect()]
    assert set(got) == want and len(got) == len(want) > 5


def test_weights_and_scores_by_hand(spark):
    texts = ["red red blue", "blue green", "blue sky blue", "sky"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {(r.id, r.term): r for r in terms.term_scores(df, "id", "text", prior=10.0).collect()}
    r = rows[0, "red"]
    total, c, y, m = 9, 2, 2, 3
    alpha = 10 * c / total
    want = (math.log((y + alpha) / (m + 10 - y - alpha)) - math.log((c - y + alpha) / (total - m + 10 - (c - y) - alpha))) / math.sqrt(1 / (y + alpha) + 1 / (c - y + alpha))
    assert r.z == pytest.approx(want) and (r.records, r.n, r.record_terms) == (1, 4, 2)
    assert collections.Counter(t for t in re.findall(r"\w+", " ".join(texts)))["blue"] == rows[1, "blue"].occurrences
