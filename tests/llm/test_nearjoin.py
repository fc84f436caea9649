"""The near-duplicate join against brute force over all pairs."""

import random
import re
from itertools import combinations

import pytest

from graticule.llm import nearjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=12, size=9, alone=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = text(40)
    rows = []
    for _ in range(groups):
        base = text(rng.randint(6, 120)) + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [" ".join(text(rng.randint(1, 60)) + (shared if rng.random() < 0.3 else [])) for _ in range(alone)]
    rows += ["", None, " \t\n", "One", "one", "ONE two", "É é", "é É", "a b c d e", "a  b\tc d\ne", "x " * 3000, "x " * 50]
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(df.repartition(3)).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("small, part", [(2, 1000), (3, 5)])
def test_long_and_hot_lists_lose_nothing(spark, monkeypatch, small, part):
    """The values travel with the functions that use them, which are pickled by value."""
    rows = corpus(2, groups=4, size=30, alone=30)
    monkeypatch.setattr(nearjoin, "SMALL_LIST", small)
    monkeypatch.setattr(nearjoin, "PART", part)
    monkeypatch.setattr(nearjoin, "BLOCK", 200)
    assert found(spark, rows) == brute(rows)


def test_common_members_in_short_and_long_lists_add_up(spark):
    """The last two texts link; of their three common prefix members one is in a short list and two in long ones, whose leader is another text."""
    passage = " ".join(f"p{k}" for k in range(83))
    most = f"{passage} q"
    rows = list(enumerate([passage, *[f"c{k} {passage}" for k in range(14)], most, most + "".join(f" u{k}" for k in range(20))]))
    sets = [shingles(t) for _, t in rows]
    assert 100 * len(sets[-1] & sets[-2]) == 80 * len(sets[-1] | sets[-2]) and max(100 * len(sets[-1] & s) / len(sets[-1] | s) for s in sets[:-2]) < 80
    assert found(spark, rows) == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in nearjoin.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (None, 0, None), (3, 0, 3)], key=repr)
    assert nearjoin.near_duplicates(df.limit(0)).count() == 0
    kept = nearjoin.drop_near_duplicates(df.selectExpr("*", "1 as u", "'x' as node"))
    assert kept.columns == ["doc_id", "text", "u", "node"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None, None]


def thue_morse(flip):
    bits = [flip ^ (bin(k).count("1") & 1) for k in range(1024)]
    return "".join("ab"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    rows = [(1, thue_morse(0)), (2, thue_morse(1)), (3, "abcdefgh1"), (4, "abcdefgh2"), (5, "abcdefgh12345678x"), (6, "abcdefgh12345678y")]
    assert found(spark, rows) == {i: (1, i) for i, _ in rows}


def test_a_group_around_the_threshold(spark, monkeypatch):
    """Many copies edited here and there: some pairs link, most do not, and components are exact."""
    monkeypatch.setattr(nearjoin, "PART", 20)
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == brute(rows)


def test_equal_sets_of_different_texts_and_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"l{rng.randrange(90000)}" for _ in range(400_000)]
    near = list(long)
    near[1000:1010] = ["other"] * 10
    rows = [(1, "A b c  d e f"), (2, "a b\nc d e f"), (3, " ".join(long)), (4, " ".join(near)), (5, "q" * 2_000_000), (6, "r" * 2_000_000)]
    got = found(spark, rows)
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 3, 3, 5, 6] and got[3][0] == len(shingles(rows[2][1]))


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8), (2, "a b c d e f", 9, 10), (3, "x", 11, 12)], "doc_id long, text string, _taken int, node int")
    kept = nearjoin.drop_near_duplicates(df.unionAll(df.where("doc_id = 3")))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", 7, 8), (3, "x", 11, 12)]


def test_equal_shared_members_are_not_equal_sets(spark):
    """Both have 100 members, share the same 85 and have 15 of their own: 85 of 115."""
    passage = " ".join(f"p{k}" for k in range(89))
    rows = [(1, passage + "".join(f" a{k}" for k in range(15))), (2, passage + "".join(f" b{k}" for k in range(15)))]
    assert found(spark, rows) == brute(rows) == {1: (100, 1), 2: (100, 2)}
