import random

import plain
import pytest

from fleetlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, token string, depth long, chain string, items string, c long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "t", 7, "x", "y", 1) for r in rows], SCHEMA)


def tree(spark, rows):
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_turns(prefix_trie.turns_of(frame(spark, rows)))).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0]))


def random_rows(rng, convs, most, words=3):
    rows = []
    for c in rng.sample(range(-250, 450), convs):
        rows += [(c, t, rng.choice(["user", "assistant"]), "ab"[: rng.randint(0, 2)] * rng.randint(1, words)) for t in range(rng.randint(0, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,convs,most", [(1, 60, 9), (2, 200, 5), (3, 120, 2), (4, 25, 30)])
def test_like_brute_force(spark, seed, convs, most):
    rows = random_rows(random.Random(seed), convs, most, 2)
    assert tree(spark, rows) == plain.trie(plain.rebuilt(rows))


def test_awkward_rows(spark):
    rows = [
        (0, 0, "user", "a"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "", ""), (0, 1, "", ""), (1, 5, "user", "same"), (1, 5, "user", "same"),
        (None, 0, "user", "nobody's"), (None, None, None, None), (-7, 0, "user", "é漢👍"), (-7, -3, "user", "before"), (250, None, None, None),
        (250, None, None, "x"), (251, 0, "us", "er"), (252, 0, "u", "ser"), (253, 0, "", "user"), (10**15, 1, "user", "far " * 20_000), (10**15 + 1, 0, "user", "own"),
    ]
    assert tree(spark, rows) == plain.trie(plain.rebuilt(rows))


def test_long_conversations_beside_short_ones(spark):
    """Several tiers of chunks: 64 turns are one, 4,096 the most of two."""
    def turns(c, n, split):
        return [(c, i, "user", "w" if i != split else f"s{c}") for i in range(n)]

    rows = turns(600, 4_200, -1) + turns(700, 4_200, 4_150) + turns(800, 130, -1) + turns(900, 129, 70) + turns(1_000, 64, -1) + turns(1_100, 1, -1)
    got = tree(spark, rows)
    sequences = plain.rebuilt(rows)
    want = plain.trie({c: t for c, t in sequences.items() if c in (800, 900, 1_000, 1_100)})
    assert len(got) == 1 + 4_200 + 50 + 59 and got[0][3:6] == (6, 1, 3)
    deep = [r for r in got if 1 <= r[1] <= 130 and r[0] != 900]
    assert [r[1] for r in deep] == list(range(1, 131)) and all(r[0] == 600 for r in deep[1:])
    small = tree(spark, [r for r in rows if r[0] in (800, 900, 1_000, 1_100)])
    assert small == want


def test_many_conversations_that_end_in_one_node(spark):
    rows = [(c, 0, "user", "same") for c in range(-3_000, 12_000, 3)]
    assert tree(spark, rows) == plain.trie(plain.rebuilt(rows))


def test_all_without_turns(spark):
    """The first conversation of the hundred is absent, and a conversation's own first turns go."""
    rows = [(c, 0, "user", "gone") for c in range(1, 99) if prefix_trie_h(c)]
    got = tree(spark, rows)
    assert got == plain.trie(plain.rebuilt(rows)) and len(got) == 1 and got[0][5] == 1


def prefix_trie_h(c):
    return plain.zlib.crc32(str(c).encode()) % 6


def test_empty_table(spark):
    assert tree(spark, []) == [] and tree(spark, [(None, 0, "user", "x")]) == []
