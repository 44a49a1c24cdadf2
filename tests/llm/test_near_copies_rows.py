import random

from .test_near_copies import stay, words_of


def test_rows_are_judged_one_by_one(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(words_of(rng, 100)) for _ in range(4))
    rows = [(2, a), (5, a + " end"), (5, b), (None, c), (None, d), (None, b + " end"), (7, d + " end"), (9, b)]
    want = [(True, 2, a), (True, 5, b), (False, 0, c), (True, 7, d + " end")]
    assert stay(spark, rows) == sorted(want)
