"""Small seeded tables with the shapes that the rule table and the methods are tested on."""

import random


def choose(r, values, n, weights=None):
    return r.choices(values, weights, k=n)


EIGHT_ROWS = [
    (0.3, 1.0, 2.0, 5.0, 1.0), (0.12, 1.0, 2.0, 1.0, 1.0), (0.18, 1.0, 2.0, 1.0, 1.0), (1.9, 3.0, 3.0, 1.0, 5.0), (1.0, 4.0, 3.0, 1.0, 4.0), (1.0, 4.0, 3.0, 1.0, 1.0), (0.1, 6.0, 2.0, 1.0, 5.0), (0.15, 1.0, 2.0, 5.0, 1.0),
]
EIGHT_SCHEMA = "num double, key1 double, key2 double, key3 double, key4 double"


def low1(seed=1):
    r = random.Random(seed)
    return [(r.choice("MF"), r.choice("NSEW"), r.choice(["18-30", "31-45", "46-60", "60+"])) for _ in range(2000)], "sex string, region string, age_band string", ["sex", "region", "age_band"]


def severe_tail(seed=1):
    r = random.Random(seed)
    rows = [(r.choice([30, 35, 40]), r.choice([10001, 10002, 10003]), r.choice("MF")) for _ in range(980)] + [(r.randrange(85, 93), r.randrange(99990, 99997), r.choice("MF")) for _ in range(20)]
    return rows, "age long, zip long, sex string", ["age", "zip", "sex"]


def low3(seed=1):
    r = random.Random(seed)
    return [(r.choice("ABC"), r.randrange(20, 41)) for _ in range(5000)], "region string, age long", ["region", "age"]


def hr6(seed=1):
    r = random.Random(seed)
    return [(r.choice("abcde"), r.choice("MF"), r.choice("NSE")) for _ in range(150)], "age_band string, sex string, region string", ["age_band", "sex", "region"]


def sr3(seed=1):
    r = random.Random(seed)
    return [(r.randrange(20000, 100000), r.choice("MF")) for _ in range(200)], "income long, sex string", ["income", "sex"]


def cat1(seed=1):
    r = random.Random(seed)
    rows = list(zip(choose(r, "NSEW", 600, [0.3, 0.25, 0.25, 0.2]), choose(r, "abcd", 600, [0.35, 0.35, 0.2, 0.1]), choose(r, "xyz", 600, [0.4, 0.4, 0.2])))
    return rows, "region string, edu string, marital string", ["region", "edu", "marital"]


def pub1_high(seed=1):
    r = random.Random(seed)
    return [(r.choice("abcde"), r.choice([20, 40, 60]), r.choice([1, 3, 5, 7])) for _ in range(300)], "region string, age long, score long", ["region", "age", "score"]


DEGENERATE = {
    "single_group": ([(30, "M", 1.0 * i) for i in range(50)]),
    "single_row": [(25, "F", 45000.0)],
    "two_identical": [(30, "M", 50000.0)] * 2,
    "null_qi": [(i, None, 1.0) for i in range(50)],
    "all_unique": [(i, f"cat_{i}", float(i)) for i in range(100)],
    "constant": [(40, "M", 1.0)] * 50,
    "empty": [],
}
DEGENERATE_SCHEMA = "age long, sex string, income double"
