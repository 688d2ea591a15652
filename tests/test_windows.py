"""Shared windows against a look at every window."""

import random

import pytest
from pyspark.sql import functions as F

from sluiceworks.functions import vocab as V
from sluiceworks.functions import windows
from sluiceworks.operators import egress


def plainly(prompt, response):
    low, said = prompt.lower(), response.lower()
    if len(low.encode()) < V.LEAK_PROMPT or len(said.encode()) < V.LEAK_WINDOW:
        return None
    every = (low[i : i + V.LEAK_WINDOW] for i in range(len(low) - V.LEAK_WINDOW + 1))
    return next((c for c in every if c in said and windows.is_significant(c)), None)


@pytest.mark.parametrize("alphabet", ["ab", "abc é", "if else for x 😀", "0123456789"])
def test_the_first_window_equals_a_plain_search(alphabet):
    r = random.Random(alphabet)
    found = 0
    for _ in range(400):
        prompt = "".join(r.choice(alphabet) for _ in range(r.choice([10, 30, 59, 60, 61, 90, 300])))
        at = r.randint(0, len(prompt))
        response = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) + r.choice([prompt[at : at + r.randint(10, 60)], ""]) + "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert windows.leak(prompt, response) == plainly(prompt, response)
        found += plainly(prompt, response) is not None
    assert found > 20


def test_hashes_tell_windows_apart():
    r = random.Random(2)
    for size in (1, 2, 3, 7, 19, 20, 33):
        text = "".join(r.choice("ab") for _ in range(500))
        hashes = windows.window_hashes(text, size).tolist()
        pairs = {(h, text[i : i + size]) for i, h in enumerate(hashes)}
        assert len(hashes) == 500 - size + 1 and len({h for h, _ in pairs}) == len({t for _, t in pairs}) == len(pairs)


def test_long_texts_take_time_in_proportion():
    import time

    r = random.Random(3)
    prompt = "".join(r.choice("abcdefgh ") for _ in range(8000))
    response = "".join(r.choice("abcdefgh ") for _ in range(200_000)) + prompt[4000:4040]
    began = time.perf_counter()
    assert windows.leak(prompt, response) is not None and time.perf_counter() - began < 2


def test_nulls_and_repeated_code(spark):
    code = "if else for while return const let var function class interface public private static"
    rows = [(None, "x"), ("x" * 70, None), (code, code), (code + " the blue cabinet of the old library", "say the blue cabinet of the old library")]
    out = spark.createDataFrame(rows, "p string, r string").select(egress.leaked(F.col("p"), F.col("r")).alias("leak")).collect()
    assert [x.leak for x in out[:2]] == [None, None] and out[2].leak == plainly(code, code) and out[3].leak == plainly(*rows[3])
