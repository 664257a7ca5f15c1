import difflib
import random

import pytest

from duelframe.operators.similarity import closest_names, similar_pairs


def frames(spark, words, names):
    return (
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(n,) for n in names], "candidate string"),
    )


def vocabulary(seed, size):
    rng = random.Random(seed)
    parts = ["real", "sporting", "united", "City", "FC ", "1. ", "são", "köln", "Ath", "etic", "o", " ", "-", "ll", "é", "𝔘x"]
    made = {"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(size)}
    letters = {"".join(rng.choice("aabbcde ") for _ in range(rng.randrange(1, 14))) for _ in range(size)}
    return sorted(made | letters)


@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.85, 1.0])
def test_no_pair_is_lost(spark, cutoff):
    words, names = vocabulary(1, 60) + [""], vocabulary(2, 60) + vocabulary(1, 5) + [""]
    wanted = {
        (w, n): r
        for w in words
        for n in set(names)
        if (r := difflib.SequenceMatcher(None, n, w).ratio()) >= cutoff
    }
    got = {(r["word"], r["candidate"]): r["score"] for r in similar_pairs(*frames(spark, words, names), cutoff).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[k] == wanted[k] for k in wanted)


@pytest.mark.parametrize("cutoff", [0.6, 0.85])
def test_closest_is_the_library_choice(spark, cutoff):
    words, names = vocabulary(3, 50), vocabulary(4, 50)
    wanted = {w: m[0] for w in words if (m := difflib.get_close_matches(w, names, n=1, cutoff=cutoff))}
    got = {r["word"]: r["candidate"] for r in closest_names(*frames(spark, words, names), cutoff).collect()}
    assert got == wanted


def test_long_names_with_popular_characters(spark):
    """From 200 characters on the matcher ignores popular ones; the result follows it."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij") for _ in range(230))
    words, names = [base], [base[:200] + "x" * 20, base[5:] + "yy"]
    wanted = {(w, n) for w in words for n in names if difflib.SequenceMatcher(None, n, w).ratio() >= 0.3}
    got = {(r["word"], r["candidate"]) for r in similar_pairs(*frames(spark, words, names), 0.3).collect()}
    assert got == wanted


def test_known_ratios(spark):
    pairs = similar_pairs(*frames(spark, ["Ath Madrid", "Wolves"], ["Atletico Madrid", "Alaves"]), 0.6).collect()
    scores = {(r["word"], r["candidate"]): round(r["score"], 3) for r in pairs}
    assert scores == {("Ath Madrid", "Atletico Madrid"): 0.72, ("Wolves", "Alaves"): 0.667}


def test_cutoff_must_be_positive(spark):
    with pytest.raises(ValueError):
        similar_pairs(*frames(spark, ["a"], ["b"]), 0.0)
