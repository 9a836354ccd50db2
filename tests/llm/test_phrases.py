"""Collocations against plain Python counting, and the automata behind them."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from acctrisk.llm import phrases
from acctrisk.llm.automata import Automaton, composed, prefix_sums, united
from acctrisk.llm.words import mixed, unmixed

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    held = {p: a for p, a in f.items() if a >= least}
    gone = {(p[0], *q) for p, a in held.items() for q in (p[1:-1], p[2:]) if len(q) > 1 and held[(p[0], *q)] == a}
    out = {}
    for p, a in held.items():
        if len(p) > 2 and p not in gone:
            lang, *words = p
            cuts = [(1000 * a * n[lang] // (f[p[:k + 1]] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words), f[p[:k + 1]], f[(lang, *words[k:])]))
    return sorted((lang, i, phrase, -a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1))


def found(spark, rows, least, top=2000):
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, words string")
    return sorted(tuple(r) for r in phrases.collocations(docs.repartition(3), least, top).collect())


@pytest.mark.parametrize("ranges", [20_000, 40])
def test_random_texts(spark, monkeypatch, ranges):
    monkeypatch.setattr(phrases, "RANGE_ROWS", ranges)
    monkeypatch.setattr(phrases.prefix_ranges, "__defaults__", (ranges,))
    monkeypatch.setattr(phrases, "HELD_PHRASES", 50)
    random.seed(5)
    words = [f"W{int(random.paretovariate(0.8))}" for _ in range(300)] + ["a\x01", "a", "É", "b\x0b", "x."]
    rows = []
    for i in range(300):
        text = random.choice(["", "new York city hall ", "the the the the the the "])
        text += " ".join(random.choices(words, k=random.randint(0, 60))).replace("W7", "W7,").replace("W9 ", "W9\t ")
        rows.append((text, random.choice(["en", "und", None, "x y"])))
    assert found(spark, rows, 8) == brute(rows, 8, 2000)
    assert found(spark, rows, 8, 3) == brute(rows, 8, 3)


def test_odd_rows(spark):
    long = "alpha beta gamma. " * 30_000 + "z" * 200_000 + " " + "z" * 200_000
    rows = [(None, "en"), ("", "en"), ("...;\n", None), (long, "en"), ("one word", None), ("z" * 100_000, "en")]
    assert found(spark, rows, 100) == brute(rows, 100, 2000)
    assert found(spark, [], 2) == []


def test_exact_beyond_64_bits(spark):
    rows = [("p q " * 400 + "r", "en")] * 60
    assert found(spark, rows, 100) == brute(rows, 100, 2000)


def test_automata():
    random.seed(2)
    bag = lambda: sorted(Counter(tuple(random.choices("abc", k=random.randint(1, 4))) for _ in range(200)).items())
    one, two = bag(), bag()
    first = Automaton(one)
    assert list(first) == one == list(Automaton.load(first.dump()))
    assert len(first.weights) <= len({p[:k] for p, _ in one for k in range(5)})
    both = Counter(dict(one)) + Counter(dict(two))
    assert dict(united([first, Automaton(two)])) == both
    sums = dict(prefix_sums(united([first, Automaton(two)])))
    assert sums == Counter({p: sum(w for q, w in both.items() if q[:len(p)] == p) for p in sums})
    whole = Automaton(sorted(sums.items()))
    for phrase, along, same in composed(Automaton((p, 1) for p in sorted(sums)[::3]), whole):
        assert along == [sums[phrase[:k]] for k in range(1, len(phrase) + 1)]
        assert same == any(sums.get((*phrase, w)) == sums[phrase] for w in "abc")
    with pytest.raises(ValueError):
        Automaton([(("b",), 1), (("a",), 1)])
    assert list(Automaton()) == []


def test_hashes_give_back_what_they_are_made_of():
    numbers = np.random.default_rng(1).integers(0, 2 ** 64, 1000, np.uint64)
    assert (unmixed(mixed(numbers)) == numbers).all()


def test_shard_rows_do_not_grow_with_the_tasks(spark, monkeypatch):
    rows = [(" ".join(f"w{(7 * i + j * j) % 30}" for j in range(40)), "en") for i in range(400)]
    taken = []
    whole = phrases.united_counts
    monkeypatch.setattr(phrases, "united_counts", lambda shards, least: taken.append(shards.count()) or whole(shards, least))
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [sorted(tuple(r) for r in phrases.collocations(docs.repartition(n), 20).collect()) for n in (1, 8)]
    assert got[0] == got[1] == brute(rows, 20, 2000)
    assert taken[0] == taken[1]


def test_rows_of_words_grow_with_the_input(spark, monkeypatch):
    """Five times the texts and tasks, by which all words become frequent, give five times the rows with words."""
    taken = []
    frame = type(spark.range(1))
    whole = frame.mapInArrow

    def counted(own, function, schema, *args, **named):
        out = whole(own, function, schema, *args, **named)
        if "word string" in schema:
            taken.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    rows = [(" ".join(f"w{(3 * i + j) % 97} the" for j in range(97)), "en") for i in range(20)]
    sums = []
    for copies, tasks in ((1, 2), (5, 10)):
        docs = spark.createDataFrame([r for r in rows for _ in range(copies)], "text string, lang string")
        taken.clear()
        got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(tasks), 60).collect())
        assert got == brute(rows * copies, 60, 2000)
        sums.append(sum(taken))
    assert 0 < sums[1] <= 5 * sums[0]


def test_words_are_counted_as_text_where_little_is_held(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_BYTES", 2000)
    random.seed(6)
    rows = [("A b. " * random.randint(0, 3) + "z" * random.randint(0, 300) + " Été", random.choice(["en", "und", None])) for _ in range(300)]
    counts = phrases.word_counts(spark.createDataFrame([(t, g or "und") for t, g in rows], "text string, lang string").repartition(3))
    got = Counter()
    for r in counts.collect():
        got[r.lang, r.word] += r.n
    want = Counter((g or "und", w) for t, g in rows for w in re.findall(r"[^\x20\x09.]+", t.translate(LOWER)))
    want += Counter({(lang, None): sum(n for (x, _), n in want.items() if x == lang) for lang in ("en", "und")})
    assert got == want
    assert found(spark, rows, 5) == brute(rows, 5, 2000)


@pytest.mark.parametrize("weak", ["words", "phrases"])
def test_shared_hashes(spark, monkeypatch, weak):
    """Words or phrases that share a hash, frequent ones among them, are told apart by their texts."""
    if weak == "words":
        kept = phrases.runs.hashes
        monkeypatch.setattr(phrases.runs, "hashes", lambda *a: kept(*a) & np.uint64(0xF))
    else:
        monkeypatch.setattr(phrases.Words, "grams", lambda own, at, size: own.hashes[at] ^ own.hashes[at + size - 1])
    used = []
    by_text = phrases.shard_phrases
    monkeypatch.setattr(phrases, "shard_phrases", lambda *a: used.append(1) or by_text(*a))
    random.seed(3)
    rows = [(" ".join(random.choices([f"w{i}" for i in range(25)], k=40)), random.choice(["en", None])) for _ in range(200)]
    rows += [("q" * 70_000 + f"{i % 2} end", "en") for i in range(40)]
    assert found(spark, rows, 15) == brute(rows, 15, 2000)
    assert used
