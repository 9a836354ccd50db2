"""Weighted acyclic automata over words: built from sorted phrases, united by summing, composed for look-ups."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import groupby

Phrase = tuple[str, ...]


class Automaton:
    """A minimal acyclic automaton that gives each phrase it accepts a weight.

    Phrases come in ascending order, so that all states but those of the latest phrase are final and
    can be shared with equal ones at once. States are numbered from the leaves; the last is the root.
    """

    def __init__(self, weighted: Iterable[tuple[Phrase, int]] = ()):
        self.weights: list[int] = []
        self.arcs: list[tuple] = []
        register: dict[tuple, int] = {}
        path: list[list] = [[0, []]]  # weight and arcs of the states of the latest phrase
        words: Phrase = ()

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                weight, arcs = path.pop()
                state = (weight, tuple(arcs))
                number = register.get(state)
                if number is None:
                    number = register[state] = len(self.weights)
                    self.weights.append(weight)
                    self.arcs.append(state[1])
                path[-1][1].append((words[len(path) - 1], number))

        for phrase, weight in weighted:
            if phrase < words:
                raise ValueError("phrases must ascend")
            same = 0
            while same < len(words) and same < len(phrase) and words[same] == phrase[same]:
                same += 1
            close(same)
            words = phrase
            path += [[0, []] for _ in range(len(phrase) - same)]
            path[-1][0] += weight
        close(0)
        self.weights.append(path[0][0])
        self.arcs.append(tuple(path[0][1]))

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases with their weights, ascending."""
        def below(state: int, phrase: Phrase):
            if self.weights[state]:
                yield phrase, self.weights[state]
            for word, to in self.arcs[state]:
                yield from below(to, (*phrase, word))

        return below(len(self.weights) - 1, ())

    def dump(self) -> bytes:
        words = sorted({w for arcs in self.arcs for w, _ in arcs})
        number = {w: i for i, w in enumerate(words)}
        return pickle.dumps((words, self.weights, [[(number[w], to) for w, to in arcs] for arcs in self.arcs]), 5)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        own = cls.__new__(cls)
        words, own.weights, arcs = pickle.loads(data)
        own.arcs = [tuple((words[w], to) for w, to in a) for a in arcs]
        return own


def united(parts: Iterable[Automaton]) -> Iterator[tuple[Phrase, int]]:
    """The phrases of several automata, ascending, with the sums of their weights."""
    for phrase, same in groupby(merge(*parts), key=lambda x: x[0]):
        yield phrase, sum(w for _, w in same)


def prefix_sums(weighted: Iterable[tuple[Phrase, int]]) -> Iterator[tuple[Phrase, int]]:
    """For phrases in ascending order, every beginning of them with the weight of all that begin so."""
    path: list[list] = []
    for phrase, weight in weighted:
        same = 0
        while same < len(path) and same < len(phrase) and path[same][0] == phrase[same]:
            same += 1
        while len(path) > same:
            yield tuple(w for w, _ in path), path[-1][1]
            path.pop()
        path += [[word, 0] for word in phrase[same:]]
        for step in path:
            step[1] += weight
    while path:
        yield tuple(w for w, _ in path), path[-1][1]
        path.pop()


def composed(phrases: Automaton, counts: Automaton) -> Iterator[tuple[Phrase, list[int], bool]]:
    """Both automata walked in step: for each phrase the counts along it, and whether a longer phrase has its count.

    The counts of a phrase are those of its first word, its first two words and so on.
    """
    def walk(a: int, b: int, phrase: Phrase, along: list[int]):
        if phrase and phrases.weights[a]:
            yield phrase, along, any(counts.weights[to] == along[-1] for _, to in counts.arcs[b])
        targets = dict(counts.arcs[b])
        for word, to in phrases.arcs[a]:
            if word in targets:
                yield from walk(to, targets[word], (*phrase, word), [*along, counts.weights[targets[word]]])

    return walk(len(phrases.weights) - 1, len(counts.weights) - 1, (), [])
