"""Phrases of a dictionary in texts, with places (D14, D26, F09, F10): one automaton for all phrases, so a text is read once whatever the
dictionary holds.

A phrase matches whole words, in any case; runs of white space and hyphens are alike. The dictionary is a list that travels to the
tasks; it is the catalogue of a deployment, not something that grows with the texts, and `phrases_of` checks its size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Phrases of a dictionary at most.
MOST = 200_000
SPAN_SCHEMA = "label string, phrase string, raw string, start int, end int"
JOINT = re.compile(r"[\s\-]+")


def canonical(phrase: str) -> str:
    return JOINT.sub(" ", phrase.strip()).lower()


def lowered(text: str) -> str:
    """The text in lower case, every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


class Phrases:
    """An automaton of phrases; a phrase may stand for several labels."""

    def __init__(self, phrases: list[tuple[str, str]]):
        import ahocorasick

        by_text: dict[str, list] = {}
        for label, phrase in phrases:
            if key := canonical(phrase):
                by_text.setdefault(key, []).append((label, phrase))
        self.machine = ahocorasick.Automaton()
        for key, own in by_text.items():
            self.machine.add_word(key, (len(key), own))
        if by_text:
            self.machine.make_automaton()
        self.some = bool(by_text)

    def found(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """label, phrase, start and end of every occurrence as whole words, by end."""
        if not self.some:
            return
        low, at = lowered(text), None
        flat = JOINT.sub(" ", low)
        if len(flat) != len(low):  # places of the text for those of the flat one
            keep = np.ones(len(low), bool)
            for m in JOINT.finditer(low):
                keep[m.start() + 1 : m.end()] = False
            at = np.flatnonzero(keep)
        word = lambda c: c.isalnum() or c == "_"
        for last, (size, own) in self.machine.iter(flat):
            first = last - size + 1
            if first and word(flat[first - 1]) and word(flat[first]) or last + 1 < len(flat) and word(flat[last + 1]) and word(flat[last]):
                continue
            start, end = (first, last + 1) if at is None else (int(at[first]), int(at[last]) + 1)
            for label, phrase in own:
                yield label, phrase, start, end

    def spans(self, text: str) -> list[tuple[str, str, int, int]]:
        """Of each label the leftmost occurrences, of those that begin together the longest, none within another."""
        by_label: dict[str, list] = {}
        for label, phrase, start, end in self.found(text):
            by_label.setdefault(label, []).append((start, -end, phrase))
        out = []
        for label, places in by_label.items():
            free = 0
            for start, end, phrase in sorted(places):
                if start >= free:
                    out.append((label, phrase, start, -end))
                    free = -end
        return out


def scanned(texts: DataFrame, key: str, phrases: list[tuple[str, str]]) -> DataFrame:
    """key, label, phrase, raw, start and end of the phrases ((label, phrase) pairs) in each text; a null text has none."""
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Phrases(phrases)
        for frame in frames:
            out = [(k, label, phrase, t[a:b], a, b) for k, t in zip(frame[key], frame["text"]) if t for label, phrase, a, b in machine.spans(t)]
            yield pd.DataFrame(out, columns=[key, "label", "phrase", "raw", "start", "end"])

    return texts.select(key, "text").mapInPandas(run, f"`{key}` {kind}, {SPAN_SCHEMA}")


def phrases_of(table: DataFrame, phrase: str) -> list[tuple[str, str]]:
    """The distinct phrases of a column, each its own label; an error if there are more than MOST."""
    found = [r[0] for r in table.select(phrase).filter(f"`{phrase}` is not null").distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"a dictionary of more than {MOST} phrases")
    return [(p, p) for p in found]
