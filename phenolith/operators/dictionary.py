"""Dictionaries on text: one walk finds all keywords; which of them comes first in the dictionary decides.

The keywords are sent to the tasks with the function, so their number is bounded; each task builds one
automaton from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that may be sent to every task.
MOST_KEYWORDS = 100_000


def contained(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Ascending indices of the groups of which the text holds a keyword, as substrings; none for null texts.

    A group with an empty keyword is in every text, one without keywords in none.
    """
    import ahocorasick

    owners: dict[str, set[int]] = {}
    for i, group in enumerate(groups):
        for word in group:
            owners.setdefault(word, set()).add(i)
    if len(owners) > MOST_KEYWORDS:
        raise ValueError(f"{len(owners)} keywords; a dictionary of more than {MOST_KEYWORDS} is a table to join with")
    always = sorted(owners.pop("", ()))

    @F.pandas_udf("array<int>")
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = ahocorasick.Automaton()
        for word, own in owners.items():
            trie.add_word(word, tuple(own))
        trie.make_automaton()

        def found(text: str | None) -> list[int]:
            if text is None:
                return []
            hit = set(always)
            if owners:
                for _, own in trie.iter(text):
                    hit.update(own)
            return sorted(hit)

        for series in texts:
            yield series.map(found, na_action=None)

    return walk(text)


def needles(pattern: str) -> list[str]:
    """Lower-case strings one of which every match of a regular expression holds; an empty one if none can be told."""
    from re import _constants as c
    from re import _parser

    def of(items: Sequence[tuple]) -> list[str]:
        runs: list[list[str]] = [[""]]
        for op, value in items:
            if op is c.LITERAL:
                runs[-1] = [runs[-1][0] + chr(value).lower()] if len(runs[-1]) == 1 else runs[-1]
                if len(runs[-1]) > 1:
                    runs.append([chr(value).lower()])
                continue
            if op is c.SUBPATTERN:
                runs.append(of(value[-1]))
            elif op is c.BRANCH:
                runs.append([n for branch in value[1] for n in of(branch)])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] > 0:
                runs.append(of(value[2]))
            runs.append([""])
        return max(runs, key=lambda r: (min(map(len, r)), -len(r)))

    return sorted(set(of(list(_parser.parse(pattern)))))


def stopless(pattern: str) -> bool:
    """Whether no match of a regular expression holds a full stop, nor depends on more beside it than where words end."""
    from re import _constants as c
    from re import _parser

    def one(item: tuple) -> bool:
        op, value = item
        if op in (c.LITERAL, c.RANGE):
            low, high = value if op is c.RANGE else (value, value)
            return not low <= ord(".") <= high
        if op is c.CATEGORY:
            return value in (c.CATEGORY_DIGIT, c.CATEGORY_SPACE, c.CATEGORY_WORD)
        if op is c.AT:
            return value is c.AT_BOUNDARY
        if op is c.BRANCH:
            return all(one(x) for branch in value[1] for x in branch)
        if op in (c.SUBPATTERN, c.MAX_REPEAT, c.MIN_REPEAT):
            return all(map(one, value[-1]))
        return op is c.IN and all(map(one, value))

    return all(map(one, _parser.parse(pattern)))


def stretches(text: Column, groups: Sequence[Sequence[str]], whole: Sequence[bool]) -> Column:
    """i, parts of each group i of which a text holds a keyword: the stretches (at, s) between full stops that hold one, by their places.

    ``whole`` names the groups that want the whole text as one stretch instead. One walk finds all; null texts have none.
    """
    import ahocorasick

    owners: dict[str, set[int]] = {}
    for i, group in enumerate(groups):
        for word in group:
            owners.setdefault(word, set()).add(i)
    if len(owners) > MOST_KEYWORDS:
        raise ValueError(f"{len(owners)} keywords; a dictionary of more than {MOST_KEYWORDS} is a table to join with")
    always, entire = sorted(owners.pop("", ())), {i for i, x in enumerate(whole) if x}

    @F.arrow_udf("array<struct<i:int,parts:array<struct<at:int,s:string>>>>")
    def walk(texts: pa.Array) -> pa.Array:
        trie = ahocorasick.Automaton()
        for word, own in owners.items():
            trie.add_word(word, tuple(own))
        trie.make_automaton()
        rows, numbers, cuts, at, parts = [0], [], [0], [], []
        for text in texts.to_pylist():
            found: dict[int, list[tuple[int, str]]] = {} if text is None else {i: [(0, text)] for i in always}
            end, seen = 0, set(always)
            for place, own in trie.iter(text) if text and owners else ():
                if place >= end:
                    begin, end = text.rfind(".", 0, place) + 1, text.find(".", place)
                    end, seen = len(text) if end < 0 else end, set(always)
                for i in own:
                    if i not in seen:
                        seen.add(i)
                        if i not in entire:
                            found.setdefault(i, []).append((begin, text[begin:end]))
                        elif i not in found:
                            found[i] = [(0, text)]
            for i in sorted(found):
                numbers.append(i)
                at += [a for a, _ in found[i]]
                parts += [x for _, x in found[i]]
                cuts.append(len(at))
            rows.append(len(numbers))
        each = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(parts, pa.string())], ["at", "s"])
        by = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(np.array(cuts, np.int32)), each)], ["i", "parts"])
        return pa.ListArray.from_arrays(pa.array(np.array(rows, np.int32)), by)

    return walk(text)


def matching(df: DataFrame, text: str, patterns: Mapping[str, str], name: str = "name") -> DataFrame:
    """Rows of df once for each pattern that ``text`` matches, with its ``name`` and ``pattern``.

    ``text`` is in lower case. One walk finds the patterns whose needles it holds; only those are tried.
    """
    keys = list(patterns)
    hits = df.withColumn("__hit", F.explode(contained(F.col(text), [needles(patterns[k]) for k in keys])))
    table = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(patterns[k]).alias("pattern")) for k in keys))
    named = hits.withColumn("__row", F.element_at(table, F.col("__hit") + 1)).withColumns({name: F.col("__row.name"), "pattern": F.col("__row.pattern")})
    return named.where(F.rlike(text, F.col("pattern"))).drop("__hit", "__row")


def words_pattern(words: Sequence[str]) -> str:
    """One pattern for words with any ending, and for phrases as they stand."""
    return "|".join(re.escape(w) if " " in w or "-" in w else rf"\b{re.escape(w)}\w*" for w in words).replace("\\ ", " ").replace("\\-", "-")
