"""Marks the terms of a glossary in texts, with one automaton for all of them.

Occurrences are taken from left to right, of those that begin at one place the longest, so no marked
term is inside another.  A term stands alone: neither before nor behind it is an ASCII letter or digit.
The text is taken as it is (case counts), as HTML that is escaped already.
"""

from __future__ import annotations

import html
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow import small_batches, tidy

_PART_OF_WORD = set(string.ascii_letters + string.digits)


def automaton(terms: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in terms:
        if term:
            a.add_word(term, term)
    a.make_automaton()
    return a


def occurrences(text: str, known: ahocorasick.Automaton) -> Iterator[tuple[int, str]]:
    """(begin, term) of the terms that are marked."""
    if not len(known):
        return
    longest: dict[int, str] = {}
    for last, term in known.iter(text):
        begin = last - len(term) + 1
        alone = (begin == 0 or text[begin - 1] not in _PART_OF_WORD) and (last + 1 == len(text) or text[last + 1] not in _PART_OF_WORD)
        if alone and len(term) > len(longest.get(begin, "")):
            longest[begin] = term
    free = 0
    for begin in sorted(longest):
        if begin >= free:
            yield begin, longest[begin]
            free = begin + len(longest[begin])


def mark(text: str, terms: dict[str, str], known: ahocorasick.Automaton) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with marked terms, and (term, place of its first occurrence, how many) in the order of their first."""
    out, at, used = [], 0, {}
    for begin, term in occurrences(text, known):
        out += [text[at:begin], f'<span class="gloss" title="{html.escape(terms[term]).replace("&#x27;", chr(39))}">{term}</span>']
        at = begin + len(term)
        first, n = used.get(term, (begin, 0))
        used[term] = (first, n + 1)
    return "".join([*out, text[at:]]), [(t, first, n) for t, (first, n) in used.items()]


def annotate_terms(df: DataFrame, terms: dict[str, str], text: str = "text") -> DataFrame:
    """df with its text marked, and ``terms``: array of (term, first, n); a null text is empty.

    ``terms`` is a glossary, from term to explanation; it goes to every task.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, "terms")]
    kind = pa.list_(pa.struct([("term", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(terms)
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            done = [mark(t or "", terms, known) for t in at[text].to_pylist()]
            found = pa.array([[{"term": t, "first": f, "n": n} for t, f, n in used] for _, used in done], kind)
            yield pa.RecordBatch.from_arrays([*[at[c] for c in kept], pa.array([t for t, _ in done], pa.string()), found], [*kept, text, "terms"])
        tidy()

    columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, text).mapInArrow(run, f"{columns}, `{text}` string, terms array<struct<term:string,first:bigint,n:bigint>>")
