"""Words that contain a listed term, however it is disguised.

Terms and text are folded letter by letter: accents and look-alikes to plain
letters, digits and signs that stand for letters to those, upper to lower case,
repeated letters to one or two.  A trie with failure links finds all terms in
one pass over the folded text; every folded letter knows where it comes from, so a
hit leads back to the word that it starts in.  The automaton is built once per worker;
the list of terms has a checked bound.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs that stand for a letter, and letters that may stand twice.
STANDS_FOR = {"@": "a", "4": "a", "(": "c", "3": "e", "6": "g", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "ø": "o", "ß": "b", "ı": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x"}
TWICE = frozenset("beolsg")
#: Most terms of a list: an automaton of so many is a few hundred MB in a worker.
MOST_TERMS = 200_000


def folded(text: str) -> tuple[str, list[int]]:
    """Folded letters and the index in ``text`` that each comes from."""
    out, at, last, run = [], [], "", 0
    for i, raw in enumerate(text):
        for c in unicodedata.normalize("NFKD", raw).lower():
            if unicodedata.combining(c):
                continue
            c = STANDS_FOR.get(c, c)
            run = run + 1 if c == last else 1
            last = c
            if run <= (2 if c in TWICE else 1):
                out.append(c)
                at.append(i)
    return "".join(out), at


class Automaton:
    """A trie of folded terms; a term with ``|`` in front or behind must begin or end at a word's edge there."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, bool]]] = [[]]
        for term in sorted(set(terms)):
            word, _ = folded(term.strip("|"))
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                node = self.next[node][c]
            if word:
                self.ends[node].append((len(word), term.startswith("|"), term.endswith("|")))
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            node = waiting.popleft()
            for c, child in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0) if self.next[back].get(c, 0) != child else 0
                self.ends[child] = self.ends[child] + self.ends[self.fail[child]]
                waiting.append(child)

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """First and last place of each hit in folded ``text``."""
        node = 0
        for i, c in enumerate(text):
            while node and c not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(c, 0)
            for size, front, behind in self.ends[node]:
                first = i - size + 1
                if front and first and text[first - 1].isalnum() or behind and i + 1 < len(text) and text[i + 1].isalnum():
                    continue
                yield first, i


def words_hit(words: list[str], automaton: Automaton) -> list[int]:
    """Indexes of the words in which a hit starts, words standing a space apart."""
    text = " ".join(words)
    owner = [k for k, w in enumerate(words) for _ in range(len(w) + 1)]
    plain, at = folded(text)
    return sorted({owner[at[first]] for first, _ in automaton.hits(plain) if text[at[first]] != " "})


def term_hits(lines: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", marked: str | None = None) -> DataFrame:
    """``lines`` with ``word_at`` and ``word``, a row for each word in which a term starts.

    Words are runs without white space.  ``marked`` names an array of word
    indexes that are known already.  A null text has no words.
    """
    listed = [r[0] for r in terms.select(F.col(term).cast("string")).where(F.col(term).isNotNull()).distinct().limit(MOST_TERMS + 1).collect()]
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: scan with a part of them at a time")
    keep = [f for f in lines.schema.fields if f.name not in (text, marked)]
    names = [f.name for f in keep]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(listed)
        for batch in batches:
            known = [set(m if m is not None else ()) for m in batch[marked]] if marked else [()] * len(batch)
            words = [t.split() if t is not None else [] for t in batch[text]]
            hits = [[k for k in words_hit(w, automaton) if k not in m] for w, m in zip(words, known)]
            rows = [i for i, h in enumerate(hits) for _ in h]
            yield batch[names].iloc[rows].assign(word_at=[k for h in hits for k in h], word=[words[i][k] for i, h in enumerate(hits) for k in h]).astype(object)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return lines.mapInPandas(scan, schema + "word_at int, word string")


def suggestions(hits: DataFrame) -> DataFrame:
    """Hits rolled up over linked copies: one row per word of a template line, or of a line that is not linked.

    ``hits``: song, line_no, group_id, template_line, instance, detached,
    field, word_at, word.  ``fingerprint`` stays the same over edits elsewhere;
    a linked word found in one copy only goes by its line.
    """
    linked = F.col("group_id").isNotNull() & F.col("template_line").isNotNull() & ~F.coalesce(F.col("detached"), F.lit(False))
    key = F.regexp_replace(F.lower("word"), "[^a-z0-9]", "")
    shared = F.when(linked, F.concat_ws(":", F.lit("group"), "group_id", "template_line", "field", "word_at", key))
    own = F.concat_ws(":", "line_no", "field", "word_at", key)
    rows = hits.withColumns({"_own": own, "_shared": F.coalesce(shared, own), "_linked": linked})
    one = F.struct(F.coalesce("instance", F.lit(0)).alias("i"), F.col("line_no").alias("l"), F.col("word_at").alias("at"), F.col("word").alias("word"), F.col("_own").alias("own"))
    grouped = rows.groupBy("song", "field", "_shared", "_linked").agg(F.min(one).alias("r"), F.count("*").alias("copies"), F.array_sort(F.collect_list("line_no")).alias("lines"))
    several = F.col("_linked") & (F.col("copies") > 1)
    return grouped.select("song", F.when(several, F.col("_shared")).otherwise(F.col("r.own")).alias("fingerprint"), "field", F.col("r.l").alias("line_no"), F.col("r.at").alias("word_at"), F.col("r.word").alias("word"), "copies", "lines")
