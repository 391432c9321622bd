"""Licence scans by fuzzy search for short notices (operator 2).

A notice may differ from its wording in at most k characters (inserted, dropped or changed). Cut into k + 1 pieces,
one piece of it must stand in the text unharmed (pigeonhole), so one Aho-Corasick pass over all pieces finds every
candidate; around each the regex library's bounded-error matching verifies the edits and gives the span. Texts are
searched as lower-cased words joined by single blanks.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import bytes_of, map_batches

#: Phrases that count wherever their words stand in sequence.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: Notices to find with errors, as label, words and number of errors.
NOTICES = (
    ("gpl", "licensed under the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    ("bsd", "licensed under the bsd license", 3),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by", "licensed under cc by 4 0", 1),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1),
    ("cc0", "dedicated to the public domain", 3),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
    ("all-rights-reserved", "all rights reserved", 2),
)
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HIT = "struct<label:string,first_word:long,last_word:long,edits:int,exact:boolean,score:double>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@functools.lru_cache(maxsize=4)
def _searcher(notices: tuple) -> tuple[ahocorasick.Automaton, list]:
    """The automaton over all pieces, each with (notice, its offset), and the patterns."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for n, (_, wording, k) in enumerate(notices):
        edges = [round(i * len(wording) / (k + 1)) for i in range(k + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            seeds.setdefault(wording[a:b], []).append((n, a))
    machine = ahocorasick.Automaton()
    for piece, places in seeds.items():
        machine.add_word(piece, (len(piece), places))
    machine.make_automaton()
    return machine, [regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(wording, special_only=True)}){{e<={k}}}(?![^ ])") for _, wording, k in notices]


def fuzzy_spans(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in a text of words and blanks: per notice non-overlapping best matches.

    A match begins and ends at word boundaries. Candidates of one notice whose windows touch are verified together.
    """
    machine, patterns = _searcher(notices)
    windows: dict[int, list[list[int]]] = {}
    # A piece says where its notice would begin, give or take k.
    for end, (size, places) in machine.iter(text):
        for n, offset in places:
            _, wording, k = notices[n]
            begin = end + 1 - size - offset
            low, high = max(0, begin - k), min(len(text), begin + len(wording) + k)
            own = windows.setdefault(n, [])
            if high - low < len(wording) - k:
                continue
            if own and low <= own[-1][2]:  # these begin close together: one search covers both
                own[-1][1] = max(own[-1][1], high)
                own[-1][2] = max(own[-1][2], begin + k)
            else:
                own.append([low, high, begin + k])
    out = []
    for n, own in windows.items():
        wording, k = notices[n][1], notices[n][2]
        taken = -1
        for low, high, _ in sorted(own):
            if not _near(text[low:high], wording, k):
                continue
            for m in patterns[n].finditer(text, max(low, taken), high):
                a, b = m.span()
                if a >= taken and (a == 0 or text[a - 1] == " " or text[a] == " ") and (b == len(text) or text[b] == " " or text[b - 1] == " "):
                    out.append((n, a, b, sum(m.fuzzy_counts)))
                    taken = b
    return out


def _near(window: str, wording: str, k: int) -> bool:
    """A bound that spares most searches: k edits change at most k letters of the wording's multiset."""
    missing = 0
    for c in set(wording):
        lack = wording.count(c) - window.count(c)
        if lack > 0:
            missing += lack
            if missing > k:
                return False
    return True


def scan(text: bytes, base: dict = BASE, notices: tuple = NOTICES) -> tuple[int, list[dict]]:
    """Number of words, and the hits with word positions."""
    words = words_of(text)
    joined = b" ".join(words).decode("utf-8", "surrogateescape")
    framed, hits = f" {joined} ", []
    for label, phrase in base.items():
        if f" {phrase} " not in framed:
            continue
        at = framed.find(f" {phrase} ")
        while at >= 0:
            first = framed.count(" ", 0, at)
            hits.append({"label": label, "first_word": first, "last_word": first + phrase.count(" "), "edits": 0, "exact": True, "score": 1.0})
            at = framed.find(f" {phrase} ", at + 1)
    for n, a, b, edits in fuzzy_spans(joined, notices):
        a, b = a + (joined[a] == " "), b - (joined[b - 1] == " ")
        first = joined.count(" ", 0, a)
        hits.append({"label": notices[n][0], "first_word": first, "last_word": first + joined.count(" ", a, b), "edits": edits, "exact": False, "score": 1 - edits / len(notices[n][1])})
    return len(words), hits


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict = BASE, notices: tuple = NOTICES) -> DataFrame:
    """(id, n_words, hits): hits hold label, word span, edits, whether exact, and score 1 - edits / length.

    Map-only over whole texts; null counts as empty; repeated rows each give a row; other columns are ignored.
    """
    of_id = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t, base, notices) for t in bytes_of(batch)]
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], kind)], ["id", "n_words", "hits"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {of_id}, n_words long, hits array<{HIT}>").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of figures per scanned text: places of base phrases, labels, and the best score."""
    exact = F.filter("hits", lambda h: h["exact"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    firsts = F.transform(exact, lambda h: h["first_word"])
    return scanned.select(id_col, "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"), F.size("hits").cast("long").alias("n_hits"))
