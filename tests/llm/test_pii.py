"""Stand-ins over a whole table: collisions that really happen, coreference, distinctness, formats."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.llm import pii


def test_collisions_are_settled(spark):
    """1500 three-letter surnames have 9072 stand-ins, so some collide and are drawn again."""
    names = [a + b + c for a in "BCDFGKLMNP" for b in "aeiou" for c in "abcdefghiklmnoprstuvwxyzéèà"][:1500]
    d = spark.createDataFrame([(i, f"Mr {n} came. {n} left.") for i, n in enumerate(names)] + [(9999, None)], "doc_id long, text string")
    again = pii.retries(d).collect()
    assert sum(r.type == "surname" and r.attempt > 0 for r in again) > 20
    got = {r.doc_id: r.text for r in pii.pseudonymise(d).collect()}
    new = [re.fullmatch(r"Mr (\w+) came\. (\w+) left\.", got[i]).groups() for i in range(len(names))]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(names) and not {a for a, _ in new} & set(names)
    assert {r.doc_id: r.text for r in pii.pseudonymise(d, max_sent=0).collect()} == got and got[9999] is None


def test_planted_entities(spark):
    """Texts made of known pieces: every entity goes, unlike ones stay unlike, one has one stand-in, all else stays."""
    rng = random.Random(16)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    people = [(g, f"{first} {last}") for g, first, last in ((g, rng.choice(pii.GIVEN[g, "Latin"]), f"{rng.choice(['Wal', 'Brun', 'Oster', 'Lind', 'Hart'])}{rng.choice(['berg', 'ow', 'mann', 'ley', 'by'])}") for g in "mfmfmf" for _ in range(12))]
    title = {"m": "Mr", "f": "Mrs"}
    pool = [("email", f"u{i}.x@host{i % 7}.example.org") for i in range(60)] + [("ipv4", f"10.{i}.{i * 3 % 200}.7") for i in range(60)] + [("ssn", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}") for _ in range(60)]
    pool += [("card", f"4{digits(15)}") for _ in range(60)] + [("phone", f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}") for _ in range(60)]
    pool += [("secret", f"{rng.getrandbits(160):040x}") for _ in range(30)] + [("secret", f"{rng.getrandbits(800):0200x}") for _ in range(5)]
    pool += [("iban", f"DE{pii.iban_check('DE', b)}{b}") for b in (digits(18) for _ in range(40))]
    texts, places = [], []
    for _ in range(250):
        parts, own = ["on the day of"], []
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.4:
                g, who = rng.choice(people)
                parts += [f"wrote {rng.choice([title[g], 'Dr.'])}", ("name", who), "and later", ("name", who.split()[1]), "again"]
            else:
                parts += ["they noted", rng.choice(pool), "down,"]
        text = ""
        for p in parts:
            piece = p if isinstance(p, str) else p[1]
            if not isinstance(p, str):
                own.append((len(text), len(text) + len(piece), p[0], piece))
            text += f"{piece} "
        texts.append(text)
        places.append(own)
    d = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("type", "form", "start", "id")})
    out = pii.pseudonymise(d, spans_col="spans").collect()
    assert len(out) == 251 and all(r.type == "type" and r.id == "id" for r in out)
    new_of, old_of, shape = defaultdict(set), defaultdict(set), lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", t)))
    for r in out:
        old, own = texts[r.doc_id], places[r.doc_id]
        assert [(s.start, s.end, s.type) for s in r.spans] == [o[:3] for o in own]
        at = 0
        for s, (a, b, kind, piece) in zip(r.spans, own, strict=True):
            assert r.text[at : s.new_start] == old[(own[own.index((a, b, kind, piece)) - 1][1] if s != r.spans[0] else 0) : a]
            new, at = r.text[s.new_start : s.new_end], s.new_end
            new_of[kind, piece].add(new)
            old_of[kind, new].add(piece)
            assert new != piece
            if kind in ("ipv4", "ssn", "card", "phone", "iban"):
                assert shape(new) == shape(piece)
            if kind == "iban":
                assert pii.iban_check(new[:2], new[4:]) == new[2:4]
            if kind == "card":
                assert pii.luhn(new) == pii.luhn(piece)
        assert r.text[at:] == (old[own[-1][1] :] if own else old)
    assert all(len(v) == 1 for v in new_of.values()) and all(len(v) == 1 for v in old_of.values())
    assert not {n for _, n in old_of} & {p for _, p in new_of}
    for g, who in people:  # the surname alone is that of the full name, and the given name is of the gender
        if ("name", who) in new_of:
            new = next(iter(new_of["name", who]))
            assert new.split()[-1] == next(iter(new_of["name", who.split()[1]]))
            assert all(n in pii.GIVEN[g, "Latin"] for n in new.split()[0].split("-"))


def test_other_scripts_and_untitled_names():
    text = "г-н Иван Петров пишет; потом Петров ушёл. Prof. Σοφία Παππά. We met Anna Karlsson and std::vector at 2001:db8::1 or 555 123 4567."
    out, spans = pii.replaced(text, {})
    assert [(s["type"], text[s["start"] : s["end"]]) for s in spans] == [("name", "Иван Петров"), ("name", "Петров"), ("name", "Σοφία Παππά"), ("name", "Anna Karlsson"), ("ipv6", "2001:db8::1"), ("phone", "555 123 4567")]
    new = [out[s["new_start"] : s["new_end"]] for s in spans]
    assert new[0].split()[0] in pii.GIVEN["m", "Cyrillic"] and new[0].split()[1] == new[1] and re.fullmatch(r"[А-ЯЁ][а-яё]+", new[1])
    assert re.fullmatch(r"[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώ]+ [Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώ]+", new[2]) and new[3].split()[0] in pii.GIVEN["f", "Latin"]


def test_columns_in_the_way_and_long_texts(spark):
    d = spark.createDataFrame([(1, "x " * 300_000 + "mail a.b@c.org " + 'api_key = "' + "q1" * 200 + '"')], "doc_id long, text string")
    row = pii.pseudonymise(d, spans_col="spans").first()
    assert [s.type for s in row.spans] == ["email", "secret"] and "a.b@c.org" not in row.text and "q1q1" not in row.text
    with pytest.raises(ValueError):
        pii.pseudonymise(d.withColumn("spans", F.lit(1)), spans_col="spans")


def test_names_have_room_on_later_attempts():
    short = [a + b + c for a in "BCDFG" for b in "aeiou" for c in "bcdfghklmnprst"]
    assert len({pii.surrogate("name", x, "", attempt=4) for x in short}) == len(short)
    assert len(pii.surrogate("name", "Xab", "", attempt=4)) >= 11


def test_one_stand_in_for_several_titles(spark):
    d = spark.createDataFrame([(0, "Dr. Anna Braun"), (1, "Mrs Anna Braun")], "doc_id long, text string")
    assert len({r.text.split(" ", 1)[1] for r in pii.pseudonymise(d).collect()}) == 1
