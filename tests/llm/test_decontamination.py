"""Decontamination where one slot differs, and names that open sentences or begin with other letters."""

import random
import re

from strandframe.llm import decontamination

TAIL = b"apples in a basket beside the old well and walks home along the quiet river with"


def met(item, text):
    return decontamination.batch_matches([text], decontamination.Items([(1, item)], 8)).get(0, [])


def test_verbatim_part_of_an_inconsistent_run():
    item = b"a farmer puts 12 " + TAIL + b" 12 pears left"
    assert met(item, item.replace(b"puts 12", b"puts 15"))[0][3] > decontamination.COVER
    # a passage with all values new and one of them inconsistent stays no match
    assert not met(b"of 12 apples and 5 kg he gives 12 apples away", b"of 30 apples and 7 kg he gives 31 apples away")


def test_names_that_open_sentences():
    item = b"Anna has 3 apples. Anna buys 4 more. Peter takes 2 apples. Anna counts the rest."
    new = b"Carla has 5 apples. Carla buys 9 more. Jonas takes 1 apples. Carla counts the rest."
    assert met(item, new)[0][3:] == (1.0, True)
    assert met(item, item)[0][3:] == (1.0, False)
    assert met(item, new.replace(b"Carla buys", b"Lea buys"))[0][3] < 1  # Anna became two persons


def test_names_of_other_letters():
    item = "then we saw how Élise gave 3 plums to Ömer".encode()
    assert met(item, "then we saw how Jean gave 9 plums to Paul".encode())[0][3:] == (1.0, True)


def test_benchmark_rows_without_or_with_one_id(spark):
    passage = lambda c: " ".join(f"{c}{i}" for i in range(20))
    benchmark = spark.createDataFrame([(None, passage("a")), (7, passage("b")), (7, passage("c")), (7, passage("c")), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage('a')} y"), (2, passage("b")), (3, passage("c")), (4, "nothing"), (5, None), (2, passage("b"))], "doc_id long, text string")
    for limit in (decontamination.MAX_SENT, 0):
        got = decontamination.contaminated(docs, benchmark, max_sent=limit)
        assert sorted(map(str, ((r.doc_id, r.item_id, r.n_tokens) for r in got.collect()))) == ["(1, None, 20)", "(2, 7, 20)", "(2, 7, 20)", "(3, 7, 20)"]
        assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark, max_sent=limit).collect()) == [4, 5]


def test_long_passage_of_a_longer_item():
    words = [f"w{i}" for i in range(200)]
    hit = met(" ".join(words).encode(), " ".join(words[20:80]).encode())[0]
    assert hit[3] < decontamination.COVER and decontamination.counts(hit, decontamination.COVER, decontamination.ENOUGH)
    assert not decontamination.counts(met(" ".join(words).encode(), " ".join(words[20:60]).encode())[0], decontamination.COVER, decontamination.ENOUGH)


class Plain:
    """The definition written out: tokens by regular expressions, all windows met by their tokens, no hashes."""

    UNITS, NUMBERS = {u.decode() for u in decontamination.UNITS}, {w.decode() for w in decontamination.NUMBER_WORDS}

    def __init__(self, text):
        raws = re.findall(r"[^ \t\n\v\f\r]+", text)
        self.words, self.variants, self.token, self.names = [], [[], [], []], [], []
        opens, number = True, False
        for raw in raws:
            bare = raw.strip(".,;:!?\"'()[]{}*#$%&|<>")
            low = re.sub("[A-Z]", lambda m: m[0].lower(), bare)
            ends = raw.rstrip("\"')]}*#$%&|")[-1:] in (".", "!", "?", ":") and raw.rstrip("\"')]}*#$%&|") != ""
            if bare:
                united = re.fullmatch(r"([+-]?[0-9][0-9.,]*)([a-z]+)", low)
                wordy = re.match("[a-z]", low)
                capital = bare[0].isupper() and not bare.isupper()
                if low in self.NUMBERS or (not wordy and re.fullmatch(r"[$€£]*[+-]?[0-9][0-9.,:/%]*(st|nd|rd|th)?", low)):
                    kinds, slot, name = ["<n>"] * 3, "<n>", False
                elif not wordy and united and united[2] in self.UNITS:
                    kinds, slot, name = ["<nu>"] * 3, "<nu>", False
                elif low in self.UNITS and number and not capital:
                    kinds, slot, name = ["<u>"] * 3, "<u>", False
                elif capital:
                    kinds, slot, name = [low if opens else "<p>", low, "<p>"], low if opens else "<p>", True
                else:
                    kinds, slot, name = [low] * 3, low, False
                for v, k in zip(self.variants, kinds, strict=True):
                    v.append(k)
                self.token.append(slot)
                self.words.append(low)
                self.names.append(name)
                number = kinds[0] == "<n>"
            opens = ends

    def slot(self, k):
        return self.token[k] in ("<n>", "<nu>", "<u>", "<p>")


def plain_match(doc, item, window=8):
    """(tokens covered, whether only slots differ), or None."""
    n = min(window, len(item.token))
    if not n:
        return None
    theirs = {}
    for v in item.variants:
        for q in range(len(v) - n + 1):
            theirs.setdefault(tuple(v[q : q + n]), set()).add(q)
    pairs = sorted({(p, q) for v in doc.variants for p in range(len(v) - n + 1) for q in theirs.get(tuple(v[p : p + n]), ())})
    covered, done, changed = set(), set(), False
    for p, q in pairs:
        if (p, q) in done:
            continue
        tried = []
        for loose in (True, False):
            slots = {}

            def alike(k, slots=slots, loose=loose, p=p, q=q):
                a, b = p + k, q + k
                if not (0 <= a < len(doc.token) and 0 <= b < len(item.token)):
                    return False
                if doc.token[a] == item.token[b] or doc.words[a] == item.words[b]:
                    return True
                return loose and doc.names[a] and item.names[b] and slots.setdefault(item.words[b], doc.words[a]) == doc.words[a]

            if all(alike(k) for k in range(n)):
                a, b = 0, n
                while alike(a - 1):
                    a -= 1
                while alike(b):
                    b += 1
                fits = all(slots.setdefault(item.words[q + k], doc.words[p + k]) == doc.words[p + k] for k in range(a, b) if item.slot(q + k))
                tried.append((a, b, slots, fits))
        if not tried:
            continue
        a, b, slots, fits = next((t for t in tried if t[3]), tried[-1])
        done |= {(p + k, q + k) for k in range(a, b)}
        if fits:
            covered |= set(range(q + a, q + b))
            changed |= any(x != y for x, y in slots.items())
        else:
            run = []
            for k in range(a, b + 1):
                if k < b and doc.words[p + k] == item.words[q + k]:
                    run.append(q + k)
                else:
                    covered |= set(run) if len(run) >= n else set()
                    run = []
    return (len(covered), changed) if covered else None


def test_query_against_plain_windows(spark):
    rng = random.Random(15)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items += [(1000, "Anna has 12 apples and 5 kg of flour. How many of the 12 apples does Anna give to Peter after 3 days?"), (1001, "Just four short words")]
    swap = lambda t, **new: re.sub("|".join(new), lambda m: new[m[0]], t)
    docs += [(5000, swap(items[-2][1], Anna="Élise", Peter="Jan")), (5001, swap(items[-2][1], Anna="Mia") + " x"), (5002, "so just four short words it is"), (5003, items[-2][1].replace("the 12", "the 13")), (5004, "")]
    for k in range(40):  # passages cut, joined and with words changed
        words = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(words) - 8))
        part = words[a : a + rng.randrange(8, 60)]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = rng.choice(["77", "Bob", "and", "12 kg"])
        docs.append((6000 + k, " ".join([*rng.choice(docs)[1].split()[:30], *part])))
    plain_items = [(i, Plain(t)) for i, t in items]
    want = []
    for d, text in docs:
        doc = Plain(text or "")
        for i, item in plain_items:
            m = plain_match(doc, item)
            if m and (m[0] >= 0.6 * len(item.token) or m[0] >= 50):
                want.append((d, i, *m))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (decontamination.MAX_SENT, 0):
        got = [(r.doc_id, r.item_id, r.n_tokens, r.reparameterised) for r in decontamination.contaminated(table, benchmark, max_sent=limit).collect()]
        assert sorted(got) == sorted(want)
    assert len(want) > 15
