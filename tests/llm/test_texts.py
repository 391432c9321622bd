"""Operators that look at one text at a time, against libraries or plain versions."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandframe.llm import license_scan, pii, quality, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, rows, none, by_id):
    texts = [t or "" for _, t, *_ in rows]
    want = sorted(((i, len(t.encode()), n) for (i, *_), t, n in zip(rows, texts, library_counts(texts), strict=True)), key=lambda t: (t[0] is not None, str(t[0]), str(t)))
    got = by_id(token_counts.token_counts(docs, BPE), "doc_id", "n_bytes", "n_tokens")
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_counts.token_counts(none, BPE).count() == 0


def test_token_counts_of_odd_strings():
    rng = random.Random(5)
    letters = "aetslvrmd' '  \n\t'1290!?.,-éßñ漢字ن́  \x85\x00\x1c🎉ǅⅧ²½_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(1500)]
    texts += ["a" * 3000, "-" * 2000, " " * 900, "'ll'l've'v're'r's'd'm't''s 's", "<|endoftext|>", "a <|endoftext|>  b", "x" * 700 + "'" * 700]
    assert token_counts.Counter(BPE).batch(texts).tolist() == library_counts(texts)


def test_chunk_maps_agree_with_one_walk(monkeypatch):
    rng = random.Random(1)
    import numpy as np

    kinds = np.array([rng.randrange(1, token_counts.N_CLASSES) for _ in range(3000)] + [0], np.uint8)
    whole = token_counts.split_marks(kinds)
    for chunk in (1, 2, 7, 64):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert (token_counts.split_marks(kinds) == whole).all()


def test_license_base(docs, rows, none):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.digest(license_scan.scan_licenses(docs)).collect()}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at, labels = [], set()
        for label, phrase in license_scan.BASE.items():
            p = phrase.split()
            hit = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        assert (i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))) in got
    assert license_scan.digest(license_scan.scan_licenses(none)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_license_fuzzy():
    rng = random.Random(2)
    for label, wording, k in license_scan.NOTICES:
        for _ in range(6):
            text = list(wording)
            for _ in range(rng.randrange(k + 1)):
                at = rng.randrange(1, len(text) - 1)
                rng.choice([lambda t=text, a=at: t.__setitem__(a, "q"), lambda t=text, a=at: t.insert(a, "q"), lambda t=text, a=at: t.pop(a)])()
            near = " ".join("".join(text).split())
            if edits(near, wording) > k:  # a word that is gone takes its blank along
                continue
            _, hits = license_scan.scan(f"before it {near} after it".encode())
            assert label in {h["label"] for h in hits if not h["exact"]}, (near, wording)
            for h in hits:
                assert 0 < h["score"] <= 1
    _, hits = license_scan.scan(b"all right reversed is not near nothing")
    assert not [h for h in hits if h["label"] == "gpl"]


def test_quality(docs, rows, none):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(docs, PIECES).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        three = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {k + d for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed) in got
    assert quality.verdicts(none, PIECES).count() == 0
    with pytest.raises(ValueError):
        quality.measures(docs.withColumn("script", F.lit(1)), PIECES)


def test_quality_measures_of_single_words(docs, rows):
    """Fertility, byte share, entropy and verdict from the library's own cuts, word by word."""
    import math
    import unicodedata

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        pieces = Counter(p for w in words for p in model.encode(w))
        n, chars = sum(pieces.values()), sum(map(len, words))
        entropy = abs(sum(c / n * math.log2(c / n) for c in pieces.values())) if n else None
        fallback = sum(c for p, c in pieces.items() if model.is_byte(p)) / n if n else None
        scripts = Counter(next((s for s in ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "CJK", "HIRAGANA", "KATAKANA") if unicodedata.name(c, "").startswith(s)), "") for c in text if c.isalpha())
        del scripts[""]
        script = max(scripts, key=scripts.get).capitalize() if scripts else "other"
        three = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {k + d for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for d in range(3)}
        low, high, most, least = quality.BANDS[lang if lang in quality.BANDS else script]
        base = len(words) < 50 or 100 * len(again) > 50 * len(words)
        kept = not base and low <= chars / n <= high and fallback <= most and entropy >= least * min(1, math.log2(n) / math.log2(100))
        want.append((i, n, n and round(chars / n, 6), n and round(fallback, 6), n and round(entropy, 6), kept))
    got = quality.verdicts(docs, PIECES).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.n_tokens and round(r.chars_per_token, 6), r.n_tokens and round(r.byte_share, 6), r.n_tokens and abs(round(r.entropy, 6)), r.kept)) for r in got)
    with pytest.raises(ValueError):
        quality.verdicts(docs.withColumn("kept", F.lit(1)), PIECES)


def test_quality_keeps_clean_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    judged = quality.verdicts(d, PIECES).where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and not kept").count() > 0


def test_surrogates_are_one_to_one_and_typed():
    rng = random.Random(3)
    cards = {"".join(rng.choice("0123456789") for _ in range(16)) for _ in range(3000)}
    new = {pii.surrogate("card", c, "") for c in cards}
    assert len(new) == len(cards)
    assert all(pii.luhn(pii.surrogate("card", c, "")) for c in cards if pii.luhn(c))
    mails = {f"{a}.{n}@mail{n % 9}.example.com" for a in "abcdefghij" for n in range(200)}
    assert len({pii.surrogate("email", m, "") for m in mails}) == len(mails)
    ips = {f"{rng.randrange(256)}.{rng.randrange(256)}.7.{n % 256}" for n in range(2000)}
    made = [pii.surrogate("ipv4", x, "") for x in ips]
    assert len(set(made)) == len(ips) and all(all(0 <= int(p) < 256 for p in m.split(".")) for m in made)
    text = "Mr. John Smith and Mrs Anna Müller, +1 (437) 555-0689, 4111 1111 1111 1111, Foo@Bar.org foo@bar.org, 10.0.0.1; token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""
    out, spans = pii.replaced(text, {})
    assert [s["type"] for s in spans] == ["name", "name", "phone", "card", "email", "email", "ipv4", "secret"]
    news = [out[s["new_start"] : s["new_end"]] for s in spans]
    assert news[4].lower() == news[5] and news[0].split()[0] in pii.GIVEN["m", "Latin"] and news[1].split()[0] in pii.GIVEN["f", "Latin"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", news[2]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", news[3])
    assert not any(text[s["start"] : s["end"]] in out for s in spans)
    assert pii.replaced("version 1.2.3 of 2024, chapter 7", {}) == ("version 1.2.3 of 2024, chapter 7", [])


def test_surrogates_of_a_table(spark, docs, none):
    names = spark.createDataFrame([(i, f"Dear Mr. {a}{b} of {i}, write to a.{b}@x.org") for i, (a, b) in enumerate((x, y) for x in ("Ab", "Be", "Co") for y in "abcdefghijklmnop")], "doc_id long, text string")
    again = pii.pseudonymise(names, spans_col="spans").collect()
    seen = {}
    for r in again:
        for s, old in zip(r.spans, pii.entities(names.where(f"doc_id = {r.doc_id}").first().text), strict=True):
            seen.setdefault((s.type, r.text[s.new_start : s.new_end]), set()).add(names.where(f"doc_id = {r.doc_id}").first().text[old[0] : old[1]])
    assert all(len(v) == 1 for v in seen.values())
    done = pii.pseudonymise(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.where("doc_id = 900001 and text is null").count() == 1
    assert pii.pseudonymise(none).count() == 0
