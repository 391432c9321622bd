"""PII surrogates (operator 6).

Detected entities are replaced by keyed stand-ins of the same type, length and format: letters become letters of
the same script and case, digits digits, check digits fit again, everything else stays. A keyed Feistel walk over the
entity's positions makes the mapping one-to-one within a format, so unlike entities stay unlike and one entity has one
stand-in in all documents (coreference) without any table. What a walk cannot promise is checked over the whole corpus:
a stand-in must not equal an original, and two entities of a type must not meet in one stand-in; those that do
(personal names draw from lists, so they can) get the next attempt, from a larger space, until none is left. A surname
has one stand-in wherever it stands, alone or after given names.

Names are found after a title, after a common given name, after words that introduce a name, and wherever a name so
found is mentioned again in the same text, in full or by surname; given names alone stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandframe.llm._common import cut, map_batches, texts_of

#: Settled entities that are sent to every executor at most; beyond, they are joined by text.
MAX_SENT, ROUNDS = 200_000, 6
KEY = "surrogates-1"

#: Given names by gender and script.
GIVEN = {
    ("m", "Latin"): "James Robert John Michael David William Thomas Daniel Paul Mark Peter Lukas Felix Jonas Louis Hugo Arthur Carlos Miguel Javier".split(),
    ("f", "Latin"): "Mary Anna Linda Susan Sarah Karen Nancy Laura Emma Julia Sophie Clara Marie Camille Alice Carmen Lucia Elena Ines Paula".split(),
    ("m", "Cyrillic"): "Иван Пётр Алексей Дмитрий Николай Сергей Андрей Михаил Виктор Павел".split(),
    ("f", "Cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Вера Нина".split(),
    ("m", "Greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
    ("f", "Greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Βασιλική Δήμητρα".split(),
}
#: Titles by gender, and words that introduce a name.
_TITLES_M, _TITLES_F = r"Mr|Herr|Monsieur|M|Señor|Sr|Don|Sir|Lord|г-н|[Гг]осподин|[Κκ]ος", r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Lady|Madam|г-жа|[Гг]оспожа|[Κκ]α"
_LEADS = ("my name is ", "My name is ", "Name: ", "name: ")
_NAME = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’-]+|[А-ЯЁ][а-яё-]+|[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ-]+)"
_GENDER = {n: g for (g, _), names in GIVEN.items() for n in names}
#: Detectors in order of precedence; a match may not overlap an earlier one's.
DETECTORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|sk|pk|xox[bp])[_-][A-Za-z0-9_-]{16,}|(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])|(?i:(?<![A-Za-z])(?:password|passwd|secret|api[_-]?key|token)\s{0,3}[=:]\s{0,3}[\"'])(?P<v>[^\s\"']{6,})(?=[\"'])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("ipv6", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    ("ipv4", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")),
    ("ssn", re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])(?!\.\d)")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4})(?![\w-])")),
    ("name", re.compile(rf"(?<!\w)(?:(?:(?P<m>(?:{_TITLES_M})\.?)|(?P<f>(?:{_TITLES_F})\.?)|(?P<n>(?:Dr|Prof)\.)|(?:[Mm]y name is|[Nn]ame:)) (?P<v>{_NAME}(?: {_NAME}){{0,2}})|(?P<w>(?:{'|'.join(_GENDER)})(?: {_NAME}){{1,2}}))(?!\w)")),
)
_QUOTED = re.compile(r"[=:]\s{0,3}[\"']")


@functools.cache
def _hints() -> ahocorasick.Automaton:
    """Strings without which a name, an address or a key cannot stand in a text."""
    machine = ahocorasick.Automaton()
    titles = re.sub(r"\[(.)(.)\](\w+)", r"\1\3|\2\3", f"{_TITLES_M}|{_TITLES_F}|Dr|Prof").split("|")
    for title in titles:
        for end in (" ", ". "):
            machine.add_word(title + end, "name")
    for lead in (*_LEADS, *(f"{n} " for names in GIVEN.values() for n in names)):
        machine.add_word(lead, "name")
    for lead in ("ghp_", "ghp-", "gho_", "gho-", "sk_", "sk-", "pk_", "pk-", *(f"xox{c}{d}" for c in "bp" for d in "_-")):
        machine.add_word(lead, "secret")
    machine.add_word("@", "email")
    machine.make_automaton()
    return machine


_NAME_PARTS = "ba be bo da de do fa fe ga ge ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te va ve wa wi".split()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, gender) of the entities in a text, in order; gender is '' but for names.

    A run of 13 to 19 digits is a card number whether or not its check digit fits.
    """
    digit = any(d in text for d in "0123456789")
    near = {kind for _, kind in _hints().iter(text)}
    if digit or (("'" in text or '"' in text) and _QUOTED.search(text)):
        near.add("secret")
    if not digit and not near:
        return []
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in DETECTORS:
        if kind not in near and (not digit or kind in ("name", "email")):  # no match without these
            continue
        for m in pattern.finditer(text):
            named = m.groupdict()
            a, b = next((m.span(g) for g in ("v", "w") if named.get(g)), m.span())
            if all(b <= x or y <= a for x, y, *_ in found):
                gender = "m" if named.get("m") else "f" if named.get("f") else _GENDER.get(text[a:b].split(" ")[0], "") if kind == "name" and " " in text[a:b] else ""
                found.append((a, b, kind, gender))
    return sorted(found + _mentions(text, found))


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further places of the names found in a text: the whole name, or its last part alone."""
    known = {}
    for a, b, kind, gender in found:
        if kind == "name":
            whole = text[a:b]
            for form in (whole, whole.split(" ")[-1]):
                known[form] = known.get(form) or gender
    if not known:
        return []
    again = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(k) for k in sorted(known, key=len, reverse=True))})(?!\w)")
    taken = sorted((a, b) for a, b, *_ in found)
    starts = [a for a, _ in taken]
    out = []
    for m in again.finditer(text):
        at = bisect.bisect_right(starts, m.start()) - 1
        if (at < 0 or taken[at][1] <= m.start()) and (at + 1 == len(taken) or m.end() <= starts[at + 1]):
            out.append((*m.span(), "name", known[m[0]]))
    return out


def normal(kind: str, surface: str) -> str:
    """The same person or account in one spelling: separators of numbers, case of addresses."""
    if kind in ("card", "iban", "phone", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", surface).upper()
    if kind in ("email", "ipv6"):
        return surface.lower()
    return surface


@functools.lru_cache(maxsize=50_000)
def _stream(key: str, tag: str) -> int:
    return int.from_bytes(hmac.digest(key.encode(), tag.encode("utf-8", "surrogatepass"), hashlib.sha256), "big")


def walk(values: list[int], sizes: list[int], key: str, tag: str) -> list[int]:
    """A keyed one-to-one map of mixed-base numbers: halves take turns adding a keyed function of the other half."""
    values = list(values)
    half = (len(values) + 1) // 2
    for r in range(ROUNDS):
        mine, other = (range(half), range(half, len(values))) if r % 2 == 0 else (range(half, len(values)), range(half))
        drawn = _stream(key, f"{tag}|{sizes}|{r}|{[values[i] for i in other]}")
        spare = 256
        for i in mine:
            if spare < 40:
                drawn, spare = _stream(key, f"{tag}|{r}|{i}|{drawn}"), 256
            drawn, part = divmod(drawn, 1 << 20)
            spare -= 20
            values[i] = (values[i] + part) % sizes[i]
    return values


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ")
_PLACE = {c: (s, i) for s in _SETS for i, c in enumerate(s)}


def _spell(text: str, key: str, tag: str, fixed: frozenset[int] = frozenset(), hexed: bool = False) -> str:
    """The text with its letters and digits walked, each within its own alphabet; fixed positions stay."""
    sets = []
    for i, c in enumerate(text):
        if i in fixed or c not in _PLACE:
            continue
        chars, at = _PLACE[c]
        if hexed:
            chars = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
            if c not in chars:
                continue
            at = chars.index(c)
        sets.append((i, chars, at))
    if not sets:
        return text
    got = walk([at for *_, at in sets], [len(chars) for _, chars, _ in sets], key, tag)
    out = list(text)
    for (i, chars, _), v in zip(sets, got, strict=True):
        out[i] = chars[v]
    return "".join(out)


def iban_check(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def script_of(name: str) -> str:
    """The script of a name's first letter."""
    return unicodedata.name(next((c for c in name if c.isalpha()), "A"), "LATIN").split(" ")[0].capitalize()


def surrogate(kind: str, name: str, gender: str, key: str = KEY, attempt: int = 0, surname_attempt: int = 0) -> str:
    """The stand-in of an entity's normal form. A name of several parts keeps the stand-in of its last part, its surname."""
    tag = f"{kind}|{attempt}" if attempt else kind
    if kind == "ipv4":
        octets = [int(x) for x in name.split(".")]
        # within the same number of digits, so that the format holds
        bands = [(0, 10) if x < 10 else (10, 90) if x < 100 else (100, 156) for x in octets]
        got = walk([x - a for x, (a, _) in zip(octets, bands, strict=True)], [n for _, n in bands], key, f"{tag}|{[a for a, _ in bands]}")
        return ".".join(str(v + a) for v, (a, _) in zip(got, bands, strict=True))
    if kind == "card":
        fitting = lambda digits: next(d for d in range(10) if luhn(f"{digits}{d}"))
        body, off = _spell(name[:-1], key, tag), (int(name[-1]) - fitting(name[:-1])) % 10
        if off:  # a check digit that does not fit stays one that does not
            off = 1 + (off - 1 + _stream(key, f"{tag}|{body}")) % 9
        return f"{body}{(fitting(body) + off) % 10}"
    if kind == "phone":
        fixed = frozenset(range(len(name) - 10)) if name.startswith("+") and len(name) > 11 else frozenset({0, 1} if name.startswith("+") else ())
        return _spell(name, key, tag, fixed)
    if kind == "iban":
        if iban_check(name[:2], name[4:]) != name[2:4]:
            return _spell(name, key, tag, frozenset({0, 1}))
        body = _spell(name[4:], key, f"{tag}|{name[:2]}")
        return name[:2] + iban_check(name[:2], body) + body
    if kind == "email":
        local, _, domain = name.rpartition("@")
        host, dot, top = domain.rpartition(".")
        return f"{_spell(local, key, f'{tag}|l|{len(domain)}')}@{_spell(host, key, f'{tag}|d')}{dot}{top}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", name):
            return _spell(name, key, tag, hexed=True)
        lead = re.match(r"AKIA|ASIA|(?:ghp|gho|sk|pk|xox[bp])[_-]", name)
        return _spell(name, key, tag, frozenset(range(lead.end() if lead else 0)))
    if kind == "ipv6":
        return _spell(name, key, tag, hexed=True)
    if kind in ("name", "surname"):
        *given, last = name.split(" ")
        out = []
        for i, part in enumerate(given):
            names = GIVEN.get((gender, script_of(part)))
            if names:  # one more given name with each attempt, so the space grows
                out.append("-".join(names[_stream(key, f"given|{attempt}|{i}|{part}|{gender}|{n}") % len(names)] for n in range(attempt + 1)))
            else:
                out.append(_surname(part, key, f"given|{attempt}|{i}", attempt))
        times = surname_attempt if given else surname_attempt or attempt
        return " ".join([*out, _surname(last, key, f"surname|{times}", times)])
    return _spell(name, key, tag)


def _surname(part: str, key: str, tag: str, attempt: int) -> str:
    """A made-up name of the part's script, longer with each attempt."""
    if script_of(part) != "Latin":
        return _spell(part, key, tag) + (_spell(part.lower(), key, f"{tag}|more") if attempt else "")
    drawn, sound = divmod(_stream(key, f"{tag}|{part}"), 7)
    made = ""
    while len(made) < max(3, min(len(part), 12)) + 2 * attempt:
        drawn, n = divmod(drawn, len(_NAME_PARTS))
        made += _NAME_PARTS[n]
    return made.capitalize() + "nrslmkt"[sound]


def dressed(surface: str, normal_form: str, stand_in: str) -> str:
    """The stand-in in the format of the surface: separators and letter case of the original come back."""
    if surface == normal_form or len([c for c in surface if c.isalnum() or c == "+"]) != len(stand_in):
        if surface.lower() == normal_form and len(surface) == len(stand_in):
            return "".join(c.upper() if s.isupper() else c for s, c in zip(surface, stand_in, strict=True))
        return stand_in
    chars = iter(stand_in)
    return "".join(next(chars) if c.isalnum() or c == "+" else c for c in surface)


def replaced(text: str, settled: dict[tuple[str, str], tuple[int, str]], key: str = KEY) -> tuple[str, list[dict]]:
    """The text with stand-ins, and the spans: offsets in the original and in the new text.

    settled has the attempt and the gender of the forms for which these are not 0 and that of the mention.
    """
    out, at, grown, spans = [], 0, 0, []
    for a, b, kind, gender in entities(text):
        surface = text[a:b]
        form = normal(kind, surface)
        attempt, gender = settled.get((kind, form), (0, gender))
        surname_attempt = settled.get(("surname", form.split(" ")[-1]), (0, ""))[0] if kind == "name" else 0
        new = dressed(surface, form, surrogate(kind, form, gender, key, attempt, surname_attempt))
        out += [text[at:a], new]
        spans.append({"type": kind, "start": a, "end": b, "new_start": a + grown, "new_end": a + grown + len(new)})
        grown += len(new) - (b - a)
        at = b
    return ("".join(out) + text[at:] if spans else text), spans


def _forms(text: str) -> set[tuple[str, str, str]]:
    """(type, form, gender) of a text's entities; the last part of a name is a surname besides."""
    own = {(kind, normal(kind, text[a:b]), gender) for a, b, kind, gender in entities(text)}
    return own | {("surname", form.split(" ")[-1], "") for kind, form, _ in own if kind == "name"}


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """(type, form, gender) of the entities of all texts, each once per run of rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sorted(set().union(*map(_forms, texts_of(batch))))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], pa.string()) for i in range(3)], ["type", "form", "gender"])

    return map_batches(docs.select(F.col(text_col).alias("text")), run, "type string, form string, gender string")


def _drawn(forms: DataFrame, key: str) -> DataFrame:
    """forms (type, form, gender, last, attempt) with their stand-ins in the column new."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [surrogate(kind, form, gender, key, attempt, last) for kind, form, gender, last, attempt in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "new"])

    return map_batches(forms.select("type", "form", "gender", "last", "attempt"), run, "type string, form string, gender string, last int, attempt int, new string", "form")


def _settled(base: DataFrame, key: str) -> DataFrame:
    """base (type, form, gender, last) with the first attempt whose stand-in collides with nothing, round by round."""
    now = cut(_drawn(base.withColumn("attempt", F.lit(0)), key))
    for attempt in range(1, 65):
        first = now.groupBy("type", "new").agg(F.min("form").alias("owner"), F.count("*").alias("n")).where("n > 1")
        met = now.join(first, ["type", "new"]).where("form <> owner").select("type", "form")
        real = now.join(base.select("type", F.col("form").alias("new")), ["type", "new"], "left_semi").select("type", "form")
        bad = cut(met.unionByName(real).distinct())
        if not bad.head(1):
            return now
        again = _drawn(bad.join(base, ["type", "form"]).withColumn("attempt", F.lit(attempt)), key)
        now = cut(now.join(bad, ["type", "form"], "left_anti").unionByName(again))
    raise RuntimeError(f"a format has too few stand-ins for its entities: {bad.first()}")


def retries(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """(type, form, attempt, gender) of the entities whose first stand-in collides, with the attempt that does not, and
    of those whose mentions differ in gender: one gender holds for all of them.

    A collision is a stand-in that is an original form of its type, or that a smaller form of the type has as well.
    Only colliding entities go to the next round; mostly there are none at all. Surnames settle first, then the names
    of several parts, whose attempts change given names only.
    """
    base = cut(_found(docs, text_col).groupBy("type", "form").agg(F.max("gender").alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed")))
    several = (F.col("type") == "name") & F.col("form").contains(" ")
    plain = _settled(base.where((F.col("type") != "name")).select("type", "form", "gender", F.lit(0).alias("last")), key)
    surnames = plain.where("type = 'surname'").select(F.col("form").alias("surname"), F.col("attempt").alias("last"))
    named = base.where(several).withColumn("surname", F.element_at(F.split("form", " "), -1)).join(surnames, "surname")
    full = _settled(cut(named.select("type", "form", "gender", "last")), key)
    found = plain.unionByName(full).join(base.select("type", "form", "mixed"), ["type", "form"])
    return found.where("attempt > 0 or mixed").select("type", "form", "attempt", "gender")


def _with_settled(docs: DataFrame, again: DataFrame, text_col: str) -> DataFrame:
    """docs and _settled: the rows of retries() that each text's own entities have, joined by the text's digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sorted({(digest, kind, form) for digest, text in zip(batch.column("digest").to_pylist(), texts_of(batch), strict=True) if digest is not None for kind, form, _ in _forms(text)})
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], pa.string()) for i in range(3)], ["digest", "type", "form"])

    digest = F.sha2(F.col(text_col), 256)
    met = map_batches(docs.select(digest.alias("digest"), F.col(text_col).alias("text")), run, "digest string, type string, form string").distinct()
    of_text = met.join(again, ["type", "form"]).groupBy("digest").agg(F.collect_list(F.struct("type", "form", "attempt", "gender")).alias("_settled"))
    of_text = of_text.withColumnRenamed("digest", "_digest")
    return docs.join(of_text, digest == F.col("_digest"), "left").drop("_digest")


SPANS = "array<struct<type:string,start:int,end:int,new_start:int,new_end:int>>"


def pseudonymise(docs: DataFrame, key: str = KEY, text_col: str = "text", spans_col: str | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """docs with stand-ins in text_col and, if spans_col is named, the spans.

    Null texts stay null, texts without entities stay as they are, other columns are untouched, every row is kept and
    repeated rows fare alike; ids do not matter. Long texts are searched whole. An empty table gives no rows. Two map
    passes over the texts; between them only distinct entities are shuffled. Settled entities go to all executors if
    there are at most max_sent, else each text gets its own by a join. spans_col and, then, _settled and _digest must
    be free.
    """
    if spans_col in docs.columns:
        raise ValueError(f"column in the way: {spans_col}")
    spark = docs.sparkSession
    again = retries(docs, key, text_col)
    few = [(r.type, r.form, r.attempt, r.gender) for r in again.limit(max_sent + 1).collect()]
    many = len(few) > max_sent
    sent = spark.sparkContext.broadcast({} if many else {(k, f): (a, g) for k, f, a, g in few})
    at, width = docs.columns.index(text_col), len(docs.columns)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = pa.list_(pa.struct([("type", pa.string()), *((c, pa.int32()) for c in ("start", "end", "new_start", "new_end"))]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        settled = [{(x["type"], x["form"]): (x["attempt"], x["gender"]) for x in row or ()} for row in batch.column("_settled").to_pylist()] if many else [sent.value] * len(texts)
        done = [(None, []) if t is None else replaced(t, known, key) for t, known in zip(texts, settled, strict=True)]
        columns, names = list(batch.columns)[:width], list(batch.schema.names)[:width]
        columns[at] = pa.array([t for t, _ in done], pa.string())
        if spans_col:
            columns.append(pa.array([s for _, s in done], kind))
            names.append(spans_col)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(_with_settled(docs, again, text_col) if many else docs, run, own + (f", `{spans_col}` {SPANS}" if spans_col else ""), text_col)
