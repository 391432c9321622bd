"""Token counts by compiled finite-state transducers (operator 1).

Two machines are compiled from a public byte-level BPE file.

* Splitter: a deterministic transducer over thirteen states and twelve character classes that marks where
  pre-tokens begin. A stream of characters is cut into chunks; each chunk yields its state map (entry state ->
  exit state), the maps compose by a parallel prefix scan, and a second pass with the known entry state emits marks.
* Merger: a byte transducer, determinised as inputs need it. Its state holds, for every start still open in the
  vocabulary's trie, the last token before that start and the count so far, relative to the current one; each
  transition carries the change of the emitted-token count. Two tokens may stand side by side only if merging
  their joined bytes gives just these two, which is what makes the counts equal to those of greedy merging.
"""

from __future__ import annotations

import functools
import json
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm._common import claim, map_batches, texts_of

CHUNK = 512
KEPT_WORDS, KEPT_STATES, KEPT_LENGTH = 300_000, 250_000, 48

# Classes of characters.
END, SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, LOW_L, LOW_V, LOW_R, LOW_E, LOW_STMD = range(12)
# States of the splitter: what the characters so far end with.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, QUOTE, QUOTE_L, QUOTE_V, QUOTE_R, CLITIC = range(13)
N_STATES, N_CLASSES = 13, 12
_LETTERS = {LETTER, LOW_L, LOW_V, LOW_R, LOW_E, LOW_STMD}


def _fresh(kind: int) -> int:
    """The state after the first character of a pre-token."""
    if kind in _LETTERS:
        return IN_LETTERS
    return {END: START, SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE: QUOTE}[kind]


def _step(state: int, kind: int) -> tuple[int, bool, bool]:
    """Next state; whether a pre-token begins one character back; whether one begins here."""
    white = kind in (SPACE, WHITE)
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE) and white:
        return (RUN_SPACE if kind == SPACE else RUN_WHITE), False, False
    if kind == END:
        return START, state in (QUOTE_L, QUOTE_V, QUOTE_R), True
    if state in (ONE_SPACE, RUN_SPACE):  # the last blank leads the next pre-token
        return (IN_OTHER if kind == APOSTROPHE else _fresh(kind)), state == RUN_SPACE, False
    if state == RUN_WHITE:
        return _fresh(kind), True, True
    if state == QUOTE:
        if kind in (LOW_L, LOW_V, LOW_R):
            return {LOW_L: QUOTE_L, LOW_V: QUOTE_V, LOW_R: QUOTE_R}[kind], False, False
        if kind == LOW_STMD:
            return CLITIC, False, False
        if kind in (OTHER, APOSTROPHE):
            return IN_OTHER, False, False
        return _fresh(kind), False, True
    if state in (QUOTE_L, QUOTE_V, QUOTE_R):
        if kind == (LOW_L if state == QUOTE_L else LOW_E):
            return CLITIC, False, False
        return _fresh(kind), True, kind not in _LETTERS
    same = {IN_LETTERS: kind in _LETTERS, IN_NUMBERS: kind == NUMBER, IN_OTHER: kind in (OTHER, APOSTROPHE)}.get(state, False)
    return (state, False, False) if same else (_fresh(kind), False, True)


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and marks (1: begins here, 2: began one back), flat over state * N_CLASSES + class."""
    steps = [_step(s, k) for s in range(N_STATES) for k in range(N_CLASSES)]
    return np.array([s for s, _, _ in steps], np.uint8), np.array([2 * back + here for _, back, here in steps], np.uint8)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: column i becomes map 0, then 1, ... then i."""
    out, step = maps.copy(), 1
    while step < out.shape[1]:
        joined = np.take_along_axis(out[:, step:], out[:, :-step], axis=0)
        out[:, step:] = joined
        step *= 2
    return out


def split_marks(kinds: np.ndarray) -> np.ndarray:
    """For each character of a stream that begins and ends with the START state: whether a pre-token begins there."""
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    move, mark = splitter_tables()
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, END, np.uint8)
    padded[:n] = kinds
    rows = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T).astype(np.intp)
    # State maps: all entry states run in step until each chunk's paths have met, then one path is enough.
    maps, at = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, 1), 0
    while at < CHUNK and (maps != maps[0]).any():
        maps = move[maps.astype(np.intp) * N_CLASSES + rows[at]]
        at += 1
    path = maps[0]
    for row in rows[at:]:
        path = move[path.astype(np.intp) * N_CLASSES + row]
    maps = np.repeat(path[None], N_STATES, 0) if at < CHUNK else maps
    state = np.concatenate([[START], scan(maps)[START, :-1]]).astype(np.uint8)
    marks = np.empty((CHUNK, lanes), np.uint8)
    for i, row in enumerate(rows):
        where = state.astype(np.intp) * N_CLASSES + row
        marks[i] = mark[where]
        state = move[where]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return begins


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Emitted-token counts of byte strings."""

    def __init__(self, model: dict):
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for piece, i in self.ids.items():
            node = 0
            for b in piece:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.bytes_of = {i: piece for piece, i in self.ids.items()}
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in reversed(self.ranks.items())}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.state_ids = {((0, -1, 0),): 0}
        self.states = [((0, -1, 0),)]
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Greedy merging by rank, written plainly; only pairs of tokens go through it."""
        parts = [self.ids[bytes([b])] for b in data]
        while len(parts) > 1:
            rank, at, new = min((*self.ranks.get((a, b), (1 << 60, -1))[:1], i, self.ranks.get((a, b), (0, -1))[1]) for i, (a, b) in enumerate(pairwise(parts)))
            if rank == 1 << 60:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens may be neighbours; before is -1 at the start of a pre-token."""
        got = self.pairs.get((before, token))
        if got is None:
            got = self._apart(before, token) if before >= 0 else self.merged(self.bytes_of[token]) == [token]
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[before, token] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the right edge of a with the left edge of b.

        Goes back in time from the finished tokens: the edge piece made later is undone first (on a tie the right
        one, as merging runs from the left), and each pair that stood side by side must not have a merge that was
        due before one of the two was used up.
        """
        ends_a = ends_b = 1 << 60
        while True:
            due = self.ranks.get((a, b))
            if due and (due[0] < min(ends_a, ends_b) or due[0] == ends_b < ends_a):
                return False
            made_a, made_b = self.made.get(a, (-1, 0, 0)), self.made.get(b, (-1, 0, 0))
            if made_a[0] > made_b[0]:
                ends_a, _, a = made_a
            elif made_b[0] >= 0:
                ends_b, b, _ = made_b
            else:
                return True

    def _build(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, gain = [], -1, 0
        for node, before, count in self.states[state]:
            node = self.child[node].get(byte, 0)
            if node:
                grown.append((node, before, count))
                if last < 0 and (token := self.token[node]) >= 0 and self.fits(before, token):
                    last, gain = token, count + 1
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*((node, before, count - gain) for node, before, count in grown if self.child[node]), (0, last, 0))
        found = self.state_ids.get(key)
        if found is None:
            found = self.state_ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = found, gain
        return found, gain

    def count(self, data: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self._forget()
        state = total = 0
        moves = self.moves
        for byte in data:
            got = moves.get(state << 8 | byte)
            state, gain = self._build(state, byte) if got is None else got
            total += gain
        return total


class _Counts(dict):
    """Counts of pre-tokens; what is missing goes through the transducer."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, word: bytes) -> int:
        n = self.merger.count(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Token counts of texts, as the tokenizer file's library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normaliser is needed")
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.lead = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.splits = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.counts = _Counts(Merger(spec["model"]))
        self.kinds = np.full(0x110000, 255, np.uint8)
        for c, kind in ((" ", SPACE), ("'", APOSTROPHE), ("l", LOW_L), ("v", LOW_V), ("r", LOW_R), ("e", LOW_E), *((c, LOW_STMD) for c in "stmd")):
            self.kinds[ord(c)] = kind

    def _kind(self, c: str) -> int:
        """A character's class, as the library's own splitter treats it."""
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self.splits(probe + c)) == 1:
                return kind
        return WHITE

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text without special strings, which count one token each."""
        parts, n = [text], 0
        for special in self.specials:
            if special in text:
                split = [p.split(special) for p in parts]
                n += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        return parts, n

    def batch(self, texts: list[str]) -> np.ndarray:
        parts, owners, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own, total[i] = self.segments(text)
            own = [p for p in own if p]
            parts += [" " + p if self.lead and p[:1] != " " else p for p in own]
            owners += [i] * len(own)
        if not parts:
            return total
        stream = "\n".join(parts) + "\n"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        if (kinds == 255).any():
            for p in np.unique(points[kinds == 255]):
                self.kinds[p] = self._kind(chr(p))
            kinds = self.kinds[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        marks = np.flatnonzero(split_marks(kinds))
        widths = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        data = stream.encode()
        cuts = offsets[marks].tolist()
        counts = np.fromiter(map(self.counts.__getitem__, [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]), np.int64, len(cuts))
        is_end = kinds[marks] == END
        counts[is_end] = 0
        sums = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(total, np.array(owners), np.diff(sums[np.concatenate([[0], np.flatnonzero(is_end) + 1])]))
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text; null counts as empty (0, 0), repeated rows each give a row.

    Map-only: no shuffle, memory bounded by a batch of texts or one long text. tokenizer_path is opened on the
    executors, where the public file must be installed. Other columns of docs are ignored.
    """
    schema = docs.select(F.col(id_col)).schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("token_counts", counter.cache_clear)
        texts = texts_of(batch)
        counts = counter(tokenizer_path).batch(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {schema}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
