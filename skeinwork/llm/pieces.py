"""SentencePiece encoding and decoding of BPE models, without the library.

Pieces merge by score, the leftmost first. Two facts make a table of prefixes enough: each prefix of a text has one
encoding, and a row of tokens is the encoding of its text just if each two neighbours are that of theirs. So for every
prefix the table holds the one last token: of the pieces that end there (an automaton finds them), the one that goes
with the last token of the prefix before it. From the end, the table gives the ids backwards.

No piece has a space mark behind another character, or letters beside other characters, so a text falls into segments (a
run of letters or of others, with the marks before it) that are encoded apart; frequent segments are kept.

Null and empty texts have no ids and decode to the empty text. Equal texts get equal rows; rows are encoded one by one, so
ties, repeated rows, repeated or null doc_ids, columns of any other names and empty tables need no rule of their own. Texts
that begin a segment with several marks are merged pair by pair from a heap: their pieces share one score."""

import hashlib
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import kept, map_texts

MARK = "▁"
ONE_KIND = regex.compile(rf"{MARK}*(\p{{L}}*|\P{{L}}*)")
#: Segments kept in each of two generations of a task's cache, and the length of one that is kept.
KEPT, SHORT = 200_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Vocabulary:
    """What a BPE model file says, and how each piece comes from two others."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, {NORMAL, UNKNOWN, CONTROL, BYTE}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or {p.type for p in model.pieces} - kinds:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no further normalization are read")
        self.surface = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        if any(MARK in p.lstrip(MARK) or not ONE_KIND.fullmatch(p) for p in self.ids):
            raise ValueError("pieces with inner space marks, or of letters and others, are not read")
        rank = sorted(self.ids.values(), key=lambda i: -model.pieces[i].score)
        #: the order of merging; equal scores share a rank
        self.rank = [0] * len(self.surface)
        for place, i in enumerate(rank):
            same = place and model.pieces[i].score == model.pieces[rank[place - 1]].score
            self.rank[i] = self.rank[rank[place - 1]] if same else place
        #: the halves that merge last into a piece, or None for single characters; pieces that no merging reaches are not usable
        self.halves: list[tuple[int, int] | None] = [None] * len(self.surface)
        self.usable = [False] * len(self.surface)
        for piece, i in self.ids.items():
            parts, last = self.merge(piece)
            self.usable[i], self.halves[i] = parts == [piece], last

    def merge(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """Merge as the definition says, the best pair first, of equal ones the leftmost: the parts, and the two halves of the
        last merge. Pairs wait in a heap, parts are linked, so long texts take little longer than their length."""
        parts, last, n = list(text), None, len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, str]] = []

        def wait(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (self.rank[k], i, parts[i] + parts[j]))

        for i in range(n):
            wait(i)
        while waiting:
            _, i, whole = heapq.heappop(waiting)
            if not parts[i] or (j := after[i]) >= n or parts[i] + parts[j] != whole:
                continue  # one of them has merged since
            last = (self.ids.get(parts[i], -1), self.ids.get(parts[j], -1))
            parts[i], parts[j], after[i] = whole, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            wait(i)
            wait(before[i])
        return [p for p in parts if p], last


class Kept(dict):
    """Results of make by key, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key) or self.make(key)
        if len(key) > SHORT:
            return found
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Followers(dict):
    """Of a token: whether others may follow it, found as they are asked for."""

    def __init__(self, token: int, compatible):
        super().__init__()
        self.token, self.compatible = token, compatible

    def __missing__(self, token: int) -> bool:
        fits = self[token] = self.compatible(self.token, token)
        return fits


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.pairs = [Followers(i, self.compatible) for i in range(len(vocabulary.surface))]
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            if vocabulary.usable[i]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        table = [s.replace(MARK, " ").encode() for s in vocabulary.surface]
        for b, i in enumerate(vocabulary.byte):
            table[i] = bytes([b])
        for i, k in enumerate(vocabulary.kind):
            if k == CONTROL:
                table[i] = b""
        self.table = table
        self.segment = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+")
        self.decimal = [str(i) for i in range(len(table))]
        self.segments, self.words = Kept(self.entry), Kept(self.word)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of both texts in a row is these two: undo the merges of both, the latest first, and at
        each step see that no merge across the border would have come before the one undone."""
        v = self.v
        surface, rank, halves, ids = v.surface, v.rank, v.halves, v.ids
        x, y, before, right = a, b, float("inf"), False
        while True:
            across = ids.get(surface[x] + surface[y])
            if across is not None and (rank[across] < before or rank[across] == before and right):
                return False
            if halves[x] is not None and (halves[y] is None or rank[x] > rank[y]):
                before, right, x = rank[x], False, halves[x][1]
            elif halves[y] is not None:
                before, right, y = rank[y], True, halves[y][0]
            else:
                return True

    def ids_of(self, segment: str) -> list[int]:
        """Ids of a segment, by the table of the last tokens of its prefixes."""
        v = self.v
        if segment.startswith(MARK * 2):  # pieces of several marks share one score: merged as the definition says
            out = []
            for part in v.merge(segment)[0]:
                out += [v.ids[part]] if part in v.ids else [v.byte[b] for b in part.encode()]
            return out
        n = len(segment)
        last, size = [-1] * (n + 1), [0] * n  # by a prefix's last place; the empty prefix is the last, at -1
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(segment):
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before < 0 or pairs[before][token]:
                last[end], size[end] = token, length
        out: list[int] = []
        n -= 1
        while n >= 0:
            if size[n]:
                out.append(last[n])
                n -= size[n]
            else:  # a character without a piece
                out += [v.byte[b] for b in reversed(segment[n].encode())]
                n -= 1
        return out[::-1]

    def entry(self, segment: str) -> tuple[str, int, bytes]:
        """Of a segment: its ids in decimal, their number, and the bytes that they decode to."""
        ids = self.ids_of(segment)
        return ",".join([self.decimal[i] for i in ids]), len(ids), b"".join([self.table[i] for i in ids])

    def word(self, word: str) -> tuple[str, int, bytes]:
        """The same of a word and the mark before it."""
        parts = [self.segments[x] for x in self.segment.findall(MARK + word)]
        return parts[0] if len(parts) == 1 else (",".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts]))

    def encode(self, texts: list[str]) -> tuple[list[str], list[bytes]]:
        """Of each text its ids in decimal, joined by commas, and the bytes that they decode to. Each distinct word of these texts
        is looked up once, and its entry goes to all its places."""
        import pyarrow as pa
        import pyarrow.compute as pc

        several = ["  " in t or MARK in t or t[:1] == " " for t in texts]  # marks in a row
        lists = pc.split_pattern(pa.array(["" if s else t for s, t in zip(several, texts, strict=True)], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        entries = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        place = lambda k, kind: pa.ListArray.from_arrays(lists.offsets, pa.array([e[k] for e in entries], kind).take(coded.indices))
        lines, raws = pc.binary_join(place(0, pa.string()), ",").to_pylist(), pc.binary_join(place(2, pa.binary()), b"").to_pylist()
        for i, (s, t) in enumerate(zip(several, texts, strict=True)):
            if s or not t:
                parts = list(map(self.segments.__getitem__, self.segment.findall(MARK + t.replace(" ", MARK)))) if t else []
                lines[i], raws[i] = ",".join([p[0] for p in parts]), b"".join([p[2] for p in parts])
        return lines, raws

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the first mark is dropped, bytes that are no text become one U+FFFD each."""
        return decoded(b"".join([self.table[i] for i in ids]))


def decoded(raw: bytes) -> str:
    raw = raw.removeprefix(b" ")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_pieces(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (32-bit
    integers in little-endian bytes). The vocabulary, of fixed size, is read on the driver and broadcast."""
    vocabulary = Vocabulary(model_path)
    held, name = docs.sparkSession.sparkContext.broadcast(vocabulary.__dict__), hashlib.sha256(repr(vocabulary.__dict__).encode()).hexdigest()

    def encoder_of():
        vocabulary = Vocabulary.__new__(Vocabulary)
        vocabulary.__dict__.update(held.value)
        return Encoder(vocabulary)

    def make():
        encoder = kept(name, encoder_of)

        def run(texts):
            counts, ids, plain, raw = [], [], [], []
            for line, held in zip(*encoder.encode([(t or b"").decode() for t in texts]), strict=True):
                counts.append(line.count(",") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                plain.append(hashlib.sha256(decoded(held).encode()).hexdigest())
                if with_ids:
                    raw.append(np.array(line.split(",") if line else [], dtype="<u4").tobytes())
            return [counts, ids, plain] + [raw] * with_ids

        return run

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, make, keeps=name)
