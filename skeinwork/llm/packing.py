"""Cost-balanced packing of documents into sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n to attend to. Each task tokenizes its rows and packs blocks of
them: documents in descending order of cost, each into the sequence of lowest cost that has room for it. Where none has
room, the document is cut and fills the roomiest ones. A block has just as many full sequences as its tokens fill; what
is left goes into the next block, and at a task's end into sequences whose lengths are powers of two, which need no
padding. So no token is padded, no row is shuffled, and a task holds one block at a time.

Which rows share a sequence depends on how the input is split; each row's ids do not. A null or empty text is one token,
the end id. Repeated rows, ties and rows without a doc_id are packed like any others, in the order of rows. Columns besides doc_id and
text may have any names; an empty table gives no rows."""

import itertools
import re
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bare_words, in_arrow, kept, slices

LENGTH, END = 4096, 2
#: Tokens that a block holds at least, unless the input ends.
BLOCK = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Bytes of the words of each generation, and of the runs, whose ids a worker keeps; what an entry takes beside its bytes.
KEPT_BYTES, ENTRY = 112 << 20, 170
UNSPLIT, RUN, LETTERS = regex.compile(r"'|<[|]|İ"), regex.compile(r"\p{L}+|\P{L}+"), regex.compile(r"[\p{Ll}]+")
ASCII_RUN = re.compile(r"[A-Za-z]+|[^A-Za-z]+")
#: A task's sequences are numbered from its own number times this.
PER_TASK = 1 << 40


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, rooms: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces as (document, start, length, sequence) for documents and sequences of these sizes; the sequences
    have room for all tokens or fewer, and then the last pieces get sequence -1."""
    room, spent, out = rooms.astype(np.int64).copy(), np.zeros(len(rooms)), []
    for i in np.argsort(-lengths, kind="stable"):
        start, n = 0, int(lengths[i])
        while n:
            if not room.any():
                out.append((int(i), start, n, -1))
                break
            fits = room >= n
            to = int(np.where(fits, spent, np.inf).argmin()) if fits.any() else int(room.argmax())
            size = min(n, int(room[to]))
            out.append((int(i), start, size, to))
            room[to] -= size
            spent[to] += cost(size)
            start, n = start + size, n - size
    return out


class Block:
    """Documents that wait to be packed: doc_id, ids, and the place of the first id in its document."""

    def __init__(self, first_sequence: int):
        self.waiting: list[tuple[object, np.ndarray, int, int]] = []
        self.tokens, self.sequence = 0, first_sequence

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Rows of the pieces of all full sequences and, if this is the last block, of those of powers of two."""
        rest = self.tokens % LENGTH
        rooms = [LENGTH] * (self.tokens // LENGTH) + [1 << k for k in range(LENGTH.bit_length() - 1, -1, -1) if rest >> k & 1] * last
        used, rows, left = np.zeros(len(rooms), np.int64), [], []
        for i, start, size, to in assign(np.array([len(w[1]) for w in self.waiting], np.int64), np.array(rooms, np.int64)):
            doc_id, ids, before, whole = self.waiting[i]
            piece = ids[start : start + size]
            if to < 0:
                left.append((doc_id, piece, before + start, whole))
                continue
            rows.append((doc_id, before + start, size, zlib.crc32(piece.astype("<u4").tobytes()), whole, self.sequence + to, int(used[to])))
            used[to] += size
        self.waiting, self.tokens, self.sequence = left, sum(len(w[1]) for w in left), self.sequence + len(rooms)
        return rows


class Words(dict):
    """Ids by word, in two generations, and below it ids of runs of letters and runs of others. Spaces end every token of this
    vocabulary, and so do the borders between letters and others: a text's ids are its words' ids in a row, and a word's
    those of its runs, unless it has an apostrophe (which goes with letters), a special token's beginning or what normalization takes apart or joins."""

    def __init__(self, description: str, most: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.library, self.old, self.runs = Tokenizer.from_str(description), {}, {}
        self.held = self.runs_held = 0
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def look_up(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow array: each distinct word is looked up once, and its ids go to all its places."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # the tokenizer lowers letters anyway; but names of special tokens must stay what they are
        words, counts = bare_words(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        found = list(map(self.get, distinct))
        missing = {w for w, v in zip(distinct, found, strict=True) if v is None}
        if missing:
            self.learn(missing)
            found = [self[w] if v is None else v for w, v in zip(distinct, found, strict=True)]
        known, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [ids[a:b] for a, b in itertools.pairwise(edges)]
        if self.held >= self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        return out

    def learn(self, missing: set[bytes]) -> None:
        parts = {}
        for w in missing:
            if (ids := self.old.get(w)) is not None:
                self[w] = ids
            elif w.isalpha():  # ASCII letters alone
                parts[w] = (w.decode(),)
            elif w.isascii():  # normalized as it is
                parts[w] = (w.decode(),) if b"'" in w or b"<|" in w else ASCII_RUN.findall(w.decode())
            else:
                text = w.decode()
                parts[w] = RUN.findall(text) if not UNSPLIT.search(text) and unicodedata.is_normalized("NFC", text) else [text]
        if self.runs_held >= self.most:
            self.runs.clear()
            self.runs_held = 0
        letters, others = [], []
        for p in set().union(*parts.values()).difference(self.runs):
            (letters if LETTERS.fullmatch(p) else others).append(p)
        self.encode(letters, others)
        runs = self.runs
        self.runs_held += sum(ENTRY + len(p) + len(runs[p]) for p in itertools.chain(letters, others))
        for w, own in parts.items():
            self[w] = runs[own[0]] if len(own) == 1 else b"".join([runs[p] for p in own])
        self.held += sum(ENTRY + len(w) + len(self[w]) for w in missing)

    def encode(self, letters: list[str], others: list[str]) -> None:
        """Letters in one text each 10,000: every run is one token row with an end; others one by one."""
        for at in range(0, len(letters), 10_000):
            part = letters[at : at + 10_000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = (np.nonzero(self.ends[ids])[0] + 1) * 4
            if len(stops) != len(part) or stops[-1] != 4 * len(ids):  # some run isn't one word to the library
                others += part
                continue
            raw = ids.tobytes()
            self.runs.update(zip(part, [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)], strict=True))
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            for p, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.runs[p] = np.array(e.ids, np.uint32).tobytes()


def pack_documents(docs: DataFrame, tokenizer_path: str, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """docs: doc_id, text. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. kept_bytes: of
    words and of runs in a worker's memory (of words twice that, for a moment); fewer take more time."""
    with open(tokenizer_path) as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: of fixed size

    def words_of_vocabulary():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Words(held.value, kept_bytes)

    name = f"words {zlib.crc32(held.value.encode())} {len(held.value)} {kept_bytes}"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        cache = kept(name, words_of_vocabulary)
        block = Block(TaskContext.get().partitionId() * PER_TASK)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows(found):
            arrays = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 7
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                for doc_id, ids in zip(part.column(0).to_pylist(), cache.look_up(part.column(1).cast(pa.string())), strict=True):
                    block.add(doc_id, np.append(ids, np.uint32(END)))
                    if block.tokens >= BLOCK:
                        yield rows(block.pack(False))
        yield rows(block.pack(True))

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", name)
