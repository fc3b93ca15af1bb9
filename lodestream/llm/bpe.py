"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

1. Texts are split into words in Spark tasks: at ASCII white space, and where ASCII letters, digits and
   punctuation meet, which are pre-token boundaries wherever nothing else is near. Words are counted by
   aggregation; the table holds every distinct word of the corpus, and each is encoded exactly once.
2. The most frequent words, a number with a proven size, are broadcast; their ids are put in by position
   in the scan. Every other position is a hole: its word is joined with the table by the word's bytes,
   and the ids come back to the run of texts that asked for them and fill its holes in order.
3. Ids meet their pieces by position in the broadcast id-to-piece table.

What words a vocabulary allows is tried at the start on texts of all kinds; one that fails (a normalizer
or pre-tokenizer that looks across words, a decoder of another kind) is used on whole texts instead.

Defined results: a null text is empty; an empty text has no ids. Repeated rows give repeated rows, a null
doc_id stays null, other columns are left alone. A text of any length is worked on in segments.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, buckets, release_memory
from .text_features import SPACE, segments, token_hashes

#: Letters, ASCII or Latin-1, alone.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Longer words are never broadcast, which bounds the broadcast's bytes.
_LONGEST = 64

#: Kinds of bytes: white space, letter, digit, punctuation, and what is never parted from its neighbours (beyond ASCII,
#: apostrophes, which begin contractions, and what special tokens are written with).
_BLANK, _LETTER, _DIGIT, _PUNCT, _GLUE = range(5)
_KIND = np.full(256, _GLUE, np.uint8)
for _kind, _bytes in ((_BLANK, b" \t\n\x0b\x0c\r"), (_DIGIT, b"0123456789"), (_PUNCT, b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")):
    _KIND[list(_bytes)] = _kind
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = _LETTER

#: Texts on which a vocabulary is tried.
_TRIALS = (
    "Plain words, UPPER and mIxEd; digits 2024 and 3.14, 5th x86_64!?! (a)[b]{c}",
    "it's they'll 'quoted' don't''s &'t /'re \"said\" end.'s",
    "é e\u0301 T\u0308o H\u0331 \u212bngstr\u00f6m \u0130stanbul Ω\u03a3 stra\u00dfe 5\u0301 =\u0338 a\u0338",
    "tab\tline\nfeed\r\n\x0b\x0c  two  spaces \u00a0nbsp\u3000wide \u4f60\u597d, \u4e16\u754c! \U0001f600\U0001f600",
    "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>,y a<|endoftext|>b </w> a</w>b ## ### </turn>",
    "https://example.com/a-b_c?d=e&f=%20#g user@host.org C:\\dir\\file.txt $1,000.00 -5 +7 1e-9 ...---===",
)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, last) of the words of texts joined by line feeds. A-Z are lower-cased, but for letters that a byte
    beyond ASCII follows, as they may compose with it, and words with `<|`, which begins special tokens."""
    if joined.isascii():
        b = np.frombuffer(joined.lower(), np.uint8)
    else:
        b = np.frombuffer(joined, np.uint8)
        upper = (b >= 65) & (b <= 90)
        upper[:-1] &= b[1:] < 128
        b = b + (upper.view(np.uint8) << np.uint8(5))
    at = joined.find(b"<|")
    if at >= 0:
        b = b.copy()
        while at >= 0:
            end = m.start() if (m := SPACE.search(joined, at)) else len(joined)
            begin = at
            while begin and joined[begin - 1] not in b" \t\n\x0b\x0c\r":
                begin -= 1
            b[begin:end] = np.frombuffer(joined[begin:end], np.uint8)
            at = joined.find(b"<|", end)
    kind = _KIND[b]
    glue, blank = kind == _GLUE, kind == _BLANK
    cut = kind[1:] != kind[:-1]
    cut &= ~((glue[1:] | glue[:-1]) & ~(blank[1:] | blank[:-1]))
    edge = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(b)]])
    first, last = edge[:-1], edge[1:]
    word = ~blank[first] if len(b) else np.zeros(1, bool)
    return b, first[word], last[word]


def _gather(source: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[start : start + count] for every entry in a row, and where each begins (one entry more)."""
    begins = np.concatenate([[0], np.cumsum(count)])
    return source[np.arange(begins[-1]) + np.repeat(start - begins[:-1], count)], begins


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def word_counts(texts: DataFrame, run_bytes: int = 1 << 22) -> DataFrame:
    """texts (text) -> (word, n) of every distinct word; each task counts runs of texts before Spark aggregates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in segments((x.as_py() for x in batch.column(0).cast(pa.binary())), run_bytes, SPACE):
                # short words are told apart by hashes within the run, long ones by their bytes
                pieces, long, at = [], Counter(), 0
                for joined in _joined(run):
                    b, first, last = split_words(joined)
                    more = last - first > _LONGEST
                    long.update(b[i:j].tobytes() for i, j in zip(first[more].tolist(), last[more].tolist(), strict=True))
                    first, last = first[~more], last[~more]
                    pieces.append((token_hashes(b, first, last), b, first, last))
                _, where, n = np.unique(np.concatenate([x[0] for x in pieces]), return_index=True, return_counts=True)
                order = np.argsort(where)
                where, n = where[order], n[order]
                for h, b, first, last in pieces:
                    lo, hi = np.searchsorted(where, [at, at + len(h)])
                    mine = where[lo:hi] - at
                    yield pa.RecordBatch.from_arrays([_binary(*_gather(b, first[mine], last[mine] - first[mine])), pa.array(n[lo:hi], pa.int64())], ["word", "n"])
                    at += len(h)
                yield pa.RecordBatch.from_arrays([pa.array(list(long), pa.binary()), pa.array(list(long.values()), pa.int64())], ["word", "n"])
        release_memory()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _joined(run: list[tuple[int, bytes]], piece_bytes: int = 1 << 19) -> Iterator[bytes]:
    out, size = [], 0
    for _, s in run:
        out.append(s)
        size += len(s)
        if size >= piece_bytes:
            yield b"\n".join([*out, b""])
            out, size = [], 0
    if out:
        yield b"\n".join([*out, b""])


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that does not print as the next free code point from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Words:
    """Encodes single words. A plain word of a caseless byte-level vocabulary is one pre-token, so that it goes straight
    to the merges; whether the vocabulary is of that kind is tried on a few words."""

    _letters = _byte_letters()

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        tried = [w.encode() for w in ("a", "Zebra", "uNiVeRsAl", "Éclair", "größe", "ÀÞÿß")]
        self.direct = [self._whole(w) for w in tried] == [self.ids([w])[0] for w in tried]

    def _whole(self, word: bytes) -> bytes:
        letters = word.decode().lower().encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]

    def encode(self, words: list[bytes]) -> list[bytes]:
        plain = [self.direct and _PLAIN.fullmatch(w) is not None for w in words]
        rest = iter(self.ids([w for w, p in zip(words, plain, strict=True) if not p]))
        return [self._whole(w) if p else next(rest) for w, p in zip(words, plain, strict=True)]


def splits_into_words(path: str) -> bool:
    """Whether the ids of the trial texts are the ids of their words in order."""
    words = Words(path)
    for text in _TRIALS:
        b, first, last = split_words(text.encode() + b"\n")
        if b"".join(words.encode([b[i:j].tobytes() for i, j in zip(first, last, strict=True)])) != words.ids([text.encode()])[0]:
            return False
    return True


class HotWords:
    """The broadcast words: sorted hashes, reached through their leading bits, and the ids of each. A hash with the
    word's length stands for it. The last entry is the hole, a single id that no piece has."""

    def __init__(self, h: np.ndarray, length: np.ndarray, ids: list[np.ndarray], count: np.ndarray, kind: np.dtype):
        """h, length, count: of each word; ids: theirs in a row, in parts. Some 20 bytes a word."""
        self.hole = int(np.iinfo(kind).max)
        order = np.argsort(h)
        start = np.cumsum(count, dtype=np.int64) - count
        self.hash, self.length, self.count = h[order], length[order], np.append(count[order], np.uint8(1))
        self.start = np.append(start[order], start[-1] + count[-1] if len(h) else 0).astype(np.uint32)
        self.ids = np.concatenate([*ids, np.array([self.hole], kind)])
        self.bits = max(8, min(22, len(h).bit_length()))
        self.begin = np.searchsorted(self.hash >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def kind(path: str) -> np.dtype:
        """Ids of two bytes where all of them fit beside the hole."""
        return np.dtype("<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) < 0xFFFF else "<u4")

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each word, the hole's for those not here."""
        lead = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end, out = self.begin[lead], self.begin[lead + 1], np.full(len(h), len(self.hash), np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = (self.hash[here] == h[left]) & (self.length[here] == length[left])
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def codes(self, run: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
        """(text number, ids with holes, the words of the holes in order) of each segment."""
        joined = b"\n".join([*(s for _, s in run), b""])
        b, first, last = split_words(joined)
        entry = self.find(token_hashes(b, first, last), last - first)
        ids, begins = _gather(self.ids, self.start[entry].astype(np.int64), self.count[entry].astype(np.int64))
        holes = np.flatnonzero(entry == len(self.hash))
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for _, s in run])])
        cuts = np.searchsorted(first, starts)
        of_holes = np.searchsorted(holes, cuts)
        for k, (number, _) in enumerate(run):
            mine = holes[of_holes[k] : of_holes[k + 1]]
            yield number, ids[begins[cuts[k]] : begins[cuts[k + 1]]], [b[i:j].tobytes() for i, j in zip(first[mine].tolist(), last[mine].tolist(), strict=True)]

    def coded(self, texts: Iterator[bytes | None], run_bytes: int = 1 << 18) -> Iterator[tuple[list[int], np.ndarray, dict[bytes, int], list[int]]]:
        """(number of ids of each text, their ids with holes, distinct hole words by first place, the word of each hole) of
        runs of whole texts, about run_bytes together."""
        waiting, size = [], 0

        def flush() -> tuple[list[int], np.ndarray, dict[bytes, int], list[int]]:
            parts, sizes, words, refs = [], [0] * len(waiting), {}, []
            for run in segments(waiting, run_bytes, SPACE):
                for number, ids, holes in self.codes(run):
                    parts.append(ids)
                    sizes[number] += len(ids)
                    refs += [words.setdefault(w, len(words)) for w in holes]
            return sizes, np.concatenate(parts), words, refs

        for t in texts:
            waiting.append(t or b"")
            size += len(waiting[-1])
            if size >= run_bytes:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()


def word_table(texts: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """(word, n, ids) of every distinct word, each encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Words(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.encode(b.column(0).to_pylist()), pa.binary())], ["word", "n", "ids"])
        release_memory()

    return scratch.cut(word_counts(texts).mapInArrow(encode, "word binary, n long, ids binary"), "words")


def hot_words(table: DataFrame, path: str, most: int = 1 << 22) -> tuple[Broadcast, DataFrame]:
    """The broadcast of at most `most` words of at most 64 bytes, all that occur at least so and so often; the rest of the table."""
    short = F.octet_length("word") <= _LONGEST
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    least, held = (1 << 63) - 1, 0
    for r in sorted(table.filter(short).groupBy(step.alias("least")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["least"]):
        held += r["words"]
        if held > most:
            break
        least = r["least"]
    hot = short & (F.col("n") >= least)
    kind = HotWords.kind(path)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            end = np.cumsum([len(w) for w in words], dtype=np.int64)
            length = np.diff(end, prepend=0)
            h = token_hashes(np.frombuffer(b"".join(words), np.uint8), end - length, end)
            count = np.array([len(x) // 4 for x in ids], np.uint8)
            columns = [x.tobytes() for x in (h, length.astype(np.uint8), np.frombuffer(b"".join(ids), "<u4").astype(kind), count)]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["h", "length", "ids", "count"])

    parts = table.filter(hot).select("word", "ids").mapInArrow(slim, "h binary, length binary, ids binary, count binary").toArrow()
    read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in parts.column(c))])
    columns = [read("h", np.uint64), read("length", np.uint8), [read("ids", kind)], read("count", np.uint8)]
    del parts
    shared = table.sparkSession.sparkContext.broadcast(HotWords(*columns, kind))  # the driver keeps it in a file only
    del columns
    release_memory()
    return shared, table.filter(~hot).select("word", "ids")


def encoded(docs: DataFrame, path: str, finish: Callable[[], Callable], schema: str, most: int = 1 << 22) -> DataFrame:
    """docs (doc_id, text) -> rows of schema. finish() is called in a task and returns a function from (doc_ids, packed
    little-endian unsigned 32-bit ids of each) to a record batch. most: words that are broadcast at most."""
    docs = docs.select("doc_id", "text")
    if not splits_into_words(path):
        return docs.mapInArrow(_whole_texts(path, finish), schema)
    scratch = Scratch(docs.sparkSession, "bpe")
    table = word_table(docs, path, scratch)
    hot, rare = hot_words(table, path, most)

    n_buckets = buckets(docs.sparkSession)

    def numbers(part: int) -> Iterator[int]:
        """Run numbers of a task, all of one bucket: the runs are written in buckets without being shuffled."""
        for at in range(part << 32, (part + 1) << 32, 16 * n_buckets):
            ids = np.arange(at, at + 16 * n_buckets)
            yield from ids[bucket_of(ids, n_buckets) == part % n_buckets].tolist()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, number = pa.Codec("zstd", compression_level=3), numbers(TaskContext.get().partitionId())
        for batch in batches:
            at = 0
            for sizes, ids, words, refs in hot.value.coded(x.as_py() for x in batch.column(1).cast(pa.binary())):
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                packed = [pa.array([zstd.compress(x.tobytes(), asbytes=True)], pa.binary()) for x in (ids, np.array(refs, "<u4"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number)]), one(batch.column(0).slice(at, len(sizes))), one(pa.array(sizes, pa.int64())), *packed, pa.array([len(refs)]), one(pa.array(list(words), pa.binary()))],
                    ["run", "doc_ids", "sizes", "codes", "refs", "holes", "words"],
                )
                at += len(sizes)
        release_memory()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = docs.mapInArrow(code, f"run long, doc_ids array<{id_type}>, sizes array<long>, codes binary, refs binary, holes long, words array<binary>")
    runs = scratch.cut_bucketed(runs, "run")
    # the ids of the holes' words, each asked for once in a run
    asked = runs.select("run", F.posexplode("words").alias("at", "word")).join(rare, "word", "left")
    answers = asked.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("a")).select("run", F.transform("a", lambda a: a["ids"]).alias("answers"))
    answers = scratch.cut(answers, "answers").hint("shuffle_hash")
    whole = runs.drop("words").join(answers, "run", "left").select("doc_ids", "sizes", "codes", "refs", "holes", "answers")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, zstd, hole, kind = finish(), pa.Codec("zstd"), hot.value.hole, hot.value.ids.dtype
        unpack = lambda x, n, kind: np.frombuffer(zstd.decompress(x.as_buffer(), n * kind.itemsize), kind) if n else np.zeros(0, kind)
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, sizes, codes, refs, holes, answers = (c[k] for c in batch.columns)
                ends = np.cumsum(sizes.values.to_numpy())
                codes = unpack(codes, int(ends[-1]), kind)
                ids, begins = filled(codes, codes == hole, unpack(refs, holes.as_py(), np.dtype("<u4")), answers)
                raw, cuts = ids.tobytes(), [0, *(begins[ends] * 4).tolist()]
                yield done(doc_ids.values, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        release_memory()

    return whole.mapInArrow(fill, schema)


def filled(codes: np.ndarray, holes: np.ndarray, refs: np.ndarray, answers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The ids with every hole's put in, and where each code's begin (one entry more)."""
    width = np.ones(len(codes), np.int64)
    if len(refs):
        words = [np.frombuffer(x, "<u4") for x in answers.as_py()]  # a word that the table lacks would be None and fail here
        count = np.fromiter((len(w) for w in words), np.int64, len(words))
        width[holes] = count[refs]
    begins = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(codes.astype("<u4"), width)
    if len(refs):
        values, at = _gather(np.concatenate(words), (np.cumsum(count) - count)[refs], count[refs])
        out[np.arange(len(values)) + np.repeat(begins[:-1][holes] - at[:-1], count[refs])] = values
    return out, begins


def _whole_texts(path: str, finish: Callable[[], Callable]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, words = finish(), Words(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 64):
                part = texts.slice(at, 64)
                yield done(batch.column(0).slice(at, 64), words.ids([x.as_py() or b"" for x in part]))

    return run


def encode_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids binary): packed little-endian unsigned 32-bit ids."""
    done = lambda doc_ids, ids: pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids"])
    return encoded(docs, path, lambda: done, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary", **options)


class Pieces:
    """The id-to-piece table. A vocabulary file without a decoder joins pieces by single spaces, which is tried; one
    with a decoder decodes whole texts itself."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = piece.encode()
        tried = [*self.tokenizer.encode(" ".join(_TRIALS), add_special_tokens=False).ids, 0, 0]
        self.plain = self.tokenizer.decode(tried, skip_special_tokens=False).encode() == b" ".join(self.pieces[i] for i in tried)

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        """The decoded text in parts."""
        numbers = np.frombuffer(ids, "<u4")
        if not self.plain:
            yield self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False).encode()
            return
        for at in range(0, len(numbers), step):
            yield (b" " if at else b"") + b" ".join(map(self.pieces.__getitem__, numbers[at : at + step].tolist()))


def digest(docs: DataFrame, path: str, **options) -> DataFrame:
    """Counts and hashes of ids and of the text decoded from them; ids and decoded text leave a task only as hashes."""

    def finish() -> Callable:
        pieces = Pieces(path)

        def done(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            decoded = []
            for x in ids:
                h = hashlib.sha256()
                for part in pieces.decode(x):
                    h.update(part)
                decoded.append(h.hexdigest())
            return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return done

    return encoded(docs, path, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", **options)
