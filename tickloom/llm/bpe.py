"""BPE encoding and decoding by a traversal of a prefix trie of distinct words.

Let last(p) be the final token of the encoding of a word's prefix p. The
encoding of p is that of the prefix without last(p), and then last(p); a token
may follow another exactly if the two, merged from their bytes, come out as
these two. So a walk over the trie of distinct words, depth first, finds one
token per node from the states on the path above: a node asks for the states
ahead of the tokens that may end it, others get none, and prefixes that words
share are encoded once. A word's tokens are read off backwards along its path.

The sorted list of the words is the depth-first order of their trie: the path to
the next word keeps the states of the prefix that it shares with the last one.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Splits text ahead of the merges, as byte-level tokenizers do.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and chunks of text, whose encodings a worker keeps.
KNOWN_WORDS = 150_000
#: Bytes of text whose pieces a worker holds at a time.
ENCODE_BYTES = 2_000_000
#: Pieces of one text that are handled at a time.
SLICE = 100_000
#: Marks after a word that no contraction begins with.
CLOSING = frozenset(".,;:!?")
#: Beyond every rank.
NEVER = 1 << 60


def byte_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def checked(j: dict) -> dict:
    """The content of a vocabulary file; raises where it isn't plain byte-level BPE, whose splits PATTERN makes."""
    model, pre = j["model"], j.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or j.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the vocabulary isn't byte-level BPE without normalizer, added prefix or other pre-tokenizer")
    if any(t.get(k) for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that match whole words only, or take white space along, aren't supported")
    return j


class Recent(dict):
    """A dict that forgets keys not asked for while KNOWN_WORDS / 2 others were."""

    old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that aren't here; those here stay. Afterwards the caller adds the missing."""
        if len(self) > KNOWN_WORDS // 2:
            self.old = dict(self)
            self.clear()
        out = {k for k in keys if k not in self}
        if self.old:
            back = [k for k in out if k in self.old]
            self.update((k, self.old[k]) for k in back)
            out.difference_update(back)
        return out


class Decoder:
    """Decoder of one vocabulary file of the byte-level BPE kind."""

    def __init__(self, spec: str):
        self.read(checked(json.loads(spec)))

    def read(self, j: dict) -> dict[bytes, int]:
        of = byte_chars()
        vocab = {bytes(of[c] for c in k): v for k, v in j["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        most = max(self.bytes, default=-1) + 1
        self.blob = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(most)), np.uint8)
        self.lengths = np.array([len(self.bytes.get(i, b"")) for i in range(most)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        return vocab

    def decode(self, ids) -> str:
        """The text of ids: their bytes are gathered SLICE tokens at a time. An id that isn't in the vocabulary raises."""
        ids, parts = np.asarray(ids, np.int64), []
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise KeyError("an id isn't in the vocabulary")
        for at in range(0, len(ids), SLICE):
            own = ids[at : at + SLICE]
            n = self.lengths[own]
            ends = np.cumsum(n)
            parts.append(self.blob[np.repeat(self.starts[own] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


class Codec(Decoder):
    """Encoder and decoder of one vocabulary file of the byte-level BPE kind."""

    def __init__(self, spec: str):
        import regex

        j = checked(json.loads(spec))
        self.vocab = self.read(j)
        of = byte_chars()
        raw = lambda s: bytes(of[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        pairs = [(self.vocab[raw(a)], self.vocab[raw(b)]) for a, b in merges]
        self.made = [self.vocab[raw(a + b)] for a, b in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {t: (i, pairs[i]) for i, t in reversed([*enumerate(self.made)])}
        self.whole: dict[int, bool] = {}
        self.edges: dict[tuple, list] = {}
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[tuple, bool] = {}
        self.size = {v: len(k) for k, v in self.vocab.items()}
        self.known, self.words = Recent(), Recent()
        self.white = re.compile(r"\s")
        #: Every end of a token, as a token or -1.
        self.ends = {k[i:]: -1 for k in self.vocab for i in range(len(k))} | self.vocab

    def alone(self, t: int) -> bool:
        """Whether merging the bytes of token t, lowest rank and leftmost first, gives t."""
        ok = self.whole.get(t)
        if ok is None:
            ids = [self.single[b] for b in self.bytes[t]]
            while len(ids) > 1:
                rank, i = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(ids, ids[1:])))
                if rank == NEVER:
                    break
                ids[i : i + 2] = [self.made[rank]]
            ok = self.whole[t] = ids == [t]
        return ok

    def edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens that end (side 1) or begin (side 0) t while it is merged, each
        with the rank of the merge that takes it in; t itself is never taken in."""
        key = (t, side)
        if key not in self.edges:
            out, limit = [], NEVER
            while True:
                out.append((t, limit))
                if t not in self.parts:
                    break
                limit, halves = self.parts[t]
                t = halves[side]
            self.edges[key] = out
        return self.edges[key]

    def follows(self, a: int | None, b: int) -> bool:
        """Whether token b may follow a (or begin a word, for a = None).

        It may unless a merge across the border comes up while both of its sides
        stand there; of equal merges the leftmost comes first.
        """
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            ok = self.alone(b)
            if ok and a is not None:
                for x, x_until in self.edge(a, 1):
                    for y, y_until in self.edge(b, 0):
                        if (r := self.rank.get((x, y))) is not None and r < x_until and r <= y_until:
                            ok = False
            if len(self.fits) > 400_000:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def encode_words(self, words: dict[str, bytes]) -> dict[str, tuple]:
        """Token ids of distinct words, by one walk over their trie; nodes that no encoding asks for get no state."""
        out, path, before = {}, [], b""
        ends, fits, follows, size = self.ends.get, self.fits.get, self.follows, self.size
        for key, word in sorted(words.items(), key=lambda x: x[1]):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            path[shared:] = [None] * (len(word) - shared)
            asked = [(len(word), None)] if word else []  # prefixes whose state is wanted, with the tokens that may end them, longest last
            while asked:
                end, found = asked[-1]
                if found is None:
                    if path[end - 1] is not None:
                        asked.pop()
                        continue
                    found, start = [], end - 1
                    while start >= 0 and (t := ends(word[start:end])) is not None:
                        if t >= 0:
                            found.append((start, t))
                        start -= 1
                    asked[-1] = (end, found)
                while True:
                    start, t = found[-1]
                    last = path[start - 1] if start else None
                    if start and last is None:
                        asked.append((start, None))
                        break
                    ok = fits((last, t))
                    if ok or ok is None and follows(last, t):
                        path[end - 1] = t
                        asked.pop()
                        break
                    found.pop()
            ids, at = [], len(word)
            while at:
                t = path[at - 1]
                ids.append(t)
                at -= size[t]
            ids.reverse()
            out[key] = array("i", ids).tobytes()
            before = word
        return out

    def learn(self, chunks: set) -> None:
        """Encode the chunks that aren't known, their new words in one trie.

        A chunk stands for itself with a space ahead, or as it is if it begins
        with a line feed; (chunk,) begins a text. A chunk with other white space,
        or none but that, is noted as None: its text can't be cut this way.
        """
        new = self.known.missing(chunks)
        if not new:
            return
        split = self.split.findall
        words, plain, white = {}, {}, self.white.search
        for c in new:
            if c.__class__ is str and c.isascii() and c.isalpha():
                plain[c] = " " + c  # a space and letters are one piece
            elif c.__class__ is str and c.isascii() and c[-1:] in CLOSING and c[:-1].isalpha():
                words[c] = (" " + c[:-1], c[-1])  # and a mark after them another
            elif isinstance(c, tuple):
                words[c] = split(c[0]) if c[0] and not white(c[0]) else None
            elif not c or c == "\n" or white(c, 1) or white(c[0]) and c[0] != "\n":
                words[c] = None
            else:
                words[c] = split(c if c[0] == "\n" else " " + c)
        more = self.words.missing({*plain.values(), *itertools.chain.from_iterable(ws for ws in words.values() if ws)})
        self.words.update(self.encode_words({w: w.encode() for w in more}))
        get = self.words.__getitem__
        self.known.update(zip(plain, map(get, plain.values())))
        for c, ws in words.items():
            self.known[c] = ws and b"".join(map(get, ws))

    def encode_part(self, text: str, chunks: list | None = None) -> list[bytes]:
        """Ids of a text without special tokens, as int32 bytes.

        Where white space stands alone, a piece begins at each space and at each
        line feed, so plain splitting gives chunks that recur in other texts.
        """
        chunks = chunks or self.cut(text)
        out = []
        for at in range(0, len(chunks), SLICE):
            some = chunks[at : at + SLICE] if len(chunks) > SLICE else chunks
            try:
                got = [*map(self.known.__getitem__, some)]
            except KeyError:
                self.learn(set(some))
                got = [*map(self.known.__getitem__, some)]
            if None in got:
                break
            out.append(b"".join(got))
        else:
            return out
        out, found = [], self.split.finditer(text)
        while held := [m[0] for m in itertools.islice(found, SLICE)]:
            more = self.words.missing(set(held))
            self.words.update(self.encode_words({w: w.encode() for w in more}))
            out.append(b"".join(map(self.words.__getitem__, held)))
        return out

    @staticmethod
    def cut(text: str) -> list:
        chunks: list = text.replace("\n", " \n").split(" ")
        chunks[0] = (chunks[0],)
        return chunks

    def encode_batch(self, texts: list[str]) -> list:
        """One int32 array of ids per text; the words of short texts share one trie."""
        plan, short = [], set()
        for text in texts:
            one = []
            for part in self.apart.split(text) if self.apart else [text]:
                if part in self.special:
                    one.append((None, np.array([self.special[part]], np.int32).tobytes()))
                elif len(part) <= 8 * SLICE:
                    if part:
                        one.append((part, self.cut(part)))
                        short.update(one[-1][1])
                else:
                    one.append((part, None))
            plan.append(one)
        self.learn(short)
        return [np.frombuffer(b"".join(x for part, c in one for x in ([c] if part is None else self.encode_part(part, c))), np.int32) for one in plan]


_codecs: dict[tuple, Decoder] = {}


def _codec(spec: str, kind=Codec):
    key = (kind, spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = kind(spec)
    return _codecs[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids array<int>.

    vocabulary: path, on the driver, of a byte-level BPE file; its fixed content
    (a few MB) is broadcast. Special tokens written in a text become their ids.
    Null and empty texts give an empty array; other columns are dropped; no
    shuffle. Texts are encoded whole, a long one in slices of words. Repeated
    rows and null ids are encoded like others; an empty table gives an empty
    table. A file of another kind (with a normalizer, say) raises.
    """
    return _encoded(docs, id_col, text_col, vocabulary, lambda codec: lambda ids: (ids,), "ids array<int>")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task and not two, each with a vocabulary: doc_id, ids, decoded."""
    return _encoded(docs, id_col, text_col, vocabulary, lambda codec: lambda ids: (ids, codec.decode(ids)), "ids array<int>, decoded string")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, row_of, schema: str) -> DataFrame:
    """doc_id and the columns of schema, which row_of(codec) makes of a text's ids."""
    content = Path(vocabulary or default_vocabulary()).read_text()
    checked(json.loads(content))
    spec = docs.sparkSession.sparkContext.broadcast(content)

    def make():
        codec = _codec(spec.value)
        row = row_of(codec)
        return lambda texts: [row(ids) for ids in codec.encode_batch(texts)]

    return common.map_texts(common.id_and_text(docs, id_col, text_col), make, schema, ENCODE_BYTES)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the column decoded: the ids' bytes as UTF-8 text.

    Bytes that aren't UTF-8 become U+FFFD, a null or empty array an empty text.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    spark = encoded.sparkSession
    common.ship(spark)
    spec = spark.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_text())

    def run(batches):
        codec = _codec(spec.value, Decoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [codec.decode(x.values.to_numpy() if x.is_valid else ()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.select("doc_id", "ids").mapInArrow(run, StructType.fromDDL(f"doc_id {kinds['doc_id']}, ids array<int>, decoded string"))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding each text, one row per input row.

    A null or empty text has 0 tokens and the hashes of nothing; all else as in encode.
    """
    both = encode_and_decode(docs, vocabulary=vocabulary)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return round_trip(common.documents(spark, sf_dir))
